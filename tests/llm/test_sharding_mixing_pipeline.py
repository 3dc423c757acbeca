"""Extendible hashing, mixing and the pipeline."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from parley.llm import mixing, near_dedup, quality, sharding

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def plain_directory(rows, limit):
    """Shards by splitting a bucket on its next bit until it fits; rows of (key, bytes)."""

    def bits(key):
        return format(int(hashlib.md5(str("" if key is None else key).encode()).hexdigest()[:16], 16), "064b")

    done, open_ = {}, {"": rows}
    while open_:
        prefix, own = open_.popitem()
        if not own:
            continue
        if sum(b for _, b in own) <= limit or len(own) == 1:
            done[prefix] = own
        else:
            for bit in "01":
                open_[prefix + bit] = [r for r in own if bits(r[0]).startswith(prefix + bit)]
    return {key: prefix for prefix, own in done.items() for key, _ in own}


@pytest.mark.parametrize("limit", [50, 400, 5000, 10**6])
def test_shards_equal_plain_splitting(spark, limit):
    rng = random.Random(4)
    rows = [(k, "x" * rng.choice([0, 3, 20, 90, 300])) for k in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.assigned(docs, limit=limit).collect()
    assert {r.doc_id: r.shard_id for r in got} == plain_directory([(k, len(t)) for k, t in rows], limit)
    sizes = defaultdict(int)
    for r in got:
        sizes[r.shard_id] += r.bytes
    assert all(sizes[r.shard_id] == r.shard_bytes for r in got)
    assert all(r.shard_bytes <= limit or r.oversized and r.shard_rows == 1 for r in got)


def test_hot_key_is_split(spark):
    docs = spark.createDataFrame([(1, "x" * 50)] * 400 + [(k, "y" * 50) for k in range(200)], "doc_id long, text string")
    got = sharding.assigned(docs, limit=2000).collect()
    assert len(got) == 600 and all(r.shard_bytes <= 2000 for r in got)
    assert len({r.shard_id for r in got if r.doc_id == 1}) >= 10


def test_shard_edge_cases(spark, tmp_path):
    docs = spark.createDataFrame([(None, None, 1), (1, "é" * 100, 2), (2, None, 3), (3, "", 4)],
                                 "doc_id long, text string, shard_id int")
    got = {r.doc_id: r for r in sharding.assigned(docs, limit=150).collect()}
    assert got[1].bytes == 200 and got[1].oversized and got[None].bytes == 0
    assert sharding.assigned(docs.limit(0)).count() == 0
    out = str(tmp_path / "shards")
    sharding.write_shards(docs, out, limit=150)
    back = spark.read.option("basePath", out).parquet(out)
    assert back.count() == 4 and sorted(back.columns) == sorted(docs.columns)


def test_written_rows_with_repeated_and_null_keys_stay_as_they_are(spark, tmp_path):
    rows = [(7, "a" * 40), (7, "b" * 40), (None, "c" * 90), (None, "d"), (None, None), (8, "e")] + [(9, "f" * 50)] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = str(tmp_path / "repeated")
    sharding.write_shards(docs, out, limit=100)
    back = spark.read.option("basePath", out).schema("doc_id long, text string, shard_id string").parquet(out)
    assert sorted(map(repr, back.select("doc_id", "text").collect())) == sorted(map(repr, docs.collect()))
    sizes = defaultdict(int)
    for r in back.collect():
        sizes[r.shard_id] += len(r.text or "")
    assert max(sizes.values()) <= 100 and len(sizes) > 20
    empty = str(tmp_path / "empty")
    sharding.write_shards(docs.limit(0), empty)
    assert spark.read.schema(docs.schema).parquet(empty).count() == 0


def tongues(rng, lang, n):
    stems = {"aa": ["tra", "lo", "min", "que"], "bb": ["sch", "wer", "ung", "ach"], "cc": ["ki", "nu", "poa", "wai"]}[lang]
    return " ".join("".join(rng.choices(stems, k=2)) for _ in range(n))


def corpus(spark, rng, n=300):
    rows = []
    for k in range(n):
        lang = rng.choices(["aa", "bb", "cc"], [6, 3, 1])[0]
        size = rng.randint(20, 60)
        text = tongues(rng, lang, size) if k % 3 else tongues(rng, lang, size) + " " + tongues(rng, "aa", size // 2)
        rows.append((k, text, lang, None, None))
    return spark.createDataFrame(rows, DOCS)


def test_rates_match_targets(spark):
    docs = corpus(spark, random.Random(6))
    targets = {"aa": 0.4, "bb": 0.3, "cc": 0.3}
    got = mixing.mixed(docs, docs, "lang", targets).collect()
    rates, n = np.array([r.rate for r in got]), np.array([r.n_tokens for r in got], float)
    posterior = np.array([r.posterior for r in got])
    assert (rates >= 0).all() and np.allclose(posterior.sum(1), 1)
    shares = (rates * n) @ posterior / n.sum()
    assert np.allclose(shares, [0.4, 0.3, 0.3], atol=2e-3)
    # what least squares with the same pull gives, by plain projected gradient steps
    weight, r = n / n.sum(), np.ones(len(n))
    for _ in range(4000):
        error = (weight * r) @ posterior - np.array([0.4, 0.3, 0.3])
        r = np.maximum(0, r - 0.5 * (posterior @ error + mixing.PULL * (r - 1)))
    assert np.abs(weight * r @ posterior - shares).max() < 1e-3
    assert all(r.copies in (int(r.rate), int(r.rate) + 1) for r in got)


def test_unreachable_targets_are_approached(spark):
    docs = corpus(spark, random.Random(7))
    got = mixing.mixed(docs, docs, "lang", {"aa": 0.0, "cc": 1.0}).collect()
    assert min(r.rate for r in got) == 0.0 and max(r.rate for r in got) > 3


def test_mixing_edge_cases(spark):
    docs = corpus(spark, random.Random(8), 120)
    odd = docs.union(spark.createDataFrame([(None, None, None, None, None), (3, "", "aa", None, None), (500, "x", None, "s", 1)],
                                           DOCS)).selectExpr("*", "1 AS mixed_key", "2 AS rate")
    got = mixing.mixed(odd, docs, "lang", {"aa": 0.5, "bb": 0.5, "none": 3.0}).collect()
    assert len(got) == 123 and sum(r.n_tokens == 0 for r in got) == 2
    sampled = mixing.resampled(odd, docs, "lang", {"aa": 0.5, "bb": 0.2, "cc": 0.3})
    assert sampled.columns == odd.columns and sampled.count() > 0
    assert mixing.mixed(docs.limit(0), docs, "lang", {"aa": 1.0}).count() == 0
    one = mixing.mixed(docs, docs.filter("lang = 'aa'"), "lang", {"aa": 1.0}).collect()
    assert {r.rate for r in one} == {1.0}
    assert mixing.mixed(docs, docs.limit(0), "lang", {"aa": 1.0}).count() == 120


def test_pipeline_stages_keep_columns_and_clean_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    cleaned = corpus_pipeline.quality_rules(spark, docs, sf).cache()
    kept = {r.doc_id for r in quality.judged(docs).filter("kept").collect()}
    assert cleaned.columns == docs.columns and {r.doc_id for r in cleaned.collect()} == kept
    tongue = stage["language"](spark, cleaned, sf).cache()
    assert tongue.columns == docs.columns and tongue.count() == cleaned.count()
    single = stage["near duplicates"](spark, tongue, sf).cache()
    ids = {r.doc_id for r in near_dedup.labelled(tongue).filter("kept").collect()}
    assert single.columns == docs.columns and sorted(r.doc_id for r in single.collect()) == sorted(ids)
    mix = stage["mixture"](spark, single, sf)
    assert mix.columns == docs.columns
    last = stage["tokens"](spark, single, sf).collect()
    texts = {r.doc_id: r.text for r in single.collect()}
    assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in last)


def test_pipeline_edge_cases(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, None, None, None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    for _, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, docs.limit(0), "").count() == 0
        assert stage(spark, docs, "").columns == docs.columns
    assert corpus_pipeline.STAGES[4][1](spark, docs, "").count() == 3


@pytest.mark.parametrize("unlearned", ["de"])
def test_languages_without_labels_go_and_clean_documents_stay(spark, unlearned):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("lang is not null")
    cleaned = corpus_pipeline.quality_rules(spark, docs, sf).cache()
    true = {r.doc_id: r.lang for r in cleaned.select("doc_id", "lang").collect()}
    # a tenth of the other documents has no label either
    hidden = cleaned.withColumn("lang", F.when((F.col("lang") != unlearned) & (F.col("doc_id") % 10 != 0), F.col("lang")))
    got = {r.doc_id: r.lang for r in corpus_pipeline.language(spark, hidden, sf).select("doc_id", "lang").collect()}
    assert [k for k in got if true[k] == unlearned] == []
    assert sorted(got) == sorted(k for k in true if true[k] != unlearned)
    assert all(got[k] == true[k] for k in got)
