from datetime import date

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from parley.operators import clusters as U
from parley.operators import conversations as C
from parley.schemas import MESSAGES
from parley.session import fresh_path
from parley.sources import lists, published, tables
from parley.streaming import streams as S
from tools.check import compare, connect


@pytest.fixture(scope="module")
def dataset(spark):
    rows = [(i, f'text "{i}",\nnext', "ai", i % 3, "test" if i % 4 == 0 else "train") for i in range(20)]
    return spark.createDataFrame(rows, "seq bigint, text string, category string, label int, split string")


def test_snapshot_is_dated_and_not_overwritten(spark, dataset):
    base = fresh_path(spark, "base")
    path = tables.snapshot(dataset, base, day=date(2024, 12, 16))
    assert path.endswith("nli_20241216") and tables.restore(spark, path).count() == 20
    with pytest.raises(Exception, match="already exists"):
        tables.snapshot(dataset, base, day=date(2024, 12, 16))


def test_publishing_replaces_one_split_only(spark, dataset):
    path = fresh_path(spark, "published")
    dataset.write.partitionBy("split").parquet(path)
    tables.publish_split(dataset.where("split = 'test'").drop("split").limit(2), path, "test")
    assert dict(tables.restore(spark, path).groupBy("split").count().collect()) == {"test": 2, "train": 15}
    # rows may come from the version before, and an empty table empties its split
    tables.publish_split(tables.restore(spark, path).where("split = 'test'").drop("split").limit(1), path, "test")
    assert dict(tables.restore(spark, path).groupBy("split").count().collect()) == {"test": 1, "train": 15}
    tables.publish_split(dataset.limit(0), path, "test")
    assert dict(tables.restore(spark, path).groupBy("split").count().collect()) == {"train": 15}
    tables.publish_split(dataset.limit(0), path, "train")
    assert tables.restore(spark, path).count() == 0 and tables.versions(spark, path) == [1, 2, 3, 4]


def test_append_and_publish_checks_labels(spark, dataset):
    path = fresh_path(spark, "appended")
    dataset.write.partitionBy("split").parquet(path)
    new = dataset.limit(1).drop("split")
    tables.append_and_publish(spark, path, new, "train")
    assert dict(tables.restore(spark, path).groupBy("split").count().collect()) == {"test": 5, "train": 16}
    with pytest.raises(Exception, match="unknown label 9"):
        tables.append_and_publish(spark, path, new.withColumn("label", F.lit(9)), "train")
    assert tables.restore(spark, path).count() == 21


def files_below(spark, path):
    return {r["path"] for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path").collect()}


def test_publishing_writes_only_its_split_and_old_versions_stay(spark, dataset):
    path = fresh_path(spark, "published")
    dataset.write.partitionBy("split").parquet(path)
    plain = files_below(spark, path)
    published.publish_split(dataset.where("split = 'test'").limit(3), path, "test")
    first = files_below(spark, f"{path}/_published/data")
    published.publish_split(dataset.where("split = 'train'").limit(4).withColumn("more", F.lit(1)), path, "train")
    published.append_rows(dataset.limit(2), path, "test")
    assert plain == files_below(spark, path) and first < files_below(spark, f"{path}/_published/data")
    sizes = [dict(published.restore(spark, path, v).groupBy("split").count().collect()) for v in published.versions(spark, path)]
    assert sizes == [{"test": 3, "train": 15}, {"test": 3, "train": 4}, {"test": 5, "train": 4}]
    assert published.restore(spark, path).where("more = 1").count() == 4
    assert spark.read.parquet(path).count() == 20


def test_of_two_writers_of_a_split_one_gets_a_conflict(spark, dataset):
    path = fresh_path(spark, "raced")
    dataset.write.parquet(path)
    base = published.publish_split(dataset.where("split = 'test'"), path, "test")
    published.publish_split(dataset.limit(1), path, "test", base)
    with pytest.raises(published.Conflict, match="changed in version 2, after version 1"):
        published.publish_split(dataset.limit(2), path, "test", base)
    # another split and appended rows do not conflict
    assert published.publish_split(dataset.limit(3), path, "train", base) == 3
    assert published.append_rows(dataset.limit(2), path, "test") == 4
    assert dict(published.restore(spark, path).groupBy("split").count().collect()) == {"test": 3, "train": 3}


def test_a_writer_that_loses_the_race_for_a_number_tries_the_next(spark, dataset, monkeypatch):
    path = fresh_path(spark, "raced")
    dataset.write.parquet(path)
    real, raced = published._put, []

    def slow(spark, path, content):
        if not raced:  # another writer commits between the read of the manifest and its replacement
            raced.append(content["version"])
            published.append_rows(dataset.limit(1), path, "train")
        return real(spark, path, content)

    monkeypatch.setattr(published, "_put", slow)
    assert published.publish_split(dataset.limit(2), path, "test") == 2 and raced == [1]
    assert dict(published.restore(spark, path).groupBy("split").count().collect()) == {"test": 2, "train": 16}
    assert not real(spark, path, {**published.manifest(spark, path), "version": 1})


def test_publishing_without_a_plain_dataset(spark, dataset):
    path = fresh_path(spark, "new")
    published.publish_split(dataset.where("split = 'test'"), path, "test")
    assert dict(published.restore(spark, path).groupBy("split").count().collect()) == {"test": 5}


def test_one_of_several_files_is_drawn(spark, dataset):
    path = fresh_path(spark, "files")
    dataset.repartition(4).withColumn("file", F.spark_partition_id()).write.parquet(path)
    drawn = [{r["file"] for r in tables.sample_one_file(spark, path, 2, "seq", seed).collect()} for seed in range(6)]
    assert all(len(d) == 1 for d in drawn) and len(set().union(*drawn)) > 1


def test_one_file_sample_returns_rows_of_the_drawn_file(spark):
    """The query gives the 30 rows that its SQL knows, not a count of them."""
    name = "sample_of_one_file"
    sf = "/root/testdata/sf0.01"
    ok, note = compare(spark, connect(sf), sf, name, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, note
    rows = entry.queries()[name](spark, sf).collect()
    assert len(rows) == 30 and {(r["file"], r["files"]) for r in rows} == {(rows[0]["file"], 4)}
    assert {(r["conv_id"] + r["turn"]) % 4 for r in rows} == {rows[0]["file"]}


def test_split_read_is_pruned(spark, dataset):
    path = tables.snapshot(dataset, fresh_path(spark, "base"))
    plan = tables.read_split(spark, path, "test")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan


def test_csv_keeps_quotes_and_lines(spark, dataset):
    path = fresh_path(spark, "csv")
    tables.write_csv(dataset.withColumn("scores", F.array(F.lit(0.5))), path)
    back = tables.read_csv(spark, path, dataset.schema.add("scores", "string"))
    assert sorted(r["text"] for r in back.collect()) == sorted(r["text"] for r in dataset.collect())
    assert back.first()["scores"] == "[0.5]"


def test_csv_keeps_blanks_and_empty_texts(spark):
    texts = ["  padded\t", "", None, '"', "\\N", " ", "a,b", "line\nline", '""']
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    path = fresh_path(spark, "csv")
    tables.write_csv(rows, path)
    assert dict(tables.read_csv(spark, path, rows.schema).collect()) == dict(enumerate(texts))


def test_text_lists(spark, tmp_path):
    (tmp_path / "phrases").write_text("  one [x] \n\n two\n")
    (tmp_path / "categories").write_text("Coding\nGeneral Q&A\n\nOther")
    (tmp_path / "annotations").write_text("a1; roleplay, storytelling\nb2; business\n\nnotes:\nsome note\n")
    assert {r[0] for r in lists.read_phrases(spark, str(tmp_path / "phrases")).collect()} == {"one [x]", "two"}
    assert [tuple(r) for r in lists.read_categories(spark, str(tmp_path / "categories")).collect()] == [
        (0, "Coding"), (1, "General Q&A"), (2, "Other")]
    assert {tuple(r) for r in lists.read_annotations(spark, str(tmp_path / "annotations")).collect()} == {
        ("a1", "roleplay"), ("a1", "storytelling"), ("b2", "business")}


def test_one_file_sample_reads_one_file(spark):
    path = fresh_path(spark, "files")
    spark.range(100).repartition(4).write.parquet(path)
    sample = tables.sample_one_file(spark, path, 5, "id")
    assert sample.count() == 5 and len(sample.inputFiles()) == 1
    with pytest.raises(ValueError):
        tables.sample_one_file(spark, path, 60, "id")


# ---- streams -----------------------------------------------------------------------------------------------------

def arriving(spark, batches):
    """A folder with one file per batch, in order of arrival."""
    path = fresh_path(spark, "arriving")
    for rows in batches:
        spark.createDataFrame(rows, MESSAGES).coalesce(1).write.mode("append").parquet(path)
    return path


def rows_for(conversation, start, roles):
    return [(conversation, start + i, r, f"{conversation}{start + i}", "English") for i, r in enumerate(roles)]


CHATS = [[("a", ["user", "user", "assistant"]), ("b", ["system", "assistant"])],
         [("a", ["assistant", "user"]), ("b", ["user"]), ("c", ["assistant"])],
         [("b", ["assistant", "assistant", "user"])],
         [("a", ["system", "assistant", "user", "assistant"]), ("b", ["assistant"]), ("c", ["user", "assistant"])]]


def chat_batches():
    """The same conversations in four micro-batches, with places that go on."""
    places, made = {}, []
    for batch in CHATS:
        rows = []
        for conversation, roles in batch:
            start = places.get(conversation, 0)
            rows += rows_for(conversation, start, roles)
            places[conversation] = start + len(roles)
        made.append(rows[::-1])
    return made


def run_again(stream, out, checkpoint):
    S.to_table(stream, out, checkpoint).awaitTermination()


@pytest.mark.parametrize("operator,batch", [(S.turn_numbers, C.number_turns), (S.turn_pairs, C.pair_turns)])
def test_turns_on_a_stream_equal_those_on_a_table_over_batches_and_a_restart(spark, operator, batch):
    batches, out, checkpoint = chat_batches(), fresh_path(spark, "out"), fresh_path(spark, "checkpoint")
    path = arriving(spark, batches[:3])
    for more in (None, batches[3]):
        if more:  # the query starts again from its checkpoint
            spark.createDataFrame(more, MESSAGES).coalesce(1).write.mode("append").parquet(path)
        run_again(operator(S.open_stream(spark, path, MESSAGES, files_per_batch=1)), out, checkpoint)
    expected = batch(spark.read.schema(MESSAGES).parquet(path))
    got = spark.read.parquet(out)
    columns = [c for c in got.columns if c in expected.columns]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, expected.select(columns).collect()))
    assert got.count() > 3


def test_idle_conversations_expire(spark, monkeypatch):
    path = arriving(spark, [rows_for("a", 0, ["user", "user"]), rows_for("b", 0, ["user"]), rows_for("a", 2, ["assistant", "user"])])
    stream = S.open_stream(spark, path, MESSAGES, files_per_batch=1)
    got = S.drain(S.turn_numbers(stream, idle=0.001))
    assert sorted((r["conversation_id"], r["pos"], r["turn_n"]) for r in got.collect()) == [
        ("a", 0, 1), ("a", 1, 2), ("a", 2, 0), ("a", 3, 1), ("b", 0, 1)]
    assert S.drain(S.turn_pairs(stream, idle=0.001)).count() == 0


def test_stream_filters_equal_batch(spark):
    path = arriving(spark, [rows_for("a", 0, ["user", "assistant"]), rows_for("b", 0, ["system", "user"])])
    stream = S.open_stream(spark, path, MESSAGES, files_per_batch=1)
    prompts = S.drain(C.message_prompts(stream, min_chars=1))
    assert sorted(r["prompt"] for r in prompts.collect()) == ["a0", "b1"]
    assert S.first_rows(stream.withColumn("k", F.col("content")), 3, "k").count() == 3


# ---- clusters ----------------------------------------------------------------------------------------------------

def test_clusters_and_components(spark):
    rows = [(i, [float(i % 3 * 10), float(i % 3), 1.0 + i * 0.001]) for i in range(30)]
    df = U.array_vectors(spark.createDataFrame(rows, "id int, v array<double>"), "v")
    assigned = U.kmeans_clusters(df, 3)
    assert {r["cluster"] for r in assigned.collect()} == {1, 2, 3}
    assert U.kmeans_cost(df, 3) <= U.kmeans_cost(df, 2)
    assert assigned.groupBy((F.col("id") % 3).alias("g")).agg(F.count_distinct("cluster").alias("n")).where("n > 1").count() == 0
    pcs = U.pca_2d(df).agg(F.avg("pc1"), F.avg("pc2")).first()
    assert all(abs(x) < 1e-9 for x in pcs)
