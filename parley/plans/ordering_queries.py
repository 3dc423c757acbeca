"""Samples, shuffles, splits, last rows, batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.operators import ordering as O
from parley.plans import fixtures as X
from parley.plans.registry import query


def docs(spark, sf):
    return X.table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")


DOC = "doc_id, lang, source, n_chars"


def md5_order(seed: int, key: str = "doc_id") -> str:
    return f"md5('{seed}:' || CAST({key} AS VARCHAR)), {key}"


@query("sample_exact", f"SELECT {DOC} FROM documents ORDER BY {md5_order(42)} LIMIT 150")
def sample_exact(spark, sf):
    return O.sample_n(docs(spark, sf), 150, "doc_id")


@query("sample_one", f"SELECT {DOC} FROM documents ORDER BY {md5_order(38)} LIMIT 1")
def sample_one(spark, sf):
    return O.sample_n(docs(spark, sf), 1, "doc_id", seed=38)


@query(
    "sample_by_language_and_length",
    f"""WITH s AS (SELECT doc_id, text, lang FROM documents WHERE lang = 'en' ORDER BY {md5_order(5)} LIMIT 100)
SELECT doc_id, text, lang FROM s WHERE length(text) BETWEEN 50 AND 600""",
)
def sample_by_language_and_length(spark, sf):
    from parley.operators.conversations import in_languages

    english = in_languages(X.table(spark, sf, "documents").select("doc_id", "text", "lang"), ["en"], "lang")
    return O.sample_n(english, 100, "doc_id", seed=5).where(F.length("text").between(50, 600))


@query("shuffled", f"SELECT doc_id, row_number() OVER (ORDER BY {md5_order(42)}) AS seq FROM documents")
def shuffled(spark, sf):
    return O.number_rows(docs(spark, sf), "doc_id").select("doc_id", "seq")


@query("last_records", f"SELECT {DOC} FROM documents ORDER BY doc_id DESC LIMIT 25")
def last_records(spark, sf):
    return O.last_n(docs(spark, sf), 25, "doc_id")


@query(
    "head_and_tail",
    """SELECT 'head' AS part, * FROM (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 3)
UNION ALL SELECT 'tail' AS part, * FROM (SELECT doc_id FROM documents ORDER BY doc_id DESC LIMIT 3)""",
)
def head_and_tail(spark, sf):
    ids = docs(spark, sf).select("doc_id")
    head, tail = O.first_n(ids, 3, "doc_id"), O.last_n(ids, 3, "doc_id")
    return head.select(F.lit("head").alias("part"), "doc_id").union(tail.select(F.lit("tail").alias("part"), "doc_id"))


@query(
    "shuffled_records",
    f"SELECT {DOC} FROM documents WHERE lang = 'fr' ORDER BY {md5_order(42)} LIMIT 20",
)
def shuffled_records(spark, sf):
    return O.sample_n(docs(spark, sf).where("lang = 'fr'"), 20, "doc_id", 42)


@query(
    "drop_last_of_split",
    f"""WITH {X.NLI}, r AS (
  SELECT seq, split, label, row_number() OVER (PARTITION BY split ORDER BY seq DESC) AS back FROM nli)
SELECT seq, split, label FROM r WHERE split <> 'train' OR back > 2""",
)
def drop_last_of_split(spark, sf):
    return O.drop_last(X.nli(spark, sf, False).select("seq", "split", "label"), 2, "seq", "train")


@query(
    "positional_split",
    f"""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {md5_order(42)}) AS rn, count(*) OVER () AS n FROM documents)
SELECT doc_id, CASE WHEN rn <= floor(n * CAST({1 - 0.4!r} AS DOUBLE)) THEN 'train' ELSE 'eval' END AS split FROM r""",
)
def positional_split(spark, sf):
    return O.positional_split(docs(spark, sf), "doc_id", 0.4).select("doc_id", "split")


@query(
    "half_split",
    f"""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {md5_order(38)}) AS rn, count(*) OVER () AS n FROM documents)
SELECT doc_id, CASE WHEN rn <= n - ceil(n * 0.5) THEN 'train' ELSE 'test' END AS split FROM r""",
)
def half_split(spark, sf):
    return O.share_split(docs(spark, sf), "doc_id", 0.5).select("doc_id", "split")


@query("row_window", f"SELECT {DOC} FROM documents ORDER BY doc_id LIMIT 5 OFFSET 117")
def row_window(spark, sf):
    return O.row_window(docs(spark, sf), 117, 5, "doc_id")


@query("row_at_position", "SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 1 OFFSET 146")
def row_at_position(spark, sf):
    return O.row_window(X.table(spark, sf, "documents").select("doc_id", "text"), 146, 1, "doc_id")


@query("row_numbers", "SELECT vec_id, row_number() OVER (ORDER BY md5('9:' || CAST(vec_id AS VARCHAR))) AS seq FROM embeddings")
def row_numbers(spark, sf):
    return O.number_rows(X.table(spark, sf, "embeddings").select("vec_id"), "vec_id", 9)


@query(
    "length_batches",
    f"""WITH r AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY {md5_order(42)}) AS rn FROM documents),
m AS (SELECT *, (rn - 1) // 400 AS mega_batch FROM r),
p AS (SELECT *, row_number() OVER (PARTITION BY mega_batch ORDER BY n_chars DESC, doc_id) AS place FROM m)
SELECT doc_id, n_chars, CAST(mega_batch AS BIGINT) AS mega_batch,
       CAST(mega_batch * 50 + (place - 1) // 8 AS BIGINT) AS batch FROM p""",
)
def length_batches(spark, sf):
    rows = X.table(spark, sf, "documents").select("doc_id", "n_chars")
    return O.length_batches(rows, "doc_id", F.col("n_chars"), 8)
