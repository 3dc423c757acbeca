"""Operator 12, grouping of spelling variants over a reduced alphabet.

Letters are hashed to a few symbols, so that the one-edit neighbourhood of a reduced word is small enough to be generated whole.
Each neighbourhood is joined with the reduced vocabulary; words that meet are verified on their own letters. An edge of the
neighbourhood graph is generated from one of its ends only: a deletion from the longer word (which is the insertion into the
shorter one), a replacement from the word with the smaller symbol, and equal reduced words meet as they are. So no pair is
lost and none is met twice. The number of symbols grows slowly with the vocabulary, which keeps reduced words apart.

Neighbourhoods grow with the square of a word's length in bytes, so words of more than LONG code points meet otherwise, and as
exactly: one edit leaves the first or the last half of the shorter word as it is, so words of a length that share a half, and
words one apart in length that share a half of the shorter, are verified.

Both sides of every join grow with the vocabulary, and Spark's estimate of a side forgets what an explode adds and a file's
compression, so joins are merges: nothing is broadcast.

A word's form is its near word found most often, if that is found at least twice as often. Roots follow forms by pointer
doubling, whose rounds grow with the logarithm of the longest chain (itself at most the logarithm of the largest count).

Edge cases: a null text has no words, a null id counts as an empty one. Rows with equal ids are texts of their own. Runs of any
length are whole. Ties go to the word that is smaller in code-point order. Other columns are ignored, whatever their names.
An empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from parley.llm.exprs import ascii_lower
from parley.session import materialize

MIN_LENGTH = 5
MIN_COUNT = 3
#: A letter is deleted from occurrences whose checksum this number divides.
DELETED = 97
#: A form is found at least so many times as often as its variant.
RATIO = 2
#: Code points of the longest words whose neighbourhoods are generated.
LONG = 48
LETTERS = "a-zÀ-ÿ"
ALPHABET = "".join(map(chr, [*range(0x61, 0x7B), *range(0xC0, 0x100)]))
#: Symbols of reduced words: at least FEW, and about the 7th root of the number of words.
FEW, MANY = 4, 26


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (word, n): runs of letters with a letter deleted from some occurrences, at least MIN_COUNT times found."""
    low = ascii_lower(F.coalesce(F.col(f"`{text}`"), F.lit("")))
    # a shorter run gives no word of the least length
    runs = F.regexp_extract_all(low, F.lit(f"[{LETTERS}]{{{MIN_LENGTH},}}"), F.lit(0))
    rows = docs.select(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    rows = rows.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    word = F.when(F.col("h") % DELETED == 0, cut).otherwise(F.col("run"))
    counts = rows.select(word.alias("word")).filter(F.length("word") >= MIN_LENGTH).groupBy("word")
    return counts.agg(F.count("*").alias("n")).filter(F.col("n") >= MIN_COUNT)


def symbols_for(words: int) -> int:
    return min(MANY, max(FEW, math.ceil(max(words, 1) ** (1 / 7))))


def reduced(word: Column, symbols: int) -> Column:
    """Each letter hashed to one of the symbols A, B, ..; code points outside the alphabet count as its first letter."""
    known = F.regexp_replace(word, f"[^{LETTERS}]", ALPHABET[0])
    return F.translate(known, ALPHABET, "".join(chr(65 + zlib.crc32(c.encode()) % symbols) for c in ALPHABET))


def _neighbourhood(word: Column, symbols: int) -> Column:
    """A reduced word, its deletions, and its replacements by larger symbols."""
    places = F.sequence(F.lit(1), F.length(word))

    def before(i: Column) -> Column:
        return F.substr(word, F.lit(1), i - 1)

    def after(i: Column) -> Column:
        return F.substr(word, i + 1)

    deleted = F.array_distinct(F.transform(places, lambda i: F.concat(before(i), after(i))))

    def replaced(symbol: str) -> Column:
        smaller = F.filter(places, lambda i: F.substr(word, i, F.lit(1)) < F.lit(symbol))
        return F.transform(smaller, lambda i: F.concat(before(i), F.lit(symbol), after(i)))

    larger = [replaced(chr(65 + k)) for k in range(1, symbols)]
    return F.concat(F.array(word), deleted, *larger)


@F.arrow_udf(BooleanType())
def one_edit_apart(words: pa.Array, others: pa.Array) -> pa.Array:
    """Whether two words differ by one edit, in time that grows with their length (an edit distance's grows faster)."""

    def apart(a: str, b: str) -> bool:
        if len(a) > len(b):
            a, b = b, a
        if a == b or len(b) - len(a) > 1:
            return False
        same, differs = 0, len(a) + 1  # the common beginning is at least ``same`` long and shorter than ``differs``
        while differs - same > 1:
            middle = (same + differs) // 2
            same, differs = (middle, differs) if a[same:middle] == b[same:middle] else (same, middle)
        return a[same + (len(a) == len(b)):] == b[same + 1:]

    return pa.array([apart(a, b) for a, b in zip(words.to_pylist(), others.to_pylist())], pa.bool_())


def _short_pairs(words: DataFrame, symbols: int) -> DataFrame:
    """Pairs of near words of up to LONG code points, each once."""
    words = words.filter(F.length("word") <= LONG).withColumn("code", reduced(F.col("word"), symbols))
    asking = words.select("word", "n", "code", F.explode(_neighbourhood(F.col("code"), symbols)).alias("key"))
    asking = asking.select("word", "n", "key", (F.col("key") == F.col("code")).alias("same"))
    known = words.select(F.col("code").alias("key"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    met = asking.hint("merge").join(known, "key").filter(~F.col("same") | (F.col("word") < F.col("other")))
    return met.filter(F.levenshtein("word", "other", 1) == 1).select("word", "n", "other", "other_n")


def _long_pairs(words: DataFrame) -> DataFrame:
    """Pairs of near words of which one has more than LONG code points, each once."""
    words = words.filter(F.length("word") >= LONG).withColumn("size", F.length("word"))

    def halves(size: Column) -> Column:
        """The halves that a word shares with a near one, if the shorter of them has this size."""
        half = F.floor(size / 2).cast("int")
        first = F.xxhash64(F.substr("word", F.lit(1), half))
        last = F.xxhash64(F.substr("word", F.col("size") - (size - half) + 1))
        return F.array(F.struct(size.alias("of"), F.lit(True).alias("first"), first.alias("part")),
                       F.struct(size.alias("of"), F.lit(False).alias("first"), last.alias("part")))

    asked = F.concat(halves(F.col("size")), halves(F.col("size") - 1))
    asking = words.filter(F.col("size") > LONG).select("word", "n", "size", F.inline(asked))
    known = words.select(F.col("word").alias("other"), F.col("n").alias("other_n"), F.inline(halves(F.col("size"))))
    met = asking.hint("merge").join(known, ["of", "first", "part"])
    met = met.filter((F.col("size") > F.col("of")) | (F.col("word") < F.col("other")))
    half = F.floor(F.col("of") / 2).cast("int")
    both = F.substr("word", F.lit(1), half) == F.substr("other", F.lit(1), half)
    near = met.filter((F.col("first") | ~both) & one_edit_apart("word", "other"))
    return near.select("word", "n", "other", "other_n")


def near_pairs(words: DataFrame) -> DataFrame:
    """Rows (word, n, other, other_n): pairs of words that differ by one inserted, deleted or replaced code point, once each.

    ``words`` has distinct words with their counts n.
    """
    return _short_pairs(words, symbols_for(words.count())).unionByName(_long_pairs(words))


def _roots(forms: DataFrame) -> DataFrame:
    """Rows (word, root) of rows (word, form)."""
    steps = materialize(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while not steps.filter("moved").isEmpty():
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = F.col("further").isNotNull()
        steps = materialize(steps.drop("moved").join(further.hint("merge"), "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), moved.alias("moved")), "roots")
    return steps.select("word", "root")


def grouped(words: DataFrame) -> DataFrame:
    """Rows (word, form, root, n, n_near, form_n) of distinct words with their counts n."""
    words = materialize(words.select("word", "n"), "words")
    pairs = near_pairs(words)
    both = pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"),
                                          F.col("word").alias("other"), F.col("n").alias("other_n")))
    best = both.groupBy("word", "n").agg(F.count("*").alias("n_near"),
                                         F.min(F.struct((-F.col("other_n")).alias("n"), "other")).alias("best"))
    has = -F.col("best.n") >= RATIO * F.col("n")
    near = materialize(best.select("word", "n_near", F.when(has, F.col("best.other")).alias("form"),
                                   F.when(has, -F.col("best.n")).alias("form_n")), "near-words")
    roots = _roots(near.filter(F.col("form").isNotNull()))
    return words.join(near.hint("merge"), "word", "left").join(roots.hint("merge"), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (word, form, root, n, n_near, form_n) of the words of all texts."""
    return grouped(word_counts(docs, key, text))


ORACLE = rf"""
WITH RECURSIVE runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]{{{MIN_LENGTH},}}')) AS run
  FROM documents),
distinct_runs AS (SELECT id, run, count(*) AS c, hex(encode(id || ':' || run)) AS h FROM runs GROUP BY ALL),
-- crc32 bit by bit: each byte enters with the first of its eight steps
summed AS (SELECT run, c, xor(4294967295, list_reduce(
    list_concat([4294967295::BIGINT], flatten(list_transform(range(1, len(h), 2),
      lambda i: [('0x' || substr(h, i, 2))::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
    lambda s, b: xor(xor(s, b) >> 1, 3988292384 * (xor(s, b) & 1)))) AS crc FROM distinct_runs),
cut AS (SELECT c, CASE WHEN crc % {DELETED} = 0
    THEN substr(run, 1, CAST(crc % length(run) AS INTEGER)) || substr(run, CAST(crc % length(run) AS INTEGER) + 2)
    ELSE run END AS word FROM summed),
words AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM cut WHERE length(word) >= {MIN_LENGTH} GROUP BY word
  HAVING sum(c) >= {MIN_COUNT}),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
without AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM places),
shorter AS (SELECT DISTINCT w.word, w.n, s.word AS other, s.n AS other_n FROM without w JOIN words s ON s.word = w.rest),
near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM without a JOIN without b
    ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION ALL SELECT word, n, other, other_n FROM shorter
  UNION ALL SELECT other, other_n, word, n FROM shorter),
numbered AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, encode(other)) AS r,
  count(*) OVER (PARTITION BY word) AS n_near FROM near),
best AS (SELECT word, n_near, CASE WHEN other_n >= {RATIO} * n THEN other END AS form,
  CASE WHEN other_n >= {RATIO} * n THEN other_n END AS form_n FROM numbered WHERE r = 1),
paths AS (
  SELECT word, form AS at FROM best WHERE form IS NOT NULL
  UNION ALL SELECT p.word, b.form FROM paths p JOIN best b ON b.word = p.at WHERE b.form IS NOT NULL),
roots AS (SELECT p.word, p.at AS root FROM paths p LEFT JOIN best b ON b.word = p.at WHERE b.form IS NULL)
SELECT w.word, b.form, coalesce(r.root, w.word) AS root, w.n, coalesce(b.n_near, 0) AS n_near, b.form_n
FROM words w LEFT JOIN best b ON b.word = w.word LEFT JOIN roots r ON r.word = w.word
"""
