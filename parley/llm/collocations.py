"""Operator 13, phrase collocations by marginalising the counts of the longest windows.

Texts are split into pieces at punctuation and line ends and the pieces into words. Every word starts one window: the word
and, as lead columns, the next words of its piece, padded with '' past the end. Only these longest windows are counted, in
each task before the shuffle. The counts of all shorter phrases are sums over them: a phrase occurs as often as the windows
that start with it. Windows are shuffled by all their words but the last, so whole windows and the prefixes one word shorter
are summed in place. Of a prefix only its share in the one a word shorter is handed on unless it is found often enough; a
ROLLUP of these sums gives all shorter prefixes and, at its top, the words of a language. (A ROLLUP over the windows themselves
would shuffle each window once more for the prefix level.) Tasks hand on their windows in order, so that rows with common words
lie together and compress well.

A phrase is scored by the worst of its cuts in two: floor(1000000 * a * a / (l * r)) in exact decimal numbers, where a, l and
r are the counts of the phrase and its parts, for texts of fewer than 10^16 words. Only phrases found MIN_COUNT times are
candidates, and as a part is found at least as often as the whole, all other counts are left out once they are summed.

Edge cases: a null text is empty, a null language is ``und``. Words of any length and texts of any length are whole: a text
longer than CHUNK is scanned in stretches that overlap by a window. Rows count as often as they occur; repeated ids mean
nothing, as no id is read. Other columns are ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.session import materialize

LONGEST = 3
MIN_COUNT = 10
#: A phrase goes if a longer candidate around it has at least this share of its count, in percent.
SHARE = 50
LIMIT = 2000
SCALE = 1_000_000
#: Bytes of text whose windows are counted at once.
CHUNK = 1 << 24
#: Rows handed to Spark at once.
ROWS = 1 << 16
BLANK, END = 1, 2
CLASS = np.zeros(256, np.uint8)
CLASS[list(b" \t")] = BLANK
CLASS[list(b".,;:!?\n\x0b\x0c\r")] = END


def _stretches(text: bytes, longest: int) -> Iterator[tuple[bytes, int]]:
    """A text in stretches of about CHUNK bytes, each with the number of last words whose windows the next one counts."""
    start, size = 0, CHUNK
    while len(text) - start > size:
        kinds = CLASS[np.frombuffer(text, np.uint8, size, start)]
        inside = np.concatenate([[False], kinds == 0])
        starts = np.flatnonzero(inside[1:] & ~inside[:-1])
        if kinds[-1] == 0:  # the last word may go on
            starts = starts[:-1]
        if len(starts) <= longest:
            size *= 2
            continue
        # the words before the tail have their windows within the stretch, which ends behind its last whole word
        tail = starts[-longest:]
        end = size if kinds[-1] else size - int(np.argmax(kinds[::-1] != 0))
        yield text[start:start + end], longest
        start, size = start + int(tail[0]), CHUNK
    yield text[start:], 0


def _sums(table: pa.Table, keys: list[str], sizes: list[int]) -> pa.Table:
    """Distinct rows of ids below ``sizes``, in order, and how often each occurs."""
    bits = [int(n).bit_length() for n in sizes]
    if sum(bits) > 63:
        return table.group_by(keys, use_threads=False).aggregate([([], "count_all")]).sort_by([(k, "ascending") for k in keys])
    # rows that fit in one number are sorted as numbers
    packed = np.zeros(table.num_rows, np.int64)
    for key, width in zip(keys, bits):
        packed = packed << width | table[key].to_numpy()
    packed.sort()
    first = np.flatnonzero(np.append(True, packed[1:] != packed[:-1])) if len(packed) else np.zeros(0, np.int64)
    counts, packed, columns = np.diff(np.append(first, len(packed))), packed[first], {}
    for key, width in zip(reversed(keys), reversed(bits)):
        columns[key] = (packed & ((1 << width) - 1)).astype(np.int32)
        packed >>= width
    return pa.table({**{key: columns[key] for key in keys}, "count_all": counts})


def counted(langs: list[str], texts: list[bytes], uncounted: list[int], longest: int) -> pa.Table:
    """Columns head, last, n: the windows of stretches of text, sorted by their words.

    The head is the language, a line end, and the words but the last, which are joined by blanks; no word holds either.
    """
    return pa.Table.from_batches(_named(*_numbered(langs, texts, uncounted, longest)))


def _named(sums: pa.Table, languages: pa.Array, names: pa.Array) -> Iterator[pa.RecordBatch]:
    """The windows with their words, ROWS at a time, so that the strings of all of them never lie side by side."""
    words = [c for c in sums.column_names if c.startswith("w")]
    for part in (sums.slice(start, ROWS).combine_chunks() for start in range(0, max(sums.num_rows, 1), ROWS)):
        taken = {k: names.take(_whole(part[k])) for k in words}
        head = pc.binary_join_element_wise(*[taken[k] for k in words[:-1]], " ")
        head = pc.binary_join_element_wise(languages.take(_whole(part["lang"])), head, "\n")
        yield pa.RecordBatch.from_arrays([head, taken[words[-1]], _whole(part["count_all"])], names=["head", "last", "n"])


def _whole(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)


def _numbered(langs: list[str], texts: list[bytes], uncounted: list[int], longest: int) -> tuple[pa.Table, pa.Array, pa.Array]:
    """The distinct windows as numbers of languages and words, in order, how often each occurs, and the two lists of names."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    kinds = CLASS[data]
    inside = np.concatenate([[False], kinds == 0, [False]])
    starts = np.flatnonzero(inside[1:] & ~inside[:-1])
    lengths = np.flatnonzero(~inside[1:] & inside[:-1]) - starts
    piece = np.cumsum(kinds == END, dtype=np.int32)[starts]
    first = np.cumsum([0] + [len(t) + 1 for t in texts])
    text = np.searchsorted(first, starts, "right") - 1
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data[kinds == 0]))
    coded = words.dictionary_encode()
    ids, names = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32), coded.dictionary
    # ids in the order of the words, the pad first
    order = pc.sort_indices(names)
    place = np.empty(len(names), np.int32)
    place[order.to_numpy()] = np.arange(1, len(names) + 1, dtype=np.int32)
    names = pa.concat_arrays([pa.array([""], pa.string()), names.take(order)])
    ids = place[ids]
    languages = pa.array(langs, pa.string()).dictionary_encode()
    lang = languages.indices.to_numpy(zero_copy_only=False).astype(np.int32)[text] if len(text) else text.astype(np.int32)
    columns = {"lang": lang, "w1": ids}
    for k in range(1, longest):
        lead = np.zeros_like(ids)
        lead[:-k] = np.where(piece[k:] == piece[:-k], ids[k:], 0)
        columns[f"w{k + 1}"] = lead
    table = pa.table(columns)
    if any(uncounted):
        of_text = np.bincount(text, minlength=len(texts))
        from_end = np.cumsum(of_text)[text] - np.arange(len(text))
        table = table.filter(pa.array(from_end > np.array(uncounted)[text]))
    keys = list(columns)
    sums = _sums(table, keys, [max(len(languages.dictionary), 1), *[len(names)] * longest])
    return sums, languages.dictionary, names


def _windows(longest: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, texts, uncounted, held = [], [], [], 0
        for batch in batches:
            for lang, whole in zip(batch.column(0).to_pylist(), batch.column(1)):
                for text, left in _stretches(whole.as_buffer().to_pybytes().lower(), longest):
                    langs.append(lang)
                    texts.append(text)
                    uncounted.append(left)
                    held += len(text)
                    if held >= CHUNK:
                        yield from _named(*_numbered(langs, texts, uncounted, longest))
                        langs, texts, uncounted, held = [], [], [], 0
        if texts:
            yield from _named(*_numbered(langs, texts, uncounted, longest))

    return count


def phrase_counts(docs: DataFrame, lang: str = "lang", text: str = "text", longest: int = LONGEST,
                  min_count: int = MIN_COUNT) -> DataFrame:
    """Rows (lang, phrase, size, n): how often phrases of up to ``longest`` words occur, those found ``min_count`` times.

    Size 0 with an empty phrase gives all words of a language. ``longest`` is at least 2.
    """
    words = [f"w{i + 1}" for i in range(longest)]
    rows = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"),
                       F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    partial = rows.mapInArrow(_windows(longest), "head string, last string, n long")
    # windows that share all words but the last meet in one partition, where these are summed without another shuffle
    windows = partial.repartition("head").groupBy("head", "last").agg(F.sum("n").alias("n"))
    none = F.lit(None).cast("string").alias("last")
    prefix, window = F.struct(none, "n"), F.struct("last", "n")
    often = (F.col("last") != "") & (F.col("n") >= min_count)
    # each window adds to its prefix, still without another shuffle; whole windows stay if they are found often enough
    summed = windows.select("head", F.inline(F.when(often, F.array(prefix, window)).otherwise(F.array(prefix))))
    summed = summed.groupBy("head", "last").agg(F.sum("n").alias("n"))
    # so does each prefix to the one a word shorter, which is all that is left of a rare one
    dropped = F.length(F.substring_index("head", " " if longest > 2 else "\n", -1)) + (1 if longest > 2 else 0)
    itself = F.struct("head", "last", F.when(F.col("last").isNull(), longest - 1).otherwise(longest).alias("size"), "n")
    short = F.struct(F.left("head", F.length("head") - dropped).alias("head"), none, F.lit(longest - 2).alias("size"), "n")
    rows = F.when(F.col("last").isNotNull(), F.array(itself)).when(F.col("n") >= min_count, F.array(itself, short))
    kept = summed.select(F.inline(rows.otherwise(F.array(short)))).groupBy("head", "last", "size").agg(F.sum("n").alias("n"))
    kept = materialize(kept, "windows")
    parts = F.split(F.substring_index("head", "\n", -1), " ")
    language = F.substr("head", F.lit(1), F.length("head") - F.length(F.substring_index("head", "\n", -1)) - 1)
    kept = kept.select(language.alias("lang"), *[F.get(parts, F.lit(i)).alias(w) for i, w in enumerate(words[:-1])],
                       F.col("last").alias(words[-1]), "size", "n")
    windows, prefixes, shorter = (kept.filter(F.col("size") == longest - k).drop("size") for k in range(3))
    level = F.lit(longest - 2) - F.bit_count(F.grouping_id())
    shorter = shorter.rollup("lang", *words[:-2]).agg(F.sum("n").alias("n"), level.alias("size")).filter("size >= 0")

    def found(sums: DataFrame, size: Column, names: list[str]) -> DataFrame:
        rows = sums.select("lang", F.concat_ws(" ", *[F.col(w) for w in names]).alias("phrase"), size.alias("size"), "n",
                           *[F.col(w) for w in names])
        # a pad at the end of its words means a shorter phrase, which its own level has
        whole = F.forall(F.slice(F.array(*[F.col(w) for w in names] or [F.lit("")]), 1, F.col("size")), lambda w: w != "")
        return rows.filter(whole & ((F.col("size") == 0) | (F.col("n") >= min_count))).drop(*names)

    return (found(windows, F.lit(longest), words).unionByName(found(prefixes, F.lit(longest - 1), words[:-1]))
            .unionByName(found(shorter, F.col("size").cast("int"), words[:-2])))


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", longest: int = LONGEST,
                 min_count: int = MIN_COUNT, share: int = SHARE, limit: int = LIMIT) -> DataFrame:
    """Rows (lang, rank, phrase, a, l, r, n, score): the best-scored phrases of 2 to ``longest`` words of each language."""
    counts = materialize(phrase_counts(docs, lang, text, longest, min_count), "phrase-counts")
    words = F.split("phrase", " ")
    candidates = counts.filter("size >= 2").select("lang", "phrase", "size", F.col("n").alias("a"))

    def part(first: Column, size: Column) -> Column:
        return F.array_join(F.slice(words, first, size), " ")

    cuts = candidates.select("lang", "phrase", "size", "a", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"),
                       part(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(counts.select("lang", F.col("phrase").alias(side), F.col("n").alias(name)), ["lang", side])
    exact = [F.col(c).cast("decimal(16,0)") for c in ("a", "l", "r")]
    cuts = cuts.withColumns({"top": exact[0] * exact[0] * F.lit(SCALE), "bottom": exact[1] * exact[2]})
    scored = cuts.withColumn("score", F.expr("top div bottom")).groupBy("lang", "phrase", "a").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda s: F.transform(
        F.sequence(F.lit(1), F.col("size") - s + 1), lambda at: part(at, s))))
    around = candidates.filter("size > 2").select("lang", F.col("a").alias("longer"), F.explode(inner).alias("phrase"))
    around = around.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = scored.join(around, ["lang", "phrase"], "left").filter(
        F.coalesce(100 * F.col("longer") < share * F.col("a"), F.lit(True)))
    kept = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    best = kept.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= limit)
    totals = counts.filter("size = 0").select("lang", F.col("n"))
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = rf"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
numbered AS (SELECT lang, row_number() OVER () AS id, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
words AS (SELECT lang, id, unnest(w) AS w1, generate_subscripts(w, 1) AS pos FROM numbered),
windows AS (SELECT lang, w1, lead(w1) OVER in_piece AS w2, lead(w1, 2) OVER in_piece AS w3 FROM words
  WINDOW in_piece AS (PARTITION BY id ORDER BY pos)),
phrases AS (
  SELECT lang, 1 AS size, w1 AS phrase FROM windows
  UNION ALL SELECT lang, 2, w1 || ' ' || w2 FROM windows WHERE w2 IS NOT NULL
  UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3 FROM windows WHERE w3 IS NOT NULL),
counts AS (SELECT lang, size, phrase, CAST(count(*) AS HUGEINT) AS f FROM phrases GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counts WHERE size = 1 GROUP BY lang),
candidates AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts
  WHERE size >= 2 AND f >= {MIN_COUNT}),
cuts AS (SELECT lang, phrase, a, w, unnest(range(1, size)) AS k FROM candidates),
parts AS (SELECT lang, phrase, a, k, array_to_string(w[:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail FROM cuts),
known AS (SELECT lang || ' ' || phrase AS id, f FROM counts WHERE f >= {MIN_COUNT}),
headed AS MATERIALIZED (SELECT p.*, f AS l FROM parts p JOIN known ON id = p.lang || ' ' || head),
scored AS (SELECT p.*, f AS r, {SCALE} * a * a // (l * f) AS score FROM headed p JOIN known ON id = p.lang || ' ' || tail),
worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_phrases AS (SELECT lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase FROM candidates WHERE size = 3),
around AS (SELECT lang, phrase, max(a) AS longer FROM inner_phrases GROUP BY lang, phrase),
kept AS (SELECT w.*, row_number() OVER (PARTITION BY w.lang ORDER BY score DESC, w.a DESC, encode(w.phrase)) AS rank
  FROM worst w LEFT JOIN around o ON o.lang = w.lang AND o.phrase = w.phrase
  WHERE o.longer IS NULL OR 100 * o.longer < {SHARE} * w.a)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n,
  CAST(score AS BIGINT) AS score FROM kept JOIN totals USING (lang) WHERE rank <= {LIMIT}
"""
