"""Operator 10, quality rules: lines are judged first, then the document by what is left of it.

Punctuation, navigation and boilerplate rules run on each line, failing lines are removed, and a document that loses too
much of its text is rejected, as is one that fails the base rules on length and repetition. Everything is an expression
of the row: no shuffle, no Python.

Edge cases: a null text counts as an empty one (no words, rejected by length; its cleaned text is empty). Repeated rows
are judged one by one. Other columns pass through ``judged``; one that is named like a result is replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.exprs import BLANKS, columns_but, let, words_of

#: Base rules of the contract.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = r"[#*$%&|<>]"

#: Line rules. A line fails if more than this share of its characters are symbols.
MAX_SYMBOL_PERCENT = 10
#: A line fails if it has at least one doubled exclamation or question mark for so many words.
WORDS_PER_SHOUT = 3
SHOUTS = r"[!?]{2}"
#: A line fails if it has at least two separators of navigation bars and one for so many words.
WORDS_PER_SEPARATOR = 4
SEPARATORS = r"[ \t][|»›·•][ \t]"
#: Phrases of lines that belong to the site and not to the text.
BOILERPLATE = (
    r"(?i)(licensed under the|all rights reserved|copyright (\(c\)|©|[0-9]{4})|terms of (use|service)|privacy policy"
    r"|accept (all )?cookies|enable javascript|skip to (main )?content)"
)
#: A document is rejected if less than this share of its word characters is in lines that stay.
MIN_KEPT_PERCENT = 60


def repeated_words(words: Column) -> Column:
    """Number of words that lie in a three-word window found twice or more.

    Windows are compared by hash first: hash and position share one long, so that a sort of plain longs brings equal
    hashes together. Only windows whose hash repeats are compared as text, so the count is exact.
    """

    def covered(starts: Column) -> Column:
        steps = F.transform(starts, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(starts, j + 1) - p, F.lit(3))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda total, x: total + x)

    def confirmed(starts: Column) -> Column:
        grams = F.sort_array(F.transform(starts, lambda p: F.struct(
            F.concat_ws(" ", F.get(words, p.cast("int")), F.get(words, p.cast("int") + 1),
                        F.get(words, p.cast("int") + 2)).alias("gram"), p.alias("start"))))

        def repeated(sorted_grams: Column) -> Column:
            def twin(x: Column, j: Column) -> Column:
                before, after = F.get(sorted_grams, j - 1)["gram"], F.get(sorted_grams, j + 1)["gram"]
                return F.coalesce(before == x["gram"], F.lit(False)) | F.coalesce(after == x["gram"], F.lit(False))

            return F.sort_array(F.transform(F.filter(sorted_grams, twin), lambda x: x["start"]))

        return let(let(grams, repeated), covered)

    def by_hash(bits: Column) -> Column:
        def key(i: Column) -> Column:
            hashed = F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
            return F.call_function("shiftleft", hashed, bits).bitwiseOR(i.cast("long"))

        keys = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(words) - 3), key))

        def twins(sorted_keys: Column) -> Column:
            def same(x: Column, other: Column) -> Column:
                shifted = F.call_function("shiftright", other, bits)
                return F.coalesce(F.call_function("shiftright", x, bits) == shifted, F.lit(False))

            mask = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
            found = F.filter(sorted_keys, lambda x, j: same(x, F.get(sorted_keys, j - 1))
                             | same(x, F.get(sorted_keys, j + 1)))
            return F.transform(found, lambda x: x.bitwiseAND(mask))

        return let(let(keys, twins),
                   lambda starts: F.when(F.size(starts) == 0, F.lit(0).cast("long")).otherwise(confirmed(starts)))

    bits = F.coalesce(F.ceil(F.log2(F.size(words) + 1)).cast("int"), F.lit(1))
    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(let(bits, by_hash))


def chars_of(words: Column) -> Column:
    return F.aggregate(words, F.lit(0).cast("long"), lambda total, w: total + F.length(w))


def line_stays(line: Column) -> Column:
    """Whether a line has words and passes the punctuation, navigation and boilerplate rules."""

    def judged(n_words: Column) -> Column:
        symbols = F.regexp_count(line, F.lit(SYMBOLS)) * 100 > F.length(line) * MAX_SYMBOL_PERCENT
        shouting = F.regexp_count(line, F.lit(SHOUTS)) * WORDS_PER_SHOUT >= n_words
        separators = F.regexp_count(line, F.lit(SEPARATORS))
        navigation = (separators >= 2) & (separators * WORDS_PER_SEPARATOR >= n_words)
        return (n_words > 0) & ~symbols & ~shouting & ~navigation & ~line.rlike(BOILERPLATE)

    return let(F.size(words_of(line)), judged)


def cleaned(text: Column) -> Column:
    """The text without failing lines, lines without words and lines equal to an earlier one."""
    lines = F.array_distinct(F.split(F.coalesce(text, F.lit("")), "\n"))
    return F.array_join(F.filter(lines, line_stays), "\n")


def measured(text: Column) -> Column:
    """Struct of counts and the cleaned text of one document."""

    def of_words(words: Column) -> Column:
        lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{BLANKS}]"))
        clean = cleaned(text)
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            chars_of(words).alias("word_chars"),
            F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
            repeated_words(words).alias("n_repeat_words"),
            clean.alias("clean_text"),
        )

    return let(words_of(text), of_words)


def judged(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, kept_chars, base_failed, kept and clean_text."""
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "kept_chars", "base_failed", "kept",
             "clean_text"]
    found = let(let(F.coalesce(F.col(text), F.lit("")), measured), lambda m: F.struct(
        *[m[c].alias(c) for c in added[:5]], chars_of(words_of(m["clean_text"])).alias("kept_chars"),
        ((m["n_words"] < MIN_WORDS) | (m["n_repeat_words"] * 100 > m["n_words"] * MAX_REPEAT_PERCENT))
        .alias("base_failed"), m["clean_text"].alias("clean_text")))
    # inline evaluates the struct once; reading fields of a plain struct column would repeat it per field
    rows = docs.select(*columns_but(docs, added), F.inline(F.array(found)))
    enough = F.col("kept_chars") * 100 >= F.col("word_chars") * MIN_KEPT_PERCENT
    return rows.withColumn("kept", ~F.col("base_failed") & enough)


def cleaned_documents(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their cleaned text; same columns as before, n_chars counted anew."""
    source = docs.toDF(*[f"in_{c}" for c in docs.columns])
    passed = judged(source, "in_text").filter("kept")
    columns = {c: F.col(f"`in_{c}`") for c in docs.columns}
    columns["text"] = F.col("clean_text")
    if "n_chars" in columns:
        columns["n_chars"] = F.length("clean_text").cast(docs.schema["n_chars"].dataType)
    return passed.select(*[c.alias(name) for name, c in columns.items()])


WORDS_SQL = r"list_filter(regexp_split_to_array({0}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"
CHARS_SQL = r"length(regexp_replace({0}, '[\x20\x09-\x0D]+', '', 'g'))"

ORACLE = rf"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, unnest({WORDS_SQL.format('text')}) AS word,
             generate_subscripts({WORDS_SQL.format('text')}, 1) AS pos FROM t),
g AS (SELECT rid, pos, word || ' ' || lead(word) OVER o || ' ' || lead(word, 2) OVER o AS gram FROM w
      WINDOW o AS (PARTITION BY rid ORDER BY pos)),
again AS (SELECT rid, pos FROM (SELECT *, count(*) OVER (PARTITION BY rid, gram) AS n FROM g WHERE gram IS NOT NULL)
          WHERE n > 1),
covered AS (SELECT rid, count(DISTINCT pos + d) AS n FROM again, (SELECT unnest([0, 1, 2]) AS d) GROUP BY rid),
l AS (SELECT rid, line, count(*) AS n, len({WORDS_SQL.format('line')}) AS line_words,
             len(regexp_extract_all(line, '[#*$%&|<>]')) AS symbols,
             len(regexp_extract_all(line, '[!?]{{2}}')) AS shouts,
             len(regexp_extract_all(line, '[ \t][|»›·•][ \t]')) AS seps
      FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM t) GROUP BY rid, line),
lines AS (SELECT rid, coalesce(sum(n - 1) FILTER (line_words > 0), 0) AS dups,
       coalesce(sum({CHARS_SQL.format('line')}) FILTER (line_words > 0 AND symbols * 100 <= length(line) * {MAX_SYMBOL_PERCENT}
           AND shouts * {WORDS_PER_SHOUT} < line_words
           AND NOT (seps >= 2 AND seps * {WORDS_PER_SEPARATOR} >= line_words)
           AND NOT regexp_matches(line, '{BOILERPLATE}')), 0) AS kept_chars
       FROM l GROUP BY rid),
m AS (SELECT t.rid, doc_id, len({WORDS_SQL.format('text')}) AS n_words, {CHARS_SQL.format('text')} AS word_chars,
             len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, dups AS n_dup_lines,
             coalesce(c.n, 0) AS n_repeat_words, kept_chars
      FROM t JOIN lines USING (rid) LEFT JOIN covered c ON c.rid = t.rid),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, n_repeat_words,
       CAST(kept_chars AS BIGINT) AS kept_chars, base_failed,
       NOT base_failed AND 100 * kept_chars >= {MIN_KEPT_PERCENT} * word_chars AS kept
FROM f
"""
