"""Porter2 ("English") stemming, for words in a column and for the words inside a text.

The algorithm is the published one (M. F. Porter, "The English (Porter2) stemming algorithm"). Column expressions serve a
table of distinct words; ``stemmed_words`` stems the words of whole texts in place, each once per worker while it is cached.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from parley.functions.arrays import pinned

# Fixed values of the published algorithm: whole-word exceptions.
EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie",
    "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias",
    "andes": "andes",
}
# Words left alone after step 1a.
KEPT_AFTER_1A = ["inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"]
# Suffix replacements of steps 2 and 3, applied in region R1.
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize",
    "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al",
    "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble",
    "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP_3 = {
    "tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "",
    "ness": "", "ative": "",
}
# Suffixes deleted in region R2 by step 4.
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous",
          "ive", "ize", "ion"]
VOWEL, OTHER = "[aeiouy]", "[^aeiouy]"
SHORT_SYLLABLE = f"({OTHER}{VOWEL}[^aeiouywxY]|^{VOWEL}{OTHER})$"


def _suffix(word: Column, suffixes) -> Column:
    """The longest of the suffixes that ends the word, or an empty string."""
    return F.regexp_extract(word, f"({'|'.join(suffixes)})$", 1)


def _cut(word: Column, suffix: Column, replacement: Column | str = "") -> Column:
    stem = F.left(word, F.length(word) - F.length(suffix))
    return F.concat(stem, F.lit(replacement) if isinstance(replacement, str) else replacement)


def _table(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def add_stems(words: DataFrame, column: str = "word", target: str = "stem") -> DataFrame:
    """Add the stem of each word."""
    w, s = F.col("_w"), F.col("_s")
    in_r1 = F.length(w) - F.length(s) >= F.col("_r1")
    in_r2 = F.length(w) - F.length(s) >= F.col("_r2")

    # a y that acts as a consonant is written Y
    df = words.withColumn("_w", F.regexp_replace(F.regexp_replace(column, "^y", "Y"), f"({VOWEL})y", "$1Y"))
    # R1 starts after the first non-vowel that follows a vowel; R2 is the same inside R1
    head = F.regexp_extract(w, f"^(gener|commun|arsen|.*?{VOWEL}{OTHER})", 1)
    df = df.withColumn("_r1", F.when(head == "", F.length(w)).otherwise(F.length(head)))
    tail = F.substr(w, F.col("_r1") + 1)
    second = F.regexp_extract(tail, f"^(.*?{VOWEL}{OTHER})", 1)
    df = df.withColumn(
        "_r2", F.when(second == "", F.length(w)).otherwise(F.col("_r1") + F.length(second))
    )

    # step 1a
    df = df.withColumn("_s", _suffix(w, ["sses", "ied", "ies", "us", "ss", "s"])).withColumn(
        "_w",
        F.when(s == "sses", _cut(w, s, "ss"))
        .when(s.isin("ied", "ies"), _cut(w, s, F.when(F.length(w) > 4, "i").otherwise("ie")))
        .when((s == "s") & F.rlike(w, F.lit(f"{VOWEL}.+s$")), _cut(w, s))
        .otherwise(w),
    )
    df = df.withColumn("_kept", w.isin(KEPT_AFTER_1A))

    # step 1b
    bare = _cut(w, s)
    df = df.withColumn("_s", _suffix(w, ["eedly", "eed", "ingly", "edly", "ing", "ed"])).withColumn(
        "_cut", s.isin("ingly", "edly", "ing", "ed") & F.rlike(bare, F.lit(VOWEL))
    )
    df = df.withColumn(
        "_w", F.when(F.col("_cut"), bare).when(s.isin("eed", "eedly") & in_r1, _cut(w, s, "ee")).otherwise(w)
    )
    short = F.rlike(w, F.lit(SHORT_SYLLABLE)) & (F.col("_r1") >= F.length(w))
    df = df.withColumn(
        "_w",
        F.when(~F.col("_cut"), w)
        .when(F.rlike(w, F.lit("(at|bl|iz)$")), F.concat(w, F.lit("e")))
        .when(F.rlike(w, F.lit("(bb|dd|ff|gg|mm|nn|pp|rr|tt)$")), F.left(w, F.length(w) - 1))
        .when(short, F.concat(w, F.lit("e")))
        .otherwise(w),
    )

    # step 1c
    df = df.withColumn("_w", F.regexp_replace(w, f"(.{OTHER})[yY]$", "$1i"))

    # step 2
    allowed = (
        F.when(s == "ogi", F.rlike(w, F.lit("logi$"))).when(s == "li", F.rlike(w, F.lit("[cdeghkmnrt]li$"))).otherwise(True)
    )
    df = df.withColumn("_s", _suffix(w, STEP_2)).withColumn(
        "_w", F.when((s != "") & in_r1 & allowed, _cut(w, s, F.try_element_at(_table(STEP_2), s))).otherwise(w)
    )

    # step 3
    allowed = F.when(s == "ative", in_r2).otherwise(True)
    df = df.withColumn("_s", _suffix(w, STEP_3)).withColumn(
        "_w", F.when((s != "") & in_r1 & allowed, _cut(w, s, F.try_element_at(_table(STEP_3), s))).otherwise(w)
    )

    # step 4
    allowed = F.when(s == "ion", F.rlike(w, F.lit("[st]ion$"))).otherwise(True)
    df = df.withColumn("_s", _suffix(w, STEP_4)).withColumn(
        "_w", F.when((s != "") & in_r2 & allowed, _cut(w, s)).otherwise(w)
    )

    # step 5
    before = F.left(w, F.length(w) - 1)
    drop_e = (s == "e") & (in_r2 | (in_r1 & ~F.rlike(before, F.lit(SHORT_SYLLABLE))))
    drop_l = (s == "l") & in_r2 & F.rlike(w, F.lit("ll$"))
    df = df.withColumn("_s", F.regexp_extract(w, "[el]$", 0)).withColumn(
        "_w", F.when(drop_e | drop_l, before).otherwise(w)
    )

    raw = F.col(column)
    stem = (
        F.when(F.length(raw) <= 2, raw)
        .when(raw.isin(list(EXCEPTIONS)), F.try_element_at(_table(EXCEPTIONS), raw))
        .when(F.col("_kept"), F.regexp_replace(raw, "s$", ""))
        .otherwise(F.regexp_replace(w, "Y", "y"))
    )
    return pinned(df, words.columns, **{target: stem})


# ---- words inside a text -----------------------------------------------------------------------------------------

#: Stems that a worker remembers.
CACHED_STEMS = 1 << 16
#: Texts that are Python strings at once.
SLICE = 256


def _region(word: str, start: int, special: str = "") -> int:
    """Where the region after the first non-vowel that follows a vowel starts, at or after a position."""
    found = re.match(f"{special}.*?{VOWEL}{OTHER}", word[start:])
    return start + found.end() if found else len(word)


def _ending(word: str, suffixes) -> str:
    """The longest of the suffixes that ends the word, or an empty string."""
    return max((x for x in suffixes if word.endswith(x)), key=len, default="")


def _short(word: str, r1: int) -> bool:
    return r1 >= len(word) and re.search(SHORT_SYLLABLE, word) is not None


def _step_1(w: str, r1: int) -> tuple[str, bool]:
    """Plurals and participles; also whether the word is one that is left alone after step 1a."""
    s = _ending(w, ["sses", "ied", "ies", "us", "ss", "s"])
    if s == "sses":
        w = w[:-2]
    elif s in ("ied", "ies"):
        w = w[:-3] + ("i" if len(w) > 4 else "ie")
    elif s == "s" and re.search(f"{VOWEL}.+s$", w):
        w = w[:-1]
    if w in KEPT_AFTER_1A:
        return w, True
    s = _ending(w, ["eedly", "eed", "ingly", "edly", "ing", "ed"])
    bare = w[:len(w) - len(s)]
    if s in ("eed", "eedly"):
        w = bare + "ee" if len(bare) >= r1 else w
    elif s and re.search(VOWEL, bare):
        w = bare
        if re.search("(at|bl|iz)$", w):
            w += "e"
        elif re.search("(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", w):
            w = w[:-1]
        elif _short(w, r1):
            w += "e"
    return re.sub(f"(.{OTHER})[yY]$", r"\1i", w), False


@functools.lru_cache(CACHED_STEMS)
def stem_word(word: str) -> str:
    """Stem of one lower-cased word."""
    if len(word) <= 2:
        return word
    if word in EXCEPTIONS:
        return EXCEPTIONS[word]
    w = re.sub(f"({VOWEL})y", r"\1Y", re.sub("^y", "Y", word))
    special = re.match("gener|commun|arsen", w)
    r1 = special.end() if special else _region(w, 0)
    r2 = _region(w, r1)
    w, kept = _step_1(w, r1)
    if kept:
        return re.sub("s$", "", word)
    s = _ending(w, STEP_2)
    allowed = {"ogi": "logi$", "li": "[cdeghkmnrt]li$"}.get(s, "")
    if s and len(w) - len(s) >= r1 and re.search(allowed, w):
        w = w[:len(w) - len(s)] + STEP_2[s]
    s = _ending(w, STEP_3)
    if s and len(w) - len(s) >= (r2 if s == "ative" else r1):
        w = w[:len(w) - len(s)] + STEP_3[s]
    s = _ending(w, STEP_4)
    if s and len(w) - len(s) >= r2 and (s != "ion" or re.search("[st]ion$", w)):
        w = w[:len(w) - len(s)]
    if w.endswith("e"):
        at = len(w) - 1
        if at >= r2 or at >= r1 and not re.search(SHORT_SYLLABLE, w[:-1]):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def _stemmed(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else " ".join(map(stem_word, t.split(" "))) for t in texts.to_pylist()], pa.string())


@F.arrow_udf(StringType())
def stemmed_words(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The words of a text, separated by blanks, stemmed in place."""
    for texts in batches:
        yield pa.concat_arrays([_stemmed(texts.slice(s, SLICE)) for s in range(0, max(len(texts), 1), SLICE)])
