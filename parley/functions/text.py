"""Scalar text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The public Spark ML English stop word list.
STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it
its itself they them their theirs themselves what which who whom this that these those am is are was were be been
being have has had having do does did doing a an the and but if or because as until while of at by for with about
against between into through during before after above below to from up down in out on off over under again further
then once here there when where why how all any both each few more most other some such no nor not only own same so
than too very s t can will just don should now i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd they'd
i'm you're he's she's it's we're they're i've we've you've they've isn't aren't wasn't weren't haven't hasn't hadn't
don't doesn't didn't won't wouldn't shan't shouldn't mustn't can't couldn't cannot could here's how's let's ought
that's there's what's when's where's who's why's would
""".split()

# Frequent words that say little about a prompt, left out of corpus counts.
CORPUS_EXCLUDED = ["write", "answer", "say", "make", "want", "don", "like", "good", "com", "words", "tell", "hello",
                   "create", "explain"]
# The longer list used for counts per cluster.
CLUSTER_EXCLUDED = CORPUS_EXCLUDED + ["use", "using", "used", "uses", "does", "did", "know"]
# The list of the analysis with seven clusters.
TOPIC_EXCLUDED = ["make", "want", "don", "like", "good", "com"]
# The list used for counts per pair of predicted labels.
PAIR_EXCLUDED = ["don", "hello"]
# Fixed value: words with this prefix stand for masked names.
MASKED_NAME_PREFIX = "name_"

# The hypothesis templates and the marks around a premise.
PROMPT_TEMPLATE = "This example is a {} prompt."
PLAIN_TEMPLATE = "This example is {}."
PROMPT_MARKS = ("<prompt>", "</prompt>")
SEQUENCE_MARKS = ("<s>", "</s>")
# Role marks in front of rendered messages.
USER_MARK = "😎"
ASSISTANT_MARK = "🤖"

#: A word is a run of two or more letters, digits or underscores.
WORD_PATTERN = r"[\p{L}\p{N}_]{2,}"


def strip(c: Column) -> Column:
    """Remove whitespace of any kind at both ends."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def stripped_or_null(c: Column) -> Column:
    """Stripped text; an empty result counts as absent."""
    return F.nullif(strip(c), F.lit(""))


def words(c: Column) -> Column:
    """Lowercased words of a text, in order."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORD_PATTERN), F.lit(0))


def char_trigrams(c: Column) -> Column:
    """Every run of three characters, in order, in one pass over the text."""
    return F.regexp_extract_all(c, F.lit("(?s)(?=(...))"), F.lit(1))


def clean(c: Column) -> Column:
    """Non-word runs to one space, digits removed, lowercased."""
    spaced = F.regexp_replace(c, r"[^\p{L}\p{N}_]+", " ")
    return F.lower(F.regexp_replace(spaced, r"\p{Nd}+", ""))


def drop_words(c: Column, excluded: list[str]) -> Column:
    """Split on whitespace, drop the excluded words, join with one space."""
    kept = F.filter(F.split(c, r"\s+"), lambda w: (w != "") & ~w.isin(excluded))
    return F.array_join(kept, " ")


def hypothesis(template: str, label: Column) -> Column:
    """The template with its ``{}`` replaced; the label is taken literally."""
    return F.replace(F.lit(template), F.lit("{}"), label)


def marked(text: Column, marks: tuple[str, str], tail: Column) -> Column:
    """Text between its marks, a space, and the hypothesis."""
    return F.concat(F.lit(marks[0]), text, F.lit(marks[1] + " "), tail)


def chat_text(prompt: Column, response: Column) -> Column:
    """Prompt and response as one text with role marks."""
    return F.concat(F.lit(USER_MARK + " "), prompt, F.lit(" \n" + ASSISTANT_MARK + " "), response)


def zero_padded(n: Column, width: int = 3) -> Column:
    """Number padded with zeros to a least width; longer numbers stay whole."""
    digits = n.cast("string")
    return F.when(F.length(digits) >= width, digits).otherwise(F.lpad(digits, width, "0"))


def class_index(c: Column) -> Column:
    """The number after the last underscore of a class name such as LABEL_1."""
    return F.element_at(F.split(c, "_"), -1).cast("int")


def capitalize(c: Column) -> Column:
    """First character upper, all others lower."""
    return F.concat(F.upper(F.left(c, F.lit(1))), F.lower(F.substring(c, 2, 2**31 - 1)))


def mask_secret(c: Column, shown: int = 4, reveal_short: bool = False) -> Column:
    """Keep ``shown`` characters at each end and star the rest.

    A value not longer than both ends together is starred whole unless ``reveal_short``.
    """
    stars = F.repeat(F.lit("*"), F.greatest(F.length(c) - 2 * shown, F.lit(0)))
    masked = F.concat(F.left(c, F.lit(shown)), stars, F.right(c, F.lit(shown)))
    if reveal_short:
        return masked
    return F.when(F.length(c) <= 2 * shown, F.repeat(F.lit("*"), F.length(c))).otherwise(masked)


def first_words(c: Column, n: int) -> Column:
    """The first ``n`` whitespace tokens, as a model with an ``n`` token window would see them."""
    return F.array_join(F.slice(F.split(strip(c), r"(?U)\s+"), 1, n), " ")


def word_ids(c: Column, vocab_size: int) -> Column:
    """Hashed word ids in 1..vocab_size-1; 0 is left for padding."""
    def bucket(w: Column) -> Column:
        return F.conv(F.left(F.md5(w), F.lit(8)), 16, 10).cast("bigint") % (vocab_size - 1) + 1

    return F.transform(c, lambda w: bucket(w).cast("int"))
