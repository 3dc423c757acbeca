"""Curation of labelled tables, NLI rows and labelling."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.functions import text as T
from parley.operators import conversations as C
from parley.operators import curation as Q
from parley.operators import labeling as L
from parley.operators import nli as N
from parley.operators.ordering import number_rows
from parley.operators.scoring import HypothesisOverlapScorer
from parley.plans import fixtures as X
from parley.plans import oracle_parts as P
from parley.plans.registry import query
from parley.schemas import NLI as NLI_SCHEMA
from parley.sources.tables import literal_rows


# ---- filters -----------------------------------------------------------------------------------------------------

@query("documents_in_languages", "SELECT doc_id, lang FROM documents WHERE lang IN ('fr', 'de')")
def documents_in_languages(spark, sf):
    return C.in_languages(X.table(spark, sf, "documents"), ["fr", "de"], "lang").select("doc_id", "lang")


@query("texts_by_length", "SELECT doc_id, text FROM documents WHERE length(text) BETWEEN 50 AND 600")
def texts_by_length(spark, sf):
    return X.table(spark, sf, "documents").where(C.length_between(F.col("text"), 50, 600)).select("doc_id", "text")


@query("entailments", f"WITH {X.NLI} SELECT seq, category, split FROM nli WHERE label = 2")
def entailments(spark, sf):
    return Q.entailments(X.nli(spark, sf, False)).select("seq", "category", "split")


@query(
    "untagged_rows",
    f"WITH {X.TAGGED} SELECT doc_id, conversation_tag, detected_language FROM tagged "
    "WHERE conversation_tag IS NULL OR conversation_tag NOT IN ('delete', 'private')",
)
def untagged_rows(spark, sf):
    return Q.without_tags(X.tagged(spark, sf), ["delete", "private"]).drop("prompt")


@query(
    "rows_matching_pattern",
    f"WITH {X.NLI} SELECT seq, category FROM nli WHERE regexp_matches(text, 'the [a-z]+ing') AND category = 'ai' AND label = 2",
)
def rows_matching_pattern(spark, sf):
    hit = Q.matches(F.col("text"), "the [a-z]+ing", regex=True)
    return X.nli(spark, sf, False).where(hit & (F.col("category") == "ai") & (F.col("label") == 2)).select("seq", "category")


@query("rows_containing", "SELECT doc_id FROM documents WHERE contains(text, 'of the')")
def rows_containing(spark, sf):
    return X.table(spark, sf, "documents").where(Q.matches(F.col("text"), "of the")).select("doc_id")


RULES = [Q.Rule("and the"), Q.Rule("que la", "writing"), Q.Rule("los", "language"), Q.Rule("und der"),
         Q.Rule("que le", "ai", label=0)]


@query(
    "rules_applied",
    f"""WITH {X.NLI} SELECT seq, label,
  CASE WHEN contains(text, 'que le') AND label = 0 THEN 'ai'
       WHEN contains(text, 'los') AND label = 2 THEN 'language'
       WHEN contains(text, 'que la') AND label = 2 THEN 'writing' ELSE category END AS category
FROM nli WHERE NOT (label = 2 AND (contains(text, 'and the') OR contains(text, 'und der')))""",
)
def rules_applied(spark, sf):
    return Q.apply_rules(X.nli(spark, sf, False), RULES).select("seq", "label", "category")


@query(
    "conditional_delete",
    f"WITH {X.NLI} SELECT seq, category, label FROM nli WHERE NOT (contains(text, 'of the') AND label = 2)",
)
def conditional_delete(spark, sf):
    return Q.apply_rules(X.nli(spark, sf, False), [Q.Rule("of the")]).select("seq", "category", "label")


@query(
    "conditional_update",
    f"WITH {X.NLI} SELECT seq, label, CASE WHEN contains(text, 'of the') AND label = 2 THEN 'writing' ELSE category END "
    "AS category FROM nli",
)
def conditional_update(spark, sf):
    return Q.apply_rules(X.nli(spark, sf, False), [Q.Rule("of the", "writing")]).select("seq", "label", "category")


# ---- column edits ------------------------------------------------------------------------------------------------

@query("lowercased", "SELECT doc_id, lower(source) AS source, lower(text) AS text FROM documents")
def lowercased(spark, sf):
    docs = X.table(spark, sf, "documents").select("doc_id", "source", "text")
    return Q.lowercase(Q.lowercase(docs, "text"), "source")


@query(
    "category_swapped",
    f"WITH {X.NLI} SELECT seq, CASE WHEN category = 'coding' THEN 'code' ELSE category END AS category FROM nli",
)
def category_swapped(spark, sf):
    return Q.swap_value(X.nli(spark, sf, False), "category", "coding", "code").select("seq", "category")


GROUPED = P.category_groups()


@query("category_groups", f"WITH {X.NLI} SELECT seq, {GROUPED} AS category FROM nli")
def category_groups(spark, sf):
    return Q.group_categories(X.nli(spark, sf, False)).select("seq", "category")


@query("columns_renamed", "SELECT doc_id AS id, text AS prompt, lang AS language FROM documents")
def columns_renamed(spark, sf):
    renamed = X.table(spark, sf, "documents").withColumnsRenamed({"doc_id": "id", "text": "prompt", "lang": "language"})
    return renamed.select("id", "prompt", "language")


@query("accepted_columns", "SELECT doc_id, text FROM documents")
def accepted_columns(spark, sf):
    kept, _ = Q.select_accepted(X.table(spark, sf, "documents"), ["doc_id", "text", "input_ids"])
    return kept


@query("helper_columns_dropped", "SELECT doc_id, lang, source, n_chars FROM documents")
def helper_columns_dropped(spark, sf):
    return X.table(spark, sf, "documents").drop("text")


@query("class_names", f"SELECT vec_id, {X.sql_list(X.TOPICS)}[label % 4 + 1] AS class FROM embeddings")
def class_names(spark, sf):
    topics = X.table(spark, sf, "embeddings").select("vec_id", (F.col("label") % 4).alias("label"))
    return Q.decode_class(topics, X.TOPICS)


@query(
    "labels_cast",
    f"WITH {X.NLI} SELECT seq, label, ['contradiction', 'neutral', 'entailment'][label + 1] AS label_name FROM nli",
)
def labels_cast(spark, sf):
    return Q.cast_label(X.nli(spark, sf, False)).select("seq", "label", "label_name")


@query("label_convention", f"WITH {X.NLI} SELECT seq, label, CAST(2 - label AS INT) AS pair_label FROM nli")
def label_convention(spark, sf):
    return X.nli(spark, sf, False).select("seq", "label", Q.flip_label_convention(F.col("label")).alias("pair_label"))


@query(
    "premise_hypothesis_pairs",
    f"""WITH {X.NLI} SELECT text AS premise, 'This example is a ' || category || ' prompt.' AS hypothesis,
       CAST(2 - label AS INT) AS label, split AS genre FROM nli""",
)
def premise_hypothesis_pairs(spark, sf):
    return X.nli(spark, sf, False).select(
        F.col("text").alias("premise"),
        T.hypothesis(T.PROMPT_TEMPLATE, F.col("category")).alias("hypothesis"),
        Q.flip_label_convention(F.col("label")).alias("label"),
        F.col("split").alias("genre"),
    )


@query(
    "secrets_masked",
    """SELECT doc_id, CASE WHEN length(source) <= 4 THEN repeat('*', length(source)) ELSE
       left(source, 2) || repeat('*', length(source) - 4) || right(source, 2) END AS source,
  left(text, 4) || repeat('*', greatest(length(text) - 8, 0)) || right(text, 4) AS text FROM documents""",
)
def secrets_masked(spark, sf):
    return X.table(spark, sf, "documents").select(
        "doc_id", T.mask_secret(F.col("source"), 2).alias("source"),
        T.mask_secret(F.col("text"), reveal_short=True).alias("text"),
    )


@query(
    "stripped_texts",
    r"""SELECT doc_id, regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '') AS text,
  upper(left(lang, 1)) || lower(substr(lang, 2)) AS language FROM documents""",
)
def stripped_texts(spark, sf):
    return X.table(spark, sf, "documents").select(
        "doc_id", T.strip(F.col("text")).alias("text"), T.capitalize(F.col("lang")).alias("language")
    )


@query(
    "first_words_of_texts",
    r"""SELECT doc_id, array_to_string(list_slice(regexp_split_to_array(
  regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', ''), '\s+'), 1, 16), ' ') AS trimmed FROM documents""",
)
def first_words_of_texts(spark, sf):
    return X.documents(spark, sf).select("doc_id", T.first_words(F.col("text"), 16).alias("trimmed"))


@query(
    "class_indexes",
    "SELECT doc_id, CAST(string_split('LABEL_' || toxic, '_')[-1] AS INT) AS idx FROM labels",
)
def class_indexes(spark, sf):
    name = F.concat(F.lit("LABEL_"), F.col("toxic").cast("string"))
    return X.table(spark, sf, "labels").select("doc_id", T.class_index(name).alias("idx"))


# ---- counts and top k --------------------------------------------------------------------------------------------

@query("language_counts", "SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def language_counts(spark, sf):
    return Q.value_counts(X.table(spark, sf, "documents"), "lang")


TOP = "SELECT category, count(*) AS n FROM ent GROUP BY category ORDER BY n DESC, category LIMIT {k}"


@query("top_categories", f"WITH {X.NLI}, ent AS (SELECT * FROM nli WHERE label = 2) {TOP.format(k=10)}")
def top_categories(spark, sf):
    return Q.top_categories(Q.entailments(X.nli(spark, sf, False)), 10)


@query(
    "top_categories_excluding",
    f"WITH {X.NLI}, ent AS (SELECT * FROM nli WHERE label = 2 AND category <> 'general knowledge') {TOP.format(k=5)}",
)
def top_categories_excluding(spark, sf):
    return Q.top_categories(Q.entailments(X.nli(spark, sf, False)), 5, exclude=["general knowledge"])


@query("top_sources_all_ties", "SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 7")
def top_sources_all_ties(spark, sf):
    return Q.top_categories(X.table(spark, sf, "documents"), 7, "source")


@query(
    "rows_in_top_categories",
    f"""WITH {X.NLI}, ent AS (SELECT * FROM nli WHERE label = 2 AND category <> 'general knowledge'),
top AS ({TOP.format(k=5)}) SELECT seq, category FROM ent WHERE category IN (SELECT category FROM top)""",
)
def rows_in_top_categories(spark, sf):
    return Q.in_top_categories(
        Q.entailments(X.nli(spark, sf, False)), 5, exclude=["general knowledge"]
    ).select("seq", "category")


@query(
    "rows_in_top_groups",
    f"""WITH {X.NLI}, ent AS (SELECT seq, {GROUPED} AS category FROM nli WHERE label = 2),
kept AS (SELECT * FROM ent WHERE category <> 'general knowledge'),
top AS (SELECT category, count(*) AS n FROM kept GROUP BY category ORDER BY n DESC, category LIMIT 6)
SELECT seq, category FROM kept WHERE category IN (SELECT category FROM top)""",
)
def rows_in_top_groups(spark, sf):
    grouped = Q.group_categories(Q.entailments(X.nli(spark, sf, False)))
    return Q.in_top_categories(grouped, 6, exclude=["general knowledge"]).select("seq", "category")


@query("rows_per_split", f"WITH {X.NLI} SELECT split, count(*) AS n FROM nli GROUP BY split")
def rows_per_split(spark, sf):
    return Q.value_counts(X.nli(spark, sf, False), "split")


# ---- appends -----------------------------------------------------------------------------------------------------

EXAMPLES = [
    (-1, "Which of four siblings is not named?", "riddle", 2),
    (-2, "Which of four siblings is not named?", "role play", 0),
    (-3, "Explain in simple terms how a language model predicts words.", "language", 1),
]
EXAMPLE_SCHEMA = "seq bigint, text string, category string, label int"


@query(
    "records_appended",
    f"""WITH {X.NLI} SELECT seq, text, category, label, split FROM nli
UNION ALL SELECT * FROM (VALUES {', '.join(f"({s}, '{t}', '{c}', {l}, 'train')" for s, t, c, l in EXAMPLES)})""",
)
def records_appended(spark, sf):
    new = literal_rows(spark, EXAMPLES, EXAMPLE_SCHEMA)
    return Q.append_to_split(X.nli(spark, sf, False), new, "train").select(*NLI_SCHEMA.names)


@query(
    "session_records_appended",
    f"""WITH {X.NLI}, s AS (SELECT * FROM nli WHERE split = 'test')
SELECT seq, category, label FROM s UNION ALL SELECT seq, category, label FROM s WHERE label = 2""",
)
def session_records_appended(spark, sf):
    session = X.nli(spark, sf, False).where("split = 'test'").select("seq", "category", "label")
    return session.unionByName(Q.entailments(session))


# ---- NLI training rows -------------------------------------------------------------------------------------------

@query(
    "nli_sentences",
    f"""WITH {X.NLI}, r AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || seq), seq) AS rn, count(*) OVER () AS n FROM nli)
SELECT seq, label AS labels,
  '<prompt>' || text || '</prompt> ' || 'This example is a ' || category || ' prompt.' AS input_sentence,
  CASE WHEN rn <= floor(n * CAST({1 - 0.4!r} AS DOUBLE)) THEN 'train' ELSE 'eval' END AS split FROM r""",
)
def nli_sentences(spark, sf):
    return N.format_rows(X.nli(spark, sf), "seq").select("seq", "labels", "input_sentence", "split")


@query(
    "nli_token_ids",
    f"""WITH {X.NLI}, s AS (
  SELECT seq, list_slice(regexp_extract_all(lower('<prompt>' || text || '</prompt> ' || 'This example is a ' || category
         || ' prompt.'), '[\\p{{L}}\\p{{N}}_]{{2,}}'), 1, 127) AS w FROM nli),
i AS (SELECT seq, list_transform(w, lambda x: CAST('0x' || substr(md5(x), 1, 8) AS BIGINT) % 49999 + 1) AS ids FROM s)
SELECT seq, CAST(len(ids) AS INT) AS real_tokens, 127 AS padded_tokens,
       array_to_string(ids, ' ') || repeat(' 0', 127 - len(ids)) AS input_ids FROM i""",
)
def nli_token_ids(spark, sf):
    rows = N.encode(N.input_sentences(X.nli(spark, sf)), F.col("input_sentence"))
    return rows.select(
        "seq",
        F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("real_tokens"),
        F.size("input_ids").alias("padded_tokens"),
        F.array_join(F.transform("input_ids", lambda x: x.cast("string")), " ").alias("input_ids"),
    )


def contradictions(k: int, template: str = T.PLAIN_TEMPLATE) -> str:
    head, tail = template.split("{}")
    return f"""{X.NLI}, ent AS (SELECT * FROM nli WHERE label = 2),
drawn AS (
  SELECT e.seq, e.text, c.label AS hypothesis_category,
         row_number() OVER (PARTITION BY e.seq ORDER BY md5('42:' || e.seq || ':' || c.label)) AS pos
  FROM ent e JOIN (SELECT unnest({X.sql_list(X.CATEGORIES)}) AS label) c ON c.label <> e.category),
made AS (
  SELECT seq, text, 0 AS pos, category AS hypothesis_category, 2 AS labels FROM ent
  UNION ALL SELECT seq, text, CAST(pos AS INT), hypothesis_category, 0 FROM drawn WHERE pos <= {k}),
rows AS (SELECT *, '{head}' || hypothesis_category || '{tail}' AS hypothesis FROM made)"""


@query(
    "contradictions",
    f"""WITH {contradictions(2)} SELECT seq, pos, hypothesis_category, labels,
  '<prompt>' || text || '</prompt> ' || hypothesis AS input_sentence FROM rows""",
)
def contradiction_rows(spark, sf):
    rows = N.contradiction_rows(Q.entailments(X.nli(spark, sf)), "seq", X.CATEGORIES, 2)
    return rows.select("seq", "pos", "hypothesis_category", "labels", "input_sentence")


@query(
    "contradictions_split",
    f"""WITH {contradictions(2)}, r AS (
  SELECT seq, pos, labels, row_number() OVER (ORDER BY md5('42:' || seq || '-' || pos)) AS rn, count(*) OVER () AS n FROM rows)
SELECT seq, pos, labels, CASE WHEN rn <= floor(n * CAST({1 - 0.2!r} AS DOUBLE)) THEN 'train' ELSE 'eval' END AS split FROM r""",
)
def contradictions_split(spark, sf):
    rows = N.contradiction_dataset(Q.entailments(X.nli(spark, sf)), "seq", X.CATEGORIES)
    return rows.select("seq", "pos", "labels", "split")


@query(
    "contradictions_with_sequence_marks",
    f"""WITH {contradictions(3)} SELECT seq, pos, labels, '<s>' || text || '</s> ' || hypothesis AS input_sentence FROM rows""",
)
def contradictions_with_sequence_marks(spark, sf):
    rows = N.contradiction_rows(Q.entailments(X.nli(spark, sf)), "seq", X.CATEGORIES, 3, marks=T.SEQUENCE_MARKS)
    return rows.select("seq", "pos", "labels", "input_sentence")


@query(
    "paired_rows",
    f"WITH {contradictions(1)} SELECT seq, text AS premise, hypothesis, labels, pos FROM rows",
)
def paired_rows(spark, sf):
    return N.paired_encoding(Q.entailments(X.nli(spark, sf)), "seq", X.CATEGORIES)


@query(
    "training_rows_size",
    f"WITH {X.NLI} SELECT count(*) AS num_examples, CAST(count(*) * 127 AS BIGINT) AS num_tokens FROM nli",
)
def training_rows_size(spark, sf):
    from parley.operators.metrics import dataset_size

    return dataset_size(N.encode(N.input_sentences(X.nli(spark, sf)), F.col("input_sentence")))


@query("planned_training_tokens", "SELECT CAST(least(32, count(*)) * 127 * 60 AS BIGINT) AS num_tokens FROM labels")
def planned_training_tokens(spark, sf):
    from parley.operators.metrics import planned_tokens

    rows = N.encode(N.input_sentences(X.nli(spark, sf)), F.col("input_sentence"))
    return planned_tokens(rows, "seq", 32, 60)


# ---- labelling ---------------------------------------------------------------------------------------------------

CANDIDATES = X.CATEGORIES[:10]


def queue(spark, sf):
    prompts = X.nli(spark, sf).where("split = 'test'").select("seq", "text")
    return L.labeling_queue(prompts, HypothesisOverlapScorer(CANDIDATES))


QUEUE = f"""{X.NLI}, src AS (SELECT seq AS id, text FROM nli WHERE split = 'test'), {P.overlap(CANDIDATES)},
q AS (SELECT id AS seq, row_number() OVER (ORDER BY md5('42:' || id), id) AS place,
        max(label) FILTER (WHERE r = 1) AS top_category, max(score) FILTER (WHERE r = 1) AS top_score,
        max(label) FILTER (WHERE r = 2) AS second_category, max(score) FILTER (WHERE r = 2) AS second_score,
        max(label) FILTER (WHERE r = {len(CANDIDATES)}) AS bottom_category,
        max(score) FILTER (WHERE r = {len(CANDIDATES)}) AS bottom_score
      FROM ranked GROUP BY id)"""


@query(
    "labeling_queue",
    f"""WITH {QUEUE} SELECT seq, place, top_category, round_even(top_score, 6) AS top_score, second_category,
  round_even(second_score, 6) AS second_score, bottom_category, round_even(bottom_score, 6) AS bottom_score FROM q""",
)
def labeling_queue(spark, sf):
    scores = [F.bround(f"{w}_score", 6).alias(f"{w}_score") for w in ("top", "second", "bottom")]
    return queue(spark, sf).select("seq", "place", "top_category", "second_category", "bottom_category", *scores)


DECIDE = """d AS (
  SELECT doc_id AS seq, ['correct', 'wrong', 'neutral', 'skip'][doc_id // 5 % 4 + 1] AS action,
         CASE WHEN doc_id % 3 = 0 THEN ' music ' ELSE ' ' END AS custom_entailment,
         CASE WHEN doc_id % 2 = 0 THEN 'sports' END AS custom_contradiction,
         'travel' AS custom_neutral
  FROM labels)"""


@query(
    "labeling_records",
    f"""WITH {QUEUE}, {DECIDE}, j AS (SELECT q.*, d.* EXCLUDE (seq) FROM q JOIN d ON q.seq = d.seq WHERE action <> 'skip'),
a AS (SELECT seq, 1 AS o, top_category AS category, CASE action WHEN 'correct' THEN 2 WHEN 'wrong' THEN 0 ELSE 1 END AS label FROM j
  UNION ALL SELECT seq, 2, bottom_category, 0 FROM j WHERE action <> 'wrong'
  UNION ALL SELECT seq, 3, trim(custom_entailment), 2 FROM j WHERE trim(custom_entailment) <> ''
  UNION ALL SELECT seq, 4, trim(custom_contradiction), 0 FROM j WHERE trim(custom_contradiction) <> ''
  UNION ALL SELECT seq, 5, custom_neutral, 1 FROM j WHERE action = 'neutral')
SELECT a.seq, CAST(row_number() OVER (PARTITION BY a.seq ORDER BY o) - 1 AS INT) AS place, nli.text, a.category,
       CAST(a.label AS INT) AS label FROM a JOIN nli ON a.seq = nli.seq""",
)
def labeling_records(spark, sf):
    ids = X.table(spark, sf, "labels")
    actions = F.array(*map(F.lit, ["correct", "wrong", "neutral", "skip"]))
    decisions = ids.select(
        F.col("doc_id").alias("seq"),
        F.element_at(actions, (F.floor(F.col("doc_id") / 5) % 4 + 1).cast("int")).alias("action"),
        F.when(F.col("doc_id") % 3 == 0, " music ").otherwise(" ").alias("custom_entailment"),
        F.when(F.col("doc_id") % 2 == 0, "sports").alias("custom_contradiction"),
        F.lit("travel").alias("custom_neutral"),
    )
    return L.apply_decisions(queue(spark, sf).drop("place"), decisions)
