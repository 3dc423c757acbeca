"""SQL for the oracles of scored queries, written independently of the Spark plans: labels are rows here, not arrays."""

from __future__ import annotations

from collections.abc import Sequence

from parley.functions.text import PLAIN_TEMPLATE

WORDS = r"regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}_]{{2,}}')"


# every run of three characters: the disjoint runs from the first, the second and the third character on
TRIGRAMS = """(regexp_extract_all({t}, '(?s)...') || regexp_extract_all(substr({t}, 2), '(?s)...')
  || regexp_extract_all(substr({t}, 3), '(?s)...'))"""


def words(c: str) -> str:
    return WORDS.format(c=c)


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def label_rows(labels: Sequence[str]) -> str:
    return "(VALUES " + ", ".join(f"({i}, {quoted(l)})" for i, l in enumerate(labels)) + ")"


def ranked(multi_label: bool = False) -> str:
    """From sc(id, pos, label, e, c) to ranked(id, pos, label, score, r)."""
    if multi_label:
        return """ranked AS (SELECT *, 1 / (1 + exp(c - e)) AS score,
  row_number() OVER (PARTITION BY id ORDER BY e - c DESC, pos) AS r FROM sc)"""
    return """shifted AS (SELECT *, exp(e - max(e) OVER (PARTITION BY id)) AS x FROM sc),
ranked AS (SELECT *, x / sum(x) OVER (PARTITION BY id) AS score,
  row_number() OVER (PARTITION BY id ORDER BY e DESC, pos) AS r FROM shifted)"""


def overlap(labels: Sequence[str], template: str = PLAIN_TEMPLATE, scale: float = 10.0, multi_label: bool = False) -> str:
    """From src(id, text) to ranked, by trigram overlap."""
    grams = f"list_distinct({TRIGRAMS})"
    return f"""hyp AS (SELECT pos, label, lower(replace({quoted(template)}, '{{}}', label)) AS h
  FROM {label_rows(labels)} AS v(pos, label)),
lab AS (SELECT pos, label, {grams.format(t='h')} AS g FROM hyp),
low AS (SELECT id, lower(text) AS t FROM src),
gr AS (SELECT id, {grams.format(t='t')} AS g FROM low),
cosines AS (SELECT id, pos, label, CASE WHEN len(gr.g) = 0 THEN 0 ELSE
  len(list_intersect(gr.g, lab.g)) / sqrt(CAST(len(gr.g) AS DOUBLE) * len(lab.g)) END AS co FROM gr, lab),
sc AS (SELECT id, pos, label, round_even({scale!r} * co, 6) AS e, round_even({scale!r} * (1 - co), 6) AS c FROM cosines),
{ranked(multi_label)}"""


def naive_bayes_model(labels: Sequence[str]) -> str:
    """From train(category, text) to lab, prior and weights(word, pos, n, nc, e, c)."""
    return f"""lab AS (SELECT pos, label FROM {label_rows(labels)} AS v(pos, label)),
known AS (SELECT category, text FROM train WHERE category IN (SELECT label FROM lab)),
tok AS (SELECT category, unnest({words('text')}) AS word FROM known),
voc AS (SELECT word, count(*) AS n FROM tok GROUP BY word),
cnt AS (SELECT word, category, count(*) AS nc FROM tok GROUP BY word, category),
grid AS (SELECT voc.word, lab.pos, voc.n, coalesce(cnt.nc, 0) AS nc
  FROM voc CROSS JOIN lab LEFT JOIN cnt ON cnt.word = voc.word AND cnt.category = lab.label),
weights AS (SELECT word, pos, n, nc,
  ln((nc + 1) / (sum(nc) OVER (PARTITION BY pos) + count(*) OVER (PARTITION BY pos))) AS e,
  ln((n - nc + 1) / (sum(n - nc) OVER (PARTITION BY pos) + count(*) OVER (PARTITION BY pos))) AS c FROM grid),
prior AS (SELECT lab.pos, lab.label,
  (count(known.category) + 1) / ((SELECT count(*) FROM known) + {len(labels)}) AS p
  FROM lab LEFT JOIN known ON known.category = lab.label GROUP BY lab.pos, lab.label)"""


def naive_bayes_scores() -> str:
    """From src(id, text) and the model to sc."""
    return f"""stok AS (SELECT id, unnest({words('text')}) AS word FROM src),
tf AS (SELECT id, word, count(*) AS tf FROM stok GROUP BY id, word),
sums AS (SELECT tf.id, w.pos, sum(tf.tf * w.e) AS e, sum(tf.tf * w.c) AS c
  FROM tf JOIN weights w ON w.word = tf.word GROUP BY tf.id, w.pos),
sc AS (SELECT src.id, prior.pos, prior.label, round_even(ln(prior.p) + coalesce(sums.e, 0), 6) AS e,
  round_even(ln(1 - prior.p) + coalesce(sums.c, 0), 6) AS c
  FROM src CROSS JOIN prior LEFT JOIN sums ON sums.id = src.id AND sums.pos = prior.pos)"""


def naive_bayes(labels: Sequence[str], multi_label: bool = False) -> str:
    return f"{naive_bayes_model(labels)},\n{naive_bayes_scores()},\n{ranked(multi_label)}"


def class_table(pairs: str = "pred") -> str:
    """From pred(true_class, predicted_class) to cls(class, tp, fp, fn, support, f1)."""
    return f"""names AS (SELECT true_class AS class FROM {pairs} UNION SELECT predicted_class FROM {pairs}),
cls0 AS (SELECT names.class,
  count(*) FILTER (WHERE p.true_class = names.class AND p.predicted_class = names.class) AS tp,
  count(*) FILTER (WHERE p.true_class <> names.class AND p.predicted_class = names.class) AS fp,
  count(*) FILTER (WHERE p.true_class = names.class AND p.predicted_class <> names.class) AS fn
  FROM names CROSS JOIN {pairs} p GROUP BY names.class),
cls AS (SELECT *, tp + fn AS support, 2 * tp / (2 * tp + fp + fn) AS f1 FROM cls0)"""


BUNDLE = """SELECT CAST(sum(support) AS BIGINT) AS n, round_even(sum(tp) / sum(support), 6) AS accuracy,
  round_even(avg(f1), 6) AS f1_macro, round_even(sum(f1 * support) / sum(support), 6) AS f1_weighted FROM cls"""


def category_groups() -> str:
    return """CASE WHEN category IN ('business', 'finance') THEN 'business and finance'
       WHEN category IN ('language', 'writing') THEN 'language and writing'
       WHEN category IN ('popular culture', 'music', 'entertainment') THEN 'culture and entertainment'
       WHEN category IN ('technology', 'ai') THEN 'technology and ai' ELSE category END"""
