"""Operator 3, near-duplicate documents with bottom-k sketches.

A document's set is that of its five-word shingles, hashed once; its sketch is the SKETCH smallest hashes. Documents with equal
sets are one class. Inverted lists of retained values bring classes together, the union of two sketches estimates their
similarity and drops clear misses, and the Jaccard index of the full sets decides.

Lists stay short by a prefix rule: two sets of similarity 0.75 share at least ``required`` retained values (all but a
chance below 1e-8, exactly so for short documents), so they meet in the lists of their rarest values. Frequent values
of shared passages, which come last, are in a prefix only where nearly the whole document is frequent.

A list is not paired off. Its FIRST_MEMBERS first members are compared with the others, which settles most groups of copies
by about one comparison per member, as members of one component need not be compared again. What is left, lists with several
components, is cut into pools that share no list. In a pool, members outside its largest component are compared with all
others in blocks of bounded size, by one matrix product of the shared values; a block hands on a spanning forest of its links,
never the pairs. So no link that would join two components is lost.

Edge cases: a null or blank text has the empty set and no links. Rows with equal id are one document: they share a
component, and texts that differ under one id are linked by it. A row with null id joins the component of a class with
an id, else its component is null; it is kept only in the latter case. Other columns pass through ``without_copies``.
An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.components import components, forest
from parley.llm.exprs import ascii_lower, free_name, let, words_of
from parley.session import materialize

SHINGLE_WORDS = 5
#: Similarity, in percent, from which documents are linked.
MIN_PERCENT = 75
#: Values in a sketch, and how many of them two linked documents share at least.
SKETCH = 64
MIN_SHARED = 28
#: Sets up to this size only have partners whose sketch is their whole set.
WHOLE_SETS = SKETCH * MIN_PERCENT // 100
#: First members of a list that are compared with all others.
FIRST_MEMBERS = 2
#: Members and hashes on one side of a block, and values that one matrix product takes.
BLOCK_MEMBERS = 512
BLOCK_HASHES = 1 << 20
BLOCK_VALUES = 1 << 13


def shingle_set(text: Column) -> Column:
    """Sorted hashes of the distinct shingles of a text; of fewer words, the whole sequence is one."""

    def of_hashes(h: Column) -> Column:
        def shingle(i: Column) -> Column:
            return F.xxhash64(*[F.get(h, i + k) for k in range(SHINGLE_WORDS)])

        windows = F.transform(F.sequence(F.lit(0), F.size(h) - SHINGLE_WORDS), shingle)
        whole = F.array(F.xxhash64(F.lit("short"), h))
        empty = F.array().cast("array<long>")
        return (F.when(F.size(h) == 0, empty).when(F.size(h) < SHINGLE_WORDS, whole)
                .otherwise(F.sort_array(F.array_distinct(windows))))

    return let(F.transform(words_of(ascii_lower(text)), lambda w: F.xxhash64(w)), of_hashes)


def required(size: Column) -> Column:
    """Retained values that a set of this size shares at least with any set that is linked to it."""
    sketch = F.least(size, F.lit(SKETCH))
    return F.when(size <= WHOLE_SETS, F.ceil(size * MIN_PERCENT / 100)).otherwise(
        F.ceil(sketch * MIN_SHARED / SKETCH)).cast("int")


def _classes(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Rows (id, n, h1, h2), and classes (rep, n, sketch) of rows with equal, non-empty sets."""
    measured = docs.select(F.col(key).alias("id"), F.inline(F.array(let(shingle_set(F.col(text)), lambda s: F.struct(
        F.size(s).alias("n"), F.xxhash64(s).alias("h1"), F.xxhash64(F.lit(1), s).alias("h2"),
        F.slice(s, 1, SKETCH).alias("sketch"))))))
    rows = materialize(measured, "shingle-sketches")
    classes = (rows.filter("n > 0").groupBy("h1", "h2")
               .agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch")))
    return rows.drop("sketch"), materialize(classes, "shingle-classes")


def _lists(classes: DataFrame) -> DataFrame:
    """Inverted lists (v, rep, n, shared, members) of the rarest retained values, of at least two members each.

    ``shared`` is the number of a class's retained values that other classes have.
    """
    entries = classes.filter("rep is not null").select("rep", "n", "h1", "h2", F.explode("sketch").alias("v"))
    frequency = entries.groupBy("v").agg(F.count("*").alias("f")).filter("f > 1")
    # a sketch has SKETCH values, so these groups are small
    own = (entries.join(frequency, "v").groupBy("rep", "h1", "h2", "n")
           .agg(F.sort_array(F.collect_list(F.struct("f", "v"))).alias("values"))
           .withColumn("shared", F.size("values")).withColumn("extra", F.col("shared") - required(F.col("n")) + 1)
           .filter("extra > 0"))
    prefixes = materialize(own.select("rep", "n", "shared", F.explode(F.slice("values", 1, F.col("extra"))).alias("value"))
                           .select("rep", "n", "shared", "value.v"), "shingle-prefixes")
    sizes = prefixes.groupBy("v").agg(F.count("*").alias("members")).filter("members > 1")
    return materialize(prefixes.join(sizes, "v"), "shingle-lists")


def _full_sets(docs: DataFrame, lists: DataFrame, key: str, text: str) -> DataFrame:
    """Sets (rep, n, sketch, shingles) of the classes that are in lists."""
    wanted = materialize(lists.select(F.col("rep").alias("wanted")).distinct(), "shingle-wanted")
    texts = docs.select(F.col(key).alias("rep"), F.col(text).alias("text"))
    found = texts.join(wanted, F.col("rep") == F.col("wanted"), "left_semi")
    sets = found.select("rep", F.inline(F.array(let(shingle_set(F.col("text")), lambda s: F.struct(
        F.size(s).alias("n"), F.slice(s, 1, SKETCH).alias("sketch"), s.alias("shingles"))))))
    return materialize(sets.filter("n > 0"), "shingle-sets")


def _estimated(a: Column, b: Column) -> Column:
    """Whether the union sketch of two sketches leaves the pair a chance: of its values, enough are in both."""
    union = let(F.slice(F.sort_array(F.array_union(a, b)), 1, SKETCH), lambda u: F.struct(
        F.size(F.array_intersect(u, F.array_intersect(a, b))).alias("shared"), F.size(u).alias("size")))
    return let(union, lambda x: x["shared"] * SKETCH >= x["size"] * MIN_SHARED)


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""

    def side(name: str, value: str) -> DataFrame:
        return sets.select(F.col("rep").alias(name), F.col("n").alias(f"n_{name}"), F.col(value).alias(f"{value}_{name}"))

    likely = (pairs.join(side("a", "sketch"), "a").join(side("b", "sketch"), "b")
              .filter(_estimated(F.col("sketch_a"), F.col("sketch_b"))).select("a", "b"))
    likely = materialize(likely, "shingle-pairs")
    whole = likely.join(side("a", "shingles"), "a").join(side("b", "shingles"), "b")
    common = F.size(F.array_intersect("shingles_a", "shingles_b"))
    similar = let(common, lambda c: c * 100 >= (F.col("n_a") + F.col("n_b") - c) * MIN_PERCENT)
    return whole.filter(similar).select("a", "b").distinct()


def _unsettled(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """Lists whose members are in several components, with the component of each member."""
    placed = lists.join(labels, lists["rep"] == labels["node"], "left").withColumn(
        "component", F.coalesce("label", "rep")).drop("node", "label")
    unsettled = (placed.groupBy("v").agg(F.min("component").alias("low"), F.max("component").alias("high"))
                 .filter("low != high").select("v"))
    return materialize(placed.join(unsettled, "v", "left_semi"), "shingle-open")


def _first_pairs(lists: DataFrame) -> DataFrame:
    """Pairs (a, b) of the first members of each list with its other members."""
    # members with most shared values come first: the original of a group of copies has what the others share
    order = Window.partitionBy("v").orderBy(F.desc("shared"), "rep")
    first = (lists.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= FIRST_MEMBERS)
             .select("v", F.col("rep").alias("center"), F.col("n").alias("n_center"),
                     F.col("component").alias("of_center")))
    sizes_fit = F.least("n", "n_center") * 100 >= F.greatest("n", "n_center") * MIN_PERCENT
    return (lists.join(first, "v").filter((F.col("component") != F.col("of_center")) & sizes_fit)
            .select(F.least("rep", "center").alias("a"), F.greatest("rep", "center").alias("b")).distinct())


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Number of hashes that each set of one side shares with each of the other."""
    counts = np.zeros((len(left), len(right)), np.float32)
    values_a, values_b = np.concatenate(left), np.concatenate(right)
    rows_a = np.repeat(np.arange(len(left)), [len(x) for x in left])
    rows_b = np.repeat(np.arange(len(right)), [len(x) for x in right])
    shared = np.intersect1d(values_a, values_b)
    if not len(shared):
        return counts
    place_a, place_b = np.searchsorted(shared, values_a), np.searchsorted(shared, values_b)
    in_a = shared[np.minimum(place_a, len(shared) - 1)] == values_a
    in_b = shared[np.minimum(place_b, len(shared) - 1)] == values_b
    place_a, rows_a, place_b, rows_b = place_a[in_a], rows_a[in_a], place_b[in_b], rows_b[in_b]
    for start in range(0, len(shared), BLOCK_VALUES):
        width = min(BLOCK_VALUES, len(shared) - start)
        sides = []
        for place, rows, n in ((place_a, rows_a, len(left)), (place_b, rows_b, len(right))):
            own = (place >= start) & (place < start + width)
            side = np.zeros((n, width), np.float32)
            side[rows[own], place[own] - start] = 1
            sides.append(side)
        counts += sides[0] @ sides[1].T
    return counts


def _block_links(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Spanning forest of the links between the members of a block that are of one pool and different components."""
    if not len(left) or not len(right):
        return pd.DataFrame({"a": [], "b": []}).astype("int64")
    sets_a, sets_b = left["shingles"].tolist(), right["shingles"].tolist()
    common = _common(sets_a, sets_b)
    sizes = np.array([len(x) for x in sets_a])[:, None] + np.array([len(x) for x in sets_b])
    similar = common * 100 >= (sizes - common) * MIN_PERCENT
    similar &= left["pool"].to_numpy()[:, None] == right["pool"].to_numpy()
    similar &= left["component"].to_numpy()[:, None] != right["component"].to_numpy()
    a, b = np.nonzero(similar)
    nodes, places = np.unique(np.concatenate([left["rep"], right["rep"]]), return_inverse=True)
    edges = forest(places[:len(left)][a], places[len(left):][b], len(nodes))
    return pd.DataFrame({"a": [nodes[x] for x, _ in edges], "b": [nodes[y] for _, y in edges]}).astype("int64")


def _pool_links(lists: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between different components within pools of lists."""
    edges = lists.join(lists.groupBy("v").agg(F.min("rep").alias("low")), "v").select(F.col("rep").alias("a"),
                                                                                     F.col("low").alias("b"))
    pools = components(edges).select(F.col("node").alias("rep"), F.col("label").alias("pool"))
    members = materialize(lists.select("rep", "n", "component").distinct().join(pools, "rep"), "shingle-members")
    sizes = members.groupBy("pool", "component").agg(F.count("*").alias("size"), F.sum("n").alias("hashes"))
    pool = sizes.groupBy("pool").agg(F.sum("size").alias("all"), F.sum("hashes").alias("all_hashes"),
                                     F.max(F.struct("size", "component", "hashes")).alias("largest"))

    def blocks(n: Column, hashes: Column) -> Column:
        return F.greatest(F.lit(1), F.ceil(n / BLOCK_MEMBERS), F.ceil(hashes / BLOCK_HASHES)).cast("int")

    # the small pools share groups of about a block, so that a task is not one pool of three
    small = (F.col("all") * 8 <= BLOCK_MEMBERS) & (F.col("all_hashes") * 8 <= BLOCK_HASHES)
    totals = pool.filter(small).agg(F.sum("all"), F.sum("all_hashes")).first()
    bins = max(1, -(-(totals[0] or 0) // BLOCK_MEMBERS), -(-(totals[1] or 0) // BLOCK_HASHES))
    pool = pool.select(
        "pool", F.col("largest.component").alias("main"),
        F.when(small, -1 - F.pmod(F.xxhash64("pool"), F.lit(bins))).otherwise(F.col("pool")).alias("of"),
        blocks(F.col("all"), F.col("all_hashes")).alias("n_all"),
        blocks(F.col("all") - F.col("largest.size"), F.col("all_hashes") - F.col("largest.hashes")).alias("n_rest"))
    rows = members.join(pool, "pool").join(sets.select("rep", "shingles"), "rep")

    def side(rows: DataFrame, own: str, other: str, n_own: str, n_other: str) -> DataFrame:
        return rows.select("of", F.pmod(F.xxhash64("rep"), F.col(n_own)).cast("int").alias(own),
                           F.explode(F.sequence(F.lit(0), F.col(n_other) - 1)).alias(other),
                           "rep", "component", "pool", "shingles")

    rest = side(rows.filter("component != main"), "x", "y", "n_rest", "n_all")
    whole = side(rows, "y", "x", "n_all", "n_rest")
    whole = whole.toDF(*whole.columns)  # new column identities, as both sides come from the same rows
    return (rest.groupBy("of", "x", "y").cogroup(whole.groupBy("of", "x", "y"))
            .applyInPandas(_block_links, "a long, b long"))


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Components of the links of before, which labels stand for, and new ones."""
    return materialize(components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(links)),
                       "shingle-labels")


def labelled(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the key, n_shingles, component_id and kept."""
    rows, classes = _classes(docs, key, text)
    lists = _lists(classes)
    sets = _full_sets(docs, lists, key, text)
    # texts that differ under one id are linked by the id, and classes through the ids they share
    reps = classes.select("h1", "h2", "rep")
    by_id = (rows.filter("n > 0").join(reps, ["h1", "h2"]).filter("id != rep")
             .groupBy("id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")))
    twice = by_id.join(reps.select(F.col("rep").alias("id")).distinct(), "id", "left_semi")
    links = materialize(twice.select(F.col("id").alias("a"), F.col("low").alias("b")).unionByName(
        by_id.filter("low != high").select(F.col("low").alias("a"), F.col("high").alias("b"))), "shingle-links")
    pairs = materialize(_first_pairs(lists.withColumn("component", F.col("rep"))), "shingle-first")
    labels = materialize(components(links.unionByName(_confirmed(pairs, sets))), "shingle-labels")
    unsettled = _unsettled(lists, labels)
    labels = _joined(labels, materialize(_pool_links(unsettled, sets), "shingle-links"))
    facts = (reps.join(labels, reps["rep"] == labels["node"], "left")
             .select("h1", "h2", F.coalesce("label", "rep").alias("component")))
    joined = rows.withColumn("h1", F.when(F.col("n") > 0, F.col("h1"))).join(facts, ["h1", "h2"], "left")
    component = F.coalesce("component", "id")
    kept = F.when(component.isNull(), True).otherwise(F.coalesce(F.col("id") == component, F.lit(False)))
    return joined.select(F.col("id").alias(key), F.col("n").cast("long").alias("n_shingles"),
                         component.alias("component_id"), kept.alias("kept"))


def without_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without those of which another one of their component stays; one row per id.

    Rows with null id and no copy under an id all stay.
    """
    found = materialize(labelled(docs, key, text), "near-copies")
    name = free_name(docs, "removed")
    removed = found.filter(~F.col("kept") & F.col(f"`{key}`").isNotNull()).select(F.col(f"`{key}`").alias(name)).distinct()
    own = F.col(f"`{key}`")
    stay = docs.filter(own.isNotNull()).join(removed, own == F.col(name), "left_anti").dropDuplicates([key])
    return stay.unionByName(docs.filter(own.isNull()))
