"""Near-duplicate documents and vectors, and components, against brute force."""

import itertools
import random
import re

import numpy as np
import pytest

from disk import written
from parley.llm import near_dedup, vector_dedup
from parley.llm.components import components, forest, spanning


def reachable(nodes, links):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)]
    links += [(k, k + 1) for k in range(1000, 1060)] + [(2000, 2000 + k) for k in range(500)] + [(5, 5), (None, 4)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    real = [(a, b) for a, b in links if a is not None and a != b]
    want = reachable({n for pair in real for n in pair}, real)
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if 0 < len(words) < 5:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[k:k + 5]) for k in range(len(words) - 4))


def expected(rows):
    """Brute force over all pairs: rows of (id, text), ids may repeat."""
    sets = [(i, shingles(t)) for i, t in rows]
    ids = [i for i, s in sets]
    links = []
    for (i, s), (j, t) in itertools.combinations(sets, 2):
        if s and t and 100 * len(s & t) >= 75 * len(s | t):
            links.append((i, j))
    return {i: len(s) for i, s in sets}, reachable(ids, links)


def variants(rng):
    """Documents with exact copies, near copies around the threshold, a shared passage and short texts."""
    vocabulary = [f"w{k}" for k in range(400)]
    passage = " ".join(rng.choices(vocabulary, k=60))
    rows = []
    for _ in range(40):
        words = rng.choices(vocabulary, k=rng.choice([3, 6, 20, 90, 300]))
        text = " ".join(words)
        rows.append(text)
        for _ in range(rng.randrange(4)):
            changed = list(words)
            for _ in range(rng.randrange(1 + len(words) // 20 + 2)):
                changed[rng.randrange(len(changed))] = rng.choice(vocabulary)
            rows.append(" ".join(changed))
        rows.append(text.upper() + "\n")
        rows.append(text + " " + passage)
    # a group of short texts made of frequent lines
    lines = [" ".join(rng.choices(vocabulary, k=7)) for _ in range(6)]
    rows += [" ".join(rng.sample(lines, 3)) for _ in range(60)]
    # near copies of one text, mostly unlike each other
    base = rng.choices(vocabulary, k=120)
    for _ in range(60):
        copy = list(base)
        for _ in range(rng.randrange(8)):
            copy[rng.randrange(120)] = rng.choice(vocabulary)
        rows.append(" ".join(copy))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_near_copies_equal_brute_force(spark, seed):
    rows = list(enumerate(variants(random.Random(seed))))
    got = near_dedup.labelled(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    sizes, labels = expected(rows)
    assert {r.doc_id: r.n_shingles for r in got} == sizes
    assert {r.doc_id: r.component_id for r in got} == labels
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_blocks_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "FIRST_MEMBERS", 1)
    monkeypatch.setattr(near_dedup, "BLOCK_MEMBERS", 8)
    monkeypatch.setattr(near_dedup, "BLOCK_VALUES", 16)
    rows = list(enumerate(variants(random.Random(3))[:200]))
    got = near_dedup.labelled(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == expected(rows)[1]


def test_common_counts():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40))) for _ in range(30)]
    got = near_dedup._common(sets[:12], sets[12:])
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets[12:]] for a in sets[:12]]


def test_near_copies_edge_cases(spark):
    words = " ".join(f"w{k}" for k in range(30))
    other = " ".join(f"v{k}" for k in range(30))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One two"), (5, "one  TWO"), (6, words), (6, words), (6, other), (7, other),
            (None, words), (None, "only here"), (None, None), (8, "É one two three four"), (9, "é one two three four"),
            (10, " ".join(f"long{k}" for k in range(50_000))), (11, " ".join(f"long{k}" for k in range(50_000)))]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, removed int, n int")
    got = near_dedup.labelled(docs).collect()
    found = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in got}
    assert found[(1, 0)] == (1, True) and found[(2, 0)] == (2, True) and found[(5, 1)] == (4, False)
    assert found[(7, 26)] == (6, False) and found[(None, 26)] == (6, False) and found[(None, 1)] == (None, True)
    assert found[(8, 1)] == (8, True) and found[(9, 1)] == (9, True) and found[(11, 49_996)] == (10, False)
    assert len(got) == len(rows)
    stay = near_dedup.without_copies(docs)
    assert stay.columns == docs.columns
    assert sorted(r.doc_id for r in stay.filter("doc_id is not null").collect()) == [1, 2, 3, 4, 6, 8, 9, 10]
    assert near_dedup.labelled(docs.limit(0)).count() == 0 and near_dedup.without_copies(docs.limit(0)).count() == 0


def groups(rng, n, dims):
    """Unit-free vectors with copies around the threshold, exact copies and one large group."""
    base = rng.normal(size=(n, dims))
    near = base[: n // 4] + rng.normal(size=(n // 4, dims)) * rng.choice([0.05, 0.45, 0.5], size=(n // 4, 1))
    crowd = rng.normal(size=dims) + rng.normal(size=(n // 4, dims)) * 0.1
    return np.concatenate([base, near, crowd, base[:20], crowd[:30]]).astype(np.float32)


def brute(vectors):
    whole = vectors.astype(np.float64)
    unit = whole / np.linalg.norm(whole, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    return near.sum(1), reachable(range(len(unit)), list(zip(*map(list, np.nonzero(np.triu(near))))))


def test_vectors_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "ROWS_PER_LIST", 40)
    monkeypatch.setattr(vector_dedup, "BLOCK", 32)
    vectors = groups(np.random.default_rng(2), 800, 16)
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r for r in vector_dedup.deduplicated(rows.repartition(3)).collect()}
    links, labels = brute(vectors)
    found = sum(r.n_links for r in got.values())
    assert found <= links.sum() and all(got[k].n_links <= links[k] for k in got)
    assert found >= 0.99 * links.sum()
    assert np.mean([got[k].component_id == labels[k] for k in got]) >= 0.99
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


@pytest.mark.parametrize("rank", [8, 64])
def test_vectors_of_few_directions_lose_no_link(spark, monkeypatch, rank):
    monkeypatch.setattr(vector_dedup, "ROWS_PER_LIST", 20)
    rng = np.random.default_rng(rank)
    vectors = groups(rng, 800, rank) @ np.linalg.qr(rng.normal(size=(64, rank)))[0].T
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in vector_dedup.deduplicated(rows.repartition(3)).collect()}
    links, labels = brute(vectors)
    assert {k: r.n_links for k, r in got.items()} == dict(enumerate(links.tolist()))
    assert {k: r.component_id for k, r in got.items()} == labels


def test_vector_edge_cases(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]),
            (7, [None, 1.0]), (8, [1.0, 0.0]), (8, [1.0, 0.0]), (9, [0.0, -1.0]), (10, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]),
            (11, []), (12, [-0.0, -2.0])]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, h1 string")
    got = sorted((r.vec_id or 0, r.n_links, r.component_id or 0) for r in vector_dedup.deduplicated(table).collect())
    assert got == sorted([(1, 3, 1), (2, 3, 1), (8, 3, 1), (8, 3, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 0, 6), (7, 0, 7),
                          (9, 1, 9), (12, 1, 9), (10, 0, 10), (11, 0, 11), (0, 0, 0)])
    assert vector_dedup.deduplicated(table.limit(0)).count() == 0


def test_forest_connects_what_the_links_connect():
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 60, 90), rng.integers(0, 60, 90)
    kept = forest(a, b, 60)
    assert reachable(range(60), kept) == reachable(range(60), list(zip(a.tolist(), b.tolist()))) and len(kept) < 60


def test_what_is_written_does_not_grow_with_the_probes(spark, monkeypatch):
    """100 lists, of which a vector asks many: with a copy of it for each, 18 times the input was written."""
    monkeypatch.setattr(vector_dedup, "ROWS_PER_LIST", 30)
    vectors = np.random.default_rng(4).normal(size=(3000, 64)).astype(np.float32)
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    assert written(spark, lambda: vector_dedup.deduplicated(rows).collect()) < 5 * vectors.nbytes


def test_passes_over_single_lists_and_pieces_of_them_equal_brute_force(spark, monkeypatch):
    """Lists are read some at a time, and one that is larger than a pass in pieces; equal vectors count as often as they occur."""
    monkeypatch.setattr(vector_dedup, "ROWS_PER_LIST", 100)
    monkeypatch.setattr(vector_dedup, "BLOCK", 64)
    monkeypatch.setattr(vector_dedup, "CHUNK_BYTES", 400 * 8 * 16)
    monkeypatch.setattr(vector_dedup, "PLAIN_ROWS", 100)
    vectors = groups(np.random.default_rng(6), 900, 16)
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r for r in vector_dedup.deduplicated(rows.repartition(3)).collect()}
    links, labels = brute(vectors)
    assert {k: r.n_links for k, r in got.items()} == dict(enumerate(links.tolist()))
    assert {k: r.component_id for k, r in got.items()} == labels


def test_spanning_links_connect_what_the_links_connect_over_several_calls():
    rng = np.random.default_rng(5)
    tops, kept, links = np.arange(300), [], []
    for _ in range(5):
        a, b = rng.integers(0, 300, 60), rng.integers(0, 300, 60)
        at, tops = spanning(a, b, tops)
        kept += [(int(a[k]), int(b[k])) for k in at]
        links += zip(a.tolist(), b.tolist())
    want = reachable(range(300), links)
    assert dict(enumerate(tops.tolist())) == want == reachable(range(300), kept)
    assert len(kept) == 300 - len(set(want.values()))
