"""Operators on pairs, against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from fedspark.llm import ann, jaccard

from .cases import by_id, documents, empty, texts

WORD = re.compile("[^\x20\x09-\x0d]+")


def lower(text: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute_components(values: list, width: int, percent: int) -> dict:
    """(shingles, smallest linked document) of each text."""
    sets = []
    for text in values:
        words = WORD.findall(lower(text or ""))
        sets.append({tuple(words[k : k + width]) for k in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)} if words else set())
    up = list(range(len(values)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in enumerate(sets)}


def near_copies(seed: int = 3) -> list:
    """Originals of many lengths with copies changed a little, chains of changes, and passages that texts share."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 5)))
    passage = [word() for _ in range(60)]
    out = []
    for n in (3, 4, 8, 20, 45, 90, 90, 140, 300, 900):
        words = [word() for _ in range(n)]
        for copy in range(8):
            words = list(words)
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                words[rng.randrange(len(words))] = word()
            if rng.random() < 0.2:
                words = words + [word()]
            out.append(" ".join(words))
        out += [" ".join(passage + [word() for _ in range(30)]) for _ in range(3)]
    return out


def test_near_duplicates(spark):
    values = texts(n=25) + near_copies()
    for width, percent in ((4, 85), (5, 80)):
        got = by_id(jaccard.near_duplicates(documents(spark, values), width, percent))
        assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == brute_components(values, width, percent)
    assert jaccard.near_duplicates(empty(spark)).count() == 0


def test_near_duplicates_of_one_large_group(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "HELD", 3000)  # families are cut into blocks, whose open sets meet all others
    monkeypatch.setattr(jaccard, "PIVOTS", 2)
    rng = random.Random(8)
    base = [str(k) for k in range(200)]
    values = []
    for _ in range(60):
        words = list(base)
        for _ in range(rng.choice([1, 3, 5, 12])):
            words[rng.randrange(200)] = str(rng.random())
        values.append(" ".join(words))
    got = by_id(jaccard.near_duplicates(documents(spark, values)))
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == brute_components(values, 4, 85)
    links = {(r.a, r.b) for r in jaccard.near_duplicates(documents(spark, values), every_link=True).collect()}
    sets = [{tuple(v.split()[k : k + 4]) for k in range(197)} for v in values]
    assert links == {(i, j) for j in range(60) for i in range(j) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])}


def test_near_duplicates_of_repeated_and_null_ids(spark):
    values = near_copies(5) + texts(n=5)
    ids = [None if i % 7 == 2 else i % 40 for i in range(len(values))]
    rows = list(zip(ids, values)) * 2
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    brute = brute_components(values, 4, 85)
    least = {}
    for i, (n, root) in brute.items():
        if n and ids[i] is not None:
            least[root] = min(least.get(root, ids[i]), ids[i])
    want = [(ids[i], n, least.get(root) if n else ids[i]) for i, (n, root) in brute.items()] * 2
    order = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted((tuple(r) for r in got), key=order) == sorted(want, key=order)


def test_trees_find_every_link():
    rng = np.random.default_rng(1)
    base = np.arange(300, dtype=np.uint64)
    sets = [np.setdiff1d(base, rng.choice(300, d)) for d in rng.integers(0, 60, 80)] + [np.array([9], np.uint64)]
    sizes = np.array([len(s) for s in sets])
    linked = {(i, j) for j in range(81) for i in range(j) if 100 * (both := len(np.intersect1d(sets[i], sets[j]))) >= 85 * (sizes[i] + sizes[j] - both)}
    assert set(jaccard.tree_links(sets, sizes, every=True)) == linked
    sides = np.arange(81) % 2
    assert set(jaccard.tree_links(sets, sizes, sides, every=True)) == {(i, j) for i, j in linked if sides[i] != sides[j]}


def vectors(spark, rows: list):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, leaf int, vector string")


@pytest.mark.parametrize("cell", [150, 30])  # cells of many leaves, and of one, where copies fill two blocks
def test_neighbours(spark, monkeypatch, cell):
    monkeypatch.setattr(ann, "QUERY_BLOCK", 7)
    monkeypatch.setattr(ann, "LEAF_ROWS", 30)
    monkeypatch.setattr(ann, "CELL_BYTES", cell * 8 * 16)
    monkeypatch.setattr(ann, "PRODUCTS_AT_ONCE", 500)
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((12, 16))
    m = (centres[rng.integers(0, 12, 700)] + 0.3 * rng.standard_normal((700, 16))).astype(np.float32)
    m[300:340] = m[300]  # copies tie
    rows = [(i, m[i].tolist(), 0, "x") for i in range(700)]
    rows += [(1000, None, 0, ""), (1020, [0.0] * 16, 0, ""), (1040, [float("nan")] * 16, 0, ""), (1060, [None] * 16, 0, ""), (1080, [1.0] * 3, 0, "")]
    got = ann.nearest(vectors(spark, rows).repartition(5), F.col("vec_id") % 20 == 0, 10).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    assert sorted(by) == list(range(0, 700, 20))
    hit = 0
    for q, found in by.items():
        found.sort(key=lambda r: r["rank"])
        exact = (m.astype(float) * m[q].astype(float)).sum(1)
        assert [r["rank"] for r in found] == list(range(1, 11)) and all(abs(r.score - exact[r.vec_id]) < 1e-12 for r in found)
        assert [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found)
        order = [i for i in np.lexsort((np.arange(700), -exact)) if i != q][:10]
        hit += len(set(order) & {r.vec_id for r in found})
    assert hit >= 0.9 * 350
    few = ann.nearest(vectors(spark, rows[:3]), F.col("vec_id") == 0, 10).collect()
    assert sorted(r.vec_id for r in few) == [1, 2]
    assert ann.nearest(vectors(spark, []), F.col("vec_id") == 0, 10).count() == 0


def test_neighbours_of_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(ann, "LEAF_ROWS", 1000)  # one leaf: all candidates are found
    rng = np.random.default_rng(6)
    m = rng.standard_normal((50, 8)).astype(np.float32)
    rows = [(i % 45, m[i].tolist(), 0, "") for i in range(50)]
    got = ann.nearest(vectors(spark, rows + rows[:20]), F.col("vec_id") % 20 == 0, 5).collect()
    queries = [i for i in range(50) if i % 45 % 20 == 0]
    want = []
    for q in queries:
        score = m.astype(float) @ m[q].astype(float)
        order = [i for i in np.lexsort((np.arange(50) % 45, -score)) if i % 45 != q % 45][:5]
        want += [(q % 45, r + 1, i % 45, round(float(score[i]), 9)) for r, i in enumerate(order)]
    assert sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in got) == sorted(want)


def test_leaves_grow_with_the_table():
    rng = np.random.default_rng(2)
    small, large = (ann.KMeansTree(rng.standard_normal((n, 8)), leaf=100, cell=1000) for n in (2000, 16000))
    assert 5 * small.leaves < large.leaves and small.cells < large.cells <= large.leaves
    assert set(large.cell_of) == set(range(large.cells))
