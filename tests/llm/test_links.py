"""All links of near duplicates, and sides without documents."""

import numpy as np

from fedspark.llm import jaccard

from .cases import documents


def test_every_link(spark):
    words = [f"w{k}" for k in range(60)]
    values = [" ".join(words[:-1] + [f"x{i}"]) for i in range(9)] + ["another text of other words entirely"]
    links = jaccard.near_duplicates(documents(spark, values), width=5, percent=80, every_link=True).collect()
    assert sorted((r.a, r.b) for r in links) == [(i, j) for i in range(9) for j in range(i + 1, 9)]


def test_an_empty_side_has_no_links():
    sets = [np.arange(20, dtype=np.uint64) + np.uint64(k) for k in range(8)]
    for side in (0, 1):
        assert jaccard.tree_links(sets, np.full(8, 20), np.full(8, side)) == []
    assert len(jaccard.tree_links(sets, np.full(8, 20), percent=60, every=True)) == sum(100 * (20 - d) >= 60 * (20 + d) for i in range(8) for d in range(1, 8 - i))
