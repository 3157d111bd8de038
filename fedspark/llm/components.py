"""Connected components of a graph whose edges stand in a DataFrame."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, written


def spanning_stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (smallest node, other node) that connect what the edges (a, b) connect."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    up = np.arange(len(nodes))
    while len(x):
        low = np.minimum(up[x], up[y])
        np.minimum.at(up, up[x], low)
        np.minimum.at(up, up[y], low)
        while not np.array_equal(up, up[up]):
            up = up[up]
        apart = up[x] != up[y]
        x, y = x[apart], y[apart]
    other = np.flatnonzero(up != np.arange(len(nodes)))
    return nodes[up[other]], nodes[other]


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for all nodes of edges (a, b), component being the smallest node that can be reached.

    Each round, a node takes the smallest component among its neighbours' and its own, then that component's own
    component; rounds are written, so lineage stays short, and go on until none changes; a round's table goes when the
    next one stands. Only a count comes to the driver.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        step = labels.join(near, "node").select("node", F.col("component").alias("before"), F.least("component", "near").alias("component"))
        up = labels.select(F.col("node").alias("component"), F.col("component").alias("above"))
        after = written(step.join(up, "component").select("node", "before", F.least("component", "above").alias("component")), "labels")
        forget(labels)
        if after.filter("before <> component").isEmpty():
            forget(both)
            return after.select("node", "component")
        labels = after.select("node", "component")
