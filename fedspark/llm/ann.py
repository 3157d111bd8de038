"""Approximate nearest neighbours: a hierarchical k-means tree, best-bin-first search and calibrated leaf visits."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, table, written

#: The tree is fitted on so many vectors at most, those of the smallest hashes; all vectors are indexed.
SAMPLE = 100_000
#: Leaves hold LEAF_ROWS of all vectors at most, and an eighth of that or more in the mean, so their number grows with the
#: table, as far as LEAF_SAMPLE vectors of the sample fall to each.
BRANCHES, LEAF_ROWS, LEAF_SAMPLE = 8, 800, 16
#: Queries on which the number of leaf visits is calibrated against brute force over all vectors.
CALIBRATION, RECALL = 128, 0.95
#: A cell is a subtree whose vectors take about CELL_BYTES; a query is sent to it once, with the leaves it visits there, and
#: takes its best of them all at once. Vectors of a cell of so many bytes, and QUERY_BLOCK queries that visit it, meet in one task.
CELL_BYTES, QUERY_BLOCK = 32 << 20, 8192
#: Inner products that are held at a time.
PRODUCTS_AT_ONCE = 8_000_000

FOUND = "query long, query_id long, vec_id long, score double"


class KMeansTree:
    """Inner nodes hold their children's centres; leaves are numbered, and each belongs to a cell: the largest subtree around
    it with at most `cell` vectors of the sample."""

    def __init__(self, sample: np.ndarray, branches: int = BRANCHES, leaf: int = LEAF_SAMPLE, cell: int = 4096, seed: int = 1):
        self.centres: list[np.ndarray] = []
        self.children: list[list[int]] = []  # a leaf is ~number
        self.cell_of: list[int] = []
        self.cells = 0
        self._grow(sample, branches, leaf, cell, None, np.random.default_rng(seed))
        self.leaves = len(self.cell_of)

    def _grow(self, points: np.ndarray, branches: int, leaf: int, cell: int, own_cell: int | None, rng) -> int:
        if own_cell is None and len(points) <= cell:
            own_cell, self.cells = self.cells, self.cells + 1
        if len(points) <= leaf or len(distinct := np.unique(points, axis=0)) <= branches:
            return self._leaf(own_cell)
        centres = distinct[rng.choice(len(distinct), branches, replace=False)]
        for _ in range(8):
            own = nearest_centre(points, centres)
            centres = np.stack([points[own == k].mean(0) if (own == k).any() else points[rng.integers(len(points))] for k in range(branches)])
        own = nearest_centre(points, centres)
        if (np.bincount(own, minlength=branches) == len(points)).any():
            return self._leaf(own_cell)
        node = len(self.centres)
        self.centres.append(centres)
        self.children.append([])
        self.children[node] = [self._grow(points[own == k], branches, leaf, cell, own_cell, rng) for k in range(branches)]
        return node

    def _leaf(self, cell: int | None) -> int:
        if cell is None:
            cell, self.cells = self.cells, self.cells + 1
        self.cell_of.append(cell)
        return ~(len(self.cell_of) - 1)

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int64)
        stack = [(0, np.arange(len(points)))] if self.centres else []
        while stack:
            node, rows = stack.pop()
            own = nearest_centre(points[rows], self.centres[node])
            for k, child in enumerate(self.children[node]):
                some = rows[own == k]
                if len(some) and child >= 0:
                    stack.append((child, some))
                else:
                    out[some] = ~child
        return out

    def visits(self, query: np.ndarray, most: int) -> list[int]:
        """Leaves in best-bin-first order: a priority queue of nodes by the inner product of the query and their centres."""
        if not self.centres:
            return [0]
        out: list[int] = []
        queue = [(0.0, 0, 0)]
        pushed = 1
        while queue and len(out) < most:
            _, _, node = heapq.heappop(queue)
            if node < 0:
                out.append(~node)
                continue
            for score, child in zip((self.centres[node] @ query).tolist(), self.children[node]):
                heapq.heappush(queue, (-score, pushed, child))
                pushed += 1
        return out


def nearest_centre(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (points @ centres.T - (centres**2).sum(1) / 2).argmax(1)


def exact_top(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int, names: np.ndarray | None = None, asked=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of the query, id, inner product) of each query's k best, ties to smaller ids, the query's own id left out; names
    are given instead of ids, if there are any. asked(a, b), if given, tells for the queries from a to b which vectors each asks for.

    Products are summed alike for equal vectors, so that copies tie; a blocked product only picks what to compute so.
    """
    out = []
    step = max(1, PRODUCTS_AT_ONCE // max(len(ids), 1))
    for at in range(0, len(queries), step):
        q = queries[at : at + step]
        rough = q @ vectors.T
        rough[query_ids[at : at + step][:, None] == ids] = -np.inf
        if asked is not None:
            rough[~asked(at, at + len(q))] = -np.inf
        n = min(k, rough.shape[1])
        bar = np.partition(rough, rough.shape[1] - n, axis=1)[:, rough.shape[1] - n]
        scale = 1e-12 * (np.abs(q).max() * np.abs(vectors).max() * q.shape[1] + 1e-300)
        r, c = np.nonzero((rough >= bar[:, None] - scale) & (rough > -np.inf))
        score = np.empty(len(r))
        for x in range(0, len(r), 200_000):
            score[x : x + 200_000] = (q[r[x : x + 200_000]] * vectors[c[x : x + 200_000]]).sum(1)
        order = np.lexsort((ids[c], -score, r))
        r, c, score = r[order], c[order], score[order]
        rank = np.arange(len(r)) - np.searchsorted(r, r)
        out.append((r[rank < k] + at, (ids if names is None else names)[c][rank < k], score[rank < k]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0) if column.num_chunks else pa.array([], pa.list_(pa.float64()))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.empty((0, 0))


def _index(tree: KMeansTree):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell_of = np.array(tree.cell_of)
        for batch in batches:
            if len(batch):
                leaf = tree.leaf_of(_matrix(batch.column("vector")))
                yield batch.append_column("leaf", pa.array(leaf)).append_column("cell", pa.array(cell_of[leaf]))

    return run


def _visit(tree: KMeansTree, most: int):
    """A row for each cell in which a query visits leaves, with those leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell_of = np.array(tree.cell_of)
        for batch in batches:
            if len(batch):
                row, cells, leaves = [], [], []
                for k, q in enumerate(_matrix(batch.column("vector"))):
                    found = np.array(tree.visits(q, most))
                    for cell in np.unique(cell_of[found]).tolist():
                        row.append(k)
                        cells.append(cell)
                        leaves.append(found[cell_of[found] == cell])
                rows = batch.take(pa.array(row))
                yield rows.append_column("cell", pa.array(cells, pa.int64())).append_column("leaves", pa.array(leaves, pa.list_(pa.int64())))

    return run


def _search(k: int):
    """A block of a cell's vectors against the queries that visit it: a query's k best in the leaves it visits."""

    def run(key, queries: pa.Table, vectors: pa.Table) -> pa.Table:
        if not len(queries) or not len(vectors):
            return pa.table({name: pa.array([], pa.float64() if name == "score" else pa.int64()) for name in ("query", "query_id", "vec_id", "score")})
        ids = queries.column("query_id").to_numpy()
        lists = queries.column("leaves").combine_chunks()
        lists = lists if isinstance(lists, pa.Array) else lists.chunk(0)
        leaves, place = np.unique(vectors.column("leaf").to_numpy(), return_inverse=True)
        wanted, asker = lists.flatten().to_numpy(), np.repeat(np.arange(len(ids)), np.diff(lists.offsets.to_numpy()))
        here = np.isin(wanted, leaves)
        visited = np.zeros((len(ids), len(leaves)), bool)
        visited[asker[here], np.searchsorted(leaves, wanted[here])] = True
        row, near, score = exact_top(_matrix(queries.column("vector")), ids, _matrix(vectors.column("vector")), vectors.column("vec_id").to_numpy(), k, asked=lambda a, b: visited[a:b][:, place])
        return pa.table({"query": queries.column("query").to_numpy()[row], "query_id": ids[row], "vec_id": near, "score": score})

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query", "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def clean_vectors(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, vector) in double precision, without null, empty and zero vectors and those that hold null, NaN or infinity."""
    v = F.transform(F.col(column), lambda x: x.cast("double"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), v.alias("vector"))
    return rows.filter("vec_id is not null and vector is not null").filter((F.size("vector") > 0) & ~F.exists("vector", bad) & F.exists("vector", lambda x: x != 0))


def nearest(vectors: DataFrame, is_query, k: int = 20, column: str = "embedding", recall: float = RECALL, sample: int = SAMPLE) -> DataFrame:
    """The k vectors of largest inner product for each row of vectors (vec_id, embedding) where is_query holds.

    A k-means tree is fitted on at most `sample` vectors, with leaves of at most LEAF_ROWS of all vectors; every vector is put
    into its leaf. A query visits leaves best bin first, and is sent once to each cell, a subtree, in which it visits any. A
    cell's vectors are cut into blocks of about CELL_BYTES and the queries that visit it into parts of
    QUERY_BLOCK at most, and into more while there are fewer tasks than cores, so that a cell of many copies, or one that many queries visit, is shared among tasks. On CALIBRATION queries, compared
    with brute force over all rows, the visits are widened until `recall` of the true neighbours lie in visited leaves;
    all queries then visit as many. Scores are exact, on the given vectors. Returns query_id, rank, vec_id and score,
    ties to the smaller vec_id. Null, empty and zero vectors and those with null or non-finite components take no
    part, nor do those of another length than most; a row never finds its own vec_id; rows equal in vec_id and vector count
    once, and those of one vec_id with other vectors are candidates, and queries, each; fewer candidates than k are all
    given; an empty table gives an empty one; other columns aren't read.
    """
    spark = vectors.sparkSession
    rows = clean_vectors(vectors, column).withColumn("_length", F.size("vector"))
    lengths = rows.groupBy("_length").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "_length").first()
    if lengths is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.filter(F.col("_length") == lengths["_length"]).drop("_length").withColumn("row", F.xxhash64("vec_id", "vector"))
    rows = written(rows.dropDuplicates(["vec_id", "row"]), "vectors")
    n = rows.count()
    fit = rows.orderBy(F.xxhash64(F.lit(7), "row"), "row").limit(sample).select("vector").toArrow()
    share, block = len(fit) / n, max(1, CELL_BYTES // (8 * lengths["_length"]))
    tree = KMeansTree(_matrix(fit.column("vector")), leaf=max(LEAF_SAMPLE, round(LEAF_ROWS * share)), cell=max(LEAF_SAMPLE, round(block * share)))
    indexed = written(rows.mapInArrow(_index(tree), "vec_id long, vector array<double>, row long, leaf long, cell long"), "indexed")
    forget(rows)
    queries = written(indexed.filter(is_query).select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"), "vector"), "queries")

    # brute force for the trial queries: every block of vectors meets all of them, which are few
    given = queries.orderBy(F.xxhash64(F.lit(11), "query"), "query", "query_id").limit(CALIBRATION).toArrow()
    trial, trial_ids, trial_vectors = given.column("query").to_numpy(), given.column("query_id").to_numpy(), _matrix(given.column("vector"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch) and len(trial_ids):
                leaves = batch.column("leaf").to_numpy()
                row, at, score = exact_top(trial_vectors, trial_ids, _matrix(batch.column("vector")), batch.column("vec_id").to_numpy(), k, np.arange(len(batch)))
                yield pa.RecordBatch.from_arrays([pa.array(trial[row]), pa.array(leaves[at]), pa.array(batch.column("vec_id").to_numpy()[at]), pa.array(score)], names=["query", "query_id", "vec_id", "score"])

    lies = _best(indexed.mapInArrow(scan, FOUND), k).select("query", F.col("query_id").alias("leaf")).collect()  # CALIBRATION * k rows at most
    place = {q: {leaf: i for i, leaf in enumerate(tree.visits(v, tree.leaves))} for q, v in zip(trial.tolist(), trial_vectors)}
    needed = sorted(place[r["query"]][r["leaf"]] + 1 for r in lies)
    most = needed[math.ceil(recall * len(needed)) - 1] if needed else tree.leaves

    visits = written(queries.mapInArrow(_visit(tree, most), "query long, query_id long, vector array<double>, cell long, leaves array<long>"), "visits")
    # a row for each cell, whose number the sample bounds
    blocks = indexed.groupBy("cell").agg((F.floor(F.count(F.lit(1)) / block) + 1).cast("int").alias("blocks"))
    least = -(-spark.sparkContext.defaultParallelism // tree.cells)
    parts = visits.groupBy("cell").agg(F.greatest(F.floor(F.count(F.lit(1)) / QUERY_BLOCK) + 1, F.lit(least)).cast("int").alias("parts"))
    cells = F.broadcast(blocks.join(parts, "cell"))
    of = lambda name, by: F.pmod(F.xxhash64(name), F.col(by).cast("long")).cast("int")
    each = lambda by: F.explode(F.sequence(F.lit(0), F.col(by) - 1))
    asked = visits.join(cells, "cell").select("query", "query_id", "vector", "leaves", "cell", of("query", "parts").alias("part"), each("blocks").alias("block"))
    held = indexed.join(cells, "cell").select("vec_id", "vector", "leaf", "cell", of("row", "blocks").alias("block"), each("parts").alias("part"))
    keys = ["cell", "block", "part"]
    found = asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(_search(k), FOUND)
    return _best(found, k).drop("query")


def op3_neighbours(spark, sf_dir):
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)
