"""Splits and non-IID partitions. Shuffles are orders of hashes, so results don't depend on how rows are stored."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import hash_rank


def split_by_cuts(rows: DataFrame, cuts: list[tuple[str, float]], rest: str, seed: int | str = 42, key: str = "id", sizes: bool = False) -> DataFrame:
    """Adds `split`: the first floor(f1 n) rows of the shuffle, then those up to floor(f2 n), ..., then the rest.

    With sizes, the fractions are sizes of their own and not cumulative: int(f1 n) rows, then int(f2 n) rows.
    """
    n = rows.select(key).count()
    at, column, ends = 0, F.lit(rest), []
    for name, share in cuts:
        at = at + int(share * n) if sizes else int(share * n)
        ends.append((name, at))
    for name, end in reversed(ends):
        column = F.when(F.col("rn") <= end, name).otherwise(column)
    return hash_rank(rows, seed, key=key).withColumn("split", column).drop("rn")


def split_by_subject(rows: DataFrame, train: float = 0.8, seed: int | str = 42) -> DataFrame:
    """All samples of a subject on one side."""
    subjects = split_by_cuts(rows.select("subject").distinct(), [("train", train)], "test", seed, key="subject")
    return rows.join(subjects, "subject")


def dirichlet_proportions(classes: int, clients: int, alpha: float, seed: int = 42, least: float = 0.01) -> list[list[float]]:
    """Each class's cumulative shares of the clients, none under `least` before they are scaled to 1."""
    rng = np.random.RandomState(seed)
    out = []
    for _ in range(classes):
        p = np.maximum(rng.dirichlet([alpha] * clients), least)
        out.append(np.cumsum(p / p.sum()).tolist())
    return out


def dirichlet_partition(rows: DataFrame, classes: int, clients: int = 4, alpha: float = 0.5, seed: int = 42) -> DataFrame:
    """Adds `client`. Each class's shuffle is cut at floor(cumulative share * its rows); the last client takes the rest."""
    dealt = deal_by_cuts(rows, classes, [(alpha, clients)], seed)
    return dealt.drop("alpha", "clients")


def _ranked_ways(rows: DataFrame, classes: int, ways: list[tuple[float, int]], seed: int) -> DataFrame:
    """Rows with their rank within their label and `_ways`: for each way, in order, its number, alpha, clients and the ranks
    at which clients end. Labels outside 0 to classes - 1, and null ones, have no cuts."""
    spark = rows.sparkSession
    shares = [(i, a, k, c, [float(x) for x in row[:-1]]) for i, (a, k) in enumerate(ways) for c, row in enumerate(dirichlet_proportions(classes, k, a, seed))]
    cuts = spark.createDataFrame(shares, "i int, alpha double, clients int, _label int, shares array<double>")
    n = rows.groupBy(F.col("label").alias("_label")).agg(F.count(F.lit(1)).alias("_n"))
    cuts = n.join(cuts, "_label").withColumn("_cuts", F.transform("shares", lambda s: F.floor(s * F.col("_n"))))
    by_label = F.broadcast(cuts.groupBy("_label").agg(F.array_sort(F.collect_list(F.struct("i", "alpha", "clients", "_cuts"))).alias("_ways")))  # a row for each class
    none = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(a).alias("alpha"), F.lit(k).alias("clients"), F.expr("cast(array() as array<bigint>)").alias("_cuts")) for i, (a, k) in enumerate(ways)))
    ranked = hash_rank(rows, seed, keys=("label",)).join(by_label, F.col("label") == F.col("_label"), "left")
    return ranked.select(*rows.columns, "rn", F.coalesce("_ways", none).alias("_ways"))


def deal_by_cuts(rows: DataFrame, classes: int, ways: list[tuple[float, int]], seed: int = 42) -> DataFrame:
    """Rows with alpha, clients and client for each way (alpha, clients) of dealing them out; the rows are ranked once.

    Labels outside 0 to classes - 1, and null ones, have no shares: they go to client 0.
    """
    each = _ranked_ways(rows, classes, ways, seed).select(*rows.columns, "rn", F.explode("_ways").alias("_way")).select(*rows.columns, "rn", "_way.*")
    return each.withColumn("client", F.size(F.filter("_cuts", lambda c: F.col("rn") > c)).cast("int")).drop("rn", "_cuts", "i")


def deal_many(rows: DataFrame, classes: int, ways: list[tuple[float, int]], seed: int = 42, name: str = "dealt") -> DataFrame:
    """Rows with the array `name` of their client by each way (alpha, clients); otherwise as deal_by_cuts()."""
    client = lambda way: F.size(F.filter(way["_cuts"], lambda c: F.col("rn") > c)).cast("int")
    return _ranked_ways(rows, classes, ways, seed).withColumn(name, F.transform("_ways", client)).drop("rn", "_ways")


def partition_stats(assigned: DataFrame, classes: list[int], total_row: bool = False) -> DataFrame:
    """Rows of each class on each client, all of them, and their percentage of all rows to one decimal; with a grand total."""
    counts = [F.sum(F.when(F.col("label") == c, 1).otherwise(0)).alias(f"class_{c}") for c in classes]
    grouped = (assigned.rollup("client") if total_row else assigned.groupBy("client")).agg(*counts, F.count(F.lit(1)).alias("total"))
    n = assigned.agg(F.count(F.lit(1)).alias("_all"))
    return grouped.crossJoin(F.broadcast(n)).withColumn("percentage", F.round(F.col("total") * 100.0 / F.col("_all"), 1)).drop("_all")


def client_class_pct(assigned: DataFrame, guard: float = 1e-8) -> DataFrame:
    """Each class's share of its client's rows in percent; the guard keeps an empty client at 0."""
    counts = assigned.groupBy("client", "label").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("client").agg(F.sum("n").alias("_of"))
    return counts.join(totals, "client").select("client", "label", (F.col("n") * 100.0 / (F.col("_of") + guard)).alias("pct"))


def client_local_split(assigned: DataFrame, share: float = 0.1, seed: int | str = "local") -> DataFrame:
    """Adds `split` within each client: a tenth, one row at least, validates."""
    sizes = assigned.groupBy("client").agg(F.count(F.lit(1)).alias("_n"))
    ranked = hash_rank(assigned, seed, keys=("client",)).join(F.broadcast(sizes), "client")
    held = F.greatest(F.lit(1).cast("long"), F.floor(F.col("_n") * share))
    return ranked.withColumn("split", F.when(F.col("rn") <= held, "val").otherwise("train")).drop("rn", "_n")


def batches(rows: DataFrame, size: int = 32, seed: int | str = "batch") -> DataFrame:
    """Adds `batch`, shuffled; the last one is short."""
    return hash_rank(rows, seed).withColumn("batch", F.floor((F.col("rn") - 1) / size)).drop("rn")


def draw(rows: DataFrame, n: int, seed: int | str, without: DataFrame | None = None) -> DataFrame:
    """n rows without replacement, none of `without`: the smallest hashes, by a top-k that never sorts all rows."""
    from ..functions.hashing import hash_hex

    pool = rows if without is None else rows.join(without.select("id"), "id", "left_anti")
    return pool.orderBy(hash_hex(seed), "id").limit(n)
