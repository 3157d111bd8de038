"""Sharding by proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import spread, table, written

#: Hash buckets that rank a source's rows; each source is dealt over as many, so a hot one is spread as well.
ROWS_PER_BUCKET = 20_000
#: Buckets whose counts are summed up in one window.
RUN = 1024


def _ranked(rows: DataFrame, keys: list[str], bucket: str, order: list, name: str) -> DataFrame:
    """0-based ranks within keys, by bucket and then order: a window for each bucket, and the rows of earlier buckets before it."""
    counts = rows.groupBy(*keys, bucket).agg(F.count(F.lit(1)).alias("_in"))
    before = counts.withColumn("_before", F.sum("_in").over(Window.partitionBy(*keys).orderBy(bucket)) - F.col("_in")) if keys else _running(counts, bucket)
    before = before.select(*(F.col(k).alias(f"_of_{k}") for k in [*keys, bucket]), "_before")
    same = F.col(bucket) == F.col(f"_of_{bucket}")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    joined = rows.join(before, same).select(*rows.columns, "_before")
    inner = F.row_number().over(Window.partitionBy(*keys, bucket).orderBy(*order))
    return joined.withColumn(name, F.col("_before") + inner - 1).drop("_before")


def _running(counts: DataFrame, bucket: str) -> DataFrame:
    """Rows in earlier buckets: those of its run of RUN buckets, and those of earlier runs, of which there is one row each."""
    runs = counts.withColumn("_run", F.floor(F.col(bucket) / RUN))
    totals = runs.groupBy("_run").agg(F.sum("_in").alias("_all"))
    first = totals.select("_run", (F.sum("_all").over(Window.orderBy("_run")) - F.col("_all")).alias("_first"))
    inner = runs.withColumn("_inner", F.sum("_in").over(Window.partitionBy("_run").orderBy(bucket)) - F.col("_in"))
    return inner.join(first, "_run").select(bucket, (F.col("_first") + F.col("_inner")).alias("_before"))


def interleave(docs: DataFrame, shards: int = 8, seed: int = 42) -> DataFrame:
    """Deals the rows of docs (doc_id, text, source) to shards so that every shard holds the sources in the table's mixture.

    Rows are ranked within their source by a seeded hash; (rank - 0.5) / rows of the source orders all of them, and that
    order is cut into shards whose counts differ by one at most. Returns doc_id, source, size (UTF-8 bytes of the text
    and 1; a null text has 0 bytes), text_crc32, shard and slot, gapless from 0 in each shard. Texts aren't shuffled.
    A null source is a source of its own; equal rows get places of their own; rows with one doc_id differ by their
    checksum and size; an empty table gives an empty one; other columns aren't read.
    """
    spark = docs.sparkSession
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    rows = written(
        docs.select(
            docs["doc_id"].cast("long").alias("doc_id"),
            docs["source"].cast("string").alias("source"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(F.lit(seed), docs["doc_id"].cast("long")).alias("_hash"),
        ),
        "shard-rows",
    )
    sources = rows.groupBy(F.col("source").alias("_source")).agg(F.count(F.lit(1)).alias("_of"))
    n = rows.count()
    buckets = spread(spark, n, ROWS_PER_BUCKET) * 4
    rows = rows.withColumn("_bucket", F.floor((F.shiftrightunsigned("_hash", 33) / F.lit(float(1 << 31))) * buckets).cast("long"))
    order = [F.shiftrightunsigned("_hash", 33), F.col("_hash"), F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    ranked = _ranked(rows, ["source"], "_bucket", order, "_rank")
    ranked = ranked.join(sources, F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "_bucket")
    ranked = ranked.withColumn("_share", (F.col("_rank") + 0.5) / F.col("_of"))
    ranked = ranked.withColumn("_bucket", F.least(F.floor(F.col("_share") * buckets), F.lit(buckets - 1)).cast("long"))
    placed = _ranked(ranked, [], "_bucket", [F.col("_share"), F.col("source"), F.col("_hash"), F.col("doc_id"), F.col("text_crc32"), F.col("size")], "_place")
    shard = F.floor(F.col("_place") * shards / F.lit(max(n, 1)))
    # exact for places below 2^53 / shards: the division is done again in whole numbers
    shard = F.when(F.col("_place") * shards >= (shard + 1) * n, shard + 1).when(F.col("_place") * shards < shard * n, shard - 1).otherwise(shard)
    first = F.expr(f"(_shard * {n} + {shards - 1}) div {shards}")
    return placed.withColumn("_shard", shard.cast("long")).select(
        "doc_id", "source", "size", "text_crc32", F.col("_shard").cast("int").alias("shard"), (F.col("_place") - first).cast("long").alias("slot")
    )


def op1_sharding(spark, sf_dir):
    return interleave(table(spark, sf_dir, "documents"), 8).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source"
    )
