"""Tables of samples and the views of them that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str, classes: int | None = None) -> DataFrame:
    """Samples (id, subject, features, label) from the embeddings: an embedding stands for a flattened image, and three in a row for a subject's."""
    rows = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.expr("vec_id div 3").alias("subject"), F.transform("embedding", lambda x: x.cast("double")).alias("features"), "label"
    )
    return rows if classes is None else rows.filter(F.col("label") < classes)


def pixels(rows: DataFrame) -> DataFrame:
    """Samples as a long table (id, label, j, v)."""
    return rows.select("id", "label", F.posexplode("features").alias("j", "v"))


def spread(rows: DataFrame) -> DataFrame:
    """rows in as many partitions as there are cores, where a scan gives fewer: for work that makes much of each row."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)
