"""Client folders, checkpoints and metric files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Ranges of ids in which rows are numbered apart.
BUCKETS = 64


def client_file_names(assigned: DataFrame, names: dict[int, str]) -> DataFrame:
    """Adds each row's file name in its client's folder: the class and a counter within client and class.

    The counter, by id, has four digits at least. Rows are numbered in ranges of ids, so that a client with most rows of a
    class isn't one task.
    """
    cuts = assigned.agg(F.percentile_approx("id", [k / BUCKETS for k in range(1, BUCKETS)], 1000)).first()[0] or []
    bucketed = assigned.withColumn("_bucket", sum((F.when(F.col("id") > c, 1).otherwise(0) for c in sorted(set(cuts))), F.lit(0)))
    totals = bucketed.groupBy("client", "label", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("client", "label").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("client").alias("_client"), F.col("label").alias("_label"), F.col("_bucket").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    same = F.col("client").eqNullSafe(F.col("_client")) & F.col("label").eqNullSafe(F.col("_label")) & (F.col("_bucket") == F.col("_of"))
    numbered = bucketed.join(offsets, same)
    counter = (F.col("_before") + F.row_number().over(Window.partitionBy("client", "label", "_bucket").orderBy("id")) - 1).cast("string")
    name = F.coalesce(F.create_map(*(x for k, v in names.items() for x in (F.lit(k), F.lit(v))))[F.col("label")], F.col("label").cast("string"))
    padded = F.when(F.length(counter) < 4, F.lpad(counter, 4, "0")).otherwise(counter)
    return numbered.withColumn("file_name", F.concat(name, F.lit("_"), padded)).select(*assigned.columns, "file_name")


def write_clients(assigned: DataFrame, path: str) -> None:
    assigned.write.mode("overwrite").partitionBy("client", "label").parquet(path)


def read_client(spark: SparkSession, path: str, client: int) -> DataFrame:
    """One client's rows; the other clients' folders aren't read."""
    return spark.read.parquet(path).filter(F.col("client") == client)


def save_params(params: DataFrame, path: str) -> None:
    params.write.mode("overwrite").parquet(path)


def load_params(spark: SparkSession, path: str) -> DataFrame:
    """Parameters (c, j, w); a table that holds them in one column `params` of structs is taken as well."""
    found = spark.read.parquet(path)
    return found.select("params.*") if "params" in found.columns else found


def metrics_to_json(metrics: DataFrame) -> DataFrame:
    return metrics.select(F.to_json(F.struct("*")).alias("json"))


def scratch_folder(spark: SparkSession) -> str:
    """A new folder's path below the one that the cluster names for checkpoints; where none is named, a temporary one if the session is local."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        shared = f"file://{tempfile.mkdtemp(prefix='fedspark-')}"
        spark.conf.set("spark.checkpoint.dir", shared)
    return f"{shared.rstrip('/')}/files-{uuid.uuid4().hex}"


def written(rows: DataFrame, by: str | None = None) -> DataFrame:
    """rows as a table in the shared folder, in as few files as their size allows, so that steps don't compute them again.
    Clustered by a column, a filter on it reads its own files and row groups alone."""
    folder = scratch_folder(rows.sparkSession)
    (rows.repartitionByRange(by).sortWithinPartitions(by) if by else rows.hint("rebalance")).write.parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


def remove(rows: DataFrame) -> None:
    """Deletes the table of written() that rows reads; nothing may read it afterwards."""
    jvm, conf = rows.sparkSession._jvm, rows.sparkSession._jsc.hadoopConfiguration()
    for folder in {file.rpartition("/")[0] for file in rows.inputFiles()}:
        where = jvm.org.apache.hadoop.fs.Path(folder)
        where.getFileSystem(conf).delete(where, True)


def write_metrics(metrics: DataFrame, folder: str) -> None:
    """A JSON file for each experiment (a column of metrics), in a folder of its name."""
    metrics.repartition("experiment").write.mode("append").partitionBy("experiment").json(folder)


def read_metrics(spark: SparkSession, folder: str, schema: str, names: str = "*") -> DataFrame:
    """Metric files of the experiments whose names fit the pattern, with those names; missing figures are 0."""
    found = spark.read.schema(schema).json(f"{folder}/experiment={names}")
    return found.na.fill(0.0).withColumn("experiment", F.regexp_extract(F.input_file_name(), r"experiment=([^/]+)/", 1))


def write_csv(rows: DataFrame, folder: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(folder)


def read_csv(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(folder)


def read_history(spark: SparkSession, path: str, series: list[str]) -> DataFrame:
    """Histories of parallel arrays as a row for each step."""
    found = spark.read.schema(", ".join(f"{x} array<double>" for x in series)).json(path)
    return found.select(F.posexplode(F.arrays_zip(*series)).alias("step", "x")).select("step", "x.*")
