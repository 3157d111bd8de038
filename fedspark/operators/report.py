"""Compiling experiments: metric tables, sweeps, formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Experiments by name (setting, model, alpha, clients, rounds, local epochs), one variable at a time around a base configuration.
ABLATIONS = (
    ("A1_no_dp", "federated", "resnet50", 0.5, 4, 15, 5),
    ("A2_with_dp", "private", "resnet50", 0.5, 1, 1, 15),
    ("A4_resnet50", "central", "resnet50", 0.5, 1, 1, 15),
    ("A4_vgg19", "central", "vgg19", 0.5, 1, 1, 15),
    ("A5_alpha0.1", "federated", "resnet50", 0.1, 4, 8, 5),
    ("A5_alpha0.5", "federated", "resnet50", 0.5, 4, 8, 5),
    ("A5_alpha1.0", "federated", "resnet50", 1.0, 4, 8, 5),
    ("A5_alpha100.0", "federated", "resnet50", 100.0, 4, 8, 5),
    ("A6_K2", "federated", "resnet50", 0.5, 2, 8, 5),
    ("A6_K4", "federated", "resnet50", 0.5, 4, 8, 5),
    ("A6_K6", "federated", "resnet50", 0.5, 6, 8, 5),
    ("A7_E1", "federated", "resnet50", 0.5, 4, 8, 1),
    ("A7_E3", "federated", "resnet50", 0.5, 4, 8, 3),
    ("A7_E5", "federated", "resnet50", 0.5, 4, 8, 5),
)


def strip_extension(name: Column) -> Column:
    """A file's name without its folder and without what follows its first dot."""
    return F.regexp_extract(name, r"([^/.]*)[^/]*$", 1)


def strip_wrapper(key: Column) -> Column:
    """A parameter's name without the prefix that a wrapping module gives it."""
    return F.regexp_replace(key, r"_module\.", "")


def percent(value: Column) -> Column:
    return F.format_string("%.1f%%", F.round(value * 100, 1))


def parse_key(key: Column) -> list[Column]:
    """The family of an experiment's key, its variable and its value; an alpha of 100 or more is IID."""
    value = F.regexp_extract(key, r"(?:K|E|alpha)([0-9.]+)$", 1)
    shown = F.when(key.contains("alpha") & (value != "") & (F.coalesce(value.try_cast("double"), F.lit(0.0)) >= 100), F.lit("IID")).otherwise(value)
    return [F.substring_index(key, "_", 1).alias("family"), F.regexp_extract(key, r"_(K|E|alpha)[0-9.]+$", 1).alias("variable"), shown.alias("value")]


def numeric_order(key: Column) -> Column:
    """Sort key of stringified numbers: infinity stands last."""
    return F.when(key == "inf", 999.0).otherwise(key.try_cast("double"))


def compile_metrics(rows: DataFrame, schema: str, column: str = "props") -> DataFrame:
    """Figures out of a JSON column by a schema of doubles; those that are missing are 0."""
    parsed = rows.withColumn("_m", F.from_json(column, schema))
    names = [x.split()[0] for x in schema.split(", ")]
    return parsed.select(*rows.columns, *(F.coalesce(F.col(f"_m.{n}"), F.lit(0.0)).alias(n) for n in names))


def unpivot_metrics(rows: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    return rows.unpivot(key, metrics, "metric", "value")


def ablation_table(results: DataFrame) -> DataFrame:
    """A sweep's rows as shown: figures in percent to one decimal, 0 where an experiment failed or lacks one."""
    of = lambda name: F.coalesce(F.try_element_at("metrics", F.lit(name)), F.lit(0.0))
    shown = lambda name: F.format_string("%.1f%%", F.round(of(name), 1))
    return results.select(
        "experiment", percent(of("accuracy")).alias("accuracy"), percent(of("f1_macro")).alias("f1"), percent(of("auroc_macro")).alias("auroc"), shown("mia_accuracy").alias("mia_accuracy"), shown("mia_advantage").alias("mia_advantage"), F.col("error").isNotNull().alias("failed")
    )
