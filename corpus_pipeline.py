"""The corpus pipeline: quality rules, near duplicates, personal data, packing. Part of the training-data operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fedspark.llm.common import forget, written
from fedspark.llm.jaccard import near_duplicates
from fedspark.llm.packing import pack
from fedspark.llm.pii import find_personal_data, mask
from fedspark.llm.quality import keep_good

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep. Each row goes or stays by its own text, whatever its doc_id; null and
    empty texts go, equal rows go or stay together, and an empty table gives an empty one."""
    return keep_good(docs.select(*COLUMNS))


def keep_first_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each component of near duplicates (five words, similarity 0.8).

    Texts of one doc_id, or of none, are documents apart; of rows with equal doc_id and text one stays, the first by lang,
    source and n_chars; a null doc_id comes after all others. Documents without words, null texts too, link to none and
    all stay. An empty table gives an empty one.
    """
    row = F.struct(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), F.coalesce("text", F.lit("")))
    keyed = docs.select(*COLUMNS, F.xxhash64(row).alias("_key"))
    near = written(near_duplicates(keyed.select(F.col("_key").alias("doc_id"), "text"), width=5, percent=80).filter("n_shingles > 0").select(F.col("doc_id").alias("_key"), "component_id").distinct(), "near")
    rank = F.struct(F.col("doc_id").isNull().alias("null"), F.col("doc_id"), F.col("_key"))
    first = near.join(keyed.select("_key", "doc_id"), "_key").groupBy("component_id").agg(F.min(rank).getField("_key").alias("_key"))
    worded = written(near.select("_key").join(first.select("_key", F.lit(True).alias("_first")), "_key", "left"), "worded")
    number = F.row_number().over(Window.partitionBy("_key").orderBy("lang", "source", "n_chars"))
    stay = keyed.join(worded.withColumn("_worded", F.lit(True)), "_key", "left").filter("_worded is null or _first")
    return stay.withColumn("_number", number).filter("_number = 1 or _worded is null").select(*COLUMNS)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each row's personal data replaced by its kind and n_chars counted anew; a null text stays null, with
    its n_chars. Equal rows stay equal; an empty table gives an empty one."""
    found = find_personal_data(docs.select(*COLUMNS, F.col("text").alias("_text")))
    masked = found.withColumn("text", mask(F.col("_text"), F.col("spans")))
    return masked.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), "n_chars")).select(*COLUMNS)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 4096 ids: a row for each. A null or empty text gives its end id alone; equal rows and
    rows of one doc_id are packed each; an empty table gives an empty one."""
    return pack(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", keep_quality),
    ("n-gram Jaccard join", keep_first_of_near_duplicates),
    ("PII", mask_personal_data),
    ("packing", pack_windows),
]

#: DuckDB has neither the tokenizer nor zstandard, so the pipeline is tested against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage")
        if before is not None:
            forget(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
