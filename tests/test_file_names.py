"""File names beyond the sizes of the test tables."""

from pyspark.sql import functions as F

from fedspark.sources import files


def test_file_names_beyond_four_digits(spark):
    assigned = spark.range(10_050).select("id", F.lit(1).alias("client"), F.lit(0).alias("label")).union(spark.sql("select 7L, null, null union all select 7L, 2, 5 union all select 7L, 2, 5"))
    names = [(r.client, r.id, r.file_name) for r in files.client_file_names(assigned, {0: "CN"}).collect()]
    assert sorted(x[1:] for x in names if x[0] == 1) == [(k, f"CN_{k:04d}") for k in range(10_050)]
    assert sorted(x[2] for x in names if x[0] == 2) == ["5_0000", "5_0001"]
    assert len(names) == 10_053
