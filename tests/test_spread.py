"""Costly work on single rows is dealt to tasks by rows, however tightly the file packs them."""

from pyspark.sql import functions as F

from facetry.plans import catalogue
from facetry.session import spread


def test_rows_of_a_packed_file_go_to_several_tasks(spark, tmp_path):
    customers = spark.range(9000).select(
        F.col("id").alias("c_custkey"), (F.col("id") % 25).cast("int").alias("c_nationkey"), (F.col("id") / 7).alias("c_acctbal")
    )
    customers.coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    out = catalogue.QUERIES["transform_algebra"](spark, str(tmp_path))
    held = [r["count"] for r in out.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()]
    assert len(held) == 3 and max(held) <= 4000 and sum(held) == 9000


def test_a_small_table_is_left_alone(spark):
    few = spark.range(10).coalesce(1)
    assert spread(few) is few and spread(few, 3).count() == 10
