"""Narrow tables whose rows become pages: dealt out whatever the file's splits and keys."""

from pyspark.sql import functions as F

from pagegrid.plans import derived as D


def _sizes(rows):
    return sorted(r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect())


def test_one_split_becomes_many_tasks_even_with_null_keys(spark, tmp_path):
    key = F.when(F.col("id") % 2 == 0, F.col("id"))
    orders = spark.range(4000).select(
        key.alias("o_orderkey"),
        (F.col("id") % 97).alias("o_custkey"),
        F.expr("date_add(DATE'1995-01-01', cast(id % 700 as int))").alias("o_orderdate"),
        (F.col("id") * 1.5).alias("o_totalprice"),
        F.lit("O").alias("o_orderstatus"),
    )
    orders.coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    parts = spark.range(4000).select(key.alias("p_partkey"), (F.col("id") % 50).alias("p_size"))
    parts.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    turns = spark.range(4000).select(
        key.alias("conv_id"), (F.col("id") % 3).alias("turn"), F.col("id").cast("string").alias("text")
    )
    turns.coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    assert spark.read.parquet(f"{tmp_path}/orders.parquet").rdd.getNumPartitions() == 1
    for source in (D.invoice_pages, D.scattered_pages, D.turn_pairs):
        rows = source(spark, str(tmp_path))
        sizes = _sizes(rows)
        assert len(sizes) >= 8 and sum(sizes) == 4000, source.__name__
        assert sizes[-1] < 1000, source.__name__
    assert len(_sizes(D.baselines(spark, str(tmp_path)))) >= 8
    assert len(_sizes(D.page_features(spark, str(tmp_path)))) >= 8
