from pyspark.sql import functions as F

from catalog import derived as D
from ticketveil.sources import spread_rows


def orders(spark, n):
    return spark.range(n).coalesce(1).selectExpr(
        "id AS o_orderkey", "id % 7 AS o_custkey", "'O' AS o_orderstatus", "cast(id AS double) AS o_totalprice",
        "timestamp_ntz'2024-01-01 00:00:00' AS o_orderdate", "'1-URGENT' AS o_orderpriority",
    )


def test_rows_are_dealt_evenly(spark):
    rows = orders(spark, 1050).union(orders(spark, 1050))  # twice the same rows
    dealt = spread_rows(rows, 100)
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 21 and max(sizes) <= 120
    assert dealt.exceptAll(rows).isEmpty() and dealt.count() == 2100


def test_few_rows_stay(spark):
    assert spread_rows(orders(spark, 100), 100).rdd.getNumPartitions() == 1
    assert spread_rows(orders(spark, 0), 100).count() == 0


def test_one_row_group_of_orders_becomes_many_tasks(spark, tmp_path):
    """A row group is read by one task, which then made all the texts."""
    orders(spark, 50_000).write.option("parquet.block.size", 1 << 30).parquet(f"{tmp_path}/orders.parquet")
    for made in (D.tickets, D.reports, D.files):
        assert made(spark, str(tmp_path)).rdd.getNumPartitions() == 3
