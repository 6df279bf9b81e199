"""Order totals held against their lines: the severity of each difference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import query

#: Absolute tolerance, small difference, and the shares of the scale for info and warning.
TOLERANCE, SMALL, INFO_SHARE, WARN_SHARE = "0.02", "1.00", "0.005", "0.02"

TOTALS_SQL = """
WITH lines AS (
  SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(1 - l_discount AS DECIMAL(6,2))) AS subtotal,
         sum(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(1 - l_discount AS DECIMAL(6,2)) * CAST(l_tax AS DECIMAL(6,2))) AS tax
  FROM lineitem GROUP BY l_orderkey),
diff AS (
  SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,6)) AS stated, CAST(subtotal + tax AS DECIMAL(18,6)) AS expected
  FROM orders LEFT JOIN lines ON l_orderkey = o_orderkey)
SELECT severity, count(*) AS n_orders FROM (
  SELECT CASE WHEN expected IS NULL THEN 'no_lines'
              WHEN abs(stated - expected) <= 0.02 THEN 'none'
              WHEN abs(stated - expected) <= greatest(1.00, 0.005 * greatest(abs(stated), abs(expected), 1)) THEN 'info'
              WHEN abs(stated - expected) <= 0.02 * greatest(abs(stated), abs(expected), 1) THEN 'warning'
              ELSE 'error' END AS severity FROM diff) GROUP BY severity"""


def agreement(expected: Column, actual: Column) -> Column:
    """none, info, warning or error, by the size of the difference against the larger amount (1 at least)."""
    gap = F.abs(actual - expected)
    scale = F.greatest(F.abs(expected), F.abs(actual), F.lit(1).cast("decimal(18,6)"))
    dec = lambda x: F.lit(x).cast("decimal(6,3)")
    return (
        F.when(expected.isNull() | actual.isNull(), F.lit(None).cast("string"))
        .when(gap <= dec(TOLERANCE), "none")
        .when(gap <= F.greatest(dec(SMALL), dec(INFO_SHARE) * scale), "info")
        .when(gap <= dec(WARN_SHARE) * scale, "warning")
        .otherwise("error")
    )


def order_sums(lineitem: DataFrame) -> DataFrame:
    """(l_orderkey, subtotal, tax) in decimals."""
    price = F.col("l_extendedprice").cast("decimal(12,2)") * (1 - F.col("l_discount")).cast("decimal(6,2)")
    return lineitem.groupBy("l_orderkey").agg(F.sum(price).alias("subtotal"), F.sum(price * F.col("l_tax").cast("decimal(6,2)")).alias("tax"))


@query("val02_totals_severity", TOTALS_SQL)
def totals_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lines = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "lineitem"))
    joined = orders.join(order_sums(lines), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    expected = (F.col("subtotal") + F.col("tax")).cast("decimal(18,6)")
    graded = joined.select(F.coalesce(agreement(expected, F.col("o_totalprice").cast("decimal(18,6)")), F.lit("no_lines")).alias("severity"))
    return graded.groupBy("severity").agg(F.count("*").alias("n_orders"))
