"""Sales indicators: the first slice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import is_credit_note, is_sale, out_of_revenue
from ..sources.catalog import order_lines


def a_aov(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average order value with its inputs: lines put together by order, then one aggregate over the orders."""
    o = order_lines(spark, sf_dir, cost=False)
    out = out_of_revenue(F.col("status"), F.col("unit_price"))
    credit = is_credit_note(F.col("quantity"), F.col("subtotal"))
    sale = is_sale(out, credit, F.col("subtotal"))
    by_order = o.groupBy("order_id").agg(
        F.sum(F.when(~out, F.col("subtotal"))).alias("order_revenue"),
        F.sum(F.when(sale, F.col("subtotal"))).alias("gross_sales"),
        F.sum(F.when(~out & credit, F.abs("subtotal"))).alias("returns_amount"),
        F.max(sale).alias("sale"),
    )
    one = by_order.agg(F.sum("order_revenue").alias("order_revenue"), F.sum("gross_sales").alias("gross_sales"), F.coalesce(F.sum("returns_amount"), F.lit(0.0)).alias("returns_amount"), F.count_if("sale").alias("order_count"))
    aov = (F.col("order_revenue") + F.col("returns_amount")) / F.nullif(F.col("order_count"), F.lit(0))
    return one.select(
        *(F.round(c, 2).alias(c) for c in ("order_revenue", "gross_sales", "returns_amount")),
        "order_count",
        F.round(aov, 2).alias("aov"),
        F.when(aov.isNull(), "NOT_MEASURED").when(aov == 0, "VALID_ZERO").otherwise("VALID").alias("status"),
    )


QUERIES = {"a_aov": a_aov}

ORACLE_SQL = {
    "a_aov": """
WITH o AS (
  SELECT l_orderkey AS order_id, l_quantity AS quantity, l_extendedprice / l_quantity AS unit_price,
         l_extendedprice * (1 - l_discount) AS subtotal, l_returnflag = 'R' AS returned
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
), f AS (
  SELECT *, returned OR unit_price < 0 AS out, quantity < 0 OR subtotal < 0 AS credit FROM o
), a AS (
  SELECT sum(subtotal) FILTER (NOT out) AS order_revenue,
         sum(subtotal) FILTER (NOT out AND NOT credit AND subtotal <> 0) AS gross_sales,
         coalesce(sum(abs(subtotal)) FILTER (NOT out AND credit), 0) AS returns_amount,
         count(DISTINCT CASE WHEN NOT out AND NOT credit AND subtotal <> 0 THEN order_id END) AS order_count
  FROM f
)
SELECT round(order_revenue, 2) AS order_revenue, round(gross_sales, 2) AS gross_sales, round(returns_amount, 2) AS returns_amount,
       order_count, round((order_revenue + returns_amount) / nullif(order_count, 0), 2) AS aov,
       CASE WHEN order_revenue IS NULL OR order_count = 0 THEN 'NOT_MEASURED' WHEN order_revenue + returns_amount = 0 THEN 'VALID_ZERO' ELSE 'VALID' END AS status
FROM a
"""
}
