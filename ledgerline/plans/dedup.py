"""Deduplication, conflicts and incremental ingestion of business rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import catalog as cat
from .base import Part

part = Part()
c = F.col


def fingerprint(*fields: str) -> Column:
    """Digest of a business key; a null field differs from an empty one."""
    return F.sha2(F.concat_ws("|", *(F.coalesce(c(f).cast("string"), F.lit("\\N")) for f in fields)), 256)


def kth(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """k: the row is the k-th of its key, in a fixed order."""
    return df.withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))


def classify(df: DataFrame, key: list[str], content: list[str], order: list[str]) -> DataFrame:
    """status of each row: 'new' (first of its key), 'duplicate' (same key, content of the first), 'conflict' (other content).

    The first row of a key is found by one grouped minimum and joined back, so a frequent key is never sorted in one task.
    """
    row = F.struct(*order, *content)
    first = df.groupBy(*key).agg(F.min(row).alias("__first"))
    same = lambda cols: F.lit(True) if not cols else _all([c(x).eqNullSafe(c(f"__first.{x}")) for x in cols])
    status = F.when(same(order) & same(content), "new").when(same(content), "duplicate").otherwise("conflict")
    return df.join(first, key).withColumn("status", status).drop("__first")


def _all(cols: list[Column]) -> Column:
    out = cols[0]
    for x in cols[1:]:
        out = out & x
    return out


_LINES = "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_quantity, l_extendedprice) AS k, first_value((l_partkey, l_quantity)) OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_quantity, l_extendedprice) AS f FROM lineitem"


@part.query(f"WITH x AS ({_LINES}) SELECT CASE WHEN k = 1 THEN 'new' WHEN (l_partkey, l_quantity) = f THEN 'duplicate' ELSE 'conflict' END AS status, count(*) AS n FROM x GROUP BY 1")
def x_duplicates_and_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines by their line key: repeated keys with the first one's content, or with another."""
    li = cat.table(spark, sf_dir, "lineitem")
    ranked = kth(li, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_quantity", "l_extendedprice"])
    first = li.groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_quantity")).alias("f"))
    both = ranked.join(first, ["l_orderkey", "l_linenumber"])
    same = F.struct("l_partkey", "l_quantity") == c("f")
    return both.groupBy(F.when(c("k") == 1, "new").when(same, "duplicate").otherwise("conflict").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@part.query("""WITH i AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber, l_quantity) AS k FROM lineitem), s AS (SELECT l_orderkey, l_partkey, count(*) AS stored FROM lineitem WHERE l_orderkey % 2 = 0 AND l_linenumber <= 3 GROUP BY 1, 2)
SELECT k <= coalesce(stored, 0) AS is_duplicate, count(*) AS n FROM i LEFT JOIN s USING (l_orderkey, l_partkey) GROUP BY 1""")
def x_kth_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Re-import: the k-th occurrence of a key is a duplicate if k of them are stored already."""
    li = cat.table(spark, sf_dir, "lineitem")
    stored = li.filter("l_orderkey % 2 = 0 AND l_linenumber <= 3").groupBy("l_orderkey", "l_partkey").agg(F.count(F.lit(1)).alias("stored"))
    again = kth(li.select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity"), ["l_orderkey", "l_partkey"], ["l_linenumber", "l_quantity"])
    return again.join(stored, ["l_orderkey", "l_partkey"], "left").groupBy((c("k") <= F.coalesce("stored", F.lit(0))).alias("is_duplicate")).agg(F.count(F.lit(1)).alias("n"))


@part.query("SELECT sha256(concat_ws('|', coalesce(CAST(transaction_id AS VARCHAR), '\\N'), coalesce(CAST(date AS VARCHAR), '\\N'), coalesce(type, '\\N'))) AS fingerprint FROM transactions")
def x_business_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat.transactions(spark, sf_dir).select(fingerprint("transaction_id", "date", "type").alias("fingerprint"))


@part.query("SELECT CASE WHEN order_id % 10 = 0 THEN false ELSE true END AS is_strong, count(*) AS n FROM order_lines GROUP BY 1")
def x_strong_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that were made up for want of one ('AUTO-...') never prove a duplicate."""
    o = cat.order_lines(spark, sf_dir)
    key = F.when(c("order_id") % 10 == 0, F.concat(F.lit("AUTO-"), c("order_id").cast("string"))).otherwise(c("order_id").cast("string"))
    return o.groupBy((~key.startswith("AUTO-")).alias("is_strong")).agg(F.count(F.lit(1)).alias("n"))


@part.query("WITH g AS (SELECT order_id, product_id, count(DISTINCT (quantity, unit_price)) AS contents, count(*) AS n FROM order_lines GROUP BY 1, 2) SELECT contents > 1 AS refuted, count(*) AS keys, sum(n)::BIGINT AS n_rows FROM g GROUP BY 1")
def x_composite_key_refuted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order and product are a key only where the data never shows them with different content."""
    # two contents differ in one of their columns, so the ends of each tell; a null is a content of its own
    o = cat.order_lines(spark, sf_dir, cost=False)
    two = lambda x: (F.min(x) != F.max(x)) | (F.count(x) > 0) & (F.count(x) < F.count(F.lit(1)))
    g = o.groupBy("order_id", "product_id").agg((F.coalesce(two("quantity"), F.lit(False)) | F.coalesce(two("unit_price"), F.lit(False))).alias("refuted"), F.count(F.lit(1)).alias("n"))
    return g.groupBy("refuted").agg(F.count(F.lit(1)).alias("keys"), F.sum("n").alias("n_rows"))


@part.query("WITH h AS (SELECT order_id, count(DISTINCT customer_id) AS a, count(DISTINCT date) AS b FROM order_lines GROUP BY 1) SELECT count(*) FILTER (a > 1 OR b > 1) AS conflicting, count(*) AS n FROM h")
def x_order_header_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = cat.order_lines(spark, sf_dir).groupBy("order_id").agg(F.countDistinct("customer_id").alias("a"), F.countDistinct("date").alias("b"))
    return h.agg(F.count_if((c("a") > 1) | (c("b") > 1)).alias("conflicting"), F.count(F.lit(1)).alias("n"))


@part.query("SELECT md5(concat_ws('|', CAST(user_id AS VARCHAR), event_type)) AS h, count(*) AS n, min(event_id) AS first_id FROM events GROUP BY 1 HAVING count(*) > 1")
def x_internal_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal row hashes with their size and first row."""
    e = cat.table(spark, sf_dir, "events")
    return e.groupBy(F.md5(F.concat_ws("|", c("user_id").cast("string"), "event_type")).alias("h")).agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id")).filter("n > 1")


@part.query("WITH f AS (SELECT event_id % 8 AS file, min(CAST(ts AS DATE)) AS a, max(CAST(ts AS DATE)) AS b FROM events WHERE day(ts) BETWEEN (event_id % 8) * 3 AND (event_id % 8) * 3 + 6 GROUP BY 1) SELECT x.file AS file, y.file AS earlier, 0.7::DOUBLE AS likelihood FROM f x JOIN f y ON x.file > y.file AND x.a <= y.b AND y.a <= x.b")
def x_overlapping_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports whose periods overlap an earlier one's; one row an import, so a small inequality join."""
    e = cat.table(spark, sf_dir, "events").withColumn("file", c("event_id") % 8)
    f = e.filter(F.dayofmonth("ts").between(c("file") * 3, c("file") * 3 + 6)).groupBy("file").agg(F.min(F.to_date("ts")).alias("a"), F.max(F.to_date("ts")).alias("b"))
    y = f.select(c("file").alias("earlier"), c("a").alias("ya"), c("b").alias("yb"))
    return f.join(y, (c("file") > c("earlier")) & (c("a") <= c("yb")) & (c("ya") <= c("b"))).select("file", "earlier", F.lit(0.7).alias("likelihood"))


@part.query("SELECT count(*) AS n, count(DISTINCT (l_orderkey, l_linenumber)) AS keys, count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS duplicates FROM lineitem")
def x_quality_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = cat.table(spark, sf_dir, "lineitem")
    return li.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("l_orderkey", "l_linenumber").alias("keys")).withColumn("duplicates", c("n") - c("keys"))


@part.query("WITH d AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber, l_quantity, l_extendedprice) AS k FROM lineitem) SELECT count(*) AS kept, round(sum(l_quantity), 2) AS quantity FROM d WHERE NOT (k = 2 AND l_orderkey % 3 = 0)")
def x_resolved_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A decision takes the second copy of some keys out: an anti-join on (key, k)."""
    li = kth(cat.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_partkey"], ["l_linenumber", "l_quantity", "l_extendedprice"])
    decided = li.filter("k = 2 AND l_orderkey % 3 = 0").select("l_orderkey", "l_partkey", "k")
    return li.join(decided, ["l_orderkey", "l_partkey", "k"], "left_anti").agg(F.count(F.lit(1)).alias("kept"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@part.query("SELECT 'order' AS entity, 'revenue' AS canonical_key, date, round(sum(subtotal), 4) AS value FROM order_lines GROUP BY 3 UNION ALL SELECT 'transaction', type || '_amount', date, round(sum(amount), 4) FROM transactions GROUP BY 2, 3")
def x_measure_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heterogeneous entities as one long table of measures."""
    o = cat.order_lines(spark, sf_dir).groupBy("date").agg(F.round(F.sum("subtotal"), 4).alias("value")).select(F.lit("order").alias("entity"), F.lit("revenue").alias("canonical_key"), "date", "value")
    t = cat.transactions(spark, sf_dir).groupBy("type", "date").agg(F.round(F.sum("amount"), 4).alias("value")).select(F.lit("transaction").alias("entity"), F.concat("type", F.lit("_amount")).alias("canonical_key"), "date", "value")
    return o.unionByName(t)


@part.query("SELECT DISTINCT customer_id FROM order_lines WHERE date < DATE '2001-01-01' EXCEPT SELECT customer_id FROM order_lines WHERE date >= DATE '2001-01-01'")
def x_lapsed_buyers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buyers of earlier years without a purchase since."""
    o = cat.order_lines(spark, sf_dir)
    return o.filter("date < DATE '2001-01-01'").select("customer_id").distinct().join(o.filter("date >= DATE '2001-01-01'"), "customer_id", "left_anti")
