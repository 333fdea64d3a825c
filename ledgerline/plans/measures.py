"""Generic aggregates by canonical key, fuzzy header matching, and external signals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.semantics import MEASURES, aggregate
from ..operators.typo import best_matches
from ..sources import catalog as cat
from .base import Part

part = Part()
c = F.col

_V = {
    "revenue": "SELECT sum(subtotal) FROM order_lines WHERE status <> 'returned'", "cogs": "SELECT sum(cost) FROM order_lines WHERE status <> 'returned'", "sales_quantity": "SELECT sum(quantity) FROM order_lines WHERE status <> 'returned'",
    "order_unit_price": "SELECT sum(unit_price * quantity) / sum(quantity) FROM order_lines WHERE status <> 'returned'", "order_discount": "SELECT avg(discount) FROM order_lines WHERE status <> 'returned'", "order_ids": "SELECT count(DISTINCT order_id) FROM order_lines WHERE status <> 'returned'",
    "stock_closing": "SELECT sum(v) FROM (SELECT arg_max(closing_stock, date) AS v FROM inventory GROUP BY product_id, warehouse_id)", "inventory_value": "SELECT sum(v) FROM (SELECT arg_max(inventory_value, date) AS v FROM inventory GROUP BY product_id, warehouse_id)",
    "operating_expense": "SELECT sum(amount) FROM expenses", "payroll_total_cost": "SELECT sum(total_cost) FROM payroll", "customer_credit_limit": "SELECT sum(credit_limit) FROM customers", "supplier_esg": "SELECT avg(esg_score) FROM suppliers",
}


@part.query("SELECT key, round(v, 4) AS value, CASE WHEN v IS NULL THEN 'NOT_MEASURED' WHEN v = 0 THEN 'VALID_ZERO' ELSE 'VALID' END AS status FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS key, CAST(({q}) AS DOUBLE) AS v" for k, q in _V.items()) + ")")
def a_generic_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = {n: getattr(cat, n)(spark, sf_dir) for n in {m.entity for m in MEASURES.values()}}
    frames["order_lines"] = frames["order_lines"].filter("status <> 'returned'")
    every = reduce(DataFrame.unionAll, (aggregate(df, *(m for m in MEASURES.values() if m.entity == entity)) for entity, df in frames.items()))
    return every.select("key", F.round("value", 4).alias("value"), "status")


#: A name misspelled by its key: two letters swapped, one dropped, one doubled, or as it is.
_TYPO = """CASE p_partkey % 4 WHEN 0 THEN substr(w, 1, k - 1) || substr(w, k + 1, 1) || substr(w, k, 1) || substr(w, k + 2) WHEN 1 THEN substr(w, 1, k - 1) || substr(w, k + 1) WHEN 2 THEN substr(w, 1, k) || substr(w, k, 1) || substr(w, k + 1) ELSE upper(w) END"""
_MATCHED = """d AS (SELECT DISTINCT seen, known, damerau_levenshtein(lower(seen), known) AS dist FROM (SELECT DISTINCT {typo} AS seen FROM s), (SELECT DISTINCT w AS known FROM s) WHERE length(seen) >= 3),
r AS (SELECT *, 1 - dist / greatest(length(seen), length(known)) AS sim FROM d WHERE dist <= CASE WHEN length(known) <= 5 THEN 1 ELSE 2 END),
x AS (SELECT *, row_number() OVER (PARTITION BY seen ORDER BY sim DESC, known) AS i FROM r WHERE sim >= 0.65)
SELECT seen AS value, known AS match, dist::INT AS distance, round(sim, 3) AS similarity FROM x WHERE i = 1""".format(typo=_TYPO)


def _misspelled(s: DataFrame) -> DataFrame:
    return s.withColumn("k", (1 + c("p_partkey") % (F.length("w") - 1)).cast("int")).select("w", F.expr(_TYPO).alias("seen"))


@part.query("WITH s AS (SELECT p_partkey, w, (1 + p_partkey % (length(w) - 1))::INT AS k FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part)), " + _MATCHED)
def g_fuzzy_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Misspelled words of the parts' names, each with the nearest word that the names have."""
    s = cat.table(spark, sf_dir, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("w"))
    m = _misspelled(s)
    return best_matches(m, "seen", m, "w")


@part.query("WITH s AS (SELECT p_partkey, p_name AS w, (1 + p_partkey % (length(p_name) - 1))::INT AS k FROM part), " + _MATCHED)
def g_typo_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Misspelled names of parts, each with the nearest name of the table."""
    m = _misspelled(cat.table(spark, sf_dir, "part").select("p_partkey", c("p_name").alias("w")))
    return best_matches(m, "seen", m, "w")


@part.query("SELECT event_id, event_type AS concept, round(value, 4) AS value, CASE WHEN event_id % 3 = 0 THEN 0.9 WHEN event_id % 3 = 1 THEN 0.6 ELSE 0.3 END::DOUBLE AS confidence FROM events WHERE event_id % 3 <> 2")
def c_signal_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals as observations with their source's trust; those under 0.6 are left out."""
    trust = F.when(c("event_id") % 3 == 0, 0.9).when(c("event_id") % 3 == 1, 0.6).otherwise(0.3)
    e = cat.table(spark, sf_dir, "events").withColumn("confidence", trust)
    return e.filter("confidence >= 0.6").select("event_id", c("event_type").alias("concept"), F.round("value", 4).alias("value"), "confidence")


@part.query("SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS i FROM events) WHERE i = 1")
def s_latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest row of each key of an append-only store."""
    e = cat.table(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(F.max(F.struct("ts", "event_id")).alias("x")).select("user_id", "x.event_id", "x.ts")


@part.query("SELECT c_custkey AS customer_id, kind, value FROM (SELECT c_custkey, c_mktsegment AS segment, CAST(c_nationkey AS VARCHAR) AS nation FROM customer) UNPIVOT (value FOR kind IN (segment, nation))")
def k_observation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One observation for each filled cell."""
    cu = cat.table(spark, sf_dir, "customer").select(c("c_custkey").alias("customer_id"), c("c_mktsegment").alias("segment"), c("c_nationkey").cast("string").alias("nation"))
    return cu.unpivot(["customer_id"], ["segment", "nation"], "kind", "value").filter("value IS NOT NULL")


@part.query("SELECT event_id, value FROM events WHERE event_id % 5 <> 2")
def k_delete_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left after one import's rows are taken out."""
    return cat.table(spark, sf_dir, "events").filter("event_id % 5 <> 2").select("event_id", "value")
