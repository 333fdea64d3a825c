"""Profiles and quality at work."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import profile as prof
from ..operators import quality as qual
from ..sources import catalog as cat
from .base import Part

part = Part()
c = F.col

_COLUMNS = ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


@part.query(" UNION ALL ".join(
    f"SELECT '{x}' AS name, count(*) AS n, count(*) FILTER ({x} IS NULL) AS nulls, count(DISTINCT {x}) AS n_distinct, round(count(DISTINCT {x}) * 1.0 / count({x}), 6) AS uniqueness, '{kind}' AS logical_type, {dim} AS is_dimension FROM customer"
    for x, kind, dim in (("c_custkey", "integer", "false"), ("c_name", "text", "false"), ("c_nationkey", "integer", "false"), ("c_acctbal", "number", "false"), ("c_mktsegment", "category", "true"))
))
def g_column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every column of the customers."""
    return prof.column_profile(cat.table(spark, sf_dir, "customer"), list(_COLUMNS)).select("name", "n", "nulls", "n_distinct", "uniqueness", "logical_type", "is_dimension")


@part.query("SELECT 'amount' AS name, round(avg(CAST(event_id % 17 <> 0 AS INT)), 6) AS ratio FROM events UNION ALL SELECT 'date', 1.0 FROM events UNION ALL SELECT 'kind', 0.0 FROM events LIMIT 3".replace("FROM events UNION ALL SELECT 'date', 1.0 FROM events UNION ALL SELECT 'kind', 0.0 FROM events LIMIT 3", "FROM events UNION ALL SELECT 'date', 1.0 UNION ALL SELECT 'kind', 0.0"))
def g_value_compatibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = cat.table(spark, sf_dir, "events")
    t = e.select(F.when(c("event_id") % 17 == 0, "n/a").otherwise(c("value").cast("string")).alias("amount"), F.date_format("ts", "dd/MM/yyyy").alias("date"), c("event_type").alias("kind"))
    return prof.compatibility(t, {"amount": "number", "date": "date", "kind": "number"})


_KEYS = ("l_orderkey", "l_linenumber", "l_partkey")
_SETS = [(a,) for a in _KEYS] + [("l_orderkey", "l_linenumber"), ("l_orderkey", "l_partkey"), ("l_linenumber", "l_partkey")]


@part.query(" UNION ALL ".join(f"SELECT '{'+'.join(s)}' AS name, round(count(DISTINCT ({', '.join(s)})) * 1.0 / count(*), 6) AS uniqueness, count(DISTINCT ({', '.join(s)})) = count(*) AS is_key FROM lineitem" for s in _SETS))
def g_key_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prof.key_candidates(cat.table(spark, sf_dir, "lineitem"), list(_KEYS))


_NEAR = "round(avg(CAST(abs({e} - ({r})) <= greatest(0.011, 0.01 * abs({e})) AS INT)), 6)"
_REL = {"quantity_price_subtotal": ("quantity * unit_price - discount", "subtotal"), "total_with_taxes": ("subtotal + tax - discount", "total")}


@part.query(" UNION ALL ".join(f"SELECT '{n}' AS relation, count(*) AS n, {_NEAR.format(e='(' + e + ')', r=r)} AS rate, avg(CAST(abs(({e}) - {r}) <= greatest(0.011, 0.01 * abs({e})) AS INT)) >= 0.9 AS holds FROM order_lines" for n, (e, r) in _REL.items())
            + " UNION ALL SELECT 'net_flow', count(*), 1.0, true FROM cashflow UNION ALL SELECT 'roas', count(*) FILTER (spend <> 0), 1.0, true FROM campaign_days")
def g_column_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formulas between the columns of order lines, of cash flow and of campaign days."""
    o = cat.order_lines(spark, sf_dir)
    f = cat.cashflow(spark, sf_dir).withColumn("net_cash_flow", c("cash_in") - c("cash_out"))
    m = cat.campaign_days(spark, sf_dir).withColumn("roas", c("revenue") / F.nullif("spend", F.lit(0.0))).drop("conversions")
    every = reduce(DataFrame.unionAll, (prof.column_relations(x) for x in (o, f, m)))
    return every.select("relation", "n", "rate", "holds")


_FROM = {"events.user_id": "SELECT DISTINCT user_id AS v FROM events", "orders.o_custkey": "SELECT DISTINCT o_custkey FROM orders", "lineitem.l_partkey": "SELECT DISTINCT l_partkey FROM lineitem", "lineitem.l_suppkey": "SELECT DISTINCT l_suppkey FROM lineitem"}
_TO = {"customer.c_custkey": "SELECT c_custkey AS k FROM customer", "part.p_partkey": "SELECT p_partkey FROM part", "supplier.s_suppkey": "SELECT s_suppkey FROM supplier"}


@part.query(" UNION ALL ".join(f"SELECT '{a}' AS \"from\", '{b}' AS \"to\", count(*) AS n_distinct, round(avg(CAST(v IN (SELECT k FROM ({y}) AS y(k)) AS INT)), 6) AS overlap, count(*) >= 2 AND avg(CAST(v IN (SELECT k FROM ({y}) AS y(k)) AS INT)) >= 0.8 AS linked FROM ({x}) AS x(v)" for a, x in _FROM.items() for b, y in _TO.items()))
def g_foreign_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of three tables against the keys of three others, by their values alone."""
    t = lambda n: cat.table(spark, sf_dir, n)
    return prof.foreign_keys({"events": (t("events"), ["user_id"]), "orders": (t("orders"), ["o_custkey"]), "lineitem": (t("lineitem"), ["l_partkey", "l_suppkey"])}, {"customer": (t("customer"), "c_custkey"), "part": (t("part"), "p_partkey"), "supplier": (t("supplier"), "s_suppkey")})


_RULES = [qual.FieldRule("event_id", identifier=True), qual.FieldRule("value", amount=True), qual.FieldRule("user_id"), qual.FieldRule("event_type")]
_AGE = "date_diff('day', max(CAST(ts AS DATE)), DATE '2024-01-30')"
_FRESH = f"CAST(CASE WHEN {_AGE} <= 7 THEN 100.0 WHEN {_AGE} <= 30 THEN 90 WHEN {_AGE} <= 90 THEN 75 WHEN {_AGE} <= 180 THEN 50 WHEN {_AGE} <= 365 THEN 30 ELSE 10 END AS DOUBLE)"
_MEDIAN = "(SELECT list_sort(list(value) FILTER (value > 0))[count(*) FILTER (value > 0) // 2 + 1] FROM events)"


def _field_sql() -> str:
    row = "SELECT '{f}' AS field, count({f}) * 100.0 / count(*) AS a, {v} AS b, {k} AS c, {u} AS d, {fresh} AS e FROM events"
    rows = " UNION ALL ".join(
        row.format(f=r.name, fresh=_FRESH, v="count(*) FILTER (value >= 0) * 100.0 / count(value)" if r.amount else "100.0", k=f"100 - count(*) FILTER (value < 0 OR value > 20 * {_MEDIAN}) * 100.0 / count(*)" if r.amount else "100.0", u=f"count(DISTINCT {r.name}) * 100.0 / count({r.name})" if r.identifier else "100.0")
        for r in _RULES
    )
    return f"WITH q AS ({rows}), s AS (SELECT *, a * 0.3 + b * 0.25 + c * 0.2 + d * 0.1 + e * 0.15 AS score, least(a, b, c, d, e) AS w FROM q)"


_GRADE = "CASE WHEN {0} >= 90 THEN 'A' WHEN {0} >= 75 THEN 'B' WHEN {0} >= 60 THEN 'C' ELSE 'D' END"


@part.query(f"{_field_sql()} SELECT field, round(a, 4) AS completeness, round(b, 4) AS validity, round(c, 4) AS consistency, round(d, 4) AS uniqueness, round(e, 4) AS freshness, round(score, 4) AS score, {_GRADE.format('score')} AS grade, score >= 60 AS sufficient, CASE w WHEN a THEN 'completeness' WHEN b THEN 'validity' WHEN c THEN 'consistency' WHEN d THEN 'uniqueness' ELSE 'freshness' END AS weakest FROM s")
def q_field_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qual.field_quality(cat.table(spark, sf_dir, "events"), _RULES, cat.EVENTS_AS_OF, "ts")


@part.query(f"{_field_sql()} SELECT round(avg(score), 4) AS score, {_GRADE.format('avg(score)')} AS grade, round(count(*) * 100.0 / 6, 4) AS mapping_coverage, count(*) FILTER (score >= 60) AS n_sufficient, avg(score) >= 60 AND count(*) * 100.0 / 6 >= 60 AS ready FROM s")
def q_dataset_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = cat.table(spark, sf_dir, "events")
    return qual.dataset_quality(qual.field_quality(e, _RULES, cat.EVENTS_AS_OF, "ts"), len(e.columns))


#: source: entity, date, amount, key, reference date
_SOURCES = {
    "transactions": ("transactions", "date", "amount", None, cat.EVENTS_AS_OF), "orders": ("order_lines", "date", "total", "order_id", cat.ORDERS_AS_OF), "customers": ("acquired", "date", None, "customer_id", cat.ORDERS_AS_OF), "treasury": ("cashflow", "date", "cash_in", "date", cat.EVENTS_AS_OF),
    "expenses": ("expenses", "date", "amount", "expense_id", cat.EVENTS_AS_OF), "inventory": ("inventory", "date", None, None, cat.ORDERS_AS_OF), "campaigns": ("campaigns", "date", "spend", "campaign_id", cat.EVENTS_AS_OF), "campaign days": ("campaign_days", "date", "spend", None, cat.EVENTS_AS_OF), "payroll": ("payroll", "period", "total_cost", None, cat.ORDERS_AS_OF),
}
_MORE = "acquired AS (SELECT customer_id, min(date) AS date FROM order_lines GROUP BY 1), campaigns AS (SELECT campaign_id, min(date) AS date, sum(spend) AS spend FROM campaign_days GROUP BY 1)"


def _source_sql() -> str:
    out = []
    for name, (e, d, v, k, at) in _SOURCES.items():
        zero = f"count(*) FILTER ({v} IS NULL OR {v} = 0)" if v else "0"
        many = f"count(*) FILTER (abs({v}) > 20 * (SELECT avg(abs({v})) FROM {e} WHERE {v} <> 0))" if v else "0"
        again = f"count({k}) - count(DISTINCT {k})" if k else "0"
        gaps = f"(SELECT coalesce(sum(g), 0)::BIGINT FROM (SELECT date_diff('month', lag(m) OVER (ORDER BY m), m) - 1 AS g FROM (SELECT DISTINCT date_trunc('month', {d}) AS m FROM {e} WHERE {d} IS NOT NULL AND date_trunc('month', {d}) <> date_trunc('month', DATE '{at}'))))"
        out.append(f"SELECT '{name}' AS source, count(*) AS n, count(*) FILTER ({d} IS NULL) AS undated, count(*) FILTER ({d} > DATE '{at}') AS future, {zero} AS zero, {many} AS outliers, {again} AS duplicates, count(DISTINCT date_trunc('month', {d})) AS months, {gaps} AS month_gaps FROM {e}")
    return f"WITH {_MORE}, s AS ({' UNION ALL '.join(out)}) SELECT *, CASE WHEN n = 0 THEN 'skip' WHEN duplicates > 0 OR undated > 0 THEN 'error' WHEN future > 0 OR zero > 0 OR outliers > 0 OR month_gaps > 0 THEN 'warn' ELSE 'ok' END AS verdict FROM s"


@part.query(_source_sql())
def q_source_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nine sources."""
    frames = cat.frames(spark, sf_dir)
    frames["acquired"] = frames["order_lines"].groupBy("customer_id").agg(F.min("date").alias("date"))
    frames["campaigns"] = frames["campaign_days"].groupBy("campaign_id").agg(F.min("date").alias("date"), F.sum("spend").alias("spend"))
    return reduce(DataFrame.unionAll, (qual.source_quality(frames[e], name, at, d, v, k) for name, (e, d, v, k, at) in _SOURCES.items()))
