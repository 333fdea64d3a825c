"""Read plans, gated aggregates and alerts that depend on earlier alerts, over whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.semantics import MEASURES, Measure
from ..operators.gated import gated_aggregate
from ..operators.read_plan import Plan, PlanColumn, apply_plan
from ..sources import catalog as cat
from ..streaming.alert_chain import alert_chain, critical
from .base import Part

part = Part()
c = F.col

_PLAN = Plan((PlanColumn("Date op.", "date"), PlanColumn("Sens", "type", coded=True), PlanColumn("Montant", "amount"), PlanColumn("No client", "customer_id"), PlanColumn("Divers")))
_CODES = {"P": "income", "E": "expense", "S": "signup"}


def _exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as an export of another house writes them: months first, decimal commas, codes, a total every 500 rows."""
    e = cat.table(spark, sf_dir, "events")
    total = c("event_id") % 500 == 250
    return e.select(
        c("event_id").alias("row_no"), F.when(~total, F.date_format("ts", "M/d/yyyy")).alias("Date op."), F.when(total, "Total général").otherwise(F.concat(F.lit(" "), F.upper(F.substring("event_type", 1, 1)), F.lit(" "))).alias("Sens"),
        F.replace(F.format_string("%.2f", "value"), F.lit("."), F.lit(",")).alias("Montant"), F.when(~total, c("user_id").cast("string")).alias("No client"), F.when(~total, F.lit("x")).alias("Divers"),
    )


@part.query("""WITH e AS (SELECT *, upper(substr(event_type, 1, 1)) AS k FROM events WHERE event_id % 500 <> 250 AND event_id % 100 <> 7)
SELECT event_id AS row_no, CAST(CAST(ts AS DATE) AS VARCHAR) AS date, CASE k WHEN 'P' THEN 'income' WHEN 'E' THEN 'expense' WHEN 'S' THEN 'signup' ELSE ' ' || k || ' ' END AS type, round(value, 2) AS amount, CAST(user_id AS VARCHAR) AS customer_id FROM e""")
def n_apply_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An export read by its plan: fields named, codes translated, conventions proven by whole columns, totals and ignored rows set aside."""
    raw = _exported(spark, sf_dir)
    codes = spark.createDataFrame([("Sens", k, v) for k, v in _CODES.items()], "column string, code string, value string")
    rows, _ = apply_plan(raw, _PLAN, codes, raw.filter("row_no % 100 = 7").select("row_no"))
    return rows.select("row_no", "date", "type", F.round(c("amount").cast("double"), 2).alias("amount"), "customer_id")


@part.query("""SELECT event_id AS row_no, CASE WHEN event_id % 500 = 250 THEN 'total' ELSE 'ignored' END AS reason FROM events WHERE event_id % 500 = 250 OR event_id % 100 = 7""")
def n_plan_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the plan's reading set aside, and why."""
    raw = _exported(spark, sf_dir)
    return apply_plan(raw, _PLAN, None, raw.filter("row_no % 100 = 7").select("row_no"))[1].select("row_no", "reason")


#: Measures by branch of the choice: an entity of good quality, one of poor quality, one without values, and observations.
_GATED = [MEASURES["revenue"], MEASURES["operating_expense"], MEASURES["stock_closing"], MEASURES["order_ids"], Measure("late_fee", "order_lines", ("late_fee",), "flow", "sum"), Measure("rebate", "order_lines", ("rebate",), "flow", "sum"), Measure("energy", "meters", ("kwh",), "flow", "sum"), Measure("waste", "meters", ("tons",), "flow", "sum"), Measure("water", "meters", ("m3",), "flow", "sum")]


def _judged(entity: str, field: str, amount: bool = True, unique: bool = False) -> str:
    """The score of a field, in percent, as of the orders' reference date."""
    median = f"(SELECT list_sort(list({field}) FILTER ({field} > 0))[count(*) FILTER ({field} > 0) // 2 + 1] FROM {entity})"
    age = f"date_diff('day', max(date), DATE '{cat.ORDERS_AS_OF}')"
    fresh = f"CASE WHEN {age} <= 7 THEN 100 WHEN {age} <= 30 THEN 90 WHEN {age} <= 90 THEN 75 WHEN {age} <= 180 THEN 50 WHEN {age} <= 365 THEN 30 ELSE 10 END"
    valid = f"coalesce(count(*) FILTER ({field} >= 0) * 100.0 / nullif(count({field}), 0), 0)" if amount else "100.0"
    even = f"(100 - count(*) FILTER ({field} < 0 OR {field} > 20 * {median}) * 100.0 / count(*))" if amount else "100.0"
    alone = f"count(DISTINCT {field}) * 100.0 / count({field})" if unique else "100.0"
    return f"SELECT round(count({field}) * 100.0 / count(*) * 0.3 + {valid} * 0.25 + {even} * 0.2 + {alone} * 0.1 + ({fresh}) * 0.15, 4) FROM {entity}"


@part.query(f"""WITH ol AS (SELECT *, CASE WHEN order_id % 10 = 0 THEN -5.0 END AS late_fee FROM order_lines),
ob AS (SELECT CASE event_type WHEN 'view' THEN 'finance.energy' WHEN 'click' THEN 'waste' ELSE 'marketing.revenue' END AS concept, value, CASE WHEN event_type = 'click' THEN 0.4 WHEN event_id % 2 = 0 THEN 0.9 ELSE 0.3 END AS confidence FROM events),
x(key, value, source, quality) AS (
  SELECT 'revenue', (SELECT sum(subtotal) FROM ol), 'order_lines.subtotal', ({_judged('ol', 'subtotal')})
  UNION ALL SELECT 'operating_expense', (SELECT sum(amount) FROM expenses), 'expenses.amount', ({_judged('expenses', 'amount')})
  UNION ALL SELECT 'stock_closing', (SELECT sum(v) FROM (SELECT arg_max(closing_stock, date) AS v FROM inventory GROUP BY product_id, warehouse_id)), 'inventory.closing_stock', ({_judged('inventory', 'closing_stock')})
  UNION ALL SELECT 'order_ids', (SELECT count(DISTINCT order_id) FROM ol), 'order_lines.order_id', ({_judged('ol', 'order_id', False, True)})
  UNION ALL SELECT 'late_fee', (SELECT sum(late_fee) FROM ol), 'order_lines.late_fee', ({_judged('ol', 'late_fee')})
  UNION ALL SELECT 'rebate', NULL, 'order_lines.rebate', NULL
  UNION ALL SELECT 'energy', (SELECT sum(value) FROM ob WHERE concept = 'finance.energy' AND confidence >= 0.6), 'observations', NULL
  UNION ALL SELECT 'waste', NULL, 'observations', NULL
  UNION ALL SELECT 'water', NULL, NULL, NULL)
SELECT key, CASE WHEN quality < 60 THEN NULL ELSE round(value, 4) END AS value, CASE WHEN value IS NULL OR quality < 60 THEN 'NOT_MEASURED' WHEN value = 0 THEN 'VALID_ZERO' ELSE 'VALID' END AS status, source, quality,
  CASE WHEN quality < 60 THEN 'quality' WHEN key = 'rebate' THEN 'no value' WHEN key = 'waste' THEN 'trust' WHEN key = 'water' THEN 'no source' END AS reason FROM x""")
def a_gated_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine measures, each by the branch that its sources leave: entity, gate, no value, observations, no trust, no source."""
    lines = cat.order_lines(spark, sf_dir, cost=False).withColumns({"late_fee": F.when(c("order_id") % 10 == 0, -5.0), "rebate": F.lit(None).cast("double")})
    # what the measures read and no more, as each reads it several times over
    lines = lines.select("order_id", "date", "subtotal", "total", "late_fee", "rebate").persist()
    stock = cat.inventory(spark, sf_dir).select("product_id", "warehouse_id", "date", "closing_stock").persist()
    frames = {"order_lines": lines, "expenses": cat.expenses(spark, sf_dir), "inventory": stock}
    concept = F.when(c("event_type") == "view", "finance.energy").when(c("event_type") == "click", "waste").otherwise("marketing.revenue")
    confidence = F.when(c("event_type") == "click", 0.4).when(c("event_id") % 2 == 0, 0.9).otherwise(0.3)
    seen = cat.table(spark, sf_dir, "events").select(concept.alias("concept"), "value", confidence.alias("confidence"))
    every = reduce(DataFrame.unionAll, (gated_aggregate(m, frames, cat.ORDERS_AS_OF, seen, spark) for m in _GATED))
    return every.select("key", F.round("value", 4).alias("value"), "status", "source", F.round("quality", 4).alias("quality"), "reason")


@part.query("""WITH RECURSIVE f AS (SELECT event_type || ' ' || (user_id % 7) AS title, CAST(ts AS DATE) AS day, arg_min(CAST(event_id AS VARCHAR), (ts, CAST(event_id AS VARCHAR))) AS event_id FROM events WHERE value > 20 GROUP BY ALL),
chain(title, day) AS (SELECT title, min(day) FROM f GROUP BY 1 UNION ALL SELECT c.title, (SELECT min(f.day) FROM f WHERE f.title = c.title AND f.day > c.day + 5) AS day FROM chain c WHERE EXISTS (SELECT 1 FROM f WHERE f.title = c.title AND f.day > c.day + 5))
SELECT title, CAST(day AS DATE) AS day, event_id FROM chain JOIN f USING (title, day)""")
def j_alert_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of events over a value: each title again only when five days have passed since its last alert."""
    title = F.concat(F.initcap("event_type"), F.lit("  "), (c("user_id") % 7).cast("string"), F.lit(" "))
    return alert_chain(critical(cat.table(spark, sf_dir, "events"), title, c("value") > 20, "ts", "event_id"), 5)
