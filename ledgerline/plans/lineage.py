"""Q6: where every indicator comes from: its sources through the dependency graph, their period, quality, evidence and
warnings, beside its value and status in the same row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.quality import FieldRule, field_quality
from ..sources import catalog as cat
from ..sources.catalog import with_entities
from . import kpis
from .base import Part

part = Part()
c = F.col

#: The field that each base measure reads; measures of shared months read those of their names without the suffix.
FIELDS = {
    "order_lines": "order_revenue:subtotal cogs:cost tax_federal:tax_federal tax_provincial:tax_provincial gross_sales:subtotal returns:subtotal n_orders:order_id n_orders_buyer:customer_id n_buyers:customer_id revenue_buyer:subtotal discount_amount:discount days:date months:date",
    "transactions": "income:amount txn_expense:amount txn_open:amount txn_twice:amount booked:amount foreign_share:currency", "expenses": "opex:amount", "payroll": "payroll:total_cost payroll_cost:total_cost overtime:overtime regular_pay:regular_pay",
    "employees": "n_staff_all:employee_id n_staff:employee_id mean_employer_cost:total_employer_cost employer_total:total_employer_cost seniority:seniority_years n_sales_staff:department union_share:union_status",
    "cashflow": "net_flow:cash_in cash_days:date closing_cash:cash_in", "balances": "receivable:receivable payable:payable opening_cash:opening_cash",
    "campaign_days": "spend:spend campaign_revenue:revenue clicks:clicks impressions:impressions new_customers:new_customers", "customers": "n_active:status n_lost:status n_customers:customer_id points:loyalty_points credit_limit:credit_limit",
    "remarks": "sentiment:text", "inventory": "stock_value:inventory_value stock_average:inventory_value critical_share:closing_stock", "suppliers": "esg:esg_score local_share:province", "assets": "net_book_value:net_book_value accumulated:accumulated_depreciation initial_cost:initial_cost dpa:net_book_value",
}
READ_BY = {m: (entity, field) for entity, said in FIELDS.items() for m, field in (x.split(":") for x in said.split())}
#: The date column of an entity's rows.
DATED = kpis.FLOWS | kpis.UP_TO
# How far a value can be relied on.
EVIDENCE = {"VALID": "CALCUL", "VALID_ZERO": "CALCUL", "UNKNOWN": "INFÉRENCE"}
NO_EVIDENCE = "HYPOTHÈSE"
POOR = 60


def sources_of(kpi: kpis.Kpi) -> list[tuple[str, str]]:
    """(entity, field) that an indicator rests on, through all indicators and shared measures that it names, in order."""
    by = {k.id: k for k in kpis.KPIS}
    out: dict[tuple[str, str], None] = {}
    seen: set[str] = set()

    def walk(name: str) -> None:
        if name in seen:
            return
        seen.add(name)
        plain = name if name in READ_BY or name in kpis._SHARED else name.rstrip("34")
        if name in kpis._SHARED:
            for w in kpis._names(kpis._SHARED[name]):
                walk(w)
        elif plain in READ_BY:
            out[READ_BY[plain]] = None
        elif name in by:
            for w in kpis._names(by[name].expr):
                walk(w)

    for w in kpis._names(kpi.expr):
        walk(w)
    return list(out)


def source_facts(frames: dict[str, DataFrame], used: set[tuple[str, str]], as_of: str) -> DataFrame:
    """One row: for every (entity, field) that a frame has, a struct `entity.field` of source, rows, first and last day, quality."""
    row = None
    for entity in sorted({e for e, _ in used}):
        df = frames.get(entity)
        fields = sorted(f for e, f in used if e == entity and df is not None and f in df.columns)
        if not fields:
            continue
        day = DATED.get(entity)
        has_day = day is not None and day in df.columns
        span = (F.min(day).cast("date"), F.max(day).cast("date")) if has_day else (F.lit(None).cast("date"),) * 2
        q = field_quality(df, [FieldRule(f) for f in fields], as_of, day if has_day else None, {"n": F.count(F.lit(1)), "a": span[0], "b": span[1]})
        facts = q.agg(*(F.max(x).alias(x) for x in ("n", "a", "b")), *(F.max(F.when(c("field") == f, c("score"))).alias(f"q_{f}") for f in fields))
        facts = facts.select(*(F.struct(F.lit(f"{entity}.{f}").alias("source"), "n", "a", "b", c(f"q_{f}").alias("quality")).alias(f"{entity}__{f}") for f in fields))
        row = facts if row is None else row.crossJoin(F.broadcast(facts))
    return row


def lineage(spark: SparkSession, frames: dict[str, DataFrame], as_of: str, start: str | None = None, end: str | None = None, ids: list[str] | None = None) -> DataFrame:
    """kpi, value, status, sources, n_records, period_start, period_end, quality, evidence, warnings of indicators.

    A source that no frame has is none. quality is the rounded mean of the sources', null without any.
    """
    asked = [k for k in kpis.needed(ids) if ids is None or k.id in ids]
    row = kpis.evaluated(kpis.measures(spark, frames, start, end), kpis.needed(ids))
    rests_on = {k.id: sources_of(k) for k in asked}
    facts = source_facts(frames, {s for own in rests_on.values() for s in own}, as_of)
    known = set(facts.columns) if facts is not None else set()
    if facts is not None:
        row = row.crossJoin(F.broadcast(facts))
    kind = "array<struct<source:string,n:bigint,a:date,b:date,quality:double>>"
    cells = []
    for k in asked:
        own = [c(name) for e, f in rests_on[k.id] if (name := f"{e}__{f}") in known]
        sources = (F.array(*own) if own else F.array()).cast(kind)
        cells.append(F.struct(F.lit(k.id).alias("kpi"), c(k.id).alias("v"), kpis.status_of(c(k.id), c(f"{k.id}__partial")).alias("status"), sources.alias("s")))
    x = row.select(F.explode(F.array(*cells)).alias("x")).select("x.*")
    of = lambda name: F.transform("s", lambda y: y[name])
    known_q = F.array_compact(of("quality"))
    mean = F.when(F.size(known_q) > 0, F.floor(F.aggregate(known_q, F.lit(0.0), lambda a, b: a + b) / F.size(known_q) + 0.5))
    return x.select("kpi", F.round("v", 4).alias("value"), "status", F.array_join(F.array_sort(of("source")), ",").alias("sources"), F.coalesce(F.aggregate(of("n"), F.lit(0).cast("long"), lambda a, b: a + b), F.lit(0)).alias("n_records"), F.array_min(F.array_compact(of("a"))).alias("period_start"), F.array_max(F.array_compact(of("b"))).alias("period_end"), mean.cast("long").alias("quality"), _evidence(c("status")).alias("evidence"), _warnings(mean, F.exists("s", lambda y: y["n"] == 0), c("status")).alias("warnings"))


def _evidence(status: Column) -> Column:
    out = F.lit(NO_EVIDENCE)
    for s, e in EVIDENCE.items():
        out = F.when(status == s, e).otherwise(out)
    return out


def _warnings(quality: Column, empty: Column, status: Column) -> Column:
    return F.array_join(F.array_compact(F.array(F.when(quality < POOR, "poor sources"), F.when(empty, "empty source"), F.when(status == "UNKNOWN", "partial"), F.when(status == "INVALID", "not finite"))), ",")


def _sql() -> str:
    used = sorted({s for k in kpis.KPIS for s in sources_of(k)})
    facts, pairs = [], []
    for e, f in used:
        day = DATED.get(e)
        age = f"date_diff('day', max(CAST({day} AS DATE)), DATE '{cat.ORDERS_AS_OF}')" if day else "NULL"
        fresh = f"CASE WHEN {age} IS NULL THEN 75 WHEN {age} <= 7 THEN 100 WHEN {age} <= 30 THEN 90 WHEN {age} <= 90 THEN 75 WHEN {age} <= 180 THEN 50 WHEN {age} <= 365 THEN 30 ELSE 10 END"
        span = f"min(CAST({day} AS DATE)), max(CAST({day} AS DATE))" if day else "CAST(NULL AS DATE), CAST(NULL AS DATE)"
        facts.append(f"SELECT '{e}.{f}', count(*), {span}, count({f}) * 100.0 / nullif(count(*), 0) * 0.3 + 55 + ({fresh}) * 0.15 FROM {e}")
    for k in kpis.KPIS:
        pairs += [f"('{k.id}', '{e}.{f}')" for e, f in sources_of(k)]
    values = kpis._all_sql()
    return with_entities(f"""
WITH facts(source, n, a, b, q) AS ({' UNION ALL '.join(facts)}), rests(kpi, source) AS (VALUES {', '.join(pairs)}),
v AS ({values}),
s AS (SELECT kpi, string_agg(source, ',' ORDER BY source) AS sources, sum(n) AS n_records, min(a) AS period_start, max(b) AS period_end, floor(avg(q) + 0.5) AS quality, bool_or(n = 0) AS empty FROM rests JOIN facts USING (source) GROUP BY kpi)
SELECT kpi, value, status, sources, CAST(n_records AS BIGINT) AS n_records, period_start, period_end, CAST(quality AS BIGINT) AS quality,
  CASE status WHEN 'VALID' THEN 'CALCUL' WHEN 'VALID_ZERO' THEN 'CALCUL' WHEN 'UNKNOWN' THEN 'INFÉRENCE' ELSE 'HYPOTHÈSE' END AS evidence,
  concat_ws(',', CASE WHEN quality < 60 THEN 'poor sources' END, CASE WHEN empty THEN 'empty source' END, CASE WHEN status = 'UNKNOWN' THEN 'partial' END, CASE WHEN status = 'INVALID' THEN 'not finite' END) AS warnings
FROM v LEFT JOIN s USING (kpi)
""")


@part.query(None)
def q_kpi_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every indicator over the whole tables with all that it rests on."""
    return lineage(spark, cat.frames(spark, sf_dir), cat.ORDERS_AS_OF)


part.ORACLE_SQL["q_kpi_lineage"] = _sql()
