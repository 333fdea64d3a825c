"""Quality, coherence and lineage checks; alerts, scores and derived analytics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.periods import latest_stock, trend_pct
from ..sources import catalog as cat
from . import kpis
from .base import Part

part = Part()
c = F.col


@part.query("SELECT 'orders' AS source, count(*) AS n, min(date) AS first_date, max(date) AS last_date FROM order_lines UNION ALL SELECT 'transactions', count(*), min(date), max(date) FROM transactions UNION ALL SELECT 'payroll', count(*), min(period), max(period) FROM payroll")
def q_lineage_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda df, name, d: df.agg(F.lit(name).alias("source"), F.count(F.lit(1)).alias("n"), F.min(d).alias("first_date"), F.max(d).alias("last_date"))
    return one(cat.order_lines(spark, sf_dir), "orders", "date").unionAll(one(cat.transactions(spark, sf_dir), "transactions", "date")).unionAll(one(cat.payroll(spark, sf_dir), "payroll", "period"))


@part.query("""WITH s AS (SELECT customer_id, count(DISTINCT order_id) AS freq, sum(subtotal) AS rev, date_diff('day', max(date), DATE '2001-08-15') AS rec FROM order_lines WHERE status <> 'returned' GROUP BY 1), l AS (SELECT list_sort(list(freq)) AS f, list_sort(list(rev)) AS r FROM s),
q AS (SELECT f[len(f) // 2 + 1] AS mf, r[len(r) // 2 + 1] AS mr, r[CAST(floor(0.75 * len(r)) AS INT) + 1] AS p75 FROM l)
SELECT count(*) FILTER (rec <= 60 AND freq >= greatest(2, mf) AND rev >= p75) AS champions, count(*) FILTER (rec > 180) AS to_reactivate, count(*) FILTER (rev >= mr AND (status IN ('inactif', 'perdu') OR credit_limit > 0 AND rev >= 0.8 * credit_limit)) AS at_risk FROM s JOIN customers USING (customer_id), q""")
def c_rfm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments by recency, frequency and revenue; thresholds are exact order statistics by rank over distinct customers."""
    # exact sums: those of doubles differ from one evaluation to the next, and a threshold is one of the values
    orders = cat.order_lines(spark, sf_dir, cost=False).filter("status <> 'returned'").groupBy("customer_id", "order_id").agg(F.sum(c("subtotal").cast("decimal(28,8)")).alias("rev"), F.max("date").alias("date"))
    s = orders.groupBy("customer_id").agg(F.count(F.lit(1)).alias("freq"), F.sum("rev").cast("double").alias("rev"), F.datediff(F.lit(cat.ORDERS_AS_OF).cast("date"), F.max("date")).alias("rec"))
    from ..functions.parsing import order_statistic

    s = s.persist()  # one row a customer, read for three ranks and the segments
    q = order_statistic(s, "freq", 0.5, "mf").crossJoin(order_statistic(s, "rev", 0.5, "mr")).crossJoin(order_statistic(s, "rev", 0.75, "p75"))
    x = s.join(cat.customers(spark, sf_dir), "customer_id").crossJoin(F.broadcast(q))
    return x.agg(F.count_if((c("rec") <= 60) & (c("freq") >= F.greatest(F.lit(2), c("mf"))) & (c("rev") >= c("p75"))).alias("champions"), F.count_if(c("rec") > 180).alias("to_reactivate"), F.count_if((c("rev") >= c("mr")) & (c("status").isin("inactif", "perdu") | (c("credit_limit") > 0) & (c("rev") >= 0.8 * c("credit_limit")))).alias("at_risk"))


@part.query("""WITH b AS (SELECT customer_id, max(date) AS last FROM order_lines GROUP BY 1)
SELECT round(count(*) FILTER (status IN ('inactif', 'perdu')) * 100.0 / count(*), 4) AS churn_rate, count(*) FILTER (status = 'actif' AND churn_risk >= 0.7) AS at_risk, round(count(*) FILTER (last < DATE '2001-02-15') * 100.0 / count(last), 4) AS lapse_rate FROM customers LEFT JOIN b USING (customer_id)""")
def c_churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By status, by risk, and by behaviour: buyers without an order in six months."""
    b = cat.order_lines(spark, sf_dir).groupBy("customer_id").agg(F.max("date").alias("last"))
    x = cat.customers(spark, sf_dir).join(b, "customer_id", "left")
    n = F.count(F.lit(1))
    return x.agg(F.round(F.count_if(c("status").isin("inactif", "perdu")) * 100.0 / n, 4).alias("churn_rate"), F.count_if((c("status") == "actif") & (c("churn_risk") >= 0.7)).alias("at_risk"), F.round(F.count_if(c("last") < "2001-02-15") * 100.0 / F.count("last"), 4).alias("lapse_rate"))


@part.query("""WITH k AS (SELECT count(*) FILTER (status <> 'actif') * 1.0 / count(*) AS churn FROM customers)
SELECT customer_id, round(sum(subtotal), 4) AS value, round(sum(subtotal - cost), 4) AS margin_value, round(sum(subtotal - cost) / any_value(churn), 4) AS ltv FROM order_lines, k WHERE status <> 'returned' GROUP BY 1""")
def c_customer_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each customer brought, in revenue and margin, and the margin over the share of customers that leave."""
    k = cat.customers(spark, sf_dir).agg((F.count_if(c("status") != "actif") / F.count(F.lit(1))).alias("churn"))
    g = cat.order_lines(spark, sf_dir).filter("status <> 'returned'").groupBy("customer_id").agg(F.sum("subtotal").alias("v"), F.sum(c("subtotal") - c("cost")).alias("m"))
    return g.crossJoin(F.broadcast(k)).select("customer_id", F.round("v", 4).alias("value"), F.round("m", 4).alias("margin_value"), F.round(c("m") / F.nullif("churn", F.lit(0.0)), 4).alias("ltv"))


@part.query("""WITH w AS (SELECT product_id, warehouse_id, arg_max(closing_stock, date) AS stock, max(date) AS date FROM inventory WHERE date <= DATE '2001-06-30' GROUP BY 1, 2), l AS (SELECT product_id, sum(stock) AS stock, max(date) AS snapshot FROM w GROUP BY 1),
s AS (SELECT product_id, coalesce(sum(quantity) FILTER (order_lines.date > snapshot), 0) AS since, max(order_lines.date) AS last_sale FROM l LEFT JOIN order_lines USING (product_id) GROUP BY 1)
SELECT product_id, greatest(stock - since, 0) AS live_stock, CASE WHEN greatest(stock - since, 0) <= 0 THEN 'rupture' WHEN greatest(stock - since, 0) <= reorder_point THEN 'low' ELSE 'ok' END AS alert, last_sale < DATE '2001-02-15' AS dormant FROM l JOIN s USING (product_id) JOIN products USING (product_id)""")
def c_stock_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stock at the last snapshot less what was sold since, against the reorder point."""
    i = latest_stock(cat.inventory(spark, sf_dir).filter("date <= DATE '2001-06-30'"))
    latest = i.groupBy("product_id").agg(F.sum("stock").alias("stock"), F.max("date").alias("snapshot"))
    o = cat.order_lines(spark, sf_dir).select("product_id", c("date").alias("sold_on"), "quantity")
    since = latest.join(o, "product_id", "left").groupBy("product_id", "stock").agg(F.coalesce(F.sum(F.when(c("sold_on") > c("snapshot"), c("quantity"))), F.lit(0.0)).alias("since"), F.max("sold_on").alias("last_sale"))
    live = F.greatest(c("stock") - c("since"), F.lit(0.0))
    p = cat.products(spark, sf_dir).select("product_id", "reorder_point")
    return since.join(p, "product_id").select("product_id", live.alias("live_stock"), F.when(live <= 0, "rupture").when(live <= c("reorder_point"), "low").otherwise("ok").alias("alert"), (c("last_sale") < "2001-02-15").alias("dormant"))


_ALERT_SQL = """WITH m AS (SELECT sum(subtotal) FILTER (date >= DATE '2001-05-01') AS a, sum(subtotal) FILTER (date < DATE '2001-05-01') AS b, sum(cost) FILTER (date >= DATE '2001-05-01') AS k, sum(cost) FILTER (date < DATE '2001-05-01') AS kb FROM order_lines WHERE status <> 'returned' AND date >= DATE '2001-02-01' AND date < DATE '2001-08-01'),
f AS (SELECT sum(cash_in - cash_out) / count(DISTINCT date_trunc('month', date)) AS net, any_value(opening_cash) + sum(cash_in - cash_out) AS cash FROM cashflow, balances),
w AS (SELECT sum(revenue) / nullif(sum(spend), 0) AS roas, sum(revenue) FILTER (date >= DATE '2024-01-16') / nullif(sum(spend) FILTER (date >= DATE '2024-01-16'), 0) AS now, sum(revenue) FILTER (date < DATE '2024-01-16') / nullif(sum(spend) FILTER (date < DATE '2024-01-16'), 0) AS before FROM campaign_days),
l AS (SELECT product_id, sum(q) AS q FROM (SELECT product_id, arg_max(closing_stock, date) AS q FROM inventory GROUP BY product_id, warehouse_id) GROUP BY 1), ls AS (SELECT product_id, max(date) AS last_sale, sum(subtotal) FILTER (status <> 'returned') AS rev FROM order_lines GROUP BY 1),
g AS (SELECT count(*) FILTER (coalesce(q, 0) <= 0) AS ruptures, count(*) FILTER (q > 0 AND q <= reorder_point) AS near, count(*) FILTER (last_sale < DATE '2001-02-15') AS dormant, max(rev) FILTER (coalesce(q, 0) <= 0) AS top, sum(rev) AS rev FROM products LEFT JOIN l USING (product_id) LEFT JOIN ls USING (product_id)),
k AS (SELECT count(*) FILTER (status <> 'actif') * 100.0 / count(*) AS churn, count(*) FILTER (status = 'actif' AND churn_risk >= 0.7) AS at_risk FROM customers), by_c AS (SELECT customer_id, max(date) AS last FROM order_lines GROUP BY 1), b AS (SELECT count(*) AS buyers, count(*) FILTER (last < DATE '2001-02-15') * 100.0 / nullif(count(*), 0) AS lapse FROM by_c),
s AS (SELECT *, (a - k.k) * 100 / a AS margin, (a - k.k) * 100 / a - (m.b - kb) * 100 / m.b AS delta, CASE WHEN m.b > 0 THEN (a - m.b) * 100 / m.b END AS sales, CASE WHEN before > 0 THEN (now - before) * 100 / before END AS roas_trend, CASE WHEN net < 0 THEN CASE WHEN cash <= 0 THEN 0 ELSE cash / -net END END AS runway FROM (SELECT a, b, kb FROM m) m, (SELECT k FROM m) k, f, w, g, (SELECT churn, at_risk FROM k) kk, (SELECT buyers, lapse FROM b) bb)"""

#: Alerts in order: name, severity, and when it fires, over the measures of `signals`. The first of a name that fires counts.
ALERTS = [
    ("runway", "critical", "runway < 3"), ("runway", "important", "runway < 6"), ("negative_cash", "critical", "cash < 0"), ("margin", "critical", "margin < 0"), ("margin", "important", "margin < 10"), ("margin_drop", "important", "delta < -5"),
    ("sales_drop", "critical", "sales < -20"), ("sales_drop", "important", "sales < -8"), ("ruptures", "critical", "ruptures >= 10"), ("ruptures", "important", "ruptures > 0"), ("near_rupture", "moderate", "near >= 10"), ("dormant_stock", "moderate", "dormant > 0"),
    ("churn", "critical", "churn >= 20"), ("churn", "important", "churn >= 10"), ("customers_at_risk", "important", "at_risk > 0"), ("lapsed_buyers", "important", "lapse >= 40 AND buyers >= 10"), ("roas", "critical", "roas < 1"), ("roas", "important", "roas_trend < -25"),
    ("marketing_hurts_margin", "critical", "roas_trend < -15 AND delta < -2"), ("rupture_of_a_top_seller", "critical", "rev > 0 AND top > rev * 0.02"), ("lapse_endangers_cash", "critical", "lapse >= 30 AND runway < 6"),
]
_NAMES = list(dict.fromkeys(n for n, _, _ in ALERTS))


def _severity(name: str) -> str:
    return "CASE " + " ".join(f"WHEN {when} THEN '{severity}'" for n, severity, when in ALERTS if n == name) + " ELSE 'none' END"


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of what the alerts look at, one aggregate an entity."""
    days = (c("date") >= "2001-02-01") & (c("date") < "2001-08-01")
    late = c("date") >= "2001-05-01"
    kept = c("status") != "returned"
    when = lambda w, x: F.sum(F.when(w, c(x)))
    o = cat.order_lines(spark, sf_dir)
    m = o.filter(days & kept).agg(when(late, "subtotal").alias("a"), when(~late, "subtotal").alias("b"), when(late, "cost").alias("k"), when(~late, "cost").alias("kb"))
    flow = cat.cashflow(spark, sf_dir).agg(F.sum(c("cash_in") - c("cash_out")).alias("sum"), F.countDistinct(F.trunc("date", "month")).alias("n")).crossJoin(cat.balances(spark, sf_dir))
    flow = flow.select((c("sum") / c("n")).alias("net"), (c("opening_cash") + c("sum")).alias("cash"))
    half = c("date") >= "2024-01-16"
    ratio = lambda w: when(w, "revenue") / F.nullif(when(w, "spend"), F.lit(0.0))
    w = cat.campaign_days(spark, sf_dir).agg(ratio(F.lit(True)).alias("roas"), ratio(half).alias("now"), ratio(~half).alias("before"))
    stock = latest_stock(cat.inventory(spark, sf_dir)).groupBy("product_id").agg(F.sum("stock").alias("q"))
    lines = cat.order_lines(spark, sf_dir, cost=False)
    sold = lines.groupBy("product_id").agg(F.max("date").alias("last_sale"), when(kept, "subtotal").alias("rev"))
    q = F.coalesce("q", F.lit(0.0))
    g = cat.products(spark, sf_dir).select("product_id", "reorder_point").join(stock, "product_id", "left").join(sold, "product_id", "left").agg(
        F.count_if(q <= 0).alias("ruptures"), F.count_if((q > 0) & (q <= c("reorder_point"))).alias("near"), F.count_if(c("last_sale") < "2001-02-15").alias("dormant"), F.max(F.when(q <= 0, c("rev"))).alias("top"), F.sum("rev").alias("rev")
    )
    k = cat.customers(spark, sf_dir).agg((F.count_if(c("status") != "actif") * 100.0 / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("churn"), F.count_if((c("status") == "actif") & (c("churn_risk") >= 0.7)).alias("at_risk"))
    b = lines.groupBy("customer_id").agg(F.max("date").alias("last")).agg(F.count(F.lit(1)).alias("buyers"), (F.count_if(c("last") < "2001-02-15") * 100.0 / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("lapse"))
    one = m.crossJoin(flow).crossJoin(w).crossJoin(g).crossJoin(k).crossJoin(b)  # rows of one
    margin = (c("a") - c("k")) * 100 / c("a")
    return one.withColumns({"margin": margin, "delta": margin - (c("b") - c("kb")) * 100 / c("b"), "sales": trend_pct(c("a"), c("b")), "roas_trend": trend_pct(c("now"), c("before")), "runway": F.when(c("net") < 0, F.when(c("cash") <= 0, 0.0).otherwise(c("cash") / -c("net")))})


@part.query(_ALERT_SQL + " SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS rule, {_severity(n)} AS severity FROM s" for n in _NAMES) + ")")
def c_live_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every alert with its severity, or none; the contradictions between sources are in c_contradictions."""
    cells = [F.struct(F.lit(n).alias("rule"), F.expr(_severity(n)).alias("severity")) for n in _NAMES]
    return signals(spark, sf_dir).select(F.explode(F.array(*cells)).alias("x")).select("x.*")


@part.query("""WITH a AS (SELECT sum(revenue) AS attributed, sum(conversions) AS conv, sum(new_customers) AS nc FROM campaign_days), b AS (SELECT sum(amount) FILTER (type = 'income') AS income, count(DISTINCT date_trunc('month', date)) AS months FROM transactions),
o AS (SELECT count(DISTINCT order_id) AS orders, sum(subtotal) FILTER (year(date) = 2000) AS rev2000, count(*) FILTER (date > DATE '2001-08-15') AS future, count(DISTINCT customer_id) AS acquired FROM order_lines),
p AS (SELECT sum(total_cost) AS payroll, count(DISTINCT employee_id) AS paid, count(*) AS slips, count(*) FILTER (total_cost < regular_pay + overtime + employer_cost - 0.01) * 1.0 / count(*) AS below FROM payroll), e AS (SELECT count(*) AS staff FROM employees),
f AS (SELECT sum(cash_in - cash_out) AS cash FROM cashflow), x AS (SELECT sum(amount) AS charges FROM expenses), r AS (SELECT cash, income - charges AS result, greatest(1000, 0.25 * income / months) AS least FROM f, b, x)
SELECT 'attributed_over_revenue' AS rule, 'critical' AS severity, round(attributed, 2) > round(income, 2) AS fires FROM a, b UNION ALL SELECT 'conversions_over_orders', 'important', conv > orders * 1.05 FROM a, o UNION ALL SELECT 'new_customers_over_acquired', 'important', nc > acquired * 1.05 FROM a, o
UNION ALL SELECT 'payroll_over_revenue', 'critical', payroll > rev2000 FROM p, o UNION ALL SELECT 'payroll_coverage', 'important', staff >= 10 AND paid < staff * 0.5 FROM p, e UNION ALL SELECT 'payroll_below_parts', 'important', slips >= 10 AND below >= 0.1 FROM p
UNION ALL SELECT 'future_rows', 'moderate', future > 0 FROM o UNION ALL SELECT 'treasury_against_result', 'important', sign(cash) <> sign(result) AND abs(cash) > least AND abs(result) > least FROM r""")
def c_contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight pairs of sources that cannot both be right."""
    a = cat.campaign_days(spark, sf_dir).agg(F.sum("revenue").alias("attributed"), F.sum("conversions").alias("conv"), F.sum("new_customers").alias("nc"))
    b = cat.transactions(spark, sf_dir).agg(F.sum(F.when(c("type") == "income", c("amount"))).alias("income"), F.countDistinct(F.trunc("date", "month")).alias("months"))
    lines = cat.order_lines(spark, sf_dir, cost=False)
    by_order = lines.groupBy("order_id", "customer_id").agg(F.sum(F.when(F.year("date") == 2000, c("subtotal"))).alias("v"), F.count_if(c("date") > cat.ORDERS_AS_OF).alias("future"))
    o = by_order.groupBy("customer_id").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("v"), F.sum("future").alias("future")).agg(F.sum("n").alias("orders"), F.sum("v").alias("rev2000"), F.sum("future").alias("future"), F.count("customer_id").alias("acquired"))
    parts = c("regular_pay") + c("overtime") + c("employer_cost")
    p = cat.payroll(spark, sf_dir).agg(F.sum("total_cost").alias("payroll"), F.countDistinct("employee_id").alias("paid"), F.count(F.lit(1)).alias("slips"), F.avg((c("total_cost") < parts - 0.01).cast("int")).alias("below"))
    e = cat.employees(spark, sf_dir).agg(F.count(F.lit(1)).alias("staff"))
    f = cat.cashflow(spark, sf_dir).agg(F.sum(c("cash_in") - c("cash_out")).alias("cash"))
    x = cat.expenses(spark, sf_dir).agg(F.sum("amount").alias("charges"))
    one = a.crossJoin(b).crossJoin(o).crossJoin(p).crossJoin(e).crossJoin(f).crossJoin(x)  # rows of one
    result, least = c("income") - c("charges"), F.greatest(F.lit(1000.0), 0.25 * c("income") / c("months"))
    rules = [
        ("attributed_over_revenue", "critical", F.round("attributed", 2) > F.round("income", 2)), ("conversions_over_orders", "important", c("conv") > c("orders") * 1.05), ("new_customers_over_acquired", "important", c("nc") > c("acquired") * 1.05),
        ("payroll_over_revenue", "critical", c("payroll") > c("rev2000")), ("payroll_coverage", "important", (c("staff") >= 10) & (c("paid") < c("staff") * 0.5)), ("payroll_below_parts", "important", (c("slips") >= 10) & (c("below") >= 0.1)),
        ("future_rows", "moderate", c("future") > 0), ("treasury_against_result", "important", (F.signum("cash") != F.signum(result)) & (F.abs("cash") > least) & (F.abs(result) > least)),
    ]
    return one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("rule"), F.lit(s).alias("severity"), v.alias("fires")) for k, s, v in rules))).alias("x")).select("x.*")


def ladder(v: Column, steps: list[tuple[float, int]], least: int, unknown: int = 50) -> Column:
    """Points of the first step that a value reaches, from the top; below all of them `least`."""
    out = F.when(v.isNull(), unknown)
    for at, points in steps:
        out = out.when(v >= at, points)
    return out.otherwise(least)


def with_trend(score: Column, pct: Column, bonus: int, penalty: int, threshold: float = 5.0) -> Column:
    """The score with what a trend adds or takes, within 0 and 100."""
    moved = F.when(pct > threshold, score + bonus).when(pct < -threshold, score - penalty).otherwise(score)
    return F.greatest(F.lit(0), F.least(F.lit(100), moved))


_LADDER = lambda v, steps, least: f"CASE WHEN {v} IS NULL THEN 50 {' '.join(f'WHEN {v} >= {a} THEN {p}' for a, p in steps)} ELSE {least} END"
_TREND = lambda s, t, b, p, th=5: f"greatest(0, least(100, CASE WHEN {t} > {th} THEN ({s}) + {b} WHEN {t} < -{th} THEN ({s}) - {p} ELSE ({s}) END))"
_MARGIN, _RUNWAY, _SALES, _ROAS = [(40, 88), (25, 72), (10, 52), (0, 32)], [(12, 90), (6, 75), (3, 55), (1, 35)], [(15, 85), (2, 70), (-2, 60), (-15, 48)], [(4, 88), (2, 72), (1, 50)]
_PCT = lambda a, b: f"CASE WHEN {b} > 0 THEN ({a} - {b}) * 100 / {b} END"


@part.query(f"""WITH m AS (SELECT sum(subtotal) FILTER (date >= DATE '2001-05-01') AS a, sum(cost) FILTER (date >= DATE '2001-05-01') AS ka, sum(subtotal) FILTER (date < DATE '2001-05-01') AS b, sum(cost) FILTER (date < DATE '2001-05-01') AS kb,
  sum(subtotal) FILTER (date >= DATE '2001-07-01') / count(DISTINCT order_id) FILTER (date >= DATE '2001-07-01') AS aov, sum(subtotal) FILTER (date BETWEEN DATE '2001-06-01' AND DATE '2001-06-30') / count(DISTINCT order_id) FILTER (date BETWEEN DATE '2001-06-01' AND DATE '2001-06-30') AS aov0
  FROM order_lines WHERE status <> 'returned' AND date >= DATE '2001-02-01' AND date < DATE '2001-08-01'), d AS (SELECT date, (SELECT opening_cash FROM balances) + sum(cash_in - cash_out) OVER (ORDER BY date) AS v, row_number() OVER (ORDER BY date DESC) AS i FROM cashflow),
t AS (SELECT avg(v) FILTER (i <= 7) AS c7, CASE WHEN count(*) >= 14 THEN avg(v) FILTER (i BETWEEN 8 AND 14) END AS p7, max(v) FILTER (i = 1) AS cash FROM d), n AS (SELECT sum(cash_in - cash_out) / count(DISTINCT date_trunc('month', date)) AS net FROM cashflow),
w AS (SELECT sum(revenue) / nullif(sum(spend), 0) AS roas, sum(revenue) FILTER (date >= DATE '2024-01-16') / nullif(sum(spend) FILTER (date >= DATE '2024-01-16'), 0) AS now, sum(revenue) FILTER (date < DATE '2024-01-16') / nullif(sum(spend) FILTER (date < DATE '2024-01-16'), 0) AS before FROM campaign_days),
l AS (SELECT product_id, sum(q) AS q FROM (SELECT product_id, arg_max(closing_stock, date) AS q FROM inventory GROUP BY product_id, warehouse_id) GROUP BY 1), ls AS (SELECT product_id, max(date) AS last_sale FROM order_lines GROUP BY 1),
g AS (SELECT count(*) FILTER (q <= reorder_point OR last_sale < DATE '2001-02-15') * 1.0 / nullif(count(*), 0) AS ratio FROM l JOIN products USING (product_id) LEFT JOIN ls USING (product_id)),
k AS (SELECT count(*) FILTER (status <> 'actif') * 100.0 / count(*) AS churn FROM customers), fo AS (SELECT min(date) AS first FROM order_lines GROUP BY customer_id), q AS (SELECT count(*) FILTER (first >= DATE '2001-05-01' AND first < DATE '2001-08-01') AS n3, count(*) FILTER (first >= DATE '2001-02-01' AND first < DATE '2001-05-01') AS p3 FROM fo),
s AS (SELECT 'finance' AS domain, a > 0 AS measured, {_TREND(_LADDER('((a - ka) * 100 / a)', _MARGIN, 15), '((a - ka) * 100 / a - (b - kb) * 100 / b)', 8, 12, 3)} AS score FROM m
UNION ALL SELECT 'treasury', cash IS NOT NULL, {_TREND("CASE WHEN cash > 0 AND net >= 0 THEN 92 ELSE " + _LADDER('(CASE WHEN cash <= 0 THEN 0 ELSE cash / -net END)', _RUNWAY, 18) + " END", _PCT('c7', 'p7'), 6, 10, 2)} FROM t, n
UNION ALL SELECT 'sales', b > 0, {_TREND(_LADDER(f"({_PCT('a', 'b')})", _SALES, 28), _PCT('aov', 'aov0'), 6, 6)} FROM m UNION ALL SELECT 'marketing', roas IS NOT NULL, {_TREND(_LADDER('roas', _ROAS, 28), _PCT('now', 'before'), 6, 10)} FROM w
UNION ALL SELECT 'operations', ratio IS NOT NULL, CASE WHEN ratio IS NULL THEN 50 WHEN ratio = 0 THEN 82 WHEN ratio < 0.1 THEN 68 WHEN ratio < 0.25 THEN 48 ELSE 28 END FROM g
UNION ALL SELECT 'customers', churn IS NOT NULL, {_TREND('CASE WHEN churn IS NULL THEN 50 WHEN churn < 5 THEN 85 WHEN churn < 10 THEN 70 WHEN churn < 20 THEN 50 ELSE 30 END', _PCT('n3', 'p3'), 8, 8)} FROM k, q)
SELECT domain, measured, score FROM s UNION ALL SELECT 'overall', bool_or(measured), CAST(floor(avg(score) FILTER (measured) + 0.5) AS INT) FROM s""")
def c_domain_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six domains: a ladder, and what the trend adds or takes; unknown is a neutral 50. The overall score is the mean of what
    is measured."""
    days = lambda a, b: (c("date") >= a) & (c("date") < b)
    part_of = lambda x, w: F.sum(F.when(w, c(x)))
    late, early = days("2001-05-01", "2001-08-01"), days("2001-02-01", "2001-05-01")
    o = cat.order_lines(spark, sf_dir).filter(c("status") != "returned").filter(days("2001-02-01", "2001-08-01"))
    by_order = o.groupBy("order_id").agg(F.min("date").alias("date"), F.sum("subtotal").alias("v"), F.sum("cost").alias("k"))
    now, before = days("2001-07-01", "2001-08-01"), days("2001-06-01", "2001-07-01")
    m = by_order.agg(part_of("v", late).alias("a"), part_of("k", late).alias("ka"), part_of("v", early).alias("b"), part_of("k", early).alias("kb"), (part_of("v", now) / F.nullif(F.count_if(now), F.lit(0))).alias("aov"), (part_of("v", before) / F.nullif(F.count_if(before), F.lit(0))).alias("aov0")).persist()  # one row, of two domains
    margin, prior = (c("a") - c("ka")) * 100 / c("a"), (c("b") - c("kb")) * 100 / c("b")
    flow = cat.cashflow(spark, sf_dir)
    net = c("cash_in") - c("cash_out")
    d = flow.crossJoin(cat.balances(spark, sf_dir)).select((c("opening_cash") + F.sum(net).over(Window.orderBy("date"))).alias("v"), F.row_number().over(Window.orderBy(F.desc("date"))).alias("i"))  # one row a day
    t = d.agg(F.avg(F.when(c("i") <= 7, c("v"))).alias("c7"), F.when(F.count(F.lit(1)) >= 14, F.avg(F.when(c("i").between(8, 14), c("v")))).alias("p7"), F.max(F.when(c("i") == 1, c("v"))).alias("cash")).crossJoin(flow.agg((F.sum(net) / F.countDistinct(F.trunc("date", "month"))).alias("net")))
    runway = F.when(c("cash") <= 0, 0.0).otherwise(c("cash") / -c("net"))
    treasury = F.when((c("cash") > 0) & (c("net") >= 0), 92).otherwise(ladder(runway, _RUNWAY, 18))
    half = c("date") >= "2024-01-16"
    ratio = lambda w: part_of("revenue", w) / F.nullif(part_of("spend", w), F.lit(0.0))
    w = cat.campaign_days(spark, sf_dir).agg(ratio(F.lit(True)).alias("roas"), ratio(half).alias("now"), ratio(~half).alias("before"))
    stock = latest_stock(cat.inventory(spark, sf_dir)).groupBy("product_id").agg(F.sum("stock").alias("q"))
    sold = cat.order_lines(spark, sf_dir, cost=False).groupBy("product_id").agg(F.max("date").alias("last_sale"))
    g = stock.join(cat.products(spark, sf_dir).select("product_id", "reorder_point"), "product_id").join(sold, "product_id", "left").agg((F.count_if((c("q") <= c("reorder_point")) | (c("last_sale") < "2001-02-15")) / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("r"))
    k = cat.customers(spark, sf_dir).agg((F.count_if(c("status") != "actif") * 100.0 / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("churn"))
    first = cat.order_lines(spark, sf_dir, cost=False).groupBy("customer_id").agg(F.min("date").alias("date"))
    q = k.crossJoin(first.agg(F.count_if(late).alias("n3"), F.count_if(early).alias("p3")))
    churn, r = c("churn"), c("r")
    rows = [
        (m, "finance", c("a") > 0, with_trend(ladder(margin, _MARGIN, 15), margin - prior, 8, 12, 3.0)), (t, "treasury", c("cash").isNotNull(), with_trend(treasury, trend_pct(c("c7"), c("p7")), 6, 10, 2.0)),
        (m, "sales", c("b") > 0, with_trend(ladder(trend_pct(c("a"), c("b")), _SALES, 28), trend_pct(c("aov"), c("aov0")), 6, 6)), (w, "marketing", c("roas").isNotNull(), with_trend(ladder(c("roas"), _ROAS, 28), trend_pct(c("now"), c("before")), 6, 10)),
        (g, "operations", r.isNotNull(), F.when(r.isNull(), 50).when(r == 0, 82).when(r < 0.1, 68).when(r < 0.25, 48).otherwise(28)),
        (q, "customers", churn.isNotNull(), with_trend(F.when(churn.isNull(), 50).when(churn < 5, 85).when(churn < 10, 70).when(churn < 20, 50).otherwise(30), trend_pct(c("n3"), c("p3")), 8, 8)),
    ]
    s = reduce(DataFrame.unionAll, (df.select(F.lit(n).alias("domain"), F.coalesce(known, F.lit(False)).alias("measured"), score.cast("int").alias("score")) for df, n, known, score in rows)).persist()  # six rows, read twice
    return s.unionAll(s.agg(F.lit("overall").alias("domain"), F.max("measured").alias("measured"), F.floor(F.avg(F.when(c("measured"), c("score"))) + 0.5).cast("int").alias("score")))


@part.query("WITH b AS (SELECT sum(subtotal) AS r, sum(cost) AS k FROM order_lines WHERE status <> 'returned'), s AS (SELECT * FROM (VALUES (0.0, 0.0, 0.0), (5.0, 0.0, 0.0), (0.0, 10.0, 0.0), (5.0, -5.0, 10.0)) AS t(price, volume, expense)) SELECT price::DOUBLE AS price, volume::DOUBLE AS volume, expense::DOUBLE AS expense, round(r * (1 + price / 100) * (1 + volume / 100) - k * (1 + volume / 100 * 0.6) * (1 + expense / 100), 2) AS profit FROM b, s")
def c_simulator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What if prices, volume and expenses change by so many percent, with 60 % of costs variable."""
    b = cat.order_lines(spark, sf_dir).filter("status <> 'returned'").agg(F.sum("subtotal").alias("r"), F.sum("cost").alias("k"))
    cases = spark.createDataFrame([(0.0, 0.0, 0.0), (5.0, 0.0, 0.0), (0.0, 10.0, 0.0), (5.0, -5.0, 10.0)], "price double, volume double, expense double")
    profit = c("r") * (1 + c("price") / 100) * (1 + c("volume") / 100) - c("k") * (1 + c("volume") / 100 * 0.6) * (1 + c("expense") / 100)
    return cases.crossJoin(F.broadcast(b)).select("price", "volume", "expense", F.round(profit, 2).alias("profit"))


@part.query("SELECT product_id, round((selling_price - purchase_cost) * 100 / selling_price, 4) AS margin FROM products WHERE (selling_price - purchase_cost) * 100 / selling_price < 45 ORDER BY selling_price DESC, product_id LIMIT 10")
def c_low_margin_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    margin = (c("selling_price") - c("purchase_cost")) * 100 / c("selling_price")
    return cat.products(spark, sf_dir).filter(margin < 45).orderBy(F.desc("selling_price"), "product_id").limit(10).select("product_id", F.round(margin, 4).alias("margin"))


#: The snapshot's indicators; those that add up, and three more, are told for all three periods, the others for the whole.
SNAPSHOT = ["total_revenue", "total_expense", "payroll_total", "ebitda", "net_income", "order_revenue", "cogs_total", "gross_margin_amount", "order_count", "gross_sales", "returns_amount", "gross_margin_pct", "aov", "return_rate", "churn_rate", "arpu", "roas", "cac", "inventory_value_total", "cash_runway"]
BY_PERIOD = SNAPSHOT[:14]
_SPANS = {"total": (None, None), "three months": ("2001-05-01", "2001-07-31"), "month": ("2001-07-01", "2001-07-31")}


@part.query("SELECT * FROM (" + ") UNION ALL SELECT * FROM (".join(f"SELECT '{n}' AS period, kpi, value, status FROM ({kpis._all_sql(*span)}) WHERE kpi IN ({', '.join(repr(k) for k in (SNAPSHOT if n == 'total' else BY_PERIOD))})" for n, span in _SPANS.items()) + ")")
def c_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty indicators over the whole, fourteen over the last three complete months and the last one."""
    frames = cat.frames(spark, sf_dir)
    one = lambda name, span, ids: kpis.compute(spark, frames, *span, ids=ids).select(F.lit(name).alias("period"), "kpi", "value", "status")
    return reduce(DataFrame.unionAll, (one(n, span, SNAPSHOT if n == "total" else BY_PERIOD) for n, span in _SPANS.items()))
