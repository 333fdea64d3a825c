"""Seventeen checks between sources that describe the same things, and the context that links them.

A gap is in percent of the larger side; a count is of rows that disagree. Each check is a one-row frame of (n compared, value);
without anything to compare its verdict is 'skip'.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.money import RATES
from ..functions.parsing import NEGATIVE, POSITIVE, TOPICS, issues
from ..sources import catalog as cat
from .base import Part

part = Part()
c = F.col

#: Check -> (over which value it warns, over which it is an error); counts only warn, shares of rows are in percent.
LIMITS = {
    "revenue_two_ways": (5, 20), "cash_against_balance": (2, 10), "in_less_out": (0, 5), "profit": (0, 5), "order_customers": (0, None), "order_and_stock_products": (0, None), "payroll_employees": (0, None), "campaign_totals": (5, 25), "customer_total": (5, None),
    "expenses_against_cash_out": (15, 40), "customer_revenue": (0, None), "prices": (0, None), "stock_cost": (0, None), "branches": (0, None), "budgets": (0, None), "summaries": (0, None), "currencies": (0, None),
}


def gap(a: Column, b: Column) -> Column:
    most = F.greatest(F.abs(a), F.abs(b))
    return F.when(most > 0, F.abs(a - b) * 100 / most).otherwise(F.when(a.isNotNull() & b.isNotNull(), 0.0))


def _differ(a: Column, b: Column) -> Column:
    return F.abs(a - b) > F.greatest(F.lit(0.01), F.abs(b) * 0.01)


def _bad(df: DataFrame, wrong: Column) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_if(wrong).cast("double").alias("value"))


def _share(df: DataFrame, wrong: Column) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"), (F.count_if(wrong) * 100.0 / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("value"))


def _orphans(df: DataFrame, key: str, known: DataFrame) -> DataFrame:
    """Rows (k of each) whose key is not known; keys are grouped first, so that none is joined more than once."""
    keys = df.filter(c(key).isNotNull()).groupBy(key).agg(F.sum("k").alias("k"))
    marked = keys.join(known.select(key, F.lit(1).alias("hit")).distinct(), key, "left")
    return marked.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(c("hit").isNull(), c("k"))), F.lit(0)).cast("double").alias("value"))


def _gap_sql(a: str, b: str) -> str:
    return f"CASE WHEN greatest(abs({a}), abs({b})) > 0 THEN abs({a} - {b}) * 100 / greatest(abs({a}), abs({b})) WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN 0 END"


def _differ_sql(a: str, b: str) -> str:
    return f"abs({a} - {b}) > greatest(0.01, abs({b}) * 0.01)"


_SQL = f"""WITH li AS (SELECT *, total - cost AS gross_profit, product_id % 4 AS location, supplier_id AS employee_id FROM order_lines), heads AS (SELECT o_custkey AS customer_id, sum(o_totalprice) AS said FROM orders GROUP BY 1),
fl AS (SELECT date, cash_in, cash_out, cash_in - cash_out AS net, (SELECT opening_cash FROM balances) + sum(cash_in - cash_out) OVER (ORDER BY date) AS closing FROM cashflow), fp AS (SELECT *, lag(date) OVER (ORDER BY date) AS d0, lag(closing) OVER (ORDER BY date) AS c0 FROM fl),
ca AS (SELECT user_id % 6 AS campaign_id, count(*) FILTER (event_type = 'click') * 25.0 AS spend, count(*) FILTER (event_type = 'view') * 20.0 AS budget FROM events GROUP BY 1), cd AS (SELECT campaign_id, sum(spend) AS spend, count(*) AS days FROM campaign_days GROUP BY 1),
cu AS (SELECT customer_id, sum(total) AS v FROM li GROUP BY 1), su AS (SELECT supplier_id % 4 AS loc, sum(quantity * unit_price) AS said, sum(subtotal) AS v FROM li GROUP BY 1), cur AS (SELECT count(DISTINCT currency) AS k, count(*) FILTER (currency NOT IN ({', '.join(repr(x) for x in RATES)})) AS left_out FROM transactions),
v AS (SELECT 'revenue_two_ways' AS name, count(*) AS n, {_gap_sql('sum(total)', '(SELECT sum(o_totalprice) FROM orders)')} AS value FROM li
UNION ALL SELECT 'cash_against_balance', count(*), {_gap_sql('sum(net)', 'sum(closing - c0)')} FROM fp WHERE date_diff('day', d0, date) = 1 UNION ALL SELECT 'in_less_out', count(*), count(*) FILTER (abs(cash_in - cash_out - net) > greatest(1, abs(cash_in - cash_out) * 0.02)) * 100.0 / nullif(count(*), 0) FROM fl
UNION ALL SELECT 'profit', count(*), count(*) FILTER (abs(subtotal - cost - gross_profit) > greatest(1, abs(subtotal - cost) * 0.05)) * 100.0 / nullif(count(*), 0) FROM li
UNION ALL SELECT 'order_customers', count(*), count(*) FILTER (customer_id NOT IN (SELECT customer_id FROM customers)) FROM li
UNION ALL SELECT 'order_and_stock_products', count(*), count(*) FILTER (product_id NOT IN (SELECT product_id FROM products)) FROM (SELECT product_id FROM li UNION ALL SELECT product_id FROM inventory)
UNION ALL SELECT 'payroll_employees', count(*), count(*) FILTER (employee_id NOT IN (SELECT employee_id FROM employees)) FROM payroll
UNION ALL SELECT 'campaign_totals', count(*), CASE WHEN sum(days) >= 15 * count(*) THEN {_gap_sql('sum(ca.spend)', 'sum(cd.spend)')} END FROM ca JOIN cd USING (campaign_id)
UNION ALL SELECT 'customer_total', count(*), {_gap_sql('sum(said)', '(SELECT sum(total) FROM li)')} FROM heads
UNION ALL SELECT 'expenses_against_cash_out', count(*), {_gap_sql('sum(x)', 'sum(o)')} FROM (SELECT date_trunc('month', date) AS m, sum(amount) AS x FROM expenses GROUP BY 1) JOIN (SELECT date_trunc('month', date) AS m, sum(cash_out) AS o FROM cashflow GROUP BY 1) USING (m)
UNION ALL SELECT 'customer_revenue', count(*), count(*) FILTER ({_gap_sql('said', 'v')} > 5) FROM heads JOIN cu USING (customer_id)
UNION ALL SELECT 'prices', count(*), count(*) FILTER ({_differ_sql('unit_price', 'selling_price')}) FROM li JOIN products USING (product_id)
UNION ALL SELECT 'stock_cost', count(*), count(*) FILTER ({_differ_sql('inventory_value / closing_stock', 'purchase_cost')}) FROM inventory JOIN products USING (product_id) WHERE closing_stock > 0
UNION ALL SELECT 'branches', count(*), count(*) FILTER (location <> branch) FROM li JOIN employees USING (employee_id) UNION ALL SELECT 'budgets', count(*), count(*) FILTER (spend > budget + 0.01) FROM ca WHERE budget > 0
UNION ALL SELECT 'summaries', count(*), count(*) FILTER ({_gap_sql('said', 'v')} > 1) FROM su UNION ALL SELECT 'currencies', k, CASE WHEN k > 1 THEN left_out ELSE 0 END FROM cur),
lim(name, w, e) AS (VALUES {', '.join(f"('{k}', {w}, {'NULL' if e is None else e})" for k, (w, e) in LIMITS.items())})
SELECT name AS "check", n, round(CAST(value AS DOUBLE), 4) AS value, CASE WHEN n = 0 OR value IS NULL THEN 'skip' WHEN value > e THEN 'error' WHEN value > w THEN 'warn' ELSE 'ok' END AS verdict FROM v JOIN lim USING (name)"""


@part.query(_SQL)
def q_coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All checks, over the tables' order lines and headers, cash, campaigns, customers, stock, staff and summaries."""
    o = cat.order_lines(spark, sf_dir)
    products = cat.products(spark, sf_dir).select("product_id", "selling_price", "purchase_cost")
    heads = cat.table(spark, sf_dir, "orders").groupBy(c("o_custkey").alias("customer_id")).agg(F.sum("o_totalprice").alias("said"))
    headed = heads.agg(F.sum("said").alias("said"), F.count(F.lit(1)).alias("n"))
    profit, none = c("subtotal") - c("cost"), F.lit(None).cast("long")
    wrong_profit = F.abs(profit - (c("total") - c("cost"))) > F.greatest(F.lit(1.0), F.abs(profit) * 0.05)
    # one pass over the lines by customer, by product, and by seller and place: sums that are small beside the lines, and read several times
    keys = [F.struct(F.lit(name).alias("of"), a.alias("a"), b.alias("b")) for name, a, b in (("customer", c("customer_id"), none), ("product", c("product_id"), none), ("seller", c("supplier_id"), c("product_id") % 4))]
    sold = o.select(F.explode(F.array(*keys)).alias("key"), "total", "subtotal", (c("quantity") * c("unit_price")).alias("said"), wrong_profit.alias("wrong"))
    sums = sold.groupBy("key.of", "key.a", "key.b").agg(F.count(F.lit(1)).alias("k"), F.sum("total").alias("v"), F.count_if("wrong").alias("bad"), F.sum("said").alias("said"), F.sum("subtotal").alias("net")).persist()
    by_customer, by_product, by_seller = (sums.filter(c("of") == name).withColumnsRenamed({"a": a, "b": "location"}) for name, a in (("customer", "customer_id"), ("product", "product_id"), ("seller", "supplier_id")))
    lines = by_customer.agg(F.sum("v").alias("v"), F.sum("k").alias("k"), F.sum("bad").alias("bad")).crossJoin(headed)
    flow = cat.cashflow(spark, sf_dir).crossJoin(cat.balances(spark, sf_dir)).withColumn("net", c("cash_in") - c("cash_out"))
    day = Window.orderBy("date")  # one row a day
    flow = flow.withColumn("closing", c("opening_cash") + F.sum("net").over(day)).withColumns({"d0": F.lag("date").over(day)}).withColumn("c0", F.lag("closing").over(day))
    e = cat.table(spark, sf_dir, "events")
    campaigns = e.groupBy((c("user_id") % 6).alias("campaign_id")).agg((F.count_if(c("event_type") == "click") * 25.0).alias("spend"), (F.count_if(c("event_type") == "view") * 20.0).alias("budget"))
    days = cat.campaign_days(spark, sf_dir).groupBy("campaign_id").agg(F.sum("spend").alias("daily"), F.count(F.lit(1)).alias("days"))
    known = campaigns.join(days, "campaign_id").agg(F.count(F.lit(1)).alias("n"), F.sum("spend").alias("a"), F.sum("daily").alias("b"), F.sum("days").alias("days"))
    month = F.trunc("date", "month")
    paid = cat.expenses(spark, sf_dir).groupBy(month.alias("m")).agg(F.sum("amount").alias("x")).join(cat.cashflow(spark, sf_dir).groupBy(month.alias("m")).agg(F.sum("cash_out").alias("y")), "m")
    stock = cat.inventory(spark, sf_dir).persist()
    all_products = by_product.select("product_id", "k").unionAll(stock.groupBy("product_id").agg(F.count(F.lit(1)).alias("k")))
    staff = cat.employees(spark, sf_dir).select("employee_id", "branch")
    sellers = by_seller.select(c("supplier_id").alias("employee_id"), "location", "k").join(staff, "employee_id")
    places = by_seller.groupBy((c("supplier_id") % 4).alias("loc")).agg(F.sum("said").alias("said"), F.sum("net").alias("v"))
    money = cat.transactions(spark, sf_dir).agg(F.countDistinct("currency").alias("n"), F.count_if(~c("currency").isin(*RATES)).alias("left_out"))
    checks = {
        "revenue_two_ways": lines.select(c("k").alias("n"), gap(c("v"), c("said")).alias("value")),
        "cash_against_balance": flow.filter("datediff(date, d0) = 1").agg(F.count(F.lit(1)).alias("n"), gap(F.sum("net"), F.sum(c("closing") - c("c0"))).alias("value")),
        "in_less_out": _share(flow, F.abs(c("cash_in") - c("cash_out") - c("net")) > F.greatest(F.lit(1.0), F.abs(c("cash_in") - c("cash_out")) * 0.02)),
        "profit": lines.select(c("k").alias("n"), (c("bad") * 100.0 / F.nullif("k", F.lit(0))).alias("value")),
        "order_customers": _orphans(by_customer, "customer_id", cat.customers(spark, sf_dir)), "order_and_stock_products": _orphans(all_products, "product_id", products), "payroll_employees": _orphans(cat.payroll(spark, sf_dir).withColumn("k", F.lit(1).cast("long")), "employee_id", staff),
        "campaign_totals": known.select("n", F.when(c("days") >= 15 * c("n"), gap(c("a"), c("b"))).alias("value")), "customer_total": lines.select("n", gap(c("said"), c("v")).alias("value")),
        "expenses_against_cash_out": paid.agg(F.count(F.lit(1)).alias("n"), gap(F.sum("x"), F.sum("y")).alias("value")), "customer_revenue": _bad(heads.join(by_customer.select("customer_id", "v"), "customer_id"), gap(c("said"), c("v")) > 5),
        "prices": _bad(o.select("product_id", "unit_price").join(products, "product_id"), _differ(c("unit_price"), c("selling_price"))),
        "stock_cost": _bad(stock.filter("closing_stock > 0").join(products, "product_id"), _differ(c("inventory_value") / c("closing_stock"), c("purchase_cost"))),
        "branches": sellers.agg(F.sum("k").alias("n"), F.coalesce(F.sum(F.when(c("location") != c("branch"), c("k"))), F.lit(0)).cast("double").alias("value")), "budgets": _bad(campaigns.filter("budget > 0"), c("spend") > c("budget") + 0.01),
        "summaries": _bad(places, gap(c("said"), c("v")) > 1), "currencies": money.select("n", F.when(c("n") > 1, c("left_out")).otherwise(0).cast("double").alias("value")),
    }

    def told(name: str, df: DataFrame) -> DataFrame:
        warn, error = LIMITS[name]
        v = c("value")
        said = F.when((c("n") == 0) | c("n").isNull() | v.isNull(), "skip")
        said = said if error is None else said.when(v > error, "error")
        return df.select(F.lit(name).alias("check"), F.coalesce(c("n"), F.lit(0)).cast("long").alias("n"), F.round(v.cast("double"), 4).alias("value"), said.when(v > warn, "warn").otherwise("ok").alias("verdict"))

    return reduce(DataFrame.unionAll, (told(k, df) for k, df in checks.items()))


def _has(words: list[str]) -> str:
    return "(" + " + ".join(f"CAST(contains(lower(text), '{w}') AS INT)" for w in words) + ")"


_PRICE = "(" + " OR ".join(f"contains(lower(text), '{w}')" for w in TOPICS["price"]) + ")"


@part.query(f"""WITH p AS (SELECT count(*) FILTER ({_has(POSITIVE)} - {_has(NEGATIVE)} < 0 AND {_PRICE}) AS complaints FROM remarks), r AS (SELECT sum(subtotal) AS revenue FROM order_lines), d AS (SELECT count(*) FILTER (event_type = 'error' AND value - 50 < 0) AS drops FROM events)
SELECT 'association' AS kind, 'qualitative.price_sensitivity' AS primary_concept, 'finance.revenue' AS secondary_concept, least(1.0, complaints / 10.0)::DOUBLE AS strength FROM p, r WHERE complaints > 0 AND revenue IS NOT NULL
UNION ALL SELECT 'temporal', 'external.competitor_price_change', 'finance.revenue', 0.8 FROM d WHERE drops > 0 UNION ALL SELECT 'causal_candidate', 'external.competitor_pricing', 'qualitative.price_sensitivity', 0.95 FROM p, d WHERE drops > 0 AND complaints > 0""")
def c_context_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rules that link complaints about prices, revenue, and signals that a competitor's price fell (errors here stand
    for those signals, 50 for the price before)."""
    p = cat.remarks(spark, sf_dir).agg(F.count_if(F.array_contains(issues(c("text")), "price_sensitivity")).alias("complaints"))
    r = cat.order_lines(spark, sf_dir, cost=False).agg(F.sum("subtotal").alias("revenue"))
    d = cat.table(spark, sf_dir, "events").agg(F.count_if((c("event_type") == "error") & (c("value") - 50 < 0)).alias("drops"))
    one = p.crossJoin(r).crossJoin(d)  # rows of one
    row = lambda ok, kind, a, b, strength: F.when(ok, F.struct(F.lit(kind).alias("kind"), F.lit(a).alias("primary_concept"), F.lit(b).alias("secondary_concept"), strength.alias("strength")))
    complains, drops = c("complaints") > 0, c("drops") > 0
    rows = F.array_compact(F.array(
        row(complains & c("revenue").isNotNull(), "association", "qualitative.price_sensitivity", "finance.revenue", F.least(F.lit(1.0), c("complaints") / 10.0)), row(drops, "temporal", "external.competitor_price_change", "finance.revenue", F.lit(0.8)),
        row(drops & complains, "causal_candidate", "external.competitor_pricing", "qualitative.price_sensitivity", F.lit(0.95)),
    ))
    return one.select(F.explode(rows).alias("x")).select("x.*")
