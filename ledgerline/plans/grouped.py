"""Grouped aggregates: monthly series, profit and loss, rankings, distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.parsing import NEGATIVE, POSITIVE, sentiment
from ..functions.periods import balances_per_month, cash_per_month, complete_months, densify, latest_stock, month
from ..sources import catalog as cat
from .base import Part

part = Part()
c = F.col

#: Complete months of order data: those before the month of the reference date.
_MONTHS = "date < DATE '2001-08-01'"


@part.query("SELECT date_trunc('month', date)::DATE AS month, round(sum(subtotal), 4) AS revenue, count(*) AS n_lines, count(DISTINCT order_id) AS n_orders, round(arg_max(subtotal, (date, order_id, line_no, subtotal)), 4) AS last_amount FROM order_lines GROUP BY 1")
def b_monthly_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = cat.order_lines(spark, sf_dir)
    return o.groupBy(month("date").alias("month")).agg(F.round(F.sum("subtotal"), 4).alias("revenue"), F.count(F.lit(1)).alias("n_lines"), F.countDistinct("order_id").alias("n_orders"), F.round(F.max_by("subtotal", F.struct("date", "order_id", "line_no", "subtotal")), 4).alias("last_amount"))


def _complete_revenue(lines: DataFrame) -> DataFrame:
    monthly = lines.groupBy(month("date").alias("month")).agg(F.sum("subtotal").alias("revenue"))
    return densify(complete_months(monthly, cat.ORDERS_AS_OF), "revenue", until="2001-07-01")


@part.query("""WITH m AS (SELECT date_trunc('month', date)::DATE AS month, sum(subtotal) AS v FROM order_lines WHERE date < DATE '2001-08-01' GROUP BY 1),
cal AS (SELECT unnest(generate_series((SELECT min(month) FROM m), DATE '2001-07-01', INTERVAL 1 MONTH))::DATE AS month)
SELECT month, round(coalesce(v, 0), 4) AS revenue FROM cal LEFT JOIN m USING (month)""")
def b_complete_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly revenue of all products, the running month left out and gaps filled with zero."""
    return _complete_revenue(cat.order_lines(spark, sf_dir)).select("month", F.round("revenue", 4).alias("revenue"))


@part.query("SELECT order_id, round(sum(subtotal), 4) AS amount, sum(quantity) AS quantity, min(date) AS date FROM order_lines GROUP BY 1")
def b_one_row_per_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines without an order id would stay apart; here all have one."""
    o = cat.order_lines(spark, sf_dir)
    with_id = o.filter("order_id IS NOT NULL").groupBy("order_id").agg(F.sum("subtotal").alias("amount"), F.sum("quantity").alias("quantity"), F.min("date").alias("date"))
    alone = o.filter("order_id IS NULL").select("order_id", c("subtotal").alias("amount"), "quantity", "date")
    return with_id.unionAll(alone).withColumn("amount", F.round("amount", 4))


@part.query("""WITH r AS (SELECT date_trunc('month', date)::DATE AS month, sum(amount) FILTER (type = 'income') AS income, sum(amount) FILTER (type = 'expense') AS expense FROM transactions GROUP BY 1),
x AS (SELECT date_trunc('month', date)::DATE AS month, sum(amount) AS booked FROM expenses GROUP BY 1)
SELECT month, round(income, 2) AS income, round(expense, 2) AS expense, round(booked, 2) AS booked, round(coalesce(income, 0) - coalesce(expense, 0), 2) AS margin, income IS NOT NULL AS measured FROM r FULL JOIN x USING (month)""")
def b_monthly_finance(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = cat.transactions(spark, sf_dir).groupBy(month("date").alias("month")).agg(F.sum(F.when(c("type") == "income", c("amount"))).alias("income"), F.sum(F.when(c("type") == "expense", c("amount"))).alias("expense"))
    x = cat.expenses(spark, sf_dir).groupBy(month("date").alias("month")).agg(F.sum("amount").alias("booked"))
    both = t.join(x, "month", "full")
    zero = lambda n: F.coalesce(n, F.lit(0.0))
    return both.select("month", *(F.round(n, 2).alias(n) for n in ("income", "expense", "booked")), F.round(zero(c("income")) - zero(c("expense")), 2).alias("margin"), c("income").isNotNull().alias("measured"))


@part.query("""WITH m AS (SELECT date_trunc('month', date)::DATE AS month, sum(subtotal) FILTER (status <> 'returned') AS revenue, count(DISTINCT order_id) FILTER (status <> 'returned') AS orders FROM order_lines WHERE date < DATE '2001-08-01' GROUP BY 1)
SELECT month, round(revenue, 4) AS revenue, orders, round(revenue / nullif(orders, 0), 6) AS aov FROM m""")
def b_monthly_kpi_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = cat.order_lines(spark, sf_dir).filter(_MONTHS)
    ok = c("status") != "returned"
    m = o.groupBy(month("date").alias("month")).agg(F.sum(F.when(ok, c("subtotal"))).alias("revenue"), F.countDistinct(F.when(ok, c("order_id"))).alias("orders"))
    return m.select("month", F.round("revenue", 4).alias("revenue"), "orders", F.round(c("revenue") / F.nullif("orders", F.lit(0)), 6).alias("aov"))


@part.query("SELECT date, round(cash_in - cash_out, 2) AS net, round(sum(cash_in - cash_out) OVER (ORDER BY date), 2) AS balance FROM cashflow")
def b_treasury_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily net flow and the balance carried forward; one row a day of history, so one sorted window."""
    f = cat.cashflow(spark, sf_dir)
    net = c("cash_in") - c("cash_out")
    return f.select("date", F.round(net, 2).alias("net"), F.round(F.sum(net).over(Window.orderBy("date")), 2).alias("balance"))


@part.query("SELECT date_trunc('month', date)::DATE AS month, round(sum(cash_in - cash_out), 2) AS net_flow FROM cashflow GROUP BY 1")
def b_cash_per_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat.cashflow(spark, sf_dir).groupBy(month("date").alias("month")).agg(F.round(F.sum(c("cash_in") - c("cash_out")), 2).alias("net_flow"))


@part.query("""WITH s AS (SELECT supplier_id % 4 AS branch, sum(subtotal) AS revenue, sum(cost) AS cogs FROM order_lines WHERE status <> 'returned' GROUP BY 1),
e AS (SELECT branch, sum(total_employer_cost) AS staff FROM employees WHERE status = 'actif' GROUP BY 1),
a AS (SELECT branch, sum(net_book_value * CASE WHEN dpa_rate > 1 THEN dpa_rate / 100 ELSE dpa_rate END) AS dep FROM assets GROUP BY 1)
SELECT branch, round(revenue, 2) AS revenue, round(cogs, 2) AS cogs, round(staff, 2) AS staff, round(dep, 2) AS depreciation, round(coalesce(revenue, 0) - coalesce(cogs, 0) - coalesce(staff, 0), 2) AS ebitda,
  round(coalesce(revenue, 0) - coalesce(cogs, 0) - coalesce(staff, 0) - coalesce(dep, 0), 2) AS ebit, round((coalesce(revenue, 0) - coalesce(cogs, 0) - coalesce(staff, 0)) * 100 / nullif(revenue, 0), 2) AS margin_pct
FROM s FULL JOIN e USING (branch) FULL JOIN a USING (branch)""")
def b_branch_profit_and_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.money import depreciation_rate

    s = cat.order_lines(spark, sf_dir).filter("status <> 'returned'").groupBy((c("supplier_id") % 4).alias("branch")).agg(F.sum("subtotal").alias("revenue"), F.sum("cost").alias("cogs"))
    e = cat.employees(spark, sf_dir).filter("status = 'actif'").groupBy("branch").agg(F.sum("total_employer_cost").alias("staff"))
    a = cat.assets(spark, sf_dir).groupBy("branch").agg(F.sum(c("net_book_value") * depreciation_rate(c("dpa_rate"))).alias("depreciation"))
    z = {n: F.coalesce(c(n), F.lit(0.0)) for n in ("revenue", "cogs", "staff", "depreciation")}
    ebitda = z["revenue"] - z["cogs"] - z["staff"]
    return s.join(e, "branch", "full").join(a, "branch", "full").select(
        "branch", *(F.round(n, 2).alias(n) for n in z), F.round(ebitda, 2).alias("ebitda"), F.round(ebitda - z["depreciation"], 2).alias("ebit"), F.round(ebitda * 100 / F.nullif("revenue", F.lit(0.0)), 2).alias("margin_pct")
    )


@part.query("""WITH l AS (SELECT product_id, warehouse_id, arg_max(closing_stock, date) AS stock, arg_max(inventory_value, date) AS value FROM inventory GROUP BY 1, 2)
SELECT product_id, sum(stock) AS stock, round(sum(value), 2) AS value, min(CASE WHEN stock < 10 THEN 0 WHEN stock < 25 THEN 1 ELSE 2 END) AS worst FROM l GROUP BY 1""")
def b_latest_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stocks are not summed over time: the last value of each product and warehouse, then their sum."""
    latest = latest_stock(cat.inventory(spark, sf_dir))
    worst = F.when(c("stock") < 10, 0).when(c("stock") < 25, 1).otherwise(2)
    return latest.groupBy("product_id").agg(F.sum("stock").alias("stock"), F.round(F.sum("value"), 2).alias("value"), F.min(worst).alias("worst"))


@part.query("""SELECT product_id, sum(quantity) AS sold, coalesce(sum(quantity) FILTER (date >= DATE '2001-05-01' AND date < DATE '2001-08-01'), 0) AS sold_last_3, round(sum(subtotal), 4) AS revenue FROM order_lines WHERE status <> 'returned' GROUP BY 1""")
def b_sales_per_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = cat.order_lines(spark, sf_dir).filter("status <> 'returned'")
    recent = (c("date") >= "2001-05-01") & (c("date") < "2001-08-01")
    return o.groupBy("product_id").agg(F.sum("quantity").alias("sold"), F.coalesce(F.sum(F.when(recent, c("quantity"))), F.lit(0.0)).alias("sold_last_3"), F.round(F.sum("subtotal"), 4).alias("revenue"))


@part.query("""WITH m AS (SELECT month(date) AS m, sum(total) AS v FROM order_lines GROUP BY 1), a AS (SELECT *, v / avg(v) OVER () AS idx FROM m)
SELECT m AS month_of_year, round(v, 2) AS revenue, round(idx, 4) AS seasonal_index, idx > 1.15 AND row_number() OVER (ORDER BY v DESC) <= 3 AS is_peak FROM a""")
def b_seasonality(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = cat.order_lines(spark, sf_dir).groupBy(F.month("date").alias("month_of_year")).agg(F.sum("total").alias("v"))  # twelve rows
    index = c("v") / F.avg("v").over(Window.partitionBy())
    rank = F.row_number().over(Window.orderBy(F.desc("v")))
    return m.select("month_of_year", F.round("v", 2).alias("revenue"), F.round(index, 4).alias("seasonal_index"), ((index > 1.15) & (rank <= 3)).alias("is_peak"))


@part.query("SELECT segment, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 4) AS share FROM customers GROUP BY 1")
def b_segment_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = cat.customers(spark, sf_dir).groupBy("segment").agg(F.count(F.lit(1)).alias("n"))
    return g.select("segment", "n", F.round(c("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 4).alias("share"))


@part.query("""WITH s AS (SELECT customer_id, sum(subtotal) AS v FROM order_lines WHERE status <> 'returned' GROUP BY 1), t AS (SELECT sum(v) AS total FROM s)
SELECT customer_id, round(v, 2) AS revenue, round(v * 100 / total, 4) AS share FROM s, t ORDER BY v DESC, customer_id LIMIT 5""")
def b_customer_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = cat.order_lines(spark, sf_dir).filter("status <> 'returned'").groupBy("customer_id").agg(F.sum("subtotal").alias("v"))
    top = s.orderBy(F.desc("v"), "customer_id").limit(5)  # the report's five
    total = s.agg(F.sum("v").alias("total"))
    return top.crossJoin(total).select("customer_id", F.round("v", 2).alias("revenue"), F.round(c("v") * 100 / c("total"), 4).alias("share"))


@part.query("SELECT campaign_id AS channel, round(sum(spend), 4) AS spend, round(sum(revenue), 4) AS revenue, sum(conversions)::BIGINT AS conversions, round(sum(revenue) / nullif(sum(spend), 0), 4) AS roas, round(sum(spend) / nullif(sum(new_customers), 0), 4) AS cac FROM campaign_days GROUP BY 1")
def b_marketing_by_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = cat.campaign_days(spark, sf_dir).groupBy(c("campaign_id").alias("channel")).agg(*(F.sum(x).alias(x) for x in ("spend", "revenue", "conversions", "new_customers")))
    return g.select("channel", F.round("spend", 4).alias("spend"), F.round("revenue", 4).alias("revenue"), "conversions", F.round(c("revenue") / F.nullif("spend", F.lit(0.0)), 4).alias("roas"), F.round(c("spend") / F.nullif("new_customers", F.lit(0)), 4).alias("cac"))


@part.query("SELECT sum(impressions)::BIGINT AS impressions, sum(clicks)::BIGINT AS clicks, sum(conversions)::BIGINT AS conversions, round(sum(clicks) * 100.0 / nullif(sum(impressions), 0), 4) AS ctr, round(sum(conversions) * 100.0 / nullif(sum(clicks), 0), 4) AS conversion_rate, round(sum(spend) / coalesce(nullif(sum(new_customers), 0), nullif(sum(conversions), 0)), 4) AS cac FROM campaign_days")
def b_marketing_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acquisition cost per new customer, else per conversion."""
    m = cat.campaign_days(spark, sf_dir).agg(*(F.sum(x).alias(x) for x in ("impressions", "clicks", "conversions", "new_customers", "spend")))
    none = lambda x: F.nullif(x, F.lit(0))
    return m.select("impressions", "clicks", "conversions", F.round(c("clicks") * 100.0 / none("impressions"), 4).alias("ctr"), F.round(c("conversions") * 100.0 / none("clicks"), 4).alias("conversion_rate"), F.round(c("spend") / F.coalesce(none("new_customers"), none("conversions")), 4).alias("cac"))


@part.query("WITH f AS (SELECT customer_id, min(date) AS first FROM order_lines GROUP BY 1) SELECT date_trunc('month', first)::DATE AS month, count(*) AS acquired FROM f GROUP BY 1")
def b_acquisitions_per_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = cat.order_lines(spark, sf_dir).groupBy("customer_id").agg(F.min("date").alias("first"))
    return first.groupBy(month("first").alias("month")).agg(F.count(F.lit(1)).alias("acquired"))


@part.query("SELECT category, round(sum(amount) / count(DISTINCT date_trunc('month', date)), 4) AS monthly_mean, count(DISTINCT date_trunc('month', date)) AS months FROM expenses GROUP BY 1")
def b_recurring_expenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = cat.expenses(spark, sf_dir).groupBy("category").agg(F.sum("amount").alias("v"), F.countDistinct(month("date")).alias("months"))
    return g.select("category", F.round(c("v") / c("months"), 4).alias("monthly_mean"), "months")


@part.query("SELECT department, count(*) AS headcount, round(avg(annual_salary), 6) AS mean_salary FROM employees WHERE status = 'actif' GROUP BY 1")
def b_headcount_by_department(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat.employees(spark, sf_dir).filter("status = 'actif'").groupBy("department").agg(F.count(F.lit(1)).alias("headcount"), F.round(F.avg("annual_salary"), 6).alias("mean_salary"))


@part.query("SELECT round(sum(initial_cost), 2) AS initial_cost, round(sum(net_book_value), 2) AS net_book_value, round(sum(accumulated_depreciation) * 100 / nullif(sum(initial_cost), 0), 4) AS obsolescence_rate FROM assets")
def b_asset_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = cat.assets(spark, sf_dir).agg(F.sum("initial_cost").alias("i"), F.sum("net_book_value").alias("n"), F.sum("accumulated_depreciation").alias("a"))
    return a.select(F.round("i", 2).alias("initial_cost"), F.round("n", 2).alias("net_book_value"), F.round(c("a") * 100 / F.nullif("i", F.lit(0.0)), 4).alias("obsolescence_rate"))


@part.query("SELECT category, round(sum(amount), 2) AS total FROM expenses GROUP BY 1 ORDER BY sum(amount) DESC, category LIMIT 8")
def b_context_expense_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = cat.expenses(spark, sf_dir).groupBy("category").agg(F.sum("amount").alias("v"))
    return g.orderBy(F.desc("v"), "category").limit(8).select("category", F.round("v", 2).alias("total"))


@part.query("SELECT channel, count(DISTINCT order_id) AS orders, round(sum(subtotal), 2) AS revenue, round(sum(subtotal) FILTER (status = 'returned'), 2) AS returned FROM order_lines GROUP BY 1")
def b_context_orders_by_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = cat.order_lines(spark, sf_dir)
    return o.groupBy("channel").agg(F.countDistinct("order_id").alias("orders"), F.round(F.sum("subtotal"), 2).alias("revenue"), F.round(F.sum(F.when(c("status") == "returned", c("subtotal"))), 2).alias("returned"))


@part.query("SELECT supplier_id, round(avg(delay_days), 4) AS mean_delay, count(*) FILTER (delay_days > 60) AS late, count(*) AS n FROM purchases GROUP BY 1")
def b_context_supplier_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = cat.purchases(spark, sf_dir)
    return p.groupBy("supplier_id").agg(F.round(F.avg("delay_days"), 4).alias("mean_delay"), F.count_if(c("delay_days") > 60).alias("late"), F.count(F.lit(1)).alias("n"))


@part.query("""WITH s AS (SELECT event_type AS concept, sum(value) FILTER (CAST(ts AS DATE) >= DATE '2024-01-16') AS now, sum(value) FILTER (CAST(ts AS DATE) < DATE '2024-01-16') AS before FROM events GROUP BY 1)
SELECT concept, round(now, 2) AS now, round(before, 2) AS before, round(CASE WHEN coalesce(before, 0) = 0 THEN CASE WHEN now > 0 THEN 100 ELSE 0 END ELSE (now - before) * 100 / before END, 2) AS trend FROM s""")
def b_observations_by_concept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities by concept in two windows; a trend from zero is +100 %."""
    e = cat.table(spark, sf_dir, "events")
    late = F.to_date("ts") >= "2024-01-16"
    s = e.groupBy(c("event_type").alias("concept")).agg(F.sum(F.when(late, c("value"))).alias("now"), F.sum(F.when(~late, c("value"))).alias("before"))
    trend = F.when(F.coalesce("before", F.lit(0.0)) == 0, F.when(c("now") > 0, 100.0).otherwise(0.0)).otherwise((c("now") - c("before")) * 100 / c("before"))
    return s.select("concept", F.round("now", 2).alias("now"), F.round("before", 2).alias("before"), F.round(trend, 2).alias("trend"))


@part.query("SELECT 'orders' AS entity, count(*) AS n FROM order_lines WHERE date BETWEEN DATE '2001-01-01' AND DATE '2001-07-31' UNION ALL SELECT 'transactions', count(*) FROM transactions WHERE date BETWEEN DATE '2024-01-01' AND DATE '2024-01-31' UNION ALL SELECT 'expenses', count(*) FROM expenses WHERE date BETWEEN DATE '2024-01-01' AND DATE '2024-01-31'")
def b_report_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda df, name, a, b: df.filter(c("date").between(a, b)).agg(F.lit(name).alias("entity"), F.count(F.lit(1)).alias("n"))
    return n(cat.order_lines(spark, sf_dir), "orders", "2001-01-01", "2001-07-31").unionAll(n(cat.transactions(spark, sf_dir), "transactions", "2024-01-01", "2024-01-31")).unionAll(n(cat.expenses(spark, sf_dir), "expenses", "2024-01-01", "2024-01-31"))


@part.query("""WITH l AS (SELECT product_id, warehouse_id, arg_max(closing_stock, date) AS q, arg_max(inventory_value, date) AS v FROM inventory GROUP BY 1, 2), i AS (SELECT product_id, sum(q) AS q, sum(v) AS v FROM l GROUP BY 1)
SELECT round(avg((selling_price - purchase_cost) * 100 / selling_price), 4) AS mean_margin, round(sum(coalesce(v, purchase_cost * q)), 2) AS stock_value FROM products LEFT JOIN i USING (product_id)""")
def b_product_margin_and_stock_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stocks are the last value of each product and warehouse, then summed."""
    i = latest_stock(cat.inventory(spark, sf_dir)).groupBy("product_id").agg(F.sum("stock").alias("q"), F.sum("value").alias("v"))
    p = cat.products(spark, sf_dir).join(i, "product_id", "left")
    return p.agg(F.round(F.avg((c("selling_price") - c("purchase_cost")) * 100 / c("selling_price")), 4).alias("mean_margin"), F.round(F.sum(F.coalesce("v", c("purchase_cost") * c("q"))), 2).alias("stock_value"))


@part.query("SELECT event_type AS entity, count(*) AS n, round(count(*) FILTER (value > 0) * 100.0 / count(*), 4) AS import_rate, count(DISTINCT user_id % 5) AS branches FROM events GROUP BY 1")
def b_import_understanding(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = cat.table(spark, sf_dir, "events")
    return e.groupBy(c("event_type").alias("entity")).agg(F.count(F.lit(1)).alias("n"), F.round(F.count_if(c("value") > 0) * 100.0 / F.count(F.lit(1)), 4).alias("import_rate"), F.countDistinct(c("user_id") % 5).alias("branches"))


_DAYS = "f AS (SELECT ship_date AS date, sum(total) AS cash_in, sum(cost) AS cash_out FROM order_lines GROUP BY 1)"
_BLAME = "(" + " + ".join(f"CAST(contains(lower(text), '{w}') AS INT)" for w in POSITIVE) + " - " + " - ".join(f"CAST(contains(lower(text), '{w}') AS INT)" for w in NEGATIVE) + ")"


@part.query(f"WITH {_DAYS}, b AS (SELECT date, 1e6 + sum(cash_in - cash_out) OVER (ORDER BY date) AS v FROM f), l AS (SELECT date_trunc('month', date)::DATE AS month, arg_max(v, date) AS v FROM b WHERE date < DATE '2001-08-01' GROUP BY 1), n AS (SELECT date_trunc('month', date)::DATE AS month, sum(cash_in - cash_out) AS net FROM f WHERE date < DATE '2001-08-01' GROUP BY 1) SELECT month, round(net, 2) AS net_flow, round(v - lag(v) OVER (ORDER BY month), 2) AS by_balance, round(1e6 + sum(net) OVER (ORDER BY month), 2) AS balance FROM n JOIN l USING (month)")
def b_cash_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statement of daily flows, the same as balances alone, and the balances that follow from the flows."""
    o = cat.order_lines(spark, sf_dir)
    f = o.groupBy(c("ship_date").alias("date")).agg(F.sum("total").alias("cash_in"), F.sum("cost").alias("cash_out")).persist()  # one row a day, read three ways
    alone = f.select("date", (F.lit(1e6) + F.sum(c("cash_in") - c("cash_out")).over(Window.orderBy("date"))).alias("closing_cash"))  # one row a day
    flows = cash_per_month(f, cat.ORDERS_AS_OF)
    both = flows.join(cash_per_month(alone, cat.ORDERS_AS_OF).withColumnRenamed("net_flow", "by_balance"), "month", "left").join(balances_per_month(f, 1e6, cat.ORDERS_AS_OF), "month")
    return both.select("month", *(F.round(n, 2).alias(n) for n in ("net_flow", "by_balance", "balance")))


@part.query("SELECT channel, count(DISTINCT order_id) AS orders, round(sum(subtotal), 2) AS amount FROM order_lines WHERE status = 'returned' GROUP BY 1")
def b_context_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = cat.order_lines(spark, sf_dir, cost=False).filter("status = 'returned'")
    return o.groupBy("channel").agg(F.countDistinct("order_id").alias("orders"), F.round(F.sum("subtotal"), 2).alias("amount"))


@part.query("WITH l AS (SELECT product_id, warehouse_id, arg_max(closing_stock, date) AS q, arg_max(inventory_value, date) AS v FROM inventory GROUP BY 1, 2) SELECT CASE WHEN q <= 0 THEN 'rupture' WHEN q < 10 THEN 'low' ELSE 'normal' END AS status, count(*) AS n, round(sum(v), 2) AS value FROM l GROUP BY 1")
def b_context_stock_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = c("stock")
    return latest_stock(cat.inventory(spark, sf_dir)).groupBy(F.when(q <= 0, "rupture").when(q < 10, "low").otherwise("normal").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("value"))


@part.query("SELECT round(avg(delay_days), 4) AS mean_delay, count(*) FILTER (delay_days > 60) AS late, count(DISTINCT supplier_id) FILTER (delay_days > 60) AS suppliers FROM purchases")
def b_context_purchase_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = cat.purchases(spark, sf_dir).groupBy("supplier_id").agg(F.sum("delay_days").alias("d"), F.count(F.lit(1)).alias("n"), F.count_if(c("delay_days") > 60).alias("late"))
    return by.agg(F.round(F.sum("d") / F.sum("n"), 4).alias("mean_delay"), F.sum("late").alias("late"), F.count_if(c("late") > 0).alias("suppliers"))


@part.query(f"SELECT CASE WHEN {_BLAME} < 0 THEN 'complaint' WHEN {_BLAME} > 0 THEN 'praise' ELSE 'neutral' END AS kind, count(*) AS n, count(DISTINCT conv_id) AS conversations FROM remarks GROUP BY 1")
def b_context_complaints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complaints and praise among what users wrote."""
    v = sentiment(c("text"))
    return cat.remarks(spark, sf_dir).groupBy(F.when(v < 0, "complaint").when(v > 0, "praise").otherwise("neutral").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("conv_id").alias("conversations"))
