"""Joins between entities: look-ups, orphans, one-to-one matching, ranges, reconciliations.

Sides are left for the optimiser to broadcast or to sort and merge by their size; only tables of a fixed size (nations,
regions) are hinted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.periods import latest_stock
from ..sources import catalog as cat
from .base import Part

part = Part()
c = F.col


@part.query("""WITH k AS (SELECT customer_id, CAST(customer_id AS VARCHAR) AS key, 1 AS prio FROM customers UNION ALL SELECT customer_id, lower(name), 2 FROM customers),
u AS (SELECT key, min(customer_id) AS customer_id, count(DISTINCT customer_id) AS n FROM k GROUP BY key),
o AS (SELECT DISTINCT order_id, CASE WHEN order_id % 3 = 0 THEN NULL ELSE CAST(customer_id AS VARCHAR) END AS by_id, lower('Customer#' || lpad(CAST(customer_id AS VARCHAR), 9, '0')) AS by_name FROM order_lines),
ok AS (SELECT order_id, by_id AS key, 1 AS prio FROM o WHERE by_id IS NOT NULL UNION ALL SELECT order_id, by_name, 2 FROM o),
m AS (SELECT order_id, arg_min(CASE WHEN n = 1 THEN customer_id END, prio) FILTER (n IS NOT NULL) AS found, min(n) AS least, count(*) AS tried FROM ok LEFT JOIN u USING (key) GROUP BY 1)
SELECT CASE WHEN found IS NOT NULL THEN 'found' WHEN least > 1 THEN 'ambiguous' ELSE 'absent' END AS status, count(*) AS n FROM m GROUP BY 1""")
def j_orders_to_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders matched by id, else by name; keys of several customers decide nothing."""
    cu = cat.customers(spark, sf_dir)
    keys = cu.select("customer_id", F.explode(F.array(c("customer_id").cast("string"), F.lower("name"))).alias("key"))
    unique = keys.groupBy("key").agg(F.min("customer_id").alias("customer_id"), F.countDistinct("customer_id").alias("n"))
    o = cat.order_lines(spark, sf_dir).select("order_id", "customer_id").distinct()
    by_id = F.when(c("order_id") % 3 != 0, c("customer_id").cast("string"))
    by_name = F.lower(F.concat(F.lit("Customer#"), F.lpad(c("customer_id").cast("string"), 9, "0")))
    tried = o.select("order_id", F.posexplode(F.array(by_id, by_name)).alias("prio", "key")).filter("key IS NOT NULL").join(unique, "key", "left")
    best = tried.groupBy("order_id").agg(F.min_by(F.when(c("n") == 1, c("customer_id")), F.when(c("n").isNotNull(), c("prio"))).alias("found"), F.min("n").alias("least"))
    status = F.when(c("found").isNotNull(), "found").when(c("least") > 1, "ambiguous").otherwise("absent")
    return best.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def _orphans(side: str, key: str) -> str:
    return f"SELECT l.{key}, count(*) AS n_lines FROM order_lines l ANTI JOIN (SELECT {key} FROM {side} WHERE {key} % 50 <> 0) r USING ({key}) GROUP BY 1"


@part.query(_orphans("products", "product_id"))
def j_orphan_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines whose product the catalogue (here without every fiftieth) does not have."""
    p = cat.products(spark, sf_dir).filter("product_id % 50 <> 0")
    return cat.order_lines(spark, sf_dir).join(p, "product_id", "left_anti").groupBy("product_id").agg(F.count(F.lit(1)).alias("n_lines"))


@part.query("SELECT product_id, count(*) AS n_snapshots FROM inventory ANTI JOIN (SELECT product_id FROM products WHERE product_id % 20 <> 0) USING (product_id) GROUP BY 1")
def j_orphan_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = cat.products(spark, sf_dir).filter("product_id % 20 <> 0")
    return cat.inventory(spark, sf_dir).join(p, "product_id", "left_anti").groupBy("product_id").agg(F.count(F.lit(1)).alias("n_snapshots"))


@part.query("SELECT employee_id, count(*) AS n_slips FROM payroll ANTI JOIN (SELECT employee_id FROM employees WHERE status = 'actif') USING (employee_id) GROUP BY 1")
def j_payroll_without_employee(spark: SparkSession, sf_dir: str) -> DataFrame:
    active = cat.employees(spark, sf_dir).filter("status = 'actif'")
    return cat.payroll(spark, sf_dir).join(active, "employee_id", "left_anti").groupBy("employee_id").agg(F.count(F.lit(1)).alias("n_slips"))


@part.query("""WITH w AS (SELECT product_id, warehouse_id, max(date) AS date, arg_max(closing_stock, date) AS stock FROM inventory GROUP BY 1, 2), l AS (SELECT product_id, max(date) AS date, sum(stock) AS stock FROM w GROUP BY 1)
SELECT product_id, name, date, stock, coalesce(stock, 0) <= reorder_point AS below FROM products LEFT JOIN l USING (product_id)""")
def j_product_latest_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each product with its stock: the last snapshot of every warehouse, whenever that was."""
    latest = latest_stock(cat.inventory(spark, sf_dir)).groupBy("product_id").agg(F.max("date").alias("date"), F.sum("stock").alias("stock"))
    return cat.products(spark, sf_dir).join(latest, "product_id", "left").select("product_id", "name", "date", "stock", (F.coalesce("stock", F.lit(0.0)) <= c("reorder_point")).alias("below"))


@part.query("""WITH s AS (SELECT product_id, max(date) AS snapshot FROM inventory WHERE date <= DATE '2000-12-31' GROUP BY 1)
SELECT product_id, snapshot, coalesce(sum(quantity) FILTER (date > snapshot), 0) AS sold_since FROM s LEFT JOIN order_lines USING (product_id) GROUP BY 1, 2""".replace("FILTER (date", "FILTER (order_lines.date"))
def j_range_sold_after_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity sold after each product's last snapshot: an equi-join with a range, aggregated per product."""
    s = cat.inventory(spark, sf_dir).filter("date <= DATE '2000-12-31'").groupBy("product_id").agg(F.max("date").alias("snapshot"))
    o = cat.order_lines(spark, sf_dir).select("product_id", c("date").alias("sold_on"), "quantity")
    later = s.join(o, (s.product_id == o.product_id) & (o.sold_on > s.snapshot), "left").drop(o.product_id)
    return later.groupBy("product_id", "snapshot").agg(F.coalesce(F.sum("quantity"), F.lit(0.0)).alias("sold_since"))


@part.query("""WITH t AS (SELECT *, row_number() OVER (PARTITION BY date, amount ORDER BY transaction_id) AS k FROM transactions WHERE type = 'expense'),
x AS (SELECT *, row_number() OVER (PARTITION BY date, amount ORDER BY expense_id) AS k FROM expenses)
SELECT transaction_id, expense_id, t.amount FROM t JOIN x USING (date, amount, k)""")
def j_already_booked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each expense takes one transaction of its date and amount: the k-th of both sides are matched."""
    nth = lambda df, key: df.withColumn("k", F.row_number().over(Window.partitionBy("date", "amount").orderBy(key)))
    t = nth(cat.transactions(spark, sf_dir).filter("type = 'expense'"), "transaction_id")
    x = nth(cat.expenses(spark, sf_dir), "expense_id").select("date", "amount", "k", "expense_id")
    return t.join(x, ["date", "amount", "k"]).select("transaction_id", "expense_id", "amount")


@part.query("""WITH r AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '[0-9]+')) AS tok FROM remarks)
SELECT DISTINCT conv_id, turn FROM r WHERE TRY_CAST(tok AS BIGINT) IN (SELECT order_id FROM order_lines)""")
def j_remarks_that_quote_an_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    quoted = cat.remarks(spark, sf_dir).select("conv_id", "turn", F.explode(F.regexp_extract_all("text", F.lit("[0-9]+"), 0)).alias("tok"))
    known = cat.order_lines(spark, sf_dir).select("order_id").distinct()
    return quoted.withColumn("order_id", c("tok").try_cast("bigint")).join(known, "order_id", "left_semi").select("conv_id", "turn").distinct()


@part.query("WITH c AS (SELECT campaign_id, sum(spend) * 1.01 AS budget FROM campaign_days GROUP BY 1 HAVING campaign_id <> 3) SELECT campaign_id, count(*) AS n_days, round(sum(spend) / any_value(budget), 4) AS share FROM campaign_days JOIN c USING (campaign_id) GROUP BY 1")
def j_campaign_total_vs_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = cat.campaign_days(spark, sf_dir)
    total = d.groupBy("campaign_id").agg((F.sum("spend") * 1.01).alias("budget")).filter("campaign_id <> 3")
    return d.join(total, "campaign_id").groupBy("campaign_id").agg(F.count(F.lit(1)).alias("n_days"), F.round(F.sum("spend") / F.first("budget"), 4).alias("share"))


@part.query("""WITH i AS (SELECT date_trunc('week', date)::DATE AS week, sum(cash_in) AS a FROM cashflow GROUP BY 1), t AS (SELECT date_trunc('week', date)::DATE AS week, sum(amount) AS b FROM transactions WHERE type = 'income' AND currency <> 'EUR' GROUP BY 1)
SELECT week, round(a, 2) AS cash_in, round(b, 2) AS income, CASE WHEN abs(a - b) / b > 0.2 THEN 'error' WHEN abs(a - b) / b > 0.05 THEN 'warn' ELSE 'ok' END AS verdict FROM i JOIN t USING (week)""")
def j_shared_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two accounts of one flow on the periods both cover."""
    week = F.to_date(F.date_trunc("week", "date"))
    i = cat.cashflow(spark, sf_dir).groupBy(week.alias("week")).agg(F.sum("cash_in").alias("a"))
    t = cat.transactions(spark, sf_dir).filter("type = 'income' AND currency <> 'EUR'").groupBy(week.alias("week")).agg(F.sum("amount").alias("b"))
    gap = F.abs(c("a") - c("b")) / c("b")
    return i.join(t, "week").select("week", F.round("a", 2).alias("cash_in"), F.round("b", 2).alias("income"), F.when(gap > 0.2, "error").when(gap > 0.05, "warn").otherwise("ok").alias("verdict"))


@part.query("""WITH p AS (SELECT date, cash_in - cash_out AS net, lag(date) OVER (ORDER BY date) AS before, lag(cash_in - cash_out) OVER (ORDER BY date) AS net_before FROM cashflow)
SELECT date, round(net - net_before, 2) AS change FROM p WHERE date_diff('day', before, date) = 1""")
def j_consecutive_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.orderBy("date")  # one row a day
    f = cat.cashflow(spark, sf_dir).select("date", (c("cash_in") - c("cash_out")).alias("net"))
    p = f.select("date", "net", F.lag("date").over(w).alias("before"), F.lag("net").over(w).alias("net_before"))
    return p.filter(F.datediff("date", "before") == 1).select("date", F.round(c("net") - c("net_before"), 2).alias("change"))


@part.query("""WITH s AS (SELECT customer_id, sum(total) AS v FROM order_lines GROUP BY 1), f AS (SELECT o_custkey AS customer_id, sum(o_totalprice) AS said FROM orders GROUP BY 1)
SELECT count(*) FILTER (abs(said - v) > 0.05 * v) AS differing, count(*) AS n FROM customers JOIN s USING (customer_id) JOIN f USING (customer_id)""")
def j_customer_file_vs_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose order headers say another sum than their order lines."""
    s = cat.order_lines(spark, sf_dir).groupBy("customer_id").agg(F.sum("total").alias("v"))
    f = cat.table(spark, sf_dir, "orders").groupBy(c("o_custkey").alias("customer_id")).agg(F.sum("o_totalprice").alias("said"))
    both = cat.customers(spark, sf_dir).join(s, "customer_id").join(f, "customer_id")
    return both.agg(F.count_if(F.abs(c("said") - c("v")) > 0.05 * c("v")).alias("differing"), F.count(F.lit(1)).alias("n"))


@part.query("SELECT product_id, count(*) AS n, count(*) FILTER (abs(unit_price - selling_price) > 0.05 * selling_price) AS off_price, round(avg(unit_price / selling_price), 4) AS mean_ratio FROM order_lines JOIN products USING (product_id) GROUP BY 1")
def j_price_vs_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = cat.order_lines(spark, sf_dir).join(cat.products(spark, sf_dir).select("product_id", "selling_price"), "product_id")
    return o.groupBy("product_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.abs(c("unit_price") - c("selling_price")) > 0.05 * c("selling_price")).alias("off_price"), F.round(F.avg(c("unit_price") / c("selling_price")), 4).alias("mean_ratio"))


@part.query("SELECT e.branch AS seller_branch, o.order_id % 4 AS sale_branch, count(*) AS n FROM order_lines o JOIN employees e ON o.supplier_id = e.employee_id WHERE e.branch <> o.order_id % 4 GROUP BY 1, 2")
def j_sale_branch_vs_seller(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, e = cat.order_lines(spark, sf_dir), cat.employees(spark, sf_dir).select("employee_id", c("branch").alias("seller_branch"))
    both = o.join(e, o.supplier_id == e.employee_id).withColumn("sale_branch", c("order_id") % 4)
    return both.filter("seller_branch <> sale_branch").groupBy("seller_branch", "sale_branch").agg(F.count(F.lit(1)).alias("n"))


@part.query("""WITH s AS (SELECT r_name AS location, sum(o_totalprice) AS said FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1),
v AS (SELECT region AS location, sum(total) AS recomputed FROM order_lines JOIN customers USING (customer_id) GROUP BY 1)
SELECT location, round(said, 2) AS said, round(recomputed, 2) AS recomputed, abs(said - recomputed) > 0.05 * said AS differs FROM s JOIN v USING (location)""")
def j_summary_vs_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    cu = cat.customers(spark, sf_dir).select("customer_id", c("region").alias("location"))
    o = cat.table(spark, sf_dir, "orders")
    said = o.join(cu, o.o_custkey == cu.customer_id).groupBy("location").agg(F.sum("o_totalprice").alias("said"))
    again = cat.order_lines(spark, sf_dir).join(cu, "customer_id").groupBy("location").agg(F.sum("total").alias("recomputed"))
    return said.join(again, "location").select("location", F.round("said", 2).alias("said"), F.round("recomputed", 2).alias("recomputed"), (F.abs(c("said") - c("recomputed")) > 0.05 * c("said")).alias("differs"))


@part.query("""WITH i AS (SELECT product_id, min(warehouse_id) AS supplier_id FROM inventory GROUP BY 1)
SELECT product_id, CASE WHEN s.country NOT IN ('CANADA') THEN 1 ELSE 0 END + CASE WHEN s.province <> 'Québec' THEN 1 ELSE 0 END + CASE WHEN (selling_price - purchase_cost) * 100 / selling_price < 20 THEN 1 ELSE 0 END AS points
FROM i LEFT JOIN products USING (product_id) LEFT JOIN suppliers s USING (supplier_id)""")
def j_customs_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """0 to 3 points: foreign origin, supplier from elsewhere, thin margin. One supplier a product, the first."""
    i = cat.inventory(spark, sf_dir).groupBy("product_id").agg(F.min("warehouse_id").alias("supplier_id"))
    both = i.join(cat.products(spark, sf_dir), "product_id", "left").join(cat.suppliers(spark, sf_dir).select("supplier_id", "country", "province"), "supplier_id", "left")
    margin = (c("selling_price") - c("purchase_cost")) * 100 / c("selling_price")
    point = lambda x: F.when(x, 1).otherwise(0)
    return both.select("product_id", (point(c("country") != "CANADA") + point(c("province") != "Québec") + point(margin < 20)).alias("points"))


@part.query("SELECT s.name AS supplier, count(*) AS n, round(sum(quantity * unit_cost), 2) AS total FROM purchases LEFT JOIN suppliers s USING (supplier_id) GROUP BY 1")
def j_purchases_by_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = cat.purchases(spark, sf_dir).groupBy("supplier_id").agg(F.count(F.lit(1)).alias("n"), F.sum(c("quantity") * c("unit_cost")).alias("v"))
    return p.join(cat.suppliers(spark, sf_dir).select("supplier_id", c("name").alias("supplier")), "supplier_id", "left").select("supplier", "n", F.round("v", 2).alias("total"))


@part.query("""WITH stored AS (SELECT * FROM transactions WHERE transaction_id % 2 = 0), incoming AS (SELECT * FROM transactions WHERE transaction_id % 3 = 0)
SELECT transaction_id FROM incoming ANTI JOIN stored USING (date, amount, type, customer_id)""")
def j_new_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incoming rows whose business key is not stored yet."""
    t = cat.transactions(spark, sf_dir)
    return t.filter("transaction_id % 3 = 0").join(t.filter("transaction_id % 2 = 0"), ["date", "amount", "type", "customer_id"], "left_anti").select("transaction_id")


@part.query("""WITH s AS (SELECT event_type AS entity, count(*) AS stored FROM events WHERE event_id % 10 <> 0 GROUP BY 1), j AS (SELECT event_type AS entity, count(*) AS announced FROM events GROUP BY 1)
SELECT entity, announced, coalesce(stored, 0) AS stored, announced - coalesce(stored, 0) AS missing FROM j FULL JOIN s USING (entity)""")
def j_journal_vs_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = cat.table(spark, sf_dir, "events").withColumnRenamed("event_type", "entity")
    s = e.filter("event_id % 10 <> 0").groupBy("entity").agg(F.count(F.lit(1)).alias("stored"))
    j = e.groupBy("entity").agg(F.count(F.lit(1)).alias("announced"))
    stored = F.coalesce("stored", F.lit(0))
    return j.join(s, "entity", "full").select("entity", "announced", stored.alias("stored"), (c("announced") - stored).alias("missing"))


@part.query("""WITH i AS (SELECT product_id, max(selling_price) * 1.02 AS price, 'x' AS brand FROM products WHERE product_id % 2 = 0 GROUP BY 1), s AS (SELECT product_id, CASE WHEN product_id % 3 = 0 THEN NULL ELSE selling_price END AS price FROM products)
SELECT product_id, round(coalesce(s.price, i.price), 4) AS price FROM s LEFT JOIN i USING (product_id)""")
def j_back_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only fields that are empty are filled from the incoming rows."""
    p = cat.products(spark, sf_dir)
    stored = p.select("product_id", F.when(c("product_id") % 3 != 0, c("selling_price")).alias("price"))
    incoming = p.filter("product_id % 2 = 0").select("product_id", (c("selling_price") * 1.02).alias("new_price"))
    return stored.join(incoming, "product_id", "left").select("product_id", F.round(F.coalesce("price", "new_price"), 4).alias("price"))


@part.query("""WITH f AS (SELECT event_id, lower(trim(event_type || '-' || (user_id % 7))) AS title, CAST(ts AS DATE) AS d FROM events WHERE event_type = 'error' AND value > 90), r AS (SELECT * FROM f WHERE d < DATE '2024-01-20')
SELECT event_id FROM f WHERE d >= DATE '2024-01-20' AND NOT EXISTS (SELECT 1 FROM r WHERE r.title = f.title AND date_diff('day', r.d, f.d) <= 5)""")
def j_findings_not_alerted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Critical findings whose normalised title was not alerted in the days before."""
    e = cat.table(spark, sf_dir, "events").filter("event_type = 'error' AND value > 90")
    f = e.select("event_id", F.lower(F.trim(F.concat_ws("-", "event_type", (c("user_id") % 7).cast("string")))).alias("title"), F.to_date("ts").alias("d"))
    # the last alert before each title and day, over one row a title and day: no join within a hot title
    days = f.groupBy("title", "d").agg((c("d") < "2024-01-20").alias("old"))
    last = F.max(F.when(c("old"), c("d"))).over(Window.partitionBy("title").orderBy("d"))
    silent = days.withColumn("last", last).filter("NOT old AND (last IS NULL OR datediff(d, last) > 5)").select("title", "d")
    return f.join(silent, ["title", "d"], "left_semi").select("event_id")


@part.query("""WITH r AS (SELECT product_id, sum(subtotal) AS v, sum(sum(subtotal)) OVER () AS t FROM order_lines GROUP BY 1), w AS (SELECT product_id, warehouse_id, arg_max(closing_stock, date) AS q FROM inventory GROUP BY 1, 2), s AS (SELECT product_id, sum(q) AS q FROM w GROUP BY 1)
SELECT product_id, round(v * 100 / t, 4) AS share FROM r JOIN products USING (product_id) LEFT JOIN s USING (product_id) WHERE coalesce(q, 0) < reorder_point AND v * 1000 > t""")
def j_top_sellers_short_of_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = cat.order_lines(spark, sf_dir).groupBy("product_id").agg(F.sum("subtotal").alias("v"))
    total = o.agg(F.sum("v").alias("t"))
    s = latest_stock(cat.inventory(spark, sf_dir)).groupBy("product_id").agg(F.sum("stock").alias("q"))
    short = o.join(cat.products(spark, sf_dir), "product_id").join(s, "product_id", "left").filter(F.coalesce("q", F.lit(0.0)) < c("reorder_point"))
    return short.crossJoin(total).filter("v * 1000 > t").select("product_id", F.round(c("v") * 100 / c("t"), 4).alias("share"))
