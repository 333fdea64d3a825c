"""Business entities read from the star-schema tables, as lazy projections: nothing is read until a query asks.

Every entity is a DataFrame with the columns named in its function. Amounts are doubles, dates are dates. Entities
that the tables do not hold are derived from them by fixed rules: employees from suppliers, payroll from employees
and months, assets from large parts, expenses and transactions from events, stock from order lines. `with_entities`
gives the same definitions as SQL common table expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Reference date of order data; the month it falls in counts as running.
ORDERS_AS_OF = "2001-08-15"
#: Reference date of event data.
EVENTS_AS_OF = "2024-01-30"


#: Schemas of the tables that a session has read: entities share tables, and each inference is a job.
_schemas: dict[tuple[str, str], StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    key = (spark.sparkContext.applicationId, path)
    if key not in _schemas:
        _schemas[key] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[key]).parquet(path)


def _c(name: str) -> Column:
    return F.col(name)


def order_lines(spark: SparkSession, sf_dir: str, cost: bool = True) -> DataFrame:
    """Order entity at line grain: lineitem with its order's customer, date and status, and the part's cost; without
    `cost`, that column is null and the parts are not read."""
    li, o, p = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "part"))
    net = _c("l_extendedprice") * (1 - _c("l_discount"))
    both = li.join(o, li.l_orderkey == o.o_orderkey)
    both = both.join(p.select("p_partkey", "p_retailprice"), li.l_partkey == _c("p_partkey"), "left") if cost else both.withColumn("p_retailprice", F.lit(None).cast("double"))
    return both.select(
        _c("l_orderkey").alias("order_id"),
        _c("l_linenumber").alias("line_no"),
        _c("l_partkey").alias("product_id"),
        _c("l_suppkey").alias("supplier_id"),
        _c("o_custkey").alias("customer_id"),
        F.to_date("o_orderdate").alias("date"),
        F.to_date("l_shipdate").alias("ship_date"),
        _c("l_quantity").alias("quantity"),
        (_c("l_extendedprice") / _c("l_quantity")).alias("unit_price"),
        _c("l_discount").alias("discount"),
        net.alias("subtotal"),
        (net * _c("l_tax")).alias("tax"),
        (net * _c("l_tax") * 5 / 14.975).alias("tax_federal"),
        (net * _c("l_tax") * 9.975 / 14.975).alias("tax_provincial"),
        (net * (1 + _c("l_tax"))).alias("total"),
        (_c("l_quantity") * _c("p_retailprice") * 0.6).alias("cost"),
        F.when(_c("l_returnflag") == "R", "returned").when(_c("o_orderstatus") == "F", "completed").when(_c("o_orderstatus") == "O", "pending").otherwise("in progress").alias("status"),
        _c("o_orderpriority").alias("channel"),
    )


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    return c.join(F.broadcast(n.join(r, n.n_regionkey == r.r_regionkey)), c.c_nationkey == n.n_nationkey).select(
        _c("c_custkey").alias("customer_id"), _c("c_name").alias("name"), _c("c_mktsegment").alias("segment"), _c("n_name").alias("country"), _c("r_name").alias("region"), _c("c_acctbal").alias("credit_limit"),
        F.when(_c("c_custkey") % 10 == 0, "inactif").when(_c("c_custkey") % 17 == 0, "perdu").otherwise("actif").alias("status"), (_c("c_custkey") % 100 / 100.0).alias("churn_risk"), (_c("c_custkey") % 500).alias("loyalty_points"),
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        _c("p_partkey").alias("product_id"), _c("p_name").alias("name"), _c("p_brand").alias("brand"), _c("p_type").alias("category"), _c("p_retailprice").alias("selling_price"), (_c("p_retailprice") * 0.6).alias("purchase_cost"), (_c("p_size") * 2).alias("reorder_point")
    )


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    return s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey).select(
        _c("s_suppkey").alias("supplier_id"), _c("s_name").alias("name"), _c("n_name").alias("country"), (_c("s_suppkey") % 100).cast("double").alias("esg_score"), F.when(_c("s_suppkey") % 7 == 0, "Québec").otherwise("Ontario").alias("province")
    )


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = order_lines(spark, sf_dir)
    return o.select("supplier_id", "product_id", _c("ship_date").alias("date"), "quantity", (_c("cost") / _c("quantity")).alias("unit_cost"), F.datediff("ship_date", "date").alias("delay_days"))


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.filter(_c("event_type").isin("purchase", "error")).select(
        _c("event_id").alias("transaction_id"), F.to_date("ts").alias("date"), _c("value").alias("amount"), F.when(_c("event_type") == "purchase", "income").otherwise("expense").alias("type"), _c("user_id").alias("customer_id"),
        F.when(_c("event_id") % 11 == 0, "USD").when(_c("event_id") % 13 == 0, "EUR").otherwise("CAD").alias("currency"), F.concat(F.lit("cat"), _c("user_id") % 5).alias("category"),
        F.when(_c("event_id") % 17 == 0, "En attente").when(_c("event_id") % 19 == 0, "Annulée").otherwise("Complétée").alias("status"), F.when(_c("event_id") % 23 == 0, "Virement paie").otherwise("Achat").alias("description"),
    )


def ledger_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transactions as a bank's ledger of fourteen months from January 2000, a day after the other by their ids."""
    return transactions(spark, sf_dir).withColumn("date", F.date_add(F.lit("2000-01-01").cast("date"), (_c("transaction_id") % 420).cast("int")))


def ledger_expenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _expenses_of(ledger_transactions(spark, sf_dir))


def _expenses_of(t: DataFrame) -> DataFrame:
    t = t.filter("type = 'expense'")
    return t.select(_c("transaction_id").alias("expense_id"), "date", F.when(_c("transaction_id") % 3 == 0, _c("amount")).otherwise(_c("amount") + 1.5).alias("amount"), "category")


def expenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third expense transaction is booked as an expense as well; the others are new ones."""
    return _expenses_of(transactions(spark, sf_dir))


def campaign_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind = lambda k: F.sum(F.when(_c("event_type") == k, 1).otherwise(0))
    value = lambda k: F.sum(F.when(_c("event_type") == k, _c("value")).otherwise(0.0))
    return e.groupBy((_c("user_id") % 6).alias("campaign_id"), F.to_date("ts").alias("date")).agg(
        kind("view").alias("impressions"), kind("click").alias("clicks"), kind("purchase").alias("conversions"), kind("signup").alias("new_customers"), (value("click") * 0.5).alias("spend"), value("purchase").alias("revenue")
    )


#: Tasks that stock is worked out in: no more than Spark writes a file each for while it shuffles, so that no task sorts what it sends.
STOCK_TASKS = 200


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot per product, warehouse (supplier) and month of shipping: what was shipped counts as stock.

    Hardly two lines share a snapshot, so that summing them where they are read only fills memory. They are dealt out by
    product first; what groups snapshots by product, and by warehouse or month besides, needs no further exchange.
    """
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    lines = li.repartition(STOCK_TASKS, "l_partkey").join(p, li.l_partkey == p.p_partkey, "left")
    cost = _c("l_quantity") * _c("p_retailprice") * 0.6
    return lines.groupBy(_c("l_partkey").alias("product_id"), _c("l_suppkey").alias("warehouse_id"), F.last_day(F.to_date("l_shipdate")).alias("date")).agg(F.sum("l_quantity").alias("closing_stock"), F.sum(cost).alias("inventory_value"))


def cashflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = transactions(spark, sf_dir)
    side = lambda k: F.sum(F.when(_c("type") == k, _c("amount")).otherwise(0.0))
    return t.groupBy("date").agg(side("income").alias("cash_in"), side("expense").alias("cash_out"))


def employees(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    k = _c("s_suppkey")
    return s.select(
        k.alias("employee_id"), F.when(k % 4 == 0, "Ventes").when(k % 4 == 1, "Finance").when(k % 4 == 2, "Production").otherwise("Direction").alias("department"), (30000 + F.abs("s_acctbal")).alias("annual_salary"), ((30000 + F.abs("s_acctbal")) * 1.12).alias("total_employer_cost"),
        F.when(k % 9 == 0, "quitté").otherwise("actif").alias("status"), F.when(k % 5 == 0, "syndiqué").otherwise("non").alias("union_status"), (k % 15).cast("double").alias("seniority_years"), (k % 4).alias("branch"),
    )


def payroll(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve pay slips of 2000 for each employee."""
    e = employees(spark, sf_dir).withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12))))
    pay = _c("annual_salary") / 12
    return e.select("employee_id", F.make_date(F.lit(2000), _c("month"), F.lit(1)).alias("period"), pay.alias("regular_pay"), F.when(_c("employee_id") % 3 == 0, pay * 0.1).otherwise(0.0).alias("overtime"), (pay * 0.12).alias("employer_cost"), (pay * F.when(_c("employee_id") % 3 == 0, 1.1).otherwise(1.0) + pay * 0.12).alias("total_cost"))


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").filter("p_size >= 45")
    return p.select(_c("p_partkey").alias("asset_id"), (_c("p_retailprice") * 10).alias("initial_cost"), (_c("p_retailprice") * 4).alias("accumulated_depreciation"), (_c("p_retailprice") * 6).alias("net_book_value"), F.when(_c("p_partkey") % 2 == 0, 30.0).otherwise(0.2).alias("dpa_rate"), (_c("p_partkey") % 4).alias("branch"))


def balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: what customers owe on open orders, what suppliers are owed, and the cash at the start."""
    owed = table(spark, sf_dir, "orders").agg(F.sum(F.when(_c("o_orderstatus") == "O", _c("o_totalprice"))).alias("receivable"))
    owing = table(spark, sf_dir, "supplier").agg(F.sum(F.when(_c("s_acctbal") > 0, _c("s_acctbal"))).alias("payable"))
    return owed.crossJoin(owing).crossJoin(table(spark, sf_dir, "customer").agg(F.sum(F.when(_c("c_acctbal") > 0, _c("c_acctbal"))).alias("opening_cash")))


def remarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text observations: what users wrote."""
    return table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", "text")


#: Entities that the indicators read.
ENTITIES = ("order_lines", "customers", "products", "suppliers", "purchases", "transactions", "expenses", "campaign_days", "inventory", "cashflow", "employees", "payroll", "assets", "balances", "remarks")


def frames(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """All entities of the tables by name: one way to fill the engine's catalog."""
    return {name: globals()[name](spark, sf_dir) for name in ENTITIES}


#: The same entities in SQL.
ENTITY_SQL = {
    "order_lines": """SELECT l_orderkey AS order_id, l_linenumber AS line_no, l_partkey AS product_id, l_suppkey AS supplier_id, o_custkey AS customer_id,
  CAST(o_orderdate AS DATE) AS date, CAST(l_shipdate AS DATE) AS ship_date, l_quantity AS quantity, l_extendedprice / l_quantity AS unit_price, l_discount AS discount,
  l_extendedprice * (1 - l_discount) AS subtotal, l_extendedprice * (1 - l_discount) * l_tax AS tax, l_extendedprice * (1 - l_discount) * l_tax * 5 / 14.975 AS tax_federal, l_extendedprice * (1 - l_discount) * l_tax * 9.975 / 14.975 AS tax_provincial, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS total,
  l_quantity * p_retailprice * 0.6 AS cost,
  CASE WHEN l_returnflag = 'R' THEN 'returned' WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'O' THEN 'pending' ELSE 'in progress' END AS status, o_orderpriority AS channel
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey""",
    "customers": """SELECT c_custkey AS customer_id, c_name AS name, c_mktsegment AS segment, n_name AS country, r_name AS region, c_acctbal AS credit_limit,
  CASE WHEN c_custkey % 10 = 0 THEN 'inactif' WHEN c_custkey % 17 = 0 THEN 'perdu' ELSE 'actif' END AS status, c_custkey % 100 / 100.0::DOUBLE AS churn_risk, c_custkey % 500 AS loyalty_points
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "products": "SELECT p_partkey AS product_id, p_name AS name, p_brand AS brand, p_type AS category, p_retailprice AS selling_price, p_retailprice * 0.6 AS purchase_cost, p_size * 2 AS reorder_point FROM part",
    "suppliers": "SELECT s_suppkey AS supplier_id, s_name AS name, n_name AS country, CAST(s_suppkey % 100 AS DOUBLE) AS esg_score, CASE WHEN s_suppkey % 7 = 0 THEN 'Québec' ELSE 'Ontario' END AS province FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "purchases": "SELECT supplier_id, product_id, ship_date AS date, quantity, cost / quantity AS unit_cost, date_diff('day', date, ship_date) AS delay_days FROM order_lines",
    "transactions": """SELECT event_id AS transaction_id, CAST(ts AS DATE) AS date, value AS amount, CASE WHEN event_type = 'purchase' THEN 'income' ELSE 'expense' END AS type, user_id AS customer_id,
  CASE WHEN event_id % 11 = 0 THEN 'USD' WHEN event_id % 13 = 0 THEN 'EUR' ELSE 'CAD' END AS currency, 'cat' || (user_id % 5) AS category,
  CASE WHEN event_id % 17 = 0 THEN 'En attente' WHEN event_id % 19 = 0 THEN 'Annulée' ELSE 'Complétée' END AS status, CASE WHEN event_id % 23 = 0 THEN 'Virement paie' ELSE 'Achat' END AS description FROM events WHERE event_type IN ('purchase', 'error')""",
    "ledger_transactions": "SELECT * REPLACE (CAST(DATE '2000-01-01' + CAST(transaction_id % 420 AS INT) AS DATE) AS date) FROM transactions",
    "ledger_expenses": "SELECT transaction_id AS expense_id, date, CASE WHEN transaction_id % 3 = 0 THEN amount ELSE amount + 1.5 END AS amount, category FROM ledger_transactions WHERE type = 'expense'",
    "expenses": "SELECT transaction_id AS expense_id, date, CASE WHEN transaction_id % 3 = 0 THEN amount ELSE amount + 1.5 END AS amount, category FROM transactions WHERE type = 'expense'",
    "campaign_days": """SELECT user_id % 6 AS campaign_id, CAST(ts AS DATE) AS date, count(*) FILTER (event_type = 'view') AS impressions, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'purchase') AS conversions,
  count(*) FILTER (event_type = 'signup') AS new_customers, coalesce(sum(value) FILTER (event_type = 'click'), 0) * 0.5 AS spend, coalesce(sum(value) FILTER (event_type = 'purchase'), 0) AS revenue FROM events GROUP BY 1, 2""",
    "inventory": "SELECT product_id, supplier_id AS warehouse_id, last_day(ship_date) AS date, sum(quantity) AS closing_stock, sum(cost) AS inventory_value FROM order_lines GROUP BY 1, 2, 3",
    "cashflow": "SELECT date, coalesce(sum(amount) FILTER (type = 'income'), 0) AS cash_in, coalesce(sum(amount) FILTER (type = 'expense'), 0) AS cash_out FROM transactions GROUP BY 1",
    "employees": """SELECT s_suppkey AS employee_id, CASE s_suppkey % 4 WHEN 0 THEN 'Ventes' WHEN 1 THEN 'Finance' WHEN 2 THEN 'Production' ELSE 'Direction' END AS department, 30000 + abs(s_acctbal) AS annual_salary, (30000 + abs(s_acctbal)) * 1.12 AS total_employer_cost,
  CASE WHEN s_suppkey % 9 = 0 THEN 'quitté' ELSE 'actif' END AS status, CASE WHEN s_suppkey % 5 = 0 THEN 'syndiqué' ELSE 'non' END AS union_status, CAST(s_suppkey % 15 AS DOUBLE) AS seniority_years, s_suppkey % 4 AS branch FROM supplier""",
    "payroll": """SELECT employee_id, make_date(2000, m, 1) AS period, annual_salary / 12 AS regular_pay, CASE WHEN employee_id % 3 = 0 THEN annual_salary / 12 * 0.1 ELSE 0 END AS overtime, annual_salary / 12 * 0.12 AS employer_cost,
  annual_salary / 12 * CASE WHEN employee_id % 3 = 0 THEN 1.1 ELSE 1.0 END + annual_salary / 12 * 0.12 AS total_cost FROM employees, range(1, 13) AS t(m)""",
    "assets": "SELECT p_partkey AS asset_id, p_retailprice * 10 AS initial_cost, p_retailprice * 4 AS accumulated_depreciation, p_retailprice * 6 AS net_book_value, CASE WHEN p_partkey % 2 = 0 THEN 30.0 ELSE 0.2 END AS dpa_rate, p_partkey % 4 AS branch FROM part WHERE p_size >= 45",
    "balances": "SELECT (SELECT sum(o_totalprice) FILTER (o_orderstatus = 'O') FROM orders) AS receivable, (SELECT sum(s_acctbal) FILTER (s_acctbal > 0) FROM supplier) AS payable, (SELECT sum(c_acctbal) FILTER (c_acctbal > 0) FROM customer) AS opening_cash",
    "remarks": "SELECT conv_id, turn, text FROM conversations WHERE role = 'user'",
}
_NEEDS = {"ledger_transactions": ["transactions"], "ledger_expenses": ["transactions", "ledger_transactions"], "purchases": ["order_lines"], "inventory": ["order_lines"], "expenses": ["transactions"], "cashflow": ["transactions"], "payroll": ["employees"]}


def with_entities(body: str) -> str:
    """The body, a SELECT or further common table expressions, after the entities whose names it holds."""
    wanted: list[str] = []
    for name in ENTITY_SQL:
        if name in body:
            wanted += [x for x in [*_NEEDS.get(name, []), name] if x not in wanted]
    head = ",\n".join(f"{n} AS ({ENTITY_SQL[n]})" for n in wanted)
    if not head:
        return body
    body = body.strip()
    return f"WITH {head}{',' + body[4:] if body[:5].upper() == 'WITH ' else chr(10) + body}"
