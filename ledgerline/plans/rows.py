"""Row rules at work: parsers, enums, predicates and row amounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parsing as P
from ..functions.money import ex_tax, normalise_currencies, revenue_base
from ..functions.rules import is_revenue_order
from ..operators import derive
from ..operators.row_import import Entity, Field, normalise
from ..sources import catalog as cat
from .base import Part

part = Part()
c = F.col


@part.query("SELECT DISTINCT p_type AS raw, trim(regexp_replace(lower(p_type), '[^a-z0-9]+', '_', 'g'), '_') AS canonical FROM part")
def n_canonical_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = cat.table(spark, sf_dir, "part").select(c("p_type").alias("raw")).distinct()
    return t.select("raw", P.canonical_key(c("raw")).alias("canonical"))


def _written_amount() -> Column:
    """l_extendedprice written the French, English and Swiss way."""
    en = F.format_number("l_extendedprice", 2)
    return F.when(c("l_linenumber") % 3 == 0, F.concat(F.translate(F.translate(F.translate(en, ",", "_"), ".", ","), "_", " "), F.lit(" $"))).when(c("l_linenumber") % 3 == 1, en).otherwise(F.translate(en, ",", "'"))


@part.query("SELECT l_orderkey AS k, l_linenumber AS i, round(l_extendedprice, 2) AS parsed FROM lineitem")
def n_parse_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All amounts written the French, English and Swiss way, and back."""
    li = cat.table(spark, sf_dir, "lineitem")
    return li.select(c("l_orderkey").alias("k"), c("l_linenumber").alias("i"), F.round(P.parse_number(_written_amount()), 2).alias("parsed"))


@part.query("SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS parsed FROM orders")
def n_parse_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates written as ISO, day first, spreadsheet serial and text, and back."""
    o = cat.table(spark, sf_dir, "orders")
    d = F.to_date("o_orderdate")
    k = c("o_orderkey") % 4
    text = F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "dd/MM/yyyy")).when(k == 2, F.datediff(d, F.lit("1899-12-30")).cast("string")).otherwise(F.concat_ws(" ", F.dayofmonth(d).cast("string"), F.element_at(F.array(*map(F.lit, P.MONTHS_FR)), F.month(d)), F.year(d).cast("string")))
    return o.select(c("o_orderkey").alias("k"), P.parse_date(text).alias("parsed"))


@part.query("SELECT max(CAST(day(o_orderdate) > 12 AS INT)) = 1 AS day_first, count(*) AS n FROM orders")
def n_column_convention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a column of D/M/Y or M/D/Y dates proves its order by a value over twelve."""
    text = F.date_format("o_orderdate", "dd/MM/yyyy")
    return cat.table(spark, sf_dir, "orders").agg((P.date_convention(text) == "DMY").alias("day_first"), F.count(F.lit(1)).alias("n"))


@part.query("SELECT CASE WHEN user_id % 9 = 0 THEN 'MISSING_DATE:date' WHEN value > 95 THEN 'INVALID_NUMBER:amount' END AS reason, count(*) AS n FROM events GROUP BY 1")
def n_missing_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reason code of the first required field that a row lacks, or has and cannot be read."""
    e = cat.table(spark, sf_dir, "events")
    raw = e.select(c("event_id").alias("row_no"), F.when(c("user_id") % 9 != 0, F.to_date("ts").cast("string")).alias("date"), F.when(c("value") > 95, "n/a").otherwise(c("value").cast("string")).alias("amount"))
    entity = Entity("Row", (Field("date", "date", required=True), Field("amount", "number", required=True)))
    return normalise(raw, entity).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


_CENTS = "floor(({}) * 100 + 0.5) / 100"


@part.query(f"SELECT employee_id, {_CENTS.format('annual_salary / (52 * 37.5)')} AS hourly_rate FROM employees")
def n_hourly_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.employee(cat.employees(spark, sf_dir), 2001).select("employee_id", "hourly_rate")


@part.query(f"SELECT employee_id, CAST(period AS VARCHAR) AS period, {_CENTS.format('regular_pay + overtime + employer_cost')} AS total_cost FROM payroll")
def n_payroll_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cost of a slip whose total is not given."""
    return derive.payroll(cat.payroll(spark, sf_dir).drop("total_cost")).select("employee_id", "period", "total_cost")


@part.query(f"""WITH r AS (SELECT order_id, line_no, product_id, {_CENTS.format('subtotal')} AS revenue, {_CENTS.format('quantity * (cost / quantity)')} AS total_cost FROM order_lines), p AS (SELECT *, {_CENTS.format('revenue - total_cost')} AS gross_profit FROM r)
SELECT order_id, line_no, product_id, revenue, gross_profit, {_CENTS.format('gross_profit * 100 / revenue')} AS gross_margin FROM p""")
def n_order_derivations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derivations of every order: revenue ex tax from a net subtotal, cost, profit and margin."""
    o = cat.order_lines(spark, sf_dir).withColumn("unit_cost", c("cost") / c("quantity"))
    return derive.order(o).select(c("order_id").cast("long").alias("order_id"), "line_no", "product_id", c("total_revenue").alias("revenue"), "gross_profit", "gross_margin")


@part.query(f"SELECT campaign_id, date, {_CENTS.format('revenue / nullif(spend, 0)')} AS roas, {_CENTS.format('nullif(spend, 0) / nullif(conversions, 0)')} AS cac FROM campaign_days")
def n_campaign_derivations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.campaign(cat.campaign_days(spark, sf_dir)).select("campaign_id", "date", "roas", "cac")


_CLASS = "CASE WHEN status = 'returned' THEN 'refunded' WHEN status = 'completed' THEN 'completed' WHEN status = 'pending' THEN 'pending' ELSE 'unknown' END"


@part.query(f"SELECT {_CLASS} AS class, count(*) AS n, count(*) FILTER ({_CLASS} IN ('completed', 'pending')) AS revenue_rows FROM order_lines GROUP BY 1")
def p_classify_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = P.classify_status(c("status"))
    return cat.order_lines(spark, sf_dir).groupBy(k.alias("class")).agg(F.count(F.lit(1)).alias("n"), F.count_if(is_revenue_order(k)).alias("revenue_rows"))


@part.query("SELECT sum(CAST(department = 'Ventes' AS INT)) > 0 AS has_sales, count(*) FILTER (status = 'quitté') AS leavers FROM employees")
def p_leavers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat.employees(spark, sf_dir).agg((F.count_if(c("department") == "Ventes") > 0).alias("has_sales"), F.count_if(P.is_leaver(c("status"))).alias("leavers"))


@part.query("SELECT product_id, warehouse_id, date, CASE WHEN closing_stock <= 0 THEN 'rupture' WHEN closing_stock < 10 THEN 'proche_rupture' WHEN closing_stock < reorder_point THEN 'faible' ELSE 'normal' END AS status FROM inventory JOIN products USING (product_id)")
def p_stock_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = cat.inventory(spark, sf_dir).join(cat.products(spark, sf_dir).select("product_id", "reorder_point"), "product_id")
    s = c("closing_stock")
    return i.select("product_id", "warehouse_id", "date", F.when(s <= 0, "rupture").when(s < 10, "proche_rupture").when(s < c("reorder_point"), "faible").otherwise("normal").alias("status"))


@part.query("SELECT count(*) AS n, round(sum(subtotal), 2) AS ex_tax FROM order_lines")
def t_ex_tax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ex-tax amount of differently filled lines is the same."""
    o = cat.order_lines(spark, sf_dir)
    k = c("line_no") % 3
    none = F.lit(None).cast("double")
    gross = c("quantity") * c("unit_price")
    ht = ex_tax(F.when(k == 0, c("subtotal")).otherwise(none), F.when(k == 1, gross).otherwise(none), c("total"), c("tax"), F.when(k == 1, c("discount")).otherwise(none), c("quantity"), c("unit_price"))
    return o.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(ht), 2).alias("ex_tax"))


@part.query("SELECT currency AS reference FROM transactions GROUP BY currency ORDER BY count(*) DESC, currency LIMIT 1")
def t_reference_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalise_currencies(cat.transactions(spark, sf_dir)).select("reference").distinct()


@part.query("""SELECT 'net' AS file, 'HT' AS base, count(*) AS n FROM order_lines UNION ALL SELECT 'gross', 'TTC', count(*) FROM order_lines UNION ALL SELECT 'unsaid', NULL, count(*) FROM order_lines""")
def t_revenue_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What revenue is told in, for files with subtotals, with amounts whose header says that tax is in, and with neither."""
    o = cat.order_lines(spark, sf_dir).select("subtotal", "total", "tax")
    bare = o.select("total")
    files = {"net": o, "gross": bare.withColumn("original_data", F.to_json(F.struct(c("total").alias("Montant TTC")))), "unsaid": bare.withColumn("original_data", F.to_json(F.struct(c("total").alias("Montant"))))}
    every = [revenue_base(df).select(F.lit(name).alias("file"), "base", "n") for name, df in files.items()]
    return every[0].unionAll(every[1]).unionAll(every[2])


@part.query("SELECT asset_id, CASE WHEN dpa_rate > 1 THEN dpa_rate / 100 ELSE dpa_rate END AS rate FROM assets")
def t_depreciation_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.money import depreciation_rate

    return cat.assets(spark, sf_dir).select("asset_id", depreciation_rate(c("dpa_rate")).alias("rate"))


@part.query("WITH g AS (SELECT category, sum(1) AS n FROM products GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, category) AS i FROM g) SELECT CASE WHEN i <= 5 THEN category ELSE 'Autres' END AS label, sum(n)::BIGINT AS n FROM r GROUP BY 1")
def t_small_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five largest slices and the others together."""
    g = cat.products(spark, sf_dir).groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    top = g.orderBy(F.desc("n"), "category").limit(5).select("category", F.lit(True).alias("top"))
    return g.join(F.broadcast(top), "category", "left").groupBy(F.when(c("top"), c("category")).otherwise("Autres").alias("label")).agg(F.sum("n").alias("n"))
