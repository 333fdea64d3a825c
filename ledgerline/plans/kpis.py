"""The catalogue of key indicators.

Orders, transactions, expenses and payroll are summed by month into one cube, of as many rows as they have months;
the whole period's measures are sums over it, and so are those of the months that several sources share: an
indicator of several sources takes the intersection of their ranges of months (rows without a date stay, a source of
one month aligns nothing, without a common month the indicator is not measured). The other entities give one
aggregate each; the one-row results are crossed, every indicator is an expression over them, and one unpivot gives
rows of (kpi, value, status). An unknown input is never zero: the value is null and the status NOT_MEASURED; a measured
0 is VALID_ZERO; what lacks a part of its inputs, or rows left out for want of an exchange rate, is UNKNOWN, and so is
what rests on it; what is not finite is INVALID.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.money import RATES, REFERENCE, depreciation_rate, rate
from ..functions.parsing import NEGATIVE, POSITIVE, is_leaver, sentiment
from ..functions.rules import has_moved, is_credit_note, is_expense, is_income, is_sale, out_of_revenue
from ..operators.booking import already_booked
from ..sources import catalog as cat
from ..sources.catalog import with_entities


@dataclass(frozen=True)
class Kpi:
    """expr: over measures and earlier indicators. partial: rests on transactions, some of which may lack a rate.
    parts: measures that count as 0 where they are unknown, which makes the value partial."""

    id: str
    expr: str
    unit: str
    partial: bool = False
    parts: tuple[str, ...] = ()


def _ratio(a: str, b: str, times: str = "100") -> str:
    return f"({a}) * {times} / nullif({b}, 0)"


def _expense(x: str = "") -> str:
    """Expenses, and the transactions that aren't booked elsewhere; unknown where transactions net to nothing and none was booked.

    x: the suffix of the measures of a common period.
    """
    net = f"greatest(0.0, txn_open{x} - txn_twice{x})"
    return f"CASE WHEN txn_expense{x} IS NULL AND opex{x} IS NULL THEN NULL WHEN opex{x} IS NOT NULL THEN {net} + opex{x} WHEN {net} > 0 THEN {net} WHEN booked{x} > 0 THEN 0.0 END"


#: What the indicators of several sources rest on, over the months that all of them share ("4": orders, transactions,
#: expenses and payroll; "3": without expenses). A measure, so that no indicator is named twice.
_SHARED = {"revenue4": "coalesce(order_revenue4, income4)", "expense4": _expense("4"), "revenue3": "coalesce(order_revenue3, income3)"}
_CHARGES = "coalesce(cogs4, 0) + coalesce(expense4, 0) + coalesce(payroll4, 0)"
_NO_CHARGE = "expense4 IS NULL AND payroll4 IS NULL"
_COSTS = ("cogs4", "expense4", "payroll4")

KPIS = [
    Kpi("total_revenue", "coalesce(order_revenue, income)", "currency"),
    Kpi("total_expense", _expense(), "currency", True),
    Kpi("payroll_total", "payroll_cost", "currency"),
    Kpi("employee_count_raw", "nullif(n_staff_all, 0) * 1.0", "count"),
    Kpi("employee_count", "nullif(n_staff, 0) * 1.0", "count"),
    Kpi("rh_expense_ratio", _ratio("payroll3", "revenue3"), "percentage"),
    Kpi("revenue_per_employee", _ratio("total_revenue", "employee_count", "1.0"), "currency"),
    Kpi("avg_employee_cost", "coalesce(payroll_total / nullif(employee_count, 0), mean_employer_cost)", "currency"),
    Kpi("overtime_ratio", _ratio("overtime", "regular_pay + overtime"), "percentage"),
    Kpi("gross_margin_amount", "total_revenue - cogs", "currency"),
    Kpi("gross_margin_pct", _ratio("total_revenue - cogs", "total_revenue"), "percentage"),
    Kpi("ebitda", f"CASE WHEN NOT ({_NO_CHARGE}) THEN revenue4 - ({_CHARGES}) END", "currency", True, _COSTS),
    Kpi("net_income", "ebitda - coalesce(dpa, 0) * months4 / 12", "currency", True),
    Kpi("order_revenue", "order_revenue", "currency"),
    Kpi("cogs_total", "cogs", "currency"),
    Kpi("total_charges", f"CASE WHEN NOT ({_NO_CHARGE}) THEN {_CHARGES} + coalesce(dpa, 0) * months4 / 12 END", "currency", True, _COSTS),
    Kpi("net_margin_pct", _ratio("net_income", "revenue4"), "percentage", True),
    Kpi("cash_runway", "CASE WHEN closing_cash = 0 THEN 0.0 WHEN net_flow < 0 THEN closing_cash / (abs(net_flow) / cash_days * 30.416) ELSE NULL END", "months"),
    Kpi("net_burn_rate", "net_flow", "currency"),
    Kpi("bfr", "CASE WHEN receivable IS NULL AND payable IS NULL THEN NULL ELSE coalesce(receivable, 0) + coalesce(stock_value, 0) - coalesce(payable, 0) END", "currency", False, ("receivable", "stock_value", "payable")),
    Kpi("bfr_days", _ratio("bfr", "total_revenue", "days"), "days"),
    Kpi("dso", _ratio("receivable", "total_revenue", "days"), "days"),
    Kpi("dpo", _ratio("payable", "total_expense", "days"), "days", True),
    Kpi("cac", _ratio("spend", "new_customers", "1.0"), "currency"),
    Kpi("roas", _ratio("campaign_revenue", "spend", "1.0"), "ratio"),
    Kpi("marketing_roi", _ratio("campaign_revenue - spend", "spend"), "percentage"),
    Kpi("cpc", _ratio("spend", "clicks", "1.0"), "currency"),
    Kpi("cpm", _ratio("spend", "impressions", "1000"), "currency"),
    Kpi("order_count", "n_orders * 1.0", "count"),
    Kpi("aov", _ratio("order_revenue + returns", "n_orders", "1.0"), "currency"),
    Kpi("gross_sales", "gross_sales", "currency"),
    Kpi("returns_amount", "returns", "currency"),
    Kpi("return_rate", _ratio("returns", "gross_sales"), "percentage"),
    Kpi("purchase_frequency", _ratio("n_orders_buyer", "n_buyers", "1.0"), "ratio"),
    Kpi("active_customers", "CASE WHEN n_customers > 0 THEN n_active * 1.0 END", "count"),
    Kpi("churn_rate", _ratio("n_lost", "n_customers"), "percentage"),
    Kpi("arpu", _ratio("revenue_buyer", "n_buyers", "1.0"), "currency"),
    Kpi("ltv", "arpu / nullif(churn_rate / 100, 0)", "currency"),
    Kpi("ltv_cac_ratio", _ratio("ltv", "cac", "1.0"), "ratio"),
    Kpi("customer_sentiment_score", "CASE WHEN sentiment IS NOT NULL THEN least(10.0, greatest(0.0, 5 + 5 * sentiment)) END", "score"),
    Kpi("tps_payable", "tax_federal", "currency"),
    Kpi("tvq_payable", "tax_provincial", "currency"),
    Kpi("inventory_value_total", "stock_value", "currency"),
    Kpi("inventory_value_average", "stock_average", "currency"),
    Kpi("stock_turnover_rate", _ratio("cogs", "stock_average", "1.0"), "ratio"),
    Kpi("dio", _ratio("days", "stock_turnover_rate", "1.0"), "days"),
    Kpi("critical_sku_rate", "critical_share * 100", "percentage"),
    Kpi("employer_cost_total", "employer_total", "currency"),
    Kpi("employer_charge_rate", _ratio("employer_total - payroll_total", "payroll_total"), "percentage"),
    Kpi("avg_seniority", "seniority", "years"),
    Kpi("net_book_value_total", "net_book_value", "currency"),
    Kpi("asset_depreciation_rate", _ratio("accumulated", "initial_cost"), "percentage"),
    Kpi("dpa_annual_total", "dpa", "currency"),
    Kpi("discount_rate", _ratio("discount_amount", "order_revenue + discount_amount"), "percentage"),
    Kpi("loyalty_liability", "points * 0.05", "currency"),
    Kpi("stock_availability", "100 - critical_sku_rate", "percentage"),
    Kpi("weighted_esg_score", "esg", "score"),
    Kpi("currency_exposure", "foreign_share * 100", "percentage"),
    Kpi("local_sourcing_ratio_qc", "local_share * 100", "percentage"),
    Kpi("sales_productivity", _ratio("total_revenue", "n_sales_staff", "1.0"), "currency"),
    Kpi("unionization_rate", "union_share * 100", "percentage"),
    Kpi("credit_utilization_ratio", _ratio("receivable", "credit_limit"), "percentage"),
]

#: What the engine reads of each entity; a frame without a column, or no frame at all, leaves its measures unknown.
READS = {
    "order_lines": "order_id string, customer_id string, date date, quantity double, unit_price double, discount double, subtotal double, tax_federal double, tax_provincial double, cost double, status string",
    "transactions": "transaction_id string, date date, amount double, type string, currency string, status string, category string, description string", "expenses": "expense_id string, date date, amount double",
    "payroll": "employee_id string, period date, regular_pay double, overtime double, employer_cost double, total_cost double",
    "employees": "employee_id string, department string, status string, union_status string, seniority_years double, total_employer_cost double", "cashflow": "date date, cash_in double, cash_out double",
    "balances": "receivable double, payable double, opening_cash double", "campaign_days": "date date, spend double, revenue double, clicks double, impressions double, new_customers double",
    "customers": "customer_id string, status string, loyalty_points double, credit_limit double", "remarks": "text string", "inventory": "product_id string, warehouse_id string, date date, closing_stock double, inventory_value double",
    "suppliers": "supplier_id string, esg_score double, province string", "assets": "asset_id string, initial_cost double, accumulated_depreciation double, net_book_value double, dpa_rate double",
}
#: Flows count inside a period, balances and stocks up to its end; reference rows always.
FLOWS = {"order_lines": "date", "transactions": "date", "expenses": "date", "payroll": "period", "campaign_days": "date"}
UP_TO = {"cashflow": "date", "inventory": "date"}
#: Keys that rows are only grouped by, and keep their type: a cast would hide that rows lie together by them already.
GROUPED = {"inventory": ("product_id", "warehouse_id")}


def not_given(frames: dict[str, DataFrame], ids: list[str] | None = None) -> list[str]:
    """Entities that the indicators asked for read and that nobody passed: forgotten, not empty."""
    wanted = {w for k in needed(ids) for w in _names(" ".join([k.expr, *(_SHARED.get(x, "") for x in _names(k.expr))]))}
    read = {e for e, own in SOURCES.items() if e in READS and {w.rstrip("34") for w in wanted} & {x for x in own.split()}}
    return sorted(read - frames.keys())


def readable(spark: SparkSession, frames: dict[str, DataFrame], start: str | None = None, end: str | None = None) -> dict[str, DataFrame]:
    """Every entity with the columns of READS, nulls where a frame lacks one, filtered to the period."""
    out = {}
    for name, schema in READS.items():
        df = frames.get(name)
        if df is None:
            out[name] = spark.createDataFrame([], schema)
            continue
        kinds = [x.split() for x in schema.split(", ")]
        df = df.select(*(F.col(n) if n in GROUPED.get(name, ()) and n in df.columns else (F.col(n) if n in df.columns else F.lit(None)).cast(k).alias(n) for n, k in kinds))
        if (d := FLOWS.get(name)) and start:
            df = df.filter(F.col(d) >= F.lit(start).cast("date"))
        if (d := FLOWS.get(name) or UP_TO.get(name)) and end:
            df = df.filter(F.col(d) <= F.lit(end).cast("date"))
        out[name] = df
    return out


#: Sources of each set of shared months, in order.
ALIGNED = {"4": ("order_lines", "transactions", "expenses", "payroll"), "3": ("order_lines", "transactions", "payroll")}


def monthly_cube(e: dict[str, DataFrame], rates: dict[str, float] | None = None) -> DataFrame:
    """One row a source and month (null: rows without a date): source, month, a, b (first and last day) and sums.

    Lines, transactions and slips are summed where they are read; only (source, month) rows are shuffled.
    """
    c = F.col
    m = lambda d: F.trunc(d, "month").alias("month")
    span = lambda d: (F.min(d).alias("a"), F.max(d).alias("b"))
    out, credit = out_of_revenue(c("status"), c("unit_price")), is_credit_note(c("quantity"), c("subtotal"))
    sale, named = is_sale(out, credit, c("subtotal")), c("customer_id").isNotNull()
    lines = e["order_lines"].groupBy(m("date")).agg(
        *span("date"), F.count(F.lit(1)).alias("n_lines"), *(F.sum(F.when(~out, x)).alias(k) for k, x in (("order_revenue", c("subtotal")), ("cogs", c("cost")), ("tax_federal", c("tax_federal")), ("tax_provincial", c("tax_provincial")), ("discount_amount", c("subtotal") / (1 - c("discount")) * c("discount")))),
        F.sum(F.when(sale, c("subtotal"))).alias("gross_sales"), F.sum(F.when(~out & credit, F.abs("subtotal"))).alias("returned"), F.sum(F.when(~out & named, c("subtotal"))).alias("revenue_buyer"),
    )
    t = e["transactions"].withColumn("cad", c("amount") * rate(c("currency"), rates))
    spent = already_booked(t.filter(is_expense(c("type"))), e["expenses"], e["payroll"])
    t = t.filter(~is_expense(c("type"))).withColumn("booked_by", F.lit(None).cast("string")).unionByName(spent)
    moved, paid, booked, owed = has_moved(c("status")), is_expense(c("type")), c("booked_by").isNotNull(), F.abs("cad")
    moves = t.groupBy(m("date")).agg(
        *span("date"), F.sum(F.when(moved & is_income(c("type")), c("cad"))).alias("income"), F.sum(F.when(moved & paid, owed)).alias("txn_expense"), F.sum(F.when(moved & paid & ~booked, owed)).alias("txn_open"),
        F.sum(F.when(~moved & booked, owed)).alias("txn_twice"), F.sum(F.when(booked, owed)).alias("booked"), F.sum((moved & c("cad").isNull() & c("amount").isNotNull()).cast("int")).alias("n_left_out"),
        F.sum(F.when(paid, (F.upper(F.trim("currency")) != REFERENCE).cast("int"))).alias("n_foreign"), F.sum(F.when(paid & c("currency").isNotNull(), 1)).alias("n_spent"),
    )
    opex = e["expenses"].groupBy(m("date")).agg(*span("date"), F.sum("amount").alias("opex"))
    paid_out = e["payroll"].groupBy(m("period")).agg(*span("period"), F.sum("total_cost").alias("payroll_cost"), F.sum("overtime").alias("overtime"), F.sum("regular_pay").alias("regular_pay"))
    cube = None
    for name, df in zip(ALIGNED["4"], (lines, moves, opex, paid_out), strict=True):
        df = df.withColumn("source", F.lit(name))
        cube = df if cube is None else cube.unionByName(df, allowMissingColumns=True)
    return cube


def _months(a: Column, b: Column) -> Column:
    return (F.months_between(F.trunc(b, "month"), F.trunc(a, "month")) + 1).cast("int")


def from_cube(cube: DataFrame) -> DataFrame:
    """One row: sums over the whole cube, and with a suffix those over the months that a set of sources shares."""
    c = F.col
    every = Window.partitionBy(F.lit(1))  # a row a source and month
    inside = {}
    for x, sources in ALIGNED.items():
        end = lambda s, f: f(F.when(c("source") == s, c("month"))).over(every)
        first, last = [end(s, F.min) for s in sources], [end(s, F.max) for s in sources]
        present = sum((a.isNotNull().cast("int") for a in first), F.lit(0))
        lone = reduce(lambda p, q: p | q, (F.coalesce(a == b, F.lit(False)) for a, b in zip(first, last, strict=True)))
        cube = cube.withColumns({f"from{x}": F.greatest(*first), f"to{x}": F.least(*last), f"present{x}": present, f"lone{x}": lone})
        cube = cube.withColumn(f"empty{x}", (c(f"present{x}") > 1) & F.coalesce(c(f"from{x}") > c(f"to{x}"), F.lit(False)))
        free = (c(f"present{x}") < 2) | c(f"lone{x}") | ~c("source").isin(*sources) | c("month").isNull()
        inside[x] = ~c(f"empty{x}") & (free | c("month").between(c(f"from{x}"), c(f"to{x}")))
    total = lambda k, x="": (F.sum(F.when(inside[x], c(k))) if x else F.sum(k)).alias(f"{k}{x}")
    sold = c("source").isin("order_lines", "transactions")
    day = lambda x, f, k, w: f(F.when((inside[x] if x else F.lit(True)) & w, c(k)))
    # the period is that of the sales; without any, that of the expenses
    edge = lambda x, f, k: F.coalesce(day(x, f, k, sold), day(x, f, k, c("source") == "expenses"))
    some = lambda k, x="": F.coalesce(total(k, x), F.lit(0.0)).alias(f"{k}{x}")
    return cube.agg(
        *(total(k) for k in ("order_revenue", "cogs", "tax_federal", "tax_provincial", "discount_amount", "gross_sales", "revenue_buyer", "income", "txn_expense", "opex", "payroll_cost", "overtime", "regular_pay")),
        *(some(k) for k in ("txn_open", "txn_twice", "booked")), (F.coalesce(F.sum("n_left_out"), F.lit(0)) > 0).alias("left_out"), (F.sum("n_foreign") / F.nullif(F.sum("n_spent"), F.lit(0))).alias("foreign_share"),
        F.when(F.sum("n_lines") > 0, F.coalesce(F.sum("returned"), F.lit(0.0))).alias("returns"), (F.datediff(edge("", F.max, "b"), edge("", F.min, "a")) + 1).alias("days"), _months(edge("", F.min, "a"), edge("", F.max, "b")).alias("months"),
        *(total(k, x) for x in ALIGNED for k in ("order_revenue", "income", "cogs", "txn_expense", "opex")), *(F.sum(F.when(inside[x], c("payroll_cost"))).alias(f"payroll{x}") for x in ALIGNED),
        *(some(k, "4") for k in ("txn_open", "txn_twice", "booked")), F.coalesce(_months(edge("4", F.min, "a"), edge("4", F.max, "b")), F.lit(12)).alias("months4"),
        *(f(f"{k}{x}").alias(f"{k}{x}") for x in ALIGNED for k, f in (("from", F.max), ("to", F.max), ("empty", F.max), ("present", F.max), ("lone", F.max))),
    )


def measures(spark: SparkSession, frames: dict[str, DataFrame], start: str | None = None, end: str | None = None, rates: dict[str, float] | None = None, asked: list[Kpi] | None = None) -> DataFrame:
    """One row of all base measures: the cube's sums, and one aggregate for each other entity (that `asked` indicators read), crossed."""
    c = F.col
    e = readable(spark, frames, start, end)
    row = from_cube(monthly_cube(e, rates))
    o = e["order_lines"]
    sale = is_sale(out_of_revenue(c("status"), c("unit_price")), is_credit_note(c("quantity"), c("subtotal")), c("subtotal"))
    # rows without an order id are no orders, and rows with neither id are nobody's. No filter by an id: both counts read the same pairs
    pairs = o.withColumn("order_id", F.nullif(F.trim("order_id"), F.lit(""))).groupBy("order_id", "customer_id").agg(F.max(sale).alias("sale"))
    has_order, has_customer = c("order_id").isNotNull(), c("customer_id").isNotNull()
    by_order = pairs.groupBy("order_id").agg(F.max("sale").alias("sale"), F.max(c("sale") & has_customer).alias("named"))
    n_orders = by_order.agg(F.sum(F.when(has_order, c("sale").cast("int"))).alias("n_orders"), F.sum(F.when(has_order, c("named").cast("int"))).alias("n_orders_buyer"))
    buyers = pairs.groupBy("customer_id").agg(F.max("sale").alias("sale")).agg(F.count_if(c("sale") & has_customer).alias("n_buyers"))
    staff_all = e["employees"].select("employee_id").union(e["payroll"].select("employee_id")).agg(F.countDistinct("employee_id").alias("n_staff_all"))
    gone = F.coalesce(is_leaver(c("status")), F.lit(False))
    staff = e["employees"].agg(
        F.countDistinct(F.when(~gone, c("employee_id"))).alias("n_staff"), F.avg("total_employer_cost").alias("mean_employer_cost"), F.sum("total_employer_cost").alias("employer_total"), F.avg("seniority_years").alias("seniority"),
        F.sum(F.lower("department").contains("vente").cast("int")).alias("n_sales_staff"), F.avg(F.lower("union_status").rlike("syndiqué|oui|yes").cast("int")).alias("union_share"),
    )
    flow = e["cashflow"].agg(F.sum(c("cash_in") - c("cash_out")).alias("net_flow"), (F.datediff(F.max("date"), F.min("date")) + 1).alias("cash_days"))
    owed = e["balances"].agg(F.max("receivable").alias("receivable"), F.max("payable").alias("payable"), F.max("opening_cash").alias("opening_cash"))
    flow = flow.crossJoin(owed).withColumn("closing_cash", c("opening_cash") + c("net_flow"))
    m = e["campaign_days"].agg(*(F.sum(k).alias(a) for k, a in (("spend", "spend"), ("revenue", "campaign_revenue"), ("clicks", "clicks"), ("impressions", "impressions"), ("new_customers", "new_customers"))))
    cu = e["customers"].agg(F.count_if(F.lower("status").isin("actif", "active")).alias("n_active"), F.count_if(F.lower("status").isin("perdu", "lost", "inactif")).alias("n_lost"), F.count(F.lit(1)).alias("n_customers"), F.sum("loyalty_points").alias("points"), F.sum("credit_limit").alias("credit_limit"))
    feel = e["remarks"].filter("text IS NOT NULL").agg(F.avg(F.signum(sentiment(c("text")).cast("double"))).alias("sentiment"))
    last, first = F.max_by("inventory_value", "date"), F.min_by("inventory_value", "date")
    per = e["inventory"].groupBy("product_id", "warehouse_id").agg(last.alias("last"), first.alias("first"), F.count_if(c("closing_stock") < 10).alias("critical"), F.count("closing_stock").alias("n"))
    stock = per.agg(F.sum("last").alias("stock_value"), F.sum((c("first") + c("last")) / 2).alias("stock_average"), (F.sum("critical") / F.nullif(F.sum("n"), F.lit(0))).alias("critical_share"))
    su = e["suppliers"].agg(F.avg("esg_score").alias("esg"), F.avg(F.lower("province").rlike("qc|québec").cast("int")).alias("local_share"))
    a = e["assets"].agg(F.sum("net_book_value").alias("net_book_value"), F.sum("accumulated_depreciation").alias("accumulated"), F.sum("initial_cost").alias("initial_cost"), F.sum(c("net_book_value") * depreciation_rate(c("dpa_rate"))).alias("dpa"))
    wanted = None if asked is None else {w for k in asked for w in _names(" ".join([k.expr, *k.parts]))}
    for one in (n_orders, buyers, staff_all, staff, flow, m, cu, feel, stock, su, a):
        if wanted is None or wanted & set(one.columns):  # a row that no indicator reads is not worked out
            row = row.crossJoin(F.broadcast(one))  # rows of one
    return row.withColumns({name: F.expr(expr) for name, expr in _SHARED.items()})


def ordered(kpis: list[Kpi] | None = None) -> list[Kpi]:
    """Indicators so that each comes after those its expression names; a cycle is an error."""
    kpis = KPIS if kpis is None else kpis
    by = {k.id: k for k in kpis}
    needs = {k.id: {w for w in re.findall(r"[a-z_0-9]+", k.expr) if w in by and w != k.id} for k in kpis}
    out: list[str] = []
    while len(out) < len(by):
        ready = [i for i in by if i not in out and needs[i] <= {*out}]
        if not ready:
            raise ValueError(f"indicators depend on each other: {sorted(set(by) - set(out))}")
        out += ready
    return [by[i] for i in out]


def needed(ids: list[str] | None) -> list[Kpi]:
    """The indicators asked for with all that they rest on, in order of dependence (A3, A4)."""
    every = ordered()
    if ids is None:
        return every
    by, wanted = {k.id: k for k in every}, set(ids)
    for k in reversed(every):
        if k.id in wanted:
            wanted |= {w for w in re.findall(r"[a-z_0-9]+", k.expr) if w in by}
    return [k for k in every if k.id in wanted]


def _names(expr: str) -> list[str]:
    return re.findall(r"[a-z_0-9]+", expr)


def evaluated(row: DataFrame, asked: list[Kpi]) -> DataFrame:
    """The measures' row with a column for every indicator, and for whether it is partial (`<id>__partial`)."""
    base, done = set(row.columns), set()
    left = list(asked)
    while left:  # all indicators whose inputs are there at once: a projection a level, not one an indicator
        mine = {k.id for k in left}
        level = {}
        for k in left:
            rests_on = [w for w in dict.fromkeys(_names(k.expr)) if w in mine | done and w != k.id and w not in base]
            if set(rests_on) <= done:
                whys = [F.col("left_out")] * k.partial + [F.col(p).isNull() for p in k.parts] + [F.col(f"{w}__partial") for w in rests_on]
                level |= {k.id: F.expr(k.expr).cast("double"), f"{k.id}__partial": reduce(lambda x, y: x | y, whys, F.lit(False))}
        if not level:
            raise ValueError(f"indicators depend on each other: {sorted(mine)}")
        row = row.withColumns(level)
        done |= level.keys()
        left = [k for k in left if k.id not in done]
    return row


def compute(spark: SparkSession, frames: dict[str, DataFrame], start: str | None = None, end: str | None = None, ids: list[str] | None = None, rates: dict[str, float] | None = None) -> DataFrame:
    """kpi, unit, value (rounded to four decimals), status of indicators over any frames and period.

    frames: entity -> DataFrame with (some of) the columns of READS. What they lack is NOT_MEASURED, never zero.
    rates: of each currency to the company's; RATES by default.
    """
    asked = needed(ids)
    row = evaluated(measures(spark, frames, start, end, rates, asked), asked)
    cells = [F.struct(F.lit(k.id).alias("kpi"), F.lit(k.unit).alias("unit"), F.col(k.id).alias("v"), F.col(f"{k.id}__partial").alias("partial")) for k in asked if ids is None or k.id in ids]
    return row.select(F.explode(F.array(*cells)).alias("x")).select("x.kpi", "x.unit", F.round(F.col("x.v"), 4).alias("value"), status_of(F.col("x.v"), F.col("x.partial")).alias("status"))


def status_of(v: Column, partial: Column) -> Column:
    return F.when(v.isNull(), "NOT_MEASURED").when(F.isnan(v) | (F.abs(v) == float("inf")), "INVALID").when(partial, "UNKNOWN").when(v == 0, "VALID_ZERO").otherwise("VALID")


#: The entity that each base measure comes from.
SOURCES = {
    "order_lines": "order_revenue cogs tax_federal tax_provincial gross_sales returns n_orders n_orders_buyer n_buyers revenue_buyer discount_amount days months", "transactions": "income txn_expense txn_open txn_twice booked foreign_share", "expenses": "opex",
    "payroll": "payroll payroll_cost overtime regular_pay", "employees": "n_staff_all n_staff mean_employer_cost employer_total seniority n_sales_staff union_share", "cashflow": "net_flow cash_days closing_cash", "balances": "receivable payable opening_cash",
    "shared months": "revenue4 expense4 cogs4 payroll4 months4 revenue3 payroll3", "campaign_days": "spend campaign_revenue clicks impressions new_customers", "customers": "n_active n_lost n_customers points credit_limit", "remarks": "sentiment", "inventory": "stock_value stock_average critical_share", "suppliers": "esg local_share", "assets": "net_book_value accumulated initial_cost dpa",
}
TRACED = ["total_revenue", "total_expense", "gross_margin_pct", "net_income", "cash_runway", "roas", "cac", "aov", "churn_rate", "ltv"]


def steps(kpi: Kpi) -> list[tuple[str, str]]:
    """What an indicator is worked out from, in order: (measure or indicator, its entity or 'indicator')."""
    entity = {m: e for e, ms in SOURCES.items() for m in ms.split()}
    ids = {k.id for k in KPIS}
    names = dict.fromkeys(re.findall(r"[a-z_0-9]+", kpi.expr))
    return [(n, "indicator" if n in ids and n not in entity else entity[n]) for n in names if n in entity or n in ids and n != kpi.id]


def trace(spark: SparkSession, frames: dict[str, DataFrame], start: str | None = None, end: str | None = None, ids: list[str] | None = None) -> DataFrame:
    """Q6, Q10: kpi, formula, position, step, source, value of every step of the indicators, the result last."""
    asked = needed(ids)
    row = evaluated(measures(spark, frames, start, end), asked)
    cells = []
    for k in asked:
        if ids is None or k.id in ids:
            for i, (name, source) in enumerate([*steps(k), (k.id, "result")], 1):
                cells.append(F.struct(F.lit(k.id).alias("kpi"), F.lit(k.expr).alias("formula"), F.lit(i).alias("position"), F.lit(name).alias("step"), F.lit(source).alias("source"), F.round(F.col(name).cast("double"), 4).alias("value")))
    return row.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def q_metric_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten traced indicators over the whole tables."""
    return trace(spark, cat.frames(spark, sf_dir), ids=TRACED)


def all_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All indicators over the whole tables."""
    return compute(spark, cat.frames(spark, sf_dir))


def a_kpi_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All indicators over the year 2000."""
    return compute(spark, cat.frames(spark, sf_dir), "2000-01-01", "2000-12-31")


#: The indicators over shared months, and the expenses that they rest on.
SHARED_KPIS = {"total_expense": "", "rh_expense_ratio": "3", "ebitda": "4", "net_income": "4", "total_charges": "4", "net_margin_pct": "4"}


def shared_months(spark: SparkSession, frames: dict[str, DataFrame], start: str | None = None, end: str | None = None, rates: dict[str, float] | None = None) -> DataFrame:
    """Kpi, value, status of the indicators of several sources, with the months that their sources share.

    Months are null where nothing was aligned: fewer than two sources with dates, or one of a single month.
    """
    asked = needed(list(SHARED_KPIS))
    row = evaluated(measures(spark, frames, start, end, rates, asked), asked)
    cells = []
    for k, x in SHARED_KPIS.items():
        aligned = (F.col(f"present{x}") > 1) & ~F.col(f"lone{x}") & ~F.col(f"empty{x}") if x else F.lit(False)
        month = lambda c, x=x, aligned=aligned: F.when(aligned, F.col(f"{c}{x}" if x else "from4"))
        cells.append(F.struct(F.lit(k).alias("kpi"), F.col(k).alias("v"), F.col(f"{k}__partial").alias("partial"), month("from").alias("first_month"), month("to").alias("last_month")))
    return row.select(F.explode(F.array(*cells)).alias("x")).select("x.kpi", F.round("x.v", 4).alias("value"), status_of(F.col("x.v"), F.col("x.partial")).alias("status"), "x.first_month", "x.last_month")


def a_kpi_common_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indicators of several sources over the bank's ledger: orders of seven years, entries of fourteen months, payroll of twelve."""
    frames = cat.frames(spark, sf_dir) | {"transactions": cat.ledger_transactions(spark, sf_dir), "expenses": cat.ledger_expenses(spark, sf_dir)}
    return shared_months(spark, frames)


def j_booked_elsewhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger's expense entries that an expense, a pay slip or a month's payroll has booked already."""
    return already_booked(cat.ledger_transactions(spark, sf_dir).filter(is_expense(F.col("type"))), cat.ledger_expenses(spark, sf_dir), cat.payroll(spark, sf_dir)).filter("booked_by IS NOT NULL").select("transaction_id", "date", "amount", "booked_by")


_CAD = " ".join(f"WHEN '{c}' THEN {r}" for c, r in RATES.items())


def _booked_sql(t: str, x: str, p: str) -> str:
    """Common table expressions that end in `bk`: expense transactions of t with booked_by, by expenses x and slips p."""
    return f"""
tk AS (SELECT *, row_number() OVER (PARTITION BY date, cents ORDER BY transaction_id) AS k FROM (SELECT *, CAST(round(abs(amount) * 100) AS BIGINT) AS cents FROM {t} WHERE type = 'expense')),
ek AS (SELECT date, CAST(round(abs(amount) * 100) AS BIGINT) AS cents, count(*) AS n_expenses FROM {x} GROUP BY 1, 2),
sk AS (SELECT period AS date, CAST(round(abs(total_cost) * 100) AS BIGINT) AS cents, count(*) AS n_slips FROM {p} GROUP BY 1, 2),
bk AS (SELECT tk.*, CASE WHEN k <= coalesce(n_expenses, 0) THEN 'expense' WHEN k <= coalesce(n_expenses, 0) + coalesce(n_slips, 0) THEN 'pay slip'
  WHEN regexp_matches(lower(category || ' ' || description), 'paie|salaire|payroll|remunerat') AND date_trunc('month', date) IN (SELECT date_trunc('month', period) FROM {p}) THEN 'month''s payroll' END AS booked_by
  FROM tk LEFT JOIN ek USING (date, cents) LEFT JOIN sk USING (date, cents))"""


#: Written from the rules: profit is what is left of one period's revenue, so all its parts are cut to the months in common first.
_COMMON_SQL = f"""
WITH o AS (SELECT date_trunc('month', date) AS month, date, subtotal, cost, status = 'returned' OR unit_price < 0 AS out FROM order_lines),
t AS (SELECT *, amount * CASE currency {_CAD} END AS cad, regexp_matches(lower(status), 'attente|pending|annul|draft') AS still FROM ledger_transactions),{_booked_sql("t", "ledger_expenses", "payroll")},
flows AS (
  SELECT 'Order' AS entity, month, date, CASE WHEN NOT out THEN subtotal END AS revenue, CASE WHEN NOT out THEN cost END AS cogs, NULL AS income, NULL AS spent, NULL AS taken, NULL AS opex, NULL AS pay, NULL AS unrated FROM o
  UNION ALL SELECT 'Transaction', date_trunc('month', date), date, NULL, NULL, CASE WHEN NOT still THEN cad END, NULL, NULL, NULL, NULL, CAST(NOT still AND cad IS NULL AS INT) FROM t WHERE type = 'income'
  UNION ALL SELECT 'Transaction', date_trunc('month', date), date, NULL, NULL, NULL, CASE WHEN NOT still THEN abs(cad) END, CASE WHEN booked_by IS NOT NULL THEN abs(cad) END, NULL, NULL, CAST(NOT still AND cad IS NULL AS INT) FROM bk
  UNION ALL SELECT 'Expense', date_trunc('month', date), date, NULL, NULL, NULL, NULL, NULL, amount, NULL, NULL FROM ledger_expenses
  UNION ALL SELECT 'Payroll', date_trunc('month', period), NULL, NULL, NULL, NULL, NULL, NULL, NULL, total_cost, NULL FROM payroll
), extent AS (SELECT entity, min(month) AS a, max(month) AS b FROM flows WHERE month IS NOT NULL GROUP BY 1),
asked(entities, x) AS (VALUES (['Order', 'Transaction', 'Expense', 'Payroll'], 'all'), (['Order', 'Transaction', 'Payroll'], 'pay'), ([]::VARCHAR[], 'none')),
shared AS (SELECT x, entities, max(a) AS a, min(b) AS b, count(*) FILTER (entity IS NOT NULL) > 1 AND NOT coalesce(bool_or(a = b), false) AS aligned FROM asked LEFT JOIN extent ON list_contains(entities, entity) GROUP BY ALL),
sums AS (
  SELECT x, any_value(aligned) AS aligned, any_value(shared.a) AS a, any_value(shared.b) AS b, coalesce(sum(revenue), sum(income)) AS total_revenue, sum(cogs) AS cogs, sum(pay) AS pay,
    CASE WHEN sum(spent) IS NULL AND sum(opex) IS NULL THEN NULL WHEN sum(opex) IS NULL THEN CASE WHEN sum(spent) - coalesce(sum(taken), 0) > 1e-6 THEN sum(spent) - coalesce(sum(taken), 0) WHEN sum(taken) > 0 THEN 0 END
      ELSE greatest(0, coalesce(sum(spent), 0) - coalesce(sum(taken), 0)) + sum(opex) END AS total_expense,
    date_diff('month', min(date) FILTER (entity IN ('Order', 'Transaction')), max(date) FILTER (entity IN ('Order', 'Transaction'))) + 1 AS months
  FROM shared JOIN flows ON NOT aligned OR NOT list_contains(entities, entity) OR month IS NULL OR month BETWEEN shared.a AND shared.b GROUP BY x
), dpa AS (SELECT sum(net_book_value * CASE WHEN dpa_rate > 1 THEN dpa_rate / 100 ELSE dpa_rate END) AS dpa FROM assets),
lacking AS (SELECT coalesce(sum(unrated), 0) > 0 AS left_out FROM flows),
v AS (
  SELECT 'total_expense' AS kpi, total_expense AS v, left_out AS partial, aligned, a, b FROM sums, lacking WHERE x = 'none'
  UNION ALL SELECT 'rh_expense_ratio', pay / total_revenue * 100, false, aligned, a, b FROM sums WHERE x = 'pay'
  UNION ALL SELECT 'ebitda', total_revenue - coalesce(cogs, 0) - coalesce(total_expense, 0) - coalesce(pay, 0), left_out, aligned, a, b FROM sums, lacking WHERE x = 'all'
  UNION ALL SELECT 'net_income', total_revenue - coalesce(cogs, 0) - coalesce(total_expense, 0) - coalesce(pay, 0) - dpa * months / 12, left_out, aligned, a, b FROM sums, lacking, dpa WHERE x = 'all'
  UNION ALL SELECT 'total_charges', coalesce(cogs, 0) + coalesce(total_expense, 0) + coalesce(pay, 0) + dpa * months / 12, left_out, aligned, a, b FROM sums, lacking, dpa WHERE x = 'all'
  UNION ALL SELECT 'net_margin_pct', (total_revenue - coalesce(cogs, 0) - coalesce(total_expense, 0) - coalesce(pay, 0) - dpa * months / 12) / total_revenue * 100, left_out, aligned, a, b FROM sums, lacking, dpa WHERE x = 'all'
)
SELECT kpi, round(v, 4) AS value, CASE WHEN v IS NULL THEN 'NOT_MEASURED' WHEN partial THEN 'UNKNOWN' WHEN v = 0 THEN 'VALID_ZERO' ELSE 'VALID' END AS status,
  CASE WHEN aligned THEN CAST(a AS DATE) END AS first_month, CASE WHEN aligned THEN CAST(b AS DATE) END AS last_month FROM v
"""


def _all_sql(start: str | None = None, end: str | None = None, traced: bool = False) -> str:
    words = lambda ws: " + ".join(f"CAST(contains(lower(text), '{w}') AS INT)" for w in ws)
    inside = lambda d: f" WHERE {d} BETWEEN DATE '{start}' AND DATE '{end}'" if start else ""
    until = lambda d: f" WHERE {d} <= DATE '{end}'" if end else ""
    cut = lambda x, d: f"(SELECT NOT empty AND (a IS NULL OR date_trunc('month', {d}) BETWEEN a AND b) FROM lim{x})"
    body = f"""
WITH o AS (SELECT *, status = 'returned' OR unit_price < 0 AS out, quantity < 0 OR subtotal < 0 AS credit FROM order_lines{inside('date')}),
f AS (SELECT *, NOT out AND NOT credit AND subtotal <> 0 AS sale FROM o),
t AS (SELECT *, amount * CASE currency {_CAD} END AS cad, NOT regexp_matches(lower(status), 'attente|pending|annul|draft') AS moved FROM transactions{inside('date')}),
xx AS (SELECT * FROM expenses{inside('date')}),
pp AS (SELECT * FROM payroll{inside('period')}),{_booked_sql("t", "xx", "pp")},
ext(s, a, b) AS (SELECT 'o', min(date), max(date) FROM o UNION ALL SELECT 't', min(date), max(date) FROM t UNION ALL SELECT 'x', min(date), max(date) FROM xx UNION ALL SELECT 'p', min(period), max(period) FROM pp),
em AS (SELECT s, date_trunc('month', a) AS a, date_trunc('month', b) AS b FROM ext),
lim4 AS (SELECT count(a) > 1 AND max(a) > min(b) AS empty, CASE WHEN count(a) > 1 AND NOT bool_or(a = b) THEN max(a) END AS a, CASE WHEN count(a) > 1 AND NOT bool_or(a = b) THEN min(b) END AS b FROM em),
lim3 AS (SELECT count(a) > 1 AND max(a) > min(b) AS empty, CASE WHEN count(a) > 1 AND NOT bool_or(a = b) THEN max(a) END AS a, CASE WHEN count(a) > 1 AND NOT bool_or(a = b) THEN min(b) END AS b FROM em WHERE s <> 'x'),
sold AS (SELECT date FROM o UNION ALL SELECT date FROM t),
m1 AS (SELECT sum(subtotal) FILTER (NOT out) AS order_revenue, sum(cost) FILTER (NOT out) AS cogs, sum(tax_federal) FILTER (NOT out) AS tax_federal, sum(tax_provincial) FILTER (NOT out) AS tax_provincial, sum(subtotal) FILTER (sale) AS gross_sales,
  coalesce(sum(abs(subtotal)) FILTER (NOT out AND credit), 0) AS returns, count(DISTINCT order_id) FILTER (sale) AS n_orders, count(DISTINCT order_id) FILTER (sale AND customer_id IS NOT NULL) AS n_orders_buyer,
  count(DISTINCT customer_id) FILTER (sale) AS n_buyers, sum(subtotal) FILTER (NOT out AND customer_id IS NOT NULL) AS revenue_buyer, sum(subtotal / (1 - discount) * discount) FILTER (NOT out) AS discount_amount FROM f),
m1a AS (SELECT date_diff('day', min(date), max(date)) + 1 AS days, date_diff('month', min(date), max(date)) + 1 AS months FROM sold),
m2 AS (SELECT sum(cad) FILTER (type = 'income' AND moved) AS income, sum(abs(cad)) FILTER (type = 'expense' AND moved) AS txn_expense, coalesce(bool_or(cad IS NULL) FILTER (moved), false) AS left_out, avg(CAST(currency <> 'CAD' AS INT)) FILTER (type = 'expense') AS foreign_share FROM t),
m3 AS (SELECT coalesce(sum(abs(cad)) FILTER (moved AND booked_by IS NULL), 0) AS txn_open, coalesce(sum(abs(cad)) FILTER (NOT moved AND booked_by IS NOT NULL), 0) AS txn_twice, coalesce(sum(abs(cad)) FILTER (booked_by IS NOT NULL), 0) AS booked FROM bk),
m4 AS (SELECT sum(amount) AS opex FROM xx),
m5 AS (SELECT sum(total_cost) AS payroll_cost, sum(overtime) AS overtime, sum(regular_pay) AS regular_pay FROM pp),
m6 AS (SELECT count(DISTINCT employee_id) AS n_staff_all FROM (SELECT employee_id FROM employees UNION ALL SELECT employee_id FROM pp)),
m7 AS (SELECT count(DISTINCT employee_id) FILTER (status <> 'quitté') AS n_staff, avg(total_employer_cost) AS mean_employer_cost, sum(total_employer_cost) AS employer_total, avg(seniority_years) AS seniority,
  count(*) FILTER (contains(lower(department), 'vente')) AS n_sales_staff, avg(CAST(contains(lower(union_status), 'syndiqué') AS INT)) AS union_share FROM employees),
m8 AS (SELECT sum(cash_in - cash_out) AS net_flow, date_diff('day', min(date), max(date)) + 1 AS cash_days, any_value(opening_cash) + sum(cash_in - cash_out) AS closing_cash FROM (SELECT * FROM cashflow{until('date')}), balances),
m9 AS (SELECT sum(spend) AS spend, sum(revenue) AS campaign_revenue, sum(clicks) AS clicks, sum(impressions) AS impressions, sum(new_customers) AS new_customers FROM campaign_days{inside('date')}),
m10 AS (SELECT count(*) FILTER (status = 'actif') AS n_active, count(*) FILTER (status IN ('perdu', 'inactif')) AS n_lost, count(*) AS n_customers, sum(loyalty_points) AS points, sum(credit_limit) AS credit_limit FROM customers),
m11 AS (SELECT avg(sign({words(POSITIVE)} - ({words(NEGATIVE)}))) AS sentiment FROM remarks),
ii AS (SELECT * FROM inventory{until('date')}),
per AS (SELECT arg_max(inventory_value, date) AS last, arg_min(inventory_value, date) AS first FROM ii GROUP BY product_id, warehouse_id),
m12 AS (SELECT sum(last) AS stock_value, sum((first + last) / 2) AS stock_average FROM per),
m13 AS (SELECT avg(CAST(closing_stock < 10 AS INT)) AS critical_share FROM ii),
m14 AS (SELECT avg(esg_score) AS esg, avg(CAST(province = 'Québec' AS INT)) AS local_share FROM suppliers),
m15 AS (SELECT sum(net_book_value) AS net_book_value, sum(accumulated_depreciation) AS accumulated, sum(initial_cost) AS initial_cost, sum(net_book_value * CASE WHEN dpa_rate > 1 THEN dpa_rate / 100 ELSE dpa_rate END) AS dpa FROM assets),
m16 AS (SELECT receivable, payable FROM balances),
s1 AS (SELECT sum(subtotal) FILTER ({cut(4, 'date')}) AS order_revenue4, sum(cost) FILTER ({cut(4, 'date')}) AS cogs4, sum(subtotal) FILTER ({cut(3, 'date')}) AS order_revenue3 FROM o WHERE NOT out),
s2 AS (SELECT sum(cad) FILTER (type = 'income' AND {cut(4, 'date')}) AS income4, sum(cad) FILTER (type = 'income' AND {cut(3, 'date')}) AS income3, sum(abs(cad)) FILTER (type = 'expense' AND {cut(4, 'date')}) AS txn_expense4 FROM t WHERE moved),
s3 AS (SELECT coalesce(sum(abs(cad)) FILTER (moved AND booked_by IS NULL AND {cut(4, 'date')}), 0) AS txn_open4, coalesce(sum(abs(cad)) FILTER (NOT moved AND booked_by IS NOT NULL AND {cut(4, 'date')}), 0) AS txn_twice4, coalesce(sum(abs(cad)) FILTER (booked_by IS NOT NULL AND {cut(4, 'date')}), 0) AS booked4 FROM bk),
s4 AS (SELECT sum(amount) FILTER ({cut(4, 'date')}) AS opex4 FROM xx),
s5 AS (SELECT sum(total_cost) FILTER ({cut(4, 'period')}) AS payroll4, sum(total_cost) FILTER ({cut(3, 'period')}) AS payroll3 FROM pp),
s6 AS (SELECT coalesce(date_diff('month', min(date), max(date)) + 1, 12) AS months4 FROM sold WHERE {cut(4, 'date')}),
k00 AS (SELECT * FROM m1, m1a, {', '.join(f'm{i}' for i in range(2, 17))}, {', '.join(f's{i}' for i in range(1, 7))}),
k0 AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in _SHARED.items())} FROM k00)"""
    last = "k0"
    every = ordered()
    for i, k in enumerate(every, 1):
        replace = "REPLACE" if k.id in ("order_revenue", "gross_sales") else None
        body += f",\nk{i} AS (SELECT * {f'REPLACE (CAST({k.expr} AS DOUBLE) AS {k.id})' if replace else f', CAST({k.expr} AS DOUBLE) AS {k.id}'} FROM {last})"
        last = f"k{i}"
    by = {k.id: k for k in KPIS}

    def partial(k: Kpi) -> str:
        rests_on = [by[w] for w in dict.fromkeys(_names(k.expr)) if w in by and w != k.id and w not in ("order_revenue", "gross_sales")]
        return " OR ".join(["left_out"] * k.partial + [f"{p} IS NULL" for p in k.parts] + [f"({partial(w)})" for w in rests_on] or ["false"])

    if traced:
        cells = " UNION ALL ".join(f"SELECT '{t}' AS kpi, '{by[t].expr}' AS formula, {i} AS position, '{n}' AS step, '{src}' AS source, round(CAST({n} AS DOUBLE), 4) AS value FROM {last}" for t in TRACED for i, (n, src) in enumerate([*steps(by[t]), (t, "result")], 1))
        return with_entities(body + f"\nSELECT * FROM ({cells})")
    rows = " UNION ALL ".join(f"SELECT '{k.id}' AS kpi, '{k.unit}' AS unit, {k.id} AS v, {partial(k)} AS partial FROM {last}" for k in KPIS)
    return with_entities(body + f"\nSELECT kpi, unit, round(v, 4) AS value, CASE WHEN v IS NULL THEN 'NOT_MEASURED' WHEN isnan(v) OR isinf(v) THEN 'INVALID' WHEN partial THEN 'UNKNOWN' WHEN v = 0 THEN 'VALID_ZERO' ELSE 'VALID' END AS status FROM ({rows})")


QUERIES = {"a_kpi_catalogue": all_kpis, "a_kpi_period": a_kpi_period, "q_metric_trace": q_metric_trace, "a_kpi_common_period": a_kpi_common_period, "j_booked_elsewhere": j_booked_elsewhere}
ORACLE_SQL = {"a_kpi_catalogue": _all_sql(), "a_kpi_period": _all_sql("2000-01-01", "2000-12-31"), "q_metric_trace": _all_sql(traced=True), "a_kpi_common_period": with_entities(_COMMON_SQL), "j_booked_elsewhere": with_entities(f"WITH {_booked_sql('ledger_transactions', 'ledger_expenses', 'payroll').strip()} SELECT transaction_id, date, amount, booked_by FROM bk WHERE booked_by IS NOT NULL")}
