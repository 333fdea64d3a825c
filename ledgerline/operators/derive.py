"""What a row lets one work out: the derived columns of each entity, as projections.

Every function takes typed rows and fills only what is missing; a column that the frame lacks counts as null. Amounts are
rounded to cents with halves up. No value is invented: without the inputs a derived column stays null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import currency_code, ex_tax
from ..functions.parsing import classify_transaction, period_month, strip_accents
from ..functions.rules import half_up

c = F.col


def opt(df: DataFrame, name: str, kind: str = "double") -> Column:
    return c(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def short_hash(df: DataFrame, columns: list[str]) -> Column:
    """Sixteen hex digits of a row's content."""
    return F.lower(F.hex(F.xxhash64(F.concat_ws("\u0001", *(F.coalesce(c(f"`{x}`").cast("string"), F.lit("\u0002")) for x in columns)))))


def fallback_id(parts: list[Column], length: int = 60) -> Column:
    """AUTO- and what names the row, where anything does."""
    label = F.concat_ws(" - ", *(F.nullif(F.trim(p.cast("string")), F.lit("")) for p in parts))
    return F.when(label != "", F.substring(F.concat(F.lit("AUTO-"), label), 1, length))


def _fill(df: DataFrame, **columns: Column) -> DataFrame:
    return df.withColumns({k: F.coalesce(opt(df, k, "string" if k.endswith("_id") else "double"), v) for k, v in columns.items()})


def order(df: DataFrame) -> DataFrame:
    """Currency code, AUTO- number, revenue ex tax, cost, profit, margin."""
    x = lambda n: opt(df, n)
    if "currency" in df.columns:
        df = df.withColumn("currency", currency_code(c("currency")))
    net = ex_tax(x("total_revenue"), x("subtotal"), x("total"), x("tax"), x("discount"), x("quantity"), x("unit_price"))
    lines = x("quantity") * x("unit_price")
    off = F.when(F.abs(x("discount")) < 1, lines * x("discount")).otherwise(F.coalesce(x("discount"), F.lit(0.0)))
    df = _fill(df, order_id=F.concat(F.lit("AUTO-"), short_hash(df, df.columns)), total_revenue=half_up(F.coalesce(net, lines - off)), total_cost=F.when(x("unit_cost") > 0, half_up(x("quantity") * x("unit_cost"))))
    df = _fill(df, gross_profit=half_up(c("total_revenue") - c("total_cost")))
    return _fill(df, gross_margin=F.when(c("total_revenue") != 0, half_up(c("gross_profit") * 100 / c("total_revenue"))))


def transaction(df: DataFrame) -> DataFrame:
    """Income or expense by type, category, sign or words; the amount without its sign; CAD where no currency is given."""
    label = F.concat_ws(" ", opt(df, "category", "string"), opt(df, "description", "string"))
    kind = F.coalesce(classify_transaction(opt(df, "type", "string"), F.lit(None).cast("double"), F.lit(None).cast("string")), classify_transaction(opt(df, "category", "string"), x_amount := opt(df, "amount"), label))
    return df.withColumns({"type": kind, "amount": F.abs(x_amount), "currency": F.coalesce(currency_code(opt(df, "currency", "string")), F.lit("CAD"))})


def cash_flow(df: DataFrame) -> DataFrame:
    """Net flow is in less out, where either is given."""
    a, b = opt(df, "cash_in"), opt(df, "cash_out")
    return _fill(df, net_cash_flow=F.when(a.isNotNull() | b.isNotNull(), F.coalesce(a, F.lit(0.0)) - F.coalesce(b, F.lit(0.0))))


def purchase(df: DataFrame) -> DataFrame:
    return _fill(df, total_cost=half_up(opt(df, "quantity") * opt(df, "unit_cost")))


def expense(df: DataFrame) -> DataFrame:
    return df.withColumn("amount", F.abs(opt(df, "amount")))


def payroll(df: DataFrame) -> DataFrame:
    """The period as a month, the cost as the sum of what is given."""
    parts = [opt(df, n) for n in ("regular_pay", "overtime", "bonus", "employer_cost")]
    total = sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0))
    df = df.withColumn("period", F.coalesce(period_month(opt(df, "period", "string")), opt(df, "period", "string")))
    return _fill(df, total_cost=F.when(F.coalesce(*parts).isNotNull(), half_up(total)))


def campaign(df: DataFrame) -> DataFrame:
    """Return on spend and acquisition cost."""
    spend = F.nullif(opt(df, "spend"), F.lit(0.0))
    return _fill(df, roas=half_up(opt(df, "revenue") / spend), cac=half_up(spend / F.nullif(opt(df, "conversions"), F.lit(0.0))))


def inventory(df: DataFrame, received: str) -> DataFrame:
    """A date of reference with what kind it is; stock from the level; value from stock and cost."""
    date = opt(df, "date", "date")
    df = df.withColumns({"import_date": F.lit(received).cast("date"), "reference_date": F.coalesce(date, F.lit(received).cast("date")), "reference_date_type": F.when(date.isNotNull(), "INVENTORY_DATE").otherwise("IMPORT_DATE")})
    df = _fill(df, closing_stock=opt(df, "inventory_level"))
    cost = F.coalesce(F.nullif(opt(df, "unit_cost"), F.lit(0.0)), opt(df, "purchase_cost"))
    return _fill(df, inventory_value=F.when((c("closing_stock") > 0) & (cost > 0), half_up(c("closing_stock") * cost)))


def employee(df: DataFrame, year: int) -> DataFrame:
    """Hourly rate from the salary, social charges from their rates, employer's cost, seniority."""
    salary = opt(df, "annual_salary")
    rates = sum((F.coalesce(opt(df, n), F.lit(0.0)) for n in ("cpp_employer", "qpip_employer", "cnesst", "fss_qc", "group_insurance", "rrsp_employer")), F.lit(0.0))
    df = _fill(df, hourly_rate=half_up(F.nullif(salary, F.lit(0.0)) / (52 * F.coalesce(F.nullif(opt(df, "weekly_hours"), F.lit(0.0)), F.lit(37.5)))), total_social_charges=F.when((salary > 0) & (rates > 0), half_up(salary * rates)))
    df = _fill(df, total_employer_cost=F.when(salary > 0, half_up(salary + F.coalesce(c("total_social_charges"), F.lit(0.0)))))
    return _fill(df, seniority_years=F.greatest(F.lit(0), F.lit(year) - F.year(opt(df, "hire_date", "date"))).cast("double"))


def product(df: DataFrame) -> DataFrame:
    """Id from the SKU, prices and levels from their other names, margin from price and cost."""
    df = _fill(df, product_id=opt(df, "sku", "string"), inventory_level=opt(df, "closing_stock"), selling_price=opt(df, "price"), purchase_cost=opt(df, "unit_cost"))
    return _fill(df, gross_margin=half_up((c("selling_price") - c("purchase_cost")) * 100 / F.nullif(c("selling_price"), F.lit(0.0))))


def asset(df: DataFrame) -> DataFrame:
    """Id from the description, book value from cost less depreciation, never below 0."""
    key = F.substring(F.regexp_replace(F.upper(strip_accents(opt(df, "description", "string"))), "[^A-Z0-9]", "_"), 1, 20)
    return _fill(df, asset_id=F.concat(F.lit("AST-"), F.nullif(key, F.lit(""))), net_book_value=F.greatest(F.lit(0.0), opt(df, "initial_cost") - opt(df, "accumulated_depreciation")))


def summary(df: DataFrame) -> DataFrame:
    """Id from the place; profit and margin from revenue and cost. Rows without any figure go."""
    figures = [n for n in ("total_revenue", "total_cost", "gross_profit", "total_orders") if n in df.columns]
    df = df.filter(F.coalesce(*(opt(df, n) for n in figures)).isNotNull()) if figures else df
    df = _fill(df, summary_id=F.concat(F.lit("SUM-"), F.regexp_replace(F.upper(strip_accents(opt(df, "location_id", "string"))), "[^A-Z0-9]", "_")), gross_profit=half_up(opt(df, "total_revenue") - opt(df, "total_cost")))
    return _fill(df, gross_margin=half_up(c("gross_profit") * 100 / F.nullif(opt(df, "total_revenue"), F.lit(0.0))))


DERIVE: dict[str, Callable[[DataFrame], DataFrame]] = {"Order": order, "Transaction": transaction, "Cashflow": cash_flow, "Purchase": purchase, "Expense": expense, "Payroll": payroll, "Campaign": campaign, "Product": product, "Asset": asset, "ExecutiveSummary": summary}
