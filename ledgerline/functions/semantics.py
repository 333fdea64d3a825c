"""What a measure is, and hence how it may be combined: roles, aggregations, and the generic aggregator."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLOW, STOCK, RATE, COUNT = "flow", "stock", "rate", "count"
ADDITIVE = {FLOW, COUNT}


@dataclass(frozen=True)
class Measure:
    """fields: candidates in order; the first that has any value in the data is read, for all rows alike."""

    key: str
    entity: str
    fields: tuple[str, ...]
    role: str
    how: str  # sum, avg, weighted_avg, last, min, max, count, count_distinct
    weight: str | None = None


MEASURES = {
    m.key: m
    for m in (
        Measure("revenue", "order_lines", ("subtotal", "total"), FLOW, "sum"),
        Measure("cogs", "order_lines", ("total_cost", "cost"), FLOW, "sum"),
        Measure("sales_quantity", "order_lines", ("quantity",), FLOW, "sum"),
        Measure("order_unit_price", "order_lines", ("unit_price",), RATE, "weighted_avg", "quantity"),
        Measure("order_discount", "order_lines", ("discount",), RATE, "avg"),
        Measure("order_ids", "order_lines", ("order_id",), COUNT, "count_distinct"),
        Measure("stock_closing", "inventory", ("closing_stock",), STOCK, "last"),
        Measure("inventory_value", "inventory", ("inventory_value",), STOCK, "last"),
        Measure("operating_expense", "expenses", ("amount",), FLOW, "sum"),
        Measure("payroll_total_cost", "payroll", ("total_cost",), FLOW, "sum"),
        Measure("customer_credit_limit", "customers", ("credit_limit",), FLOW, "sum"),
        Measure("supplier_esg", "suppliers", ("esg_score",), RATE, "avg"),
    )
}

#: Stocks are last values per these keys before they are summed.
STOCK_KEYS = {"inventory": ("product_id", "warehouse_id")}


def check(m: Measure) -> None:
    """Raises for a combination that has no meaning."""
    if m.how == "sum" and m.role not in ADDITIVE:
        raise ValueError(f"{m.key}: a {m.role} is never summed")


def can_compare(a: Measure, b: Measure) -> bool:
    """Only measures of one role stand side by side on one axis."""
    return a.role == b.role


def can_add(a: Measure, b: Measure) -> bool:
    return a.role == b.role and a.role in ADDITIVE


def combine(m: Measure, field: str) -> Column:
    check(m)
    x = F.col(field)
    return {
        "sum": F.sum(x), "avg": F.avg(x), "min": F.min(x), "max": F.max(x), "count": F.count(x).cast("double"), "count_distinct": F.countDistinct(x).cast("double"), "last": F.max_by(x, "date") if m.how == "last" else F.lit(None),
        "weighted_avg": F.sum(x * F.col(m.weight)) / F.nullif(F.sum(F.when(x.isNotNull(), F.col(m.weight))), F.lit(0.0)) if m.weight else F.avg(x),
    }[m.how].cast("double")


def aggregate(df: DataFrame, *measures: Measure) -> DataFrame:
    """A row a measure of one entity: key, value, status. All measures but stocks are aggregated in one pass, and so are the
    stocks; of a measure's candidates the first with a value is taken."""
    for m in measures:
        check(m)
    fields = {m.key: [f for f in m.fields if f in df.columns] for m in measures}
    stock = lambda m: m.role == STOCK and m.entity in STOCK_KEYS
    out = None
    for own in ([m for m in measures if fields[m.key] and not stock(m)], [m for m in measures if fields[m.key] and stock(m)]):
        if not own:
            continue
        x = df
        if stock(own[0]):
            x = df.groupBy(*STOCK_KEYS[own[0].entity]).agg(*(F.max_by(f, "date").alias(f) for f in dict.fromkeys(f for m in own for f in fields[m.key])))
        value = lambda m, f: F.sum(f).cast("double") if stock(m) else combine(m, f)
        cells = [F.struct(F.lit(m.key).alias("key"), F.coalesce(*(F.when(F.count(f) > 0, value(m, f)) for f in fields[m.key])).alias("value")) for m in own]
        one = x.agg(F.array(*cells).alias("x")).select(F.explode("x").alias("x")).select("x.*")
        out = one if out is None else out.unionAll(one)
    for m in measures:
        if not fields[m.key]:
            none = df.sparkSession.range(1).select(F.lit(m.key).alias("key"), F.lit(None).cast("double").alias("value"))
            out = none if out is None else out.unionAll(none)
    v = F.col("value")
    return out.select("key", "value", F.when(v.isNull(), "NOT_MEASURED").when(v == 0, "VALID_ZERO").otherwise("VALID").alias("status"))
