"""Months, calendars and windows. Every function takes its dates; none reads the clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def month(date: str | Column) -> Column:
    return F.trunc(date, "month")


def complete_months(monthly: DataFrame, as_of: str, least: int = 3) -> DataFrame:
    """Without the running month of as_of; kept only where fewer than `least` months come before it."""
    running = month(F.to_date(F.lit(as_of)))
    earlier = monthly.filter(F.col("month") < running).agg(F.count(F.lit(1)).alias("__n"))
    return monthly.crossJoin(earlier).filter((F.col("month") < running) | ((F.col("__n") < least) & (F.col("month") == running))).drop("__n")


def densify(monthly: DataFrame, value: str, until: str | None = None) -> DataFrame:
    """A row for every month from the first one to the last one (or `until`), 0 where there was none."""
    last = F.to_date(F.lit(until)) if until else F.max("month")
    calendar = monthly.agg(F.min("month").alias("a"), last.alias("b") if until is None else F.first(last).alias("b")).filter("a IS NOT NULL")
    months = calendar.select(F.explode(F.expr("sequence(a, b, interval 1 month)")).alias("month"))
    return months.join(monthly, "month", "left").withColumn(value, F.coalesce(value, F.lit(0.0)))


def trend_pct(now: Column, before: Column) -> Column:
    """Change in percent of what was; null unless that was positive."""
    return F.when(before > 0, (now - before) * 100 / before)


def trend_direction(pct: Column, margin: float = 2.0) -> Column:
    return F.when(pct > margin, "up").when(pct < -margin, "down").when(pct.isNotNull(), "flat")


def latest_stock(inventory: DataFrame) -> DataFrame:
    """product_id, warehouse_id, date, stock, value: the last snapshot of each product in each warehouse."""
    return inventory.groupBy("product_id", "warehouse_id").agg(F.max("date").alias("date"), F.max_by("closing_stock", "date").alias("stock"), F.max_by("inventory_value", "date").alias("value"))


def row_month(*dates: Column) -> Column:
    """YYYY-MM of the first readable of several date or period texts."""
    return F.coalesce(*(F.when(d.rlike(r"^\d{4}-\d{2}"), F.substring(d, 1, 7)) for d in dates))


def row_date(*dates: Column) -> tuple[Column, Column]:
    """The first readable text as a date, and its grain: 'day', or 'month' for YYYY-MM (its first day)."""
    day = lambda d: d.rlike(r"^\d{4}-\d{2}-\d{2}")
    whole = lambda d: d.rlike(r"^\d{4}-\d{2}$")
    grain = F.coalesce(*(F.when(day(d), "day").when(whole(d), "month") for d in dates))
    value = F.coalesce(*(F.when(day(d), F.try_to_date(F.substring(d, 1, 10), "yyyy-MM-dd")).when(whole(d), F.try_to_date(F.concat(d, F.lit("-01")), "yyyy-MM-dd")) for d in dates))
    return value, grain


def in_days(date: Column, grain: Column, start: str, end: str) -> Column:
    """A day inside the window; a row of month grain only where the whole month is inside."""
    last = F.when(grain == "month", F.last_day(date)).otherwise(date)
    return (date >= F.lit(start).cast("date")) & (last <= F.lit(end).cast("date"))


#: Grains from fine to coarse.
GRAINS = ("day", "week", "month", "quarter", "year")


def can_aggregate(fine: str, coarse: str) -> bool:
    """Whether data of one grain can be summed up to another."""
    return fine == coarse or fine in GRAINS and coarse in GRAINS and GRAINS.index(fine) <= GRAINS.index(coarse)


def align(a: str, b: str) -> str | None:
    """The finest grain that both can be summed up to."""
    return b if can_aggregate(a, b) else a if can_aggregate(b, a) else None


def cash_per_month(statement: DataFrame, as_of: str) -> DataFrame:
    """Month, net_flow of the months before that of as_of: the net flow where the statement has one, else in less out,
    else, where there are balances alone, what the month's last balance changed from the month before that has one."""
    running = month(F.to_date(F.lit(as_of)))
    has = lambda n: n in statement.columns
    rows = statement.withColumn("month", month("date")).filter(F.col("month") < running)
    if has("net_cash_flow") or has("cash_in"):
        zero = lambda n: F.coalesce(F.col(n), F.lit(0.0)) if has(n) else F.lit(0.0)
        net = zero("cash_in") - zero("cash_out")
        return rows.groupBy("month").agg(F.sum(F.coalesce(F.col("net_cash_flow"), net) if has("net_cash_flow") else net).alias("net_flow"))
    last = rows.filter("closing_cash IS NOT NULL").groupBy("month").agg(F.max_by("closing_cash", "date").alias("v"))
    change = F.col("v") - F.lag("v").over(Window.orderBy("month"))  # one row a month
    return last.select("month", change.alias("net_flow")).filter("net_flow IS NOT NULL")


def balances_per_month(statement: DataFrame, opening: float, as_of: str) -> DataFrame:
    """Month, balance at its end: from the opening balance and the net flows, months without a row carried forward."""
    flow = densify(cash_per_month(statement, as_of), "net_flow")
    return flow.select("month", (F.lit(opening) + F.sum("net_flow").over(Window.orderBy("month"))).alias("balance"))
