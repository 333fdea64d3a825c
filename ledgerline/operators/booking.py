"""Money booked twice: expense transactions that repeat an expense, a pay slip or a month's payroll.

Every expense covers one transaction of its day and amount, every pay slip one of those that are left, and of what is
left then, a transaction whose label speaks of pay is covered by its month's payroll. Amounts are compared without
their sign, in cents. A transaction's turn is its place among those of its day and amount, counted over ranges, so
that a day on which one amount occurs very often is not numbered by one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dedup_engine import RANGE, occurrence

# What a label of pay holds.
PAY_WORDS = "paie|salaire|payroll|remunerat"
#: Ranges that ids which are no whole numbers are hashed into.
HASHED_RANGES = 4096


def cents(amount: Column) -> Column:
    return F.round(F.abs(F.coalesce(amount, F.lit(0.0))) * 100).cast("long")


def slip_cost(df: DataFrame) -> Column:
    """What a pay slip cost: the total, else the employer's part, else the regular pay."""
    return F.coalesce(*(F.col(c).cast("double") for c in ("total_cost", "employer_cost", "regular_pay") if c in df.columns), F.lit(0.0))


def _key(day: Column, amount: Column) -> Column:
    return F.concat_ws("|", F.coalesce(day.cast("date").cast("string"), F.lit("")), cents(amount).cast("string"))


def _optional(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in df.columns else F.lit("")


def already_booked(transactions: DataFrame, expenses: DataFrame, payroll: DataFrame, id_col: str = "transaction_id") -> DataFrame:
    """Expense transactions (date, amount, id, category and description where there are any), all columns as they were,
    and booked_by: expense, pay slip, month's payroll or null.

    Turns follow the id where it is a whole number; other ids, and none, come before, by a hash of the row.
    """
    room = (
        expenses.select(_key(F.col("date"), F.col("amount")).alias("__key"), F.lit(1).alias("e"), F.lit(0).alias("p"))
        .unionAll(payroll.select(_key(F.col("period"), slip_cost(payroll)), F.lit(0), F.lit(1)))
        .groupBy("__key").agg(F.sum("e").alias("__expenses"), F.sum("p").alias("__slips"))
    )
    paid = payroll.filter("period IS NOT NULL").select(F.trunc("period", "month").alias("__month")).distinct().withColumn("__paid", F.lit(True))
    hashed = -1 - F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in transactions.columns)), F.lit(HASHED_RANGES * RANGE))
    place = F.coalesce(F.expr(f"try_cast(`{id_col}` AS bigint)"), hashed)
    rows = transactions.withColumns({"__key": _key(F.col("date"), F.col("amount")), "__place": place})
    ranked = occurrence(rows.join(room, "__key", "left"), "__key", "__place", into="__k")
    by = F.when(F.col("__k") <= F.col("__expenses"), "expense").when(F.col("__k") <= F.col("__expenses") + F.col("__slips"), "pay slip")
    met = ranked.select(*(f"`{c}`" for c in transactions.columns), by.alias("booked_by"))
    label = F.lower(F.concat_ws(" ", _optional(transactions, "category"), _optional(transactions, "description")))
    out = met.withColumn("__month", F.trunc("date", "month")).join(paid, "__month", "left")
    return out.withColumn("booked_by", F.coalesce("booked_by", F.when(F.coalesce("__paid", F.lit(False)) & label.rlike(PAY_WORDS), "month's payroll"))).drop("__month", "__paid")
