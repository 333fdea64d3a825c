"""The quality of fields, datasets and sources: one aggregate a table, all fields as rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.parsing import upper_median
from ..functions.periods import month

c = F.col

#: Weights of a field's quality: completeness, validity, consistency, uniqueness, freshness.
WEIGHTS = (0.30, 0.25, 0.20, 0.10, 0.15)
DIMENSIONS = ("completeness", "validity", "consistency", "uniqueness", "freshness")


@dataclass(frozen=True)
class FieldRule:
    """amount: a number that should be positive and not over twenty times the upper median. identifier: should be unique."""

    name: str
    amount: bool = False
    identifier: bool = False


def freshness(days: Column) -> Column:
    """100 to 10 points by the age of the last row; unknown is 75."""
    return F.when(days.isNull(), 75).when(days <= 7, 100).when(days <= 30, 90).when(days <= 90, 75).when(days <= 180, 50).when(days <= 365, 30).otherwise(10)


def grade(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 75, "B").when(score >= 60, "C").otherwise("D")


def field_quality(df: DataFrame, rules: list[FieldRule], as_of: str, date: str | None = None, beside: dict[str, Column] | None = None) -> DataFrame:
    """Q1, Q3, Q4: field, the five dimensions (0 to 100), score, grade, sufficient, weakest dimension, and what of the whole
    frame is asked for `beside` (aggregates by name), the same in every row.

    What a field cannot be judged by counts as 100. Three passes at most: the medians' two, and one for all the rest.
    """
    one = None
    for r in rules:
        if r.amount:
            m = upper_median(df.filter(c(r.name) > 0).select(c(r.name).cast("double").alias(r.name)), r.name).withColumnRenamed("median", f"__m_{r.name}")
            one = m if one is None else one.crossJoin(m)
    x = df if one is None else df.crossJoin(F.broadcast(one))  # one row of medians
    n = F.nullif(F.count(F.lit(1)), F.lit(0))
    age = F.datediff(F.lit(as_of).cast("date"), F.max(c(date).cast("date"))) if date else F.lit(None).cast("int")
    cells = []
    for r in rules:
        v = c(r.name)
        full = F.nullif(F.count(v), F.lit(0))
        validity = F.count_if(v >= 0) * 100.0 / full if r.amount else F.lit(100.0)
        consistency = 100 - F.count_if((v < 0) | (v > 20 * c(f"__m_{r.name}"))) * 100.0 / n if r.amount else F.lit(100.0)
        uniqueness = F.countDistinct(v) * 100.0 / full if r.identifier else F.lit(100.0)
        cells.append(F.struct(F.lit(r.name).alias("field"), (F.count(v) * 100.0 / n).alias("completeness"), F.coalesce(validity, F.lit(0.0)).alias("validity"), F.coalesce(consistency, F.lit(0.0)).alias("consistency"), F.coalesce(uniqueness, F.lit(0.0)).alias("uniqueness"), freshness(age).cast("double").alias("freshness")))
    more = beside or {}
    g = x.agg(F.array(*cells).alias("x"), *(v.alias(k) for k, v in more.items())).select(F.explode("x").alias("x"), *more).select("x.*", *more)
    score = sum((c(d) * w for d, w in zip(DIMENSIONS, WEIGHTS, strict=True)), F.lit(0.0))
    weakest = F.array_min(F.array(*(F.struct(c(d).alias("v"), F.lit(i).alias("i"), F.lit(d).alias("d")) for i, d in enumerate(DIMENSIONS))))["d"]
    return g.select("field", *(F.round(d, 4).alias(d) for d in DIMENSIONS), F.round(score, 4).alias("score"), grade(score).alias("grade"), (score >= 60).alias("sufficient"), weakest.alias("weakest"), *more)


def dataset_quality(fields: DataFrame, n_columns: int) -> DataFrame:
    """Q2: the mean of the fields, how much of the table is mapped to fields, and whether it is ready (both over 60)."""
    one = fields.agg(F.avg("score").alias("score"), F.count(F.lit(1)).alias("n"), F.count_if("sufficient").alias("ok"))
    coverage = c("n") * 100.0 / n_columns
    return one.select(F.round("score", 4).alias("score"), grade(c("score")).alias("grade"), F.round(coverage, 4).alias("mapping_coverage"), c("ok").alias("n_sufficient"), ((c("score") >= 60) & (coverage >= 60)).alias("ready"))


def source_quality(df: DataFrame, name: str, as_of: str, date: str, amount: str | None = None, key: str | None = None) -> DataFrame:
    """Q9, one row: rows, undated, future, zero (or no) amounts, outliers over twenty times the mean, repeated keys, months
    covered, months missing between them, verdict."""
    v = F.abs(c(amount).cast("double")) if amount else F.lit(None).cast("double")
    x = df.select(c(date).cast("date").alias("d"), v.alias("v"), (c(key).cast("string") if key else F.lit(None).cast("string")).alias("k"))
    mean = x.agg(F.avg(F.when(c("v") > 0, c("v"))).alias("mean"))
    one = x.crossJoin(F.broadcast(mean)).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(c("d").isNull()).alias("undated"), F.count_if(c("d") > F.lit(as_of).cast("date")).alias("future"), (F.count_if(c("v").isNull() | (c("v") == 0)) if amount else F.lit(0).cast("long")).alias("zero"),
        F.count_if(c("v") > 20 * c("mean")).alias("outliers"), (F.count("k") - F.countDistinct("k")).alias("duplicates"),
    )
    months = x.filter("d IS NOT NULL").select(month("d").alias("m")).distinct()
    running = F.trunc(F.lit(as_of).cast("date"), "month")
    gap = F.months_between("m", F.lag("m").over(Window.orderBy("m"))) - 1  # one row a month
    cover = months.agg(F.count(F.lit(1)).alias("months")).crossJoin(months.filter(c("m") != running).select(gap.alias("g")).agg(F.coalesce(F.sum("g"), F.lit(0.0)).cast("long").alias("month_gaps")))
    bad, odd = (c("duplicates") > 0) | (c("undated") > 0), (c("future") > 0) | (c("zero") > 0) | (c("outliers") > 0) | (c("month_gaps") > 0)
    verdict = F.when(c("n") == 0, "skip").when(bad, "error").when(odd, "warn").otherwise("ok")
    return one.crossJoin(cover).select(F.lit(name).alias("source"), "n", "undated", "future", "zero", "outliers", "duplicates", "months", "month_gaps", verdict.alias("verdict"))
