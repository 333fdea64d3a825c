"""Values of an unlikely sign or size, of many fields of many frames in two passes over each frame.

The first pass counts the positive values of each field in cells of equal ratio (CELLS an e-fold, at most 6 million of a
field, however many rows there are); the median's cell follows from these counts, and so does how many values are
certainly over the limit. The second pass counts the values of the cells that leave a doubt: the median's own, and those
about twenty times it. Only counts are shuffled, and no cell is told by an estimate.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

c = F.col

#: Cells that the values between v and e * v are counted in.
CELLS = 4096
#: The cell of what has no logarithm that is a number: infinity, and what is no number, which sorts after it.
TOP = 4_000_000
#: Parts of the median's cell, so that the values of one part alone are ranked.
PARTS = 2**16
#: A value is too large over so many times the median of at least so many positive values.
TIMES, LEAST = 20, 10


def cell(v: Column) -> Column:
    """The cell of a positive value; never smaller for a larger value."""
    return F.when(v < float("inf"), F.floor(F.ln(v) * CELLS)).otherwise(F.lit(TOP).cast("long"))


def _first_over(counts: DataFrame, by: str, rank: Column, before: Column, *more: str) -> DataFrame:
    """A row of each field (i): the first `by` up to which more than `rank` values lie, as x, with how many come before it."""
    upto = before + F.sum("k").over(Window.partitionBy("i").orderBy(by))
    over = counts.withColumn("__upto", upto).filter(c("__upto") > rank)
    return over.groupBy("i").agg(F.min(F.struct(c(by).alias("x"), (c("__upto") - c("k")).alias("before"), *more)).alias("m")).select("i", "m.*")


def anomalous(spark: SparkSession, frames: dict[str, DataFrame], fields: dict[str, list[tuple[str, str]]]) -> DataFrame:
    """entity, field, negative, outliers (over TIMES the upper median, the element at floor(n / 2) of the n positive values; 0
    where they are fewer than LEAST). fields: of each frame, the columns to judge and the entity that each is told of."""
    names = [pair for e in frames for pair in fields[e]]
    at = {}
    for e in frames:  # a column that is told of two entities is counted once
        for pair in fields[e]:
            at[pair] = at.get(next((p for p in fields[e] if p[1] == pair[1] and p in at), None), len(at))
    values = lambda e: F.array(*(F.struct(F.lit(i).alias("i"), c(f).cast("double").alias("v")) for i, f in sorted({(at[p], p[1]) for p in fields[e]})))
    cells = reduce(DataFrame.unionAll, (df.select(F.explode(values(e)).alias("x")).select("x.i", "x.v") for e, df in frames.items()))

    counts = cells.groupBy("i", F.when(c("v") > 0, cell(c("v"))).alias("cell")).agg(F.count(F.lit(1)).alias("k"), F.count_if(c("v") < 0).alias("neg"), F.min("v").alias("a"), F.max("v").alias("b"))
    counts = counts.persist()  # cells, not rows; read several times
    totals = counts.groupBy("i").agg(F.sum("neg").alias("negative"), F.coalesce(F.sum(F.when(c("cell").isNotNull(), c("k"))), F.lit(0)).alias("n"))
    ranked = counts.filter("cell IS NOT NULL").join(F.broadcast(totals.select("i", F.floor(c("n") / 2).alias("rank"))), "i")
    held = _first_over(ranked, "cell", c("rank"), F.lit(0), "rank", "a", "b").withColumnRenamed("x", "mid")
    # where 20 times a value of the median's cell may lie, with a cell on either side for what logarithms round
    held = held.withColumn("near", F.floor(c("mid") + math.log(TIMES) * CELLS) - 1)
    doubtful = (c("cell") == c("mid")) | c("cell").between(c("near"), c("near") + 3) | (c("cell") == TOP)
    sure = counts.join(F.broadcast(held.select("i", "near")), "i").filter((c("cell") > c("near") + 3) & (c("cell") < TOP)).groupBy("i").agg(F.sum("k").alias("sure"))

    met = cells.filter("v > 0").join(F.broadcast(held.select("i", "mid", "near")), "i").withColumn("cell", cell(c("v"))).filter(doubtful)
    met = met.groupBy("i", "v", (c("cell") == c("mid")).alias("inside")).agg(F.count(F.lit(1)).alias("k")).persist()  # the values of a few cells
    place = F.when(c("b") > c("a"), F.least(F.floor((c("v") - c("a")) / (c("b") - c("a")) * PARTS), F.lit(PARTS - 1))).otherwise(F.lit(0))
    inside = met.filter("inside").join(F.broadcast(held), "i").withColumn("place", F.when(c("mid") == TOP, 0).otherwise(place))
    parts = inside.groupBy("i", "place", "rank", "before").agg(F.sum("k").alias("k"))
    part = _first_over(parts, "place", c("rank"), c("before"), "rank").withColumnRenamed("before", "upto")
    own = inside.drop("rank", "before").join(F.broadcast(part), (inside["i"] == part["i"]) & (c("place") == c("x"))).drop(part["i"])
    median = _first_over(own.drop("x"), "v", c("rank"), c("upto")).select("i", c("x").alias("median"))
    many = met.join(F.broadcast(median), "i").groupBy("i").agg(F.sum(F.when(c("v") > TIMES * c("median"), c("k")).otherwise(0)).alias("many"))

    all_of = F.array(*(F.struct(F.lit(at[(e, f)]).alias("i"), F.lit(e).alias("entity"), F.lit(f).alias("field")) for e, f in names))
    told = spark.range(1).select(F.explode(all_of).alias("x")).select("x.*")
    for one in (totals, sure, many):
        told = told.join(F.broadcast(one), "i", "left")
    zero = lambda n: F.coalesce(c(n), F.lit(0))
    return told.select("entity", "field", zero("negative").alias("negative"), F.when(c("n") >= LEAST, zero("sure") + zero("many")).otherwise(0).alias("outliers"))
