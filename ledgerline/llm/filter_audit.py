"""Audit of how corpus filters interact, by a subset-zeta transform of mask counts.

A row's failures are one bit a filter, all found in one pass over the texts. Counts by part and mask are all that the
rest needs: the subset-zeta transform (one addition a bit over an array of 2^k counts) turns them into the survivors
of every subset of the filters, since what survives a subset has a mask within its complement. Every figure about any
order of the filters is then a difference between neighbouring subsets: what a step removes, how many good or toxic
documents go with it, what was gone before, and each filter's share summed over all orders.

Filters on the text alone are columns. "Repeats an earlier row's text" needs the table: rows of equal texts share every
other bit, so they are counted by (digest, part, labels) before they meet, and only these few counts of a text learn
its smallest id. A hot text, part or label costs one row a task in every shuffle.

Defined results: a null text is empty, a null part the empty string. A row without an id repeats nothing and is no
earlier row. Of rows with one id and equal texts none is the smaller. A document with several label rows has a label
if one of them has it; without an id or a label row it has none. Extra columns are ignored, whatever their names. An
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of, written

#: The filter that compares a text with those of the rest of the table; the others are columns over the text.
REPEATED = "E"


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, "[ \\t-\\r]+"), lambda w: w != "")


def quality_filters(text: Column, words: Column) -> dict[str, Column]:
    """Letter -> whether a text fails: short, repetitive, shouting, with signs of markup."""
    n = F.size(words)
    return {
        "A": n < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * n,
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 10 * F.char_length(text),
        "D": text.rlike("[#$%&*|]"),
    }


#: (text, its words) -> letter -> whether the filter of that letter fails the text.
Filters = Callable[[Column, Column], dict[str, Column]]


def failure_masks(docs: DataFrame, labels: DataFrame, filters: Filters = quality_filters, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", good_col: str = "quality", toxic_col: str = "toxic") -> DataFrame:
    """part, mask, n, good, toxic: how many rows of each part fail exactly the filters of the mask.

    Bit i stands for the i-th filter, the highest one for REPEATED.
    """
    texts = docs.select(docs[id_col].alias("id"), F.coalesce(docs[part_col].cast("string"), F.lit("")).alias("part"), text_of(docs, text_col).alias("text"))
    texts = texts.withColumn("words", words_of(F.col("text")))
    filters = filters(F.col("text"), F.col("words"))
    own = sum((F.when(failed, 1 << i).otherwise(0) for i, failed in enumerate(filters.values())), F.lit(0))
    # a small row a document, written once: what follows reads it twice
    rows = written(texts.select("id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), own.cast("int").alias("own")), "audit-facts")
    flag = lambda c: F.max(F.coalesce(labels[c] == 1, F.lit(False)))
    marked = labels.filter(labels[id_col].isNotNull()).groupBy(labels[id_col].alias("id")).agg(flag(good_col).alias("good"), flag(toxic_col).alias("toxic"))
    # rows without an id find no label, and need no shuffle to learn it
    named = rows.filter("id IS NOT NULL").join(marked, "id", "left").select("id", "part", "digest", "own", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    nameless = rows.filter("id IS NULL").select("id", "part", "digest", "own", F.lit(False).alias("good"), F.lit(False).alias("toxic"))
    kind = ["digest", "own", "part", "good", "toxic"]
    by_id = named.groupBy("id", *kind).agg(F.count(F.lit(1)).alias("n"))
    by_id = by_id.unionByName(nameless.groupBy("id", *kind).agg(F.count(F.lit(1)).alias("n")))
    same = by_id.groupBy(*kind).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("nameless"), F.min("id").alias("first"), F.min_by("n", "id").alias("at_first"))
    least = same.groupBy("digest").agg(F.min("first").alias("least"))
    same = same.join(least, "digest")
    once = F.col("nameless") + F.when(F.col("first") == F.col("least"), F.col("at_first")).otherwise(0)
    counted = same.groupBy("part", "own", "good", "toxic").agg(F.sum(once).alias("once"), F.sum(F.col("n") - once).alias("again"))
    both = F.array(F.struct(F.col("own").alias("mask"), F.col("once").alias("n")), F.struct((F.col("own") + (1 << len(filters))).alias("mask"), F.col("again").alias("n")))
    cells = counted.select("part", "good", "toxic", F.explode(both).alias("c")).filter("c.n > 0")
    of = lambda flag: F.sum(F.when(F.col(flag), F.col("c.n")).otherwise(0))
    return cells.groupBy("part", F.col("c.mask").alias("mask")).agg(F.sum("c.n").alias("n"), of("good").alias("good"), of("toxic").alias("toxic"))


def _dense(by_mask: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda m: F.coalesce(F.try_element_at(by_mask, m), F.lit(0).cast("long")))


def _add_bit(counts: Column, bit: int) -> Column:
    return F.transform(counts, lambda x, i: x + F.when(i.bitwiseAND(F.lit(bit)) != 0, F.get(counts, i - bit)).otherwise(0))


def survivors(masks: DataFrame, bits: int) -> DataFrame:
    """part, and for each count an array: at S, how many rows pass every filter of the subset S.

    The transform adds, bit by bit, to the count at each mask with the bit the count at the mask without it; then the
    array holds at T the sum over all masks within T, and read from its end it is ordered by T's complement.
    """
    counts = ("n", "good", "toxic")
    out = masks.groupBy("part").agg(*(F.map_from_entries(F.collect_list(F.struct("mask", c))).alias(c) for c in counts))  # at most 2^bits masks a part
    for c in counts:
        out = out.withColumn(c, _dense(F.col(c), 1 << bits))
        for b in range(bits):
            out = out.withColumn(c, _add_bit(F.col(c), 1 << b))
        out = out.withColumn(c, F.reverse(c))
    return out


def interaction_report(docs: DataFrame, labels: DataFrame, filters: Filters = quality_filters, **columns: str) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    letters = "".join([*filters(F.lit(""), words_of(F.lit(""))), REPEATED])
    k = len(letters)
    every = (1 << k) - 1
    by_part = survivors(failure_masks(docs, labels, filters, **columns), k)
    for i in range(k):
        bit = 1 << i
        gain = lambda s, bit=bit: F.get("n", F.lit(s)) - F.get("n", F.lit(s | bit))
        # a subset comes before the filter, and the rest after it, in |S|! (k - 1 - |S|)! of the orders
        weighted = [gain(s) * (factorial(s.bit_count()) * factorial(k - 1 - s.bit_count())) for s in range(1 << k) if not s & bit]
        by_part = by_part.withColumn(f"share{i}", sum(weighted[1:], weighted[0]))
    by_part = by_part.withColumn("share", F.array(*(f"share{i}" for i in range(k))))
    orders = by_part.withColumn("filter_order", F.explode(F.lit(["".join(p) for p in permutations(letters)]))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(k))))
    bit_of = lambda j: f"CAST(pow(2, instr('{letters}', substr(filter_order, {j}, 1)) - 1) AS INT)"
    before = F.expr(f"aggregate(sequence(1, {k}), 0, (s, j) -> s + IF(j < step, {bit_of('j')}, 0))")
    rows = orders.withColumn("at", F.expr(f"instr('{letters}', substr(filter_order, step, 1)) - 1")).withColumn("bit", F.expr(bit_of("step"))).withColumn("before", before).withColumn("after", F.col("before") + F.col("bit"))
    had = lambda c, s: F.get(F.col(c), s)
    lost = lambda c: had(c, F.col("before")) - had(c, F.col("after"))
    failing = had("n", F.lit(0)) - had("n", F.col("bit"))
    return rows.select(
        "part", "filter_order", F.col("step").cast("int").alias("step"), had("n", F.col("after")).alias("kept"), lost("n").alias("removed"), (failing - lost("n")).alias("redundant"),
        (had("n", F.lit(every) - F.col("bit")) - had("n", F.lit(every))).alias("unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), F.get("share", F.col("at")).alias("shapley"),
    )
