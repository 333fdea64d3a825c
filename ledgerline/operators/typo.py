"""Misspelled values matched with known ones: edit distance with transpositions, candidates by deletions.

Two texts within k edits (insertions, deletions, substitutions, swaps of neighbours) become equal when up to k letters
of each are deleted. So every distinct value is joined with the known ones on the hashes of its deletions, never all
with all, and only what meets is compared, by a fold over the rows of the distance table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.parsing import strip_accents

# Edits allowed by the length of the known value, the least similarity, and the least letters of a value.
SHORT, SHORT_EDITS, LONG_EDITS, LEAST_SIMILARITY, LEAST_LETTERS = 5, 1, 2, 0.65, 3


def plain(x: Column) -> Column:
    """Letters, digits and blanks, lower-case, without accents."""
    return F.regexp_replace(strip_accents(F.lower(F.trim(x))), r"[^a-z0-9\s]", "")


def edits(a: str, b: str) -> Column:
    """Distance of two columns in which neighbours that are swapped are one edit, and no letter is edited twice."""
    cell = f"""least(s.p1[j] + 1, element_at(r, -1) + 1, s.p1[j - 1] + if(substr({a}, i, 1) = substr({b}, j, 1), 0, 1),
      if(i > 1 AND j > 1 AND substr({a}, i, 1) = substr({b}, j - 1, 1) AND substr({a}, i - 1, 1) = substr({b}, j, 1), s.p2[j - 2] + 1, 2147483647))"""
    fold = f"""aggregate(sequence(1, length({a})), named_struct('p2', array(0), 'p1', sequence(0, length({b}))),
      (s, i) -> named_struct('p2', s.p1, 'p1', aggregate(sequence(1, length({b})), array(i), (r, j) -> concat(r, array({cell})))), s -> element_at(s.p1, -1))"""
    return F.expr(f"CASE WHEN {a} = '' THEN length({b}) WHEN {b} = '' THEN length({a}) ELSE {fold} END")


def deletions(x: Column, most: int) -> Column:
    """The text and all it becomes when up to `most` of its letters are deleted."""
    out = level = F.array(x)
    for _ in range(most):
        level = F.array_distinct(F.flatten(F.transform(level, _one_less)))
        out = F.concat(out, level)
    return F.array_distinct(out)


def _one_less(t: Column) -> Column:
    each = F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t))))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(each)


def allowed(known: Column) -> Column:
    return F.when(F.length(known) <= SHORT, SHORT_EDITS).otherwise(LONG_EDITS)


def best_matches(values: DataFrame, value: str, known: DataFrame, name: str) -> DataFrame:
    """value, match, distance, similarity: each distinct value with the most similar known one, the first in order at a tie.

    Values of fewer than three letters, and those that no known one is near enough to, have no row.
    """
    v = values.select(F.col(value).alias("value")).distinct().withColumn("a", plain(F.col("value"))).filter(F.length("a") >= LEAST_LETTERS)
    k = known.select(F.col(name).alias("match")).distinct().withColumn("b", plain(F.col("match"))).filter("b IS NOT NULL")
    # a known value is short or long: so many of its letters are deleted, and as many of a value that it may be
    hashed = lambda df, text, most: df.withColumn("key", F.explode(F.transform(deletions(F.col(text), most), lambda t: F.xxhash64(t))))
    keys = hashed(k.filter(F.length("b") <= SHORT), "b", SHORT_EDITS).unionByName(hashed(k.filter(F.length("b") > SHORT), "b", LONG_EDITS))
    met = hashed(v, "a", LONG_EDITS).join(keys, "key").select("value", "a", "match", "b").distinct()
    near = met.withColumn("distance", edits("a", "b")).filter(F.col("distance") <= allowed(F.col("b")))
    near = near.withColumn("similarity", 1 - F.col("distance") / F.greatest(F.length("a"), F.length("b"))).filter(F.col("similarity") >= LEAST_SIMILARITY)
    best = near.groupBy("value").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "match", "distance")).alias("x"))
    return best.select("value", "x.match", "x.distance", F.round(-F.col("x.s"), 3).alias("similarity"))
