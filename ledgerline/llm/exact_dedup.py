"""Exact deduplication by a tree merge of sorted digest runs, with DataFrame functions only.

Every input partition is one run: its rows reduced to (digest, length, id) and sorted by digest.
In round r, the runs whose numbers agree but for their lowest FAN_BITS * r bits exchange what
they hold and are merged into one run that keeps, for each digest, the smallest row by the order
"most code points in the original text, then smallest id" and the number of rows merged. After
ceil(log_fan(runs)) rounds one run is left, dealt over the cluster by digest.

A digest is the SHA-256 of the normalised text, verified at every level by that text's length and
an independent 64-bit hash: rows merge only when all three agree.

No round holds more than one row a digest and run, and the way back goes through the runs too
(final row -> run's row -> documents of that run), so no key meets more rows in one task than
there are runs, or rows in a partition, however many copies a text has.

Defined results: null text is empty; empty and white-space-only texts are equal to each other;
of rows that tie on length, a non-null id goes before null, then the smaller id; of fully equal
rows (same id and text) the first one read stays, so exactly one row a group is kept. An empty
table gives an empty result. Extra columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, text_of, written

#: 2**FAN_BITS runs are merged into one in each round.
FAN_BITS = 4

KEY = ["digest", "norm_chars", "check"]


def normalised(text: Column) -> Column:
    for c in WHITE:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def digest_columns(text: Column) -> list[Column]:
    norm = normalised(text)
    return [
        F.unhex(F.sha2(norm, 256)).alias("digest"),
        F.char_length(norm).cast("long").alias("norm_chars"),
        F.xxhash64(norm).alias("check"),
    ]


def digest_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One small row a document, sorted by digest within its run: id, run, row, n_points and the digest."""
    text = text_of(docs, text_col)
    rows = docs.select(
        docs[id_col].alias("id"),
        F.spark_partition_id().alias("run"),
        F.monotonically_increasing_id().alias("row"),
        F.char_length(text).cast("long").alias("n_points"),
        *digest_columns(text),
    )
    return rows.sortWithinPartitions("digest")


def _best() -> Column:
    return F.struct((-F.col("n_points")).alias("less"), F.col("id").isNull().alias("no_id"), "id", "row").alias("best")


def merge_runs(runs: DataFrame, n_runs: int) -> tuple[DataFrame, DataFrame]:
    """(each run's own rows, the rows of the one run left): run, KEY, best, n."""
    first = runs.groupBy("run", *KEY).agg(F.min(_best()).alias("best"), F.count(F.lit(1)).alias("n"))
    level = first
    while n_runs > 1:
        level = (
            level.withColumn("run", F.shiftright("run", FAN_BITS))
            .groupBy("run", *KEY)
            .agg(F.min("best").alias("best"), F.sum("n").alias("n"))
        )
        n_runs = (n_runs + (1 << FAN_BITS) - 1) >> FAN_BITS
    return first, level


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, row, keep_id, group_size, kept, digest."""
    runs = written(digest_runs(docs, id_col, text_col), "digest-runs")
    n_runs = (runs.agg(F.max("run")).first()[0] or 0) + 1
    first, last = merge_runs(runs, n_runs)
    groups = last.select(*KEY, F.col("best.id").alias("keep_id"), F.col("best.row").alias("keep_row"), F.col("n").alias("group_size"))
    by_run = first.select("run", *KEY).join(groups, KEY)
    return runs.join(by_run, ["run", *KEY]).select("id", "row", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "digest")


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of every group of equal texts, all columns as they were.

    The rows that stay are found by id, length and digest, in a join that shuffles the documents. Only where several
    rows with one id and equal texts match is one of them picked, the least by its text and then a hash of the whole
    row, by a partial aggregation over those groups alone.
    """
    runs = written(digest_runs(docs, id_col, text_col), "digest-runs")
    n_runs = (runs.agg(F.max("run")).first()[0] or 0) + 1
    _, last = merge_runs(runs, n_runs)
    stay = last.select(F.col("best.id").alias("__id"), (-F.col("best.less")).alias("__points"), F.col("digest").alias("__digest"))
    ties = runs.groupBy(F.col("id").alias("__id"), F.col("n_points").alias("__points"), F.col("digest").alias("__digest")).agg((F.count(F.lit(1)) > 1).alias("__tied"))
    same = lambda a, b: a["__id"].eqNullSafe(b["__id"]) & (a["__points"] == b["__points"]) & (a["__digest"] == b["__digest"])
    stay = stay.join(ties, same(stay, ties)).select(stay["__id"], stay["__points"], stay["__digest"], "__tied")
    text = text_of(docs, text_col)
    full = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("__doc"), docs[id_col].alias("__id"), F.char_length(text).cast("long").alias("__points"), digest_columns(text)[0].alias("__digest"))
    found = full.join(stay, same(full, stay)).select("__doc", full["__digest"].alias("__digest"), "__tied")
    one = found.filter(~F.col("__tied")).select("__doc")
    many = found.filter("__tied").groupBy("__digest").agg(F.min_by("__doc", F.struct(F.col(f"__doc.`{text_col}`"), F.xxhash64("__doc"))).alias("__doc")).select("__doc")
    return one.unionAll(many).select("__doc.*")


def exact_dedup_report(docs: DataFrame) -> DataFrame:
    """The contract's rows: doc_id, keep_id, group_size, kept, text_sha256."""
    return exact_groups(docs).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )
