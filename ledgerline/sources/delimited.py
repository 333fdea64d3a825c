"""Delimited text and workbooks to frames of text cells: separator, header row, unnamed columns, blank rows.

Only a bounded head of a file is looked at on the driver; the rows themselves are read and shaped by Spark.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEPARATORS = (",", ";", "\t", "|")
#: Lines looked at for the separator, and rows for the header.
HEAD_LINES, HEAD_ROWS = 20, 10
#: Lines of a file that its first HEAD_ROWS rows lie within.
HEAD_SPAN = 10_000


def count_outside_quotes(line: str, sep: str) -> int:
    n, inside = 0, False
    for ch in line:
        if ch == '"':
            inside = not inside
        elif ch == sep and not inside:
            n += 1
    return n


def detect_separator(lines: list[str]) -> str:
    """The separator that gives most columns most regularly over the first lines; a comma where none does."""
    lines = [x for x in lines if x.strip()][:HEAD_LINES]
    best, best_score = ",", (0.0, 0)
    for sep in SEPARATORS:
        counts = [count_outside_quotes(x, sep) for x in lines]
        if counts and max(counts):
            common = max(set(counts), key=lambda k: (counts.count(k), k))
            score = (counts.count(common) / len(counts) if common else 0.0, common)
            if score > best_score:
                best, best_score = sep, score
    return best


def header_row(rows: list[list[str | None]]) -> int:
    """The row among the first ten with the most labels: twice the cells with a letter, plus the filled ones. A row of one
    filled cell among several columns is a title."""

    def score(row: list[str | None]) -> int:
        filled = [x for x in row if x and x.strip()]
        if len(filled) < min(2, len(row)):
            return 0
        return 2 * sum(any(ch.isalpha() for ch in x) for x in filled) + len(filled)

    head = rows[:HEAD_ROWS]
    return max(range(len(head)), key=lambda i: (score(head[i]), -i)) if head else 0


def unique_names(cells: list[str | None]) -> list[str]:
    """Header cells as column names: blank ones are col_N, repeated ones (but for case) get a number."""
    out: list[str] = []
    for i, x in enumerate(cells, 1):
        name = (x or "").strip().replace("`", "'") or f"col_{i}"
        k, base = 2, name
        while name.lower() in {n.lower() for n in out}:
            name, k = f"{base}_{k}", k + 1
        out.append(name)
    return out


def shape(spark: SparkSession, path: str, sep: str) -> tuple[int, bool]:
    """Columns of the widest line, and whether quoted cells break lines: one pass over the text."""
    odd = (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2 == 1
    outside, broken = spark.read.text(path).agg(F.max(separators(F.col("value"), sep)), F.max(odd)).first()
    return (outside or 0) + 1, bool(broken)


def separators(record: Column, sep: str) -> Column:
    """How many separators stand outside quotes."""
    bare = F.regexp_replace(record, '"[^"]*"', "")
    return F.length(bare) - F.length(F.replace(bare, F.lit(sep), F.lit("")))


def _quoted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines with their place in their split, whether their own quotes are odd in number, and whether those before them are."""
    split, place, parity = None, 0, 0
    for b in batches:
        keys = list(zip(b["file"].to_pylist(), b["block"].to_pylist(), strict=True))
        odd = pc.bit_wise_and(pc.count_substring(pc.fill_null(b["value"], ""), '"'), 1).to_numpy(zero_copy_only=False)
        n, before = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int8)
        edges = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]] + [len(keys)]
        for lo, hi in zip(edges, edges[1:], strict=False):
            if keys[lo] != split:
                split, place, parity = keys[lo], 0, 0
            n[lo:hi] = np.arange(place, place + hi - lo)
            upto = (parity + np.cumsum(odd[lo:hi])) & 1
            before[lo:hi] = np.concatenate([[parity], upto[:-1]])
            place, parity = place + hi - lo, int(upto[-1])
        yield pa.RecordBatch.from_arrays([b["file"], b["block"], pa.array(n), b["value"], pa.array(odd == 1), pa.array(before == 1)], ["file", "block", "n", "value", "odd", "inside"])


def records(spark: SparkSession, path: str) -> DataFrame:
    """file, block, n, record: what stands between line ends outside quotes, of files of any size read in parallel.

    Whether a line begins within quotes follows from how many quotes stand before it: within its split a running sum, and
    over splits a prefix sum of one bit a split. So no file is read by one task, as a reader of whole files must. Lines
    of a record that breaks lines are put together by its first line's place; all other lines are not shuffled. Line
    ends within a record become \\n. A quote that is never closed makes one record of the rest of its file.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    lines = lines.mapInArrow(_quoted, "file string, block long, n long, value string, odd boolean, inside boolean")
    in_order = Window.partitionBy("file").orderBy("block")  # one row a split
    splits = lines.groupBy("file", "block").agg((F.count_if("odd") % 2).alias("odd"))
    entered = splits.select("file", "block", (F.coalesce(F.sum("odd").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) % 2 == 1).alias("entered"))
    lines = lines.join(entered, ["file", "block"]).withColumn("starts", F.col("entered") == F.col("inside"))
    whole = lines.filter("starts AND NOT odd").select("file", "block", "n", F.col("value").alias("record"))
    parts = lines.filter("NOT starts OR odd")
    parts = parts.withColumn("first", F.max(F.when(F.col("starts"), F.col("n"))).over(Window.partitionBy("file", "block").orderBy("n")))
    # lines before a split's first record belong to the last one that began in an earlier split
    begun = parts.groupBy("file", "block").agg(F.max("first").alias("last"))
    own = F.when(F.col("last").isNotNull(), F.struct("block", "last"))
    begun = begun.select("file", "block", F.last(own, ignorenulls=True).over(in_order.rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"))
    parts = parts.join(begun, ["file", "block"]).withColumn("of", F.when(F.col("first").isNotNull(), F.struct("block", F.col("first").alias("last"))).otherwise(F.col("earlier")))
    joined = parts.groupBy("file", "of").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "n", "value"))), lambda x: x["value"]), "\n").alias("record"))
    return whole.unionByName(joined.select("file", F.col("of.block").alias("block"), F.col("of.last").alias("n"), "record"))


def _cells(sep: str):
    """Records to their cells, batch by batch; an empty cell is null."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [[x or None for x in next(csv.reader(io.StringIO(r, newline=""), delimiter=sep), [])] for r in b["record"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["file"], b["block"], b["n"], pa.array(rows, pa.list_(pa.string()))], ["file", "block", "n", "cells"])

    return split


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """A file, or a folder of files alike, as text columns named by its header. The header, what stands above it and blank
    rows are left out; rows wider than the header keep their cells in col_N; quoted cells may break lines."""
    head = [r[0].lstrip("\ufeff") for r in spark.read.text(path).limit(HEAD_LINES).collect()]
    sep = detect_separator(head)
    width, broken = shape(spark, path, sep)
    if broken:
        placed = records(spark, path).mapInArrow(_cells(sep), "file string, block long, n long, cells array<string>")
        width = placed.agg(F.max(F.size("cells"))).first()[0] or 1
    else:
        placed = _placed(spark, path, sep, [f"c{i}" for i in range(width)]).withColumn("cells", F.array(*(f"c{i}" for i in range(width))))
    # the first rows of every file, in order: a row's place tells the header from a row that only looks like it
    top = placed.filter(f"block = 0 AND n < {HEAD_SPAN}").withColumn("i", F.row_number().over(Window.partitionBy("file").orderBy("n"))).select("file", "n", "i", "cells")
    rows = [r["cells"] + [None] * (width - len(r["cells"])) for r in top.filter(f"i <= {HEAD_ROWS}").orderBy("file", "i").limit(HEAD_ROWS).collect()]
    rows = [[(r[0] or "").lstrip("\ufeff"), *r[1:]] for r in rows]
    at = header_row(rows)
    names = unique_names(rows[at] if rows else [f"col_{i}" for i in range(1, width + 1)])
    ends = top.filter(f"i = {at + 1}").select(F.col("file").alias("__file"), F.col("n").alias("__header"))
    below = lambda df, file, block, n: df.join(ends, F.col(file) == F.col("__file"), "left").filter(F.coalesce((F.col(block) > 0) | (F.col(n) > F.col("__header")), F.lit(False)))
    if broken:
        body = below(placed.filter(F.exists("cells", lambda x: F.coalesce(F.trim(x) != "", F.lit(False)))), "file", "block", "n")
        return body.select(*(F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)))
    # read under the final names: renaming columns that a filter has named together makes the optimiser's constraints
    # double with every column
    body = below(_placed(spark, path, sep, names, "__f", "__b", "__n"), "__f", "__b", "__n")
    filled = F.coalesce(*(F.nullif(F.trim(F.col(f"`{x}`")), F.lit("")) for x in names))
    return body.filter(filled.isNotNull()).select(*(f"`{x}`" for x in names))


def _placed(spark: SparkSession, path: str, sep: str, names: list[str], file: str = "file", block: str = "block", n: str = "n") -> DataFrame:
    """Rows of files without broken lines, with their file, split and place in it."""
    schema = T.StructType([T.StructField(x, T.StringType()) for x in names])
    raw = spark.read.schema(schema).csv(path, sep=sep, header=False, mode="PERMISSIVE", quote='"', escape='"')
    raw = raw.select(*(f"`{x}`" for x in names), F.col("_metadata.file_path").alias(file), F.col("_metadata.file_block_start").alias(block), F.monotonically_increasing_id().alias(n))
    first = raw.groupBy(F.col(file).alias("__file1"), F.col(block).alias("__block1")).agg(F.min(n).alias("__first"))
    return raw.join(first, (F.col(file) == F.col("__file1")) & (F.col(block) == F.col("__block1"))).withColumn(n, F.col(n) - F.col("__first")).drop("__file1", "__block1", "__first")


def is_data_dictionary(names: list[str]) -> bool:
    """A sheet that describes columns instead of holding data."""
    low = {n.lower() for n in names}
    return len(low) <= 6 and bool(low & {"field", "champ", "column", "colonne", "variable"}) and bool(low & {"description", "definition", "définition", "meaning", "signification"})
