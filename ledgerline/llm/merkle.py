"""Merkle manifest of a dataset: one tree a source over its rows, one tree over the sources' roots.

Leaves get their places by a range sort over (source, id, leaf): what lies before a range within its source is a sum
over ranges, so a source that holds a third of all rows is dealt like any other. Bottom-up build: level by level, every
ARITY consecutive nodes of a tree become one, whose row keeps its children's digests; each level is a written table, a
third of the one below. Top-down proof push: starting at the roots, each level's children are joined with their
parents; a child finds its siblings in its parent's row and prepends them to the proof suffix it inherits. The proofs
of the sources' tree are the suffixes that the sources' roots inherit. No key of any join has more than ARITY rows.

A proof is an array with a step a level, from the leaf to the root: the digests before the node among its siblings and
those after it, each as one text. Folding a leaf along its proof gives the root unless the leaf was tampered with.

Defined results: any column may be null, sources too (a tree of their own, first in order); null ids come first in
their source; rows with one id are ordered by their leaves, and of equal rows each has a place of its own, so that
their proofs differ and their leaves do not; a lone leaf is its source's root, a lone source's root is the root, each
without a proof step of its own; an empty table gives no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

ARITY = 3
#: What a leaf covers, in order.
COVERED = ("doc_id", "source", "lang", "n_chars", "text")


def encoded(value: Column) -> Column:
    """`-` for null, else byte count, colon, value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*(encoded(v) for v in values)), 256)


def without_line_breaks(text: Column) -> Column:
    return F.replace(text, F.lit("\n"), F.lit(""))


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(proof, leaf, lambda node, step: F.sha2(F.concat(step["before"], node, step["after"]), 256))


def proof_text(proof: Column) -> Column:
    """All siblings of a proof, left to right, level by level."""
    return F.array_join(F.transform(proof, lambda step: F.concat(step["before"], step["after"])), "")


def _tree_of(source: Column) -> Column:
    """A text in the order of the sources, null first, that is never null."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def placed(nodes: DataFrame, order: list[str], name: str) -> DataFrame:
    """nodes (with a column tree) with pos, from 0 within each tree by `order`, and n, the tree's size."""
    by = ["tree", *order, "__place"]  # the last spreads rows that are equal in all else over ranges
    ranged = nodes.withColumn("__place", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by)
    ranged = written(ranged.drop("__place").withColumn("__range", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()), name)
    spans = ranged.groupBy("tree", "__range").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__rows"))
    # one row a range that the tree reaches into
    earlier = Window.partitionBy("tree").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("tree", "__range", "__first", F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__before"), F.sum("__rows").over(Window.partitionBy("tree")).alias("n"))
    return ranged.join(spans, ["tree", "__range"]).withColumn("pos", F.col("__at") - F.col("__first") + F.col("__before")).drop("__range", "__at", "__first", "__before")


def build(leaves: DataFrame, name: str) -> list[DataFrame]:
    """Levels above the leaves (tree, pos, n, digest), each written: tree, pos, n, digest, kids.

    n is the number of nodes of the tree on that level; the node of a level with n = 1 is the tree's root.
    """
    levels: list[DataFrame] = []
    below, most = leaves.select("tree", "pos", "n", "digest"), leaves.agg(F.max("n")).first()[0] or 0
    while most > 1:
        kid = [F.max(F.when(F.col("pos") % ARITY == i, F.col("digest"))) for i in range(ARITY)]
        up = below.filter("n > 1").groupBy("tree", F.expr(f"pos div {ARITY}").alias("pos"), F.expr(f"(n + {ARITY - 1}) div {ARITY}").alias("n")).agg(F.array_compact(F.array(*kid)).alias("kids"))
        below = written(up.withColumn("digest", F.sha2(F.array_join("kids", ""), 256)), f"{name}-level")
        levels.append(below)
        most = -(-most // ARITY)
    return levels


def roots(leaves: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """tree, digest, height (the level) of every tree's root."""
    out = leaves.filter("n = 1").select("tree", "digest", F.lit(0).alias("height"))
    for height, level in enumerate(levels, 1):
        out = out.unionByName(level.filter("n = 1").select("tree", "digest", F.lit(height).alias("height")))
    return out


def push(leaves: DataFrame, levels: list[DataFrame], inherited: DataFrame, name: str) -> DataFrame:
    """The leaves with their proofs, one join a level, from the top; every level but the leaves is written.

    inherited: tree, height, proof (of the tree's root), and columns handed to all its leaves. A root is its own
    parent's only child, without a step.
    """
    handed = [c for c in inherited.columns if c not in ("tree", "proof", "height")]
    parent = ["__tree", "__parent", "__kids", "__suffix", *handed]
    parents = None
    for height, level in reversed(list(enumerate([leaves, *levels]))):
        above = inherited.filter(F.col("height") == height).select(F.col("tree").alias("__tree"), F.lit(0).cast("long").alias("__parent"), F.lit(None).cast("array<string>").alias("__kids"), F.col("proof").alias("__suffix"), *handed)
        if parents is not None:
            above = above.unionByName(parents.select(F.col("tree").alias("__tree"), F.col("pos").alias("__parent"), F.col("kids").alias("__kids"), F.col("proof").alias("__suffix"), *handed))
        met = level.join(above.select(*parent), (F.col("tree") == F.col("__tree")) & (F.expr(f"pos div {ARITY}") == F.col("__parent")))
        i = (F.col("pos") % ARITY).cast("int")
        before, after = F.array_join(F.slice("__kids", F.lit(1), i), ""), F.array_join(F.slice("__kids", i + 2, F.lit(ARITY)), "")
        step = F.when(F.col("n") > 1, F.array(F.struct(before.alias("before"), after.alias("after")))).otherwise(F.array())
        parents = met.withColumn("proof", F.concat(step, F.col("__suffix"))).select(*level.columns, "proof", *handed)
        if height:
            parents = written(parents, f"{name}-pushed")
    return parents


def manifest(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", lang_col: str = "lang", chars_col: str = "n_chars", text_col: str = "text") -> DataFrame:
    """id, leaf, tampered (a leaf, or null), subroot, root, proof: array of (before, after)."""
    values = [docs[c] for c in (id_col, source_col, lang_col, chars_col, text_col)]
    marked = F.coalesce(F.crc32(docs[id_col].cast("string").cast("binary")) % 2 == 0, F.lit(False))
    rows = docs.select(_tree_of(docs[source_col]).alias("tree"), docs[id_col].alias("id"), leaf_digest(*values).alias("digest"), F.when(marked, leaf_digest(*values[:-1], without_line_breaks(values[-1]))).alias("tampered"))
    leaves = written(placed(rows, ["id", "digest"], "manifest-rows"), "manifest-leaves")
    levels = build(leaves, "manifest")
    # the sources' tree: its leaves are the subroots in the order of the sources
    subroots = roots(leaves, levels).select(F.lit("").alias("tree"), F.col("tree").alias("source"), F.col("height").alias("source_height"), "digest")
    tops = written(placed(subroots, ["source"], "manifest-tops"), "manifest-sources")
    above = build(tops, "manifest-top")
    root = roots(tops, above)
    proofs = push(tops, above, root.select("tree", "height", F.col("digest").alias("root"), F.array().cast("array<struct<before:string,after:string>>").alias("proof")), "manifest-top")
    inherited = proofs.select(F.col("source").alias("tree"), F.col("source_height").alias("height"), "proof", F.col("digest").alias("subroot"), "root")
    return push(leaves, levels, inherited, "manifest").select("id", F.col("digest").alias("leaf"), "tampered", "subroot", "root", "proof")


def manifest_report(docs: DataFrame) -> DataFrame:
    """The contract's rows: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    folded = fold(F.coalesce("tampered", "leaf"), F.col("proof"))
    rows = manifest(docs).select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(proof_text(F.col("proof")), 256).alias("proof_sha256"), folded.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
