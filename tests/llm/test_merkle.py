"""The manifest against a plain recursive tree, on rows with nulls, ties, repeats, long texts and clashing columns."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerline.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, pos long, n int, digest string, root string"
ROWS = [
    *((i, "a", "en", i, f"line {i}\nand more") for i in range(1, 30)), (5, "a", "en", 5, "another five"), (5, "a", "en", 5, "line 5\nand more"), (None, "a", None, None, None), (None, "a", None, None, None), (7, None, "fr", 1, "x"),
    (-3, None, "fr", None, "x\ny"), (8, "", "é", 0, ""), (9, "é", "en", 3, "é\n\né"), (10, "z", None, 10, None), (11, "b", "en", 1, "w\n" * 40_000), (12, "b", "en", 1, "1:a"), (13, "-", "-", 1, "-"), (14, "c", "en", 2, "\n"),
]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, cut=False):
    i, source, lang, n, text = row
    if cut and text is not None:
        text = text.replace("\n", "")
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)))


def tree(nodes):
    """(root, for every node its steps to the root)."""
    steps, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, p in enumerate(at):
            run = nodes[p - p % 3 : p - p % 3 + 3]
            steps[k].append(("".join(run[: p % 3]), "".join(run[p % 3 + 1 :])))
        at = [p // 3 for p in at]
        nodes = [h(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
    return (nodes or [None])[0], steps


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    sub = {}
    for s in order:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        sub[s] = tree([leaf(r) for r in by[s]])
    root, above = tree([sub[s][0] for s in order])
    out = Counter()
    for s, up in zip(order, above, strict=True):
        for r, own in zip(by[s], sub[s][1], strict=True):
            steps = own + up
            marked = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            node = leaf(r, marked)
            for before, after in steps:
                node = h(before, node, after)
            out[r[0], leaf(r), sub[s][0], root, h(*(b + a for b, a in steps)), node, node == root] += 1
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "t", 1, 2, "d", "r") for r in ROWS], SCHEMA).repartition(5)


def test_report(docs):
    got = merkle.manifest_report(docs)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    rows = got.collect()
    assert Counter(tuple(r) for r in rows) == brute(ROWS)
    assert {r.verified for r in rows} == {True, False}


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 9, 10, 28])
def test_sizes_of_one_source(spark, n):
    rows = [(i, "s", "en", 1, f"t\n{i}") for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(3)
    assert Counter(tuple(r) for r in merkle.manifest_report(docs).collect()) == brute(rows)


def test_proofs_and_tampering(docs):
    """Every untouched leaf folds to the root along its proof; a proof doesn't fit another leaf."""
    rows = merkle.manifest(docs).withColumn("folded", merkle.fold(F.col("leaf"), F.col("proof"))).withColumn("other", merkle.fold(F.sha2("leaf", 256), F.col("proof"))).collect()
    assert len(rows) == len(ROWS) and {r.folded for r in rows} == {rows[0].root} and rows[0].root not in {r.other for r in rows}


def test_levels_shrink_by_the_arity(docs, spark):
    nodes = spark.range(100).select(F.lit("t").alias("tree"), F.sha2(F.col("id").cast("string"), 256).alias("digest"), "id")
    leaves = merkle.placed(nodes, ["id"], "test-rows")
    assert [r.pos for r in leaves.orderBy("id").collect()] == list(range(100))
    assert [level.count() for level in merkle.build(leaves, "test")] == [34, 12, 4, 2, 1]
