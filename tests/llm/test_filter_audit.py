"""The filter audit against a plain walk through every order, on rows with nulls, ties, repeats and clashing columns."""

from __future__ import annotations

import re
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from ledgerline.llm import filter_audit

WORDS = " ".join(f"w{i}" for i in range(120))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n int, mask string, digest string, id int"
ROWS = [
    (1, WORDS, "en"), (2, WORDS, "en"), (2, WORDS, "en"), (2, WORDS, "fr"), (3, "SHORT", "en"), (4, None, None), (5, "", None), (6, "", "de"), (None, WORDS, "en"), (None, "", "fr"), (7, "a a a a $", "en"), (8, "A B C", ""),
    (9, WORDS + " x" * 400, "fr"), (10, "one\ntwo\x0bthree|", "fr"), (11, WORDS.upper(), "de"), (12, "a a a a $", "de"), (13, " ".join(["again"] * 20_000), "en"), (14, "é" * 50 + "ÀÉ", "fr"),
]
LABELS = [(1, 1, 0), (2, 1, 1), (3, 0, 1), (3, 1, None), (7, None, 1), (9, 1, 0), (None, 1, 1), (12, 1, 1), (99, 1, 1)]


def fails(rows):
    for doc_id, text, lang in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        e = doc_id is not None and any(i is not None and i < doc_id and (x or "") == t for i, x, _ in rows)
        yield {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": e}


def brute(rows, labels):
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    failing = list(fails(rows))
    out = Counter()
    for part in {r[2] or "" for r in rows}:
        own = [(r, f) for r, f in zip(rows, failing, strict=True) if (r[2] or "") == part]
        removed_in_all = Counter()
        lines = []
        for order in permutations("ABCDE"):
            left = own
            for step, x in enumerate(order, 1):
                gone, before = [r for r, f in left if f[x]], len(left)
                left = [(r, f) for r, f in left if not f[x]]
                removed_in_all[x] += len(gone)
                assert before == len(left) + len(gone)
                lines.append((x, ("".join(order), step, len(left), len(gone), sum(f[x] for _, f in own) - len(gone), sum(f[x] and sum(f.values()) == 1 for _, f in own), sum(r[0] in good for r in gone), sum(r[0] in toxic for r in gone))))
        out.update((part, *line, removed_in_all[x]) for x, line in lines)
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, g, "s", 1, 7, "m", "d", 3) for i, t, g in ROWS], SCHEMA).repartition(5)


def test_every_order_and_step(spark, docs):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    got = filter_audit.interaction_report(docs, labels)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert Counter(tuple(r) for r in got.collect()) == brute(ROWS, LABELS)


def test_empty_tables(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.interaction_report(docs.limit(0), labels).count() == 0
    got = filter_audit.interaction_report(docs, labels)
    assert Counter(tuple(r) for r in got.collect()) == brute(ROWS, [])


def test_other_filters_and_names(spark):
    """Two filters of one's own: six orders of three steps a part."""
    docs = spark.createDataFrame([("a", "x y", "p"), ("b", "x y", "p"), ("c", "z", "q")], "key string, body string, site string")
    labels = spark.createDataFrame([("b", 1, 0)], "key string, quality int, toxic int")
    own = lambda text, words: {"S": F.size(words) < 2, "X": text.contains("x")}
    rows = filter_audit.interaction_report(docs, labels, own, id_col="key", text_col="body", part_col="site").collect()
    assert len(rows) == 2 * 6 * 3
    by = {(r.part, r.filter_order, r.step): r for r in rows}
    assert (by["p", "SXE", 2].removed, by["p", "SXE", 2].good_lost, by["p", "SXE", 3].removed, by["p", "SXE", 3].redundant) == (2, 1, 0, 1)
    assert by["p", "ESX", 1].removed == 1 and by["q", "SXE", 1].kept == 0


def test_survivors_are_sums_over_subsets(spark):
    masks = spark.createDataFrame([("p", m, m + 1, m % 3, m % 2) for m in range(0, 32, 3)], "part string, mask int, n long, good long, toxic long")
    row = filter_audit.survivors(masks, 5).first()
    for s in range(32):
        assert row.n[s] == sum(m + 1 for m in range(0, 32, 3) if not m & s)
        assert row.toxic[s] == sum(m % 2 for m in range(0, 32, 3) if not m & s)
