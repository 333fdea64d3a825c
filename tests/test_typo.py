"""Misspellings against a plain table of distances."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from ledgerline.operators import typo


def distance(a, b):
    d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def words(seed, n):
    r = random.Random(seed)
    return ["".join(r.choice("abc") for _ in range(r.randrange(9))) for _ in range(n)]


def test_distance(spark):
    pairs = [*zip(words(1, 150), words(2, 150), strict=True), ("ca", "abc"), ("", ""), ("", "ab"), ("ab", "ba")]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", typo.edits("a", "b").alias("d")).collect()
    assert [r.d for r in got] == [distance(a, b) for a, b in pairs]


def test_matches_against_all_pairs(spark):
    seen, known = words(3, 200) + ["Crédit ", None, "ab"], words(4, 60) + ["credit", "crédti", None, ""]
    got = typo.best_matches(spark.createDataFrame([(x,) for x in seen], "x string"), "x", spark.createDataFrame([(x,) for x in known], "k string"), "k")
    plain = lambda t: t.strip().lower().replace("é", "e")
    want = {}
    for v in {x for x in seen if x is not None and len(plain(x)) >= 3}:
        near = []
        for k in {x for x in known if x is not None}:
            a, b = plain(v), plain(k)
            d = distance(a, b)
            sim = 1 - d / max(len(a), len(b))
            if d <= (1 if len(b) <= 5 else 2) and sim >= 0.65:
                near.append((-sim, k, d))
        if near:
            want[v] = min(near)
    assert {r.value: (r.match, r.distance, r.similarity) for r in got.collect()} == {v: (k, d, round(-s, 3)) for v, (s, k, d) in want.items()}
    assert got.filter(F.col("value") == "Crédit ").first().match == "credit"
