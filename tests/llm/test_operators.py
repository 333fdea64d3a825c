"""Small fixtures with nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns,
held against brute force."""

from __future__ import annotations

import hashlib
import re
import time
import zlib
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerline.llm import decontaminate, exact_dedup, html_extract, jaccard_join, language_id, license_scan, packing, substring_dedup, textnum, toxicity, url_filter
from ledgerline.llm.components import components

PROSE = "the quick brown fox jumps over the lazy dog while many other animals look on from the far side of the old stone wall and wonder what all the noise is about this time"
LONG = " ".join(f"w{i % 977} x{i % 13}" for i in range(30_000))


def doc(i, text, lang="en"):
    return (i, text, lang, "s", len(text or ""), "k", 1)


#: doc_id, text, lang, source, n_chars, and columns with names that operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, run int"
ROWS = [
    doc(1, PROSE), doc(2, PROSE), doc(2, PROSE), doc(3, PROSE.replace("noise", "fuss")), doc(4, None, None), doc(5, ""), doc(6, " \t\n"), doc(7, PROSE.upper()), doc(None, PROSE), doc(None, "one two"),
    doc(8, LONG), doc(9, "x " + LONG), doc(10, "one two"), doc(11, "One  two"), doc(12, "Un deux trois é à la maison du père", "fr"), doc(13, f"start {PROSE} end {PROSE}"), doc(14, "1234 !!!"), doc(15, "<|endoftext|> it's 'RE x9 ½ ß 中文 é"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def squash(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def test_exact_dedup(docs, none):
    got = exact_dedup.exact_dedup_report(docs).collect()
    assert len(got) == len(ROWS)
    groups = Counter(squash(r[1]) for r in ROWS)
    for sha, n in ((hashlib.sha256(k.encode()).hexdigest(), n) for k, n in groups.items()):
        own = [r for r in got if r.text_sha256 == sha]
        assert len(own) == n and {r.group_size for r in own} == {n} and sum(r.kept for r in own) == 1
    keep = {r.text_sha256: r.keep_id for r in got}
    assert keep[hashlib.sha256(squash(PROSE).encode()).hexdigest()] == 1
    assert keep[hashlib.sha256(b"").hexdigest()] == 6  # most code points
    assert exact_dedup.exact_dedup_report(none).count() == 0
    left = exact_dedup.drop_exact_duplicates(docs)
    assert left.columns == docs.columns and left.count() == len(groups)
    assert exact_dedup.drop_exact_duplicates(none).count() == 0


def words(t, lower=True):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "") if lower else t or ""
    return re.findall(r"[^\x20\x09-\x0D]+", t)


def plain(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def shingle_set(t, n=4):
    w = words(t)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute_components(texts, n=4, percent=85):
    sets = [shingle_set(t, n) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return sets, root


def test_jaccard_join(docs, none):
    got = jaccard_join.jaccard_report(docs).collect()
    sets, root = brute_components([r[1] for r in ROWS])
    least = {}
    for r, row in zip(root, ROWS, strict=True):
        if row[0] is not None:
            least[r] = min(least.get(r, row[0]), row[0])
    want = Counter((row[0], len(s), least.get(r)) for row, s, r in zip(ROWS, sets, root, strict=True))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    assert jaccard_join.jaccard_report(none).count() == 0
    left = jaccard_join.drop_near_duplicates(docs, 5, 80)
    sets, root = brute_components([r[1] for r in ROWS], 5, 80)
    assert left.columns == docs.columns and left.count() == len({r for r, s in zip(root, sets, strict=True) if s}) + sum(not s for s in sets) - 0


def test_jaccard_join_of_near_copies(spark):
    rng = np.random.default_rng(4)
    base = [f"t{i}" for i in rng.integers(0, 5000, 300)]
    rows = []
    for i in range(120):
        w = list(base)
        for k in rng.integers(0, 300, int(rng.integers(0, 14))):
            w[k] = f"n{rng.integers(0, 10**6)}"
        rows.append((i, " ".join(w)))
    long = [f"u{i}" for i in rng.integers(0, 10**6, 4000)]
    rows += [(1000 + i, " ".join(long[: 4000 - 150 * i])) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_report(df).collect()}
    _, root = brute_components([t for _, t in rows])
    assert got == {i: rows[r][0] for (i, _), r in zip(rows, root, strict=True)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 30), min_size=3, max_size=14), min_size=2, max_size=14), st.integers(0, 2**14 - 1))
def test_tile_forest_connects_all_pairs_that_may_link(sets, home_bits):
    sets = sorted(sets, key=len)
    h = [np.array(sorted(x), np.uint64) * np.uint64(0x9E3779B97F4A7C15) for x in sets]
    size = np.array([len(x) for x in h])
    bits = jaccard_join.signatures(np.concatenate(h), np.concatenate([[0], np.cumsum(size)])).view(np.uint64)
    home = np.array([bool(home_bits >> i & 1) for i in range(len(h))])
    edges = jaccard_join.tile_forest(size, bits, home, 60)
    root = list(range(len(h)))
    for i in range(len(h)):
        for j in range(i):
            if (home[i] or home[j]) and 100 * size[j] >= 60 * size[i] and jaccard_join.may_link(size[j], bits[j], size[i], bits[i], 60):
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    mine = list(range(len(h)))
    for a, b in edges:
        assert mine[a] != mine[b]  # a forest
        mine = [min(mine[a], mine[b]) if r in (mine[a], mine[b]) else r for r in mine]
    assert mine == root


def test_classes_whose_first_digests_clash(spark):
    sets = spark.createDataFrame([(1, 3, 7, 8), (2, 3, 7, 9), (3, 3, 5, 6), (4, 3, 5, 6), (5, 0, 7, 1)], "id long, size long, c1 long, c2 long")
    clash = jaccard_join.clashes(sets)
    assert clash == {7} and sorted(r.c1 for r in jaccard_join.named(sets, clash).collect()) == [1, 5, 5, 8, 9]


def test_components_of_a_star(spark):
    edges = [(i, 0) for i in range(1, 3000)] + [(i, i - 1) for i in range(5001, 5100)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 3000)}, **{i: 5000 for i in range(5001, 5100)}}


def brute_substrings(rows, width=20):
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    seen, out = set(), {}
    for k in order:
        w = words(rows[k][1], False)
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            x = tuple(w[i : i + width])
            if x in seen:
                gone[i : i + width] = [True] * width
            seen.add(x)
        out[k] = (rows[k][0], len(w), sum(gone), hashlib.sha256(" ".join(a for a, g in zip(w, gone, strict=True) if not g).encode()).hexdigest())
    return Counter(out.values())


@pytest.mark.parametrize("shard_bytes", [16_000_000, 60_000, 2_000])
def test_substring_dedup(spark, docs, none, shard_bytes):
    rows = [r for r in ROWS if r[0] is not None]  # the order of several null ids is by text hash
    df = spark.createDataFrame(rows, SCHEMA).repartition(2)
    got = substring_dedup.substring_report(df, shard_bytes=shard_bytes).collect()
    assert Counter(map(tuple, got)) == brute_substrings(rows)
    if shard_bytes > 10**6:
        assert substring_dedup.substring_report(docs).count() == len(ROWS)
        assert substring_dedup.substring_report(none).count() == 0


def brute_hits(rows, items, width=10):
    phrases = {}
    for item, text in items:
        w = plain(text)
        for i in range(max(1, len(w) - width + 1) if w else 0):
            phrases.setdefault(tuple(w[i : i + width]), set()).add(item)
    out = Counter()
    for r in rows:
        w = plain(r[1])
        hit, found = [False] * len(w), set()
        for n in {len(p) for p in phrases}:
            for i in range(len(w) - n + 1):
                if (p := tuple(w[i : i + n])) in phrases:
                    hit[i : i + n] = [True] * n
                    found |= phrases[p]
        out[(r[0], len(w), sum(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), any(hit))] += 1
    return out


def test_decontamination(spark, docs, none):
    items = [(1, PROSE[20:110]), (2, "one two"), (3, None), (4, "!!"), (10, "ONE, two"), (5, " ".join(LONG.split()[500:530])), (6, "zebra"), (7, PROSE)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert Counter(map(tuple, decontaminate.contamination_report(docs, bench).collect())) == brute_hits(ROWS, items)
    assert decontaminate.contamination_report(none, bench).count() == 0
    clean = decontaminate.contamination_report(docs, bench.limit(0)).collect()
    assert len(clean) == len(ROWS) and not any(r.contaminated for r in clean)
    cut = decontaminate.without_benchmark(docs, bench)
    assert cut.columns == docs.columns
    again = decontaminate.contamination_report(cut, bench).collect()
    assert 13 in {r.doc_id for r in again} and not any(r.n_hit for r in again if r.doc_id in (8, 13))


def test_decontamination_in_passes(spark, docs, monkeypatch):
    """A benchmark of many blocks, a few at a time, gives what one pass gives."""
    items = [(f"i{k}", x) for k, x in enumerate([PROSE[20:110], "one two", None, "!!", "ONE, two", " ".join(LONG.split()[500:530]), "zebra", PROSE, "un deux trois é", PROSE[60:]])]
    bench = spark.createDataFrame(items, "item_id string, text string")
    whole, cut = Counter(map(tuple, decontaminate.contamination_report(docs, bench).collect())), Counter(map(tuple, decontaminate.without_benchmark(docs, bench).collect()))
    assert whole == brute_hits(ROWS, items)
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 20)
    monkeypatch.setattr(decontaminate, "PASS_BLOCKS", 2)
    assert Counter(map(tuple, decontaminate.contamination_report(docs, bench).collect())) == whole
    assert Counter(map(tuple, decontaminate.without_benchmark(docs, bench).collect())) == cut


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(2, 5), min_size=1, max_size=80), st.lists(st.lists(st.integers(2, 5), min_size=3, max_size=3), min_size=1, max_size=5))
def test_fm_index(seq, phrases):
    s = np.array([*seq, 0])
    index = decontaminate.FMIndex(s, 5)
    lo, hi = index.search(np.array(phrases))
    for p, a, b in zip(phrases, lo, hi, strict=True):
        want = [i for i in range(len(seq) - 2) if seq[i : i + 3] == p]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_packing(docs, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    ids = {}
    for r in ROWS:
        x = np.array([*t.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4")
        ids.setdefault(r[0], []).append(x)
        want[r[0]] += len(x)
    got = packing.pack(docs).collect()
    assert {k: sum(r.length for r in got if r.doc_id == k) for k in want} == dict(want)
    for r in got:
        assert any(len(x) == r.doc_tokens and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for x in ids[r.doc_id])
    for s in {r.sequence_id for r in got}:
        own = sorted((r.offset, r.length) for r in got if r.sequence_id == s)
        assert [o for o, _ in own] == list(np.cumsum([0, *(n for _, n in own)])[:-1]) and sum(n for _, n in own) <= 4096
    for i in {r.doc_id for r in got if r.doc_id is not None and want[r.doc_id] == r.doc_tokens}:  # pieces tile a document
        own = sorted((r.start, r.length) for r in got if r.doc_id == i)
        assert [a for a, _ in own] == list(np.cumsum([0, *(n for _, n in own)])[:-1]) and sum(n for _, n in own) == want[i]
    used = Counter()
    for r in got:
        used[r.sequence_id] += r.length
    assert all(u == 4096 or u & (u - 1) == 0 for u in used.values())
    assert packing.pack(none).count() == 0


def test_first_fit_decreasing_is_first_fit():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 100, 300)
    bins, free = [], []
    for i in np.argsort(-sizes, kind="stable"):
        k = next((k for k, f in enumerate(free) if f >= sizes[i]), len(free))
        if k == len(free):
            free.append(128)
        free[k] -= sizes[i]
        bins.append((i, k))
    assert packing.first_fit_decreasing(sizes, 128).tolist() == [k for _, k in sorted(bins)]


URLS = ["http://www.example.net/en/1?x#y", "https://EXAMPLE.net/fr/", "http://a.net", "ftp://notexample.com/de/x", "x://sub.example.com/de/?q", "http://b.org/fr/1", "nope", None, "http://u.net/?", "http://example.net:80/en/", "://net/"]


def brute_verdicts(urls, rules):
    want = Counter()
    for i, u in urls:
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = [(len(h + p), h + p, v) for h, p, v in rules if None not in (h, p, v) and (host == h or host.endswith("." + h)) and path.startswith(p)]
        want[(i, host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else "allow")] += 1
    return want


@pytest.mark.parametrize("shard_bytes", [1 << 26, 400])
def test_url_filter(spark, shard_bytes):
    urls = [*enumerate(URLS), (None, URLS[0]), (None, URLS[0]), (90, "http://" + "a." * 200_000 + "net/x"), (91, "http://b.net/" + "y" * 500_000)]
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in urls], "page_id long, url string, host string, rule string")
    assert Counter(map(tuple, url_filter.filter_urls(pages, shard_bytes=shard_bytes).collect())) == brute_verdicts(urls, url_filter.RULES)
    many = [*url_filter.RULES, (None, "/", "block"), ("com", None, "allow"), ("com", "/", None), ("example.net", "/en/", "block"), *((f"h{i}.net", "/" + "p" * (i % 5), "block" if i % 2 else "warn") for i in range(60))]
    more = [(i, f"http://{a}h{i}.net/ppp{i}") for i in range(60) for a in ("", "x.", "x")]
    got = url_filter.filter_urls(spark.createDataFrame(more + urls, "page_id long, url string"), spark.createDataFrame(many, "host string, path string, verdict string"), shard_bytes=shard_bytes).collect()
    assert Counter(map(tuple, got)) == brute_verdicts(more + urls, many)
    assert url_filter.filter_urls(pages.limit(0)).count() == 0 and {r.verdict for r in url_filter.filter_urls(pages, []).collect()} == {"allow"}


def test_digests_are_those_of_spark(spark):
    texts = ["", "a", "net/", "é" * 40, "x" * 1000]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(F.xxhash64("t")).collect()]
    assert np.array(got, np.int64).view(np.uint64).tolist() == url_filter.digests([t.encode() for t in texts]).tolist()


def test_digest_array_confirms(tmp_path, monkeypatch):
    monkeypatch.setattr(url_filter, "digests", lambda keys: np.array([len(k) for k in keys], np.uint64))  # everything collides
    (tmp_path / "t").write_bytes(url_filter.DigestArray.pack([b"aa", b"bb", b"c"], [b"x", b"y", b""]))
    index = url_filter.DigestArray.open(str(tmp_path / "t"))
    found = index.find([b"bb", b"aa", b"zz", b"c"])
    assert [index.key(i) if i >= 0 else None for i in found] == [b"bb", b"aa", None, b"c"]
    assert [index.verdict(i) for i in found[[0, 1, 3]]] == ["y", "x", ""]


def test_license_scan(spark, docs, none):
    rows = [(1, "Released UNDER the MIT License. x"), (2, "Licensed under the Apache License, Version 2.0."), (3, "by cc by nc cc by nc"), (4, None), (5, "This work is licensed under the GNU General Public License, version 3"), (6, "Licensed under CC BY-NC 4.0."), (7, "mit license nothing else"), (7, "under the mit license" * 2)]
    got = {(r.doc_id, r.n_words): r for r in license_scan.license_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows)
    assert got[(1, 6)].labels == "mit" and (got[(1, 6)].first_word, got[(1, 6)].n_base, got[(1, 6)].score) == (1, 1, 1.0)
    assert got[(2, 8)].labels == "apache-2" and got[(3, 7)].n_base == 2 and (got[(3, 7)].first_word, got[(3, 7)].last_word) == (1, 4)
    assert got[(4, 0)].labels == "" and got[(4, 0)].first_word is None and got[(5, 12)].labels == "gpl-3" and got[(6, 7)].labels == "cc-by-nc"
    assert got[(7, 4)].labels == ""
    assert license_scan.license_report(docs).count() == len(ROWS) and license_scan.license_report(none).count() == 0


def contained_labels(text):
    """Brute force: every line, and every run of twice a template's words, line ends or not."""
    split = lambda t: re.findall(r"[a-z0-9]+", t.lower())
    sets = [(label, split(t), set(split(must))) for label, texts in license_scan.TEMPLATES.items() for t, must in texts]
    w, out = split(text), []
    for label, t, must in sets:
        runs = [set(w[i : i + 2 * len(t)]) for i in range(len(w))] + [set(split(x)) for x in text.split("\n")]
        out += [(label, r & set(t)) for r in runs if len(r & set(t)) >= 0.8 * len(set(t)) - 1e-9 and must <= r]
    return ",".join(sorted({label for label, x in out if not any(x < y for _, y in out)}))


def test_license_base_columns(spark):
    """Places of the base phrases against a plain search, in texts of phrase words, other words and odd separators."""
    rng = np.random.default_rng(11)
    parts = [*license_scan.PHRASES, "under the mit", "mit license", "Apache License, Version 2.0", "cc-by-nc", "CC", "by", "nc", "é", "the", "\n", "licensé", "under THE Mit LICENSE", "x9"]
    rows = [(i, "".join(str(rng.choice(parts)) + str(rng.choice([" ", "-", ", ", "\t", "é"], p=[0.7, 0.1, 0.1, 0.05, 0.05])) for _ in range(int(rng.integers(0, 40))))) for i in range(300)]
    rows += [(900, None), (901, ""), (902, rows[5][1]), (902, rows[5][1]), (None, "under the mit license"), (903, "cc by nc " * 50_000)]
    got = Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in license_scan.license_report(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    want = Counter()
    for i, t in rows:
        w = plain(t)
        places = [(k, label) for p, label in license_scan.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        at = sorted(k for k, _ in places)
        want[(i, len(w), len(at), at[0] if at else None, at[-1] if at else None, ",".join(sorted({x for _, x in places})))] += 1
    assert got == want


@pytest.mark.parametrize("text", ["Released under the BSD license", "released under the terms of the old license", "Photo by Ann, licensed under GPL 4.0", "licensed by Ann under version 4.0", "under a public license of the general kind"])
def test_license_names_must_be_there(spark, text):
    assert [(r.labels, r.score) for r in license_scan.license_report(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()] == [("", 0.0)]
    assert contained_labels(text) == ""


def test_license_notices_wrapped_and_variants(spark):
    import textwrap

    rows, want = [], []
    for label, notices in license_scan.TEMPLATES.items():
        for notice, _ in notices:
            for width in (12, 40, 72, 500):
                for text in (textwrap.fill(notice, width, break_long_words=False), f"{PROSE}\n\n{textwrap.fill(notice, width, break_long_words=False)}\n{PROSE}"):
                    rows.append((len(rows), text))
                    want.append(label)
    for text, label in (("Licensed under CC BY 4.0", "cc-by"), ("Licensed under CC\nBY-SA 4.0", "cc-by-sa"), ("licensed under the GNU General Public License version 2.0", "gpl-2"), ("Licensed under CC BY-ND 4.0", "cc-by-nd"), ("This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License", "cc-by-nc-nd"), ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "cc-by-nc-sa"), ("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License", "cc-by-nd"),
        ("SPDX-License-Identifier: LGPL-2.1-or-later", "lgpl-2.1"), ("SPDX-License-Identifier: AGPL-3.0-only", "agpl-3"), ("SPDX-License-Identifier: MIT", "mit"), ("licensed under the GNU Lesser General Public License version 3", "lgpl-3"), ("licensed under the GNU Affero General Public License version 3", "agpl-3"), ("released\nunder the\nApache License", "")):
        rows.append((len(rows), text))
        want.append(label)
    got = {r.doc_id: r for r in license_scan.license_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [contained_labels(t) for _, t in rows] == want
    # base labels stay beside the method's: a BY-NC-SA notice holds the phrase "cc by nc"
    both = [",".join(sorted({*x.split(","), *got[i].base_labels.split(",")} - {""})) for i, x in enumerate(want)]
    wrong = [(t, got[i].labels, x) for (i, t), x in zip(rows, both, strict=True) if got[i].labels != x]
    assert not wrong and all((got[i].score > 0) == (x != "") for i, x in enumerate(want))


def test_language_id(spark, docs, none):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(240):
        lang, parts = ("aa", ["tion", "the", "ing", "er"]) if i % 2 else ("bb", ["schen", "ung", "ein", "lich"])
        rows.append((i, " ".join("".join(rng.choice(parts, 2)) for _ in range(int(rng.integers(3, 40)))), lang))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.language_report(df).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got)
    assert np.mean([got[i].lang_pred == lang for i, _, lang in rows if got[i].held_out]) > 0.97
    odd = language_id.language_report(docs).collect()
    assert len(odd) == len(ROWS) and {r.lang_pred for r in odd if r.doc_id in (4, 5, 6, 14)} == {"und"} and all(0 <= r.score <= 1 for r in odd)
    assert language_id.language_report(none).count() == 0
    left = language_id.keep_identified(docs)
    assert left.columns == docs.columns and left.count() == len(ROWS) - 4


def test_language_stage_without_labels(spark, docs):
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    held_out = docs.withColumn("lang", F.when(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1, "en"))
    for d in (unlabelled, held_out, docs.withColumn("lang", F.lit("und"))):
        left = language_id.keep_identified(d)
        assert left.columns == d.columns and Counter(r.text for r in left.collect()) == Counter(r[1] for r in ROWS if r[0] not in (4, 5, 6, 14))
    assert {r.lang_pred for r in language_id.language_report(unlabelled).collect()} == {"und"}


def test_language_stage_rejects_what_no_profile_is_near(spark):
    rng = np.random.default_rng(5)
    letters = "etaoinshrdlucmfwypvbgk"
    known = [(i, " ".join("".join(rng.choice(list(letters[:15]), int(rng.integers(2, 9)))) for _ in range(200)), "aa") for i in range(60)]
    strange = [(100, "Привет мир как дела сегодня вечером дома"), (101, "短い 文章 ではない もっと 長い 文章 です よろしく おねがいします"), (102, "zzqxj"), (103, known[0][1]), (104, "12 34"), (105, None)]
    df = spark.createDataFrame(known + [(i, t, None) for i, t in strange], "doc_id long, text string, lang string")
    assert {r.doc_id for r in language_id.keep_identified(df).collect()} == {*range(60), 100, 101, 102, 103}  # without a letter or text alone
    assert {r.doc_id for r in language_id.keep_identified(df, least_strength=2.0).collect()} == {*range(60), 103}
    assert language_id.keep_identified(df, ["bb"]).count() == 0


def test_language_scores_do_not_depend_on_neighbours_or_length(spark):
    text = "one two three é four " * 40_000  # cut into pieces
    model = language_id.train(spark.createDataFrame([(0, text, "aa"), *((i, "fünf sechs sieben " * 9, "bb") for i in range(2, 8)), *((i, None, f"x{i}") for i in range(20, 40))], "doc_id long, text string, lang string"))
    tri = lambda t: np.concatenate([x[1] for x in language_id.trigrams(pa.array([t]))])
    assert Counter(tri(text).tolist()) == Counter({k: 40_000 * n for k, n in Counter(tri("one two three é four ").tolist()).items()})
    texts = ["sechs", text, "", "é", None, "one", "x" * 600_000, "one"]
    together = model.judge(pa.array(texts)).to_pylist()
    assert together == [model.judge(pa.array([t], pa.string())).to_pylist()[0] for t in texts]
    assert [r["lang_pred"] for r in together] == ["bb", "aa", "und", together[3]["lang_pred"], "und", "aa", together[6]["lang_pred"], "aa"]


def test_toxicity(spark, docs, none):
    rng = np.random.default_rng(3)
    vocabulary = [f"{a}{b}" for a in ("ba", "lo", "mi", "tu") for b in ("ran", "sel", "dop", "fin", "gul")]
    rows, labels = [], []
    for i in range(600):
        w = list(rng.choice(vocabulary, 30))
        toxic = i % 4 == 0
        for k in rng.integers(0, 30, 3) if toxic else ():
            w[k] = str(rng.choice(["horribad", "meanword"]))
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    d, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (1, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    lexicon, weights = toxicity.learn(d, lab)
    assert set(lexicon.terms) == {"horribad", "meanword"}
    got = {r.doc_id: r for r in toxicity.toxicity_report(d, lab).collect()}
    assert all(got[i].predicted == t for i, _, t in labels) and all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    some = spark.createDataFrame([(1, "baran horribat horribat losel"), (2, None), (3, "the word \"horribad\" is an insult, he said"), (4, "you horribad horribad")], "doc_id long, text string")
    s = {r.id: r.score for r in toxicity.score(some, lexicon, weights).collect()}
    assert s[1] > s[2] and s[4] > s[3]
    assert toxicity.toxicity_report(docs, lab.limit(0)).count() == len(ROWS) and toxicity.toxicity_report(none, lab).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(max_examples=150, deadline=None)
@given(st.text("abé中😀", min_size=1, max_size=12), st.lists(st.text("abé中😀", min_size=1, max_size=12), min_size=1, max_size=6, unique=True))
def test_automaton_meets_trie(word, terms):
    best = min(((distance(word, t), k) for k, t in enumerate(terms) if distance(word, t) <= toxicity.bound(len(t))), default=None)
    assert toxicity.Trie(terms).near(word) == best
    w = next(textnum.words(pa.array([word]), textnum.PLAIN_WORDS))
    assert bool(toxicity.Lexicon(terms).hits(w)[0]) == (best is not None)  # the filter loses nothing


@pytest.mark.parametrize("term, word", [("é" * 10, "é" * 8), ("中文字符串", "中文字符"), ("中文字符串", "中文字符串x"), ("abcdefghij", "abcdefgh😀j"), ("😀" * 10, "😀" * 8), ("abcdefghij", "ab中cdefghij中")])
def test_filter_keeps_edits_of_wide_letters(term, word):
    w = next(textnum.words(pa.array([f"x {word} y"]), textnum.PLAIN_WORDS))
    assert distance(word, term) <= toxicity.bound(len(term)) and toxicity.Lexicon([term]).hits(w)[0] == [1]


@settings(max_examples=60, deadline=None)
@given(st.text("abcdé", min_size=1, max_size=9), st.lists(st.text("abcdé", min_size=4, max_size=6), min_size=1, max_size=5, unique=True))
def test_stems_are_states_of_the_trie(word, stems):
    fits = [(len(x), k) for k, x in enumerate(stems) if word.startswith(x) and len(word) > len(x)]
    assert toxicity.Trie(["zzzzz"], stems).run(word)[1] == (max(fits)[1] if fits else -1)
    w = next(textnum.words(pa.array([word]), textnum.PLAIN_WORDS))
    assert toxicity.Lexicon(["zzzzz"], stems).hits(w) == (([0], [max(fits)[1]], [-1]) if fits else ([], [], []))


def test_toxicity_repeated_rows_and_clashing_columns(spark):
    rows = [(i % 40, ("horribad thing " if i % 40 < 20 else "fine thing ") + " ".join(f"w{(i * j) % 17}" for j in range(9)), "x", 1) for i in range(80)]
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic string, score int")
    lab = spark.createDataFrame([(i, int(i < 20), "t", 0.0) for i in range(40)] * 2 + [(1, None, None, None)], "doc_id long, toxic int, text string, score double")
    got = toxicity.toxicity_report(d, lab).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _, _, _ in rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


PAGE = "<html><head><title>t</title><script>var a='</p>';</script></head><body><header><p>Site</p></header><nav><ul><li>Home<li>News</ul></nav><div class='cookie-notice'>We use cookies</div>{}<aside>More</aside><form><p>Sign up</p></form><footer>&copy; x</footer></body></html>"


def test_html_extraction(spark):
    article = "<article><h1>Title &amp; more</h1><p>One <b>two<br><p>three\n\t four</p><div class=\"ad\">Buy</div><section id='comments'><p>nice!</p></section></article>"
    open_page = "<div><p>Body {} a</p><p>Body {} b</p></div><div><p>All rights reserved here</p></div>"
    rows = [(1, "http://h/a/1", PAGE.format(article)), (2, None, None), (3, "http://h/a/2", ""), (None, "nope", "plain text"), *((10 + i, f"http://k.org/x/{i}", PAGE.format(open_page.format(i, i))) for i in range(6)), (20, "http://k.org/x/0", PAGE.format(open_page.format(0, 0)))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r for r in html_extract.extraction_report(df).collect()}
    assert len(got) == len(rows)
    assert got[1].text == "Title & more\nOne two\nthree four" and got[2].text == got[3].text == "" and got[None].text == "plain text"
    assert all(got[10 + i].text == f"Body {i} a\nBody {i} b" for i in range(1, 6))
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert html_extract.extraction_report(df.limit(0)).count() == 0


def test_html_article_parts_with_ambiguous_names():
    kept = ["<section id='discussion'><p>{}</p></section>", "<h2 id='search'>{}</h2>", "<h3 class='comments'>{}</h3>", "<section id='related-work'><p>{}</p></section>", "<div class='header'><h1>{}</h1></div>", "<div id='menu'><p>{}</p></div>", "<section id='ads'><p>{}</p></section>", "<p class='notice'>{}</p>", "<div class='copyright'>{}</div>"]
    gone = ["<div class='ad'>{}</div>", "<div class='box share-bar'>{}</div>", "<section id='comments'><p>{}</p></section>", "<div class='cookie-notice'>{}</div>", "<div role='navigation'>{}</div>", "<nav><p>{}</p></nav>"]
    for tag in ("article", "main"):
        body = "".join(x.format(f"kept {i}") for i, x in enumerate(kept)) + "".join(x.format(f"gone {i}") for i, x in enumerate(gone)) + "<p>end</p>"
        texts, kinds, _ = html_extract.page_lines(PAGE.format(f"<{tag}>{body}</{tag}>"))
        assert [t for t, k in zip(texts, kinds, strict=True) if k == html_extract.TEXT] == [*(f"kept {i}" for i in range(len(kept))), "end"]
    texts, kinds, _ = html_extract.page_lines("<div id='menu'><p>a</p></div><div><p>b</p></div>")
    assert kinds == [html_extract.FURNITURE, html_extract.UNDECIDED]


class Reader(HTMLParser):
    """An independent extractor for pages that declare their article: blocks of text within it, menus and the like left out."""

    OUT = {"nav", "header", "footer", "aside", "form", "script", "style", "noscript", "template", "title", "textarea", "svg", "iframe", "select", "button", "menu", "dialog"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.text, self.inside, self.out = [], "", 0, []

    def end(self):
        if t := " ".join(self.text.split()):
            self.blocks.append(t)
        self.text = ""

    def handle_starttag(self, tag, attrs):
        if tag in html_extract._BLOCK:
            self.end()
        if tag in ("article", "main"):
            self.inside += 1
        said = " ".join(v or "" for k, v in attrs if k in ("class", "id"))
        if tag not in html_extract._VOID and (self.out or tag in self.OUT or re.search(r"\b(ad|ads|comments)\b", said)):
            self.out.append(tag)

    def handle_endtag(self, tag):
        if tag in html_extract._BLOCK:
            self.end()
        if tag in ("article", "main"):
            self.inside -= 1
        if tag in self.out:
            while self.out.pop() != tag:
                pass

    def handle_data(self, data):
        if self.inside and not self.out:
            self.text += data


def test_html_extraction_against_an_independent_reader(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in html_extract.extraction_report(pages).collect()}
    for r in pages.collect():
        reader = Reader()
        reader.feed(r.html or "")
        reader.close()
        reader.end()
        assert got[r.page_id] == "\n".join(reader.blocks), r.page_id


def test_html_differencing_decides_without_telling_tags(spark):
    """Boxes without a telling tag or class: what neighbours share goes, and so does what varies in the same box."""
    page = "<div><div class='x1'><p>Our site</p><p>Contact us</p><p>All topics</p><p>Terms of use</p><p>Visits today</p><p>Visitor {n}</p></div><div class='x2'><p>Story {n} begins with a sentence of its own, {w}.</p><p>And it goes on about {w} for quite some time, {n} words.</p></div></div>"
    inside = "<article><h1>Piece {n}</h1><p>Text of piece {n} is all about {w} and not much else.</p><p>As they say.</p><div class='q7'><p>Tell a friend</p><p>Print this</p><p>Send it on</p><p>Save for later</p><p>Read {n} times</p></div></article>"
    rows = [(i, f"http://{h}/a/{i:02}", body.format(n=i, w=f"w{i * 7919 % 101}")) for h, body in (("plain.org", page), ("art.org", inside)) for i in range(12)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = {r.url: r.text for r in html_extract.extract(df).collect()}
    off = {r.url: r.text for r in html_extract.extract(df, differencing=False).collect()}
    for i, url, _ in rows:
        w = f"w{i * 7919 % 101}"
        if "plain" in url:
            assert got[url] == f"Story {i} begins with a sentence of its own, {w}.\nAnd it goes on about {w} for quite some time, {i} words."
            assert "Our site" in off[url] and f"Visitor {i}" in off[url]
        else:  # a shared line of the article stays, a box that all pages have goes
            assert got[url] == f"Piece {i}\nText of piece {i} is all about {w} and not much else.\nAs they say."
            assert "Tell a friend" in off[url]


def test_html_of_any_size_and_repeated_rows(spark):
    n = 40_000
    odd = ["<li>same" * n, "<a '" * n, "<a x='" * n, "<svg><p>x" * n, "<div class=ad>" * n + "y", "</x>" * n + "<div>" * n + "z" + "</p>" * n, "<nav><main>" * n, "<!--" * n, "<p>a<p>b" * n, "&#" + "9" * 10_000 + ";", "<script>" * n, "< " * n, "<p>" + "word " * 200_000]
    for page in odd:
        began = time.perf_counter()
        html_extract.main_text(page, [], [])
        assert time.perf_counter() - began < 3, page[:20]
    a, b = np.arange(n, dtype=np.uint64) % 2, (np.arange(n, dtype=np.uint64) // 3) % 2
    began = time.perf_counter()
    assert len(html_extract.shared_lines(a, a)) == n and len(html_extract.shared_lines(np.zeros(n, np.uint64), np.zeros(n - 9, np.uint64))) == n - 9
    found = html_extract.shared_lines(a[:8000], b[:9000])
    assert time.perf_counter() - began < 10 and found == sorted(set(found))
    rows = [(i % 3, "http://h/x", "<p>Repeated page with text</p>", 1, "p") for i in range(60)] + [(9, "http://h/y", odd[0][:100_000], 2, "q"), (10, "http://h/z", None, 3, None)]
    got = html_extract.extraction_report(spark.createDataFrame(rows, "page_id long, url string, html string, host int, path string").repartition(5)).collect()
    assert Counter(r.text for r in got)["Repeated page with text"] == 60 and len(got) == len(rows)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=40), st.lists(st.integers(0, 4), max_size=40))
def test_longest_common_subsequence(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    got = html_extract.shared_lines(np.array(a, np.uint64), np.array(b, np.uint64))
    assert len(got) == table[-1][-1] and got == sorted(set(got))
    halves: list[int] = []
    html_extract._many_matches(a, b, 0, halves)
    assert len(halves) == table[-1][-1] and html_extract._row(a, b)[-1] == table[-1][-1]
    for found in (got, halves):  # a subsequence of b
        rest = iter(b)
        assert all(any(x == y for y in rest) for x in (a[i] for i in found))


def test_components(spark):
    edges = [(5, 4), (4, 3), (9, 8), (7, 7), *((i, i + 1) for i in range(100, 160))]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {5: 3, 4: 3, 9: 8, **{i: 100 for i in range(101, 161)}}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame(ROWS, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(LONG.split()[500:530]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    d = spark.read.parquet(f"{tmp_path}/documents.parquet")
    counts = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        d = stage(spark, d, str(tmp_path))
        assert d.columns == SCHEMA.replace(" long", "").replace(" string", "").replace(" int", "").split(", ")
        counts.append(d.count())
    assert counts[0] == len(ROWS) - 4 and counts[1] == len({squash(r[1]) for r in ROWS if r[0] not in (4, 5, 6, 14)})
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.count() > 0 and "sequence_id" in got.columns


def without_phrases(text, items, width=10):
    """The text with every word inside an occurrence of an item's window cut out, from the first word of a span to its last."""
    phrases = {tuple(w[i : i + width]) for w in map(plain, items) for i in range(max(1, len(w) - width + 1) if w else 0)}
    found = [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]
    w = plain(text)
    hit = [False] * len(w)
    for n in {len(p) for p in phrases}:
        for i in range(len(w) - n + 1):
            if tuple(w[i : i + n]) in phrases:
                hit[i : i + n] = [True] * n
    if not any(hit):
        return text
    if all(hit):
        return None
    parts, at, i = [], 0, 0
    while i < len(w):
        if not hit[i]:
            i += 1
            continue
        j = i
        while j < len(w) and hit[j]:
            j += 1
        parts.append(text[at : found[i][0]])
        at, i = found[j - 1][1], j
    parts.append(text[at:])
    return " ".join(x.strip(" ") for x in parts)


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    items = [" ".join(LONG.split()[500:530]), "Un deux trois é à la maison", "one two", PROSE[40:110]]
    spark.createDataFrame(ROWS, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    lettered = [r for r in ROWS if any(ch.isalpha() for ch in r[1] or "")]
    exact = {}
    for r in lettered:
        k, best = squash(r[1]), lambda x: (-len(x[1]), x[0] is None, x[0] or 0)
        exact[k] = min(exact.get(k, r), r, key=best)
    rows = list(exact.values())
    _, root = brute_components([r[1] for r in rows], 5, 80)
    near = {}
    for k, r in zip(root, rows, strict=True):
        near[k] = min(near.get(k, r), r, key=lambda x: (x[0] is None, x[0] or 0))
    cut = [(r[0], without_phrases(r[1], items)) for r in near.values()]
    cut = [(i, t) for i, t in cut if t is not None]
    d = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for (_, stage), want in zip(corpus_pipeline.STAGES, ([(r[0], r[1]) for r in lettered], [(r[0], r[1]) for r in rows], [(r[0], r[1]) for r in near.values()], cut), strict=False):
        d = stage(spark, d, str(tmp_path))
        assert Counter((r.doc_id, r.text) for r in d.collect()) == Counter(want)
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokens = Counter()
    for i, text in cut:
        tokens[i] += len(t.encode(text, add_special_tokens=False).ids) + 1
    got = Counter()
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got[r.doc_id] += r.length
    assert got == tokens


def test_pipeline_without_rows(spark, none, tmp_path):
    import corpus_pipeline

    none.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
