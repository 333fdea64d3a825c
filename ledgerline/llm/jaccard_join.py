"""Exact n-gram Jaccard self-join: size-banded tiles, hashed bitmap signatures, sorted-array intersection.

Texts with the same set of shingles form one class; the join runs between classes. Two sets with a Jaccard
similarity of at least t share one of the first |x| - ceil(t |x|) + 1 shingles of each, in any one order of all
shingles, and differ in size by a factor t at most. So:

1. A fixed-size table of counters, summed over all texts, says which shingles are common; the order puts rarer
   ones first, so that passages that many texts share do not make candidates.
2. Each class posts its prefix shingles. A posting stays only if another class with a size that fits posted it too.
3. Postings of one shingle in one size band form a tile; a posting goes to the next band's tile as a visitor when
   a class there fits. In a tile, every pair's overlap is bounded from above by the bits that one bitmap signature
   has and the other has not. What is left is told as a spanning forest, not as pairs.
4. The forests' connected components are clusters outside of which no link can be. Each cluster's sets are
   compared in one task (a large cluster in several: every two of its chunks): again the bitmap bound, then exact
   intersection of the sorted shingle arrays; pairs that are already connected are passed over.
5. The links' connected components are the result.

Defined results: A-Z is lower-cased; a text of fewer words than a shingle has is one shingle of them all; null
texts and texts without words have an empty set and are linked with nothing, not even each other; of equal rows
each gets its row; a component's id is its smallest doc_id that is not null, or null if it has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of, written
from .components import components
from .textnum import SPACE_WORDS_LOWER, Words, mix, window_hash, words

SHINGLE = 4
PERCENT = 85
#: Counters of the frequency table: 2**COUNTER_BITS.
COUNTER_BITS = 20
COUNTER_PARTS = 64
#: Bits of a signature.
SIGNATURE = 1024
#: Tiles of so many rows at most are done all at once; those of large sets tell pairs up to LARGE_TILE rows.
SMALL_TILE = 8
LARGE_TILE = 256
#: Pairs that a task remembers having told; beyond that some are told again, which changes nothing.
MOST_TOLD = 1_000_000
#: Most classes and shingles of a chunk of a cluster.
CHUNK_CLASSES = 2_000
CHUNK_SHINGLES = 2_000_000

_U = np.uint64


def shingles(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of all shingles of a slice; repeated ones repeat."""
    h, at = w.windows(n)
    of = w.text_of_word()[at]
    short = np.flatnonzero((w.counts() > 0) & (w.counts() < n))
    if len(short):
        own = np.array([window_hash(w.hash[w.first[i] : w.first[i + 1]]) for i in short.tolist()], _U)
        h, of = np.concatenate([h, own]), np.concatenate([of, short])
    return h, of


def ordered_sets(w: Words, n: int, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of all texts, text by text, each text's in the common order; and the bounds of the texts."""
    h, of = shingles(w, n)
    level = levels[(h >> _U(64 - COUNTER_BITS)).astype(np.int64)].astype(_U)
    by_rank = np.argsort(level << _U(60) | h >> _U(4))
    if w.n_texts > 1:
        by_rank = by_rank[np.argsort(of[by_rank].astype(np.uint16 if w.n_texts < 1 << 16 else np.int64), kind="stable")]
    h, of = h[by_rank], of[by_rank]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    h, of = h[keep], of[keep]
    return h, np.concatenate([[0], np.cumsum(np.bincount(of, minlength=w.n_texts))])


def _sums(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, _U), np.cumsum(x)])
    return total[bounds[1:]] - total[bounds[:-1]]


def digests(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit digests of each set."""
    size = np.diff(bounds).astype(_U)
    return mix(_sums(mix(h * _U(0x9E3779B97F4A7C15)), bounds) + size).view(np.int64), mix(_sums(mix(h ^ _U(0xC2B2AE3D27D4EB4F)), bounds) + size).view(np.int64)


def signatures(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """SIGNATURE hashed bits of each set, packed in bytes."""
    n = len(bounds) - 1
    bits = np.zeros(n * SIGNATURE, bool)
    bits[np.repeat(np.arange(n), np.diff(bounds)) * SIGNATURE + ((h >> _U(7)) % _U(SIGNATURE)).astype(np.int64)] = True
    return np.packbits(bits.reshape(n, SIGNATURE), axis=1)


def wide_signature(h: np.ndarray) -> bytes:
    """At least twice as many hashed bits as shingles, a power of two; widths fold into each other."""
    n = 1 << (2 * len(h) - 1).bit_length()
    bits = np.zeros(n, bool)
    bits[((h >> _U(7)) % _U(n)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def folded(bits: np.ndarray, n: int) -> np.ndarray:
    """A signature at a smaller width of n 64-bit words."""
    return np.bitwise_or.reduce(bits.reshape(-1, n), axis=0)


def frequency_levels(rows: DataFrame, n: int) -> np.ndarray:
    """Level of each counter: 0 up to what chance explains, then one more for every doubling of what exceeds the mean."""
    part = (1 << COUNTER_BITS) // COUNTER_PARTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << COUNTER_BITS, np.int64)
        for b in batches:
            for w in words(b["text"], SPACE_WORDS_LOWER):
                total += np.bincount((shingles(w, n)[0] >> _U(64 - COUNTER_BITS)).astype(np.int64), minlength=len(total))
        if total.any():
            kind = np.min_scalar_type(int(total.max()))
            yield pa.RecordBatch.from_arrays([pa.array(range(COUNTER_PARTS), pa.int32()), pa.array([str(kind)] * COUNTER_PARTS), pa.array([x.astype(kind).tobytes() for x in total.reshape(-1, part)], pa.binary())], ["part", "kind", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for p, kind, x in zip(b["part"].to_pylist(), b["kind"].to_pylist(), b["counts"].to_pylist(), strict=True):
                total[p] = total.get(p, 0) + np.frombuffer(x, kind).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["part", "counts"])

    summed = rows.mapInArrow(count, "part int, kind string, counts binary").repartition(COUNTER_PARTS, "part").mapInArrow(add, "part int, counts binary")
    out = np.zeros((COUNTER_PARTS, part), np.int64)
    for p, x in summed.collect():  # COUNTER_PARTS rows, 2**COUNTER_BITS numbers, at every size of the input
        out[p] = np.frombuffer(x, np.int64)
    counts = out.ravel()
    least = max(32.0, 6 * counts.mean() ** 0.5)  # shingles that share a counter by chance add up to its mean, give or take
    return np.clip(np.floor(np.log2(np.maximum(counts - counts.mean(), 1) / least)) + 1, 0, 15).astype(np.uint8)


def prefix_size(size: np.ndarray, percent: int) -> np.ndarray:
    return size - (percent * size + 99) // 100 + 1


def prepared(rows: DataFrame, n: int, percent: int, levels: np.ndarray) -> DataFrame:
    """One row a text: id, th, size, c1, c2 (the class), and for a class's first text in its task its keys and signature."""
    shared = rows.sparkSession.sparkContext.broadcast(levels)  # 2**COUNTER_BITS bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for b in batches:
            for w in words(b["text"], SPACE_WORDS_LOWER):
                h, bounds = ordered_sets(w, n, shared.value)
                size = np.diff(bounds)
                c1, c2 = digests(h, bounds)
                bits = signatures(h, bounds)
                fresh = np.zeros(w.n_texts, bool)
                for i, c in enumerate(zip(c1.tolist(), c2.tolist(), strict=True)):
                    if size[i] and c not in seen:
                        seen.add(c)
                        fresh[i] = True
                many = np.where(fresh, prefix_size(size, percent), 0)
                ends = np.cumsum(many)
                keys = h[np.arange(int(ends[-1])) - np.repeat(ends - many, many) + np.repeat(bounds[:-1], many)].view(np.int64)
                part = b.slice(w.row0, w.n_texts)
                yield pa.RecordBatch.from_arrays(
                    [part["id"], part["th"], pa.array(size), pa.array(c1), pa.array(c2), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(keys)), pa.array([bits[i].tobytes() if f else None for i, f in enumerate(fresh)], pa.binary()),
                     pa.array([wide_signature(h[bounds[i] : bounds[i + 1]]) if f and size[i] > SIGNATURE else None for i, f in enumerate(fresh)], pa.binary())],
                    ["id", "th", "size", "c1", "c2", "keys", "bits", "wide"],
                )

    kind = rows.schema["id"].dataType.simpleString()
    return written(rows.mapInArrow(run, f"id {kind}, th long, size long, c1 long, c2 long, keys array<long>, bits binary, wide binary"), "jaccard-sets")


def _band(size: np.ndarray, percent: int) -> np.ndarray:
    return np.floor(np.log(size) / np.log(100 / percent) + 1e-9).astype(np.int32)


def surviving(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key, size downwards, c1: postings whose size fits a neighbour's; as home, and as visitor of the
    next band where a class there fits. Holds two rows and a band's end from batch to batch."""
    held = {c: np.zeros(0, np.int64) for c in ("key", "size", "c1")}
    decided = 0  # rows at the start of held that are there as neighbours only
    above = (0, -9, 0)  # key, band and smallest size of the run before held

    def judge(x: dict[str, np.ndarray], last: bool) -> pa.RecordBatch | None:
        nonlocal held, decided, above
        n = len(x["key"])
        if not n:
            return None
        same = x["key"][1:] == x["key"][:-1]
        fit = same & (100 * x["size"][1:] >= percent * x["size"][:-1])
        live = np.zeros(n, bool)
        live[1:] |= fit
        live[:-1] |= fit
        band = _band(x["size"], percent)
        new = np.ones(n, bool)
        new[1:] = ~same | (band[1:] != band[:-1])
        at = np.flatnonzero(new)
        least = np.zeros(n, np.int64)  # smallest size of the next band's run of the same key, or 0
        before = at[1:] - 1
        ok = (x["key"][before] == x["key"][at[1:]]) & (band[before] == band[at[1:]] + 1)
        run_least = np.concatenate([[above[2] if (x["key"][0], band[0] + 1) == above[:2] else 0], np.where(ok, x["size"][before], 0)])
        least = run_least[np.cumsum(new) - 1]
        end = n if last else n - 1
        own = np.arange(decided, end)
        own = own[live[own]]
        visit = own[(least[own] > 0) & (100 * x["size"][own] >= percent * least[own])]
        keep = max(0, n - 2)
        if not last:
            run = at[np.searchsorted(at, keep, "right") - 1]  # the run that row keep is in
            if run == 0:
                pass
            elif (x["key"][run - 1], band[run - 1]) == (x["key"][run], band[run] + 1):
                above = (int(x["key"][run - 1]), int(band[run - 1]), int(x["size"][run - 1]))
            else:
                above = (0, -9, 0)
            held = {c: v[keep:] for c, v in x.items()}
            decided = n - 1 - keep
        row = np.concatenate([own, visit])
        home = np.arange(len(row)) < len(own)
        return pa.RecordBatch.from_arrays([pa.array(x["key"][row]), pa.array(band[row] + ~home), pa.array(home), pa.array(x["size"][row]), pa.array(x["c1"][row])], ["key", "band", "home", "size", "c1"])

    for b in batches:
        x = {c: np.concatenate([held[c], b[c].to_numpy()]) for c in held}
        new = np.ones(len(x["key"]), bool)  # copies of a class from several tasks
        new[1:] = (x["key"][1:] != x["key"][:-1]) | (x["size"][1:] != x["size"][:-1]) | (x["c1"][1:] != x["c1"][:-1])
        if (out := judge({c: v[new] for c, v in x.items()}, False)) is not None:
            yield out
    if (out := judge(held, True)) is not None:
        yield out


class Forest:
    """The components of 0..n-1, as an array of roots: a member's root is its component's smallest member."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: int, b: int) -> bool:
        a, b = int(self.root[a]), int(self.root[b])
        if a == b:
            return False
        self.root[self.root == max(a, b)] = min(a, b)
        return True


def may_link(size_a, bits_a: np.ndarray, size_b, bits_b: np.ndarray, percent: int) -> np.ndarray:
    """Whether the bound on the overlap lets the pairs reach the threshold. bits: 64-bit words, one row a set."""
    most = np.minimum(size_a - np.bitwise_count(bits_a & ~bits_b).sum(-1, dtype=np.int64), size_b - np.bitwise_count(bits_b & ~bits_a).sum(-1, dtype=np.int64))
    return 100 * most >= percent * (size_a + size_b - most)


def tile_forest(size: np.ndarray, bits: np.ndarray, home: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Spanning forest of the pairs of one tile that may link; rows are sorted by size.

    A row meets the smallest row of each component and its neighbour first, and then only rows that it is not connected
    with yet: a tile of near copies, however many, costs one comparison a row and component.
    """
    n = len(size)
    forest, out = Forest(n), []
    low = np.searchsorted(100 * size, percent * size)

    def meet(i: np.ndarray, j: int) -> None:
        i = i[home[i] | home[j]]
        i = i[may_link(size[i], bits[i], size[j], bits[j], percent)]
        for a in i.tolist():
            if forest.join(a, j):
                out.append((a, j))

    for j in range(1, n):
        i = np.arange(low[j], j)
        meet(i[(forest.root[i] == i) | (i == j - 1)], j)
        rest = i[forest.root[i] != forest.root[j]]
        if len(rest):
            meet(rest, j)
    return out


def candidate_edges(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key, band and size: u, v (classes) of each tile's forest, or pairs; check: whether a pair of
    large sets is left to their wide signatures."""
    held: pa.Table | None = None
    told: set[int] = set()  # pairs that this task has told; they share many shingles

    def judge(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        key, band, size, c1 = (t[c].to_numpy() for c in ("key", "band", "size", "c1"))
        home = t["home"].to_numpy(zero_copy_only=False)
        bits = np.frombuffer(b"".join(t["bits"].to_pylist()), np.uint64).reshape(len(key), -1)
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (band[1:] != band[:-1])
        tile = np.cumsum(new) - 1
        start = np.append(np.flatnonzero(new), len(key))
        small = np.diff(start) <= SMALL_TILE
        pairs = [np.zeros((0, 2), np.int64)]
        for k in range(1, SMALL_TILE):
            i = np.flatnonzero((tile[k:] == tile[:-k]) & small[tile[k:]])
            i = i[(home[i] | home[i + k]) & (100 * size[i] >= percent * size[i + k])]
            i = i[may_link(size[i], bits[i], size[i + k], bits[i + k], percent)]
            pairs.append(np.column_stack([i, i + k]))
        i, j = np.concatenate(pairs).T
        check = [np.minimum(size[i], size[j]) > SIGNATURE]
        for x in np.flatnonzero(~small).tolist():
            a, b = start[x], start[x + 1]
            if size[a] > SIGNATURE and b - a <= LARGE_TILE:
                i, j = np.triu_indices(b - a, 1)
                ok = (home[a + i] | home[a + j]) & (100 * size[a + i] >= percent * size[a + j])
                i, j = i[ok] + a, j[ok] + a
                ok = may_link(size[i], bits[i], size[j], bits[j], percent)
                pairs.append(np.column_stack([i[ok], j[ok]]))
                check.append(np.ones(int(ok.sum()), bool))
            elif found := tile_forest(size[a:b], bits[a:b], home[a:b], percent):
                pairs.append(np.array(found, np.int64) + a)
                check.append(np.zeros(len(found), bool))
        u, v = c1[np.concatenate(pairs)].T
        edge = np.unique(np.column_stack([np.maximum(u, v), np.minimum(u, v), np.concatenate(check)]), axis=0)
        mark = mix(mix(edge[:, 0].astype(_U)) + edge[:, 1].astype(_U) + edge[:, 2].astype(_U)).tolist() if len(edge) else []
        edge = edge[[m not in told for m in mark]] if told else edge
        if len(told) < MOST_TOLD:
            told.update(mark)
        return pa.RecordBatch.from_arrays([pa.array(edge[:, 0]), pa.array(edge[:, 1]), pa.array(edge[:, 2] == 1)], ["u", "v", "check"])

    for b in batches:
        t = pa.Table.from_batches([b])
        t = t if held is None else pa.concat_tables([held, t])
        if not len(t):
            continue
        key, band = t["key"].to_numpy(), t["band"].to_numpy()
        cut = int(np.flatnonzero((key != key[-1]) | (band != band[-1]))[-1]) + 1 if (key[0], band[0]) != (key[-1], band[-1]) else 0
        if cut:
            yield judge(t.slice(0, cut))
        held = t.slice(cut)
    if held is not None and len(held):
        yield judge(held)


def wide_check(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """u, v of those pairs of large sets that their wide signatures leave."""
    for b in batches:
        keep = []
        for su, sv, x, y in zip(*(b[c].to_pylist() for c in ("su", "sv", "wu", "wv")), strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            n = min(len(x), len(y))
            keep.append(bool(may_link(su, folded(x, n), sv, folded(y, n), percent)))
        yield b.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))


def linked(batches: Iterator[pa.RecordBatch], n: int, percent: int, levels: np.ndarray, clash: frozenset[int] = frozenset()) -> Iterator[pa.RecordBatch]:
    """Rows sorted by tile (text, chunk, low, high): u, v of a spanning forest of the links in each tile."""
    held: list[tuple] = []

    def judge() -> pa.RecordBatch:
        low, high = held[0][1:3]
        column = pa.array([r[4] for r in held], pa.large_string())
        sets, chunk, c1, seen = [], [], [], set()
        for w in words(column, SPACE_WORDS_LOWER):
            h, bounds = ordered_sets(w, n, levels)
            a, b = digests(h, bounds)
            for i, c in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
                if c not in seen:
                    seen.add(c)
                    sets.append(np.sort(h[bounds[i] : bounds[i + 1]]))
                    chunk.append(held[w.row0 + i][3])
                    c1.append(c[1] if c[0] in clash else c[0])
        size = np.array([len(s) for s in sets])
        order = np.argsort(size, kind="stable")
        size, sets, chunk, c1 = size[order], [sets[i] for i in order], np.array(chunk)[order], np.array(c1, np.int64)[order]
        bits = signatures(np.concatenate(sets), np.concatenate([[0], np.cumsum(size)])).view(np.uint64)
        least = np.searchsorted(100 * size, percent * size)
        forest, u, v = Forest(len(sets)), [], []
        for j in range(1, len(sets)):
            i = np.arange(least[j], j)
            if low != high:
                i = i[chunk[i] != chunk[j]]
            i = i[forest.root[i] != forest.root[j]]
            i = i[may_link(size[i], bits[i], size[j], bits[j], percent)]
            for a in i[::-1].tolist():
                if forest.root[a] == forest.root[j]:
                    continue
                x, y = sets[a], sets[j]
                common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                if 100 * common >= percent * (len(x) + len(y) - common):
                    forest.join(a, j)
                    u.append(int(c1[a]))
                    v.append(int(c1[j]))
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    for b in batches:
        for row in zip(*(b[c].to_pylist() for c in ("root", "low", "high", "chunk", "text")), strict=True):
            if held and held[0][:3] != row[:3]:
                yield judge()
                held.clear()
            held.append(row)
    if held:
        yield judge()


def clashes(sets: DataFrame) -> frozenset[int]:
    """First digests that two different sets share: n * n / 2**65 of n sets are expected, none but beyond 10**9."""
    two = sets.filter("size > 0").groupBy("c1").agg((F.min("c2") != F.max("c2")).alias("two")).filter("two")
    return frozenset(r.c1 for r in two.select("c1").toLocalIterator())


def named(sets: DataFrame, clash: frozenset[int]) -> DataFrame:
    """A class is named by its first digest, where that clashes by its second one."""
    return sets.withColumn("c1", F.when(F.col("c1").isin(*clash), F.col("c2")).otherwise(F.col("c1"))) if clash else sets


def similarity_classes(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, th (hash of its text), n_shingles, component (of its class; null for an empty set)."""
    text = text_of(docs, text_col)
    rows = docs.select(docs[id_col].alias("id"), text.alias("text"), F.xxhash64(text).alias("th"))
    levels = frequency_levels(rows.select("text"), n)
    sets = prepared(rows, n, percent, levels)
    sets = named(sets, clash := clashes(sets))
    postings = sets.select(F.explode("keys").alias("key"), "size", "c1").repartition("key").sortWithinPartitions("key", F.desc("size"), "c1")
    left = postings.mapInArrow(lambda it: surviving(it, percent), "key long, band int, home boolean, size long, c1 long")
    bits = sets.filter("bits IS NOT NULL").groupBy("c1").agg(F.first("bits").alias("bits"))
    tiles = left.join(bits, "c1").repartition("key", "band").sortWithinPartitions("key", "band", "size", "c1")
    pairs = written(tiles.mapInArrow(lambda it: candidate_edges(it, percent), "u long, v long, check boolean").distinct(), "jaccard-pairs")
    wide = sets.filter("wide IS NOT NULL").groupBy("c1").agg(F.first("wide").alias("w"), F.first("size").alias("s"))
    of = lambda x: wide.select(F.col("c1").alias(x), F.col("w").alias(f"w{x}"), F.col("s").alias(f"s{x}"))
    large = pairs.filter("check").join(of("u"), "u").join(of("v"), "v").mapInArrow(lambda it: wide_check(it, percent), "u long, v long")
    clusters = components(pairs.filter("NOT check").select("u", "v").unionAll(large))
    # each class of a cluster with one of its texts
    member = clusters.unionAll(clusters.select(F.col("root").alias("node"), "root").distinct())
    text_key = sets.filter("bits IS NOT NULL").groupBy("c1").agg(F.min(F.struct("id", "th")).alias("one"), F.first("size").alias("size"))
    member = member.join(text_key, member.node == text_key.c1).select("root", "size", F.col("one.id").alias("id"), F.col("one.th").alias("th"), F.col("node"))
    chunks = member.groupBy("root").agg(F.greatest(F.ceil(F.count(F.lit(1)) / CHUNK_CLASSES), F.ceil(F.sum("size") / CHUNK_SHINGLES)).cast("int").alias("n_chunks"))
    member = member.join(chunks, "root").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("n_chunks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1))
    wanted = written(member.select("*", other.alias("other")).select("id", "th", "root", "chunk", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high")), "jaccard-clusters")
    # by merging at every size, never by sending `wanted`, which grows with the input
    texts = rows.join(wanted.hint("merge"), rows["id"].eqNullSafe(wanted["id"]) & (rows["th"] == wanted["th"])).select("root", "low", "high", "chunk", "text")
    texts = texts.repartition("root", "low", "high").sortWithinPartitions("root", "low", "high")
    shared = levels
    edges = texts.mapInArrow(lambda it: linked(it, n, percent, shared, clash), "u long, v long")
    found = components(edges)
    return sets.join(found, sets.c1 == found.node, "left").select("id", "th", F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.coalesce("root", "c1")).alias("component"))


def jaccard_report(docs: DataFrame) -> DataFrame:
    """The contract's rows: doc_id, n_shingles, component_id."""
    found = written(similarity_classes(docs), "jaccard-classes")
    # written, so that Spark may split a component with many documents when it joins
    least = written(found.filter("component IS NOT NULL").groupBy("component").agg(F.min("id").alias("least")), "jaccard-least")
    return found.join(least, "component", "left").select(F.col("id").alias("doc_id"), "n_shingles", F.when(F.col("component").isNull(), F.col("id")).otherwise(F.col("least")).alias("component_id"))


def drop_near_duplicates(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of every component: that with the smallest id (null last), then text hash; empty sets
    all stay. All columns as they were; of rows with one id and text the one with the least
    hash of the whole row stays."""
    found = written(similarity_classes(docs, n, percent, id_col, text_col), "jaccard-classes")
    best = F.min(F.struct(F.col("id").isNull(), "id", "th")).alias("best")
    stay = found.filter("component IS NOT NULL").groupBy("component").agg(best).select(F.col("best.id").alias("__id"), F.col("best.th").alias("__th"), F.col("component").alias("__component"))
    ties = found.filter("component IS NOT NULL").groupBy(F.col("id").alias("__id"), F.col("th").alias("__th")).agg((F.count(F.lit(1)) > 1).alias("__tied"))
    same = lambda a, b: a["__id"].eqNullSafe(b["__id"]) & (a["__th"] == b["__th"])
    stay = stay.join(ties, same(stay, ties)).select(stay["__id"], stay["__th"], "__component", "__tied")
    empty = found.filter("component IS NULL").select(F.col("id").alias("__id"), F.col("th").alias("__th"), F.lit(None).cast("long").alias("__component"), F.lit(False).alias("__tied")).distinct()
    stay = stay.unionAll(empty)
    full = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("__doc"), docs[id_col].alias("__id"), F.xxhash64(text_of(docs, text_col)).alias("__th"))
    kept = full.join(stay, same(full, stay)).select("__doc", "__component", "__tied")
    one = kept.filter(~F.col("__tied")).select("__doc")
    many = kept.filter("__tied").groupBy("__component").agg(F.min_by("__doc", F.xxhash64("__doc")).alias("__doc")).select("__doc")
    return one.unionAll(many).select("__doc.*")
