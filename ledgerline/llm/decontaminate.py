"""Benchmark decontamination with an FM-index for every shard of the training texts.

A window is `width` consecutive words of a benchmark item (a shorter item is one window). The windows are the
test phrases. Each task takes its texts shard by shard (SHARD_BYTES of text): words become numbers in the
phrases' vocabulary, the stretches that can hold a phrase at all (each word and each pair of neighbours occurs
in some phrase) are laid end to end, and over these the FM-index is built: suffix order, Burrows-Wheeler
transform, and a wavelet matrix for ranks. All phrases are searched backwards at once; the occurrences'
places are found by walking to the next sampled suffix position; the spans they cover are merged.

The benchmark is the query set: it is read in blocks of BLOCK_BYTES of text, and PASS_BLOCKS of them at a time are
sent to the tasks and searched in all texts, so that neither the driver nor a task ever holds more of it. A pass
writes the spans and items it found, by row, and frees its blocks; the passes' finds are merged in the end. A 64-bit
word hash finds vocabulary words; every word of a stretch is then confirmed on its bytes.

Defined results: null and empty texts have no words, hence no windows and no hits; an item without words is
never found; equal items are found together; an item id may be null and then counts as the text ''; an empty
benchmark leaves all documents clean. Rows that repeat are judged one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_of, written
from .textnum import PLAIN_WORDS, Words, words

WIDTH = 10
SHARD_BYTES = 2_000_000
BLOCK_BYTES = 2_000_000
PASS_BLOCKS = 4
#: Every so many positions of the indexed stretches have their suffix's place stored.
SAMPLE = 8


class WaveletMatrix:
    """rank(symbol, i): how often symbol stands before place i, for many symbols and places at once."""

    def __init__(self, seq: np.ndarray, top: int):
        self.levels = max(1, int(top).bit_length())
        self.ones, self.zeros = [], []
        for bit in reversed(range(self.levels)):
            b = (seq >> bit & 1).astype(bool)
            self.ones.append(np.concatenate([[0], np.cumsum(b)]))
            self.zeros.append(len(seq) - int(b.sum()))
            seq = np.concatenate([seq[~b], seq[b]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        lo = np.zeros_like(i)
        for level, bit in enumerate(reversed(range(self.levels))):
            one, zeros = self.ones[level], self.zeros[level]
            up = (symbol >> bit & 1).astype(bool)
            a, b = one[lo], one[i]
            lo, i = np.where(up, zeros + a, lo - a), np.where(up, zeros + b, i - b)
        return i - lo

    def at(self, i: np.ndarray) -> np.ndarray:
        """The symbols at places i."""
        out = np.zeros_like(i)
        for level in range(self.levels):
            one, zeros = self.ones[level], self.zeros[level]
            a = one[i]
            bit = one[i + 1] - a
            out = out << 1 | bit
            i = np.where(bit == 1, zeros + a, i - a)
        return out


def suffix_order(seq: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; a shorter suffix goes before a longer one that it begins."""
    n = len(seq)
    rank = seq.astype(np.int64)
    k = 1
    while True:
        key = rank * (int(rank.max(initial=0)) + 2)
        key[: n - k] += rank[k:] + 1
        order = np.argsort(key, kind="stable")
        s = key[order]
        fresh = np.concatenate([[0], np.cumsum(s[1:] != s[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        if k >= n or fresh[-1] == n - 1:
            return order
        k *= 2


class FMIndex:
    """Over a sequence of symbols 0..top, of which 0 stands at its end and nowhere else."""

    def __init__(self, seq: np.ndarray, top: int):
        sa = suffix_order(seq)
        bwt = seq[sa - 1]
        self.n = len(seq)
        self.ranks = WaveletMatrix(bwt, top)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=top + 1))])
        self.sampled = sa % SAMPLE == 0
        self.sampled_before = np.concatenate([[0], np.cumsum(self.sampled)])
        self.samples = sa[self.sampled]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges [lo, hi) of suffixes that begin with each row of phrases (all of one length)."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for j in reversed(range(phrases.shape[1])):
            c = phrases[live, j]
            lo[live] = self.before[c] + self.ranks.rank(c, lo[live])
            hi[live] = self.before[c] + self.ranks.rank(c, hi[live])
            live = live[lo[live] < hi[live]]
        hi[np.setdiff1d(np.arange(len(phrases)), live)] = 0
        return lo, np.maximum(lo, hi)

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Place in the sequence of the suffix in each row of the order."""
        out, row = np.zeros(len(row), np.int64), row.copy()
        left = np.arange(len(row))
        steps = 0
        while len(left):
            r = row[left]
            hit = self.sampled[r]
            out[left[hit]] = self.samples[self.sampled_before[r[hit]]] + steps
            left, r = left[~hit], r[~hit]
            c = self.ranks.at(r)
            row[left] = self.before[c] + self.ranks.rank(c, r)
            steps += 1
        return out


@dataclass
class Phrases:
    """The windows of a block of items: distinct rows of vocabulary numbers by length, and the items of each."""

    words: list[bytes]  # number - 1 -> word
    hashes: np.ndarray  # sorted
    numbers: np.ndarray  # of the sorted hashes
    pairs: np.ndarray  # sorted first * 2**32 + second of neighbours
    by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # length -> rows, bounds of owners, owners
    items: list[str]

    @classmethod
    def of(cls, rows: list[tuple[str, str]], width: int) -> Phrases:
        number: dict[bytes, int] = {}
        hashes: list[int] = []
        items = sorted({i for i, _ in rows})
        place = {x: k for k, x in enumerate(items)}
        owners: dict[tuple[int, ...], set[int]] = {}
        pairs: set[int] = set()
        for w in words(pa.array([t for _, t in rows], pa.large_string()), PLAIN_WORDS):
            raw = lowered(w.data)
            ids = []
            for s, e, h in zip(w.start.tolist(), w.end.tolist(), w.hash.tolist(), strict=True):
                if (x := raw[s:e]) not in number:
                    number[x] = len(number) + 1
                    hashes.append(h)
                ids.append(number[x])
            for t in range(w.n_texts):
                own = ids[w.first[t] : w.first[t + 1]]
                pairs.update(a << 32 | b for a, b in zip(own, own[1:], strict=False))
                for i in range(max(1, len(own) - width + 1) if own else 0):
                    owners.setdefault(tuple(own[i : i + width]), set()).add(place[rows[w.row0 + t][0]])
        order = np.argsort(np.array(hashes, np.uint64), kind="stable")
        by_length = {}
        for n in sorted({len(p) for p in owners}):
            group = [(p, sorted(o)) for p, o in owners.items() if len(p) == n]
            by_length[n] = (np.array([p for p, _ in group], np.int64), np.cumsum([0, *(len(o) for _, o in group)]), np.array([x for _, o in group for x in o], np.int64))
        return cls(list(number), np.array(hashes, np.uint64)[order], order + 1, np.array(sorted(pairs), np.int64), by_length, items)


_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def lowered(data: np.ndarray) -> bytes:
    return data.tobytes().translate(_LOWER)


def _in_sorted(sorted_: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(sorted_, x), max(0, len(sorted_) - 1))
    return (sorted_[at] == x) if len(sorted_) else np.zeros(len(x), bool), at


def numbered(w: Words, p: Phrases, quick: np.ndarray) -> np.ndarray:
    """Vocabulary number of every word, 0 for others; quick: a bit table of the vocabulary's hashes."""
    out = np.zeros(len(w.hash), np.int64)
    maybe = np.flatnonzero(quick[(w.hash & np.uint64(len(quick) - 1)).astype(np.int64)])
    found, at = _in_sorted(p.hashes, w.hash[maybe])
    out[maybe[found]] = p.numbers[at[found]]
    return out


def stretches(num: np.ndarray, text_of_word: np.ndarray, p: Phrases) -> np.ndarray:
    """Places of the words in maximal stretches that may hold a phrase; -1 closes each stretch."""
    n = len(num)
    live = num > 0
    shortest = min(p.by_length)
    if shortest > 1:
        link = np.zeros(n + 1, bool)  # link[i]: words i-1 and i are neighbours in some phrase
        ok = np.flatnonzero(live[:-1] & live[1:] & (text_of_word[:-1] == text_of_word[1:])) + 1 if n else np.zeros(0, np.int64)
        found, _ = _in_sorted(p.pairs, num[ok - 1] << 32 | num[ok])
        link[ok[found]] = True
    else:
        link = np.zeros(n + 1, bool)
        if n:
            link[1:n] = live[:-1] & live[1:] & (text_of_word[:-1] == text_of_word[1:])
    start = np.flatnonzero(live & ~link[:-1]) if n else np.zeros(0, np.int64)
    end = np.flatnonzero(live & ~link[1:]) + 1 if n else np.zeros(0, np.int64)
    long = end - start >= shortest
    start, end = start[long], end[long]
    size = end - start + 1
    total = int(size.sum())
    close = np.cumsum(size) - 1
    place = np.arange(total) + np.repeat(start - (close - size + 1), size)
    place[close] = -1
    return place


def occurrences(w: Words, p: Phrases, quick: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, length, item) of every occurrence in a shard."""
    none = (np.zeros(0, np.int64),) * 3
    if not p.by_length or not len(w.hash):
        return none
    num = numbered(w, p, quick)
    place = stretches(num, w.text_of_word(), p)
    if not len(place):
        return none
    raw = lowered(w.data)
    own = place[place >= 0]
    wrong = [i for i, s, e, k in zip(own.tolist(), w.start[own].tolist(), w.end[own].tolist(), num[own].tolist(), strict=True) if raw[s:e] != p.words[k - 1]]
    num[wrong] = 0  # another word with a vocabulary word's hash
    seq = np.where(place >= 0, num[place], 0) + 1  # 1 closes a stretch, 0 ends the whole
    index = FMIndex(np.append(seq, 0), len(p.words) + 1)
    out = []
    for n, (rows, bounds, owners) in p.by_length.items():
        lo, hi = index.search(rows + 1)
        hits = hi - lo
        which = np.repeat(np.arange(len(rows)), hits)
        if not len(which):
            continue
        row = np.arange(len(which)) - np.repeat(np.cumsum(hits) - hits, hits) + lo[which]
        first = place[index.locate(row)]
        many = np.diff(bounds)[which]
        item = owners[np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(bounds[which], many)]
        out.append((np.repeat(first, many), np.full(len(item), n), item))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else none


def hit_words(w: Words, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Mask of the words inside any occurrence: the spans merged."""
    edge = np.zeros(len(w.hash) + 1, np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, first + length, -1)
    return np.cumsum(edge[:-1]) > 0


def blocks(benchmark: DataFrame, width: int, id_col: str = "item_id", text_col: str = "text") -> Iterator[Phrases]:
    """The benchmark's phrases, BLOCK_BYTES of text at a time; the driver holds one block."""
    rows, size, n = [], 0, 0
    for item, text in benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")), text_of(benchmark, text_col)).toLocalIterator():
        rows.append((item, text))
        size += len(text.encode())
        if size > BLOCK_BYTES:
            yield Phrases.of(rows, width)
            rows, size, n = [], 0, n + 1
    if rows or not n:
        yield Phrases.of(rows, width)


def _quick(p: Phrases) -> np.ndarray:
    """A bit table that rules out most words outside the vocabulary with one look."""
    t = np.zeros(1 << max(16, (16 * len(p.hashes)).bit_length()), bool)
    t[(p.hashes & np.uint64(len(t) - 1)).astype(np.int64)] = True
    return t


_FOUND = "n_words long, spans array<long>, items array<string>, cut string"


def _finds(spark: SparkSession, own: list[Phrases], text: Column, cut: bool = False) -> Column:
    """What one pass finds in a text: its number of words, the merged spans (first word and end by turns) and the items;
    with `cut`, also the text without the spans."""
    shared = [spark.sparkContext.broadcast(p) for p in own]  # PASS_BLOCKS of BLOCK_BYTES of text each

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        quick = [_quick(s.value) for s in shared]
        for column in texts:
            counts, spans, items, texts_left = [], [], [], []
            for w in words(column, PLAIN_WORDS, SHARD_BYTES):
                mask, found = np.zeros(len(w.hash), bool), [set() for _ in range(w.n_texts)]
                of = w.text_of_word()
                for s, q in zip(shared, quick, strict=True):
                    first, length, item = occurrences(w, s.value, q)
                    mask |= hit_words(w, first, length)
                    for t, i in {*zip(of[first].tolist(), item.tolist(), strict=True)}:
                        found[t].add(s.value.items[i])
                counts += w.counts().tolist()
                items += [sorted(f) for f in found]
                hit = np.unique(of[mask])
                own_spans: list[list[int]] = [[] for _ in range(w.n_texts)]
                for t in hit.tolist():
                    edge = np.diff(np.concatenate([[0], mask[w.first[t] : w.first[t + 1]].astype(np.int8), [0]]))
                    own_spans[t] = np.flatnonzero(edge).tolist()
                spans += own_spans
                texts_left += _without(w, own_spans) if cut else [None] * w.n_texts
            yield pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string())), pa.array(texts_left, pa.string())], ["n_words", "spans", "items", "cut"])

    run.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, _FOUND).asNondeterministic()(text)  # so that the optimiser never evaluates it twice


def _merged(a: list[int]) -> list[int]:
    """Spans (first, end by turns) of several passes as disjoint ones in order."""
    out: list[int] = []
    for s, e in sorted(zip(a[::2], a[1::2], strict=True)):
        if out and s <= out[-1]:
            out[-1] = max(out[-1], e)
        else:
            out += [s, e]
    return out


def found_in(docs: DataFrame, benchmark: DataFrame, width: int, cut: bool = False, text_col: str = "text") -> tuple[DataFrame, Column]:
    """A table with docs' rows, and the column (struct of n_words, spans, items, cut) of what was found in its texts."""
    spark = docs.sparkSession
    text = text_of(docs, text_col)
    passes = iter(lambda it=blocks(benchmark, width): list(islice(it, PASS_BLOCKS)), [])
    first, more = next(passes), next(passes, None)
    if more is None:
        return docs, _finds(spark, first, text, cut)
    # several passes: each over the same written rows, whose place is their key
    rows = written(docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("__doc"), text.alias("__text"), F.monotonically_increasing_id().alias("__row")), "benchmark-rows")
    hits = None
    for own in chain([first, more], passes):
        one = written(rows.select("__row", _finds(spark, own, F.col("__text")).alias("f")).filter("size(f.items) > 0").select("__row", "f.*"), "benchmark-hits")
        hits = one if hits is None else hits.unionAll(one)
    hits = hits.groupBy("__row").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))  # one entry a pass
    both = rows.join(hits, "__row", "left")

    def merge(text: pa.Array, spans: pa.Array) -> pa.Array:
        spans, counts, left = [_merged(x or []) for x in spans.to_pylist()], [], []
        for w in words(text, PLAIN_WORDS):
            counts += w.counts().tolist()
            left += _without(w, spans[w.row0 : w.row0 + w.n_texts]) if cut else [None] * w.n_texts
        return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(left, pa.string())], ["n_words", "spans", "cut"])

    merge.__annotations__ = {"text": pa.Array, "spans": pa.Array, "return": pa.Array}
    merged = F.arrow_udf(merge, "n_words long, spans array<long>, cut string").asNondeterministic()
    both = both.select("__doc", "items", merged("__text", "spans").alias("m"))
    found = F.struct("m.n_words", "m.spans", F.coalesce("items", F.array().cast("array<string>")).alias("items"), "m.cut")
    return both.select("__doc.*", found.alias("__found")), F.col("__found")


def _without(w: Words, spans: list[list[int]]) -> list[str | None]:
    """Texts with spans of words cut out; None where there is none to cut, empty where no word is left."""
    raw, out = None, []
    for t, own in enumerate(spans):
        if not own:
            out.append(None)
            continue
        raw = raw or w.data.tobytes()
        a, at, parts = int(w.first[t]), int(w.text_at[t]), []
        for s, e in zip(own[::2], own[1::2], strict=True):
            parts.append(raw[at : w.start[a + s]])
            at = int(w.end[a + e - 1])
        parts.append(raw[at : w.text_at[t + 1]])
        out.append("" if own == [0, int(w.first[t + 1]) - a] else b" ".join(p.strip(b" ") for p in parts).decode())
    return out


def contamination_report(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """The contract's rows: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    rows, found = found_in(docs.select("doc_id", "text"), benchmark, width)
    rows = rows.select("doc_id", found.alias("f"))
    n_hit = F.aggregate(F.transform("f.spans", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select("doc_id", "f.n_words", n_hit.alias("n_hit"), F.size("f.items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("f.items"), ","), 256).alias("items_sha256")).withColumn("contaminated", F.col("n_hit") > 0)


def without_benchmark(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs with every merged span cut out of the text (from its first word to its last, a space in its place).

    A document of which no word is left goes. n_chars, where there is such a column, follows the new text;
    texts without a span, and all other columns, are as they were.
    """
    rows, found = found_in(docs, benchmark, width, cut=True)
    rows = rows.select(F.struct(*(rows[f"`{c}`"] for c in docs.columns)).alias("d"), found.alias("f")).select("d", "f.cut")
    cols = {"text": F.coalesce("cut", "d.text").alias("text")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        cols["n_chars"] = F.when(F.col("cut").isNotNull(), F.char_length("cut").cast(kind)).otherwise(F.col("d.n_chars")).alias("n_chars")
    return rows.filter("cut IS NULL OR cut <> ''").select(*(cols.get(c, F.col(f"d.`{c}`").alias(c)) for c in docs.columns))
