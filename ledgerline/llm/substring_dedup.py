"""Exact substring deduplication with fixed-block anchors.

A window is `width` consecutive words. Every word of a window that also starts earlier (in a document that goes
before, or in the same one) is removed. The block length is half the width, so that every window of a text holds a
whole one of the text's non-overlapping blocks. Hence, if a window is a repeat, one of its block-long parts equals
a block of the text it repeats:

1. Texts are sorted by document over the cluster and stored as shards of about SHARD_BYTES, in a table bucketed by
   shard, so that the later rounds bring their answers to the shards and never move a text again.
2. Index and probe. Each shard sends the hashes of its blocks (the anchors) and, as sorted and delta-coded
   fingerprints, those of all its rolling windows of a block's length, dealt by hash over many small tasks. A task
   answers each shard with one bit for each: whether the anchor was found elsewhere; whether the fingerprint is that
   of an anchor there or earlier.
3. Extend. Hits are extended to the windows around them; what is left, windows around a found anchor and windows
   that hold an anchor of an earlier text, is a superset of the maximal repeats. Their hashes over the full width, 128
   bits each, are exchanged in the same way: a shard learns which of them stand in an earlier shard; what repeats within
   a shard it sees itself. Words covered
   by repeated windows, that is by the maximal exact repeats of at least `width` words, go.

Only hashes that are distinct within a shard are sent, so a passage that a third of all texts share costs each task
one entry a shard. Windows are compared by two independent 64-bit hashes, each of other word hashes: a wrong match among
n candidate windows is expected n * n / 2**129 times, which is 1e-12 for the 1.7e13 words of 100 TB.

Defined results: null texts have no words; documents of fewer than `width` words lose nothing; null ids go after
all others; of rows with one id the one with the smaller text hash goes first, and equal rows lose all but one's
words like copies do; the sha256 of no words is that of the empty string.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import replace
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, mark, remove, shared_dir, text_of, written
from .textnum import SPACE_WORDS, second_hashes, words

WIDTH = 20
SHARD_BYTES = 16_000_000
#: Files of the bucketed table (Spark's own limit is 100,000); beyond as many shards, one holds several.
MOST_BUCKETS = 65_536
#: Bits of a fingerprint beside those that choose its task.
FINGERPRINT = 28

_U = np.uint64


class Shard:
    """The word hashes of a shard's texts, in order."""

    def __init__(self, texts: pa.ChunkedArray, width: int, confirm: bool = True):
        self.width, self.block = width, width // 2
        counts, h_block, at_block, h_wide, at_wide, h_other, base = [], [], [], [], [], [], 0
        for w in words(texts, SPACE_WORDS):
            counts.append(w.counts())
            for n, hs, ats in ((self.block, h_block, at_block), (width, h_wide, at_wide)):
                h, at = w.windows(n)
                hs.append(h)
                ats.append(at + base)
            if confirm:
                h_other.append(replace(w, hash=second_hashes(w, SPACE_WORDS)).windows(width)[0])
            base += len(w.hash)
        cat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        self.counts, self.n_words = cat(counts, np.int64), base
        self.short, self.short_at = cat(h_block, _U), cat(at_block, np.int64)
        self.wide, self.wide_at = cat(h_wide, _U), cat(at_wide, np.int64)
        self.other = cat(h_other, _U)  # the second halves of the wide windows' hashes
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        text = np.searchsorted(self.first, self.short_at, "right") - 1
        self.anchor = (self.short_at - self.first[text]) % self.block == 0

    def probes(self, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct anchors' hashes, their counts; distinct fingerprints of the other windows, and each one's place."""
        anchors, count = np.unique(self.short[self.anchor], return_counts=True)
        prints, place = np.unique(self.short[~self.anchor] >> _U(64 - bits - FINGERPRINT), return_inverse=True)
        return anchors, count, prints, place

    def candidates(self, anchor_bits: np.ndarray, print_bits: np.ndarray, bits: int) -> np.ndarray:
        """Windows (indexes into wide) around a hit."""
        anchors, _, _, place = self.probes(bits)
        hit = np.zeros(len(self.short), bool)
        hit[self.anchor] = anchor_bits[np.searchsorted(anchors, self.short[self.anchor])]
        hit[~self.anchor] = print_bits[place]
        starts = np.zeros(self.n_words + 1, np.int64)
        starts[self.short_at[hit] + 1] = 1
        sums = np.cumsum(starts)  # hits that start before each word
        reach = np.minimum(self.wide_at + self.width - self.block + 1, self.n_words)
        return np.flatnonzero(sums[reach] > sums[self.wide_at])

    def distinct(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct 128-bit hashes of windows, in order; the first window of each; and each window's place among them."""
        return _unique(np.column_stack([self.wide[windows], self.other[windows]]))


def _unique(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows of (first, second half) in order, where each stands first, and every row's place among them."""
    order = np.lexsort((pairs[:, 1], pairs[:, 0]))  # stable: equal rows stay in order
    s = pairs[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]).any(1)
    place = np.empty(len(s), np.int64)
    place[order] = np.cumsum(new) - 1
    return s[new], order[new], place


def encode(sorted_: np.ndarray) -> bytes:
    """Distinct sorted numbers as 16-bit steps (65535: go on), or plain where that is shorter."""
    step = np.diff(sorted_, prepend=_U(0)).astype(np.int64)
    more = step // 65535
    if int(more.sum()) + len(step) > 2 * len(step):
        return b"\1" + sorted_.astype("<u4").tobytes()
    out = np.full(len(step) + int(more.sum()), 65535, "<u2")
    out[np.cumsum(more + 1) - 1] = step % 65535
    return b"\0" + out.tobytes()


def decode(data: bytes) -> np.ndarray:
    if data[:1] == b"\1":
        return np.frombuffer(data, "<u4", offset=1).astype(_U)
    step = np.frombuffer(data, "<u2", offset=1)
    return np.cumsum(step.astype(_U))[step != 65535]


def _cuts(sorted_: np.ndarray, shift: int, n_tasks: int) -> np.ndarray:
    """Bounds of the tasks' parts of sorted numbers whose top bits choose the task."""
    return np.append(np.searchsorted(sorted_, np.arange(n_tasks, dtype=_U) << _U(shift)), len(sorted_)) if shift < 64 else np.array([0, len(sorted_)])


def _bits(x: np.ndarray) -> bytes:
    return np.packbits(x).tobytes()


def _unbits(replies: list[tuple[int, int, bytes]]) -> np.ndarray:
    """One array from (task, length, bits) of all tasks."""
    parts = [np.unpackbits(np.frombuffer(b, np.uint8))[:n] for _, n, b in sorted(replies)]
    return np.concatenate(parts).astype(bool) if parts else np.zeros(0, bool)


_ASK = "task int, shard int, anchors binary, counts binary, prints binary, n long"
_TELL = "shard int, task int, round int, n long, bits binary"


def _rows(rows: list[tuple], schema: list[tuple[str, pa.DataType]]) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else ([] for _ in schema)
    return pa.table({name: pa.array(c, kind) for (name, kind), c in zip(schema, columns, strict=True)})


_ASK_ARROW = [("task", pa.int32()), ("shard", pa.int32()), ("anchors", pa.binary()), ("counts", pa.binary()), ("prints", pa.binary()), ("n", pa.int64())]
_TELL_ARROW = [("shard", pa.int32()), ("task", pa.int32()), ("round", pa.int32()), ("n", pa.int64()), ("bits", pa.binary())]


def answer_probes(asked: pa.Table) -> pa.Table:
    """One task of round 1: for each shard, which of its anchors stand elsewhere too, and which of its fingerprints
    stand as anchors there or earlier."""
    rows = sorted(asked.to_pylist(), key=lambda r: r["shard"])
    anchors = [np.frombuffer(r["anchors"], _U) for r in rows]
    shard = np.repeat([r["shard"] for r in rows], [len(a) for a in anchors])
    every, count = np.concatenate(anchors), np.concatenate([np.frombuffer(r["counts"], "<u2") for r in rows])
    order = np.lexsort((shard, every))
    hashes, first = np.unique(every[order], return_index=True)
    total = np.add.reduceat(count[order].astype(np.int64), first) if len(hashes) else np.zeros(0, np.int64)
    since = shard[order][first]
    prints = [decode(r["prints"]) for r in rows]
    short, place = np.unique(hashes >> _U(64 - FINGERPRINT - rows[0]["n"]) & _U((1 << FINGERPRINT) - 1), return_inverse=True)
    probed = np.zeros(len(short), bool)  # anchors that some other window, anywhere, looks like
    for p in prints if len(short) else ():
        at = np.minimum(np.searchsorted(short, p), len(short) - 1)
        probed[at[short[at] == p]] = True
    earliest = np.full(len(short), np.iinfo(np.int64).max)
    np.minimum.at(earliest, place, since)
    out = []
    for r, own, p in zip(rows, anchors, prints, strict=True):
        at = np.searchsorted(hashes, own)
        out.append((r["shard"], r["task"], 0, len(own), _bits((total[at] > 1) | probed[place[at]])))
        hit = np.zeros(len(p), bool)
        if len(short):
            at = np.minimum(np.searchsorted(short, p), len(short) - 1)
            hit = (short[at] == p) & (earliest[at] <= r["shard"])
        out.append((r["shard"], r["task"], 1, len(p), _bits(hit)))
    return _rows(out, _TELL_ARROW)


def answer_windows(asked: pa.Table) -> pa.Table:
    """One task of round 2: which of each shard's windows stand in an earlier shard."""
    rows = sorted(asked.to_pylist(), key=lambda r: r["shard"])
    own = [np.frombuffer(r["anchors"], _U).reshape(-1, 2) for r in rows]
    shard = np.repeat([r["shard"] for r in rows], [len(a) for a in own])
    _, first, place = _unique(np.concatenate(own))
    earlier = shard[first[place]] < shard  # rows go by shard, so the first one is the earliest
    cuts = np.cumsum([0, *map(len, own)])
    return _rows([(r["shard"], r["task"], 2, len(a), _bits(earlier[cuts[k] : cuts[k + 1]])) for k, (r, a) in enumerate(zip(rows, own, strict=True))], _TELL_ARROW)


def _told(replies: pa.Table, round_: int) -> np.ndarray:
    return _unbits([(r["task"], r["n"], r["bits"]) for r in replies.to_pylist() if r["round"] == round_])


def repeated(shard: Shard, replies: pa.Table, bits: int) -> np.ndarray:
    """Mask of the words that repeated windows cover."""
    windows = shard.candidates(_told(replies, 0), _told(replies, 1), bits)
    _, first, place = shard.distinct(windows)
    earlier = _told(replies, 2)
    again = earlier[place] | (np.arange(len(windows)) != first[place]) if len(windows) else np.zeros(0, bool)
    edge = np.zeros(shard.n_words + 1, np.int64)
    at = shard.wide_at[windows[again]]
    np.add.at(edge, at, 1)
    np.add.at(edge, at + shard.width, -1)
    return np.cumsum(edge[:-1]) > 0


def sharded(docs: DataFrame, shard_bytes: int, id_col: str, text_col: str, keep: list[str], name: str) -> int:
    """The texts in document order as a table bucketed by shard, in the shared folder: the number of shards."""
    spark = docs.sparkSession
    text = text_of(docs, text_col)
    size = docs.select(F.octet_length(text).alias("n")).agg(F.sum("n")).first()[0] or 0
    n = max(1, -(-size // shard_bytes))
    rows = docs.select(docs[id_col].alias("id"), text.alias("text"), F.xxhash64(text).alias("th"), F.monotonically_increasing_id().alias("place"), *keep)
    # equal rows are told apart by their place, so that no number of them has to lie in one shard
    ranged = rows.repartitionByRange(n, F.col("id").isNull(), "id", "th", "place").drop("place").withColumn("shard", F.spark_partition_id())
    ranged.write.option("compression", "zstd").option("path", f"{shared_dir(spark)}/{name}").bucketBy(min(n, MOST_BUCKETS), "shard").sortBy("shard").saveAsTable(name)
    return n


def removals(docs: DataFrame, finish, schema: str, width: int = WIDTH, shard_bytes: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text", keep: list | None = None) -> DataFrame:
    """finish(table of a shard in order, words of each text, mask of removed words) for every shard.

    The shards' table goes when the result is written, or when that fails.
    """
    spark, name = docs.sparkSession, f"ledgerline_shards_{uuid.uuid4().hex}"
    try:
        return _removals(docs, finish, schema, width, shard_bytes, id_col, text_col, keep or [], name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove(spark, f"{shared_dir(spark)}/{name}")


def _removals(docs: DataFrame, finish, schema: str, width: int, shard_bytes: int, id_col: str, text_col: str, keep: list, name: str) -> DataFrame:
    n = sharded(docs, shard_bytes, id_col, text_col, keep, name)
    spark = docs.sparkSession
    shards, began = spark.table(name), mark()
    bits = max(1, n.bit_length())
    n_tasks = 1 << bits

    def in_order(t: pa.Table) -> pa.Table:
        t = t.append_column("no_id", t["id"].is_null())
        return t.sort_by([("no_id", "ascending"), ("id", "ascending"), ("th", "ascending")])

    def ask_probes(t: pa.Table) -> pa.Table:
        t = in_order(t)
        anchors, count, prints, _ = Shard(t["text"], width, confirm=False).probes(bits)
        count = np.minimum(count, 2).astype("<u2")
        a, p = _cuts(anchors, 64 - bits, n_tasks), _cuts(prints, FINGERPRINT, n_tasks)
        low = prints & _U((1 << FINGERPRINT) - 1)
        number = t["shard"][0].as_py()
        return _rows([(k, number, anchors[a[k] : a[k + 1]].tobytes(), count[a[k] : a[k + 1]].tobytes(), encode(low[p[k] : p[k + 1]]), bits) for k in range(n_tasks) if a[k] < a[k + 1] or p[k] < p[k + 1]], _ASK_ARROW)

    def ask_windows(t: pa.Table, replies: pa.Table) -> pa.Table:
        t = in_order(t)
        shard = Shard(t["text"], width)
        hashes, _, _ = shard.distinct(shard.candidates(_told(replies, 0), _told(replies, 1), bits))
        a, number = _cuts(hashes[:, 0], 64 - bits, n_tasks), t["shard"][0].as_py()
        return _rows([(k, number, hashes[a[k] : a[k + 1]].tobytes(), None, None, bits) for k in range(n_tasks) if a[k] < a[k + 1]], _ASK_ARROW)

    def cut(t: pa.Table, replies: pa.Table) -> pa.Table:
        t = in_order(t)
        shard = Shard(t["text"], width)
        return finish(t, shard, repeated(shard, replies, bits))

    some = shards.select("shard", "id", "th", "text")
    told = written(some.groupBy("shard").applyInArrow(ask_probes, _ASK).groupBy("task").applyInArrow(answer_probes, _TELL), "substring-hits")
    again = some.groupBy("shard").cogroup(told.groupBy("shard")).applyInArrow(ask_windows, _ASK)
    told = told.unionAll(again.groupBy("task").applyInArrow(answer_windows, _TELL))
    out = written(shards.groupBy("shard").cogroup(told.groupBy("shard")).applyInArrow(cut, schema), "substring-result")
    forget(spark, began, mark() - 1)
    return out


def _kept_texts(t: pa.Table, shard: Shard, gone: np.ndarray) -> Iterator[bytes]:
    some = np.diff(np.concatenate([[0], np.cumsum(gone)])[shard.first]) > 0
    keep = ~gone
    for i, text in enumerate(t["text"].cast(pa.binary()).to_pylist()):
        own = text.split()
        yield b" ".join(compress(own, keep[shard.first[i] : shard.first[i + 1]].tolist()) if some[i] else own)


def substring_report(docs: DataFrame, width: int = WIDTH, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The contract's rows: doc_id, n_words, n_removed, kept_sha256."""

    def finish(t: pa.Table, shard: Shard, gone: np.ndarray) -> pa.Table:
        n = np.diff(np.concatenate([[0], np.cumsum(gone)])[shard.first])
        digest = [hashlib.sha256(x).hexdigest() for x in _kept_texts(t, shard, gone)]
        return pa.table({"doc_id": t["id"], "n_words": pa.array(shard.counts), "n_removed": pa.array(n), "kept_sha256": pa.array(digest, pa.string())})

    return removals(docs, finish, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_removed long, kept_sha256 string", width, shard_bytes)


def without_repeats(docs: DataFrame, width: int = WIDTH, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """id and text of every document with the repeated words gone, the rest joined by single spaces."""

    def finish(t: pa.Table, shard: Shard, gone: np.ndarray) -> pa.Table:
        return pa.table({"doc_id": t["id"], "text": pa.array([x.decode() for x in _kept_texts(t, shard, gone)], pa.string())})

    return removals(docs, finish, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string", width, shard_bytes)
