"""Sequence packing: first-fit decreasing over a tournament tree of bin capacities, in randomised groups.

Texts are tokenised in Arrow batches; a document's ids end with the separator id. A document is cut
into full sequences and one remainder. Only (document, start, length, crc) leaves the tokenising
tasks: a group of documents, drawn at random, is packed by one task that sorts its pieces
by decreasing length and puts each into the first bin with room, found by descending a max-tree of
free capacities in O(log bins). The bins that a group leaves part-empty are then closed up: pieces of
the emptiest bins are cut to fill the holes of the fullest, so that at most one bin a group is not full.
That last bin is split at powers of two, each of which needs no padding.

The number of groups follows the number of documents (GROUP_DOCS each), and so does the number of tasks that pack
them, so a task's memory is bounded; a document's group is drawn by a hash of its place in the written table, which
spreads rows with null or equal ids, and equal rows, like all others.

Defined results: a null or empty text is a document of the separator alone; a table without rows gives
no pieces; rows that repeat are separate documents; ids are never read beyond copying them out.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of, written
from .textnum import SPACE_WORDS, SPACE_WORDS_LOWER, utf8, words

MAX_TOKENS = 4096
SEPARATOR = 2
#: Documents packed by one task, about.
GROUP_DOCS = 16_384
#: Entries that a task's caches of words and of chunks may hold; what comes later is worked out again.
CACHE_WORDS = 300_000
CACHE_CHUNKS = 400_000


#: A chunk that the short way may take: visible ASCII and Latin letters and signs, none of which
#: composes with another; and how the tokenizer's pre-tokenizer then splits it.
_SHORT_WAY = re.compile("[!-~\u00a1-\u012f]*").fullmatch
_LETTER = "a-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f"
_NUMBER = "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_LETTER}{_NUMBER}]+").findall


def _byte_letters() -> dict[int, int]:
    """Byte -> the visible character that stands for it in a byte-level vocabulary."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: b for b in visible} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in visible)}


class Tokenise:
    """Whole texts to ids. White space always ends a word of this tokenizer, so each distinct chunk
    between white space is tokenised once and looked up after that: a slice of texts is hashed, reduced
    to its distinct chunks, each word confirmed on its bytes, and put together again in numpy.

    Chunks of Latin letters are split here by the pre-tokenizer's own pattern, so that the vocabulary's
    merges run once for each distinct word; any other chunk takes the tokenizer's whole way.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words: dict[bytes, bytes] = {}
        self._forget()
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.short = self._is_known_kind()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}  # chunk -> its place in size, at
        self.size, self.at, self.ids, self.used = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.uint32), 0

    def _learn(self, chunks: list[bytes]) -> None:
        found = [self._chunk(c) for c in chunks]
        n, k = len(self.known), len(chunks)
        sizes = np.fromiter(map(len, found), np.int64, k) // 4
        while n + k > len(self.size):
            self.size, self.at = np.concatenate([self.size, np.zeros_like(self.size)]), np.concatenate([self.at, np.zeros_like(self.at)])
        while self.used + sizes.sum() > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.size[n : n + k] = sizes
        self.at[n : n + k] = self.used + np.cumsum(sizes) - sizes
        self.ids[self.used : self.used + sizes.sum()] = np.frombuffer(b"".join(found), "<u4")
        self.used += int(sizes.sum())
        self.known.update(zip(chunks, range(n, n + k), strict=True))

    def _is_known_kind(self) -> bool:
        """Whether the short way gives this tokenizer's ids, tried on a line that has every kind of piece."""
        line = "don't we'll x9, caf\u00e9 stra\u00dfe \u00bd\u00b2 (a-b) \u00c9T\u00c9!!\u00ab1234\u00bb"
        try:
            own = b"".join(self._short(c.decode().lower()) for c in line.encode().split())
        except Exception:  # a model without word ends, or of another kind
            return False
        return own == self._whole(line)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, w: bytes) -> bytes:
        ids = self.words.get(w)
        if ids is None:
            spelled = w.decode("latin-1")
            found = self.model.tokenize(spelled if w.isalnum() else spelled.translate(self.letters))
            ids = array("I", [t.id for t in found]).tobytes()
            if len(self.words) < CACHE_WORDS:
                self.words[w] = ids
        return ids

    def _short(self, chunk: str) -> bytes:
        return b"".join([self._word(w.encode()) for w in _PIECES(chunk)])

    def _chunk(self, chunk: bytes) -> bytes:
        if self.short:
            low = chunk.lower()  # A-Z alone
            if low.isalpha():
                return self._word(low)
            if low[:-1].isalpha() and low[-1] in b".,":
                return self._word(low[:-1]) + self._word(low[-1:])
            if b"<|" not in chunk and _SHORT_WAY(text := chunk.decode().lower()):
                return self._short(text)
        return self._whole(chunk.decode())

    def __call__(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text, in order."""
        # special tokens, which alone depend on case, begin with "<|"
        data, _ = utf8(texts)
        table = SPACE_WORDS if b"<|" in memoryview(data).tobytes() else SPACE_WORDS_LOWER
        for w in words(texts, table):
            if len(self.known) > CACHE_CHUNKS:
                self._forget()
            low = _LOWER[w.data] if table is SPACE_WORDS_LOWER else w.data
            order = np.argsort(w.hash)
            ranked = w.hash[order]
            new = np.ones(len(order), bool)
            new[1:] = ranked[1:] != ranked[:-1]
            sample = np.empty(len(order), np.int64)
            sample[order] = order[new][np.cumsum(new) - 1] if len(order) else 0
            sample[~_equal(low, w.start, w.end, sample)] = -1  # another chunk with the same hash: on its own
            alone = np.flatnonzero(sample < 0)
            sample[alone] = alone
            distinct, of = np.unique(sample, return_inverse=True)
            raw = low.tobytes()
            chunks = [raw[s:e] for s, e in zip(w.start[distinct].tolist(), w.end[distinct].tolist(), strict=True)]
            if missing := [c for c in dict.fromkeys(chunks) if c not in self.known]:
                self._learn(missing)
            of = np.array([self.known[c] for c in chunks], np.int64)[of]
            size = self.size[of]
            ends = np.cumsum(size)
            total = int(ends[-1]) if len(ends) else 0
            ids = self.ids[np.arange(total) + np.repeat(self.at[of] - (ends - size), size)]
            bounds = np.concatenate([[0], ends])[w.first]
            for i in range(w.n_texts):
                yield ids[bounds[i] : bounds[i + 1]]


_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def _equal(data: np.ndarray, start: np.ndarray, end: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether each word has the same bytes as another one."""
    size = end - start
    same = size == size[other]
    at = np.flatnonzero(same & (other != np.arange(len(other))))
    n = size[at]
    step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    unlike = data[step + np.repeat(start[at], n)] != data[step + np.repeat(start[other[at]], n)]
    same[at[np.unique(np.repeat(np.arange(len(at)), n)[unlike])]] = False
    return same


class TournamentTree:
    """Bins of one capacity with a max-tree of free space; the leftmost bin with room is found from the root."""

    def __init__(self, n_bins: int, capacity: int):
        self.leaves = 1 << max(0, (n_bins - 1).bit_length())
        self.free = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> tuple[int, int]:
        """(bin, free space it had)."""
        free, i = self.free, 1
        while i < self.leaves:
            i *= 2
            if free[i] < size:
                i += 1
        had = free[i]
        free[i] = had - size
        bin_ = i - self.leaves
        while i > 1:
            i //= 2
            top = max(free[2 * i], free[2 * i + 1])
            if free[i] == top:
                break
            free[i] = top
        return bin_, had


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each piece. Ties keep the given order."""
    bins = np.zeros(len(sizes), np.int64)
    tree = TournamentTree(max(1, len(sizes)), capacity)
    for i in np.argsort(-sizes, kind="stable"):
        bins[i], _ = tree.place(int(sizes[i]))
    return bins


def close_up(bins: list[list[list[int]]], capacity: int) -> list[list[list[int]]]:
    """bins of [piece, start, length]: the fullest are filled with cuts from the emptiest; the one
    part-full bin that is left is split into sequences whose lengths are powers of two."""
    load = [sum(p[2] for p in b) for b in bins]
    order = sorted(range(len(bins)), key=lambda i: (-load[i], i))
    lo, hi = 0, len(order) - 1
    while lo < hi:
        a, b = order[lo], order[hi]
        room = capacity - load[a]
        if not room:
            lo += 1
            continue
        piece = bins[b][-1]
        n = min(room, piece[2])
        bins[a].append([piece[0], piece[1] + piece[2] - n, n])
        piece[2] -= n
        load[a] += n
        load[b] -= n
        if not piece[2]:
            bins[b].pop()
        if not bins[b]:
            hi -= 1
    out = [bins[i] for i in order if bins[i]]
    if out and (rest := sum(p[2] for p in out[-1])) < capacity:
        last = out.pop()
        for bit in reversed(range(rest.bit_length())):
            if not rest >> bit & 1:
                continue
            need, seq = 1 << bit, []
            while need:
                piece = last[0]
                n = min(need, piece[2])
                seq.append([piece[0], piece[1], n])
                piece[1] += n
                piece[2] -= n
                need -= n
                if not piece[2]:
                    last.pop(0)
            out.append(seq)
    return out


def tokenised(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", separator: int = SEPARATOR) -> DataFrame:
    """id, ids (binary, little-endian unsigned 32-bit, with the separator at the end)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenise, end = Tokenise(tokenizer_path), np.array([separator], "<u4").tobytes()
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                ids = [x.astype("<u4").tobytes() + end for x in tokenise(part["text"])]
                yield pa.RecordBatch.from_arrays([part["id"], pa.array(ids, pa.binary())], ["id", "ids"])

    rows = docs.select(docs[id_col].alias("id"), text_of(docs, text_col).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, ids binary")


def _narrow(ids: bytes) -> bytes:
    """Ids in two bytes each where all fit, else as they are (four)."""
    x = np.frombuffer(ids, "<u4")
    return ids if len(x) and x.max() > 0xFFFF else x.astype("<u2").tobytes()


def pack(docs: DataFrame, tokenizer_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = MAX_TOKENS, separator: int = SEPARATOR, group_docs: int = GROUP_DOCS) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    The ids of remainders travel with them to the packing task (they may be cut there, and a cut needs
    its own crc); full sequences need no packing and leave the tokenising task with their crc alone.
    """
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenise, end = Tokenise(tokenizer_path), np.array([separator], "<u4").tobytes()
        place = TaskContext.get().partitionId() << 40
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                n, crcs, rest = [], [], []
                for ids in tokenise(part["text"]):
                    x = ids.astype("<u4").tobytes() + end
                    full = len(x) // (4 * capacity)
                    n.append(len(x) // 4)
                    crcs.append([zlib.crc32(x[4 * capacity * i : 4 * capacity * (i + 1)]) for i in range(full)])
                    rest.append(_narrow(x[4 * capacity * full :]))
                yield pa.RecordBatch.from_arrays([part["id"], pa.array(np.arange(place, place + part.num_rows)), pa.array(n, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(rest, pa.binary())], ["id", "place", "n", "crcs", "rest"])
                place += part.num_rows

    rows = docs.select(docs[id_col].alias("id"), text_of(docs, text_col).alias("text"))
    cuts = written(rows.mapInArrow(cut, f"id {kind}, place long, n long, crcs array<long>, rest binary"), "packing-cuts")
    n_groups = max(1, -(-cuts.count() // group_docs))
    # by range, so that every group has a task of its own
    cuts = cuts.withColumn("grp", F.pmod(F.xxhash64("place"), F.lit(n_groups))).repartitionByRange(n_groups, "grp")

    def pack_group(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        group = int(key[0])
        frame = frame.sort_values("place").reset_index(drop=True)
        out: list[tuple] = []
        seq = group << 32
        ids, ns, rests = frame["id"], frame["n"].to_numpy(), list(frame["rest"])
        for i, crcs in enumerate(frame["crcs"]):
            for k, crc in enumerate(crcs):
                out.append((i, k * capacity, capacity, int(crc), seq, 0))
                seq += 1
        base = np.array([len(c) * capacity for c in frame["crcs"]], np.int64)
        length = ns - base
        some = np.flatnonzero(length > 0)
        where = first_fit_decreasing(length[some], capacity)
        bins: list[list[list[int]]] = [[] for _ in range(int(where.max()) + 1 if len(where) else 0)]
        for i, w in zip(some, where, strict=True):
            bins[w].append([int(i), 0, int(length[i])])
        for b in close_up(bins, capacity):
            offset = 0
            for i, start, n in b:
                width = len(rests[i]) // int(length[i])
                piece = np.frombuffer(rests[i], "<u2" if width == 2 else "<u4")[start : start + n].astype("<u4").tobytes()
                out.append((i, int(base[i]) + start, n, zlib.crc32(piece), seq, offset))
                offset += n
            seq += 1
        i, start, n, crc, s, o = (np.array(x, np.int64) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 6
        return pd.DataFrame({"doc_id": ids.iloc[i].to_numpy(), "start": start, "length": n, "ids_crc32": crc, "doc_tokens": ns[i], "sequence_id": s, "offset": o})

    cuts = cuts.withColumn("id", F.col("id").cast("string"))  # pandas has no whole numbers with nulls; text keeps both
    packed = cuts.groupBy("grp").applyInPandas(pack_group, "doc_id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return packed.withColumn("doc_id", F.col("doc_id").cast(kind))
