"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1; a trigram's vector binds (multiplies) its letters' vectors
after permuting (rolling) them by their place; a text's vector bundles (adds) its trigrams' vectors, and a
language's prototype bundles those of all its training texts. A text gets the language whose prototype has
the largest cosine with it.

The dot product of a text with a prototype is the sum over the text's trigrams of the trigram's own dot
product with it, so those are worked out once for all trigrams, and scoring a text is a table look-up: the
order of the cosines without building 2,048 numbers a document. The score is the best dot product's share of
all positive ones. The tables, GRAMS half-precision numbers a language, are one file that Spark ships to the
executors and tasks map into memory, one language at a time, so that neither a task's nor the driver's memory
grows with the number of languages. Training trigrams are counted by Spark: a task holds the counts of
HELD languages and hands on those of others; prototypes are made from them language by language in tasks.

Letters are lower-cased and given one of SYMBOLS symbols: a-z and the accented letters of Latin-1 their own,
others shared ones, but none is shared between scripts. All else counts as a gap, and runs of gaps as one. A
trigram has a letter in its middle, so none reaches over a gap, and a text's score depends on its own letters alone.
Texts are read PIECE_BYTES at a time, however long they are, cut where there is white space; only a run of more
than PIECE_BYTES without any is cut within words.

Defined results: null texts and texts without a letter are "und" with score 0; a table without labelled
rows makes every prediction "und"; ties go to the language first in order; ids may be null or repeat; repeated
rows count, and are judged, one by one; columns of other names are never read.
"""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, text_of
from .textnum import slices

SYMBOLS = 128
GRAMS = SYMBOLS**3
DIMENSIONS = 2048
UNKNOWN = "und"
PIECE_BYTES = 256_000
#: Languages whose counts a training task holds at once.
HELD = 4


def _symbol(x: int) -> int:
    """Symbol of a lower-case letter: each script has its own range."""
    if 97 <= x <= 122:
        return x - 96
    if 0xDF <= x <= 0xFF:
        return 27 + x - 0xDF
    for end, first, n in ((0x250, 60, 16), (0x400, 76, 8), (0x530, 84, 12), (0x590, 124, 4), (0x900, 96, 10), (0x1200, 106, 6), (0x2E80, 124, 4), (0xA000, 112, 12), (0xAC00, 124, 4), (0xD7B0, 112, 12), (0x20000, 124, 4)):
        if x < end:
            return first + x % n
    return 112 + x % 12


@functools.cache
def symbol_table() -> np.ndarray:
    """Code point -> symbol; 0 for what is no letter."""
    t = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            t[c] = _symbol(ord(x.lower()[0]))
    return t


def _pieces(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of texts of PIECE_BYTES at most; a longer text comes in several pieces."""
    for row0, data, at in slices(column, PIECE_BYTES):
        start, end = 0, len(data)
        while len(at) == 2 and end - start > PIECE_BYTES:
            gap = np.flatnonzero(data[start : start + PIECE_BYTES] <= 32)
            cut = start + (int(gap[-1]) + 1 if len(gap) else PIECE_BYTES)
            while not len(gap) and data[cut] & 0xC0 == 0x80:  # within a character
                cut -= 1
            yield row0, data[start:cut], np.array([0, cut - start])
            start = cut
        yield row0, data[start:end], at if not start else np.array([0, end - start])


def trigrams(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, trigram numbers, bounds of each text's trigrams, letters of each text), piece by piece."""
    table = symbol_table()
    for row0, data, at in _pieces(column):
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), "<u4")
        bounds = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int32)])[at]
        # a gap before each text and after the last one
        n = len(at) - 1
        sym = np.zeros(len(points) + n + 1, np.uint8)
        sym[np.arange(len(points), dtype=np.int32) + np.repeat(np.arange(1, n + 1, dtype=np.int32), np.diff(bounds))] = table[points]
        letter = sym > 0
        letters = np.diff(np.concatenate([[0], np.cumsum(letter, dtype=np.int32)])[bounds + np.arange(n + 1)])
        keep = np.ones(len(sym), bool)
        keep[1:] = letter[1:] | letter[:-1]  # runs of gaps are one gap
        place = np.concatenate([[0], np.cumsum(keep, dtype=np.int32)])[bounds + np.arange(n + 1)]
        s = sym[keep].astype(np.int32)
        middle = s[1:-1] > 0
        tri = ((s[:-2] << 14 | s[1:-1] << 7 | s[2:]) if len(s) > 2 else np.zeros(0, np.int32))[middle]
        # a trigram belongs to the text that holds its middle symbol
        yield row0, tri, np.concatenate([[0], np.cumsum(middle, dtype=np.int32)])[np.clip(place - 1, 0, len(middle))], letters


def trigram_counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, gram, n over all rows with a language: counted within tasks, then summed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        held = 0

        def told(lang: str) -> pa.RecordBatch:
            n = total.pop(lang)
            gram = np.flatnonzero(n)
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram), pa.array(n[gram].astype(np.int64))], ["lang", "gram", "n"])

        for b in batches:
            langs = b["lang"].to_pylist()
            order = sorted(range(len(langs)), key=lambda i: langs[i])
            sorted_ = [langs[i] for i in order]
            texts = b["text"].take(pa.array(order, pa.int32()))
            cuts = [0, *(i for i in range(1, len(sorted_)) if sorted_[i] != sorted_[i - 1]), len(sorted_)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                lang = sorted_[lo]
                if lang not in total:
                    if len(total) == HELD:
                        yield told(next(iter(total)))
                    total[lang] = np.zeros(GRAMS, np.uint32)
                total[lang] = own = total.pop(lang)  # the one used last goes last
                for _, tri, _, _ in trigrams(texts.slice(lo, hi - lo)):
                    np.add.at(own, tri, np.uint32(1))
                    held += len(tri)
                    if held > 1 << 31:
                        held = 0
                        yield from [told(x) for x in [*total]]
                        total[lang] = own = np.zeros(GRAMS, np.uint32)
        yield from [told(x) for x in [*total]]

    rows = docs.filter(docs[lang_col].isNotNull()).select(docs[lang_col].cast("string").alias("lang"), text_of(docs, text_col).alias("text"))
    return rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def letter_vectors(seed: int = 8) -> np.ndarray:
    return np.random.default_rng(seed).choice(np.array([-1, 1], np.float32), (SYMBOLS, DIMENSIONS))


def _bound() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The letters' vectors, permuted for the first, second and third place of a trigram."""
    letters = letter_vectors()
    return np.roll(letters, 2, 1), np.roll(letters, 1, 1), letters


def prototype(counts: pa.Table) -> pa.Table:
    """One language's bundled trigram vectors, at length one."""
    n = np.zeros(GRAMS, np.float32)
    n[counts["gram"].to_numpy()] = counts["n"].to_numpy()
    n = n.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    first, second, third = _bound()
    out = np.zeros(DIMENSIONS, np.float32)
    for a in np.flatnonzero(n.any((1, 2))):
        out += first[a] * (second * (n[a] @ third)).sum(0)
    out /= max(1e-9, np.linalg.norm(out))
    return pa.table({"lang": counts["lang"].slice(0, 1), "vector": pa.array([out.tobytes()], pa.binary())})


def trigram_dots(vector: np.ndarray) -> np.ndarray:
    """Every trigram's dot product with a prototype."""
    first, second, third = _bound()
    right = (third * vector).T
    return np.concatenate([((first[a] * second) @ right).ravel() for a in range(SYMBOLS)]).astype(np.float16)


class Model:
    """Languages in order and the name of the file of their tables, which tasks map into memory."""

    def __init__(self, langs: list[str], file: str | None):
        self.langs, self.file = langs, file

    @classmethod
    def of(cls, spark: SparkSession, counts: DataFrame) -> Model:
        """From trigram counts. The driver gets DIMENSIONS numbers a language and writes one table after the other."""
        found = sorted(counts.groupBy("lang").applyInArrow(prototype, "lang string, vector binary").toLocalIterator())
        if not found:
            return cls([], None)
        # beside the files that Spark serves, which go when the session ends
        path = f"{tempfile.mkdtemp(dir=SparkFiles.getRootDirectory())}/languages-{uuid.uuid4().hex}.npy"
        table = np.lib.format.open_memmap(path, "w+", np.float16, (len(found), GRAMS))
        for k, (_, vector) in enumerate(found):
            table[k] = trigram_dots(np.frombuffer(vector, np.float32))
        table.flush()
        spark.sparkContext.addFile(path)
        return cls([lang for lang, _ in found], path.rsplit("/", 1)[1])

    def judge(self, column: pa.Array) -> pa.Array:
        """lang_pred, score, whether the text has a letter, its trigrams, and strength: the best dot product over what chance gives."""
        n = len(column)
        size, lettered = np.zeros(n), np.zeros(n, bool)
        dot = np.zeros((len(self.langs), n))
        table = np.load(SparkFiles.get(self.file), mmap_mode="r") if self.langs else []
        for row0, tri, bounds, letters in trigrams(column):
            own = np.arange(row0, row0 + len(letters))
            lettered[own] |= letters > 0
            size[own] += np.diff(bounds)
            some = np.flatnonzero(np.diff(bounds))
            for k, dots in enumerate(table):
                if len(some):
                    dot[k, row0 + some] += np.add.reduceat(dots[tri].astype(np.float64), bounds[some])
        if not self.langs:
            names, score, strength = pa.array([UNKNOWN] * n, pa.string()), np.zeros(n), np.zeros(n)
        else:
            up = np.maximum(dot, 0)
            best = dot.argmax(0)
            score = np.where(lettered, up.max(0) / np.maximum(up.sum(0), 1e-12), 0.0)
            strength = dot.max(0) / np.sqrt(np.maximum(size, 1))
            names = pc.take(pa.array([*self.langs, UNKNOWN], pa.string()), pa.array(np.where(lettered, best, len(self.langs))))
        return pa.StructArray.from_arrays([names, pa.array(score), pa.array(lettered), pa.array(size.astype(np.int64)), pa.array(strength)], ["lang_pred", "score", "lettered", "grams", "strength"])

    def column(self, text: Column) -> Column:
        """The judgement of a text column; only that column goes through Python."""

        def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for x in texts:
                yield self.judge(x)

        run.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
        return F.arrow_udf(run, "lang_pred string, score double, lettered boolean, grams long, strength double").asNondeterministic()(text)  # so that the optimiser never evaluates it twice


def train(docs: DataFrame) -> Model:
    """Prototypes from the labelled rows that are not held out."""
    return Model.of(docs.sparkSession, trigram_counts(docs.filter(fold(docs["doc_id"], 3) != 1)))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score of every row of docs."""
    return docs.select(docs[id_col].alias("id"), model.column(text_of(docs, text_col)).alias("said")).select("id", "said.lang_pred", "said.score")


def language_report(docs: DataFrame) -> DataFrame:
    """The contract's rows: doc_id, held_out, lang_pred, score."""
    found = predict(docs, train(docs))
    return found.select(F.col("id").alias("doc_id"), (fold(F.col("id"), 3) == 1).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, languages: list[str] | None = None, least_strength: float | None = None) -> DataFrame:
    """docs without the rows whose language cannot be told; all columns as they were.

    What goes: texts that op8 calls `und`, those without a letter; where `languages` is given, texts of others; where
    `least_strength` is given, texts whose best dot product is less than so many times sqrt(trigrams), which is what
    chance gives one (another script, say, or letters at random; 2 is a good value for profiles of many texts). A row's
    own label is not looked at. Where no language was learned, every text with a letter stays.
    """
    model = train(docs)
    said = model.column(text_of(docs))
    keep = said["lettered"]
    if model.langs and least_strength is not None:
        keep &= said["strength"] >= least_strength
    if model.langs and languages is not None:
        keep &= said["lang_pred"].isin(languages)
    return docs.filter(keep)
