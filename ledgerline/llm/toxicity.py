"""Toxicity scores from a learned lexicon, met by Levenshtein automata so that misspelled terms count too.

The lexicon is a trie. A word is matched by running the word's Levenshtein automaton (states: rows of edit
distances, cut off above the bound) along the trie and leaving every branch on which no state is within the bound.
Only words that can be near a term at all are run: the letters of two words within k edits differ by 2k letters at
most and their lengths by k, which is tested for all words of a slice at once. Each distinct word is run once.

Besides whole terms the lexicon has stems: beginnings that several toxic words share, each ending of which may be
rare. They are accepting states inside the same trie: the automaton of a word that reaches one without an edit and goes
on is an inflected hit, where no whole term is near.

A hit's score depends on its context: a window of words around it is searched for signs of quotation (quotation
marks at the term, words that report speech or speak about words) and of address (second-person words). What is
quoted and not addressed to anyone counts as quotation, else as abuse. The document score is logistic in the
logarithms of the kinds of hits (exact or misspelled, abuse or quotation; inflected).

Lexicon and weights are fitted on at most SAMPLE_ROWS labelled documents, those with the smallest hash of their
id, so that only that bounded set of labels is sent to all tasks; every word of them that passes the tests is a term.
Scoring reads every whole text.

Defined results: null and empty texts have no hits and get the score of a text without any; without labelled rows
the lexicon is empty and all scores equal the prior; a doc_id labelled twice counts once, as toxic if either says
so; null labels are ignored. Rows that repeat are scored one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, text_of, written
from .license_scan import Vocabulary, _tokens
from .textnum import PLAIN_WORDS, Words, words

#: The most labelled documents that lexicon and weights are fitted on.
SAMPLE_ROWS = 20_000
#: Words looked at on each side of a hit.
CONTEXT = 6

# Words that report speech or speak about words, and words that address someone.
REPORTING = "said says say told wrote writes called call term word words phrase quote quotes quoted insult insults slur meaning means mot terme dit disait wort sagte genannt palabra dijo llamado".split()
ADDRESS = "you your yours yourself u ur du dich dein deine ihr tu te toi ton ta vous votre tú ti usted ustedes eres".split()
_MARKS = b"\"'`"
_WIDE_MARKS = ("“", "”", "‘", "’", "«", "»", "„", "‚", "‹", "›")


def bound(length: int) -> int:
    """Edits that a term of this length may be away."""
    return 0 if length < 5 else 1 if length < 10 else 2


class Trie:
    def __init__(self, terms: list[str], stems: list[str] | None = None):
        self.children: list[dict[str, int]] = [{}]
        self.depth = [0]
        self.term, self.stem = [-1], [-1]
        for marks, texts in ((self.term, terms), (self.stem, stems or [])):
            for k, t in enumerate(texts):
                marks[self._node(t)] = k
        self.most = [bound(len(t)) for t in terms]
        self._reach()

    def _node(self, text: str) -> int:
        node = 0
        for c in text:
            if c not in self.children[node]:
                self.children[node][c] = len(self.children)
                self.children.append({})
                self.depth.append(self.depth[node] + 1)
                self.term.append(-1)
                self.stem.append(-1)
            node = self.children[node][c]
        return node

    def _reach(self) -> None:
        """The largest bound among the terms below each node; a stem's is 0."""
        self.reach = [max(self.most[t] if t >= 0 else -1, 0 if x >= 0 else -1) for t, x in zip(self.term, self.stem, strict=True)]
        for node in reversed(range(len(self.children))):  # children come after their parent
            self.reach[node] = max([self.reach[node], *(self.reach[c] for c in self.children[node].values())])

    def exact_only(self, terms: list[int]) -> None:
        for t in terms:
            self.most[t] = 0
        self._reach()

    def run(self, word: str) -> tuple[tuple[int, int] | None, int]:
        """(distance, term) of the nearest term within its bound, the first term at a tie; and the longest stem that
        the word begins with and goes on from, or -1."""
        best, stem, stem_depth = None, -1, 0
        todo = [(0, list(range(len(word) + 1)))]
        while todo:
            node, state = todo.pop()
            t, depth = self.term[node], self.depth[node]
            if t >= 0 and state[-1] <= self.most[t] and (best is None or (state[-1], t) < best):
                best = (state[-1], t)
            if self.stem[node] >= 0 and stem_depth < depth < len(word) and state[depth] == 0:
                stem, stem_depth = self.stem[node], depth
            for c, child in self.children[node].items():
                k = self.reach[child]
                left = least = state[0] + 1
                row = [left]
                for i, x in enumerate(word):
                    here = state[i] if x == c else 1 + min(state[i], state[i + 1], left)
                    row.append(here)
                    left = here
                    if here < least:
                        least = here
                if least <= k:
                    todo.append((child, row))
        return best, stem

    def near(self, word: str) -> tuple[int, int] | None:
        """(distance, term) of the nearest term within its bound; the first term at a tie."""
        return self.run(word)[0]


#: Letters and digits in 31 classes, by byte; the last bit marks other than ASCII letters.
_WIDE = np.uint32(1 << 31)
_LETTER_BIT = np.array([1 << (b % 31) if b < 128 else int(_WIDE) | 1 << (b % 31) for b in range(256)], np.uint32)


def _letters(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The set of letter classes of each word."""
    bits = np.append(_LETTER_BIT[np.where((data >= 65) & (data <= 90), data + 32, data)], np.uint32(0))
    both = np.empty(2 * len(start), np.int64)
    both[::2], both[1::2] = start, end
    return np.bitwise_or.reduceat(bits, both)[::2] if len(start) else np.zeros(0, np.uint32)


@dataclass
class Lexicon:
    terms: list[str]
    stems: list[str] = field(default_factory=list)
    exact_only: list[int] = field(default_factory=list)  # terms whose neighbours are other words
    trie: Trie = field(init=False)
    seen: dict[int, tuple[tuple[int, int] | None, int]] = field(init=False, default_factory=dict)

    def __post_init__(self) -> None:
        self.trie = Trie(self.terms, self.stems)
        self.trie.exact_only(self.exact_only)
        raw = [t.encode() for t in self.terms]
        self.sets = [int(np.bitwise_or.reduce(_LETTER_BIT[np.frombuffer(t, np.uint8)])) for t in raw]
        self.lengths = [len(t) for t in raw]

    def candidates(self, w: Words) -> np.ndarray:
        """Words that may be near a term, by what k edits can do to a word's bytes, or that begin like a stem."""
        length = w.end - w.start
        fits = np.flatnonzero((length >= min(self.lengths, default=0) - 8) & (length <= max(self.lengths, default=-9) + 8))
        sets = _letters(w.data, w.start[fits], w.end[fits])
        maybe = np.zeros(len(fits), bool)
        plain = sets < _WIDE
        size = length[fits]
        for s, n, k in zip(self.sets, self.lengths, self.trie.most, strict=True):
            # an edit takes one letter away and adds one at most; other than ASCII letters have up to four bytes
            if not k:
                maybe |= (sets == np.uint32(s)) & (size == n)
                continue
            most = np.where(plain, k, 4 * k)
            lost = k if s < _WIDE else 4 * k
            # the wide mark itself is no letter
            maybe |= (np.bitwise_count(sets & ~np.uint32(s) & ~_WIDE) <= most) & (np.bitwise_count(np.uint32(s) & ~sets & ~_WIDE) <= lost) & (size - n <= most) & (n - size <= lost)
        out = np.zeros(len(length), bool)
        out[fits[maybe]] = True
        if self.stems:
            low = np.append(np.where((w.data >= 65) & (w.data <= 90), w.data + 32, w.data), np.zeros(4, np.uint8)).astype(np.uint32)
            head = low[w.start] | low[w.start + 1] << 8 | low[w.start + 2] << 16 | low[w.start + 3] << 24
            out |= np.isin(head, [int.from_bytes(x.encode()[:4], "little") for x in self.stems])
        return np.flatnonzero(out)

    def hits(self, w: Words) -> tuple[list[int], list[int], list[int]]:
        """Word, term and distance of every word near a term; of inflected words, the stem and distance -1."""
        at = self.candidates(w)
        place, term, distance = [], [], []
        raw = None
        for i, h in zip(at.tolist(), w.hash[at].tolist(), strict=True):
            if h not in self.seen:
                if len(self.seen) > 200_000:
                    self.seen.clear()
                raw = raw or w.data.tobytes()
                self.seen[h] = self.trie.run(raw[w.start[i] : w.end[i]].decode().lower())
            best, stem = self.seen[h]
            if best is not None or stem >= 0:
                place.append(i)
                distance.append(-1 if best is None else best[0])
                term.append(stem if best is None else best[1])
        return place, term, distance


KINDS = 5


def quoted(w: Words, i: int, lo: int, hi: int) -> bool:
    """Whether word i, of a text of the words lo..hi, is quoted rather than addressed to someone."""
    a, b = max(lo, i - CONTEXT), min(hi, i + CONTEXT + 1)
    around = [bytes(w.data[w.start[j] : w.end[j]]).decode().lower() for j in range(a, b) if j != i]
    before = bytes(w.data[w.end[i - 1] if i > lo else max(0, w.start[i] - 8) : w.start[i]])
    after = bytes(w.data[w.end[i] : w.start[i + 1] if i + 1 < hi else w.end[i] + 8])
    marks = lambda x: any(m in _MARKS for m in x)
    if i > a and (j := around[i - a - 1]) and j[-1:] in _WIDE_MARKS:
        before += b'"'
    own = bytes(w.data[w.start[i] : w.end[i]]).decode()
    score = 1.0 * ((marks(before) or own[:1] in _WIDE_MARKS) and (marks(after) or own[-1:] in _WIDE_MARKS))
    score += 0.5 * len({*around} & {*REPORTING}) - 1.0 * bool({*around} & {*ADDRESS})
    return score >= 1.0


def features(w: Words, lexicon: Lexicon) -> np.ndarray:
    """Hits of each text: exact abuse, exact quotation, misspelled abuse, misspelled quotation, inflected."""
    out = np.zeros((w.n_texts, KINDS))
    place, _, distance = lexicon.hits(w)
    if place:
        of = (np.searchsorted(w.first, place, "right") - 1).tolist()
        for i, t, d in zip(place, of, distance, strict=True):
            out[t, 4 if d < 0 else 2 * (d > 0) + quoted(w, i, int(w.first[t]), int(w.first[t + 1]))] += 1
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text, toxic of at most SAMPLE_ROWS labelled documents that are not held out."""
    own = labels.filter(F.col("toxic").isNotNull() & (fold(labels["doc_id"], 5) != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)  # a bounded set of (id, label)
    found = docs.select(F.col("doc_id"), text_of(docs).alias("text")).join(F.broadcast(some), "doc_id")
    return written(found.select("text", F.col("toxic").cast("int").alias("toxic")), "toxicity-sample")


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, documents with it, toxic documents with it, within this task."""
    count: dict[bytes, list[int]] = {}
    for b in batches:
        toxic = b["toxic"].to_numpy()
        for w in words(b["text"], PLAIN_WORDS):
            of = w.text_of_word()
            order = np.lexsort((of, w.hash))
            h, t = w.hash[order], of[order]
            first = np.ones(len(h), bool)
            first[1:] = h[1:] != h[:-1]
            once = first.copy()  # the first place of a word in a text
            once[1:] |= t[1:] != t[:-1]
            group = np.cumsum(first) - 1
            n = np.bincount(group[once])
            n_toxic = np.bincount(group[once], toxic[w.row0 + t[once]])
            raw, at = w.data.tobytes(), order[first]
            for s, e, x, y in zip(w.start[at].tolist(), w.end[at].tolist(), n.tolist(), n_toxic.tolist(), strict=True):
                own = count.setdefault(raw[s:e].lower(), [0, 0])
                own[0] += x
                own[1] += int(y)
    yield pa.RecordBatch.from_arrays([pa.array([x.decode() for x in count], pa.string()), pa.array([x[0] for x in count.values()], pa.int64()), pa.array([x[1] for x in count.values()], pa.int64())], ["word", "n", "n_toxic"])


def common_stems(found: list[str]) -> list[str]:
    """Prefixes of five letters or more that at least three of the words share and go on from, each as long as the
    words that share it allow; a stem within another one's words is left out."""
    by: dict[str, set[str]] = {}
    for x in found:
        for n in range(5, len(x)):
            by.setdefault(x[:n], set()).add(x)
    out: list[str] = []
    for stem in sorted(by, key=lambda p: (-len(by[p]), -len(p), p)):
        if len(by[stem]) >= 3 and not any(stem.startswith(x) or x.startswith(stem) for x in out):
            out.append(stem)
    return out


def learn_lexicon(sample: DataFrame) -> Lexicon:
    """Terms: words that stand in toxic texts nearly alone, in many of them and after many different words. The last
    condition keeps out words of passages that copies of a few toxic texts repeat.
    Stems: shared prefixes of words that lean to toxic texts, where texts that have two such words nearly all are."""
    least, contexts = 8, 8
    n, n_toxic = sample.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    rate = (n_toxic or 0) / max(1, n)
    share, lean = rate + 0.9 * (1 - rate), rate + 0.5 * (1 - rate)
    counts = sample.mapInArrow(_word_counts, "word string, n long, n_toxic long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_toxic").alias("n_toxic"))
    leaning = counts.filter((F.col("n_toxic") >= least) & (F.col("n_toxic") >= lean * F.col("n")) & (F.char_length("word") >= 3))
    found = {r["word"]: r for r in leaning.collect()}  # words of SAMPLE_ROWS texts
    stems = common_stems(sorted(found))
    known = [x for x, r in found.items() if r["n_toxic"] >= share * r["n"]]
    vocabulary = Vocabulary(_tokens(known))
    probe = Lexicon([], stems)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(word, a word before it in a toxic text), and (stem, toxic or not) of each text that has it twice."""
        rows: set[tuple[str, int]] = set()
        twice = np.zeros((len(stems), 2), np.int64)
        for b in batches:
            toxic = b["toxic"].to_numpy()
            for w in words(b["text"], PLAIN_WORDS):
                of = w.text_of_word()
                at, k, _ = (np.array(x, np.int64) for x in probe.hits(w))
                pair, n = np.unique(k * w.n_texts + of[at], return_counts=True)
                for x in pair[n >= 2].tolist():
                    twice[x // w.n_texts, int(toxic[w.row0 + x % w.n_texts] == 1)] += 1
                num = vocabulary.numbers(w)
                at = np.flatnonzero((num > 0) & (toxic[w.row0 + of] == 1))
                last = np.where((at > 0) & (of[at - 1] == of[at]), w.hash[at - 1].astype(np.int64), 0)
                rows.update(zip((vocabulary.words[k - 1].decode() for k in num[at].tolist()), last.tolist(), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.string()), pa.array([h for _, h in rows], pa.int64()), pa.array([0] * len(rows), pa.int64()), pa.array([0] * len(rows), pa.int64())], ["word", "before", "n", "n_toxic"])
        yield pa.RecordBatch.from_arrays([pa.array([f"{x}*" for x in stems], pa.string()), pa.array([0] * len(stems), pa.int64()), pa.array(twice.sum(1)), pa.array(twice[:, 1])], ["word", "before", "n", "n_toxic"])

    seen = sample.mapInArrow(look, "word string, before long, n long, n_toxic long").groupBy("word").agg(F.countDistinct("before").alias("n_before"), F.sum("n").alias("n"), F.sum("n_toxic").alias("n_toxic"))
    support = {r["word"]: r for r in seen.collect()}
    stems = [x for x in stems if support[f"{x}*"]["n_toxic"] >= max(least, 0.8 * support[f"{x}*"]["n"])]
    terms = [x for x in sorted(known, key=lambda x: (-found[x]["n_toxic"], x)) if x in support and support[x]["n_before"] >= max(contexts, min(15, 0.3 * found[x]["n_toxic"]))]
    return Lexicon([x for x in terms if not any(x.startswith(p) for p in stems)], stems)


#: Weights that the fit is drawn to where the sample says nothing: a misspelled hit weighs less than an exact
#: one, a quotation little.
PRIOR = np.array([3.0, 0.3, 2.0, 0.2, 1.0])


def fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic weights (the last one constant) by Newton's method, with a ridge toward PRIOR."""
    x = np.column_stack([np.log1p(x), np.ones(len(x))])
    mean, ridge = np.append(PRIOR, 0.0), np.append(np.ones(KINDS), 1e-3)
    w = mean.copy()
    w[-1] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)) if len(y) else -2.0
    mean[-1] = w[-1]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * (w - mean)
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-6:
            break
    w[:KINDS] = np.maximum(w[:KINDS], 0)
    return w


def neighbours_apart(sample: DataFrame, lexicon: Lexicon) -> list[int]:
    """Terms near which the sample's clean texts have words, not just now and then: words, not misspellings."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int]] = []
        for b in batches:
            toxic = b["toxic"].to_numpy()
            for w in words(b["text"], PLAIN_WORDS):
                place, term, distance = lexicon.hits(w)
                of = np.searchsorted(w.first, place, "right") - 1
                found += [(k, int(toxic[w.row0 + t])) for t, k in {(t, k) for t, k, d in zip(of.tolist(), term, distance, strict=True) if d > 0}]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()), pa.array([t for _, t in found], pa.int64())], ["term", "toxic"])

    counts = sample.mapInArrow(count, "term long, toxic long").groupBy("term").agg(F.sum("toxic").alias("n_toxic"), F.count(F.lit(1)).alias("n"))
    return [r["term"] for r in counts.collect() if r["n"] - r["n_toxic"] > max(1, 0.3 * r["n"])]


def learn(docs: DataFrame, labels: DataFrame) -> tuple[Lexicon, np.ndarray]:
    sample = labelled_sample(docs, labels)
    lexicon = learn_lexicon(sample)
    lexicon = Lexicon(lexicon.terms, lexicon.stems, neighbours_apart(sample, lexicon))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.concatenate([np.zeros((0, KINDS)), *(features(w, lexicon) for w in words(b["text"], PLAIN_WORDS))])
            yield pa.RecordBatch.from_arrays([*(pa.array(x[:, j]) for j in range(KINDS)), b["toxic"]], [*names, "toxic"])

    names = [f"x{j}" for j in range(KINDS)]
    found = sample.mapInArrow(measure, "".join(f"{x} double, " for x in names) + "toxic int").toPandas()  # SAMPLE_ROWS rows
    return lexicon, fit(found[names].to_numpy(), found["toxic"].to_numpy(float))


def score(docs: DataFrame, lexicon: Lexicon, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score, predicted, n_hits."""
    parts = lexicon.terms, lexicon.stems, lexicon.exact_only

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Lexicon(*parts)
        for b in batches:
            x = np.concatenate([np.zeros((0, KINDS)), *(features(w, own) for w in words(b["text"], PLAIN_WORDS))])
            p = 1 / (1 + np.exp(-np.clip(np.log1p(x) @ weights[:KINDS] + weights[KINDS], -30, 30)))
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(x.sum(1).astype(np.int64))], ["id", "score", "predicted", "n_hits"])

    rows = docs.select(docs[id_col].alias("id"), text_of(docs, text_col).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double, predicted int, n_hits long")


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's rows: doc_id, held_out, score, predicted."""
    found = score(docs, *learn(docs, labels))
    return found.select(F.col("id").alias("doc_id"), (fold(F.col("id"), 5) == 0).alias("held_out"), "score", "predicted", "n_hits")
