"""Best-fit packing: pieces against the tokenizer, bins against exhaustive search, on rows with nulls, ties and repeats."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerline.llm import best_fit

SCHEMA = "doc_id long, text string, grp string, place int, length string, sizes int"
LONG = " ".join(f"w{i % 977} x{i % 13}" for i in range(9_000))
ROWS = [(1, "one two"), (1, "one two"), (2, None), (3, ""), (None, "one two"), (None, None), (4, LONG), (5, LONG + " x"), (6, " \n "), *((10 + i, "word " * (i * 7 % 300)) for i in range(300))]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "g", 1, "l", 2) for i, t in ROWS], SCHEMA).repartition(3)


def ids_of(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode(text or "", add_special_tokens=False).ids, 1]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("group_pieces", [8192, 40])
def test_pieces_and_sequences(docs, group_pieces):
    rows = best_fit.pack_best_fit(docs, group_pieces=group_pieces).collect()
    want = Counter()
    for i, t in ROWS:
        ids = ids_of(t)
        want.update((i, k, 4096 * k, len(ids[a : a + 4096]), crc(ids[a : a + 4096])) for k, a in enumerate(range(0, len(ids), 4096)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    # no packing has fewer sequences
    assert len(bins) == -(-sum(r.length for r in rows) // 4096)


def test_empty_table_and_other_names(spark, docs):
    assert best_fit.pack_best_fit(docs.limit(0)).count() == 0
    own = spark.createDataFrame([("a", "one two three"), ("b", "four")], "key string, body string")
    rows = best_fit.pack_best_fit(own, id_col="key", text_col="body", capacity=3).collect()
    assert sorted((r.doc_id, r.piece, r.length) for r in rows) == [("a", 0, 3), ("a", 1, 1), ("b", 0, 2)] and len({r.sequence_id for r in rows}) == 2
    with pytest.raises(ValueError):
        best_fit.pack_best_fit(own, id_col="key", text_col="body", group_pieces=70_000)


def test_open_bins_meet_in_later_rounds(docs):
    """Groups of few pieces alone would waste half a sequence each, seven in all."""
    rows = best_fit.pack_best_fit(docs, group_pieces=25).collect()
    levels = {r.sequence_id >> 58 for r in rows if r.sequence_id >= 0}
    assert len(levels) > 1
    assert len({r.sequence_id for r in rows}) <= -(-sum(r.length for r in rows) // 4096) + 4


def fewest(sizes, capacity):
    sizes = tuple(sorted(sizes, reverse=True))

    @lru_cache(None)
    def possible(i, rooms):
        if i == len(sizes):
            return True
        return any(possible(i + 1, tuple(sorted(rooms[:k] + (room - sizes[i],) + rooms[k + 1 :]))) for k, room in enumerate(rooms) if room >= sizes[i] and room not in rooms[:k])

    n = -(-sum(sizes) // capacity)
    while not possible(0, (capacity,) * n):
        n += 1
    return n


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=11), st.integers(0, 5))
def test_evolution_finds_the_fewest_bins(sizes, seed):
    problem, rng = best_fit.Problem(np.array(sizes), 20), np.random.default_rng(seed)
    population = problem.evolve(problem.population(6, rng), [], 150, rng)
    for p in population:
        assert len(p) == len(sizes) and problem.loads(p).max() <= 20 and problem.loads(p).min() > 0
    assert problem.fitness(population[0])[0] == fewest(sizes, 20)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=60))
def test_best_fit_is_the_tightest_room(sizes):
    got = best_fit.best_fit(sizes, [], 100)
    loads: list[int] = []
    for s, b in zip(sizes, got, strict=True):
        rooms = [100 - x for x in loads if 100 - x >= s]
        assert (100 - loads[b] == min(rooms)) if rooms else b == len(loads)
        if b == len(loads):
            loads.append(0)
        loads[b] += s


def test_evolution_beats_best_fit_decreasing():
    """Where best fit of decreasing pieces leaves room, injected bins find packings with fewer bins."""
    fewer = 0
    for seed in range(6):
        rng = np.random.default_rng(seed)
        problem = best_fit.Problem(rng.integers(20, 100, 250), 150)
        population = problem.population(8, rng)
        decreasing = problem.fitness(population[0])[0]
        evolved = problem.fitness(problem.evolve(population, [], 300, rng)[0])[0]
        assert evolved <= decreasing
        fewer += evolved < decreasing
    assert fewer


def test_guests_replace_the_least_fit():
    rng = np.random.default_rng(0)
    problem = best_fit.Problem(np.array([6, 4, 5, 5, 3, 7]), 10)
    poor = [np.arange(6), np.arange(6)]
    assert problem.fitness(problem.evolve(poor, [np.array([0, 0, 1, 1, 2, 2])], 0, rng)[0]) == (3, -300)
