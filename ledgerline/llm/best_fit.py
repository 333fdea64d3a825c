"""Sequence packing into as few sequences as possible, by a grouping genetic algorithm on islands.

A document's ids end with the separator id. Only documents longer than a sequence are cut, into full sequences and a
last piece; full pieces are sequences of their own. All other pieces are dealt, by a hash of their place, into groups
of about GROUP_PIECES, and every group is a bin-packing problem of bounded size, held as a few arrays in one row.

Each group is solved by a grouping genetic algorithm, in which a gene is a whole bin. A population starts from best fits
of shuffled pieces and one of decreasing pieces. Crossover injects whole well-filled bins of one parent into the other,
removes the bins that hold a piece twice, dissolves some of the emptiest bins besides, and puts the displaced pieces,
longest first, where they fit best. Fewer bins are fitter; of as many, those whose fill is less even, because the room
left over then lies together. A group is evolved on several islands, each a task; after an epoch the best packing of
every island migrates to the next island, and the populations are written, so that a lost executor costs one epoch.

A group leaves its few emptiest bins open; the pieces of all groups' open bins are the pieces of the next round, which
has a thousandth of the groups, until one group is left. So no room is lost because the corpus was dealt into groups.

Token ids never leave the tokenising task: pieces are known there, and only (id, start, length, crc) goes on.

Defined results: a null or empty text is a document of the separator alone; a document of exactly one sequence is one
piece; repeated rows, and rows with null or equal ids, are documents of their own; a table without rows gives no
pieces; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of, written
from .packing import MAX_TOKENS, Tokenise

SEPARATOR = 1
#: Pieces of one bin-packing problem, about; a bin's number within its group takes two bytes.
GROUP_PIECES = 8192
#: Tasks that groups are dealt to at most; beyond it a task solves several groups, one after the other.
MOST_TASKS = 10_000
ISLANDS, EPOCHS, POPULATION, CHILDREN = 3, 2, 6, 24
#: Bins that a crossover injects, and of the emptiest bins how many it dissolves besides, as shares of all bins.
INJECTED, DISSOLVED = 0.06, 0.04
#: Emptiest bins that a group hands on to the next round.
HANDED_ON = 2


def best_fit(sizes: list[int], load: list[int], capacity: int) -> list[int]:
    """Bin of each size in turn: the fullest one with room for it, else a new one. load is brought up to date.

    Rooms that some bin has are the bits of one number, so the tightest room is found by a shift.
    """
    held: dict[int, list[int]] = {}
    rooms = 0
    for b, used in enumerate(load):
        if room := capacity - used:
            if room in held:
                held[room].append(b)
            else:
                held[room] = [b]
                rooms |= 1 << room
    out = []
    for s in sizes:
        if fits := rooms >> s:
            room = s + (fits & -fits).bit_length() - 1
            own = held[room]
            b = own.pop()
            if not own:
                del held[room]
                rooms ^= 1 << room
        else:
            b, room = len(load), capacity
            load.append(0)
        load[b] += s
        if rest := room - s:
            if rest in held:
                held[rest].append(b)
            else:
                held[rest] = [b]
                rooms |= 1 << rest
        out.append(b)
    return out


class Problem:
    """One group's pieces. A packing is an array: the bin of each piece, bins numbered from 0 without gaps."""

    def __init__(self, sizes: np.ndarray, capacity: int):
        self.sizes, self.capacity = sizes.astype(np.int64), capacity
        total = int(self.sizes.sum())
        self.full, self.rest = divmod(total, capacity)

    def loads(self, packing: np.ndarray) -> np.ndarray:
        return np.bincount(packing, self.sizes, int(packing.max()) + 1 if len(packing) else 0).astype(np.int64)

    def fitness(self, packing: np.ndarray) -> tuple[int, int]:
        """Less is fitter."""
        loads = self.loads(packing)
        return len(loads), -int((loads * loads).sum())

    def perfect(self, fitness: tuple[int, int]) -> bool:
        """Every bin but one is full: no packing is fitter."""
        return fitness == (self.full + bool(self.rest), -(self.full * self.capacity**2 + self.rest**2))

    def packed(self, order: np.ndarray) -> np.ndarray:
        out = np.empty(len(order), np.int64)
        out[order] = best_fit(self.sizes[order].tolist(), [], self.capacity)
        return out

    def child(self, host: np.ndarray, donor: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """host with well-filled bins of the donor."""
        host_load, donor_load = self.loads(host), self.loads(donor)
        # a donor's bin is well filled when it is fuller than the bins of the host that it would displace, on the mean
        displaced = np.bincount(donor, host_load[host], len(donor_load)) / np.bincount(donor, minlength=len(donor_load))
        good = np.flatnonzero(donor_load >= np.maximum(displaced, np.median(donor_load)))
        injected = np.zeros(len(donor_load), bool)
        if len(good):
            injected[rng.choice(good, min(len(good), max(1, round(INJECTED * len(donor_load)))), replace=False)] = True
        moved = injected[donor]
        gone = np.zeros(len(host_load), bool)
        gone[host[moved]] = True
        part_full = np.flatnonzero(~gone & (host_load < self.capacity))
        worst = part_full[np.argsort(host_load[part_full], kind="stable")[: 2 * max(1, round(DISSOLVED * len(host_load)))]]
        gone[worst[rng.random(len(worst)) < 0.5]] = True
        out = np.where(moved, donor + len(host_load), np.where(gone[host], -1, host))
        kept, compact = np.unique(out, return_inverse=True)
        free = np.flatnonzero(out < 0)
        out = compact - (kept[0] < 0)
        load = np.bincount(out[out >= 0], self.sizes[out >= 0], len(kept) - (kept[0] < 0)).astype(np.int64).tolist()
        free = free[np.argsort(-self.sizes[free], kind="stable")]
        out[free] = best_fit(self.sizes[free].tolist(), load, self.capacity)
        return out

    def population(self, n: int, rng: np.random.Generator) -> list[np.ndarray]:
        return [self.packed(np.argsort(-self.sizes, kind="stable")), *(self.packed(rng.permutation(len(self.sizes))) for _ in range(n - 1))]

    def evolve(self, population: list[np.ndarray], guests: list[np.ndarray], children: int, rng: np.random.Generator) -> list[np.ndarray]:
        """The population, fittest first, after so many children; guests take the place of the least fit."""
        ranked = sorted(((self.fitness(p), i, p) for i, p in enumerate(population)), key=lambda x: x[:2])
        if guests:
            ranked = ranked[: len(population) - len(guests)] + [(self.fitness(g), len(population) + i, g) for i, g in enumerate(guests)]
            ranked.sort(key=lambda x: x[:2])
        for k in range(children):
            if self.perfect(ranked[0][0]) or len(ranked) < 2:
                break
            a, b = rng.choice(len(ranked), 2, replace=False)
            host, donor = min(a, b), max(a, b)
            if rng.random() < 0.5:
                host, donor = donor, host
            new = self.child(ranked[host][2], ranked[donor][2], rng)
            fit = self.fitness(new)
            if fit < ranked[-1][0] and all(fit != x[0] for x in ranked):
                ranked[-1] = (fit, 1_000 + k, new)
                ranked.sort(key=lambda x: x[:2])
        return [x[2] for x in ranked]


def _pieces(docs: DataFrame, tokenizer_path: str, id_col: str, text_col: str, capacity: int, separator: int) -> DataFrame:
    """place (unique), id, piece, start, length, crc."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenise, end = Tokenise(tokenizer_path), np.array([separator], "<u4").tobytes()
        place = TaskContext.get().partitionId() << 40
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                row, piece, length, crc = [], [], [], []
                for i, ids in enumerate(tokenise(part["text"])):
                    x = ids.astype("<u4").tobytes() + end
                    for k, begin in enumerate(range(0, len(x), 4 * capacity)):
                        y = x[begin : begin + 4 * capacity]
                        row.append(i)
                        piece.append(k)
                        length.append(len(y) // 4)
                        crc.append(zlib.crc32(y))
                n = len(row)
                starts = np.array(piece, np.int64) * capacity
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(place, place + n)), part["id"].take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(starts), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    ["place", "id", "piece", "start", "length", "crc"],
                )
                place += n

    rows = docs.select(docs[id_col].alias("id"), text_of(docs, text_col).alias("text"))
    return rows.mapInArrow(cut, f"place long, id {rows.schema['id'].dataType.simpleString()}, piece int, start long, length long, crc long")


def _tasks(n: int) -> int:
    return max(1, min(n, MOST_TASKS))


def _groups(items: DataFrame, n_groups: int) -> DataFrame:
    """(place, length) -> one row a group: grp, places (8 bytes each), sizes (4 bytes each), in order of place."""

    def gather(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The rows come sorted by group and place: one group at a time is held."""
        grp, held = None, []

        def row() -> pd.DataFrame:
            own = pd.concat(held)
            return pd.DataFrame({"grp": [grp], "places": [own["place"].to_numpy().astype("<i8").tobytes()], "sizes": [own["length"].to_numpy().astype("<i4").tobytes()]})

        for frame in frames:
            for g, own in frame.groupby("grp", sort=True):
                if g != grp and held:
                    yield row()
                    held = []
                grp = g
                held.append(own)
        if held:
            yield row()

    dealt = items.select("place", "length", F.pmod(F.xxhash64("place"), F.lit(n_groups)).alias("grp"))
    dealt = dealt.repartitionById(_tasks(n_groups), (F.col("grp") % _tasks(n_groups)).cast("int")).sortWithinPartitions("grp", "place")
    return dealt.mapInPandas(gather, "grp long, places binary, sizes binary")


def _solve(items: DataFrame, n_groups: int, capacity: int, level: int, more: bool) -> DataFrame:
    """place, length, sequence_id, offset, open."""
    groups = written(_groups(items, n_groups), "best-fit-groups")

    def epoch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                problem = Problem(np.frombuffer(r.sizes, "<i4"), capacity)
                n = len(problem.sizes)
                rng = np.random.default_rng([level, int(r.grp), int(r.island), int(r.epoch)])
                if r.population is None:
                    population, guests = problem.population(POPULATION, rng), []
                else:
                    population = list(np.frombuffer(r.population, "<u2").astype(np.int64).reshape(-1, n))
                    guests = [np.frombuffer(r.guest, "<u2").astype(np.int64)] if r.guest is not None else []
                population = problem.evolve(population, guests, CHILDREN, rng)
                bins, uneven = problem.fitness(population[0])
                yield pd.DataFrame({"grp": [r.grp], "island": [r.island], "sizes": [r.sizes], "population": [np.concatenate(population).astype("<u2").tobytes()], "elite": [population[0].astype("<u2").tobytes()], "bins": [bins], "uneven": [uneven]})

    state_schema = "grp long, island int, sizes binary, population binary, elite binary, bins long, uneven long"
    deal = lambda df: df.repartitionById(_tasks(n_groups * ISLANDS), ((F.col("grp") * ISLANDS + F.col("island")) % _tasks(n_groups * ISLANDS)).cast("int"))
    state = groups.select("grp", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), "sizes", F.lit(None).cast("binary").alias("population"), F.lit(None).cast("binary").alias("guest"))
    for k in range(EPOCHS):
        if k:
            travelled = state.select("grp", ((F.col("island") + 1) % ISLANDS).alias("island"), F.col("elite").alias("guest"))
            state = state.drop("elite", "bins", "uneven").join(travelled, ["grp", "island"])
        state = written(deal(state.withColumn("epoch", F.lit(k))).mapInPandas(epoch, state_schema), "best-fit-islands")
    best = state.groupBy("grp").agg(F.min_by("elite", F.struct("bins", "uneven", "island")).alias("elite"))

    def lay_out(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                places, sizes, bins = np.frombuffer(r.places, "<i8"), np.frombuffer(r.sizes, "<i4").astype(np.int64), np.frombuffer(r.elite, "<u2").astype(np.int64)
                loads = np.bincount(bins, sizes).astype(np.int64)
                open_ = np.zeros(len(loads), bool)
                if more:
                    emptiest = np.argsort(loads, kind="stable")[:HANDED_ON]
                    open_[emptiest[loads[emptiest] < capacity]] = True
                order = np.argsort(bins, kind="stable")
                ends = np.cumsum(sizes[order])
                first = np.concatenate([[0], np.cumsum(loads)])[bins[order]]
                yield pd.DataFrame({"place": places[order], "length": sizes[order], "sequence_id": (level << 58) + (int(r.grp) << 16) + bins[order], "offset": ends - sizes[order] - first, "open": open_[bins[order]]})

    return written(groups.join(best, "grp").mapInPandas(lay_out, "place long, length long, sequence_id long, offset long, open boolean"), "best-fit-bins")


def pack_best_fit(docs: DataFrame, tokenizer_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = MAX_TOKENS, separator: int = SEPARATOR, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Pieces of all documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Sequences of full pieces have negative numbers. group_pieces: at most 60,000.
    """
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    if not 0 < group_pieces <= 60_000:
        raise ValueError("group_pieces must lie between 1 and 60,000")
    pieces = written(_pieces(docs, tokenizer_path, id_col, text_col, capacity, separator), "best-fit-pieces")
    items = pieces.filter(F.col("length") < capacity).select("place", "length")
    done: list[DataFrame] = []
    n_groups, level = -(-items.count() // group_pieces), 0
    while n_groups:
        solved = _solve(items, n_groups, capacity, level, more=n_groups > 1)
        items = solved.filter("open").select("place", "length")
        next_groups = -(-items.count() // group_pieces)
        if next_groups >= n_groups:  # the open bins are most of the pieces: they stay as they are
            done.append(solved)
            break
        done.append(solved.filter(~F.col("open")))
        n_groups, level = next_groups, level + 1
    full = pieces.filter(F.col("length") == capacity).select("id", "piece", "start", "length", "crc", (-1 - F.col("place")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    out = full
    if done:
        bins = done[0]
        for more in done[1:]:
            bins = bins.unionByName(more)
        out = full.unionByName(pieces.filter(F.col("length") < capacity).join(bins.select("place", "sequence_id", "offset"), "place").select(*full.columns))
    return out.select(F.col("id").alias("doc_id"), "piece", "start", "length", F.col("crc").alias("ids_crc32"), "sequence_id", "offset")
