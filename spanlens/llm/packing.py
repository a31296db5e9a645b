"""Best-fit packing by a configuration linear program over the length histogram.

Only counts of lengths (at most ``capacity`` of them) reach the driver. Long lengths are grouped, each group standing
for its longest, and the program over configurations of groups - fill every group's demand with as few sequences as can
be - is solved by multiplicative weights: groups still short of demand gain weight, and a knapsack dynamic program
prices configurations under the weights, the best one for each group at a time. The program's multiples are rounded down, and
best fit places what they leave open and, last, the short lengths, which are sand for the room that is left. Grouping
wastes room where sand is scarce, so the multiples are also tried in part, and the plan of fewest sequences is taken.
It is a list of runs of equal placements, bounded by the number of lengths and configurations whatever the number of
documents; pieces find their place in it by their rank among pieces of their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import slices
from .shared import release, stored
from .tokens import load

GROUPS, EPSILON, RANK_BUCKETS, MOST_ROUNDS = 64, 0.25, 256, 20_000
SAND, KEEP = 16, (1, 0.75, 0.5, 0.25, 0.1, 0.05, 0.02)  # lengths up to this part of the capacity are sand; parts of the multiples that are tried
CACHE = 400_000, 120_000  # words and parts that the tokenizer keeps: scans and windows need the memory


def _table(value: np.ndarray, size: np.ndarray, room: int, most: np.ndarray | None = None) -> np.ndarray:
    """Most value of items (repeats allowed, up to ``most`` of each) that fit in each room."""
    best = np.zeros(room + 1)
    for i, (v, n) in enumerate(zip(value.tolist(), size.tolist(), strict=True)):
        for _ in range(room // n if most is None else min(room // n, int(most[i]))):
            np.maximum(best[n:], best[:-n] + v, out=best[n:])
    return best


def _trace(best: np.ndarray, value: np.ndarray, size: np.ndarray, room: int) -> np.ndarray:
    """Counts of the items behind ``best`` at a room, of a table with repeats."""
    counts = np.zeros(len(size), dtype=np.int64)
    while True:
        fits = np.flatnonzero((size <= room) & (value > 0))
        if not len(fits) or best[room] <= 0:
            return counts
        gain = value[fits] + best[room - size[fits]]
        top = int(gain.argmax())
        if gain[top] < best[room] * (1 - 1e-9):  # the best leaves room over
            room -= 1
            continue
        counts[fits[top]] += 1
        room -= int(size[fits[top]])


def price(weight: np.ndarray, size: np.ndarray, room: int) -> list[np.ndarray]:
    """For each item the configuration of most weight that holds it."""
    best = _table(weight, size, room)
    out = []
    for i in range(len(size)):
        counts = _trace(best, weight, size, room - int(size[i]))
        counts[i] += 1
        out.append(counts)
    return out


def solve(demand: np.ndarray, size: np.ndarray, room: int) -> list[tuple[np.ndarray, float]]:
    """Configurations and multiples that together cover the demand, near the fewest (fractional covering)."""
    goal = np.log(max(2, len(demand))) / EPSILON**2
    covered, used = np.zeros(len(demand)), np.zeros(0)
    pool, known = np.zeros((0, len(demand)), dtype=np.int64), set()
    for turn in range(MOST_ROUNDS):
        short = covered < goal
        if not short.any():
            break
        weight = np.where(short, np.exp(-EPSILON * (covered - covered[short].min())), 0.0) / demand
        if turn % max(1, len(demand) // 2) == 0:
            new = [c for c in {c.tobytes(): c for c in price(weight * demand.max(), size, room)}.values() if c.tobytes() not in known]
            known |= {c.tobytes() for c in new}
            pool, used = np.concatenate([pool, *[c[None] for c in new]]), np.append(used, np.zeros(len(new)))
            steps = np.where(pool > 0, demand / np.maximum(pool, 1), np.inf).min(axis=1)
            shares = pool / demand
        top = int((pool @ weight).argmax())
        covered += steps[top] * shares[top]
        used[top] += steps[top]
    return [(pool[i], used[i] / max(covered.min(), 1e-9)) for i in np.flatnonzero(used).tolist()]


class Plan:
    """Runs of equal placements: rank0.. of a length go ``per`` to a sequence from ``sequence`` on, at ``offset``."""

    def __init__(self, histogram: dict[int, int], capacity: int) -> None:
        self.capacity, self.sequences, self.configured = capacity, 0, 0  # configured: pieces placed by the program
        self.left = {k: v for k, v in histogram.items() if v > 0}
        self.rank: dict[int, int] = {}
        self.runs: list[tuple[int, int, int, int, int, int]] = []  # length, rank0, count, per, sequence, offset
        self.open: dict[int, list[tuple[int, int]]] = {}  # room left -> runs of sequences

    def _put(self, length: int, sequence: int, sequences: int, per: int, offset: int) -> None:
        rank, n = self.rank.get(length, 0), sequences * per
        self.runs.append((length, rank, n, per, sequence, offset))
        self.rank[length] = rank + n
        self.left[length] -= n

    def _keep(self, room: int, sequence: int, sequences: int) -> None:
        if sequences and room:
            self.open.setdefault(room, []).append((sequence, sequences))

    def configure(self, lengths: list[int], times: int) -> None:
        """``times`` sequences of these lengths."""
        sequence, offset = self.sequences, 0
        self.sequences += times
        for length in sorted(set(lengths), reverse=True):
            per = lengths.count(length)
            self._put(length, sequence, times, per, offset)
            offset += per * length
        self._keep(self.capacity - offset, sequence, times)

    def best_fit(self) -> None:
        """Place all that is left, longest first, each where the least room stays."""
        rooms = np.zeros(self.capacity + 1, dtype=bool)
        rooms[list(self.open)] = True
        for length in sorted((k for k, v in self.left.items() if v), reverse=True):
            while self.left[length]:
                fit = np.flatnonzero(rooms[length:])
                if len(fit):
                    room = int(fit[0]) + length
                    sequence, sequences = self.open[room].pop()
                    if not self.open[room]:
                        del self.open[room]
                        rooms[room] = False
                else:
                    room, sequence = self.capacity, self.sequences
                    sequences = max(1, self.left[length] // (self.capacity // length))
                    self.sequences += sequences
                per = min(room // length, self.left[length])
                take = min(sequences, self.left[length] // per)
                self._put(length, sequence, take, per, self.capacity - room)
                for r, s, n in ((room - per * length, sequence, take), (room, sequence + take, sequences - take)):
                    if n and r:
                        self._keep(r, s, n)
                        rooms[r] = True

    def arrays(self) -> tuple[np.ndarray, ...]:
        runs = np.array(sorted(self.runs), dtype=np.int64).reshape(-1, 6)
        return tuple(runs[:, i] for i in range(6))


def _grouped(lengths: list[int], counts: list[int]) -> list[list[int]]:
    """Lengths (longest first) in at most GROUPS runs of about equal counts."""
    if len(lengths) <= GROUPS:
        return [[x] for x in lengths]
    upto = np.cumsum(counts)
    at = np.minimum((upto - 1) * GROUPS // upto[-1], GROUPS - 1)
    return [[lengths[i] for i in np.flatnonzero(at == g)] for g in np.unique(at)]


def program(histogram: dict[int, int], capacity: int) -> tuple[list[list[int]], list[tuple[np.ndarray, float]]]:
    """Groups of the long lengths, and the program's configurations of groups with their multiples."""
    long = sorted((x for x, n in histogram.items() if n and x > capacity // SAND), reverse=True)
    if not long:
        return [], []
    groups = _grouped(long, [histogram[x] for x in long])
    demand = np.array([float(sum(histogram[x] for x in g)) for g in groups])
    found = solve(demand, np.array([g[0] for g in groups], dtype=np.int64), capacity)
    return groups, sorted(found, key=lambda c: -c[1])


def rounded(histogram: dict[int, int], capacity: int, groups: list[list[int]], found: list[tuple[np.ndarray, float]], keep: float) -> Plan:
    """Whole numbers of ``keep`` times the multiples, then best fit."""
    out = Plan(histogram, capacity)
    for counts, times in found:
        many = int(times * keep + 1e-6)
        while many > 0:
            lengths: list[int] = []
            for at in np.flatnonzero(counts).tolist():
                need = int(counts[at])
                for length in groups[at]:
                    got = min(need, max(0, out.left[length] - lengths.count(length)))
                    lengths += [length] * got
                    need -= got
                    if not need:
                        break
            if len(lengths) < counts.sum():
                break
            run = max(1, min(many, *(out.left[x] // lengths.count(x) for x in set(lengths))))
            out.configure(lengths, run)
            many -= run
    out.configured = sum(r[2] for r in out.runs)
    out.best_fit()
    return out


def plan(histogram: dict[int, int], capacity: int) -> Plan:
    """The program's plan of fewest sequences, the largest part of its multiples first; plain best fit if that has fewer."""
    least = -(-sum(k * n for k, n in histogram.items()) // capacity)
    groups, found = program(histogram, capacity)
    best: Plan | None = None
    for keep in (*KEEP, 0):
        own = rounded(histogram, capacity, groups, found, keep)
        best = own if best is None or own.sequences < best.sequences else best
        if best.sequences == least:
            break
    return best


def _pieces(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(path, *CACHE)
        names, types = ["doc", "piece", "start", "length", "ids_crc32"], [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        for batch in batches:
            for a, b in slices(batch.column(1), 1 << 20):
                flat, bounds = tokenizer.encode(batch.column(1).slice(a, b - a), end_id)
                data, out, rows = memoryview(flat).cast("B"), [], []
                for row, (low, high) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                    for n, start in enumerate(range(low, high, capacity)):
                        stop = min(start + capacity, high)
                        rows.append(row)
                        out.append((n, start - low, stop - start, zlib.crc32(data[4 * start : 4 * stop])))
                docs = batch.column(0).slice(a, b - a).take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([docs, *[pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]], names)
            pa.default_memory_pool().release_unused()

    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id_col, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its text's ids and end_id (a null or empty text: end_id alone); only one longer than ``capacity`` is
    cut, into pieces of that length and a rest. Sequences are filled without gaps from 0. Null ids are kept, and rows
    that repeat an id are packed each for itself. Other columns are left out. An empty table gives no rows.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    pieces = stored(base.mapInArrow(_pieces(tokenizer_path, capacity, end_id), "doc long, piece int, start long, length long, ids_crc32 long"), "pieces", 500)
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    sent = spark.sparkContext.broadcast(plan(histogram, capacity).arrays())
    rows = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc", "piece", "ids_crc32"), F.lit(RANK_BUCKETS)))
    order = Window.partitionBy("length", "bucket").orderBy("doc", "piece", "ids_crc32", "start")
    upto = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("length", "bucket").count().select("length", "bucket", F.coalesce(F.sum("count").over(upto), F.lit(0)).alias("base"))
    ranked = rows.withColumn("rank", F.row_number().over(order) - 1).join(sums, ["length", "bucket"])
    ranked = ranked.select("doc", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("base")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, rank0, _, per, sequence, offset = sent.value
        shift = 2**48  # ranks of one length stay far below
        key = length * shift + rank0
        for batch in batches:
            own, rank = (batch.column(i).to_numpy() for i in (3, 5))
            at = np.searchsorted(key, own * shift + rank, side="right") - 1
            n = rank - rank0[at]
            columns = [*batch.columns[:5], pa.array(sequence[at] + n // per[at]), pa.array(offset[at] + n % per[at] * own)]
            yield pa.RecordBatch.from_arrays(columns, ["doc", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    release(spark)
    schema = "doc long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.mapInArrow(place, schema).withColumnRenamed("doc", id_col)
