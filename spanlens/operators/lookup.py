"""Which names stand in which sentences, found inside each row, so that no table of pairs of names and sentences is made.

All names go into one bitmap of hashes of their UTF-8 bytes (whole names, and prefixes of 1, 2, 4, ... bytes). A position
of a sentence stays in the race while its prefixes are in the bitmap. The bitmap lets some strings through that are no
names, never loses one, and has a fixed size, so callers join what it lets through with the names themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlens.operators.roles import cover_lists

BITS = 26
_rng = np.random.default_rng(20)
_BYTE = _rng.integers(1, 2**64, 256, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_MIX, _PREFIX = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC2B2AE3D27D4EB4F)
CHUNK = 1 << 18


class Hashed:
    """Hashes of any stretch of some bytes."""

    def __init__(self, data: np.ndarray) -> None:
        n = len(data)
        self.up = np.append(np.uint64(1), np.cumprod(np.full(n, _STEP)))
        down = np.append(np.uint64(1), np.cumprod(np.full(n, _BACK)))[:n]
        self.sums = np.append(np.uint64(0), np.cumsum(_BYTE[data] * down))

    def of(self, start: np.ndarray, length) -> np.ndarray:
        x = (self.sums[start + length] - self.sums[start]) * self.up[start] + np.asarray(length).astype(np.uint64) * _PREFIX
        x ^= x >> np.uint64(32)
        x *= _MIX
        return x ^ (x >> np.uint64(29))


def _spots(hashes: np.ndarray, whole: bool) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each hash."""
    h = hashes if whole else hashes * _PREFIX
    return (h >> np.uint64(64 - BITS)).astype(np.int64), (h & np.uint64(2**BITS - 1)).astype(np.int64)


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Their bytes, and where each begins (and the last ends)."""
    texts = texts.cast(pa.large_binary())
    at = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or at[-1] == at[0]:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(texts) + 1, dtype=np.int64)
    return np.frombuffer(texts.buffers()[2], dtype=np.uint8)[at[0] : at[-1]], at - at[0]


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows for what is planned inside (run or persisted), as whole texts are long."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _chunks(at: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes."""
    low = 0
    while low < len(at) - 1:
        high = max(low + 1, int(np.searchsorted(at, at[low] + most, side="right")) - 1)
        yield low, high
        low = high


class Names:
    """The bitmap of a column of names, and the lengths that they have in bytes."""

    def __init__(self, words: np.ndarray, lengths: np.ndarray) -> None:
        self.words, self.lengths = words, lengths

    def may_hold(self, hashes: np.ndarray, whole: bool) -> np.ndarray:
        a, b = _spots(hashes, whole)
        one = lambda x: (self.words[x >> 6] >> (x & 63).astype(np.uint64)) & np.uint64(1)
        return (one(a) & one(b)).astype(bool)

    def starts(self, text: Hashed, at: np.ndarray, end: np.ndarray, stops: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """(position, length) of all that may be names among ``at``; ``end``: of each one's row; ``stops``: where a name may end."""
        found, level = [], 1
        while len(at) and level <= (self.lengths[-1] if len(self.lengths) else 0):
            at, end = (x[at + level <= end] for x in (at, end))
            on = self.may_hold(text.of(at, level), False)
            at, end = at[on], end[on]
            for n in self.lengths[np.searchsorted(self.lengths, level) : np.searchsorted(self.lengths, 2 * level)].tolist():
                one = at[at + n <= end]
                one = one if stops is None else one[stops[one + n]]
                one = one[self.may_hold(text.of(one, n), True)]
                found.append((one, np.full(len(one), n)))
            level *= 2
        return tuple(np.concatenate([x[i] for x in found]).astype(np.int64) if found else np.zeros(0, dtype=np.int64) for i in range(2))


def names_of(rows: DataFrame, tasks: int | None = None, column: str = "name", prefixes: bool = True) -> Names:
    """The bitmap of a column; repeated names do no harm.

    Each task sends its own bitmap, as far as it is filled, so what is exchanged grows with ``tasks``, to which the rows
    are drawn together. Without ``prefixes`` it is for whole strings only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, lengths = np.zeros(2**BITS >> 6, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        for batch in batches:
            data, at = _bytes(batch.column(0))
            for low, high in _chunks(at):
                text, start, size = Hashed(data[at[low] : at[high]]), at[low:high] - at[low], np.diff(at[low : high + 1])
                start, size = start[size > 0], size[size > 0]
                bits, level = [*_spots(text.of(start, size), True)], 1
                while prefixes and (some := size >= level).any():
                    bits += _spots(text.of(start[some], level), False)
                    level *= 2
                bits = np.unique(np.concatenate(bits))
                word, first = np.unique(bits >> 6, return_index=True)
                if len(first):
                    words[word] |= np.bitwise_or.reduceat(np.uint64(1) << (bits & 63).astype(np.uint64), first)
                lengths = np.union1d(lengths, size)
        word = np.flatnonzero(words)
        for low in range(0, len(word), CHUNK >> 4):
            some = word[low : low + (CHUNK >> 4)]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(words[some].view(np.int64))], ["word", "bits"])
        yield pa.RecordBatch.from_arrays([pa.array(-lengths), pa.array(np.zeros(len(lengths), dtype=np.int64))], ["word", "bits"])

    named = rows.select(column).where(F.col(column).isNotNull())
    got = (named.coalesce(tasks) if tasks else named).mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    word, bits = got.column("word").to_numpy(), got.column("bits").to_numpy()
    words = np.zeros(2**BITS >> 6, dtype=np.uint64)
    words[word[word >= 0]] = bits[word >= 0].view(np.uint64)
    return Names(words, np.sort(-word[word < 0]))


class _Rows:
    """Some sentences as bytes, with their tokens (runs between single spaces)."""

    def __init__(self, data: np.ndarray, at: np.ndarray) -> None:
        self.data, self.at, self.text, self.raw = data, at, Hashed(data), data.tobytes()
        full = at[:-1][np.diff(at) > 0]
        space = data == 32
        begins = np.zeros(len(data) + 1, dtype=bool)
        begins[1:][space] = True
        begins[full] = True
        self.stops = np.append(space, True)
        self.stops[at[1:]] = True
        self.first = np.flatnonzero(begins[: len(data)])
        ends = np.flatnonzero(self.stops)
        self.last = ends[np.searchsorted(ends, self.first, side="right")]
        self.row = np.searchsorted(at, self.first, side="right") - 1
        self.codes = self.text.of(self.first, self.last - self.first)

    def distinct(self, p: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The first of equal strings in each row: position, length, row."""
        order = np.argsort(p, kind="stable")
        p, n = p[order], n[order]
        row = np.searchsorted(self.at, p, side="right") - 1
        _, keep = np.unique(self.text.of(p, n) + row.astype(np.uint64) * _STEP, return_index=True)
        keep.sort()
        return p[keep], n[keep], row[keep]


def _lists(batch: pa.RecordBatch, column: int, low: int, high: int) -> np.ndarray:
    return batch.column(column).slice(low, high - low).flatten().to_numpy(zero_copy_only=False)


def _ends(rows: DataFrame) -> list[str]:
    """What ``_cover`` needs, third and later in a batch."""
    return ["cover"] if "cover" in rows.columns else ["ents.s", "ents.e"]


def _cover(batch: pa.RecordBatch, low: int, high: int, t: _Rows) -> np.ndarray:
    """``roles.covered`` of the tokens, made here if the rows have only entities, which saves a Python worker a task."""
    if batch.schema.names[2] == "cover":
        return _lists(batch, 2, low, high)
    size = np.diff(np.searchsorted(t.row, np.arange(high - low + 1)))
    return cover_lists(pa.array(size), *(batch.column(i).slice(low, high - low) for i in (2, 3))).flatten().to_numpy()


def free_names(rows: DataFrame, names: Names) -> DataFrame:
    """(name, id, s, e, copies): what may be names, where it first occurs in a sentence as a string, if that is at tokens.

    rows(id, sentence, cover), as of ``roles.covered``, or with ents for cover; the sentence is its tokens with one space between them. Each
    token needs another role than entity somewhere in the sentence; copies is 2 for one token that is both others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = _bytes(batch.column(1))
            ids = batch.column(0).to_numpy()
            for low, high in _chunks(at):
                t = _Rows(data[at[low] : at[high]], at[low : high + 1] - at[low])
                cover = _cover(batch, low, high, t)
                _, same = np.unique(t.codes + t.row.astype(np.uint64) * _STEP, return_inverse=True)
                other, beside = (np.bincount(same, weights=x, minlength=1) > 0 for x in (cover == 0, cover < 0))
                kinds = (other.astype(np.int64) + beside)[same] if len(same) else np.zeros(0, dtype=np.int64)
                free = kinds > 0
                begin = t.first[free]
                p, n = names.starts(t.text, begin, t.at[1:][t.row[free]], t.stops)
                s, e = np.searchsorted(t.first, p), np.searchsorted(t.first, p + n) - 1
                bound = np.append(0, np.cumsum(~free))
                on = bound[e + 1] == bound[s]
                p, n, row = t.distinct(p[on], n[on])
                s, e = np.searchsorted(t.first, p), np.searchsorted(t.first, p + n) - 1
                base = np.searchsorted(t.row, row)
                copies = np.where(s == e, kinds[s], 1) if len(s) else s
                found = [t.raw[a : a + m] for a, m in zip(p.tolist(), n.tolist(), strict=True)]
                good = np.array([t.raw.find(x, a, b) == c for x, a, b, c in zip(found, t.at[row].tolist(), t.at[row + 1].tolist(), p.tolist(), strict=True)], dtype=bool)
                columns = [pa.array(found, pa.binary()).cast(pa.string()), pa.array(ids[low:high][row]), pa.array((s - base).astype(np.int32)), pa.array((e - base).astype(np.int32)), pa.array(copies.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["name", "id", "s", "e", "copies"]).filter(pa.array(good))

    return rows.select("id", "sentence", *_ends(rows)).mapInArrow(run, "name string, id long, s int, e int, copies long")


def named_starts(rows: DataFrame, names: Names, whole: bool = False) -> DataFrame:
    """(id, name, spots, aligned): what may be names and is in a sentence as a string, anywhere, and its first token's places.

    rows(id, sentence, cover or ents); spots are the places that no entity covers, aligned says where the name itself stands.
    Names whose first token has no such place are left out. ``whole``: only names that stand at whole tokens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = _bytes(batch.column(1))
            ids = batch.column(0).to_numpy()
            for low, high in _chunks(at):
                t = _Rows(data[at[low] : at[high]], at[low : high + 1] - at[low])
                cover = _cover(batch, low, high, t)
                bounds = np.append(t.data & 0xC0 != 0x80, True)  # of characters: what the bitmap lets through must be text, too
                every, stops = (t.first, t.stops) if whole else (np.flatnonzero(bounds[:-1]), bounds)
                end = t.at[1:][t.row] if whole else np.repeat(t.at[1:], np.diff(t.at))[every]
                p, n, row = t.distinct(*names.starts(t.text, every, end, stops))
                ends = np.flatnonzero(t.stops)
                one = np.minimum(ends[np.searchsorted(ends, p, side="right")] - p, n)
                mine = t.codes + t.row.astype(np.uint64) * _STEP
                open_ = np.flatnonzero(cover <= 0)
                order = open_[np.argsort(mine[open_], kind="stable")]
                key = t.text.of(p, one) + row.astype(np.uint64) * _STEP
                a, b = (np.searchsorted(mine[order], key, side=side) for side in ("left", "right"))
                on = b > a
                p, n, row, a, b = (x[on] for x in (p, n, row, a, b))
                size = b - a
                which = np.repeat(np.arange(len(p)), size)
                spots = order[np.repeat(a - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())] if len(p) else np.zeros(0, dtype=np.int64)
                start, length = t.first[spots], n[which]
                stop = start + length
                fits = stop <= t.at[row[which] + 1]
                stop = np.where(fits, stop, start)
                same = fits & t.stops[stop] & (t.text.of(start, stop - start) == t.text.of(p[which], length))
                offsets = pa.array(np.append(0, np.cumsum(size)).astype(np.int32))
                found = pa.array([t.raw[x : x + m] for x, m in zip(p.tolist(), n.tolist(), strict=True)], pa.binary()).cast(pa.string())
                places = (spots - np.searchsorted(t.row, row[which])).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(ids[low:high][row]), found, pa.ListArray.from_arrays(offsets, pa.array(places)), pa.ListArray.from_arrays(offsets, pa.array(same))], ["id", "name", "spots", "aligned"])

    return rows.select("id", "sentence", *_ends(rows)).mapInArrow(run, "id long, name string, spots array<int>, aligned array<boolean>")


def edge_spots(rows: DataFrame, bitmaps: list[Names] | None) -> DataFrame:
    """(id, s, e, name, type, pos, token, edge): tokens in and beside the entities of rows(id, sentence, ents).

    edge: at or beside an end, and in no other entity. With the bitmaps of tokens wanted outside, inside, and inside
    wherever they stand, only what may be wanted: tokens outside are edges, those inside are edges or of the third kind.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = _bytes(batch.column(1))
            ids = batch.column(0).to_numpy()
            for low, high in _chunks(at):
                t = _Rows(data[at[low] : at[high]], at[low : high + 1] - at[low])
                cover = _cover(batch, low, high, t)
                own = [batch.column(i).slice(low, high - low) for i in (2, 3, 4, 5)]
                s, e = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in own[:2])
                many = own[0].value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                row, base = np.repeat(np.arange(high - low), many), np.searchsorted(t.row, np.arange(high - low + 1))
                a, b = np.maximum(s - 1, 0), np.minimum(e + 1, np.diff(base)[row] - 1)
                size = np.maximum(b - a + 1, 0)
                x = np.repeat(np.arange(len(s)), size)
                p = a[x] + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                g = base[row[x]] + p
                inside = (p >= s[x]) & (p <= e[x])
                edge = ((p <= s[x]) | (p >= e[x])) & (cover[g] <= inside)
                keep = edge | inside
                if bitmaps is not None:
                    out, in_, any_ = (y.may_hold(t.codes[g], True) for y in bitmaps)
                    keep = np.where(inside, (edge & in_) | any_, edge & out)
                x, p, g, edge = (y[keep] for y in (x, p, g, edge))
                which = pa.array(x)
                token = pa.array([t.raw[i:j] for i, j in zip(t.first[g].tolist(), t.last[g].tolist(), strict=True)], pa.binary()).cast(pa.string())
                columns = [pa.array(ids[low:high][row[x]]), pa.array(s[x].astype(np.int32)), pa.array(e[x].astype(np.int32)), *(y.flatten().take(which).cast(pa.string()) for y in own[2:]), pa.array(p.astype(np.int32)), token, pa.array(edge)]
                yield pa.RecordBatch.from_arrays(columns, ["id", "s", "e", "name", "type", "pos", "token", "edge"])

    return rows.select("id", "sentence", "ents.s", "ents.e", "ents.name", "ents.type").mapInArrow(run, "id long, s int, e int, name string, type string, pos int, token string, edge boolean")
