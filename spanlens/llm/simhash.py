"""SimHash near-duplicates over a Gray-order hierarchical index.

Fingerprints within ``radius`` bits agree on at least ``segments - radius`` of ``segments`` bit segments, so every link
shows in some table keyed by such a choice of segments; that deals the search out. The distinct fingerprints of one key
are sorted by Gray rank and cut into blocks. A block carries the bit pattern all its members share, so pairs of blocks
whose shared patterns already differ too much are never formed. Inside a pair of blocks the search walks a hierarchical
index: each upper node factors out the bits its members agree on, differences accumulate from the root down, and a
whole group goes as soon as its sum passes the radius. A pair of blocks returns a spanning forest of its links, never
all pairs, which leaves the components as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import acos, ceil, comb, log, log2, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import U, mix, raw, slices
from .components import components, forest, roots
from .shared import release, stored

FOLD = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
LEAF, FAN, BLOCK, QUERIES = 16, 8, 4096, 256


def shingle_hashes(text: bytes, width: int) -> list[int]:
    """XXH64 (seed 42) of each shingle of ``width`` words; shorter texts are one shingle, no words none."""
    words = text.translate(FOLD).split()
    if not words:
        return []
    line, ends, at = b" ".join(words), [], -1
    for word in words:
        at += len(word) + 1
        ends.append(at)
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(line, 42)]
    starts = [0, *[e + 1 for e in ends[: len(words) - width]]]
    digest = xxhash.xxh64_intdigest
    return [digest(line[a:b], 42) for a, b in zip(starts, ends[width - 1 :], strict=True)]


def _majority(hashes: np.ndarray, words: int) -> np.ndarray:
    ones = np.zeros(64 * words, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)]
        more = [part, *[mix(part + U(i * 0x9E3779B97F4A7C15 % 2**64)) for i in range(1, words)]]
        bits = np.unpackbits(np.stack(more, axis=1).view(np.uint8), axis=1, bitorder="little")
        for low in range(0, len(bits), 255):  # sums of 255 bits fit a byte
            ones += bits[low : low + 255].sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")


def fingerprints(texts: list[bytes], width: int) -> np.ndarray:
    """A bit is 1 if it is set in over half of the shingle hashes (XXH64)."""
    out = np.zeros((len(texts), 1), dtype="<u8")
    for row, text in enumerate(texts):
        out[row] = _majority(np.array(shingle_hashes(text, width), dtype="<u8"), 1)
    return out


def set_print(shingles: np.ndarray) -> np.ndarray:
    """WORDS words of bits of a set of shingle hashes, each counted once."""
    return _majority(shingles, WORDS)


def _fingerprint_rows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1)):
                data, at = raw(batch.column(1).slice(a, b - a))
                data = data.tobytes()
                prints = fingerprints([data[at[i] : at[i + 1]] for i in range(b - a)], width).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.ascontiguousarray(prints[:, 0]))], ["doc", "print"])

    return run


def gray_order(prints: np.ndarray) -> np.ndarray:
    """Order of fingerprints (rows of words, the first word highest) by Gray rank."""
    ranks, odd = [], np.zeros(len(prints), dtype=bool)
    for word in prints.T:
        rank = word.copy()
        for shift in (1, 2, 4, 8, 16, 32):
            rank ^= rank >> U(shift)
        rank[odd] = ~rank[odd]  # the words before hold an odd number of ones
        odd = (rank & U(1)).astype(bool)
        ranks.append(rank)
    return np.lexsort(ranks[::-1])


def _ones(x: np.ndarray) -> np.ndarray:
    """Ones of each fingerprint, of one word or of a row of words."""
    return np.bitwise_count(x).astype(np.int16) if x.ndim == 1 else np.bitwise_count(x).sum(axis=1, dtype=np.int16)


class GrayIndex:
    """Hierarchical index over fingerprints in Gray order: per level the shared bits of each node, less its parent's.

    Fingerprints are numbers or rows of words.
    """

    def __init__(self, prints: np.ndarray) -> None:
        self.prints = prints
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # from the leaves up: pattern, shared bits
        low, high, step = prints, prints, LEAF
        while True:
            at = np.arange(0, len(low), step)
            low, high = np.bitwise_and.reduceat(low, at), np.bitwise_or.reduceat(high, at)
            self.levels.append((low, ~(low ^ high)))
            if len(low) <= FAN:
                break
            step = FAN

    def search(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query index, print index) within the radius, a few queries at a time."""
        step = QUERIES if queries.ndim == 1 else QUERIES // 8  # rows of words take more room for each pair
        for start in range(0, len(queries), step):
            part = queries[start : start + step]
            pattern, shared = self.levels[-1]
            q, node = np.divmod(np.arange(len(part) * len(pattern)), len(pattern))
            gone = _ones((part[q] ^ pattern[node]) & shared[node])
            for level in range(len(self.levels) - 1, -1, -1):
                near = gone <= radius
                q, node, gone = q[near], node[near], gone[near]
                fan = FAN if level else LEAF
                above = self.levels[level][1]
                child = node[:, None] * fan + np.arange(fan)
                inside = child < (len(self.levels[level - 1][0]) if level else len(self.prints))
                own = np.broadcast_to(np.arange(len(node))[:, None], child.shape)[inside]
                q, gone, above, node = q[own], gone[own], above[node[own]], child[inside]
                pattern, shared = self.levels[level - 1] if level else (self.prints, None)
                fresh = ~above if shared is None else shared[node] & ~above
                gone = gone + _ones((part[q] ^ pattern[node]) & fresh)
            near = gone <= radius
            yield q[near] + start, node[near]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut rows sorted by (part, key, rank) into blocks of one key; lone fingerprints of keys inside the partition go."""
    from pyspark import TaskContext

    base, count, pending, first, done = TaskContext.get().partitionId() << 32, 0, None, True, None  # done: key of the last block
    names = ["part", "key", "block", "low", "shared", "prints"]

    def cut(part: np.ndarray, key: np.ndarray, prints: np.ndarray, last: bool) -> tuple[list, tuple]:
        nonlocal count, first, done
        head = np.ones(len(part), dtype=bool)
        head[1:] = (part[1:] != part[:-1]) | (key[1:] != key[:-1])
        at = np.append(np.flatnonzero(head), len(part))
        out, open_at = [], len(part)
        for i in range(len(at) - 1):
            a, b = int(at[i]), int(at[i + 1])
            if i == len(at) - 2 and not last:
                open_at = b - (b - a) % BLOCK if b - a >= BLOCK else a
                b = open_at
            elif b - a == 1 and not first and not last and (part[a], key[a]) != done:
                continue
            for s in range(a, b, BLOCK):
                own = prints[s : min(b, s + BLOCK)]
                low, high = np.bitwise_and.reduce(own), np.bitwise_or.reduce(own)
                out.append((int(part[a]), int(key[a]), base + count, int(low.view(np.int64)), int((~(low ^ high)).view(np.int64)), own.tobytes()))
                count += 1
            if b > a:
                first, done = False, (part[a], key[a])
        return out, (part[open_at:], key[open_at:], prints[open_at:])

    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    for batch in batches:
        new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
        new[2] = new[2].view(U)
        if pending is not None:
            new = [np.concatenate([x, y]) for x, y in zip(pending, new, strict=True)]
        out, pending = cut(*new, False)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names)
    if pending is not None and len(pending[0]):
        out, _ = cut(*pending, True)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names)


def _links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for left, right in zip(batch.column(0), batch.column(1), strict=True):
                one, two = np.frombuffer(left.as_py(), dtype=U), np.frombuffer(right.as_py(), dtype=U)
                both = np.concatenate([one, two])
                label = np.arange(len(both))
                for q, p in GrayIndex(two).search(one, radius):
                    q, p = label[q], label[p + len(one)]
                    label = roots(len(both), q, p)[label]
                other = both[label] != both
                a.append(both[other])
                b.append(both[label][other])
            x, y = np.concatenate(a), np.concatenate(b)
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], ["a", "b"])

    return run


def _choices(distinct: int, radius: int) -> list[int]:
    """Bit masks, one a table; more segments (longer keys, more tables) as the fingerprints grow in number."""
    segments = radius + 1
    while segments < 12 and distinct / 2 ** (64 * (segments - radius) // segments) > 8192:
        segments += 1
    edges = [ceil(64 * i / segments) for i in range(segments + 1)]
    bits = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(segments)]
    out = [sum(bits[i] for i in pick) for pick in combinations(range(segments), segments - radius)]
    assert len(out) == comb(segments, radius)
    return out


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def link_prints(prints: DataFrame, distinct: int, radius: int) -> DataFrame:
    """Spanning links (a, b) of the distinct fingerprints in prints(print) that differ in at most ``radius`` bits."""
    masks = F.array(*[F.lit(_signed(m)) for m in _choices(distinct, radius)])
    rank = F.col("print")
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, shift))
    rows = prints.select("print", rank.alias("rank"), F.posexplode(masks).alias("part", "mask"))
    rows = rows.select("part", F.col("mask").bitwiseAND(F.col("print")).alias("key"), "print", "rank")
    ordered = rows.repartitionByRange("part", "key", "rank").sortWithinPartitions("part", "key", "rank").select("part", "key", "print")
    blocks = stored(ordered.mapInArrow(_blocks, "part int, key long, block long, low long, shared long, prints binary"), "blocks")
    one, two = blocks.alias("one"), blocks.alias("two")
    differ = F.expr("bit_count((one.low ^ two.low) & one.shared & two.shared)")
    same = (F.col("one.part") == F.col("two.part")) & (F.col("one.key") == F.col("two.key"))
    pairs = one.join(two, same & (F.col("one.block") <= F.col("two.block")) & (differ <= radius))
    return pairs.select("one.prints", F.col("two.prints").alias("other")).mapInArrow(_links(radius), "a long, b long")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4) -> DataFrame:
    """One row per input row: id_col, fingerprint (16 hex digits), component_id (smallest id reachable by links).

    Null and empty texts have fingerprint zero and link like any other. Rows that repeat an id or a text share a
    fingerprint or a component. A null id keeps its row and never becomes a component's id; where a component has no
    other, component_id is null. Other columns are left out.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    known = stored(base.mapInArrow(_fingerprint_rows(width), "doc long, print long"), "fingerprints")
    prints = stored(known.groupBy("print").agg(F.min("doc").alias("low")), "prints")
    edges = stored(link_prints(prints.select("print"), prints.count(), radius).distinct(), "links")
    release(docs.sparkSession)
    root = components(edges)
    whole = prints.join(root, prints.print == root.node, "left").select("print", "low", F.coalesce("root", "print").alias("root"))
    named = whole.join(whole.groupBy("root").agg(F.min("low").alias("component")), "root").select("print", "component")
    return known.join(named, "print").select(F.col("doc").alias(id_col), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


WORDS, BAND_BITS, MISS, SMALL_KEY, KEY_BLOCK, SET_BYTES = 4, 18, 0.01, 32, 2048, 1 << 22


def _close(one: np.ndarray, two: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (index of one, index of two) within the limit, by a hierarchical index over two."""
    order = gray_order(two)
    for q, p in GrayIndex(two[order]).search(one, limit):
        yield q, order[p]


def _stars(ids: np.ndarray, a: list[np.ndarray], b: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Links (id, smallest id) with the components of the pairs a[i], b[i] of indexes."""
    names, number = np.unique(ids, return_inverse=True)
    label = names[roots(len(names), number[np.concatenate(a)], number[np.concatenate(b)])] if a else names
    other = label != names
    return names[other], label[other]


NEAR_SCHEMA = "a long, b long, band int, key long, block int, ids binary, prints binary"


def _near_rows(limit: int):
    """Of rows (band, key, id, prints) sorted by band and key: links, and blocks of the keys too large for one.

    All pairs of one key are compared, except those across two blocks, which ``_near_blocks`` compares.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending, cut = None, 0  # rows of the open key, and how many blocks of it are out
        schema = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
        names = ["a", "b", "band", "key", "block", "ids", "prints"]

        def work(rows: list[np.ndarray], last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal pending, cut
            band, key, ids = rows[:3]
            prints = np.stack(rows[3:], axis=1).view(U)
            head = np.ones(len(ids), dtype=bool)
            head[1:] = (band[1:] != band[:-1]) | (key[1:] != key[:-1])
            at = np.append(np.flatnonzero(head), len(ids))
            a, b, blocks, open_at = [], [], [], len(ids)
            for g in np.flatnonzero((np.diff(at) > SMALL_KEY) | (np.arange(len(at) - 1) == len(at) - 2) | ((np.arange(len(at) - 1) == 0) & (cut > 0))):
                start, end = int(at[g]), int(at[g + 1])
                done, still = (cut if g == 0 else 0), g == len(at) - 2 and not last
                if still:
                    open_at = end - (end - start) % KEY_BLOCK
                    end = open_at
                for low in range(start, end, KEY_BLOCK):
                    own = slice(low, min(end, low + KEY_BLOCK))
                    for x, y in _close(prints[own], prints[own], limit):
                        a.append(x[x < y] + low)
                        b.append(y[x < y] + low)
                    if done or still or end - start > KEY_BLOCK:  # the last rows of a cut key, even one row, are a block
                        blocks.append((int(band[low]), int(key[low]), done, ids[own].tobytes(), prints[own].tobytes()))
                        done += 1
                if g == len(at) - 2:
                    cut = done if still else 0
            sizes = np.diff(at)
            few = (sizes <= SMALL_KEY) & (sizes > 1)
            few[-1] = False
            small = np.repeat(few, sizes)
            end_of = np.repeat(at[1:], sizes)
            for step in range(1, SMALL_KEY):
                here = np.flatnonzero(small & (np.arange(len(ids)) + step < end_of))
                if not len(here):
                    break
                near = np.bitwise_count(prints[here] ^ prints[here + step]).sum(axis=1, dtype=np.int64) <= limit
                a.append(here[near])
                b.append(here[near] + step)
            pending = [x[open_at:] for x in rows]
            x, y = _stars(ids, a, b)
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), *[pa.nulls(len(x), t) for t in schema[2:]]], names)
            for block in blocks:
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((None, None, *block), schema, strict=True)], names)

        for batch in batches:
            if not len(batch):
                continue
            rows = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3 + WORDS)]
            if pending is not None and len(pending[0]):
                if cut and (pending[0][-1], pending[1][-1]) != (rows[0][0], rows[1][0]):
                    yield from work(pending, True)
                else:
                    rows = [np.concatenate([x, y]) for x, y in zip(pending, rows, strict=True)]
            elif cut and (rows[0][0], rows[1][0]) != open_key:
                cut = 0
            open_key = (rows[0][-1], rows[1][-1])
            yield from work(rows, False)
        if pending is not None and len(pending[0]):
            yield from work(pending, True)

    return run


def _near_blocks(limit: int):
    """Links of all pairs across two blocks of one key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                ids = [np.frombuffer(x, dtype=np.int64) for x in row[:2]]
                one, two = (np.frombuffer(x, dtype=U).reshape(-1, WORDS) for x in row[2:])
                near = [(x, y + len(one)) for x, y in _close(one, two, limit)]
                x, y = _stars(np.concatenate(ids), [n[0] for n in near], [n[1] for n in near])
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])

    return run


def near_links(dealt: DataFrame, limit: int) -> DataFrame:
    """Links (a, b) with the components of all pairs within the limit among the rows of each key.

    ``dealt`` has band, key, an id and WORDS columns of bits. The blocks of a key that fills more than one are paired
    and the pairs dealt out anew, so that no task compares a large key alone.
    """
    dealt = dealt.repartitionByRange("band", "key").sortWithinPartitions("band", "key")
    out = stored(dealt.mapInArrow(_near_rows(limit), NEAR_SCHEMA), "near")
    blocks = out.where("block is not null")
    one, two = blocks.alias("one"), blocks.alias("two")
    same = (F.col("one.band") == F.col("two.band")) & (F.col("one.key") == F.col("two.key")) & (F.col("one.block") < F.col("two.block"))
    pairs = one.join(two, same).select("one.ids", F.col("two.ids").alias("ids2"), "one.prints", F.col("two.prints").alias("prints2"), "one.band", "one.key", "one.block", F.col("two.block").alias("block2"))
    pairs = pairs.repartition("band", "key", "block", "block2").select("ids", "ids2", "prints", "prints2")
    return out.where("block is null").select("a", "b").union(pairs.mapInArrow(_near_blocks(limit), "a long, b long"))


def _shingle_rows(width: int, sets: bool):
    """(doc, node) of each text, node being a hash of its set of shingles, with the set or else its WORDS of bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1)):
                data, at = raw(batch.column(1).slice(a, b - a))
                data = data.tobytes()
                own = [np.unique(np.array(shingle_hashes(data[at[i] : at[i + 1]], width), dtype=U)) for i in range(b - a)]
                node = pa.array(np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in own], dtype=U).view(np.int64))
                if sets:
                    rest, names = [pa.array([x.tobytes() for x in own], pa.binary())], ["set"]
                else:
                    prints = np.stack([set_print(x) for x in own]).view(np.int64)
                    rest, names = [pa.array(np.ascontiguousarray(prints[:, i])) for i in range(WORDS)], [f"f{i}" for i in range(WORDS)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), node, *rest], ["doc", "node", *names])

    return run


def linked(sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links (index, index) with the components of all pairs of sets whose Jaccard is ``similarity`` or more.

    Each set is held once against all that no set has reached yet, which leaves no pair out: those reached before are
    in a component already.
    """
    sizes = np.array([len(x) for x in sets])
    _, number = np.unique(np.concatenate(sets), return_inverse=True)
    at = np.concatenate([[0], np.cumsum(sizes)])
    parts = [number[at[i] : at[i + 1]] for i in range(len(sets))]
    marked = np.zeros(int(number.max(initial=-1)) + 1, dtype=bool)
    left = np.arange(len(sets))
    flat = number
    a, b, queue = [], [], []
    while len(left):
        if not queue:
            if len(left) == 1:
                break
            queue.append(int(left[0]))
            left, flat = left[1:], flat[sizes[left[0]] :]
        one = queue.pop()
        marked[parts[one]] = True
        both = np.add.reduceat(np.append(marked[flat], False), np.cumsum(sizes[left]) - sizes[left], dtype=np.int64)
        both[sizes[left] == 0] = 0
        marked[parts[one]] = False
        either = sizes[one] + sizes[left] - both
        near = both >= similarity * either - 1e-9
        if near.any():
            a += [one] * int(near.sum())
            b += left[near].tolist()
            queue += left[near].tolist()
            flat = flat[np.repeat(~near, sizes[left])]
            left = left[~near]
    return np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)


def _verified(similarity: float):
    """Links of the sets in one block, or in two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                nodes = np.array([n for i in range(0, batch.num_columns, 2) for n in batch.column(i)[row].as_py()], dtype=np.int64)
                sets = [np.frombuffer(x, dtype=U) for i in range(1, batch.num_columns, 2) for x in batch.column(i)[row].as_py()]
                a, b = linked(sets, similarity)
                yield pa.RecordBatch.from_arrays([pa.array(nodes[a]), pa.array(nodes[b])], ["a", "b"])

    return run


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id_col, component_id) of near duplicates: ``similarity`` or more of their ``width``-word shingles (Jaccard).

    Four words of SimHash bits of the set of shingles find candidates; the limit of differing bits is that of
    ``similarity`` and 2.6 standard deviations more. Bands are as many as leave a pair at the similarity unseen with
    probability MISS. In a band, all rows of one key are held against each other: those of a small key one by one, those of
    a larger one by a Gray-order hierarchical index over blocks of bounded size, which are taken in pairs. In each component of candidates, the Jaccard of all pairs decides what is linked; a large
    component is cut into blocks of about SET_BYTES, which are compared in pairs. Texts of equal sets are one node.
    Rows without an id take no part.
    """
    differ = acos(2 * similarity / (1 + similarity)) / pi
    bits = 64 * WORDS
    limit = int(bits * differ + 2.6 * sqrt(bits * differ * (1 - differ)))
    base = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text")).where("doc is not null")
    names = [f"f{i}" for i in range(WORDS)]
    known = stored(base.mapInArrow(_shingle_rows(width, False), "doc long, node long, " + ", ".join(f"{n} long" for n in names)), "fingerprints")
    prints = stored(known.groupBy("node", *names).agg(F.min("doc").alias("low")), "prints")
    distinct = prints.count()
    size = max(BAND_BITS, ceil(log2(max(2, distinct))) - 6)
    bands = ceil(log(MISS) / log(1 - (1 - differ) ** size))
    rng = np.random.default_rng(5)
    masks = np.zeros((bands, WORDS), dtype="<u8")
    for band in masks:
        for bit in rng.choice(bits, size, replace=False):
            band[bit // 64] |= U(1) << U(bit % 64)
    rows = F.array(*[F.struct(F.lit(i).alias("band"), *[F.lit(_signed(int(m[j]))).alias(f"m{j}") for j in range(WORDS)]) for i, m in enumerate(masks)])
    dealt = prints.withColumn("b", F.explode(rows))
    key = F.xxhash64(*[F.col(n).bitwiseAND(F.col(f"b.m{j}")) for j, n in enumerate(names)])
    candidates = stored(near_links(dealt.select("b.band", key.alias("key"), "node", *names), limit).distinct(), "candidates")
    release(docs.sparkSession)
    group = components(stored(forest(candidates), "forest")).withColumnRenamed("root", "part")
    links = stored(verified_links(base, prints.join(group, "node").select("node", "low", "part"), width, similarity).distinct(), "links")
    root = components(stored(forest(links), "forest"))
    whole = prints.select("node", "low").join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = whole.join(whole.groupBy("root").agg(F.min("low").alias("component_id")), "root").select("node", "component_id")
    return known.select("doc", "node").join(named, "node").select(F.col("doc").alias(id_col), "component_id")


def verified_links(base: DataFrame, group: DataFrame, width: int, similarity: float) -> DataFrame:
    """Links (a, b) with the components of all pairs at the similarity, of nodes in the same part.

    ``base`` has doc and text, ``group`` each node with a document ``low`` that holds it, and its part.
    """
    texts = base.join(group.select(F.col("low").alias("doc")).distinct(), "doc", "left_semi")
    sets = texts.mapInArrow(_shingle_rows(width, True), "doc long, node long, set binary").join(group.select("node", "low", "part"), "node")
    sets = stored(sets.where("doc = low").select("part", "node", "set"), "sets", 500)
    cuts = sets.groupBy("part").agg(F.ceil(F.sum(F.length("set")) / SET_BYTES).cast("int").alias("cuts"))
    placed = sets.join(cuts, "part").withColumn("block", F.pmod(F.xxhash64("node"), F.greatest("cuts", F.lit(1))))
    blocks = placed.groupBy("part", "block").agg(F.any_value("cuts").alias("cuts"), F.collect_list(F.struct("node", "set")).alias("rows"))
    blocks = stored(blocks.select("part", "block", "cuts", F.col("rows.node").alias("nodes"), F.col("rows.set").alias("sets")), "set_blocks", 16)
    inside = blocks.where("cuts <= 1").select("nodes", "sets").mapInArrow(_verified(similarity), "a long, b long")
    one, two = blocks.where("cuts > 1").alias("one"), blocks.where("cuts > 1").alias("two")
    # a block also meets itself, for parts of which all sets fell into one block
    same = (F.col("one.part") == F.col("two.part")) & (F.col("one.block") <= F.col("two.block"))
    pairs = one.join(two, same).select("one.part", "one.block", F.col("two.block").alias("block2"), "one.nodes", "one.sets", F.col("two.nodes").alias("nodes2"), F.col("two.sets").alias("sets2"))
    pairs = pairs.repartition("part", "block", "block2").select("nodes", "sets", "nodes2", "sets2")
    return inside.union(pairs.mapInArrow(_verified(similarity), "a long, b long"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: the one with the smallest id.

    All columns stay. Rows that repeat an id count as one document, of which the row with the least hash of its text,
    then of all its columns but maps, stays; rows without an id are not grouped and stay. Texts without words are alike.
    An empty table gives no rows.
    """
    kept = near_groups(docs, id_col, text_col, **how).where(F.col(id_col) == F.col("component_id")).select(F.col(id_col).alias("_kept")).distinct()
    once = docs.where(F.col(id_col).isNotNull()).join(kept, F.col(id_col) == F.col("_kept"), "left_semi")
    turn = F.row_number().over(Window.partitionBy(id_col).orderBy(F.xxhash64(text_col), F.xxhash64(*[c for c, kind in docs.dtypes if "map<" not in kind])))
    once = once.withColumn("_turn", turn).where("_turn = 1").drop("_turn")
    return once.unionByName(docs.where(F.col(id_col).isNull()))
