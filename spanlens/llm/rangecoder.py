"""Token ids as compressed files: an adaptive context-mixing range coder over independent, checksummed blocks.

A frame holds whole documents. Its head stores the ids it uses in order of frequency and, for each of a few classes of
previous ids, a distribution of the next one: order 1, mixed with order 0 in proportion to what was counted. Classes are
found by clustering the previous ids by what follows them. A block is BLOCK ids and starts from a fresh state. In it,
order 2 names the id last seen after the same two, with a check of its context and a count of its successes in a row;
weights that adapt to that count and to the last outcomes split the coder's interval between order 2 and the
distribution, and a range coder with carries narrows it.

All blocks of a frame advance together, one id of each at a time, as numpy vectors; a block's words depend on its own
ids and the head alone. After the head come document ids and lengths, then each block's length, CRC-32 and words.
Arithmetic is on integers below 2**53 held as doubles, so every machine gets the same words.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import slices
from .shared import batches_of
from .tokens import load

MAGIC, BLOCK, FRAME_TOKENS = b"SLT2", 4096, 1 << 23
SLOTS, SINGLES, BUCKETS = 1 << 10, 1 << 13, 1 << 12
SPLIT_BITS, TABLE_BITS = 8, 16  # of the weight of order 2, and of a distribution
TABLE, SPLIT, PART = 1 << TABLE_BITS, np.int32(1 << SPLIT_BITS), 2.0 ** -(SPLIT_BITS + TABLE_BITS)
WEIGHT_BITS, RATE, RUN = 15, 4, 6  # weights are fixed-point; a success count stops at RUN
LOW_WEIGHT = np.int32((1 << WEIGHT_BITS - SPLIT_BITS) + (1 << RATE))  # with it, order 2 still gets the least share
SURE = np.int32((1 << WEIGHT_BITS) - 2 * LOW_WEIGHT)
NEXT = np.minimum(np.arange(RUN + 2), RUN).astype(np.int32)
TAG, HASH1, HASH2 = np.int32(0xFF << 19), np.int32(0x2C1B3C6D), np.int32(0x297A2D39)
#: Classes by ids of a frame; ids of the most frequent ranks by which previous ids are clustered, and the rounds of it.
CLASSES, CLASS_IDS, LOOK, ROUNDS, SMOOTH = 32, 1 << 15, 256, 4, 12.0
FULL, LEAST, WORD = float(1 << 48), float(1 << 32), 65536.0
CACHE = 2_500_000, 800_000  # words and parts that the writer's tokenizer keeps; the writer holds little else


class _Tables:
    """The head of a frame: names (ids by rank), the class of each rank, and classes x symbols frequencies.

    A symbol is a rank below SINGLES or a bucket of 2 ** extra ranks above.
    """

    def __init__(self, names: np.ndarray, group: np.ndarray, freq: np.ndarray) -> None:
        self.names, self.group, self.freq = names, group, freq
        self.extra = _extra(len(names))
        cum = np.cumsum(freq, axis=1, dtype=np.int64) - freq
        self.spans = (cum << 16 | freq - 1).astype(np.uint32).reshape(-1)  # start above size less one
        self.symbols = freq.shape[1]

    @staticmethod
    def fit(ids: np.ndarray) -> tuple[_Tables, np.ndarray]:
        """Tables of the ids, and the rank of each."""
        counts = np.bincount(ids)
        names = np.argsort(-counts, kind="stable")[: int((counts > 0).sum())]
        rank = np.zeros(len(counts), dtype=np.int32)
        rank[names] = np.arange(len(names), dtype=np.int32)
        ranks, n = rank[ids], len(names)
        classes = int(np.clip(len(ids) // CLASS_IDS, 1, min(CLASSES, n)))
        look, extra = min(LOOK, n), _extra(n)
        before = np.empty_like(ranks)  # the rank that the coder has before each
        before[1:], before[::BLOCK] = ranks[:-1], 0
        near = _pairs(before, ranks, n, look)
        base = near.sum(axis=0) / len(ranks)
        rows, group = near[:classes], np.zeros(n, dtype=np.int64)
        for _ in range(ROUNDS if classes > 1 else 0):
            share = (rows + SMOOTH * base) / (rows.sum(axis=1, keepdims=True) + SMOOTH)
            group = (near @ np.log(share).T).argmax(axis=1)
            rows = np.stack([np.bincount(group, weights=column, minlength=classes) for column in near.T], axis=1)
        size = int(_symbol(np.array([n - 1]), extra)[0]) + 1
        found = _pairs(group.astype(np.int32)[before], _symbol(ranks, extra), classes, size)
        whole = found.sum(axis=0) / len(ids)
        share = (found + SMOOTH * whole) / (found.sum(axis=1, keepdims=True) + SMOOTH)
        upto = np.minimum(np.floor(np.cumsum(share, axis=1) * (TABLE - size)), TABLE - size)
        upto[:, -1] = TABLE - size
        return _Tables(names, group, (np.diff(upto, axis=1, prepend=0) + 1).astype(np.int64)), ranks

    def pack(self) -> bytes:
        planes = (self.freq - 1).astype("<u2").view(np.uint8).reshape(-1, 2).T.tobytes()
        body = zlib.compress(self.names.astype("<u4").tobytes() + self.group.astype("u1").tobytes() + planes, 6)
        return struct.pack("<IIII", len(self.names), len(self.freq), self.symbols, len(body)) + body

    @staticmethod
    def unpack(frame: bytes, at: int) -> tuple[_Tables, int]:
        n, classes, symbols, size = struct.unpack_from("<IIII", frame, at)
        body = zlib.decompress(frame[at + 16 : at + 16 + size])
        planes = np.frombuffer(body, dtype=np.uint8, offset=5 * n).reshape(2, -1)
        freq = np.ascontiguousarray(planes.T).view("<u2").reshape(classes, symbols).astype(np.int64) + 1
        return _Tables(np.frombuffer(body, dtype="<u4", count=n), np.frombuffer(body, dtype="u1", count=n, offset=4 * n).astype(np.int64), freq), at + 16 + size

    def lookup(self) -> np.ndarray:
        """Symbol at each place of each class's table."""
        return np.repeat(np.tile(np.arange(self.symbols, dtype=np.uint16), len(self.freq)), self.freq.reshape(-1))


def _pairs(one: np.ndarray, two: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Counts of the pairs; what lies beyond the last column counts for it."""
    out = np.zeros(rows * columns, dtype=np.int64)
    for at in range(0, len(one), 1 << 18):
        out += np.bincount(one[at : at + (1 << 18)].astype(np.int64) * columns + np.minimum(two[at : at + (1 << 18)], columns - 1), minlength=len(out))
    return out.reshape(rows, columns).astype(np.float64)


def _extra(n: int) -> int:
    """Bits of the place inside a bucket."""
    extra = 0
    while n - SINGLES > BUCKETS << extra:
        extra += 1
    return extra


def _symbol(ranks: np.ndarray, extra: int) -> np.ndarray:
    return np.where(ranks < SINGLES, ranks, SINGLES + (ranks - SINGLES >> extra)) if extra else ranks


class _Order2:
    """What all lanes know of order 2: a slot holds a check of its context, an id's rank and its successes in a row."""

    def __init__(self, lanes: int) -> None:
        self.slots = np.zeros(lanes * SLOTS, dtype=np.int32)
        self.base = np.arange(lanes, dtype=np.int32) * SLOTS
        self.state = np.arange(lanes, dtype=np.int32) * (RUN + 2)
        self.weights = np.tile(np.array([LOW_WEIGHT, *(SURE * min(3, 1 + i) // 4 for i in range(RUN + 1))], dtype=np.int32), lanes)
        self.one = self.two = np.zeros(lanes, dtype=np.int32)

    def predict(self) -> None:
        mixed = self.one * HASH1
        mixed += self.two * HASH2
        self.at = (mixed & SLOTS - 1) + self.base
        slot = self.slots.take(self.at)
        self.tag = mixed & TAG
        self.guess = slot >> 3 & 0xFFFF
        runs = slot & 7
        self.runs = runs + 1
        self.k = self.runs * (slot & TAG == self.tag)
        self.k += self.state
        self.weight = self.weights.take(self.k)
        self.first = self.weight >> WEIGHT_BITS - SPLIT_BITS

    def update(self, ranks: np.ndarray, hit: np.ndarray) -> None:
        goal = hit * SURE
        goal += LOW_WEIGHT
        goal -= self.weight
        goal >>= RATE
        goal += self.weight
        self.weights[self.k] = goal
        slot = NEXT.take(self.runs)
        slot *= hit
        slot |= self.tag
        slot |= ranks << 3
        self.slots[self.at] = slot
        self.one, self.two = ranks, self.one


def _turned(table: np.ndarray, kind) -> np.ndarray:
    """Transposed copy, in strips that fit the processor's caches."""
    out = np.empty(table.shape[::-1], dtype=kind)
    for at in range(0, len(table), 32):
        out[:, at : at + 32] = table[at : at + 32].T
    return out


def encode_blocks(ranks: np.ndarray, tables: _Tables) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of whole blocks (blocks x BLOCK) to the number of 16-bit words of each block, and the words."""
    lanes, extra = len(ranks), tables.extra
    steps = _turned(ranks, np.int32)
    model = _Order2(lanes)
    low, width = np.zeros(lanes), np.full(lanes, FULL)
    room = BLOCK * (3 if extra else 2) + 4
    out, first = np.zeros(lanes * room, dtype=np.uint16), np.arange(lanes) * room
    spots = first.copy()
    before = np.zeros(lanes, dtype=np.int32)

    def settle(low: np.ndarray) -> None:
        """Carries go into the words before; then top words go out until every interval is wide again."""
        at = np.flatnonzero(low >= FULL)
        if len(at):
            low[at] -= FULL
            back = spots[at] - 1
            while len(back):
                out[back] += np.uint16(1)
                back = back[out[back] == 0] - 1
        at = np.flatnonzero(width < LEAST)
        while len(at):
            part = low.take(at)
            top = np.floor(part / LEAST)
            spot = spots.take(at)
            out[spot] = top
            spots[at] = spot + 1
            low[at] = (part - top * LEAST) * WORD
            wide = width.take(at) * WORD
            width[at] = wide
            at = at[wide < LEAST]

    for start in range(0, BLOCK, 64):  # what doesn't depend on the state is worked out for many steps at once
        part = steps[start : start + 64]
        previous = np.concatenate([before[None], part[:-1]])
        before = part[-1]
        symbol = _symbol(part, extra)
        spans = tables.spans.take(tables.group.take(previous) * tables.symbols + symbol)
        begins, sizes = (spans >> 16).astype(np.int32), (spans & 0xFFFF).astype(np.int32) + 1
        for now, begin, size, own in zip(part, begins, sizes, symbol, strict=True):
            model.predict()
            hit = now == model.guess
            rest, split = SPLIT - model.first, model.first << TABLE_BITS
            begin *= rest
            begin += split
            begin *= ~hit
            size *= rest
            np.copyto(size, split, where=hit)
            unit = np.floor(width * PART)
            low += unit * begin
            np.multiply(unit, size, out=width)
            settle(low)
            if extra and len(at := np.flatnonzero(~hit & (own >= SINGLES))):
                unit = np.floor(width[at] / (1 << extra))
                low[at] += unit * (now[at] - SINGLES & (1 << extra) - 1)
                width[at] = unit
                settle(low)
            model.update(now, hit)
    for _ in range(3):
        top = np.floor(low / LEAST)
        out[spots] = top
        spots += 1
        low = (low - top * LEAST) * WORD
    used = spots - first
    return used, np.concatenate([out[a : a + n] for a, n in zip(first.tolist(), used.tolist(), strict=True)])


def decode_blocks(used: np.ndarray, words: np.ndarray, tables: _Tables) -> np.ndarray:
    """Ranks of the blocks (blocks x BLOCK)."""
    lanes, extra = len(used), tables.extra
    data = np.zeros((lanes, int(used.max()) + 3), dtype=np.uint16)
    data[np.arange(data.shape[1]) < used[:, None]] = words
    model, lookup = _Order2(lanes), tables.lookup()
    places, group = (tables.group << TABLE_BITS).astype(np.int32), (tables.group * tables.symbols).astype(np.int32)
    width = np.full(lanes, FULL)
    code = (data[:, 0] * WORD + data[:, 1]) * WORD + data[:, 2]
    flat, spots = data.reshape(-1), np.arange(lanes) * data.shape[1] + 3
    out = np.empty((BLOCK, lanes), dtype=np.int32)

    def settle() -> None:
        at = np.flatnonzero(width < LEAST)
        while len(at):
            spot = spots.take(at)
            code[at] = code.take(at) * WORD + flat.take(spot)
            spots[at] = spot + 1
            wide = width.take(at) * WORD
            width[at] = wide
            at = at[wide < LEAST]

    for now in range(BLOCK):
        model.predict()
        rest, split = SPLIT - model.first, model.first << TABLE_BITS
        unit = np.floor(width * PART)
        value = (code / unit).astype(np.int32)  # exact: such quotients can't round up to an integer
        value -= split
        hit = value < 0
        np.maximum(value, 0, out=value)
        goal = (value / rest).astype(np.int32)
        symbol = lookup.take(places.take(model.one) + goal).astype(np.int32)
        spans = tables.spans.take(group.take(model.one) + symbol)
        begin, size = (spans >> 16).astype(np.int32), (spans & 0xFFFF).astype(np.int32)
        size += 1
        begin *= rest
        begin += split
        begin *= ~hit
        size *= rest
        np.copyto(size, split, where=hit)
        code -= unit * begin
        np.multiply(unit, size, out=width)
        settle()
        ranks = symbol
        if extra and len(at := np.flatnonzero(~hit & (symbol >= SINGLES))):
            unit = np.floor(width[at] / (1 << extra))
            inner = np.floor(code[at] / unit)
            code[at] -= unit * inner
            width[at] = unit
            settle()
            ranks[at] = SINGLES + (symbol[at] - SINGLES << extra) + inner.astype(np.int32)
        np.copyto(ranks, model.guess, where=hit)
        out[now] = ranks
        model.update(ranks, hit)
    return _turned(out, np.int32)


def pack_frame(docs: list[int | None], sizes: np.ndarray, ids: np.ndarray) -> bytes:
    """One frame of whole documents: their ids, their numbers of tokens, and all tokens (at most 65,536 different ones)."""
    blocks = -(-len(ids) // BLOCK)
    used, words, sums, tables = np.zeros(0, np.int64), np.zeros(0, np.uint16), np.zeros(0, "<u4"), b""
    if blocks:
        model, ranks = _Tables.fit(ids)
        full = np.zeros(blocks * BLOCK, dtype=np.int32)
        full[: len(ids)] = ranks
        full = full.reshape(blocks, BLOCK)
        used, words = encode_blocks(full, model)
        sums = np.array([zlib.crc32(model.names[x].astype("<u4")) for x in full], dtype="<u4")
        tables = model.pack()
    head = MAGIC + struct.pack("<IIQ", len(docs), blocks, len(ids))
    known = np.array([x is not None for x in docs], dtype=np.uint8)
    names = np.array([x or 0 for x in docs], dtype="<i8")
    body = b"".join([head, tables, known.tobytes(), names.tobytes(), sizes.astype("<i8").tobytes(), used.astype("<u4").tobytes(), sums.tobytes(), words.astype("<u2").tobytes()])
    return body + struct.pack("<I", zlib.crc32(body))


def unpack_frame(frame: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, their numbers of tokens, and all ids of the frame; raises ValueError where a checksum is wrong."""
    if frame[:4] != MAGIC or zlib.crc32(memoryview(frame)[:-4]) != struct.unpack("<I", frame[-4:])[0]:
        raise ValueError("not a token frame, or damaged")
    docs, blocks, count = struct.unpack("<IIQ", frame[4:20])
    tables, at = _Tables.unpack(frame, 20) if blocks else (None, 20)

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(frame, dtype=kind, count=n, offset=at)
        at += out.nbytes
        return out

    known, names, sizes, used, sums = take("u1", docs), take("<i8", docs), take("<i8", docs), take("<u4", blocks), take("<u4", blocks)
    words = take("<u2", int(used.sum()))
    full = np.zeros((0, BLOCK), "<u4")
    if blocks:
        ranks = decode_blocks(used.astype(np.int64), words, tables)
        full = np.empty(ranks.shape, dtype="<u4")
        np.take(tables.names, ranks, out=full, mode="clip")
    bad = [i for i in range(blocks) if zlib.crc32(full[i]) != sums[i]]
    if bad:
        raise ValueError(f"blocks {bad[:5]} fail their checksums")
    return [int(x) if k else None for k, x in zip(known, names, strict=True)], sizes, full.reshape(-1)[:count]


def _frames(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokenizer, part = load(path, *CACHE), TaskContext.get().partitionId()
        docs, sizes, tokens, size, chunk, start = [], [], [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            frame = pack_frame(docs, np.concatenate(sizes), np.concatenate(tokens))
            values = [[part], [chunk], [start], [size], [frame]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["part", "chunk", "start", "tokens", "frame"])

        for batch in batches:
            for a, b in slices(batch.column(1), 1 << 20):
                flat, bounds = tokenizer.encode(batch.column(1).slice(a, b - a), end_id)
                docs += batch.column(0).slice(a, b - a).to_pylist()
                sizes.append(np.diff(bounds))
                tokens.append(flat)
                size += len(flat)
                if size >= FRAME_TOKENS:
                    yield flush()
                    docs, sizes, tokens, size, chunk, start = [], [], [], 0, chunk + 1, start + size
            pa.default_memory_pool().release_unused()
        if docs:
            yield flush()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of every whole text, each closed by end_id, as frames in ascending id order (null ids first).

    A null text is empty. Rows that repeat an id follow each other. ``path`` becomes a Parquet table of frames: part and
    chunk give their order, start is the number of tokens before a frame within its part. Vocabularies have at most
    65,536 ids.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    dealt = base.repartitionByRange("doc").sortWithinPartitions("doc", "text")
    frames = dealt.mapInArrow(_frames(tokenizer_path, end_id), "part int, chunk int, start long, tokens long, frame binary")
    with batches_of(docs.sparkSession, 1000):
        frames.write.option("compression", "uncompressed").parquet(path)


def read_tokens(spark: SparkSession, path: str, id_col: str = "doc_id", ids: bool = True) -> DataFrame:
    """One row per document of a written table: id_col, start, n_tokens, ids_crc32 and, if asked for, the ids.

    start counts the tokens of all documents before it; every checksum is verified. Only the number of tokens of each
    part comes to the driver (a part is a shuffle partition of the writer).
    """
    table = spark.read.parquet(path)
    parts = sorted((r["part"], r["n"]) for r in table.groupBy("part").agg(F.sum("tokens").alias("n")).collect())
    base, at = {}, 0
    for part, n in parts:
        base[part], at = at, at + n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, start, frame in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                docs, sizes, flat = unpack_frame(frame)
                upto = np.concatenate([[0], np.cumsum(sizes)])
                data = flat.tobytes()
                sums = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]
                columns = [pa.array(docs, pa.int64()), pa.array(upto[:-1] + base[part] + start), pa.array(sizes), pa.array(sums, pa.int64())]
                if ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(flat.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, ["doc", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    schema = "doc long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if ids else "")
    return table.select("part", "start", "frame").mapInArrow(run, schema).withColumnRenamed("doc", id_col)
