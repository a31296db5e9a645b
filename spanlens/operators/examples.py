"""The occurrences of tokens whose contexts share most words with wanted spans, found without a table of pairs.

An occurrence that is among the k best of a span is, of all that share its shared words, among the first k. So for every
set of words of a span (beside the token) the first k occurrences that have them are enough. The sets are keys of 64 bits,
sums of hashes of their words; a bitmap of all wanted keys goes to the sentences, which give only the first k of a key.
Spans of more than ``FEW`` other words are few and go through a plain join with the occurrences, where they are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlens.functions.text import join_tokens
from spanlens.operators.lookup import _BACK, _MIX, _PREFIX, _STEP, Hashed, _bytes, _chunks, _Rows, small_batches
from spanlens.operators.reflection import top_examples
from spanlens.operators.roles import occurrences_of_own, own_rows

ROLES = ("entity", "context", "other")
BITS = 22  # words of 64 bits in the bitmap, as a power of 2
FEW = 6
CHUNK = 1 << 18
SLAB = 1 << 18
HELD = 1 << 18
_U = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _MIX
    x = (x ^ (x >> _U(29))) * _PREFIX
    return x ^ (x >> _U(32))


def _root(codes: np.ndarray, role: np.ndarray) -> np.ndarray:
    return _mixed(codes + (role.astype(np.uint64) + _U(1)) * _STEP)


def _word(codes: np.ndarray) -> np.ndarray:
    return _mixed(codes ^ _BACK)


def _spot(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word of each key in the bitmap, and its three bits there."""
    bit = lambda n: _U(1) << ((keys >> _U(n)) & _U(63))
    return (keys >> _U(64 - BITS)).astype(np.int64), bit(0) | bit(6) | bit(12)


def _held(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    word, bits = _spot(keys)
    return (bitmap[word] & bits) == bits


def _bitmap(keys: DataFrame, to_keys) -> np.ndarray:
    """The bitmap of all keys that ``to_keys`` makes of the batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, bits = _spot(np.unique(to_keys(batch)))
            order = np.argsort(word, kind="stable")
            word, first = np.unique(word[order], return_index=True)
            held = np.bitwise_or.reduceat(bits[order], first) if len(first) else bits
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(held.view(np.int64))], ["word", "bits"])

    got = keys.mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << BITS, dtype=np.uint64)
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return out


def _coded(token: pa.Array, role: pa.Array, span: pa.Array) -> pa.Array:
    """(root, words, own) of wanted rows: hashes of token and role and of the span's other words, and whether the token is in it."""
    data, at = _bytes(token)
    codes = Hashed(data).of(at[:-1], np.diff(at))
    t = _Rows(*_bytes(span))
    mine = t.codes == codes[t.row]
    word, row = _word(t.codes[~mine]), t.row[~mine]
    order = np.lexsort((word, row))
    word, row = word[order], row[order]
    keep = np.append(True, (word[1:] != word[:-1]) | (row[1:] != row[:-1]))[: len(word)]
    word, row = word[keep], row[keep]
    own = np.zeros(len(codes), dtype=bool)
    own[t.row[mine]] = True
    root = _root(codes, pc.index_in(role, pa.array(ROLES)).to_numpy(zero_copy_only=False))
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(codes) + 1)).astype(np.int32)), pa.array(word.view(np.int64)))
    whole = root.copy()
    np.add.at(whole, row, word)
    return pa.StructArray.from_arrays([pa.array(root.view(np.int64)), lists, pa.array(own), pa.array(whole.view(np.int64))], ["root", "words", "own", "whole"])


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a column of lists, and where each row's begin."""
    size = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(size)).astype(np.int64)


def _sets(root: np.ndarray, words: np.ndarray, at: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, rows, keys) of every set of words of the rows, one choice of places after the other."""
    size = np.diff(at)[rows]
    for many in np.unique(size).tolist():
        some = rows[size == many]
        own = words[at[some][:, None] + np.arange(many)]
        for mask in range(1 << many):
            chosen = [i for i in range(many) if mask >> i & 1]
            yield len(chosen), some, root[some] + own[:, chosen].sum(axis=1, dtype=np.uint64)


class _Found:
    """Occurrences in a chunk of sentences, in the order of id, entity and place for each role."""

    def __init__(self, ids: np.ndarray, data: np.ndarray, at: np.ndarray, cover: np.ndarray, ents: list[np.ndarray], ent_at: np.ndarray, width: int, starts: bool) -> None:
        self.t = t = _Rows(data, at)
        base = np.searchsorted(t.row, np.arange(len(ids) + 1))
        s, e, order_ = (x.astype(np.int64) for x in ents)
        row = np.repeat(np.arange(len(ids)), np.diff(ent_at))
        s, e = base[row] + s, base[row] + e
        low, high = np.maximum(s - width, base[row]), np.minimum(e + width, base[row + 1] - 1)
        begin, end = (s, s) if starts else (low, high)
        n = end - begin + 1
        ent = np.repeat(np.arange(len(s)), n)
        p = begin[ent] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        inside = (p >= s[ent]) & (p <= e[ent])
        on = inside | (cover[p] < 0) if len(p) else inside
        ent, p, inside = ent[on], p[on], inside[on]
        sort = np.lexsort((p, order_[ent], ids[row[ent]]))
        ent, p, inside = ent[sort], p[sort], inside[sort]
        rest = np.zeros(0, dtype=np.int64) if starts else np.flatnonzero(cover == 0)
        rest = rest[np.lexsort((rest, ids[t.row[rest]]))]
        self.p = np.append(p, rest)
        self.role = np.append(np.where(inside, 0, 1), np.full(len(rest), 2))
        self.ent = np.append(ent, np.full(len(rest), -1))
        self.low = np.append(low[ent], np.maximum(rest - width, base[t.row[rest]]))
        self.high = np.append(high[ent], np.minimum(rest + width, base[t.row[rest] + 1] - 1))
        self.id = ids[t.row[self.p]]
        self.ord = np.append(order_[ent], np.zeros(len(rest), dtype=np.int64))
        self.pos = self.p - base[t.row[self.p]]
        self.first, self.last = s, e

    def keep(self, on: np.ndarray) -> None:
        for name in ("p", "role", "ent", "low", "high", "id", "ord", "pos"):
            setattr(self, name, getattr(self, name)[on])


def _first(columns: list[np.ndarray], k: int, order: np.ndarray) -> list[np.ndarray]:
    """The first k rows of each key (the first column), in the given order, which brings equal keys together."""
    columns = [c[order] for c in columns]
    key = columns[0]
    new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))[: len(key)]
    rank = np.arange(len(key)) - np.repeat(new, np.diff(np.append(new, len(key))))
    return [c[rank < k] for c in columns]


def _matches(found: _Found, bitmap: np.ndarray, k: int) -> list[np.ndarray]:
    """(key, root, id, ord, pos, role) of the first k occurrences of each wanted key."""
    t = found.t
    found.keep(_held(bitmap, _root(t.codes[found.p], found.role)))
    if not len(found.p):
        return [np.zeros(0, dtype=x) for x in (np.int64, np.int64, np.int64, np.int64, np.int32, np.int8)]
    # of equal tokens in one entity's context, which are equally near, the first k are enough
    same = _mixed(t.codes[found.p] ^ (found.role + 3 * found.ent).astype(np.uint64))
    same[found.ent < 0] = _mixed(np.arange((found.ent < 0).sum(), dtype=np.uint64) + _STEP)
    order = np.argsort(same, kind="stable")
    found.keep(np.sort(_first([same, np.arange(len(same))], k, order)[1]))
    root = _root(t.codes[found.p], found.role)
    by = np.lexsort((t.codes, t.row))
    again = np.append(False, (t.codes[by][1:] == t.codes[by][:-1]) & (t.row[by][1:] == t.row[by][:-1]))
    before = np.full(len(by), -1)
    before[by[again]] = by[np.flatnonzero(again) - 1]  # where the same token stood before in the sentence
    word = _word(t.codes)
    keys, rows = [root], [np.arange(len(root))]

    def grow(row: np.ndarray, key: np.ndarray, at: np.ndarray, own: np.ndarray, ends: np.ndarray, level: int) -> None:
        """Sets of one word more; ``at``: place of a set's last word in ``own``, where row's words end at ``ends``."""
        many = ends[row] - at - 1
        upto = np.cumsum(many)
        low = 0
        while low < len(row):
            high = max(low + 1, int(np.searchsorted(upto, (upto[low - 1] if low else 0) + SLAB, side="right")))
            n = many[low:high]
            which = np.repeat(np.arange(low, high), n)
            to = at[which] + 1 + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            new = key[which] + own[to]
            on = _held(bitmap, new)
            if on.any():
                keys.append(new[on])
                rows.append(row[which[on]])
                if level < FEW:
                    grow(row[which[on]], new[on], to[on], own, ends, level + 1)
            low = high

    size = found.high - found.low + 1
    upto = np.cumsum(size)
    low = 0
    while low < len(size):
        high = max(low + 1, int(np.searchsorted(upto, (upto[low - 1] if low else 0) + SLAB, side="right")))
        n = size[low:high]
        which = np.repeat(np.arange(low, high), n)
        j = found.low[which] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        on = (before[j] < found.low[which]) & (t.codes[j] != t.codes[found.p[which]])
        which, j = which[on], j[on]
        new = root[which] + word[j]
        on = _held(bitmap, new)
        which, new, own = which[on], new[on], word[j[on]]
        keys.append(new)
        rows.append(which)
        grow(which, new, np.arange(len(which)), own, np.searchsorted(which, np.arange(len(size)), side="right"), 2)
        low = high
    key, row = np.concatenate(keys), np.concatenate(rows)
    key, row = _first([key, row], k, np.argsort(key, kind="stable"))
    return [key.view(np.int64), root[row].view(np.int64), found.id[row], found.ord[row], found.pos[row].astype(np.int32), found.role[row].astype(np.int8)]


def _in_order(columns: list[np.ndarray], k: int) -> list[np.ndarray]:
    return _first(columns, k, np.lexsort((columns[4], columns[3], columns[2], columns[0])))


NAMES = ["key", "root", "id", "ent_ord", "pos", "role"]
KINDS = ["long", "long", "long", "long", "int", "tinyint"]


def _scanned(rows: DataFrame, width: int, starts: bool, work) -> Iterator:
    """Arrow batches of own_rows to what ``work`` makes of the occurrences of each chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator:
        for batch in batches:
            data, at = _bytes(batch.column(1))
            ids = batch.column(0).to_numpy()
            for low, high in _chunks(at, CHUNK):
                part = batch.slice(low, high - low)
                cover, _ = _lists(part.column(2))
                ents = [_lists(part.column(i)) for i in (3, 4, 5)]
                found = _Found(ids[low:high], data[at[low] : at[high]], at[low : high + 1] - at[low], cover, [x for x, _ in ents], ents[0][1], width, starts)
                yield work(found, part)

    return run


def _columns(rows: DataFrame, *more: str) -> DataFrame:
    own = [F.transform("own", lambda x: x["s"].cast("int")).alias("s"), F.transform("own", lambda x: x["e"].cast("int")).alias("e"), F.transform("own", lambda x: x["ent_ord"].cast("long")).alias("ord")]
    return rows.select("id", join_tokens(F.col("tokens")).alias("sentence"), "cover", *own, *more)


def best_examples(wanted: DataFrame, rows: DataFrame, k: int, width: int = 2, starts: bool = False) -> DataFrame:
    """``reflection.top_examples`` of the occurrences of rows(id, tokens, ents), of the first tokens of entities only if ``starts``.

    wanted(key, token, role, span), one span for a key, token and role; returns key, token, role, rank, id, ent_ord (0: no
    entity), pos, shared.
    """
    coded = F.arrow_udf(_coded, "struct<root:long,words:array<long>,own:boolean,whole:long>")
    asked = wanted.select("key", "token", "role", "span", coded("token", "role", "span").alias("x")).select("key", "token", "role", "span", "x.*").persist()
    few, own = asked.where(F.size("words") <= FEW), own_rows(rows, width)

    def all_sets(batch: pa.RecordBatch) -> np.ndarray:
        root, (words, at) = batch.column(0).to_numpy().view(np.uint64), _lists(batch.column(1))
        return np.concatenate([np.zeros(0, dtype=np.uint64), *[keys for _, _, keys in _sets(root, words.view(np.uint64), at, np.arange(len(root)))]])

    bitmap = _bitmap(few.select("root", "words").distinct(), all_sets)
    scan = _scanned(rows, width, starts, lambda found, part: _matches(found, bitmap, k))

    def first_of_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, most = [], 0, HELD
        for found in scan(batches):
            held.append(found)
            n += len(found[0])
            if n > most:
                held = [_in_order([np.concatenate(c) for c in zip(*held, strict=True)], k)]
                n = len(held[0][0])
                most = max(HELD, 2 * n)
        if held:
            out = pa.RecordBatch.from_arrays(list(map(pa.array, _in_order([np.concatenate(c) for c in zip(*held, strict=True)], k))), NAMES)
            for low in range(0, len(out), 100_000):
                yield out.slice(low, 100_000)

    met = _columns(own).mapInArrow(first_of_keys, ", ".join(map(" ".join, zip(NAMES, KINDS, strict=True))))
    none = F.lit(None)
    both = met.select(*NAMES, none.cast("array<long>").alias("words")).unionByName(few.select(F.col("whole").alias("key"), "root", *[none.cast(kind).alias(c) for c, kind in list(zip(NAMES, KINDS, strict=True))[2:]], "words"))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches([b for b in batches]) if (batches := list(batches)) else None
        if table is None:
            return
        asks = pc.is_valid(table.column("words"))
        ask, seen = table.filter(asks), table.filter(pc.invert(asks))
        key, root, *place = _in_order([seen.column(c).to_numpy() for c in NAMES], k)
        key, begin = np.unique(key.view(np.uint64), return_index=True) if len(key) else (key.view(np.uint64), np.zeros(0, dtype=np.int64))
        many = np.zeros(len(key), dtype=np.int64)
        many[np.argsort(begin)] = np.diff(np.append(np.sort(begin), len(root)))
        whole, one = np.unique(ask.column("key").to_numpy(), return_index=True)
        roots, (words, at) = ask.column("root").to_numpy().view(np.uint64), _lists(ask.column("words").combine_chunks())
        for low in range(0, len(one), 20_000):
            rows_, size, spot = [], [], []
            for n, some, sets in _sets(roots, words.view(np.uint64), at, one[low : low + 20_000]):
                i = np.searchsorted(key, sets)
                on = i < len(key)
                on[on] = key[i[on]] == sets[on]
                i, some = i[on], some[on]
                n_ = many[i]
                rows_.append(np.repeat(some, n_))
                size.append(np.full(n_.sum(), n))
                spot.append(np.repeat(begin[i] - np.cumsum(n_) + n_, n_) + np.arange(n_.sum()))
            row, shared, spot = (np.concatenate(x).astype(np.int64) for x in (rows_, size, spot))
            id_, ord_, pos = (x[spot] for x in place[:3])
            sort = np.lexsort((-shared, pos, ord_, id_, row))
            row, shared, id_, ord_, pos = (x[sort] for x in (row, shared, id_, ord_, pos))
            fresh = np.append(True, (row[1:] != row[:-1]) | (id_[1:] != id_[:-1]) | (ord_[1:] != ord_[:-1]) | (pos[1:] != pos[:-1]))[: len(row)]
            row, shared, id_, ord_, pos = (x[fresh] for x in (row, shared, id_, ord_, pos))
            row, shared, id_, ord_, pos = _first([row, shared, id_, ord_, pos], k, np.lexsort((pos, ord_, id_, -shared, row)))
            rank = np.arange(len(row)) - np.searchsorted(row, row) + 1
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ask.column("key").to_numpy()[row], rank, id_, ord_, pos.astype(np.int64), shared)], ["whole", "rank", "id", "ent_ord", "pos", "shared"])

    with small_batches(rows.sparkSession):
        top = both.repartition("root").mapInArrow(merged, "whole long, rank long, id long, ent_ord long, pos long, shared long").persist()
    out = few.select("key", "token", "role", "own", "whole").join(top, "whole")
    out = out.select("key", "token", "role", F.col("rank").cast("int").alias("rank"), "id", "ent_ord", F.col("pos").cast("int").alias("pos"), (F.col("shared") + F.col("own").cast("long")).cast("int").alias("shared"))
    many = asked.where(F.size("words") > FEW)
    if not many.isEmpty():
        occ = occurrences_of_own(own, width)
        occ = occ.where((F.col("role") == "entity") & (F.col("pos") == F.col("ent_ord"))) if starts else occ
        plain = top_examples(F.broadcast(many.select("key", "token", "role", "span")), occ, k)
        out = out.unionByName(plain.select("key", "token", "role", "rank", "id", F.coalesce("ent_ord", F.lit(0)).cast("long").alias("ent_ord"), "pos", "shared"))
    return out


def with_texts(best: DataFrame, rows: DataFrame, width: int = 2) -> DataFrame:
    """``best_examples`` with ent_type, ent_span and cxt of each occurrence, as far as a bitmap of them goes from the rows themselves."""

    def keys(id_, ord_, pos, role) -> np.ndarray:
        x = np.zeros(len(id_), dtype=np.uint64)
        for part in (id_, ord_, pos, role):
            x = _mixed(x + part.astype(np.uint64) + _STEP)
        return x

    best = best.persist()
    role = F.array_position(F.array(*map(F.lit, ROLES)), F.col("role")) - 1
    places = best.select("id", "ent_ord", F.col("pos").cast("long").alias("pos"), role.alias("role"))
    bitmap = _bitmap(places, lambda batch: keys(*(batch.column(i).to_numpy() for i in range(4))))

    def work(found: _Found, part: pa.RecordBatch) -> pa.RecordBatch:
        found.keep(_held(bitmap, keys(found.id, found.ord, found.pos, found.role)))
        t, ent = found.t, found.ent
        text = lambda a, b: pa.array([t.raw[x:y] for x, y in zip(t.first[a].tolist(), t.last[b].tolist(), strict=True)], pa.binary()).cast(pa.string())
        of = ent >= 0
        empty = pa.array(~of)
        a, b = (np.where(of, x[ent], 0) if len(x) else np.zeros(len(ent), dtype=np.int64) for x in (found.first, found.last))
        kinds = part.column(6).flatten()
        kind = kinds.take(pa.array(np.where(of, ent, 0), mask=~of)) if len(kinds) else pa.nulls(len(ent), pa.string())
        span = pc.if_else(empty, pa.scalar(None, pa.string()), text(a, b)) if len(ent) else pa.array([], pa.string())
        return pa.RecordBatch.from_arrays([pa.array(found.id), pa.array(found.ord), pa.array(found.pos.astype(np.int32)), pa.array(ROLES).take(pa.array(found.role)), kind.cast(pa.string()), span, text(found.low, found.high)], ["id", "ent_ord", "pos", "role", "ent_type", "ent_span", "cxt"])

    source = _columns(own_rows(rows, width), F.transform("own", lambda x: x["type"]).alias("type"))
    with small_batches(rows.sparkSession):
        texts = source.mapInArrow(_scanned(rows, width, False, work), "id long, ent_ord long, pos int, role string, ent_type string, ent_span string, cxt string").persist()
    return best.join(texts, ["id", "ent_ord", "pos", "role"])
