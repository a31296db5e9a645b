"""Substring deduplication with difference-cover anchors.

{0, 1, 3} is a difference cover modulo 7: for any two residues some shift brings both into the cover. If only
windows of 7 words that start at cover positions are hashed, any two equal runs of 7 - 1 + 7 = 13 words share
such an anchor at the same place of the run. Three steps follow, each with one exchange of fixed-size rows:

1. anchors: documents that share an anchor with another document;
2. extension: only windows of 13 words around shared anchors are hashed; of each the smallest document is found;
3. removal: every word under a window that also starts in a smaller document goes.

Within each batch of rows equal keys are folded to the smallest document before they are sent, so a passage that
occurs in every document costs one row a batch in the exchange, and groups are walked as sorted streams, never
gathered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .blocks import U, Words, mix, slices
from .shared import free_names, release, stored

COVER, PERIOD, ANCHOR = (0, 1, 3), 7, 7
WINDOW = ANCHOR + PERIOD - 1
_ROWS = "doc long, key long, check int, known boolean"


def _anchors(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Word indexes of anchors in rows that hold a whole window, and their keys (48 bits, the low 16 clear)."""
    key, whole = words.windows(ANCHOR)
    place = np.arange(len(key)) - words.first[words.row]
    residue = place % PERIOD
    at = np.flatnonzero(whole & np.isin(residue, COVER) & (np.diff(words.first)[words.row] >= WINDOW))
    return at, key[at] & ~U(0xFFFF)


def _fold(doc: np.ndarray, key: np.ndarray, check: np.ndarray, first_too: bool) -> Iterator[pa.RecordBatch]:
    """One open row a (key, check), its smallest document; rows already known to share it pass as known."""
    if not len(doc):
        return
    order = np.lexsort((doc, check, key))
    doc, key, check = doc[order], key[order], check[order]
    head = np.ones(len(doc), dtype=bool)
    head[1:] = (key[1:] != key[:-1]) | (check[1:] != check[:-1])
    fresh = head.copy()
    fresh[1:] |= doc[1:] != doc[:-1]
    doc, key, check, head = doc[fresh], key[fresh], check[fresh], head[fresh]
    known = ~head
    if first_too:
        known[:-1] |= known[1:]
    d, k, c = (np.concatenate([x[head], x[known]]) for x in (doc, key, check))
    flag = np.zeros(len(d), dtype=bool)
    flag[head.sum() :] = True
    yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(k.view(np.int64)), pa.array(c), pa.array(flag)], ["doc", "key", "check", "known"])


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, docs, keys = batch.column(0).to_numpy(zero_copy_only=False), [], []
        for a, b in slices(batch.column(1)):
            words = Words(batch.column(1).slice(a, b - a))
            at, key = _anchors(words)
            docs.append(ids[a:b][words.row[at]])
            keys.append(key)
        if docs:
            keys = np.concatenate(keys)
            yield from _fold(np.concatenate(docs), keys, np.zeros(len(keys), dtype=np.int32), True)


def _shared(first_too: bool):
    """Walk rows sorted by (known, key, check, doc): emit known rows, and open rows of groups with another document.

    A group is the rows of one (key, check). first_too: also the smallest document of such a group.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, least, was = None, 0, False  # the open group: its key and check, smallest document, and whether another came
        for batch in batches:
            doc, key, check, known = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            out_d, out_k = [doc[known]], [key[known]]
            doc, key, check = doc[~known], key[~known], check[~known]
            if len(doc):
                head = np.ones(len(doc), dtype=bool)
                head[1:] = (key[1:] != key[:-1]) | (check[1:] != check[:-1])
                group, low, keys = np.cumsum(head) - 1, doc[head], key[head]
                old = np.zeros(len(low), dtype=bool)
                if (keys[0], check[0]) == last:
                    low[0], old[0] = least, was
                later = doc > low[group]
                hit = old.copy()
                hit[group[later]] = True
                out_d.append(doc[later])
                out_k.append(key[later])
                if first_too:
                    out_d.append(low[hit & ~old])
                    out_k.append(keys[hit & ~old])
                last, least, was = (keys[-1], check[-1]), low[-1], bool(hit[-1])
            d, k = np.concatenate(out_d), np.concatenate(out_k)
            if len(d):
                yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(k, pa.int64())], ["doc", "key"])

    return walk


def _exchange(rows: DataFrame, first_too: bool) -> DataFrame:
    spread = F.when(F.col("known"), F.xxhash64("doc", "key")).otherwise(F.col("key"))
    dealt = rows.repartition(spread).sortWithinPartitions("known", "key", "check", "doc")
    return dealt.mapInArrow(_shared(first_too), "doc long, key long")


def _members(words: Words, rows: np.ndarray, keys: np.ndarray, lists: pa.Array) -> np.ndarray:
    """Whether keys[i] is in the list of row rows[i]."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(U)
    sizes = np.diff(lists.offsets.to_numpy()) if not lists.null_count else np.array([len(x) if x is not None else 0 for x in lists.to_pylist()])
    owner = np.repeat(np.arange(len(lists), dtype=U), sizes)
    return np.isin(mix(keys + mix(rows.astype(U))), mix(flat + mix(owner)))


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, docs, keys, checks = batch.column(0).to_numpy(zero_copy_only=False), [], [], []
        for a, b in slices(batch.column(1)):
            words = Words(batch.column(1).slice(a, b - a))
            at, key = _anchors(words)
            hit = at[_members(words, words.row[at], key, batch.column(2).slice(a, b - a))]
            window, whole = words.windows(WINDOW)
            near = np.zeros(len(window) + 1, dtype=np.int32)
            np.add.at(near, np.maximum(hit - PERIOD + 1, 0), 1)
            np.add.at(near, hit + 1, -1)
            pick = np.flatnonzero((np.cumsum(near[:-1]) > 0) & whole)
            docs.append(ids[a:b][words.row[pick]])
            keys.append(window[pick])
            checks.append(words.checks(pick, WINDOW))
        if docs:
            yield from _fold(np.concatenate(docs), np.concatenate(keys), np.concatenate(checks), False)


def _removal(carried: list[str]):
    names = ["doc", "n_words", "n_removed", "kept_sha256", "kept_text", *carried]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1)):
                words = Words(batch.column(1).slice(a, b - a))
                gone = np.zeros(len(words.start) + 1, dtype=np.int32)
                lists = batch.column(2).slice(a, b - a)
                if len(lists.flatten()):
                    window, whole = words.windows(WINDOW)
                    at = np.flatnonzero(whole)
                    at = at[_members(words, words.row[at], window[at], lists)]
                    np.add.at(gone, at, 1)
                    np.add.at(gone, at + WINDOW, -1)
                kept = np.cumsum(gone[:-1]) == 0
                counts = np.diff(words.first)
                left = np.concatenate([[0], np.cumsum(kept)])
                removed = counts - (left[words.first[1:]] - left[words.first[:-1]])
                data, text = words.data.tobytes(), []
                for row in range(b - a):
                    own = data[words.offsets[row] : words.offsets[row + 1]].split()
                    if removed[row]:
                        own = compress(own, kept[words.first[row] : words.first[row + 1]].tolist())
                    text.append(b" ".join(own))
                digest = [hashlib.sha256(x).hexdigest() for x in text]
                text = [x if gone_ else data[words.offsets[i] : words.offsets[i + 1]] for i, (x, gone_) in enumerate(zip(text, removed, strict=True))]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string()), pa.array(text, pa.binary()).cast(pa.string()),
                        *[c.slice(a, b - a) for c in batch.columns[3:]],
                    ],
                    names,
                )

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Remove each word under a 13-word window whose words also start in a document with a smaller id.

    Returns one row per input row: id_col, n_words, n_removed, kept_sha256 (of the kept words joined by one space), kept_text (the
    same words so joined; the text as it is, empty for null, where none was removed).
    A null text has no words; a null id takes no part (its words stay, and nothing is removed on its account); rows
    that repeat an id count as one document, so they never remove each other's words. Columns named in ``carry`` come
    along as they are after these, with ``_in`` behind a name that is one of these; others are left out. Windows of two documents are equal
    if two independent hashes of their words, 95 bits together, are.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"), *[F.col(c).alias(f"_carried{i}") for i, c in enumerate(carry)])
    usable = base.select("doc", "text").where("doc is not null and text is not null")
    shared = stored(_exchange(usable.mapInArrow(_anchor_rows, _ROWS), True), "anchors")
    release(spark)
    lists = shared.groupBy("doc").agg(F.collect_list("key").alias("keys"))
    near = usable.join(lists, "doc").select("doc", "text", "keys").mapInArrow(_window_rows, _ROWS)
    covered = stored(_exchange(near, False), "windows")
    release(spark)
    lists = covered.groupBy("doc").agg(F.collect_list("key").alias("keys"))
    carried = [f"_carried{i}" for i in range(len(carry))]
    out = base.join(lists, "doc", "left").select("doc", "text", "keys", *carried)
    schema = StructType.fromDDL("doc long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    for name in carried:
        schema = schema.add(out.schema[name])
    done = out.mapInArrow(_removal(carried), schema).withColumnRenamed("doc", id_col)
    return done.select(*done.columns[:5], *[F.col(n).alias(c) for n, c in zip(carried, free_names(list(carry), done.columns[:5]), strict=True)])
