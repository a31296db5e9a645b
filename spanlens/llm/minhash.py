"""One-permutation MinHash fingerprints with optimal densification and packed low-order bits.

Each shingle of five words is hashed once; the top bits name its bin and the rest compete for the bin's minimum. An
empty bin takes the value of the first non-empty bin in its own pseudo-random sequence of bins, the same sequence for
every document, so two documents agree on a bin with probability equal to their Jaccard similarity. Of each minimum
only the low byte is kept; the share of agreeing bins is corrected for the chance 2**-8 that unequal values agree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import U, Words, mix, slices
from .order import with_next

BINS, BIN_BITS, KEPT_BITS, SHINGLE = 256, 8, 8, 5
_NONE = U(2**64 - 1)


def _shingles(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each shingle; a row of fewer words is one shingle."""
    key, whole = words.windows(SHINGLE)
    at = np.flatnonzero(whole)
    counts = np.diff(words.first)
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    lone = words.spans(words.first[short], words.first[short + 1])
    return np.concatenate([key[at], lone]), np.concatenate([words.row[at], short])


def _densify(least: np.ndarray) -> np.ndarray:
    """Fill the empty bins of every row that has any value."""
    full = least != _NONE
    out = least.copy()
    row, slot = np.nonzero(~full & full.any(axis=1)[:, None])
    turn = 0
    while len(row):
        turn += 1
        donor = (mix(slot.astype(U) * U(0x9E3779B97F4A7C15) + mix(np.array([turn], dtype=U))) % U(BINS)).astype(np.int64)
        if turn > 64 * BINS:
            donor = (slot + turn) % BINS
        got = full[row, donor]
        out[row[got], slot[got]] = least[row[got], donor[got]]
        row, slot = row[~got], slot[~got]
    return out


def fingerprints(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Packed fingerprints (rows x BINS bytes) of whole texts, and whether each has a word."""
    packed, some = [np.zeros((0, BINS), dtype=np.uint8)], [np.zeros(0, dtype=bool)]
    for a, b in slices(texts):
        words = Words(texts.slice(a, b - a))
        key, row = _shingles(words)
        least = np.full((b - a) * BINS, _NONE, dtype=U)
        np.minimum.at(least, row * BINS + (key >> U(64 - BIN_BITS)).astype(np.int64), key & U(2 ** (64 - BIN_BITS) - 1))
        least = least.reshape(-1, BINS)
        has = (least != _NONE).any(axis=1)
        packed.append((_densify(least) & U(2**KEPT_BITS - 1)).astype(np.uint8) * has[:, None])
        some.append(has)
    return np.concatenate(packed), np.concatenate(some)


def likeness(a: np.ndarray, some_a: np.ndarray, b: np.ndarray, some_b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity, row by row; two texts without words are alike, one without is unlike any other."""
    chance = 2.0**-KEPT_BITS
    found = np.clip(((a == b).mean(axis=1) - chance) / (1 - chance), 0, 1)
    return np.where(some_a & some_b, found, (some_a == some_b).astype(float))


def _edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc, text, guest) in order; emits each row that isn't a guest when the row after it is known."""
    names = ["doc", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    held: pa.RecordBatch | None = None
    for batch in batches:
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        held = batch.slice(len(batch) - 1)
        for start in range(0, len(batch) - 1, 512):
            part = batch.slice(start, min(513, len(batch) - start))
            texts = [x or "" for x in part.column(1).to_pylist()]
            prints, some = fingerprints(pa.array(texts, pa.large_string()))
            own = np.flatnonzero(~part.column(2).to_numpy(zero_copy_only=False)[:-1])
            edited = []
            for i in own.tolist():
                cut = len(texts[i]) // 3
                edited.append(texts[i][: len(texts[i]) - cut] + texts[i + 1][:cut])
            new, new_some = fingerprints(pa.array(edited, pa.large_string()))
            hexes = [p.tobytes().hex() if s else "" for p, s in zip(prints[own], some[own], strict=True)]
            new_hexes = [p.tobytes().hex() if s else "" for p, s in zip(new, new_some, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).take(pa.array(own)), pa.array([len(texts[i]) for i in own.tolist()], pa.int64()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited], pa.string()),
                    pa.array(hexes, pa.string()), pa.array(new_hexes, pa.string()), pa.array(likeness(prints[own], some[own], new, new_some), pa.float64()), pa.array(likeness(prints[own], some[own], prints[own + 1], some[own + 1]), pa.float64()),
                ],
                names,
            )


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edit, in which the last third gives way to the head of the next by id.

    Returns id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint (hex; empty for a text without words),
    near_edited, near_next. A null text is empty. Null ids come last; rows that repeat an id follow each other in order
    of text. Other columns are left out.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    if not base.limit(1).count():
        dealt = base.select("doc", "text", F.lit(False).alias("guest"))
    else:
        order = ("bucket", "guest", F.col("doc").desc(), "text")
        dealt = with_next(base, "doc").repartition("bucket").sortWithinPartitions(*order).select("doc", "text", "guest")
    schema = "doc long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.mapInArrow(_edit, schema).withColumnRenamed("doc", id_col)


def text_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fingerprint) of each whole text; a null or wordless text has an empty fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, some = fingerprints(batch.column(1))
            out = [p.tobytes().hex() if s else "" for p, s in zip(prints, some, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc", "fingerprint"])

    base = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    return base.mapInArrow(run, "doc long, fingerprint string").withColumnRenamed("doc", id_col)
