"""Language identification: multinomial naive Bayes over hashed character n-grams.

N-grams of one to three letters (case folded, one mark for each gap between words) are hashed to FEATURES slots and
counted for each language over all training rows. The log-probability matrix has FEATURES rows and a column a language;
it is broadcast in parts of at most PART_LANGUAGES columns, and batches are scored in numpy against one part after the
other, so any number of languages is taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from .blocks import slices
from .shared import free_names, stored

FEATURES, ORDERS, SMOOTHING, PART_LANGUAGES, STEP = 1 << 16, 3, 0.5, 256, 1 << 20
UNKNOWN = "und"
_letter: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _letter
    if _letter is None:
        _letter = np.fromiter((not 0xD800 <= i < 0xE000 and chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
    return _letter


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-gram of every place, and its row."""
    folded = [(x or "").lower() for x in texts]
    points = np.frombuffer(" ".join([*folded, ""]).encode("utf-32-le", "replace"), dtype=np.uint32)
    row = np.repeat(np.arange(len(folded)), [len(x) + 1 for x in folded])
    is_letter = _letters()[points]
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    point, row, is_letter = np.where(is_letter, points, 0)[keep], row[keep], is_letter[keep]
    # the gap that closes a row's last word belongs to that row; a row's first word has the mark of a gap before it
    codes, rows = [], []
    gram = np.zeros(len(point), dtype=np.uint32)
    for order in range(ORDERS):
        before = np.zeros_like(point)
        if order:
            before[order:] = np.where(row[order:] == row[:-order], point[:-order], 0)
        else:
            before = point
        gram = gram * np.uint32(0x9E3779B1) + before + np.uint32(order + 1)
        code = (gram ^ (gram >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        code = (code ^ (code >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        take = is_letter if not order else slice(None)
        codes.append((code >> np.uint32(16))[take])
        rows.append(row[take])
    return np.concatenate(codes), np.concatenate(rows)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    rows: dict[str, int] = {}
    for batch in batches:
        for a, b in slices(batch.column(0), STEP):
            langs = batch.column(1).slice(a, b - a).to_pylist()
            names = sorted(set(langs))
            code, row = features(batch.column(0).slice(a, b - a).to_pylist())
            kind = np.array([names.index(x) for x in langs])
            found = np.bincount(kind[row] * FEATURES + code, minlength=len(names) * FEATURES).reshape(-1, FEATURES)
            for i, name in enumerate(names):
                total[name] = total.get(name, 0) + found[i]
                rows[name] = rows.get(name, 0) + int((kind == i).sum())
    for name, found in total.items():
        at = np.flatnonzero(found)
        slot, n = np.append(at, -1), np.append(found[at], rows[name])
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(slot), pa.string()), pa.array(slot, pa.int32()), pa.array(n, pa.int64())], ["lang", "slot", "n"])


class Part:
    """Log-probabilities of FEATURES slots (float64, a row a language) and of the languages, for some of them."""

    def __init__(self, langs: list[str], counts: np.ndarray, share: np.ndarray) -> None:
        self.langs = langs
        self.logs = np.log((counts + SMOOTHING) / (counts.sum(axis=1, keepdims=True) + SMOOTHING * FEATURES))
        self.prior = np.log(share)

    def best(self, texts: list[str | None]) -> tuple[list[str | None], np.ndarray, np.ndarray]:
        """Most probable language of each text (null without a letter), its log-score, and the log of all scores' sum."""
        code, row = features(texts)
        some = np.zeros(len(texts), dtype=bool)
        some[row] = True
        score = np.stack([np.bincount(row, weights=logs[code], minlength=len(texts)) for logs in self.logs]) + self.prior[:, None]
        top = score.argmax(axis=0)
        most = score.max(axis=0)
        return [self.langs[t] if s else None for t, s in zip(top, some, strict=True)], most, most + np.log(np.exp(score - most).sum(axis=0))


class LanguageModel:
    """Counts in a stored table (lang, slot, n), of which a part of the languages comes to the driver at a time."""

    def __init__(self, table: DataFrame) -> None:
        self.table = table
        rows = sorted((r["lang"], r["n"]) for r in table.where("slot < 0").collect())  # a row a language
        self.rows = dict(rows)

    def parts(self) -> Iterator[Part]:
        langs, whole = list(self.rows), sum(self.rows.values())
        for start in range(0, len(langs), PART_LANGUAGES):
            names = langs[start : start + PART_LANGUAGES]
            found = self.table.where((F.col("slot") >= 0) & (F.col("lang") >= names[0]) & (F.col("lang") <= names[-1])).toPandas()
            counts = np.zeros((len(names), FEATURES))
            kind = found["lang"].map({x: i for i, x in enumerate(names)}).to_numpy(dtype=np.int64)
            counts[kind, found["slot"].to_numpy(dtype=np.int64)] = found["n"].to_numpy()
            yield Part(names, counts, np.array([self.rows[x] for x in names]) / whole)


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Count n-grams of every row whose language is not null; no sample is taken. Null texts count for the prior alone."""
    rows = labelled.where(F.col(lang_col).isNotNull()).select(F.col(text_col).cast("string"), F.col(lang_col).cast("string"))
    return LanguageModel(stored(rows.mapInArrow(_counts, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")), "grams"))


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score (the posterior, 0 to 1) of every whole text; all columns stay as they are.

    A null text or one without a letter is ``und`` with score 0, as is any text if nothing was learned. Of languages
    with equal scores the first by name is taken. Columns of ``docs`` that have these names get ``_in`` behind them.
    """
    names = free_names(docs.columns, ["lang_pred", "score"])
    at, added = docs.columns.index(text_col), 0
    out = plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    for part in model.parts():
        sent = docs.sparkSession.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a, b in slices(batch.column(at), STEP):
                    rows = batch.slice(a, b - a)
                    found, best, whole = sent.value.best(rows.column(at).to_pylist())
                    new = [pa.array(found, pa.string()), pa.array(best, pa.float64()), pa.array(whole, pa.float64())]
                    labels = [*batch.schema.names, *(f"{x}{rows.num_columns}" for x in ("lang", "best", "sum"))]
                    yield pa.RecordBatch.from_arrays([*rows.columns, *new], names=labels)

        schema, width = StructType([*out.schema.fields]), len(out.columns)
        for name, kind in (("lang", StringType()), ("best", DoubleType()), ("sum", DoubleType())):
            schema = schema.add(f"{name}{width}", kind)
        out, added = out.mapInArrow(run, schema), added + 1
    if not added:
        return plain.select(*plain.columns, F.lit(UNKNOWN), F.lit(0.0)).toDF(*names, "lang_pred", "score")
    found, best, whole = ([F.col(out.columns[len(names) + 3 * i + j]) for i in range(added)] for j in range(3))
    most = best[0] if added == 1 else F.greatest(*best)
    top = F.coalesce(*[F.when(b == most, x) for x, b in zip(found, best, strict=True)])
    score = sum((F.exp(w - most) for w in whole[1:]), F.exp(whole[0] - most))
    some = found[0].isNotNull()
    return out.select(*plain.columns, F.when(some, top).otherwise(UNKNOWN), F.when(some, 1 / score).otherwise(0.0)).toDF(*names, "lang_pred", "score")


def held_out(id_col: str = "doc_id") -> Column:
    """Whether the CRC-32 of the id as text leaves 2 modulo 4; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
