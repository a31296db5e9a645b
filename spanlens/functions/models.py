"""Model calls: protocols, retries with per-row errors, and backends that need no network."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import NamedTuple, Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType


class EmbeddingModel(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Answer(NamedTuple):
    text: str
    logprobs: list[float] | None = None  # one a token of the text


class LanguageModel(Protocol):
    """A model that also gives log-probabilities has ``answers`` besides: list[str] -> list[Answer]."""

    def generate(self, prompts: list[str]) -> list[str]: ...


def retried(call: Callable, *args, tries: int = 3, pause: float = 1.0):
    """The call's result; after a failure again, with doubling pauses."""
    for turn in range(tries):
        try:
            return call(*args)
        except Exception:
            if turn == tries - 1:
                raise
            time.sleep(pause * 2**turn)


def _batched(make: Callable, method: str, batch: int, sleep: float, pause: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for frame in frames:
            for start in range(0, len(frame), batch):
                part = frame.iloc[start : start + batch]
                try:
                    got, error = retried(getattr(model, method), part["text"].tolist(), pause=pause), None
                except Exception as e:  # one failed batch is a column, not a failed run
                    got, error = [None] * len(part), str(e)
                columns = {"key": part["key"], "out": got, "error": error}
                if method == "answers":
                    columns |= {"out": [x and x.text for x in got], "logprobs": [x and x.logprobs for x in got]}
                yield pd.DataFrame(columns)
                if sleep:
                    time.sleep(sleep)

    return run


def generate(prompts: DataFrame, make: Callable[[], LanguageModel], batch: int = 64, sleep: float = 0.0, streams: int | None = None, pause: float = 1.0, logprobs: bool = False) -> DataFrame:
    """(key, out, error) of prompts(key, text), with ``logprobs`` also an array of one number a token of the answer.

    ``streams`` bounds how many partitions call at once.
    """
    rows = prompts.select("key", "text")
    rows = rows.repartition(streams) if streams else rows
    schema = rows.select("key").schema.add("out", "string").add("error", "string")
    if logprobs:
        schema = schema.add("logprobs", ArrayType(DoubleType()))
    return rows.mapInPandas(_batched(make, "answers" if logprobs else "generate", batch, sleep, pause), schema)


def embed(texts: DataFrame, make: Callable[[], EmbeddingModel], batch: int = 128, sleep: float = 0.0, pause: float = 1.0) -> DataFrame:
    """(key, out array<double>, error) of texts(key, text), line breaks turned to spaces; batches are 2048 at most."""
    rows = texts.select("key", F.replace("text", F.lit("\n"), F.lit(" ")).alias("text"))
    schema = rows.select("key").schema.add("out", ArrayType(DoubleType())).add("error", "string")
    return rows.mapInPandas(_batched(make, "embed", min(batch, 2048), sleep, pause), schema)


def replay(prompts: DataFrame, responses: DataFrame) -> DataFrame:
    """(key, out, error) from recorded responses(key, text); prompts without one have an error."""
    met = prompts.select("key").join(responses.select("key", F.col("text").alias("out")), "key", "left")
    return met.select("key", "out", F.when(F.col("out").isNull(), F.lit("no recorded response")).alias("error"))


def answered(prompts: DataFrame, model: Callable | DataFrame, **calls) -> DataFrame:
    """(key, out, error) of prompts(key, text) from a factory of models, or from recorded responses(key, text)."""
    if not isinstance(model, DataFrame):
        return generate(prompts, model, **calls)
    found = replay(prompts.select(F.col("key").cast("string").alias("key")), model.select(F.col("key").cast("string").alias("key"), "text"))
    return found.withColumn("key", F.col("key").cast(prompts.schema["key"].dataType))


def missing_keys(prompts: DataFrame, answered: DataFrame) -> DataFrame:
    """Prompts that have no answer yet: what a second run has to ask."""
    return prompts.join(answered.where("error is null").select("key"), "key", "left_anti")


class HashEmbedding:
    """Deterministic vectors from a hash of the text, for tests and dry runs."""

    def __init__(self, dim: int = 16) -> None:
        self.dim = dim

    def embed(self, texts: list[str]) -> list[list[float]]:
        import hashlib

        return [[b / 255 - 0.5 for b in hashlib.sha256(t.encode()).digest()[: self.dim]] for t in texts]


class Echo:
    """Answers every prompt with itself."""

    def generate(self, prompts: list[str]) -> list[str]:
        return prompts
