"""Results that are kept between runs: retrieval, embeddings and responses, under keys that name all they depend on."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a finished table lies at the path, in any store that Spark reads."""
    jvm, at = spark.sparkContext._jvm, f"{path}/_SUCCESS"
    place = jvm.org.apache.hadoop.fs.Path(at)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at the path; made and written first where there is none (an unfinished one is written anew)."""
    if not exists(spark, path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def fingerprint(rows: DataFrame) -> str:
    """Number of rows and a hash of ids and sentences that doesn't depend on their order."""
    found = rows.agg(F.count("*").alias("n"), F.sum(F.xxhash64("id", "sentence").cast("decimal(38,0)")).alias("h")).first()
    return hashlib.sha256(f"{found['n']}:{found['h']}".encode()).hexdigest()[:16]


def retrieval_path(root: str, o, split: str, backend: str, data: str) -> str:
    """Key of a retrieval: method, options, evaluation split, embedding backend and the data's fingerprint."""
    weights = f"{o.alpha_token_match}_{o.alpha_embed_sim}_{o.entity_weight}_{o.context_weight}_{o.other_weight}_{o.context_len}"
    return f"{root}/{o.task}/{split}/{o.retrieval}_{o.demo_num}_{weights}_{backend.replace('/', '-')}_{data}"


def embedding_path(root: str, task: str, split: str, backend: str, data: str) -> str:
    return f"{root}/{task}/embeddings/{split}_{backend.replace('/', '-')}_{data}"
