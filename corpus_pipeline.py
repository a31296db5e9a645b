"""The corpus pipeline: stages over ``documents``, each calling one operator of ``spanlens.llm``.

Every stage takes all rows its predecessor kept and returns the columns of ``documents``; the last returns the packed
pieces. Stages are applied in order, each written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlens.llm.langid import UNKNOWN, identify, train
from spanlens.llm.mixing import copies
from spanlens.llm.packing import pack
from spanlens.llm.queries import tokenizer_path
from spanlens.llm.shared import stored
from spanlens.llm.simhash import near_duplicates
from spanlens.llm.substring import remove_repeats

LEAST_SCORE = 0.5


def _plain(docs: DataFrame) -> DataFrame:
    """The columns as c0, c1, ..., so that none clashes with those that an operator adds."""
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose language stays below LEAST_SCORE, go: null and empty texts among them.

    Rows that repeat are judged alike; null ids and other nulls don't matter; an empty table stays empty.
    """
    plain, text = _plain(docs), f"c{docs.columns.index('text')}"
    found = identify(plain, train(docs.select("text", "lang")), text)
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*plain.columns).toDF(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (Jaccard of five-word shingles, 0.8) the document with the smallest id stays.

    Texts without words (null ones, too) are alike. Rows that repeat an id count as one document; the one with the least
    hash of its text stays. Rows without an id stay as they are; an empty table stays empty.
    """
    return near_duplicates(docs, width=5)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words under passages that a smaller document also has go; a document left without words goes.

    Rows without an id or a text stay as they are; rows that repeat an id never cut each other; n_chars follows a cut text.
    """
    plain, at = _plain(docs), {c: f"c{i}" for i, c in enumerate(docs.columns)}
    carry = tuple(at[c] for c in docs.columns if c not in ("doc_id", "text"))
    out = remove_repeats(plain, at["doc_id"], at["text"], carry).where("n_removed = 0 or n_removed < n_words")
    changed = {"text": F.col("kept_text")}
    if "n_chars" in at:
        changed["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col(at["n_chars"]))
    return out.select(*[changed.get(c, F.col(at[c])).alias(c) for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it (not at all to twice), so that sources come near their targets.

    Null sources are one source, null texts have no words and go as often as their source goes whole. Within a source a
    hash of id and text decides, so rows that repeat both are taken alike; an empty table stays empty.
    """
    return copies(docs).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, placed in sequences of 4096 tokens.

    A null or empty text is its end token; rows that repeat are packed each for itself; null ids are kept; an empty
    table gives no rows.
    """
    return pack(docs, tokenizer_path())


STAGES = [("language", language), ("near_copies", near_copies), ("repeats", repeats), ("mix", mix), ("packed", packed)]
#: Bayes scores, hashes by seed and the packing program aren't SQL; tests/llm holds each stage against a brute-force version on small tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
