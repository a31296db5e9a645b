"""Annotated sentences: JSONL and tables in, results out, samples and derived fixtures."""

from __future__ import annotations

import hashlib
import json
import random
from dataclasses import asdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlens.functions.text import join_tokens, span, split_tokens, starts_upper

_S = T.StringType()
ENT = T.StructType().add("name", _S).add("type", _S).add("token_idx", T.ArrayType(T.IntegerType()))
TOK = T.StructType().add("token", _S).add("span", T.ArrayType(_S)).add("token_index", T.IntegerType())
REFLECT = T.StructType().add("fp_tokens", T.ArrayType(TOK)).add("fn_tokens", T.ArrayType(TOK)).add("unseen_tokens", T.ArrayType(TOK)).add("fn_spans", T.ArrayType(ENT))
ITEM = (
    T.StructType().add("split", _S).add("id", _S).add("tokens", T.ArrayType(_S)).add("ent_list", T.ArrayType(ENT)).add("sentence", _S)
    .add("icl_example_ids", T.ArrayType(_S)).add("icl_prompt", _S).add("llm_response", _S).add("ent_list_pred", T.ArrayType(ENT)).add("ent_list_pred_prior", T.ArrayType(ENT))
    .add("reflect_tokens", REFLECT).add("reflect_prompt", _S).add("boundary_tokens", T.ArrayType(TOK)).add("error", _S)
)


def split_path(data_dir: str, split: str) -> str:
    return f"{data_dir}/{split}.jsonl"


def result_path(root: str, options, stage: str, run: dict | None = None) -> str:
    """Key of a run: the main options in words, and a hash of all options and of ``run``, what else changes its result."""
    o = options
    size = f"train{o.train_num or 'all'}_eval{o.eval_num or 'all'}_seed{o.sample_seed}"
    whole = json.dumps([asdict(o), stage, run or {}], sort_keys=True, default=str)
    return f"{root}/{o.task}/{size}/{o.retrieval}_{o.demo_num}_{o.template}_{hashlib.sha256(whole.encode()).hexdigest()[:16]}/{stage}"


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with the declared schema; ``sentence`` defaults to the joined tokens; a missing path raises."""
    items = spark.read.schema(ITEM).json(path)
    return items.withColumn("sentence", F.coalesce("sentence", join_tokens(F.col("tokens")))).withColumn("ord", F.col("id").cast("long"))


def write_items(reflected: DataFrame, kept: DataFrame | None, path: str) -> None:
    """Results as JSON lines: reflected rows before kept ones."""
    out = reflected.withColumn("part", F.lit(0))
    if kept is not None:
        out = out.unionByName(kept.withColumn("part", F.lit(1)), allowMissingColumns=True)
    names = [f.name for f in ITEM.fields if f.name in out.columns]
    out.repartitionByRange("part", F.col("id").cast("long")).sortWithinPartitions("part", F.col("id").cast("long")).select(*names).write.json(path)


def read_sentence_embeddings(items: DataFrame, path: str) -> DataFrame:
    """Left join of {id, sentence_embedding} lines; rows without one keep null."""
    found = items.sparkSession.read.schema("id string, sentence_embedding array<double>").json(path)
    return items.join(found.dropDuplicates(["id"]), "id", "left")


def read_vocabulary_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """(token, emb) of a JSON object token -> vector."""
    text = spark.read.text(path, wholetext=True)
    pairs = F.explode(F.from_json("value", "map<string,array<double>>"))
    return text.select(pairs.alias("token", "emb"))


def numbered(rows: DataFrame, column: str = "ord", buckets: int = 200) -> DataFrame:
    """Rows with their 0-based ``place`` in the order of a numeric column, without ordering all in one task.

    Quantiles cut the column into buckets; bucket sizes (at most ``buckets`` rows) give each bucket's first place, and
    rows are ordered inside their bucket only.
    """
    cuts = rows.agg(F.percentile_approx(column, [i / buckets for i in range(1, buckets)], 100 * buckets).alias("cuts")).first()["cuts"] or []
    bounds = F.array(*[F.lit(c) for c in sorted(set(cuts))]) if cuts else F.array().cast("array<long>")
    dealt = rows.withColumn("_bucket", F.size(F.filter(bounds, lambda b: b < F.col(column))))
    sizes = dealt.groupBy("_bucket").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = F.broadcast(sizes.select("_bucket", before.alias("_first")))
    inner = F.row_number().over(Window.partitionBy("_bucket").orderBy(column)) - 1
    return dealt.withColumn("_n", inner).join(first, "_bucket").withColumn("place", (F.col("_first") + F.col("_n")).cast("long")).drop("_bucket", "_n", "_first")


def shuffled_sample(rows: DataFrame, n: int, seed: int) -> DataFrame:
    """The rows at the first n places of Python's seeded shuffle of all places by ``ord``, with their ``place``.

    The shuffle itself is made on the driver, as equality with Python's needs; ``hashed_sample`` is the way without it.
    """
    total = rows.count()
    places = list(range(total))
    random.Random(seed).shuffle(places)
    order = rows.sparkSession.createDataFrame([(p, i) for i, p in enumerate(places[:n])], "at long, place long")
    return numbered(rows).withColumnRenamed("place", "at").join(order, "at").drop("at")


def hashed_sample(rows: DataFrame, n: int, seed: int) -> DataFrame:
    """n rows in the order of a hash of id and seed; a distributed top-n."""
    dice = F.md5(F.concat(F.col("id").cast("string"), F.lit(f":{seed}")))
    return rows.withColumn("dice", dice).orderBy("dice", "id").limit(n)


def sentences(docs: DataFrame) -> DataFrame:
    """(id, ord, tokens, sentence) of whole documents; a null text has no tokens."""
    tokens = split_tokens(F.col("text"))
    return docs.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("ord"), tokens.alias("tokens")).withColumn("sentence", join_tokens(F.col("tokens")))


def token_rows(sents: DataFrame) -> DataFrame:
    return sents.select("id", F.posexplode("tokens").alias("pos", "token"))


def _runs(flags: pa.Array) -> pa.Array:
    """First and last place of each run of true flags in each row."""
    size = np.diff(flags.offsets.to_numpy())
    base = np.append(0, np.cumsum(size + 1))  # a false flag ends each row
    row = np.repeat(np.arange(len(size)), size)
    on = np.zeros(base[-1] + 1, dtype=np.int8)
    on[np.arange(len(row)) + row] = flags.flatten().to_numpy(zero_copy_only=False)
    edge = np.diff(on, prepend=0)
    s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
    row = np.searchsorted(base, s, side="right") - 1
    ends = [pa.array((x - base[row]).astype(np.int32)) for x in (s, e)]
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(size) + 1)).astype(np.int32)), pa.StructArray.from_arrays(ends, ["s", "e"]))


def _named(tokens, x, e, kind=None):
    name = join_tokens(span(tokens, x["s"], e))
    return F.struct(x["s"].alias("s"), e.alias("e"), name.alias("name"), *([] if kind is None else [kind.alias("type")]))


def with_gold(sents: DataFrame) -> DataFrame:
    """Sentences with ``gold``: maximal runs of capitalised tokens as (s, e, name, type), in order; a rule on the start leaves some unlabelled.

    Everything is made from the row itself, so no exchange is needed. The explode of one keeps the optimizer from putting
    the tokenizer into functions of each token or name below.
    """
    sents = sents.withColumn("tokens", F.explode(F.array("tokens")))
    runs = F.arrow_udf(_runs, "array<struct<s:int,e:int>>")(F.transform("tokens", starts_upper))
    rows = sents.withColumn("_runs", runs)
    kind = lambda name: F.element_at(F.array(*map(F.lit, ("LOC", "PER", "ORG", "MISC"))), F.length(name) % 4 + 1)
    named = F.transform(F.filter("_runs", lambda x: x["s"] % 3 != 0), lambda x: _named(F.col("tokens"), x, x["e"]))
    return rows.withColumn("gold", F.transform(named, lambda x: x.withField("type", kind(x["name"])))).drop("_runs")


def with_predicted(rows: DataFrame) -> DataFrame:
    """Rows of ``with_gold`` with ``pred``: some lost, some one token too long, some of a type outside the label set."""
    end = lambda x: F.when((x["s"] % 5 == 0) & (x["e"] + 1 < F.size("tokens")), x["e"] + 1).otherwise(x["e"])
    kind = lambda x: F.when(x["s"] % 11 == 0, F.lit("X")).otherwise(x["type"])
    return rows.withColumn("pred", F.transform(F.filter("gold", lambda x: x["s"] % 7 != 0), lambda x: _named(F.col("tokens"), x, end(x), kind(x))))


def entity_rows(rows: DataFrame, column: str) -> DataFrame:
    """(id, ent_ord, s, e, name, type), one row an entity of a nested column."""
    return rows.select("id", F.explode(column).alias("x")).select("id", F.col("x.s").alias("ent_ord"), "x.s", "x.e", "x.name", "x.type")


def nested_entities(rows: DataFrame, name: str = "ents") -> DataFrame:
    """One row per id: its entities in order of start."""
    one = F.struct("s", "e", "name", "type")
    return rows.groupBy("id").agg(F.array_sort(F.collect_list(one)).alias(name))
