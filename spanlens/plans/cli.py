"""Command line: ``python -m spanlens.plans.cli STAGE --data DIR --out DIR``.

Stages are icl, unseen, fn and boundary, ``chain`` for all of them in turn, ``evaluate`` and ``evaluate-boundary``. Each
stage writes items, which the next reads as ``--prior``; the chain stops at a stage with failed rows. Answers come from a
chat server or from recorded responses, vectors from an embedding backend or from files.
"""

from __future__ import annotations

import argparse
import shlex
from contextlib import nullcontext
from dataclasses import fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlens.config import PRESETS, Options
from spanlens.functions import backends
from spanlens.functions.models import embed
from spanlens.operators import retrieval
from spanlens.plans import pipeline as P
from spanlens.sources import annotated as A
from spanlens.sources import cache as C

STAGES = ("icl", "unseen", "fn", "boundary")
#: Arguments that change a result besides the options.
RUN = (
    "eval_split", "prior", "model_type", "model_name", "model_url", "temperature", "top_p", "max_tokens", "stop", "response_format", "model_seed", "responses",
    "emb_type", "emb_name", "emb_url", "sentence_vectors", "vocabulary_vectors", "exact_sample",
)


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(description=__doc__)
    add = out.add_argument
    add("stage", choices=[*STAGES, "chain", "evaluate", "evaluate-boundary"])
    add("--data", required=True, help="folder of <split>.jsonl")
    add("--eval-split", default="test", choices=["train", "dev", "test", "test_sample_1000"])
    add("--prior", help="results of the stage before; needed by reflection and evaluation")
    add("--out", help="folder for results")
    add("--cache", help="folder for vectors and retrieved demonstrations that later runs can use")
    add("--preset", choices=sorted(PRESETS))
    add("--exact-sample", action="store_true", help="sample as Python's seeded shuffle does, which is made on the driver")
    add("--model-type", choices=[*sorted(backends.CHAT), "replay"])
    add("--model-name")
    add("--model-url")
    add("--model-key-variable")
    add("--model-command", help="command that starts a server at --model-url, stopped at the end")
    add("--model-seed", type=int, default=42)
    add("--temperature", type=float, default=0.0)
    add("--top-p", type=float, default=1.0)
    add("--max-tokens", type=int, default=1024)
    add("--stop", nargs="*", default=[])
    add("--response-format")
    add("--responses", help="JSON lines {key, text} of recorded answers, for --model-type replay")
    add("--batch-size", type=int, default=64)
    add("--sleep-time", type=float, default=0.0)
    add("--streams", type=int, help="most partitions that call at once")
    add("--emb-type", choices=sorted(backends.EMBEDDINGS))
    add("--emb-name")
    add("--emb-url")
    add("--emb-key-variable")
    add("--emb-batch-size", type=int, default=128)
    add("--sentence-vectors", help="JSON lines {id, sentence_embedding} instead of an embedding backend")
    add("--vocabulary-vectors", help="a JSON object token -> vector instead of an embedding backend")
    for f in fields(Options):
        if f.name == "extra":
            continue
        flag = "--" + f.name.replace("_", "-")
        if isinstance(f.default, bool):
            add(flag, action="store_true", default=None)
        else:
            kind = int if f.name in ("train_num", "eval_num") else type(f.default)
            add(flag, type=kind, choices=P.RETRIEVALS if f.name == "retrieval" else None)
    return out


def options(args: argparse.Namespace) -> Options:
    base = PRESETS[args.preset] if args.preset else Options()
    given = {f.name: getattr(args, f.name) for f in fields(Options) if f.name != "extra" and getattr(args, f.name) is not None}
    return replace(base, **given)


def chat(args: argparse.Namespace, spark: SparkSession):
    """A factory of the model, or the table of recorded answers."""
    if args.model_type is None:
        raise ValueError("this stage calls a model: give --model-type")
    if args.model_type == "replay":
        return spark.read.schema("key string, text string").json(args.responses)
    how = dict(base_url=args.model_url, model=args.model_name, key_variable=args.model_key_variable, temperature=args.temperature, top_p=args.top_p, max_tokens=args.max_tokens, stop=tuple(args.stop), response_format=args.response_format, seed=args.model_seed)
    return backends.factory(backends.CHAT, args.model_type, **how if args.model_type == "server" else {})


def encoder(args: argparse.Namespace):
    if args.emb_type is None:
        raise ValueError("this retrieval needs vectors: give --emb-type, --sentence-vectors or --vocabulary-vectors, or --retrieval random")
    how = {"server": dict(base_url=args.emb_url, model=args.emb_name, key_variable=args.emb_key_variable), "hash": {}}.get(args.emb_type, dict(name=args.emb_name))
    return backends.factory(backends.EMBEDDINGS, args.emb_type, **how)


def kept(args: argparse.Namespace, spark: SparkSession, path, make) -> DataFrame:
    return C.cached(spark, path(), make) if args.cache else make()


def embedded(args: argparse.Namespace, texts: DataFrame, o: Options, split: str) -> DataFrame:
    """(key, emb) of texts(key, text) by the embedding backend; a failed row raises."""
    make = encoder(args)

    def run() -> DataFrame:
        out = embed(texts, make, args.emb_batch_size, args.sleep_time)
        return out.select("key", F.when(F.col("error").isNull(), F.col("out")).otherwise(F.raise_error(F.concat(F.lit("no vector: "), "error"))).alias("emb"))

    data = lambda: C.fingerprint(texts.select(F.col("key").alias("id"), F.col("text").alias("sentence")))
    return kept(args, texts.sparkSession, lambda: C.embedding_path(args.cache, o.task, split, f"{args.emb_type}-{args.emb_name}", data()), run)


def demonstrations(args: argparse.Namespace, side: P.Training, asked: DataFrame, o: Options) -> DataFrame:
    """Retrieved demonstrations, with the vectors that their method needs."""
    spark = asked.sparkSession

    def dense(sents: DataFrame, split: str) -> DataFrame:
        if args.sentence_vectors:
            found = A.read_sentence_embeddings(sents.select(F.col("id").cast("string").alias("id")), args.sentence_vectors)
            return found.select(F.col("id").cast("long").alias("id"), F.coalesce("sentence_embedding", F.raise_error(F.concat(F.lit("no vector for "), "id"))).alias("emb"))
        return embedded(args, sents.select(F.col("id").alias("key"), F.col("sentence").alias("text")), o, split).withColumnRenamed("key", "id")

    def make() -> DataFrame:
        if o.retrieval == "random":
            return P.retrieve(side, asked, o)
        if o.retrieval == "dense":
            return P.retrieve(side, asked, o, dense(side.sents, "train"), dense(asked, args.eval_split))
        if args.vocabulary_vectors:
            words = A.read_vocabulary_embeddings(spark, args.vocabulary_vectors)
        else:
            tokens = A.token_rows(side.sents.unionByName(asked)).select("token").distinct()
            words = embedded(args, tokens.select(F.col("token").alias("key"), F.col("token").alias("text")), o, "tokens").withColumnRenamed("key", "token")
        own, theirs = (retrieval.sentence_vectors(s, side.stats, words, o) for s in (side.sents, asked))
        return P.retrieve(side, asked, o, own, theirs)

    backend = args.sentence_vectors or args.vocabulary_vectors or f"{args.emb_type}-{args.emb_name}"
    return kept(args, spark, lambda: C.retrieval_path(args.cache, o, args.eval_split, backend, f"{C.fingerprint(side.sents)}-{C.fingerprint(asked)}"), make)


def run_stage(args: argparse.Namespace, o: Options, spark: SparkSession, stage: str, prior: str | None, model) -> str:
    """Run one stage and write its items; returns their path."""

    def sampled(items: DataFrame, n: int | None) -> DataFrame:
        if not n:
            return items
        return A.shuffled_sample(items, n, o.sample_seed).drop("place") if args.exact_sample else A.hashed_sample(items, n, o.sample_seed).drop("dice")

    side = P.Training(sampled(A.read_items(spark, A.split_path(args.data, "train")), o.train_num), o)
    items = A.read_items(spark, prior or A.split_path(args.data, args.eval_split))
    items = items if prior else sampled(items, o.eval_num)
    path = A.result_path(args.out, o, stage, {k: getattr(args, k) for k in RUN} | {"prior": prior})
    calls = dict(batch=args.batch_size, sleep=args.sleep_time, streams=args.streams)
    if stage == "icl":
        out = P.run_icl(items, side, demonstrations(args, side, P.sentences_of(items), o), model, o, **calls)
    elif stage == "boundary":
        P.run_boundary_reflection(items, side, model, o, **calls).write.json(f"{path}_spans")
        out = P.boundary_items(items, P.read_spans(spark, f"{path}_spans"))
        out = P.filter_single_tokens(out, side) if o.filter_single_token_fp else out
    else:
        out = P.run_token_reflection(items, side, stage, model, o, **calls)
    A.write_items(out, None, path)
    return path


def main(argv: list[str] | None = None, spark: SparkSession | None = None, model=None):
    """Scores for the evaluations, else the path of what was written. ``model`` stands in for the one of the arguments."""
    args = parser().parse_args(argv)
    o = options(args)
    spark = spark or SparkSession.builder.getOrCreate()
    if args.stage.startswith("evaluate"):
        if args.stage == "evaluate":
            out = P.evaluate(A.read_items(spark, args.prior or A.split_path(args.data, args.eval_split)), o)
        else:
            out = P.evaluate_boundary(A.read_items(spark, A.split_path(args.data, args.eval_split)), P.read_spans(spark, args.prior), o)
        out.show()
        return out
    model = model or chat(args, spark)
    path = args.prior
    with backends.local_server(shlex.split(args.model_command), args.model_url) if args.model_command else nullcontext():
        for stage in STAGES if args.stage == "chain" else (args.stage,):
            path = run_stage(args, o, spark, stage, path, model)
            if args.stage == "chain":
                P.stop_at_errors(A.read_items(spark, path), stage)
    return path


if __name__ == "__main__":
    main()
