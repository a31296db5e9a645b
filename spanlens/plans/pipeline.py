"""The three ways through: demonstrations to predictions, reflection on predictions, and scores.

Tables are lazily planned; the caller writes each stage's result (``write_items`` or a table) and passes it on, so a
stage can be run again for missing rows alone. Items have the schema of ``sources.annotated.ITEM``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlens.config import Options
from spanlens.functions import align, parsing
from spanlens.functions.models import answered
from spanlens.operators import metrics, prompts, reflection, retrieval, roles

PARSERS: dict[str, Callable[[Column], Column]] = {"icl_json": parsing.parse_json, "icl_tagging": parsing.parse_tagged, "icl_code": parsing.parse_code}
RETRIEVALS = ("dense", "blended", "random")
NO_SPANS = f"cast(array() as {align.SPANS})"


def sentences_of(items: DataFrame) -> DataFrame:
    return items.select(F.col("id").cast("long").alias("id"), F.col("id").cast("long").alias("ord"), "tokens", "sentence")


def entities_of(items: DataFrame, column: str = "ent_list") -> DataFrame:
    """(id, ent_ord, s, e, name, type) of a list of entities; a null list has none."""
    rows = items.select(F.col("id").cast("long").alias("id"), F.posexplode(column).alias("ent_ord", "x"))
    return rows.select("id", "ent_ord", F.col("x.token_idx")[0].alias("s"), F.col("x.token_idx")[1].alias("e"), "x.name", "x.type")


def as_entities(spans: Column) -> Column:
    return F.transform(spans, lambda x: F.struct(x["name"].alias("name"), x["type"].alias("type"), F.array(x["s"], x["e"]).alias("token_idx")))


class Training:
    """What the training side gives: role statistics, sentences with their entities and counts of surface forms, each planned once."""

    def __init__(self, items: DataFrame, o: Options) -> None:
        self.sents, self.ents = sentences_of(items), entities_of(items)
        self.roles = roles.role_tokens(self.sents, self.ents, o.context_len)
        self.stats = roles.token_stats(self.roles)
        self.labels = roles.nested(self.sents, self.ents)
        self.labelled = roles.labelled_spans(self.sents, self.ents)
        self.counts = roles.span_counts(self.labelled, roles.unlabelled_spans(self.sents, self.labelled, roles.token_sources(self.roles)))


def retrieve(train: Training, asked: DataFrame, o: Options, train_vectors: DataFrame | None = None, asked_vectors: DataFrame | None = None) -> DataFrame:
    """(qid, rank, did, score) by the method of the options: dense (vectors), blended (vectors and tokens) or random.

    Vectors have id and emb; a method that needs them raises without.
    """
    if o.retrieval not in RETRIEVALS:
        raise ValueError(f"unknown retrieval {o.retrieval}; known: {', '.join(RETRIEVALS)}")
    if o.retrieval == "random":
        return retrieval.random_demos(train.sents, asked, o.demo_num, o.sample_seed)
    if train_vectors is None or asked_vectors is None:
        raise ValueError(f"{o.retrieval} retrieval needs vectors of both sides")
    if o.retrieval == "dense":
        return retrieval.knn_dense(train_vectors, asked_vectors, o.demo_num)
    return retrieval.knn_blended(train.sents, asked, train.stats, train_vectors, asked_vectors, o)


def unchanged(items: DataFrame) -> DataFrame:
    return items


def run_icl(items: DataFrame, train: Training, retrieved: DataFrame, model: Callable | DataFrame, o: Options, before: Callable = unchanged, after: Callable = unchanged, **calls) -> DataFrame:
    """Items with prompt, response and aligned predictions; rows whose call failed have an error and no entities.

    ``before`` and ``after`` are hooks on the items that go in and on the result.
    """
    items = items.transform(before)
    asked = sentences_of(items)
    demos = train.sents.join(train.ents.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("s", "e", "name", "type"))).alias("ents")), "id", "left")
    prompt = prompts.icl_prompts(asked, demos, retrieved, o.template, o.types, o.guide)
    answers = answered(prompt.select(F.col("id").alias("key"), F.col("icl_prompt").alias("text")), model, **calls)
    out = items.drop("icl_example_ids", "icl_prompt", "llm_response", "ent_list_pred", "error").withColumn("key", F.col("id").cast("long"))
    out = out.join(prompt.withColumnRenamed("id", "key"), "key", "left").join(answers.withColumnRenamed("out", "llm_response"), "key", "left")
    named = PARSERS[o.template](F.coalesce("llm_response", F.lit("")))
    return out.withColumn("ent_list_pred", as_entities(align.align_udf("tokens", named, "sentence"))).drop("key").transform(after)


def _spans(df: DataFrame, name: str, fields: tuple[str, ...]) -> DataFrame:
    return df.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))


def run_token_reflection(items: DataFrame, train: Training, kind: str, model: Callable | DataFrame, o: Options, **calls) -> DataFrame:
    """Second look at missed (``fn``) or ``unseen`` tokens: items with ent_list_pred and ent_list_pred_prior.

    Sentences without a candidate keep their predictions; the others get a prompt with evidence, and of the answer those
    entities that hold a candidate token.
    """
    sents, pred = sentences_of(items), entities_of(items, "ent_list_pred")
    rows = reflection.annotated_tokens(sents, pred, train.stats)
    if kind == "fn":
        spans = reflection.fn_spans(reflection.fn_span_candidates(rows, sents, train.labelled, train.counts, o), pred)
        tokens, neighbours = reflection.open_fn_tokens(reflection.fn_tokens(rows, o), spans), None
    else:
        spans = pred.select("id", F.expr(NO_SPANS).alias("spans")).limit(0)
        tokens = reflection.unseen_tokens(rows, o)
        if o.process_abbrev == "unseen":
            tokens = tokens.union(reflection.abbreviations(rows, o))
        neighbours = evidence_neighbours(rows, o)
    keyed = tokens.select(F.col("id").cast("string").alias("key"), "id", "pos", "token", F.lit("").alias("status"))
    shown = prompts.evidence(kind, keyed, train.stats, train.labels, sents, o.span_demo_num, o.context_len, neighbours)
    shown = shown.select(F.col("key").cast("long").alias("id"), "evidence")
    listed = sents.join(_spans(pred, "ents", ("s", "e", "name", "type")), "id", "left").join(_spans(tokens, "candidates", ("pos", "token")), "id", "left").join(spans, "id", "left")
    none = F.expr("cast(array() as array<struct<s:int,e:int,name:string,type:string>>)")
    listed = listed.withColumn("ents", F.coalesce("ents", none)).withColumn("spans", F.coalesce("spans", F.expr(NO_SPANS)))
    asked = listed.join(shown, "id")
    text = prompts.filled(f"reflect_{kind}", o.types, F.col("sentence"), F.col("evidence"), F.to_json("ents"), o.guide)
    answers = answered(asked.select(F.col("id").alias("key"), text.alias("text")), model, **calls)
    named = align.respelled_udf(parsing.parse_reflection(F.coalesce("out", F.lit(""))), F.col("sentence"))
    merged = asked.join(answers, asked.id == answers.key).select("id", F.col("out").alias("llm_response"), "error", align.merge_tokens_udf("tokens", "ents", named, "candidates", "spans").alias("merged"))
    return _with_merged(items, merged)


def evidence_neighbours(rows: DataFrame, o: Options) -> DataFrame:
    """(id, pos, neighbour, role): near each position the tokens that are often entity, else often context."""
    from spanlens.functions.text import is_stop, starts_punctuation

    role = F.when(F.col("r_ent") >= o.entity_bound_unseen, "entity").when(F.col("r_ctx") >= o.context_bound_unseen, "context")
    sign = rows.where(F.col("n_tot").isNotNull() & ~is_stop(F.col("token")) & ~starts_punctuation(F.col("token"))).withColumn("role", role).where("role is not null")
    spots = F.explode(F.sequence(F.col("pos") - o.context_len, F.col("pos") + o.context_len))
    return sign.select("id", spots.alias("pos"), F.col("token").alias("neighbour"), "role").distinct()


def _with_merged(items: DataFrame, merged: DataFrame) -> DataFrame:
    """Items with the lists of merged(id, merged) as predictions, what they were before, and its other columns."""
    new = [c for c in merged.columns if c not in ("id", "merged")]
    out = items.drop(*new, "ent_list_pred_prior").withColumn("key", F.col("id").cast("long")).join(merged.withColumnRenamed("id", "key"), "key", "left")
    out = out.withColumn("ent_list_pred_prior", F.col("ent_list_pred"))
    fresh = F.when(F.col("merged").isNull(), F.col("ent_list_pred")).otherwise(as_entities(F.col("merged")))
    return out.withColumn("ent_list_pred", fresh).drop("key", "merged")


def run_boundary_reflection(items: DataFrame, train: Training, model: Callable | DataFrame, o: Options, **calls) -> DataFrame:
    """(span_id, id, n, ents): one row per predicted entity, after a second look at those with doubtful boundaries."""
    sents, pred = sentences_of(items), entities_of(items, "ent_list_pred").drop("ent_ord")
    rows = reflection.annotated_tokens(sents, pred, train.stats)
    marks = reflection.boundary_tokens(pred, rows, train.counts, reflection.fp_tokens(rows, o), o)
    fan = reflection.boundary_fanout(sents, pred, marks).where("n is not null")
    key = F.concat_ws("_", "id", "n").alias("key")
    spot = ["id", "s", "e", "name", "type"]
    status = F.when(F.array_contains(F.split("name", " "), F.col("token")), "part of the entity").otherwise("part of the context")
    tokens = marks.join(fan.select(*spot, "n"), spot).select(key, "id", "pos", "token", status.alias("status"))
    shown = prompts.evidence("boundary", tokens, train.stats, train.labels, sents, o.span_demo_num, o.context_len)
    all_ = _spans(pred, "ents", ("s", "e", "name", "type"))
    listed = fan.withColumn("key", F.concat_ws("_", "id", "n")).join(shown, "key", "left").join(sents, "id").join(all_, "id")
    listed = listed.join(tokens.groupBy("key").agg(F.collect_set("token").alias("marks")), "key", "left")
    one = F.struct("name", "type", "s", "e")
    text = prompts.filled("reflect_boundary", o.types, F.col("sentence"), F.col("evidence"), F.to_json(one), o.guide)
    answers = answered(listed.where("evidence is not null").select("key", text.alias("text")), model, **calls)
    met = listed.join(answers, "key", "left")
    named = align.respelled_udf(parsing.parse_boundary(F.coalesce("out", F.lit(""))), F.col("sentence"))
    others = F.filter("ents", lambda x: (x["s"] != F.col("s")) | (x["e"] != F.col("e")) | (x["name"] != F.col("name")))
    changed = align.merge_boundary_udf("tokens", F.array(one), others, named, F.coalesce("marks", F.array().cast("array<string>")))
    asked = F.col("evidence").isNotNull() & F.col("error").isNull()
    ents = F.when(asked, changed).otherwise(F.array(one).cast(align.SPANS))
    return met.select(F.col("key").alias("span_id"), "id", "n", ents.alias("ents"), "out", "error")


SPAN_ROWS = f"span_id string, id long, n int, ents {align.SPANS}, out string, error string"


def read_spans(spark: SparkSession, path: str) -> DataFrame:
    """Rows of ``run_boundary_reflection`` that were written as JSON lines."""
    return spark.read.schema(SPAN_ROWS).json(path)


def boundary_items(items: DataFrame, spans: DataFrame) -> DataFrame:
    """Items with the entities of their spans, in order, as predictions; those without spans keep theirs."""
    rows = F.array_sort(F.collect_list(F.struct("n", "ents", "out")))
    merged = spans.groupBy("id").agg(rows.alias("rows"), F.max("error").alias("error"))
    return _with_merged(items, merged.select("id", F.array_join("rows.out", "\n").alias("llm_response"), "error", F.flatten("rows.ents").alias("merged")))


def stop_at_errors(items: DataFrame, stage: str) -> None:
    """Raise where the stage has no rows or rows whose model call failed."""
    found = items.agg(F.count("*").alias("n"), F.count("error").alias("failed"), F.max("error").alias("error")).first()
    if not found["n"] or found["failed"]:
        raise RuntimeError(f"stage {stage}: {found['failed']} of {found['n']} rows failed, such as: {found['error']}")


def _once(items: DataFrame) -> None:
    again = items.groupBy("id").count().where("count > 1").first()
    if again is not None:
        raise ValueError(f"sentence {again['id']} has {again['count']} rows of labels; it needs exactly one")


def evaluate(items: DataFrame, o: Options) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 of items' predictions against their labels; an id that repeats raises."""
    _once(items)
    keys = metrics.confusion(entities_of(items), entities_of(items, "ent_list_pred"), sentences_of(items), o.types)
    return metrics.scores(keys)


def evaluate_boundary(items: DataFrame, spans: DataFrame, o: Options) -> DataFrame:
    """The same scores of span rows, against the labels of the sentences that have any."""
    _once(items)
    return metrics.scores(metrics.boundary_keys(entities_of(items), spans.select("span_id", "ents"), sentences_of(items), o.types))


def filter_single_tokens(items: DataFrame, train: Training) -> DataFrame:
    """Items without predictions of one token that never is an entity by itself; the list before becomes the prior."""
    kept = reflection.without_single_token_fp(entities_of(items, "ent_list_pred"), train.stats, train.counts)
    lists = _spans(kept, "merged", ("s", "e", "name", "type"))
    all_ = sentences_of(items).select("id").join(lists, "id", "left")
    none = F.expr("cast(array() as array<struct<s:int,e:int,name:string,type:string>>)")
    return _with_merged(items, all_.select("id", F.coalesce("merged", none).alias("merged")))
