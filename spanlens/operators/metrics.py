"""Entity-level scores over multisets of (id, name, type, s, e)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlens.functions.text import ratio

KEY = ["id", "name", "type", "s", "e"]


def confusion(gold: DataFrame, pred: DataFrame, sents: DataFrame, types) -> DataFrame:
    """Each key with its counts g and p. Both sides keep only ``types``; predictions only names that the sentence has;
    gold only sentences of ``sents``, those with a prediction row (even an empty one)."""
    inside = pred.join(sents.select("id", "sentence"), "id").where(F.contains(F.col("sentence"), F.col("name")))
    p = inside.where(F.col("type").isin(*types)).groupBy(KEY).agg(F.count("*").alias("p"))
    g = gold.where(F.col("type").isin(*types)).join(sents.select("id"), "id", "left_semi").groupBy(KEY).agg(F.count("*").alias("g"))
    return g.join(p, KEY, "full").select(*KEY, F.coalesce("g", F.lit(0)).alias("g"), F.coalesce("p", F.lit(0)).alias("p"))


def totals(keys: DataFrame) -> DataFrame:
    g, p = F.col("g"), F.col("p")
    zero = F.lit(0).cast("long")
    sums = (F.sum(F.least(g, p)).alias("tp"), F.sum(F.greatest(p - g, zero)).alias("fp"), F.sum(F.greatest(g - p, zero)).alias("fn"))
    out = keys.agg(*sums)
    return out.select(*[F.coalesce(c, zero).alias(c) for c in ("tp", "fp", "fn")])


def scores(keys: DataFrame) -> DataFrame:
    """tp, fp, fn and micro precision, recall and F1 (0 where undefined)."""
    t = totals(keys).withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return t.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def error_rows(keys: DataFrame) -> DataFrame:
    """One row per key and kind (tp, fp, fn) with its multiplicity."""
    g, p = F.col("g"), F.col("p")
    kinds = F.array(F.struct(F.lit("tp").alias("kind"), F.least(g, p).alias("n")), F.struct(F.lit("fp").alias("kind"), (p - g).alias("n")), F.struct(F.lit("fn").alias("kind"), (g - p).alias("n")))
    return keys.select(*KEY, F.explode(kinds).alias("k")).where("k.n > 0").select(*KEY, "k.kind", "k.n")


def spans_to_sentences(rows: DataFrame) -> DataFrame:
    """rows(span_id "<id>_<n>", ents) regrouped by sentence: id and all entities in order of span."""
    n = F.coalesce(F.try_element_at(F.split("span_id", "_"), F.lit(2)).cast("int"), F.lit(0))
    keyed = rows.select(F.split("span_id", "_")[0].cast("long").alias("id"), n.alias("n"), "ents")
    return keyed.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "ents"))).alias("all")).select("id", F.flatten("all.ents").alias("ents"))


def boundary_keys(gold: DataFrame, spans: DataFrame, sents: DataFrame, types) -> DataFrame:
    """Confusion of fan-out rows (span_id, ents of at most one): regrouped, and gold only of their sentences."""
    grouped = spans_to_sentences(spans.where(F.size("ents") <= 1))
    pred = grouped.select("id", F.explode("ents").alias("x")).select("id", "x.name", "x.type", "x.s", "x.e")
    return confusion(gold, pred, sents.join(grouped.select("id"), "id", "left_semi"), types)
