"""Roles of token occurrences (entity, context, other), their counts, and spans by surface form."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlens.functions.text import join_tokens, ratio, span, window


def nested(sents: DataFrame, ents: DataFrame) -> DataFrame:
    """Sentences with ``ents``, the list of their entities (in order of start), for entities from a table of their own."""
    one = F.struct("s", "e", "name", "type", "ent_ord")
    lists = ents.groupBy("id").agg(F.array_sort(F.collect_list(one)).alias("ents"))
    return sents.join(lists, "id", "left").withColumn("ents", F.coalesce("ents", F.array().cast(lists.schema["ents"].dataType)))


def cover_lists(size: pa.Array, s: pa.Array, e: pa.Array, width: int = 2) -> pa.Array:
    """``cover`` of some rows, as of ``covered``, from how many tokens they have and where their entities begin and end."""
    n, many = size.to_numpy().astype(np.int64), np.diff(s.offsets.to_numpy())
    base, row = np.append(0, np.cumsum(n + 1)), np.repeat(np.arange(len(n)), many)
    low, high = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in (s, e))

    def count(*ranges) -> np.ndarray:
        steps = np.zeros(base[-1] + 1, dtype=np.int32)
        for a, b in ranges:
            a, b = (base[row] + np.clip(x, 0, n[row]) for x in (a, b))
            on = a < b
            np.add.at(steps, a[on], 1)
            np.add.at(steps, b[on], -1)
        return np.cumsum(steps, dtype=np.int32)

    inside, near = count((low, high + 1)), count((low - width, low), (high + 1, high + 1 + width))
    keep = np.ones(base[-1] + 1, dtype=bool)
    keep[np.append(base[1:] - 1, base[-1])] = False
    values = np.where(inside > 0, inside, -near)[keep]
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(values))


def covered(rows: DataFrame, width: int = 2, ents: str = "ents", cover: str = "cover") -> DataFrame:
    """Rows with ``cover``, a number for each token: how many entities cover it, or (below 0) have it in their context.

    Counts keep double coverage: a token near two entities counts twice. Entity tokens are never context.
    """

    def run(size: pa.Array, s: pa.Array, e: pa.Array) -> pa.Array:
        return cover_lists(size, s, e, width)

    ends = F.transform(ents, lambda x: x["s"].cast("int")), F.transform(ents, lambda x: x["e"].cast("int"))
    return rows.withColumn(cover, F.arrow_udf(run, "array<int>")(F.size("tokens"), *ends))


def role_rows(rows: DataFrame) -> DataFrame:
    """(id, pos, token, n_ent, n_ctx) of rows of ``covered``: how many entities cover a token, and how many have it in their context."""
    each = rows.select("id", F.posexplode(F.arrays_zip("tokens", "cover")).alias("pos", "x")).select("id", "pos", F.col("x.tokens").alias("token"), F.col("x.cover").alias("c"))
    return each.select("id", "pos", "token", F.greatest("c", F.lit(0)).cast("long").alias("n_ent"), F.greatest(-F.col("c"), F.lit(0)).cast("long").alias("n_ctx"))


def role_tokens(sents: DataFrame, ents: DataFrame, width: int = 2) -> DataFrame:
    """``role_rows`` of sentences and a table of entities."""
    return role_rows(covered(nested(sents, ents), width))


def _other() -> Column:
    return ((F.col("n_ent") == 0) & (F.col("n_ctx") == 0)).cast("int")


def token_stats(roles: DataFrame) -> DataFrame:
    """Counts by role of each token, and their rates; n_tot counts (token, entity) pairs of context, not occurrences."""
    out = roles.groupBy("token").agg(F.sum("n_ent").alias("n_ent"), F.sum("n_ctx").alias("n_ctx"), F.sum(_other()).alias("n_oth"))
    return with_rates(out)


def with_rates(counts: DataFrame) -> DataFrame:
    """Counts by role of each token with their sum and their rates."""
    out = counts.withColumn("n_tot", F.col("n_ent") + F.col("n_ctx") + F.col("n_oth"))
    return out.select("*", *[(F.col(f"n_{r}") / F.col("n_tot")).alias(f"r_{r}") for r in ("ent", "ctx", "oth")])


def token_sources(roles: DataFrame) -> DataFrame:
    """Inverted index: (token, role, id, cnt)."""
    sums = roles.groupBy("token", "id").agg(F.sum("n_ent").alias("entity"), F.sum("n_ctx").alias("context"), F.sum(_other()).alias("other"))
    parts = F.array(*[F.struct(F.lit(r).alias("role"), F.col(r).cast("long").alias("cnt")) for r in ("entity", "context", "other")])
    return sums.select("token", "id", F.explode(parts).alias("p")).where("p.cnt > 0").select("token", "p.role", "id", "p.cnt")


def occurrence_rows(rows: DataFrame, width: int = 2) -> DataFrame:
    """(id, pos, token, role, ent_ord, ent_type, ent_span, cxt): one row per (token, entity) pair, or other token.

    Joined strings stand for the spans. Entities that don't match their tokens are skipped, so those tokens may be
    context or other here. Rows have tokens and ents; all comes from the row itself, so no token leaves its sentence
    with the whole sentence beside it.
    """
    return occurrences_of_own(own_rows(rows, width), width)


def own_rows(rows: DataFrame, width: int = 2) -> DataFrame:
    """(id, tokens, own, cover): the entities that match their tokens, and what they cover."""
    tokens = F.col("tokens")
    own = F.filter("ents", lambda x: x["name"] == join_tokens(span(tokens, x["s"].cast("int"), x["e"].cast("int"))))
    return covered(rows.select("id", "tokens", own.alias("own")), width, "own")


def occurrences_of_own(all_: DataFrame, width: int = 2) -> DataFrame:
    """``occurrence_rows`` of ``own_rows``."""
    tokens = F.col("tokens")
    columns = ["id", "pos", "token", "role", "ent_ord", "ent_type", "ent_span", "cxt"]
    s, e, cover = F.col("x.s").cast("int"), F.col("x.e").cast("int"), F.element_at("cover", F.col("pos") + 1)
    each = all_.select("id", "tokens", "cover", F.explode("own").alias("x"))
    each = each.select("id", "tokens", "cover", "x", join_tokens(window(tokens, s, e, width)).alias("cxt"), F.explode(F.sequence(F.greatest(s - width, F.lit(0)), F.least(e + width, F.size("tokens") - 1))).alias("pos"))
    inside = F.col("pos").between(s, e)
    both = each.where(inside | (cover < 0)).select("id", "pos", F.element_at("tokens", F.col("pos") + 1).alias("token"), F.when(inside, "entity").otherwise("context").alias("role"), F.col("x.ent_ord").alias("ent_ord"), F.col("x.type").alias("ent_type"), F.col("x.name").alias("ent_span"), "cxt")
    rest = all_.select("id", "tokens", F.posexplode(F.arrays_zip("tokens", "cover")).alias("pos", "x")).where("x.cover = 0")
    rest = rest.select("id", "pos", F.col("x.tokens").alias("token"), F.lit("other").alias("role"), F.lit(None).cast("int").alias("ent_ord"), F.lit(None).cast("string").alias("ent_type"), F.lit(None).cast("string").alias("ent_span"), join_tokens(window(tokens, F.col("pos"), F.col("pos"), width)).alias("cxt"))
    return both.select(*columns).unionByName(rest)


def occurrences(sents: DataFrame, ents: DataFrame, width: int = 2) -> DataFrame:
    """``occurrence_rows`` of sentences and a table of entities."""
    return occurrence_rows(nested(sents, ents), width)


def labelled_spans(sents: DataFrame, ents: DataFrame) -> DataFrame:
    """(name, id, s, e, type) by the joined tokens of the span, whatever the entity is called."""
    own = ents.join(sents.select("id", "tokens"), "id")
    return own.select(join_tokens(span(F.col("tokens"), F.col("s"), F.col("e"))).alias("name"), "id", "s", "e", "type")


def unlabelled_spans(sents: DataFrame, labelled: DataFrame, sources: DataFrame) -> DataFrame:
    """(name, id, s, e, copies): sentences in which a labelled surface form occurs and each token has another role too.

    The first occurrence as a string has to be aligned to tokens, and the first aligned one is returned. copies is 2 for
    a one-token form whose token is both context and other in the sentence. Candidates come by relational division over
    the inverted index.
    """
    names = labelled.select("name").distinct().withColumn("words", F.split("name", " "))
    parts = names.select("name", F.size("words").alias("n"), F.size(F.array_distinct("words")).alias("distinct"), F.explode(F.array_distinct("words")).alias("token"))
    free = sources.where("role <> 'entity'").groupBy("token", "id").agg(F.count("*").alias("roles"))
    found = parts.join(free, "token").groupBy("name", "id").agg(F.count("*").alias("hits"), F.max("distinct").alias("distinct"), F.max("n").alias("n"), F.max("roles").alias("roles"))
    found = found.where("hits = distinct").join(sents.select("id", "sentence", "tokens"), "id")
    at = F.instr(F.col("sentence"), F.col("name"))
    s = F.length(F.substring("sentence", F.lit(1), at - 1)) - F.length(F.replace(F.substring("sentence", F.lit(1), at - 1), F.lit(" "), F.lit("")))
    found = found.withColumn("at", at).where("at > 0").withColumn("s", s)
    found = found.where(F.col("name") == join_tokens(F.slice("tokens", F.col("s") + 1, F.col("n"))))
    copies = F.when(F.col("n") == 1, F.col("roles")).otherwise(1)
    return found.select("name", "id", F.col("s").cast("int").alias("s"), (F.col("s") + F.col("n") - 1).cast("int").alias("e"), copies.cast("long").alias("copies"))


def span_counts(labelled: DataFrame, unlabelled: DataFrame) -> DataFrame:
    """(name, ent_count, non_ent_count) of each labelled surface form; ``labelled`` may be those counts, one row a form."""
    mine = labelled if "ent_count" in labelled.columns else labelled.groupBy("name").agg(F.count("*").alias("ent_count"))
    rest = unlabelled.groupBy("name").agg(F.sum("copies").alias("n"))
    return mine.join(rest, "name", "left").select("name", "ent_count", F.coalesce("n", F.lit(0)).alias("non_ent_count"))


def entity_context_ratio() -> Column:
    return ratio(F.col("n_ent"), F.col("n_ent") + F.col("n_ctx"))
