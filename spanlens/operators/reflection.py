"""Tokens and entity boundaries worth a second look, from role statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlens.config import RARE, Options
from spanlens.functions.align import greedy_spans_udf
from spanlens.functions.text import all_digits, all_upper, is_article, is_punctuation, is_stop, starts_punctuation, starts_upper
from spanlens.operators.lookup import edge_spots, free_names, named_starts, names_of, small_batches
from spanlens.operators.roles import entity_context_ratio, span_counts, with_rates
from spanlens.sources.annotated import token_rows

STATS = ["n_ent", "n_ctx", "n_oth", "n_tot", "r_ent", "r_ctx", "r_oth"]


def annotated_tokens(sents: DataFrame, pred: DataFrame, stats: DataFrame) -> DataFrame:
    """Every token with its statistics (null: unseen) and whether a predicted entity covers it."""
    covered = pred.select("id", F.explode(F.sequence(F.col("s").cast("int"), F.col("e").cast("int"))).alias("pos")).distinct().withColumn("inside", F.lit(True))
    rows = token_rows(sents).join(covered, ["id", "pos"], "left").join(stats.select("token", *STATS), "token", "left")
    return rows.withColumn("inside", F.coalesce("inside", F.lit(False)))


def _looked_at(o: Options) -> Column:
    return starts_upper(F.col("token")) if o.process_abbrev == "only" else F.lit(True)


def _missed(o: Options) -> Column:
    return (F.col("r_ent") > o.entity_bound_fn) & (F.col("n_tot") > RARE) & ~F.col("inside")


def fn_tokens(rows: DataFrame, o: Options) -> DataFrame:
    """(id, pos, token): entity tokens by their statistics that no prediction covers."""
    return rows.where(_looked_at(o) & F.coalesce(_missed(o), F.lit(False))).select("id", "pos", "token")


def fp_tokens(rows: DataFrame, o: Options) -> DataFrame:
    """(id, pos, token): predicted tokens that are common and never part of an entity."""
    return rows.where(_looked_at(o) & (F.col("r_ent") == 0) & (F.col("n_tot") > RARE) & F.col("inside")).select("id", "pos", "token")


def fn_token_rows(rows: DataFrame, stats: DataFrame, o: Options) -> DataFrame:
    """(id, candidates): the ``fn_tokens`` of each sentence in order, as a list of (pos, token).

    Rows have the predictions (id, sentence, ents and their ``roles.covered``). Tokens are found in the sentences by a
    bitmap; an exact join follows.
    """
    inside = F.lit(False).alias("inside")
    strong = stats.select("*", inside).where(_looked_at(o) & _missed(o)).select(F.col("token").alias("name"))
    met = named_starts(rows, names_of(strong), whole=True).join(strong, "name").select("id", F.transform("spots", lambda p: F.struct(p.alias("pos"), F.col("name").alias("token"))).alias("x"))
    return met.groupBy("id").agg(F.array_sort(F.flatten(F.collect_list("x"))).alias("candidates"))


def abbreviations(rows: DataFrame, o: Options) -> DataFrame:
    """(id, pos, token): capitals that are rare or often entities, not covered and not missed entity tokens already."""
    likely = (F.col("n_tot") <= RARE) | (F.col("r_ent") > o.entity_bound_unseen)
    return rows.where(F.col("n_tot").isNotNull() & ~F.coalesce(_missed(o), F.lit(False)) & all_upper(F.col("token")) & likely & ~F.col("inside")).select("id", "pos", "token")


def unseen_tokens(rows: DataFrame, o: Options) -> DataFrame:
    """(id, pos, token): tokens without statistics, not covered and not numbers, near one that is often entity or context.

    Near is within ``context_len`` tokens; stop words and tokens that start with punctuation are no evidence. Evidence
    positions are spread to their neighbours, so the join is an equality on (id, pos).
    """
    strong = (F.col("r_ent") >= o.entity_bound_unseen) | (F.col("r_ctx") >= o.context_bound_unseen)
    signs = rows.where(F.col("n_tot").isNotNull() & ~is_stop(F.col("token")) & ~starts_punctuation(F.col("token")) & strong)
    near = signs.select("id", F.explode(F.sequence(F.col("pos") - o.context_len, F.col("pos") + o.context_len)).alias("pos")).distinct()
    open_ = rows.where(_looked_at(o) & F.col("n_tot").isNull() & ~F.col("inside") & ~all_digits(F.col("token")))
    return open_.join(near, ["id", "pos"], "left_semi").select("id", "pos", "token")


def _kinds(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("name", "type").agg(F.count("*").alias("n"))


def _good_forms(kinds: DataFrame, counts: DataFrame) -> DataFrame:
    """(name, type, token, n) of forms labelled more than once and over twice as often as not; token is the first of n.

    kinds(name, type, n) says how often a form is labelled so.
    """
    kind = kinds.groupBy("name").agg(F.max("n").alias("top"), F.collect_list(F.struct("n", "type")).alias("all"))
    kind = kind.select("name", F.array_min(F.transform(F.filter("all", lambda x: x["n"] == F.col("top")), lambda x: x["type"])).alias("type"))
    good = counts.where("ent_count > 1 and ent_count > 2 * non_ent_count").join(kind, "name")
    return good.select("name", "type", F.split("name", " ")[0].alias("token"), F.size(F.split("name", " ")).alias("n"))


def fn_span_candidates(rows: DataFrame, sents: DataFrame, labelled: DataFrame, counts: DataFrame, o: Options) -> DataFrame:
    """(id, name, type, s, e, aligned): labelled forms that begin with a token and occur in its sentence.

    Forms are labelled more than once and over twice as often as not. The token is sometimes an entity, no stop word or
    punctuation, and not covered. type is the form's most frequent (then first) type; aligned says whether the form
    stands at the token itself.
    """
    good = _good_forms(_kinds(labelled), counts)
    starts = rows.where(_looked_at(o) & (F.col("n_ent") > 1) & ~F.col("inside") & ~is_punctuation(F.col("token")) & ~is_stop(F.col("token"))).select("id", "pos", "token")
    met = starts.join(good, "token").join(sents.select("id", "tokens", "sentence"), "id").where(F.contains(F.col("sentence"), F.col("name")))
    aligned = F.col("name") == F.array_join(F.slice("tokens", F.col("pos") + 1, F.col("n")), " ")
    return met.select("id", "name", "type", F.col("pos").alias("s"), (F.col("pos") + F.col("n") - 1).alias("e"), aligned.alias("aligned"))


def fn_span_rows(rows: DataFrame, labels: DataFrame, labelled: DataFrame, o: Options) -> DataFrame:
    """``fn_span_candidates`` of rows with the predictions (id, sentence, ents).

    labels are such rows with the entities of ``labelled``. The forms that a sentence holds are found in the sentence
    itself, by a bitmap of the forms that no exact join loses, so no frequent first token meets all forms that begin with
    it. The sentence is its tokens with one space between. Only forms labelled more than once are counted where they are
    no entities; their first tokens are in more than one entity, so token statistics are not asked. How often forms are
    labelled, and the few forms that are wanted, are cached, so no text is read twice for them.
    """
    token = F.split("name", " ")[0]
    with small_batches(rows.sparkSession):
        kinds = _kinds(labelled).persist()
        often = kinds.groupBy("name").agg(F.sum("n").alias("ent_count")).where("ent_count > 1").withColumn("token", token)
        often = often.where(_looked_at(o) & ~is_punctuation(F.col("token")) & ~is_stop(F.col("token"))).select("name", "ent_count")
        counts = span_counts(often, free_names(labels, names_of(often, 8)))
        good = _good_forms(kinds, counts).select("name", "type", "n").persist()
        names = names_of(good, 8)
    met = named_starts(rows, names).join(good, "name")
    each = met.select("id", "name", "type", "n", F.explode(F.arrays_zip("spots", "aligned")).alias("x"))
    return each.select("id", "name", "type", F.col("x.spots").alias("s"), (F.col("x.spots") + F.col("n") - 1).alias("e"), F.col("x.aligned").alias("aligned"))


def fn_spans(candidates: DataFrame, pred: DataFrame) -> DataFrame:
    """(id, spans): the missed forms of each sentence, longest first per start, free of predictions and of each other."""
    one = F.array_sort(F.collect_list(F.struct("s", "e", "name", "type", "aligned")))
    busy = pred.groupBy("id").agg(F.flatten(F.collect_list(F.sequence(F.col("s").cast("int"), F.col("e").cast("int")))).alias("busy"))
    rows = candidates.groupBy("id").agg(one.alias("candidates")).join(busy, "id", "left")
    rows = rows.withColumn("busy", F.coalesce("busy", F.array().cast("array<int>")))
    return rows.select("id", greedy_spans_udf("candidates", "busy").alias("spans"))


def open_fn_tokens(missed: DataFrame, spans: DataFrame) -> DataFrame:
    """Missed tokens that no missed span covers."""
    covered = spans.select("id", F.explode("spans").alias("x")).select("id", F.explode(F.sequence("x.s", "x.e")).alias("pos")).distinct()
    return missed.join(covered, ["id", "pos"], "left_anti")


def boundary_tokens(pred: DataFrame, rows: DataFrame, counts: DataFrame, fp: DataFrame, o: Options, bound: float = 0.5) -> DataFrame:
    """(id, s, e, pos, token) for each predicted entity: tokens at its edges and its doubtful ones, as far as in doubt.

    Entities whose form is surely an entity have none. Tokens of other predictions and punctuation are left out; one
    outside counts if it is rather entity than context, one inside if it is rather not; unseen ones and articles as the
    options say.
    """
    doubt = pred.join(counts, "name", "left").where(f"coalesce(not ({_sure()}), true)")
    one = doubt.select("id", "s", "e", "name", "type").distinct()
    edges = F.array_distinct(F.array(F.col("s") - 1, F.col("s"), F.col("e"), F.col("e") + 1))
    spots = one.select("id", "s", "e", "name", "type", F.explode(edges).alias("pos"), F.lit(False).alias("fp"))
    inner = fp.select("id", "pos").join(one, "id").where("pos between s and e").select("id", "s", "e", "name", "type", "pos", F.lit(True).alias("fp"))
    cover = pred.select("id", F.col("s").alias("os"), F.col("e").alias("oe"), F.col("name").alias("oname"), F.col("type").alias("otype"), F.explode(F.sequence(F.col("s").cast("int"), F.col("e").cast("int"))).alias("pos")).distinct()
    other = spots.join(cover, ["id", "pos"]).where("os <> s or oe <> e or oname <> name or otype <> type").select("id", "s", "e", "name", "type", "pos").distinct()
    spots = spots.join(other, ["id", "s", "e", "name", "type", "pos"], "left_anti").unionByName(inner)
    spots = spots.groupBy("id", "s", "e", "name", "type", "pos").agg(F.max("fp").alias("fp"))
    met = spots.join(rows.select("id", "pos", "token", *STATS), ["id", "pos"])
    return _in_doubt(met, o, bound)


def _sure() -> str:
    return "(ent_count > 0 and non_ent_count = 0) or ent_count > 2 * non_ent_count"


def _taken(outside: Column, o: Options, bound: float) -> Column:
    share = entity_context_ratio()
    seen = F.when(outside, (share > bound) | (F.col("r_ent") > bound)).otherwise(share < bound)
    take = F.when(F.col("n_tot").isNotNull(), seen).otherwise(F.lit(o.include_unseen_boundary))
    if o.ignore_article:
        take = F.when(is_article(F.col("token")), outside).otherwise(take)
    return take & ~is_punctuation(F.col("token"))


def _never(o: Options) -> Column:
    return _looked_at(o) & (F.col("r_ent") == 0) & (F.col("n_tot") > RARE)


def _in_doubt(spots: DataFrame, o: Options, bound: float) -> DataFrame:
    met = spots.where(_taken((F.col("pos") < F.col("s")) | (F.col("pos") > F.col("e")), o, bound))
    if o.ignore_rare:
        common = F.max(F.coalesce(F.col("n_tot"), F.lit(0)) >= RARE).over(Window.partitionBy("id", "s", "e", "name", "type"))
        met = met.withColumn("common", common).where("common")
    return met.select("id", "s", "e", "name", "type", "pos", "token")


def boundary_rows(rows: DataFrame, stats: DataFrame, labels: DataFrame, labelled: DataFrame, o: Options, bound: float = 0.5) -> DataFrame:
    """``boundary_tokens`` of rows with the predictions (id, sentence, ents, no two alike).

    labels are such rows with the entities of ``labelled``. Edges and other predictions are looked at inside the row, and
    so are the tokens: bitmaps of those that count outside and inside leave few spots (all, if tokens without statistics
    may count), which then meet the statistics themselves. Only forms that still have a spot are counted. The statistics
    of tokens that may count, the spots and the forms in no doubt are cached, so no text is read twice for them.
    """
    outside, inside = (_taken(F.lit(x), o, bound) for x in (True, False))
    with small_batches(rows.sparkSession):
        bitmaps, known = None, stats
        if not (o.include_unseen_boundary or o.ignore_article):
            some = stats.where(outside | inside).select("token", "n_ent", "n_ctx", "n_oth").persist()
            known = with_rates(some)
            bitmaps = [names_of(known.where(x), 8, "token", False) for x in (outside, inside, inside & _never(o))]
        met = edge_spots(rows, bitmaps).join(known.select("token", *STATS), "token", "left")
        spots = _in_doubt(met.where(F.col("edge") | F.coalesce(_never(o) & F.col("pos").between(F.col("s"), F.col("e")), F.lit(False))), o, bound).persist()
        mine = labelled.groupBy("name").agg(F.count("*").alias("ent_count")).join(spots.select("name").distinct(), "name", "left_semi").persist()
        sure = span_counts(mine, free_names(labels, names_of(mine, 8))).where(_sure()).select("name").persist()
    return spots.join(sure, "name", "left_anti").select("id", "s", "e", "name", "type", "pos", "token")


def routed(ids: DataFrame, *evidence: DataFrame) -> DataFrame:
    """(id, needs_reflection): whether any evidence table has a row of the sentence."""
    some = evidence[0].select("id")
    for more in evidence[1:]:
        some = some.union(more.select("id"))
    marked = some.distinct().withColumn("needs_reflection", F.lit(True))
    return ids.select("id").join(marked, "id", "left").select("id", F.coalesce("needs_reflection", F.lit(False)).alias("needs_reflection"))


def boundary_fanout(sents: DataFrame, pred: DataFrame, boundary: DataFrame) -> DataFrame:
    """One row per predicted entity, sentences without one too: (id, n, s, e, name, type, prior, n_boundary).

    n is the entity's place in its sentence (null without); prior is how many entities its prior list holds: all with a
    boundary token, itself without.
    """
    n = F.row_number().over(Window.partitionBy("id").orderBy("s", "e", "name", "type"))
    size = F.count("*").over(Window.partitionBy("id"))
    rows = pred.select("id", "s", "e", "name", "type", (n - 1).alias("n"), size.alias("size"))
    marks = boundary.groupBy("id", "s", "e", "name", "type").agg(F.count("*").alias("n_boundary"))
    out = sents.select("id").join(rows, "id", "left").join(marks, ["id", "s", "e", "name", "type"], "left")
    found = F.coalesce("n_boundary", F.lit(0))
    prior = F.when(F.col("n").isNull(), 0).when(found > 0, F.col("size")).otherwise(1)
    return out.select("id", "n", "s", "e", "name", "type", prior.cast("long").alias("prior"), found.cast("long").alias("n_boundary"))


def without_single_token_fp(pred: DataFrame, stats: DataFrame, counts: DataFrame) -> DataFrame:
    """Predictions less those of one token that is seen, common as an entity token, yet never an entity by itself."""
    known = pred.join(stats.select(F.col("token").alias("name"), "n_ent", "n_tot"), "name", "left").join(counts.select("name", "ent_count"), "name", "left")
    doubtful = (F.size(F.split("name", " ")) == 1) & (F.col("n_tot") > 0) & (F.coalesce("ent_count", F.lit(0)) == 0) & (F.col("n_ent") > RARE)
    return known.where(~F.coalesce(doubtful, F.lit(False))).select(*pred.columns)


def top_examples(wanted: DataFrame, occurrences: DataFrame, k: int) -> DataFrame:
    """The k occurrences of each wanted token and role whose context shares most distinct tokens with ``span``.

    wanted(key, token, role, span); returns key, token, role, rank, id, ent_ord, pos, shared. Ties go to the earlier occurrence.
    All pairs are made; ``examples.best_examples`` goes without.
    """
    met = wanted.join(occurrences, ["token", "role"])
    shared = F.size(F.array_intersect(F.split("cxt", " "), F.split("span", " ")))
    rank = F.row_number().over(Window.partitionBy("key", "token", "role").orderBy(F.desc("shared"), "id", "ent_ord", "pos"))
    out = met.withColumn("shared", shared).withColumn("rank", rank).where(F.col("rank") <= k)
    return out.select("key", "token", "role", "rank", "id", "ent_ord", "pos", "shared", "ent_type", "ent_span", "cxt")


def majority_types(labelled: DataFrame) -> DataFrame:
    """(name, type, n): the most frequent type of each form, the first by name of equals."""
    n = labelled.groupBy("name", "type").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("n"), "type"))
    return n.withColumn("rank", rank).where("rank = 1").select("name", "type", "n")
