"""Time-varying curriculum: mix sources to target weights and place documents along training.

Each source has a base weight and a piecewise-linear schedule of it over training time 0..1. The integral of the
schedule gives the source's share, water-filling under a cap of whole passes gives its target, and inverting the
cumulative demand turns a document's place in its source's token stream into a training position. DataFrame functions
only.

Prefix sums never order a whole source in one task: documents are ordered by a hash, its top bits name one of
``BUCKETS`` buckets a source, bucket sums are added up first, and rows are ordered only inside their bucket. Only the
table of sources (one row each) is ordered as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

BUCKET_BITS = 10
WEIGHTS = (3.0, 1.0, 2.0)
#: Multipliers of the base weight at equally spaced times; each integrates to 1. Sources take them in turn.
SCHEDULES = ((1.5, 1.0, 0.5), (0.5, 1.0, 1.5), (1.0, 1.0, 1.0))


def word_count(text: Column) -> Column:
    """Number of words [^\\x20\\x09-\\x0D]+; a null text has none."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, r"[\x20\x09-\x0D]+"))).cast("long")


def _cycle(values, at: Column) -> Column:
    return F.element_at(F.array(*values), (at % len(values) + 1).cast("int"))


def _pieces(schedule) -> Column:
    """Linear pieces of a schedule: start, length, value and slope, and the share of the integral before and after."""
    step = 1 / (len(schedule) - 1)
    areas = [step * (a + b) / 2 for a, b in zip(schedule, schedule[1:], strict=False)]
    whole, upto, out = sum(areas), 0.0, []
    for i, area in enumerate(areas):
        out.append(F.struct(F.lit(i * step).alias("start"), F.lit(step).alias("length"), F.lit(float(schedule[i])).alias("value"), F.lit((schedule[i + 1] - schedule[i]) / step).alias("slope"), F.lit(upto / whole).alias("lo"), F.lit((upto + area) / whole if i < len(areas) - 1 else 1.0).alias("hi"), F.lit(whole).alias("whole")))
        upto += area
    return F.array(*out)


def _when(pieces: Column, share: Column) -> Column:
    """Training time at which the cumulative demand reaches ``share`` of its whole."""
    at = F.element_at(F.filter(pieces, lambda p: p["hi"] >= share), 1)
    need = (share - at["lo"]) * at["whole"]
    root = F.sqrt(F.greatest(at["value"] * at["value"] + 2 * at["slope"] * need, F.lit(0.0)))
    step = F.when(need <= 0, F.lit(0.0)).otherwise(2 * need / (at["value"] + root))
    return F.least(at["start"] + F.least(step, at["length"]), F.lit(1.0))


def source_targets(sizes: DataFrame, weights=WEIGHTS, schedules=SCHEDULES, share: float = 1.5, passes: int = 2) -> DataFrame:
    """One row per source of sizes(source, size): source_size, weight, target (double), goal (whole words), pieces.

    Weights repeat over the sources in order of code points, null last. Targets fill ``share`` of all words by weight
    and stop at ``passes`` times a source's size; the excess is shared again by weight among the rest.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("at", order)
    base = _cycle([F.lit(w) for w in weights], F.col("at"))
    area = [sum((a + b) / 2 for a, b in zip(s, s[1:], strict=False)) / (len(s) - 1) for s in schedules]
    per = per.withColumn("weight", base * _cycle([F.lit(a) for a in area], F.col("at"))).withColumn("pieces", _cycle([_pieces(s) for s in schedules], F.col("at")))
    per = per.withColumn("cap", passes * F.col("source_size").cast("double")).withColumn("full", F.col("cap") / F.col("weight"))
    by = Window.orderBy("full", "at")
    before, after = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).orderBy("full", "at")
    left = share * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    per = per.withColumn("level", left / F.sum("weight").over(after))
    open_level = F.first(F.when(F.col("full") > F.col("level"), F.col("level")), ignorenulls=True).over(every)
    target = F.when(F.col("full") > F.col("level"), F.col("weight") * open_level).otherwise(F.col("cap"))
    out = per.withColumn("target", F.least(target, F.col("cap")))
    return out.select("source", "source_size", "weight", "target", F.round("target").cast("long").alias("goal"), "pieces")


def curriculum(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17, **mix) -> DataFrame:
    """One row per input row: id_col, source, size, source_size, target, takes, taken, position, goal (whole words of the
    source's target) and dice (the hash that orders it); sorted by position.

    takes: one entry per pass over the document, (pass, words, position); taken: their words. A source's takes add up
    to its rounded target: every document goes floor(target / size) times whole, and a hash of id and text orders the
    documents that fill the rest, the last of them in part. position is that of the first take, null without any; the
    rows are range-sorted by it, those without last. Null sources are one source, null texts have no words, null ids are kept;
    rows that repeat an id and a text are each placed, one after the other. The same input gives the same result.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col).cast("string")).alias("size"), F.xxhash64(F.lit(seed), id_col, text_col).alias("dice"))
    sizes = stored(base, "sizes")
    per = stored(source_targets(sizes, **mix), "sources")
    part = [F.coalesce("source", F.lit("")).alias("name"), F.col("source").isNull().alias("nameless"), F.shiftright("dice", 64 - BUCKET_BITS).alias("bucket")]
    rows = sizes.select("*", *part)
    sums = rows.groupBy("name", "nameless", "bucket").agg(F.sum("size").alias("words"))
    run = Window.partitionBy("name", "nameless").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("name", "nameless", "bucket", F.coalesce(F.sum("words").over(run), F.lit(0)).alias("base"))
    inner = Window.partitionBy("name", "nameless", "bucket").orderBy("dice", "doc", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("upto", F.sum("size").over(inner)).join(sums, ["name", "nameless", "bucket"])
    placed = placed.withColumn("start", F.col("base") + F.col("upto") - F.col("size")).select("doc", "source", "size", "start", "dice")
    out = placed.alias("p").join(per.alias("s"), F.col("p.source").eqNullSafe(F.col("s.source"))).select("p.*", "source_size", "target", "goal", "pieces")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("goal") / F.col("source_size"))).otherwise(0).cast("long")
    out = out.withColumn("whole", F.least(whole, F.col("goal")))
    rest = F.least(F.greatest(F.col("goal") - F.col("whole") * F.col("source_size") - F.col("start"), F.lit(0)), F.col("size"))
    share = lambda turn: (turn * F.col("source_size") + F.col("start")) / F.col("goal")
    take = lambda turn: F.struct(turn.cast("int").alias("pass"), F.when(turn < F.col("whole"), F.col("size")).otherwise(rest).alias("words"), _when(F.col("pieces"), F.least(share(turn), F.lit(1.0))).alias("position"))
    takes = F.when(F.col("size") > 0, F.filter(F.transform(F.sequence(F.lit(0).cast("long"), F.col("whole")), take), lambda t: t["words"] > 0)).otherwise(F.array())
    out = out.withColumn("takes", takes)
    taken = F.aggregate("takes", F.lit(0).cast("long"), lambda total, t: total + t["words"])
    first = F.try_element_at("takes", F.lit(1))["position"]
    out = out.select(F.col("doc").alias(id_col), "source", "size", "source_size", "target", "takes", taken.alias("taken"), first.alias("position"), "goal", "dice")
    behind = 1 + F.pmod(F.xxhash64(id_col), F.lit(1 << 20)) / (1 << 20)  # rows without a take spread over many ranges
    return out.orderBy(F.coalesce("position", behind + 1), id_col)


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17, **mix) -> DataFrame:
    """``docs`` as the mix takes them: each row as often as it goes whole; the last one of a source if over half goes.

    All columns stay. The order by hash turns a source's takes into one number a source, up to which rows go once more,
    so texts are not moved. Rows without words go as often as the source does whole.
    """
    plan = curriculum(docs, id_col, text_col, source_col, seed, **mix)
    dice = F.xxhash64(F.lit(seed), id_col, text_col)
    taken = plan.select("source", "size", "source_size", "goal", "dice", F.col("taken"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("goal") / F.col("source_size"))).otherwise(1).cast("long")
    more = (F.col("taken") - whole * F.col("size")) * 2 >= F.col("size")
    per = taken.groupBy("source").agg(F.first(whole).alias("_whole"), F.max(F.when(more & (F.col("size") > 0), F.col("dice"))).alias("_upto"))
    per = stored(per.withColumnRenamed("source", "_source"), "copies")
    out = docs.join(per, F.col(source_col).cast("string").eqNullSafe(F.col("_source")))
    times = F.col("_whole") + F.when(dice <= F.col("_upto"), 1).otherwise(0)
    return out.withColumn("_turn", F.explode(F.array_repeat(F.lit(0), times.cast("int")))).select(*docs.columns)
