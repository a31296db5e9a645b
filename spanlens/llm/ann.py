"""Approximate nearest neighbours by largest inner product: inverted lists scanned with adaptive dimensions.

Vectors get one more component that gives them all the same length (queries get 0), so the largest inner product is the
smallest distance, and a random rotation then spreads every distance evenly over the components: of a distance over n
components, m of them hold a share that is beta distributed around m / n. A list is scanned in blocks of columns. After
each, a candidate is abandoned where its partial distance is too large (by Z standard deviations of that share) for its
distance to be within that of the query's k-th best so far. Survivors are measured exactly on the original vectors in
double precision.

Centroids come from a bounded sample; every vector is indexed. How many lists a query probes is measured, not set: on the
sample, the least number of nearest lists that hold the wanted share of the true neighbours of sampled queries. The k-th
best so far is first that of the sample, whose vectors are candidates, too; lists are visited nearest first, in two
turns, and the second has the k-th best of the first. Lists are cut into blocks of vectors and of queries by their
counts, so a list with a third of all vectors becomes many block pairs of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

SAMPLE, LIST_ROWS, MOST_LISTS, ASKED = 16_384, 1000, 2048, 512
BLOCK_ROWS, QUERY_ROWS, COLUMNS, Z, SEED = 2048, 1024, 16, 2.6, 11
FIRST_TURN = 8  # the first turn visits this part of the lists


def _rotation(dim: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(SEED).standard_normal((dim, dim)))[0]


def _lift(vectors: np.ndarray, length2: float | None) -> np.ndarray:
    """Append the component that brings each vector's squared length to length2 (0 for queries)."""
    extra = np.zeros(len(vectors)) if length2 is None else np.sqrt(np.maximum(length2 - (vectors * vectors).sum(axis=1), 0))
    return np.concatenate([vectors, extra[:, None]], axis=1)


def _kmeans(points: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(SEED)
    centres = points[rng.choice(len(points), k, replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(points, centres, 1)[:, 0]
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        counts = np.bincount(near, minlength=k)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], points[rng.choice(len(points), k)])
    return centres


def _nearest(points: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    far = (centres * centres).sum(axis=1) - 2 * points @ centres.T
    return np.argsort(far, axis=1, kind="stable")[:, :n]


def _probes(ids: np.ndarray, points: np.ndarray, qids: np.ndarray, queries: np.ndarray, centres: np.ndarray, k: int, recall: float) -> int:
    """Nearest lists to probe so that they hold ``recall`` of the k true neighbours, among the points, of the queries."""
    own = _nearest(points, centres, 1)[:, 0]
    places = []
    for qid, q, order in zip(qids, queries, _nearest(queries, centres, len(centres)), strict=True):
        score = np.where(ids == qid, -np.inf, points @ q)
        best = np.argsort(-score, kind="stable")[: min(k, int((ids != qid).sum()))]
        at = np.empty(len(centres), dtype=np.int64)
        at[order] = np.arange(len(centres))
        places.append(at[own[best]])
    places = np.sort(np.concatenate(places)) if places else np.zeros(0, dtype=np.int64)
    return int(places[ceil(recall * len(places)) - 1]) + 1 if len(places) else 1


def _best(ids: np.ndarray, vectors: np.ndarray, qids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and scores of the k best of the vectors for each query, by score and then id."""
    near = queries @ vectors.T
    near[qids[:, None] == ids] = -np.inf
    for row, query, qid in zip(near, queries, qids, strict=True):
        some = np.flatnonzero(ids != qid)
        if len(some) > k:  # products of matrices round otherwise than sums do
            some = np.flatnonzero(row >= np.partition(row, len(row) - k)[len(row) - k] - 1e-9 * np.abs(query).sum())
            some = some[ids[some] != qid]
        score = (vectors[some] * query).sum(axis=1)
        best = np.lexsort((ids[some], -score))[:k]
        yield ids[some][best], score[best]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def usable(vectors: DataFrame, vec_col: str) -> DataFrame:
    """Rows with a vector that is not null, not zero, and without null or non-finite components."""
    x = F.col(vec_col)
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.where(x.isNotNull() & (F.size(x) > 0) & fine & F.exists(x, lambda v: v != 0))


def _cuts(width: int) -> list[int]:
    """Ends of the column blocks: two steps at once first, and longer ones as fewer candidates are left."""
    out, at = [0], 2 * COLUMNS
    while at + COLUMNS <= width:
        out.append(at)
        at += max(COLUMNS, at // 2 // COLUMNS * COLUMNS) if at >= 4 * COLUMNS else COLUMNS
    return [*out, width]


def scan(ids: np.ndarray, vectors: np.ndarray, qids: np.ndarray, queries: np.ndarray, leasts: np.ndarray, length2: float, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """Of each query the id, the ids and scores of its k best that score ``least`` or more, and how many were measured."""
    width = vectors.shape[1] + 1
    rotation = _rotation(width)
    cuts = _cuts(width)
    turned, asked = _lift(vectors, length2) @ rotation, _lift(queries, None) @ rotation
    parts = [np.ascontiguousarray(turned[:, a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
    sizes = [(p * p).sum(axis=1) for p in parts]
    share = [m / width + Z * np.sqrt(2 * m * (width - m) / (width * width * (width + 2))) for m in cuts[1:]]
    limits = np.maximum((queries * queries).sum(axis=1) + length2 - 2 * leasts, 0) * (1 + 1e-9) + 1e-9
    own = asked[:, : cuts[1]]
    first = (own * own).sum(axis=1)[:, None] - 2 * (own @ parts[0].T) + sizes[0]
    for row, (qid, q, t, least, limit) in enumerate(zip(qids, queries, asked, leasts, limits, strict=True)):
        alive = np.flatnonzero(first[row] <= share[0] * limit)
        partial = first[row][alive]
        for n in range(1, len(parts)):
            own = t[cuts[n] : cuts[n + 1]]
            partial = partial + sizes[n][alive] - 2 * (parts[n][alive] @ own) + own @ own
            keep = partial <= share[n] * limit
            alive, partial = alive[keep], partial[keep]
        alive = alive[ids[alive] != qid]
        score = (vectors[alive] * q).sum(axis=1)
        good = score >= least
        best = np.lexsort((ids[alive][good], -score[good]))[:k]
        yield qid, ids[alive][good][best], score[good][best], len(alive)


def _scans(dim: int, length2: float, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                ids, flat, qids, asked, leasts = (batch.column(i).slice(row, 1).flatten() for i in range(5))
                vectors, queries = (x.to_numpy(zero_copy_only=False).reshape(-1, dim) for x in (flat, asked))
                out = list(scan(ids.to_numpy(), vectors, qids.to_numpy(), queries, leasts.to_numpy(), length2, k))
                names, own, score = zip(*[x[:3] for x in out], strict=True)
                columns = [np.repeat(names, list(map(len, own))), np.concatenate(own), np.concatenate(score)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", least_probes: int = 6, recall: float = 0.95) -> DataFrame:
    """The k nearest found of each query: query_id, rank (from 1), vec_id, score; ties go to the smaller vec_id.

    Both tables have id_col and vec_col; a query's own id is no candidate of it, and equal rows count once. Vectors that are null, empty, zero, hold
    null or non-finite components, or are not of the most common length take no part. Each query probes its nearest
    lists: at least ``least_probes``, as many as hold 4 k vectors, and as many as the sample shows to be needed for
    ``recall``.
    """
    spark = vectors.sparkSession
    base = usable(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")), "v").where("id is not null")
    asked = usable(queries.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")), "v").where("id is not null")
    schema = "query_id long, rank int, vec_id long, score double"
    length2 = F.aggregate("v", F.lit(0.0), lambda t, x: t + x * x)
    sizes = base.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("rows"), F.max(length2).alias("length2")).orderBy(F.desc("rows"), "dim").first()
    if sizes is None:
        return spark.createDataFrame([], schema)
    dim, rows, most = sizes["dim"], sizes["rows"], sizes["length2"]
    base, asked = base.where(F.size("v") == dim), asked.where(F.size("v") == dim)

    def sampled(df: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
        rows = df.orderBy(F.xxhash64("id"), "id").limit(n).select("id", "v").toArrow().combine_chunks()
        return rows.column("id").to_numpy(), _matrix(rows.column("v").combine_chunks(), dim)

    rotation = _rotation(dim + 1)
    ids, plain = sampled(base, SAMPLE)
    points = _lift(plain, most) @ rotation
    lists = max(1, min(MOST_LISTS, round(rows / LIST_ROWS), len(points) // 8))
    centres = _kmeans(points, lists)
    sent = spark.sparkContext.broadcast(centres)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = _lift(_matrix(batch.column(1), dim), most) @ _rotation(dim + 1)
            yield pa.RecordBatch.from_arrays([pa.array(_nearest(points, sent.value, 1)[:, 0], pa.int32()), *batch.columns], ["list", "id", "v"])

    indexed = stored(base.mapInArrow(assign, "list int, id long, v array<double>"), "lists")
    counts = {r["list"]: r["count"] for r in indexed.groupBy("list").count().collect()}  # at most MOST_LISTS rows
    held = np.array([counts.get(i, 0) for i in range(lists)])
    probes = min(lists, least_probes)
    if probes < lists:
        qids, tried = sampled(asked, ASKED)
        probes = max(probes, _probes(ids, points, qids, _lift(tried, None) @ rotation, centres, k, recall))

    known = spark.sparkContext.broadcast((ids, plain))
    first = ceil(probes / FIRST_TURN)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                qids, queries = part.column(0).to_numpy(), _matrix(part.column(1), dim)
                order = _nearest(_lift(queries, None) @ _rotation(dim + 1), sent.value, lists)
                enough = np.cumsum(held[order], axis=1) - held[order] < 4 * k
                enough[:, :probes] = True
                enough &= held[order] > 0
                own, score = zip(*_best(*known.value, qids, queries, k), strict=True)
                least = [x[-1] if len(x) == k else -np.inf for x in score]
                near = [[o[e & turn].tolist() for o, e in zip(order, enough, strict=True)] for turn in (np.arange(lists) < first, np.arange(lists) >= first)]
                columns = [*part.columns, pa.array(least), *[pa.array(x, pa.list_(pa.int32())) for x in near], *[pa.array([x.tolist() for x in c], pa.list_(t)) for c, t in ((own, pa.int64()), (score, pa.float64()))]]
                yield pa.RecordBatch.from_arrays(columns, ["id", "v", "least", "near", "rest", "own", "scores"])

    routed = stored(asked.mapInArrow(route, "id long, v array<double>, least double, near array<int>, rest array<int>, own array<long>, scores array<double>"), "probes", 256)

    def blocks(df: DataFrame, size: int, ids: str, flat: str, *more: str) -> DataFrame:
        parts = {r["list"]: ceil(r["count"] / size) for r in df.groupBy("list").count().collect()}
        cut = F.element_at(F.array(*[F.lit(parts.get(i, 1)) for i in range(lists)]), F.col("list") + 1)
        keyed = df.withColumn("block", F.pmod(F.xxhash64("id"), cut))
        rows = keyed.groupBy("list", "block").agg(F.collect_list(F.struct("id", "v", *more)).alias("rows"))
        return rows.select("list", F.col("rows.id").alias(ids), F.flatten("rows.v").alias(flat), *[F.col(f"rows.{m}").alias(m) for m in more])

    held_blocks = blocks(indexed, BLOCK_ROWS, "ids", "vs")

    def turn(asked: DataFrame) -> DataFrame:
        pairs = held_blocks.join(blocks(asked, QUERY_ROWS, "qids", "qs", "least"), "list")
        return pairs.select("ids", "vs", "qids", "qs", "least").mapInArrow(_scans(dim, most, k), "query_id long, vec_id long, score double")

    def ranked(found: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return found.distinct().withColumn("rank", rank).where(F.col("rank") <= k)

    seeds = routed.select(F.col("id").alias("query_id"), F.explode(F.arrays_zip("own", "scores")).alias("x")).select("query_id", F.col("x.own").alias("vec_id"), F.col("x.scores").alias("score"))
    found = seeds.union(turn(routed.select("id", "v", "least", F.explode("near").alias("list"))))
    found = stored(ranked(found), "near")
    best = found.where(F.col("rank") == k).groupBy("query_id").agg(F.max("score").alias("found"))
    again = routed.join(best, F.col("id") == F.col("query_id"), "left").select("id", "v", F.coalesce("found", "least").alias("least"), F.explode("rest").alias("list"))
    return ranked(found.drop("rank").union(turn(again))).select("query_id", "rank", "vec_id", "score")
