"""Deal documents out in id order, so that neighbours by id meet in one task."""

from __future__ import annotations

from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKET_ROWS, MOST_BUCKETS = 1024, 20_000


def id_bounds(docs: DataFrame, id_col: str) -> np.ndarray:
    """Ids that cut the table into about equal runs of ids; at most MOST_BUCKETS of them, whatever the table's size."""
    rows = docs.count()
    parts = max(1, min(MOST_BUCKETS, ceil(rows / BUCKET_ROWS)))
    cuts = F.percentile_approx(id_col, [i / parts for i in range(1, parts)] or [0.5], 20 * parts)
    found = docs.agg(cuts.alias("cuts")).first()["cuts"] if parts > 1 else None
    return np.unique(np.array(found or [], dtype=np.int64))


def with_next(docs: DataFrame, id_col: str) -> DataFrame:
    """Rows with ``bucket`` and ``guest``: sorted by (bucket, guest, id descending) each row's next by id follows it.

    A bucket is a run of ids. The first row of the run below joins each bucket as its guest, behind the bucket's own
    rows (the first row of all is the guest of the lowest run), so all but guests have a follower in their own bucket.
    Null ids count as the lowest.
    """
    bounds = id_bounds(docs.select(id_col), id_col)

    @F.pandas_udf("int")
    def bucket(ids: pd.Series) -> pd.Series:
        low = ids.isna()
        return pd.Series(np.where(low, 0, np.searchsorted(bounds, ids.fillna(0).to_numpy(np.int64), side="left"))).astype("int32")

    tops = docs.select(id_col, bucket(id_col).alias("bucket")).groupBy("bucket").agg(F.max(id_col).alias("top")).collect()
    tops = sorted(((r["bucket"], r["top"]) for r in tops), reverse=True)
    spark = docs.sparkSession
    after = [(tops[(i + 1) % len(tops)][1], tops[i][0]) for i in range(len(tops))]
    guests = F.broadcast(spark.createDataFrame(after, "top long, target int"))
    own = docs.withColumn("bucket", bucket(id_col)).join(guests, F.col(id_col).eqNullSafe(F.col("top")), "left")
    places = F.array(F.struct("bucket", F.lit(False).alias("guest")), F.struct(F.col("target").alias("bucket"), F.lit(True).alias("guest")))
    places = F.filter(places, lambda p: p["bucket"].isNotNull())
    return own.withColumn("place", F.explode(places)).drop("bucket", "top", "target").select("*", "place.bucket", "place.guest").drop("place")
