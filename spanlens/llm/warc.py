"""Not-modified revisits: give each the latest earlier full response of its URL and refresh that response's headers.

The as-of join is two window passes. Time is cut into slices; the last full response of each (URL, slice) is found by a
partial aggregate, carried forward over a URL's slices (one row each), and only rows of one slice of one URL are ordered
together. A URL with any share of all records therefore spreads over as many tasks as it has slices. Payloads never
move: records carry digests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Header fields (lower case) that a 304 response may set anew on a stored response.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")


def canonical_url(url: Column) -> Column:
    """Without scheme, fragment, tracking parameters, default port and trailing slash; lower-case host without www."""
    bare = F.regexp_replace(F.regexp_replace(url, r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    bare = F.regexp_replace(bare, r"([?&])utm_[a-z]+=[^&]*", "$1")
    bare = F.regexp_replace(F.regexp_replace(bare, r"&+", "&"), r"[?&/]+$", "")
    bare = F.regexp_replace(bare, r"\?&", "?")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, r"^[^/?]*", 0)), r"^www\.", ""), r":(80|443)$", "")
    return F.concat(host, F.regexp_extract(bare, r"^[^/?]*(.*)$", 1))


def _weak(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def resolve_revisits(records: DataFrame, slice_width: int = 4096) -> DataFrame:
    """One row per revisit of records(record_id, uri, ts, kind, etag, last_modified, digest, headers).

    ts is a long; kind is ``response`` (a full one) or ``revisit``; headers is a map with lower-case names. Returns
    record_id, url, full_id, outcome, headers. The candidate is the full response with the largest (ts, record_id)
    below the revisit's ts; a later or simultaneous one never counts. outcome: ``resolved`` where a validator agrees
    (entity tags compared weakly; without a pair of tags the dates, without those the digests), ``mismatch`` where it
    does not, ``unchecked`` where no pair of validators exists, ``orphan`` without a candidate. headers: the stored
    ones, with permitted fields of the revisit put over them if resolved, else the revisit's own. Null uri or ts: an
    orphan, or never a candidate. Repeated rows are resolved each for itself; of full responses that repeat a url, ts
    and record_id the one with the largest digest, then etag, date and headers (in order of names) is taken. slice_width
    is in units of ts. Other columns are left out; an empty table gives no rows.
    """
    r = records.select(
        F.col("record_id").cast("long"), canonical_url(F.col("uri")).alias("url"), F.col("ts").cast("long"), (F.col("kind") == "revisit").alias("revisit"), (F.col("kind") == "response").alias("full"), "etag", "last_modified", "digest", "headers"
    )
    r = r.where("revisit or full").withColumn("slice", F.floor(F.col("ts") / slice_width))
    stored = F.when(F.col("full") & F.col("ts").isNotNull() & F.col("url").isNotNull(), F.struct("ts", "record_id", "etag", "last_modified", "digest", "headers"))
    r = r.withColumn("stored", stored)
    tie = [F.col("digest"), F.col("etag"), F.col("last_modified"), F.array_sort(F.map_entries("headers"))]
    key = F.struct("ts", "record_id", *tie)
    lasts = r.where("stored is not null").groupBy("url", "slice").agg(F.max_by("stored", key).alias("stored"))
    spots = r.where("revisit and ts is not null and url is not null").select("url", "slice").distinct()
    over = Window.partitionBy("url").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = spots.join(lasts, ["url", "slice"], "full").withColumn("before", F.last("stored", ignorenulls=True).over(over)).select("url", "slice", "before")
    inner = Window.partitionBy("url", "slice").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    near = r.withColumn("here", F.max(F.when(F.col("stored").isNotNull(), F.struct("ts", "record_id"))).over(inner)).where("revisit")
    bodies = r.where("stored is not null").select("url", "slice", F.struct("ts", "record_id").alias("here"), "stored", F.struct(*tie).alias("tie"))
    bodies = bodies.groupBy("url", "slice", "here").agg(F.max_by("stored", "tie").alias("found"))
    near = near.drop("stored").join(carried, ["url", "slice"], "left").join(bodies, ["url", "slice", "here"], "left")
    near = near.withColumn("found", F.coalesce("found", "before"))
    f = F.col("found")
    tags, dates, digests = (F.col(n).isNotNull() & f[n].isNotNull() for n in ("etag", "last_modified", "digest"))
    agree = F.when(tags, _weak(F.col("etag")) == _weak(f["etag"])).when(dates, F.col("last_modified") == f["last_modified"]).when(digests, F.col("digest") == f["digest"])
    outcome = F.when(f.isNull(), "orphan").when(agree, "resolved").when(~agree, "mismatch").otherwise("unchecked")
    empty = F.expr("cast(map() as map<string,string>)")
    own = F.coalesce("headers", empty)
    fresh = F.map_filter(own, lambda k, _: k.isin(*PERMITTED))
    old = F.map_filter(F.coalesce(f["headers"], empty), lambda k, _: ~F.array_contains(F.map_keys(fresh), k))
    return near.select("record_id", "url", f["record_id"].alias("full_id"), outcome.alias("outcome"), F.when(outcome == "resolved", F.map_concat(old, fresh)).otherwise(own).alias("headers"))


def header_lines(headers: Column) -> Column:
    """One ``name: value`` line a field, in order of names."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(headers), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "\n")
