"""The opN queries: thin digests over the operators, and their SQL where SQL can express them."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import nearest
from .langid import held_out, identify, train
from .license import BLANK, CUES, STRANGE, TEMPLATES, TERM, license_scan
from .minhash import edited_fingerprints
from .mixing import curriculum
from .packing import pack
from .rangecoder import read_tokens, write_tokens
from .shared import shared_dir
from .simhash import simhash_groups
from .substring import remove_repeats
from .warc import header_lines, resolve_revisits

ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLES["op1_substring_dedup"] = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), win AS (
  SELECT doc_id, p, array_to_string(ws[p:p + 12], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS p FROM w WHERE len(ws) >= 13)
), least AS (
  SELECT g, min(doc_id) AS d FROM win GROUP BY g HAVING min(doc_id) < max(doc_id)
), gone AS (
  SELECT DISTINCT doc_id, i FROM (
    SELECT win.doc_id, unnest(range(p, p + 13)) AS i FROM win JOIN least USING (g) WHERE d < win.doc_id)
), words AS (
  SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM w
), kept AS (
  SELECT words.doc_id, count(*) FILTER (WHERE gone.i IS NOT NULL) AS n_removed,
         string_agg(word, ' ' ORDER BY words.i) FILTER (WHERE gone.i IS NULL) AS t
  FROM words LEFT JOIN gone USING (doc_id, i) GROUP BY words.doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""


def file_path() -> Column:
    """Documents as files: a source is a tree two directories deep, and every fourth document is its licence file."""
    name = F.concat(F.when(F.col("doc_id") % 4 == 1, F.lit("LICENSE-")).otherwise(F.lit("file-")), F.col("doc_id").cast("string"), F.lit(".txt"))
    deep = F.when(F.col("doc_id") % 8 == 1, F.lit("")).otherwise(F.concat(F.lit("/"), (F.col("doc_id") % 3).cast("string"), F.when(F.col("doc_id") % 5 == 0, F.lit("/lib")).otherwise(F.lit(""))))
    return F.concat(F.coalesce("source", F.lit("none")), deep, F.lit("/"), name)


def op2_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return license_scan(docs.select(file_path().alias("path"), "text"))


def _values(rows: list[tuple]) -> str:
    quoted = ["(" + ", ".join("'" + str(x).replace("'", "''") + "'" for x in r) + ")" for r in rows]
    return ", ".join(quoted)


ORACLES["op2_license"] = rf"""
WITH files AS (
  SELECT DISTINCT coalesce(source, 'none') || CASE WHEN doc_id % 8 = 1 THEN '' ELSE '/' || (doc_id % 3) || CASE WHEN doc_id % 5 = 0 THEN '/lib' ELSE '' END END
         || '/' || CASE WHEN doc_id % 4 = 1 THEN 'LICENSE-' ELSE 'file-' END || doc_id || '.txt' AS path, text, doc_id FROM documents
), cut AS (
  SELECT path, list_distinct(list_concat(string_split(coalesce(text, ''), chr(10)), regexp_split_to_array(coalesce(text, ''), '{BLANK}'), CASE WHEN doc_id % 4 = 1 THEN [coalesce(text, '')] ELSE [] END)) AS units FROM files
), units AS (
  SELECT path, words, row_number() OVER () AS id FROM (SELECT DISTINCT path, unnest(units) AS words FROM cut)
  WHERE {" OR ".join(f"contains(lower(words), '{c}')" for c in CUES)}
), tf AS (
  SELECT path, id, term, 1 + ln(count(*)) AS tf FROM (SELECT path, id, unnest(regexp_extract_all(lower(words), '{TERM}')) AS term FROM units) GROUP BY ALL
), templates(tno, name, body) AS (VALUES {_values([(i, *t) for i, t in enumerate(TEMPLATES)])}
), tt AS (
  SELECT tno, name, term, 1 + ln(count(*)) AS tf FROM (SELECT tno, name, unnest(regexp_extract_all(lower(body), '{TERM}')) AS term FROM templates) GROUP BY ALL
), idf AS (
  SELECT term, ln((1.0 + {len(TEMPLATES)}) / (1 + count(*))) + 1 AS idf FROM tt GROUP BY term
), tw AS (
  SELECT tno, name, term, tf * idf AS w, sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY tno)) AS length, count(*) OVER (PARTITION BY tno) AS terms FROM tt JOIN idf USING (term)
), w AS (
  SELECT path, id, term, tf * coalesce(idf, {STRANGE}) AS w FROM tf LEFT JOIN idf USING (term)
), cosine AS (
  SELECT w.path, name, terms, round(sum(w.w * tw.w) / (any_value(norm) * any_value(length)), 6) AS score
  FROM w JOIN tw USING (term) JOIN (SELECT id, sqrt(sum(w * w)) AS norm FROM w GROUP BY id) USING (id)
  GROUP BY w.path, id, tno, name, terms
), own AS (
  SELECT path, name AS licence, score FROM cosine WHERE score >= 0.6
  QUALIFY row_number() OVER (PARTITION BY path ORDER BY score DESC, terms DESC, name) = 1
), holders AS (
  SELECT regexp_replace(path, '/[^/]*$', '') AS up, licence, score FROM own WHERE regexp_matches(path, '/LICENSE[^/]*$')
  QUALIFY row_number() OVER (PARTITION BY regexp_replace(path, '/[^/]*$', '') ORDER BY score DESC, licence) = 1
), near AS (
  SELECT path, h.up, h.licence, h.score FROM (SELECT DISTINCT path, regexp_replace(path, '/[^/]*$', '') AS dir FROM files) JOIN holders h ON dir = h.up OR starts_with(dir, h.up || '/')
  QUALIFY row_number() OVER (PARTITION BY path ORDER BY length(h.up) DESC) = 1
)
SELECT p.path, coalesce(own.licence, near.licence) AS licence, coalesce(own.score, near.score) AS score,
       CASE WHEN own.licence IS NOT NULL THEN 'own' WHEN near.licence IS NOT NULL THEN 'inherited' ELSE 'none' END AS found,
       CASE WHEN own.licence IS NULL THEN near.up END AS licence_dir
FROM (SELECT DISTINCT path FROM files) p LEFT JOIN own USING (path) LEFT JOIN near USING (path)
"""


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.where(~held_out()).select("text", "lang"))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = curriculum(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "position")


def page_records(pages: DataFrame) -> DataFrame:
    """Each page as a full response at time page_id, and as a revisit of the page's URL 700 later.

    Of the revisits one in five has another entity tag, and one in five has only a date.
    """
    tag = F.md5(F.col("html").cast("binary"))
    kinds = F.array(F.lit("response"), F.lit("revisit"))
    rows = pages.select("page_id", "url", tag.alias("tag"), F.explode(kinds).alias("kind"))
    again, turn = F.col("kind") == "revisit", F.col("page_id") % 5
    etag = F.when(~again, F.concat(F.lit('"'), "tag", F.lit('"'))).when(turn == 0, F.lit('"old"')).when(turn == 1, F.lit(None)).otherwise(F.concat(F.lit('W/"'), "tag", F.lit('"')))
    date = F.concat(F.lit("day "), F.floor(F.col("page_id") / 10).cast("string"))
    headers = F.when(again, F.create_map(F.lit("date"), F.concat(F.lit("seen "), F.col("page_id").cast("string")), F.lit("content-length"), F.lit("0"), F.lit("cache-control"), F.lit("max-age=60")))
    headers = headers.otherwise(F.create_map(F.lit("date"), date, F.lit("content-type"), F.lit("text/html"), F.lit("content-length"), F.length("tag").cast("string")))
    return rows.select(
        (2 * F.col("page_id") + F.when(again, 1).otherwise(0)).alias("record_id"), F.col("url").alias("uri"), (F.col("page_id") + F.when(again, 700).otherwise(0)).alias("ts"), "kind",
        etag.alias("etag"), date.alias("last_modified"), F.col("tag").alias("digest"), headers.alias("headers"),
    )


def op7_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resolve_revisits(page_records(_table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    return out.select("record_id", "url", "full_id", "outcome", header_lines(F.col("headers")).alias("header_lines"))


ORACLES["op7_revisits"] = rf"""
WITH p AS (
  SELECT page_id, md5(html) AS tag, page_id // 10 AS day,
         regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '([?&])utm_[a-z]+=[^&]*', '\1', 'g'), '&+', '&', 'g'), '[?&/]+$', ''), '\?&', '?', 'g') AS bare
  FROM pages
), c AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^[^/?]*')), '^www\.', ''), ':(80|443)$', '') || regexp_extract(bare, '^[^/?]*(.*)$', 1) AS url FROM p
), found AS (
  SELECT r.page_id AS rid, r.tag AS rtag, r.day AS rday, r.url, f.page_id AS fid, f.tag AS ftag, f.day AS fday
  FROM c r LEFT JOIN c f ON r.url = f.url AND f.page_id < r.page_id + 700
  QUALIFY row_number() OVER (PARTITION BY r.page_id ORDER BY f.page_id DESC NULLS LAST) = 1
), o AS (
  SELECT *, CASE WHEN fid IS NULL THEN 'orphan'
                 WHEN rid % 5 = 0 THEN 'mismatch'
                 WHEN rid % 5 = 1 THEN CASE WHEN rday = fday THEN 'resolved' ELSE 'mismatch' END
                 WHEN rtag = ftag THEN 'resolved' ELSE 'mismatch' END AS outcome FROM found
)
SELECT 2 * rid + 1 AS record_id, url, 2 * fid AS full_id, outcome,
       CASE WHEN outcome = 'resolved' THEN 'cache-control: max-age=60' || chr(10) || 'content-length: 32' || chr(10) || 'content-type: text/html' || chr(10) || 'date: seen ' || rid
            ELSE 'cache-control: max-age=60' || chr(10) || 'content-length: 0' || chr(10) || 'date: seen ' || rid END AS header_lines
FROM o
"""


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(_table(spark, sf_dir, "documents").select("doc_id", "text"), path, tokenizer_path())
    return read_tokens(spark, path, ids=False)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}
