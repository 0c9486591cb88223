"""Operator 9: resolution of not-modified revisits in web archives.

A revisit record (HTTP 304) has no body. It is joined as of its date with the latest earlier full
response for the same canonical URL; its validators are checked against that response's, and the
headers that a 304 may change are merged into the stored ones.

The as-of join runs on records range-sorted by URL and date: each block of the sort looks back
within itself, and the last responses of earlier blocks, one row per URL and block, cover the
rest, so a URL with a third of all captures is spread over many tasks. Bodies are joined last,
only to the revisits that use them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scanhouse.llm.common import materialise, small_enough, table

# Headers that a not-modified response may replace in the stored one.
MERGED_HEADERS = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]

RESPONSE, REVISIT = "response", "revisit"


def canonical_url(url: Column) -> Column:
    """Host in lower case without ``www.`` and default port, path, and query with sorted parts;
    scheme, user and fragment go. NULL for a NULL URL."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    bare = F.regexp_replace(bare, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    rest = F.regexp_extract(bare, "^[^/?]*(.*)$", 1)
    host = F.lower(F.regexp_replace(F.regexp_extract(bare, "^([^/?]*)", 1), "^.*@", ""))
    host = F.regexp_replace(F.regexp_replace(host, ":(80|443)$", ""), r"^www\d*\.", "")
    path = F.regexp_extract(rest, r"^([^?]*)", 1)
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    parts = F.array_join(F.sort_array(F.split(query, "&")), "&")
    return F.concat(host, F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), parts)))


def opaque(etag: Column) -> Column:
    """An entity tag without its weakness mark: not-modified checks compare weakly."""
    return F.regexp_replace(etag, "^W/", "")


def latest_earlier(records: DataFrame) -> DataFrame:
    """Revisits of ``records(record_id, type, canonical, date, status, headers)`` with ``found``,
    the latest earlier full response (record_id, etag, last_modified), NULL if there is none."""
    full = (F.col("type") == RESPONSE) & (F.col("status") == 200)
    head = F.struct("record_id", F.col("headers")["etag"].alias("etag"), F.col("headers")["last-modified"].alias("last_modified"))
    rows = records.where("canonical is not null and date is not null").where(full | (F.col("type") == REVISIT))
    rows = rows.select("record_id", "type", "canonical", "date", "status", "headers", full.cast("int").alias("full"), F.when(full, head).alias("head"))
    order = ["date", "full", "record_id"]  # at the same instant a response is not earlier
    rows = rows.repartitionByRange("canonical", *order).sortWithinPartitions("canonical", *order)
    rows = materialise(rows.withColumn("block", F.spark_partition_id()), "captures")
    within = Window.partitionBy("canonical", "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    here = rows.withColumn("here", F.last("head", ignorenulls=True).over(within)).where(F.col("type") == REVISIT)
    tails = rows.groupBy("canonical", "block").agg(F.max_by("head", F.when(F.col("full") == 1, F.struct("date", "record_id"))).alias("tail"))
    before = Window.partitionBy("canonical").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    tails = tails.select("canonical", "block", F.last("tail", ignorenulls=True).over(before).alias("prior")).where("prior is not null")
    return here.join(tails, ["canonical", "block"], "left").withColumn("found", F.coalesce("here", "prior")).drop("here", "prior", "head", "full", "block")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row per revisit of ``records(record_id, type, url, date, status, headers, payload, ...)``:
    record_id, canonical, date, outcome, response_id, status, headers, payload.

    ``headers`` is a map with names in lower case. ``outcome``: ``resolved``; ``changed`` (an ETag,
    or without one a Last-Modified, that differs from the response's or that it lacks);
    ``unvalidated`` (the revisit has neither; still resolved); ``missing`` (no earlier full
    response, or no URL or date). Only resolved and unvalidated rows get the response's status,
    body and merged headers; the others keep their own. Equal dates are not earlier; among
    responses of one date the largest record_id is the latest. Repeated revisits are resolved
    each; of responses that repeat a record_id any one gives the body. Other columns are not read.
    """
    rows = records.select("record_id", "type", canonical_url(F.col("url")).alias("canonical"), "date", "status", "headers")
    matched = latest_earlier(rows)
    lost = rows.where(F.col("type") == REVISIT).where("canonical is null or date is null")
    lost = lost.withColumn("found", F.lit(None).cast(matched.schema["found"].dataType))
    matched = matched.unionByName(lost)
    etag, modified = F.col("headers")["etag"], F.col("headers")["last-modified"]
    agrees = (
        F.when(etag.isNotNull(), F.coalesce(opaque(etag) == opaque(F.col("found.etag")), F.lit(False)))
        .when(modified.isNotNull(), F.coalesce(modified == F.col("found.last_modified"), F.lit(False)))
    )
    outcome = F.when(F.col("found").isNull(), "missing").when(agrees, "resolved").when(~agrees, "changed").otherwise("unvalidated")
    matched = matched.withColumn("outcome", outcome)
    uses = F.when(F.col("outcome").isin("resolved", "unvalidated"), F.col("found.record_id"))
    matched = matched.select("record_id", "canonical", "date", "outcome", F.col("found.record_id").alias("response_id"), uses.alias("uses"), "status", "headers")
    matched = materialise(matched, "revisits")
    using = matched.where("uses is not null")
    used = small_enough(materialise(using.select(F.col("uses").alias("_id")).distinct(), "used-responses"))
    bodies = records.where((F.col("type") == RESPONSE) & (F.col("status") == 200))
    bodies = bodies.select(F.col("record_id").alias("_id"), F.col("status").alias("_status"), F.col("headers").alias("_headers"), "payload")
    bodies = bodies.join(used, "_id", "left_semi").dropDuplicates(["_id"])
    # revisits that use no response, which may be most, take no part in the join
    out = using.join(bodies, F.col("uses") == F.col("_id"), "left")
    out = out.unionByName(matched.where("uses is null"), allowMissingColumns=True)
    new = F.map_filter(F.coalesce("headers", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), lambda k, v: k.isin(MERGED_HEADERS))
    old = F.map_filter("_headers", lambda k, v: ~F.array_contains(F.map_keys(new), k))
    return out.select(
        "record_id", "canonical", "date", "outcome", "response_id",
        F.coalesce("_status", "status").alias("status"),
        F.when(F.col("_id").isNotNull(), F.map_concat(F.coalesce(old, F.map_filter(new, lambda k, v: F.lit(False))), new)).otherwise(F.col("headers")).alias("headers"),
        "payload",
    )


def captures_of_pages(pages: DataFrame) -> DataFrame:
    """Archive records made of ``pages(page_id, url, html)``: each page's response, and a revisit
    of it under another spelling of its URL, some hours earlier or later, with its ETag, with
    another one, with the date only, or with no validator, by turns."""
    day = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page_id") * 60)
    etag = F.concat(F.lit('"'), F.md5("html"), F.lit('"'))
    modified = F.date_format(day, "yyyy-MM-dd HH:mm:ss")
    response = pages.select(
        (F.col("page_id") * 2).alias("record_id"),
        F.lit(RESPONSE).alias("type"),
        "url",
        day.alias("date"),
        F.lit(200).alias("status"),
        F.create_map(
            F.lit("etag"), etag, F.lit("last-modified"), modified, F.lit("content-type"), F.lit("text/html"),
            F.lit("content-length"), F.octet_length("html").cast("string"), F.lit("cache-control"), F.lit("max-age=60"),
        ).alias("headers"),
        F.col("html").alias("payload"),
    )
    turn = F.pmod("page_id", F.lit(5))
    later = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page_id") * 60 + (F.pmod("page_id", F.lit(7)) - 2) * 3600)
    checks = (
        F.when(turn < 2, F.create_map(F.lit("etag"), F.concat(F.lit("W/"), etag), F.lit("cache-control"), F.lit("max-age=90")))
        .when(turn == 2, F.create_map(F.lit("etag"), F.lit('"other"')))
        .when(turn == 3, F.create_map(F.lit("last-modified"), modified, F.lit("content-length"), F.lit("0")))
        .otherwise(F.create_map(F.lit("vary"), F.lit("accept")))
    )
    revisit = pages.select(
        (F.col("page_id") * 2 + 1).alias("record_id"),
        F.lit(REVISIT).alias("type"),
        F.concat("url", F.when(turn == 0, "#again").otherwise("")).alias("url"),
        later.alias("date"),
        F.lit(304).alias("status"),
        checks.alias("headers"),
        F.lit(None).cast("string").alias("payload"),
    )
    return response.unionByName(revisit)


def op9_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resolve_revisits(captures_of_pages(table(spark, sf_dir, "pages")))
    names = ["etag", "last-modified", "content-type", "content-length", "cache-control", "vary"]
    headers = [F.col("headers")[n].alias(n.replace("-", "_")) for n in names]
    body = F.sha2("payload", 256).alias("payload_sha256")
    return out.select("record_id", "canonical", "outcome", "response_id", "status", *headers, body)


ORACLE = r"""
WITH p AS (
  SELECT page_id, url, html, 1700000000 + page_id * 60 AS t, '"' || md5(html) || '"' AS etag,
    regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare
  FROM pages
), q AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_replace(regexp_extract(bare, '^([^/?]*)', 1), '^.*@', '')), ':(80|443)$', ''), '^www\d*\.', '') AS host,
    regexp_extract(regexp_extract(bare, '^[^/?]*(.*)$', 1), '^([^?]*)', 1) AS path,
    regexp_extract(regexp_extract(bare, '^[^/?]*(.*)$', 1), '\?(.*)$', 1) AS query
  FROM p
), c AS (
  SELECT *, host || CASE WHEN path = '' THEN '/' ELSE path END ||
    CASE WHEN query = '' THEN '' ELSE '?' || array_to_string(list_sort(string_split(query, '&')), '&') END AS canonical,
    strftime(make_timestamp(t * 1000000), '%Y-%m-%d %H:%M:%S') AS modified
  FROM q
), r AS (
  SELECT page_id * 2 + 1 AS record_id, canonical, t + ((page_id % 7) - 2) * 3600 AS rt, page_id % 5 AS turn, page_id,
    CASE WHEN page_id % 5 < 2 THEN etag WHEN page_id % 5 = 2 THEN '"other"' END AS r_etag,
    CASE WHEN page_id % 5 = 3 THEN modified END AS r_modified
  FROM c
), m AS (
  SELECT r.*, f.page_id AS f, f.etag AS f_etag, f.modified AS f_modified, f.html,
    row_number() OVER (PARTITION BY r.record_id ORDER BY f.t DESC, f.page_id DESC) AS k
  FROM r LEFT JOIN c f ON f.canonical = r.canonical AND f.t < r.rt
), o AS (
  SELECT *, CASE WHEN f IS NULL THEN 'missing' WHEN turn = 4 THEN 'unvalidated'
    WHEN coalesce(r_etag = f_etag, r_modified = f_modified, false) THEN 'resolved' ELSE 'changed' END AS outcome
  FROM m WHERE k = 1
), u AS (SELECT *, outcome IN ('resolved', 'unvalidated') AS used FROM o)
SELECT record_id, canonical, outcome, f * 2 AS response_id, CAST(CASE WHEN used THEN 200 ELSE 304 END AS INTEGER) AS status,
  CASE WHEN turn < 2 THEN 'W/' || r_etag WHEN turn = 2 THEN r_etag WHEN used THEN f_etag END AS etag,
  CASE WHEN turn = 3 THEN r_modified WHEN used THEN f_modified END AS last_modified,
  CASE WHEN used THEN 'text/html' END AS content_type,
  CASE WHEN used THEN CAST(strlen(html) AS VARCHAR) WHEN turn = 3 THEN '0' END AS content_length,
  CASE WHEN turn < 2 THEN 'max-age=90' WHEN used THEN 'max-age=60' END AS cache_control,
  CASE WHEN turn = 4 THEN 'accept' END AS vary,
  CASE WHEN used THEN sha256(html) END AS payload_sha256
FROM u
"""
