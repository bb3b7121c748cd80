"""Not-modified revisit resolution: an as-of join by canonical URL to the latest earlier full response.

Every revisit (status 304) looks for the latest full response (status 200) with an earlier time of the same canonical URL. Its validators are checked:
entity tags by weak comparison, else Last-Modified dates; a revisit without validators is taken as it is. A resolved revisit gets the
response's payload digest and its headers, into which the headers of the 304 are merged that it may update; those that describe the
payload or the connection stay as they were.

The as-of join splits every URL's history into time buckets: within a bucket a window finds the latest response, and each bucket
gets the latest response of the buckets before it from an aggregation of one row a bucket. A URL with very many captures is so spread over
many tasks. Payloads don't move; digests stand for them.

Defined results: a null URL matches nothing (status 'no_response'); of responses with equal times the largest id wins; records with
a null time or another status are left out; repeated revisits are all resolved; an empty table gives an empty result; other columns
are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Header fields that a 304 must not change in a stored response.
KEPT = ("connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "set-cookie", "te", "trailer", "transfer-encoding", "upgrade")
#: Query parameters that say where a visitor came from.
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid)(=|$)"


def canonical_url(url: Column) -> Column:
    """Scheme, user, default port, leading www., fragment, trailing slash and tracking parameters go; parameters are sorted."""
    bare = F.regexp_replace(url, r"(?s)#.*$", "")
    rest = F.regexp_replace(bare, r"(?s)^[^/?]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, r"(?s)^([^/?]*)", 1)), r"^.*@|^www\.|:(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"(?s)^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.array_sort(F.filter(F.split(F.regexp_extract(rest, r"(?s)^[^?]*\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise(""))


def _tag(t: Column) -> Column:
    return F.regexp_replace(t, "^W/", "")


def resolve(records: DataFrame, bucket_width: int = 4096) -> DataFrame:
    """records: record_id, url, ts (bigint), status (int), headers (map of lower-case names), payload_sha256.

    One row a revisit: record_id, ts, canonical_url, response_id, outcome ('resolved', 'mismatch', 'no_response'), payload_sha256, headers.
    """
    base = records.select("record_id", F.col("ts").cast("long").alias("ts"), "status", "headers", "payload_sha256", canonical_url(F.col("url")).alias("canonical_url")).where("ts is not null and status in (200, 304)")
    base = base.withColumn("bucket", F.floor(F.col("ts") / bucket_width))
    held = F.when(F.col("status") == 200, F.struct("record_id", "headers", "payload_sha256"))
    order = F.when(F.col("status") == 200, F.struct("ts", "record_id"))
    base = base.withColumns({"full": held, "at": order})
    within = Window.partitionBy("canonical_url", "bucket").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    inside = base.where("canonical_url is not null").withColumn("inside", F.max_by("full", "at").over(within)).where("status = 304")
    last = base.where("status = 200 and canonical_url is not null").groupBy("canonical_url", "bucket").agg(F.max_by("full", "at").alias("full"), F.max("at").alias("at"))
    # a row for each bucket that has a revisit or a response: the latest response of the buckets before
    spine = base.where("canonical_url is not null").select("canonical_url", "bucket").distinct().join(last, ["canonical_url", "bucket"], "left")
    earlier = Window.partitionBy("canonical_url").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = spine.select("canonical_url", "bucket", F.max_by("full", "at").over(earlier).alias("before"))
    found = inside.join(before, ["canonical_url", "bucket"], "left").withColumn("full", F.coalesce("inside", "before")).drop("inside", "before")
    found = found.unionByName(base.where("canonical_url is null and status = 304").withColumn("full", F.lit(None).cast(base.schema["full"].dataType)), allowMissingColumns=True)

    mine, theirs = F.col("headers"), F.col("full.headers")
    etag, modified = mine["etag"], mine["last-modified"]
    fits = F.when(etag.isNotNull(), F.coalesce(_tag(etag) == _tag(theirs["etag"]), F.lit(False))).when(modified.isNotNull(), F.coalesce(modified == theirs["last-modified"], F.lit(False))).otherwise(True)
    outcome = F.when(F.col("full").isNull(), "no_response").when(fits, "resolved").otherwise("mismatch")
    permitted = F.map_filter(mine, lambda k, v: ~k.isin(*KEPT) & v.isNotNull())
    merged = F.map_concat(F.map_filter(theirs, lambda k, v: ~F.array_contains(F.map_keys(permitted), k)), permitted)
    return found.withColumn("outcome", outcome).select("record_id", "ts", "canonical_url", F.when(F.col("outcome") != "no_response", F.col("full.record_id")).alias("response_id"), "outcome", F.when(F.col("outcome") == "resolved", F.col("full.payload_sha256")).alias("payload_sha256"), F.when(F.col("outcome") == "resolved", merged).alias("headers"))


def captures(pages: DataFrame, lag: int = 64) -> DataFrame:
    """Every page as two WARC records: its full response at time 2 * page_id, and a revisit 2 * lag + 1 later that names its entity tag."""
    sha = F.sha2(F.coalesce("html", F.lit("")), 256)
    tag = F.substring(sha, 1, 16)
    base = pages.select("page_id", "url", sha.alias("payload_sha256"), tag.alias("tag"), F.length(F.coalesce("html", F.lit(""))).cast("string").alias("n"))
    day = F.col("page_id").cast("string")
    pair = lambda *kv: F.map_from_arrays(F.array(*[F.lit(k) for k in kv[::2]]), F.array(*kv[1::2]))
    full = F.struct((F.col("page_id") * 2).alias("ts"), F.lit(200).alias("status"), pair("etag", F.col("tag"), "date", F.concat(F.lit("day "), day), "content-length", F.col("n"), "server", F.lit("origin")).alias("headers"), "payload_sha256")
    again = F.struct((F.col("page_id") * 2 + 2 * lag + 1).alias("ts"), F.lit(304).alias("status"), pair("etag", F.concat(F.lit("W/"), F.col("tag")), "date", F.concat(F.lit("again "), day), "content-length", F.lit("0"), "age", day).alias("headers"), F.lit(None).cast("string").alias("payload_sha256"))
    return base.select(F.col("page_id").alias("record_id"), "url", F.explode(F.array(full, again)).alias("r")).select("record_id", "url", "r.*")


def digest(resolved: DataFrame) -> DataFrame:
    """resolved with its headers as text: name: value, sorted, joined by newlines."""
    lines = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat_ws(": ", e["key"], e["value"]))), "\n")
    return resolved.withColumn("headers", lines)


ORACLE = r"""
WITH u AS (SELECT page_id, sha256(coalesce(html, '')) AS sha, length(coalesce(html, '')) AS n, regexp_replace(regexp_replace(url, '(?s)#.*$', ''), '(?s)^[^/?]*://', '') AS rest FROM pages WHERE page_id IS NOT NULL),
q AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(rest, '(?s)^([^/?]*)', 1)), '^.*@', ''), '^www\.', ''), ':(80|443)$', '') AS host, regexp_replace(regexp_extract(rest, '(?s)^[^/?]*([^?]*)', 1), '/+$', '') AS path,
             list_sort(list_filter(string_split(regexp_extract(rest, '(?s)^[^?]*\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)'))) AS params FROM u),
k AS (SELECT page_id, sha, n, host || path || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS c FROM q),
f AS (SELECT DISTINCT ON (c, ts) c, 2 * page_id AS ts, page_id, sha, n FROM k ORDER BY c, ts, page_id DESC),
r AS (SELECT k.page_id, 2 * k.page_id + 129 AS ts, k.c, k.sha, f.page_id AS id, f.sha AS fsha, f.n FROM k ASOF LEFT JOIN f ON k.c = f.c AND 2 * k.page_id + 129 > f.ts)
SELECT page_id AS record_id, ts, c AS canonical_url, id AS response_id, CASE WHEN id IS NULL THEN 'no_response' WHEN left(sha, 16) = left(fsha, 16) THEN 'resolved' ELSE 'mismatch' END AS outcome,
       CASE WHEN left(sha, 16) = left(fsha, 16) THEN fsha END AS payload_sha256,
       CASE WHEN left(sha, 16) = left(fsha, 16) THEN 'age: ' || page_id || chr(10) || 'content-length: ' || n || chr(10) || 'date: again ' || page_id || chr(10) || 'etag: W/' || left(sha, 16) || chr(10) || 'server: origin' END AS headers
FROM r
"""
