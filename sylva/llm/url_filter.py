"""URL filters: a blocked Bloom filter in front of an exact hash join. DataFrame functions only.

A rule names a host and a path prefix. It fits a URL if the URL's host is the rule's or a subdomain of it and the URL's path starts
with the rule's. The canonical keys that a rule could have are, for a URL, each suffix of the host at a label border with each prefix
of the path whose length some rule has. They probe a blocked Bloom filter: a hash picks one block of 256 bits, which holds all bits
of a key. URLs none of whose keys passes stay where they are and take the default verdict; only the others move, once for each
distinct (host, path), to an exact hash join with the rules, which removes the filter's false positives; the longest rule wins.

The filter is one constant array of longs if it takes at most ``max_inline_bytes``. That of a longer list is a table, which the keys
of the distinct URLs join by block; it is broadcast up to ``max_broadcast_bytes``.

Defined results: a null URL or one without ``://`` has an empty host and path; no rule fits it and its verdict is the default; of
rules of equal length the block rule wins; equal rules count once; rules with a null host, path or verdict count for nothing;
repeated rows are all kept; an empty table gives an empty result; other columns of the table are not carried.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylva.llm.skew import join_counted
from sylva.session import shared_table

WORDS, PROBES = 4, 4  # longs in a block; bits of a key
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _key_hash(host: Column, path: Column) -> Column:
    return F.xxhash64(host, path)


def block_of(h: Column, blocks: int) -> Column:
    return F.pmod(F.shiftrightunsigned(h, 32), F.lit(blocks).cast("long"))


def mask_of(h: Column, w: int) -> Column:
    """The bits of a key's hash h that fall into word w of its block; the low half of h, which does not choose the block, gives them."""
    out = F.lit(0).cast("long")
    for i in range(PROBES):
        byte = F.pmod(F.shiftrightunsigned(h, 8 * i), F.lit(256).cast("long"))
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(byte, F.lit(64)).cast("int"))
        out = out.bitwiseOR(F.when(F.floor(byte / 64) == w, bit).otherwise(F.lit(0).cast("long")))
    return out


def bloom_blocks(keys: DataFrame, blocks: int) -> DataFrame:
    """The filter as rows (block, w0..w3); keys has a bigint column h."""
    out = keys.select(block_of(F.col("h"), blocks).alias("block"), *[mask_of(F.col("h"), w).alias(f"w{w}") for w in range(WORDS)])
    return out.groupBy("block").agg(*[F.bit_or(f"w{w}").alias(f"w{w}") for w in range(WORDS)])


def bloom_array(filter_: DataFrame, blocks: int) -> Column:
    """The filter's words, block by block, as a constant."""
    words = [0] * (blocks * WORDS)
    for row in filter_.collect():  # at most max_inline_bytes
        words[row.block * WORDS : (row.block + 1) * WORDS] = row[1:]
    return F.from_json(F.lit(json.dumps(words)), "array<bigint>")


def judge(
    pages: DataFrame,
    rules: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
    bits_per_key: int = 16,
    max_inline_bytes: int = 256 << 10,
    max_broadcast_bytes: int = 32 << 20,
) -> DataFrame:
    """For every row of pages: page_id, host, path, rule, verdict. rules: host, path, verdict ('allow' or 'block')."""
    rules = rules.select("host", "path", "verdict").where("host is not null and path is not null and verdict is not null").distinct()
    n, lengths = rules.agg(F.count(F.lit(1)), F.collect_set(F.length("path"))).first()  # at most as many lengths as a URL has characters
    urls = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    named = {"rule": F.lit(None).cast("string"), "verdict": F.lit(default)}
    if not n:
        return urls.withColumns(named)
    blocks = max(1, -(-n * bits_per_key // (64 * WORDS)))
    filter_ = bloom_blocks(rules.select(_key_hash(F.col("host"), F.col("path")).alias("h")), blocks)

    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.transform(F.filter(F.array(*[F.lit(x) for x in sorted(lengths)]), lambda x: x <= F.length("path")), lambda x: F.substring(F.col("path"), F.lit(1), x))
    keyed = lambda df: df.withColumn("key_host", F.explode(suffixes)).withColumn("key_path", F.explode(prefixes))
    straight = None
    if blocks * 8 * WORDS <= max_inline_bytes:
        words = bloom_array(filter_, blocks)
        in_block = lambda h, w: F.element_at(words, (block_of(h, blocks) * WORDS + w + 1).cast("int")).bitwiseAND(mask_of(h, w)) == mask_of(h, w)
        hashes = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: _key_hash(s, p))))
        passes = (F.col("host") != "") & F.exists(hashes, lambda h: reduce(Column.__and__, [in_block(h, w) for w in range(WORDS)]))
        straight = urls.where(~passes).withColumns(named)
        urls = shared_table(urls.where(passes), "possible")
    distinct = urls.where("host != ''").groupBy("host", "path").agg(F.count(F.lit(1)).alias("size"))
    keys = keyed(distinct)
    if straight is None:
        keys = keys.withColumn("h", _key_hash(F.col("key_host"), F.col("key_path"))).withColumn("block", block_of(F.col("h"), blocks))
        fits = [F.col(f"w{w}").bitwiseAND(mask_of(F.col("h"), w)) == mask_of(F.col("h"), w) for w in range(WORDS)]
        small = blocks * 8 * (WORDS + 1) <= max_broadcast_bytes
        keys = keys.join(F.broadcast(filter_) if small else filter_, "block").where(reduce(Column.__and__, fits))
    exact = keys.join(rules.withColumnsRenamed({"host": "key_host", "path": "key_path"}), ["key_host", "key_path"])
    rank = F.struct(F.length("key_host") + F.length("key_path"), F.col("verdict") == "block", "key_host", "key_path")
    best = exact.withColumn("rule", F.concat("key_host", "key_path")).groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), rank).alias("best"), F.first("size").alias("size"))
    joined = join_counted(urls, shared_table(best, "judged"), ["host", "path"], "size", urls.count(), how="left")
    judged = joined.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
    return judged if straight is None else straight.unionByName(judged)


#: The production list as (host, path, verdict).
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

ORACLE = r"""
WITH r(rule, h, p, verdict) AS (VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'), ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
u AS (SELECT row_number() OVER () AS k, page_id,
             translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
m AS (SELECT u.*, r.rule, r.verdict, row_number() OVER (PARTITION BY k ORDER BY length(r.rule) DESC) AS n
      FROM u LEFT JOIN r ON (u.host = r.h OR ends_with(u.host, '.' || r.h)) AND starts_with(u.path, r.p))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE n = 1
"""
