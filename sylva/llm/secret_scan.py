"""Secret scans over a blob ledger. DataFrame functions only.

Every historical version of a path is content-addressed by SHA-256. The ledger lists (blob, rule_version) pairs that are scanned;
only blobs with an unseen pair are scanned, each once, whichever paths hold it. Findings are kept by blob and joined back to all
paths at the end. Blobs are counted by their hashes alone. Those of several rows, or scanned before, fill a blocked Bloom filter; texts that
miss it are single and unseen and are scanned where they are, the others are settled by row numbers, and one row of each unseen blob is
scanned. No rule is evaluated below the filter or that join: the scanned rows carry a row number that the optimiser must not compute
earlier, so it can't move a test of their matches before them either.

Matches of a rule come from two passes of one expression over the text: the pieces between matches, and the matches. Each match is
a row of three numbers (the gap before it, its length, the length that counts); running sums over a text's rows are its code-point
positions, so no position-reporting regex function is needed, and the work grows with the number of matches, not its square. A
length test that a rule has besides its expression is applied to the matches afterwards, because a failing match still uses up its
characters.

Defined results: a null text counts as empty and has no spans; paths may be null or repeat, each row is reported; of spans with
equal start the rule listed first comes first; an empty table gives an empty result; other columns are not carried.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sylva.llm.skew import join_counted
from sylva.llm.url_filter import WORDS, block_of, bloom_blocks, mask_of
from sylva.session import shared_table

#: Kind, expression, group whose length counts, least length. A list of rules is one rule version.
RULES = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
]
RULE_VERSION = "base-1"

BLOBS_A_BLOCK = 16  # of 256 bits

_SPAN = "array<struct<start:bigint,rank:int,kind:string,end:bigint>>"


def matches_of(text: Column, expression: str, group: int, rank: int) -> Column:
    """Matches of one rule in order: rank, i, gap (characters since the match before), n (its characters), m (characters that count)."""
    pattern = F.lit(expression)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    counted = F.regexp_extract_all(text, pattern, F.lit(group)) if group else found
    between = F.slice(F.split(text, expression, -1), 1, F.size(found))
    both = F.zip_with(found, counted, lambda a, b: F.struct(F.length(a).alias("n"), F.length(b).alias("m")))
    numbered = F.transform(both, lambda x, i: F.struct(i.alias("i"), x["n"].alias("n"), x["m"].alias("m")))
    rows = F.zip_with(between, numbered, lambda gap, x: F.struct(F.lit(rank).alias("rank"), x["i"].alias("i"), F.length(gap).alias("gap"), x["n"].alias("n"), x["m"].alias("m")))
    # rlike stops at the first match, so texts without any are read once
    return F.when(text.rlike(expression), rows).otherwise(F.expr("cast(array() as array<struct<rank:int,i:int,gap:int,n:int,m:int>>)"))


def spans_by_blob(texts: DataFrame, rules: list) -> DataFrame:
    """blob, spans (by start, then rule) of the texts (blob, text) with any. Rows of one blob count once."""
    found = texts.select("blob", F.monotonically_increasing_id().alias("row"), F.concat(*[matches_of(F.col("text"), e, g, i) for i, (_, e, g, _) in enumerate(rules)]).alias("found"))
    each = found.select("blob", "row", F.explode_outer("found").alias("x")).where("x is not null").select("blob", "row", "x.*").repartition("blob")
    upto = Window.partitionBy("blob", "row", "rank").orderBy("i")
    placed = each.withColumn("end", F.sum(F.col("gap").cast("long") + F.col("n")).over(upto))
    rule = F.element_at(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(least).alias("least")) for k, _, _, least in rules]), F.col("rank") + 1)
    span = F.struct((F.col("end") - F.col("n")).alias("start"), "rank", rule["kind"].alias("kind"), "end")
    by_row = placed.where(F.col("m") >= rule["least"]).groupBy("blob", "row").agg(F.array_sort(F.collect_list(span)).cast(_SPAN).alias("spans"))
    return by_row.groupBy("blob").agg(F.first("spans").alias("spans"))


def parted(texts: DataFrame, counted: DataFrame, seen: DataFrame | None, max_filter_bytes: int) -> tuple[DataFrame, DataFrame]:
    """texts (blob, text) of blobs that are single and unseen for certain, which stay where they are, and the others.

    Blobs of several rows (counted: blob, size) or in seen (blob) fill a blocked Bloom filter that is broadcast. Its size grows with
    their number up to ``max_filter_bytes``; beyond that more single blobs pass as possible, which costs moving them and changes no result.
    """
    apart = counted.where("size > 1").select("blob")
    if seen is not None:
        apart = apart.union(counted.where("size = 1").join(seen, "blob", "left_semi").select("blob"))
    h = F.xxhash64("blob")
    apart = shared_table(apart.select(h.alias("h")), "apart")
    blocks = max(1, min(apart.count() // BLOBS_A_BLOCK + 1, max_filter_bytes // (8 * (WORDS + 1))))
    filter_ = shared_table(bloom_blocks(apart, blocks), "filter")
    probed = texts.withColumn("h", h).withColumn("block", block_of(F.col("h"), blocks)).join(F.broadcast(filter_), "block", "left")
    hit = reduce(Column.__and__, [F.coalesce(F.col(f"w{w}"), F.lit(0).cast("long")).bitwiseAND(mask_of(F.col("h"), w)) == mask_of(F.col("h"), w) for w in range(WORDS)])
    return probed.where(~hit).select("blob", "text"), probed.where(hit).select("blob", "text")


def scan(versions: DataFrame, path_col: str = "doc_id", text_col: str = "text", rules: list = RULES, rule_version: str = RULE_VERSION, ledger: DataFrame | None = None, known: DataFrame | None = None, max_filter_bytes: int = 32 << 20) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(report, findings, ledger): spans of every row of versions; findings by blob; the ledger with this run's pairs.

    ledger: blob, rule_version of earlier runs. known: the findings of those runs (blob, rule_version, spans).
    """
    texts = versions.select(F.col(path_col).alias("path"), F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).alias("blob"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    paths = shared_table(texts.select("path", "blob"), "paths")
    counted = shared_table(paths.groupBy("blob").agg(F.count(F.lit(1)).alias("size")), "blobs")
    unseen, seen = counted, None
    if ledger is not None:
        seen = ledger.where(F.col("rule_version") == rule_version).select("blob").distinct()
        unseen = counted.join(seen, "blob", "left_anti")
    alone, others = parted(texts.where("text != ''").select("blob", "text"), counted, seen, max_filter_bytes)
    # One row of each unseen blob is read: row numbers are unique, so copies of one blob don't meet in one task.
    others = shared_table(others.withColumn("row", F.monotonically_increasing_id()), "possible")
    first = others.groupBy("blob").agg(F.min("row").alias("row"))
    first = shared_table((first if seen is None else first.join(seen, "blob", "left_anti")).select("row"), "first")
    chosen = alone.unionByName(others.join(first, "row").select("blob", "text"))
    found = spans_by_blob(chosen, rules).withColumn("rule_version", F.lit(rule_version))
    if known is not None:
        found = found.unionByName(known.where(F.col("rule_version") == rule_version))
    found = shared_table(found.select("blob", "rule_version", "spans"), "findings")
    pairs = unseen.select("blob", F.lit(rule_version).alias("rule_version"))
    sized = shared_table(found.select("blob", "spans").join(counted.select("blob", "size"), "blob"), "sized")
    report = join_counted(paths, sized, ["blob"], "size", paths.count(), how="left").select("path", "blob", F.coalesce("spans", F.expr(f"cast(array() as {_SPAN})")).alias("spans"))
    return report, found, pairs if ledger is None else ledger.select("blob", "rule_version").unionByName(pairs)


def digest(report: DataFrame, rules: list = RULES) -> DataFrame:
    """Per path: doc_id, a count of each kind, base_sha256, spans."""
    joined = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k, *_ in rules]
    return report.select(F.col("path").alias("doc_id"), *counts, F.sha2(joined, 256).alias("base_sha256"), joined.alias("spans"))


ORACLE = r"""
WITH RECURSIVE rules(kind, rank, e, g, least) AS (VALUES
  ('assign', 0, '(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1, 6),
  ('access', 1, '(AKIA[A-Z0-9]{16,})', 1, 20),
  ('hex', 2, '([0-9a-f]{24,})', 1, 24)),
d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
a AS (SELECT k, text, kind, rank, least, regexp_extract_all(text, e, 0) AS w, regexp_extract_all(text, e, g) AS v FROM d, rules),
s AS (SELECT k, kind, rank, least, w, v, 1 AS i, text AS rest, 0::BIGINT AS off, NULL::BIGINT AS st, NULL::BIGINT AS en, NULL::BOOLEAN AS ok FROM a WHERE len(w) > 0
      UNION ALL
      SELECT k, kind, rank, least, w, v, i + 1, substr(rest, strpos(rest, w[i]) + length(w[i])), off + strpos(rest, w[i]) - 1 + length(w[i]),
             off + strpos(rest, w[i]) - 1, off + strpos(rest, w[i]) - 1 + length(w[i]), length(v[i]) >= least FROM s WHERE i <= len(w)),
t AS (SELECT k, string_agg(kind || ':' || st || ':' || en, ',' ORDER BY st, rank) AS spans, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS b, count(*) FILTER (kind = 'hex') AS c
      FROM s WHERE ok GROUP BY k)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN t USING (k)
"""
