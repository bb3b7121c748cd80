"""Chat formatting of preference pairs. DataFrame functions only.

A pair holds a chosen and a rejected conversation. Their longest common turn prefix (equal roles and texts, position by position) is
rendered once as the prompt; what follows it on either side is rendered as that side's completion, with a loss mask that covers the
texts and end marks of the assistant's turns.

Conversations are collected as arrays of turns, so a task holds a pair's turns, never more; pairs are as many as the data has.

Defined results: null roles and texts count as empty; turns are ordered by number (nulls first), then role and text, and turns with
equal numbers all stay; a side that is missing gives a null completion and mask, and the other side has no common prefix with it;
equal sides give empty completions; rows without a pair or a side are left out; an empty table gives an empty result; other columns
are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(CLOSE), t["text"], F.lit(END))), "")


def _mask(turns: Column, role: str) -> Column:
    """start:end of what counts for the loss in the rendered turns, in code points, comma-joined."""

    def step(acc: Column, t: Column) -> Column:
        start = acc["at"] + len(OPEN) + len(CLOSE) + F.length(t["role"])
        end = start + F.length(t["text"]) + len(END)
        return F.struct(end.alias("at"), F.when(t["role"] == role, F.concat(acc["out"], F.array(F.concat_ws(":", start, end)))).otherwise(acc["out"]).alias("out"))

    none = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out"))
    return F.array_join(F.aggregate(turns, none, step, lambda acc: acc["out"]), ",")


def format_pairs(turns: DataFrame, pair_col: str = "pair_id", side_col: str = "side", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", learner: str = "assistant") -> DataFrame:
    """One row a pair: pair_id, n_common, prompt, chosen, chosen_mask, rejected, rejected_mask. side: 'chosen' or 'rejected'."""
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = turns.select(F.col(pair_col).alias("pair_id"), F.col(side_col).alias("side"), turn.alias("t")).where("pair_id is not null and side in ('chosen', 'rejected')")
    sides = rows.groupBy("pair_id").agg(*[F.sort_array(F.collect_list(F.when(F.col("side") == s, F.col("t")))).alias(s) for s in ("chosen", "rejected")])
    same = F.zip_with("chosen", "rejected", lambda a, b: a["role"].eqNullSafe(b["role"]) & a["text"].eqNullSafe(b["text"]))
    first = F.struct(F.lit(0).alias("n"), F.lit(True).alias("on"))
    common = F.aggregate(same, first, lambda acc, x: F.struct((acc["n"] + F.when(acc["on"] & x, 1).otherwise(0)).alias("n"), (acc["on"] & x).alias("on")), lambda acc: acc["n"])
    out = sides.withColumn("n_common", common)
    rest = {s: F.slice(F.col(s), F.col("n_common") + 1, F.greatest(F.size(s) - F.col("n_common"), F.lit(0))) for s in ("chosen", "rejected")}
    there = {s: F.size(s) > 0 for s in rest}
    return out.select(
        "pair_id",
        F.col("n_common").cast("long").alias("n_common"),
        _render(F.slice("chosen", F.lit(1), F.col("n_common"))).alias("prompt"),
        *[c for s, turns_ in rest.items() for c in (F.when(there[s], _render(turns_)).alias(s), F.when(there[s], _mask(turns_, learner)).alias(f"{s}_mask"))],
    )


def neighbours_as_pairs(conversations: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Turns of conversations, numbered from 0, as pairs: conversation 2k is chosen over 2k + 1."""
    return conversations.withColumns({"pair_id": F.floor(F.col(conv_col) / 2), "side": F.when(F.pmod(F.col(conv_col), F.lit(2)) == 0, "chosen").when(F.col(conv_col).isNotNull(), "rejected")})


ORACLE = r"""
WITH t AS (SELECT conv_id // 2 AS pair_id, conv_id % 2 AS side, coalesce(role, '') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, min(coalesce(a.i, b.i)) FILTER (a.i IS NULL OR b.i IS NULL OR a.role <> b.role OR a.text <> b.text) AS f, max(coalesce(a.i, b.i)) AS m
      FROM (FROM t WHERE side = 0) a FULL JOIN (FROM t WHERE side = 1) b ON a.pair_id = b.pair_id AND a.i = b.i GROUP BY 1),
n AS (SELECT pair_id, coalesce(f - 1, m) AS n_common FROM c),
r AS (SELECT t.*, n_common, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS line FROM t JOIN n USING (pair_id)),
o AS (SELECT *, sum(length(line)) OVER (PARTITION BY pair_id, side, i <= n_common ORDER BY i) AS en FROM r),
s AS (SELECT pair_id, side, string_agg(line, '' ORDER BY i) FILTER (i <= n_common) AS prompt, string_agg(line, '' ORDER BY i) FILTER (i > n_common) AS done,
             string_agg((en - length(text) - 8)::BIGINT || ':' || en::BIGINT, ',' ORDER BY i) FILTER (i > n_common AND role = 'assistant') AS mask FROM o GROUP BY 1, 2)
SELECT n.pair_id, n_common::BIGINT AS n_common, coalesce(a.prompt, '') AS prompt, CASE WHEN a.pair_id IS NOT NULL THEN coalesce(a.done, '') END AS chosen, CASE WHEN a.pair_id IS NOT NULL THEN coalesce(a.mask, '') END AS chosen_mask,
       CASE WHEN b.pair_id IS NOT NULL THEN coalesce(b.done, '') END AS rejected, CASE WHEN b.pair_id IS NOT NULL THEN coalesce(b.mask, '') END AS rejected_mask
FROM n LEFT JOIN (FROM s WHERE side = 0) a ON n.pair_id = a.pair_id LEFT JOIN (FROM s WHERE side = 1) b ON n.pair_id = b.pair_id
"""
