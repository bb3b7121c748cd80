"""Text edits (file_id, rule, start, end, insert) over byte ranges: disjointness, conflicts, application, offsets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sylva.operators.spans import running


def overlapping(edits: DataFrame, neighbours_only: bool = False) -> DataFrame:
    """edits with ``clash``: whether an edit starts before one ahead of it, by (start, end, rule), has ended.

    neighbours_only compares with the directly preceding edit alone, which misses what a wide one covers further on.
    """
    order = Window.partitionBy("file_id").orderBy("start", "end", "rule", "insert")
    ends = F.lag("end").over(order) if neighbours_only else F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return edits.withColumn("clash", F.coalesce(ends > F.col("start"), F.lit(False)))


def without_conflicts(edits: DataFrame) -> DataFrame:
    """Every edit of a rule that clashes in a file is left out there."""
    edits = edits.distinct()
    clashing = overlapping(edits).where("clash").select("file_id", "rule").distinct()
    return edits.join(clashing, ["file_id", "rule"], "left_anti")


def union_disjoint(*edits: DataFrame) -> DataFrame:
    """All edits (file_id, rule, start, end, insert) of several tables; running it fails where two of them overlap, naming the file, both spans and rules.

    Equal edits are one. The check is a running maximum within the plan, so nothing is collected for it.
    """
    both = reduce(DataFrame.unionByName, [e.select("file_id", "rule", "start", "end", "insert") for e in edits]).distinct()
    order = Window.partitionBy("file_id").orderBy("start", "end", "rule", "insert").rowsBetween(Window.unboundedPreceding, -1)
    furthest = F.max(F.struct("end", "start", "rule")).over(order)
    said = F.format_string("file %s: the edit of %s at %s..%s overlaps that of %s at %s..%s", *[F.col(c).cast("string") for c in ("file_id", "rule", "start", "end", "_f.rule", "_f.start", "_f.end")])
    checked = F.when(F.col("_f.end") > F.col("start"), F.raise_error(said).cast("int")).otherwise(F.col("start"))
    return both.withColumn("_f", furthest).withColumn("start", checked.cast(both.schema["start"].dataType)).select(both.columns)


def apply_edits(files: DataFrame, edits: DataFrame) -> DataFrame:
    """files (file_id, source, …) with their edits applied: source is the new text; files without edits stay out.

    The new text is put together once, of what lies between the edits and what they insert.
    """
    sorted_ = edits.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "insert"))).alias("_e"))
    joined = files.join(sorted_, "file_id").withColumn("_b", F.col("source").cast("binary"))
    gap = "substring(_b, coalesce(get(_e, i - 1).end, 0) + 1, greatest(e.start - coalesce(get(_e, i - 1).end, 0), 0))"
    parts = F.expr(f"transform(_e, (e, i) -> concat(cast({gap} as string), e.insert))")
    rest = F.expr("cast(substring(_b, element_at(_e, -1).end + 1, greatest(octet_length(_b) - element_at(_e, -1).end, 0)) as string)")
    return joined.withColumn("source", F.concat(F.array_join(parts, ""), rest)).drop("_e", "_b")


def map_offsets(offsets: DataFrame, edits: DataFrame, width: int | None = None) -> DataFrame:
    """offsets (file_id, offset, …) with ``mapped``: where the byte is after the edits, null inside a deletion.

    One sort of the ends of edits, offsets and starts of edits: what the edits that end by then add is a running sum, and an offset lies
    inside an edit if the furthest end of those begun before it is beyond it.
    """
    side = F.struct(*[F.col(f"`{c}`") for c in offsets.columns])
    kind = offsets.select(side.alias("_row")).schema["_row"].dataType
    grown = F.octet_length("insert").cast("long") - (F.col("end") - F.col("start"))
    none = F.lit(None)
    event = lambda df, at, order, grown, end, row: df.select("file_id", at.cast("long").alias("_at"), F.lit(order).alias("_order"), grown.cast("long").alias("_grown"), end.cast("long").alias("_end"), row.cast(kind).alias("_row"))
    ends = event(edits, F.col("end"), 0, grown, none, none)
    here = event(offsets, F.col("offset"), 1, none, none, side)
    starts = event(edits, F.col("start"), 2, none, F.col("end"), none)
    passed = running(ends.unionByName(here).unionByName(starts), ["file_id"], ["_at", "_order"], {"_moved": ("sum", F.col("_grown")), "_far": ("max", F.col("_end"))}, width)
    mapped = F.when(~F.coalesce(F.col("_far") > F.col("_at"), F.lit(False)), F.col("_at") + F.coalesce("_moved", F.lit(0)))
    return passed.where("_order = 1").select("_row.*", mapped.alias("mapped"))


def moved(spans: DataFrame, edits: DataFrame) -> DataFrame:
    """Rows with a file_id, start and end, such as findings, where they are after the edits; those that an edit cuts into are left out. Equal rows count once."""
    span = F.struct(*[F.col(f"`{c}`") for c in spans.columns])
    sides = F.explode(F.array(*[F.struct(F.col(c).alias("offset"), F.lit(c).alias("side")) for c in ("start", "end")]))
    at = map_offsets(spans.select("file_id", span.alias("_span"), sides.alias("_x")).select("file_id", "_span", "_x.*"), edits)
    both = at.groupBy("_span").agg(*[F.max(F.when(F.col("side") == c, F.col("mapped"))).alias(f"_{c}") for c in ("start", "end")])
    whole = both.where("_start is not null and _end is not null and _end - _start = _span.end - _span.start")
    return whole.select("_span.*", "_start", "_end").withColumns({c: F.col(f"_{c}").cast(spans.schema[c].dataType) for c in ("start", "end")}).drop("_start", "_end")


# Builders: arrays of (start, end, insert) for a rule's fixes column.


def _one(start: Column, end: Column, insert: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), insert.alias("insert"))


def replace(start: Column, end: Column, text: Column) -> Column:
    return F.array(_one(start, end, text))


def insert(at: Column, text: Column) -> Column:
    return F.array(_one(at, at, text))


def delete(start: Column, end: Column) -> Column:
    return F.array(_one(start, end, F.lit("")))


def wrap(start: Column, end: Column, before: str = "(", after: str = ")") -> Column:
    return F.array(_one(start, start, F.lit(before)), _one(end, end, F.lit(after)))


def unwrap(start: Column, end: Column, inner_start: Column, inner_end: Column) -> Column:
    """Deletes what surrounds an inner range."""
    return F.array(_one(start, inner_start, F.lit("")), _one(inner_end, end, F.lit("")))


def unless_commented(fixes: Column, has_comment: Column) -> Column:
    """No fixes where they would drop a comment."""
    return F.when(has_comment, F.array().cast("array<struct<start:int,end:int,insert:string>>")).otherwise(fixes)


def disjoint(edits: DataFrame) -> DataFrame:
    """file_id, disjoint: whether no edit of a file overlaps another."""
    return overlapping(edits).groupBy("file_id").agg((F.count_if("clash") == 0).alias("disjoint"))


def eating_whitespace(edits: DataFrame, tokens: DataFrame, before: bool = True, after: bool = True) -> DataFrame:
    """edits whose ranges also take the white space token that ends where they start, or starts where they end."""
    blanks = tokens.where("kind = 'WHITESPACE'")
    out = edits
    if before:
        left = blanks.select("file_id", F.col("start").alias("_s"), F.col("end").alias("start"))
        out = out.join(left, ["file_id", "start"], "left").withColumn("start", F.coalesce("_s", "start")).drop("_s")
    if after:
        right = blanks.select("file_id", F.col("start").alias("end"), F.col("end").alias("_e"))
        out = out.join(right, ["file_id", "end"], "left").withColumn("end", F.coalesce("_e", "end")).drop("_e")
    return out.select(*edits.columns)
