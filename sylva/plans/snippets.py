"""The long report: every diagnostic with the source lines that its labels begin and end in, marked.

    error[no-await-in-loop]: this await runs anew in each round of a loop
      --> a.mjs:2:3
    1 | / for (const a of b) {
    2 | |   await a;
      | |   ^^^^^^^
    3 | | }
      | \\__- each round of this loop waits for the one before
      = note: collect the promises and await all of them together

The diagnostic's own span is marked with ^, other labels with -. Labels within a line share a row of marks where they leave each other
room, else they take further rows; labels over several lines run down a rail each at the left. Rows and rails are tracks of
:func:`sylva.operators.spans.tracks`, the lowest that is free. Lines in between that no label begins or ends in are left out (``...``).
Of a line of more than ``WIDE`` characters the part around its first mark is shown, so what is written of a diagnostic grows with its labels only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sylva.operators.spans import as_of, inside, tracks
from sylva.session import shared_table

WIDE, BEFORE = 240, 40  # characters of a line that are shown, and of those how many stand before its first mark if it is cut
KEY = ["file_id", "_d"]


def source_lines(files: DataFrame) -> DataFrame:
    """file_id, line (from 0), start (its byte), text."""
    pieces = files.select("file_id", F.posexplode(F.split(F.coalesce("source", F.lit("")), "\n", -1)).alias("line", "text"))
    before = Window.partitionBy("file_id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    return pieces.withColumn("start", F.coalesce(F.sum(F.octet_length("text").cast("long") + 1).over(before), F.lit(0)).cast("long"))


def labels_of(diagnostics: DataFrame) -> DataFrame:
    """A row a label of each diagnostic: file_id, _d (a number of the diagnostic), n (0: its own span), start, end, text."""
    more = F.col("labels") if "labels" in diagnostics.columns else F.expr("cast(array() as array<struct<start:int,end:int,text:string>>)")
    own = F.array(F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.coalesce("label", F.lit("")).alias("text")))
    return diagnostics.select(*KEY, F.posexplode(F.concat(own, F.coalesce(more, F.array().cast("array<struct<start:int,end:int,text:string>>")))).alias("n", "l")).select(*KEY, "n", "l.*")


def _chars(text: Column, n: Column) -> Column:
    """How many characters the first n bytes of a text are."""
    return F.length(F.substring(text.cast("binary"), F.lit(1), F.greatest(n, F.lit(0)).cast("int")).cast("string"))


def _placed(labels: DataFrame, lines: DataFrame) -> DataFrame:
    """labels with line and col (in characters) of their first character, to_line and to_col after their last."""
    marks = lines.select("file_id", F.col("start").alias("_at"), F.struct("line", "start", "text").alias("_mark"))
    both = as_of(labels.withColumn("_last", F.greatest(F.col("end") - 1, F.col("start"))), marks, ["file_id"], "start", "_a")
    both = as_of(both, marks, ["file_id"], "_last", "_b")
    to = _chars(F.col("_b.text"), F.col("end") - F.col("_b.start"))
    out = both.withColumns({"line": F.col("_a.line"), "col": _chars(F.col("_a.text"), F.col("start") - F.col("_a.start")), "to_line": F.col("_b.line"), "to_col": to})
    return out.withColumn("to_col", F.when(F.col("line") == F.col("to_line"), F.greatest(F.col("to_col"), F.col("col") + 1)).otherwise(F.col("to_col"))).drop("_a", "_b", "_last")


def _sign() -> Column:
    return F.when(F.col("n") == 0, "^").otherwise("-")


def _said(marks: Column) -> Column:
    return F.concat(marks, F.when(F.col("text") != "", F.concat(F.lit(" "), "text")).otherwise(""))


def long_report(diagnostics: DataFrame, files: DataFrame) -> DataFrame:
    """path, start, text: one text a diagnostic, as above. diagnostics: as of a run; labels and notes may be missing."""
    diagnostics = diagnostics.withColumn("_d", F.xxhash64("phase", "rule", "start", "end", "title"))
    lines = source_lines(files.join(diagnostics.select("file_id").distinct(), "file_id", "left_semi"))
    labels = shared_table(_placed(labels_of(diagnostics), lines), "labels")  # read by all that follows
    rails = tracks(labels.where("line < to_line").withColumn("_after", F.col("to_line") + 1), KEY, "line", "_after", ["n"]).drop("_after")
    rails = shared_table(rails, "rails")
    single = labels.where("line = to_line")

    # the lines that are shown, with what of them, and the rails beside them
    ends = labels.select(*KEY, F.explode(F.array(F.struct("line", "col"), F.struct(F.col("to_line").alias("line"), F.when(F.col("line") == F.col("to_line"), F.col("col")).otherwise(F.greatest(F.col("to_col") - 1, F.lit(0))).alias("col")))).alias("x"))
    shown = ends.select(*KEY, "x.*").groupBy(*KEY, "line").agg(F.min("col").alias("_first"))
    shown = shown.join(lines.select("file_id", "line", F.col("text").alias("_text")), ["file_id", "line"])
    cut = F.when(F.length("_text") > WIDE, F.greatest(F.col("_first") - BEFORE, F.lit(0))).otherwise(0)
    shown = shown.withColumn("_cut", cut).withColumn("_text", F.expr(f"substring(_text, _cut + 1, {WIDE})"))
    beside = inside(shown.select(*KEY, F.col("line").alias("_line")), rails.select(*KEY, "track", F.col("line").alias("_lo"), F.col("to_line").alias("_hi")), KEY, "_line")
    sign = F.when(F.col("_line") == F.col("_lo"), "/").otherwise("|")
    beside = beside.groupBy(*KEY, F.col("_line").alias("line")).agg(F.map_from_entries(F.collect_list(F.struct("track", sign.alias("s")))).alias("_rails"))
    width = rails.groupBy(*KEY).agg((F.max("track") + 1).alias("_n"))
    shown = shown.join(beside, [*KEY, "line"], "left").join(width, KEY, "left")
    passing = lambda mark: F.expr(f"if(_n is null, '', concat(array_join(transform(sequence(0, _n - 1), r -> {mark}), ''), ' '))")
    held = "coalesce(element_at(_rails, r), ' ')"
    order = Window.partitionBy(*KEY).orderBy("line")
    shown = shown.withColumns({"_beside": passing(held), "_under": passing(f"if({held} = '/', '|', {held})"), "_gap": F.col("line") - F.lag("line").over(order) > 1, "_wide": F.max(F.length((F.col("line") + 1).cast("string"))).over(Window.partitionBy(*KEY))})
    shown = shared_table(shown, "shown")

    # rows: gaps (0), source lines (1), marks within the line by row (2), ends of rails (3)
    blank = F.expr("repeat(' ', _wide)")
    row = lambda df, kind, k, text: df.select(*KEY, F.struct(F.col("line"), F.lit(kind).alias("kind"), k.cast("int").alias("k"), text.alias("text")).alias("r"))
    after_gap = passing(f"if({held} = '/', ' ', {held})")
    zero = F.lit(0)
    rows = [
        row(shown.where("_gap"), 0, zero, F.rtrim(F.concat(F.lit("..."), F.expr("repeat(' ', _wide)"), after_gap))),
        row(shown, 1, zero, F.rtrim(F.concat(F.lpad((F.col("line") + 1).cast("string"), F.col("_wide"), " "), F.lit(" | "), "_beside", "_text"))),
    ]
    frame = shown.select(*KEY, "line", "_cut", "_under", "_wide", "_n", "_rails")
    # a label takes the room of its marks, its text and a blank; what lies beyond the shown part is marked at its end
    room = single.join(frame, [*KEY, "line"]).withColumns({"_from": F.least(F.col("col") - F.col("_cut"), F.lit(WIDE)), "_to": F.least(F.col("to_col") - F.col("_cut"), F.lit(WIDE + 1))}).withColumn("_mark", _said(F.expr("repeat(if(n = 0, '^', '-'), greatest(_to - _from, 1))")))
    room = tracks(room.withColumn("_upto", F.col("_from") + F.length("_mark") + 1), [*KEY, "line"], "_from", "_upto", ["n"])
    side_by_side = room.groupBy(*KEY, "line", "track").agg(F.array_sort(F.collect_list(F.struct("_from", "_mark"))).alias("_all"), F.first("_under").alias("_under"), F.first("_wide").alias("_wide"))
    drawn = F.expr("aggregate(_all, '', (acc, x) -> concat(rpad(acc, x._from, ' '), x._mark))")
    rows.append(row(side_by_side, 2, F.col("track"), F.concat(blank, F.lit(" | "), "_under", drawn)))
    closing = rails.select(*KEY, "n", "text", "track", F.col("to_line").alias("line"), "to_col").join(frame, [*KEY, "line"])
    # left of the end are the rails that go on; those that end here are closed one below the other
    still = passing(f"if(r < track, if({held} = '/', '|', {held}), if(r = track, '\\\\', '_'))")
    line_to = F.expr("repeat('_', greatest(least(to_col - 1 - _cut, 240), 0))")
    left = F.regexp_replace(still, " $", "_")
    rows.append(row(closing, 3, F.col("track"), F.concat(blank, F.lit(" | "), left, line_to, _said(_sign()))))

    body = reduce(DataFrame.unionByName, rows).groupBy(*KEY).agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["text"]), "\n").alias("_body"), F.max(F.length((F.col("r.line") + 1).cast("string"))).alias("_wide"))
    notes = F.col("notes") if "notes" in diagnostics.columns else F.array().cast("array<string>")
    fixes = F.transform("fixes", lambda f: F.when(f["insert"] == "", F.when(f["end"] > f["start"], "delete what is marked").otherwise("")).otherwise(F.concat(F.lit("write "), f["insert"]))) if "fixes" in diagnostics.columns else F.array().cast("array<string>")
    one = F.when(F.size(fixes) == 1, F.filter(fixes, lambda x: x != "")).otherwise(F.array().cast("array<string>"))
    said = F.concat(F.transform(F.coalesce(notes, F.array().cast("array<string>")), lambda x: F.concat(F.lit("note: "), x)), F.transform(one, lambda x: F.concat(F.lit("fix: "), x)))
    head = F.concat("severity", F.lit("["), F.coalesce("rule", "phase"), F.lit("]: "), "title", F.lit("\n"), blank, F.lit(" --> "), "path", F.lit(":"), (F.col("line") + 1).cast("string"), F.lit(":"), (F.col("col") + 1).cast("string"), F.lit("\n"))
    foot = F.array_join(F.transform(said, lambda x: F.concat(F.lit("\n"), blank, F.lit(" = "), x)), "")
    return diagnostics.dropDuplicates(KEY).join(body, KEY).select("path", "start", F.concat(head, "_body", foot).alias("text"))
