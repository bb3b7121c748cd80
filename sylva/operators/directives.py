"""Comments that steer the rules: ``// sylva-ignore no-empty, no-debugger``.

Only comments that begin with ``sylva-`` are read; those of other tools mean nothing here. Commands: ``ignore [rules] [until eof|N]``, ``disable [rules]`` and
``enable``; only ignore has an effect. A comment before the first statement that stands at byte 0 or is set off by a blank line concerns
the file; any other concerns the statement that follows it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sylva.functions.names import name_distance
from sylva.operators.rules import RULES, STEERING
from sylva.operators.spans import covered

PREFIX = STEERING
COMMANDS = ("ignore", "disable", "enable")


def parse_directives(tokens: DataFrame, nodes: DataFrame) -> DataFrame:
    """file_id, scope ('file' or 'node'), node_start, node_end, command, rules, until, start, end."""
    content = F.regexp_replace("text", r"(?s)^(//|/\*+)\s*|\s*\*/$", "")
    wanted = tokens.where((F.col("kind") == "COMMENT") & content.rlike(rf"^{PREFIX}"))
    mine = tokens.join(wanted.select("file_id").distinct(), "file_id", "left_semi")
    after = Window.partitionBy("file_id").orderBy("tok")
    mine = mine.withColumns({
        "_next": F.min(F.when(~F.col("is_trivia"), F.col("start"))).over(after.rowsBetween(1, Window.unboundedFollowing)),
        "_before": F.count(F.when(~F.col("is_trivia"), 1)).over(after.rowsBetween(Window.unboundedPreceding, -1)),
        "_gap": F.lead("text").over(after),
        "_gap_kind": F.lead("kind").over(after),
    })
    found = mine.where((F.col("kind") == "COMMENT") & content.rlike(rf"^{PREFIX}")).withColumn("c", F.regexp_replace(content, rf"^{PREFIX}", ""))
    blank = (F.col("_gap_kind") == "WHITESPACE") & F.col("_gap").rlike(r"\n[ \t\r]*\n")
    alone = (F.col("_before") == 0) & ((F.col("start") == 0) | F.coalesce(blank, F.lit(False)) | F.col("_next").isNull())
    rest = F.regexp_replace(F.regexp_extract("c", r"(?s)^[a-z]*\s*(.*)$", 1), r"\s*--.*$", "")
    until = F.regexp_extract(rest, r"\buntil\s+(eof|[0-9]+)", 1)
    names = F.filter(F.split(F.trim(F.regexp_replace(rest, r"\buntil\b.*$", "")), r"[\s,]+"), lambda x: x != "")
    out = found.select("file_id", F.when(alone, "file").otherwise("node").alias("scope"), "_next", F.regexp_extract("c", "^([a-z]*)", 1).alias("command"), names.alias("rules"), F.when(until != "", until).alias("until"), "start", "end")
    starts = nodes.where("role = 'item' or depth = 1").groupBy("file_id", F.col("start").alias("_next")).agg(F.max("end").alias("node_end"))
    return out.join(starts, ["file_id", "_next"], "left").select("file_id", "scope", F.col("_next").alias("node_start"), "node_end", "command", "rules", "until", "start", "end")


def directive_errors(directives: DataFrame, active: list[str]) -> DataFrame:
    """Unknown or missing commands and rules that aren't active, with the name that was most likely meant: file_id, title, start, end."""
    command = F.when(F.col("command") == "", F.lit("a directive without a command")).when(~F.col("command").isin(*COMMANDS), F.concat(F.lit("there is no directive "), "command"))
    a = directives.select("file_id", command.alias("title"), F.col("command").alias("said"), F.lit(list(COMMANDS)).alias("names"), "start", "end").where("title is not null")
    bad = directives.where(F.col("command").isin(*COMMANDS)).select("file_id", F.explode("rules").alias("rule"), "start", "end").where(~F.col("rule").isin(*active) if active else F.lit(True))
    both = a.unionByName(bad.select("file_id", F.concat(F.lit("there is no active rule "), "rule").alias("title"), F.col("rule").alias("said"), F.lit(sorted(RULES)).alias("names"), "start", "end"))
    # the names are a short fixed list: the nearest comes from a fold over it
    near = F.array_min(F.transform("names", lambda n: F.struct(name_distance(n, F.col("said")).alias("d"), n.alias("n"))))
    meant = F.array_min(F.filter(F.transform("names", lambda n: F.struct(name_distance(n, F.col("said")).alias("d"), n.alias("n"))), lambda x: x["d"].isNotNull() & (x["d"] > 0)))
    title = F.when(near.isNotNull() & meant.isNotNull() & (F.col("said") != ""), F.concat("title", F.lit(", did you mean "), meant["n"], F.lit("?"))).otherwise(F.col("title"))
    return both.select("file_id", title.alias("title"), "start", "end")


def redundant(directives: DataFrame, found: DataFrame) -> DataFrame:
    """Ignores that take nothing out, as an outer one of the file already does: rules named again, and any after one that names none."""
    ignores = directives.where("command = 'ignore'")
    whole = ignores.where("scope = 'file' and size(rules) = 0").groupBy("file_id").agg(F.min("start").alias("_first"))
    named = ignores.where("scope = 'file'").select("file_id", F.explode("rules").alias("rule"), "start").groupBy("file_id", "rule").agg(F.min("start").alias("_first"))
    after = ignores.join(whole, "file_id").where("start > _first").select("file_id", F.lit("this is redundant: the file is ignored as a whole").alias("title"), "start", "end")
    each = ignores.select("file_id", F.explode("rules").alias("rule"), "start", "end").join(named, ["file_id", "rule"]).where("start > _first")
    return after.unionByName(each.select("file_id", F.concat(F.lit("this is redundant: the file already ignores "), "rule").alias("title"), "start", "end")).distinct()


def apply_ignores(diagnostics: DataFrame, directives: DataFrame) -> DataFrame:
    """diagnostics (file_id, rule, start, end, …) without those that an ignore takes out; files are matched by equality first."""
    ignores = directives.where("command = 'ignore'")
    whole = ignores.where("scope = 'file' and size(rules) = 0").select("file_id").distinct()
    by_rule = ignores.where("scope = 'file'").select("file_id", F.explode("rules").alias("rule")).distinct()
    ranges = ignores.where("scope = 'node' and node_end is not null").select("file_id", "rules", F.col("node_start").alias("_lo"), F.col("node_end").alias("_hi"))
    left = diagnostics.join(whole, "file_id", "left_anti").join(by_rule, ["file_id", "rule"], "left_anti")
    left = covered(left, ranges.where("size(rules) = 0"), ["file_id"], flag="_any")
    left = covered(left, ranges.withColumn("rule", F.explode("rules")), ["file_id", "rule"], flag="_own")
    return left.where("not _any and not _own").drop("_any", "_own")
