"""What an editor asks of a document: hover, completion and quick fixes, as lookups in the tables of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.operators.directives import COMMANDS
from sylva.operators.edits import moved
from sylva.operators.rules import RULES


def hover(directives: DataFrame, path_files: DataFrame, path: str, offset: int) -> DataFrame:
    """The directives under a byte of a document, and what they say: command, rules, text."""
    at = directives.join(path_files.where(F.col("path") == path).select("file_id"), "file_id").where((F.col("start") <= offset) & (F.col("end") >= offset))
    docs = F.create_map(*[F.lit(x) for r in RULES.values() for x in (r.name, r.docs)])
    return at.select("command", "rules", F.array_join(F.transform("rules", lambda r: F.concat_ws(": ", r, docs[r])), "\n").alias("text"))


def completions(spark, written: str, rules: bool = True) -> DataFrame:
    """label, distance: names of rules (or commands) that begin with or are near what is written, nearest first."""
    names = sorted(RULES) if rules else list(COMMANDS)
    rows = spark.createDataFrame([(n,) for n in names], "label string")
    return rows.withColumn("distance", F.when(F.col("label").startswith(written), 0).otherwise(F.levenshtein("label", F.lit(written)))).orderBy("distance", "label")


def quick_fixes(diagnostics: DataFrame, files: DataFrame, path: str, start: int, end: int) -> DataFrame:
    """title, start, end, insert: edits for the findings of exactly a range: each rule's own fixes, and a directive that ignores it in the file.

    The directive goes to the first line, or below it if that is a shebang.
    """
    mine = diagnostics.where((F.col("path") == path) & (F.col("start") == start) & (F.col("end") == end) & F.col("rule").isNotNull())
    own = mine.select(F.concat(F.lit("fix: "), "title").alias("title"), F.explode("fixes").alias("f")).select("title", "f.*")
    first = F.regexp_extract("source", r"^(#![^\n]*\n)", 1)
    ignore = mine.select("file_id", "rule").distinct().join(files.select("file_id", "source"), "file_id")
    ignore = ignore.select(F.concat(F.lit("ignore "), "rule", F.lit(" in this file")).alias("title"), F.octet_length(first).alias("start"), F.octet_length(first).alias("end"), F.concat(F.lit("// sylva-ignore "), "rule", F.lit("\n\n")).alias("insert"))
    return own.unionByName(ignore)


def after_fix(diagnostics: DataFrame, edits: DataFrame) -> DataFrame:
    """The findings that are left once edits (file_id, start, end, insert) are made, at their new places, without linting anew: those not cut into by an edit.

    line and col are those of before and go, as an edit may add lines.
    """
    return moved(diagnostics.drop("line", "col"), edits)
