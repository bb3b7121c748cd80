"""Conformance coverage: files of a language test suite with YAML front matter, parsed in strict and sloppy mode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylva.operators.syntax import errors_of, parsed
from sylva.session import shared_table

GIVEN_UP = ("nesting is too deep", "too many steps")  # what the parser says of a source it gives up
FRONT = r"(?s)/\*---(.*?)---\*/"


def _list(front: Column, key: str) -> Column:
    return F.filter(F.transform(F.split(F.regexp_extract(front, rf"(?m)^{key}:\s*\[([^\]]*)\]", 1), ","), F.trim), lambda x: x != "")


def test_files(files: DataFrame) -> DataFrame:
    """files with flags, features, negative_phase and description; files that need features are left out."""
    front = F.regexp_extract("source", FRONT, 1)
    found = files.where(F.col("source").rlike(FRONT)).withColumns({"flags": _list(front, "flags"), "features": _list(front, "features"), "negative_phase": F.regexp_extract(front, r"negative:\s+phase:\s*(\w+)", 1), "description": F.trim(F.regexp_extract(front, r"(?m)^description:\s*>?\s*(.*)$", 1))})
    return found.where("size(features) = 0")


def run(tests: DataFrame) -> DataFrame:
    """path, mode ('module', 'strict' or 'sloppy'), outcome ('passed', 'failed', or 'panicked' where the parser gave up): a negative test passes if it has a syntax error."""
    modes = F.when(F.array_contains("flags", "module"), F.array(F.lit("module"))).when(F.array_contains("flags", "onlyStrict"), F.array(F.lit("strict"))).when(F.array_contains("flags", "noStrict") | F.array_contains("flags", "raw"), F.array(F.lit("sloppy"))).otherwise(F.array(F.lit("strict"), F.lit("sloppy")))
    each = tests.select("path", "source", "negative_phase", F.explode(modes).alias("mode"))
    source = F.when(F.col("mode") == "strict", F.concat(F.lit('"use strict";\n'), "source")).otherwise(F.col("source"))
    each = each.select(F.xxhash64("path", "mode").alias("file_id"), "path", "mode", "negative_phase", source.alias("source"), F.when(F.col("mode") == "module", "module").otherwise("script").alias("kind"))
    bad = errors_of(shared_table(parsed(each), "coverage", partition="what")).groupBy("file_id").agg(F.max(F.col("title").isin(*GIVEN_UP)).alias("gave_up"))
    failed = F.col("gave_up").isNotNull() != F.col("negative_phase").isin("parse", "early")
    return each.join(bad, "file_id", "left").select("path", "mode", F.when(F.col("gave_up"), "panicked").when(failed, "failed").otherwise("passed").alias("outcome"))


def coverage(results: DataFrame) -> DataFrame:
    """One row: passed, failed, panicked, percentage (of those that passed)."""
    n = {o: F.count_if(F.col("outcome") == o) for o in ("passed", "failed", "panicked")}
    return results.agg(*[c.alias(o) for o, c in n.items()], F.round(100 * n["passed"] / F.count(F.lit(1)), 2).alias("percentage"))
