"""The nearest of some names to a misspelt one."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def levenshtein(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _words(name: str) -> list[str]:
    return sorted(re.split(r"[-_]", name))


def best_match(names: list[str], wrong: str) -> str | None:
    """Equal but for case; else the nearest within a third of the length; else of the same words in another order."""
    for n in names:
        if n.upper() == wrong.upper():
            return n
    least = max(len(wrong), 3) // 3
    near = [(levenshtein(n, wrong), i, n) for i, n in enumerate(names)]
    near = [x for x in near if x[0] <= least]
    if near:
        return min(near)[2]
    return next((n for n in names if _words(n) == _words(wrong)), None)


def name_distance(a: Column, b: Column) -> Column:
    """The edit distance where it is within a third of the longer of b and 3, else null."""
    d = F.levenshtein(a, b)
    return F.when(d <= F.floor(F.greatest(F.length(b), F.lit(3)) / 3), d)


# A text within k edits of a name, cut into k + 1 segments, holds one of the segments unchanged, at most k places from its own.
_BASE, _EXTRA = "(n div (k + 1))", "(k + 1 - n % (k + 1))"  # segments from the second number on are longer by one
_START = f"(i * {_BASE} + greatest(i - {_EXTRA}, 0))"
_LENGTH = f"({_BASE} + if(i >= {_EXTRA}, 1, 0))"


def nearest_names(said: DataFrame, names: DataFrame) -> DataFrame:
    """For every different text of ``said`` (column said) the nearest of names (column name) within a third of its length, of equally near ones the least: said, nearest, distance.

    Names are found by an equality join on segments, so no text meets all names, and each pair found is verified by its edit distance: the
    result is that of comparing all pairs. Texts without a near name and nulls are left out.
    """
    index = names.select("name").where("name is not null").distinct().withColumn("n", F.expr("cast(length(name) as int)"))
    index = index.withColumn("k", F.explode(F.expr("sequence(greatest(1, cast(n div 4 as int)), greatest(1, cast(n div 2 as int)))"))).withColumn("i", F.explode(F.expr("sequence(0, k)")))
    index = index.select("name", "n", "k", "i", F.expr(f"substring(name, cast({_START} + 1 as int), cast({_LENGTH} as int))").alias("segment"))
    texts = said.select("said").where("said is not null").distinct().withColumn("m", F.expr("cast(length(said) as int)")).withColumn("k", F.expr("cast(greatest(m, 3) div 3 as int)"))
    probes = texts.withColumn("n", F.explode(F.expr("sequence(greatest(m - k, 0), m + k)"))).withColumn("i", F.explode(F.expr("sequence(0, k)")))
    probes = probes.withColumns({"_s": F.expr(f"cast({_START} as int)"), "_l": F.expr(f"cast({_LENGTH} as int)")})
    probes = probes.withColumn("_at", F.explode(F.expr("filter(sequence(greatest(_s - k, 0), _s + k), x -> x + _l <= m)")))
    probes = probes.select("said", "n", "k", "i", F.expr("substring(said, _at + 1, _l)").alias("segment")).distinct()
    pairs = probes.join(index, ["n", "k", "i", "segment"]).select("said", "name", "k").distinct()
    near = pairs.withColumn("distance", F.levenshtein("said", "name")).where("distance <= k")
    return near.groupBy("said").agg(F.min(F.struct("distance", "name")).alias("x")).select("said", F.col("x.name").alias("nearest"), "x.distance")
