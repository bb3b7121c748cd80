"""Options inferred from how sources are written: every place votes, and the most frequent value wins, of equals the largest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mode_largest(rows: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """The most frequent value of each group; of equally frequent ones the largest. Pre-aggregated, so a frequent value is no hot spot."""
    counts = rows.select(*keys, value.alias("_v")).groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*keys).agg(F.max(F.struct("_n", "_v"))["_v"].alias(name))


def votes(rows: DataFrame, keys: list[str], options: dict[str, Column]) -> DataFrame:
    """keys, option, value, n: histograms of several options by one pass; each option's expression is a vote of the row, null for none.

    The same histograms made of parts of the rows merge by :func:`merged`, so they may be kept and added to.
    """
    cast = F.array(*[F.struct(F.lit(name).alias("option"), vote.cast("string").alias("value")) for name, vote in options.items()])
    said = rows.select(*keys, F.explode(F.filter(cast, lambda v: v["value"].isNotNull())).alias("v")).select(*keys, "v.*")
    return said.groupBy(*keys, "option", "value").agg(F.count(F.lit(1)).alias("n"))


def merged(histograms: DataFrame, keys: list[str]) -> DataFrame:
    """Histograms of several parts as one: the counts of equal values added up."""
    return histograms.groupBy(*keys, "option", "value").agg(F.sum("n").alias("n"))


def winners(histograms: DataFrame, keys: list[str]) -> DataFrame:
    """keys, options: a map of each option to its most frequent value, of equals the largest."""
    best = histograms.groupBy(*keys, "option").agg(F.max(F.struct("n", "value"))["value"].alias("value"))
    return best.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("option", "value")))).alias("options"))


def infer_block_spacing(nodes: DataFrame) -> DataFrame:
    """rule, style: whether one-line blocks have spaces inside their braces."""
    full = nodes.where("kind in ('BLOCK_STMT', 'SWITCH_STMT') and if(kind = 'SWITCH_STMT', child_count > 1, child_count > 0)")
    sides = full.select(F.explode(F.expr("array(if(info['open_nl'] = 'false', if(info['open_ws'] <> info['open'], 'always', 'never'), null), if(info['close_nl'] = 'false', if(info['close_ws'] <> info['close'], 'always', 'never'), null))")).alias("style")).where("style is not null")
    found = winners(votes(sides.withColumn("rule", F.lit("block-spacing")), ["rule"], {"style": F.col("style")}), ["rule"])
    return found.select("rule", F.col("options.style").alias("style"))


def as_toml(inferred: DataFrame) -> str:
    lines = ["[rules.errors]"]
    lines += [f'{r["rule"]} = {{ style = "{r["style"]}" }}' for r in inferred.collect()]  # a row a rule
    return "\n".join(lines) + "\n"
