"""Joins on keys of which some hold a large part of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT = 4096  # a key of more than 1/HOT of the rows is hot, so fewer than HOT keys are: a proven bound of what is broadcast


def join_counted(rows: DataFrame, small: DataFrame, on: list[str], count: str, n: int, how: str = "inner", keep: bool = False) -> DataFrame:
    """rows joined with small, which has one row a key and in ``count`` how many of the n rows have that key (dropped unless ``keep``).

    Rows of hot keys stay where they are, as those keys are broadcast; all others join by their key, of which each task gets
    few. how: inner or left. rows is read twice, so it should be a table.
    """
    is_hot = F.col(count) * HOT > n
    hot, cold = small.where(is_hot), small.where(~is_hot)
    if not keep:
        hot, cold = hot.drop(count), cold.drop(count)
    at_place = rows.join(F.broadcast(hot), on)
    others = rows.join(F.broadcast(hot.select(*on)), on, "left_anti")
    return at_place.unionByName(others.join(cold, on, how))
