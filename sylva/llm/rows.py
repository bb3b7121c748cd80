"""Dropping rows of a table without moving the others."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylva.llm.bloom import key_filter, slice_of, slices, with_flag
from sylva.session import shared_table


def drop_marked(docs: DataFrame, id_: Column, mark: Column, acts: DataFrame, bits_per_row: int = 16, max_bits: int = 1 << 28) -> DataFrame:
    """docs without the rows whose (id, mark) acts names, all columns as they were.

    acts, a table, has a row (id, mark, one) for each key: where ``one`` is set, a single row of that key stays, else none. A Bloom
    filter of the keys finds the rows they may mean; only those move, by their own key, so that rows of one text but different ids
    don't meet. If the keys need more bits than max_bits, rows and keys are cut into slices.
    """
    held = F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]).alias("row")
    key = F.xxhash64("id", "mark")
    rows = docs.select(held, id_.alias("id"), mark.alias("mark"))
    n = acts.count()
    k = slices(n, bits_per_row, max_bits)
    if k > 1:
        rows = shared_table(rows.withColumn("_slice", slice_of(key, k)), "rows", "_slice")
    out = []
    for i in range(k):
        own, few = rows, acts
        if k > 1:
            own, few = rows.where(F.col("_slice") == i).drop("_slice"), acts.where(slice_of(key, k) == i)
        full = with_flag(own.withColumn("possible", key), *key_filter(few.select(key.alias("h")), bits_per_row, max_bits, n // k), "possible")
        named = few.select(key.alias("k"), F.col("id").alias("i"), F.col("mark").alias("m"), "one")
        hit = full.where("possible").withColumn("key", key).join(named, F.expr("key = k and id <=> i and mark = m"), "left")
        once = hit.where("one").groupBy("key", "id", "mark").agg(F.first("row").alias("row"))
        out += [full.where("not possible").select("row"), hit.where("one is null").select("row"), once.select("row")]
    return reduce(DataFrame.unionByName, out).select("row.*")
