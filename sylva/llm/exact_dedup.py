"""Exact dedup by two-pass Bloom filtering.

Pass one reads the hash of every row and builds two bit arrays: bits of hashes seen once, bits of hashes seen at least twice.
Pass two tests every row against the second array. A row that fails can't be repeated and passes straight through; only the
possibly repeated rows shuffle, and an exact aggregation over their SHA-256 removes the filter's false positives.

The arrays take ``bits_per_row`` bits a row, at most ``max_bits`` (the proven bound of what is broadcast). A larger table is cut into
slices by hash, so many that each has its bits: equal texts are in one slice, slices are treated one after another in the same way,
and the share of rows that shuffle stays what it is. Rows of a text that a large part of the table has stay where they are when their
group is joined back.

Defined results: a null text counts as empty; texts are equal when their bytes are; the largest doc_id of a group stays (nulls only
where a group has nothing else); repeated rows of one doc_id and text are all marked alike by :func:`find_duplicates`, and
:func:`drop_duplicates` keeps one of them; an empty table gives an empty result; other columns don't matter, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylva.llm.bloom import repeated_filter, slice_of, slices, with_flag
from sylva.llm.rows import drop_marked
from sylva.llm.skew import join_counted
from sylva.session import shared_table, ship


def _sha(text_col: str) -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))


def _marked(base: DataFrame, n: int, bits_per_row: int, max_bits: int) -> DataFrame:
    """base with its hash column possible replaced by whether it is possibly repeated; a table. base is a table or cheap to read twice."""
    k = slices(n, bits_per_row, max_bits)
    if k == 1:
        return shared_table(with_flag(base, *repeated_filter(base.select("possible"), bits_per_row, max_bits, n), "possible"), "exact")
    sliced = shared_table(base.withColumn("_slice", slice_of(F.col("possible"), k)), "sliced", "_slice")
    out = []
    for i in range(k):
        own = sliced.where(F.col("_slice") == i).drop("_slice")
        out.append(shared_table(with_flag(own, *repeated_filter(own.select("possible"), bits_per_row, max_bits, n // k), "possible"), "exact"))
    return reduce(DataFrame.unionByName, out)


def find_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_row: int = 16, max_bits: int = 1 << 28) -> DataFrame:
    """For every row: doc_id, keep_id, group_size, kept, text_sha256."""
    ship(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("doc_id"), _sha(text_col).alias("sha")).withColumn("possible", F.xxhash64("sha"))
    n = docs.count()
    marked = _marked(base, n, bits_per_row, max_bits)
    hit = marked.where("possible").drop("possible")
    groups = shared_table(hit.groupBy("sha").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups")
    hex_ = F.lower(F.hex("sha")).alias("text_sha256")
    shuffled = join_counted(hit, groups, ["sha"], "group_size", n, keep=True).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), hex_)
    straight = marked.where("not possible").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), hex_)
    return straight.unionByName(shuffled)


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_row: int = 16, max_bits: int = 1 << 28) -> DataFrame:
    """docs with one row of each group of equal texts, all columns as they were.

    Groups are settled on ids and hashes; then the rows that go are looked up by both, so rows of one frequent text never meet.
    """
    ship(docs.sparkSession)
    n = docs.count()
    base = docs.select(F.col(id_col).alias("id"), _sha(text_col).alias("sha")).withColumn("possible", F.xxhash64("sha"))
    hit = _marked(base, n, bits_per_row, max_bits).where("possible").drop("possible")
    groups = shared_table(hit.groupBy("sha").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("n")).where("n > 1"), "groups")
    named = join_counted(hit, groups, ["sha"], "n", n)
    keys = named.groupBy("id", F.col("sha").alias("mark")).agg(F.first("keep_id").alias("keep_id"), F.count(F.lit(1)).alias("k"))
    acts = keys.select("id", "mark", F.col("id").eqNullSafe(F.col("keep_id")).alias("one"), "k").where("not one or k > 1").drop("k")
    return drop_marked(docs, F.col(id_col), _sha(text_col), shared_table(acts, "dropped"), bits_per_row, max_bits)


ORACLE = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
