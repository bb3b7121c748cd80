"""Audit of filters that act one after another: what every filter removes in every order, and what it takes from the others.

Each document becomes a mask of the filters it fails. Documents of one part are counted by mask, so that whatever their number a part
is at most 2^k cells for k filters. Orders are then visited by single swaps of neighbours (plain changes); a swap of steps i and i + 1
leaves the documents that reach step i and those that leave step i + 1 as they were, so only these two steps are counted anew from the
cells, and the Shapley sums grow along the walk.

A filter that looks at other rows, the one for repeated texts, is settled on (SHA-256 of the text, least id): rows of one text are
counted by (text, part, mask, labels) before they meet, so a text of a third of all rows is a few rows by then. The rows that labels join
to are written once (ids, hashes and masks, no texts); ids of many rows stay in place.

Defined results: a null text is the empty text, a null part the empty string. Rows are judged, not ids: a repeated row is counted again
and, as its id is not smaller, is no repetition of itself. A null id is neither smaller nor larger than another, so its row never fails
the filter for repeated texts and makes no other fail it; it has no labels. Of several labels of an id any 1 counts; null labels are 0.
Filters read whole texts of any length. An empty table has no parts and gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylva.llm.skew import join_counted
from sylva.session import shared_table, ship

SPACES = r"[\x20\x09-\x0D]+"


def _words(text: Column) -> Column:
    return F.filter(F.split(text, SPACES), lambda w: w != "")


#: Whether a text fails, by letter. The filter for repeated texts follows them as REPEATED.
FILTERS: dict[str, Callable[[Column], Column]] = {
    "A": lambda text: F.size(_words(text)) < 200,
    "B": lambda text: 100 * F.size(F.array_distinct(_words(text))) < 50 * F.size(_words(text)),
    "C": lambda text: 100 * (F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))) > 3 * F.length(text),
    "D": lambda text: text.rlike(r"[#$%&*|]"),
}
REPEATED = "E"


def cells(docs: DataFrame, labels: DataFrame, filters: dict[str, Callable[[Column], Column]] = FILTERS, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents of a part that fail exactly the filters of mask, bit i for the i-th letter, the last one for repeated texts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), text.alias("text"))
    bits = [F.when(fails(F.col("text")), 1 << i).otherwise(0) for i, fails in enumerate(filters.values())]
    mask = sum(bits[1:], bits[0]) if bits else F.lit(0)
    rows = own.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("sha"), mask.cast("int").alias("mask"))
    rows = shared_table(rows.groupBy("doc_id", "part", "sha", "mask").agg(F.count(F.lit(1)).alias("n")), "audit-rows")

    marks = labels.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), *[F.coalesce(F.col(c) == 1, F.lit(False)).cast("int").alias(to) for c, to in (("quality", "good"), ("toxic", "toxic"))])
    marks = marks.groupBy("doc_id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    known = rows.where("doc_id is not null")
    counted = marks.join(known.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")), "doc_id")
    marked = join_counted(known, shared_table(counted, "audit-labels"), ["doc_id"], "rows", max(1, rows.count()), "left").fillna(0, ["good", "toxic"])
    marked = marked.unionByName(rows.where("doc_id is null").withColumns({"good": F.lit(0), "toxic": F.lit(0)}))

    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first")
    texts = marked.groupBy("sha", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("nameless"), first)
    # at most four rows a part of each text are left, which is less than what a part has of results
    passing = F.expr("nameless + if(first.doc_id = min(first.doc_id) over (partition by sha), first.n, 0)")
    split = texts.withColumn("passing", F.coalesce(passing, F.col("nameless"))).selectExpr("part", "good", "toxic", f"inline(array(struct(mask, passing as n), struct(mask | {1 << len(filters)} as mask, n - passing as n)))")
    return split.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic")).where("n > 0")


def neighbour_swaps(k: int) -> Iterator[int]:
    """Places i whose swap with i + 1 leads through all orders of k things, each once: the last thing runs to and fro through the orders of the others."""
    if k < 2:
        return
    others, down = neighbour_swaps(k - 1), True
    while True:
        yield from range(k - 2, -1, -1) if down else range(k - 1)
        if (i := next(others, None)) is None:
            return
        yield i + down  # the last thing stands in front of the others after running down
        down = not down


def walk(counts: np.ndarray, k: int) -> tuple[list[tuple[tuple[int, ...], np.ndarray]], np.ndarray]:
    """Every order with what each of its steps removes, and the Shapley sums by filter.

    counts: (columns, 2^k), documents of every mask, in the first column all of them. What a step removes has the same columns.
    """
    masks = np.arange(1 << k)
    shapley = np.zeros(k, np.int64)

    def removed(order: list[int], step: int) -> np.ndarray:
        before = sum(1 << f for f in order[:step])
        return counts[:, (masks & before == 0) & (masks >> order[step] & 1 == 1)].sum(axis=1)

    order = list(range(k))
    steps = np.array([removed(order, s) for s in range(k)]).reshape(k, len(counts))
    seen = []
    swaps = neighbour_swaps(k)
    while True:
        seen.append((tuple(order), steps.copy()))
        shapley[order] += steps[:, 0]
        if (i := next(swaps, None)) is None:
            return seen, shapley
        order[i], order[i + 1] = order[i + 1], order[i]
        both = steps[i] + steps[i + 1]  # what two neighbours remove together doesn't depend on their order
        steps[i] = removed(order, i)
        steps[i + 1] = both - steps[i]


SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit(docs: DataFrame, labels: DataFrame, filters: dict[str, Callable[[Column], Column]] = FILTERS, repeated: str = REPEATED, **columns: str) -> DataFrame:
    """One row per part, order of all filters and step: see SCHEMA; shapley is the sum over all orders."""
    ship(docs.sparkSession)
    letters = [*filters, repeated]
    k = len(letters)

    def of_part(cell: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros((3, 1 << k), np.int64)
        counts[:, cell["mask"]] = cell[["n", "good", "toxic"]].to_numpy().T
        masks = np.arange(1 << k)
        fails = [int(counts[0, masks >> f & 1 == 1].sum()) for f in range(k)]
        seen, shapley = walk(counts, k)
        out = []
        for order, steps in seen:
            left = int(counts[0].sum()) - np.cumsum(steps[:, 0])
            name = "".join(letters[f] for f in order)
            out += [(cell["part"].iloc[0], name, s + 1, left[s], steps[s, 0], fails[f] - steps[s, 0], counts[0, 1 << f], steps[s, 1], steps[s, 2], shapley[f]) for s, f in enumerate(order)]
        return pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    # a part has at most 2^k cells
    return cells(docs, labels, filters, **columns).groupBy("part").applyInPandas(of_part, SCHEMA)


ORACLE = r"""
WITH own AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
worded AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM own),
marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
judged AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
  (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t))::INT
  + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS mask
  FROM worded LEFT JOIN marks USING (doc_id)),
cell AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM judged GROUP BY part, mask),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letter a, letter b, letter c, letter d, letter e
  WHERE a.f NOT IN (b.f, c.f, d.f, e.f) AND b.f NOT IN (c.f, d.f, e.f) AND c.f NOT IN (d.f, e.f) AND d.f <> e.f),
steps AS (SELECT filter_order, step, 1 << (ascii(filter_order[step]) - 65) AS bit, list_sum([1 << (ascii(x) - 65) FOR x IN string_split(filter_order[1:step], '')])::INT AS upto
  FROM orders, (SELECT unnest(range(1, 6))::INT AS step)),
counted AS (SELECT part, filter_order, step, bit, sum(CASE WHEN mask & upto = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & upto = bit THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN mask & bit > 0 AND mask & upto <> bit THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN mask & upto = bit THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & upto = bit THEN toxic ELSE 0 END) AS toxic_lost
  FROM cell, steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM counted
"""
