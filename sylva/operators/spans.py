"""Positions and spans inside a key (a file): lookups, running values, containment and tracks, none of which pairs a row with all others of its key.

Keys are columns of equal names on both sides; positions are whole numbers from 0. Lookups sort both sides together once and carry a value
along; where a key may hold most of the rows, ``width`` cuts it into stretches of so many positions, each with what came before it.
Containment is a join by equality on aligned blocks. Null keys and null positions lie nowhere: such rows are kept without a value by
lookups and are in no join.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from sylva.session import ship

#: How running values go on from those of earlier stretches.
_KINDS = {
    "sum": (F.sum, lambda before, own: F.coalesce(before, F.lit(0)) + F.coalesce(own, F.lit(0))),
    "max": (F.max, lambda before, own: F.greatest(before, own)),
    "last": (lambda c: F.last(c, ignorenulls=True), lambda before, own: F.coalesce(own, before)),
}


def running(rows: DataFrame, keys: list[str], order: list[str], values: dict[str, tuple[str, Column]], width: int | None = None) -> DataFrame:
    """rows with running values up to and with each row: name to (sum, max or last, column).

    order: the position first. With a width, positions of a key are cut into stretches: a window runs within each, and what comes before
    is carried over one row a stretch.
    """
    if width is None:
        over = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return rows.withColumns({name: _KINDS[kind][0](column).over(over) for name, (kind, column) in values.items()})
    held = rows.withColumn("_part", F.floor(F.col(order[0]) / width)).withColumns({f"_v_{name}": column for name, (_, column) in values.items()})
    within = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = held.withColumns({f"_v_{name}": _KINDS[kind][0](F.col(f"_v_{name}")).over(within) for name, (kind, _) in values.items()})
    place = F.struct(*order)
    ends = {"sum": F.sum, "max": F.max, "last": lambda c: F.max_by(c, F.when(c.isNotNull(), place))}
    whole = held.groupBy(*keys, "_part").agg(*[ends[kind](F.col(f"_v_{name}")).alias(f"_b_{name}") for name, (kind, _) in values.items()])
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = whole.withColumns({f"_b_{name}": _KINDS[kind][0](F.col(f"_b_{name}")).over(before) for name, (kind, _) in values.items()})
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in (*keys, "_part")]
    joined = own.alias("l").join(carried.alias("r"), same, "left")
    out = {name: _KINDS[kind][1](F.col(f"r._b_{name}"), F.col(f"l._v_{name}")) for name, (kind, _) in values.items()}
    return joined.select(*[F.col(f"l.`{c}`") for c in rows.columns], *[c.alias(name) for name, c in out.items()])


def as_of(rows: DataFrame, marks: DataFrame, keys: list[str], at: str, found: str = "found", strictly: bool = False, width: int | None = None) -> DataFrame:
    """rows with ``found``: the last of marks (keys, ``_at``, ``_mark``) at or before (strictly: before) position ``at``, null if there is none.

    Of marks at one place the largest counts. A row is sorted among the marks and takes along what it passed; neither side is collected.
    """
    side = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    kind = rows.select(side.alias("_row")).schema["_row"].dataType
    first = 0 if strictly else 2  # marks of the same place are 1
    both = rows.select(*keys, F.col(at).cast("long").alias("_at"), F.lit(first).alias("_side"), F.lit(None).cast(marks.schema["_mark"].dataType).alias("_mark"), side.alias("_row"))
    both = both.unionByName(marks.dropna(subset=[*keys, "_at"]).select(*keys, F.col("_at").cast("long").alias("_at"), F.lit(1).alias("_side"), "_mark", F.lit(None).cast(kind).alias("_row")))
    passed = running(both, keys, ["_at", "_side", "_mark"], {"_found": ("last", F.col("_mark"))}, width)
    out = F.when(F.col("_at").isNotNull(), F.col("_found"))
    return passed.where(f"_side = {first}").select("_row.*", out.alias(found))


RADIX = 16


def blocks_of(lo: str, hi: str, levels: int) -> str:
    """SQL: an array of (level, block) that makes up the span from lo to hi, both included: of level k are blocks of RADIX^k aligned positions.

    A level has the blocks that no larger block holds, so fewer than 2 * RADIX of each.
    """
    size = f"shiftleft(1L, {RADIX.bit_length() - 1} * k)"
    wide = f"shiftleft(1L, {RADIX.bit_length() - 1} * (k + 1))"
    up = lambda x, n: f"(({x}) + {n} - 1) div {n}"
    down = lambda x, n: f"({x}) div {n}"
    a, b = up(lo, size), down(f"{hi} + 1", size)
    c, d = up(lo, wide), down(f"{hi} + 1", wide)
    run = lambda x, y: f"if({x} < {y}, sequence({x}, {y} - 1), cast(array() as array<bigint>))"
    own = f"if(k < {levels - 1} and {c} < {d}, concat({run(a, f'({c}) * {RADIX}')}, {run(f'({d}) * {RADIX}', b)}), {run(a, b)})"
    return f"flatten(transform(sequence(0, {levels - 1}), k -> transform({own}, i -> named_struct('level', k, 'block', i))))"


def inside(points: DataFrame, spans: DataFrame, keys: list[str], at: str, lo: str = "_lo", hi: str = "_hi") -> DataFrame:
    """Rows of points joined with the rows of spans (keys, lo, hi, …) that hold position ``at``, ends included.

    A span is cut into aligned blocks, a point lies in one block of each level, and of the blocks of a span in one at most: a join by
    equality, whose rows are the answer. So a key may hold most of the rows, and a point costs a row a level (five up to a million positions).
    """
    longest = spans.agg(F.max(F.col(hi) - F.col(lo)).alias("n")).first().n
    levels = 1
    while longest is not None and RADIX**levels <= longest + 1:
        levels += 1
    cut = spans.where(f"{lo} <= {hi}").withColumn("_x", F.explode(F.expr(blocks_of(f"cast({lo} as bigint)", f"cast({hi} as bigint)", levels)))).withColumns({"_level": F.col("_x.level"), "_block": F.col("_x.block")}).drop("_x")
    near = points.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1)))).withColumn("_block", F.expr(f"cast(`{at}` as bigint) div shiftleft(1L, {RADIX.bit_length() - 1} * _level)"))
    return near.join(cut, [*keys, "_level", "_block"]).drop("_level", "_block")


def covered(rows: DataFrame, spans: DataFrame, keys: list[str], start: str = "start", end: str = "end", flag: str = "covered", width: int | None = None) -> DataFrame:
    """rows with ``flag``: whether one of spans (keys, ``_lo``, ``_hi``) holds all of the row's span from start to end.

    One does if the furthest end among the spans that begin at or before the row reaches its end.
    """
    side = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    kind = rows.select(side.alias("_row")).schema["_row"].dataType
    both = rows.select(*keys, F.col(start).cast("long").alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast("long").alias("_hi"), side.alias("_row"))
    both = both.unionByName(spans.dropna(subset=[*keys, "_lo"]).select(*keys, F.col("_lo").cast("long").alias("_at"), F.lit(0).alias("_side"), F.col("_hi").cast("long").alias("_hi"), F.lit(None).cast(kind).alias("_row")))
    far = running(both, keys, ["_at", "_side"], {"_far": ("max", F.col("_hi"))}, width).where("_side = 1")
    held = F.coalesce((F.col("_far") >= F.col(f"_row.{end}")) & F.col("_at").isNotNull(), F.lit(False))
    return far.select("_row.*", held.alias(flag))


def tracks(spans: DataFrame, keys: list[str], lo: str, hi: str, tie: list[str] = (), name: str = "track") -> DataFrame:
    """spans with ``track``: the lowest number from 0 that no earlier span of its key, by (lo, hi, tie), still holds at lo; ``hi`` is excluded.

    Spans of a track don't overlap, and a key has as many tracks as spans lie on top of each other at most. Rows go by in order, so what
    is kept of a key are the ends of the spans that are open; a span that ends where it begins takes a track at its place only.
    """
    ship(spans.sparkSession)
    columns = spans.columns
    # rows of null positions are on no track; they don't have to move
    placed = spans.where(f"`{lo}` is not null and `{hi}` is not null")
    sorted_ = placed.repartition(*keys).sortWithinPartitions(*keys, lo, hi, *tie) if keys else placed.coalesce(1).sortWithinPartitions(lo, hi, *tie)
    at = [columns.index(c) for c in (*keys, lo, hi)]

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, open_, free, n = object(), [], [], 0
        for b in batches:
            out = []
            for *own, start, end in zip(*[b.column(i).to_pylist() for i in at], strict=True):
                if own != key:
                    key, open_, free, n = own, [], [], 0
                while open_ and open_[0][0] <= start:
                    heapq.heappush(free, heapq.heappop(open_)[1])
                if free:
                    track = heapq.heappop(free)
                else:
                    track, n = n, n + 1
                heapq.heappush(open_, (max(end, start), track))
                out.append(track)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int32())], names=[*b.schema.names, name])

    schema = StructType([*spans.schema.fields, StructField(name, IntegerType())])
    done = sorted_.mapInArrow(sweep, schema)
    return done.unionByName(spans.where(f"`{lo}` is null or `{hi}` is null").withColumn(name, F.lit(None).cast("int")))
