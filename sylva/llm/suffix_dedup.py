"""Removal of long repeated substrings by column-wise construction over aligned segments.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else. The strings starting at every position are
suffixes cut at ``length``; two are equal where the common prefix of neighbours in the sorted collection reaches ``length``.

A column-wise construction over whole documents needs as many rounds as the longest has bytes, each over the whole collection, and
one machine for it. Here the collection is first cut into segments that can be treated apart:

  1. Every string gets an anchor: the leftmost least hash among its ``gram``-byte grams. Equal strings have equal anchors at equal
     places. Consecutive strings of one anchor form a segment, at most 2 * length bytes long; every string is in one segment.
  2. A two-pass Bloom filter finds anchors that occur at least twice; all other segments are dropped where they are read. Where the
     anchors need more bits than a filter may have, their hashes are counted exactly by a shuffle instead, and each text gets the list
     of its own repeated anchors; so no more segments move as the collection grows.
  3. Equal segments are counted (those that occur twice are repeated as a whole), and one of each goes to its anchor's group.
  4. In a group the segments are aligned on the anchor, so equal strings start in one column. The construction inserts one symbol of
     every segment each round, from the last column to the first: the transform of the round before, read in order, is sorted stably
     by its symbols, and the common prefixes of new neighbours follow from the minima between their old places. Only suffixes of one
     column are compared, so a round costs the number of segments, and there are at most 2 * length rounds. Transform, order and
     common prefixes are read from and written to sequential files in the executor's scratch folder.
  5. A group of more than ``most`` different segments (a frequent passage with ever different surroundings) is split for the same
     construction: its columns are halved, and of each half the segments go to one group for each content of the bytes that all
     strings which start in that half share. Halves that are still too large are halved again. In the end a column stands alone and
     its groups hold equal strings, so there is nothing left to construct.

A text that occurs twice is removed as a whole without being moved.

Defined results: a null text counts as empty; texts shorter than ``length`` lose nothing; equal texts of at least ``length`` bytes
lose everything, and so do repeated rows; a null doc_id is an id like others; an empty table gives an empty result; other columns
don't matter.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator
from contextlib import ExitStack
from functools import reduce
from pathlib import Path
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.llm import bloom
from sylva.llm.skew import join_counted
from sylva.session import in_worker, shared_table, ship

LENGTH, GRAM = 200, 48
PORTION = 1 << 18  # bytes hashed at a time, so that the arrays stay in the processor's cache; places in a portion take 24 bits
PLACES = 24
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)

_powers: dict[str, np.ndarray] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "n" not in _powers or len(_powers["n"]) < n:
        size = max(n, 2 * PORTION)
        for name, base in (("n", BASE), ("i", INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["n"][:n], _powers["i"][:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each run of width values: of prefix and suffix minima of blocks of that width."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    forward = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], forward[width - 1 : n])


def _portion_runs(data: bytes, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Segments of texts laid end to end: first start, number of starts, anchor place, anchor hash."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none
    b = np.frombuffer(data, np.uint8)
    power, inverse = _power_table(len(b) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((b + np.uint64(1)) * power[: len(b)])))
    h = _mix((total[gram:] - total[:-gram]) * inverse[: len(b) - gram + 1])
    low = np.uint64((1 << PLACES) - 1)
    least = _sliding_min((h & ~low) | np.arange(len(h), dtype=np.uint64), length - gram + 1)
    place = (least & low).astype(np.int64)
    start = np.arange(len(least))
    # starts whose string ends within its text: the first end at or after the start bounds it
    lens = np.diff(np.concatenate(([0], ends)))
    limit = np.repeat(ends, lens)[: len(least)]
    good = start + length <= limit
    new = np.ones(len(least), bool)
    new[1:] = (place[1:] != place[:-1]) | ~good[:-1]
    first = np.flatnonzero(new & good)
    if not len(first):
        return none, none, none, none
    stop = np.flatnonzero(np.concatenate((new[1:] | ~good[1:], [True])) & good)
    return first, stop - first + 1, place[first], h[place[first]].view(np.int64)


def runs_of(texts: list[bytes], length: int, gram: int, most: int = PORTION) -> Iterator[tuple[list[tuple[int, int]], bytes, np.ndarray, tuple[np.ndarray, ...]]]:
    """Texts in portions of about ``most`` bytes: (number of the text, offset in it) of each part, data, ends of the parts, and the runs.

    A text longer than a portion is cut into parts that overlap by length - 1 bytes, so that every string is in one part.
    """
    held, parts, size = [], [], 0

    def flush() -> tuple:
        data, ends = b"".join(held), np.cumsum([len(t) for t in held])
        return parts, data, ends, _portion_runs(data, ends, length, gram)

    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - length + 1), most):
            part = t[at : at + most + length - 1]
            if held and size + len(part) > most:
                yield flush()
                held, parts, size = [], [], 0
            held.append(part)
            parts.append((i, at))
            size += len(part)
    if held:
        yield flush()


def _bytes(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


def _anchors(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, _, (_, _, _, h) in runs_of(_bytes(b.column(0)), length, gram):
                if len(h):
                    yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64())], names=["h"])

    return run


def _own_anchors(length: int, gram: int):
    """Rows (d, n, text) to each text's different anchors: d, n, a, and whether it has it more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d, n = b.column(0).to_numpy(), b.column(1).to_numpy()
            for parts, _, ends, (start, _, _, h) in runs_of(_bytes(b.column(2)), length, gram):
                if len(h):
                    own = np.array([k for k, _ in parts])[np.searchsorted(ends, start, side="right")]
                    kinds, counts = np.unique(np.stack((own, h)), axis=1, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(d[kinds[0]]), pa.array(n[kinds[0]]), pa.array(kinds[1]), pa.array(counts > 1)], names=["d", "n", "a", "again"])

    return run


def _repeated_anchors(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """d, n, own: for each text (d, n) the anchors that occur in several places, if any. texts: d, n, text."""
    places = shared_table(texts.mapInArrow(in_worker("suffix_dedup", _own_anchors(length, gram)), "d bigint, n int, a bigint, again boolean"), "places")
    counts = places.groupBy("a").agg(F.count(F.lit(1)).alias("k"), F.max("again").alias("again")).where("again or k > 1").select("a", "k")
    held = join_counted(places, shared_table(counts, "repeated"), ["a"], "k", places.count())
    return held.groupBy("d", "n").agg(F.collect_set("a").alias("own"))


SEGMENT = "d bigint, n int, a bigint, g bigint, lead int, run int, starts array<int>, seg binary"


def _segments(filter_, bits: int, length: int, gram: int, remember: int = 100_000):
    """Segments with possibly repeated anchors: by the filter, or if there is none by each row's own list. Rows: d, n, text[, own].

    Of a text that the task has had, none; of a segment that it has had, no bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array, had, texts_had = np.frombuffer(filter_.value, np.uint8) if filter_ else None, set(), set()
        for b in batches:
            d, n = b.column(0).to_numpy(), b.column(1).to_numpy()
            listed = None if filter_ else np.unique(b.column(3).flatten().to_numpy())
            fresh = []
            for i, key in enumerate(zip(d.tolist(), n.tolist(), strict=True)):
                if key not in texts_had:
                    texts_had.add(key)
                    fresh.append(i)
            if len(texts_had) > remember:
                texts_had.clear()
            texts = _bytes(b.column(2).take(pa.array(fresh, pa.int32())))
            for parts, data, ends, (start, count, place, h) in runs_of(texts, length, gram):
                at = np.flatnonzero(np.isin(h, listed) if listed is not None else bloom.contained(array, bloom.positions(h, bits))) if len(h) else []
                if not len(at):
                    continue
                own = np.searchsorted(ends, start[at], side="right")
                begins = np.concatenate(([0], ends))
                rows: dict[tuple, list[int]] = {}
                for k, s, c, p, a in zip(own.tolist(), start[at].tolist(), count[at].tolist(), place[at].tolist(), h[at].tolist(), strict=True):
                    seg = data[s : s + c - 1 + length]
                    g = xxhash.xxh3_64_intdigest(seg, seed=p - s) - (1 << 63)
                    rows.setdefault((k, a, g, p - s, c), []).append(s)
                out: list[list] = [[] for _ in range(8)]
                for (k, a, g, lead, c), starts in rows.items():
                    i, offset = fresh[parts[k][0]], parts[k][1] - int(begins[k])
                    seg = None
                    if (a, g) not in had:
                        had.add((a, g))
                        seg = data[starts[0] : starts[0] + c - 1 + length]
                    for o, x in zip(out, (d[i], n[i], a, g, lead, c, [s + offset for s in starts], seg), strict=True):
                        o.append(x)
                if len(had) > remember:
                    had.clear()
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, types, strict=True)], names=[x.split()[0] for x in SEGMENT.split(", ")])

    return run


def _range_minima(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Minimum of x over [lo, hi] for each pair, by tables of minima of powers of two."""
    level = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
    tables, out = x, np.empty(len(lo), x.dtype)
    for k in range(int(level.max(initial=0)) + 1):
        if k:
            half = 1 << (k - 1)
            tables = np.minimum(tables[:-half], tables[half:])
        if len(at := np.flatnonzero(level == k)):
            out[at] = np.minimum(tables[lo[at]], tables[hi[at] - (1 << k) + 1])
    return out


def _read(f: BinaryIO, n: int, kind: type) -> np.ndarray:
    f.seek(0)
    return np.frombuffer(f.read(n * np.dtype(kind).itemsize), kind).copy() if n else np.zeros(0, kind)


def column_rounds(segments: list[bytes], leads: list[int], folder: str, length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """For each segment and column whether the string of ``length`` bytes that starts there is another segment's, too.

    leads: bytes before the anchor. Files: symbols (a column after the other, the last first), and of the latest round the order of
    the segments' suffixes, the symbols before them (the transform) and the common prefixes of neighbours.
    """
    m, before = len(segments), length - gram
    width = before + length
    start = before - np.array(leads, np.int64)
    end = start + np.array([len(s) for s in segments], np.int64)
    grid = np.frombuffer(b"".join(b"\0" * s + x + b"\0" * (width - e) for x, s, e in zip(segments, start.tolist(), end.tolist(), strict=True)), np.uint8).reshape(m, width)
    where = Path(folder)
    with open(where / "symbols", "wb") as f:
        f.write(np.ascontiguousarray(grid.T[::-1]).data)
    kept = 0  # entries in the files of the latest round
    by_end = np.argsort(end, kind="stable")
    ends = end[by_end]
    found = np.zeros((m, before + 1), bool)
    with ExitStack() as stack:
        symbols = stack.enter_context(open(where / "symbols", "rb", buffering=1 << 20))
        # Opened once and written over in place: cutting them to nothing each round would make the file system flush them each time.
        files = [(stack.enter_context(open(where / x, "w+b", buffering=0)), d) for x, d in (("order", np.uint32), ("transform", np.uint8), ("prefixes", np.uint8))]
        ahead = np.frombuffer(symbols.read(m), np.uint8)
        for t in range(width - 1, -1, -1):
            column, ahead = ahead, np.frombuffer(symbols.read(m), np.uint8) if t else None
            order, transform, lcp = (_read(f, kept, d) for f, d in files)
            if len(gone := np.flatnonzero(start[order] > t)):
                stay = np.delete(np.arange(len(order)), gone)
                if len(stay):
                    lcp = np.minimum.reduceat(lcp[: stay[-1] + 1], np.concatenate(([0], stay[:-1] + 1)))
                else:
                    lcp = lcp[:0]
                order, transform = order[stay], transform[stay]
            fresh = by_end[np.searchsorted(ends, t + 1) : np.searchsorted(ends, t + 2)].astype(np.uint32)
            if len(fresh):  # their suffixes were empty: they come before all others
                order, transform, lcp = np.concatenate((fresh, order)), np.concatenate((column[fresh], transform)), np.concatenate((np.zeros(len(fresh), np.uint8), lcp))
            kept = len(order)
            if not kept:
                continue
            lcp[0] = 0
            perm = np.argsort(transform, kind="stable")
            order, symbol = order[perm], transform[perm]
            same = np.flatnonzero(symbol[1:] == symbol[:-1]) + 1
            now = np.zeros(len(order), np.uint8)
            if len(same):
                now[same] = np.minimum(_range_minima(lcp, perm[same - 1] + 1, perm[same]), length - 1) + 1
            if t <= before:
                full = now == length
                full[:-1] |= full[1:]
                found[order[full], t] = True
            for (f, d), x in zip(files, (order, ahead[order] if t else symbol, now), strict=True):
                f.seek(0)
                f.write(np.ascontiguousarray(x, d).data)
    return found


def _intervals(flags: np.ndarray) -> list[dict[str, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0])))).tolist()
    return [{"t0": a, "t1": b - 1} for a, b in zip(edges[::2], edges[1::2], strict=True)]


MARK = "a bigint, g bigint, ivs array<struct<t0:int,t1:int>>"
_MARK = pa.list_(pa.struct([("t0", pa.int32()), ("t1", pa.int32())]))


def _construct(length: int, gram: int, batch: int = 20_000):
    """Rows of PART sorted by (a, sub): whole groups, batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            with tempfile.TemporaryDirectory(prefix="sylva-columns-") as folder:
                found = column_rounds([x[5] for x in held], [x[3] for x in held], folder, length, gram)
            rows = [(x[0], x[2], _intervals(f)) for x, f in zip(held, found, strict=True) if not x[4] and f.any()]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], _MARK)], names=["a", "g", "ivs"])

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if len(held) >= batch and row[:2] != held[-1][:2]:
                    yield flush()
                    held = []
                held.append(row)
        if held:
            yield flush()

    return run


def column_ranges(columns: int, level: int) -> list[tuple[int, int]]:
    """The columns in 2**level ranges of about one width, from and to; ranges without a column are left out."""
    edges = [columns * i >> level for i in range((1 << level) + 1)]
    return [(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True) if a < b]


PART = "a bigint, sub bigint, g bigint, lead int, whole boolean, seg binary"


def _halved(length: int, gram: int, level: int):
    """Rows of PART to the parts of their segments whose strings start in one range of the level; sub is the content that those strings share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = length - gram
        ranges = column_ranges(before + 1, level)
        for b in batches:
            out: list[list] = [[] for _ in range(6)]
            for a, _, g, lead, whole, seg in zip(*(c.to_pylist() for c in b.columns), strict=True):
                first = before - lead
                last = first + len(seg) - length
                for i, (lo, hi) in enumerate(ranges):
                    c0, c1 = max(lo, first), min(hi - 1, last)
                    if c0 > c1:
                        continue
                    sub = xxhash.xxh3_64_intdigest(seg[hi - 1 - first : lo + length - first], seed=i) - (1 << 63)
                    for o, x in zip(out, (a, sub, g, before - c0, whole, seg[c0 - first : c1 + length - first]), strict=True):
                        o.append(x)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, types, strict=True)], names=[x.split()[0] for x in PART.split(", ")])

    return run


def _in_groups(parts: DataFrame, length: int, gram: int, most: int) -> DataFrame:
    """a, g, ivs: columns in which segments of parts (PART, a table with sub = 0) have strings in common with others of their group."""
    marks, level, done = [], 0, column_ranges(length - gram + 1, 0)
    while True:
        sizes = shared_table(parts.groupBy("a", "sub").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"), "sizes")
        fit = parts.join(sizes.where(F.col("kinds") <= most).drop("kinds"), ["a", "sub"])
        marks.append(shared_table(fit.select(*[x.split()[0] for x in PART.split(", ")]).repartition("a", "sub").sortWithinPartitions("a", "sub").mapInArrow(in_worker("suffix_dedup", _construct(length, gram)), MARK), "marks"))
        large = sizes.where(F.col("kinds") > most)
        if not large.limit(1).count():
            return reduce(DataFrame.unionByName, marks)
        parts = shared_table(join_counted(parts, large, ["a", "sub"], "kinds", parts.count()), "large")
        if all(b - a == 1 for a, b in done):  # equal strings, each several segments'
            own = F.array(F.struct((F.lit(length - gram) - F.col("lead")).alias("t0"), (F.lit(length - gram) - F.col("lead")).alias("t1")))
            marks.append(parts.where("not whole").select("a", "g", own.alias("ivs")).distinct())
            return reduce(DataFrame.unionByName, marks)
        level += 1
        done = column_ranges(length - gram + 1, level)
        parts = shared_table(parts.mapInArrow(in_worker("suffix_dedup", _halved(length, gram, level)), PART), "halves")


def _split(filter_, bits: int, id_type: str):
    """Rows (doc_id, d, n, text, sha): the text stays only where a part may be removed; else the text's digest is taken."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = np.frombuffer(filter_.value, np.uint8)
        for b in batches:
            d = b.column(1).to_numpy()
            hit = bloom.contained(array, bloom.positions(d, bits)) if len(d) else []
            texts = _bytes(b.column(3))
            keep = [t if h else None for t, h in zip(texts, hit, strict=True)]
            sha = [None if h else hashlib.sha256(t).hexdigest() for t, h in zip(texts, hit, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(keep, pa.binary()), pa.array(sha, pa.string())], names=["doc_id", "d", "n", "text", "sha"])

    return run


def _merged(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(pairs):
        if out and s <= out[-1][1]:
            if e > out[-1][1]:
                out[-1] = (out[-1][0], e)
        else:
            out.append((s, e))
    return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        removed, spans, shas, kept = [], [], [], []
        for text, sha, ivs in zip(b.column(2), b.column(3), b.column(4), strict=True):
            if (text := text.as_py()) is None:
                runs = _merged([(x["s"], x["e"]) for x in ivs.as_py() or []])  # all or nothing
                sha = hashlib.sha256(b"").hexdigest() if runs else sha.as_py()
                kept.append(None)
            else:
                runs = _merged([(x["s"], x["e"]) for x in ivs.as_py() or []])
                at, parts = 0, []
                for s, e in runs:
                    parts.append(text[at:s])
                    at = e
                kept.append(b"".join([*parts, text[at:]]))
                sha = hashlib.sha256(kept[-1]).hexdigest()
            removed.append(sum(e - s for s, e in runs))
            spans.append(len(runs))
            shas.append(sha)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1).cast(pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(shas, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, most: int = 20_000, bits_per_anchor: int = 8, max_bits: int = 1 << 28) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): docs as doc_id, text, d, n; and for each text (d, n) with repeated strings the byte intervals ivs (s, e) to remove."""
    spark = docs.sparkSession
    ship(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).withColumns({"d": F.xxhash64("text"), "n": F.octet_length("text")})
    long_ = rows.where(F.col("n") >= length)
    total = long_.agg(F.sum("n")).first()[0] or 0
    anchors = int(total * 2 / (length - gram + 2))
    texts = long_.select("d", "n", "text")
    if bloom.slices(anchors, bits_per_anchor, max_bits) == 1:
        filter_, bits = bloom.repeated_filter(long_.select("text").mapInArrow(in_worker("suffix_dedup", _anchors(length, gram)), "h bigint"), bits_per_anchor, max_bits, anchors)
        filter_ = spark.sparkContext.broadcast(filter_)
    else:
        filter_, bits = None, 0
        texts = texts.join(_repeated_anchors(texts, length, gram), ["d", "n"])
    found = shared_table(texts.mapInArrow(in_worker("suffix_dedup", _segments(filter_, bits, length, gram)), SEGMENT), "segments")

    # The parts of a long text have rows of their own: places are told apart, not texts.
    seen = found.select("a", "g", F.xxhash64("d", "n", F.col("starts")[0]).alias("of"), (F.size("starts") > 1).alias("twice"))
    each = seen.groupBy("a", "g").agg(F.min("of").alias("lo"), F.max("of").alias("hi"), F.max("twice").alias("twice"), F.count(F.lit(1)).alias("k"))
    each = shared_table(each.select("a", "g", (F.col("twice") | (F.col("lo") < F.col("hi"))).alias("whole"), "k"), "counted")
    several = each.groupBy("a").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo < hi").select("a")
    several = each.join(several, "a").select("a", "g", "whole")
    parts = found.where("seg is not null").select("a", "g", "lead", "seg").join(several, ["a", "g"])
    parts = parts.groupBy("a", F.lit(0).cast("long").alias("sub"), "g").agg(*[F.first(c).alias(c) for c in ("lead", "whole", "seg")])  # tasks' copies are one
    built = _in_groups(shared_table(parts, "several"), length, gram, most)
    none = F.lit(None).cast("array<struct<t0:int,t1:int>>")
    marks = each.where("whole").select("a", "g", none.alias("ivs")).unionByName(built.groupBy("a", "g").agg(F.flatten(F.collect_list("ivs")).alias("ivs")))
    marks = shared_table(marks.join(each.select("a", "g", "k"), ["a", "g"]), "marked")

    own = join_counted(found.select("d", "n", "a", "g", "lead", "run", "starts"), marks, ["a", "g"], "k", found.count()).select("d", "n", "lead", "run", "ivs", F.explode("starts").alias("s"))
    shift = F.col("s") + F.col("lead") - (length - gram)
    spans = own.where("ivs is null").select("d", "n", F.col("s"), (F.col("s") + F.col("run") - 1 + length).alias("e"))
    spans = spans.unionByName(own.where("ivs is not null").select("d", "n", shift.alias("s0"), F.explode("ivs").alias("i")).select("d", "n", (F.col("s0") + F.col("i.t0")).alias("s"), (F.col("s0") + F.col("i.t1") + length).alias("e")))
    copies = long_.groupBy("d", "n").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("d", "n", F.lit(0).alias("s"), F.col("n").alias("e"))
    spans = spans.join(copies.select("d", "n"), ["d", "n"], "left_anti").unionByName(copies)
    return rows, shared_table(spans.groupBy("d", "n").agg(F.collect_set(F.struct("s", "e")).alias("ivs")), "spans")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, max_bits: int = 1 << 28, **parameters: int) -> DataFrame:
    """For every row: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    rows, spans = repeated_spans(docs, id_col, text_col, length, max_bits=max_bits, **parameters)
    partly = spans.where("not exists(ivs, x -> x.s = 0 and x.e = n)")
    filter_, bits = bloom.key_filter(partly.select("d"), max_bits=max_bits)
    kind = rows.schema["doc_id"].dataType.simpleString()
    split = rows.select("doc_id", "d", "n", "text").mapInArrow(in_worker("suffix_dedup", _split(docs.sparkSession.sparkContext.broadcast(filter_), bits, kind)), f"doc_id {kind}, d bigint, n int, text binary, sha string")
    joined = split.join(spans, ["d", "n"], "left").select("doc_id", "n", "text", "sha", "ivs")
    return joined.mapInArrow(in_worker("suffix_dedup", _cut), f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
