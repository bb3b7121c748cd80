"""Bloom filters of bounded size. All bits of a hash lie in one of CHUNKS parts, and every part is filled by one task.

What moves for that are the hashes, nine bytes each and equal ones of a batch once; no task sends whole arrays about. A table that needs
more bits than a filter may have is cut into slices by another hash of its keys, each with a filter of its own (:func:`slices`), so the
filter never gets denser as the table grows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylva.session import in_worker

HASHES = 4
CHUNKS = 256
ONE_TASK = 100_000  # up to so many hashes one task fills all parts


def _mixed(h: np.ndarray) -> np.ndarray:
    """Hashes that were chosen for being small are spread again."""
    h = h.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)
    h = (h ^ (h >> np.uint64(35))) * np.uint64(0x9FB21C651E98DF25)
    return h ^ (h >> np.uint64(28))


def _chunk(mixed: np.ndarray) -> np.ndarray:
    return mixed >> np.uint64(56)


def positions(h: np.ndarray, bits: int) -> np.ndarray:
    """HASHES bit positions for each 64-bit hash, by double hashing within its part; bits is a power of two."""
    h, part = _mixed(h), bits // CHUNKS
    step = ((h >> np.uint64(24)) & np.uint64(0xFFFFFFFF)) | np.uint64(1)
    within = (h[:, None] + step[:, None] * np.arange(HASHES, dtype=np.uint64)) & np.uint64(part - 1)
    return (_chunk(h)[:, None] * np.uint64(part) + within).astype(np.int64)


def contained(array: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ((array[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)


def _set(array: np.ndarray, at: np.ndarray) -> None:
    at = at.ravel()
    np.bitwise_or.at(array, at >> 3, np.left_shift(np.uint8(1), (at & 7).astype(np.uint8)))


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The different hashes of each batch, and which of them it has several times."""
    for b in batches:
        h, n = np.unique(b.column(0).to_numpy(), return_counts=True)
        yield h, n > 1


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for h, many in _hashes(batches):
        yield pa.RecordBatch.from_arrays([pa.array(_chunk(_mixed(h)).astype(np.int32)), pa.array(h), pa.array(many)], names=["chunk", "h", "many"])


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for b in batches:
        h, where, n = np.unique(b.column(1).to_numpy(), return_inverse=True, return_counts=True)
        many = n > 1
        many[where[b.column(2).to_numpy(zero_copy_only=False)]] = True
        yield h, many


def _build(bits: int, read):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # pages of other tasks' parts are never touched, so they take no memory
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for h, many in read(batches):
            if len(h):
                at = positions(h, bits)
                _set(twice, at[many | contained(once, at)])
                _set(once, at)
        size = bits // 8 // CHUNKS
        for c in range(CHUNKS):
            if (part := once[c * size : (c + 1) * size]).any():
                yield pa.RecordBatch.from_pydict({"chunk": pa.array([c], pa.int32()), "once": [zlib.compress(part.tobytes(), 1)], "twice": [zlib.compress(twice[c * size : (c + 1) * size].tobytes(), 1)]})

    return build


def slices(n: int, bits_per_row: int, max_bits: int) -> int:
    """How many filters of at most max_bits n keys take."""
    return max(1, -(-n * bits_per_row // max_bits))


def slice_of(h: Column, k: int) -> Column:
    """The slice of a key's hash, of k; independent of its places in a filter."""
    return F.pmod(F.xxhash64(h, F.lit(k)), F.lit(k)).cast("int")


def _filter(hashes: DataFrame, column: str, n: int | None, bits_per_row: int, max_bits: int) -> tuple[bytes, int]:
    n = hashes.count() if n is None else n
    bits = min(max_bits, 1 << max(17, (max(1, n) * bits_per_row - 1).bit_length()))
    schema = "chunk int, once binary, twice binary"
    if n <= ONE_TASK:
        parts = hashes.coalesce(1).mapInArrow(in_worker("bloom", _build(bits, _hashes)), schema)
    else:
        dealt = hashes.mapInArrow(in_worker("bloom", _dealt), "chunk int, h bigint, many boolean").repartition("chunk")
        parts = dealt.mapInArrow(in_worker("bloom", _build(bits, _gathered)), schema)
    out, size = np.zeros(bits // 8, np.uint8), bits // 8 // CHUNKS
    for row in parts.select("chunk", F.col(column).alias("data")).collect():  # max_bits in all
        out[row.chunk * size : (row.chunk + 1) * size] = np.frombuffer(zlib.decompress(bytes(row.data)), np.uint8)
    return out.tobytes(), bits


def repeated_filter(hashes: DataFrame, bits_per_row: int = 16, max_bits: int = 1 << 28, n: int | None = None) -> tuple[bytes, int]:
    """The bits of hashes that occur at least twice, and their number. hashes: one bigint column; n: about how many, if known."""
    return _filter(hashes, "twice", n, bits_per_row, max_bits)


def key_filter(hashes: DataFrame, bits_per_row: int = 16, max_bits: int = 1 << 28, n: int | None = None) -> tuple[bytes, int]:
    """The bits of all hashes, and their number."""
    return _filter(hashes, "once", n, bits_per_row, max_bits)


def _flag(filter_, bits: int, column: str):
    def flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = np.frombuffer(filter_.value, np.uint8)
        for b in batches:
            at = b.schema.get_field_index(column)
            h = b.column(at).to_numpy()
            hit = contained(array, positions(h, bits)) if len(h) else np.zeros(0, bool)
            columns = b.columns
            columns[at] = pa.array(hit)
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names)

    return flag


def with_flag(df: DataFrame, filter_: bytes, bits: int, column: str) -> DataFrame:
    """df with its bigint hash column replaced by whether the hash is possibly repeated."""
    schema = df.schema
    types = ", ".join(f"`{f.name.replace('`', '``')}` {'boolean' if f.name == column else f.dataType.simpleString()}" for f in schema)
    return df.mapInArrow(in_worker("bloom", _flag(df.sparkSession.sparkContext.broadcast(filter_), bits, column)), types)
