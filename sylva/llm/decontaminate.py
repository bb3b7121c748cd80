"""Benchmark decontamination: a broadcast hash set of test n-grams, scanned over the token windows of every document.

Words are runs of ASCII letters and digits and of all non-ASCII characters; A-Z is lower-cased. A window is ``n`` consecutive words
of an item; an item of fewer words, but not none, is one window. Words of a document that no item has break its windows at once;
the rest become numbers, a rolling hash of each window probes the sorted hashes of the benchmark's windows, and every hit is
verified word by word against the windows with that hash.

The benchmark is broadcast in blocks of at most ``block_words`` words and ``block_bytes`` bytes of words (the proven bound), counted as
the windows count them; an item longer than a block is cut into parts that overlap by n - 1 words, so each window is in one. With several
blocks each is loaded, used for a batch of documents and dropped, so memory does not grow with the benchmark.

Defined results: a null text has no words; items without words have no windows; items of equal id count as one, and a null item id
marks words but is not listed; repeated rows are all reported; with an empty benchmark nothing is hit; other columns don't matter.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.session import in_worker, ship

#: Bytes to what they count as: letters lower-cased, digits and non-ASCII bytes as they are, all others a blank.
TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def _split(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


@dataclass
class Block:
    """Windows of some items. vocab: word to number from 1; by_length: for each window length its sorted hashes and the windows' ids; items: for each window the items that have it."""

    vocab: dict[bytes, int] = field(default_factory=dict)
    by_length: dict[int, tuple[np.ndarray, list[int]]] = field(default_factory=dict)
    windows: list[tuple[int, ...]] = field(default_factory=list)
    items: list[list[int]] = field(default_factory=list)
    names: list[str | None] = field(default_factory=list)


def _hash(ids: np.ndarray, n: int) -> np.ndarray:
    """Hash of each window of n ids, wrapping at 64 bits."""
    h = np.zeros(len(ids) - n + 1, np.uint64)
    for i in range(n):
        h = h * BASE + ids[i : len(ids) - n + 1 + i].astype(np.uint64)
    return h


def build_block(items: list[tuple[str | None, list[bytes]]], n: int) -> Block:
    """items: names and words; an item may come in several parts."""
    block, seen, found = Block(), {}, {}
    for name, words in items:
        block.names.append(name)
        ids = [block.vocab.setdefault(w, len(block.vocab) + 1) for w in words]
        for at in range(max(1, len(ids) - n + 1)):
            w = tuple(ids[at : at + n])
            if w not in seen:
                seen[w] = len(block.windows)
                block.windows.append(w)
                block.items.append([])
                found.setdefault(len(w), []).append(seen[w])
            if (own := block.items[seen[w]])[-1:] != [len(block.names) - 1]:
                own.append(len(block.names) - 1)
    for length, numbers in found.items():
        h = np.array([_hash(np.array(block.windows[k]), length)[0] for k in numbers], np.uint64)
        order = np.argsort(h, kind="stable")
        block.by_length[length] = (h[order], [numbers[k] for k in order])
    return block


def scan(words: list[bytes], block: Block, hit: np.ndarray, items: set) -> None:
    """Marks the words that windows of the block cover, and adds the names of their items."""
    ids = np.fromiter(map(block.vocab.get, words, [0] * len(words)), np.int64, len(words))
    for length, (hashes, numbers) in block.by_length.items():
        if len(ids) < length:
            continue
        known = np.concatenate(([0], np.cumsum(ids == 0)))
        starts = np.flatnonzero(known[length:] == known[:-length])  # windows without a foreign word
        if not len(starts):
            continue
        h = _hash(ids, length)[starts]
        at = np.searchsorted(hashes, h)
        for s, k in zip(starts[(ok := (at < len(hashes)) & (hashes[np.minimum(at, len(hashes) - 1)] == h))].tolist(), at[ok].tolist(), strict=True):
            own, value = tuple(ids[s : s + length].tolist()), hashes[k]
            while k < len(hashes) and hashes[k] == value:
                if block.windows[numbers[k]] == own:
                    hit[s : s + length] = True
                    items.update(block.names[i] for i in block.items[numbers[k]])
                k += 1


def _parts(words: list[bytes], n: int, most: int, most_bytes: int) -> Iterator[list[bytes]]:
    """The words in parts within both bounds (but of n words at least), each window of n words in one; of fewer words, one part."""
    at, step, size = 0, 0, 0
    while at < len(words):
        step = size = 0
        while at + step < len(words) and (step < n or step < most and size + len(words[at + step]) <= most_bytes):
            size += len(words[at + step])
            step += 1
        yield words[at : at + step]
        if at + step == len(words):
            return
        at += step - n + 1


def _broadcast(benchmark: DataFrame, item_col: str, text_col: str, n: int, block_words: int, block_bytes: int) -> list:
    sc, blocks, held, size, weight = benchmark.sparkSession.sparkContext, [], [], 0, 0

    def flush() -> None:
        nonlocal held, size, weight
        blocks.append(sc.broadcast(pickle.dumps(build_block(held, n))))
        held, size, weight = [], 0, 0

    for name, text in benchmark.select(F.col(item_col).cast("string"), F.col(text_col)).toLocalIterator():
        for part in _parts(_split((text or "").encode("utf-8", "surrogatepass")), n, block_words, block_bytes):
            more = sum(map(len, part))
            if held and (size + len(part) > block_words or weight + more > block_bytes):
                flush()
            held.append((name, part))
            size, weight = size + len(part), weight + more
    if held:
        flush()
    return blocks


def _blocks(broadcasts: list) -> Iterator[Block]:
    if len(broadcasts) == 1:
        yield pickle.loads(broadcasts[0].value)
        return
    for b in broadcasts:
        with open(b._path, "rb") as f:  # not kept: one block at a time
            yield pickle.loads(b.load(f))


def _each(broadcasts: list, texts: list[bytes], held: list) -> Iterator[tuple[bytes, list[bytes], np.ndarray, set]]:
    split = [_split(t) for t in texts]
    hits, items = [np.zeros(len(w), bool) for w in split], [set() for _ in split]
    if len(broadcasts) == 1 and not held:
        held.extend(_blocks(broadcasts))
    for block in held or _blocks(broadcasts):
        for w, h, s in zip(split, hits, items, strict=True):
            if w:
                scan(w, block, h, s)
    yield from zip(texts, split, hits, items, strict=True)


def _portions(column: pa.Array, most: int = 4 << 20) -> Iterator[list[bytes]]:
    """Texts of a batch as bytes, some megabytes at a time."""
    held, size = [], 0
    for x in column:
        t = (x.as_py() or "").encode("utf-8", "surrogatepass")
        held.append(t)
        size += len(t)
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = 10, block_words: int = 1_000_000, block_bytes: int = 64 << 20) -> DataFrame:
    """For every row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items, spans (of words, as start:end)."""
    ship(docs.sparkSession)
    blocks = _broadcast(benchmark, item_col, item_text_col, n, block_words, block_bytes)
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one: list = []
        for b in batches:
            out: list[list] = [[] for _ in range(7)]
            for texts in _portions(b.column(1)):
                for _, words, hit, items in _each(blocks, texts, one):
                    named = sorted(x for x in items if x is not None)
                    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0])))).tolist() if hit.any() else []
                    row = (len(words), int(hit.sum()), len(named), hashlib.sha256(",".join(named).encode()).hexdigest(), bool(edges), named, [f"{s}:{e}" for s, e in zip(edges[::2], edges[1::2], strict=True)])
                    for o, x in zip(out, row, strict=True):
                        o.append(x)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(o, t) for o, t in zip(out, types, strict=True))], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "spans"])

    kind = base.schema["doc_id"].dataType.simpleString()
    return base.mapInArrow(in_worker("decontaminate", run), f"doc_id {kind}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, items array<string>, spans array<string>")


def _cut(text: bytes, words: list[bytes], hit: np.ndarray) -> str:
    """The text without the runs of hit words; what stood between the first and last word of a run goes too."""
    plain, keep, at, start = text.translate(TABLE), [], 0, 0
    k = 0
    while k < len(words):
        begin = plain.index(words[k], at)
        if not hit[k]:
            at = begin + len(words[k])
            k += 1
            continue
        keep.append(text[start:begin])
        while k < len(words) and hit[k]:
            at = plain.index(words[k], at) + len(words[k])
            k += 1
        start = at
    return b"".join([*keep, text[start:]]).decode("utf-8", "surrogatepass")


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = 10, drop_at: float = 0.5, length_col: str | None = None, block_words: int = 1_000_000, block_bytes: int = 64 << 20) -> DataFrame:
    """docs without the hit spans; a document of which at least ``drop_at`` of the words are hit goes as a whole.

    All columns stay as they were but the text, and length_col, which gets the new number of characters where a span was cut.
    """
    ship(docs.sparkSession)
    blocks = _broadcast(benchmark, item_col, item_text_col, n, block_words, block_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one: list = []
        for b in batches:
            at = b.schema.get_field_index(text_col)
            texts, keep, lengths = b.column(at).to_pylist(), [], {}
            k = 0
            for portion in _portions(b.column(at)):
                for text, words, hit, _ in _each(blocks, portion, one):
                    keep.append(not hit.any() or hit.sum() < drop_at * len(words))
                    if keep[-1] and hit.any():
                        texts[k] = _cut(text, words, hit)
                        lengths[k] = len(texts[k])
                    k += 1
            columns = list(b.columns)
            columns[at] = pa.array(texts, b.schema.field(at).type)
            if length_col is not None and lengths:
                i = b.schema.get_field_index(length_col)
                columns[i] = pa.array([lengths.get(j, x) for j, x in enumerate(columns[i].to_pylist())], b.schema.field(i).type)
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names).filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(in_worker("decontaminate", run), docs.schema)


#: Windows of every length are cut from lists of words; an item of fewer than ten words is one window.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
p AS (SELECT k, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT k, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n)),
h AS (SELECT k, i, p.n, item_id FROM p JOIN bw ON p.n = bw.n AND p.g = bw.g),
c AS (SELECT k, count(DISTINCT x) AS n_hit FROM (SELECT k, unnest(range(i, i + n)) AS x FROM h) GROUP BY k),
t AS (SELECT k, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT k, item_id::VARCHAR AS s FROM h) GROUP BY k)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (k) LEFT JOIN t USING (k)
"""
