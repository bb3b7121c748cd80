"""Quality by compression: zstandard dictionaries of good and of bad text; the normalised size difference, calibrated.

Two dictionaries are built from samples of good and bad labelled text. A text is cut into blocks of ``block`` bytes, so that a long
text is as much in need of a dictionary as a short one, and every block is compressed with either dictionary. The score's one
feature is (size with the bad one - size with the good one) / (bytes of the text); a logistic function fitted on other labelled rows
turns it into a probability, shifted to the true share of good labels.

Fitting reads at most ``sample`` labelled rows of each class for the dictionaries and as many again for the calibration, chosen by a
hash of the id, and of a text at most ``most_bytes`` bytes in blocks spread evenly over it; that bounds what reaches the driver.
Scoring reads every whole text. Labels, ids and other columns are never inputs of a score.

Defined results: null and empty texts get the share of good labels as their score; labels of null ids or null quality don't count;
of several rows of one id fitting takes the least text, and of its labels each value once; without labels of both classes, every score is that share (1 if there are no labels);
repeated rows are all scored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylva.session import in_worker, ship

LEVEL = 3


def held_out(id_: Column) -> Column:
    """Whether a row is kept from learning: crc32 of the id as text, modulo 5, is 0. A null id is kept from it."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def blocks_of(text: bytes, block: int) -> list[bytes]:
    """The whole text in blocks; a short rest joins the last."""
    n = max(1, len(text) // block)
    return [text[i * block : (i + 1) * block if i < n - 1 else len(text)] for i in range(n)]


@dataclass
class Model:
    good: bytes
    bad: bytes
    slope: float
    offset: float
    share: float  # of good labels
    block: int


class Scorer:
    def __init__(self, model: Model) -> None:
        self.model = model
        if model.good and model.bad:
            self.compressors = []
            for d in (model.good, model.bad):
                dictionary = zstandard.ZstdCompressionDict(d)
                dictionary.precompute_compress(level=LEVEL)
                self.compressors.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=False, write_content_size=False, write_dict_id=False))

    def feature(self, text: bytes) -> float:
        parts = blocks_of(text, self.model.block)
        good, bad = (sum(len(c.compress(p)) for p in parts) for c in self.compressors)
        return (bad - good) / len(text)

    def score(self, text: str | None) -> float:
        if not text or not (self.model.good and self.model.bad):
            return self.model.share
        z = self.model.slope * self.feature(text.encode("utf-8", "surrogatepass")) + self.model.offset
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _spread(text: str, block: int, most: int) -> bytes:
    """The text, or blocks spread evenly over it that make up ``most`` bytes."""
    data = text.encode("utf-8", "surrogatepass")
    if len(data) <= most:
        return data
    parts = blocks_of(data, block)
    return b"".join(parts[i] for i in np.linspace(0, len(parts) - 1, most // block).astype(int))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and offset by Newton's method, with a small penalty that keeps separable data finite."""
    scale = float(np.std(x)) or 1.0
    a = np.column_stack([x / scale, np.ones(len(x))])
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = a.T @ (a * (p * (1 - p))[:, None]) + ridge * len(x) * np.diag([1.0, 1e-6])
        step = np.linalg.solve(h, a.T @ (y - p) - ridge * len(x) * np.array([w[0], 0.0]))
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 1500, most_bytes: int = 16_384, block: int = 512, dictionary_bytes: int = 32_768) -> Model:
    ship(docs.sparkSession)
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)").where(~held_out(F.col("id")))
    counts = {r.y: r.n for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    share = counts.get(1, 0) / total if total else 1.0
    empty = Model(b"", b"", 0.0, 0.0, share, block)
    if len(counts) < 2:
        return empty
    ranked = known.withColumn("h", F.xxhash64("id", F.lit(17)))
    # 2 * sample labels of each class at most: a bounded broadcast
    chosen = ranked.where("y = 1").orderBy("h", "id").limit(2 * sample).unionByName(ranked.where("y = 0").orderBy("h", "id").limit(2 * sample))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null and text != ''").join(F.broadcast(chosen), "id")
    # an id may have many rows: its least text counts, so no more than the chosen labels reach the driver
    texts = texts.groupBy("id", "y", "h").agg(F.min("text").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = [_spread(t, block, most_bytes) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(data, pa.binary())], names=["y", "h", "data"])

    rows = texts.select("y", "h", "text").mapInArrow(cut, "y int, h bigint, data binary").toLocalIterator()
    rows = sorted((r.y, r.h, bytes(r.data)) for r in rows)
    halves: dict[tuple[int, int], list[bytes]] = {(y, k): [] for y in (0, 1) for k in (0, 1)}
    for i, (y, _, data) in enumerate(rows):
        halves[y, i % 2].append(data)
    if any(len(v) < 4 for v in halves.values()):
        return empty
    made = {}
    for y in (0, 1):
        pieces = [p for t in halves[y, 0] for p in blocks_of(t, block)]
        try:
            made[y] = zstandard.train_dictionary(min(dictionary_bytes, max(4096, sum(map(len, pieces)) // 8)), pieces).as_bytes()
        except zstandard.ZstdError:  # too little to train on: its last bytes serve as the dictionary
            made[y] = b"".join(pieces)[-dictionary_bytes:]
    model = Model(made[1], made[0], 0.0, 0.0, share, block)
    scorer = Scorer(model)
    x = np.array([scorer.feature(t) for y in (0, 1) for t in halves[y, 1]])
    target = np.array([y for y in (0, 1) for _ in halves[y, 1]], float)
    model.slope, offset = _logistic(x, target)
    drawn = float(target.mean())
    model.offset = offset + math.log(share / (1 - share)) - math.log(drawn / (1 - drawn))
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """For every row: doc_id, held_out, score, predicted."""
    ship(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            s = [scorer.score(x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.float64()), pa.array([int(x >= threshold) for x in s], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    return base.mapInArrow(in_worker("quality", run), f"doc_id {base.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of docs that score at least threshold, all columns as they were."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            at = b.schema.get_field_index(text_col)
            yield b.filter(pa.array([scorer.score(x.as_py()) >= threshold for x in b.column(at)], pa.bool_()))

    return docs.mapInArrow(in_worker("quality", run), docs.schema)
