"""Whitening of embeddings: covariance by column aggregates, components by LAPACK.

Entries become whole numbers x = floor(64 * c) + 1000000 (``SCALE``, ``SHIFT``), written once as a table. One aggregation sums every
dimension, the next one sums the centred products of every pair of dimensions of the upper triangle, as generated Spark SQL expressions;
what reaches the driver is one number a pair, whatever the number of rows. LAPACK decomposes the covariance there. A last aggregation of
the same kind, over the whitened values themselves, measures how far their covariance is from the identity.

Up to ``pairs_at_once`` pairs are one aggregation (64 dimensions have 2,080); more dimensions take several over the same table.

Defined results: rows whose vector is null or holds a null, NaN or infinite entry are dropped, a null id is kept as it is, repeated rows are
kept and fitted as often as they occur. Vectors of another length than the most common one (the longer, if equally many) lie in another
space and are dropped. Directions without variance (an eigenvalue of at most d * 2^-52 of the largest) can't be whitened and are no
components; so one vector, or equal ones, give no rows, as an empty table does. deviation is exact; where it exceeds a long it is null.
An entry above 10^17 exceeds what x can hold and is an error. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.session import in_worker, shared_table, ship

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32


@dataclass
class Model:
    n: int
    sums: np.ndarray  # long, of x by dimension
    eigenvalues: np.ndarray  # falling, of the components
    components: np.ndarray  # a column each, of length 1
    trace: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([int(s) / self.n for s in self.sums])

    @property
    def projection(self) -> np.ndarray:
        return self.components / np.sqrt(self.eigenvalues)


def whole(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, int]:
    """The table (vec_id, x) of all vectors that remain, and their length."""
    v = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where("v is not null")
    v = v.where("forall(v, c -> c is not null and not isnan(c) and abs(c) < double('Infinity'))")
    far = F.expr("exists(v, c -> abs(c) > 1e17)")
    x = F.when(far, F.raise_error(F.lit("an entry of a vector exceeds 1e17"))).otherwise(F.expr(f"transform(v, c -> cast(floor({SCALE} * c) as bigint) + {SHIFT})"))
    table = shared_table(v.select("vec_id", x.cast("array<bigint>").alias("x")), "whole")
    common = table.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return (table.where(F.size("x") == common.d), common.d) if common else (table, 0)


def products(rows: DataFrame, columns: list[str], pairs_at_once: int = 4096) -> np.ndarray:
    """The sums of the products of every two columns, which are doubles and centred, as a symmetric matrix."""
    d = len(columns)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    out = np.zeros((d, d))
    for k in range(0, len(pairs), pairs_at_once):
        some = pairs[k : k + pairs_at_once]
        sums = rows.selectExpr(*[f"sum({columns[i]} * {columns[j]}) as p{i}_{j}" for i, j in some]).first()
        for (i, j), s in zip(some, sums, strict=True):
            out[i, j] = out[j, i] = s
    return out


def fit(table: DataFrame, d: int, most: int = COMPONENTS, pairs_at_once: int = 4096) -> Model:
    """The model of a table of :func:`whole`."""
    row = table.selectExpr("count(*) as n", *[f"coalesce(sum(x[{i}]), 0) as s{i}" for i in range(d)]).first()
    n, sums = row[0], np.array(row[1:], np.int64)
    model = Model(n, sums, np.zeros(0), np.zeros((d, 0)), 0.0)
    if not n or not d:
        return model
    # nothing is null here; saying so halves the code that Spark generates for the sums
    centred = table.selectExpr(*[f"coalesce(x[{i}] - double('{m!r}'), 0D) as c{i}" for i, m in enumerate(map(float, model.mean))])
    covariance = products(centred, [f"c{i}" for i in range(d)], pairs_at_once) / n
    e, v = np.linalg.eigh(covariance)
    e, v = e[::-1], v[:, ::-1]
    rank = int((e > max(e[0], 0.0) * d * 2.0**-52).sum())
    model.eigenvalues, model.components, model.trace = e[: min(rank, most)], v[:, : min(rank, most)], float(np.trace(covariance))
    return model


def whiten(table: DataFrame, model: Model) -> DataFrame:
    """vec_id, deviation (sum over dimensions of (n * x - S)^2), whitened (an array, a component each)."""
    ship(table.sparkSession)
    shared = table.sparkSession.sparkContext.broadcast((model.n, model.sums, model.mean, model.projection))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, mean, projection = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(1).flatten().to_numpy().reshape(b.num_rows, -1)
            far = x * np.int64(n) - sums  # modulo 2^64, as is the sum of squares: exact where that fits a long
            size = ((x - mean) ** 2).sum(axis=1) * float(n) ** 2
            y = (x - mean) @ projection
            whitened = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * y.shape[1], pa.int32()), pa.array(y.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array((far * far).sum(axis=1), mask=size >= 2.0**63), whitened], names=["vec_id", "deviation", "whitened"])

    kind = table.schema["vec_id"].dataType.simpleString()
    return table.mapInArrow(in_worker("whitening", run), f"vec_id {kind}, deviation bigint, whitened array<double>")


def identity_error(whitened: DataFrame, n: int, k: int, pairs_at_once: int = 4096) -> float:
    """The largest absolute entry of the whitened values' covariance minus the identity."""
    if not k:
        return 0.0
    sums = whitened.selectExpr(*[f"sum(whitened[{i}]) as s{i}" for i in range(k)]).first()
    centred = whitened.selectExpr(*[f"coalesce(whitened[{i}] - double('{s / n!r}'), 0D) as w{i}" for i, s in enumerate(sums)])
    return float(np.abs(products(centred, [f"w{i}" for i in range(k)], pairs_at_once) / n - np.eye(k)).max())


def report(vectors: DataFrame, most: int = COMPONENTS, **columns: str) -> DataFrame:
    """One row per remaining vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    table, d = whole(vectors, **columns)
    model = fit(table, d, most)
    k = len(model.eigenvalues)
    done = whiten(table, model) if k else table.selectExpr("vec_id", "cast(null as bigint) as deviation", "cast(array() as array<double>) as whitened")
    error = identity_error(done, model.n, k)
    shares = f"array({', '.join(f"double('{float(e / model.trace)!r}')" for e in model.eigenvalues)})" if k else "cast(array() as array<double>)"
    rows = done.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.selectExpr("vec_id", "at + 1 as component", f"cast({model.n} as bigint) as n", "deviation", "whitened", f"{shares}[at] as explained", f"double('{error!r}') as identity_error")
