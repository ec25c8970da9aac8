"""Embedding whitening by hierarchical SVD merging.

Each partition of vectors is summed up by its number of rows, its sums, and the full-rank factor
R = diag(s) Vt of its centred rows (all singular values and right vectors). Two summaries merge
without loss: the rows of both factors and one mean-correction row,
sqrt(n1 n2 / (n1 + n2)) (m1 - m2), are stacked and decomposed again, so that always
R' R = sum of (v - mean)' (v - mean) over all rows below. A task merges its own blocks of rows, then
summaries merge FAN at a time in the order of their partitions, in as many rounds as their number
has digits to that base; only the last one, of dims x dims, comes to the driver. Nothing is squared
before it is decomposed, so components and variances have double precision.

Vectors are taken relative to one of them (``origin``), so a large common offset costs no digits, and
sums of integers are exact up to 2**53.

Defined results: rows whose vector is null, or holds a null or an entry that is not finite, are left
out, and so are vectors of another length than the most common one (ties: the longer). Rows repeated count as
often as they stand; a null id is carried along. Directions without variance (an eigenvalue of at most
1e-12 of the largest) cannot be scaled to one and are no components, so a table of one row, or of equal
rows, has none and gives no rows, as does an empty table. Components are numbered from 1 by falling
variance; of both signs the one whose largest entry is positive is taken. Other columns are ignored, or
carried along when named in ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType

from .common import cut_small

FAN = 16  # summaries merged by a task
ROWS = 4096  # rows decomposed at once
FLAT = 1e-12  # least share of the largest eigenvalue
SUMMARY = "part bigint, n bigint, total binary, factor binary"


@dataclass
class Summary:
    """n rows, their sums relative to the origin, and the factor of the centred rows."""

    n: int
    total: np.ndarray
    factor: np.ndarray

    @classmethod
    def of(cls, rows: np.ndarray) -> Summary:
        total = rows.sum(0)
        return cls(len(rows), total, _reduced(rows - total / len(rows)))

    def merge(self, other: Summary) -> Summary:
        n = self.n + other.n
        gap = (self.total * other.n - other.total * self.n) / (self.n * other.n)
        row = np.sqrt(self.n * (other.n / n)) * gap
        return Summary(n, self.total + other.total, _reduced(np.vstack([self.factor, other.factor, row])))

    def row(self, part: int) -> pa.RecordBatch:
        cols = [pa.array([part]), pa.array([self.n]), pa.array([self.total.tobytes()], pa.binary()), pa.array([self.factor.tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays(cols, ["part", "n", "total", "factor"])

    @classmethod
    def read(cls, n: int, total: bytes, factor: bytes) -> Summary:
        t = np.frombuffer(total)
        return cls(n, t, np.frombuffer(factor).reshape(-1, len(t)))


def _reduced(rows: np.ndarray) -> np.ndarray:
    """diag(s) Vt of ``rows``, all of it."""
    _, s, vt = np.linalg.svd(rows, full_matrices=False)
    return s[:, None] * vt


@dataclass
class Whitening:
    """components: (rank, dims) unit rows by falling ``values``, the variances with divisor n."""

    n: int
    origin: np.ndarray
    total: np.ndarray
    components: np.ndarray
    values: np.ndarray
    trace: float

    def sums(self) -> list[int]:
        """Sums of all vectors of integers, exact."""
        return [int(o) * self.n + int(t) for o, t in zip(self.origin, self.total, strict=True)]

    def covariance(self) -> np.ndarray:
        return (self.components.T * self.values) @ self.components


def finite(column: Column) -> Column:
    """Whether a vector is not null and has finite entries only."""
    x = column.cast("array<double>")
    return column.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))


def usable(df: DataFrame, column: str) -> tuple[DataFrame, np.ndarray | None]:
    """The rows that take part, and one of their vectors (None: there is none)."""
    own = df.filter(F.coalesce(finite(F.col(column)), F.lit(False)))
    size = F.size(column)
    common = own.groupBy(size.alias("dims")).agg(F.count("*").alias("n"), F.first(F.col(column).cast("array<double>")).alias("v"))
    top = common.orderBy(F.desc("n"), F.desc("dims")).first()
    return (own, None) if top is None else (own.filter(size == top["dims"]), np.array(top["v"], float))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dims)


def summarised(rows: DataFrame, column: str, origin: np.ndarray) -> Summary | None:
    """One summary of all rows, merged FAN at a time."""
    dims = len(origin)

    def partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting, n = None, [], 0

        def added() -> Summary:
            block = Summary.of(np.vstack(waiting))
            return block if held is None else held.merge(block)

        for b in batches:
            x = matrix(b.column(0), dims) - origin
            for at in range(0, len(x), ROWS):
                waiting.append(x[at : at + ROWS])
                n += len(waiting[-1])
                if n >= ROWS:
                    held, waiting, n = added(), [], 0
        if n:
            held = added()
        if held is not None:
            yield held.row(TaskContext.get().partitionId())

    def merged(table: pa.Table) -> pa.Table:
        out, rows = None, table.sort_by("part").to_pylist()
        for r in rows:
            one = Summary.read(r["n"], r["total"], r["factor"])
            out = one if out is None else out.merge(one)
        return pa.Table.from_batches([out.row(rows[0]["part"] // FAN)])

    level = cut_small(rows.select(F.col(column).cast("array<double>")).mapInArrow(partition, SUMMARY))
    while True:
        found = level.limit(2).collect()
        if len(found) < 2:
            return Summary.read(*found[0][1:]) if found else None
        level = cut_small(level.groupBy(F.floor(F.col("part") / FAN).alias("to")).applyInArrow(merged, SUMMARY))


def fit(vectors: DataFrame, column: str = "embedding") -> Whitening | None:
    """The principal directions of all usable vectors and their variances; None if there are no vectors."""
    rows, origin = usable(vectors, column)
    if origin is None or not len(origin):
        return None
    return _fitted(rows, column, origin)


def _fitted(rows: DataFrame, column: str, origin: np.ndarray) -> Whitening | None:
    s = summarised(rows, column, origin)
    if s is None:
        return None
    _, values, vt = np.linalg.svd(s.factor, full_matrices=False)
    values = values * values / s.n
    real = values > FLAT * max(values.max(initial=0.0), np.finfo(float).tiny)
    vt = vt[real]
    vt = vt * np.sign(vt[np.arange(len(vt)), np.abs(vt).argmax(1)])[:, None]
    return Whitening(s.n, origin, s.total, vt, values[real], float(values.sum()))


def whiten(vectors: DataFrame, model: Whitening, k: int, column: str = "embedding", keep: list[str] | None = None) -> DataFrame:
    """``keep`` and __whitened: array<double>, the first ``k`` components of each usable vector, scaled to variance one."""
    dims, origin = len(model.origin), model.origin
    scaled = (model.components[:k] / np.sqrt(model.values[:k])[:, None]).T
    shift, n = model.total, model.n
    own = [F.col(c) for c in keep or []]
    rows = vectors.filter(F.coalesce(finite(F.col(column)) & (F.size(column) == dims), F.lit(False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                x = (n * (matrix(b.column(b.num_columns - 1), dims) - origin) - shift) / n @ scaled
                out = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], out], [*b.schema.names[:-1], "__whitened"])

    picked = rows.select(*own, F.col(column).cast("array<double>").alias("__vector"))
    schema = picked.drop("__vector").schema.add("__whitened", ArrayType(DoubleType()))
    return picked.mapInArrow(run, schema)


def identity_error(whitened: DataFrame, k: int, column: str = "__whitened") -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity, measured on all rows."""
    s = summarised(whitened, column, np.zeros(k))
    return float(np.abs(s.factor.T @ s.factor / s.n - np.eye(k)).max())


def components(vectors: DataFrame, k: int, column: str = "embedding", keep: list[str] | None = None) -> DataFrame:
    """``keep``, component, whitened, explained, identity_error: a row per usable vector and component up to ``k``."""
    keep = keep or []
    model = fit(vectors, column)
    types = vectors.select(*keep).schema.add("component", IntegerType())
    for name in ("whitened", "explained", "identity_error"):
        types = types.add(name, DoubleType())
    k = 0 if model is None else min(k, len(model.values))
    if not k:
        return vectors.sparkSession.createDataFrame([], types)
    return long_rows(whiten(vectors, model, k, column, keep), model, k, keep)


def long_rows(white: DataFrame, model: Whitening, k: int, keep: list[str]) -> DataFrame:
    share = F.array(*(F.lit(float(v / model.trace)) for v in model.values[:k]))
    error = F.lit(identity_error(white, k)).alias("identity_error")
    rows = white.select(*keep, F.posexplode("__whitened").alias("__i", "whitened"))
    return rows.select(*keep, (F.col("__i") + 1).alias("component"), "whitened", F.get(share, F.col("__i")).alias("explained"), error)
