"""Operator 11: whitening of embeddings by a hierarchical singular value decomposition.

Each partition of the fit list keeps a state: count, exact sums, and all singular values and right vectors of its
centred rows. Two states merge into one of the stacked matrix (s1 V1; s2 V2; sqrt(n1 n2 / (n1 + n2)) (m1 - m2)), whose
last row corrects the means, decomposed again: nothing is cut off, so the merged state is that of all rows. States are
merged by a tree of groups; the last one has dims^2 numbers, however many rows there are.

Vectors are lists of numbers that become integers floor(scale * c) + offset; sums and deviations are exact. A vector
that is null, or holds a null or non-finite entry, or has another length than the fitted space, has no row. The space
has the length of the longest valid vector, if none is given; empty vectors have none. Equal vectors count once in the
fit list. A component without variance is kept with null `whitened`, and is not part of identity_error. Null ids and
repeated rows stay rows; an empty table has no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm import common

_STATE = "place long, n long, sums binary, s binary, v binary"
#: States merged by one task at a time, and rows decomposed at once.
FAN_IN, BLOCK = 8, 4096


class State:
    """n rows of integers: their sums without the offset, singular values and right vectors of the centred rows."""

    def __init__(self, n: int, sums: list[int], s: np.ndarray, v: np.ndarray):
        self.n, self.sums, self.s, self.v = n, sums, s, v

    @classmethod
    def of(cls, rows: np.ndarray) -> State:
        """rows: integers without the offset."""
        sums = [int(x) for x in rows.sum(axis=0)] if not rows.size or _fits(len(rows) * int(np.abs(rows).max())) else [sum(map(int, c)) for c in rows.T]
        n = len(rows)
        _, s, v = np.linalg.svd(centred(rows, n, sums), full_matrices=False)
        return cls(n, sums, s, v)

    def merged(self, other: State) -> State:
        n = self.n + other.n
        # n1 n2 (m1 - m2) is an integer; it is exact before it is rounded once.
        gap = np.array([(a * other.n - b * self.n) / (self.n * other.n) for a, b in zip(self.sums, other.sums)])
        stacked = np.vstack([self.s[:, None] * self.v, other.s[:, None] * other.v, math.sqrt(self.n * other.n / n) * gap[None, :]])
        _, s, v = np.linalg.svd(stacked, full_matrices=False)
        return State(n, [a + b for a, b in zip(self.sums, other.sums)], s, v)

    def row(self, place: int) -> tuple:
        sums = b"".join(x.to_bytes(16, "little", signed=True) for x in self.sums)
        return place, self.n, sums, self.s.astype("<f8").tobytes(), self.v.astype("<f8").tobytes()

    @classmethod
    def read(cls, n: int, sums: bytes, s: bytes, v: bytes) -> State:
        whole = [int.from_bytes(sums[k : k + 16], "little", signed=True) for k in range(0, len(sums), 16)]
        return cls(int(n), whole, np.frombuffer(s, "<f8"), np.frombuffer(v, "<f8").reshape(-1, len(whole)))

    def components(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Variances by falling size, their unit vectors as rows, and which are more than rounding."""
        s = self.s
        real = s > (s[0] if len(s) else 0.0) * max(self.n, len(self.sums)) * np.finfo(float).eps
        return s * s / self.n, self.v, real & (s > 0)


def _fits(x: int) -> bool:
    return x < 1 << 62


def scaled_gap(rows: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exact: as 64-bit integers where they fit, else as Python's."""
    most = int(np.abs(rows).max()) if rows.size else 0
    if _fits(n * most + max(map(abs, sums), default=0)):
        return n * rows - np.array(sums, np.int64)
    return n * rows.astype(object) - np.array(sums, object)


def centred(rows: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return scaled_gap(rows, n, sums).astype(np.float64) / n


def integers(vectors: DataFrame, vec: str, scale: int) -> DataFrame:
    """vectors with x, the integers of each valid vector without the offset; the rest go."""
    bad = F.exists(vec, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    valid = vectors.where(F.col(vec).isNotNull()).where((F.size(vec) > 0) & ~bad)
    return valid.withColumn("x", F.transform(vec, lambda c: F.floor(F.lit(float(scale)) * c.cast("double"))))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def fit(rows: DataFrame, dims: int, folder: str) -> State | None:
    """The state of all rows of integers x, each of `dims`; None without rows. One state comes to the driver."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        state = None
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = State.of(_matrix(batch.column("x").slice(at, BLOCK), dims))
                state = part if state is None else state.merged(part)
        if state is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(("place", "n", "sums", "s", "v"), state.row(TaskContext.get().partitionId())))], schema=_ARROW)

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        states = [State.read(*r) for r in group.sort_values("place")[["n", "sums", "s", "v"]].itertuples(index=False)]
        out = states[0]
        for s in states[1:]:
            out = out.merged(s)
        return pd.DataFrame([out.row(int(group["place"].min()) // FAN_IN)], columns=["place", "n", "sums", "s", "v"])

    states = common.materialized(rows.select("x").mapInArrow(local, _STATE), f"{folder}/states")
    most = states.agg(F.max("place")).first()[0]
    if most is None:
        return None
    while most > 0:
        states = states.groupBy(F.floor(F.col("place") / FAN_IN).alias("up")).applyInPandas(merge, _STATE)
        most //= FAN_IN
    row = states.first()
    return State.read(row.n, row.sums, row.s, row.v)


_ARROW = pa.schema([("place", pa.int64()), ("n", pa.int64()), ("sums", pa.binary()), ("s", pa.binary()), ("v", pa.binary())])


def identity_error(rows: DataFrame, state: State, dims: int, k: int) -> float | None:
    """Largest absolute entry of the covariance of whitened rows minus the identity, summed up by partition."""
    e, v, real = state.components()
    real = real[:k]
    if not real.any():
        return None
    n, sums, to = state.n, state.sums, v[:k][real].T / np.sqrt(e[:k][real])

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, found = np.zeros((to.shape[1], to.shape[1])), False
        for batch in batches:
            if batch.num_rows:
                w = centred(_matrix(batch.column("x"), dims), n, sums) @ to
                total, found = total + w.T @ w, True
        if found:
            flat = total.ravel()
            yield pa.record_batch([pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat)], ["cell", "total"])

    cells = rows.select("x").mapInArrow(products, "cell int, total double").groupBy("cell").agg(F.sum("total").alias("total"))
    found = np.zeros(to.shape[1] ** 2)
    for r in cells.collect():  # k^2 numbers
        found[r.cell] = r.total
    return float(np.abs(found.reshape(to.shape[1], -1) / n - np.eye(to.shape[1])).max())


def whiten(
    vectors: DataFrame, *, key: str = "vec_id", vec: str = "embedding", k: int | None = 16, scale: int = 64, dims: int | None = None, folder: str | None = None
) -> DataFrame:
    """A row for each valid vector: key, n, deviation, whitened, explained (one entry for each of the first k components,
    all of them if k is None), identity_error.

    deviation is the sum of (n x - S)^2, null where it is beyond 64 bits.
    """
    spark = vectors.sparkSession
    folder = folder or common.shared_dir(spark, "whitening")
    rows = integers(vectors.select(F.col(key).alias("key"), F.col(vec).alias("vec")), "vec", scale)
    kind = dict(vectors.select(F.col(key).alias("key")).dtypes)["key"]
    schema = f"key {kind}, n long, deviation long, whitened array<double>, explained array<double>, identity_error double"
    if dims is None:
        dims = rows.agg(F.max(F.size("vec"))).first()[0]
        if dims is None:
            return spark.createDataFrame([], schema)
    rows = rows.where(F.size("vec") == dims).select("key", "x")
    fit_list = common.materialized(rows.groupBy("x").agg(F.lit(1).alias("one")).select("x"), f"{folder}/fit")
    state = fit(fit_list, dims, folder)
    if state is None:
        return spark.createDataFrame([], schema)
    k = dims if k is None else min(k, dims)
    error = identity_error(fit_list, state, dims, k)
    e, v, real = state.components()
    short = k - len(e)  # fewer rows than components
    e_k, v_k, real = np.pad(e, (0, max(0, short)))[:k], np.pad(v, ((0, max(0, short)), (0, 0)))[:k], np.pad(real, (0, max(0, short)))[:k]
    n, sums = state.n, state.sums
    share = (e_k / e.sum()).tolist() if e.sum() > 0 else [None] * k
    to = v_k.T / np.sqrt(np.where(real, e_k, 1.0))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                gap = scaled_gap(_matrix(batch.column("x"), dims), n, sums)
                if gap.dtype == object or not _fits(int(np.abs(gap).max()) ** 2 * dims):
                    gap = gap.astype(object)
                squares = (gap * gap).sum(axis=1)
                if gap.dtype == object:
                    squares = [int(x) if x < 1 << 63 else None for x in squares]
                w = gap.astype(np.float64) / n @ to
                mask = np.broadcast_to(~real, w.shape).ravel()
                m = batch.num_rows
                columns = [
                    batch.column("key"), pa.array([n] * m, pa.int64()), pa.array(squares, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(np.arange(m + 1) * k, pa.int32()), pa.array(w.ravel(), mask=mask)),
                    pa.array([share] * m, pa.list_(pa.float64())), pa.array([error] * m, pa.float64()),
                ]
                yield pa.record_batch(columns, ["key", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: embeddings whitened, a row for each of the first 16 components; see the module."""
    rows = whiten(common.table(spark, sf_dir, "embeddings"), k=16)
    each = F.posexplode(F.arrays_zip("whitened", "explained"))
    rows = rows.select(F.col("key").alias("vec_id"), "n", "deviation", "identity_error", each.alias("at", "c"))
    return rows.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", "c.whitened", "c.explained", "identity_error")
