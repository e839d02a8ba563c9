"""Integer vectors in chunks, for operators that go over the same vectors in several rounds.

A chunk is one stored row: some vectors of one dimension, so that a round
reads whole matrices and nothing is shuffled but sums of a fixed size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Components of a chunk.
CHUNK_COMPONENTS = 1 << 21
LONG_MAX = (1 << 63) - 1


def arrays(table: DataFrame, *others) -> DataFrame:
    """(vec_id, *others, embedding as doubles) of the rows with a vector."""
    return table.select("vec_id", *others, F.col("embedding").cast("array<double>").alias("embedding")).filter("embedding IS NOT NULL")


def finite(column: str = "embedding"):
    """Whether no component is null, NaN or infinite."""
    return F.forall(column, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))


def floors(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as 64-bit integers; what doesn't fit becomes the largest or smallest one."""
    y = np.floor(x * scale)
    out = np.clip(y, -(2.0**63), 2.0**62).astype(np.int64)
    big = y >= 2.0**62
    if big.any():
        out[big] = [min(int(v), LONG_MAX) if np.isfinite(v) else LONG_MAX for v in y[big]]
    return out


def matrix(batch: pa.RecordBatch, dimension: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, integer vectors) of the rows with exactly that many components, all of them finite."""
    lists = batch.column("embedding")
    fits = np.flatnonzero(np.diff(lists.offsets.to_numpy()) == dimension)
    x = lists.take(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(fits), dimension)  # null becomes NaN
    fine = np.isfinite(x).all(axis=1)
    return fits[fine], floors(x[fine], scale)


def narrow(v: np.ndarray) -> np.ndarray:
    """The same integers in the smallest type that holds them."""
    most = max(abs(int(v.min())), abs(int(v.max()))) if v.size else 0
    return v.astype(next((t for t, m in (("<i1", 127), ("<i2", 32767), ("<i4", 2**31 - 1)) if most <= m), "<i8"))


def wide(v: np.ndarray, other: np.ndarray, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Both as 64-bit integers if squared distances over ``dims`` components fit those, else as Python's."""
    most = sum(max(abs(int(a.min())), abs(int(a.max()))) if a.size else 0 for a in (v, other))
    kind = np.int64 if dims * most * most < 1 << 62 else object
    return v.astype(kind), other.astype(kind)


def chunked(build: Callable[[pa.Table, np.ndarray], pa.RecordBatch], dimension: int, scale: int, components: int = CHUNK_COMPONENTS):
    """A mapInArrow function that gives ``build`` (rows, their integer vectors) in chunks of bounded size."""
    most = max(1, components // max(1, dimension))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, vectors, n = [], [], 0
        for batch in batches:
            at, v = matrix(batch, dimension, scale)
            kept = pa.Table.from_batches([batch]).drop_columns(["embedding"]).take(pa.array(at))
            while len(v):
                take = min(most - n, len(v))
                rows.append(kept.slice(0, take))
                vectors.append(v[:take])
                kept, v, n = kept.slice(take), v[take:], n + take
                if n == most:
                    yield build(pa.concat_tables(rows), np.concatenate(vectors))
                    rows, vectors, n = [], [], 0
        if n:
            yield build(pa.concat_tables(rows), np.concatenate(vectors))

    return run


def halves(total: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Sums as (high, low) longs, low ones of 32 bits, so that their own sums over all tasks are exact."""
    whole = [int(x) for x in total.ravel()]
    return pa.array([x >> 32 for x in whole], pa.int64()), pa.array([x & 0xFFFFFFFF for x in whole], pa.int64())


def summed(parts: DataFrame, keys: list[str]) -> list[tuple]:
    """(*keys, sum, n) over all tasks; the keys are codebook or centroid places, of a fixed number."""
    found = parts.groupBy(*keys).agg(F.sum("high").alias("high"), F.sum("low").alias("low"), F.sum("n").alias("n")).collect()
    return [(*(r[k] for k in keys), (r.high << 32) + r.low, r.n) for r in found]


def as_longs(values: np.ndarray) -> pa.Array:
    """Distances as longs; what doesn't fit becomes the largest one."""
    return pa.array(values, pa.int64()) if values.dtype != object else pa.array([min(int(x), LONG_MAX) for x in values], pa.int64())


def long_sum(column: str):
    """The exact sum of a long column, no more than the largest long."""
    return F.least(F.sum(F.col(column).cast("decimal(20,0)")), F.lit(LONG_MAX).cast("decimal(38,0)")).cast("bigint")
