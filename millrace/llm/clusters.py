"""Operator 13: centroid clustering over subvector dictionaries.

A chunk of vectors is stored once, its dimensions cut into blocks and each
block's distinct subvectors numbered, so that a vector is a row of codes. In
a round the distances of the distinct subvectors to the centroids are worked
out once, and a vector's distance is the sum of those of its codes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vectors as V
from .common import Scratch

DIMENSION, CENTROIDS, ROUNDS, SCALE, SALT = 64, 8, 10, 1024, 3
#: Widths that a block of dimensions may have, and distinct subvectors to a row that it may then have at most.
WIDTHS, REPEATED = (16, 8, 4, 2), 0.5


def distinct(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct rows, the number of each row's)."""
    if v.shape[1] == 1:
        values, code = np.unique(v[:, 0], return_inverse=True)
        return values[:, None], code
    keys = np.ascontiguousarray(v).view(np.dtype((np.void, v.itemsize * v.shape[1]))).ravel()
    _, at, code = np.unique(keys, return_index=True, return_inverse=True)
    return v[at], code


def encoded(v: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(first dimension, distinct subvectors, codes) of each block, which together are the vectors again.

    A block is as wide as its subvectors repeat often enough.
    """
    out, at, d = [], 0, v.shape[1]
    while at < d:
        for width in (*(x for x in WIDTHS if at + x <= d), 1):
            found, code = distinct(v[:, at : at + width])
            if width == 1 or len(found) <= REPEATED * len(v):
                break
        out.append((at, found, code))
        at += width
    return out


def packed(v: np.ndarray) -> tuple[list[int], list[int], list[int], bytes, bytes, int]:
    """(widths, sizes of the dictionaries, bytes of a code) by block, all dictionaries, all codes, bytes of a component."""
    blocks = encoded(v)
    kind = V.narrow(v).dtype
    code_width = [1 if len(f) <= 256 else 2 if len(f) <= 1 << 16 else 4 for _, f, _ in blocks]
    return (
        [f.shape[1] for _, f, _ in blocks],
        [len(f) for _, f, _ in blocks],
        code_width,
        b"".join(f.astype(kind).tobytes() for _, f, _ in blocks),
        b"".join(c.astype(f"<u{k}").tobytes() for (_, _, c), k in zip(blocks, code_width, strict=True)),
        kind.itemsize,
    )


def blocks_of(row: dict) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """The blocks of a stored chunk."""
    out, at, dims, codes = [], 0, 0, 0
    for width, size, code in zip(row["widths"], row["sizes"], row["code_widths"], strict=True):
        found = np.frombuffer(row["dictionaries"], f"<i{row['itemsize']}", size * width, at).astype(np.int64).reshape(size, width)
        out.append((dims, found, np.frombuffer(row["codes"], f"<u{code}", row["n"], codes)))
        at, dims, codes = at + size * width * row["itemsize"], dims + width, codes + row["n"] * code
    return out


def distances(blocks: list[tuple[int, np.ndarray, np.ndarray]], centroids: np.ndarray) -> np.ndarray:
    """(vector, centroid): squared distances, as sums of those of the vectors' codes."""
    kind = object if any(V.wide(f, centroids, centroids.shape[1])[0].dtype == object for _, f, _ in blocks) else np.int64
    total = np.zeros((len(blocks[0][2]), len(centroids)), kind)
    for at, found, code in blocks:
        gap = found.astype(kind)[:, None, :] - centroids[None, :, at : at + found.shape[1]].astype(kind)
        total += (gap * gap).sum(2)[code]
    return total


def sums(blocks: list[tuple[int, np.ndarray, np.ndarray]], cluster: np.ndarray, k: int, d: int) -> tuple[np.ndarray, np.ndarray]:
    """(sums, counts) of the clusters' vectors: each distinct subvector by the number of its vectors there."""
    out = np.zeros((k, d), object)
    for at, found, code in blocks:
        n = np.bincount(cluster * len(found) + code, minlength=k * len(found)).reshape(k, len(found))
        small = int(np.abs(found.astype(np.float64)).max(initial=0)) * (len(code) + 1) < 1 << 62
        out[:, at : at + found.shape[1]] = (n @ found if small else n.astype(object) @ found.astype(object)).astype(object)
    return out, np.bincount(cluster, minlength=k)


def clusters(table: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dimension: int = DIMENSION, scale: int = SCALE, salt: int = SALT, chunk: int = V.CHUNK_COMPONENTS) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector with exactly ``dimension`` components.

    Components become floor(scale * x). Centroids start as the ``k`` vectors of
    the smallest sha256 of ``salt:vec_id``. In each round every vector goes to
    the nearest one, ties to the smaller number, and each one that has vectors
    becomes the floor of their mean; then vectors are assigned once more.
    Inertia is squared distance, summed over the cluster and over all.

    Rows whose vector is null, has another length, or a null or non-finite
    component, take no part. A null vec_id comes last among the hashes; rows
    that repeat count each, and of equal vec_ids the smaller vector starts
    first. With fewer vectors than ``k`` there are as many centroids.
    Integers, distances and sums beyond a long become the largest one. An empty
    table gives no row. Columns other than vec_id and embedding are ignored.
    """
    spark, work = table.sparkSession, Scratch(table.sparkSession)
    given = V.arrays(table)
    kind = given.schema["vec_id"]
    good = given.filter((F.size("embedding") == dimension) & V.finite())
    name = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    start = good.select(name.alias("name"), "embedding").orderBy(F.col("name").asc_nulls_last(), "embedding").limit(k).collect()
    out_kind = T.StructType([kind, T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType()), T.StructField("cluster_inertia", T.LongType()), T.StructField("inertia", T.LongType()), T.StructField("centroid_sha256", T.StringType())])
    if not start:
        return spark.createDataFrame([], out_kind)
    centroids = V.floors(np.array([r.embedding for r in start]), scale)
    k = len(start)

    lists = "widths array<int>, sizes array<int>, code_widths array<int>, dictionaries binary, codes binary, itemsize int, n int"
    packed_kind = T.StructType([T.StructField("vec_id", T.ArrayType(kind.dataType)), *T.StructType.fromDDL(lists).fields])

    def build(rows: pa.Table, v: np.ndarray) -> pa.RecordBatch:
        widths, sizes, code_widths, dictionaries, codes, itemsize = packed(v)
        ids = pa.ListArray.from_arrays(pa.array([0, rows.num_rows], pa.int32()), rows.column("vec_id").combine_chunks())
        return pa.record_batch([ids, *(pa.array([x], pa.list_(pa.int32())) for x in (widths, sizes, code_widths)), pa.array([dictionaries], pa.binary()), pa.array([codes], pa.binary()), pa.array([itemsize], pa.int32()), pa.array([len(v)], pa.int32())], names=[f.name for f in packed_kind])

    chunks = work.stored(given.mapInArrow(V.chunked(build, dimension, scale, chunk), packed_kind))

    def totals(centroids: np.ndarray):
        def run(batches):
            total, n = np.zeros(centroids.shape, object), np.zeros(k, np.int64)
            for batch in batches:
                for row in batch.drop_columns(["vec_id"]).to_pylist():
                    blocks = blocks_of(row)
                    s, c = sums(blocks, distances(blocks, centroids).argmin(1), k, dimension)
                    total += s
                    n += c
            place = np.indices(centroids.shape).reshape(2, -1)
            high, low = V.halves(total)
            yield pa.record_batch([*(pa.array(x, pa.int32()) for x in place), high, low, pa.array(np.repeat(n, dimension), pa.int64())], names=["cluster", "at", "high", "low", "n"])

        return run

    for _ in range(rounds):
        centroids = centroids.copy()
        for c, at, total, n in V.summed(chunks.mapInArrow(totals(centroids), "cluster int, at int, high bigint, low bigint, n bigint"), ["cluster", "at"]):
            if n:
                centroids[c, at] = total // n

    def assigned(batches):
        for batch in batches:
            ids = batch.column("vec_id")
            for i, row in enumerate(batch.drop_columns(["vec_id"]).to_pylist()):
                away = distances(blocks_of(row), centroids)
                near = away.argmin(1)
                yield pa.record_batch([ids.slice(i, 1).flatten(), pa.array(near, pa.int32()), V.as_longs(away[np.arange(len(near)), near])], names=["vec_id", "cluster", "distance"])

    rows = work.stored(chunks.mapInArrow(assigned, T.StructType([kind, T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])))
    work.drop(chunks)
    totals_by = {r.cluster: int(r.s) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()}  # one row for each centroid
    sha = [hashlib.sha256(",".join(str(int(x)) for x in c).encode()).hexdigest() for c in centroids]
    fixed = [(c, min(s, V.LONG_MAX), min(sum(totals_by.values()), V.LONG_MAX), sha[c]) for c, s in totals_by.items()]
    named = spark.createDataFrame(fixed, "of int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return rows.join(F.broadcast(named), F.col("cluster") == F.col("of")).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
