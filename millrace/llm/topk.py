"""Operator 5: exact top-k search by distributed histogram selection.

Vectors are stored once as chunks of integers. In a round every chunk meets
every block of queries in one pass: a task holds one chunk and one block at a
time. Histograms of the scores, summed over the chunks, narrow each query's
interval to its k-th score; what reaches that is kept, and ties are broken.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import vectors as V
from .common import Scratch, sized

#: Components of a block of queries and of a chunk of vectors, and vectors scored at once.
BLOCK_COMPONENTS, CHUNK_COMPONENTS, ROWS = 1 << 19, 1 << 22, 512
#: Buckets of a histogram.
BUCKETS = 256
#: Scores beyond it, up or down, count as it.
LIMIT = 1 << 61

CHUNK = "pid bigint, d int, ids binary, v binary, itemsize int, most bigint"
MEETING = "pid bigint, kind int, block int, d int, ids binary, v binary, itemsize int, low binary, need binary"


def whole_vectors(table: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component x, without vectors that are null or hold null or non-finite components."""
    x = F.transform("embedding", lambda c: F.floor(F.lit(scale) * c.cast("double")))
    fine = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < math.inf))
    return table.select("vec_id", "embedding").filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine).select("vec_id", x.alias("v"))


def chunked(scale: int, components: int):
    """A mapInArrow function from rows to chunks, each of one dimension."""

    def run(batches):
        part, made, held, size = TaskContext.get().partitionId(), 0, {}, 0

        def chunks():
            nonlocal made
            for d, (ids, vectors) in sorted(held.items()):
                ids, v, step = np.concatenate(ids), np.concatenate(vectors), max(1, components // max(1, d))
                for at in range(0, len(ids), step):
                    some = V.narrow(v[at : at + step])
                    most = max(abs(int(some.min())), abs(int(some.max()))) if some.size else 0
                    yield pa.record_batch(
                        [pa.array([(part << 33) + made], pa.int64()), pa.array([d], pa.int32()), pa.array([ids[at : at + step].astype("<i8").tobytes()], pa.binary()), pa.array([some.tobytes()], pa.binary()), pa.array([some.itemsize], pa.int32()), pa.array([min(most, V.LONG_MAX)], pa.int64())],
                        names=["pid", "d", "ids", "v", "itemsize", "most"],
                    )
                    made += 1

        for batch in batches:
            for d in np.unique(np.diff(batch.column("embedding").offsets.to_numpy())).tolist():
                at, v = V.matrix(batch, d, scale)
                if len(at):
                    ids, vectors = held.setdefault(d, ([], []))
                    ids.append(batch.column("vec_id").take(pa.array(at)).to_numpy())
                    vectors.append(v)
                    size += len(at) * max(1, d)
            if size >= components:
                yield from chunks()
                held, size = {}, 0
        yield from chunks()

    return run


@dataclass
class Block:
    """Some queries of one dimension: a query's k-th score lies in [low, low + width), and ``need`` of its candidates
    there are still to be taken from the top."""

    ids: np.ndarray
    q: np.ndarray
    low: np.ndarray
    need: np.ndarray

    def scores(self, v: np.ndarray) -> np.ndarray:
        """Inner products of the rows of v with all queries, without rounding."""
        most = [max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0 for x in (v, self.q)]
        bound = self.q.shape[1] * most[0] * most[1]
        if bound < 1 << 53:
            return (v.astype(np.float64) @ self.q.T.astype(np.float64)).astype(np.int64)
        if bound < LIMIT:
            return v.astype(np.int64) @ self.q.T.astype(np.int64)
        return np.clip(v.astype(object) @ self.q.T.astype(object), -LIMIT, LIMIT).astype(np.int64)

    def parts(self, ids: np.ndarray, v: np.ndarray):
        """(vec_ids, scores, whether a row may be a query's candidate), a few rows at a time."""
        for at in range(0, len(ids), ROWS):
            some = ids[at : at + ROWS]
            yield some, self.scores(v[at : at + ROWS]), some[:, None] != self.ids[None, :]


def histogram(step: int, block: Block, ids: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    """(query_id, bucket, n): how many of the chunk's candidates fall in each bucket of a query's interval, from the top
    until they reach what the query needs; buckets below cannot hold its k-th score."""
    m = len(block.ids)
    total = np.zeros(m * BUCKETS, np.int64)
    for _, s, other in block.parts(ids, v):
        bucket = (s - block.low[None, :]) // step
        here = other & (bucket >= 0) & (bucket < BUCKETS)
        total += np.bincount(np.nonzero(here)[1] * BUCKETS + bucket[here], minlength=m * BUCKETS)
    n = total.reshape(m, BUCKETS)[:, ::-1]
    before = np.cumsum(n, axis=1) - n
    q, b = np.nonzero((n > 0) & (before < block.need[:, None]))
    return pa.record_batch([pa.array(block.ids[q], pa.int64()), pa.array(BUCKETS - 1 - b, pa.int32()), pa.array(n[q, b], pa.int64())], names=["query_id", "bucket", "n"])


def survivors(k: int, block: Block, ids: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    """(query_id, vec_id, score) of candidates that reach the k-th score; of a chunk's ties only the k smallest ids matter."""
    best = pd.DataFrame({"q": np.array([], np.int64), "vec_id": np.array([], np.int64), "score": np.array([], np.int64)})
    for some, s, other in block.parts(ids, v):
        row, q = np.nonzero(other & (s >= block.low[None, :]))
        best = pd.concat([best, pd.DataFrame({"q": q, "vec_id": some[row], "score": s[row, q]})])
        if len(best) > 4 * k * len(block.ids):
            best = _first(best, k)
    best = _first(best, k)
    return pa.record_batch([pa.array(block.ids[best.q.to_numpy(np.int64)], pa.int64()), pa.array(best.vec_id.to_numpy(np.int64), pa.int64()), pa.array(best.score.to_numpy(np.int64), pa.int64())], names=["query_id", "vec_id", "score"])


def _first(found: pd.DataFrame, k: int) -> pd.DataFrame:
    found = found.sort_values(["q", "score", "vec_id"], ascending=[True, False, True], kind="stable")
    return found[found.groupby("q").cumcount() < k]


def met(fn: Callable[[Block, np.ndarray, np.ndarray], pa.RecordBatch]):
    """A mapInArrow function over rows sorted by chunk, each chunk before the blocks that it meets."""

    def run(batches):
        ids = v = None
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                own, held = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["v"], f"<i{r['itemsize']}")
                if r["kind"] == 0:
                    ids, v = own, held.reshape(len(own), r["d"])
                else:
                    yield fn(Block(own, held.reshape(len(own), r["d"]), np.frombuffer(r["low"], "<i8"), np.frombuffer(r["need"], "<i8")), ids, v)

    return run


def _packed(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("query_id")
    plain = lambda c: rows.column(c).combine_chunks()
    raw = lambda c: [plain(c).to_numpy().astype("<i8").tobytes()]
    q = plain("q").flatten().to_numpy(zero_copy_only=False).astype("<i8").tobytes()
    return pa.table({"d": pa.array([rows.column("d")[0].as_py()], pa.int32()), "block": pa.array([rows.column("block")[0].as_py()], pa.int32()), "ids": pa.array(raw("query_id"), pa.binary()), "v": pa.array([q], pa.binary()), "low": pa.array(raw("low"), pa.binary()), "need": pa.array(raw("need"), pa.binary())})


def meetings(chunks: DataFrame, state: DataFrame) -> DataFrame:
    """Each chunk followed by all blocks of queries of its dimension. The blocks are copied for each chunk, never the chunks."""
    blocks = state.groupBy("d", "block").applyInArrow(_packed, "d int, block int, ids binary, v binary, low binary, need binary")
    places = chunks.select("pid", F.col("d").alias("of"))
    sent = blocks.join(sized(places), F.col("d") == F.col("of")).select("pid", F.lit(1).alias("kind"), "block", "d", "ids", "v", F.lit(8).alias("itemsize"), "low", "need")
    none = F.lit(None).cast("binary")
    own = chunks.select("pid", F.lit(0).alias("kind"), F.lit(-1).alias("block"), "d", "ids", "v", "itemsize", none.alias("low"), none.alias("need"))
    return own.unionByName(sent).repartition("pid").sortWithinPartitions("pid", "kind", "block")


def top_k(table: DataFrame, k: int = 5, every: int = 50, scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` largest inner products of each query, ties to the smaller vec_id.

    Queries are the rows whose vec_id is divisible by ``every``; every row but
    those with the query's own id is a candidate, and rows of another dimension
    are none. Rows with a null id or a vector that is null or has null or
    non-finite components take no part. Repeated ids are separate candidates;
    of repeated queries the smallest vector is asked. Scores beyond 2^61 count
    as that. A query without candidates has no row, and an empty table gives
    none. Only vec_id and embedding are read.

    The number of passes over the vectors follows the range of scores alone, by
    256 for each pass, not the number of queries.
    """
    spark, work = table.sparkSession, Scratch(table.sparkSession)
    chunks = work.stored(V.arrays(table).filter("vec_id IS NOT NULL").select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding").mapInArrow(chunked(scale, CHUNK_COMPONENTS), CHUNK))
    most, d = chunks.agg(F.max("most"), F.max("d")).first()
    queries = whole_vectors(table, scale).filter(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").cast("bigint").alias("query_id")).agg(F.min("v").alias("q"))
    queries = queries.withColumn("d", F.size("q"))
    dims = queries.groupBy(F.col("d").alias("of")).agg(F.ceil(F.count("*") * F.greatest(F.max("d"), F.lit(1)) / BLOCK_COMPONENTS).cast("int").alias("blocks"))
    bound = min(LIMIT, (d or 0) * (most or 0) ** 2) + 1
    width = BUCKETS
    while width < 2 * bound + 1:
        width *= BUCKETS
    block = F.pmod(F.xxhash64("query_id"), "blocks").cast("int").alias("block")
    state = work.stored(queries.join(sized(dims), F.col("d") == F.col("of")).select("query_id", "d", block, "q", F.lit(-bound).cast("bigint").alias("low"), F.lit(k).cast("bigint").alias("need")))
    while width > 1:
        width //= BUCKETS
        counts = meetings(chunks, state).mapInArrow(met(lambda *x, step=width: histogram(step, *x)), "query_id bigint, bucket int, n bigint").groupBy("query_id", "bucket").agg(F.sum("n").alias("n"))
        above = F.sum("n").over(Window.partitionBy("query_id").orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1))
        levels = counts.select("query_id", "bucket", "n", F.coalesce(above, F.lit(0)).alias("above"))
        asked = state.select(F.col("query_id").alias("of"), F.col("need").alias("asked"))
        found = levels.join(asked, F.col("query_id") == F.col("of")).filter((F.col("above") < F.col("asked")) & (F.col("above") + F.col("n") >= F.col("asked"))).select("of", "bucket", "above")
        # a query with fewer candidates than it needs keeps its interval's foot, and all of them
        low = F.col("low") + F.lit(width).cast("bigint") * F.coalesce("bucket", F.lit(0))
        need = F.when(F.col("bucket").isNull(), F.lit(V.LONG_MAX)).otherwise(F.col("need") - F.col("above"))
        old, state = state, work.stored(state.join(found, F.col("query_id") == F.col("of"), "left").select("query_id", "d", "block", "q", low.alias("low"), need.alias("need")))
        work.drop(old)
    best = work.stored(meetings(chunks, state).mapInArrow(met(lambda *x: survivors(k, *x)), "query_id bigint, vec_id bigint, score bigint"))
    work.drop_all_but(best)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
