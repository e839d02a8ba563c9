"""Operator 12: vector code compression by codebooks of vector parts, learned over Hilbert-sorted blocks.

A chunk of vectors is stored once. For each part position its subvectors are
sorted along a Hilbert curve and cut into flat blocks that keep a box of
smallest and largest components, and sums. In a round the boxes' distances to
the codebook's entries leave a short list of entries for each block. A block with one
entry left is counted by its sums; the others are compared with their short
lists by exact integer kernels.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vectors as V
from .common import Scratch, sized

#: Subvectors of a block, and blocks that are compared at once.
BLOCK, AT_ONCE = 16, 1024
PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256


def hilbert_order(v: np.ndarray) -> np.ndarray:
    """Row numbers along a Hilbert curve; only an order, so the grid's cells may be coarse.

    Each component becomes a few bits, which Skilling's transform turns into
    the curve's, most significant first.
    """
    n, dims = v.shape
    if not n or not dims:
        return np.arange(n)
    used = min(dims, 62)
    bits = max(1, min(10, 62 // used))
    x = v[:, :used].astype(np.float64)
    low, span = x.min(0), np.maximum(x.max(0) - x.min(0), 1.0)
    axes = [np.minimum((x[:, d] - low[d]) / span[d] * (1 << bits), (1 << bits) - 1).astype(np.int64) for d in range(used)]
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        below = q - 1
        for d in range(used):
            on = (axes[d] & q) != 0
            if d == 0:
                axes[0] = np.where(on, axes[0] ^ below, axes[0])
            else:
                swap = np.where(on, 0, (axes[0] ^ axes[d]) & below)
                axes[0] = np.where(on, axes[0] ^ below, axes[0] ^ swap)
                axes[d] = axes[d] ^ swap
        q >>= 1
    for d in range(1, used):
        axes[d] = axes[d] ^ axes[d - 1]
    turn = np.zeros(n, np.int64)
    q = top
    while q > 1:
        turn = np.where((axes[-1] & q) != 0, turn ^ (q - 1), turn)
        q >>= 1
    key = np.zeros(n, np.int64)
    for b in reversed(range(bits)):
        for d in range(used):
            key = (key << 1) | (((axes[d] ^ turn) >> b) & 1)
    return np.argsort(key, kind="stable")


@dataclass
class Blocks:
    """The subvectors of one part position in curve order, with each block's box and sums."""

    order: np.ndarray
    v: np.ndarray
    low: np.ndarray
    high: np.ndarray
    sums: np.ndarray

    @classmethod
    def of(cls, v: np.ndarray, size: int = BLOCK) -> Blocks:
        order = hilbert_order(v)
        v = v[order]
        at = np.arange(0, len(v), size)
        total = v if v.dtype == object or len(v) == 0 or int(np.abs(v.astype(np.float64)).max()) * size < 2**62 else v.astype(object)
        return cls(order, v, np.minimum.reduceat(v, at, axis=0), np.maximum.reduceat(v, at, axis=0), np.add.reduceat(total, at, axis=0))

    def shortlists(self, entries: np.ndarray) -> np.ndarray:
        """Whether an entry may be the nearest one to a subvector of the block, for each block and entry.

        One whose distance to the box is larger than another's to the box's farthest corner is not.
        """
        low, e = V.wide(self.low, entries, entries.shape[1])
        high, _ = V.wide(self.high, entries, entries.shape[1])
        if low.dtype != high.dtype:
            low, high, e = low.astype(object), high.astype(object), e.astype(object)
        below, above = low[:, None, :] - e[None, :, :], e[None, :, :] - high[:, None, :]
        gap = np.maximum(np.maximum(below, above), 0)
        far = np.maximum(np.abs(below), np.abs(above))
        least, most = (gap * gap).sum(2), (far * far).sum(2)
        return least <= most.min(1)[:, None]

    def nearest(self, entries: np.ndarray, size: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each subvector in curve order; of equally near entries the first."""
        keep = self.shortlists(entries)
        v, e = V.wide(self.v, entries, entries.shape[1])
        best, away = np.zeros(len(v), np.int64), np.zeros(len(v), v.dtype)
        width = keep.sum(1)
        by_width = np.argsort(width, kind="stable")
        for at in range(0, len(by_width), AT_ONCE):
            some = by_width[at : at + AT_ONCE]
            w = int(width[some].max())
            # the kept entries in ascending order, then any others, which a mask leaves out
            listed = np.argsort(~keep[some], axis=1, kind="stable")[:, :w]
            rows = some[:, None] * size + np.arange(size)
            inside = rows < len(v)
            rows = np.minimum(rows, len(v) - 1)
            d = v[rows][:, :, None, :] - e[listed][:, None, :, :]
            d = (d * d).sum(3)
            out = np.arange(w) >= width[some][:, None]
            d = np.where(out[:, None, :], d.max() + 1, d) if out.any() else d
            pick = d.argmin(2)
            best[rows[inside]] = np.take_along_axis(listed, pick, 1)[inside] if pick.ndim == 2 else 0
            away[rows[inside]] = np.take_along_axis(d, pick[:, :, None], 2)[:, :, 0][inside]
        return best, away

    def totals(self, entries: np.ndarray, size: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
        """(sums, counts) of the subvectors that each entry is nearest to."""
        keep = self.shortlists(entries)
        alone = keep.sum(1) == 1
        kind = self.sums.dtype if self.sums.dtype == object or int(np.abs(self.sums.astype(np.float64)).max(initial=0)) * (len(self.sums) + 1) < 2**62 else object
        sums, n = np.zeros(entries.shape, kind), np.zeros(len(entries), np.int64)
        first = keep.argmax(1)
        np.add.at(sums, first[alone], self.sums[alone].astype(kind))
        lengths = np.minimum(size, len(self.v) - np.arange(len(keep)) * size)
        np.add.at(n, first[alone], lengths[alone])
        if not alone.all():
            inside = np.repeat(~alone, lengths)
            rest = Blocks(self.order, self.v[inside], self.low[~alone], self.high[~alone], self.sums[~alone])
            near, _ = rest.nearest(entries, size)
            np.add.at(sums, near, rest.v.astype(kind))
            n += np.bincount(near, minlength=len(entries))
        return sums, n


def packed(v: np.ndarray, parts: int) -> dict:
    """A chunk's blocks as bytes. Sums that don't fit longs are left to be made again."""
    w = v.shape[1] // parts
    made = [Blocks.of(v[:, p * w : (p + 1) * w]) for p in range(parts)]
    kind = V.narrow(v).dtype
    joined = lambda name, to: np.concatenate([getattr(b, name).ravel() for b in made]).astype(to).tobytes()
    fits = all(b.sums.dtype != object for b in made)
    return {"n": len(v), "width": kind.itemsize, "orders": joined("order", "<u4"), "vectors": joined("v", kind), "low": joined("low", "<i8"), "high": joined("high", "<i8"), "sums": joined("sums", "<i8") if fits else None}


def blocks_of(row: dict, parts: int, w: int) -> list[Blocks]:
    """The blocks of a stored chunk, one for each part position."""
    n = row["n"]
    order, v = np.frombuffer(row["orders"], "<u4").reshape(parts, n), np.frombuffer(row["vectors"], f"<i{row['width']}").astype(np.int64).reshape(parts, n, w)
    box = lambda name: np.frombuffer(row[name], "<i8").reshape(parts, -1, w)
    low, high = box("low"), box("high")
    sums = box("sums") if row["sums"] is not None else [np.add.reduceat(v[p].astype(object), np.arange(0, n, BLOCK), axis=0) for p in range(parts)]
    return [Blocks(order[p], v[p], low[p], high[p], sums[p]) for p in range(parts)]


PACKED = "n int, width int, orders binary, vectors binary, low binary, high binary, sums binary"


def vector_codes(table: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, label: str = "label", chunk: int = V.CHUNK_COMPONENTS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of each vector.

    Components become floor(scale * x) and vectors are cut into ``parts`` equal
    parts. A codebook starts as the parts of the ``entries`` vectors of the
    smallest vec_ids, and in each round every entry becomes the floor of the
    mean of the subvectors that are nearest to it, by squared distance, ties to
    the lower index. ``code`` has two hex digits (or more, beyond 256 entries)
    for each part; ``error`` is the vector's squared distance to what its code
    stands for, and label_error the sum over its label, where null is a label.

    Rows whose vector is null, or has a null or non-finite component, take no
    part. The dimension is that of the kept vector of the smallest vec_id whose
    length is a positive multiple of ``parts``; vectors of another length take
    no part either. A null vec_id comes after all others; rows that repeat are
    coded each, and of equal vec_ids the smaller vector comes first. With fewer
    vectors than ``entries`` there are as many entries. Integers, errors and their sums
    beyond a long become the largest one. An empty table gives no row. Columns other than
    vec_id, embedding and ``label`` are ignored.
    """
    spark, work = table.sparkSession, Scratch(table.sparkSession)
    given = V.arrays(table, F.col(label).alias("label"))
    kinds = given.schema
    good = given.filter(V.finite()).filter((F.size("embedding") > 0) & (F.size("embedding") % parts == 0))
    first_of = lambda rows: rows.select("vec_id", "embedding").orderBy(F.col("vec_id").asc_nulls_last(), "embedding")
    first = first_of(good).first()
    out_kind = T.StructType([kinds["vec_id"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType()), T.StructField("label_error", T.LongType()), T.StructField("codebooks_sha256", T.StringType())])
    if first is None:
        return spark.createDataFrame([], out_kind)
    d = len(first.embedding)
    w = d // parts
    start = first_of(good.filter(F.size("embedding") == d)).limit(entries).collect()
    books = V.floors(np.array([r.embedding for r in start]), scale).reshape(len(start), parts, w).transpose(1, 0, 2)

    listed = [T.StructField("vec_id", T.ArrayType(kinds["vec_id"].dataType)), T.StructField("label", T.ArrayType(kinds["label"].dataType))]
    packed_kind = T.StructType(listed + T.StructType.fromDDL(PACKED).fields)

    def build(rows: pa.Table, v: np.ndarray) -> pa.RecordBatch:
        made = packed(v, parts)
        columns = [pa.ListArray.from_arrays(pa.array([0, rows.num_rows], pa.int32()), rows.column(c).combine_chunks()) for c in ("vec_id", "label")]
        binary = ("orders", "vectors", "low", "high", "sums")
        return pa.record_batch([*columns, pa.array([made["n"]], pa.int32()), pa.array([made["width"]], pa.int32()), *(pa.array([made[c]], pa.binary()) for c in binary)], names=[f.name for f in packed_kind])

    chunks = work.stored(given.mapInArrow(V.chunked(build, d, scale, chunk), packed_kind))

    def totals(books: np.ndarray):
        def run(batches):
            sums, n = np.zeros(books.shape, object), np.zeros(books.shape[:2], np.int64)
            for batch in batches:
                for row in batch.drop_columns(["vec_id", "label"]).to_pylist():
                    for p, blocks in enumerate(blocks_of(row, parts, w)):
                        s, k = blocks.totals(books[p])
                        sums[p] += s.astype(object)
                        n[p] += k
            place = np.indices(books.shape).reshape(3, -1)
            high, low = V.halves(sums)
            yield pa.record_batch([*(pa.array(x, pa.int32()) for x in place), high, low, pa.array(np.repeat(n.ravel(), w), pa.int64())], names=["part", "entry", "at", "high", "low", "n"])

        return run

    for _ in range(rounds):
        books = books.copy()
        for p, e, at, total, n in V.summed(chunks.mapInArrow(totals(books), "part int, entry int, at int, high bigint, low bigint, n bigint"), ["part", "entry", "at"]):
            if n:
                books[p, e, at] = total // n

    digits = max(2, len(f"{max(0, len(start) - 1):x}"))

    def coded(batches):
        names = np.array([f"{i:0{digits}x}" for i in range(len(start))])
        for batch in batches:
            ids, labels = batch.column("vec_id"), batch.column("label")
            for i, row in enumerate(batch.drop_columns(["vec_id", "label"]).to_pylist()):
                code, error = np.empty((row["n"], parts), names.dtype), np.zeros(row["n"], object)
                for p, blocks in enumerate(blocks_of(row, parts, w)):
                    near, away = blocks.nearest(books[p])
                    code[blocks.order, p] = names[near]
                    error[blocks.order] += away
                text = ["".join(c) for c in code.tolist()]
                yield pa.record_batch([ids.slice(i, 1).flatten(), labels.slice(i, 1).flatten(), pa.array(text, pa.string()), V.as_longs(error)], names=["vec_id", "label", "code", "error"])

    coded_kind = T.StructType([kinds["vec_id"], kinds["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    rows = work.stored(chunks.mapInArrow(coded, coded_kind))
    work.drop(chunks)
    by_label = work.stored(rows.groupBy(F.col("label").alias("of")).agg(V.long_sum("error").alias("label_error")))
    sha = hashlib.sha256(",".join(str(int(x)) for x in books.ravel()).encode()).hexdigest()
    return rows.join(sized(by_label), F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256"))
