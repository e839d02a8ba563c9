"""Operator 10: first-fit decreasing packing with a tournament tree, in randomised groups."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe
from .common import give_back, per_batch, rows_of

#: Bytes of text and rows that a group holds on average; a document's full sequences are dealt to many groups.
GROUP_BYTES, GROUP_ROWS = 2 << 20, 1 << 13
_MIX = np.uint64(0xBF58476D1CE4E5B9)


class FirstFit:
    """Bins in order of their opening, under a tournament tree whose nodes hold the largest room below them."""

    def __init__(self, bins: int, capacity: int):
        self.width = 1 << max(0, (max(1, bins) - 1).bit_length())
        self.room = [capacity] * (2 * self.width)

    def put(self, size: int) -> int:
        """Put an item in the first bin with room for it."""
        room, at = self.room, 1
        while at < self.width:
            at *= 2
            if room[at] < size:
                at += 1
        found = at - self.width
        room[at] -= size
        at //= 2
        while at:
            room[at] = max(room[2 * at], room[2 * at + 1])
            at //= 2
        return found


def pack_sizes(sizes: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Bins of (item, start, length) that hold each item whole or cut.

    First-fit decreasing comes first. Then the emptiest bins are emptied into
    the room of the fullest ones, cutting pieces where they do not fit, and
    what the last one holds is cut into bins of powers of two. So no bin but
    those has room left, and none needs padding.
    """
    tree = FirstFit(len(sizes), capacity)
    bins: dict[int, list[tuple[int, int, int]]] = {}
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        if sizes[i]:
            bins.setdefault(tree.put(sizes[i]), []).append((i, 0, sizes[i]))
    full = sorted(bins.values(), key=lambda b: -sum(p[2] for p in b))
    done, lo, hi = [], 0, len(full) - 1
    while lo < hi:
        room = capacity - sum(p[2] for p in full[lo])
        while room and lo < hi:
            item, start, n = full[hi].pop()
            take = min(n, room)
            full[lo].append((item, start + n - take, take))
            room -= take
            if n > take:
                full[hi].append((item, start, n - take))
            if not full[hi]:
                hi -= 1
        if room:
            break
        done.append(full[lo])
        lo += 1
    rest = [p for b in full[lo : hi + 1] for p in b]
    left = sum(p[2] for p in rest)
    if left == capacity:
        return [*done, rest] if rest else done
    while left:
        size, part = 1 << (left.bit_length() - 1), []
        left -= size
        while size:
            item, start, n = rest.pop()
            take = min(n, size)
            part.append((item, start + n - take, take))
            size -= take
            if n > take:
                rest.append((item, start, n - take))
        done.append(part)
    return done


def pack(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 1, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Pieces of the token ids of all documents, packed into sequences of at most ``capacity``.

    Returns (doc_id, start, length, ids, doc_tokens, sequence_id, offset): ``ids``
    are the piece's ids as little-endian 32-bit integers. A document's ids are
    those of its text and then ``end_id``; a null or empty text has that one
    alone. Sequences are full, or a power of two long. Each is made within one
    group of documents, dealt by hash, so repeated rows and ties only matter
    there; a row that repeats is packed each time. Columns other than doc_id
    and text are ignored. An empty table gives no piece.

    A task cuts each document into full sequences and a rest. A piece's group
    follows from its row, its start, its partition and how many rows like it
    came before there, so a group's size follows neither the longest document
    nor the most repeated row, and a task that runs again deals alike.
    """
    slim = docs.select("doc_id", "text")
    total, rows = slim.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    groups = max(1, -(-(total or 0) // group_bytes), -(-rows // GROUP_ROWS))
    slim = slim.withColumn("row_hash", F.xxhash64("doc_id", "text"))
    kind = slim.schema["doc_id"]
    cut_kind = T.StructType([T.StructField("grp", T.IntegerType()), kind, T.StructField("start", T.LongType()), T.StructField("doc_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
    out_kind = T.StructType([kind, T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("doc_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def cut(batch: pa.RecordBatch, seen: dict[int, int], partition: int) -> pa.RecordBatch:
        bounds, ids = bpe.ids_of(path, batch.column("text"))
        n = np.diff(bounds) + 1
        width = "<u2" if end_id < 1 << 16 and (not len(ids) or int(ids.max()) < 1 << 16) else "<u4"
        all_ids = np.full(int(n.sum()), end_id, width)
        ends = np.cumsum(n)
        at = np.ones(len(all_ids), bool)
        at[ends - 1] = False
        all_ids[at] = ids
        pieces = -(-n // capacity)
        row = rows_of(np.concatenate([[0], np.cumsum(pieces)]))
        start = (np.arange(len(row)) - (np.cumsum(pieces) - pieces)[row]) * capacity
        raw, size = all_ids.tobytes(), all_ids.itemsize
        base = (ends - n)[row] + start
        length = np.minimum(capacity, n[row] - start)
        like = batch.column("row_hash").to_pylist()
        times = np.empty(len(like), np.uint64)
        for i, h in enumerate(like):
            times[i] = seen[h] = seen.get(h, -1) + 1
        key = batch.column("row_hash").to_numpy().view(np.uint64)[row] + start.astype(np.uint64) * _MIX
        key = (key ^ (key >> np.uint64(31))) * _MIX + ((np.uint64(partition) << np.uint64(32)) + times[row]) * np.uint64(0x9E3779B97F4A7C15)
        keys = ((key ^ (key >> np.uint64(29))) * _MIX >> np.uint64(33)) % np.uint64(groups)
        blobs = [raw[a * size : (a + k) * size] if size == 4 else b"\x02" + raw[a * size : (a + k) * size] for a, k in zip(base.tolist(), length.tolist(), strict=True)]
        return pa.record_batch(
            [pa.array(keys.astype(np.int32)), batch.column("doc_id").take(pa.array(row)), pa.array(start, pa.int64()), pa.array(n[row], pa.int64()), pa.array(blobs, pa.binary())],
            names=[f.name for f in cut_kind],
        )

    def fit(rows: pa.Table) -> pa.Table:
        grp = rows.column("grp")[0].as_py()
        order = np.argsort(rows.column("start").to_numpy(), kind="stable")
        rows = rows.take(pa.array(order))
        # an odd number of bytes marks ids of two bytes
        ids = [np.frombuffer(b[1:], "<u2").astype("<u4") if len(b) % 2 else np.frombuffer(b, "<u4") for b in rows.column("ids").to_pylist()]
        bins = pack_sizes([len(x) for x in ids], capacity)
        flat = [(i, s, k, b, o) for b, pieces in enumerate(bins) for (i, s, k), o in zip(pieces, np.cumsum([0, *[p[2] for p in pieces]]).tolist(), strict=False)]
        item, cut_at, length, bin_no, offset = (np.array(x, np.int64) for x in zip(*flat, strict=True))
        take = pa.array(item)
        give_back()
        return pa.table(
            [
                rows.column("doc_id").take(take),
                pa.array(rows.column("start").to_numpy()[item] + cut_at),
                pa.array(length),
                pa.array([ids[i][s : s + k].tobytes() for i, s, k, _, _ in flat], pa.binary()),
                rows.column("doc_tokens").take(take),
                pa.array((grp << 32) + bin_no),
                pa.array(offset),
            ],
            names=[f.name for f in out_kind],
        )

    def cut_all(batches):
        seen: dict[int, int] = {}
        yield from per_batch(partial(cut, seen=seen, partition=TaskContext.get().partitionId()))(batches)

    return slim.mapInArrow(cut_all, cut_kind).groupBy("grp").applyInArrow(fit, out_kind)
