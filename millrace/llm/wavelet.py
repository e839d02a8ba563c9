"""Operator 11: token ids in shard files, each a wavelet matrix over compressed bit planes.

A shard's distinct ids are numbered by falling frequency, so that the upper planes of
the numbers are mostly zeros. Each plane holds one bit of every number, in the
order to which the planes above have sorted them. Planes are cut into blocks,
compressed each for itself, with the ones before each block beside them: so a
token, a count or an occurrence is found by reading one block of each plane.

Shards are written by Spark's own file writer, one record to a file, and so
are whole or absent whichever executors are lost, in any file system that
Spark writes to.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe
from .common import FREE_SHUFFLES, give_back, rows_of, slices

MAGIC = b"MRWAVE1\0"
#: Tokens from which a shard is full; bits of a block.
SHARD_TOKENS, BLOCK_BITS = 1 << 22, 1 << 16
_HEADER = np.dtype([(n, "<i8") for n in ("n", "docs", "distinct", "planes", "block_bits", "part", "before")])
_NULL = np.iinfo(np.int64).min


def _pressed(raw: bytes) -> bytes:
    """The bytes with a mark before them, compressed if that is shorter."""
    small = pa.compress(raw, codec="zstd", asbytes=True) if raw else raw
    return b"\x01" + small if len(small) < len(raw) else b"\x00" + raw


def _plain(stored, size: int) -> np.ndarray:
    """What ``_pressed`` was given."""
    raw = pa.decompress(bytes(stored[1:]), size, codec="zstd", asbytes=True) if bytes(stored[:1]) == b"\x01" else stored[1:]
    return np.frombuffer(raw, np.uint8, size)


def encoded(ids: np.ndarray, sizes: np.ndarray, doc_ids: np.ndarray, nulls: np.ndarray, part: int = 0, before: int = 0, block_bits: int = BLOCK_BITS) -> bytes:
    """A shard: the ids of documents of these sizes, one after the other.

    ``part`` is the number of the task that wrote it and ``before`` the ids in that task's shards before it.
    """
    n = len(ids)
    count = np.bincount(ids, minlength=1) if n and int(ids.max()) < max(1 << 22, 4 * n) else None
    if count is not None:
        alphabet = np.flatnonzero(count)
        alphabet = alphabet[np.argsort(-count[alphabet], kind="stable")]
        number = np.zeros(len(count), np.uint32)
        number[alphabet] = np.arange(len(alphabet), dtype=np.uint32)
        codes = number[ids]
    else:
        values, back, times = np.unique(ids, return_inverse=True, return_counts=True)
        order = np.argsort(-times, kind="stable")
        alphabet, number = values[order], np.empty(len(values), np.uint32)
        number[order] = np.arange(len(values), dtype=np.uint32)
        codes = number[back]
    planes = max(0, len(alphabet) - 1).bit_length()
    codes = codes.astype(np.uint16) if planes <= 16 else codes
    zeros, ranks, lengths, blocks = [], [], [], []
    step = block_bits // 8
    for plane in reversed(range(planes)):
        on = (codes & codes.dtype.type(1 << plane)) != 0
        bits = np.packbits(on, bitorder="little")
        ones = np.add.reduceat(np.bitwise_count(bits).astype(np.int64), np.arange(0, len(bits), step))
        ranks.append(np.cumsum(ones) - ones)
        zeros.append(n - int(ones.sum()))
        raw = bits.tobytes()
        for at in range(0, len(raw), step):
            blocks.append(_pressed(raw[at : at + step]))
            lengths.append(len(blocks[-1]))
        codes = np.concatenate([codes[~on], codes[on]]) if plane else codes
    header = np.array([(n, len(sizes), len(alphabet), planes, block_bits, part, before)], _HEADER)
    parts = [np.asarray(alphabet, "<u4"), np.asarray(np.where(nulls, _NULL, doc_ids), "<i8"), np.asarray(sizes, "<i8"), np.asarray(zeros, "<i8"), np.concatenate(ranks or [np.zeros(0, np.int64)]).astype("<i8"), np.asarray(lengths, "<i8")]
    tables = [_pressed(x.tobytes()) for x in parts]
    return MAGIC + header.tobytes() + np.array([len(t) for t in tables], "<i8").tobytes() + b"".join(tables) + b"".join(blocks)


class Shard:
    """A shard file's content; whatever follows the last block is not looked at."""

    def __init__(self, content):
        view = memoryview(content)
        if bytes(view[:8]) != MAGIC:
            raise ValueError("not a shard file")
        at = 8 + _HEADER.itemsize
        for name, value in zip(_HEADER.names, np.frombuffer(view[8:at], _HEADER)[0].tolist(), strict=True):
            setattr(self, name, value)
        lengths = np.frombuffer(view[at : at + 48], "<i8").tolist()
        at += 48
        per_plane = -(-self.n // self.block_bits)
        kinds = (("<u4", self.distinct), ("<i8", self.docs), ("<i8", self.docs), ("<i8", self.planes), ("<i8", self.planes * per_plane), ("<i8", self.planes * per_plane))
        tables = []
        for size, (kind, count) in zip(lengths, kinds, strict=True):
            tables.append(_plain(view[at : at + size], count * int(kind[-1])).view(kind))
            at += size
        self.alphabet, ids, self.sizes, self.zeros, ranks, sizes = tables
        self.null, self.doc_ids = ids == _NULL, ids
        self.ranks, self.block_at = ranks.reshape(self.planes, per_plane), (at + np.concatenate([[0], np.cumsum(sizes)])).astype(np.int64)
        self.view, self.per_plane = view, per_plane
        self.number = {int(x): i for i, x in enumerate(self.alphabet)} if self.distinct < 1 << 12 else None
        self.bits = lru_cache(4 * max(1, self.planes))(self._bits)

    def _block(self, plane: int, block: int) -> np.ndarray:
        k = plane * self.per_plane + block
        size = min(self.block_bits, self.n - block * self.block_bits)
        return _plain(self.view[self.block_at[k] : self.block_at[k + 1]], -(-size // 8))

    def _bits(self, plane: int, block: int) -> np.ndarray:
        """The block's bits, and the ones before each and at the end."""
        size = min(self.block_bits, self.n - block * self.block_bits)
        return np.unpackbits(self._block(plane, block), bitorder="little", count=size)

    def _code(self, token: int) -> int | None:
        if self.number is not None:
            return self.number.get(token)
        found = np.flatnonzero(self.alphabet == token)
        return int(found[0]) if len(found) else None

    def _ones(self, plane: int, i: int) -> int:
        """Ones before position i."""
        block = min(i // self.block_bits, self.per_plane - 1)
        return int(self.ranks[plane, block]) + int(self.bits(plane, block)[: i - block * self.block_bits].sum())

    def token(self, i: int) -> int:
        """The id at position i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        code = 0
        for plane in range(self.planes):
            ones = self._ones(plane, i)
            bit = int(self.bits(plane, i // self.block_bits)[i % self.block_bits])
            code = code << 1 | bit
            i = int(self.zeros[plane]) + ones if bit else i - ones
        return int(self.alphabet[code])

    def _span(self, code: int, start: int, end: int) -> tuple[int, int]:
        """Where the occurrences in [start, end) have come to below the last plane."""
        for plane in range(self.planes):
            a, b = self._ones(plane, start), self._ones(plane, end)
            if code >> (self.planes - 1 - plane) & 1:
                start, end = int(self.zeros[plane]) + a, int(self.zeros[plane]) + b
            else:
                start, end = start - a, end - b
            if start == end:
                break
        return start, end

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """How often the id occurs in [start, end)."""
        end = self.n if end is None else end
        code = self._code(token)
        if code is None or start >= end:
            return 0
        a, b = self._span(code, start, end)
        return b - a

    def occurrences(self, token: int, start: int = 0, end: int | None = None) -> np.ndarray:
        """The positions of the id in [start, end), ascending."""
        end = self.n if end is None else end
        code = self._code(token)
        if code is None or start >= end:
            return np.zeros(0, np.int64)
        a, b = self._span(code, start, end)
        at = np.arange(a, b)
        for plane in reversed(range(self.planes)):
            bit = code >> (self.planes - 1 - plane) & 1
            at = self._select(plane, bit, at - (int(self.zeros[plane]) if bit else 0))
        return at

    def nth(self, token: int, k: int) -> int:
        """The position of the k-th occurrence of the id, from 0; -1 if there are fewer."""
        code = self._code(token)
        if code is None:
            return -1
        a, b = self._span(code, 0, self.n)
        if not 0 <= k < b - a:
            return -1
        at = np.array([a + k])
        for plane in reversed(range(self.planes)):
            bit = code >> (self.planes - 1 - plane) & 1
            at = self._select(plane, bit, at - (int(self.zeros[plane]) if bit else 0))
        return int(at[0])

    def _select(self, plane: int, bit: int, k: np.ndarray) -> np.ndarray:
        """Positions of the k-th bits of that kind, for ascending k from 0."""
        before = self.ranks[plane] if bit else np.arange(self.per_plane) * self.block_bits - self.ranks[plane]
        block = np.searchsorted(before, k, "right") - 1
        out = np.empty(len(k), np.int64)
        edges = np.flatnonzero(np.diff(block, prepend=-1))
        for a, b in zip(edges, np.append(edges, len(k))[1:], strict=True):
            j = int(block[a])
            out[a:b] = j * self.block_bits + np.flatnonzero(self.bits(plane, j) == bit)[k[a:b] - before[j]]
        return out

    def ids(self) -> np.ndarray:
        """All ids."""
        kind = np.uint16 if self.planes <= 16 else np.uint32
        codes = np.zeros(self.n, kind)
        for plane in reversed(range(self.planes)):
            raw = np.concatenate([self._block(plane, j) for j in range(self.per_plane)])
            on = np.unpackbits(raw, bitorder="little", count=self.n).view(bool)
            z = int(self.zeros[plane])
            out = np.empty_like(codes)
            out[~on] = codes[:z]
            out[on] = codes[z:] | kind(1 << (self.planes - 1 - plane))
            codes = out
        return self.alphabet[codes] if self.distinct else np.zeros(0, "<u4")


def write_ids(docs: DataFrame, path: str, out: str, end_id: int = 0, shard_tokens: int = SHARD_TOKENS) -> str:
    """Write the token ids of all documents to shard files in the folder ``out``, in ascending order of doc_id; returns it.

    A document's ids are those of the tokenizer library for its text, without added tokens, and then ``end_id``; a null
    or empty text has that one alone. Null ids come last; rows that share a doc_id are ordered by a hash of the text. A
    shard ends with the document that fills it, so a task holds one shard and one text at a time,
    whatever its share of the rows. doc_id must be an integer; other columns are ignored. Without rows there are no shards.
    """
    spark = docs.sparkSession
    key = F.col("doc_id").cast("bigint")
    order = ["__null", "doc_id", "__text", "__row"]
    # rows that repeat are split by place, too, so that no doc_id fills one range
    rows = docs.select(key.isNull().alias("__null"), key.alias("doc_id"), F.xxhash64("text").alias("__text"), F.xxhash64(F.monotonically_increasing_id()).alias("__row"), "text")
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")

    def shards(batches):
        part, before, n, held = TaskContext.get().partitionId(), 0, 0, []

        def made() -> pa.RecordBatch:
            ids, sizes, keys = (np.concatenate([x[i] for x in held]) for i in range(3))
            nulls = keys == _NULL
            return pa.record_batch([pa.array([encoded(ids, sizes, keys, nulls, part, before)], pa.binary())], names=["content"])

        for batch in batches:
            for some in slices(batch):
                bounds, ids = bpe.byte_ids_of(path, some.column("text"))
                size = np.diff(bounds) + 1
                ends = np.cumsum(size)
                whole = np.full(int(ends[-1]), end_id, "<u4")
                own = np.ones(len(whole), bool)
                own[ends - 1] = False
                whole[own] = ids
                keys = pc.fill_null(some.column("doc_id"), int(_NULL)).to_numpy(zero_copy_only=False)
                at = 0
                while at < len(size):
                    base = int(ends[at - 1]) if at else 0
                    to = min(len(size), int(np.searchsorted(ends, base + shard_tokens - n, "left")) + 1)
                    held.append((whole[base : ends[to - 1]], size[at:to], keys[at:to]))
                    n += int(ends[to - 1]) - base
                    at = to
                    if n >= shard_tokens:
                        yield made()
                        before, n, held = before + n, 0, []
        if held:
            yield made()
        give_back()

    keep = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        # a record to a file; as text, the writer adds one line feed, which readers don't look at
        rows.mapInArrow(shards, "content binary").select(F.col("content").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).option("compression", "none").text(out)
    finally:
        spark.conf.set(FREE_SHUFFLES, keep) if keep else spark.conf.unset(FREE_SHUFFLES)
    return out


def files(spark: SparkSession, folder: str) -> DataFrame:
    """(content) of each shard file; a task without rows may have left an empty one."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).filter("length > 0").select("content")


def documents(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """(part, at, doc_id, n_tokens, ids_crc32[, ids]) of each document, from the files.

    ``at`` is its start among the ids of the task that wrote it, whose number is ``part``; ids are little-endian 32-bit integers.
    """

    def read(batches):
        for batch in batches:
            for content in batch.column("content"):
                shard = Shard(content.as_buffer())
                ids = shard.ids().astype("<u4", copy=False)
                ends = np.cumsum(shard.sizes)
                raw = memoryview(ids).cast("B")
                places = list(zip((4 * (ends - shard.sizes)).tolist(), (4 * ends).tolist(), strict=True))
                columns = [
                    pa.array(np.full(shard.docs, shard.part), pa.int64()),
                    pa.array(shard.before + ends - shard.sizes, pa.int64()),
                    pa.array(shard.doc_ids, pa.int64(), mask=shard.null),
                    pa.array(shard.sizes, pa.int64()),
                    pa.array([zlib.crc32(raw[a:b]) for a, b in places], pa.int64()),
                ]
                if with_ids:
                    columns.append(pa.array([raw[a:b].tobytes() for a, b in places], pa.binary()))
                yield pa.record_batch(columns, names=["part", "at", "doc_id", "n_tokens", "ids_crc32", "ids"][: len(columns)])
                del ids, raw, shard
        give_back()

    kind = "part bigint, at bigint, doc_id bigint, n_tokens bigint, ids_crc32 bigint" + (", ids binary" if with_ids else "")
    return files(spark, folder).mapInArrow(read, kind)


def with_starts(found: DataFrame) -> DataFrame:
    """``found`` with start, the ids of all documents before: those of its own task and of the tasks before it.

    The running sum goes over one row for each task that wrote shards.
    """
    totals = found.groupBy(F.col("part").alias("of")).agg(F.sum("n_tokens").alias("n"))
    before = totals.select("of", F.coalesce(F.sum("n").over(Window.orderBy("of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return found.join(F.broadcast(before), F.col("part") == F.col("of")).withColumn("start", F.col("base") + F.col("at")).drop("of", "base")


def counts(spark: SparkSession, folder: str, tokens: list[int]) -> DataFrame:
    """(token, n): how often each id occurs in the files, by ranks alone; an id that is asked for twice counts once."""
    tokens = sorted(set(tokens))

    def count(batches):
        for batch in batches:
            for content in batch.column("content"):
                shard = Shard(content.as_buffer())
                yield pa.record_batch([pa.array(tokens, pa.int64()), pa.array([shard.count(t) for t in tokens], pa.int64())], names=["token", "n"])

    return files(spark, folder).mapInArrow(count, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))


def occurrences(spark: SparkSession, folder: str, tokens: list[int]) -> DataFrame:
    """(token, part, at, doc_id, offset) of each occurrence of the ids, by selects alone; ``offset`` is the place in the document."""
    tokens = sorted(set(tokens))

    def find(batches):
        for batch in batches:
            for content in batch.column("content"):
                shard = Shard(content.as_buffer())
                starts = np.cumsum(shard.sizes) - shard.sizes
                for token in tokens:
                    at = shard.occurrences(token)
                    doc = np.searchsorted(starts, at, "right") - 1
                    yield pa.record_batch(
                        [pa.array(np.full(len(at), token), pa.int64()), pa.array(np.full(len(at), shard.part), pa.int64()), pa.array(shard.before + at, pa.int64()), pa.array(shard.doc_ids[doc], pa.int64(), mask=shard.null[doc]), pa.array(at - starts[doc], pa.int64())],
                        names=["token", "part", "at", "doc_id", "offset"],
                    )

    return files(spark, folder).mapInArrow(find, "token bigint, part bigint, at bigint, doc_id bigint, offset bigint")
