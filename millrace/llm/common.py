"""What the operators share: splits of labelled rows, stored intermediates and word columns."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are worked through in slices of about this many bytes, whatever the size of an Arrow batch.
SLICE_BYTES = 8 << 20


#: Whether a query's shuffle files go when it ends, instead of when the driver collects its garbage.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(key: str | Column, n: int) -> Column:
    """crc32 of the key as text, modulo ``n``; a null key gives null."""
    return F.crc32((F.col(key) if isinstance(key, str) else key).cast("string")) % n


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from ``spark.checkpoint.dir``.

    Only a local session may be without it; it then gets a folder of its own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def drop_folder(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


class Scratch:
    """Tables of one operator call in the shared folder, which can be dropped when nothing reads them any more.

    Writing a table cuts its lineage, in a way that survives lost executors.
    What a returned DataFrame still reads must stay, as it may be evaluated at
    any time and again.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.tables, self.made = spark, f"{shared_dir(spark)}/millrace-{uuid.uuid4().hex}", [], 0

    def stored(self, df: DataFrame) -> DataFrame:
        """``df``, written and read back.

        During the write the session frees shuffle files as soon as a query ends, those of other threads' queries, too.
        """
        path = f"{self.path}/{self.made}"
        self.made += 1
        before = self.spark.conf.get(FREE_SHUFFLES, None)
        self.spark.conf.set(FREE_SHUFFLES, "true")  # the write's own, which nothing reads after it
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(FREE_SHUFFLES, before) if before else self.spark.conf.unset(FREE_SHUFFLES)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.tables.append((table, path))
        return table

    def drop(self, *tables: DataFrame) -> None:
        for table, path in self.tables:
            if any(table is t for t in tables):
                drop_folder(self.spark, path)
        self.tables = [x for x in self.tables if not any(x[0] is t for t in tables)]

    def drop_all_but(self, *kept: DataFrame) -> None:
        self.drop(*(t for t, _ in self.tables if not any(t is k for k in kept)))


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back."""
    return Scratch(df.sparkSession).stored(df)


def unused(df: DataFrame, *names: str) -> list[str]:
    """For each name, one that no column of ``df`` has, in upper or lower case."""
    taken = {c.lower() for c in df.columns}
    return [next(n for n in (f"__{name}{'_' * i}" for i in range(len(taken) + 1)) if n not in taken) for name in names]


def sized(df: DataFrame, most: int = 400_000) -> DataFrame:
    """A stored table of ids marked for broadcast if it has at most ``most`` rows, as counted; else it is left to a shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def slices(batch: pa.RecordBatch, column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts come to about ``size`` bytes; a single longer text is a run of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + size, "right")))
        yield batch.slice(at, to - at)
        at = to


def own(texts: pa.Array) -> pa.Array:
    """The same texts in buffers of their own, from 0: offsets of a cast slice don't start there, which ``ascii_lower`` doesn't heed."""
    return pa.concat_arrays([texts, texts.slice(0, 0)])


def words_of(texts: pa.Array, lower: Callable = pc.ascii_lower) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words between ASCII white space, as (row bounds, codes, distinct words). Null is an empty text.

    Row i has the words ``distinct[codes[bounds[i]:bounds[i + 1]]]``.
    """
    texts = own(pc.fill_null(texts, "")).cast(pa.large_string())
    lists = pc.ascii_split_whitespace(lower(texts) if lower else texts)
    bounds = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    codes, distinct = coded.indices.to_numpy(), coded.dictionary
    bounds = bounds - bounds[0]
    empty = pc.index(distinct, pa.scalar("", distinct.type)).as_py() if len(distinct) else -1
    if empty >= 0:  # from white space at either end
        real = codes != empty
        bounds = np.concatenate([[0], np.cumsum(real)])[bounds]
        codes = codes[real]
    return bounds, codes, distinct


def sums_by_row(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``values[bounds[i]:bounds[i + 1]]`` for each i, 0 for empty runs."""
    if values.dtype.kind == "f":
        return np.bincount(rows_of(bounds), values, len(bounds) - 1)
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def rows_of(bounds: np.ndarray) -> np.ndarray:
    """The row number of each element."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def give_back() -> None:
    """Return freed memory to the system: workers stay between stages, beside the executor's own heap."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def per_batch(fn: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table]) -> Callable:
    """A mapInArrow function that applies ``fn`` to each slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch) if batch.num_rows else ():
                out = fn(part)
                yield from out.to_batches() if isinstance(out, pa.Table) else [out]
                del out
        give_back()

    return run
