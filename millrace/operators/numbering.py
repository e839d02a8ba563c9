"""Dense row numbers over any keys, without a window over all rows."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bits of a row's place within its partition in what ``monotonically_increasing_id`` gives.
PLACE_BITS = 33


@dataclass(frozen=True)
class Numbered:
    """Rows with their numbers, the number of rows, and the folder that holds them."""

    rows: DataFrame
    total: int
    folder: str


def staging_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share; only a local session may be without it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/millrace-{uuid.uuid4().hex}"


def offsets(totals: DataFrame, part: str, n: str) -> DataFrame:
    """(part, before): the sum of ``n`` over the smaller parts. For one row for each partition, which one task can hold."""
    before = F.sum(n).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    return totals.select(F.col(part).alias("part"), F.coalesce(before, F.lit(0)).alias("before"))


def dense_numbers(df: DataFrame, order_by: list[str | Column], name: str = "number", start: int = 1) -> Numbered:
    """``df`` with the numbers start, start + 1, ... in a stated order, as a column ``name``.

    Rows are dealt to ranges of the order and written once with their place in their
    range; the counts of the ranges, one row each, then give each range's first
    number. So one shuffle moves the rows, no task holds more than a range, and
    a range that runs again can't number otherwise. Ties are numbered in some
    order; they are dealt by their place in the input, too, so rows of one key
    fill several ranges. A column of that name is replaced. Without rows there are none.
    """
    spark = df.sparkSession
    given = df.drop(name)
    order = [F.col(c) if isinstance(c, str) else c for c in order_by]
    taken = set(given.columns)
    free = lambda base: next(c for c in (base, *(f"{base}{i}" for i in range(len(taken) + 1))) if c not in taken)
    tie, place, of, before = map(free, ("__tie", "__place", "__of", "__before"))
    ranged = given.withColumn(tie, F.xxhash64(F.monotonically_increasing_id())).repartitionByRange(*order, tie).sortWithinPartitions(*order, tie)
    folder = staging_folder(spark)
    ranged.drop(tie).withColumn(place, F.monotonically_increasing_id()).write.parquet(folder)
    placed = spark.read.parquet(folder)
    part = F.shiftright(place, PLACE_BITS)
    first = offsets(placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")), "part", "n").select(F.col("part").alias(of), F.col("before").alias(before))
    within = F.col(place).bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    numbered = placed.join(F.broadcast(first), part == F.col(of)).withColumn(name, F.col(before) + within + F.lit(start)).select(*given.columns, name)
    return Numbered(numbered, placed.count(), folder)
