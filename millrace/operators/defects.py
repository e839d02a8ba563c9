"""Planted defects in exact numbers, on any DataFrame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.draws import typed_null


def duplicate_first(df: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """``df`` and whole copies of its first ``k`` rows by ``keys``.

    ``keys`` should order the rows fully; the copies come from a top-k, not
    from a sort of the table.
    """
    return df.unionByName(df.orderBy(*keys).limit(k))


def blank_alternately(df: DataFrame, offset: Column, k: int, even: str, odd: str) -> DataFrame:
    """Null ``even`` in rows of even offset and ``odd`` in rows of odd offset, for offsets in [0, k)."""
    hit = (offset >= 0) & (offset < k)
    kinds = dict(df.dtypes)
    return df.withColumns(
        {
            even: F.when(hit & (offset % 2 == 0), typed_null(kinds[even])).otherwise(F.col(even)),
            odd: F.when(hit & (offset % 2 == 1), typed_null(kinds[odd])).otherwise(F.col(odd)),
        }
    )


def break_reference(df: DataFrame, fk: str, hit: Column, replacement: Column) -> DataFrame:
    """Replace ``fk`` by a key that no master row has, where ``hit``."""
    return df.withColumn(fk, F.when(hit, replacement.cast(dict(df.dtypes)[fk])).otherwise(F.col(fk)))
