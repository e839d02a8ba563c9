"""Scans: Parquet tables by directory, catalog tables, views and integer ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(sp: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return sp.read.parquet(f"{sf_dir}/{name}.parquet")


def catalog_table(sp: SparkSession, name: str) -> DataFrame:
    return sp.table(name)


def sequence(sp: SparkSession, lo: int, hi: int, partitions: int | None = None) -> DataFrame:
    """Integers from ``lo`` up to, not including, ``hi``."""
    return sp.range(lo, hi, 1, partitions)


def sequences(df: DataFrame, lo: Column, hi: Column, name: str = "id") -> DataFrame:
    """Each row with each integer from its ``lo`` up to, not including, its ``hi``; rows without any are left out."""
    return df.select("*", F.explode(F.when(lo < hi, F.sequence(lo, hi - 1))).alias(name))


def view_head(sp: SparkSession, view: str, order_by: str, n: int) -> DataFrame:
    """The first ``n`` rows of a registered view by a stated order, through SQL."""
    return sp.sql(f"SELECT * FROM {view} ORDER BY {order_by} LIMIT {n}")
