"""Data-quality checks. Each returns a lazy DataFrame; none collects keys or counts to the driver."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key that occurs more than once, with its number of rows. Null is a key value."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).filter(F.col("n_rows") > 1)


def duplicate_measures(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Repeated keys, rows that hold them, and rows beyond the first of each key."""
    return duplicate_keys(df, keys).agg(
        F.count("*").alias("repeated_keys"),
        F.coalesce(F.sum("n_rows"), F.lit(0)).alias("rows_in_groups"),
        F.coalesce(F.sum(F.col("n_rows") - 1), F.lit(0)).alias("surplus_rows"),
    )


def null_rows(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNull())


def null_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, n_rows, n_null) for all columns from one pass."""
    counts = df.agg(F.count("*").alias("n"), *[F.count_if(F.col(c).isNull()).alias(f"c{i}") for i, c in enumerate(columns)])
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"c{i}").alias("n_null")) for i, c in enumerate(columns)])
    return counts.select("n", F.explode(pairs).alias("p")).select("p.column_name", F.col("n").alias("n_rows"), "p.n_null")


def orphan_rows(fact: DataFrame, fk: str, master: DataFrame, key: str, null_aware: bool = False) -> DataFrame:
    """Rows of ``fact`` whose non-null ``fk`` no row of ``master`` has.

    ``null_aware`` takes SQL's NOT IN instead: it also keeps null foreign keys
    when the master is empty, and nothing when a master key is null. Spark can
    only broadcast for that form, so the default scales further.
    """
    keys = master.select(F.col(key).alias("__key"))
    if null_aware:
        return fact.alias("__f").join(keys, (F.col(f"__f.{fk}") == keys["__key"]) | (F.col(f"__f.{fk}") == keys["__key"]).isNull(), "left_anti")
    present = fact.filter(F.col(fk).isNotNull())
    return present.join(keys, present[fk] == keys["__key"], "left_anti")


def orphan_count(fact: DataFrame, fk: str, master: DataFrame, key: str) -> DataFrame:
    """(n_orphans): rows are counted by foreign key first, so that only distinct keys meet the master."""
    by_key = fact.filter(F.col(fk).isNotNull()).groupBy(F.col(fk).alias("__fk")).agg(F.count("*").alias("n"))
    unknown = by_key.join(master.select(F.col(key).alias("__key")), F.col("__fk") == F.col("__key"), "left_anti")
    return unknown.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_orphans"))


def known_rows(fact: DataFrame, fk: str, master: DataFrame, key: str) -> DataFrame:
    """Rows of ``fact`` whose ``fk`` is in ``master``."""
    keys = master.select(F.col(key).alias("__key"))
    return fact.join(keys, fact[fk] == keys["__key"], "left_semi")


def _wider(a: DataFrame, x: str, b: DataFrame, y: str) -> T.DataType:
    """The type in which the two columns are compared."""
    return a.select(F.col(x).alias("c")).limit(0).union(b.select(F.col(y).alias("c")).limit(0)).schema["c"].dataType


def quality_summary(df: DataFrame, keys: Sequence[str], columns: Sequence[str], references: Sequence[tuple[str, DataFrame, str]]) -> DataFrame:
    """(check_name, column_name, n): total rows, repeated keys, nulls by column and orphans by foreign key, from one scan.

    Each row gives an entry for its key, which carries the null flags, and one
    for each foreign key; each master row gives one for its key. Entries are
    aggregated before and after the only shuffle, so a key or foreign key that many
    rows share is one row there, and no join is needed: a foreign key is unknown if
    no master row has met it. Null is a key value, but no foreign key.
    """
    kinds = {f"k{i}": df.schema[c].dataType for i, c in enumerate(keys)} | {f"f{j}": _wider(df, fk, master, key) for j, (fk, master, key) in enumerate(references)}

    def entry(tag: int, values: dict[str, Column], flags: Sequence[Column] = (), known: bool = False) -> Column:
        held = [values.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in kinds.items()]
        nulls = [(flags[i].cast("bigint") if flags else F.lit(0).cast("bigint")).alias(f"c{i}") for i in range(len(columns))]
        return F.struct(F.lit(tag).alias("tag"), *held, F.lit(0 if known else 1).cast("bigint").alias("n"), *nulls, F.lit(known).alias("known"))

    entries = [entry(-1, {f"k{i}": F.col(c) for i, c in enumerate(keys)}, [F.col(c).isNull() for c in columns])]
    entries += [entry(j, {f"f{j}": F.col(fk)}) for j, (fk, _, _) in enumerate(references)]
    rows = df.select(F.inline(F.array(*entries)))
    for j, (_, master, key) in enumerate(references):
        rows = rows.unionByName(master.select(F.inline(F.array(entry(j, {f"f{j}": F.col(key)}, known=True)))))
    sums = [F.sum(c).alias(c) for c in ("n", *(f"c{i}" for i in range(len(columns))))]
    met = rows.groupBy("tag", *kinds).agg(*sums, F.max("known").alias("known"))
    own = F.col("tag") == -1
    of = lambda value, hit: F.coalesce(F.sum(F.when(hit, F.col(value))), F.lit(0))
    found = met.agg(
        of("n", own).alias("total"),
        *[of(f"c{i}", own).alias(f"c{i}") for i in range(len(columns))],
        F.count_if(own & (F.col("n") > 1)).alias("repeated"),
        *[of("n", (F.col("tag") == j) & F.col(f"f{j}").isNotNull() & ~F.col("known")).alias(f"o{j}") for j in range(len(references))],
    )
    named = [("total", "*", "total"), *(("null", c, f"c{i}") for i, c in enumerate(columns)), ("duplicate", ",".join(keys), "repeated"), *(("orphan", fk, f"o{j}") for j, (fk, _, _) in enumerate(references))]
    return found.select(F.inline(F.array(*[F.struct(F.lit(check).alias("check_name"), F.lit(column).alias("column_name"), F.col(value).alias("n")) for check, column, value in named])))
