"""Idempotent publishing of DataFrames as catalog tables.

A Parquet load writes a table of its own, a version, and then moves the
table's name to it: the name is a view on the current version, whose
replacement is a single change of the catalog. Until then readers see the old
rows and the old schema, so a load may fail anywhere, and may read the table it
replaces. The view carries the id of the load that it shows, which makes the
name itself the proof of what was committed; the load log repeats it.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.draws import grouped, grouped_right

OPERATION = "CREATE OR REPLACE TABLE AS SELECT"
LOG_SCHEMA = T.StructType(
    [
        T.StructField("table_name", T.StringType(), False),
        T.StructField("load_id", T.StringType(), False),
        T.StructField("timestamp", T.TimestampType(), False),
        T.StructField("operation", T.StringType(), False),
        T.StructField("operation_parameters", T.MapType(T.StringType(), T.StringType()), True),
        T.StructField("event", T.StringType(), False),
        T.StructField("version_table", T.StringType(), True),
        T.StructField("n_rows", T.LongType(), True),
    ]
)
#: Events of a load in its log: every load begins, and then is committed or fails.
BEGUN, COMMITTED, FAILED = "begun", "committed", "failed"
#: Between a table's name and the rest of its versions' names, and the view's property for the load it shows.
VERSION_MARK, LOAD_PROPERTY = "__load_", "millrace.load_id"


def create_database(sp: SparkSession, name: str, location: str | None = None) -> None:
    """Create the database unless it is there. ``location`` matters for the in-memory
    catalog, which refuses a table directory left by an earlier session."""
    at = f" LOCATION '{location}'" if location else ""
    sp.sql(f"CREATE DATABASE IF NOT EXISTS {name}{at}")


def drop_database(sp: SparkSession, name: str) -> None:
    """Drop the database with its tables, if it is there."""
    sp.sql(f"DROP DATABASE IF EXISTS {name} CASCADE")


def use_database(sp: SparkSession, name: str) -> str:
    """Make ``name`` current and return the database that was current before."""
    before = sp.catalog.currentDatabase()
    sp.catalog.setCurrentDatabase(name)
    return before


def register_views(frames: Mapping[str, DataFrame]) -> None:
    for name, df in frames.items():
        df.createOrReplaceTempView(name)


def _qualified(sp: SparkSession, table: str) -> str:
    return table if "." in table else f"{sp.catalog.currentDatabase()}.{table}"


def current_load(sp: SparkSession, table: str) -> str | None:
    """The id of the load that the table's name shows; None if there is no such name or it isn't one of these."""
    if not sp.catalog.tableExists(table):
        return None
    found = {r[0]: r[1] for r in sp.sql(f"SHOW TBLPROPERTIES {table}").collect()}
    return found.get(LOAD_PROPERTY)


def versions(sp: SparkSession, table: str) -> list[str]:
    """The names of the table's stored versions, oldest first, committed or not."""
    database, name = _qualified(sp, table).rsplit(".", 1)
    found = sp.sql(f"SHOW TABLES IN {database} LIKE '{name}{VERSION_MARK}*'").collect()
    return sorted(f"{database}.{r.tableName}" for r in found if not r.isTemporary)


def vacuum(sp: SparkSession, table: str, keep: int = 1, before: str | None = None) -> list[str]:
    """Drop stored versions but the current one and the ``keep`` last ones before it; returns what was dropped.

    What was begun after the current version is left alone, as its load may still be under way.
    """
    load = current_load(sp, table)
    known = versions(sp, table)
    current = [i for i, v in enumerate(known) if load and v.endswith(load)]
    if not current:
        return []
    gone = known[: max(0, current[0] - keep)]
    for version in gone:
        sp.sql(f"DROP TABLE IF EXISTS {version}")
    return gone


def _logged(sp: SparkSession, log: str | None, table: str, load_id: str, event: str, parameters: Mapping[str, str], version: str | None = None, n_rows: int | None = None) -> None:
    if log:
        row = (table, load_id, dt.datetime.now(dt.timezone.utc), OPERATION, dict(parameters), event, version, n_rows)
        sp.createDataFrame([row], LOG_SCHEMA).coalesce(1).write.format("parquet").mode("append").saveAsTable(log)


def _point(sp: SparkSession, table: str, version: str, load_id: str) -> None:
    """Move the table's name to a version, in one change of the catalog."""
    sp.sql(f"CREATE OR REPLACE VIEW {table} TBLPROPERTIES ('{LOAD_PROPERTY}' = '{load_id}') AS SELECT * FROM {version}")


def _adopt(sp: SparkSession, table: str) -> None:
    """A plain table of that name becomes the first version, once."""
    if sp.catalog.tableExists(table) and sp.catalog.getTable(table).tableType != "VIEW":
        load_id = f"{0:020d}_{uuid.uuid4().hex[:12]}"
        version = f"{table}{VERSION_MARK}{load_id}"
        sp.sql(f"ALTER TABLE {table} RENAME TO {version}")
        _point(sp, table, version, load_id)


def _repair(sp: SparkSession, table: str, log: str | None) -> None:
    """If the session of the last load ended between its commit and the log, the log gets the row that it lacks."""
    load = current_load(sp, table)
    if log and load and sp.catalog.tableExists(log):
        rows = sp.table(log).filter((F.col("table_name") == table) & (F.col("load_id") == load)).collect()  # of one load
        begun = [r for r in rows if r.event == BEGUN]
        if begun and not any(r.event == COMMITTED for r in rows):
            _logged(sp, log, table, load, COMMITTED, begun[0].operation_parameters or {}, begun[0].version_table)


def publish(sp: SparkSession, df: DataFrame, table: str, fmt: str = "parquet", log: str | None = None, keep: int = 1, counted: Observation | None = None) -> DataFrame:
    """Replace ``table`` by ``df``, schema included, and return it as a table scan.

    A repeat leaves the same table, not twice the rows. If the load fails, the
    table stays as it was; ``df`` may read the table itself. ``keep`` earlier
    versions stay for those who still read them. With ``log`` each load adds
    rows to that log table: when it begins, and when it is committed, with the
    rows that the write itself counted, or has failed. ``counted`` observes
    those rows as n_rows for the caller. ``fmt="delta"`` needs the connector on
    the class path and leaves versions and history to it.
    """
    seen = counted or Observation()
    parameters = {"format": fmt, "mode": "overwrite"}
    if fmt == "delta":
        df.observe(seen, F.count(F.lit(1)).alias("n_rows")).write.format(fmt).mode("overwrite").option("overwriteSchema", "true").saveAsTable(table)
        return sp.table(table)
    # the clock only orders a table's versions
    load_id = f"{dt.datetime.now(dt.timezone.utc):%Y%m%d%H%M%S%f}_{uuid.uuid4().hex[:12]}"
    table = _qualified(sp, table)
    version = f"{table}{VERSION_MARK}{load_id}"
    _repair(sp, table, log)
    _logged(sp, log, table, load_id, BEGUN, parameters, version)
    try:
        # right below the write, in its last stage, a row is counted once whatever is run again
        df.observe(seen, F.count(F.lit(1)).alias("n_rows")).write.format(fmt).mode("error").saveAsTable(version)
        _adopt(sp, table)
        _point(sp, table, version, load_id)
    except BaseException:
        if current_load(sp, table) != load_id:
            sp.sql(f"DROP TABLE IF EXISTS {version}")
            _logged(sp, log, table, load_id, FAILED, parameters)
        raise
    _logged(sp, log, table, load_id, COMMITTED, parameters, version, seen.get["n_rows"])
    vacuum(sp, table, keep)
    return sp.table(table)


def loads(sp: SparkSession, table: str, log: str) -> DataFrame:
    """(load_id, timestamp, operation, operation_parameters, status, version_table, n_rows): every load that the log has begun.

    A load without a further row is committed if the table's name shows it,
    and else has failed, or is still under way.
    """
    table = _qualified(sp, table)
    at = lambda event, column: F.max(F.when(F.col("event") == event, F.col(column)))
    done = (F.count_if(F.col("event") == COMMITTED) > 0) | F.col("load_id").eqNullSafe(F.lit(current_load(sp, table)))
    rows = sp.table(log).filter(F.col("table_name") == table).groupBy("load_id")
    return rows.agg(
        F.coalesce(at(COMMITTED, "timestamp"), F.min("timestamp")).alias("timestamp"),
        F.first("operation").alias("operation"),
        F.first("operation_parameters").alias("operation_parameters"),
        F.when(done, COMMITTED).otherwise(FAILED).alias("status"),
        at(BEGUN, "version_table").alias("version_table"),
        at(COMMITTED, "n_rows").alias("n_rows"),
    )


def history(sp: SparkSession, table: str, fmt: str = "parquet", log: str | None = None) -> DataFrame:
    """Committed loads of ``table`` with a version from 0, newest last.

    Delta keeps its own history. For other formats the version is counted on
    read from the load log, so writers never race for a number; loads that
    failed have none.
    """
    if fmt == "delta":
        return sp.sql(f"DESCRIBE HISTORY {table}").select("version", "timestamp", "operation", F.col("operationParameters").alias("operation_parameters"))
    order = Window.orderBy("timestamp", "load_id")  # over the loads of one table
    rows = loads(sp, table, log).filter(F.col("status") == COMMITTED)
    return rows.select((F.row_number().over(order) - 1).cast("bigint").alias("version"), "timestamp", "operation", "operation_parameters", "load_id", "version_table", "n_rows")


def as_of(sp: SparkSession, table: str, version: int, log: str) -> DataFrame:
    """The table as it was at a version that is still stored."""
    found = history(sp, table, log=log).filter(F.col("version") == version).first()
    if found is None or not sp.catalog.tableExists(found.version_table):
        raise ValueError(f"{table} has no stored version {version}")
    return sp.table(found.version_table)


def load_tables(sp: SparkSession, frames: Mapping[str, DataFrame], fmt: str = "parquet", log: str | None = None) -> DataFrame:
    """Publish each frame under its name; (table_name, n_rows) as the writes counted them. No table is read again."""
    counts = []
    for table, df in frames.items():
        seen = Observation()
        publish(sp, df, table, fmt, log, counted=seen)
        counts.append((table, seen.get["n_rows"]))
    return sp.createDataFrame(counts, "table_name string, n_rows bigint")


def table_counts(sp: SparkSession, tables: Sequence[str]) -> DataFrame:
    """(table_name, n_rows), counted by reading the tables back, in one query."""
    parts = [sp.table(t).agg(F.count("*").alias("n_rows")).select(F.lit(t).alias("table_name"), "n_rows") for t in tables]
    return reduce(DataFrame.unionByName, parts)


def check_loads(sp: SparkSession, written: DataFrame) -> DataFrame:
    """(table_name, n_written, n_read, agrees): what the writes counted beside what is read back."""
    read = table_counts(sp, [r.table_name for r in written.select("table_name").collect()])  # of a few tables
    both = written.withColumnRenamed("n_rows", "n_written").join(read.withColumnRenamed("n_rows", "n_read"), "table_name", "left")
    return both.withColumn("agrees", F.col("n_written").eqNullSafe(F.col("n_read")))


def load_summary(counts: DataFrame) -> DataFrame:
    """Counts with their display texts."""
    n = F.col("n_rows")
    return counts.select("table_name", "n_rows", grouped(n).alias("n_rows_text"), grouped_right(n).alias("n_rows_right"))


def write_parquet(df: DataFrame, out_dir: str, name: str) -> str:
    """Replace one Parquet directory below ``out_dir``; returns its path."""
    path = f"{out_dir}/{name}"
    df.write.mode("overwrite").parquet(path)
    return path


def preview(df: DataFrame, n: int, order_by: Sequence[str]) -> DataFrame:
    """The first ``n`` rows by a stated order; printing is left to the caller."""
    return df.orderBy(*order_by).limit(n)
