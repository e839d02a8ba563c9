"""Loads that fail, stop or read their own table; counts from the write; history and versions."""

import datetime as dt

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from millrace.plans import bronze


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def db(spark, request):
    name = f"loads_{abs(hash(request.node.name)) % 10**9}"
    bronze.create_database(spark, name)
    yield name
    bronze.drop_database(spark, name)


def failing(spark, n=2000):
    """A frame whose last partition fails after the others are written."""
    late = F.when(F.col("id") == n - 1, F.raise_error(F.lit("planted"))).otherwise(F.lit("x")).cast("string")
    return spark.range(0, n, 1, 4).withColumn("other", late)


def test_a_failed_load_changes_nothing(spark, db):
    t, log = f"{db}.t", f"{db}.log"
    bronze.publish(spark, spark.range(5), t, log=log)
    before = bronze.versions(spark, t)
    with pytest.raises(Exception, match="planted"):
        bronze.publish(spark, failing(spark), t, log=log)
    assert rows(spark.table(t)) == [(i,) for i in range(5)] and spark.table(t).columns == ["id"]
    assert bronze.versions(spark, t) == before
    assert [r.status for r in bronze.loads(spark, t, log).orderBy("timestamp").collect()] == ["committed", "failed"]
    assert [(r.version, r.n_rows) for r in bronze.history(spark, t, log=log).collect()] == [(0, 5)]
    bronze.publish(spark, spark.range(7), t, log=log)
    assert [(r.version, r.n_rows) for r in bronze.history(spark, t, log=log).orderBy("version").collect()] == [(0, 5), (1, 7)]


def test_a_failed_first_load_leaves_no_table(spark, db):
    with pytest.raises(Exception, match="planted"):
        bronze.publish(spark, failing(spark), f"{db}.t")
    assert not spark.catalog.tableExists(f"{db}.t") and bronze.versions(spark, f"{db}.t") == []


def test_self_overwrite_and_readers_of_the_last_version(spark, db):
    t = f"{db}.t"
    first = bronze.publish(spark, spark.range(10), t)
    second = bronze.publish(spark, first.filter("id > 3").withColumn("twice", F.col("id") * 2), t)
    assert rows(second) == [(i, 2 * i) for i in range(4, 10)]
    assert first.count() == 10  # a frame that was made before the switch reads what it was made for
    third = bronze.publish(spark, spark.table(t).select("twice"), t)
    assert rows(third) == sorted([(2 * i,) for i in range(4, 10)], key=repr)
    assert len(bronze.versions(spark, t)) == 2
    assert len(bronze.vacuum(spark, t, keep=0)) == 1 and third.count() == 6
    assert bronze.vacuum(spark, t, keep=0) == []


def test_a_load_that_stops_before_the_switch_has_failed(spark, db, monkeypatch):
    t, log = f"{db}.t", f"{db}.log"
    bronze.publish(spark, spark.range(3), t, log=log)

    def stop(*_):
        raise SystemExit

    def end(*_):  # the session is gone: no clean-up either
        bronze.current_load = stop
        stop()

    with monkeypatch.context() as m:
        m.setattr(bronze, "current_load", bronze.current_load)
        m.setattr(bronze, "_point", end)
        with pytest.raises(SystemExit):
            bronze.publish(spark, spark.range(99), t, log=log)
    assert spark.table(t).count() == 3 and len(bronze.versions(spark, t)) == 2
    assert [r.status for r in bronze.loads(spark, t, log).orderBy("timestamp").collect()] == ["committed", "failed"]
    assert bronze.vacuum(spark, t, keep=0) == []  # what was begun later may still be under way
    bronze.publish(spark, spark.range(4), t, log=log, keep=0)
    assert len(bronze.versions(spark, t)) == 1 and [r.version for r in bronze.history(spark, t, log=log).collect()] == [0, 1]


def test_a_load_that_stops_before_the_log_is_committed(spark, db, monkeypatch):
    t, log = f"{db}.t", f"{db}.log"
    bronze.publish(spark, spark.range(3), t, log=log)
    real = bronze._logged

    def only_begun(sp, log, table, load_id, event, *rest, **more):
        if event != bronze.BEGUN:
            raise SystemExit
        real(sp, log, table, load_id, event, *rest, **more)

    with monkeypatch.context() as m:
        m.setattr(bronze, "_logged", only_begun)
        with pytest.raises(SystemExit):
            bronze.publish(spark, spark.range(8), t, log=log)
    assert spark.table(t).count() == 8
    shown = bronze.history(spark, t, log=log).orderBy("version").collect()
    assert [(r.version, r.n_rows) for r in shown] == [(0, 3), (1, None)]
    bronze.publish(spark, spark.range(1), t, log=log)  # writes the missing row, too
    assert [(r.version, r.n_rows) for r in bronze.history(spark, t, log=log).orderBy("version").collect()] == [(0, 3), (1, None), (2, 1)]


def test_versions_by_number(spark, db):
    t, log = f"{db}.t", f"{db}.log"
    for n in (2, 3, 4):
        bronze.publish(spark, spark.range(n), t, log=log, keep=1)
    assert bronze.as_of(spark, t, 1, log).count() == 3 and bronze.as_of(spark, t, 2, log).count() == 4
    for gone in (0, 3):
        with pytest.raises(ValueError):
            bronze.as_of(spark, t, gone, log)


def test_a_plain_table_is_taken_over(spark, db):
    spark.range(6).write.saveAsTable(f"{db}.t")
    table = bronze.publish(spark, spark.table(f"{db}.t").filter("id < 2"), f"{db}.t")
    assert table.count() == 2 and len(bronze.versions(spark, f"{db}.t")) == 2
    before = bronze.use_database(spark, db)
    try:
        assert bronze.publish(spark, spark.range(1), "t").count() == 1 and spark.table(f"{db}.t").count() == 1
    finally:
        bronze.use_database(spark, before)


def test_counts_come_from_the_write(spark, db):
    seen = Observation()
    wide = spark.range(1000).repartition(7).groupBy((F.col("id") % 30).alias("k")).count()
    bronze.publish(spark, wide, f"{db}.t", counted=seen)
    assert seen.get["n_rows"] == 30 == spark.table(f"{db}.t").count()
    written = bronze.load_tables(spark, {f"{db}.a": spark.range(12), f"{db}.b": spark.range(0)})
    plan = bronze.load_summary(written)._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" not in plan
    assert rows(bronze.check_loads(spark, written)) == [(f"{db}.a", 12, 12, True), (f"{db}.b", 0, 0, True)]
    wrong = spark.createDataFrame([(f"{db}.a", 11)], "table_name string, n_rows bigint")
    assert rows(bronze.check_loads(spark, wrong)) == [(f"{db}.a", 11, 12, False)]


def test_times_of_loads(spark, db):
    bronze.publish(spark, spark.range(1), f"{db}.t", log=f"{db}.log")
    at = bronze.history(spark, f"{db}.t", log=f"{db}.log").first().timestamp
    assert abs((dt.datetime.now(dt.timezone.utc) - at.astimezone(dt.timezone.utc)).total_seconds()) < 120


def test_delta_where_there_is_a_connector(spark, db):
    try:
        spark._jvm.java.lang.Class.forName("io.delta.sql.DeltaSparkSessionExtension")
    except Exception:
        pytest.skip("no Delta connector on the class path")
    bronze.publish(spark, spark.range(3), f"{db}.t", fmt="delta")
    assert bronze.publish(spark, spark.range(2).withColumn("x", F.lit(1)), f"{db}.t", fmt="delta").columns == ["id", "x"]
    assert [r.version for r in bronze.history(spark, f"{db}.t", fmt="delta").orderBy("version").collect()] == [0, 1]


def test_results_of_two_calls_can_both_be_read(spark):
    from millrace import queries as Q
    from tests.oracle import DATA

    d = f"{DATA}/sf0.001"
    first, second = Q.bronze_roundtrip(spark, d), Q.bronze_roundtrip(spark, d)
    assert first.count() == second.count() == spark.read.parquet(f"{d}/orders.parquet").count()
    Q.drop_databases()
    assert not [x for x in spark.catalog.listDatabases() if x.name.startswith("millrace_bronze_roundtrip")]
