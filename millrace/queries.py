"""The registered queries over the given tables, each with the same statement in ANSI SQL.

The given tables have few defects of their own, so most checks first plant
some by a rule that SQL can repeat.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import draws as D
from .operators import defects, quality
from .operators.numbering import dense_numbers
from .plans import bronze
from .sources import generate as G
from .sources.tables import catalog_table, read, sequence, sequences, view_head

Query = Callable[[SparkSession, str], DataFrame]


def _orders(sp: SparkSession, d: str) -> DataFrame:
    o = read(sp, d, "orders")
    return o.select("o_orderkey", "o_custkey", "o_orderstatus", F.col("o_totalprice").alias("amount"), F.col("o_orderdate").cast("date").alias("order_date"))


ORDERS_SQL = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice AS amount, CAST(o_orderdate AS DATE) AS order_date FROM orders"

#: Every 50th order loses its amount or its date, every 70th refers to no customer.
MISSING_EVERY, ORPHAN_EVERY, COPIES = 50, 70, 5


def _missing(sp: SparkSession, d: str) -> DataFrame:
    step = F.col("o_orderkey") % MISSING_EVERY
    offset = F.when(step == 0, (F.col("o_orderkey") / MISSING_EVERY).cast("bigint") % 2).otherwise(-1)
    return defects.blank_alternately(_orders(sp, d), offset, 2, "amount", "order_date")


MISSING_SQL = f"""SELECT o_orderkey, o_custkey, o_orderstatus,
  CASE WHEN o_orderkey % {MISSING_EVERY} = 0 AND (o_orderkey // {MISSING_EVERY}) % 2 = 0 THEN NULL ELSE amount END AS amount,
  CASE WHEN o_orderkey % {MISSING_EVERY} = 0 AND (o_orderkey // {MISSING_EVERY}) % 2 = 1 THEN NULL ELSE order_date END AS order_date
FROM ({ORDERS_SQL})"""


def _orphans(df: DataFrame) -> DataFrame:
    """Foreign keys below zero, which no customer has."""
    return defects.break_reference(df, "o_custkey", F.col("o_orderkey") % ORPHAN_EVERY == 0, -F.col("o_orderkey") - 1)


def orphans_sql(source: str) -> str:
    return f"""SELECT o_orderkey, CASE WHEN o_orderkey % {ORPHAN_EVERY} = 0 THEN -o_orderkey - 1 ELSE o_custkey END AS o_custkey,
  o_orderstatus, amount, order_date FROM ({source})"""


def copies_sql(source: str) -> str:
    return f"SELECT * FROM ({source}) UNION ALL SELECT * FROM (SELECT * FROM ({source}) ORDER BY o_orderkey LIMIT {COPIES})"


def dup_keys(sp, d):
    return quality.duplicate_keys(read(sp, d, "lineitem"), ["l_orderkey", "l_linenumber"])


def dup_measures(sp, d):
    return quality.duplicate_measures(read(sp, d, "lineitem"), ["l_orderkey", "l_linenumber"])


def null_rows(sp, d):
    return quality.null_rows(_missing(sp, d), "amount")


def null_profile(sp, d):
    return quality.null_profile(_missing(sp, d), ["amount", "order_date", "o_custkey"])


def inject_missing(sp, d):
    return _missing(sp, d)


def inject_orphans(sp, d):
    return _orphans(_orders(sp, d))


def inject_duplicates(sp, d):
    return defects.duplicate_first(_orders(sp, d), ["o_orderkey"], COPIES)


def orphan_rows(sp, d):
    documents, labels = read(sp, d, "documents").select("doc_id", "lang", "source"), read(sp, d, "labels")
    return quality.orphan_rows(documents, "doc_id", labels, "doc_id")


def orphan_count(sp, d):
    return quality.orphan_count(_orphans(_orders(sp, d)), "o_custkey", read(sp, d, "customer"), "c_custkey")


def known_fk_rows(sp, d):
    documents, labels = read(sp, d, "documents").select("doc_id", "lang", "source"), read(sp, d, "labels")
    return quality.known_rows(documents, "doc_id", labels, "doc_id")


def not_in_null_fk(sp, d):
    broken = _orphans(_orders(sp, d))
    nulled = broken.withColumn("o_custkey", F.when(F.col("o_orderkey") % 90 == 0, F.lit(None)).otherwise(F.col("o_custkey")).cast("bigint"))
    return quality.orphan_rows(nulled, "o_custkey", read(sp, d, "customer"), "c_custkey")


def quality_summary(sp, d):
    dirty = defects.duplicate_first(_orphans(_missing(sp, d)), ["o_orderkey"], COPIES)
    return quality.quality_summary(dirty, ["o_orderkey"], ["amount", "order_date"], [("o_custkey", read(sp, d, "customer"), "c_custkey")])


def gen_sequence(sp, d):
    """For each order, the integers from its key up to five further ones."""
    key = F.col("o_orderkey")
    rows = sequences(read(sp, d, "orders").select("o_orderkey"), key, key + key % 6, "n")
    return rows.select("o_orderkey", "n", F.col("n").cast("string").alias("n_text"), (F.col("n") + 99).alias("shifted"))


def sequence_gaps(sp, d):
    """Integers between the smallest and the largest customer of an order that no order has."""
    orders = read(sp, d, "orders").select(F.col("o_custkey").alias("id"))
    low, high = orders.agg(F.min("id"), F.max("id")).first()
    return sequence(sp, low or 0, (high or -1) + 1).join(orders, "id", "left_anti")


def gen_products(sp, d):
    """The catalog joined to the parts that take its entries in turn."""
    parts = read(sp, d, "part").select("p_partkey", D.padded_key("P", 1 + F.col("p_partkey") % len(G.CATALOG), 3).alias("product_id"))
    return parts.join(F.broadcast(G.products(sp)), "product_id").select("p_partkey", "product_id", "product_name", "category")


def gen_users(sp, d):
    return G.users(sp, ids=read(sp, d, "customer").select(F.col("c_custkey").alias("id")))


def _order_ids(sp, d):
    return read(sp, d, "orders").select(F.col("o_orderkey").alias("id"))


def gen_orders_clean(sp, d):
    return G.orders_clean(sp, ids=_order_ids(sp, d))


def gen_orders_dirty(sp, d):
    return G.orders_dirty_of(read(sp, d, "orders"), "o_orderkey", 100, len(G.CATALOG))


def row_numbers(sp, d):
    """Orders by falling price, numbered without gaps."""
    orders = read(sp, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return dense_numbers(orders, [F.desc("o_totalprice"), F.col("o_orderkey")], "rank").rows


def fn_keys(sp, d):
    """Keys below and above the pad width."""
    key = F.col("c_custkey")
    return read(sp, d, "customer").select("c_custkey", D.padded_key("U", key, 3).alias("short_key"), D.padded_key("ORD", key * 97, 5).alias("long_key"), F.concat(F.lit("#"), key.cast("string")).alias("plain_key"))


def fn_draws(sp, d):
    """Every kind of draw, keyed by the order."""
    u = lambda s: D.draw(G.SEED, s, F.col("o_orderkey"))
    return read(sp, d, "orders").select(
        "o_orderkey",
        D.int_between(1, 20, u("a")).alias("an_int"),
        D.round_even(D.real_between(500, 50000, u("b"))).alias("an_amount"),
        D.date_between(G.FIRST_DAY, G.LAST_DAY, u("c")).alias("a_day"),
        D.pick(G.REGIONS, u("d")).alias("a_region"),
        F.datediff(F.col("o_orderdate").cast("date"), F.lit(G.FIRST_DAY)).alias("days_after"),
    )


def view_sql_limit(sp, d):
    bronze.register_views({"millrace_orders": read(sp, d, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("date"))})
    return view_head(sp, "millrace_orders", "o_orderkey", 10)


def preview_top5(sp, d):
    return bronze.preview(read(sp, d, "part"), 5, ["p_partkey"])


#: The databases of this session's calls.
_DATABASES: list[tuple[SparkSession, str]] = []


@atexit.register
def drop_databases() -> None:
    """Drop the databases of all calls so far; what their queries returned can't be read any more."""
    while _DATABASES:
        sp, name = _DATABASES.pop()
        if sp.sparkContext._jsc is not None:  # else the session has ended before
            bronze.drop_database(sp, name)


def _database(sp: SparkSession, query: str) -> str:
    """A database of its own for each call, in the warehouse that all executors share.

    What a query returns reads its tables, at any time and again, so they stay until the session ends.
    """
    name = f"millrace_{query}_{uuid.uuid4().hex[:12]}"
    _DATABASES.append((sp, name))
    bronze.create_database(sp, name)
    bronze.create_database(sp, name)  # a repeat changes nothing
    return name


def bronze_roundtrip(sp, d):
    db = _database(sp, "bronze_roundtrip")
    bronze.publish(sp, _orders(sp, d), f"{db}.bronze_orders")
    return catalog_table(sp, f"{db}.bronze_orders")


def bronze_rerun(sp, d):
    db = _database(sp, "bronze_rerun")
    bronze.publish(sp, _orders(sp, d), f"{db}.bronze_orders")
    return bronze.publish(sp, _orders(sp, d), f"{db}.bronze_orders")


def bronze_schema_replace(sp, d):
    db = _database(sp, "bronze_schema_replace")
    bronze.publish(sp, _orders(sp, d), f"{db}.bronze_orders")
    changed = _orders(sp, d).drop("o_orderstatus").withColumn("is_large", F.col("amount") > 100000)
    return bronze.publish(sp, changed, f"{db}.bronze_orders")


def bronze_current_db(sp, d):
    """An unqualified name resolves in the database that was made current; the session's own is put back."""
    db = _database(sp, "bronze_current_db")
    bronze.publish(sp, _orders(sp, d), f"{db}.bronze_orders")
    before = bronze.use_database(sp, db)
    try:
        return catalog_table(sp, "bronze_orders").groupBy("o_orderstatus").agg(F.count("*").alias("n_rows"))
    finally:
        bronze.use_database(sp, before)


def parquet_roundtrip(sp, d):
    out = f"{sp.conf.get('spark.sql.warehouse.dir')}/millrace_{uuid.uuid4().hex[:12]}"
    part = read(sp, d, "part")
    return sp.read.schema(part.schema).parquet(bronze.write_parquet(part, out, "part"))


def _three(sp, d, query: str) -> list[str]:
    db = _database(sp, query)
    for t in ("orders", "part", "customer"):
        bronze.publish(sp, read(sp, d, t), f"{db}.bronze_{t}")
    return [f"{db}.bronze_{t}" for t in ("orders", "part", "customer")]


def _short(df: DataFrame) -> DataFrame:
    return df.withColumn("table_name", F.substring_index("table_name", ".", -1))


def bronze_counts(sp, d):
    return _short(bronze.table_counts(sp, _three(sp, d, "bronze_counts")))


def _written(sp, d, query: str) -> DataFrame:
    db = _database(sp, query)
    return bronze.load_tables(sp, {f"{db}.bronze_{t}": read(sp, d, t) for t in ("orders", "part", "customer")})


def load_summary(sp, d):
    """What the writes counted; the tables are not read again."""
    return _short(bronze.load_summary(_written(sp, d, "load_summary")))


def load_check(sp, d):
    """What the writes counted beside what is read back."""
    return _short(bronze.check_loads(sp, _written(sp, d, "load_check")))


def bronze_self_overwrite(sp, d):
    """A table replaced by rows read from itself."""
    db = _database(sp, "bronze_self_overwrite")
    table = bronze.publish(sp, _orders(sp, d), f"{db}.bronze_orders")
    large = table.filter(F.col("amount") > 100000).withColumn("amount", F.col("amount") - 100000)
    return bronze.publish(sp, large, f"{db}.bronze_orders")


def _fails(df: DataFrame) -> DataFrame:
    """``df``, whose last orders can't be worked out."""
    broken = F.raise_error(F.lit("planted failure")).cast("double")
    return df.withColumn("amount", F.when(F.col("o_orderkey") % MISSING_EVERY == 7, broken).otherwise(F.col("amount")))


def _after_a_failure(sp, d, query: str) -> str:
    """A table with a load, one that fails midway, and one more."""
    db = _database(sp, query)
    name, log = f"{db}.bronze_orders", f"{db}.load_log"
    bronze.publish(sp, _orders(sp, d), name, log=log)
    try:
        bronze.publish(sp, _fails(_orders(sp, d)), name, log=log)
    except Exception as failure:
        if "planted failure" not in str(failure):
            raise
    return name


def bronze_failed_load(sp, d):
    """A load that fails midway leaves the table as it was."""
    return catalog_table(sp, _after_a_failure(sp, d, "bronze_failed_load"))


def load_audit(sp, d):
    """All loads of a table with their outcome and the rows that they wrote; a failed one has no version."""
    name = _after_a_failure(sp, d, "load_audit")
    log = name.replace("bronze_orders", "load_log")
    bronze.publish(sp, _orders(sp, d).filter("amount > 100000"), name, log=log)
    numbers = bronze.history(sp, name, log=log).select("load_id", "version")
    order = Window.orderBy("timestamp", "load_id")
    every = bronze.loads(sp, name, log).withColumn("load", F.row_number().over(order))
    return every.join(numbers, "load_id", "left").select("load", "status", "version", "n_rows")


def bronze_as_of(sp, d):
    """The version of a table before its last load."""
    db = _database(sp, "bronze_as_of")
    name, log = f"{db}.bronze_orders", f"{db}.load_log"
    bronze.publish(sp, _orders(sp, d), name, log=log)
    bronze.publish(sp, _orders(sp, d).filter("amount > 100000"), name, log=log)
    return bronze.as_of(sp, name, 0, log)


def load_history(sp, d):
    """Two loads of one table; the times vary, so only their order is returned."""
    db = _database(sp, "load_history")
    for _ in range(2):
        bronze.publish(sp, _orders(sp, d), f"{db}.bronze_orders", log=f"{db}.load_log")
    past = bronze.history(sp, f"{db}.bronze_orders", log=f"{db}.load_log")
    n = catalog_table(sp, f"{db}.bronze_orders").agg(F.count("*").alias("n_rows"))
    return past.select("version", "operation", F.col("operation_parameters")["mode"].alias("write_mode")).crossJoin(F.broadcast(n))


def draw_sql(stream: str, key: str) -> str:
    return f"('0x' || substr(md5(concat_ws(':', '{G.SEED}', '{stream}', CAST({key} AS VARCHAR))), 1, 8))::BIGINT"


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _order_sql(key: str, clean: str, missing: str) -> str:
    """Columns of a generated order; ``clean`` and ``missing`` are the sizes of its bands."""
    band = f"({key} > {clean} AND {key} <= {clean} + {missing})"
    offset = f"({key} - {clean} - 1)"
    amount = f"round_even({G.AMOUNT_FROM}e0 + {G.AMOUNT_TO - G.AMOUNT_FROM}e0 * {draw_sql('amount', key)} / 4294967296e0, 0)"
    day = f"(DATE '{G.FIRST_DAY}' + ({draw_sql('date', key)} % 366)::INT)"
    return f"""printf('ORD%05d', {key}) AS order_id,
  printf('U%03d', 1 + {draw_sql('user', key)} % 100) AS user_id,
  CASE WHEN {key} > {clean} + {missing} THEN printf('P%03d', {key} - {clean} - {missing} - 1 + {G.ORPHAN_FROM})
       ELSE printf('P%03d', 1 + {draw_sql('product', key)} % {len(G.CATALOG)}) END AS product_id,
  CASE WHEN {band} AND {offset} % 2 = 0 THEN NULL ELSE {amount} END AS amount,
  CASE WHEN {band} AND {offset} % 2 = 1 THEN NULL ELSE {day} END AS order_date"""


_K = "(SELECT greatest(1, count(*) // 1000) FROM orders)"
_FK = "documents.doc_id IN (SELECT doc_id FROM labels)"
_DIRTY = copies_sql(orphans_sql(MISSING_SQL))
_COUNTS = " UNION ALL ".join(f"SELECT 'bronze_{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in ("orders", "part", "customer"))

ORACLES: dict[str, str] = {
    "dup_keys": "SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    "dup_measures": "SELECT count(*) AS repeated_keys, coalesce(sum(n), 0)::BIGINT AS rows_in_groups, coalesce(sum(n - 1), 0)::BIGINT AS surplus_rows FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)",
    "null_rows": f"SELECT * FROM ({MISSING_SQL}) WHERE amount IS NULL",
    "null_profile": " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) FILTER ({c} IS NULL) AS n_null FROM ({MISSING_SQL})" for c in ("amount", "order_date", "o_custkey")),
    "inject_missing": MISSING_SQL,
    "inject_orphans": orphans_sql(ORDERS_SQL),
    "inject_duplicates": copies_sql(ORDERS_SQL),
    "orphan_rows": f"SELECT doc_id, lang, source FROM documents WHERE NOT ({_FK})",
    "orphan_count": f"SELECT count(*) AS n_orphans FROM ({orphans_sql(ORDERS_SQL)}) WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)",
    "known_fk_rows": f"SELECT doc_id, lang, source FROM documents WHERE {_FK}",
    "not_in_null_fk": f"SELECT * FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 90 = 0 THEN NULL ELSE o_custkey END AS o_custkey, o_orderstatus, amount, order_date FROM ({orphans_sql(ORDERS_SQL)})) WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)",
    "quality_summary": f"""WITH t AS ({_DIRTY})
SELECT 'total' AS check_name, '*' AS column_name, count(*) AS n FROM t
UNION ALL SELECT 'null', 'amount', count(*) FROM t WHERE amount IS NULL
UNION ALL SELECT 'null', 'order_date', count(*) FROM t WHERE order_date IS NULL
UNION ALL SELECT 'duplicate', 'o_orderkey', count(*) FROM (SELECT o_orderkey FROM t GROUP BY o_orderkey HAVING count(*) > 1)
UNION ALL SELECT 'orphan', 'o_custkey', count(*) FROM t WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)""",
    "gen_sequence": "SELECT o_orderkey, n, CAST(n AS VARCHAR) AS n_text, n + 99 AS shifted FROM (SELECT o_orderkey, unnest(range(o_orderkey, o_orderkey + o_orderkey % 6)) AS n FROM orders)",
    "sequence_gaps": "SELECT id FROM (SELECT unnest(range((SELECT min(o_custkey) FROM orders), (SELECT max(o_custkey) + 1 FROM orders))) AS id) WHERE id NOT IN (SELECT o_custkey FROM orders)",
    "gen_products": "SELECT p_partkey, product_id, product_name, category FROM part JOIN (VALUES " + ", ".join(str(x) for x in G.CATALOG) + ") c(product_id, product_name, category) ON product_id = printf('P%03d', 1 + p_partkey % 20)",
    "gen_users": f"SELECT printf('U%03d', id) AS user_id, {_list(G.LAST_NAMES)}[1 + {draw_sql('last', 'id')} % 20] || {_list(G.FIRST_NAMES)}[1 + {draw_sql('first', 'id')} % 20] AS user_name, {_list(G.REGIONS)}[1 + {draw_sql('region', 'id')} % 8] AS region FROM (SELECT c_custkey AS id FROM customer)",
    "gen_orders_clean": f"SELECT {_order_sql('id', '4611686018427387904', '0')} FROM (SELECT o_orderkey AS id FROM orders)",
    "gen_orders_dirty": f"""WITH n AS (SELECT count(*) AS n, CASE WHEN count(*) >= 995 THEN count(*) // 995 WHEN count(*) > 15 THEN 1 ELSE 0 END AS k FROM orders),
b AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS id, k, n - 15 * k AS clean FROM orders, n),
o AS (SELECT id, k, clean, {_order_sql('id', 'clean', '10 * k')} FROM b)
SELECT order_id, user_id, product_id, amount, order_date FROM o UNION ALL SELECT order_id, user_id, product_id, amount, order_date FROM o WHERE id <= least(5 * k, clean)""",
    "row_numbers": "SELECT o_orderkey, o_custkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders",
    "fn_keys": "SELECT c_custkey, printf('U%03d', c_custkey) AS short_key, printf('ORD%05d', c_custkey * 97) AS long_key, '#' || CAST(c_custkey AS VARCHAR) AS plain_key FROM customer",
    "fn_draws": f"SELECT o_orderkey, 1 + {draw_sql('a', 'o_orderkey')} % 20 AS an_int, round_even(500e0 + 49500e0 * {draw_sql('b', 'o_orderkey')} / 4294967296e0, 0) AS an_amount, DATE '{G.FIRST_DAY}' + ({draw_sql('c', 'o_orderkey')} % 366)::INT AS a_day, {_list(G.REGIONS)}[1 + {draw_sql('d', 'o_orderkey')} % 8] AS a_region, date_diff('day', DATE '{G.FIRST_DAY}', CAST(o_orderdate AS DATE))::INT AS days_after FROM orders",
    "view_sql_limit": "SELECT * REPLACE (CAST(o_orderdate AS DATE) AS o_orderdate) FROM orders ORDER BY o_orderkey LIMIT 10",
    "preview_top5": "SELECT * FROM part ORDER BY p_partkey LIMIT 5",
    "bronze_roundtrip": ORDERS_SQL,
    "bronze_rerun": ORDERS_SQL,
    "bronze_self_overwrite": f"SELECT o_orderkey, o_custkey, o_orderstatus, amount - 100000 AS amount, order_date FROM ({ORDERS_SQL}) WHERE amount > 100000",
    "bronze_failed_load": ORDERS_SQL,
    "bronze_as_of": ORDERS_SQL,
    "load_audit": f"""SELECT 1 AS load, 'committed' AS status, 0 AS version, count(*) AS n_rows FROM orders
UNION ALL SELECT 2, 'failed', NULL, NULL
UNION ALL SELECT 3, 'committed', 1, count(*) FROM ({ORDERS_SQL}) WHERE amount > 100000""",
    "load_check": f"SELECT table_name, n_rows AS n_written, n_rows AS n_read, true AS agrees FROM ({_COUNTS})",
    "bronze_schema_replace": f"SELECT o_orderkey, o_custkey, amount, order_date, amount > 100000 AS is_large FROM ({ORDERS_SQL})",
    "bronze_current_db": "SELECT o_orderstatus, count(*) AS n_rows FROM orders GROUP BY o_orderstatus",
    "parquet_roundtrip": "SELECT * FROM part",
    "bronze_counts": _COUNTS,
    "load_summary": f"SELECT table_name, n_rows, format('{{:,}}', n_rows) AS n_rows_text, format('{{:>6}}', format('{{:,}}', n_rows)) AS n_rows_right FROM ({_COUNTS})",
    "load_history": "SELECT v AS version, 'CREATE OR REPLACE TABLE AS SELECT' AS operation, 'overwrite' AS write_mode, (SELECT count(*) FROM orders) AS n_rows FROM range(0, 2) t(v)",
}

QUERIES: dict[str, Query] = {name: globals()[name] for name in ORACLES}
