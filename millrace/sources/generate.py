"""Seeded star-schema generation: narrow plans over ``range``, no shuffle and no driver rows."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import draws as D
from ..operators.numbering import dense_numbers
from ..schemas import ORDERS, PRODUCTS, USERS, conform

# Fixed values.
CATALOG = (
    ("P001", "ワイヤレスイヤホン", "家電"),
    ("P002", "スマートウォッチ", "家電"),
    ("P003", "ノートパソコン", "家電"),
    ("P004", "USBハブ", "家電"),
    ("P005", "モバイルバッテリー", "家電"),
    ("P006", "綿100%Tシャツ", "衣類"),
    ("P007", "デニムジーンズ", "衣類"),
    ("P008", "レインコート", "衣類"),
    ("P009", "スニーカー", "衣類"),
    ("P010", "ウールセーター", "衣類"),
    ("P011", "プロテインパウダー", "食品"),
    ("P012", "オーガニックコーヒー", "食品"),
    ("P013", "抹茶クッキー", "食品"),
    ("P014", "グラノーラ", "食品"),
    ("P015", "ドライフルーツMIX", "食品"),
    ("P016", "ヨガマット", "スポーツ"),
    ("P017", "ダンベルセット", "スポーツ"),
    ("P018", "ランニングシューズ", "スポーツ"),
    ("P019", "水筒（500ml）", "スポーツ"),
    ("P020", "フィットネスバンド", "スポーツ"),
)
# Fixed values.
REGIONS = ("北海道", "東北", "関東", "中部", "近畿", "中国", "四国", "九州")
# Fixed values.
LAST_NAMES = (
    "田中", "鈴木", "佐藤", "山田", "伊藤", "渡辺", "中村", "小林", "加藤", "吉田",
    "山口", "松本", "井上", "木村", "林", "斎藤", "清水", "山本", "池田", "橋本",
)
# Fixed values.
FIRST_NAMES = (
    "太郎", "花子", "次郎", "美咲", "健一", "由美", "翔", "あゆみ", "大輔", "さくら",
    "裕子", "誠", "和子", "拓海", "麻衣", "直樹", "恵子", "亮", "奈々", "隆",
)
# Fixed values.
SEED, FIRST_DAY, LAST_DAY = 42, dt.date(2024, 1, 1), dt.date(2024, 12, 31)
AMOUNT_FROM, AMOUNT_TO, ORPHAN_FROM = 500, 50000, 99


def spread(ids: DataFrame) -> DataFrame:
    """The same ids over all cores, if they come in fewer partitions: draws cost more than moving ids."""
    cores = ids.sparkSession.sparkContext.defaultParallelism
    return ids if ids.rdd.getNumPartitions() >= cores else ids.repartition(cores)


def products(sp: SparkSession, catalog: Sequence[tuple[str, str, str]] = CATALOG) -> DataFrame:
    """The product dimension, one row per catalog entry."""
    return sp.createDataFrame(list(catalog), PRODUCTS)


def user_columns(key: Column, seed: int = SEED, method: str = "md5") -> list[Column]:
    u = lambda stream: D.draw(seed, stream, key, method)
    return [
        D.padded_key("U", key, 3).alias("user_id"),
        F.concat(D.pick(LAST_NAMES, u("last")), D.pick(FIRST_NAMES, u("first"))).alias("user_name"),
        D.pick(REGIONS, u("region")).alias("region"),
    ]


def users(sp: SparkSession, n: int = 100, seed: int = SEED, method: str = "md5", partitions: int | None = None, ids: DataFrame | None = None) -> DataFrame:
    """``n`` users U001.. with a drawn name and region, or one for each ``id`` of ``ids``."""
    ids = sp.range(1, n + 1, 1, partitions) if ids is None else ids
    return conform(ids.select(*user_columns(F.col("id"), seed, method)), USERS)


@dataclass(frozen=True)
class OrderShape:
    """Sizes of an order table: clean rows, then copies, then missing values, then orphans."""

    clean: int = 980
    copies: int = 5
    missing: int = 10
    orphans: int = 5
    n_users: int = 100
    n_products: int = 20

    @classmethod
    def scaled(cls, rows: int, n_users: int = 100, n_products: int = 20) -> OrderShape:
        """The default proportions for about ``rows`` rows."""
        k = max(1, rows // 1000)
        return cls(980 * k, 5 * k, 10 * k, 5 * k, n_users, n_products)

    @classmethod
    def covering(cls, n: int, n_users: int = 100, n_products: int = 20) -> OrderShape:
        """The default proportions for exactly ``n`` numbers: what defects leave of them is clean, and fewer than 16 are all clean."""
        k = n // 995 or int(n > 15)
        return cls(n - 15 * k, min(5 * k, n - 15 * k), 10 * k, 5 * k, n_users, n_products)


def order_columns(key: Column, shape: OrderShape, seed: int = SEED, method: str = "md5") -> list[Column]:
    """An order by its number; numbers above ``shape.clean`` carry the planted defects."""
    u = lambda stream: D.draw(seed, stream, key, method)
    offset = key - F.lit(shape.clean + 1)
    lacks = (key > shape.clean) & (key <= shape.clean + shape.missing)
    orphan = key > shape.clean + shape.missing
    amount = D.round_even(D.real_between(AMOUNT_FROM, AMOUNT_TO, u("amount")))
    day = D.date_between(FIRST_DAY, LAST_DAY, u("date"))
    product = D.padded_key("P", D.int_between(1, shape.n_products, u("product")), 3)
    unknown = D.padded_key("P", key - F.lit(shape.clean + shape.missing + 1) + F.lit(max(ORPHAN_FROM, shape.n_products + 1)), 3)
    return [
        D.padded_key("ORD", key, 5).alias("order_id"),
        D.padded_key("U", D.int_between(1, shape.n_users, u("user")), 3).alias("user_id"),
        F.when(orphan, unknown).otherwise(product).alias("product_id"),
        F.when(lacks & (offset % 2 == 0), D.typed_null("double")).otherwise(amount).alias("amount"),
        F.when(lacks & (offset % 2 == 1), D.typed_null("date")).otherwise(day).alias("order_date"),
    ]


def orders_clean(sp: SparkSession, n: int = 980, shape: OrderShape | None = None, seed: int = SEED, method: str = "md5", partitions: int | None = None, ids: DataFrame | None = None) -> DataFrame:
    """``n`` orders without defects, or one for each ``id`` of ``ids``."""
    base = shape or OrderShape()
    only = OrderShape(n if ids is None else 2**62, 0, 0, 0, base.n_users, base.n_products)
    ids = sp.range(1, n + 1, 1, partitions) if ids is None else spread(ids)
    return conform(ids.select(*order_columns(F.col("id"), only, seed, method)), ORDERS)


def orders_dirty_of(keys: DataFrame, key: str, n_users: int = 100, n_products: int = 20, seed: int = SEED, method: str = "md5") -> DataFrame:
    """Orders with defects in the default proportions, one for each row of ``keys`` in the order of ``key``, and whole copies of the first few.

    Keys may be sparse, repeated or of any type that sorts; the orders are numbered without gaps.
    """
    ids = dense_numbers(keys.select(key), [key], "id")
    shape = OrderShape.covering(ids.total, n_users, n_products)
    return orders_dirty(keys.sparkSession, shape, seed, method, ids=ids.rows.select("id"))


def orders_dirty(sp: SparkSession, shape: OrderShape | None = None, seed: int = SEED, method: str = "md5", partitions: int | None = None, ids: DataFrame | None = None) -> DataFrame:
    """Clean, missing and orphan orders as bands of one range, and whole copies of the first few.

    With ``ids`` the orders are those of its ``id`` values within the range.
    """
    shape = shape or OrderShape()
    columns = order_columns(F.col("id"), shape, seed, method)
    total = shape.clean + shape.missing + shape.orphans
    copied = min(shape.copies, shape.clean)
    if ids is None:
        body, first = sp.range(1, total + 1, 1, partitions), sp.range(1, copied + 1, 1, 1)
    else:
        body, first = spread(ids.filter(F.col("id").between(1, total))), ids.filter(F.col("id").between(1, copied))
    body, copies = body.select(*columns), first.select(*columns)
    return conform(body.unionByName(copies), ORDERS)
