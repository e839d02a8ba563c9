"""The three retail schemas, declared once and never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

PRODUCTS = T.StructType(
    [
        T.StructField("product_id", T.StringType(), False),
        T.StructField("product_name", T.StringType(), True),
        T.StructField("category", T.StringType(), True),
    ]
)
USERS = T.StructType(
    [
        T.StructField("user_id", T.StringType(), False),
        T.StructField("user_name", T.StringType(), True),
        T.StructField("region", T.StringType(), True),
    ]
)
ORDERS = T.StructType(
    [
        T.StructField("order_id", T.StringType(), False),
        T.StructField("user_id", T.StringType(), True),
        T.StructField("product_id", T.StringType(), True),
        T.StructField("amount", T.DoubleType(), True),
        T.StructField("order_date", T.DateType(), True),
    ]
)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of ``schema`` by name, in its order and with its types.

    Nullability is a quality check here, not a table property: Spark's file
    sinks make every column nullable on the way back.
    """
    return df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in schema])
