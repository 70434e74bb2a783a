"""The record model: six columns, in this order, and an optional position column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Phone stays text: leading zeros count.
RECORD = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("phone", T.StringType()),
        T.StructField("email", T.StringType()),
        T.StructField("age", T.IntegerType()),
        T.StructField("grade", T.IntegerType()),
        T.StructField("etc", T.StringType()),
    ]
)
FIELDS = RECORD.fieldNames()
#: The position of a row where order matters; Spark tables have none of their own.
SEQ = "seq"


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as make it no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
