"""Operators on record tables with any columns: find, count, insert, positions, delete."""

from __future__ import annotations

import math
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import free_name


def find(records: DataFrame, column: str, key: Any) -> DataFrame:
    """Rows whose ``column`` is exactly ``key``; a null key finds nulls. The test reaches the scan."""
    c = F.col(column)
    return records.where(c.isNull() if key is None else c == F.lit(key))


def count_matches(records: DataFrame, column: str, key: Any, name: str = "n") -> DataFrame:
    return find(records, column, key).agg(F.count(F.lit(1)).alias(name))


def insert(records: DataFrame, new: DataFrame) -> DataFrame:
    """Both tables' rows, matched by column name; repeated rows stay."""
    return records.unionByName(new)


def insert_numbered(records: DataFrame, new: DataFrame, seq: str, order: str) -> DataFrame:
    """Both tables' rows; those of ``new`` go on in ``seq`` after the last of ``records``, in the order of its unique numeric column ``order``."""
    start = records.agg(F.coalesce(F.max(seq) + 1, F.lit(0))).first()[0]
    kind = records.schema[seq].dataType
    numbered = ranked(new, order).select(*(F.col("row")[c].alias(c) for c in new.columns if c != seq), (F.lit(start) + F.col("rank")).cast(kind).alias(seq))
    return records.unionByName(numbered, allowMissingColumns=True)


def _range_of(value: Column, cuts: list[float]) -> Column:
    """How many of the sorted ``cuts`` are at most ``value``: first among every width-th, then in one run of them."""
    if not cuts:
        return F.lit(0)
    width = math.isqrt(len(cuts)) + 1
    runs = [cuts[i : i + width] for i in range(0, len(cuts), width)]
    array = lambda values: F.array(*map(F.lit, values))
    upto = lambda values: F.size(F.filter(values, lambda b: b <= value))
    run = upto(array([r[0] for r in runs]))
    return F.when(run == 0, 0).otherwise((run - 1) * width + upto(F.get(F.array(*map(array, runs)), run - 1)))


def ranked(records: DataFrame, order: str) -> DataFrame:
    """(row, rank): each record as a struct and its 0-based rank by ``order``, a unique numeric column.

    One sort of a whole table in one task would not scale. Quantiles of ``order`` cut it into ranges, each range is
    ranked by itself, and starts where the ranges before it end.
    """
    n = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = records.approxQuantile(order, [i / n for i in range(1, n)], 0.25 / n) if n > 1 else []
    ranged = records.select(F.struct("*").alias("row"), _range_of(F.col(order), sorted(set(cuts))).alias("range"))
    sizes = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("size"))
    ends = F.sum("size").over(Window.orderBy("range"))  # a row for each range
    starts = sizes.select("range", (ends - F.col("size")).alias("start"))
    at = F.row_number().over(Window.partitionBy("range").orderBy(F.col("row")[order])) - 1
    return ranged.withColumn("at", at).join(F.broadcast(starts), "range").select("row", (F.col("start") + F.col("at")).alias("rank"))


def positions(records: DataFrame, column: str, key: Any, order: str) -> DataFrame:
    """The rows found, with ``position``: their 0-based rank among all rows by ``order``, a unique numeric column.

    A table that has a column ``position`` gets ``_position``.
    """
    found = F.col("row")[column].isNull() if key is None else F.col("row")[column] == F.lit(key)
    return ranked(records, order).where(found).select(*(F.col("row")[c].alias(c) for c in records.columns), F.col("rank").alias(free_name(records, "position")))


def delete(records: DataFrame, column: str, key: Any) -> DataFrame:
    """All rows but those whose ``column`` is ``key``; rows with a null there stay."""
    return records.where(~F.col(column).eqNullSafe(F.lit(key)))


def _is_key(column: str, key: Any) -> Column:
    return F.col(column).eqNullSafe(F.lit(key))


def delete_confirmed(records: DataFrame, column: str, key: Any, confirmed: DataFrame, order: str) -> DataFrame:
    """All rows but those found by ``key`` whose ``order`` id is in ``confirmed(order)``."""
    ids = confirmed.select(F.col(order).alias(free_name(records, "confirmed")))
    return records.join(ids, _is_key(column, key) & (F.col(order) == F.col(ids.columns[0])), "left_anti")


def deleted(records: DataFrame, column: str, key: Any, confirmed: DataFrame, order: str) -> DataFrame:
    """The rows that ``delete_confirmed`` takes away, for the report that a session shows."""
    ids = confirmed.select(F.col(order).alias(free_name(records, "confirmed")))
    return records.join(ids, _is_key(column, key) & (F.col(order) == F.col(ids.columns[0])), "left_semi")


def unpivot(records: DataFrame, columns: list[str], ids: list[str]) -> DataFrame:
    """Each record as rows of key and value (text), in the order of ``columns``."""
    return records.select(*ids, *(F.col(c).cast("string").alias(c) for c in columns)).unpivot(ids, columns, "key", "value")


def top_k(records: DataFrame, keys: list[str], order: list[Column], k: int, ties: bool = False) -> DataFrame:
    """The first ``k`` rows of each key by ``order``, which should tell rows apart; with ``ties`` also those equal to the k-th.

    A limit by rank is one that Spark takes in two steps: each task keeps ``k`` rows a key before the shuffle (more only
    for ties), so of a hot key no more than that moves. A null key is a key like others.
    """
    rank, place = (F.rank() if ties else F.row_number()), free_name(records, "place")
    ranked_rows = records.withColumn(place, rank.over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked_rows.where(F.col(place) <= k)
