"""Totals over a span of time before each row, as running sums of what enters and leaves the span."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import free_name
from .asof import SLICE_ROWS, slice_of, time_slices


def rolling_totals(rows: DataFrame, key: str, time: str, within: str, totals: dict[str, str], count: str = "n", slice_rows: int = SLICE_ROWS) -> DataFrame:
    """``rows`` with ``count`` and ``totals`` (name: column) over the rows of their key from ``within`` before their time to it.

    ``within`` is an SQL interval or a number; both ends of the span belong to it, and so do all rows of the same time.
    Each row enters at its time and leaves just after the span has passed it, so a total is one running sum, however
    many rows the span holds, and no frame is looked through. A key of more than ``slice_rows`` entries and leaves is cut into slices of
    time that are tasks of their own; each starts with the sums of the slices before it, a row a slice.

    Totals are exact, as decimals or whole numbers: the type of a column's sum; for floating-point columns cast first.
    Nulls in a column count as nothing, and a total is null where the span holds nothing else. A null key is a key like
    others. Rows with a null time are in no span and get nulls. New columns whose name is taken get an underscore.
    """
    for c in totals.values():
        if rows.schema[c].dataType.simpleString() in ("double", "float"):
            raise ValueError(f"{c}: running sums of floating-point numbers are not exact; cast it to a decimal")
    kinds = rows.agg(*(F.sum(c).alias(c) for c in dict.fromkeys(totals.values()))).schema if totals else None
    values = [F.lit(1).cast("long"), *(x for c in totals.values() for x in (F.coalesce(F.col(c), F.lit(0)).cast(kinds[c].dataType), F.col(c).isNotNull().cast("long")))]
    names = [f"v{i}" for i in range(len(values))]
    timed = rows.where(F.col(time).isNotNull())
    base = timed.select(F.struct(F.col(key).alias("k")).alias("key"), F.col(time).alias("time"), F.struct("*").alias("row"), *(v.alias(n) for v, n in zip(values, names, strict=True)))
    leaving = base.select("key", (F.col("time") + F.expr(within)).cast(rows.schema[time].dataType).alias("time"), F.lit(None).cast(base.schema["row"].dataType).alias("row"), *((-F.col(n)).cast(base.schema[n].dataType).alias(n) for n in names))
    moves = base.withColumn("leaves", F.lit(0)).union(leaving.withColumn("leaves", F.lit(1)))
    cuts = time_slices(moves.select("key", "time"), slice_rows)
    placed = moves.join(F.broadcast(cuts), "key", "left").withColumn("slice", slice_of(F.col("time"), F.col("firsts"), F.col("runs"))).drop("firsts", "runs")
    sums = placed.join(F.broadcast(cuts.select("key")), "key", "left_semi").groupBy("key", "slice").agg(*(F.sum(n).alias(n) for n in names))
    before = Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("key", "slice", *(F.sum(n).over(before).alias(f"start_{n}") for n in names))
    # What leaves at a time counts until all that enters at it has been counted.
    upto = Window.partitionBy("key", "slice").orderBy("time", "leaves").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    running = placed.select("key", "slice", "row", "leaves", *(F.sum(n).over(upto).alias(n) for n in names)).where("leaves = 0").join(starts, ["key", "slice"], "left")
    full: list[Column] = [F.col(n) + F.coalesce(F.col(f"start_{n}"), F.lit(0)) for n in names]
    found = [full[0].cast("long"), *(F.when(full[2 * i + 2] > 0, full[2 * i + 1].cast(kinds[c].dataType)) for i, c in enumerate(totals.values()))]
    out = running.select("row", *(f.alias(f"o{i}") for i, f in enumerate(found)))
    none = rows.where(F.col(time).isNull()).select(F.struct("*").alias("row"), *(F.lit(None).cast(out.schema[f"o{i}"].dataType).alias(f"o{i}") for i in range(len(found))))
    whole = out.union(none)
    return whole.select(*(F.col("row")[c].alias(c) for c in rows.columns), *(F.col(f"o{i}").alias(free_name(rows, n)) for i, n in enumerate([count, *totals])))
