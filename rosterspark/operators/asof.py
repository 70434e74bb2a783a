"""As-of join: for each row the last row of another table before it, by one sort and a value carried over time."""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one key that a task may sort; slices of time in all, however many rows there are; and rows looked at to place a cut.
SLICE_ROWS, MOST_SLICES, PER_CUT = 1 << 18, 1 << 12, 64


def time_slices(rows: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(key, firsts, runs) of the hot keys of ``rows(key, time)``: cuts that split their rows into slices of about ``slice_rows``.

    Keys are counted with partial sums, if there are rows enough for one to be hot. Where there would be more than ``MOST_SLICES`` slices they get larger, so there
    are at most that many hot keys and twice as many cuts, and the driver may hold them. The cuts come from a sample of
    the hot keys' times, which has no bearing on results: any cuts give the same rows. Cuts are kept in ``runs`` of about
    equal length, led by ``firsts``, so that a row looks at few of them. A key has no cut more than once.
    """
    spark, kind = rows.sparkSession, rows.schema
    total = rows.count()
    most = max(slice_rows, math.ceil(total / MOST_SLICES))
    counts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
    hot = {r["key"]: math.ceil(r["n"] / most) for r in counts.collect()} if total > most else {}
    table = []
    if hot:
        keys = spark.createDataFrame([(k,) for k in hot], f"key {kind['key'].dataType.simpleString()}")
        share = min(1.0, PER_CUT / most)
        times = defaultdict(list)
        for r in rows.join(F.broadcast(keys), "key").sample(share, seed=1).collect():
            times[r["key"]].append(r["time"])
        for key, found in times.items():
            found.sort()
            cuts = sorted({found[len(found) * i // hot[key]] for i in range(1, hot[key])})
            width = math.isqrt(len(cuts)) + 1
            runs = [cuts[i : i + width] for i in range(0, len(cuts), width)]
            table.append((key, [r[0] for r in runs], runs))
    key, time = (kind[c].dataType.simpleString() for c in ("key", "time"))
    return spark.createDataFrame(table, f"key {key}, firsts array<{time}>, runs array<array<{time}>>")


def slice_of(time: Column, firsts: Column, runs: Column) -> Column:
    """The number of cuts that are at most ``time``; 0 without cuts."""
    upto = lambda cuts: F.size(F.filter(cuts, lambda c: c <= time))
    run = upto(firsts)
    return F.when(firsts.isNull() | (run == 0), 0).otherwise((run - 1) * F.size(F.get(runs, F.lit(0))) + upto(F.get(runs, run - 1)))


def asof_join(left: DataFrame, right: DataFrame, left_on: tuple[str, str], right_on: tuple[str, str], ties: tuple[str, ...] = (), strict: bool = False, within: str | None = None, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Each row of ``left`` with the columns of the last row of ``right`` that has its key and no later time.

    ``left_on`` and ``right_on`` name key and time. With ``strict`` the time must be earlier; ``within``, an SQL interval
    or number, is how much earlier it may be at most. Of right rows that share key and time, the last by the columns
    ``ties`` counts, nulls first; rows that tie there too should be equal, else any of them may count.

    Both tables are sorted together, once, by key and time, and the last right row is carried down. A key of more than
    ``slice_rows`` rows is cut into slices of time that are tasks of their own; what a slice starts with, the last right
    row before it, is a table of a row for each slice. Rows of one key and one time stay together.

    Left rows without a match, or with a null key or time, keep nulls on the right; right rows with such nulls match
    nothing. Repeated left rows come out once each. Right columns whose name is taken get an underscore before it.
    """
    (lk, lt), (rk, rt) = left_on, right_on
    kind = right.select(F.struct("*").alias("row")).schema["row"].dataType.simpleString()
    whole, known = F.struct("*"), lambda k, t: F.col(k).isNotNull() & F.col(t).isNotNull()
    mine = left.where(known(lk, lt)).select(F.col(lk).alias("key"), F.col(lt).alias("time"), whole.alias("mine"))
    other = right.where(known(rk, rt)).select(F.col(rk).alias("key"), F.col(rt).alias("time"), whole.alias("other"))
    spans = mine.select("key", "time").union(other.select("key", "time"))
    cuts = time_slices(spans, slice_rows)
    both = mine.withColumn("other", F.lit(None).cast(kind)).unionByName(other.withColumn("mine", F.lit(None).cast(mine.schema["mine"].dataType)))
    placed = both.join(F.broadcast(cuts), "key", "left").select("key", "time", "mine", "other", slice_of(F.col("time"), F.col("firsts"), F.col("runs")).alias("slice"))
    # At equal times right rows stand before left ones, unless they must be earlier; ties among them in their order.
    side = F.col("mine").isNotNull() if not strict else F.col("mine").isNull()
    order = Window.partitionBy("key", "slice").orderBy("time", side, *(F.col("other")[c].asc_nulls_first() for c in ties)).rowsBetween(Window.unboundedPreceding, 0)
    carried = placed.select("key", "slice", "time", "mine", F.last("other", ignorenulls=True).over(order).alias("other")).where(F.col("mine").isNotNull())
    carried = carried.join(_starts(placed, cuts, ties), ["key", "slice"], "left").withColumn("other", F.coalesce("other", "start"))
    if within is not None:
        carried = carried.withColumn("other", F.when(F.col("other")[rt] >= F.col("time") - F.expr(within), F.col("other")))
    rest = left.where(~known(lk, lt)).select(whole.alias("mine"), F.lit(None).cast(kind).alias("other"))
    return beside(carried.select("mine", "other").union(rest), left, right)


def _starts(placed: DataFrame, cuts: DataFrame, ties: tuple[str, ...]) -> DataFrame:
    """(key, slice, start) for each slice of a hot key: the last right row of the slices before it."""
    cut = F.aggregate("runs", F.lit(0), lambda n, r: n + F.size(r))
    slices = cuts.select("key", F.explode(F.sequence(F.lit(0), cut)).alias("slice"))
    rank = F.struct("time", *(F.col("other")[c] for c in ties))
    last = placed.where(F.col("other").isNotNull()).join(F.broadcast(cuts.select("key")), "key", "left_semi").groupBy("key", "slice").agg(F.max_by("other", rank).alias("last"))
    before = Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    return slices.join(last, ["key", "slice"], "left").select("key", "slice", F.last("last", ignorenulls=True).over(before).alias("start"))


def beside(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """The columns of the structs ``mine`` and ``other`` side by side; right columns whose name is taken get an underscore before it."""
    taken, found = {c.lower() for c in left.columns}, [F.col("mine")[c].alias(c) for c in left.columns]
    for c in right.columns:
        name = c
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        found.append(F.col("other")[c].alias(name))
    return pairs.select(*found)
