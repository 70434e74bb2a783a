"""Intervals that meet: pairs through an index of bins instead of a comparison of all with all, and counts without pairs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import free_name
from .asof import SLICE_ROWS, beside, slice_of, time_slices

#: Entries of the index for each row, on average and at most; entries of a bin that a task takes from the left; and hot bins that there may be at most.
MOST_ENTRIES, BIN_ROWS, MOST_HOT = 4, 1 << 16, 1 << 12
DAY = 86_400_000_000


def ticks(value: Column, kind: T.DataType) -> Column:
    """A date or time as microseconds, by the calendar alone, so that no time zone can reorder them; a number as it is."""
    if isinstance(kind, T.DateType):
        return F.unix_date(value).cast("long") * DAY
    if isinstance(kind, T.TimestampNTZType):
        seconds = F.hour(value) * 3600 + F.minute(value) * 60 + F.extract(F.lit("SECOND"), value)
        return F.unix_date(value.cast("date")).cast("long") * DAY + (seconds * 1_000_000).cast("long")
    return F.unix_micros(value) if isinstance(kind, T.TimestampType) else value


def bin_width(left: DataFrame, right: DataFrame, whole: bool) -> float:
    """The width of bins for ``left`` and ``right``, both (keys, low, high): the one that makes the least work.

    With bins of width w, intervals of total length S make about S / w entries besides one each, and rows of n and m
    that are spread over a span D meet about 2 w n m / D more often than they should, fewer if keys divide them. The sum
    is least at w = sqrt(S D keys / 2 n m). A width that would make more than ``MOST_ENTRIES`` entries a row is raised:
    so the index stays in proportion to its rows, however long a few intervals are.
    """
    stats = lambda d: d.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("high") - F.col("low")).cast("double")).alias("length"), F.min("low").cast("double").alias("low"), F.max("high").cast("double").alias("high"), F.approx_count_distinct("keys").alias("keys")).first()
    a, b = stats(left), stats(right)
    n, m = a["n"], b["n"]
    if not n or not m:
        return 1.0
    length, span = a["length"] + b["length"], max(a["high"], b["high"]) - min(a["low"], b["low"])
    best = math.sqrt(length * span * max(1, min(a["keys"], b["keys"])) / (2 * n * m))
    width = max(best, length / ((MOST_ENTRIES - 1) * (n + m)), span / (n + m))
    return max(width, 1.0) if whole else width or 1.0


def interval_join(left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], keys: tuple[tuple[str, str], ...] = (), bin_rows: int = BIN_ROWS) -> DataFrame:
    """Pairs of rows whose closed intervals have a point in common, and whose ``keys`` (left, right) are equal.

    A span names first and last point, columns of dates, times or numbers; one column named twice is a point. Each
    interval has an entry in every bin it touches; entries meet by keys and bin, an equi-join, and a pair counts only in
    the first bin that it has in common, so nothing has to be made distinct. The width of bins comes from the data. The
    left entries of a bin of more than ``bin_rows`` are dealt by hash, and the right ones go to each part. (With so many
    rows that more than ``MOST_HOT`` bins could be hot, ``bin_rows`` is raised; so their table may be broadcast.)

    An interval with a null end or with its last point before its first meets nothing, and neither does a null key.
    Repeated rows make a pair each. Right columns whose name is taken get an underscore before it.
    """
    mine, other = (_placed(d, span, [k[i] for k in keys], name) for i, (d, span, name) in enumerate(((left, left_span, "mine"), (right, right_span, "other"))))
    whole = not isinstance(mine.schema["low"].dataType, T.FractionalType) and not isinstance(other.schema["low"].dataType, T.FractionalType)
    width = bin_width(mine, other, whole)
    bin_of = lambda c: F.floor(F.col(c) / F.lit(width)).cast("long")

    def entries(rows: DataFrame, first: str) -> DataFrame:
        return rows.withColumn(first, bin_of("low")).withColumn("bin", F.explode(F.sequence(F.col(first), bin_of("high"))))

    a = entries(mine, "first")
    hot, parts = F.broadcast(_hot_bins(a, bin_rows)), F.coalesce("parts", F.lit(1))
    a = a.join(hot, ["keys", "bin"], "left").withColumn("part", F.pmod(F.xxhash64("mine"), parts).cast("int")).drop("parts")
    b = entries(other, "began").select("keys", "bin", "began", F.col("low").alias("from"), F.col("high").alias("to"), "other")
    b = b.join(hot, ["keys", "bin"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    # Entries are many times larger in memory than in a shuffle, so Spark must not take them for a table to broadcast.
    pairs = a.join(b.hint("merge"), ["keys", "bin", "part"]).where((F.col("bin") == F.greatest("first", "began")) & (F.col("low") <= F.col("to")) & (F.col("from") <= F.col("high")))
    return beside(pairs.select("mine", "other"), left, right)


def meeting_counts(left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], keys: tuple[tuple[str, str], ...] = (), name: str = "n", slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Each row of ``left`` with ``name``, the number of rows that ``interval_join`` would give it.

    No pairs are made: an interval meets all that begin up to its end, but those that end before it begins. Both are
    running totals over the different ends by ``keys``, in slices of time where a key has many. So the work grows with
    the rows, however many meet. Rows that can meet nothing have 0; repeated rows come out once each.
    """
    mine, other = (_placed(d, span, [k[i] for k in keys], "row") for i, (d, span) in enumerate(((left, left_span), (right, right_span))))
    point = lambda rows, at, begun, over: rows.select("keys", F.col(at).alias("at"), F.lit(begun).cast("long").alias("begun"), F.lit(over).cast("long").alias("over"))
    ends = point(other, "low", 1, 0).union(point(other, "high", 0, 1)).union(point(mine, "low", 0, 0)).union(point(mine, "high", 0, 0))
    totals = _running(ends.groupBy("keys", "at").agg(F.sum("begun").alias("begun"), F.sum("over").alias("over")), slice_rows)
    begun = totals.select("keys", F.col("at").alias("high"), F.col("upto.begun").alias("begun"))
    over = totals.select("keys", F.col("at").alias("low"), (F.col("upto.over") - F.col("over")).alias("over"))
    spans = mine.select("keys", "low", "high").distinct().join(begun.hint("merge"), ["keys", "high"]).join(over.hint("merge"), ["keys", "low"])
    counts = spans.select(F.col("keys").alias("_keys"), F.col("low").alias("_low"), F.col("high").alias("_high"), (F.col("begun") - F.col("over")).alias("_n"))
    found = mine.join(counts, (F.col("keys") == F.col("_keys")) & (F.col("low") == F.col("_low")) & (F.col("high") == F.col("_high"))).select("row", "_n")
    rest = left.where(~F.coalesce(_meets(left, left_span, [k[0] for k in keys]), F.lit(False))).select(F.struct("*").alias("row"), F.lit(0).cast("long"))
    return found.union(rest).select("row.*", F.col("_n").alias(free_name(left, name)))


def _running(ends: DataFrame, slice_rows: int) -> DataFrame:
    """``ends(keys, at, begun, over)``, a row for each point, with ``upto``: the totals of its key up to it."""
    cuts = time_slices(ends.select(F.col("keys").alias("key"), F.col("at").alias("time")), slice_rows)
    placed = ends.join(F.broadcast(cuts.withColumnRenamed("key", "keys")), "keys", "left").select("keys", "at", "begun", "over", F.col("firsts").isNotNull().alias("cut"), slice_of(F.col("at"), F.col("firsts"), F.col("runs")).alias("slice"))
    within = Window.partitionBy("keys", "slice").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("keys").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.where("cut").groupBy("keys", "slice").agg(F.sum("begun").alias("b"), F.sum("over").alias("o"))  # as few as there are slices
    starts = parts.select("keys", "slice", F.sum("b").over(before).alias("begun_before"), F.sum("o").over(before).alias("over_before"))
    upto = F.struct(*((F.sum(c).over(within) + F.coalesce(f"{c}_before", F.lit(0))).alias(c) for c in ("begun", "over")))
    return placed.join(F.broadcast(starts), ["keys", "slice"], "left").select("keys", "at", "begun", "over", upto.alias("upto"))


def _hot_bins(entries: DataFrame, bin_rows: int) -> DataFrame:
    """(keys, bin, parts) of the bins with more than ``bin_rows`` of the ``entries``; they are counted if there are entries enough for one."""
    total = entries.count()
    most = max(bin_rows, math.ceil(total / MOST_HOT))
    counts = entries.groupBy("keys", "bin").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("keys", "bin", F.ceil(F.col("n") / most).cast("int").alias("parts"))
    return entries.sparkSession.createDataFrame(counts.collect() if total > most else [], counts.schema)


def _placed(rows: DataFrame, span: tuple[str, str], keys: list[str], name: str) -> DataFrame:
    """(keys, low, high, row as ``name``) of the rows whose interval and keys can meet others."""
    low, high = (ticks(F.col(c), rows.schema[c].dataType) for c in span)
    whole = F.struct("*").alias(name)
    return rows.where(_meets(rows, span, keys)).select(F.struct(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys))).alias("keys") if keys else F.lit(0).alias("keys"), low.alias("low"), high.alias("high"), whole)


def _meets(rows: DataFrame, span: tuple[str, str], keys: list[str]) -> Column:
    """Whether a row's interval and keys can meet others; null where an end is null."""
    low, high = (ticks(F.col(c), rows.schema[c].dataType) for c in span)
    known = low <= high
    for k in keys:
        known = known & F.col(k).isNotNull()
    return known
