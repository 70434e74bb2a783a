"""Distinct counts and quantiles kept as mergeable sketches or bitmaps in tables, so that later questions read no rows again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Logarithm of a theta sketch's entries: up to 4096 different values it is exact, beyond its standard error is about 1 / 64.
#: And the size of a quantile sketch: a rank is off by about 1.3 % of the rows.
LOG_ENTRIES, QUANTILE_SIZE = 12, 200


def sketch_table(rows: DataFrame, keys: list[str | Column], distinct: str, value: str | None = None) -> DataFrame:
    """``keys``, ``n``, ``users`` (a theta sketch of ``distinct``) and, with ``value``, ``ranks`` (a quantile sketch of it).

    Partial sketches meet before the shuffle, so a hot group moves a few kilobytes a task. Nulls are left out of both
    sketches, and the sketch of a group with nulls alone is that of nothing. An empty table gives an empty result.
    """
    made = [F.count(F.lit(1)).alias("n"), F.theta_sketch_agg(distinct, LOG_ENTRIES).alias("users")]
    if value is not None:
        made.append(F.kll_sketch_agg_double(F.col(value).cast("double"), QUANTILE_SIZE).alias("ranks"))
    return rows.groupBy(*keys).agg(*made)


def merged(sketches: DataFrame, keys: list[str | Column]) -> DataFrame:
    """The sketches of coarser ``keys``, from a table of ``sketch_table``; merging twice gives what merging once would."""
    made = [F.sum("n").alias("n"), F.theta_union_agg("users", LOG_ENTRIES).alias("users")]
    if "ranks" in sketches.columns:
        made.append(F.kll_merge_agg_double("ranks").alias("ranks"))
    return sketches.groupBy(*keys).agg(*made)


def distinct_of(sketch: str | Column = "users") -> Column:
    """How many different values a theta sketch has seen."""
    return F.theta_sketch_estimate(sketch)


def shared(a: str | Column, b: str | Column) -> Column:
    """How many different values two theta sketches have both seen."""
    return F.theta_sketch_estimate(F.theta_intersection(a, b))


def quantile_of(rank: float, sketch: str | Column = "ranks") -> Column:
    """The value at ``rank`` (0 to 1); null where the sketch has seen none."""
    return F.when(F.kll_sketch_get_n_double(sketch) > 0, F.kll_sketch_get_quantile_double(sketch, F.lit(rank)))


def bitmap_table(rows: DataFrame, keys: list[str | Column], distinct: str) -> DataFrame:
    """``keys``, ``bucket``, ``n`` and ``bits``: which values of ``distinct``, whole numbers, the rows have; exact at every size.

    Where a sketch of many values estimates, this counts. A bucket holds the bits of 32,768 neighbouring values in 4 KB
    that compress well, so a group is as many rows as its values have buckets. Rows with a null value are a bucket of
    their own, null, without bits.
    """
    value = F.col(distinct).cast("long")
    return rows.groupBy(*keys, F.bitmap_bucket_number(value).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.bitmap_construct_agg(F.bitmap_bit_position(value)).alias("bits"))
