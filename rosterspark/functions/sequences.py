"""Sequence helpers: safe position lookup, bounded Fibonacci series, repeated lines, reversal."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: the lines that are repeated by default.
LINES = ("Hello, Python", "Hello, World")
#: Terms from F(0) to F(183), the last that DECIMAL(38,0) holds, are available.
LAST_TERM = 183


def safe_index(array: Column, item: Column) -> Column:
    """First 0-based position of ``item`` in an array, -1 if it is not there or null."""
    return (F.coalesce(F.array_position(array, item), F.lit(0)) - 1).cast("int")


def safe_index_text(text: Column, part: Column) -> Column:
    """First 0-based position of ``part`` in a text, -1 if it is not there or null; 0 for an empty part."""
    return F.coalesce(F.instr(text, part), F.lit(0)) - 1


#: The limit where none is given.
BELOW = 100


def _terms() -> Column:
    """All terms that are available, an array of constants, so that rows only filter it."""
    terms = [0, 1]
    while len(terms) <= LAST_TERM:
        terms.append(terms[-2] + terms[-1])
    return F.array(*(F.lit(str(t)).cast("decimal(38,0)") for t in terms))


def fibonacci_below(limit: Column) -> Column:
    """The terms less than ``limit``, an integer, as an array: from 0, 1, 1 on, ``BELOW`` being the limit of a null; none for zero or less.

    A limit of 38 digits, the longest that its type holds, is still less than the term after F(183).
    """
    below = F.coalesce(limit.cast("decimal(38,0)"), F.lit(BELOW).cast("decimal(38,0)"))
    return F.filter(_terms(), lambda t: t < below)


def fibonacci_text(limit: Column) -> Column:
    """The same terms as one text, a blank after each."""
    return F.array_join(F.transform(fibonacci_below(limit), lambda t: F.concat(t.cast("string"), F.lit(" "))), "")


def fibonacci(spark: SparkSession, below: int = BELOW) -> DataFrame:
    """(n, value): the terms less than ``below``."""
    if below >= 10**38:
        raise ValueError(f"terms beyond F({LAST_TERM}) do not fit DECIMAL(38,0)")
    return spark.range(1).select(F.posexplode(fibonacci_below(F.lit(str(below)))).alias("n", "value"))


def fibonacci_line(spark: SparkSession, below: int = BELOW) -> DataFrame:
    """The same terms as one text, a blank after each."""
    return spark.range(1).select(fibonacci_text(F.lit(str(below))).alias("line"))


def repeated(count: Column, lines: Sequence[str] = LINES) -> Column:
    """The lines ``count`` times, in turn, as an array; an empty one for a null, zero or less."""
    return F.flatten(F.array_repeat(F.array(*map(F.lit, lines)), F.greatest(F.coalesce(count, F.lit(0)), F.lit(0)).cast("int")))


def repeat_lines(spark: SparkSession, count: int, lines: Sequence[str] = LINES) -> DataFrame:
    """(seq, line): the lines ``count`` times, in turn; nothing for zero or less."""
    rows = spark.range(max(count, 0)).select(F.col("id"), F.posexplode(F.array(*map(F.lit, lines))).alias("pos", "line"))
    return rows.select((F.col("id") * len(lines) + F.col("pos")).alias("seq"), "line")


def reverse(array: Column) -> Column:
    return F.reverse(array)
