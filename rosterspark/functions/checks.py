"""Validation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import free_name
from .text import INTEGER, parse_integer, strip

# Two Hangul syllables side by side, anywhere in a name; the ends of ages and grades.
NAME_PATTERN = "[가-힣]{2,}"
AGE_LOW, AGE_HIGH, GRADE_LOW, GRADE_HIGH = 0, 130, 1, 5


def in_range(c: Column, low: int, high: int) -> Column:
    """Both ends included; false for null."""
    return F.coalesce(c.between(low, high), F.lit(False))


def matches(c: Column, pattern: str) -> Column:
    """Whether ``pattern`` is found anywhere; false for null."""
    return F.coalesce(c.rlike(pattern), F.lit(False))


def clamp(c: Column, low: int, high: int) -> Column:
    """``c`` held within the ends; null gives ``low``."""
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def parse_or_default(c: Column, low: int = GRADE_LOW, high: int = GRADE_HIGH, default: int = GRADE_LOW) -> Column:
    """An integer of any size held within the ends, ``default`` where ``c`` is none. It is clamped before it is narrowed."""
    wide = [F.lit(v).cast("decimal(38,0)") for v in (low, high)]
    bare, number = strip(c), parse_integer(c)
    long = bare.rlike(INTEGER) & (F.length(F.regexp_replace(bare, "^[+-]?[0_]*|_", "")) > 37)  # sign and length tell where it lies
    held = F.when(long, F.when(bare.startswith("-"), wide[0]).otherwise(wide[1])).when(number.isNotNull(), F.least(F.greatest(number, wide[0]), wide[1]))
    return F.coalesce(held.cast("int"), F.lit(default))


def split_valid(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted records and rejected rows of ``answers``, whose fields are texts as a user typed them.

    A row is accepted if its name matches and its age is an integer in range; its grade is clamped, 1 where it is no
    integer. Rejected rows keep their texts and get ``reason`` (``_reason`` if they have a column of that name).
    """
    age = parse_integer(F.col("age"))
    bad_name, bad_age = ~matches(F.col("name"), NAME_PATTERN), ~in_range(age, AGE_LOW, AGE_HIGH)
    accepted = answers.where(~bad_name & ~bad_age).withColumns({"age": age.cast("int"), "grade": parse_or_default(F.col("grade"))})
    return accepted, answers.where(bad_name | bad_age).withColumn(free_name(answers, "reason"), F.when(bad_name, "name").otherwise("age"))
