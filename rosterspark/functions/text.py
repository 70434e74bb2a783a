"""Column expressions on text: strip, integer parsing, alignment, rendering, encoding of lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: how a rendered record's columns before the age are padded.
ROW_FORMAT = "%5s\t%-3s\t%-13s\t%-10s\t"
#: An integer as Python's int() reads it, ASCII digits only (other digits are not supported).
INTEGER = r"^[+-]?[0-9]+(_[0-9]+)*$"


def strip(c: Column) -> Column:
    """Without white space at either end: any of Unicode's, and the four separators that Python counts too."""
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def parse_integer(c: Column) -> Column:
    """A DECIMAL(38,0), null where ``c`` is no integer: blanks around, a sign and single underscores are allowed."""
    bare = strip(c)
    return F.when(bare.rlike(INTEGER), F.regexp_replace(bare, "_", "").try_cast("decimal(38,0)"))


def strict_integer(c: Column) -> Column:
    """An INT; a text that is no integer fails the query."""
    wrong = F.raise_error(F.concat(F.lit("not an integer: "), F.coalesce(c, F.lit("null"))))
    return F.coalesce(parse_integer(c), wrong.cast("decimal(38,0)")).cast("int")


def narrow(c: Column) -> Column:
    """A stored number as integer, cut towards zero."""
    return c.cast("int")


def encode_line(columns: Sequence[Column]) -> Column:
    """The values joined by comma and blank, one blank at the end; nulls are empty, so no field shifts."""
    return F.concat(F.concat_ws(", ", *(F.coalesce(c.cast("string"), F.lit("")) for c in columns)), F.lit(" "))


def fields_of(line: Column) -> Column:
    """The pieces between commas, empty ones at the end included. No quoting: a comma always separates."""
    return F.split(line, ",", -1)


def stars(grade: Column) -> Column:
    """As many stars as ``grade``; none for zero or less."""
    return F.repeat(F.lit("*"), grade.cast("int"))


def centre(c: Column, width: int) -> Column:
    """Centred in ``width``, the odd blank on the right; longer texts stay whole."""
    left = F.greatest(F.floor((F.lit(width) - F.length(c)) / 2), F.lit(0)).cast("int")
    right = F.greatest(F.lit(width) - F.length(c) - left, F.lit(0)).cast("int")
    return F.concat(F.repeat(F.lit(" "), left), c, F.repeat(F.lit(" "), right))


def row_line(grade: Column, name: Column, phone: Column, email: Column, age: Column, etc: Column) -> Column:
    """A record as one aligned line, tab-separated; widths pad and never cut. Nulls are empty."""
    texts = [F.coalesce(c, F.lit("")) for c in (stars(grade), name, phone, email)]
    aged = F.when(age.isNull(), F.lit("   ")).otherwise(F.format_string("%3d", age.cast("int")))
    return F.concat(F.format_string(ROW_FORMAT, *texts), aged, F.lit("\t"), F.coalesce(etc, F.lit("")))


def is_yes(answer: Column) -> Column:
    """True for ``y`` and ``Y`` alone, untrimmed; a null is no."""
    return F.coalesce(F.upper(answer) == "Y", F.lit(False))


def or_default(c: Column, default: str) -> Column:
    """``default`` for an empty or null text."""
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))
