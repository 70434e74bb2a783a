"""Sources: line-based record backups, other delimited text, JSON."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import fields_of, parse_integer, strict_integer, strip
from ..schema import FIELDS, RECORD, SEQ


def decode_lines(lines: DataFrame, column: str = "value", permissive: bool = False) -> DataFrame:
    """Records from lines; other columns of ``lines`` stay.

    A line is cut at every comma; what follows the sixth field is dropped. The name keeps its blanks, other fields lose
    theirs. Strict, a line with too few fields or a number that is none fails the query. Permissive, such a line's
    fields are null and ``rejected`` holds the line (null on good ones).
    """
    part = fields_of(F.col(column))
    texts = {name: F.get(part, i) for i, name in enumerate(FIELDS)}
    texts = {name: c if name == "name" else strip(c) for name, c in texts.items()}
    rest = [c for c in lines.columns if c != column]
    if not permissive:
        line = F.coalesce(F.col(column), F.lit("null"))
        few = F.coalesce(F.size(part), F.lit(0)) < len(FIELDS)
        wrong = reduce(Column.__or__, (parse_integer(texts[n]).isNull() for n in ("age", "grade")))
        reason = F.when(few, F.concat(F.lit("too few fields: "), line)).when(wrong, F.concat(F.lit("not an integer: "), line))
        # A filter, as columns that are not used are not computed: a bad line fails whatever is selected, a count too.
        lines = lines.where(F.when(reason.isNull(), F.lit(True)).otherwise(F.raise_error(reason).cast("boolean")))
        return lines.select(*rest, *(strict_integer(c).alias(n) if n in ("age", "grade") else c.alias(n) for n, c in texts.items()))
    numbers = {n: parse_integer(texts[n]).try_cast("int") for n in ("age", "grade")}
    good = F.coalesce((F.size(part) >= len(FIELDS)) & numbers["age"].isNotNull() & numbers["grade"].isNotNull(), F.lit(False))
    return lines.select(*rest, *(F.when(good, numbers.get(n, c)).alias(n) for n, c in texts.items()), F.when(~good, F.col(column)).alias("rejected"))


def load_backup(spark: SparkSession, path: str, permissive: bool = False) -> DataFrame:
    """Records of a backup; a path that does not exist is an empty table. Reading is lazy: bad lines fail the action."""
    try:
        lines = spark.read.text(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        lines = spark.createDataFrame([], "value string")
    return decode_lines(lines, permissive=permissive)


def load_backup_ordered(spark: SparkSession, path: str, permissive: bool = False) -> DataFrame:
    """Records of a backup's files with ``seq``, the line number from 0 over all of them in the order of their names.

    Files are read in blocks. Ids grow line by line within a block, so a line's number is its place in its block and
    the lines of the blocks before (a row for each block).
    """
    block = ["file", "start"]
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"))
    blocks = lines.groupBy(*block).agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = blocks.select(*block, (before - F.col("first")).alias("shift"))
    return decode_lines(lines.join(starts, block).select("value", (F.col("id") + F.col("shift")).alias(SEQ)), permissive=permissive)


def load_delimited(spark: SparkSession, path: str, schema: T.StructType | str = RECORD, sep: str = ",", header: bool = True, comment: str | None = None, corrupt: str | None = None, multi_line: bool = True) -> DataFrame:
    """Delimited text with quoting under an explicit schema. Ragged rows have null fields; a column named ``corrupt`` in the schema gets their lines.

    Quoted fields may hold line ends; without ``multi_line`` they may not, and large files are read in blocks.
    """
    options = {"sep": sep, "header": header, "multiLine": multi_line, "escape": '"', "comment": comment, "columnNameOfCorruptRecord": corrupt}
    return spark.read.schema(schema).options(**{k: v for k, v in options.items() if v is not None}).csv(path)


def load_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Files that hold a JSON array of objects each."""
    return spark.read.schema(schema).json(path, multiLine=True)
