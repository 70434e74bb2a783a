"""Sinks: CSV exports and line-based backups, as folders of part files, and small single files for people."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ROW_FORMAT, centre, encode_line, narrow, row_line
from ..schema import FIELDS

#: Quote only where needed, double quotes inside, keep blanks and empty texts as they are.
CSV = {"header": True, "escape": '"', "emptyValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
# The width of rulers and titles, and a table's head.
RULER = 70
#: The name of an export that is given none.
EXPORT_NAME = "records.csv"
HEAD = ("GRADE", "NAME", "PHONE", "EMAIL", "AGE", "ETC")


def replace_folder(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """Let ``write`` fill a folder beside ``path``, and only then put it in the place of what was there.

    If the write fails, or the driver is lost, the old folder is whole: at ``path``, or for a moment beside it. So a table
    may also be saved over the folder that it is read from.
    """
    to = lambda p: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
    files, mark = to(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), uuid.uuid4().hex
    bare = path.rstrip("/")
    new, old = f"{bare}.new-{mark}", f"{bare}.old-{mark}"
    try:
        write(new)
    except BaseException:
        files.delete(to(new), True)
        raise
    if files.exists(to(bare)) and not files.rename(to(bare), to(old)) or not files.rename(to(new), to(bare)):
        raise OSError(f"{path} could not be replaced; what it held is at {old}, and the new table at {new}")
    files.delete(to(old), True)


def save_csv(records: DataFrame, path: str, keep_if_empty: bool = True) -> bool:
    """Replace ``path`` by the records as CSV. An empty table leaves an older export in place, unless told otherwise; the answer says whether it was written."""
    if keep_if_empty and records.isEmpty():
        return False
    replace_folder(records.sparkSession, path, lambda new: records.write.options(**CSV).csv(new))
    return True


def export_csv(records: DataFrame, folder: str, name: str | None = None, keep_if_empty: bool = True) -> str | None:
    """Save the records as CSV in ``folder`` under ``name``, ``EXPORT_NAME`` where that is empty; the path, or None if nothing was written."""
    path = f"{folder.rstrip('/')}/{name or EXPORT_NAME}"
    return path if save_csv(records, path, keep_if_empty) else None


def lines_of(records: DataFrame) -> DataFrame:
    """``value``: a backup line for each record."""
    return records.select(encode_line([narrow(F.col(c)) if c in ("age", "grade") else F.col(c) for c in FIELDS]).alias("value"))


def save_backup(records: DataFrame, path: str, keep_if_empty: bool = True) -> bool:
    """Replace ``path`` by a backup. Fields that hold a comma do not survive a backup (use CSV for those)."""
    if keep_if_empty and records.isEmpty():
        return False
    replace_folder(records.sparkSession, path, lambda new: lines_of(records).write.text(new))
    return True


def rendered(records: DataFrame) -> DataFrame:
    """``line``: each record as an aligned text; other columns are not kept."""
    return records.select(row_line(*(F.col(c) for c in ("grade", "name", "phone", "email", "age", "etc"))).alias("line"))


def report(records: DataFrame, order: str, title: str = "RECORDS") -> DataFrame:
    """(part, place, line): the whole table as lines, to be read by part and place: title and head (0), a line for each record at its ``order`` (1), the last ruler (2)."""
    spark, kind = records.sparkSession, records.schema[order].dataType
    ruler = lambda c: F.repeat(F.lit(c), F.lit(RULER))
    head = F.array(ruler("="), centre(F.lit(title), RULER), ruler("-"), F.lit(f"{ROW_FORMAT % HEAD[:4]}{HEAD[4]}\t{HEAD[5]}"), ruler("-"))
    first = spark.range(1).select(F.lit(0).alias("part"), F.posexplode(head).alias("place", "line")).withColumn("place", F.col("place").cast(kind))
    body = records.select(F.lit(1).alias("part"), F.col(order).alias("place"), row_line(*(F.col(c) for c in ("grade", "name", "phone", "email", "age", "etc"))).alias("line"))
    return first.union(body).union(spark.range(1).select(F.lit(2), F.lit(0).cast(kind), ruler("=")))


def render_table(records: DataFrame, most: int, order: str, title: str = "RECORDS") -> str:
    """The first ``most`` rows by ``order`` as text, for a terminal; no other row comes to the driver."""
    return "\n".join(r.line for r in report(records.orderBy(order).limit(most), order, title).orderBy("part", "place").collect())
