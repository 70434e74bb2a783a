"""What the operators share: the shared folder, tables that cut lineage, bounded samples, minima of hot groups."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import free_name

#: Used only where the session names no shared folder and runs on one machine (local runs and tests).
LOCAL_FOLDER = "/tmp/checkpoints"
#: Parts into which the rows of a hot group are dealt.
SALTS = 64
#: Slots by which rows are told from those that a join may concern: the table of slots in use has no more rows.
SLOTS = 1 << 21


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or a local one where it is unset and Spark runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (named or LOCAL_FOLDER).rstrip("/")


def tables_folder(spark: SparkSession) -> str:
    """The session's own folder of written tables, so that clearing it leaves other sessions alone."""
    return f"{shared_folder(spark)}/tables/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{tables_folder(spark)}/{name}-{uuid.uuid4().hex}"


def path_exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage and survives lost executors.

    Spark knows the size of what it reads back, so a join broadcasts such a table only where it is small.
    """
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_tables(spark: SparkSession) -> None:
    """Delete the tables that this session's operators have written, once no result that reads them is needed."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(tables_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def in_parts(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most ``rows`` rows, so that what is made of a part is small."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def fold(col: str, folds: int) -> Column:
    """``crc32`` of the id as text, modulo ``folds``; a null id counts as the empty string."""
    return F.pmod(F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def pieces_over(text: Column, pieces: int, size: int) -> Column:
    """The text, or of one longer than all pieces together as many of ``size`` characters, evenly spread from its start to its end, as lines."""
    step = (F.length(text) - size) / (pieces - 1)
    cut = F.transform(F.sequence(F.lit(0), F.lit(pieces - 1)), lambda i: F.substring(text, (i * step).cast("int") + 1, F.lit(size)))
    return F.when(F.length(text) > pieces * size, F.array_join(cut, "\n")).otherwise(text)


def bounded_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """About ``rows`` rows (never over twice as many), those of the lowest hashes of ``key``; all of them if there are fewer.

    Costs one count. The choice depends on the rows alone, so that it is the same in every run; among rows that repeat
    a key, order decides by all columns.
    """
    total = df.count()
    if total <= rows:
        return df
    h = F.xxhash64(F.col(key))
    below = -(1 << 63) + (1 << 64) * rows // total  # hashes are even over all 64-bit integers
    return df.where(h <= below).orderBy(h, *df.columns).limit(2 * rows)


def join_least(rows: DataFrame, group: str, value: str, name: str) -> DataFrame:
    """``rows`` with ``name``, the smallest ``value`` of the row's ``group``.

    Minima are aggregated on the map side, and joined back by group and salt, so a group that holds a third of all rows
    is spread over ``SALTS`` tasks.
    """
    salt, low = free_name(rows, "salt"), free_name(rows, "low")
    salted = rows.withColumn(salt, F.pmod(F.xxhash64(value), F.lit(SALTS)).cast("short"))
    parts = salted.groupBy(group, salt).agg(F.min(value).alias(low))
    least = parts.groupBy(group).agg(F.min(low).alias(name))
    return salted.join(parts.select(group, salt).join(least, group), [group, salt]).drop(salt)


def split_by_slots(rows: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` that certainly have none of ``keys`` (columns of both), and the others, which a join by key has to settle.

    Keys are hashed to ``SLOTS`` slots; those in use are a table of bounded size, broadcast however many keys there are.
    So wide rows move only where their slot is in use, in the same way at every size: nearly none while keys are few,
    all when they are many more than slots.
    """
    name = free_name(rows, "slot")
    slot = F.pmod(F.xxhash64(*keys.columns), F.lit(SLOTS)).cast("int").alias(name)
    used = F.broadcast(keys.select(slot).distinct())
    placed = rows.select("*", slot)
    return placed.join(used, name, "left_anti").drop(name), placed.join(used, name, "left_semi").drop(name)
