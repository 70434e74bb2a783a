"""Sessions: a log of commands, replayed at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import table
from ..schema import free_name
from ..sinks import files

#: Commands by the names that a menu shows.
COMMANDS: dict[str, Callable] = {
    "1": table.insert,
    "2": files.rendered,
    "3": table.delete_confirmed,
    "4": table.find,
    "5": files.save_csv,
    "9": files.save_backup,
}


def command(name: str) -> Callable:
    """The operator behind a command; names match exactly, others are an error."""
    if name not in COMMANDS:
        raise KeyError(f"no such command: {name!r}")
    return COMMANDS[name]


def answered(log: DataFrame, column: str) -> DataFrame:
    """``log`` with ``operator``, the name of the operator behind each command, and ``error``, an answer where there is none.

    Names match exactly, without trimming; a null is no command either. Columns whose names are taken get an underscore.
    """
    known = F.create_map(*(F.lit(x) for name, f in COMMANDS.items() for x in (name, f.__name__)))
    operator = F.element_at(known, F.coalesce(F.col(column), F.lit("")))
    error = F.when(operator.isNull(), F.concat(F.lit("no such command: "), F.coalesce(F.col(column), F.lit("null"))))
    return log.select("*", operator.alias(free_name(log, "operator")), error.alias(free_name(log, "error")))


def replay(log: DataFrame, order: str, key: str, is_insert: Column | str, is_delete: Column | str, is_end: Column | str | None = None) -> DataFrame:
    """The inserts of ``log`` that no later delete of the same key takes back.

    Only the last delete of a key matters, so deletes are first reduced to one row for each key; then one equi-join on
    the key remains. A null key matches a null key. ``order`` must be unique. Commands after the first that ``is_end``
    accepts are ignored.
    """
    test = lambda c: F.expr(c) if isinstance(c, str) else c
    if is_end is not None:
        end = log.where(test(is_end)).agg(F.min(order)).first()[0]
        log = log if end is None else log.where(F.col(order) < F.lit(end))
    last = log.where(test(is_delete)).groupBy(F.col(key).alias("deleted")).agg(F.max(order).alias("last"))
    inserts = log.where(test(is_insert)).select(F.struct("*").alias("row"), F.col(key).alias("key"), F.col(order).alias("at"))
    joined = inserts.join(last, F.col("key").eqNullSafe(F.col("deleted")), "left")
    return joined.where(F.col("last").isNull() | (F.col("last") < F.col("at"))).select("row.*")
