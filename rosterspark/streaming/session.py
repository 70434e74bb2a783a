"""The same sessions over a stream of commands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_deletes(log: DataFrame, order: str, key: str, is_delete: Column | str) -> DataFrame:
    """(key, last): the last delete of each key in a stream of commands, for update or complete output.

    Joined to the inserts as in ``plans.session.replay`` it gives the table as of the last batch. State is one number
    for each key, however many commands a key has.
    """
    test = F.expr(is_delete) if isinstance(is_delete, str) else is_delete
    return log.where(test).groupBy(key).agg(F.max(order).alias("last"))
