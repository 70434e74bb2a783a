"""Totals and distinct counts over several sets of keys at once, and differences of tables as bags."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How the totals of parts become the total of the whole.
MERGE = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}
MAKE = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max}


def cube(keys: Sequence[str]) -> list[tuple[str, ...]]:
    """Every subset of ``keys``."""
    return [s for n in range(len(keys), -1, -1) for s in combinations(keys, n)]


def rollup(keys: Sequence[str]) -> list[tuple[str, ...]]:
    """``keys``, then ever shorter beginnings of them."""
    return [tuple(keys[:n]) for n in range(len(keys), -1, -1)]


def grouping_sets(rows: DataFrame, keys: Sequence[str], sets: Sequence[Sequence[str]], totals: dict[str, tuple[str, str | Column]], distinct: dict[str, str]) -> DataFrame:
    """``keys``, ``grouping``, then ``totals`` (name: kind of ``MAKE`` and column) and ``distinct`` counts (name: column) of each set.

    ``grouping`` has a bit for each key, the first key's the highest, set where the key is summed over; so a null that
    stands for all is told from a null of the data, which is a group of its own. Distinct counts leave nulls out.

    Rows are shuffled once for each distinct column, as partial totals by all keys and that column. Only those partials
    are spread over the sets, and meet again in two levels: by set and value, where each value counts once, then by set.
    So a group that all rows belong to is counted from one row a value and task. The empty set of an empty table gives no row.
    """
    if not totals and not distinct:
        raise ValueError("nothing to compute")
    made = [MAKE[kind](F.col(c) if isinstance(c, str) and c != "*" else F.lit(1) if isinstance(c, str) else c).alias(name) for name, (kind, c) in totals.items()]
    merge = lambda parts: [MERGE[kind](F.col(f"_t{i}")).alias(f"_t{i}") for i, (kind, _) in enumerate(parts)]
    plain = {c: f"_k{i}" for i, c in enumerate(keys)}

    def sides(value: Column | None, own: bool) -> DataFrame:
        """Set, its keys, its totals if ``own``, and the distinct count of ``value``."""
        parts = [m.alias(f"_t{i}") for i, m in enumerate(made)] if own else []
        kinds = list(totals.values()) if own else []
        named = rows.groupBy(*(F.col(c).alias(k) for c, k in plain.items()), (F.lit(None).cast("int") if value is None else value).alias("_v"))
        base = named.agg(*parts) if parts else named.agg(F.lit(0).alias("_none"))
        # Each row is about to become one for each set, so few small partitions would become few large ones. (In the order
        # of the groups Spark would drop this shuffle and join its partitions again.)
        base = base.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_v", *plain.values())
        masks = [F.struct(F.lit(_mask(keys, s)).alias("g"), *(F.col(k).alias(k) if c in s else F.lit(None).cast(base.schema[k].dataType).alias(k) for c, k in plain.items())) for s in sets]
        spread = base.select(F.explode(F.array(*masks)).alias("s"), "_v", *(f"_t{i}" for i in range(len(parts)))).select("s.*", "_v", *(f"_t{i}" for i in range(len(parts))))
        once = spread.groupBy("g", *plain.values(), "_v").agg(*(merge(kinds) or [F.lit(0).alias("_none")]))
        return once.groupBy("g", *plain.values()).agg(F.count("_v").alias("_n"), *merge(kinds))

    columns = list(distinct.items()) or [(None, None)]
    found = []
    for i, (name, c) in enumerate(columns):
        side = sides(None if c is None else F.col(c), i == 0)
        counts = [(F.col("_n") if j == i else F.lit(None).cast("long")).alias(f"_d{j}") for j in range(len(distinct))]
        own = [(F.col(f"_t{j}") if i == 0 else F.lit(None).cast(found[0].schema[f"_t{j}"].dataType)).alias(f"_t{j}") for j in range(len(totals))]
        found.append(side.select("g", *plain.values(), *own, *counts))
    whole = reduce(DataFrame.union, found)
    if len(found) > 1:  # a row for each distinct column and group
        whole = whole.groupBy("g", *plain.values()).agg(*(F.max(c).alias(c) for c in whole.columns if c[:2] in ("_t", "_d")))
    names = [F.col(f"_t{i}").alias(n) for i, n in enumerate(totals)] + [F.col(f"_d{i}").alias(n) for i, n in enumerate(distinct)]
    return whole.select(*(F.col(k).alias(c) for c, k in plain.items()), F.col("g").alias("grouping"), *names)


def _mask(keys: Sequence[str], own: Sequence[str]) -> int:
    return sum((c not in own) << (len(keys) - 1 - i) for i, c in enumerate(keys))


def bag_counts(old: DataFrame, new: DataFrame) -> DataFrame:
    """The columns of both tables, ``before`` and ``after``: how often each row is in ``old`` and in ``new``.

    Columns match by name. Nulls are equal to nulls here. Copies are summed before the shuffle, so a row that makes up a
    third of a table moves once a task. Rows of types that cannot be grouped (maps) are refused by Spark.
    """
    columns = old.columns
    both = old.select(F.struct(*columns).alias("row"), F.lit(1).alias("b"), F.lit(0).alias("a")).union(new.select(F.struct(*columns).alias("row"), F.lit(0), F.lit(1)))
    counts = both.groupBy("row").agg(F.sum("b").alias("b"), F.sum("a").alias("a"))
    taken = {c.lower() for c in columns}
    free = lambda name: next(n for n in ("_" * i + name for i in range(len(taken) + 1)) if n.lower() not in taken)
    return counts.select("row.*", F.col("b").alias(free("before")), F.col("a").alias(free("after")))


def _repeated(old: DataFrame, new: DataFrame, times: Column) -> DataFrame:
    counts = bag_counts(old, new)
    named = counts.select(F.struct(*counts.columns[:-2]).alias("row"), F.col(counts.columns[-2]).alias("b"), F.col(counts.columns[-1]).alias("a")).where(times > 0)
    return named.select("row", F.explode(F.sequence(F.lit(1).cast("long"), times)).alias("copy")).select("row.*")


def added(old: DataFrame, new: DataFrame) -> DataFrame:
    """The rows of ``new`` beyond those of ``old``, each as often as it was added; swapped, those that were removed."""
    return _repeated(old, new, F.col("a") - F.col("b"))


def common(old: DataFrame, new: DataFrame) -> DataFrame:
    """The rows of both, each as often as it is in both."""
    return _repeated(old, new, F.least("a", "b"))
