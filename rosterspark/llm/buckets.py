"""Comparing the members of buckets inside tasks: hot buckets in blocks, groups streamed in sorted order.

A bucket of more than ``block`` nodes is cut into blocks by hash, and each pair of blocks is a group of its own, so no
bucket needs one task and a group has at most twice ``block`` nodes. What a group emits is up to the caller.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize

BLOCK = 512


def grouped(rows: DataFrame, keys: list[str], node: str, block: int = BLOCK) -> DataFrame:
    """``rows`` in buckets of at least two, with the group ``g`` (a hash), ``keys``, its blocks ``i`` and ``j``, and ``side``.

    In a group of one block with itself ``side`` is 2; else it is 0 for nodes of block ``i`` and 1 for those of ``j``.
    Rows are dealt by group and sorted by it.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = materialize(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "bucket-sizes")
    blocks = F.ceil(F.col("n") / block).cast("int")
    placed = rows.join(sizes, keys).select(*rows.columns, blocks.alias("blocks"), F.pmod(F.xxhash64(node), blocks).cast("int").alias("own"))
    # A node goes to every pair of blocks that holds its own; pair (i, j) has i <= j.
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("own")).alias("i"), F.greatest(o, F.col("own")).alias("j")))
    side = F.when(F.col("p.i") == F.col("p.j"), 2).when(F.col("p.i") == F.col("own"), 0).otherwise(1).cast("long")
    spread = placed.withColumn("p", F.explode(pair)).select(F.xxhash64(*keys, "p.i", "p.j").alias("g"), side.alias("side"), *rows.columns, "p.i", "p.j")
    return spread.repartition(n, "g").sortWithinPartitions("g")


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables that hold whole groups, from batches sorted by their first column; empty ones are left out."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        table = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
        g = table.column(0).to_numpy()
        cut = int(np.searchsorted(g, g[-1]))  # the last group may go on in the next batch
        if cut:
            yield table.slice(0, cut).combine_chunks()
        held = table.slice(cut)
    if held is not None:
        yield held.combine_chunks()


def close_pairs(g: np.ndarray, side: np.ndarray | None, close: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (a, b), a < b, of the pairs of a group, of different sides unless the side is 2, that ``close`` accepts."""
    starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
    ends = np.repeat(np.r_[starts[1:], len(g)], np.diff(np.r_[starts, len(g)]))
    here, low, high = np.arange(len(g)), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    step, left = 1, here[ends - here > 1]
    while len(left):
        a = left if side is None else left[(side[left] != side[left + step]) | (side[left] == 2)]
        a = a[close(a, a + step)]
        low.append(a)
        high.append(a + step)
        step += 1
        left = left[ends[left] - left > step]
    return np.concatenate(low), np.concatenate(high)


def smallest_reached(count: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each row the smallest row that the pairs reach."""
    root = np.arange(count)
    while True:
        least, before = np.minimum(root[low], root[high]), root.copy()
        np.minimum.at(root, low, least)
        np.minimum.at(root, high, least)
        root = root[root]
        if (root == before).all():
            return root
