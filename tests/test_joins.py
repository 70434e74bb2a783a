import datetime
import random

import pytest
from pyspark.sql import functions as F

from rosterspark.operators import asof, intervals

LEFT, RIGHT = "id long, k string, t timestamp_ntz, row string", "id long, k string, t timestamp_ntz, key string, n int"
AT = lambda i: None if i is None else datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=i)


def some(seed, n, keys=("a", "b", None)):
    pick = random.Random(seed)
    return [(i, pick.choice(keys), pick.choice([None, *range(40)])) for i in range(n)]


def last_before(left, right, strict=False, within=None):
    out = []
    for i, k, t in left:
        fits = [r for r in right if None not in (k, t, r[1], r[2]) and r[1] == k and (r[2] < t if strict else r[2] <= t)]
        best = max(fits, key=lambda r: (r[2], r[0]), default=None)
        out.append((i, best[0] if best and (within is None or t - best[2] <= within) else None))
    return sorted(out)


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("within", [None, 3])
@pytest.mark.parametrize("slice_rows", [1 << 18, 10])
def test_asof_equals_brute_force(spark, strict, within, slice_rows):
    left, right = some(1, 120), some(2, 60)
    a = spark.createDataFrame([(i, k, AT(t), "x") for i, k, t in left + left[:5]], LEFT)
    b = spark.createDataFrame([(i, k, AT(t), "y", i) for i, k, t in right + right[:5]], RIGHT)
    found = asof.asof_join(a, b, ("k", "t"), ("k", "t"), ties=("id",), strict=strict, within=within and f"interval {within} minutes", slice_rows=slice_rows)
    assert found.columns == ["id", "k", "t", "row", "_id", "_k", "_t", "key", "n"]
    assert sorted((r.id, r._id) for r in found.collect()) == sorted(last_before(left + left[:5], right, strict, within), key=lambda r: r[0])


def test_asof_splits_a_hot_key(spark):
    """A key with a third of all rows is cut into slices that run in many tasks."""
    pick = random.Random(3)
    rows = [(i, "hot" if i % 3 == 0 else f"k{i % 500}", pick.randrange(100_000)) for i in range(6000)]
    a = spark.createDataFrame([(i, k, t) for i, k, t in rows], "id long, k string, t long")
    b = spark.createDataFrame([(i, k, t) for i, k, t in rows if pick.random() < 0.05], "id long, k string, t long")
    cuts = asof.time_slices(a.select(F.col("k").alias("key"), F.col("t").alias("time")), 100)
    assert [r.key for r in cuts.collect()] == ["hot"]
    placed = a.join(cuts, F.col("k") == F.col("key")).groupBy(asof.slice_of(F.col("t"), F.col("firsts"), F.col("runs")).alias("slice")).count().collect()
    assert len(placed) == 20 and max(r["count"] for r in placed) < 200
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        found = asof.asof_join(a, b, ("k", "t"), ("k", "t"), ties=("id",), slice_rows=100).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert len({r.task for r in found if r.k == "hot"}) >= 8
    right = {}
    for r in b.collect():
        right.setdefault(r.k, []).append((r.t, r.id))
    assert sorted((r.id, r._id) for r in found) == [(i, max((x for x in right.get(k, []) if x[0] <= t), default=(None, None))[1]) for i, k, t in rows]


def test_asof_slices_by_cuts(spark):
    cuts = [1, 5, 5, 9, 12, 30, 31]
    rows = spark.createDataFrame([(t, [1, 9, 30], [[1, 5], [9, 12], [30, 31]]) for t in range(-2, 35)], "t int, firsts array<int>, runs array<array<int>>")
    found = {r.t: r.s for r in rows.select("t", asof.slice_of(F.col("t"), F.col("firsts"), F.col("runs")).alias("s")).collect()}
    assert found == {t: sum(c <= t for c in set(cuts)) for t in range(-2, 35)}


@pytest.mark.parametrize("side", ["left", "right", "both"])
def test_joins_of_empty_tables(spark, side):
    a, b = spark.createDataFrame([(1, "a", AT(1), "x")], LEFT), spark.createDataFrame([(1, "a", AT(0), "y", 1)], RIGHT)
    a, b = a.limit(0) if side != "right" else a, b.limit(0) if side != "left" else b
    assert [r._id for r in asof.asof_join(a, b, ("k", "t"), ("k", "t")).collect()] == ([None] if side == "right" else [])
    assert intervals.interval_join(a, b, ("t", "t"), ("t", "t"), (("k", "k"),)).isEmpty()


def meetings(left, right, keyed):
    return sorted((a[0], b[0]) for a in left for b in right if None not in a[2:] + b[2:] and a[2] <= a[3] and b[2] <= b[3] and a[2] <= b[3] and b[2] <= a[3] and (not keyed or a[1] is not None and a[1] == b[1]))


@pytest.mark.parametrize("keyed", [False, True])
@pytest.mark.parametrize("bin_rows", [1 << 16, 3])
@pytest.mark.parametrize("kind", ["timestamp_ntz", "timestamp", "date", "long", "double"])
def test_intervals_equal_brute_force(spark, keyed, bin_rows, kind):
    """Points, short intervals and one over everything; nulls, ends before starts, ties, repeated rows, names that clash."""
    pick = random.Random(4)

    def spans(n, most):
        return [(i, pick.choice(["a", "b", None]), s := pick.choice([None, *range(-30, 60)]), pick.choice([None, -100]) if pick.random() < 0.1 else None if s is None else s + pick.choice([0, 0, most])) for i in range(n)] + [(n, "a", -30, 60), (n + 1, "b", 7, 7), (n + 1, "b", 7, 7)]

    value = {"timestamp_ntz": AT, "timestamp": AT, "date": lambda i: None if i is None else datetime.date(2024, 1, 1) + datetime.timedelta(days=i), "long": lambda i: i, "double": lambda i: None if i is None else i / 8}[kind]
    left, right = spans(80, 3), spans(60, 9)
    schema = f"id long, k string, s {kind}, e {kind}, bin string, keys string"
    a, b = (spark.createDataFrame([(i, k, value(s), value(e), "x", "y") for i, k, s, e in rows], schema) for rows in (left, right))
    found = intervals.interval_join(a, b, ("s", "e"), ("s", "e"), (("k", "k"),) if keyed else (), bin_rows)
    assert found.columns == [*a.columns, *(f"_{c}" for c in a.columns)]
    assert sorted((r.id, r._id) for r in found.collect()) == meetings(left, right, keyed)


def test_interval_index_is_bounded(spark):
    """A few intervals over everything make no index of many entries a row, and the plan has no nested loops."""
    a = spark.range(1000).select("id", F.col("id").alias("s"), F.when(F.col("id") < 5, 1_000_000).otherwise(F.col("id")).alias("e"))
    width = intervals.bin_width(*(a.select(F.lit(0).alias("keys"), F.col("s").alias("low"), F.col("e").alias("high")) for _ in range(2)), True)
    assert a.select(F.sum(F.floor(F.col("e") / width) - F.floor(F.col("s") / width) + 1)).first()[0] <= intervals.MOST_ENTRIES * 1000
    plan = intervals.interval_join(a, a, ("s", "e"), ("s", "e"))._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("keyed", [False, True])
@pytest.mark.parametrize("slice_rows", [1 << 18, 5])
def test_meeting_counts_make_no_pairs(spark, keyed, slice_rows):
    """Counts equal brute force, with points and long intervals; nulls, ends before starts and repeated rows count 0 or each; no pairs are made."""
    pick = random.Random(9)
    spans = lambda n, most: [(i, pick.choice(["a", "b", None]), s := pick.choice([None, *range(-30, 60)]), None if s is None else s + pick.choice([-2, 0, 0, most])) for i in range(n)] + [(n, "a", -30, 60), (n + 1, "b", 7, 7), (n + 2, "b", 7, 7)]
    left, right = spans(90, 5), spans(70, 40)
    a, b = (spark.createDataFrame(rows, "id long, k string, s long, e long") for rows in (left, right))
    found = intervals.meeting_counts(a, b, ("s", "e"), ("s", "e"), (("k", "k"),) if keyed else (), slice_rows=slice_rows)
    met = [i for i, _ in meetings(left, right, keyed)]
    assert found.columns == [*a.columns, "n"] and sorted((r.id, r.n) for r in found.collect()) == [(r[0], met.count(r[0])) for r in left]
    same = spark.range(100_000).select("id", F.lit(1).alias("t"))
    assert intervals.meeting_counts(same, same, ("t", "t"), ("t", "t")).agg(F.sum("n")).first()[0] == 10**10
    assert intervals.meeting_counts(a, b.limit(0), ("s", "e"), ("s", "e")).agg(F.sum("n")).first()[0] == 0 and intervals.meeting_counts(a.limit(0), b, ("s", "e"), ("s", "e")).isEmpty()
