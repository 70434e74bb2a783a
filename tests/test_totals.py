import datetime
import random
from collections import Counter
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from rosterspark.operators import rolling, sets, sketches, table
from rosterspark.plans import queries


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


SCHEMA = "a string, b int, x string, y int, v int, _v int, g int"


def mixed(seed, n):
    pick = random.Random(seed)
    return [(pick.choice(["p", "q", None]), pick.choice([1, 2, None]), pick.choice(["u", "w", "z", None]), pick.choice([*range(5), None]), pick.choice([*range(9), None]), 0, 0) for _ in range(n)]


def brute_sets(rows, chosen):
    out = []
    for s in chosen:
        groups = {}
        for r in rows:
            key = tuple(v if c in s else None for c, v in zip("ab", r))
            groups.setdefault(key, []).append(r)
        mask = ("a" not in s) * 2 + ("b" not in s)
        for key, own in groups.items():
            values = [r[4] for r in own if r[4] is not None]
            out.append((*key, mask, len(own), sum(values) if values else None, min(values, default=None), len({r[2] for r in own} - {None}), len({r[3] for r in own} - {None})))
    return sorted(out, key=repr)


@pytest.mark.parametrize("n", [0, 1, 300])
@pytest.mark.parametrize("sets_of", [sets.cube, sets.rollup, lambda k: [("b",), ()]])
def test_grouping_sets_equal_brute_force(spark, n, sets_of):
    """Nulls in keys and values, repeated rows, and columns with the names that are used inside."""
    data = mixed(n, n) + mixed(n, n)[:20]
    found = sets.grouping_sets(spark.createDataFrame(data, SCHEMA), ["a", "b"], sets_of(["a", "b"]), {"n": ("count", "*"), "total": ("sum", "v"), "least": ("min", "v")}, {"xs": "x", "ys": "y"})
    assert found.columns == ["a", "b", "grouping", "n", "total", "least", "xs", "ys"]
    assert rows_of(found) == brute_sets(data, sets_of(["a", "b"]))


def test_grouping_sets_spread_partials_only(spark):
    """What is spread over the sets comes after the first aggregation, which halves nothing but sums copies up."""
    data = spark.range(20_000).select((F.col("id") % 2).alias("a"), (F.col("id") % 3).alias("b"), (F.col("id") % 5).alias("x"))
    found = sets.grouping_sets(data, ["a", "b"], sets.cube(["a", "b"]), {"n": ("count", "*")}, {"xs": "x"})
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Generate") :]
    assert "Aggregate" in below and "Expand" not in plan
    assert rows_of(found)[-1][2:] and {r[4] for r in rows_of(found)} == {5}
    only = sets.grouping_sets(data, ["a"], [("a",), ()], {}, {"xs": "x"})
    assert rows_of(only) == [(0, 0, 5), (1, 0, 5), (None, 1, 5)]
    with pytest.raises(ValueError):
        sets.grouping_sets(data, ["a"], [()], {}, {})


def test_bags(spark):
    pick = random.Random(5)
    made = lambda n: [(pick.choice(["x", "y", None]), pick.choice([1, None])) for _ in range(n)]
    old, new = made(60), made(40)
    a, b = (spark.createDataFrame(r, "row string, before int") for r in (old, new))
    before, after = Counter(old), Counter(new)
    assert sets.bag_counts(a, b).columns == ["row", "before", "_before", "after"]
    assert rows_of(sets.bag_counts(a, b)) == sorted(((*r, before[r], after[r]) for r in before | after), key=repr)
    assert rows_of(sets.added(a, b)) == sorted((after - before).elements(), key=repr)
    assert rows_of(sets.added(b, a)) == sorted((before - after).elements(), key=repr)
    assert rows_of(sets.common(a, b.select("before", "row"))) == sorted((before & after).elements(), key=repr)
    assert sets.common(a, b.limit(0)).isEmpty() and rows_of(sets.added(a.limit(0), b)) == sorted(new, key=repr)


@pytest.mark.parametrize("slice_rows", [1 << 18, 20])
@pytest.mark.parametrize("kind", ["timestamp_ntz", "timestamp", "int"])
def test_rolling_equals_brute_force(spark, slice_rows, kind):
    """Ties, rows exactly a span apart, nulls everywhere, repeated rows, and columns with clashing names."""
    pick = random.Random(6)
    at = (lambda m: m) if kind == "int" else lambda m: None if m is None else datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=m)
    data = [(i, pick.choice(["hot", "hot", "b", None]), pick.choice([*range(60), None]), pick.choice([Decimal("1.5"), Decimal("-2"), None])) for i in range(300)]
    data += data[:10]
    rows = spark.createDataFrame([(i, k, at(t), v, 7) for i, k, t, v in data], f"id int, k string, t {kind}, v decimal(9,2), n int")
    found = rolling.rolling_totals(rows, "k", "t", "7" if kind == "int" else "interval 7 minutes", {"total": "v", "n": "v"}, count="count", slice_rows=slice_rows)
    assert found.columns == ["id", "k", "t", "v", "n", "count", "total", "_n"]
    expected = []
    for i, k, t, v in data:
        own = [] if t is None else [r[3] for r in data if r[1] == k and r[2] is not None and t - 7 <= r[2] <= t]
        values = [x for x in own if x is not None]
        expected.append((i, len(own) if t is not None else None, sum(values) if values else None))
    assert sorted(((r.id, r["count"], r.total) for r in found.collect()), key=repr) == sorted(expected, key=repr)


def test_rolling_of_a_hot_key_runs_in_many_tasks(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("t"))
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {c: spark.conf.get(c) for c in settings}
    for c, v in settings.items():
        spark.conf.set(c, v)
    try:
        found = rolling.rolling_totals(rows, "k", "t", "30", {}, slice_rows=100).withColumn("task", F.spark_partition_id()).collect()
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert len({r.task for r in found if r.k == 0}) >= 8
    assert all(r.n == (min(11, r.t // 3 + 1) if r.k == 0 else 1) for r in found)


def test_rolling_refuses_floats_and_takes_empty_tables(spark):
    rows = spark.createDataFrame([(1, 2, 0.5)], "k int, t int, v double")
    with pytest.raises(ValueError):
        rolling.rolling_totals(rows, "k", "t", "1", {"s": "v"})
    assert rolling.rolling_totals(rows.limit(0).drop("v"), "k", "t", "1", {"s": "t"}).isEmpty()


@pytest.mark.parametrize("ties", [False, True])
def test_top_k(spark, ties):
    pick = random.Random(7)
    data = [(pick.choice(["a", "b", None]), pick.choice([*range(8), None]), i) for i in range(100)]
    rows = spark.createDataFrame(data, "k string, v int, place int")
    order = [F.col("v").desc_nulls_last()] if ties else [F.col("v").desc_nulls_last(), F.col("place")]
    found = table.top_k(rows, ["k"], order, 4, ties)
    rank = lambda r: (r[1] is None, -(r[1] or 0))
    expected = []
    for k in ("a", "b", None):
        own = sorted((r for r in data if r[0] == k), key=lambda r: (*rank(r), r[2]))
        expected += [r for r in own if rank(r) <= rank(own[3])] if ties else own[:4]
    assert sorted(((r.k, r.v, r.place) for r in found.collect()), key=repr) == sorted(expected, key=repr) and found.columns[-1] == "_place"
    assert table.top_k(rows.limit(0), ["k"], order, 4).isEmpty()


def test_top_k_is_cut_before_the_shuffle(spark):
    """A hot key sends at most k rows a task."""
    rows = spark.range(0, 40_000, 1, 8).select((F.col("id") % 2).alias("k"), F.col("id").alias("v"))
    plan = table.top_k(rows, ["k"], [F.col("v").desc()], 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and plan.rindex("WindowGroupLimit") > plan.index("Exchange hashpartitioning")


def test_sketches(spark):
    """Exact up to 4096 values, within four deviations beyond, and the same however they are merged."""
    rows = spark.range(60_000).select((F.col("id") % 10).alias("day"), F.when(F.col("id") % 50 > 0, F.col("id") % 20_011).alias("user"), (F.col("id") * 7919 % 60_000).cast("double").alias("v"))
    days = sketches.sketch_table(rows, ["day"], "user", "v")
    exact = {r.day: r.n for r in rows.groupBy("day").agg(F.count_distinct("user").alias("n")).collect()}
    for r in days.select("day", sketches.distinct_of().alias("d"), sketches.quantile_of(0.5).alias("m")).collect():
        assert abs(r.d / exact[r.day] - 1) < 4 / 64 and abs(r.m / 60_000 - 0.5) < 0.03
    twice = sketches.merged(sketches.merged(days, [(F.col("day") % 2).alias("day")]), [F.lit(0).alias("all")])
    once = sketches.merged(days, [F.lit(0).alias("all")])
    a, b = (d.select("n", sketches.distinct_of().alias("d"), sketches.quantile_of(0.9).alias("q")).first() for d in (once, twice))
    assert a.n == b.n == 60_000 and a.d == b.d and abs(a.d / 20_011 - 1) < 4 / 64 and abs(b.q / 60_000 - 0.9) < 0.03
    small = sketches.sketch_table(spark.range(3000).select(F.lit("g").alias("g"), F.col("id")), ["g"], "id")
    assert small.select(sketches.distinct_of()).first()[0] == 3000 and "ranks" not in small.columns
    none = sketches.sketch_table(spark.createDataFrame([("g", None, None)] * 2, "g string, u long, v double"), ["g"], "u", "v")
    assert none.select("n", sketches.distinct_of(), sketches.quantile_of(0.5)).first()[:] == (2, 0, None)
    assert sketches.sketch_table(rows.limit(0), ["day"], "user", "v").isEmpty()


def test_users_are_counted_beyond_a_sketch(spark, tmp_path):
    """More users a week than a sketch tells apart, large and negative ids, nulls: counts are those of SQL."""
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, start + datetime.timedelta(minutes=i % 20_000), i % 7001 * (3 if i % 5 else -40_000), "signup" if i % 3 else "purchase", 1.0) for i in range(40_000)]
    rows += [(-1, start, None, "signup", 1.0), (-2, start, None, "purchase", 1.0), (-3, None, 5, "signup", 1.0), (-4, None, 5, "purchase", 1.0), (-5, start + datetime.timedelta(days=300), 5, None, 1.0)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").coalesce(1).write.parquet(f"file://{tmp_path}/events.parquet")
    duckdb.sql(f"create or replace temp view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    expected = duckdb.sql(queries.ORACLE_SQL["sketch_users"]).fetchall()
    assert max(r[2] for r in expected) > 4096
    assert sorted(map(tuple, queries.sketch_users(spark, f"file://{tmp_path}").collect()), key=repr) == sorted(expected, key=repr)


def test_sets_are_spread_over_all_tasks(spark):
    """Rows that explode to every set are dealt in as many tasks as there are shuffle partitions, not in the few that their bytes would fill before."""
    rows = spark.range(2000).select((F.col("id") % 7).alias("a"), (F.col("id") % 3).alias("b"), "id")
    found = sets.grouping_sets(rows, ["a", "b"], sets.cube(["a", "b"]), {"n": ("count", "*")}, {"ids": "id"})
    got = found.collect()
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert sorted(r.ids for r in got) == sorted([rows.where((F.col("id") % 7 == a) & (F.col("id") % 3 == b)).count() for a in range(7) for b in range(3)] + [2000 // 7 + (a < 5) for a in range(7)] + [667, 667, 666, 2000])
