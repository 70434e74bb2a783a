import datetime
import random

import pytest
from pyspark.sql import functions as F

from rosterspark.plans.session import replay
from rosterspark.streaming import arrivals, fold, windows

START = datetime.datetime(2024, 1, 1)
SCHEMA = "event_id long, ts timestamp, user_id long, command string"


def commands(seed, n):
    pick = random.Random(seed)
    return [(i, START + datetime.timedelta(minutes=3 * i), pick.choice([1, 2, 3, None]), pick.choice(["insert", "insert", "delete", None, "bogus"])) for i in range(n)]


def put(spark, rows, path, schema=SCHEMA):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def left_of(rows):
    """The records left, by plain Python: orders of inserts that no later delete of the key takes back."""
    kept = {}
    for i, _, key, command in sorted(rows):
        if command == "insert":
            kept.setdefault(key, []).append(i)
        elif command == "delete":
            kept[key] = []
    return [(str(k) if k is not None else None, i) for k, ids in kept.items() for i in ids]


def run(spark, source, out, kept):
    own = fold.stateful_session(spark)
    log = arrivals.read_arrivals(own, source, spark.createDataFrame([], SCHEMA))
    arrivals.run_to_end(fold.fold_commands(log, "ts", "2 hours", "event_id", "user_id", "command"), out, kept)
    return spark.read.schema(fold.OUT).parquet(out)


def test_fold_goes_on_after_restarts(spark, tmp_path):
    """Rows that come out of order within the delay, in three runs from one checkpoint, give the replay's table and one error a bogus command."""
    rows = commands(1, 120)
    source, out, kept = (f"file://{tmp_path}/{d}" for d in ("in", "out", "kept"))
    shuffled = sorted(rows, key=lambda r: r[0] + random.Random(r[0]).randrange(30))
    for part in (shuffled[:40], shuffled[40:80], shuffled[80:], [(None, START + datetime.timedelta(days=40), None, None)]):
        put(spark, part, source)
        changes = run(spark, source, out, kept)
    log = spark.createDataFrame(rows, SCHEMA)
    replayed = replay(log, "event_id", "user_id", "command = 'insert'", "command = 'delete'")
    found = sorted(((r.key, r.order) for r in fold.table_of(changes).collect()), key=repr)
    assert found == sorted(left_of(rows), key=repr) == sorted(((None if r.user_id is None else str(r.user_id), r.event_id) for r in replayed.collect()), key=repr)
    assert sorted(r.order for r in changes.where("change = 'error'").collect()) == [r[0] for r in rows if r[3] == "bogus"]
    assert changes.where("change = 'insert'").count() == sum(r[3] == "insert" for r in rows)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != fold.PROVIDER  # the caller's session is as it was


def test_fold_drops_late_rows(spark, tmp_path):
    """A row behind the watermark is dropped and counted; one within the delay is folded in its place."""
    source, out, kept = (f"file://{tmp_path}/{d}" for d in ("in", "out", "kept"))
    at = lambda hours: START + datetime.timedelta(hours=hours)
    put(spark, [(1, at(0), 7, "insert"), (5, at(10), 7, "insert"), (None, at(10), None, None)], source)
    run(spark, source, out, kept)
    put(spark, [(2, at(1), 7, "delete"), (4, at(9), 7, "delete"), (6, at(11), 7, "bogus"), (7, None, 7, "delete")], source)
    run(spark, source, out, kept)
    put(spark, [(None, at(500), None, None)], source)
    changes = run(spark, source, out, kept)
    assert sorted((r.order, r.change) for r in changes.collect()) == [(1, "delete"), (1, "insert"), (5, "insert"), (6, "error")]
    assert [r.order for r in fold.table_of(changes).collect()] == [5]


def test_fold_state_does_not_grow_with_keys(spark, tmp_path):
    """Thousands of keys, one of them hot, share a bounded number of states and stores; each keeps its own records, and numbers beyond 2**53 theirs."""
    pick, big = random.Random(3), 1 << 60
    keys = [*range(4000)] * 4 + [None] * 50 + [7] * 15000
    pick.shuffle(keys)
    rows = [(big + i, START + datetime.timedelta(seconds=i), k, pick.choice(["insert", "insert", "delete", "bogus"]) if k != 7 or i > 30000 else "insert") for i, k in enumerate(keys)]
    source, out, kept = (f"file://{tmp_path}/{d}" for d in ("in", "out", "kept"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 400)
    try:
        own = fold.stateful_session(spark)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert int(own.conf.get("spark.sql.shuffle.partitions")) <= 2 * spark.sparkContext.defaultParallelism
    beat = (None, START + datetime.timedelta(days=40), None, None)
    states = []
    for part in (rows[:20000], [*rows[20000:], beat]):
        put(spark, part, source)
        log = arrivals.read_arrivals(own, source, spark.createDataFrame([], SCHEMA))
        query = fold.fold_commands(log, "ts", "2 hours", "event_id", "user_id", "command").writeStream.outputMode("append")
        query = query.option("checkpointLocation", kept).trigger(availableNow=True).start(path=out, format="parquet")
        query.awaitTermination()
        states += [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress]
    assert 0 < max(states) <= 2 * 1024  # commands that wait and records, a group
    changes = spark.read.schema(fold.OUT).parquet(out)
    assert sorted(((r.key, r.order) for r in fold.table_of(changes).collect()), key=repr) == sorted(left_of(rows), key=repr)
    assert sorted(r.order for r in changes.where("change = 'error'").collect()) == [r[0] for r in rows if r[3] == "bogus"]


EVENTS = "id long, ts timestamp, k string, v int"


def sessions(rows, gap):
    """(key, first, last, count, sum) by plain Python; events exactly ``gap`` apart belong together."""
    by, out = {}, []
    for _, ts, k, v in sorted((r for r in rows if r[1]), key=lambda r: (r[1], r[0])):
        by.setdefault(k, []).append((ts, v))
    for k, events in by.items():
        own = [events[0]]
        for e in events[1:]:
            if e[0] - own[-1][0] > gap:
                out.append((k, own))
                own = []
            own.append(e)
        out.append((k, own))
    return sorted(((k, own[0][0], own[-1][0] + gap, len(own), sum(v for _, v in own)) for k, own in out), key=repr)


@pytest.mark.parametrize("steps", [1, 5])
def test_sessions_merge_late_events(spark, tmp_path, steps):
    pick = random.Random(steps)
    minutes = [pick.randrange(4000) for _ in range(150)] + [30, 60, 90, 90]  # ties, and events exactly a gap apart
    rows = [(i, START + datetime.timedelta(minutes=m), pick.choice(["a", "b", None]), i) for i, m in enumerate(minutes)] + [(999, None, "a", 1)]
    events = spark.createDataFrame(rows, EVENTS)
    found = arrivals.replayed(events, "ts", "id", 3000, lambda s: windows.session_windows(s, "ts", "k", "30 minutes", "1 hour", F.sum("v").alias("total")), f"file://{tmp_path}", steps)
    assert sorted(map(tuple, found.select("k", "start", "end", "n", "total").collect()), key=repr) == sessions(rows, datetime.timedelta(minutes=30))


def test_windows_and_late_rows(spark, tmp_path):
    """Tumbling windows; what comes behind the watermark is dropped, and an empty stream gives nothing."""
    at = lambda m: START + datetime.timedelta(minutes=m)
    source, like = f"file://{tmp_path}/in", spark.createDataFrame([], EVENTS)
    for part in ([(1, at(5), "a", 1), (2, at(65), "a", 1)], [(3, at(50), "a", 1), (4, at(5), "a", 1), (5, at(70), None, 1)], [(None, at(9000), None, None)]):
        put(spark, part, source, EVENTS)
        stream = windows.time_windows(arrivals.read_arrivals(spark, source, like), "ts", "k", "30 minutes", "30 minutes", "20 minutes")
        found = arrivals.run_to_end(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/kept")
    assert sorted(((r.k, r.start, r.n) for r in found.collect()), key=repr) == sorted([("a", at(0), 1), ("a", at(30), 1), ("a", at(60), 1), (None, at(60), 1)], key=repr)
    empty = arrivals.replayed(like, "ts", "id", 60, lambda s: windows.session_windows(s, "ts", "k", "30 minutes", "10 minutes"), f"file://{tmp_path}/none")
    assert empty.count() == 0
