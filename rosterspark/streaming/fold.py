"""Commands folded in order as they arrive: keyed state, event-time timers, and changes of the table as output."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import TYPE_CHECKING

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

if TYPE_CHECKING:
    import pandas as pd

#: The state store that keyed state with timers needs.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Groups that keys are dealt over. A group is one state: what Spark and Python say to each other grows with groups, not with keys.
GROUPS = 1024
#: Rows in one entry of a state.
CHUNK = 10_000
STATE = T.StructType([T.StructField("least", T.LongType()), T.StructField("rows", T.BinaryType())])
OUT = T.StructType([T.StructField("key", T.StringType()), T.StructField("order", T.LongType()), T.StructField("change", T.StringType()), T.StructField("row", T.StringType())])
WAITING, RECORDS = ("at", "order", "key", "command", "row"), ("order", "key", "row")


# Spark starts such an operator once in a process that gets none of the files added to a session.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _packed(rows: list[tuple], names: tuple[str, ...]) -> list[tuple[int, bytes]]:
    """``rows`` as entries of a state: the least first field, and the rows in Arrow's format."""
    import pyarrow as pa

    types, entries = {"at": pa.int64(), "order": pa.int64()}, []
    for i in range(0, len(rows), CHUNK):
        part = rows[i : i + CHUNK]
        batch = pa.record_batch([pa.array(c, types.get(n, pa.string())) for n, c in zip(names, zip(*part, strict=True), strict=True)], names)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema) as writer:
            writer.write_batch(batch)
        entries.append((min(r[0] for r in part), sink.getvalue().to_pybytes()))
    return entries


def _unpacked(entry: bytes) -> Iterator[tuple]:
    import pyarrow as pa

    return zip(*(c.to_pylist() for c in pa.ipc.open_stream(entry).read_all().columns), strict=True)


class CommandFold(StatefulProcessor):
    """State of a group of keys: commands that wait for the watermark, and the records that the inserts of each key have left.

    A command is applied once the watermark has passed its time, so commands of one key are applied by time, then order,
    however they arrive. ``insert`` adds a record, ``delete`` takes all of the key's records back; any other command
    changes nothing and is answered by a row with the change ``error``. What waits longer is not unpacked, and records
    are only read where a key of the group has a delete.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", STATE)
        self.records = handle.getListState("records", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first = None
        for batch in rows:
            batch = batch[batch["command"].notna()]  # the others only have a time
            come = [(int(a), int(o), k, c, r) for a, o, k, c, r in zip(*(batch[n] for n in WAITING), strict=True)]
            if come:
                entries = _packed(come, WAITING)
                self.waiting.appendList(entries)
                first = min(least for least, _ in entries) if first is None else min(first, *(least for least, _ in entries))
        if first is not None:
            self.handle.registerTimer(first)  # it sets the next one when it is through
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        import pandas as pd

        until = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        waiting = list(self.waiting.get()) if self.waiting.exists() else []
        later, open_now = [e for e in waiting if e[0] > until], [r for least, entry in waiting if least <= until for r in _unpacked(entry)]
        if not open_now:
            return
        later += _packed([r for r in open_now if r[0] > until], WAITING)
        due = sorted({(r[2], r[1]): r for r in open_now if r[0] <= until}.values(), key=lambda r: r[:2])
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(min(least for least, _ in later))
        else:
            self.waiting.clear()
        again = any(r[3] == "delete" for r in due)
        held: dict = {}
        if again and self.records.exists():
            for _, entry in self.records.get():
                for order, name, row in _unpacked(entry):
                    held.setdefault(name, []).append((order, row))
        changes = []
        for _, order, name, command, row in due:
            if command == "insert":
                held.setdefault(name, []).append((order, row))
                changes.append((name, order, "insert", row))
            elif command == "delete":
                changes += [(name, o, "delete", r) for o, r in held.pop(name, ())]
            else:
                changes.append((name, order, "error", row))
        left = _packed([(order, name, row) for name, own in held.items() for order, row in own], RECORDS)
        if not again:
            if left:
                self.records.appendList(left)
        elif left:
            self.records.put(left)
        else:
            self.records.clear()
        yield pd.DataFrame(changes, columns=OUT.fieldNames(), dtype=object)  # as Arrow's own strings may come in chunks

    def close(self) -> None:
        pass


def fold_commands(log: DataFrame, time: str, delay: str, order: str, key: str, command: str, groups: int = GROUPS) -> DataFrame:
    """(key, order, change, row) of a stream of commands, for append output: each insert, and each record that a delete takes back.

    ``order`` is a unique whole number, ``command`` a column of names. A row whose command is null is left out; one without
    order and command is a heartbeat, whose time moves the watermark and does nothing else. A change comes out once the watermark, ``delay`` behind the latest time, has passed
    its command. Rows later than the watermark are dropped by Spark, which counts them in ``numRowsDroppedByWatermark``;
    rows with a null time are dropped too. A row is kept as JSON. Null keys are a key of their own. Of commands that wait with the same order one is applied.

    Keys are dealt over ``groups`` by a hash; what waits in one, and with a delete its records, is in a task's memory at
    once. The session must use ``PROVIDER`` as its state store. State and watermark are in the checkpoint, so a query that is
    started again, with as many groups, goes on where it stopped.
    """
    # Spark moves filters below the watermark, so this one must let heartbeats through.
    marked = log.where(F.col(time).isNotNull() & (F.col(command).isNotNull() | F.col(order).isNull())).withWatermark(time, delay)
    name, number = F.col(key).cast("string"), F.col(order).cast("long")  # with a null among them, pandas would make numbers floating ones
    rows = marked.select(F.pmod(F.xxhash64(name), F.lit(groups)).cast("int").alias("group"), name.alias("key"), F.coalesce(number, F.lit(0)).alias("order"), F.unix_millis(time).alias("at"), F.when(number.isNotNull(), F.col(command)).alias("command"), F.to_json(F.struct(*log.columns)).alias("row"), F.col(time).alias("_time"))
    return rows.groupBy("group").transformWithStateInPandas(CommandFold(), OUT, "Append", "EventTime")


def table_of(changes: DataFrame) -> DataFrame:
    """(key, order, row) of the records that inserts have left and no delete has taken back."""
    sign = F.when(F.col("change") == "insert", 1).when(F.col("change") == "delete", -1).otherwise(0)
    return changes.groupBy("key", "order", "row").agg(F.sum(sign).alias("n")).where("n > 0").drop("n")


def stateful_session(spark: SparkSession) -> SparkSession:
    """A session of the same application that keeps state where keyed state with timers can be kept; the caller's stays as it is.

    Each partition of such state is a store of its own that every batch opens and commits, however little it holds, so
    there are at most two for each core.
    """
    other = spark.newSession()
    other.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    other.conf.set("spark.sql.shuffle.partitions", min(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism))
    other.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return other
