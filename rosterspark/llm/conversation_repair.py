"""Structure repair of conversations by a forward Viterbi pass over four grammar states.

A repaired conversation is empty, or an optional system turn and then pairs of user and assistant turns. A state says
what has been written last: nothing, the system, the user or the assistant. For each state the pass carries the cheapest
way to reach it as (cost, audit string), ties broken by the audit string, and the running digest of what that way has
written. Each turn may be kept, given another role or deleted; then the layer is closed by insert transitions, two at
most, as a third would lead back to a state that was cheaper before.

Turns are dealt by conversation and sorted, and stream through a task: it holds four states, never a conversation. A digest
of a whole conversation is one running hash, so the turns of one conversation pass one task, whatever their number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: States of the grammar, and the state after a user's or an assistant's turn by the state before.
START, SYSTEM, USER, ASSISTANT = range(4)
AFTER_USER, AFTER_ASSISTANT = {START: USER, SYSTEM: USER, ASSISTANT: USER}, {USER: ASSISTANT}
AFTER = {"s": {START: SYSTEM}, "u": AFTER_USER, "a": AFTER_ASSISTANT}
#: Costs, and the longest audit string that a state carries before what is settled is set aside.
REROLE, DELETE, INSERT, TRUNCATED, CARRIED = 3, 4, 3, 3, 256
BLANKS, STOPS = " \t\n\v\f\r", (".", "!", "?")
PAIRS = {"su", "ua", "au"}
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


class Way(NamedTuple):
    """The cheapest way to a state: ``audit`` is its end, after a digit that orders what ``before`` holds of it."""

    cost: int
    audit: str
    before: tuple | None
    digest: Any


class Forward:
    """The pass over the turns of one conversation."""

    def __init__(self) -> None:
        self.ways: list[Way | None] = [Way(0, "0", None, hashlib.sha256()), None, None, None]
        self._close()

    def _close(self) -> None:
        """Inserts of a turn without text, two at most."""
        for _ in range(2):
            layer = list(self.ways)
            for role, after in (("user", AFTER_USER), ("assistant", AFTER_ASSISTANT)):
                for a, b in after.items():
                    if layer[a] is not None:
                        self._offer(self.ways, layer[a], a, b, INSERT, "I", f"{role}:")

    @staticmethod
    def _offer(layer: list[Way | None], way: Way, a: int, b: int, cost: int, letter: str, written: str | None) -> None:
        """Take the step from state ``a`` to ``b`` if it is the best to reach ``b``."""
        cost, audit = way.cost + cost, way.audit + letter
        if layer[b] is not None and (layer[b].cost, layer[b].audit) <= (cost, audit):
            return
        digest = way.digest
        if written is not None:
            digest = digest.copy()
            digest.update((written if a == START else f"\n{written}").encode())
        layer[b] = Way(cost, audit, way.before, digest)

    def turn(self, role: str, text: str, must_go: bool, truncated: bool) -> None:
        layer: list[Way | None] = [None] * 4
        more = TRUNCATED if truncated else 0
        keep = AFTER.get(role[:1], {})
        for a, way in enumerate(self.ways):
            if way is None:
                continue
            self._offer(layer, way, a, a, DELETE, "D", None)
            if must_go:
                continue
            if a in keep:
                self._offer(layer, way, a, keep[a], more, "K", f"{role}:{text}")
            for name, after in (("user", AFTER_USER), ("assistant", AFTER_ASSISTANT)):
                if a in after:
                    self._offer(layer, way, a, after[a], REROLE + more, "R", f"{name}:{text}")
        self.ways = layer
        self._close()
        if max(len(w.audit) for w in self.ways if w) > CARRIED:
            self._set_aside()

    def _set_aside(self) -> None:
        """Keep long audit strings in links. Ways of equal cost never are one the beginning of the other, but others may
        be, by inserts at the end alone: those stay with the state, and a digit orders the rest."""
        settled = [w and w.audit.rstrip("I") for w in self.ways]
        ranks = {s: str(i) for i, s in enumerate(sorted({s for s in settled if s}))}
        links = {s: (next(w.before for w, t in zip(self.ways, settled, strict=True) if t == s), s[1:]) for s in ranks}
        self.ways = [w and Way(w.cost, ranks[s] + w.audit[len(s) :], links[s], w.digest) for w, s in zip(self.ways, settled, strict=True)]

    def end(self) -> tuple[int, str, str]:
        """Cost, audit and digest of the cheapest way that ends empty or with the assistant."""
        best = min((w for w in (self.ways[START], self.ways[ASSISTANT]) if w), key=lambda w: (w.cost, w.audit))
        parts, link = [best.audit[1:]], best.before
        while link:
            link, part = link
            parts.append(part)
        return best.cost, "".join(reversed(parts)), best.digest.hexdigest()


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and gone: ``rows`` damaged by the checksum of ``conv_id:turn`` modulo 20.

    0 drops a turn (``gone``; it only says that the conversation was there), 1 empties its text, 2 takes its stops, 3
    repeats it, 4 makes its role ``user``. Nulls count as one blank; a null id or turn stays one for grouping and order.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    coded = rows.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), code.cast("int").alias("code"))
    text = F.when(F.col("code") <= 1, "").when(F.col("code") == 2, F.translate("text", "".join(STOPS), "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("code") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    damaged = coded.select("conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("code") == 0).alias("gone"), copies.alias("copy"))
    return damaged.drop("copy")


def _ordered(rows: DataFrame) -> DataFrame:
    """Turns by conversation in order, with ``seen``: whether an earlier turn has this role and text. One shuffle."""
    gone = F.col("gone") if "gone" in rows.columns else F.lit(False)
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    turns = rows.select(F.col("conv_id").cast("string").alias("conv_id"), F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"), gone.alias("gone")).repartition("conv_id")
    same = Window.partitionBy("conv_id", "gone", "role", F.sha2("text", 256)).orderBy(F.col("turn").asc_nulls_first())
    marked = turns.withColumn("seen", F.row_number().over(same) > 1)
    return marked.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(b.column(i).to_pylist() for i in range(b.num_columns)), strict=True)


def _repaired(turns: Iterator[tuple]) -> tuple:
    """Counts, cost, audit and digest of one conversation, its turns in order."""
    found = dict.fromkeys(COUNTS, 0)
    way, low, high, distinct, before = Forward(), None, None, 0, None
    for _, turn, role, text, gone, seen in turns:
        if gone:
            continue
        if turn is not None and turn != high:
            low, high, distinct = turn if low is None else low, turn, distinct + 1
        stripped = text.rstrip(BLANKS)
        fault = "blank" if not stripped else "duplicate" if seen else "" if stripped.endswith(STOPS) else "truncated"
        if fault:
            found[fault] += 1
        if before is not None and before + role[:1] not in PAIRS:
            found["illegal"] += 1
        before = role[:1]
        way.turn(role, text, fault in ("blank", "duplicate"), fault == "truncated")
    cost, audit, digest = way.end()
    found |= {"cost": cost, "gaps": min(high - low + 1 - distinct, (1 << 63) - 1) if distinct else 0}
    return *(found[c] for c in COUNTS), audit, digest


def repair(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of each conversation.

    ``rows(conv_id, turn, role, text)`` has a turn a row; a boolean column ``gone`` marks rows that only name their
    conversation. Turns are taken by ``turn``, nulls first, and those of one ``turn`` by role and text. The audit has the
    first letters of Keep, Rerole, Delete and Insert in order; ``repaired`` turns those letters into turns again.

    A null role or text counts as one blank, so such a text is blank; null ids are one conversation; null turns count
    for no gap. A role without a letter fits nowhere unless it is changed. Repeated rows are duplicates. A text of any
    length is hashed as it comes. Other columns are ignored. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = []
        for conv, turns in groupby(_turns(batches), lambda t: t[0]):
            made.append((conv, *_repaired(turns)))
            if len(made) == 4096:
                yield batch(made)
                made = []
        if made:
            yield batch(made)

    def batch(made: list[tuple]) -> pa.RecordBatch:
        types = [pa.string(), *[pa.int64()] * len(COUNTS), pa.string(), pa.string()]
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*made, strict=True), types, strict=True)], names=["conv_id", *COUNTS, "audit", "repaired_sha256"])

    found = _ordered(rows).mapInArrow(run, f"conv_id string, {', '.join(f'{c} long' for c in COUNTS)}, audit string, repaired_sha256 string")
    return found.withColumn("conv_id", F.col("conv_id").cast(rows.schema["conv_id"].dataType))


def repaired(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """conv_id, place, role, text and edit: the turns that the ``audits`` of ``repair`` leave of ``rows``, in order of ``place``.

    ``edit`` is K, R or I. Audits and turns stream through a task side by side, each conversation's audit first. Rows
    are treated as in ``repair``; conversations without an audit, and those that end empty, give no row.
    """
    gone = F.col("gone") if "gone" in rows.columns else F.lit(False)
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    turns = rows.where(~gone).select("conv_id", F.lit(1).alias("part"), F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"))
    first = audits.select("conv_id", F.lit(0).alias("part"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"))
    both = first.union(turns).repartition("conv_id").sortWithinPartitions("conv_id", "part", F.col("turn").asc_nulls_first(), "role", "text")
    text_ids = both.select(F.col("conv_id").cast("string").alias("conv_id"), "part", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple] = []
        for conv, rows in groupby(_turns(batches), lambda t: t[0]):
            letters, last, place = None, "", 0
            for _, part, role, text in rows:
                if part == 0:
                    letters = iter(text)
                    continue
                for letter in letters or ():
                    if letter != "D":
                        other = "assistant" if last == "u" else "user"
                        written = (role, text) if letter == "K" else (other, text if letter == "R" else "")
                        made.append((conv, place, *written, letter))
                        last, place = written[0][:1], place + 1
                    if letter != "I":
                        break
                if len(made) >= 1024:
                    yield batch(made)
                    made = []
            for _ in letters or ():  # inserts after the last turn
                other = "assistant" if last == "u" else "user"
                made.append((conv, place, other, "", "I"))
                last, place = other[:1], place + 1
        if made:
            yield batch(made)

    def batch(made: list[tuple]) -> pa.RecordBatch:
        types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*made, strict=True), types, strict=True)], names=["conv_id", "place", "role", "text", "edit"])

    found = text_ids.mapInArrow(run, "conv_id string, place long, role string, text string, edit string")
    return found.withColumn("conv_id", F.col("conv_id").cast(rows.schema["conv_id"].dataType))
