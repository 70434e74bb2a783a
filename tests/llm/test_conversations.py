import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from rosterspark.llm import conversation_repair as repair
from rosterspark.llm import queries

BLANK = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string"


def damaged(rows):
    out, names = {}, {r[0] for r in rows}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if code == 0:
            continue
        text = {1: "", 2: text.translate({ord(c): None for c in ".!?"})}.get(code, text)
        out.setdefault(conv, []).extend([(turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1))
    return {c: sorted(out.get(c, []), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c in names}


def faults(turns):
    seen, out = set(), []
    for _, role, text in turns:
        shown = text.strip(BLANK)
        out.append("blank" if not shown else "duplicate" if (role, text) in seen else "" if shown[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def every_repair(turns, found):
    """All (cost, audit, written) that give a whole conversation, with up to two inserts in each place."""
    grammar = {"": "su", "s": "u", "u": "a", "a": "u"}

    def go(i, last, cost, audit, written, inserts):
        if i == len(turns) and last in ("", "a"):
            yield cost, audit, written
        for role in ("user", "assistant"):
            if inserts < 2 and role[0] in grammar[last]:
                yield from go(i, role[0], cost + 3, audit + "I", [*written, f"{role}:"], inserts + 1)
        if i == len(turns):
            return
        _, role, text = turns[i]
        yield from go(i + 1, last, cost + 4, audit + "D", written, 0)
        if found[i] in ("blank", "duplicate"):
            return
        more = 3 if found[i] == "truncated" else 0
        if role and role[0] in grammar[last]:
            yield from go(i + 1, role[0], cost + more, audit + "K", [*written, f"{role}:{text}"], 0)
        for other in ("user", "assistant"):
            if other[0] in grammar[last]:
                yield from go(i + 1, other[0], cost + 3 + more, audit + "R", [*written, f"{other}:{text}"], 0)

    return go(0, "", 0, "", [], 0)


def brute(conv, turns):
    found = faults(turns)
    cost, audit, written = min(every_repair(turns, found), key=lambda r: r[:2])
    numbers = [t for t, _, _ in turns if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    initials = [r[:1] for _, r, _ in turns]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return conv, gaps, *(found.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(written).encode()).hexdigest()


def made_up(seed, convs, most):
    pick = random.Random(seed)
    texts = ["Yes.", "No!", "So?", "cut off", "", " \t", None, "é漢 end.", "Yes.", "x" * 500 + "."]
    roles = ["user", "assistant", "system", "user", "assistant", None, "", "tool"]
    return [(c if c else None, pick.choice([None, t, t, t, t, 3]), pick.choice(roles), pick.choice(texts)) for c in range(convs) for t in range(pick.randint(1, most))]


def rows_of(found):
    return sorted(map(tuple, found.select("conv_id", *repair.COUNTS, "audit", "repaired_sha256").collect()), key=repr)


def test_repair_equals_every_repair(spark):
    rows = made_up(1, 300, 6)
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("extra") for c in ("gone", "seen", "part", "place", "copy", "code", "audit", "a.b") if c != "gone"})
    found = rows_of(repair.repair(repair.damage(docs)))
    assert found == sorted((brute(c, t) for c, t in damaged(rows).items()), key=repr)
    assert len({f[7] for f in found}) > 50


def test_repaired_turns_have_the_digest(spark):
    docs = repair.damage(spark.createDataFrame(made_up(2, 200, 8), SCHEMA))
    audits = repair.repair(docs)
    digests = {r.conv_id: r.repaired_sha256 for r in audits.collect()}
    turns = {}
    for r in sorted(repair.repaired(docs, audits).collect(), key=lambda r: (repr(r.conv_id), r.place)):
        turns.setdefault(r.conv_id, []).append(r)
    for conv, digest in digests.items():
        own = turns.get(conv, [])
        assert [r.place for r in own] == list(range(len(own)))
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in own).encode()).hexdigest() == digest
        letters = "".join(r.role[0] for r in own)
        assert letters.removeprefix("s") == "ua" * (len(letters.removeprefix("s")) // 2) and letters != "s"


@pytest.mark.parametrize("roles", [["system"], ["user"], ["assistant"], ["user", "assistant"], ["tool", "user"], ["system", "assistant", "assistant"]])
def test_long_conversations(roles):
    """What is set aside changes no result: compared with a pass that carries whole audit strings."""
    pick = random.Random(len(roles))
    ways, whole = repair.Forward(), repair.Forward()
    whole._set_aside = lambda: None
    for i in range(3000):
        turn = pick.choice(roles), f"turn {i}", pick.random() < 0.1, pick.random() < 0.3
        ways.turn(*turn)
        whole.turn(*turn)
    assert ways.end() == whole.end() and max(len(w.audit) for w in ways.ways if w) <= repair.CARRIED + 3
    assert len(ways.end()[1]) >= 3000


def test_hot_conversation_and_small_tables(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}.") for t in range(20_000)] + [(2, 0, "user", None), (3, 2**63 - 1, "user", "A."), (3, -(2**63), "user", "B.")]
    found = {r.conv_id: r for r in repair.repair(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found[1].audit == "K" * 20_000 and found[1].cost == 0 and found[2].audit == "D" and found[2].blank == 1
    assert found[3].gaps == 2**63 - 1
    assert repair.repair(spark.createDataFrame([], SCHEMA)).isEmpty()
    gone = repair.repair(spark.createDataFrame([("a", 1, "user", "x", True)], "conv_id string, turn int, role string, text string, gone boolean"))
    assert list(gone.first()) == ["a", 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()]


@pytest.mark.parametrize("seed", [None, 5])
def test_repair_sql(spark, tmp_path, seed):
    source = "/root/testdata/sf0.001" if seed is None else str(tmp_path)
    if seed is not None:
        spark.createDataFrame([r for r in made_up(seed, 80, 6) if r[2] != ""], SCHEMA).coalesce(1).write.parquet(f"{source}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{source}/conversations.parquet{'' if seed is None else '/*.parquet'}'")
    wanted = con.execute(queries.ORACLE_SQL["op13_conversation_repair"])
    names = [d[0] for d in wanted.description]
    rows = queries.op13_conversation_repair(spark, source).select(*names).collect()
    assert rows and sorted(map(tuple, rows), key=repr) == sorted(wanted.fetchall(), key=repr)
