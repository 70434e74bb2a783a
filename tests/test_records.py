import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rosterspark.functions import checks, sequences, text
from rosterspark.operators import table
from rosterspark.plans.session import answered, command, replay
from rosterspark.schema import FIELDS, RECORD
from rosterspark.sinks import files
from rosterspark.sources import text as sources
from rosterspark.streaming.session import last_deletes

ROWS = [("홍길동", "010-1234", "h@x.kr", 20, 3, "kind"), ("Ann Lee ", "0044", "", 7, 0, ""), ("홍길동", "010-1234", "h@x.kr", 20, 3, "kind"), ("a-name-over-width", "012345678901234567", "long-address@example.org", 130, 9, "-")]


def column(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.select("i", expression(F.col("v")).alias("out")).orderBy("i").select("out").collect()]


@pytest.fixture(scope="module")
def records(spark):
    return spark.createDataFrame(ROWS, RECORD)


def test_strip_removes_all_white_space(spark):
    assert column(spark, ["\t x \n", "　a ", "b c", "", None], text.strip) == ["x", "a", "b c", "", None]


def test_parse_integer_reads_what_python_reads(spark):
    values = [" 30 ", "+3", "-4", "1_000", "3.5", "", "1__0", "_1", "1_", "x", "99999999999", None, "9" * 60]
    expected = [30, 3, -4, 1000, None, None, None, None, None, None, 99999999999, None, None]
    assert [None if v is None else int(v) for v in column(spark, values, text.parse_integer)] == expected


def test_strict_integer_fails(spark):
    with pytest.raises(Exception, match="not an integer"):
        column(spark, ["1", "x"], text.strict_integer)


def test_strip_takes_what_python_strips(spark):
    blanks = [chr(i) for i in range(0x11000) if not 0xD800 <= i < 0xE000 and chr(i).isspace()]
    assert column(spark, [f"{c}x{c}y{c}{c}" for c in blanks], text.strip) == [f"x{c}y" for c in blanks] and len(blanks) > 25


def test_parse_or_default_takes_integers_of_any_size(spark):
    nines = "9" * 40
    cases = {nines: 5, f"-{nines}": 1, f" +{nines} ": 5, "0" * 50 + "3": 3, "-" + "0" * 50 + "3": 1, "9_9" * 20: 5, "9" * 38: 5, "1" + "0" * 37: 5, f"{nines}x": 1, f"{nines}.5": 1, "_" + nines: 1}
    assert column(spark, list(cases), checks.parse_or_default) == list(cases.values())


def test_unknown_commands_are_error_rows(spark):
    log = spark.createDataFrame([(1, "4", "x"), (2, " 4", "x"), (3, None, "x"), (4, "", "x"), (5, "9", "x"), (5, "9", "x")], "seq int, command string, error string")
    rows = answered(log, "command").orderBy("seq").collect()
    assert [(r.operator, r._error) for r in rows] == [("find", None), (None, "no such command:  4"), (None, "no such command: null"), (None, "no such command: "), ("save_backup", None), ("save_backup", None)]
    assert answered(log.limit(0), "command").isEmpty()


def test_parse_or_default_clamps_before_narrowing(spark):
    assert column(spark, ["0", "-3", "3", "9", "99999999999", "x", None, "2.5"], checks.parse_or_default) == [1, 1, 3, 5, 5, 1, 1, 1]


def test_ranges_and_patterns(spark):
    assert column(spark, [0, 130, -1, 131, None], lambda c: checks.in_range(c, 0, 130), "int") == [True, True, False, False, False]
    assert column(spark, ["ab홍길", "홍a길", "홍길동", "", None], lambda c: checks.matches(c, checks.NAME_PATTERN)) == [True, False, True, False, False]
    assert column(spark, [0, 3, 9, None], lambda c: checks.clamp(c, 1, 5), "int") == [1, 3, 5, 1]


def test_validation_splits_rows(spark):
    raw = spark.createDataFrame([("홍길동", "1", "e", " 20 ", "9", "z"), ("Ann", "1", "e", "20", "1", "z"), ("홍길동", "1", "e", "131", "1", "z"), ("홍길동", "1", "e", "x", "1", "z"), (None, None, None, None, None, None)], "name string, phone string, email string, age string, grade string, etc string")
    accepted, rejected = checks.split_valid(raw)
    assert [tuple(r) for r in accepted.collect()] == [("홍길동", "1", "e", 20, 5, "z")]
    assert sorted(r.reason for r in rejected.collect()) == ["age", "age", "name", "name"]


def test_answers_and_defaults(spark):
    assert column(spark, ["y", "Y", "n", " y", "", None], text.is_yes) == [True, True, False, False, False, False]
    assert column(spark, ["", "a", None], lambda c: text.or_default(c, "d")) == ["d", "a", "d"]


def test_rendering_pads_and_never_cuts(records):
    lines = [r.line for r in files.rendered(records).collect()]
    assert lines == ["{:>5}\t{:3}\t{:13}\t{:10}\t{:3}\t{}".format("*" * g, n, p, e, a, x) for n, p, e, a, g, x in ROWS]
    numbered = records.withColumn("at", F.monotonically_increasing_id())
    whole = files.render_table(numbered, 3, "at").split("\n")
    assert len(whole) == 5 + 3 + 1 and whole[0] == whole[-1] == "=" * 70 and whole[1].strip() == "RECORDS"
    assert files.report(records.limit(0).withColumn("at", F.lit(1)), "at").count() == 6


def test_centre(spark):
    assert column(spark, ["abc", "", "abcdefgh"], lambda c: text.centre(c, 6)) == ["{:^6}".format(v) for v in ("abc", "", "abcdefgh")]


def test_backup_round_trip(spark, records, tmp_path):
    assert files.save_backup(records, f"{tmp_path}/b")
    assert sorted(map(tuple, sources.load_backup(spark, f"{tmp_path}/b").collect())) == sorted(ROWS)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.text("abc 가", max_size=5), st.text("01", max_size=4), st.integers(-5, 200), st.integers(-3, 9)), min_size=1, max_size=8))
def test_lines_without_commas_survive(spark, rows):
    made = [(n, p, "e", a, g, "x") for n, p, a, g in rows]
    back = sources.decode_lines(files.lines_of(spark.createDataFrame(made, RECORD)))
    assert sorted(map(tuple, back.collect())) == sorted(made)


def test_commas_cut_what_follows(spark):
    lines = spark.createDataFrame([("홍길동 , 010, e@e, 20, 3, a, b, c",)], "value string")
    assert tuple(sources.decode_lines(lines).first()) == ("홍길동 ", "010", "e@e", 20, 3, "a")


@pytest.mark.parametrize("bad", ["a,b,c", "", "a,b,c,x,1,z", "a,b,c,1,2.5,z"])
def test_bad_lines(spark, bad):
    lines = spark.createDataFrame([("n,1,e,5,1,z",), (bad,)], "value string")
    with pytest.raises(Exception, match="too few fields|not an integer"):
        sources.decode_lines(lines).collect()
    with pytest.raises(Exception, match="too few fields|not an integer"):
        sources.decode_lines(lines).count()
    rows = sources.decode_lines(lines, permissive=True).collect()
    assert sorted((r.rejected is None, r.age) for r in rows) == [(False, None), (True, 5)]


def test_ordered_backup(spark, tmp_path):
    (tmp_path / "b.txt").write_text("a, 1, e, 5, 1, x \nb, 1, e, 5, 1, x ")
    assert [(r.seq, r.name) for r in sources.load_backup_ordered(spark, f"{tmp_path}/b.txt").orderBy("seq").collect()] == [(0, "a"), (1, "b")]


def test_ordered_backup_in_blocks(spark, tmp_path):
    for k, n in enumerate((700, 0, 1300)):
        (tmp_path / f"{k}.txt").write_text("".join(f"n{k}-{i}, 1, e, {i % 100}, 1, x \n" for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = sources.load_backup_ordered(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    expected = [f"n{k}-{i}" for k, n in enumerate((700, 0, 1300)) for i in range(n)]
    assert [r.name for r in sorted(rows, key=lambda r: r.seq)] == expected and sorted(r.seq for r in rows) == list(range(2000))


def test_missing_backup_is_empty(spark, tmp_path):
    rows = sources.load_backup(spark, f"{tmp_path}/none")
    assert rows.isEmpty() and rows.columns == FIELDS


def test_csv_keeps_everything(spark, tmp_path):
    rows = [("a, b", ' "q" ', "#x", 1, 2, "line\nnext"), ("", "007", " pad ", -1, 0, "e")]
    records = spark.createDataFrame(rows, RECORD)
    assert files.save_csv(records, f"{tmp_path}/c")
    back = [tuple("" if v is None else v for v in r) for r in sources.load_delimited(spark, f"{tmp_path}/c").collect()]
    assert sorted(back) == sorted(rows)


def test_empty_tables_leave_old_files(spark, records, tmp_path):
    for save, load in ((files.save_csv, lambda p: sources.load_delimited(spark, p)), (files.save_backup, lambda p: sources.load_backup(spark, p))):
        path = f"{tmp_path}/{save.__name__}"
        assert save(records, path)
        assert not save(records.limit(0), path) and load(path).count() == len(ROWS)
        assert save(records.limit(0), path, keep_if_empty=False) and load(path).count() == 0


def test_other_formats(spark, tmp_path):
    (tmp_path / "p.csv").write_text("Name|Age|Birth\n#x|1|2000-01-01\nAnn|3|2001-02-03\nBob|4\n")
    rows = sources.load_delimited(spark, f"{tmp_path}/p.csv", "name string, age int, birth date, bad string", sep="|", comment="#", corrupt="bad").collect()
    assert [(r.name, r.age, str(r.birth), r.bad) for r in rows] == [("Ann", 3, "2001-02-03", None), ("Bob", 4, "None", "Bob|4")]
    (tmp_path / "j.json").write_text('[\n{"Name": "Ann", "Age": "3"},\n{"Name": "", "Age": ""}\n]')
    assert sources.load_json(spark, f"{tmp_path}/j.json", "Name string, Age string").count() == 2


def test_find_delete_and_nulls(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "A"), (4, "a"), (5, "a ")], "id int, name string")
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(table.find(rows, "name", "a")) == [1, 4] and ids(table.find(rows, "name", None)) == [2]
    assert ids(table.delete(rows, "name", "a")) == [2, 3, 5] and table.count_matches(rows, "name", "zz").first().n == 0
    assert table.find(table.delete(rows, "name", "a"), "name", "a").isEmpty()
    confirmed = spark.createDataFrame([(4,), (5,)], "id int")
    assert ids(table.delete_confirmed(rows, "name", "a", confirmed, "id")) == [1, 2, 3, 5]
    assert [(r.id, r.position) for r in table.positions(rows, "name", "a", "id").orderBy("id").collect()] == [(1, 0), (4, 3)]
    assert [(r.id, r.name, r.confirmed) for r in table.deleted(rows.withColumn("confirmed", F.lit("k")), "name", "a", confirmed, "id").collect()] == [(4, "a", "k")]
    assert table.insert(rows, rows).count() == 10
    new = spark.createDataFrame([("x", 9), ("y", 3)], "name string, at int")
    assert sorted((r.name, r.id) for r in table.insert_numbered(rows, new, "id", "at").where("name in ('x', 'y')").select("name", "id").collect()) == [("x", 7), ("y", 6)]
    assert [r.id for r in table.insert_numbered(rows.limit(0), new, "id", "at").orderBy("id").collect()] == [0, 1]


def test_clashing_names_keep_their_values(spark):
    names = ("_range", "_at", "_start", "range", "at", "start", "row", "rank", "position", "_key", "_last", "key", "last", "deleted", "reason")
    extra = {c: F.lit(f"my {c}") for c in names}
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "id int, name string").withColumns(extra)
    found = table.positions(rows, "name", "a", "id").collect()
    assert [(r.id, r["_position"]) for r in found] == [(1, 0), (3, 2)] and all(r[c] == f"my {c}" for r in found for c in names)
    kept = replay(rows, "id", "name", "true", "id = 2").collect()
    assert sorted(r.id for r in kept) == [1, 3] and all(r[c] == f"my {c}" for r in kept for c in names)
    raw = spark.createDataFrame([("홍길동", "20", "1"), ("Ann", "20", "1")], "name string, age string, grade string").withColumns(extra)
    good, bad = (x.collect() for x in checks.split_valid(raw))
    assert [r["_reason"] for r in bad] == ["name"] and all(r[c] == f"my {c}" for r in [*good, *bad] for c in names)


def test_sessions_end(spark):
    log = spark.createDataFrame([(1, "i", 7), (2, "i", 8), (3, "9", 0), (4, "d", 7), (5, "9", 0), (6, "i", 9)], "seq int, op string, key int")
    ends = lambda end: sorted(r.seq for r in replay(log, "seq", "key", "op = 'i'", "op = 'd'", end).collect())
    assert ends("op = '9'") == [1, 2] and ends(None) == [2, 6] and ends("op = 'none'") == [2, 6]


def test_replay_equals_a_fold(spark):
    log = [(1, "i", 7), (2, "d", 7), (3, "i", 7), (4, "i", 8), (5, "d", 9), (6, "i", 9), (7, "i", None), (8, "d", None), (9, "i", None)]
    kept: list = []
    for seq, op, key in log:
        kept = kept + [(seq, key)] if op == "i" else [k for k in kept if k[1] != key]
    rows = replay(spark.createDataFrame(log, "seq int, op string, key int"), "seq", "key", "op = 'i'", "op = 'd'")
    assert sorted((r.seq, r.key) for r in rows.collect()) == sorted(kept, key=lambda k: k[0])


def test_commands():
    assert command("4") is table.find
    with pytest.raises(KeyError, match="no such command"):
        command(" 4")


def test_streamed_deletes(spark, tmp_path):
    spark.createDataFrame([(1, "d", 7), (2, "i", 7), (5, "d", 7), (3, "d", 8)], "seq long, op string, key long").write.parquet(f"{tmp_path}/log")
    stream = spark.readStream.schema("seq long, op string, key long").parquet(f"{tmp_path}/log")
    query = last_deletes(stream, "seq", "key", "op = 'd'").writeStream.outputMode("complete").format("memory").queryName("deletes").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.table("deletes").collect())) == [(7, 5), (8, 3)]


@pytest.mark.parametrize("below", [-1, 0, 1, 2, 10, 200])
def test_fibonacci(spark, below):
    terms, a, b = [], 0, 1
    while a < below:
        terms.append(a)
        a, b = b, a + b
    assert [int(r.value) for r in sequences.fibonacci(spark, below).orderBy("n").collect()] == terms
    assert sequences.fibonacci_line(spark, below).first().line == "".join(f"{t} " for t in terms)


def test_sequences_by_row(spark):
    rows = spark.createDataFrame([(0,), (1,), (2,), (-7,), (14,), (None,)], "n int").select("n", sequences.fibonacci_below(F.col("n")).alias("terms"), sequences.fibonacci_text(F.col("n")).alias("line"), sequences.repeated(F.col("n"), ["x", "y"]).alias("lines")).collect()
    known = [0, 1, 1, 2, 3, 5, 8, 13, 21, 34, 55, 89]
    for r in rows:
        terms = [t for t in known if t < (100 if r.n is None else r.n)]
        assert [int(t) for t in r.terms] == terms and r.line == "".join(f"{t} " for t in terms) and r.lines == ["x", "y"] * max(r.n or 0, 0)
    assert spark.range(1).select(F.size(sequences.fibonacci_below(F.lit("9" * 38)))).first()[0] == 184


def test_fibonacci_ends_where_the_type_ends(spark):
    assert int(sequences.fibonacci(spark, 10**37 * 9).orderBy(F.desc("n")).first().value) == 78569350599398894027251472817058687522
    with pytest.raises(ValueError, match="do not fit"):
        sequences.fibonacci(spark, 10**39)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 3), max_size=6), st.integers(0, 4))
def test_safe_index(spark, values, item):
    rows = spark.createDataFrame([(values, item)], "a array<int>, x int")
    assert rows.select(sequences.safe_index(F.col("a"), F.col("x"))).first()[0] == (values.index(item) if item in values else -1)


def test_safe_index_text_and_lines(spark):
    assert column(spark, ["abcb", "", None], lambda c: sequences.safe_index_text(c, F.lit("b"))) == [1, -1, -1]
    assert column(spark, ["abc"], lambda c: sequences.safe_index_text(c, F.lit(""))) == [0]
    assert [r.line for r in sequences.repeat_lines(spark, 2).orderBy("seq").collect()] == ["Hello, Python", "Hello, World"] * 2
    assert sequences.repeat_lines(spark, 0).isEmpty()
