import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from rosterspark.schema import FIELDS, RECORD
from rosterspark.sinks import files
from rosterspark.sources import backup_format, text

LINES = ["Ann Lee, 010, a@b.c, 31, 3, x ", " 김철수 ,011,,+7,-1,", "a,b,c,1_0,2,e, more, fields", "é, , , 0, 0, " + "z" * 300]


@pytest.fixture(scope="module")
def own(spark):
    backup_format.register(spark)
    return spark


@pytest.mark.parametrize("block", [1, 7, 40, 100, 1 << 20])
@pytest.mark.parametrize("end", ["", "\n", "\r\n"])
def test_blocks_equal_the_text_reader(own, tmp_path, block, end):
    """Every line once, wherever blocks end; two files in the order of their names, a hidden one left out."""
    join = "\r\n" if end == "\r\n" else "\n"
    for name in ("part-0", "part-1", "_hidden"):
        (tmp_path / name).write_bytes((join.join(LINES) + end).encode())
    (tmp_path / "part-2").write_bytes(b"")
    found = own.read.format("roster").option("blockBytes", block).load(str(tmp_path))
    wanted = text.load_backup(own, str(tmp_path))
    assert found.schema == RECORD and found.columns == wanted.columns
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, wanted.collect())) and found.count() == 8
    if block == 40:
        assert found.rdd.getNumPartitions() > 8


def test_bad_lines(own, tmp_path):
    bad = ["a,b", "", "a,b,c,x,1,e", "a,b,c,1,99999999999,e", "a,b,c,,1,e", "a,b,c,٣,1,e"]
    (tmp_path / "part-0").write_text("\n".join([LINES[0], *bad, LINES[1]]))
    with pytest.raises(PySparkException, match="too few fields|not an integer"):
        own.read.format("roster").load(str(tmp_path)).collect()
    kept = own.read.format("roster").schema(RECORD.simpleString()[7:-1].replace(":", " ").replace(",", ", ") + ", rejected string").load(str(tmp_path)).collect()
    assert [r.rejected for r in kept if r.rejected is not None] == bad and sum(r.name is not None for r in kept) == 2
    assert own.read.format("roster").load(f"file://{tmp_path}/none").count() == 0


def records(spark, n, start=0):
    return spark.range(start, start + n).select(F.concat(F.lit("n"), "id").alias("name"), F.lit(None).cast("string").alias("phone"), F.lit("").alias("email"), F.col("id").cast("int").alias("age"), F.lit(1.0).alias("grade"), F.lit("e").alias("etc"), F.lit("extra").alias("other"))


def test_writer_publishes_finished_jobs_only(own, tmp_path):
    path = f"{tmp_path}/backup"
    records(own, 100).repartition(5).write.format("roster").mode("append").save(path)
    records(own, 50, 100).write.format("roster").mode("append").save(f"file://{path}")
    read = lambda: sorted(r.age for r in own.read.format("roster").load(path).collect())
    assert read() == list(range(150)) and text.load_backup(own, path).count() == 150
    broken = records(own, 40).repartition(4).withColumn("age", F.when(F.col("age") == 33, F.raise_error(F.lit("lost")).cast("int")).otherwise(F.col("age")))
    for mode in ("overwrite", "append"):
        with pytest.raises(PySparkException):
            broken.write.format("roster").mode(mode).save(path)
        assert read() == list(range(150))
    records(own, 0).write.format("roster").mode("overwrite").save(path)
    assert read() == list(range(150))
    records(own, 3).write.format("roster").mode("overwrite").save(path)
    assert read() == [0, 1, 2] and all(n.startswith("part-") for n in os.listdir(path))
    records(own, 0).write.format("roster").mode("overwrite").option("keepIfEmpty", "false").save(path)
    assert read() == []
    with pytest.raises(PySparkException, match="a record has no etc"):
        records(own, 1).drop("etc").write.format("roster").mode("append").save(path)


@pytest.mark.parametrize("save", [files.save_backup, files.save_csv])
def test_interrupted_saves_keep_the_old_folder(spark, tmp_path, save):
    path = f"{tmp_path}/saved"
    load = text.load_backup if save is files.save_backup else text.load_delimited
    assert save(records(spark, 5).select(*FIELDS), path)
    broken = records(spark, 9).select(*FIELDS).withColumn("etc", F.when(F.col("age") == 7, F.raise_error(F.lit("lost"))).otherwise(F.col("etc")))
    with pytest.raises(PySparkException):
        save(broken, path)
    assert sorted(r.age for r in load(spark, path).collect()) == list(range(5)) and os.listdir(tmp_path) == ["saved"]
    again = load(spark, path)
    assert save(again.union(again), path) and load(spark, path).count() == 10 and os.listdir(tmp_path) == ["saved"]
