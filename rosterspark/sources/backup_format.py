"""Backups as a data source of their own: ``spark.read.format("roster")`` and ``df.write.format("roster")``.

Files are read in blocks, each a task of its own; a line belongs to the block in which it starts. Writers put their
lines into files beside the backup, and only the commit, once all tasks are through, makes them the backup: a job that
fails or is stopped leaves the old one as it was.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..functions.text import INTEGER
from ..schema import FIELDS, RECORD

#: Bytes of a block where the reader is told no other number, and rows of a batch.
BLOCK_BYTES, BATCH_ROWS = 64 << 20, 4096
NUMBERS = ("age", "grade")
#: Folders of files that are not, or no longer, the backup.
STAGED = "_staged-"


def place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path there."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def listing(files: fs.FileSystem, path: str) -> list[fs.FileInfo]:
    """A backup's files by name: the folder's own, or the file itself; none where there is nothing."""
    info = files.get_file_info(path)
    if info.type == fs.FileType.NotFound:
        return []
    if info.type == fs.FileType.File:
        return [info]
    found = files.get_file_info(fs.FileSelector(path))
    return sorted((f for f in found if f.type == fs.FileType.File and f.base_name[0] not in "._"), key=lambda f: f.path)


@dataclass
class Block(InputPartition):
    path: str
    start: int
    end: int


@dataclass
class Written(WriterCommitMessage):
    path: str | None
    rows: int


def lines_of_block(stream: pa.NativeFile, start: int, end: int, size: int = 1 << 20) -> Iterator[bytes]:
    """The lines that start in a block, without their ends; the one before its start is the block's before."""
    stream.seek(max(start - 1, 0))
    at, held, skip = max(start - 1, 0), b"", start > 0
    while at < end:
        if not (more := stream.read(size)):
            if held and not skip:
                yield held
            return
        *lines, held = (held + more).split(b"\n")
        for line in lines:
            if at >= end:
                return
            if not skip:
                yield line
            skip = False
            at += len(line) + 1


def decode(line: str, permissive: bool) -> tuple:
    """A record's fields; permissive, nulls and the line where it is none, else an error."""
    parts = line.split(",")
    fields = [parts[0], *(p.strip() for p in parts[1 : len(FIELDS)])]
    numbers = [fields[i] if len(fields) > i else "" for i, n in enumerate(FIELDS) if n in NUMBERS]
    wrong = "too few fields" if len(fields) < len(FIELDS) else "not an integer" if not all(re.fullmatch(INTEGER, n, re.A) and abs(int(n)) < 1 << 31 for n in numbers) else ""
    if wrong and not permissive:
        raise ValueError(f"{wrong}: {line}")
    if wrong:
        return *(None for _ in FIELDS), line
    return *(int(v) if n in NUMBERS else v for n, v in zip(FIELDS, fields, strict=True)), None


class BackupReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.path, self.block = options["path"], int(options.get("blockbytes", BLOCK_BYTES))
        self.permissive = "rejected" in schema.fieldNames()

    def partitions(self) -> list[Block]:
        files, path = place(self.path)
        blocks = [Block(f.path, at, min(at + self.block, f.size)) for f in listing(files, path) for at in range(0, f.size, self.block)]
        return blocks or [Block("", 0, 0)]

    def read(self, partition: Block) -> Iterator[tuple]:
        if not partition.path:
            return
        files, _ = place(self.path)
        with files.open_input_file(partition.path) as stream:
            for line in lines_of_block(stream, partition.start, partition.end):
                record = decode(line.removesuffix(b"\r").decode(errors="replace"), self.permissive)
                yield record if self.permissive else record[:-1]


class BackupWriter(DataSourceWriter):
    """Each task writes a file of its own attempt below a folder of this job; the commit moves the finished ones."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.keep_if_empty = options.get("keepifempty", "true").lower() == "true"
        self.job = f"{STAGED}{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Written:
        files, path = place(self.path)
        name, rows = f"{path}/{self.job}/part-{uuid.uuid4().hex}", 0
        files.create_dir(f"{path}/{self.job}")
        with files.open_output_stream(name) as out:
            for r in iterator:
                values = (r[n] if r[n] is None or n not in NUMBERS else int(r[n]) for n in FIELDS)
                out.write((", ".join("" if v is None else str(v) for v in values) + " \n").encode())
                rows += 1
        return Written(name, rows)

    def commit(self, messages: list[Written | None]) -> None:
        files, path = place(self.path)
        done = [m for m in messages if m is not None and m.rows]
        if done or not self.keep_if_empty:
            old = listing(files, path) if self.overwrite else []
            gone = f"{path}/{self.job}/old"
            files.create_dir(gone)
            for i, m in enumerate(sorted(done, key=lambda m: m.path)):  # at first under names that no reader takes
                files.move(m.path, f"{path}/.{self.job}-{i:05d}")
            for f in old:
                files.move(f.path, f"{gone}/{f.base_name}")
            for i in range(len(done)):
                files.move(f"{path}/.{self.job}-{i:05d}", f"{path}/part-{i:05d}-{self.job.removeprefix(STAGED)}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        files, path = place(self.path)
        if files.get_file_info(f"{path}/{self.job}").type == fs.FileType.Directory:
            files.delete_dir(f"{path}/{self.job}")


class BackupSource(DataSource):
    """Options: ``path``; ``blockBytes``; ``keepIfEmpty`` (an empty table leaves an older backup, by default).

    Paths are of any file system that pyarrow opens (mounted paths, hdfs, s3, gs, abfs). The schema is the record's. With a column ``rejected`` after it, reading is permissive: that holds a bad line, whose
    fields are null; without it a bad line fails the query. A path that does not exist is an empty table; a file of no
    bytes has no records; a last line needs no end.
    """

    @classmethod
    def name(cls) -> str:
        return "roster"

    def schema(self) -> T.StructType:
        return RECORD

    def reader(self, schema: T.StructType) -> BackupReader:
        return BackupReader(schema, self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> BackupWriter:
        if missing := [n for n in FIELDS if n not in schema.fieldNames()]:
            raise ValueError(f"a record has no {', '.join(missing)}")
        return BackupWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Make the format ``roster`` known to a session."""
    spark.dataSource.register(BackupSource)
