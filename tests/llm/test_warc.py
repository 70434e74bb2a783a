import gzip
import hashlib
import io

import pytest
from pyspark.sql import functions as F

from rosterspark.llm import warc

PAGES = [
    (1, "http://a/ b", "x" * 99), (2, None, "x" * 99), (3, "http://a", "é" * 50), (4, "http://b", "é" * 50), (5, "u", None), (6, "u", ""), (7, "u", "WARC/1.1\r\n\r\n" * 20), (8, "u", "WARC/1.1\r\n\r\n" * 20),
    (9, "line\nbreak", "y" * 5_000_000), (10, "u", "y" * 5_000_000), (None, "u", "z" * 200), (11, "u", "z" * 200), (12, "u", "q" * 100), (12, "u", "q" * 100), (13, "u", "only"), (14, "u", "\r\n\r\n"),
]


def expected(rows):
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        same = [p for p, _, h in rows if (h or "").encode() == data]
        first = min((p for p in same if p is not None), default=None)
        revisit = len(data) >= 100 and len(same) > 1 and first is not None and page != first
        out.append((page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=repr)


def round_trip(pages):
    return sorted((tuple(r)[:5] for r in warc.warc_round_trip(pages).collect()), key=repr)


@pytest.fixture
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumns({c: F.lit("extra") for c in ("digest", "refers_to", "first", "path", "records", "n")})


def test_round_trip(pages, small):
    assert round_trip(pages) == expected(PAGES)
    assert round_trip(small("pages")) == expected([(r.page_id, r.url, r.html) for r in small("pages").collect()])
    assert warc.warc_round_trip(pages.limit(0)).isEmpty()


def test_textual_ids(spark):
    rows = [("a>b\nWARC-Type: revisit", None, "x" * 200), ("z %2B+ é", "u", "x" * 200), ("", "u", "short"), (None, "u", "short"), ("<urn:page:1>", "u", "y")]
    pages = spark.createDataFrame(rows, "page_id string, url string, html string")
    assert round_trip(pages) == expected(rows)


def test_chunks_hold_the_payloads(spark, pages, tmp_path):
    manifest = warc.write_archives(pages, f"file://{tmp_path}/archives")
    chunks = warc.read_archives(spark, manifest).where("record_id = '<urn:page:9>'").orderBy("chunk").collect()
    assert [len(c.data) for c in chunks] == [1 << 20] * 4 + [5_000_000 - (4 << 20)] and [c.last for c in chunks] == [False] * 4 + [True]
    digest = hashlib.sha256()
    for c in chunks:
        digest.update(c.data)
        assert c.digest_so_far == digest.hexdigest()
    assert manifest.agg(F.sum("records")).first()[0] == len(PAGES)


def test_archives_are_plain_warc(pages, tmp_path):
    for row in warc.write_archives(pages.where("page_id in (3, 4)"), f"file://{tmp_path}/a").collect():
        data = gzip.decompress(open(row.path.removeprefix("file://"), "rb").read())
        for part in data.split(b"WARC/1.1\r\n")[1:]:
            header, _, block = part.partition(b"\r\n\r\n")
            fields = dict(line.split(b": ", 1) for line in header.split(b"\r\n"))
            assert len(block) == int(fields[b"Content-Length"]) + 4 and block.endswith(b"\r\n\r\n")
            assert (b"WARC-Refers-To" in fields) == (fields[b"WARC-Type"] == b"revisit")


def test_small_chunks_and_broken_streams():
    header, head = warc._header(1, "u", "d", None, 10)
    record = header + head + b"0123456789\r\n\r\n"
    rows = list(warc.read_chunks(io.BufferedReader(io.BytesIO(record * 2)), 4))
    assert [r[7] for r in rows] == [b"0123", b"4567", b"89"] * 2 and rows[-1][9] == 10
    with pytest.raises(ValueError, match="cut short"):
        list(warc.read_chunks(io.BufferedReader(io.BytesIO(record[:-9]))))
    with pytest.raises(ValueError, match="not a WARC record"):
        list(warc.read_chunks(io.BufferedReader(io.BytesIO(b"junk\r\n\r\n"))))
