import base64
import gzip
import hashlib
import zlib
from collections import defaultdict

import pytest

from briarlake.llm import warc
from briarlake.llm.queries import op13_warc
from briarlake.scratch import Scratch
from tests.llm import brute

SCHEMA = "page_id long, url string, html string"


def plain(rows, least=0):
    """(page_id, bytes, digest, type, refers_to) of (page_id, url, html), by grouping equal texts."""
    groups = defaultdict(list)
    for i, _, html in rows:
        groups[(html or "").encode()].append(i)
    out = []
    for payload, ids in groups.items():
        top = max((i for i in ids if i is not None), default=None)
        for i in ids:
            again = len(payload) >= least and top is not None and i != top
            out.append((i, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if again else "response", top if again else None))
    return sorted(out, key=str)


def listed(frame):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in frame.collect()), key=str)


def pages(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def texts(n=60):
    return [(k, f"http://x.example/{k}?q=a b\r\nc", ["", "short", f"<p>{k % 7}</p>" * 50, "é\n中 \r\n\r\n" * (k + 1), None, "x" * 20000][k % 6]) for k in range(n)]


@pytest.mark.parametrize("least", [0, 100])
def test_written_and_read_back(spark, least):
    rows = texts()
    assert listed(warc.archived(pages(spark, rows), Scratch(spark, "t"), least)) == plain(rows, least)


@pytest.mark.parametrize("split", [97, 1000, 1 << 30])
def test_each_record_once_whatever_the_ranges(spark, tmp_path, split):
    rows, folder = texts(30), f"file://{tmp_path}/a"
    warc.write_archives(pages(spark, rows).coalesce(2), folder, Scratch(spark, "t"))
    read = warc.read_archives(spark, folder, Scratch(spark, "t"), splitBytes=split, payload="true").where("record_type <> 'warcinfo'").collect()
    assert sorted(int(r.page_id) for r in read) == list(range(30)) and {r.problem for r in read} == {None}
    whole = {k: (h or "").encode() for k, _, h in rows}
    assert all(bytes(r.payload) == whole[int(r.page_id)] for r in read if r.record_type == "response")
    assert {r.target_uri for r in read} == {f"http://x.example/{k}?q=a%20b%0D%0Ac" for k in range(30)}


def member(text: bytes, level: int = 6) -> bytes:
    pack = zlib.compressobj(level, wbits=31)
    return pack.compress(text) + pack.flush()


def record(name: str, body: bytes, level: int = 6) -> bytes:
    head = f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <{name}>\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    return member(head + body + b"\r\n\r\n", level)


def names(spark, tmp_path, data: bytes, split: int):
    (tmp_path / "f.warc.gz").write_bytes(data)
    return sorted((r.record_id, r.problem) for r in warc.read_archives(spark, f"file://{tmp_path}", Scratch(spark, "t"), splitBytes=split).collect())


@pytest.mark.parametrize("split", [100, 333, 5000, 1 << 20])
def test_archives_inside_payloads_are_not_taken_for_records(spark, tmp_path, split):
    inner = b"".join(record(f"inner{k}", b"y" * 40) for k in range(20))
    data = record("a", b"first") + record("b", inner, level=0) + record("c", b"z" * 3000) + record("d", b"q" + inner + inner[:77], level=0) + record("e", b"last")
    assert names(spark, tmp_path, data, split) == [(f"<{x}>", None) for x in "abcde"]


@pytest.mark.parametrize("split", [64, 1 << 20])
def test_damaged_truncated_and_odd_members(spark, tmp_path, split):
    good = [record(x, x.encode() * 200) for x in "abcd"]
    broken = bytearray(record("x", bytes(range(256)) * 40))
    broken[-6] ^= 255  # in the checksum
    data = good[0] + bytes(broken) + good[1] + b"\x1f\x8b\x08 no member" + member(b"not a record") + good[2] + gzip.compress(b"") + good[3] + record("y", bytes(range(256)) * 40)[:-9]
    assert names(spark, tmp_path, data, split) == [*((f"<{x}>", None) for x in "abcd"), ("<x>", "damaged"), ("<y>", "truncated")]


def test_a_wrong_digest_and_length_are_told(spark, tmp_path):
    head = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <{}>\r\nWARC-Payload-Digest: sha1:AAAA\r\nContent-Type: application/http\r\nContent-Length: {}\r\n\r\n"
    data = member(head.format("p", 20).encode() + b"HTTP/1.1 200\r\n\r\nbody\r\n\r\n") + member(head.format("q", 99).encode() + b"HTTP/1.1 200\r\n\r\n")
    assert names(spark, tmp_path, data, 1 << 20) == [("<p>", "digest"), ("<q>", "length")]


def test_unfinished_writes_are_not_read(spark, tmp_path):
    folder = f"file://{tmp_path}/a"
    warc.write_archives(pages(spark, texts(12)), folder, Scratch(spark, "t"))
    (tmp_path / "a" / "part-lost.warc.gz").write_bytes(record("lost", b"x"))
    assert warc.read_archives(spark, folder, Scratch(spark, "t")).where("record_id = '<lost>'").count() == 0


def test_files_end_at_their_size(spark, tmp_path):
    warc.write_archives(pages(spark, texts(40)).coalesce(1), f"file://{tmp_path}/a", Scratch(spark, "t"), fileBytes=2000)
    assert len(list((tmp_path / "a").glob("*.warc.gz"))) > 3
    assert warc.read_archives(spark, f"file://{tmp_path}/a", Scratch(spark, "t")).where("page_id IS NOT NULL").count() == 40


def test_odd_rows(spark):
    rows = [(1, None, "same"), (1, "u", "same"), (2, "u", "same"), (2, "u", "same"), (3, "u", "own"), (3, "v", "other"), (None, None, None), (None, "w", "lonely"), (None, "w", "lonely"), (9, "u", "")]
    assert listed(warc.archived(pages(spark, rows), Scratch(spark, "t"))) == plain(rows)
    assert warc.archived(pages(spark, rows).limit(0), Scratch(spark, "t")).count() == 0
    named = spark.createDataFrame([("a b", "u", "t", 1, 2), ("c\n%", "u", "t", 1, 2)], "page_id string, url string, html string, payload int, sha1 int")
    assert listed(warc.archived(named, Scratch(spark, "t")))[1][0::4] == ("c\n%", None)


def test_query_against_grouping(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{brute.SMALL}/pages.parquet").select("page_id", "url", "html").collect()]
    assert listed(op13_warc(spark, brute.SMALL)) == plain(rows)
