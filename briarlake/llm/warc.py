"""WARC archives: written a gzip member a record, read back by tasks over byte ranges.

Writing: pages of equal payloads share a digest; the one of the largest id
becomes a response, the others revisit it and carry headers alone. Each task
writes files of its own; a manifest, written when all tasks are done, names the
files that count, so a lost executor's half-written files are never read.

Splittable reader: a file is cut into ranges of `splitBytes`. A task looks in its
range for the first bytes of a gzip member, and believes a candidate only if it
inflates to the header of a WARC record. It owns the records that start inside its
range, walks from member to member, reads the last one past the range's end, and
looks for the next candidate where a member is damaged. Only the record at hand
is held.

A payload may itself hold archives, whose members are stored byte by byte; a range
that starts within such a payload would take them for its own. Therefore each
record says where it ends: what starts before the end of a record of an earlier
range is inside that record and goes (`read_archives`), by the ends of ranges
alone.

Defined results: a null text is an empty payload; a null URL has no target field;
a null id has a record id of chance and comes back null. Rows of equal id and
payload, if that id is the largest, are all responses of one record id; of equal
id and other payloads, each has its own. Control characters of URLs come back
percent-encoded; ids of any type come back as they were. A damaged or truncated
record comes back with `problem` set and no payload; revisits of a response that
is not in the archives have no length. An empty table makes a folder without
records. Columns beside the three are left out, whatever their names.

Files are opened through pyarrow's file systems (local, HDFS, S3, GCS), by the
scheme of the folder.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from briarlake.llm.text import named, small_batches
from briarlake.scratch import Scratch

_MAGIC = b"\x1f\x8b\x08"
_HEADER_LIMIT = 1 << 16
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_WRITTEN = "page_id string, url string, payload binary, sha1 string, refers string"
_READ = "file string, range_start long, offset long, end long, record_id string, record_type string, page_id string, target_uri string, date string, refers_to string, payload_digest string, payload_bytes long, problem string"


def _opened(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if "://" in folder or not folder.startswith("file:") else "file://" + folder[5:])


def _digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


def _record_id(page: str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid4() if page is None else uuid.uuid5(uuid.NAMESPACE_URL, f'{page}/{digest}')}>"


def _record(fields: list[tuple[str, str | None]], block: bytes, level: int) -> bytes:
    """One gzip member with one record."""
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    packer = zlib.compressobj(level, wbits=31)
    return packer.compress(f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n") + packer.flush()


def _page_record(page: str | None, url: str | None, payload: bytes, sha1: str, refers: str | None, date: str, level: int) -> bytes:
    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
    block = _HTTP if refers is not None else _HTTP + payload
    fields = [
        ("WARC-Type", "response" if refers is None else "revisit"), ("WARC-Record-ID", _record_id(page, digest)), ("WARC-Date", date),
        ("WARC-Target-URI", None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: quote(m[0]), url)), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{_digest(block)}"),
        ("WARC-Profile", None if refers is None else "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", None if refers is None else _record_id(refers, digest)),
        ("Page-Id", None if page is None else quote(page)), ("Content-Type", "application/http; msgtype=response"),
    ]
    return _record(fields, block, level)


@dataclass
class _Files(WriterCommitMessage):
    names: list[str]


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.folder, self.overwrite = options["path"], overwrite
        self.date, self.level = options.get("date", "1970-01-01T00:00:00Z"), int(options.get("level", 6))
        self.file_bytes = int(options.get("filebytes", 1 << 30))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Files:
        system, root = _opened(self.folder)
        system.create_dir(root, recursive=True)
        names, out, size = [], None, 0
        try:
            for batch in iterator:
                for row in zip(*(batch.column(k) for k in range(batch.num_columns)), strict=True):
                    if out is None or size >= self.file_bytes:
                        if out is not None:
                            out.close()
                        names.append(f"part-{uuid.uuid4().hex}.warc.gz")
                        out = system.open_output_stream(f"{root}/{names[-1]}", compression=None)
                        info = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", _record_id(None, "")), ("WARC-Date", self.date), ("WARC-Filename", names[-1]), ("Content-Type", "application/warc-fields")]
                        head = _record(info, b"format: WARC File Format 1.1\r\n", self.level)
                        out.write(head)
                        size = len(head)
                    data = _page_record(*(v.as_py() for v in row), self.date, self.level)
                    out.write(data)
                    size += len(data)
        finally:
            if out is not None:
                out.close()
        return _Files(names)

    def commit(self, messages: list[_Files | None]) -> None:
        system, root = _opened(self.folder)
        system.create_dir(root, recursive=True)
        old = [f.path for f in system.get_file_info(fs.FileSelector(root)) if f.base_name.startswith("_manifest-")] if self.overwrite else []
        with system.open_output_stream(f"{root}/_manifest-{uuid.uuid4().hex}") as out:
            out.write("".join(f"{n}\n" for m in messages if m for n in m.names).encode())
        for path in old:
            for name in _lines(system, path):
                system.delete_file(f"{root}/{name}")
            system.delete_file(path)

    def abort(self, messages: list[_Files | None]) -> None:
        system, root = _opened(self.folder)
        for m in messages:
            for name in m.names if m else []:
                system.delete_file(f"{root}/{name}")


def _lines(system: fs.FileSystem, path: str) -> list[str]:
    with system.open_input_file(path) as f:
        return f.read().decode().splitlines()


class _Bytes:
    """A file read ahead in pieces."""

    def __init__(self, file: pa.NativeFile, ahead: int = 1 << 20):
        self.file, self.size, self.ahead, self.low, self.data = file, file.size(), ahead, 0, b""

    def at(self, place: int, n: int) -> bytes:
        if place < self.low or min(place + n, self.size) > self.low + len(self.data):
            self.file.seek(place)
            self.low, self.data = place, self.file.read(max(n, self.ahead))
        return self.data[place - self.low : place - self.low + n]

    def candidate(self, place: int, end: int) -> int | None:
        """Where the next gzip magic starts, from `place` on and before `end`."""
        while place < end:
            part = self.at(place, min(1 << 16, end + len(_MAGIC) - 1 - place))
            found = part.find(_MAGIC)
            if found >= 0:
                return place + found
            if len(part) < len(_MAGIC):
                return None
            place += len(part) - len(_MAGIC) + 1
        return None


def _fields(head: bytes) -> dict[str, str]:
    lines = re.sub(r"\r\n[ \t]+", " ", head.decode("utf-8", "replace")).split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def _salvaged(part: bytes) -> bytes:
    """What inflates before the damage: zlib keeps back what it had when it fails."""
    unpack, out = zlib.decompressobj(31), bytearray()
    try:
        for k in range(len(part)):
            out += unpack.decompress(part[k : k + 1])
    except zlib.error:
        pass
    return bytes(out)


def _member(data: _Bytes, start: int) -> tuple[bytes, int, str | None] | None:
    """What the gzip member at `start` inflates to, where it ends, and what is wrong; None if it does not begin a WARC record."""
    unpack, out, place, known = zlib.decompressobj(31), bytearray(), start, False
    problem = None
    while not unpack.eof:
        part = data.at(place, 1 << 14)
        try:
            out += unpack.decompress(part)
        except zlib.error:
            problem = "damaged"
            out += _salvaged(part) if not out else b""
        place += len(part)
        if not known and (not b"WARC/1.".startswith(out[:7]) or len(out) > _HEADER_LIMIT and b"\r\n\r\n" not in out[:_HEADER_LIMIT]):
            return None
        known = known or (len(out) >= 7 and b"\r\n\r\n" in out[:_HEADER_LIMIT] and b"warc-record-id:" in out[: out.index(b"\r\n\r\n")].lower())
        if problem is None and not part and not unpack.eof:
            problem = "truncated"
        if problem:
            return (bytes(out), start + 1, problem) if known else None
    return (bytes(out), place - len(unpack.unused_data), None) if known else None


def _records(text: bytes, problem: str | None) -> Iterator[tuple[dict[str, str], bytes | None, str | None]]:
    """(fields, block, problem) of the records of a member, which is one but in odd archives."""
    while text.startswith(b"WARC/1."):
        head, _, rest = text.partition(b"\r\n\r\n")
        fields = _fields(head)
        size = int(fields["content-length"]) if fields.get("content-length", "").isdigit() else -1
        if problem or size < 0 or len(rest) < size:
            yield fields, None, problem or "length"
            return
        yield fields, rest[:size], None
        text = rest[size:].lstrip(b"\r\n")


@dataclass
class _Range(InputPartition):
    path: str
    start: int
    end: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.split = options["path"], int(options.get("splitbytes", 64 << 20))
        self.payload = options.get("payload", "false") == "true"

    def partitions(self) -> list[_Range]:
        system, root = _opened(self.folder)
        found = system.get_file_info(fs.FileSelector(root, recursive=True))
        manifests = [f.path for f in found if f.base_name.startswith("_manifest-")]
        named_files = {f"{p.rpartition('/')[0]}/{n}" for p in manifests for n in _lines(system, p)}
        files = [f for f in found if f.is_file and f.base_name.endswith(".warc.gz") and (not manifests or f.path in named_files)]
        ranges = [_Range(f.path, s, min(s + self.split, f.size)) for f in sorted(files, key=lambda f: f.path) for s in range(0, f.size, self.split)]
        return ranges or [_Range("", 0, 0)]

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        held, size, names = [], 0, [c.split()[0] for c in _READ.split(", ")] + ["payload"] * self.payload
        kinds = {"long": pa.int64(), "string": pa.string()}
        types = [kinds[c.split()[1]] for c in _READ.split(", ")] + [pa.binary()] * self.payload

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)

        with _opened(self.folder)[0].open_input_file(part.path) as file:
            data, place = _Bytes(file), part.start
            while (place := data.candidate(place, part.end)) is not None:
                member = _member(data, place)
                if member is None:
                    place += 1
                    continue
                text, end, wrong = member
                for fields, block, problem in _records(text, wrong):
                    row, payload = self._row(fields, block, problem)
                    held.append((part.path, part.start, place, end, *row, *([payload] if self.payload else [])))
                    size += len(payload or b"") if self.payload else 0
                place = end
                if len(held) >= 1000 or size >= 8 << 20:
                    yield batch()
                    held, size = [], 0
        if held:
            yield batch()

    @staticmethod
    def _row(fields: dict[str, str], block: bytes | None, problem: str | None) -> tuple[tuple, bytes | None]:
        kind, payload = fields.get("warc-type"), block
        if block is not None and fields.get("content-type", "").startswith("application/http"):
            payload = block.partition(b"\r\n\r\n")[2]
        if kind == "revisit":
            payload = None
        said = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
        if payload is not None and kind == "response":
            made = _digest(payload)
            problem = problem or ("digest" if said not in (None, made) else None)
            said = said or made
        page = fields.get("page-id")
        values = (fields.get("warc-record-id"), kind, None if page is None else unquote(page), fields.get("warc-target-uri"), fields.get("warc-date"), fields.get("warc-refers-to"), said, None if payload is None else len(payload), problem)
        return values, payload


class WarcSource(DataSource):
    """Format "warc": options path, splitBytes and payload (true adds the payload's bytes) to read; path, date, level and fileBytes to write."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return _READ + (", payload binary" if self.options.get("payload", "false") == "true" else "")

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options.items()))

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(dict(self.options.items()), overwrite)


def _text(column: Column) -> Column:
    return column.cast("string")


def write_archives(pages: DataFrame, folder: str, scratch: Scratch, least_bytes: int = 0, page_id: str = "page_id", url: str = "url", html: str = "html", **options: object) -> None:
    """A record per page into `folder`. Of equal payloads of at least `least_bytes`, the page of the largest id is a response and the others revisit it."""
    small_batches(pages.sparkSession)
    pages.sparkSession.dataSource.register(WarcSource)
    payload = F.coalesce(named(html).cast("binary"), F.lit(b""))
    rows = pages.select(named(page_id).alias("id"), named(url).alias("url"), payload.alias("payload")).withColumn("sha1", F.sha1("payload"))
    long_enough = rows.where(F.octet_length("payload") >= least_bytes)
    shared = scratch.keep(long_enough.groupBy(F.col("sha1").alias("_sha1")).agg(F.max("id").alias("_largest"), F.count("*").alias("_n")).where("_n > 1").drop("_n"))
    marked = rows.join(shared, F.col("sha1") == F.col("_sha1"), "left")
    refers = F.when((F.octet_length("payload") >= least_bytes) & (F.col("id").isNull() | (F.col("id") < F.col("_largest"))), _text(F.col("_largest")))
    marked.select(_text(F.col("id")).alias("page_id"), "url", "payload", "sha1", refers.alias("refers")).write.format("warc").mode("append").options(**options).save(folder)


def read_archives(spark: SparkSession, folder: str, scratch: Scratch, **options: object) -> DataFrame:
    """Every record of the archives in `folder`, each once, whatever the ranges; see `WarcSource` for options."""
    spark.dataSource.register(WarcSource)
    found = scratch.keep(spark.read.format("warc").options(**options).load(folder))
    ends = found.groupBy("file", "range_start").agg(F.max("end").alias("_end"))
    before = Window.partitionBy("file").orderBy("range_start").rowsBetween(Window.unboundedPreceding, -1)
    covered = scratch.keep(ends.select(F.col("file").alias("_file"), F.col("range_start").alias("_start"), F.max("_end").over(before).alias("_covered")).where("_covered > _start"))
    joined = found.join(covered, (F.col("file") == F.col("_file")) & (F.col("range_start") == F.col("_start")), "left")
    return joined.where(F.col("_covered").isNull() | (F.col("offset") >= F.col("_covered"))).drop("_file", "_start", "_covered", "range_start")


def page_records(records: DataFrame, scratch: Scratch) -> DataFrame:
    """(page_id string, payload_bytes, payload_digest, record_type, refers_to string): responses and revisits, these with the length of what they revisit."""
    kept = scratch.keep(records.where(F.col("record_type").isin("response", "revisit")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id"))
    asked = kept.where("record_type = 'revisit'").select(F.col("refers_to").alias("_asked")).distinct()
    answers = kept.where("record_type = 'response'").join(asked, F.col("record_id") == F.col("_asked"), "left_semi")
    answers = scratch.keep(answers.groupBy(F.col("record_id").alias("_id")).agg(F.min("page_id").alias("_page"), F.min("payload_bytes").alias("_bytes")))
    revisits = kept.where("record_type = 'revisit'").join(answers, F.col("refers_to") == F.col("_id"), "left")
    out = revisits.select("page_id", F.col("_bytes").alias("payload_bytes"), "payload_digest", "record_type", F.col("_page").alias("refers_to"))
    return kept.where("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("string").alias("refers_to")).unionByName(out)


def archived(pages: DataFrame, scratch: Scratch, least_bytes: int = 0, page_id: str = "page_id") -> DataFrame:
    """The pages as their archives give them back: ids in their own type."""
    folder = f"{scratch.base}/archives"
    write_archives(pages, folder, scratch, least_bytes, page_id)
    found = page_records(read_archives(pages.sparkSession, folder, scratch), scratch)
    kind = pages.schema[page_id].dataType
    return found.withColumn("page_id", F.col("page_id").cast(kind)).withColumn("refers_to", F.col("refers_to").cast(kind))


_BITS = "array_to_string(list_transform(string_split(h, ''), lambda c: lpad(bin(strpos('0123456789abcdef', c) - 1), 4, '0')), '')"
_BASE32 = "array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(5), lambda k: CAST(substr(bits, 5 * i + k + 1, 1) AS INT) << (4 - k)))::INT, 1)), '')"
SQL = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages), b AS (SELECT page_id, strlen(html) AS n, {_BITS} AS bits, max(page_id) OVER (PARTITION BY h) AS largest FROM p)
 SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = largest THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> largest THEN largest END AS refers_to FROM b"""
