"""Writes pages as WARC archives, and reads archives back past damage.

A reader checks each record: its version line, its length, the end mark behind it and the digest of its block; in a compressed
archive the checksum of its member too. Where a check fails it looks for the next place at which a valid member or a version line of a valid
record starts, goes on there, and reports the bytes between as a gap. Archives are streamed, so a task holds one record at a time.
"""
from __future__ import annotations

import datetime
import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from typing import BinaryIO
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import spare
from tickloom.sources.session import settle

#: Payloads of fewer bytes are stored again, not revisited.
LEAST_REVISITED = 100
#: Groups of equal payloads above this share of all records are joined apart; there can be so many of them at most.
HOT_SHARES = 1000
#: Bytes of a record at most, and of its header; what claims more is damaged.
LARGEST_RECORD = 1 << 30
LARGEST_HEADER = 1 << 16
READ_BYTES = 1 << 20
# Fixed values of the format.
END = b"\r\n\r\n"
MEMBER = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/\d\.\d\r\n")
START = re.compile(rb"\x1f\x8b\x08|WARC/\d\.\d\r\n")
LONGEST_START = 10
REPEATED = "warc-concurrent-to"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"

Found = tuple[int, int, str | None, dict[str, str], bytes]


class _Ahead:
    """The bytes of a stream from some offset on, as far as they are asked for."""

    def __init__(self, stream: BinaryIO):
        self.stream, self.offset, self.held, self.ended = stream, 0, bytearray(), False

    def reach(self, n: int) -> bool:
        """Whether ``n`` bytes lie ahead."""
        while len(self.held) < n and not self.ended:
            more = self.stream.read(max(READ_BYTES, n - len(self.held)))
            self.ended = not more
            self.held += more
        return len(self.held) >= n

    def drop(self, n: int) -> None:
        del self.held[:n]
        self.offset += n


def _member(ahead: _Ahead, largest: int) -> tuple[int, bytes | str]:
    """(bytes taken, content or problem) of the compressed member ahead."""
    unpack, parts, size, fed = zlib.decompressobj(31), [], 0, 0
    try:
        while not unpack.eof:
            if not ahead.reach(fed + 1):
                return 0, "truncated member"
            piece = bytes(ahead.held[fed : fed + READ_BYTES])
            fed += len(piece)
            parts.append(unpack.decompress(piece, largest + 1 - size))
            size += len(parts[-1])
            if size > largest:
                return 0, "member too large"
    except zlib.error:
        return 0, "broken member"
    return fed - len(unpack.unused_data), b"".join(parts)


def _fields(header: bytes) -> dict[str, str] | None:
    """Fields by lower-case name; None if a line isn't one or a field comes twice that may not, as where two headers have run into one.

    A line that starts with a blank goes on with the one before.
    """
    out: dict[str, str] = {}
    name = ""
    for line in header.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        name = name.strip().lower()
        if not colon or not name or (name in out and name != REPEATED):
            return None
        out[name] = value.strip()
    return out


def _record(ahead: _Ahead, largest: int) -> tuple[int, str | None, dict[str, str], bytes]:
    """(bytes taken, problem, fields, block) of the plain record ahead; bytes are also taken of one whose bounds hold but whose block is damaged."""
    ahead.reach(LARGEST_HEADER)
    if not VERSION.match(ahead.held):
        return 0, "no version line", {}, b""
    head = ahead.held.find(END, 0, LARGEST_HEADER)
    fields = _fields(bytes(ahead.held[:head])) if head >= 0 else None
    length = (fields or {}).get("content-length", "")
    if fields is None or not re.fullmatch("[0-9]{1,15}", length):
        return 0, "broken header", {}, b""
    start, end = head + len(END), head + len(END) + int(length)
    if int(length) > largest:
        return 0, "record too large", {}, b""
    if not ahead.reach(end + len(END)):
        return 0, "truncated record", {}, b""
    if ahead.held[end : end + len(END)] != END:
        return 0, "no end mark", {}, b""
    block, taken = bytes(ahead.held[start:end]), end + len(END)
    kind, _, digest = fields.get("warc-block-digest", "").partition(":")
    if kind.lower() in ("sha256", "sha-256") and hashlib.sha256(block).hexdigest() != digest.lower():
        whole = not ahead.reach(taken + 1) or (ahead.reach(taken + LONGEST_START) and START.match(ahead.held, taken))
        return taken if whole else 0, "digest differs", {}, b""
    return taken, None, fields, block


def salvaged(stream: BinaryIO, largest: int = LARGEST_RECORD) -> Iterator[Found]:
    """(offset, length, problem, fields, block) of what a stream holds, in order and without holes: records, whose problem is None, and gaps.

    Offsets are those of the stream, so of compressed records the member's. A member must hold one whole record, or nothing.
    A gap has the problem that was met at its start; a record with intact bounds and a damaged block is a gap by itself.
    """
    ahead = _Ahead(stream)
    gap, why = -1, ""
    while ahead.reach(1):
        ahead.reach(LONGEST_START)
        problem, fields, block, taken = "no record", {}, b"", 0
        if ahead.held.startswith(MEMBER):
            taken, content = _member(ahead, largest)
            if isinstance(content, str):
                problem = content
            elif content:
                inner = _Ahead(_Bytes(content))
                size, problem, fields, block = _record(inner, largest)
                if problem is None and size != len(content):
                    problem = "member holds more than a record"
            else:
                problem = ""  # an empty member separates
        elif VERSION.match(ahead.held):
            taken, problem, fields, block = _record(ahead, largest)
        if taken and problem == "digest differs" or not problem:
            if gap >= 0:
                yield gap, ahead.offset - gap, why, {}, b""
                gap = -1
            if problem != "":
                yield ahead.offset, taken, problem, fields, block
            ahead.drop(taken)
            continue
        if gap < 0:
            gap, why = ahead.offset, problem
        # the next place that may start a record; all before it can be forgotten
        while not (found := START.search(ahead.held, 1)) and not ahead.ended:
            ahead.drop(max(0, len(ahead.held) - LONGEST_START - 1))
            ahead.reach(len(ahead.held) + READ_BYTES)
        ahead.drop(found.start() if found else len(ahead.held))
    if gap >= 0:
        yield gap, ahead.offset - gap, why, {}, b""


class _Bytes:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def read(self, n: int) -> bytes:
        self.at += n
        return self.data[self.at - n : self.at]


def open_file(path: str) -> BinaryIO:
    """A stream of a file by its address, in any store that Arrow's file systems reach."""
    parts = urlsplit(path)
    if parts.scheme in ("", "file"):
        return open(unquote(parts.path) if parts.scheme else path, "rb")
    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_stream(inner)


RECORD = "path string, offset long, length long, problem string, type string, record_id string, target_uri string, fields map<string,string>, payload binary"


def _read(opener: Callable[[str], BinaryIO], largest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary())
        names = [x.split()[0] for x in RECORD.split(", ")]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows: list[tuple] = []
                size = 0
                with opener(path) as stream:
                    for offset, length, problem, fields, block in salvaged(stream, largest):
                        payload = None
                        if problem is None:
                            http = fields.get("content-type", "").startswith("application/http")
                            payload = block.partition(END)[2] if http else block
                        rows.append((path, offset, length, problem, fields.get("warc-type"), fields.get("warc-record-id"), fields.get("warc-target-uri"), list(fields.items()), payload))
                        size += len(block)
                        if size >= READ_BYTES or len(rows) >= 1000:
                            yield batch_of(rows)
                            rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    return run


def read_archives(spark: SparkSession, folder: str, opener: Callable[[str], BinaryIO] = open_file, largest: int = LARGEST_RECORD) -> DataFrame:
    """Records and gaps of all files below ``folder``, plain or compressed by record: (path, offset, length, problem, type, record_id, target_uri, fields, payload).

    Records have a null ``problem`` and all their ``fields`` by lower-case name, gaps name the first problem and have no payload. ``payload`` is the
    block, without the HTTP header where it has one. Empty files give no rows. Tasks take files by their sizes and stream them; a record
    of more than ``largest`` bytes counts as damaged.
    """
    paths = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    return paths.mapInArrow(_read(opener, largest), RECORD)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for record in batch.column("record"):
            pack = zlib.compressobj(6, zlib.DEFLATED, 31)
            out.append(pack.compress(record.as_py()) + pack.flush())
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])


def first_of_equal(pages: DataFrame, id: str, digest: str, size: str, first: str, least: int = LEAST_REVISITED) -> DataFrame:
    """``pages`` with ``first``: the smallest ``id`` of the rows with the same ``digest`` if they are several and ``size`` is ``least`` or more, else null.

    Digests of more than a thousandth of the rows are a thousand at most and are broadcast; the others meet their rows in a join
    whose keys are small groups, and rows that need no partner are spread over it by their id.
    """
    key, other, hot = spare(pages, "_key", "_first", "_hot")
    total = pages.count()
    groups = pages.where(F.col(size) >= least).groupBy(digest).agg(F.min(id).alias(other), F.count(F.lit(1)).alias("n")).where("n > 1")
    groups = settle(groups.select(F.col(digest).alias(key), other, "n"), "equal-payloads")
    large = groups.where(F.col("n") > total / HOT_SHARES).select(key, F.col(other).alias(hot))
    small = groups.where(F.col("n") <= total / HOT_SHARES).select(key, other)
    out = pages.join(F.broadcast(large), F.col(digest) == F.col(key), "left").drop(key)
    alone = (F.col(size) < least) | F.col(hot).isNotNull()
    out = out.withColumn(key, F.when(alone, F.concat(F.lit("-"), F.coalesce(F.col(id).cast("string"), F.lit("")))).otherwise(F.col(digest)))
    return out.join(small, key, "left").withColumn(first, F.coalesce(hot, other)).drop(key, hot, other)


def write_archives(pages: DataFrame, folder: str, compress: bool = True, least: int = LEAST_REVISITED, date: str | None = None) -> None:
    """Write a record for each row of ``pages`` (page_id, url, html) into archives below ``folder``; other columns are left out.

    The payload is the html in UTF-8, null the empty one. Of rows with equal payloads of ``least`` bytes or more that with the smallest
    ``page_id`` is a response, as are rows that repeat its id, and the others are revisits without the payload; smaller ones are all responses. Null ids
    are no smallest id; their records have none, and a null url gives no target; line ends in a url are escaped. Spark's writer commits the files, so a
    lost task leaves no half archive. ``compress`` makes each record a gzip member, with an empty member behind it as the line separator.
    """
    date = date or datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("body"))
    rows = rows.withColumn("digest", F.sha2("body", 256)).withColumn("size", F.octet_length("body").cast("long"))
    rows = first_of_equal(rows, "page_id", "digest", "size", "first", least)
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    block = F.concat(F.lit(HTTP), F.when(revisit, "").otherwise(F.col("body")))

    def line(name: str, value, when=None):
        text = F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
        return text if when is None else F.when(when, text).otherwise("")

    escaped = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    head = F.concat(
        F.lit("WARC/1.0\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.coalesce(escaped, F.lit("")), F.col("url").isNotNull()),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        line("X-Payload-Length", F.col("size").cast("string")),
        line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("first").cast("string"), F.lit("")), F.lit(">")), revisit),
        line("WARC-Profile", F.lit(PROFILE), revisit),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("WARC-Block-Digest", F.concat(F.lit("sha256:"), F.sha2(F.col("block"), 256))),
        line("Content-Length", F.octet_length("block").cast("string")),
        F.lit("\r\n"),
    )
    records = rows.withColumn("block", block).select(F.concat(head, "block").alias("record"))
    if not compress:
        records.write.option("lineSep", END.decode()).text(folder)
        return
    empty = zlib.compressobj(6, zlib.DEFLATED, 31).flush()
    packed = records.select(F.concat("record", F.lit(END.decode())).cast("binary").alias("record")).mapInArrow(_packed, "record binary")
    # Spark writes a string's bytes as they are, and the separator in the named encoding
    packed.select(F.col("record").cast("string")).write.option("encoding", "ISO-8859-1").option("lineSep", empty.decode("latin-1")).text(folder)
