"""Operator 13: WARC archives, written by tasks and read by splits.

An archive is a run of gzip members, one per record.  Tasks write files of bounded size and return their
names and sizes; only files in that stored list count, so what a lost task left behind is never read.
A reading task owns the records that start inside its byte range: it looks for the gzip magic, decodes
the header of each candidate member, and takes it if a whole WARC record follows with the right checksum;
the last record may end beyond the range.  Bytes of an archived archive can pass all of these tests inside
another record; a record is dropped if a record that starts in an earlier range ends behind its start.

Files are opened by tasks through pyarrow: local and mounted folders, hdfs, s3, gs and abfs.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from agentcorpus.llm.store import looked_up, partitions, stored
from agentcorpus.session import shared_folder

MAGIC = b"\x1f\x8b\x08"
FILE_BYTES = 256 << 20  # a file is closed beyond that size
SPLIT_BYTES = 32 << 20  # length of a reading task's byte range
PIECE = 1 << 16  # compressed bytes decoded at once
BLOCK = 1 << 22  # bytes read from a file at once
FIRST = 1 << 11  # bytes decoded to judge a candidate
MOST_HEADER = 1 << 20  # bytes of a record's own header or of its HTTP header
DATE = "2000-01-01T00:00:00Z"
FILES = "path string, bytes long, records long"
INDEX = (
    "path string, split long, start long, end long, record_type string, record_id string, url string, "
    "refers_to string, payload_bytes long, payload_digest string, error string"
)
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasbs": "abfss"}


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the name in it of a path or address."""
    scheme, mark, rest = path.partition("://")
    if not mark and path.startswith("file:"):
        return fs.LocalFileSystem(), unquote(path[len("file:") :])
    if mark and scheme == "file":
        return fs.LocalFileSystem(), unquote("/" + rest.partition("/")[2])
    if mark:
        return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}://{rest}")
    return fs.LocalFileSystem(), path


def digest_of(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def id_text(value: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid4()}>" if value is None else f"<urn:record:{quote(value, safe='')}>"


def id_value(field: str | None) -> str | None:
    mark, text = "<urn:record:", field or ""
    return unquote(text[len(mark) : -1]) if text.startswith(mark) else None


def record(record_id, url, payload: bytes, digest: str, refers_to, is_revisit: bool, date: str) -> bytes:
    """One record as a gzip member.  A revisit keeps the HTTP header, with the length of its payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (b"" if is_revisit else payload)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if is_revisit else 'response'}",
        f"WARC-Record-ID: {id_text(record_id)}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c if c.isprintable() and c != " " else quote(c) for c in url))
    if is_revisit:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        if refers_to is not None:
            lines.append(f"WARC-Refers-To: {id_text(refers_to)}")
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    head = "\r\n".join([*lines, "", ""]).encode()
    return packer.compress(head + block + b"\r\n\r\n") + packer.flush()


def mark_revisits(records: DataFrame, least: int = 0) -> DataFrame:
    """Add ``digest`` (SHA-1, hex), ``record_type`` and ``refers_to`` to (record_id, url, payload).

    Of records with equal payloads of ``least`` bytes or more the one of the smallest id is the response
    and the others revisit it.  Null payloads are empty.  Null ids come last.  Rows that share the smallest id are all responses.
    """
    rows = records.withColumn("payload", F.coalesce("payload", F.lit(b"")))
    rows = rows.withColumn("digest", F.sha1("payload"))
    size = F.octet_length("payload")
    firsts = (
        rows.where(size >= least)
        .groupBy("digest")
        .agg(F.min("record_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .where((F.col("n") > 1) & F.col("first").isNotNull())
        .drop("n")
    )
    found = looked_up(rows, firsts, ["digest"], F.xxhash64("record_id", "url"))
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("record_id")) & (size >= least)
    return found.withColumns(
        {
            "record_type": F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
            "refers_to": F.when(revisit, F.col("first")),
        }
    ).drop("first")


def write_archives(marked: DataFrame, folder: str, date: str = DATE) -> DataFrame:
    """Write marked records beneath ``folder``; (path, bytes, records) of the files that count.

    Tasks stream their rows to files of about FILE_BYTES, so they hold a record at a time.  Null
    payloads are empty.  No rows give no files.
    """
    columns = ["record_id", "url", "payload", "digest", "record_type", "refers_to"]
    limit = FILE_BYTES

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = opened(folder)
        system.create_dir(base, recursive=True)
        stream, name, size, count = None, "", 0, 0
        done: dict[str, list] = {"path": [], "bytes": [], "records": []}

        def close() -> None:
            stream.close()
            for key, value in zip(done, (f"{folder}/{name}", size, count)):
                done[key].append(value)

        for batch in batches:
            for at in range(batch.num_rows):
                row = [batch.column(c)[at].as_py() for c in columns]
                if stream is None:
                    name, size, count = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    stream = system.open_output_stream(f"{base}/{name}", compression=None)
                key = [None if x is None else str(x) for x in (row[0], row[5])]
                digest = digest_of(bytes.fromhex(row[3]))
                member = record(key[0], row[1], row[2] or b"", digest, key[1], row[4] == "revisit", date)
                stream.write(member)
                size, count = size + len(member), count + 1
                if size >= limit:
                    close()
                    stream = None
        if stream is not None:
            close()
        yield pa.RecordBatch.from_pydict(
            done, schema=pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())])
        )

    return stored(marked.select(*columns).mapInArrow(write, FILES), "archives")


class Bytes:
    """Bytes of a file by place, read in blocks."""

    def __init__(self, path: str, size: int) -> None:
        system, name = opened(path)
        self.file, self.size = system.open_input_file(name), size
        self.base, self.data = 0, b""

    def at(self, place: int, length: int) -> bytes:
        """Up to ``length`` bytes from ``place``, fewer at the end of the file or of the block."""
        if not self.base <= place < self.base + len(self.data):
            if place >= self.size:
                return b""
            self.base = place
            self.data = self.file.read_at(min(BLOCK, self.size - place), place)
        offset = place - self.base
        return self.data[offset : offset + length]

    def find(self, place: int, until: int) -> int | None:
        """The first place of the gzip magic in [place, until)."""
        while place < until:
            piece = self.at(place, PIECE)
            if len(piece) < len(MAGIC):  # the magic may lie across two blocks
                piece += self.at(place + len(piece), PIECE)
                if len(piece) < len(MAGIC):
                    return None
            hit = piece.find(MAGIC)
            if hit >= 0:
                return place + hit if place + hit < until else None
            place += len(piece) - len(MAGIC) + 1
        return None


def member(source: Bytes, place: int) -> Iterator[bytes]:
    """Decoded bytes of the gzip member at ``place``, in pieces; returns where it ends."""
    decoder, most = zlib.decompressobj(31), FIRST
    while not decoder.eof:
        packed = decoder.unconsumed_tail
        if not packed:
            packed = source.at(place, PIECE)
            if not packed:
                raise EOFError("cut off")
            place += len(packed)
        yield decoder.decompress(packed, most)
        most = BLOCK
    return place - len(decoder.unused_data)


def fields_of(head: bytes) -> dict[str, str]:
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, mark, value = line.partition(":")
        if mark:
            fields.setdefault(name.strip().lower(), value.strip())
    return fields


def length_of(fields: dict[str, str]) -> int | None:
    value = fields.get("content-length", "")
    return int(value) if value.isascii() and value.isdecimal() else None


def parsed(source: Bytes, place: int, keep: bool = False) -> dict | None:
    """The record whose member starts at ``place``; None where no WARC header does.

    A record that starts well and is broken further on has an ``error``.  Its payload is hashed piece by
    piece, and returned only if ``keep``.
    """
    pieces, data, end = member(source, place), b"", None

    def more() -> bool:
        nonlocal data, end
        try:
            data += next(pieces)
        except StopIteration as stop:
            end = stop.value
        return end is None

    found = {"start": place, "end": None, "error": None}
    try:
        while b"\r\n\r\n" not in data:
            if data[:7] != b"WARC/1."[: len(data)] or len(data) > MOST_HEADER or not more():
                return None
        if data[:7] != b"WARC/1.":
            return None
    except (zlib.error, EOFError):
        return None
    head, _, data = data.partition(b"\r\n\r\n")
    fields = fields_of(head)
    found |= {
        "record_type": fields.get("warc-type"),
        "record_id": id_value(fields.get("warc-record-id")),
        "url": fields.get("warc-target-uri"),
        "refers_to": id_value(fields.get("warc-refers-to")),
    }
    try:
        left = length_of(fields)
        if left is None:
            raise ValueError("no length")
        http = {}
        if fields.get("content-type", "").startswith("application/http"):
            while b"\r\n\r\n" not in data[:left] and len(data) < min(left, MOST_HEADER) and more():
                pass
            lines, mark, rest = data[:left].partition(b"\r\n\r\n")
            if not mark:
                raise ValueError("no HTTP header")
            http = fields_of(lines)
            left -= len(lines) + len(mark)
            data = data[len(lines) + len(mark) :]
        payload, size, kept = hashlib.sha1(), left, []
        while True:
            taken = data[:left]
            payload.update(taken)
            if keep:
                kept.append(taken)
            data, left = data[len(taken) :], left - len(taken)
            if len(data) > 4:
                raise ValueError("bytes behind the block")
            if not more():
                break
        if left or data != b"\r\n\r\n":
            raise ValueError("wrong length")
        found |= {"end": end, "payload_bytes": size, "payload_digest": digest_of(payload.digest())}
        stated = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
        if found["record_type"] == "revisit":
            found |= {"payload_bytes": length_of(http), "payload_digest": stated}
        elif stated not in (None, found["payload_digest"]):
            found["error"] = "wrong digest"
        if keep:
            found["payload"] = b"".join(kept)
    except (zlib.error, EOFError, ValueError) as error:
        found["error"] = str(error)
    return found


def index_archives(files: DataFrame, split_bytes: int | None = None) -> DataFrame:
    """Every record of the (path, bytes) files: its place, type, ids, url, payload length and digest.

    Records that cannot be decoded to their end have an ``error`` and a null ``end``; the reader goes on
    at the next member.  A revisit's length and digest are those that it states for the payload.
    """
    step = split_bytes or SPLIT_BYTES
    ranges = files.where(F.col("bytes") > 0).select(
        "path",
        "bytes",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(step).cast("long"))).alias("split"),
    )
    names = [field.split()[0] for field in INDEX.split(", ")]
    schema = pa.schema(
        [(name, pa.int64() if kind == "long" else pa.string()) for name, kind in map(str.split, INDEX.split(", "))]
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                source = Bytes(row["path"], row["bytes"])
                until, found = min(row["split"] + step, row["bytes"]), []
                place = source.find(row["split"], until)
                while place is not None:
                    one = parsed(source, place)
                    if one is not None:
                        found.append({name: one.get(name) for name in names} | {k: row[k] for k in ("path", "split")})
                        if len(found) == 4096:
                            yield pa.RecordBatch.from_pylist(found, schema=schema)
                            found = []
                    done = one is not None and one["end"] is not None
                    place = source.find(one["end"] if done else place + 1, until)
                source.file.close()
                yield pa.RecordBatch.from_pylist(found, schema=schema)

    spread = ranges.repartition(partitions(files), "path", "split")
    rows = stored(spread.mapInArrow(read, INDEX), "index")
    earlier = W.partitionBy("path").orderBy("split").rowsBetween(W.unboundedPreceding, -1)
    covered = (
        rows.groupBy("path", "split")  # a row per byte range
        .agg(F.max("end").alias("until"), F.min("start").alias("first"))
        .withColumn("until", F.max("until").over(earlier))
        .where(F.col("first") < F.col("until"))
        .select("path", "split", "until")
    )
    outside = F.col("until").isNull() | (F.col("start") >= F.col("until"))
    return rows.join(covered, ["path", "split"], "left").where(outside).drop("until", "split")


def read_records(index: DataFrame) -> DataFrame:
    """The indexed rows with their ``payload``; null for revisits and broken records."""
    schema = index.select("path", "start", "end", "record_type", "record_id", "url", "refers_to").schema
    names = schema.names

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, path = None, None
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                values = {name: row.column(name)[0].as_py() for name in names}
                payload = None
                if values["end"] is not None and values["record_type"] != "revisit":
                    if values["path"] != path:
                        path, source = values["path"], Bytes(values["path"], 0)
                        source.size = source.file.size()
                    payload = parsed(source, values["start"], keep=True)["payload"]
                columns = [*[row.column(name) for name in names], pa.array([payload], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, "payload"])

    return index.select(*names).mapInArrow(read, f"{schema.simpleString()[7:-1].replace(':', ' ')}, payload binary")


def archived(pages: DataFrame) -> DataFrame:
    """Write (page_id, url, html) as archives and index them: (page_id, url, payload_bytes,
    payload_digest, record_type, refers_to) as read back, a row per page.

    Null html is an empty payload, and equal payloads of any length, none included, are revisits.  Null
    ids come back as null.  In urls blanks and control characters come back percent-encoded.  Rows that
    repeat an id keep a record each.  Other columns are ignored; an empty table gives no rows.
    """
    records = pages.select(
        F.col("page_id").alias("record_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"),
    )
    folder = f"{shared_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    found = index_archives(write_archives(mark_revisits(records), folder))
    kind = pages.schema["page_id"].dataType
    return found.select(
        F.col("record_id").cast(kind).alias("page_id"),
        "url",
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"),
        "error",
    )
