"""Arrow IPC shards, split by record batches.

An Arrow file holds a stream between its magic and its footer, so both kinds are read alike.  A first
pass walks the message headers of every shard (a few bytes per batch, bodies are skipped) and cuts the
batches into splits of about equal bytes; a second pass deals the splits out and decodes them.  What
cannot be read becomes rows with a reason in place of a failed job.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agentcorpus.session import cut

# ---- fixed values: marks and header kinds of the Arrow IPC format ----------------------------
FILE_MAGIC = b"ARROW1"
CONTINUATION = 0xFFFFFFFF
SCHEMA, DICTIONARY, BATCH = 1, 2, 3
# ----------------------------------------------------------------------------------------------
SPLIT_BYTES = 64 << 20
PLAN = (
    "path string, split long, head array<long>, start long, length long, first_batch long, "
    "batches long, first_row long, row_count long, reason string"
)


def open_path(path: str):
    """File system and name of a local path or a file, HDFS or object-store URI."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def _header(metadata: bytes) -> tuple[int, int, int]:
    """(kind, body bytes, rows) of an encoded message header, a flatbuffer table."""

    def field(table: int, slot: int) -> int:
        vtable = table - struct.unpack_from("<i", metadata, table)[0]
        size = struct.unpack_from("<H", metadata, vtable)[0]
        at = struct.unpack_from("<H", metadata, vtable + 4 + 2 * slot)[0] if size > 4 + 2 * slot else 0
        return table + at if at else 0

    root = struct.unpack_from("<I", metadata, 0)[0]
    kind_at, header_at, body_at = field(root, 1), field(root, 2), field(root, 3)
    kind = metadata[kind_at] if kind_at else 0
    body = struct.unpack_from("<q", metadata, body_at)[0] if body_at else 0
    rows = 0
    if kind == BATCH and header_at:
        batch = header_at + struct.unpack_from("<I", metadata, header_at)[0]
        rows_at = field(batch, 0)
        rows = struct.unpack_from("<q", metadata, rows_at)[0] if rows_at else 0
    return kind, body, rows


def _messages(source, size: int) -> Iterator[tuple[int, int, int, int]]:
    """(kind, offset, bytes, rows) of a shard's messages; ValueError names why it ends too early."""
    if size == 0:
        raise ValueError("empty")
    start = source.read_at(min(8, size), 0)
    is_file = start[:6] == FILE_MAGIC
    at = 8 if is_file else 0
    while at < size:
        lead = source.read_at(min(8, size - at), at)
        if len(lead) < 4:
            raise ValueError("cut_off")
        mark = struct.unpack_from("<I", lead)[0]
        if mark == 0:
            break
        if mark != CONTINUATION:
            raise ValueError("not_arrow")
        if len(lead) < 8:
            raise ValueError("cut_off")
        length = struct.unpack_from("<i", lead, 4)[0]
        if length == 0:
            break
        if length < 0:
            raise ValueError("not_arrow")
        if at + 8 + length > size:
            raise ValueError("cut_off")
        try:
            kind, body, rows = _header(source.read_at(length, at + 8))
        except (struct.error, IndexError):
            raise ValueError("not_arrow") from None
        whole = 8 + length + body
        if body < 0 or rows < 0:
            raise ValueError("not_arrow")
        if at + whole > size:
            raise ValueError("cut_off")
        yield kind, at, whole, rows
        at += whole
    if is_file and source.read_at(min(6, size), max(0, size - 6)) != FILE_MAGIC:
        raise ValueError("cut_off")


def plan_arrow(files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Stored splits of the shards listed in ``files`` (column ``path``), and a row per unreadable end.

    A split names the schema and dictionaries before it (``head``: offsets and sizes in turn), the bytes
    of its batches, and the numbers of its first batch and row.  Rejections have a ``reason``
    (``empty``, ``cut_off``, ``not_arrow``, ``unreadable``) and start where the readable part ends.
    """
    fields = [name.split()[0] for name in PLAN.replace("array<long>", "array").split(", ")]
    limit = split_bytes
    arrow = pa.schema(
        [(name, pa.string() if name in ("path", "reason") else pa.int64()) for name in fields]
    ).set(2, pa.field("head", pa.list_(pa.int64())))

    def walk(path: str) -> Iterator[dict]:
        head: list[int] = []
        part = dict(path=path, split=0, start=0, length=0, first_batch=0, batches=0, first_row=0, row_count=0)
        reason = None
        try:
            files_at, name = open_path(path)
            with files_at.open_input_file(name) as source:
                for kind, at, size, rows in _messages(source, source.size()):
                    if kind in (SCHEMA, DICTIONARY) and not part["batches"]:
                        head = [*head, at, size]
                    if kind != BATCH and not part["batches"]:
                        part |= dict(start=at + size)
                        continue
                    part["length"] += size  # a dictionary amid batches belongs to the split
                    part["batches"] += kind == BATCH
                    part["row_count"] += rows
                    if kind == DICTIONARY:
                        part.setdefault("later", []).extend([at, size])
                    if part["length"] >= limit:
                        yield part | dict(head=head, reason=None)
                        head = head + part.pop("later", [])
                        part = dict(
                            path=path, split=part["split"] + 1, start=at + size, length=0,
                            first_batch=part["first_batch"] + part["batches"], batches=0,
                            first_row=part["first_row"] + part["row_count"], row_count=0,
                        )
        except ValueError as error:
            reason = str(error)
        except OSError:
            reason = "unreadable"
        if part["batches"]:
            yield part | dict(head=head, reason=None)
        if reason:
            yield part | dict(
                split=-1, head=[], start=part["start"] + part["length"], length=0, batches=0, reason=reason,
                first_batch=part["first_batch"] + part["batches"],
                first_row=part["first_row"] + part["row_count"], row_count=0,
            )

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                found = [{name: row[name] for name in fields} for row in walk(path)]
                yield pa.RecordBatch.from_pylist(found, schema=arrow)

    return cut(files.select("path").repartition(_tasks(files), "path").mapInArrow(plan, PLAN))


def _tasks(df: DataFrame) -> int:
    """Tasks to deal names out to: a stated number, as names are too small for Spark to judge by size."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


class Segments:
    """Some stretches of a file as one stream for the Arrow reader."""

    closed = False

    def __init__(self, source, stretches: Sequence[tuple[int, int]]) -> None:
        self.source, self.stretches = source, list(stretches)

    def read(self, size: int = -1) -> bytes:
        out = b""
        while self.stretches and (size < 0 or len(out) < size):
            at, length = self.stretches[0]
            taken = length if size < 0 else min(length, size - len(out))
            out += self.source.read_at(taken, at)
            self.stretches[0] = (at + taken, length - taken)
            if taken == length:
                self.stretches.pop(0)
        return out

    def readable(self) -> bool:
        return True

    def close(self) -> None:
        self.closed = True


def scan_arrow(
    spark: SparkSession,
    files: DataFrame,
    columns: Sequence[str],
    schema: str,
    rows: int = 4096,
    rejects: bool = False,
    plan: DataFrame | None = None,
) -> DataFrame:
    """Rows of the Arrow shards listed in ``files`` (column ``path``), or of their stored ``plan``.

    Batches are projected before they leave the reader and re-sliced to a fixed size, so a task holds
    one batch at a time.  With ``rejects`` rows carry their place (``path``, ``row_index`` in the shard)
    and a ``reason``: rows with one stand for what cannot be read from there on: a broken shard
    (see :func:`plan_arrow`), ``columns`` that are missing or of other types, or a ``broken_batch``.
    A shard of another schema is rejected once, however many splits it has; values that do not fit
    reject the rest of their split.  Without it those rows are left out.
    """
    plan = plan_arrow(files) if plan is None else plan
    wanted = list(columns)
    kinds = T.StructType.fromDDL(schema)
    output = T.StructType([T.StructField(f.name, f.dataType) for f in kinds]).add("path", "string")
    output = output.add("row_index", "long").add("reason", "string")
    arrow = _arrow_schema(output)

    def rejected(row: dict, at: int, reason: str) -> pa.RecordBatch:
        values = [pa.nulls(1, f.type) for f in arrow][:-3]
        return pa.RecordBatch.from_arrays(
            [*values, pa.array([row["path"]]), pa.array([at], pa.int64()), pa.array([reason])], schema=arrow
        )

    def read_split(row: dict) -> Iterator[pa.RecordBatch]:
        at, reason = row["first_row"], "broken_batch"
        head = list(zip(row["head"][::2], row["head"][1::2]))
        files_at, name = open_path(row["path"])
        try:
            with files_at.open_input_file(name) as source:
                stream = pa.ipc.open_stream(
                    pa.PythonFile(Segments(source, [*head, (row["start"], row["length"])]), mode="r")
                )
                if not _fits(stream.schema, wanted, arrow):
                    if row["split"] == 0:  # one schema holds for the whole shard
                        yield rejected(row, at, "columns")
                    return
                for piece in stream:
                    reason = "columns"
                    kept = piece.select(wanted)
                    fitted = [kept.column(i).cast(f.type) for i, f in enumerate(arrow) if i < len(wanted)]
                    reason = "broken_batch"
                    for start in range(0, kept.num_rows, rows):
                        n = min(rows, kept.num_rows - start)
                        yield pa.RecordBatch.from_arrays(
                            [
                                *[column.slice(start, n) for column in fitted],
                                pa.array([row["path"]] * n),
                                pa.array(range(at + start, at + start + n), pa.int64()),
                                pa.nulls(n, pa.string()),
                            ],
                            schema=arrow,
                        )
                    at += kept.num_rows
        except (pa.ArrowException, KeyError, OSError):
            yield rejected(row, at, reason)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                if row["reason"] is not None:
                    yield rejected(row, row["first_row"], row["reason"])
                else:
                    yield from read_split(row)

    found = plan.repartition(_tasks(plan), "path", "split").mapInArrow(read, output)
    return found if rejects else found.where("reason is null").select(*kinds.names)


def _fits(found: pa.Schema, wanted: Sequence[str], schema: pa.Schema) -> bool:
    """Whether a shard has the columns, each once, of types that can be cast."""
    try:
        kept = found.empty_table().select(list(wanted))
        for i in range(len(wanted)):
            kept.column(i).cast(schema.field(i).type)
    except (pa.ArrowException, KeyError):
        return False
    return True


def _arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def write_arrow_shards(df: DataFrame, folder: str, as_file: bool = False, rows: int | None = None) -> DataFrame:
    """Write each partition as one Arrow stream (or file) in a shared folder; returns the paths.

    ``rows`` is the size of a record batch, else batches stay as they come.  A repeated task writes a
    shard of another name, so only the returned paths count: store them once.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files_at, base = open_path(folder)
        sink, writer, path = None, None, None
        for batch in batches:
            if writer is None:
                files_at.create_dir(base, recursive=True)
                name = f"shard-{uuid.uuid4().hex}.arrow"
                path = f"{folder}/{name}"
                sink = files_at.open_output_stream(f"{base}/{name}")
                opened = pa.ipc.new_file if as_file else pa.ipc.new_stream
                writer = opened(sink, batch.schema)
            for start in range(0, batch.num_rows, rows or max(1, batch.num_rows)):
                writer.write_batch(batch.slice(start, rows))
        if writer is not None:
            writer.close()
            sink.close()
            yield pa.record_batch({"path": [path]})

    return df.mapInArrow(write, "path string")
