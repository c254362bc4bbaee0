"""Media columns: lossless 8-bit samples in archives, read by a data source of byte ranges.

A text's UTF-8 bytes, padded with zeros to a positive multiple of 64, become a grey PNG 64 samples wide; its text chunk keeps the length before padding. Tasks write
PNGs as stored members of ZIP archives in the shared folder, each archive under a temporary name that an atomic rename replaces, so a repeated task replaces its own
archive and a folder never shows half of one. The data source ``archive_members`` plans a partition for every byte range of every archive; a reader takes the members whose headers
begin in its range (every range reads the archive's directory, about 100 bytes a member), streams them in Arrow batches of bounded size, and on a bad read opens the archive anew at that member's offset, up to RETRIES
times, while the others stand; opening is retried alike. Members written are compared with members listed before any is read.

Defined cases: a null text is an empty one: 64 zero bytes. Long texts are one member each, which a task holds alone. Repeated rows are members each for themselves. An empty table
gives no rows. Only id and text are read, whatever the other columns' names; ids of any type that a string can be cast to, and null, come back as they were.
"""

from __future__ import annotations

import hashlib
import struct
import time
import zipfile
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from meshfront.plans.storage import fresh_dir

WIDTH, LEVEL = 64, 4
ARCHIVE_BYTES, RANGE_BYTES, BATCH_BYTES, RETRIES = 256 << 20, 16 << 20, 8 << 20, 3
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def pad(data: bytes) -> bytes:
    return data + bytes(WIDTH if not data else -len(data) % WIDTH)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes, n_bytes: int) -> bytes:
    """An 8-bit grey image of the samples, with no row filter."""
    rows = np.zeros((len(payload) // WIDTH, WIDTH + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"Length\0%d" % n_bytes) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> tuple[bytes, int]:
    """Payload and length before padding; every chunk's checksum is verified."""
    if not media.startswith(_SIGNATURE):
        raise ValueError("no PNG")
    at, parts = len(_SIGNATURE), {b"IDAT": b""}
    while at < len(media):
        (n,), kind = struct.unpack_from(">I", media, at), media[at + 4 : at + 8]
        body = media[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", media, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError("a chunk is damaged")
        parts[kind] = parts.get(kind, b"") + body
        at += n + 12
    width, height = struct.unpack(">II", parts[b"IHDR"][:8])
    rows = np.frombuffer(zlib.decompress(parts[b"IDAT"]), np.uint8).reshape(height, width + 1)
    return rows[:, 1:].tobytes(), int(parts[b"tEXt"].partition(b"\0")[2])


def member_name(doc_id: str | None) -> str:
    return "null" if doc_id is None else "=" + quote(doc_id, safe="")


def id_of(name: str) -> str | None:
    own = name.rpartition("/")[2].removesuffix(".png")
    return None if own == "null" else unquote(own[1:])


def retried(act: Callable, again: Callable | None = None):
    """What ``act`` returns; a bad read is tried RETRIES times, after ``again``."""
    for attempt in range(RETRIES):
        try:
            return act()
        except (OSError, zipfile.BadZipFile, EOFError):
            if attempt + 1 == RETRIES:
                raise
            time.sleep(0.1 * 2**attempt)
            if again:
                again()


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyspark import TaskContext

        store, path = _store(folder)
        store.create_dir(path, recursive=True)
        part, number, members, sink, archive, temporary = TaskContext.get().partitionId(), 0, 0, None, None, ""

        def close() -> None:
            archive.close()
            sink.close()
            store.move(temporary, f"{path}/part-{part:06d}-{number:04d}.zip")

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                if archive is None:
                    temporary = f"{path}/.{uuid.uuid4().hex}"
                    sink = pa.PythonFile(store.open_output_stream(temporary, compression=None), mode="w")
                    archive = zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED, allowZip64=True)
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                name = f"{members:09d}/{member_name(doc_id.as_py())}.png"
                archive.writestr(zipfile.ZipInfo(name), to_png(pad(data), len(data)))
                members += 1
                if sink.tell() >= ARCHIVE_BYTES:
                    close()
                    number, archive = number + 1, None
        if archive is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([members], pa.int64())], ["members"])

    return run


def write_archives(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> int:
    """Write a member for every row into archives in ``folder``; the number of members."""
    rows = docs.select(F.col(f"`{id_col}`").cast("string").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(_writer(folder), "members long").agg(F.coalesce(F.sum("members"), F.lit(0)).alias("n")).first().n


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int) -> None:
        self.path, self.start, self.end = path, start, end


class MemberReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.folder, self.bytes = options["path"], int(options.get("rangebytes", RANGE_BYTES))
        self.listed = options.get("listed", "false") == "true"  # members without their data

    def partitions(self) -> list[Range]:
        from pyarrow import fs

        store, path = _store(self.folder)
        found = sorted((f.path, f.size) for f in store.get_file_info(fs.FileSelector(path, allow_not_found=True)) if f.base_name.endswith(".zip"))
        return [Range(p, s, min(s + self.bytes, n)) for p, n in found for s in range(0, n, self.bytes)] or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        store, _ = _store(self.folder)
        names, offsets, media, size = [], [], [], 0

        def batch() -> pa.RecordBatch:
            columns = [pa.array([part.path] * len(names)), pa.array(names), pa.array(offsets, pa.int64()), pa.array(media, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["archive", "member", "offset", "media"])

        archive = None

        def opened() -> None:
            nonlocal archive
            archive = zipfile.ZipFile(store.open_input_file(part.path))

        retried(opened)
        for member in (m for m in archive.infolist() if part.start <= m.header_offset < part.end):
            # Reading seeks to the member's offset and verifies its checksum.
            data = None if self.listed else retried(lambda m=member: archive.read(m), lambda: retried(opened))
            names.append(member.filename)
            offsets.append(member.header_offset)
            media.append(data)
            size += len(data or b"") + 100
            if size >= BATCH_BYTES:
                yield batch()
                names, offsets, media, size = [], [], [], 0
        if names:
            yield batch()


class ArchiveMembers(DataSource):
    """``spark.read.format("archive_members").load(folder)``: the members of all ZIP archives in a folder."""

    @classmethod
    def name(cls) -> str:
        return "archive_members"

    def schema(self) -> str:
        return "archive string, member string, offset long, media binary"

    def reader(self, schema) -> MemberReader:
        return MemberReader(self.options)


def read_archives(spark: SparkSession, folder: str, listed: bool = False) -> DataFrame:
    """All members; with ``listed`` their places alone, from the archives' directories."""
    spark.dataSource.register(ArchiveMembers)
    return spark.read.format("archive_members").option("listed", str(listed).lower()).load(folder)


def feature(payload: bytes) -> str:
    """Rows, mean, deviation and entropy in bits of the samples, and an 8-bin histogram."""
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    n, values = len(payload), np.arange(256)
    mean = float((counts * values).sum() / n)
    deviation = float(np.sqrt(max((counts * values**2).sum() / n - mean**2, 0)))
    p = counts[counts > 0] / n
    return f"rows={n // WIDTH} mean={mean:.4f} std={deviation:.4f} entropy={abs(float((p * np.log2(p)).sum())):.4f} hist=" + ",".join(map(str, counts.reshape(8, 32).sum(axis=1)))


_FEATURES = "doc_id string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    names = [c.split()[0] for c in _FEATURES.split(", ")]
    for batch in batches:
        rows = []
        for member, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            media = value.as_py()
            payload, n = from_png(media)
            rows.append((id_of(member), n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload)))
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)


def media_features(docs: DataFrame, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text as media, read the archives back and describe each member."""
    spark = docs.sparkSession
    folder = folder or fresh_dir(spark, "media")
    written, listed = write_archives(docs, folder, id_col, text_col), read_archives(spark, folder, listed=True).count()
    if written != listed:
        raise OSError(f"{written} members were written and {listed} are there")
    found = read_archives(spark, folder).select("member", "media").mapInArrow(_described, _FEATURES)
    return found.withColumn("doc_id", F.col("doc_id").cast(docs.schema[id_col].dataType))
