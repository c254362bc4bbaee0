"""WARC archives with a two-level capture index.

Of records with equal payloads of at least MIN_REVISIT bytes, the one of the largest page_id is the response; the others are revisits that carry its payload's digest and length, its page
and its url, but no payload. Copies are found by digest with a partial aggregate; the join that marks the pages is salted, so one payload that fills a third of the table is spread over SALTS
partitions and, where adaptive execution sees fit, more.

Tasks write one gzip member a record to archives of their own and return captures. These are sorted by reversed-host key (``com,example,www)/path``) and page over all partitions and written as
compressed blocks of LINES lines. Beside each file of blocks lies its sparse directory: the first key and the place of every block, with an array of the entries' positions. A search bisects the files by
their first keys, which are one row a file, then a file's directory by range reads of PAGE entries, galloping from the place of the search before, and reads the one block and the record. The last PAGES pages and one block are
all that is held, so searches in the order of keys read each page that they meet about once.

A scan reads all blocks in parallel and then the records by archive and offset, in tasks of READ_BYTES, or in READ_TASKS larger ones, which read one record at a time whatever their share. What the revisits refer to is then sought: each response once, in order
of keys, by bisection; its payload is read again and must have the revisits' digest, and gives their length.

A file that a lost or repeated task left behind is never read: only captures and blocks of the attempt that counted name files.

Defined cases: null html is an empty payload. Very long payloads are records like any other, each held in memory one at a time. A null url has the empty key and no target header; control characters and blanks in
a url are percent-encoded. Rows without page_id are revisits of a larger one, or responses if no equal payload has an id. Rows that repeat the largest page_id are responses all, and a revisit refers to the one of the
greatest url among them. An empty table gives no rows. Other columns aren't read, whatever their names.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshfront.plans.storage import fresh_dir, materialize

MIN_REVISIT, SALTS, LINES, LEVEL = 1000, 16, 1000, 4
#: Bytes, stored and unpacked, that a task reads back.
READ_BYTES = 16 << 20
#: Tasks at most that read records or seek responses.
READ_TASKS = 10_000
#: Entries of a directory that a range read takes, and such pages that a search keeps.
PAGE, PAGES = 64, 64
DATE = "1970-01-01T00:00:00Z"
#: Fixed value: the profile of revisits by digest.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CAPTURE = "key string, page_id long, file string, offset long, length long, digest string, type string, size long"
_BLOCK = "first string, first_id long, file string, offset long, length long, lines long"


def surt(url: str | None) -> str:
    """The url with its host's labels reversed: the sort key of captures."""
    url = _safe(url or "")
    rest = url.partition("://")[2] or url
    host, cut, path = re.match(r"([^/?#]*)(/?)(.*)", rest, re.S).groups()
    return ",".join(reversed(host.lower().split("."))) + ")" + cut + path if host else ""


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _squeeze(data: bytes) -> bytes:
    c = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def _unsqueeze(data: bytes) -> bytes:
    return zlib.decompress(data, 31)


def _safe(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record(name: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, refers_url: str | None) -> bytes:
    """One WARC record, not yet compressed. ``name`` makes its id, which no other record has."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    kind = "response" if refers_to is None else "revisit"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>", f"WARC-Date: {DATE}"]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if url is not None:
        lines.append(f"WARC-Target-URI: {_safe(url)}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To-Date: {DATE}", f"X-Refers-To-Page-ID: {refers_to}"]
        lines += [] if refers_url is None else [f"WARC-Refers-To-Target-URI: {_safe(refers_url)}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of one record."""

    def headers(part: bytes) -> dict[str, str]:
        return {k: v for k, _, v in (x.partition(": ") for x in part.decode("utf-8", "surrogatepass").split("\r\n")[1:])}

    head, _, rest = data.partition(b"\r\n\r\n")
    own = headers(head)
    block = rest[: int(own["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return own, headers(http), payload


def _records(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _store(folder)
        store.create_dir(path, recursive=True)
        name, sink, at = f"{path}/{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            rows = []
            for values in zip(*batch.columns, strict=True):
                page_id, url, html, digest, refers_to, refers_url = (v.as_py() for v in values)
                sink = sink or store.open_output_stream(name, compression=None, buffer_size=1 << 20)
                payload = (html or "").encode("utf-8", "surrogatepass")
                data = _squeeze(record(f"{name}#{at}", page_id, url, payload, digest, refers_to, refers_url))
                sink.write(data)
                rows.append((surt(url), page_id, name, at, len(data), digest, "response" if refers_to is None else "revisit", len(payload) if refers_to is None else 0))
                at += len(data)
            yield _batch(rows, _CAPTURE)
        if sink:
            sink.close()

    return run


_ARROW = {"string": pa.string(), "long": pa.int64()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[t]) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def _blocks(folder: str, lines: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _store(folder)
        store.create_dir(path, recursive=True)
        name, sink, entries, at, entry_at, held = f"{path}/{uuid.uuid4().hex}.cdx.gz", None, None, 0, 0, []
        positions: list[int] = []

        def flush() -> tuple:
            nonlocal at, entry_at, held, sink, entries
            if sink is None:
                sink, entries = (store.open_output_stream(n, compression=None) for n in (name, _directory_of(name)))
            data = _squeeze("".join(json.dumps(x, separators=(",", ":")) + "\n" for x in held).encode())
            sink.write(data)
            row = (held[0][0], held[0][1], name, at, len(data), len(held))
            entry = json.dumps([*row[:2], *row[3:]], separators=(",", ":")).encode()
            entries.write(entry)
            positions.append(entry_at)
            at, entry_at, held = at + len(data), entry_at + len(entry), []
            return row

        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(row)
                if len(held) == lines:
                    out.append(flush())
            yield _batch(out, _BLOCK)
        if held:
            yield _batch([flush()], _BLOCK)
        if sink:
            sink.close()
            entries.write(struct.pack(f"<{len(positions) + 2}Q", *positions, entry_at, len(positions)))
            entries.close()

    return run


def _directory_of(name: str) -> str:
    return name.removesuffix(".cdx.gz") + ".directory"


def mark_revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """``(page_id, url, html, digest, refers_to, refers_url)``; the last two are null for a response."""
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"), F.col("html"), F.sha1(body).alias("digest"), F.octet_length(body).alias("n"))
    # Each task folds what it sees of a payload; only payloads that occur twice go on.
    first = base.where(F.col("n") >= min_bytes).groupBy("digest").agg(F.max(F.struct("page_id", "url")).alias("first"), F.count("*").alias("copies"))
    first = first.where("copies > 1 AND first.page_id IS NOT NULL")
    first = first.select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = base.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    later = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("first.page_id")))
    refers = (F.when(later, F.col(f"first.{c}")).alias(f"refers_{n}") for c, n in (("page_id", "to"), ("url", "url")))
    return salted.join(first, ["digest", "salt"], "left").select("page_id", "url", "html", "digest", *refers)


@dataclass(frozen=True)
class Archive:
    """captures: every record's place. directory: a row for each index block, sorted by first key and page."""

    captures: DataFrame
    directory: DataFrame
    folder: str


def write_archive(pages: DataFrame, folder: str | None = None, min_bytes: int = MIN_REVISIT, lines: int = LINES) -> Archive:
    folder = folder or fresh_dir(pages.sparkSession, "warc")
    captures = materialize(mark_revisits(pages, min_bytes).mapInArrow(_records(f"{folder}/archive"), _CAPTURE), "captures")
    by = ["key", "page_id", "file", "offset"]
    shards = captures.repartitionByRange(*by).sortWithinPartitions(*by)
    return Archive(captures, materialize(shards.mapInArrow(_blocks(f"{folder}/index", lines), _BLOCK), "directory"), folder)


def _read(store, name: str, offset: int, length: int) -> bytes:
    with store.open_input_file(name) as f:
        f.seek(offset)
        return _unsqueeze(f.read(length))


def _place(key: str, page_id: int | None) -> tuple:
    """Sorts as the index does: by key, then by page with null first."""
    return key, page_id is not None, page_id or 0


class Index:
    """Search by bisection. ``files``: first key and page and name of each file of blocks, which is one row a file. ``reads`` counts range reads, of directories and blocks."""

    def __init__(self, folder: str, files: list[tuple]) -> None:
        self.store, _ = _store(folder)
        files = sorted(files, key=lambda f: (_place(f[0], f[1]), f[2]))
        self.names, self.firsts = [f[2] for f in files], [_place(f[0], f[1]) for f in files]
        self.open: tuple = (None, None, 0)
        self.pages: dict[int, list[list]] = {}
        self.block: tuple = (None, [])
        self.at = self.reads = 0

    def _range(self, start: int, length: int) -> bytes:
        self.reads += 1
        self.open[1].seek(start)
        return self.open[1].read(length)

    def _open(self, name: str) -> int:
        """The number of the file's blocks."""
        if self.open[0] != name:
            if self.open[1]:
                self.open[1].close()
            f = self.store.open_input_file(_directory_of(name))
            self.open, self.pages, self.at = (name, f, 0), {}, 0
            n = struct.unpack("<Q", self._range(f.size() - 8, 8))[0]
            self.open = (name, f, n)
        return self.open[2]

    def _entry(self, k: int) -> list:
        """``[first key, first page, offset, length, lines]`` of a block of the open file, with its page of entries by two range reads unless that is held."""
        page = self.pages.pop(k // PAGE, None)
        if page is None:
            _, f, n = self.open
            first = k // PAGE * PAGE
            count = min(PAGE, n - first)
            positions = struct.unpack(f"<{count + 1}Q", self._range(f.size() - 8 * (n + 2) + 8 * first, 8 * (count + 1)))
            data = self._range(positions[0], positions[-1] - positions[0])
            page = [json.loads(data[a - positions[0] : b - positions[0]]) for a, b in zip(positions, positions[1:], strict=False)]
            if len(self.pages) >= PAGES:
                del self.pages[next(iter(self.pages))]  # the one unused for longest
        self.pages[k // PAGE] = page
        return page[k % PAGE]

    def _before(self, low: tuple) -> int:
        """The last block of the open file that begins before ``low``, or -1: from where the search before ended, steps double until they pass it, and what they enclose is bisected."""
        n, key = self.open[2], lambda k: _place(*self._entry(k)[:2])
        left, right, step = -1, n, 1
        at = min(self.at, n - 1)
        while left < at < right:
            if key(at) < low:
                left, at = at, at + step
            else:
                right, at = at, at - step
            step *= 2
        return bisect.bisect_left(range(n), low, lo=left + 1, hi=right, key=key) - 1

    def _lines(self, name: str, entry: list) -> list[list]:
        if self.block[0] != (name, entry[2]):
            self.reads += 1
            data = _read(self.store, name, entry[2], entry[3])
            self.block = ((name, entry[2]), [json.loads(x) for x in data.decode().splitlines()])
        return self.block[1]

    def find(self, key: str, page_id: int | None = None, any_page: bool = True) -> list[dict]:
        """The captures of a key, or of one of its pages."""
        low, high = (_place(key, None), (key, True, float("inf"))) if any_page else (_place(key, page_id),) * 2
        out, at = [], max(0, bisect.bisect_left(self.firsts, low) - 1)
        for name, first in zip(self.names[at:], self.firsts[at:], strict=True):
            if first > high:
                break
            n = self._open(name)
            self.at = max(0, self._before(low))
            for k in range(self.at, n):
                entry = self._entry(k)
                if _place(*entry[:2]) > high:
                    return out
                lines = self._lines(name, entry)
                begin = bisect.bisect_left(lines, low, key=lambda x: _place(x[0], x[1]))
                for x in lines[begin:]:
                    if _place(x[0], x[1]) > high:
                        return out
                    out.append(dict(zip(_CAPTURE_NAMES, x, strict=True)))
        return out


_CAPTURE_NAMES = [f.split()[0] for f in _CAPTURE.split(", ")]


def index_files(archive: Archive) -> list[tuple]:
    """First key and page and name of each file of blocks."""
    rows = archive.directory.groupBy("file").agg(F.min(F.struct("first", "first_id")).alias("m")).select("m.first", "m.first_id", "file").collect()
    return [tuple(r) for r in rows]


def lookup(archive: Archive, urls: list[str]) -> dict[str, list[dict]]:
    """The captures of each url."""
    index = Index(archive.folder, index_files(archive))
    return {url: index.find(surt(url)) for url in urls}


def _captures(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _store(folder)
        for batch in batches:
            for name, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
                yield _batch([tuple(json.loads(x)) for x in _read(store, name, offset, length).decode().splitlines()], _CAPTURE)

    return run


_PAGE = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, refers_key string, url string"


def _page(data: bytes, where: str) -> tuple:
    """A row of a stored record; a response's payload must have the digest and length that its headers state."""
    own, http, payload = parse(_unsqueeze(data))
    digest, kind = own["WARC-Payload-Digest"].removeprefix("sha1:"), own["WARC-Type"]
    if kind == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != int(http["Content-Length"])):
        raise ValueError(f"the record at {where} is damaged")
    number = lambda x: None if x is None else int(x)
    refers_key = surt(own.get("WARC-Refers-To-Target-URI")) if kind == "revisit" else None
    size = len(payload) if kind == "response" else None
    return number(own.get("X-Page-ID")), size, digest, kind, number(own.get("X-Refers-To-Page-ID")), refers_key, own.get("WARC-Target-URI")


def _pages(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _store(folder)
        name, f = None, None
        for batch in batches:
            rows = []
            for file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
                if file != name:
                    name, f = file, store.open_input_file(file)
                f.seek(offset)
                rows.append(_page(f.read(length), f"{offset} of {file}"))
            yield _batch(rows, _PAGE)

    return run


_RESPONSE = "found_id long, found_digest string, found_bytes long"


def _responses(folder: str, files: list[tuple]):
    """Seek ``(refers_key, refers_to)`` in the index and read what is found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(folder, files)
        for batch in batches:
            rows = []
            for key, page_id in zip(*(batch.column(c).to_pylist() for c in ("refers_key", "refers_to")), strict=True):
                for hit in index.find(key, page_id, any_page=False):
                    if hit["type"] == "response":
                        with index.store.open_input_file(hit["file"]) as f:
                            f.seek(hit["offset"])
                            _, size, digest, *_ = _page(f.read(hit["length"]), f"{hit['offset']} of {hit['file']}")
                        rows.append((page_id, digest, size))
            yield _batch(rows, _RESPONSE)

    return run


def reading_tasks(n: int) -> int:
    """Tasks that read ``n`` bytes, stored and unpacked."""
    return min(1 + n // READ_BYTES, READ_TASKS)


def read_archive(spark: SparkSession, archive: Archive) -> DataFrame:
    """Every record through the index, ``(page_id, payload_bytes, payload_digest, record_type, refers_to, url)``."""
    size = archive.captures.agg(F.sum("length").alias("stored"), F.sum(F.col("length") + F.col("size")).alias("n")).first()
    tasks = reading_tasks(size.n or 0)
    run = max(1, READ_BYTES // 16 * (size.stored or 0) // max(size.n or 0, 1))  # stored bytes that a task reads in one go
    blocks = archive.directory.select("file", "offset", "length")
    places = blocks.repartition("file", "offset").mapInArrow(_captures(archive.folder), _CAPTURE).select("file", "offset", "length")
    near = F.floor(F.col("offset") / run)
    places = places.repartition(tasks, "file", near).sortWithinPartitions("file", "offset")
    pages = materialize(places.mapInArrow(_pages(archive.folder), _PAGE), "records")
    # Each response that is referred to is sought once; its rows go to the revisits by a salted join.
    revisits = pages.where("record_type = 'revisit'")
    sought = revisits.groupBy("refers_key", "refers_to").agg(F.count("*").alias("n")).select("refers_key", "refers_to")
    sought = sought.repartitionByRange(tasks, "refers_key", "refers_to").sortWithinPartitions("refers_key", "refers_to")
    found = materialize(sought.mapInArrow(_responses(archive.folder, index_files(archive)), _RESPONSE).distinct(), "responses")
    found = found.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = revisits.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    same = (F.col("refers_to") == F.col("found_id")) & (F.col("payload_digest") == F.col("found_digest"))
    joined = salted.join(found.withColumnRenamed("salt", "found_salt"), same & (F.col("salt") == F.col("found_salt")), "left")
    lost = F.raise_error(F.concat(F.lit("a revisit's response is missing: page "), F.coalesce(F.col("refers_to").cast("string"), F.lit("null"))))
    names = ["payload_digest", "record_type", "refers_to", "url"]
    resolved = joined.select("page_id", F.coalesce("found_bytes", lost.cast("long")).alias("payload_bytes"), *names)
    return pages.where("record_type <> 'revisit'").select("page_id", "payload_bytes", *names).unionAll(resolved)
