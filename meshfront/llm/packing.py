"""Best-fit packing of token sequences in bounded space.

A first pass tokenizes whole documents and cuts only those that exceed the capacity: all pieces but the first are full. Full pieces are sequences by themselves. The rest
goes, in hash order, to bounded-space online best-fit: a task keeps OPEN_BINS open bins, and a bitset of the free spaces that occur, so the tightest
bin that fits is the lowest set bit at or above the piece's length. When no open bin fits and all are taken, the fullest closes. Tasks pack alone; each has
about BUCKET_TOKENS tokens, of which what stays open at its end is a negligible part. Text is tokenized once, and only pieces' lengths are shuffled.

Defined cases: a null or empty text is the end token alone. Repeated rows and repeated ids are documents each for themselves. An empty table gives no
rows. Only id and text are read, whatever the other columns' names. Long texts are tokenized in one go: their ids depend on all of the text. Pieces of equal
length are alike to the bins, and which comes first follows the hash.

Ids are those of ``tokenizers``. Plain texts may take a second library with the same vocabulary, which is faster; texts with very long runs of blanks, which its regular
expressions can't hold, and any text that it fails on, go to ``tokenizers``.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshfront.plans.storage import materialize

CAPACITY, END, OPEN_BINS, BUCKET_TOKENS = 1024, 2, 256, 50_000_000
#: Characters that go to the tokenizer at once.
BATCH_CHARS = 1 << 20

#: Texts of these characters only are split into words alike by every version of the Unicode tables and by both tokenizer libraries.
_PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-\u024f]*")

#: A run of blanks that the faster library's pattern may not get through.
_LONG_RUN = re.compile(r"\s{5000}")

_PIECE = "doc_id {id}, piece int, start long, length long, ids_crc32 long"


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """Start and length of each piece of n tokens."""
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def token_ids(tokenizer: str, ranks: str | None = None, pattern: str | None = None):
    """A function from a list of texts to their id arrays by the file ``tokenizer``, without special tokens.

    ``ranks`` may name the same vocabulary as a rank file, with its word pattern: plain texts then take the faster library, with equal ids.
    """
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(tokenizer)
    full.encode_special_tokens = True
    quick = None
    if ranks:
        import tiktoken

        with open(ranks, "rb") as lines:
            merges = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
        quick = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=merges, special_tokens={})

    def ids(texts: list[str]) -> list[np.ndarray]:
        out: list = [None] * len(texts)
        for k, t in enumerate(texts):
            if quick is not None and _PLAIN.fullmatch(t) and not _LONG_RUN.search(t):
                try:
                    out[k] = quick.encode_to_numpy(t, disallowed_special=())
                except Exception:  # whatever it can't do, the other can
                    out[k] = None
        rest = [k for k, x in enumerate(out) if x is None]
        for k, e in zip(rest, full.encode_batch_fast([texts[k] for k in rest], add_special_tokens=False), strict=True):
            out[k] = np.array(e.ids, np.uint32)
        return out

    return ids


def _tokenized(tokenizer: tuple, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = token_ids(*tokenizer)

        def pieces(ids: list, texts: list[str], kind: pa.DataType) -> pa.RecordBatch:
            rows = []
            for k, e in zip(ids, encode(texts), strict=True):
                own = np.append(e, END).astype("<u4")
                rows.extend((k, p, s, n, zlib.crc32(own[s : s + n])) for p, (s, n) in enumerate(cut(len(own), capacity)))
            kinds = (kind, pa.int32(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

        for batch in batches:
            ids, texts, size = [], [], 0
            for k, t in zip(batch.column(0), batch.column(1), strict=True):
                ids.append(k.as_py())
                texts.append(t.as_py() or "")
                size += len(texts[-1])
                if size >= BATCH_CHARS:
                    yield pieces(ids, texts, batch.schema.field(0).type)
                    ids, texts, size = [], [], 0
            if ids:
                yield pieces(ids, texts, batch.schema.field(0).type)

    return run


class OpenBins:
    """At most ``most`` open bins of ``capacity``. put() gives a bin's number and the offset in it."""

    def __init__(self, capacity: int = CAPACITY, most: int = OPEN_BINS) -> None:
        self.capacity, self.most, self.free, self.at, self.open, self.made = capacity, most, 0, {}, 0, 0

    def put(self, length: int) -> tuple[int, int]:
        fits = self.free >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1  # the least free space that suffices
            bins = self.at[space]
            number = bins.pop()
            if not bins:
                self.free ^= 1 << space
            self.open -= 1
        else:
            if self.open == self.most:  # the fullest closes
                space = (self.free & -self.free).bit_length() - 1
                bins = self.at[space]
                bins.pop()
                if not bins:
                    self.free ^= 1 << space
                self.open -= 1
            space, number = self.capacity, self.made
            self.made += 1
        left = space - length
        if left:
            bins = self.at.setdefault(left, [])
            if not bins:
                self.free |= 1 << left
            bins.append(number)
            self.open += 1
        return number, self.capacity - space


def _packed(capacity: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, bins = TaskContext.get().partitionId() << 40, OpenBins(capacity, most)
        for batch in batches:
            places = [bins.put(n) for n in batch.column("length").to_pylist()]
            where = pa.array([base + s for s, _ in places], pa.int64()), pa.array([o for _, o in places], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *where], [*batch.schema.names[:5], "sequence_id", "offset"])

    return run


def tokenize(docs: DataFrame, tokenizer: tuple, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """The pieces of every document: ``(doc_id, piece, start, length, ids_crc32)``. tokenizer: the arguments of token_ids()."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(_tokenized(tokenizer, capacity), _PIECE.format(id=kind))


def pack(docs: DataFrame, tokenizer: tuple, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    """Every piece with its place: ``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)``."""
    pieces = materialize(tokenize(docs, tokenizer, id_col, text_col, capacity), "pieces")
    loose = pieces.where(F.col("length") < capacity)
    total = loose.agg(F.sum("length").alias("n")).first().n or 0
    buckets = 1 + total // BUCKET_TOKENS
    # The number of the written row parts equal rows, so that a row repeated very often is spread over all tasks.
    order = F.xxhash64("doc_id", "ids_crc32", "piece", F.monotonically_increasing_id())
    kind = pieces.schema["doc_id"].dataType.simpleString()
    packed = (
        loose.withColumn("_order", order)
        .repartition(buckets, "_order")
        .sortWithinPartitions("_order")
        .mapInArrow(_packed(capacity, open_bins), f"{_PIECE.format(id=kind)}, sequence_id long, offset long")
    )
    # Full pieces take numbers that no task above gives: negative ones.
    full = pieces.where(F.col("length") == capacity).select("*", (-F.monotonically_increasing_id() - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(full)
