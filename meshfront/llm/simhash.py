"""SimHash near-duplicates by pigeonring filtering.

Fingerprints are taken of whole texts. Equal fingerprints collapse before anything else, so copies are never paired. The 64 bits stand on a ring of
SEGMENTS segments. If two fingerprints differ in at most MAX_BITS bits, then from some segment on every chain of k consecutive segments differs
in at most ``k * MAX_BITS / SEGMENTS`` bits (the pigeonring principle). The first steps of such a chain make the bucket key. With two steps the first segment is
equal and the second differs in at most one bit; two values that differ in one bit have unlike parity, so values of even parity are filed under
themselves only and those of odd parity also under their one-bit neighbours. With three steps the second and third segments together differ in at most two bits, so some value between them is at most one bit from each:
every print is filed under its own and all one-bit neighbours there, in buckets that are smaller by the third segment's bits. In a bucket, the longer chains prune before the full Hamming check.

Two steps serve up to MANY prints, three beyond, where buckets of two would hold many unrelated prints. A bucket that has more than LARGE prints isn't kept in a task either: its prints are passed on and filed anew
under three steps. Both find the same links. A bucket never emits all its pairs: small ones are compared by shifted arrays and large ones by a search that drops what it has reached, and
what a task found is reduced to a spanning forest. No bucket has a cap: one of three steps that is still large only takes longer. Its rows are
distinct fingerprints, of which even a very large group of near copies has few.

Defined cases: a null text or one without words has fingerprint zero, linked like any other; shorter texts than a shingle are one shingle. Very long texts are hashed whole.
Repeated rows are alike. A null doc_id never names a component unless all of its ids are null. An empty table gives no rows. Only id and text
are read; keep_first() returns all columns of ``docs`` whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from meshfront.llm.common import free_name
from meshfront.operators.components import connected_components
from meshfront.plans.storage import materialize, release

SHINGLE, SEED, MAX_BITS, SEGMENTS = 4, 42, 4, 5
#: Widths of the segments from the lowest bit on.
WIDTHS = (13, 13, 13, 13, 12)
#: Runs of up to so many rows are compared by shifts, larger ones by search.
SHORT_RUN = 24
#: Prints of a bucket that a task keeps, and prints from which on keys have three steps.
LARGE, MANY = 1 << 16, 1 << 29
#: Rows of bit counts held at once.
BLOCK = 1 << 15

_STARTS = np.cumsum((0, *WIDTHS))
_SEGMENT = [np.uint64(((1 << w) - 1) << int(s)) for w, s in zip(WIDTHS, _STARTS, strict=False)]
#: By first segment and length: the bits of a chain, and how many of them may differ.
_CHAIN = [[np.uint64(sum(int(_SEGMENT[(i + k) % SEGMENTS]) for k in range(n))) for n in range(1, SEGMENTS + 1)] for i in range(SEGMENTS)]
_BUDGET = [n * MAX_BITS // SEGMENTS for n in range(1, SEGMENTS + 1)]


def shingle_hashes(text: str | None, size: int = SHINGLE) -> np.ndarray:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line, lengths = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = max(1, len(words) - size + 1)
    last = ends[min(size, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts[:n].tolist(), last.tolist(), strict=True)), np.uint64, n)


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """Bit set where over half of the shingles' hashes have it set."""
    h = shingle_hashes(text, size)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), BLOCK):
        part = h[k : k + BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(t.as_py()) for t in batch.column(1)], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp)`` with the fingerprint as a signed long."""
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(_fingerprints, f"doc_id {kind}, fp long")


def _keys(fp: np.ndarray, i: int, steps: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(keys, prints)`` for the chains of two or three steps from segment i on; a key's top bits are i."""
    seg = [(fp & _SEGMENT[j]) >> np.uint64(int(_STARTS[j])) for j in ((i + n) % SEGMENTS for n in range(3))]
    if steps == 2:
        top, odd = (np.uint64(i) << np.uint64(32)) | (seg[0] << np.uint64(16)), np.bitwise_count(seg[1]) % 2 == 1
        yield top | seg[1], fp
        for b in range(WIDTHS[(i + 1) % SEGMENTS]):
            yield top[odd] | (seg[1][odd] ^ np.uint64(1 << b)), fp[odd]
    else:
        key = (np.uint64(i) << np.uint64(48)) | (seg[0] << np.uint64(32)) | (seg[1] << np.uint64(16)) | seg[2]
        yield key, fp
        for n, shift in ((1, 16), (2, 0)):
            for b in range(WIDTHS[(i + n) % SEGMENTS]):
                yield key ^ np.uint64(1 << (b + shift)), fp


def _filed(steps: int, every: bool):
    """File prints under the chains from every segment on, or from the one given in a second column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            first = None if every else batch.column(1).to_numpy(zero_copy_only=False)
            for k in range(0, len(whole), 20_000):
                part = whole[k : k + 20_000]
                chosen = [part if every else part[first[k : k + 20_000] == i] for i in range(SEGMENTS)]
                found = [pair for i, own in enumerate(chosen) for pair in _keys(own, i, steps)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in zip(*found, strict=True)], ["key", "fp"])

    return run


def _viable(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where the differing bits keep to the budget of every chain from the first segment on."""
    ok = np.ones(len(x), bool)
    for i in range(SEGMENTS):
        at = np.flatnonzero(first == i)
        for n in range(1, SEGMENTS):
            at = at[np.bitwise_count(x[at] & _CHAIN[i][n - 1]) <= _BUDGET[n - 1]]
        at = at[np.bitwise_count(x[at]) <= MAX_BITS]  # the full check
        ok[first == i] = False
        ok[at] = True
    return ok


def _search(fp: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of a large bucket: what a print reaches leaves the rest, so each print is reached once."""
    rest, a, b = fp, [], []
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            seed = queue.pop()
            hit = _viable(rest ^ seed, np.full(len(rest), first))
            if hit.any():
                reached = rest[hit]
                a.append(np.full(len(reached), seed))
                b.append(reached)
                queue.extend(reached)
                rest = rest[~hit]
    none = np.zeros(0, np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _forest(a: np.ndarray, b: np.ndarray, parent: dict[int, int]) -> list[tuple[int, int]]:
    """The edges that join two trees of ``parent``, which they extend."""

    def root(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = parent.get(p, p)
            x = p
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        if (p := root(x)) != (q := root(y)):
            parent[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def _linked(steps: int, large: int):
    """Links within the runs of equal keys of a sorted partition, ``(a, b, first)`` with first null; the prints of a run of two steps that grows beyond ``large`` as ``(fp, null, first)``."""
    shift = 32 if steps == 2 else 48

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}
        held: list[np.ndarray] = []  # the prints of the last key, whose run may go on in the next batch
        held_key, n_held, passing = None, 0, False

        def done(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            first = key >> shift
            cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
            sizes = np.diff(np.r_[cut, len(key)])
            a, b = [], []
            small = np.repeat(sizes <= SHORT_RUN, sizes)
            k_small, f_small, i_small = key[small], fp[small], first[small]
            for d in range(1, int(sizes[sizes <= SHORT_RUN].max(initial=1))):
                at = np.flatnonzero(k_small[d:] == k_small[:-d])
                x = f_small[at] ^ f_small[at + d]
                at = at[_viable(x, i_small[at])]
                a.append(f_small[at])
                b.append(f_small[at + d])
            for c, n in zip(cut[sizes > SHORT_RUN].tolist(), sizes[sizes > SHORT_RUN].tolist(), strict=True):
                p, q = _search(fp[c : c + n], int(first[c]))
                a.append(p)
                b.append(q)
            edges = _forest(np.concatenate(a), np.concatenate(b), parent) if a else []
            pairs = np.array(edges, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.nulls(len(pairs), pa.int32())], _LINK)

        def passed_on(fp: np.ndarray, key: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), pa.nulls(len(fp), pa.int64()), pa.array(np.full(len(fp), key >> shift, np.int32))], _LINK)

        for batch in batches:
            key = batch.column(0).to_numpy(zero_copy_only=False)
            fp = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(key):
                continue
            start = int(np.searchsorted(key, held_key, "right")) if held_key is not None else 0
            if start:
                held.append(fp[:start])
                n_held += start
            stop = int(np.searchsorted(key, key[-1]))  # where the batch's last run begins
            if stop >= start and held_key is not None and start < len(key):  # the held run is over
                if passing:
                    yield passed_on(np.concatenate(held), held_key)
                else:
                    yield done(np.full(n_held, held_key), np.concatenate(held))
                held, n_held, passing = [], 0, False
            if start < len(key):
                if stop > start:
                    yield done(key[start:stop], fp[start:stop])
                held, n_held, passing, held_key = [fp[stop:]], len(key) - stop, False, int(key[-1])
            if steps == 2 and (passing or n_held > large):  # too many to keep: from here on they pass through
                yield passed_on(np.concatenate(held), held_key)
                held, n_held, passing = [np.zeros(0, np.uint64)], 0, True
        if held_key is not None:
            yield passed_on(np.concatenate(held), held_key) if passing else done(np.full(n_held, held_key), np.concatenate(held))

    return run


_LINK = ["a", "b", "first"]
_LINK_SCHEMA = "a long, b long, first int"


def fingerprint_links(distinct: DataFrame, many: int = MANY, large: int = LARGE) -> DataFrame:
    """``(a, b)``: links that join all fingerprints (column fp, distinct) of each component."""

    def linked(rows: DataFrame, steps: int, every: bool) -> DataFrame:
        filed = rows.mapInArrow(_filed(steps, every), "key long, fp long")
        return filed.repartition("key").sortWithinPartitions("key").mapInArrow(_linked(steps, large), _LINK_SCHEMA)

    fp = distinct.select("fp")
    if fp.count() > many:
        return linked(fp, 3, True).select("a", "b")
    found = materialize(linked(fp, 2, True), "links")
    over = found.where("b IS NULL").select(F.col("a").alias("fp"), "first").distinct()
    links = found.where("b IS NOT NULL").select("a", "b")
    return links if over.isEmpty() else links.unionAll(linked(over, 3, False).select("a", "b"))


def _rooted(own: DataFrame) -> DataFrame:
    """``own`` (a row for each distinct fp) with the least fingerprint of its component, ``root``."""
    parts = connected_components(fingerprint_links(own))
    return own.join(parts, own.fp == parts.node, "left").select(*own.columns, F.coalesce("component", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row of ``docs``; component_id is the smallest id of its component."""
    prints = materialize(fingerprints(docs, id_col, text_col), "prints")
    own = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    rooted = _rooted(own)
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    names = materialize(rooted.join(named, "root").select("fp", "component_id"), "named")
    release(own)
    return prints.join(names, "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component stays, with all its columns: that of the smallest id, a row without an id only if none has one, and one of rows that repeat the id.

    Rows are written once with their fingerprint and a number; the rows to stay are then found among numbers, so texts are shuffled once.
    """
    fp, row = (free_name(docs.columns, n) for n in ("fp", "row"))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t.as_py()) for t in batch.column(at)], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prints.view(np.int64))], [*batch.schema.names, fp])

    schema = StructType([*docs.schema.fields, StructField(fp, LongType())])
    kept = materialize(docs.mapInArrow(run, schema).withColumn(row, F.monotonically_increasing_id()), "printed")
    order = F.struct(F.col(f"`{id_col}`").isNull().alias("none"), F.col(f"`{id_col}`").alias("id"), F.col(row).alias("row"))
    own = materialize(kept.groupBy(F.col(fp).alias("fp")).agg(F.min(order).alias("least")), "distinct")
    first = _rooted(own).groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.row").alias(row))
    # A merge join at every size: how much is shuffled follows the input, and adaptive execution can still split it.
    return kept.join(materialize(first, "first").hint("merge"), row, "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))
