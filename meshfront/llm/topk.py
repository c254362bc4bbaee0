"""Exact top-k inner products over norm-sorted vectors.

Vectors are written once in descending length, so the length of a block's first vector bounds all that follow. A task takes a block of
queries and streams the candidates in that order. A query is done when its length times that bound falls below its k-th score, and the task ends with its last
query. Inside a block, vectors rotated by an SVD put most of a product in HEAD coordinates; the partial product plus the product of the residual
lengths (Cauchy-Schwarz) bounds the rest, and only what may reach the k-th score is multiplied in full, in exact integers. The rotation is
fitted on SAMPLE vectors at most, which affects speed alone.

No side is broadcast and no pairs are made: a task holds QUERIES queries, reads the candidates once for all of them and works on one block of BLOCK candidates by CHUNK queries at a time.

Defined cases: a vector that is null, or holds a null or non-finite component, takes no part, nor does a row without an id; an empty vector is the zero vector, and shorter
ones are padded with zeros. Very long vectors are read whole. Rows with a query's own id are not its candidates; repeated query rows are answered each. Ties go to smaller ids. Components of any size count exactly: products are
floats below 2**52, 64-bit integers below 2**62 and Python's integers beyond; a score that no long can hold is ranked by its value and given as the nearest long.
An empty table gives no rows. Only id and vector are read, whatever the other columns' names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshfront.plans.storage import materialize

SCALE, K, EVERY = 256, 5, 50
HEAD, BLOCK, QUERIES, CHUNK, SAMPLE = 16, 4096, 4096, 256, 16_384
_KINDS = "vec_id long, norm double, x binary, width int, wide boolean"


def quantize(v: list[float]) -> np.ndarray:
    """floor(SCALE * x) as doubles, which hold it exactly; the largest doubles stay as they are, scaled with care."""
    with np.errstate(over="ignore"):
        x = np.array(v, np.float64)
        return np.where(np.abs(x) < 2.0**900, np.floor(x * SCALE), np.clip(x * SCALE, -np.finfo(float).max, np.finfo(float).max))


def _norm(x: np.ndarray) -> float:
    most = float(np.abs(x).max(initial=0))
    if most < 2.0**500:
        return float(np.sqrt(x @ x))
    return min(most * float(np.sqrt(((x / most) ** 2).sum())), np.finfo(float).max)


def _quantized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for k, v in zip(batch.column(0), batch.column(1), strict=True):
            own = v.as_py()
            if own is None or not k.is_valid or None in own or not np.isfinite(np.array(own, np.float64)).all():
                continue
            x = quantize(own)
            wide = bool((np.abs(x) >= 2**31).any())
            rows.append((k.as_py(), _norm(x), x.astype("<f8" if wide else "<i4").tobytes(), len(x), wide))
        columns = zip(*rows, strict=True) if rows else [()] * 5
        kinds = (pa.int64(), pa.float64(), pa.binary(), pa.int32(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["vec_id", "norm", "x", "width", "wide"])


def _matrix(column: pa.Array, wide: pa.Array, width: int) -> np.ndarray:
    out = np.zeros((len(column), width))
    for k, (v, w) in enumerate(zip(column, wide.to_pylist(), strict=True)):
        own = np.frombuffer(v.as_py(), "<f8" if w else "<i4")
        out[k, : len(own)] = own
    return out


def _products(q: np.ndarray, x: np.ndarray, most: float) -> np.ndarray:
    """Exact inner products of integers held as floats, none larger than ``most``."""
    if most < 2.0**52:
        return (q @ x.T).astype(np.int64)
    if most < 2.0**62 and max(np.abs(q).max(initial=0), np.abs(x).max(initial=0)) < 2.0**62:
        return q.astype(np.int64) @ x.astype(np.int64).T
    whole = lambda m: [[int(c) for c in row] for row in m.tolist()]
    rows, columns = whole(q), whole(x)
    out = np.empty((len(rows), len(columns)), object)
    for r, a in enumerate(rows):
        for c, b in enumerate(columns):
            out[r, c] = sum(x * y for x, y in zip(a, b, strict=True) if x and y)
    return out


def _held(score: int) -> int:
    return max(-(2**63), min(2**63 - 1, score))


class _Best:
    """The k best of a query: exact scores and ids, best first."""

    def __init__(self, k: int) -> None:
        self.k, self.rows, self.least = k, [], -np.inf

    def add(self, scores: list[int], ids: list[int]) -> None:
        self.rows = sorted([*self.rows, *((-s, i) for s, i in zip(scores, ids, strict=True))])[: self.k]
        if len(self.rows) == self.k:
            try:
                self.least = float(np.nextafter(float(-self.rows[-1][0]), -np.inf))  # never above the exact score
            except OverflowError:
                self.least = np.finfo(float).max if self.rows[-1][0] < 0 else -np.inf


def _answers(folder: str, width: int, rotation: np.ndarray, k: int):
    head = max(1, min(HEAD, width // 2))

    def compared(q: np.ndarray, length: np.ndarray, ids: np.ndarray, best: list[_Best], x: np.ndarray, norm: np.ndarray, own: np.ndarray, turned: tuple) -> None:
        """One chunk of queries against one block of candidates."""
        least = np.array([b.least for b in best])
        q_turned = q @ rotation
        q_tail = np.sqrt(np.maximum((q_turned[:, head:] ** 2).sum(axis=1), 0))
        x_head, x_tail = turned
        slack = 1e-9 * length * norm[0] + 1e-6
        bound = q_turned[:, :head] @ x_head.T + np.outer(q_tail, x_tail)
        may = ~(bound + slack[:, None] < least[:, None]) & (own != ids[:, None])  # what overflows is not less
        seen = np.flatnonzero(may.any(axis=0))
        if not len(seen):
            return
        most = length * norm[0]
        for low, high in ((0, 2.0**52), (2.0**52, 2.0**62), (2.0**62, np.inf)):
            rows = np.flatnonzero((most >= low) & ((most < high) | (high == np.inf)) & may.any(axis=1))
            if not len(rows):
                continue
            part = seen if high < np.inf else seen[may[np.ix_(rows, seen)].any(axis=0)]
            scores = _products(q[rows], x[part], low if high == np.inf else high - 1)
            for r, a in enumerate(rows.tolist()):
                at = np.flatnonzero(may[a, part] & np.asarray(scores[r] >= least[a], bool))
                if len(at) > 4 * k and scores.dtype == np.int64:
                    own_scores = scores[r][at]
                    at = at[own_scores >= np.partition(own_scores, len(at) - k)[len(at) - k]]
                if len(at):
                    best[a].add(scores[r][at].tolist(), own[part][at].tolist())

    def search(ids: np.ndarray, q: np.ndarray) -> Iterator[tuple[int, list]]:
        from pyarrow import fs
        from pyarrow import parquet as pq

        store, path = fs.FileSystem.from_uri(folder)
        files = sorted(f.path for f in store.get_file_info(fs.FileSelector(path)) if f.base_name.startswith("part-"))
        length, best = np.array([_norm(x) for x in q]), [_Best(k) for _ in ids]
        for name in files:
            for batch in pq.ParquetFile(store.open_input_file(name)).iter_batches(BLOCK):
                norm = batch.column("norm").to_numpy()
                if not len(norm):
                    continue
                slack = 1e-9 * length * norm[0] + 1e-6
                active = np.flatnonzero(~(length * norm[0] + slack < np.array([b.least for b in best])))
                if not len(active):
                    return zip(ids.tolist(), best, strict=True)
                x, own = _matrix(batch.column("x"), batch.column("wide"), width), batch.column("vec_id").to_numpy()
                x_turned = x @ rotation
                turned = x_turned[:, :head], np.sqrt(np.maximum((x_turned[:, head:] ** 2).sum(axis=1), 0))
                for s in range(0, len(active), CHUNK):
                    at = active[s : s + CHUNK]
                    compared(q[at], length[at], ids[at], [best[i] for i in at.tolist()], x, norm, own, turned)
        return zip(ids.tolist(), best, strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, QUERIES):
                part = batch.slice(s, QUERIES)
                with np.errstate(over="ignore", invalid="ignore"):
                    found = search(part.column(0).to_numpy(), _matrix(part.column(1), part.column(2), width))
                rows = [(i, r, v, _held(-n)) for i, own in found for r, (n, v) in enumerate(own.rows, 1)]
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
                columns = zip(*rows, strict=True) if rows else ([], [], [], [])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["query_id", "rank", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the best k rows for each row whose id ``every`` divides."""
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").alias("v")).mapInArrow(_quantized, _KINDS)
    by = [F.col("norm").desc(), F.col("vec_id")]
    flat = materialize(rows, "vectors")
    candidates = materialize(flat.repartitionByRange(*by).sortWithinPartitions(*by), "by-length")
    is_query = F.col("vec_id") % every == 0
    queries = flat.where(is_query)
    size = flat.agg(F.max("width").alias("w"), F.count_if(is_query).alias("q")).first()
    if not size.q:
        return flat.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = max(1, size.w)
    sample = flat.orderBy(F.xxhash64("vec_id", F.lit("rotation")), "vec_id").limit(SAMPLE).select("x", "wide", "norm").toArrow().combine_chunks()
    x = _matrix(sample.column("x"), sample.column("wide"), width) / np.maximum(sample.column("norm").to_numpy(), 1)[:, None]
    rotation = np.ascontiguousarray(np.linalg.svd(x.T @ x)[0])
    # As few scans of the candidates as memory allows, but all cores at work.
    tasks = max(-(-size.q // QUERIES), min(-(-size.q // CHUNK), flat.sparkSession.sparkContext.defaultParallelism))
    rows = queries.select("vec_id", "x", "wide").repartition(tasks)
    return rows.mapInArrow(_answers(candidates.stored_at, width, rotation, k), "query_id long, rank int, vec_id long, score long")
