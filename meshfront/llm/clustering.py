"""Centroid clustering in exact integers with annulus search.

A vector's distance to a centroid is at least the difference of their lengths. Centroids are kept sorted by length: a binary search finds those next to a vector's own length, the nearer of them gives an upper bound, and only centroids within
that annulus, found by binary search too, are compared in full. They are met from the inside out, so each better one narrows the annulus, and one at its very border is still compared, since ties go to the smaller number.
Lengths are floats with slack, distances exact integers.

Vectors are turned into integers and written once; a round reads them, assigns them where they are read and adds up components a task; k rows of sums are what leaves a task. Centroids travel with the tasks: k times width numbers, both parameters.

Defined cases: vectors that are null, not exactly ``width`` long or hold null or non-finite components take no part. A vector without an id is clustered, but starts no cluster before all with ids have. Ids that repeat are vectors each for themselves; of rows with
one id the lesser vector starts first. Fewer than k vectors make fewer clusters; equal starts are legal, and the later stays empty. Components of any size count exactly: 64-bit integers where they suffice, Python's beyond. A distance or sum
that no long holds is given as the largest long. An empty table gives no rows. Only id and vector are read, whatever the other columns' names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshfront.plans.storage import materialize

WIDTH, SCALE, K, ROUNDS, SEED = 64, 64, 16, 3, "1"
_LIMB, _MOST = 30, 2**63 - 1
_FLAT = "vec_id long, x binary, wide boolean"


def _whole(v: float, scale: int) -> int:
    return int(v) * scale if abs(v) >= 2.0**53 else math.floor(v * scale)


def _kept(width: int, scale: int):
    """Vectors of the right form as integers of 32 bits; where those don't suffice, as the doubles they were."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vectors = batch.column(0), batch.column(1)
            fits = np.array([n == width for n in vectors.value_lengths().to_pylist()], bool)
            vectors, ids = vectors.filter(pa.array(fits)), ids.filter(pa.array(fits))
            raw = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
            fine = np.isfinite(raw).all(axis=1)
            raw, ids = raw[fine], ids.filter(pa.array(fine))
            wide = (np.abs(raw) >= 2.0**31 / scale).any(axis=1)
            narrow = np.floor(np.where(wide[:, None], 0, raw) * scale).astype("<i4")
            x = [r.astype("<f8").tobytes() if w else n.tobytes() for r, n, w in zip(raw, narrow, wide.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(x, pa.binary()), pa.array(wide, pa.bool_())], ["vec_id", "x", "wide"])

    return run


def _integers(x: bytes, wide: bool, scale: int) -> list[int]:
    return [_whole(v, scale) for v in np.frombuffer(x, "<f8").tolist()] if wide else np.frombuffer(x, "<i4").tolist()


class Annulus:
    """Centroids sorted by length. assign() gives each vector's nearest centroid and squared distance."""

    def __init__(self, centroids: list[list[int]]) -> None:
        self.exact, self.most = centroids, max((abs(v) for c in centroids for v in c), default=0)
        if self._fits(0):
            self.c = np.array(centroids, np.int64)
            length = np.sqrt((self.c.astype(np.float64) ** 2).sum(axis=1))
            self.order = np.argsort(length, kind="stable")
            self.length = length[self.order]

    def _fits(self, most: int) -> bool:
        """Whether 64 bits hold every squared distance."""
        return (most + self.most) ** 2 * len(self.exact[0]) < 2**62

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if x.dtype == object or not self._fits(int(np.abs(x).max(initial=0))):
            return self._large(x.astype(object))
        k = len(self.c)
        own = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
        slack = 1e-9 * (own + self.length[-1]) + 1e-6
        at = np.searchsorted(self.length, own)
        below, above = np.maximum(at - 1, 0), np.minimum(at, k - 1)
        seed = np.where(np.abs(self.length[below] - own) <= np.abs(self.length[above] - own), below, above)
        label = self.order[seed]
        best = ((x - self.c[label]) ** 2).sum(axis=1)
        reach = np.sqrt(best.astype(np.float64)) + slack
        first, last = np.searchsorted(self.length, own - reach), np.searchsorted(self.length, own + reach, "right")
        left, right, rows = seed - 1, seed + 1, np.arange(len(x))
        while len(rows):
            a, b = left[rows], right[rows]
            down = np.where(a >= first[rows], own[rows] - self.length[np.maximum(a, 0)], np.inf)
            up = np.where(b < last[rows], self.length[np.minimum(b, k - 1)] - own[rows], np.inf)
            # A gap beyond the bound ends a vector's search: the other side's is no smaller.
            open_ = np.minimum(down, up) <= np.sqrt(best[rows].astype(np.float64)) + slack[rows]
            rows, inner = rows[open_], (down <= up)[open_]
            if not len(rows):
                break
            met = self.order[np.where(inner, left[rows], right[rows])]
            far = ((x[rows] - self.c[met]) ** 2).sum(axis=1)
            better = (far < best[rows]) | ((far == best[rows]) & (met < label[rows]))
            best[rows[better]], label[rows[better]] = far[better], met[better]
            left[rows[inner]] -= 1
            right[rows[~inner]] += 1
        return label, best

    def _large(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As assign(), in Python's integers, whose lengths no float may hold: the annulus is all."""
        label, best = np.zeros(len(x), np.int64), None
        for k, c in enumerate(self.exact):
            far = ((x - np.array(c, object)) ** 2).sum(axis=1) if len(x) else np.zeros(0, object)
            if best is None:
                best = far
            else:
                nearer = np.array(far < best, bool)
                best, label = np.where(nearer, far, best), np.where(nearer, k, label)
        return label, best


def _matrices(batch: pa.RecordBatch, width: int, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and integer vectors of a batch: all of 32 bits at once, then the wide ones."""
    wide = np.array(batch.column("wide").to_pylist(), bool)
    narrow = np.flatnonzero(~wide)
    if len(narrow):
        yield narrow, np.frombuffer(b"".join(batch.column("x").filter(pa.array(~wide)).to_pylist()), "<i4").reshape(-1, width).astype(np.int64)
    if wide.any():
        yield np.flatnonzero(wide), np.array([_integers(v, True, scale) for v in batch.column("x").filter(pa.array(wide)).to_pylist()], object).reshape(-1, width)


def _sums(centroids: list[list[int]], width: int, scale: int):
    """Sums of each cluster's components and their number, one set a task: ``(cluster, axis, limb, total, n)``. Large integers are split into limbs, whose sums fit a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, sums, counts = Annulus(centroids), {}, {}
        for batch in batches:
            for _, x in _matrices(batch, width, scale):
                label, _ = search.assign(x)
                by = np.argsort(label, kind="stable")
                found, starts, n = np.unique(label[by], return_index=True, return_counts=True)
                for c, total, m in zip(found.tolist(), np.add.reduceat(x[by], starts, axis=0).tolist(), n.tolist(), strict=True):
                    sums[c] = [a + b for a, b in zip(sums.get(c, [0] * width), total, strict=True)]
                    counts[c] = counts.get(c, 0) + m
        rows = []
        for c, total in sums.items():
            for axis, value in enumerate(total):
                sign, left, limb = (1 if value >= 0 else -1), abs(value), 0
                while left or not limb:
                    rows.append((c, axis, limb, sign * (left & ((1 << _LIMB) - 1)), counts[c]))
                    left, limb = left >> _LIMB, limb + 1
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
        columns = zip(*rows, strict=True) if rows else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["cluster", "axis", "limb", "total", "n"])

    return run


def _labels(centroids: list[list[int]], width: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Annulus(centroids)
        for batch in batches:
            label, far = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int64)
            for at, x in _matrices(batch, width, scale):
                own, best = search.assign(x)
                label[at], far[at] = own, np.minimum(best, _MOST).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(label), pa.array(far)], ["vec_id", "cluster", "distance"])

    return run


def fit(flat: DataFrame, k: int = K, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE, seed: str = SEED) -> list[list[int]]:
    """The centroids after ``rounds`` rounds over vectors as integers. Only sums of k clusters reach the driver."""
    start = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = flat.select("x", "wide", start.alias("start")).orderBy(F.col("start").asc_nulls_last(), "x").limit(k).collect()
    centroids = [_integers(bytes(r.x), r.wide, scale) for r in first]
    for _ in range(rounds if centroids else 0):
        parts = flat.mapInArrow(_sums(centroids, width, scale), "cluster int, axis int, limb int, total long, n long")
        exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
        sums, counts = {}, {}
        # Limbs beyond the first are rare, so a task's count is that of its first limb.
        for r in parts.groupBy("cluster", "axis", "limb").agg(exact("total"), exact("n")).collect():
            own = sums.setdefault(r.cluster, [0] * width)
            own[r.axis] += int(r.total) << (_LIMB * r.limb)
            if not r.limb:
                counts[r.cluster] = int(r.n)
        centroids = [[v // counts[c] for v in sums[c]] if c in sums else old for c, old in enumerate(centroids)]
    return centroids


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE, seed: str = SEED, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)`` of every vector."""
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    flat = materialize(rows.mapInArrow(_kept(width, scale), _FLAT), "integers")
    spark, centroids = flat.sparkSession, fit(flat, k, rounds, width, scale, seed)
    if not centroids:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    assigned = materialize(flat.mapInArrow(_labels(centroids, width, scale), "vec_id long, cluster int, distance long"), "assigned")
    sums = {r.cluster: int(r.s) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    total = min(_MOST, sum(sums.values()))
    about = [(c, min(_MOST, s), total, hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, s in sums.items()]
    table = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # a row for each cluster
    return assigned.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
