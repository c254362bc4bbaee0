"""Connected components by alternating large-star and small-star contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from meshfront.plans.storage import materialize, release


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """One contraction. Each vertex sends its larger neighbours (large star) or its smaller ones and itself (small star) to its least neighbour.

    The minimum is a partial aggregate, and the join that brings it back is one that adaptive execution can split, so a hub of any degree stays distributed.
    """
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if larger else edges
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("m", "a").alias("m"))
    joined = both.join(least, both.a == least.k)
    if larger:
        out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select(F.col("k").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


#: Vertices whose stars a task keeps while it contracts what it sees, and edges that it takes in at a time.
HELD, TAKEN = 500_000, 2_000_000


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every vertex of the edges with the least that it reaches, without the least themselves. Roots hook to their least neighbour and all paths are halved until they end, in whole arrays."""
    names, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = ends[: len(a)], ends[len(a) :]
    parent = np.arange(len(names))
    while True:
        a, b = parent[a], parent[b]
        apart = a != b
        if not apart.any():
            break
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := parent[parent], parent):
            parent = up
    below = parent != np.arange(len(names))
    return names[below], names[parent[below]]


def _contracted(edges: DataFrame, held: int = HELD) -> DataFrame:
    """Edges ``(a, b)``, a > b, that join what ``edges`` joins: each task replaces its edges by stars around the least vertex that they reach, some ``held`` vertices at a time. That leaves fewer edges and shorter paths
    for the rounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken: list[tuple[np.ndarray, np.ndarray]] = []
        count = kept = 0

        def stars() -> tuple[np.ndarray, np.ndarray]:
            return _forest(*(np.concatenate([t[k] for t in taken] or [np.empty(0, np.int64)]) for k in (0, 1)))

        for batch in batches:
            taken.append(tuple(batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)))
            count += batch.num_rows
            if count - kept >= min(TAKEN, held):
                found = stars()
                full = len(found[0]) >= held
                if full:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["a", "b"])
                taken = [] if full else [found]
                count = kept = 0 if full else len(found[0])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in stars()], ["a", "b"])

    return edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).mapInArrow(run, "a long, b long")


def _written(edges: DataFrame) -> tuple[DataFrame, tuple[int, int]]:
    """The written edges with their count and digest, which are taken as they are written."""
    seen = Observation()
    out = materialize(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)).alias("x")), "edges")
    return out, (seen.get["n"], seen.get["x"])


def connected_components(edges: DataFrame, left: str = "a", right: str = "b", max_rounds: int = 100, held: int = HELD) -> DataFrame:
    """``(node, component)`` for every end of an edge, where component is the least node that can be reached.

    Vertices are whole numbers. Tasks first contract what they see, in ranges of vertices, since near vertices tend to have near numbers; every round after that is written to the shared folder, so lineage stays short and a lost executor costs one round. Rounds grow with the logarithm of the
    longest path. Loops and repeated edges are allowed; an edge with a null end is ignored; no edges give no rows.
    """
    a, b = F.col(left), F.col(right)
    start = materialize(edges.where(a.isNotNull() & b.isNotNull()).select(a.alias("a"), b.alias("b")), "links")  # read twice below
    now, seen = _written(_contracted(start.where("a <> b").repartitionByRange("a"), held).distinct())
    for _ in range(max_rounds if seen[0] else 0):
        after, before = _written(_star(_star(now, True), False)), seen
        release(now)
        now, seen = after
        if seen == before:  # a forest of stars is a fixed point
            break
    else:
        if seen[0]:
            raise RuntimeError("components did not converge")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    loops = start.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    linked = now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots)
    return linked.unionAll(loops.join(linked, "node", "left_anti")).distinct()
