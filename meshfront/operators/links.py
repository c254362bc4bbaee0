"""Face links between cells by equi-joins on integer lattice corners."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshfront.operators import within
from meshfront.plans.ship import ship
from meshfront.plans.storage import exists, materialize_by, publish, together

#: Faces in order -x, +x, -y, +y, -z, +z.
FACES = tuple((2 * axis + up, axis, 2 * up - 1) for axis in range(3) for up in (0, 1))
CORNER = ("lx", "ly", "lz")
SCHEMA = "row_id long, face int, kind string, slot int, nbr_id long"
LINK = ("row_id", "face", "kind", "slot", "nbr_id")
#: Edge of a block in cells of the widest kind, by the number of cells from which on it holds; and cells of a bucket of blocks.
EDGES, BUCKET = ((0, 8), (1_000_000, 16), (20_000_000, 32)), 250_000


@dataclass(frozen=True)
class Lattice:
    """Finest width and lower corner of a region."""

    finest: float
    origin: tuple[float, float, float]


def lattice_of(cells: DataFrame) -> Lattice | None:
    """Four minima in one pass; None for no cells."""
    r = cells.agg(F.min("dx").alias("d"), *(F.min(F.col(c) - F.col("dx") / 2).alias(c) for c in "xyz")).first()
    return None if r.d is None else Lattice(r.d, (r.x, r.y, r.z))


def _places(lattice: Lattice) -> list[Column]:
    whole = lambda v: F.floor(v / lattice.finest + 0.5)
    return [whole(F.col("dx")).alias("w"), *(whole(F.col(c) - F.col("dx") / 2 - o).alias(k) for k, c, o in zip(CORNER, "xyz", lattice.origin, strict=True))]


def on_lattice(cells: DataFrame, lattice: Lattice) -> DataFrame:
    """``(row_id, level, w, lx, ly, lz)``: width and lower corner in finest cells, rounded half up."""
    return cells.select("row_id", "level", *_places(lattice))


def _touching(placed: DataFrame, edge: int, reach: Column) -> DataFrame:
    """``placed`` with ``at``, the blocks whose cells each may touch, its own first. Numbers of blocks along the axes are told once a cell, and most cells touch none but their own."""
    kept = placed.columns
    own, low, high = ([f"_{k}{c}" for c in CORNER] for k in ("own", "low", "high"))
    df = placed.select("*", *(F.floor(F.col(c) / edge).alias(o) for c, o in zip(CORNER, own, strict=True)))
    df = df.select("*", *(F.floor((F.col(c) - reach) / edge).alias(k) for c, k in zip(CORNER, low, strict=True)), *(F.floor((F.col(c) + reach) / edge).alias(k) for c, k in zip(CORNER, high, strict=True)))
    inside = reduce(and_, (F.col(a) == F.col(b) for a, b in zip(low, high, strict=True)))
    near = [F.array_distinct(F.array(*ks)) for ks in zip(own, low, high, strict=True)]
    name = lambda x, y, z: x + y * (1 << 20) + z * (1 << 40)
    every = F.flatten(F.transform(near[0], lambda x: F.flatten(F.transform(near[1], lambda y: F.transform(near[2], lambda z: name(x, y, z))))))
    return df.select(*kept, F.when(inside, F.array(name(*(F.col(o) for o in own)))).otherwise(every).alias("at"))


def blocked(cells: DataFrame) -> DataFrame | None:
    """Cells by cubic ``block``, written as a table bucketed by it: each with ``home``, the block that it lives in, and, as a guest, in every block whose cells it may touch. ``also`` are those other blocks. None for no cells.

    All that looks one cell far is then joined and folded within blocks, without a shuffle. Where corners are multiples of widths and widths follow from levels, a guest comes from the layer of cells next to the block; else
    from as far as the widest cell reaches.
    """
    lattice = lattice_of(cells)
    if lattice is None:
        return None
    placed = cells.select("*", *_places(lattice))
    span = F.col("w") * F.pow(F.lit(2.0), F.col("level"))
    off = sum(F.pmod(F.col(c), F.col("w")) for c in CORNER) > 0
    r = placed.agg(F.count("*").alias("n"), F.max("w").alias("widest"), F.count_if(off).alias("off"), F.min(span).alias("a"), F.max(span).alias("b")).first()
    reach = F.col("w") if not r.off and r.a == r.b else F.lit(r.widest)
    edge = r.widest * max(e for n, e in EDGES if r.n >= n)
    buckets = max(int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-r.n // BUCKET))
    # The cell alone is shuffled; what follows from its place is told anew after that.
    rows = _touching(placed, edge, reach).select(F.explode("at").alias("block"), *cells.columns).repartition(buckets, "block")
    rows = _touching(rows.select("*", *_places(lattice)), edge, reach).withColumn("home", F.get("at", F.lit(0)))
    return materialize_by(rows.withColumn("also", F.when(F.col("block") == F.col("home"), F.slice("at", 2, 27))).drop("at"), "blocks", "block", buckets)


def build_links(cells: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """``(row_id, face, kind, slot, nbr_id)`` and the row's ``block``: same-level links, else a link to a coarser cell, else up to four to finer ones.

    Cells are shuffled once, by block; a task looks up the faces of a block's cells among its cells and guests (within.linked()).
    """
    blocks = blocks if blocks is not None else blocked(cells)
    if blocks is None:
        return cells.sparkSession.createDataFrame([], SCHEMA + ", block long")
    ship(cells.sparkSession)
    found = blocks.select(F.col("block").alias("lies"), "home", "row_id", "level", "w", *CORNER).groupBy("lies").applyInArrow(within.linked, within.LINKS)
    return found.select(*LINK, "block")


def digest(cells: DataFrame) -> str:
    """Depends on the geometry and its order alone: two independent 64-bit hashes of every row, folded without order since the row id is in them, and the count."""
    rows = [F.xxhash64(F.lit(s), "row_id", "x", "y", "z", "dx", "level") for s in (1, 2)]
    r = cells.agg(F.count("*").alias("n"), *(F.coalesce(F.bit_xor(h), F.lit(0)).alias(k) for h, k in zip(rows, "ab", strict=True))).first()
    return f"{r.n:x}-{r.a & (2**64 - 1):016x}{r.b & (2**64 - 1):016x}"


def cached_links(cells: DataFrame, folder: str | None = None) -> DataFrame:
    """Links from ``folder`` if a whole set for this geometry is there, else built and kept there. Without a folder they're written to the shared one, bucketed by ``block``, and know the ``blocks`` that they were found in.

    A set is written under a hidden name of its own and published by one rename, so readers see whole sets alone. Of those that build a set at the same time the first to rename it wins, the others delete theirs and read
    the winner's. A store that renames by copying is no place for the folder while several jobs build.
    """
    if not folder:
        blocks = blocked(cells)
        found = build_links(cells, blocks)
        if blocks is not None:
            found = materialize_by(found, "links", "block", blocks.buckets, lies=True)
            found.blocks = blocks
        return found
    spark, name = cells.sparkSession, f"links-{digest(cells)}"
    path = f"{folder}/{name}"
    if not exists(spark, f"{path}/_SUCCESS"):
        own = f"{folder}/_{name}-{uuid.uuid4().hex}"
        with together(spark):
            build_links(cells).select(*LINK).write.parquet(own)
        publish(spark, own, path)
    return spark.read.schema(SCHEMA).parquet(path)


def direct_links(links: DataFrame) -> DataFrame:
    """Same-level and coarser neighbours only."""
    return links.where("kind <> 'fine'").select(*LINK)
