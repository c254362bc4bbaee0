"""Divergence and gradients from the faces of each cell."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from meshfront.functions.physics import GAMMA, entropy, norm
from meshfront.operators import within
from meshfront.plans.ship import ship
from meshfront.plans.storage import materialize, materialize_by, together


def face_samples(cells: DataFrame, links: DataFrame, gamma: float = GAMMA) -> DataFrame:
    """``(row_id, face, p, v, t, s)``: what lies across each usable face. A direct neighbour is sampled at its center; finer ones are averaged at the face plane, where p is null."""
    nbr = cells.select(F.col("row_id").alias("nbr_id"), *(F.array(*c).alias(k) for k, c in (("pos", "xyz"), ("vel", ("vx", "vy", "vz")))), "temp", F.col("rho"))
    axis = F.floor(F.col("face") / 2).cast("int")
    rows = links.join(nbr, "nbr_id").where("temp > 0 AND rho > 0")
    rows = rows.select("row_id", "face", F.when(F.col("kind") != "fine", F.get("pos", axis)).alias("p"), F.get("vel", axis).alias("v"), F.col("temp").alias("t"), entropy("temp", "rho", gamma).alias("s"))
    return rows.groupBy("row_id", "face").agg(F.max("p").alias("p"), *(F.avg(c).alias(c) for c in "vts"))


def stencil(cells: DataFrame, links: DataFrame, gamma: float = GAMMA) -> DataFrame:
    """Every cell with ``divv``, the gradients ``gt*`` and ``gs*``, ``valid``, ``candidate`` and the unit vector ``n*``.

    The faces of a cell meet in one aggregate on row_id that folds six fixed slots, so a task keeps no list of neighbours. With links that know their blocks a task folds those of
    a block (within.sampled()), which takes no shuffle, and the cells keep ``block`` and ``also``.
    """
    if (blocks := getattr(links, "blocks", None)) is not None:
        return _in_blocks(blocks, cells.columns, links, gamma)
    nbr = cells.select(F.col("row_id").alias("nbr_id"), *(F.array(*c).alias(k) for k, c in (("pos", "xyz"), ("vel", ("vx", "vy", "vz")))), "temp", "rho")
    axis = F.floor(F.col("face") / 2).cast("int")
    rows = links.join(nbr, "nbr_id").where("temp > 0 AND rho > 0")
    rows = rows.select("row_id", "face", F.when(F.col("kind") != "fine", F.get("pos", axis)).alias("p"), F.get("vel", axis).alias("v"), F.col("temp").alias("t"), entropy("temp", "rho", gamma).alias("s"))
    rows = rows.repartition("row_id")  # a row for each link is narrower than one with all slots
    folds = [f(F.when(F.col("face") == k, F.col(c))).alias(f"{c}{k}") for k in range(6) for c, f in (("p", F.max), ("v", F.avg), ("t", F.avg), ("s", F.avg))]
    out = cells.join(rows.groupBy("row_id").agg(*folds), ["row_id"], "left")
    sound = (F.col("temp") > 0) & (F.col("rho") > 0) & (F.col("dx") > 0)
    for a, c in enumerate("xyz"):
        low, high = 2 * a, 2 * a + 1
        far = F.coalesce(F.col(f"p{high}"), F.col(c) + F.col("dx") / 2) - F.coalesce(F.col(f"p{low}"), F.col(c) - F.col("dx") / 2)
        used = sound & F.col(f"t{low}").isNotNull() & F.col(f"t{high}").isNotNull() & (F.abs(far) > 0)
        out = out.withColumns({f"far{a}": F.when(used, far)})
        out = out.withColumns({f"d{k}{a}": (F.col(f"{k}{high}") - F.col(f"{k}{low}")) / F.col(f"far{a}") for k in "vts"})
    zero = lambda k, a: F.coalesce(F.col(f"d{k}{a}"), F.lit(0.0))
    out = out.withColumns({"divv": zero("v", 0) + zero("v", 1) + zero("v", 2), **{f"g{k}{c}": zero(k, a) for k in "ts" for a, c in enumerate("xyz")}, "valid": F.coalesce("far0", "far1", "far2").isNotNull()})
    rising = sum(F.col(f"gt{c}") * F.col(f"gs{c}") for c in "xyz") > 0
    out = out.withColumns({"candidate": F.col("mask") & F.col("valid") & (F.col("divv") < 0) & rising})
    return _directed(out, cells.columns)


def _in_blocks(blocks: DataFrame, columns: list[str], links: DataFrame, gamma: float) -> DataFrame:
    ship(blocks.sparkSession)
    kept = blocks.select("block", "also", *columns)
    more = StructType().add("divv", "double")
    for c in (f"g{k}{c}" for k in "ts" for c in "xyz"):
        more = more.add(c, "double")
    schema = StructType([*kept.schema.fields, *more.add("valid", "boolean").add("candidate", "boolean").fields])
    whole = blocks.select("block", "also", *columns, "home", entropy("temp", "rho", gamma).alias("entropy"), F.col("block").alias("lies"))
    near = links.select(F.col("block").alias("lies"), "row_id", "face", "kind", "nbr_id")
    with together(blocks.sparkSession):
        out = whole.groupBy("lies").cogroup(near.groupBy("lies")).applyInArrow(within.sampled, schema)
    return _directed(out, kept.columns)


def _directed(out: DataFrame, columns: list[str]) -> DataFrame:
    out = out.withColumn("steep", norm("gtx", "gty", "gtz"))
    return out.select(*columns, "divv", *(f"g{k}{c}" for k in "ts" for c in "xyz"), "valid", "candidate", *(F.when(F.col("steep") > 0, F.col(f"gt{c}") / F.col("steep")).otherwise(0.0).alias(f"n{c}") for c in "xyz"))


def written(cells: DataFrame, links: DataFrame, gamma: float = GAMMA) -> DataFrame:
    """The stencil as a stage, without what only diagnostics read; unit vectors are made of the gradients when it is read, and only candidates keep these."""
    full = stencil(cells, links, gamma)
    full = full.withColumns({f"gt{c}": F.when(F.col("candidate"), F.col(f"gt{c}")) for c in "xyz"})
    lean = full.drop(*(f"{k}{c}" for k in ("gs", "n") for c in "xyz"), "vx", "vy", "vz", "mask")
    blocks = getattr(links, "blocks", None)
    kept = materialize(lean, "stencil") if blocks is None else materialize_by(lean, "stencil", "block", blocks.buckets, lies=True)
    length = norm("gtx", "gty", "gtz")
    return kept.select("*", *(F.when(length > 0, F.col(f"gt{c}") / length).otherwise(0.0).alias(f"n{c}") for c in "xyz"))
