"""Meshes: made from the driver's tables, and synthetic ones of the tests."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshfront.functions.physics import GAMMA, density_jump, temperature_jump

#: The priority whose cells are refined, and factors of the velocity pattern.
REFINED = "1-URGENT"
VELOCITY = ((37, 7919), (53, 101), (71, 307))


def side_of(n: int) -> int:
    """Edge of the smallest cube that holds n cells."""
    s = max(1, round(n ** (1 / 3)))
    while s**3 < n:
        s += 1
    while s > 1 and (s - 1) ** 3 >= n:
        s -= 1
    return s


def _orders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    df = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").cast("long").alias("id"), "o_totalprice", "o_orderpriority")
    return df, side_of(df.count())


def _fields(df: DataFrame, s: int) -> DataFrame:
    i = F.col("id")
    place = {"ix": i % s, "iy": F.floor(i / s) % s, "iz": F.floor(i / (s * s))}
    speed = {f"v{c}": ((i * i * a + i * b) % 401 - 200).cast("double") for c, (a, b) in zip("xyz", VELOCITY, strict=True)}
    return df.withColumns({**place, **speed, "T": (F.col("o_totalprice") / 5000 + 1) * 1.0e4, "rho": (F.col("o_totalprice") / 100000 + 1) * 1.0e6})


_OUT = ("row_id", "x", "y", "z", "dx", "vx", "vy", "vz", "T", "rho", "level")


def uniform_mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit cells in a cube, one for each order."""
    orders, s = _orders(spark, sf_dir)
    df = _fields(orders, s)
    return df.select(F.col("id").alias("row_id"), *((F.col(f"i{c}") + 0.5).alias(c) for c in "xyz"), F.lit(1.0).alias("dx"), "vx", "vy", "vz", "T", "rho", F.lit(0).alias("level"))


def two_level_mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of width 2, those of urgent orders replaced by eight of width 1."""
    orders, s = _orders(spark, sf_dir)
    df = _fields(orders, s)
    coarse = df.where(F.col("o_orderpriority") != REFINED)
    coarse = coarse.select((F.col("id") * 8).alias("row_id"), *((F.col(f"i{c}") * 2 + 1.0).alias(c) for c in "xyz"), F.lit(2.0).alias("dx"), "vx", "vy", "vz", "T", "rho", F.lit(0).alias("level"))
    fine = df.where(F.col("o_orderpriority") == REFINED).select("*", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("oct"))
    bits = {c: F.shiftright("oct", k).bitwiseAND(1) for k, c in enumerate("xyz")}
    more = F.col("oct") * 0.01 + 1
    fine = fine.select((F.col("id") * 8 + F.col("oct")).alias("row_id"), *((F.col(f"i{c}") * 2 + 0.5 + bits[c]).alias(c) for c in "xyz"), F.lit(1.0).alias("dx"), "vx", "vy", "vz", (F.col("T") * more).alias("T"), (F.col("rho") * more).alias("rho"), F.lit(1).alias("level"))
    return coarse.unionByName(fine)


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies at two snapshots, one for each customer, in the box of the uniform mesh."""
    _, s = _orders(spark, sf_dir)
    k = F.col("c_custkey").cast("long")
    now = [((k * a) % s).cast("double") for a in (17, 29, 43)]
    back = [(k % 5 - 2).cast("double"), F.lit(1.0), F.lit(0.0)]
    df = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return df.select(k.alias("galaxy_id"), *((n - b).alias(f"p{c}") for n, b, c in zip(now, back, "xyz", strict=True)), *(n.alias(f"c{c}") for n, c in zip(now, "xyz", strict=True)))


def mach_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("long").alias("id"), (F.col("p_partkey") / 100 + 1.0).alias("mach"))


@dataclass(frozen=True)
class Step:
    mach: float
    index: int
    temperature: float
    density: float


#: The default line of four shocks.
STEPS = (Step(8.0, 16, 1.0e4, 0.5e6), Step(3.0, 36, 2.0e6, 5.0e6), Step(2.5, 58, 3.0e6, 6.0e6), Step(6.0, 78, 1.0e4, 0.7e6))


def _line(df: DataFrame, t: Column, rho: Column, vx: Column, level: int) -> DataFrame:
    i = F.col("id")
    return df.select(
        i.alias("row_id"), (i + 0.5).alias("x"), F.lit(0.5).alias("y"), F.lit(0.5).alias("z"), F.lit(1.0).alias("dx"), vx.cast("double").alias("vx"), F.lit(0.0).alias("vy"), F.lit(0.0).alias("vz"),
        t.cast("double").alias("T"), rho.cast("double").alias("rho"), F.lit(level).alias("level"),
    )


def line_mesh(spark: SparkSession, n: int = 8, at: int = 4, level: int = 20) -> DataFrame:
    """A step of temperature 4, density 3 and opposite flows in unit cells."""
    past = F.col("id") >= at
    return _line(spark.range(n), F.when(past, 4.0e4).otherwise(1.0e4), F.when(past, 3.0).otherwise(1.0), F.when(past, -1.0).otherwise(1.0), level)


def grid_mesh(spark: SparkSession, nx: int = 10, ny: int = 4, level: int = 20) -> DataFrame:
    """Rows of cells, numbered along x first, with a step in the middle."""
    i = F.col("id")
    right = i % nx >= nx // 2
    line = _line(spark.range(nx * ny), F.when(right, 4.0e7).otherwise(1.0e7), F.when(right, 3.0e6).otherwise(1.0e6), F.when(right, -1.0).otherwise(1.0), level)
    return line.withColumns({"x": F.col("row_id") % nx + 0.5, "y": F.floor(F.col("row_id") / nx) + 0.5})


def planar_shock(spark: SparkSession, mach: float, n: int = 12, index: int | None = None, temperature: float = 1.0e4, density: float = 1.0e6, level: int = 20, gamma: float = GAMMA) -> DataFrame:
    """A Rankine-Hugoniot step along x."""
    index = n // 2 if index is None else index
    if not 2 <= index <= n - 3:
        raise ValueError("the shock must leave at least two cells on each side")
    past = F.col("id") >= index
    return _line(spark.range(n), F.when(past, temperature_jump(mach, gamma) * temperature).otherwise(temperature), F.when(past, density_jump(mach, gamma) * density).otherwise(density), F.when(past, -100.0).otherwise(100.0), level)


def multi_shock_line(spark: SparkSession, n: int = 96, steps: tuple[Step, ...] = STEPS) -> DataFrame:
    """Shocks one after another; each overwrites what lies beyond it, so the profile is made on the driver."""
    m = [s.mach**2 for s in steps]
    t_up = [(5 * x - 1) * (x + 3) / (16 * x) for x in m]  # both ratios for gamma = 5/3
    r_up = [4 * x / (x + 3) for x in m]
    t, r, v = [1.0e4] * n, [0.5e6] * n, [80.0] * n
    for s, ft, fr in zip(steps, t_up, r_up, strict=True):
        k = s.index
        hot, dense = max(t[k], s.temperature * ft), max(r[k], s.density * fr)
        t[k - 2 :], r[k - 2 :], v[k - 2 :] = [s.temperature] * 2 + [hot] * (n - k), [s.density] * 2 + [dense] * (n - k), [80.0] * 2 + [-80.0] * (n - k)
        if (e := k + 3) < n:
            t[e:], r[e:], v[e:] = [max(hot, s.temperature * 1.15)] * (n - e), [max(dense, s.density * 1.15)] * (n - e), [80.0] * (n - e)
    df = spark.createDataFrame([(i, t[i], r[i], v[i]) for i in range(n)], "id long, t double, r double, v double")
    return _line(df, F.col("t"), F.col("r"), F.col("v"), 20)


def tiled_sheet(base: DataFrame, n: int, ny: int = 16, nz: int = 1) -> DataFrame:
    """A line of n cells repeated along y and z."""
    copies = F.explode(F.sequence(F.lit(0), F.lit(ny * nz - 1)))
    df = base.select("*", copies.alias("copy"))
    return df.withColumns({"row_id": F.col("copy") * n + F.col("row_id"), "y": F.col("copy") % ny + 0.5, "z": F.floor(F.col("copy") / ny) + 0.5}).drop("copy")


def result_from_centers(spark: SparkSession, centers: list[tuple], normal=(1.0, 0.0, 0.0), dx: float = 1.0) -> DataFrame:
    """A detection result from ``(x, y, z, mach)``; those above Mach 1 are shocks without ends."""
    rows = [(i, float(m), m > 1, i if m > 1 else -1, -1, -1, float(x), float(y), float(z), dx, *map(float, normal), 0, 0.0) for i, (x, y, z, m) in enumerate(centers)]
    return spark.createDataFrame(rows, "row_id long, mach double, shock boolean, center_index long, upstream_index long, downstream_index long, x double, y double, z double, dx double, nx double, ny double, nz double, level int, zone_width double")
