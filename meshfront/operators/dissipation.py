"""Energy dissipated at each shock cell."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshfront.functions.physics import GAMMA, KPC_IN_KM, dissipation_flux, sound_speed_cgs, surface_area, thermalization_efficiency


def upstream_state(result: DataFrame, cells: DataFrame) -> DataFrame:
    """``result`` with ``up_temp`` and ``up_rho`` of the upstream cell, null where there is none. A detection's own rows know them; of others only shock rows are joined."""
    own, full = getattr(result, "upstream", (None, None))
    if own is cells and full is not None:
        return full.drop("block")
    state = cells.select(F.col("row_id").alias("_up"), F.col("temp").alias("up_temp"), F.col("rho").alias("up_rho"))
    linked = result.where("upstream_index >= 0").join(state, F.col("upstream_index") == F.col("_up"), "left").drop("_up")
    rest = result.where("upstream_index < 0").select("*", F.lit(None).cast("double").alias("up_temp"), F.lit(None).cast("double").alias("up_rho"))
    return linked.unionByName(rest)


def compute_dissipation(cells: DataFrame, result: DataFrame, gamma: float = GAMMA, mu: float = 0.59, temperature_floor: float = 1.0e4, area_mode: str = "normal") -> DataFrame:
    """``(row_id, flux, total, area, efficiency, sound_speed)`` for each retained row; zeros where there is no shock above Mach 1 with an upstream cell."""
    face = (F.col("dx") / KPC_IN_KM) * (F.col("dx") / KPC_IN_KM)
    area = surface_area(face, ("nx", "ny", "nz"), area_mode)
    speed = sound_speed_cgs("up_temp", gamma, mu, temperature_floor)
    df = upstream_state(result, cells).withColumn("ok", F.col("shock") & (F.col("mach") > 1) & F.col("up_temp").isNotNull())
    df = df.withColumns({"efficiency": thermalization_efficiency("mach", gamma), "speed": speed})
    df = df.withColumns({"flux": dissipation_flux("up_rho", "mach", "speed", "efficiency"), "area": area})
    values = {"flux": F.col("flux"), "total": F.col("flux") * F.col("area"), "area": F.col("area"), "efficiency": F.col("efficiency"), "sound_speed": F.col("speed") / 1.0e5}
    return df.select("row_id", *(F.when(F.col("ok"), v).otherwise(0.0).alias(k) for k, v in values.items()))
