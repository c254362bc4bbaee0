"""Distributions over Mach number and summary counters."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def log_edges(low: float, high: float, n: int = 60) -> list[float]:
    return np.logspace(math.log10(low), math.log10(high), n).tolist()


def _bin(mach: Column, logs: list[float]) -> Column:
    """Bin of log10(mach), half open but for the last; null outside. One comparison an edge inside generated code."""
    v = F.log10(mach)
    k = sum((v >= e).cast("int") for e in logs) - 1
    return F.when((v >= logs[0]) & (v <= logs[-1]), F.least(k, F.lit(len(logs) - 2)))


def _histogram(df: DataFrame, weight: Column, edges: list[float], volume: float = 1.0) -> DataFrame:
    """``(bin, center, value)`` for every bin, sum of weights over the bin's log10 width; 0 for an empty one."""
    logs = [math.log10(e) for e in edges]
    sums = df.select(_bin(F.col("mach"), logs).alias("bin"), weight.alias("w")).where("bin IS NOT NULL").groupBy("bin").agg(F.sum("w").alias("s"))
    bins = df.sparkSession.createDataFrame([(k, 10 ** ((a + b) / 2), b - a) for k, (a, b) in enumerate(zip(logs, logs[1:], strict=False))], "bin int, center double, width double")
    return bins.join(sums, "bin", "left").select("bin", "center", (F.coalesce("s", F.lit(0.0)) / F.col("width") / volume).alias("value"))


def mach_distribution(result: DataFrame, dissipation: DataFrame, mach_bins=None, min_mach: float = 1.5, volume: float | None = None, weight_field: str = "total") -> DataFrame:
    """Dissipated energy by log10 Mach number."""
    if mach_bins is not None and (min(mach_bins) <= 0 or any(b <= a for a, b in zip(mach_bins, mach_bins[1:], strict=False))):
        raise ValueError(f"edges must rise from above 0: {list(mach_bins)}")
    rows = result.select("row_id", "mach", "shock").join(dissipation.select("row_id", F.col(weight_field).alias("energy")), "row_id")
    strong = F.col("shock") & (F.col("mach") >= min_mach)
    c = rows.agg(F.count_if("shock").alias("shock"), F.count_if(strong).alias("strong"), F.count_if(F.col("energy") > 0).alias("energy"), F.max(F.when(strong & (F.col("energy") > 0), F.col("mach"))).alias("top")).first()
    if c.top is None:
        raise ValueError(f"nothing to count: {c.shock} shocks, {c.strong} of them at Mach {min_mach:g} or more, {c.energy} rows with a positive {weight_field}")
    edges = list(mach_bins) if mach_bins is not None else log_edges(min_mach, max(c.top * 1.001, min_mach * 1.01))
    return _histogram(rows.where(strong & (F.col("energy") > 0)), F.col("energy"), edges, volume or 1.0)


def surface_histogram(result: DataFrame, bins: list[float], min_mach: float = 1.5, area_factor: float = 1.19) -> DataFrame:
    """Front area by log10 Mach number."""
    return _histogram(result.where(F.col("shock") & (F.col("mach") >= min_mach)), F.col("dx") * F.col("dx") * area_factor, list(bins))


def external_internal(result: DataFrame, cells: DataFrame, threshold: float = 1.0e4, min_mach: float = 1.5) -> DataFrame:
    """``(row_id, external, internal)`` by the upstream temperature of shocks; both false elsewhere."""
    from meshfront.operators.dissipation import upstream_state

    ok = F.col("shock") & (F.col("mach") >= min_mach) & F.col("up_temp").isNotNull()
    return upstream_state(result, cells).select("row_id", (ok & (F.col("up_temp") <= threshold)).alias("external"), (ok & (F.col("up_temp") > threshold)).alias("internal"))


def shock_summary(result: DataFrame, dissipation: DataFrame) -> DataFrame:
    """Counters of a run in one pass."""
    rows = result.select("row_id", "mach", "shock").join(dissipation.select("row_id", "flux", "total"), "row_id")
    return rows.agg(
        F.count("*").alias("retained_cells"), F.count("*").alias("selected_cells"), F.count_if("shock").alias("shock_cells"), F.count_if(F.col("mach") > 0).alias("mach_positive"),
        F.count_if(F.col("shock") & (F.col("mach") >= 1.5)).alias("mach_above_1_5"), F.count_if(F.col("flux") > 0).alias("flux_positive"), F.count_if(F.col("total") > 0).alias("total_positive"),
        F.max("mach").alias("max_mach"), F.max("flux").alias("max_flux"), F.max("total").alias("max_total"),
    )
