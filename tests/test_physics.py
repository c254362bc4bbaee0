"""Jump relations, efficiency and image scaling against known values."""

import math

import pytest
from pyspark.sql import functions as F

from meshfront.functions import physics as P

JUMPS = {1.5: (1.494791667, 1.714285714), 2.0: (2.078125, 2.285714286), 3.0: (3.666666667, 3.0), 5.0: (8.68, 3.571428571), 10.0: (32.123125, 3.883495146)}
EFFICIENCY = {1.5: 0.049936662, 2.0: 0.154319086, 3.0: 0.317316569, 5.0: 0.456733719, 10.0: 0.533744145, 100.0: 0.562204016}


def table(spark, values):
    return spark.createDataFrame([(float(v),) for v in values], "m double")


@pytest.mark.parametrize("gamma", [1.4, 1.5, 5 / 3])
def test_mach_inverts_the_temperature_jump(spark, gamma):
    rows = table(spark, [1.0, 1.01, 1.5, 3, 8, 50]).select("m", P.mach_from_temperature_jump(P.temperature_jump("m", gamma), gamma).alias("b")).collect()
    assert all(math.isclose(r.m, r.b, rel_tol=1e-9) for r in rows)


def test_jump_values(spark):
    rows = table(spark, JUMPS).select("m", P.temperature_jump("m").alias("t"), P.density_jump("m").alias("r"), P.mach_from_jump_monatomic(P.temperature_jump("m")).alias("c")).collect()
    for r in rows:
        assert (r.t, r.r) == pytest.approx(JUMPS[r.m], rel=1e-8)
        assert r.c == pytest.approx(r.m)


def test_efficiency(spark):
    rows = table(spark, [*EFFICIENCY, 0.5, 1.0]).select("m", P.thermalization_efficiency("m").alias("e")).collect()
    for r in rows:
        assert r.e == pytest.approx(EFFICIENCY.get(r.m, 0.0), abs=2e-8)  # the table has nine places at best


def test_area_modes(spark):
    df = spark.createDataFrame([(4.0, 1.0, 0.0, 0.0), (4.0, 0.6, 0.8, 0.0), (4.0, 0.0, 0.0, 0.0)], "a double, x double, y double, z double")
    assert [r[0] for r in df.select(P.surface_area("a", ("x", "y", "z"))).collect()] == [4.0, 5.0, 4.0]
    assert [r[0] for r in df.select(P.surface_area("a", ("x", "y", "z"), "cell")).collect()] == [4.0] * 3
    with pytest.raises(ValueError):
        P.surface_area("a", ("x", "y", "z"), "other")


def test_entropy_needs_positive_state(spark):
    df = spark.createDataFrame([(8.0, 8.0), (0.0, 1.0), (1.0, -1.0)], "t double, r double")
    assert [r[0] for r in df.select(P.entropy("t", "r")).collect()] == pytest.approx([2.0, 0.0, 0.0])


def test_normalized(spark):
    df = spark.createDataFrame([(1.0,), (10.0,), (1e9,), (0.0,), (float("nan"),)], "v double")
    out = [r[0] for r in df.select(P.normalized("v", 0.0, 2.0, log=True)).collect()]
    assert out[:3] == [0.0, 0.5, 1.0] and out[3:] == [None, None]
    assert df.select(P.normalized("v", 5.0, 5.0)).first()[0] == 0.0
    stretched = df.where(F.col("v") == 10).select(P.normalized("v", 0.0, 2.0, log=True, stretch=4.0)).first()[0]
    assert stretched == pytest.approx(math.asinh(2) / math.asinh(4))


def test_plane():
    assert P.projected("yz") == ("y", "z", "x")
    with pytest.raises(ValueError):
        P.projected("zx")
