"""Octrees, nearest fronts and components in dense boxes against brute force, and the plan of a round of walks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshfront.operators import detect, octree, tracks
from meshfront.plans.storage import Scratch, materialize_by


def fronts_of(spark, places):
    rows = [(i, *map(float, p), 1.0, 2.0, 3.0, 1.0, 0.0, 0.0, True) for i, p in enumerate(places)]
    return spark.createDataFrame(rows, "row_id long, x double, y double, z double, dx double, mach double, flux double, nx double, ny double, nz double, valid_normal boolean")


def test_leaves_hold_every_point_once_and_few_each(spark):
    rng = np.random.default_rng(1)
    places = np.vstack([rng.random((400, 3)), rng.random((200, 3)) * 1e-9 + 0.5, np.full((50, 3), 0.25), [[0, 0, 0], [5e-324, 0, 0]]])
    points = spark.createDataFrame([("a" if i % 2 else "b", i, *map(float, p)) for i, p in enumerate(places)], "root string, id long, x double, y double, z double")
    tree = octree.build(points, leaf=8)
    held = tree.points.groupBy("node").agg(F.count("*").alias("n"), F.countDistinct("x", "y", "z").alias("places")).collect()
    assert sum(r.n for r in held) == len(places) and all(r.n <= 8 or r.places == 1 for r in held)
    inside = tree.points.join(tree.levels[0].select(F.col("node").alias("top"), *octree.BOUNDS), F.col("node").startswith(F.col("top")))
    assert inside.where("x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 AND z BETWEEN z0 AND z1").count() == len(places)
    for above, level in zip(tree.levels, tree.levels[1:], strict=False):
        assert level.join(above.where("open").select(F.col("node").alias("parent"), F.col("n").alias("whole")), "parent").groupBy("parent", "whole").agg(F.sum("n").alias("s")).where("s <> whole").count() == 0
    assert octree.build(points.limit(0)).points.count() == 0
    tree.drop()


@pytest.mark.parametrize("spread", [1.0, 0.02, 1e-7])
def test_nearest_front_in_a_dense_box(spark, spread):
    rng = np.random.default_rng(2)
    places = np.vstack([rng.random((1500, 3)) * spread, [[0.5, 0.5, 0.5]] * 100, rng.random((200, 3)) * 4 - 2])
    bodies = np.vstack([rng.random((60, 3)) * spread, rng.random((60, 3)) * 5 - 2.5, [[0.5, 0.5, 0.5], [9, 9, 9]]])
    rows = [(i, 0.0, 0.0, 0.0, *map(float, b)) for i, b in enumerate(bodies)]
    got = {r.galaxy_id: (r.front and r.front.row_id, r.far) for r in tracks.nearest_front(spark.createDataFrame(rows, "galaxy_id long, px double, py double, pz double, cx double, cy double, cz double"), fronts_of(spark, places), 1.0).collect()}
    for i, b in enumerate(bodies):
        far = np.sqrt(((places - b) ** 2).sum(axis=1))
        if far.min() > 1:
            assert got[i] == (None, None)
        else:
            assert got[i][1] == pytest.approx(far.min(), rel=1e-12) and far[got[i][0]] == far.min() and got[i][0] == int(np.flatnonzero(far == far.min())[0])


def components_by_hand(places, length):
    root = list(range(len(places)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, p in enumerate(places):
        for j in np.flatnonzero(((places[i + 1 :] - p) ** 2).sum(axis=1) <= length * length):
            a, b = sorted((find(i), find(i + 1 + int(j))))
            root[b] = a
    return [find(i) for i in range(len(places))]


@pytest.mark.parametrize("gap", [0.9, 0.9985, 1.0, 1.0015])
def test_components_of_clumps_just_in_or_out_of_reach(spark, gap):
    rng = np.random.default_rng(3)
    ball = rng.normal(size=(600, 3))
    shell = ball / np.sqrt((ball**2).sum(axis=1))[:, None] * gap + [7, 0, 0]
    places = np.vstack([rng.random((500, 3)) * 1e-3, rng.random((500, 3)) * 1e-3 + [gap, 0, 0], rng.random((300, 3)) * 1e-3 + [7, 0, 0], shell, rng.random((100, 3)) * 12 - 14, [[3.0, 3.0, 3.0], [4.0, 3.0, 3.0], [3.0, 3.0, 3.0]]])
    order = rng.permutation(len(places))
    places = places[order]
    got = {r.row_id: r.root for r in tracks.spatial_components(fronts_of(spark, places), 1.0).collect()}
    assert [got[i] for i in range(len(places))] == components_by_hand(places, 1.0)


def test_a_round_of_walks_shuffles_the_walks_alone(spark):
    """However many walks there are, nothing but a sort lies between the written probes and the join."""
    face = "struct<face:int,slot:int,nbr_id:bigint,x:double,y:double,z:double,temp:double,rho:double,divv:double,candidate:boolean>"
    probe = spark.range(4000).selectExpr("id AS row_id", "1D AS x", "1D AS y", "1D AS z", "1D AS dx", "1D AS temp", "1D AS rho", f"CAST(array() AS array<{face}>) AS faces")
    with Scratch() as own:
        probe = materialize_by(probe, "probe", "row_id")
    state = probe.withColumnRenamed("row_id", "at")
    front = spark.range(4000).selectExpr("id AS row_id", "1 AS way", *(f"1D AS {a}{c}" for a in "pu" for c in "xyz"), f"CAST(named_struct('face', 0, 'slot', 0, 'nbr_id', id, 'x', 1D, 'y', 1D, 'z', 1D, 'temp', 1D, 'rho', 1D, 'divv', 1D, 'candidate', true) AS {face}) AS end", "CAST(NULL AS string) AS reason")
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        plans = {few: detect._hop(front, state, few)._jdf.queryExecution().executedPlan().toString() for few in (False, True)}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert plans[False].count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plans[False]
    scan = plans[False][: plans[False].index("FileScan")].splitlines()
    assert "Exchange" not in "".join(scan[-4:])
    assert plans[True].count("Exchange hashpartitioning") == 0 and "BroadcastHashJoin" in plans[True]
    table = probe.stored_as
    own.drop()
    assert not spark.catalog.tableExists(table)
