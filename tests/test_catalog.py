"""Dissipation, catalogs, quality, storage, maps, histograms and tracks."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshfront.functions.physics import KPC_IN_KM
from meshfront.operators import catalog as cat
from meshfront.operators import histograms, links, raster, tracks
from meshfront.operators.components import connected_components
from meshfront.plans.detector import Detector, MapView
from meshfront.sources import meshes, store


@pytest.fixture(scope="module")
def grid(spark):
    return Detector().analyze(meshes.grid_mesh(spark), provenance={"run": "test"})


def catalog_of(spark, centers, normal=(1.0, 0.0, 0.0), dissipation=None, **settings):
    result = meshes.result_from_centers(spark, centers, normal)
    return result, cat.build_catalog(result, links.build_links(result), None, dissipation, cat.CatalogSettings(**settings))


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (5, 5), (None, 4), (3, 1), (8, 7)], "a long, b long")
    assert sorted(map(tuple, connected_components(edges).collect())) == [(1, 1), (2, 1), (3, 1), (5, 5), (7, 7), (8, 7), (9, 7)]
    path = spark.range(400).select((F.col("id") + 1).alias("a"), F.col("id").alias("b"))
    out = connected_components(path)
    assert out.count() == 401 and out.where("component <> 0").count() == 0
    assert connected_components(edges.where("a > 100")).count() == 0
    rng = np.random.default_rng(9)
    pairs = [tuple(map(int, p)) for p in rng.integers(-300, 300, (500, 2))]
    least = {v: v for p in pairs for v in p}
    for _ in range(100):
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
    for held in (1, 50, 10_000):
        got = connected_components(spark.createDataFrame(pairs, "a long, b long").repartition(5), held=held)
        assert dict(map(tuple, got.collect())) == least


def test_local_contraction_of_many_edges(spark):
    """Ten million edges in one task: paths, hubs and chance, and the same components as by labels passed on."""
    import time

    from meshfront.operators.components import _forest

    rng = np.random.default_rng(2)
    n = 3_000_000
    path, hub = np.arange(n), np.full(n, 4 * n)
    a = np.concatenate([path[1:], hub, rng.integers(5 * n, 9 * n, 4_000_000)])
    b = np.concatenate([path[:-1], np.arange(n, 2 * n), rng.integers(5 * n, 9 * n, 4_000_000)])
    began = time.perf_counter()
    node, least = _forest(a, b)
    assert time.perf_counter() - began < 60  # some seconds on an idle machine
    of = np.arange(9 * n)
    of[node] = least
    assert (of[a] == of[b]).all() and (of[:n] == 0).all() and (of[n : 2 * n] == n).all() and of[4 * n] == n
    assert (of[least] == least).all() and (least < node).all() and len(np.unique(node)) == len(node)
    shuffled = rng.permutation(200_000)  # a path in chance order
    node, least = _forest(shuffled[1:], shuffled[:-1])
    assert len(node) == 199_999 and (least == 0).all()


def test_grid_dissipation(grid):
    rows = grid.dissipation.where("flux > 0").collect()
    assert sorted(r.row_id for r in rows) == [4, 14, 24, 34]
    for r in rows:
        assert (r.sound_speed, r.efficiency, r.flux) == pytest.approx((482.88211229, 0.336854815, 3.8992272763e41), rel=1e-8)
        assert (r.area, r.total) == pytest.approx((1.0502650403e-33, 4.0952220924e8), rel=1e-8)


def test_grid_catalog(grid):
    (g,) = grid.catalog.groups.collect()
    assert (g.group_id, g.root, g.n_centers, g.classification, g.touches_boundary) == (0, 4, 4, "internal", True)
    assert grid.catalog.metadata["run"] == "test" and grid.counts == {"retained": 40, "shock": 4, "representative": 4, "groups": 1}
    assert set(grid.timings) == {"input", "neighbors", "scan", "detection_total", "dissipation", "catalog", "total"}
    assert cat.with_centers(grid.catalog).first().center_indices == [4, 14, 24, 34]


def test_gamma_must_agree(spark):
    with pytest.raises(ValueError, match="gamma"):
        Detector(gamma=1.4).analyze(meshes.line_mesh(spark), dissipation_options={"gamma": 5 / 3})


def test_stacked_centers_make_one_group(spark):
    _, c = catalog_of(spark, [(0.5, 0.5, 0.5, 3.0), (0.5, 1.5, 0.5, 3.1), (0.5, 2.5, 0.5, 2.9)])
    (g,) = c.groups.collect()
    assert (g.mach_peak, g.n_centers, g.area_unit, g.classification) == (3.1, 3, "position_unit2", "unclassified")
    assert g.mach_mean == pytest.approx(3.0) and g.mach_std == pytest.approx(math.sqrt(0.02 / 3))
    assert g.quality_flags == ["touches_boundary", "missing_upstream"] and g.valid_upstream_fraction == 0


def test_groups_weigh_by_dissipation(spark):
    d = spark.createDataFrame([(0, 1.0, 10.0), (1, 3.0, 30.0)], "row_id long, area double, total double")
    _, c = catalog_of(spark, [(0.5, 0.5, 0.5, 2.0), (0.5, 1.5, 0.5, 4.0)], dissipation=d, mach_tolerance=1.0)
    (g,) = c.groups.collect()
    assert (g.area, g.mach_mean, g.dissipation_total, g.centroid_y, g.area_unit) == (4.0, 3.5, 40.0, 1.25, "kpc2")
    z = spark.createDataFrame([(0, 0.0, 0.0), (1, 0.0, 0.0)], "row_id long, area double, total double")
    _, c = catalog_of(spark, [(0.5, 0.5, 0.5, 2.0), (0.5, 1.5, 0.5, 4.0)], dissipation=z, mach_tolerance=1.0)
    assert c.groups.first().area == 2.0  # without any weight a group's area is its count


def test_duplicates_along_the_normal(spark):
    _, c = catalog_of(spark, [(0.5, 0.5, 0.5, 2.5), (1.5, 0.5, 0.5, 3.0), (1.5, 1.5, 0.5, 3.1)], deduplicate=True)
    rows = {r.row_id: (r.center_representative, r.group_id) for r in c.cells.collect()}
    assert [rows[i][0] for i in range(3)] == [1, 1, 2] and rows[0][1] == -1 and rows[1][1] == rows[2][1] == 0


def test_thresholds_split_groups_and_order_them(spark):
    _, c = catalog_of(spark, [(0.5, 0.5, 0.5, 3.0), (0.5, 1.5, 0.5, 5.0)])
    assert {r.group_id: r.mach_peak for r in c.groups.collect()} == {0: 5.0, 1: 3.0}
    _, c = catalog_of(spark, [(0.5, 0.5, 0.5, 1.0), (0.5, 1.5, 0.5, 1.4)])
    assert c.groups.count() == 1 and c.cells.where("group_id < 0").count() == 1


@pytest.mark.parametrize("setting", [{"boundary": "x"}, {"mach_tolerance": -1}, {"normal_cosine": 2}, {"duplicate_normal_cosine": -1}, {"min_mach": 0.5}, {"external_temperature": 0}, {"classification_fraction": 0.4}, {"boundary_margin_cells": -1}, {"minimum_group_centers": 0}, {"maximum_normal_dispersion": 2}])
def test_bad_catalog_settings(spark, setting):
    with pytest.raises(ValueError):
        cat.CatalogSettings(**setting).check()


def test_sensitivity_and_quality(spark, grid):
    rows = cat.sensitivity(grid.result.rows, grid.result.links, grid.dissipation, (0.2, 0.5), (0.7,)).collect()
    assert [(r.n_input_centers, r.n_representative_centers, r.n_groups) for r in rows] == [(4, 4, 1)] * 2
    grown = [(0.5, 0.5 + i, 0.5, m) for i, m in enumerate((2.0, 2.1, 2.9, 1.4, 1.5, 5.0, 5.2, 9.0))] + [(1.5, 0.5, 0.5, 3.0), (1.5, 6.5, 0.5, 1.35)]
    result = meshes.result_from_centers(spark, grown)
    near = links.build_links(result)
    for dedup, machs in ((True, (1.3, 1.45)), (False, (1.3,))):
        for r in cat.sensitivity(result, near, None, (0.05, 0.3), (0.9,), (0.9,), machs, dedup).collect():
            c = cat.build_catalog(result, near, None, None, cat.CatalogSettings(r.mach_tolerance, r.normal_cosine, dedup, r.duplicate_normal_cosine, r.min_mach))
            own = c.cells.agg(F.count_if(F.col("center_representative") >= 0), F.count_if(F.col("center_representative") == F.col("row_id"))).first()
            g = c.groups.agg(F.count("*"), F.sum("area"), F.max("mach_peak"), F.sum(F.col("area") * F.col("mach_mean")) / F.sum("area")).first()
            assert (r.n_input_centers, r.n_representative_centers, r.n_groups) == (*own, g[0])
            assert (r.surface_area, r.mach_peak, r.mach_mean) == pytest.approx(tuple(g)[1:])
    s = cat.quality_summary(grid.catalog.groups).first()
    assert (s.n_groups, s.n_complete, s.n_boundary) == (1, 0, 1)
    assert [tuple(r) for r in cat.quality_counts(grid.catalog.groups).collect()] == [("classification", "internal", 1), ("flag", "touches_boundary", 1)]


def test_catalog_round_trip(spark, grid, tmp_path):
    path = store.save_catalog(f"file://{tmp_path}/c", grid.catalog)
    back = store.load_catalog(spark, path)
    assert sorted(back.groups.collect()) == sorted(grid.catalog.groups.collect()) and sorted(back.cells.collect()) == sorted(grid.catalog.cells.collect())
    assert back.metadata == grid.catalog.metadata
    spark.createDataFrame([(7, "{}")], "schema_version int, metadata_json string").write.mode("overwrite").parquet(f"{path}/metadata")
    with pytest.raises(ValueError, match="version 7"):
        store.load_catalog(spark, path)
    spark.createDataFrame([(2, "{}")], "schema_version int, metadata_json string").write.mode("overwrite").parquet(f"{path}/metadata")
    grid.catalog.groups.drop("mach_std").write.mode("overwrite").parquet(f"{path}/groups")
    with pytest.raises(ValueError, match="mach_std"):
        store.load_catalog(spark, path)
    grid.catalog.groups.withColumn("n_centers", F.lit(9).cast("long")).write.mode("overwrite").parquet(f"{path}/groups")
    with pytest.raises(ValueError, match="n_centers"):
        store.load_catalog(spark, path)


def test_csv(spark, grid, tmp_path):
    df = spark.read.csv(store.save_csv(f"file://{tmp_path}/s", grid.catalog), header=True)
    assert tuple(df.columns) == store.CSV_COLUMNS and len(store.CSV_COLUMNS) == 36 and df.first().quality_flags == "touches_boundary"


def test_old_archives(spark, tmp_path):
    v1 = {
        "schema_version": np.int32(1), "cell_group_id": np.array([0, 0, -1]), "center_representative": np.array([0, 1, -1]), "group_ids": np.array([0]), "center_offsets": np.array([0, 2]), "center_indices": np.array([0, 1]), "n_centers": np.array([2]),
        "mach_peak": np.array([3.0]), "mach_mean": np.array([2.5]), "area": np.array([2.0]), "area_unit": np.array(["kpc2"]), "dissipation_total": np.array([1.0]), "centroid": np.zeros((1, 3)), "mean_normal": np.ones((1, 3)), "bounds": np.zeros((1, 2, 3)),
        "level_min": np.array([1]), "level_max": np.array([3]), "upstream_temperature": np.array([1e4]), "upstream_density": np.array([1.0]), "external_fraction": np.array([0.3]), "classification": np.array(["mixed"]),
    }
    np.savez(tmp_path / "v1.npz", **v1)
    c = store.import_npz(spark, str(tmp_path / "v1.npz"))
    g = c.groups.first()
    assert c.metadata == {"loaded_from_schema": 1} and g.quality_flags == ["legacy_schema"] and not g.is_complete and g.level_count == 3 and g.classification_confidence == 0.7
    for key, value, message in (("center_offsets", np.array([0, 1]), "offsets"), ("n_centers", np.array([1]), "counts"), ("centroid", np.zeros((2, 3)), "shape"), ("schema_version", np.int32(9), "version")):
        np.savez(tmp_path / "bad.npz", **(v1 | {key: value}))
        with pytest.raises(ValueError, match=message):
            store.import_npz(spark, str(tmp_path / "bad.npz"))
    np.savez(tmp_path / "bad.npz", **{k: v for k, v in v1.items() if k != "area"})
    with pytest.raises(ValueError, match="area"):
        store.import_npz(spark, str(tmp_path / "bad.npz"))


def test_archive_round_trip(spark, grid, tmp_path):
    for compressed in (True, False):
        back = store.import_npz(spark, store.export_npz(f"{tmp_path}/c{compressed}.npz", grid.catalog, compressed))
        plain = lambda g: [{k: (round(v, 12) if isinstance(v, float) and v == v else str(v)) for k, v in r.asDict().items() if k != "root"} for r in g.orderBy("group_id").collect()]
        nulls = grid.catalog.groups.select(*(F.coalesce(c, F.lit(float("nan"))).alias(c) if t == "double" else F.col(c) for c, t in grid.catalog.groups.dtypes))
        assert plain(back.groups) == plain(nulls) and back.metadata == grid.catalog.metadata
        assert back.cells.orderBy("row_id").select("group_id").collect() == grid.catalog.cells.orderBy("row_id").select("group_id").collect()
        assert not store.group_faults(back.groups, back.cells)
    empty = catalog_of(spark, [(0.5, 0.5, 0.5, 1.0)], min_mach=2.0)[1]
    assert store.import_npz(spark, store.export_npz(f"{tmp_path}/none.npz", empty)).groups.count() == 0


def test_cells_from_arrays(spark, tmp_path):
    columns = {c: np.arange(5, dtype=float) + k for k, c in enumerate(("x", "y", "z"))} | {"level": np.full(5, 3, np.int32)}
    for c, v in columns.items():
        np.save(tmp_path / f"{c}.npy", v)
    df = store.import_npy(spark, {c: f"{tmp_path}/{c}.npy" for c in columns})
    assert [tuple(r) for r in df.orderBy("row_id").collect()] == [(k, k, k + 1.0, k + 2.0, 3) for k in range(5)]
    np.save(tmp_path / "x.npy", np.zeros(4))
    with pytest.raises(ValueError, match="shape"):
        store.import_npy(spark, {c: f"{tmp_path}/{c}.npy" for c in columns})


def test_metadata_is_json(grid):
    assert json.loads(json.dumps(grid.catalog.metadata))["mach_tolerance"] == 0.3


def cells(spark, rows):
    return spark.createDataFrame([tuple(map(float, r)) for r in rows], "h double, v double, dx double, value double, weight double")


def pixels(df):
    return {(r.iy, r.ix): r.value for r in df.collect()}


def test_rasters(spark):
    two = cells(spark, [(0.5, 0.5, 1, 2, 9), (0.5, 0.5, 1, 10, 1)])
    assert pixels(raster.cells_to_map(two, 1, (0, 1, 0, 1), "mean", True)) == {(0, 0): pytest.approx(2.8)}
    assert pixels(raster.points_to_map(two, 1, (0, 1, 0, 1), "mean", True)) == {(0, 0): pytest.approx(2.8)}
    assert pixels(raster.cells_to_map(cells(spark, [(0.5, 0.5, 0.5, 8, 1)]), 1, (0, 1, 0, 1), "sum")) == {(0, 0): 2.0}
    one = cells(spark, [(0.5, 0.5, 1, 3, 1)])
    assert pixels(raster.cells_to_map(one, 2, (0, 1, 0, 1), "mean")) == {(i, j): 3.0 for i in (0, 1) for j in (0, 1)}
    assert len(pixels(raster.points_to_map(one, 2, (0, 1, 0, 1), "mean"))) == 1
    assert pixels(raster.points_to_map(cells(spark, [(1.0, 0.5, 1, 3, 1), (0.2, 0.2, 1, 0, 1)]), 1, (0, 1, 0, 1), "sum")) == {}
    assert raster.densified(raster.points_to_map(one, (2, 3), (0, 1, 0, 1)), (2, 3)).where(F.isnan("value")).count() == 5
    with pytest.raises(ValueError):
        raster.cells_to_map(one, 2, (0, 0, 0, 1))
    assert raster.cells_to_map(one.limit(0), 2, (0, 0, 0, 1)).count() == 0
    for bad in ({"statistic": "min"}, {"method": "x"}, {"plane": "zz"}, {"weights": "mach"}, {"weights": "none", "statistic": "mean"}, {"bins": (1, 2, 3)}):
        with pytest.raises(ValueError):
            raster.mach_map(meshes.result_from_centers(spark, [(0.5, 0.5, 0.5, 2.0)]), **bad).collect()


def covered_by_hand(rows, bins, extent):
    """Sums over all pixels of all cells: ``(iy, ix)`` to greatest value, product and share."""
    (ny, nx), (x0, x1, y0, y1), out = bins, extent, {}
    sx, sy = (x1 - x0) / nx, (y1 - y0) / ny
    for h, v, dx, value, weight in rows:
        low, high = (h - dx / 2, v - dx / 2), (h + dx / 2, v + dx / 2)
        for iy in range(max(0, int(np.floor((low[1] - y0) / sy))), min(ny, int(np.ceil((high[1] - y0) / sy)))):
            for ix in range(max(0, int(np.floor((low[0] - x0) / sx))), min(nx, int(np.ceil((high[0] - x0) / sx)))):
                share = weight * (min(high[0], x0 + (ix + 1) * sx) - max(low[0], x0 + ix * sx)) * (min(high[1], y0 + (iy + 1) * sy) - max(low[1], y0 + iy * sy))
                top, product, total = out.get((iy, ix), (-np.inf, 0.0, 0.0))
                out[iy, ix] = max(top, value), product + value * share, total + share
    return out


@pytest.mark.parametrize("bins", [(24, 40), (33, 7), (1, 64)])
def test_footprints_against_pixels(spark, bins):
    """Cells from a part of a pixel to wider than the map, some of them aligned with pixels."""
    rng, extent = np.random.default_rng(3), (-2.0, 6.0, 1.0, 9.0)
    rows = [(*rng.uniform(-3, 10, 2), 12.0 * rng.uniform() ** 4, *rng.uniform(1, 9, 2)) for _ in range(150)]
    rows += [(x + 0.5, 3.5, 1.0, 2.0, 1.0) for x in range(-3, 7)] + [(2.0, 5.0, 8.0, 1.0, 2.0), (2.0, 5.0, 40.0, 1.5, 1.0)]
    rows = [tuple(map(float, r)) for r in rows]
    want = covered_by_hand(rows, bins, extent)
    df = cells(spark, rows)
    assert pixels(raster.cells_to_map(df, bins, extent)) == {k: w[0] for k, w in want.items()}
    assert pixels(raster.cells_to_map(df, bins, extent, "mean", True)) == pytest.approx({k: w[1] / w[2] for k, w in want.items() if w[2] > 0}, rel=1e-9)
    unit = 64.0 / bins[0] / bins[1]
    assert pixels(raster.cells_to_map(df, bins, extent, "sum", True)) == pytest.approx({k: w[1] / unit for k, w in want.items() if w[2] > 0}, rel=1e-9)


def test_a_wide_cell_makes_few_rows(spark):
    """A footprint of 4096 by 4096 pixels, off the pixels' borders; a thousand of them fold into one another before they are spread."""
    grid = raster.Grid.of(4100, (0.0, 4100.0, 0.0, 4100.0))
    one = cells(spark, [(2050.3, 2049.6, 4095.1, 5, 1)])
    blocks = raster._footprints(one, grid)
    pixels_ = F.expr("sum(shiftleft(1L, x_level) * shiftleft(1L, y_level))")
    n, area, covered = blocks.agg(F.count("*"), F.sum(F.col("share") * F.expr("shiftleft(1L, x_level) * shiftleft(1L, y_level)")), pixels_).first()
    assert n < 1000 and covered == 4096 * 4096 and area == pytest.approx(4095.1**2, rel=1e-12)
    many = spark.range(1000).select(F.lit(64.0).alias("h"), F.lit(64.0).alias("v"), (F.lit(100.0) + F.col("id") % 10).alias("dx"), F.col("id").cast("double").alias("value"), F.lit(1.0).alias("weight"))
    got = pixels(raster.cells_to_map(many, 128, (0, 128, 0, 128)))
    assert len(got) == 110 * 110 and got[64, 64] == 999.0 and got[9, 9] == 999.0


def test_maps_facade(spark, grid):
    detector = Detector()
    found = detector.find(meshes.grid_mesh(spark))
    m = detector.maps(found, MapView(bins=(4, 10)))
    assert m.extent == (0.0, 10.0, 0.0, 4.0) and set(pixels(m.mach)) == {(i, 4) for i in range(4)} == set(pixels(m.flux))
    assert pixels(detector.maps(grid, MapView(bins=(4, 10))).flux) == pixels(m.flux)
    again = detector.maps(grid, MapView(bins=(4, 10), z_center=99.0, z_width=1.0))
    assert pixels(again.mach) == {}


def test_histograms(spark, grid):
    edges = [1.0, 2.0, 4.0, 8.0]
    rows = histograms.mach_distribution(grid.result.rows, grid.dissipation, edges).orderBy("bin").collect()
    total = grid.dissipation.agg(F.sum("total")).first()[0]
    assert [r.value for r in rows] == pytest.approx([0, total / math.log10(2), 0])
    assert histograms.mach_distribution(grid.result.rows, grid.dissipation).count() == 59
    one = meshes.result_from_centers(spark, [(0.5, 0.5, 0.5, 4.0)])
    assert [r.value for r in histograms.surface_histogram(one, [2.0, 4.0]).collect()] == pytest.approx([1.19 / math.log10(2)])
    with pytest.raises(ValueError, match="4 shocks"):
        histograms.mach_distribution(grid.result.rows, grid.dissipation, min_mach=9.0)
    with pytest.raises(ValueError, match="rise"):
        histograms.mach_distribution(grid.result.rows, grid.dissipation, [2.0, 1.0])
    s = histograms.external_internal(grid.result.rows, grid.result.cells).where("internal").count()
    assert s == 4 and histograms.shock_summary(grid.result.rows, grid.dissipation).first().shock_cells == 4


@pytest.mark.parametrize(("gap", "n"), [(0.99, 1), (1.01, 2)])
def test_dense_boxes_are_linked_by_their_parts(spark, gap, n):
    """50,000 points in two clouds whose nearest points are ``gap`` apart: no list of pairs is made."""
    rng = np.random.default_rng(3)
    side = rng.random((2, 25_000, 3)) * [0.3, 0.5, 0.5]
    side[0, 0], side[1, 0] = (0.3, 0.2, 0.2), (0.0, 0.2, 0.2)  # the nearest ones
    side[1, :, 0] += 0.3 + gap
    rows = np.vstack(side)
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(rows)], "row_id long, x double, y double, z double")
    assert sorted(r["root"] for r in tracks.spatial_components(df, 1.0).select("root").distinct().collect()) == [0, 25_000][:n]


def test_nearest_front_in_dense_boxes(spark):
    rng = np.random.default_rng(4)
    pts = np.vstack([rng.random((3000, 3)) * 0.2 - 0.1, rng.random((300, 3)) * 6 - 3, [[1.0, 1.0, 1.0]] * 3])
    fronts = spark.createDataFrame([(i, *map(float, p), 1.0, 2.0, 1.0, 1.0, 0.0, 0.0, True) for i, p in enumerate(pts)], "row_id long, x double, y double, z double, dx double, mach double, flux double, nx double, ny double, nz double, valid_normal boolean")
    where = np.vstack([rng.random((200, 3)) * 7 - 3.5, rng.random((200, 3)) * 0.3 - 0.15, [[1.0, 1.0, 1.0], [-9.0, 0.0, 0.0], [0.0, 0.0, 0.0]]])
    bodies = spark.createDataFrame([(i, 0.0, 0.0, 0.0, *map(float, p)) for i, p in enumerate(where)], "galaxy_id long, px double, py double, pz double, cx double, cy double, cz double")
    got = {r.galaxy_id: (r.front.row_id, r.far) if r.front else None for r in tracks.nearest_front(bodies, fronts, 0.8).collect()}
    for i, p in enumerate(where):
        far = np.sqrt(((pts - p) ** 2).sum(axis=1))
        k = int(np.argmin(far))
        assert got[i] == ((k, pytest.approx(far[k])) if far[k] <= 0.8 else None)


def test_spatial_components_and_extent_against_brute_force(spark):
    rng = np.random.default_rng(5)
    pts = np.vstack([rng.normal(0, 1, (60, 3)) * [4, 1, 1], rng.normal(30, 1, (40, 3)), [[100, 100, 100]]])
    rows = [(i, *map(float, p), 1.0) for i, p in enumerate(pts)]
    fronts = spark.createDataFrame(rows, "row_id long, x double, y double, z double, flux double")
    got = {r.row_id: r.root for r in tracks.spatial_components(fronts, 1.7).collect()}
    label = list(range(len(pts)))
    for _ in pts:
        for i, p in enumerate(pts):
            near = np.flatnonzero(((pts - p) ** 2).sum(axis=1) <= 1.7**2)
            label[i] = min(label[j] for j in near)
    assert [got[i] for i in range(len(pts))] == label
    labels = spark.createDataFrame(list(got.items()), "row_id long, root long")
    for r in tracks.component_extents(fronts, labels).collect():
        own = pts[[i for i in got if got[i] == r.root]]
        want = 0.0 if len(own) < 2 else np.ptp((own - own.mean(0)) @ np.linalg.svd(own - own.mean(0), full_matrices=False)[2][0])
        assert r.extent == pytest.approx(want) and r.size == len(own)
    assert tracks.filter_large_fronts(fronts, 1.7, 10**6).count() == 0


def test_axes_against_eigenvectors(spark):
    """Chance matrices, near-equal eigenvalues, planes, lines and nothing at all; no Python runs."""
    rng = np.random.default_rng(8)
    spectra = [(1, 1 - g, 0.3) for g in (1e-1, 1e-3, 2e-6)] + [(1e40, 5e39, 0), (7, 0, 0), (1, 1, 0.2), (1, 1, 1), (0, 0, 0), (3e-12, 1e-12, 0)] + [tuple(sorted(rng.uniform(0, 9, 3), reverse=True)) for _ in range(40)]
    rows, want = [], {}
    for i, spectrum in enumerate(spectra):
        q = np.linalg.qr(rng.normal(size=(3, 3)))[0]
        m = q @ np.diag(spectrum) @ q.T
        rows.append((i, [float(m[j, k]) for j, k in ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))]))
        want[i] = q[:, 0], (spectrum[0] - spectrum[1]) / spectrum[0] if spectrum[0] else 0.0
    out = tracks._principal(spark.createDataFrame(rows, "id long, cov array<double>"))
    assert "Python" not in out._jdf.queryExecution().toString() and "Arrow" not in out._jdf.queryExecution().toString()
    for r in out.collect():
        axis, gap = want[r.id]
        assert r.gap == pytest.approx(gap, abs=1e-7)
        if gap > 1e-6:
            assert abs(np.dot(axis, r.axis)) == pytest.approx(1, abs=1e-8) and np.linalg.norm(r.axis) == pytest.approx(1, rel=1e-12)


def test_crossings(spark):
    fronts = spark.createDataFrame([(7, 0.0, 0.0, 0.0, 1.0, 3.0, 5.0, 1.0, 0.0, 0.0, True), (9, 50.0, 0.0, 0.0, 1.0, 3.0, 5.0, 0.0, 0.0, 0.0, False)], "row_id long, x double, y double, z double, dx double, mach double, flux double, nx double, ny double, nz double, valid_normal boolean")
    t = spark.createDataFrame([(0, -1.0, 0.5, 0.0, 1.0, 0.5, 0.0), (1, 2.0, 0.0, 0.0, 1.0, 0.0, 0.0), (2, 500.0, 0.0, 0.0, 500.0, 0.0, 0.0), (3, 49.0, 0.0, 0.0, 51.0, 0.0, 0.0), (4, -1.0, 8.0, 0.0, 1.0, 8.0, 0.0)], "galaxy_id long, px double, py double, pz double, cx double, cy double, cz double")
    out = tracks.classify_crossings(t, fronts, 10.0)
    rows = {r.galaxy_id: r for r in out.collect()}
    assert [(rows[i].near_shock, rows[i].crossed, rows[i].nearest_shock_row) for i in range(5)] == [(True, True, 7), (True, False, 7), (False, False, -1), (False, False, -1), (True, False, 7)]
    assert rows[0].signed_distance_prev == -1.0 and rows[0].transverse_distance == pytest.approx(0.5) and rows[2].distance_to_shock is None
    assert len(out.columns) == 13 and rows[0].nearest_component_id == -1
    assert [r.galaxy_index for r in tracks.compact(out, "crossed").collect()] == [0] and tracks.compact(out, None).count() == 5
    assert tracks.classify_crossings(t, fronts.limit(0), 10.0).where("near_shock").count() == 0
    with pytest.raises(ValueError):
        tracks.compact(out, "other")
    assert tracks.front_catalog  # distances default to kiloparsecs in km
    assert KPC_IN_KM == pytest.approx(3.0856775814913673e16)
