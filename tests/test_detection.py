"""Cells, links, detection and diagnostics on small meshes."""

import threading
import warnings
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from meshfront.operators import detect, links
from meshfront.plans import storage
from meshfront.plans.detector import Detector
from meshfront.plans.settings import Settings
from meshfront.sources import cells, meshes

CELL = "row_id long, x double, y double, z double, dx double, level int"


def geometry(spark, rows):
    return spark.createDataFrame(rows, CELL)


def found_links(df):
    return {(r.row_id, r.face, r.slot): (r.kind, r.nbr_id) for r in links.build_links(df).collect()}


def shocks(detection):
    return {r.row_id: r for r in detection.rows.where("shock").collect()}


@pytest.mark.parametrize("setting", [{"gamma": 1.0}, {"gamma": float("nan")}, {"temperature_floor": 0.0}, {"min_mach": 0.5}, {"max_steps": -1}, {"max_steps": True}, {"max_steps": 1.5}, {"max_center_steps": 0}, {"center_normal_cosine": 1.1}, {"center_plateau_tolerance": -1.0}, {"minlevel": 5, "maxlevel": 4}, {"boundary": "periodic"}, {"progress_interval": -1}])
def test_bad_settings(setting):
    with pytest.raises(ValueError):
        Settings(**setting).check()


def test_many_steps_only_warn():
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        Settings(max_steps=51).check()
    assert [w.category for w in seen] == [RuntimeWarning]


def test_level_filter_and_mask(spark):
    levels = [12, 13, 13, 14, 14, 20, 21, 22]
    base = meshes.line_mesh(spark).withColumn("level", F.element_at(F.array(*map(F.lit, levels)), (F.col("row_id") + 1).cast("int")))
    kept = cells.prepare(base.withColumn("dx", F.lit(1.0)), Detector(minlevel=13, maxlevel=20))
    assert sorted(r.row_id for r in kept.collect()) == [1, 2, 3, 4, 5]
    masked = cells.prepare(meshes.line_mesh(spark), Detector(min_temperature=2.0e4, max_density=3.0))
    assert masked.count() == 8 and masked.where("mask").count() == 4


def test_names_and_units(spark):
    df = meshes.line_mesh(spark).withColumnRenamed("T", "temperature").withColumnRenamed("rho", "rho [Msol/kpc3]").withColumnRenamed("level", "refinement_level")
    assert cells.canonical(df, Settings()).count() == 8
    with pytest.raises(KeyError, match="vx"):
        cells.canonical(df.drop("vx"), Settings())


@pytest.mark.parametrize(("column", "value"), [("level", 0.5), ("level", None), ("vx", float("nan")), ("dx", 0.0), ("rho", None)])
def test_bad_cells(spark, column, value):
    df = meshes.line_mesh(spark).withColumn(column, F.when(F.col("row_id") == 3, F.lit(value).cast("double")).otherwise(F.col(column).cast("double")))
    with pytest.raises(ValueError):
        cells.prepare(df, Settings())


def test_two_refinement_jumps_are_rejected(spark):
    df = meshes.line_mesh(spark).withColumn("dx", F.when(F.col("row_id") == 3, 4.0).otherwise(1.0))
    with pytest.raises(ValueError, match="one refinement jump"):
        cells.prepare(df, Settings())


def test_coarse_and_fine_links(spark):
    rows = [(0, 1.0, 1.0, 1.0, 2.0, 0)] + [(1 + 2 * j + k, 2.5, 0.5 + j, 0.5 + k, 1.0, 1) for j in (0, 1) for k in (0, 1)]
    got = found_links(geometry(spark, rows))
    assert {k: v for k, v in got.items() if k[0] == 0} == {(0, 1, s): ("fine", 1 + s) for s in range(4)}
    assert all(got[(i, 0, 0)] == ("coarse", 0) for i in range(1, 5))


def test_same_width_at_another_level_is_no_neighbour(spark):
    assert found_links(geometry(spark, [(0, 0.5, 0.5, 0.5, 1.0, 0), (1, 1.5, 0.5, 0.5, 1.0, 1)])) == {}


def test_links_against_brute_force(spark):
    """A random two-level mesh: every face link follows from where boxes touch."""
    import random

    rng, rows = random.Random(3), []
    for i in range(4):
        for j in range(4):
            for k in range(3):
                if rng.random() < 0.4:
                    rows += [(2 * i + a + 0.5, 2 * j + b + 0.5, 2 * k + c + 0.5, 1.0, 1) for a in (0, 1) for b in (0, 1) for c in (0, 1)]
                elif rng.random() < 0.9:
                    rows.append((2 * i + 1.0, 2 * j + 1.0, 2 * k + 1.0, 2.0, 0))
    rng.shuffle(rows)
    rows = [(n, *r) for n, r in enumerate(rows)]
    lo = min(r[1] - r[4] / 2 for r in rows), min(r[2] - r[4] / 2 for r in rows), min(r[3] - r[4] / 2 for r in rows)
    assert lo == (0, 0, 0)  # aligned with the coarse lattice
    want = set()
    for p in rows:
        for q in rows:
            for a in range(3):
                touch = [abs(abs(p[1 + c] - q[1 + c]) - (p[4] + q[4]) / 2) < 1e-9 for c in range(3)]
                over = [abs(p[1 + c] - q[1 + c]) < (p[4] + q[4]) / 2 - 1e-9 for c in range(3)]
                if touch[a] and all(over[c] for c in range(3) if c != a):
                    want.add((p[0], 2 * a + (q[1 + a] > p[1 + a]), q[0]))
    got = {(r.row_id, r.face, r.nbr_id) for r in links.build_links(geometry(spark, rows)).collect()}
    assert got == want


def test_link_cache_is_used_and_depends_on_geometry_alone(spark, tmp_path, monkeypatch):
    finder, calls = Detector(neighbor_cache_dir=f"file://{tmp_path}"), []
    build = links.build_links
    monkeypatch.setattr(links, "build_links", lambda c: calls.append(1) or build(c))
    for mesh in (meshes.line_mesh(spark), meshes.line_mesh(spark).withColumn("T", F.col("T") * 2)):
        c = cells.prepare(mesh, finder)
        assert links.cached_links(c, finder.neighbor_cache_dir).count() == 14
    assert calls == [1]
    moved = cells.prepare(meshes.line_mesh(spark).withColumn("x", F.col("x") + 1), finder)
    assert links.digest(moved) != links.digest(c)


def test_a_cache_built_twice_at_once_is_published_once(spark, tmp_path, monkeypatch):
    """Both builders find no set, both write one; the second to publish reads the first's, whose files stay as they are."""
    finder, folder = Detector(), f"file://{tmp_path}"
    c = cells.prepare(meshes.line_mesh(spark), finder)
    both, build = threading.Barrier(2, timeout=120), links.build_links

    def slow(cells_):
        both.wait()
        return build(cells_)

    monkeypatch.setattr(links, "build_links", slow)
    with ThreadPoolExecutor(2) as pool:
        found = [f.result() for f in [pool.submit(links.cached_links, c, folder) for _ in range(2)]]
    monkeypatch.setattr(links, "build_links", build)
    assert [f.count() for f in found] == [14, 14] and len({tuple(f.inputFiles()) for f in found}) == 1
    assert [p.name for p in tmp_path.iterdir() if p.is_dir()] == [f"links-{links.digest(c)}"]
    assert not [p for p in next(tmp_path.iterdir()).iterdir() if p.is_dir()]
    own = tmp_path / "_late"
    own.mkdir()
    (own / "part").write_text("x")
    target = f"{folder}/links-{links.digest(c)}"
    assert not storage.publish(spark, f"{folder}/_late", target) and not own.exists() and links.cached_links(c, folder).count() == 14


def test_line(spark):
    finder = Detector()
    found = finder.find(meshes.line_mesh(spark))
    own = shocks(found)
    assert list(own) == [3]
    r = own[3]
    assert (r.upstream_index, r.downstream_index, r.zone_width, r.nx, r.center_index) == (2, 5, 3.0, 1.0, 3)
    assert r.mach == pytest.approx(3.171694224900851, rel=1e-12)
    assert finder.diagnose(found).first().asDict() == dict.fromkeys(detect.COUNTERS, 0) | {"nonconverging_exit": 2}


def test_planar_shocks_recover_the_mach_number(spark):
    df = meshes.planar_shock(spark, 3.0, 18, 9).withColumn("y", F.lit(0.5))
    for k, m in enumerate((1.5, 2.0, 5.0, 10.0), 1):
        more = meshes.planar_shock(spark, m, 18, 9).withColumns({"row_id": F.col("row_id") + 100 * k, "y": F.lit(0.5 + 10 * k)})
        df = df.unionByName(more)
    own = shocks(Detector().find(df))
    assert {i: round(r.mach, 9) for i, r in own.items()} == {8: 3.0, 108: 1.5, 208: 2.0, 308: 5.0, 408: 10.0}
    assert all((r.upstream_index, r.downstream_index) == (i - 1, i + 2) for i, r in own.items())


def test_no_shock_without_convergence_or_jump(spark):
    base = meshes.planar_shock(spark, 3.0, 12)
    contact, rarefaction = base.withColumn("vx", F.lit(0.0)), base.withColumn("vx", -F.col("vx"))
    mismatch = base.withColumn("rho", F.lit(4.0e6) - F.col("rho"))
    for df in (contact, rarefaction, mismatch):
        assert not shocks(Detector().find(df))
    assert not shocks(Detector(min_mach=1.5).find(meshes.planar_shock(spark, 1.3, 12)))


def test_a_masked_cell_may_end_a_walk(spark):
    masked = shocks(Detector(min_temperature=2.0e4).find(meshes.line_mesh(spark)))
    assert masked[4].upstream_index == 3 and masked[4].downstream_index == 5


def test_step_limits(spark):
    finder = Detector(max_steps=1)
    found = finder.find(meshes.line_mesh(spark))
    counts = finder.diagnose(found).first()
    assert not shocks(found) and counts.downstream_step_limit == 1 and counts.nonconverging_exit == 1
    finder = Detector(max_steps=0)
    found = finder.find(meshes.line_mesh(spark))
    assert not shocks(found) and finder.diagnose(found).first().upstream_step_limit == 1


def test_center_step_limit_replays_in_row_order(spark):
    chain = spark.createDataFrame([(i, max(i - 1, 0)) for i in range(8)], "row_id long, next_id long")
    assert detect.long_paths(chain, 50) == 0
    # Rows resolve from the root on, so each finds the one before it resolved.
    assert detect.long_paths(chain, 1) == 0
    back = spark.createDataFrame([(i, min(i + 1, 7)) for i in range(8)], "row_id long, next_id long")
    # From row 0 on the root is too far until row 5, two moves away.
    assert detect.long_paths(back, 2) == 5


def test_partitions_do_not_matter(spark):
    mesh = meshes.grid_mesh(spark)
    first = sorted(Detector().find(mesh.repartition(1)).rows.collect())
    assert sorted(Detector().find(mesh.repartition(17, "x")).rows.collect()) == first


def test_empty_mesh(spark):
    finder = Detector(minlevel=3, maxlevel=4)
    a = finder.analyze(meshes.line_mesh(spark))
    assert a.counts == {"retained": 0, "shock": 0, "representative": 0, "groups": 0}
    a.clear()
    a.clear()
    assert a.counts["retained"] == 0


def test_sequential_numbers(spark):
    df = spark.range(1000).withColumn("v", F.xxhash64("id"))
    rows = detect.sequential(df, [F.col("v")], "n").orderBy("v").collect()
    assert [r.n for r in rows] == list(range(1000))
