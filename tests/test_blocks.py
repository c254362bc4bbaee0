"""Links and stencils by blocks: what is shuffled, and neighbours across the blocks' walls."""

import pytest

from meshfront.operators import detect, dissipation, links, stencil, tracks
from meshfront.plans.detector import Detector
from meshfront.plans.storage import Scratch, materialize, together
from meshfront.sources import cells, meshes


def test_what_looks_one_cell_far_is_not_shuffled(spark):
    """Cells move once, by block; the joins and folds after that lie where the buckets lie."""
    with Scratch() as own:
        c = materialize(cells.prepare(meshes.grid_mesh(spark, 20, 20), Detector()), "cells")
        near = links.cached_links(c)
        field = stencil.written(c, near)
        with together(spark):
            plans = [df._jdf.queryExecution().executedPlan().toString() for df in (links.build_links(c, near.blocks), stencil.stencil(c, near), detect.probes(field, near))]
        assert [p.count("Exchange hashpartitioning") for p in plans] == [0, 0, 0] and all("Bucketed: true" in p for p in plans)
    own.drop()


@pytest.mark.parametrize("shift", [0.0, 1.0])
def test_links_across_blocks(spark, monkeypatch, shift):
    """Small blocks find what one block finds, also where coarse cells are off the coarse lattice."""
    rows, n = [], 0
    for i in range(6):
        for j in range(6):
            for k in range(6):
                fine = (i * 7 + j * 3 + k) % 3 == 0
                for o in range(8 if fine else 1):
                    at = [2 * v + ((o >> a & 1) + 0.5 if fine else 1.0) + shift for a, v in enumerate((i, j, k))]
                    rows.append((n, *at, 1.0 if fine else 2.0, int(fine)))
                    n += 1
    if shift:
        rows.append((n, 0.5, 0.5, 0.5, 1.0, 1))
    mesh = spark.createDataFrame(rows, "row_id long, x double, y double, z double, dx double, level int")
    found = []
    for edge in (1, 1000):
        monkeypatch.setattr(links, "EDGES", ((0, edge),))
        found.append(sorted(tuple(r) for r in links.build_links(mesh).select(*links.LINK).collect()))
    assert found[0] == found[1] and {r[2] for r in found[0]} >= {"same", "fine"}


def test_long_ways_of_center_searches(spark):
    """Reach doubles six times here; were a doubling not written before the next reads it twice, the plan would double as well."""
    n, limit = 50, 3
    to = {i: i + 1 if i < 40 else max(i - 1, 41) for i in range(n)} | {40: 40}
    reached, failed = set(), 0
    for i in range(n):
        way = [i]
        while len(way) <= limit and to[way[-1]] != way[-1] and way[-1] not in reached:
            way.append(to[way[-1]])
        if to[way[-1]] == way[-1] or way[-1] in reached:
            reached |= set(way)
        else:
            failed += 1
    chain = spark.createDataFrame(list(to.items()), "row_id long, next_id long")
    assert detect.long_paths(chain, limit) == failed > 0


def test_a_filter_on_the_gap_repeats_no_squarings(spark):
    fronts = spark.createDataFrame([(i, float(i), float(i * i % 5), 0.0, 1.0) for i in range(12)], "row_id long, x double, y double, z double, flux double")
    labels = spark.range(12).selectExpr("id AS row_id", "id % 2 AS root")
    large = tracks.component_extents(fronts, labels).where("gap >= 1e-6")
    assert "aggregate(" not in large._jdf.queryExecution().optimizedPlan().toString() and large.count() == 2


def _joined_ends(found):
    cols = ("row_id", "mach", "shock", "upstream_index", "downstream_index", "zone_width")
    return sorted(tuple(r) for r in found.rows.select(*cols).collect())


def test_walks_across_blocks_in_many_rounds(spark, monkeypatch, tmp_path):
    """Small blocks, no broadcasts and one move a round find what links without blocks find; the first round and the pairing shuffle no walk that ended in its block."""
    mesh = meshes.two_level_mesh(spark, "/root/testdata/sf0.001")
    plain = Detector(neighbor_cache_dir=f"file://{tmp_path}").find(mesh)
    monkeypatch.setattr(links, "EDGES", ((0, 2),))
    monkeypatch.setattr(detect, "FEW", 0)
    monkeypatch.setattr(detect, "HERE", 1)
    finder = Detector()
    found = finder.find(mesh)
    assert _joined_ends(found) == _joined_ends(plain) and any(r[2] for r in _joined_ends(found))
    assert finder.diagnose(found).first() == Detector().diagnose(plain).first()
    with together(spark):
        stepped = detect.stepped(found.stencil, found.links, finder)
        probe, own = stepped.drop("next_id"), detect.centers(stepped)
        probe.buckets = stepped.buckets
        walked = detect.walks(probe, own, finder.max_steps)
        first = detect.paired(walked.rounds[0])._jdf.queryExecution().executedPlan().toString()
        whole = detect.paired(walked, probe.buckets).repartition(probe.buckets, "block")._jdf.queryExecution().executedPlan().toString()
    assert first.count("Exchange hashpartitioning") == 0 and whole.count("Exchange hashpartitioning") == 1


def test_a_block_is_read_once_for_all_moves_within(spark, monkeypatch):
    """Walks of many moves end in the first round if no wall is in their way, which shuffles nothing; were a round a move or four, they'd take several."""
    monkeypatch.setattr(links, "EDGES", ((0, 1000),))
    finder = Detector()
    found = finder.find(meshes.two_level_mesh(spark, "/root/testdata/sf0.001"))
    moves = []
    probe = found.stepped.drop("next_id")
    probe.buckets = found.stepped.buckets
    walked = detect.walks(probe, detect.centers(found.stepped), finder.max_steps, lambda done, left: moves.append(left))
    assert moves == [0] and len(walked.rounds) == 1 and walked.where("reason IS NULL").isEmpty()
    few = detect.walks(probe, detect.centers(found.stepped), 3)
    assert {"step_limit", "nonconverging"} <= {r.reason for r in few.select("reason").distinct().collect()}


def test_blocks_are_worked_on_whole(spark):
    """Links, stencil and center searches join no rows, and find what joins and Columns find."""
    with Scratch() as own:
        finder = Detector()
        c = materialize(cells.prepare(meshes.two_level_mesh(spark, "/root/testdata/sf0.001"), finder), "cells")
        near = links.cached_links(c)
        made = links.build_links(c, near.blocks), stencil.stencil(c, near)
        assert not any("Join" in df._jdf.queryExecution().optimizedPlan().toString() for df in made)
        plain = materialize(near.select(*links.LINK), "plain")
        names = ("row_id", "divv", "gtx", "gsy", "gtz", "valid", "candidate", "nx")
        one, two = (sorted(tuple(r) for r in stencil.stencil(c, n).select(*names).collect()) for n in (near, plain))
        assert [(r[0], *r[5:7]) for r in one] == [(r[0], *r[5:7]) for r in two]
        assert all(x == pytest.approx(y, rel=1e-9, abs=1e-9) for x, y in zip(one, two, strict=True))
        field = stencil.written(c, near)
        steps = detect.stepped(field, near, finder)
        assert "Join" not in steps._jdf.queryExecution().optimizedPlan().toString()
        wanted = detect.next_centers(detect.probes(field, near), finder)
        pick = lambda df: sorted((r.row_id, r.next_id, len(r.faces)) for r in df.select("row_id", "next_id", "faces").collect())
        assert pick(steps) == pick(wanted) and any(a != b for a, b, _ in pick(steps))
    own.drop()


def test_upstream_state_of_a_detection_joins_nothing(spark):
    found = Detector().find(meshes.line_mesh(spark))
    known = dissipation.upstream_state(found.rows, found.cells)
    assert "Join" not in known._jdf.queryExecution().optimizedPlan().toString()
    cols = ("row_id", "up_temp", "up_rho")
    joined = dissipation.upstream_state(found.rows.select("*"), found.cells)
    assert sorted(map(tuple, known.select(*cols).collect())) == sorted(map(tuple, joined.select(*cols).collect()))
