"""Fronts, their spatial components, and bodies that cross them."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshfront.functions.physics import KPC_IN_KM, norm
from meshfront.operators import octree
from meshfront.operators.components import connected_components
from meshfront.plans.storage import materialize, release


def front_catalog(result: DataFrame, dissipation: DataFrame, min_mach: float = 1.5, min_flux: float = 0.0) -> DataFrame:
    """``(row_id, x, y, z, dx, mach, flux, nx, ny, nz, valid_normal)`` of strong fronts."""
    strong = result.where(F.col("shock") & (F.col("mach") >= min_mach)).join(dissipation.where(F.col("flux") > min_flux).select("row_id", "flux"), "row_id")
    ok = (F.col("upstream_index") >= 0) & (F.col("downstream_index") >= 0) & (norm("nx", "ny", "nz") > 0)
    return strong.select("row_id", "x", "y", "z", "dx", "mach", "flux", "nx", "ny", "nz", ok.alias("valid_normal"))


def _boxed(points: DataFrame, edge: float) -> DataFrame:
    """``points`` with the lattice numbers b* of the box of edge ``edge`` around each."""
    return points.withColumns({f"b{c}": F.floor(F.col(c) / edge) for c in "xyz"})


_BOX = [f"b{c}" for c in "xyz"]


def _name(*numbers: Column) -> Column:
    """A box's name, under which its tree hangs."""
    return F.concat(F.concat_ws(",", *numbers), F.lit(":"))


def _steps(reach: int, half: bool = False) -> Column:
    """A row for each offset of boxes up to ``reach``; with ``half``, for one of each pair of opposite ones."""
    around = range(-reach, reach + 1)
    offsets = [(i, j, k) for i in around for j in around for k in around if not half or (i, j, k) > (0, 0, 0)]
    return F.explode(F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip("ijk", o, strict=True))) for o in offsets)))


def _bounds(prefix: str) -> dict[str, tuple[Column, Column]]:
    return {c: (F.col(f"{prefix}{c}0"), F.col(f"{prefix}{c}1")) for c in "xyz"}


def _nodes(level: DataFrame, prefix: str, key: str) -> DataFrame:
    """Nodes of a level with prefixed names; ``key`` (node or parent) is ``at``, to join on."""
    named = [F.col(key).alias(f"{prefix}at"), *(F.col(c).alias(f"{prefix}{c}") for c in ("node", "n", "open", *octree.BOUNDS))]
    return level.select(*named).drop(f"{prefix}open" if prefix else "n")


def spatial_components(points: DataFrame, length: float) -> DataFrame:
    """``(row_id, root)``: points chained by steps of at most ``length``; root is the lowest row of the component.

    In a box of edge ``length / sqrt 3`` all points are within reach of each other, so a box is one vertex however many points it holds. Which boxes are linked is decided on pairs of nodes of their octrees: nodes that are
    close enough as a whole link their boxes, nodes too far apart are dropped, and so are those that begin farther apart than another pair of the same boxes ends, since the closest points aren't there. Of a pair
    that stays open the wider node is cut, a leaf into its points. So dense clumps just at the length make few pairs for each pair of boxes and level.
    """
    edge = length / math.sqrt(3) * (1 - 1e-12)
    boxed = materialize(_boxed(points.select("row_id", "x", "y", "z"), edge), "boxed")
    boxes = boxed.groupBy(*_BOX).agg(F.min("row_id").alias("box"))
    rows = materialize(boxed.join(boxes, _BOX).select("row_id", "x", "y", "z", "box", _name(*_BOX).alias("root"), *_BOX), "boxes")
    release(boxed)
    places = rows.select("root", "x", "y", "z").distinct()
    tree = octree.build(places)
    near = rows.select("box", "root", *_BOX).distinct().select("box", "root", *_BOX, _steps(2, half=True).alias("o"))
    near = near.select(F.col("box").alias("a"), F.col("root").alias("pat"), *((F.col(f"b{c}") + F.col(f"o.{n}")).alias(f"b{c}") for c, n in zip("xyz", "ijk", strict=True)))
    pairs = near.join(rows.select(F.col("box").alias("b"), F.col("root").alias("qat"), *_BOX).distinct(), _BOX).drop(*_BOX)
    pairs = pairs.join(_nodes(tree.levels[0], "p", "node"), "pat").join(_nodes(tree.levels[0], "q", "node"), "qat").drop("pat", "qat")
    # Below a leaf hang its points, so that they are decided as the nodes above them are.
    spots = tree.points.select(F.lit(None).cast("string").alias("node"), F.col("node").alias("parent"), F.lit(1).alias("n"), F.lit(False).alias("open"), *(F.col(b[0]).alias(b) for b in octree.BOUNDS))
    nodes = reduce(DataFrame.unionAll, [*(x.select(*spots.columns) for x in tree.levels), spots])
    lies = {side: F.col(f"{side}n") > 1 for side in "pq"}
    within, edges = length * length, []
    while True:
        least, most = octree.gaps(_bounds("p"), _bounds("q"))
        spot = ~lies["p"] & ~lies["q"]  # two points, whose distance is exact
        pairs = pairs.withColumns({"least": least, "most": most}).where(F.col("least") <= F.when(spot, within).otherwise(within * (1 + 1e-12)))
        # The closest points of two boxes lie no farther apart than any pair of nodes ends.
        sure = F.max(F.col("most") <= F.when(spot, within).otherwise(within * (1 - 1e-12))).over(Window.partitionBy("a", "b"))
        closest = F.min("most").over(Window.partitionBy("a", "b"))
        judged = pairs.withColumns({"linked": sure, "closest": closest}).where(F.col("least") <= F.col("closest") * (1 + 1e-12))
        judged = materialize(judged, "pairs")
        tree.written.append(judged)
        edges.append(judged.where("linked").select("a", "b").distinct())
        pairs = judged.where(~F.col("linked") & (lies["p"] | lies["q"])).drop("least", "most", "closest", "linked")
        if pairs.isEmpty():
            break
        # The wider of the two is cut.
        wide = {side: sum((F.col(f"{side}{c}1") - F.col(f"{side}{c}0")) * (F.col(f"{side}{c}1") - F.col(f"{side}{c}0")) for c in "xyz") for side in "pq"}
        pairs = pairs.withColumn("left", lies["p"] & (~lies["q"] | (wide["p"] >= wide["q"])))
        cut = []
        for side, mine in (("p", F.col("left")), ("q", ~F.col("left"))):
            own = [f"{side}node", f"{side}n", *(f"{side}{b}" for b in octree.BOUNDS)]
            inner = pairs.where(mine).withColumnRenamed(f"{side}node", f"{side}at").drop(*own, "left").join(_nodes(nodes, side, "parent"), f"{side}at")
            cut.append(inner.select(*(c for c in pairs.columns if c != "left")))
        pairs = cut[0].unionAll(cut[1])
    found = materialize(reduce(DataFrame.unionAll, edges), "edges")
    tree.drop()
    parts_ = connected_components(found)
    return rows.join(parts_, rows.box == parts_.node, "left").select("row_id", F.coalesce("component", "box").alias("root"))


def component_numbers(labels: DataFrame) -> DataFrame:
    """``(root, component_id)``: dense numbers by lowest row."""
    from meshfront.operators.detect import sequential

    return sequential(labels.select("root").distinct(), [F.col("root")], "component_id")


#: Squarings that bring out an axis: of eigenvalues a millionth apart the lesser has vanished after them.
SQUARINGS = 32
_SYMMETRIC = ("xx", "xy", "xz", "yy", "yz", "zz")


def _entry(m: Column, a: str, b: str) -> Column:
    """An entry of a symmetric matrix, kept as the array of _SYMMETRIC."""
    return F.get(m, F.lit(_SYMMETRIC.index("".join(sorted(a + b)))))


def _times(m: Column, v: Column, a: str) -> Column:
    return sum(_entry(m, a, k) * F.get(v, F.lit(i)) for i, k in enumerate("xyz"))


def _scaled(values: Column, by: Column) -> Column:
    """Divided by a number that is not negative; zeros stay zeros."""
    return F.transform(values, lambda x: x / F.greatest(by, F.lit(1e-300)))


def _squared(m: Column) -> Column:
    """The square, divided by its trace."""
    trace = sum(_entry(m, a, b) * _entry(m, a, b) for a in "xyz" for b in "xyz")
    return _scaled(F.array(*(sum(_entry(m, a, k) * _entry(m, k, b) for k in "xyz") for a, b in _SYMMETRIC)), trace)


def _principal(folds: DataFrame) -> DataFrame:
    """``folds`` with ``axis``, the unit vector of the largest eigenvalue of the matrix ``cov``, and ``gap``, how far that eigenvalue is ahead of the next, relative to it; both are made of Columns.

    A matrix squared again and again becomes the projection on its axis (on the plane of two equal ones), whose longest column is taken. The other two eigenvalues follow from the trace and the sum of squares.
    """
    df = folds.withColumn("unit", _scaled(F.col("cov"), sum(_entry(F.col("cov"), a, a) for a in "xyz")))
    df = df.withColumn("grown", F.aggregate(F.sequence(F.lit(1), F.lit(SQUARINGS)), F.col("unit"), lambda m, _: _squared(m)))
    columns = [F.array(*(_entry(F.col("grown"), a, b) for b in "xyz")) for a in "xyz"]
    df = df.withColumn("longest", F.greatest(*(F.struct(norm(*(F.get(c, F.lit(k)) for k in range(3))).alias("n"), c.alias("v")) for c in columns)))
    df = df.withColumn("axis", _scaled(F.col("longest.v"), F.col("longest.n")))
    unit, axis = F.col("unit"), F.col("axis")
    first = sum(F.get(axis, F.lit(k)) * _times(unit, axis, a) for k, a in enumerate("xyz"))
    rest, squares = (sum(_entry(unit, a, a) for a in "xyz"), sum(_entry(unit, a, b) * _entry(unit, a, b) for a in "xyz" for b in "xyz"))
    df = df.withColumn("first", first).withColumns({"rest": rest - F.col("first"), "squares": squares - F.col("first") * F.col("first")})
    second = (F.col("rest") + F.sqrt(F.greatest(2 * F.col("squares") - F.col("rest") * F.col("rest"), F.lit(0.0)))) / 2
    gap = F.when(F.col("first") > 0, F.greatest((F.col("first") - second) / F.nullif(F.col("first"), F.lit(0.0)), F.lit(0.0))).otherwise(0.0)
    return df.select(*folds.columns, "axis", gap.alias("gap"))


def component_extents(points: DataFrame, labels: DataFrame) -> DataFrame:
    """``(root, size, total_flux, extent, gap)``: extent along the first principal axis, which is a matter of chance where ``gap`` is 0. Covariances fold partially, so no component is gathered in one task."""
    rows = points.join(labels, "row_id")
    means = rows.groupBy("root").agg(*(F.avg(c).alias(f"m{c}") for c in "xyz"))
    rows = rows.join(means, "root").select("root", "flux", *((F.col(c) - F.col(f"m{c}")).alias(c) for c in "xyz"))
    squares = F.array(*(F.sum(F.col(a) * F.col(b)) for a, b in _SYMMETRIC))
    folds = rows.groupBy("root").agg(F.count("*").alias("size"), F.sum("flux").alias("total_flux"), squares.alias("cov"))
    # Written, so that a filter on gap isn't pushed into it: each step of _principal() stands in the next several times, and so would all squarings.
    axes = materialize(_principal(folds).drop("cov"), "axes")
    along = sum(F.col(c) * F.get("axis", F.lit(k)) for k, c in enumerate("xyz"))
    spans = rows.join(axes.select("root", "axis"), "root").groupBy("root").agg((F.max(along) - F.min(along)).alias("extent"))
    extent = F.when(F.col("size") > 1, F.col("extent")).otherwise(0.0)
    return axes.drop("axis").join(spans, "root").select("root", "size", "total_flux", extent.alias("extent"), "gap")


def filter_large_fronts(fronts: DataFrame, link_length: float = 50 * KPC_IN_KM, min_cells: int = 30, min_extent: float = 300 * KPC_IN_KM, min_total_flux: float = 0.0) -> DataFrame:
    """Fronts of large components with ``component_id``, ``component_size``, ``component_extent``, ``component_total_flux`` and ``component_gap``."""
    labels = materialize(spatial_components(fronts, link_length), "components")
    large = component_extents(fronts, labels).where((F.col("size") >= min_cells) & (F.col("extent") >= min_extent) & (F.col("total_flux") >= min_total_flux))
    named = large.join(component_numbers(labels), "root").select("root", "component_id", F.col("size").alias("component_size"), F.col("extent").alias("component_extent"), F.col("total_flux").alias("component_total_flux"), F.col("gap").alias("component_gap"))
    return fronts.join(labels, "row_id").join(named, "root").drop("root")


_FILLS = {"component_id": (-1, "long"), "component_size": (-1, "long"), "component_extent": (None, "double")}


def nearest_front(tracks: DataFrame, fronts: DataFrame, radius: float) -> DataFrame:
    """Each track with the front nearest to where it is now, as struct ``front`` with distance ``far``, if one lies within ``radius``; the lowest row of equals.

    A track looks into the 27 boxes of edge ``radius`` around it and descends their octrees, nearest nodes alone: of a level it keeps the nodes that begin no farther than the nearest node ends, so few at any density,
    and meets only the fronts of the few leaves that are left. Fronts at one place stand for the lowest row among them. Sides meet by equi-joins.
    """
    extra = [c if c in fronts.columns else F.lit(v).cast(t).alias(c) for c, (v, t) in _FILLS.items()]
    front = F.struct("row_id", "x", "y", "z", "dx", "mach", "flux", "nx", "ny", "nz", "valid_normal", *extra).alias("front")
    placed = fronts.select("x", "y", "z", front).groupBy("x", "y", "z").agg(F.min_by("front", "front.row_id").alias("front"))
    placed = materialize(_boxed(placed, radius).select(_name(*_BOX).alias("root"), "x", "y", "z", "front"), "placed")
    tree = octree.build(placed)
    here = ["galaxy_id", "tx", "ty", "tz"]
    bodies = _boxed(tracks.select("galaxy_id", *(F.col(f"c{c}").alias(c) for c in "xyz")), radius)
    bodies = bodies.select("galaxy_id", *(F.col(c).alias(f"t{c}") for c in "xyz"), *_BOX, _steps(1).alias("o"))
    looks = bodies.select(*here, _name(*(F.col(f"b{c}") + F.col(f"o.{n}") for c, n in zip("xyz", "ijk", strict=True))).alias("at"))
    own = [*here, "node", "open", "begins", "ends"]
    least, most = octree.gaps({c: (F.col(f"t{c}"),) * 2 for c in "xyz"}, _bounds(""))
    met = looks.join(_nodes(tree.levels[0], "", "node"), "at").withColumns({"begins": least, "ends": most}).select(*own)
    for depth in range(len(tree.levels)):
        if depth:
            inner = met.where("open").select(*here, F.col("node").alias("at")).join(_nodes(tree.levels[depth], "", "parent"), "at")
            met = met.where("NOT open").unionAll(inner.withColumns({"begins": least, "ends": most}).select(*own))
        reach = F.least(F.min("ends").over(Window.partitionBy("galaxy_id")), F.lit(radius * radius)) * (1 + 1e-9) + radius * radius * 1e-12
        met = met.withColumn("reach", reach).where("begins <= reach").drop("reach")
        if depth < len(tree.levels) - 1:
            met = materialize(met, "looks")
            tree.written.append(met)
    far = norm(*(F.col(f"front.{c}") - F.col(f"t{c}") for c in "xyz"))
    near = met.join(tree.points.select("node", "front"), "node").withColumn("far", far).where(F.col("far") <= radius)
    best = materialize(near.groupBy("galaxy_id").agg(F.min_by("front", F.struct("far", "front.row_id")).alias("front"), F.min("far").alias("far")), "nearest")
    tree.drop()
    return tracks.join(best, "galaxy_id", "left")


def classify_crossings(tracks: DataFrame, fronts: DataFrame, search_radius: float = 100 * KPC_IN_KM, width_factor: float = 2.0) -> DataFrame:
    """Twelve columns for each of ``tracks(galaxy_id, px, py, pz, cx, cy, cz)``: whether it is near a front and crossed its plane since the last snapshot.

    Fills are -1 and null where no front is near; they are exported as -1 and NaN.
    """
    if missing := {"galaxy_id", "px", "py", "pz", "cx", "cy", "cz"} - set(tracks.columns):
        raise ValueError(f"tracks lack {sorted(missing)}")
    df = nearest_front(tracks, fronts, search_radius)
    near = F.coalesce(F.col("front.valid_normal"), F.lit(False))
    signed = lambda p: sum((F.col(f"{p}{c}") - F.col(f"front.{c}")) * F.col(f"front.n{c}") for c in "xyz")
    offset = {c: (F.col(f"p{c}") + F.col(f"c{c}")) / 2 - F.col(f"front.{c}") for c in "xyz"}
    df = df.withColumns({"near_shock": near, "prev": signed("p"), "now": signed("c"), "along": sum(offset[c] * F.col(f"front.n{c}") for c in "xyz")})
    df = df.withColumn("side", norm(*(offset[c] - F.col("along") * F.col(f"front.n{c}") for c in "xyz")))
    crossed = (F.col("prev") * F.col("now") <= 0) & (F.col("side") <= F.col("front.dx") * width_factor)
    own = lambda c, fill=None: F.when(F.col("near_shock"), c).otherwise(F.lit(fill))
    return df.select(
        "galaxy_id", (F.col("near_shock") & F.coalesce(crossed, F.lit(False))).alias("crossed"), "near_shock", own(F.col("front.row_id"), -1).cast("long").alias("nearest_shock_row"),
        own(F.col("front.component_id"), -1).cast("long").alias("nearest_component_id"), own(F.col("front.component_size"), -1).cast("long").alias("nearest_component_size"), own(F.col("front.component_extent")).alias("nearest_component_extent"),
        own(F.col("front.mach")).alias("nearest_mach"), own(F.col("front.flux")).alias("nearest_flux"), own(F.col("far")).alias("distance_to_shock"),
        own(F.col("prev")).alias("signed_distance_prev"), own(F.col("now")).alias("signed_distance_now"), own(F.col("side")).alias("transverse_distance"),
    )


def compact(classified: DataFrame, keep: str | Column | None = "near_or_crossed", keep_keys: list[str] | None = None) -> DataFrame:
    """The rows of interest, with the number of all tracks."""
    masks = {"all": F.lit(True), "near_or_crossed": F.col("near_shock") | F.col("crossed"), "near_shock": F.col("near_shock"), "crossed": F.col("crossed")}
    mask = masks["all"] if keep is None else keep if isinstance(keep, Column) else masks.get(keep)
    if mask is None:
        raise ValueError(f"keep must be a column or one of {sorted(masks)}")
    n = classified.count()
    keys = keep_keys or [c for c in classified.columns if c != "galaxy_id"]
    return classified.where(mask).select(F.col("galaxy_id").alias("galaxy_index"), F.lit(n).cast("long").alias("n_galaxies"), *keys)
