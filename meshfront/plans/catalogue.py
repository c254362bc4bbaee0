"""Registered mesh queries. Their SQL counterparts are in ``oracles``.

Queries over one mesh share its written stages (links, stencil, detection), as one analysis does; the memo below holds them for a session and the state of a data folder. forget() empties it and deletes them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property, reduce, wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshfront.functions import physics
from meshfront.operators import catalog as cat
from meshfront.operators import detect, histograms, links, raster, stencil, tracks
from meshfront.operators import dissipation as diss
from meshfront.plans import oracles
from meshfront.plans.detector import Detection, Detector, MapView
from meshfront.plans.storage import Scratch, fresh_dir, materialize, materialize_by, stamp
from meshfront.sources import cells, meshes, store

_MEMO: dict[tuple, Products] = {}


def _stage(make: Callable) -> cached_property:
    """A product that is made when first asked for; its files belong to the products' scratch."""

    @wraps(make)
    def run(self):
        with self.scratch:
            return make(self)

    return cached_property(run)


class Products:
    """What the queries over one mesh share."""

    def __init__(self, spark: SparkSession, sf_dir: str, mesh: str) -> None:
        self.spark, self.sf_dir, self.mesh, self.scratch = spark, sf_dir, mesh, Scratch()

    @_stage
    def finder(self) -> Detector:
        return Detector()

    @_stage
    def cells(self) -> DataFrame:
        table = meshes.two_level_mesh if self.mesh == "two" else meshes.uniform_mesh
        return materialize(cells.prepare(table(self.spark, self.sf_dir), self.finder), "cells")

    @_stage
    def links(self) -> DataFrame:
        return links.cached_links(self.cells)

    @_stage
    def stencil(self) -> DataFrame:
        return stencil.written(self.cells, self.links, self.finder.gamma)

    @_stage
    def found(self) -> Detection:
        return self.finder._scan(self.cells, self.links, self.stencil)

    @_stage
    def limited(self) -> Detection:
        return LIMITED._scan(self.cells, self.links, self.stencil)

    @_stage
    def rows(self) -> DataFrame:
        return self.found.rows

    @_stage
    def dissipation(self) -> DataFrame:
        return materialize(diss.compute_dissipation(self.cells, self.rows), "dissipation")

    @_stage
    def catalog(self) -> cat.Catalog:
        return cat.build_catalog(self.rows, self.links, self.cells, self.dissipation, CATALOG)

    @_stage
    def fronts(self) -> DataFrame:
        return materialize(tracks.front_catalog(self.rows, self.dissipation, min_mach=FRONT_MACH), "fronts")


#: Catalog settings of the queries: both classes and both kinds of surfaces occur with them.
CATALOG = cat.CatalogSettings(deduplicate=True, min_mach=1.0, external_temperature=2.0e5)
FRONT_MACH, FRONT_LINK, RADIUS = 1.8, 1.8, 3.0
#: Limits low enough to be met.
LIMITED = Detector(min_mach=1.5, max_steps=2, max_center_steps=1)
#: A map of the two-level mesh that doesn't line up with its cells.
MAP = {"bins": (24, 40), "plane": "xy"}


def products(spark: SparkSession, sf_dir: str, mesh: str = "two") -> Products:
    key = spark.sparkContext.applicationId, sf_dir, mesh, stamp(spark, f"{sf_dir}/orders.parquet")
    return _MEMO.setdefault(key, Products(spark, sf_dir, mesh))


def forget() -> None:
    while _MEMO:
        _MEMO.popitem()[1].scratch.drop()


def r6(c: Column | str) -> Column:
    """Rounded half up to six places by arithmetic that every engine does alike."""
    return F.floor((F.col(c) if isinstance(c, str) else c) * 1e6 + 0.5) / 1e6


def lg(c: Column | str) -> Column:
    """log10 of a positive value, rounded; 0 for 0. For values without cancellation only: weak shocks' fluxes are compared in units of strong ones."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c > 0, r6(F.log10(c))).otherwise(0.0)


def _links(mesh: str, kind: str):
    return lambda s, d: products(s, d, mesh).links.where(F.col("kind") == kind).select("row_id", "face", "slot", "nbr_id")


def _stencil(p: Products) -> DataFrame:
    """With the gradients that the stage leaves out."""
    with p.scratch:
        return materialize_by(stencil.stencil(p.cells, p.links, p.finder.gamma).drop("also"), "gradients", "block", p.links.buckets)


def _walks(p: Products) -> DataFrame:
    up, down = (w.select("row_id", F.col("reason").alias(f"{k}_reason"), F.coalesce("end.nbr_id", F.lit(-1).cast("long")).alias(k)) for w, k in ((p.found.up, "upstream"), (p.found.down, "downstream")))
    return up.join(down, "row_id", "left").select("row_id", "upstream_reason", "upstream", F.coalesce("downstream_reason", F.lit("none")).alias("downstream_reason"), F.coalesce("downstream", F.lit(-1).cast("long")).alias("downstream"))


def _unpivot(df: DataFrame) -> DataFrame:
    pairs = F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("long").alias("n")) for c in df.columns))
    return df.select(F.explode(pairs).alias("p")).select("p.name", "p.n")


def _faces(c: str) -> Column:
    return F.concat_ws("", F.transform(c, lambda x: x.cast("int").cast("string"))).alias("faces")


def _per_cell(df: DataFrame) -> DataFrame:
    """Every retained cell; magnitudes as logarithms but just above Mach 1, where the efficiency cancels."""
    strong = lambda v: lg(F.when(F.col("mach") >= 1.02, v).otherwise(0.0))
    return df.select("row_id", r6(F.col("flux") / 1e38).alias("flux"), strong(F.col("flux")).alias("lg_flux"), strong(F.col("total")).alias("lg_total"), lg(F.col("area") * 1e33).alias("lg_area"), r6("efficiency").alias("efficiency"), r6("sound_speed").alias("sound_speed"))


def _cell_area(s: SparkSession, d: str) -> DataFrame:
    p = products(s, d)
    return _per_cell(diss.compute_dissipation(p.cells, p.rows, area_mode="cell").join(p.rows.select("row_id", "mach"), "row_id"))


def _plain_groups(s: SparkSession, d: str) -> DataFrame:
    """Without dissipation areas are in squared position units."""
    p = products(s, d)
    groups = cat.build_catalog(p.rows, p.links, p.cells, None, CATALOG).groups
    return groups.select("root", "n_centers", r6("area").alias("area"), r6("mach_mean").alias("mach_mean"), "area_unit")


def _levels(s: SparkSession, d: str) -> DataFrame:
    c = products(s, d).cells
    widest = c.agg(F.max("dx").alias("m")).first().m
    return c.select("row_id", physics.inferred_level(F.lit(widest), "dx").alias("level"))


def _shocks(s: SparkSession, d: str) -> DataFrame:
    return products(s, d).rows.where("shock").select("row_id", r6("mach").alias("mach"), "upstream_index", "downstream_index", r6("nx").alias("nx"), r6("ny").alias("ny"), r6("nz").alias("nz"), "level", r6("zone_width").alias("zone_width"))


def _curve(s: SparkSession, d: str) -> DataFrame:
    grid = meshes.mach_grid(s, d)
    jump = physics.temperature_jump("mach")
    return grid.select("id", r6(jump).alias("temperature_ratio"), r6(physics.density_jump("mach")).alias("density_ratio"), r6(physics.mach_from_temperature_jump(jump)).alias("mach_back"), r6(physics.mach_from_jump_monatomic(jump)).alias("mach_closed"))


def _groups(g: DataFrame, *more) -> DataFrame:
    """The summary's values, all but root and faces, in comparable form.""" 
    exact = ["group_id", "n_centers", "level_min", "level_max", "level_count", "classification", "touches_boundary", "is_complete"]
    rounded = ["mach_peak", "mach_mean", "centroid_x", "centroid_y", "centroid_z", "normal_x", "normal_y", "normal_z", "xmin", "xmax", "ymin", "ymax", "zmin", "zmax", "external_fraction", "valid_upstream_fraction", "classification_confidence", "mach_std", "normal_dispersion", "zone_width_mean", "zone_width_min", "zone_width_max"]
    return g.select(*exact, *(r6(c).alias(c) for c in rounded), lg(F.col("area") * 1e33).alias("lg_area"), r6(F.col("dissipation_total") / 1e5).alias("dissipation"), lg("upstream_temperature").alias("lg_temperature"), lg("upstream_density").alias("lg_density"), F.concat_ws(";", "quality_flags").alias("flags"), *more)


def _whole_groups(g: DataFrame) -> DataFrame:
    return _groups(g, "root", _faces("boundary_faces"))


def _sensitivity(s: SparkSession, d: str) -> DataFrame:
    p = products(s, d, "uniform")
    df = cat.sensitivity(p.rows, p.links, p.dissipation, mach_tolerances=(0.1, 0.5), normal_cosines=(0.5, 0.9))
    return df.select("mach_tolerance", "normal_cosine", "duplicate_normal_cosine", "min_mach", "n_input_centers", "n_representative_centers", "n_groups", lg(F.col("surface_area") * 1e33).alias("lg_area"), lg("dissipation_total").alias("lg_dissipation"), r6("mach_peak").alias("mach_peak"), r6("mach_mean").alias("mach_mean"))


def _pixels(df: DataFrame, unit: float = 1.0) -> DataFrame:
    return df.select("iy", "ix", r6(F.col("value") / unit).alias("value"))


def _weighted(p: Products) -> DataFrame:
    return p.rows.join(p.dissipation.select("row_id", F.col("total").alias("energy")), "row_id")


def _normalized(s: SparkSession, d: str) -> DataFrame:
    p = products(s, d)
    m = raster.dissipation_map(p.rows, p.dissipation, **MAP)
    low, high = raster.color_limits(m, log=True) or (0.0, 1.0)
    return m.select("iy", "ix", r6(physics.normalized("value", low, high, log=True, stretch=4.0)).alias("value"))


def _extent(s: SparkSession, d: str) -> DataFrame:
    rows = products(s, d).rows
    return s.createDataFrame([(p, *raster.map_extent(rows, p)) for p in ("xy", "xz", "yz")], "plane string, xmin double, xmax double, ymin double, ymax double")


def _components(p: Products) -> DataFrame:
    return tracks.spatial_components(p.fronts, FRONT_LINK)


def _crossings(s: SparkSession, d: str) -> DataFrame:
    return tracks.classify_crossings(meshes.tracks(s, d), products(s, d).fronts, RADIUS, 2.0)


#: The smallest component that counts as large. Extents are compared, not cut at, since they are a matter of chance where eigenvalues agree.
LARGE = 5


def _large(p: Products) -> DataFrame:
    found = tracks.filter_large_fronts(p.fronts, FRONT_LINK, LARGE, 0.0)
    return found.withColumn("component_extent", F.when(F.col("component_gap") < 1e-6, -1.0).otherwise(F.col("component_extent")))


def _front_large_all(s: SparkSession, d: str) -> DataFrame:
    return _large(products(s, d)).select("row_id", "component_id", "component_size", r6("component_extent").alias("component_extent"), lg("component_total_flux").alias("lg_component_flux"))


def _crossings_large(s: SparkSession, d: str) -> DataFrame:
    """Crossings of large fronts alone, with their components."""
    df = tracks.classify_crossings(meshes.tracks(s, d), _large(products(s, d)), RADIUS, 2.0)
    lengths = ("nearest_component_extent", "nearest_mach", "distance_to_shock", "signed_distance_prev", "signed_distance_now", "transverse_distance")
    exact = ("galaxy_id", "crossed", "near_shock", "nearest_shock_row", "nearest_component_id", "nearest_component_size")
    return df.select(*exact, lg(F.coalesce("nearest_flux", F.lit(0.0))).alias("lg_flux"), *(r6(F.coalesce(c, F.lit(-999.0))).alias(c) for c in lengths))


def _compact_modes(s: SparkSession, d: str) -> DataFrame:
    """What each way to keep tracks keeps."""
    classified = materialize(_crossings(s, d), "crossings")
    ways = {"all": None, "column": F.col("distance_to_shock") < 1.5, "crossed": "crossed", "near_or_crossed": "near_or_crossed", "near_shock": "near_shock"}
    parts = (tracks.compact(classified, way, ["near_shock", "nearest_shock_row"]).select(F.lit(name).alias("keep"), "*") for name, way in ways.items())
    return reduce(DataFrame.unionAll, parts)


def _maps_both(s: SparkSession, d: str) -> DataFrame:
    p = products(s, d)
    both = p.finder.maps(p.found, MapView(**MAP))
    return _pixels(both.mach).select(F.lit("mach").alias("kind"), "*").unionAll(_pixels(both.flux, 1e38).select(F.lit("flux").alias("kind"), "*"))


def _round_trip(s: SparkSession, d: str) -> DataFrame:
    path = store.save_catalog(fresh_dir(s, "catalog"), products(s, d).catalog)
    return _whole_groups(store.load_catalog(s, path).groups)


def _csv(s: SparkSession, d: str) -> DataFrame:
    path = store.save_csv(fresh_dir(s, "csv"), products(s, d).catalog)
    kinds = dict(products(s, d).catalog.groups.dtypes) | {"quality_flags": "string"}
    df = s.read.schema(", ".join(f"{c} {kinds[c]}" for c in store.CSV_COLUMNS)).csv(path, header=True, enforceSchema=False)
    return _groups(df.withColumn("quality_flags", F.coalesce("quality_flags", F.lit(""))), "area_unit")


def _upgrade(s: SparkSession, d: str) -> DataFrame:
    old = products(s, d).catalog.groups.select(*store.required_fields(1))
    g = store.upgrade_v1(old)
    same = ["group_id", "touches_boundary", "is_complete", "level_count", "zone_width_mean", "zone_width_min", "zone_width_max", "valid_upstream_fraction"]
    unknown = (F.isnan(c).alias(f"{c}_unknown") for c in ("mach_std", "normal_dispersion"))
    return g.select(*same, *unknown, _faces("boundary_faces"), r6("classification_confidence").alias("classification_confidence"), F.concat_ws(";", "quality_flags").alias("flags"))


def _cache(s: SparkSession, d: str) -> DataFrame:
    p, folder = products(s, d), fresh_dir(s, "cache")
    links.cached_links(p.cells, folder)
    return links.cached_links(p.cells, folder)


def _mask(s: SparkSession, d: str) -> DataFrame:
    finder = Detector(minlevel=0, maxlevel=20, min_temperature=3.0e5, min_density=2.0e6, max_density=4.0e6)
    return cells.prepare(meshes.two_level_mesh(s, d), finder).select("row_id", "level", "mask")


def _lattice(s: SparkSession, d: str) -> DataFrame:
    c = products(s, d).cells
    return links.on_lattice(c, links.lattice_of(c)).select("row_id", F.col("w"), *links.CORNER)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "cells_level_filter": lambda s, d: cells.prepare(meshes.two_level_mesh(s, d), Detector(minlevel=1)).select("row_id", "level"),
    "cells_detection_mask": _mask,
    "cells_box": lambda s, d: cells.box(meshes.two_level_mesh(s, d), (10.0, 12.0, 14.0), 6.0).select("row_id"),
    "lattice_coords": _lattice,
    "links_same": _links("uniform", "same"),
    "links_coarse": _links("two", "coarse"),
    "links_fine": _links("two", "fine"),
    "face_samples": lambda s, d: stencil.face_samples(products(s, d).cells, products(s, d).links).select("row_id", "face", r6(F.coalesce("p", F.lit(-1.0))).alias("p"), r6("v").alias("v"), r6("t").alias("t"), r6("s").alias("s")),
    "stencil_divergence": lambda s, d: _stencil(products(s, d, "uniform")).select("row_id", r6("divv").alias("divv"), "valid", *(r6(F.col(f"gt{a}") / 1e6).alias(f"gt{a}") for a in "xyz"), *(r6(f"gs{a}").alias(f"gs{a}") for a in "xyz")),
    "candidates": lambda s, d: products(s, d).stencil.where("candidate").select("row_id"),
    "center_next": lambda s, d: products(s, d).found.stepped.select("row_id", "next_id"),
    "shock_centers": lambda s, d: detect.centers(products(s, d).found.stepped).select("row_id"),
    "walk_endpoints": lambda s, d: _walks(products(s, d)),
    "walk_diagnostics": lambda s, d: _unpivot(products(s, d).finder.diagnose(products(s, d).found)),
    "walk_diagnostics_limited": lambda s, d: _unpivot(LIMITED.diagnose(products(s, d).limited)),
    "shocks_limited": lambda s, d: products(s, d).limited.rows.where("shock").select("row_id", r6("mach").alias("mach"), "upstream_index", "downstream_index"),
    "shocks": _shocks,
    "jump_relations": _curve,
    "efficiency_curve": lambda s, d: meshes.mach_grid(s, d).select("id", r6(physics.thermalization_efficiency("mach")).alias("efficiency")),
    "upstream_state": lambda s, d: diss.upstream_state(products(s, d).rows.where("shock"), products(s, d).cells).select("row_id", r6("up_temp").alias("up_temp"), r6("up_rho").alias("up_rho")),
    "dissipation": lambda s, d: _per_cell(products(s, d).dissipation.join(products(s, d).rows.select("row_id", "mach"), "row_id")),
    "dissipation_cell_area": _cell_area,
    "center_representatives": lambda s, d: products(s, d).catalog.cells.select("row_id", "center_representative"),
    "group_labels": lambda s, d: products(s, d).catalog.members().join(products(s, d).catalog.groups.select("group_id", "root"), "group_id").select("row_id", "root"),
    "shock_groups": lambda s, d: _whole_groups(products(s, d).catalog.groups),
    "group_quality_flags": lambda s, d: products(s, d).catalog.groups.select("root", F.explode("quality_flags").alias("flag")),
    "group_preview": lambda s, d: cat.preview(products(s, d).catalog.groups).select("group_id", "n_centers", r6("mach_peak").alias("mach_peak")),
    "quality_summary": lambda s, d: cat.quality_summary(products(s, d).catalog.groups).select("n_groups", "n_complete", "n_boundary", lg(F.col("surface_area") * 1e33).alias("lg_area"), lg("dissipation_total").alias("lg_dissipation")),
    "quality_counts": lambda s, d: cat.quality_counts(products(s, d).catalog.groups),
    "analysis_counts": lambda s, d: _unpivot(products(s, d).rows.agg(F.count("*").alias("retained"), F.count_if("shock").alias("shock")).crossJoin(F.broadcast(products(s, d).catalog.cells.agg(F.count_if(F.col("center_representative") == F.col("row_id")).alias("representative"), (F.max("group_id") + 1).alias("groups"))))),
    "shock_summary": lambda s, d: histograms.shock_summary(products(s, d).rows, products(s, d).dissipation).select("retained_cells", "selected_cells", "shock_cells", "mach_positive", "mach_above_1_5", "flux_positive", "total_positive", r6("max_mach").alias("max_mach"), lg("max_flux").alias("lg_max_flux"), lg("max_total").alias("lg_max_total")),
    "sensitivity_sweep": _sensitivity,
    "map_extent": _extent,
    "mach_map_max": lambda s, d: _pixels(raster.mach_map(products(s, d).rows, **MAP)),
    "mach_map_mean": lambda s, d: _pixels(raster.mach_map(_weighted(products(s, d)), statistic="mean", weights="energy", **MAP)),
    "mach_map_sum": lambda s, d: _pixels(raster.mach_map(products(s, d).rows, statistic="sum", **MAP)),
    "mach_map_slab": lambda s, d: _pixels(raster.mach_map(products(s, d).rows, z_center=12.0, z_width=10.0, **(MAP | {"plane": "xz"}))),
    "diss_map": lambda s, d: _pixels(raster.dissipation_map(products(s, d).rows, products(s, d).dissipation, **(MAP | {"plane": "yz"})), 1e38),
    "point_map_max": lambda s, d: _pixels(raster.mach_map(products(s, d).rows, method="point", **MAP)),
    "point_map_mean": lambda s, d: _pixels(raster.mach_map(_weighted(products(s, d)), method="point", statistic="mean", weights="energy", **MAP)),
    "map_normalized": _normalized,
    "map_dense": lambda s, d: raster.densified(raster.mach_map(products(s, d).rows, **MAP), MAP["bins"]).select("iy", "ix", r6(F.when(F.isnan("value"), -1.0).otherwise(F.col("value"))).alias("value")),
    "mach_distribution": lambda s, d: histograms.mach_distribution(products(s, d).rows, products(s, d).dissipation, mach_bins=[1.2, 1.5, 2.0, 2.5, 3.0, 4.0, 6.0], min_mach=1.2).select("bin", lg("value").alias("value")),
    "surface_histogram": lambda s, d: histograms.surface_histogram(products(s, d).rows, [1.5, 2.0, 3.0, 4.0, 6.0]).select("bin", r6("value").alias("value")),
    "external_internal": lambda s, d: histograms.external_internal(products(s, d).rows, products(s, d).cells, threshold=2.0e5),
    "front_catalog": lambda s, d: products(s, d).fronts.select("row_id", r6("mach").alias("mach"), lg("flux").alias("lg_flux"), r6("nx").alias("nx"), r6("ny").alias("ny"), r6("nz").alias("nz"), "valid_normal"),
    "front_components": lambda s, d: _components(products(s, d)),
    "front_extent": lambda s, d: tracks.component_extents(products(s, d).fronts, _components(products(s, d))).select("root", "size", lg("total_flux").alias("lg_flux"), r6(F.when(F.col("size") == 1, 0.0).when(F.col("gap") < 1e-6, -1.0).otherwise(F.col("extent"))).alias("extent")),
    "front_large": lambda s, d: tracks.filter_large_fronts(products(s, d).fronts, FRONT_LINK, 5, 2.0).where("component_gap >= 1e-6").select("row_id", "component_size"),
    "track_nearest_front": lambda s, d: tracks.nearest_front(meshes.tracks(s, d), products(s, d).fronts, RADIUS).select("galaxy_id", F.coalesce("front.row_id", F.lit(-1).cast("long")).alias("front"), r6(F.coalesce("far", F.lit(-1.0))).alias("far")),
    "track_crossing": lambda s, d: _crossings(s, d).select("galaxy_id", "crossed", "near_shock", "nearest_shock_row", *(r6(F.coalesce(c, F.lit(-999.0))).alias(c) for c in ("nearest_mach", "distance_to_shock", "signed_distance_prev", "signed_distance_now", "transverse_distance"))),
    "track_compact": lambda s, d: tracks.compact(_crossings(s, d), "crossed", ["nearest_shock_row"]),
    "track_crossing_large": _crossings_large,
    "track_compact_modes": _compact_modes,
    "front_large_all": _front_large_all,
    "links_direct": lambda s, d: links.direct_links(products(s, d).links),
    "maps_both": _maps_both,
    "catalog_roundtrip": _round_trip,
    "catalog_csv": _csv,
    "catalog_v1_upgrade": _upgrade,
    "neighbor_cache": _cache,
    "groups_without_dissipation": _plain_groups,
    "retained_rank": lambda s, d: detect.retained_rank(products(s, d).rows).select("row_id", "rank"),
    "levels_inferred": _levels,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in oracles.sql().items() if k in QUERIES}
