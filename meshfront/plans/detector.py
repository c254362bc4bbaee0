"""The facade: detection, dissipation, catalog and maps of one region."""

from __future__ import annotations

import logging
import time
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshfront.operators import catalog as cat
from meshfront.operators import detect, raster, stencil
from meshfront.operators.dissipation import compute_dissipation
from meshfront.operators.links import cached_links
from meshfront.plans.settings import Settings
from meshfront.plans.storage import Scratch, materialize, materialize_by, together
from meshfront.sources.cells import prepare

log = logging.getLogger("meshfront")


@dataclass
class Detection:
    """rows: one for each retained cell. The other tables are written stages that later steps reuse; ``scratch`` knows their files."""

    rows: DataFrame | None
    diagnostics: DataFrame | None
    cells: DataFrame | None
    links: DataFrame | None
    stencil: DataFrame | None = None
    stepped: DataFrame | None = None
    up: DataFrame | None = None
    down: DataFrame | None = None
    judged: DataFrame | None = None
    scratch: Scratch = field(default_factory=Scratch, repr=False)

    def clear(self) -> None:
        """Delete the written stages; a second call does nothing."""
        self.scratch.drop()
        for k in vars(self).keys() - {"scratch"}:
            setattr(self, k, None)


@dataclass
class Analysis:
    result: Detection
    dissipation: DataFrame | None = None
    catalog: cat.Catalog | None = None
    timings: dict[str, float] = field(default_factory=dict)

    @property
    def counts(self) -> dict[str, int]:
        """Retained cells, shocks, representatives and groups; zeros after clear()."""
        out = {"retained": 0, "shock": 0, "representative": 0, "groups": 0}
        if self.result.rows is not None:
            r = self.result.rows.agg(F.count("*").alias("n"), F.count_if("shock").alias("s")).first()
            out |= {"retained": r.n, "shock": r.s}
        if self.catalog is not None:
            own = self.catalog.cells.where("center_representative = row_id").count()
            out |= {"representative": own, "groups": self.catalog.groups.count()}
        return out

    def clear(self) -> None:
        """Delete the files of all stages, dissipation and catalog among them."""
        self.result.clear()
        self.dissipation, self.catalog = None, None


@dataclass
class MapView:
    """What a map shows: the projection, its pixels and extent, a slab along the line of sight, and how cells become pixels."""

    plane: str = "xy"
    bins: int | tuple[int, int] = 1024
    extent: tuple[float, float, float, float] | None = None
    z_center: float | None = None
    z_width: float | None = None
    min_mach: float = 1.0
    statistic: str = "max"
    method: str = "amr"


@dataclass
class Maps:
    mach: DataFrame
    flux: DataFrame
    extent: tuple[float, float, float, float]


class Detector(Settings):
    """Settings, and what is done with them: ``Detector(min_mach=1.5).find(df)``."""

    def __init__(self, **settings) -> None:
        super().__init__(**settings)
        self._made: list[Detection] = []

    def find(self, df: DataFrame) -> Detection:
        return self._find(df, {})

    __call__ = find

    @contextmanager
    def _timed(self, timings: dict[str, float], name: str):
        began = time.monotonic()
        yield
        timings[name] = time.monotonic() - began
        if self.show_progress:
            log.info("%s: %.1f s", name, timings[name])

    def _report(self):
        """What a walk calls after each round: a line every ``progress_interval`` moves, or every tenth of the limit."""
        if not self.show_progress:
            return None
        every, last = self.progress_interval or max(1, self.max_steps // 10), [0]

        def report(moves: int, left: int) -> None:
            if moves - last[0] >= every or not left:
                last[0] = moves
                log.info("walks: %d moves, %d under way", moves, left)

        return report

    def _find(self, df: DataFrame, timings: dict[str, float]) -> Detection:
        self.check()
        scratch = Scratch()
        with scratch, self._timed(timings, "detection_total"):
            with self._timed(timings, "input"):
                cells = materialize(prepare(df, self), "cells")
            with self._timed(timings, "neighbors"):
                links = cached_links(cells, self.neighbor_cache_dir)
            with self._timed(timings, "scan"):
                out = self._scan(cells, links) if cells.limit(1).count() else _nothing(cells, links)
        out.scratch = scratch
        self._made.append(out)
        return out

    def _scan(self, cells: DataFrame, links: DataFrame, field_: DataFrame | None = None) -> Detection:
        field_ = field_ if field_ is not None else stencil.written(cells, links, self.gamma)
        stepped = detect.stepped(field_, links, self)
        probe, own = stepped.drop("next_id"), detect.centers(stepped)
        probe.buckets = stepped.buckets

        both = detect.walks(probe, own, self.max_steps, self._report()) if self.max_steps else _none_walked(probe, own)
        blocks = getattr(links, "blocks", None)
        with together(cells.sparkSession):
            pairs = materialize(detect.paired(both), "pairs") if blocks is None else materialize_by(detect.paired(both, blocks.buckets), "pairs", "block", blocks.buckets)
        up = pairs.select("row_id", F.col("up_reason").alias("reason"), F.col("u").alias("end"))
        # Only a center whose walk upstream ended in a cell walks downstream; what the others' other walks met is left out.
        down = pairs.where("u IS NOT NULL").select("row_id", F.col("down_reason").alias("reason"), F.col("d").alias("end"))
        judged = detect.jumps(pairs, self)
        with together(cells.sparkSession):
            if blocks is None:
                full = materialize(detect.finalize(cells, judged), "result")
            else:
                full = materialize_by(detect.finalize(blocks.where("block = home"), judged), "result", "block", blocks.buckets)
        rows = full.drop("block", "up_temp", "up_rho")
        rows.upstream = cells, full
        return Detection(rows, None, cells, links, field_, stepped, up, down, judged)

    def diagnose(self, found: Detection) -> DataFrame:
        """The ten counters in one row; made on demand, since the first one needs the whole step graph."""
        if found.diagnostics is None:
            with found.scratch:
                moving = found.stepped.where("nx <> 0 OR ny <> 0 OR nz <> 0")
                far = detect.long_paths(moving, self.max_center_steps)
            found.diagnostics = detect.diagnostics(found.up, found.down, found.judged, far)
        return found.diagnostics

    def analyze(self, df: DataFrame, dissipation: bool = True, catalog: bool = True, catalog_settings: cat.CatalogSettings | None = None, provenance: dict | None = None, dissipation_options: dict | None = None) -> Analysis:
        """Everything in one pass over the same links."""
        options = dict(dissipation_options or {})
        if options.setdefault("gamma", self.gamma) != self.gamma:
            raise ValueError(f"one gamma holds for all steps: {self.gamma} here, {options['gamma']} for dissipation")
        timings: dict[str, float] = {}
        with self._timed(timings, "total"):
            found = self._find(df, timings)
            out = Analysis(found, timings=timings)
            with found.scratch:
                if dissipation:
                    with self._timed(timings, "dissipation"):
                        out.dissipation = materialize(compute_dissipation(found.cells, found.rows, **options), "dissipation")
                if catalog:
                    with self._timed(timings, "catalog"):
                        s = catalog_settings or cat.CatalogSettings(deduplicate=True, min_mach=self.min_mach)
                        out.catalog = cat.build_catalog(found.rows, found.links, found.cells, out.dissipation, s, provenance)
        return out

    def maps(self, found: Analysis | Detection, view: MapView | None = None) -> Maps:
        """Mach number and dissipated flux of what was found; dissipation is computed if the analysis has none."""
        own, view = found if isinstance(found, Analysis) else Analysis(found), view or MapView()
        if own.dissipation is None:
            with own.result.scratch:
                own.dissipation = materialize(compute_dissipation(own.result.cells, own.result.rows, self.gamma), "dissipation")
        how = asdict(view)
        how["extent"] = view.extent or raster.map_extent(own.result.rows, view.plane)
        return Maps(raster.mach_map(own.result.rows, **how), raster.dissipation_map(own.result.rows, own.dissipation, **how), how["extent"])

    def clear(self) -> None:
        """Clear every detection that was made with these settings."""
        while self._made:
            self._made.pop().clear()


def _none_walked(probe: DataFrame, starts: DataFrame) -> DataFrame:
    """With no step allowed every walk hits the limit."""
    end = F.lit(None).cast(probe.schema["faces"].dataType.elementType)
    ways = F.explode(F.array(F.lit(-1), F.lit(1))).alias("way")
    own = [F.col("block").alias("start")] if "block" in starts.columns else []
    return starts.select("row_id", ways, F.lit("step_limit").alias("reason"), end.alias("end"), *own)


#: A result's columns.
RESULT = "row_id long, mach double, shock boolean, center_index long, upstream_index long, downstream_index long, x double, y double, z double, dx double, nx double, ny double, nz double, level int, zone_width double"


def _nothing(cells: DataFrame, links: DataFrame) -> Detection:
    """What is found in an empty region."""
    spark = cells.sparkSession
    counters = spark.createDataFrame([], ", ".join(f"{c} long" for c in detect.COUNTERS))
    return Detection(materialize(spark.createDataFrame([], RESULT), "result"), counters, cells, links)
