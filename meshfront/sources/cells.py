"""Reading a cell table: names, validation, level filter and detection mask."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshfront.plans.settings import Settings

FIELDS = ("x", "y", "z", "dx", "vx", "vy", "vz", "temp", "rho")
#: Names under which a field may stand, after its name with the unit.
ALIASES = {"temp": ("T", "temp", "temperature"), "rho": ("rho", "density"), "level": ("level", "levels", "refinement_level")}
_TAGGED = {"temp": ("T", "temperature"), "rho": ("rho", "density")}


def _unit(settings: Settings, field: str) -> str:
    return {"temp": settings.temperature_unit, "rho": settings.density_unit}.get(field) or (settings.velocity_unit if field[0] == "v" else settings.position_unit)


def find_column(df: DataFrame, field: str, unit: str | None = None) -> str:
    """The first name that the table has: with the unit (``x [km]``, ``x_km`` or metadata), then bare."""
    bare = ALIASES.get(field, (field,))
    if unit:
        for name in _TAGGED.get(field, (field,)):
            for tagged in (f"{name} [{unit}]", f"{name}_{unit.replace('/', '_per_')}"):
                if tagged in df.columns:
                    return tagged
            if name in df.columns and df.schema[name].metadata.get("unit") == unit:
                return name
    for name in bare:
        if name in df.columns:
            return name
    raise KeyError(f"missing required field: {field}")


def canonical(df: DataFrame, settings: Settings) -> DataFrame:
    """``row_id``, the nine fields as double with their units as metadata, and an integer level. Rows are identified by ``row_id``, in the order that ties follow."""
    if "row_id" not in df.columns:
        raise KeyError("missing required field: row_id")
    fields = [F.col(f"`{find_column(df, f, _unit(settings, f))}`").cast("double").alias(f, metadata={"unit": _unit(settings, f)}) for f in FIELDS]
    return df.select(F.col("row_id").cast("long").alias("row_id"), *fields, F.col(f"`{find_column(df, 'level')}`").cast("double").alias("level"))


def _bad(value: Column) -> Column:
    return value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))


def validate(cells: DataFrame, settings: Settings) -> None:
    """One pass that counts every kind of fault: levels over all rows, fields over the retained ones."""
    kept, level = F.col("level").between(settings.minlevel, settings.maxlevel), F.col("level")
    faults = cells.agg(
        F.count_if(_bad(level)).alias("level_finite"),
        F.count_if(~_bad(level) & (level != F.floor(level))).alias("level_whole"),
        *(F.count_if(kept & _bad(F.col(f))).alias(f"{f}_finite") for f in FIELDS),
        F.count_if(kept & (F.col("dx") <= 0)).alias("dx_positive"),
        # Widths in use are few, one a refinement level; in thousandths of an octave they are few whatever they are.
        F.collect_set(F.when(kept & (F.col("dx") > 0) & ~_bad(F.col("dx")), F.rint(F.log2("dx") * 1000))).alias("octaves"),
    ).first()
    if faults.level_finite or faults.level_whole:
        raise ValueError("level must be finite" if faults.level_finite else "level must hold whole numbers")
    if found := [f for f in FIELDS if faults[f"{f}_finite"]]:
        raise ValueError(f"{found[0]} must be finite in all retained cells")
    if faults.dx_positive:
        raise ValueError("dx must be positive")
    widths = sorted(faults.octaves)
    if any(b - a > 1001 for a, b in zip(widths, widths[1:], strict=False)):
        raise ValueError("cell widths may differ by at most one refinement jump")


def prepare(df: DataFrame, settings: Settings, check: bool = True) -> DataFrame:
    """Retained cells with ``mask``. The level range decides which cells exist; temperature and density only which may start a detection, so they are a flag."""
    cells = canonical(df, settings)
    if check:
        validate(cells, settings)
    limits = [c for c, v in (
        (F.col("temp") >= F.lit(settings.min_temperature), settings.min_temperature),
        (F.col("rho") >= F.lit(settings.min_density), settings.min_density),
        (F.col("rho") <= F.lit(settings.max_density), settings.max_density),
    ) if v is not None]
    mask = reduce(lambda a, b: a & b, limits, F.lit(True))
    return cells.where(F.col("level").between(settings.minlevel, settings.maxlevel)).withColumns({"level": F.col("level").cast("int"), "mask": mask})


def box(df: DataFrame, center: tuple[float, float, float], half_width: float) -> DataFrame:
    """A closed box: three range predicates that reach the scan."""
    return df.where(reduce(lambda a, b: a & b, (F.col(c).between(m - half_width, m + half_width) for c, m in zip(("x", "y", "z"), center, strict=True))))
