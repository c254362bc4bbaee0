"""Catalogs on disk: Parquet folders, a CSV summary, and archives of arrays for single-node tools."""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshfront.operators.catalog import Catalog
from meshfront.plans.storage import drop_dir, fresh_dir

VERSION = 2
#: Group fields of version 1, and those that version 2 adds.
_V1 = (
    "group_id", "n_centers", "mach_peak", "mach_mean", "area", "area_unit", "dissipation_total", "centroid_x", "centroid_y", "centroid_z", "normal_x", "normal_y", "normal_z",
    "xmin", "xmax", "ymin", "ymax", "zmin", "zmax", "level_min", "level_max", "upstream_temperature", "upstream_density", "external_fraction", "classification",
)
_V2 = (
    "boundary_faces", "touches_boundary", "valid_upstream_fraction", "classification_confidence", "mach_std", "normal_dispersion", "zone_width_mean", "zone_width_min", "zone_width_max",
    "level_count", "is_complete", "quality_flags",
)
#: The CSV summary's columns in order.
CSV_COLUMNS = (
    *_V1, "touches_boundary", "is_complete", "valid_upstream_fraction", "classification_confidence", "mach_std", "normal_dispersion", "zone_width_mean", "zone_width_min", "zone_width_max",
    "level_count", "quality_flags",
)
_CELLS = ("row_id", "group_id", "center_representative")


def required_fields(version: int = VERSION) -> tuple[str, ...]:
    return _V1 if version == 1 else (*_V1, *_V2)


def _reject(what: str, faults: list[str]) -> None:
    if faults:
        raise ValueError(f"{what}: {'; '.join(faults)}")


def _known_version(what: str, version) -> int:
    _reject(what, [] if version in (1, VERSION) else [f"version {version} can't be read, only 1 to {VERSION}"])
    return int(version)


def save_catalog(path: str, catalog: Catalog, compressed: bool = True) -> str:
    """``cells/``, ``groups/`` and ``metadata/`` under ``path``."""
    codec = "zstd" if compressed else "none"
    spark = catalog.cells.sparkSession
    meta = spark.createDataFrame([(VERSION, json.dumps(catalog.metadata, sort_keys=True))], "schema_version int, metadata_json string")
    for name, df in (("cells", catalog.cells), ("groups", catalog.groups), ("metadata", meta.coalesce(1))):
        df.write.mode("overwrite").option("compression", codec).parquet(f"{path}/{name}")
    return path


def upgrade_v1(groups: DataFrame) -> DataFrame:
    """Fields that version 1 lacks, with what can be said of them."""
    f, nan, t = F.col("external_fraction"), F.lit(float("nan")), F.col("upstream_temperature")
    return groups.withColumns({
        "boundary_faces": F.array_repeat(F.lit(False), 6), "touches_boundary": F.lit(False), "is_complete": F.lit(False), "quality_flags": F.array(F.lit("legacy_schema")),
        "valid_upstream_fraction": F.when(t.isNotNull() & ~F.isnan(t), 1.0).otherwise(0.0), "classification_confidence": F.greatest(f, 1 - f),
        "mach_std": nan, "normal_dispersion": nan, "zone_width_mean": F.lit(0.0), "zone_width_min": F.lit(0.0), "zone_width_max": F.lit(0.0),
        "level_count": (F.col("level_max") - F.col("level_min") + 1).cast("int"),
    })


def group_faults(groups: DataFrame, cells: DataFrame) -> list[str]:
    """What is wrong with a catalog's rows: one pass over the groups and one over the cells."""
    rules = {
        "rows without group_id or mach_peak": F.col("group_id").isNull() | F.col("mach_peak").isNull(),
        "negative group_id": F.col("group_id") < 0,
        "boundary_faces not of six": F.size("boundary_faces") != 6,
    }
    seen = groups.agg(*(F.count_if(rule).alias(name) for name, rule in rules.items())).first().asDict()
    own = cells.where("group_id >= 0").groupBy("group_id").agg(F.count("*").alias("have"))
    uneven = groups.select("group_id", "n_centers").join(own, "group_id", "full").where("NOT (have <=> n_centers)").count()
    return [f"{n} {name}" for name, n in ({**seen, "groups whose n_centers isn't the number of their cells": uneven}).items() if n]


def load_catalog(spark: SparkSession, path: str) -> Catalog:
    """Read what save_catalog() wrote, of this version or version 1, and check it."""
    tables = {name: spark.read.parquet(f"{path}/{name}") for name in ("cells", "groups", "metadata")}
    head = tables["metadata"].first().asDict()
    version = _known_version(path, head.get("schema_version"))
    wanted = {"cells": _CELLS, "groups": required_fields(version)}
    _reject(path, [f"{name} has no column {c}" for name, columns in wanted.items() for c in columns if c not in tables[name].columns])
    groups = upgrade_v1(tables["groups"]) if version == 1 else tables["groups"]
    _reject(path, group_faults(groups, tables["cells"]))
    return Catalog(tables["cells"], groups, {"loaded_from_schema": 1} if version == 1 else json.loads(head["metadata_json"]))


def csv_rows(groups: DataFrame) -> DataFrame:
    """The summary's columns in order, flags joined by semicolons."""
    return groups.select(*(F.concat_ws(";", c).alias(c) if c == "quality_flags" else F.col(c) for c in CSV_COLUMNS))


def save_csv(path: str, catalog: Catalog) -> str:
    """One CSV file with a header, a row for each surface in order. Tasks write sorted parts, whose bytes are then appended to the file one part after another."""
    spark = catalog.groups.sparkSession
    parts = fresh_dir(spark, "csv-parts")
    csv_rows(catalog.groups).orderBy("group_id").write.csv(parts)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    source, target = jvm.org.apache.hadoop.fs.Path(parts), jvm.org.apache.hadoop.fs.Path(path)
    files, store = source.getFileSystem(conf), target.getFileSystem(conf)
    out = store.create(target, True)
    try:
        out.write(bytearray((",".join(CSV_COLUMNS) + "\n").encode()))
        for part in sorted(f.getPath().toString() for f in files.listStatus(source) if f.getPath().getName().startswith("part-")):
            data = files.open(jvm.org.apache.hadoop.fs.Path(part))
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(data, out, 1 << 16, False)
            data.close()
    finally:
        out.close()
    drop_dir(spark, parts)
    return path


@dataclass(frozen=True)
class _Array:
    """An array of the archive: the columns it packs, in order, its kind, the shape of a group's part, and the first version that has it."""

    columns: tuple[str, ...]
    kind: str
    shape: tuple[int, ...] = ()
    version: int = 1

    @property
    def spark_kind(self) -> str:
        return {"i8": "long", "i4": "int", "f8": "double", "?": "boolean"}.get(self.kind, "string")


def _plain(kind: str, version: int, *names: str) -> dict[str, _Array]:
    return {n: _Array((n,), kind, version=version) for n in names}


#: The arrays of groups.
_GROUPS = {
    "group_ids": _Array(("group_id",), "i8"),
    "centroid": _Array(("centroid_x", "centroid_y", "centroid_z"), "f8", (3,)),
    "mean_normal": _Array(("normal_x", "normal_y", "normal_z"), "f8", (3,)),
    "bounds": _Array(("xmin", "ymin", "zmin", "xmax", "ymax", "zmax"), "f8", (2, 3)),
    **_plain("i8", 1, "n_centers"),
    **_plain("f8", 1, "mach_peak", "mach_mean", "area", "dissipation_total", "upstream_temperature", "upstream_density", "external_fraction"),
    **_plain("U32", 1, "area_unit", "classification"),
    **_plain("i4", 1, "level_min", "level_max"),
    **_plain("f8", 2, "valid_upstream_fraction", "classification_confidence", "mach_std", "normal_dispersion", "zone_width_mean", "zone_width_min", "zone_width_max"),
    **_plain("?", 2, "touches_boundary", "is_complete"),
    **_plain("i4", 2, "level_count"),
    "boundary_faces": _Array(("boundary_faces",), "?", (6,), 2),
    "quality_flags": _Array(("quality_flags",), "U256", version=2),
}
#: The arrays beside them.
_MEMBERS, _OFFSETS, _CELL_GROUP, _CELL_CENTER, _VERSION, _METADATA = "center_indices", "center_offsets", "cell_group_id", "center_representative", "schema_version", "metadata_json"


def export_npz(path: str, catalog: Catalog, compressed: bool = True) -> str:
    """The catalog as one archive of arrays of the current version, with cells by their rank in row order. Such a file fits one process by its nature, so the driver gathers and writes it; at scale use save_catalog()."""
    cells = catalog.cells.select(*_CELLS).orderBy("row_id").toArrow().to_pydict()
    rank = {r: k for k, r in enumerate(cells["row_id"])}
    table = catalog.groups.orderBy("group_id").toArrow().to_pydict()
    members: dict[int, list[int]] = {g: [] for g in table["group_id"]}
    for k, g in enumerate(cells["group_id"]):
        if g >= 0:
            members[g].append(k)
    sizes = [len(m) for m in members.values()]
    out = {
        _VERSION: np.int32(VERSION), _METADATA: np.array(json.dumps(catalog.metadata, sort_keys=True)),
        _CELL_GROUP: np.array(cells["group_id"], "i8"), _CELL_CENTER: np.array([rank.get(r, -1) for r in cells["center_representative"]], "i8"),
        _OFFSETS: np.concatenate([[0], np.cumsum(sizes)]).astype("i8"), _MEMBERS: np.array([k for m in members.values() for k in m], "i8"),
    }
    for name, a in _GROUPS.items():
        packed = [table[c] for c in a.columns]
        if name == "quality_flags":
            packed = [[";".join(x) for x in packed[0]]]
        if a.kind == "f8":
            packed = [[np.nan if v is None else v for v in column] for column in packed]
        values = packed[0] if len(packed) == 1 else list(zip(*packed, strict=True))
        out[name] = np.array(values, a.kind).reshape(len(sizes), *a.shape)
    (np.savez_compressed if compressed else np.savez)(path, **out)
    return path


def import_npz(spark: SparkSession, path: str) -> Catalog:
    """A catalog from an archive of arrays, versions 1 and 2. Such files fit one process, so the driver reads them."""
    with np.load(path, allow_pickle=False) as archive:
        a = {k: archive[k] for k in archive.files}
    version = _known_version(path, a[_VERSION].item() if _VERSION in a else None)
    arrays = {name: x for name, x in _GROUPS.items() if x.version <= version}
    beside = [_CELL_GROUP, _CELL_CENTER, _OFFSETS, _MEMBERS, *([_METADATA] if version > 1 else [])]
    _reject(path, [f"no array {name}" for name in (*arrays, *beside) if name not in a])
    n, cells = len(a["group_ids"]), len(a[_CELL_GROUP])
    shapes = {**{name: (n, *x.shape) for name, x in arrays.items()}, _CELL_CENTER: (cells,), _OFFSETS: (n + 1,)}
    _reject(path, [f"{name} has shape {a[name].shape} instead of {s}" for name, s in shapes.items() if a[name].shape != s])
    steps = np.diff(a[_OFFSETS], prepend=0, append=len(a[_MEMBERS]))
    _reject(path, [] if steps[0] == 0 == steps[-1] and (steps >= 0).all() else [f"{_OFFSETS} don't run from 0 to {len(a[_MEMBERS])} in order"])
    _reject(path, [] if np.array_equal(steps[1:-1], a["n_centers"]) else [f"{_OFFSETS} disagree with the counts in n_centers"])
    values, kinds = {}, {}
    for name, x in arrays.items():
        columns = [a[name]] if len(x.columns) == 1 else list(a[name].reshape(n, len(x.columns)).T)
        for c, v in zip(x.columns, columns, strict=True):
            kinds[c] = "array<string>" if name == "quality_flags" else "array<boolean>" if name == "boundary_faces" else x.spark_kind
            values[c] = [[f for f in str(s).split(";") if f] for s in v] if name == "quality_flags" else v.tolist()
    names = required_fields(version)
    groups = spark.createDataFrame(list(zip(*(values[c] for c in names), strict=True)), ", ".join(f"{c} {kinds[c]}" for c in names))
    rows = zip(range(cells), a[_CELL_GROUP].tolist(), a[_CELL_CENTER].tolist(), strict=True)
    out = spark.createDataFrame(list(rows), ", ".join(f"{c} long" for c in _CELLS))
    if version == 1:
        return Catalog(out, upgrade_v1(groups), {"loaded_from_schema": 1})
    return Catalog(out, groups, json.loads(str(a[_METADATA])))


def import_npy(spark: SparkSession, files: dict[str, str]) -> DataFrame:
    """A cell table from one ``.npy`` file a column, as single-node tools store a region. Files are mapped, not loaded, and come in blocks of rows; ``row_id`` is the position."""
    arrays = {c: np.load(path, mmap_mode="r", allow_pickle=False) for c, path in files.items()}
    n = {c: x.shape for c, x in arrays.items()}
    _reject("cell columns", [f"{c} has shape {s}" for c, s in n.items() if len(s) != 1 or s != next(iter(n.values()))])
    rows, block, out = next(iter(n.values()))[0] if n else 0, 1 << 20, None
    import pyarrow as pa

    for start in range(0, max(rows, 1), block):
        part = {c: np.ascontiguousarray(x[start : start + block]) for c, x in arrays.items()}
        df = spark.createDataFrame(pa.table({"row_id": np.arange(start, min(start + block, rows)), **part}))
        out = df if out is None else out.unionAll(df)
    return out
