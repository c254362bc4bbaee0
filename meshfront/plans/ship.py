"""Sending this package to Python workers that don't have it installed."""

from __future__ import annotations

import io
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from meshfront.plans.storage import fresh_dir


def ship(spark: SparkSession) -> None:
    """Once for a Spark context: put the package's modules as an archive in the shared folder and have workers import from it."""
    context = spark.sparkContext
    if getattr(context, "_meshfront_shipped", False):
        return
    from pyarrow import fs

    root, data = Path(__file__).resolve().parents[1], io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, path.relative_to(root.parent).as_posix())
    uri = fresh_dir(spark, "package") + ".zip"
    store, place = fs.FileSystem.from_uri(uri)
    store.create_dir(place.rpartition("/")[0], recursive=True)
    with store.open_output_stream(place, compression=None) as out:
        out.write(data.getvalue())
    context.addPyFile(uri)
    context._meshfront_shipped = True
