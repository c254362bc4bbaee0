"""Snapshots that arrive as files."""

from pyspark.sql import functions as F

from meshfront.plans.detector import Detector
from meshfront.sources import meshes
from meshfront.streaming.snapshots import merged_maximum, watch


def test_each_snapshot_is_analysed_once(spark, tmp_path):
    base, seen = meshes.line_mesh(spark), []
    for k in ("a", "b"):
        base.withColumn("snapshot", F.lit(k)).coalesce(1).write.parquet(f"file://{tmp_path}/in/{k}")
    schema = spark.read.parquet(f"file://{tmp_path}/in/a").schema

    def run():
        q = watch(spark, f"file://{tmp_path}/in/*", schema, f"file://{tmp_path}/state", Detector(), lambda a, name, batch: seen.append((name, a.counts["shock"])))
        q.awaitTermination()

    run()
    run()  # nothing new
    assert sorted(seen) == [("a", 1), ("b", 1)]


def test_rasters_merge(spark):
    a, b = (spark.createDataFrame(r, "iy int, ix int, value double") for r in ([(0, 0, 1.0), (0, 1, 5.0)], [(0, 0, 2.0), (3, 3, 1.0)]))
    assert sorted(map(tuple, merged_maximum(a, b).collect())) == [(0, 0, 2.0), (0, 1, 5.0), (3, 3, 1.0)]
