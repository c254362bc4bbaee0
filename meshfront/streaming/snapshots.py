"""Snapshots that arrive as files: each micro-batch is a set of whole regions, analysed one by one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from meshfront.plans.detector import Analysis, Detector


def watch(spark: SparkSession, folder: str, schema, checkpoint: str, detector: Detector, publish: Callable[[Analysis, str, int], None], key: str = "snapshot") -> StreamingQuery:
    """Analyse every snapshot that lands in ``folder``, a file for each, and hand it to ``publish(analysis, snapshot, batch_id)``.

    A region is complete within its file, so no state is kept between batches and there is nothing to arrive late. A batch that is run again
    calls ``publish`` again with the same ids, which lets a sink overwrite.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        for r in batch.select(key).distinct().collect():  # one row for each file in the batch
            analysis = detector.analyze(batch.where(batch[key] == r[0]).drop(key))
            publish(analysis, r[0], batch_id)
            analysis.clear()

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged_maximum(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two sparse rasters of maxima as one."""
    from pyspark.sql import functions as F

    return a.unionByName(b).groupBy("iy", "ix").agg(F.max("value").alias("value"))
