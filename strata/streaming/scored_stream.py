"""Stateless scoring-side operators on Structured Streaming.

The analysed pipeline has no streaming; its per-row operators (binarisation
against thresholds, element losses, model scoring) are stateless, so they run
unchanged on a streaming DataFrame. Running per-label confusion counts are a
streaming aggregation (state = one row per label) written with ``foreachBatch``
to a parquet table; the checkpoint lives under ``spark.checkpoint.dir`` so a
restarted driver or lost executor resumes exactly once.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strata.operators import losses, metrics
from strata.sources.tables import shared_folder


def read_scored_stream(spark: SparkSession, path: str, schema: StructType, max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming source over parquet files of a scored table (schema required)."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(path)


def running_confusion(stream: DataFrame, thresholds: DataFrame | None = None, default: float = 0.5) -> DataFrame:
    """Per-label running ``(label, tp, fp, fn, tn, n)`` over a scored stream.
    The thresholds table is static and one row per label (stream-static broadcast join)."""
    b = metrics.binarize(stream, thresholds, default)
    y, p = F.col("y"), F.col("pred")
    return b.groupBy("label").agg(
        F.sum(y * p).cast("long").alias("tp"),
        F.sum((1 - y) * p).cast("long").alias("fp"),
        F.sum(y * (1 - p)).cast("long").alias("fn"),
        F.sum((1 - y) * (1 - p)).cast("long").alias("tn"),
        F.count(F.lit(1)).alias("n"),
    )


def running_loss(stream: DataFrame, loss: str = "bce", label_weights: DataFrame | None = None) -> DataFrame:
    """Running element-loss sum and count per label (mean = sum / n)."""
    el = losses.element_loss(stream, loss, label_weights=label_weights)
    return el.groupBy("label").agg(F.sum("loss").alias("loss_sum"), F.count(F.lit(1)).alias("n"))


def run_to_table(agg: DataFrame, out_path: str, checkpoint: str | None = None, available_now: bool = True) -> str:
    """Run a streaming aggregation in complete mode. Each micro-batch writes the totals so far to
    its own folder ``out_path/batch-<id>`` (a repeated batch replaces its own folder alone, so
    readers of an earlier one are undisturbed); folders before the previous batch's are deleted.
    With ``available_now``, waits for the available input and returns the last folder."""
    spark = agg.sparkSession
    checkpoint = checkpoint or shared_folder(spark, "stream-state")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(_batch_folder(out_path, number))
        if number > 1:
            path, fs = _hadoop(spark, _batch_folder(out_path, number - 2))
            fs.delete(path, True)

    q = agg.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(write)
    q = q.trigger(availableNow=True) if available_now else q.trigger(processingTime="10 seconds")
    handle = q.start()
    if available_now:
        handle.awaitTermination()
        return latest_batch(spark, out_path)
    return out_path


def _batch_folder(out_path: str, number: int) -> str:
    return f"{out_path}/batch-{number:012d}"


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def latest_batch(spark: SparkSession, out_path: str) -> str:
    """Folder of the last complete micro-batch under ``out_path`` (FileNotFoundError if none)."""
    path, fs = _hadoop(spark, out_path)
    done = [str(x.getPath()) for x in (fs.listStatus(path) if fs.exists(path) else []) if fs.exists(_hadoop(spark, f"{x.getPath()}/_SUCCESS")[0])]
    if not done:
        raise FileNotFoundError(f"no complete batch under {out_path}")
    return max(done)
