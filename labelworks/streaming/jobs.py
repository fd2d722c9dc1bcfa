"""Incremental labeling, job progress, corrections and usage windows.

Each operator takes a streaming DataFrame and gives what the batch operator gives for the same rows.
State and lateness are bounded by watermarks where the stream has an event time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ledger import overlay
from ..plans.labeling import Labeler, Step, annotate, result_rows
from ..scratch import new_path


def annotate_stream(
    items: DataFrame, steps: list[Step], labeler: Labeler, keys: list[str] = ("item_id",)
) -> DataFrame:
    """Result rows of arriving items: stateless, each item is written once (append)."""
    return result_rows(annotate(items, steps, labeler), steps, keys)


def job_progress(
    results: DataFrame, event_time: str | None = None, delay: str = "1 day"
) -> DataFrame:
    """Running completed, failed and tokens per job (update or complete mode).

    ``results(job_id, item_id, ok, tokens)``. A repeated item counts once; with ``event_time`` the
    memory of seen items is limited to ``delay``.
    """
    if event_time is not None:
        once = results.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["job_id", "item_id"])
    else:
        once = results.dropDuplicates(["job_id", "item_id"])
    return once.groupBy("job_id").agg(
        F.count_if("ok").alias("completed"),
        F.count_if(~F.col("ok")).alias("failed"),
        F.coalesce(F.sum(F.when(F.col("ok"), F.col("tokens"))), F.lit(0)).cast("bigint").alias("tokens"),
    )


def usage_window(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Cost and tokens per day. ``events(ts timestamp, cost, tokens)``; rows later than ``delay`` are
    dropped, and append mode emits a day once it is closed."""
    day = F.window("ts", "1 day")
    return (
        events.withWatermark("ts", delay)
        .groupBy(day.alias("w"))
        .agg(F.sum("cost").alias("cost"), F.sum("tokens").alias("tokens"))
        .select(F.col("w.start").alias("day"), "cost", "tokens")
    )


def log_corrections(log_path: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` body: adds the micro-batch of edits to the correction log.

    The predictions are not rewritten: readers lay the log over them (:func:`corrected`). A batch
    that runs again replaces its own part of the log.
    """

    def body(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{log_path}/batch={batch_id}")

    return body


def corrected(predictions: DataFrame, edits: DataFrame) -> DataFrame:
    """Predictions with the latest logged edit of each (job, item, dimension)."""
    return overlay(predictions, edits)


def run_to_table(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there now and returns what it wrote, from the shared folder.

    Complete results replace those of the micro-batch before, so the last batch is returned. A stream
    without any data gives no rows.
    """
    spark = stream.sparkSession
    base = new_path(spark, name)
    writer = stream.writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", f"{base}/rows").outputMode("append").start()
        _finish(query)
        return spark.read.schema(stream.schema).parquet(f"{base}/rows")

    def body(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/rows")

    spark.createDataFrame([], stream.schema).write.parquet(f"{base}/rows")
    _finish(writer.outputMode(mode).foreachBatch(body).start())
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")


def run_corrections(edits: DataFrame, predictions: DataFrame) -> DataFrame:
    """Logs a stream of edits and returns the corrected predictions; without edits, all as they are."""
    spark = predictions.sparkSession
    base = new_path(spark, "corrections")
    spark.createDataFrame([], edits.schema).write.parquet(f"{base}/log/batch=-1")
    query = (
        edits.writeStream.option("checkpointLocation", f"{base}/state")
        .trigger(availableNow=True)
        .foreachBatch(log_corrections(f"{base}/log"))
        .start()
    )
    _finish(query)
    return corrected(predictions, spark.read.schema(edits.schema).parquet(f"{base}/log"))


def _finish(query: StreamingQuery) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def table_stream(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A stream over one table in a folder that holds several: one Parquet file, or a folder of them."""
    path = f"{folder}/{table}.parquet"
    files = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1000)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return files.parquet(path)
    # a stream reads folders only; the filter goes by the names of files, not of folders
    return files.option("pathGlobFilter", f"{table}.parquet").parquet(folder)
