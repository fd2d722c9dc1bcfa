"""Writing results: flat and wide exports, run snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import display_text, gold_values
from ..operators.joins import with_items

SEPARATOR = " & "


def export_flat(items: DataFrame, dims: list[str]) -> DataFrame:
    """One row per item with one column per dimension; several labels are joined with `` & ``.

    Gold is a map on the item row, so no shuffle is needed.
    """
    columns = [
        F.coalesce(
            F.array_join(gold_values(F.try_element_at("gold", F.lit(d))), SEPARATOR), F.lit("")
        ).alias(d)
        for d in dims
    ]
    return items.select(*[c for c in items.columns if c not in ("gold", "metadata")], *columns)


def dimension_order(predictions: DataFrame) -> list[str]:
    """Dimensions by first step, then name (a list as long as the codebook has dimensions)."""
    first = predictions.groupBy("dimension").agg(F.min("step_order").alias("s"))
    return [r["dimension"] for r in first.orderBy("s", "dimension").collect()]


def export_wide(predictions: DataFrame, items: DataFrame, dims: list[str] | None = None) -> DataFrame:
    """One row per item, one column per dimension; the last write in (step, id) order wins."""
    dims = dims if dims is not None else dimension_order(predictions)

    def last(d: str) -> Column:
        at = F.when(F.col("dimension") == d, F.struct("step_order", "pred_id"))
        return F.coalesce(F.max_by("label", at), F.lit("")).alias(d)

    wide = predictions.groupBy("item_id").agg(*[last(d) for d in dims])
    shown = items.select("item_id", display_text(F.col("metadata"), F.col("content")).alias("content"))
    return wide.join(shown, "item_id", "left").select(
        "item_id", F.coalesce("content", F.lit("")).alias("content"), *[F.col(f"`{d}`") for d in dims]
    )


def write_export(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """CSV with header or JSON lines, written by all tasks in parallel."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    else:
        writer.json(path)


def snapshot_rows(predictions: DataFrame, items: DataFrame) -> DataFrame:
    """Predictions with the item's text and gold, as they are kept for good."""
    kept = items.select("item_id", "idx", "content", "context", "gold")
    return with_items(predictions, kept)


def snapshot_run(predictions: DataFrame, items: DataFrame, counters: DataFrame, path: str) -> None:
    """Durable copy of finished jobs, partitioned by job, and one summary line per job.

    Only partitions of the given jobs are replaced; the summary log grows.
    """
    (
        snapshot_rows(predictions, items)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("job_id")
        .parquet(f"{path}/runs")
    )
    counters.withColumn("saved_at", F.current_timestamp()).write.mode("append").json(f"{path}/log")
