"""Evaluating predictions against gold, per dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import gold_values, label_for, metric_target
from ..operators.metrics import classification_metrics, confusion, per_class_metrics


def scored_pairs(predictions: DataFrame, items: DataFrame, keys: list[str] = ("dimension",)) -> DataFrame:
    """(keys, true, pred) of predictions that have gold; names of dimensions meet by key.

    One join on the item; the dimension is looked up inside the item's gold map. Items without gold
    and columns that are not needed are left out before the join.
    """
    labeled = items.filter(F.size("gold") > 0).select("item_id", "gold")
    rows = predictions.select(*dict.fromkeys(["item_id", "dimension", "label", *keys])).join(labeled, "item_id")
    gold = gold_values(label_for(F.col("gold"), F.col("dimension")))
    return (
        rows.withColumn("_gold", gold)
        .select(*keys, metric_target(F.col("label"), F.col("_gold")).alias("true"), F.col("label").alias("pred"))
        .filter(F.col("true") != "")
    )


def metrics_by_dimension(
    predictions: DataFrame, items: DataFrame, keys: list[str] = ("dimension",)
) -> DataFrame:
    return classification_metrics(scored_pairs(predictions, items, keys), list(keys))


def class_metrics_by_dimension(
    predictions: DataFrame, items: DataFrame, keys: list[str] = ("dimension",)
) -> DataFrame:
    return per_class_metrics(scored_pairs(predictions, items, keys), list(keys))


def confusion_by_dimension(
    predictions: DataFrame, items: DataFrame, dimension: str | None = None
) -> DataFrame:
    """Confusion counts; with ``dimension`` only that one (its exact name, pushed to the scan)."""
    if dimension is not None:
        predictions = predictions.filter(F.col("dimension") == dimension)
    return confusion(scored_pairs(predictions, items), ["dimension"])
