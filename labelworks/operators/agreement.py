"""Agreement between coders, disputes, and labelers scored against several coders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import pair_coders


def agreement(gold: DataFrame, a: str, b: str, positive: str | None = None) -> DataFrame:
    """Per dimension: shared items, share of equal labels, positive rate of each coder."""
    pairs = pair_coders(gold, a, b)

    def rate(c: str):
        return F.avg((F.col(c) == positive).cast("double")) if positive else F.lit(None).cast("double")

    return pairs.groupBy("dimension").agg(
        F.count(F.lit(1)).alias("shared"),
        F.avg((F.col("label_a") == F.col("label_b")).cast("double")).alias("agreement"),
        rate("label_a").alias("rate_a"),
        rate("label_b").alias("rate_b"),
    )


def cross_target(preds: DataFrame, gold: DataFrame) -> DataFrame:
    """Accuracy of every labeler against every coder on the items both have.

    ``preds(labeler, item_id, label)``, ``gold(coder, item_id, label)``. ``own_minus_other`` compares,
    for one coder, the labeler tuned on that coder (same name) with the mean of the others.
    """
    acc = (
        preds.withColumnRenamed("label", "_p")
        .join(gold.select("coder", "item_id", "label"), "item_id")
        .groupBy("labeler", "coder")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg((F.col("_p") == F.col("label")).cast("double")).alias("accuracy"),
        )
    )
    own = F.col("labeler") == F.col("coder")
    gaps = acc.groupBy("coder").agg(
        (F.avg(F.when(own, F.col("accuracy"))) - F.avg(F.when(~own, F.col("accuracy")))).alias(
            "own_minus_other"
        )
    )
    return acc.join(gaps, "coder")


def disputed_items(gold: DataFrame, a: str, b: str, dimension: str | None = None) -> DataFrame:
    """Items that two coders label differently."""
    return pair_coders(gold, a, b, dimension).filter(F.col("label_a") != F.col("label_b"))


def adjudication_sheet(disputed: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Disputed items with blank columns to fill in, both labels, and a third verdict if there is
    one. ``verdicts(item_id, dimension, verdict, confidence, cited_rules array<string>)``."""
    return disputed.join(verdicts, ["item_id", "dimension"], "left").select(
        "item_id",
        "dimension",
        F.lit("").alias("final_label"),
        F.lit("").alias("notes"),
        "label_a",
        "label_b",
        F.coalesce("verdict", F.lit("")).alias("verdict"),
        F.coalesce(F.col("confidence").cast("string"), F.lit("")).alias("confidence"),
        F.coalesce(F.array_join("cited_rules", "; "), F.lit("")).alias("cited_rules"),
    )
