"""Classification metrics.

All of them first reduce the rows to counts per (true, predicted) class with partial aggregation;
everything after that works on classes, not on rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import plain_key
from .rank import join_safely


def safe_ratio(num: Column, den: Column) -> Column:
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def _prf(df: DataFrame) -> DataFrame:
    df = df.withColumn("precision", safe_ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn(
        "recall", safe_ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    )
    return df.withColumn(
        "f1", safe_ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    )


def pair_counts(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Rows per (keys, true, pred)."""
    return pairs.groupBy(*keys, "true", "pred").agg(F.count(F.lit(1)).alias("n"))


def class_universe(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """All classes seen as true or predicted, once each."""
    return (
        pair_counts(pairs, keys)
        .select(*keys, F.explode(F.array("true", "pred")).alias("class"))
        .distinct()
    )


def per_class_metrics(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """tp, fp, fn, support, precision, recall and F1 per class."""
    same = F.col("true") == F.col("pred")
    zero = F.lit(0).cast("bigint")
    hit = F.struct(
        F.col("true").alias("class"), F.col("n").alias("tp"), zero.alias("fp"), zero.alias("fn")
    )
    miss = F.struct(
        F.col("true").alias("class"), zero.alias("tp"), zero.alias("fp"), F.col("n").alias("fn")
    )
    wrong = F.struct(
        F.col("pred").alias("class"), zero.alias("tp"), F.col("n").alias("fp"), zero.alias("fn")
    )
    parts = F.when(same, F.array(hit)).otherwise(F.array(miss, wrong))
    summed = (
        pair_counts(pairs, keys)
        .select(*keys, F.inline(parts))
        .groupBy(*keys, "class")
        .agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    )
    return _prf(summed.withColumn("support", F.col("tp") + F.col("fn")))


def classification_metrics(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Accuracy, macro and weighted scores per group.

    Macro and weighted scores use classes with support only; a class that was only predicted
    counts in ``n_classes`` but is not averaged.
    """
    seen = F.col("support") > 0

    def macro(c: str) -> Column:
        return F.coalesce(F.avg(F.when(seen, F.col(c))), F.lit(0.0))

    total = F.sum("support")
    return (
        per_class_metrics(pairs, keys)
        .groupBy(*keys)
        .agg(
            F.coalesce(total, F.lit(0)).alias("n"),
            F.count(F.lit(1)).alias("n_classes"),
            safe_ratio(F.sum("tp"), total).alias("accuracy"),
            macro("precision").alias("macro_precision"),
            macro("recall").alias("macro_recall"),
            macro("f1").alias("macro_f1"),
            safe_ratio(F.sum(F.col("f1") * F.col("support")), total).alias("weighted_f1"),
        )
    )


def confusion(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Counts for every (true, pred) of a group's classes, zeros included.

    ``keys`` names at least one column (such as the dimension): the square of classes is built by
    an equi-join on it. A null label counts as the empty label.
    """
    blank = {c: F.coalesce(c, F.lit("")) for c in ("true", "pred")}
    counts = pair_counts(pairs.withColumns(blank), keys)
    classes = counts.select(*keys, F.explode(F.array("true", "pred")).alias("true")).distinct()
    square = join_safely(classes, classes.withColumnRenamed("true", "pred"), keys)
    return join_safely(square, counts, [*keys, "true", "pred"], "left").fillna(0, ["n"])


def _clean_set(c: Column) -> Column:
    return F.array_distinct(F.filter(F.coalesce(c, F.array()), lambda x: x.isNotNull() & (x != "")))


def _label_outcomes(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """One pass over items: counts per label, and per group one row (label null) for the items."""
    sets = pairs.select(*keys, _clean_set(F.col("gold")).alias("g"), _clean_set(F.col("pred")).alias("p"))

    def flag(c: Column) -> Column:
        return c.cast("bigint")

    def outcome(x: Column) -> Column:
        in_g, in_p = F.array_contains(F.col("g"), x), F.array_contains(F.col("p"), x)
        return F.struct(
            x.alias("label"),
            flag(in_g & in_p).alias("tp"),
            flag(in_p & ~in_g).alias("fp"),
            flag(in_g & ~in_p).alias("fn"),
        )

    exact = (F.size("g") == F.size("p")) & (F.size(F.array_except("g", "p")) == 0)
    item = F.struct(
        F.lit(None).cast("string").alias("label"),
        flag(exact).alias("tp"),
        flag(~exact).alias("fp"),
        F.lit(0).cast("bigint").alias("fn"),
    )
    rows = F.concat(F.array(item), F.transform(F.array_union("g", "p"), outcome))
    return (
        sets.select(*keys, F.inline_outer(rows))  # never empty
        .groupBy(*keys, "label")
        .agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    )


def per_label_metrics(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """tp, fp, fn, support, precision, recall and F1 per label of multi-label pairs."""
    labels = _label_outcomes(pairs, keys).filter(F.col("label").isNotNull())
    return _prf(labels.withColumn("support", F.col("tp") + F.col("fn")))


def multilabel_metrics(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Exact-match accuracy, micro and macro scores of (gold set, predicted set) rows.

    Macro scores average every label seen, also those without support. Two empty sets match.
    """
    is_label = F.col("label").isNotNull()
    scored = _prf(_label_outcomes(pairs, keys).withColumn("support", F.col("tp") + F.col("fn")))

    def over(c: str) -> Column:
        return F.coalesce(F.sum(F.when(is_label, F.col(c))), F.lit(0))

    def macro(c: str) -> Column:
        return F.coalesce(F.avg(F.when(is_label, F.col(c))), F.lit(0.0))

    tp, fp, fn = over("tp"), over("fp"), over("fn")
    exact, inexact = F.sum(F.when(~is_label, F.col("tp"))), F.sum(F.when(~is_label, F.col("fp")))
    out = scored.groupBy(*keys).agg(
        (exact + inexact).alias("n"),
        safe_ratio(exact, exact + inexact).alias("accuracy"),
        safe_ratio(tp, tp + fp).alias("micro_precision"),
        safe_ratio(tp, tp + fn).alias("micro_recall"),
        macro("precision").alias("macro_precision"),
        macro("recall").alias("macro_recall"),
        macro("f1").alias("macro_f1"),
        F.count("label").alias("n_labels"),
    )
    p, r = F.col("micro_precision"), F.col("micro_recall")
    return out.withColumn("micro_f1", safe_ratio(2 * p * r, p + r))


def overall_accuracy(metrics: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Unweighted mean of the accuracy over dimensions."""
    return metrics.groupBy(*keys).agg(F.avg("accuracy").alias("overall_accuracy"))


def class_counts(
    gold: DataFrame, labels: DataFrame, keys: list[str] = ("dimension",), rare_share: float = 0.05
) -> DataFrame:
    """Gold rows per label; unused codebook labels show 0, labels outside the codebook stay.

    ``gold`` is one row per (keys, label); ``labels`` the codebook's (keys, label). Spellings that
    share the plain key count for the codebook's label.
    """
    keys = list(keys)
    raw = (
        gold.filter(F.col("label").isNotNull() & (F.col("label") != ""))
        .groupBy(*keys, "label")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("_key", plain_key(F.col("label")))
        .groupBy(*keys, "_key")
        .agg(F.sum("n").alias("n"), F.min("label").alias("raw_label"))
    )
    book = labels.select(*keys, "label").distinct().withColumn("_key", plain_key(F.col("label")))
    merged = book.join(raw, [*keys, "_key"], "full").select(
        *keys,
        F.coalesce("label", "raw_label").alias("label"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
        F.col("label").isNotNull().alias("in_codebook"),
    )
    totals = merged.groupBy(*keys).agg(F.sum("n").alias("_total"))
    share = F.try_divide(F.col("n").cast("double"), F.col("_total"))
    return join_safely(merged, totals, keys).select(
        *merged.columns, ((F.col("n") > 0) & (share < rare_share)).alias("rare")
    )


def label_distribution(gold: DataFrame, keys: list[str] = ("dimension",)) -> DataFrame:
    return gold.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("n"))


def per_class_f1_series(pairs: DataFrame, keys: list[str] = ("run_id", "round")) -> DataFrame:
    """Rounded F1 per class for every run and round."""
    return per_class_metrics(pairs, list(keys)).select(
        *keys, "class", F.round("f1", 4).alias("f1")
    )


def set_errors(pairs: DataFrame) -> DataFrame:
    """Adds ``missed`` (gold, not predicted) and ``added`` (predicted, not gold)."""
    return pairs.withColumn("missed", F.array_except("gold", "pred")).withColumn(
        "added", F.array_except("pred", "gold")
    )
