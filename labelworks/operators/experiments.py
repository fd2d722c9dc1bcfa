"""Tables over many tuning runs: seeds, comparisons, trajectories, failed runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.answers import canonical_labels, match_label
from ..functions.labels import gold_values, label_for
from ..functions.names import trimmed
from .rank import join_safely, shuffle_key

EPSILON = 0.005


def mean_std(runs: DataFrame, keys: list[str], value: str, sample: bool = False) -> DataFrame:
    """Mean and deviation over runs: population by default, sample (0 for one run) on request."""
    dev = F.coalesce(F.stddev_samp(value), F.lit(0.0)) if sample else F.stddev_pop(value)
    return runs.groupBy(*keys).agg(
        F.count(value).alias("runs"), F.avg(value).alias("mean"), dev.alias("std")
    )


def repeat_over_seeds(df: DataFrame, k: int, fn: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Runs one analysis for seeds 0..k-1 in a single plan; ``fn`` must keep ``seed`` as a key."""
    return fn(df.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))))


def comparison_table(runs: DataFrame, group: str) -> DataFrame:
    """Before, after and gain in points per run, plus one mean row per group (dimension null).

    ``runs(group, dimension, before, after, tokens)``. Both kinds of rows come from one aggregation.
    """
    rows = F.explode(F.array(F.col("dimension"), F.lit(None).cast("string")))
    out = (
        runs.withColumn("dimension", rows)
        .groupBy(group, "dimension")
        .agg(
            F.avg("before").alias("before"),
            F.avg("after").alias("after"),
            F.sum("tokens").alias("tokens"),
            F.count(F.lit(1)).alias("runs"),
        )
    )
    return out.withColumn("delta_pp", (F.col("after") - F.col("before")) * 100)


def trajectory_rows(runs: DataFrame, keys: list[str]) -> DataFrame:
    """One row per round of the ``trajectory`` array of structs."""
    return runs.select(*keys, F.inline("trajectory"))


def trajectory_ends(trajectory: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Rounds sorted by score; of more than ``k`` the lowest and highest halves stay."""
    low, high = k // 2, k - k // 2
    n = trajectory.groupBy(*keys).agg(F.count(F.lit(1)).alias("_all"))

    def end(order: list[Column], rows: int) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(*order)
        return trajectory.withColumn("_i", F.row_number().over(w)).filter(F.col("_i") <= rows)

    up, down = [F.asc("val_acc"), F.asc("round")], [F.desc("val_acc"), F.desc("round")]
    first = end(up, low).withColumn("position", F.col("_i"))
    last = join_safely(end(down, high), n, keys).withColumn("position", F.col("_all") - F.col("_i") + 1)
    # in a short run both ends meet: its upper rows start after the lower ones
    return (
        first.select(*trajectory.columns, F.col("position").cast("int").alias("position"))
        .unionByName(
            last.filter(F.col("position") > low).select(
                *trajectory.columns, F.col("position").cast("int").alias("position")
            )
        )
    )


def replay(
    trajectory: DataFrame,
    keys: list[str],
    epsilon: float = EPSILON,
    strict: bool = False,
    value: str = "val_acc",
) -> DataFrame:
    """Which rounds were accepted when rounds are judged in order.

    The first round is the start. Later ones are accepted when the value plus ``epsilon`` reaches the
    current value; with ``strict`` only when it beats the best so far. A run has few rounds (its
    tuning budget), which are folded as one array per run.
    """
    rounds = F.array_sort(F.collect_list(F.struct("round", F.col(value).alias("v"))))
    state = "struct<cur:double,out:array<struct<round:bigint,v:double,accepted:boolean,current:double>>>"

    def step(acc: Column, r: Column) -> Column:
        ok = r["v"] > acc["cur"] if strict else r["v"] + F.lit(epsilon) >= acc["cur"]
        ok = acc["cur"].isNull() | ok
        cur = F.when(ok, r["v"]).otherwise(acc["cur"])
        row = F.struct(
            r["round"].cast("bigint").alias("round"), r["v"].alias("v"), ok.alias("accepted"), cur.alias("current")
        )
        return F.struct(cur.alias("cur"), F.concat(acc["out"], F.array(row)).alias("out")).cast(state)

    start = F.struct(F.lit(None).alias("cur"), F.array().alias("out")).cast(state)
    folded = trajectory.groupBy(*keys).agg(rounds.alias("r"))
    return folded.select(*keys, F.inline(F.aggregate("r", start, step)["out"])).withColumnRenamed("v", value)


def drop_failed_runs(
    predictions: DataFrame, tuned: list[str], max_empty: float = 0.5
) -> tuple[DataFrame, DataFrame]:
    """Leaves out runs in which more than half of a tuned condition's predictions are empty.

    ``predictions(run_id, condition, pred array)``. Returns the kept rows and the excluded runs.
    """
    empty = (
        predictions.filter(F.col("condition").isin(tuned))
        .groupBy("run_id", "condition")
        .agg(F.avg((F.size("pred") == 0).cast("double")).alias("empty_share"))
    )
    excluded = empty.filter(F.col("empty_share") > max_empty).select("run_id").distinct()
    return predictions.join(excluded, "run_id", "left_anti"), excluded


def failure_sample(scored: DataFrame, k: int, seed: int | str, width: int | None = None) -> DataFrame:
    """``k`` wrong items in a reproducible random order; ``width`` shortens the texts."""
    wrong = scored.filter(~F.col("pred").eqNullSafe(F.col("gold")))
    if width is not None:
        wrong = wrong.withColumn("sentence", F.substring("sentence", 1, width))
    return wrong.orderBy(shuffle_key(F.col("item_id"), seed), "item_id").limit(k)


def explode_examples(
    items: DataFrame, dimension: str, labels: Column, loose: bool = False
) -> DataFrame:
    """One example per distinct codebook label of an item's gold; the source id is kept.

    Labels are matched by plain key, or with ``loose`` also by contained words.
    """
    values = gold_values(label_for(F.col("gold"), dimension))
    if loose:
        near = F.array_compact(F.transform(values, lambda v: match_label(v, labels)))
        found = F.array_distinct(F.filter(near, lambda x: x != ""))
    else:
        found = canonical_labels(values, labels)
    return items.select(
        F.col("item_id").alias("source_id"),
        F.col("content").alias("sentence"),
        "context",
        F.lit(dimension).alias("dimension"),
        F.posexplode_outer(found).alias("pos", "label"),
    ).filter(F.col("pos").isNotNull())


def coder_examples(items: DataFrame, dimension: str) -> DataFrame:
    """Examples of items with a non-blank label under the exact dimension; a list gives its first."""
    raw = F.try_element_at("gold", F.lit(dimension))
    first = trimmed(F.get(gold_values(raw), F.lit(0)))
    return items.select(
        F.col("item_id").alias("source_id"), F.col("content").alias("sentence"), "context", first.alias("gold")
    ).filter(F.col("gold") != "")
