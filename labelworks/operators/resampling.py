"""Bootstrap intervals and learned thresholds.

Resampling items with replacement only needs how many items show each outcome pattern: the counts
of n redrawn items over the patterns are multinomial. So the items are counted once, and the cost
of the replicates does not depend on the number of items.

The patterns may be many. They are dealt into buckets, and a replicate is drawn in two levels, which is
the same distribution: how many of the n items fall into each bucket, then, bucket by bucket, how they fall
on its patterns. A task holds the patterns of one bucket, or the totals of a group's buckets.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rank import join_safely

REPLICATES_PER_TASK_ROW = 250
DRAWS_PER_ROW = 250_000  # numbers that the first level hands on in one row
BUCKET_PATTERNS = 1_000
THRESHOLDS = 20


def _micro_f1(tp: Column, fp: Column, fn: Column) -> Column:
    p = F.try_divide(tp.cast("double"), (tp + fp).cast("double"))
    r = F.try_divide(tp.cast("double"), (tp + fn).cast("double"))
    return F.when(tp == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r))


def _f1_counts(gold: Column, pred: Column) -> list[Column]:
    hit = F.size(F.array_intersect(gold, pred))
    return [hit, F.size(pred) - hit, F.size(gold) - hit]


def _patterns(df: DataFrame, keys: list[str], parts: list[Column]) -> DataFrame:
    """Items per outcome pattern (an array of small whole numbers)."""
    pattern = F.array(*[p.cast("bigint") for p in parts])
    return df.groupBy(*keys, pattern.alias("pattern")).agg(F.count(F.lit(1)).alias("m"))


def _f1_patterns(df: DataFrame, keys: list[str]) -> DataFrame:
    """A null set counts as empty: a failed item misses its gold labels."""
    g, a, b = (F.array_distinct(F.coalesce(c, F.array())) for c in ("gold", "pred_a", "pred_b"))
    return _patterns(df, keys, _f1_counts(g, a) + _f1_counts(g, b))


def _accuracy_patterns(df: DataFrame, keys: list[str]) -> DataFrame:
    ok_a, ok_b = (F.col(c).eqNullSafe(F.col("gold")) for c in ("pred_a", "pred_b"))
    return _patterns(df, keys, [ok_a.cast("int"), ok_b.cast("int")])


def _buckets(patterns: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, bucket, total, rows): the patterns of a bucket with their counts, about ``BUCKET_PATTERNS``."""
    sizes = patterns.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / BUCKET_PATTERNS).alias("_buckets"))
    dealt = join_safely(patterns, sizes, keys)
    rows = F.array_sort(F.collect_list(F.concat("pattern", F.array("m")))).alias("rows")
    bucket = F.pmod(F.xxhash64("pattern"), F.col("_buckets")).cast("int").alias("bucket")
    return dealt.groupBy(*keys, bucket).agg(F.sum("m").alias("total"), rows)


def _first_level(buckets: DataFrame, keys: list[str], iters: int, seed: int) -> DataFrame:
    """(keys, n, bucket, start, draws): for the replicates from ``start`` on, the items that fall into a bucket, of n.

    A row of totals stands for thousand times as many patterns; the more buckets, the fewer replicates are
    drawn at once.
    """
    totals = buckets.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("bucket", "total"))).alias("totals"), F.sum("total").alias("n")
    )
    step = F.greatest(F.lit(1), F.least(F.lit(REPLICATES_PER_TASK_ROW), F.expr(f"{DRAWS_PER_ROW} div size(totals)")))
    # groups draw apart from each other: the key is part of the seed
    own = F.crc32(F.to_json(F.struct(*keys)).cast("binary"))
    blocks = totals.select(*keys, "n", "totals", own.cast("bigint").alias("own"), step.cast("int").alias("step")).select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(iters - 1), F.col("step"))).alias("start")
    )

    @F.pandas_udf("array<array<bigint>>")
    def draw(totals: pd.Series, own: pd.Series, start: pd.Series, step: pd.Series) -> pd.Series:
        out = []
        for t, g, at, k in zip(totals, own, start, step):
            m = np.array([x["total"] for x in t], np.int64)
            rng = np.random.default_rng([seed, int(g), int(at)])
            out.append(list(rng.multinomial(int(m.sum()), m / m.sum(), size=min(int(k), iters - int(at))).T))
        return pd.Series(out)

    drawn = blocks.repartition(*keys, "start").select(
        *keys, "n", "own", "start", "totals", draw("totals", "own", "start", "step").alias("_draws")
    )
    return drawn.select(
        *keys,
        "n",
        "own",
        "start",
        F.inline(F.zip_with("totals", "_draws", lambda t, d: F.struct(t["bucket"].alias("bucket"), d.alias("draws")))),
    )


def _replicates(patterns: DataFrame, keys: list[str], iters: int, seed: int, sums: int) -> DataFrame:
    """One row per (keys, replicate) with n and s0, s1, ...: the redrawn sums of the first ``sums`` numbers of a
    pattern.

    Second level: each bucket spreads its items over its own patterns in a task of its own; only the sums of
    a bucket and replicate leave it.
    """
    buckets = _buckets(patterns, keys)
    first = _first_level(buckets, keys, iters, seed)
    tasks = join_safely(first, buckets.drop("total"), [*keys, "bucket"]).repartition(*keys, "bucket", "start")

    @F.pandas_udf("array<array<bigint>>")
    def spread(rows: pd.Series, own: pd.Series, bucket: pd.Series, start: pd.Series, draws: pd.Series) -> pd.Series:
        out = []
        for r, g, b, at, n in zip(rows, own, bucket, start, draws):
            table = np.stack([np.asarray(x, dtype=np.int64) for x in r])
            m = table[:, -1]
            rng = np.random.default_rng([seed, int(g), int(at), int(b) + 1])
            n = np.asarray(n, np.int64)
            parts = [
                rng.multinomial(n[i : i + 64], m / m.sum()) @ table[:, :sums] for i in range(0, len(n), 64)
            ]
            out.append(list(np.concatenate(parts)))
        return pd.Series(out)

    spreads = tasks.select(
        *keys, "n", "start", F.posexplode(spread("rows", "own", "bucket", "start", "draws")).alias("_at", "_sums")
    )
    return spreads.groupBy(*keys, (F.col("start") + F.col("_at")).alias("replicate")).agg(
        F.first("n").alias("n"), *[F.sum(F.get("_sums", F.lit(i))).alias(f"s{i}") for i in range(sums)]
    )


def _interval(
    patterns: DataFrame, point: Column, delta: Column, keys: list[str], iters: int, seed: int, sums: int
) -> DataFrame:
    """Point and 95 % interval. ``delta`` is the statistic of a replicate, in its sums s0, s1, ... and, as
    ``n``, the number of items."""
    shown = list(keys)
    patterns, keys = _grouped(patterns, keys)
    points = patterns.groupBy(*keys).agg(point.alias("point"), F.sum("m").alias("n"))
    drawn = _replicates(patterns, keys, iters, seed, sums)
    ordered = F.array_sort(F.collect_list("delta"))  # exactly ``iters`` numbers per group
    bounds = (
        drawn.select(*keys, delta.alias("delta"))
        .groupBy(*keys)
        .agg(ordered.alias("d"))
        .select(
            *keys,
            F.get("d", F.lit(int(0.025 * iters))).alias("low"),
            F.get("d", F.lit(int(0.975 * iters))).alias("high"),
        )
    )
    return join_safely(points, bounds, keys).select(*shown, "point", "n", "low", "high")


def _grouped(patterns: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str]]:
    """Without keys all rows are one group under a key of its own."""
    return (patterns, list(keys)) if keys else (patterns.withColumn("_all", F.lit(0)), ["_all"])


def _sum(i: int) -> Column:
    return F.sum(F.get("pattern", F.lit(i)) * F.col("m"))


def delta_f1(df: DataFrame, keys: list[str]) -> DataFrame:
    """micro-F1(a) - micro-F1(b) in points. ``gold``, ``pred_a``, ``pred_b`` are label arrays."""
    return _f1_patterns(df, keys).groupBy(*keys).agg(
        _f1_point().alias("point"), F.sum("m").alias("n")
    )


def _f1_point() -> Column:
    return (_micro_f1(_sum(0), _sum(1), _sum(2)) - _micro_f1(_sum(3), _sum(4), _sum(5))) * 100


def bootstrap_delta_f1(
    df: DataFrame, keys: list[str], iters: int = 10_000, seed: int = 0
) -> DataFrame:
    """95 % interval of micro-F1(a) - micro-F1(b), paired by item, in points."""
    s = [F.col(f"s{i}") for i in range(6)]
    delta = (_micro_f1(*s[:3]) - _micro_f1(*s[3:])) * 100
    return _interval(_f1_patterns(df, keys), _f1_point(), delta, keys, iters, seed, 6)


def delta_accuracy(df: DataFrame, keys: list[str]) -> DataFrame:
    """accuracy(a) - accuracy(b) against the same gold label, as a fraction."""
    return _accuracy_patterns(df, keys).groupBy(*keys).agg(
        _accuracy_point().alias("point"), F.sum("m").alias("n")
    )


def _accuracy_point() -> Column:
    return (_sum(0) - _sum(1)).cast("double") / F.sum("m")


def bootstrap_delta_accuracy(
    df: DataFrame, keys: list[str], iters: int = 10_000, seed: int = 0
) -> DataFrame:
    """95 % interval of accuracy(a) - accuracy(b), paired by item, as a fraction."""
    delta = (F.col("s0") - F.col("s1")).cast("double") / F.col("n")
    return _interval(_accuracy_patterns(df, keys), _accuracy_point(), delta, keys, iters, seed, 2)


# ---- standard errors -------------------------------------------------------------------------


def _error(patterns: DataFrame, keys: list[str], totals: list[Column], part: Column, scale: float) -> DataFrame:
    """Standard error of a statistic from its linear parts: ``part`` is what an item of a pattern adds, in the
    pattern's numbers and the group's ``totals`` (t0, t1, ...) and ``n``."""
    shown = list(keys)
    patterns, keys = _grouped(patterns, keys)
    sums = patterns.groupBy(*keys).agg(F.sum("m").alias("n"), *[t.alias(f"t{i}") for i, t in enumerate(totals)])
    rows = join_safely(patterns, sums, keys).withColumn("_x", part)
    mean = F.sum(F.col("_x") * F.col("m")) / F.sum("m")
    spread = F.sum(F.col("_x") * F.col("_x") * F.col("m")) / F.sum("m") - mean * mean
    error = F.sqrt(F.greatest(spread, F.lit(0.0)) / F.sum("m")) * scale
    return rows.groupBy(*keys).agg(error.alias("error"), F.sum("m").alias("n")).select(*shown, "error", "n")


def delta_f1_error(df: DataFrame, keys: list[str]) -> DataFrame:
    """Standard error of ``delta_f1`` by the delta method, in points: a check on the bootstrap's width, and the
    interval to use where 10,000 replicates are too dear. Null where a labeler has nothing to be scored on."""
    p = [F.get("pattern", F.lit(i)) for i in range(6)]

    def part(at: int) -> Column:
        size = 2 * F.col(f"t{at}") + F.col(f"t{at + 1}") + F.col(f"t{at + 2}")
        f1 = F.try_divide(2.0 * F.col(f"t{at}"), size.cast("double"))
        own = 2 * p[at] + p[at + 1] + p[at + 2]
        return F.try_divide((2.0 * p[at] - f1 * own) * F.col("n"), size.cast("double"))

    totals = [_sum(i) for i in range(6)]
    return _error(_f1_patterns(df, keys), keys, totals, part(0) - part(3), 100.0)


def delta_accuracy_error(df: DataFrame, keys: list[str]) -> DataFrame:
    """Standard error of ``delta_accuracy``, as a fraction."""
    p = [F.get("pattern", F.lit(i)) for i in range(2)]
    return _error(_accuracy_patterns(df, keys), keys, [], (p[0] - p[1]).cast("double"), 1.0)


# ---- thresholds ------------------------------------------------------------------------------


def learn_threshold(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Threshold of .05, .10, ... .95 with the best accuracy of "yes when score >= t"; the first
    one wins a tie. ``scores(keys, score, truth)`` with truth 0/1. One partial aggregation."""
    hits = [
        F.sum(((F.col("score") >= F.lit(i / THRESHOLDS)).cast("int") == F.col("truth")).cast("bigint"))
        for i in range(1, THRESHOLDS)
    ]
    best = F.array_max(
        F.array(
            *[
                F.struct(h.alias("ok"), F.lit(-i).alias("first"), F.lit(i / THRESHOLDS).alias("t"))
                for i, h in enumerate(hits, 1)
            ]
        )
    )
    return (
        scores.groupBy(*keys)
        .agg(best.alias("b"), F.count(F.lit(1)).alias("n"))
        .select(*keys, F.col("b.t").alias("threshold"), (F.col("b.ok") / F.col("n")).alias("accuracy"), "n")
    )


def threshold_accuracy(scores: DataFrame, thresholds: DataFrame, keys: list[str], group: list[str]) -> DataFrame:
    """Accuracy of given thresholds: ``thresholds`` is joined by ``keys``; rows grouped by ``group``."""
    said = (F.col("score") >= F.col("threshold")).cast("int") == F.col("truth")
    return (
        scores.join(thresholds, keys)
        .groupBy(*group)
        .agg(F.avg(said.cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n"))
    )
