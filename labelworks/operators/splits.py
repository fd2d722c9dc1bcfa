"""Reproducible splits that hold for classes of any size.

Items are ordered by a seeded hash and ranked with :func:`rank.bucketed_rank`; a split is then a
comparison of the rank with cut points, so no class is ever gathered in one task.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import stored
from .rank import bucketed_rank, running_total, shuffle_key

TINY_CLASS = 3
MIN_EXAMPLES = 15
MIN_TRAIN = 5
MIN_VAL = 5
FRACTION_SLACK = 0.01


def seeded_order(df: DataFrame, key: str, seed: int | str) -> DataFrame:
    """Rows in a reproducible random order."""
    return df.orderBy(shuffle_key(F.col(key), seed), key)


def _half_even(x: Column) -> Column:
    return F.bround(x, 0).cast("bigint")


def _ranked(df: DataFrame, keys: list[str], item: str, seed: int | str) -> DataFrame:
    return bucketed_rank(df.withColumn("_order", shuffle_key(F.col(item), seed)), keys, "_order", [item]).drop("_order")


def _cut(rank: Column, train: Column, val: Column) -> Column:
    return F.when(rank <= train, "train").when(rank <= train + val, "val").otherwise("test")


def stratified_split(
    examples: DataFrame,
    label: str,
    item: str,
    seed: int | str,
    train_frac: float = 0.15,
    val_frac: float = 0.42,
    scope: list[str] = (),
) -> DataFrame:
    """Adds ``split`` with every class spread by the fractions.

    A class of n items gives round(f*n), half-even and at least one, to train and val and leaves at
    least one for test where it can; classes under three items go to train.
    """
    ranked = _ranked(examples, [*scope, label], item, seed)
    n = F.col("total")
    train = F.greatest(F.lit(1), _half_even(n * F.lit(float(train_frac))))
    want = F.greatest(F.lit(1), _half_even(n * F.lit(float(val_frac))))
    val = F.when(train + want > n - 1, F.greatest(F.lit(1), n - train - 1)).otherwise(want)
    split = F.when(n < TINY_CLASS, "train").otherwise(_cut(F.col("rank"), train, val))
    return ranked.withColumn("split", split).drop("rank", "total")


def grouped_split(
    examples: DataFrame,
    seed: int | str,
    train_frac: float = 0.15,
    val_frac: float = 0.42,
) -> DataFrame:
    """Splits source items, not examples: the class is the item's first label and all its examples
    follow it. ``examples(source_id, pos, label, ...)``."""
    first = examples.groupBy("source_id").agg(F.min_by("label", "pos").alias("_class"))
    assigned = stratified_split(first, "_class", "source_id", seed, train_frac, val_frac)
    return examples.join(assigned.select("source_id", "split"), "source_id")


def two_way_split(
    examples: DataFrame, label: str, item: str, seed: int | str, train_frac: float = 0.7
) -> DataFrame:
    """Train and val only; every class of two or more keeps one item for val."""
    ranked = _ranked(examples, [label], item, seed)
    n = F.col("total")
    train = F.least(n - 1, F.greatest(F.lit(1), _half_even(n * F.lit(float(train_frac)))))
    split = F.when((n < 2) | (F.col("rank") <= train), "train").otherwise("val")
    return ranked.withColumn("split", split).drop("rank", "total")


def fraction_split(
    items: DataFrame,
    item: str,
    seed: int | str,
    train_frac: float = 0.4,
    val_frac: float = 0.3,
    floors: bool = False,
    scope: list[str] = (),
) -> DataFrame:
    """Splits without strata: whole-number cuts, or with ``floors`` rounded cuts with at least five
    train and val items and up to three moved from train to a test set smaller than three."""
    ranked = _ranked(items, list(scope), item, seed)
    n = F.col("total")
    if not floors:
        train = F.floor(n * F.lit(float(train_frac)))
        val = F.floor(n * F.lit(float(val_frac)))
        split = _cut(F.col("rank"), train, val)
        return ranked.withColumn("split", split).drop("rank", "total")
    train = F.greatest(F.lit(MIN_TRAIN), _half_even(n * F.lit(float(train_frac))))
    val = F.greatest(F.lit(MIN_VAL), _half_even(n * F.lit(float(val_frac))))
    test = F.greatest(F.lit(0), n - train - val)
    steal = F.when(
        (test < 3) & (train > MIN_TRAIN), F.least(3 - test, train - MIN_TRAIN)
    ).otherwise(F.lit(0))
    return ranked.withColumn("split", _cut(F.col("rank"), train - steal, val)).drop("rank", "total")


def split_report(assigned: DataFrame, labels: str = "labels") -> DataFrame:
    """Items per split (label null) and label support per split, in one pass."""
    rows = F.concat(F.array(F.lit(None).cast("string")), F.col(labels))
    return (
        assigned.select("split", F.explode(rows).alias("label"))
        .groupBy("split", "label")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def split_gates(assigned: DataFrame, fractions: dict[str, float]) -> DataFrame:
    """Why a split must not be used; empty when it may. ``assigned`` has one row per example."""
    bad_sum = abs(sum(fractions.values()) - 1.0) > FRACTION_SLACK
    bad = [n for n, f in fractions.items() if not 0.0 < f < 1.0]
    counts = assigned.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("split") == "train").alias("train"),
        F.count_if(F.col("split") == "val").alias("val"),
    )

    def when(cond: Column, name: str, value: Column) -> Column:
        return F.when(cond, F.struct(F.lit(name).alias("error"), value.cast("bigint").alias("amount")))

    checks = F.array(
        when(F.col("n") < MIN_EXAMPLES, "too_few_examples", F.col("n")),
        when((F.col("train") < MIN_TRAIN) & (F.col("n") >= MIN_EXAMPLES), "too_few_train", F.col("train")),
        when((F.col("val") < MIN_VAL) & (F.col("n") >= MIN_EXAMPLES), "too_few_val", F.col("val")),
        when(F.lit(bad_sum), "fractions_do_not_sum_to_one", F.lit(len(fractions))),
        when(F.lit(bool(bad)), "fraction_out_of_range", F.lit(len(bad))),
    )
    return counts.select(F.inline(F.array_compact(checks)))


# ---- multi-label balance ---------------------------------------------------------------------


def balanced_multilabel_split(
    items: DataFrame,
    item: str,
    labels: str,
    fractions: dict[str, float],
    seed: int | str,
) -> DataFrame:
    """Adds ``split`` so that each label's support follows the fractions. Null label arrays, and nulls in them,
    count as no label.

    A label is placed once all labels that it shares an unplaced item with are more frequent among the unplaced
    items (ties: by name); its items go to the splits that still want most of it (ties: to the split that
    wants most items). Items without labels fill up by size at the end.

    Items with the same label set are interchangeable, so the passes work on counts per distinct label set;
    the items themselves are read twice, once to count the sets and once to rank every item within its set
    and cut the ranks at the set's quotas. Labels placed in one pass have no set in common, so a pass takes
    all of them at once: the number of passes is the length of the longest chain of ever more frequent
    labels that share items, not the number of labels. Demand, amounts and quotas stay in tables; the
    driver sees sums per split.
    """
    if abs(sum(fractions.values()) - 1.0) > 1e-6:
        raise ValueError("fractions must sum to 1")
    names = list(fractions)
    clean = F.array_compact(F.coalesce(F.col(labels).cast("array<string>"), F.array().cast("array<string>")))
    rows = items.withColumn("_set", F.to_json(F.array_sort(F.array_distinct(clean))))
    sets = rows.groupBy("_set").agg(F.count(F.lit(1)).alias("m"))
    sets = sets.withColumn("_labels", F.from_json("_set", "array<string>"))
    sets = sets.withColumn("_order", shuffle_key(F.col("_set"), seed)).withColumn(
        "quota", F.lit(None).cast("array<bigint>")
    )
    sets = stored(sets, "label-sets")
    support = sets.select(F.explode("_labels").alias("label"), "m").groupBy("label").agg(F.sum("m").alias("support"))
    support = stored(support, "label-support")
    shares = [float(fractions[s]) for s in names]
    placed = [F.coalesce(F.sum(F.get("quota", F.lit(i))), F.lit(0)) for i in range(len(names))]
    open_ = F.col("quota").isNull()
    labeled = F.count_if(open_ & (F.size("_labels") > 0))
    while True:
        n, left, *given = sets.agg(F.coalesce(F.sum("m"), F.lit(0)), labeled, *placed).first()
        wanted_n = [f * n - g for f, g in zip(shares, given)]
        if not left:
            break
        sets = stored(_place_labels(sets, support, shares, wanted_n), "label-sets")
    rest = n - sum(given)
    if rest:
        counts = F.array(*[F.lit(c).cast("bigint") for c in fill_by_demand(wanted_n, wanted_n, rest)])
        pool = sets.filter(open_).select("_set", F.lit("").alias("label"), counts.alias("counts"))
        sets = stored(_give_quotas(sets, pool, len(names)), "label-sets")
    ranked = bucketed_rank(
        rows.withColumn("_order", shuffle_key(F.col(item), seed)),
        ["_set"],
        "_order",
        [item],
        attach=sets.select("_set", "quota"),
    )
    split = F.lit(names[-1])
    for i in range(len(names) - 2, -1, -1):
        upto = sum((F.get("quota", F.lit(j)) for j in range(i + 1)), F.lit(0))
        split = F.when(F.col("rank") <= upto, names[i]).otherwise(split)
    return ranked.withColumn("split", split).select(*items.columns, "split")


def _place_labels(sets: DataFrame, support: DataFrame, shares: list[float], wanted_n: list[float]) -> DataFrame:
    """One pass: quotas for the open sets of every label that is the rarest in all of its open sets."""
    k = len(shares)
    pairs = sets.select("_set", "m", "quota", F.explode("_labels").alias("label"))
    facts = pairs.groupBy("label").agg(
        F.sum(F.when(F.col("quota").isNull(), F.col("m"))).alias("amount"),
        F.array(*[F.coalesce(F.sum(F.get("quota", F.lit(i))), F.lit(0)) for i in range(k)]).alias("given"),
    )
    facts = facts.filter("amount > 0")
    ranked = pairs.filter("quota IS NULL").join(facts.select("label", "amount"), "label")
    in_order = ranked.groupBy("_set").agg(F.array_sort(F.collect_list(F.struct("amount", "label"))).alias("ls"))
    first = in_order.select("_set", F.posexplode("ls").alias("_at", "l")).select(
        "_set", "l.label", (F.col("_at") == 0).alias("is_first")
    )
    ready = first.groupBy("label").agg(F.bool_and("is_first").alias("ready")).filter("ready").select("label")

    @F.pandas_udf("array<bigint>")
    def fill(amount: pd.Series, support: pd.Series, given: pd.Series) -> pd.Series:
        return pd.Series(
            [
                fill_by_demand([f * int(s) - int(g) for f, g in zip(shares, gs)], wanted_n, int(a))
                for a, s, gs in zip(amount, support, given)
            ]
        )

    counts = facts.join(ready, "label").join(support, "label").select("label", fill("amount", "support", "given").alias("counts"))
    pool = first.filter("is_first").join(counts, "label").select("_set", "label", "counts")
    return _give_quotas(sets, pool, k)


def fill_by_demand(want: list[float], want_n: list[float], amount: int) -> list[int]:
    """How many of ``amount`` items each split takes when every item goes to the split that wants
    most (ties: wants most items). Demand falls by one per item, so all splits are first taken down
    to one common level at once and only the last few items are given one by one."""
    ordered = sorted(want, reverse=True)
    level = max((sum(ordered[: j + 1]) - amount) / (j + 1) for j in range(len(ordered)))
    got = [max(0, math.floor(w - level)) for w in want]
    while sum(got) > amount:
        got[max(range(len(got)), key=lambda i: got[i] - want[i])] -= 1
    while sum(got) < amount:
        got[max(range(len(want)), key=lambda i: (want[i] - got[i], want_n[i] - got[i], -i))] += 1
    return got


def _give_quotas(sets: DataFrame, pool: DataFrame, k: int) -> DataFrame:
    """Spreads each label's split counts over the label's pool, evenly along a random order of its sets.

    ``pool(_set, label, counts)`` has a set once. Position x of a pool has given floor-type shares to each split,
    so the quotas of a set are the differences between its end and its start: whole numbers that add up
    exactly. Large pools are summed bucket by bucket.
    """
    inside = running_total(
        sets.drop("quota").join(pool, "_set"), ["label"], "_order", ["_set"], F.col("m")
    ).drop("total")
    counts = [F.get("counts", F.lit(i)) for i in range(k)]

    def upto(x: Column) -> list[Column]:
        left_rows, left_all, out = x, sum(counts[1:], counts[0]), []
        for c in counts[:-1]:
            part = F.floor(left_rows.cast("decimal(38,0)") * c / F.greatest(left_all, F.lit(1))).cast("bigint")
            out.append(part)
            left_rows, left_all = left_rows - part, left_all - c
        return [*out, left_rows]

    start, end = upto(F.col("before")), upto(F.col("before") + F.col("m"))
    quota = F.array(*[(e - s).cast("bigint") for s, e in zip(start, end)])
    done = inside.select("_set", quota.alias("_quota"))
    return sets.join(done, "_set", "left").withColumn("quota", F.coalesce("quota", "_quota")).drop("_quota")
