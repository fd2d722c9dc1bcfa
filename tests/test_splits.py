"""Splits and resampling against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelworks.operators import resampling as R
from labelworks.operators import splits as P
from labelworks.operators.rank import bucketed_rank, shuffle_key


def test_bucketed_rank_is_row_number(spark):
    from pyspark.sql import Window

    df = spark.range(3000).withColumn("k", F.when(F.col("id") % 10 == 0, F.col("id") % 7).otherwise(0)).withColumn("o", shuffle_key(F.col("id"), 1))
    got = bucketed_rank(df, ["k"], "o", ["id"], digits=2)
    plain = got.withColumn("want", F.row_number().over(Window.partitionBy("k").orderBy("o", "id")))
    assert plain.filter("rank <> want").count() == 0 and got.count() == 3000


def greedy(want, want_n, amount):
    want, want_n, got = list(want), list(want_n), [0] * len(want)
    for _ in range(amount):
        i = max(range(len(want)), key=lambda j: (want[j], want_n[j], -j))
        want[i] -= 1
        want_n[i] -= 1
        got[i] += 1
    return got


def test_demand_is_the_greedy_count():
    rng = random.Random(3)
    for _ in range(300):
        k = rng.randint(1, 4)
        want = [rng.uniform(-5, 30) for _ in range(k)]
        want_n = [rng.uniform(0, 50) for _ in range(k)]
        amount = rng.randint(0, 40)
        assert P.fill_by_demand(want, want_n, amount) == greedy(want, want_n, amount)


def test_balanced_split(spark):
    rng = random.Random(5)
    rows = [(i, [x for x, p in (("a", 0.5), ("b", 0.2), ("c", 0.05)) if rng.random() < p]) for i in range(2000)]
    df = spark.createDataFrame(rows, "item_id bigint, labels array<string>")
    fr = {"train": 0.15, "val": 0.42, "test": 0.43}
    out = P.balanced_multilabel_split(df, "item_id", "labels", fr, 1)
    again = P.balanced_multilabel_split(df.repartition(5), "item_id", "labels", fr, 1)
    assert out.exceptAll(again).count() == 0
    rep = {(r["split"], r["label"]): r["n"] for r in P.split_report(out).collect()}
    assert sum(rep[s, None] for s in fr) == 2000
    for s, f in fr.items():
        assert abs(rep[s, None] - f * 2000) <= 5
        for x in "abc":
            total = sum(1 for _, ls in rows if x in ls)
            assert abs(rep[s, x] - f * total) <= 3, (s, x)


def test_tiny_classes(spark):
    rows = [("one", 1), ("two", 2), ("two", 3), ("three", 4), ("three", 5), ("three", 6)]
    out = P.stratified_split(spark.createDataFrame(rows, "label string, id bigint"), "label", "id", 1, 0.9, 0.9)
    got = {}
    for r in out.collect():
        got.setdefault(r["label"], []).append(r["split"])
    assert got["one"] == ["train"] and got["two"] == ["train", "train"]
    assert sorted(got["three"]) == ["train", "train", "train"]


def test_bootstrap_matches_resampling(spark):
    rng = np.random.default_rng(2)
    n = 300
    g = rng.random((n, 3)) < 0.4
    a, b = g ^ (rng.random((n, 3)) < 0.1), g ^ (rng.random((n, 3)) < 0.2)
    names = np.array(["x", "y", "z"])
    rows = [("k", *[list(names[m[i]]) for m in (g, a, b)]) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, gold array<string>, pred_a array<string>, pred_b array<string>")
    got = R.bootstrap_delta_f1(df, ["k"], iters=4000, seed=1).collect()[0]

    def f1(p, t):
        tp = (p & t).sum()
        return 2 * tp / (p.sum() + t.sum())

    assert got["point"] == pytest.approx((f1(a, g) - f1(b, g)) * 100)
    draws = []
    for _ in range(4000):
        i = rng.integers(0, n, n)
        draws.append((f1(a[i], g[i]) - f1(b[i], g[i])) * 100)
    draws.sort()
    assert got["low"] == pytest.approx(draws[100], abs=0.6) and got["high"] == pytest.approx(draws[3900], abs=0.6)
    acc = spark.createDataFrame([("k", "t", "t" if i % 4 else "u", "t" if i % 2 else "u") for i in range(400)], "k string, gold string, pred_a string, pred_b string")
    got = R.bootstrap_delta_accuracy(acc, ["k"], iters=1000, seed=1).collect()[0]
    assert got["point"] == pytest.approx(0.25) and got["low"] < 0.25 < got["high"]
    assert got["high"] - got["low"] == pytest.approx(2 * 1.96 * (0.25 * 0.75 / 400) ** 0.5, rel=0.15)


def test_gates(spark):
    df = spark.createDataFrame([("train",)] * 12 + [("val",)] * 4, "split string")
    got = {r["error"]: r["amount"] for r in P.split_gates(df, {"train": 0.5, "val": 0.5, "test": 0.0}).collect()}
    assert got == {"too_few_val": 4, "fraction_out_of_range": 1}


def test_balanced_split_of_many_disjoint_labels(spark):
    """Labels that share no item are placed together: passes do not grow with the labels."""
    rng = random.Random(11)
    rows = []
    for i in range(3000):
        branch = rng.randrange(40)
        rows.append((i, [f"b{branch}"] + [f"b{branch}.{k}" for k in range(3) if rng.random() < 0.3]))
    rows += [(3000 + i, None) for i in range(50)] + [(3100 + i, [None]) for i in range(50)]
    df = spark.createDataFrame(rows, "item_id bigint, labels array<string>")
    fr = {"train": 0.15, "val": 0.42, "test": 0.43}
    passes = []
    place = P._place_labels
    P._place_labels = lambda *a: (passes.append(1), place(*a))[1]
    try:
        out = P.balanced_multilabel_split(df, "item_id", "labels", fr, 1).collect()
    finally:
        P._place_labels = place
    assert len(passes) <= 6  # 160 labels in chains of at most four, ties included
    assert sorted(r["item_id"] for r in out) == sorted(r[0] for r in rows)
    assert all(sum(r["split"] == s for r in out) - f * len(rows) < 40 for s, f in fr.items())
    for x in {x for _, ls in rows for x in ls or [] if x}:
        mine = [r["split"] for r in out if r["labels"] and x in r["labels"]]
        for s, f in fr.items():
            assert abs(mine.count(s) - f * len(mine)) <= 3, (x, s)


def test_bootstrap_of_many_patterns(spark):
    """20,000 patterns are drawn in twenty buckets; no row holds them all."""
    rng = np.random.default_rng(4)
    n = 20_000
    parts = rng.integers(0, 40, (n, 6))
    rows = [([int(v) for v in p], int(m)) for p, m in zip(parts, rng.integers(1, 4, n))]
    patterns = spark.createDataFrame(rows, "pattern array<bigint>, m bigint").withColumn("k", F.lit(None).cast("string"))
    patterns = patterns.groupBy("k", "pattern").agg(F.sum("m").alias("m"))
    buckets = R._buckets(patterns, ["k"]).select(F.size("rows").alias("n")).collect()
    assert len(buckets) >= 20 and max(b["n"] for b in buckets) < 1300
    items = sum(m for _, m in rows)
    draws = R._replicates(patterns, ["k"], 300, 5, 6).collect()
    assert sorted(r["replicate"] for r in draws) == list(range(300))
    total = sum(np.array(p) * m for p, m in rows)
    square = sum(np.array(p) ** 2 * m for p, m in rows)
    sd = np.sqrt(square - total**2 / items)
    got = np.array([[r[f"s{i}"] for i in range(6)] for r in draws])
    assert (np.abs(got.mean(axis=0) - total) < 5 * sd / np.sqrt(300)).all()
    assert (np.abs(got.std(axis=0) / sd - 1) < 0.2).all()
    again = R._replicates(patterns.repartition(7), ["k"], 300, 5, 6).collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, draws), key=str)


def test_errors_without_keys(spark):
    acc = spark.createDataFrame([("t", "t" if i % 4 else "u", "t" if i % 2 else None) for i in range(400)], "gold string, pred_a string, pred_b string")
    (e,) = R.delta_accuracy_error(acc, []).collect()
    assert e["error"] == pytest.approx((0.25 * 0.75 / 400) ** 0.5) and e["n"] == 400
    (b,) = R.bootstrap_delta_accuracy(acc, [], iters=500, seed=1).collect()
    assert b["low"] < 0.25 < b["high"] and b["n"] == 400
