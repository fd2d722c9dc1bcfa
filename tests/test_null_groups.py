"""Null groups, repeated answers and several labels of one coder keep their rows."""

import pytest
from pyspark.sql import Row

from labelworks.operators import experiments, joins, metrics, resampling
from labelworks.operators.ledger import upsert_rules
from labelworks.plans import labeling


def test_null_groups_stay(spark):
    rows = [(None, i, float(i)) for i in range(9)]
    ends = experiments.trajectory_ends(spark.createDataFrame(rows, "run_id long, round int, val_acc double"), ["run_id"], 8)
    assert ends.count() == 8
    pairs = spark.createDataFrame([(None, None, "a")], "dimension string, true string, pred string")
    assert [r.n for r in metrics.confusion(pairs, ["dimension"]).collect() if r.true == "" and r.pred == "a"] == [1]
    sets = spark.createDataFrame(
        [(None, ["a"], None, ["a"]), (None, ["a"], ["a"], ["b"])],
        "g string, gold array<string>, pred_a array<string>, pred_b array<string>",
    )
    got = resampling.bootstrap_delta_f1(sets, ["g"], iters=20).collect()
    assert len(got) == 1 and round(got[0].point, 1) == 16.7


def test_all_labels_of_a_coder_count(spark):
    gold = spark.createDataFrame(
        [(1, "d", "a", "X"), (1, "d", "a", "Y"), (1, "d", "b", "Y"), (1, "d", "b", "X"), (1, "d", "b", "X")],
        "item_id long, dimension string, coder string, label string",
    )
    assert joins.pair_coders(gold, "a", "b").collect() == [Row(item_id=1, dimension="d", label_a="X; Y", label_b="X; Y")]


def test_rules_with_a_long_common_start_stay_apart(spark):
    schema = "k int, pos int, rule_id string, boundary string"
    new = spark.createDataFrame([(1, 1, None, "x" * 50 + "1"), (1, 2, None, "x" * 50 + "2")], schema)
    assert upsert_rules(spark.createDataFrame([], schema), new, ["k"]).count() == 2


def test_repeated_answers_do_not_end_the_job(spark):
    items = spark.createDataFrame([(1, "text", "")], "item_id long, content string, context string")
    rows = [(1, 0, "Yes", 3), (1, 0, "Yes", 3)]
    answers = spark.createDataFrame(rows, "item_id long, step_order int, response string, tokens long")
    step = labeling.Step(name="d", dims=["d"], labels={"d": ["Yes", "No"]})
    assert labeling.annotate(items, [step], labeling.recorded(answers)).first().tokens == 3


def test_purge_follows_the_tree(spark):
    sets = spark.createDataFrame([(1,), (2,)], "dataset_id long")
    jobs = spark.createDataFrame([(10, 1), (20, 2)], "job_id long, dataset_id long")
    results = spark.createDataFrame([(100, 10), (200, 20), (300, None)], "result_id long, job_id long")
    out = joins.purge_tree(
        {"datasets": sets, "jobs": jobs, "results": results}, sets.filter("dataset_id = 1"), "datasets", "dataset_id",
        [("jobs", "dataset_id", "datasets", "dataset_id"), ("results", "job_id", "jobs", "job_id")],
    )
    assert [r.job_id for r in out["jobs"].collect()] == [20]
    assert sorted(r.result_id for r in out["results"].collect()) == [200, 300]


def test_purge_needs_the_key(spark):
    sets = spark.createDataFrame([(1,), (2,)], "dataset_id long")
    results = spark.createDataFrame([(100, 10)], "result_id long, job_id long")
    with pytest.raises(ValueError, match="results"):
        joins.purge({"datasets": sets, "results": results}, sets.filter("dataset_id = 1"), "dataset_id")
    runs = spark.createDataFrame([(5, 1), (6, None)], "run_id long, gold_dataset_id long")
    out = joins.purge({"datasets": sets, "runs": runs}, sets.filter("dataset_id = 1"), "dataset_id")
    assert [r.dataset_id for r in out["datasets"].collect()] == [2]
    assert sorted((r.run_id, r.gold_dataset_id) for r in out["runs"].collect()) == [(5, None), (6, None)]
