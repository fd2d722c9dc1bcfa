"""Coder CSV -> items -> predictions -> evidence, metrics, confusion."""

import pytest

from labelworks.operators.joins import evidence, review_order
from labelworks.plans.evaluation import class_metrics_by_dimension, confusion_by_dimension, metrics_by_dimension
from labelworks.sources.sheets import collapse_coder_rows, read_coder_csv

DIMENSION = "Listening Strategy (Somebody et al., 2001)"
SHEET = """Row,Response ID,Coding theme,Level,Relevant quotes 
1,R_1,Listening strategy,Question-asking,"How did you come up with that?"
2,R_2,Listening strategy,Question-asking,"Tell me more about that."
2,R_2,Listening strategy,Paraphrase,"Tell me more about that."
3,R_3,Listening strategy,Sympathetic responsiveness,"I understand how hard that must feel."
4,R_4,Listening strategy,Back-channel response,"Uh-huh."
"""
SAID = ["Question-Asking", "Paraphrase", "Question-Asking", "Back-Channel Response"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sheet") / "a.csv"
    path.write_text(SHEET)
    items = collapse_coder_rows(read_coder_csv(spark, str(path)), ["file"], "ord")
    items = items.withColumnRenamed("idx", "item_id").cache()
    predictions = spark.createDataFrame(
        [(i, 7, i, 0, DIMENSION, x) for i, x in enumerate(SAID)],
        "pred_id bigint, job_id bigint, item_id bigint, step_order int, dimension string, label string",
    )
    return items, predictions


def test_items(tables):
    rows = {r["item_id"]: r for r in tables[0].collect()}
    assert len(rows) == 4
    assert rows[1]["content"] == "Tell me more about that."
    assert rows[1]["gold"] == {"Listening strategy": '["Question-asking","Paraphrase"]'}
    assert rows[0]["gold"] == {"Listening strategy": "Question-asking"}
    assert rows[0]["metadata"] == {"Row": "1", "Response ID": "R_1"}


def test_evidence(tables):
    items, predictions = tables
    rows = evidence(predictions, items, items, DIMENSION).collect()
    status = {r["content"]: r["match_status"] for r in rows}
    assert status == {
        "How did you come up with that?": "match",
        "Tell me more about that.": "partial",
        "I understand how hard that must feel.": "mismatch",
        "Uh-huh.": "match",
    }
    review = evidence(predictions, items, items, DIMENSION, review_only=True).orderBy(*review_order())
    assert [r["match_status"] for r in review.collect()] == ["mismatch", "partial"]


def test_metrics(tables):
    items, predictions = tables
    m = metrics_by_dimension(predictions, items).collect()[0]
    assert (m["dimension"], m["n"], m["accuracy"]) == (DIMENSION, 4, 0.75)
    assert m["weighted_f1"] == pytest.approx((2 / 3 + 1 + 0 + 1) / 4)
    per = {r["class"]: r for r in class_metrics_by_dimension(predictions, items).collect()}
    assert (per["Question-Asking"]["tp"], per["Question-Asking"]["fp"]) == (1, 1)
    assert per["Sympathetic responsiveness"]["fn"] == 1


def test_confusion(tables):
    items, predictions = tables
    cells = {(r["true"], r["pred"]): r["n"] for r in confusion_by_dimension(predictions, items, DIMENSION).collect()}
    assert len(cells) == 16 and sum(cells.values()) == 4
    assert cells["Question-Asking", "Question-Asking"] == 1
    assert cells["Sympathetic responsiveness", "Question-Asking"] == 1
    assert cells["Back-Channel Response", "Back-Channel Response"] == 1


def test_gold_of_equal_text(spark):
    items = spark.createDataFrame(
        [(1, "same", "", {}, {}), (2, "same", "", {}, {"Tone": "Warm"}), (3, "same", "", {}, {"Tone": "Cold"}),
         (4, "row", "", {"Unnamed: 3": "tone", "Unnamed: 4": "Warm", "Unnamed: 6": "quoted"}, {})],
        "item_id bigint, content string, context string, metadata map<string,string>, gold map<string,string>",
    )
    p = spark.createDataFrame(
        [(i, 1, i, 0, "Tone", "warm") for i in (1, 4)],
        "pred_id bigint, job_id bigint, item_id bigint, step_order int, dimension string, label string",
    )
    rows = {r["item_id"]: r for r in evidence(p, items, items, "Tone").collect()}
    assert (rows[1]["gold_label"], rows[1]["match_status"]) == ("Warm", "match")
    assert (rows[4]["gold_label"], rows[4]["match_status"], rows[4]["content"]) == ("Warm", "match", "quoted")


def test_empty_metrics(spark):
    from labelworks.operators.metrics import classification_metrics, multilabel_metrics

    none = spark.createDataFrame([], "true string, pred string")
    m = classification_metrics(none, []).collect()[0]
    assert (m["n"], m["accuracy"]) == (0, 0.0)
    sets = spark.createDataFrame([([], []), (["a", "a"], ["a"]), (["a"], ["b", ""])], "gold array<string>, pred array<string>")
    m = multilabel_metrics(sets, []).collect()[0]
    assert (m["n"], m["n_labels"]) == (3, 2)
    assert m["accuracy"] == pytest.approx(2 / 3)
    assert m["macro_f1"] == pytest.approx((2 / 3 + 0) / 2)
