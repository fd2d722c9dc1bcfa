"""Column functions on small literal cases."""

import pytest
from pyspark.sql import functions as F

from labelworks import functions as L


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "fn,text,want",
    [
        (L.align_key, "Categories of Glass topics", "category of glass topic"),
        (L.align_key, "STRAßE", "strasse"),
        (L.dimension_key, "Level of X (A et al., 2012)", "level of x"),
        (L.agreement_key, "Central-Layer level", "central"),
        (L.agreement_key, "label", ""),
        (L.plain_key, " A, b ", "a b"),
        (L.gate_key, "Boss s yes", "bos s ye"),
        (L.header_key, " Coding_Theme ", "coding theme"),
        (L.sheet_label, "yes, it's one", "Yes"),
        (L.sheet_label, "north", "No"),
        (L.sheet_label, "self-made o'neil LEVEL", "Self-Made O'Neil"),
        (L.first_word, "  two words", "two"),
        (L.trimmed, "  x y\x1f\n", "x y"),
    ],
)
def test_keys(spark, fn, text, want):
    assert value(spark, fn(F.lit(text))) == want


@pytest.mark.parametrize(
    "answer,labels,want",
    [
        ("Answer: N/A", ["Emotional Support", "No label"], "No label"),
        ("Answer: none", ["Emotional Support", "No label"], "No label"),
        ("Answer: not applicable", ["Emotional Support", "No label"], "No label"),
        ("Answer: none", ["A", "B"], "none"),
        ("so\nAnswer: High.", ["High", "Low"], "High"),
        ("answer: high level", ["High level", "High"], "High level"),
        ("High, then low, then higher", ["High", "Low"], "Low"),
        ("Answer: unclear", ["High", "Low"], "unclear"),
        ("  nothing here ", ["High", "Low"], "nothing here"),
        ("Answer: c++ (fast)", ["c++", "c"], "c"),
        ("It is é-low", ["low"], "low"),
        ("It is élow", ["low"], "It is élow"),
        ("Answer:\n\n  Low..\nbye", ["High", "Low"], "Low"),
        ("Yes... no", ["Yes, a", "No, b"], "No, b"),
        ("Answer: I know", ["Yes, a", "No, b"], "I know"),
    ],
)
def test_parse_answer(spark, answer, labels, want):
    assert value(spark, L.parse_answer(F.lit(answer), labels)) == want


def test_match_label(spark):
    labels = ["Central", "Intermediate", "Functional support", "Emotional support", "No, it's not a confession"]
    cases = {
        "Central layer": "Central",
        "intermediate LEVEL": "Intermediate",
        "Functional": "Functional support",
        "no it s not a confession": "No, it's not a confession",
        "unknown": None,
        "support": "Functional support",
    }
    for raw, want in cases.items():
        assert value(spark, L.match_label(F.lit(raw), labels)) == want


def test_canonical_labels(spark):
    labels = ["Question-Asking", "Offers Advice, Opinions, And More"]
    got = value(spark, L.canonical_labels(F.array(F.lit("question asking"), F.lit("?"), F.lit("Question-asking")), labels))
    assert got == ["Question-Asking"]


def test_label_for_prefers_the_exact_name(spark):
    gold = F.create_map(F.lit("tone (old)"), F.lit("a"), F.lit("Tone"), F.lit("b"))
    assert value(spark, L.label_for(gold, "Tone")) == "b"
    assert value(spark, L.label_for(gold, "TONE!")) == "a"
    assert value(spark, L.label_for(gold, "Pitch")) is None


def test_status_and_target(spark):
    gold = F.array(F.lit("Question-asking"), F.lit("Paraphrase"))

    def status(p, g=gold, is_list=True):
        return value(spark, L.match_status(F.lit(p), g, F.lit(is_list)))

    assert status("paraphrase") == "partial"
    assert status("Humor") == "mismatch"
    assert status("") == "mismatch"
    assert status("x", F.array().cast("array<string>")) == "missing"
    assert status("x", F.array(F.lit("")), False) == "missing"
    assert status("level", F.array(F.lit("label")), False) == "match"
    assert value(spark, L.metric_target(F.lit("PARAPHRASE"), gold)) == "PARAPHRASE"
    assert value(spark, L.metric_target(F.lit("Humor"), gold)) == "Question-asking"


def test_payloads(spark):
    def arr(t):
        return value(spark, L.json_array_payload(F.lit(t)))

    def obj(t):
        return value(spark, L.json_object_payload(F.lit(t)))

    assert arr('```json\n[{"id": "a"},\n {"id": "b"}]\n```') == '[{"id": "a"},\n {"id": "b"}]'
    assert arr('x [{"a": "line\nbreak"}] y') == '[{"a": "line\nbreak"}]'
    assert arr('[{"a": 1}, {"b": "cut') == '[{"a": 1}]'
    assert arr("none") is None
    assert obj('so {"a": {"b": 1}} done') == '{"a": {"b": 1}}'
    assert obj('{"a": 1} {"b": 2}') is None
    assert obj("[1]") is None


def test_embedded_labels(spark):
    def got(a, b=None):
        return value(spark, L.embedded_labels(F.lit(a), F.lit(b) if b is not None else None))

    assert got('{"Theme": "Level A"}') == {"Theme": "Level A"}
    assert got('{"T": ["a", "b"]}') == {"T": '["a","b"]'}
    assert got("[1]") == {} and got("{bad") == {} and got("") == {}
    assert got("", '{"T": "x"}') == {"T": "x"}


def test_scores_and_tokens(spark):
    assert value(spark, L.parse_score(F.lit("about 0.75 or 1"))) == 0.75
    assert value(spark, L.parse_score(F.lit("no number"))) == 0.5
    assert [value(spark, L.rough_tokens(F.lit("x" * n))) for n in (0, 7, 8, 12, 13)] == [1, 1, 2, 2, 3]
    assert value(spark, L.parse_label_set(F.lit("Core | other\nnone"), ["None", "Core", "Other"])) == ["None", "Core", "Other"]
    assert value(spark, L.parse_label_set(F.lit(" N/A "), ["None", "Core"])) == []
