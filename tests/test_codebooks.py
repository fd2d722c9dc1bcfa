"""Gate maps, step order, prompts."""

import json
import random
import re

import pytest

from labelworks.operators import codebooks as C
from labelworks.plans import labeling as P
from labelworks.plans import library as L
from labelworks.plans.prompts import prompt_table, step_prompts
from labelworks.sources.sheets import codebook_tables

BOOK = {
    "name": "Small",
    "dimensions": [
        {"name": "Topics", "labels": [{"name": "Work Stress", "definition": "w", "examples": ["busy"]}, {"name": "Writing", "definition": ""}, {"name": "Roleplay"}]},
        {"name": "Level of Disclosure", "labels": [{"name": "High"}, {"name": "Low"}, {"name": "No"}], "instructions": "Look closely."},
    ],
}
ALLOWED = {"High": ["Work Stress", "Roleplays", "ghost"], "low": ["Writing", "Work Stress", "writing"], "Unknown": ["Writing"]}
CATEGORY = {"Work Stress": "Life", "Writing": "Fun", "Roleplay": "fun"}


@pytest.fixture(scope="module")
def folded(spark):
    dims, labels = codebook_tables(spark.createDataFrame([("b", json.dumps(BOOK))], "codebook_id string, body string"))
    rows, n = [], 0
    for gate, leaves in ALLOWED.items():
        for leaf in leaves:
            rows.append(("b", "topic", "Levels of disclosure", "Topic categories", gate, leaf, n))
            n += 1
    allowed = spark.createDataFrame(rows, "codebook_id string, dimension string, gated_by string, category_dimension string, gate_value string, leaf string, ord bigint")
    cats = spark.createDataFrame([("b", k, v) for k, v in CATEGORY.items()], "codebook_id string, leaf string, category string")
    return C.fold_gate_map(dims, labels, allowed, cats)


def test_fold(folded):
    dims, labels, dropped = folded
    got = [(r["dim"], r["label"], r["path"]) for r in labels.filter("dim <> 'Level of Disclosure'").orderBy("dim", "sort_order").collect()]
    assert got == [
        ("Topic categories", "Life", ["High"]), ("Topic categories", "fun", ["High"]), ("Topic categories", "Fun", ["Low"]), ("Topic categories", "Life", ["Low"]),
        ("Topics", "Work Stress", ["High"]), ("Topics", "Roleplay", ["High"]), ("Topics", "Writing", ["Low"]), ("Topics", "Work Stress", ["Low"]),
    ]
    d = {r["dim"]: r for r in dims.collect()}
    assert d["Topics"]["gated_by"] == d["Topic categories"]["gated_by"] == "Level of Disclosure"
    assert d["Topic categories"]["context_dims"] == ["Topics"]
    assert sorted((r["leaf"], r["reason"]) for r in dropped.collect()) == [("Writing", "unknown gate value"), ("ghost", "unknown leaf")]


def gated_book():
    return {"dimensions": [
        {"name": "Category", "gated_by": "Level", "context_dims": ["Topic"], "labels": [{"name": "Life", "path": ["High"]}]},
        {"name": "Topic", "gated_by": "Level", "labels": [{"name": "Work", "path": ["High"]}, {"name": "Play", "path": ["Low"]}, {"name": "Work", "path": ["Low"]}]},
        {"name": "Level", "labels": [{"name": "High"}, {"name": "Low"}]},
        {"name": "Rollup", "derived_from": "Topic", "labels": [{"name": "x"}]},
    ]}


def tables(spark, book):
    return codebook_tables(spark.createDataFrame([("b", json.dumps(book))], "codebook_id string, body string"))


def test_steps(spark):
    steps = L.codebook_steps(spark, gated_book())
    assert [s.name for s in steps] == ["Level", "Topic", "Category"]
    topic = steps[1]
    assert topic.gated_labels == {"High": ["Work"], "Low": ["Play", "Work"]}
    assert "Play" in topic.gated_prompts["Low"] and "Play" not in topic.gated_prompts["High"]
    assert steps[2].context_from == ["Topic"]


def test_step_order_of_circles_and_chains(spark):
    rows = [
        # a chain against the order of the codebook: a turn each
        ("chain", "a", 0, "b", []), ("chain", "b", 1, "c", []), ("chain", "c", 2, "", ["nowhere"]),
        # with the order: all in the first turn
        ("along", "a", 0, "", []), ("along", "b", 1, "a", []), ("along", "c", 2, "a", ["b", "a"]),
        # b and c wait for each other, d for b, e for itself; all last, by place
        ("circle", "b", 0, "c", []), ("circle", "c", 1, "b", []), ("circle", "d", 2, "", ["b"]), ("circle", "e", 3, "e", []), ("circle", "a", 4, None, None),
        (None, "x", 0, "y", []), (None, "y", 1, "", []),
    ]
    dims = spark.createDataFrame([(*r, None) for r in rows], "codebook_id string, dim string, sort_order bigint, gated_by string, context_dims array<string>, derived_from string")
    got = {}
    for r in L.step_order(dims).orderBy("step_order").collect():
        got.setdefault(r["codebook_id"], []).append(r["dim"])
    assert got == {"chain": ["c", "b", "a"], "along": ["a", "b", "c"], "circle": ["a", "b", "c", "d", "e"], None: ["y", "x"]}
    assert L.step_order(dims.limit(0)).count() == 0


def test_prompt_texts(spark):
    book = {"dimensions": [
        {"name": "Mood", "gated_by": "Level", "instructions": "Read twice.", "labels": [
            {"name": "Glad", "path": ["High", "Warm"], "definition": "g", "examples": ["e1", " ", "e3"]}, {"name": "No label", "path": ["High"]}, {"name": "Sad", "path": ["Low"]}]},
        {"name": "Is it", "type": "binary", "labels": [{"name": "Yes, a"}, {"name": "Not"}]},
    ]}
    got = {(r["dim"], r["gate_value"]): r["prompt"] for r in prompt_table(*tables(spark, book), True).collect()}
    rule = 'If none of the substantive labels apply to the input, use "No label". Do not force a substantive label just because the output format requires an answer.'
    head = "You will receive a sentence (and optional context). Classify it using EXACTLY ONE of these labels:\n"
    end = "\n## Output Format\nThink step-by-step, then write your final answer as:\nAnswer: "
    assert got["Mood", "High"] == (
        'You are an expert annotator classifying text on the dimension "Mood".\n\n' + head
        + '"Glad", "No label"\n\n## Label Definitions\n- Warm:\n  - **Glad**: g\n- **No label**:\n'
        + '\n## Additional Instructions\nYou already determined Level = "High". Choose the single best label below; only these apply at this Level value. Read twice.\n'
        + rule + "\n" + end + '<one of "Glad", "No label">\n\n## Examples\nSentence: "e1"\nAnswer: Glad\n'
    )
    assert got["Is it", None] == (
        'You are an expert annotator classifying text on the dimension "Is it".\n\n' + head
        + '"Yes, a", "Not"\n\n## Label Definitions\n- **Yes, a**: \n- **Not**: \n' + end + "<Yes label or No label>\n"
    )
    assert set(got) == {("Mood", None), ("Mood", "High"), ("Mood", "Low"), ("Is it", None)}


def test_step_prompts(spark):
    dims, labels = tables(spark, gated_book())
    rows = [("b", "both", "Topic", 0), ("b", "both", "Level", 1), ("b", "one", "Level", 0)]
    steps = spark.createDataFrame(rows, "codebook_id string, step string, dim string, pos int")
    got = {r["step"]: r["prompt"] for r in step_prompts(dims, labels, steps).collect()}
    text = got["both"]
    assert text.startswith('You are an expert annotator performing step "both". Classify the input text on the following 2 dimensions.')
    assert text.endswith("Topic: <label>\nLevel: <label>")
    assert '### Level\nLabels: "High", "Low"\n  - **High**: ' in text
    assert got["one"] == next(r["prompt"] for r in prompt_table(dims, labels).collect() if r["dim"] == "Level")


def test_library_asks_the_prompt_of_the_gate(spark):
    """Prompts and inputs of two codebooks in one job, through a user function."""
    other = {"dimensions": [{"name": "Only", "labels": [{"name": "A"}, {"name": "B"}]}]}
    books = [("b", json.dumps(gated_book())), ("o", json.dumps(other))]
    plan = L.labeling_plan(*codebook_tables(spark.createDataFrame(books, "codebook_id string, body string")))

    def fn(batch):
        said = []
        for p, t in zip(batch["prompt"], batch["input"]):
            if '"Level"' in p.split("\n")[0]:
                said.append("Answer: High" if "one" in t else "Answer: Low")
            elif "Only" in p:
                said.append(None if "two" in t else "Answer: B")
            else:
                said.append(f"Answer: {'Work' if 'Work' in p else 'Life'}|{'High' in p}|{t[-30:]}")
        return batch.assign(response=said, tokens=3)[["response", "tokens"]]

    rows = [(1, "b", "one", ""), (2, "b", "two", ""), (3, "o", "three", ""), (4, "o", "two", ""), (5, "none", "x", ""), (6, None, "x", "")]
    items = spark.createDataFrame(rows, "item_id bigint, codebook_id string, content string, context string")
    out = L.annotate_library(items, plan, P.pandas_labeler(fn)).collect()
    got = {(r["item_id"], r["dimension"]): r["label"] for r in out}
    said = {(r["item_id"], r["dimension"]): r["reasoning"] for r in out}
    assert got[1, "Level"] == "High" and got[2, "Level"] == "Low" and got[3, "Only"] == "B"
    assert got[1, "Topic"] == "Work" and said[1, "Topic"].startswith("Answer: Work|True|")
    assert got[2, "Topic"] == "Work" and said[2, "Topic"].startswith("Answer: Work|False|")
    assert said[2, "Category"].endswith("determined: Topic = Work."[-30:])
    assert {r["item_id"]: (r["ok"], r["tokens"]) for r in out} == {1: (True, 3), 2: (True, 3), 3: (True, 3), 4: (False, 0)}


def test_annotate_gates_and_failures(spark):
    steps = L.codebook_steps(spark, gated_book())
    steps[0].gate = "Level"
    items = spark.createDataFrame([(1, "a", ""), (2, "b", ""), (3, "c", "")], "item_id bigint, content string, context string")
    said = [(1, 0, "Answer: high", 4), (1, 1, "work", 4), (1, 2, "Answer: Life", 3), (2, 0, "Answer: none", 5), (3, 0, "Answer: Low", 5), (3, 1, None, 9)]
    rec = spark.createDataFrame(said, "item_id bigint, step_order int, response string, tokens bigint")
    out = P.annotate(items, steps, P.recorded(rec))
    rows = {(r["item_id"], r["dimension"]): (r["label"], r["tokens"]) for r in P.result_rows(out, steps).collect()}
    assert rows == {
        (1, "Level"): ("High", 3), (1, "Topic"): ("Work", 3), (1, "Category"): ("Life", 3),
        (2, "Level"): ("none", 1), (2, "Topic"): ("", 1), (2, "Category"): ("", 1),
    }
    assert {r["item_id"]: r["ok"] for r in out.select("item_id", "ok").collect()} == {1: True, 2: True, 3: False}


def test_user_function_isolates_failures(spark):
    def fn(batch):
        if (batch["input"].str.contains("bad")).any():
            raise ValueError("bad row")
        return batch.assign(response="Answer: A", tokens=2)[["response", "tokens"]]

    items = spark.createDataFrame([(i, "bad" if i == 3 else f"t{i}", "") for i in range(6)], "item_id bigint, content string, context string").coalesce(1)
    one = [P.Step(name="D", dims=["D"], labels={"D": ["A", "B"]})]
    out = P.annotate(items, one, P.pandas_labeler(fn, parallelism=1))
    got = {r["item_id"]: (r["ok"], r["tokens"], r["answers"][0]["label"]) for r in out.collect()}
    assert got == {i: ((False, 0, "") if i == 3 else (True, 2, "A")) for i in range(6)}


def test_suggestions(spark):
    names = ["Topic Thematic Categories", "Topics", "Intimacy Of Self-Disclosure", "No, it's not a confession"]
    n = spark.createDataFrame([(x, i) for i, x in enumerate(names)], "name string, sort_order int")
    u = spark.createDataFrame([("Topic",), ("Initmacy of self-disclosure",), ("No",), ("zzz",), ("No",)], "value string")
    got = {r["value"]: r["suggestion"] for r in C.suggest_mapping(u, n).collect()}
    assert got == {"Topic": "Topics", "Initmacy of self-disclosure": "Intimacy Of Self-Disclosure", "No": "No, it's not a confession", "zzz": ""}


def test_schema_with_categories(spark):
    dims = spark.createDataFrame(
        [(1, "Real", "binary", "", 0), (1, "Leaf", "multi_label", "Group", 1), (1, "Other", "single_label", "Group", 2),
         (1, "Third", "single_label", "Real", 3), (1, "Empty", "single_label", "", 4)],
        "codebook_id bigint, dim string, dim_type string, category_dimension string, sort_order bigint",
    )
    labels = spark.createDataFrame(
        [(1, "Real", "Yes", [], 0), (1, "Leaf", "a", ["G", "B"], 0), (1, "Leaf", "b", ["G", "A"], 1), (1, "Leaf", "c", ["X"], 2),
         (1, "Other", "d", ["G", "C"], 0), (1, "Third", "e", ["G", "D"], 0)],
        "codebook_id bigint, dim string, label string, path array<string>, sort_order bigint",
    )
    d, x = C.gold_schema(dims, labels)
    kinds = {r["dim"]: (r["dim_type"], r["dim_order"]) for r in d.collect()}
    assert kinds == {"Real": ("binary", 0.0), "Leaf": ("multi_label", 1.0), "Group": ("multi_label", 1.5),
                     "Other": ("single_label", 2.0), "Third": ("single_label", 3.0), "Empty": ("single_label", 4.0)}
    assert [r["label"] for r in x.filter("dim = 'Group'").orderBy("sort_order").collect()] == ["B", "A"]
    assert [r["label"] for r in x.filter("dim = 'Real'").collect()] == ["Yes"]
    row = C.schema_rows(d, x).collect()[0]
    assert row["dim_keys"]["group"] == "Group" and row["dims"]["Empty"]["labels"] == {}
    assert row["dims"]["Real"]["single"] and not row["dims"]["Group"]["single"]


def test_suggested_names_against_all_pairs(spark):
    """Also with words repeated in a name, empty names and values, and one word in most names."""
    rnd = random.Random(3)
    common, rare = ["the", "of", "tone"], ["a", "ab", "style", "tones", "x1", "x2", "x3", "x4", "x5", "x6", "x7"]

    def phrase():
        words = rnd.choices(common, k=rnd.randrange(3)) + rnd.choices(rare, k=rnd.choice([0, 1, 1, 2, 5]))
        rnd.shuffle(words)
        return rnd.choice([" ", "-", "_"]).join(words).title()

    names = [(rnd.randrange(2), n, rnd.randrange(40)) for n in {phrase() for _ in range(120)}]
    names += [(2, f"the {i}", i) for i in range(60)] + [(3, "!", 1), (3, "", 1), (3, "the x1", 0)]
    values = [(s, v) for s in range(4) for v in {phrase() for _ in range(60)} | {"", "?", "the", "the y z"}]

    def key(s):
        return re.sub("[^a-z0-9]+", " ", s.lower()).strip()

    def tokens(k):
        return [t[:-1] if len(t) > 2 and t.endswith("s") else t for t in k.split()]

    def score(a, b):
        a, b = key(a), key(b)
        u, n = tokens(a), tokens(b)
        return sum(t in u for t in n) / max(len(set(u) | set(n)), 1) + 0.5 * (a.startswith(b) or b.startswith(a))

    u = spark.createDataFrame(values, "scope int, value string")
    n = spark.createDataFrame(names, "scope int, name string, sort_order int")
    for limit in (0.3, 0.6):
        got = {(r["scope"], r["value"]): (r["suggestion"], r["score"]) for r in C.suggest_mapping(u, n, ["scope"], limit).collect()}
        assert len(got) == len(values)
        for scope, value in values:
            best = max((score(value, name), -order, name) for s, name, order in names if s == scope)
            want = (best[2], best[0]) if best[0] >= limit else ("", None)
            assert got[scope, value] == want, (scope, value)
