"""Worked examples, leaks, streams against brute force."""

import random
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from labelworks.operators import leaks as K
from labelworks.operators import ledger as G
from labelworks.operators.leaks import audit_coverage, leak_audit, leaked_examples
from labelworks.streaming import jobs as T


def test_worked_examples(spark):
    rng = random.Random(4)
    rules = [(b, r, f"r{r}", rng.sample(["A", "B", "C"], rng.randint(0, 2))) for b in range(3) for r in range(12)]
    ex = [(b, i, b * 1000 + i, "x" * rng.randint(1, 9), rng.choice("ABC"), rng.choice("ABC")) for b in range(3) for i in range(60)]
    rdf = spark.createDataFrame(rules, "book int, pos int, rule_id string, target_labels array<string>")
    edf = spark.createDataFrame(ex, "book int, ord int, item_id bigint, sentence string, gold string, first_pred string")
    for per_rule, total in ((1, 8), (2, 5)):
        got = {(r["book"], r["rule_id"], r["item_id"]) for r in G.worked_examples(rdf, edf, ["book"], per_rule, total).collect()}
        want = set()
        for b in range(3):
            used = []
            for _, _, rid, targets in (r for r in rules if r[0] == b):
                cand = [e for e in ex if e[0] == b and e[4] in targets and e[2] not in used]
                cand.sort(key=lambda e: (e[5] == e[4], len(e[3]), e[1]))
                for e in cand[: max(0, min(per_rule, total - len(used)))]:
                    used.append(e[2])
                    want.add((b, rid, e[2]))
        assert got == want


def test_leaks_with_words_and_characters(spark):
    prompts = [
        (1, 'He said "The Quick brown fox jumps" and left; supercalifragilisticexpialidocious!'),
        (2, "prefixthe quick brown fox jumpsuffix"),
        (3, "nothing to see here at all, really nothing"),
        (4, "ÜBER die große Straße gehen wir heute"),
    ]
    examples = [
        (1, "val", "the quick brown fox jumps"), (2, "test", " The quick brown fox jumps "), (3, "val", "califragilisticexpiali"),
        (4, "val", "short"), (5, "test", "über die große Straße"), (6, "train", "quick brown fox jumps over"), (7, "test", "---------- ----------"),
    ]
    p = spark.createDataFrame(prompts, "prompt_id int, prompt string")
    e = spark.createDataFrame(examples, "source_id int, split string, sentence string")
    want = {(i, s) for i, t in prompts for s, _, x in examples if len(x.strip()) >= 20 and x.strip().lower() in t.lower()}
    assert {(r["prompt_id"], r["source_id"]) for r in leaked_examples(p, e).collect()} == want
    assert {(1, 1), (1, 2), (1, 3), (2, 1), (4, 5)} <= want
    audit = {(r["prompt_id"], r["split"]): (r["leaks"], len(r["samples"])) for r in leak_audit(p, e).collect()}
    assert audit[1, "val"] == (2, 2) and audit[1, "test"] == (1, 1)
    assert {r["split"]: r["skipped_short"] for r in audit_coverage(e).collect()} == {"val": 1, "test": 0, "train": 0}


@pytest.mark.parametrize("words", [3, 4, 5, 6, 9, 12, 30])
def test_leaks_of_any_number_of_words(spark, words):
    """Sentences of ``words`` words at every place of prompts, against a plain search."""
    rng = random.Random(words)
    text = [" ".join(rng.choice(["ab", "cde", "fghij", "kl mn", "Øre"]) for _ in range(60)) for _ in range(12)]
    cuts = []
    for i in range(40):
        parts = text[rng.randrange(12)].split(" ")
        at = rng.randrange(len(parts) - words)
        cuts.append((i, "s", " ".join(parts[at : at + words]) + ("x" if i % 5 == 0 else "")))
    p = spark.createDataFrame(list(enumerate(text)), "prompt_id int, prompt string")
    e = spark.createDataFrame(cuts, "source_id int, split string, sentence string")
    want = {(i, k) for i, t in enumerate(text) for k, _, c in cuts if len(c) >= 8 and c.lower() in t.lower()}
    assert {(r["prompt_id"], r["source_id"]) for r in leaked_examples(p, e, min_len=8).collect()} == want
    assert want


def test_leaks_of_no_sentence(spark):
    p = spark.createDataFrame([(1, "a text")], "prompt_id int, prompt string")
    e = spark.createDataFrame([(1, "s", "short"), (2, "s", None)], "source_id int, split string, sentence string")
    assert leaked_examples(p, e).count() == leak_audit(p, e).count() == 0


def test_leaks_against_brute_force(spark):
    rng = random.Random(5)
    words = ["der", "Straße", "ÜBER", "of", "a", "日本語", "x1", "naïve"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", "-", "", ", "]) for _ in range(rng.randint(0, 90))) for _ in range(60)]
    ex = []
    for i in range(240):
        at = rng.choice(texts)
        start = rng.randint(0, max(0, len(at) - 1))
        ex.append((i, "s", at[start : start + rng.choice([1, 3, 19, 20, 21, 32, 63, 64, 70, 200])].swapcase()))
    p = spark.createDataFrame([*enumerate(texts), (99, None)], "prompt_id int, prompt string")
    e = spark.createDataFrame([*ex, (999, "s", None)], "source_id int, split string, sentence string")
    for min_len in (1, 20):
        rows = e.select("source_id", F.trim(F.lower("sentence")).alias("s")).filter(F.length("s") >= min_len)
        low = p.select("prompt_id", F.lower("prompt").alias("p"))
        want = {tuple(r) for r in low.crossJoin(rows).filter(F.contains("p", "s")).select("prompt_id", "source_id").collect()}
        got = leaked_examples(p, e, min_len).select("prompt_id", "source_id").collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want) > 20


def test_only_runs_of_sentences_leave_the_prompts(spark, monkeypatch):
    """Sentences of few words made every character of every prompt a row."""
    monkeypatch.setattr(K, "PIECE", 32)
    rng = random.Random(6)
    noise = [bytes(rng.choices(range(97, 123), k=n)) for n in (0, 5, 16, 500, 3000)]
    runs = {16: b"abcdefghijklmnop", 64: b"0123456789" * 6 + b"0123"}
    bits = np.zeros(K.MARK_BITS // 8, np.uint8)
    want = []
    for size, run in runs.items():
        (h,) = next(K._run_hashes(run, [size]))
        want.append(int(h.view(np.int64)))
        bits[int(h) % K.MARK_BITS >> 3] |= 1 << (int(h) & 7)
    looked_up = K._looked_up([16, 64], SimpleNamespace(value=bits.tobytes())).func
    texts = [*noise, noise[3] + runs[16] + noise[4] + runs[16], noise[1] + runs[64], runs[16] + runs[64], runs[16][:9], runs[16][9:]]
    (got,) = looked_up(iter([pd.Series(texts)]))
    assert [sorted(x) for x in got] == [[], [], [], [], [], [want[0]], [want[1]], sorted(want), [], []]


def test_leak_samples_are_whole(spark):
    text = " ".join(f"word{i}" for i in range(60))
    p = spark.createDataFrame([(1, f"x {text} y")], "prompt_id bigint, prompt string")
    e = spark.createDataFrame([(1, "test", text)], "source_id bigint, split string, sentence string")
    assert leaked_examples(p, e).first()["sample"] == text and leak_audit(p, e).first()["samples"] == [text]
    assert leak_audit(p, e, sample_characters=9).first()["samples"] == [text[:9]]


def test_leak_samples_are_the_first(spark):
    p = spark.createDataFrame([(1, "a sentence that is long enough")], "prompt_id int, prompt string")
    e = spark.range(50).select(F.col("id").alias("source_id"), F.lit("val").alias("split"), F.lit("A sentence that is long enough").alias("sentence"))
    row = leak_audit(p, e).collect()[0]
    assert row["leaks"] == 50 and len(row["samples"]) == 5


def test_null_keys_are_keys(spark):
    df = spark.createDataFrame([(None, 1, "a"), (None, 2, "b"), (5, 1, "c")], "k bigint, v bigint, x string")
    assert sorted(r["x"] for r in G.latest_per(df, ["k"], "v").collect()) == ["b", "c"]


def test_streams_over_several_files(spark, tmp_path):
    rows = [(i % 3, i // 2, i % 7 != 0, i) for i in range(40)]
    df = spark.createDataFrame(rows, "job_id bigint, item_id bigint, ok boolean, tokens bigint")
    df = df.withColumn("ok", F.col("item_id") % 5 != 0).withColumn("tokens", F.col("item_id"))
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = T.run_to_table(T.job_progress(stream), "progress", "complete")
    want = G.job_counters(df.dropDuplicates(["job_id", "item_id"])).drop("status")
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_corrections_over_several_batches(spark, tmp_path):
    preds = spark.createDataFrame([(1, 1, 1, 0, "Tone (x)", "old"), (2, 1, 2, 0, "Tone (x)", "old")], "pred_id bigint, job_id bigint, item_id bigint, step_order int, dimension string, label string")
    schema = "job_id bigint, item_id bigint, dimension string, label string, edit_id bigint"
    for i, label in enumerate(["first", "second"]):
        spark.createDataFrame([(1, 1, "tone", label, i)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "edits"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "edits"))
    got = {r["pred_id"]: r["label"] for r in T.run_corrections(stream, preds).collect()}
    assert got == {1: "second", 2: "old"}


def test_corrections_of_tables_in_folders(spark, tmp_path):
    """A table is one file or a folder of files; beside it lie tables that are not read."""
    preds = spark.createDataFrame([(1, 1, 1, 0, "Tone", "old")], "pred_id bigint, job_id bigint, item_id bigint, step_order int, dimension string, label string")
    schema = "job_id bigint, item_id bigint, dimension string, label string, edit_id bigint"
    edits = spark.createDataFrame([(1, 1, "tone", "first", 1), (1, 1, "tone", "second", 2)], schema)
    edits.repartition(2).write.parquet(f"{tmp_path}/two/edits.parquet")
    edits.coalesce(1).write.parquet(f"{tmp_path}/part")
    (tmp_path / "one").mkdir()
    next((tmp_path / "part").glob("part-*.parquet")).rename(tmp_path / "one" / "edits.parquet")
    for folder in ("one", "two"):
        spark.range(3).write.parquet(f"{tmp_path}/{folder}/other.parquet")
        stream = T.table_stream(spark, f"{tmp_path}/{folder}", "edits")
        assert [r["label"] for r in T.run_corrections(stream, preds).collect()] == ["second"], folder


def test_streams_without_data(spark, tmp_path):
    preds = spark.createDataFrame([(1, 1, 1, 0, "Tone", "old")], "pred_id bigint, job_id bigint, item_id bigint, step_order int, dimension string, label string")
    edits = spark.readStream.schema("job_id bigint, item_id bigint, dimension string, label string, edit_id bigint").parquet(str(tmp_path))
    assert [r["label"] for r in T.run_corrections(edits, preds).collect()] == ["old"]


def test_progress_of_tables_in_folders(spark, tmp_path):
    df = spark.createDataFrame([(1, 1, True, 5), (1, 2, False, 7), (2, 3, True, 1)], "job_id bigint, item_id bigint, ok boolean, tokens bigint")
    df.repartition(2).write.parquet(f"{tmp_path}/results.parquet")
    stream = T.table_stream(spark, str(tmp_path), "results")
    got = T.run_to_table(T.job_progress(stream), "progress", "complete")
    assert sorted(map(tuple, got.select("job_id", "completed", "failed", "tokens").collect())) == [(1, 1, 1, 5), (2, 1, 0, 1)]


def test_progress_without_results(spark, tmp_path):
    stream = spark.readStream.schema("job_id bigint, item_id bigint, ok boolean, tokens bigint").parquet(str(tmp_path))
    assert T.run_to_table(T.job_progress(stream), "progress", "complete").count() == 0
