"""Files in, files out."""

import csv
import json
import random
import re

from pyspark.sql import functions as F

from labelworks.sources import exports as X
from labelworks.sources import records as R
from labelworks.sources import sheets as H


def test_items_json(spark, tmp_path):
    body = {"n": 2, "items": [{"sentence": "first one", "context": "c", "user_id": "u1", "gold_labels": {"T": "a"}}, "plain",
                              {"id": "7", "note": "a long enough note", "labels": {"T": ["a", "b"]}, "gold_labels": {"T": "no"}}]}
    (tmp_path / "a.json").write_text("﻿" + json.dumps(body), encoding="utf-8")
    (tmp_path / "b.json").write_text(json.dumps({"text": "alone", "labels": {}}))
    (tmp_path / "c.json").write_text(json.dumps(["x", "y"]))
    rows = H.read_items_json(spark, str(tmp_path)).withColumn("file", F.regexp_extract("file", "[a-z][.]json", 0)).collect()
    got = {(r["file"][0], r["idx"]): r for r in rows}
    assert len(got) == 6
    a = got["a", 0]
    assert (a["content"], a["context"], a["metadata"], a["gold"]) == ("first one", "c", {"user_id": "u1"}, {"T": "a"})
    assert got["a", 1]["content"] == "plain" and got["a", 1]["gold"] == {}
    assert got["a", 2]["content"] == "a long enough note" and got["a", 2]["gold"] == {"T": '["a","b"]'}
    assert got["b", 0]["content"] == "alone"
    assert [got["c", i]["content"] for i in (0, 1)] == ["x", "y"]


def csv_items(spark, tmp_path, text):
    path = tmp_path / "s.csv"
    path.write_text(text, encoding="utf-8")
    df = H.read_coder_csv(spark, str(path))
    return df, H.collapse_coder_rows(df, ["file"], "ord").orderBy("idx").collect()


def test_two_row_header(spark, tmp_path):
    df, items = csv_items(
        spark, tmp_path,
        '﻿#,User ,FL,,,,,\n,,Logs,Coding theme,Level,Topic,Time stamp,Relevant quotes \n'
        '1,R_1,Donated,Listening strategy,Question-asking,Casual talk,8/5/2025,"How did\nyou do it?"\n,,,,,,,\n'
        '1,R_1,Donated,Support type,Emotional support,Other talk,8/5/2025,"""How did\nyou do it?"""\n',
    )
    assert df.columns[2:5] == ["col0", "col1", "Logs"]
    assert len(items) == 1
    assert items[0]["content"] == "How did\nyou do it?"
    assert items[0]["gold"] == {"Listening strategy": "Question-asking", "Support type": "Emotional support", "Topic": "Casual talk"}
    assert items[0]["metadata"]["Logs"] == "Donated" and items[0]["metadata"]["col1"] == "R_1"


def test_repeated_theme_and_column_order(spark, tmp_path):
    _, items = csv_items(
        spark, tmp_path,
        "Label,Notes,Response,Dimension\nQuestion-asking,seen,Tell me more.,Listening\nAdvice,seen,Tell me more.,Listening\n"
        "Question-asking,seen,Tell me more.,Listening\nCompanion,seen,Tell me more.,AI role\nX,,Bye,\n",
    )
    assert [i["content"] for i in items] == ["Tell me more.", "Bye"]
    assert items[0]["gold"] == {"Listening": '["Question-asking","Advice"]', "AI role": "Companion"}
    assert items[1]["gold"] == {}


def test_header_in_the_first_rows(spark, tmp_path):
    path = tmp_path / "deep.csv"
    path.write_text("Export,,\nof,today,\nCoding theme,Level,Relevant Quotes \nT,L,q1\nT,M,q1\n")
    df = H.read_coder_csv(spark, str(path), header_cell="relevant quotes")
    assert df.columns[2:] == ["Coding theme", "Level", "Relevant Quotes"]
    assert [r["gold"] for r in H.collapse_coder_rows(df, ["file"], "ord").collect()] == [{"T": '["L","M"]'}]


def test_each_file_has_its_own_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Theme,Level,Quote\nT,L,q1\nTheme,Level,Quote\n")
    (tmp_path / "b.csv").write_text("#,User,x\nQuote,Theme,Extra\nq2,U,e\n")
    (tmp_path / "c.csv").write_text(",".join(f"h{i}" for i in range(300)) + "\n" + ",".join(str(i) for i in range(300)) + "\n")
    df = H.read_coder_csv(spark, str(tmp_path))
    rows = [r.asDict() for r in df.orderBy("file", "ord").collect()]
    assert df.columns[2:6] == ["Theme", "Level", "Quote", "Extra"]
    got = [(r["file"][-5], r["Theme"], r["Level"], r["Quote"], r["Extra"], r["h299"]) for r in rows]
    assert got == [("a", "T", "L", "q1", "", ""), ("a", "Theme", "Level", "Quote", "", ""), ("b", "U", "", "q2", "e", ""), ("c", "", "", "", "", "299")]


def csv_rows(spark, folder):
    got = {}
    for r in sorted(R.read_csv_rows(spark, str(folder)).collect(), key=lambda r: (r["file"], r["ord"])):
        got.setdefault(r["file"].rsplit("/", 1)[-1], []).append(r["cells"])
    return got


def test_rows_of_byte_ranges(spark, tmp_path, monkeypatch):
    rnd = random.Random(5)
    parts = ['"', '"', ",", "\n", "a", "bc", "\r\n", '""', " ", '",', '\n"', "é"]
    texts = ["".join(rnd.choices(parts + ["\r"] * (i % 3 == 0), k=n)) for i, n in enumerate([0, 4, 60, 200, 250, 300])]
    texts += ["\ufeff\"a\nb\",c\n", 'x,"' + "long\n" * 60 + 'y"\nz,\n', "\n\n\n", "a\rb,c\r", 'he said "hi, you\n5" x 7",b\n']
    want = {}
    for i, text in enumerate(texts):
        (tmp_path / f"f{i:02}.csv").write_text(text, encoding="utf-8", newline="")
        body = text.removeprefix("\ufeff").removesuffix("\n")
        rows = [r for r in csv.reader(re.split("(?<=\r)(?!\n)|(?<=\n)", body)) if r]
        want |= {f"f{i:02}.csv": rows} if rows else {}
    size, cost = "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"
    old = spark.conf.get(size), spark.conf.get(cost)
    assert csv_rows(spark, tmp_path) == want
    try:  # ranges far shorter than rows
        spark.conf.set(size, "70")
        spark.conf.set(cost, "30")
        assert csv_rows(spark, tmp_path) == want
        monkeypatch.setattr(R, "BROADCAST_RANGES", 0)
        assert csv_rows(spark, tmp_path) == want
    finally:
        spark.conf.set(size, old[0])
        spark.conf.set(cost, old[1])


def test_lines_put_together():
    ends = {"identity": (False, True), "turn": (True, False), "out": (False, False), "in": (True, True)}
    rnd = random.Random(1)
    for _ in range(200):
        steps = [ends[k] for k in rnd.choices(list(ends), k=rnd.randrange(6))]
        want = []
        for state in (False, True):
            for step in steps:
                state = step[state]
            want.append(state)
        outs, ins = (R.np.array([s[k] for s in steps], dtype=bool) for k in (0, 1))
        assert R._composed(outs, ins) == tuple(want)


def test_items_csv_takes_each_file_by_its_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text('sentence,gold_labels,labels,context\n" hello","{""Theme"": ""Level A""}",,before\n,,,\nbye,no object,"{""T"": [""a"", ""b""]}",\nend,,"{""T"": ""x""}",\n')
    (tmp_path / "b.csv").write_text("#,User,x\n,Dimension,Label,Response,n,n\n1,T,L,q1,u,v\n2,T,M,\"\"\"q1\"\"\",w,w\n3,,,q2,,\n")
    (tmp_path / "c.csv").write_text("id,note,id\n1,short,2\n3,a text of many letters,4\n")
    (tmp_path / "d.csv").write_text("sentence,Theme\n")
    (tmp_path / "e.csv").write_text("")
    rows = H.read_items_csv(spark, str(tmp_path)).collect()
    got = {(r["file"][-5], r["idx"]): (r["content"], r["context"], r["metadata"], r["gold"]) for r in rows}
    assert len(got) == len(rows) == 7
    assert got["a", 0] == (" hello", "before", {"gold_labels": '{"Theme": "Level A"}', "labels": ""}, {"Theme": "Level A"})
    assert got["a", 1][0] == "bye" and got["a", 1][3] == {}
    assert got["a", 2][3] == {"T": "x"}
    assert got["b", 0] == ("q1", "", {"col0": "1", "n": "u", "n_1": "v"}, {"T": '["L","M"]'})
    assert got["b", 1][0] == "q2" and got["b", 1][3] == {}
    assert got["c", 0] == ("1", "", {"note": "short", "id_1": "2"}, {})
    assert got["c", 1] == ("a text of many letters", "", {"id": "3", "id_1": "4"}, {})
    only = H.read_items_csv(spark, [str(tmp_path / "d.csv"), str(tmp_path / "e.csv")])
    assert only.count() == 0 and only.columns == ["file", "idx", "content", "context", "metadata", "gold"]


def test_content_field_is_text(spark):
    body = json.dumps([{"id": 123456789012, "note": "long enough to be text"}, {"id": 5}])
    df = spark.createDataFrame([("f", body)], "file string, value string")
    assert [r["content"] for r in H.parse_items(df).orderBy("idx").collect()] == ["long enough to be text", "5"]


def test_headers():
    assert H.unique_headers(["a", "", "a", None, "a"]) == ["a", "col1", "a_1", "col3", "a_2"]
    assert H.looks_like_coder_sheet(["Coding theme", "Quote"]) and not H.looks_like_coder_sheet(["a", "b"])


def test_content_column(spark):
    df = spark.createDataFrame([("x", "a much longer value"), ("y", "z")], "kind string, body string")
    assert H.pick_content_column(df) == "body"
    assert H.pick_content_column(df.withColumnRenamed("kind", "User_Message")) == "User_Message"


def test_fill_over_chunks(spark):
    rows = [(1, i, "p" if i == 0 else None, "c" if i == 5 else ("d" if i == 9 else "")) for i in range(12)] + [(1, 12, "q", None), (1, 13, "", "e")]
    df = spark.createDataFrame(rows, "sheet int, ord bigint, a string, b string").filter("ord % 4 <> 3 OR a IS NOT NULL")
    got = {r["ord"]: (r["a"], r["b"]) for r in H.fill_down_nested(df, ["a", "b"], ["sheet"], "ord", chunk=3).collect()}
    assert got == {0: ("p", None), 5: ("p", "c"), 9: ("p", "d"), 12: ("q", None), 13: ("q", "e")}
    got = {r["ord"]: (r["a"], r["b"]) for r in H.fill_down(df, ["a", "b"], ["sheet"], "ord", chunk=3).collect()}
    assert got[12] == ("q", "d")


def test_codebook_and_snapshot(spark, tmp_path):
    (tmp_path / "book.json").write_text(json.dumps({"name": "B", "dimensions": [
        {"name": "D", "labels": [{"name": "x", "path": ["G", " "]}, {"name": "y", "examples": ["e"]}]}, {"name": "E", "type": "binary", "labels": []}]}))
    dims, labels = H.load_codebooks(spark, str(tmp_path / "book.json"))
    assert [(r["dim"], r["dim_type"]) for r in dims.orderBy("sort_order").collect()] == [("D", "single_label"), ("E", "binary")]
    assert [(r["label"], r["path"], r["examples"]) for r in labels.orderBy("sort_order").collect()] == [("x", ["G"], []), ("y", [], ["e"])]

    items = spark.createDataFrame([(1, 0, "t", "", {}, {"D": "x"})], "item_id bigint, idx bigint, content string, context string, metadata map<string,string>, gold map<string,string>")
    preds = spark.createDataFrame([(1, 9, 1, 0, "D", "y"), (2, 9, 1, 0, "D", "x")], "pred_id bigint, job_id bigint, item_id bigint, step_order int, dimension string, label string")
    counters = spark.createDataFrame([(9, 1)], "job_id bigint, completed bigint")
    out = str(tmp_path / "out")
    for _ in range(2):
        X.snapshot_run(preds, items, counters, out)
    assert spark.read.parquet(f"{out}/runs").count() == 2
    assert spark.read.json(f"{out}/log").count() == 2
    wide = X.export_wide(preds, items).collect()[0]
    assert (wide["content"], wide["D"]) == ("t", "x")
    X.write_export(X.export_flat(items, ["D"]), f"{out}/csv")
    assert spark.read.option("header", True).csv(f"{out}/csv").first()["D"] == "x"
