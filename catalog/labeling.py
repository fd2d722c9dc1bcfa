"""Labeling all documents with recorded answers, as batches and as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelworks.plans import labeling as P
from labelworks.plans import library as L
from labelworks.streaming import jobs as T

from . import sql as S
from .registry import query
from .relations import edits, h, items, pick, predictions, table, usage

BOOK = {
    "name": "Review of documents",
    "dimensions": [
        {
            "name": "Reason",
            "gated_by": "Quality",
            "category_dimension": "Reason group",
            "labels": [
                {"name": "clear", "path": ["High", "Style"], "definition": "Easy to read."},
                {"name": "deep", "path": ["High", "Content"]},
                {"name": "short", "path": ["Low", "Style"]},
                {"name": "wrong", "path": ["Low", "Content"]},
            ],
        },
        {"name": "Quality", "labels": [{"name": "High"}, {"name": "Low"}, {"name": "No label"}]},
        {"name": "Toxic", "type": "binary", "labels": [{"name": "Yes"}, {"name": "No"}], "context_dims": ["Reason"]},
        {"name": "Strength", "labels": [{"name": "mild"}, {"name": "strong"}], "context_dims": ["Toxic"]},
    ],
}


_STEPS = []


def steps(spark):
    """The steps of BOOK: plain data, planned once a session's driver."""
    if not _STEPS:
        _STEPS.extend(L.codebook_steps(spark, BOOK))
        next(s for s in _STEPS if s.name == "Toxic").gate = "Toxic"
    return _STEPS


def recorded_answers(spark, d):
    """Answers per document and step (Quality, Reason, Toxic, Strength); some are missing."""
    n = [h("doc_id", f"'s{i}'") for i in range(4)]
    texts = [
        pick(n[0] % 5, "Answer: High", "Good.\nAnswer: low.", "Answer: N/A", "hmm", "I say High."),
        pick(n[1] % 4, "Answer: clear", "Answer: SHORT", "it is deep", "answer: Wrong"),
        pick(n[2] % 2, "Yes, clearly", "no"),
        pick(n[3] % 2, "Answer: mild", "Answer: strong"),
    ]
    fails = h("doc_id", "'f'") % 30 == 0
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("step_order"),
                (F.when(fails, F.lit(None)).otherwise(t) if i == 1 else t).alias("response"),
                F.lit(10 + i).cast("bigint").alias("tokens"),
            )
            for i, t in enumerate(texts)
        ]
    )
    return table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), F.inline(rows))


def _work(spark, d):
    return items(spark, d).select("item_id", "content", "context")


def annotated(spark, d):
    return P.annotate(_work(spark, d), steps(spark), P.recorded(recorded_answers(spark, d)))


_RUN = f"""
n AS (SELECT doc_id AS item_id, {S.h("doc_id||'|s0'")} % 5 AS a, {S.h("doc_id||'|s1'")} % 4 AS b, {S.h("doc_id||'|s2'")} % 2 AS c, {S.h("doc_id||'|s3'")} % 2 AS e, {S.h("doc_id||'|f'")} % 30 = 0 AS failed FROM documents),
l AS (SELECT *, CASE WHEN a IN (0, 4) THEN 'High' WHEN a = 1 THEN 'Low' WHEN a = 2 THEN 'No label' ELSE 'hmm' END AS quality,
  CASE WHEN c = 0 THEN 'Yes' ELSE 'No' END AS toxic FROM n),
m AS (SELECT *, CASE b WHEN 0 THEN CASE WHEN quality = 'Low' THEN 'clear' ELSE 'clear' END
   WHEN 1 THEN CASE WHEN quality = 'High' THEN 'SHORT' ELSE 'short' END
   WHEN 2 THEN CASE WHEN quality = 'Low' THEN 'it is deep' ELSE 'deep' END
   ELSE CASE WHEN quality = 'High' THEN 'Wrong' ELSE 'wrong' END END AS reason,
   CASE WHEN toxic = 'No' THEN '' WHEN e = 0 THEN 'mild' ELSE 'strong' END AS strength FROM l),
run AS (SELECT *, CASE lower(reason) WHEN 'clear' THEN 'Style' WHEN 'deep' THEN 'Content' WHEN 'short' THEN 'Style' WHEN 'wrong' THEN 'Content' ELSE '' END AS reason_group,
   CASE WHEN failed THEN 10 WHEN toxic = 'No' THEN 33 ELSE 46 END AS tokens FROM m)"""
_RESULTS = """
SELECT item_id, 0 AS step_order, 'Quality' AS dimension, quality AS label, tokens // 4 AS tokens FROM run WHERE NOT failed
UNION ALL SELECT item_id, 1, 'Reason', reason, tokens // 4 FROM run WHERE NOT failed
UNION ALL SELECT item_id, 1, 'Reason group', reason_group, tokens // 4 FROM run WHERE NOT failed
UNION ALL SELECT item_id, 2, 'Toxic', toxic, tokens // 4 FROM run WHERE NOT failed
UNION ALL SELECT item_id, 3, 'Strength', strength, tokens // 4 FROM run WHERE NOT failed"""


@query("annotate_results", f"WITH {_RUN} {_RESULTS}")
def annotate_results(spark, d):
    return P.result_rows(annotated(spark, d), steps(spark)).drop("reasoning")


@query("annotate_items", f"WITH {_RUN} SELECT item_id, tokens, NOT failed AS ok FROM run")
def _items(spark, d):
    return annotated(spark, d).select("item_id", "tokens", "ok")


@query(
    "hard_gate",
    S.with_("pred", "SELECT item_id, CASE WHEN label = '' OR upper(label) LIKE 'HIGH%' THEN 'kept' ELSE '' END AS later FROM pred WHERE step_order = 0"),
)
def _gate(spark, d):
    p = predictions(spark, d).filter("step_order = 0")
    answer = F.when((F.col("label") == "") | F.upper("label").startswith("HIGH"), "Yes").otherwise(
        pick(F.col("item_id") % 3, "No", "n/a", "NONE")
    )
    rows = p.select("item_id", answer.alias("gate"), F.lit("kept").alias("later"))
    return P.apply_gate(rows, "gate", ["later"]).select("item_id", "later")


@query(
    "recorded_answers",
    f"""
WITH {_RUN}, r AS (SELECT item_id, i.i AS step_order, 10 + i.i AS tokens,
  CASE i.i WHEN 0 THEN CASE a WHEN 0 THEN 'Answer: High' WHEN 1 THEN 'Good.' || chr(10) || 'Answer: low.' WHEN 2 THEN 'Answer: N/A' WHEN 3 THEN 'hmm' ELSE 'I say High.' END
   WHEN 1 THEN CASE WHEN failed THEN NULL WHEN b = 0 THEN 'Answer: clear' WHEN b = 1 THEN 'Answer: SHORT' WHEN b = 2 THEN 'it is deep' ELSE 'answer: Wrong' END
   WHEN 2 THEN CASE c WHEN 0 THEN 'Yes, clearly' ELSE 'no' END
   ELSE CASE e WHEN 0 THEN 'Answer: mild' ELSE 'Answer: strong' END END AS response FROM run CROSS JOIN range(4) i(i))
SELECT item_id, step_order, CASE WHEN item_id % 2 = 0 OR step_order <> 1 THEN response END AS response,
  CASE WHEN item_id % 2 = 0 OR step_order <> 1 THEN tokens END AS tokens FROM r""",
)
def _recorded(spark, d):
    """What the replaying labeler gives for four calls per item; odd items are not active in the second."""
    call = P.recorded(recorded_answers(spark, d))
    df = call.joined(_work(spark, d).select("item_id"))
    for i in range(4):
        active = F.lit(True) if i != 1 else F.col("item_id") % 2 == 0
        df = call(df, i, F.lit(""), F.lit(""), active).withColumnsRenamed({"_response": f"r{i}", "_tokens": f"t{i}"})
    said = [
        F.struct(F.lit(i).cast("bigint").alias("step_order"), F.col(f"r{i}").alias("response"), F.col(f"t{i}").alias("tokens"))
        for i in range(4)
    ]
    return df.select("item_id", F.inline(F.array(*said)))


# ---- a library of codebooks --------------------------------------------------------------------


def _library(spark, d):
    """One codebook per conversation, all labels named after it; dimensions stand in two different orders."""
    c = F.col("codebook_id").cast("string")
    books = table(spark, d, "conversations").select(F.col("conv_id").alias("codebook_id")).distinct()
    label = lambda *names: F.concat(*[F.lit(n) if n != "#" else c for n in names])
    none = F.array().cast("array<string>")
    rows = [
        ("Quality", "", none, "", [("High ", ()), ("Low ", ()), ("No label", None)]),
        ("Reason", "Quality", none, "Reason group", [
            ("clear ", ("High ", "Style")), ("deep ", ("High ", "Content")), ("short ", ("Low ", "Style")), ("wrong ", ("Low ", "Content"))]),
        ("Toxic", "", F.array(F.lit("Reason")), "", [("rude ", ()), ("kind ", ())]),
        ("Strength", "", F.array(F.lit("Toxic"), F.lit("Missing")), "", [("mild ", ()), ("strong ", ())]),
    ]
    place = {0: {"Reason": 0, "Quality": 1, "Toxic": 2, "Strength": 3}, 1: {"Strength": 0, "Toxic": 1, "Quality": 2, "Reason": 3}}
    odd = F.col("codebook_id") % 2 == 1
    dims = books.select(
        "codebook_id",
        F.inline(F.array(*[
            F.struct(
                F.lit(dim).alias("dim"), F.lit("single_label").alias("dim_type"), F.lit("").alias("instructions"),
                F.lit(gate).alias("gated_by"), F.lit("").alias("derived_from"), F.lit(cat).alias("category_dimension"),
                context.alias("context_dims"),
                F.when(odd, place[1][dim]).otherwise(place[0][dim]).cast("bigint").alias("sort_order"),
            ) for dim, gate, context, cat, _ in rows
        ])),
    )
    labels = books.select(
        "codebook_id",
        F.inline(F.array(*[
            F.struct(
                F.lit(dim).alias("dim"), (F.lit(name) if path is None else label(name, "#")).alias("label"),
                F.lit("").alias("definition"), none.alias("examples"),
                (F.array(label(path[0], "#"), F.lit(path[1])) if path else none).alias("path"),
                F.lit(i).cast("bigint").alias("sort_order"),
            ) for dim, _, _, _, names in rows for i, (name, path) in enumerate(names)
        ])),
    )
    return dims, labels


def _library_work(spark, d):
    books = table(spark, d, "conversations").agg((F.max("conv_id") + 1).alias("n"))
    docs = items(spark, d).select("item_id", "content", "context")
    return docs.join(F.broadcast(books)).select("item_id", (F.col("item_id") % F.col("n")).alias("codebook_id"), "content", "context")


def _library_answers(spark, d):
    n = [h("item_id", f"'l{i}'") for i in range(4)]
    c = F.col("codebook_id").cast("string")
    say = lambda before: F.concat(F.lit(before), c)
    texts = [
        pick(n[0] % 4, say("Answer: High "), say("Good.\nAnswer: low "), "Answer: N/A", "hmm"),
        pick(n[1] % 4, say("Answer: clear "), say("Answer: SHORT "), say("Answer: deep "), say("answer: Wrong ")),
        pick(n[2] % 2, say("Answer: rude "), say("Answer: kind ")),
        pick(n[3] % 2, say("Answer: mild "), say("Answer: strong ")),
    ]
    fails = h("item_id", "'lf'") % 30 == 0
    rows = F.array(*[
        F.struct(F.lit(i).alias("step_order"), (F.when(~fails, t) if i == 1 else t).alias("response"), F.lit(10 + i).cast("bigint").alias("tokens"))
        for i, t in enumerate(texts)
    ])
    return _library_work(spark, d).select("item_id", F.inline(rows))


@query(
    "annotate_library",
    f"""
WITH n AS (SELECT doc_id AS item_id, doc_id % (SELECT max(conv_id) + 1 FROM conversations) AS codebook_id,
  {S.h("doc_id||'|l0'")} % 4 AS a, {S.h("doc_id||'|l1'")} % 4 AS b, {S.h("doc_id||'|l2'")} % 2 AS c, {S.h("doc_id||'|l3'")} % 2 AS e, {S.h("doc_id||'|lf'")} % 30 = 0 AS failed FROM documents),
q AS (SELECT *, CASE a WHEN 0 THEN 'High ' || codebook_id WHEN 1 THEN 'Low ' || codebook_id WHEN 2 THEN 'No label' ELSE 'hmm' END AS quality FROM n),
m AS (SELECT *, CASE WHEN failed THEN '' ELSE CASE b WHEN 0 THEN 'clear ' WHEN 1 THEN CASE WHEN a = 0 THEN 'SHORT ' ELSE 'short ' END
   WHEN 2 THEN 'deep ' ELSE CASE WHEN a = 0 THEN 'Wrong ' ELSE 'wrong ' END END || codebook_id END AS reason,
   CASE WHEN failed THEN '' WHEN b IN (0, 1) THEN 'Style' ELSE 'Content' END AS reason_group,
   CASE WHEN failed THEN '' WHEN c = 0 THEN 'rude ' || codebook_id ELSE 'kind ' || codebook_id END AS toxic,
   CASE WHEN failed THEN '' WHEN e = 0 THEN 'mild ' || codebook_id ELSE 'strong ' || codebook_id END AS strength,
   CASE WHEN failed THEN 10 ELSE 46 END // 4 AS tokens, NOT failed AS ok FROM q),
r AS (SELECT item_id, codebook_id, 0 AS step_order, 'Quality' AS dimension, quality AS label, tokens, ok FROM m
UNION ALL SELECT item_id, codebook_id, 1, 'Reason', reason, tokens, ok FROM m UNION ALL SELECT item_id, codebook_id, 1, 'Reason group', reason_group, tokens, ok FROM m
UNION ALL SELECT item_id, codebook_id, 2, 'Toxic', toxic, tokens, ok FROM m UNION ALL SELECT item_id, codebook_id, 3, 'Strength', strength, tokens, ok FROM m)
SELECT r.* FROM r WHERE codebook_id IN (SELECT conv_id FROM conversations)""",
)
def _annotate_library(spark, d):
    plan = L.labeling_plan(*_library(spark, d))
    out = L.annotate_library(_library_work(spark, d), plan, P.recorded(_library_answers(spark, d)))
    return out.drop("content", "context", "reasoning")


_ORDER_DIMS = f"""
dims AS (SELECT conv_id AS codebook_id, turn AS sort_order, 'd' || turn AS dim,
  ['d' || {S.h("conv_id||'|'||turn||'|og'")} % 12, 'd' || {S.h("conv_id||'|'||turn||'|oc'")} % 24] AS sources FROM conversations)"""


@query(
    "step_order",
    f"""
WITH RECURSIVE {_ORDER_DIMS},
need AS (SELECT DISTINCT x.codebook_id, x.dim, y.dim AS source, (y.sort_order >= x.sort_order)::INT AS later
  FROM (SELECT codebook_id, dim, sort_order, unnest(sources) AS s FROM dims) x JOIN dims y ON y.codebook_id = x.codebook_id AND y.dim = x.s),
walk AS (SELECT codebook_id, dim, dim AS at, 0 AS weight, 0 AS steps FROM dims
  UNION SELECT w.codebook_id, w.dim, need.source, w.weight + need.later, w.steps + 1 FROM walk w JOIN need ON need.codebook_id = w.codebook_id AND need.dim = w.at
  WHERE w.steps <= 10),
turn AS (SELECT codebook_id, dim, CASE WHEN max(steps) <= 9 THEN max(weight) END AS turn FROM walk GROUP BY ALL)
SELECT codebook_id, dim, row_number() OVER (PARTITION BY codebook_id ORDER BY turn NULLS LAST, sort_order) - 1 AS step_order
FROM turn JOIN dims USING (codebook_id, dim)""",
)
def _step_order(spark, d):
    """Up to eight dimensions per codebook with two sources each; some stand in circles."""
    rows = table(spark, d, "conversations")
    dims = rows.select(
        F.col("conv_id").alias("codebook_id"), F.concat(F.lit("d"), "turn").alias("dim"), F.col("turn").alias("sort_order"),
        F.lit("").alias("derived_from"), F.concat(F.lit("d"), h("conv_id", "turn", "'og'") % 12).alias("gated_by"),
        F.array(F.concat(F.lit("d"), h("conv_id", "turn", "'oc'") % 24)).alias("context_dims"),
    )
    return L.step_order(dims).withColumn("step_order", F.col("step_order").cast("bigint"))


@query(
    "user_labeler",
    """
WITH i AS (SELECT doc_id AS item_id, len(regexp_extract_all(CASE WHEN doc_id % 3 = 0 THEN 'Context: ' || lang || chr(10) || chr(10) ELSE '' END || 'Sentence: ' || text, '[ \\n]+')) AS n FROM documents)
SELECT item_id, 'Toxic' AS dimension, CASE WHEN n % 2 = 0 THEN 'Yes' ELSE 'No' END AS label, n + 1 AS tokens FROM i""",
)
def user_labeler(spark, d):
    """A user function over batches: answers yes when the text has an even number of words."""
    import pandas as pd

    def label(batch: pd.DataFrame) -> pd.DataFrame:
        n = batch["input"].str.count(r"[ \n]+")
        said = n.mod(2).map({0: "Answer: Yes", 1: "Answer: No"})
        return pd.DataFrame({"response": said, "tokens": n + 1})

    one = [P.Step(name="Toxic", dims=["Toxic"], labels={"Toxic": ["Yes", "No"]}, prompt="Even?")]
    done = P.annotate(_work(spark, d), one, P.pandas_labeler(label))
    return P.result_rows(done, one).select("item_id", "dimension", "label", "tokens")


# ---- streams ---------------------------------------------------------------------------------


@query("annotate_stream", f"WITH {_RUN} {_RESULTS}")
def annotate_stream(spark, d):
    docs = T.table_stream(spark, d, "documents").select(
        F.col("doc_id").alias("item_id"), F.col("text").alias("content"), F.lit("").alias("context")
    )
    rows = T.annotate_stream(docs, steps(spark), P.recorded(recorded_answers(spark, d)))
    return T.run_to_table(rows.drop("reasoning"), "annotate")


@query(
    "job_progress_stream",
    f"""
WITH r AS (SELECT {S.h("doc_id||'|job'")} % 3 AS job_id, {S.h("doc_id||'|fail'")} % 40 <> 0 AS ok, n_chars AS tokens FROM documents)
SELECT job_id, count(*) FILTER (ok) AS completed, count(*) FILTER (NOT ok) AS failed, sum(tokens) FILTER (ok)::BIGINT AS tokens FROM r GROUP BY job_id""",
)
def _progress(spark, d):
    rows = T.table_stream(spark, d, "documents").select(
        (h("doc_id", "'job'") % 3).alias("job_id"), F.col("doc_id").alias("item_id"),
        (h("doc_id", "'fail'") % 40 != 0).alias("ok"), F.col("n_chars").alias("tokens"),
    )
    twice = rows.withColumn("again", F.explode(F.array(F.lit(0), F.lit(1)))).drop("again")
    return T.run_to_table(T.job_progress(twice), "progress", "complete")


@query(
    "corrections_stream",
    S.with_(
        "pred edits",
        f"""
WITH last AS (SELECT job_id, item_id, {S.n2('dimension')} AS k, max_by(label, edit_id) AS label FROM edits GROUP BY ALL)
SELECT p.pred_id, coalesce(e.label, p.label) AS label FROM pred p
LEFT JOIN last e ON e.job_id = p.job_id AND e.item_id = p.item_id AND e.k = {S.n2('p.dimension')}""",
    ),
)
def _corrections(spark, d):
    stream = edits(spark, d, T.table_stream(spark, d, "documents"))
    return T.run_corrections(stream, predictions(spark, d)).select("pred_id", "label")


@query(
    "usage_window_stream",
    S.with_(
        "msgs",
        """
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, round(sum(cost), 4) AS cost, sum(tokens)::BIGINT AS tokens FROM msgs
WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM msgs) GROUP BY 1""",
    ),
)
def _usage_window(spark, d):
    e = T.table_stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = T.run_to_table(T.usage_window(usage(e)), "usage")
    return out.select(F.date_format("day", "yyyy-MM-dd").alias("day"), F.round("cost", 4).alias("cost"), "tokens")

