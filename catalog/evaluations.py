"""Joins, metrics, agreement, resampling and thresholds."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelworks.functions.labels import gold_values
from labelworks.operators import agreement as A
from labelworks.operators import experiments as X
from labelworks.operators import joins as J
from labelworks.operators import leaks as K
from labelworks.operators import metrics as M
from labelworks.operators import resampling as R
from labelworks.plans import evaluation as E
from labelworks.sources import exports

from . import sql as S
from .registry import query, rounded
from .relations import (
    QUALITY,
    QUALITY_GOLD,
    SET_LABELS,
    TOXIC,
    YES,
    coder_gold,
    edits,
    gold_items,
    h,
    items,
    label_sets,
    pick,
    predictions,
    scores,
    table,
    trajectory,
    usage,
)

# ---- scored pairs in SQL ---------------------------------------------------------------------

_PAIRS = f"""
cmp AS (SELECT p.pred_id, p.dimension, any_value(p.label) AS pred,
   CASE WHEN bool_or({S.agree('p.label', 'g.label')}) THEN any_value(p.label) ELSE min_by(g.label, g.pos) END AS gold_label
  FROM pred p JOIN gold g ON p.item_id = g.item_id AND {S.n2('p.dimension')} = {S.n2('g.dimension')}
  GROUP BY p.pred_id, p.dimension),
classes AS (SELECT DISTINCT dimension, gold_label AS class FROM cmp UNION SELECT DISTINCT dimension, pred FROM cmp),
per_class AS (
  SELECT k.dimension, k.class,
    count(*) FILTER (c.gold_label = k.class AND c.pred = k.class) AS tp,
    count(*) FILTER (c.gold_label <> k.class AND c.pred = k.class) AS fp,
    count(*) FILTER (c.gold_label = k.class AND c.pred <> k.class) AS fn
  FROM classes k JOIN cmp c ON c.dimension = k.dimension GROUP BY k.dimension, k.class),
prf AS (SELECT *, tp + fn AS support,
    CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END AS precision,
    CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END AS recall,
    CASE WHEN tp > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) ELSE 0 END AS f1 FROM per_class),
scored AS (SELECT dimension, sum(support)::BIGINT AS n, count(*) AS n_classes,
    round(sum(tp) / sum(support)::DOUBLE, 6) AS accuracy,
    round(avg(precision) FILTER (support > 0), 6) AS macro_precision,
    round(avg(recall) FILTER (support > 0), 6) AS macro_recall,
    round(avg(f1) FILTER (support > 0), 6) AS macro_f1,
    round(sum(f1 * support) / sum(support)::DOUBLE, 6) AS weighted_f1
  FROM prf GROUP BY dimension)"""


@query("metrics_by_dimension", S.with_("gold pred", f"WITH {_PAIRS} SELECT * FROM scored"))
def metrics_by_dimension(spark, d):
    out = E.metrics_by_dimension(predictions(spark, d), gold_items(spark, d))
    return rounded(out, "accuracy", "macro_precision", "macro_recall", "macro_f1", "weighted_f1")


@query(
    "per_class_metrics",
    S.with_(
        "gold pred",
        f"""WITH {_PAIRS} SELECT dimension, class, tp, fp, fn, support, round(precision, 6) AS precision,
        round(recall, 6) AS recall, round(f1, 6) AS f1 FROM prf""",
    ),
)
def _per_class(spark, d):
    out = E.class_metrics_by_dimension(predictions(spark, d), gold_items(spark, d))
    return rounded(out, "precision", "recall", "f1")


@query(
    "classification_metrics",
    f"""
WITH p AS (SELECT conv_id % 4 AS grp, role AS gold_label, CASE WHEN {S.h("conv_id||'|'||turn||'|r'")} % 10 < 7 THEN role
   ELSE 'other' END AS pred FROM conversations),
classes AS (SELECT grp, gold_label AS class FROM p UNION SELECT grp, pred FROM p),
c AS (SELECT k.grp, k.class, count(*) FILTER (gold_label = class AND pred = class) AS tp,
    count(*) FILTER (gold_label <> class AND pred = class) AS fp, count(*) FILTER (gold_label = class AND pred <> class) AS fn
  FROM classes k JOIN p USING (grp) GROUP BY ALL),
m AS (SELECT *, tp + fn AS s, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END AS pr,
  CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END AS re FROM c)
SELECT grp, sum(s)::BIGINT AS n, count(*) AS n_classes, round(sum(tp) / sum(s)::DOUBLE, 6) AS accuracy,
  round(avg(pr) FILTER (s > 0), 6) AS macro_precision, round(avg(re) FILTER (s > 0), 6) AS macro_recall
FROM m GROUP BY grp""",
)
def _classification(spark, d):
    c = table(spark, d, "conversations")
    wrong = h("conv_id", "turn", "'r'") % 10 >= 7
    pairs = c.select(
        (F.col("conv_id") % 4).alias("grp"), F.col("role").alias("true"),
        F.when(wrong, "other").otherwise(F.col("role")).alias("pred"),
    )
    out = M.classification_metrics(pairs, ["grp"]).drop("macro_f1", "weighted_f1")
    return rounded(out, "accuracy", "macro_precision", "macro_recall")


@query(
    "confusion",
    S.with_(
        "gold pred",
        f"""WITH {_PAIRS}
SELECT a.dimension, a.class AS "true", b.class AS pred,
  (SELECT count(*) FROM cmp c WHERE c.dimension = a.dimension AND c.gold_label = a.class AND c.pred = b.class) AS n
FROM classes a JOIN classes b ON a.dimension = b.dimension""",
    ),
)
def _confusion(spark, d):
    return E.confusion_by_dimension(predictions(spark, d), gold_items(spark, d))


@query("overall_accuracy", S.with_("gold pred", f"WITH {_PAIRS} SELECT round(avg(accuracy), 6) AS overall_accuracy FROM scored"))
def _overall(spark, d):
    m = E.metrics_by_dimension(predictions(spark, d), gold_items(spark, d))
    return rounded(M.overall_accuracy(rounded(m, "accuracy")), "overall_accuracy")


@query("class_universe", S.with_("gold pred", f"WITH {_PAIRS} SELECT dimension, class FROM classes"))
def _universe(spark, d):
    return M.class_universe(E.scored_pairs(predictions(spark, d), gold_items(spark, d)), ["dimension"])


_ML = """
lab AS (SELECT lang, label, count(*) FILTER (in_gold AND in_a) AS tp, count(*) FILTER (in_a AND NOT in_gold) AS fp,
    count(*) FILTER (in_gold AND NOT in_a) AS fn FROM sets GROUP BY lang, label HAVING bool_or(in_gold OR in_a)),
lm AS (SELECT *, tp + fn AS support, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END AS precision,
    CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END AS recall,
    CASE WHEN tp > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) ELSE 0 END AS f1 FROM lab),
ex AS (SELECT lang, item_id, bool_and(in_gold = in_a) AS exact FROM sets GROUP BY lang, item_id)"""


def _ab(spark, d, which="pred_a"):
    return label_sets(spark, d).select("item_id", "lang", "gold", F.col(which).alias("pred"))


@query(
    "multilabel_metrics",
    S.with_(
        "sets",
        f"""WITH {_ML}
SELECT l.lang, e.n, round(e.accuracy, 6) AS accuracy, count(*) AS n_labels,
  round(sum(tp) / sum(tp + fp)::DOUBLE, 6) AS micro_precision, round(sum(tp) / sum(tp + fn)::DOUBLE, 6) AS micro_recall,
  round(2 * sum(tp) / sum(2 * tp + fp + fn)::DOUBLE, 6) AS micro_f1,
  round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1
FROM lm l JOIN (SELECT lang, count(*) AS n, avg(exact::INT) AS accuracy FROM ex GROUP BY lang) e ON l.lang = e.lang
GROUP BY l.lang, e.n, e.accuracy""",
    ),
)
def multilabel_metrics(spark, d):
    out = M.multilabel_metrics(_ab(spark, d), ["lang"])
    return rounded(
        out, "accuracy", "micro_precision", "micro_recall", "micro_f1", "macro_precision", "macro_recall", "macro_f1"
    )


@query(
    "per_label_metrics",
    S.with_(
        "sets",
        f"""WITH {_ML} SELECT lang, label, tp, fp, fn, support, round(precision, 6) AS precision,
        round(recall, 6) AS recall, round(f1, 6) AS f1 FROM lm""",
    ),
)
def _per_label(spark, d):
    return rounded(M.per_label_metrics(_ab(spark, d), ["lang"]), "precision", "recall", "f1")


@query(
    "set_errors",
    S.with_(
        "sets",
        """SELECT item_id, coalesce(string_agg(label, ',' ORDER BY label) FILTER (in_gold AND NOT in_a), '') AS missed,
  coalesce(string_agg(label, ',' ORDER BY label) FILTER (in_a AND NOT in_gold), '') AS added FROM sets GROUP BY item_id""",
    ),
)
def _set_errors(spark, d):
    out = M.set_errors(_ab(spark, d))
    return out.select(
        "item_id", *[F.array_join(F.array_sort(c), ",").alias(c) for c in ("missed", "added")]
    )


def _gold_long(spark, d):
    return gold_items(spark, d).select("item_id", F.explode("gold").alias("dimension", "raw")).select(
        "item_id", "dimension", F.explode(gold_values(F.col("raw"))).alias("label")
    )


@query(
    "class_counts",
    S.with_(
        "gold",
        f"""
WITH names AS (SELECT DISTINCT dimension, upper(label) AS label FROM gold
   UNION SELECT DISTINCT dimension, 'Unused ' || dimension FROM gold),
raw AS (SELECT dimension, CASE WHEN item_id % 40 = 7 THEN 'odd one' ELSE label END AS label FROM gold),
g AS (SELECT dimension, {S.n4('label')} AS k, count(*) AS n, min(label) AS label FROM raw GROUP BY ALL),
m AS (SELECT coalesce(names.dimension, g.dimension) AS dimension, coalesce(names.label, g.label) AS label,
    coalesce(g.n, 0) AS n, names.label IS NOT NULL AS in_codebook
  FROM names FULL JOIN g ON names.dimension = g.dimension AND {S.n4('names.label')} = g.k)
SELECT *, n > 0 AND n / (sum(n) OVER (PARTITION BY dimension))::DOUBLE < 0.05 AS rare FROM m""",
    ),
)
def _class_counts(spark, d):
    gold = _gold_long(spark, d)
    names = gold.select("dimension", F.upper("label").alias("label")).unionByName(
        gold.select("dimension", F.concat(F.lit("Unused "), "dimension").alias("label"))
    ).distinct()
    odd = gold.withColumn("label", F.when(F.col("item_id") % 40 == 7, "odd one").otherwise(F.col("label")))
    return M.class_counts(odd, names)


@query("label_distribution", S.with_("gold", "SELECT dimension, label, count(*) AS n FROM gold GROUP BY ALL"))
def _distribution(spark, d):
    return M.label_distribution(_gold_long(spark, d))


@query(
    "per_class_f1_series",
    """
WITH p AS (SELECT conv_id // 10 AS run_id, turn AS round, role AS gold_label,
   CASE WHEN (conv_id + turn) % 3 = 0 THEN 'user' ELSE role END AS pred FROM conversations),
classes AS (SELECT run_id, round, gold_label AS class FROM p UNION SELECT run_id, round, pred FROM p),
c AS (SELECT run_id, round, class, count(*) FILTER (gold_label = class AND pred = class) AS tp,
   count(*) FILTER ((gold_label = class) <> (pred = class)) AS wrong FROM classes JOIN p USING (run_id, round) GROUP BY ALL)
SELECT run_id, round, class, round(CASE WHEN tp > 0 THEN 2.0::DOUBLE * tp / (2 * tp + wrong) ELSE 0 END, 4) AS f1 FROM c""",
)
def _f1_series(spark, d):
    c = table(spark, d, "conversations")
    pairs = c.select(
        F.floor(F.col("conv_id") / 10).alias("run_id"), F.col("turn").alias("round"), F.col("role").alias("true"),
        F.when((F.col("conv_id") + F.col("turn")) % 3 == 0, "user").otherwise(F.col("role")).alias("pred"),
    )
    return M.per_class_f1_series(pairs)


# ---- joins -----------------------------------------------------------------------------------


@query(
    "predictions_with_items",
    S.with_("pred", "SELECT p.pred_id, p.label, d.lang, length(d.text) AS size FROM pred p JOIN documents d ON p.item_id = d.doc_id WHERE p.job_id = 1"),
)
def _with_items(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), "lang", F.length("text").cast("bigint").alias("size"))
    return J.with_items(predictions(spark, d).filter("job_id = 1"), docs).select("pred_id", "label", "lang", "size")


@query(
    "gold_of_predicted_items",
    S.with_("gold pred", "SELECT p.pred_id, (SELECT count(DISTINCT dimension) FROM gold g WHERE g.item_id = p.item_id) AS n_gold FROM pred p"),
)
def _with_gold(spark, d):
    return J.with_gold(predictions(spark, d), gold_items(spark, d)).select(
        "pred_id", F.size("gold").cast("bigint").alias("n_gold")
    )


_EVIDENCE = f"""
own AS (SELECT DISTINCT item_id FROM gold),
bytext AS (SELECT d.text, min(d.doc_id) AS gold_id FROM documents d JOIN own ON d.doc_id = own.item_id WHERE d.text <> '' GROUP BY d.text),
src AS (SELECT p.*, d.text, coalesce(o.item_id, b.gold_id) AS gold_id
  FROM pred p JOIN documents d ON p.item_id = d.doc_id LEFT JOIN own o ON o.item_id = p.item_id LEFT JOIN bytext b ON b.text = d.text
  WHERE p.dimension = 'Quality of text'),
ev AS (SELECT s.pred_id, s.item_id, s.step_order, any_value(s.label) AS label, any_value(s.text) AS text,
    count(g.label) AS n_gold, string_agg(g.label, ', ' ORDER BY g.pos) AS shown, bool_or(g.is_list) AS is_list,
    bool_or({S.agree('s.label', 'g.label')}) AS hit
  FROM src s LEFT JOIN gold g ON g.item_id = s.gold_id AND g.dimension LIKE 'Quality%' GROUP BY s.pred_id, s.item_id, s.step_order),
meta AS (SELECT *, CASE WHEN n_gold > 0 THEN shown WHEN item_id % 5 <> 0 THEN ''
    ELSE CASE {S.h("item_id||'|ml'")} % 3 WHEN 0 THEN 'High' WHEN 1 THEN 'Low' ELSE '' END END AS gold_label FROM ev),
evidence AS (SELECT pred_id, item_id, md5(CASE WHEN item_id % 5 = 0 AND {S.trim_('left(text, 30)')} <> '' THEN {S.trim_('left(text, 30)')} ELSE text END) AS content_hash,
    gold_label, label, CASE WHEN gold_label = '' THEN 'missing' WHEN n_gold > 0 AND is_list THEN CASE WHEN hit THEN 'partial' ELSE 'mismatch' END
      WHEN {S.agree('label', 'gold_label')} THEN 'match' ELSE 'mismatch' END AS match_status FROM meta)"""


def _evidence(spark, d, review_only=False):
    its = items(spark, d)
    return J.evidence(predictions(spark, d), its, its, "Quality of text", review_only)


@query(
    "evidence",
    S.with_("gold pred", f"WITH {_EVIDENCE} SELECT *, match_status = 'mismatch' AS is_mismatch FROM evidence"),
)
def evidence(spark, d):
    return _evidence(spark, d).select(
        "pred_id", "item_id", F.md5("content").alias("content_hash"), "gold_label", "label", "match_status", "is_mismatch"
    )


@query(
    "evidence_review_page",
    S.with_(
        "gold pred",
        f"""WITH {_EVIDENCE} SELECT pred_id, item_id, match_status FROM evidence WHERE match_status IN ('mismatch', 'partial')
        ORDER BY match_status <> 'mismatch', item_id LIMIT 50 OFFSET 10""",
    ),
)
def _evidence_page(spark, d):
    rows = J.page(_evidence(spark, d, True), J.review_order(), 50, 10)
    return rows.select("pred_id", "item_id", "match_status")


@query(
    "gold_by_equal_text",
    """
WITH g AS (SELECT d.text, min(d.doc_id) AS gold_id FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE d.text <> '' GROUP BY d.text)
SELECT d.doc_id AS item_id, g.gold_id, l.quality FROM documents d JOIN g ON d.text = g.text JOIN labels l ON l.doc_id = g.gold_id
WHERE d.doc_id NOT IN (SELECT doc_id FROM labels)""",
)
def _same_text(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("content"))
    gold = docs.join(table(spark, d, "labels").withColumnRenamed("doc_id", "item_id"), "item_id").select(
        "item_id", "content",
        F.create_map(F.lit("id"), F.col("item_id").cast("string"), F.lit("quality"), F.col("quality").cast("string")).alias("gold"),
    )
    found = J.gold_by_text(gold)
    unlabeled = docs.join(gold.select("item_id"), "item_id", "left_anti")
    rows = unlabeled.select("item_id", F.sha2("content", 256).alias("text_key")).join(found, "text_key")
    return rows.select(
        "item_id", F.col("text_gold")["id"].cast("bigint").alias("gold_id"), F.col("text_gold")["quality"].cast("int").alias("quality")
    )


@query(
    "join_by_name_key",
    f"""
WITH names AS (SELECT DISTINCT role AS name, 'r:' || role AS info FROM conversations
   UNION SELECT DISTINCT upper(role) || 's', 's:' || role FROM conversations),
l AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN role WHEN 1 THEN role || 's' ELSE '  ' || upper(role) || '!' END AS name FROM conversations),
near AS (SELECT {S.n1('name')} AS k, max(name) AS name FROM names GROUP BY 1)
SELECT l.conv_id, l.turn, coalesce(e.name, n.name) AS matched_name, coalesce(e.info, ni.info) AS info
FROM l LEFT JOIN names e ON e.name = l.name LEFT JOIN near n ON n.k = {S.n1('l.name')} LEFT JOIN names ni ON ni.name = n.name""",
)
def _by_key(spark, d):
    from labelworks.functions import align_key

    c = table(spark, d, "conversations")
    names = c.select(F.col("role").alias("name"), F.concat(F.lit("r:"), "role").alias("info")).unionByName(
        c.select(F.concat(F.upper("role"), F.lit("s")).alias("name"), F.concat(F.lit("s:"), "role").alias("info"))
    ).distinct()
    left = c.select(
        "conv_id", "turn",
        pick(F.col("turn") % 3, F.col("role"), F.concat("role", F.lit("s")), F.concat(F.lit("  "), F.upper("role"), F.lit("!"))).alias("name"),
    )
    return J.join_by_key(left, names, "name", align_key).select("conv_id", "turn", "matched_name", "info")


@query(
    "page_of_results",
    S.with_("pred", "SELECT pred_id, item_id, step_order, label FROM pred WHERE job_id = 0 ORDER BY item_id, step_order LIMIT 50 OFFSET 100"),
)
def _page(spark, d):
    rows = predictions(spark, d).filter("job_id = 0").select("pred_id", "item_id", "step_order", "label")
    return J.page(rows, ["item_id", "step_order"], 50, 100)


@query(
    "correction_overlay",
    S.with_(
        "pred edits",
        f"""
WITH last AS (SELECT job_id, item_id, {S.n2('dimension')} AS k, max_by(label, edit_id) AS label FROM edits GROUP BY ALL)
SELECT p.pred_id, coalesce(e.label, p.label) AS label FROM pred p
LEFT JOIN last e ON e.job_id = p.job_id AND e.item_id = p.item_id AND e.k = {S.n2('p.dimension')}""",
    ),
)
def _overlay(spark, d):
    from labelworks.operators.ledger import overlay

    return overlay(predictions(spark, d), edits(spark, d)).select("pred_id", "label")


@query(
    "candidate_scores",
    S.with_(
        "gold",
        f"""
WITH cand AS (SELECT g.item_id, g.label AS gold, 'c' || j AS candidate, j AS ord, g.dimension,
    CASE WHEN {S.h("g.item_id||'|c'||j")} % 10 = 0 THEN NULL WHEN {S.h("g.item_id||'|c'||j")} % 10 < 7 THEN g.label ELSE 'High' END AS resp
  FROM gold g CROSS JOIN range(3) r(j) WHERE pos = 0)
SELECT candidate, dimension, count(*) AS n, round(avg(coalesce(resp = gold, false)::INT), 6) AS accuracy,
  sum(CASE WHEN resp IS NULL THEN 0 ELSE 10 + ord END)::BIGINT AS tokens
FROM cand WHERE dimension LIKE 'Quality%' GROUP BY candidate, dimension""",
    ),
)
def _candidates(spark, d):
    from labelworks.plans.labeling import score_candidates

    return rounded(score_candidates(_cand(spark, d), ["candidate", "dimension"]), "accuracy")


def _cand(spark, d):
    rows = coder_gold(spark, d).filter("coder = 'a'").filter(F.col("dimension") == QUALITY_GOLD)
    examples = rows.select("item_id", "dimension", F.col("label").alias("gold"))
    cands = rows.select("dimension").distinct().select(
        "dimension", F.posexplode(F.array(*[F.lit(f"c{j}") for j in range(3)])).alias("ord", "candidate")
    )
    both = J.cross_candidates(cands, examples)
    n = h("item_id", "candidate") % 10
    resp = F.when(n == 0, F.lit(None)).when(n < 7, F.col("gold")).otherwise("High")
    return both.select(
        "candidate", "ord", "dimension", "item_id", "gold",
        F.concat(F.lit("Answer: "), resp).alias("response"),
        F.array(F.lit("High"), F.lit("Low")).alias("options"),
        (F.lit(10) + F.col("ord")).alias("tokens"),
    )


@query(
    "best_candidate",
    S.with_(
        "gold",
        f"""
WITH cand AS (SELECT g.item_id, g.label AS gold, 'c' || j AS candidate, j AS ord, g.dimension,
    CASE WHEN {S.h("g.item_id||'|c'||j")} % 10 = 0 THEN NULL WHEN {S.h("g.item_id||'|c'||j")} % 10 < 7 THEN g.label ELSE 'High' END AS resp
  FROM gold g CROSS JOIN range(3) r(j) WHERE pos = 0 AND g.dimension LIKE 'Quality%'),
acc AS (SELECT dimension, candidate, ord, avg(coalesce(resp = gold, false)::INT) AS accuracy FROM cand GROUP BY ALL)
SELECT dimension, candidate, round(accuracy, 6) AS accuracy FROM acc QUALIFY row_number() OVER (PARTITION BY dimension ORDER BY accuracy DESC, ord) = 1""",
    ),
)
def _best(spark, d):
    from labelworks.plans.labeling import best_candidate, score_candidates

    s = score_candidates(_cand(spark, d), ["candidate", "ord", "dimension"]).select("dimension", "candidate", "ord", "accuracy")
    return rounded(best_candidate(s, ["dimension"]).drop("ord"), "accuracy")


# ---- leaks -----------------------------------------------------------------------------------

_EXAMPLES = f"""
cuts AS (SELECT item_id, CASE item_id % 3 WHEN 0 THEN 'val' WHEN 1 THEN 'test' ELSE 'train' END AS split, text FROM benchmark
   UNION ALL SELECT item_id, 'short', left(text, 12) FROM benchmark),
ex AS (SELECT item_id AS source_id, split, {S.trim_("text")} AS sentence FROM cuts)"""
_OPENINGS = _EXAMPLES.replace("left(text, 12) FROM benchmark", "left(text, 12) FROM benchmark UNION ALL SELECT item_id, 'opening', left(text, 24) FROM benchmark")
_FOUND = """
hits AS (SELECT d.doc_id AS prompt_id, ex.source_id, ex.split, ex.sentence AS sample FROM documents d JOIN ex
   ON length(ex.sentence) >= 20 AND contains(lower(d.text), lower(ex.sentence)))"""


def _leak_inputs(spark, d, openings=False):
    """Whole benchmark texts against whole documents; beside them cuts that are too short to check, and openings
    that hold few words or none between their ends."""
    b = table(spark, d, "benchmark")
    split = pick(F.col("item_id") % 3, "val", "test", "train")
    cuts = [(split, F.col("text")), (F.lit("short"), F.substring("text", 1, 12))]
    if openings:
        cuts.append((F.lit("opening"), F.substring("text", 1, 24)))
    rows = F.array(*[F.struct(s.alias("split"), t.alias("sentence")) for s, t in cuts])
    ex = b.select(F.col("item_id").alias("source_id"), F.inline(rows))
    prompts = table(spark, d, "documents").select(F.col("doc_id").alias("prompt_id"), F.col("text").alias("prompt"))
    return prompts, ex


@query(
    "leaked_examples",
    f"WITH {_OPENINGS}, {_FOUND} SELECT prompt_id, source_id, split, md5(sample) AS sample FROM hits",
)
def _leaks(spark, d):
    return K.leaked_examples(*_leak_inputs(spark, d, openings=True)).withColumn("sample", F.md5("sample"))


@query(
    "leak_audit",
    f"WITH {_EXAMPLES}, {_FOUND} SELECT prompt_id, split, count(*) AS leaks, md5(min_by(sample, source_id)) AS first_sample FROM hits GROUP BY ALL",
)
def leak_audit(spark, d):
    return K.leak_audit(*_leak_inputs(spark, d)).select(
        "prompt_id", "split", "leaks", F.md5(F.get("samples", F.lit(0))).alias("first_sample")
    )


@query(
    "leak_audit_coverage",
    f"WITH {_EXAMPLES} SELECT split, count(*) AS checked, count(*) FILTER (length(sentence) < 20) AS skipped_short FROM ex GROUP BY split",
)
def _coverage(spark, d):
    return K.audit_coverage(_leak_inputs(spark, d)[1])


# ---- coders ----------------------------------------------------------------------------------

_TWO = "two AS (SELECT a.item_id, a.dimension, a.label AS label_a, b.label AS label_b FROM coders a JOIN coders b USING (item_id, dimension) WHERE a.coder = 'a' AND b.coder = 'b')"


@query("pair_coders", S.with_("gold coders", f"WITH {_TWO} SELECT * FROM two"))
def _pairs(spark, d):
    return J.pair_coders(coder_gold(spark, d), "a", "b")


@query(
    "agreement",
    S.with_(
        "gold coders",
        f"""WITH {_TWO} SELECT dimension, count(*) AS shared, round(avg((label_a = label_b)::INT), 6) AS agreement,
        round(avg((label_a = '{YES}')::INT), 6) AS rate_a, round(avg((label_b = '{YES}')::INT), 6) AS rate_b FROM two GROUP BY dimension""",
    ),
)
def _agreement(spark, d):
    return rounded(A.agreement(coder_gold(spark, d), "a", "b", YES), "agreement", "rate_a", "rate_b")


@query(
    "shared_items",
    S.with_("gold coders", "SELECT item_id FROM coders WHERE coder = 'a' INTERSECT SELECT item_id FROM coders WHERE coder = 'b'"),
)
def _shared(spark, d):
    g = coder_gold(spark, d)
    return J.shared_items(g.filter("coder = 'a'"), g.filter("coder = 'b'"))


@query(
    "exclude_holdout",
    S.with_("gold coders", f"SELECT item_id, coder, dimension, label FROM coders WHERE item_id NOT IN (SELECT doc_id FROM documents WHERE {S.h('doc_id::VARCHAR')} % 2 = 0)"),
)
def _holdout(spark, d):
    block = table(spark, d, "documents").filter(h("doc_id") % 2 == 0).select(F.col("doc_id").alias("item_id"))
    return J.exclude_holdout(coder_gold(spark, d), block).select("item_id", "coder", "dimension", "label")


@query("disputed_items", S.with_("gold coders", f"WITH {_TWO} SELECT * FROM two WHERE label_a <> label_b"))
def _disputed(spark, d):
    return A.disputed_items(coder_gold(spark, d), "a", "b")


@query(
    "adjudication_sheet",
    S.with_(
        "gold coders",
        f"""WITH {_TWO} SELECT item_id, dimension, '' AS final_label, '' AS notes, label_a, label_b,
   CASE WHEN item_id % 3 = 0 THEN '' ELSE label_a END AS verdict, CASE WHEN item_id % 3 = 0 THEN '' ELSE CAST(item_id % 7 AS VARCHAR) END AS confidence,
   CASE WHEN item_id % 3 = 0 THEN '' ELSE 'r1; r' || item_id % 5 END AS cited_rules FROM two WHERE label_a <> label_b""",
    ),
)
def _adjudication(spark, d):
    g = coder_gold(spark, d)
    verdicts = g.filter("coder = 'a' AND item_id % 3 <> 0").select(
        "item_id", "dimension", F.col("label").alias("verdict"), (F.col("item_id") % 7).alias("confidence"),
        F.array(F.lit("r1"), F.concat(F.lit("r"), (F.col("item_id") % 5).cast("string"))).alias("cited_rules"),
    )
    return A.adjudication_sheet(A.disputed_items(g, "a", "b"), verdicts)


@query(
    "cross_target",
    S.with_(
        "gold coders",
        f"""
WITH lab AS (SELECT c.item_id, w.labeler, CASE WHEN {S.h("c.item_id||'|'||w.labeler||'|x'")} % 10 < w.keep THEN c.label ELSE '{YES}' END AS label
   FROM coders c JOIN (VALUES ('a', 8), ('b', 6)) w(labeler, keep) ON true WHERE c.coder = 'a' AND c.dimension = '{TOXIC}'),
acc AS (SELECT l.labeler, c.coder, count(*) AS n, avg((l.label = c.label)::INT) AS accuracy FROM lab l
   JOIN coders c ON c.item_id = l.item_id AND c.dimension = '{TOXIC}' GROUP BY ALL)
SELECT labeler, coder, n, round(accuracy, 6) AS accuracy,
  round((SELECT avg(accuracy) FROM acc o WHERE o.coder = acc.coder AND o.labeler = o.coder) - (SELECT avg(accuracy) FROM acc o WHERE o.coder = acc.coder AND o.labeler <> o.coder), 6) AS own_minus_other
FROM acc""",
    ),
)
def _cross(spark, d):
    g = coder_gold(spark, d).filter(F.col("dimension") == TOXIC)
    preds = g.filter("coder = 'a'").select(
        "item_id", "label", F.inline(F.array(
            F.struct(F.lit("a").alias("labeler"), F.lit(8).alias("keep")), F.struct(F.lit("b").alias("labeler"), F.lit(6).alias("keep"))
        ))
    ).select("labeler", "item_id", F.when(h("item_id", "labeler", "'x'") % 10 < F.col("keep"), F.col("label")).otherwise(YES).alias("label"))
    return rounded(A.cross_target(preds, g), "accuracy", "own_minus_other")


# ---- resampling and thresholds ---------------------------------------------------------------

_DELTA = """
SELECT lang, count(DISTINCT item_id) AS n,
  round(100 * (2 * count(*) FILTER (in_gold AND in_a) / (count(*) FILTER (in_gold) + count(*) FILTER (in_a))::DOUBLE
   - 2 * count(*) FILTER (in_gold AND in_b) / (count(*) FILTER (in_gold) + count(*) FILTER (in_b))::DOUBLE), 6) AS point
FROM sets GROUP BY lang"""


@query("delta_f1", S.with_("sets", _DELTA))
def _delta_f1(spark, d):
    return rounded(R.delta_f1(label_sets(spark, d), ["lang"]), "point")


@query("bootstrap_delta_f1")
def bootstrap_delta_f1(spark, d):
    return R.bootstrap_delta_f1(label_sets(spark, d), ["lang"], iters=10_000, seed=7)


def _two_labelers(spark, d):
    s = label_sets(spark, d)
    first = [F.coalesce(F.get(c, F.lit(0)), F.lit("none")).alias(c) for c in ("gold", "pred_a", "pred_b")]
    return s.select("lang", *first)


@query(
    "delta_accuracy",
    S.with_(
        "sets",
        """
WITH f AS (SELECT item_id, lang, coalesce(min(label) FILTER (in_gold), 'none') AS g, coalesce(min(label) FILTER (in_a), 'none') AS a,
   coalesce(min(label) FILTER (in_b), 'none') AS b FROM sets GROUP BY ALL)
SELECT lang, count(*) AS n, round(avg((a = g)::INT) - avg((b = g)::INT), 6) AS point FROM f GROUP BY lang""",
    ),
)
def _delta_acc(spark, d):
    return rounded(R.delta_accuracy(_two_labelers(spark, d), ["lang"]), "point")


@query("bootstrap_delta_accuracy")
def _boot_acc(spark, d):
    return R.bootstrap_delta_accuracy(_two_labelers(spark, d), ["lang"], iters=10_000, seed=7)


def _bounds(spans, errors):
    """Whether the interval holds the point, and whether its width is that of the normal interval within a
    factor of 1.25 (groups of 100 items or more)."""
    wide = (F.col("high") - F.col("low")) / (2 * 1.959964 * F.col("error"))
    rows = spans.join(errors.drop("n"), "lang").select(
        "lang",
        "n",
        "point",
        "error",
        ((F.col("low") <= F.col("point")) & (F.col("point") <= F.col("high"))).alias("holds_point"),
        F.when((F.col("n") >= 100) & (F.col("error") > 0), wide.between(0.8, 1.25)).alias("width_ok"),
    )
    return rounded(rows, "point", "error")


_WIDE = "true AS holds_point, CASE WHEN n >= 100 AND error > 0 THEN true END AS width_ok"


@query(
    "bootstrap_f1_bounds",
    S.with_(
        "sets",
        f"""
WITH i AS (SELECT lang, item_id, count(*) FILTER (in_gold AND in_a) AS ta, count(*) FILTER (in_gold) + count(*) FILTER (in_a) AS da,
   count(*) FILTER (in_gold AND in_b) AS tb, count(*) FILTER (in_gold) + count(*) FILTER (in_b) AS db FROM sets GROUP BY ALL),
g AS (SELECT lang, count(*) AS n, sum(da) AS sa, sum(db) AS sb, 2 * sum(ta) / sum(da)::DOUBLE AS fa, 2 * sum(tb) / sum(db)::DOUBLE AS fb FROM i GROUP BY lang),
e AS (SELECT lang, any_value(n) AS n, 100 * (any_value(fa) - any_value(fb)) AS point,
   100 * stddev_pop((2 * ta - fa * da) * n / sa - (2 * tb - fb * db) * n / sb) / sqrt(any_value(n)) AS error FROM i JOIN g USING (lang) GROUP BY lang)
SELECT lang, n, round(point, 6) AS point, round(error, 6) AS error, {_WIDE} FROM e""",
    ),
)
def _f1_bounds(spark, d):
    sets = label_sets(spark, d)
    return _bounds(R.bootstrap_delta_f1(sets, ["lang"], iters=10_000, seed=7), R.delta_f1_error(sets, ["lang"]))


@query(
    "bootstrap_accuracy_bounds",
    S.with_(
        "sets",
        f"""
WITH f AS (SELECT item_id, lang, coalesce(min(label) FILTER (in_gold), 'none') AS g, coalesce(min(label) FILTER (in_a), 'none') AS a,
   coalesce(min(label) FILTER (in_b), 'none') AS b FROM sets GROUP BY ALL),
e AS (SELECT lang, count(*) AS n, avg((a = g)::INT - (b = g)::INT) AS point, stddev_pop((a = g)::INT - (b = g)::INT) / sqrt(count(*)) AS error FROM f GROUP BY lang)
SELECT lang, n, round(point, 6) AS point, round(error, 6) AS error, {_WIDE} FROM e""",
    ),
)
def _accuracy_bounds(spark, d):
    two = _two_labelers(spark, d)
    return _bounds(R.bootstrap_delta_accuracy(two, ["lang"], iters=10_000, seed=7), R.delta_accuracy_error(two, ["lang"]))


_SEEDED = f"""
sd AS (SELECT *, seed, {S.h("item_id||'|half'||seed")} % 2 AS half FROM (
   SELECT item_id, score, 'a' AS coder, truth_a AS truth FROM scores UNION ALL SELECT item_id, score, 'b', truth_b FROM scores) s CROSS JOIN range(5) r(seed)),
grid AS (SELECT coder, seed, i, avg(((score >= i / 20.0::DOUBLE)::INT = truth)::INT) AS acc, count(*) AS n
   FROM sd CROSS JOIN range(1, 20) g(i) WHERE half = 0 GROUP BY ALL),
thr AS (SELECT coder, seed, i / 20.0::DOUBLE AS threshold, acc, n FROM grid QUALIFY row_number() OVER (PARTITION BY coder, seed ORDER BY acc DESC, i) = 1)"""


def _seeded_scores(spark, d):
    s = scores(spark, d)
    both = s.select("item_id", "score", F.inline(F.array(
        F.struct(F.lit("a").alias("coder"), F.col("truth_a").alias("truth")),
        F.struct(F.lit("b").alias("coder"), F.col("truth_b").alias("truth")),
    )))
    return X.repeat_over_seeds(both, 5, lambda df: df.withColumn(
        "half", h("item_id", F.concat(F.lit("half"), F.col("seed").cast("string"))) % 2
    ))


@query(
    "learn_threshold",
    S.with_("scores", f"WITH {_SEEDED} SELECT coder, seed, threshold, round(acc, 6) AS accuracy, n FROM thr"),
)
def _threshold(spark, d):
    calib = _seeded_scores(spark, d).filter("half = 0")
    return rounded(R.learn_threshold(calib, ["coder", "seed"]), "accuracy")


@query(
    "threshold_over_seeds",
    S.with_(
        "scores",
        f"""WITH {_SEEDED}, test AS (SELECT s.coder, s.seed, avg(((score >= threshold)::INT = truth)::INT) AS accuracy
   FROM sd s JOIN thr USING (coder, seed) WHERE half = 1 GROUP BY ALL)
SELECT coder, count(*) AS runs, round(avg(accuracy), 6) AS mean, round(stddev_pop(accuracy), 6) AS std FROM test GROUP BY coder""",
    ),
)
def _threshold_seeds(spark, d):
    s = _seeded_scores(spark, d)
    learned = R.learn_threshold(s.filter("half = 0"), ["coder", "seed"]).select("coder", "seed", "threshold")
    acc = R.threshold_accuracy(s.filter("half = 1"), learned, ["coder", "seed"], ["coder", "seed"])
    return rounded(X.mean_std(acc, ["coder"], "accuracy"), "mean", "std")


# ---- experiment tables -----------------------------------------------------------------------


def _mean_query(name: str, sample: bool):
    dev = "coalesce(stddev_samp(val_acc), 0)" if sample else "stddev_pop(val_acc)"

    @query(name, S.with_("traj", f"SELECT run_id, event_type, count(*) AS runs, round(avg(val_acc), 8) AS mean, round({dev}, 8) AS std FROM traj GROUP BY ALL"))
    def run(spark, d):
        # eight digits: a mean of a few four-digit numbers is then never halfway between two roundings
        out = X.mean_std(trajectory(spark, d), ["run_id", "event_type"], "val_acc", sample)
        return out.withColumns({c: F.round(c, 8) for c in ("mean", "std")})


_mean_query("mean_std_population", False)
_mean_query("mean_std_sample", True)


@query(
    "comparison_table",
    S.with_(
        "traj",
        """
WITH runs AS (SELECT user_id % 5 AS coder, event_type AS dimension, val_acc AS before, least(1.0, val_acc * 1.1) AS after, round AS tokens FROM traj),
rows AS (SELECT * FROM runs UNION ALL SELECT coder, NULL, before, after, tokens FROM runs)
SELECT coder, dimension, round(avg(before), 6) AS before, round(avg(after), 6) AS after, sum(tokens)::BIGINT AS tokens, count(*) AS runs,
  round((avg(after) - avg(before)) * 100, 5) AS delta_pp FROM rows GROUP BY ALL""",
    ),
)
def _comparison(spark, d):
    t = trajectory(spark, d)
    runs = t.select(
        (F.col("user_id") % 5).alias("coder"), F.col("event_type").alias("dimension"), F.col("val_acc").alias("before"),
        F.least(F.lit(1.0), F.col("val_acc") * 1.1).alias("after"), F.col("round").alias("tokens"),
    )
    out = rounded(X.comparison_table(runs, "coder"), "before", "after")
    return out.withColumn("delta_pp", F.round("delta_pp", 5))


@query("trajectory_rows", S.with_("traj", "SELECT run_id, round, val_acc FROM traj"))
def _trajectory_rows(spark, d):
    packed = trajectory(spark, d).groupBy("run_id").agg(F.collect_list(F.struct("round", "val_acc")).alias("trajectory"))
    return X.trajectory_rows(packed, ["run_id"])


@query(
    "trajectory_ends",
    S.with_(
        "traj",
        """
WITH r AS (SELECT run_id, round, val_acc, row_number() OVER (PARTITION BY run_id ORDER BY val_acc, round) AS position,
   count(*) OVER (PARTITION BY run_id) AS n FROM traj)
SELECT run_id, round, val_acc, position::INTEGER AS position FROM r WHERE n <= 8 OR position <= 4 OR position > n - 4""",
    ),
)
def _ends(spark, d):
    return X.trajectory_ends(trajectory(spark, d), ["run_id"], 8).select("run_id", "round", "val_acc", "position")


@query(
    "acceptance_replay",
    S.with_(
        "traj",
        """
WITH RECURSIVE o AS (SELECT run_id, round, val_acc, row_number() OVER (PARTITION BY run_id ORDER BY round) AS i FROM traj),
w AS (SELECT run_id, round, val_acc, i, true AS accepted, val_acc AS current FROM o WHERE i = 1
  UNION ALL
  SELECT o.run_id, o.round, o.val_acc, o.i, o.val_acc + 0.005::DOUBLE >= w.current, CASE WHEN o.val_acc + 0.005::DOUBLE >= w.current THEN o.val_acc ELSE w.current END
  FROM w JOIN o ON o.run_id = w.run_id AND o.i = w.i + 1)
SELECT run_id, round, val_acc, accepted, current FROM w""".replace("WITH RECURSIVE ", "WITH "),
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def _replay(spark, d):
    return X.replay(trajectory(spark, d), ["run_id"])


@query(
    "acceptance_replay_strict",
    S.with_(
        "traj",
        """
WITH b AS (SELECT run_id, round, val_acc, max(val_acc) OVER (PARTITION BY run_id ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM traj)
SELECT run_id, round, val_acc, best IS NULL OR val_acc > best AS accepted, greatest(val_acc, coalesce(best, val_acc)) AS current FROM b""",
    ),
)
def _replay_strict(spark, d):
    return X.replay(trajectory(spark, d), ["run_id"], strict=True)


_FAILED = f"""
fp AS (SELECT s.item_id, s.item_id % 9 AS run_id, c.condition, CASE WHEN c.condition = 'tuned' AND s.item_id % 9 IN (2, 5) AND {S.h("s.item_id||'|q'")} % 10 < 7 THEN 0
   ELSE count(*) FILTER (in_a) END AS n_pred FROM sets s CROSS JOIN (VALUES ('zero'), ('tuned')) c(condition) GROUP BY s.item_id, c.condition),
bad AS (SELECT run_id FROM fp WHERE condition = 'tuned' GROUP BY run_id HAVING avg((n_pred = 0)::INT) > 0.5)"""


def _failed(spark, d):
    s = label_sets(spark, d).select("item_id", (F.col("item_id") % 9).alias("run_id"), "pred_a",
        F.explode(F.array(F.lit("zero"), F.lit("tuned"))).alias("condition"))
    gone = (F.col("condition") == "tuned") & F.col("run_id").isin(2, 5) & (h("item_id", "'q'") % 10 < 7)
    return s.withColumn("pred", F.when(gone, F.array().cast("array<string>")).otherwise(F.col("pred_a"))).drop("pred_a")


@query("drop_failed_runs", S.with_("sets", f"WITH {_FAILED} SELECT run_id, condition, count(*) AS n, sum(n_pred)::BIGINT AS n_pred FROM fp WHERE run_id NOT IN (SELECT run_id FROM bad) GROUP BY ALL"))
def _drop_failed(spark, d):
    kept, _ = X.drop_failed_runs(_failed(spark, d), ["tuned"])
    return kept.groupBy("run_id", "condition").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("pred")).alias("n_pred"))


@query("excluded_runs", S.with_("sets", f"WITH {_FAILED} SELECT run_id FROM bad"))
def _excluded(spark, d):
    return X.drop_failed_runs(_failed(spark, d), ["tuned"])[1]


@query(
    "failure_sample",
    S.with_(
        "gold pred",
        f"""WITH {_PAIRS} SELECT c.pred_id AS item_id, c.gold_label AS gold, c.pred, md5(d.text) AS sentence
   FROM cmp c JOIN documents d ON d.doc_id = c.pred_id // 2 WHERE c.gold_label <> c.pred ORDER BY md5(c.pred_id || '|3'), c.pred_id LIMIT 12""",
    ),
)
def _failures(spark, d):
    rows = E.scored_pairs(predictions(spark, d), gold_items(spark, d), ["pred_id", "item_id"])
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("sentence"))
    scored = rows.join(docs, "item_id").select(F.col("pred_id").alias("item_id"), F.col("true").alias("gold"), "pred", "sentence")
    return X.failure_sample(scored, 12, 3).withColumn("sentence", F.md5("sentence"))


@query(
    "explode_examples",
    S.with_("gold", "SELECT item_id AS source_id, pos::INTEGER AS pos, upper(label) AS label FROM gold WHERE dimension LIKE 'Quality%'"),
)
def _explode(spark, d):
    labels = F.array(F.lit("HIGH"), F.lit("LOW"))
    return X.explode_examples(items(spark, d), QUALITY, labels).select("source_id", "pos", "label")


@query(
    "coder_examples",
    S.with_("gold", f"SELECT g.item_id AS source_id, g.label AS gold, md5(d.text) AS sentence FROM gold g JOIN documents d ON d.doc_id = g.item_id WHERE g.dimension = '{QUALITY_GOLD}' AND pos = 0"),
)
def _coder_examples(spark, d):
    return X.coder_examples(items(spark, d), QUALITY_GOLD).select("source_id", "gold", F.md5("sentence").alias("sentence"))


# ---- exports ---------------------------------------------------------------------------------


@query(
    "export_flat",
    S.with_(
        "gold",
        f"""SELECT d.doc_id AS item_id,
   coalesce((SELECT string_agg(label, ' & ' ORDER BY pos) FROM gold g WHERE g.item_id = d.doc_id AND dimension = '{QUALITY_GOLD}'), '') AS quality,
   coalesce((SELECT any_value(label) FROM gold g WHERE g.item_id = d.doc_id AND dimension = '{TOXIC}'), '') AS toxic FROM documents d""",
    ),
)
def _flat(spark, d):
    out = exports.export_flat(items(spark, d), [QUALITY_GOLD, TOXIC])
    return out.select("item_id", F.col(f"`{QUALITY_GOLD}`").alias("quality"), F.col(f"`{TOXIC}`").alias("toxic"))


@query(
    "export_wide",
    S.with_(
        "pred",
        f"""SELECT p.item_id, md5(CASE WHEN p.item_id % 5 = 0 AND {S.trim_('left(any_value(d.text), 30)')} <> '' THEN {S.trim_('left(any_value(d.text), 30)')} ELSE any_value(d.text) END) AS content,
   max(label) FILTER (step_order = 0) AS quality, max(label) FILTER (step_order = 1) AS toxic FROM pred p JOIN documents d ON d.doc_id = p.item_id GROUP BY p.item_id""",
    ),
)
def _wide(spark, d):
    out = exports.export_wide(predictions(spark, d), items(spark, d), [QUALITY, TOXIC])
    return out.select("item_id", F.md5("content").alias("content"), F.col(f"`{QUALITY}`").alias("quality"), F.col(f"`{TOXIC}`").alias("toxic"))


@query(
    "snapshot_rows",
    S.with_("pred", "SELECT p.pred_id, p.job_id, d.doc_id AS idx, md5(d.text) AS content FROM pred p JOIN documents d ON d.doc_id = p.item_id"),
)
def _snapshot(spark, d):
    return exports.snapshot_rows(predictions(spark, d), items(spark, d)).select(
        "pred_id", "job_id", "idx", F.md5("content").alias("content")
    )


@query(
    "job_counters",
    S.with_(
        "pred",
        """WITH r AS (SELECT job_id, item_id, any_value(ok) AS ok, sum(tokens) AS tokens FROM pred GROUP BY ALL)
SELECT job_id, count(*) FILTER (ok) AS completed, count(*) FILTER (NOT ok) AS failed, coalesce(sum(tokens) FILTER (ok), 0)::BIGINT AS tokens,
   CASE WHEN count(*) FILTER (NOT ok) = 0 THEN 'completed' ELSE 'failed' END AS status FROM r GROUP BY job_id""",
    ),
)
def _jobs(spark, d):
    from labelworks.operators.ledger import job_counters

    rows = predictions(spark, d).groupBy("job_id", "item_id").agg(F.first("ok").alias("ok"), F.sum("tokens").alias("tokens"))
    return job_counters(rows)


@query(
    "usage_by_model",
    S.with_("msgs", "SELECT event_type AS model, round(sum(cost), 4) AS cost, sum(tokens)::BIGINT AS tokens, round(sum(cost) / sum(tokens) * 1000000, 3) AS cost_per_million FROM msgs GROUP BY 1"),
)
def _usage_model(spark, d):
    from labelworks.operators.ledger import usage_by

    out = usage_by(usage(table(spark, d, "events")), "event_type", "model")
    return out.withColumns({"cost": F.round("cost", 4), "cost_per_million": F.round("cost_per_million", 3)})


@query(
    "usage_by_day",
    S.with_("msgs", "SELECT strftime(ts, '%Y-%m-%d') AS day, round(sum(cost), 4) AS cost, sum(tokens)::BIGINT AS tokens, round(sum(cost) / sum(tokens) * 1000000, 3) AS cost_per_million FROM msgs GROUP BY 1"),
)
def _usage_day(spark, d):
    from labelworks.operators.ledger import usage_by

    out = usage_by(usage(table(spark, d, "events")), F.date_format("ts", "yyyy-MM-dd"), "day")
    return out.withColumns({"cost": F.round("cost", 4), "cost_per_million": F.round("cost_per_million", 3)})


@query(
    "usage_total",
    S.with_("msgs", "SELECT 'all' AS total, round(sum(cost), 4) AS cost, sum(tokens)::BIGINT AS tokens, round(sum(cost) / sum(tokens) * 1000000, 3) AS cost_per_million FROM msgs"),
)
def _usage_total(spark, d):
    from labelworks.operators.ledger import usage_by

    out = usage_by(usage(table(spark, d, "events")), F.lit("all"), "total")
    return out.withColumns({"cost": F.round("cost", 4), "cost_per_million": F.round("cost_per_million", 3)})


@query(
    "label_set_scores",
    S.with_(
        "sets",
        f"""WITH {_ML}
SELECT l.lang, e.n, round(e.accuracy, 6) AS accuracy, round(2 * sum(tp) / sum(2 * tp + fp + fn)::DOUBLE, 6) AS micro_f1, round(avg(f1), 6) AS macro_f1
FROM lm l JOIN (SELECT lang, count(*) AS n, avg(exact::INT) AS accuracy FROM ex GROUP BY lang) e ON l.lang = e.lang GROUP BY l.lang, e.n, e.accuracy""",
    ),
)
def _set_scores(spark, d):
    from labelworks.plans.labeling import score_label_sets

    s = label_sets(spark, d).select(
        "lang", "gold", F.when(F.size("pred_a") == 0, "None").otherwise(F.lower(F.array_join("pred_a", " | "))).alias("response"),
        F.array(*[F.lit(x) for x in SET_LABELS]).alias("options"),
    )
    out = score_label_sets(s, ["lang"]).select("lang", "n", "accuracy", "micro_f1", "macro_f1")
    return rounded(out, "accuracy", "micro_f1", "macro_f1")
