"""Rules, versions, prompts and run estimates, from the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelworks.functions import rough_tokens
from labelworks.operators import joins as J
from labelworks.operators import ledger as G

from . import sql as S
from .registry import query
from .relations import gold_items, predictions, rules, table

KEYS = ["codebook_id", "dimension"]


@query(
    "latest_version_per_key",
    S.with_("rules", "SELECT codebook_id, dimension, version, pos, rule_id FROM rules QUALIFY row_number() OVER (PARTITION BY codebook_id, dimension ORDER BY pos DESC) = 1"),
)
def _latest(spark, d):
    rows = rules(spark, d).select("codebook_id", "dimension", "version", "pos", "rule_id")
    return G.latest_per(rows, KEYS, "pos")


@query(
    "next_version",
    S.with_(
        "rules",
        """
WITH v AS (SELECT codebook_id, dimension, version, count(*) AS n_rules FROM rules GROUP BY ALL),
w AS (SELECT *, greatest(0, n_rules - coalesce(lag(n_rules) OVER (PARTITION BY codebook_id, dimension ORDER BY version), 0)) AS added FROM v)
SELECT codebook_id, dimension, max(version) + 1 AS next_version, max_by(added, version) AS new_rules, max_by(n_rules, version) AS n_rules FROM w GROUP BY ALL""",
    ),
)
def _next(spark, d):
    v = rules(spark, d).groupBy(*KEYS, "version").agg(F.count(F.lit(1)).alias("n_rules"))
    return G.next_version(v, KEYS)


@query(
    "best_prompt",
    """
WITH dims AS (SELECT DISTINCT user_id AS project_id, event_type AS dim FROM events),
o AS (
  SELECT user_id AS project_id, event_type AS dim, 3 AS p, 0 AS o, 'given ' || event_type AS prompt, 'given' AS source FROM events WHERE user_id % 7 = 0 AND event_type = 'view'
  UNION ALL SELECT user_id, event_type, 2, event_id, 'run ' || event_id, 'run' FROM events WHERE event_id % 5 IN (1, 2)
  UNION ALL SELECT user_id, event_type, 1, event_id, 'step ' || event_id, 'step' FROM events WHERE event_id % 5 = 3)
SELECT d.project_id, d.dim, coalesce(b.prompt, 'generated ' || d.dim) AS prompt, coalesce(b.source, 'generated') AS source FROM dims d LEFT JOIN
  (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY project_id, dim ORDER BY p DESC, o DESC) = 1) b ON b.project_id = d.project_id AND b.dim = d.dim""",
)
def _best_prompt(spark, d):
    e = table(spark, d, "events").withColumnRenamed("user_id", "project_id")
    i = F.col("event_id")
    named = F.concat(F.upper("event_type"), F.lit(" (v1)"))
    dims = e.select("project_id", F.col("event_type").alias("dim"), F.concat(F.lit("generated "), "event_type").alias("generated_prompt")).distinct()
    steps = e.filter(i % 5 >= 3).select(
        "project_id", F.when(i % 5 == 3, F.array("event_type")).otherwise(F.array("event_type", F.lit("other"))).alias("dims"),
        F.concat(F.lit("step "), i.cast("string")).alias("prompt"), i.alias("step_order"),
    )
    runs = e.select(
        "project_id", i.alias("run_id"), named.alias("dimension"),
        F.when(i % 5 == 0, "failed").otherwise("completed").alias("status"),
        F.when(i % 5 <= 2, F.concat(F.lit("run "), i.cast("string"))).alias("prompt"),
    )
    given = e.filter("project_id % 7 = 0 AND event_type = 'view'").select(
        "project_id", named.alias("dimension"), F.concat(F.lit("given "), "event_type").alias("prompt")
    ).distinct()
    return G.best_prompt(dims, steps, runs, given)


@query("valid_rules", S.with_("rules", "SELECT pos, boundary FROM rules WHERE boundary <> ''"))
def _valid(spark, d):
    return G.valid_rules(rules(spark, d)).select("pos", "boundary")


@query(
    "changed_rules",
    S.with_(
        "rules",
        """
WITH o AS (SELECT codebook_id, dimension, rule_id, boundary, rule, target_labels FROM rules WHERE pos % 3 = 0),
n AS (SELECT * FROM rules WHERE pos % 3 <> 0)
SELECT pos FROM n WHERE boundary <> '' AND NOT EXISTS (SELECT 1 FROM o WHERE o.codebook_id IS NOT DISTINCT FROM n.codebook_id AND o.dimension = n.dimension
  AND o.rule_id = n.rule_id AND o.boundary = n.boundary AND o.rule = n.rule AND o.target_labels = n.target_labels)""",
    ),
)
def _changed(spark, d):
    r = rules(spark, d).drop("version")
    return G.changed_rules(r.filter("pos % 3 <> 0"), r.filter("pos % 3 = 0"), KEYS).select("pos")


@query(
    "upsert_rules",
    S.with_(
        "rules",
        """
WITH t AS (SELECT *, pos % 2 AS is_new, CASE WHEN pos % 2 = 0 THEN CASE WHEN rule_id = '' THEN 'r_' || pos ELSE rule_id END
    WHEN rule_id <> '' THEN rule_id ELSE boundary END AS id FROM rules WHERE pos % 2 = 0 OR boundary <> '')
SELECT codebook_id, dimension, id AS merged_id, max_by(pos, is_new * 1000000000 + pos) AS pos, min_by(pos, is_new * 1000000000 + pos) AS place_pos, min(is_new)::INTEGER AS place_new FROM t GROUP BY ALL""",
    ),
)
def _upsert(spark, d):
    r = rules(spark, d).drop("version")
    old = r.filter("pos % 2 = 0").withColumn("rule_id", F.nullif("rule_id", F.lit("")))
    out = G.upsert_rules(old, G.valid_rules(r.filter("pos % 2 = 1")), KEYS)
    return out.select("codebook_id", "dimension", "merged_id", "pos", "place_pos", "place_new")


@query(
    "guard_shrink",
    S.with_(
        "rules",
        """
WITH n AS (SELECT codebook_id, dimension, count(*) AS n_old, count(*) FILTER (boundary <> '' AND pos % 4 <> 0) AS n_new FROM rules GROUP BY ALL)
SELECT *, n_new > 0 AND n_new <= n_old AND n_new >= greatest(3, 2 * n_old // 3) AS accepted FROM n""",
    ),
)
def _guard(spark, d):
    r = rules(spark, d)
    return G.guard_shrink(r, r.filter("pos % 4 <> 0"), KEYS)


def _worked_inputs(spark, d):
    r = rules(spark, d).filter("codebook_id IS NOT NULL").groupBy("codebook_id", "dimension").agg(
        F.min("pos").alias("pos"), F.min_by("target_labels", "pos").alias("target_labels")
    )
    r = r.withColumn("rule_id", F.concat(F.lit("r"), F.col("pos").cast("string")))
    rows = predictions(spark, d).filter("step_order = 0").join(gold_items(spark, d), "item_id")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("sentence"))
    gold = F.when(F.col("item_id") % 2 == 0, "High").otherwise("Low")
    ex = rows.join(docs, "item_id").select(
        ((F.col("item_id") % 150)).alias("codebook_id"), F.col("item_id").alias("ord"), "item_id", "sentence",
        gold.alias("gold"), F.initcap(F.lower("label")).alias("first_pred"),
    )
    return r, ex


@query(
    "worked_examples",
    S.with_(
        "gold pred rules",
        """
WITH rl AS (SELECT codebook_id, dimension, min(pos) AS pos, min_by(target_labels[1], pos) AS target FROM rules WHERE codebook_id IS NOT NULL GROUP BY ALL),
ri AS (SELECT *, row_number() OVER (PARTITION BY codebook_id ORDER BY pos) AS i FROM rl),
ex AS (SELECT p.item_id % 150 AS codebook_id, p.item_id, CASE WHEN p.item_id % 2 = 0 THEN 'High' ELSE 'Low' END AS gold, lower(p.label) AS said, length(d.text) AS size
  FROM pred p JOIN documents d ON d.doc_id = p.item_id WHERE p.step_order = 0 AND p.item_id IN (SELECT item_id FROM gold)),
cl AS (SELECT codebook_id, gold, list(item_id ORDER BY (said = lower(gold))::INT, size, item_id) AS items FROM ex GROUP BY ALL),
w AS (SELECT ri.codebook_id, ri.i, ri.pos, cl.gold, cl.items[1] AS item_id, [cl.items[1]] AS used FROM ri LEFT JOIN cl ON cl.codebook_id = ri.codebook_id AND cl.gold = ri.target WHERE ri.i = 1
  UNION ALL
  SELECT ri.codebook_id, ri.i, ri.pos, cl.gold, list_filter(cl.items, lambda x: NOT list_contains(w.used, x))[1],
     list_append(w.used, list_filter(cl.items, lambda x: NOT list_contains(w.used, x))[1])
  FROM w JOIN ri ON ri.codebook_id = w.codebook_id AND ri.i = w.i + 1 LEFT JOIN cl ON cl.codebook_id = ri.codebook_id AND cl.gold = ri.target)
SELECT codebook_id, pos, 'r' || pos AS rule_id, item_id, gold FROM w WHERE item_id IS NOT NULL""",
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def _worked(spark, d):
    r, ex = _worked_inputs(spark, d)
    return G.worked_examples(r, ex, ["codebook_id"]).select("codebook_id", "pos", "rule_id", "item_id", "gold")


@query(
    "estimate_run",
    """
WITH i AS (SELECT lang, doc_id, greatest(1, round_even((length(text) + 10) / 5.0::DOUBLE, 0))::BIGINT AS t FROM documents),
s AS (SELECT lang, round_even(avg(t), 0)::BIGINT AS per_call FROM i GROUP BY lang),
n AS (SELECT lang, count(*) AS n_items FROM i GROUP BY lang),
p AS (SELECT lang, count(*) AS n_steps, sum(greatest(1, round_even(length(source) / 5.0::DOUBLE, 0)))::BIGINT AS prompt_tokens FROM (SELECT DISTINCT lang, source FROM documents) GROUP BY lang)
SELECT lang, n_items, n_items * n_steps AS n_calls, n_items * prompt_tokens + n_items * n_steps * per_call AS input_tokens, n_items * n_steps * 24 AS output_tokens FROM n JOIN s USING (lang) JOIN p USING (lang)""",
)
def _estimate(spark, d):
    docs = table(spark, d, "documents")
    items = docs.select("lang", rough_tokens(F.concat(F.lit("Sentence: "), "text")).alias("input_tokens"))
    steps = docs.select("lang", "source").distinct().select("lang", rough_tokens(F.col("source")).alias("prompt_tokens"))
    return G.estimate_run(items, steps, ["lang"]).select("lang", "n_items", "n_calls", "input_tokens", "output_tokens")


def _purged(spark, d):
    from .relations import edits

    removed = table(spark, d, "documents").filter("source = 'src1'").select(F.col("doc_id").alias("item_id"))
    runs = table(spark, d, "labels").select(F.col("doc_id").alias("run_id"), F.col("doc_id").alias("gold_item_id"))
    tables = {"predictions": predictions(spark, d), "edits": edits(spark, d), "runs": runs}
    return J.purge(tables, removed, "item_id")


@query("purge_rows", S.with_("pred", "SELECT pred_id FROM pred WHERE item_id NOT IN (SELECT doc_id FROM documents WHERE source = 'src1')"))
def _purge(spark, d):
    return _purged(spark, d)["predictions"].select("pred_id")


@query("purge_keeps_runs", "SELECT l.doc_id AS run_id, CASE WHEN d.source = 'src1' THEN NULL ELSE l.doc_id END AS gold_item_id FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id")
def _purge_runs(spark, d):
    return _purged(spark, d)["runs"]


@query(
    "purge_tree_rows",
    S.with_(
        "edits",
        """
WITH kept AS (SELECT doc_id FROM documents WHERE source IS DISTINCT FROM 'src1' AND source IS DISTINCT FROM 'src2'),
p AS (SELECT pred_id FROM pred WHERE item_id IN (SELECT doc_id FROM kept))
SELECT 'sources' AS part, source AS id FROM (SELECT DISTINCT source FROM documents) WHERE source IS DISTINCT FROM 'src1' AND source IS DISTINCT FROM 'src2'
UNION ALL SELECT 'items', doc_id::VARCHAR FROM kept
UNION ALL SELECT 'predictions', pred_id::VARCHAR FROM p
UNION ALL SELECT 'edits', edit_id::VARCHAR FROM edits WHERE edit_id // 10 IN (SELECT pred_id FROM p)
UNION ALL SELECT 'golds', doc_id::VARCHAR FROM labels WHERE doc_id IN (SELECT doc_id FROM kept) OR doc_id NOT IN (SELECT doc_id FROM documents)""",
    ),
)
def _purge_tree(spark, d):
    """Two sources go, with their items, what was predicted for these, and the corrections of that."""
    from .relations import edits

    docs = table(spark, d, "documents")
    tables = {
        "sources": docs.select("source").distinct(),
        "items": docs.select(F.col("doc_id").alias("item_id"), "source"),
        "predictions": predictions(spark, d).select("pred_id", "item_id"),
        "edits": edits(spark, d).select("edit_id", F.expr("edit_id div 10").alias("pred_id")),
        "golds": table(spark, d, "labels").select(F.col("doc_id").alias("item_id")),
    }
    links = [
        ("items", "source", "sources", "source"),
        ("predictions", "item_id", "items", "item_id"),
        ("golds", "item_id", "items", "item_id"),
        ("edits", "pred_id", "predictions", "pred_id"),
    ]
    removed = tables["sources"].filter("source in ('src1', 'src2')")
    left = J.purge_tree(tables, removed, "sources", "source", links)
    ids = {"sources": "source", "items": "item_id", "predictions": "pred_id", "edits": "edit_id", "golds": "item_id"}
    parts = [left[n].select(F.lit(n).alias("part"), F.col(c).cast("string").alias("id")) for n, c in ids.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query(
    "stack_runs",
    S.with_("traj", "SELECT run_id % 10 AS seed, count(*) AS n, round(sum(val_acc), 4) AS total FROM traj GROUP BY ALL"),
)
def _stack(spark, d):
    """Runs written as JSON files, one folder per seed, and stacked again."""
    from labelworks.scratch import new_path

    from .relations import trajectory

    path = new_path(spark, "runs")
    t = trajectory(spark, d).select((F.col("run_id") % 10).alias("seed"), "run_id", "round", "val_acc")
    t.write.json(path)
    runs = G.stack_runs(spark, path, "seed bigint, run_id bigint, round bigint, val_acc double", lines=True)
    return runs.groupBy("seed").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("val_acc"), 4).alias("total"))
