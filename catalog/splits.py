"""Splits of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelworks.operators import joins as J
from labelworks.operators import splits as P
from labelworks.operators.rank import running_total
from labelworks.scratch import stored

from . import sql as S
from .registry import query
from .relations import h, label_sets, table


def _ranked(source: str, part: str, item: str, seed: str) -> str:
    over = f"PARTITION BY {part}" if part else ""
    return (
        f"r AS (SELECT *, row_number() OVER ({over} ORDER BY md5({item} || '|{seed}'), {item}) AS rank, "
        f"count(*) OVER ({over}) AS n FROM {source})"
    )


_CUT = """
c AS (SELECT *, greatest(1, round_even(0.15::DOUBLE * n, 0)) AS nt, greatest(1, round_even(0.42::DOUBLE * n, 0)) AS nv0 FROM r),
k AS (SELECT *, CASE WHEN nt + nv0 > n - 1 THEN greatest(1, n - nt - 1) ELSE nv0 END AS nv FROM c),
assigned AS (SELECT *, CASE WHEN n < 3 OR rank <= nt THEN 'train' WHEN rank <= nt + nv THEN 'val' ELSE 'test' END AS split FROM k)"""


def _examples(spark, d):
    return table(spark, d, "documents").select("doc_id", F.concat("lang", F.lit("-"), "source").alias("label"))


_SRC = "(SELECT doc_id, lang || '-' || source AS label FROM documents)"


@query("stratified_split", f"WITH {_ranked(_SRC, 'label', 'doc_id', '17')}, {_CUT} SELECT doc_id, label, split FROM assigned")
def stratified_split(spark, d):
    return P.stratified_split(_examples(spark, d), "label", "doc_id", 17)


_GROUPED = f"""
ex AS (SELECT doc_id AS source_id, label, pos FROM (
   SELECT doc_id, CASE {S.h("doc_id||'|g0'")} % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS label, 0 AS pos FROM documents
   UNION ALL SELECT doc_id, 'extra', 1 FROM documents WHERE doc_id % 3 = 0)),
first AS (SELECT source_id, min_by(label, pos) AS class FROM ex GROUP BY source_id),
{_ranked('first', 'class', 'source_id', '5')}, {_CUT}"""


def _grouped(spark, d):
    first = F.when(h("doc_id", "'g0'") % 3 == 0, "a").when(h("doc_id", "'g0'") % 3 == 1, "b").otherwise("c")
    two = F.when(F.col("doc_id") % 3 == 0, F.array(first, F.lit("extra"))).otherwise(F.array(first))
    ex = table(spark, d, "documents").select(F.col("doc_id").alias("source_id"), F.posexplode(two).alias("pos", "label"))
    return P.grouped_split(ex, 5)


@query("grouped_split", f"WITH {_GROUPED} SELECT ex.source_id, ex.pos::INTEGER AS pos, ex.label, a.split FROM ex JOIN assigned a USING (source_id)")
def _grouped_split(spark, d):
    return _grouped(spark, d)


@query(
    "two_way_split",
    f"""WITH {_ranked(_SRC, 'label', 'doc_id', '17')}
SELECT doc_id, label, CASE WHEN n < 2 OR rank <= least(n - 1, greatest(1, round_even(0.7::DOUBLE * n, 0))) THEN 'train' ELSE 'val' END AS split FROM r""",
)
def _two_way(spark, d):
    return P.two_way_split(_examples(spark, d), "label", "doc_id", 17)


@query(
    "fraction_split",
    f"""WITH {_ranked('documents', '', 'doc_id', '9')}
SELECT doc_id, CASE WHEN rank <= floor(n * 0.4::DOUBLE) THEN 'train' WHEN rank <= floor(n * 0.4::DOUBLE) + floor(n * 0.3::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM r""",
)
def _fraction(spark, d):
    return P.fraction_split(table(spark, d, "documents").select("doc_id"), "doc_id", 9)


@query(
    "fraction_split_with_floors",
    f"""WITH {_ranked('(SELECT conv_id, turn, conv_id * 1000 + turn AS id FROM conversations)', 'conv_id', 'id', '9')},
a AS (SELECT *, greatest(5, round_even(n * 0.5::DOUBLE, 0)) AS nt, greatest(5, round_even(n * 0.25::DOUBLE, 0)) AS nv FROM r),
b AS (SELECT *, greatest(0, n - nt - nv) AS nx FROM a),
c AS (SELECT *, CASE WHEN nx < 3 AND nt > 5 THEN least(3 - nx, nt - 5) ELSE 0 END AS steal FROM b)
SELECT id, CASE WHEN rank <= nt - steal THEN 'train' WHEN rank <= nt - steal + nv THEN 'val' ELSE 'test' END AS split FROM c""",
)
def _floors(spark, d):
    c = table(spark, d, "conversations").select("conv_id", (F.col("conv_id") * 1000 + F.col("turn")).alias("id"))
    return P.fraction_split(c, "id", 9, 0.5, 0.25, floors=True, scope=["conv_id"]).select("id", "split")


@query("balanced_multilabel_split")
def balanced(spark, d):
    sets = label_sets(spark, d).select("item_id", F.col("gold").alias("labels"))
    return P.balanced_multilabel_split(sets, "item_id", "labels", _FRACTIONS, 3)


_FRACTIONS = {"train": 0.15, "val": 0.42, "test": 0.43}


@query(
    "balanced_split_support",
    S.with_(
        "sets",
        """
WITH items AS (SELECT item_id, list(DISTINCT label) FILTER (in_gold) AS ls FROM sets GROUP BY item_id),
f(split, f) AS (VALUES ('train', 0.15::DOUBLE), ('val', 0.42), ('test', 0.43)),
t AS (SELECT NULL::VARCHAR AS label, count(*) AS total FROM items
  UNION ALL SELECT label, count(*) FROM (SELECT unnest(ls) AS label FROM items) GROUP BY label)
SELECT label, split, total, floor(3 + 0.02::DOUBLE * total)::BIGINT AS allowed, true AS within FROM t, f""",
    ),
)
def _support(spark, d):
    """Every item stays, and each label's support and each split's size is within 3 items and 2 % of its share.
    Items without gold labels are nulls here."""
    gold = F.when(F.size("gold") > 0, F.col("gold"))
    sets = label_sets(spark, d).select("item_id", gold.alias("labels"))
    out = P.balanced_multilabel_split(sets, "item_id", "labels", _FRACTIONS, 3)
    report = P.split_report(out.withColumn("labels", F.coalesce("labels", F.array().cast("array<string>"))))
    share = F.map_from_entries(F.array(*[F.struct(F.lit(k), F.lit(v)) for k, v in _FRACTIONS.items()]))
    counts = F.map_from_entries(F.collect_list(F.struct("split", "n")))
    rows = report.groupBy("label").agg(counts.alias("counts"), F.sum("n").alias("total"))
    allowed = F.floor(3 + 0.02 * F.col("total"))
    return rows.select("label", "total", allowed.alias("allowed"), "counts", F.explode(share).alias("split", "f")).select(
        "label", "split", "total", "allowed",
        (F.abs(F.coalesce(F.try_element_at("counts", "split"), F.lit(0)) - F.col("f") * F.col("total")) <= F.col("allowed")).alias("within"),
    )


@query(
    "split_report",
    f"""WITH {_GROUPED}, x AS (SELECT ex.source_id, a.split, ex.label FROM ex JOIN assigned a USING (source_id))
SELECT split, label, count(*) AS n FROM x GROUP BY ALL UNION ALL SELECT split, NULL, count(DISTINCT source_id) FROM x GROUP BY split""",
)
def _report(spark, d):
    per_item = _grouped(spark, d).groupBy("source_id", "split").agg(F.collect_list("label").alias("labels"))
    return P.split_report(per_item)


@query(
    "split_gates",
    f"""WITH {_GROUPED}, x AS (SELECT a.split FROM ex JOIN assigned a USING (source_id) WHERE ex.label = 'c' OR a.split = 'test'),
n AS (SELECT count(*) AS n, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val FROM x)
SELECT 'fractions_do_not_sum_to_one' AS error, 3::BIGINT AS amount UNION ALL SELECT 'fraction_out_of_range', 1
UNION ALL SELECT 'too_few_examples', n FROM n WHERE n < 15 UNION ALL SELECT 'too_few_train', train FROM n WHERE train < 5 AND n >= 15
UNION ALL SELECT 'too_few_val', val FROM n WHERE val < 5 AND n >= 15""",
)
def _gates(spark, d):
    x = _grouped(spark, d).filter("label = 'c' OR split = 'test'")
    return P.split_gates(x, {"train": 0.15, "val": 0.0, "test": 0.43})


@query(
    "split_overlap",
    f"""WITH {_GROUPED}, x AS (SELECT ex.source_id, CASE WHEN ex.label = 'extra' AND source_id % 9 = 0 THEN 'test' ELSE a.split END AS split FROM ex JOIN assigned a USING (source_id))
SELECT source_id, min(split) AS first_split, max(split) AS last_split FROM x GROUP BY source_id HAVING count(DISTINCT split) > 1""",
)
def _overlap(spark, d):
    moved = F.when((F.col("label") == "extra") & (F.col("source_id") % 9 == 0), "test").otherwise(F.col("split"))
    return J.split_overlap(_grouped(spark, d).withColumn("split", moved))


@query(
    "seeded_order",
    "SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id || '|4'), doc_id) AS rank FROM documents",
)
def _order(spark, d):
    """The place of each row in the seeded order, counted partition by partition of the sorted rows."""
    rows = P.seeded_order(table(spark, d, "documents").select("doc_id"), "doc_id", 4)
    placed = stored(rows.withColumn("at", F.monotonically_increasing_id()), "seeded-order")
    ranked = running_total(placed, [], "at", [], bucket=F.shiftright("at", 33))
    return ranked.select("doc_id", (F.col("before") + 1).alias("rank"))
