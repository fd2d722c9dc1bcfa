"""Gold alignment and validation over all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelworks.operators import alignment as A
from labelworks.operators import codebooks as C
from labelworks.scratch import stored

from . import sql as S
from .registry import query
from .relations import h, pick, table

BOOKS = (1, 2)

# ---- messy gold: names and labels as people write them ---------------------------------------

_RAW = f"""
raw0 AS (SELECT doc_id AS idx, {S.h("doc_id||'|q'")} % 7 AS q, {S.h("doc_id||'|x'")} % 4 AS x, {S.h("doc_id||'|t'")} % 5 AS t, doc_id % 50 = 0 AS blank, text FROM documents),
raw AS (
  SELECT idx, 0 AS dpos, CASE WHEN idx % 2 = 0 THEN 'quality of texts' ELSE 'Quality of text' END AS name, unnest(v) AS val, generate_subscripts(v, 1) AS pos, len(v) > 1 AS multi
   FROM (SELECT idx, CASE q WHEN 0 THEN ['high'] WHEN 1 THEN ['LOW!'] WHEN 2 THEN ['bad'] WHEN 3 THEN [''] WHEN 4 THEN ['High', 'Low'] ELSE ['unsure'] END AS v FROM raw0 WHERE q <> 6)
  UNION ALL SELECT idx, 1, 'Toxic', CASE x WHEN 0 THEN 'yes it is toxic' WHEN 1 THEN 'No, it is not toxic' ELSE 'maybe' END, 1, false FROM raw0 WHERE x <> 3
  UNION ALL SELECT idx, 2, 'Tags', unnest(v), generate_subscripts(v, 1), len(v) > 1 FROM (SELECT idx, CASE t WHEN 0 THEN ['a & b'] WHEN 1 THEN ['a', 'c'] WHEN 2 THEN ['a,b & D'] WHEN 3 THEN ['z, A'] END AS v FROM raw0 WHERE t <> 4)
  UNION ALL SELECT idx, 3, 'Extra dim', 'x', 1, false FROM raw0 WHERE idx % 5 = 0)"""


def messy_items(spark, d):
    q, x, t = (h("doc_id", f"'{c}'") for c in "qxt")
    q, x, t = q % 7, x % 4, t % 5
    null = F.lit(None).cast("string")
    tags = pick(t, "a & b", F.to_json(F.array(F.lit("a"), F.lit("c"))), "a,b & D", "z, A", null)
    entries = F.array(
        F.struct(
            F.when(F.col("doc_id") % 2 == 0, "quality of texts").otherwise("Quality of text").alias("key"),
            pick(q, "high", "LOW!", "bad", "", F.to_json(F.array(F.lit("High"), F.lit("Low"))), "unsure", null).alias("value"),
        ),
        F.struct(F.lit("Toxic").alias("key"), pick(x, "yes it is toxic", "No, it is not toxic", "maybe", null).alias("value")),
        F.struct(F.lit("Tags").alias("key"), tags.alias("value")),
        F.struct(F.lit("Extra dim").alias("key"), F.when(F.col("doc_id") % 5 == 0, "x").alias("value")),
    )
    blank = F.col("doc_id") % 50 == 0
    return table(spark, d, "documents").select(
        (F.col("doc_id") % 2 + 1).alias("codebook_id"),
        F.col("doc_id").alias("idx"),
        F.when(blank, " ").otherwise(F.col("text")).alias("content"),
        F.create_map(F.lit("body"), F.col("text")).alias("metadata"),
        F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull())).alias("gold"),
    )


def schema(spark):
    """The codebook of the messy items: three dimensions, one with a no-label option."""
    book = {
        "Quality of text": ("single_label", ["High", "Low", "No label"]),
        "Toxic language": ("binary", ["Yes, it is toxic", "No, it is not toxic"]),
        "Tags": ("multi_label", ["A", "B", "C", "D", "None"]),
    }
    dims = ", ".join(
        f"({b}L, '{n}', '{kind}', '', {i}L)" for b in BOOKS for i, (n, (kind, _)) in enumerate(book.items())
    )
    labels = ", ".join(
        f"({b}L, '{n}', '{x}', {i}L)" for b in BOOKS for n, (_, xs) in book.items() for i, x in enumerate(xs)
    )
    dims = spark.sql(f"SELECT * FROM VALUES {dims} AS d(codebook_id, dim, dim_type, category_dimension, sort_order)")
    labels = spark.sql(
        f"SELECT *, CAST(array() AS array<string>) AS path FROM VALUES {labels} AS l(codebook_id, dim, label, sort_order)"
    )
    return stored(C.schema_rows(*C.gold_schema(dims, labels)), "schema")


def spec(spark):
    return A.make_spec(
        spark.sql(
            """SELECT codebook_id, 'body' AS content_from, map('toxic', 'Toxic language') AS dim_map,
              array('extra DIM') AS drop_dims, array(' & ', ',') AS splits,
              map('Quality of text', map('Bad', 'Low', 'unsure', '__drop__'), 'Tags', map('z', '__drop__')) AS label_map
            FROM VALUES (1L), (2L) AS b(codebook_id)"""
        )
    )


_LABELS = """
labs AS (SELECT * FROM (VALUES ('Quality of text', 'High', 'high'), ('Quality of text', 'Low', 'low'), ('Quality of text', 'No label', 'no label'),
  ('Toxic language', 'Yes, it is toxic', 'yes it is toxic'), ('Toxic language', 'No, it is not toxic', 'no it is not toxic'),
  ('Tags', 'A', 'a'), ('Tags', 'B', 'b'), ('Tags', 'C', 'c'), ('Tags', 'D', 'd'), ('Tags', 'None', 'none')) l(dim, label, k))"""


@query(
    "filter_gold_to_codebook",
    f"WITH {_RAW} SELECT DISTINCT idx, CASE WHEN name = 'Tags' THEN 'Tags' ELSE name END AS name FROM raw WHERE name IN ('Quality of text', 'Tags')",
)
def _filter_gold(spark, d):
    dims = spark.sql(
        """SELECT * FROM VALUES (1L, 'Quality of text', 0), (1L, 'Toxic language', 1), (1L, 'Tags', 2),
          (2L, 'Quality of text', 0), (2L, 'Toxic language', 1), (2L, 'Tags', 2) AS d(codebook_id, dim, sort_order)"""
    )
    return A.filter_gold_to_codebook(messy_items(spark, d), dims).select("idx", F.explode(F.map_keys("gold")).alias("name"))


_CANON = f"""
WITH {_RAW}, {_LABELS},
m AS (SELECT r.idx, r.dpos, r.pos, CASE r.name WHEN 'quality of texts' THEN 'Quality of text' ELSE r.name END AS dim, r.val FROM raw r WHERE r.name IN ('quality of texts', 'Quality of text', 'Tags')),
c AS (SELECT m.idx, m.dim, m.pos, coalesce(l.label, m.val) AS label FROM m LEFT JOIN labs l ON l.dim = m.dim AND l.k = {S.n1('m.val')}),
s AS (SELECT idx, dim, label, pos FROM c WHERE dim = 'Tags' OR pos = 1),
f AS (SELECT idx, dim, string_agg(label, ';' ORDER BY pos) AS labels FROM s GROUP BY ALL),
filled AS (SELECT idx, dim, CASE WHEN trim(labels) = '' THEN CASE dim WHEN 'Tags' THEN 'None' ELSE 'No label' END ELSE labels END AS labels FROM f
  UNION ALL SELECT doc_id, 'Tags', 'None' FROM documents WHERE doc_id NOT IN (SELECT idx FROM f WHERE dim = 'Tags')
  UNION ALL SELECT doc_id, 'Quality of text', 'No label' FROM documents WHERE doc_id NOT IN (SELECT idx FROM f WHERE dim = 'Quality of text'))
SELECT idx, dim, labels FROM filled"""


def _gold_rows(df):
    return df.select("idx", F.explode("gold").alias("dim", "v")).select("idx", "dim", F.array_join("v", ";").alias("labels"))


@query("canonicalize_gold", _CANON)
def canonicalize(spark, d):
    return _gold_rows(A.canonicalize(messy_items(spark, d), schema(spark)))


_TRANSFORM = f"""
WITH {_RAW}, {_LABELS},
m AS (SELECT r.idx, r.pos, CASE WHEN r.name ILIKE 'quality%' THEN 'Quality of text' WHEN r.name = 'Toxic' THEN 'Toxic language' ELSE r.name END AS dim, r.val FROM raw r WHERE r.name <> 'Extra dim'),
sp AS (SELECT idx, dim, pos * 100 AS pos, val FROM m WHERE dim <> 'Tags'
  UNION ALL SELECT idx, dim, pos * 100 + i, trim(parts[i]) FROM (SELECT idx, dim, pos, string_split(replace(val, ' & ', ','), ',') AS parts FROM m WHERE dim = 'Tags') CROSS JOIN range(1, 10) r(i) WHERE i <= len(parts) AND trim(parts[i]) <> ''),
mp AS (SELECT sp.idx, sp.dim, sp.pos, CASE WHEN sp.dim = 'Quality of text' AND {S.n1('sp.val')} = 'bad' THEN 'Low' ELSE coalesce(l.label, sp.val) END AS label FROM sp LEFT JOIN labs l ON l.dim = sp.dim AND l.k = {S.n1('sp.val')}
  WHERE NOT (sp.dim = 'Quality of text' AND {S.n1('sp.val')} = 'unsure') AND NOT (sp.dim = 'Tags' AND {S.n1('sp.val')} = 'z')),
dd AS (SELECT idx, dim, label, min(pos) AS pos FROM mp GROUP BY ALL),
one AS (SELECT * FROM dd QUALIFY dim = 'Tags' OR row_number() OVER (PARTITION BY idx, dim ORDER BY pos) = 1),
f AS (SELECT idx, dim, string_agg(label, ';' ORDER BY pos) AS labels FROM one GROUP BY ALL),
filled AS (SELECT idx, dim, CASE WHEN trim(labels) = '' THEN CASE dim WHEN 'Tags' THEN 'None' ELSE 'No label' END ELSE labels END AS labels FROM f
  UNION ALL SELECT doc_id, 'Tags', 'None' FROM documents WHERE doc_id NOT IN (SELECT idx FROM f WHERE dim = 'Tags')
  UNION ALL SELECT doc_id, 'Quality of text', 'No label' FROM documents WHERE doc_id NOT IN (SELECT idx FROM f WHERE dim = 'Quality of text')),
ov AS (SELECT idx, dim, CASE WHEN dim = 'Tags' AND idx % 37 = 0 THEN 'C' ELSE labels END AS labels FROM filled WHERE NOT (dim = 'Toxic language' AND idx % 37 = 0))
SELECT idx, dim, labels FROM ov"""


def _transformed(spark, d):
    over = table(spark, d, "documents").filter("doc_id % 37 = 0").select(
        (F.col("doc_id") % 2 + 1).alias("codebook_id"), F.col("doc_id").alias("idx"),
        F.inline(F.array(
            F.struct(F.lit("tag").alias("dimension"), F.lit("c!").alias("value")),
            F.struct(F.lit("Toxic language").alias("dimension"), F.lit("").alias("value")),
        )),
    )
    return A.apply_transform(messy_items(spark, d), schema(spark), spec(spark), over)


@query("apply_transform", _TRANSFORM)
def apply_transform(spark, d):
    rows = _gold_rows(_transformed(spark, d))
    return rows.filter(~((F.col("dim") == "Toxic language") & (F.col("labels") == "")))


@query(
    "transform_content",
    f"SELECT doc_id AS idx, md5({S.trim_('text')}) AS content FROM documents",
)
def _content(spark, d):
    return _transformed(spark, d).select("idx", F.md5("content").alias("content"))


_VALID = f"""
WITH {_RAW}, {_LABELS},
k AS (SELECT r.*, CASE WHEN name ILIKE 'quality%' THEN 'Quality of text' WHEN name = 'Tags' THEN 'Tags' END AS dim FROM raw r),
j AS (SELECT k.*, l.label AS hit FROM k LEFT JOIN labs l ON l.dim = k.dim AND l.k = {S.n1('k.val')}),
issues AS (
  SELECT doc_id AS idx, 'error' AS severity, 'missing_content' AS kind, '' AS dimension, '' AS value FROM documents WHERE doc_id % 50 = 0
  UNION ALL SELECT DISTINCT idx, 'warn', 'unknown_dimension', name, '' FROM k WHERE dim IS NULL
  UNION ALL SELECT DISTINCT idx, 'error', 'cardinality', dim, '["High","Low"]' FROM k WHERE dim = 'Quality of text' AND multi
  UNION ALL SELECT idx, 'error', 'unknown_label', dim, val FROM j WHERE dim IS NOT NULL AND hit IS NULL
  UNION ALL SELECT idx, 'error', 'unmatched_row', '', '' FROM k GROUP BY idx HAVING count(dim) = 0
  UNION ALL SELECT d.doc_id, 'warn', 'missing_dimension', x.dim, '' FROM documents d CROSS JOIN (SELECT DISTINCT dim FROM labs) x
    WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.idx = d.doc_id AND k.dim = x.dim AND trim(k.val) <> ''))"""


@query(
    "validation_report",
    _VALID
    + """
SELECT idx % 2 + 1 AS codebook_id, severity, kind, dimension, value, count(*) AS n FROM issues GROUP BY ALL
UNION ALL SELECT doc_id % 2 + 1, '', 'items', '', '', count(*) FROM documents GROUP BY 1
UNION ALL SELECT idx % 2 + 1, '', 'error_items', '', '', count(DISTINCT idx) FROM issues WHERE severity = 'error' GROUP BY 1""",
)
def validation_report(spark, d):
    return A.validation_report(messy_items(spark, d), schema(spark))


@query("validation_ok", _VALID + " SELECT idx % 2 + 1 AS codebook_id, count(*) FILTER (severity = 'error') = 0 AS ok FROM issues GROUP BY 1")
def _ok(spark, d):
    return A.validation_ok(A.validation_report(messy_items(spark, d), schema(spark)))


@query(
    "issue_samples",
    _VALID
    + f"""
, s AS (SELECT i.idx % 2 + 1 AS codebook_id, i.kind, i.dimension, i.value, {S.trim_("CASE WHEN i.idx % 50 = 0 THEN ' ' ELSE d.text END")} AS sample, min(i.idx) AS idx FROM issues i JOIN documents d ON d.doc_id = i.idx
  WHERE kind IN ('unknown_label', 'unknown_dimension', 'missing_dimension') GROUP BY ALL HAVING sample <> '')
SELECT kind, dimension, value, md5(sample) AS sample, idx FROM s QUALIFY row_number() OVER (PARTITION BY codebook_id, kind, dimension, value ORDER BY idx, sample) <= 3""",
)
def _samples(spark, d):
    out = A.issue_samples(messy_items(spark, d), schema(spark), 3)
    return out.select("kind", "dimension", "value", F.md5("sample").alias("sample"), "idx")
