"""Coder sheets, item files and columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelworks.scratch import new_path
from labelworks.sources import sheets as H

from . import sql as S
from .registry import query, rounded
from .relations import pick, sheet, table

CHUNK = 4  # positions per chunk: small, so that the carry between chunks is met in tests


@query(
    "fill_down",
    S.with_(
        "sheet",
        """
SELECT conv_id, turn, last_value(nullif(theme, '') IGNORE NULLS) OVER w AS theme, last_value(nullif(topic, '') IGNORE NULLS) OVER w AS topic,
  level FROM sheet WHERE theme <> '' OR topic <> '' WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)""",
    ),
)
def _fill(spark, d):
    rows = sheet(spark, d).select("conv_id", "turn", "theme", "topic", "level")
    return H.fill_down(rows, ["theme", "topic"], ["conv_id"], "turn", CHUNK)


@query(
    "fill_down_nested",
    S.with_(
        "sheet",
        """
WITH r AS (SELECT conv_id, turn, nullif(theme, '') AS a, nullif(topic, '') AS b, nullif(behavior, '') AS c FROM sheet WHERE theme <> '' OR topic <> '' OR behavior <> ''),
g AS (SELECT *, count(a) OVER w AS ga, count(coalesce(a, b)) OVER w AS gb FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING))
SELECT conv_id, turn, last_value(a IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS theme,
  last_value(b IGNORE NULLS) OVER (PARTITION BY conv_id, ga ORDER BY turn ROWS UNBOUNDED PRECEDING) AS topic,
  last_value(c IGNORE NULLS) OVER (PARTITION BY conv_id, gb ORDER BY turn ROWS UNBOUNDED PRECEDING) AS behavior FROM g""",
    ),
)
def _fill_nested(spark, d):
    rows = sheet(spark, d).select("conv_id", "turn", "theme", "topic", "behavior")
    return H.fill_down_nested(rows, ["theme", "topic", "behavior"], ["conv_id"], "turn", CHUNK)


_QUOTES = f"""
q0 AS (SELECT *, {S.trim_('quote')} AS t FROM sheet),
q1 AS (SELECT *, CASE WHEN length(t) >= 2 AND t LIKE '"%' AND t LIKE '%"' THEN {S.trim_('substr(t, 2, length(t) - 2)')} ELSE t END AS content FROM q0),
q AS (SELECT * FROM q1 WHERE content <> ''),
firsts AS (SELECT conv_id, content, min(turn) AS first_turn FROM q GROUP BY ALL),
items AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY first_turn) - 1 AS idx FROM firsts)"""


@query(
    "collapse_coder_rows",
    S.with_(
        "sheet",
        f"""
WITH {_QUOTES},
lv AS (SELECT conv_id, content, theme, level, min(turn) AS first_at FROM q WHERE theme <> '' AND level <> '' GROUP BY ALL),
th AS (SELECT conv_id, content, theme AS dimension, CASE WHEN count(*) = 1 THEN min(level) ELSE '[' || string_agg('"' || level || '"', ',' ORDER BY first_at) || ']' END AS value FROM lv GROUP BY ALL),
tp AS (SELECT conv_id, content, 'Topic' AS dimension, min_by(topic, turn) AS value FROM q WHERE topic <> '' GROUP BY ALL)
SELECT i.conv_id, i.idx, md5(i.content) AS content_hash, g.dimension, g.value, f.role
FROM items i JOIN (SELECT * FROM th UNION ALL SELECT * FROM tp) g USING (conv_id, content) JOIN sheet f ON f.conv_id = i.conv_id AND f.turn = i.first_turn""",
    ),
)
def collapse(spark, d):
    out = H.collapse_coder_rows(sheet(spark, d), ["conv_id"], "turn", CHUNK)
    return out.select(
        "conv_id", "idx", F.md5("content").alias("content_hash"), F.col("metadata")["role"].alias("role"),
        F.explode("gold").alias("dimension", "value"),
    )


@query(
    "annotation_records",
    S.with_(
        "sheet",
        f"""
WITH f AS (SELECT conv_id, turn, last_value(nullif({S.trim_('quote')}, '') IGNORE NULLS) OVER w AS sentence, last_value(nullif(theme, '') IGNORE NULLS) OVER w AS theme,
   level, last_value(nullif(topic, '') IGNORE NULLS) OVER w AS topic, last_value(nullif(behavior, '') IGNORE NULLS) OVER w AS beh,
   row_number() OVER w AS row_id FROM sheet WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING))
SELECT conv_id, row_id, md5(sentence) AS sentence, CASE WHEN beh = 'AI behavior' THEN 'ai' WHEN beh LIKE 'Self%' THEN 'user' END AS side,
  CASE WHEN theme IS NOT NULL THEN theme || '=' || CASE WHEN level LIKE '% & Upper level' THEN '["' || split_part(level, ' & ', 1) || '","Upper"]' ELSE level END END AS themed,
  topic FROM f WHERE sentence IS NOT NULL""",
    ),
)
def _records(spark, d):
    out = H.annotation_records(
        sheet(spark, d), ["conv_id"], "turn", CHUNK, topic="topic", behavior="behavior"
    )
    other = F.filter(F.map_entries("annotations"), lambda e: e["key"] != "Topic")
    first = F.get(other, F.lit(0))
    return out.select(
        "conv_id", "row_id", F.md5("sentence").alias("sentence"), "side",
        F.concat(first["key"], F.lit("="), first["value"]).alias("themed"),
        F.try_element_at("annotations", F.lit("Topic")).alias("topic"),
    )


def _dims(spark, d):
    themes = sheet(spark, d).select("theme").filter("theme like '%0' or theme like '%1'").distinct()
    return themes.select(F.concat(F.upper("theme"), F.lit("!")).alias("dim"))


_REASON = f"""
r AS (SELECT *, CASE WHEN behavior <> '' AND behavior <> 'AI behavior' THEN 'other_behavior' WHEN {S.trim_('quote')} = '' THEN 'no_quote'
   WHEN NOT (theme LIKE '%0' OR theme LIKE '%1') THEN 'unmapped_dimension' END AS reason FROM sheet)"""


@query("clean_sheet_reasons", S.with_("sheet", f"WITH {_REASON} SELECT reason, count(*) AS n FROM r GROUP BY reason"))
def _reasons(spark, d):
    return H.clean_coder_sheet(sheet(spark, d), _dims(spark, d), "ai BEHAVIOR")[1]


@query(
    "clean_sheet_labels",
    S.with_(
        "sheet",
        f"""WITH {_REASON}, l AS (SELECT DISTINCT {S.trim_('quote')} AS quote, upper(theme) || '!' AS dim, trim(unnest(string_split(level, '&'))) AS label FROM r WHERE reason IS NULL)
SELECT md5(quote) AS quote, dim, string_agg(label, '|' ORDER BY label) AS labels FROM l WHERE label <> '' GROUP BY quote, dim""",
    ),
)
def _clean(spark, d):
    out = H.clean_coder_sheet(sheet(spark, d), _dims(spark, d), "ai BEHAVIOR")[0]
    return out.select(F.md5("quote").alias("quote"), "dim", F.array_join("labels", "|").alias("labels"))


@query(
    "read_coder_csv",
    S.with_("sheet", "SELECT conv_id::VARCHAR AS conv_id, turn::VARCHAR AS turn, md5(quote) AS quote, level AS level_1, theme FROM sheet"),
)
def _read_csv(spark, d):
    """Writes the sheet as CSV files with a repeated header name and reads them back."""
    path = new_path(spark, "coder-sheet")
    s = sheet(spark, d).select("conv_id", "turn", "quote", "theme", F.col("role").alias("level"), F.col("level").alias("last"))
    s.write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    out = H.read_coder_csv(spark, path)
    return out.select("conv_id", "turn", F.md5("quote").alias("quote"), F.col("last").alias("level_1"), "theme")


@query(
    "items_from_json",
    f"""
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx, md5(text) AS content,
   CASE WHEN conv_id % 7 = 6 THEN '' ELSE role END AS context, CASE WHEN conv_id % 7 = 6 THEN NULL ELSE 'lab' || turn % 3 END AS theme FROM conversations""",
)
def _items_json(spark, d):
    """Every conversation becomes one JSON document: a list, or an object with a list inside."""
    c = table(spark, d, "conversations")
    item = F.struct(
        F.col("turn").alias("turn"), F.col("text"), F.col("role").alias("context"),
        F.struct(F.concat(F.lit("lab"), (F.col("turn") % 3).cast("string")).alias("Theme")).alias("labels"),
    )
    docs = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("x"))
    rows = F.to_json("x")
    plain = F.to_json(F.transform("x", lambda i: i["text"]))
    which = F.col("conv_id") % 7
    body = pick(
        which, rows, *[F.concat(F.lit('{"n": 1, "' + k + '": '), rows, F.lit("}")) for k in H.ITEM_LIST_KEYS], plain
    )
    out = H.parse_items(docs.select(F.col("conv_id").alias("file"), body.alias("value")))
    return out.select(
        F.col("file").alias("conv_id"), "idx", F.md5("content").alias("content"), "context",
        F.try_element_at("gold", F.lit("Theme")).alias("theme"),
    )


@query(
    "items_from_csv",
    S.with_(
        "sheet",
        f"""
WITH q AS (SELECT *, {S.trim_("conv_id || ' ' || quote")} AS content FROM sheet WHERE quote <> ''),
firsts AS (SELECT conv_id, content, min(turn) AS turn FROM q GROUP BY ALL),
lv AS (SELECT conv_id, content, theme, level, min(turn) AS first_at FROM q WHERE theme <> '' AND level <> '' GROUP BY ALL),
th AS (SELECT conv_id, content, theme AS dimension, CASE WHEN count(*) = 1 THEN min(level) ELSE '[' || string_agg('"' || level || '"', ',' ORDER BY first_at) || ']' END AS value FROM lv GROUP BY ALL),
tp AS (SELECT conv_id, content, 'Topic' AS dimension, min_by(topic, turn) AS value FROM q WHERE topic <> '' GROUP BY ALL),
g AS (SELECT conv_id, content, string_agg(dimension || '=' || value, ';' ORDER BY dimension) AS gold FROM (SELECT * FROM th UNION ALL SELECT * FROM tp) GROUP BY ALL)
SELECT 'sheet' AS layout, f.conv_id::VARCHAR AS conv_id, f.turn::VARCHAR AS turn, row_number() OVER (PARTITION BY f.conv_id ORDER BY f.turn) - 1 AS idx,
   md5(f.content) AS content, '' AS context, coalesce(g.gold, '') AS gold FROM firsts f LEFT JOIN g USING (conv_id, content)
UNION ALL SELECT 'plain', conv_id::VARCHAR, turn::VARCHAR, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1, md5(text), role,
   CASE turn % 3 WHEN 0 THEN 'Theme=lab' || conv_id % 5 WHEN 1 THEN '' ELSE 'Late=yes' END FROM conversations""",
    ),
)
def _items_csv(spark, d):
    """Writes all conversations as coder sheets and as plain items, and reads both back from one folder."""
    path = new_path(spark, "items-csv")
    s = sheet(spark, d)
    marked = F.concat(F.col("conv_id").cast("string"), F.lit(" "), "quote")
    quoted = F.when(F.col("turn") % 2 == 0, F.concat(F.lit('"'), marked, F.lit('"'))).otherwise(marked)
    coder = s.select(
        "role", F.col("level").alias("Label"), F.when(F.col("quote") != "", quoted).otherwise("").alias("Relevant quotes"),
        F.col("theme").alias("Coding theme"), F.col("topic").alias("Topic"), "turn", "conv_id",
    )
    lab = F.concat(F.lit('{"Theme": "lab'), (F.col("conv_id") % 5).cast("string"), F.lit('"}'))
    plain = table(spark, d, "conversations").select(
        "conv_id", F.col("role").alias("context"), pick(F.col("turn") % 3, lab, "[not an object]", "").alias("gold_labels"),
        "turn", F.when(F.col("turn") % 3 == 2, '{"Late": "yes"}').otherwise("").alias("labels"), "text",
    )
    for name, rows in (("sheet", coder), ("plain", plain)):
        whole = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn")
        whole.write.option("header", True).option("escape", '"').option("quoteAll", True).csv(f"{path}/{name}")
    out = H.read_items_csv(spark, f"{path}/*")
    layout = F.regexp_extract("file", "/(sheet|plain)/[^/]*$", 1)
    gold = F.transform(F.map_entries("gold"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    rows = out.select(
        layout.alias("layout"), F.col("metadata")["conv_id"].alias("conv_id"), F.col("metadata")["turn"].alias("turn"),
        "idx", F.md5("content").alias("content"), "context", F.array_join(F.array_sort(gold), ";").alias("gold"),
    )
    first = rows.groupBy("layout", "conv_id").agg(F.min("idx").alias("first"))
    return rows.join(first, ["layout", "conv_id"]).withColumn("idx", F.col("idx") - F.col("first")).drop("first")


@query(
    "text_lengths",
    """
SELECT 'lang' AS "column", 0 AS position, round(avg(length(lang)), 6) AS mean_length FROM documents UNION ALL
SELECT 'source', 1, round(avg(length(source)), 6) FROM documents UNION ALL SELECT 'text', 2, round(avg(length(text)), 6) FROM documents""",
)
def _lengths(spark, d):
    return rounded(H.text_lengths(table(spark, d, "documents"), ["lang", "source", "text"]), "mean_length")


@query("items_of_table", "SELECT doc_id AS idx, md5(text) AS content, lang AS context, source FROM documents")
def _to_items(spark, d):
    docs = table(spark, d, "documents").select(
        "doc_id", F.concat(F.lit("  "), "text", F.lit("\n")).alias("text"), "lang", "source"
    )
    content = H.pick_content_column(docs.select("lang", "source", "text"))
    out = H.to_items(docs, content, "lang", "doc_id")
    return out.select("idx", F.md5("content").alias("content"), "context", F.col("metadata")["source"].alias("source"))


@query("preview", "SELECT doc_id AS ord, lang, NULL::VARCHAR AS role FROM documents UNION ALL SELECT conv_id * 1000 + turn + 1000000000, NULL, role FROM conversations ORDER BY ord LIMIT 5")
def _preview(spark, d):
    a = table(spark, d, "documents").select(F.col("doc_id").alias("ord"), "lang")
    b = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn") + 1_000_000_000).alias("ord"), "role")
    return H.preview([a, b], "ord")[2]


@query("profile_column", S.with_("sheet", "SELECT level AS value, count(*) AS n FROM sheet GROUP BY level ORDER BY n DESC, value LIMIT 5"))
def _profile(spark, d):
    return H.profile_column(sheet(spark, d), "level", 5)[0]


@query("profile_totals", S.with_("sheet", "SELECT count(DISTINCT level) AS n_distinct, count(*) FILTER (level LIKE '% & %' OR level LIKE '%,%') AS n_with_separator FROM sheet"))
def _totals(spark, d):
    return H.profile_column(sheet(spark, d), "level", 5)[1]


@query("multi_value_columns", S.with_("sheet", "SELECT 'level' AS \"column\", bool_or(level LIKE '% & %') AS multi FROM sheet UNION ALL SELECT 'theme', bool_or(theme LIKE '% & %') FROM sheet"))
def _multi(spark, d):
    return H.multi_value_columns(sheet(spark, d), ["level", "theme"])

