"""Name keys, label comparison and answer parsing over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelworks import functions as L
from labelworks.sources.sheets import search_rows

from . import sql as S
from .relations import gold_items, h, items, pick, predictions, responses, table
from .registry import query


def _key_query(name, fn, sql_fn, source="text"):
    sql_source = "text" if source == "text" else "text || ' (rated, ' || source || ') Levels'"

    @query(name, f"SELECT doc_id, md5({sql_fn(sql_source)}) AS key_hash, length({sql_fn(sql_source)}) AS key_length FROM documents")
    def run(spark, d):
        noted = F.concat("text", F.lit(" (rated, "), "source", F.lit(") Levels"))
        k = fn(F.col("text") if source == "text" else noted)
        return table(spark, d, "documents").select(
            "doc_id", F.md5(k).alias("key_hash"), F.length(k).cast("bigint").alias("key_length")
        )


_key_query("align_key", L.align_key, S.n1)
_key_query("dimension_key", L.dimension_key, S.n2, "noted")
_key_query("agreement_key", L.agreement_key, S.n3, "noted")
_key_query("plain_key", L.plain_key, S.n4)
_key_query("gate_key", L.gate_key, S.n5, "noted")
_key_query("header_key", L.header_key, S.n6)


@query(
    "sheet_label",
    f"""
WITH cells AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN ' yes, ' || text WHEN 1 THEN 'NO ' || text
   WHEN 2 THEN regexp_extract(text, '^[a-zA-Z]*') || '-side Level' ELSE text END AS cell FROM conversations),
t AS (SELECT *, {S.trim_('cell')} AS s FROM cells)
SELECT conv_id, turn,
  CASE WHEN lower(s) LIKE 'yes%' THEN 'Yes' WHEN lower(s) LIKE 'no%' THEN 'No'
       WHEN lower(s) LIKE '% layer' OR lower(s) LIKE '% level' THEN
         array_to_string(list_transform(string_split(left(s, length(s) - 6), '-'),
           lambda w: upper(left(w, 1)) || lower(substr(w, 2))), '-')
       ELSE s END AS label
FROM t""",
)
def _sheet_label(spark, d):
    c = table(spark, d, "conversations")
    cell = pick(
        F.col("turn") % 4,
        F.concat(F.lit(" yes, "), "text"),
        F.concat(F.lit("NO "), "text"),
        F.concat(F.regexp_extract("text", "^[a-zA-Z]*", 0), F.lit("-side Level")),
        F.col("text"),
    )
    return c.select("conv_id", "turn", L.sheet_label(cell).alias("label"))


@query(
    "first_word",
    f"""SELECT doc_id, CASE WHEN {S.trim_('text')} <> '' THEN
    regexp_extract({S.trim_('text')}, '^[^\\s\\x0b\\x1c-\\x1f\\x85\\p{{Z}}]+') END AS word FROM documents""",
)
def _first_word(spark, d):
    return table(spark, d, "documents").select("doc_id", L.first_word(F.col("text")).alias("word"))


# ---- gold lookup and comparison --------------------------------------------------------------


@query(
    "label_for_dimension",
    S.with_(
        "gold",
        """
SELECT item_id, string_agg(label, ',' ORDER BY pos) AS labels, count(*) AS n
FROM gold WHERE dimension = 'Quality of text (rated)' GROUP BY item_id""",
    ),
)
def _label_for(spark, d):
    found = L.gold_values(L.label_for(F.col("gold"), "quality OF text"))
    return gold_items(spark, d).select(
        "item_id", F.array_join(found, ",").alias("labels"), F.size(found).cast("bigint").alias("n")
    )


@query(
    "embedded_label_cells",
    """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k,
  event_id % 3 <> 0 AS has_labels
FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE props END AS props FROM events)""",
)
def _embedded(spark, d):
    cell = F.when(F.col("event_id") % 3 == 0, F.concat("props", F.lit("x"))).otherwise(F.col("props"))
    m = L.embedded_labels(F.lit(""), cell)
    return table(spark, d, "events").select(
        "event_id", F.try_element_at(m, F.lit("k")).alias("k"), (F.size(m) > 0).alias("has_labels")
    )


@query(
    "gold_from_metadata",
    f"""
SELECT doc_id AS item_id,
  CASE WHEN doc_id % 5 <> 0 THEN '' ELSE
    CASE {S.h("doc_id||'|ml'")} % 3 WHEN 0 THEN 'High' WHEN 1 THEN 'Low' ELSE '' END END AS label
FROM documents""",
)
def _gold_meta(spark, d):
    return items(spark, d).select(
        "item_id", L.gold_from_metadata(F.col("metadata"), "Quality of text (rated)").alias("label")
    )


@query(
    "display_text",
    f"""
SELECT doc_id AS item_id, md5(CASE WHEN doc_id % 5 = 0 AND {S.trim_('left(text, 30)')} <> ''
  THEN {S.trim_('left(text, 30)')} ELSE text END) AS shown FROM documents""",
)
def _display(spark, d):
    return items(spark, d).select(
        "item_id", F.md5(L.display_text(F.col("metadata"), F.col("content"))).alias("shown")
    )


@query(
    "labels_agree",
    S.with_(
        "gold pred",
        f"""
SELECT p.item_id, p.step_order, g.pos, {S.agree('p.label', 'g.label')} AS agrees
FROM pred p JOIN gold g ON p.item_id = g.item_id AND {S.n2('p.dimension')} = {S.n2('g.dimension')}""",
    ),
)
def _agree(spark, d):
    rows = predictions(spark, d).join(gold_items(spark, d), "item_id")
    gold = L.gold_values(L.label_for(F.col("gold"), F.col("dimension")))
    return rows.select("item_id", "step_order", "label", F.posexplode(gold).alias("pos", "g")).select(
        "item_id", "step_order", "pos", L.labels_agree(F.col("label"), F.col("g")).alias("agrees")
    )


_STATUS = f"""
SELECT p.item_id, p.step_order,
  CASE WHEN count(g.label) = 0 THEN 'missing'
       WHEN bool_or({S.agree('p.label', 'g.label')}) THEN CASE WHEN bool_or(g.is_list) THEN 'partial' ELSE 'match' END
       ELSE 'mismatch' END AS status,
  CASE WHEN bool_or({S.agree('p.label', 'g.label')}) THEN any_value(p.label)
       ELSE coalesce(min_by(g.label, g.pos), '') END AS target
FROM pred p LEFT JOIN gold g ON p.item_id = g.item_id AND {S.n2('p.dimension')} = {S.n2('g.dimension')}
GROUP BY p.item_id, p.step_order"""


def _compared(spark, d):
    rows = predictions(spark, d).join(gold_items(spark, d), "item_id", "left")
    raw = L.label_for(F.coalesce("gold", F.create_map().cast("map<string,string>")), F.col("dimension"))
    return rows.withColumn("raw", raw).withColumn("vals", L.gold_values(F.col("raw")))


@query("match_status", f"SELECT item_id, step_order, status FROM ({S.with_('gold pred', _STATUS)})")
def _status(spark, d):
    rows = _compared(spark, d)
    return rows.select(
        "item_id",
        "step_order",
        L.match_status(F.col("label"), F.col("vals"), L.is_gold_list(F.col("raw"))).alias("status"),
    )


@query("metric_target", f"SELECT item_id, step_order, target FROM ({S.with_('gold pred', _STATUS)})")
def _target(spark, d):
    return _compared(spark, d).select(
        "item_id", "step_order", L.metric_target(F.col("label"), F.col("vals")).alias("target")
    )


# ---- answers ---------------------------------------------------------------------------------

OPTIONS = ["High", "Low", "No label"]
YES_NO = ["Yes, it is", "No, it is not"]
_W, _NW = r"[\p{L}\p{N}_]", r"[^\p{L}\p{N}_]"


def _last(text: str, word: str) -> str:
    """Start of the last whole word in SQL, -1 when absent."""
    pat = f"(?is)^((?:.*{_NW})?){word}(?:{_NW}|$)"
    return (
        f"CASE WHEN regexp_matches({text}, '{pat}') THEN length(regexp_extract({text}, '{pat}', 1)) ELSE -1 END"
    )


_NO_LABEL = (
    "('no label','none','n/a','na','not applicable','not apply','does not apply','no applicable label','no labels')"
)


def _clean(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9/ ]+', ' ', 'g'), ' +', ' ', 'g'))"


_ANSWER = f"""
ans0 AS (SELECT item_id, response, regexp_extract_all(response, '(?i)answer[:\\s]+([^\\n]+)', 1) AS hits FROM responses),
ans AS (SELECT item_id, response, CASE WHEN len(hits) > 0 THEN
   regexp_replace({S.trim_('hits[len(hits)]')}, '\\.+$', '') END AS answer FROM ans0)"""


def _from_text(text: str) -> str:
    return f"""(SELECT max_by(label, at * 10 - i) FROM (VALUES
      ('High', {_last(text, 'High')}, 0), ('Low', {_last(text, 'Low')}, 1), ('No label', {_last(text, 'No label')}, 2)) v(label, at, i)
      WHERE at >= 0)"""


_PARSED = f"""
WITH {_ANSWER},
one AS (SELECT item_id, response, answer,
  CASE WHEN {_clean('answer')} IN {_NO_LABEL} THEN 'No label'
       WHEN lower(answer) = 'high' THEN 'High' WHEN lower(answer) = 'low' THEN 'Low'
       WHEN lower(answer) = 'no label' THEN 'No label'
       WHEN {_last('answer', 'High')} >= 0 THEN 'High' WHEN {_last('answer', 'Low')} >= 0 THEN 'Low'
       WHEN {_last('answer', 'No label')} >= 0 THEN 'No label' END AS first_try,
  {_last('response', 'High')} AS p0, {_last('response', 'Low')} AS p1, {_last('response', 'No label')} AS p2 FROM ans),
two AS (SELECT *, CASE WHEN greatest(p0, p1, p2) < 0 THEN NULL WHEN p0 >= p1 AND p0 >= p2 THEN 'High'
   WHEN p1 >= p2 THEN 'Low' ELSE 'No label' END AS last_named FROM one)"""


@query(
    "parse_answer",
    S.with_(
        "responses",
        _PARSED
        + f"""
SELECT item_id, md5(coalesce(CASE WHEN answer IS NOT NULL THEN first_try END, last_named,
   {S.trim_("CASE WHEN coalesce(answer,'') <> '' THEN answer ELSE response END")})) AS label_hash,
   coalesce(CASE WHEN answer IS NOT NULL THEN first_try END, last_named, 'other') AS label
FROM two""",
    ),
)
def _parse(spark, d):
    got = L.parse_answer(F.col("response"), OPTIONS, False)
    return responses(spark, d).select("item_id", got.alias("got")).select(
        "item_id",
        F.md5("got").alias("label_hash"),
        F.when(F.col("got").isin(OPTIONS), F.col("got")).otherwise("other").alias("label"),
    )


@query("last_label_in_text", S.with_("responses", _PARSED + " SELECT item_id, last_named AS label FROM two"))
def _last_label(spark, d):
    return responses(spark, d).select("item_id", L.last_label_in(F.col("response"), OPTIONS).alias("label"))


@query(
    "yes_no_answer",
    S.with_(
        "responses",
        f"""
WITH spots AS (SELECT item_id, {_last('response', 'yes')} AS y, {_last('response', 'no')} AS n FROM responses)
SELECT item_id, CASE WHEN y < 0 AND n < 0 THEN NULL WHEN y > n THEN 'Yes, it is' ELSE 'No, it is not' END AS label
FROM spots""",
    ),
)
def _yes_no(spark, d):
    return responses(spark, d).select("item_id", L.yes_no(F.col("response"), YES_NO).alias("label"))


@query(
    "no_label_phrases",
    S.with_("responses", f"WITH {_ANSWER} SELECT item_id, coalesce({_clean('answer')} IN {_NO_LABEL}, false) AS no_label FROM ans"),
)
def _no_label(spark, d):
    from labelworks.functions.answers import answer_line

    return responses(spark, d).select(
        "item_id", F.coalesce(L.is_no_label(answer_line(F.col("response"))), F.lit(False)).alias("no_label")
    )


# raw coder values built from words of the texts, so that every matching rule is met
_VALUES_SQL = f"""
vals AS (SELECT doc_id AS item_id, CASE {S.h("doc_id||'|v'")} % 7 WHEN 0 THEN 'central LAYER' WHEN 1 THEN 'Emotional'
  WHEN 2 THEN 'the functional support, of course' WHEN 3 THEN 'Core' WHEN 4 THEN ' - ' WHEN 5 THEN 'support'
  ELSE text END AS value FROM documents),
opts AS (SELECT * FROM (VALUES ('Central', 0), ('Emotional support', 1), ('Functional support', 2), ('Core', 3), ('Core support', 4)) o(label, i)),
keyed AS (SELECT v.item_id, v.value, o.label, o.i, {S.n4('v.value')} AS vk, {S.n4('o.label')} AS lk FROM vals v CROSS JOIN opts o),
ranked AS (SELECT *, CASE WHEN vk = lk THEN 0
    WHEN list_has_all({S.toks('vk')}, {S.toks('lk')}) THEN 1
    WHEN len({S.toks('vk')}) > 0 AND list_has_all({S.toks('lk')}, {S.toks('vk')}) THEN 2 END AS rule,
    len({S.toks('lk')}) AS n FROM keyed),
matched AS (SELECT item_id, any_value(value) AS value,
    min_by(label, rule * 1000 + CASE rule WHEN 1 THEN -n * 10 WHEN 2 THEN n * 10 ELSE 0 END + i) FILTER (rule IS NOT NULL) AS label
  FROM ranked GROUP BY item_id)"""
VALUE_OPTIONS = ["Central", "Emotional support", "Functional support", "Core", "Core support"]


def _values(spark, d):
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("item_id"),
        pick(
            h("doc_id", "'v'") % 7, "central LAYER", "Emotional", "the functional support, of course", "Core", " - ",
            "support", F.col("text"),
        ).alias("value"),
    )


@query("match_label", f"WITH {_VALUES_SQL} SELECT item_id, label FROM matched")
def _match(spark, d):
    return _values(spark, d).select("item_id", L.match_label(F.col("value"), VALUE_OPTIONS).alias("label"))


@query(
    "parse_label_set",
    f"""
WITH {_VALUES_SQL},
texts AS (SELECT item_id, value || CASE WHEN item_id % 2 = 0 THEN ' | core support' || chr(10) || 'central' ELSE ', emotional support' END AS response FROM vals),
parts AS (SELECT item_id, response, unnest(regexp_split_to_array(response, '[|\\n]')) AS part FROM texts),
pk AS (SELECT p.item_id, p.part, o.label, o.i, {S.n4('p.part')} AS vk, {S.n4('o.label')} AS lk FROM parts p CROSS JOIN opts o),
pr AS (SELECT *, CASE WHEN vk = lk THEN 0 WHEN list_has_all({S.toks('vk')}, {S.toks('lk')}) THEN 1
   WHEN len({S.toks('vk')}) > 0 AND list_has_all({S.toks('lk')}, {S.toks('vk')}) THEN 2 END AS rule, len({S.toks('lk')}) AS n FROM pk),
pm AS (SELECT item_id, part, min_by(label, rule * 1000 + CASE rule WHEN 1 THEN -n * 10 WHEN 2 THEN n * 10 ELSE 0 END + i) FILTER (rule IS NOT NULL) AS label
  FROM pr GROUP BY item_id, part),
hits AS (SELECT item_id, label FROM pm WHERE label IS NOT NULL
  UNION SELECT t.item_id, o.label FROM texts t CROSS JOIN opts o WHERE contains({S.n4('t.response')}, {S.n4('o.label')}))
SELECT t.item_id, coalesce((SELECT string_agg(o.label, ';' ORDER BY o.i) FROM hits x JOIN opts o ON x.label = o.label WHERE x.item_id = t.item_id), '') AS labels
FROM texts t""",
)
def _label_set(spark, d):
    tail = F.when(F.col("item_id") % 2 == 0, " | core support\ncentral").otherwise(", emotional support")
    got = L.parse_label_set(F.concat("value", tail), VALUE_OPTIONS)
    return _values(spark, d).select("item_id", F.array_join(got, ";").alias("labels"))


@query(
    "canonical_labels",
    f"""
WITH {_VALUES_SQL}
SELECT v.item_id, coalesce((SELECT o.label FROM opts o WHERE {S.n4('o.label')} = {S.n4('v.value')}), '') AS first_label,
  (SELECT count(DISTINCT o.label) FROM opts o WHERE {S.n4('o.label')} IN ({S.n4('v.value')}, 'core')) AS n
FROM vals v""",
)
def _canonical(spark, d):
    got = L.canonical_labels(F.array(F.col("value"), F.lit("CORE!"), F.lit("nothing")), VALUE_OPTIONS)
    alone = L.canonical_labels(F.array("value"), VALUE_OPTIONS)
    return _values(spark, d).select(
        "item_id",
        F.coalesce(F.get(alone, F.lit(0)), F.lit("")).alias("first_label"),
        F.size(got).cast("bigint").alias("n"),
    )


@query(
    "gold_label_set",
    S.with_(
        "gold",
        """
SELECT item_id, string_agg(DISTINCT label, ';' ORDER BY label) AS labels
FROM gold WHERE dimension = 'Quality of text (rated)' GROUP BY item_id""",
    ),
)
def _gold_set(spark, d):
    got = L.gold_set(F.col("gold"), "quality of text, rated", ["High", "Low"])
    return gold_items(spark, d).select("item_id", F.array_join(got, ";").alias("labels"))


@query(
    "parse_score",
    """
SELECT event_id, coalesce(TRY_CAST(nullif(regexp_extract(props || ' v=' || value, '[01](?:\\.[0-9]+)?'), '') AS DOUBLE), 0.5) AS score
FROM (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'none' ELSE props END AS props,
      CASE WHEN event_id % 4 = 0 THEN 'x' ELSE CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) END AS value FROM events)""",
)
def _score(spark, d):
    skip = F.col("event_id") % 4 == 0
    text = F.concat(
        F.when(skip, "none").otherwise(F.col("props")), F.lit(" v="),
        F.when(skip, "x").otherwise(F.floor("value").cast("string")),
    )
    return table(spark, d, "events").select("event_id", L.parse_score(text).alias("score"))


@query(
    "json_payloads",
    """
SELECT event_id,
  CASE event_id % 6 WHEN 0 THEN props WHEN 1 THEN props WHEN 2 THEN props ELSE NULL END AS object_text,
  CASE event_id % 6 WHEN 3 THEN '[' || props || ']' WHEN 4 THEN '[' || props || ']' ELSE NULL END AS array_text
FROM events""",
)
def _payload(spark, d):
    p = F.col("props")
    raw = pick(
        F.col("event_id") % 6,
        p,
        F.concat(F.lit("```json\n"), p, F.lit("\n```")),
        F.concat(F.lit("Here it is: "), p, F.lit(" as asked.")),
        F.concat(F.lit("```\n["), p, F.lit("]\n```")),
        F.concat(F.lit("Rules: ["), p, F.lit(", {\"id\": \"cut o")),
        F.lit("nothing {to read"),
    )
    rows = table(spark, d, "events").withColumn("raw", raw)
    is_array = F.col("event_id") % 6 >= 3
    return rows.select(
        "event_id",
        F.when(~is_array, L.json_object_payload(F.col("raw"))).alias("object_text"),
        L.json_array_payload(F.col("raw")).alias("array_text"),
    )


@query(
    "model_input",
    S.with_(
        "pred",
        """
SELECT d.doc_id AS item_id, md5(CASE WHEN d.doc_id % 3 = 0 THEN 'Context: ' || d.lang || chr(10) || chr(10) ELSE '' END
  || 'Sentence: ' || d.text || CASE WHEN p.label <> '' THEN chr(10) || chr(10) || 'Already determined: Quality = ' || p.label || '.' ELSE '' END) AS input_hash
FROM documents d JOIN pred p ON p.item_id = d.doc_id AND p.step_order = 0""",
    ),
)
def _model_input(spark, d):
    rows = items(spark, d).join(predictions(spark, d).filter("step_order = 0").select("item_id", "label"), "item_id")
    text = L.model_input(F.col("content"), F.col("context"), [("Quality", F.col("label"))])
    return rows.select("item_id", F.md5(text).alias("input_hash"))


@query(
    "rough_tokens",
    "SELECT doc_id, greatest(1, round_even(length(text) / 5.0::DOUBLE, 0))::BIGINT AS tokens FROM documents",
)
def _tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", L.rough_tokens(F.col("text")).alias("tokens"))


@query(
    "search_rows",
    f"""
SELECT conv_id, turn, c AS "column", left({S.trim_('cell')}, 200) AS hit FROM (
  SELECT conv_id, turn, 0 AS i, 'role' AS c, role AS cell FROM conversations
  UNION ALL SELECT conv_id, turn, 1, 'text', text FROM conversations)
WHERE contains(lower(cell), 'the') ORDER BY conv_id, turn, i LIMIT 10""",
)
def _search(spark, d):
    return search_rows(table(spark, d, "conversations"), "The", ["role", "text"], ["conv_id", "turn"], 10)


@query(
    "binary_options",
    S.with_(
        "book",
        """
SELECT codebook_id, dim, count(*) = 2 AND bool_or(contains(lower(label), 'yes')) AS is_binary FROM book GROUP BY codebook_id, dim""",
    ),
)
def _is_binary(spark, d):
    from .relations import book_labels

    opts = book_labels(spark, d).groupBy("codebook_id", "dim").agg(F.collect_list("label").alias("o"))
    return opts.select("codebook_id", "dim", L.is_binary(F.col("o")).alias("is_binary"))
