"""SQL text for the relations and keys that the checks share (DuckDB dialect).

Written from the definitions, not from the Spark plans: names are matched with SQL joins, sets with
unnested rows.
"""

from __future__ import annotations

SPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"


def h(key: str) -> str:
    return f"('0x'||substr(md5({key}),1,8))::BIGINT"


def trim_(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def fold(x: str) -> str:
    return f"replace(replace(lower({x}), 'ſ', 's'), 'ß', 'ss')"


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '[^0-9a-zA-Z]+', ' ', 'g'))"


def toks(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda t: t <> '')"


def joined(x: str) -> str:
    return f"array_to_string({x}, ' ')"


def n1(x: str) -> str:
    stem = (
        "CASE WHEN length(t) > 4 AND t LIKE '%ies' THEN left(t, length(t)-3) || 'y' "
        "WHEN length(t) > 3 AND t LIKE '%s' AND t NOT LIKE '%ss' THEN left(t, length(t)-1) ELSE t END"
    )
    return joined(f"list_transform({toks(squeeze(fold(x)))}, lambda t: {stem})")


def n2(x: str) -> str:
    no_paren = f"regexp_replace({x}, '\\([^)]*\\)', ' ', 'g')"
    return f"lower({squeeze(no_paren)})"


def n3(x: str) -> str:
    words = "('layer', 'level', 'label', 'category')"
    return joined(f"list_filter({toks(squeeze(fold(x)))}, lambda t: t NOT IN {words})")


def n4(x: str) -> str:
    return f"lower({squeeze(x)})"


def n5(x: str) -> str:
    cut = "CASE WHEN t LIKE '%s' AND length(t) > 1 THEN left(t, length(t)-1) ELSE t END"
    return joined(f"list_transform({toks(squeeze(fold(x)))}, lambda t: {cut})")


def n6(x: str) -> str:
    return f"replace(lower({trim_(x)}), '_', ' ')"


def agree(p: str, g: str) -> str:
    return f"({p} <> '' AND {g} <> '' AND {n3(p)} = {n3(g)})"


# ---- relations -------------------------------------------------------------------------------

CTES: dict[str, str] = {}

CTES["gold"] = f"""
gold0 AS (SELECT doc_id AS item_id, quality, toxic, {h("doc_id||'|multi'")} % 10 = 0 AS multi FROM labels),
gold AS (
  SELECT item_id, 'Quality of text (rated)' AS dimension, 0 AS pos, multi AS is_list,
         CASE quality WHEN 1 THEN 'High' ELSE 'Low' END AS label FROM gold0
  UNION ALL
  SELECT item_id, 'Quality of text (rated)', 1, true, CASE quality WHEN 1 THEN 'Low' ELSE 'High' END
  FROM gold0 WHERE multi
  UNION ALL
  SELECT item_id, 'Toxic language', 0, false,
         CASE toxic WHEN 1 THEN 'Yes, it is toxic' ELSE 'No, it is not toxic' END FROM gold0)
"""

CTES["pred"] = f"""
pred0 AS (
  SELECT d.doc_id AS item_id, s.step_order, s.dimension,
         CASE s.step_order
           WHEN 0 THEN coalesce(l.quality, {h("d.doc_id||'|guess'")} % 2)
           ELSE coalesce(l.toxic, {h("d.doc_id||'|guess'")} % 2) END AS truth
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
  CROSS JOIN (VALUES (0, 'Quality of text'), (1, 'Toxic language')) s(step_order, dimension)),
pred1 AS (
  SELECT *, (truth = 1) = ({h("item_id||'|'||dimension||'|pred'")} % 100 < 80) AS positive FROM pred0),
pred2 AS (
  SELECT *, CASE WHEN step_order = 0 THEN CASE WHEN positive THEN 'High' ELSE 'Low' END
            ELSE CASE WHEN positive THEN 'Yes, it is toxic' ELSE 'No, it is not toxic' END END AS base
  FROM pred1),
pred AS (
  SELECT item_id * 2 + step_order AS pred_id, {h("item_id||'|job'")} % 3 AS job_id, item_id, step_order, dimension,
         CASE WHEN {h("item_id||'|'||dimension||'|blank'")} % 50 = 0 THEN ''
              WHEN {h("item_id||'|'||dimension||'|spell'")} % 3 = 0 THEN base
              WHEN {h("item_id||'|'||dimension||'|spell'")} % 3 = 1 THEN upper(base)
              ELSE base || ' level' END AS label,
         20 + {h("item_id||'|'||dimension||'|tok'")} % 80 AS tokens,
         {h("item_id||'|fail'")} % 40 <> 0 AS ok
  FROM pred2)
"""

CTES["coders"] = f"""
coders AS (
  SELECT item_id, 'a' AS coder, dimension, label FROM gold WHERE pos = 0
  UNION ALL
  SELECT g.item_id, 'b', g.dimension,
    CASE WHEN {h("g.item_id||'|'||g.dimension||'|b'")} % 100 < 85 THEN g.label ELSE o.other END
  FROM gold g JOIN (VALUES ('High','Low'), ('Low','High'),
       ('Yes, it is toxic','No, it is not toxic'), ('No, it is not toxic','Yes, it is toxic')) o(label, other)
    ON g.label = o.label
  WHERE g.pos = 0 AND {h("g.item_id||'|skip'")} % 8 <> 0)
"""

CTES["sets"] = f"""
setbits AS (
  SELECT d.doc_id AS item_id, d.lang, 'L'||j AS label,
         {h("d.doc_id||'|L'||j||'|g'")} % 100 < 40 - 7 * j AS g,
         {h("d.doc_id||'|L'||j||'|a'")} % 100 < 15 AS fa, {h("d.doc_id||'|L'||j||'|b'")} % 100 < 25 AS fb
  FROM documents d CROSS JOIN range(5) r(j)),
sets AS (SELECT item_id, lang, label, g AS in_gold, g <> fa AS in_a, g <> fb AS in_b FROM setbits)
"""

CTES["scores"] = f"""
scores AS (
  SELECT doc_id AS item_id, ({h("doc_id||'|score'")} % 1000 + 300 * quality) / 1300.0::DOUBLE AS score,
         quality::INTEGER AS truth_a,
         (CASE WHEN {h("doc_id||'|tb'")} % 100 < 80 THEN quality ELSE 1 - quality END)::INTEGER AS truth_b
  FROM labels)
"""

CTES["responses"] = f"""
responses AS (
  SELECT doc_id AS item_id,
    CASE {h("doc_id||'|resp'")} % 8
      WHEN 0 THEN 'Reason.' || chr(10) || 'Answer: High.'
      WHEN 1 THEN 'Answer: maybe' || chr(10) || 'answer:  low'
      WHEN 2 THEN 'I think it is High, not Low'
      WHEN 3 THEN 'Answer: n/a'
      WHEN 4 THEN 'unclear'
      WHEN 5 THEN 'ANSWER: the highest is High level' || chr(10) || 'end'
      WHEN 6 THEN 'Yes at first, but no.'
      ELSE 'Answer: ' || text END AS response
  FROM documents)
"""

CTES["sheet"] = f"""
sheet AS (
  SELECT conv_id, turn,
    CASE WHEN {h("conv_id||'|'||turn||'|n'")} % 4 = 0 THEN ''
         WHEN {h("conv_id||'|'||turn||'|n'")} % 4 = 1 THEN '"quote ' || {h("conv_id||'|'||turn||'|q'")} % 3 || '"'
         ELSE text END AS quote,
    CASE WHEN {h("conv_id||'|'||turn||'|e'")} % 5 = 0 THEN ''
         ELSE 'Theme ' || {h("conv_id||'|'||turn||'|t'")} % 3 END AS theme,
    CASE WHEN {h("conv_id||'|'||turn||'|m'")} % 5 = 0
         THEN 'Level ' || {h("conv_id||'|'||turn||'|l'")} % 4 || ' & Upper level'
         ELSE 'Level ' || {h("conv_id||'|'||turn||'|l'")} % 4 END AS level,
    CASE WHEN turn % 3 = 0 THEN '' ELSE 'Topic ' || {h("conv_id||'|'||turn||'|topic'")} % 2 END AS topic,
    CASE {h("conv_id||'|'||turn||'|beh'")} % 4 WHEN 0 THEN 'AI behavior' WHEN 1 THEN 'Self-disclosure' ELSE '' END AS behavior,
    role
  FROM conversations)
"""

CTES["book"] = f"""
book AS (
  SELECT conv_id AS codebook_id, role AS dim, turn AS sort_order,
    CASE WHEN turn % 3 = 0 THEN 'No label'
         WHEN turn % 2 = 0 THEN regexp_extract(text, '^[^ ]+ [^ ]+')
         ELSE regexp_extract(text, '^[^ ]+') END AS label,
    CASE {h("conv_id||'|'||turn||'|p'")} % 4
         WHEN 0 THEN [] WHEN 1 THEN ['Group A'] WHEN 2 THEN ['Group A', 'Sub']
         ELSE ['Group B', CASE WHEN turn % 3 = 0 THEN 'no labels' ELSE 'Other' END] END AS path,
    CASE WHEN {h("conv_id||'|'||turn||'|d'")} % 3 = 0 THEN '' ELSE text END AS definition,
    [text, '', 'second ' || turn] AS examples
  FROM conversations),
bookdims AS (
  SELECT codebook_id, dim, min(sort_order) AS sort_order,
    CASE dim WHEN 'user' THEN 'single_label' WHEN 'assistant' THEN 'multi_label' ELSE 'binary' END AS dim_type,
    CASE WHEN dim = 'assistant' THEN 'user' ELSE '' END AS gated_by,
    CASE WHEN dim = 'system' THEN 'user' ELSE '' END AS derived_from,
    CASE WHEN dim = 'assistant' THEN 'Assistant groups' ELSE '' END AS category_dimension,
    CASE WHEN dim = 'user' THEN 'Read the turn.' ELSE '' END AS instructions
  FROM book GROUP BY codebook_id, dim)
"""

CTES["traj"] = """
traj AS (
  SELECT event_id // 12 AS run_id, event_id % 12 AS round, event_type, user_id,
         least(1.0, abs(value) / 100) AS val_acc
  FROM events)
"""

CTES["rules"] = f"""
rules AS (
  SELECT CASE WHEN user_id % 10 = 0 THEN NULL ELSE user_id END AS codebook_id, event_type AS dimension,
         date_diff('day', DATE '2024-01-01', ts::DATE) AS version, event_id AS pos,
         CASE WHEN event_id % 11 = 0 THEN '' ELSE 'rule' || event_id % 7 END AS rule_id,
         CASE WHEN event_id % 9 = 0 THEN '' ELSE 'Boundary ' || event_id % 5 || ' of ' || event_type || ' with a long tail of words' END AS boundary,
         'rule text ' || event_id % 3 AS rule,
         [CASE WHEN event_id % 2 = 0 THEN 'High' ELSE 'Low' END] AS target_labels
  FROM events)
"""

CTES["edits"] = f"""
edits AS (
  SELECT job_id, item_id, upper(dimension) || ' (edited)' AS dimension, 'Fixed ' || e AS label,
         pred_id * 10 + e AS edit_id
  FROM pred CROSS JOIN range(2) r(e)
  WHERE {h("item_id||'|'||dimension||'|edit'")} % 20 = 0 AND (e = 0 OR item_id % 2 = 0))
"""

CTES["msgs"] = """
msgs AS (SELECT event_id, ts, user_id, event_type, value AS cost, CAST(floor(value * 10) AS BIGINT) + 5 AS tokens FROM events)
"""

NEEDS = {"pred": [], "coders": ["gold"], "edits": ["pred"]}


def with_(names: str, body: str) -> str:
    """SQL with the named relations (and those they need) in front."""
    order: list[str] = []
    for n in names.split():
        for m in [*NEEDS.get(n, []), n]:
            if m not in order:
                order.append(m)
    ctes = ",\n".join(CTES[n].strip() for n in order)
    head = f"WITH {ctes}" if ctes else ""
    body = body.strip()
    if body.upper().startswith("WITH ") and head:
        return head + ",\n" + body[5:]
    return f"{head}\n{body}".strip()
