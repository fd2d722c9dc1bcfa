"""Registered queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from labelworks.llm import (
    conversations,
    decontaminate,
    exact,
    extract,
    licenses,
    lm_score,
    near,
    packing,
    secrets,
    spelling,
    substrings,
    toxicity,
    warc,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query; ``sql`` is left out where SQL cannot express the result."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql.strip()
        return fn

    return add


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query(
    "op1_exact_dedup",
    r"""
    WITH t AS (
      SELECT doc_id, length(coalesce(text, '')) AS n,
             sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
      FROM documents),
    g AS (
      SELECT text_sha256, count(*) AS group_size, max(n) AS longest FROM t GROUP BY text_sha256),
    k AS (
      SELECT g.text_sha256, any_value(group_size) AS group_size, min(doc_id) AS keep_id
      FROM g JOIN t ON t.text_sha256 = g.text_sha256 AND t.n = g.longest GROUP BY g.text_sha256)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, t.text_sha256
    FROM t JOIN k ON t.text_sha256 = k.text_sha256
    """,
)
def op1_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact.exact_duplicates(table(spark, folder, "documents"))


@query(
    "op5_decontamination",
    r"""
    WITH dw AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    bw AS (
      SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
    bwin AS (
      SELECT DISTINCT item_id, least(10, len(w)) AS k,
             array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS win
      FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM bw WHERE len(w) > 0)),
    ks AS (SELECT DISTINCT k FROM bwin),
    dwin AS (
      SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS win
      FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, ks WHERE len(w) >= k)),
    occ AS (
      SELECT doc_id, item_id, dwin.k, i FROM dwin JOIN bwin ON dwin.k = bwin.k AND dwin.win = bwin.win),
    hit AS (
      SELECT doc_id, count(DISTINCT p) AS n_hit
      FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM occ) GROUP BY doc_id),
    its AS (
      SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS list
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM occ) GROUP BY doc_id)
    SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
           coalesce(n_items, 0) AS n_items, sha256(coalesce(list, '')) AS items_sha256,
           coalesce(n_hit, 0) > 0 AS contaminated
    FROM dw LEFT JOIN hit ON dw.doc_id = hit.doc_id LEFT JOIN its ON dw.doc_id = its.doc_id
    """,
)
def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op10_toxicity")
def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op4_packing")
def op4_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), vocabulary("word_bpe_49k.json"))


@query(
    "op2_minhash_near_dedup",
    r"""
    WITH RECURSIVE w AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
      FROM documents),
    s AS MATERIALIZED (
      SELECT DISTINCT doc_id, array_to_string(w[i : i + least(4, len(w)) - 1], ' ') AS s
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(4, len(w)) + 2)) AS i FROM w WHERE len(w) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    e AS MATERIALIZED (
      SELECT a.doc_id AS a, b.doc_id AS b
      FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id
      JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
      GROUP BY a.doc_id, b.doc_id
      HAVING 100 * count(*) >= 80 * (any_value(na.n) + any_value(nb.n) - count(*))),
    r AS (
      SELECT doc_id AS node, doc_id AS seen FROM documents
      UNION
      SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen),
    c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node)
    SELECT node AS doc_id, coalesce(n, 0) AS n_shingles, component_id, node = component_id AS kept
    FROM c LEFT JOIN n ON n.doc_id = c.node
    """,
)
def op2_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near.near_duplicates(table(spark, folder, "documents"))


@query("op3_warc")
def op3_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archive_and_read(table(spark, folder, "pages"))


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    return corpus_pipeline.run(spark, folder)


@query("op6_suffix_array_dedup")
def op6_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.repeat_report(table(spark, folder, "documents"))


@query("op8_html_extraction")
def op8_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return extract.extract(table(spark, folder, "pages"))


@query("op9_lm_scoring")
def op9_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return lm_score.pseudo_likelihood(table(spark, folder, "documents"))


@query("op7_license_scan")
def op7_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = licenses.license_matches(table(spark, folder, "documents"))
    return found.select(
        "doc_id",
        F.size("matches").cast("long").alias("n_matches"),
        F.concat_ws(",", F.array_sort(F.array_distinct("matches.license"))).alias("licenses"),
        F.coalesce(F.array_max("matches.containment"), F.lit(0.0)).alias("best"),
        "matches",
    )


# CRC-32 (reflected polynomial 0xEDB88320), a table of 256 entries by its rule.
CRC_TABLE = """crc_table AS MATERIALIZED (
      SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
        lambda c, k: xor(c >> 1, 3988292384 * (c & 1)))) AS crc_t)"""


def crc32_sql(text: str) -> str:
    """SQL for the unsigned CRC-32 of the UTF-8 bytes of a text, with ``crc_table`` in FROM."""
    return f"""xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(
        range(octet_length(encode({text}))),
        lambda i: CAST('0x' || substr(hex(encode({text})), 2 * i + 1, 2) AS BIGINT))),
        lambda c, b: xor(c >> 8, crc_t[(xor(c, b) & 255) + 1])), 4294967295)"""


@query(
    "op13_conversation_trie",
    f"""
    WITH {CRC_TABLE},
    t AS (
      SELECT conv_id, turn, octet_length(encode(coalesce(text, ''))) AS bytes,
             sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) AS x
      FROM conversations WHERE conv_id IS NOT NULL),
    own AS (
      SELECT conv_id, list(x ORDER BY turn NULLS FIRST, x) AS xs, list(bytes ORDER BY turn NULLS FIRST, x) AS bs
      FROM t GROUP BY conv_id),
    k AS (SELECT own.*, {crc32_sql("CAST(conv_id AS VARCHAR)")} % 9 AS h FROM own, crc_table),
    c AS (
      SELECT k.conv_id, list_concat(coalesce(b.xs[1:h], []), k.xs[h + 1:]) AS xs,
             list_concat(coalesce(b.bs[1:h], []), k.bs[h + 1:]) AS bs
      FROM k LEFT JOIN own b ON b.conv_id = k.conv_id - k.conv_id % 5),
    p AS (SELECT conv_id, xs, bs, unnest(range(len(xs) + 1)) AS d FROM c),
    node AS MATERIALIZED (
      SELECT xs[1:d] AS path, d, min(conv_id) AS conv_id, count(*) AS n,
             coalesce(any_value(bs[d]), 0) AS bytes,
             sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (d = len(xs)), '')) AS ends
      FROM p GROUP BY xs[1:d], d),
    child AS (SELECT path[1:d - 1] AS path, count(*) AS n_children FROM node WHERE d > 0 GROUP BY 1),
    v AS MATERIALIZED (
      SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN child ON node.path = child.path),
    sub AS (
      SELECT path[1:j] AS path, CAST(sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_leaves,
             CAST(sum((n - 1) * bytes) AS BIGINT) AS saved_tokens
      FROM (SELECT *, unnest(range(d + 1)) AS j FROM v) GROUP BY 1)
    SELECT v.conv_id, v.d AS depth, up.conv_id AS parent_conv_id, v.n AS n_convs, v.n_children,
           sub.n_leaves, sub.saved_tokens, v.ends AS ends_sha256
    FROM v JOIN sub ON sub.path = v.path LEFT JOIN node up ON v.d > 0 AND up.path = v.path[1:v.d - 1]
    """,
)
def op13_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.prefix_trie(table(spark, folder, "conversations"))


@query(
    "op11_spelling_variants",
    f"""
    WITH RECURSIVE {CRC_TABLE},
    d AS (
      SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
             unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
               'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{{00C0}}-\\x{{00FF}}]+')) AS run FROM documents),
    r AS (SELECT id, run, count(*) AS c FROM d GROUP BY id, run),
    k AS (SELECT run, c, {crc32_sql("id || ':' || run")} AS h FROM r, crc_table),
    v AS MATERIALIZED (
      SELECT word, CAST(sum(c) AS BIGINT) AS n
      FROM (SELECT CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2)
                        ELSE run END AS word, c FROM k)
      GROUP BY word HAVING sum(c) >= 3 AND length(word) >= 5),
    x AS MATERIALIZED (
      SELECT word, i, left(word, i) || substr(word, i + 2) AS rest
      FROM (SELECT word, unnest(range(length(word))) AS i FROM v)),
    e AS (
      SELECT a.word, b.word AS near FROM x a JOIN x b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
      UNION SELECT x.word, v.word FROM x JOIN v ON v.word = x.rest
      UNION SELECT v.word, x.word FROM x JOIN v ON v.word = x.rest),
    b AS (
      SELECT e.word, near, v.n AS near_n, count(*) OVER (PARTITION BY e.word) AS n_near,
             row_number() OVER (PARTITION BY e.word ORDER BY v.n DESC, near) AS place
      FROM e JOIN v ON v.word = e.near),
    f AS MATERIALIZED (
      SELECT v.word, v.n, coalesce(n_near, 0) AS n_near,
             CASE WHEN near_n >= 2 * v.n THEN near END AS form, CASE WHEN near_n >= 2 * v.n THEN near_n END AS form_n
      FROM v LEFT JOIN b ON b.word = v.word AND place = 1),
    chain AS (
      SELECT word, word AS at FROM f
      UNION ALL SELECT chain.word, f.form FROM chain JOIN f ON f.word = chain.at WHERE f.form IS NOT NULL)
    SELECT f.word, f.form, ends.at AS root, f.n, f.n_near, f.form_n
    FROM f JOIN (SELECT chain.word, chain.at FROM chain JOIN f ON f.word = chain.at WHERE f.form IS NULL) ends
      ON ends.word = f.word
    """,
)
def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(table(spark, folder, "documents"))


@query("op12_secret_scan")
def op12_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.scan(table(spark, folder, "documents"))
