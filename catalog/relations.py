"""Relations the queries start from, derived by Spark from the given tables.

Everything that looks random is a hash of a row's key, so any engine builds the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUALITY, TOXIC = "Quality of text", "Toxic language"
QUALITY_GOLD = "Quality of text (rated)"
YES, NO = "Yes, it is toxic", "No, it is not toxic"
SET_LABELS = ["L0", "L1", "L2", "L3", "L4"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def key(*parts: Column | str) -> Column:
    """Parts joined with a bar; plain strings are column names, ``'text'`` in quotes literals."""
    cols = []
    for p in parts:
        if isinstance(p, str):
            cols.append(F.lit(p[1:-1]) if p.startswith("'") else F.col(p).cast("string"))
        else:
            cols.append(p.cast("string"))
    return F.concat_ws("|", *cols)


def h(*parts: Column | str) -> Column:
    return F.conv(F.substring(F.md5(key(*parts)), 1, 8), 16, 10).cast("bigint")


def pick(n: Column, *values: str | Column) -> Column:
    """Value number n (0-based); the last one for anything else."""
    out = None
    for i, v in enumerate(values[:-1]):
        v = F.lit(v) if isinstance(v, str) else v
        out = F.when(n == i, v) if out is None else out.when(n == i, v)
    last = values[-1]
    return out.otherwise(F.lit(last) if isinstance(last, str) else last)


def _gold_map() -> Column:
    own = F.when(F.col("quality") == 1, "High").otherwise("Low")
    other = F.when(F.col("quality") == 1, "Low").otherwise("High")
    multi = h("doc_id", "'multi'") % 10 == 0
    quality = F.when(multi, F.to_json(F.array(own, other))).otherwise(own)
    toxic = F.when(F.col("toxic") == 1, YES).otherwise(NO)
    return F.create_map(F.lit(QUALITY_GOLD), quality, F.lit(TOXIC), toxic)


def gold_items(spark: SparkSession, d: str) -> DataFrame:
    """Labeled documents: item_id, gold."""
    return table(spark, d, "labels").select(F.col("doc_id").alias("item_id"), _gold_map().alias("gold"))


def items(spark: SparkSession, d: str) -> DataFrame:
    """All documents as items; gold where there are labels, metadata for every fifth."""
    empty = F.create_map().cast("map<string,string>")
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    meta = F.create_map(
        F.lit("Coding theme"), F.lit("QUALITY of text"), F.lit("Level"), pick(h("doc_id", "'ml'") % 3, "High", "Low", ""),
        F.lit("quote"), F.substring("text", 1, 30),
    )
    return docs.select(
        F.col("doc_id").alias("item_id"),
        F.col("doc_id").alias("idx"),
        F.lit(1).cast("bigint").alias("codebook_id"),
        F.col("text").alias("content"),
        F.when(F.col("doc_id") % 3 == 0, F.col("lang")).otherwise("").alias("context"),
        F.when(F.col("doc_id") % 5 == 0, meta).otherwise(empty).alias("metadata"),
        F.when(F.col("quality").isNotNull(), _gold_map()).otherwise(empty).alias("gold"),
    )


def predictions(spark: SparkSession, d: str, docs: DataFrame | None = None) -> DataFrame:
    """Two predictions per document; ``docs`` may be a stream of documents."""
    docs = table(spark, d, "documents") if docs is None else docs
    docs = docs.select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    steps = F.array(
        F.struct(F.lit(0).alias("step_order"), F.lit(QUALITY).alias("dimension"), F.col("quality").alias("t")),
        F.struct(F.lit(1).alias("step_order"), F.lit(TOXIC).alias("dimension"), F.col("toxic").alias("t")),
    )
    rows = docs.select(F.col("doc_id").alias("item_id"), F.inline(steps))
    truth = F.coalesce(F.col("t").cast("bigint"), h("item_id", "'guess'") % 2)
    positive = (truth == 1) == (h("item_id", "dimension", "'pred'") % 100 < 80)
    base = F.when(
        F.col("step_order") == 0, F.when(positive, "High").otherwise("Low")
    ).otherwise(F.when(positive, YES).otherwise(NO))
    spelled = pick(h("item_id", "dimension", "'spell'") % 3, F.col("base"), F.upper("base"), F.concat("base", F.lit(" level")))
    return rows.withColumn("base", base).select(
        (F.col("item_id") * 2 + F.col("step_order")).alias("pred_id"),
        (h("item_id", "'job'") % 3).alias("job_id"),
        "item_id",
        "step_order",
        "dimension",
        F.when(h("item_id", "dimension", "'blank'") % 50 == 0, "").otherwise(spelled).alias("label"),
        (20 + h("item_id", "dimension", "'tok'") % 80).alias("tokens"),
        (h("item_id", "'fail'") % 40 != 0).alias("ok"),
    )


def coder_gold(spark: SparkSession, d: str) -> DataFrame:
    """Labels of coders a and b in long form."""
    rows = table(spark, d, "labels").select(
        F.col("doc_id").alias("item_id"),
        F.inline(
            F.array(
                F.struct(F.lit(QUALITY_GOLD).alias("dimension"), F.when(F.col("quality") == 1, "High").otherwise("Low").alias("label"),
                         F.when(F.col("quality") == 1, "Low").otherwise("High").alias("other")),
                F.struct(F.lit(TOXIC).alias("dimension"), F.when(F.col("toxic") == 1, YES).otherwise(NO).alias("label"),
                         F.when(F.col("toxic") == 1, NO).otherwise(YES).alias("other")),
            )
        ),
    )
    b = F.when(h("item_id", "dimension", "'b'") % 100 < 85, F.col("label")).otherwise(F.col("other"))
    both = F.array(
        F.struct(F.lit("a").alias("coder"), F.col("label").alias("said")),
        F.struct(F.lit("b").alias("coder"), F.when(h("item_id", "'skip'") % 8 != 0, b).alias("said")),
    )
    return (
        rows.select("item_id", "dimension", F.inline(both))
        .filter(F.col("said").isNotNull())
        .withColumnRenamed("said", "label")
    )


def label_sets(spark: SparkSession, d: str) -> DataFrame:
    """Gold and two predicted label sets for every document."""

    def bit(j: int, tag: str, below: int) -> Column:
        return h("doc_id", f"'L{j}'", f"'{tag}'") % 100 < below

    gold = [bit(j, "g", 40 - 7 * j) for j in range(5)]

    def chosen(conds: list[Column]) -> Column:
        return F.array_compact(F.array(*[F.when(c, f"L{j}") for j, c in enumerate(conds)]))

    return table(spark, d, "documents").select(
        F.col("doc_id").alias("item_id"),
        "lang",
        chosen(gold).alias("gold"),
        chosen([g != bit(j, "a", 15) for j, g in enumerate(gold)]).alias("pred_a"),
        chosen([g != bit(j, "b", 25) for j, g in enumerate(gold)]).alias("pred_b"),
    )


def scores(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("quality").cast("int")
    return table(spark, d, "labels").select(
        F.col("doc_id").alias("item_id"),
        ((h("doc_id", "'score'") % 1000 + 300 * q) / F.lit(1300.0)).alias("score"),
        q.alias("truth_a"),
        F.when(h("doc_id", "'tb'") % 100 < 80, q).otherwise(1 - q).alias("truth_b"),
    )


def responses(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("item_id"),
        pick(
            h("doc_id", "'resp'") % 8,
            "Reason.\nAnswer: High.",
            "Answer: maybe\nanswer:  low",
            "I think it is High, not Low",
            "Answer: n/a",
            "unclear",
            "ANSWER: the highest is High level\nend",
            "Yes at first, but no.",
            F.concat(F.lit("Answer: "), "text"),
        ).alias("response"),
    )


def sheet(spark: SparkSession, d: str) -> DataFrame:
    """Coder sheet: one sheet per conversation, rows in turn order."""

    def hh(tag: str) -> Column:
        return h("conv_id", "turn", f"'{tag}'")

    level = F.concat(F.lit("Level "), (hh("l") % 4).cast("string"))
    n = hh("n") % 4
    return table(spark, d, "conversations").select(
        "conv_id",
        "turn",
        F.when(n == 0, "").when(n == 1, F.concat(F.lit('"quote '), (hh("q") % 3).cast("string"), F.lit('"')))
        .otherwise(F.col("text")).alias("quote"),
        F.when(hh("e") % 5 == 0, "").otherwise(F.concat(F.lit("Theme "), (hh("t") % 3).cast("string"))).alias("theme"),
        F.when(hh("m") % 5 == 0, F.concat(level, F.lit(" & Upper level"))).otherwise(level).alias("level"),
        F.when(F.col("turn") % 3 == 0, "").otherwise(F.concat(F.lit("Topic "), (hh("topic") % 2).cast("string"))).alias("topic"),
        pick(hh("beh") % 4, "AI behavior", "Self-disclosure", "").alias("behavior"),
        "role",
    )


def book_labels(spark: SparkSession, d: str) -> DataFrame:
    """A library of codebooks: one per conversation, roles as dimensions, turns as labels."""
    p = h("conv_id", "turn", "'p'") % 4
    turn = F.col("turn")
    none = F.array().cast("array<string>")
    return table(spark, d, "conversations").select(
        F.col("conv_id").alias("codebook_id"),
        F.col("role").alias("dim"),
        F.when(turn % 3 == 0, "No label")
        .when(turn % 2 == 0, F.regexp_extract("text", "^[^ ]+ [^ ]+", 0))
        .otherwise(F.regexp_extract("text", "^[^ ]+", 0)).alias("label"),
        F.when(h("conv_id", "turn", "'d'") % 3 == 0, "").otherwise(F.col("text")).alias("definition"),
        F.array(F.col("text"), F.lit(""), F.concat(F.lit("second "), turn.cast("string"))).alias("examples"),
        F.when(p == 0, none).when(p == 1, F.array(F.lit("Group A"))).when(p == 2, F.array(F.lit("Group A"), F.lit("Sub")))
        .otherwise(F.array(F.lit("Group B"), F.when(turn % 3 == 0, "no labels").otherwise("Other"))).alias("path"),
        turn.cast("bigint").alias("sort_order"),
    )


def book_dims(spark: SparkSession, d: str) -> DataFrame:
    dim = F.col("dim")
    return (
        book_labels(spark, d)
        .groupBy("codebook_id", "dim")
        .agg(F.min("sort_order").alias("sort_order"))
        .select(
            "codebook_id",
            "dim",
            F.when(dim == "user", "single_label").when(dim == "assistant", "multi_label").otherwise("binary").alias("dim_type"),
            F.when(dim == "user", "Read the turn.").otherwise("").alias("instructions"),
            F.when(dim == "assistant", "user").otherwise("").alias("gated_by"),
            F.when(dim == "system", "user").otherwise("").alias("derived_from"),
            F.when(dim == "assistant", "Assistant groups").otherwise("").alias("category_dimension"),
            F.array().cast("array<string>").alias("context_dims"),
            "sort_order",
        )
    )


def trajectory(spark: SparkSession, d: str) -> DataFrame:
    """Tuning runs of twelve rounds each, from consecutive events."""
    e = table(spark, d, "events")
    return e.select(
        F.floor(F.col("event_id") / 12).alias("run_id"),
        (F.col("event_id") % 12).alias("round"),
        "event_type",
        "user_id",
        F.least(F.lit(1.0), F.abs("value") / 100).alias("val_acc"),
    )


def rules(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    return table(spark, d, "events").select(
        F.when(F.col("user_id") % 10 != 0, F.col("user_id")).alias("codebook_id"),
        F.col("event_type").alias("dimension"),
        F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("bigint").alias("version"),
        i.alias("pos"),
        F.when(i % 11 == 0, "").otherwise(F.concat(F.lit("rule"), (i % 7).cast("string"))).alias("rule_id"),
        F.when(i % 9 == 0, "").otherwise(
            F.concat(F.lit("Boundary "), (i % 5).cast("string"), F.lit(" of "), "event_type", F.lit(" with a long tail of words"))
        ).alias("boundary"),
        F.concat(F.lit("rule text "), (i % 3).cast("string")).alias("rule"),
        F.array(F.when(i % 2 == 0, "High").otherwise("Low")).alias("target_labels"),
    )


def edits(spark: SparkSession, d: str, docs: DataFrame | None = None) -> DataFrame:
    p = predictions(spark, d, docs).filter(h("item_id", "dimension", "'edit'") % 20 == 0)
    rows = p.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("e")).filter(
        (F.col("e") == 0) | (F.col("item_id") % 2 == 0)
    )
    return rows.select(
        "job_id", "item_id", F.concat(F.upper("dimension"), F.lit(" (edited)")).alias("dimension"),
        F.concat(F.lit("Fixed "), F.col("e").cast("string")).alias("label"),
        (F.col("pred_id") * 10 + F.col("e")).alias("edit_id"),
    )


def usage(events: DataFrame) -> DataFrame:
    return events.select(
        "event_id", "ts", "user_id", "event_type", F.col("value").alias("cost"),
        (F.floor(F.col("value") * 10) + 5).alias("tokens"),
    )
