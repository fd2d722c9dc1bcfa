"""Labeling a whole library of codebooks in one job.

A codebook is one row of a plan table: its steps in order, each with its options, its prompt, and lookup maps by
gate value. Items meet the plan of their codebook once; a step is then the same column expressions for
all items, whatever their codebook says.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.answers import is_binary, parse_answer
from ..functions.names import gate_key, text_or_blank
from ..functions.texts import model_input
from ..operators.codebooks import DIM_KEYS
from ..operators.rank import join_safely
from ..scratch import stored
from ..sources.sheets import codebook_tables
from .labeling import Labeler, Step
from .prompts import prompt_table


def step_order(dims: DataFrame) -> DataFrame:
    """(codebook_id, dim, step_order): each dimension after its gate and its context dimensions.

    A dimension's turn is the greatest turn among those it needs, one more where the needed one stands at or
    below it in the codebook; steps go by turn, then by place. Dimensions that need themselves in a circle,
    and those that need such ones, come last by place. Names that the codebook does not have, and dimensions
    that are derived from others, are not waited for. Turns are found by repeated joins, as many as the longest
    chain of needs in any codebook.
    """
    kept = dims.filter(F.coalesce("derived_from", F.lit("")) == "").select(
        *DIM_KEYS, "sort_order", "gated_by", "context_dims"
    )
    named = F.array_distinct(F.array_compact(F.concat(F.array("gated_by"), F.coalesce("context_dims", F.array()))))
    place = kept.select("codebook_id", F.col("dim").alias("source"), F.col("sort_order").alias("_at"))
    needs = kept.select(*DIM_KEYS, "sort_order", F.explode(named).alias("source"))
    needs = join_safely(needs, place, ["codebook_id", "source"]).select(
        *DIM_KEYS, "source", (F.col("_at") >= F.col("sort_order")).cast("int").alias("later")
    )
    needs = stored(needs, "needs")
    counted = needs.groupBy(*DIM_KEYS).agg(F.count(F.lit(1)).alias("_waits"))
    turns = stored(join_safely(kept.select(*DIM_KEYS), counted, DIM_KEYS, "left").withColumn(
        "turn", F.when(F.col("_waits").isNull(), 0)), "turns")
    while True:
        known = turns.filter("turn IS NOT NULL").select("codebook_id", F.col("dim").alias("source"), "turn")
        got = join_safely(needs, known, ["codebook_id", "source"]).groupBy(*DIM_KEYS).agg(
            F.count(F.lit(1)).alias("_have"), F.max(F.col("turn") + F.col("later")).alias("_turn")
        )
        more = join_safely(turns, got, DIM_KEYS, "left").withColumn(
            "turn", F.coalesce("turn", F.when(F.col("_have") == F.col("_waits"), F.col("_turn")))
        )
        more = stored(more.select(*turns.columns), "turns")
        before, after = (t.filter("turn IS NOT NULL").count() for t in (turns, more))
        turns = more
        if before == after:
            break
    order = Window.partitionBy("codebook_id").orderBy(F.col("turn").asc_nulls_last(), "sort_order", "dim")
    ordered = join_safely(turns.select(*DIM_KEYS, "turn"), kept.select(*DIM_KEYS, "sort_order"), DIM_KEYS)
    return ordered.select(*DIM_KEYS, (F.row_number().over(order) - 1).alias("step_order"))


def _in_order(value: str) -> Column:
    rows = F.array_sort(F.collect_list(F.struct("sort_order", value)))
    return F.array_distinct(F.transform(rows, lambda r: r[value]))


def _map_of(rows: DataFrame, keys: list[str], key: Column, value: Column, name: str) -> DataFrame:
    """One map per group: of several values for a key that of the last row counts."""
    one = rows.groupBy(*keys, key.alias("_k")).agg(F.max_by(value, "sort_order").alias("_v"))
    return one.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_k", "_v"))).alias(name))


def labeling_plan(dims: DataFrame, labels: DataFrame, few_shot: bool = False) -> DataFrame:
    """(codebook_id, steps): the steps of each codebook in order, as an array as long as its dimensions.

    A step has dim, gated_by, context_dims, options, prompt, ``gated`` (by gate key: value, options, prompt) and,
    where the codebook derives a category from the label's path, category_dimension with ``exact`` and
    ``near`` (by lower-cased label) maps from label to category.
    """
    prompts = prompt_table(dims, labels, few_shot)
    steps = join_safely(dims, step_order(dims), DIM_KEYS)
    own = prompts.filter("gate_value IS NULL").select(*DIM_KEYS, "prompt")
    options = labels.groupBy(*DIM_KEYS).agg(_in_order("label").alias("options"))
    gated_dims = dims.filter(F.coalesce("gated_by", F.lit("")) != "").select(*DIM_KEYS)
    below = labels.join(gated_dims, DIM_KEYS, "left_semi").filter(F.size("path") > 0)
    below = below.withColumn("gate_value", F.get("path", F.lit(0))).filter("gate_value <> ''")
    values = below.groupBy(*DIM_KEYS, "gate_value").agg(
        _in_order("label").alias("options"), F.min("sort_order").alias("sort_order")
    )
    values = join_safely(values, prompts.filter("gate_value IS NOT NULL"), [*DIM_KEYS, "gate_value"], "left")
    # of several values with one key the first counts
    values = values.withColumn("sort_order", -F.col("sort_order"))
    entry = F.struct(F.col("gate_value").alias("value"), "options", "prompt")
    gated = _map_of(values, DIM_KEYS, gate_key(F.col("gate_value")), entry, "gated")
    category = dims.filter(F.coalesce("category_dimension", F.lit("")) != "").select(*DIM_KEYS)
    derived = labels.join(category, DIM_KEYS, "left_semi").filter(F.size("path") > 1)
    last = F.element_at("path", -1)
    exact = _map_of(derived, DIM_KEYS, F.col("label"), last, "exact")
    first = derived.withColumn("sort_order", -F.col("sort_order"))
    near = _map_of(first, DIM_KEYS, F.lower("label"), last, "near")
    for part in (own, options, gated, exact, near):
        steps = join_safely(steps, part, DIM_KEYS, "left")
    none = F.array().cast("array<string>")
    step = F.struct(
        "step_order",
        "dim",
        text_or_blank(F.col("gated_by")).alias("gated_by"),
        F.coalesce("context_dims", none).alias("context_dims"),
        F.coalesce("options", none).alias("options"),
        text_or_blank(F.col("prompt")).alias("prompt"),
        "gated",
        F.when(F.col("exact").isNotNull(), F.col("category_dimension")).alias("category_dimension"),
        "exact",
        "near",
    )
    # maps can't be sorted, so steps are put in their places by a map from place to step
    places = F.map_from_entries(F.collect_list(F.struct("step_order", step.alias("step"))))
    return steps.groupBy("codebook_id").agg(places.alias("places"), F.count(F.lit(1)).alias("n_steps")).select(
        "codebook_id", F.expr("transform(sequence(0, cast(n_steps as int) - 1), i -> places[i])").alias("steps")
    )


def codebook_steps(spark: SparkSession, codebook: dict, few_shot: bool = False) -> list[Step]:
    """The plan of one codebook object as steps for ``annotate``, where steps are to be changed by hand."""
    body = spark.createDataFrame([("codebook", json.dumps(codebook))], "codebook_id string, body string")
    row = labeling_plan(*codebook_tables(body), few_shot).first()
    out = []
    for s in row["steps"] if row else []:
        gated = [g for g in (s["gated"] or {}).values()]
        out.append(
            Step(
                name=s["dim"],
                dims=[s["dim"]],
                labels={s["dim"]: list(s["options"])},
                prompt=s["prompt"],
                gate_by=s["gated_by"] or None,
                gated_labels={g["value"]: list(g["options"]) for g in gated},
                gated_prompts={g["value"]: g["prompt"] for g in gated},
                context_from=list(s["context_dims"]),
                derived=[(s["category_dimension"], s["dim"], s["exact"])] if s["exact"] else [],
            )
        )
    return out


def annotate_library(items: DataFrame, plan: DataFrame, labeler: Labeler) -> DataFrame:
    """One row per item and dimension of its codebook: the item's columns, step_order, dimension, label, reasoning,
    tokens (the item's, divided by its steps) and ok.

    ``items(item_id, codebook_id, content, context, ...)``, ``plan`` from ``labeling_plan``. A step whose labeler gives
    nothing makes the item fail: its later steps are not asked, and its rows have ok = false with what was
    found before. Items whose codebook has no plan give no rows. Recorded answers are joined before the plan, so
    prompts are never shuffled with the items.
    """
    steps = plan.agg(F.max(F.size("steps"))).first()[0] or 0
    df = getattr(labeler, "joined", lambda rows: rows)(items)
    df = join_safely(df, plan, ["codebook_id"])
    df = df.withColumns(
        {
            "_known": F.create_map().cast("map<string,string>"),
            "_answers": F.array().cast("array<struct<step_order:int,dimension:string,label:string,reasoning:string>>"),
            "_total": F.lit(0).cast("bigint"),
            "_ok": F.lit(True),
        }
    )
    for i in range(steps):
        df = df.withColumn("_step", F.get("steps", F.lit(i)))
        gate = gate_key(F.try_element_at("_known", F.col("_step.gated_by")))
        asked = F.col("_step").isNotNull() & F.col("_ok")
        df = df.withColumns({"_gate": F.try_element_at("_step.gated", gate), "_asked": asked})
        prompt = F.coalesce("_gate.prompt", "_step.prompt")
        text = _input(F.col("_step.context_dims"))
        df = labeler(df, i, prompt, text, F.col("_asked"))
        df = df.withColumns(
            {
                "_said": F.when(F.col("_asked"), F.col("_response")),
                "_options": F.coalesce("_gate.options", "_step.options"),
            }
        )
        found = F.when(
            F.col("_said").isNotNull(), parse_answer(F.col("_said"), F.col("_options"), is_binary(F.col("_options")))
        )
        df = df.withColumn("_label", F.coalesce(found, F.lit("")))
        df = df.withColumn(
            "_derived",
            F.when(
                F.col("_step.exact").isNotNull() & F.col("_said").isNotNull(),
                F.coalesce(
                    F.nullif(F.try_element_at("_step.exact", "_label"), F.lit("")),
                    F.try_element_at("_step.near", F.lower("_label")),
                    F.lit(""),
                ),
            ),
        )
        category = F.col("_step.category_dimension")
        why = F.when(F.col("_said").isNotNull(), F.concat(F.lit("Derived from "), "_step.dim", F.lit(" = "), "_label")).otherwise("")
        new = F.array_compact(
            F.array(
                F.when(F.col("_step").isNotNull(), _row(i, F.col("_step.dim"), F.col("_label"), text_or_blank(F.col("_said")))),
                F.when(category.isNotNull(), _row(i, category, F.coalesce("_derived", F.lit("")), why)),
            )
        )
        said = F.when(F.col("_step").isNull(), F.array()).otherwise(
            F.filter(
                F.array(
                    F.struct(F.col("_step.dim").alias("key"), F.col("_label").alias("value")),
                    F.struct(category.alias("key"), F.coalesce("_derived", F.lit("")).alias("value")),
                ),
                lambda e: e["key"].isNotNull(),
            )
        )
        df = df.withColumns({"_new": new, "_entries": said.cast("array<struct<key:string,value:string>>")})
        df = df.withColumns(
            {
                "_answers": F.concat("_answers", "_new"),
                "_known": F.map_concat(
                    F.map_filter("_known", lambda k, _: ~F.array_contains(F.transform("_entries", lambda e: e["key"]), k)),
                    F.map_from_entries("_entries"),
                ),
                "_total": F.col("_total") + F.coalesce(F.when(F.col("_said").isNotNull(), F.col("_tokens")), F.lit(0)),
                "_ok": F.col("_ok") & (~F.col("_asked") | F.col("_said").isNotNull()),
            }
        )
    share = F.floor(F.col("_total") / F.greatest(F.size("steps"), F.lit(1))).cast("bigint")
    kept = [c for c in items.columns]
    rows = df.select(*kept, F.inline_outer("_answers"), share.alias("tokens"), F.col("_ok").alias("ok"))
    return rows.filter(F.col("dimension").isNotNull())


def _row(step: int, dim: Column, label: Column, reasoning: Column) -> Column:
    return F.struct(
        F.lit(step).alias("step_order"), dim.alias("dimension"), label.alias("label"), reasoning.alias("reasoning")
    )


def _input(sources: Column) -> Column:
    """The text sent to a labeler, with the labels already found for the step's context dimensions."""
    pairs = F.transform(sources, lambda d: F.struct(d.alias("d"), F.try_element_at("_known", d).alias("v")))
    said = F.transform(
        F.filter(pairs, lambda p: F.coalesce(p["v"], F.lit("")) != ""), lambda p: F.concat(p["d"], F.lit(" = "), p["v"])
    )
    body = model_input(F.col("content"), F.col("context"))
    tail = F.concat(F.lit("\n\nAlready determined: "), F.array_join(said, "; "), F.lit("."))
    return F.when(F.size(said) > 0, F.concat(body, tail)).otherwise(body)
