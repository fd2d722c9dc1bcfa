"""Labeling items step by step with a pluggable labeler.

A codebook becomes a few steps (``library.codebook_steps``); each step adds columns to the items, so any
number of steps is one pass over the items. The labeler is a plug point: recorded responses, or a user
function over pandas batches. Everything works on batches and on streams.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions.answers import is_binary, options, parse_answer, parse_label_set
from ..functions.names import gate_key, text_or_blank
from ..functions.texts import model_input
from ..operators.metrics import multilabel_metrics

# Gate answers after which no further step runs.
STOP_VALUES = ["no", "n/a", "none"]


@dataclass
class Step:
    """One labeler call: the dimensions it decides and how their options depend on earlier ones."""

    name: str
    dims: list[str]
    labels: dict[str, list[str]]
    prompt: str = ""
    gate: str | None = None
    gate_by: str | None = None
    gated_labels: dict[str, list[str]] = field(default_factory=dict)
    gated_prompts: dict[str, str] = field(default_factory=dict)
    context_from: list[str] = field(default_factory=list)
    derived: list[tuple[str, str, dict[str, str]]] = field(default_factory=list)


# ---- gated options and derived labels on tables ----------------------------------------------


def gated_options(predictions: DataFrame, labels: DataFrame, gate_values: str = "gate_value") -> DataFrame:
    """Adds ``options``: the labels under the row's gate value, all labels when it is unknown.

    ``predictions(codebook_id, dim, gate_value, ...)``, ``labels(codebook_id, dim, label, path,
    sort_order)``. Names meet by gate key; the option lists are as long as the codebook.
    """
    keys = ["codebook_id", "dim"]
    ordered = F.transform(
        F.array_sort(F.collect_list(F.struct("sort_order", "label"))), lambda s: s["label"]
    )
    by_gate = (
        labels.filter(F.size("path") > 0)
        .groupBy(*keys, gate_key(F.get("path", F.lit(0))).alias("_gate"))
        .agg(ordered.alias("_some"))
    )
    every = labels.groupBy(*keys).agg(F.array_distinct(ordered).alias("_all"))
    return (
        predictions.withColumn("_gate", gate_key(F.col(gate_values)))
        .join(by_gate, [*keys, "_gate"], "left")
        .join(every, keys, "left")
        .withColumn("options", F.coalesce("_some", "_all"))
        .drop("_gate", "_some", "_all")
    )


def derive_label(predictions: DataFrame, derived: DataFrame) -> DataFrame:
    """Adds ``derived_label``: the label mapped from ``label``; exact, else ignoring case, else ''.

    ``derived(codebook_id, source, from_label, to_label, sort_order)``.
    """
    keys = ["codebook_id", "source"]
    exact = derived.groupBy(*keys, F.col("from_label").alias("_l")).agg(
        F.max_by("to_label", "sort_order").alias("_exact")
    )
    low = derived.groupBy(*keys, F.lower("from_label").alias("_low")).agg(
        F.min_by("to_label", "sort_order").alias("_near")
    )
    rows = predictions.withColumn("_l", F.col("label")).withColumn("_low", F.lower("label"))
    joined = rows.join(exact, [*keys, "_l"], "left").join(low, [*keys, "_low"], "left")
    found = F.coalesce(F.nullif("_exact", F.lit("")), "_near", F.lit(""))
    return joined.withColumn("derived_label", found).select(*predictions.columns, "derived_label")


# ---- labelers --------------------------------------------------------------------------------

Labeler = Callable[[DataFrame, int, Column, Column, Column], DataFrame]


def recorded(responses: DataFrame, key: str = "item_id") -> Labeler:
    """Replays ``responses(item_id, step_order, response, tokens)``; a missing one is a failure.

    Responses are joined once, as one map per item, whatever the number of steps. Of several for one
    item and step the greatest (response, tokens) is used, as logs may hold an answer twice.
    """
    answer = F.max(F.struct("response", "tokens")).alias("answer")
    one = responses.filter(F.col("step_order").isNotNull()).groupBy(key, "step_order").agg(answer)
    entries = F.map_from_entries(F.collect_list(F.struct("step_order", "answer")))
    per_item = one.groupBy(key).agg(entries.alias("_recorded"))

    def joined(df: DataFrame) -> DataFrame:
        return df if "_recorded" in df.columns else df.join(per_item, key, "left")

    def call(df: DataFrame, step: int, prompt: Column, text: Column, active: Column) -> DataFrame:
        df = joined(df)
        hit = F.try_element_at("_recorded", F.lit(step))
        return df.withColumn("_response", F.when(active, hit["response"])).withColumn(
            "_tokens", F.when(active, hit["tokens"])
        )

    call.joined = joined
    return call


def pandas_labeler(
    fn: Callable[[pd.DataFrame], pd.DataFrame], parallelism: int | None = None
) -> Labeler:
    """A user function over pandas batches with columns ``prompt`` and ``input``; it returns
    ``response`` and ``tokens`` for the same rows. ``parallelism`` caps the tasks that call it. Only these two
    columns go to Python.

    Rows that are gated out never reach the function. When it raises for a batch, its halves
    are tried in turn, so only the rows that fail themselves are marked as failed.
    """

    def safe(batch: pd.DataFrame) -> pd.DataFrame:
        try:
            out = fn(batch)
            return pd.DataFrame(
                {"response": list(out["response"]), "tokens": list(out["tokens"])}, index=batch.index
            )
        except Exception:
            if len(batch) == 1:
                return pd.DataFrame({"response": [None], "tokens": [None]}, index=batch.index)
            half = len(batch) // 2
            return pd.concat([safe(batch.iloc[:half]), safe(batch.iloc[half:])])

    def asked(active: pd.Series, prompt: pd.Series, text: pd.Series) -> pd.DataFrame:
        todo = pd.DataFrame({"prompt": prompt, "input": text})[active.fillna(False).astype(bool)]
        got = safe(todo.reset_index(drop=True)) if len(todo) else pd.DataFrame({"response": [], "tokens": []})
        out = pd.DataFrame({"response": None, "tokens": pd.array([None] * len(active), "Int64")}, index=active.index)
        said = got["response"].astype(object)
        out.loc[todo.index, "response"] = said.where(said.notna(), None).to_numpy()
        out.loc[todo.index, "tokens"] = pd.to_numeric(got["tokens"]).astype("Int64").to_numpy()
        return out

    # a call may be dear: the optimizer must not repeat it where its answer is used twice
    ask = F.pandas_udf(asked, StructType([StructField("response", StringType()), StructField("tokens", LongType())]))
    ask = ask.asNondeterministic()

    def call(df: DataFrame, step: int, prompt: Column, text: Column, active: Column) -> DataFrame:
        if parallelism is not None and step == 0:
            df = df.repartition(parallelism)
        df = df.withColumn("_call", ask(active, prompt, text))
        return df.withColumns({"_response": F.col("_call.response"), "_tokens": F.col("_call.tokens")}).drop("_call")

    return call


# ---- the plan --------------------------------------------------------------------------------


def annotate(items: DataFrame, steps: list[Step], labeler: Labeler, key: str = "item_id") -> DataFrame:
    """Items with ``answers`` (one struct per step dimension and derived dimension, in order),
    ``tokens`` (all calls of the item) and ``ok`` (no call failed).

    Each step asks the labeler, reads the answer against the options its gate leaves, and adds
    derived labels. After a gate step answered no, the remaining steps are skipped.
    """
    df = items.withColumn("_stop", F.lit(False)).withColumn("tokens", F.lit(0).cast("bigint"))
    df = df.withColumn("ok", F.lit(True))
    column: dict[str, str] = {}  # dimension -> column with its label
    answers: list[Column] = []
    for i, s in enumerate(steps):
        active = ~F.col("_stop") & F.col("ok")
        gate = F.col(column[s.gate_by]) if s.gate_by in column else None

        def by_gate(values: dict, fallback: Column, make: Callable) -> Column:
            if gate is None or not values:
                return fallback
            out = None
            for v, x in values.items():
                cond = gate_key(gate) == gate_key(F.lit(v))
                out = F.when(cond, make(x)) if out is None else out.when(cond, make(x))
            return out.otherwise(fallback)

        prompt = by_gate(s.gated_prompts, F.lit(s.prompt), F.lit)
        prior = [(d, F.col(column[d])) for d in s.context_from if d in column]
        text = model_input(F.col("content"), F.col("context"), prior)
        df = labeler(df, i, prompt, text, active)
        failed = active & F.col("_response").isNull()
        df = df.withColumns(
            {
                "tokens": F.col("tokens")
                + F.coalesce(F.when(active & ~failed, F.col("_tokens")), F.lit(0)),
                "ok": F.col("ok") & ~failed,
                f"_r{i}": F.when(active, F.col("_response")),
            }
        )
        new: dict[str, Column] = {}
        for j, d in enumerate(s.dims):
            labels = by_gate(s.gated_labels, options(s.labels.get(d, [])), options)
            df = df.withColumn(f"_o{i}_{j}", labels)
            opts = F.col(f"_o{i}_{j}")
            label = F.when(
                F.col(f"_r{i}").isNotNull(), parse_answer(F.col(f"_r{i}"), opts, is_binary(opts))
            )
            name = f"_l{i}_{j}"
            new[name] = F.coalesce(label, F.lit(""))
            column[d] = name
            answers.append(_answer(i, d, F.col(name), text_or_blank(F.col(f"_r{i}"))))
        df = df.withColumns(new)
        for j, (d, source, mapping) in enumerate(s.derived):
            name = f"_d{i}_{j}"
            src = F.col(column[source]) if source in column else F.lit("")
            df = df.withColumn(name, F.when(F.col(f"_r{i}").isNotNull(), _mapped(src, mapping)).otherwise(""))
            column[d] = name
            why = F.when(
                F.col(f"_r{i}").isNotNull(), F.concat(F.lit(f"Derived from {source} = "), src)
            ).otherwise("")
            answers.append(_answer(i, d, F.col(name), why))
        if s.gate and s.gate in column:
            stop = F.lower(F.col(column[s.gate])).isin(STOP_VALUES) & F.col(f"_r{i}").isNotNull()
            df = df.withColumn("_stop", F.col("_stop") | stop)
    return df.select(*items.columns, F.array(*answers).alias("answers"), "tokens", "ok")


def _answer(step: int, dim: str, label: Column, reasoning: Column) -> Column:
    return F.struct(
        F.lit(step).alias("step_order"), F.lit(dim).alias("dimension"), label.alias("label"), reasoning.alias("reasoning")
    )


def _mapped(source: Column, mapping: dict[str, str]) -> Column:
    exact, near = None, None
    for k, v in mapping.items():
        exact = F.when(source == k, v) if exact is None else exact.when(source == k, v)
        same = F.lower(source) == k.lower()
        near = F.when(same, v) if near is None else near.when(same, v)
    return F.coalesce(F.nullif(exact, F.lit("")), near, F.lit(""))


def result_rows(annotated: DataFrame, steps: list[Step], keys: list[str] = ("item_id",)) -> DataFrame:
    """One row per item and dimension for items without failures.

    Every row carries the item's tokens divided by the number of steps (whole number), so adding
    up rows is not the item's total.
    """
    share = F.floor(F.col("tokens") / max(len(steps), 1)).cast("bigint")
    # the outer form keeps the optimizer from copying all step expressions into a filter on the array
    rows = annotated.select(
        *keys, F.inline_outer(F.when(F.col("ok"), F.col("answers"))), share.alias("tokens")
    )
    return rows.filter(F.col("dimension").isNotNull())


def apply_gate(df: DataFrame, gate: str, labels: list[str]) -> DataFrame:
    """Wide labels: after a gate column that says no, the given later label columns are blank."""
    stop = F.lower(F.col(gate)).isin(STOP_VALUES)
    return df.withColumns({c: F.when(stop, "").otherwise(F.col(c)) for c in labels})


# ---- scoring candidates ----------------------------------------------------------------------


def score_candidates(answers: DataFrame, keys: list[str] = ("candidate",)) -> DataFrame:
    """Accuracy by exact equality per candidate. ``answers(candidate, gold, response, options,
    tokens)``; a missing response is a wrong, empty label without tokens."""
    opts = F.col("options")
    pred = F.coalesce(F.when(F.col("response").isNotNull(), parse_answer(F.col("response"), opts, is_binary(opts))), F.lit(""))
    return (
        answers.withColumn("pred", pred)
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg((F.col("pred") == F.col("gold")).cast("double")).alias("accuracy"),
            F.coalesce(F.sum(F.when(F.col("response").isNotNull(), F.col("tokens"))), F.lit(0)).alias("tokens"),
        )
    )


def score_label_sets(answers: DataFrame, keys: list[str] = ("candidate",)) -> DataFrame:
    """Multi-label metrics per candidate. ``answers(candidate, gold array, response, options)``; a
    missing response is an empty set."""
    pred = parse_label_set(text_or_blank(F.col("response")), F.col("options"))
    return multilabel_metrics(answers.withColumn("pred", pred), list(keys))


def best_candidate(scores: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """Highest accuracy; a later candidate must be strictly better to win."""
    at = F.struct("accuracy", (-F.col(order)).alias("o"))
    return scores.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in scores.columns if c not in keys]), at).alias("b")).select(*keys, "b.*")
