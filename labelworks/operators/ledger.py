"""Versioned ledgers: rules, prompts, corrections, jobs, usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import dimension_key, text_or_blank
from .rank import first_rows, join_safely

OUTPUT_TOKENS_PER_CALL = 24


def latest_per(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row with the highest ``order`` per key; a null key is a key of its own."""
    row = F.max_by(F.struct(*df.columns), order).alias("r")
    return df.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(row).select("r.*")


def next_version(versions: DataFrame, keys: list[str]) -> DataFrame:
    """Next free version per key and how many rules the last version added (never negative).

    ``versions(keys, version, n_rules)``.
    """
    last_two = first_rows(versions, keys, [F.desc("version")], 2)
    now, before = F.max(F.struct("version", "n_rules")), F.min(F.struct("version", "n_rules"))
    old = F.when(F.count(F.lit(1)) > 1, before["n_rules"]).otherwise(0)
    return last_two.groupBy(*keys).agg(
        (F.max("version") + 1).alias("next_version"),
        F.greatest(F.lit(0), now["n_rules"] - old).alias("new_rules"),
        now["n_rules"].alias("n_rules"),
    )


def best_prompt(
    dims: DataFrame, steps: DataFrame, runs: DataFrame, given: DataFrame | None = None
) -> DataFrame:
    """Prompt per dimension: given now, else newest completed run, else an existing step for that
    dimension alone, else the generated one. Names meet by dimension key.

    ``dims(project_id, dim, generated_prompt)``, ``steps(project_id, dims, prompt, step_order)``,
    ``runs(project_id, run_id, dimension, status, prompt)``, ``given(project_id, dimension, prompt)``.
    """
    single = steps.filter((F.size("dims") == 1) & (F.coalesce("prompt", F.lit("")) != ""))
    done = runs.filter((F.col("status") == "completed") & (F.coalesce("prompt", F.lit("")) != ""))

    def option(df: DataFrame, name: Column, priority: int, order: Column, source: str) -> DataFrame:
        return df.select(
            "project_id",
            dimension_key(name).alias("k"),
            F.struct(F.lit(priority).alias("p"), order.cast("bigint").alias("o")).alias("rank"),
            "prompt",
            F.lit(source).alias("source"),
        )

    options = option(done, F.col("dimension"), 2, F.col("run_id"), "run").unionByName(
        option(single, F.get("dims", F.lit(0)), 1, F.col("step_order"), "step")
    )
    if given is not None:
        options = options.unionByName(option(given, F.col("dimension"), 3, F.lit(0), "given"))
    best = options.groupBy("project_id", "k").agg(
        F.max_by(F.struct("prompt", "source"), "rank").alias("best")
    )
    return (
        dims.withColumn("k", dimension_key(F.col("dim")))
        .join(best, ["project_id", "k"], "left")
        .select(
            "project_id",
            "dim",
            F.coalesce("best.prompt", "generated_prompt").alias("prompt"),
            F.coalesce("best.source", F.lit("generated")).alias("source"),
        )
    )


# ---- rules -----------------------------------------------------------------------------------


def valid_rules(rules: DataFrame) -> DataFrame:
    return rules.filter(text_or_blank(F.col("boundary")) != "")


def changed_rules(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """Valid rules that are new or differ from the old rule of the same id."""
    cols = [*keys, *[c for c in new.columns if c not in (*keys, "pos")]]
    row = F.max_by(F.struct(*cols), "pos").alias("r")
    same = old.groupBy(*[F.col(k).alias(f"_{k}") for k in (*keys, "rule_id")]).agg(row).select("r.*")
    cond = [F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}")) for c in cols]
    match = cond[0]
    for c in cond[1:]:
        match = match & c
    return valid_rules(new).alias("n").join(same.alias("o"), match, "left_anti")


def upsert_rules(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rules replace old ones of the same id at the old place; other new ones follow.

    ``old/new(keys, pos, rule_id, boundary, ...)``. A missing id is the place for old rules and the
    whole boundary for new ones.
    """
    rid = F.nullif(F.col("rule_id"), F.lit(""))
    tagged_old = old.withColumn(
        "_id", F.coalesce("rule_id", F.concat(F.lit("r_"), F.col("pos").cast("string")))
    ).withColumn("_new", F.lit(0))
    tagged_new = new.withColumn(
        "_id", F.coalesce(rid, "boundary")
    ).withColumn("_new", F.lit(1))
    rows = tagged_old.unionByName(tagged_new)
    at = F.struct("_new", "pos")
    return (
        rows.groupBy(*keys, "_id")
        .agg(F.max_by(F.struct(*old.columns), at).alias("r"), F.min(at).alias("place"))
        .select(
            "r.*",
            F.col("_id").alias("merged_id"),
            F.col("place._new").alias("place_new"),
            F.col("place.pos").alias("place_pos"),
        )
    )


def guard_shrink(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: whether a de-duplicated library is accepted (not larger, not under two thirds)."""
    usable = (text_or_blank(F.col("rule")) != "") & (text_or_blank(F.col("boundary")) != "")
    rows = old.select(*keys, F.lit(1).alias("o"), F.lit(0).alias("n")).unionByName(
        new.filter(usable).select(*keys, F.lit(0).alias("o"), F.lit(1).alias("n"))
    )
    counts = rows.groupBy(*keys).agg(F.sum("o").alias("n_old"), F.sum("n").alias("n_new"))
    n, m = F.col("n_old"), F.col("n_new")
    floor = F.greatest(F.lit(3), F.floor(2 * n / 3))
    return counts.filter(n > 0).withColumn("accepted", (m > 0) & (m >= floor) & (m <= n))


def worked_examples(
    rules: DataFrame,
    examples: DataFrame,
    keys: list[str],
    per_rule: int = 1,
    total: int = 8,
) -> DataFrame:
    """Examples to show with each rule: items whose gold is a target label, items that were wrong at
    first before others, then shorter texts; no item twice, at most ``total`` per library.

    ``rules(keys, pos, rule_id, target_labels)``, ``examples(keys, ord, item_id, sentence, gold,
    first_pred)``. At most ``total`` items are taken in all, so the best ``total`` + ``per_rule``
    candidates of each label decide; only those are resolved rule by rule.
    """
    wrong_first = F.when(F.col("first_pred").eqNullSafe(F.col("gold")), 1).otherwise(0)
    ranked = examples.select(
        *keys, "item_id", "sentence", "gold", "ord",
        wrong_first.alias("right"), F.length("sentence").alias("size"),
    )
    top = first_rows(ranked, [*keys, "gold"], ["right", "size", "ord"], total + per_rule)
    pairs = (
        rules.select(*keys, "pos", "rule_id", F.explode(F.array_distinct("target_labels")).alias("gold"))
        .join(top, [*keys, "gold"])
    )
    pairs = first_rows(pairs, [*keys, "pos"], ["right", "size", "ord"], total + per_rule)
    cand = F.struct("pos", "right", "size", "ord", "item_id", "sentence", "gold", "rule_id")
    row = "struct<pos:bigint,rule_id:string,item_id:bigint,sentence:string,gold:string>"

    def take(acc: Column, c: Column) -> Column:
        used = F.exists(acc, lambda a: a["item_id"] == c["item_id"])
        mine = F.size(F.filter(acc, lambda a: a["pos"] == c["pos"]))
        ok = ~used & (mine < per_rule) & (F.size(acc) < total)
        new = F.struct(
            c["pos"].cast("bigint").alias("pos"), c["rule_id"].alias("rule_id"), c["item_id"].alias("item_id"),
            c["sentence"].alias("sentence"), c["gold"].alias("gold"),
        )
        return F.when(ok, F.concat(acc, F.array(new))).otherwise(acc)

    start = F.array().cast(f"array<{row}>")
    # rules are codebook-sized and each brings at most total + per_rule candidates
    folded = pairs.groupBy(*keys).agg(F.array_sort(F.collect_list(cand)).alias("c"))
    return folded.select(*keys, F.inline(F.aggregate("c", start, take)))


# ---- corrections, jobs, usage ----------------------------------------------------------------


def overlay(predictions: DataFrame, edits: DataFrame) -> DataFrame:
    """Predictions with the latest correction of each (job, item, dimension) in place.

    ``edits(job_id, item_id, dimension, label, edit_id)``; dimensions meet by dimension key.
    """
    last = (
        edits.withColumn("_k", dimension_key(F.col("dimension")))
        .groupBy("job_id", "item_id", "_k")
        .agg(F.max_by("label", "edit_id").alias("_label"))
    )
    return (
        predictions.withColumn("_k", dimension_key(F.col("dimension")))
        .join(last, ["job_id", "item_id", "_k"], "left")
        .withColumn("label", F.coalesce("_label", "label"))
        .select(*predictions.columns)
    )


def job_counters(results: DataFrame) -> DataFrame:
    """Per job: items completed and failed, tokens, status. ``results(job_id, item_id, ok, tokens)``
    has one row per item; tokens of failed items do not count."""
    ok = F.col("ok")
    out = results.groupBy("job_id").agg(
        F.count_if(ok).alias("completed"),
        F.count_if(~ok).alias("failed"),
        F.coalesce(F.sum(F.when(ok, F.col("tokens"))), F.lit(0)).cast("bigint").alias("tokens"),
    )
    return out.withColumn("status", F.when(F.col("failed") == 0, "completed").otherwise("failed"))


def usage_by(events: DataFrame, key: str | Column, name: str) -> DataFrame:
    """Cost, tokens and cost per million tokens per day or model. ``events(cost, tokens)``."""
    out = events.groupBy((F.col(key) if isinstance(key, str) else key).alias(name)).agg(
        F.sum("cost").alias("cost"), F.sum("tokens").alias("tokens")
    )
    return out.withColumn(
        "cost_per_million", F.try_divide(F.col("cost"), F.col("tokens")) * 1_000_000
    )


def estimate_run(items: DataFrame, steps: DataFrame, keys: list[str]) -> DataFrame:
    """Calls and tokens of a labeling run. ``items(keys, input_tokens)``,
    ``steps(keys, prompt_tokens)``; the input tokens of a call are the mean of all items."""
    of_items = items.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_items"),
        F.bround(F.avg("input_tokens"), 0).cast("bigint").alias("input_per_call"),
    )
    per_item = steps.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_steps"), F.sum("prompt_tokens").alias("prompt_tokens_per_item")
    )
    n, calls = F.col("n_items"), F.col("n_calls")
    out = join_safely(of_items, per_item, keys, "left")
    out = out.fillna(0, ["n_steps", "prompt_tokens_per_item"]).withColumn("n_calls", n * F.col("n_steps"))
    out = out.withColumn(
        "input_tokens", n * F.col("prompt_tokens_per_item") + calls * F.col("input_per_call")
    ).withColumn("output_tokens", calls * OUTPUT_TOKENS_PER_CALL)
    return out.withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens"))


def stack_runs(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """Run files as one table: one JSON value per file, or one per line with ``lines``."""
    return spark.read.schema(schema).option("multiLine", not lines).json(path)
