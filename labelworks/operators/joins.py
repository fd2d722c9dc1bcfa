"""Joins between predictions, items, gold and coders.

No broadcast hints: Catalyst and adaptive execution broadcast a side only when its measured size is
under the session's threshold, and split skewed keys otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import (
    display_text,
    gold_from_metadata,
    gold_values,
    is_gold_list,
    label_for,
    match_status,
)
from ..functions.names import dimension_key, text_or_blank


def with_items(predictions: DataFrame, items: DataFrame) -> DataFrame:
    return predictions.join(items, "item_id")


def with_gold(predictions: DataFrame, items: DataFrame) -> DataFrame:
    """Adds the item's raw gold map; predictions without gold stay with an empty one."""
    gold = items.select("item_id", "gold")
    empty = F.create_map().cast("map<string,string>")
    return predictions.join(gold, "item_id", "left").withColumn("gold", F.coalesce("gold", empty))


def gold_by_text(gold_items: DataFrame) -> DataFrame:
    """One gold map per text: that of the lowest item id. Keyed by a hash of the text."""
    return (
        gold_items.filter((F.col("content") != "") & (F.size("gold") > 0))
        .select(F.sha2("content", 256).alias("text_key"), "item_id", "gold")
        .groupBy("text_key")
        .agg(F.min_by(F.map_entries("gold"), "item_id").alias("g"))
        .select("text_key", F.map_from_entries("g").alias("text_gold"))
    )


def with_gold_fallback(
    predictions: DataFrame, items: DataFrame, gold_items: DataFrame, dimension: str | None = None
) -> DataFrame:
    """Gold of the item itself, else of a gold item with the same text, else from metadata.

    Adds ``gold`` (array), ``gold_is_list``, ``gold_label`` and the item's display columns. Texts
    meet through their SHA-256, so no long text is shuffled as a key.
    """
    if dimension is not None:
        predictions = predictions.filter(dimension_key(F.col("dimension")) == _key(dimension))
    joined = with_items(predictions, items.drop("gold")).join(
        resolved_gold(items, gold_items), "item_id", "left"
    )
    asked = F.lit(dimension) if dimension is not None else F.col("dimension")
    raw = label_for(F.col("gold_map"), asked)
    meta = gold_from_metadata(F.col("metadata"), asked)
    joined = joined.withColumn("_raw", raw).withColumn("_vals", gold_values(F.col("_raw")))
    shown = F.array_join("_vals", ", ")
    from_meta = shown == ""
    return joined.select(
        *predictions.columns,
        display_text(F.col("metadata"), F.col("content")).alias("content"),
        text_or_blank(F.col("context")).alias("context"),
        F.when(from_meta, F.array(meta)).otherwise(F.col("_vals")).alias("gold"),
        F.when(from_meta, F.lit(False)).otherwise(is_gold_list(F.col("_raw"))).alias("gold_is_list"),
        F.when(from_meta, meta).otherwise(shown).alias("gold_label"),
    )


def resolved_gold(items: DataFrame, gold_items: DataFrame) -> DataFrame:
    """(item_id, gold_map): the item's own gold, else that of a gold item with the same text.

    Only ids, hashes and maps are shuffled. Items that need no lookup get a key of their own, so
    they spread evenly instead of meeting under one empty key.
    """
    own = F.size("gold") > 0
    wanted = F.when(~own & (F.col("content") != ""), F.sha2("content", 256))
    keyed = items.select(
        "item_id",
        F.when(own, F.col("gold")).alias("_own"),
        F.coalesce(wanted, F.concat(F.lit("own "), F.col("item_id").cast("string"))).alias("text_key"),
    )
    return keyed.join(gold_by_text(gold_items), "text_key", "left").select(
        "item_id", F.coalesce("_own", "text_gold").alias("gold_map")
    )


def _key(name: str) -> Column:
    return dimension_key(F.lit(name))


def evidence(
    predictions: DataFrame,
    items: DataFrame,
    gold_items: DataFrame,
    dimension: str,
    review_only: bool = False,
) -> DataFrame:
    """Predictions of one dimension with text, gold and match status (unsorted).

    ``review_order`` holds the sort columns of the review page: mismatches first, then by item.
    """
    rows = with_gold_fallback(predictions, items, gold_items, dimension)
    status = match_status(text_or_blank(F.col("label")), F.col("gold"), F.col("gold_is_list"))
    rows = rows.withColumn("match_status", status)
    if review_only:
        rows = rows.filter(F.col("match_status").isin("mismatch", "partial"))
    return rows.withColumn("is_mismatch", F.col("match_status") == "mismatch")


def review_order() -> list[Column]:
    return [F.col("is_mismatch").desc(), F.col("item_id"), F.col("step_order")]


def join_by_key(
    left: DataFrame,
    right: DataFrame,
    on: str,
    key: Callable[[Column], Column],
    scope: list[str] = (),
) -> DataFrame:
    """Left join on a name: a row with the exact name wins over rows that share its key.

    ``right`` holds one row per (scope, name); of several names with one key the last (by name)
    is used. Columns of ``right`` other than the name and scope are added.
    """
    scope = list(scope)
    value_cols = [c for c in right.columns if c not in (*scope, on)]
    packed = right.select(
        *scope, F.col(on).alias("_name"), key(F.col(on)).alias("_key"), F.struct(on, *value_cols).alias("_v")
    )
    exact = packed.select(*scope, F.col("_name").alias(on), F.col("_v").alias("_exact"))
    near = packed.groupBy(*scope, "_key").agg(F.max_by("_v", "_name").alias("_near"))
    out = (
        left.withColumn("_key", key(F.col(on)))
        .join(exact, [*scope, on], "left")
        .join(near, [*scope, "_key"], "left")
        .withColumn("_hit", F.coalesce("_exact", "_near"))
    )
    return out.select(
        *left.columns,
        F.col(f"_hit.{on}").alias("matched_name"),
        *[F.col(f"_hit.{c}").alias(c) for c in value_cols],
    )


def pair_coders(gold: DataFrame, a: str, b: str, dimension: str | None = None) -> DataFrame:
    """One row per item and dimension labeled by both coders, with all non-empty labels of each.

    Several different labels of a coder are one text in order, joined by "; ", so that coders agree
    when their sets are equal. A single aggregation by item, no self-join.
    """

    rows = gold.filter(F.col("coder").isin(a, b) & (F.coalesce("label", F.lit("")) != ""))
    if dimension is not None:
        rows = rows.filter(F.col("dimension") == dimension)
    # what is collected are labels of a codebook, each once
    def labels_of(coder: str) -> Column:
        found = F.collect_set(F.when(F.col("coder") == coder, F.col("label")))
        return F.nullif(F.array_join(F.array_sort(found), "; "), F.lit(""))

    return (
        rows.groupBy("item_id", "dimension")
        .agg(labels_of(a).alias("label_a"), labels_of(b).alias("label_b"))
        .filter(F.col("label_a").isNotNull() & F.col("label_b").isNotNull())
    )


def shared_items(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("item_id").intersect(b.select("item_id"))


def exclude_holdout(gold: DataFrame, holdout: DataFrame) -> DataFrame:
    return gold.join(holdout.select("item_id"), "item_id", "left_anti")


def split_overlap(assigned: DataFrame) -> DataFrame:
    """Source ids that sit in more than one split (empty when the split is clean)."""
    spread = assigned.groupBy("source_id").agg(
        F.min("split").alias("first_split"), F.max("split").alias("last_split")
    )
    return spread.filter(F.col("first_split") != F.col("last_split"))


def page(df: DataFrame, order: list[str | Column], limit: int, offset: int = 0) -> DataFrame:
    """One page of rows; only offset + limit rows per task are kept while sorting."""
    return df.orderBy(*order).offset(offset).limit(limit)


def cross_candidates(candidates: DataFrame, examples: DataFrame) -> DataFrame:
    """Every candidate labeler of a dimension with every example of that dimension."""
    return examples.join(candidates, "dimension")


def purge(tables: dict[str, DataFrame], removed: DataFrame, key: str) -> dict[str, DataFrame]:
    """Drops the rows of removed datasets or projects from every table; all carry the key.

    Tuning runs keep their history: their gold link is set to null instead. A table without the key
    raises, as its rows would outlive what they belong to: ``purge_tree`` follows the links between tables.
    """
    gone = removed.select(key).distinct()
    out = {}
    for name, df in tables.items():
        if name == "runs" and f"gold_{key}" in df.columns:
            link = gone.select(F.col(key).alias(f"gold_{key}"), F.lit(True).alias("_gone"))
            kept = df.join(link, f"gold_{key}", "left")
            out[name] = kept.withColumn(
                f"gold_{key}", F.when(F.col("_gone").isNull(), F.col(f"gold_{key}"))
            ).select(*df.columns)
        elif key in df.columns:
            out[name] = df.join(gone, key, "left_anti").select(*df.columns)
        else:
            raise ValueError(f"{name} has no column {key}: use purge_tree")
    return out


def purge_tree(
    tables: dict[str, DataFrame], removed: DataFrame, root: str, key: str, links: list[tuple[str, str, str, str]]
) -> dict[str, DataFrame]:
    """Drops the removed rows of ``root`` and everything below them.

    ``removed`` holds values of ``key``. ``links(child, column, parent, parent_key)`` stand in order
    from the root down; rows of a child go with the parent row they name. Rows without a link stay.
    """
    out = dict(tables)
    out[root] = tables[root].join(removed.select(key).distinct(), key, "left_anti").select(*tables[root].columns)
    gone = {root: tables[root].join(removed.select(key).distinct(), key, "left_semi")}
    for child, column, parent, parent_key in links:
        dead = gone[parent].select(F.col(parent_key).alias(column)).distinct()
        lost = out[child].join(dead, column, "left_semi").select(*tables[child].columns)
        gone[child] = gone[child].unionByName(lost) if child in gone else lost
        out[child] = out[child].join(dead, column, "left_anti").select(*tables[child].columns)
    return out
