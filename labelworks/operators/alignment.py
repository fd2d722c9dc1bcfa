"""Aligning raw gold maps with a codebook, row by row.

An item carries its raw gold as one map, and a codebook is one row of lookup maps
(:func:`codebooks.schema_rows`) joined by ``codebook_id``. Everything else is an expression on the
row: aligning or validating any number of items needs no shuffle of the items beyond that join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import gold_values
from ..functions.maps import last_wins
from ..functions.names import align_key, dimension_key, text_or_blank, trimmed
from .rank import first_rows

DROP_VALUE = "__drop__"
_STRINGS = "array<string>"
_TEXT_MAP = "map<string,string>"
_LABEL_MAPS = "map<string,map<string,string>>"
SPEC_COLUMNS = {
    "content_from": "string",
    "dim_map": _TEXT_MAP,
    "drop_dims": _STRINGS,
    "label_map": _LABEL_MAPS,
    "splits": _STRINGS,
}


def filter_gold_to_codebook(items: DataFrame, dims: DataFrame | None) -> DataFrame:
    """Keeps gold dimensions that the codebook defines, under the codebook's spelling.

    Without a codebook (None) gold stays as it is. Items and dims meet by ``codebook_id``.
    """
    if dims is None:
        return items
    keys = (
        dims.select("codebook_id", "dim", "sort_order", dimension_key(F.col("dim")).alias("k"))
        .groupBy("codebook_id", "k")
        .agg(F.max_by("dim", "sort_order").alias("dim"))
        .groupBy("codebook_id")
        .agg(F.map_from_entries(F.collect_list(F.struct("k", "dim"))).alias("_dims"))
    )
    named = F.filter(
        F.transform(
            F.map_entries("gold"),
            lambda e: F.struct(
                F.try_element_at(F.col("_dims"), dimension_key(e["key"])).alias("key"),
                e["value"].alias("value"),
            ),
        ),
        lambda e: e["key"].isNotNull(),
    )
    kept = F.when(F.col("_dims").isNull(), F.col("gold")).otherwise(last_wins(named))
    return items.join(keys, "codebook_id", "left").withColumn("gold", kept).select(*items.columns)


def make_spec(specs: DataFrame) -> DataFrame:
    """Transform specs, one row per codebook, with dimension and label names turned into keys.

    Columns: codebook_id, content_from, dim_map (source -> codebook dimension), drop_dims,
    label_map (dimension -> source label -> label or ``__drop__``), splits (separators in order).
    Missing columns count as empty.
    """
    for name, kind in SPEC_COLUMNS.items():
        value = F.col(name) if name in specs.columns else F.lit(None)
        specs = specs.withColumn(name, value.cast(kind))

    def by_key(m: Column) -> Column:
        return last_wins(
            F.transform(
                F.map_entries(m),
                lambda e: F.struct(align_key(e["key"]).alias("key"), e["value"].alias("value")),
            )
        )

    return specs.select(
        "codebook_id",
        "content_from",
        by_key(F.col("dim_map")).alias("dim_map"),
        F.transform("drop_dims", align_key).alias("drop_dims"),
        by_key(F.transform_values("label_map", lambda _, m: by_key(m))).alias("label_map"),
        F.filter("splits", lambda s: s != "").alias("splits"),
    )


def _with_schema(items: DataFrame, schema: DataFrame) -> DataFrame:
    """Items of an unknown codebook stay, with null lookup maps."""
    look = schema.select("codebook_id", F.col("dims").alias("_dims"), F.col("dim_keys").alias("_keys"))
    return items.join(look, "codebook_id", "left")


def _canonical(name: Column) -> Column:
    return F.when(F.map_contains_key(F.col("_dims"), name), name).otherwise(
        F.try_element_at(F.col("_keys"), align_key(name))
    )


def _split_all(values: Column, separators: Column) -> Column:
    """Each value split by every separator in turn; parts trimmed, blanks removed."""

    def step(parts: Column, sep: Column) -> Column:
        quoted = F.regexp_replace(sep, r"([!-/:-@\[-`{-~])", r"\\$1")
        return F.flatten(F.transform(parts, lambda v: F.split(v, quoted, -1)))

    cut = F.aggregate(separators, values, step)
    return F.filter(F.transform(cut, trimmed), lambda v: v != "")


def apply_transform(
    items: DataFrame,
    schema: DataFrame,
    spec: DataFrame | None = None,
    overrides: DataFrame | None = None,
) -> DataFrame:
    """Items with ``gold`` aligned to the codebook as ``map<string,array<string>>``.

    In order: content from metadata when blank; dropped and renamed dimensions; separators (only
    for dimensions that take several labels); label map or canonical spelling; repeats removed, one
    label kept for single-label dimensions; blanks filled with the no-label option; overrides per
    row (``overrides(codebook_id, idx, dimension, value)``; an empty value removes). Gold of items
    without a known codebook stays as it is, each value as a list.
    """
    rows = _with_schema(items, schema)
    blank_spec = {n: F.lit(None).cast(k) for n, k in SPEC_COLUMNS.items()}
    if spec is None:
        rows = rows.withColumns(blank_spec)
    else:
        rows = rows.join(spec.select("codebook_id", *SPEC_COLUMNS), "codebook_id", "left")
    rows = rows.withColumns(
        {
            "dim_map": F.coalesce("dim_map", F.create_map().cast(_TEXT_MAP)),
            "drop_dims": F.coalesce("drop_dims", F.array().cast(_STRINGS)),
            "label_map": F.coalesce("label_map", F.create_map().cast(_LABEL_MAPS)),
            "splits": F.coalesce("splits", F.array().cast(_STRINGS)),
        }
    )
    own = trimmed(text_or_blank(F.col("content")))
    moved = trimmed(text_or_blank(F.try_element_at("metadata", F.col("content_from"))))
    rows = rows.withColumn("content", F.when(own != "", own).otherwise(moved))

    def target(name: Column) -> Column:
        renamed = F.try_element_at(F.col("dim_map"), align_key(name))
        dim = F.when(F.coalesce(renamed, F.lit("")) != "", renamed).otherwise(_canonical(name))
        dropped = F.array_contains(F.col("drop_dims"), align_key(name))
        return F.when(~dropped & F.map_contains_key(F.col("_dims"), dim), dim)

    def aligned(entry: Column) -> Column:
        info = F.try_element_at(F.col("_dims"), entry["key"])
        raw = gold_values(entry["value"])
        values = F.when(
            ~info["single"] & (F.size("splits") > 0), _split_all(raw, F.col("splits"))
        ).otherwise(raw)
        remap = F.try_element_at(F.col("label_map"), align_key(entry["key"]))

        def one(v: Column) -> Column:
            to = F.try_element_at(remap, align_key(v))
            return F.when(to == DROP_VALUE, F.lit(None)).otherwise(
                F.coalesce(
                    F.when(to != "", to), F.try_element_at(info["labels"], align_key(v)), v
                )
            )

        labels = F.array_distinct(F.array_compact(F.transform(values, one)))
        return F.when(info["single"], F.slice(labels, 1, 1)).otherwise(labels)

    named = F.filter(
        F.transform(
            F.map_entries("gold"),
            lambda e: F.struct(target(e["key"]).alias("key"), e["value"].alias("value")),
        ),
        lambda e: e["key"].isNotNull(),
    )
    rows = rows.withColumn("_named", last_wins(named)).withColumn(
        "_gold",
        F.map_from_entries(
            F.transform(
                F.map_entries("_named"),
                lambda e: F.struct(e["key"].alias("key"), aligned(e).alias("value")),
            )
        ),
    )
    fill = F.filter(
        F.transform(
            F.map_entries("_dims"),
            lambda d: F.struct(d["key"].alias("key"), F.array(d["value"]["no_label"]).alias("value")),
        ),
        lambda d: F.get(d["value"], F.lit(0)).isNotNull()
        & ~F.exists(
            F.coalesce(F.try_element_at(F.col("_gold"), d["key"]), F.array().cast(_STRINGS)),
            lambda v: trimmed(v) != "",
        ),
    )
    rows = rows.withColumn(
        "_gold", last_wins(F.concat(F.map_entries("_gold"), fill))
    )
    if overrides is not None:
        # one value per dimension first, so that repeated overrides of a row stay small
        single = overrides.groupBy("codebook_id", "idx", "dimension").agg(F.max("value").alias("value"))
        per_row = single.groupBy("codebook_id", "idx").agg(
            F.collect_list(F.struct("dimension", "value")).alias("_over")
        )
        rows = rows.join(per_row, ["codebook_id", "idx"], "left")
        fixes = F.filter(
            F.transform(
                F.coalesce("_over", F.array().cast("array<struct<dimension:string,value:string>>")),
                lambda o: F.struct(_canonical(o["dimension"]).alias("key"), o["value"].alias("value")),
            ),
            lambda o: o["key"].isNotNull(),
        )
        snapped = F.transform(
            fixes,
            lambda o: F.struct(
                o["key"].alias("key"),
                F.when(
                    F.coalesce(o["value"], F.lit("")) != "",
                    F.array(
                        F.coalesce(
                            F.try_element_at(
                                F.try_element_at(F.col("_dims"), o["key"])["labels"],
                                align_key(o["value"]),
                            ),
                            o["value"],
                        )
                    ),
                ).alias("value"),
            ),
        )
        merged = last_wins(F.concat(F.map_entries("_gold"), snapped))
        rows = rows.withColumn("_gold", F.map_filter(merged, lambda _, v: v.isNotNull()))
    as_is = F.transform_values("gold", lambda _, v: gold_values(v))
    gold = F.when(F.col("_dims").isNull(), as_is).otherwise(F.col("_gold"))
    return rows.withColumn("gold", gold).select(*items.columns)


def canonicalize(items: DataFrame, schema: DataFrame) -> DataFrame:
    """Alignment with an empty spec: unknown dimensions go, labels take the codebook's spelling."""
    return apply_transform(items, schema)


# ---- validation ------------------------------------------------------------------------------

_ISSUE = "struct<severity:string,kind:string,dimension:string,value:string>"


def _issue(severity: str, kind: str, dimension: Column | None = None, value: Column | None = None) -> Column:
    blank = F.lit("")
    return F.struct(
        F.lit(severity).alias("severity"),
        F.lit(kind).alias("kind"),
        (blank if dimension is None else dimension).alias("dimension"),
        (blank if value is None else value).alias("value"),
    )


def _only(cond: Column, issue: Column) -> Column:
    return F.when(cond, F.array(issue)).otherwise(F.array().cast(f"array<{_ISSUE}>"))


def gold_issues(items: DataFrame, schema: DataFrame) -> DataFrame:
    """Items with an array column ``issues`` (severity, kind, dimension, value).

    Errors: missing_content, unknown_codebook, unknown_label, cardinality, unmatched_row. Warnings:
    unknown_dimension, missing_dimension. A blank value is an unknown label unless the dimension
    has a label with an empty key; ``null`` is no value.
    """
    rows = _with_schema(items, schema).withColumn(
        "_g",
        F.transform(
            F.map_entries("gold"),
            lambda e: F.struct(
                e["key"].alias("name"),
                _canonical(e["key"]).alias("dim"),
                e["value"].alias("raw"),
                gold_values(e["value"]).alias("vals"),
            ),
        ),
    )
    unknown = F.flatten(
        F.transform(
            "_g", lambda g: _only(g["dim"].isNull(), _issue("warn", "unknown_dimension", g["name"]))
        )
    )
    known = F.filter("_g", lambda g: g["dim"].isNotNull())

    def info(g: Column) -> Column:
        return F.try_element_at(F.col("_dims"), g["dim"])

    cardinality = F.flatten(
        F.transform(
            known,
            lambda g: _only(
                info(g)["single"] & (F.size(g["vals"]) > 1),
                _issue("error", "cardinality", g["dim"], g["raw"]),
            ),
        )
    )
    bad_labels = F.flatten(
        F.transform(
            known,
            lambda g: F.transform(
                F.filter(
                    g["vals"], lambda v: ~F.map_contains_key(info(g)["labels"], align_key(v))
                ),
                lambda v: _issue("error", "unknown_label", g["dim"], text_or_blank(v)),
            ),
        )
    )
    filled = F.transform(
        F.filter(known, lambda g: F.exists(g["vals"], lambda v: trimmed(text_or_blank(v)) != "")),
        lambda g: align_key(g["dim"]),
    )
    missing = F.transform(
        F.filter(F.map_entries("_keys"), lambda k: ~F.array_contains(F.col("_filled"), k["key"])),
        lambda k: _issue("warn", "missing_dimension", k["value"]),
    )
    no_content = _only(trimmed(text_or_blank(F.col("content"))) == "", _issue("error", "missing_content"))
    no_codebook = _issue("error", "unknown_codebook", None, text_or_blank(F.col("codebook_id").cast("string")))
    of_gold = F.concat(
        unknown,
        cardinality,
        bad_labels,
        _only((F.size("_g") > 0) & (F.size(known) == 0), _issue("error", "unmatched_row")),
        missing,
    )
    issues = F.concat(no_content, F.when(F.col("_dims").isNull(), F.array(no_codebook)).otherwise(of_gold))
    return rows.withColumn("_filled", filled).withColumn("issues", issues).select(
        *items.columns, "issues"
    )


def validation_report(items: DataFrame, schema: DataFrame) -> DataFrame:
    """Counts per codebook, kind, dimension and value, in one pass over the items.

    Besides the issue kinds the report holds ``items`` and ``error_items``.
    """
    flagged = gold_issues(items, schema)
    has_error = F.exists("issues", lambda i: i["severity"] == "error")
    rows = F.concat(
        F.col("issues").cast(f"array<{_ISSUE}>"),
        F.array(_issue("", "items")).cast(f"array<{_ISSUE}>"),
        _only(has_error, _issue("", "error_items")),
    )
    return (
        flagged.select("codebook_id", F.inline_outer(rows))  # never empty
        .groupBy("codebook_id", "severity", "kind", "dimension", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def validation_ok(report: DataFrame) -> DataFrame:
    """Per codebook: no errors at all (the two warnings do not matter)."""
    return report.groupBy("codebook_id").agg(
        F.coalesce(F.max(F.col("severity") == "error") == F.lit(False), F.lit(True)).alias("ok")
    )


def issue_samples(items: DataFrame, schema: DataFrame, k: int, width: int | None = None) -> DataFrame:
    """First ``k`` distinct texts per issue value, in item order; ``width`` shortens them."""
    text = trimmed(text_or_blank(F.col("content")))
    rows = gold_issues(items, schema).select(
        "codebook_id",
        "idx",
        (text if width is None else F.substring(text, 1, width)).alias("sample"),
        F.inline_outer("issues"),
    )
    return first_samples(
        rows.filter(F.col("kind").isin("unknown_label", "unknown_dimension", "missing_dimension")),
        ["codebook_id", "kind", "dimension", "value"],
        "sample",
        "idx",
        k,
    )


def first_samples(df: DataFrame, keys: list[str], col: str, order: str, k: int) -> DataFrame:
    """First ``k`` distinct non-blank values of ``col`` per key, by ``order``."""
    distinct = (
        df.filter(F.coalesce(col, F.lit("")) != "")
        .groupBy(*keys, col)
        .agg(F.min(order).alias(order))
    )
    return first_rows(distinct, keys, [order, col], k)
