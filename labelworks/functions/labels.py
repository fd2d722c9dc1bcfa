"""Looking up, comparing and choosing gold labels (Column -> Column).

Raw gold is ``map<string,string>``: dimension -> label, where a list of labels is kept as JSON text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import agreement_key, dimension_key, text_or_blank, trimmed

# Metadata columns in which coder sheets hold theme, level and quote.
THEME_COLUMNS = ["Coding theme", "coding theme", "Unnamed: 3"]
LEVEL_COLUMNS = ["Level", "level", "Label", "label", "Unnamed: 4"]
QUOTE_COLUMNS = ["Relevant quotes", "Relevant quotes ", "quote", "Quote", "Unnamed: 6"]


def _lit(c: Column | str) -> Column:
    return F.lit(c) if isinstance(c, str) else c


def label_for(gold: Column, dimension: Column | str) -> Column:
    """The map's value under the exact name, else under the first name with an equal key."""
    dimension = _lit(dimension)
    near = F.filter(
        F.map_entries(gold), lambda e: dimension_key(e["key"]) == dimension_key(dimension)
    )
    return F.when(
        F.map_contains_key(gold, dimension), F.try_element_at(gold, dimension)
    ).otherwise(F.get(near, F.lit(0))["value"])


def is_gold_list(raw: Column) -> Column:
    """True when the raw gold text is a JSON list."""
    return F.coalesce(
        F.ltrim(raw).startswith("[") & F.json_array_length(raw).isNotNull(), F.lit(False)
    )


def gold_values(raw: Column) -> Column:
    """The labels of one raw gold text as an array: list as is, one label alone, null empty."""
    return (
        F.when(raw.isNull(), F.array().cast("array<string>"))
        .when(is_gold_list(raw), F.from_json(raw, "array<string>"))
        .otherwise(F.array(raw))
    )


def embedded_labels(gold_labels: Column, labels: Column | None = None) -> Column:
    """Label map held as JSON text in a cell; the first non-empty cell counts, bad text is empty."""
    cell = gold_labels if labels is None else F.when(
        F.coalesce(gold_labels, F.lit("")) != "", gold_labels
    ).otherwise(labels)
    whole = F.json_array_length(F.concat(F.lit("["), cell, F.lit("]"))) == 1
    parsed = F.when(
        whole & F.json_object_keys(cell).isNotNull(), F.from_json(cell, "map<string,string>")
    )
    return F.coalesce(parsed, F.create_map().cast("map<string,string>"))


def _first_nonblank(metadata: Column, names: list[str]) -> Column:
    cells = [trimmed(F.try_element_at(metadata, F.lit(n))) for n in names]
    return F.coalesce(*[F.when(c != "", c) for c in cells], F.lit(""))


def gold_from_metadata(metadata: Column, dimension: Column | str) -> Column:
    """Label of a coder row that keeps theme and level in metadata; '' when the theme differs."""
    theme = _first_nonblank(metadata, THEME_COLUMNS)
    level = _first_nonblank(metadata, LEVEL_COLUMNS)
    return F.when(dimension_key(theme) == dimension_key(_lit(dimension)), level).otherwise("")


def display_text(metadata: Column, content: Column) -> Column:
    """A quote found in metadata, else the content."""
    quote = _first_nonblank(metadata, QUOTE_COLUMNS)
    return F.when(quote != "", quote).otherwise(content)


def labels_agree(predicted: Column, gold: Column) -> Column:
    """Both present and equal under the agreement key (two fillers alone agree as well)."""
    p, g = text_or_blank(predicted), text_or_blank(gold)
    return (p != "") & (g != "") & (agreement_key(p) == agreement_key(g))


def match_status(predicted: Column, gold: Column, gold_is_list: Column) -> Column:
    """missing / match / partial / mismatch. ``gold`` is an array; a list never gives ``match``."""
    hit = F.exists(gold, lambda g: labels_agree(predicted, g))
    empty = (F.size(gold) == 0) | (~gold_is_list & (text_or_blank(F.get(gold, F.lit(0))) == ""))
    return (
        F.when(F.coalesce(empty, F.lit(True)), F.lit("missing"))
        .when(hit & gold_is_list, F.lit("partial"))
        .when(hit, F.lit("match"))
        .otherwise(F.lit("mismatch"))
    )


def metric_target(predicted: Column, gold: Column) -> Column:
    """Label to score against: the prediction's own spelling if any gold label agrees."""
    hit = F.exists(gold, lambda g: labels_agree(predicted, g))
    return F.when(hit, predicted).otherwise(text_or_blank(F.get(gold, F.lit(0))))
