"""Column functions: name keys, label comparison, answer parsing, small text helpers."""

from .answers import (
    gold_set,
    is_binary,
    is_no_label,
    canonical_labels,
    json_array_payload,
    json_object_payload,
    last_label_in,
    match_label,
    parse_answer,
    parse_label_set,
    parse_score,
    yes_no,
)
from .labels import (
    display_text,
    embedded_labels,
    gold_from_metadata,
    gold_values,
    is_gold_list,
    label_for,
    labels_agree,
    match_status,
    metric_target,
)
from .names import (
    agreement_key,
    align_key,
    dimension_key,
    first_word,
    gate_key,
    header_key,
    plain_key,
    sheet_label,
    trimmed,
)
from .texts import model_input, rough_tokens

__all__ = [
    "agreement_key",
    "align_key",
    "canonical_labels",
    "dimension_key",
    "display_text",
    "embedded_labels",
    "first_word",
    "gate_key",
    "gold_from_metadata",
    "gold_set",
    "gold_values",
    "header_key",
    "is_binary",
    "is_gold_list",
    "is_no_label",
    "json_array_payload",
    "json_object_payload",
    "label_for",
    "labels_agree",
    "last_label_in",
    "match_label",
    "match_status",
    "metric_target",
    "model_input",
    "parse_answer",
    "parse_label_set",
    "parse_score",
    "plain_key",
    "rough_tokens",
    "sheet_label",
    "trimmed",
    "yes_no",
]
