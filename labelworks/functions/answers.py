"""Turning raw labeler answers and raw coder values into codebook labels (Column -> Column).

``labels`` is an ``array<string>`` column in codebook order, so one expression serves rows that
have different options. A regular expression is built only for labels that occur in the text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .labels import gold_values
from .maps import let
from .names import plain_key, text_or_blank, trimmed, words

# Answers that mean "no label applies".
NO_LABEL_PHRASES = [
    "no label",
    "none",
    "n/a",
    "na",
    "not applicable",
    "not apply",
    "does not apply",
    "no applicable label",
    "no labels",
]
# Whole answers that mean an empty label set.
EMPTY_SET_PHRASES = ["none", "n a", "na"]
# How an answer line and a score are recognised.
ANSWER_LINE = r"(?i)answer[:\s]+([^\n]+)"
SCORE = r"[01](?:\.[0-9]+)?"

_WORD = r"[\p{L}\p{N}_]"
_NOT_WORD = r"[^\p{L}\p{N}_]"


def options(labels: list[str] | Column) -> Column:
    """A Python list as an array column; a column stays as it is."""
    if isinstance(labels, Column):
        return labels
    return F.array(*[F.lit(x) for x in labels]).cast("array<string>")


def is_binary(labels: Column) -> Column:
    return (F.size(labels) == 2) & F.exists(labels, lambda x: F.contains(F.lower(x), F.lit("yes")))


def _quoted(label: Column) -> Column:
    return F.regexp_replace(label, r"([!-/:-@\[-`{-~])", r"\\$1")


def _last_start(text: Column, word: Column) -> Column:
    """0-based start of the last whole-word occurrence, ignoring case; -1 when absent."""
    starts_word = F.regexp_like(word, F.lit(f"^{_WORD}"))
    ends_word = F.regexp_like(word, F.lit(f"{_WORD}$"))
    before = F.when(starts_word, F.lit(rf"(?:.*{_NOT_WORD})?")).otherwise(F.lit(rf".*{_WORD}"))
    after = F.when(ends_word, F.lit(rf"(?!{_WORD})")).otherwise(F.lit(rf"(?={_WORD})"))
    pattern = F.concat(F.lit("(?isu)^("), before, F.lit(")"), _quoted(word), after)
    found = (word != "") & F.contains(F.lower(text), F.lower(word))
    return F.when(
        F.coalesce(found, F.lit(False)) & F.regexp_like(text, pattern),
        F.length(F.call_function("regexp_extract", text, pattern, F.lit(1))),
    ).otherwise(F.lit(-1))


def last_label_in(text: Column, labels: list[str] | Column) -> Column:
    """The label mentioned last in the text; on equal starts the earlier label; else null."""
    labels = options(labels)
    spots = F.transform(
        labels,
        lambda x, i: F.struct(_last_start(text, x).alias("at"), (-i).alias("first"), x.alias("x")),
    )
    best = F.array_max(spots)
    return F.when(best["at"] >= 0, best["x"])


def yes_no(text: Column, labels: list[str] | Column) -> Column:
    """Yes/no answers: the later of the two words picks the label that contains it."""
    labels = options(labels)
    yes, no = _last_start(text, F.lit("yes")), _last_start(text, F.lit("no"))

    def pick(word: str, fallback: Column) -> Column:
        having = F.filter(labels, lambda x: F.contains(F.lower(x), F.lit(word)))
        return F.coalesce(F.get(having, F.lit(0)), fallback)

    return (
        F.when((yes < 0) & (no < 0), F.lit(None).cast("string"))
        .when(yes > no, pick("yes", F.get(labels, F.lit(0))))
        .otherwise(pick("no", F.try_element_at(labels, F.lit(-1))))
    )


def is_no_label(text: Column) -> Column:
    """One of the fixed phrases that mean no label, after cleaning."""
    clean = F.regexp_replace(F.lower(text), "[^a-z0-9/ ]+", " ")
    return F.trim(F.regexp_replace(clean, " +", " ")).isin(NO_LABEL_PHRASES)


def answer_line(response: Column) -> Column:
    """Text after the last ``answer:``, without final dots; null when there is none."""
    hits = F.regexp_extract_all(response, F.lit(ANSWER_LINE), F.lit(1))
    return F.regexp_replace(trimmed(F.try_element_at(hits, F.lit(-1))), r"\.+$", "")


def parse_answer(
    response: Column, labels: list[str] | Column, binary: Column | bool | None = None
) -> Column:
    """Codebook label in a free-text answer, or the raw answer when no label is found."""
    labels = options(labels)
    binary = is_binary(labels) if binary is None else F.lit(binary) if isinstance(
        binary, bool
    ) else binary
    no_label = F.get(F.filter(labels, lambda x: F.lower(trimmed(x)) == "no label"), F.lit(0))

    def choose(answer: Column) -> Column:
        exact = F.get(F.filter(labels, lambda x: F.lower(x) == F.lower(answer)), F.lit(0))
        inside = F.get(F.filter(labels, lambda x: _last_start(answer, x) >= 0), F.lit(0))
        from_answer = F.when(no_label.isNotNull() & is_no_label(answer), no_label).otherwise(
            F.when(binary, yes_no(answer, labels)).otherwise(F.coalesce(exact, inside))
        )
        from_text = F.when(binary, yes_no(response, labels)).otherwise(
            last_label_in(response, labels)
        )
        raw = F.when(text_or_blank(answer) != "", answer).otherwise(response)
        return F.coalesce(F.when(answer.isNotNull(), from_answer), from_text, trimmed(raw))

    return let(answer_line(response), choose)


def match_label(value: Column, labels: list[str] | Column) -> Column:
    """Codebook label for a raw coder value: equal key, else contained words, else null."""
    labels = options(labels)
    keyed = F.transform(
        labels, lambda x, i: F.struct(i.alias("i"), x.alias("x"), plain_key(x).alias("k"))
    )

    def choose(key: Column) -> Column:
        tokens = words(key)
        exact = F.get(F.filter(keyed, lambda k: k["k"] == key), F.lit(0))["x"]
        inner = F.array_max(
            F.transform(
                F.filter(keyed, lambda k: F.size(F.array_except(words(k["k"]), tokens)) == 0),
                lambda k: F.struct(
                    F.size(words(k["k"])).alias("n"), (-k["i"]).alias("i"), k["x"].alias("x")
                ),
            )
        )["x"]
        distinct = F.array_distinct(tokens)
        outer = F.array_min(
            F.transform(
                F.filter(keyed, lambda k: F.size(F.array_except(distinct, words(k["k"]))) == 0),
                lambda k: F.struct(
                    F.size(F.array_distinct(words(k["k"]))).alias("n"),
                    k["i"].alias("i"),
                    k["x"].alias("x"),
                ),
            )
        )["x"]
        return F.coalesce(
            exact, F.when(inner != "", inner), F.when((F.size(tokens) > 0) & (outer != ""), outer)
        )

    return let(plain_key(value), choose)


def parse_label_set(response: Column, labels: list[str] | Column) -> Column:
    """All codebook labels named in an answer, in codebook order."""
    labels = options(labels)

    def choose(text: Column) -> Column:
        key = plain_key(text)
        parts = F.transform(F.split(text, r"[|\n]"), lambda p: match_label(p, labels))
        named = let(
            F.struct(F.array_compact(parts).alias("parts"), key.alias("key")),
            lambda s: F.filter(
                labels,
                lambda x: F.array_contains(s["parts"], x)
                | ((plain_key(x) != "") & F.contains(s["key"], plain_key(x))),
            ),
        )
        empty = (text == "") | key.isin(EMPTY_SET_PHRASES)
        return F.when(empty, F.array().cast("array<string>")).otherwise(F.array_distinct(named))

    return let(trimmed(text_or_blank(response)), choose)


def canonical_labels(values: Column, labels: list[str] | Column) -> Column:
    """Values with an equal key in the codebook, in value order, each label once."""
    labels = options(labels)

    def one(v: Column) -> Column:
        return F.try_element_at(F.filter(labels, lambda x: plain_key(x) == plain_key(v)), F.lit(-1))

    found = F.array_compact(F.transform(values, one))
    return F.array_distinct(F.filter(found, lambda x: x != ""))


def gold_set(gold: Column, dimension: Column | str, labels: list[str] | Column) -> Column:
    """Codebook labels of one dimension of a raw gold map, sorted, each once."""
    labels = options(labels)
    name = F.lit(dimension) if isinstance(dimension, str) else dimension
    near = F.filter(F.map_entries(gold), lambda e: plain_key(e["key"]) == plain_key(name))
    raw = F.coalesce(F.try_element_at(gold, name), F.get(near, F.lit(0))["value"])
    found = F.transform(gold_values(raw), lambda v: match_label(v, labels))
    return F.array_sort(F.array_distinct(F.filter(F.array_compact(found), lambda x: x != "")))


def parse_score(response: Column) -> Column:
    """First number between 0 and 1.9 in the text, else one half."""
    return F.coalesce(
        F.regexp_extract(response, f"({SCORE})", 1).try_cast("double"), F.lit(0.5)
    )


def _unfenced(text: Column) -> Column:
    s = trimmed(text)
    body = F.regexp_replace(s, r"^[^\n]*\n", "")
    cut = F.regexp_replace(body, r"(?s)^(.*)```.*$", "$1")
    return F.when(s.startswith("```"), trimmed(cut)).otherwise(s)


def _strict_json(c: Column) -> Column:
    """The candidate when it is exactly one JSON value (raw control characters allowed)."""
    clean = F.regexp_replace(c, r"[\x00-\x1f]", " ")
    return F.when(F.json_array_length(F.concat(F.lit("["), clean, F.lit("]"))) == 1, c)


def json_object_payload(response: Column) -> Column:
    """JSON object text in an answer: the whole text, else the outermost braces."""
    s = _unfenced(response)
    whole = F.when(s.startswith("{"), _strict_json(s))
    braces = _strict_json(F.nullif(F.regexp_extract(s, r"(?s)(\{.*\})", 1), F.lit("")))
    return F.coalesce(whole, braces)


def json_array_payload(response: Column) -> Column:
    """JSON array text in an answer; an array that was cut off is closed after its last object."""
    s = _unfenced(response)
    whole = F.nullif(F.regexp_extract(s, r"(?s)(\[.*)$", 1), F.lit(""))
    closed = F.concat(F.nullif(F.regexp_extract(s, r"(?s)(\[.*\})", 1), F.lit("")), F.lit("]"))
    shut = F.nullif(F.regexp_extract(s, r"(?s)(\[.*\])", 1), F.lit(""))
    return F.coalesce(_strict_json(whole), _strict_json(closed), _strict_json(shut))

