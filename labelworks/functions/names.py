"""The eight name keys used to match dimensions and labels (Column -> Column).

They differ on purpose: mixing them changes which names meet. All of them are plain expressions,
so a key can be computed inside a scan, a join condition or a higher-order function.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that count as white space at the ends of a text.
SPACE_CLASS = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
SPACE_CHARACTERS = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)
# Words that carry no meaning when two labels are compared.
LABEL_FILLER_WORDS = ["layer", "level", "label", "category"]
# Suffixes removed from sheet labels.
SHEET_SUFFIXES = [" layer", " level"]


def trimmed(c: Column) -> Column:
    """Text without white space (of any script) at either end."""
    return F.btrim(c, F.lit(SPACE_CHARACTERS))


def text_or_blank(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def casefold(c: Column) -> Column:
    """Lower case with the two folds that end in plain letters (sharp s, long s)."""
    return F.replace(F.translate(F.lower(c), "ſ", "s"), F.lit("ß"), F.lit("ss"))


def squeezed(c: Column) -> Column:
    """Runs of characters outside 0-9, a-z, A-Z become one space; ends are clean."""
    return F.trim(F.regexp_replace(c, "[^0-9a-zA-Z]+", " "))


def words(c: Column) -> Column:
    """Tokens of a squeezed text; an empty text has none."""
    return F.filter(F.split(c, " "), lambda t: t != "")


def _singular(t: Column) -> Column:
    n = F.length(t)
    return (
        F.when((n > 4) & t.endswith("ies"), F.concat(F.substring(t, F.lit(1), n - 3), F.lit("y")))
        .when((n > 3) & t.endswith("s") & ~t.endswith("ss"), F.substring(t, F.lit(1), n - 1))
        .otherwise(t)
    )


def align_key(c: Column) -> Column:
    """Case, punctuation and simple plurals are ignored."""
    return F.array_join(F.transform(words(squeezed(casefold(text_or_blank(c)))), _singular), " ")


def dimension_key(c: Column) -> Column:
    """Anything in parentheses is ignored, then case and punctuation."""
    return F.lower(squeezed(F.regexp_replace(text_or_blank(c), r"\([^)]*\)", " ")))


def agreement_key(c: Column) -> Column:
    """Case, punctuation and filler words are ignored; repeats stay."""
    tokens = words(squeezed(casefold(text_or_blank(c))))
    return F.array_join(F.filter(tokens, lambda t: ~t.isin(LABEL_FILLER_WORDS)), " ")


def plain_key(c: Column) -> Column:
    """Case and punctuation are ignored."""
    return F.lower(squeezed(text_or_blank(c)))


def gate_key(c: Column) -> Column:
    """As ``plain_key``; each word also loses one final s unless nothing would be left."""

    def drop_s(t: Column) -> Column:
        return F.when(
            t.endswith("s") & (F.length(t) > 1), F.substring(t, F.lit(1), F.length(t) - 1)
        ).otherwise(t)

    return F.array_join(F.transform(words(squeezed(casefold(text_or_blank(c)))), drop_s), " ")


def header_key(c: Column) -> Column:
    """Column headers: ends, case and underscores are ignored."""
    return F.translate(F.lower(trimmed(text_or_blank(c))), "_", " ")


def title_case(c: Column) -> Column:
    """A letter after a non-letter is upper case, every other letter lower case."""
    parts = F.regexp_extract_all(F.lower(c), F.lit(r"([^\p{L}]*\p{L}*)"), F.lit(1))

    def raise_first(p: Column) -> Column:
        lead = F.length(F.regexp_extract(p, r"^([^\p{L}]*)", 1))
        return F.concat(
            F.substring(p, F.lit(1), lead),
            F.upper(F.substring(p, lead + 1, F.lit(1))),
            F.substring(p, lead + 2, F.length(p)),
        )

    return F.array_join(F.transform(parts, raise_first), "")


def sheet_label(c: Column) -> Column:
    """Coder-sheet spelling: yes/no answers, then ``... layer``/``... level`` in title case."""
    s = trimmed(text_or_blank(c))
    low = F.lower(s)
    out = F.when(low.startswith("yes"), F.lit("Yes")).when(low.startswith("no"), F.lit("No"))
    for suffix in SHEET_SUFFIXES:
        cut = trimmed(F.substring(s, F.lit(1), F.length(s) - len(suffix)))
        out = out.when(low.endswith(suffix), title_case(cut))
    return out.otherwise(s)


def first_word(c: Column) -> Column:
    """First white-space separated token; null for null or blank text."""
    s = trimmed(c)
    return F.when(s != "", F.split(s, f"{SPACE_CLASS}+")[0])
