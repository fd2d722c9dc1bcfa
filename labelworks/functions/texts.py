"""Model input text and rough token counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import text_or_blank

CHARACTERS_PER_TOKEN = 5


def model_input(content: Column, context: Column, prior: list[tuple[str, Column]] = ()) -> Column:
    """Text sent to a labeler: context if present, the sentence, labels already decided."""
    body = F.concat(F.lit("Sentence: "), content)
    ctx = text_or_blank(context)
    body = F.when(ctx != "", F.concat(F.lit("Context: "), ctx, F.lit("\n\n"), body)).otherwise(body)
    if not prior:
        return body
    known = F.array_join(
        F.array_compact(
            F.array(
                *[
                    F.when(text_or_blank(v) != "", F.concat(F.lit(f"{d} = "), v))
                    for d, v in prior
                ]
            )
        ),
        "; ",
    )
    tail = F.concat(F.lit("\n\nAlready determined: "), known, F.lit("."))
    return F.when(known != "", F.concat(body, tail)).otherwise(body)


def rough_tokens(text: Column) -> Column:
    """About one token per five characters, half-even, at least one."""
    n = F.length(text_or_blank(text)).cast("double") / CHARACTERS_PER_TOKEN
    return F.greatest(F.lit(1).cast("bigint"), F.bround(n, 0).cast("bigint"))
