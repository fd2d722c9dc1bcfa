"""Small helpers for maps and values inside expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also when lambdas inside use it often."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def last_wins(entries: Column) -> Column:
    """Map of (key, value) entries; of entries with one key the last is kept."""

    def build(es: Column) -> Column:
        keep = F.filter(
            es,
            lambda e, i: ~F.exists(
                F.slice(es, i + 2, F.greatest(F.size(es) - i - 1, F.lit(0))),
                lambda later: later["key"] == e["key"],
            ),
        )
        return F.map_from_entries(keep)

    return let(entries, build)
