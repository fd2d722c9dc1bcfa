"""Exact ranks and running sums over groups of any size.

``row_number`` over a whole class sends the class to one task. Here rows are ordered by a hash, so
the leading digits of the hash cut every group into even buckets: sums per bucket give offsets, and
only the rows of one bucket are ever sorted together.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_DIGITS = 4  # hex digits: 65,536 buckets per group


def shuffle_key(key: Column, seed: int | str) -> Column:
    """Reproducible random order: md5 of the row key and a seed."""
    return F.md5(F.concat(key.cast("string"), F.lit(f"|{seed}")))


def join_safely(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, null being equal to null; the right side's keys are left out."""
    right = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    return left.join(right, on, how).drop(*[f"_right_{k}" for k in keys])


def running_total(
    df: DataFrame,
    keys: list[str],
    order: str,
    ties: list[str],
    value: Column | None = None,
    digits: int = BUCKET_DIGITS,
    attach: DataFrame | None = None,
    bucket: Column | None = None,
) -> DataFrame:
    """Adds ``before`` (sum of ``value`` over earlier rows of the group) and ``total``.

    ``order`` is a hex hash column; ``ties`` make the order unique. Null keys are a group of
    their own.
    ``attach`` (one row per group) adds its columns through the small table of bucket sums, so rows
    of a large group are never shuffled by the group alone. ``bucket`` replaces the hash prefix for an
    order that is not a hash; it must rise with the order.
    """
    value = F.lit(1) if value is None else value
    bucket = F.substring(F.col(order), 1, digits) if bucket is None else bucket
    rows = df.withColumn("_value", value.cast("bigint")).withColumn("_bucket", bucket)
    # Rows that tie in everything still take turns.
    inside = Window.partitionBy(*keys, "_bucket").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_local", F.sum("_value").over(inside) - F.col("_value"))
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    sums = (
        df.withColumn("_bucket", bucket)
        .groupBy(*keys, "_bucket")
        .agg(F.sum(value.cast("bigint")).alias("_sum"))
        .withColumn("_offset", F.sum("_sum").over(group.orderBy("_bucket")) - F.col("_sum"))
        .withColumn("total", F.sum("_sum").over(group))
        .drop("_sum")
    )
    if attach is not None:
        sums = join_safely(sums, attach, keys)
    return (
        join_safely(rows, sums, [*keys, "_bucket"])
        .withColumn("before", F.col("_offset") + F.col("_local"))
        .drop("_bucket", "_offset", "_local", "_value")
    )


def bucketed_rank(
    df: DataFrame,
    keys: list[str],
    order: str,
    ties: list[str],
    digits: int = BUCKET_DIGITS,
    attach: DataFrame | None = None,
) -> DataFrame:
    """Adds ``rank`` (1-based, exact) and ``total`` (group size)."""
    ranked = running_total(df, keys, order, ties, digits=digits, attach=attach)
    return ranked.withColumn("rank", F.col("before") + 1).drop("before")


def first_rows(df: DataFrame, keys: list[str], order: list[str | Column], k: int) -> DataFrame:
    """The first ``k`` rows of every group. Spark limits each group before the shuffle as well, so
    a group of any size sends at most ``k`` rows per input task."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k).drop("_n")


def running_last(
    df: DataFrame, keys: list[str], order: str, marks: dict[str, Column], chunk: int
) -> DataFrame:
    """Adds, per entry of ``marks``, the last non-null value up to and including the row.

    ``order`` is a whole-number position. A group is cut into chunks of ``chunk`` positions: the last
    value of each chunk is carried to later chunks through a small table, so a sheet of any length
    is filled in parallel.
    """
    rows = df.withColumn("_chunk", F.floor(F.col(order) / chunk))
    marked = rows.withColumns(
        {f"_m_{n}": F.when(c.isNotNull(), F.struct(F.col(order).alias("at"), c.alias("v"))) for n, c in marks.items()}
    )
    inside = Window.partitionBy(*keys, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    local = marked.withColumns({f"_l_{n}": F.max(f"_m_{n}").over(inside) for n in marks})
    tops = marked.groupBy(*keys, "_chunk").agg(*[F.max(f"_m_{n}").alias(f"_t_{n}") for n in marks])
    carried = tops.select(
        *keys, "_chunk", *[F.max(f"_t_{n}").over(earlier).alias(f"_c_{n}") for n in marks]
    )
    return join_safely(local, carried, [*keys, "_chunk"]).select(
        *df.columns, *[F.coalesce(f"_l_{n}", f"_c_{n}").alias(n) for n in marks]
    )
