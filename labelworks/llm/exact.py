"""Exact dedup by an extendible-hash index on shared files; DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelworks.llm.common import written

WHITE_SPACE = r"[\x20\x09-\x0D]+"
BITMAP_BITS = 1 << 22  # bits of the table of repeated keys: 512 KiB for any number of rows
BITMAP_ROW = 32768  # bits per row of that table, fixed by Spark's bitmap functions


def normalized(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_SPACE, "")


def directory(entries: DataFrame, capacity: int, max_depth: int) -> DataFrame:
    """Directory of an extendible-hash index: (cell, bucket, local_depth), at most 2^max_depth rows.

    It starts as one bucket. Whenever a bucket holds more than ``capacity`` entries it splits on the
    next bit of the key, and the directory doubles when a split needs a bit that it doesn't have. The
    depth at which the splitting of a cell ends is the first at which its prefix is not overfull, so
    all splits follow from one count per cell. Buckets that are overfull at ``max_depth`` stay so.
    """
    cells = entries.groupBy("cell").agg(F.count("*").alias("n"))
    tries = cells.select("cell", "n", F.explode(F.sequence(F.lit(0), F.lit(max_depth))).alias("depth"))
    tries = tries.withColumn("prefix", F.expr(f"shiftright(cell, {max_depth} - depth)"))
    held = tries.groupBy("depth", "prefix").agg(F.sum("n").alias("held"))
    fits = (F.col("held") <= capacity) | (F.col("depth") == max_depth)
    return (
        tries.join(held.filter(fits), ["depth", "prefix"])
        .groupBy("cell")
        .agg(F.min("depth").cast("int").alias("local_depth"))
        .withColumn("bucket", F.expr(f"shiftleft(shiftright(cell, {max_depth} - local_depth), {max_depth} - local_depth)"))
    )


@dataclass
class ExactIndex:
    """``files``: one row per (bucket, key, link), a link being one text of the chain of its key, with
    the rows it stands for. ``groups``: the texts of keys that more than one row has, compared byte for
    byte. ``rows``: id, key and hash of every document."""

    files: DataFrame
    groups: DataFrame
    rows: DataFrame


def build_index(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 100_000,
    max_depth: int = 12,
) -> ExactIndex:
    """Indexes whole normalised texts by a 64-bit key.

    1. Rows are reduced to (key, hash, number, best row) before any shuffle, so a group of copies of any
       size is one entry; the directory is built from counts of entries.
    2. Owner tasks take ranges of buckets (= ranges of keys) and write them as files of the index.
       Within a key, entries are chained: link 1, 2, ...
    3. Texts are compared byte for byte where a key has more than one row. A table of ``BITMAP_BITS``
       bits marks such keys; rows that it rules out do not send their text through a shuffle. Rows that
       it lets through needlessly form groups of one. Copies meet as one row per task.
    """
    norm = normalized(F.col(text_col))
    base = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("n_chars"),
        norm.alias("norm"),
    ).withColumn("key", F.xxhash64("norm"))
    # Longest text first, then the smallest id; null ids come last.
    best = F.max(F.struct("n_chars", F.bitwise_not(F.col("doc_id")).alias("low"))).alias("best")
    rows = written(
        base.select("doc_id", "n_chars", "key", F.sha2("norm", 256).alias("text_sha256")), "exact-rows"
    )
    entries = written(
        rows.groupBy("key", "text_sha256")
        .agg(F.count("*").alias("n_rows"), best)
        .withColumn("cell", F.shiftrightunsigned("key", 64 - max_depth)),
        "exact-entries",
    )
    cells = F.broadcast(directory(entries, capacity, max_depth))
    chain = Window.partitionBy("bucket", "key")
    index = written(
        entries.join(cells, "cell")
        .repartitionByRange("bucket", "key")
        .withColumn("link", F.row_number().over(chain.orderBy("text_sha256")))
        .withColumn("chain_rows", F.sum("n_rows").over(chain))
        .select("bucket", "local_depth", "key", "link", "text_sha256", "n_rows", "chain_rows"),
        "exact-index",
    )
    # Slots count from 1 in Spark's bitmap functions.
    slot = F.pmod(F.col("key"), F.lit(BITMAP_BITS)) + 1
    bits = (
        index.filter("chain_rows > 1")
        .groupBy(F.bitmap_bucket_number(slot).alias("part"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    )
    place = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.expr("substring(bits, cast(place div 8 as int) + 1, 1)")), 16, 10).cast("int")
    marked = F.expr("shiftright(byte, cast(place % 8 as int)) % 2") == 1
    groups = written(
        base.withColumn("part", F.bitmap_bucket_number(slot))
        .join(F.broadcast(bits), "part")
        .withColumn("place", place)
        .withColumn("byte", byte)
        .filter(marked)
        .groupBy("key", "norm")
        .agg(F.count("*").alias("group_size"), best)
        .select(
            "key",
            F.sha2("norm", 256).alias("text_sha256"),
            "group_size",
            F.bitwise_not(F.col("best.low")).alias("best_id"),
        ),
        "exact-groups",
    )
    return ExactIndex(index, groups, rows)


def exact_duplicates(docs: DataFrame, **settings) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without white space (0x20, 0x09 to 0x0D). The row with the most code
    points in the original text stays, among ties the smallest id. Null texts count as empty. Null ids
    come after all others; if all ids of a group are null, keep_id is null and its rows stay.
    Repeated rows (same id) each count in group_size and share one decision, as an id can't tell them
    apart; ``drop_exact`` leaves one of them. An empty table gives an empty result, and other columns
    of the table are not read.
    """
    index = build_index(docs, **settings)
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("best_id"))
    return index.rows.join(index.groups, ["key", "text_sha256"], "left").select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """One document of each group of equal texts, with all its columns: the row that ``exact_duplicates`` keeps.

    Rows are told apart by id and normalised text, so different texts under one id (or without an id) all
    stay. Of rows that agree in both, the longest original text stays, ties by hashes of the text and of
    the other columns.
    """
    kept = (
        exact_duplicates(docs, id_col=id_col, text_col=text_col, **settings)
        .filter("kept")
        .groupBy(F.col("doc_id").alias("_kept_id"), F.col("text_sha256").alias("_kept_sha"))
        .agg(F.count("*").alias("_rows"))
    )
    whole = F.struct(*[docs[c] for c in docs.columns]).alias("_doc")
    rows = docs.select(whole, docs[id_col].cast("long").alias("_id"), F.sha2(normalized(docs[text_col]), 256).alias("_sha"))
    same = F.col("_id").eqNullSafe(F.col("_kept_id")) & (F.col("_sha") == F.col("_kept_sha"))
    return one_of_each(rows.join(kept, same), ["_kept_id", "_kept_sha"], docs.columns, text_col)


def one_of_each(rows: DataFrame, keys: list[str], columns: list[str], text_col: str) -> DataFrame:
    """One row ``_doc`` for each value of ``keys``; ``_rows`` counts the rows of a key, and most are alone. Repeated
    rows are reduced before the shuffle, so a key may have any number of them."""
    text = F.coalesce(F.col("_doc")[text_col], F.lit(""))
    rest = [F.to_json(F.struct(F.col("_doc")[c].alias(c))) for c in columns if c != text_col]
    best = F.struct(F.length(text), F.bitwise_not(F.xxhash64(text)), F.xxhash64(*rest) if rest else F.lit(0))
    alone = rows.filter("_rows = 1").select("_doc")
    more = rows.filter("_rows > 1").groupBy(*keys).agg(F.max_by("_doc", best).alias("_doc"))
    return alone.union(more.select("_doc")).select("_doc.*")
