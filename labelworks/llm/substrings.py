"""Repeated byte strings, found by merging Burrows-Wheeler transforms of text shards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelworks.llm.common import mix, prepare, run_hashes, written

LENGTH = 200  # bytes of a string that must not repeat
ANCHOR = 64  # bytes of the anchors by which equal strings find each other
MARK_BITS = 1 << 25  # bits of the table of repeated anchors: 4 MiB for any number of documents
GROUP = 2_000  # most shards merged for one anchor; larger groups are counted string by string
MERGED_BYTES = 2 << 20  # shards of several anchors are merged together up to this size
PIECE = 1 << 20
FIRST = 8  # bytes of a suffix that are sorted as one number
ROWS = 256  # shards whose suffixes are sorted at once
_PLACE = np.uint64((1 << 21) - 1)


def anchors(data: bytes, length: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of anchors, and the first and last start of the strings that each stands for.

    The anchor of a ``length``-byte string is its leftmost ``anchor``-byte part with the smallest hash, so
    equal strings have equal anchors at equal places. Strings that start in turn mostly share one."""
    parts = []
    for begin in range(0, max(0, len(data) - length + 1), PIECE):
        a = np.frombuffer(data[begin : begin + PIECE + length - 1], np.uint8)
        h = run_hashes(a, anchor)
        starts = np.arange(len(h), dtype=np.uint64)
        w = length - anchor + 1
        n = len(a) - length + 1
        # The place in the low bits makes ties fall to the leftmost anchor of a string.
        key = (h & ~_PLACE) | starts
        # Smallest of each w in turn: from the minima towards both ends of blocks of w.
        padded = np.full(-(-len(key) // w) * w, np.iinfo(np.uint64).max, np.uint64)
        padded[: len(key)] = key
        ahead = np.minimum.accumulate(padded.reshape(-1, w), axis=1).ravel()
        back = np.minimum.accumulate(padded.reshape(-1, w)[:, ::-1], axis=1)[:, ::-1].ravel()
        place = (np.minimum(back[:n], ahead[w - 1 : w - 1 + n]) & _PLACE).astype(np.int64)
        edge = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        last = np.concatenate([edge[1:], [n]]) - 1
        parts.append((h[place[edge]], edge + begin, last + begin))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    value, first, last = (np.concatenate(c) for c in zip(*parts))
    return mix(value).view(np.int64), first.astype(np.int64), last.astype(np.int64)


def _transforms(shards: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Burrows-Wheeler transforms of shards, each with its end mark (0), one after another: characters, where
    the next step to the left leads, and the starts of the suffixes.

    Suffixes of several shards are sorted at once by their first bytes; those of a shard that agree there
    are compared whole."""
    parts, base = [], 0
    for at in range(0, len(shards), ROWS):
        some = shards[at : at + ROWS]
        sizes = np.array([len(s) for s in some])
        places = np.arange(sizes.max() + 1)
        inside = places <= sizes[:, None]
        # UTF-8 has no byte over 0xF7, so characters move up by one and 0 marks the end.
        text = np.zeros((len(some), len(places) + FIRST), np.uint8)
        text[:, : len(places)][places < sizes[:, None]] = np.frombuffer(b"".join(some), np.uint8) + 1
        key = np.zeros(inside.shape, np.uint64)
        for k in range(FIRST):
            key = (key << np.uint64(8)) | text[:, k : k + len(places)]
        key[~inside] = np.iinfo(np.uint64).max
        order = np.argsort(key, axis=1)
        key = np.take_along_axis(key, order, axis=1)
        same = (key[:, 1:] == key[:, :-1]) & inside[:, 1:]
        for row in np.flatnonzero(same.any(axis=1)):
            edge = np.diff(np.concatenate([[0], same[row].view(np.int8), [0]]))
            for i, j in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + 1):
                order[row, i:j] = sorted(order[row, i:j].tolist(), key=lambda k: some[row][k + FIRST :])
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, places[None, :], axis=1)
        before = np.where(order > 0, order - 1, sizes[:, None])
        chars = np.where(order > 0, np.take_along_axis(text, before, axis=1), np.uint8(0))
        start = base + np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        left = np.take_along_axis(rank, before, axis=1) + start[:, None]
        parts.append((chars[inside], left[inside], order[inside]))
        base += int((sizes + 1).sum())
    chars, left, order = (np.concatenate(c) for c in zip(*parts))
    return chars, left, order


def repeated_starts(shards: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each shard the starts of its ``length``-byte strings that also start elsewhere in the shards.

    The transforms of the shards are merged by refining their interleave: a step sorts the slots, stably,
    by the character to their left, after which they are in the order of one character more. Slots that a
    step parts have a common prefix of just the steps before, so after ``length`` steps slots that are
    still together are an interval of a repeated string. Slots that stand alone are dropped at once, as
    everything to their left stands alone as well, and so are those with fewer than ``length`` characters
    to their left, which would meet the end mark; suffixes are never sorted again.
    """
    chars, left, starts = _transforms(shards)
    base = np.concatenate([[0], np.cumsum([len(s) + 1 for s in shards])[:-1]])
    slots = np.flatnonzero(starts >= length)
    block = np.zeros(len(slots), np.int32)
    # Two steps at once: the nearer character is the lesser part of what slots are sorted by.
    two = chars[left].astype(np.uint16) << np.uint16(8) | chars
    two[chars[left] == 0] = 0
    two[chars == 0] = 0
    left_two = left[left]
    for done in range(0, length, 2):
        by, to = (two, left_two) if done + 2 <= length else (chars, left)
        c = by[slots]
        order = np.argsort(c, kind="stable")
        c, b = c[order], block[order]
        cut = np.ones(len(c) + 1, bool)
        cut[1:-1] = (c[1:] != c[:-1]) | (b[1:] != b[:-1]) | (c[1:] == 0)
        alive = ~(cut[:-1] & cut[1:])
        slots = to[slots[order[alive]]]
        block = np.cumsum(cut[:-1], dtype=np.int32)[alive]
        if not len(slots):
            break
    owner = np.searchsorted(base, slots, "right") - 1
    start = starts[slots]
    by = np.lexsort((start, owner))
    owner, start = owner[by], start[by]
    at = np.searchsorted(owner, np.arange(len(shards) + 1))
    return [start[i:j].astype(np.int64) for i, j in zip(at[:-1], at[1:])]


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def naming(length: int, anchor: int):
    @F.pandas_udf("array<long>")
    def name(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([anchors(_raw(t), length, anchor)[0] for t in texts])

    return name


def cutting(length: int, anchor: int, marks):
    @F.pandas_udf("array<struct<anchor: long, start: long, shard: binary>>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bits = np.frombuffer(marks.value, np.uint8)
        for texts in batches:
            out = []
            for t in texts:
                data = _raw(t)
                h, first, last = anchors(data, length, anchor)
                slot = h.view(np.uint64) % np.uint64(MARK_BITS)
                hit = (bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1
                keep = np.flatnonzero(hit)
                out.append(
                    [
                        {"anchor": a, "start": i, "shard": data[i : j + length]}
                        for a, i, j in zip(h[keep].tolist(), first[keep].tolist(), last[keep].tolist())
                    ]
                )
            yield pd.Series(out)

    return cut


def merging(length: int):
    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def of(part: pd.DataFrame) -> pd.DataFrame:
            shards = list(part["shard"])
            found = repeated_starts(shards, length)
            rows = []
            for name, starts in zip(part["name"], found):
                if len(starts):
                    edge = np.flatnonzero(np.diff(starts) != 1)
                    first = starts[np.concatenate([[0], edge + 1])]
                    last = starts[np.concatenate([edge, [len(starts) - 1]])]
                    rows += [(name, int(a), int(b)) for a, b in zip(first, last)]
            return pd.DataFrame(rows, columns=["name", "first", "last"])

        held, size = [], 0
        for batch in batches:  # sorted by anchor; an anchor's shards are merged together
            anchors_of = batch["anchor"].to_numpy()
            edge = [0, *(np.flatnonzero(anchors_of[1:] != anchors_of[:-1]) + 1).tolist(), len(batch)]
            for i, j in zip(edge, edge[1:]):
                part = batch.iloc[i:j]
                if held and size > MERGED_BYTES and held[-1]["anchor"].iloc[-1] != anchors_of[i]:
                    yield of(pd.concat(held))
                    held, size = [], 0
                held.append(part)
                size += int(part["shard"].map(len).sum())
        if held:
            yield of(pd.concat(held))

    return merge


def _marks(spark: SparkSession, repeated: DataFrame):
    """The repeated anchors as a table of bits of fixed size, for every task."""
    slot = F.expr(f"pmod(pmod(anchor, {MARK_BITS}L) + {MARK_BITS}L, {MARK_BITS}L)") + 1
    parts = (
        repeated.groupBy(F.bitmap_bucket_number(slot).alias("part"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
        .collect()
    )
    bits = np.zeros(MARK_BITS // 8, np.uint8)
    for r in parts:
        at = (r.part - 1) * 4096
        bits[at : at + 4096] = np.frombuffer(r.bits, np.uint8)
    return spark.sparkContext.broadcast(bits.tobytes())


def repeated_spans(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """(row, runs) for rows (row, text) with repeated strings: runs are [first, last] starts of strings
    of ``length`` bytes that also start elsewhere. ``row`` names rows by their content, equal rows alike.

    1. Anchors are counted over all documents; a table of bits of fixed size marks those that occur twice.
    2. A second scan cuts a shard of text around each marked anchor: the strings that it stands for.
       Shards that occur twice are repeated as a whole and need no more; equal shards meet map-side.
    3. The other shards of an anchor are merged with all of its shards (``repeated_starts``). Anchors with
       more than ``GROUP`` different shards are split further: their strings are counted one by one.
    """
    spark = docs.sparkSession
    repeated = (
        docs.select(F.explode(naming(length, anchor)("text")).alias("anchor"))
        .groupBy("anchor")
        .agg(F.count("*").alias("n"))
        .filter("n > 1")
    )
    marks = _marks(spark, repeated)
    shards = written(
        docs.select("row", F.explode(cutting(length, anchor, marks)("text")).alias("s"))
        .select("row", "s.*")
        .withColumn("name", F.md5(F.concat(F.col("anchor").cast("string").cast("binary"), "shard"))),
        "substring-shards",
    )
    kinds = written(
        shards.groupBy("anchor", "name").agg(F.count("*").alias("n"), F.first("shard").alias("shard")),
        "substring-kinds",
    )
    groups = kinds.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("n").alias("least"))
    open_ = groups.filter("kinds > 1 and least = 1")
    size = F.length("shard") - length
    whole = kinds.filter("n > 1").select("name", F.lit(0).cast("long").alias("first"), size.cast("long").alias("last"))
    merged = (
        kinds.join(open_.filter(F.col("kinds") <= GROUP).select("anchor"), "anchor", "left_semi")
        .repartition("anchor")
        .sortWithinPartitions("anchor")
        .select("anchor", "name", "shard")
        .mapInPandas(merging(length), "name string, first long, last long")
    )
    strings = (
        kinds.join(open_.filter(F.col("kinds") > GROUP).select("anchor"), "anchor", "left_semi")
        .select("name", "shard", F.explode(F.sequence(F.lit(0), size.cast("int"))).alias("first"))
        .select("name", "first", F.md5(F.expr(f"substring(shard, first + 1, {length})")).alias("string"))
    )
    twice = strings.groupBy("string").agg(F.count("*").alias("n")).filter("n > 1").select("string")
    single = F.col("first").cast("long")
    counted = strings.join(twice, "string").select("name", single.alias("first"), single.alias("last"))
    runs = written(whole.union(merged).union(counted), "substring-runs")
    return (
        shards.select("row", "start", "name")
        .join(runs, "name")
        .groupBy("row")
        .agg(
            F.collect_set(
                F.struct((F.col("start") + F.col("first")).alias("first"), (F.col("start") + F.col("last")).alias("last"))
            ).alias("runs")
        )
    )


def removing(length: int):
    @F.pandas_udf("n_removed long, n_spans long, kept binary, spans array<long>")
    def remove(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, all_runs in batches:
            rows = []
            for t, runs in zip(texts, all_runs):
                data = _raw(t)
                pairs = sorted((int(r["first"]), int(r["last"]) + length) for r in runs)
                spans: list[int] = []
                for a, b in pairs:
                    if spans and a <= spans[-1]:
                        spans[-1] = max(spans[-1], b)
                    else:
                        spans += [a, b]
                edges = [0, *spans, len(data)]
                kept = b"".join(data[i:j] for i, j in zip(edges[::2], edges[1::2]))
                rows.append((len(data) - len(kept), len(spans) // 2, kept, spans))
            yield pd.DataFrame(rows, columns=["n_removed", "n_spans", "kept", "spans"])

    return remove


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept (bytes), spans (start, end, ...).

    Every byte that lies in a ``length``-byte string which also starts anywhere else in the table, also
    in the same document, goes; strings are judged on the input. Matches never cross documents. Null and
    shorter texts lose nothing. Repeated rows repeat each other's strings. An empty table gives an empty
    result; other columns of docs are not read.
    """
    prepare(docs.sparkSession)
    base = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    ).withColumn("row", F.xxhash64("doc_id", "text"))
    runs = written(repeated_spans(base, length), "substring-rows")
    removed = (
        base.join(runs, "row")
        .withColumn("_r", removing(length)("text", "runs"))
        .select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "_r.*")
    )
    same = base.join(runs.select("row"), "row", "left_anti").select(
        "doc_id",
        F.octet_length("text").cast("long").alias("n_bytes"),
        F.lit(0).cast("long").alias("n_removed"),
        F.lit(0).cast("long").alias("n_spans"),
        F.col("text").cast("binary").alias("kept"),
        F.array().cast("array<long>").alias("spans"),
    )
    return removed.union(same)


def repeat_report(docs: DataFrame, **settings) -> DataFrame:
    return remove_repeats(docs, **settings).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )

