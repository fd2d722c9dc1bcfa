"""Trie of conversation prefixes by fixed-length block hashing."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelworks.llm.common import prepare, written

BLOCK = 4  # turns of a block
FAN = 64  # blocks, or groups of them, that one link of the digest chain spans
CHUNK_BITS = 12  # ids that differ in these low bits only are joined to text before they are dealt out
ROOT = "root"


def _digest(text: Column) -> Column:
    """128 bits of SHA-256 as hex."""
    return F.substring(F.sha2(text, 256), 1, 32)


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, h, bytes): turns counted from 0 in order of turn, nulls first; equal turn numbers by
    the digest ``h`` of role and text.

    Repeated rows are counted first. The rest is cut into ranges of (conv_id, turn, h), which may split a
    conversation anywhere; what stands before a range comes from one number per range and conversation.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = (
        conversations.filter("conv_id IS NOT NULL")
        .select(
            F.col("conv_id").cast("long").alias("conv_id"),
            F.col("turn"),
            _digest(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)).alias("h"),
            F.octet_length(text).cast("long").alias("bytes"),
        )
        .groupBy("conv_id", "turn", "h", "bytes")
        .agg(F.count("*").alias("copies"))
    )
    rows = written(
        rows.repartitionByRange("conv_id", "turn", "h").withColumn("part", F.spark_partition_id()), "trie-turns"
    )
    inside = Window.partitionBy("conv_id", "part").orderBy(F.col("turn").asc_nulls_first(), "h", "bytes")
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (
        rows.groupBy("conv_id", "part")
        .agg(F.sum("copies").alias("held"))
        .select("conv_id", "part", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("offset"))
    )
    counted = rows.withColumn("upto", F.sum("copies").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    return counted.join(parts, ["conv_id", "part"]).select(
        "conv_id",
        F.explode(F.sequence(F.expr("offset + upto - copies"), F.expr("offset + upto - 1"))).alias("pos"),
        "h",
        "bytes",
    )


def sessions(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, h, bytes, length): every conversation c begins with the first ``crc32(c) % 9`` turns of
    conversation ``c - c % 5`` and goes on with its own turns after as many of its own. Conversations
    without a turn left have one row with null pos."""
    lead = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    own = turns.groupBy("conv_id").agg(F.count("*").alias("own"))
    base = own.select(F.col("conv_id").alias("base_id"), F.col("own").alias("base"))
    sizes = (
        own.withColumn("base_id", F.expr("conv_id - conv_id % 5"))
        .withColumn("skip", lead)
        .join(base, "base_id", "left")
        .withColumn("lead", F.least("skip", F.coalesce("base", F.lit(0))))
        .select("conv_id", "base_id", "skip", "lead", F.expr("lead + greatest(0, own - skip)").alias("length"))
    )
    sizes = written(sizes, "trie-sizes")
    head = (
        turns.filter("pos < 8")
        .withColumnRenamed("conv_id", "base_id")
        .join(sizes, "base_id")
        .filter("pos < skip")
        .select("conv_id", "pos", "h", "bytes", "length")
    )
    rest = (
        turns.filter(F.col("pos") >= lead)
        .join(sizes, "conv_id")
        .select("conv_id", F.expr("pos - skip + lead").alias("pos"), "h", "bytes", "length")
    )
    none = sizes.filter("length = 0").selectExpr(
        "conv_id", "cast(null as long) pos", "cast(null as string) h", "cast(null as long) bytes", "length"
    )
    return head.union(rest).union(none)


def _chained(items: DataFrame, last: int, level: int = 0) -> DataFrame:
    """Adds ``before`` and ``after`` to items (conv_id, k, digest, held): digests of all items before an item,
    and up to it. They depend on nothing but these items' digests.

    ``FAN`` items form a group, whose digest is an item of the next level, until one group holds a whole
    conversation; so a conversation of any length is done in groups of bounded size.
    """
    groups = items.groupBy("conv_id", F.expr(f"k div {FAN}").alias("g")).agg(
        F.sort_array(F.collect_list(F.struct("k", "digest", "held"))).alias("list")
    )
    if last < FAN:
        groups = groups.withColumns({"start": F.lit(f"{ROOT}"), "end": F.lit(None).cast("string")})
    else:
        groups = written(groups, f"trie-groups-{level}")
        above = groups.select(
            "conv_id",
            F.col("g").alias("k"),
            _digest(F.array_join("list.digest", "")).alias("digest"),
            F.lit(None).cast("int").alias("held"),
        )
        links = _chained(above, last // FAN, level + 1).select(
            "conv_id", F.col("k").alias("g"), F.col("before").alias("start"), F.col("after").alias("end")
        )
        groups = groups.join(links, ["conv_id", "g"])
    one = groups.select("conv_id", "start", "end", "list", F.posexplode("list").alias("i", "x"))
    upto = lambda n: _digest(F.concat("start", F.lit(":"), F.array_join(F.slice("list.digest", 1, n), "")))
    return one.select(
        "conv_id",
        F.col("x.k").alias("k"),
        F.col("x.digest").alias("digest"),
        F.col("x.held").alias("held"),
        F.when(F.col("i") == 0, F.col("start")).otherwise(upto(F.col("i"))).alias("before"),
        F.when((F.col("i") == FAN - 1) & F.col("end").isNotNull(), F.col("end")).otherwise(upto(F.col("i") + 1)).alias("after"),
    )


def blocks(turns: DataFrame) -> DataFrame:
    """(conv_id, k, digest, held, before, after) of the blocks of all conversations. ``before`` names the node
    at which a block begins (``anchor`` below), ``after`` the one at which a full block ends."""
    rows = turns.filter("pos IS NOT NULL").groupBy("conv_id", F.expr(f"pos div {BLOCK}").alias("k")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "h", "bytes"))).alias("held")
    )
    rows = rows.withColumn("digest", _digest(F.array_join("held.h", "")))
    rows = written(rows.select("conv_id", "k", "digest", "held"), "trie-blocks")
    last = rows.agg(F.max("k")).first()[0] or 0
    return written(_chained(rows, last), "trie-chain")


def _keys() -> Column:
    """Names of the nodes of a block, one for each of its turns."""
    return F.expr(
        f"transform(sequence(1, size(held)), j -> if(j = {BLOCK}, after,"
        " substring(sha2(concat(before, '/', array_join(slice(held.h, 1, j), '')), 256), 1, 32)))"
    )


def nodes(chain: DataFrame) -> DataFrame:
    """All nodes but the root: (key, parent, anchor, path, depth, n, conv_id, bytes); ``path`` are the nodes
    from the anchor's first turn to the node itself.

    Conversations are grouped by whole blocks first, so copies are one row from here on. An anchor with one
    kind of block has all its nodes settled; blocks of anchors with several are refined turn by turn.
    """
    kinds = written(
        chain.groupBy("before", "digest").agg(
            F.count("*").alias("n"),
            F.min("conv_id").alias("conv_id"),
            F.first("k").alias("k"),
            F.first("held").alias("held"),
            F.first("after").alias("after"),
        ),
        "trie-kinds",
    )
    siblings = kinds.groupBy("before").agg(F.count("*").alias("siblings"))
    rows = (
        kinds.join(siblings, "before")
        .withColumn("keys", _keys())
        .select("*", F.posexplode("keys").alias("j", "key"))
        .select(
            "key",
            F.when(F.col("j") == 0, F.col("before")).otherwise(F.expr("keys[j - 1]")).alias("parent"),
            F.col("before").alias("anchor"),
            F.slice("keys", 1, F.col("j") + 1).alias("path"),
            F.expr(f"k * {BLOCK} + j + 1").alias("depth"),
            "n",
            "conv_id",
            F.expr("held[j].bytes").alias("bytes"),
            "siblings",
        )
    )
    rest = [F.first(c).alias(c) for c in ("parent", "anchor", "path", "depth")]
    split = (
        rows.filter("siblings > 1")
        .groupBy("key")
        .agg(*rest, F.sum("n").alias("n"), F.min("conv_id").alias("conv_id"), F.first("bytes").alias("bytes"))
    )
    return written(rows.filter("siblings = 1").drop("siblings").union(split), "trie-nodes")


def _below(valued: DataFrame, last: int) -> DataFrame:
    """(anchor, leaves, saved): sums over all nodes strictly below an anchor.

    Sums of the blocks directly below it are added up along the tree of anchors by pointer doubling, so a
    tree of any depth takes as many rounds as the logarithm of its depth in blocks.
    """
    up = valued.filter(f"depth % {BLOCK} = 0").select(F.col("key").alias("anchor"), F.col("anchor").alias("up"))
    now = (
        valued.groupBy("anchor")
        .agg(F.sum("leaf").alias("leaves"), F.sum("save").alias("saved"))
        .join(up, "anchor", "left")
    )
    for _ in range(last.bit_length()):
        now = written(now, "trie-below")
        gains = now.filter("up IS NOT NULL").groupBy(F.col("up").alias("anchor")).agg(
            F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved")
        )
        further = now.filter("up IS NOT NULL").select(F.col("anchor").alias("up"), F.col("up").alias("next"))
        now = (
            now.join(gains, "anchor", "left")
            .join(further, "up", "left")
            .select(
                "anchor",
                F.expr("leaves + coalesce(more_leaves, 0)").alias("leaves"),
                F.expr("saved + coalesce(more_saved, 0)").alias("saved"),
                F.col("next").alias("up"),
            )
        )
    return written(now.drop("up"), "trie-below")


def _hash_lists(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of each key's texts, joined by commas; rows come sorted by key."""
    key, state = None, None
    for batch in batches:
        done = []
        for k, ids in zip(batch["key"], batch["ids"]):
            if k != key:
                if key is not None:
                    done.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield pd.DataFrame(done, columns=["key", "ends"])
    if key is not None:
        yield pd.DataFrame([(key, state.hexdigest())], columns=["key", "ends"])


def _ends(turns: DataFrame, chain: DataFrame) -> DataFrame:
    """(key, ends): hash of the ids of the conversations that end at a node. Ids are joined to texts of at most
    2^CHUNK_BITS ids each; a node's texts, one row each, are then hashed in order as a stream."""
    size = turns.filter("pos IS NOT NULL").groupBy("conv_id").agg(F.max("pos").alias("end"))
    at = (
        chain.join(size, "conv_id")
        .filter(f"k = end div {BLOCK}")
        .select("conv_id", F.element_at(_keys(), -1).alias("key"))
        .union(turns.filter("pos IS NULL").select("conv_id", F.lit(ROOT)))
    )
    texts = at.groupBy("key", F.shiftright("conv_id", CHUNK_BITS).alias("chunk")).agg(
        F.array_join(F.sort_array(F.collect_list("conv_id")), ",").alias("ids")
    )
    return (
        texts.repartition("key")
        .sortWithinPartitions("key", "chunk")
        .select("key", "ids")
        .mapInPandas(_hash_lists, "key string, ends string")
    )


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of rebuilt conversations: conv_id (smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256; (conv_id, depth) names a node.

    Conversations are rebuilt as ``sessions`` says. Null role or text counts as empty. Turns with equal
    numbers are ordered by the digest of role and text, and repeated rows are turns of their own. Rows with
    null conv_id belong to no conversation and are left out; ids must be whole numbers. Other columns are
    not read. An empty table gives an empty result, conversations of which nothing is left are members of
    the root alone.

    1. Turns are cut into blocks of ``BLOCK``, and blocks get digests. 2. A chain of digests over bounded groups
    names the node at which each block begins, and conversations are grouped by (node, block). 3. Only blocks
    that share their first node with other blocks are refined to turns. 4. Sums over subtrees go up by blocks
    (pointer doubling), then by the turns inside each block. Texts are not shuffled, only their digests.
    """
    prepare(conversations.sparkSession, 10_000)
    turns = written(sessions(written(ordered_turns(conversations), "trie-ordered")), "trie-sessions")
    chain = blocks(turns)
    found = nodes(chain)
    members = turns.groupBy("conv_id").agg(F.lit(1).alias("one"))
    root = (
        members.agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id"))
        .filter("n > 0")
        .selectExpr(
            f"'{ROOT}' key", "cast(null as string) parent", "cast(null as string) anchor", f"array('{ROOT}') path",
            "cast(0 as long) depth", "n", "conv_id", "cast(0 as long) bytes",
        )
    )
    every = written(found.union(root.select(*found.columns)), "trie-all")
    parents = every.filter("parent IS NOT NULL").select(F.col("parent").alias("key")).distinct()
    valued = written(
        every.join(parents.withColumn("inner", F.lit(True)), "key", "left")
        .withColumn("leaf", F.when(F.col("inner"), 0).otherwise(1))
        .withColumn("save", F.expr("(n - 1) * bytes")),
        "trie-valued",
    )
    deepest = valued.agg(F.max("depth")).first()[0] or 0
    below = _below(valued.filter("anchor IS NOT NULL"), deepest // BLOCK)
    weighed = valued.join(below.withColumnRenamed("anchor", "key"), "key", "left").select(
        "path",
        F.expr("leaf + coalesce(leaves, 0)").alias("leaves"),
        F.expr("save + coalesce(saved, 0)").alias("saved"),
    )
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("string")
    facts = (
        weighed.select(F.explode("path").alias("key"), zero.alias("children"), "leaves", "saved", none.alias("ends"))
        .union(every.filter("parent IS NOT NULL").select("parent", F.lit(1).cast("long"), zero, zero, none))
        .union(_ends(turns, chain).select("key", zero, zero, zero, "ends"))
        .groupBy("key")
        .agg(
            F.sum("children").alias("n_children"),
            F.sum("leaves").alias("n_leaves"),
            F.sum("saved").alias("saved_tokens"),
            F.max("ends").alias("ends"),
        )
    )
    above = every.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return (
        every.select("key", "parent", "conv_id", "depth", "n")
        .join(facts, "key")
        .join(above, "parent", "left")
        .select(
            "conv_id",
            F.col("depth").cast("long").alias("depth"),
            "parent_conv_id",
            F.col("n").cast("long").alias("n_convs"),
            "n_children",
            "n_leaves",
            "saved_tokens",
            F.coalesce("ends", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
        )
    )
