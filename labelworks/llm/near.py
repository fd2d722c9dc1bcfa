"""Near-duplicate documents by b-bit MinHash."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelworks.llm.common import mix, prepare, shingle_set, written
from labelworks.llm.components import components
from labelworks.llm.exact import one_of_each

HASHES = 128
KEPT_BITS = 4  # low bits of each minimum that are kept
ROWS = 4
BANDS = 32  # 4 rows each: a pair with similarity 0.8 misses all bands once in 20 million
MARGIN = 0.17  # a candidate stays if its estimate is at least threshold - MARGIN (4.5 deviations)
BLOCK = 1024  # members of a bucket compared at once
BLOCK_SHINGLES = 1 << 20  # and their shingles, about
COLUMNS = 4096  # shingles multiplied at once

_rng = np.random.Generator(np.random.PCG64(20240607))
_MULTIPLY = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_BAND_SALT = mix(np.arange(1, BANDS + 1, dtype=np.uint64))


def minima(shingles: np.ndarray) -> np.ndarray:
    """Smallest value of each hash function over a set."""
    low = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 512):
        part = shingles[at : at + 512, None] * _MULTIPLY + _ADD
        low = np.minimum(low, part.min(axis=0))
    return low


def packed(low: np.ndarray) -> bytes:
    """The low bits of the (spread) minima, two hashes to a byte."""
    bits = (mix(low) & np.uint64((1 << KEPT_BITS) - 1)).astype(np.uint8)
    return (bits[0::2] | bits[1::2] << 4).tobytes()


def band_keys(low: np.ndarray) -> np.ndarray:
    keys = _BAND_SALT.copy()
    for i in range(ROWS):
        keys = mix(keys * np.uint64(0x2545F4914F6CDD1D) + low[i : BANDS * ROWS : ROWS])
    return keys.view(np.int64)


def _equal(x: np.ndarray) -> np.ndarray:
    """Number of equal hashes from the exclusive or of packed signatures (64-bit words of 16 hashes)."""
    x |= x >> np.uint64(2)
    x |= x >> np.uint64(1)
    x &= np.uint64(0x1111111111111111)
    return 16 * x.shape[-1] - np.bitwise_count(x).sum(axis=-1, dtype=np.int64)


def similarity(x: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity; hashes that agree in the kept bits by chance are taken off."""
    chance = 1 / (1 << KEPT_BITS)
    return (_equal(x) / (16 * x.shape[-1]) - chance) / (1 - chance)


def similarities(words: np.ndarray) -> np.ndarray:
    """Estimates for all rows against all rows."""
    out = np.empty((len(words), len(words)))
    for at in range(0, len(words), 64):
        out[at : at + 64] = similarity(words[at : at + 64, None, :] ^ words[None, :, :])
    return out


def describing(width: int):
    @F.pandas_udf("n_shingles long, node long, signature binary, bands array<long>")
    def describe(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for t in texts:
                s = shingle_set(t, width)
                if not len(s):
                    rows.append((0, None, None, None))
                    continue
                low = minima(s)
                node = int.from_bytes(hashlib.md5(s.tobytes()).digest()[:8], "little", signed=True)
                rows.append((len(s), node, packed(low), band_keys(low)))
            out = pd.DataFrame(rows, columns=["n_shingles", "node", "signature", "bands"])
            yield out.astype({"node": "Int64"})

    return describe


def shingling(width: int):
    @F.pandas_udf("binary")
    def shingled(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([shingle_set(t, width).tobytes() for t in texts])

    return shingled


def verdict(width: int, percent: int):
    @F.pandas_udf("boolean")
    def linked(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in batches:
            sets: dict[str, np.ndarray] = {}
            for t in (*left, *right):
                if t not in sets:
                    sets[t] = shingle_set(t, width)
            out = []
            for x, y in zip(left, right):
                a, b = sets[x], sets[y]
                both = len(np.intersect1d(a, b, assume_unique=True))
                out.append(100 * both >= percent * (len(a) + len(b) - both))
            yield pd.Series(out, dtype=bool)

    return linked


def _forest(nodes: np.ndarray, groups: np.ndarray, words: np.ndarray, least: float):
    """Spanning forest of the most similar pairs of one block, for pairs of different components."""
    equal = similarities(words)
    rows, cols = np.nonzero(np.triu(equal >= least, 1))
    keep = groups[rows] != groups[cols]
    rows, cols = rows[keep], cols[keep]
    order = np.argsort(-equal[rows, cols], kind="stable")
    parent = {g: g for g in groups.tolist()}

    def root(g):
        while parent[g] != g:
            parent[g] = parent[parent[g]]
            g = parent[g]
        return g

    chosen = []
    for k in order.tolist():
        a, b = root(int(groups[rows[k]])), root(int(groups[cols[k]]))
        if a != b:
            parent[a] = b
            chosen.append(k)
            if len(chosen) == len(parent) - 1:
                break
    return nodes[rows[chosen]], nodes[cols[chosen]]


def shared(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets with all sets, by a product of 0-1 matrices. Shingles of one set
    alone are left out, the others multiplied ``COLUMNS`` at a time."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, place, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = counts[place] > 1
    owner, place = owner[common], np.unique(place[common], return_inverse=True)[1]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    out = np.zeros((len(sets), len(sets)), np.float32)  # exact below 2^24
    total = int(place[-1]) + 1 if len(place) else 0
    exact = np.zeros((len(sets), len(sets)), np.int64)
    for at in range(0, total, COLUMNS):
        i, j = np.searchsorted(place, [at, at + COLUMNS])
        has = np.zeros((len(sets), COLUMNS), np.float32)
        has[owner[i:j], place[i:j] - at] = 1
        np.matmul(has, has.T, out=out)
        exact += out.astype(np.int64)
    return exact


def _links(nodes: np.ndarray, groups: np.ndarray, sets: list[np.ndarray], percent: int):
    """Spanning forest of the links between different components in one block, confirmed on full sets: at most
    one row less than the block has members, however many links there are."""
    both = shared(sets)
    size = np.array([len(s) for s in sets], np.int64)
    linked = 100 * both >= percent * (size[:, None] + size[None, :] - both)
    linked &= groups[:, None] != groups[None, :]
    waiting = np.ones(len(nodes), bool)
    rows, cols = [], []
    for first in range(len(nodes)):
        if not waiting[first]:
            continue
        waiting[first] = False
        stack = [first]
        while stack:
            at = stack.pop()
            found = np.flatnonzero(linked[at] & waiting)
            waiting[found] = False
            rows += [at] * len(found)
            cols += found.tolist()
            stack += found.tolist()
    return nodes[rows], nodes[cols]


def _runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The rows of one block at a time; rows come sorted by ``keys``. Blocks of one row are left out."""
    rest: list[pd.DataFrame] = []
    for batch in batches:
        key = list(zip(*[batch[k] for k in keys]))
        edges = [0, *(i for i in range(1, len(key)) if key[i] != key[i - 1]), len(key)]
        for i, j in zip(edges, edges[1:]):
            if rest and tuple(rest[-1][k].iloc[-1] for k in keys) != key[i]:
                whole = pd.concat(rest) if len(rest) > 1 else rest[0]
                if len(whole) > 1:
                    yield whole
                rest = []
            rest.append(batch.iloc[i:j])
    if rest:
        whole = pd.concat(rest) if len(rest) > 1 else rest[0]
        if len(whole) > 1:
            yield whole


def _words(part: pd.DataFrame) -> np.ndarray:
    return np.frombuffer(b"".join(part["signature"]), np.uint64).reshape(len(part), -1)


def proposing(least: float):
    def propose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _runs(batches, ["key", "block"]):
            a, b = _forest(part["node"].to_numpy(), part["component"].to_numpy(), _words(part), least)
            if len(a):
                yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return propose


def leaving_open(least: float):
    """Members of a block that may be linked with a member of another component."""

    def leave(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _runs(batches, ["key", "block"]):
            groups = part["component"].to_numpy()
            near = (similarities(_words(part)) >= least) & (groups[:, None] != groups[None, :])
            left = part[near.any(axis=1)]
            if len(left):
                yield left[["key", "block", "node", "component"]]

    return leave


def confirming(percent: int):
    def confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _runs(batches, ["key", "block"]):
            sets = [np.frombuffer(s, np.uint64) for s in part["shingles"]]
            a, b = _links(part["node"].to_numpy(), part["component"].to_numpy(), sets, percent)
            if len(a):
                yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return confirm


def _buckets(nodes: DataFrame) -> DataFrame:
    """Members (key, n, node, signature) of band buckets with two members or more. Buckets of the same
    members under several bands are kept once."""
    members = nodes.select("node", "n_shingles", F.explode("bands").alias("key"))
    sums = members.groupBy("key").agg(
        F.count("*").alias("n"),
        F.sum("n_shingles").alias("shingles"),
        F.bit_xor(F.xxhash64("node")).alias("x"),
        F.sum(F.xxhash64("node", F.lit(1)) % F.lit(1 << 40)).alias("s"),
    )
    once = sums.filter("n > 1").groupBy("n", "shingles", "x", "s").agg(F.min("key").alias("key"))
    return written(members.join(once.select("key", "n", "shingles"), "key").drop("n_shingles"), "near-members").join(
        nodes.select("node", "signature"), "node"
    )


def near_links(docs: DataFrame, width: int, percent: int, id_col: str, text_col: str):
    """Described rows and the confirmed links between different sets."""
    prepare(docs.sparkSession)
    least = percent / 100 - MARGIN
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn(
        "row", F.xxhash64("doc_id", "text")
    )
    rows = written(
        base.withColumn("_d", describing(width)("text")).select("doc_id", "row", "_d.*"), "near-rows"
    )
    # Equal sets are one node, whatever their number; their descriptions are equal.
    nodes = written(
        rows.filter("n_shingles > 0")
        .groupBy("node")
        .agg(
            F.min("row").alias("row"),
            F.first("n_shingles").alias("n_shingles"),
            F.first("signature").alias("signature"),
            F.first("bands").alias("bands"),
        ),
        "near-nodes",
    )
    members = written(_buckets(nodes), "near-buckets")
    # Each block meets each other block of its bucket in a group of its own.
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    paired = (
        members.withColumn("blocks", blocks)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("block", F.least("own", "other").cast("long") * F.col("blocks") + F.greatest("own", "other"))
        .select("key", "block", "node", "signature")
    )
    asked = members.select("node").distinct().join(nodes.select("node", "row"), "node")
    texts = written(
        base.select("row", "text").join(asked, "row").select("node", "text").dropDuplicates(["node"]), "near-texts"
    )
    dealt = lambda df: df.repartition("key", "block").sortWithinPartitions("key", "block")
    pairs = dealt(paired.withColumn("component", F.col("node"))).mapInPandas(proposing(least), "a long, b long").distinct()
    compared = written(
        pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
        .join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
        .select("a", "b", verdict(width, percent)("ta", "tb").alias("linked")),
        "near-compared",
    )
    links = compared.filter("linked").select("a", "b")
    placed = components(links)
    # What these links leave apart is confirmed where it meets.
    again = paired.join(placed, "node", "left").withColumn("component", F.coalesce("component", "node"))
    open_ = (
        again.groupBy("key", "block")
        .agg(F.min("component").alias("_low"), F.max("component").alias("_high"))
        .filter("_low <> _high")
        .select("key", "block")
    )
    again = written(again.join(open_, ["key", "block"], "left_semi"), "near-open")
    left = dealt(again).mapInPandas(leaving_open(least), "key long, block long, node long, component long")
    left = written(left, "near-left")
    sets = left.select("node").distinct().join(texts, "node").select("node", shingling(width)("text").alias("shingles"))
    found = dealt(left.join(written(sets, "near-sets"), "node")).mapInPandas(confirming(percent), "a long, b long")
    return rows, components(links.union(written(found.distinct(), "near-found")))


def _decided(docs: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """``near_duplicates`` with the hash ``row`` of a row's id and text, and whether that row stays for its
    component: the one with the smallest id (nulls last), then the smallest hash."""
    rows, placed = near_links(docs, width, percent, id_col, text_col)
    placed = rows.filter("node is not null").select("node").distinct().join(placed, "node", "left").select(
        "node", F.coalesce("component", "node").alias("component")
    )
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "row")).alias("first")
    names = placed.join(rows.filter("node is not null").groupBy("node").agg(first), "node")
    least = names.groupBy("component").agg(F.min("first").alias("least"))
    named = names.join(least, "component").select(
        "node", F.col("least.doc_id").alias("component_id"), F.col("least.row").alias("_stays")
    )
    named = written(named, "near-components")
    out = (
        rows.filter("node is not null")
        .join(named, "node")
        .select("doc_id", "row", "n_shingles", "component_id", (F.col("row") == F.col("_stays")).alias("stays"))
    )
    alone = rows.filter("node is null").select(
        "doc_id", "row", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("stays")
    )
    return out.union(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_duplicates(
    docs: DataFrame,
    width: int = 4,
    percent: int = 80,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents are linked when 100 * |A and B| >= percent * |A or B| for their sets of ``width``-word
    shingles (as 64-bit hashes); a shorter text is one shingle. Null texts, empty texts and texts
    without words have no shingles and are linked with nothing. ``component_id`` is the smallest id of
    the component; null ids count only where all are null. Repeated rows (equal ids) share a component
    and are all kept if their id is its smallest; ``drop_near`` leaves one. An empty table gives an empty
    result; other columns of docs are not read.

    1. Documents with equal sets are one node. 2. Nodes that share a band meet in buckets, in blocks of
    bounded size. 3. Packed low bits of minima give estimates by bit counts; pairs under the threshold
    less a margin are ruled out. 4. A spanning forest of each block is confirmed on full sets. 5. Members
    that may still be linked with another component bring their sets to their block, where all of them are
    compared exactly; a block hands on a spanning forest of what it confirms. There is no table of pairs and
    no cap.
    """
    return _decided(docs, width, percent, id_col, text_col).select("doc_id", "n_shingles", "component_id", "kept")


def drop_near(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, with all its columns: the smallest id, then the smallest hash of id and text.

    Rows are told apart by id and text, so different texts under one id (or without an id) are only dropped
    if they are linked. Texts without words are linked with nothing and stay. Of rows that agree in id and text one
    stays (by the hash of their other columns).
    """
    kept = (
        _decided(docs, width, percent, id_col, text_col)
        .filter("stays")
        .groupBy(F.col("doc_id").alias("_kept_id"), F.col("row").alias("_kept_row"))
        .agg(F.count("*").alias("_rows"))
    )
    whole = F.struct(*[docs[c] for c in docs.columns]).alias("_doc")
    rows = docs.select(whole, docs[id_col].alias("_id"), F.xxhash64(docs[id_col], docs[text_col]).alias("_row"))
    same = F.col("_id").eqNullSafe(F.col("_kept_id")) & (F.col("_row") == F.col("_kept_row"))
    return one_of_each(rows.join(kept, same), ["_kept_id", "_kept_row"], docs.columns, text_col)
