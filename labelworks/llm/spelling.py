"""Spelling variants: words one edit apart, found in a trie of letter-group counts."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelworks.llm.common import BATCH_ROWS, LOWER, batches_of, written

RUN = re.compile("[a-zÀ-ÿ]+")
EVERY = 97  # a run loses a letter where this divides its checksum
SHORTEST = 5
LEAST = 3  # occurrences
GROUPS = 20  # letter groups: levels of the trie
SINGLE = 16  # groups of one letter; all other letters share the rest
CAPACITY = 20_000  # words of one subtrie
TOP = 15  # counts are cut to one hex digit; the words themselves are verified
WIDTH = 32  # letters compared as arrays; longer words are compared one by one
PIECE = 1 << 20
HELD = 1 << 17  # different words that a task counts before it hands them on
WORD_ROWS = 20_000  # words handed to Python at once
QUERIES = 2_048  # words searched at once


def _pieces(text: str) -> Iterator[str]:
    """A lower-cased text cut between runs."""
    at = 0
    while len(text) - at > PIECE:
        cut = re.compile("[^a-zÀ-ÿ]").search(text, at + PIECE)
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total: Counter[str] = Counter()
    for batch in batches:
        for name, text in zip(batch["id"], batch["text"]):
            head = zlib.crc32(f"{name}:".encode())
            runs: Counter[str] = Counter()
            for piece in _pieces(text.encode().translate(LOWER).decode()):
                runs.update(RUN.findall(piece))
            for run, n in runs.items():
                if len(run) < SHORTEST:
                    continue
                h = zlib.crc32(run.encode(), head)
                if h % EVERY == 0:
                    i = h % len(run)
                    run = run[:i] + run[i + 1 :]
                    if len(run) < SHORTEST:
                        continue
                total[run] += n
        if len(total) > HELD:
            yield pd.DataFrame({"word": list(total), "n": list(total.values())})
            total.clear()
    if total:
        yield pd.DataFrame({"word": list(total), "n": list(total.values())})


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): words of at least ``SHORTEST`` letters with at least ``LEAST`` occurrences in all texts."""
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text")
    ).filter("text <> ''")
    with batches_of(docs.sparkSession, BATCH_ROWS):
        counts = rows.mapInPandas(_counted, "word string, n long")
        return written(counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST), "spell-words")


def letter_groups(words: DataFrame) -> list[str]:
    """Letters of each level, the most frequent first; the alphabet has 90 letters at most."""
    letters = words.select(F.explode(F.split("word", "")).alias("c")).groupBy("c").count()
    order = [r["c"] for r in sorted(letters.collect(), key=lambda r: (-r["count"], r["c"]))]
    groups = order[:SINGLE] + [""] * (GROUPS - min(SINGLE, len(order)))
    for i, c in enumerate(order[SINGLE:]):
        groups[SINGLE + i % (GROUPS - SINGLE)] += c
    return groups


def _vector(groups: list[str]):
    """Counts of the letter groups, one hex digit each."""
    digits = [
        F.expr(f"substring('0123456789abcdef', least({TOP}, length(word) - length(translate(word, '{g}', ''))) + 1, 1)")
        if g
        else F.lit("0")
        for g in groups
    ]
    return F.concat(*digits)


def top_levels(words: DataFrame) -> list[DataFrame]:
    """The trie's levels down to subtries of at most ``CAPACITY`` words: (prefix, held, blocks) each; blocks is
    null where a node has children in the next level. Words with one vector that are more than a subtrie
    holds are split into several blocks there."""
    open_ = written(words.groupBy("vec").agg(F.count("*").alias("held")), "spell-vectors")
    levels = []
    for t in range(GROUPS + 1):
        prefix = F.substring("vec", 1, t)
        blocks = F.ceil(F.col("held") / CAPACITY)
        at = open_.groupBy(prefix.alias("prefix")).agg(F.sum("held").alias("held"))
        fits = (F.col("held") <= CAPACITY) | F.lit(t == GROUPS)
        levels.append(written(at.withColumn("blocks", F.when(fits, blocks).cast("int")), f"spell-level-{t}"))
        over = levels[-1].filter("blocks IS NULL").select("prefix")
        if over.isEmpty():
            break
        open_ = open_.withColumn("prefix", prefix).join(over, "prefix", "left_semi").drop("prefix")
    return levels


def routed(words: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(prefix, block, kind, word, n): each word once as a member (kind 0) of its subtrie, and as a query (kind 1)
    at every subtrie that the search of the top levels reaches with one surplus and one deficit."""
    members, queries = [], []
    at = words.select("*", F.lit("").alias("prefix"), F.lit(1).alias("surplus"), F.lit(1).alias("deficit"))
    for t, level in enumerate(levels):
        here = at.join(level.select("prefix", "blocks"), "prefix")
        block = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        queries.append(here.filter("blocks IS NOT NULL").select("prefix", block.alias("block"), F.lit(1).alias("kind"), "word", "n"))
        own = words.withColumn("prefix", F.substring("vec", 1, t)).join(level.filter("blocks IS NOT NULL"), "prefix")
        part = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
        members.append(own.select("prefix", part.alias("block"), F.lit(0).alias("kind"), "word", "n"))
        count = f"conv(substring(vec, {t + 1}, 1), 16, 10)"
        step = "struct(concat(prefix, lower(hex(cast({c} as long)))) AS prefix, surplus - {s} AS surplus, deficit - {d} AS deficit)"
        same, more, less = step.format(c=count, s=0, d=0), step.format(c=f"{count} + 1", s=1, d=0), step.format(c=f"{count} - 1", s=0, d=1)
        ways = F.expr(
            f"filter(array({same}, if(surplus = 1 AND {count} < {TOP}, {more}, null),"
            f" if(deficit = 1 AND {count} > 0, {less}, null)), x -> x IS NOT NULL)"
        )
        at = here.filter("blocks IS NULL").select("word", "n", "vec", F.explode(ways).alias("x")).select("word", "n", "vec", "x.*")
        if t % 4 == 3:
            at = written(at, "spell-front")  # so that a deep top is not planned as one chain
    out = members[0]
    for more in [*members[1:], *queries]:
        out = out.union(more)
    return out


def one_edit(a: bytes, b: bytes) -> bool:
    """Exactly one inserted, deleted or replaced letter."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


class Words:
    """Words as arrays: letters from the left and from the right, letter-group counts."""

    def __init__(self, words: list[str], group_of: np.ndarray):
        self.raw = [w.encode("latin-1") for w in words]
        self.length = np.array([len(w) for w in self.raw], np.int32)
        self.left = self._letters([w[:WIDTH] for w in self.raw])
        self.right = self._letters([w[::-1][:WIDTH] for w in self.raw])
        in_groups = group_of[self.left]
        self.vector = np.zeros((len(words), GROUPS), np.uint8)
        for g in range(GROUPS):
            self.vector[:, g] = (in_groups == g).sum(axis=1)
        for i in np.flatnonzero(self.length > WIDTH).tolist():
            counts = np.bincount(group_of[np.frombuffer(self.raw[i], np.uint8)], minlength=GROUPS)
            self.vector[i] = np.minimum(counts[:GROUPS], TOP)
        np.minimum(self.vector, TOP, out=self.vector)
        self.first = self.left[:, 0].astype(np.uint16) << 8 | self.left[:, 1]
        self.last = self.right[:, 0].astype(np.uint16) << 8 | self.right[:, 1]

    @staticmethod
    def _letters(words: list[bytes]) -> np.ndarray:
        return np.array(words, f"S{WIDTH}").view(np.uint8).reshape(len(words), WIDTH)


def _shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common beginning of rows; the width where they are equal."""
    differ = a != b
    return np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])


class Subtrie:
    """Trie of letter-group counts over the words of one subtrie, levels as arrays."""

    def __init__(self, words: list[str], n: list[int], group_of: np.ndarray):
        self.group_of = group_of
        vectors = Words(words, group_of).vector
        order = np.lexsort(vectors.T[::-1])
        self.text = [words[i] for i in order]
        self.n = np.array(n, np.int64)[order]
        self.words = Words(self.text, group_of)
        self.rank = np.empty(len(words), np.int64)
        self.rank[np.argsort(np.array(self.text, object))] = np.arange(len(words))
        node = np.zeros(len(words), np.int64)
        self.children = []
        for g in range(GROUPS):
            key = node * (TOP + 1) + self.words.vector[:, g]
            new = np.r_[True, key[1:] != key[:-1]]
            table = np.full((int(node[-1]) + 1) * (TOP + 1), -1, np.int32)
            node = np.cumsum(new) - 1
            table[key[new]] = node[new]
            self.children.append(table)
        self.start = np.r_[np.flatnonzero(new), len(words)]

    def leaves(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, leaf) pairs within one surplus and one deficit of counts: a depth-first search done for all
        queries level by level, each branch carrying what is left of its budget."""
        query = np.arange(len(vectors))
        node = np.zeros(len(vectors), np.int32)
        surplus = np.ones(len(vectors), bool)
        deficit = np.ones(len(vectors), bool)
        for g, table in enumerate(self.children):
            count = vectors[query, g].astype(np.int32)
            at = node * (TOP + 1) + count
            same = table[at]
            more = np.flatnonzero(surplus & (count < TOP))
            less = np.flatnonzero(deficit & (count > 0))
            to = np.concatenate([same, table[at[more] + 1], table[at[less] - 1]])
            of = np.concatenate([np.arange(len(query)), more, less])
            s, d = surplus[of], deficit[of]
            s[len(query) : len(query) + len(more)] = False
            d[len(query) + len(more) :] = False
            found = to >= 0
            query, node, surplus, deficit = query[of[found]], to[found], s[found], d[found]
        return query, node

    def search(self, words: list[str]) -> pd.DataFrame | None:
        """For each word with a near word here: their number and the best of them; None if there is none."""
        own, here = Words(words, self.group_of), self.words
        query, leaf = self.leaves(own.vector)
        sizes = (self.start[leaf + 1] - self.start[leaf]).astype(np.int64)
        ends = np.cumsum(sizes)
        hits = []
        at = 0
        while at < len(sizes):  # about a million pairs at once
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 20), "right")))
            size = sizes[at:to]
            q = np.repeat(query[at:to], size)
            inside = np.arange(len(q)) - np.repeat(np.cumsum(size) - size, size)
            r = np.repeat(self.start[leaf[at:to]], size) + inside
            hits.append(self._verified(own, here, q, r))
            at = to
        if not sum(len(h[0]) for h in hits):
            return None
        q, r = (np.concatenate([h[i] for h in hits]) for i in (0, 1))
        order = np.lexsort((self.rank[r], -self.n[r], q))
        q, r = q[order], r[order]
        first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        return pd.DataFrame(
            {
                "word": [words[i] for i in q[first].tolist()],
                "n_near": np.diff(np.r_[first, len(q)]),
                "best_n": self.n[r[first]],
                "best": [self.text[i] for i in r[first].tolist()],
            }
        )

    @staticmethod
    def _verified(own: Words, here: Words, q: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # One edit leaves the first two or the last two letters of a word as they are.
        near = (own.first[q] == here.first[r]) | (own.last[q] == here.last[r])
        q, r = q[near], r[near]
        longer = np.maximum(own.length[q], here.length[r])
        ahead, behind = _shared(own.left[q], here.left[r]), _shared(own.right[q], here.right[r])
        ok = (ahead + behind >= longer - 1) & (ahead < WIDTH)
        for i in np.flatnonzero(longer > WIDTH).tolist():
            ok[i] = one_edit(own.raw[q[i]], here.raw[r[i]])
        return q[ok], r[ok]


def _searching(groups: list[str]):
    group_of = np.full(256, GROUPS, np.uint8)  # zero bytes after a word belong to no group
    for g, letters in enumerate(groups):
        group_of[list(letters.encode("latin-1"))] = g

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, words, n, trie = None, [], [], None
        for batch in batches:
            key = list(zip(batch["prefix"], batch["block"], batch["kind"]))
            edges = [0, *(i for i in range(1, len(key)) if key[i] != key[i - 1]), len(key)]
            for i, j in zip(edges, edges[1:]):
                prefix, block, kind = key[i]
                part = batch.iloc[i:j]
                if at != (prefix, block):
                    at, words, n, trie = (prefix, block), [], [], None
                if kind == 0:
                    words += part["word"].tolist()
                    n += part["n"].tolist()
                    continue
                if not words:
                    continue
                trie = trie or Subtrie(words, n, group_of)
                asked = part["word"].tolist()
                for k in range(0, len(asked), QUERIES):
                    found = trie.search(asked[k : k + QUERIES])
                    if found is not None:
                        yield found

    return search


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) of words that have near words; ``words`` are (word, n)."""
    groups = letter_groups(words)
    words = written(words.withColumn("vec", _vector(groups)), "spell-vectored")
    rows = routed(words, top_levels(words))
    with batches_of(words.sparkSession, WORD_ROWS):
        parts = (
            rows.repartition("prefix", "block")
            .sortWithinPartitions("prefix", "block", "kind")
            .mapInPandas(_searching(groups), "word string, n_near long, best_n long, best string")
        )
        best = F.min(F.struct((-F.col("best_n")).alias("low"), "best")).alias("first")
        found = parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
        return written(
            found.select("word", "n_near", (-F.col("first.low")).alias("best_n"), F.col("first.best").alias("best")),
            "spell-near",
        )


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, only A-Z lower-cased; a run loses a letter where
    97 divides the checksum of its document's id and itself (a null id counts as no characters). Null and
    empty texts have no words; repeated rows count again. Two words are near if one letter is inserted,
    deleted or replaced. The form of a word is its near word of largest n (ties: the smallest word) if that is
    at least twice as frequent. ``root`` follows forms to the last. An empty table gives an empty result;
    other columns are not read.

    The trie has a level for each group of letters, a word's branch there being how often it uses them. Its
    top levels are tables and are searched by joins; below, subtries of at most ``CAPACITY`` words are
    searched in tasks. On the way down a search may meet one letter too many and one too few. Words in the leaves
    that it reaches are compared letter by letter. No pairs of words are stored or shuffled: a subtrie gives
    one row for each word that has a near word in it.
    """
    words = vocabulary(docs, id_col, text_col)
    near = near_words(words)
    rows = words.join(near, "word", "left").withColumn("is_form", F.col("best_n") >= 2 * F.col("n"))
    rows = rows.select(
        "word",
        F.when(F.col("is_form"), F.col("best")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(F.col("is_form"), F.col("best_n")).alias("form_n"),
    )
    rows = written(rows.withColumn("root", F.coalesce("form", "word")), "spell-forms")
    # A form is twice as frequent, so chains are as long as the logarithm of the largest n; each round doubles.
    most = rows.agg(F.max("n")).first()[0] or 1
    for _ in range(int(most).bit_length().bit_length()):
        nexts = rows.filter("root <> word").select(F.col("word").alias("root"), F.col("root").alias("next"))
        rows = written(
            rows.join(nexts, "root", "left").withColumn("root", F.coalesce("next", "root")).drop("next"), "spell-roots"
        )
    return rows.select("word", "form", "root", "n", "n_near", "form_n")
