"""Benchmark decontamination by Wu-Manber search for windows of benchmark words."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelworks.llm.common import prepare

WINDOW_WORDS = 10
ITEMS_PER_PASS = 20_000  # bounds what is sent to the executors; more items take more passes
BLOCK = 8  # most bytes of a block of the shift table

# Words are runs of 0-9, a-z and everything beyond ASCII; A-Z are lower-cased, the rest separates.
_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split()


class WuManber:
    """Finds every occurrence of many byte strings.

    The shift table says, for the block of bytes that ends at a position, how far the next possible end
    of a pattern's first ``m`` bytes lies (``m``: length of the shortest pattern). Only where it is 0 is
    the bucket of that block looked up, and its patterns are compared directly.
    """

    def __init__(self, patterns: list[bytes]):
        self.m = m = min(map(len, patterns))
        self.b = b = min(BLOCK, m)
        self.default = m - b + 1
        self.shift: dict[bytes, int] = {}
        self.bucket: dict[bytes, list[bytes]] = defaultdict(list)
        for p in patterns:
            for end in range(b, m + 1):
                block = p[end - b : end]
                self.shift[block] = min(self.shift.get(block, self.default), m - end)
            self.bucket[p[m - b : m]].append(p)

    def find(self, text: bytes) -> Iterator[tuple[int, bytes]]:
        at, b, m, default, shift = self.m, self.b, self.m, self.default, self.shift.get
        while at <= len(text):
            step = shift(text[at - b : at], default)
            if step:
                at += step
                continue
            for p in self.bucket[text[at - b : at]]:
                if text.startswith(p, at - m):
                    yield at - m, p
            at += 1


class Windows:
    """The windows of some benchmark items, grouped by length so that short ones do not shorten the
    shifts of long ones."""

    def __init__(self, items: list[tuple[str | None, str | None]], width: int):
        owners: dict[bytes, set[str]] = defaultdict(set)
        for item, text in items:
            w = words_of(text)
            k = min(width, len(w))
            for i in range(len(w) - k + 1 if k else 0):
                owners[b" " + b" ".join(w[i : i + k]) + b" "] |= {item} - {None}
        self.owners = dict(owners)
        classes: dict[int, list[bytes]] = defaultdict(list)
        for p in owners:
            classes[len(p).bit_length()].append(p)
        self.searchers = [WuManber(ps) for _, ps in sorted(classes.items())]

    def hits(self, text: str | None) -> tuple[int, list[int], list[str]]:
        """Number of words; the first word and the one after the last of hit runs, in turn; items."""
        words = words_of(text)
        line = b" " + b" ".join(words) + b" "
        found = [(at, p) for s in self.searchers for at, p in s.find(line)] if words else []
        if not found:
            return len(words), [], []
        spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
        spans = sorted((int(np.searchsorted(spaces, at)), p.count(b" ") - 1) for at, p in found)
        runs: list[int] = []
        for first, k in spans:
            if runs and first <= runs[-1]:
                runs[-1] = max(runs[-1], first + k)
            else:
                runs += [first, first + k]
        return len(words), runs, sorted({i for _, p in found for i in self.owners[p]})


def searching(windows: Windows):
    @F.pandas_udf("n_words long, runs array<long>, items array<string>")
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([windows.hits(t) for t in texts], columns=["n_words", "runs", "items"])

    return search


def benchmark_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    width: int = WINDOW_WORDS,
) -> DataFrame:
    """Adds ``n_words``, ``runs`` (array: first word, word after the last, of each hit run in turn) and
    ``items`` (array of item ids as strings, sorted) to every document, all its columns kept.

    A window is ``width`` consecutive words of an item; an item of fewer words is one window. Null and
    empty texts have no words and are in no window. An item without id marks words but is not listed;
    items with equal ids count once. Columns of docs named like the results are replaced. An empty
    benchmark marks nothing.

    The benchmark is read in parts of at most ``ITEMS_PER_PASS`` items, each searched in one pass over
    the documents, so no more than that is ever sent to the executors.
    """
    prepare(docs.sparkSession)
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text"))
    n = items.count()
    parts = max(1, -(-n // (ITEMS_PER_PASS // 2)))
    part = F.pmod(F.xxhash64("item", "text"), F.lit(parts))
    out = docs.drop("n_words", "runs", "items")
    columns = out.columns
    for k in range(parts):
        windows = Windows([(r.item, r.text) for r in items.filter(part == k).distinct().collect()], width)

        out = out.withColumn(f"_pass_{k}", searching(windows)(text_col))
    passes = [F.col(f"_pass_{k}") for k in range(parts)]
    return out.select(
        *columns,
        passes[0]["n_words"].alias("n_words"),
        (passes[0]["runs"] if parts == 1 else merged_runs(F.array(*[p["runs"] for p in passes]))).alias("runs"),
        F.array_sort(F.array_distinct(F.flatten(F.array(*[p["items"] for p in passes])))).alias("items"),
    )


@F.pandas_udf(T.ArrayType(T.LongType()))
def merged_runs(of_passes: pd.Series) -> pd.Series:
    """The runs of several passes as one list of runs."""

    def merge(lists) -> list[int]:
        out: list[int] = []
        for a, b in sorted(p for runs in lists for p in np.reshape(runs, (-1, 2)).tolist()):
            if out and a <= out[-1]:
                out[-1] = max(out[-1], b)
            else:
                out += [a, b]
        return out

    return of_passes.map(merge)


def n_hit(runs: str = "runs"):
    """Number of words in the runs: the ends minus the starts."""
    return F.expr(
        f"aggregate({runs}, named_struct('sum', 0L, 'sign', -1L), "
        "(s, x) -> named_struct('sum', s.sum + s.sign * x, 'sign', -s.sign), s -> s.sum)"
    )


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **settings) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(settings.get("text_col", "text")).alias("text"))
    found = benchmark_hits(texts, benchmark, **{**settings, "text_col": "text"})
    return found.select(
        "doc_id",
        F.col("n_words"),
        n_hit().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.size("runs") > 0).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """The documents in which no window of the benchmark occurs, with all their columns."""
    columns = docs.columns
    names = {c: f"_c{i}" for i, c in enumerate(columns)}
    text = names[settings.pop("text_col", "text")]
    marked = benchmark_hits(docs.select(*[docs[c].alias(n) for c, n in names.items()]), benchmark, text_col=text, **settings)
    return marked.filter(F.size("runs") == 0).select(*[F.col(n).alias(c) for c, n in names.items()])
