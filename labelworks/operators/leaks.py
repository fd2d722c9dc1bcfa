"""Which example sentences occur inside longer texts (prompts), ignoring case.

A plain "contains" join compares every text with every sentence. Here each sentence is named by the hash
of one run of its bytes, the longest power of two that fits (``LONGEST`` at most). A prompt that holds
the sentence holds that run, so the hashes of all runs of a prompt are looked up in a table of bits of
fixed size, and the few that are marked meet the sentences in an equi-join. Only the pairs found there
are compared as text, so the result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import text_or_blank, trimmed
from ..llm.common import BATCH_ROWS, batches_of, mix
from ..llm.substrings import MARK_BITS, _marks
from ..scratch import stored
from .rank import first_rows

LONGEST = 64  # bytes of the longest run; a power of two
OPENING = 4096  # bytes at the start of a sentence among which its run is chosen
PIECE = 1 << 16  # bytes of text hashed at once
_BASE = 0x9E3779B97F4A7C15


def _run_hashes(data: bytes, sizes: list[int]) -> Iterator[np.ndarray]:
    """For each of the sizes (powers of two, ascending) the hashes of all runs of so many bytes."""
    h, base = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1), _BASE
    size = 1
    for wanted in sizes:
        while size < wanted:
            h = h[:-size] * np.uint64(base) + h[size:]
            size, base = 2 * size, base * base % (1 << 64)
        yield mix(h ^ np.uint64(wanted))


def _naming():
    """The smallest hash of a sentence's runs of the given size."""

    @F.pandas_udf("long")
    def name(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, sizes in batches:
            found = [next(_run_hashes(t[:OPENING], [int(n)])).min() for t, n in zip(texts, sizes)]
            yield pd.Series(np.array(found, np.uint64).view(np.int64))

    return name


def _looked_up(sizes: list[int], marks):
    """Different hashes of a text's runs that are marked."""

    @F.pandas_udf("array<long>")
    def look_up(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bits = np.frombuffer(marks.value, np.uint8)
        for texts in batches:
            # The texts of a batch are hashed as one; runs that leave their text are dropped.
            line = b"".join(texts)
            ends = np.cumsum([len(t) for t in texts])
            owners, hashes = [], []
            for at in range(0, len(line), PIECE):
                part = line[at : at + PIECE + sizes[-1] - 1]
                for size, h in zip(sizes, _run_hashes(part, sizes)):
                    h = h[:PIECE]
                    slot = (h & np.uint64(MARK_BITS - 1)).view(np.int64)
                    hit = np.flatnonzero((bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1)
                    owner = np.searchsorted(ends, hit + at, "right")
                    inside = hit + at + size <= ends[owner]
                    owners.append(owner[inside])
                    hashes.append(h[hit[inside]].view(np.int64))
            out: list[set[int]] = [set() for _ in texts]
            for owner, h in zip(owners, hashes):
                for o, x in zip(owner.tolist(), h.tolist()):
                    out[o].add(x)
            yield pd.Series([list(x) for x in out])

    return look_up


def contained_sentences(prompts: DataFrame, sentences: DataFrame) -> DataFrame:
    """Pairs (prompt_id, sentence_key) where the lowered sentence occurs in the lowered prompt.

    ``prompts(prompt_id, prompt)``; ``sentences(sentence_key, text)`` with distinct lowered texts; empty
    ones occur nowhere. What goes to every task is a table of ``MARK_BITS`` bits, however many sentences
    there are. The candidate pairs are stored in the shared folder when the plan is built: their real size
    then decides how the texts are looked up, and as a rule no prompt is ever shuffled.
    """
    spark = prompts.sparkSession
    sizes = [LONGEST >> i for i in range(LONGEST.bit_length())]
    size = F.coalesce(*[F.when(F.octet_length("text") >= n, F.lit(n)) for n in sizes])
    sized = sentences.select("sentence_key", F.col("text").cast("binary").alias("_b"), size.alias("_size")).filter("_size > 0")
    found = sorted(r["_size"] for r in sized.select("_size").distinct().collect())
    low = prompts.select("prompt_id", F.lower(text_or_blank(F.col("prompt"))).alias("p"))
    if not found:
        return low.join(sentences.select("sentence_key").limit(0)).select("prompt_id", "sentence_key")
    with batches_of(spark, BATCH_ROWS):
        anchors = stored(sized.select("sentence_key", _naming()("_b", "_size").alias("anchor")), "anchors")
        marks = _marks(spark, anchors)
        runs = low.select("prompt_id", _looked_up(found, marks)(F.col("p").cast("binary")).alias("_runs"))
        # the outer form: a plain explode would compute the hashes twice, once to test for emptiness
        hits = runs.select("prompt_id", F.explode_outer("_runs").alias("anchor")).join(anchors, "anchor")
        candidates = stored(hits.select("prompt_id", "sentence_key").distinct(), "candidates")
    return (
        low.join(candidates, "prompt_id")
        .join(sentences.select("sentence_key", "text"), "sentence_key")
        .filter(F.contains("p", "text"))
        .select("prompt_id", "sentence_key")
    )


def _keyed(examples: DataFrame, min_len: int) -> DataFrame:
    clean = examples.withColumn("sentence", trimmed(text_or_blank(F.col("sentence"))))
    return clean.filter(F.length("sentence") >= min_len).select(
        "source_id",
        "split",
        "sentence",
        F.lower("sentence").alias("text"),
        F.sha2(F.lower("sentence"), 256).alias("sentence_key"),
    )


def _hits(prompts: DataFrame, rows: DataFrame) -> DataFrame:
    texts = rows.groupBy("sentence_key").agg(F.first("text").alias("text"))
    return contained_sentences(prompts, texts)


def _sample(characters: int | None) -> Column:
    whole = F.col("sentence")
    return (whole if characters is None else F.substring(whole, 1, characters)).alias("sample")


def leaked_examples(
    prompts: DataFrame, examples: DataFrame, min_len: int = 20, sample_characters: int | None = None
) -> DataFrame:
    """One row per (prompt, example) hit. ``examples(source_id, split, sentence)``. Samples are whole
    sentences, or their first ``sample_characters``.

    Copies of a sentence are looked up once and expanded again at the end.
    """
    rows = _keyed(examples, min_len)
    return _hits(prompts, rows).join(rows, "sentence_key").select(
        "prompt_id", "source_id", "split", _sample(sample_characters)
    )


def leak_audit(
    prompts: DataFrame,
    examples: DataFrame,
    min_len: int = 20,
    samples: int = 5,
    sample_characters: int | None = None,
) -> DataFrame:
    """Per prompt and split: hits and the first sample texts, whole or their first ``sample_characters``. Prompts without hits are absent.

    Copies of a sentence are counted before they meet the prompts, so a sentence that makes up most
    of a split is still one row.
    """
    rows = _keyed(examples, min_len)
    keys = ["sentence_key", "split"]
    copies = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"))
    first = first_rows(rows.select(*keys, "source_id", _sample(sample_characters)), keys, ["source_id"], samples)
    shown = first.groupBy(*keys).agg(F.collect_list(F.struct("source_id", "sample")).alias("first"))
    hits = _hits(prompts, rows).join(copies.join(shown, keys), "sentence_key")
    ordered = F.array_sort(F.flatten(F.collect_list("first")))
    return hits.groupBy("prompt_id", "split").agg(
        F.sum("copies").alias("leaks"),
        F.transform(F.slice(ordered, 1, samples), lambda s: s["sample"]).alias("samples"),
    )


def audit_coverage(examples: DataFrame, min_len: int = 20) -> DataFrame:
    """Per split: sentences checked and sentences too short to check."""
    size = F.length(trimmed(text_or_blank(F.col("sentence"))))
    return examples.groupBy("split").agg(
        F.count(F.lit(1)).alias("checked"),
        F.count_if(size < min_len).alias("skipped_short"),
    )
