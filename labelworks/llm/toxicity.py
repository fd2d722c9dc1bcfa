"""Toxicity by compression distance: zstandard with a toxic and with an ordinary dictionary."""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelworks.llm.common import prepare

TOXIC_ROWS = 2_000  # most labelled rows of each kind that the model is fitted on
ORDINARY_ROWS = 4_000
ORDINARY_BYTES = 8 * 1024
TOXIC_BYTES = 2 * 1024
WINDOW_BYTES = 40  # a word's first bytes; the rest of a longer word is windows of its own
PIECES = (4, 5, 6, 8, 12)  # bytes of word beginnings that the toxic dictionary is trained on
SAMPLE_BYTES = 1000  # of the samples that a dictionary is trained on; longer texts give several
CONTRAST = 30.0  # times more often in toxic text than in ordinary text
LEVELS = 4  # differences of 1, 2, 3 and more bytes
CACHED_WORDS = 600_000  # about 60 MB in a worker

# Both dictionaries end in this line and every window starts with it. It costs the same under both,
# and keeps zstandard from storing short windows raw, which would hide differences of a few bytes.
FRAME = bytes(range(128, 192))


def windows_of(text: str | None) -> Iterator[bytes]:
    """The words of a text in lower case, each between blanks; long words are cut, none is left out."""
    for word in (text or "").lower().split():
        yield from _windows_of_word(word)


def _windows_of_word(word: str) -> list[bytes]:
    raw = word.encode("utf-8", "surrogatepass")
    return [b" " + raw[at : at + WINDOW_BYTES] + b" " for at in range(0, len(raw), WINDOW_BYTES)]


def _settings() -> zstandard.ZstdCompressionParameters:
    return zstandard.ZstdCompressionParameters(
        window_log=15,
        hash_log=12,
        chain_log=13,
        search_log=4,
        min_match=3,
        target_length=32,
        strategy=zstandard.STRATEGY_BTOPT,
        write_content_size=False,
        write_checksum=False,
        write_dict_id=False,
    )


# The compressors of the model in use and what is known of words; a worker keeps them between its tasks.
_in_use: dict[tuple[bytes, bytes], tuple[list[zstandard.ZstdCompressor], dict[str, int]]] = {}


@dataclass
class Model:
    """Two dictionaries and the calibration of their differences; pickled to the executors."""

    ordinary: bytes
    toxic: bytes
    weights: list[float] = field(default_factory=list)
    base: float = 0.0  # score where nothing could be learned

    def _held(self):
        key = (self.ordinary, self.toxic)
        if key not in _in_use:
            _in_use.clear()
            pair = []
            for d in key:
                held = zstandard.ZstdCompressionDict(d + FRAME, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                held.precompute_compress(compression_params=_settings())
                pair.append(zstandard.ZstdCompressor(dict_data=held, compression_params=_settings()))
            _in_use[key] = (pair, {})
        return _in_use[key]

    def difference(self, window: bytes) -> int:
        """Bytes that the toxic dictionary saves on a window against the ordinary one."""
        (plain, toxic), _ = self._held()
        framed = FRAME + window
        return len(plain.compress(framed)) - len(toxic.compress(framed))

    def features(self, text: str | None) -> list[float]:
        """1, and the logarithm of the number of windows at each level of difference and in all."""
        counts = [0] * (LEVELS + 1)
        known = self._held()[1]
        for word, times in Counter((text or "").lower().split()).items():
            level = known.get(word)
            if level is not None:
                counts[level] += times
                continue
            levels = [min(max(self.difference(w), 0), LEVELS) for w in _windows_of_word(word)]
            for level in levels:
                counts[level] += times
            if len(levels) == 1:  # words of several windows are rare and may be very long
                if len(known) >= CACHED_WORDS:
                    known.clear()
                known[word] = levels[0]
        return [1.0, *(math.log1p(n) for n in counts[1:]), math.log1p(sum(counts))]

    def score(self, text: str | None) -> float:
        if not self.weights:
            return self.base
        z = sum(w * x for w, x in zip(self.weights, self.features(text)))
        return 1 / (1 + math.exp(-max(-35.0, min(35.0, z))))


def _support(texts: list[str], only: set[bytes] | None = None) -> tuple[dict[bytes, int], int]:
    """For each word beginning (of ``only``) the number of different words that follow it, and the
    number of words. Copies of a text add nothing to the former."""
    follows: dict[bytes, set[bytes]] = defaultdict(set)
    n = 0
    for t in texts:
        ws = list(windows_of(t))
        n += len(ws)
        for w, after in zip(ws, [*ws[1:], b""]):
            follows[w].add(after)
    next_words: dict[bytes, set[bytes]] = defaultdict(set)
    for w, after in follows.items():
        for p in {w[: min(k, len(w) - 1) + 1] for k in PIECES}:
            if only is None or p in only:
                next_words[p] |= after
    return {p: len(v) for p, v in next_words.items()}, max(n, 1)


def _samples(text: str, keep: set[bytes], support: dict[bytes, int]) -> list[bytes]:
    """The kept word beginnings of a whole text, in samples of about ``SAMPLE_BYTES``."""
    samples = [bytearray()]
    for w in windows_of(text):
        own = [w[: k + 1] for k in PIECES if w[: k + 1] in keep] + ([w[:-1]] if w[:-1] in keep else [])
        if own:
            if len(samples[-1]) >= SAMPLE_BYTES:
                samples.append(bytearray())
            samples[-1] += max(own, key=lambda p: (support[p], len(p)))
    return [bytes(s) for s in samples if s]


def _dictionary(size: int, samples: list[bytes], **settings) -> bytes:
    """A trained dictionary; too few samples to train on are a dictionary themselves."""
    try:
        return zstandard.train_dictionary(size, samples, **settings).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(dict.fromkeys(samples))[-size:]


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> list[float]:
    """Weighted logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    penalty = np.eye(x.shape[1]) * ridge
    penalty[0, 0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        gradient = x.T @ (weight * (p - y)) + penalty @ w
        step = np.linalg.solve((x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + penalty, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w.tolist()


def fit(toxic: list[str], ordinary: list[str], shares: tuple[int, int]) -> Model:
    """Fits dictionaries on two thirds of the texts and the calibration on all others (on all of them
    where there are few). ``shares``: rows of each kind among all labelled rows."""
    if not toxic or not ordinary:
        return Model(b"", b"", [], shares[0] / max(1, sum(shares)))
    few = len(toxic) < 90
    train_t, train_o = (toxic, ordinary) if few else (toxic[: 2 * len(toxic) // 3], ordinary[: 2 * len(ordinary) // 3])
    in_toxic, n_toxic = _support(train_t)
    least = max(4, len(train_t) // 100)
    frequent = {p for p, n in in_toxic.items() if n >= least}
    in_ordinary, n_ordinary = _support(train_o, frequent)
    keep = {
        p
        for p, n in in_toxic.items()
        if p in frequent and n / n_toxic >= CONTRAST * (in_ordinary.get(p, 0) + 0.5) / n_ordinary
    }
    samples = [s for t in train_t for s in _samples(t, keep, in_toxic)]
    plain = [b"".join(windows_of(t)) for t in train_o]
    plain = [p[i : i + 64] for p in plain for i in range(0, len(p), 64)]
    model = Model(
        _dictionary(ORDINARY_BYTES, plain, k=64, d=8), _dictionary(TOXIC_BYTES, samples, k=16, d=6), [], 0.0
    )
    rest_t, rest_o = (toxic, ordinary) if few else (toxic[len(train_t) :], ordinary[len(train_o) :])
    x = np.array([model.features(t) for t in [*rest_t, *rest_o]])
    y = np.array([1.0] * len(rest_t) + [0.0] * len(rest_o))
    true_share = shares[0] / sum(shares)
    weight = np.where(y == 1, true_share / len(rest_t), (1 - true_share) / len(rest_o)) * len(y)
    model.weights = _logistic(x, y, weight)
    return model


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never used: crc32 of the id as text leaves 0 modulo 5."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic") -> Model:
    """Fits a model on a bounded sample of labelled rows outside the held-out fifth.

    The sample is the ``TOXIC_ROWS`` and ``ORDINARY_ROWS`` labelled rows of each kind with the smallest
    hashes of their ids; their texts are used whole. Of several texts with one id the smallest is learned
    from. Null labels, ids and texts are not learned from.
    """
    usable = labels.select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("_y")).filter(
        F.col("_id").isNotNull() & F.col("_y").isin(0, 1) & ~held_out(F.col("_id"))
    )
    shares = {r._y: r.n for r in usable.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    sample = {1: TOXIC_ROWS, 0: ORDINARY_ROWS}
    chosen = None
    for y, rows in sample.items():
        one = usable.filter(F.col("_y") == y).distinct().orderBy(F.xxhash64("_id"), "_id").limit(rows)
        chosen = one if chosen is None else chosen.union(one)
    text = F.col(text_col)
    found = (
        docs.select(F.col(id_col).alias("_id"), text.alias("_text"))
        .filter(text.isNotNull())
        .join(F.broadcast(chosen), "_id")  # at most TOXIC_ROWS + ORDINARY_ROWS ids
        .groupBy("_id", "_y")
        .agg(F.min("_text").alias("_text"))
        .collect()
    )
    found.sort(key=lambda r: (fixed_order(r._id), str(r._id)))
    return fit(
        [r._text for r in found if r._y == 1],
        [r._text for r in found if r._y == 0],
        (shares.get(1, 0), shares.get(0, 0)),
    )


def fixed_order(key) -> int:
    """A fixed random-looking order of ids."""
    return zlib.crc32(f"{key}|order".encode())


def scoring(model: Model):
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([model.score(t) for t in texts], dtype="float64")

    return score


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted (1 from 0.5 on).

    Every window of the whole text counts; null and empty texts get the score of a text without
    windows. A null id is not held out. Repeated rows get equal scores. Without labels of both kinds,
    every score is the share of label 1 (0 without labels).
    """
    prepare(docs.sparkSession)
    model = train(docs, labels, id_col, text_col)
    scored = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(held_out(F.col(id_col)), F.lit(False)).alias("held_out"),
        scoring(model)(F.col(text_col)).alias("score"),
    )
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with a score under 0.5, with all their columns."""
    prepare(docs.sparkSession)
    model = train(docs, labels, id_col, text_col)
    return docs.filter(scoring(model)(F.col(text_col)) < 0.5)
