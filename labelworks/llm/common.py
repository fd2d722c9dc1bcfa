"""Shared helpers of the training-data operators: stored tables, batches of texts, word hashes."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from labelworks.scratch import new_path

BATCH_ROWS = 256  # rows of text handed to Python at once


_shipped: set[str] = set()


def prepare(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Before Python works on texts: gives this package's code to the executors (once a session), and
    hands their workers few texts at a time, so that a batch of long texts fits in memory."""
    if spark.sparkContext.applicationId not in _shipped:
        package = Path(__file__).resolve().parent.parent
        archive = Path(tempfile.mkdtemp(prefix="labelworks-code-")) / "labelworks.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, f.relative_to(package.parent))
        spark.sparkContext.addPyFile(str(archive))
        _shipped.add(spark.sparkContext.applicationId)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs started inside hand ``rows`` rows at once to Python; the session's setting comes back after."""
    prepare(spark, int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")))
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a compressed table in the shared folder; later work restarts from there."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# Bytes 0x20 and 0x09 to 0x0D separate words; only A-Z are lower-cased.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

PIECE_BYTES = 1 << 20
TOGETHER_BYTES = 1 << 16  # of short texts that are hashed at once
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """Powers of ``base`` modulo 2^64, kept for the longest text piece so far."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << int(n).bit_length())
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads every bit (the finisher of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running polynomial hash of bytes (n + 1 values); see ``span_hash``."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the byte spans [start, end): equal for equal bytes wherever they stand."""
    inverse = _power(_INVERSE, len(prefix))
    return mix((prefix[ends] - prefix[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def run_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """``span_hash`` of every run of ``size`` bytes."""
    prefix = prefix_hash(data)
    n = len(prefix) - size
    return mix((prefix[size:] - prefix[:n]) * _power(_INVERSE, n) + np.uint64(size))


def _pieces(data: bytes):
    """The text cut between words into pieces of about ``PIECE_BYTES``."""
    at = 0
    while len(data) - at > PIECE_BYTES:
        end = at + PIECE_BYTES
        while end < len(data) and not SPACE[data[end]]:
            end += 1
        yield data[at:end]
        at = end
    yield data[at:]


def _hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words in order, and where they start."""
    found, starts, offset = [], [], 0
    for piece in _pieces(data.translate(LOWER)):
        a = np.frombuffer(piece, np.uint8)
        inside = np.zeros(len(a) + 2, np.int8)
        inside[1:-1] = ~SPACE[a]
        edge = np.diff(inside)
        start = np.flatnonzero(edge == 1)
        found.append(span_hash(prefix_hash(a), start, np.flatnonzero(edge == -1)))
        starts.append(start + offset)
        offset += len(piece)
    return np.concatenate(found), np.concatenate(starts)


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words of a text in order; words are runs of other than white space."""
    return _hashes((text or "").encode("utf-8", "surrogatepass"))[0]


def hashes_of_texts(texts) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``word_hashes`` of all texts in order, as (hashes, how many each text has) for some texts at a time.
    Short texts are hashed together."""
    held, size, hashes, counts, total = [], 0, [], [], 0

    def hash_held() -> None:
        found, starts = _hashes(b"\n".join(held))
        ends = np.cumsum([len(d) + 1 for d in held])
        counts.append(np.diff(np.searchsorted(starts, ends), prepend=0))
        hashes.append(found)

    for text in texts:
        data = (text or "").encode("utf-8", "surrogatepass")
        if held and size + len(data) > TOGETHER_BYTES:
            hash_held()
            held, size = [], 0
            if total > PIECE_BYTES:
                yield np.concatenate(hashes), np.concatenate(counts)
                hashes, counts, total = [], [], 0
        held.append(data)
        size += len(data)
        total += len(data)
    if held:
        hash_held()
        yield np.concatenate(hashes), np.concatenate(counts)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Distinct hashes of ``width`` consecutive words, ascending; a shorter text is one shingle, a text
    without words has none."""
    words = word_hashes(text)
    if not len(words):
        return words
    width = min(width, len(words))
    acc = words[: len(words) - width + 1]
    for i in range(1, width):
        acc = mix(acc * np.uint64(0x2545F4914F6CDD1D) + words[i : len(words) - width + 1 + i])
    return np.unique(acc)
