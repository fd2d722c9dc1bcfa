"""Packs tokenized documents into sequences: shortest pack first over the histogram of lengths."""

from __future__ import annotations

import bisect
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelworks.llm.common import prepare, written
from labelworks.operators.rank import bucketed_rank, shuffle_key

MAX_LENGTH = 4096
END_ID = 2
CACHED_WORDS = 600_000  # about 100 MB in a worker

# The fast way treats a text word by word; it is exact for these characters. Others, and texts that
# hold the mark of a special token, go through the library as a whole.
_PLAIN = re.compile("[^\x00-\x1b\x20-ɏ]|<\\|")
# How the vocabulary's own file splits text before the merges (white space is dropped).
_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\t-\r \x85\xa0\p{L}\p{N}]+")


class WordTokenizer:
    """Ids of a lower-casing BPE with word ends, equal to ``Tokenizer.encode`` of the whole text.

    Merges never cross words, so ids of words are kept and looked up; only new words are encoded.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = iter(range(256, 512))
        self.to_chars = str.maketrans({chr(b): chr(b) if b in printable else chr(next(rest)) for b in range(256)})
        self.words: dict[str, bytes] = {}

    def _encode(self, chunk: str) -> bytes:
        if chunk.isalpha():
            parts = [chunk]
        elif chunk[:-1].isalpha():
            parts = [chunk[:-1], chunk[-1]]
        else:
            parts = _SPLIT.findall(chunk)
        ids = [
            t.id for p in parts for t in self.model.tokenize(p.encode().decode("latin-1").translate(self.to_chars))
        ]
        return np.array(ids, "<u4").tobytes()

    def ids(self, text: str | None) -> bytes:
        """Little-endian 32-bit ids."""
        if not text:
            return b""
        if _PLAIN.search(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        chunks = text.lower().split()
        try:
            return b"".join(map(self.words.__getitem__, chunks))
        except KeyError:
            new = {c: self._encode(c) for c in set(chunks) if c not in self.words}
            out = b"".join([new[c] if c in new else self.words[c] for c in chunks])
            if len(self.words) + len(new) > CACHED_WORDS:
                self.words.clear()
            self.words.update(new)
            return out


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One tokenizer per worker process and file, with the words it has met."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def cutting(vocabulary: str, max_length: int, end_id: int | None, with_ids: bool):
    fields = "array<struct<start: long, length: long, ids_crc32: long" + (", ids: array<int>>>" if with_ids else ">>")
    tail = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
    step = 4 * max_length

    @F.pandas_udf(f"doc_tokens long, pieces {fields}")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        # The packed code lives on the executors as a module, so its tokenizers outlast a task.
        from labelworks.llm import packing

        words = packing.tokenizer(vocabulary)
        for texts in batches:
            rows = []
            for t in texts:
                raw = words.ids(t) + tail
                pieces = []
                for at in range(0, len(raw), step):
                    part = raw[at : at + step]
                    piece = {"start": at // 4, "length": len(part) // 4, "ids_crc32": zlib.crc32(part)}
                    if with_ids:
                        piece["ids"] = np.frombuffer(part, "<i4")
                    pieces.append(piece)
                rows.append((len(raw) // 4, pieces))
            yield pd.DataFrame(rows, columns=["doc_tokens", "pieces"])

    return cut


def pieces_of(
    docs: DataFrame,
    vocabulary: str,
    max_length: int = MAX_LENGTH,
    end_id: int | None = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Tokenizes whole texts and cuts them into pieces of at most ``max_length`` ids:
    (doc_id, doc_tokens, start, length, ids_crc32[, ids]). Each id lies in one piece. A document of up
    to ``max_length`` ids is one piece; a null or empty text is the end id alone."""
    prepare(docs.sparkSession)
    found = docs.select(
        F.col(id_col).alias("doc_id"),
        cutting(vocabulary, max_length, end_id, with_ids)(F.col(text_col)).alias("_t"),
    )
    return found.select("doc_id", F.col("_t.doc_tokens").alias("doc_tokens"), F.explode("_t.pieces").alias("_p")).select(
        "doc_id", "doc_tokens", "_p.*"
    )


def pack_histogram(histogram: dict[int, int], max_length: int) -> list[tuple[int, tuple[int, ...]]]:
    """Shortest pack first: (number of sequences, lengths in them) per pattern.

    Lengths are placed longest first, each on the pattern that is shortest among those begun, as long as
    it fits there; a pattern of more sequences than rows of the length is divided. What fits nowhere
    begins a pattern. Work and patterns follow the number of different lengths, not of documents.
    """
    room: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)  # free ids -> patterns
    free: list[int] = []  # the keys of room in ascending order

    def put(space: int, pattern: tuple[int, tuple[int, ...]]) -> None:
        if not room[space]:
            bisect.insort(free, space)
        room[space].append(pattern)

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if not free or free[-1] < length:
                put(max_length - length, (left, (length,)))
                break
            space = free[-1]
            count, lengths = room[space].pop()
            if not room[space]:
                free.pop()
            used = min(count, left)
            if count > used:
                put(space, (count - used, lengths))
            put(space - length, (used, (*lengths, length)))
            left -= used
    return [p for space in sorted(room) for p in room[space]]


def slots_of(patterns: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, int, int, int, int]]:
    """Where the pieces of each length go: (length, first rank, last rank, sequence of the first, offset)."""
    taken: dict[int, int] = defaultdict(int)
    slots, sequence = [], 0
    for count, lengths in patterns:
        offset = 0
        for length in lengths:
            first = taken[length] + 1
            taken[length] += count
            slots.append((length, first, taken[length], sequence, offset))
            offset += length
        sequence += count
    return slots


def placing(slots: list[tuple[int, int, int, int, int]]):
    by_length: dict[int, list[np.ndarray]] = {}
    for length in {s[0] for s in slots}:
        rows = sorted(s[1:] for s in slots if s[0] == length)
        by_length[length] = [np.array(c, np.int64) for c in zip(*rows)]

    @F.pandas_udf("sequence_id long, offset long")
    def place(lengths: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        out = np.zeros((len(lengths), 2), np.int64)
        of, rank = lengths.to_numpy(), ranks.to_numpy()
        for length in np.unique(of):
            at = np.flatnonzero(of == length)
            first, _, sequence, offset = by_length[int(length)]
            k = np.searchsorted(first, rank[at], "right") - 1
            out[at, 0] = sequence[k] + rank[at] - first[k]
            out[at, 1] = offset[k]
        return pd.DataFrame(out, columns=["sequence_id", "offset"])

    return place


def assign(pieces: DataFrame, max_length: int = MAX_LENGTH) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces with doc_id, start and length.

    Only the histogram (at most ``max_length`` rows) goes to the driver, and only the slots of the
    patterns come back, whose number depends on the different lengths alone. Pieces find their slot by
    their rank among pieces of the same length; ranks are exact and no task ranks a whole length.
    """
    stored = written(pieces, "packing-pieces")
    histogram = {r.length: r.n for r in stored.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = slots_of(pack_histogram(histogram, max_length))
    key = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("start").cast("string"))
    ranked = bucketed_rank(
        stored.withColumn("_order", shuffle_key(key, "packing")), ["length"], "_order", ["doc_id", "start", "ids_crc32"], digits=3
    )
    return (
        ranked.withColumn("_place", placing(slots)("length", "rank"))
        .select(*pieces.columns, "_place.sequence_id", "_place.offset")
    )


def pack(
    docs: DataFrame,
    vocabulary: str,
    max_length: int = MAX_LENGTH,
    end_id: int | None = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids].

    Documents of more than ``max_length`` ids are cut into full pieces and a rest; no other document is
    cut. Null texts count as empty, null ids are kept, repeated rows are packed as often as they stand
    there, an empty table gives an empty result. Other columns of docs are not read.
    """
    pieces = pieces_of(docs, vocabulary, max_length, end_id, id_col, text_col, with_ids)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return assign(pieces, max_length).select(*names, *(["ids"] if with_ids else []))
