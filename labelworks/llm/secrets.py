"""Secrets in texts: fixed patterns, and a linear-chain conditional random field over tokens."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelworks.llm.common import BATCH_ROWS, _power, batches_of, mix, written

ASSIGN = re.compile(
    r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{24,}")
KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "crf")

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Matches of the fixed patterns as (kind, start, end), leftmost and without overlap within a kind."""
    return [s[:3] for s in _matches(text)]


def _matches(text: str) -> list[tuple[str, int, int, int, int]]:
    """Base spans with the place of the secret itself."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [("assign", *m.span(), *m.span(1)) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span(), *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [("hex", *m.span(), *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


# Tokens and their features. A token is a maximal run of ASCII letters, digits, + / _ . - and characters
# outside ASCII; all else separates.
_KIND = np.zeros(129, np.uint8)  # 0 separator, 1 a-f, 2 g-z, 3 A-Z, 4 digit, 5 sign, 6 not ASCII
_KIND[ord("a") : ord("g")], _KIND[ord("g") : ord("z") + 1], _KIND[ord("A") : ord("Z") + 1] = 1, 2, 3
_KIND[ord("0") : ord("9") + 1], _KIND[[ord(c) for c in "+/_.-"]], _KIND[128] = 4, 5, 6
_PLACE = np.full(129, 6, np.uint8)  # what stands around: 1 space, 2 line end, 3 =, 4 :, 5 quote, 6 else, 7 token
for _c, _n in ((" ", 1), ("\t", 1), ("\n", 2), ("\r", 2), ("=", 3), (":", 4), ('"', 5), ("'", 5)):
    _PLACE[ord(_c)] = _n
_PLACE[np.flatnonzero(_KIND)] = 7
_FOLD = np.arange(129, dtype=np.uint64)
_FOLD[ord("A") : ord("Z") + 1] += 32
# Two sets of three counts, 21 bits each: digits, capitals, a-f; signs, not ASCII, changes of kind.
_FIELD = (1 << 21) - 1
_COUNTS = np.zeros((2, 7), np.int64)
_COUNTS[0, 4], _COUNTS[0, 3], _COUNTS[0, 1] = 1, 1 << 21, 1 << 42
_COUNTS[1, 5], _COUNTS[1, 6] = 1, 1 << 21
_LENGTHS = np.array([2, 4, 7, 11, 15, 19, 23, 31, 47])  # upper ends of the length classes
WORDS = 1 << 13  # hash classes of neighbouring words
SIZES = (600, 100, 512, 64, WORDS, WORDS, WORDS, 40, 40, 32)
OFFSETS = np.concatenate([[0], np.cumsum(SIZES)[:-1]]).astype(np.int32)
JOINED = 1 << 20  # characters worked on at once; longer texts are tagged in pieces, cut between tokens
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = pow(int(_BASE), -1, 1 << 64)


@dataclass
class Tokens:
    """Tokens of several texts: places in their text, number of the text, features (one column each)."""

    start: np.ndarray
    end: np.ndarray
    owner: np.ndarray
    features: np.ndarray


def _file_class(text: str) -> int:
    """How often lines end, and how often signs of code and settings occur, in sixteen classes."""
    n = max(1, len(text))
    lines = text.count("\n") / n
    signs = sum(text.count(c) for c in "=:;{}") / n
    return 4 * int(np.searchsorted([0.0005, 0.01, 0.04], lines)) + int(np.searchsorted([0.001, 0.01, 0.04], signs))


def tokens(texts: list[str], classes: list[int]) -> Tokens:
    """Tokens of texts that are worked on together; nothing crosses from one text to the next."""
    sizes = np.array([len(t) + 3 for t in texts])
    begin = np.cumsum(sizes) - sizes
    codes = np.frombuffer("".join(t + "\n\n\n" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    low = np.minimum(codes, 128).astype(np.uint8)
    kind = _KIND[low]
    inside = np.zeros(len(codes) + 2, np.int8)
    inside[1:-1] = kind > 0
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    owner = np.searchsorted(begin, start, "right") - 1
    length = end - start

    def summed(values: np.ndarray) -> np.ndarray:
        total = np.zeros(len(values) + 1, values.dtype)
        np.cumsum(values, out=total[1:])
        return total[end] - total[start]

    one = summed(_COUNTS[0][kind])
    other = _COUNTS[1][kind]
    other[1:] += ((kind[1:] != kind[:-1]) & (kind[:-1] > 0)).astype(np.int64) << 42
    two = summed(other)
    digits, capitals, hexes = one & _FIELD, one >> 21 & _FIELD, one >> 42
    signs, foreign, changes = two & _FIELD, two >> 21 & _FIELD, two >> 42
    folded = np.where(codes < 128, _FOLD[low], codes.astype(np.uint64))
    power = summed((folded + np.uint64(1)) * _power(int(_BASE), len(codes)))
    word = (mix(power * _power(_INVERSE, len(codes))[start]) % np.uint64(WORDS)).astype(np.int32)

    size = np.searchsorted(_LENGTHS, length)
    share = np.select([digits == 0, 5 * digits < length, 2 * digits < length, digits < length], [0, 1, 2, 3], 4)
    upper = np.select([capitals == 0, 2 * capitals < length], [0, 1], 2)
    shape = (((size * 5 + share) * 3 + upper) * 2 + (digits + hexes == length)) * 2 + (signs > 0)
    shape = np.where(foreign > 0, 0, shape)
    coarse = (size * 2 + (digits > 0)) * 2 + (capitals > 0)
    place = np.full(len(codes) + 6, 2, np.uint8)
    place[3:-3] = _PLACE[low]
    before = (place[start + 2].astype(np.int32) * 8 + place[start + 1]) * 8 + place[start]
    after = place[end + 3].astype(np.int32) * 8 + place[end + 4]

    def neighbour(values: np.ndarray, by: int, none: int = 0) -> np.ndarray:
        out = np.full(len(values), none, np.int32)
        if by < 0 and len(values) > -by:
            same = owner[-by:] == owner[:by]
            out[-by:] = np.where(same, values[:by], none)
        elif by > 0 and len(values) > by:
            same = owner[:-by] == owner[by:]
            out[:-by] = np.where(same, values[by:], none)
        return out

    columns = [
        shape, np.minimum(changes, 9) * 10 + size, before, after, neighbour(word, -1), neighbour(word, -2),
        neighbour(word, 1), neighbour(coarse, -1), neighbour(coarse, 1),
        np.array(classes, np.int32)[owner] * 2 + (digits > 0),
    ]
    features = np.empty((len(columns), len(start)), np.int32)
    for i, c in enumerate(columns):
        features[i] = OFFSETS[i] + c
    return Tokens(start - begin[owner], end - begin[owner], owner, features)


# The field: tags 0 outside, 1 begin, 2 inside; inside never follows outside.
_NEVER = -1e9


@dataclass
class Field:
    """Weights of features by tag, and of steps from tag to tag."""

    weights: np.ndarray
    steps: np.ndarray

    def scores(self, features: np.ndarray) -> np.ndarray:
        out = np.zeros((features.shape[1], 3), np.float32)
        for column in features:
            out += self.weights[column]
        return out

    def tags(self, scores: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Most probable tags of each text (Viterbi).

        A token that prefers outside by more than any change of steps around it can bring is outside on every
        best path, so paths are only searched between such tokens; the result is that of the whole text.
        """
        n = len(scores)
        tags = np.zeros(n, np.int8)
        if not n:
            return tags
        allowed = self.steps[self.steps > _NEVER / 2]
        bound = 3 * float(allowed.max() - allowed.min()) + 1e-3
        last = np.r_[owner[1:] != owner[:-1], True]
        ahead = np.where(last, 0, np.r_[np.maximum(0, scores[1:, 2] - scores[1:, 1]), 0])
        settled = scores[:, 0] - scores[:, 1:].max(axis=1) > bound + ahead
        open_ = np.flatnonzero(~settled)
        if not len(open_):
            return tags
        first = np.r_[True, owner[1:] != owner[:-1]]
        cut = np.flatnonzero(np.r_[True, (np.diff(open_) > 1) | first[open_[1:]]])
        for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(open_)]):
            a, b = int(open_[i]), int(open_[j - 1]) + 1
            tags[a:b] = self._path(scores[a:b].tolist(), bool(first[a]), bool(last[b - 1]))
        return tags

    def _path(self, scores: list[list[float]], begins: bool, ends: bool) -> list[int]:
        steps = self.steps.tolist()
        best = [scores[0][t] + (0.0 if begins else steps[0][t]) for t in range(3)]
        if begins:
            best[2] = _NEVER
        back = []
        for row in scores[1:]:
            came, now = [], []
            for t in range(3):
                ways = [best[u] + steps[u][t] for u in range(3)]
                u = max(range(3), key=ways.__getitem__)
                came.append(u)
                now.append(ways[u] + row[t])
            back.append(came)
            best = now
        if not ends:
            best = [best[t] + steps[t][0] for t in range(3)]
        path = [max(range(3), key=best.__getitem__)]
        for came in reversed(back):
            path.append(came[path[-1]])
        return path[::-1]


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def fit(features: np.ndarray, tags: np.ndarray, rounds: int = 40, rate: float = 0.2, ridge: float = 1e-3) -> Field:
    """Fits by conditional likelihood. ``features``: windows x tokens x columns, -1 where a window is short;
    ``tags``: windows x tokens. Forward-backward over all windows at once, steps by Adam."""
    total = int(sum(SIZES))
    windows, width, columns = features.shape
    there = features[:, :, 0] >= 0
    index = np.where(there[:, :, None], features, total)  # padding has a row of its own
    flat = index.reshape(-1, columns)
    weights = np.zeros((total + 1, 3))
    steps = np.zeros((3, 3))
    steps[0, 2] = _NEVER
    gold = np.eye(3)[tags] * there[:, :, None]
    gold_steps = np.einsum("nta,ntb->ab", gold[:, :-1], gold[:, 1:])
    moment = [np.zeros_like(weights), np.zeros_like(steps)]
    square = [np.zeros_like(weights), np.zeros_like(steps)]
    for r in range(1, rounds + 1):
        e = weights[flat].sum(axis=1).reshape(windows, width, 3)
        forward = np.empty_like(e)
        forward[:, 0] = e[:, 0] + [0.0, 0.0, _NEVER]
        for t in range(1, width):
            on = e[:, t] + _logsum(forward[:, t - 1, :, None] + steps, 1)
            forward[:, t] = np.where(there[:, t, None], on, forward[:, t - 1])
        norm = _logsum(forward[:, -1], 1)
        backward = np.zeros_like(e)
        pairs = np.zeros((3, 3))
        for t in range(width - 2, -1, -1):
            ways = steps + (e[:, t + 1] + backward[:, t + 1])[:, None, :]
            backward[:, t] = np.where(there[:, t + 1, None], _logsum(ways, 2), 0)
            p = np.exp(forward[:, t, :, None] + ways - norm[:, None, None])
            pairs += (p * there[:, t + 1, None, None]).sum(axis=0)
        # A short window's forward scores stand still after its end, and its backward scores are 0 there.
        p = np.exp(forward + backward - norm[:, None, None]) * there[:, :, None]
        wrong = (p - gold).reshape(-1, 3)
        slope = np.stack(
            [np.bincount(flat.ravel(), np.repeat(wrong[:, k], columns), total + 1) for k in range(3)], axis=1
        )
        slopes = [slope / windows + ridge * weights, (pairs - gold_steps) / windows + ridge * np.where(steps > _NEVER / 2, steps, 0)]
        slopes[0][total] = 0
        slopes[1][0, 2] = 0
        for k, (value, g) in enumerate(zip((weights, steps), slopes)):
            moment[k] = 0.9 * moment[k] + 0.1 * g
            square[k] = 0.99 * square[k] + 0.01 * g * g
            value -= rate * (moment[k] / (1 - 0.9**r)) / (np.sqrt(square[k] / (1 - 0.99**r)) + 1e-8)
    return Field(weights[:total].astype(np.float32), steps)


# Training rows: windows around base spans, which give the tags, and around other tokens.
HALF = 10  # tokens on each side of a window's middle
PER_TEXT = 4  # windows of a text


def _pieces(text: str) -> Iterator[tuple[int, str]]:
    """(offset, part) of a text, cut between tokens where it is longer than ``JOINED``."""
    at = 0
    while len(text) - at > JOINED:
        end = at + JOINED
        while end < len(text) and _KIND[min(128, ord(text[end]))]:
            end += 1
        yield at, text[at:end]
        at = end
    yield at, text[at:]


def _windows(text: str) -> tuple[list[int], list[int]]:
    """Flat features and tags of the windows of one text."""
    features, tags = [], []
    matches = _matches(text)
    kind = _file_class(text)
    for at, piece in _pieces(text):
        t = tokens([piece], [kind])
        if not len(t.start):
            continue
        gold = np.zeros(len(t.start), np.int8)
        for _, _, _, a, b in matches:
            i, j = np.searchsorted(t.end + at, a, "right"), np.searchsorted(t.start + at, b, "left")
            if i < j and not gold[i:j].any():
                gold[i], gold[i + 1 : j] = 1, 2
        odd = np.flatnonzero((gold == 0) & (t.end - t.start >= 8) & (t.features[9] % 2 == 1))
        middles = np.concatenate(
            [np.flatnonzero(gold == 1)[:PER_TEXT], odd[:1], [int(mix(np.array([len(text)], np.uint64))[0] % len(gold))]]
        ).astype(int)
        for m in middles[:PER_TEXT].tolist():
            a, b = max(0, m - HALF), m + HALF + 1
            x = t.features[:, a:b].T
            pad = 2 * HALF + 1 - len(x)
            features += [*x.ravel().tolist(), *[-1] * (pad * len(SIZES))]
            y = gold[a:b].copy()
            if y[0] == 2:
                y[0] = 1
            tags += [*y.tolist(), *[0] * pad]
        if len(tags) >= PER_TEXT * (2 * HALF + 1):
            break
    return features, tags


def _windowing():
    @F.pandas_udf("features array<int>, tags array<int>")
    def windowed(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_windows(t) for t in texts], columns=["features", "tags"])

    return windowed


def train(docs: DataFrame, text_col: str = "text", sample_rows: int = 750) -> Field | None:
    """Fits the field on windows of at most ``sample_rows`` different texts with base spans and as many without
    (those of the smallest hashes); None where no text has a base span. Base spans give the tags."""
    text = F.col(text_col)
    marked = text.rlike("[0-9a-f]{24}") | F.contains(text, F.lit("AKIA"))
    for k in KEYWORDS:
        marked |= F.contains(F.lower(text), F.lit(k))
    rows = docs.filter(text != "").select(F.xxhash64(text).alias("h"), text.alias("text"), marked.alias("marked"))
    keys = written(rows.groupBy("h").agg(F.first("marked").alias("marked")), "secret-keys")
    chosen = None
    for flag in (True, False):
        part = keys.filter(F.col("marked") == flag).orderBy("h").limit(sample_rows).select("h")
        chosen = part if chosen is None else chosen.union(part)
    with batches_of(docs.sparkSession, BATCH_ROWS):
        # Copies of a chosen text give equal windows; one of them stays.
        found = (
            rows.join(written(chosen, "secret-chosen"), "h")
            .select("h", _windowing()("text").alias("w"))
            .groupBy("h")
            .agg(F.first("w").alias("w"))
            .select("w.*")
            .collect()
        )
    width = 2 * HALF + 1
    tags = np.array([y for r in found for y in r["tags"]], np.int64).reshape(-1, width)
    if not (tags == 1).any():
        return None
    features = np.array([x for r in found for x in r["features"]], np.int32).reshape(-1, width, len(SIZES))
    return fit(features, tags)


def _added(field: Field | None, texts: list[str], base: list[list[Span]]) -> list[list[Span]]:
    """Spans that the field finds outside base spans."""
    out: list[list[Span]] = [[] for _ in texts]
    if field is None:
        return out
    queue: list[tuple[int, int, str, int]] = []
    held = 0

    def tag() -> None:
        t = tokens([q[2] for q in queue], [q[3] for q in queue])
        tags = field.tags(field.scores(t.features), t.owner)
        begins = np.flatnonzero(tags == 1)
        for i in begins.tolist():
            j = i
            while j + 1 < len(tags) and tags[j + 1] == 2 and t.owner[j + 1] == t.owner[i]:
                j += 1
            number, offset = queue[t.owner[i]][:2]
            a, b = int(t.start[i]) + offset, int(t.end[j]) + offset
            if not any(a < y and x < b for _, x, y in base[number]):
                out[number].append(("crf", a, b))

    for number, text in enumerate(texts):
        kind = _file_class(text)
        for offset, piece in _pieces(text):
            if held and held + len(piece) > JOINED:
                tag()
                queue, held = [], 0
            queue.append((number, offset, piece, kind))
            held += len(piece)
    if queue:
        tag()
    return out


def scanning(field: Field | None):
    @F.pandas_udf("array<struct<kind: string, start: long, end: long>>")
    def scan_texts(texts: pd.Series) -> pd.Series:
        whole = [t or "" for t in texts]
        base = [base_spans(t) for t in whole]
        more = _added(field, whole, base)
        spans = [sorted(a + b, key=lambda s: (s[1], KINDS.index(s[0]))) for a, b in zip(base, more)]
        return pd.Series([[dict(zip(("kind", "start", "end"), s)) for s in row] for row in spans])

    return scan_texts


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 750) -> DataFrame:
    """One row per document: doc_id, spans (kind, start, end in code points), by start, then kind.

    Kinds ``assign``, ``access`` and ``hex`` are the fixed patterns. Kind ``crf`` are spans that the field
    adds; those that overlap a fixed one are left out. The field tags tokens as begin, inside or outside by their
    shape, the words and signs around them, and how much the text looks like code or settings. It is
    fitted on the documents themselves, with the fixed patterns as labels (``train``), and decoded by Viterbi.
    Null and empty texts have no spans; repeated rows give repeated rows; null ids stay. Without any fixed
    match in the table nothing is added. An empty table gives an empty result; other columns are not read.
    """
    field = train(docs, text_col, sample_rows)
    with batches_of(docs.sparkSession, BATCH_ROWS):
        return written(
            docs.select(F.col(id_col).alias("doc_id"), scanning(field)(text_col).alias("spans")), "secret-spans"
        )


def _text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan(docs: DataFrame, **settings) -> DataFrame:
    """Counts and digests of ``secret_spans``: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    base = F.filter("spans", lambda s: s["kind"] != "crf")
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as long) AS n_{k}") for k in KINDS[:3]]
    return secret_spans(docs, **settings).select(
        "doc_id", *counts, F.sha2(_text(base), 256).alias("base_sha256"), _text(F.col("spans")).alias("spans")
    )
