"""Masked pseudo-likelihood of documents under a bidirectional window network trained in numpy."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelworks.llm.common import hashes_of_texts, mix, prepare, written
from labelworks.llm.warc import filesystem
from labelworks.scratch import new_path

SPARSE = 2  # numbers for each different word of the corpus, at least; words get theirs by hash
DIGIT = 5  # bits of a word's number that are predicted together
SIDES = (-2, -1, 1, 2)  # the places that a masked word is predicted from
REACH = max(SIDES)
WIDTH = 16
BATCH = 4096
STEP = 1024  # masked words per step of training; every word of the corpus is masked once
RATE = 0.15
REGISTERS = 12  # bits; the number of different words is estimated with a standard error of 1.6 %
CHUNK = 1 << 19  # words whose rows are looked up at once
PART_WORDS = 24 << 20  # words that one task trains on, about; partitions are joined, not split
BLOCK_WORDS = 1 << 21  # words of the corpus for each block of keys that is averaged at once
ROWS_OUT = 50_000
EVERY = -1  # names the rows that every part reads

_PAIRS = np.arange(WIDTH // 2)


def registers(words: np.ndarray, held: np.ndarray) -> None:
    """Notes words in the registers of a HyperLogLog."""
    rest = (words & np.uint64((1 << (64 - REGISTERS)) - 1)).astype(np.float64)
    zeros = 64 - REGISTERS - np.floor(np.log2(np.maximum(rest, 0.5))).astype(np.int64)
    np.maximum.at(held, (words >> np.uint64(64 - REGISTERS)).astype(np.int64), zeros)


def counting():
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, words = np.zeros(1 << REGISTERS, np.int64), 0
        for batch in batches:
            for found, _ in hashes_of_texts(batch["text"]):
                registers(found, held)
                words += len(found)
        at = np.flatnonzero(held)
        if len(at):
            yield pd.DataFrame({"register": at, "zeros": held[at], "words": np.where(at == at[0], words, 0)})

    return count


def corpus_size(docs: DataFrame, text_col: str = "text") -> tuple[int, float]:
    """How many words all documents have, and about how many different ones."""
    parts = docs.select(F.col(text_col).alias("text")).mapInPandas(counting(), "register long, zeros long, words long")
    held, words = np.zeros(1 << REGISTERS), 0
    for r in parts.groupBy("register").agg(F.max("zeros").alias("zeros"), F.sum("words").alias("words")).collect():
        held[r.register] = r.zeros
        words += r.words
    n, empty = len(held), int((held == 0).sum())
    found = 0.7213 / (1 + 1.079 / n) * n * n / (2.0**-held).sum()
    return words, n * math.log(n / empty) if empty and found <= 2.5 * n else found


def bits_for(words: float) -> int:
    return max(DIGIT, math.ceil(math.log2(max(1.0, SPARSE * words))))


def as_tokens(words: np.ndarray, bits: int) -> np.ndarray:
    return (words >> np.uint64(64 - bits)).astype(np.int64)


def in_order(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the values in ascending order, the values in that order, and which are the first of their kind."""
    shift = max(1, len(values).bit_length())
    line = np.sort((values << shift) | np.arange(len(values)))
    values = line >> shift
    return line & ((1 << shift) - 1), values, firsts(values)


def firsts(ascending: np.ndarray) -> np.ndarray:
    out = np.ones(len(ascending), bool)
    np.not_equal(ascending[1:], ascending[:-1], out=out[1:])
    return out


def group_sums(rows: np.ndarray, first: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Sums of rows that lie group by group; two numbers are added at a time."""
    starts, pairs = np.flatnonzero(first), rows.view(np.complex64)
    if 8 * len(starts) < len(rows):
        return np.add.reduceat(pairs, starts, axis=0).view(np.float32)
    out = pairs.take(starts, axis=0)
    rest = np.flatnonzero(~first)
    np.add.at(out.reshape(-1), (group[rest][:, None] * len(_PAIRS) + _PAIRS).ravel(), pairs.take(rest, axis=0).ravel())
    return out.view(np.float32)


def _put(table: np.ndarray, places: np.ndarray, rows: np.ndarray) -> None:
    whole = np.dtype((np.void, table.itemsize * WIDTH))
    np.put(table.view(whole).ravel(), places, np.ascontiguousarray(rows).view(whole).ravel())


class Network:
    """A word's number is predicted digit by digit, each from the words on both sides and the digits before.

    Rows of ``WIDTH`` by key: one for each word, the border and each beginning of a number. Only rows in
    use are held. Besides them there are a few dense parameters, whatever the vocabulary.
    """

    def __init__(self, bits: int):
        self.bits, self.border = bits, 1 << bits
        self.levels, before, first = [], 0, self.border + 1  # (bits before, bits, key of the first beginning)
        while before < bits:
            self.levels.append((before, min(DIGIT, bits - before), first))
            first += 1 << before
            before += DIGIT
        rng = np.random.Generator(np.random.PCG64(7))
        self.dense = {"gates": rng.standard_normal((len(SIDES), WIDTH)).astype(np.float32) * 0.5 + 0.5, "bias": np.zeros(WIDTH, np.float32)}
        for i, (_, b, _) in enumerate(self.levels):
            self.dense[f"out{i}"] = rng.standard_normal((1 << b, WIDTH)).astype(np.float32) * 0.1
            self.dense[f"base{i}"] = np.zeros((2, WIDTH), np.float32)  # one value a digit
        self.keys = np.zeros(0, np.int64)  # ascending
        self.places = np.zeros(0, np.int64)  # of their rows
        self.rows = np.zeros((0, WIDTH), np.float32)

    def _base(self, i: int) -> np.ndarray:
        return self.dense[f"base{i}"].ravel()[: 1 << self.levels[i][1]]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places of the rows of different keys, given in ascending order."""
        at = np.searchsorted(self.keys, keys)
        if len(keys) and (not len(self.keys) or (self.keys[np.minimum(at, len(self.keys) - 1)] != keys).any()):
            raise ValueError("a word was not trained on here: the table's partitions changed between two jobs")
        return self.places[at]

    def look_up(self, line: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """Of a line of words: the rank of each among the different ones, these in ascending order, the places
        of their rows and, by level, of their beginnings."""
        order, ids, first = in_order(line)
        rank = np.empty(len(line), np.int64)
        rank[order] = np.cumsum(first) - 1
        different = ids[first]
        words = different[: np.searchsorted(different, self.border)]
        wanted, groups = [different], []
        for before, _, start in self.levels:
            begun = words >> (self.bits - before)
            new = firsts(begun)
            wanted.append(start + begun[new])
            groups.append(np.cumsum(new) - 1)
        places = self.find(np.concatenate(wanted))
        ends = np.cumsum([len(w) for w in wanted])
        return rank, different, places[: ends[0]], [places[a:b][g] for a, b, g in zip(ends, ends[1:], groups)]

    def hidden(self, near: list[np.ndarray]) -> np.ndarray:
        return np.tanh(sum(x * g for x, g in zip(near, self.dense["gates"])) + self.dense["bias"])

    def log_probabilities(self, line: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Of the own places of a line given the words on both of their sides; the rest are borders."""
        line = np.concatenate([np.full(REACH, self.border), line, np.full(REACH, self.border)])
        rank, different, places, begun = self.look_up(line)
        out = np.zeros(len(own), np.float32)
        for at in range(0, len(own), BATCH):
            to = np.flatnonzero(own[at : at + BATCH])
            n = len(own[at : at + BATCH])
            x = self.rows.take(places[rank[at : at + n + 2 * REACH]], axis=0)
            h = self.hidden([x[REACH + s : REACH + s + n] for s in SIDES])[to]
            r = rank[at + REACH + to]
            target, total, each = different[r], np.zeros(len(to), np.float32), np.arange(len(to))
            for i, (before, b, _) in enumerate(self.levels):
                z = self.dense[f"out{i}"] @ (h + self.rows.take(begun[i][r], axis=0)).T
                z += self._base(i)[:, None]
                z -= z.max(axis=0)
                total += z[(target >> (self.bits - before - b)) & ((1 << b) - 1), each]
                total -= np.log(np.exp(z, out=z).sum(axis=0))
            out[at + to] = total
        return out

    def dense_rows(self) -> np.ndarray:
        return np.concatenate([v.reshape(-1, WIDTH) for v in self.dense.values()])

    def set_dense(self, rows: np.ndarray) -> None:
        at = 0
        for k, v in self.dense.items():
            n = v.size // WIDTH
            self.dense[k] = rows[at : at + n].reshape(v.shape).astype(np.float32)
            at += n


class Trainer(Network):
    """One pass of AdaGrad over the tokens of a task."""

    def __init__(self, bits: int):
        super().__init__(bits)
        # A level's digits with their bases as the last column.
        self.digits = [np.column_stack([self.dense[f"out{i}"], self._base(i)]) for i in range(len(self.levels))]
        self.seen_dense = [np.full(v.shape, 1e-2, np.float32) for v in (self.dense["gates"], self.dense["bias"], *self.digits)]
        self.used = 0
        self.seen = np.zeros((0, WIDTH), np.float32)
        self.times = np.zeros(0, np.int64)
        self.n = 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places of the rows of different keys, given in ascending order; new ones get a row."""
        at = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), bool)
        inside = at < len(self.keys)
        new[inside] = self.keys[at[inside]] != keys[inside]
        if new.any():
            need = self.used + int(new.sum())
            if need > len(self.rows):
                room = max(need, len(self.rows) + len(self.rows) // 4)
                for table in (self.rows, self.seen):
                    table.resize((room, WIDTH), refcheck=False)
                self.times.resize(room, refcheck=False)
            self.seen[self.used : need] = 1e-2
            self.keys = np.insert(self.keys, at[new], keys[new])
            self.places = np.insert(self.places, at[new], np.arange(self.used, need))
            self.used = need
            at += np.cumsum(new) - new
        return self.places[at]

    def _move(self, i: int, values: np.ndarray, gradient: np.ndarray) -> None:
        self.seen_dense[i] += gradient * gradient
        values -= RATE * gradient / np.sqrt(self.seen_dense[i])

    def dense_rows(self) -> np.ndarray:
        for i, v in enumerate(self.digits):
            self.dense[f"out{i}"] = v[:, :WIDTH].copy()
            self._base(i)[:] = v[:, WIDTH]
        return super().dense_rows()

    def learn(self, pieces: list[list[np.ndarray]]) -> None:
        """Steps of pieces of texts; a piece has ``REACH`` more places on both sides, which are no targets."""
        sizes = [[len(p) - 2 * REACH for p in step] for step in pieces]
        own = np.zeros(sum(len(p) for step in pieces for p in step), bool)
        at, ends = 0, []
        for step in sizes:
            for n in step:
                own[at + REACH : at + REACH + n] = True
                at += n + 2 * REACH
            ends.append(at)
        rank, different, places, begun = self.look_up(np.concatenate([p for step in pieces for p in step]))
        for start, end in zip([0, *ends], ends):
            self.step(rank[start:end], own[start:end], different, places, begun)
        targets = np.bincount(rank[own], minlength=len(different))
        near = np.zeros(len(rank), np.int64)
        for s in SIDES:
            near[REACH + s : len(rank) - REACH + s] += own[REACH:-REACH]
        self.times[places] += np.bincount(rank, weights=near, minlength=len(different)).astype(np.int64)
        for p in begun:
            np.add.at(self.times, p, targets[: len(p)])
        self.n += int(targets.sum())

    def step(self, rank: np.ndarray, own: np.ndarray, different: np.ndarray, word_places: np.ndarray, begun_places: list[np.ndarray]) -> None:
        order, ranks, first = in_order(rank)
        word = np.cumsum(first) - 1
        is_target = own[order]
        at = order[is_target] - REACH  # of the targets by number, so that those with one beginning lie together
        target_rank = ranks[is_target]
        target, n = different[target_rank], len(at)
        new = [firsts(target >> (self.bits - before)) for before, _, _ in self.levels]
        group = [np.cumsum(f) - 1 for f in new]
        kinds = [word_places[ranks[first]], *(p[target_rank[f]] for p, f in zip(begun_places, new))]
        places = np.concatenate(kinds)
        ends = np.cumsum([len(k) for k in kinds])
        rows = self.rows.take(places, axis=0)

        of_place = np.empty(len(rank), np.int64)
        of_place[order] = word
        x, inner = rows.take(of_place, axis=0), len(rank) - 2 * REACH
        near = [x[REACH + s : REACH + s + inner] for s in SIDES]
        h = self.hidden(near).take(at, axis=0)
        d_h, sums, each = np.zeros_like(h), [], np.arange(n)
        state = np.ones((n, WIDTH + 1), np.float32)
        for i, (before, b, _) in enumerate(self.levels):
            np.add(h, rows[ends[i] : ends[i + 1]].take(group[i], axis=0), out=state[:, :WIDTH])
            d = self.digits[i] @ state.T
            d -= d.max(axis=0)
            np.exp(d, out=d)
            d *= 1 / d.sum(axis=0)
            d.reshape(-1)[((target >> (self.bits - before - b)) & ((1 << b) - 1)) * n + each] -= 1
            d_begun = d.T @ self.digits[i][:, :WIDTH]
            d_h += d_begun
            self._move(2 + i, self.digits[i], d @ state)
            sums.append(group_sums(d_begun, new[i], group[i]))
        d_h *= 1 - h * h
        d_line = np.zeros((inner, WIDTH), np.float32)
        d_line[at] = d_h
        ones, d_words = np.ones(inner, np.float32), np.zeros((len(rank), WIDTH), np.float32)
        for s, gate in zip(SIDES, self.dense["gates"]):
            d_words[REACH + s : REACH + s + inner] += d_line * gate
        self._move(0, self.dense["gates"], np.stack([ones @ (d_line * v) for v in near]))
        self._move(1, self.dense["bias"], ones @ d_line)

        summed = np.concatenate([group_sums(d_words.take(order, axis=0), first, word), *sums])
        seen = self.seen.take(places, axis=0)
        seen += summed * summed
        _put(self.seen, places, seen)
        summed *= np.float32(RATE)
        summed /= np.sqrt(seen)
        rows -= summed
        _put(self.rows, places, rows)

    def parts(self, part: int, blocks: int) -> Iterator[pd.DataFrame]:
        """The keys by block, how often each was used, and their rows; dense rows are block -1."""

        def block(number: int, keys: np.ndarray, times: np.ndarray, rows: np.ndarray) -> dict:
            steps = np.diff(keys, prepend=0)
            return {"block": number, "part": part, "n": self.n, "keys": steps.tobytes(), "times": times.tobytes(), "rows": rows.tobytes()}

        dense = self.dense_rows()
        out = [block(-1, -1 - np.arange(len(dense)), np.full(len(dense), self.n), dense)]
        of_key = (mix(self.keys.astype(np.uint64)) % np.uint64(blocks)).astype(np.int64)
        order = np.argsort(of_key, kind="stable")
        ends = np.cumsum(np.bincount(of_key, minlength=blocks))
        held = 0
        for number, (start, end) in enumerate(zip([0, *ends], ends)):
            if start < end:
                places = self.places[order[start:end]]
                out.append(block(number, self.keys[order[start:end]], self.times[places], self.rows.take(places, axis=0)))
                held += end - start
            if held >= ROWS_OUT:
                yield pd.DataFrame(out)
                out, held = [], 0
        if out:
            yield pd.DataFrame(out)


def training(bits: int, blocks: int = 1):
    def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trainer, part = Trainer(bits), 0
        border = np.full(REACH, trainer.border)
        steps, step, held, ready = [], [], 0, 0
        for batch in batches:
            part = int(batch["part"].iloc[0]) if "part" in batch and len(batch) else part
            for found, sizes in hashes_of_texts(batch["text"]):
                ids, start = as_tokens(found, bits), 0
                for size in sizes:
                    padded = np.concatenate([border, ids[start : start + size], border])
                    start += size
                    for at in range(0, size, STEP):
                        step.append(padded[at : at + STEP + 2 * REACH])
                        held += len(step[-1]) - 2 * REACH
                        if held >= STEP:
                            steps.append(step)
                            ready += held
                            step, held = [], 0
                        if ready >= CHUNK:
                            trainer.learn(steps)
                            steps, ready = [], 0
        if held:
            steps.append(step)
        if steps:
            trainer.learn(steps)
        if trainer.n:
            yield from trainer.parts(part, blocks)

    return train


def _read_block(keys: bytes, rows: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(np.frombuffer(keys, np.int64)), np.frombuffer(rows, np.float32).reshape(-1, WIDTH)


def averaging(parts: int):
    def average(found: pd.DataFrame) -> pd.DataFrame:
        """Of one block: rows averaged by how often each task used them. Rows that more than half of the
        tasks use are given once, for every part; others for each part that uses them."""
        keys, rows = zip(*(_read_block(k, r) for k, r in zip(found["keys"], found["rows"])))
        different = np.unique(np.concatenate(keys))
        sums, times, users = np.zeros((len(different), WIDTH)), np.zeros(len(different)), np.zeros(len(different), np.int64)
        places = [np.searchsorted(different, k) for k in keys]
        for at, r, t in zip(places, rows, found["times"]):
            n = np.frombuffer(t, np.int64)
            sums[at] += r * n[:, None].astype(np.float64)
            times[at] += n
            users[at] += 1
        mean = (sums / np.maximum(times, 1)[:, None]).astype(np.float32)  # a word alone in its text is never beside a masked one
        every = (2 * users > parts) | (different < 0)
        out = [(EVERY, different[every], mean[every])]
        for part, at in zip(found["part"], places):
            at = at[~every[at]]
            out.append((part, different[at], mean[at]))
        return pd.DataFrame([{"part": p, "keys": np.diff(k, prepend=0).tobytes(), "rows": r.tobytes()} for p, k, r in out if len(k)], columns=["part", "keys", "rows"])

    return average


def trained(docs: DataFrame, text_col: str = "text") -> tuple[int, DataFrame, str]:
    """Trains on every word of every document: each task on its part from the same start, then rows are
    averaged by how often each task used them. (bits, the documents in parts, path of the model): the model is a
    table (part, keys, rows) in the shared folder; a part's rows are those of its words and those of ``EVERY``."""
    prepare(docs.sparkSession)
    words, different = corpus_size(docs, text_col)
    bits, parts = bits_for(different), max(1, math.ceil(words / PART_WORDS))
    docs = docs.coalesce(parts).withColumn("_part", F.spark_partition_id())
    texts = docs.select(F.col("_part").alias("part"), F.col(text_col).alias("text"))
    found = texts.mapInPandas(
        training(bits, max(1, math.ceil(words / BLOCK_WORDS))), "block long, part int, n long, keys binary, times binary, rows binary"
    )
    path = new_path(docs.sparkSession, "lm-rows")
    found.groupBy("block").applyInPandas(averaging(parts), "part int, keys binary, rows binary").write.partitionBy("part").parquet(path)
    return bits, docs, path


def part_rows(path: str, part: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Dense rows, keys in ascending order and rows that a part of the documents needs."""
    import pyarrow.parquet as pq
    from pyarrow import fs as pafs

    fs, root = filesystem(path)
    files = [f for p in (EVERY, part) for f in fs.get_file_info(pafs.FileSelector(f"{root}/part={p}", allow_not_found=True)) if f.path.endswith(".parquet")]
    blocks = []
    for f in files:
        with fs.open_input_file(f.path) as source:
            found = pq.read_table(source, columns=["keys", "rows"])
        blocks += [_read_block(k, r) for k, r in zip(found["keys"].to_pylist(), found["rows"].to_pylist())]
    return joined(blocks)


def joined(blocks: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys = np.concatenate([k for k, _ in blocks]) if blocks else np.zeros(0, np.int64)
    rows = np.concatenate([r for _, r in blocks]) if blocks else np.zeros((0, WIDTH), np.float32)
    order = np.argsort(keys, kind="stable")
    order = order[firsts(keys[order])]
    dense = int(np.searchsorted(keys[order], 0))
    return rows[order[:dense][::-1]], keys[order[dense:]], rows[order[dense:]]


def fit(docs: DataFrame, text_col: str = "text") -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """The whole model of ``trained`` on the driver, for a vocabulary that fits there: (bits, dense rows, keys, rows)."""
    bits, docs, path = trained(docs, text_col)
    model = docs.sparkSession.read.schema("keys binary, rows binary, part int").parquet(path)
    dense, keys, rows = joined([_read_block(bytes(r["keys"]), bytes(r["rows"])) for r in model.toLocalIterator()])
    return bits, dense if len(dense) else Network(bits).dense_rows(), keys, rows


def network(bits: int, dense: np.ndarray, keys: np.ndarray, rows: np.ndarray) -> Network:
    """``keys`` ascending, with a row each."""
    out = Network(bits)
    if len(dense):
        out.set_dense(dense)
    out.keys, out.places, out.rows = keys, np.arange(len(keys)), rows
    return out


def scoring(bits: int, path: str):
    @F.pandas_udf("n_tokens long, log_likelihood double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        net, held = None, None
        gap = np.full(REACH, 1 << bits)
        for parts, texts in batches:
            counts, totals = [], []
            for found, sizes in hashes_of_texts(texts):
                if len(found) and held != parts.iloc[0]:
                    held = parts.iloc[0]
                    net = None  # its rows go before others come
                    net = network(bits, *part_rows(path, held))
                # Texts go through the network together, kept apart by borders.
                starts = np.cumsum(sizes + REACH) - sizes - REACH
                line = np.full(int((sizes + REACH).sum()), 1 << bits)
                own = np.ones(len(line), bool)
                for k in range(REACH):
                    own[starts + sizes + k] = False
                line[own] = as_tokens(found, bits)
                scores = net.log_probabilities(line, own).astype(np.float64) if len(found) else np.zeros(len(line))
                counts.append(sizes)
                totals.append(np.add.reduceat(scores, starts))
            yield pd.DataFrame({"n_tokens": np.concatenate(counts), "log_likelihood": np.concatenate(totals)})

    return score


def pseudo_likelihood(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, log_likelihood (sum over its tokens), per_token.

    Tokens are words by hash, at least ``SPARSE`` numbers for each different word. Null texts, empty texts
    and texts without words have no tokens, log_likelihood 0 and per_token null. Repeated rows get equal
    scores and count as often in training. An empty table gives an empty result; other columns are not read.

    The documents are read three times in the same partitions; where their plan shuffles, they are stored first.
    The model never is on the driver: a task reads the rows of its part from the shared folder, which must be in a
    store that pyarrow knows.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    if "Exchange" in docs._jdf.queryExecution().executedPlan().toString():
        docs = written(docs, "lm-texts")
    bits, docs, path = trained(docs)
    return docs.select("doc_id", scoring(bits, path)("_part", "text").alias("_s")).select(
        "doc_id",
        "_s.n_tokens",
        "_s.log_likelihood",
        F.when(F.col("_s.n_tokens") > 0, F.col("_s.log_likelihood") / F.col("_s.n_tokens")).alias("per_token"),
    )
