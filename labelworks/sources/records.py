"""Rows of CSV files read in byte ranges, also where quoted cells hold line breaks.

A line break ends a row only outside quotes, and whether a range starts inside quotes hangs on all text
before it. Every line therefore reports how it would end under both assumptions, ranges put their lines
together, and a prefix over the ranges of a file settles which assumption holds. Ranges are then parsed
in parallel; what two or more of them share of a row is joined afterwards.
"""

from __future__ import annotations

import csv
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import stored

# A quoted cell up to its closing quote, and a line that ends inside one. Possessive, so that long cells
# need neither stack nor a second try.
_QUOTED = '"[^"]*+(?:""[^"]*+)*+'
_ENDS_OPEN = rf'^(?:(?!")[^,\r]*+[,\r]|{_QUOTED}"[^,\r]*+[,\r])*+{_QUOTED}\z'
_AFTER_RETURN = re.compile("(?<=\r)")
BROADCAST_RANGES = 50_000  # ranges known to start inside quotes; more are joined by sorting
CELL_CHARS = 1 << 40

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of the library


def read_csv_rows(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, ord, cells) of every row that is not an empty line, in a stored table.

    Cells are separated by commas; a cell that begins with a quote goes on to its closing quote, a quote
    in it is doubled, and what follows the closing quote up to the comma belongs to the cell. Elsewhere a
    quote is text. Rows end at ``\\n``, ``\\r\\n`` or ``\\r`` outside quotes; a quote that never closes
    takes the rest of the file (but its last line break). A byte order mark goes. ``ord`` rises in the order of a file's rows.

    Files are read in ranges of ``spark.sql.files.maxPartitionBytes``, so a large file is many tasks;
    compressed ones are one task. Text is scanned twice and is not shuffled, unless more than
    ``BROADCAST_RANGES`` ranges start inside quotes.
    """
    lines = _lines(spark, path)
    ends = lines.select("file", "start", "from_out", "from_in").mapInArrow(
        _range_ends, "file string, start bigint, from_out boolean, from_in boolean"
    )
    inside = stored(_starts_inside(ends), "csv-ranges")
    known = inside.count()
    laid = lines.withColumn("inside", F.lit(False))
    if known:
        flagged = inside.withColumn("_in", F.lit(True))
        small = known <= BROADCAST_RANGES
        if not small:
            lines = lines.withColumn("_id", F.monotonically_increasing_id())
        laid = lines.join(F.broadcast(flagged) if small else flagged, ["file", "start"], "left")
        laid = laid.withColumn("inside", F.coalesce("_in", F.lit(False))).drop("_in")
        if not small:
            laid = laid.sortWithinPartitions("file", "start", "_id").drop("_id")
    schema = "file string, start bigint, ord bigint, cells array<string>, tail boolean, text string"
    parts = stored(laid.mapInArrow(_range_rows, schema), "csv-parts")
    whole = parts.filter("tail is null").select("file", "ord", "cells")
    return whole.unionByName(_joined(parts.filter("tail is not null")))


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines with their range, and whether each ends inside quotes if it begins outside or inside."""
    text = spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value"
    )
    text = text.withColumn(
        "value", F.when(F.col("start") == 0, F.regexp_replace("value", "^\\x{FEFF}", "")).otherwise(F.col("value"))
    )
    quoted = F.contains("value", F.lit('"'))
    opened = F.concat(F.lit('"'), "value")  # inside quotes reads as a row that begins with one
    return text.select(
        "*",
        (quoted & F.col("value").rlike(_ENDS_OPEN)).alias("from_out"),
        (~quoted | opened.rlike(_ENDS_OPEN)).alias("from_in"),
    )


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """Slices of a batch that belong to one range; a task reads each of its ranges as a whole."""
    if not batch.num_rows:
        return
    files = batch.column("file").dictionary_encode().indices.to_numpy(zero_copy_only=False)
    starts = batch.column("start").to_numpy(zero_copy_only=False)
    changes = np.flatnonzero((np.diff(files) != 0) | (np.diff(starts) != 0)) + 1
    edges = [0, *changes.tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        yield (batch.column("file")[a].as_py(), int(starts[a])), batch.slice(a, b - a)


def _composed(outs: np.ndarray, ins: np.ndarray) -> tuple[bool, bool]:
    """How lines in a row end: the last one that forgets where it began decides, later ones may turn it."""
    forgets = np.flatnonzero(outs == ins)
    after = forgets[-1] + 1 if len(forgets) else 0
    turned = bool(np.count_nonzero(outs[after:] & ~ins[after:]) & 1)
    if len(forgets):
        return (bool(outs[after - 1]) ^ turned,) * 2
    return turned, not turned


def _range_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, ends, done = None, (False, True), []
    for batch in batches:
        for k, run in _runs(batch):
            if k != key:
                if key is not None:
                    done.append((*key, *ends))
                key, ends = k, (False, True)
            step = _composed(*(run.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("from_out", "from_in")))
            ends = step[ends[0]], step[ends[1]]
    if key is not None:
        done.append((*key, *ends))
        names = ["file", "start", "from_out", "from_in"]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names)


def _starts_inside(ends: DataFrame) -> DataFrame:
    """(file, start) of the ranges that begin inside quotes."""
    w = Window.partitionBy("file").orderBy("start")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    forgets = F.col("from_out") == F.col("from_in")
    turns = (F.col("from_out") & ~F.col("from_in")).cast("int")
    ranges = ends.withColumn("turned", F.sum(turns).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.last(F.when(forgets, F.struct(F.col("from_out").cast("int").alias("v"), "turned")), ignorenulls=True)
    ranges = ranges.select(
        "file", "start", last.over(before).alias("last"), F.coalesce(F.lag("turned").over(w), F.lit(0)).alias("so_far")
    )
    state = F.coalesce(F.col("last.v"), F.lit(0)) + F.col("so_far") - F.coalesce(F.col("last.turned"), F.lit(0))
    return ranges.filter(state % 2 == 1).select("file", "start")


def _rows_of(record: str) -> list[list[str]]:
    """Cells of a row; of several, where a lone carriage return outside quotes ends one."""
    return list(csv.reader(_AFTER_RETURN.split(record) if "\r" in record else [record]))


class _Range:
    """One range while it is read: rows so far, and the lines of a row that is still open."""

    def __init__(self, key: tuple[str, int], inside: bool):
        self.file, self.start = key
        self.at = self.start + (self.start > 0)  # a row takes a byte or more, so places of ranges differ
        self.head = inside  # the open lines belong to a row of an earlier range
        self.opened: list[str] | None = [] if inside else None
        self.rows: list[tuple[int, list[str] | None, bool | None, str | None]] = []

    def add(self, line: str, from_out: bool, from_in: bool) -> None:
        if self.opened is not None:
            self.opened.append(line)
            if not from_in:
                self._close()
        elif from_out:
            self.opened = [line]
        else:
            self._parse(line, 1)

    def _parse(self, record: str, lines: int) -> None:
        found = _rows_of(record)
        self.rows += [(self.at + j, cells, None, None) for j, cells in enumerate(found) if cells]
        self.at += max(lines, len(found))

    def _close(self) -> None:
        record = "\n".join(self.opened)
        if self.head:
            self._share(record)
        else:
            self._parse(record, len(self.opened))
        self.head, self.opened = False, None

    def _share(self, record: str) -> None:
        self.rows.append((self.at, None, not self.head, record))
        self.at += len(self.opened)

    def end(self) -> None:
        """What is still open goes on in a later range, or to the end of the file."""
        if self.opened:
            self._share("\n".join(self.opened))

    def batch(self) -> pa.RecordBatch:
        ords, cells, tails, texts = zip(*self.rows) if self.rows else ([], [], [], [])
        n, self.rows = len(ords), []
        return pa.RecordBatch.from_arrays(
            [
                pa.array([self.file] * n, pa.string()),
                pa.array([self.start] * n, pa.int64()),
                pa.array(ords, pa.int64()),
                pa.array(cells, pa.list_(pa.string())),
                pa.array(tails, pa.bool_()),
                pa.array(texts, pa.string()),
            ],
            ["file", "start", "ord", "cells", "tail", "text"],
        )


def _range_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of each range. A row that an earlier range began (tail false), or that is open at the end
    (tail true), is left as text."""
    csv.field_size_limit(CELL_CHARS)
    key = current = None
    for batch in batches:
        for k, run in _runs(batch):
            if k != key:
                if current is not None:
                    current.end()
                    yield current.batch()
                key, current = k, _Range(k, run.column("inside")[0].as_py())
            for line in zip(*(run.column(c).to_pylist() for c in ("value", "from_out", "from_in"))):
                current.add(*line)
            yield current.batch()
    if current is not None:
        current.end()
        yield current.batch()


def _joined(shares: DataFrame) -> DataFrame:
    """Rows that several ranges share: a range's open end and what follows up to the closing quote."""
    w = Window.partitionBy("file").orderBy("start", "tail").rowsBetween(Window.unboundedPreceding, 0)
    texts = F.array_sort(F.collect_list(F.struct("start", "tail", "text")))
    rows = (
        shares.withColumn("row", F.sum(F.col("tail").cast("int")).over(w))
        .groupBy("file", "row")
        .agg(F.min("ord").alias("ord"), F.array_join(F.transform(texts, lambda t: t["text"]), "\n").alias("text"))
    )
    return rows.select("file", "ord", "text").mapInArrow(_shared_rows, "file string, ord bigint, cells array<string>")


def _shared_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    csv.field_size_limit(CELL_CHARS)
    for batch in batches:
        for row in batch.to_pylist():
            found = [(row["file"], row["ord"] + j, cells) for j, cells in enumerate(_rows_of(row["text"])) if cells]
            if found:
                files, ords, cells = zip(*found)
                columns = [pa.array(files), pa.array(ords, pa.int64()), pa.array(cells, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, ["file", "ord", "cells"])
