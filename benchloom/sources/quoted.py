"""Records of delimited files whose quoted cells hold line ends, found in parallel over the splits of a file.

A line maps what it begins in (outside of quotes or within a quoted cell) to what it ends in. Each split composes the maps of
its lines without knowing how it begins; a scan over splits, one row each, then says how each begins and which record is
open there, and a second pass cuts records in all splits at once. Only the lines of records that cross an edge of splits are
shuffled. A folder's files are one text in the order of their names, and a record may go on in the next one; a task that
holds several splits treats lines that follow one another as one split.

A quote opens a cell only as its first character, and closes it where no second quote follows; quotes elsewhere are text. A
quote that nothing closes up to the end of the file is text, too: from its line on every line is a record of its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from benchloom.sources.lines import numbered_lines

OUT, IN = 0, 1


def patterns(delimiter: str) -> tuple[re.Pattern, re.Pattern]:
    """Whether a line that begins outside of quotes ends within a cell; where a line that begins within one leaves it."""
    d = re.escape(delimiter)
    cell = rf'(?:[^"{d}][^{d}]*+)?+{d}|"(?:[^"]|"")*+"[^{d}]*+{d}'
    return re.compile(rf'(?:{cell})*+"(?:[^"]|"")*+$'), re.compile(r'(?:[^"]|"")*+"')


def line_map(line: str, opens: re.Pattern, leaves: re.Pattern, delimiter: str) -> tuple[int, int]:
    """What a line ends in, if it begins outside, and if it begins within a cell."""
    out = IN if opens.match(line) else OUT
    m = leaves.match(line)
    if not m:
        return out, IN
    rest = line.find(delimiter, m.end())
    return out, IN if rest >= 0 and opens.match(line[rest + 1 :]) else OUT


def _states(values: pa.Array, begin: tuple[int, int], delimiter: str, regexes) -> np.ndarray:
    """For both ways in which the split begins (columns): what each line begins in, and (last row) what the last ends in."""
    out = np.empty((len(values) + 1, 2), np.int8)
    out[:] = begin
    quoted = np.flatnonzero(pc.match_substring(values, '"').to_numpy(zero_copy_only=False))
    now = list(begin)
    for at, line in zip(quoted.tolist(), values.take(pa.array(quoted)).to_pylist()):
        ends = line_map(line, *regexes, delimiter)
        now = [ends[now[0]], ends[now[1]]]
        out[at + 1 :] = now
    return out


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bool, pa.RecordBatch]]:
    """A task's batches, cut where a line does not follow the one before: the first line's number, whether a split begins there."""
    follows = None
    for batch in batches:
        if not batch.num_rows:
            continue
        numbers = batch.column("row_index").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(numbers) != 1) + 1).tolist(), len(numbers)]
        for low, high in zip(cuts, cuts[1:]):
            at = int(numbers[low])
            yield at, at != follows, batch.slice(low, high - low)
            follows = at + high - low


def _summaries(lines: DataFrame, delimiter: str) -> list:
    """By split: its first line, lines, what it ends in for both beginnings, and its last record start for both (-1: none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        regexes, now, n, last, split = patterns(delimiter), (OUT, IN), 0, [-1, -1], None

        def row() -> pa.RecordBatch:
            return pa.record_batch({"split": pa.array([split], pa.int64()), "n": pa.array([n], pa.int64()), "from_out": pa.array([now[0]], pa.int32()), "from_in": pa.array([now[1]], pa.int32()), "last_out": pa.array([last[0]], pa.int64()), "last_in": pa.array([last[1]], pa.int64())})

        for at, fresh, batch in _splits(batches):
            if fresh:
                if split is not None:
                    yield row()
                now, n, last, split = (OUT, IN), 0, [-1, -1], at
            states = _states(batch.column("value"), now, delimiter, regexes)
            for k in (0, 1):
                if (starts := np.flatnonzero(states[:-1, k] == OUT)).size:
                    last[k] = n + int(starts[-1])
            now, n = tuple(int(x) for x in states[-1]), n + batch.num_rows
        if split is not None:
            yield row()

    return lines.mapInArrow(run, "split long, n long, from_out int, from_in int, last_out long, last_in long").collect()  # a row a split


def records(spark: SparkSession, path: str, encoding: str, delimiter: str) -> DataFrame:
    """value, row_index: the records of a file, by the number (from 0) of the line on which they begin."""
    lines = numbered_lines(spark, path, encoding)
    carry, end, state, start = {}, 0, OUT, 0
    for r in sorted(_summaries(lines, delimiter)):
        carry[r.split] = (state, start)
        last = r.last_in if state else r.last_out
        start = r.split + last if last >= 0 else start
        end, state = r.split + r.n, r.from_in if state else r.from_out
    # The line whose quote nothing closes; from it on lines stand alone.
    alone = start if state == IN else end
    known = spark.sparkContext.broadcast(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        regexes, end, state, start = patterns(delimiter), 0, OUT, 0
        held: list[str] = []  # the lines so far of the record that is open
        crosses = False  # whether that record began in another split

        def row(values: list[str], starts: list[int], line: list[int], part: list[bool]) -> pa.RecordBatch:
            return pa.record_batch({"value": pa.array(values, pa.string()), "row_index": pa.array(starts, pa.int64()), "line": pa.array(line, pa.int64()), "part": pa.array(part, pa.bool_())})

        def left() -> pa.RecordBatch:
            """Open at the end of the split: the rest comes from the next ones."""
            return row(["\n".join(held)], [start], [end - len(held)], [crosses or state == IN and start < alone])

        for at, fresh, batch in _splits(batches):
            if fresh:
                if held:
                    yield left()
                held, (state, start) = [], known.value[at]
                crosses = state == IN and start < alone
            states = _states(batch.column("value"), (state, state), delimiter, regexes)[:, 0]
            number = at + np.arange(batch.num_rows)
            begins = (states[:-1] == OUT) | (number >= alone)
            values, starts, line, part = [], [], [], []
            texts = batch.column("value").to_pylist()
            for i, first in enumerate(begins.tolist()):
                if first:
                    if held:
                        values.append("\n".join(held)), starts.append(start), line.append(int(number[i]) - len(held)), part.append(crosses)
                    held, start, crosses = [texts[i]], int(number[i]), False
                else:
                    held.append(texts[i])
            end, state = at + batch.num_rows, int(states[-1])
            if values:
                yield row(values, starts, line, part)
        if held:
            yield left()

    found = lines.mapInArrow(run, "value string, row_index long, line long, part boolean")
    pieces = found.filter("part").groupBy("row_index").agg(F.sort_array(F.collect_list(F.struct("line", "value"))).alias("p"))
    joined = pieces.select(F.array_join(F.transform("p", lambda x: x["value"]), "\n").alias("value"), "row_index")
    return found.filter(~F.col("part")).select("value", "row_index").unionByName(joined)


def has_quotes(spark: SparkSession, path: str, encoding: str) -> bool:
    """Whether the file holds a quote at all; the search ends with the first."""
    return not spark.read.option("encoding", encoding).text(path).filter(F.col("value").contains('"')).isEmpty()
