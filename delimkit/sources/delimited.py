"""The data source ``delimited``: ranges of files, ragged rows in Arrow batches.

A large file is cut into ranges that begin behind a line feed. Whether such a place lies
within a quoted cell only shows from the file's start, so a first pass takes both cases for
each range, at the same time: how many rows begin in it, and whether a quote is open at its
end. Put together in order this gives each range's case and its first row's number. The
ranges are then read by themselves; a row that passes its range's end is read to its own.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..model import SCAN_SCHEMA, Dialect
from . import sniff, tokenize

BATCH_ROWS = 8192
#: Bytes of a range at least; a file has at most MOST_RANGES of them.
RANGE_BYTES, MOST_RANGES = 16 << 20, 100_000
#: Bytes that one look for a line feed reads.
LOOK = 1 << 16


@dataclass(frozen=True)
class Range:
    """Bytes of a file in which rows begin. ``quoted``: they begin within a quoted cell. ``first``: physical number of the first row; ``rows``: how many begin, if known."""

    order: int
    path: str
    dialect: Dialect
    start: int
    end: int
    size: int
    quoted: bool = False
    first: int = 0
    rows: int | None = None


class FilePartition(InputPartition):
    def __init__(self, value: Range):
        super().__init__(value.order)
        self.range = value


def file_name(path: str) -> str:
    return os.path.basename(path.rstrip("/"))


def read_rows(path: str, dialect: Dialect):
    """Header and an iterator of data rows; None for an empty file's header."""
    stream = sniff.open_bytes(path)
    stream.read(dialect.data_start)
    rows = tokenize.rows_of_bytes(stream, dialect.delimiter, dialect.encoding)
    return next(rows, None), rows


def _line_feed(encoding: str) -> bytes:
    return {"utf-16-le": b"\n\0", "utf-16-be": b"\0\n"}.get(encoding, b"\n")


def behind_line_feed(stream, at: int, size: int, dialect: Dialect) -> int:
    """The first place from ``at`` on that lies behind a line feed, or the file's end."""
    feed = _line_feed(dialect.encoding)
    unit = len(feed)
    at = max(at - unit, dialect.data_start)
    at += -(at - dialect.data_start) % unit
    stream.seek(at)
    while data := stream.read(LOOK):
        i = data.find(feed)
        while i % unit and i >= 0:
            i = data.find(feed, i + 1)
        if i >= 0:
            return at + i + unit
        at += len(data)
    return size


def _text(stream, start: int, end: int, encoding: str) -> str:
    stream.seek(start)
    return "".join(tokenize.decoded(_Bounded(stream, end - start), encoding))


class _Bounded:
    """A stream's next ``left`` bytes."""

    def __init__(self, stream, left: int):
        self.stream, self.left = stream, left

    def read(self, n: int) -> bytes:
        data = self.stream.read(min(n, self.left))
        self.left -= len(data)
        return data


def measure(value: Range) -> tuple[int, int, list[tuple[int, bool]]]:
    """Where a range really begins and ends; in either case (not quoted, quoted) the rows that begin there and whether a quote is open at its end."""
    d = value.dialect
    with sniff.open_bytes(value.path) as f:
        start = value.start if value.start == d.data_start else behind_line_feed(f, value.start, value.size, d)
        end = value.size if value.end >= value.size else behind_line_feed(f, value.end, value.size, d)
        if start >= end:
            return start, end, [(0, False), (0, True)]
        text = _text(f, start, end, d.encoding)
    if value.start == d.data_start:
        return start, end, [tokenize.count_rows(text, d.delimiter), (0, True)]
    if '"' not in text:
        return start, end, [tokenize.count_rows(text, d.delimiter), (0, True)]
    # a quoted cell goes on: as if it began here; that row isn't one of the range
    n, is_open = tokenize.count_rows('"' + text, d.delimiter)
    return start, end, [tokenize.count_rows(text, d.delimiter), (n - 1, is_open)]


def plan(files: list[tuple[int, str, Dialect]], most: int | None = None) -> list[Range]:
    """Ranges of files by size alone, and files in one range if they are small. Raises OSError for a file that isn't there."""
    out = []
    for order, path, d in files:
        size, start = sniff.size_of(path), d.data_start
        step = max(most or RANGE_BYTES, -(-size // MOST_RANGES))
        step += step % 2
        for at in range(start, max(size, start + 1), step):
            out.append(Range(order, path, d, at, min(at + step, size) if at + step < size else size, size))
    return out


def joined(ranges: list[Range], measured: list[tuple[int, int, list[tuple[int, bool]]]], before: tuple[int, bool] = (0, False)) -> tuple[list[Range], tuple[int, bool]]:
    """Ranges of one file, in order, with their cases and row numbers; and the number and case behind them."""
    out, (first, quoted) = [], before
    for r, (start, end, cases) in zip(ranges, measured, strict=True):
        n, after = cases[quoted]
        if start < end:
            out.append(replace(r, start=start, end=end, quoted=quoted, first=first, rows=n))
            first, quoted = first + n, after
    return out, (first, quoted)


def _packed(r: Range) -> str:
    return json.dumps(asdict(r))


def _unpacked(s: str) -> Range:
    d = json.loads(s)
    return Range(**d | {"dialect": Dialect(**d["dialect"])})


def measured(spark: SparkSession, ranges: list[Range]) -> list[tuple[int, int, list[tuple[int, bool]]]]:
    """``measure`` for each range, by the executors; a few numbers come back for each."""
    from ..session import ship

    ship(spark)

    def run(frames):
        import pandas as pd

        for f in frames:
            yield pd.DataFrame([(n, json.dumps(measure(_unpacked(s)))) for n, s in zip(f["n"], f["s"], strict=True)], columns=["n", "s"])

    todo = spark.createDataFrame([(i, _packed(r)) for i, r in enumerate(ranges)], "n int, s string").repartition(min(len(ranges), 10_000))
    got = {r.n: json.loads(r.s) for r in todo.mapInPandas(run, "n int, s string").collect()}
    return [(a, b, [tuple(c) for c in cases]) for a, b, cases in (got[i] for i in range(len(ranges)))]


def index(spark: SparkSession, files: list[tuple[str, Dialect]], exact: bool = False, range_bytes: int | None = None) -> list[Range]:
    """Ranges of files in their order. Files of one range aren't read, unless row counts are asked for (``exact``)."""
    ranges = plan([(i, p, d) for i, (p, d) in enumerate(files)], range_bytes)
    several = {r.order for a, r in zip(ranges, ranges[1:], strict=False) if a.order == r.order}
    look = [r for r in ranges if exact or r.order in several]
    if not look:
        return ranges
    by_file: dict[int, tuple[list, list]] = {}
    for r, m in zip(look, measured(spark, look), strict=True):
        for held, x in zip(by_file.setdefault(r.order, ([], [])), (r, m), strict=True):
            held.append(x)
    out = [r for r in ranges if r.order not in by_file]
    for of, m in by_file.values():
        out += joined(of, m)[0]
    return sorted(out, key=lambda r: (r.order, r.start))


def row_count(ranges: list[Range]) -> int:
    """Data rows of measured ranges; the header isn't one."""
    return sum(max(0, sum(r.rows for r in ranges if r.order == o) - 1) for o in {r.order for r in ranges})


def read_range(r: Range) -> Iterator:
    """Arrow arrays of the rows that begin in a range, the header included."""
    d = r.dialect
    with sniff.open_bytes(r.path) as f:
        text, at, want = _text(f, r.start, r.end, d.encoding), r.end, LOOK
        if r.quoted:
            text = '"' + text
        while at < r.size:
            # the last row may pass the range's end
            starts, is_open = tokenize.row_starts(text, d.delimiter) if '"' in text else ([], False)
            if not is_open or (r.quoted and len(starts) == 1):
                break
            tail, whole = text[starts[-1] :], text[: starts[-1]]
            while is_open and at < r.size:
                end = behind_line_feed(f, at + want, r.size, d) if at + want < r.size else r.size
                tail += _text(f, at, end, d.encoding)
                at, want = end, want * 2
                more, is_open = tokenize.row_starts(tail, d.delimiter)
                if len(more) > 1:
                    tail = tail[: more[1]]
                    break
            got = tokenize.cell_lists(whole, d.delimiter)
            last = tokenize.cell_lists(tail, d.delimiter)[:1]
            yield from (x for x in (got[1:], last) if r.quoted) if r.quoted else (got, last)
            return
        got = tokenize.cell_lists(text, d.delimiter)
        yield got[1:] if r.quoted else got


def holding(ranges: list[Range], wanted: list[tuple[int, int]]) -> list[Range]:
    """The ranges that may hold data rows of the wanted numbers, given as first and last of each run of them."""
    # row numbers count from behind the header, which is physical row 0
    return [r for r in ranges if r.rows is None or any(a < r.first - 1 + r.rows and z >= r.first - 1 for a, z in wanted)]


class DelimitedReader(DataSourceReader):
    def __init__(self, ranges: list[Range]):
        self.ranges = ranges

    def partitions(self):
        return [FilePartition(r) for r in self.ranges]

    def read(self, partition):
        import pyarrow as pa

        if partition is None:
            return  # no range is left
        r = partition.range
        schema = pa.schema([("file_ord", pa.int32()), ("path", pa.string()), ("file_name", pa.string()), ("row_idx", pa.int64()), ("cells", pa.list_(pa.field("element", pa.string(), False)))])
        nth = r.first - 1
        for rows in read_range(r):
            if nth < 0 and len(rows):
                rows, nth = rows[1:], 0  # the header
            for i in range(0, len(rows), BATCH_ROWS):
                part = rows[i : i + BATCH_ROWS]
                n = len(part)
                yield pa.RecordBatch.from_arrays([pa.array([r.order] * n, pa.int32()), pa.array([r.path] * n), pa.array([file_name(r.path)] * n), pa.array(range(nth, nth + n), pa.int64()), part], schema=schema)
                nth += n


class DelimitedDataSource(DataSource):
    """Options: ``ranges``, a JSON list of them; or a path, with its profile's dialect, in one range."""

    @classmethod
    def name(cls):
        return "delimited"

    def schema(self):
        return SCAN_SCHEMA

    def reader(self, schema):
        if "ranges" in self.options:
            return DelimitedReader([_unpacked(x) for x in json.loads(self.options["ranges"])])
        path = self.options["path"]
        return DelimitedReader(plan([(0, path, sniff.profile_file(path)[1])], 1 << 62))


def read_ranges(spark: SparkSession, ranges: list[Range]) -> DataFrame:
    """Rows of ranges."""
    from ..session import ship

    ship(spark)
    spark.dataSource.register(DelimitedDataSource)
    return spark.read.format("delimited").option("ranges", json.dumps([_packed(r) for r in ranges])).load()


def scan(spark: SparkSession, files: list[tuple[str, Dialect]]) -> DataFrame:
    """Rows of files in their order (``file_ord``)."""
    return read_ranges(spark, index(spark, files))
