"""Progressive reading: a stream over a growing or large delimited file, chunk by chunk."""

from __future__ import annotations

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from ..model import FIRST_ROWS, NEXT_ROWS, SCAN_SCHEMA
from ..sources import delimited, sniff, tokenize

#: Bytes that a batch reads at first; more if its rows need them.
READ_BYTES = 1 << 20


class ProgressiveReader(SimpleDataSourceStreamReader):
    """Offsets are bytes, and rows read by then: each batch reads on from the one before, after a restart too.

    The first batch is small, the next ones larger. A last row without a line feed may still
    grow: it is held back until the file is said to be complete.
    """

    def __init__(self, path: str, complete: bool = False):
        self.path, self.complete, self.dialect = path, complete, sniff.profile_file(path)[1]

    def initialOffset(self):
        return {"byte": self.dialect.data_start, "row": -1}

    def _from(self, start: dict, most: int | None, end: int | None = None) -> tuple[list[list[str]], int]:
        """Rows (at most ``most``, or those before byte ``end``) from an offset on, and the byte behind them."""
        d = self.dialect
        wide = d.encoding.startswith("utf-16")
        codec, errors = (d.encoding, "surrogatepass") if wide else ("utf-8", "surrogateescape")
        size, want, at = sniff.size_of(self.path), READ_BYTES, start["byte"]
        stop = size if end is None else end
        with sniff.open_bytes(self.path) as f:
            while True:
                cut = min(at + want, stop)
                if end is None and not (cut == size and self.complete):
                    cut = self._last_feed(f, at, cut)
                f.seek(at)
                raw = f.read(cut - at)
                text = raw.decode(codec, "replace" if wide else errors)
                starts, is_open = tokenize.row_starts(text, d.delimiter)
                if is_open and not (cut == size and self.complete) and end is None:
                    starts, text = starts[:-1], text[: starts[-1]]
                if starts or at + want >= stop:
                    break
                want *= 2
        if most is not None and len(starts) > most:
            text, starts = text[: starts[most]], starts[:most]
        used = len(text.encode(codec, errors))
        clean = text if wide else text.encode(codec, errors).decode(codec, "replace")
        return tokenize.cell_lists(clean, d.delimiter).to_pylist(), at + used

    def _last_feed(self, f, at: int, cut: int) -> int:
        """The last place before ``cut`` that lies behind a line feed; ``at`` if there is none."""
        feed = delimited._line_feed(self.dialect.encoding)
        f.seek(at)
        raw = f.read(cut - at)
        i = raw.rfind(feed)
        while i % len(feed) and i >= 0:
            i = raw.rfind(feed, 0, i + len(feed) - 1)
        return at + i + len(feed) if i >= 0 else at

    def _rows(self, start: dict, rows: list[list[str]]):
        name = delimited.file_name(self.path)
        return iter([(0, self.path, name, n, r) for n, r in enumerate(rows, start["row"]) if n >= 0])  # row -1 is the header

    def read(self, start):
        first = start["row"] < 0
        rows, byte = self._from(start, FIRST_ROWS + 1 if first else NEXT_ROWS)
        return self._rows(start, rows), {"byte": byte, "row": start["row"] + len(rows)}

    def readBetweenOffsets(self, start, end):
        return self._rows(start, self._from(start, None, end["byte"])[0])


class ProgressiveDataSource(DataSource):
    """Options: a path, and ``complete`` (true: the file won't grow, so its last row needs no line feed)."""

    @classmethod
    def name(cls):
        return "delimited_progressive"

    def schema(self):
        return SCAN_SCHEMA

    def simpleStreamReader(self, schema):
        return ProgressiveReader(self.options["path"], self.options.get("complete", "false").lower() == "true")


def stream(spark, path: str, complete: bool = False):
    from ..session import ship

    ship(spark)
    spark.dataSource.register(ProgressiveDataSource)
    return spark.readStream.format("delimited_progressive").option("path", path).option("complete", str(complete).lower()).load()
