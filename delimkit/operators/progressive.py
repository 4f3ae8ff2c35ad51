"""Opening a large file step by step: its indexed prefix is readable at once."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..model import BINARY_MESSAGE, DelimitedError, IndexStatus
from ..sources import delimited
from .document import described, file_view
from .view import View

NOT_READY = "Indexing is still running. Sorting, filtering and exporting need the whole file."


class ProgressiveDocument:
    """A document whose ranges are measured a few at a time, by the executors.

    ``page`` works on what is indexed. ``view``, the way to sort, filter and export, waits
    for the whole file. If a range can't be read the error is kept, indexing ends, and the
    prefix stays readable.
    """

    def __init__(self, spark: SparkSession, path: str, delimiter: str | None = None, encoding: str | None = None, range_bytes: int | None = None, step: int = 64):
        self.spark, self.path, self.step = spark, path, step
        self.profile, self.dialect, self.headers = described(path, delimiter, encoding)
        if self.profile.binary_like:
            raise DelimitedError(BINARY_MESSAGE)
        self._todo = delimited.plan([(0, path, self.dialect)], range_bytes)
        self.file_size = self._todo[0].size
        self._ranges: list[delimited.Range] = []
        self._behind, self._bytes = (0, False), 0
        self.error: str | None = None
        self.advance(1)

    def status(self) -> IndexStatus:
        rows = delimited.row_count(self._ranges)
        return IndexStatus(self.path, rows, not self._todo, self._bytes, self.file_size, self.error)

    def advance(self, ranges: int | None = None) -> bool:
        """Index the next ranges; whether the file is done."""
        some, rest = self._todo[: ranges or self.step], self._todo[ranges or self.step :]
        if not some:
            return True
        try:
            known, self._behind = delimited.joined(some, delimited.measured(self.spark, some), self._behind)
        except Exception as e:
            self.error, self._todo = str(e), []
            return True
        self._ranges += known
        self._bytes = known[-1].end if known else some[-1].end
        self._todo = rest
        return not rest

    def run(self) -> IndexStatus:
        while not self.advance():
            pass
        return self.status()

    def _prefix(self) -> View:
        return file_view(self.spark, list(self._ranges), self.headers)

    def page(self, start: int = 0, count: int = 256):
        """A page of the indexed prefix, in the file's order."""
        return self._prefix().page(start, min(count, max(0, self.status().row_count - start)))

    @property
    def view(self) -> View:
        if self._todo:
            raise DelimitedError(NOT_READY)
        return self._prefix()
