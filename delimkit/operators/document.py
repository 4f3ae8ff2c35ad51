"""Documents: an opened file with its profile, dialect, headers and view."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..model import BINARY_MESSAGE, FIRST_ROWS, PROFILE_SCHEMA, DelimitedError, Dialect, FileProfile
from ..sources import delimited, sniff
from .view import View


def described(path: str, delimiter: str | None = None, encoding: str | None = None) -> tuple[FileProfile, Dialect, tuple[str, ...]]:
    """A file's profile and dialect under overrides, and its header. Reads its start."""
    profile, dialect = sniff.override(path, *sniff.profile_file(path), delimiter, encoding)
    header = None if profile.binary_like else delimited.read_rows(path, dialect)[0]
    return profile, dialect, tuple(header or ())


def file_view(spark: SparkSession, ranges: list[delimited.Range], headers: tuple[str, ...]) -> View:
    """A view over a file's ranges; pages read only the ranges that hold them."""
    near = lambda runs: delimited.read_ranges(spark, delimited.holding(ranges, runs))
    return View(delimited.read_ranges(spark, ranges), headers, tuple(F.coalesce(F.get("cells", F.lit(i)), F.lit("")) for i in range(len(headers))), "cells", near=near)


@dataclass(frozen=True)
class Document:
    path: str
    profile: FileProfile
    dialect: Dialect
    headers: tuple[str, ...]
    view: View
    ranges: tuple[delimited.Range, ...] = ()

    @staticmethod
    def open(spark: SparkSession, path: str, delimiter: str | None = None, encoding: str | None = None) -> Document:
        """Profile a file, apply overrides, refuse binary content, read the header. The rows stay lazy."""
        profile, dialect, headers = described(path, delimiter, encoding)
        if profile.binary_like:
            raise DelimitedError(BINARY_MESSAGE)
        ranges = tuple(delimited.index(spark, [(path, dialect)]))
        return Document(path, profile, dialect, headers, file_view(spark, list(ranges), headers), ranges)

    def preview(self, rows: int = FIRST_ROWS) -> list[list[str]]:
        """The first rows at once, read on the driver without a job."""
        _, it = delimited.read_rows(self.path, self.dialect)
        return [r for r, _ in zip(it, range(rows), strict=False)]

    def row_count(self) -> int:
        """Data rows, counted by a scan that builds no cell; known already if the file has several ranges."""
        if all(r.rows is not None for r in self.ranges):
            return delimited.row_count(list(self.ranges))
        return delimited.row_count(delimited.index(self.view.base.sparkSession, [(self.path, self.dialect)], exact=True))


def profile_files(spark: SparkSession, paths: list[str], overrides: dict[str, tuple] | None = None):
    """(ord, path, profile, headers, dialect, error) of many files, profiled by the executors; a file that fails has an error."""
    from ..session import ship

    ship(spark)
    chosen = overrides or {}

    def run(frames):
        import json
        from dataclasses import asdict

        import pandas as pd

        for f in frames:
            out = []
            for i, p in zip(f["ord"], f["path"], strict=True):
                try:
                    profile, dialect, headers = described(p, *chosen.get(p, ()))
                    made = vars(profile).copy()
                    made["warnings"] = list(made["warnings"])
                    out.append((i, p, made, list(headers), json.dumps(asdict(dialect)), None))
                except (OSError, ValueError) as e:
                    out.append((i, p, None, None, None, str(e) or type(e).__name__))
            yield pd.DataFrame(out, columns=["ord", "path", "profile", "headers", "dialect", "error"])

    todo = spark.createDataFrame(list(enumerate(paths)), "ord int, path string").repartition(min(len(paths) or 1, 200))
    return todo.mapInPandas(run, f"ord int, path string, profile struct<{PROFILE_SCHEMA.replace(' ', ':').replace(',:', ',')}>, headers array<string>, dialect string, error string")


def profile_summary(profiles):
    """Files by kind, with warnings and errors in all."""
    kind = F.coalesce("profile.detected_kind_label", F.lit("Error"))
    return profiles.groupBy(kind.alias("kind")).agg(F.count("*").alias("files"), F.sum(F.coalesce(F.size("profile.warnings"), F.lit(0))).alias("warnings"), F.count("error").alias("errors"))
