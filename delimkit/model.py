"""Values of the engine: dialects, profiles, sort keys, summaries, errors."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# Bounds of paging, previews, sampling and search.
PAGE_ROWS = 256
PREVIEW_BYTES = 12_288
SEARCH_PREVIEW_BYTES = 512
SEARCH_DEFAULT, SEARCH_MAX = 500, 5_000
SAMPLE_BYTES, SAMPLE_ROWS = 256 * 1024, 256
SORT_SAMPLE_ROWS, NUMERIC_RATIO = 2_000, 0.8
FIRST_ROWS, NEXT_ROWS = 2_048, 4_096
RECENT_FILES = 50
CACHED_PAGES = 48

BINARY_MESSAGE = "Unsupported file: File appears to be binary or uses an unsupported encoding"

#: A delimited scan: rows keep their own width; ``row_idx`` counts data rows of a file from 0.
SCAN_SCHEMA = T.StructType([T.StructField("file_ord", T.IntegerType()), T.StructField("path", T.StringType()), T.StructField("file_name", T.StringType()), T.StructField("row_idx", T.LongType()), T.StructField("cells", T.ArrayType(T.StringType(), False))])


class DelimitedError(ValueError):
    """A file or request that the engine refuses."""


@dataclass(frozen=True)
class Dialect:
    delimiter: str = ","
    encoding: str = "utf-8"
    data_start: int = 0


@dataclass(frozen=True)
class FileProfile:
    extension: str | None
    detected_kind: str
    detected_kind_label: str
    delimiter: int | None
    delimiter_label: str | None
    delimiter_confidence: str
    encoding: str
    sampled_rows: int
    likely_columns: int
    binary_like: bool
    warnings: tuple[str, ...]


PROFILE_SCHEMA = "extension string, detected_kind string, detected_kind_label string, delimiter int, delimiter_label string, delimiter_confidence string, encoding string, sampled_rows bigint, likely_columns bigint, binary_like boolean, warnings array<string>"


@dataclass(frozen=True)
class SortKey:
    column: int
    descending: bool = False


@dataclass(frozen=True)
class IndexStatus:
    """How far a file is indexed. An error ends the indexing; what was indexed before stays readable."""

    path: str
    row_count: int
    is_complete: bool
    indexed_bytes: int
    file_size: int
    error: str | None = None


@dataclass(frozen=True)
class SearchProgress:
    total_files: int
    searched_files: int
    matches: int
    is_running: bool
    cancelled: bool = False


@dataclass
class SearchSummary:
    """What a search over several files found. ``matches``, ``schemas`` and ``errors`` are lists of dicts."""

    query: str
    searched_files: int = 0
    matched_files: int = 0
    matches: list[dict] = field(default_factory=list)
    schemas: list[dict] = field(default_factory=list)
    errors: list[dict] = field(default_factory=list)
    truncated: bool = False
    cancelled: bool = False
