"""Cell search over several files or views, with a cap on the matches that are returned."""

from __future__ import annotations

import json
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr
from ..model import BINARY_MESSAGE, SEARCH_DEFAULT, SEARCH_MAX, SEARCH_PREVIEW_BYTES, Dialect, SearchProgress, SearchSummary
from ..sources import delimited, sniff
from .document import profile_files
from .view import View, union_cells

#: Files of the first wave of a search; each later wave has FASTER times as many.
FIRST_WAVE, FASTER, LARGEST_WAVE = 64, 4, 20_000


def _shown(found: DataFrame) -> DataFrame:
    cut = lambda c: expr.truncate_utf8(c, SEARCH_PREVIEW_BYTES)
    return found.select("file_ord", "path", (F.col("row_idx") + 1).alias("row_index"), "column_index", "column_name", cut(F.col("value")).alias("value"), F.transform("row_values", cut).alias("row_values"))


def matches(views: list[tuple[str, View]], query: str) -> DataFrame:
    """All matching cells; row_index counts from 1, values are cut for display."""
    return _shown(union_cells(views, lambda c: expr.contains_search(c, query)))


def matches_in_files(rows: DataFrame, headers: DataFrame, query: str) -> DataFrame:
    """All matching cells of one scan over many files. ``headers``: (file_ord, headers)."""
    pick = lambda c: expr.contains_search(c, query)
    hits = rows.where(F.exists("cells", pick)).join(headers, "file_ord", "left")
    cells = hits.select("file_ord", "path", "row_idx", "headers", F.col("cells").alias("row_values"), F.posexplode("cells").alias("column_index", "value")).where(pick(F.col("value")))
    return _shown(cells.withColumn("column_name", F.coalesce(F.get("headers", F.col("column_index")), F.lit(""))))


def capped(found: DataFrame, limit: int = SEARCH_DEFAULT) -> DataFrame:
    """The first matches in the order of files, rows and cells: a top-k, never a full sort."""
    return found.orderBy("file_ord", "row_index", "column_index").limit(max(1, min(SEARCH_MAX, limit)))


def counts_per_file(found: DataFrame) -> DataFrame:
    return found.groupBy("path").agg(F.count("*").alias("n_matches"))


def schemas(described: DataFrame) -> DataFrame:
    """(file_ord, path, headers) of described files that have headers, each path once, at its first place."""
    some = described.where(F.size(F.coalesce("headers", F.array())) > 0)
    return some.groupBy("path").agg(F.min(F.struct(F.col("ord"), "headers")).alias("x")).select(F.col("x.ord").alias("file_ord"), "path", F.col("x.headers").alias("headers"))


def _finish(out: SearchSummary, names: list[tuple[str, tuple[str, ...]]], stop: int) -> SearchSummary:
    """File names, counts and schemas. ``names``: path and headers of the files, up to the last one searched."""
    out.searched_files = stop
    out.matched_files = len({m["file_ord"] for m in out.matches})
    seen = set()
    for path, headers in names[:stop]:
        if path not in seen and headers:
            seen.add(path)
            out.schemas.append({"path": path, "file_name": os.path.basename(path), "headers": list(headers)})
    for m in out.matches:
        m["file_name"] = os.path.basename(m["path"])
    return out


def search_views(views: list[tuple[str, View]], query: str, limit: int = SEARCH_DEFAULT) -> SearchSummary:
    """Search views in order. Files behind the one where the cap was reached count as not searched."""
    q = query.strip(expr.PY_SPACE)
    out = SearchSummary(q)
    if not q or not views:
        return out
    limit = max(1, min(SEARCH_MAX, limit))
    out.matches = [r.asDict() for r in capped(matches(views, q), limit).collect()]
    out.truncated = len(out.matches) == limit
    return _finish(out, [(p, v.headers) for p, v in views], out.matches[-1]["file_ord"] + 1 if out.truncated else len(views))


def search_files(
    spark: SparkSession,
    paths: list[str],
    query: str,
    limit: int = SEARCH_DEFAULT,
    overrides: dict[str, tuple] | None = None,
    progress: Callable[[SearchProgress], None] = lambda p: None,
    cancelled: Callable[[], bool] = lambda: False,
) -> SearchSummary:
    """Search files in order; files that can't be read are listed with their errors and don't stop the search.

    A path may be a folder or a pattern. Files are searched in waves, each one scan: once
    the cap is reached no later wave is read. ``progress`` hears of each wave. ``cancelled``
    is asked before each wave, and a wave whose Spark jobs are interrupted counts as
    cancelled: the matches of the waves before stay, and the summary says so.
    """
    q = query.strip(expr.PY_SPACE)
    out = SearchSummary(q)
    paths = [f for p in paths for f in sniff.listed(p)]
    if not q or not paths:
        return out
    limit = max(1, min(SEARCH_MAX, limit))
    names: list[tuple[str, tuple[str, ...]]] = []
    errors: list[tuple[int, dict]] = []
    at, wave = 0, FIRST_WAVE
    tell = lambda running: progress(SearchProgress(len(paths), at, len(out.matches), running, out.cancelled))
    while at < len(paths) and len(out.matches) < limit:
        if cancelled():
            out.cancelled = True
            break
        try:
            found, heads, bad = _wave(spark, paths[at : at + wave], q, limit - len(out.matches), overrides, at)
        except Exception:
            if not cancelled():
                raise
            out.cancelled = True  # the jobs were interrupted
            break
        out.matches += found
        names += heads
        errors += bad
        at, wave = min(at + wave, len(paths)), min(wave * FASTER, LARGEST_WAVE)
        tell(True)
    out.truncated = len(out.matches) == limit
    stop = out.matches[-1]["file_ord"] + 1 if out.truncated else at
    out.errors = [e for i, e in errors if i < stop]
    tell(False)
    return _finish(out, names, stop)


def _wave(spark: SparkSession, paths: list[str], q: str, limit: int, overrides: dict[str, tuple] | None, first: int) -> tuple[list[dict], list, list]:
    """Matches, headers and errors of some files, in one scan."""
    described = sorted(profile_files(spark, paths, overrides).collect(), key=lambda r: r["ord"])
    errors, files, order = [], [], []
    for r in described:
        message = r["error"] or (BINARY_MESSAGE if r["profile"]["binary_like"] else None)
        if message:
            errors.append((first + r["ord"], {"path": r["path"], "message": message}))
        else:
            files.append((r["path"], Dialect(**json.loads(r["dialect"]))))
            order.append(first + r["ord"])
    names = [(r["path"], tuple(r["headers"] or ())) for r in described]
    if not files:
        return [], names, errors
    heads = spark.createDataFrame([(i, list(names[o - first][1])) for i, o in enumerate(order)], "file_ord int, headers array<string>")
    found = [r.asDict() for r in capped(matches_in_files(delimited.scan(spark, files), heads, q), limit).collect()]
    for m in found:
        m["file_ord"] = order[m["file_ord"]]
    return found, names, errors


def scopes(summary: SearchSummary) -> list[dict]:
    """Groups in which results are shown: all matched files together if their headers are the same, then each file."""
    headers = {s["path"]: s["headers"] for s in summary.schemas}
    by_path: dict[str, list[dict]] = {}
    for m in summary.matches:
        by_path.setdefault(m["path"], []).append(m)
    out = []
    for p, ms in by_path.items():
        width = max(len(m["row_values"]) for m in ms)
        out.append({"label": os.path.basename(p), "headers": headers.get(p) or [f"Column {i + 1}" for i in range(width)], "matches": ms})
    if out and all(s["headers"] == out[0]["headers"] for s in out):
        first = ["File"] if len(out) > 1 else []
        out.insert(0, {"label": "All matched files", "headers": first + out[0]["headers"], "matches": summary.matches})
    for s in out:
        s["label"] += f" ({len(s['matches'])})"
    return out


def distinct_paths(paths: list[str], cap: int = 50) -> list[str]:
    """Trimmed, non-empty paths, each once in order of first sight."""
    return list(dict.fromkeys(q for p in paths if (q := p.strip())))[:cap]
