"""Export of a view to delimited text."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..functions import expr
from ..model import PREVIEW_BYTES, DelimitedError, SortKey
from .view import View


#: Rows written between two reports of an export.
TOLD = 2048


def encode_row(cells: list[str], delimiter: str = ",") -> str:
    quoted = ['"' + c.replace('"', '""') + '"' if any(x in c for x in (delimiter, '"', "\r", "\n")) else c for c in cells]
    return delimiter.join(quoted) + "\n"


def _columns(view: View, columns: list[int] | None) -> list[int]:
    columns = list(range(len(view.headers))) if columns is None else list(columns)
    if not columns:
        raise DelimitedError("Pick at least one column to export.")
    view._check(columns)
    return columns


def export_file(view: View, target: str, columns: list[int] | None = None, delimiter: str = ",", preview: bool = False, cancelled=lambda: False, progress=lambda rows: None) -> int:
    """Write a header and the view's rows to one file, replaced as a whole at the end. Rows written; -1 if cancelled.

    Rows stream through the driver one partition at a time. ``preview`` cuts long cells as a
    page does; ``progress`` hears of the rows written, every TOLD of them and at the end.
    """
    if not target.strip():
        raise DelimitedError("Pick a file to export to.")
    columns = _columns(view, columns)
    folder, name = os.path.split(target)
    temp = os.path.join(folder, f".{name}.{uuid.uuid4().hex}-tmp")
    shown = (lambda c: expr.truncate_utf8(c, PREVIEW_BYTES)) if preview else (lambda c: c)
    lines = view.filtered().orderBy(*view.order()).select(expr.export_line([shown(view.cells[c]) for c in columns], delimiter).alias("line"))
    n = 0
    try:
        with open(temp, "w", encoding="utf-8", newline="", buffering=1 << 18) as f:
            f.write(encode_row([view.headers[c] for c in columns], delimiter))
            for row in lines.toLocalIterator(prefetchPartitions=True):
                if cancelled():
                    return -1
                f.write(row["line"] + "\n")
                n += 1
                if not n % TOLD:
                    progress(n)
        os.replace(temp, target)
        progress(n)
    finally:
        if os.path.exists(temp):
            os.remove(temp)
    return n


def export_folder(view: View, target: str, columns: list[int] | None = None, delimiter: str = ",", one_file: bool = False) -> None:
    """Write a header and the view's lines as text files, written by all executors in the view's order; for results too large for one file.

    The files, in the order of their names, are what ``export_file`` writes: the header is
    the first line of the first. ``one_file`` has one task write them all.
    """
    columns = _columns(view, columns)
    rows, keys = view.keyed()
    names = [n for n, _ in keys]
    lines = rows.select(F.lit(1).alias("body"), *names, "row_idx", expr.export_line([view.cells[c] for c in columns], delimiter).alias("line"))
    head = view.base.sparkSession.createDataFrame([(encode_row([view.headers[c] for c in columns], delimiter)[:-1],)], "line string")
    head = head.select(F.lit(0).alias("body"), *[F.lit(None).cast(lines.schema[n].dataType).alias(n) for n in names], F.lit(0).cast("long").alias("row_idx"), "line")
    order = ["body", *(c for n, descending in keys for c in expr.ordering([F.col(n)], descending)), "row_idx"]
    out = lines.unionByName(head)
    out = out.coalesce(1).sortWithinPartitions(*order) if one_file else out.orderBy(*order)
    out.select("line").write.text(target)


def suggested_name(source: str, filtered: bool = False, keys: tuple[SortKey, ...] = ()) -> str:
    stem = os.path.splitext(os.path.basename(source))[0]
    tags = "-filtered" if filtered else ""
    if len(keys) == 1:
        tags += "-sorted-desc" if keys[0].descending else "-sorted-asc"
    elif keys:
        tags += "-sorted"
    return f"{stem}{tags or '-export'}.csv"


def next_sort_keys(keys: tuple[SortKey, ...], column: int, extend: bool = False) -> tuple[SortKey, ...]:
    """A click on a header: ascending, descending, none; with ``extend`` within the other keys."""
    mine = next((k for k in keys if k.column == column), None)
    following = SortKey(column) if mine is None else SortKey(column, True) if not mine.descending else None
    if not extend:
        alone = mine is not None and len(keys) == 1
        new = following if alone or mine is None else SortKey(column)
        return (new,) if new else ()
    if mine is None:
        return (*keys, following)
    return tuple(x for k in keys for x in ([following] if k is mine and following else [] if k is mine else [k]))


def copy_row(view: View, row_idx: int) -> str:
    """The visible cells of a row joined by tabs."""
    row = view._runs([(row_idx, row_idx)]).select(expr.tsv_line([view.cells[c] for c in view.visible]).alias("line")).first()
    if row is None:
        raise DelimitedError(f"Row {row_idx} is out of range.")
    return row["line"]
