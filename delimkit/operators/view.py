"""Views: a lazy row filter, sort and column choice over numbered rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr
from ..model import NUMERIC_RATIO, PAGE_ROWS, PREVIEW_BYTES, SORT_SAMPLE_ROWS, DelimitedError, SortKey
from ..session import written


@dataclass(frozen=True)
class View:
    """``base`` has ``row_idx`` and whatever ``cells`` refer to; ``array`` names the cells' array if rows are ragged.

    ``row_idx`` is unique and has the rows' order; ``dense`` says that it counts them from 0
    without gaps. ``alphabets``: for each cell the characters that it may hold, if they are
    known and none is a letter. ``near``, if given, makes ``base`` anew from only those parts
    of its source that hold the asked-for runs of row numbers. Nothing is materialised: each method returns a new view or a
    lazy DataFrame; ``ranked`` alone writes a table of row numbers.
    """

    base: DataFrame
    headers: tuple[str, ...]
    cells: tuple[Column, ...]
    array: str | None = None
    dense: bool = True
    alphabets: tuple[str | None, ...] = ()
    near: Callable[[list[tuple[int, int]]], DataFrame] | None = None
    query: str = ""
    keys: tuple[SortKey, ...] = ()
    hidden: frozenset[int] = frozenset()

    # -- state

    def filter(self, query: str) -> View:
        """Rows of which any cell contains the trimmed query, whatever the case; an empty query clears the filter."""
        return replace(self, query=query.strip(expr.PY_SPACE))

    def clear_filter(self) -> View:
        return replace(self, query="")

    def sort(self, *keys: SortKey) -> View:
        if not keys:
            raise DelimitedError("Pick at least one column to sort by.")
        self._check(k.column for k in keys)
        return replace(self, keys=tuple(keys))

    def clear_sort(self) -> View:
        return replace(self, keys=())

    def hide(self, column: int) -> View:
        """Hide a column; the last visible one stays."""
        self._check([column])
        hidden = self.hidden | {column}
        return self if len(hidden) >= len(self.headers) else replace(self, hidden=hidden)

    def show(self, column: int) -> View:
        return replace(self, hidden=self.hidden - {column})

    def show_all(self) -> View:
        return replace(self, hidden=frozenset())

    def hide_all(self) -> View:
        """Hide all columns but the first."""
        return replace(self, hidden=frozenset(range(1, len(self.headers))))

    @property
    def visible(self) -> list[int]:
        return [i for i in range(len(self.headers)) if i not in self.hidden]

    def label(self, column: int) -> str:
        return self.headers[column] or f"Column {column + 1}"

    def _check(self, columns) -> None:
        for c in columns:
            if not 0 <= c < len(self.headers):
                raise DelimitedError(f"Column {c} is out of range: there are {len(self.headers)} columns.")

    # -- plans

    def _runs(self, runs: list[tuple[int, int]]) -> DataFrame:
        """Rows of some runs of row numbers (first, last), read from where they are."""
        inside = [F.col("row_idx") == a if a == z else F.col("row_idx").between(a, z) for a, z in runs]
        return (self.near(runs) if self.near else self.base).where(reduce(lambda x, y: x | y, inside, F.lit(False)))

    @cached_property
    def predicate(self) -> Column:
        if not self.query:
            return F.lit(True)
        if self.array:
            return expr.any_array_cell(F.col(self.array), self.query)
        needle = set(expr.fold_filter_needle(self.query))
        known = self.alphabets or (None,) * len(self.cells)
        return expr.any_cell([c for c, a in zip(self.cells, known, strict=True) if a is None or needle <= set(a)], self.query)

    def filtered(self) -> DataFrame:
        return self.base.where(self.predicate) if self.query else self.base

    def modes(self, columns: list[int]) -> dict[int, bool]:
        """Whether each column sorts as numbers: at least 0.8 of the non-empty cells of the first 2000 rows are. One job for all."""
        sample = self._runs([(0, SORT_SAMPLE_ROWS - 1)])
        aggs = []
        for c in columns:
            t = expr.utrim(self.cells[c])
            aggs += [F.count_if(t != "").alias(f"n{c}"), F.count_if(expr.is_number(t)).alias(f"k{c}")]
        got = sample.agg(*aggs).first()
        return {c: got[f"n{c}"] > 0 and got[f"k{c}"] / got[f"n{c}"] >= NUMERIC_RATIO for c in columns}

    def order(self) -> list[Column]:
        """Sort columns; ties and unsorted views keep the physical order."""
        modes = self.modes(sorted({k.column for k in self.keys})) if self.keys else {}
        keys = [c for k in self.keys for c in expr.ordering(expr.sort_columns(self.cells[k.column], modes[k.column]), k.descending)]
        return [*keys, F.col("row_idx").asc()]

    def keyed(self) -> tuple[DataFrame, list[tuple[str, bool]]]:
        """The filtered rows with their sort keys as columns, and those columns' names and directions (True: descending)."""
        modes = self.modes(sorted({k.column for k in self.keys})) if self.keys else {}
        made, names = [], []
        for k in self.keys:
            for c in expr.sort_columns(self.cells[k.column], modes[k.column]):
                names.append((f"k{len(names)}", k.descending))
                made.append(c.alias(names[-1][0]))
        return self.filtered().select("*", *made), names

    def rows(self) -> DataFrame:
        """All rows of the view in order: row_idx, and the visible cells as c0, c1, ..."""
        return self.filtered().orderBy(*self.order()).select("row_idx", *[self.cells[c].alias(f"c{i}") for i, c in enumerate(self.visible)])

    def select(self, columns: list[int]) -> DataFrame:
        """All rows in order with columns by number; repeats and any order are kept."""
        if not columns:
            raise DelimitedError("Pick at least one column to export.")
        self._check(columns)
        return self.filtered().orderBy(*self.order()).select("row_idx", *[self.cells[c].alias(f"c{i}") for i, c in enumerate(columns)])

    def count(self) -> int:
        return self.filtered().count()

    def counts(self) -> DataFrame:
        """rows_scanned, matched_rows, total_rows in one pass."""
        return self.base.agg(F.count("*").alias("rows_scanned"), F.count_if(self.predicate).alias("matched_rows"), F.count("*").alias("total_rows"))

    def page(self, start: int = 0, count: int = PAGE_ROWS, column_start: int = 0, column_count: int | None = None, preview: bool = True) -> DataFrame:
        """At most 256 rows from the start-th visible one; columns by a window over all of them. Long cells are cut for display."""
        if count > PAGE_ROWS:
            raise DelimitedError("Too many rows requested in one batch")
        start, count = max(0, int(start)), max(0, int(count))
        last = len(self.headers) if column_count is None else min(len(self.headers), column_start + column_count)
        cut = (lambda c: expr.truncate_utf8(c, PREVIEW_BYTES)) if preview else (lambda c: c)
        picked = [cut(self.cells[c]).alias(f"c{i}") for i, c in enumerate(range(min(column_start, last), last))]
        if not self.keys and not self.query and self.dense:
            # physical order without a filter: a range of row numbers, which the source can prune by; no sort of the whole
            some = self._runs([(start, start + count - 1)]).orderBy("row_idx")
        else:
            some = self.filtered().orderBy(*self.order()).offset(start).limit(count)
        return some.select("row_idx", *picked)

    def page_by_ids(self, ids: list[int]) -> DataFrame:
        """Rows by physical number, in the order asked for (``pos``); unknown numbers give blank rows."""
        if len(ids) > PAGE_ROWS:
            raise DelimitedError("Too many rows requested in one batch")
        spark = self.base.sparkSession
        wanted = spark.createDataFrame([(i, int(x)) for i, x in enumerate(ids)], "pos int, row_idx long")
        # at most a page of ids: they go to the rows as a filter, and what is found, a page at most, goes to the ids
        found = self._runs([(x, x) for x in sorted({int(x) for x in ids})]).select("row_idx", *[expr.truncate_utf8(c, PREVIEW_BYTES).alias(f"c{i}") for i, c in enumerate(self.cells)])
        names = [f"c{i}" for i in range(len(self.cells))]
        return wanted.join(F.broadcast(found), "row_idx", "left").select("pos", "row_idx", *[F.coalesce(n, F.lit("")).alias(n) for n in names]).orderBy("pos")

    def locate(self, row_idx: int) -> DataFrame:
        """visible_pos (from 1) of a physical row in this view; no row if the filter hides it."""
        if not self.keys:
            target = self.filtered().where(F.col("row_idx") <= row_idx)
            return target.agg(F.count("*").alias("visible_pos"), F.max("row_idx").alias("row_idx")).where(F.col("row_idx") == row_idx).select("row_idx", "visible_pos")
        # the rows before the target are counted: no global numbering, so no single partition
        flat, names = self.keyed()
        flat = flat.select("row_idx", *[n for n, _ in names])
        target = F.broadcast(flat.where(F.col("row_idx") == row_idx).limit(1).select(F.col("row_idx").alias("t"), *[F.col(n).alias("t" + n) for n, _ in names]))
        before, same = F.lit(False), F.lit(True)
        for n, descending in names:
            a, b = F.col(n), F.col("t" + n)
            less = F.coalesce((a > b) if descending else (a < b), a.isNotNull() & b.isNull())
            before, same = before | (same & less), same & a.eqNullSafe(b)
        before = before | (same & (F.col("row_idx") <= F.col("t")))
        return flat.join(target, before).groupBy("t").agg(F.count("*").alias("visible_pos")).select(F.col("t").alias("row_idx"), "visible_pos")

    def ranked(self) -> DataFrame:
        """row_idx and its place in the view, from 1.

        The sorted row numbers are written in range partitions; how many rows each has gives
        the places at which the next ones begin. No partition ever holds all rows.
        """
        spark = self.base.sparkSession
        part, mask = 33, (1 << 33) - 1  # of a row's id: the partition, and the place within it
        rows = written(self.filtered().orderBy(*self.order()).select("row_idx", F.monotonically_increasing_id().alias("at")), "ranked")
        sizes = {r["part"]: r["n"] for r in rows.groupBy(F.shiftright("at", part).alias("part")).agg(F.count("*").alias("n")).collect()}
        before, starts = 0, []
        for p in sorted(sizes):
            starts.append((p, before))
            before += sizes[p]
        starts = F.broadcast(spark.createDataFrame(starts, "part long, before long"))
        place = (F.col("before") + F.col("at").bitwiseAND(F.lit(mask)) + 1).cast("int" if before < 1 << 31 else "long")
        return rows.join(starts, F.shiftright("at", part) == F.col("part")).select("row_idx", place.alias("visible_pos"))

    def copy_rows(self) -> DataFrame:
        """row_idx and the visible cells joined by tabs."""
        return self.filtered().orderBy(*self.order()).select("row_idx", expr.tsv_line([self.cells[c] for c in self.visible]).alias("line"))

    def export_lines(self, columns: list[int] | None = None, delimiter: str = ",") -> DataFrame:
        """row_idx and the exported line, in the view's order."""
        columns = list(range(len(self.headers))) if columns is None else columns
        if not columns:
            raise DelimitedError("Pick at least one column to export.")
        self._check(columns)
        return self.filtered().orderBy(*self.order()).select("row_idx", expr.export_line([self.cells[c] for c in columns], delimiter).alias("line"))


def union_cells(views: list[tuple[str, View]], pick) -> DataFrame:
    """(file_ord, path, row_idx, column_index, column_name, value, row_values) of the cells that ``pick`` takes, from several views."""
    parts = []
    for i, (path, v) in enumerate(views):
        if v.array:
            row = F.transform(F.col(v.array), lambda c: c)
        else:
            row = F.array(*v.cells)
        name = F.coalesce(F.get(F.array(*[F.lit(h) for h in v.headers]), F.col("column_index")), F.lit("")) if v.headers else F.lit("")
        any_hit = F.exists(row, pick) if v.array else reduce(lambda a, b: a | b, [pick(c) for c in v.cells], F.lit(False))
        hits = v.base.where(any_hit).select("row_idx", row.alias("row_values"))
        cells = hits.select("row_idx", "row_values", F.posexplode("row_values").alias("column_index", "value")).where(pick(F.col("value")))
        parts.append(cells.select(F.lit(i).alias("file_ord"), F.lit(path).alias("path"), "row_idx", "column_index", name.alias("column_name"), "value", "row_values"))
    return reduce(DataFrame.unionByName, parts)
