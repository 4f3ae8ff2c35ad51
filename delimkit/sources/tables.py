"""Tables as delimited documents: each column as canonical text, rows numbered by a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def cell_text(column: Column, kind: T.DataType) -> Column:
    """A value's canonical text; null is the empty cell. Floating-point values of at most two decimals show both, others all they have."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        short = column.try_cast("decimal(18,2)")
        c = F.when(short.cast("double") == column, short.cast("string")).otherwise(column.cast("string"))
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        c = F.date_format(column, "yyyy-MM-dd HH:mm:ss")
    else:
        c = column.cast("string")
    return F.coalesce(c, F.lit(""))


def alphabet(kind: T.DataType) -> str | None:
    """The characters of a kind's texts, where none is a letter."""
    if isinstance(kind, T.IntegralType):
        return "0123456789-"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "0123456789-: "
    return None


def numbered(df: DataFrame) -> DataFrame:
    """``df``, read from files, with ``row_idx``: its rows counted from 0 by file and place in it, without moving one."""
    place = df.select("*", F.col("_metadata.file_path").alias("file_of_row"), F.col("_metadata.row_index").alias("row_idx"))
    if len(df.inputFiles()) < 2:
        return place.drop("file_of_row")
    sizes = sorted((r["f"], r["n"]) for r in place.groupBy(F.col("file_of_row").alias("f")).agg(F.count("*").alias("n")).collect())
    before, starts = 0, []
    for f, n in sizes:
        starts.append((f, before))
        before += n
    starts = F.broadcast(df.sparkSession.createDataFrame(starts, "file_of_row string, rows_before long"))
    return place.join(starts, "file_of_row").withColumn("row_idx", F.col("row_idx") + F.col("rows_before")).drop("file_of_row", "rows_before")


def table_view(df: DataFrame, key: str | None = None, dense: bool = False):
    """A view over a table.

    ``key`` is a column of unique whole numbers that has the rows' order; ``dense`` says that
    it counts them from 0 without gaps, so that a page is a range of it. Without a key, rows
    of files are numbered by their place.
    """
    from ..operators.view import View

    cells = [cell_text(F.col(f.name), f.dataType).alias(f"c{i}") for i, f in enumerate(df.schema)]
    if key is None:
        base = numbered(df).select("row_idx", *cells)
    else:
        base = df.select(F.col(key).cast("long").alias("row_idx"), *cells)
    return View(base, tuple(df.columns), tuple(F.col(f"c{i}") for i in range(len(df.columns))), dense=dense or key is None, alphabets=tuple(alphabet(f.dataType) for f in df.schema))
