"""Column expressions for the engine's text rules. All stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE = r"(?U)^\s+|\s+\z"
NUMBER = r"(?i)^[+-]?(inf|infinity|([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?)\z"


def utrim(c: Column) -> Column:
    """Without Unicode white space at both ends; null counts as empty."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), SPACE, "")


def ascii_fold(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def char_fold(c: Column) -> Column:
    """Each character's lower case by itself: a capital sigma never becomes a final one."""
    return F.lower(F.replace(c, F.lit("Σ"), F.lit("σ")))


def fold_filter_needle(query: str) -> str:
    """A filter's query, trimmed and lower-cased as a whole."""
    return query.strip(PY_SPACE).lower()


#: White space as Unicode defines it; Python's own strip takes four control characters more.
PY_SPACE = "".join(c for c in map(chr, (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def contains_filter(c: Column, query: str) -> Column:
    """Whether a cell contains a filter's query. A query without a letter needs no folding: no capital's lower case is an ASCII digit or mark."""
    needle = fold_filter_needle(query)
    plain = needle.isascii() and not any(x.isalpha() for x in needle)
    return F.contains(c if plain else char_fold(c), F.lit(needle))


def contains_search(c: Column, query: str) -> Column:
    """Whether a cell contains a search's query: ASCII folding for an ASCII query, else whole-string lower case."""
    q = query.strip(PY_SPACE)
    if q.isascii() and not any(x.isalpha() for x in q):
        return F.contains(c, F.lit(q))
    if q.isascii():
        return F.contains(ascii_fold(c), F.lit(q.translate(str.maketrans(UPPER, LOWER))))
    return F.contains(F.lower(c), F.lit(q.lower()))


def is_number(trimmed: Column) -> Column:
    return trimmed.rlike(NUMBER)


def sort_columns(cell: Column, numeric: bool) -> list[Column]:
    """Keys that order a cell: kind, number, sign of zero, text. Empty cells come last, text in a numeric column before them."""
    t = utrim(cell)
    if not numeric:
        return [F.when(t == "", 2).otherwise(0), ascii_fold(t)]
    num = is_number(t)
    value = F.when(num, F.expr("0d") + t.try_cast("double"))
    zero = F.when(num & (t.try_cast("double") == 0) & t.startswith("-"), 0).otherwise(1)
    return [F.when(t == "", 2).when(~num, 1).otherwise(0), value, zero, F.when(num, F.lit("")).otherwise(ascii_fold(t))]


def ordering(columns: list[Column], descending: bool) -> list[Column]:
    """All keys in one direction: descending reverses everything, so empty cells come first."""
    return [c.desc_nulls_last() if descending else c.asc_nulls_last() for c in columns]


def truncate_utf8(c: Column, limit: int) -> Column:
    """At most ``limit`` bytes of a cell, cut at a character, with an ellipsis if anything was cut."""
    b = F.encode(c, "UTF-8")
    # a character has four bytes at most: step back over up to three that continue one
    at = lambda i: F.hex(F.substring(b, limit + 1 - i, 1))  # noqa: E731  the byte behind a cut of i bytes less
    keep = reduce(lambda rest, i: F.when(~at(i).between("80", "BF"), limit - i).otherwise(rest), (2, 1, 0), F.lit(limit - 3))
    return F.when(F.octet_length(c) <= limit, c).otherwise(F.concat(F.decode(b.substr(F.lit(1), keep), "UTF-8"), F.lit("…")))


def csv_quote(c: Column, delimiter: str = ",") -> Column:
    """A cell as it is exported: quoted if it holds the delimiter, a quote or a line end."""
    needs = reduce(lambda a, b: a | b, [F.contains(c, F.lit(x)) for x in (delimiter, '"', "\r", "\n")])
    return F.when(needs, F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def export_line(cells: list[Column], delimiter: str = ",") -> Column:
    """A row as it is exported, without the line end."""
    return F.concat_ws(delimiter, *[csv_quote(c, delimiter) for c in cells])


def tsv_line(cells: list[Column]) -> Column:
    return F.concat_ws("\t", *cells)


def any_cell(cells: list[Column], query: str) -> Column:
    """Whether any of some columns contains the query; a chain of alternatives, so it compiles and stops early."""
    return reduce(lambda a, b: a | b, [contains_filter(c, query) for c in cells], F.lit(False))


def any_array_cell(cells: Column, query: str) -> Column:
    return F.exists(cells, lambda c: contains_filter(c, query))
