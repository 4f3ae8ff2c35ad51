"""Delimited text to ragged rows of cells."""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

CHUNK = 1 << 20


@lru_cache
def _plain(delimiter: str) -> re.Pattern:
    return re.compile(f"[^{re.escape(delimiter)}\r\n]*")


_QUOTED = re.compile('[^"]*')


class _Short(Exception):
    """The buffer ends where more text could change the row."""


def _row(s: str, i: int, delimiter: str, final: bool) -> tuple[list[str], int]:
    """The row that starts at ``i``, and where the next one starts."""
    cells, n, plain = [], len(s), _plain(delimiter)
    while True:
        if i < n and s[i] == '"':
            i += 1
            part = []
            while True:
                m = _QUOTED.match(s, i)
                part.append(m[0])
                i = m.end()
                if i == n:
                    if not final:
                        raise _Short
                    cells.append("".join(part))
                    return cells, i  # an open quote runs to the end
                if s[i + 1 : i + 2] == '"':
                    part.append('"')
                    i += 2
                elif i + 1 == n and not final:
                    raise _Short
                else:
                    i += 1
                    break
            cells.append("".join(part))
            while i < n and s[i] != delimiter and s[i] in " \t":
                i += 1
        else:
            m = plain.match(s, i)
            cells.append(m[0])
            i = m.end()
        if i == n:
            if not final:
                raise _Short
            return cells, i
        if s[i] == delimiter:
            i += 1
            continue
        if s[i] == "\n":
            return cells, i + 1
        if s[i] == "\r":
            if i + 2 >= n and not final:
                raise _Short
            return cells, i + (2 if s[i + 1 : i + 2] == "\n" else 3 if s[i + 1 : i + 3] == "\r\n" else 1)
        return cells, i  # what stands behind a closing quote begins the next row


def rows_of_text(chunks: Iterable[str], delimiter: str) -> Iterator[list[str]]:
    """Rows of text that comes in pieces. A row is parsed again if a piece ends within it; then more is read at once."""
    source, buffer, at, want = iter(chunks), "", 0, 1
    final = False
    while True:
        try:
            while at < len(buffer):
                cells, at = _row(buffer, at, delimiter, final)
                want = 1
                yield cells
        except _Short:
            pass
        if final:
            return
        parts = [buffer[at:]]
        at = 0
        for _ in range(want):
            piece = next(source, None)
            if piece is None:
                final = True
                break
            parts.append(piece)
        want *= 2
        buffer = "".join(parts)


@lru_cache
def _whole_row(delimiter: str) -> re.Pattern:
    """A row with its line end; an open quote takes all that is left."""
    d, blanks = re.escape(delimiter), "".join(b for b in " \t" if b != delimiter)
    cell = f'(?>"[^"]*+(?:""[^"]*+)*+(?:"[{blanks}]*+|\\Z)|(?!")[^{d}\r\n]*+)'
    return re.compile(f"{cell}(?:{d}{cell})*+(?:\r{{1,2}}\n|\r|\n)?")


_LINE_END = re.compile("\r{1,2}\n|\r")


def row_starts(text: str, delimiter: str) -> tuple[list[int], bool]:
    """Where rows begin in text that begins with a row and ends behind a line feed or at the end of all; whether a quote is open at its end."""
    starts = [m.start() for m in _whole_row(delimiter).finditer(text) if m.end() > m.start()]
    if not starts or '"' not in text:
        return starts, False
    try:
        # a line feed put behind it ends a row, unless a quote is open
        _row(text[starts[-1] :] + "\n  ", 0, delimiter, False)
    except _Short:
        return starts, True
    return starts, False


def count_rows(text: str, delimiter: str) -> tuple[int, bool]:
    """How many rows begin in a text, without building a cell; whether a quote is open at its end."""
    if '"' in text:
        starts, is_open = row_starts(text, delimiter)
        return len(starts), is_open
    n = text.count("\n") + (len(_LINE_END.findall(text)) - text.count("\r\n") if "\r" in text else 0)
    return n + (text[-1:] not in ("", "\n", "\r")), False


#: Text without quotes of at least this length is split by Arrow between rows that have some.
_NATIVE = 1 << 12


def cell_lists(text: str, delimiter: str):
    """The rows of a text as an Arrow array of lists. Where there are no quotes, Arrow itself splits."""
    import pyarrow as pa

    kind = pa.list_(pa.field("element", pa.string(), False))
    parts, rows, at = [], [], 0
    while at < len(text):
        quote = text.find('"', at)
        end = len(text) if quote < 0 else text.rfind("\n", at, quote) + 1
        if quote < 0 or end - at >= _NATIVE:
            parts += [pa.array(rows, kind)] * bool(rows) + [_split(text[at:end], delimiter, kind)]
            rows, at = [], end
        while quote >= 0 and at <= quote:
            cells, at = _row(text, at, delimiter, True)
            rows.append(cells)
    parts += [pa.array(rows, kind)] if rows or not parts else []
    return pa.concat_arrays(parts)


def _split(text: str, delimiter: str, kind):
    import pyarrow as pa
    import pyarrow.compute as pc

    if "\r" in text:
        text = _LINE_END.sub("\n", text)
    lines = pc.split_pattern(pa.array([text[: len(text) - (text[-1] == "\n")]]), "\n").flatten()
    got = pc.split_pattern(lines, delimiter)
    return pa.ListArray.from_arrays(got.offsets, got.values, type=kind)


def decoded(stream, encoding: str) -> Iterator[str]:
    """Text of a byte stream; what isn't valid becomes U+FFFD."""
    name = {"utf-8": "utf-8", "utf-8-bom": "utf-8", "utf-16-le": "utf-16-le", "utf-16-be": "utf-16-be"}[encoding]
    decode = codecs.getincrementaldecoder(name)("replace")
    while data := stream.read(CHUNK):
        yield decode.decode(data)
    if rest := decode.decode(b"", True):
        yield rest


def rows_of_bytes(stream, delimiter: str, encoding: str = "utf-8") -> Iterator[list[str]]:
    return rows_of_text(decoded(stream, encoding), delimiter)


def parse(text: str, delimiter: str = ",") -> list[list[str]]:
    return list(rows_of_text([text], delimiter))
