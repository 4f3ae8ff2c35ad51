"""Secret scans: patterns, and structural confirmation of encoded candidates.

Base kinds are found by pattern. Besides, long base64 or hex runs are decoded, and are
reported only if what they decode to has the structure of a key: nested DER lengths that
add up, length-prefixed fields of a public-key blob, or a signed token whose header names
an algorithm.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import give_back, map_texts, slices

# The base patterns. Letters of names in either case, ASCII only.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24

#: Kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "der", "jwt", "keyblob")

_LONG_HEX = re.compile(r"[0-9a-f]{%d,}" % MIN_HEX)
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)(?![A-Za-z0-9_-])")
#: A maximal run of both alphabets; its parts in one alphabet are tried where the whole isn't a key.
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{40,}={0,2}")
_ONE_ALPHABET = (re.compile(r"[A-Za-z0-9+/]{40,}={0,2}"), re.compile(r"[A-Za-z0-9_-]{40,}={0,2}"))
_HEX_BLOB = re.compile(r"(?:[0-9a-fA-F]{2}){20,}")
#: A run may go on over line ends, as armoured keys do.
_ARMOUR = re.compile(r"(?:[A-Za-z0-9+/]{40,}\r?\n)+[A-Za-z0-9+/]+={0,2}")


def decode64(s: str) -> bytes | None:
    """Bytes of base64 or base64url text with or without padding; None if it isn't that."""
    s = re.sub(r"\s", "", s).rstrip("=").replace("-", "+").replace("_", "/")
    if len(s) % 4 == 1:
        return None
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_nodes(data: bytes, depth: int = 0) -> list[tuple[int, bytes]] | None:
    """The elements that fill ``data`` exactly as nested DER, or None. Constructed ones are parsed to 8 levels."""
    out, i = [], 0
    while i < len(data):
        if i + 2 > len(data):
            return None
        tag, n = data[i], data[i + 1]
        i += 2
        if n & 128:
            k = n & 127
            if not 1 <= k <= 4 or i + k > len(data):
                return None
            n = int.from_bytes(data[i : i + k], "big")
            if n < 128 or (k > 1 and not data[i]):
                return None  # DER takes the shortest form
            i += k
        if i + n > len(data):
            return None
        body = data[i : i + n]
        if tag & 32 and depth < 8 and der_nodes(body, depth + 1) is None:
            return None
        out.append((tag, body))
        i += n
    return out


def is_der_key(data: bytes | None) -> bool:
    """One sequence that fills the bytes and holds an integer version, an algorithm or nested sequences with bits."""
    if not data or len(data) < 20 or data[0] != 0x30:
        return False
    top = der_nodes(data)
    if not top or len(top) != 1:
        return False
    inner = der_nodes(top[0][1])
    if not inner or len(inner) < 2:
        return False
    tags = [t for t, _ in inner]
    if tags[0] == 0x02 and (len(inner) >= 3 or all(t == 0x02 for t in tags)):
        return True  # private key: a version first; or a bare public key: two integers
    return tags[0] == 0x30 and tags[1] in (0x03, 0x04)  # an algorithm, then key bits


def is_keyblob(data: bytes | None) -> bool:
    """Length-prefixed fields that fill the bytes, the first a name of a key type."""
    if not data or len(data) < 24:
        return False
    i, fields = 0, []
    while i < len(data):
        n = int.from_bytes(data[i : i + 4], "big")
        if i + 4 + n > len(data) or i + 4 > len(data):
            return False
        fields.append(data[i + 4 : i + 4 + n])
        i += 4 + n
    return len(fields) >= 2 and re.fullmatch(rb"(?:ssh|ecdsa|sk)-[a-z0-9@.-]+", fields[0]) is not None


def is_signed_token(header: str, payload: str) -> bool:
    """Both parts are JSON objects and the header names an algorithm."""
    for part, key in ((header, "alg"), (payload, None)):
        data = decode64(part)
        try:
            obj = json.loads(data) if data else None
        except ValueError:
            return False
        if not isinstance(obj, dict) or key and not isinstance(obj.get(key), str):
            return False
    return True


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) of the base kinds, in code points."""
    got = [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    got += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    # a run of 24 or more starts where a longest run starts, so both give the same spans
    return got + [("hex", *m.span()) for m in _LONG_HEX.finditer(text)]


def _candidates(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Places of a run that may be a key: the whole run if it is in one alphabet, and its longest parts in either."""
    run = text[start:end]
    mixed = ("+" in run or "/" in run) and ("-" in run or "_" in run)
    whole = [] if mixed else [(start, end)]
    parts = {m.span() for p in _ONE_ALPHABET for m in p.finditer(text, start, end)}
    return whole + sorted(parts - set(whole), key=lambda s: (s[0], -s[1]))


def confirmed_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans whose decoded bytes have the structure of a key or signed token."""
    got = [("jwt", *m.span()) for m in _TOKEN.finditer(text) if is_signed_token(m[1], m[2])] if "eyJ" in text else []
    taken = []
    for m in _ARMOUR.finditer(text) if "\n" in text else ():
        data = decode64(m[0])
        kind = "der" if is_der_key(data) else "keyblob" if is_keyblob(data) else None
        if kind:
            got.append((kind, *m.span()))
            taken.append(m.span())
    for m in _BASE64.finditer(text):
        for a, b in _candidates(text, *m.span()):
            if any(x <= a < y for x, y in taken):
                continue
            data = decode64(text[a:b])
            kind = "der" if is_der_key(data) else "keyblob" if is_keyblob(data) else None
            if kind:
                got.append((kind, a, b))
                taken.append((a, b))
    for m in _HEX_BLOB.finditer(text):
        data = bytes.fromhex(m[0])
        kind = "der" if is_der_key(data) else "keyblob" if is_keyblob(data) else None
        if kind:
            got.append((kind, *m.span()))
    return got


def ordered(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan_text(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and all spans, both in order. A null text has none."""
    base = base_spans(text) if text else []
    return ordered(base), ordered(base + (confirmed_spans(text) if text else []))


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Replace each span, overlapping ones as one, by a mark."""
    out, at = [], 0
    for _, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], "[REDACTED]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", redacted: bool = False) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans; with ``redacted`` also redacted_text.

    Positions are code points, ends exclusive. base_sha256 is the digest of the base spans
    as kind:start:end, ordered by start, then kind, joined by commas (of an empty text: the
    digest of nothing). ``spans`` has all spans, joined likewise. A null text has no spans
    (redacted_text stays null); repeated rows stay; null ids stay; further columns are
    ignored; an empty table gives an empty result; long texts are scanned whole.
    """
    fields = [("n_assign", T.LongType()), ("n_access", T.LongType()), ("n_hex", T.LongType()), ("base_sha256", T.StringType()), ("spans", T.StringType())]
    if redacted:
        fields.append(("redacted_text", T.StringType()))

    def setup():
        def step(texts):
            rows = []
            for x in texts:
                base, every = scan_text(x)
                kinds = [k for k, _, _ in base]
                row = [kinds.count("assign"), kinds.count("access"), kinds.count("hex"), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)]
                rows.append(row + [redact(x, every) if x else x] if redacted else row)
            return list(zip(*rows, strict=True)) if rows else [[] for _ in fields]

        return step

    return map_texts(df, setup, fields, id_col, text_col)


def redact_rows(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """All rows and columns of ``docs`` with secrets in texts replaced; ``chars_col``, if there, follows where a text changes.

    Null texts stay null; repeated rows, null ids and further columns stay as they are; an
    empty table gives an empty result.
    """
    at = docs.columns.index(text_col)
    chars = docs.columns.index(chars_col) if chars_col in docs.columns else None

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, text_col):
                texts, cols = part.column(at).to_pylist(), list(part.columns)
                new = [redact(x, scan_text(x)[1]) if x else x for x in texts]
                cols[at] = pa.array(new, cols[at].type)
                if chars is not None:
                    counts = [len(b) if a != b else n for a, b, n in zip(texts, new, cols[chars].to_pylist(), strict=True)]
                    cols[chars] = pa.array(counts, cols[chars].type)
                yield pa.RecordBatch.from_arrays(cols, names=part.schema.names)
        give_back()

    return docs.mapInArrow(run, docs.schema)
