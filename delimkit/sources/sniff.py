"""Profiles of delimited files: encoding, delimiter, kind, warnings."""

from __future__ import annotations

import glob
import os
from collections import Counter
from dataclasses import replace

from ..model import SAMPLE_BYTES, SAMPLE_ROWS, Dialect, FileProfile
from . import tokenize

# Candidates in order of preference, names, and byte order marks.
CANDIDATES = [",", ";", "\t", "|", ":", " "]
DELIMITER_LABELS = {",": "comma", ";": "semicolon", "\t": "tab", "|": "pipe", ":": "colon", " ": "space"}
KIND_LABELS = {"csv": "CSV", "tsv": "TSV", "delimited_text": "Delimited text", "plain_text": "Plain text"}
MARKS = {"utf-8-bom": b"\xef\xbb\xbf", "utf-16-le": b"\xff\xfe", "utf-16-be": b"\xfe\xff"}
ENCODINGS = ("utf-8", "utf-8-bom", "utf-16-le", "utf-16-be")
#: Endings of files that a folder offers.
ENDINGS = (".csv", ".tsv", ".txt")
WARN_BINARY = "Binary-looking content detected."
WARN_UTF8 = "Invalid UTF-8 bytes detected; text may be decoded lossily."
WARN_NONE = "No consistent delimiter found in the sample."
WARN_LOW = "Delimiter confidence is low."


def open_bytes(path: str):
    """A byte stream of a local path or of a URI that a file system is known for."""
    if "://" in path:
        from pyarrow import fs

        system, at = fs.FileSystem.from_uri(path)
        return system.open_input_file(at)
    return open(path, "rb")


def size_of(path: str) -> int:
    if "://" in path:
        from pyarrow import fs

        system, at = fs.FileSystem.from_uri(path)
        info = system.get_file_info(at)
        if info.type != fs.FileType.File:
            raise FileNotFoundError(path)
        return info.size
    return os.path.getsize(path)


def listed(path: str) -> list[str]:
    """The files that a path stands for, sorted: itself, a folder's delimited files, or those that a pattern fits."""
    if "://" in path:
        from pyarrow import fs

        system, at = fs.FileSystem.from_uri(path)
        if system.get_file_info(at).type != fs.FileType.Directory:
            return [path]
        names = [x.path for x in system.get_file_info(fs.FileSelector(at)) if x.type == fs.FileType.File]
        return sorted(path.rstrip("/") + "/" + os.path.basename(n) for n in names if n.lower().endswith(ENDINGS))
    if os.path.isdir(path):
        return sorted(e.path for e in os.scandir(path) if e.is_file() and e.name.lower().endswith(ENDINGS))
    return [path] if os.path.exists(path) or not glob.has_magic(path) else sorted(p for p in glob.glob(path, recursive=True) if os.path.isfile(p))


def detect_encoding(head: bytes) -> tuple[str, int]:
    """Encoding by byte order mark alone, and the mark's length."""
    for name, mark in MARKS.items():
        if head.startswith(mark):
            return name, len(mark)
    return "utf-8", 0


def score(sample: str, delimiter: str) -> tuple[int, int, float, int]:
    """Score of a candidate; its modal number of columns, the share of rows that have it, rows sampled."""
    rows = []
    for cells in tokenize.rows_of_text([sample], delimiter):
        rows.append(len(cells))
        if len(rows) == SAMPLE_ROWS:
            break
    many = [n for n in rows if n > 1]
    if not many:
        return -len(rows), min(1, len(rows)), 0.0, len(rows)
    counts = Counter(rows)
    mode = max(counts, key=lambda n: (counts[n], n))
    agree = counts[mode] / len(rows)
    return int(agree * 100_000) + int(len(many) / len(rows) * 50_000) + mode * 100 - abs(rows[0] - mode), mode, agree, len(rows)


def detect_delimiter(sample: str) -> tuple[str, str, int, int, bool]:
    """Best candidate, confidence, likely columns, rows sampled, whether the text is delimited at all."""
    if not sample:
        return ",", "low", 0, 0, False
    got = sorted(((score(sample, d), -i, d) for i, d in enumerate(CANDIDATES)), key=lambda x: (x[0][0], x[1]), reverse=True)
    (best, mode, agree, rows), _, delimiter = got[0]
    shaped = best > 0 and mode >= 2
    if not shaped or not rows:
        confidence = "low"
    elif agree >= 0.8 and best - got[1][0][0] >= 10_000:
        confidence = "high"
    else:
        confidence = "medium" if agree >= 0.5 else "low"
    return delimiter, confidence, mode, rows, shaped


def is_binary(text: str, raw: bytes | None = None) -> bool:
    data = text.encode("utf-8", "surrogatepass") if raw is None else raw
    if not data:
        return False
    odd = sum(1 for b in data if b < 32 and b not in (9, 10, 13))
    return 0 in data or odd / len(data) > 0.05


def _text(sample: bytes, encoding: str) -> tuple[str, bool]:
    """The sample as text, and whether it is valid; a character cut by the sample's end is no fault."""
    if encoding.startswith("utf-16"):
        return sample[: len(sample) // 2 * 2].decode(encoding, "replace"), True
    try:
        return sample.decode("utf-8"), True
    except UnicodeDecodeError as e:
        if len(sample) >= SAMPLE_BYTES and e.reason == "unexpected end of data" and e.start >= len(sample) - 3:
            return sample[: e.start].decode("utf-8"), True
        return sample.decode("utf-8", "replace"), False


def kind_of(extension: str | None, shaped: bool, delimiter: str) -> str:
    if extension in ("csv", "tsv"):
        return extension
    if not shaped:
        return "plain_text"
    # by content alone only tabs name a kind
    return "tsv" if delimiter == "\t" and extension != "txt" else "delimited_text"


def profile_file(path: str) -> tuple[FileProfile, Dialect]:
    """The profile of a file and the dialect to read it with. Reads one sample from its start."""
    with open_bytes(path) as f:
        head = f.read(SAMPLE_BYTES + 3)
    encoding, start = detect_encoding(head)
    sample = head[start : start + SAMPLE_BYTES]
    text, valid = _text(sample, encoding)
    delimiter, confidence, columns, rows, shaped = detect_delimiter(text)
    extension = os.path.splitext(path)[1][1:].lower() or None
    binary = is_binary(text, None if encoding.startswith("utf-16") else sample)
    warnings = [WARN_BINARY] if binary else []
    if not valid:
        warnings.append(WARN_UTF8)
    if not shaped:
        warnings.append(WARN_NONE)
    elif confidence == "low":
        warnings.append(WARN_LOW)
    # whatever the shape: the delimiter that rows are read with
    if extension in ("csv", "tsv") and delimiter not in {"csv": ",;", "tsv": "\t"}[extension]:
        warnings.append(f"Extension is {extension.upper()} but detected {DELIMITER_LABELS[delimiter]} delimiter.")
    kind = kind_of(extension, shaped, delimiter)
    made = FileProfile(extension, kind, KIND_LABELS[kind], ord(delimiter) if shaped else None, DELIMITER_LABELS[delimiter] if shaped else None, confidence, encoding if valid else "utf-8-lossy", rows, columns, binary, tuple(warnings))
    return made, Dialect(delimiter, encoding, start)


def override(path: str, profile: FileProfile, dialect: Dialect, delimiter: str | None = None, encoding: str | None = None) -> tuple[FileProfile, Dialect]:
    """A profile and dialect under a user's choice of delimiter and encoding. Unknown encodings are ignored."""
    if delimiter:
        d = delimiter[0]
        if ord(d) > 255:
            raise ValueError("a delimiter is one byte")
        profile = replace(profile, delimiter=ord(d), delimiter_label=DELIMITER_LABELS.get(d, "unknown"), delimiter_confidence="user", warnings=tuple(w for w in profile.warnings if "delimiter" not in w.lower()))
        dialect = replace(dialect, delimiter=d)
    if encoding and encoding.lower() in ENCODINGS:
        e = encoding.lower()
        with open_bytes(path) as f:
            head = f.read(3)
        mark = MARKS.get(e, b"\0none")
        profile = replace(profile, encoding=e, binary_like=False, warnings=tuple(w for w in profile.warnings if w not in (WARN_UTF8, WARN_BINARY)))
        dialect = replace(dialect, encoding=e, data_start=len(mark) if head.startswith(mark) else 0)
    return profile, dialect


def tone(warnings) -> str:
    """positive, warning (only a file name's ending differs) or negative."""
    soft = [w.startswith("Extension is CSV but detected") for w in warnings]
    return "positive" if not soft else "warning" if all(soft) else "negative"
