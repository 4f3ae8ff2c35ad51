"""Tokenizer, sniffer, and text expressions against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from delimkit.functions import expr
from delimkit.sources import sniff, tokenize


@pytest.mark.parametrize(
    "text, rows",
    [
        ("p,q,r\r\r\n7,8,9\r\r\n0,2,4\r\r\n", [["p", "q", "r"], ["7", "8", "9"], ["0", "2", "4"]]),
        ("left,right\r\r\nup,down\r\r\n", [["left", "right"], ["up", "down"]]),
        ("m,n\r\n5,6\rS,T\n", [["m", "n"], ["5", "6"], ["S", "T"]]),
        ("a,b\n\n1,2\n", [["a", "b"], [""], ["1", "2"]]),
        ('a,b\n"x"yz,1\n', [["a", "b"], ["x"], ["yz", "1"]]),
        ("a,b,", [["a", "b", ""]]),
        ('"abc', [["abc"]]),
        ('"a""b","c\nd" ,x"y', [['a"b', "c\nd", 'x"y']]),
        (' "q",""\n', [[' "q"', ""]]),
        ("", []),
    ],
)
def test_rows(text, rows):
    assert tokenize.parse(text) == rows
    assert list(tokenize.rows_of_text(list(text), ",")) == rows  # one character at a time


def test_arrays_counts_and_starts_equal_rows(monkeypatch):
    r = random.Random(5)
    for native in (1, 1 << 12):
        monkeypatch.setattr(tokenize, "_NATIVE", native)
        for _ in range(3000):
            d = r.choice(",; \t")
            text = "".join(r.choice('ab"",;\r\n \t\n') for _ in range(r.randint(0, 30)))
            want = tokenize.parse(text, d)
            assert tokenize.cell_lists(text, d).to_pylist() == want
            n, is_open = tokenize.count_rows(text, d)
            assert n == len(want) and (text[-1:] != "\n" or is_open == (len(tokenize.parse(text + "x", d)) == n))


def test_rows_do_not_depend_on_chunks():
    r = random.Random(4)
    for _ in range(300):
        text = "".join(r.choice('ab",;\r\n \t') for _ in range(40))
        cut = sorted(r.randrange(41) for _ in range(4))
        parts = [text[a:b] for a, b in zip([0, *cut], [*cut, 40], strict=True)]
        assert list(tokenize.rows_of_text(parts, ",")) == tokenize.parse(text)


@pytest.mark.parametrize(
    "rows, delimiter, confidence",
    [
        (["widths;settings;title", '"[""wide""]";"{""key"": ""k1"", ""on"": true}";Plain Paper'], ";", "high"),
        (["oak@trees.test:acorn1", "ash@trees.test:key22", "elm@trees.test:leaf3", "fir@trees.test:cone4"], ":", "high"),
        (["oak@trees.test acorn1", "ash@trees.test key22", "elm@trees.test leaf3", "fir@trees.test cone4"], " ", "high"),
        (["no,whole name,port", "5,Tall Ship,Old Harbour", "6,Low Barge,Quay"], ",", None),
        (["no,clock,mark", "5,09:10:11,oak", "6,09:12:11,ash"], ",", None),
    ],
)
def test_delimiters(rows, delimiter, confidence):
    got = sniff.detect_delimiter("\n".join(rows) + "\n")
    assert got[0] == delimiter and confidence in (None, got[1])


def test_profiles(tmp_path):
    def write(name, data):
        (tmp_path / name).write_bytes(data)
        return str(tmp_path / name)

    p, d = sniff.profile_file(write("a.csv", b"no;tree\n5;Oak\n6;Ash\n"))
    assert (p.delimiter_label, p.detected_kind, p.delimiter_confidence, p.binary_like, p.warnings) == ("semicolon", "csv", "high", False, ())
    p, _ = sniff.profile_file(write("b.txt", bytes([0, 0x9F, 0x92, 0x96, 0, 1, 2, 3])))
    assert p.binary_like and p.warnings[0] == sniff.WARN_BINARY
    for name, mark in (("utf-16-le", b"\xff\xfe"), ("utf-16-be", b"\xfe\xff")):
        p, d = sniff.profile_file(write("c.csv", mark + "no,tree,wood\n5,A,B\n6,C,D\n7,E,F\n".encode(name)))
        assert (p.encoding, p.delimiter_label, p.binary_like, d.data_start) == (name, "comma", False, 2)
    p, _ = sniff.profile_file(write("d.tsv", b"a,b\n1,2\n"))
    assert "Extension is TSV but detected comma delimiter." in p.warnings
    p, _ = sniff.profile_file(write("one.tsv", b"word\nonly\n"))
    assert "Extension is TSV but detected comma delimiter." in p.warnings and sniff.WARN_NONE in p.warnings
    for name, data, kind in (("a.log", b"a,b\n1,2\n", "delimited_text"), ("b.log", b"a\tb\n1\t2\n", "tsv"), ("c.txt", b"a\tb\n1\t2\n", "delimited_text"), ("d.dat", b"plain\n", "plain_text"), ("noending", b"a;b\n1;2\n", "delimited_text")):
        assert sniff.profile_file(write(name, data))[0].detected_kind == kind
    p, d = sniff.profile_file(write("e.csv", b""))
    assert (d.delimiter, p.delimiter_confidence, p.sampled_rows) == (",", "low", 0)
    bom = write("f.csv", b"\xef\xbb\xbfid,name\n1,x\n")
    p, d = sniff.override(bom, *sniff.profile_file(bom), None, "UTF-8")
    assert d.data_start == 0 and p.encoding == "utf-8"


def plain_key(cell, numeric):
    import re

    t = cell.strip(expr.PY_SPACE)
    if not t:
        return (2, 0, 0, b"")
    low = "".join(c.lower() if c.isascii() else c for c in t).encode()
    if numeric:
        if re.fullmatch(r"(?i)[+-]?(inf|infinity|([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?)", t):
            v = float(t)
            return (0, v, 0 if v == 0 and t[0] == "-" else 1, b"")
        return (1, 0, 0, low)
    return (0, 0, 0, low)


@pytest.mark.parametrize("numeric", [True, False])
@pytest.mark.parametrize("descending", [True, False])
def test_sort_order_equals_plain(spark, numeric, descending):
    r = random.Random(1)
    cells = ["", "  ", "10", "2", "n/a", "-0", "0", "inf", "-INF", "1e3", "+5", ".5", "5.", "1d", "0x1p3", "NaN", "1_0", "é", "B", "b", " 7", "1e999"]
    rows = [(i, r.choice(cells)) for i in range(400)]
    df = spark.createDataFrame(rows, "row_idx long, c string")
    got = [x.row_idx for x in df.orderBy(*expr.ordering(expr.sort_columns(F.col("c"), numeric), descending), "row_idx").collect()]
    want = [i for i, _ in sorted(rows, key=lambda x: plain_key(x[1], numeric), reverse=descending)]
    if descending:  # ties stay in physical order
        keyed = {}
        for i, c in rows:
            keyed.setdefault(plain_key(c, numeric), []).append(i)
        want = [i for k in sorted(keyed, reverse=True) for i in keyed[k]]
    assert got == want


def test_truncation_and_folds(spark):
    r = random.Random(2)
    texts = ["".join(r.choice("aé漢😀") for _ in range(r.randint(0, 12))) for _ in range(300)]
    for limit in (4, 9, 10, 11):
        got = [x.t for x in spark.createDataFrame(list(enumerate(texts)), "i int, c string").orderBy("i").select(expr.truncate_utf8(F.col("c"), limit).alias("t")).collect()]
        assert got == [t if len(t.encode()) <= limit else t.encode()[:limit].decode("utf-8", "ignore") + "…" for t in texts]
    one = spark.createDataFrame([("ΟΔΟΣ", "\u212a")], "a string, k string")
    row = one.select(expr.contains_filter(F.col("a"), "ΟΔΟΣ"), expr.contains_search(F.col("a"), "ΟΔΟΣ"), expr.contains_filter(F.col("k"), "k"), expr.contains_search(F.col("k"), "k")).first()
    assert tuple(row) == (False, True, True, False)
