"""Documents, views, search, export and streaming over real files."""

import os
import random

import pytest
from pyspark.sql import functions as F

from delimkit.model import DelimitedError, Dialect, SortKey
from delimkit.operators import export, search
from delimkit.operators import view as view_module
from delimkit.operators.document import Document, profile_files, profile_summary
from delimkit.operators.pages import PageCache
from delimkit.operators.progressive import ProgressiveDocument
from delimkit.session import Job, progress
from delimkit.sources import delimited, tokenize
from delimkit.sources.tables import table_view
from delimkit.streaming import progressive


@pytest.fixture
def write(tmp_path):
    def f(name, data):
        (tmp_path / name).write_bytes(data if isinstance(data, bytes) else data.encode())
        return str(tmp_path / name)

    return f


def ids(df):
    return [r.row_idx for r in df.collect()]


def test_open_page_and_overrides(spark, write):
    d = Document.open(spark, write("a.csv", "no,bird,pond\n7,Heron,North End\n8,Teal,Mill\n9,Coot,Quarry\n".encode("utf-16")))
    assert d.headers == ("no", "bird", "pond") and d.row_count() == 3
    assert [tuple(r)[1:] for r in d.view.page().collect()] == [("7", "Heron", "North End"), ("8", "Teal", "Mill"), ("9", "Coot", "Quarry")]
    d = Document.open(spark, write("b.csv", "no,bird|pond\n7,Heron|Mill\n"), delimiter="|")
    assert d.headers == ("no,bird", "pond") and d.profile.delimiter_confidence == "user" and d.profile.delimiter_label == "pipe"
    assert Document.open(spark, write("b2.csv", "no#bird\n7#Heron\n"), delimiter="#").profile.delimiter_label == "unknown"
    d = Document.open(spark, write("c.csv", "no,bird\n7,x\n".encode("utf-16-le")), encoding="utf-16-le")
    assert d.headers == ("no", "bird") and d.preview() == [["7", "x"]]
    assert Document.open(spark, write("f.csv", b"\xef\xbb\xbfno,n\n7,x\n"), encoding="utf-8").headers[0] == "\ufeffno"
    with pytest.raises(DelimitedError):
        Document.open(spark, write("d.txt", bytes(range(9)) * 9))
    empty = Document.open(spark, write("e.csv", ""))
    assert empty.headers == () and empty.row_count() == 0 and empty.view.count() == 0


def test_ragged_rows(spark, write):
    v = Document.open(spark, write("r.csv", "p,q\n5\n5,6,77\n\n")).view
    assert [tuple(r)[1:] for r in v.page().collect()] == [("5", ""), ("5", "6"), ("", "")]
    assert ids(v.filter("77").rows()) == [1]
    got = search.search_views([("r", v)], "77")
    assert [(m["row_index"], m["column_index"], m["column_name"]) for m in got.matches] == [(2, 2, "")]


@pytest.mark.parametrize(
    "text, keys, want",
    [
        ("fruit,x\nQuince,1\nfig,2\nMango,3\n", [SortKey(0)], [1, 2, 0]),
        ("k,kg\na,7\nb,150\nc,22\nd,3100\n", [SortKey(1, True)], [3, 1, 2, 0]),
        ("k,fruit\n4,Quince\n5,\n6,fig\n", [SortKey(1)], [2, 0, 1]),
        ("k,v\na,-3.5\nb,2.5\nc,-12\nd,0\ne,2.5\n", [SortKey(1)], [2, 0, 3, 1, 4]),
        ("bay,tons\nEast,9\nWest,11\nMid,6\nEast,8\nMid,5\nEast,7\n", [SortKey(0), SortKey(1, True)], [0, 3, 5, 2, 4, 1]),
        ("bay,ship\nEast,Yawl\nWest,Ketch\nMid,Dory\nEast,Brig\nMid,Bark\nEast,Cog\n", [SortKey(0, True), SortKey(1)], [1, 4, 2, 3, 5, 0]),
        ("x,n\n1,b\n2,\n3,a\n", [SortKey(1, True)], [1, 0, 2]),
        ("x,n\na,12\nb,2\nc,none\nd,\ne,3\nf,4\ng,5\n", [SortKey(1)], [1, 4, 5, 6, 0, 2, 3]),
    ],
)
def test_sorts(spark, write, text, keys, want):
    v = Document.open(spark, write("s.csv", text)).view.sort(*keys)
    assert ids(v.rows()) == want
    assert [v.locate(i).first().visible_pos for i in want[:3]] == [1, 2, 3]
    assert [r.row_idx for r in sorted(v.ranked().collect(), key=lambda r: r.visible_pos)] == want


def test_filters_pages_columns(spark, write):
    v = Document.open(spark, write("p.csv", "fruit,farm\nApple,Hill Top\nPlum,Dale\nCherry,HILL TOP\nDamson,Priory\n")).view
    assert ids(v.filter(" hill ").rows()) == [0, 2] and ids(v.filter("zzz").rows()) == [] and v.filter("  ").count() == 4
    assert v.filter("hill").counts().first().asDict() == {"rows_scanned": 4, "matched_rows": 2, "total_rows": 4}
    assert ids(v.filter("a").sort(SortKey(1)).page(1, 2)) == [0, 3]
    assert v.page(9, 5).count() == v.page(0, 0).count() == 0 and v.page(0, 1, 5, 2).columns == ["row_idx"]
    with pytest.raises(DelimitedError):
        v.page(0, 257)
    assert [r.c0 for r in v.page_by_ids([2, 99, 0]).collect()] == ["Cherry", "", "Apple"]
    assert v.filter("hill").locate(1).count() == 0 and v.filter("hill").locate(2).first().visible_pos == 2
    assert v.hide(0).visible == [1] and v.hide(0).hide(1).visible == [1] and v.hide_all().visible == [0] and v.hide(1).show_all().visible == [0, 1]
    assert export.copy_row(v, 1) == "Plum\tDale"
    with pytest.raises(DelimitedError):
        v.sort()
    with pytest.raises(DelimitedError):
        v.sort(SortKey(7))


def test_search_files(spark, write, tmp_path, monkeypatch):
    a, b, c = write("a.csv", "no;bird\n7;Stork\n8;Teal\n"), write("b.csv", "no;bird\n3;Crane\n4;Storkling\n"), write("c.txt", b"\0\1\2")
    got = search.search_files(spark, [a, c, b], "stork", 10)
    assert [(m["row_index"], m["row_values"], m["column_name"], m["file_name"]) for m in got.matches] == [(1, ["7", "Stork"], "bird", "a.csv"), (2, ["4", "Storkling"], "bird", "b.csv")]
    assert (got.searched_files, got.matched_files, len(got.schemas), len(got.errors), got.truncated) == (3, 2, 2, 1, False)
    got = search.search_files(spark, [a, c, b], "stork", 1)
    assert (got.truncated, got.searched_files, got.matched_files, got.errors) == (True, 1, 1, [])
    assert search.search_files(spark, [a], " ").searched_files == 0
    labels = [s["label"] for s in search.scopes(search.search_files(spark, [a, b], "stork"))]
    assert labels == ["All matched files (2)", "a.csv (1)", "b.csv (1)"]
    assert search.distinct_paths([" a ", "", "b", "a"]) == ["a", "b"]
    # overrides, folders and patterns, waves, progress, an early stop, a cancel that keeps what was found
    assert search.search_files(spark, [a], "7;stork", overrides={a: ("|",)}).matches[0]["value"] == "7;Stork"
    assert [e["path"] for e in search.search_files(spark, [str(tmp_path)], "stork").errors] == [c]
    assert search.search_files(spark, [str(tmp_path / "[ab].csv")], "stork").searched_files == 2
    monkeypatch.setattr(search, "FIRST_WAVE", 1)
    monkeypatch.setattr(search, "FASTER", 1)
    told = []
    got = search.search_files(spark, [a, b, "/no/such/file.csv", a], "stork", 2, progress=told.append)
    assert (got.truncated, got.searched_files, got.errors) == (True, 2, []) and [p.searched_files for p in told] == [1, 2, 2] and not told[-1].is_running
    got = search.search_files(spark, [a, b, c], "stork", 9, progress=told.append, cancelled=lambda: len(told) > 3)
    assert got.cancelled and got.searched_files == 1 and len(got.matches) == 1


def test_many_files_are_one_scan(spark, tmp_path):
    paths = []
    for i in range(2000):
        (tmp_path / f"f{i:04}.csv").write_text(f"id,word\n{i},w{i % 7}\n")
        paths.append(str(tmp_path / f"f{i:04}.csv"))
    df = delimited.scan(spark, [(p, Dialect()) for p in paths[:300]])
    assert df._jdf.queryExecution().logical().toString().count("Relation") <= 1 and df.count() == 300
    got = search.search_files(spark, paths, "w3", 5000)
    assert got.searched_files == 2000 and got.matched_files == len(got.matches) == len([i for i in range(2000) if i % 7 == 3]) and not got.errors


def test_profiles_of_many(spark, write):
    rows = profile_files(spark, [write("a.csv", "a,b\n1,2\n"), "/no/such/file.csv"]).orderBy("ord").collect()
    assert rows[0].profile.detected_kind == "csv" and rows[0].headers == ["a", "b"] and rows[0].error is None and rows[1].profile is None and rows[1].error
    assert {(r.kind, r.files, r.errors) for r in profile_summary(profile_files(spark, [write("a.csv", "a,b\n1,2\n"), "/no/such"])).collect()} == {("CSV", 1, 0), ("Error", 1, 1)}


def test_export(spark, write, tmp_path):
    assert export.encode_row(["p", "q,r", "s"]) == 'p,"q,r",s\n' and export.encode_row(['she "won"']) == '"she ""won"""\n'
    v = Document.open(spark, write("x.csv", "bird,n\nauk,1\nteal,2\ncoot,3\n")).view
    out, told = str(tmp_path / "out.csv"), []
    assert export.export_file(v.sort(SortKey(1, True)).filter("u"), out, progress=told.append) == 1 and told == [1]
    assert export.export_file(v.sort(SortKey(1, True)).filter("t"), out) == 2
    assert open(out).read() == "bird,n\ncoot,3\nteal,2\n"
    assert export.export_file(v, out, [1, 0, 0]) == 3 and open(out).readline() == "n,bird,bird\n"
    assert export.export_file(v, out, cancelled=lambda: True) == -1 and not [f for f in os.listdir(tmp_path) if f.endswith("-tmp")]
    for bad in ([], [5]):
        with pytest.raises(DelimitedError):
            export.export_file(v, out, bad)
    odd = 'a,b\n"x,1","she ""won""\nhere"\n  lead,é\n'
    w = Document.open(spark, write("odd.csv", odd))
    export.export_file(w.view, out)
    again = Document.open(spark, out)
    assert [r.cells for r in again.view.base.collect()] == [r.cells for r in w.view.base.collect()]
    for view in (v.sort(SortKey(0)), v.filter("t"), v.filter("zzz")):
        folder = str(tmp_path / f"many{len(os.listdir(tmp_path))}")
        export.export_folder(view, folder)
        parts = sorted(f for f in os.listdir(folder) if f.startswith("part-"))
        export.export_file(view, out)
        assert "".join(open(os.path.join(folder, f)).read() for f in parts) == open(out).read()
    assert [export.suggested_name("/a/b.tsv", f, k) for f, k in ((False, ()), (True, ()), (True, (SortKey(0, True),)), (False, (SortKey(0), SortKey(1))))] == ["b-export.csv", "b-filtered.csv", "b-filtered-sorted-desc.csv", "b-sorted.csv"]


def messy(r, rows):
    """Delimited text with quoted line feeds, doubled quotes, ragged rows and all line ends."""
    cell = lambda: r.choice(["", "a", "bb", "é漢", '"x\n1"', '"say ""so"""', '"\n\n,"', "  lead", '"end" ', "0" * r.randint(0, 30)])
    return "".join(",".join(cell() for _ in range(r.randint(1, 5))) + r.choice(["\n", "\n", "\r\n", "\r\r\n", "\r"]) for _ in range(rows))


@pytest.mark.parametrize("encoding", ["utf-8", "utf-16-le"])
def test_ranges_read_what_the_whole_has(tmp_path, encoding):
    """Every range by itself, wherever files are cut: the same rows and numbers as from the start."""
    r = random.Random(9)
    for i in range(60):
        text = "h,i,j\n" + messy(r, r.randint(0, 25)) + r.choice(["", "last", '"open\nend', '"q"'])
        path = str(tmp_path / f"{encoding}{i}.csv")
        mark = {"utf-8": b"", "utf-16-le": b"\xff\xfe"}[encoding]
        with open(path, "wb") as f:
            f.write(mark + text.encode(encoding))
        d = Dialect(",", encoding, len(mark))
        want = [x for x in tokenize.parse(text)]
        for size in (2, 14, 60, 1000):
            ranges = delimited.plan([(0, path, d)], size)
            known, (total, _) = delimited.joined(ranges, [delimited.measure(x) for x in ranges])
            assert total == len(want), (text, size)
            got = [(x.first + n, row) for x in known for n, row in enumerate(y for a in delimited.read_range(x) for y in a.to_pylist())]
            assert got == list(enumerate(want)), (text, size)
            assert [x.rows for x in known] == [sum(len(a) for a in delimited.read_range(x)) for x in known]


def test_pages_read_one_range(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(delimited, "RANGE_BYTES", 4000)
    path = str(tmp_path / "big.csv")
    with open(path, "w") as f:
        f.write("id,word\n" + "".join(f'{i},"w\n{i}"\n' for i in range(4000)))
    d = Document.open(spark, path)
    assert len(d.ranges) > 10 and d.row_count() == 4000 == d.view.count()
    page = d.view.page(2500, 20)
    assert [(r.row_idx, r.c0, r.c1) for r in page.collect()] == [(i, str(i), f"w\n{i}") for i in range(2500, 2520)]
    assert page.rdd.getNumPartitions() <= 2 and d.view._runs([(2500, 2519)]).rdd.getNumPartitions() <= 2
    assert [r.c0 for r in d.view.page_by_ids([3999, 0]).collect()] == ["3999", "0"]
    ranked = d.view.sort(SortKey(0, True)).ranked()
    assert [r.row_idx for r in ranked.orderBy("visible_pos").limit(2).collect()] == [3999, 3998]


def test_sorting_never_uses_one_partition(spark):
    n = 400_000
    v = table_view(spark.range(n).select(F.col("id").alias("k"), F.expr("pmod(hash(id), 1000)").alias("x")).repartition(8), "k", dense=True)
    seen = []
    real = view_module.written
    view_module.written = lambda df, name: seen.append(df) or real(df, name)
    try:
        got = v.sort(SortKey(1, True), SortKey(0)).ranked()
    finally:
        view_module.written = real
    plans = [x._jdf.queryExecution().executedPlan().toString() for x in (got, *seen)]
    assert not any("SinglePartition" in p for p in plans) and "rangepartitioning" in plans[1]
    rows = got.join(v.base, "row_idx").selectExpr("visible_pos", "cast(c1 as int) x", "row_idx").orderBy("visible_pos").collect()
    assert [r.visible_pos for r in rows] == list(range(1, n + 1))
    assert all((a.x, -a.row_idx) >= (b.x, -b.row_idx) for a, b in zip(rows, rows[1:], strict=False))


def test_tables_with_gaps_and_without_keys(spark, tmp_path):
    v = table_view(spark.createDataFrame([(0, "a"), (10, "b"), (20, "c")], "k long, t string"), "k")
    assert [r.row_idx for r in v.page(1, 1).collect()] == [10] and v.locate(20).first().visible_pos == 3
    folder = str(tmp_path / "parts")
    spark.range(10).selectExpr("id % 3 as same", "cast(id as string) as t").repartition(3).write.parquet(folder)
    w = table_view(spark.read.parquet(folder))
    assert sorted(r.row_idx for r in w.base.collect()) == list(range(10)) and w.page(4, 3).count() == 3
    odd = [0.001, 1e20, 2.5, -0.0, 12.34, float("nan"), None]
    cells = [r.c0 for r in table_view(spark.createDataFrame([(x, i) for i, x in enumerate(odd)], "d double, k long"), "k").base.orderBy("row_idx").collect()]
    assert cells == ["0.001", "1.0E20", "2.50", "0.00", "12.34", "NaN", ""]


def test_filters_skip_what_can_not_match(spark):
    v = table_view(spark.createDataFrame([(0, 199, "x"), (1, 2, "y199"), (2, 3, "İ199é")], "k long, n int, t string"), "k", dense=True)
    assert ids(v.filter("199").rows()) == [0, 1, 2] and ids(v.filter("Y19").rows()) == [1]
    assert "c1" not in str(v.filter("y19").predicate) and "lower" not in str(v.filter("199").predicate)


def test_page_cache(spark, write):
    v = Document.open(spark, write("c.csv", "i,t\n" + "".join(f"{i},x\n" for i in range(1500)))).view
    asked = []

    class Counting:
        def __init__(self, inner):
            self.inner = inner

        def page(self, start, count):
            asked.append(start)
            return self.inner.page(start, count)

    cache = PageCache(Counting(v))
    assert [r.row_idx for r in cache.rows(250, 20)] == list(range(250, 270)) and sorted(asked) == [0, 256]
    assert [r.row_idx for r in cache.rows(500, 20, 1)] == list(range(500, 520)) and cache.rows(1490, 200)[-1].row_idx == 1499
    cache.rows(768, 10)
    assert len(asked) == len(set(asked))  # nothing twice, what was read ahead included
    assert cache.rows(-5, 3)[0].row_idx == 0 and cache.rows(0, 0) == [] and cache.rows(9000, 5) == []
    cache.reset(Counting(v.sort(SortKey(0, True))))
    assert cache.rows(0, 2)[0].row_idx == 1499
    cache.close()


def test_progressive_open(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "p.csv")
    with open(path, "w") as f:
        f.write("id,t\n" + "".join(f"{i},word {i}\n" for i in range(3000)))
    doc = ProgressiveDocument(spark, path, range_bytes=5000, step=3)
    s = doc.status()
    assert 0 < s.row_count < 3000 and not s.is_complete and 0 < s.indexed_bytes < s.file_size and s.error is None
    assert [r.c0 for r in doc.page(0, 3).collect()] == ["0", "1", "2"] and doc.page(2990, 5).count() == 0
    with pytest.raises(DelimitedError):
        doc.view.sort(SortKey(0))
    s = doc.run()
    assert s.is_complete and s.row_count == 3000 and s.indexed_bytes == s.file_size
    assert ids(doc.view.filter("word 2999").rows()) == [2999]
    # a range that can't be read ends the indexing; the prefix stays readable
    doc = ProgressiveDocument(spark, path, range_bytes=5000, step=3)
    had = doc.status().row_count
    monkeypatch.setattr(delimited, "measured", lambda *a: (_ for _ in ()).throw(OSError("disk gone")))
    s = doc.run()
    assert s.error == "disk gone" and s.is_complete and s.row_count == had and ids(doc.page(0, 2)) == [0, 1] == ids(doc.view.page(0, 2))


def test_sort_key_clicks():
    k = export.next_sort_keys
    one = k((), 2)
    assert one == (SortKey(2),) and k(one, 2) == (SortKey(2, True),) and k(k(one, 2), 2) == ()
    two = k(one, 0, True)
    assert two == (SortKey(2), SortKey(0)) and k(two, 2, True) == (SortKey(2, True), SortKey(0)) and k(k(two, 2, True), 2, True) == (SortKey(0),)


def streamed(spark, path, name, want, complete=False, before_end=lambda: None):
    q = progressive.stream(spark, path, complete).writeStream.format("memory").queryName(name).trigger(processingTime="0 seconds").start()
    try:
        for _ in range(60):
            q.processAllAvailable()
            if spark.table(name).count() >= want:
                break
        before_end()
        q.processAllAvailable()
        return sorted((r.row_idx, *r.cells) for r in spark.table(name).collect())
    finally:
        q.stop()


def test_stream(spark, write):
    n = 5000
    path = write("s.csv", "i,t\n" + "".join(f'{i},"x\n{i}"\n' for i in range(n)))
    assert streamed(spark, path, "whole", n) == [(i, str(i), f"x\n{i}") for i in range(n)]


def test_stream_holds_back_a_torn_row(spark, write):
    path = write("t.csv", "i,t\n1,x\n2,y")

    def grow():
        with open(path, "a") as f:
            f.write('yy\n3,"open\n')

    assert streamed(spark, path, "torn", 1, before_end=grow) == [(0, "1", "x"), (1, "2", "yyy")]
    assert streamed(spark, path, "done", 3, complete=True) == [(0, "1", "x"), (1, "2", "yyy"), (2, "3", "open\n")]
    wide = write("w.csv", b"\xff\xfe" + "i,t\n1,漢\n2,y".encode("utf-16-le"))
    assert streamed(spark, wide, "wide", 1) == [(0, "1", "漢")]
    broken = write("b.csv", b"i,t\n1,\xff\xfe\n2,ok\n")
    assert streamed(spark, broken, "broken", 2) == [(0, "1", "\ufffd\ufffd"), (1, "2", "ok")]


def test_jobs(spark):
    job = Job(spark, "sort")
    assert job.run(lambda: spark.range(5).count()) == 5 and not job.status["running"]
    assert job.run(lambda: job.cancel() or 1) is None
    assert progress(1, 4) == 0.25 and progress(0, 0) == 1.0
