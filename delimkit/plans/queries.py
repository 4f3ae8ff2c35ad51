"""Queries of the engine's operators over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr
from ..model import SortKey
from ..operators import export, search
from ..operators.document import Document, profile_files, profile_summary
from ..operators.view import View
from ..session import shared_dir
from ..sources import delimited, sniff
from ..sources.tables import table_view

# The tables' columns, the kind of each (i whole number, d double, t timestamp, s text), and the key, which counts from 0 ("": rows count by their place).
TABLES = {
    "nation": ("n_nationkey", "n_nationkey i, n_name s, n_regionkey i"),
    "customer": ("c_custkey", "c_custkey i, c_name s, c_nationkey i, c_acctbal d, c_mktsegment s"),
    "supplier": ("s_suppkey", "s_suppkey i, s_name s, s_nationkey i, s_acctbal d"),
    "part": ("p_partkey", "p_partkey i, p_name s, p_brand s, p_type s, p_size i, p_retailprice d"),
    "orders": ("o_orderkey", "o_orderkey i, o_custkey i, o_orderstatus s, o_totalprice d, o_orderdate t, o_orderpriority s"),
    "lineitem": ("", "l_orderkey i, l_partkey i, l_suppkey i, l_linenumber i, l_quantity d, l_extendedprice d, l_discount d, l_tax d, l_returnflag s, l_linestatus s, l_shipdate t"),
    "events": ("event_id", "event_id i, ts t, user_id i, event_type s, value d, props s"),
    "documents": ("doc_id", "doc_id i, text s, lang s, source s, n_chars i"),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> View:
    columns = [c.split()[0] for c in TABLES[name][1].split(", ")]
    return table_view(spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns), TABLES[name][0] or None, dense=True)


def sql_cells(name: str) -> list[str]:
    made = {"i": "{}::VARCHAR", "d": "({}::DECIMAL(18,2))::VARCHAR", "t": "strftime({}, '%Y-%m-%d %H:%M:%S')", "s": "{}"}
    return [f"coalesce({made[k].format(c)}, '')" for c, k in (x.split() for x in TABLES[name][1].split(", "))]


def sql_base(name: str, extra: str = "") -> str:
    cells = ", ".join(f"{c} AS c{i}" for i, c in enumerate(sql_cells(name)))
    key = f"{TABLES[name][0]}::BIGINT" if TABLES[name][0] else "row_number() OVER () - 1"
    return f"SELECT {key} AS row_idx, {cells}{extra} FROM {name}"


def sql_any(name: str, needle: str) -> str:
    return "(" + " OR ".join(f"contains(lower(c{i}), '{needle}')" for i in range(len(sql_cells(name)))) + ")"


def _width(name: str) -> int:
    return len(sql_cells(name))


def _all(name: str) -> str:
    return ", ".join(f"c{i}" for i in range(_width(name)))


SEARCHED = ["customer", "supplier", "part", "nation"]


def _matches(spark, sf_dir, query="er"):
    return search.matches([(n, view(spark, sf_dir, n)) for n in SEARCHED], query).drop("row_values")


def _sql_matches(needle: str) -> str:
    parts = []
    for o, n in enumerate(SEARCHED):
        for i, c in enumerate(TABLES[n][1].split(", ")):
            parts.append(f"SELECT {o} AS file_ord, '{n}' AS path, row_idx + 1 AS row_index, {i} AS column_index, '{c.split()[0]}' AS column_name, c{i} AS value FROM ({sql_base(n)}) WHERE contains(lower(c{i}), '{needle}')")
    return " UNION ALL ".join(parts)


QUERIES = {}
ORACLE_SQL = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(f"SELECT row_idx, {_all('orders')} FROM ({sql_base('orders')}) WHERE {sql_any('orders', 'urgent')}")
def filter_any_cell_orders(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, "orders").filter("  Urgent ").filtered()


@query(f"SELECT row_idx, {_all('events')} FROM ({sql_base('events')}) WHERE {sql_any('events', 'purchase')}")
def filter_any_cell_events(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, "events").filter("PURCHASE").filtered()


@query(f"SELECT row_idx FROM ({sql_base('documents')}) WHERE {sql_any('documents', 'é')}")
def filter_unicode_documents(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, "documents").filter("É").filtered().select("row_idx")


@query(f"SELECT row_idx, {_all('part')} FROM ({sql_base('part')}) WHERE false")
def filter_no_match(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, "part").filter("zzz no such cell zzz").filtered()


@query(f"SELECT row_idx, {_all('part')} FROM ({sql_base('part')})")
def filter_empty_query(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, "part").filter(" \t ").filtered()


@query(f"SELECT row_idx, {_all('part')} FROM ({sql_base('part')})")
def filter_cleared(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, "part").filter("steel").clear_filter().sort(SortKey(1)).clear_sort().filtered()


@query(f"SELECT count(*) AS rows_scanned, count(*) FILTER (WHERE {sql_any('lineitem', '199')}) AS matched_rows, count(*) AS total_rows FROM ({sql_base('lineitem')})")
def filter_counts(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, "lineitem").filter("199").counts()


def _placed(v: View) -> DataFrame:
    return v.ranked()


def _sql_placed(name: str, order: str, where: str = "true") -> str:
    return f"SELECT row_idx, (row_number() OVER (ORDER BY {order}, row_idx))::INTEGER AS visible_pos FROM ({sql_base(name)}) WHERE {where}"


_FOLD = "translate(trim({}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(_sql_placed("part", _FOLD.format("c1")))
def sort_text_asc(spark, sf_dir) -> DataFrame:
    return _placed(view(spark, sf_dir, "part").sort(SortKey(1)))


@query(_sql_placed("part", _FOLD.format("c2") + " DESC"))
def sort_text_desc(spark, sf_dir) -> DataFrame:
    return _placed(view(spark, sf_dir, "part").sort(SortKey(2, True)))


@query(_sql_placed("customer", "c3::DOUBLE DESC"))
def sort_numeric_desc(spark, sf_dir) -> DataFrame:
    return _placed(view(spark, sf_dir, "customer").sort(SortKey(3, True)))


@query(_sql_placed("customer", _FOLD.format("c4") + " DESC, c3::DOUBLE ASC"))
def sort_multi_mixed(spark, sf_dir) -> DataFrame:
    return _placed(view(spark, sf_dir, "customer").sort(SortKey(4, True), SortKey(3)))


def _derived(spark, sf_dir, odd: str) -> View:
    """Customers with some balances replaced: every seventh by ``odd``, every fifth by an empty cell."""
    v = view(spark, sf_dir, "customer")
    cell = F.when(F.col("row_idx") % 7 == 0, F.lit(odd)).when(F.col("row_idx") % 5 == 0, F.lit("")).otherwise(F.col("c3"))
    return View(v.base.withColumn("c3", cell), v.headers, v.cells)


def _sql_derived(odd: str, order: str) -> str:
    cell = f"CASE WHEN row_idx % 7 = 0 THEN '{odd}' WHEN row_idx % 5 = 0 THEN '' ELSE c3 END"
    return f"SELECT row_idx, (row_number() OVER (ORDER BY {order}, row_idx))::INTEGER AS visible_pos FROM (SELECT row_idx, {cell} AS v FROM ({sql_base('customer')}))"


@query(_sql_derived("", "CASE WHEN v = '' THEN 1 ELSE 0 END, TRY_CAST(v AS DOUBLE)"))
def sort_with_empties(spark, sf_dir) -> DataFrame:
    return _placed(_derived(spark, sf_dir, "").sort(SortKey(3)))


@query(_sql_derived("", "CASE WHEN v = '' THEN 1 ELSE 0 END DESC, TRY_CAST(v AS DOUBLE) DESC"))
def sort_with_empties_desc(spark, sf_dir) -> DataFrame:
    return _placed(_derived(spark, sf_dir, "").sort(SortKey(3, True)))


@query(_sql_derived("n/a", "CASE WHEN v = '' THEN 2 WHEN v = 'n/a' THEN 1 ELSE 0 END, TRY_CAST(v AS DOUBLE)"))
def sort_mostly_numeric(spark, sf_dir) -> DataFrame:
    return _placed(_derived(spark, sf_dir, "n/a").sort(SortKey(3)))


_MODE_CELLS = {"customer": [1, 3, 4], "part": [1, 2, 4, 5], "orders": [2, 3, 4, 5]}


@query(" UNION ALL ".join(f"SELECT '{n}' AS tab, {c} AS column_index, coalesce(count(*) FILTER (WHERE TRY_CAST(trim(c{c}) AS DOUBLE) IS NOT NULL) >= 0.8 * nullif(count(*) FILTER (WHERE trim(c{c}) <> ''), 0), false) AS is_numeric FROM ({sql_base(n)}) WHERE row_idx < 2000" for n, cs in _MODE_CELLS.items() for c in cs))
def sort_mode_detect(spark, sf_dir) -> DataFrame:
    rows = [(n, c, bool(m)) for n, cs in _MODE_CELLS.items() for c, m in view(spark, sf_dir, n).modes(cs).items()]
    return spark.createDataFrame(rows, "tab string, column_index int, is_numeric boolean")


@query(f"SELECT row_idx, {_all('orders')} FROM ({sql_base('orders')}) WHERE row_idx BETWEEN 100 AND 299")
def page_natural(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, "orders").page(100, 200)


_ORDERS_SORT = (SortKey(3, True), SortKey(0))


@query(f"SELECT row_idx, {_all('orders')} FROM ({sql_base('orders')}) ORDER BY c3::DOUBLE DESC, row_idx LIMIT 64 OFFSET 32")
def page_sorted(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, "orders").sort(SortKey(3, True)).page(32, 64)


@query(f"SELECT row_idx, {_all('orders')} FROM ({sql_base('orders')}) WHERE {sql_any('orders', 'urgent')} ORDER BY row_idx LIMIT 64 OFFSET 10")
def page_filtered(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, "orders").filter("urgent").page(10, 64)


@query(f"SELECT row_idx, {_all('orders')} FROM ({sql_base('orders')}) WHERE {sql_any('orders', 'urgent')} ORDER BY c3::DOUBLE DESC, c0::BIGINT, row_idx LIMIT 50")
def page_filtered_sorted(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, "orders").filter("urgent").sort(*_ORDERS_SORT).page(0, 50)


@query(f"SELECT row_idx, {_all('nation')} FROM ({sql_base('nation')}) WHERE false")
def page_past_end(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, "nation").page(1000, 10)


@query(f"SELECT row_idx, c1 AS c0, c2 AS c1 FROM ({sql_base('nation')}) WHERE row_idx < 10")
def page_column_window(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, "nation").page(0, 10, 1, 5)


@query(f"SELECT pos::INTEGER AS pos, w.row_idx::BIGINT AS row_idx, coalesce(c0, '') AS c0, coalesce(c1, '') AS c1, coalesce(c2, '') AS c2, coalesce(c3, '') AS c3 FROM (VALUES (0, 7), (1, 3), (2, 7), (3, 999999999), (4, 0)) w(pos, row_idx) LEFT JOIN ({sql_base('supplier')}) s ON s.row_idx = w.row_idx")
def page_by_ids(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, "supplier").page_by_ids([7, 3, 7, 999_999_999, 0])


@query(f"SELECT row_idx, visible_pos::BIGINT AS visible_pos FROM (SELECT row_idx, row_number() OVER (ORDER BY c3::DOUBLE DESC, row_idx) AS visible_pos FROM ({sql_base('orders')}) WHERE {sql_any('orders', '1')}) WHERE row_idx = 101")
def locate_row(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, "orders").filter("1").sort(SortKey(3, True)).locate(101)


@query(f"SELECT row_idx, visible_pos::BIGINT AS visible_pos FROM (SELECT row_idx, row_number() OVER (ORDER BY row_idx) AS visible_pos FROM ({sql_base('orders')}) WHERE {sql_any('orders', '1')}) WHERE row_idx = 101")
def locate_row_natural(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, "orders").filter("1").locate(101)


@query(f"SELECT row_idx, c0, c2 AS c1, c4 AS c2, c5 AS c3, c6 AS c4, c7 AS c5, c8 AS c6, c9 AS c7, c10 AS c8 FROM ({sql_base('lineitem')})")
def hide_columns(spark, sf_dir) -> DataFrame:
    v = view(spark, sf_dir, "lineitem").hide(1).hide(3)
    return v.filtered().select("row_idx", *[v.cells[c].alias(f"c{i}") for i, c in enumerate(v.visible)])


@query(f"SELECT row_idx, c0 FROM ({sql_base('nation')})")
def hide_all_columns(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, "nation").hide_all().rows()


@query(f"SELECT row_idx, c2 AS c0, c0 AS c1, c0 AS c2 FROM ({sql_base('supplier')})")
def select_dup_columns(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, "supplier").select([2, 0, 0])


@query(_sql_matches("er"))
def search_multi_table(spark, sf_dir) -> DataFrame:
    return _matches(spark, sf_dir)


@query(f"SELECT * FROM ({_sql_matches('er')}) ORDER BY file_ord, row_index, column_index LIMIT 100")
def search_capped(spark, sf_dir) -> DataFrame:
    return search.capped(_matches(spark, sf_dir), 100)


@query(f"SELECT count(*) AS n_matches, count(*) = 100 AS truncated, max(file_ord) AS stop_ord FROM (SELECT * FROM ({_sql_matches('er')}) ORDER BY file_ord, row_index, column_index LIMIT 100)")
def search_truncated_flag(spark, sf_dir) -> DataFrame:
    got = search.search_views([(n, view(spark, sf_dir, n)) for n in SEARCHED], "er", 100)
    return spark.createDataFrame([(len(got.matches), got.truncated, got.searched_files - 1)], "n_matches long, truncated boolean, stop_ord int")


@query(f"SELECT path, count(*) AS n_matches FROM ({_sql_matches('er')}) GROUP BY path")
def search_per_file_counts(spark, sf_dir) -> DataFrame:
    return search.counts_per_file(_matches(spark, sf_dir))


# -- over files: a table's rows are written as delimited text in the shared folder, and read back


def file_of(spark: SparkSession, sf_dir: str, name: str, delimiter: str = ",") -> str:
    """The path of one new file with a header and a table's rows."""
    folder = f"{shared_dir(spark)}/files/{name}-{uuid.uuid4().hex}"
    export.export_folder(view(spark, sf_dir, name), folder, delimiter=delimiter, one_file=True)
    return next(p for p in sniff.listed(folder) if "/part-" in p)


def _files(spark: SparkSession, sf_dir: str, delimiters=",;\t|") -> list[tuple[str, str]]:
    return [(n, file_of(spark, sf_dir, n, d)) for n, d in zip(SEARCHED, delimiters, strict=True)]


def _named(df: DataFrame, files: list[tuple[str, str]]) -> DataFrame:
    """With the table's name for the path of its file."""
    names = df.sparkSession.createDataFrame(files, "table string, path string")
    return df.join(F.broadcast(names), "path").drop("path").withColumnRenamed("table", "path")


@query(f"SELECT row_idx, {_all('customer')} FROM ({sql_base('customer')})")
def file_rows(spark, sf_dir) -> DataFrame:
    doc = Document.open(spark, file_of(spark, sf_dir, "customer", ";"))
    return doc.view.base.select("row_idx", *[c.alias(f"c{i}") for i, c in enumerate(doc.view.cells)])


@query(f"SELECT row_idx, {_all('documents')} FROM ({sql_base('documents')})")
def file_rows_in_ranges(spark, sf_dir) -> DataFrame:
    """Texts with quotes and line ends, read in ranges of a few hundred KB."""
    path = file_of(spark, sf_dir, "documents")
    ranges = delimited.index(spark, [(path, sniff.profile_file(path)[1])], range_bytes=1 << 18)
    return delimited.read_ranges(spark, ranges).select("row_idx", *[F.get("cells", F.lit(i)).alias(f"c{i}") for i in range(_width("documents"))])


@query("SELECT 'orders' AS path, count(*) AS n_rows FROM orders UNION ALL SELECT 'documents', count(*) FROM documents")
def file_row_counts(spark, sf_dir) -> DataFrame:
    """Rows counted without building cells, in ranges."""
    out = []
    for n in ("orders", "documents"):
        path = file_of(spark, sf_dir, n)
        out.append((n, delimited.row_count(delimited.index(spark, [(path, sniff.profile_file(path)[1])], exact=True, range_bytes=1 << 18))))
    return spark.createDataFrame(out, "path string, n_rows long")


@query(f"SELECT row_idx, {_all('orders')} FROM ({sql_base('orders')}) WHERE row_idx BETWEEN 700 AND 799")
def file_page(spark, sf_dir) -> DataFrame:
    return Document.open(spark, file_of(spark, sf_dir, "orders", "|")).view.page(700, 100)


@query(f"SELECT row_idx, {_all('orders')} FROM ({sql_base('orders')}) WHERE {sql_any('orders', 'urgent')} ORDER BY c3::DOUBLE DESC, c0::BIGINT, row_idx LIMIT 50")
def file_page_filtered_sorted(spark, sf_dir) -> DataFrame:
    return Document.open(spark, file_of(spark, sf_dir, "orders", "\t")).view.filter("urgent").sort(*_ORDERS_SORT).page(0, 50)


@query(_sql_placed("customer", _FOLD.format("c4") + " DESC, c3::DOUBLE ASC"))
def file_sort(spark, sf_dir) -> DataFrame:
    return Document.open(spark, file_of(spark, sf_dir, "customer")).view.sort(SortKey(4, True), SortKey(3)).ranked()


def _sql_file_matches(needle: str) -> str:
    parts = []
    for o, n in enumerate(SEARCHED):
        whole = f"concat_ws('|', {_all(n)})"
        for i, c in enumerate(TABLES[n][1].split(", ")):
            parts.append(f"SELECT {o} AS file_ord, '{n}' AS path, row_idx + 1 AS row_index, {i} AS column_index, '{c.split()[0]}' AS column_name, c{i} AS value, {whole} AS row_values FROM ({sql_base(n)}) WHERE contains(lower(c{i}), '{needle}')")
    return " UNION ALL ".join(parts)


@query(f"SELECT * FROM ({_sql_file_matches('er')}) ORDER BY file_ord, row_index, column_index LIMIT 1500")
def search_files_capped(spark, sf_dir) -> DataFrame:
    files = _files(spark, sf_dir)
    names = {p: n for n, p in files}
    got = search.search_files(spark, [p for _, p in files], "ER", 1500)
    rows = [(m["file_ord"], names[m["path"]], m["row_index"], m["column_index"], m["column_name"], m["value"], "|".join(m["row_values"])) for m in got.matches]
    return spark.createDataFrame(rows, "file_ord int, path string, row_index long, column_index int, column_name string, value string, row_values string")


@query(" UNION ALL ".join(f"SELECT {o} AS file_ord, '{n}' AS path, '{'|'.join(c.split()[0] for c in TABLES[n][1].split(', '))}' AS headers" for o, n in enumerate(SEARCHED)))
def search_schemas(spark, sf_dir) -> DataFrame:
    files = _files(spark, sf_dir)
    got = search.schemas(profile_files(spark, [p for _, p in files]))
    return _named(got, files).select("file_ord", "path", F.array_join("headers", "|").alias("headers"))


@query(" UNION ALL ".join(f"SELECT '{n}' AS path, 'delimited_text' AS kind, '{d}' AS delimiter, 'utf-8' AS encoding, {_width(n)} AS likely_columns, least(count(*) + 1, 256)::BIGINT AS sampled_rows, 0 AS warnings FROM {n}" for n, d in zip(SEARCHED, ("comma", "semicolon", "tab", "pipe"), strict=True)))
def profile_files_written(spark, sf_dir) -> DataFrame:
    files = _files(spark, sf_dir)
    got = _named(profile_files(spark, [p for _, p in files]), files)
    return got.select("path", F.col("profile.detected_kind").alias("kind"), F.col("profile.delimiter_label").alias("delimiter"), "profile.encoding", F.col("profile.likely_columns").cast("int").alias("likely_columns"), "profile.sampled_rows", F.size("profile.warnings").alias("warnings"))


@query("SELECT 'Delimited text' AS kind, 4::BIGINT AS files, 0::BIGINT AS warnings, 0::BIGINT AS errors UNION ALL SELECT 'Error', 1, 0, 1")
def kind_rollup(spark, sf_dir) -> DataFrame:
    """Four written files, and one that isn't there."""
    return profile_summary(profile_files(spark, [*(p for _, p in _files(spark, sf_dir)), "/no/such/file.csv"]))


@query(" UNION ALL ".join(f"SELECT '{n}' AS path, {_width(n)} AS columns, count(*) AS n_rows FROM {n}" for n in SEARCHED))
def delimiter_column_counts(spark, sf_dir) -> DataFrame:
    """Rows of whole files by their number of cells."""
    files = _files(spark, sf_dir)
    rows = delimited.scan(spark, [(p, sniff.profile_file(p)[1]) for _, p in files])
    return _named(rows.groupBy("path", F.size("cells").alias("columns")).agg(F.count("*").alias("n_rows")), files)


@query(f"SELECT count(*) FILTER (WHERE contains(translate(c1, '{expr.UPPER}', '{expr.LOWER}'), 'the')) AS ascii_hits, count(*) FILTER (WHERE contains(lower(c1), 'ü')) AS unicode_hits FROM ({sql_base('documents')})")
def search_ascii_vs_unicode(spark, sf_dir) -> DataFrame:
    base = view(spark, sf_dir, "documents").base
    return base.agg(F.count_if(expr.contains_search(F.col("c1"), "THE")).alias("ascii_hits"), F.count_if(expr.contains_search(F.col("c1"), "Ü")).alias("unicode_hits"))


def _truncated(spark, sf_dir, limit: int) -> DataFrame:
    base = view(spark, sf_dir, "documents").base
    return base.select("row_idx", expr.truncate_utf8(F.col("c1"), limit).alias("shown"))


def _sql_truncated(limit: int) -> str:
    # the longest prefix of at most ``limit`` bytes: a character has one to four, so try the four that may fit
    return f"""WITH d AS (SELECT doc_id::BIGINT AS row_idx, coalesce(text, '') AS t FROM documents),
        n AS (SELECT row_idx, t, (SELECT max(k) FROM range({limit // 4}, {limit} + 1) r(k) WHERE k <= length(t) AND strlen(substr(t, 1, k::BIGINT)) <= {limit}) AS k FROM d WHERE strlen(t) > {limit})
        SELECT row_idx, t AS shown FROM d WHERE strlen(t) <= {limit} UNION ALL SELECT row_idx, substr(t, 1, k::BIGINT) || '…' FROM n"""


@query(_sql_truncated(512))
def truncate_512(spark, sf_dir) -> DataFrame:
    return _truncated(spark, sf_dir, 512)


@query(_sql_truncated(12_288))
def truncate_12288(spark, sf_dir) -> DataFrame:
    return _truncated(spark, sf_dir, 12_288)


def _sql_quote(c: str) -> str:
    return f"""CASE WHEN contains({c}, ',') OR contains({c}, '"') OR contains({c}, chr(10)) OR contains({c}, chr(13)) THEN '"' || replace({c}, '"', '""') || '"' ELSE {c} END"""


def _sql_export(name: str) -> str:
    return f"SELECT row_idx, concat_ws(',', {', '.join(_sql_quote(f'c{i}') for i in range(_width(name)))}) AS line FROM ({sql_base(name)})"


@query(_sql_export("part"))
def export_lines(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, "part").export_lines()


@query(f"SELECT row_idx, {_sql_quote('c1')} AS quoted FROM ({sql_base('documents')})")
def export_quote(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, "documents").base.select("row_idx", expr.csv_quote(F.col("c1")).alias("quoted"))


@query(f"SELECT row_idx, concat_ws(chr(9), c0, c1, c2) AS line FROM ({sql_base('nation')})")
def copy_row_tsv(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, "nation").copy_rows()
