"""Helpers shared by the operators: shared tables and text batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_dir

#: Bytes of text that one step of a worker handles at once; bounds a worker's memory.
SLICE_BYTES = 4 << 20
#: Rows (ids, terms, windows) that may be broadcast, and the bytes of their texts; larger sides are joined by a shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 32 << 20


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back.

    This cuts lineage in a way that outlives lost executors and fixes row ids once.
    """
    path = f"{shared_dir(df.sparkSession)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def drop_kept(*tables: DataFrame) -> None:
    """Delete tables that ``keep`` wrote and that nothing reads any more."""
    for t in tables:
        jvm = t.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(t._kept_at)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def id_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, under fixed names: further columns can't clash."""
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def give_back() -> None:
    """Return freed memory to the system: the driver and reused workers live on, and what they hold counts."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch where its texts pass ``limit`` bytes; a row is never cut."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


def map_texts(
    df: DataFrame,
    setup: Callable[[], Callable[[list], list]],
    fields: list[tuple[str, T.DataType]],
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = SLICE_BYTES,
) -> DataFrame:
    """Apply a worker function to slices of texts.

    ``setup()`` runs once in each task and returns a function from a list of texts (None
    for null) to one sequence (list, numpy or Arrow array) for each of ``fields``.
    """
    src = id_and_text(df, id_col, text_col)
    schema = T.StructType([src.schema["doc_id"], *(T.StructField(n, t) for n, t in fields)])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        step = setup()
        kinds = [to_arrow_type(t) for _, t in fields]
        names = ["doc_id", *(n for n, _ in fields)]
        for batch in batches:
            for part in slices(batch, limit=limit):
                made = step(part.column("text").to_pylist())
                arrays = [x if isinstance(x, pa.Array) else pa.array(x, type=k) for x, k in zip(made, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *arrays], names=names)
                del made, arrays
        del step
        give_back()

    return src.mapInArrow(run, schema)


def crc_bucket(column, parts: int):
    """crc32 of an id's text, modulo ``parts``: the rule that sets rows aside for testing."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % parts


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, parts: int, held: int, bound: int, how: str = "max", id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str, int]]:
    """At most ``bound`` training texts of each class, with their labels (0 or 1).

    Rows whose id is null, whose label is null or which fall into the held-out bucket are
    never used. Of several labels of one id ``how`` (min or max) counts. The rows are
    chosen by a hash of the id, so the sample is spread over the table and repeatable.
    ``id_col`` and ``text_col`` are columns of ``docs``; labels have theirs under doc_id.
    """
    one = (
        labels.select(F.col("doc_id").alias("doc_id"), F.col(label).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & (crc_bucket("doc_id", parts) != held))
        .groupBy("doc_id").agg(getattr(F, how)("y").alias("y"))
    )
    picked = None
    for y in (0, 1):
        some = one.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
        picked = some if picked is None else picked.unionByName(some)
    # at most 2 * bound ids: a proven size
    rows = (
        id_and_text(docs, id_col, text_col).join(F.broadcast(picked), "doc_id")
        .groupBy("doc_id").agg(F.max("text").alias("text"), F.max("y").alias("y"))
        .orderBy("doc_id").collect()
    )
    return [(r["text"] or "", int(r["y"])) for r in rows]


def few(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint if the rows are few and short enough to be sure of it; otherwise the plain table."""
    sizes = [F.octet_length(f.name) for f in df.schema if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    sizes += [F.octet_length(F.array_join(f.name, "")) for f in df.schema if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StringType)]
    size = sum((F.coalesce(x, F.lit(0)) for x in sizes), F.lit(0).cast("long"))
    n, total = df.limit(limit + 1).agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(df) if n <= limit and total <= BROADCAST_BYTES else df


def without(docs: DataFrame, id_col: str, text_col: str, find: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of ``docs``, all columns, but those that ``find`` names.

    ``find`` gets (doc_id, text) and returns the doc_ids of rows to drop. Its doc_id is a
    structure that orders rows by their id, nulls last, and is unique: rows that share an
    id, or have none, are written first and numbered. All other rows keep their place, so
    no text is shuffled or copied for them. Columns of any name may be in ``docs``. Kept
    tables that only ``find``'s result reads (its ``_reads``) go.
    """
    mark = uuid.uuid4().hex  # own columns can't clash with those of docs
    number, shared_id, gone_id, gone_n = (f"{name}_{mark}" for name in ("number", "shared", "gone", "gone_number"))
    shared = docs.groupBy(F.col(id_col).alias(shared_id)).agg(F.count("*").alias("n")).where((F.col("n") > 1) | F.col(shared_id).isNull()).select(shared_id)
    kept_shared = keep(shared, "shared")
    shared = few(kept_shared)
    meets = F.col(id_col).eqNullSafe(F.col(shared_id))
    plain = docs.join(shared, meets, "left_anti")
    odd = keep(docs.join(shared, meets, "left_semi").withColumn(number, F.monotonically_increasing_id()), "shared-rows")
    named = lambda df, n: df.select(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), n.cast("long").alias("n")).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = find(named(plain, F.lit(-1)).unionByName(named(odd, F.col(number))))
    gone = keep(found.select(F.col(found.columns[0]).alias("gone")), "gone")
    drop_kept(*getattr(found, "_reads", []))
    gone_plain = few(gone.where("gone.n < 0").select(F.col("gone.id").alias(gone_id)))
    gone_odd = few(gone.where("gone.n >= 0").select(F.col("gone.n").alias(gone_n)))
    left = plain.join(gone_plain, F.col(id_col) == F.col(gone_id), "left_anti")
    out = left.unionByName(odd.join(gone_odd, F.col(number) == F.col(gone_n), "left_anti").select(*docs.columns))
    # read when the result is: whoever writes the result deletes them then
    out._reads = [kept_shared, odd, gone]
    return out
