"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_kept, keep


#: Edges that one task may unite: 16 bytes each as read, some 200 while they are united.
ONE_TASK = 1_000_000


def _some(df: DataFrame) -> bool:
    return df.limit(1).count() > 0


def _roots(edges: DataFrame) -> DataFrame:
    """(node, root) for each larger end of edges (x < y): follow the smallest smaller neighbour, doubling the way each time."""
    to = keep(edges.groupBy(F.col("y").alias("node")).agg(F.min("x").alias("root")), "roots")
    while True:
        on = to.select(F.col("node").alias("root"), F.col("root").alias("on"))
        new = keep(to.join(on, "root", "left").select("node", F.coalesce("on", "root").alias("root"), F.col("on").isNotNull().alias("moved")), "roots")
        moved = _some(new.where("moved"))
        drop_kept(to)
        to = new
        if not moved:
            return to


def united(x: list[int], y: list[int]) -> dict[int, int]:
    """The smallest node reachable from each node of some edges."""
    up = {}

    def root(n):
        while (above := up.setdefault(n, n)) != n:
            up[n] = up[above]
            n = above
        return n

    for a, b in zip(x, y, strict=True):
        p, q = root(a), root(b)
        if p != q:
            up[max(p, q)] = min(p, q)
    return {n: root(n) for n in list(up)}


def _in_one_task(edges: DataFrame) -> DataFrame:
    """(node, root) of a bounded number of edges."""

    def run(batches):
        import pyarrow as pa

        x, y = [], []
        for b in batches:
            x += b.column("x").to_pylist()
            y += b.column("y").to_pylist()
        roots = united(x, y)
        yield pa.RecordBatch.from_arrays([pa.array(list(roots), pa.int64()), pa.array(list(roots.values()), pa.int64())], names=["node", "root"])

    return edges.select("x", "y").coalesce(1).mapInArrow(run, "node long, root long")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): the smallest node reachable from each node of ``edges``. Nulls and loops are ignored.

    In each round every node follows its smallest smaller neighbour to the end, and the
    edges are contracted to those between such ends; few are left after the first round.
    Once no more than ONE_TASK edges are left, one task on an executor unites them. Each
    round's tables are written to the shared folder; nothing is collected.
    """
    ends = (F.least(a, b).alias("x"), F.greatest(a, b).alias("y"))
    left = keep(edges.where(f"{a} != {b}").select(*ends).distinct(), "edges")
    labels, n = None, left.count()
    while n > ONE_TASK:
        if labels is None:
            labels = keep(left.select(F.col("x").alias("node")).union(left.select("y")).distinct().select("node", F.col("node").alias("label")), "labels")
        to = _roots(left)
        new = keep(labels.join(to.select(F.col("node").alias("label"), "root"), "label", "left").select("node", F.coalesce("root", "label").alias("label")), "labels")
        by_y = left.join(to.select(F.col("node").alias("y"), F.col("root").alias("ry")), "y")
        both = by_y.join(to.select(F.col("node").alias("x"), F.col("root").alias("rx")), "x", "left").select(F.coalesce("rx", "x").alias("p"), F.col("ry").alias("q"))
        fewer = keep(both.where("p != q").select(F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y")).distinct(), "edges")
        drop_kept(to, labels, left)
        labels, left = new, fewer
        n = left.count()
    if labels is None:
        out = keep(_in_one_task(left).withColumnRenamed("root", "label"), "labels")
        drop_kept(left)
        return out
    if n:
        to = keep(_in_one_task(left), "roots")
        new = keep(labels.join(to.select(F.col("node").alias("label"), "root"), "label", "left").select("node", F.coalesce("root", "label").alias("label")), "labels")
        drop_kept(to, labels)
        labels = new
    drop_kept(left)
    return labels
