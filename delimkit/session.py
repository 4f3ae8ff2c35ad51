"""Session helpers: package shipping, job tags, cancellation and status."""

from __future__ import annotations

import io
import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = os.path.dirname(os.path.abspath(__file__))


def ship(spark: SparkSession) -> None:
    """Send this package to the session's workers once, so that they can import it.

    Spark itself carries the file to each executor; no folder is shared for it.
    """
    sc = spark.sparkContext
    if getattr(sc, "_delimkit_shipped", False):
        return
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(_PACKAGE):
            for n in sorted(names):
                if n.endswith(".py"):
                    path = os.path.join(folder, n)
                    z.write(path, os.path.join("delimkit", os.path.relpath(path, _PACKAGE)))
    path = os.path.join(tempfile.mkdtemp(prefix="delimkit-ship-"), "delimkit_package.zip")
    with open(path, "wb") as f:
        f.write(data.getvalue())
    sc.addPyFile(path)
    sc._delimkit_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Where none is set, a folder of our own if driver and executors are one process, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = getattr(context, "_delimkit_folder", None)
        if base is None:
            base = context._delimkit_folder = tempfile.mkdtemp(prefix="delimkit-")
    return base.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back: its rows and their numbers are fixed, whatever executors are lost."""
    path = f"{shared_dir(df.sparkSession)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Job:
    """A kind of work of which only the newest run counts: starting one cancels and outdates the one before."""

    def __init__(self, spark: SparkSession, kind: str):
        self.spark, self.kind, self.epoch, self.status = spark, kind, 0, {"running": False, "error": None}

    def tag(self) -> str:
        return f"delimkit-{self.kind}-{self.epoch}"

    def run(self, action):
        """The action's result, or None if a newer run or a cancel came in between."""
        self.cancel()
        self.epoch += 1
        mine, tag = self.epoch, self.tag()
        self.spark.addTag(tag)
        self.status = {"running": True, "error": None}
        try:
            got = action()
        except Exception as e:
            if mine == self.epoch:
                self.status = {"running": False, "error": str(e)}
                raise
            return None
        finally:
            self.spark.removeTag(tag)
        if mine != self.epoch:
            return None
        self.status = {"running": False, "error": None}
        return got

    def cancel(self) -> None:
        """Interrupt the current run's Spark jobs; its result is never published."""
        if self.epoch:
            self.spark.interruptTag(self.tag())
        self.epoch += 1
        self.status = {"running": False, "error": None}


def progress(done: int, total: int) -> float:
    """Share of work done, between 0 and 1; an empty input is done."""
    return 1.0 if total <= 0 else min(1.0, max(0.0, done / total))
