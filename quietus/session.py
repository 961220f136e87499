"""Session helpers: where lineage is cut, and how a bounded value reaches every task."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a temporary one where that is unset and all runs on this machine (tests, local runs)."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if not named and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="quietus-"))
    if named:
        return named.rstrip("/")
    return context.getCheckpointDir().rstrip("/")


@contextmanager
def _batches(spark: SparkSession, rows: int | None) -> Iterator[None]:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if not rows or int(before) <= rows:
        yield
        return
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def cut(df: DataFrame, batch: int | None = None) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it from there: its lineage ends, and a lost executor costs no recomputation.

    ``batch`` is how many rows go to Python at once while ``df`` is computed: few, where rows hold whole texts, so that a task's memory stays small.
    """
    shared_dir(df.sparkSession)
    with _batches(df.sparkSession, batch):
        return df.checkpoint(eager=True)


def kept(df: DataFrame, name: str, batch: int | None = None, codec: str | None = None) -> DataFrame:
    """As ``cut``, in Parquet below the shared folder: compressed, and read by columns. For tables that are wide or large."""
    path = scratch(df.sparkSession, name)
    with _batches(df.sparkSession, batch):
        df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows with whole texts that go to Python at once.
TEXTS = 1000


def if_small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """``df``, marked to be broadcast if its counted rows (of a few short columns) are within a bound: the texts it is joined with then stay where they lie."""
    return F.broadcast(df) if df.count() <= most else df


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors where they would not find it: the driver's path came neither from PYTHONPATH nor from its working folder."""
    root = Path(__file__).resolve().parents[1]
    found = [Path.cwd(), *map(Path, filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep)))]
    application = spark.sparkContext.applicationId
    if any(p.resolve() == root for p in found) or application in _SHIPPED:
        return
    _SHIPPED.add(application)
    package = Path(tempfile.mkdtemp(prefix="quietus-")) / "quietus.zip"
    with zipfile.ZipFile(package, "w") as out:
        for file in sorted((root / "quietus").rglob("*.py")):
            out.write(file, file.relative_to(root))
    spark.sparkContext.addPyFile(str(package))


_SHIPPED: set[str] = set()
