"""Tables that cut a plan: written to the folder that the cluster shares, and read back."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_within: ContextVar[list | None] = ContextVar("staged", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder of this application below the one that ``spark.checkpoint.dir`` names; it goes when the application ends.

    Where the setting is empty a local master gets a folder of its own; a cluster must name one, since
    executors don't see the driver's disk.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = _own.setdefault(context.applicationId, tempfile.mkdtemp(prefix="cueflow-"))
    path = f"{folder.rstrip('/')}/{context.applicationId}"
    if path not in _own:
        _own[path] = path
        at = context._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


class Staged:
    """A DataFrame written to the shared folder and read back; ``drop`` deletes its files."""

    def __init__(self, df: DataFrame, name: str):
        self._spark = df.sparkSession
        self.path = f"{shared_folder(self._spark)}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = self._spark.read.schema(df.schema).parquet(self.path)
        if (open_tables := _within.get()) is not None:
            open_tables.append(self)

    def drop(self) -> None:
        context = self._spark.sparkContext
        at = context._jvm.org.apache.hadoop.fs.Path(self.path)
        at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def dropped_after() -> Iterator[None]:
    """Tables that are staged within are deleted at the end; what comes out must not read them."""
    tables: list[Staged] = []
    token = _within.set(tables)
    try:
        yield
    finally:
        _within.reset(token)
        for t in tables:
            t.drop()


def staged(df: DataFrame, name: str) -> DataFrame:
    return Staged(df, name).df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by its keys over all cores.

    Without it a small table of long texts ends up in one partition, and all work on its texts in one task.
    """
    spark = df.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, *keys)


def bound_batches(spark: SparkSession, rows: int = 1024, size: int = 8 << 20) -> None:
    """Arrow batches of at most ``rows`` rows and about ``size`` bytes from here on in the session, or fewer where it asks for fewer.

    Spark reads the bounds when a plan runs, not when it is made. Its own bound of 10,000 rows lets batches of files grow with the files.
    """
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        held = spark.conf.get(name)
        now = 0 if held.startswith("-") else int(re.sub(r"\D", "", held) or 0)
        if now <= 0 or now > most:
            spark.conf.set(name, str(most))
