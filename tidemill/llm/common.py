"""Shared plumbing of the training-data operators: tables, durable cuts, scratch folders."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_DIR = "spark.checkpoint.dir"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder, read only through Spark."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where the session names none, a temporary folder is set once if Spark runs on this machine alone, as in tests.
    """
    context = spark.sparkContext
    named = spark.conf.get(_DIR, None) or context.getConf().get(_DIR)
    current = context._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not named and context.master != "local" and not context.master.startswith("local["):
            raise ValueError(f"set {_DIR} to a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidemill-"))
        current = context._jsc.sc().getCheckpointDir()
    return named or current.get()


def fresh(columns: list[str], name: str) -> str:
    """``name``, with underscores in front until no column is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside go when it ends; else they stay until the driver happens to collect its garbage."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    with _shuffles_dropped(df.sparkSession):
        return df.checkpoint(eager=True)


class Scratch:
    """Parquet tables in the shared folder that live as long as one operator call, or the ``with`` block around it.

    ``keep`` writes a frame and reads it back, which cuts lineage and survives lost executors; ``drop`` deletes one that has no
    reader left, ``close`` everything written, after the operator's result has been cut itself.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/tables-{uuid.uuid4().hex}"
        self.count = 0
        self.paths: dict[int, str] = {}

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *error: object) -> None:
        self.close()

    def keep(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        with _shuffles_dropped(self.spark):
            df.write.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(kept)] = path
        return kept

    def drop(self, kept: DataFrame) -> None:
        self._delete(self.paths.pop(id(kept)))

    def close(self) -> None:
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
