"""Where the engine keeps tables of its own: the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_DIR = "spark.checkpoint.dir"
_STORED: dict[tuple[str, ...], tuple[str, object]] = {}


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``; where the session names none and runs on this machine alone (tests), under a temporary folder."""
    root = spark.conf.get(_DIR, None) or spark.sparkContext.getConf().get(_DIR)
    if not root:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"set {_DIR} to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="tidemill-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def stored(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table ``name`` made from a data folder: written once a session, then read."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORED:
        path = shared_path(spark, name)
        df = build()
        df.write.parquet(path)
        _STORED[key] = (path, df.schema)
    path, schema = _STORED[key]
    return spark.read.schema(schema).parquet(path)
