"""What a table consists of, published at once.

A table's folders are written under names of their own and take effect when a manifest that names them is renamed into place; readers look at the newest manifest
alone. So a write that ends anywhere before the rename changes nothing, and what it left is removed by the next one. A table has one writer at a time.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

KEPT = 3


class Manifest:
    """The numbered manifests of a table under ``root``; Spark's readers skip their folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.folder = spark, f"{root.rstrip('/')}/_manifest"

    def _path(self, name: str = ""):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def _fs(self):
        return self._path().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self) -> list[str]:
        fs = self._fs()
        found = [f.getPath().getName() for f in fs.listStatus(self._path())] if fs.exists(self._path()) else []
        return sorted(n for n in found if n.endswith(".json"))

    def read(self) -> dict:
        """The newest manifest's content; empty where none was published."""
        names = self._names()
        if not names:
            return {}
        stream = self._fs().open(self._path(names[-1]))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def publish(self, content: dict) -> None:
        """Makes ``content`` the newest manifest. Older ones than the last few go."""
        fs, names = self._fs(), self._names()
        number = int(names[-1].split(".")[0]) + 1 if names else 0
        temporary, final = self._path(f"{number:012d}.writing"), self._path(f"{number:012d}.json")
        out = fs.create(temporary, True)
        out.write(bytearray(json.dumps(content, sort_keys=True).encode()))
        out.close()
        if not fs.rename(temporary, final):
            raise OSError(f"{final} could not be published")
        for name in names[: 1 - KEPT]:
            fs.delete(self._path(name), False)
