"""Tables written in the shared folder to cut lineage.

A written table survives the loss of executors, is columnar, and brings its real size to the planner, so
that later joins are planned from facts. The folder is the one named in spark.checkpoint.dir; only in local mode, where one
machine does all, it may be unset: a temporary folder is used then.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_open: weakref.WeakSet = weakref.WeakSet()


class Scratch:
    """A private folder under the shared folder; each table in it can be dropped by itself."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not root:
            if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
                raise ValueError("on a cluster spark.checkpoint.dir must name a folder that all executors share")
            root = "file://" + tempfile.mkdtemp(prefix="ledgerloom-")
        self.folder = f"{root.rstrip('/')}/ledgerloom-{uuid.uuid4().hex}"
        self._n = 0
        _open.add(self)

    def save(self, df: DataFrame) -> DataFrame:
        """Writes df and returns it as read from there; its `scratch_path` serves drop()."""
        self._n += 1
        path = f"{self.folder}/{self._n}"
        df.write.mode("overwrite").parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back.scratch_path = path
        return back

    def mark(self) -> int:
        """A point that release() goes back to."""
        return self._n

    def release(self, mark: int, *kept: DataFrame) -> None:
        """Deletes the tables saved since a mark, but for those that are still needed: what save() returned."""
        needed = {df.scratch_path for df in kept}
        for k in range(mark + 1, self._n + 1):
            if (path := f"{self.folder}/{k}") not in needed:
                self._delete(path)

    def drop(self, df: DataFrame) -> None:
        """Deletes a table that save() returned."""
        self._delete(df.scratch_path)

    def close(self) -> None:
        """Deletes the whole folder."""
        self._delete(self.folder)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _close_all() -> None:
    for scratch in list(_open):
        try:
            scratch.close()
        except Exception:  # the session may have ended before
            pass
