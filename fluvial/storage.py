"""Materialised intermediate tables for iterative operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Largest files of an intermediate table that a join may broadcast without being asked to.
MERGED_BYTES = 256 * 1024


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a temporary folder serves a local master, where driver
    and executors are one process; any other master raises, since executors
    would write to their own disks.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if not current:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="fluvial-ckpt-"))
        current = sc.getCheckpointDir()
    return current.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of any file system that Spark reaches."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of all files below a path of any file system that Spark reaches."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(target).getLength()


def _written(df: DataFrame, path: str) -> DataFrame:
    """``df`` written to ``path`` and read back.

    The optimizer takes a table for as large as its files, which hold numbers
    in a few bits, so it would send tables of millions of rows through the
    driver to broadcast them. Only tables of few bytes are left to it; others
    ask for a merge, unless a join's own hint says otherwise.
    """
    df.write.parquet(path)
    spark = df.sparkSession
    back = spark.read.schema(df.schema).parquet(path)
    return back.hint("merge") if stored_bytes(spark, path) > MERGED_BYTES else back


def cut(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that plans stay short and survive lost executors."""
    return _written(df, scratch_path(df.sparkSession, label))


class Workspace:
    """Tables that one operator writes to the shared folder and deletes when it is done with them.

    A table may be dropped once everything that reads it has itself been
    written: then no lost executor can make Spark read it again.
    """

    def __init__(self, spark: SparkSession, label: str) -> None:
        self._spark, self._label, self._paths = spark, label, {}

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        """Write ``df`` and read it back."""
        path = scratch_path(self._spark, f"{self._label}-{label}")
        back = _written(df, path)
        self._paths[id(back)] = (back, path)
        return back

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables of this workspace; others are left alone."""
        for df in tables:
            _, path = self._paths.pop(id(df), (None, None))
            if path:
                delete_path(self._spark, path)

    def clear(self, *kept: DataFrame) -> None:
        """Delete all tables but ``kept``, which now live as long as the shared folder."""
        for df in kept:
            self._paths.pop(id(df), None)
        self.drop(*[df for df, _ in list(self._paths.values())])
