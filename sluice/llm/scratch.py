"""Tables written to the shared folder that the cluster names in ``spark.checkpoint.dir``.

A written table cuts the lineage and gives later stages exact sizes, so Spark itself decides whether one is small
enough to broadcast. Lost executors cost only the tasks that they were running: the files are in shared storage.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_root: list[str] = []

#: A Parquet writer holds its row group on the heap until it is full; with Spark's 128 MB, the eight writers of a 1 GB heap fill it. Pages stay below what the JVM keeps in regions of their own.
WRITTEN = {"compression": "zstd", "parquet.block.size": 8 << 20, "parquet.page.size": 256 << 10}


def shared_root(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a temporary folder only in local mode, where it is unset in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_root:
        _own_root.append("file://" + tempfile.mkdtemp(prefix="sluice-"))
    return _own_root[0]


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def delete(spark: SparkSession, path: str) -> None:
    fs, where = _file_system(spark, path)
    fs.delete(where, True)


def _delete_at_exit(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone already
        delete(spark, path)


def read_text(spark: SparkSession, path: str) -> str | None:
    """The content of a small file in the shared store, or None."""
    fs, where = _file_system(spark, path)
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file to the shared store; readers see the old or the new content."""
    fs, where = _file_system(spark, path + ".new")
    stream = fs.create(where, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    final = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not fs.rename(where, final):  # stores that don't rename onto a file
        fs.delete(final, False)
        fs.rename(where, final)


class Scratch:
    """Written intermediate tables of one operator call; what is still there goes when the interpreter exits."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.paths = spark, []
        self.root = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        atexit.register(_delete_at_exit, spark, self.root)

    def path(self, name: str) -> str:
        self.paths.append(f"{self.root}/{len(self.paths)}-{name}")
        return self.paths[-1]

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return it as a scan of the written files."""
        path = self.path(name)
        df.write.options(**WRITTEN).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *paths: str) -> None:
        for path in paths:
            delete(self.spark, path)
