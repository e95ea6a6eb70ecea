"""Intermediate tables in the cluster's shared folder, and small files through the file system that a path names."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``; a temporary folder stands in for it on a local master alone."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", root)
        _made.append((spark, root))
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read back: its lineage ends here, and lost executors lose nothing."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_file(spark: SparkSession, path: str, text: str) -> None:
    """A small driver-side file (a report, a manifest) on any file system that Spark knows; an older one is replaced."""
    p, fs = _path(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_file(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


@atexit.register
def _clean() -> None:
    while _made:
        spark, path = _made.pop()
        try:
            if path.startswith(("file:", "/")):
                shutil.rmtree("/" + path.removeprefix("file:").lstrip("/"), ignore_errors=True)
            else:
                p, fs = _path(spark, path)
                fs.delete(p, True)
        except Exception:  # the JVM may be gone; the folder is scratch
            pass
