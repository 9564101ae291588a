"""Folders that driver and executors share, for what a query writes and reads again."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared(spark: SparkSession) -> str:
    """What a cluster names in ``spark.checkpoint.dir``. Where that is unset in a session of one process, a temporary folder, remembered in the session; elsewhere that's an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("barloom.work.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="barloom-")
        spark.conf.set("barloom.work.dir", named)
    return named.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A folder that nothing has used yet."""
    return f"{shared(spark)}/{name}-{uuid.uuid4().hex}"


def handle(spark: SparkSession, path: str):
    """The file system of a path, and the path, as Spark's own readers see them."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where
