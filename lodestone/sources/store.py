"""Folders that every executor sees."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

_local: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir; only a local session without that setting has one of its own."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _local:
            holder = tempfile.TemporaryDirectory(prefix="lodestone-")
            atexit.register(holder.cleanup)
            _local[app] = f"file://{holder.name}"
        shared = _local[app]
    return f"{shared.rstrip('/')}/lodestone/{uuid.uuid4().hex}"


def _at(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, system = _at(spark, path)
    return system.exists(at)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of finished tables in a folder; none where there is no folder."""
    at, system = _at(spark, path)
    names = [s.getPath().getName() for s in system.listStatus(at)] if system.exists(at) else []
    return sorted(n for n in names if exists(spark, f"{path}/{n}/_SUCCESS"))


def remove(spark: SparkSession, path: str) -> None:
    at, system = _at(spark, path)
    system.delete(at, True)
