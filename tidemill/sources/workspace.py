"""Folders and commit markers that driver and executors share, by Hadoop's file system."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a session on one machine gets a temporary folder, and a cluster's is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tidemill-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for tables that a query writes and reads again."""
    return f"{shared_dir(spark)}/tidemill-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def names(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, none where it does not exist; names only, no file is opened."""
    fs, at = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def numbers(spark: SparkSession, path: str, prefix: str = "") -> list[int]:
    return sorted(int(n[len(prefix) :]) for n in names(spark, path) if n.startswith(prefix) and n[len(prefix) :].isdigit())


def delete(spark: SparkSession, path: str) -> None:
    fs, at = _at(spark, path)
    fs.delete(at, True)


def commit(spark: SparkSession, path: str, version: int) -> bool:
    """Make ``version`` the one that readers see, by one small file that is created or not; False if it is there already."""
    fs, at = _at(spark, f"{path}/{version:012d}")
    return bool(fs.createNewFile(at))


def committed(spark: SparkSession, path: str) -> int:
    """The latest committed version, 0 before the first."""
    return max([0, *numbers(spark, path)])


def touch(spark: SparkSession, path: str) -> None:
    fs, at = _at(spark, path)
    fs.create(at, True).close()


def move(spark: SparkSession, source: str, target: str) -> None:
    """Put a folder in another's place; what was there goes."""
    fs, at = _at(spark, target)
    fs.delete(at, True)
    fs.mkdirs(at.getParent())
    if not fs.rename(spark._jvm.org.apache.hadoop.fs.Path(source), at):
        raise RuntimeError(f"could not move {source}")
