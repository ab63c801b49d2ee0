"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space and words as every contract of this subpackage reads them.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir. Where it is unset, a session on one
    machine (local master) gets a temporary one; a cluster's is an error."""
    conf = spark.sparkContext.getConf()
    at = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tidemill-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def run_folder(spark: SparkSession) -> str:
    """Where this application's intermediate tables are; results read from them until they are written elsewhere."""
    return f"{shared_dir(spark)}/tidemill-{spark.sparkContext.applicationId}"


def drop_run(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application, once its results are written."""
    delete(spark, run_folder(spark))


#: Rows of a key from which a join treats it as hot, at least; and most hot keys.
HOT_ROWS, HOT_KEYS = 1000, 100_000


def skewed_join(left: DataFrame, right: DataFrame, keys: list[str], n_col: str, how: str = "inner") -> DataFrame:
    """``left`` joined to ``right``, which has one row for each key and in ``n_col`` how many rows of ``left`` share it.

    Rows of hot keys are joined where they are, with a broadcast of the hot keys' rows, HOT_KEYS at most:
    a key is hot only if it has more than one in HOT_KEYS of all rows. The others are shuffled. Both
    inputs are read twice and should be tables. ``how`` is inner, left or left_semi.
    """
    rows = left.count()
    hot = F.broadcast(right.where(F.col(n_col) > max(HOT_ROWS, rows // HOT_KEYS)))
    cold = right.where(~F.coalesce(F.col(n_col) > max(HOT_ROWS, rows // HOT_KEYS), F.lit(False)))
    few = left.join(hot, keys, "inner" if how == "left" else how)
    rest = left.join(hot.select(*keys), keys, "left_anti").join(cold, keys, how)
    return few.unionByName(rest)


def written(df: DataFrame, name: str, by: list[str] | None = None) -> str:
    """Write ``df`` as a Parquet table in the shared folder; gives its path."""
    path = f"{run_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by or []).parquet(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def materialize(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it again: lineage ends there,
    no row is computed twice, and a lost executor loses nothing. ``by`` names columns, the last ones
    of ``df``, that get a folder for each value."""
    return df.sparkSession.read.schema(df.schema).parquet(written(df, name, by))


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of our own that no column of ``df`` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        found.append(name)
    return found


def text_of(column: str = "text") -> Column:
    """The text, empty where null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
