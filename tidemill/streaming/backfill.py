"""The first backfill of a folder as a stream of its own beside the polling one, over one store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType
from pyspark.sql.window import Window

from ..sources import workspace
from .ingest import latest_before

#: Fixed value: messages of a folder in a slice.
SLICE = 200
PROGRESS = "folder string, since timestamp, cursor long, until long, total long, done long"


def begin_backfill(listing: DataFrame, state: str, since) -> None:
    """Note each folder's window: its messages from ``since`` on (uid up to the greatest now), none read yet. A folder without any has no backfill.

    ``listing`` has folder, uid and internal_date; mail that arrives later belongs to the polling stream. What was begun before is begun anew.
    """
    at = F.lit(since).cast("timestamp")
    window = listing.where(F.col("internal_date") >= at).groupBy("folder").agg((F.min("uid") - 1).alias("cursor"), F.count_distinct("uid").alias("total"))
    until = listing.groupBy("folder").agg(F.max("uid").alias("until"))
    begun = window.join(until, "folder").select("folder", at.alias("since"), "cursor", "until", "total", F.lit(0).cast("long").alias("done"))
    workspace.delete(listing.sparkSession, f"{state}-backfill")
    begun.write.mode("overwrite").parquet(f"{state}-backfill/batch=0")


def progress(spark: SparkSession, state: str) -> DataFrame:
    """(folder, since, cursor, until, total, done) after the last slice; a folder that is through has done = total."""
    return latest_before(spark, f"{state}-backfill", PROGRESS, None)


def backfill_slice(listing: DataFrame, store: str, state: str, number: int, size: int = SLICE) -> int:
    """Store the next ``size`` window messages of each folder, ascending by uid, as eligible; gives how many.

    ``listing`` (folder, identity, uid, internal_date, ...) is what the source holds. A slice (1, 2, ...) writes to a folder of its number and reads the
    progress of the slice before, so one that runs again after a failure gives the same rows. The filter on uids reaches the scan. Nothing is
    looked up in what the polling stream stored: ``messages`` merges both.
    """
    spark = listing.sparkSession
    before = latest_before(spark, f"{state}-backfill", PROGRESS, number)
    bounds = before.where("done < total").agg(F.min("cursor").alias("low"), F.max("until").alias("high")).first()
    if bounds["low"] is None:
        return 0
    near = listing.where((F.col("uid") > bounds["low"]) & (F.col("uid") <= bounds["high"]))
    mine = F.broadcast(before.where("done < total").select("folder", "since", "cursor", "until"))  # a row for each folder
    inside = near.join(mine, "folder").where((F.col("uid") > F.col("cursor")) & (F.col("uid") <= F.col("until")) & (F.col("internal_date") >= F.col("since")))
    once = inside.dropDuplicates(["folder", "uid"])
    place = F.row_number().over(Window.partitionBy("folder").orderBy("uid"))
    taken = once.withColumn("__place", place).where(F.col("__place") <= size).select(*listing.columns, F.lit(True).alias("eligible"))
    path = f"{store}-backfill/batch={number}"
    taken.write.mode("overwrite").parquet(path)
    found = spark.read.schema(taken.schema).parquet(path).groupBy("folder").agg(F.max("uid").alias("top"), F.count(F.lit(1)).alias("n"))
    moved = before.join(found, "folder", "left").select(
        "folder",
        "since",
        F.coalesce("top", F.when(F.col("done") < F.col("total"), F.col("until")).otherwise(F.col("cursor"))).alias("cursor"),
        "until",
        # messages of the window that have gone meanwhile count as done once the folder is through
        F.when(F.col("top").isNull() | (F.col("n") < size), F.col("total")).otherwise(F.least(F.col("done") + F.col("n"), F.col("total") - 1)).alias("done"),
        "total",
    )
    moved.select(*StructType.fromDDL(PROGRESS).names).write.mode("overwrite").parquet(f"{state}-backfill/batch={number}")
    return spark.read.schema(taken.schema).parquet(path).count()


def run_backfill(listing: DataFrame, store: str, state: str, size: int = SLICE) -> int:
    """Slices until no folder has more; gives the number of the last. It goes on where an earlier run stopped."""
    spark = listing.sparkSession
    number = max(workspace.numbers(spark, f"{state}-backfill", "batch="))
    while not progress(spark, state).where("done < total").isEmpty():
        number += 1
        backfill_slice(listing, store, state, number, size)
    return number


def messages(spark: SparkSession, store: str, schema: StructType) -> DataFrame:
    """The store: one row for each (folder, identity) of what either stream wrote; ``schema`` is the listing's.

    Eligible if either says so, fields of the earliest uid, the first body that is not null: whatever the order in which the streams wrote, and however
    often a message came, the row is the same. A historical message that the backfill reaches is promoted by this; none is there twice.
    """
    rows = []
    fields = StructType([*schema.fields]).add("eligible", "boolean")
    for path in (store, f"{store}-backfill"):
        if workspace.numbers(spark, path, "batch="):
            rows.append(spark.read.schema(StructType([*fields.fields]).add("batch", LongType())).parquet(path).drop("batch"))
    if not rows:
        return spark.createDataFrame([], fields)
    both = rows[0] if len(rows) == 1 else rows[0].unionByName(rows[1])
    keys = ["folder", "identity"]
    rest = [c for c in schema.names if c not in [*keys, "body"]]
    order = F.struct("uid", "internal_date")
    body = [F.min_by("body", F.when(F.col("body").isNotNull(), F.struct("uid", "body"))).alias("body")] if "body" in schema.names else []
    merged = both.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("r"), F.bool_or("eligible").alias("eligible"), *body)
    return merged.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest], *(["body"] if body else []), "eligible")
