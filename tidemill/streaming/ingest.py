"""Ingest as a stream: each micro-batch is routed by the folder's watermark and appended once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from ..operators import stream_rules, upsert
from ..sources import workspace
from .keytable import KeyTable


def read_or_empty(spark: SparkSession, path: str, schema) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as fault:
        if fault.getCondition() != "PATH_NOT_FOUND":  # any other fault would pass for an empty table
            raise
        return spark.createDataFrame([], schema)


def _batch_time(spark: SparkSession, state: str, batch_id: int):
    """The clock of a batch: recorded when it first runs, so that a second run of it caps times alike."""
    path, schema = f"{state}-clock/batch={batch_id}", "now timestamp"
    known = read_or_empty(spark, path, schema).first()
    if known is None:
        spark.range(1).select(F.current_timestamp().alias("now")).write.mode("overwrite").parquet(path)
        known = read_or_empty(spark, path, schema).first()
    return F.lit(known["now"])


def latest_before(spark: SparkSession, path: str, schema: str, batch_id: int | None) -> DataFrame:
    """What the last batch before ``batch_id`` (None: of all) wrote under ``path``, where each batch writes all that holds after it.

    One folder is read, however many batches there were; folders are told by name.
    """
    batches = [b for b in workspace.numbers(spark, path, "batch=") if batch_id is None or b < batch_id]
    return spark.read.schema(schema).parquet(f"{path}/batch={batches[-1]}") if batches else spark.createDataFrame([], schema)


def _holds(spark: SparkSession, state: str, key: str, before: int | None = None) -> DataFrame:
    """(key, n_new, held, hold_batch, released): of each folder that was ever held the latest hold or release, and the batch of the last release."""
    return latest_before(spark, f"{state}-holds", f"{key} string, n_new long, held boolean, hold_batch long, released long", before)


def approve_held(spark: SparkSession, state: str, folders: list[str], key: str = "folder") -> None:
    """The owner lets in what is held of ``folders`` now: in the next batch the count of that hold is added to their cap, once.

    An approval goes with its hold: a later hold of the folder, of another count, needs its own.
    """
    now = _holds(spark, state, key).where(F.col("held") & F.col(key).isin(folders))
    now.select(key, F.col("n_new").alias("approved"), "hold_batch").write.mode("append").parquet(f"{state}-approved")


def store_batch(batch: DataFrame, store: str, state: str, batch_id: int, key: str = "folder", identity: str = "identity", time: str = "internal_date", cap: int = stream_rules.NEW_MAIL_CAP) -> None:
    """Route one batch by the watermarks at its start, hold folders over the cap, append what is new, move the watermarks on.

    All rows of a held folder go to a table of their own (``state``-held), and stand before every later
    batch together with its rows, until the folder's new messages are within the cap or the owner has
    approved their count (``approve_held``). So no row that was read is lost.

    Late messages are stored with eligible = false, never dropped, so Spark's own watermark does not
    gate this. A batch writes to a folder of its own number and overwrites it, and reads only batches
    before it, so that a batch that is run again after a failure gives the same rows. What a batch reads does not grow with the
    number of batches: known identities are looked up in a ``KeyTable`` (``state``-keys), watermarks and holds are in the last batch's folder
    alone, and held rows are read only since the hold began.
    """
    spark = batch.sparkSession
    number = F.lit(batch_id).cast("long").alias("batch_id")
    marks = latest_before(spark, state, f"{key} string, watermark timestamp", batch_id)
    holds = _holds(spark, state, key, batch_id)
    approvals = read_or_empty(spark, f"{state}-approved", f"{key} string, approved long, hold_batch long").groupBy(key, "hold_batch").agg(F.max("approved").alias("approved"))
    released = holds.where("held").select(key, "released")
    since = released.agg(F.min(F.coalesce("released", F.lit(-1)))).first()[0]
    batches = [] if since is None else [b for b in workspace.numbers(spark, f"{state}-held", "batch=") if since < b < batch_id]
    earlier = batch.select("*", number).limit(0) if not batches else spark.read.schema(batch.select("*", number).schema).parquet(*[f"{state}-held/batch={b}" for b in batches])
    waiting = earlier.join(released, key).where(F.col("released").isNull() | (F.col("batch_id") > F.col("released"))).select(*batch.columns, F.lit(True).alias("waited"))
    arrived = batch.withColumn("waited", F.lit(False)).unionByName(waiting)
    routed = arrived.join(marks, key, "left").withColumn("eligible", stream_rules.is_new(F.col(time), F.col("watermark")))

    counts = stream_rules.admission(routed, [key], cap).drop("held").join(holds.withColumnsRenamed({"n_new": "n_before", "held": "held_before"}), key, "full_outer")
    counts = counts.join(approvals, [key, "hold_batch"], "left")
    was_held, seen = F.coalesce("held_before", F.lit(False)), F.col("n_new").isNotNull()
    over = F.col("n_new") > F.lit(cap) + F.when(was_held, F.coalesce("approved", F.lit(0))).otherwise(0)
    decided = counts.withColumns({"was": was_held, "held": F.when(seen, over).otherwise(was_held)})
    changed = seen & ((F.col("held") & (~F.col("was") | (F.col("n_new") != F.col("n_before")))) | (~F.col("held") & F.col("was")))
    after = decided.where(F.col("held_before").isNotNull() | changed).select(
        key,
        F.when(changed, F.col("n_new")).otherwise(F.col("n_before")).alias("n_new"),
        "held",
        F.when(changed, batch_id).otherwise(F.col("hold_batch")).cast("long").alias("hold_batch"),
        F.when(changed & ~F.col("held"), batch_id).otherwise(F.col("released")).cast("long").alias("released"),
    )
    after.write.mode("overwrite").parquet(f"{state}-holds/batch={batch_id}")  # one reading of the approvals
    held = _holds(spark, state, key, batch_id + 1).where("held").select(key)
    routed.where(~F.col("waited")).join(held, key, "left_semi").select(*batch.columns, number).write.mode("overwrite").parquet(f"{state}-held/batch={batch_id}")

    admitted = routed.join(held, key, "left_anti").drop("watermark", "waited").withColumn("batch_id", number)
    merged = KeyTable.hashed(upsert.merged_messages(admitted, [key, identity], "uid"), [key, identity])  # eligible if any of the repeats is
    merged.write.mode("overwrite").parquet(f"{state}-work")
    merged = spark.read.schema(merged.schema).parquet(f"{state}-work")
    keys = KeyTable(spark, f"{state}-keys")
    keys.compact(before=batch_id)
    known = keys.known(merged, before=batch_id)
    merged.join(known, ["h1", "h2"], "left_anti").drop("h1", "h2").write.mode("overwrite").parquet(f"{store}/batch={batch_id}")
    keys.add(merged, batch_id)
    now = _batch_time(spark, state, batch_id)
    moved = admitted.where("eligible").groupBy(key).agg(F.max(F.least(F.col(time), now)).alias("watermark"))
    upsert.advance(marks, moved, [key], ["watermark"]).withColumn("batch_id", number).write.mode("overwrite").parquet(f"{state}/batch={batch_id}")


def start_ingest(messages: DataFrame, store: str, state: str, checkpoint: str, interval: str | None = None, **kwargs) -> StreamingQuery:
    """Runs ``store_batch`` over a stream; every ``interval`` (such as 60 seconds), or over what is there now and then stops."""
    writer = messages.writeStream.foreachBatch(lambda df, i: store_batch(df, store, state, i, **kwargs)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()
