"""What a batch of new messages does to a folder's state: watermark routing, admission, islands, runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: How far behind the watermark a message still counts as new, and how many new ones a check admits.
OVERLAP = "INTERVAL 5 MINUTES"
NEW_MAIL_CAP = 200


def is_new(time: Column, watermark: Column) -> Column:
    """Strictly later than the watermark less the overlap; without a watermark everything is new."""
    return watermark.isNull() | (time > watermark - F.expr(OVERLAP))


def capped(time: Column, now: Column) -> Column:
    return F.least(time, now)


def routed(messages: DataFrame, keys: list[str], batch: str, time: str) -> DataFrame:
    """``messages`` with ``watermark`` (of their key before their batch) and ``eligible``; late ones are kept, not dropped.

    A batch is judged by the watermark at its start, and then moves it. Only the greatest time of each
    batch takes part in the window, so its size is the number of batches.
    """
    tops = messages.groupBy(*keys, batch).agg(F.max(time).alias("top"))
    before = Window.partitionBy(*keys).orderBy(batch).rowsBetween(Window.unboundedPreceding, -1)
    marks = tops.select(*keys, batch, F.max("top").over(before).alias("watermark"))
    return messages.join(marks, [*keys, batch]).withColumn("eligible", is_new(F.col(time), F.col("watermark")))


def admission(messages: DataFrame, keys: list[str], cap: int = NEW_MAIL_CAP) -> DataFrame:
    """(keys..., n_new, held): a batch with more new messages than the cap is held as a whole."""
    return messages.groupBy(*keys).agg(F.count_if("eligible").alias("n_new")).withColumn("held", F.col("n_new") > cap)


#: Numbers of one bucket: windows see a bucket of a key, or a key's buckets, never all rows of a key.
BUCKET = 1 << 20


def _bucket(number: Column) -> Column:
    return F.floor(number / BUCKET).cast("long")


def uid_islands(uids: DataFrame, keys: list[str], uid: str = "uid") -> DataFrame:
    """(keys..., low, high): runs of consecutive uids. They are found in buckets of BUCKET numbers, then those that touch across an edge are joined."""
    rows = uids.select(*keys, uid).distinct().withColumn("__bucket", _bucket(F.col(uid)))
    place = F.row_number().over(Window.partitionBy(*keys, "__bucket").orderBy(uid))
    pieces = rows.withColumn("__island", F.col(uid) - place).groupBy(*keys, "__bucket", "__island").agg(F.min(uid).alias("low"), F.max(uid).alias("high"))
    edge = (F.col("low") % BUCKET == 0) | (F.col("high") % BUCKET == BUCKET - 1)
    inner, outer = pieces.where(~edge).select(*keys, "low", "high"), pieces.where(edge).select(*keys, "low", "high")
    line = Window.partitionBy(*keys).orderBy("low")  # at most two rows a bucket
    starts = outer.withColumn("__new", F.when(F.col("low") == F.lag("high").over(line) + 1, 0).otherwise(1))
    runs = starts.withColumn("__run", F.sum("__new").over(line)).groupBy(*keys, "__run").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return inner.unionByName(runs.select(*keys, "low", "high"))


def uid_ranges(uids: DataFrame, keys: list[str], uid: str = "uid") -> DataFrame:
    """(keys..., ranges): uids as 1:3,7,9:10 — one text for a key, whose length is that of its islands, as the protocol has it."""
    spans = uid_islands(uids, keys, uid)
    text = F.when(F.col("low") == F.col("high"), F.col("low").cast("string")).otherwise(F.concat_ws(":", "low", "high"))
    listed = spans.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("low", text.alias("text")))).alias("s"))
    return listed.select(*keys, F.array_join(F.transform("s", lambda x: x["text"]), ",").alias("ranges"))


def chunks(rows: DataFrame, keys: list[str], order: str, size: int) -> DataFrame:
    """``rows`` with ``chunk``: consecutive chunks of ``size`` rows of a key by ``order``, a number.

    Rows are numbered within buckets of BUCKET numbers; the counts of the buckets before are added.
    """
    bucketed = rows.withColumn("__bucket", _bucket(F.col(order)))
    counts = bucketed.groupBy(*keys, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(*keys, "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    place = F.row_number().over(Window.partitionBy(*keys, "__bucket").orderBy(order))
    placed = bucketed.withColumn("__place", place).join(bases, [*keys, "__bucket"])
    return placed.withColumn("chunk", F.floor((F.col("__base") + F.col("__place") - 1) / size).cast("long")).drop("__bucket", "__base", "__place")


def failure_runs(attempts: DataFrame, keys: list[str], order: str, failed: Column, limit: int = 5) -> DataFrame:
    """(keys..., longest_run, stopped): the longest run of failures by ``order``, a number, and whether it reaches the limit.

    A run is what lies between two successes. Within buckets of BUCKET numbers runs are counted one by
    one; of each bucket the failures before its first success and after its last join those of its
    neighbours, through buckets of failures alone.
    """
    rows = attempts.select(*keys, F.col(order).alias("__at"), F.coalesce(failed, F.lit(False)).alias("__failed")).withColumn("__bucket", _bucket(F.col("__at")))
    so_far = Window.partitionBy(*keys, "__bucket").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    runs = rows.withColumn("__run", F.sum(F.when(F.col("__failed"), 0).otherwise(1)).over(so_far)).groupBy(*keys, "__bucket", "__run").agg(F.count_if("__failed").alias("n"))
    found = runs.groupBy(*keys, "__bucket").agg(
        F.max("n").alias("inner"), F.coalesce(F.max(F.when(F.col("__run") == 0, F.col("n"))), F.lit(0)).alias("head"), F.max_by("n", "__run").alias("tail"), F.max("__run").alias("ends")
    )
    # a bucket with a success ends what came before with its head and begins anew with its tail
    line = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, 0)
    parts = found.withColumn("__group", F.sum((F.col("ends") > 0).cast("int")).over(line))
    opening = parts.where("ends > 0").select(*keys, "__group", F.col("tail").alias("n"))
    closing = parts.select(*keys, (F.col("__group") - (F.col("ends") > 0).cast("int")).alias("__group"), F.col("head").alias("n"))
    across = opening.unionByName(closing).groupBy(*keys, "__group").agg(F.sum("n").alias("n")).select(*keys, "n")
    inside = parts.where("ends > 0").select(*keys, F.col("inner").alias("n"))
    longest = across.unionByName(inside).groupBy(*keys).agg(F.max("n").alias("longest_run"))
    return longest.withColumn("stopped", F.col("longest_run") >= limit)


def status_fold(events: DataFrame, keys: list[str], order: str, kind: str) -> DataFrame:
    """(keys..., state, last_seen, last_success, last_error): the latest of each kind of status event, by aggregates alone."""
    latest = lambda k: F.max(F.when(F.col(kind) == k, F.col(order)))
    folded = events.groupBy(*keys).agg(
        F.max(order).alias("last_seen"), latest("success").alias("last_success"), latest("error").alias("last_error"), latest("disabled").alias("last_disabled")
    )
    never = lambda c: F.coalesce(F.col(c), F.lit(-1))
    state = (
        F.when((never("last_disabled") > never("last_success")) & (never("last_disabled") > never("last_error")), "disabled")
        .when(never("last_error") > never("last_success"), "error")
        .when(F.col("last_success").isNotNull(), "ok")
        .otherwise("connecting")
    )
    return folded.withColumn("state", state).drop("last_disabled")


def nearest_ranks(df: DataFrame, value: str, percents: dict[str, float], buckets: int = 1024) -> DataFrame:
    """One row with the nearest-rank percentile of each name, exact, null without rows (``evaluation.nearest_ranks_by`` without keys)."""
    from .evaluation import nearest_ranks_by

    return nearest_ranks_by(df, [], value, percents, buckets)
