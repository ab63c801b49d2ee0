"""Which uids of a folder are to be read: above the offset, in a backfill window, slice by slice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import upsert

#: Fixed value: how far behind the clock a folder's first watermark may lie at most.
FIRST_ALLOWANCE = "INTERVAL 10 MINUTES"


def above_offset(records: DataFrame, last: Column, uid: str = "uid", ordinal: str = "ordinal") -> DataFrame:
    """Records strictly above the last uid that was read; of repeats of a uid the first."""
    return upsert.first_of(records.where(F.col(uid) > last), [uid], ordinal)


def backfill_window(dates: DataFrame, since, uid: str = "uid", time: str = "internal_date") -> DataFrame:
    """The different uids of messages from ``since`` on; the filter reaches the scan."""
    return dates.where(F.col(time) >= since).select(uid).distinct()


def backfill_slice(uids: DataFrame, cursor: Column, until: Column, uid: str = "uid") -> DataFrame:
    return uids.where((F.col(uid) > cursor) & (F.col(uid) <= until))


def backfill_progress(window: DataFrame, keys: list[str], uid: str = "uid", size: int = 200) -> DataFrame:
    """(keys..., slice, cursor, until, n): the slices of ``size`` uids that a backfill goes through, each from its cursor on."""
    from .stream_rules import chunks

    placed = chunks(window, keys, uid, size)
    return placed.groupBy(*keys, F.col("chunk").alias("slice")).agg((F.min(uid) - 1).alias("cursor"), F.max(uid).alias("until"), F.count(F.lit(1)).alias("n"))


def uid_bounds(uids: DataFrame, keys: list[str], uid: str = "uid") -> DataFrame:
    return uids.groupBy(*keys).agg(F.min(uid).alias("low"), F.max(uid).alias("high"))


def first_watermark(newest: Column, now: Column) -> Column:
    """A folder's first watermark: the newest message, capped at the clock, or the allowance behind the clock if that is later."""
    floor = now - F.expr(FIRST_ALLOWANCE)
    return F.greatest(F.least(newest, now), floor)


def days_before(now: Column, days: Column) -> Column:
    return now - F.make_dt_interval(days.cast("int"), F.lit(0), F.lit(0), F.lit(0))


def relabelled(removed: DataFrame, added: DataFrame, message: str, echoes: DataFrame | None = None) -> DataFrame:
    """(message, from_folder, to_folder): messages that left one folder and came into one other; our own moves (``echoes``) are left out."""
    once = lambda df, name: df.groupBy(message).agg(F.count(F.lit(1)).alias("n"), F.min("folder").alias(name)).where("n = 1").drop("n")
    pairs = once(removed, "from_folder").join(once(added, "to_folder"), message).where("from_folder <> to_folder")
    return pairs if echoes is None else pairs.join(echoes.select(message, "to_folder").distinct(), [message, "to_folder"], "left_anti")
