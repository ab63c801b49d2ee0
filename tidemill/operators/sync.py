"""Comparing what is stored with what the source holds: removals, generations, registry changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def vanished(live: DataFrame, present: DataFrame, keys: list[str], upto=None, uid_col: str = "uid") -> DataFrame:
    """Live locations that the source no longer lists, up to the last uid that was read."""
    if upto is not None:
        live = live.where(F.col(uid_col) <= upto)
    return live.join(present.select(*keys), keys, "left_anti")


def old_generation(locations: DataFrame, generation: int, message_col: str = "message_id") -> DataFrame:
    """Live locations of older generations with ``reason``: superseded if the message has a live location in ``generation``, else vanished."""
    live = locations.where(F.col("removed_at").isNull())
    fresh = live.where(F.col("generation") == generation).select(message_col).distinct().withColumn("__mark", F.lit(True))
    old = live.where(F.col("generation") < generation).join(fresh, message_col, "left")
    return old.withColumn("reason", F.when(F.col("__mark"), "superseded").otherwise("vanished")).drop("__mark")


def orphans(bodies: DataFrame, live: DataFrame, decisions: DataFrame, keys: list[str]) -> DataFrame:
    """Bodies of messages with neither a live location nor a decision."""
    return bodies.join(live.select(*keys).distinct(), keys, "left_anti").join(decisions.select(*keys).distinct(), keys, "left_anti")


def resync_counts(before: DataFrame, after: DataFrame, key: str, since_col: str, since) -> DataFrame:
    """One row: matched, new, older (new, but before ``since``) and gone identities of two generations."""
    both = before.select(key, F.lit(True).alias("b")).distinct().join(after.select(key, since_col).withColumn("a", F.lit(True)), key, "full_outer")
    fresh = F.col("a") & F.col("b").isNull()
    return both.agg(
        F.count_if(F.col("a") & F.col("b")).alias("matched"),
        F.count_if(fresh & (F.col(since_col) >= since)).alias("new"),
        F.count_if(fresh & (F.col(since_col) < since)).alias("older"),
        F.count_if(F.col("b") & F.col("a").isNull()).alias("gone"),
    )


def registry_diff(config: DataFrame, registry: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, action, changes): add, update, enable or disable, with a (field, from, to) for each field that differs.

    ``registry`` has a column enabled; an entry that the configuration lacks is disabled once.
    """
    new = config.select(F.col(key), F.struct(*[F.col(f).cast("string").alias(f) for f in fields]).alias("new"))
    old = registry.select(F.col(key), "enabled", F.struct(*[F.col(f).cast("string").alias(f) for f in fields]).alias("old"))
    joined = new.join(old, key, "full_outer")
    changes = F.filter(
        F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"old.{f}").alias("from"), F.col(f"new.{f}").alias("to")) for f in fields]),
        lambda c: ~c["from"].eqNullSafe(c["to"]),
    )
    action = (
        F.when(F.col("old").isNull(), "add")
        .when(F.col("new").isNull(), F.when(F.col("enabled"), "disable"))
        .when(~F.col("enabled"), "enable")
        .when(F.size("changes") > 0, "update")
    )
    found = joined.withColumn("changes", F.when(F.col("old").isNotNull() & F.col("new").isNotNull(), changes).otherwise(F.slice(changes, 1, 0)))
    return found.withColumn("action", action).where("action is not null").select(key, "action", "changes")


def rename_pairs(removed: DataFrame, added: DataFrame, identity: str, key: str) -> DataFrame:
    """(identity, removed_key, added_key) of identities that exactly one removed and one added entry has."""
    once = lambda df, name: df.groupBy(identity).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias(name)).where("n = 1").drop("n")
    return once(removed, "removed_key").join(once(added, "added_key"), identity)
