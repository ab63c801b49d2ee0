"""Writes as derived tables: insert-or-ignore, upsert, forward-only state, retention.

Parquet has no row-level updates, so each function returns the rows to append or the table that
replaces the old one; uniqueness is a property of these functions, and ``duplicate_keys`` audits it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_of(rows: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """One row for each key: the one with the smallest ordinal (an aggregation that combines before the shuffle)."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), ordinal).alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def last_of(rows: DataFrame, keys: list[str], order) -> DataFrame:
    """One row for each key: the one with the greatest ``order`` (a column or a list of columns)."""
    rest = [c for c in rows.columns if c not in keys]
    by = F.struct(*order) if isinstance(order, list) else F.col(order)
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), by).alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def insert_or_ignore(target: DataFrame, rows: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """The rows to append: of repeats in the batch the first, without keys that ``target`` holds."""
    return first_of(rows, keys, ordinal).join(target.select(*keys), keys, "left_anti")


def duplicate_keys(table: DataFrame, keys: list[str]) -> DataFrame:
    return table.groupBy(*keys).count().where("count > 1")


def upsert(target: DataFrame, rows: DataFrame, keys: list[str], update: list[str]) -> DataFrame:
    """``target`` after an upsert, with ``inserted``: null for rows that were left alone.

    A key that ``rows`` has twice is an error when the result is computed, since either could win.
    """
    if not update:
        raise ValueError("an upsert updates at least one column")
    once = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.first(F.struct(*rows.columns)).alias("__row"))
    new = once.select(*keys, F.when(F.col("__n") > 1, F.raise_error(F.lit("an upsert has two rows with one key"))).otherwise(F.col("__row")).alias("new"))
    old = target.select(*keys, F.struct(*target.columns).alias("old"))
    joined = old.join(new, keys, "full_outer")
    fresh = F.col("old").isNull()

    def value(c: str) -> Column:
        if c in keys:
            return F.col(c)
        if c not in rows.columns:
            return F.col(f"old.{c}").alias(c)
        if c in update:
            return F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c)
        return F.when(fresh, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c)

    return joined.select(*[value(c) for c in target.columns], F.when(F.col("new").isNotNull(), fresh).alias("inserted"))


def merged_messages(items: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """Items of a chunk as message rows: fields of the first item, eligible if any is, the first body that is not null."""
    rest = [c for c in items.columns if c not in [*keys, "eligible", "body", ordinal]]
    bodies = [F.min_by("body", F.when(F.col("body").isNotNull(), F.col(ordinal))).alias("body")] if "body" in items.columns else []
    merged = items.groupBy(*keys).agg(*[F.min_by(c, ordinal).alias(c) for c in rest], F.bool_or("eligible").alias("eligible"), *bodies, F.min(ordinal).alias(ordinal))
    return merged.select(*items.columns)


def next_versions(known: DataFrame, hashes: DataFrame, by: list[str]) -> DataFrame:
    """New (by..., hash, version): versions follow the highest known one, in the order of the hashes; known hashes are left out."""
    from pyspark.sql.window import Window

    tops = known.groupBy(*by).agg(F.max("version").alias("top"))
    fresh = hashes.select(*by, "hash").distinct().join(known.select(*by, "hash"), [*by, "hash"], "left_anti")
    place = F.row_number().over(Window.partitionBy(*by).orderBy("hash"))
    return fresh.withColumn("place", place).join(tops, by, "left").select(*by, "hash", (F.coalesce("top", F.lit(0)) + F.col("place")).alias("version"))


def advance(state: DataFrame, moves: DataFrame, keys: list[str], marks: list[str]) -> DataFrame:
    """State that only goes forward: of each mark the greatest of the old value and the moves."""
    return state.unionByName(moves, allowMissingColumns=True).groupBy(*keys).agg(*[F.max(m).alias(m) for m in marks])


def unexpired(bodies: DataFrame, at) -> DataFrame:
    """Bodies that a sweep at ``at`` leaves: without an expiry, or with a later one."""
    return bodies.where(F.col("expires_at").isNull() | (F.col("expires_at") > at))


def mark_removed(locations: DataFrame, gone: DataFrame, keys: list[str], reason, at) -> DataFrame:
    """``locations`` with ``removed_at`` and ``removed_reason`` set where ``gone`` says so; the first removal wins."""
    marks = gone.select(*keys).distinct().withColumn("__gone", F.lit(True))
    hit = F.col("removed_at").isNull() & F.col("__gone")
    joined = locations.join(marks, keys, "left")
    kept = {"removed_reason": F.when(hit, F.lit(reason)).otherwise(F.col("removed_reason")), "removed_at": F.when(hit, at).otherwise(F.col("removed_at"))}
    return joined.withColumns(kept).drop("__gone")
