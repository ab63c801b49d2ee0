"""Writes of the store that combine several tables: inserts, updates and deletes by match, chunks, decisions, bodies, the registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scope, upsert

#: Fixed value: how long a body is kept after the decision.
RETENTION = "INTERVAL 7 DAYS"
#: Columns that no update may set.
FIXED = frozenset({"mailbox_id", "id"})


def inserted(rows: DataFrame, mailbox, column: str = "mailbox_id") -> DataFrame:
    """``rows`` as the mailbox's own: its id is filled in, whatever the rows say; no rows give none."""
    return rows.withColumn(column, F.lit(mailbox))


def matched(df: DataFrame, conditions: dict) -> Column:
    """The conditions of ``scope.match`` as one predicate that is never null; lists are bounded by LITERAL_VALUES."""
    parts = []
    for name, wanted in conditions.items():
        if wanted is None:
            parts.append(F.col(name).isNull())
        elif isinstance(wanted, (list, tuple, set, frozenset)):
            if len(wanted) > scope.LITERAL_VALUES:
                raise ValueError(f"{name}: join a list this long")
            parts.append(F.coalesce(F.col(name).isin(list(wanted)), F.lit(False)) if wanted else F.lit(False))
        else:
            parts.append(F.col(name).eqNullSafe(F.lit(wanted)))
    return scope.all_of(parts)


def updated(df: DataFrame, values: dict, conditions: dict) -> DataFrame:
    """``df`` with ``values`` set where the conditions hold, as the table that replaces it."""
    if not values or FIXED & set(values):
        raise ValueError("an update sets columns, and neither the mailbox nor the id")
    hit = matched(df, conditions)
    return df.withColumns({c: F.when(hit, F.lit(v).cast(df.schema[c].dataType)).otherwise(F.col(c)) for c, v in values.items()})


def deleted(df: DataFrame, conditions: dict) -> tuple[DataFrame, DataFrame]:
    """(what stays, what the delete returns)."""
    hit = matched(df, conditions)
    return df.where(~hit), df.where(hit)


def known_identities(items: DataFrame, messages: DataFrame, keys: list[str]) -> DataFrame:
    """``items`` with the ``id`` and ``stored_eligible`` of the stored message with the same keys, null where there is none."""
    stored = messages.select(*keys, F.col("id"), F.col("eligible").alias("stored_eligible"))
    return items.join(stored, keys, "left")


def stored_chunk(items: DataFrame, messages: DataFrame, keys: list[str], ordinal: str) -> dict[str, DataFrame]:
    """What storing a chunk of items (keys, ordinal, folder, uid, eligible, body, ...) adds to the store.

    Items with the same keys are one message: fields of the first, eligible if any is, the first body.
    Returns ``messages`` (those that are new), ``promoted`` (ids of stored ones that become eligible), ``locations`` (the
    last item of each folder and uid), ``bodies`` (of new messages that have one) and ``counts`` (one row).
    The same chunk stored twice adds nothing the second time.
    """
    merged = upsert.merged_messages(items, keys, ordinal)
    resolved = known_identities(merged, messages, keys)
    fresh = resolved.where("id is null").drop("id", "stored_eligible")
    promoted = resolved.where("id is not null and eligible and not stored_eligible").select("id")
    locations = upsert.last_of(items.select("folder", "uid", *keys, ordinal), ["folder", "uid"], ordinal)
    bodies = fresh.where("body is not null").select(*keys, "body")
    counts = resolved.agg(
        F.count_if(F.col("id").isNull()).alias("n_new"),
        F.count_if(F.col("id").isNotNull()).alias("n_known"),
        F.count_if(F.col("id").isNotNull() & F.col("eligible") & ~F.col("stored_eligible")).alias("n_promoted"),
        F.count_if(F.col("id").isNull() & F.col("body").isNotNull()).alias("n_bodies"),
    )
    return {"messages": fresh.drop("body"), "promoted": promoted, "locations": locations, "bodies": bodies, "counts": counts}


def with_body_clock(bodies: DataFrame, decisions: DataFrame, keys: list[str]) -> DataFrame:
    """``bodies`` whose expiry starts at the first decision (``decided_at``), if it has not started before."""
    first = decisions.groupBy(*keys).agg(F.min("decided_at").alias("__at"))
    return bodies.join(first, keys, "left").withColumn("expires_at", F.coalesce("expires_at", F.col("__at") + F.expr(RETENTION))).drop("__at")


def restored_bodies(bodies: DataFrame, fetched: DataFrame, decisions: DataFrame, keys: list[str], at) -> DataFrame:
    """The bodies to append: of ``fetched`` what the store lacks; what is decided already expires from ``at`` on."""
    fresh = fetched.dropDuplicates(keys).join(bodies.select(*keys), keys, "left_anti")
    marks = decisions.select(*keys).distinct().withColumn("__decided", F.lit(True))
    return fresh.join(marks, keys, "left").withColumn("expires_at", F.when(F.col("__decided"), at + F.expr(RETENTION))).drop("__decided")


def applied_registry(registry: DataFrame, config: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """The registry after a configuration: its entries enabled with its values, all others disabled with theirs."""
    new = config.select(key, F.struct(*fields).alias("new"))
    old = registry.select(key, F.struct(*fields).alias("old"), "enabled")
    joined = new.join(old, key, "full_outer")
    return joined.select(key, *[F.when(F.col("new").isNotNull(), F.col(f"new.{f}")).otherwise(F.col(f"old.{f}")).alias(f) for f in fields], F.col("new").isNotNull().alias("enabled"))


def renamed(registry: DataFrame, key: str, pairs: DataFrame) -> DataFrame:
    """The registry with keys changed by ``pairs`` (old_key, new_key), which are bounded by the registry; a new key that exists is an error."""
    taken = registry.select(F.col(key).alias("new_key"), F.lit(True).alias("__taken"))
    checked = pairs.join(taken, "new_key", "left").select("old_key", F.when(F.col("__taken"), F.raise_error(F.concat(F.lit("the key is taken: "), "new_key"))).otherwise(F.col("new_key")).alias("new_key"))
    return registry.join(checked, registry[key] == checked["old_key"], "left").withColumn(key, F.coalesce("new_key", key)).drop("old_key", "new_key")


def folder_states(state: DataFrame, backfills: DataFrame, key: str) -> DataFrame:
    """``state`` with ``backfill`` set to a struct or cleared by ``backfills`` (key, backfill); a struct holds all four values or is null."""
    whole = lambda b: F.when(b["since"].isNotNull() & b["cursor"].isNotNull() & b["until"].isNotNull() & b["total"].isNotNull(), b)
    moves = backfills.select(key, F.col("backfill").alias("__new"), F.lit(True).alias("__set"))
    chosen = F.when(F.col("__set"), whole(F.col("__new"))).otherwise(whole(F.col("backfill")))
    return state.join(moves, key, "left").withColumn("backfill", chosen).drop("__new", "__set")


def status_upserted(status: DataFrame, events: DataFrame, key: str) -> DataFrame:
    """The status rows after ``events`` (key, state, at): of each key the latest event, others as they were."""
    return upsert.upsert(status, upsert.last_of(events, [key], ["at", "state"]), [key], ["state", "at"])


def server_identity(host: Column, user: Column, folder: Column) -> Column:
    """A folder on a server as one key: host and user in lower case without white space, no dot at the host's end."""
    bare = lambda c: F.lower(F.trim(c))
    return F.concat_ws("\x1f", F.regexp_replace(bare(host), r"\.$", ""), bare(user), F.trim(folder))


def counted(rows: DataFrame, items: DataFrame, key: str, name: str = "n") -> DataFrame:
    """``rows`` with how many of ``items`` have their key, 0 where there are none; items are counted before they are joined."""
    counts = items.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    return rows.join(counts, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def first_and_more(rows: DataFrame, key: str, id_col: str, n: int = 3, prefix: str = "") -> DataFrame:
    """(key, notice): the ``n`` smallest ids of each key, and how many more there are, as a line of text. A task passes on ``n`` ids of a key, and a count."""
    from pyspark.sql.window import Window

    rank = F.row_number().over(Window.partitionBy(key).orderBy(id_col))
    listed = rows.select(key, id_col).withColumn("__r", rank).where(F.col("__r") <= n).groupBy(key).agg(F.array_sort(F.collect_list(id_col)).alias("ids"))
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    shown = F.array_join(F.transform("ids", lambda i: F.concat(F.lit(prefix), i.cast("string"))), ", ")
    more = F.when(F.col("n") > n, F.concat(F.lit(" and "), (F.col("n") - n).cast("string"), F.lit(" more"))).otherwise("")
    return listed.join(counts, key).select(key, F.concat(shown, more).alias("notice"))
