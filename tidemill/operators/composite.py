"""Operations that are several writes at once: storing a chunk of messages, recording decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import trace, upsert
from .store import RETENTION

LOCATION = ["folder", "uidvalidity", "uid"]


def store_chunk(items: DataFrame, messages: DataFrame, locations: DataFrame, bodies: DataFrame, decisions: DataFrame, at, promote: bool = False) -> dict[str, DataFrame]:
    """The store after a chunk of ``items``: ``messages``, ``locations``, ``bodies`` whole, and ``counts``, one row of five counters.

    An item has identity, ordinal, folder, uidvalidity, uid, generation, eligible, body and any more fields, which messages (identity, eligible, the
    same fields) keep; locations have identity, LOCATION, generation, removed_at, removed_reason; bodies identity, body, expires_at; decisions identity.

    * Items of one identity are one message: fields of the first, eligible if any is, the first body that is not null.
    * A message that is stored stays as it is; with ``promote`` one that is historical becomes eligible if an item is.
    * Of items at one place the last counts. A place that is known is live again under the item's generation, but keeps its message.
    * Only an eligible message gets a body, once. One that is decided already gives its body an expiry, a retention after ``at``; others have none yet.

    Stored twice, a chunk adds nothing the second time. Chunks are joined to the store by key; groups combine before the shuffle.
    """
    clock = F.lit(at).cast("timestamp")
    merged = upsert.merged_messages(items.drop(*LOCATION, "generation"), ["identity"], "ordinal").drop("ordinal")
    old = messages.select("identity", F.col("eligible").alias("__old"))
    known = merged.join(old, "identity", "left")
    fresh = F.col("__old").isNull()
    raised = ~fresh & F.col("eligible") & ~F.col("__old") & F.lit(promote)
    resolved = known.withColumns({"__fresh": fresh, "__raised": raised, "__eligible": F.when(fresh, F.col("eligible")).otherwise(F.col("__old") | raised)})

    raise_ = resolved.where("__raised").select("identity", F.lit(True).alias("__up"))
    kept = messages.join(raise_, "identity", "left").withColumn("eligible", F.col("eligible") | F.coalesce("__up", F.lit(False))).drop("__up")
    new = resolved.where("__fresh").select(*[c for c in messages.columns])

    placed = upsert.last_of(items.select(*LOCATION, "identity", "generation", "ordinal"), LOCATION, "ordinal").drop("ordinal")
    both = locations.select(*LOCATION, F.struct("identity", "generation", "removed_at", "removed_reason").alias("was")).join(
        placed.select(*LOCATION, F.struct("identity", "generation").alias("now")), LOCATION, "full_outer"
    )
    again = F.col("now").isNotNull()
    after = both.select(
        *LOCATION,
        F.coalesce("was.identity", "now.identity").alias("identity"),
        F.when(again, F.col("now.generation")).otherwise(F.col("was.generation")).alias("generation"),
        F.when(~again, F.col("was.removed_at")).alias("removed_at"),
        F.when(~again, F.col("was.removed_reason")).alias("removed_reason"),
        F.col("was").isNull().alias("__inserted"),
    )

    decided = decisions.select("identity").distinct().withColumn("__decided", F.lit(True))
    given = resolved.where("__eligible and body is not null").select("identity", "body").join(bodies.select("identity"), "identity", "left_anti")
    added = given.join(decided, "identity", "left").select("identity", "body", F.when(F.col("__decided"), clock + F.expr(RETENTION)).alias("expires_at"))
    counted = resolved.agg(F.count_if("__fresh").alias("inserted_messages"), F.count_if(~F.col("__fresh")).alias("existing_messages"), F.count_if("__raised").alias("promoted_messages"))
    counts = counted.crossJoin(after.agg(F.count_if("__inserted").alias("inserted_locations"))).crossJoin(added.agg(F.count(F.lit(1)).alias("inserted_bodies")))  # one row each
    return {
        "messages": kept.unionByName(new),
        "locations": after.drop("__inserted").select(*locations.columns),
        "bodies": bodies.unionByName(added),
        "counts": counts,
    }


def decision_checks(spans: str = "spans") -> dict[str, Column]:
    """All that a decision has to meet before it is stored: the checks of its row, of its trace, and of both together."""
    row = trace.decision_row_checks()
    row.pop("spans")  # a trace here is an array of spans, not a text
    layout, agree = trace.span_checks(F.col(spans)), trace.consistency_checks(F.col(spans))
    return {**{f"row.{k}": v for k, v in row.items()}, **{f"span.{k}": v for k, v in layout.items()}, **{f"both.{k}": v for k, v in agree.items()}}


def record_decisions(made: DataFrame, decisions: DataFrame, bodies: DataFrame, key: str = "message_id", tie: str = "id") -> dict[str, DataFrame]:
    """The store after decisions are ``made``: ``decisions`` and ``bodies`` whole, and ``refused`` with the names of what each breaks.

    A decision is stored only if it meets every check and the message has no other one by the worker: of several in ``made`` the earliest
    (decided_at, then ``tie``) counts, and only one that meets the checks; reruns are appended. A message's first stored decision starts its body's clock where none
    runs; no later one moves it. All three follow from one reading of what is allowed, so a decision is never stored without its clock.
    """
    checks = decision_checks()
    broken = F.filter(F.array(*[F.when(~ok, F.lit(name)) for name, ok in checks.items()]), lambda x: x.isNotNull())
    judged = made.withColumn("__broken", broken)
    by_worker = F.col("decided_by") == "worker"
    first = judged.where(by_worker & (F.size("__broken") == 0)).groupBy(key).agg(F.min(F.struct("decided_at", tie)).alias("__first"))
    before = decisions.where(by_worker).select(key).distinct().withColumn("__before", F.lit(True))
    placed = judged.join(first, key, "left").join(before, key, "left")
    repeated = by_worker & (F.size("__broken") == 0) & (F.coalesce("__before", F.lit(False)) | (F.struct("decided_at", tie) != F.col("__first")))
    named = placed.withColumn("broken", F.when(repeated, F.array(F.lit("worker"))).otherwise(F.col("__broken")))
    allowed = named.where(F.size("broken") == 0).select(*made.columns)
    starts = allowed.groupBy(key).agg(F.min("decided_at").alias("__at"))
    dated = bodies.join(starts, key, "left").withColumn("expires_at", F.coalesce("expires_at", F.col("__at") + F.expr(RETENTION))).drop("__at")
    return {"decisions": decisions.unionByName(allowed), "bodies": dated.select(*bodies.columns), "refused": named.where(F.size("broken") > 0).select(*made.columns, "broken")}
