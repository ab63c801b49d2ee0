"""Work that waits for a decision: messages that are live, eligible and undecided, with their bodies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.mail import display_name
from .scope import keyset_before, newest


def with_decided(messages: DataFrame, decisions: DataFrame, keys: list[str]) -> DataFrame:
    """``messages`` with ``decided``: whether a decision with the same keys exists (a mark join)."""
    marks = decisions.select(*keys).distinct().withColumn("__mark", F.lit(True))
    return messages.join(marks, keys, "left").withColumn("decided", F.col("__mark").isNotNull()).drop("__mark")


def with_body(messages: DataFrame, bodies: DataFrame, keys: list[str]) -> DataFrame:
    """``messages`` with ``body``: the body row as a struct, null where there is none."""
    rest = [c for c in bodies.columns if c not in keys]
    held = bodies.select(*keys, F.struct(*rest).alias("body"))
    return messages.join(held, keys, "left")


def live(locations: DataFrame) -> DataFrame:
    return locations.where(F.col("removed_at").isNull())


def pending(messages: DataFrame, locations: DataFrame, decisions: DataFrame, keys: list[str], since=None, time_col: str = "internal_date") -> DataFrame:
    """Messages with a live location and no decision, from ``since`` on; the time filter reaches the scan."""
    if since is not None:
        messages = messages.where(F.col(time_col) >= F.lit(since).cast(messages.schema[time_col].dataType))
    return messages.join(locations.select(*keys).distinct(), keys, "left_semi").join(decisions.select(*keys).distinct(), keys, "left_anti")


def candidate_page(messages, bodies, locations, decisions, keys, n: int, since=None, time_col: str = "internal_date", id_col: str = "id", ids=None, before=None, pending_only: bool = True) -> DataFrame:
    """The ``n`` newest messages that meet all that is asked for, with ``decided`` and their bodies; bodies are joined to the page alone.

    ``messages`` are live where ``locations`` has them, and eligible where a column says so; ``since`` and ``before`` (a time and an id: the last of the page before) are bounds on
    the time that reach the scan, ``ids`` a DataFrame with ``id_col``, or a list of ids (an empty one is an empty page). With ``pending_only`` decided messages are left out.
    """
    if ids is not None and not isinstance(ids, DataFrame):
        kind = messages.schema[id_col].dataType.simpleString()
        ids = messages.sparkSession.createDataFrame([(i,) for i in ids], f"{id_col} {kind}")
    if "eligible" in messages.columns:
        messages = messages.where("eligible")
    if before is not None:
        messages = messages.where(keyset_before(time_col, id_col, *before))
    if ids is not None:
        messages = messages.join(ids.select(id_col).distinct(), id_col, "left_semi")
    wanted = pending(messages, locations, decisions.limit(0) if not pending_only else decisions, keys, since, time_col)
    page = newest(wanted, time_col, id_col, n)
    return with_body(with_decided(page, decisions, keys), bodies, [k for k in keys if k in bodies.columns] or keys)


def projected(page: DataFrame) -> DataFrame:
    """(id, matchable, untrusted) of candidates: what the rules compare, and what a prompt may show behind its fence.

    ``page`` has id, from_address, from_domain, subject, headers (map<string, array<string>>), attachments (array<struct<name, ...>>) and body (struct<text, ...>, null without one). The rules see the
    stored address, domain, subject and text, nulls as they are, and never a name or another header. A prompt gets no nulls but for the name, which is that of the first From header; attachments
    without a name are left out.
    """
    c = F.col
    empty = lambda x: F.coalesce(x, F.lit(""))
    sender = F.get(F.try_element_at("headers", F.lit("from")), F.lit(0))
    names = F.coalesce(F.filter(F.transform("attachments", lambda a: a["name"]), lambda n: n.isNotNull()), F.array().cast("array<string>"))
    matchable = F.struct("from_address", "from_domain", "subject", c("body.text").alias("body"))
    untrusted = F.struct(
        empty(c("from_address")).alias("from_address"), display_name(sender).alias("from_name"), empty(c("subject")).alias("subject"), names.alias("attachment_names"), empty(c("body.text")).alias("body")
    )
    return page.select("id", matchable.alias("matchable"), untrusted.alias("untrusted"))
