"""Chat formatting: conversations that only prefix longer ones are collapsed, the rest rendered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LANES = ("a", "b", "c", "d")


def _digest():
    return F.sha2(F.concat_ws("\x01", F.when(F.col("text").isNull(), "-").otherwise("+"), F.col("text")), 256)


def keyed_turns(conversations: DataFrame) -> DataFrame:
    """conv_key, conv_id, turn, role, text: a turn without a conv_id is a conversation of its own, and equal ones of these are one."""
    turns = conversations.select("conv_id", "turn", "role", "text")
    named = turns.where("conv_id is not null").select(F.concat(F.lit("+"), F.col("conv_id").cast("string")).alias("conv_key"), "*")
    loose = turns.where("conv_id is null").groupBy("role", _digest().alias("digest")).agg(F.first("text").alias("text"), F.min("turn").alias("turn"))
    key = F.concat_ws("\x01", F.lit("-"), F.col("digest"), F.when(F.col("role").isNotNull(), "+"), F.col("role"))
    kind = turns.schema["conv_id"].dataType
    return named.unionByName(loose.select(key.alias("conv_key"), F.lit(None).cast(kind).alias("conv_id"), "turn", "role", "text"))


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """conv_key, conv_id, pos (place of the turn, from 1), last (the number of turns) and four running sums a to d of the hashes of the turns so far.

    The hash of a turn covers its place, role and text, so the sums tell prefixes apart as an ordered
    hash would; they roll forward by one addition for each turn. Texts are not part of the windows.
    """
    order = Window.partitionBy("conv_key").orderBy("turn", "role", "digest")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    placed = turns.select("conv_key", "conv_id", "turn", "role", _digest().alias("digest")).withColumn("pos", F.row_number().over(order))
    hashed = placed.withColumn(
        "h", F.md5(F.concat_ws("\x01", F.col("pos").cast("string"), F.coalesce(F.concat(F.lit("+"), "role"), F.lit("-")), "digest"))
    )
    for i, lane in enumerate(LANES):
        part = F.conv(F.substring("h", 1 + 8 * i, 8), 16, 10).cast("long")
        hashed = hashed.withColumn(lane, F.sum(part).over(so_far))
    return hashed.select("conv_key", "conv_id", "pos", F.count(F.lit(1)).over(Window.partitionBy("conv_key")).alias("last"), *LANES)


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """conv_key, conv_id and n_turns of the conversations that are no prefix of a longer one; of equal ones, the smallest id, none last."""
    hashes = prefix_hashes(turns)
    first = F.min(F.struct(F.col("conv_id").isNull().alias("none"), "conv_id", "conv_key")).alias("first")
    whole = hashes.where("pos = last").groupBy("pos", *LANES).agg(first)
    inner = hashes.where("pos < last").select("pos", *LANES).distinct()
    return whole.join(inner, ["pos", *LANES], "left_anti").select("first.conv_key", "first.conv_id", F.col("pos").cast("long").alias("n_turns"))


def format_chats(conversations: DataFrame, start: str = "<|{role}|>\n", end: str = "\n") -> DataFrame:
    """conv_id, n_turns and text of each conversation that stays, its turns rendered in order.

    Turns are put in order by turn, then role, then text; a null turn comes first. Null role or text
    renders as empty, and a null is not equal to an empty string when conversations are compared.
    A turn with a null conv_id is a conversation of its own, and equal conversations leave the one with
    the smallest id. Repeated turns count as turns. Extra columns are ignored; an empty table gives an
    empty result. A conversation becomes one string, so its own turns meet in one task; nothing else
    does, and windows and joins carry only hashes.
    """
    turns = keyed_turns(conversations)
    keep = maximal_conversations(turns)
    role = F.coalesce("role", F.lit(""))
    before, after = start.split("{role}")
    piece = F.concat(F.lit(before), role, F.lit(after), F.coalesce("text", F.lit("")), F.lit(end))
    rendered = turns.select("conv_key", F.struct("turn", "role", _digest().alias("digest"), piece.alias("piece")).alias("t"))
    kept = rendered.join(keep, "conv_key").groupBy("conv_key", "conv_id", "n_turns")
    text = F.array_join(F.transform(F.array_sort(F.collect_list("t")), lambda t: t["piece"]), "")
    return kept.agg(text.alias("text")).drop("conv_key")
