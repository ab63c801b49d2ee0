"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, materialize, skewed_join, text_of


def normalized(text_col: str = "text"):
    """The text with every run of white space as one space; null counts as empty."""
    return F.regexp_replace(text_of(text_col), SPACE, " ")


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    prefix_chars: int = 64,
    digest_all: bool = False,
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Rows are grouped by the length of their normalised text, those that share a length by a hash of
    the first ``prefix_chars`` characters, and only those that share both by the SHA-256 of the whole
    text. Of a group the row with the smallest id stays; a null id ranks last, and of repeated rows
    with the same id one stays. Null and empty texts are equal to each other. Columns other than the
    id and the text are ignored. An empty table gives an empty result.

    The full hash is read for the survivors of the first two steps only; ``digest_all`` asks for it
    in every row (it is null in the others otherwise). Only ids, lengths and hashes are shuffled,
    never texts, every group is counted by an aggregate that combines before the shuffle, and the rows
    of hot groups are joined where they are, so a group that holds a third of all rows fills no task.
    """
    norm = normalized(text_col)
    cuts = [F.length(norm).alias("n"), F.xxhash64(F.substring(norm, 1, prefix_chars)).alias("p")]
    row = [F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("rid")]
    digest = F.sha2(norm, 256)
    narrow = materialize(
        docs.select(*row, *cuts, (digest if digest_all else F.lit(None).cast("string")).alias("text_sha256")), "dedup"
    )
    # lengths with more than one row, then of those the prefixes: both from one count that combines before the shuffle
    prefixes = narrow.groupBy("n", "p").agg(F.count(F.lit(1)).alias("rows"))
    lengths = prefixes.groupBy("n").agg(F.sum("rows").alias("of_length")).where("of_length > 1")
    prefixes = materialize(prefixes.where("rows > 1").join(lengths, "n", "left_semi"), "dedup-keys")
    marked = materialize(skewed_join(narrow, prefixes, ["n", "p"], "rows", "left"), "dedup-marked")
    alone = marked.where("rows is null")
    if digest_all:
        survivors = marked.where("rows is not null").drop("rows")
    else:
        small = prefixes.count() <= BROADCAST_KEYS
        survivors = materialize(
            docs.select(*row, *cuts, norm.alias("norm"))
            .join(F.broadcast(prefixes.select("n", "p")) if small else prefixes.select("n", "p"), ["n", "p"], "left_semi")
            .select("doc_id", "rid", F.sha2("norm", 256).alias("text_sha256")),
            "dedup-full",
        )
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "rid")
    groups = survivors.groupBy("text_sha256").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("group_size"))
    grouped = skewed_join(survivors, materialize(groups, "dedup-groups"), ["text_sha256"], "group_size").select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        (F.col("first.rid") == F.col("rid")).alias("kept"),
        "text_sha256",
    )
    singles = alone.select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    return singles.unionByName(grouped)


#: Most keys (24 bytes each) of surviving groups that are broadcast; beyond it they are joined by shuffle.
BROADCAST_KEYS = 500_000
