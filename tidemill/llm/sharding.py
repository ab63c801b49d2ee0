"""Sharding by a two-pass external shuffle."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import unused


#: Most partitions that the buckets are dealt to.
PARTITIONS = 20_000
#: Buckets up to which a row for each, and the keys of repeated rows, at most two a bucket, are broadcast.
HOT_ROWS = 500_000


def row_bytes(text_col: str = "text"):
    """UTF-8 bytes of the text (null: none) plus 16."""
    return F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long") + F.lit(16)


def external_shuffle(
    df: DataFrame,
    n_shards: int = 40,
    seed: int = 20240131,
    key_cols: tuple[str, ...] | None = None,
    size_col: str | Column | None = None,
    bucket_bytes: int = 16 << 20,
    bucket_rows: int = 1 << 18,
) -> DataFrame:
    """``df`` with two more columns, ``shard`` (0 to n_shards - 1) and ``slot`` (its place there).

    Pass one scatters the rows by a seeded hash into buckets that fit a task's memory: their number
    follows from the rows of ``df`` and their bytes by ``size_col`` (a column or an expression; without one, 16 a row). Pass two shuffles each bucket with a seeded
    Fisher-Yates shuffle. The buckets, one after the other, are one random order of all rows; the
    shards are its cuts into equal parts, so that their counts are at most one apart.

    The order depends on ``seed`` and on the rows, not on how they were partitioned: a bucket is put
    into the order of its rows' hashes before it is shuffled. Rows that are equal in all of
    ``key_cols`` (by default, all columns) hash alike and share a bucket, unless there are more than half
    a bucket of them: then each is dealt by its place in the input, so that no bucket outgrows memory; such
    rows may change places among themselves if the input is partitioned otherwise. Nulls hash like any value;
    columns of ``df`` named shard or slot are replaced. An empty table gives an empty result.
    """
    df = df.drop("shard", "slot")
    cols = list(key_cols or df.columns)
    c_key, c_bucket, c_base, c_times, c_n = unused(df, "__key", "__bucket", "__base", "__times", "__n")
    key = F.xxhash64(F.lit(seed), *[F.col(c) for c in cols])
    size = F.lit(16) if size_col is None else F.col(size_col) if isinstance(size_col, str) else size_col
    keyed = df.withColumn(c_key, key)
    totals = df.select(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("b")).first()
    n_buckets = max(1, -(-int(totals["b"]) // bucket_bytes), -(-int(totals["n"]) // bucket_rows))
    # equal rows hash alike: those that would fill a bucket are dealt one by one; at most 2 n / bucket_rows keys are so many
    hot = keyed.groupBy(c_key).agg(F.count(F.lit(1)).alias(c_times)).where(F.col(c_times) > bucket_rows // 2)
    marked = keyed.join(F.broadcast(hot) if int(totals["n"]) <= HOT_ROWS * bucket_rows else hot, c_key, "left")
    place = F.when(F.col(c_times).isNull(), F.xxhash64(F.lit(seed + 1), c_key)).otherwise(F.xxhash64(F.lit(seed + 2), F.monotonically_increasing_id()))
    bucketed = marked.withColumn(c_bucket, F.pmod(place, F.lit(n_buckets))).drop(c_times)
    counts = bucketed.groupBy(c_bucket).agg(F.count(F.lit(1)).alias(c_n))
    upto = Window.orderBy(c_bucket).rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(c_bucket, F.coalesce(F.sum(c_n).over(upto), F.lit(0)).alias(c_base))
    total = int(totals["n"])
    out = T.StructType(
        [*df.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())]
    )
    kept = df.columns

    def pass_two(group: pa.Table) -> pa.Table:
        order = np.argsort(group[c_key].to_numpy(), kind="stable")
        bucket, base = group[c_bucket][0].as_py(), group[c_base][0].as_py()
        rng = np.random.default_rng((seed, bucket))
        rng.shuffle(order)  # numpy's in-place Fisher-Yates
        at = base + np.arange(len(order), dtype=np.int64)
        shard = at * n_shards // total
        start = -(-shard * total // n_shards)
        rows = group.select(kept).take(pa.array(order))
        del group
        pa.default_memory_pool().release_unused()
        return rows.append_column("shard", pa.array(shard.astype(np.int32))).append_column("slot", pa.array(at - start))

    return (
        bucketed.repartition(min(n_buckets, PARTITIONS), c_bucket)
        .join(F.broadcast(bases) if n_buckets <= HOT_ROWS else bases, c_bucket)
        .groupBy(c_bucket, c_base)
        .applyInArrow(pass_two, out)
    )


def write_shards(sharded: DataFrame, path: str, file_rows: int = 1 << 20) -> None:
    """Write the rows of ``external_shuffle`` as Parquet, a folder for each shard, in files of about ``file_rows`` rows, each ordered by slot.

    Ranges of (shard, slot) are dealt to tasks, so a large shard is written by several.
    """
    n = sharded.count()
    (
        sharded.repartitionByRange(max(1, -(-n // file_rows)), "shard", "slot")
        .sortWithinPartitions("shard", "slot")
        .write.mode("overwrite")
        .partitionBy("shard")
        .parquet(path)
    )
