"""The keys that a stream has stored, in hash buckets: what a batch reads does not grow with the number of batches before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import workspace

KEYS = "h1 long, h2 long, batch long"
#: A row of the filter: 256 bits of the keys that fall on one block of a bucket.
FILTER = "block long, w0 long, w1 long, w2 long, w3 long"
#: Keys for each block of the filter: 10 bits a key.
BLOCK_KEYS = 25
#: Bits that a key sets in its block.
BITS = 6
#: Most keys of a batch that are broadcast.
BROADCAST_KEYS = 1_000_000
#: Tasks of a compaction; a bucket is written by one.
MERGE_TASKS = 64


class KeyTable:
    """Keys under ``path``, known by 128 bits of their hash, in ``buckets`` by the first of the two hashes.

    A batch adds a small table (``delta``) of its own number, which it overwrites if it runs again. After ``fan`` of them a
    compaction merges those of earlier batches into the buckets that they touch: a new folder with the
    bucket's keys, ordered by hash, and with its Bloom filter. A small table names each bucket's folder; its version is switched by one empty file,
    so that readers see a compaction whole or not at all.

    A lookup opens the deltas (at most ``fan``), the filters of the buckets that the batch's keys fall in, and the keys of those buckets for which a
    filter says perhaps. The number of files depends on the buckets touched, never on how many batches came before.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, fan: int = 8) -> None:
        self.spark, self.path, self.buckets, self.fan = spark, path, buckets, fan

    def _bucket(self) -> Column:
        return F.pmod("h1", F.lit(self.buckets))

    @staticmethod
    def hashed(rows: DataFrame, keys: list[str]) -> DataFrame:
        """``rows`` with the key's two hashes; nulls are values like any other."""
        named = [F.concat_ws(":", F.lit(i), F.col(k).isNull().cast("string"), F.col(k).cast("string")) for i, k in enumerate(keys)]
        return rows.withColumns({"h1": F.xxhash64(*named), "h2": F.xxhash64(F.lit(1), *named)})

    # --- files

    def folders(self) -> dict[int, str]:
        """Where each bucket's keys are: at most a name for each bucket."""
        version = workspace.committed(self.spark, f"{self.path}/commits")
        if not version:
            return {}
        rows = self.spark.read.schema("bucket long, folder string").parquet(f"{self.path}/buckets/version={version}").collect()
        return {r["bucket"]: r["folder"] for r in rows}

    def _merged_upto(self) -> int:
        """The last batch that compactions have merged."""
        version = workspace.committed(self.spark, f"{self.path}/commits")
        return int(workspace.names(self.spark, f"{self.path}/upto/version={version}")[0]) if version else -1

    def _deltas(self, before: int) -> list[int]:
        merged = self._merged_upto()
        return [b for b in workspace.numbers(self.spark, f"{self.path}/delta", "batch=") if merged < b < before]

    def _read(self, schema: str, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    # --- lookups

    @staticmethod
    def _block(blocks: Column) -> Column:
        return F.pmod(F.shiftrightunsigned("h1", 8), blocks)

    @staticmethod
    def _bits() -> list[Column]:
        """The places of a key in its block, 0 to 255, from the second hash."""
        return [F.shiftrightunsigned("h2", 8 * i).bitwiseAND(F.lit(255)) for i in range(BITS)]

    def _perhaps(self, keys: DataFrame, folders: dict[int, str]) -> DataFrame:
        """The keys that their bucket's filter does not rule out; ``keys`` has a bucket."""
        filters = self._read(f"{FILTER}, bucket long, blocks long", [f"{p}/filter" for p in folders.values()])
        sizes = F.broadcast(filters.groupBy("bucket").agg(F.max("blocks").alias("blocks")))
        placed = keys.join(sizes, "bucket").withColumn("block", self._block(F.col("blocks"))).drop("blocks")
        joined = placed.join(filters.drop("blocks"), ["bucket", "block"])

        def word(bit: Column) -> Column:
            return F.element_at(F.array("w0", "w1", "w2", "w3"), (F.shiftrightunsigned(bit, 6) + 1).cast("int"))

        for bit in self._bits():
            joined = joined.where(F.getbit(word(bit), bit.bitwiseAND(F.lit(63)).cast("int")) == 1)
        return joined.select("h1", "h2", "bucket")

    def known(self, keys: DataFrame, before: int) -> DataFrame:
        """Which of ``keys`` (h1, h2) batches before ``before`` stored. ``keys`` is a table of the batch's size and is read several times."""
        asked = keys.select("h1", "h2").distinct().withColumn("bucket", self._bucket())
        small = asked.count() <= BROADCAST_KEYS
        lookup = F.broadcast(asked) if small else asked
        recent = self._read(KEYS, [f"{self.path}/delta/batch={b}" for b in self._deltas(before)])
        found = recent.where(F.col("batch") < before).join(lookup, ["h1", "h2"], "left_semi").select("h1", "h2")
        folders = self.folders()
        touched = {r[0] for r in asked.select("bucket").distinct().collect()} & set(folders)  # at most one row a bucket
        perhaps = self._perhaps(lookup, {b: folders[b] for b in touched})
        likely = {r[0] for r in perhaps.select("bucket").distinct().collect()}
        stored = self._read(KEYS, [f"{folders[b]}/keys" for b in sorted(likely)])
        old = stored.where(F.col("batch") < before).join(F.broadcast(perhaps) if small else perhaps, ["h1", "h2"], "left_semi").select("h1", "h2")
        return found.unionByName(old).distinct()

    # --- writes

    def add(self, keys: DataFrame, batch: int) -> None:
        """Note the keys (h1, h2) of ``batch``; a second run of the batch overwrites the first."""
        keys.select("h1", "h2", F.lit(batch).cast("long").alias("batch")).distinct().coalesce(1).write.mode("overwrite").parquet(f"{self.path}/delta/batch={batch}")

    def compact(self, before: int) -> bool:
        """Merge the deltas of batches before ``before`` once there are ``fan`` of them; a batch that may run again is never merged."""
        spark, deltas = self.spark, self._deltas(before)
        if len(deltas) < self.fan:
            return False
        version = workspace.committed(spark, f"{self.path}/commits") + 1
        folders, home = self.folders(), f"{self.path}/data/version={version}"
        fresh = self._read(KEYS, [f"{self.path}/delta/batch={b}" for b in deltas]).withColumn("bucket", self._bucket())
        counts = {r[0]: r[1] for r in fresh.groupBy("bucket").count().collect()}  # at most one row a bucket
        old = self._read(KEYS, [f"{folders[b]}/keys" for b in counts if b in folders]).withColumn("bucket", self._bucket())
        merged = old.unionByName(fresh).groupBy("bucket", "h1", "h2").agg(F.min("batch").alias("batch"))
        work = f"{self.path}/work"
        ordered = merged.repartition(min(len(counts), MERGE_TASKS), "bucket").sortWithinPartitions("bucket", "h1")
        ordered.withColumn("part", F.col("bucket")).write.mode("overwrite").partitionBy("part").parquet(work)
        keys = spark.read.schema("h1 long, h2 long, bucket long").parquet(work)
        sizes = F.broadcast(keys.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / BLOCK_KEYS).cast("long").alias("blocks")))
        bit = F.explode(F.array(*self._bits()))
        words = [F.bit_or(F.when(F.shiftrightunsigned("bit", 6) == w, F.expr("shiftleft(1L, cast(bit & 63 as int))")).otherwise(F.lit(0).cast("long"))).alias(f"w{w}") for w in range(4)]
        placed = keys.join(sizes, "bucket").withColumn("block", self._block(F.col("blocks"))).select("bucket", "blocks", "block", bit.alias("bit"))
        filters = placed.groupBy("bucket", "blocks", "block").agg(*words)
        filters = filters.repartition(min(len(counts), MERGE_TASKS), "bucket").withColumn("part", F.col("bucket"))
        filters.write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/work-filter")
        for b in counts:
            for kind, made in (("keys", work), ("filter", f"{self.path}/work-filter")):
                workspace.move(spark, f"{made}/part={b}", f"{home}/bucket={b}/{kind}")
        folders |= {b: f"{home}/bucket={b}" for b in counts}
        listed = spark.createDataFrame(sorted(folders.items()), "bucket long, folder string")
        listed.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/buckets/version={version}")
        workspace.delete(spark, f"{self.path}/upto/version={version}")
        workspace.touch(spark, f"{self.path}/upto/version={version}/{max(deltas)}")
        if not workspace.commit(spark, f"{self.path}/commits", version):
            raise RuntimeError(f"another writer committed version {version}")
        return True
