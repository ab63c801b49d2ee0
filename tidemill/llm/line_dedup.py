"""Line deduplication: a sharded minimal perfect hash over the repeated lines' hashes, probed by the documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, text_of, unused

#: The white space that is stripped from a line's ends, and the letters that are folded (fixed values).
STRIPPED = " \t\n\v\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Keys of a shard, about, and probes of a task where probes are routed to shards.
SHARD_KEYS, TASK_PROBES = 1 << 18, 1 << 20
#: Most bytes of an index that is broadcast; probes are routed to the shards of a larger one.
BROADCAST_BYTES = 64 << 20
#: Bytes of a key in the index, about: fingerprint, count, last holder, its bits of the hash.
KEY_BYTES = 21
#: Bits of a level of the hash for each key that reaches it.
GAMMA = 2
#: Counts of documents are held at this.
MOST_COUNTED = (1 << 32) - 1
#: Stands for a null id: it ranks below all others.
NO_ID = -(1 << 63)

INDEX = "shard int, n long, levels array<int>, words binary, prints binary, counts binary, keepers binary"


def _mixed(h1: np.ndarray, h2: np.ndarray, level: int) -> np.ndarray:
    """A hash of both words for each level."""
    with np.errstate(over="ignore"):
        x = h1 ^ (h2 * np.uint64(0x9E3779B97F4A7C15)) ^ (np.uint64(level + 1) * np.uint64(0xD6E8FEB86659FD93))
        for shift, factor in ((32, 0xD6E8FEB86659FD93), (29, 0xBF58476D1CE4E5B9)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(32))


class PerfectHash:
    """Places 0 to n - 1 for n distinct pairs of hashes; any other pair gets some place, or none (-1).

    A level is a bit array; a key whose bit no other key of the level wants owns it, the others go on to the
    next level. A key's place is the number of set bits before its own.
    """

    def __init__(self, levels, words: np.ndarray) -> None:
        self.levels, self.words = [int(x) for x in levels], words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray) -> PerfectHash:
        levels, words = [], []
        while len(h1):
            bits = -(-GAMMA * len(h1) // 64) * 64
            at = (_mixed(h1, h2, len(levels)) % np.uint64(bits)).astype(np.int64)
            times = np.bincount(at, minlength=bits)
            levels.append(bits)
            words.append(np.packbits(times == 1, bitorder="little").view(np.uint64))
            again = times[at] > 1
            h1, h2 = h1[again], h2[again]
        return cls(levels, np.concatenate(words) if words else np.zeros(0, np.uint64))

    def places(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        found = np.full(len(h1), -1, np.int64)
        left, start = np.arange(len(h1)), 0
        for level, bits in enumerate(self.levels):
            if not len(left):
                break
            at = (_mixed(h1[left], h2[left], level) % np.uint64(bits)).astype(np.int64) + start
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            own = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            found[left[own]] = (self.before[at >> 6] + below)[own]
            left, start = left[~own], start + bits
        return found


class Shard:
    """The arrays of one shard: fingerprints, counts of documents and last holders, each at its key's place."""

    def __init__(self, row) -> None:
        self.hash = PerfectHash(row["levels"], np.frombuffer(row["words"], np.uint64))
        self.prints = np.frombuffer(row["prints"], np.uint64)
        self.counts = np.frombuffer(row["counts"], np.uint32)
        self.keepers = np.frombuffer(row["keepers"], np.int64)

    def dropped(self, h1: np.ndarray, h2: np.ndarray, ids: np.ndarray, min_docs: int) -> np.ndarray:
        """Which probes are of a line that enough documents hold and another document keeps."""
        at = self.hash.places(h1, h2)
        known = at >= 0
        known[known] = self.prints[at[known]] == h2[known]
        at = at[known]
        known[known] = (self.counts[at] >= min_docs) & (self.keepers[at] != ids[known])
        return known


def _lines(text_col: str) -> Column:
    return F.split(text_of(text_col), "\n")


def _key(line: Column) -> Column:
    return F.translate(F.trim(line, F.lit(STRIPPED)), UPPER, LOWER)


def _hashes(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key), F.xxhash64(F.lit(1), key)


def line_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40) -> DataFrame:
    """The sharded index of the lines that more than one row holds: a row for each shard (see INDEX).

    Keys are counted by an aggregate that combines before the shuffle, so a line that every document
    holds fills no task; only two hashes, a count and an id are shuffled. Shards are told by the first hash.
    """
    spark = docs.sparkSession
    keys = F.array_distinct(F.filter(F.transform(_lines(text_col), _key), lambda k: F.length(k) >= min_chars))
    h1, h2 = _hashes(F.col("key"))
    held = (
        docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.explode(keys).alias("key"))
        .select("id", h1.alias("h1"), h2.alias("h2"))
        .groupBy("h1", "h2")
        .agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keeper"))
        .where("n > 1")
    )
    held = materialize(held, "lines")
    shards = max(1, -(-held.count() // SHARD_KEYS))

    def build(group: pa.Table) -> pa.Table:
        h1, h2 = (group[c].to_numpy().view(np.uint64) for c in ("h1", "h2"))
        made = PerfectHash.build(h1, h2)
        order = np.empty(len(h1), np.int64)
        order[made.places(h1, h2)] = np.arange(len(h1))
        row = {
            "shard": int(group["shard"][0].as_py()),
            "n": len(h1),
            "levels": made.levels,
            "words": made.words.tobytes(),
            "prints": h2[order].tobytes(),
            "counts": np.minimum(group["n"].to_numpy()[order], MOST_COUNTED).astype(np.uint32).tobytes(),
            "keepers": group["keeper"].to_numpy()[order].tobytes(),
        }
        return pa.Table.from_pylist([row], schema=out)

    out = pa.schema(
        [("shard", pa.int32()), ("n", pa.int64()), ("levels", pa.list_(pa.int32()))]
        + [(c, pa.binary()) for c in ("words", "prints", "counts", "keepers")]
    )
    sharded = held.withColumn("shard", F.pmod("h1", F.lit(shards)).cast("int"))
    return materialize(sharded.groupBy("shard").applyInArrow(build, INDEX), "line-index")


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 40,
    min_docs: int = 5,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``docs`` with three more columns: n_lines, n_dropped (both long) and kept_text.

    Texts are split at line feeds; null and empty ones are one empty line. A line's key is the line without
    white space at its ends, A to Z as small letters. Keys of at least ``min_chars`` code points that at least
    ``min_docs`` (2 or more) rows hold lose all their lines, except in the row with the largest id that holds it.
    Each row counts as a document, rows with a repeated id too; all rows with the largest id keep their lines. A null
    id ranks below all others, and null ids are equal to each other. A text that loses every line is empty.
    Columns of ``docs`` of these names are replaced; others stay. An empty table gives an empty result.

    Lines that one row alone holds are not in the index: an outsider is told by its 64-bit fingerprint, at a place that
    128 bits of its hash decide, so one that is taken for a member has a chance of 2^-64 a probe. The index is broadcast
    up to ``broadcast_bytes``, and then no text moves; the probes of a larger one (hashes and ids) are routed to the
    shards, in groups of bounded size, and their answers joined to the rows.
    """
    if not 2 <= min_docs <= MOST_COUNTED:
        raise ValueError(f"min_docs must be from 2 to {MOST_COUNTED}")
    docs = docs.drop("n_lines", "n_dropped", "kept_text")
    index = line_index(docs, id_col, text_col, min_chars)
    sizes = index.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("n") * KEY_BYTES).alias("bytes")).first()
    c_lines, c_hash, c_drop = unused(docs, "lines_", "hash_", "drop_")

    def pair(key: Column) -> Column:
        h1, h2 = _hashes(key)
        return F.when(F.length(key) >= min_chars, F.struct(h1.alias("h1"), h2.alias("h2")))

    hashed = docs.withColumn(c_hash, F.transform(F.transform(_lines(text_col), _key), pair))
    if not sizes["n"]:
        marked = docs.withColumn(c_drop, F.lit(None).cast("array<boolean>"))
    elif sizes["bytes"] <= broadcast_bytes:
        marked = _probe_where_they_are(hashed, index, id_col, c_hash, c_drop, min_docs)
    else:
        marked = _probe_at_shards(hashed, index, sizes["n"], id_col, text_col, c_hash, c_drop, min_docs)
    lines, flags = F.col(c_lines), F.col(c_drop)
    kept = F.array_join(F.filter(lines, lambda x, i: ~flags[i]), "\n")
    return (
        marked.drop(c_hash)
        .withColumn(c_lines, _lines(text_col))
        .withColumn("n_lines", F.size(c_lines).cast("long"))
        .withColumn("n_dropped", F.when(flags.isNull(), 0).otherwise(F.size(F.filter(flags, lambda x: x))).cast("long"))
        .withColumn("kept_text", F.when(flags.isNull(), text_of(text_col)).otherwise(kept))
        .drop(c_lines, c_drop)
    )


def _probe_where_they_are(hashed: DataFrame, index: DataFrame, id_col: str, c_hash: str, c_drop: str, min_docs: int) -> DataFrame:
    """A column of flags, one for each line that goes; null where none goes."""
    sent = hashed.sparkSession.sparkContext.broadcast([r.asDict() for r in index.collect()])

    n_shards = _shard_count(index)

    @F.arrow_udf(T.ArrayType(T.BooleanType()))
    def probe(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        shards = {row["shard"]: Shard(row) for row in sent.value}
        for ids, hashes in batches:
            lengths = np.diff(hashes.offsets.to_numpy())
            flat = hashes.flatten()
            there = np.flatnonzero(np.asarray(flat.is_valid()))
            h1, h2 = (flat.field(c).take(pa.array(there)).to_numpy() for c in (0, 1))
            own = np.repeat(ids.to_numpy(), lengths)[there]
            shard, flags = h1 % n_shards, np.zeros(len(flat), bool)
            for s in np.unique(shard):
                if s in shards:
                    at = np.flatnonzero(shard == s)
                    flags[there[at]] = shards[s].dropped(h1[at].view(np.uint64), h2[at].view(np.uint64), own[at], min_docs)
            yield _flag_lists(flags, lengths)

    key = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    return hashed.withColumn(c_drop, probe(key, F.col(c_hash)))


def _flag_lists(flags: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """A list of flags for each row, null where none of them is set."""
    row = np.repeat(np.arange(len(lengths)), lengths)
    some = np.zeros(len(lengths), bool)
    some[row[flags]] = True
    offsets = np.concatenate([[0], np.cumsum(np.where(some, lengths, 0))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flags[some[row]]), mask=pa.array(~some))


def _shard_count(index: DataFrame) -> int:
    return max(1, -(-index.agg(F.sum("n")).first()[0] // SHARD_KEYS))


def _probe_at_shards(
    hashed: DataFrame, index: DataFrame, n_rows: int, id_col: str, text_col: str, c_hash: str, c_drop: str, min_docs: int
) -> DataFrame:
    """The same flags, from probes that go to their shards in groups of about TASK_PROBES.

    An answer depends on the id and the text alone, so rows are known by the id and 128 bits of the text.
    """
    shards = _shard_count(index)
    c_row = unused(hashed, "row_")[0]
    d1, d2 = F.xxhash64(text_of(text_col)), F.xxhash64(F.lit(1), text_of(text_col))
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    hashed = hashed.withColumn(c_row, F.struct(key.alias("id"), d1.alias("d1"), d2.alias("d2")))
    probes = (
        hashed.select(F.col(c_row).alias("row"), F.size(c_hash).alias("of"), F.posexplode(c_hash))
        .where("col is not null")
        .select(F.col("row.*"), "of", "pos", "col.*", F.pmod("col.h1", F.lit(shards)).cast("int").alias("shard"))
    )
    probes = materialize(probes, "line-probes")
    groups = probes.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / TASK_PROBES).cast("int").alias("groups"))
    groups = materialize(groups, "line-probe-groups")
    dealt = probes.join(groups if n_rows > 1_000_000 else F.broadcast(groups), "shard").withColumn(
        "deal", F.pmod(F.xxhash64("d1", "d2", "pos"), F.col("groups")).cast("int")
    )
    copies = index.join(groups, "shard").withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).drop("groups")
    out = pa.schema([("id", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("of", pa.int32()), ("pos", pa.int32())])

    def answer(asked: pa.Table, arrays: pa.Table) -> pa.Table:
        if not arrays.num_rows or not asked.num_rows:
            return out.empty_table()
        shard = Shard(arrays.to_pylist()[0])
        h1, h2 = (asked[c].to_numpy().view(np.uint64) for c in ("h1", "h2"))
        return asked.select(out.names).filter(pa.array(shard.dropped(h1, h2, asked["id"].to_numpy(), min_docs))).cast(out)

    @F.arrow_udf(T.ArrayType(T.BooleanType()))
    def flags_at(places: pa.Array, of: pa.Array) -> pa.Array:
        lengths = of.to_numpy().astype(np.int64)
        start = np.cumsum(lengths) - lengths
        flags = np.zeros(int(lengths.sum()), bool)
        flags[np.repeat(start, np.diff(places.offsets.to_numpy())) + places.flatten().to_numpy()] = True
        return _flag_lists(flags, lengths)

    gone = (
        dealt.groupBy("shard", "deal")
        .cogroup(copies.groupBy("shard", "deal"))
        .applyInArrow(answer, "id long, d1 long, d2 long, of int, pos int")
        .groupBy("id", "d1", "d2")
        .agg(F.collect_set("pos").alias("pos"), F.first("of").alias("of"))
        .select(F.struct("id", "d1", "d2").alias(c_row), flags_at("pos", "of").alias(c_drop))
    )
    return hashed.join(gone, c_row, "left").drop(c_row)
