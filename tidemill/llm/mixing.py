"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import HOT_KEYS, WORD, materialize, text_of, unused

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (3, 1, 2)
#: Most partitions that the table of blocks is spread over.
PARTITIONS = 20_000


def source_targets(sources: DataFrame, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Adds ``target`` to rows of (source, source_size): by weight, ``cap`` times the size at most.

    The targets share ``share`` times all sizes; what a source cannot take is shared anew among the
    others. With the sources in the order of size over weight, level k is the common level if all
    before k stop at their cap; the level that holds is the highest of them.
    """
    everywhere = Window.partitionBy()
    order = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    ranked = sources.withColumn("weight", weight).withColumn("ratio", F.lit(cap) * F.col("source_size") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", F.col("source").isNull(), "source")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    budget = F.lit(share) * F.sum("source_size").over(everywhere)
    level = (budget - F.coalesce(F.lit(cap) * F.sum("source_size").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    return (
        ranked.withColumn("level", level)
        .withColumn("target", F.least(F.lit(cap) * F.col("source_size"), F.col("weight") * F.max("level").over(everywhere)))
        .drop("ratio", "level", "weight")
    )


def sainte_lague(shares: DataFrame, by: list[str], key: list[str]) -> DataFrame:
    """Adds ``seats`` to rows of (by..., key..., share, most, seats_in_all): highest quotients share / (2k - 1).

    The quotients are not listed one by one. With S parties and N seats, the divisor for N - S/2
    seats surely gives no more than N, the one for N + S/2 no fewer; only the seats between the two,
    2S at most, are ranked by quotient. ``most`` bounds the seats of a row.
    """
    group = Window.partitionBy(*by)
    total, parties = F.sum("share").over(group), F.count(F.lit(1)).over(group)
    seats = F.col("seats_in_all")

    def rounded(n):
        return F.when(total > 0, F.floor(F.col("share") * n / total + 0.5)).otherwise(0).cast("long")

    sure = F.least(F.greatest(rounded(F.greatest(seats - parties / 2, F.lit(0.0))), F.lit(0)), F.col("most"))
    bounded = (
        shares.withColumn("sure", sure)
        .withColumn("upper", F.least(rounded(seats + parties / 2) + 1, F.col("most")))
        .withColumn("need", seats - F.sum("sure").over(group))
    )
    ranked = (
        bounded.where("upper > sure")
        .select(*by, *key, "share", "need", F.explode(F.sequence(F.col("sure") + 1, F.col("upper"))).alias("__seat"))
        .withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(F.col("share") / (2 * F.col("__seat") - 1)), *key, "__seat")))
        .where("rank <= need")
    )
    won = ranked.groupBy(*by, *key).agg(F.count(F.lit(1)).alias("won"))
    return (
        bounded.join(won, [*by, *key], "left")
        .withColumn("seats", F.col("sure") + F.coalesce("won", F.lit(0)))
        .drop("sure", "upper", "need", "won")
    )


def _row_hash(docs: DataFrame, seed: int, k: int):
    """One of two seeded hashes of a whole row; a null differs from an empty text by its mark."""
    return F.xxhash64(F.lit(seed + 1000 * k), *[F.col(c) for c in docs.columns], *[F.col(c).isNull() for c in docs.columns])


def mix_sources(
    docs: DataFrame,
    weights=WEIGHTS,
    share: float = 1.5,
    cap: int = 2,
    block_words: int = 32,
    shard_words: int = 1 << 21,
    seed: int = 7,
) -> DataFrame:
    """What a mix by weight takes from each row of ``docs`` (doc_id, source, text).

    The words of a source are laid out in seeded order over shards of about ``shard_words`` words,
    and each shard is cut into blocks of ``block_words``. Sainte-Laguë apportionment gives blocks to
    the sources by their targets, and the blocks of a source to its shards, as integer quotas. In a
    shard whose quota is q times its blocks and r more, every block is taken q times, and the r
    blocks with the smallest seeded hashes once more; no block is taken more than ``cap`` times.

    Returns doc_id, row_hash and row_check (of all columns of the row), source, size, source_size,
    target, taken (words of the row within the blocks taken, repeats counted) and copies (how often the
    mix takes the block that holds one seeded word of the row: whole documents in the same proportion).

    A null text has no words, and so takes none; a null source is a source of its own, the last.
    Equal rows count one by one, and of rows that hash alike the id, the size and then the place in the input
    decide the order. Other columns only take part in the seeded order (maps cannot be hashed). An empty
    table gives an empty result. The result depends on the rows and the seed alone.
    """
    text = text_of()
    sized = materialize(
        docs.select(
            F.monotonically_increasing_id().alias("rid"),
            "doc_id",
            F.col("source").cast("string").alias("source"),
            F.concat(F.when(F.col("source").isNull(), "-").otherwise("+"), F.coalesce(F.col("source").cast("string"), F.lit(""))).alias("skey"),
            F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
            *[_row_hash(docs, seed, k).alias(name) for k, name in enumerate(("row_hash", "row_check"))],
        ),
        "mix-sizes",
    )
    sums = sized.groupBy("skey").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    targets = source_targets(sums, weights, share, float(cap))
    shares = targets.select(
        "*",
        # in blocks of the source's mean size, so that a source of less than a block counts as what it is
        F.when(F.col("source_size") > 0, F.col("target") * F.ceil(F.col("source_size") / block_words) / F.col("source_size")).otherwise(0.0).alias("share"),
        (cap * F.ceil(F.col("source_size") / block_words)).cast("long").alias("most"),
    )
    shares = shares.withColumn("seats_in_all", F.round(F.sum("share").over(Window.partitionBy())).cast("long"))
    sources = materialize(
        sainte_lague(shares.withColumn("all", F.lit(1)), ["all"], ["skey"]).select(
            "skey",
            "source_size",
            "target",
            F.col("seats").alias("source_seats"),
            F.greatest(F.ceil(F.col("source_size") / shard_words), F.lit(1)).cast("long").alias("n_shards"),
        ),
        "mix-sources",
    )
    placed = sized.join(sources, "skey").withColumn("shard", F.pmod(F.col("row_hash"), F.col("n_shards")))
    line = Window.partitionBy("skey", "shard").orderBy("row_hash", "doc_id", "size", "rid")
    lines = placed.withColumn("end", F.sum("size").over(line)).withColumn("start", F.col("end") - F.col("size"))

    shards = (
        placed.groupBy("skey", "shard")
        .agg(F.sum("size").alias("words"), F.first("source_seats").alias("seats_in_all"))
        .where("words > 0")
        .withColumn("n_blocks", F.ceil(F.col("words") / block_words).cast("long"))
        .withColumn("share", F.col("words").cast("double"))
        .withColumn("most", cap * F.col("n_blocks"))
    )
    quotas = sainte_lague(shards, ["skey"], ["shard"]).select("skey", "shard", "n_blocks", F.col("seats").alias("quota"))
    # the quotas are few rows that become many blocks: spread before, by the number of shards
    n_shards = sources.agg(F.coalesce(F.sum("n_shards"), F.lit(1)).alias("n")).first()["n"]
    quotas = quotas.repartition(max(1, min(int(n_shards), PARTITIONS)), "skey", "shard")
    in_shard = Window.partitionBy("skey", "shard")
    blocks = (
        quotas.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)).alias("block"))
        .withColumn("draw", F.row_number().over(in_shard.orderBy(F.xxhash64(F.lit(seed + 1), "skey", "shard", "block"), "block")))
        .withColumn(
            "times",
            F.floor(F.col("quota") / F.col("n_blocks")) + F.when(F.col("draw") <= F.col("quota") % F.col("n_blocks"), 1).otherwise(0),
        )
        .withColumn("before", F.coalesce(F.sum("times").over(in_shard.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .select("skey", "shard", "block", "times", "before")
    )
    anchor = F.col("start") + F.pmod(F.xxhash64(F.lit(seed + 2), "row_hash"), F.col("size"))
    points = lines.where("size > 0").select(
        "rid", "skey", "shard",
        F.explode(
            F.array(
                F.struct(F.lit(-1).alias("sign"), (F.col("start") / block_words).cast("long").alias("block"), F.col("start").alias("x")),
                F.struct(F.lit(1).alias("sign"), ((F.col("end") - 1) / block_words).cast("long").alias("block"), F.col("end").alias("x")),
                F.struct(F.lit(0).alias("sign"), (anchor / block_words).cast("long").alias("block"), anchor.alias("x")),
            )
        ).alias("at"),
    ).select("rid", "skey", "shard", "at.*")
    upto = F.col("before") * block_words + F.col("times") * (F.col("x") - F.col("block") * block_words)
    taken = (
        points.join(blocks.hint("merge"), ["skey", "shard", "block"])  # blocks grow with the words: never broadcast
        .groupBy("rid")
        .agg(F.sum(F.col("sign") * upto).cast("long").alias("taken"), F.max(F.when(F.col("sign") == 0, F.col("times"))).cast("long").alias("copies"))
    )
    return (
        sized.join(taken, "rid", "left")
        .join(sources.select("skey", "source_size", "target"), "skey")
        .select(
            "doc_id", "row_hash", "row_check", "source", "size", "source_size", "target",
            F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
            F.coalesce("copies", F.lit(0)).cast("long").alias("copies"),
        )
    )


#: Copies that one row of a task is repeated to; a row of more is dealt over tasks in pieces of so many.
COPIES = 10_000


def mixed_documents(docs: DataFrame, seed: int = 7, **kwargs) -> DataFrame:
    """The rows of ``docs`` as the mix takes them: each as often as ``copies`` says, rows without a word once.

    Rows that are equal in all columns become one that is repeated as often as all of them; they are
    told apart by 128 bits of hashes. One that is to be repeated more than COPIES times is cut into pieces, and these are
    dealt over the tasks.
    """
    c_hash, c_check, c_times, c_copy, c_piece = unused(docs, "__hash", "__check", "__times", "__copy", "__piece")
    mix = mix_sources(docs, seed=seed, **kwargs)
    wanted = F.sum(F.when(F.col("size") == 0, 1).otherwise(F.col("copies"))).alias(c_times)
    times = mix.groupBy(F.col("row_hash").alias(c_hash), F.col("row_check").alias(c_check)).agg(wanted).where(F.col(c_times) > 0)
    times = materialize(times, "mix-times")
    keys = [c_hash, c_check]
    hashed = docs.select("*", *[_row_hash(docs, seed, k).alias(name) for k, name in enumerate(keys)])

    def repeated(rows: DataFrame) -> DataFrame:
        return rows.withColumn(c_copy, F.explode(F.array_repeat(F.lit(0), F.col(c_times).cast("int")))).select(*docs.columns)

    few = repeated(hashed.dropDuplicates(keys).join(times.where(F.col(c_times) <= COPIES), keys))
    many = times.where(F.col(c_times) > COPIES)
    n_many = many.count()
    if not n_many:
        return few
    # at most one in COPIES of the copies is such a row: they are picked out where they are
    picked = hashed.join(F.broadcast(many) if n_many <= HOT_KEYS else many, keys).dropDuplicates(keys)
    pieces = picked.withColumn(c_piece, F.explode(F.sequence(F.lit(0), ((F.col(c_times) - 1) / COPIES).cast("long"))))
    dealt = pieces.repartition(*keys, c_piece).withColumn(c_times, F.least(F.lit(COPIES), F.col(c_times) - F.col(c_piece) * COPIES))
    return few.unionByName(repeated(dealt))
