"""How good decisions were: the learning curve, percentiles by key, and what a change of the rules would move."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources import workspace
from . import rules
from .upsert import last_of

#: Seconds of a time bucket: windows see a bucket of a mailbox, or a mailbox's buckets, never all its rows.
BUCKET_SECONDS = 86_400
#: Buckets that a range of values is cut into in each round of ``nearest_ranks_by``.
RANGE_BUCKETS = 1024
#: Most ranges, of a hundred bytes, that are broadcast.
BROADCAST_TARGETS = 500_000


def before_each(rows: DataFrame, marks: DataFrame, keys: list[str], time: str) -> DataFrame:
    """``rows`` with ``n_before``: how many ``marks`` of the same keys are strictly earlier.

    Both are counted in time buckets: a running sum over a key's buckets, and within the bucket one over its rows.
    """
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    place = {"__t": micros, "__b": F.floor(micros / (BUCKET_SECONDS * 1_000_000)).cast("long")}
    asked = rows.withColumns({**place, "__m": F.lit(0)})
    counted = marks.select(*keys, time).withColumns(place).groupBy(*keys, "__b", "__t").agg(F.count(F.lit(1)).alias("__m"))
    both = asked.withColumn("__row", F.lit(True)).unionByName(counted, allowMissingColumns=True)
    inside = Window.partitionBy(*keys, "__b").orderBy("__t").rangeBetween(Window.unboundedPreceding, -1)
    within = both.withColumn("__in", F.coalesce(F.sum("__m").over(inside), F.lit(0))).where("__row")
    earlier = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = both.groupBy(*keys, "__b").agg(F.sum("__m").alias("__n"))
    bases = buckets.select(*keys, "__b", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__base"))
    return within.join(bases, [*keys, "__b"]).withColumn("n_before", F.col("__base") + F.col("__in")).select(*rows.columns, "n_before")


def learning_curve(decisions: DataFrame, confirmed: DataFrame, mailbox: str = "mailbox", message: str = "message", step: int = 100) -> DataFrame:
    """(mailbox, examples, n, n_correct, accuracy, n_so_far, accuracy_so_far): how accuracy grows with the training set.

    ``decisions`` (mailbox, message, category, at) are judged by the message's latest confirmation in ``confirmed`` (the same
    columns; ties by category); those of messages that are never confirmed are left out. ``examples`` is how many confirmations the mailbox
    had before the decision, in steps of ``step``: what could have been learned from then. The last two columns take all steps up to it together.
    """
    truth = last_of(confirmed.select(mailbox, message, F.col("category").alias("truth"), F.col("at").alias("__at")), [mailbox, message], ["__at", "truth"])
    judged = decisions.select(mailbox, message, "category", "at").join(truth.drop("__at"), [mailbox, message])
    placed = before_each(judged, confirmed, [mailbox], "at").withColumn("examples", F.floor(F.col("n_before") / step) * step)
    steps = placed.groupBy(mailbox, "examples").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("category") == F.col("truth")).alias("n_correct"))
    upto = Window.partitionBy(mailbox).orderBy("examples").rowsBetween(Window.unboundedPreceding, 0)  # a row for each step
    whole = steps.withColumns({"n_so_far": F.sum("n").over(upto), "__c": F.sum("n_correct").over(upto)})
    share = lambda a, b: F.round(F.col(a) / F.col(b), 6)
    return whole.select(mailbox, "examples", "n", "n_correct", share("n_correct", "n").alias("accuracy"), "n_so_far", share("__c", "n_so_far").alias("accuracy_so_far"))


def nearest_ranks_by(df: DataFrame, keys: list[str], value: str, percents: dict[str, float], buckets: int = RANGE_BUCKETS) -> DataFrame:
    """A row for each key with the nearest-rank percentile of each name: exact, null where a key has no values.

    The range that holds a rank is cut into ``buckets``; the bucket with the rank, as far as values in it reach, is the
    next range, until its least and greatest value are one. So no rows are sorted, however they are spread and whatever
    a key holds; a round counts the rows that are still in some range, and windows see a key's buckets. NaN is no value; rows with a
    null key are left out.
    """
    for key in keys:
        df = df.where(F.col(key).isNotNull())
    if not keys:
        one = nearest_ranks_by(df.select(value, F.lit(0).alias("__all")), ["__all"], value, percents, buckets)
        return one.agg(*[F.max(name).alias(name) for name in percents])
    spark, folder = df.sparkSession, workspace.scratch(df.sparkSession, "ranks")
    v = F.col(value).cast("double")
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(v)).select(*keys, v.alias("__v"))
    names = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.lit(p).alias("p")) for name, p in percents.items()]))
    bounds = rows.groupBy(*keys).agg(F.min("__v").alias("low"), F.max("__v").alias("high"), F.count(F.lit(1)).alias("n"))
    rank = F.greatest(F.lit(1), F.ceil(F.col("q.p") * F.col("n"))).cast("long")
    targets = bounds.withColumn("q", names).select(*keys, F.col("q.name").alias("name"), rank.alias("rank"), "low", "high")
    schema, number = targets.schema, 0

    def written(found: DataFrame) -> DataFrame:
        found.write.parquet(f"{folder}/{number}")
        return spark.read.schema(schema).parquet(f"{folder}/{number}")

    targets = written(targets)
    done = targets.limit(0)
    while not (open_ := targets.where("low < high")).isEmpty():
        done = done.unionByName(targets.where("low >= high"))
        # an exact sum of both ends may be beyond a double: halves are taken first
        part = F.floor((F.col("__v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2) * buckets)
        place = F.least(F.coalesce(part, F.lit(0)), F.lit(buckets - 1)).alias("b")
        small = open_.count() <= BROADCAST_TARGETS
        inside = rows.join(F.broadcast(open_) if small else open_, keys).where(F.col("__v").between(F.col("low"), F.col("high")))
        counted = inside.groupBy(*keys, "name", "rank", place).agg(F.count(F.lit(1)).alias("n"), F.min("__v").alias("low"), F.max("__v").alias("high"))
        upto = Window.partitionBy(*keys, "name").orderBy("b")
        placed = counted.withColumn("upto", F.sum("n").over(upto.rowsBetween(Window.unboundedPreceding, 0)))
        hit = placed.where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("n") < F.col("rank")))
        number += 1
        targets = written(hit.select(*keys, "name", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"), "low", "high"))
    found = done.unionByName(targets)
    wide = [F.max(F.when(F.col("name") == name, F.col("low"))).alias(name) for name in percents]
    return df.select(*keys).distinct().join(found.groupBy(*keys).agg(*wide), keys, "left")


def latest_messages(messages: DataFrame, mailbox: str, order: list[str], n: int = 200) -> DataFrame:
    """The ``n`` newest messages of each mailbox by ``order``, the last column a key; a task passes on at most ``n`` of a mailbox."""
    place = F.row_number().over(Window.partitionBy(mailbox).orderBy(*[F.desc_nulls_last(c) for c in order]))
    return messages.withColumn("__place", place).where(F.col("__place") <= n).drop("__place")


def rule_preview(messages: DataFrame, before: DataFrame, after: DataFrame, confirmed: DataFrame, mailbox: str, order: list[str], n: int = 200) -> DataFrame:
    """(mailbox, before, after, n, n_conflicts): where a change of the rules would move the ``n`` newest messages of each mailbox.

    ``messages`` are those of ``rules.first_match`` with their mailbox; ``before`` and ``after`` are entries of rules. A message moves if its label differs. It
    conflicts if its latest confirmation in ``confirmed`` (id, label, at) is not the label that it would get; messages that move are
    counted, and those that conflict whether they move or not.
    """
    recent = latest_messages(messages, mailbox, order, n)
    old = rules.first_match(recent, before).select("id", F.col("label").alias("before"))
    new = rules.first_match(recent, after).select("id", F.col("label").alias("after"))
    truth = last_of(confirmed.select("id", F.col("label").alias("truth"), "at"), ["id"], ["at", "truth"]).drop("at")
    both = recent.select(mailbox, "id").join(old, "id").join(new, "id").join(truth, "id", "left")
    moved = ~F.col("before").eqNullSafe(F.col("after"))
    conflict = F.col("after").isNotNull() & (F.col("truth") != F.col("after"))
    counted = both.where(moved | conflict).groupBy(mailbox, "before", "after")
    return counted.agg(F.count_if(moved).alias("n"), F.count_if(conflict).alias("n_conflicts"))
