"""Operators that wait: state by message with event-time timers, in place of sweeps over whole tables.

Both take a stream and give a stream of changes. Their state lives in Spark's state store (``use_states`` names RocksDB's),
by message, in buckets of messages (``_Buckets``); a batch costs the buckets that it touches. Rows of a message within a batch are taken in the order of
their times, so a batch that runs again gives the same rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..sources import workspace

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Fixed value: how long a decided message's body is kept.
RETENTION = pd.Timedelta(days=7)

#: Groups of state that messages are dealt over, by hash; with many more messages than some hundred times that, ``relabels`` and ``body_expiry`` want more. Not to be changed for a stream that has begun.
BUCKETS = 1 << 12

CHANGES = "message string, outcome string, from_folder string, to_folder string, removed_at timestamp, added_at timestamp"
BODIES = "message string, change long, kind string, stored_at timestamp, expires_at timestamp"


def use_states(spark: SparkSession) -> None:
    """State stores of the session's streams are RocksDB's, which these operators need; those of an executor share one limit of memory, however many there are."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage", "true")


def _timer(micros: int) -> int:
    """Milliseconds, rounded up: a timer never goes off before its time."""
    return -(-micros // 1000)


def _columns(schema: str) -> list[tuple[str, str]]:
    return [tuple(c.split()) for c in schema.split(", ")]


class _Buckets(StatefulProcessor):
    """Messages by buckets: what a bucket holds is one value, column by column, and its one timer is that of the row that is due first.

    A call between Python and the state store takes as long as hundreds of rows of Python, so a bucket's messages share theirs. Times are microseconds.
    """

    #: Columns of what is held, message first, and of what is given.
    HELD: str
    GIVEN: str
    #: Columns that are read, message first.
    READ: tuple[str, ...]

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", ", ".join(["timer long", *(f"{c} array<{t}>" for c, t in _columns(self.HELD))]))

    def due(self, row: tuple) -> int | None:
        """When a held row is due, if ever."""
        raise NotImplementedError

    def events(self, held: dict[str, list[tuple]], found: dict[str, list[tuple]]) -> Iterable[tuple]:
        """Rows to give for new rows by message; changes what is held by message."""
        raise NotImplementedError

    def expired(self, held: dict[str, list[tuple]], is_due) -> Iterable[tuple]:
        """Rows to give for held rows that are due; changes what is held by message."""
        raise NotImplementedError

    def _load(self) -> tuple[int | None, dict[str, list[tuple]]]:
        timer, *columns = self.held.get() or (None,)
        held = defaultdict(list)
        for message, *row in zip(*columns, strict=True):
            held[message].append(tuple(row))
        return timer, held

    def _save(self, timer: int | None, held: dict[str, list[tuple]]) -> None:
        rows = [(message, *row) for message, of in held.items() for row in of]
        first = min((d for r in rows if (d := self.due(r[1:])) is not None), default=None)
        first = None if first is None else _timer(first)
        if first != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if first is not None:
                self.handle.registerTimer(first)
        if rows:
            self.held.update((first, *map(list, zip(*rows, strict=True))))
        else:
            self.held.clear()

    def _out(self, rows: Iterable[tuple]) -> Iterator[pd.DataFrame]:
        if rows := list(rows):
            yield pd.DataFrame({c: pd.Series(v, dtype=object) for (c, _), v in zip(_columns(self.GIVEN), zip(*rows, strict=True), strict=True)})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        found = defaultdict(list)
        for part in rows:
            for message, *row in part[list(self.READ)].itertuples(index=False, name=None):
                found[message].append(tuple(row))
        timer, held = self._load()
        out = list(self.events(held, found))
        self._save(timer, held)
        yield from self._out(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, held = self._load()
        now = timerValues.getCurrentWatermarkInMs()
        out = list(self.expired(held, lambda row: (d := self.due(row)) is not None and _timer(d) <= now))
        self._save(None, held)  # the timer that went off goes by itself
        yield from self._out(out)

    def close(self) -> None:
        pass


def _by_buckets(rows: DataFrame, late: str, processor: _Buckets, buckets: int) -> DataFrame:
    """What ``processor`` gives for a stream with message and at, its times as timestamps."""
    marked = rows.withWatermark("at", late).withColumns({"bucket": F.pmod(F.xxhash64("message"), F.lit(buckets)).cast("int"), "micros": F.unix_micros("at")})
    found = marked.groupBy("bucket").transformWithStateInPandas(processor, processor.GIVEN, "Append", "EventTime")
    time: dict[str, Column] = {c: F.timestamp_micros(c) for c in found.columns if c.endswith("_at")}
    return found.withColumns(time)


# --- moves between folders

#: What a change of one kind is paired with.
OTHER = {"removed": "added", "added": "removed"}


def pair_changes(waiting: list[tuple], changes: list[tuple], wait: int | None) -> tuple[list[tuple], list[tuple]]:
    """One message's waiting (folder, kind, at) and new ones, as what still waits and what is decided.

    Kinds are removed and added, and the same with own- before them for moves that we made ourselves: an own move and
    the change of its kind and folder are an echo, whichever comes first. A removal and an addition of the same folder undo each
    other. A removal and an addition of different folders, the earliest that wait, are a correction. What waits longer
    than ``wait`` is a rejection (removed) or ambiguous (added).
    """
    done: list[tuple] = []

    def expire(before: int) -> None:
        if wait is not None:
            late = [w for w in waiting if w[2] + wait < before]
            done.extend(_expired(w) for w in late if w[1] in OTHER)
            waiting[:] = [w for w in waiting if w[2] + wait >= before]

    def take(test) -> tuple | None:
        found = min((w for w in waiting if test(w)), key=lambda w: (w[2], w[0]), default=None)
        if found is not None:
            waiting.remove(found)
        return found

    for folder, kind, at in sorted(changes, key=lambda c: (c[2], not c[1].startswith("own-"), c[1], c[0])):
        expire(at)
        own = kind.startswith("own-")
        echo = kind[4:] if own else f"own-{kind}"
        if take(lambda w: w[:2] == (folder, echo)):  # noqa: B023
            continue
        if not own:
            if take(lambda w: w[:2] == (folder, OTHER[kind])):  # noqa: B023
                continue
            if other := take(lambda w: w[1] == OTHER[kind]):  # noqa: B023
                gone, came = ((folder, at), (other[0], other[2])) if kind == "removed" else ((other[0], other[2]), (folder, at))
                done.append(("corrected", gone[0], came[0], gone[1], came[1]))
                continue
        waiting.append((folder, kind, at))
    return waiting, done


def _expired(change: tuple) -> tuple:
    folder, kind, at = change
    return ("rejected", folder, None, at, None) if kind == "removed" else ("ambiguous", None, folder, None, at)


class _Pairs(_Buckets):
    HELD, READ = "message string, folder string, kind string, at long", ("message", "folder", "kind", "micros")
    GIVEN = CHANGES.replace("timestamp", "long")

    def __init__(self, wait: int | None) -> None:
        self.wait = wait

    def due(self, row: tuple) -> int | None:
        return None if self.wait is None else row[2] + self.wait

    def events(self, held: dict[str, list[tuple]], found: dict[str, list[tuple]]) -> Iterator[tuple]:
        for message, changes in found.items():
            held[message], done = pair_changes(held[message], changes, self.wait)
            yield from ((message, *d) for d in done)

    def expired(self, held: dict[str, list[tuple]], is_due) -> Iterator[tuple]:
        for message, waiting in held.items():
            late = sorted(filter(is_due, waiting), key=lambda w: (w[2], w[1], w[0]))
            held[message] = [w for w in waiting if not is_due(w)]
            yield from ((message, *_expired(w)) for w in late if w[1] in OTHER)


def relabels(changes: DataFrame, wait: pd.Timedelta | None = None, late: str = "0 seconds", buckets: int = BUCKETS) -> DataFrame:
    """What the moves of messages between folders mean (see ``pair_changes``): a stream of CHANGES, from a stream (message, folder, kind, at).

    The halves of a move are paired however far apart they come, in whatever batches, unless ``wait`` is given: then what waits longer is decided
    when event time has passed it, ``late`` behind the newest change. Rows with a null, or of another kind, are left out.
    """
    kinds = [*OTHER, *(f"own-{k}" for k in OTHER)]
    named = changes.select(F.col("message").cast("string").alias("message"), "folder", "kind", F.col("at").cast("timestamp").alias("at"))
    good = named.where(F.col("message").isNotNull() & F.col("folder").isNotNull() & F.col("at").isNotNull() & F.col("kind").isin(kinds))
    micros = None if wait is None else wait.value // 1000
    return _by_buckets(good, late, _Pairs(micros), buckets)


# --- bodies that expire


def body_changes(held: tuple, events: list[tuple], retention: int) -> tuple[tuple, list[tuple]]:
    """One message's (changes so far, stored_at, expires_at, decided_at) after ``events`` (kind, at), and its changes (change, kind, stored_at, expires_at).

    A body that is stored while none is held expires ``retention`` later if its message is decided, else never; the first decision gives a
    body without an expiry its own. Later decisions never extend it. What has expired by the time of an event goes before the event.
    """
    n, stored, expires, decided = held
    out: list[tuple] = []

    def note(kind: str) -> None:
        nonlocal n
        n += 1
        out.append((n, kind, stored, expires))

    for kind, at in sorted(events, key=lambda e: (e[1], e[0] != "decision")):
        if expires is not None and expires <= at:
            note("expired")
            stored = expires = None
        if kind == "decision":
            decided = at if decided is None else min(decided, at)
            if stored is not None and expires is None:
                expires = at + retention
                note("dated")
        elif stored is None:
            stored, expires = at, None if decided is None else at + retention
            note("stored")
    return (n, stored, expires, decided), out


class _Bodies(_Buckets):
    HELD, READ = "message string, n long, stored long, expires long, decided long", ("message", "kind", "micros")
    GIVEN = BODIES.replace("timestamp", "long")

    def __init__(self, retention: int) -> None:
        self.retention = retention

    def due(self, row: tuple) -> int | None:
        return row[2]

    def events(self, held: dict[str, list[tuple]], found: dict[str, list[tuple]]) -> Iterator[tuple]:
        for message, events in found.items():
            before = held[message][0] if held[message] else (0, None, None, None)
            after, out = body_changes(before, events, self.retention)
            held[message] = [after]
            yield from ((message, *change) for change in out)

    def expired(self, held: dict[str, list[tuple]], is_due) -> Iterator[tuple]:
        for message, ((n, stored, expires, decided),) in held.items():
            if is_due((n, stored, expires, decided)):
                held[message] = [(n + 1, None, None, decided)]
                yield message, n + 1, "expired", stored, expires


def body_expiry(events: DataFrame, retention: pd.Timedelta = RETENTION, late: str = "0 seconds", buckets: int = BUCKETS) -> DataFrame:
    """The life of cached bodies (see ``body_changes``): a stream of BODIES, from a stream (message, kind, at), kind body or decision.

    ``change`` numbers a message's changes. A body expires when event time, ``late`` behind the newest event, has passed its
    expiry, by the timer of its bucket: nothing sweeps the table. Rows with a null, or of another kind, are left out.
    """
    named = events.select(F.col("message").cast("string").alias("message"), "kind", F.col("at").cast("timestamp").alias("at"))
    good = named.where(F.col("message").isNotNull() & F.col("at").isNotNull() & F.col("kind").isin("body", "decision"))
    return _by_buckets(good, late, _Bodies(retention.value // 1000), buckets)


def surviving_bodies(changes: DataFrame) -> DataFrame:
    """The bodies (message, stored_at, expires_at) that are held after ``changes`` (BODIES): those whose last change is no expiry."""
    last = changes.groupBy("message").agg(F.max_by(F.struct("kind", "stored_at", "expires_at"), "change").alias("r"))
    return last.where("r.kind <> 'expired'").select("message", "r.stored_at", "r.expires_at")


def replayed(rows: DataFrame, by: str, cuts: list, operator, folder: str) -> DataFrame:
    """What a stream operator gives for a table that comes in batches: rows with ``by`` up to each cut, then the rest.

    Each batch is written under ``folder`` before the stream reads it, one after another; the result is the stream's sink.
    """
    spark = rows.sparkSession
    use_states(spark)
    bounds = [None, *cuts, None]
    files = spark.sparkContext.defaultParallelism
    for n, (low, high) in enumerate(zip(bounds, bounds[1:], strict=False), start=1):
        part = rows
        part = part if low is None else part.where(F.col(by) > low)
        part = part if high is None else part.where(F.col(by) <= high)
        part.repartition(files).write.mode("append").parquet(f"{folder}/in")
        while _files(spark, f"{folder}/in") < n * files:  # a trigger takes so many files: a batch of few rows is filled up with empty ones
            part.limit(0).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/in")
    found = operator(source)
    query = found.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{folder}/out")


def _files(spark: SparkSession, path: str) -> int:
    return sum(name.startswith("part-") for name in workspace.names(spark, path))
