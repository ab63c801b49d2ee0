"""Generations of a folder's locations: a resync writes the next one beside the live one and switches by one small file.

When a folder's uid validity changes, its uids mean nothing any more. A resync reads the whole
listing anew and writes locations of the next generation under a run of its own; readers stay on the live
generation until the version of the state that names the run is committed. Tables under a store's path:

* ``commits/<version>``: empty files; the highest one is the version that readers see.
* ``state/version=N``: a row for each folder (see STATE), with what is pending; ``runs/version=N``: the runs that readers see.
* ``locations/run=R``, ``messages/run=R``, ``removals/run=R``: what run R wrote.

A run that failed is begun again under its number and overwrites what it wrote, so nothing is there twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import offsets, stream_rules
from ..sources import workspace

STATE = (
    "folder string, uid_validity long, generation long, run long, last_uid long, watermark timestamp,"
    " pending_validity long, pending_generation long, pending_run long,"
    " backfill_since timestamp, backfill_cursor long, backfill_until long, backfill_total long"
)
LOCATIONS = "folder string, uid_validity long, generation long, uid long, identity string"
MESSAGES = "identity string, internal_date timestamp, eligible boolean, folder string"
REMOVALS = f"{LOCATIONS}, reason string"
COUNTS = "folder string, result string, matched long, new long, older long, gone long"


class GenerationStore:
    """The store under ``path``; ``cap`` is how many unknown new messages a resync of a folder may bring without its owner."""

    def __init__(self, spark: SparkSession, path: str, cap: int = stream_rules.NEW_MAIL_CAP) -> None:
        self.spark, self.path, self.cap = spark, path, cap

    # --- what readers see

    def _version(self, name: str, schema: str) -> DataFrame:
        version = workspace.committed(self.spark, f"{self.path}/commits")
        if not version:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}/version={version}")

    def state(self) -> DataFrame:
        """The committed state: a row for each folder."""
        return self._version("state", STATE)

    def _runs(self) -> list[int]:
        return [r[0] for r in self._version("runs", "run long").collect()]  # a number for each resync

    def _rows(self, name: str, schema: str, runs: list[int]) -> DataFrame:
        """What ``runs`` wrote; the files of other runs are not opened."""
        paths = [f"{self.path}/{name}/run={r}" for r in runs]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def locations(self) -> DataFrame:
        """Live locations, those of each folder's generation; only runs from which a live generation stems are read."""
        state = self.state()
        live = [r[0] for r in state.where("run is not null").select("run").distinct().collect()]
        return self._rows("locations", LOCATIONS, live).join(state.select("folder", "generation"), ["folder", "generation"], "left_semi")

    def messages(self) -> DataFrame:
        """A row for each message that a committed run stored."""
        return self._rows("messages", MESSAGES, self._runs())

    def removals(self) -> DataFrame:
        """Locations that ended, with the reason: superseded or vanished."""
        return self._rows("removals", REMOVALS, self._runs())

    # --- a resync

    def _commit(self, state: DataFrame, runs: list[int]) -> None:
        version = workspace.committed(self.spark, f"{self.path}/commits") + 1
        state.select(*StructType.fromDDL(STATE).names).write.mode("overwrite").parquet(f"{self.path}/state/version={version}")
        listed = self.spark.createDataFrame([(r,) for r in sorted(runs)], "run long")
        listed.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/runs/version={version}")
        if not workspace.commit(self.spark, f"{self.path}/commits", version):
            raise RuntimeError(f"another writer committed version {version}")

    def begin(self, status: DataFrame) -> DataFrame:
        """Note which folders are to be resynced, by ``status`` (folder, uid_validity, uid_next); gives their rows of the state.

        A folder whose pending uid validity is the source's keeps its pending generation and run. Any other whose uid
        validity changed, or that is new, gets a generation above every one that it had, and a new run. A pending
        resync is dropped if the source has the live uid validity again.
        """
        state, source = self.state(), status.select("folder", F.col("uid_validity").alias("at_source"))
        runs = [*self._runs(), *workspace.numbers(self.spark, f"{self.path}/locations", "run=")]
        runs += [r[0] for r in state.where("pending_run is not null").select("pending_run").distinct().collect()]
        run = F.lit(max([0, *runs]) + 1).cast("long")
        joined = state.join(source, "folder", "full_outer")
        again = F.coalesce(F.col("pending_validity") == F.col("at_source"), F.lit(False))
        fresh = ~again & F.col("at_source").isNotNull() & ~F.col("uid_validity").eqNullSafe(F.col("at_source"))
        unlisted = F.col("at_source").isNull()
        top = F.greatest(F.coalesce("generation", F.lit(0)), F.coalesce("pending_generation", F.lit(0)))
        begun = joined.select(
            *[c for c in state.columns if not c.startswith("pending")],
            F.when(unlisted, F.col("pending_validity")).when(again | fresh, F.col("at_source")).alias("pending_validity"),
            F.when(again | unlisted, F.col("pending_generation")).when(fresh, top + 1).alias("pending_generation"),
            F.when(unlisted, F.col("pending_run")).when(again, F.coalesce("pending_run", run)).when(fresh, run).alias("pending_run"),
        )
        if not begun.select(*state.columns).exceptAll(state).isEmpty():
            self._commit(begun, self._runs())
        return self.state().join(source, "folder", "left_semi").where("pending_run is not null")

    def resync(self, listing: DataFrame, status: DataFrame, now, before_switch=lambda: None) -> DataFrame:
        """Resync every folder whose uid validity changed; gives a row (folder, result, matched, new, older, gone) for each.

        ``listing`` (folder, uid, identity, internal_date) is all that the source holds; of repeats of a uid the oldest counts.
        Unknown messages later than the watermark less the overlap are new; a folder with more of them than the cap
        stays on its generation (``needs_attention``, its numbers null) until the owner raises the cap. The others' locations are written under the pending generation,
        unknown messages with them: eligible if new in any folder, historical otherwise; a message that is known stays as it
        is. In a folder's first sync all is historical. Last the state is committed: the generation, the last uid, a watermark
        that only goes forward and is capped at ``now``, and a pending first backfill begun anew under the new uids.
        Whatever fails before that (``before_switch`` is called there) leaves readers where they were. ``matched`` + ``new`` + ``older`` are the
        uids of the listing. Locations of the folder's earlier generation end: superseded if their message has a location in the
        new one, vanished otherwise; ``gone`` counts the messages that vanished. A null uid or identity is an error.
        """
        pending = self.begin(status)
        if pending.isEmpty():
            return self.spark.createDataFrame([], COUNTS)
        clock = F.lit(now).cast("timestamp")
        marked = self._marked(listing, pending, clock)
        kinds = marked.groupBy("folder").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("matched", "new", "older")])
        counts = pending.select("folder", "pending_run").join(kinds, "folder", "left").na.fill(0).withColumn("held", F.col("new") > self.cap)
        admitted = marked.join(counts.where("not held").select("folder"), "folder", "left_semi")
        runs = [r[0] for r in pending.select("pending_run").distinct().collect()]
        placed = admitted.select("folder", F.col("pending_validity").alias("uid_validity"), F.col("pending_generation").alias("generation"), "uid", "identity", "run")
        first = F.min_by(F.struct("internal_date", "folder", "run"), F.struct("internal_date", "folder", "uid")).alias("r")
        stored = (
            admitted.where("kind <> 'matched'")
            .groupBy("identity")
            .agg(first, F.bool_or(F.col("kind") == "new").alias("eligible"))
            .select("identity", "r.internal_date", "eligible", "r.folder", "r.run")
        )
        self._overwrite("locations", placed, runs)
        self._overwrite("messages", stored, runs)
        switched = self._rows("locations", LOCATIONS, runs).select("folder", "identity").distinct().withColumn("there", F.lit(True))
        folders = counts.where("not held").select("folder", F.col("pending_run").alias("run"))
        ended = self.locations().join(folders, "folder").join(switched, ["folder", "identity"], "left")
        self._overwrite("removals", ended.select(*StructType.fromDDL(REMOVALS).names[:-1], F.when(F.col("there"), "superseded").otherwise("vanished").alias("reason"), "run"), runs)
        gone = self._rows("removals", REMOVALS, runs).where("reason = 'vanished'").groupBy("folder").agg(F.count_distinct("identity").alias("gone"))
        result = counts.join(gone, "folder", "left").select(
            "folder",
            F.when(F.col("held"), "needs_attention").otherwise("resynced").alias("result"),
            *[F.when(~F.col("held"), F.coalesce(c, F.lit(0))).cast("long").alias(c) for c in ("matched", "new", "older", "gone")],
        )
        done = f"{self.path}/resyncs/run={max(runs)}"
        result.write.mode("overwrite").parquet(done)
        before_switch()
        self._commit(self._switched(marked, counts, status, clock), [*self._runs(), *runs])
        workspace.delete(self.spark, f"{self.path}/work")
        return self.spark.read.schema(COUNTS).parquet(done)

    def _marked(self, listing: DataFrame, pending: DataFrame, clock) -> DataFrame:
        """The listing of the pending folders with each message's kind, read once and written."""
        by_uid = F.min_by(F.struct("identity", "internal_date"), F.struct("internal_date", "identity")).alias("r")
        named = F.col("uid").isNotNull() & F.col("identity").isNotNull()
        checked = listing.withColumn("uid", F.when(named, F.col("uid")).otherwise(F.raise_error(F.lit("a listing names uids and identities"))))
        once = checked.groupBy("folder", "uid").agg(by_uid).select("folder", "uid", "r.*")
        folders = pending.select("folder", "pending_validity", "pending_generation", F.col("pending_run").alias("run"), "generation", F.least("watermark", clock).alias("mark"))
        known = self.messages().select("identity", F.lit(True).alias("known"))
        new = F.col("generation").isNotNull() & stream_rules.is_new(F.col("internal_date"), F.col("mark"))
        kind = F.when(F.col("known"), "matched").when(new, "new").otherwise("older")
        marked = once.join(folders, "folder").join(known, "identity", "left").withColumn("kind", kind).drop("known")
        marked.write.mode("overwrite").parquet(f"{self.path}/work")
        return self.spark.read.schema(marked.schema).parquet(f"{self.path}/work")

    def _overwrite(self, name: str, rows: DataFrame, runs: list[int]) -> None:
        for run in runs:  # one, or two where a failed run is begun again beside a new one
            rows.where(F.col("run") == run).drop("run").write.mode("overwrite").parquet(f"{self.path}/{name}/run={run}")

    def _switched(self, marked: DataFrame, counts: DataFrame, status: DataFrame, clock) -> DataFrame:
        """The state after the switch; a held folder keeps its pending generation but leaves the run, which is done."""
        since = self.state().select("folder", "backfill_since")
        inside = F.col("internal_date") >= F.col("backfill_since")
        seen = marked.join(since, "folder", "left").groupBy("folder").agg(
            F.max("uid").alias("top"),
            F.max(F.when(F.col("kind") == "new", F.least("internal_date", clock))).alias("newest_new"),
            F.max("internal_date").alias("newest"),
            F.min(F.when(inside, F.col("uid"))).alias("low"),
            F.count_if(inside).alias("window"),
        )
        state = self.state().join(counts.select("folder", "held"), "folder", "left").join(seen, "folder", "left")
        state = state.join(status.select("folder", "uid_next"), "folder", "left")
        switch, first = F.coalesce(~F.col("held"), F.lit(False)), F.col("generation").isNull()
        first_mark = offsets.first_watermark(F.coalesce("newest", clock - F.expr("INTERVAL 1 DAY")), clock)
        window = F.coalesce("window", F.lit(0)) > 0

        def instead(column: str, value):
            return F.when(switch, value).otherwise(F.col(column)).alias(column)

        backfill = {"backfill_since": F.col("backfill_since"), "backfill_cursor": F.col("low") - 1, "backfill_until": F.col("uid_next") - 1, "backfill_total": F.col("window")}
        return state.select(
            "folder",
            instead("uid_validity", F.col("pending_validity")),
            instead("generation", F.col("pending_generation")),
            instead("run", F.col("pending_run")),
            instead("last_uid", F.greatest(F.col("uid_next") - 1, "top")),
            instead("watermark", F.when(first, first_mark).otherwise(F.greatest(F.least("watermark", clock), "newest_new"))),
            instead("pending_validity", F.lit(None)),
            instead("pending_generation", F.lit(None)),
            F.when(F.col("held").isNull(), F.col("pending_run")).alias("pending_run"),
            *[instead(c, F.when(window, v)) for c, v in backfill.items()],
        )
