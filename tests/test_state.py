"""State that outlives a batch: generations, keys, relabels, expiry, backfill."""

import datetime as dt
import random
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemill.operators import upsert
from tidemill.sources import workspace
from tidemill.streaming import states
from tidemill.streaming.generations import GenerationStore
from tidemill.streaming.keytable import KeyTable

T0 = dt.datetime(2024, 1, 1)
hours = lambda n: T0 + dt.timedelta(hours=n)


def listing(spark, rows):
    return spark.createDataFrame([(f, u, i, hours(h)) for f, u, i, h in rows], "folder string, uid long, identity string, internal_date timestamp").repartition(3)


def status(spark, *rows):
    return spark.createDataFrame(list(rows), "folder string, uid_validity long, uid_next long")


def rows_of(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.fixture
def first_sync(spark, tmp_path):
    store = GenerationStore(spark, str(tmp_path / "store"), cap=2)
    rows = [("in", u, f"m{u}", u) for u in range(1, 6)] + [("out", 7, "m1", 1), ("out", 9, "x", 3)]
    found = store.resync(listing(spark, rows + rows[:2]), status(spark, ("in", 10, 6), ("out", 20, 12)), hours(5))
    assert rows_of(found, "folder", "result", "matched", "new", "older", "gone") == [("in", "resynced", 0, 0, 5, 0), ("out", "resynced", 0, 0, 2, 0)]
    assert rows_of(store.messages(), "identity", "eligible", "folder")[0] == ("m1", False, "in")
    assert rows_of(store.state(), "folder", "uid_validity", "generation", "last_uid") == [("in", 10, 1, 5), ("out", 20, 1, 11)]
    return store


SECOND = [("in", 100 + k, f"m{k}", k) for k in (2, 3, 4, 5)] + [("in", 110, "n1", 6), ("in", 111, "n1", 6), ("in", 112, "old", 0)]


def stop():
    raise RuntimeError("stopped")


def test_a_failure_before_the_switch_leaves_readers_where_they_are(spark, first_sync):
    store, before = first_sync, rows_of(first_sync.locations(), "folder", "uid", "identity", "generation")
    at = status(spark, ("in", 11, 113), ("out", 20, 12))
    with pytest.raises(RuntimeError):
        store.resync(listing(spark, SECOND), at, hours(5.5), before_switch=stop)
    assert rows_of(store.locations(), "folder", "uid", "identity", "generation") == before
    assert store.messages().where("identity = 'n1'").count() == 0 and store.removals().count() == 0
    runs = workspace.numbers(spark, f"{store.path}/locations", "run=")
    found = store.resync(listing(spark, SECOND), at, hours(5.5))
    assert workspace.numbers(spark, f"{store.path}/locations", "run=") == runs  # the pending run is begun again
    assert rows_of(found, "folder", "result", "matched", "new", "older", "gone") == [("in", "resynced", 4, 2, 1, 1)]
    live = rows_of(store.locations().where("folder = 'in'"), "uid", "identity", "generation", "uid_validity")
    assert live == sorted((u, i, 2, 11) for _, u, i, _ in SECOND)
    assert rows_of(store.locations().where("folder = 'out'"), "uid", "generation") == [(7, 1), (9, 1)]
    assert Counter(r[0] for r in rows_of(store.messages(), "identity")).most_common(1)[0][1] == 1
    assert rows_of(store.messages().where("eligible"), "identity") == [("n1",)]
    assert rows_of(store.removals(), "uid", "reason") == [(1, "vanished")] + [(u, "superseded") for u in (2, 3, 4, 5)]
    assert rows_of(store.state(), "folder", "generation", "last_uid", "watermark", "pending_run")[0] == ("in", 2, 112, hours(5.5), None)
    assert store.resync(listing(spark, SECOND), at, hours(6)).count() == 0  # nothing changed


def test_another_uid_validity_gets_a_fresh_generation_and_the_stale_run_stays_unseen(spark, first_sync):
    store = first_sync
    with pytest.raises(RuntimeError):
        store.resync(listing(spark, SECOND), status(spark, ("in", 11, 113)), hours(5.5), before_switch=stop)
    third = [("in", 1, "m5", 5), ("in", 2, "old", 0)]
    found = store.resync(listing(spark, third), status(spark, ("in", 12, 3)), hours(5.5))
    assert rows_of(found, "matched", "new", "older", "gone") == [(1, 0, 1, 4)]
    assert rows_of(store.locations().where("folder = 'in'"), "uid", "identity", "generation") == [(1, "m5", 3), (2, "old", 3)]
    assert store.messages().where("identity = 'n1'").count() == 0


def test_a_folder_over_the_cap_waits_and_others_do_not(spark, first_sync):
    store = first_sync
    many = [("in", 200 + k, f"new{k}", 7) for k in range(3)] + [("out", 1, "x", 3), ("new", 1, "z", 2)]
    at = status(spark, ("in", 11, 300), ("out", 21, 2), ("new", 1, 2))
    found = store.resync(listing(spark, many), at, hours(8))
    assert rows_of(found.where("folder = 'in'"), "result", "matched", "gone") == [("needs_attention", None, None)]
    assert rows_of(found.where("folder <> 'in'"), "folder", "matched", "older", "gone") == [("new", 0, 1, 0), ("out", 1, 0, 1)]
    assert rows_of(store.state(), "folder", "generation", "pending_generation", "pending_run") == [("in", 1, 2, None), ("new", 1, None, None), ("out", 2, None, None)]
    assert store.locations().where("folder = 'in'").count() == 5
    store.cap = 3
    assert rows_of(store.resync(listing(spark, many), at, hours(8)), "folder", "new", "gone") == [("in", 3, 5)]
    assert rows_of(store.state().where("folder = 'in'"), "generation", "watermark") == [(2, hours(7))]


def test_a_pending_backfill_begins_anew_under_the_new_uids(spark, first_sync):
    store = first_sync
    with_backfill = store.state().withColumns({"backfill_since": F.lit(hours(3)), "backfill_cursor": F.lit(2).cast("long"), "backfill_until": F.lit(5).cast("long"), "backfill_total": F.lit(3).cast("long")})
    store._commit(with_backfill, store._runs())
    store.resync(listing(spark, SECOND), status(spark, ("in", 11, 113)), hours(5.5))
    cols = ("folder", "backfill_since", "backfill_cursor", "backfill_until", "backfill_total")
    assert rows_of(store.state(), *cols) == [("in", hours(3), 102, 112, 5), ("out", hours(3), 2, 5, 3)]
    store.resync(listing(spark, [("in", 5, "old", 0)]), status(spark, ("in", 12, 6)), hours(5.5))
    assert rows_of(store.state().where("folder = 'in'"), *cols[1:]) == [(None, None, None, None)]


def test_empty_listings_and_nulls(spark, first_sync):
    store = first_sync
    found = store.resync(listing(spark, []), status(spark, ("in", 11, 1)), hours(5))
    assert rows_of(found, "matched", "new", "older", "gone") == [(0, 0, 0, 5)]
    assert store.locations().where("folder = 'in'").count() == 0
    with pytest.raises(Exception, match="names uids and identities"):
        store.resync(listing(spark, [("out", 1, None, 1)]), status(spark, ("out", 21, 2)), hours(5))
    assert store.locations().where("folder = 'out'").count() == 2


# --- the key table


def keys_of(spark, ids):
    return KeyTable.hashed(spark.createDataFrame([(f"k{i}", None if i % 7 == 0 else i) for i in ids], "a string, b long"), ["a", "b"])


def test_key_table_knows_what_earlier_batches_stored(spark, tmp_path):
    table, stored, draw = KeyTable(spark, f"file://{tmp_path}/keys", buckets=4, fan=3), {}, random.Random(8)
    files = []
    for batch in range(14):
        ids = [draw.randrange(400) for _ in range(60)]
        rows = keys_of(spark, ids)
        table.compact(before=batch)
        for _ in range(2 if batch % 4 == 0 else 1):  # a batch that runs again
            found = table.known(rows, before=batch)
            assert {tuple(r) for r in found.collect()} == {tuple(r) for r in rows.join(found, ["h1", "h2"], "left_semi").select("h1", "h2").collect()}
            got = {r[0] for r in rows.join(found, ["h1", "h2"], "left_semi").select("a").collect()}
            assert got == {f"k{i}" for i in ids if stored.get(i, batch) < batch}
            files.append(len(found.inputFiles()))
            table.add(rows, batch)
        for i in ids:
            stored.setdefault(i, batch)
    assert max(files[-4:]) <= 3 + 2 * 4 + 1 and len(workspace.numbers(spark, f"{tmp_path}/keys/delta", "batch=")) == 14
    fresh = table.known(keys_of(spark, range(10_000, 10_040)), before=14)
    assert fresh.count() == 0 and len(fresh.inputFiles()) <= 3 + 4 + 4  # filters rule most buckets' keys out
    assert table.known(keys_of(spark, []), before=14).count() == 0


def test_compaction_that_fails_changes_nothing(spark, tmp_path, monkeypatch):
    table = KeyTable(spark, f"file://{tmp_path}/keys", buckets=2, fan=2)
    for batch in range(2):
        table.add(keys_of(spark, range(batch * 10, batch * 10 + 10)), batch)
    monkeypatch.setattr(workspace, "commit", lambda *_: False)
    with pytest.raises(RuntimeError):
        table.compact(before=2)
    monkeypatch.undo()
    asked = keys_of(spark, range(5, 40))
    assert table.known(asked, before=2).count() == 15
    assert table.compact(before=2) and table.known(asked, before=2).count() == 15 and not table.compact(before=2)
    assert table.known(asked, before=1).count() == 5  # of batches before the first only


def test_a_stream_reads_as_much_in_its_last_batch_as_in_its_first(spark, tmp_path, monkeypatch):
    from tidemill.streaming import ingest

    opened = []
    real = KeyTable.known

    def counted(self, keys, before):
        found = real(self, keys, before)
        opened.append(len(found.inputFiles()))
        return found

    monkeypatch.setattr(KeyTable, "known", counted)
    monkeypatch.setattr(KeyTable.__init__, "__defaults__", (4, 3))
    at, schema = f"file://{tmp_path}", "folder string, identity string, uid long, internal_date timestamp"
    for batch in range(9):
        rows = [("in", f"m{k}", k, hours(k)) for k in range(batch * 3, batch * 3 + 5)]
        ingest.store_batch(spark.createDataFrame(rows, schema), f"{at}/store", f"{at}/state", batch)
    stored = ingest.read_or_empty(spark, f"{at}/store/*", f"{schema}, eligible boolean, batch_id long")
    assert rows_of(stored, "uid", "identity") == [(k, f"m{k}") for k in range(29)]
    assert max(opened[-3:]) <= 3 + 2 * 4


# --- moves and bodies, by state

MINUTE = 60_000_000


def moved(*changes, waiting=(), wait=None):
    return states.pair_changes(list(waiting), list(changes), wait)


def test_pairs_of_changes():
    assert moved(("a", "removed", 1), ("b", "added", 9)) == ([], [("corrected", "a", "b", 1, 9)])
    assert moved(("b", "added", 1), ("a", "removed", 9)) == ([], [("corrected", "a", "b", 9, 1)])
    assert moved(("a", "removed", 1), ("a", "added", 2)) == ([], [])  # put back
    assert moved(("a", "removed", 1), ("a", "own-removed", 5)) == ([], [])  # an echo, even if it comes first
    assert moved(("a", "own-removed", 1), ("a", "removed", 1), ("b", "own-added", 2)) == ([("b", "own-added", 2)], [])
    assert moved(("b", "added", 20), waiting=[("b", "own-added", 2)], wait=50) == ([], [])
    assert moved(("b", "added", 20), waiting=[("b", "own-added", 2)], wait=5) == ([("b", "added", 20)], [])
    assert moved(("x", "added", 20), waiting=[("a", "removed", 2), ("c", "removed", 1)]) == ([("a", "removed", 2)], [("corrected", "c", "x", 1, 20)])
    assert moved(("x", "added", 20), waiting=[("a", "removed", 2)], wait=5) == ([("x", "added", 20)], [("rejected", "a", None, 2, None)])
    assert moved(("x", "added", 7), waiting=[("a", "removed", 2)], wait=5) == ([], [("corrected", "a", "x", 2, 7)])


def changes_of(seed, n=160):
    r = random.Random(seed)
    rows = [(f"m{r.randrange(12)}", r.choice("abc"), r.choice(["removed", "added", "removed", "added", "own-added", "own-removed"]), T0 + dt.timedelta(minutes=k, microseconds=k)) for k in range(n)]
    return rows + [(None, "a", "removed", T0), ("m1", None, "removed", T0), ("m1", "a", "moved", T0), ("m1", "a", "added", None)]


@pytest.mark.parametrize("cuts", [[], [37, 38, 120]])
def test_moves_give_the_same_rows_in_any_batches(spark, tmp_path, cuts):
    rows, wait = changes_of(3), 30 * MINUTE
    df = spark.createDataFrame(rows, "message string, folder string, kind string, at timestamp")
    cuts = [T0 + dt.timedelta(minutes=c) for c in cuts]
    found = states.replayed(df, "at", cuts, lambda s: states.relabels(s, pd.Timedelta(minutes=30)), str(tmp_path))
    micros = lambda t: None if t is None else round((t - T0).total_seconds() * 1e6)
    got = [(r.message, r.outcome, r.from_folder, r.to_folder, micros(r.removed_at), micros(r.added_at)) for r in found.collect()]
    want, end = [], max(micros(r[3]) for r in rows if r[3])
    for m in {r[0] for r in rows if r[0]}:
        waiting, done = states.pair_changes([], [(f, k, micros(t)) for i, f, k, t in rows if i == m and None not in (f, t) and k != "moved"], wait)
        done += [states._expired(w) for w in waiting if w[1] in states.OTHER and w[2] + wait <= end]
        want += [(m, *d) for d in done]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert {r[1] for r in got} == {"corrected", "rejected", "ambiguous"}


def brute_bodies(events, clock):
    """Survivors as a table with a sweep before each event would leave them."""
    held, decided = {}, {}
    for message, kind, at in sorted(events, key=lambda e: (e[2], e[1] != "decision")):
        held = {m: h for m, h in held.items() if h[1] is None or h[1] > at}
        if kind == "decision":
            decided.setdefault(message, at)
            if message in held and held[message][1] is None:
                held[message] = (held[message][0], at + dt.timedelta(days=7))
        else:
            held.setdefault(message, (at, at + dt.timedelta(days=7) if message in decided else None))
    return sorted((m, *h) for m, h in held.items() if h[1] is None or h[1] > clock)


@pytest.mark.parametrize("n_cuts", [0, 3])
def test_bodies_expire_as_a_sweep_would_leave_them(spark, tmp_path, n_cuts):
    r = random.Random(5)
    events = [(f"m{r.randrange(30)}", r.choice(["body", "body", "decision"]), T0 + dt.timedelta(hours=3 * k, microseconds=1000 * k)) for k in range(150)]
    df = spark.createDataFrame([*events, (None, "body", T0), ("m1", "body", None), ("m1", "other", T0)], "message string, kind string, at timestamp")
    cuts = [events[k * 150 // (n_cuts + 1)][2] for k in range(1, n_cuts + 1)]
    changes = states.replayed(df.where("at is not null"), "at", cuts, states.body_expiry, str(tmp_path))
    got = sorted((x.message, x.stored_at, x.expires_at) for x in states.surviving_bodies(changes).collect())
    clock = events[-1][2]
    assert sorted(map(repr, got)) == sorted(map(repr, brute_bodies(events, clock)))
    kept = spark.createDataFrame(got, "message string, stored_at timestamp, expires_at timestamp")
    assert upsert.unexpired(kept, F.lit(clock)).count() == len(got) > 5
    assert changes.where("kind = 'expired'").count() > 5
    numbers = [(x.message, x.change) for x in changes.collect()]
    assert len(set(numbers)) == len(numbers)  # each change once


class Store:
    """A bucket's value and timers as the state store would keep them, and how many calls they took."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), 0

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def clear(self):
        self.calls += 1
        self.value = None

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)


class Clock:
    def __init__(self, millis):
        self.getCurrentWatermarkInMs = lambda: millis


def given(parts):
    return sorted((tuple(None if pd.isna(x) else x for x in r) for p in parts for r in p.itertuples(index=False, name=None)), key=repr)


def test_messages_of_a_bucket_share_calls_of_the_state_store():
    names = [f"m{k}" for k in range(500)]
    store, bodies = Store(), states._Bodies(7000)
    bodies.init(store)
    frame = lambda kind, at: pd.DataFrame({"bucket": 1, "message": names, "kind": kind, "micros": [at + k for k in range(500)]})
    out = given(bodies.handleInputRows((1,), iter([frame("body", 0), frame("decision", 1000)]), None))
    assert len(out) == 1000 and ("m3", 2, "dated", 3, 8003) in out and store.timers == {8} and store.calls <= 3
    store.timers.clear()
    out = given(bodies.handleExpiredTimer((1,), Clock(8), None))  # a timer is never early: it is rounded up to milliseconds
    assert out == [("m0", 3, "expired", 0, 8000)] and store.timers == {9}
    assert given(bodies.handleExpiredTimer((1,), Clock(9), None)) == sorted((f"m{k}", 3, "expired", k, 8000 + k) for k in range(1, 500))
    store.calls = 0
    assert len(given(bodies.handleInputRows((1,), iter([frame("body", 9000)]), None))) == 500 and store.calls <= 4  # numbers and decisions are still known

    store, pairs = Store(), states._Pairs(None)
    pairs.init(store)
    frame = lambda kind, folder, at: pd.DataFrame({"bucket": 1, "message": names, "folder": folder, "kind": kind, "micros": [at + k for k in range(500)]})
    assert given(pairs.handleInputRows((1,), iter([frame("removed", "a", 0)]), None)) == [] and store.calls <= 2 and not store.timers
    out = given(pairs.handleInputRows((1,), iter([frame("added", "b", 2000)]), None))
    assert out == sorted((m, "corrected", "a", "b", k, 2000 + k) for k, m in enumerate(names)) and store.value is None and store.calls <= 4


@pytest.mark.parametrize("buckets", [1, 5])
def test_messages_that_share_a_bucket_do_not_mix(spark, tmp_path, buckets):
    rows, wait = changes_of(4), pd.Timedelta(minutes=30)
    df = spark.createDataFrame(rows, "message string, folder string, kind string, at timestamp")
    found = [states.replayed(df, "at", [rows[70][3]], lambda s, n=n: states.relabels(s, wait, buckets=n), str(tmp_path / str(n))) for n in (buckets, states.BUCKETS)]
    got, want = (sorted(map(repr, x.collect())) for x in found)
    assert got == want and len(got) > 20


@pytest.mark.parametrize("n", [0, 3, 4000])
def test_batches_of_a_replay_are_written_by_many_tasks_and_read_whole(spark, tmp_path, n):
    at = F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("id"))
    rows = spark.range(n).select((F.col("id") % 7).cast("string").alias("message"), F.lit("body").alias("kind"), at.alias("at"))
    cut = dt.datetime.fromtimestamp(1_700_000_000, dt.UTC).replace(tzinfo=None) + dt.timedelta(microseconds=n // 2)
    found = states.replayed(rows, "at", [cut], states.body_expiry, f"file://{tmp_path}/r")
    assert found.count() == min(n, 7) and len(workspace.names(spark, f"{tmp_path}/r/checkpoint/commits")) >= 2 * (n > 0)
    sizes = [spark.read.parquet(f"file://{tmp_path}/r/in/{f}").count() for f in workspace.names(spark, f"{tmp_path}/r/in") if f.startswith("part-")]
    assert sum(sizes) == n and len(sizes) == 2 * spark.sparkContext.defaultParallelism and max(sizes) <= max(2, n // 6)


def test_state_stores_share_one_limit_of_memory(spark):
    states.use_states(spark)
    assert spark.conf.get("spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage") == "true"
