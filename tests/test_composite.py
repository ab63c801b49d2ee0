"""Writes that are several at once, one mailbox's view, backfill beside polling, reports."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.operators import candidates, composite, tenant
from tidemill.sources import reports
from tidemill.streaming import backfill, ingest

T0 = dt.datetime(2024, 1, 1)
WEEK = dt.timedelta(days=7)

ITEM = "identity string, ordinal long, folder string, uidvalidity long, uid long, generation int, eligible boolean, body string, subject string"
MESSAGE = "identity string, eligible boolean, subject string"
PLACE = "folder string, uidvalidity long, uid long, identity string, generation int, removed_at timestamp, removed_reason string"
BODY = "identity string, body string, expires_at timestamp"


class PlainStore:
    """The same rules over dictionaries, an item at a time."""

    def __init__(self):
        self.messages, self.places, self.bodies = {}, {}, {}

    def store(self, items, decided, at, promote):
        groups = {}
        for i in sorted(items, key=lambda i: i[1]):
            groups.setdefault(i[0], []).append(i)
        counts = [0] * 5
        for identity, group in groups.items():
            some = any(i[6] for i in group)
            if identity not in self.messages:
                self.messages[identity] = (some, group[0][8])
                counts[0] += 1
            else:
                counts[1] += 1
                if promote and some and not self.messages[identity][0]:
                    self.messages[identity] = (True, self.messages[identity][1])
                    counts[2] += 1
        for i in sorted(items, key=lambda i: i[1]):
            known = self.places.get(i[2:5])
            counts[3] += known is None
            self.places[i[2:5]] = (i[0] if known is None or known[3] else known[0], i[5], None, None) if known is None else (known[0], i[5], None, None)
        last = {i[2:5]: i for i in sorted(items, key=lambda i: i[1])}
        for place, i in last.items():
            if place in self.fresh:
                self.places[place] = (i[0], i[5], None, None)
        for identity, group in groups.items():
            body = next((i[7] for i in group if i[7] is not None), None)
            if self.messages[identity][0] and body is not None and identity not in self.bodies:
                self.bodies[identity] = (body, at + WEEK if identity in decided else None)
                counts[4] += 1
        return tuple(counts)


@pytest.mark.parametrize("promote", [False, True])
def test_chunks_by_brute_force(spark, promote):
    r = random.Random(11 + promote)
    plain, decided = PlainStore(), {f"m{k}" for k in range(0, 30, 4)}
    tables = {"messages": spark.createDataFrame([], MESSAGE), "locations": spark.createDataFrame([], PLACE), "bodies": spark.createDataFrame([], BODY)}
    decisions = spark.createDataFrame([(d,) for d in sorted(decided)] * 2, "identity string")
    for chunk in range(3):
        items = []
        for k in range(40):
            m = r.randrange(30)
            items.append((f"m{m}", k, r.choice("ab"), 1, r.randrange(25), chunk, r.random() < 0.4, r.choice([None, f"b{k}"]), f"s{k}"))
        at = T0 + dt.timedelta(days=chunk)
        for again in range(2 if chunk == 1 else 1):
            plain.fresh = {i[2:5] for i in items} - set(plain.places)
            want = plain.store(items, decided, at, promote)
            after = composite.store_chunk(spark.createDataFrame(items, ITEM).repartition(3), tables["messages"], tables["locations"], tables["bodies"], decisions, at, promote)
            assert tuple(after["counts"].first()) == want
            assert want[0] == want[2] == want[3] == want[4] == 0 or not again  # a chunk stored twice adds nothing
            tables = {name: spark.createDataFrame(after[name].collect(), after[name].schema) for name in tables}
        assert {r.identity: (r.eligible, r.subject) for r in tables["messages"].collect()} == plain.messages
        assert {(r.folder, r.uidvalidity, r.uid): (r.identity, r.generation, r.removed_at, r.removed_reason) for r in tables["locations"].collect()} == plain.places
        assert {r.identity: (r.body, r.expires_at) for r in tables["bodies"].collect()} == plain.bodies


def test_a_place_that_is_known_lives_again_but_keeps_its_message(spark):
    places = spark.createDataFrame([("a", 1, 5, "old", 1, T0, "vanished"), ("a", 1, 6, "other", 1, T0, "vanished")], PLACE)
    items = spark.createDataFrame([("new", 1, "a", 1, 5, 3, True, None, "s")], ITEM)
    after = composite.store_chunk(items, spark.createDataFrame([], MESSAGE), places, spark.createDataFrame([], BODY), spark.createDataFrame([], "identity string"), T0)
    assert sorted(tuple(r) for r in after["locations"].collect()) == [("a", 1, 5, "old", 3, None, None), ("a", 1, 6, "other", 1, T0, "vanished")]
    assert tuple(after["counts"].first()) == (1, 0, 0, 0, 0)


DECISION = (
    "message_id long, id long, decided_at timestamp, outcome string, category string, tier string, review_reason string, confidence double, prompt_version int, model string, decided_by string, trace_format int, "
    "spans array<struct<kind:string,model:string,confidence:double,attempts:int,result:string,categories:array<string>,intent:string,label:string,reason:string>>"
)


def decision(message, id_, hour, by="worker", outcome="labelled", attempts=1):
    kind = lambda k, **m: tuple({**dict.fromkeys("kind model confidence attempts result categories intent label reason".split()), "kind": k, **m}.values())
    label = outcome == "labelled"
    action = kind("action", intent="label", label="work") if label else kind("action", intent="review", reason="low_confidence")
    spans = [kind("exact_rules"), kind("classifier"), kind("llm", model="m", confidence=0.9, attempts=attempts, result="work", categories=["work"]), action]
    return (message, id_, T0 + dt.timedelta(hours=hour), outcome, "work" if label else None, "llm", None if label else "low_confidence", 0.9, 1, "m", by, 1, spans)


def test_decisions_are_stored_with_their_clock_or_not_at_all(spark):
    made = [
        decision(1, 1, 5), decision(1, 2, 3), decision(1, 3, 1, attempts=3),  # the earliest that meets the checks
        decision(2, 4, 1, by="rerun"), decision(2, 5, 2, by="rerun"), decision(2, 6, 3),
        decision(3, 7, 1, attempts=0), decision(4, 8, 1), decision(5, 9, 1, outcome="review"), decision(6, 10, 1, outcome="maybe"),
    ]
    bodies = spark.createDataFrame([(m, T0 if m == 5 else None) for m in range(1, 8)], "message_id long, expires_at timestamp")
    known = spark.createDataFrame([decision(4, 100, 0)], DECISION)
    after = composite.record_decisions(spark.createDataFrame(made, DECISION).repartition(3), known, bodies)
    assert sorted(r.id for r in after["decisions"].collect()) == [2, 4, 5, 6, 9, 100]
    refused = {r.id: r.broken for r in after["refused"].collect()}
    assert refused[1] == refused[8] == ["worker"] and refused[3] == refused[7] == ["span.attempts"] and "row.outcome" in refused[10] and len(refused) == 5
    clock = {r.message_id: r.expires_at for r in after["bodies"].collect()}
    hours = lambda n: T0 + dt.timedelta(hours=n) + WEEK
    assert clock == {1: hours(3), 2: hours(1), 3: None, 4: None, 5: T0, 6: None, 7: None}
    again = composite.record_decisions(spark.createDataFrame([decision(2, 50, 90, by="rerun")], DECISION), after["decisions"], after["bodies"])
    assert {r.message_id: r.expires_at for r in again["bodies"].collect()} == clock  # a rerun never extends


def test_one_mailbox_sees_its_own(spark, tmp_path):
    for name, rows in {"message": [(i, i % 3, f"s{i}") for i in range(12)], "location": [(i, i % 3, None) for i in range(0, 12, 2)]}.items():
        spark.createDataFrame(rows, "id long, mailbox_id long, t string").write.parquet(f"{tmp_path}/{name}")
    read = lambda name: spark.read.parquet(f"{tmp_path}/{name}")
    raw = {"message": read("message"), "location": read("location")}
    box = tenant.Mailbox(spark, raw, 1)
    assert sorted(r.id for r in box.table("message").collect()) == [1, 4, 7, 10]
    text = "select m.id from {message} m where exists (select 1 from {location} l where l.id = m.id) and t <> :t"
    assert sorted(r.id for r in box.sql(text, {"t": "s4"}).collect()) == [10]
    assert tenant.Mailbox(spark, raw, None).sql("select * from {message}").collect() == []
    mine = box.table("message")
    refused = [
        mine.join(raw["location"], "id"),
        mine.join(raw["location"].where("mailbox_id = 2"), "id"),
        mine.join(raw["location"], "id", "left_semi"),
        mine.where(F.col("id") > 0).unionByName(raw["message"]),
        spark.sql("select * from {m} where id in (select id from {l})", m=mine, l=raw["location"]),
        spark.sql("select *, (select max(id) from {l}) as top from {m}", m=mine, l=raw["location"]),
        raw["location"].where("mailbox_id = 1 or id = 3"),
    ]
    for df in refused:
        with pytest.raises(tenant.UnscopedRead):
            box.checked(df)
    allowed = [
        mine.join(raw["location"].where("mailbox_id = 1"), "id"),
        mine.join(raw["location"].alias("l"), ["id", "mailbox_id"]),  # the equality carries the filter over
        spark.sql("select *, (select max(id) from {l}) as top from {m}", m=mine, l=box.table("location")),
        raw["message"].where("t <> 'x' and 1 = mailbox_id").groupBy("t").count(),
    ]
    for df in allowed:
        assert box.checked(df) is df and df.count() >= 0


def test_pages_by_all_conditions(spark):
    r = random.Random(2)
    rows = [(i, T0 + dt.timedelta(days=r.randrange(20)), r.random() < 0.7) for i in range(200)]
    messages = spark.createDataFrame(rows, "id long, internal_date timestamp_ntz, eligible boolean")
    live, decided = {i for i in range(200) if i % 5}, {i for i in range(200) if i % 3 == 0}
    locations, decisions = (spark.createDataFrame([(i,) for i in sorted(x)], "id long") for x in (live, decided))
    bodies = spark.createDataFrame([(i, f"b{i}") for i in range(0, 200, 4)], "id long, text string")
    since, before = T0 + dt.timedelta(days=3), (T0 + dt.timedelta(days=15), 100)
    for ids in (None, [], list(range(0, 200, 2))):
        for pending_only in (True, False):
            got = candidates.candidate_page(messages, bodies, locations, decisions, ["id"], 20, since=since, ids=ids, before=(str(before[0]), before[1]), pending_only=pending_only)
            want = [(i, t) for i, t, e in rows if e and i in live and t >= since and (t, i) < before and (ids is None or i in ids) and not (pending_only and i in decided)]
            want = sorted(want, key=lambda x: (x[1], x[0]), reverse=True)[:20]
            found = {x.id: (x.decided, x.body.text if x.body else None) for x in got.collect()}
            assert found == {i: (i in decided, f"b{i}" if i % 4 == 0 else None) for i, _ in want}


# --- backfill beside polling

SCHEMA = T.StructType().add("folder", "string").add("identity", "string").add("uid", "long").add("internal_date", "timestamp").add("body", "string")


def mail(n=60, seed=3):
    r = random.Random(seed)
    rows = [(r.choice(["in", "out"]), f"m{r.randrange(n - 10)}", u, T0 + dt.timedelta(hours=r.randrange(200)), f"b{u}" if u % 3 else None) for u in range(1, n)]
    return rows + rows[5:8]


def test_any_interleaving_of_the_streams_gives_the_same_store(spark, tmp_path):
    rows, since, seen = mail(), T0 + dt.timedelta(hours=60), []
    listing = spark.createDataFrame(rows, SCHEMA)
    polls = [rows[k : k + 16] for k in range(0, len(rows), 16)]
    for k, order in enumerate((["slice"] * 6 + ["poll"] * 4, ["poll"] * 4 + ["slice"] * 6, ["slice", "poll", "poll", "slice", "slice", "poll", "again", "slice", "poll", "slice", "slice"])):
        store, state = f"{tmp_path}/{k}/store", f"{tmp_path}/{k}/state"
        backfill.begin_backfill(listing, state, since)
        number = batch = 0
        for step in order:
            if step == "poll":
                ingest.store_batch(spark.createDataFrame(polls[batch], SCHEMA), store, state, batch)
                batch += 1
            else:
                number += step == "slice"  # or the last slice again
                backfill.backfill_slice(listing, store, state, number, size=6)
        assert backfill.progress(spark, state).where("done < total").count() == 0
        merged = backfill.messages(spark, store, SCHEMA).collect()
        assert len({(m.folder, m.identity) for m in merged}) == len(merged)
        seen.append({(m.folder, m.identity): (m.uid, m.eligible, m.body) for m in merged})
    window = {(f, i) for f, i, _, t, _ in rows if t >= since}
    assert seen[0].keys() == {(f, i) for f, i, *_ in rows} and all(seen[0][m][1] for m in window)
    polled = [{m: v for m, v in s.items()} for s in seen]
    assert polled[0] == polled[1] == polled[2]


def test_backfill_ends_and_goes_on(spark, tmp_path):
    store, state = f"{tmp_path}/store", f"{tmp_path}/state"
    rows = mail(40, 5)
    listing = spark.createDataFrame(rows, SCHEMA)
    backfill.begin_backfill(listing, state, T0)
    assert backfill.backfill_slice(listing, store, state, 1, size=5) == 10
    gone = listing.where("uid % 2 = 0")  # half of the mail goes meanwhile, some comes
    late = spark.createDataFrame([("in", "late", 900, T0 + dt.timedelta(days=90), None)], SCHEMA)
    assert backfill.run_backfill(gone.union(late), store, state, size=5) > 1
    assert {r.folder for r in backfill.progress(spark, state).where("done = total").collect()} == {"in", "out"}
    found = {r.uid for r in spark.read.schema(SCHEMA).parquet(f"{store}-backfill").collect()}
    assert 900 not in found and {u for _, _, u, _, _ in rows if u % 2 == 0} <= found
    backfill.begin_backfill(listing, state, T0 + dt.timedelta(days=900))
    assert backfill.progress(spark, state).count() == 0 and backfill.backfill_slice(listing, store, state, 1) == 0


# --- reports

GOOD = {"probeVersion": 1, "uidValidity": {"in": 7, "out": 8.0}, "sample": [{"uid": 1, "internalDate": "d", "internalIdSha256": "x"}, {"uid": 2, "internalDate": "e", "internalIdSha256": None}], "folders": ["in", "out"], "more": {"a": [1]}}
REPORTS = [
    (json.dumps(GOOD), []),
    (json.dumps({**GOOD, "sample": []}), []),
    (json.dumps(GOOD)[:-1], ["not_json"]),
    ("", ["not_json"]),
    (None, ["not_json"]),
    ("[1]", ["not_json"]),
    (json.dumps({**GOOD, "probeVersion": 2}), ["version"]),
    (json.dumps({**GOOD, "probeVersion": "1"}), ["version"]),
    (json.dumps({k: v for k, v in GOOD.items() if k != "probeVersion"}), ["version"]),
    (json.dumps({**GOOD, "uidValidity": {"in": "7"}}), ["uid_validity"]),
    (json.dumps({**GOOD, "uidValidity": {"in": None}}), ["uid_validity"]),
    (json.dumps({k: v for k, v in GOOD.items() if k != "sample"}), ["sample"]),
    (json.dumps({**GOOD, "sample": [{"uid": "1", "internalDate": "d", "internalIdSha256": "x"}]}), ["sample"]),
    (json.dumps({**GOOD, "sample": [{"uid": 1, "internalDate": 5, "internalIdSha256": "x"}]}), ["sample"]),
    (json.dumps({**GOOD, "sample": [{"uid": 1, "internalDate": "d", "internalIdSha256": 5}]}), ["sample"]),
    (json.dumps({**GOOD, "sample": [None]}), ["sample"]),
]


def test_reports_and_their_faults(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(REPORTS)], "i int, value string")
    got = {r.i: r for r in reports.read_reports(df).collect()}
    assert {i: r.faults for i, r in got.items()} == {i: f for i, (_, f) in enumerate(REPORTS)}
    assert all((r.report is None) == bool(r.faults) for r in got.values())
    assert got[0].report.uid_validity == {"in": 7, "out": 8} and [tuple(s) for s in got[0].report.sample] == [(1, "d", "x"), (2, "e", None)]


def test_compared_reports(spark):
    entry = lambda u, d, i: {"uid": u, "internalDate": d, "internalIdSha256": i}
    old = {**GOOD, "sample": [entry(1, "d", "a"), entry(2, "d", "b"), entry(3, "d", "c"), entry(4, "d", None)], "folders": ["in", "gone"]}
    new = {**GOOD, "sample": [entry(9, "d", "a"), entry(2, "x", "b"), entry(2, "d", "b")], "folders": ["z", "in", "a"]}
    read = lambda value: reports.read_reports(spark.createDataFrame([("k", json.dumps(value))], "k string, value string"))
    found = reports.compared(read(old), read(new), "k").first()
    assert (found.n_matched, found.n_uid_changed, found.n_date_changed, found.n_missing) == (2, 1, 0, 1)
    assert found.new_folders == ["a", "z"] and found.missing_folders == ["gone"]
    empty = reports.compared(read({**old, "sample": []}), read(new), "k").first()
    assert (empty.n_matched, empty.n_missing) == (0, 0)


def test_entries_that_repeat_and_settings_out_of_range(spark):
    df = spark.createDataFrame([("d", 0, "A", "s"), ("d", 1, "a", None), ("d", 2, "b", "s"), ("d", 3, "a", None), ("e", 0, "A", "s")], "doc string, place int, slug string, server string")
    found = reports.duplicate_entries(df, "doc", "place", {"slug": F.lower("slug"), "server": F.col("server")}).collect()
    assert sorted(tuple(r) for r in found) == [("d", "server", 0, 2, "s"), ("d", "slug", 0, 1, "a"), ("d", "slug", 0, 3, "a")]
    settings = spark.createDataFrame([(1, 5, None), (2, 0, 3.5), (3, 201, 3.0)], "id int, cap int, days double")
    assert sorted(tuple(r) for r in reports.out_of_range(settings, ["id"], {"cap": (1, 200), "days": (0, 9)}).collect()) == [(2, "cap", 0.0), (2, "days", 3.5), (3, "cap", 201.0)]


def test_what_rules_and_prompts_see_of_a_candidate(spark):
    kind = "id int, from_address string, from_domain string, subject string, headers map<string,array<string>>, attachments array<struct<name:string,size:int>>, body struct<text:string>"
    rows = [
        (1, "a@b", "b", "s", {"from": ['"Doe, J." <a@b>', "Other <o@p>"], "sender": ["No <n@o>"]}, [("x", 1), (None, 2), ("y", 3)], ("t",)),
        (2, None, None, None, None, None, None),
        (3, "a@b", "b", "", {"from": []}, [], (None,)),
    ]
    got = {r.id: (tuple(r.matchable), tuple(r.untrusted)) for r in candidates.projected(spark.createDataFrame(rows, kind)).collect()}
    assert got[1] == (("a@b", "b", "s", "t"), ("a@b", "Doe, J.", "s", ["x", "y"], "t"))
    assert got[2] == ((None, None, None, None), ("", None, "", [], ""))
    assert got[3] == (("a@b", "b", "", None), ("a@b", None, "", [], ""))
