"""The message-store operators: small cases, and every query with SQL against DuckDB."""

import datetime as dt
import hashlib
import json
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemill.functions import identity, mail, text
from tidemill.operators import decide, rules, scope, store, stream_rules, sync, upsert
from tidemill.plans import ORACLES, QUERIES
from tidemill.sources import rule_documents
from tidemill.streaming.ingest import approve_held, read_or_empty, start_ingest

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(rows, columns):
    def plain(v):
        if v is None or v != v:
            return None
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, (int, float)):
            return f"{float(v):.6f}"
        return str(v)

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(plain(r[i])) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.sql(ORACLES[name])
    got = QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical([tuple(r) for r in got.collect()], got.columns) == canonical(want.fetchall(), want.columns)


def test_match_filters(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "k long, v string")
    ids = lambda d: sorted(r.k for r in d.collect())
    assert ids(scope.match(df, {"v": None})) == [2]
    assert ids(scope.match(df, {"v": []})) == []
    assert ids(scope.match(df, {"k": list(range(3, 70000))})) == [3]
    assert ids(scope.scoped(df, None, "k")) == []


RULE_CASES = [
    ([{"match": {"from": ["A@x.org"]}, "label": "p"}], ("a@X.org", None, "", ""), 0, None),
    ([{"match": {"domain": ["x.org"]}, "label": "p"}], (None, "mail.x.org.", "", ""), 0, None),
    ([{"match": {"domain": ["x.org"]}, "label": "p"}], (None, "notx.org", "", ""), None, 0),
    ([{"match": {"phrase": ["your bill"], "in": "subject"}, "label": "p"}], (None, None, "your bill", ""), 0, None),
    ([{"match": {"phrase": ["your bill"], "in": "subject"}, "label": "p"}], (None, None, "", "your bill"), None, 0),
    ([{"match": {"from": ["a"], "domain": ["b.c"]}, "label": "p"}, {"match": {"from": ["a"]}, "label": "q"}], ("a", "z", "", ""), 1, None),
    ([{"match": {"from": ["z"]}, "label": "p"}, {"match": {"from": ["a"], "phrase": ["q"]}, "label": "q"}], ("a", "z", "", ""), None, 1),
]


@pytest.mark.parametrize("case", RULE_CASES)
def test_rules(spark, case):
    given, message, winner, near = case
    df = spark.createDataFrame([(1, *message)], "id long, from_address string, from_domain string, subject string, body string")
    got = rules.first_match(df, rules.rule_entries(spark, given)).collect()[0]
    assert (got.winner, got.nearest_miss) == (winner, near)


def test_writes(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "x", 1), (3, "y", 2), (3, "z", 1)], "k long, v string, o long")
    assert sorted(map(tuple, upsert.insert_or_ignore(old, new, ["k"], "o").select("k", "v").collect())) == [(3, "z")]
    merged = upsert.upsert(old, upsert.last_of(new, ["k"], "o").select("k", "v"), ["k"], ["v"])
    assert sorted(map(tuple, merged.collect())) == [(1, "a", None), (2, "x", False), (3, "y", True)]
    with pytest.raises(ValueError):
        upsert.upsert(old, old, ["k"], [])
    assert upsert.duplicate_keys(new, ["k"]).collect()[0]["k"] == 3
    items = spark.createDataFrame([("m", 1, False, None, "s1"), ("m", 2, True, "b2", "s2"), ("m", 3, False, "b3", "s3")], "k string, o long, eligible boolean, body string, subject string")
    row = upsert.merged_messages(items, ["k"], "o").collect()[0]
    assert (row.subject, row.eligible, row.body) == ("s1", True, "b2")


def test_watermark_edges(spark):
    wm = dt.datetime(2024, 1, 1, 12)
    df = spark.createDataFrame([(wm - dt.timedelta(minutes=5), wm), (wm - dt.timedelta(minutes=5) + dt.timedelta(milliseconds=1), wm), (wm, None)], "t timestamp, wm timestamp")
    assert [r[0] for r in df.select(stream_rules.is_new(F.col("t"), F.col("wm"))).collect()] == [False, True, True]


def test_text_and_identity(spark):
    df = spark.createDataFrame([(" Ｆoo 　BAR ", "<AbC@Ex.ORG>", "x@y@Ex.Org", "a\r\n\n\n\nb\x07")], "s string, m string, a string, c string")
    row = df.select(
        text.normalise(F.col("s")).alias("n"), identity.message_id(F.col("m")).alias("m"), text.address_parts(F.col("a")).alias("a"),
        text.clean_for_prompt(F.col("c")).alias("c"), text.utf16_cut(F.lit("a😀b"), 2).alias("u"), text.day(F.lit("2026-02-30")).alias("d"),
        text.redact(F.lit("pg://u:pw@h secretly secret"), ["secret", "secretly"]).alias("r"),
    ).collect()[0]
    assert row.n == "foo bar" and row.m == "AbC@ex.org" and tuple(row.a) == ("x@y@ex.org", "ex.org")
    assert row.c == "a\n\nb" and row.u == "a" and row.d is None and row.r == "pg://u:[redacted]@h [redacted] [redacted]"


def test_decisions(spark):
    df = spark.createDataFrame([("label", "x", "llm", "m", 0.6), ("label", None, "llm", "m", 0.6), ("review", None, "llm", None, 1.5)], "o string, c string, t string, m string, p double")
    broken = decide.quarantined(df, decide.decision_checks(*[F.col(c) for c in "octmp"])).collect()
    assert [r.broken for r in broken] == [["category"], ["model", "confidence"]]
    assert df.select(decide.label_or_review(F.col("p"), 0.6)).first()[0] == "label"
    codes = spark.createDataFrame([(200,), (404,), (429,), (400,), (500,)], "s int").select(decide.http_failure(F.col("s"))).collect()
    assert [r[0] for r in codes] == [None, "missing", "busy", "rejected", "server_error"]


def test_sync(spark):
    before = spark.createDataFrame([("a",), ("b",)], "k string")
    after = spark.createDataFrame([("b", 5), ("c", 9), ("d", 1)], "k string, t long")
    assert tuple(sync.resync_counts(before, after, "k", "t", 4).collect()[0]) == (1, 1, 1, 1)


def test_stream(spark, tmp_path):
    rows = [("in", f"m{i % 7}", i, dt.datetime(2024, 1, 1, i), "x") for i in range(10)]
    schema = "folder string, identity string, uid long, internal_date timestamp, body string"
    at = [f"file://{tmp_path}/{x}" for x in ("src", "store", "state", "cp")]
    for k, part in enumerate((rows[:6], rows[2:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(at[0])
        start_ingest(spark.readStream.schema(schema).parquet(at[0]), *at[1:]).awaitTermination(120)
        stored = read_or_empty(spark, f"{at[1]}/*", schema + ", eligible boolean, batch_id long").collect()
        assert sorted(r.identity for r in stored) == sorted({f"m{r[2] % 7}" for r in rows[: 6 + 4 * k]})


def test_stream_keeps_held_rows(spark, tmp_path):
    schema = "folder string, identity string, uid long, internal_date timestamp, body string"
    at = [f"file://{tmp_path}/{x}" for x in ("src", "store", "state", "cp")]
    start = dt.datetime(2024, 1, 1)

    def step(*parts):
        rows = [(f, f"m{i}", i, start + dt.timedelta(minutes=10 * i), "x") for f, ids in parts for i in ids]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(at[0])
        start_ingest(spark.readStream.schema(schema).parquet(at[0]), *at[1:]).awaitTermination(120)
        stored = read_or_empty(spark, f"{at[1]}/*", schema + ", eligible boolean, batch_id long").collect()
        return sorted((r.folder, r.uid) for r in stored if r.eligible), len(stored)

    def want(**folders):
        rows = sorted((f, i) for f, ids in folders.items() for i in ids)
        return rows, len(rows)

    assert step(("big", range(205)), ("small", range(3))) == want(small=range(3))
    assert step(("small", [3])) == want(small=range(4))  # not approved: still held, not lost
    approve_held(spark, at[2], ["big"])
    assert step(("small", [4]), ("big", [205])) == want(big=range(206), small=range(5))
    # the approval is spent: the next backlog is held again, and one that outgrows its approval too
    assert step(("big", range(206, 410))) == want(big=range(206), small=range(5))
    approve_held(spark, at[2], ["big"])
    assert step(("big", range(410, 700))) == want(big=range(206), small=range(5))
    assert step(("small", [5])) == want(big=range(206), small=range(6))
    approve_held(spark, at[2], ["big"])
    assert step(("small", [6])) == want(big=range(700), small=range(7))


def test_nearest_centroid_is_not_called_neighbours(spark, tmp_path):
    assert "nearest_centroid" in QUERIES and "knn_predict" not in QUERIES
    # label 0 has two clusters: its mean is at (1, 1), so neighbours and centroids differ on the rows of one of them
    rows = [(0, [2.0, 0.1], 0), (1, [0.1, 2.0], 0), (2, [1.0, 0.1], 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert {r.vec_id: r.predicted for r in QUERIES["nearest_centroid"](spark, str(tmp_path)).collect()} == {0: 1, 1: 0, 2: 1}


def test_canonical_json(spark):
    maps = [{"k": "a]:[b"}, {"k": "a:b"}, {"b": "x\n\"\\", "a": None}, {}]
    df = spark.createDataFrame([(m,) for m in maps], "m map<string,string>")
    got = [r[0] for r in df.select(identity.canonical_map(F.col("m"))).collect()]
    assert got == [json.dumps(m, sort_keys=True, separators=(",", ":")) for m in maps]
    row = df.limit(1).select(identity.canonical_array([F.lit('a"\\\n\x01'), F.lit(None)]).alias("a"), identity.is_identity(F.lit("hdr:v1:" + "0" * 64)).alias("i")).first()
    assert json.loads(row.a) == ['a"\\\n\x01', None] and row.i


def test_trusted_ids(spark):
    df = spark.createDataFrame([(" a-b\x00= ", True), ("a b", True), ("ab", False), ("", True), (None, True)], "p string, t boolean")
    got = [r[0] for r in df.select(identity.identity_key(F.col("p"), F.lit("x@y"), F.lit("h"), F.col("t"))).collect()]
    assert got == ["pm:a-b=", "mid:x@y", "mid:x@y", "mid:x@y", "mid:x@y"]


def test_repeated_keys_are_refused(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b")], "k long, v string")
    with pytest.raises(Exception, match="two rows with one key"):
        upsert.upsert(rows.limit(1), rows, ["k"], ["v"]).collect()
    with pytest.raises(ValueError):
        store.updated(rows, {"id": 1}, {"k": 1})
    assert store.deleted(rows, {"v": []})[1].count() == 0
    taken = spark.createDataFrame([("a", "b")], "old_key string, new_key string")
    with pytest.raises(Exception, match="the key is taken"):
        store.renamed(spark.createDataFrame([("a",), ("b",)], "slug string"), "slug", taken).collect()


def test_windows_over_buckets(spark, monkeypatch):
    monkeypatch.setattr(stream_rules, "BUCKET", 7)
    draw = random.Random(3)
    rows = [(k, i, draw.random() < 0.8) for k in "ab" for i in sorted(draw.sample(range(120), 80))] + [("c", i, True) for i in range(40)] + [("d", 3, False)]
    df = spark.createDataFrame(rows, "k string, i long, f boolean").repartition(5)
    for k in "abcd":
        mine = [(i, f) for key, i, f in rows if key == k]
        islands, longest, run = [], 0, 0
        for i, f in mine:
            if islands and islands[-1][1] == i - 1:
                islands[-1][1] = i
            else:
                islands.append([i, i])
            run = run + 1 if f else 0
            longest = max(longest, run)
        one = df.where(F.col("k") == k)
        assert sorted([r.low, r.high] for r in stream_rules.uid_islands(one, ["k"], "i").collect()) == islands
        assert stream_rules.failure_runs(one, ["k"], "i", F.col("f"), 5).first()["longest_run"] == longest
        assert sorted((r.i, r.chunk) for r in stream_rules.chunks(one, ["k"], "i", 9).collect()) == [(i, n // 9) for n, (i, _) in enumerate(mine)]


def test_nearest_ranks(spark):
    draw = random.Random(8)
    for values in ([1.0], [2.0, 2.0, 2.0], [draw.gauss(0, 10) for _ in range(501)], [float(draw.randint(0, 5)) for _ in range(100)]):
        df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
        got = stream_rules.nearest_ranks(df, "v", {"a": 0.5, "b": 0.95, "c": 1.0}, buckets=16).first()
        want = [sorted(values)[max(0, -int(-p * len(values) // 1) - 1)] for p in (0.5, 0.95, 1.0)]
        assert list(got) == want
    assert tuple(stream_rules.nearest_ranks(df.where("v > 99"), "v", {"a": 0.5}).first()) == (None,)


def test_rule_documents():
    good = {"version": 1, "categories": [{"name": "a"}, {"name": "b"}], "rules": [{"match": {"from": ["X@y"]}, "label": "a"}]}
    assert rule_documents.document_faults(good) == []
    bad = {**good, "odd": 1, "categories": [{"name": "a"}, {"name": "A"}], "judgment": ["x" * 4001]}
    bad["rules"] = [{"match": {"from": ["x"] * 101, "in": "subject"}, "label": "c"}] * 501
    faults = rule_documents.document_faults(bad)
    assert {f.split(":")[0] for f in faults} >= {"odd", "categories[1]", "judgment", "rules", "rules[0].match.from", "rules[0].match.in", "rules[500].label"}
    assert rule_documents.parsed_document("x" * (256 * 1024 + 1))[0] is None and rule_documents.document_faults([]) != []
    same = {**good, "rules": [{"label": "a", "match": {"from": [" x@Y "]}}]}
    assert rule_documents.rule_set_text(good) == rule_documents.rule_set_text(same)
    assert hashlib.sha256(rule_documents.rule_set_text(good).encode()).hexdigest() != hashlib.sha256(rule_documents.rule_set_text({**good, "judgment": ["x"]}).encode()).hexdigest()
    with pytest.raises(ValueError):
        rules.rule_entries(None, [{"match": {"from": ["x"] * 101}, "label": "a"}])


def test_mail(spark):
    rows = [("Name <a@b>", "Fri, 02 Feb 2024 01:00:00 -0500", "=?bad?x?="), ('"Q. \\"X\\"" <a@b>', "2 Feb 2024 01:00 +0000", "=?utf-8?q?=C3=A9?="), ("a@b", "yesterday", None), (None, None, "plain")]
    df = spark.createDataFrame(rows, "f string, d string, w string")
    got = df.select(mail.display_name(F.col("f")), mail.mail_date(F.col("d")), mail.decoded_words(F.col("w"))).collect()
    assert [tuple(r) for r in got] == [
        ("Name", dt.datetime(2024, 2, 2, 6), "=?bad?x?="), ('Q. "X"', dt.datetime(2024, 2, 2, 1), "é"), (None, None, None), (None, None, "plain")
    ]
    html = spark.createDataFrame([("<p>One <b>two</b><br>three</p><script>x</script>",), (None,), ("",)], "h string")
    assert [r[0] for r in html.select(text.html_text(F.col("h"))).collect()] == ["One two\nthree", None, ""]
    assert html.select(text.one_line(F.lit("a\n\n b\tc"), 5)).first()[0] == "a b c"


def test_batch_that_runs_again(spark, tmp_path):
    """The second run of a batch gives the same rows and the same watermark; a repeat that is eligible makes the message so."""
    from tidemill.streaming.ingest import store_batch

    schema = "folder string, identity string, uid long, internal_date timestamp, body string"
    store_at, state = f"file://{tmp_path}/store", f"file://{tmp_path}/state"
    late, new = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)
    store_batch(spark.createDataFrame([("in", "m0", 1, new, "x")], schema), store_at, state, 0)
    again = spark.createDataFrame([("in", "m1", 2, late, "x"), ("in", "m1", 3, dt.datetime(2999, 1, 1), "x")], schema)
    seen = []
    for _ in range(2):
        store_batch(again, store_at, state, 1)
        stored = read_or_empty(spark, f"{store_at}/*", schema + ", eligible boolean, batch_id long").collect()
        marks = read_or_empty(spark, f"{state}/*", "folder string, watermark timestamp, batch_id long").collect()
        seen.append((sorted((r.identity, r.uid, r.eligible) for r in stored), sorted((r.batch_id, r.watermark) for r in marks)))
    assert seen[0] == seen[1] and seen[0][0] == [("m0", 1, True), ("m1", 2, True)]


def test_prompt_fence(spark):
    from tidemill.functions import prompt

    df = spark.createDataFrame([("say abc123",)], "b string")
    shown = df.select(prompt.user_prompt(F.lit(None), F.lit("s"), F.col("b"), F.lit("zz9"))).first()[0]
    assert shown == "--- message zz9 ---\nFrom: \nSubject: s\n\nsay abc123\n--- end zz9 ---"
    with pytest.raises(Exception, match="holds the nonce"):
        df.select(prompt.user_prompt(F.lit(None), F.lit("s"), F.col("b"), F.lit("abc123"))).collect()


def test_mail_files(spark, tmp_path):
    from tidemill.sources.mail_files import mail_files

    inner = "From: x@y\r\nContent-Type: text/plain\r\n\r\ninside"
    files = {
        "plain.eml": 'From: "A" <a@b>\r\nSubject: one\r\n two\r\n\r\nhello\r\n',
        "mixed.eml": 'Content-Type: multipart/mixed; boundary="B"\r\n\r\n--B\r\nContent-Type: text/html; charset=latin-1\r\nContent-Transfer-Encoding: quoted-printable\r\n\r\n<p>=E9</p>\r\n'
        '--B\r\nContent-Type: text/plain\r\nContent-Disposition: attachment; filename="n.txt"\r\n\r\nnote\r\n--B\r\nContent-Type: message/rfc822\r\n\r\n' + inner + "\r\n--B--\r\n",
        "empty.eml": "\n",
        "other.txt": "Subject: no",
    }
    for name, body in files.items():
        (tmp_path / name).write_bytes(body.encode())
    rows = mail_files(spark, f"file://{tmp_path}").select(
        F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), mail.header_fields(F.col("header_block")).alias("h"), mail.text_part(F.col("parts")).alias("t"), mail.attachments(F.col("parts")).alias("a")
    )
    got = {r.name: r for r in rows.collect()}
    assert set(got) == {"plain.eml", "mixed.eml", "empty.eml"}
    assert [tuple(x) for x in got["plain.eml"].h] == [("from", '"A" <a@b>'), ("subject", "one two")] and got["plain.eml"].t.text == "hello\r\n"
    assert got["mixed.eml"].t.part == "1" and got["mixed.eml"].t.text.strip() == "<p>é</p>" and [x.name for x in got["mixed.eml"].a] == ["n.txt"]
    assert got["empty.eml"].h == [] and got["empty.eml"].t.text == ""


def test_neighbours_in_blocks(spark, monkeypatch):
    from tidemill.operators import model_tier

    draw = random.Random(1)
    rows = [(i, [draw.gauss(i % 3, 1.0) for _ in range(4)], i % 3) for i in range(90)] + [(90 + i, [9.0, 9.0, 9.0, 9.0], 7) for i in range(14)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    found = lambda: sorted(map(tuple, model_tier.neighbour_vote(df.where("vec_id % 5 = 0"), df, 5).collect()))
    whole = found()
    assert len(whole) == 21 and all(r[1] != 7 for r in whole)  # too few examples of label 7
    monkeypatch.setattr(model_tier, "QUERY_BLOCK", 4)
    assert found() == whole


def test_ten_thousand_rules_limit(spark):
    many = [{"match": {"phrase": [f"p{i}x{k}" for k in range(100)]}, "label": f"l{i}"} for i in range(20)]
    df = spark.createDataFrame([(1, None, None, "", "aa p7x99 bb"), (2, None, None, "none", None)], "id long, from_address string, from_domain string, subject string, body string")
    got = {r.id: (r.winner, r.label, r.nearest_miss, r.met, r.total) for r in rules.first_match(df, rules.rule_entries(spark, many)).collect()}
    assert got == {1: (7, "l7", None, None, None), 2: (None, None, 0, 0, 1)}
    none = rules.rule_entries(spark, many).limit(0)
    assert {(r.winner, r.nearest_miss, r.met) for r in rules.first_match(df, none).collect()} == {(None, None, 0)}


def plain_neighbours(asked, known, k):
    """(vec_id, n_id, s) by definition: cosines summed up one by one, rounded half up, ties by id; those without a cosine last."""
    import math
    from decimal import ROUND_HALF_UP, Decimal

    def cosine(q, v):
        if q is None or v is None or len(q) != len(v) or None in q or None in v:
            return None
        dots = []
        for a, b in ((q, v), (q, q), (v, v)):
            total = 0.0
            for x, y in zip(a, b, strict=True):
                total += x * y
            dots.append(total)
        return float(Decimal(repr(dots[0] / math.sqrt(dots[1] * dots[2]))).quantize(Decimal("0.000001"), ROUND_HALF_UP))

    found = []
    for i, q in asked:
        near = [(cosine(q, v), n) for n, v in known if n != i]
        found += [(i, n, s) for s, n in sorted(near, key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))[:k]]
    return sorted(found, key=repr)


@pytest.mark.parametrize("blocks", [(7, 40), (1000, 1000)])
def test_nearest_by_products_of_blocks(spark, blocks):
    from tidemill.operators import neighbours

    draw = random.Random(2)
    vectors = [(i, [float(draw.choice([-2, -1, 0.5, 1, 3])) for _ in range(3)]) for i in range(300)]  # many ties
    vectors += [(1000 + i, [1.0, 1.0, 1.0]) for i in range(60)] + [(2000 + i, [draw.gauss(0, 1) for _ in range(3)]) for i in range(60)]
    vectors += [(3000, None), (3001, [1.0, None, 1.0]), (3002, [1.0, 2.0]), (3003, [2.0, 1.0]), (None, [1.0, 2.0, 3.0]), (3004, [1e-150, 1e-150, 0.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in vectors], "vec_id long, v array<double>, label int")
    known = df.select(F.col("vec_id").alias("n_id"), "label", "v")
    for k, chosen in ((5, "vec_id % 5 = 0 or vec_id >= 3000"), (9, "vec_id in (3000, 3002)")):
        found = neighbours.nearest(df.where(chosen).select("vec_id", F.col("v").alias("q")), known, k, *blocks)
        got = sorted(((r.vec_id, r.n_id, r.s) for r in found.collect()), key=repr)
        asked = [(i, v) for i, v in vectors if i is not None and ((i % 5 == 0 or i >= 3000) if k == 5 else i in (3000, 3002))]
        assert got == plain_neighbours(asked, [(i, v) for i, v in vectors if i is not None], k)
    small = df.where("vec_id in (3002, 3003, 3000)")
    found = neighbours.nearest(small.select("vec_id", F.col("v").alias("q")), small.select(F.col("vec_id").alias("n_id"), "label", "v"), 5, *blocks)
    assert sorted(((r.vec_id, r.n_id, r.s) for r in found.collect()), key=repr) == plain_neighbours(*[[(i, v) for i, v in vectors if i in (3000, 3002, 3003)]] * 2, 5)
    assert neighbours.nearest(df.limit(0).select("vec_id", F.col("v").alias("q")), known, 5, *blocks).count() == 0


def test_a_block_of_pairs_is_a_product_and_keeps_few_of_them():
    import time

    import numpy as np
    import pyarrow as pa

    from tidemill.operators import neighbours

    draw = np.random.default_rng(1)
    vectors = draw.normal(size=(20_000, 64)).astype("float32")
    vectors[::3] = vectors[0]  # a third are the same, asked for by a third of the queries
    table = lambda rows, names: pa.table({names[0]: pa.array(rows), names[1]: pa.array(vectors[rows].tolist(), pa.list_(pa.float32())), "label": pa.array(rows % 10)})
    asked, known = table(np.arange(0, 20_000, 20), ("vec_id", "q")), table(np.arange(20_000), ("n_id", "v"))
    start = time.thread_time()
    found = neighbours.block_nearest(asked, known, 10)
    assert time.thread_time() - start < 20  # 20 million pairs; one by one they take minutes
    of = lambda i: [r["n_id"] for r in found.filter(pa.compute.equal(found["vec_id"], i)).to_pylist()]
    assert of(0) == list(range(3, 33, 3)) and of(60) == list(range(0, 30, 3)) and len(found) == 10_000
