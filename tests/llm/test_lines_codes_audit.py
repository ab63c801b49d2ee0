"""Line deduplication, vector codes and the filter audit against plain Python."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.llm import code_compression as cc
from tidemill.llm import filter_audit as fa
from tidemill.llm import line_dedup as ld
from tidemill.llm import queries as q

NONE = -(1 << 63)


# --- line deduplication


def folded(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\v\f\r"))


def brute_lines(rows, min_chars=40, min_docs=5):
    held = defaultdict(list)
    for id_, text in rows:
        for key in {folded(x) for x in (text or "").split("\n")}:
            if len(key) >= min_chars:
                held[key].append(NONE if id_ is None else id_)
    out = []
    for id_, text in rows:
        lines = (text or "").split("\n")
        own = NONE if id_ is None else id_
        kept = [x for x in lines if len(held[folded(x)]) < min_docs or max(held[folded(x)]) == own]
        out.append((id_, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def line_rows(seed=3):
    r = random.Random(seed)
    pool = [("Éa" + chr(65 + i % 26)) * 14 + str(i) for i in range(60)]

    def line():
        s = r.choice(pool[: r.choice([3, 60])]) if r.random() < 0.8 else "x" * r.randrange(50)
        return r.choice([" ", "\t", "", "\x85"]) + (s if r.random() < 0.5 else s.upper()) + r.choice(["", "\r", "  "])

    rows = [(i if r.random() < 0.9 else r.choice([None, 5, 7]), "\n".join(line() for _ in range(r.randrange(9)))) for i in range(300)]
    return rows + [(None, None), (3, ""), (4, "\n"), (900, "a" * 10**6), (901, "\n".join(pool) * 50)] + [(77, "\n".join(pool[:4]))] * 40


@pytest.mark.parametrize("broadcast_bytes", [64 << 20, 0])
def test_lines_by_brute_force(spark, docs_of, monkeypatch, broadcast_bytes):
    monkeypatch.setattr(ld, "SHARD_KEYS", 16)
    monkeypatch.setattr(ld, "TASK_PROBES", 50)
    rows = line_rows()
    docs = docs_of(rows).withColumn("drop_", F.lit("mine")).withColumn("n_lines", F.lit(7)).withColumn("hash_", F.lit(1))
    found = ld.dedup_lines(docs, broadcast_bytes=broadcast_bytes)
    assert found.columns == [c for c in docs.columns if c != "n_lines"] + ["n_lines", "n_dropped", "kept_text"]
    got = [(r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in found.collect()]
    assert sorted(got, key=repr) == brute_lines(rows)
    assert found.where("drop_ != 'mine' or hash_ != 1").count() == 0


def test_lines_of_other_bounds_and_of_nothing(spark, docs_of):
    rows = [(i, "the same line\nline %d" % (i // 2)) for i in range(6)]
    found = ld.dedup_lines(docs_of(rows), min_chars=5, min_docs=2).collect()
    assert sorted([(r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in found]) == brute_lines(rows, 5, 2)
    assert ld.dedup_lines(docs_of([(1, "x")]).limit(0)).collect() == []
    assert [r["kept_text"] for r in ld.dedup_lines(docs_of([(1, "x"), (2, None)])).orderBy("doc_id").collect()] == ["x", ""]
    with pytest.raises(ValueError):
        ld.dedup_lines(docs_of(rows), min_docs=1)


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 60_000])
def test_perfect_hash_gives_each_key_a_place_of_its_own(n):
    r = np.random.default_rng(n)
    h1, h2 = r.integers(0, 1 << 63, n).astype(np.uint64), r.integers(0, 1 << 63, n).astype(np.uint64)
    h1[: n // 3] = h1[:1] if n else h1[:0]  # first hashes that collide
    made = ld.PerfectHash.build(h1, h2)
    assert sorted(made.places(h1, h2).tolist()) == list(range(n))
    outside = made.places(h2 + np.uint64(1), h1)
    assert ((outside >= -1) & (outside < max(n, 1))).all() and len(made.words) * 64 <= 6 * n + 64 * len(made.levels)


def test_line_index_holds_counts_and_last_holders(spark, docs_of):
    rows = line_rows()
    index = ld.line_index(docs_of(rows))
    held = defaultdict(list)
    for id_, text in rows:
        for key in {folded(x) for x in (text or "").split("\n")}:
            if len(key) >= 40:
                held[key].append(NONE if id_ is None else id_)
    often = Counter((len(ids), max(ids)) for ids in held.values() if len(ids) > 1)
    got = Counter()
    for row in index.collect():
        shard = ld.Shard(row)
        assert len(shard.counts) == row["n"]
        got.update(zip(shard.counts.tolist(), shard.keepers.tolist(), strict=True))
    assert got == often


# --- vector codes


def brute_codes(rows, n_parts=4, entries=256, rounds=4):
    """rows: (id, floats or None, label)."""
    kept = [(i, [int(np.floor(np.float64(x) * 1024)) for x in v], g) for i, v, g in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    width = len(kept[0][1]) // n_parts
    codes, errors, text = [""] * len(kept), [0] * len(kept), []
    for p in range(n_parts):
        parts = [v[p * width : (p + 1) * width] for _, v, _ in kept]
        book = [list(x) for x in parts[:entries]]

        def nearest(x, book=book):
            return min((sum((a - b) ** 2 for a, b in zip(x, y, strict=True)), e) for e, y in enumerate(book))

        for _ in range(rounds):
            own = [nearest(x)[1] for x in parts]
            for e in set(own):
                inside = [x for x, o in zip(parts, own, strict=True) if o == e]
                book[e] = [sum(c) // len(inside) for c in zip(*inside, strict=True)]
        for k, x in enumerate(parts):
            d, e = nearest(x)
            codes[k] += f"{e:02x}"
            errors[k] += d
        text += [str(c) for y in book for c in y]
    digest = hashlib.sha256(",".join(text).encode()).hexdigest()
    by_label = Counter()
    for (_, _, g), d in zip(kept, errors, strict=True):
        by_label[g] += d
    most = (1 << 63) - 1
    return sorted([(i, c, min(d, most), min(by_label[g], most), digest) for (i, _, g), c, d in zip(kept, codes, errors, strict=True)], key=repr)


def codes_of(df, **more):
    return sorted([tuple(r) for r in cc.compress_vectors(df, **more).collect()], key=repr)


def vectors(spark, rows, label="int"):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], f"vec_id long, embedding array<float>, label {label}, code string, n int")


def test_codes_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(cc, "BLOCK", 37)
    r = random.Random(4)
    grid = [[r.randrange(3) / 64 for _ in range(8)] for _ in range(150)]  # many ties
    cloud = [[r.gauss(0, 0.2) for _ in range(8)] for _ in range(250)]
    rows = [(i, [float(np.float32(x)) for x in v], r.choice([0, 1, None])) for i, v in enumerate(grid + cloud)]
    rows += rows[:20] + [(None, rows[5][1], 1), (1000, None, 1), (1001, [*rows[0][1][:7], None], 1), (1002, [float("nan")] * 8, 2), (1003, [float("-inf")] * 8, 2)]
    r.shuffle(rows)
    df = vectors(spark, rows).repartition(5)
    for entries in (16, 256):
        assert codes_of(df, entries=entries) == brute_codes(rows, entries=entries)


def test_codes_of_huge_few_and_no_vectors(spark):
    huge = [(i, [float(np.float32((-1) ** i * 10.0 ** (4 + i % 5)))] * 4, 1) for i in range(12)]
    found, wanted = codes_of(vectors(spark, huge), entries=3), brute_codes(huge, entries=3)
    assert found == wanted and max(r[2] for r in wanted) > 1 << 50
    one = [(7, [0.5, 0.25, -0.1, 0.0], None)]
    assert codes_of(vectors(spark, one)) == brute_codes(one)
    assert codes_of(vectors(spark, [(1, None, 1)])) == []
    assert codes_of(vectors(spark, [(1, [], 1), (2, [], 1)], "string")) == brute_codes([(1, [], 1), (2, [], 1)])
    with pytest.raises(ValueError):
        codes_of(vectors(spark, [(1, [1.0] * 5, 1)]))


def test_heaps_rescan_little_and_stay_exact():
    r = np.random.default_rng(5)
    values = np.floor(r.normal(0, 200, (3000, 4))).astype(np.int64)
    book, drift = values[:40].copy(), np.zeros(40)
    heaps, scanned = cc.Heaps.empty(3000, 40), []
    heaps.scan(np.arange(3000), values, book, drift)
    for _ in range(12):
        new = book.copy()
        for e in np.unique(heaps.codes):
            new[e] = values[heaps.codes == e].sum(0) // (heaps.codes == e).sum()
        drift += cc._drifts(book, new)
        book = new
        rows = heaps.pop(drift)
        heaps.scan(rows, values, book, drift)
        scanned.append(len(rows))
        assert (heaps.codes == cc.squared_distances(values, book).argmin(1)).all()
        assert sum(map(len, heaps.heaps)) == 3000
    assert scanned[-1] < 1500


# --- filter audit


def brute_audit(rows, labels):
    """rows: (id, text, lang); labels: (id, quality, toxic)."""
    good, toxic = ({x[0] for x in labels if x[k] == 1 and x[0] is not None} for k in (1, 2))
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    fails = []
    for i, t, g in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {x for x, so in zip("ABCD", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), re.search(r"[#$%&*|]", t)), strict=True) if so}
        fails.append((g or "", f | ({"E"} if i is not None and i > least[t] else set()), i in good, i in toxic))
    out, removed_by = [], Counter()
    for part in {x[0] for x in fails}:
        mine = [x for x in fails if x[0] == part]
        for order in map("".join, permutations("ABCDE")):
            for step, x in enumerate(order, 1):
                before = set(order[: step - 1])
                gone = [m for m in mine if x in m[1] and not m[1] & before]
                removed_by[part, x] += len(gone)
                kept = sum(not m[1] & (before | {x}) for m in mine)
                redundant = sum(x in m[1] and bool(m[1] & before) for m in mine)
                out.append([part, order, step, kept, len(gone), redundant, sum(m[1] == {x} for m in mine), sum(m[2] for m in gone), sum(m[3] for m in gone)])
    return sorted(tuple([*r, removed_by[r[0], r[1][r[2] - 1]]]) for r in out)


def audit_rows():
    r = random.Random(6)
    bag = [f"w{i}" for i in range(400)] + ["W", "AB", "é", "#"]

    def text():
        return r.choice([" ", "\n", "\x85"]).join(r.choice(bag[: r.choice([20, 300, 404])]) for _ in range(r.choice([3, 150, 230, 400])))

    pool = [text() for _ in range(25)] + [None, "", " \t", "A" * 200_000]
    rows = [(r.choice([i, i, i, 7, None]), r.choice(pool) if r.random() < 0.6 else text(), r.choice(["en", "de", "", None])) for i in range(150)]
    return rows + [(9, "hot", "xx")] * 60 + [(None, "hot", "xx")] * 20 + [(8, "hot", "xx"), (50, "hot", "en")]


def audited(spark, rows, labels):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, mask int, part string").repartition(4)
    judged = spark.createDataFrame([(*x, 1) for x in labels], "doc_id long, quality int, toxic int, part int")
    return sorted(tuple(r) for r in fa.filter_audit(docs, judged).collect())


@pytest.mark.parametrize("local_bytes", [32 << 20, 500])
def test_audit_by_brute_force(spark, monkeypatch, local_bytes):
    monkeypatch.setattr(fa, "LOCAL_BYTES", local_bytes)
    rows = audit_rows()
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 120, 2)] + [(7, 1, None), (7, 0, 1), (None, 1, 1), (9, None, 1)]
    found = audited(spark, rows, labels)
    assert found == brute_audit(rows, labels)
    assert len(found) == 600 * len({g or "" for _, _, g in rows})


def test_audit_of_nothing_and_of_colliding_fingerprints(spark, monkeypatch):
    assert audited(spark, [], []) == []
    rows = [(x % 11, (x % 3, x % 11)) for x in range(40)]
    records = spark.sparkContext.parallelize([(5, f"t{t}".encode(), i, t) for i, (t, _) in rows] + [(5, b"t0", None, 0)], 3)
    found = fa.route_copies(records, 4).collect()
    least = {t: min(i for i, (u, _) in rows if u == t) for t in range(3)}
    assert Counter(found) == Counter([(i, t, i > least[t]) for i, (t, _) in rows] + [(None, 0, False)])


def test_queries_of_this_round_by_brute_force(spark, sf_dir):
    docs = q.table(spark, sf_dir, "documents").collect()
    got = sorted([tuple(r) for r in q.op11_line_dedup(spark, sf_dir).collect()], key=repr)
    lines = brute_lines([(r["doc_id"], r["text"]) for r in docs])
    assert got == sorted([(i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in lines], key=repr)
    labels = [(r["doc_id"], r["quality"], r["toxic"]) for r in q.table(spark, sf_dir, "labels").collect()]
    assert sorted(tuple(r) for r in q.op13_filter_audit(spark, sf_dir).collect()) == brute_audit([(r["doc_id"], r["text"], r["lang"]) for r in docs], labels)
    rows = q.table(spark, sf_dir, "embeddings").collect()
    got = sorted(tuple(r) for r in q.op12_code_compression(spark, sf_dir).where("vec_id < 1000000").collect())
    ids = {r["vec_id"] for r in rows}
    assert {r[0] for r in got} == ids and all(len(r[1]) == 8 for r in got)
