"""The embedding tier, many phrases, curves, percentiles and previews against plain Python."""

import datetime as dt
import math
import random
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.operators import classifier, evaluation, phrases, rules
from tidemill.plans import QUERIES

T0 = dt.datetime(2024, 1, 1)


def newton(x, y, k, penalty):
    """Softmax regression with an L2 penalty (not on intercepts): (k, d) coefficients and centred intercepts, by Newton's method."""
    n, d = x.shape
    z, w = np.hstack([x, np.ones((n, 1))]), np.zeros((k, d + 1))
    ridge = penalty * np.tile(np.r_[np.ones(d), 0.0], k)
    for _ in range(50):
        s = z @ w.T
        p = np.exp(s - s.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        gradient = ((p - np.eye(k)[y]).T @ z / n).reshape(-1) + ridge * w.reshape(-1)
        hessian = np.zeros((k * (d + 1), k * (d + 1)))
        for a in range(k):
            for b in range(k):
                block = (z * (p[:, a] * ((a == b) - p[:, b]))[:, None]).T @ z / n
                hessian[a * (d + 1) : (a + 1) * (d + 1), b * (d + 1) : (b + 1) * (d + 1)] = block
        step = np.linalg.lstsq(hessian + np.diag(ridge), gradient, rcond=None)[0]
        w -= step.reshape(k, d + 1)
        if np.abs(step).max() < 1e-12:
            break
    return w[:, :d], w[:, d] - w[:, d].mean()


def examples(spark, n=240, seed=2):
    r = np.random.default_rng(seed)
    rows = [(i, int(i % 3), [float(v) for v in r.normal(0, 1, 4) + np.eye(4)[i % 3] * 1.5]) for i in range(n)]
    rows += [(n + i, 9, [9.0, 9.0, 9.0, 9.0]) for i in range(14)] + [(n + 20, None, [0.0] * 4), (n + 21, 1, None)]
    return spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>"), rows


def test_regression_is_newtons(spark):
    df, rows = examples(spark)
    model, labels = classifier.fit(df, penalty=0.05)
    assert labels == [0, 1, 2]  # 14 examples of the last are too few
    known = [(x, y) for _, y, x in rows if y in labels and x is not None]
    w, b = newton(np.array([np.float32(x) for x, _ in known], float), np.array([y for _, y in known]), 3, 0.05)
    assert np.abs(model.coefficientMatrix.toArray() - w).max() < 1e-4
    found = np.array(model.interceptVector.toArray())
    assert np.abs(found - found.mean() - b).max() < 1e-4


def test_no_row_is_scored_by_a_model_that_saw_it(spark):
    df, rows = examples(spark)
    fold = {r.vec_id: r.f for r in df.select("vec_id", classifier.fold_of("vec_id", 3).alias("f")).collect()}
    found = {r.vec_id: r.probabilities for r in classifier.cross_fitted(df).collect()}
    assert found.keys() == fold.keys() and found[261] is None
    for f in range(3):
        known = [(x, y) for i, y, x in rows if fold[i] != f and y in (0, 1, 2) and x is not None]
        w, b = newton(np.array([np.float32(x) for x, _ in known], float), np.array([y for _, y in known]), 3, 0.01)
        for i, _, x in rows:
            if fold[i] == f and x is not None:
                s = w @ np.float32(x).astype(float) + b
                p = np.exp(s - s.max())
                assert [found[i][str(k)] for k in range(3)] == pytest.approx((p / p.sum()).tolist(), abs=1e-3)


def test_tier_combines_probabilities_and_votes(spark):
    probabilities = spark.createDataFrame([(1, {"a": 0.9, "b": 0.1}), (2, {"a": 0.6, "b": 0.4}), (3, None), (4, {"a": 0.5, "b": 0.5}), (5, {"a": 0.99, "b": 0.01})], "vec_id long, probabilities map<string,double>")
    votes = spark.createDataFrame([(1, "a", 8, [11, 12, 13]), (1, "b", 2, [14]), (2, "b", 10, [15]), (3, "a", 10, [16]), (5, "c", 10, [17])], "vec_id long, label string, n long, nearest array<long>")
    got = {r.vec_id: (r.label, r.confidence, r.outcome, r.neighbours) for r in classifier.classified(probabilities, votes).collect()}
    assert got == {1: ("a", 0.85, "label", [11, 12, 13]), 2: ("b", 0.7, "escalate", [15]), 3: (None, None, "cold", None), 4: ("a", 0.25, "escalate", None), 5: ("a", 0.495, "escalate", None)}


def test_cold_start(spark):
    df = spark.createDataFrame([(i, i % 2, [float(i % 2), 1.0]) for i in range(20)], "vec_id long, label int, embedding array<float>")
    assert classifier.fit(df, least=15) is None
    assert {r.outcome for r in classifier.embedding_tier(df, df.where("vec_id < 5"), k=3).collect()} == {"cold"}
    assert classifier.embedding_tier(df.limit(0), df.limit(0)).collect() == []


def test_embedding_tier_over_the_tables(spark, sf_dir):
    rows = {r.vec_id: r for r in QUERIES["embedding_tier"](spark, sf_dir).collect()}
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    assert set(rows) == {r.vec_id for r in vectors if r.vec_id % 20 == 0}
    label, known = {r.vec_id: str(r.label) for r in vectors}, {str(r.label) for r in vectors}
    for r in rows.values():
        assert r.label in known and 0 <= r.confidence <= 1 and r.outcome == ("label" if r.confidence >= 0.85 else "escalate")
        assert r.neighbours is None or all(label[n] == r.label and n != r.vec_id for n in r.neighbours)


def test_phrases_are_plain_containment(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), F.substring_index("text", "\n", 1).alias("subject"), F.lower("text").alias("body"))
    texts, r = docs.collect(), random.Random(7)
    bodies = [t.body for t in texts if t.body]
    entries = []
    for k in range(50_000):
        body = r.choice(bodies)
        at = r.randrange(len(body))
        made = body[at : at + r.randrange(1, 30)] if k % 50 == 0 else f"none{k} such"
        entries.append((k % 500, r.choice(["subject", "body", "any"]), made))
    df = spark.createDataFrame(entries, "rule int, place string, entry string")
    start = time.time()
    got = {(x.id, x.rule) for x in phrases.phrase_matches(docs, df).collect()}
    many = time.time() - start
    real = [e for e in entries if not e[2].startswith("none")]
    want = {(t.id, rule) for t in texts for rule, place, e in real if e and ((place != "body" and e in (t.subject or "")) or (place != "subject" and e in (t.body or "")))}
    assert got == want and len(want) > 1000
    start = time.time()
    phrases.phrase_matches(docs, df.limit(5)).collect()
    assert many < 10 * (time.time() - start) + 20
    with pytest.raises(ValueError):
        phrases.phrase_matches(docs, df.union(df)).collect()


def test_rules_with_many_phrases_decide_as_with_few(spark, monkeypatch):
    many = [{"match": {"phrase": [f"p{i}x{k}" for k in range(100)] + ["Ｓhared  Word"] * (i == 3)}, "in": "any", "label": f"l{i}"} for i in range(8)]
    for rule in many:
        rule["match"]["phrase"] = rule["match"]["phrase"][-100:]
    rows = [(1, None, "x.org", "", "aa p7x99 bb"), (2, "a@b", None, "none", None), (3, None, None, "a shared word", None), (4, None, None, None, "p2x50p5x99")]
    df = spark.createDataFrame(rows, "id long, from_address string, from_domain string, subject string, body string")
    entries = rules.rule_entries(spark, many)
    found = sorted(tuple(r) for r in rules.first_match(df, entries).collect())
    assert [r[:3] for r in found] == [(1, 7, "l7"), (2, None, None), (3, 3, "l3"), (4, 2, "l2")]
    monkeypatch.setattr(rules, "FEW", 10_000)
    assert sorted(tuple(r) for r in rules.first_match(df, entries).collect()) == found


def test_learning_curve_by_brute_force(spark, monkeypatch):
    r = random.Random(1)
    at = lambda: T0 + dt.timedelta(hours=r.randrange(200), microseconds=r.randrange(2))
    decisions = [(f"b{i % 3}", i, r.choice("xy"), at()) for i in range(300)]
    confirmed = [(f"b{i % 3}", i, r.choice("xy"), at()) for i in (r.randrange(350) for _ in range(400))]
    schema = "mailbox string, message long, category string, at timestamp"
    got = evaluation.learning_curve(spark.createDataFrame(decisions, schema), spark.createDataFrame(confirmed, schema), step=10)
    truth = {}
    for m, i, c, t in sorted(confirmed, key=lambda x: (x[3], x[2])):
        truth[m, i] = c
    steps = defaultdict(list)
    for m, i, c, t in decisions:
        if (m, i) in truth:
            steps[m, sum(1 for x in confirmed if x[0] == m and x[3] < t) // 10 * 10].append(c == truth[m, i])
    want, so_far = [], defaultdict(list)
    for (m, e), good in sorted(steps.items()):
        so_far[m] += good
        want.append((m, e, len(good), sum(good), round(sum(good) / len(good), 6), len(so_far[m]), round(sum(so_far[m]) / len(so_far[m]), 6)))
    assert sorted(tuple(x) for x in got.collect()) == want


@pytest.mark.parametrize("buckets", [2, 1024])
def test_percentiles_by_key(spark, buckets):
    r = random.Random(4)
    rows = [("a", r.gauss(0, 1)) for _ in range(200)] + [("b", float(r.randrange(3))) for _ in range(99)] + [("b", 1e300), ("b", -1e300), ("c", 7.0), ("d", None), ("d", float("nan")), (None, 5.0)]
    rows += [("e", 1.0 + k * 1e-15) for k in range(40)] + [("e", 1e9)] + [("f", -0.0), ("f", 0.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(3)
    percents = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = {x.k: tuple(x)[1:] for x in evaluation.nearest_ranks_by(df, ["k"], "v", percents, buckets).collect()}
    for key in "abcdef":
        values = sorted(v for k, v in rows if k == key and v is not None and v == v)
        want = tuple(values[max(1, math.ceil(p * len(values))) - 1] if values else None for p in percents.values())
        assert got[key] == want
    assert set(got) == set("abcdef")
    whole = sorted(v for _, v in rows if v is not None and v == v)
    assert tuple(evaluation.nearest_ranks_by(df, [], "v", {"m": 0.5}, buckets).first()) == (whole[math.ceil(len(whole) / 2) - 1],)
    assert tuple(evaluation.nearest_ranks_by(df.limit(0), [], "v", {"m": 0.5}).first()) == (None,)


def test_newest_of_each_mailbox_are_cut_before_the_shuffle(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 3).alias("m"), F.when(F.col("id") % 7 > 0, F.col("id")).alias("at"))
    top = evaluation.latest_messages(df, "m", ["at", "id"], 5)
    want = Counter()
    for m in range(3):
        mine = sorted((i for i in range(m, 1000, 3)), key=lambda i: (i % 7 > 0, i), reverse=True)[:5]
        want.update((i, m) for i in mine)
    assert Counter((r.id, r.m) for r in top.collect()) == want
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_neighbours_of_the_tier_are_no_join_of_pairs(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    found = classifier.embedding_tier(vectors, vectors.where("vec_id % 20 = 0"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "FlatMapCoGroups" in plan
