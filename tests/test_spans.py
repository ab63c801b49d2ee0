"""Traces: written as their rule says, and every break of it named."""

import copy
import json
import random

import pytest
from pyspark.sql import functions as F

from tidemill.operators import rules, spans

RULES = [
    {"match": {"domain": ["x.org"], "phrase": ["your bill", "pay now"], "in": "subject"}, "label": "bills"},
    {"match": {"from": ["a@b"], "domain": ["b"], "phrase": ["hello"]}, "label": "friend"},
    {"match": {"phrase": ["hello"], "in": "body"}, "label": "greeting"},
    {"match": {"domain": ["x.org"]}, "label": "x"},
]


def brute_span(message):
    _, sender, domain, subject, body = message
    met = []
    for rule in RULES:
        m = rule["match"]
        passed = {}
        if "from" in m:
            passed["from"] = sender in m["from"]
        if "domain" in m:
            passed["domain"] = domain is not None and any(domain == d or domain.endswith("." + d) for d in m["domain"])
        if "phrase" in m:
            texts = [subject or ""] * (m.get("in", "any") != "body") + [body or ""] * (m.get("in", "any") != "subject")
            passed["phrase"] = any(p in t for p in m["phrase"] for t in texts)
        met.append(passed)
    ref = lambda i: {"index": i, "name": f"rules[{i}]", "label": RULES[i]["label"]}
    matches = [ref(i) for i, p in enumerate(met) if all(p.values())]
    near = max(range(len(met)), key=lambda i: (sum(met[i].values()) / len(met[i]), -i))
    miss = {**ref(near), "conditions": [{"field": f, "pass": ok} for f, ok in met[near].items()], "met": sum(met[near].values()), "total": len(met[near])}
    return {"kind": "exact_rules", "rules_checked": len(RULES), "matches": matches, "winner": matches[0] if matches else None, "nearest_miss": None if matches else miss}


def test_rule_spans_by_brute_force(spark):
    r = random.Random(2)
    rows = [(i, r.choice([None, "a@b", "c@d"]), r.choice([None, "x.org", "mail.x.org", "b", "notx.org"]), r.choice([None, "", "your bill", "hello"]), r.choice([None, "say hello", "pay now", "none"])) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, from_address string, from_domain string, subject string, body string")
    found = spans.decided_traces(spans.exact_rules_spans(df, rules.rule_entries(spark, RULES)))
    got = {x.id: x for x in found.collect()}
    want = {m[0]: brute_span(m) for m in rows}
    assert set(got) == {i for i, s in want.items() if s["winner"]}  # without an answer of the model others are not decided
    shown = {x.id: json.loads(x.t) for x in spans.exact_rules_spans(df, rules.rule_entries(spark, RULES)).select("id", F.to_json("rules_span", {"ignoreNullFields": "false"}).alias("t")).collect()}
    assert shown == want
    for i, row in got.items():
        trace = json.loads(row.spans)
        assert [s["kind"] for s in trace] == ["exact_rules", "classifier", "action"] and trace[0] == want[i]
        assert row.spans == json.dumps(trace, sort_keys=True, separators=(",", ":"))
        assert (row.outcome, row.category, row.tier, row.review_reason, row.confidence) == ("labelled", want[i]["winner"]["label"], "exact_rules", None, None)
    nothing = spans.exact_rules_spans(df, rules.rule_entries(spark, RULES).limit(0)).first().rules_span
    assert nothing.rules_checked == 0 and nothing.matches == [] and nothing.winner is None and nothing.nearest_miss is None


GOOD = '{"reason":" so ","category":"work","confidence":0.9}'


def test_model_spans(spark):
    rows = [
        (1, 1, 200, GOOD, "stop", 5), (1, 2, 200, "no", "stop", 5),
        (2, 1, 200, "no", "stop", 5), (2, 2, 200, GOOD.replace("0.9", "0.5"), "stop", 6),
        (3, 1, 200, GOOD, "length", 5), (3, 2, 200, GOOD.replace("work", "play"), "stop", 5),
        (4, 1, 500, None, None, None), (5, 1, 200, "no", "stop", 5), (5, 2, 503, None, None, None), (6, 1, 200, GOOD, "stop", 8000), (6, 2, 200, GOOD, "stop", 5),
    ]
    df = spark.createDataFrame(rows, "id long, attempt int, status int, raw string, done_reason string, prompt_tokens int").repartition(3)
    found = spans.llm_spans(df, "id", [("work", "w"), ("home", "h")], 0.85, "m", 3, "a" * 64, ["be kind"], {"seed": 42})
    got = {r.id: (r.llm_span, r.failure) for r in found.collect()}
    codes = {i: s and [a.validation.code for a in s.attempts] for i, (s, _) in got.items()}
    assert codes == {1: [None], 2: ["not_json", None], 3: ["truncated", "out_of_category"], 4: None, 5: None, 6: ["input_too_long"]}
    assert tuple(got[1][0].result) == ("so", "work", 0.9) and got[3][0].result is None and got[5][1] == "infra"
    none = spark.createDataFrame([(i, None) for i in range(1, 8)], f"id long, rules_span {spans.RULES_SPAN}")
    made = none.select("id", F.struct(F.lit("exact_rules").alias("kind"), F.lit(0).alias("rules_checked"), F.array().cast("array<struct<index:int,name:string,label:string>>").alias("matches"), F.lit(None).cast("struct<index:int,name:string,label:string>").alias("winner"), F.lit(None).alias("nearest_miss")).cast(spans.RULES_SPAN).alias("rules_span"))
    decided = {r.id: r for r in spans.decided_traces(made, found).withColumn("faults", spans.trace_faults(F.col("spans"))).collect()}
    assert {i: (r.outcome, r.category, r.review_reason, r.confidence) for i, r in decided.items()} == {
        1: ("labelled", "work", None, 0.9), 2: ("review", None, "low_confidence", 0.5), 3: ("review", None, "out_of_category", None), 6: ("review", None, "input_too_long", None),
    }
    assert all(r.faults == [] for r in decided.values())  # an outage (4, 5) and what has no answer yet (7) are no decisions
    llm = json.loads(decided[2].spans)[2]
    assert llm["options"] == {"seed": 42} and llm["judgment_rules"] == ["be kind"] and llm["attempts"][1]["prompt_tokens"] == 6


RULE_REF = {"index": 0, "name": "rules[0]", "label": "l"}
TRACE = [
    {"kind": "exact_rules", "rules_checked": 1, "matches": [], "winner": None, "nearest_miss": {**RULE_REF, "conditions": [{"field": "from", "pass": False}], "met": 0, "total": 1}},
    {"kind": "classifier", "status": "skipped", "reason": "not trained"},
    {
        "kind": "llm", "model": "m", "prompt_version": 1, "prompt_hash": "0" * 64, "categories": [{"name": "work", "description": ""}], "judgment_rules": [], "options": {},
        "attempts": [{"raw": "x", "done_reason": "stop", "prompt_tokens": 1, "validation": {"ok": True, "code": None}}], "result": {"reason": "r", "category": "work", "confidence": 0.5}, "confidence": 0.5, "threshold": 0.5,
    },
    {"kind": "action", "status": "pending", "intent": {"type": "label", "label": "work", "reason": None}},
]


def broken(change):
    trace = copy.deepcopy(TRACE)
    change(trace)
    return json.dumps(trace)


def put(i, *path):
    *path, value = path

    def change(trace):
        at = trace[i]
        for k in path[:-1]:
            at = at[k]
        at[path[-1]] = value

    return change


TWO = [{"raw": "x", "validation": {"ok": False, "code": "not_json"}}, {"raw": "y", "validation": {"ok": True, "code": None}}]
BROKEN = [
    (lambda t: None, []),
    (put(2, "attempts", TWO), []),
    (lambda t: t.pop(2), []),
    (lambda t: t.reverse(), ["layout"]),
    (lambda t: t.pop(1), ["layout", "classifier"]),
    (lambda t: t.append(t[3]), ["layout"]),
    (put(0, "winner", RULE_REF), ["rules"]),
    (put(0, "nearest_miss", "met", 1), ["rules"]),
    (put(0, "rules_checked", None), ["rules"]),
    (put(1, "reason", "busy"), ["classifier"]),
    (put(2, "attempts", []), ["attempts", "validation"]),
    (put(2, "attempts", TWO + TWO), ["attempts"]),
    (put(2, "attempts", 0, "validation", {"ok": False, "code": "tired"}), ["validation"]),
    (put(2, "attempts", 0, "validation", {"ok": True, "code": "not_json"}), ["validation"]),
    (put(2, "result", None), ["validation", "confidence"]),
    (put(2, "categories", []), ["categories", "result"]),
    (put(2, "result", "category", "play"), ["result"]),
    (put(2, "confidence", 0.6), ["confidence"]),
    (put(2, "threshold", 1.5), ["confidence"]),
    (put(2, "prompt_hash", "A" * 64), ["prompt"]),
    (put(2, "prompt_version", 0), ["prompt"]),
    (put(3, "status", "done"), ["action"]),
    (put(3, "intent", {"type": "label", "label": "", "reason": None}), ["action"]),
    (put(3, "intent", {"type": "review", "label": None, "reason": "tired"}), ["action"]),
    (put(3, "intent", {"type": "review", "label": None, "reason": "llm_error"}), []),
]


@pytest.mark.parametrize("whole", [True])
def test_every_break_of_a_trace_is_named(spark, whole):
    texts = [(i, broken(change)) for i, (change, _) in enumerate(BROKEN)] + [(98, "no json"), (99, None)]
    got = {r.i: r.f for r in spark.createDataFrame(texts, "i int, t string").select("i", spans.trace_faults(F.col("t")).alias("f")).collect()}
    assert got == {**{i: f for i, (_, f) in enumerate(BROKEN)}, 98: ["unread"], 99: ["unread"]}
