"""Traces: what each tier saw and said of a message, as spans in a fixed order, written as canonical JSON and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import canonical
from .model_tier import ATTEMPTS, answer_verdict
from .decide import model_answer
from .rules import with_hits
from .trace import REASONS

# Fields of a rule in the order in which they are shown, and what an attempt may fail with.
FIELDS = ("from", "domain", "phrase")
FAILURES = ("not_json", "schema_mismatch", "out_of_category", "truncated", "input_too_long", "llm_error")

_REF = "index:int,name:string,label:string"
RULES_SPAN = (
    f"struct<kind:string,rules_checked:int,matches:array<struct<{_REF}>>,winner:struct<{_REF}>,"
    f"nearest_miss:struct<{_REF},conditions:array<struct<field:string,pass:boolean>>,met:int,total:int>>"
)
ATTEMPT = "struct<raw:string,done_reason:string,prompt_tokens:int,validation:struct<ok:boolean,code:string>>"
ANSWER = "struct<reason:string,category:string,confidence:double>"
LLM_SPAN = (
    "struct<kind:string,model:string,prompt_version:int,prompt_hash:string,categories:array<struct<name:string,description:string>>,judgment_rules:array<string>,"
    f"options:map<string,double>,attempts:array<{ATTEMPT}>,result:{ANSWER},confidence:double,threshold:double>"
)
CLASSIFIER_SPAN = "struct<kind:string,status:string,reason:string>"
ACTION_SPAN = "struct<kind:string,status:string,intent:struct<type:string,label:string,reason:string>>"


def exact_rules_spans(messages: DataFrame, entries: DataFrame) -> DataFrame:
    """(id, rules_span) of each message: how many rules were checked, all that matched in order, the first as winner; without one the nearest miss, field by field.

    The nearest miss is the rule with the highest fraction of fields met, the first among equals, even if it met none. A rule
    without a name is called by its place. All of it is decided within the message's row, from the hits of ``rules.with_hits``.
    """
    order = F.array(*[F.lit(f) for f in FIELDS])
    told = entries.groupBy("rule").agg(F.collect_set("field").alias("of"), F.first("label").alias("label"))
    told = told.select("rule", F.filter(order, lambda f: F.array_contains("of", f)).alias("fields"), "label")
    # bounded by the checks on rules: at most some hundreds
    known = told.agg(F.map_from_entries(F.collect_list(F.struct("rule", F.struct("fields", "label")))).alias("__told"), F.min("rule").alias("__first_rule"), F.count(F.lit(1)).cast("int").alias("__n"))
    hit = with_hits(messages, entries).select("id", "hits").crossJoin(F.broadcast(known))  # one row
    rule = lambda r: F.try_element_at("__told", r)
    ref = lambda r: [r.cast("int").alias("index"), F.concat(F.lit("rules["), r.cast("string"), F.lit("]")).alias("name"), rule(r)["label"].alias("label")]
    met = lambda r: F.size(F.filter("hits", lambda h: h["rule"] == r))
    seen = F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["rule"])))
    whole = F.filter(seen, lambda r: met(r) == F.size(rule(r)["fields"]))
    placed = hit.withColumn("matches", F.transform(whole, lambda r: F.struct(*ref(r))))
    tried = F.when(F.col("__n") > 0, F.array_distinct(F.concat(seen, F.array(F.col("__first_rule")))))
    share = lambda r: (met(r) * 6 / F.size(rule(r)["fields"])).cast("int")  # noqa: E731  a rule has one to three fields
    near = placed.withColumn("__near", -F.array_max(F.transform(tried, lambda r: F.struct(share(r).alias("share"), (-r).alias("order"))))["order"])
    r = F.col("__near")
    conditions = F.transform(rule(r)["fields"], lambda f: F.struct(f.alias("field"), F.exists("hits", lambda h: (h["rule"] == r) & (h["field"] == f)).alias("pass")))
    miss = F.struct(*ref(r), conditions.alias("conditions"), met(r).alias("met"), F.size(rule(r)["fields"]).alias("total"))
    span = F.struct(
        F.lit("exact_rules").alias("kind"),
        F.col("__n").alias("rules_checked"),
        F.col("matches"),
        F.get("matches", F.lit(0)).alias("winner"),
        F.when((F.size("matches") == 0) & r.isNotNull(), miss).alias("nearest_miss"),
    )
    return near.select("id", span.cast(RULES_SPAN).alias("rules_span"))


def llm_spans(answers: DataFrame, key: str, categories: list[tuple[str, str]], threshold: float, model: str, prompt_version: int, prompt_hash: str, judgment: list[str] = (), options: dict[str, float] | None = None) -> DataFrame:
    """(key, llm_span, failure) from recorded ``answers`` (key, attempt, status, raw, done_reason, prompt_tokens).

    The span holds every attempt that counts with its validation: the second only if the first was invalid output. ``result`` is the answer that validated, else null. A message whose last
    attempt is an outage has no span, for it is not decided; ``failure`` says how it ended (null with a result).
    """
    names = [n for n, _ in categories]
    read = answers.where(F.col("attempt") <= ATTEMPTS).withColumn("__a", model_answer(F.col("raw"), names))
    verdict = answer_verdict(F.col("status"), F.col("__a.verdict"), F.col("done_reason"), F.col("prompt_tokens"))
    step = F.struct("attempt", verdict.alias("verdict"), "raw", "done_reason", F.col("prompt_tokens").cast("int").alias("prompt_tokens"), F.struct("__a.reason", "__a.category", "__a.confidence").alias("answer"))
    folded = read.withColumn("__s", step).groupBy(key).agg(F.array_sort(F.collect_list("__s")).alias("s"))  # two at most
    first = F.get("s", F.lit(0))
    again = first["verdict"].isin("not_json", "schema_mismatch", "out_of_category", "truncated")
    used = folded.withColumn("s", F.slice("s", 1, F.when(again, ATTEMPTS).otherwise(1)))
    last = F.element_at("s", -1)
    ok = last["verdict"] == "ok"
    validation = lambda a: F.struct((a["verdict"] == "ok").alias("ok"), F.when(a["verdict"] != "ok", a["verdict"]).alias("code"))
    attempts = F.transform("s", lambda a: F.struct(a["raw"].alias("raw"), a["done_reason"].alias("done_reason"), a["prompt_tokens"].alias("prompt_tokens"), validation(a).alias("validation")))
    named = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(d).alias("description")) for n, d in categories])
    said = F.when(ok, last["answer"])
    settings = F.map_from_arrays(F.array(*[F.lit(k) for k in options]), F.array(*[F.lit(float(v)) for v in options.values()])) if options else F.create_map().cast("map<string,double>")
    span = F.struct(
        F.lit("llm").alias("kind"), F.lit(model).alias("model"), F.lit(prompt_version).alias("prompt_version"), F.lit(prompt_hash).alias("prompt_hash"), named.alias("categories"),
        F.array(*[F.lit(j) for j in judgment]).cast("array<string>").alias("judgment_rules"), settings.alias("options"), attempts.alias("attempts"), said.alias("result"), said["confidence"].alias("confidence"), F.lit(float(threshold)).alias("threshold"),
    )
    infra = last["verdict"] == "infra"
    return used.select(key, F.when(~infra, span.cast(LLM_SPAN)).alias("llm_span"), F.when(~ok, last["verdict"]).alias("failure"))


def decided_traces(rule_spans: DataFrame, model_spans: DataFrame | None = None) -> DataFrame:
    """(id, outcome, category, tier, review_reason, confidence, spans) for each message that is decided; ``spans`` is the trace as canonical JSON.

    A rule's winner decides first. Otherwise the model's answer does: at the threshold or above a label, below it a review for low_confidence; an answer that never validated is a review too, by what
    the last attempt failed with. A message without either (no answer yet, or an outage) is left out: an outage is never a decision.
    """
    joined = rule_spans if model_spans is None else rule_spans.join(model_spans, "id", "left")
    if model_spans is None:
        joined = joined.withColumns({"llm_span": F.lit(None).cast(LLM_SPAN), "failure": F.lit(None).cast("string")})
    winner, llm = F.col("rules_span.winner"), F.col("llm_span")
    by_rule = winner.isNotNull()
    sure = llm["confidence"] >= llm["threshold"]
    label = F.when(by_rule, winner["label"]).when(sure, llm["result"]["category"])
    why = F.when(F.col("failure").isin("not_json", "schema_mismatch", "truncated"), "invalid_output").otherwise(F.col("failure"))
    reason = F.when(label.isNull(), F.coalesce(why, F.lit("low_confidence")))
    decided = joined.where(by_rule | llm.isNotNull()).withColumns({"category": label, "review_reason": reason})
    intent = F.struct(F.when(F.col("category").isNotNull(), "label").otherwise("review").alias("type"), F.col("category").alias("label"), F.col("review_reason").alias("reason"))
    action = F.struct(F.lit("action").alias("kind"), F.lit("pending").alias("status"), intent.alias("intent"))
    skipped = F.struct(F.lit("classifier").alias("kind"), F.lit("skipped").alias("status"), F.lit("not trained").alias("reason"))
    written = [canonical(F.col("rules_span"), RULES_SPAN), canonical(skipped, CLASSIFIER_SPAN), F.when(~by_rule, canonical(F.when(~by_rule, llm), LLM_SPAN)), canonical(action, ACTION_SPAN)]
    return decided.select(
        "id",
        F.when(F.col("category").isNotNull(), "labelled").otherwise("review").alias("outcome"),
        "category",
        F.when(by_rule, "exact_rules").otherwise("llm").alias("tier"),
        "review_reason",
        F.when(~by_rule, llm["confidence"]).alias("confidence"),
        F.concat(F.lit("["), F.concat_ws(",", *written), F.lit("]")).alias("spans"),
    )


#: All fields of all kinds of spans: how a trace is read.
READ = (
    "array<struct<kind:string,rules_checked:int,matches:array<struct<index:int,name:string,label:string>>,winner:struct<index:int,name:string,label:string>,"
    "nearest_miss:struct<index:int,name:string,label:string,conditions:array<struct<field:string,pass:boolean>>,met:int,total:int>,status:string,reason:string,model:string,prompt_version:int,prompt_hash:string,"
    f"categories:array<struct<name:string,description:string>>,attempts:array<{ATTEMPT}>,result:{ANSWER},confidence:double,threshold:double,"
    "intent:struct<type:string,label:string,reason:string>>>"
)


def trace_faults(spans: Column) -> Column:
    """The names of what a trace's text breaks: unread, layout, rules, classifier, attempts, validation, categories, result, confidence, prompt, action; empty for a good one."""
    t = F.from_json(spans, READ)
    kinds = F.transform(t, lambda s: s["kind"])
    of = lambda kind: F.get(F.filter(t, lambda s: s["kind"] == kind), F.lit(0))
    rules, skipped, llm, action = (of(k) for k in ("exact_rules", "classifier", "llm", "action"))
    layouts = [F.array(*[F.lit(k) for k in x]) for x in (("exact_rules", "classifier", "action"), ("exact_rules", "classifier", "llm", "action"))]
    between = lambda c: c.between(0, 1)
    first_match = F.get(rules["matches"], F.lit(0))
    miss = rules["nearest_miss"]
    passed = F.size(F.filter(miss["conditions"], lambda c: c["pass"]))
    attempt_good = lambda a: a["validation"]["ok"].isNotNull() & (a["validation"]["ok"] == a["validation"]["code"].isNull()) & (a["validation"]["code"].isNull() | a["validation"]["code"].isin(*FAILURES))
    answered = F.exists(llm["attempts"], lambda a: a["validation"]["ok"])
    intent = action["intent"]
    good = {
        "layout": (kinds == layouts[0]) | (kinds == layouts[1]),
        "rules": rules["rules_checked"].isNotNull() & rules["matches"].isNotNull() & rules["winner"].eqNullSafe(first_match)
        & (miss.isNull() | (rules["winner"].isNull() & (miss["total"] == F.size(miss["conditions"])) & (miss["met"] == passed) & (miss["met"] < miss["total"]))),
        "classifier": (skipped["status"] == "skipped") & (skipped["reason"] == "not trained"),
        "attempts": llm.isNull() | F.size(llm["attempts"]).between(1, ATTEMPTS),
        "validation": llm.isNull() | (F.forall(llm["attempts"], attempt_good) & (answered == llm["result"].isNotNull())),
        "categories": llm.isNull() | ((F.size(llm["categories"]) > 0) & F.forall(llm["categories"], lambda c: F.length(c["name"]) > 0)),
        "result": llm.isNull() | llm["result"].isNull() | F.exists(llm["categories"], lambda c: c["name"] == llm["result"]["category"]),
        "confidence": llm.isNull() | (between(llm["threshold"]) & llm["confidence"].eqNullSafe(llm["result"]["confidence"]) & (llm["confidence"].isNull() | between(llm["confidence"]))),
        "prompt": llm.isNull() | ((llm["prompt_version"] > 0) & llm["prompt_hash"].rlike("^[0-9a-f]{64}$") & (F.length(llm["model"]) > 0)),
        "action": (action["status"] == "pending")
        & (((intent["type"] == "label") & (F.length(intent["label"]) > 0) & intent["reason"].isNull()) | ((intent["type"] == "review") & intent["reason"].isin(*REASONS) & intent["label"].isNull())),
    }
    named = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in good.items()]), lambda x: x.isNotNull())
    return F.when(t.isNull(), F.array(F.lit("unread"))).otherwise(named)
