"""What a decision row and its trace have to meet, as named predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Outcomes, tiers, who decides, and the reasons for a review.
OUTCOMES = ("labelled", "review")
TIERS = ("exact_rules", "llm")
DECIDERS = ("worker", "rerun")
REASONS = ("low_confidence", "invalid_output", "out_of_category", "input_too_long", "llm_error")


def _is(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def decision_row_checks() -> dict[str, Column]:
    """The ten checks of a decision row (outcome, category, tier, review_reason, confidence, prompt_version, model, decided_by, trace_format, spans as JSON text)."""
    c = F.col
    rule, model = _is(c("tier") == "exact_rules"), _is(c("tier") == "llm")
    sure = _is(c("outcome") == "labelled") | _is(c("review_reason") == "low_confidence")
    return {
        "outcome": _is(c("outcome").isin(*OUTCOMES)),
        "category": _is(c("outcome") == "labelled") == c("category").isNotNull(),
        "tier": rule | model,
        "review_reason": (_is(c("outcome") == "review") == c("review_reason").isNotNull()) & (c("review_reason").isNull() | _is(c("review_reason").isin(*REASONS))),
        "exact_rules": ~rule | (_is(c("outcome") == "labelled") & c("confidence").isNull() & c("prompt_version").isNull() & c("model").isNull()),
        "llm": ~model | (c("prompt_version").isNotNull() & c("model").isNotNull()),
        "confidence": (c("confidence").isNull() | _is(c("confidence").between(0, 1))) & ((model & sure) == c("confidence").isNotNull()),
        "decided_by": _is(c("decided_by").isin(*DECIDERS)),
        "trace_format": _is(c("trace_format") >= 1),
        "spans": _is(F.schema_of_variant(F.try_parse_json("spans")).startswith("ARRAY")),
    }


#: A trace: spans in order, of which each kind uses its own fields.
SPANS = "array<struct<kind:string,model:string,confidence:double,attempts:int,result:string,categories:array<string>,intent:string,label:string,reason:string>>"


def span_checks(spans: Column) -> dict[str, Column]:
    """The layout of a trace: rules, classifier, a model's span or none, the action; one or two attempts; a result among the categories."""
    kinds = F.transform(spans, lambda s: s["kind"])
    short, long = (F.array(*[F.lit(k) for k in x]) for x in (("exact_rules", "classifier", "action"), ("exact_rules", "classifier", "llm", "action")))
    llm = F.get(F.filter(spans, lambda s: s["kind"] == "llm"), F.lit(0))
    return {
        "layout": _is((kinds == short) | (kinds == long)),
        "attempts": llm.isNull() | _is(llm["attempts"].between(1, 2)),
        "result": llm.isNull() | llm["result"].isNull() | _is(F.array_contains(llm["categories"], llm["result"])),
    }


def consistency_checks(spans: Column) -> dict[str, Column]:
    """The columns of a decision row against its trace: the action's intent, the tier, the model and the confidence."""
    c = F.col
    action, llm = F.get(spans, F.size(spans) - 1), F.get(F.filter(spans, lambda s: s["kind"] == "llm"), F.lit(0))
    labels = _is(action["intent"] == "label")
    of_model = llm.isNotNull() & c("model").eqNullSafe(llm["model"]) & c("confidence").eqNullSafe(llm["confidence"]) & c("prompt_version").isNotNull()
    of_rules = llm.isNull() & c("model").isNull() & c("confidence").isNull() & c("prompt_version").isNull()
    return {
        "action": _is(action["kind"] == "action"),
        "intent": F.when(labels, _is(c("outcome") == "labelled") & c("category").eqNullSafe(action["label"]) & c("review_reason").isNull()).otherwise(
            _is(c("outcome") == "review") & c("category").isNull() & c("review_reason").eqNullSafe(action["reason"])
        ),
        "tier": F.when(c("tier") == "llm", of_model).when(c("tier") == "exact_rules", of_rules).otherwise(F.lit(False)),
    }


def repeated_worker_decisions(decisions: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., n): messages that the worker decided more than once, which a store must refuse; reruns repeat freely."""
    return decisions.where("decided_by = 'worker'").groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def location_checks() -> dict[str, Column]:
    """Of a location: a reason goes with a removal, uids are unsigned 32-bit numbers; nulls are explicit."""
    c = F.col
    return {
        "removed": c("removed_at").isNotNull() == c("removed_reason").isNotNull(),
        "reason": c("removed_reason").isNull() | _is(c("removed_reason").isin("vanished", "superseded")),
        "uid": _is(c("uid").between(1, 4294967295)),
    }


# States of a mailbox and of a folder.
MAILBOX_STATES = ("ok", "error", "disabled", "connecting", "needs_attention")
FOLDER_STATES = ("ok", "resyncing")


def status_checks() -> dict[str, Column]:
    """Of a mailbox's status (state, held_new_count, backfill_done, backfill_total): one that needs attention says how many are held, a backfill has both numbers or none."""
    c = F.col
    return {
        "state": _is(c("state").isin(*MAILBOX_STATES)),
        "held": ~_is(c("state") == "needs_attention") | c("held_new_count").isNotNull(),
        "backfill": c("backfill_done").isNull() == c("backfill_total").isNull(),
    }


def folder_sync_checks() -> dict[str, Column]:
    """Of a folder's state: resyncing exactly if it has a pending uid validity and generation, and all four numbers of a backfill or none."""
    c = F.col
    numbers = [c(f"backfill_{x}").isNotNull().cast("int") for x in ("since", "cursor", "until", "total")]
    return {
        "state": _is(c("state").isin(*FOLDER_STATES)),
        "pending": _is(c("state") == "resyncing") == (c("pending_validity").isNotNull() & c("pending_generation").isNotNull()),
        "backfill": sum(numbers[1:], numbers[0]).isin(0, 4),
    }
