"""The model tier over a table of recorded answers: verdicts, outages that never become decisions, pass counters, routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import neighbours, stream_rules
from .decide import http_failure, model_answer

# Context and answer tokens, attempts, passes in which a message may fail alone, and how many may in a pass.
CONTEXT_TOKENS, ANSWER_TOKENS = 8192, 256
ATTEMPTS = 2
FAILED_PASSES, FAILURES_PER_PASS = 3, 2
#: Most codes of the table of error classes.
MAX_CODES = 1000
#: Queries and vectors that a task of a search multiplies with each other.
QUERY_BLOCK, VECTOR_BLOCK = 10_000, 1 << 15


def answer_verdict(status: Column, verdict: Column, done_reason: Column, prompt_tokens: Column) -> Column:
    """Of one recorded answer: infra, input_too_long, truncated, or the verdict on its text."""
    return (
        F.when(status.isNull() | (status >= 400), "infra")
        .when(prompt_tokens >= CONTEXT_TOKENS - ANSWER_TOKENS, "input_too_long")
        .when(done_reason == "length", "truncated")
        .otherwise(verdict)
    )


def tier_results(answers: DataFrame, key: str, categories: list[str]) -> DataFrame:
    """(key, result, category, confidence, n_attempts) of recorded ``answers`` (key, attempt, status, raw, done_reason, prompt_tokens).

    The second attempt counts only if the first was invalid output; an outage ends the message without a
    decision. A message's attempts are folded by one aggregation.
    """
    read = answers.where(F.col("attempt") <= ATTEMPTS).withColumn("__read", model_answer(F.col("raw"), categories))
    seen = read.withColumn("verdict", answer_verdict(F.col("status"), F.col("__read.verdict"), F.col("done_reason"), F.col("prompt_tokens")))
    step = F.struct("verdict", "status", F.col("__read.category").alias("category"), F.col("__read.confidence").alias("confidence"))
    at = lambda k: F.max(F.when(F.col("attempt") == k, step))
    folded = seen.groupBy(key).agg(at(1).alias("a"), at(2).alias("b"))
    again = F.col("a.verdict").isin("not_json", "schema_mismatch", "out_of_category", "truncated") & F.col("b").isNotNull()
    last = F.when(again, F.col("b")).otherwise(F.col("a"))
    kind = last["verdict"]
    ok = kind == "ok"
    return folded.select(
        key,
        F.when(kind.isin("not_json", "schema_mismatch", "truncated"), "invalid_output").otherwise(kind).alias("result"),
        F.when(ok, last["category"]).alias("category"),
        F.when(ok, last["confidence"]).alias("confidence"),
        F.when(kind == "infra", F.when(last["status"].isNull(), "unreachable").otherwise(http_failure(last["status"]))).alias("failure"),
        F.when(again, 2).otherwise(1).alias("n_attempts"),
    )


def outage_fold(passes: DataFrame, key: str) -> DataFrame:
    """(key, n_failed, held): messages that fail alone. ``passes`` has key, pass, place, failure and healthy (whether the server answered the probe).

    In a pass at most FAILURES_PER_PASS messages, the first by place, count as failing alone, and only
    while the server is healthy; in its FAILED_PASSES-th such pass a message is held for review. All
    else is an outage, after which the message is tried again.
    """
    from pyspark.sql.window import Window

    alone = passes.where(F.col("failure").isin("server_error", "timeout") & F.col("healthy"))
    first = alone.withColumn("rank", F.row_number().over(Window.partitionBy("pass").orderBy("place"))).where(F.col("rank") <= FAILURES_PER_PASS)
    return first.groupBy(key).agg(F.countDistinct("pass").alias("n_failed")).withColumn("held", F.col("n_failed") >= FAILED_PASSES)


def pass_counters(outcomes: DataFrame, keys: list[str], outcome: str = "outcome") -> DataFrame:
    """(keys..., n_labelled, n_review, n_failed, n_left): what a pass did, by conditional counts."""
    is_ = lambda *x: F.count_if(F.coalesce(F.col(outcome).isin(*x), F.lit(False)))
    return outcomes.groupBy(*keys).agg(is_("labelled").alias("n_labelled"), is_("review").alias("n_review"), is_("failed").alias("n_failed"), F.count_if(F.col(outcome).isNull()).alias("n_left"))


#: Fixed value: failures in a row that end a pass.
CONSECUTIVE = 5


def pass_report(outcomes: DataFrame, keys: list[str], order: str, message: str) -> DataFrame:
    """(keys..., n_labelled, n_review, n_failed, n_left, consecutive, longest_run, stopped, n_unclassified): what a pass did and how it stands.

    ``outcomes`` has one row for each message that the pass met, by ``order`` (a number): outcome is labelled, review, failed, or null for one that is left. ``consecutive`` counts the failures after
    the last message that was decided, ``longest_run`` the most in a row; what is left in between ends no run. ``stopped`` says whether a run reached the limit.
    ``n_unclassified`` counts the messages that failed or were left, each once.
    """
    met = outcomes.where(F.col("outcome").isin("labelled", "review", "failed"))
    runs = stream_rules.failure_runs(met, keys, order, F.col("outcome") == "failed", CONSECUTIVE)
    decided = F.max(F.when(F.col("outcome").isin("labelled", "review"), F.col(order))).alias("__last")
    last = outcomes.groupBy(*keys).agg(decided)
    after = met.join(last, keys).where((F.col("outcome") == "failed") & (F.col("__last").isNull() | (F.col(order) > F.col("__last"))))
    trailing = after.groupBy(*keys).agg(F.count(F.lit(1)).alias("consecutive"))
    open_ = outcomes.where(F.coalesce(F.col("outcome") == "failed", F.lit(True))).select(*keys, message).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("n_unclassified"))
    whole = pass_counters(outcomes, keys).join(runs, keys, "left").join(trailing, keys, "left").join(open_, keys, "left")
    return whole.na.fill(0, ["consecutive", "longest_run", "n_unclassified"]).na.fill(False, ["stopped"])


def backoff(failures: Column, base: float, cap: float, jitter: Column) -> Column:
    """Seconds to wait: base doubled for each failure up to the cap, changed by up to a fifth (``jitter`` from 0 to 1), at most the cap."""
    wait = F.least(F.lit(cap), F.lit(base) * F.pow(F.lit(2.0), failures.cast("double")))
    return F.least(F.lit(cap), wait * (0.8 + 0.4 * jitter))


def error_classes(errors: DataFrame, codes: DataFrame, causes: str = "causes") -> DataFrame:
    """``errors`` with ``error_class``: that of the first code among an error and its causes (five at most) that the table ``codes`` (code, error_class) knows."""
    known = {r["code"]: r["error_class"] for r in codes.limit(MAX_CODES + 1).collect()}
    if len(known) > MAX_CODES:
        raise ValueError(f"more than {MAX_CODES} codes")
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair]) if known else F.create_map().cast("map<string,string>")
    classes = F.filter(F.transform(F.slice(causes, 1, 5), lambda c: F.try_element_at(table, c)), lambda c: c.isNotNull())
    return errors.withColumn("error_class", F.coalesce(F.get(classes, F.lit(0)), F.lit("unknown")))


def rerun_selection(messages: DataFrame, decisions: DataFrame, key: str, ids: DataFrame | None = None, since=None, pending_only: bool = False, time: str = "internal_date") -> DataFrame:
    """Messages to decide again: by a table of ids, from a time on, or only those without a decision."""
    if since is not None:
        messages = messages.where(F.col(time) >= since)
    if ids is not None:
        messages = messages.join(ids.select(key).distinct(), key, "left_semi")
    return messages.join(decisions.select(key).distinct(), key, "left_anti") if pending_only else messages


def refetched(expired: DataFrame, locations: DataFrame, fetched: DataFrame, generation: Column) -> DataFrame:
    """(id, result): restored, gone or mismatch of messages (id, identity) whose body has expired.

    A message is fetched at its live location (id, uid, generation) of the current generation; what is
    found there (uid, identity) has to be the same message.
    """
    live = locations.where((F.col("generation") == generation) & F.col("removed_at").isNull()).groupBy("id").agg(F.min("uid").alias("uid"))
    found = expired.join(live, "id", "left").join(fetched.select("uid", F.col("identity").alias("__found")), "uid", "left")
    result = F.when(F.col("uid").isNull() | F.col("__found").isNull(), "gone").when(F.col("__found") == F.col("identity"), "restored").otherwise("mismatch")
    return found.select("id", result.alias("result"))


def compared_reports(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """One row: entries of two reports (key, uid, internal_date) matched, missing, and matched with another uid or date."""
    new = after.groupBy(key).agg(F.max(F.struct("uid", "internal_date")).alias("__new"))
    joined = before.where(F.col(key).isNotNull()).join(new, key, "left")
    hit = F.col("__new").isNotNull()
    return joined.agg(
        F.count_if(hit).alias("n_matched"),
        F.count_if(~hit).alias("n_missing"),
        F.count_if(hit & ~F.col("uid").eqNullSafe(F.col("__new.uid"))).alias("n_uid_changed"),
        F.count_if(hit & ~F.col("internal_date").eqNullSafe(F.col("__new.internal_date"))).alias("n_date_changed"),
    )


def flips(pairs: DataFrame, base: str = "base", injected: str = "injected") -> DataFrame:
    """``pairs`` with ``flip``: whether the injected variant was labelled and its label differs from the base's."""
    return pairs.withColumn("flip", F.col(injected).isNotNull() & ~F.col(base).eqNullSafe(F.col(injected)))


def baseline_report(runs: DataFrame, pair: str = "pair") -> DataFrame:
    """One row: n_mails, n_pairs, n_flips, seconds_total, seconds_longest of a run over mails in pairs.

    ``runs`` has a row for each call: pair, injected (whether it is the variant with the injection), attempt, category (null: none) and seconds. A mail's seconds are those of its
    calls together, its category that of its last call. A pair flips if the variant is labelled otherwise than its base; one without its other half flips not.
    """
    mails = runs.groupBy(pair, "injected").agg(F.sum("seconds").alias("s"), F.max_by("category", "attempt").alias("c"))
    half = lambda v, c: F.max(F.when(F.col("injected") == v, F.col(c)))
    sides = lambda v: F.count_if(F.col("injected") == v) > 0
    pairs = mails.groupBy(pair).agg(half(False, "c").alias("base"), half(True, "c").alias("injected"), (sides(True) & sides(False)).alias("both"), F.count(F.lit(1)).alias("n"), F.sum("s").alias("s"), F.max("s").alias("top"))
    told = flips(pairs)
    return told.agg(F.sum("n").alias("n_mails"), F.count_if("both").alias("n_pairs"), F.count_if(F.col("flip") & F.col("both")).alias("n_flips"), F.round(F.sum("s"), 6).alias("seconds_total"), F.round(F.max("top"), 6).alias("seconds_longest"))


def identity_stats(messages: DataFrame, domain: str) -> DataFrame:
    """One row: what identities a folder's messages have, and how far their dates are from the server's.

    ``messages`` has trusted_id, message_id, external_id, sent_at (all may be null) and internal_date. scanned, trusted_present, trusted_absent, id_absent, id_of_domain (the part after
    the last @ is ``domain``), id_not_external, ids_shared (message ids that more than one trusted id has), and the nearest ranks skew_p50 and skew_p95 of the seconds between both dates.
    """
    mid, ext = F.col("message_id"), F.col("external_id")
    counts = messages.agg(
        F.count(F.lit(1)).alias("scanned"),
        F.count("trusted_id").alias("trusted_present"),
        F.count_if(F.col("trusted_id").isNull()).alias("trusted_absent"),
        F.count_if(mid.isNull()).alias("id_absent"),
        F.count_if(F.contains(mid, F.lit("@")) & (F.substring_index(mid, "@", -1) == domain)).alias("id_of_domain"),
        F.count_if(mid != ext).alias("id_not_external"),
    )
    pairs = messages.where(mid.isNotNull() & F.col("trusted_id").isNotNull()).groupBy("message_id", "trusted_id").agg(F.lit(1).alias("one"))
    shared = pairs.groupBy("message_id").agg(F.sum("one").alias("n")).agg(F.count_if(F.col("n") > 1).alias("ids_shared"))
    apart = F.abs(F.unix_micros(F.col("sent_at").cast("timestamp")) - F.unix_micros(F.col("internal_date").cast("timestamp"))) / 1_000_000
    skews = messages.where(F.col("sent_at").isNotNull()).select(F.floor(apart + 0.5).cast("double").alias("v"))
    ranks = stream_rules.nearest_ranks(skews, "v", {"skew_p50": 0.5, "skew_p95": 0.95})
    return counts.crossJoin(shared).crossJoin(ranks)  # one row each


def correction_route(tier: Column) -> Column:
    """Where an owner's correction goes: to the rules if a rule decided, to the examples if a model did."""
    return F.when(tier == "exact_rules", "rules").when(tier.isin("llm", "classifier"), "examples").otherwise("review")


def neighbour_votes(queries: DataFrame, vectors: DataFrame, k: int, least_examples: int = 15) -> DataFrame:
    """(vec_id, label, n, nearest): how many of the ``k`` most similar vectors have each label, by cosine rounded to six places, and the up to three nearest of them.

    ``queries`` are a stated set; blocks of them meet blocks of the vectors (``neighbours.nearest``). A vector is no neighbour of itself. Labels with fewer than
    ``least_examples`` vectors take no part.
    """
    enough = vectors.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_examples).select("label")
    known = vectors.join(enough, "label", "left_semi").select(F.col("vec_id").alias("n_id"), "label", F.col("embedding").alias("v"))
    near = neighbours.nearest(queries.select("vec_id", F.col("embedding").alias("q")), known, k, QUERY_BLOCK, VECTOR_BLOCK)
    first = F.transform(F.slice(F.array_sort(F.collect_list(F.struct("rank", "n_id"))), 1, 3), lambda x: x["n_id"])
    return near.groupBy("vec_id", "label").agg(F.count(F.lit(1)).alias("n"), first.alias("nearest"))


def neighbour_vote(queries: DataFrame, vectors: DataFrame, k: int, least_examples: int = 15, threshold: float = 0.85) -> DataFrame:
    """(vec_id, label, share, outcome): the label that most of the neighbours have (``neighbour_votes``); a share below ``threshold`` is a review."""
    votes = neighbour_votes(queries, vectors, k, least_examples)
    best = votes.groupBy("vec_id").agg(F.max(F.struct("n", (-F.col("label")).alias("order"))).alias("b"), F.sum("n").alias("all"))
    share = F.round(F.col("b.n") / F.col("all"), 6)
    return best.select("vec_id", (-F.col("b.order")).alias("label"), share.alias("share"), F.when(share >= threshold, "label").otherwise("review").alias("outcome"))
