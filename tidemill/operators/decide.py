"""From model output and rules to decisions, and what is read off the decision trace."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import strict_json
from ..functions.text import SPACE
from .upsert import last_of


def label_or_review(confidence: Column, threshold: float) -> Column:
    """A confidence at the threshold or above is a label; below it, or null, a review."""
    return F.when(confidence >= F.lit(threshold), "label").otherwise("review")


#: Code points of a reason, and the characters that it must not hold.
REASON_MAX = 200
REASON_CONTROL = r"[\x00-\x1f\x7f-\x9f\u2028\u2029]"
ANSWER = "verdict string, reason string, category string, confidence double"


def read_answer(raw: str | None, categories: set[str]) -> tuple:
    """(verdict, reason, category, confidence) of one model output: strict, nothing is repaired.

    The output is one JSON object, with nothing after it, of exactly reason (1 to REASON_MAX code points without the white space at its ends, no control
    characters, no half of a pair), category (one of the list) and confidence (a number from 0 to 1). A text that is no JSON is not_json; a category that is a string
    but not on the list is out_of_category, whatever else is wrong; anything else is schema_mismatch. Of a repeated key the last counts.
    """
    try:
        answer = strict_json(raw or "")
    except RecursionError:  # arrays within arrays are no answer
        return "schema_mismatch", None, None, None
    except ValueError:
        return "not_json", None, None, None
    if not isinstance(answer, dict):
        return "schema_mismatch", None, None, None
    reason, category, confidence = (answer.get(k) for k in ("reason", "category", "confidence"))
    if isinstance(category, str) and category not in categories:
        return "out_of_category", None, None, None
    trimmed = re.sub(f"^{SPACE}+|{SPACE}+$", "", reason) if isinstance(reason, str) else ""
    good = (
        answer.keys() == {"reason", "category", "confidence"}
        and isinstance(category, str)
        and 1 <= len(trimmed) <= REASON_MAX
        and not re.search(REASON_CONTROL, trimmed)
        and not re.search("[\ud800-\udfff]", trimmed)
        and isinstance(confidence, float)
        and 0 <= confidence <= 1
    )
    return ("ok", trimmed, category, confidence) if good else ("schema_mismatch", None, None, None)


def model_answer(raw: Column, categories: list[str]) -> Column:
    """struct<verdict, reason, category, confidence> of model outputs, by ``read_answer``; the last three are null unless the verdict is ok. A null output is not_json."""
    known = set(categories)

    @F.pandas_udf(ANSWER)
    def read(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read_answer(x, known) for x in s], columns=["verdict", "reason", "category", "confidence"])

    return read(raw)


def validated_output(raw: Column, categories: list[str]) -> Column:
    """ok, not_json, schema_mismatch or out_of_category (``read_answer``)."""
    return model_answer(raw, categories)["verdict"]


def http_failure(status: Column) -> Column:
    """The class of an HTTP failure of the model server; none below 400."""
    return (
        F.when(status < 400, F.lit(None).cast("string"))
        .when(status == 404, "missing")
        .when(status.isin(429, 503), "busy")
        .when(status == 400, "rejected")
        .otherwise("server_error")
    )


def decided(winner_label: Column, verdict: Column, confidence: Column, threshold: float) -> Column:
    """struct<outcome, category, tier>: a rule's label first, then the model's verdict if it is sure enough, else review."""
    sure = (confidence >= F.lit(threshold)) & verdict.isNotNull()
    none = F.lit(None).cast("string")
    return F.struct(
        F.when(winner_label.isNotNull() | sure, "label").otherwise("review").alias("outcome"),
        F.coalesce(winner_label, F.when(sure, verdict), none).alias("category"),
        F.when(winner_label.isNotNull(), "exact_rules").when(verdict.isNotNull(), "llm").otherwise("none").alias("tier"),
    )


def decision_checks(outcome: Column, category: Column, tier: Column, model: Column, confidence: Column) -> dict[str, Column]:
    """Named predicates that every decision row meets; nulls are explicit, so none of them is null."""
    return {
        "outcome": F.coalesce(outcome.isin("label", "review"), F.lit(False)),
        "category": (outcome == "label").eqNullSafe(category.isNotNull()),
        "tier": F.coalesce(tier.isin("exact_rules", "classifier", "llm", "none"), F.lit(False)),
        "model": (tier == "llm").eqNullSafe(model.isNotNull()),
        "confidence": confidence.isNull() | F.coalesce(confidence.between(0, 1), F.lit(False)),
    }


def quarantined(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Rows that break a check, with the names of those they break."""
    broken = F.filter(F.array(*[F.when(~ok, F.lit(name)) for name, ok in checks.items()]), lambda x: x.isNotNull())
    return rows.withColumn("broken", broken).where(F.size("broken") > 0)


def latest_decisions(decisions: DataFrame, keys: list[str], time: str, tie: str) -> DataFrame:
    return last_of(decisions, keys, [time, tie])


def rollup(decisions: DataFrame, by: list[str]) -> DataFrame:
    return decisions.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def confusion(rows: DataFrame, actual: str, predicted: str) -> DataFrame:
    return rows.groupBy(actual, predicted).agg(F.count(F.lit(1)).alias("n"))


def accuracy(rows: DataFrame, by: str, actual: str, predicted: str) -> DataFrame:
    """(by, accuracy, n): the share of rows whose prediction is right, to six places; a null on either side is wrong."""
    right = F.coalesce(F.col(actual) == F.col(predicted), F.lit(False)).cast("double")
    return rows.groupBy(by).agg(F.round(F.avg(right), 6).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def coverage(rows: DataFrame, tier: str) -> DataFrame:
    """(tier, n, share): the part of decisions that each tier made."""
    counts = rows.groupBy(tier).agg(F.count(F.lit(1)).alias("n"))
    whole = counts.agg(F.sum("n").alias("whole"))
    return counts.crossJoin(F.broadcast(whole)).select(tier, "n", F.round(F.col("n") / F.col("whole"), 6).alias("share"))


def spot_check(rows: DataFrame, id_col: str, percent: int = 5) -> DataFrame:
    """A fixed sample by the hash of the id: the same rows in every run, in the JVM and in SQL."""
    share = F.conv(F.substring(F.sha2(F.col(id_col).cast("string"), 256), 1, 4), 16, 10).cast("long") % 100
    return rows.where(share < percent)


def quick_confirm(rows: DataFrame, counts: DataFrame, category: str, confidence: str, tie: str, n: int = 20, few: int = 15) -> DataFrame:
    """The ``n`` rows to confirm first: categories with under ``few`` examples, then the least confident."""
    marked = rows.join(counts.select(category, (F.col("n") < few).alias("short")), category, "left").withColumn("short", F.coalesce("short", F.lit(True)))
    return marked.orderBy(F.desc("short"), confidence, tie).limit(n)


def nearest_labels(queries: DataFrame, centroids: DataFrame) -> DataFrame:
    """(vec_id, predicted, similarity): the label with the most similar centroid, by cosine; centroids are one row a label."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    v, c = F.col("embedding"), F.col("centroid")
    cosine = F.round(dot(v, c) / F.sqrt(dot(v, v) * dot(c, c)), 6)
    scored = queries.crossJoin(F.broadcast(centroids)).withColumn("similarity", cosine)
    best = F.max_by(F.struct("label_c", "similarity"), F.struct("similarity", -F.col("label_c")))
    return scored.groupBy("vec_id").agg(best.alias("b")).select("vec_id", F.col("b.label_c").alias("predicted"), F.col("b.similarity").alias("similarity"))


def centroids(labelled: DataFrame) -> DataFrame:
    """(label_c, centroid): the mean vector of each label; partial sums by place before the shuffle."""
    places = labelled.select(F.col("label").alias("label_c"), F.posexplode("embedding").alias("i", "x"))
    means = places.groupBy("label_c", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy("label_c").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centroid"))
