"""The embedding tier: logistic regression, fitted so that no row is scored by a model that saw it, beside the neighbours' vote."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import model_tier

#: Examples that a category needs before the classifier takes it on, and the confidence from which its answer stands.
LEAST_EXAMPLES, THRESHOLD = 15, 0.85
#: Most categories; rules documents have at most 20.
MAX_CATEGORIES = 1000


def fold_of(id_col: str, folds: int):
    """A row's fold by the hash of its id: in every run the same, and copies of an id together."""
    return F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(folds)).cast("int")


def _featured(rows: DataFrame, vector: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return rows.withColumn("features", array_to_vector(F.col(vector).cast("array<double>")))


def fit(examples: DataFrame, least: int = LEAST_EXAMPLES, penalty: float = 0.01, vector: str = "embedding", label: str = "label"):
    """(model, labels) of softmax regression with an L2 penalty over the labels that have ``least`` examples; None where fewer than two have.

    Rows whose label or vector is null are no examples. The fit runs on the tasks that hold the rows; the driver gets gradients and the coefficients, one vector for each label.
    """
    from pyspark.ml.classification import LogisticRegression

    known = examples.where(F.col(label).isNotNull() & F.col(vector).isNotNull())
    labels = sorted(r[0] for r in known.groupBy(label).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).limit(MAX_CATEGORIES + 1).collect())
    if len(labels) > MAX_CATEGORIES:
        raise ValueError(f"more than {MAX_CATEGORIES} categories")
    if len(labels) < 2:
        return None
    place = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(label)) - 1
    train = _featured(known.where(F.col(label).isin(labels)), vector).select("features", place.cast("double").alias("place"))
    machine = LogisticRegression(labelCol="place", family="multinomial", regParam=penalty, standardization=False, maxIter=200, tol=1e-8)
    return machine.fit(train), labels


def predict(rows: DataFrame, fitted, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, probabilities): a map from label to probability; null without a model or a vector."""
    from pyspark.ml.functions import vector_to_array

    if fitted is None:
        return rows.select(id_col, F.lit(None).cast("map<string,double>").alias("probabilities"))
    model, labels = fitted
    scored = model.transform(_featured(rows.where(F.col(vector).isNotNull()), vector))
    names = F.array(*[F.lit(str(x)) for x in labels])
    found = scored.select(id_col, F.map_from_arrays(names, vector_to_array("probability")).alias("probabilities"))
    return found.unionByName(rows.where(F.col(vector).isNull()).select(id_col, F.lit(None).cast("map<string,double>").alias("probabilities")))


def cross_fitted(examples: DataFrame, folds: int = 3, least: int = LEAST_EXAMPLES, penalty: float = 0.01, id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(id, probabilities) for all of ``examples``: each fold is scored by a model of the other folds.

    The cold start counts what the model saw: a label with fewer than ``least`` examples in the other folds gets no probability there.
    """
    placed = examples.withColumn("__fold", fold_of(id_col, folds))
    parts = [predict(placed.where(F.col("__fold") == f), fit(placed.where(F.col("__fold") != f), least, penalty, vector, label), id_col, vector) for f in range(folds)]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def classified(probabilities: DataFrame, votes: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id") -> DataFrame:
    """(id, label, confidence, outcome, neighbours): the label with the highest mean of probability and share of the votes.

    ``votes`` (id, label, n, nearest) are those of ``model_tier.neighbour_votes``. Scores are rounded to six places, ties go to the first label as text. From ``threshold``
    on the label stands (``label``), below it the message goes on to the next tier (``escalate``), as does one without a probability (``cold``: its category is not ready). ``neighbours`` are up
    to three of the nearest examples with the label.
    """
    shares = votes.withColumn("label", F.col("label").cast("string")).groupBy(id_col).agg(F.collect_list(F.struct("label", "n", "nearest")).alias("v"), F.sum("n").alias("of"))
    joined = probabilities.join(shares, id_col, "left")
    ready = F.col("probabilities").isNotNull()
    share = F.map_from_arrays(F.transform("v", lambda x: x["label"]), F.transform("v", lambda x: x["n"] / F.col("of")))
    nearest = F.map_from_arrays(F.transform("v", lambda x: x["label"]), F.transform("v", lambda x: x["nearest"]))
    labels = F.array_sort(F.map_keys("probabilities"))
    score = lambda x: F.round((F.coalesce(F.try_element_at("probabilities", x), F.lit(0.0)) + F.coalesce(F.try_element_at(share, x), F.lit(0.0))) / 2, 6)
    best = F.array_max(F.transform(labels, lambda x, i: F.struct(score(x).alias("score"), (-i).alias("order"), x.alias("label"))))
    outcome = F.when(~ready, "cold").when(F.col("b.score") >= threshold, "label").otherwise("escalate")
    chosen = joined.withColumn("b", F.when(ready, best))
    return chosen.select(id_col, F.col("b.label").alias("label"), F.col("b.score").alias("confidence"), outcome.alias("outcome"), F.try_element_at(nearest, F.col("b.label")).alias("neighbours"))


def embedding_tier(examples: DataFrame, queries: DataFrame, k: int = 10, folds: int = 3, least: int = LEAST_EXAMPLES, threshold: float = THRESHOLD) -> DataFrame:
    """The tier's answers for ``queries``, a stated set of ``examples`` (vec_id, label, embedding), each from what the others say."""
    asked = queries.select("vec_id").distinct()
    probabilities = cross_fitted(examples, folds, least).join(asked, "vec_id", "left_semi")
    return classified(probabilities, model_tier.neighbour_votes(queries, examples, k, least), threshold)
