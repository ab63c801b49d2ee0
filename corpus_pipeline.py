"""A corpus pipeline: documents are cleaned, deduplicated, decontaminated, mixed and sharded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import materialize, table, unused
from tidemill.llm.decontamination import decontaminate
from tidemill.llm.mixing import mixed_documents
from tidemill.llm.ngram_join import drop_near_duplicates
from tidemill.llm.sharding import external_shuffle, row_bytes
from tidemill.llm.toxicity import fit_toxicity, held_out, score_toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below 0.7; the machine learns from the rows that are not held out."""
    model = fit_toxicity(docs, table(spark, sf_dir, "labels").where(~held_out(1, 3)))
    (score,) = unused(docs, "toxicity")
    return score_toxicity(docs, model, score_col=score).where(F.col(score) < 0.7).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the document with the smallest id."""
    return drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix by source weights takes them."""
    return mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in 40 shards of nearly equal counts, with their shard and slot."""
    return external_shuffle(docs, n_shards=40, size_col=row_bytes())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
    ("sharding", shard),
]

#: SQL cannot express the first three stages; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the stages make of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
