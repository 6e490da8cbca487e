"""The corpus pipeline: toxicity, near duplicates, benchmark decontamination, personal data, packing.

Every stage judges rows by their own text: rows without an id are treated like others, repeated rows count as copies of one
another, null and empty texts are clean, and columns stay whatever they are called. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm import decontaminate, ngram_join, packing, pii, toxicity
from evidentia.llm.common import Scratch, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model rejects go; the model is fitted to the labelled ones among docs."""
    return without_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def without_toxic(docs: DataFrame, model: toxicity.Model | None) -> DataFrame:
    """docs without the rows that the model rejects; its result columns get a prefix that no column of docs has."""
    prefix = "_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    return toxicity.score(docs, model, prefix=prefix).where(~F.col(f"{prefix}toxic")).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one with the smallest id (groups without ids keep one row, too)."""
    return ngram_join.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with a benchmark item go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences of what is left: pieces with their token ids."""
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("ngram_jaccard", drop_near_duplicates), ("decontamination", drop_contaminated), ("pii", mask_personal), ("packing", pack)]

#: The stages hold fitted models and a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's output is written and read again, so that a loss costs one stage at most."""
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), f"{k}-{name}")
        if k:
            scratch.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs
