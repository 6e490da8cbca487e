"""Joins, id lists and set algebra on keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidentia.functions.text import sentences, strip


def with_gold(predictions: DataFrame, gold: DataFrame) -> DataFrame:
    """Predictions with gold columns by (dataset, id); predictions without gold are skipped."""
    return predictions.join(gold, ["dataset", "id"])


def tag_subset(rows: DataFrame, ids: DataFrame, flag: str = "is_hard") -> DataFrame:
    """Rows plus whether their id is on the list."""
    return rows.join(ids.select("id").distinct().withColumn(flag, F.lit(True)), "id", "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def pending(samples: DataFrame, done: DataFrame) -> DataFrame:
    """Samples not processed yet."""
    return samples.join(done.select("id").distinct(), "id", "left_anti")


def fetch(samples: DataFrame, ids: DataFrame) -> DataFrame:
    """Complete samples of an id list; those with empty answers, facts, context or query are skipped."""
    complete = (F.size("answers") > 0) & (F.size("facts") > 0) & (F.coalesce("context", F.lit("")) != "") & (F.coalesce("query", F.lit("")) != "")
    return samples.join(ids.select("id").distinct(), "id", "left_semi").where(complete)


def missing(samples: DataFrame, ids: DataFrame) -> DataFrame:
    """Ids of the list without a sample."""
    return ids.select("id").distinct().join(samples, "id", "left_anti")


def train_rows(samples: DataFrame, ids: DataFrame, facts: Column) -> DataFrame:
    """(dataset, id, solution) for the ids; facts (an array) are cut into sentences, one array each."""
    found = samples.join(ids.select("id").distinct(), "id", "left_semi")
    return found.select("dataset", "id", F.struct("context", F.transform(facts, sentences).alias("supporting_facts"), "answers", "dataset", "id").alias("solution"))


def abstracts_for(cited: DataFrame, store: DataFrame) -> DataFrame:
    """Cited (pmid, ...) with title and abstract, empty strings where the store has none."""
    return cited.join(store, "pmid", "left").withColumn("title", F.coalesce("title", F.lit(""))).withColumn("abstract", F.coalesce("abstract", F.lit("")))


def paired_runs(a: DataFrame, b: DataFrame, metrics: list[str]) -> DataFrame:
    """Two runs' metrics by dataset, for datasets that both have."""
    left = a.select("dataset", *(F.col(m).alias(f"{m}_a") for m in metrics))
    return left.join(b.select("dataset", *(F.col(m).alias(f"{m}_b") for m in metrics)), "dataset")


def pending_citations(cited: DataFrame, store: DataFrame) -> DataFrame:
    """Distinct cited ids that are not stored."""
    return cited.select("pmid").distinct().join(store, "pmid", "left_anti")


def intersect_ids(*lists: DataFrame) -> DataFrame:
    """X1."""
    return reduce(lambda a, b: a.intersect(b), [x.select("id") for x in lists])


def union_ids(*lists: DataFrame) -> DataFrame:
    """X3."""
    return reduce(lambda a, b: a.union(b), [x.select("id") for x in lists]).distinct()


def hard_subset(ids: DataFrame, scored: DataFrame) -> DataFrame:
    """Ids that no run answered (F1 above 0)."""
    return ids.select("id").distinct().join(scored.where("f1 > 0").select("id").distinct(), "id", "left_anti")


def drop_hops(ids: DataFrame, part: str = "2hop") -> DataFrame:
    """X4."""
    return ids.where(~F.col("id").contains(part))


def keep_yes(verdicts: DataFrame, exact: bool = False) -> DataFrame:
    """Verdicts that say yes; exact compares as written."""
    said = F.col("llm_response")
    return verdicts.where(said == "yes" if exact else strip(F.lower(said)) == "yes")


def difference_ids(a: DataFrame, b: DataFrame) -> DataFrame:
    """X8."""
    return a.select("id").distinct().join(b.select("id"), "id", "left_anti")


def audit(samples: DataFrame, attempts: DataFrame, predictions: DataFrame, ids: DataFrame) -> DataFrame:
    """Everything about the listed ids: sample, attempts and run prediction."""
    own = samples.join(ids.select("id").distinct(), "id", "left_semi")
    return own.join(attempts, "id").join(predictions.select("id", F.col("predict").alias("run_predict")), "id")


def last_by_key(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows with equal keys the last in order."""
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(order)))).where("_r = 1").drop("_r")


#: Rows that may be sorted in one task at the edge of a sample.
EDGE = 100_000


def shuffled(rows: DataFrame, seed: int = 42, key: str = "id") -> DataFrame:
    """Rows in the order of a seeded hash of the key, by ranges of it."""
    return rows.orderBy(F.xxhash64(key, F.lit(seed)), key)


def sample_rows(rows: DataFrame, n: int, seed: int = 42, key: str = "id", edge: int = EDGE) -> DataFrame:
    """If 0 < n < all rows, the n rows with the smallest seeded hashes of their key (ties: by key); else all, shuffled.

    The hash up to which rows are taken is found by quantiles of it: each round brackets the n-th hash by two quantiles and counts what
    lies below, until few enough rows are left between them to be sorted. So no task sorts or holds n rows.
    """
    if n <= 0 or n >= rows.count():
        return shuffled(rows, seed, key)
    name = "_h"
    while name in rows.columns:
        name += "_"
    hashed, need = rows.withColumn(name, F.xxhash64(key, F.lit(seed))), n
    low, high = -(2**63), 2**63 - 1
    while True:
        band = hashed.where(F.col(name).between(low, high))
        left = band.count()
        if left <= edge or low == high:
            break
        share = need / left
        # Quantiles are doubles: they are taken of the upper 53 bits of a hash, which stay whole, and stand for all hashes that begin with them.
        a, b = band.agg(F.percentile_approx(F.shiftright(name, 11), [max(share - 0.01, 0.0), min(share + 0.01, 1.0)], 10_000)).first()[0]
        a, b = a << 11, (b << 11) + 2047
        below, upto = band.agg(F.count_if(F.col(name) < a), F.count_if(F.col(name) <= b)).first()
        if below >= need:
            high = a - 1
        elif upto < need:
            low, need = b + 1, need - upto
        elif (a, b) == (low, high):
            break  # few different hashes, each with many rows
        else:
            low, high, need = a, b, need - below
    return hashed.where(F.col(name) < low).union(band.orderBy(name, key).limit(need)).drop(name)


def answerable_samples(samples: DataFrame) -> DataFrame:
    """Samples with answers, the first of them not blank."""
    return samples.where((F.coalesce(F.size("answers"), F.lit(0)) > 0) & (F.coalesce(strip(F.get("answers", F.lit(0))), F.lit("")) != ""))


def mixture(*samples: DataFrame) -> DataFrame:
    """Canonical sets together; rows keep their own dataset."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), samples)
