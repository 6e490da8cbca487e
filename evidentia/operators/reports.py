"""Grouped evaluations and run-to-run comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidentia.functions.metrics import failed, joint_scores, normal_answer_scores, normal_golds, row_lengths, supporting_fact_scores
from evidentia.functions.text import extract_answer, extract_answer_tagged, extract_evidence, noise_coordinate, normalize_answer, relative_delta


def parsed(predictions: DataFrame, tagged_types: frozenset[str]) -> DataFrame:
    """predictions (predict, prompt_type) plus answer and facts; prompt types in tagged_types answer between tags, others on a line.

    The names are those of the run's own prompt types; there is no default, since a wrong guess would score 0.
    """
    tagged = F.col("prompt_type").isin(sorted(tagged_types))
    return predictions.withColumn("answer", F.when(tagged, extract_answer_tagged(F.col("predict"))).otherwise(extract_answer(F.col("predict")))).withColumn("pred_facts", extract_evidence(F.col("predict")))


def scored(rows: DataFrame, legacy_unpack: bool = False) -> DataFrame:
    """rows (answer, pred_facts, answers, facts, predict) plus every row metric, once each."""
    answer, golds = F.col("answer"), F.col("answers")
    normal = rows.withColumns({"_p": normalize_answer(F.coalesce(answer, F.lit(""))), "_g": normal_golds(golds), "_s": supporting_fact_scores(F.col("pred_facts"), F.col("facts")), "_l": row_lengths(answer, golds, F.col("pred_facts"), F.col("predict"))})
    some = F.coalesce(answer, F.lit("")) != ""
    out = normal.withColumn("_a", normal_answer_scores(F.col("_p"), F.col("_g"), some))
    out = out.withColumn("_j", joint_scores(F.col("_a.em"), F.col("_a"), F.col("_s"), F.col("_l.answer_parsed") & F.col("_l.facts_parsed"), legacy_unpack))
    return out.select(
        *rows.columns, *(F.col(f"_a.{m}").alias(n) for m, n in (("em", "em"), ("hit", "hit"), ("f1", "f1"), ("precision", "prec"), ("recall", "recall"))),
        *(F.col(f"_s.{m}").alias(f"sp_{n}") for m, n in (("em", "em"), ("f1", "f1"), ("precision", "prec"), ("recall", "recall"))),
        *(F.col(f"_j.{m}").alias(f"joint_{n}") for m, n in (("em", "em"), ("f1", "f1"), ("precision", "prec"), ("recall", "recall"))), "_l.*",
    )


MEANS = ["em", "hit", "f1", "prec", "recall", "sp_em", "sp_f1", "sp_prec", "sp_recall", "joint_em", "joint_f1", "joint_prec", "joint_recall"]
LENGTHS = ["answer_len", "gold_answer_len", "facts_len", "predict_len"]


def subset_evaluation(rows: DataFrame) -> DataFrame:
    """A1: per dataset, sums over all rows divided by all rows, and counts of what was parsed."""
    a, f = F.col("answer_parsed"), F.col("facts_parsed")
    return rows.groupBy("dataset").agg(
        F.count("*").alias("total"), *((F.sum(m) / F.count("*")).alias(m) for m in MEANS + LENGTHS), F.count_if(~a).alias("no_answer"), F.count_if(~f).alias("no_facts"),
        F.count_if(a != f).alias("one_missing"), F.count_if(~a & ~f).alias("both_missing"), F.count_if(a & f).alias("both_present"),
    )


def run_evaluation(rows: DataFrame, keys: list[str]) -> DataFrame:
    """A2: per run, means over valid rows (a prediction that is no error)."""
    return rows.where(~failed(F.col("predict"))).groupBy(*keys).agg(F.avg("em").alias("answer_em"), F.avg("f1").alias("answer_f1"), F.avg("sp_f1").alias("supporting_f1"), F.count("*").alias("total_samples"))


def detailed_evaluation(rows: DataFrame) -> DataFrame:
    """A3: per dataset, means over rows with a prediction; em, hit, f1, sp_f1 and joint_f1 again over the hard subset (0 if it is empty), and its size."""
    some = rows.where(F.col("predict").isNotNull())
    hard = [F.coalesce(F.avg(F.when(F.col("is_hard"), F.col(m))), F.lit(0.0)).alias(f"hard_{m}") for m in ("em", "hit", "f1", "sp_f1", "joint_f1")]
    return some.groupBy("dataset").agg(*(F.avg(m).alias(m) for m in ("em", "hit", "f1", "prec", "recall", "sp_em", "sp_f1", "joint_f1", *LENGTHS)), *hard, F.count_if("is_hard").alias("n_hard"), F.count("*").alias("total"))


def noise_curve(rows: DataFrame, excluded: tuple[str, ...] = ()) -> DataFrame:
    """A4: per (dataset, noise, gold_removed) mean answer and fact scores with the plot coordinate, sorted by dataset and it."""
    kept = rows.where(~F.col("dataset").isin(list(excluded))) if excluded else rows
    means = kept.groupBy("dataset", "noise", "gold_removed").agg(F.avg("em").alias("answer_em"), F.avg("f1").alias("answer_f1"), F.avg("sp_em").alias("fact_em"), F.avg("sp_f1").alias("fact_f1"))
    return means.withColumn("x", noise_coordinate(F.col("noise"), F.col("gold_removed"))).orderBy("dataset", "x")


def reward_distribution(rollouts: DataFrame) -> DataFrame:
    """Per dataset: steps, steps whose rewards add up to 0, steps with mean 1, and means over rows."""
    steps = rollouts.groupBy("dataset", "step").agg(F.sum("reward").alias("total"), F.avg("reward").alias("mean"), F.count("*").alias("n"), F.sum("em").alias("em"), F.sum("hit").alias("hit"), F.sum("f1").alias("f1"))
    return steps.groupBy("dataset").agg(F.count("*").alias("steps"), F.count_if(F.col("total") == 0).alias("zero_steps"), F.count_if(F.col("mean") == 1).alias("full_steps"), *((F.sum(m) / F.sum("n")).alias(f"mean_{m}") for m in ("em", "hit", "f1")))


def spread(rows: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    """Mean and sample standard deviation (0 for one value) of each value per group; nulls do not count."""
    cols = []
    for name, value in values.items():
        cols += [F.avg(value).alias(f"{name}_mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias(f"{name}_std")]
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *cols)


def compared_runs(pairs: DataFrame, metrics: list[str], first: str) -> DataFrame:
    """Pairs (dataset, <m>_a, <m>_b) with relative changes, and a row "average" whose changes are those of the averages.

    Sorted by the change of ``first``, the largest first, the average last.
    """
    avg = pairs.agg(F.count("*").alias("n"), *(F.avg(f"{m}_{s}").alias(f"{m}_{s}") for m in metrics for s in "ab")).where("n > 0")
    cols = [f"{m}_{s}" for m in metrics for s in "ab"]
    both = pairs.select("dataset", *cols, F.lit(0).alias("_last")).union(avg.select(F.lit("average").alias("dataset"), *cols, F.lit(1).alias("_last")))
    out = both.withColumns({f"{m}_delta": relative_delta(F.col(f"{m}_a"), F.col(f"{m}_b")) for m in metrics})
    return out.orderBy("_last", F.desc(f"{first}_delta"), "dataset").drop("_last")


def method_matrix(summaries: DataFrame, datasets: list[str], sort: str = "avg_em", descending: bool = True) -> DataFrame:
    """One row a method: em_<dataset> and f1_<dataset> (null where missing) and averages over what is there."""
    cells = [F.max(F.when(F.col("dataset") == d, F.col(m))).alias(f"{m}_{d}") for d in datasets for m in ("em", "f1")]
    known = F.col("dataset").isin(datasets)
    table = summaries.groupBy("method").agg(*cells, F.avg(F.when(known, F.col("em"))).alias("avg_em"), F.avg(F.when(known, F.col("f1"))).alias("avg_f1"))
    return table.orderBy(F.desc(sort) if descending else F.asc(sort), "method")


def wins(pairs: DataFrame, metrics: list[str]) -> DataFrame:
    """(metric, wins_a, wins_b, ties)."""
    long = pairs.select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(f"{m}_a").cast("double").alias("a"), F.col(f"{m}_b").cast("double").alias("b")) for m in metrics))).alias("p")).select("p.*")
    return long.groupBy("metric").agg(F.count_if(F.col("a") > F.col("b")).alias("wins_a"), F.count_if(F.col("a") < F.col("b")).alias("wins_b"), F.count_if(F.col("a") == F.col("b")).alias("ties"))


def progress(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Total, completed and failed rows of each run."""
    bad = failed(F.col("predict"))
    return rows.groupBy(*keys).agg(F.count("*").alias("total_samples"), F.count_if(~bad).alias("completed_samples"), F.count_if(bad).alias("failed_samples"))


def counts(rows: DataFrame, key: str = "dataset") -> DataFrame:
    """A20."""
    return rows.groupBy(key).agg(F.count("*").alias("n"))


def latest(summaries: DataFrame, keys: list[str], ts: str = "run_ts") -> DataFrame:
    """The latest summary of each key."""
    return summaries.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(ts)))).where("_r = 1").drop("_r")


def length_report(rows: DataFrame, tokens: Column) -> DataFrame:
    """One row (n, mean_tokens, max_tokens)."""
    return rows.agg(F.count("*").alias("n"), F.avg(tokens).alias("mean_tokens"), F.max(tokens).alias("max_tokens"))


def too_long(rows: DataFrame, tokens: Column, limit: int = 28 * 1024) -> DataFrame:
    """Rows over the token limit; callers that want a hard stop raise when it is not empty."""
    return rows.where(tokens > limit)


def sample_text(context: Column, query: Column, facts: Column) -> Column:
    """What a sample's length is counted over."""
    return F.concat_ws("\n", context, query, F.array_join(facts, "\n"))


def write_within_limit(rows: DataFrame, tokens: Column, path: str, limit: int = 28 * 1024) -> dict[str, float]:
    """Writes rows below path and returns n, mean_tokens and max_tokens of the same job; a row over the limit stops it, and nothing is committed."""
    name = "_tokens"
    while name in rows.columns:
        name += "_"
    own = Observation("lengths")
    checked = F.when(F.col(name) > limit, F.raise_error(F.concat(F.lit("a sample has "), F.col(name).cast("string"), F.lit(f" tokens; the limit is {limit}"))).cast("long")).otherwise(F.col(name))
    seen = rows.withColumn(name, tokens.cast("long")).withColumn(name, checked).observe(own, F.count(F.lit(1)).alias("n"), F.avg(name).alias("mean_tokens"), F.max(name).alias("max_tokens"))
    # The lengths are a column of what is written, else the plan would not compute them.
    seen.write.mode("overwrite").parquet(path)
    return own.get
