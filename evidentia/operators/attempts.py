"""Repeated attempts: truncation, wrong-answer memory, pass@K."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidentia.functions.metrics import best_f1, exact_match, failed


def with_verdict(parsed: DataFrame, rule: str = "em") -> DataFrame:
    """Attempts (answer, answers, predict) plus is_correct: an exact match ("em"), or a best F1 above 0 ("f1"); null for errors."""
    good = {"em": lambda: exact_match(F.col("answer"), F.col("answers")), "f1": lambda: best_f1(F.col("answer"), F.col("answers"))["f1"] > 0}[rule]()
    return parsed.withColumn("is_correct", F.when(~failed(F.col("predict")), F.coalesce(good, F.lit(False))))


def truncate(attempts: DataFrame, k: int) -> DataFrame:
    """Per id the first correct attempt, else only attempt k."""
    first = F.min(F.when(F.col("is_correct"), F.col("attempt_idx"))).over(W.partitionBy("id"))
    return attempts.withColumn("_first", first).where(F.col("attempt_idx") == F.coalesce("_first", F.lit(k))).drop("_first")


def wrong_answer_memory(attempts: DataFrame, threshold: int) -> DataFrame:
    """Attempts (id, attempt_idx, answer, is_correct) plus the distinct wrong answers so far, sorted, and two flags.

    tips_used is true from the threshold on, received_tips after it; blank answers add nothing. The array is bounded by
    the attempts of one id.
    """
    so_far = W.partitionBy("id").orderBy("attempt_idx").rowsBetween(W.unboundedPreceding, 0)
    wrong = F.when(~F.coalesce("is_correct", F.lit(False)) & (F.coalesce(F.trim("answer"), F.lit("")) != ""), F.col("answer"))
    return attempts.withColumn("tips_wrong_answer", F.array_sort(F.collect_set(wrong).over(so_far))).withColumn("tips_used", F.col("attempt_idx") >= threshold).withColumn("received_tips", F.col("attempt_idx") > threshold)


def any_correct(attempts: DataFrame) -> DataFrame:
    """(id, any_correct, first_success): rows without a verdict (errors) are left out."""
    judged = attempts.where(F.col("is_correct").isNotNull())
    return judged.groupBy("id").agg(F.bool_or("is_correct").alias("any_correct"), F.min(F.when(F.col("is_correct"), F.col("attempt_idx"))).alias("first_success"))


def pass_at_k(attempts: DataFrame) -> DataFrame:
    """A10: one row (n_correct, n_ids)."""
    return any_correct(attempts).agg(F.count_if("any_correct").alias("n_correct"), F.count("*").alias("n_ids"))


def first_success_histogram(attempts: DataFrame, k: int) -> DataFrame:
    """(attempt_idx, n) of correct rows for 1..k, zeros included."""
    spark = attempts.sparkSession
    n = attempts.where("is_correct").groupBy(F.col("attempt_idx").cast("long").alias("attempt_idx")).agg(F.count("*").alias("n"))
    return spark.range(1, k + 1).select(F.col("id").alias("attempt_idx")).join(n, "attempt_idx", "left").select("attempt_idx", F.coalesce("n", F.lit(0)).alias("n"))


def never_correct(attempts: DataFrame) -> DataFrame:
    """A12."""
    return any_correct(attempts).where(~F.col("any_correct")).select("id")
