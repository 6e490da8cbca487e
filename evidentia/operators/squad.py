"""Answerability reports: slices, precision-recall points, best thresholds, histograms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidentia.functions.metrics import open_exact, open_f1


def score_answers(answers: DataFrame) -> DataFrame:
    """M9: (qid, pred, golds, has_ans, na_prob) plus exact and f1; rows without a prediction are left out."""
    return answers.where(F.col("pred").isNotNull()).withColumn("exact", open_exact(F.col("pred"), F.col("golds"))).withColumn("f1", open_f1(F.col("pred"), F.col("golds")))


def apply_no_answer(scored: DataFrame, threshold: float = 1.0) -> DataFrame:
    """Above the threshold a question counts as called unanswerable: 1 if it is, else 0."""
    called = F.col("na_prob") > threshold
    right = F.when(F.col("has_ans"), 0.0).otherwise(1.0)
    return scored.withColumns({c: F.when(called, right).otherwise(F.col(c)) for c in ("exact", "f1")})


def summary(scored: DataFrame) -> DataFrame:
    """A5: exact, f1 (in percent) and total, overall and by slice."""
    both = scored.groupBy("has_ans").agg(F.sum("exact").alias("e"), F.sum("f1").alias("f"), F.count("*").alias("total"))
    every = both.groupBy().agg(F.sum("e").alias("e"), F.sum("f").alias("f"), F.sum("total").alias("total")).where("total > 0").select(F.lit("all").alias("slice"), "e", "f", "total")
    named = both.select(F.when(F.col("has_ans"), "HasAns").otherwise("NoAns").alias("slice"), "e", "f", "total")
    return every.union(named).select("slice", (100 * F.col("e") / F.col("total")).alias("exact"), (100 * F.col("f") / F.col("total")).alias("f1"), "total")


SCORES = ("exact", "f1", "oracle")
#: Ranges of the ordering column over which running sums are spread.
RANGES = 64


def _gain(score: str) -> Column:
    return F.col("has_ans").cast("double") if score == "oracle" else F.when(F.col("has_ans"), F.col(score)).otherwise(0.0)


def _points(scored: DataFrame, scores: tuple[str, ...]) -> DataFrame:
    """Per na_prob: tp, running tp of each score, running count and the number of answerable rows.

    Counts are pre-aggregated by na_prob, so the running sums see one row for each distinct probability.
    """
    steps = scored.groupBy("na_prob").agg(*(F.sum(_gain(x)).alias(f"tp_{x}") for x in scores), F.count("*").alias("n"), F.sum(F.col("has_ans").cast("long")).alias("pos"))
    run = running(steps, ["na_prob"], {f"tp_{x}": f"run_{x}" for x in scores} | {"n": "run_n"})
    total = steps.agg(F.sum("pos").alias("all_pos")).where("all_pos > 0")  # one row
    return run.crossJoin(F.broadcast(total))


def precision_recall(scored: DataFrame, score: str) -> DataFrame:
    """(na_prob, precision, recall), one point for each distinct na_prob. score: a column, or "oracle" for has_ans itself."""
    return _points(scored, (score,)).select("na_prob", (F.col(f"run_{score}") / F.col("run_n")).alias("precision"), (F.col(f"run_{score}") / F.col("all_pos")).alias("recall"))


def running(df: DataFrame, order: list[str], sums: dict[str, str], ranges: int = RANGES) -> DataFrame:
    """df plus running sums in the given order, without bringing all rows to one task.

    The first ordering column is cut into ranges at its approximate quantiles (a few numbers that come to the driver);
    sums run inside each range, and the totals of the ranges before (one small row each) are added. A row's range
    depends on its value alone, so that both sides agree.
    """
    bounds = df.select(F.percentile_approx(order[0], [k / ranges for k in range(1, ranges)], 10_000)).first()[0] or []
    at = F.size(F.filter(F.array(*(F.lit(b) for b in sorted(set(bounds)))), lambda b: b < F.col(order[0]))) if bounds else F.lit(0)
    part = df.withColumn("_part", at)
    inside = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    local = part.withColumns({new: F.sum(old).over(inside) for old, new in sums.items()})
    totals = part.groupBy("_part").agg(*(F.sum(old).alias(f"_t_{old}") for old in sums))
    every = totals.agg(F.collect_list(F.struct("_part", *(f"_t_{old}" for old in sums))).alias("_all"))
    out = local.crossJoin(F.broadcast(every))  # one row with at most ``ranges`` totals
    for old, new in sums.items():
        earlier = F.transform(F.filter("_all", lambda x: x["_part"] < F.col("_part")), _field(f"_t_{old}"))
        out = out.withColumn(new, F.col(new) + F.aggregate(earlier, F.lit(0.0), lambda n, x: n + x))
    return out.drop("_part", "_all")


def _field(name: str) -> Callable[[Column], Column]:
    return lambda x: x[name].cast("double")


def average_precision(scored: DataFrame) -> DataFrame:
    """(score, ap): area under the precision-recall points, in percent, for exact, f1 and oracle; no rows without answerable ones.

    Points come in order of na_prob, where recall never falls: a step of recall is a step's own share.
    """
    area = [(100 * F.sum(F.col(f"run_{x}") / F.col("run_n") * F.col(f"tp_{x}") / F.col("all_pos"))).alias(x) for x in SCORES]
    one = _points(scored, SCORES).agg(*area)
    return one.select(F.explode(F.array(*(F.struct(F.lit(x).alias("score"), F.col(x).alias("ap")) for x in SCORES))).alias("s")).select("s.*").where("ap is not null")


def best_threshold(scored: DataFrame, score: str) -> DataFrame:
    """(best, threshold): the highest running score by na_prob (ties inside one na_prob by qid), in percent; threshold 0 if no step beats the start."""
    step = F.when(F.col("has_ans"), F.col(score)).when(F.coalesce(F.col("pred"), F.lit("")) != "", -1.0).otherwise(0.0)
    run = running(scored.select("na_prob", "qid", step.alias("step")), ["na_prob", "qid"], {"step": "run"})
    total = scored.agg(F.count("*").alias("n"), F.coalesce(F.sum((~F.col("has_ans")).cast("long")), F.lit(0)).alias("no")).where("n > 0")
    best = run.agg(F.max(F.struct(F.round("run", 9).alias("run"), (-F.col("na_prob")).alias("p"), F.col("qid").alias("q"))).alias("m"))
    better = F.coalesce(F.col("m.run") > 0, F.lit(False))
    return total.crossJoin(F.broadcast(best)).select((100 * (F.col("no") + F.when(better, F.col("m.run")).otherwise(0.0)) / F.col("n")).alias("best"), F.when(better, -F.col("m.p")).otherwise(0.0).alias("threshold"))


def histogram(scored: DataFrame, bins: int = 20) -> DataFrame:
    """(has_ans, bin from 1, weight): na_prob on [0, 1]; weights of a slice add up to 1."""
    b = F.least(F.floor(F.col("na_prob") * bins) + 1, F.lit(bins))
    n = scored.groupBy("has_ans", b.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    return n.select("has_ans", "bin", (F.col("n") / F.sum("n").over(W.partitionBy("has_ans"))).alias("weight"))
