"""User-supplied predictors and token counters, applied in Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


Predictor = Callable[[list[str]], list[str | None]]


def answers(predictor: Predictor, prompts: list[str], retries: int) -> list[str | None]:
    """What the predictor says; a batch that fails is halved until the prompts that fail stand alone, each with its own "ERROR: ..." text."""
    for left in range(retries, -1, -1):
        try:
            said = predictor(prompts)
            if len(said) != len(prompts):
                raise ValueError(f"{len(said)} answers to {len(prompts)} prompts")
            return [x if x and x.strip() else None for x in said]
        except Exception as e:  # whatever the user's predictor raises is its answer
            if not left and len(prompts) == 1:
                return [f"ERROR: {e}"]
            if len(prompts) > 1:
                break
    half = len(prompts) // 2
    return answers(predictor, prompts[:half], retries) + answers(predictor, prompts[half:], retries)


def predict_with(rows: DataFrame, setup: Callable[[], Predictor], prompt_col: str = "prompt", batch: int = 16, retries: int = 2) -> DataFrame:
    """Rows plus predict. setup is called once in each task and returns the predictor, which gets batches of prompts; a blank answer is null."""

    @F.pandas_udf("string")
    def answered(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        predictor = setup()
        for prompts in series:
            asked = prompts.tolist()
            yield pd.Series([a for at in range(0, len(asked), batch) for a in answers(predictor, asked[at : at + batch], retries)], dtype=object)

    # Only prompts pass through Python. The predictor must not be asked again where a plan would copy the expression.
    return rows.withColumn("predict", answered.asNondeterministic()(F.col(prompt_col)))


def predict(rows: DataFrame, predictor: Predictor, prompt_col: str = "prompt", batch: int = 16, retries: int = 2) -> DataFrame:
    """U3 with a predictor that needs no setup."""
    return predict_with(rows, lambda: predictor, prompt_col, batch, retries)


def done(spark: SparkSession, path: str) -> DataFrame | None:
    """The predictions that earlier runs of ``predict_into`` have committed below path."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where.suffix("/shard=*/_SUCCESS"))
    folders = [f.getPath().getParent().toString() for f in found or []]
    return spark.read.option("basePath", path).parquet(*folders) if folders else None


def predict_into(rows: DataFrame, setup: Callable[[], Predictor], path: str, id_col: str = "id", prompt_col: str = "prompt", shards: int = 16, batch: int = 16, retries: int = 2) -> DataFrame:
    """U3 with J3: predictions of rows below path, committed shard by shard; what is there already is not asked again.

    Ids are dealt to shards by a hash. Each shard is one job with a commit of its own; a run that is killed loses the shard it was at, and the next
    one asks only ids that no committed shard has. A failed row counts as done (drop it from path's shards to ask it again). A row
    without an id is asked in every run. Returns all committed predictions.
    """
    spark = rows.sparkSession
    known = done(spark, path)
    left = rows if known is None else rows.join(known.select(id_col), id_col, "left_anti")
    run = uuid.uuid4().hex[:8]
    for k in range(shards):
        own = left.where(F.coalesce(F.pmod(F.xxhash64(id_col), F.lit(shards)), F.lit(0)) == k)
        predict_with(own, setup, prompt_col, batch, retries).write.parquet(f"{path}/shard={k}-{run}")
    return done(spark, path).drop("shard")


def token_counter(count: Callable[[str], int]) -> Callable[[Column], Column]:
    """U4: a column function from a text to its number of tokens by a user-supplied counter; null counts 0."""

    @F.pandas_udf("int")
    def counted(text: pd.Series) -> pd.Series:
        return text.map(lambda t: count(t) if t else 0)

    return counted
