"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see. Only a session on one machine, local[..], may name none; a new one is set for it."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


class Scratch:
    """Tables written to the shared folder, so that lineage is cut and a lost executor costs nothing but a re-read.

    ``keep`` writes a table and reads it back; ``drop`` deletes the tables that are no longer needed.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        # The shuffle files of a step that has been written are of no more use; Spark drops them as the write ends.
        before = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.parquet(f"{self.root}/{name}")
        finally:
            self.spark.conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def drop(self, *names: str) -> None:
        for name in names:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def as_text(id_col: str) -> Column:
    """An id on its way through pandas, which would turn integers next to nulls into floats and lose digits; cast it back afterwards."""
    return F.col(id_col).cast("string")


def kind_of(df: DataFrame, id_col: str) -> str:
    return df.select(id_col).schema[0].dataType.simpleString()


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with as many underscores as it takes to be none of df's columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def labelled_sample(labels: DataFrame, id_col: str, value_cols: list[str], max_rows: int, seed: int) -> DataFrame:
    """At most max_rows labelled rows, one for each id, those with the smallest hash of the id: a fixed, bounded sample."""
    one = labels.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(*(F.max(c).alias(c) for c in value_cols))
    return one.orderBy(F.xxhash64(F.col(id_col), F.lit(seed)), id_col).limit(max_rows)
