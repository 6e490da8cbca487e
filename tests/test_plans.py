"""Plans: what is read, what is pushed down, and what must not occur."""

import pytest
from pyspark.sql import functions as F

from evidentia import plans
from evidentia.operators import reports
from evidentia.sources import readers

DATA = "/root/testdata/sf0.001"
PURE = ["t1_normalize_answer", "m1_m8_scores", "r11_r16_answer_rewards", "a1_subset_evaluation", "a16_method_matrix", "w2_wrong_answers", "c1_corpus", "c4_bm25_topk", "n7_qasper", "n10_cited_answers", "x2_hard_subset"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", PURE)
def test_no_cross_joins_and_no_python(spark, name):
    p = plan(plans.queries()[name](spark, DATA))
    assert "CartesianProduct" not in p and "Python" not in p and "Pandas" not in p


def test_columns_are_pruned_and_filters_pushed(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    p = plan(reports.counts(docs.where("doc_id > 5").withColumnRenamed("source", "dataset")))
    assert "ReadSchema: struct<doc_id:bigint,source:string>" in p and "GreaterThan(doc_id,5)" in p


def test_formatted_cache_reads_wanted_partitions(spark, tmp_path):
    rows = spark.range(20).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("dataset"), F.lit("test").alias("split"), F.lit(0).alias("noise"), F.lit(True).alias("answerable"))
    readers.write_formatted(rows, str(tmp_path / "f"))
    df = readers.read_formatted(spark, str(tmp_path / "f"), dataset="a")
    assert df.count() == 10 and "PartitionFilters: [isnotnull(dataset" in plan(df)


def test_topk_is_limited_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(plans.queries()["c4_bm25_topk"](spark, DATA))


def test_retrieval_reads_the_index_and_not_the_texts(spark):
    p = plan(plans.queries()["c7_contexts"](spark, DATA))
    assert p.count("FileScan") <= 14 and "documents.parquet" not in p
    p = plan(plans.queries()["c4_bm25_topk"](spark, DATA))
    assert p.count("FileScan") <= 6 and "documents.parquet" not in p
