"""The registered queries of this subpackage: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm import license as licenses
from evidentia.llm import ann, collocations, decontaminate, hard_negatives, ngram_join, packing, pii, quality, quality_rules, toxicity, urls, warc
from evidentia.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), licenses.known_licenses(spark), licenses.published_digests(spark))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.cotrain(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest_columns(pii.find(table(spark, sf_dir, "documents")))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"))).drop("text")


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"), with_links=True)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), with_ids=False)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where(F.col("vec_id") % 20 == 0))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The tables label documents, not pages: pages are labelled by the lines they share with documents, and by the rules.
    pages = table(spark, sf_dir, "pages")
    return urls.filter_urls(pages, urls.labels_by_text(pages, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(hard_negatives.relabelled(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 50 == 0)


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    own = [
        op1_license_scan, op2_quality, op3_decontaminate, op4_pii, op5_toxicity, op6_ngram_jaccard, op7_packing, op8_warc, op9_ann, op10_url_filter, op11_hard_negatives, op12_quality_rules,
        op13_collocations,
    ]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_license_scan": licenses.oracle(), "op3_decontaminate": decontaminate.oracle(), "op6_ngram_jaccard": ngram_join.oracle(), "op8_warc": warc.oracle(),
        "op11_hard_negatives": hard_negatives.oracle(), "op12_quality_rules": quality_rules.oracle(), "op13_collocations": collocations.oracle(),
    }
