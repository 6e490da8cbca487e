"""The registered queries run, keep their contracts' columns, and equal their SQL twins."""

from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from evidentia.llm import license, ngram_join, packing, pii, quality, queries, toxicity, urls, warc

DATA = "/root/testdata/sf0.001"
COLUMNS = {
    "op4_pii": {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"},
    "op6_ngram_jaccard": {"doc_id", "n_shingles", "component_id"},
    "op7_packing": {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"},
    "op8_warc": {"page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"},
    "op9_ann": {"query_id", "rank", "vec_id", "score"},
    "op10_url_filter": {"page_id", "host", "path", "rule", "verdict"},
    "op11_hard_negatives": {"anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"},
    "op12_quality_rules": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
    "op13_collocations": {"lang", "rank", "phrase", "a", "l", "r", "n", "score"},
}


def test_names():
    own = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 14)} == {k.split("_")[0] for k in own if k.startswith("op") and k[2].isdigit()} and "pipeline" in own


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_runs(spark, name):
    df = queries.queries()[name](spark, DATA)
    assert COLUMNS.get(name, set()) <= set(df.columns)
    df.collect()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_twin(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "pages", "embeddings"):
        p = Path(DATA, f"{t}.parquet")
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    out = c.execute(queries.oracle_sql()[name])
    cols = sorted(x[0] for x in out.description)
    df = queries.queries()[name](spark, DATA)
    assert sorted(df.columns) == cols
    want = sorted((tuple(dict(zip([x[0] for x in out.description], r, strict=True))[k] for k in cols) for r in out.fetchall()), key=repr)
    got = sorted((tuple(r[k] for k in cols) for r in df.collect()), key=repr)
    assert got == want


def test_pipeline_stages(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "ngram_jaccard", "decontamination", "pii", "packing"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = stage(spark, docs, DATA)
        assert docs.columns == columns, name
    left = docs.count()
    assert 0.5 * before < left <= before
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert {r[0] for r in packed.select("doc_id").distinct().collect()} == {r[0] for r in docs.select("doc_id").collect()}


def test_large_ids_next_to_nulls_keep_their_digits(spark):
    """pandas would make floats of them."""
    big, text = 2**60 + 1, "some words of a text that is long enough for shingles"
    docs = spark.createDataFrame([(big, text, "en", "s", 5), (None, "other", None, None, None), (big + 2, None, "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    labels = spark.createDataFrame([(big, 1, 0), (big + 2, 0, 1)], "doc_id long, quality int, toxic int")
    for out in (pii.find(docs), quality.cotrain(docs, labels), ngram_join.near_duplicates(docs), packing.pack(docs), toxicity.score(docs, toxicity.fit(docs, labels)), license.scan(docs, license.known_licenses(spark))):
        assert sorted({r[0] for r in out.collect()}, key=repr) == sorted([big, big + 2, None], key=repr) and out.schema[0].dataType == docs.schema[0].dataType
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("http://a.b/c").alias("url"), F.col("text").alias("html"))
    assert {r.page_id for r in warc.round_trip(pages).collect()} == {r.page_id for r in urls.filter_urls(pages).collect()} == {big, big + 2, None}
