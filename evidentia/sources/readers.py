"""Readers and writers. Schemas are explicit; nothing is inferred or collected."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions.text import base_dataset, run_path
from evidentia.operators.lookups import last_by_key
from evidentia.operators.reports import latest

SAMPLE = "dataset string, id string, query string, answers array<string>, context string, facts array<string>, corpus array<struct<title:string,sentences:array<string>,facts:array<string>>>, extra map<string,string>"
PREDICTION = "id string, query string, predict string, timestamp string, context string, answers array<string>"
METADATA = "info struct<model_name:string,prompt_type:string,dataset:string,temperature:double,start_time:string,end_time:string>, total_samples int, completed_samples int, failed_samples int"
LEGACY = "info struct<model_name:string,prompt_type:string,dataset:string>, data map<string,struct<predict:string,answer:array<string>,answers:array<string>,sfs:array<string>,facts:array<string>,context:string,dataset:string>>"
ATTEMPT = "id string, attempt_idx int, predict string, is_correct boolean, tips_wrong_answer array<string>, recieved_tips boolean, error string"
ROLLOUT = "rowData array<struct<step:bigint,completion:string,solution:struct<answers:array<string>,dataset:string,id:string>,AnswerEMReward:double>>"
SUMMARY = "dataset string, prompt_type string, total_samples int, answer_em double, answer_f1 double, supporting_f1 double"
SQUAD = "data array<struct<paragraphs:array<struct<qas:array<struct<id:string,answers:array<struct<text:string>>>>>>>>"
CORRUPT = "_corrupt_record"


def read_json(spark: SparkSession, path: str, schema: str, field: str | None = None) -> DataFrame:
    """One document, or one of its top-level fields (an array's elements as rows)."""
    df = spark.read.option("multiLine", True).schema(schema).json(path)
    if field is None:
        return df
    kind = df.schema[field].dataType.typeName()
    return df.select(F.explode(field).alias("_x")).select("_x.*") if kind == "array" else df.select(f"{field}.*")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Good lines; blank and malformed ones are left out (see bad_lines)."""
    raw = spark.read.schema(f"{schema}, {CORRUPT} string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)
    return raw.where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def bad_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row with the number of malformed lines. Lines are parsed from text, since a scan of the corrupt column alone is not allowed."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    got = F.from_json("value", f"{schema}, {CORRUPT} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    return lines.select(F.count_if(got[CORRUPT].isNotNull()).alias("n_bad"))


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    """S3: bare scalars, a line each, as strings."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json(F.concat(F.lit('{"v":'), "value", F.lit("}")), "v string")["v"].alias("id"))


def read_jsonl_where(spark: SparkSession, path: str, schema: str, condition: Column) -> DataFrame:
    """S4."""
    return read_jsonl(spark, path, schema).where(condition)


def write_jsonl(df: DataFrame, path: str, mode: str = "error") -> None:
    """UTF-8 lines in a folder; parents are created."""
    df.write.mode(mode).json(path)


CACHE_KEYS = ["dataset", "split", "noise", "answerable"]
#: Keys of a versioned cache.
FORMATTED_KEYS = ["dataset", "subset", "split", "noise", "answerable"]


def write_formatted(samples: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Formatted samples, partitioned by what they were made from."""
    samples.write.mode(mode).partitionBy(*CACHE_KEYS).parquet(path)


def read_formatted(spark: SparkSession, path: str, **wanted: str | int | bool) -> DataFrame:
    """Only the wanted partitions are read."""
    df = spark.read.parquet(path)
    for key, value in wanted.items():
        df = df.where(F.col(key) == value)
    return df


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Committed versions below a folder of ``formatted``, oldest first."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where.suffix("/version=*/_SUCCESS"))
    return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found or [])


def formatted(spark: SparkSession, path: str, key: dict[str, str | int | bool], build: Callable[[], DataFrame], schema: str, reload: bool = False, fmt: str = "parquet") -> DataFrame:
    """The cached samples of one key (dataset, subset, split, noise, answerable), built if there are none or reload is set.

    A build is a new version in a folder of its own, which counts once its commit marker is there: readers of the old one go on, one that fails
    leaves nothing behind that is read, and other keys stay. fmt is parquet or json (gzipped, one object a line). Columns of the key are not stored.
    """
    if sorted(key) != sorted(FORMATTED_KEYS):
        raise ValueError(f"a key has {', '.join(FORMATTED_KEYS)}")
    if fmt not in ("parquet", "json"):
        raise ValueError("fmt is parquet or json")
    folder = "/".join([path, *(f"{k}={re.sub('[^A-Za-z0-9_.-]', lambda c: f'%{ord(c[0]):02X}', str(key[k]))}" for k in FORMATTED_KEYS)])
    known = versions(spark, folder)
    if reload or not known:
        known.append(max(known, default=0) + 1)
        # A version that was begun and not committed may be in the way.
        build().write.mode("overwrite").option("compression", "gzip" if fmt == "json" else "snappy").format(fmt).save(f"{folder}/version={known[-1]}")
    return spark.read.schema(schema).format(fmt).load(f"{folder}/version={known[-1]}")


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """S7."""
    return spark.read.parquet(path)


def read_run_folder(spark: SparkSession, path: str) -> DataFrame:
    """Predictions of all runs below path with columns of their folder's metadata; a file holds a sample or an array of them. Rows without an id are dropped."""
    reader = spark.read.option("multiLine", True).option("recursiveFileLookup", True)
    folder = F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "")
    rows = reader.schema(PREDICTION).option("pathGlobFilter", "[!m]*.json").json(path).select("*", folder.alias("folder"))
    more = reader.schema(PREDICTION).option("pathGlobFilter", "m*.json").json(path).select("*", folder.alias("folder"), F.col("_metadata.file_name").alias("_n")).where("_n <> 'metadata.json'").drop("_n")
    meta = reader.schema(METADATA).option("pathGlobFilter", "metadata.json").json(path).select(folder.alias("folder"), "info.model_name", F.coalesce("info.prompt_type", F.lit("rag")).alias("prompt_type"), "info.dataset")
    found = rows.union(more).where(F.col("id").isNotNull()).join(meta, "folder", "left")
    said = run_path(F.concat("folder", F.lit("/")))
    return found.withColumns({k: said[k] for k in ("noise", "answerable", "run_ts")}).withColumn("prompt_type", F.coalesce("prompt_type", F.lit("rag")))


def read_legacy_result(spark: SparkSession, path: str) -> DataFrame:
    """Items of {info, data} files, older key names accepted; files without info (unfinished runs) are skipped."""
    df = spark.read.option("multiLine", True).schema(LEGACY).json(path).where(F.col("info").isNotNull())
    item = df.select("info.model_name", "info.prompt_type", F.col("info.dataset").alias("_d"), F.explode("data").alias("id", "v"))
    return item.select("model_name", "prompt_type", F.coalesce("v.dataset", "_d").alias("dataset"), "id", "v.predict", F.coalesce("v.answers", "v.answer").alias("answers"), F.coalesce("v.facts", "v.sfs").alias("facts"), "v.context")


def read_eval_summaries(spark: SparkSession, root: str, pattern: str = "*_eval.json") -> DataFrame:
    """Evaluation summaries below root (files of that name pattern), the latest of each method and dataset."""
    df = spark.read.option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).schema(SUMMARY).json(root)
    said = run_path(F.col("_metadata.file_path"))
    rows = df.select("*", said["prompt_type"].alias("method"), said["run_ts"].alias("run_ts")).withColumn("dataset", base_dataset(F.col("dataset")))
    return latest(rows, ["method", "dataset"])


def read_abstract_store(spark: SparkSession, path: str) -> DataFrame:
    """Pmid, title, abstract; rows without a pmid are dropped, of repeated ones the last line stays."""
    schema = f"pmid string, title string, abstract string, {CORRUPT} string"
    raw = spark.read.schema(schema).option("columnNameOfCorruptRecord", CORRUPT).json(path).select("*", F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id()).alias("_pos"))
    return last_by_key(raw.where(F.col(CORRUPT).isNull() & F.col("pmid").isNotNull()), ["pmid"], "_pos").select("pmid", "title", "abstract")


def read_rollout_logs(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all logs below path."""
    df = spark.read.option("multiLine", True).option("recursiveFileLookup", True).schema(ROLLOUT).json(path)
    return df.select(F.explode("rowData").alias("r")).select("r.*")


def read_squad(spark: SparkSession, data: str, preds: DataFrame, na_probs: DataFrame | None = None) -> DataFrame:
    """(qid, golds, has_ans, pred, na_prob); preds is (qid, text), na_probs (qid, p); a missing probability is 0."""
    qa = spark.read.option("multiLine", True).schema(SQUAD).json(data).select(F.explode("data").alias("d")).select(F.explode("d.paragraphs").alias("p")).select(F.explode("p.qas").alias("q"))
    golds = qa.select(F.col("q.id").alias("qid"), F.transform("q.answers", lambda a: a["text"]).alias("golds"), (F.size("q.answers") > 0).alias("has_ans"))
    out = golds.join(preds.select("qid", F.col("text").alias("pred")), "qid", "left")
    out = out.join(na_probs.select("qid", F.col("p").alias("na_prob")), "qid", "left") if na_probs is not None else out.withColumn("na_prob", F.lit(None).cast("double"))
    return out.withColumn("na_prob", F.coalesce("na_prob", F.lit(0.0)))
