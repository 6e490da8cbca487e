"""What the queries read: views over the driver's tables, each as a DataFrame and as DuckDB SQL with the same rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query and its SQL twin."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint folder. Only a session on one machine, local[..], may do without a shared folder."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{where.rstrip('/')}/{name}-{uuid.uuid4().hex}"


# DuckDB helpers -------------------------------------------------------------------------------------------------------


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def norm(x: str) -> str:
    """Normal form of an answer: lower, no punctuation, no articles."""
    words = f"string_split({squeeze(f"regexp_replace(lower({x}), '[[:punct:]]', '', 'g')")}, ' ')"
    return f"array_to_string(list_filter({words}, lambda w: w NOT IN ('a', 'an', 'the', '')), ' ')"


def toks(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda w: w <> '')"


def common(p: str, g: str) -> str:
    """Size of the multiset intersection of two lists."""
    return f"coalesce(list_sum(list_transform(list_distinct({p}), lambda t: least(len(list_filter({p}, lambda x: x = t)), len(list_filter({g}, lambda x: x = t))))), 0)"


# Views ----------------------------------------------------------------------------------------------------------------

#: The prompt type of the views whose answers stand between tags.
TAGGED = frozenset({"copy_evidence"})
OPEN, CLOSE = "<|EVIDENCE|>", "</|EVIDENCE|>"


def turns(spark: SparkSession, d: str) -> DataFrame:
    """User turns with the assistant's reply: id, conv_id, dataset, model, prompt_type, noise, gold_removed, q, t, line, ans."""
    c = table(spark, d, "conversations")
    asked = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("q"))
    said = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("t"))
    k = F.col("conv_id")
    return asked.join(said, ["conv_id", "turn"]).select(
        (k * 1000 + F.col("turn")).cast("string").alias("id"), "conv_id", F.concat(F.lit("set"), (k % 3).cast("string")).alias("dataset"), F.concat(F.lit("m"), (k % 2).cast("string")).alias("model"),
        F.when(k % 2 == 0, "copy_evidence").otherwise("rag").alias("prompt_type"), F.expr("cast(case conv_id % 5 when 0 then 0 when 1 then 1 when 2 then 2 when 3 then 4 else 8 end as int)").alias("noise"), (k % 7 == 0).alias("gold_removed"), "q", "t",
        F.get(F.split("t", "\n"), F.lit(0)).alias("line"), F.array_join(F.slice(F.split(F.trim(F.regexp_replace("t", r"\s+", " ")), " "), 1, 3), " ").alias("ans"),
    )


TURNS = f"""turns AS (SELECT (u.conv_id * 1000 + u.turn)::VARCHAR AS id, u.conv_id, 'set' || (u.conv_id % 3) AS dataset, 'm' || (u.conv_id % 2) AS model,
  CASE WHEN u.conv_id % 2 = 0 THEN 'copy_evidence' ELSE 'rag' END AS prompt_type, (CASE u.conv_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 4 ELSE 8 END)::INT AS noise, u.conv_id % 7 = 0 AS gold_removed,
  u.text AS q, a.text AS t, string_split(a.text, chr(10))[1] AS line, array_to_string(string_split({squeeze('a.text')}, ' ')[1:3], ' ') AS ans
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' AND u.role = 'user')"""


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """turns plus predict (well formed, answer line, no answer, two think blocks, text outside, adjacent evidence, error), answers, facts."""
    ev = F.concat(F.lit(OPEN), F.col("line"), F.lit(CLOSE))
    think = lambda x: F.concat(F.lit("<|think|>"), x, F.lit("</|think|>"))
    answer = F.concat(F.lit("<|answer|> The "), F.col("ans"), F.lit("</|answer|>"))
    k = F.col("conv_id") % 8
    predict = (
        F.when(k == 0, F.concat(think(F.concat(F.lit("so "), ev, F.lit(" and more words than the answer has"))), F.lit("\n"), answer))
        .when(k == 1, F.concat(F.lit("Since "), ev, F.lit(".\nAnswer: The "), F.col("ans"), F.lit(" <x>\nend")))
        .when(k == 2, F.concat(think(ev), F.lit(" "), F.col("q")))
        .when(k == 3, F.concat(think(ev), think(F.lit("b")), answer, F.lit("\nAnswer: "), F.col("q")))
        .when(k == 4, F.concat(F.lit("before "), think(F.concat(F.lit("x"), ev)), answer))
        .when(k == 5, F.concat(F.lit("<think>plain</think>"), ev, F.lit("  "), ev, F.lit("\nAnswer: "), F.col("ans"), F.lit(" "), ev))
        .when(k == 6, F.concat(think(F.concat(ev, F.lit(" "), ev)), answer))
        .otherwise(F.concat(F.lit("ERROR: "), F.col("q")))
    )
    p = turns(spark, d)
    return p.withColumn("predict", predict).withColumn("answers", F.array("ans", F.concat_ws(" ", F.lit("the"), "line"))).withColumn("facts", F.split("t", "\n"))


PREDICTIONS = f"""{TURNS}, predictions AS (SELECT *, [ans, 'the ' || line] AS answers, string_split(t, chr(10)) AS facts, CASE conv_id % 8
  WHEN 0 THEN '<|think|>so ' || ev || ' and more words than the answer has</|think|>' || chr(10) || an
  WHEN 1 THEN 'Since ' || ev || '.' || chr(10) || 'Answer: The ' || ans || ' <x>' || chr(10) || 'end'
  WHEN 2 THEN '<|think|>' || ev || '</|think|> ' || q
  WHEN 3 THEN '<|think|>' || ev || '</|think|><|think|>b</|think|>' || an || chr(10) || 'Answer: ' || q
  WHEN 4 THEN 'before <|think|>x' || ev || '</|think|>' || an
  WHEN 5 THEN '<think>plain</think>' || ev || '  ' || ev || chr(10) || 'Answer: ' || ans || ' ' || ev
  WHEN 6 THEN '<|think|>' || ev || ' ' || ev || '</|think|>' || an
  ELSE 'ERROR: ' || q END AS predict
  FROM (SELECT *, '{OPEN}' || line || '{CLOSE}' AS ev, '<|answer|> The ' || ans || '</|answer|>' AS an FROM turns))"""

EV = "'<\\|EVIDENCE\\|>((?s:.*?))</\\|EVIDENCE\\|>'"
SPANS = f"list_transform(regexp_extract_all(predict, {EV}, 1), lambda s: {strip('s')})"
NO_EV = squeeze(f"regexp_replace(x, {EV}, '', 'g')")
#: The parsed answer and facts of predictions.
PARSED = f"""{PREDICTIONS}, raw AS (SELECT *, {SPANS} AS pred_facts, regexp_extract_all(predict, 'Answer:\\s*([^\\n]+)(?:\\n|$)', 1) AS lines FROM predictions),
lined AS (SELECT *, regexp_replace(lines[-1], '</?\\|answer\\|>', '', 'g') AS x FROM raw),
parsed AS (SELECT * EXCLUDE (lines, x), CASE WHEN len(lines) = 0 THEN NULL ELSE regexp_replace({NO_EV}, '[<>]', '', 'g') END AS line_answer,
  {strip("regexp_extract(predict, '<\\|answer\\|>((?s:.*?))</\\|answer\\|>', 1)")} AS tag_answer FROM lined),
answered AS (SELECT *, CASE WHEN prompt_type = 'copy_evidence' THEN tag_answer ELSE line_answer END AS answer FROM parsed)"""

GOLD = "list_transform(answers, lambda g: {n})".replace("{n}", norm("g"))
CLOSED = "('yes', 'no', 'noanswer', 'maybe')"
#: Answer and fact scores of each parsed prediction.
SCORED = f"""{PARSED}, n1 AS (SELECT *, {norm("coalesce(answer, '')")} AS np, {GOLD} AS ng FROM answered),
each AS (SELECT id AS eid, gi, np, ng[gi] AS g, {toks('np')} AS pt, {toks('ng[gi]')} AS gt FROM (SELECT id, np, ng, unnest(range(1, len(ng) + 1)) AS gi FROM n1)),
cnt AS (SELECT eid, gi, len(pt) AS n_p, len(gt) AS n_g, CASE WHEN (np IN {CLOSED} OR g IN {CLOSED}) AND np <> g THEN 0 ELSE {common('pt', 'gt')} END AS c FROM each),
tri AS (SELECT eid, gi, CASE WHEN c > 0 THEN 2 * (c / n_p) * (c / n_g) / (c / n_p + c / n_g) ELSE 0 END AS f1, CASE WHEN c > 0 THEN c / n_p ELSE 0 END AS pr, CASE WHEN c > 0 THEN c / n_g ELSE 0 END AS re FROM cnt),
best AS (SELECT eid, arg_max(f1, (f1, -gi)) AS bf, arg_max(pr, (f1, -gi)) AS bp, arg_max(re, (f1, -gi)) AS br FROM tri GROUP BY eid),
facts1 AS (SELECT *, list_transform(pred_facts, lambda s: lower({strip('s')})) AS pf, list_transform(facts, lambda s: lower({strip('s')})) AS gf FROM n1),
facts2 AS (SELECT *, len(pf) > 0 AND len(gf) > 0 AND pf[1] <> '' AND gf[1] <> '' AS ok, len(list_filter(pf, lambda s: contains(array_to_string(gf, ' '), s))) AS tp, len(list_filter(gf, lambda s: NOT contains(array_to_string(pf, ' '), s))) AS fn FROM facts1),
facts3 AS (SELECT *, len(pf) - tp AS fp, CASE WHEN ok THEN tp / len(pf) ELSE 0 END AS sp_prec, CASE WHEN ok AND tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS sp_recall FROM facts2),
s1 AS (SELECT facts3.*, CASE WHEN ok AND fp + fn = 0 THEN 1.0::DOUBLE ELSE 0 END AS sp_em, CASE WHEN sp_prec + sp_recall > 0 THEN 2 * sp_prec * sp_recall / (sp_prec + sp_recall) ELSE 0 END AS sp_f1, coalesce(answer, '') <> '' AS filled, bf, bp, br FROM facts3 JOIN best ON eid = id),
s2 AS (SELECT *, CASE WHEN filled AND list_contains(ng, np) THEN 1.0::DOUBLE ELSE 0 END AS em, CASE WHEN filled AND len(list_filter(ng, lambda g: contains(np, g))) > 0 THEN 1.0::DOUBLE ELSE 0 END AS hit, CASE WHEN filled THEN bf ELSE 0.0 END AS f1, CASE WHEN filled THEN bp ELSE 0.0 END AS prec, CASE WHEN filled THEN br ELSE 0.0 END AS recall, answer IS NOT NULL AS answer_parsed, len(pred_facts) >= 1 AS facts_parsed FROM s1),
s3 AS (SELECT *, CASE WHEN answer_parsed AND facts_parsed THEN em * sp_em ELSE 0 END AS joint_em, CASE WHEN answer_parsed AND facts_parsed THEN bp * sp_prec ELSE 0 END AS joint_prec, CASE WHEN answer_parsed AND facts_parsed THEN br * sp_recall ELSE 0 END AS joint_recall, coalesce(len(answer), 0) AS answer_len, list_sum(list_transform(answers, lambda g: len(g))) / len(answers) AS gold_answer_len, coalesce(list_sum(list_transform(pred_facts, lambda s: len(s))), 0) AS facts_len, coalesce(len(predict), 0) AS predict_len FROM s2),
scored AS (SELECT *, CASE WHEN joint_prec + joint_recall > 0 THEN 2 * joint_prec * joint_recall / (joint_prec + joint_recall) ELSE 0 END AS joint_f1 FROM s3)"""


def attempts(spark: SparkSession, d: str) -> DataFrame:
    """Events as an attempt log: id, attempt_idx, answer, is_correct (null for errors)."""
    e = table(spark, d, "events")
    idx = F.expr("row_number() over (partition by user_id order by ts, event_id)")
    kind = F.col("event_type")
    return e.select(F.col("user_id").cast("string").alias("id"), idx.cast("int").alias("attempt_idx"), kind.alias("answer"), F.when(kind != "error", kind == "purchase").alias("is_correct"))


ATTEMPTS = """attempts AS (SELECT user_id::VARCHAR AS id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id))::INT AS attempt_idx, event_type AS answer,
  CASE WHEN event_type <> 'error' THEN event_type = 'purchase' END AS is_correct FROM events)"""


def answers_table(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents as answerability rows: qid, has_ans, na_prob, pred, golds."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    w = F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")
    gold = F.array_join(F.slice(w, 1, 3), " ")
    pred = F.when(F.col("toxic") == 1, "").when(F.col("doc_id") % 3 == 0, gold).otherwise(F.array_join(F.slice(w, 2, 4), " "))
    return docs.select(F.col("doc_id").alias("qid"), (F.col("quality") == 1).alias("has_ans"), ((F.col("n_chars") % 1000) / 1000.0).alias("na_prob"), pred.alias("pred"), F.when(F.col("quality") == 1, F.array(gold)).otherwise(F.array().cast("array<string>")).alias("golds"))


_W = "string_split(" + squeeze("text") + ", ' ')"
ANSWERS = f"""qa0 AS (SELECT doc_id AS qid, quality = 1 AS has_ans, (n_chars % 1000) / 1000.0 AS na_prob, array_to_string({_W}[1:3], ' ') AS gold,
  CASE WHEN toxic = 1 THEN '' WHEN doc_id % 3 = 0 THEN array_to_string({_W}[1:3], ' ') ELSE array_to_string({_W}[2:5], ' ') END AS pred FROM documents JOIN labels USING (doc_id)),
qa1 AS (SELECT *, {norm('pred')} AS np, {norm('gold')} AS n0 FROM qa0),
qa2 AS (SELECT *, CASE WHEN has_ans THEN n0 ELSE '' END AS ng FROM qa1), qa3 AS (SELECT *, {toks('np')} AS pt, {toks('ng')} AS gt FROM qa2),
qa4 AS (SELECT *, {common('pt', 'gt')} AS c FROM qa3),
qa AS (SELECT *, (np = ng)::INT::DOUBLE AS exact, CASE WHEN len(pt) = 0 OR len(gt) = 0 THEN (len(pt) = len(gt))::INT::DOUBLE WHEN c > 0 THEN 2 * (c / len(pt)) * (c / len(gt)) / (c / len(pt) + c / len(gt)) ELSE 0.0 END AS f1 FROM qa4)"""


def method_scores(spark: SparkSession, d: str) -> DataFrame:
    """Labels by source and language as evaluation summaries: method, dataset, em, f1, sp_f1."""
    j = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang", "source"), "doc_id")
    return j.groupBy(F.col("source").alias("method"), F.col("lang").alias("dataset")).agg(F.avg("quality").alias("em"), (1 - F.avg("toxic")).alias("f1"), F.avg(F.col("quality") * (1 - F.col("toxic"))).alias("sp_f1"))


METHODS = """methods AS (SELECT source AS method, lang AS dataset, avg(quality) AS em, 1 - avg(toxic) AS f1, avg(quality * (1 - toxic)) AS sp_f1 FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2)"""


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison."""
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))
