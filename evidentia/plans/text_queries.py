"""Queries of text functions and prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions import metrics as M
from evidentia.functions import prompts as P
from evidentia.functions import text as T
from evidentia.plans.base import PARSED, TAGGED, TURNS, norm, predictions, query, rounded, squeeze, strip, table, turns
from evidentia.operators import reports

D = "documents"


@query("t1_normalize_answer", f"SELECT doc_id, {norm('text')} AS normal FROM documents")
def t1(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, D).select("doc_id", T.normalize_answer(F.col("text")).alias("normal"))


@query("t2_clean_text", f"SELECT doc_id, lower({squeeze("regexp_replace(text, '[[:punct:]]', '', 'g')")}) AS clean FROM documents")
def t2(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, D).select("doc_id", T.clean_text(F.col("text")).alias("clean"))


@query("t3_t6_parse_completions", f"WITH {PARSED} SELECT id, line_answer, tag_answer, array_to_string(pred_facts, '|') AS spans, len(pred_facts)::INT AS n_spans, {squeeze("regexp_replace(predict, '<\\|EVIDENCE\\|>((?s:.*?))</\\|EVIDENCE\\|>', '', 'g')")} AS without FROM answered")
def t3(spark: SparkSession, d: str) -> DataFrame:
    p = predictions(spark, d)
    c = F.col("predict")
    spans = T.extract_evidence(c)
    return p.select("id", T.extract_answer(c).alias("line_answer"), T.extract_answer_tagged(c).alias("tag_answer"), F.array_join(spans, "|").alias("spans"), F.size(spans).alias("n_spans"), T.remove_evidence(c).alias("without"))


@query("t7_t14_sentences", f"""WITH c AS (SELECT doc_id, regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g') AS x, string_split(text, '. ') AS y FROM documents)
SELECT doc_id, len(list_filter(list_transform(string_split(x, chr(1)), lambda s: {strip('s')}), lambda s: s <> ''))::INT AS n_sentences,
array_to_string(list_filter(list_transform(string_split(x, chr(1)), lambda s: {strip('s')}), lambda s: s <> '')[1:3], '|') AS first, array_to_string(list_transform(list_filter(y, lambda s: {strip('s')} <> ''), lambda s: {strip('s')} || '.')[1:3], '|') AS naive FROM c""")
def t7(spark: SparkSession, d: str) -> DataFrame:
    s, n = T.sentences(F.col("text")), T.naive_sentences(F.col("text"))
    return table(spark, d, D).select("doc_id", F.size(s).alias("n_sentences"), F.array_join(F.slice(s, 1, 3), "|").alias("first"), F.array_join(F.slice(n, 1, 3), "|").alias("naive"))


@query("t8_quoted_span", """SELECT doc_id, CASE WHEN regexp_matches(t, '(?s)''.*?''') THEN regexp_extract(t, '(?s)''(.*?)''', 1) ELSE t END AS quoted FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text ELSE text || ' ''' || source || ''' and ''b''' END AS t FROM documents)""")
def t8(spark: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(F.concat("text", F.lit(" '"), "source", F.lit("' and 'b'")))
    return table(spark, d, D).select("doc_id", T.quoted(text).alias("quoted"))


@query("t9_html_sentences", f"""WITH c AS (SELECT page_id, list_filter(list_transform(string_split(regexp_replace(html, '(?i)<br\\s*/?>', chr(1), 'g'), chr(1)), lambda s: {strip("regexp_replace(s, '(?is)^.*?<b>Sent\\s+\\d+:\\s*</b>\\s*', '')")}), lambda s: s <> '') AS s FROM pages) SELECT page_id, len(s)::INT AS n, s[-1] AS last FROM c""")
def t9(spark: SparkSession, d: str) -> DataFrame:
    s = T.html_sentences(F.col("html"))
    return table(spark, d, "pages").select("page_id", F.size(s).alias("n"), F.try_element_at(s, F.lit(-1)).alias("last"))


@query("t10_citation_ids", "SELECT doc_id, concat_ws(',', doc_id, doc_id + 1, doc_id + 2) AS ids FROM documents")
def t10(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    text = F.concat(F.lit("see ["), k.cast("string"), F.lit(", "), (k + 1).cast("string"), F.lit(", x7] and ["), (k + 2).cast("string"), F.lit("] or [none]"))
    return table(spark, d, D).select("doc_id", F.array_join(T.citation_ids(text), ",").alias("ids"))


@query("t11_safe_keys", """WITH c AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '[\\\\/:*?"<>|''\\x00-\\x1f]', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g') AS a,
regexp_replace(regexp_replace(regexp_replace(replace(html, ' ', '_'), '[\\\\/:*?"<>|''\\x00-\\x1f]', '', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g') AS b FROM pages) SELECT page_id, a AS id_key, regexp_replace(b[1:100], '^_|_$', '', 'g') AS question_key FROM c""")
def t11(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.safe_id(F.col("url")).alias("id_key"), T.safe_question(F.col("html")).alias("question_key"))


_Q, _C = "('## Question' || chr(10) || question)", "('## Context' || chr(10) || context)"
_NL, _RULE = "chr(10) || chr(10)", "chr(10) || chr(10) || repeat('=', 50) || chr(10) || chr(10)"
_BLOCK = f"({_C} || {_NL} || {_Q})"
_PART = lambda a, b: f"('## Context' || chr(10) || coalesce(array_to_string(l[{a}:{b}], chr(10)), ''))"
_INT = f"{_Q} || {_NL} || {_PART('1', 'n // 4')} || {_NL} || {_Q} || {_NL} || {_PART('n // 4 + 1', '3 * n // 4')} || {_NL} || {_PART('3 * n // 4 + 1', 'n')} || {_NL} || {_Q}"
_SPACED = "array_to_string(string_split(question, ''), ' ')"
_DOCS = f"array_to_string(list_transform(docs, lambda x, i: 'Document ' || i || chr(10) || x || {_NL} || {_Q}), {_NL})"
PROMPTS = {
    "direct_inference": "question", "rag": _BLOCK, "rag_rep_2": f"{_BLOCK} || {_RULE} || {_BLOCK}", "rag_rep_q": f"{_BLOCK} || {_RULE} || {_Q}", "rag_qcq": f"{_Q} || {_NL} || {_C} || {_NL} || {_Q}",
    "rag_qcq2": f"{_Q} || {_NL} || {_C} || {_NL} || {_Q} || {_NL} || {_Q}", "rag_q_int_q": _INT, "rag_q_int2_q": f"{_INT} || {_NL} || {_Q}", "rag_q_int_docs_q": f"{_Q} || {_NL} || {_DOCS} || {_NL} || {_Q}",
    "rag_decompressed": f"{_C} || {_NL} || '## Question' || chr(10) || {_SPACED}", "rag_decompressed_rep_q": f"{_C} || {_NL} || '## Question' || chr(10) || {_SPACED} || {_NL} || '## Question' || chr(10) || {_SPACED}",
}
_PROMPT_COLUMNS = ", ".join(f"sha256({v}) AS {k}" for k, v in PROMPTS.items())


@query("t12_prompts", f"""WITH {TURNS}, p AS (SELECT id, string_split(q, chr(10))[1] AS question, replace(t, chr(10), chr(10) || chr(10)) AS context FROM turns),
l AS (SELECT *, string_split(context, chr(10)) AS l, len(string_split(context, chr(10))) AS n, list_filter(list_transform(string_split(context, chr(10) || chr(10)), lambda s: {strip('s')}), lambda s: s <> '') AS docs FROM p) SELECT id, {_PROMPT_COLUMNS} FROM l""")
def t12(spark: SparkSession, d: str) -> DataFrame:
    q, c = F.get(F.split("q", "\n"), F.lit(0)), F.replace("t", F.lit("\n"), F.lit("\n\n"))
    p = turns(spark, d).select("id", q.alias("question"), c.alias("context"))
    return p.select("id", *(F.sha2(P.user_prompt(k, F.col("question"), F.col("context")), 256).alias(k) for k in PROMPTS))


_LISTED = lambda a: f"array_to_string(list_transform({a}, lambda x: '- ' || x), chr(10))"
_LEGACY = {"direct": "Answer:", "reasoning": "Reason, then answer.", "reasoning_with_evidence": "Reason with copied evidence, then answer.", "reasoning_with_evidence_old": "Reason with copied evidence, then answer between tags."}
_OTHER_COLUMNS = ", ".join([
    f"sha256({_BLOCK}) AS attempt", f"sha256(CASE WHEN conv_id % 2 = 0 THEN {_BLOCK} || chr(10) || chr(10) || '## Answers known to be wrong' || chr(10) || {_LISTED('wrong')} ELSE {_BLOCK} END) AS attempt_with_tips",
    f"sha256({_C} || {_NL} || {_Q} || {_NL} || '## Facts' || chr(10) || {_LISTED('facts')} || {_NL} || '## Answers' || chr(10) || {_LISTED('[ans]')} || {_NL} || 'Do the facts support the answers? Reply yes or no.') AS judge",
    *(f"sha256('Context: ' || context || chr(10) || 'Question: ' || question || chr(10) || '{v}') AS {k}" for k, v in _LEGACY.items()), *(f"sha256('{v.replace(chr(39), chr(39) * 2)}') AS system_{k}" for k, v in P.SYSTEM.items() if k in ("rag", "cot", "rag_rep_2")),
])


@query("t12_other_prompts", f"WITH {TURNS}, p AS (SELECT id, conv_id, q AS question, t AS context, ans, [ans, 'no ' || ans] AS wrong, string_split(t, chr(10)) AS facts FROM turns) SELECT id, {_OTHER_COLUMNS} FROM p")
def t12b(spark: SparkSession, d: str) -> DataFrame:
    """Attempt prompts (with earlier wrong answers for every other conversation), judge prompts, older layouts and system texts."""
    q, c, ans = F.col("q"), F.col("t"), F.col("ans")
    wrong = F.when(F.col("conv_id") % 2 == 0, F.array(ans, F.concat(F.lit("no "), ans)))
    made = {"attempt": P.attempt_prompt(q, c), "attempt_with_tips": P.attempt_prompt(q, c, wrong), "judge": P.judge_prompt(q, c, F.split("t", "\n"), F.array("ans"))}
    made |= {k: P.legacy_prompt(k, q, c) for k in _LEGACY} | {f"system_{k}": P.prompt(k, q, c)["system"] for k in ("rag", "cot", "rag_rep_2") if k in P.SYSTEM}
    return turns(spark, d).select("id", *(F.sha2(v, 256).alias(k) for k, v in made.items()))


@query("t18_delta_text", """WITH m AS (SELECT source, lang, avg(n_chars) AS a, count(*) AS n FROM documents GROUP BY 1, 2), d AS (SELECT *, CASE WHEN a = 0 THEN 0 ELSE (n * 40 - a) / a * 100 END AS delta FROM m)
SELECT source, lang, CASE WHEN delta >= 0 THEN '+' ELSE '' END || printf('%.1f%%', delta) AS delta FROM d""")
def t18(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, D).groupBy("source", "lang").agg(F.avg("n_chars").alias("a"), F.count("*").alias("n"))
    return m.select("source", "lang", T.delta_text(T.relative_delta(F.col("a"), F.col("n") * 40)).alias("delta"))


@query("t13_dataset_names", """WITH n AS (SELECT DISTINCT source, lang FROM documents) SELECT source, lang, CASE lang WHEN 'en' THEN 'HotpotQA' WHEN 'fr' THEN 'MuSiQue' WHEN 'de' THEN '2WikiMultiHopQA' ELSE source END AS name FROM n""")
def t13(spark: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.col("lang") == "en", "hotpot-QA").when(F.col("lang") == "fr", "mu_siQUE").when(F.col("lang") == "de", "2wiki_dev").otherwise(F.col("source"))
    return table(spark, d, D).select("source", "lang").distinct().select("source", "lang", T.dataset_name(raw).alias("name"))


@query("t15_run_paths", """SELECT doc_id, 'dataset' AS level, 'mod' || (doc_id % 5) AS model, (doc_id % 9)::INT AS seed, 0.5::DOUBLE AS tpr, lang AS prompt_type, source AS dataset, (doc_id % 4)::INT AS noise, doc_id % 2 = 0 AS answerable, '20250101000000' AS run_ts, source AS plain FROM documents""")
def t15(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    folder = F.concat("source", F.lit("-noise_"), (k % 4).cast("string"), F.when(k % 2 == 0, "-answerable").otherwise("-unanswerable"))
    path = F.concat(F.lit("/runs/mod"), (k % 5).cast("string"), F.lit("/seed_"), (k % 9).cast("string"), F.lit("/tpr_0.5/prompt_"), "lang", F.lit("/"), folder)
    parsed, said = T.run_path(F.concat(path, F.lit("/20250101000000/"))), T.run_path(path)
    plain = T.base_dataset(F.concat("source", F.lit("-noise_8-answerable")))
    return table(spark, d, D).select("doc_id", said["level"].alias("level"), *(parsed[c].alias(c) for c in ("model", "seed", "tpr", "prompt_type", "dataset", "noise", "answerable", "run_ts")), plain.alias("plain"))


@query("t17_t19_names_deltas", """WITH m AS (SELECT source, lang, avg(n_chars) AS a, count(*) AS n FROM documents GROUP BY 1, 2)
SELECT source, lang, 'Rag ' || upper(lang[1]) || lang[2:] || ' ×2' AS name, round(CASE WHEN a = 0 THEN 0 ELSE (n - a) / a * 100 END, 6) AS delta, round(log2(n) + 1, 6) AS x FROM m""")
def t17(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, D).groupBy("source", "lang").agg(F.avg("n_chars").alias("a"), F.count("*").alias("n"))
    return rounded(m.select("source", "lang", T.method_name(F.concat(F.lit("prompt_rag_"), "lang", F.lit("_rep_2"))).alias("name"), T.relative_delta(F.col("a"), F.col("n")).alias("delta"), T.noise_coordinate(F.col("n")).alias("x")))


@query("t20_t22_contexts", """WITH c AS (SELECT doc_id, source, string_split(text, chr(10)) AS s FROM documents)
SELECT doc_id, sha256(array_to_string(s, ' ') || ' ' || source) AS flat, coalesce(len(s[2]), 0)::INT AS second_len, sha256(source || '. ' || array_to_string(s, '') || chr(10) || 'x. ' || source || chr(10)) AS prose FROM c""")
def t20(spark: SparkSession, d: str) -> DataFrame:
    title, sents = F.array("source", F.lit("x")), F.array(F.split("text", "\n"), F.array("source"))
    return table(spark, d, D).select("doc_id", F.sha2(T.context_text(sents), 256).alias("flat"), T.sentence_length(title, sents, F.col("source"), F.lit(1)).cast("int").alias("second_len"), F.sha2(T.prose_context(title, sents), 256).alias("prose"))


@query("t21_word_counts", f"SELECT doc_id, CASE WHEN {squeeze('text')} = '' THEN 0 ELSE len(string_split({squeeze('text')}, ' ')) END::INT AS words, len(text)::INT AS chars FROM documents")
def t21(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, D).select("doc_id", T.n_words(F.col("text")).alias("words"), F.length("text").alias("chars"))


@query("m10_strict_copy", f"""WITH {PARSED} SELECT id, (contains(lower(ans), lower(coalesce({strip('answer')}, '~'))) AND len(pred_facts) > 0 AND len(list_filter(pred_facts, lambda s: NOT contains(t, s))) = 0)::INT AS strict FROM answered""")
def m10(spark: SparkSession, d: str) -> DataFrame:
    p = reports.parsed(predictions(spark, d), TAGGED)
    return p.select("id", M.strict_copy(F.col("answer"), F.col("ans"), F.col("pred_facts"), F.col("t")).alias("strict"))


@query("x6_x7_containment", """WITH l AS (SELECT doc_id, list_distinct(string_split(text, chr(10))) AS a FROM documents)
SELECT doc_id, array_to_string(list_sort(list_filter(a, lambda x: len(list_filter(a, lambda y: y <> x AND contains(y, x))) = 0)), '|') AS longest, array_to_string(list_sort(list_filter(a, lambda x: len(list_filter(a, lambda y: y <> x AND contains(x, y))) = 0)), '|') AS shortest FROM l""")
def x6(spark: SparkSession, d: str) -> DataFrame:
    lines = F.split("text", "\n")
    return table(spark, d, D).select("doc_id", F.array_join(F.array_sort(T.maximal(lines)), "|").alias("longest"), F.array_join(F.array_sort(T.minimal(lines)), "|").alias("shortest"))


@query("c8_locate", """WITH c AS (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents), x AS (SELECT doc_id, s, trim(s[-1]) AS w FROM c)
SELECT doc_id, 'b' AS title, (list_position(list_transform(s, lambda y: contains(y, w)), true) - 1)::INT AS sent_id FROM x""")
def c8(spark: SparkSession, d: str) -> DataFrame:
    s = F.split("text", "\n")
    found = T.locate(F.trim(F.try_element_at(s, F.lit(-1))), F.array(F.lit("a"), F.lit("b")), F.array(F.array().cast("array<string>"), s))
    return table(spark, d, D).select("doc_id", found["title"].alias("title"), found["sent_id"].alias("sent_id"))
