"""Adapters from raw dataset shapes to the canonical sample; ADAPTERS is the registry to plug further ones into.

A sample is (dataset, id, query, answers, corpus, extra); context and facts follow from the corpus (``finish``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions.text import canonical_paragraph, citation_ids, html_sentences, minimal, naive_sentences, quoted, sentences, strip
from evidentia.operators.lookups import abstracts_for

NO_STRINGS = "cast(array() as array<string>)"


def _some(c: Column) -> Column:
    """An array, or null where it is empty."""
    return F.when(F.size(c) > 0, c)


def _paragraph(title: Column, sents: Column, facts: Column) -> Column:
    return F.struct(title.alias("title"), sents.alias("sentences"), facts.alias("facts"))


def _extra(**values: Column) -> Column:
    return F.create_map(*(x for k, v in values.items() for x in (F.lit(k), v.cast("string")))) if values else F.expr("cast(map() as map<string,string>)")


def _sample(df: DataFrame, dataset: str, id_: Column, query: Column, answers: Column, corpus: Column, extra: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    return df.select(F.lit(dataset).alias("dataset"), id_.cast("string").alias("id"), query.alias("query"), F.coalesce(answers, F.expr(NO_STRINGS)).alias("answers"), corpus.alias("corpus"), extra.alias("extra"), *keep)


def _passages(column: str, text: str, holds: str) -> Column:
    """Paragraphs of passages; those that hold an answer have all sentences as facts. A text is split once."""
    split = F.transform(column, lambda p: F.struct(p["title"].alias("t"), sentences(p[text]).alias("s"), p[holds].alias("holds")))
    return F.transform(split, lambda p: _paragraph(p["t"], p["s"], F.when(p["holds"], p["s"])))


def finish(samples: DataFrame) -> DataFrame:
    """Adds context (all paragraphs, N14, blank lines between) and facts (of all paragraphs, in order)."""
    context = F.array_join(F.transform("corpus", lambda p: canonical_paragraph(p["title"], p["sentences"])), "\n\n")
    return samples.withColumn("context", context).withColumn("facts", F.flatten(F.transform("corpus", lambda p: F.coalesce(p["facts"], F.expr(NO_STRINGS)))))


def hotpotqa(raw: DataFrame) -> DataFrame:
    """Facts in supporting order, repeated ones kept; numbers out of range are skipped."""
    support = F.arrays_zip(F.col("supporting_facts.title").alias("t"), F.col("supporting_facts.sent_id").alias("k"))

    def paragraph(p: Column) -> Column:
        own = F.filter(support, lambda s: (s["t"] == p["t"]) & (s["k"] < F.size(p["s"])))
        return _paragraph(F.when(p["t"] == "", "unknown title").otherwise(p["t"]), p["s"], _some(F.transform(own, lambda s: F.get(p["s"], s["k"].cast("int")))))

    corpus = F.transform(F.arrays_zip(F.col("context.title").alias("t"), F.col("context.sentences").alias("s")), paragraph)
    return _sample(raw, "HotpotQA", F.col("id"), F.col("question"), F.array("answer"), corpus, _extra(type=F.col("type"), level=F.col("level")))


def two_wiki(raw: DataFrame) -> DataFrame:
    """supporting_facts array<struct<title,idx>>, context array<struct<title,sentences>>; facts in sentence order."""
    def paragraph(p: Column) -> Column:
        return _paragraph(p["title"], p["sentences"], _some(F.filter(p["sentences"], lambda s, i: F.exists("supporting_facts", lambda x: (x["title"] == p["title"]) & (x["idx"] == i)))))

    answers = F.when(F.col("answer").isNotNull(), F.array("answer"))
    return _sample(raw, "2WikiMultiHopQA", F.col("_id"), F.col("question"), answers, F.transform("context", paragraph), _extra(type=F.col("type"), level=F.col("level")))


def musique(raw: DataFrame) -> DataFrame:
    """N3."""
    corpus = _passages("paragraphs", "paragraph_text", "is_supporting")
    return _sample(raw, "MuSiQue", F.col("id"), F.col("question"), F.concat(F.array("answer"), F.coalesce("answer_aliases", F.expr(NO_STRINGS))), corpus, _extra())


def multirc(raw: DataFrame) -> DataFrame:
    """One row a question; supporting number i is the i-th (from 0) of the sentences that are not empty."""
    q = raw.select("id", html_sentences(F.col("paragraph.text")).alias("s"), F.explode("paragraph.questions").alias("q"))
    facts = F.filter(F.transform("q.sentences_used", lambda i: F.get("s", i.cast("int"))), lambda x: x.isNotNull())
    answers = F.transform(F.filter("q.answers", lambda a: a["isAnswer"]), lambda a: a["text"])
    return _sample(q, "MultiRC", F.concat_ws("_", "id", F.col("q.idx").cast("string")), F.col("q.question"), answers, F.array(_paragraph(F.col("id"), F.col("s"), _some(facts))), _extra())


def popqa(raw: DataFrame) -> DataFrame:
    """N5."""
    corpus = _passages("ctxs", "text", "hasanswer")
    return _sample(raw, "PopQA", F.col("id"), F.col("question"), F.col("answers"), corpus, _extra(s_pop=F.col("s_pop"), o_pop=F.col("o_pop")))


def pubmedqa(raw: DataFrame) -> DataFrame:
    """N6."""
    s = F.flatten(F.transform("context.contexts", sentences))
    extra = _extra(long_answer=F.array_join(sentences(F.col("long_answer")), "\n"), options=F.lit("yes|no|maybe"))
    return _sample(raw, "PubMedQA", F.col("pubid"), F.col("question"), F.array("final_decision"), F.transform(F.array(s), lambda s: _paragraph(F.lit("Abstract"), s, s)), extra)


def qasper(raw: DataFrame) -> DataFrame:
    """Answers and evidence of answerable annotators; rows without either are dropped; facts are the minimal evidence."""
    sections = F.transform(F.arrays_zip(F.col("full_text.section_name").alias("n"), F.col("full_text.paragraphs").alias("p")), lambda s: F.concat_ws("\n", s["n"], F.array_join(s["p"], "\n")))
    context = F.concat_ws("\n", "abstract", F.array_join(sections, "\n"), F.array_join("figures_and_tables.caption", "\n"))
    zipped = F.arrays_zip(F.col("qas.question").alias("question"), F.col("qas.question_id").alias("qid"), F.col("qas.answers").alias("answers"))
    q = raw.select("id", "title", context.alias("context"), F.explode(zipped).alias("q"))
    good = F.filter("q.answers.answer", lambda a: ~F.coalesce(a["unanswerable"], F.lit(False)))
    said = F.filter(F.flatten(F.transform(good, lambda a: F.concat(a["extractive_spans"], F.array(a["free_form_answer"])))), lambda x: strip(x) != "")
    evidence = F.flatten(F.transform(good, lambda a: a["highlighted_evidence"]))
    rows = q.select("id", "title", "context", "q", said.alias("a"), evidence.alias("e")).where((F.size("a") > 0) & (F.size("e") > 0))
    return _sample(rows, "Qasper", F.concat_ws("_", "id", "q.qid"), F.col("q.question"), F.col("a"), F.array(_paragraph(F.col("title"), sentences(F.col("context")), minimal(F.col("e")))), _extra())


def faitheval(raw: DataFrame) -> DataFrame:
    """N8."""
    return _sample(raw, "FaithEval", F.col("id"), F.col("question"), F.array("answer"), F.array(_paragraph(F.lit("Document"), sentences(F.col("context")), F.array(quoted(F.col("justification"))))), _extra(answerKey=F.col("answerKey")))


def confiqa(raw: DataFrame, subset: str = "QA", mode: str = "original") -> DataFrame:
    """Raw is the source's rows (pos, x), pos being the row number from 0; all sentences are facts."""
    prefix = {"original": "orig", "counterfactual": "cf"}[mode]
    main, alias = F.col(f"x.{prefix}_answer"), F.coalesce(f"x.{prefix}_alias", F.expr(NO_STRINGS))
    answers = F.when(F.coalesce(main, F.lit("")) != "", F.array_sort(F.array_distinct(F.filter(F.concat(F.array(main), alias), lambda a: F.coalesce(a, F.lit("")) != ""))))
    id_, s = F.concat_ws("_", F.lit(subset), F.lit(mode), F.col("pos").cast("string")), naive_sentences(F.coalesce(f"x.{prefix}_context", F.lit("")))
    return _sample(raw, "ConFiQA", id_, F.col("x.question"), answers, F.array(_paragraph(F.concat(F.lit("Context_"), id_), s, s)), _extra())


def cited_answers(raw: DataFrame, store: DataFrame) -> DataFrame:
    """Canonical samples with context and facts from expert and machine answers, nuggets (the answers) and the abstract store.

    There is no paragraph table: corpus is empty, context is made of abstracts, so ``finish`` is not called. Context: abstracts of all cited papers. Facts: evidence of supporting citations in required sentences of accurate
    answers, plus abstracts of the expert's citations that those leave out. Both sorted by paper id and text.
    """
    machine = raw.select("question_id", F.explode(F.map_values("machine_generated_answers")).alias("m"))
    expert = raw.select("question_id", F.explode(F.array_distinct(citation_ids(F.col("expert_curated_answer")))).alias("pmid"))
    every = expert.union(machine.select("question_id", F.explode(citation_ids(F.col("m.answer"))).alias("pmid"))).distinct()
    supporting = machine.where("m.is_answer_accurate").select("question_id", F.explode("m.answer_sentences").alias("s")).where("s.answer_sentence_relevance = 'required'")
    supporting = supporting.select("question_id", F.explode("s.citation_assessment").alias("c")).where("c.evidence_relation = 'supporting'").select("question_id", F.col("c.cited_pmid").alias("pmid"), F.col("c.evidence_support").alias("fact"))
    left_out = abstracts_for(expert.join(supporting, ["question_id", "pmid"], "left_anti"), store).select("question_id", "pmid", F.col("abstract").alias("fact"))
    capital = F.concat(F.upper(F.substring("title", 1, 1)), F.lower(F.substring("title", 2, 1 << 20)))
    listed = lambda df, value: df.groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pmid", value.alias("x")))), lambda s: s["x"]).alias("x"))
    context = listed(abstracts_for(every, store), F.concat_ws(" ", capital, F.col("abstract"))).withColumnRenamed("x", "context")
    facts = listed(supporting.union(left_out), F.col("fact")).withColumnRenamed("x", "facts")
    rows = raw.select("question_id", "question", "nuggets").join(context, "question_id", "left").join(facts, "question_id", "left")
    corpus = F.expr("cast(array() as array<struct<title:string,sentences:array<string>,facts:array<string>>>)")
    sample = _sample(rows, "MedAESQA", F.col("question_id"), F.col("question"), F.col("nuggets"), corpus, _extra(), ("context", "facts"))
    return sample.withColumns({"context": F.coalesce(F.array_join("context", "\n\n"), F.lit("")), "facts": F.coalesce("facts", F.expr(NO_STRINGS))})


#: Dataset name -> adapter of a raw DataFrame (that of MedAESQA also takes the abstract store, and adds context and facts itself).
ADAPTERS: dict[str, Callable[..., DataFrame]] = {
    "HotpotQA": hotpotqa, "2WikiMultiHopQA": two_wiki, "MuSiQue": musique, "MultiRC": multirc, "PopQA": popqa, "PubMedQA": pubmedqa, "Qasper": qasper, "FaithEval": faitheval, "ConFiQA": confiqa, "MedAESQA": cited_answers,
}
