"""Prompt rendering (T12): each variant is a pure expression of question and context; the layout is fixed, the wording is our own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidentia.functions.text import strip

RULE = "\n\n" + "=" * 50 + "\n\n"

_GROUNDED = "Answer the question from the context. Write one line that starts with 'Answer:'."
SYSTEM: dict[str, str] = {
    "direct_inference": "Answer the question. Write one line that starts with 'Answer:'.",
    "cot": "Think step by step, then write one line that starts with 'Answer:'.",
    "ircot": "Reason over the context one step at a time, then write one line that starts with 'Answer:'.",
    "deepseek": "Reason between <|think|> and </|think|>, quote evidence between <|EVIDENCE|> and </|EVIDENCE|>, answer between <|answer|> and </|answer|>.",
    "copy_evidence": "Reason between <|think|> and </|think|>, copying each supporting sentence word for word between <|EVIDENCE|> and </|EVIDENCE|>; answer between <|answer|> and </|answer|>.",
    "find_facts": "List the sentences of the context that support the answer, each between <|EVIDENCE|> and </|EVIDENCE|>.",
}
RAG_TYPES = ["rag", "rag_rep_2", "rag_rep_q", "rag_qcq", "rag_qcq2", "rag_q_int_q", "rag_q_int2_q", "rag_q_int_docs_q", "rag_decompressed", "rag_decompressed_rep_q"]
SYSTEM |= dict.fromkeys(RAG_TYPES, _GROUNDED)
TYPES = list(SYSTEM)


def _q(question: Column) -> Column:
    return F.concat(F.lit("## Question\n"), question)


def _c(context: Column) -> Column:
    return F.concat(F.lit("## Context\n"), context)


def _block(question: Column, context: Column) -> Column:
    return F.concat_ws("\n\n", _c(context), _q(question))


def _lines(context: Column) -> list[Column]:
    """The context's lines cut at n // 4 and 3n // 4."""
    lines = F.split(context, "\n")
    n = F.size(lines)
    one, two = F.floor(n / 4).cast("int"), F.floor(3 * n / 4).cast("int")
    return [F.array_join(F.slice(lines, start + 1, end - start), "\n") for start, end in ((F.lit(0), one), (one, two), (two, n))]


def _spaced(question: Column) -> Column:
    return F.array_join(F.filter(F.split(question, ""), lambda c: c != ""), " ")


def user_prompt(kind: str, question: Column, context: Column) -> Column:
    q, c = _q(question), _c(context)
    join = lambda *parts: F.concat_ws("\n\n", *parts)
    if kind in ("direct_inference", "cot"):
        return question
    if kind == "rag_rep_2":
        return F.concat(_block(question, context), F.lit(RULE), _block(question, context))
    if kind == "rag_rep_q":
        return F.concat(_block(question, context), F.lit(RULE), q)
    if kind == "rag_qcq":
        return join(q, c, q)
    if kind == "rag_qcq2":
        return join(q, c, q, q)
    if kind in ("rag_q_int_q", "rag_q_int2_q"):
        a, b, d = (_c(x) for x in _lines(context))
        return join(q, a, q, b, d, q, *([q] if kind == "rag_q_int2_q" else []))
    if kind == "rag_q_int_docs_q":
        docs = F.filter(F.transform(F.split(context, "\n\n"), strip), lambda d: d != "")
        parts = F.transform(docs, lambda d, k: F.concat(F.lit("Document "), (k + 1).cast("string"), F.lit("\n"), d, F.lit("\n\n"), q))
        return F.concat_ws("\n\n", q, parts, q)
    if kind == "rag_decompressed":
        return _block(_spaced(question), context)
    if kind == "rag_decompressed_rep_q":
        return join(c, _q(_spaced(question)), _q(_spaced(question)))
    if kind in SYSTEM:
        return _block(question, context)
    raise ValueError(f"unknown prompt type {kind}")


def prompt(kind: str, question: Column, context: Column) -> Column:
    """struct(system, user)."""
    return F.struct(F.lit(SYSTEM[kind]).alias("system"), user_prompt(kind, question, context).alias("user"))


def attempt_prompt(question: Column, context: Column, wrong: Column | None = None) -> Column:
    """The pass@K prompt; with earlier wrong answers it lists them as hints to avoid."""
    base = _block(question, context)
    if wrong is None:
        return base
    hints = F.array_join(F.transform(wrong, lambda w: F.concat(F.lit("- "), w)), "\n")
    return F.when(F.coalesce(F.size(wrong), F.lit(0)) > 0, F.concat(base, F.lit("\n\n## Answers known to be wrong\n"), hints)).otherwise(base)


def judge_prompt(question: Column, context: Column, facts: Column, answers: Column) -> Column:
    """Asks whether a sample is reasonable; the verdict is yes or no."""
    listed = lambda a: F.array_join(F.transform(a, lambda x: F.concat(F.lit("- "), x)), "\n")
    return F.concat_ws("\n\n", _c(context), _q(question), F.concat(F.lit("## Facts\n"), listed(facts)), F.concat(F.lit("## Answers\n"), listed(answers)), F.lit("Do the facts support the answers? Reply yes or no."))


def legacy_prompt(kind: str, question: Column, context: Column) -> Column:
    """The older layouts direct, reasoning, reasoning_with_evidence and reasoning_with_evidence_old: question after context, one line each."""
    ask = {"direct": "Answer:", "reasoning": "Reason, then answer.", "reasoning_with_evidence": "Reason with copied evidence, then answer.", "reasoning_with_evidence_old": "Reason with copied evidence, then answer between tags."}[kind]
    return F.concat(F.lit("Context: "), context, F.lit("\nQuestion: "), question, F.lit("\n" + ask))
