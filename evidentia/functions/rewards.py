"""Reward functions of a completion against a solution, as columns; REWARDS is the registry to plug further ones into."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidentia.functions.metrics import best_f1, exact_match, hit_answer, supporting_fact_scores
from evidentia.functions.text import clean_text, let, normalize_answer, strip

#: Tag styles: the tags whose balance is checked, and patterns of think, answer and evidence with their content as group 1.
STYLES = {
    "pipe": {"tags": ["think", "answer", "evidence"], "think": r"(?is)<\|think\|>(.*?)</\|think\|>", "answer": r"(?is)<\|answer\|>(.*?)</\|answer\|>", "span": r"(?s)<\|EVIDENCE\|>(.*?)</\|EVIDENCE\|>", "touch": r"</\|EVIDENCE\|>\s*<\|EVIDENCE\|>"},
    "plain": {"tags": ["think", "answer", "copy"], "think": r"(?is)<think>(.*?)</think>", "answer": r"(?is)<answer>(.*?)</answer>", "span": r"(?s)<copy>(.*?)</copy>", "touch": r"</copy>\s*<copy>"},
}
EPS = 1e-9


def tags_balanced(text: Column, style: str = "pipe") -> Column:
    """Every closing tag closes the last open one and none stays open; only the style's tags in plain brackets count."""
    found = F.filter(F.regexp_extract_all(text, F.lit(r"<(/?\w+)>"), 1), lambda t: F.lower(F.regexp_replace(t, "/", "")).isin(STYLES[style]["tags"]))
    bad = F.array(F.lit("!"))
    step = lambda stack, t: (
        F.when(F.get(stack, F.lit(0)) == "!", stack)
        .when(~F.startswith(t, F.lit("/")), F.concat(F.array(F.lower(t)), stack))
        .when(F.get(stack, F.lit(0)) == F.lower(F.substring(t, 2, 1 << 20)), F.slice(stack, 2, F.size(stack)))
        .otherwise(bad)
    )
    return F.coalesce(F.size(F.aggregate(found, F.array().cast("array<string>"), step)) == 0, F.lit(False))


def structure(text: Column, style: str = "pipe", strict: bool = False) -> Column:
    """struct(valid, think, answer). Contents where each tag pair occurs exactly once.

    Lenient: also valid where one of the contents is empty. Strict: nulls for both contents where not valid.
    """
    s = STYLES[style]
    one = lambda p: F.size(F.regexp_extract_all(text, F.lit(p), F.lit(0))) == 1
    whole = lambda p: F.regexp_extract(text, p, 0)
    think, answer = F.when(one(s["think"]), F.regexp_extract(text, s["think"], 1)), F.when(one(s["answer"]), F.regexp_extract(text, s["answer"], 1))
    a, b, n = whole(s["think"]), whole(s["answer"]), F.length(text)
    middle = F.substring(text, F.length(a) + 1, n - F.length(a) - F.length(b))
    placed = F.startswith(text, a) & F.endswith(text, b) & (F.length(b) < n) & ((F.length(a) + F.length(b) >= n) | (strip(middle) == ""))
    both = one(s["think"]) & one(s["answer"])
    valid = F.coalesce(both & (placed if strict else (think == "") | (answer == "") | placed), F.lit(False))
    if strict:
        think, answer = F.when(valid, think), F.when(valid, answer)
    return F.struct(valid.alias("valid"), think.alias("think"), answer.alias("answer"))


def spans(think: Column, style: str = "pipe") -> Column:
    return F.regexp_extract_all(think, F.lit(STYLES[style]["span"]), F.lit(1))


def evidence_ok(think: Column, at_least: Column | int = 1, style: str = "pipe") -> Column:
    """Enough spans, none blank, and text between neighbours."""
    own = spans(think, style)
    least = F.lit(at_least) if isinstance(at_least, int) else at_least
    return F.coalesce((F.size(own) >= least) & ~F.exists(own, lambda x: strip(x) == "") & ~think.rlike(STYLES[style]["touch"]), F.lit(False))


def predicted_facts(think: Column, style: str = "pipe") -> Column:
    """Trimmed spans that are not empty."""
    return F.coalesce(F.filter(F.transform(spans(think, style), strip), lambda x: x != ""), F.array().cast("array<string>"))


def format_reward(text: Column, style: str = "pipe") -> Column:
    """R6."""
    s = structure(text, style)
    parts = F.when(s["valid"], 0.5).otherwise(0.0) + F.when(F.coalesce(s["think"], F.lit("")) != "", 0.25).otherwise(0.0) + F.when(F.coalesce(s["answer"], F.lit("")) != "", 0.25).otherwise(0.0)
    return F.when(tags_balanced(text, style), parts).otherwise(0.0)


def length_reward(text: Column, style: str = "pipe") -> Column:
    """R7."""
    s = structure(text, style)
    think = F.coalesce(s["think"], F.lit(""))
    facts = F.aggregate(predicted_facts(think, style), F.lit(0), lambda n, x: n + F.length(x))
    longer = s["valid"] & (F.length(think) > F.length(F.coalesce(s["answer"], F.lit(""))))
    return F.when(longer, 0.6).otherwise(0.0) + F.when((think != "") & (F.length(think) > 2 * facts), 0.4).otherwise(0.0)


def copy_hits(preds: Column, golds: Column) -> Column:
    """Distinct gold facts (arrays of sentences) that are the first to contain a predicted fact at least as long as their shortest sentence."""
    joined = F.transform(golds, lambda g: normalize_answer(F.array_join(g, " ")))
    short = F.transform(golds, lambda g: F.array_min(F.transform(g, F.length)))

    def distinct_hits(every: Column, least: Column) -> Column:
        # As with answers, the gold's normal form is looked for in the prediction's, and the first one found counts.
        first = lambda p: let(normalize_answer(p), lambda n: F.array_position(F.transform(every, lambda g: n.contains(g)), True))
        hits = F.transform(preds, lambda p: F.struct(first(p).cast("int").alias("k"), F.length(p).alias("n")))
        good = F.filter(hits, lambda h: (h["k"] > 0) & (h["n"] >= F.coalesce(F.get(least, h["k"] - 1), F.lit(0))))
        return F.size(F.array_distinct(F.transform(good, lambda h: h["k"])))

    return let(joined, lambda every: let(short, lambda least: distinct_hits(every, least)))


def copy_f1(preds: Column, golds: Column, eps: float = EPS) -> Column:
    h = copy_hits(preds, golds)
    p, r = h / (F.size(preds) + F.lit(eps)), h / (F.size(golds) + F.lit(eps))
    return F.when((F.size(preds) > 0) & (F.size(golds) > 0), 2 * p * r / (p + r + F.lit(eps))).otherwise(0.0) if eps else F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))


def copy_reward(text: Column, golds: Column, mode: str, style: str = "pipe", eps: float = EPS) -> Column:
    """Mode dense or sparse. With the default eps an F1 of exactly 1 does not occur, as in the published formula; eps=0 lets it."""
    if mode not in ("dense", "sparse"):
        raise ValueError("mode is dense or sparse")
    s = structure(text, style)
    f1 = copy_f1(predicted_facts(s["think"], style), golds, eps)
    ok = s["valid"] & evidence_ok(s["think"], F.size(golds) if mode == "sparse" else 1, style)
    value = F.when(f1 == 1.0, 1.0).otherwise(0.0) if mode == "sparse" else F.when(f1 == 1.0, 1.5 * f1).otherwise(f1)
    return F.when(ok, value).otherwise(0.0)


def copy_format_reward(text: Column, style: str = "pipe") -> Column:
    """R10."""
    s = structure(text, style)
    return F.when(s["valid"] & evidence_ok(s["think"], 1, style), 1.0).otherwise(0.0)


def answer_f1(answer: Column, golds: Column, both_empty: float = 0.0) -> Column:
    """F1 of M5; both_empty counts where neither the answer nor some gold has a token: 0 as in M4, or 1 as in M9."""
    f1 = best_f1(answer, golds)["f1"]
    if not both_empty:
        return f1
    blank = lambda c: normalize_answer(F.coalesce(c, F.lit(""))) == ""
    return F.when(F.coalesce(blank(answer) & F.exists(golds, blank), F.lit(False)), F.greatest(f1, F.lit(both_empty))).otherwise(f1)


def answer_f1_reward(text: Column, answers: Column, style: str = "pipe", both_empty: float = 0.0) -> Column:
    """R11."""
    s = structure(text, style)
    return F.when(s["valid"], answer_f1(s["answer"], answers, both_empty)).otherwise(0.0)


def answer_em_reward(text: Column, answers: Column, style: str = "pipe") -> Column:
    """R12."""
    s = structure(text, style)
    return F.when(s["valid"] & exact_match(s["answer"], answers), 1.0).otherwise(0.0)


def answer_hit_reward(text: Column, answers: Column, style: str = "pipe") -> Column:
    """Length of the first gold found over that of the answer; 0 where the answer is empty."""
    s = structure(text, style)
    return F.when(s["valid"], F.coalesce(F.try_divide(F.length(hit_answer(s["answer"], answers)), F.length(s["answer"])), F.lit(0.0))).otherwise(0.0)


def combined_reward(text: Column, answers: Column, golds: Column, style: str = "pipe", answer_weight: float = 1.0, copy_weight: float = 0.5, both_empty: float = 0.0) -> Column:
    """Weighted answer F1 and copy F1, whether or not the structure is valid."""
    s = structure(text, style)
    facts = predicted_facts(s["think"], style)
    answer = F.when(F.coalesce(s["answer"], F.lit("")) != "", answer_f1(s["answer"], answers, both_empty)).otherwise(0.0)
    copied = F.when((F.coalesce(s["think"], F.lit("")) != "") & (F.size(facts) > 0), copy_f1(facts, golds)).otherwise(0.0)
    return answer_weight * answer + copy_weight * copied


def curriculum_reward(text: Column, answers: Column, golds: Column, phase: str, style: str = "pipe", both_empty: float = 0.0) -> Column:
    """As R14; the copy part counts only after the answer_only phase."""
    return combined_reward(text, answers, golds, style, copy_weight=0.0 if phase == "answer_only" else 0.5, both_empty=both_empty)


def blended_copy_reward(text: Column, golds: Column, context: Column, style: str = "pipe", context_share: float = 0.05) -> Column:
    """Recall of gold facts, with a small share of F1 against the context taken as single characters (0 turns that off)."""
    s = structure(text, style)
    facts = predicted_facts(s["think"], style)
    x = supporting_fact_scores(facts, F.transform(golds, lambda g: F.array_join(g, " ")))["recall"]
    y = supporting_fact_scores(facts, F.split(context, ""))["f1"] if context_share else F.lit(0.0)
    return F.when(s["valid"] & evidence_ok(s["think"], 1, style), (1 - context_share) * x + context_share * y).otherwise(0.0)


def fact_sentences(title: Column, sents: Column, fact_title: Column, fact_sent: Column) -> Column:
    """Sentences that supporting facts point to; the first of equal titles; unknown titles and numbers out of range are skipped."""
    found = F.transform(F.arrays_zip(fact_title.alias("t"), fact_sent.alias("k")), lambda f: F.get(F.get(sents, F.nullif(F.array_position(title, f["t"]), F.lit(0)).cast("int") - 1), f["k"]))
    return F.filter(found, lambda s: s.isNotNull())


def copied_share(think: Column, facts: Column) -> Column:
    """1/#facts for each copy, longest first, that is part of a fact and not of a copy counted before."""
    own = F.transform(F.array_sort(F.transform(spans(think, "plain"), lambda x, k: F.struct((-F.length(x)).alias("n"), k.alias("k"), x.alias("x")))), lambda s: strip(s["x"]))
    step = lambda used, x: F.when((x != "") & F.exists(facts, lambda f: f.contains(x)) & ~F.exists(used, lambda u: u.contains(x)), F.concat(used, F.array(x))).otherwise(used)
    n = F.size(F.aggregate(own, F.array().cast("array<string>"), step))
    return F.coalesce(F.try_divide(n, F.size(facts)), F.lit(0.0))


def contains_answer(text: Column, gold: Column) -> Column:
    """The cleaned gold answer, not empty, is part of the cleaned answer."""
    got, gold = clean_text(F.regexp_extract(text, STYLES["plain"]["answer"], 1)), clean_text(gold)
    return F.when((gold != "") & got.contains(gold), 1.0).otherwise(0.0)


def answer_length_ok(answer: Column, gold: Column, times: int = 6) -> Column:
    a, g = strip(answer), strip(gold)
    return (a != "") & (g != "") & (F.length(a) <= times * F.length(g))


def unified_reward(text: Column, facts: Column, gold: Column) -> Column:
    """All gates, then copied share plus answer, 0 if either is 0, at most 2."""
    s = structure(text, "plain", strict=True)
    think, answer, copies = s["think"], s["answer"], F.transform(spans(s["think"], "plain"), strip)
    lengths = F.transform(facts, F.length)
    mean = F.try_divide(F.aggregate(lengths, F.lit(0), lambda n, x: n + x), F.size(facts))
    gates = [
        tags_balanced(text, "plain"), s["valid"], think != "", answer != "", evidence_ok(think, 2, "plain"), answer_length_ok(answer, gold), F.length(think) > F.length(answer), F.size(facts) > 0,
        F.length(think) > mean, F.exists(copies, lambda x: (x != "") & F.exists(facts, lambda f: f.contains(x))), F.forall(copies, lambda x: F.length(x) >= F.least(mean / 2, F.array_min(lengths))),
    ]
    c, a = copied_share(think, facts), contains_answer(text, gold)
    return F.when(F.coalesce(reduce(lambda x, y: x & y, gates), F.lit(False)) & (c > 0) & (a > 0), F.least(c + a, F.lit(2.0))).otherwise(0.0)


def answer_only_reward(text: Column, gold: Column) -> Column:
    """R21."""
    s = structure(text, "plain", strict=True)
    gates = tags_balanced(text, "plain") & s["valid"] & answer_length_ok(s["answer"], gold) & (F.length(s["think"]) > F.length(s["answer"]))
    return F.when(F.coalesce(gates, F.lit(False)), contains_answer(text, gold)).otherwise(0.0)


#: Name -> function of columns (completion, answers, golds) to a reward.
REWARDS: dict[str, Callable[[Column, Column, Column], Column]] = {
    "format": lambda text, answers, golds: format_reward(text),
    "length": lambda text, answers, golds: length_reward(text),
    "dense_copy": lambda text, answers, golds: copy_reward(text, golds, "dense"),
    "sparse_copy": lambda text, answers, golds: copy_reward(text, golds, "sparse"),
    "copy_format": lambda text, answers, golds: copy_format_reward(text),
    "answer_f1": lambda text, answers, golds: answer_f1_reward(text, answers),
    "answer_em": lambda text, answers, golds: answer_em_reward(text, answers),
    "answer_hit": lambda text, answers, golds: answer_hit_reward(text, answers),
    "combined": lambda text, answers, golds: combined_reward(text, answers, golds),
}


def weighted_reward(weights: dict[str, float], text: Column, answers: Column, golds: Column, rewards: dict[str, Callable[[Column, Column, Column], Column]] = REWARDS) -> Column:
    """The weighted sum of registered rewards."""
    return reduce(lambda x, y: x + y, (F.lit(float(w)) * rewards[name](text, answers, golds) for name, w in weights.items()), F.lit(0.0))
