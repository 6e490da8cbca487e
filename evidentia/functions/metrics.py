"""Row-level metrics of a prediction against gold answers or gold facts. Built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidentia.functions.text import let, normalize_answer, strip

#: Answers that only count as a whole.
CLOSED = ["yes", "no", "noanswer", "maybe"]


def exact_match(pred: Column, golds: Column) -> Column:
    """M1."""
    return F.coalesce((pred != "") & let(normalize_answer(pred), lambda p: F.exists(golds, lambda g: normalize_answer(g) == p)), F.lit(False))


def hit(pred: Column, golds: Column) -> Column:
    """M2: some gold's normal form is contained; an empty normal form always is."""
    return F.coalesce((pred != "") & let(normalize_answer(pred), lambda p: F.exists(golds, lambda g: p.contains(normalize_answer(g)))), F.lit(False))


def hit_answer(pred: Column, golds: Column) -> Column:
    """M3: the first gold, as written, whose normal form is contained; else null."""
    return let(normalize_answer(F.coalesce(pred, F.lit(""))), lambda p: F.get(F.filter(golds, lambda g: p.contains(normalize_answer(g))), F.lit(0)))


def words(c: Column) -> Column:
    """Tokens of a normal form; none for an empty one."""
    return F.filter(F.split(c, " "), lambda w: w != "")


def counted(tokens: Column) -> Column:
    """array<struct(t, n)> of the distinct tokens, sorted, with their counts: where a sorted array's runs begin tells their lengths."""
    def runs(s: Column) -> Column:
        begins = F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (F.get(s, i - 1) != x), i)), lambda i: i.isNotNull())
        return let(begins, lambda b: F.transform(b, lambda at, k: F.struct(F.get(s, at).alias("t"), (F.coalesce(F.get(b, k + 1), F.size(s)) - at).alias("n"))))

    return let(F.array_sort(tokens), runs)


def overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two arrays: their counts are merged by token, so work grows with n log n, not with n squared."""
    merged = F.array_sort(F.concat(counted(a), counted(b)))
    least = lambda m: F.transform(m, lambda x, i: F.when((i > 0) & (F.get(m, i - 1)["t"] == x["t"]), F.least(x["n"], F.get(m, i - 1)["n"])).otherwise(0))
    return let(merged, lambda m: F.aggregate(least(m), F.lit(0), lambda n, x: n + x))


def f1_of(common: Column, n_pred: Column, n_gold: Column) -> Column:
    """struct(f1, precision, recall) from counts; zeros without overlap."""
    p, r = F.try_divide(common, n_pred), F.try_divide(common, n_gold)
    zero = F.lit(0.0)
    some = common > 0
    return F.struct(F.when(some, 2 * p * r / (p + r)).otherwise(zero).alias("f1"), F.when(some, p).otherwise(zero).alias("precision"), F.when(some, r).otherwise(zero).alias("recall"))


def normal_f1(p: Column, g: Column) -> Column:
    """M4 on normal forms."""
    closed = (p.isin(CLOSED) | g.isin(CLOSED)) & (p != g)
    return f1_of(F.when(closed, 0).otherwise(overlap(words(p), words(g))), F.size(words(p)), F.size(words(g)))


def token_f1(pred: Column, gold: Column) -> Column:
    """M4: struct(f1, precision, recall) of normalised tokens; zeros where one side is a closed answer and they differ."""
    return normal_f1(normalize_answer(F.coalesce(pred, F.lit(""))), normalize_answer(F.coalesce(gold, F.lit(""))))


def best_normal_f1(p: Column, golds: Column) -> Column:
    """M5 on normal forms. Table operators normalise once, in a column of its own, since lambdas compute what they hold for each gold."""
    zero = F.struct(F.lit(0.0).alias("f1"), F.lit(0.0).alias("precision"), F.lit(0.0).alias("recall"))
    each = F.transform(golds, lambda g: normal_f1(p, g))
    return F.coalesce(F.aggregate(each, zero, lambda a, b: F.when(b["f1"] > a["f1"], b).otherwise(a)), zero)


def normal_golds(golds: Column) -> Column:
    return F.transform(golds, lambda g: normalize_answer(F.coalesce(g, F.lit(""))))


def best_f1(pred: Column, golds: Column) -> Column:
    """M5: the triple with the highest F1 over golds, the first on ties; zeros without golds."""
    return let(normalize_answer(F.coalesce(pred, F.lit(""))), lambda p: best_normal_f1(p, normal_golds(golds)))


def normal_answer_scores(p: Column, golds: Column, filled: Column) -> Column:
    """M6 on normal forms: struct(em, hit, f1, precision, recall); zeros where the prediction is not filled."""
    one = lambda c: F.when(F.coalesce(filled & c, F.lit(False)), 1.0).otherwise(0.0)
    best = lambda b: [F.when(filled, b[m]).otherwise(0.0).alias(m) for m in ("f1", "precision", "recall")]
    return let(best_normal_f1(p, golds), lambda b: F.struct(one(F.array_contains(golds, p)).alias("em"), one(F.exists(golds, lambda g: p.contains(g))).alias("hit"), *best(b)))


def answer_scores(pred: Column, golds: Column) -> Column:
    """M6: struct(em, hit, f1, precision, recall) of a prediction against gold answers."""
    filled = F.coalesce(pred, F.lit("")) != ""
    return let(normalize_answer(F.coalesce(pred, F.lit(""))), lambda p: let(normal_golds(golds), lambda g: normal_answer_scores(p, g, filled)))


def supporting_fact_scores(preds: Column, golds: Column) -> Column:
    """M7: struct(em, f1, precision, recall) of facts by containment, lower-cased and trimmed; zeros where either list is empty or starts blank."""
    p, g = F.transform(preds, lambda x: F.lower(strip(x))), F.transform(golds, lambda x: F.lower(strip(x)))
    usable = F.coalesce((F.size(preds) > 0) & (F.size(golds) > 0) & (strip(F.get(preds, F.lit(0))) != "") & (strip(F.get(golds, F.lit(0))) != ""), F.lit(False))
    tp = let(F.array_join(g, " "), lambda every: F.size(F.filter(p, lambda x: every.contains(x))))
    fp = F.size(p) - tp
    fn = let(F.array_join(p, " "), lambda every: F.size(F.filter(g, lambda x: ~every.contains(x))))
    prec, rec = F.try_divide(tp, tp + fp), F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * prec * rec, prec + rec), F.lit(0.0))
    zero = lambda c: F.when(usable, c).otherwise(0.0)
    return F.struct(zero(F.when(fp + fn == 0, 1.0).otherwise(0.0)).alias("em"), zero(f1).alias("f1"), zero(prec).alias("precision"), zero(rec).alias("recall"))


def joint_scores(ans_em: Column, ans: Column, sp: Column, both_parsed: Column, legacy_unpack: bool = False) -> Column:
    """M8: struct(em, f1, precision, recall) of answer and facts together; zeros unless both were parsed.

    legacy_unpack pairs answer precision with the facts' F1 and answer recall with their precision, as older reports did.
    """
    p = ans["precision"] * (sp["f1"] if legacy_unpack else sp["precision"])
    r = ans["recall"] * (sp["precision"] if legacy_unpack else sp["recall"])
    f1 = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    zero = lambda c: F.when(both_parsed, c).otherwise(0.0)
    return F.struct(zero(ans_em * sp["em"]).alias("em"), zero(f1).alias("f1"), zero(p).alias("precision"), zero(r).alias("recall"))


def open_golds(golds: Column) -> Column:
    """M9: golds whose normal form is not empty; [""] if none is left."""
    left = F.filter(golds, lambda g: normalize_answer(g) != "")
    return F.when(F.size(left) > 0, left).otherwise(F.array(F.lit("")))


def open_exact(pred: Column, golds: Column) -> Column:
    """M9: 1.0 where the normal forms are equal, an empty one included."""
    same = let(normalize_answer(pred), lambda p: F.exists(open_golds(golds), lambda g: normalize_answer(g) == p))
    return F.when(same, 1.0).otherwise(0.0)


def open_f1(pred: Column, golds: Column) -> Column:
    """M9: best token F1; where a side has no tokens, 1 if neither has, else 0."""
    def one(a: Column, b: Column) -> Column:
        empty = (F.size(a) == 0) | (F.size(b) == 0)
        return F.when(empty, (F.size(a) == F.size(b)).cast("double")).otherwise(f1_of(overlap(a, b), F.size(a), F.size(b))["f1"])

    each = lambda a: F.transform(open_golds(golds), lambda g: let(words(normalize_answer(g)), lambda b: one(a, b)))
    return F.array_max(let(words(normalize_answer(pred)), each))


def strict_copy(pred: Column, gold: Column, spans: Column, context: Column) -> Column:
    """1 where the answer is part of the gold one and every evidence span, at least one, is verbatim in the context."""
    inside = F.lower(strip(gold)).contains(F.lower(strip(pred)))
    return F.when(F.coalesce(inside & (F.size(spans) > 0) & F.forall(spans, lambda s: context.contains(strip(s))), F.lit(False)), 1).otherwise(0)


def row_lengths(answer: Column, golds: Column, facts: Column, predict: Column) -> Column:
    """Lengths and parse flags."""
    mean = F.coalesce(F.try_divide(F.aggregate(golds, F.lit(0), lambda n, g: n + F.length(g)), F.size(golds)), F.lit(0.0))
    return F.struct(
        F.coalesce(F.length(answer), F.lit(0)).alias("answer_len"), mean.alias("gold_answer_len"), F.coalesce(F.aggregate(facts, F.lit(0), lambda n, s: n + F.length(s)), F.lit(0)).alias("facts_len"),
        F.coalesce(F.length(predict), F.lit(0)).alias("predict_len"), answer.isNotNull().alias("answer_parsed"), (F.coalesce(F.size(facts), F.lit(0)) >= 1).alias("facts_parsed"),
    )


def failed(predict: Column) -> Column:
    """Null, or an error message in place of an answer."""
    return predict.isNull() | F.startswith(predict, F.lit("ERROR:"))
