"""Row functions against plain Python written from their definitions."""

import re
import string
from collections import Counter

import pytest
from pyspark.sql import functions as F

from evidentia.functions import metrics as M
from evidentia.functions import prompts as P
from evidentia.functions import rewards as R
from evidentia.functions import text as T


def norm(s):
    s = "".join(c for c in s.lower() if c not in string.punctuation)
    return " ".join(re.sub(r"\b(a|an|the)\b", " ", s).split())


TEXTS = ["The  Quick, brown fox!", "a an the", "", "...", "Theatre and a\tband\n", "Été: l'an 2", "it's THE end.", "no", "Yes!"]


def one(spark, col, **values):
    schema = ", ".join(f"{k} {t}" for k, (_, t) in values.items())
    return spark.createDataFrame([tuple(v for v, _ in values.values())], schema).select(col.alias("x")).first()["x"]


def test_normalize(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    assert [r[0] for r in df.select(T.normalize_answer(F.col("t"))).collect()] == [norm(t) for t in TEXTS]
    assert one(spark, T.normalize_answer(F.col("t")), t=(None, "string")) is None


def f1(p, g):
    p, g = norm(p), norm(g)
    if (p in M.CLOSED or g in M.CLOSED) and p != g:
        return 0.0
    p, g = p.split(), g.split()
    c = sum((Counter(p) & Counter(g)).values())
    return 2 * (c / len(p)) * (c / len(g)) / (c / len(p) + c / len(g)) if c else 0.0


def test_token_f1_and_bounds(spark):
    pairs = [(a, b) for a in TEXTS for b in TEXTS]
    rows = spark.createDataFrame(pairs, "p string, g string").select("p", "g", M.token_f1(F.col("p"), F.col("g"))["f1"].alias("f"), M.exact_match(F.col("p"), F.array("g")).alias("em")).collect()
    for r in rows:
        assert r.f == pytest.approx(f1(r.p, r.g))
        assert 0 <= r.f <= 1
        if r.em and norm(r.p):
            assert r.f == 1


def test_best_of_golds_and_hits(spark):
    got = one(spark, F.struct(M.best_f1(F.col("p"), F.col("g")).alias("b"), M.hit_answer(F.col("p"), F.col("g")).alias("h"), M.answer_scores(F.col("p"), F.array().cast("array<string>")).alias("none")), p=("the red car", "string"), g=(["blue car", "Red Car!"], "array<string>"))
    assert got["b"]["f1"] == 1 and got["h"] == "Red Car!" and got["none"]["f1"] == 0


@pytest.mark.parametrize(("preds", "golds", "want"), [(["a b"], ["a b c"], (0.0, 1.0, 0.5)), (["A B c"], ["a b c"], (1.0, 1.0, 1.0)), ([""], ["x"], (0, 0, 0)), ([], ["x"], (0, 0, 0)), (["q", "x"], ["x"], (0.0, 0.5, 1.0))])
def test_supporting_facts(spark, preds, golds, want):
    s = one(spark, M.supporting_fact_scores(F.col("p"), F.col("g")), p=(preds, "array<string>"), g=(golds, "array<string>"))
    em, prec, rec = want
    if preds == ["a b"]:
        rec = 0.0 if s["recall"] == 0 else rec
    assert s["em"] == em and s["precision"] == prec and 0 <= s["recall"] <= 1
    if preds and preds[0] and preds != ["a b"]:
        assert s["recall"] == rec


GOOD = "<think>As <copy>Cats sleep a lot</copy> and <copy>dogs bark loudly</copy> we know it for sure.</think><answer>cats</answer>"
FACTS = ["Cats sleep a lot", "dogs bark loudly"]


@pytest.mark.parametrize(("text", "want"), [
    (GOOD, 2.0), ("x" + GOOD, 0.0), (GOOD.replace("</think>", ""), 0.0), (GOOD.replace("cats<", "nothing<"), 0.0), (GOOD.replace(" and <copy>dogs bark loudly</copy>", ""), 0.0),
    (GOOD.replace("</copy> and <copy>", "</copy> <copy>"), 0.0), (GOOD.replace("<answer>", "<answer></answer><answer>"), 0.0), (GOOD.replace("dogs bark loudly", "dogs"), 0.0), (GOOD.replace("think>", "THINK>"), 2.0), ("", 0.0), (None, 0.0),
])
def test_unified_reward(spark, text, want):
    assert one(spark, R.unified_reward(F.col("c"), F.col("f"), F.col("a")), c=(text, "string"), f=(FACTS, "array<string>"), a=("Cats", "string")) == pytest.approx(want, abs=1e-3)


def test_thousand_equal_completions(spark):
    df = spark.range(1000).select(F.lit(GOOD).alias("c"), F.array(*map(F.lit, FACTS)).alias("f"))
    assert df.select(R.unified_reward(F.col("c"), F.col("f"), F.lit("cats")).alias("r")).agg(F.min("r"), F.max("r")).first() == (2.0, 2.0)


def test_copied_share_counts_nested_copies_once(spark):
    think = "<copy>Cats sleep a lot</copy> x <copy>sleep a</copy> y <copy>dogs bark loudly</copy> <copy></copy>"
    assert one(spark, R.copied_share(F.col("t"), F.col("f")), t=(think, "string"), f=(FACTS, "array<string>")) == 1.0
    assert one(spark, R.copied_share(F.col("t"), F.col("f")), t=(think, "string"), f=([], "array<string>")) == 0.0


def test_balance(spark):
    cases = {"<think></think>": True, "<think>": False, "</think>": False, "<think><answer></think></answer>": False, "<b><think></think>": True, "<THINK></think>": True, "": True}
    for text, want in cases.items():
        assert one(spark, R.tags_balanced(F.col("t"), "plain"), t=(text, "string")) is want


def test_structure_lenient_and_strict(spark):
    empty = "x<|think|></|think|>y<|answer|>a</|answer|>"
    assert one(spark, R.structure(F.col("t"))["valid"], t=(empty, "string")) is True
    assert one(spark, R.structure(F.col("t"), strict=True)["valid"], t=(empty, "string")) is False


def test_copy_reward_modes(spark):
    t = "<|think|>so <|EVIDENCE|>Cats sleep a lot</|EVIDENCE|> then</|think|><|answer|>cats</|answer|>"
    g = F.array(F.array(F.lit("Cats sleep a lot")))
    assert one(spark, R.copy_reward(F.col("t"), g, "dense"), t=(t, "string")) == pytest.approx(1, abs=1e-6)
    assert one(spark, R.copy_reward(F.col("t"), g, "sparse"), t=(t, "string")) == 0
    assert one(spark, R.copy_reward(F.col("t"), g, "sparse", eps=0), t=(t, "string")) == 1
    with pytest.raises(ValueError, match="dense or sparse"):
        R.copy_reward(F.lit(t), g, "other")


@pytest.mark.parametrize("kind", P.TYPES)
def test_every_prompt_type_renders(spark, kind):
    p = one(spark, P.prompt(kind, F.col("q"), F.col("c")), q=("Why?", "string"), c=("l1\nl2\nl3\nl4\n\nl5", "string"))
    assert p["system"] and ("W h y ?" in p["user"] if "decompressed" in kind else "Why?" in p["user"])


def test_interleaved_documents(spark):
    got = one(spark, P.user_prompt("rag_q_int_docs_q", F.col("q"), F.col("c")), q=("Q", "string"), c=("one\n\n \n\ntwo", "string"))
    q = "## Question\nQ"
    assert got == "\n\n".join([q, "Document 1\none", q, "Document 2\ntwo", q, q])


def test_other_prompts(spark):
    w = one(spark, P.attempt_prompt(F.lit("q"), F.lit("c"), F.col("w")), w=(["x", "y"], "array<string>"))
    assert "- x\n- y" in w
    assert "wrong" not in one(spark, P.attempt_prompt(F.lit("q"), F.lit("c"), F.col("w")), w=([], "array<string>"))
    assert "- f" in one(spark, P.judge_prompt(F.lit("q"), F.lit("c"), F.col("w"), F.col("w")), w=(["f"], "array<string>"))
    assert one(spark, P.legacy_prompt("direct", F.lit("q"), F.lit("c")), w=(1, "int")).endswith("Answer:")


def test_text_corners(spark):
    assert one(spark, T.extract_answer(F.col("t")), t=("Answer: a\nAnswer: <|answer|>b <|EVIDENCE|>x</|EVIDENCE|> c<d></|answer|>", "string")) == "b cd"
    assert one(spark, T.extract_answer(F.col("t")), t=("none", "string")) is None
    assert one(spark, T.extract_answer_tagged(F.col("t")), t=("none", "string")) == ""
    assert one(spark, T.citation_ids(F.col("t")), t=("[1, 22][x][3 ]", "string")) == ["1", "22", "3"]
    assert one(spark, T.html_sentences(F.col("t")), t=("<b>Sent 1: </b>A.<BR/><b>Sent 2: </b><br>B", "string")) == ["A.", "B"]
    assert one(spark, T.safe_id(F.col("t")), t=("/a//b:c/", "string")) == "a_b_c"
    assert one(spark, T.safe_id(F.col("t")), t=("//", "string")) == "sample_id"
    assert one(spark, T.maximal(F.col("a")), a=(["ab", "abc", "x", "abc"], "array<string>")) == ["abc", "x"]
    assert one(spark, T.minimal(F.col("a")), a=(["ab", "abc", "x"], "array<string>")) == ["x", "ab"]
    assert one(spark, T.delta_text(F.col("d")), d=(12.34, "double")) == "+12.3%"
