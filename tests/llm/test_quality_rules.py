"""The quality cascade: counts against a plain version, the order of rules, edge rows, a plan without Python."""

import random

from pyspark.sql import functions as F

from evidentia.llm import quality_rules as q

DOCS = "doc_id long, text string, words string, _n_words int"


def plain(text):
    text = text or ""
    for c in "\t\n\x0b\f\r":
        spaced = text.replace(c, " ") if c == "\t" else spaced.replace(c, " ")
    words = [w for w in spaced.split(" ") if w]
    lines = [x for x in text.split("\n") if any(c not in " \t\n\x0b\f\r" for c in x)]
    runs = {}
    for i in range(len(words) - 4):
        runs.setdefault(tuple(words[i : i + 5]), []).append(i)
    spots = {p + k for at in runs.values() if len(at) > 1 for p in at for k in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(spots)


def rows():
    r = random.Random(3)
    out = [None, "", " \t\n ", "a", "one two\x0bthree\ffour\rfive six", "\xa0x y \x1cz", "the " * 40, "a b c d e f " * 3, "\U0001f600 #|# " * 7, "x\n\nx\n \nx\r\ny", "a b c d e a b c d e a b c d", "word " * 60000]
    out += [" ".join(r.choice("abc") for _ in range(r.randrange(60))) for _ in range(60)]
    out += ["".join(r.choice("ab \n\t#!") for _ in range(r.randrange(120))) for _ in range(60)]
    return out


def test_counts(spark):
    texts = rows()
    docs = spark.createDataFrame([(k, t, "clash", 1) for k, t in enumerate(texts)], DOCS)
    out = q.judge(docs)
    assert "Python" not in out._jdf.queryExecution().toString()
    got = {r.doc_id: tuple(r)[1:] for r in out.collect()}
    for k, text in enumerate(texts):
        n, chars, symbols, lines, repeats = want = plain(text)
        assert got[k][:5] == want, text and text[:80]
        failed = n < 10 or 100 * repeats > 20 * n
        assert got[k][5] == failed and not (failed and got[k][6])


def test_rules_reject_what_they_name(spark):
    good = "It was a fine day in the town, and nobody had any reason to stay at home.\nThey went down to the water with bread and wine."
    bad = {
        "symbols": "It *** was ### a $$$ fine %%% day &&& in the old town again", "word_length": "a b c d e f g h i j k l m n o p", "repeated_lines": "one\n" * 9 + " ".join(f"w{k}ord" for k in range(90)), "capitals": "IT WAS A FINE DAY IN THE OLD TOWN AND NOBODY WENT home",
        "exclamations": "it! was! a! fine! day! in the old town and nobody went", "few_letters": "100 200 300 400 500 600 700 800 900 1000 1100 and more", "bullets": "\n".join(f"- item {k} of a list" for k in range(9)), "ellipses": "\n".join(f"and then number {k} came..." for k in range(9)), "placeholder": good + " Lorem ipsum dolor.",
    }
    texts = [("good", good), *bad.items()]
    df, f = q.with_fields(spark.createDataFrame([(k, t, "", 0) for k, (_, t) in enumerate(texts)], "id long, text string, digest string, score int"), "text")
    hit = {r.id: r for r in df.select("id", *(rule.rejects(f).alias(rule.name) for rule in q.RULES)).collect()}
    for k, (name, _) in enumerate(texts):
        assert name == "good" or hit[k][name], name
    assert not any(hit[0][r.name] for r in q.RULES)
    kept = {r.doc_id for r in q.judge(spark.createDataFrame([(k, t, "", 0) for k, (_, t) in enumerate(texts)], DOCS)).where("kept").collect()}
    assert kept == {0}


def test_order_is_by_rejections_per_cost_and_changes_no_verdict(spark):
    found = [q.Estimate("a", 1.0, 0.1), q.Estimate("b", 0.1, 0.05), q.Estimate("c", 0.2, 0.0), q.Estimate("d", 0.1, 0.0)]
    rules = [q.Rule(x, lambda f: F.lit(False), "false") for x in "abcd"]
    assert [r.name for r in q.ordered(rules, found)] == ["b", "a", "d", "c"]
    docs = spark.createDataFrame([(k, t, "clash", 1) for k, t in enumerate(rows())], DOCS)
    assert {e.name for e in q.estimates(docs, q.RULES, sample_rows=20)} == {r.name for r in q.RULES}
    kept = sorted(r.doc_id for r in q.keep_good(docs).collect())
    assert kept == sorted(r.doc_id for r in q.judge(docs).where("kept").collect()) == sorted(r.doc_id for r in q.keep_good(docs, rules=[*q.RULES, *q.BASE]).collect())
    assert q.keep_good(docs).columns == docs.columns


def test_later_rules_are_not_evaluated_for_rejected_rows(spark):
    """A rule that would raise an error is never reached by a row that an earlier one rejects."""
    boom = q.Rule("boom", lambda f: F.raise_error(F.lit("evaluated")).cast("boolean"), "")
    first = q.Rule("first", lambda f: f["n_words"] >= 0, "")
    df, f = q.with_fields(spark.createDataFrame([(1, "some text", "", 0)], "id long, text string, digest string, score int"), "text")
    assert df.select(q.first_failed([first, boom], f)).first()[0] == "first"


def test_empty_and_repeated_rows(spark):
    assert q.judge(spark.createDataFrame([], DOCS)).count() == 0 and q.keep_good(spark.createDataFrame([], DOCS)).count() == 0
    out = q.judge(spark.createDataFrame([(None, "x", "", 0), (None, "x", "", 0), (2**60 + 1, None, None, None)], DOCS)).collect()
    assert [r.doc_id for r in out].count(None) == 2 and all(r.base_failed and not r.kept for r in out)
