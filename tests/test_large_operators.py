"""Operators with an index, state or commits of their own: block-max search, containment over a table, attempts on the stream, resumed prediction."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from evidentia.functions import metrics
from evidentia.functions.stem import english_stem, plural_stem
from evidentia.operators import attempts as A
from evidentia.operators import containment, plugins, retrieval
from evidentia.streaming import attempts as streams

# Search -----------------------------------------------------------------------------------------------------------------


def corpus(spark, n=3000, seed=1):
    """Every document has the frequent word; twelve have the rare one."""
    r = random.Random(seed)
    vocabulary = [f"w{k:03d}" for k in range(300)]
    texts = [" ".join(["common"] * r.randrange(1, 4) + [r.choice(vocabulary) for _ in range(r.randrange(5, 60))] + ["rareword"] * (k % 250 == 7)) for k in range(n)]
    return spark.createDataFrame([(f"d{k:05d}", t) for k, t in enumerate(texts)], "doc_id string, text string")


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    return retrieval.write_index(corpus(spark), f"file://{tmp_path_factory.mktemp('index')}")


def every_posting(index, queries, k):
    """The same ranking with all postings of all terms."""
    terms = retrieval.query_terms(index, queries, k)
    hits = terms.join(index.postings, "term").select("query_id", "doc", (F.col("w") * F.col("impact")).alias("s"))
    scores = hits.groupBy("query_id", "doc").agg(F.round(F.sum("s"), 9).alias("score"))
    ranked = scores.withColumn("rank", F.expr("row_number() over (partition by query_id order by score desc, doc)")).where(F.col("rank") <= k)
    return sorted((r.query_id, r["rank"], r.doc, round(r.score, 6)) for r in ranked.collect())


def test_search_equals_scoring_everything(spark, index):
    r = random.Random(2)
    asked = [(0, "common rareword"), (1, "common"), (2, "rareword"), (3, "common common w001"), (4, " ".join(f"w{r.randrange(300):03d}" for _ in range(40))), (5, "w005 w006 common w007")]
    queries = spark.createDataFrame(asked, "query_id int, query string")
    for k in (1, 10):
        got = sorted((x.query_id, x["rank"], x.doc, round(x.score, 6)) for x in retrieval.bm25_topk(index, queries, k).collect())
        assert got == every_posting(index, queries, k)


def test_a_rare_term_spares_the_frequent_one(spark, index):
    queries = spark.createDataFrame([(0, "common rareword")], "query_id int, query string")
    terms = index.kept(retrieval.query_terms(index, queries, 10))
    every = terms.join(index.frequencies.select("term", "df"), "term").agg(F.sum("df")).first()[0]
    barred = index.kept(retrieval.barred(terms, retrieval.thresholds(index, terms)))
    read = retrieval.needed_blocks(index, barred).agg(F.sum("n")).first()[0] + retrieval.first_blocks(index, terms).agg(F.sum("n")).first()[0]
    assert every > 3000 and read < every / 5
    assert {r.term: r.needed for r in barred.collect()} == {"common": False, "rareword": True}


def test_blocks_are_bounded_and_unknown_words_fill_up(spark, index):
    assert index.blocks.agg(F.max("n")).first()[0] < 3 * retrieval.BLOCK and index.postings.count() == index.frequencies.agg(F.sum("df")).first()[0]
    got = retrieval.bm25_topk(index, spark.createDataFrame([(0, "nowhere"), (1, "")], "query_id int, query string"), 3).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.doc, r.score) for r in got] == [(q, f"d0000{k}", 0.0) for q in range(2) for k in range(3)]
    empty = retrieval.write_index(spark.createDataFrame([], "doc_id string, text string"), index.path + "-empty")
    assert retrieval.bm25_topk(empty, spark.createDataFrame([(0, "common")], "query_id int, query string"), 3).count() == 0


def test_a_scan_keeps_k_documents_of_a_task_and_takes_many_passes(spark, index, monkeypatch):
    """What leaves the tasks grows with queries and tasks, not with documents; small bounds give the same rows, and so do blocks."""
    asked = [(0, "common rareword"), (1, "common"), (2, "rareword"), (3, "common common w001"), (4, "w002 w003 w004"), (5, "w005 w006 common w007")]
    queries = spark.createDataFrame(asked, "query_id int, query string")
    terms = retrieval.query_terms(index, queries, 5)
    rows = retrieval.scan(index, terms, "k", retrieval.best_of_task(index.mean_length), ", s double")
    assert rows.count() <= 5 * len(asked) * index.counted.rdd.getNumPartitions() < index.n
    key = lambda df: sorted((x.query_id, x["rank"], x.doc, round(x.score, 6)) for x in df.collect())
    want = every_posting(index, queries, 5)
    for name, bound in {"BROADCAST_ROWS": 3, "SLICE_ROWS": 7, "HELD_ROWS": 10}.items():
        monkeypatch.setattr(retrieval, name, bound)
    assert key(retrieval.bm25_topk(index, queries, 5)) == want == key(retrieval.bm25_topk(index, queries, 5, by_blocks=True))


def test_equal_scores_go_to_the_smaller_number(spark, tmp_path):
    """ids are compared as numbers, in the tasks too, and a query's own k may be 0."""
    docs = spark.createDataFrame([(k, "same words here " + "x" * (k % 2)) for k in (100, 9, 20, 11, 3, 1000)], "doc_id long, text string")
    index = retrieval.write_index(docs.repartition(2), f"file://{tmp_path}/i")
    queries = spark.createDataFrame([("a", "words", 4), ("b", "same words", 0), ("c", None, 1)], "query_id string, query string, k int")
    assert sorted((r.query_id, r["rank"], r.doc) for r in retrieval.bm25_topk(index, queries).collect()) == [("a", 1, 3), ("a", 2, 9), ("a", 3, 11), ("a", 4, 20), ("c", 1, 3)]


@pytest.mark.parametrize("stemmer", [None, plural_stem, english_stem])
def test_documents_are_counted_by_the_words_of_tokenize(spark, stemmer):
    """Words are as those of queries, at edges and in other scripts too; texts reach a task as they are, not as a list with a row for each word."""
    texts = ["", None, "a", " . ", "The THE the", "x yy  x_1 _ __", "Füße FÜSSE ΣΊΣΥΦΟΣ İstanbul", "naïve nai\u0308ve", "two\nlines\ttabs\u00a0and\u2003blanks", "½ ²³ ٣٤ 東京 𝒳𝒴 😀😀", "cats-and_dogs, cats' ponies;running", "of no by it"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    words = docs.select("doc_id", retrieval.tokenize(F.col("text")).alias("w")).collect()
    want = {r.doc_id: Counter((stemmer or str)(w) for w in r.w or []) for r in words}
    counted = retrieval.counted(docs, stemmer=stemmer)
    got = counted.collect()
    assert {r.doc: dict(zip(r.terms, r.tfs, strict=True)) for r in got} == want and {r.doc: r.doc_len for r in got} == {k: v.total() for k, v in want.items()}
    assert len(got) == len(texts) and "regexp_extract_all" not in counted._jdf.queryExecution().toString()


def test_texts_are_held_by_documents_whatever_their_words(spark, tmp_path, monkeypatch):
    """Texts of one and two words, of stop words, with cut words at their edges, and of words that every document has."""
    wholes = ["the cat sat on the mat", "a cat on a mat", "on the mat", "concatenate the matter", "Cat sat on", "", "sat cat the on mat the"]
    docs = [(k, " ".join(["frequent words"] * 3) + f" {k} " + wholes[k % len(wholes)]) for k in range(70)]
    index = retrieval.write_index(spark.createDataFrame(docs, "doc_id long, text string"), f"file://{tmp_path}/i")
    texts = ["cat sat on", "at sat on th", "cat", "the mat", "on the mat", "at the mat", "words frequent words", "frequent words 3 c", "nowhere to be found", "sat sat sat sat", "", None]
    asked = spark.createDataFrame(list(enumerate(texts)), "query_id int, text string")
    want = {(q, k) for q, t in enumerate(texts) if t is not None for k, whole in docs if t in whole}
    assert {tuple(r) for r in retrieval.holding(asked, index).collect()} == want
    monkeypatch.setattr(retrieval, "BROADCAST_ROWS", 2)
    assert {tuple(r) for r in retrieval.holding(asked, index).collect()} == want


def test_plural_stem():
    assert [plural_stem(w) for w in ("ponies", "houses", "cats", "glass", "bus", "shoes", "trees", "aies", "is", "as")] == ["pony", "house", "cat", "glass", "bus", "shoes", "trees", "aie", "i", "a"]


# Containment ------------------------------------------------------------------------------------------------------------


def test_containment_equals_all_pairs(spark, tmp_path):
    r = random.Random(3)
    word = lambda: r.choice(["ab", "abc", "bc", "é", "the", "\U0001f600", "a"])
    texts = {" ".join(word() for _ in range(r.randrange(1, 30))) for _ in range(150)}
    texts |= {t[a : a + r.randrange(1, 60)] for t in list(texts) for a in [r.randrange(len(t))]}
    passage = "a passage of some length that many texts hold in the middle of them"
    texts |= {passage, *(f"{k} {passage} {k * 7}" for k in range(80)), *(passage[k:] for k in range(0, 60, 3))} | {"x" * k for k in (1, 22, 23, 24, 400)} | {"y" * 3000 + "x" * 30, "z"}
    rows = [(t, 1, "clash") for t in [*texts, *list(texts)[:20], "", None]]
    got = {x.text: (x.maximal, x.minimal) for x in containment.containment(spark.createDataFrame(rows, "text string, id int, h string"), f"file://{tmp_path}/c").collect()}
    texts.discard("")
    assert got == {t: (not any(t != u and t in u for u in texts), not any(t != u and u in t for u in texts)) for t in texts}


def test_containment_asks_for_few_candidates(spark, tmp_path):
    """Texts of the same words share short runs everywhere; only a text's own place may be left as a candidate."""
    words = ["thereby", "station", "ringing", "another", "hundred", "meadows", "lantern", "bishops"]
    texts = [" ".join(words[(k // 8**i + i) % 8] for i in range(8)) for k in range(300)]
    got = containment.containment(spark.createDataFrame([(t,) for t in texts], "text string"), f"file://{tmp_path}/c")
    assert all(r.maximal and r.minimal for r in got.collect())
    assert spark.read.parquet(f"file://{tmp_path}/c/places").count() <= len(texts)


def test_containment_of_nothing(spark, tmp_path):
    assert containment.containment(spark.createDataFrame([], "text string"), f"file://{tmp_path}/c").count() == 0


# Long texts -------------------------------------------------------------------------------------------------------------


def test_overlap_is_linear_and_exact(spark):
    r = random.Random(4)
    long_ = [" ".join(f"t{r.randrange(3000)}" for _ in range(20000)) for _ in range(2)]
    rows = [(long_[0], long_[1]), ("", ""), ("a a b", "a b b c"), ("x", ""), ("b a b a b", "b b a")]
    rows += [(" ".join(r.choice("pqrs") for _ in range(r.randrange(12))), " ".join(r.choice("pqrs") for _ in range(r.randrange(12)))) for _ in range(80)]
    df = spark.createDataFrame([(k, *x) for k, x in enumerate(rows)], "k int, a string, b string")
    got = {x.k: x.n for x in df.select("k", metrics.overlap(metrics.words(F.col("a")), metrics.words(F.col("b"))).alias("n")).collect()}
    from collections import Counter

    assert got == {k: sum((Counter(a.split()) & Counter(b.split())).values()) for k, (a, b) in enumerate(rows)}


# Attempts on the stream -------------------------------------------------------------------------------------------------

ATTEMPTS = "id string, attempt_idx int, answer string, is_correct boolean"


def files_below(path):
    return sum(1 for p in path.rglob("*") if p.is_file())


def test_stream_equals_batch_for_late_and_repeated_lots(spark, tmp_path):
    r = random.Random(5)
    rows = [(f"u{u}", k, r.choice(["x", "y", "", None, "z"]), r.choice([True, False, False, False, None])) for u in range(25) for k in range(1, 9)]
    df = spark.createDataFrame(rows, ATTEMPTS)
    src, out, mark = (f"file://{tmp_path}/{x}" for x in ("in", "out", "mark"))
    for lot in ([2], [0, 1], [2], [3], [0, 1, 2, 3]):
        df.where(F.col("attempt_idx").isin([k for k in range(1, 9) if k % 4 in lot])).coalesce(1).write.mode("append").json(src)
        streams.remember(streams.read_attempts(spark, src, ATTEMPTS), out, mark, 3).awaitTermination()
    first = F.min(F.when(F.col("is_correct"), F.col("attempt_idx")))
    open_ = df.join(df.groupBy("id").agg(first.alias("first")), "id").where("first is null or attempt_idx <= first").drop("first")
    key = lambda rows: sorted(map(repr, (tuple(r[c] for c in ("id", "attempt_idx", "answer", "is_correct", "tips_wrong_answer", "tips_used", "received_tips")) for r in rows)))
    got = spark.read.parquet(out)
    assert key(got.collect()) == key(A.wrong_answer_memory(open_, 3).collect())
    ids = lambda d: sorted((r.id, r.attempt_idx) for r in d.collect())
    assert ids(streams.first_or_kth(got, 8)) == ids(A.truncate(df, 8))
    now = sorted((r.id, r.any_correct, r.first_success) for r in streams.progress(spark, mark).collect())
    assert now == sorted((r.id, r.any_correct, r.first_success) for r in A.any_correct(df).collect())


def test_an_id_is_read_and_written_once_in_a_batch():
    """Calls of the state store do not grow with the attempts of an id, also where all of them wait; nothing new writes nothing."""
    from types import SimpleNamespace

    from pyspark.sql import Row

    calls, held = [], {}

    class Value:
        def get(self):
            calls.append("get")
            return held.get("v")

        def update(self, v):
            calls.append("update")
            held["v"] = v

    memory = streams.Memory(3)
    memory.init(SimpleNamespace(getValueState=lambda *_: Value()))
    lot = lambda ks: list(memory.handleInputRows(("u",), iter([Row(id="u", attempt_idx=k, answer=f"a{k % 7}", is_correct=None if k % 2 else False) for k in ks]), None))
    assert lot(range(2, 101)) == [] and calls == ["get", "update"]
    out = lot(range(1, 101))
    assert [r.attempt_idx for r in out] == list(range(1, 101)) and len(out[-1].tips_wrong_answer) == 7 and calls == ["get", "update"] * 2
    assert lot(range(1, 101)) == [] and calls[4:] == ["get"] and held["v"][4] == []


# Prediction -------------------------------------------------------------------------------------------------------------


def test_one_bad_prompt_fails_alone(spark):
    def predictor(prompts):
        if "p500" in prompts:
            raise ValueError("no")
        return [p.upper() if p != "p7" else " " for p in prompts]

    rows = spark.createDataFrame([(k, f"p{k}") for k in range(1000)] + [(1000, "p500x")], "id int, prompt string")
    got = {r.id: r.predict for r in plugins.predict(rows, predictor, batch=64).collect()}
    assert [k for k, v in got.items() if v and v.startswith("ERROR")] == [500] and got[7] is None and got[1000] == "P500X"


def test_a_run_that_was_killed_asks_only_what_is_missing(spark, tmp_path):
    asked, stop = tmp_path / "asked", tmp_path / "stop"
    stop.touch()

    def setup():
        def predictor(prompts):
            if stop.exists() and "p3" in prompts:
                import os

                os._exit(1)  # the worker dies, and with it the job
            with asked.open("a") as f:
                f.writelines(f"{p}\n" for p in prompts)
            return [p.upper() for p in prompts]

        return predictor

    rows = spark.createDataFrame([(k, f"p{k}") for k in range(40)], "id int, prompt string").coalesce(1)
    path = f"file://{tmp_path}/out"
    with pytest.raises(Exception):  # noqa: B017
        plugins.predict_into(rows, setup, path, shards=5)
    kept = plugins.done(spark, path)
    before = {r.id for r in kept.collect()} if kept is not None else set()
    assert 3 not in before
    asked.write_text("")
    stop.unlink()
    got = {r.id: r.predict for r in plugins.predict_into(rows, setup, path, shards=5).collect()}
    assert got == {k: f"P{k}" for k in range(40)}
    again = asked.read_text().split()
    assert len(again) == len(set(again)) == 40 - len(before) and not {f"p{k}" for k in before} & set(again)
