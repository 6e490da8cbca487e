"""Readers on small files, and operators that have no table of the driver's."""

import json
import re

import pytest
from pyspark.sql import functions as F

from evidentia.functions.stem import english_stem
from evidentia.operators import lookups, plugins, reports, retrieval
from evidentia.sources import adapters, readers


def test_jsonl_tolerates_bad_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1"}\n\nnot json\n{"id": "2"}\n')
    assert {r.id for r in readers.read_jsonl(spark, str(tmp_path), "id string").collect()} == {"1", "2"}
    assert readers.bad_lines(spark, str(tmp_path), "id string").first().n_bad == 1


def test_json_field(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"data": [{"x": 1}, {"x": 2}], "info": {"n": "k"}}))
    schema = "data array<struct<x:int>>, info struct<n:string>"
    assert sorted(r.x for r in readers.read_json(spark, str(tmp_path), schema, "data").collect()) == [1, 2]
    assert readers.read_json(spark, str(tmp_path), schema, "info").first().n == "k"
    assert readers.read_json(spark, str(tmp_path), schema).count() == 1


def test_id_list(spark, tmp_path):
    (tmp_path / "ids.jsonl").write_text('"a b"\n12\n\n"4hop3__1_2"\n')
    assert {r.id for r in readers.read_id_list(spark, str(tmp_path)).collect()} == {"a b", "12", "4hop3__1_2"}


def test_run_folder(spark, tmp_path):
    run = tmp_path / "m" / "seed_1" / "tpr_0.5" / "prompt_rag" / "PopQA-noise_8-answerable" / "20250102030405"
    run.mkdir(parents=True)
    (run / "1-q.json").write_text(json.dumps({"id": "1", "predict": "Answer: x", "query": "q"}))
    (run / "m2-q.json").write_text(json.dumps({"id": "m2", "predict": "Answer: y"}))
    (run / "bad.json").write_text(json.dumps({"predict": "no id"}))
    (run / "metadata.json").write_text(json.dumps({"info": {"model_name": "big", "dataset": "PopQA"}, "total_samples": 2}))
    rows = {r.id: r for r in readers.read_run_folder(spark, str(tmp_path)).collect()}
    assert set(rows) == {"1", "m2"}
    assert (rows["1"].model_name, rows["1"].prompt_type, rows["1"].dataset, rows["1"].noise, rows["1"].answerable, rows["1"].run_ts) == ("big", "rag", "PopQA", 8, True, "20250102030405")


def test_run_folders_have_few_files(spark, tmp_path, monkeypatch):
    """Samples are written once, many to a file: a file for each run and metadata, more only as rows need them."""
    from evidentia.plans import data_queries

    monkeypatch.setattr(data_queries, "scratch", lambda spark, name: f"file://{tmp_path}/{name}")
    n = data_queries.s8(spark, "/root/testdata/sf0.01").count()
    files = [p for p in tmp_path.glob("runs/**/*.json") if not p.name.startswith(".")]
    assert n > 200 and sum(p.name == "metadata.json" for p in files) <= 6 and len(files) <= 12 and not list(tmp_path.glob("runs-*"))


def test_sentences_are_stripped_without_a_pass_for_each(spark):
    """White space of every kind at the ends of a text and between sentences, also where sentences are empty."""
    import random

    from evidentia.functions.text import SPACE, sentences, strip as ends

    strip = lambda c: F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")
    every = spark.range(0, 0x10000).where("id not between 55296 and 57343").select(F.expr("decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE')").alias("c"))
    assert every.where((ends(F.col("c")) == "") != F.col("c").rlike(f"^{SPACE}$")).count() == 0
    r = random.Random(7)
    texts = ["", " ", ".", ". ", " . x", "a.\u00a0b", "a. \u00a0 b", "a.\u2028 b. ", None] + ["".join(r.choice(["a", "b", ".", "!", "。", " ", " ", "\n", "\u00a0", "\u2003", "\x1c", "\x85"]) for _ in range(r.randrange(30))) for _ in range(400)]
    each = F.filter(F.transform(F.split("t", r"(?<=[.!?。！？])\s+"), strip), lambda s: s != "")
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", sentences(F.col("t")).alias("got"), each.alias("want"))
    assert [x for x in df.collect() if x.got != x.want] == []
    assert "transform" not in df.select("got")._jdf.queryExecution().optimizedPlan().toString()


def test_eval_summaries_take_the_latest(spark, tmp_path):
    for ts, em in (("20250101000000", 0.1), ("20250201000000", 0.2)):
        p = tmp_path / "prompt_rag" / "PopQA-noise_8-answerable"
        p.mkdir(parents=True, exist_ok=True)
        (p / f"{ts}_eval.json").write_text(json.dumps({"dataset": "PopQA", "prompt_type": "rag", "answer_em": em}))
    got = readers.read_eval_summaries(spark, str(tmp_path)).collect()
    assert [(r.method, r.dataset, r.answer_em) for r in got] == [("rag", "PopQA", 0.2)]


def test_legacy_and_unfinished(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"info": {"model_name": "m", "dataset": "d"}, "data": {"7": {"predict": "p", "answer": ["x"], "sfs": ["s"]}}}))
    (tmp_path / "b.json").write_text(json.dumps({"data": {"8": {"predict": "p"}}}))
    r = readers.read_legacy_result(spark, str(tmp_path)).collect()
    assert [(x.id, x.answers, x.facts, x.dataset) for x in r] == [("7", ["x"], ["s"], "d")]


def test_abstract_store_and_squad(spark, tmp_path):
    (tmp_path / "abs").mkdir()
    (tmp_path / "abs" / "a.jsonl").write_text('{"pmid":"1","title":"old"}\n{"title":"none"}\n{"pmid":"1","title":"new"}\nbad\n')
    assert [(r.pmid, r.title) for r in readers.read_abstract_store(spark, str(tmp_path / "abs")).collect()] == [("1", "new")]
    (tmp_path / "sq.json").write_text(json.dumps({"data": [{"paragraphs": [{"qas": [{"id": "a", "answers": [{"text": "x"}]}, {"id": "b", "answers": []}]}]}]}))
    preds = spark.createDataFrame([("a", "x")], "qid string, text string")
    got = {r.qid: (r.has_ans, r.pred, r.na_prob) for r in readers.read_squad(spark, str(tmp_path / "sq.json"), preds).collect()}
    assert got == {"a": (True, "x", 0.0), "b": (False, None, 0.0)}
    assert readers.read_parquet.__doc__


def test_hotpot_fixture(spark):
    raw = spark.createDataFrame(
        [("1", "q", "a", "bridge", "hard", (["T", ""], [["s0", "s1"], ["u0"]]), (["T", "T", "X", "T"], [1, 0, 0, 9]))],
        "id string, question string, answer string, type string, level string, context struct<title:array<string>,sentences:array<array<string>>>, supporting_facts struct<title:array<string>,sent_id:array<int>>",
    )
    r = adapters.finish(adapters.hotpotqa(raw)).first()
    assert r.facts == ["s1", "s0"] and r.corpus[1].title == "unknown title" and r.corpus[1].facts is None
    assert r.context == "###T\ns0 s1\n\n###UNKNOWN TITLE\nu0" and set(adapters.ADAPTERS) >= {"HotpotQA", "Qasper"}


def test_predictor_retries_and_errors(spark):
    df = spark.createDataFrame([(1, "ok"), (2, "boom")], "k int, prompt string")

    def predictor(prompts):
        if "boom" in prompts:
            raise RuntimeError("down")
        return [" " if p == "" else p * 2 for p in prompts]

    got = {r.k: r.predict for r in plugins.predict(df, predictor, batch=1).collect()}
    assert got == {1: "okok", 2: "ERROR: down"}


def test_locate_across(spark):
    texts = spark.createDataFrame([(1, "jumps over the lazy"), (2, "not in any of these lines"), (3, "x over y")], "text_id int, text string")
    sents = spark.createDataFrame([(0, 0, "a fox jumps over the lazy dog"), (1, 2, "x over y")], "para int, sent_id int, sentence string")
    assert {tuple(r) for r in retrieval.locate_across(texts, sents).collect()} == {(1, 0, 0), (3, 1, 2)}


def test_locate_across_shuffles_no_runs_of_words(spark):
    """Sentences are not cut into runs that are shuffled; texts of every length around 24 bytes are found."""
    long_ = "From one small harbour to the other they went by boat."
    rows = [(k, 0, f"A sentence about number {k} of the harbour, which no text is part of") for k in range(200)] + [(500, 3, f"x{long_}y"), (501, 0, long_)]
    sents = spark.createDataFrame(rows, "para long, sent_id int, sentence string")
    texts = spark.createDataFrame([(n, long_[:n]) for n in range(18, len(long_) + 1) if long_[n - 1] != " "] + [(0, "harbour, that"), (1, long_[:20] + "no")], "text_id long, text string")
    out = retrieval.locate_across(texts, sents)
    assert {tuple(r) for r in out.collect()} == {(n, 500, 3) for n in range(18, len(long_) + 1) if long_[n - 1] != " "}
    assert "Generate explode" not in out._jdf.queryExecution().toString()


def test_locate_across_finds_short_texts(spark):
    lines = ["Paris is in France", "In New  York and New York, too", "a b", "", "x", "fox jumps"]
    texts = ["Paris", "New York", "aris", "w  Yo", "w York", "k and N", "x", "a b", " too ", "b a", "", "ox jump", "In", "jumps"]
    sents = spark.createDataFrame([(k, 0, t) for k, t in enumerate(lines)], "para int, sent_id int, sentence string")
    want = {(t, next(k for k, x in enumerate(lines) if t.strip() in x)) for t in texts if t.strip() and any(t.strip() in x for x in lines)}
    got = retrieval.locate_across(spark.createDataFrame([(t, t) for t in texts], "text_id string, text string"), sents).collect()
    assert {(r.text_id, r.para) for r in got} == want and len(got) == len(want)


def test_stemmed_index_and_filling_up(spark, tmp_path):
    corpus = spark.createDataFrame([("d1", "cats running"), ("d2", "cat runs"), ("d3", "dogs"), ("d0", "")], "doc_id string, text string")
    index = retrieval.write_index(corpus, str(tmp_path), english_stem)
    q = spark.createDataFrame([("q", "running cat"), ("none", "the zebra"), ("empty", "")], "query_id string, query string")
    got = {}
    for r in retrieval.bm25_topk(index, q, 3).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.doc, r.score > 0))
    assert {k: sorted(v) for k, v in got.items()} == {"q": [(1, "d1", True), (2, "d2", True), (3, "d0", False)], "none": [(1, "d0", False), (2, "d1", False), (3, "d2", False)], "empty": [(1, "d0", False), (2, "d1", False), (3, "d2", False)]}
    assert retrieval.bm25_topk(index, q, 9).count() == 12
    own = q.withColumn("k", F.when(F.col("query_id") == "q", 1).otherwise(2))
    assert {r.query_id: r["count"] for r in retrieval.bm25_topk(index, own).groupBy("query_id").count().collect()} == {"q": 1, "none": 2, "empty": 2}


STEMS = """consign consigned consigning consignment:consign consist consisted consistency consistent consistently:consist consolatory:consolatori consolidate:consolid knackeries:knackeri knavish:knavish kneeling:kneel
knots knotted:knot generously:generous generate:generat communities:communiti skies:sky dying:die hopping:hop hoping:hope tied:tie cries cry:cri gas:gas gaps:gap kiwis:kiwi relational:relat conditional:condit predication:predic operator:oper
decisiveness:decis triplicate:triplic electrical:electr hopeful:hope goodness:good revival:reviv inference:infer adjustable:adjust replacement:replac adoption:adopt effective:effect probate:probat rate:rate cease:ceas controll:control
roll:roll by:by say:say succeed:succeed inning:inning youth:youth boyish:boyish fluently:fluentli"""


@pytest.mark.parametrize("line", STEMS.split("\n"))
def test_published_stems(line):
    for group in re.findall(r"[^:]+:\S+", line):
        words, stem = group.split(":")
        assert {english_stem(w) for w in words.split()} == {stem}


def test_missing_and_sampling(spark):
    s = spark.createDataFrame([("1",), ("2",)], "id string")
    assert [r.id for r in lookups.missing(s, spark.createDataFrame([("2",), ("9",)], "id string")).collect()] == ["9"]
    assert lookups.sample_rows(s, 1).count() == 1 and lookups.sample_rows(s, 0).count() == 2


@pytest.mark.parametrize("exact", [True, False])
def test_verdicts(spark, exact):
    v = spark.createDataFrame([("1", "yes"), ("2", " YES "), ("3", "no")], "id string, llm_response string")
    assert {r.id for r in lookups.keep_yes(v, exact).collect()} == ({"1"} if exact else {"1", "2"})


def test_versions_of_a_cache(spark, tmp_path):
    key = {"dataset": "a/b", "subset": "x y", "split": "test", "noise": 8, "answerable": True}
    calls = []

    def build(text):
        def run():
            calls.append(text)
            return spark.createDataFrame([("1", text)], "id string, text string")

        return run

    path, schema = f"file://{tmp_path}/cache", "id string, text string"
    read = lambda text, key=key, **more: readers.formatted(spark, path, key, build(text), schema, **more)
    old = read("one")
    assert read("two").first().text == "one" and read("other", {**key, "subset": "z"}).first().text == "other"
    assert read("three", reload=True, fmt="json").first().text == "three" and read("four", fmt="json").first().text == "three"
    assert old.first().text == "one" and calls == ["one", "other", "three"]
    assert list(tmp_path.rglob("version=2/*.json.gz")) and read("five", {**key, "subset": "z"}).first().text == "other"
    # A version without its commit marker is not read.
    (tmp_path / next(p for p in tmp_path.rglob("version=2") if p.is_dir()) / "_SUCCESS").unlink()
    assert read("six").first().text == "one"


def test_length_limit_stops_the_write(spark, tmp_path):
    rows = spark.createDataFrame([(k, "w " * k) for k in range(1, 11)], "id int, text string")
    words = F.size(F.split(F.trim("text"), " "))
    seen = reports.write_within_limit(rows, words, f"file://{tmp_path}/ok", 10)
    assert (seen["n"], seen["mean_tokens"], seen["max_tokens"]) == (10, 5.5, 10)
    with pytest.raises(Exception, match="10 tokens; the limit is 9"):
        reports.write_within_limit(rows, words, f"file://{tmp_path}/no", 9)
    assert not (tmp_path / "no" / "_SUCCESS").exists()


def test_samples_by_rounds_of_quantiles(spark):
    rows = spark.createDataFrame([(str(k % 900), k) for k in range(1000)], "id string, _h int").coalesce(1)
    key = sorted(((r.h, r.id) for r in rows.select(F.xxhash64("id", F.lit(42)).alias("h"), "id").collect()))
    for n, edge in ((1, 10), (333, 10), (500, 1), (999, 50), (500, 10**6)):
        got = lookups.sample_rows(rows, n, edge=edge)
        assert got.columns == ["id", "_h"] and sorted(r.id for r in got.collect()) == sorted(k for _, k in key[:n]), (n, edge)
    assert lookups.sample_rows(rows, 0).count() == lookups.sample_rows(rows, 5000).count() == 1000
    assert [r.id for r in lookups.sample_rows(rows, 0).collect()] == [k for _, k in key]
    assert lookups.sample_rows(spark.createDataFrame([], "id string"), 3).count() == 0


def test_samples_of_ids_with_many_rows_end(spark):
    # Hashes with more rows than may be sorted, whose quantiles as doubles lie beside them.
    rows = spark.createDataFrame([(str(k % 3),) for k in range(300)], "id string").coalesce(1)
    order = [r.id for r in rows.distinct().orderBy(F.xxhash64("id", F.lit(42))).collect()]
    for n in (50, 100, 150, 299):
        got = [r.id for r in lookups.sample_rows(rows, n, edge=10).collect()]
        assert [got.count(k) for k in order] == [min(max(n - 100 * i, 0), 100) for i in range(3)], n
