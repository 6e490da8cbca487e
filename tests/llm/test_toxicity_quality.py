import random

import numpy as np
import pytest

from evidentia.llm import quality, toxicity

BAD = ["idiot", "moron", "clown"]


def corpus(n=600, seed=4):
    r = random.Random(seed)
    words = [f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(400)]
    rows, labels = [], []
    for k in range(n):
        toxic = k % 5 == 0
        text = r.choices(words, k=80)
        if toxic:
            for _ in range(r.choice([2, 5, 9])):
                text[r.randrange(80)] = r.choice(BAD)
        junk = k % 4 == 1
        joined = " ".join(w.upper() + "!!" for w in text) if junk else " ".join(text) + "."
        rows.append((k, joined, "en" if k % 3 else "fr", "bad" if junk and r.random() < 0.8 else "good", len(joined), "x"))
        labels.append((k, int(not junk), int(toxic)))
    return rows, labels


DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string"
LABELS = "doc_id long, quality int, toxic int"


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, DOCS)
    some = spark.createDataFrame([x for x in labels if x[0] < 400] + [(5, None, None), (None, 1, 1)], LABELS)
    truth = {k: (q, t) for k, q, t in labels}
    model = toxicity.fit(docs, some)
    assert (np.diff(model.cuts) > 0).all()
    got = [r for r in toxicity.score(docs, model).collect() if r.doc_id >= 400]
    assert np.mean([r.toxic == bool(truth[r.doc_id][1]) for r in got]) > 0.95
    assert all(0 <= r.expected_severity <= toxicity.GRADES - 1 and 0 <= r.grade < toxicity.GRADES for r in got)
    assert np.mean([r.expected_severity for r in got if truth[r.doc_id][1]]) > 5 * np.mean([r.expected_severity for r in got if not truth[r.doc_id][1]])
    scored = [r for r in quality.cotrain(docs, some).collect() if r.doc_id >= 400]
    assert np.mean([r.keep == bool(truth[r.doc_id][0]) for r in scored]) > 0.97
    assert len(scored) == 200 and all(0 <= r.score <= 1 for r in scored)


def test_edge_rows(spark):
    rows, labels = corpus(200)
    more = [(1000, None, None, None, None, None), (1001, "", "", "", 0, ""), (None, "x", None, "s", 1, None), (3, rows[3][1], *rows[3][2:]), (1002, "idiot " * 40000, "en", "good", 1, "")]
    docs, lab = spark.createDataFrame(rows + more, DOCS), spark.createDataFrame(labels, LABELS)
    got = toxicity.score(docs, toxicity.fit(docs, lab)).collect()
    assert len(got) == len(rows) + len(more)
    assert not [r for r in got if r.doc_id in (1000, 1001)][0].toxic
    assert quality.cotrain(docs, lab).count() == len(rows) + len(more)


@pytest.mark.parametrize("n", [0, 3])
def test_without_labels(spark, n):
    rows, _ = corpus(n or 1)
    docs = spark.createDataFrame(rows[:n], DOCS)
    none = spark.createDataFrame([], LABELS)
    assert toxicity.fit(docs, none) is None
    assert [r.toxic for r in toxicity.score(docs, None).collect()] == [False] * n
    assert [r.keep for r in quality.cotrain(docs, none).collect()] == [True] * n


def test_graded_labels_are_used():
    assert toxicity.graded(np.array([0, 2, 9]), np.zeros(0, int), np.zeros(0, int)).tolist() == [0, 2, 3]


def test_rounds_hand_over_both_classes(spark):
    from evidentia.llm.common import Scratch

    rows, labels = corpus(3000)
    docs = spark.createDataFrame(rows + [(9000 + k, *rows[0][1:]) for k in range(400)], DOCS)
    some = spark.createDataFrame(labels[:700], LABELS)
    scratch = Scratch(spark, "t")
    features = scratch.keep(quality.features(docs, "doc_id", "text", "lang", "source", "n_chars"), "f")
    model = quality.fit(features, some, "doc_id", "quality", 600, 3, 5, scratch)
    print(model.handed, model.accuracy, model.majority)
    assert all(n > 0 for step in model.handed for counts in step.values() for n in counts), model.handed
    # What was handed over left the pool: all rounds together hand over no more than there is, and copies come once.
    assert all(sum(sum(step[v]) for step in model.handed) <= features.select("x", "m").distinct().count() for v in "xm")
    assert model.accuracy > 0.97 > model.majority


def test_sums_over_tasks_equal_plain_ones(spark):
    rng = np.random.default_rng(2)
    x, m, y = rng.normal(size=(300, 4)).astype(np.float16), rng.normal(size=(300, 3)).astype(np.float16), rng.integers(-1, 2, (300, 2))
    pool = spark.createDataFrame([(a.tobytes(), b.tobytes(), int(p), int(q)) for a, b, (p, q) in zip(x, m, y, strict=True)], "x binary, m binary, yx int, ym int").repartition(7)
    beta, weight = {"x": rng.normal(size=4), "m": rng.normal(size=3)}, {"x": {0: 0.5, 1: 2.0}, "m": {0: 1.0, 1: 0.25}}
    got = quality.added(pool, beta, weight)
    for v, a, said in (("x", x, y[:, 1]), ("m", m, y[:, 0])):
        a, said = a[said >= 0].astype(float), said[said >= 0]
        p, w = 1 / (1 + np.exp(-a @ beta[v])), np.where(said, weight[v][1], weight[v][0])
        assert np.allclose(got[v][0], a.T @ (w * (said - p)), atol=1e-6) and np.allclose(got[v][1], (a * (w * p * (1 - p))[:, None]).T @ a, atol=1e-6)


def test_weighted_scores_equal_plain_ones():
    rng = np.random.default_rng(1)
    weights = np.where(rng.random(toxicity.BUCKETS) < 0.2, rng.normal(size=toxicity.BUCKETS), 0).astype(np.float32)
    weighted, buckets = toxicity.Weighted(weights), toxicity.Buckets()
    for text in ("", "Some words, someone's WORDS again", "Überaus längliche Wörter " * 30, " ".join(f"w{chr(97 + k % 26)}{k}x" * 2 for k in range(500))):
        assert abs(weighted.score(text) - weights[toxicity.features(text, buckets)].sum(dtype=np.float64)) < 1e-9


def test_columns_of_the_same_name_stay(spark):
    docs = spark.createDataFrame([(1, "x", "mine", 5)], "doc_id long, text string, _scored string, n long")
    got = toxicity.score(docs, None, prefix="_").collect()[0]
    assert got["_scored"] == "mine" and got["_toxic"] is False


def test_repeated_ids_come_once(spark):
    rows, labels = corpus(300)
    docs = spark.createDataFrame(rows + [rows[7]] * 500, DOCS)
    assert toxicity.fit(docs, spark.createDataFrame(labels, LABELS)).threshold == toxicity.fit(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)).threshold
