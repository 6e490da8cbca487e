import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from evidentia.llm import ngram_join

DOCS = "doc_id long, text string, n int, lo string"


def shingle_set(text):
    words = [w for w in re.split("[ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def brute_force(rows):
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    index = defaultdict(list)
    for k, s in enumerate(sets):
        for h in s:
            index[h].append(k)
    for k, s in enumerate(sets):
        for j, c in Counter(j for h in s for j in index[h] if j > k).items():
            if 100 * c >= 80 * (len(s) + len(sets[j]) - c):
                parent[find(j)] = find(k)
    low = {}
    for k, (doc, _) in enumerate(rows):
        low[find(k)] = min(low.get(find(k), doc), doc)
    return sorted((doc, len(sets[k]), low[find(k)]) for k, (doc, _) in enumerate(rows))


def corpus(seed, families=6, size=40):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(3000)]
    passage = r.choices(vocabulary, k=60)
    rows = []
    for _ in range(families):
        base = r.choices(vocabulary, k=r.randint(30, 220))
        for _ in range(r.randint(1, size)):
            words = list(base)
            for _ in range(r.randint(0, max(1, len(words) // 25))):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            if r.random() < 0.2:
                words = words[: int(len(words) * 0.85)]
            rows.append(" ".join(w.upper() if r.random() < 0.05 else w for w in words))
    rows += [" ".join(r.choices(vocabulary, k=50) + passage) for _ in range(60)]
    rows += ["", None, "   ", "a b", "A  b", "a b c d", "a b c d e", "a b c d e", "É b c d e", "é b c d e"]
    r.shuffle(rows)
    return list(enumerate(rows, 100))


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(k, t, 0, "x") for k, t in rows], DOCS)
    assert sorted(tuple(r) for r in ngram_join.near_duplicates(df).collect()) == brute_force(rows)


def test_repeated_rows_null_ids_and_empty(spark):
    long = "one two three four five six seven"
    df = spark.createDataFrame([(5, long, 0, ""), (5, long, 0, ""), (3, long, 0, ""), (None, long, 0, ""), (None, None, 0, ""), (9, None, 0, None)], DOCS)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(df).collect()), key=repr)
    assert got == sorted([(3, 3, 3), (5, 3, 3), (5, 3, 3), (9, 0, 9), (None, 0, None), (None, 3, 3)], key=repr)
    kept = ngram_join.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([3, 9, None], key=repr)
    empty = spark.createDataFrame([], DOCS)
    assert ngram_join.near_duplicates(empty).count() == 0 and ngram_join.keep_one(empty).count() == 0


def chain(n=3, length=60):
    """Texts of which each is linked with the next, but not with those after it."""
    words = [f"c{k}" for k in range(length)]
    out = []
    for k in range(n):
        out.append(" ".join(words))
        words[7 * k + 3] = f"x{k}"
    return out


def test_a_row_without_id_is_a_bridge(spark):
    a, b, c = chain(3, 50)
    sets = [shingle_set(t) for t in (a, b, c)]
    linked = lambda x, y: 100 * len(x & y) >= 80 * len(x | y)
    assert linked(sets[0], sets[1]) and linked(sets[1], sets[2]) and not linked(sets[0], sets[2])
    df = spark.createDataFrame([(1, a, 0, ""), (None, b, 0, ""), (2, c, 0, "")], DOCS)
    assert sorted(((r.doc_id, r.component_id, r.n_links) for r in ngram_join.near_duplicates(df, with_links=True).collect()), key=repr) == sorted([(1, 1, 1), (None, 1, 2), (2, 1, 1)], key=repr)
    assert [r.doc_id for r in ngram_join.keep_one(df).collect()] == [1]


def test_keep_one_judges_rows_by_their_text(spark):
    a, b, _ = chain()
    other = " ".join(f"o{k}" for k in range(30))
    names = "doc_id long, text string, _r long, _text string"
    rows = [(7, a, 1, "p"), (7, other, 2, "p"), (7, a, 3, "p"), (8, b, 4, ""), (None, other, 5, ""), (None, "q w e r t y", 6, ""), (None, "q w e r t y", 7, ""), (None, "", 8, ""), (None, "", 9, ""), (4, " \n", 10, None)]
    kept = ngram_join.keep_one(spark.createDataFrame(rows, names))
    assert kept.columns == ["doc_id", "text", "_r", "_text"]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([(7, a), (7, other), (None, "q w e r t y"), (None, ""), (None, ""), (4, " \n")], key=repr)


def test_long_near_copies(spark):
    r = random.Random(9)
    words = [f"v{r.randrange(20000)}" for _ in range(30000)]
    rows = []
    for k in range(6):
        own = list(words)
        for _ in range(200 * k):
            own[r.randrange(len(own))] = f"y{k}"
        rows.append((k, " ".join(own)))
    rows += [(50, " ".join(f"v{r.randrange(20000)}" for _ in range(30000))), (51, "the " * 90000)]
    df = spark.createDataFrame([(k, t, 0, "x") for k, t in rows], DOCS)
    assert sorted(tuple(r) for r in ngram_join.near_duplicates(df).collect()) == brute_force(rows)


def test_pairs_beyond_the_heads_are_found(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "HEAD", 1)
    rows = corpus(5)
    df = spark.createDataFrame([(k, t, 0, "x") for k, t in rows], DOCS)
    assert sorted(tuple(r) for r in ngram_join.near_duplicates(df).collect()) == brute_force(rows)


def test_components_of_a_chain(spark):
    from evidentia.llm.common import Scratch

    edges = spark.createDataFrame([(k, k + 1) for k in range(50)] + [(100, 101), (100, 102)], "a long, b long")
    got = dict(tuple(r) for r in ngram_join.components(edges, Scratch(spark, "t"), "c").collect())
    assert got == {k: 0 for k in range(51)} | {100: 100, 101: 100, 102: 100}


@pytest.mark.parametrize("block", [512, 5])
def test_every_link_is_counted(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rows = corpus(3)
    rows += [(5000 + k, t) for k, (_, t) in enumerate(rows[:40])]
    sets = [shingle_set(t) for _, t in rows]
    near = lambda a, b: bool(a) and bool(b) and 100 * len(a & b) >= 80 * len(a | b)
    want = {doc: sum(near(sets[k], s) for s in sets) - bool(sets[k]) for k, (doc, _) in enumerate(rows)}
    df = spark.createDataFrame([(k, t, 0, "x") for k, t in rows], DOCS)
    got = ngram_join.near_duplicates(df, with_links=True).collect()
    assert {r.doc_id: r.n_links for r in got} == want and len(got) == len(rows) and max(want.values()) > 5
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_force(rows)


def test_overlap():
    r = random.Random(4)
    sets = [np.unique(np.array([r.randrange(v) for _ in range(r.randint(0, 60))], dtype=np.int64)) for v in (50, 400, 3000) for _ in range(20)]
    want = [[len(np.intersect1d(a, b)) for b in sets[10:]] for a in sets[:45]]
    assert ngram_join.overlap(sets[:45], sets[10:]).tolist() == want
