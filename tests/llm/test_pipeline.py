"""The pipeline against a plain version of its stages on a small corpus."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from evidentia.llm import decontaminate, ngram_join, packing, pii, toxicity

DATA = "/root/testdata/sf0.001"


def one_of_each_group(docs):
    sets = {k: set(ngram_join.shingles(t).tolist()) for k, t in docs.items()}
    index, parent = defaultdict(list), {k: k for k in docs}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for k, s in sorted(sets.items()):
        for h in s:
            index[h].append(k)
    for k, s in sorted(sets.items()):
        for j, c in Counter(j for h in s for j in index[h] if j > k).items():
            if 100 * c >= 80 * (len(s) + len(sets[j]) - c):
                a, b = find(k), find(j)
                parent[max(a, b)] = min(a, b)
    return {k: t for k, t in docs.items() if find(k) == k}


def words(text):
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def contaminated(text, items):
    w = words(text)
    for item in items:
        for d in range(-len(item) + 1, len(w)):
            now = best = 0
            for k, x in enumerate(item):
                if 0 <= k + d < len(w):
                    now = max(0, now + (1 if w[k + d] == x else -1))
                    best = max(best, now)
            if best >= min(decontaminate.LEAST_SCORE, len(item)):
                return True
    return False


def test_run_equals_the_plain_version(spark):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    model = toxicity.fit(spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet"))
    buckets = toxicity.Buckets()
    clean = {k: t for k, t in rows.items() if not (t and model.above(np.array([model.weights[toxicity.features(t, buckets)].sum(dtype=np.float64)]))[0, 0] >= model.threshold)}
    clean = one_of_each_group(clean)
    items = [words(r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    items = [x for x in items if len(x) >= len(decontaminate.MASKS[0])]
    common = {w for x in items for w in x}
    # Only documents that share many words with the items can reach the score; the rest is skipped for speed alone.
    clean = {k: t for k, t in clean.items() if sum(w in common for w in words(t)) < decontaminate.LEAST_SCORE or not contaminated(t, items)}
    found = Counter((kind, v, s) for t in clean.values() for kind, _, _, v, s in pii.candidates(t, pii.base_spans(t)))
    good = {k for k, p in pii.fit([(*k, n) for k, n in found.items()]).items() if p >= pii.KEEP_FROM}
    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    want = {}
    for k, t in clean.items():
        base = pii.base_spans(t)
        out, at = "", 0
        for kind, a, b in sorted(base + [(kind, a, b) for kind, a, b, _, shape in pii.candidates(t, base) if (kind, shape) in good], key=lambda s: (s[1], -s[2])):
            if a >= at:
                out, at = out + t[at:a] + f"<{kind}>", b
        want[k] = np.array([*tokenizer.encode(out + t[at:], add_special_tokens=False).ids, 2], "<u4")
    pieces = corpus_pipeline.run(spark, DATA).collect()
    assert {r.doc_id for r in pieces} == set(want)
    for r in pieces:
        assert r.doc_tokens == len(want[r.doc_id])
        own = want[r.doc_id][r.start : r.start + r.length]
        assert r.ids == own.tolist() and r.ids_crc32 == zlib.crc32(own.tobytes())


def test_stages_take_odd_rows(spark):
    """Nulls in all columns, rows without an id, repeated rows and columns with the names that stages use."""
    names = "doc_id long, text string, lang string, source string, n_chars long, _toxic string, _r long, _scored string, _t string, ids string"
    clean = " ".join(f"word{k}" for k in range(40))
    item = " ".join(f"item{k}" for k in range(30))
    rows = [(1, clean, "en", "s", 5, "a", 1, "b", "c", "d"), (None, clean, None, None, None, None, None, None, None, None), (None, item + " tail", "en", "s", 1, "a", 1, "b", "c", "d"), (2, None, "en", "s", 0, "a", 1, "b", "c", "d"), (3, "", "en", "s", 0, "a", 1, "b", "c", "d"), (4, "mail me a@b.cd now", "en", "s", 9, "a", 1, "b", "c", "d"), (4, "mail me a@b.cd now", "en", "s", 9, "a", 1, "b", "c", "d")]
    docs = spark.createDataFrame(rows, names)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    model = toxicity.fit(docs, labels)
    assert corpus_pipeline.without_toxic(docs, model).columns == docs.columns
    docs = ngram_join.keep_one(docs)
    docs = decontaminate.drop_contaminated(docs, bench)
    docs = pii.redact(docs)
    assert docs.columns == [c.split()[0] for c in names.split(", ")]
    assert sorted(((r.doc_id, r.text) for r in docs.collect()), key=repr) == sorted([(1, clean), (2, None), (3, ""), (4, "mail me <email> now")], key=repr)
    assert {r.doc_id: r.doc_tokens for r in packing.pack(docs).collect()}[2] == 1
