"""Phrase collocations against a plain count of all phrases."""

import random
import re
from collections import Counter
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import functions as F

from evidentia.llm import collocations

DOCS = "doc_id long, text string, lang string, phrase string, n int"


def plain(rows, least, share, top):
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        own = counts.setdefault(lang, Counter())
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lowered):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for m in range(1, 6):
                for i in range(len(words) - m + 1):
                    own[tuple(words[i : i + m])] += 1
    out = []
    for lang, own in counts.items():
        found = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        rows = []
        for p, a in found.items():
            if any(len(q) > len(p) and 100 * b >= share * a and inside(p, q) for q, b in found.items()):
                continue
            cuts = [(Fraction(1000 * a * totals[lang], own[p[:k]] * own[p[k:]]).__floor__(), k) for k in range(1, len(p))]
            score, k = min(cuts)
            rows.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        out += [(lang, j + 1, s.decode(), -a, left, r, totals[lang], -score) for j, (score, a, s, left, r) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def some_rows():
    r = random.Random(5)
    vocabulary = [f"w{k}" for k in range(12)] + ["É", "x\xa0y", "A", "a", "\x1c", "\U0001f600"]
    passage = " ".join(r.choice(vocabulary) for _ in range(60))
    rows = [(None, None), ("en", ""), ("en", " \t .,; "), ("en", "the " * 3000), ("en", "same words again and again " * 200), (None, "Same words, here"), ("und", "same words here")]
    for _ in range(150):
        words = [r.choice(vocabulary) + (r.choice(".,\n\r\t;") if r.random() < 0.1 else "") for _ in range(r.randrange(120))]
        rows.append((r.choice(["en", "en", "en", "de", None]), r.choice([" ", "  "]).join(words)))
    return rows + [("en", passage)] * 40 + [("de", passage + " " + passage)] * 25


def test_equals_plain_counts(spark):
    rows = some_rows()
    docs = spark.createDataFrame([(k, t, x, "clash", 1) for k, (x, t) in enumerate(rows)], DOCS).repartition(5)
    for least, share, top in ((20, 100, 2000), (9, 80, 7)):
        got = sorted(tuple(r) for r in collocations.mine(docs, least=least, share=share, top=top).collect())
        assert got == plain(rows, least, share, top) and got


def test_empty(spark):
    empty = spark.createDataFrame([], DOCS)
    assert collocations.mine(empty).count() == 0
    assert collocations.mine(spark.createDataFrame([(1, None, None, "", 0)], DOCS)).count() == 0


def test_chunks_hold_each_phrase_once():
    r = random.Random(1)
    sizes = [1, 4, 5, 6, 9, 1, 50, 3000, 2]
    words = [f"w{r.randrange(40)}" for _ in range(sum(sizes))]
    ends = [sum(sizes[: k + 1]) for k in range(len(sizes))]
    texts = [" ".join(words[e - n : e]) for n, e in zip(sizes, ends, strict=True)]
    start, end, piece, last = collocations.chunks(collocations.Words(pa.array(texts)))
    assert len(start) > 150 and sorted(set(piece.tolist())) == list(range(len(sizes)))
    for width in range(1, 6):
        got, want, at = Counter(), Counter(), 0
        for a, b, done in zip(start.tolist(), end.tolist(), last.tolist(), strict=True):
            own = b - a if done else b - a - collocations.OVERLAP
            got.update(tuple(words[a + i : a + i + width]) for i in range(own) if a + i + width <= b)
        for n in sizes:
            want.update(tuple(words[i : i + width]) for i in range(at, at + n - width + 1))
            at += n
        assert got == want


def test_scores_beyond_64_bits_are_exact(spark):
    cut = spark.createDataFrame([(10**13 + 7, 10**14 + 3, 10**13 + 9, 10**13 + 11)], "a long, n long, l long, r long")
    score = "(cast(1000 as decimal(4, 0)) * cast(a as decimal(16, 0)) * cast(n as decimal(16, 0))) div (cast(l as decimal(16, 0)) * cast(r as decimal(16, 0)))"
    assert cut.select(F.expr(score)).first()[0] == 1000 * (10**13 + 7) * (10**14 + 3) // ((10**13 + 9) * (10**13 + 11))


def test_a_full_filter_loses_nothing(spark, monkeypatch):
    """With a filter that lets everything through the counts are the same."""
    rows = some_rows()[:60]
    docs = spark.createDataFrame([(k, t, x, "", 1) for k, (x, t) in enumerate(rows)], DOCS)
    want = plain(rows, 5, 100, 50)
    monkeypatch.setattr(collocations, "filter_of", lambda counts: b"\xff" * ((1 << collocations.BITS) // 8))
    assert sorted(tuple(r) for r in collocations.mine(docs, least=5, top=50).collect()) == want
