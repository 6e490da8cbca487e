import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evidentia.llm import packing

DOCS = "doc_id long, text string, length int, extra string"
TEXTS = ["The quick, BROWN fox. it's 3.5%", "", None, "a<|endoftext|>b é É \x1c x\x85y\xa0z", "long words " * 9000, "x." * 50, "The quick, BROWN fox. it's 3.5%"]


def reference(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY)).encode(text or "", add_special_tokens=False).ids, 2]


def test_pieces_round_trip(spark):
    rows = [(k, t, 7, "z") for k, t in enumerate(TEXTS)] + [(None, "no id", 1, "")]
    got = packing.pack(spark.createDataFrame(rows, DOCS).repartition(2)).collect()
    docs, seqs = defaultdict(list), defaultdict(list)
    for r in got:
        docs[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
    for k, t, *_ in rows:
        ids, at = [], 0
        for r in sorted(docs[k], key=lambda r: r.start):
            assert r.start == at
            ids, at = ids + r.ids, at + r.length
        assert ids == reference(t) and {r.doc_tokens for r in docs[k]} == {len(ids)}
    for own in seqs.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 4096 or at & (at - 1) == 0
    assert packing.report(packing.pack(spark.createDataFrame(rows, DOCS))).first().padding == 0


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], DOCS)).count() == 0


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(1, 200), max_size=40), st.sampled_from([16, 64]))
def test_balance_fills_everything(lengths, capacity):
    pieces = packing.balance(lengths, capacity)
    rooms = packing.bins_for(sum(lengths), capacity)
    used, done = [0] * len(rooms), [0] * len(lengths)
    for doc, start, n, at, offset in sorted(pieces, key=lambda p: (p[3], p[4])):
        assert offset == used[at] and n > 0
        used[at] += n
        done[doc] += n
    assert used == rooms and done == lengths


def test_costs_are_even():
    lengths = np.random.default_rng(1).integers(20, 1500, 2000).tolist()
    cost = defaultdict(float)
    for _, _, n, at, _ in packing.balance(lengths, 4096):
        cost[at] += n + n * n / 1024
    full = np.array([cost[k] for k in range(sum(lengths) // 4096)])
    naive = np.add.reduceat(np.array(lengths) + np.square(lengths) / 1024, np.arange(0, 2000, 5))
    assert full.std() / full.mean() < 0.5 * naive.std() / naive.mean()


@pytest.mark.parametrize("text", [t for t in TEXTS if t])
def test_chunks_equal_the_tokenizer(text):
    assert [x.tolist() for x in packing.ChunkEncoder(packing.VOCABULARY)([text, text])] == [reference(text)[:-1]] * 2


def test_a_trimmed_cache_gives_the_same():
    encode = packing.ChunkEncoder(packing.VOCABULARY)
    texts = ["The quick brown. fox, jumps Over it. " + " ".join(f"w{k}x," for k in range(300)), "other Words here. w3x, W4X é"]
    first = [x.tolist() for x in encode(texts)]
    for n in (50, 7, 0):
        encode.trim(n)
        assert encode.at.known == n and [x.tolist() for x in encode(texts)] == first
