"""Phrase collocations by prefix-free parsing: a dictionary of content-triggered chunks, whose n-grams are counted once for each distinct chunk."""

from __future__ import annotations

import operator
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import Scratch

#: Words of the longest phrase, and what a candidate's count must reach.
LONGEST, LEAST = 5, 100
#: Words that chunks overlap by: the trigger, one fewer than the longest phrase, so that each phrase lies whole in the chunk it begins in.
OVERLAP = LONGEST - 1
#: One window in so many is a trigger.
EVERY = 16
#: A candidate goes if a longer one that holds it has so many in 100 of its occurrences.
SHARE = 100
#: Phrases returned for each language.
TOP = 2000
#: A filter of 2 ** BITS bits (16 MB) says which phrases may be frequent. With more frequent phrases it lets more through; counts stay exact.
BITS = 27
#: Words that a task holds at a time, about.
SLICE = 1 << 20
#: Languages are broadcast with their word counts up to so many.
BROADCAST_LANGS = 100_000
#: Bits of one bitmap of Spark's bitmap functions.
BITMAP = 32768

BLANKS, STRIP = re.compile(" +"), operator.methodcaller("strip", " ")
#: On bytes: ends of pieces become line ends, tabs become blanks, A-Z is lower-cased. None of these bytes is part of another character.
CUTS = bytes.maketrans(b".,;:!?\x0b\x0c\r\tABCDEFGHIJKLMNOPQRSTUVWXYZ", b"\n\n\n\n\n\n\n\n\n abcdefghijklmnopqrstuvwxyz")


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def rolled(h: np.ndarray, width: int) -> np.ndarray:
    """The hash of width words from each place on."""
    n, out = max(len(h) - width + 1, 0), np.zeros(max(len(h) - width + 1, 0), np.uint64)
    for k in range(width):
        out = mixed(out * np.uint64(0x100000001B3) + h[k : k + n])
    return out


def pieces(text: str | None) -> list[str]:
    """The pieces of a text that hold words, with one blank between words."""
    text = (text or "").encode().translate(CUTS).decode()
    if "  " in text:
        text = BLANKS.sub(" ", text)
    return [p for p in map(STRIP, text.split("\n")) if p]


class Words:
    """The words of texts with one blank between words, one after the other: codes into vocab, and how many each text has."""

    def __init__(self, texts: pa.Array):
        lists = pc.split_pattern(texts.cast(pa.string()), " ")
        self.sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        encoded = lists.flatten().dictionary_encode()
        self.vocab, self.codes = encoded.dictionary, encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.which = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.ends = np.cumsum(self.sizes)

    def hashes(self) -> np.ndarray:
        """A hash of each word, the same in every process."""
        return np.array([hashed(w) for w in self.vocab.to_pylist()], np.uint64)[self.codes]


def hashed(word: str) -> int:
    return (zlib.crc32(word.encode("utf-8", "surrogatepass")) + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF


def chunks(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, piece, whether it is the piece's last) of the chunks of pieces.

    Each chunk ends with the trigger that the next one begins with.
    """
    n = len(words.codes)
    windows = rolled(words.hashes(), OVERLAP)
    starts = np.zeros(n, bool)
    starts[: len(windows)] = windows % np.uint64(EVERY) == 0
    starts &= np.arange(n) + OVERLAP <= words.ends[words.which]
    starts[words.ends - words.sizes] = True
    start = np.flatnonzero(starts)
    piece = words.which[start]
    last = np.append(piece[1:] != piece[:-1], True)
    end = np.where(last, words.ends[piece], np.append(start[1:], 0) + OVERLAP)
    return start, end, piece, last


def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(lang, chunk, last, n) of (lang, text): chunks with their counts in a slice of the batch. Equal pieces of a slice are cut once."""
    for batch in batches:
        found, size = {}, 0
        for lang, text in zip(batch["lang"], batch["text"], strict=True):
            own = pieces(text)
            found.setdefault(lang, Counter()).update(own)
            size += len(own)
            if size >= SLICE // 4:
                yield from cut(found)
                found, size = {}, 0
        if size:
            yield from cut(found)


def cut(found: dict[str, Counter]) -> Iterator[pd.DataFrame]:
    """The chunks of the pieces of each language."""
    for lang, counts in found.items():
        if not counts:
            continue
        own, n = list(counts), list(counts.values())
        words = Words(pa.array(own, pa.string()))
        start, end, piece, last = chunks(words)
        # Most pieces are one chunk, which is the piece itself.
        rows = Counter()
        for k in np.flatnonzero(np.bincount(piece, minlength=len(own)) == 1).tolist():
            rows[own[k], True] = n[k]
        some = np.flatnonzero(np.bincount(piece, minlength=len(own))[piece] > 1)
        offset, at, split = (words.ends - words.sizes)[piece[some]], -1, []
        for a, b, k, done in zip((start[some] - offset).tolist(), (end[some] - offset).tolist(), piece[some].tolist(), last[some].tolist(), strict=True):
            if k != at:
                at, split = k, own[k].split(" ")
            rows[" ".join(split[a:b]), done] += n[k]
        keys = list(zip(*rows, strict=True))
        yield pd.DataFrame({"lang": lang, "chunk": keys[0], "last": keys[1], "n": list(rows.values())})


def grams(widths: tuple[int, ...], sure: int, frequent: Broadcast | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(lang, phrase, m, f) of the dictionary: phrases of m words, for m in widths, that begin in a chunk's own part, times the chunk's count.

    frequent is the filter of phrases of ``sure`` words: a phrase can only be frequent if all its parts of that length are, so others are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if frequent is None else np.frombuffer(frequent.value, np.uint8)
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= SLICE // 8:
                yield from of_slice(pa.Table.from_batches(held).combine_chunks(), bits)
                held, rows = [], 0
        if rows:
            yield from of_slice(pa.Table.from_batches(held).combine_chunks(), bits)

    def of_slice(part: pa.Table, bits: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        column = lambda name: part.column(name).combine_chunks() if part.column(name).num_chunks != 1 else part.column(name).chunk(0)
        words, langs = Words(column("chunk")), column("lang").cast(pa.string()).dictionary_encode()
        lang, n = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64), column("n").to_numpy(zero_copy_only=False).astype(np.int64)
        code, which, size = words.codes, words.which, words.sizes[words.which]
        place = np.arange(len(code)) - (words.ends - words.sizes)[which]
        begins = place < np.where(column("last").to_numpy(zero_copy_only=False), words.sizes, words.sizes - OVERLAP)[which]
        may = None
        if bits is not None:
            salt = np.array([hashed(x) for x in langs.dictionary.to_pylist()], np.uint64)[lang][which]
            may = holds(bits, mixed(rolled(words.hashes(), sure) + salt[: max(len(code) - sure + 1, 0)]))
        for width in widths:
            good = begins & (place + width <= size)
            if may is not None:
                all_of = np.zeros(len(code), bool)
                fits = max(len(code) - width + 1, 0)
                all_of[:fits] = np.logical_and.reduce([may[k : k + fits] for k in range(width - sure + 1)])
                good &= all_of
            spots = np.flatnonzero(good)
            if not len(spots):
                continue
            # Codes of words make the exact number of a phrase; before it passes 64 bits, the numbers met are renamed.
            key = lang[which[spots]]
            for k in range(width):
                if int(key.max() + 1) * len(words.vocab) >= 2**62:
                    _, key = np.unique(key, return_inverse=True)
                key = key * len(words.vocab) + code[spots + k]
            sums = pa.table({"key": key, "f": n[which[spots]], "p": spots}).group_by("key").aggregate([("f", "sum"), ("p", "min")])
            first = sums.column("p_min").to_numpy()
            phrase = words.vocab.take(pa.array(code[first]))
            if width > 1:
                phrase = pc.binary_join_element_wise(*(words.vocab.take(pa.array(code[first + k])) for k in range(width)), " ")
            yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(lang[which[first]])), phrase, pa.array(np.full(len(first), width, np.int32)), sums.column("f_sum").combine_chunks()], ["lang", "phrase", "m", "f"])

    return run


def places(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of a phrase in the filter."""
    return (h >> np.uint64(64 - BITS)).astype(np.int64), ((h >> np.uint64(8)) & np.uint64((1 << BITS) - 1)).astype(np.int64)


def holds(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    one, two = places(h)
    return ((bits[one >> 3] >> (one & 7).astype(np.uint8)) & (bits[two >> 3] >> (two & 7).astype(np.uint8)) & 1).astype(bool)


def marked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The bits that the phrases (lang, phrase), all of one length, set."""
    for batch in batches:
        if not len(batch):
            continue
        words = Words(pa.array(batch["phrase"], pa.string()))
        width = int(words.sizes[0])
        salt = np.array([hashed(x) for x in batch["lang"]], np.uint64)
        yield pd.DataFrame({"bit": np.concatenate(places(mixed(rolled(words.hashes(), width)[::width] + salt)))})


def filter_of(counts: DataFrame) -> bytes:
    """A bounded filter of phrases of one length: 2 ** BITS bits, made on the executors as bitmaps of 4 KB that are joined here."""
    bits = counts.select("lang", "phrase").mapInPandas(marked, "bit long").select((F.col("bit") + 1).alias("bit"))
    maps = bits.groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    out = bytearray((1 << BITS) // 8)
    for r in maps.toLocalIterator():
        at = (r["bucket"] - 1) * BITMAP // 8
        out[at : at + len(r["bits"])] = r["bits"]
    return bytes(out)


def counts_of(dictionary: DataFrame, widths: tuple[int, ...], least: int, shorter: DataFrame | None = None, sure: int = 0) -> DataFrame:
    """(lang, phrase, m, f) of the phrases of m words, m in widths, with f >= least; shorter: those of ``sure`` words."""
    bits = None if shorter is None else dictionary.sparkSession.sparkContext.broadcast(filter_of(shorter))
    rows = dictionary.mapInArrow(grams(widths, sure, bits), "lang string, phrase string, m int, f long")
    return rows.groupBy("lang", "phrase", "m").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def mine(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, share: int = SHARE, top: int = TOP, scratch: Scratch | None = None) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's strongest phrases of 2 to 5 words.

    Texts are cut into pieces and words; a piece is cut into chunks that overlap by a trigger, a run of words whose hash says so, and
    the dictionary of distinct chunks has their frequencies, so copies and shared passages are counted once however often they
    occur. A phrase belongs to the chunk it begins in, ahead of the overlap, so none is counted twice. Phrases of three words
    are only taken up if their pairs may be frequent, longer ones if their triples may. Null and empty texts have no words; a null
    language is ``und``; repeated rows count as often as they occur; ties go to the smaller phrase; without candidates there are
    no rows. Other columns are ignored.
    """
    scratch = scratch or Scratch(docs.sparkSession, "collocations")
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    parts = rows.mapInPandas(parse, "lang string, chunk string, last boolean, n long")
    dictionary = scratch.keep(parts.groupBy("lang", "chunk", "last").agg(F.sum("n").alias("n")), "dictionary")
    own = F.size(F.split("chunk", " ")) - F.when(F.col("last"), 0).otherwise(OVERLAP)
    langs = scratch.keep(dictionary.groupBy("lang").agg(F.sum(F.col("n") * own).alias("n")), "langs")
    if langs.count() <= BROADCAST_LANGS:
        langs = F.broadcast(langs)
    # Words and pairs first; then triples of frequent pairs, and what is longer of frequent triples.
    one_two = scratch.keep(counts_of(dictionary, (1, 2), least), "count2")
    three = scratch.keep(counts_of(dictionary, (3,), least, one_two.where("m = 2"), 2), "count3")
    longer = scratch.keep(counts_of(dictionary, tuple(range(4, LONGEST + 1)), least, three, 3), "count4")
    scratch.drop("dictionary")
    every = one_two.unionByName(three).unionByName(longer)
    words = F.split("phrase", " ")
    phrases = every.withColumn("w", words).where(F.size("w") > 1)
    # Counts fall with length, so what a longer phrase of any length takes, one a word longer takes too.
    inner = phrases.where(F.size("w") > 2).select("lang", "f", F.explode(F.array(F.array_join(F.slice("w", F.lit(1), F.size("w") - 1), " "), F.array_join(F.slice("w", F.lit(2), F.size("w") - 1), " "))).alias("phrase"))
    longer = inner.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    left = phrases.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("f"))).select("lang", "phrase", F.col("f").alias("a"), "w")
    cut = left.select("lang", "phrase", "a", "w", F.explode(F.expr("sequence(1, size(w) - 1)")).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("head"), F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ").alias("rest"))
    heads, rests = every.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), every.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    cut = cut.join(heads, ["lang", "head"]).join(rests, ["lang", "rest"]).join(langs, "lang")
    score = F.expr("(cast(1000 as decimal(4, 0)) * cast(a as decimal(16, 0)) * cast(n as decimal(16, 0))) div (cast(l as decimal(16, 0)) * cast(r as decimal(16, 0)))")
    worst = cut.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("m"))
    ranked = worst.select("lang", "phrase", "a", "m.l", "m.r", "n", "m.score").withColumn("rank", F.expr("row_number() over (partition by lang order by score desc, a desc, phrase)").cast("long"))
    return ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def oracle() -> str:
    """The same rows as DuckDB SQL: all phrases of all pieces counted, all longer candidates looked at."""
    return f"""
    WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents),
    w AS (SELECT lang, list_filter(string_split_regex(p, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM p),
    g AS (SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i : i + m - 1], ' '))) AS phrase FROM w, range(1, {LONGEST + 1}) t(m) WHERE len(w) >= m),
    c AS (SELECT lang, phrase, any_value(m) AS m, count(*) AS f FROM g GROUP BY lang, phrase), n AS (SELECT lang, sum(f)::BIGINT AS n FROM c WHERE m = 1 GROUP BY lang),
    q AS (SELECT lang, phrase, m, f AS a FROM c WHERE m > 1 AND f >= {LEAST}),
    k AS (SELECT * FROM q WHERE NOT EXISTS (SELECT 1 FROM q o WHERE o.lang = q.lang AND o.m > q.m AND contains(' ' || o.phrase || ' ', ' ' || q.phrase || ' ') AND 100 * o.a >= {SHARE} * q.a)),
    cuts AS (SELECT *, string_split(phrase, ' ') AS w, unnest(range(1, m)) AS k FROM k),
    s AS (SELECT cuts.lang, cuts.phrase, a, x.f AS l, y.f AS r, n.n, k, (1000::HUGEINT * a * n.n) // (x.f::HUGEINT * y.f) AS score FROM cuts JOIN n ON n.lang = cuts.lang
      JOIN c x ON x.lang = cuts.lang AND x.phrase = array_to_string(w[1 : k], ' ') JOIN c y ON y.lang = cuts.lang AND y.phrase = array_to_string(w[k + 1 : cuts.m], ' ')),
    b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score::BIGINT AS score FROM b
    QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) <= {TOP}"""
