"""Which texts of a table are part of others (X6 and X7 over a whole table): candidates by hashes of beginnings, then checked."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A text is looked for by its first bytes, as many as the largest of these that it has: all of them up to 24, four fifths at least beyond.
LEVELS = [*range(1, 25)]
while LEVELS[-1] < 1 << 30:
    LEVELS.append(LEVELS[-1] * 5 // 4)
#: Keys of at most so many bytes are whole texts; one of 24 bytes may be the beginning of a text of up to 29.
WHOLE = 23
#: Beginnings of so many bytes are known, too: where none of them stands, no longer one is looked for.
STEPS = [2, 3, 4, 6, 8, 12, 16, 24]
#: A bitmap of 2 ** BITS bits (16 MB), or of up to 2 ** MOST_BITS (128 MB) for many texts, tells hashes that are looked for from others.
BITS, MOST_BITS, BITMAP = 27, 30, 32768
#: Bytes hashed at a time, and containers that are tried first for each hash.
SLICE, HUBS = 1 << 20, 4

PRIME, MIX = 0x100000001B3, np.uint64(0x9E3779B97F4A7C15)
#: What tells the hashes of a text's key, of its beginnings and the second bit of a key apart.
KEY, STEP, AGAIN = np.uint64(0), np.uint64(1 << 40), np.uint64(1 << 41)


def mixed(x: np.ndarray, salt: np.uint64) -> np.ndarray:
    x = (x + salt) * MIX
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(32))) >> np.uint64(1)


class Hashes:
    """Hashes of any run of bytes of data, from running sums of the bytes times powers of a prime."""

    def __init__(self, data: np.ndarray):
        powers = lambda base: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(data), base, np.uint64)]))
        self.up, down = powers(PRIME), powers(pow(PRIME, -1, 1 << 64))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data + np.uint64(1)) * down[:-1])])

    def of(self, at: np.ndarray, length: int) -> np.ndarray:
        return (self.sums[at + length] - self.sums[at]) * self.up[at] + np.uint64(length)


def slices(batch: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, bytes of the texts one after the other, their lengths) for a few megabytes at a time."""
    texts = [t.encode() for t in batch["text"]]
    ids, at = batch["id"].to_numpy(np.int64), 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= SLICE):
            size += len(texts[end])
            end += 1
        yield ids[at:end], np.frombuffer(b"".join(texts[at:end]), np.uint8).astype(np.uint64), np.array([len(t) for t in texts[at:end]])
        at = end


def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(id, h) of (id, text): the one hash that a text is looked for by."""
    for batch in batches:
        for ids, data, sizes in slices(batch):
            starts, hashes = np.cumsum(sizes) - sizes, Hashes(data)
            out, level = np.zeros(len(ids), np.int64), np.searchsorted(LEVELS, sizes, "right") - 1
            for k in np.unique(level):
                own = level == k
                out[own] = mixed(hashes.of(starts[own], LEVELS[k]), KEY).astype(np.int64)
            yield pd.DataFrame({"id": ids, "h": out})


def marks(bits: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """(bit) of (id, text): the bits of a text's key, two of them, and of its beginnings; each once for a few megabytes of text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, data, sizes in slices(batch):
                starts, hashes, level = np.cumsum(sizes) - sizes, Hashes(data), np.searchsorted(LEVELS, sizes, "right") - 1
                found = [mixed(hashes.of(starts[level == k], LEVELS[k]), salt) for k in np.unique(level) for salt in (KEY, AGAIN)]
                found += [mixed(hashes.of(starts[sizes >= n], n), STEP) for n in STEPS]
                yield pd.DataFrame({"bit": np.unique(np.concatenate(found) & np.uint64((1 << bits) - 1)).astype(np.int64)})

    return run


def standing(bitmap: np.ndarray, bits: int, levels: list[int], data: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(length, numbers of texts, places, keys) where a key that is looked for stands in one of the texts that data holds one after the other."""

    def known(h: np.ndarray) -> np.ndarray:
        at = h & np.uint64((1 << bits) - 1)
        return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1

    hashes, which, ends, at = Hashes(data), np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes), np.arange(len(data))
    for n in sorted({*levels, *STEPS}):
        at = at[at + n <= ends[which[at]]]
        if not len(at):
            return
        h = hashes.of(at, n)
        if n in levels:
            key = mixed(h, KEY)
            hit = np.flatnonzero(known(key))
            hit = hit[known(mixed(h[hit], AGAIN))]
            yield n, which[at[hit]], at[hit], key[hit].astype(np.int64)
        if n in STEPS:
            at = at[known(mixed(h, STEP))]


def places(sought: Broadcast, bits: int, levels: list[int]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """(id, h) of (id, text): keys of shorter texts that stand in the text. levels are the lengths of keys."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bitmap = np.frombuffer(sought.value, np.uint8)
        for batch in batches:
            for ids, data, sizes in slices(batch):
                found = [np.stack([text, key], axis=1)[sizes[text] > n] for n, text, _, key in standing(bitmap, bits, levels, data, sizes)]
                if found:
                    rows = np.unique(np.concatenate(found), axis=0)
                    yield pd.DataFrame({"id": ids[rows[:, 0]], "h": rows[:, 1]})

    return run


def firsts(sought: Broadcast, bits: int, levels: list[int]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """(found, h, para, sent_id) of (para, sent_id, sentence): where a key of at most WHOLE bytes stands, its bytes and the first of a batch; longer keys in every sentence."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bitmap = np.frombuffer(sought.value, np.uint8)
        for batch in batches:
            batch = batch.sort_values(["para", "sent_id"], ignore_index=True)
            short, long_ = {}, []
            for ids, data, sizes in slices(pd.DataFrame({"id": np.arange(len(batch)), "text": batch["sentence"]})):
                raw = data.astype(np.uint8).tobytes()
                for n, text, at, key in standing(bitmap, bits, levels, data, sizes):
                    if n <= WHOLE:
                        # Places rise, so the first of each key comes first; keys of other bytes with the same hash are told apart.
                        segments = np.lib.stride_tricks.sliding_window_view(np.frombuffer(raw, np.uint8), n)[at]
                        codes, first = pd.factorize(key)[0], np.flatnonzero(~pd.Series(key).duplicated().to_numpy())
                        other = np.flatnonzero((segments != segments[first][codes]).any(axis=1)) if len(first) else first
                        for i in [*first, *other]:
                            short.setdefault(raw[at[i] : at[i] + n], ids[text[i]])
                    else:
                        rows = np.unique(np.stack([ids[text], key], axis=1), axis=0)
                        long_.append(rows)
            rows = np.concatenate([np.zeros((0, 2), np.int64), *long_])
            at = np.concatenate([np.array(list(short.values()), np.int64), rows[:, 0]])
            out = pd.DataFrame({"found": [*short, *[None] * len(rows)], "h": [*[0] * len(short), *rows[:, 1]]})
            yield out.assign(para=batch["para"].to_numpy()[at], sent_id=batch["sent_id"].to_numpy()[at])

    return run


def bitmap_of(marked: DataFrame, bits: int) -> bytes:
    """The bounded bitmap of (bit), made on the executors in parts of 4 KB: bits are dealt by their part first, so that no task holds them all."""
    bit = marked.select((F.col("bit") + 1).alias("bit")).withColumn("bucket", F.bitmap_bucket_number("bit")).repartition("bucket")
    parts = bit.groupBy("bucket").agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    out = bytearray((1 << bits) // 8)
    for r in parts.toLocalIterator():
        at = (r["bucket"] - 1) * BITMAP // 8
        out[at : at + len(r["bits"])] = r["bits"]
    return bytes(out)


def containment(texts: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """(text, maximal, minimal) of the distinct texts: X6, no other text holds it; X7, it holds no other.

    Each text is looked for by one hash, of its beginning (up to 24 bytes: of the whole text), at all places of all texts where such a
    beginning may stand. Only hashes that some text is looked for by are shuffled, without texts. Each text is first compared with one that it
    may be part of, and with one that may be part of it; then texts that share a hash with the longest, or the shortest, of them; what that
    leaves open is compared with the others. Every candidate is checked by its text. Null and empty texts are left out, since an empty one is
    part of all; an empty table gives no rows. Steps are written below path.
    """
    spark = texts.sparkSession

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{path}/{name}")
        return spark.read.schema(df.schema).parquet(f"{path}/{name}")

    own = texts.select(F.col(text_col).alias("text")).where("text <> ''").distinct()
    own = kept(own.select(F.monotonically_increasing_id().alias("id"), "text", F.octet_length("text").alias("n")), "texts")
    sought = kept(own.select("id", "text").mapInPandas(keys, "id long, h long").join(own.select("id", "n"), "id"), "keys")
    count, most = own.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(0))).first()
    bits = min(max(BITS, (32 * count).bit_length()), MOST_BITS)
    # A text beyond the longest cannot be asked for: some seventy lengths for texts of a megabyte.
    levels = [n for n in LEVELS if n <= most]
    bitmap = spark.sparkContext.broadcast(bitmap_of(own.select("id", "text").mapInPandas(marks(bits), "bit long"), bits))
    found = own.select("id", "text").mapInPandas(places(bitmap, bits, levels), "id long, h long")
    held = kept(found.join(sought.select("h").distinct(), "h", "left_semi").join(own.select("id", "n"), "id"), "places")

    part, whole = sought.select("h", F.col("id").alias("part"), F.col("n").alias("part_n")), held.select("h", F.col("id").alias("whole"), F.col("n").alias("whole_n"))
    at = lambda side: own.select(F.col("id").alias(side), F.col("text").alias(f"{side}_text"))

    def checked(pairs: DataFrame) -> DataFrame:
        """Pairs (part, whole) of which the one holds the other."""
        real = pairs.where("part_n < whole_n").select("part", "whole").distinct().join(at("part"), "part").join(at("whole"), "whole")
        return real.where(F.col("whole_text").contains(F.col("part_text"))).select("part", "whole")

    def less(rows: DataFrame, side: str, done: list[DataFrame]) -> DataFrame:
        """rows without those of the ids that are done."""
        for d in done:
            rows = rows.join(d.select(F.col("id").alias(side)), side, "left_anti")
        return rows

    longest = whole.withColumn("r", F.expr("row_number() over (partition by h order by whole_n desc, whole)")).where(F.col("r") <= HUBS)
    shortest = part.withColumn("r", F.expr("row_number() over (partition by h order by part_n, part)")).where(F.col("r") <= HUBS)
    # One candidate for each text is nearly always enough.
    first = part.join(longest.where("r = 1"), "h").where("part_n < whole_n").select("part", "part_n", "whole", "whole_n")
    inside = [kept(checked(first).select(F.col("part").alias("id")).distinct(), "inside-0")]
    least = shortest.where("r = 1").join(whole, "h").where("part_n < whole_n").groupBy("whole", "whole_n").agg(F.min(F.struct("part_n", "part")).alias("p")).select("whole", "whole_n", "p.part", "p.part_n")
    holds = [kept(checked(least).select(F.col("whole").alias("id")).distinct(), "holds-0")]
    inside.append(kept(checked(less(part, "part", inside).join(longest, "h")).select(F.col("part").alias("id")).distinct(), "inside-1"))
    holds.append(kept(checked(shortest.join(less(whole, "whole", holds), "h")).select(F.col("whole").alias("id")).distinct(), "holds-1"))
    inside.append(checked(less(part, "part", inside).join(whole, "h")).select(F.col("part").alias("id")).distinct())
    holds.append(checked(less(whole, "whole", holds).join(part, "h")).select(F.col("whole").alias("id")).distinct())
    in_, with_ = (inside[0].union(inside[1]).union(inside[2]).withColumn("inside", F.lit(True)), holds[0].union(holds[1]).union(holds[2]).withColumn("holds", F.lit(True)))
    out = own.select("id", "text").join(in_, "id", "left").join(with_, "id", "left")
    return out.select("text", F.col("inside").isNull().alias("maximal"), F.col("holds").isNull().alias("minimal"))
