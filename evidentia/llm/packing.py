"""Cost-balanced packing of documents into training sequences of a fixed token capacity."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import as_text, kind_of

CAPACITY = 4096
END_ID = 2
VOCABULARY = "word_bpe_49k.json"
#: Tokens that are packed together at most (besides one document); a task holds no more than this.
BLOCK_TOKENS = 512 * CAPACITY
#: Chunks that a worker remembers from one task to the next.
KEPT_CHUNKS = 200_000
#: Separators that str.split takes for white space and the vocabulary's splitter does not.
SEPARATORS = "\x1c\x1d\x1e\x1f"
#: Characters that are encoded together, besides one document.
READ_CHARS = 2_000_000
#: Weights of a piece's cost: linear layers, and attention over the piece itself.
LINEAR, QUADRATIC = 1.0, 1.0 / 1024


class Chunks(dict):
    """Chunk -> index; a new chunk gets the next index and waits in ``new`` for its token ids."""

    def __init__(self):
        self.new: list[str] = []
        self.known = 0

    def __missing__(self, chunk: str) -> int:
        k = self[chunk] = self.known + len(self.new)
        self.new.append(chunk)
        return k


class ChunkEncoder:
    """Token ids of whole texts; each distinct chunk between white space is encoded once.

    White space never joins tokens in this vocabulary (its normaliser folds white space and case, its splitter drops
    white space), so texts are cut there. ASCII chunks are taken in lower case and without a final stop or comma, which
    that splitter parts from letters and digits.
    """

    def __init__(self, vocabulary: str, most_chunks: int = 900_000):
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(public_tokenizers.path(vocabulary)), most_chunks
        self.clear()

    def clear(self) -> None:
        self.at = Chunks()
        self.ids, self.starts, self.counts = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def trim(self, chunks: int = KEPT_CHUNKS) -> None:
        """Keeps the chunks met first, which are the frequent ones."""
        if self.at.known > chunks:
            kept = Chunks()
            kept.update((c, k) for c, k in self.at.items() if k < chunks)
            kept.known = chunks
            self.at, self.starts, self.counts = kept, self.starts[:chunks].copy(), self.counts[:chunks].copy()
            self.ids = self.ids[: int((self.starts + self.counts).max(initial=0))].copy()

    def gather(self, which: np.ndarray) -> np.ndarray:
        counts = self.counts[which]
        ends = np.cumsum(counts)
        return self.ids[np.repeat(self.starts[which] - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)]

    def learn(self) -> None:
        """Token ids for the waiting chunks: encoded together, or made from those of their lower case or stem."""
        at, first, plain, odd, same, ends = self.at, self.at.known, [], [], [], []
        for chunk in at.new:  # grows meanwhile
            k = at[chunk]
            if "<|" in chunk:
                odd.append((k, chunk))
            elif not chunk.isascii():
                plain.append((k, chunk))
            elif (low := chunk.lower())[-1] in ".," and low[-2:-1].isalnum():
                ends.append((k, at[low[:-1]], at[low[-1]]))
            elif low != chunk:
                same.append((k, at[low]))
            else:
                plain.append((k, chunk))
        n = first + len(at.new)
        self.starts, self.counts = np.concatenate([self.starts, np.zeros(n - first, np.int64)]), np.concatenate([self.counts, np.zeros(n - first, np.int64)])
        if plain:
            chunks = [x for _, x in plain]
            joined = self.tokenizer.encode(" ".join(chunks), add_special_tokens=False)
            begins = np.fromiter((x[0] for x in joined.offsets), np.int64, len(joined.ids))
            cuts = np.searchsorted(begins, np.concatenate([[0], np.cumsum(np.fromiter(map(len, chunks), np.int64, len(chunks)) + 1)]))
            self.put([k for k, _ in plain], np.array(joined.ids, "<u4"), np.diff(cuts))
        for k, chunk in odd:
            own = np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4")
            self.put([k], own, np.array([len(own)]))
        if same:
            to, of = np.array(same).T
            self.starts[to], self.counts[to] = self.starts[of], self.counts[of]
        if ends:
            to, stem, stop = np.array(ends).T
            self.put(to, self.gather(np.stack([stem, stop], axis=1).ravel()), self.counts[stem] + self.counts[stop])
        at.known, at.new = n, []

    def put(self, to, ids: np.ndarray, counts: np.ndarray) -> None:
        self.starts[to], self.counts[to] = len(self.ids) + np.cumsum(counts) - counts, counts
        self.ids = np.concatenate([self.ids, ids])

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.at) > self.most:
            self.clear()
        every = [[y for y in x.replace("\n", " ").split(" ") if y] if any(c in x for c in SEPARATORS) else x.split() for x in texts]
        sizes = np.fromiter(map(len, every), np.int64, len(every))
        which = np.fromiter(map(self.at.__getitem__, chain.from_iterable(every)), np.int64, int(sizes.sum()))
        if self.at.new:
            self.learn()
        ends = np.concatenate([[0], np.cumsum(self.counts[which])])[np.cumsum(sizes)]
        return np.split(self.gather(which), ends[:-1])


ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(vocabulary: str) -> ChunkEncoder:
    """One for each worker process and vocabulary."""
    if vocabulary not in ENCODERS:
        ENCODERS[vocabulary] = ChunkEncoder(vocabulary)
    return ENCODERS[vocabulary]


def bins_for(total: int, capacity: int) -> list[int]:
    """Capacities that add up to total: full sequences, then powers of two (which need no padding)."""
    rest = total % capacity
    return [capacity] * (total // capacity) + [1 << k for k in range(capacity.bit_length(), -1, -1) if rest >> k & 1]


def balance(lengths: list[int], capacity: int, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) for each piece of documents of the given token counts.

    Descending documents go to the lowest-cost sequence that still has room for them. Documents longer than a sequence
    first give whole sequences. A document that fits nowhere is cut: it fills the lowest-cost sequence with room, and
    what is left goes on. Capacities add up to the tokens, so that all sequences end up full. Ties: smaller index.
    """
    room = np.array(bins_for(sum(lengths), capacity), dtype=np.int64)
    cost, used = np.zeros(len(room)), np.zeros(len(room), dtype=np.int64)
    pieces: list[tuple[int, int, int, int, int]] = []
    first = 0

    def put(doc: int, start: int, n: int, at: int) -> None:
        pieces.append((doc, start, n, at, int(used[at])))
        used[at] += n
        room[at] -= n
        cost[at] += linear * n + quadratic * n * n

    rests: list[tuple[int, int, int]] = []
    for doc, n in enumerate(lengths):
        start = 0
        while n - start >= capacity:
            put(doc, start, capacity, first)
            first, start = first + 1, start + capacity
        if n > start:
            rests.append((n - start, doc, start))
    for n, doc, start in sorted(rests, key=lambda x: (-x[0], x[1])):
        while n:
            fits = np.flatnonzero(room >= n)
            where = fits if len(fits) else np.flatnonzero(room > 0)
            at = int(where[np.argmin(cost[where])])
            take = int(min(n, room[at]))
            put(doc, start, take, at)
            start, n = start + take, n - take
    return pieces


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str = VOCABULARY, end_id: int = END_ID, block_tokens: int = BLOCK_TOKENS, with_ids: bool = True) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, unless with_ids is False, token ids.

    Works on each input partition by itself, without a shuffle: blocks of up to block_tokens tokens are packed at a
    time, so a task's memory is bounded and no count of documents matters. A task that runs again after a loss makes
    the same sequences. Null texts count as empty and give one end token; repeated rows are packed as often as they
    come; null ids are kept; other columns are ignored; an empty table gives no rows.
    """
    columns = ["_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    schema = "_id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        encode, high, sequences = encoder(vocabulary), TaskContext.get().partitionId() << 36, 0
        held: list[tuple[object, np.ndarray]] = []
        tokens = 0

        def flush() -> pd.DataFrame:
            nonlocal sequences, tokens
            pieces = balance([len(x) for _, x in held], capacity)
            rows = []
            for doc, start, n, at, offset in pieces:
                key, ids = held[doc]
                part = ids[start : start + n]
                rows.append((key, start, n, zlib.crc32(part.tobytes()), len(ids), high + sequences + at, offset) + ((part.view(np.int32),) if with_ids else ()))
            sequences += max((p[3] for p in pieces), default=-1) + 1
            held.clear()
            tokens = 0
            return pd.DataFrame(rows, columns=columns).astype({"_id": "object"})

        for batch in batches:
            keys, texts = batch["_id"].array, batch["_text"].array
            ends = np.cumsum([len(x) for x in texts]) // READ_CHARS
            for at in np.unique(ends):
                rows = np.flatnonzero(ends == at)
                for k, ids in zip(rows, encode([texts[k] for k in rows]), strict=True):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    held.append((None if pd.isna(keys[k]) else keys[k], ids))
                    tokens += len(ids)
                    if tokens >= block_tokens:
                        yield flush()
        if held:
            yield flush()
        encode.trim()  # the worker may serve other jobs next

    sent = docs.select(as_text(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    return sent.mapInPandas(run, schema).select(F.col("_id").cast(kind_of(docs, id_col)).alias(id_col), *columns[1:])


def report(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: sequences, tokens, padding tokens (a sequence whose length is a power of two needs none), how many sequences are
    shorter than the capacity and how many tokens they hold, and cost spread."""
    n = F.sum("length").alias("n")
    cost = F.sum(F.col("length") * LINEAR + F.col("length") * F.col("length") * QUADRATIC).alias("cost")
    per = pieces.groupBy("sequence_id").agg(n, cost)
    padded = F.when(F.col("n").bitwiseAND(F.col("n") - 1) == 0, 0).otherwise(capacity - F.col("n"))
    return per.agg(F.count("*").alias("sequences"), F.sum("n").alias("tokens"), F.sum(padded).alias("padding"), F.count_if(F.col("n") < capacity).alias("short_sequences"), F.sum(F.when(F.col("n") < capacity, F.col("n")).otherwise(0)).alias("short_tokens"), F.max("cost").alias("max_cost"), F.avg("cost").alias("mean_cost"))
