"""Approximate nearest neighbours with learned partitions: a balanced cut of a neighbour graph, and a classifier that routes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import Scratch

#: Bound of the sample that partitions and classifier are learned from; every row is indexed.
SAMPLE = 4096
#: Rows that a partition should hold, and bounds of the number of partitions.
ROWS_PER_PARTITION, LEAST_PARTITIONS, MOST_PARTITIONS = 4000, 8, 128
NEIGHBOURS = 30
#: Recall on the sample that the number of probed partitions must reach.
TARGET_RECALL = 0.93
#: Vectors of one block; a task compares one block of queries with one block of candidates.
BLOCK = 8192
SEED = 9


@dataclass
class Router:
    """A softmax classifier from a vector to partition probabilities, and how many partitions a query probes."""

    weights: np.ndarray
    bias: np.ndarray
    probes: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.bias


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k rows with the largest inner products for each row (itself excluded)."""
    out = np.empty((len(x), k), np.int64)
    for at in range(0, len(x), 1024):
        s = x[at : at + 1024] @ x.T
        s[np.arange(len(s)), at + np.arange(len(s))] = -np.inf
        out[at : at + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_cut(graph: np.ndarray, parts: int, rounds: int = 30, slack: float = 1.05, seed: int = SEED) -> np.ndarray:
    """A part for each node, parts of at most slack times the mean size, with few edges between parts.

    Starts from breadth-first order cut in equal runs; then nodes move to the part that most of their neighbours are in,
    those with most to gain first, as long as there is room, until nobody moves.
    """
    n, rng = len(graph), np.random.default_rng(seed)
    src = np.concatenate([np.repeat(np.arange(n), graph.shape[1]), graph.ravel()])
    dst = np.concatenate([graph.ravel(), np.repeat(np.arange(n), graph.shape[1])])
    order = np.argsort(src, kind="stable")
    dst, starts = dst[order], np.searchsorted(src[order], np.arange(n + 1))
    seen, line = np.zeros(n, bool), []
    for root in rng.permutation(n):
        if not seen[root]:
            seen[root], queue = True, [root]
            for node in queue:
                line.append(node)
                near = np.unique(dst[starts[node] : starts[node + 1]])
                near = near[~seen[near]]
                seen[near] = True
                queue.extend(near.tolist())
    part = np.empty(n, np.int64)
    part[line] = np.arange(n) * parts // n
    room = int(np.ceil(n / parts * slack))
    s = np.repeat(np.arange(n), np.diff(starts))
    for _ in range(rounds):
        votes = np.bincount(s * parts + part[dst], minlength=n * parts).reshape(n, parts)
        best = votes.argmax(axis=1)
        gain = votes[np.arange(n), best] - votes[np.arange(n), part]
        size, moved = np.bincount(part, minlength=parts), 0
        for node in np.argsort(-gain, kind="stable"):
            if gain[node] <= 0:
                break
            if size[best[node]] < room:
                size[part[node]] -= 1
                size[best[node]] += 1
                part[node] = best[node]
                moved += 1
        if not moved:
            break
    return part


def learn(x: np.ndarray, total: int, k: int, steps: int = 360, l2: float = 1e-2) -> Router:
    """Partitions of the sample x and the classifier; total is the number of rows that will be indexed.

    The number of probes is the smallest that finds TARGET_RECALL of the sample's own nearest rows.
    """
    n, d = x.shape
    parts = int(np.clip(total // ROWS_PER_PARTITION, LEAST_PARTITIONS, MOST_PARTITIONS))
    near = neighbour_graph(x, min(NEIGHBOURS, n - 1)) if n > parts else None
    part = balanced_cut(near, parts) if near is not None else np.arange(n) % parts
    # Soft labels: half for where a row is, half for where its neighbours are.
    y = np.zeros((n, parts))
    y[np.arange(n), part] += 1
    if near is not None:
        np.add.at(y, (np.repeat(np.arange(n), near.shape[1]), part[near].ravel()), 1 / near.shape[1])
    y /= y.sum(axis=1, keepdims=True)
    scale = 1 / max(float(np.sqrt((x * x).mean())), 1e-12)
    z, w, b = x * scale, np.zeros((d, parts)), np.zeros(parts)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        o = z @ w + b
        q = np.exp(o - o.max(axis=1, keepdims=True))
        g = q / q.sum(axis=1, keepdims=True) - y
        grad = z.T @ g / n + l2 * w
        b -= 0.5 * g.mean(axis=0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= 0.02 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    router = Router(w * scale, b, parts)
    if n > 2:
        s = router.scores(x)
        home, rank = s.argmax(axis=1), np.argsort(np.argsort(-s, axis=1), axis=1)
        # The k nearest of all rows are as near as the first k * n / total of the sample; some more are asked for, which are harder to find.
        true = neighbour_graph(x, int(np.clip(k * n // max(total, 1), min(5, n - 1), min(k, n - 1))))
        at = rank[np.repeat(np.arange(n), true.shape[1]), home[true].ravel()]
        share = np.cumsum(np.bincount(at, minlength=parts)) / len(at)
        router.probes = min(int(np.searchsorted(share, TARGET_RECALL) + 1), parts)
    return router


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(_id, _v) of the rows that take part: vectors neither null nor empty nor zero, all components finite."""
    v = F.col(vector_col)
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & fine & F.exists(v, lambda c: c != 0)).select(F.col(id_col).alias("_id"), v.cast("array<double>").alias("_v"))


def widest(rows: DataFrame) -> tuple[int, int]:
    """(rows, length of the longest vector)."""
    return tuple(rows.agg(F.count("*"), F.coalesce(F.max(F.size("_v")), F.lit(0))).first())


def padded(rows: DataFrame, dim: int) -> DataFrame:
    """Vectors of one length: shorter ones are filled up with zeros, which no inner product feels."""
    return rows.withColumn("_v", F.concat("_v", F.array_repeat(F.lit(0.0), F.lit(dim) - F.size("_v"))))


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE, probes: int | None = None, scratch: Scratch | None = None) -> DataFrame:
    """(query_id, rank, <id_col>, score): each query's k nearest rows found, by inner product in double precision.

    All rows are indexed: each goes to its most probable partition, dealt to blocks of about BLOCK vectors. A query is sent to its
    most probable partitions, and there to every block: blocks of queries are joined with blocks of vectors by the
    names of both, so a hot partition is as many keys as it has blocks. Each block gives its k best for each query, and a window takes the k best
    of those. Ties go to the smaller id; a query never finds its own id. Rows that repeat an id with the same vector count once; of
    several vectors of one id, among candidates or queries, the largest inner product counts; null ids and vectors that are null,
    zero or not finite take no part; a shorter vector counts as filled up with zeros. Other columns are ignored; empty tables give no rows.
    """
    spark, scratch = vectors.sparkSession, scratch or Scratch(vectors.sparkSession, "ann")
    kind = vectors.select(id_col).schema[0].dataType.simpleString()
    rows, asked = usable(vectors, id_col, vector_col), usable(queries, id_col, vector_col)
    total, dim = widest(rows)
    dim = max(dim, widest(asked)[1])
    if not total:
        return spark.createDataFrame([], f"query_id {kind}, rank int, {id_col} {kind}, score double")
    rows, asked = padded(rows, dim), padded(asked, dim)
    got = rows.orderBy(F.xxhash64("_id", F.lit(SEED)), "_id", "_v").limit(sample).toPandas()
    x = np.array(got["_v"].tolist(), np.float64)
    router = learn(x, total, k)
    few = probes or router.probes

    def routed(width: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for at in range(0, len(batch), 2048):
                    some = batch.iloc[at : at + 2048]
                    best = np.argsort(-router.scores(np.array(some["_v"].tolist(), np.float64)), axis=1, kind="stable")[:, :width]
                    for k in range(best.shape[1]):
                        yield some.assign(part=best[:, k].astype(np.int32))

        return run

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_id", kind="stable")
        return pd.DataFrame({"part": pdf["part"].iloc[:1], "block": pdf["block"].iloc[:1], "ids": [pdf["_id"].tolist()], "vs": [np.array(pdf["_v"].tolist(), "<f8").tobytes()]})

    def blocks(df: DataFrame, width: int, size: int, name: str) -> DataFrame:
        """One row for about ``size`` vectors of a partition: a partition is dealt to as many blocks as its count asks for."""
        sent = scratch.keep(df.dropDuplicates(["_id", "_v"]).mapInPandas(routed(width), f"_id {kind}, _v array<double>, part int"), f"{name}-routed")
        counts = {r["part"]: r["count"] for r in sent.groupBy("part").count().collect()}  # MOST_PARTITIONS rows at most
        share = F.try_element_at(F.create_map(*(F.lit(x) for p, n in counts.items() for x in (p, -(-n // size)))), F.col("part")) if counts else F.lit(1)
        groups = sent.withColumn("block", F.pmod(F.xxhash64("_id"), share)).groupBy("part", "block")
        out = scratch.keep(groups.applyInPandas(block, f"part int, block long, ids array<{kind}>, vs binary"), name)
        scratch.drop(f"{name}-routed")
        return out

    index, wanted = blocks(rows, 1, BLOCK, "index"), blocks(asked, few, BLOCK // 4, "queries").withColumnRenamed("block", "q_block")
    # Names of blocks first, then queries to each block of vectors: the last join's keys are as many as blocks of vectors.
    names = index.select("part", "block").join(wanted.select("part", "q_block"), "part")
    sent = names.join(wanted.select("part", "q_block", F.col("ids").alias("q_ids"), F.col("vs").alias("q_vs")), ["part", "q_block"])
    pairs = index.join(sent, ["part", "block"])

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for ids, vs, q_ids, q_vs in zip(batch["ids"], batch["vs"], batch["q_ids"], batch["q_vs"], strict=True):
                ids, q_ids = np.asarray(ids), np.asarray(q_ids)
                a, q = np.frombuffer(vs, "<f8").reshape(len(ids), dim), np.frombuffer(q_vs, "<f8").reshape(len(q_ids), dim)
                order = np.argsort(ids, kind="stable")
                ids, a = ids[order], a[order]
                extra = len(ids) - len(np.unique(ids))
                for at in range(0, len(q), 256):
                    s = q[at : at + 256] @ a.T
                    s[q_ids[at : at + 256, None] == ids[None, :]] = -np.inf
                    # As many more as rows repeat ids, so that k ids are left.
                    top = min(k + extra, s.shape[1])
                    bar = -np.partition(-s, top - 1, axis=1)[:, top - 1]
                    # A little below the k-th best, so that rounding in the matrix product loses no tie; exact scores follow.
                    r, c = np.nonzero((s >= (bar - 1e-9 * (1 + np.abs(bar)))[:, None]) & np.isfinite(s))
                    exact = np.einsum("ij,ij->i", q[at + r], a[c])
                    took = pd.DataFrame({"query_id": q_ids[at + r], "_id": ids[c], "score": exact}).sort_values(["query_id", "score", "_id"], ascending=[True, False, True])
                    took = took.drop_duplicates(["query_id", "_id"])
                    yield took.groupby("query_id", sort=False).head(k)

    found = pairs.mapInPandas(best, f"query_id {kind}, _id {kind}, score double").groupBy("query_id", "_id").agg(F.max("score").alias("score"))
    ranked = found.withColumn("rank", F.expr("row_number() over (partition by query_id order by score desc, _id)").cast("int")).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("_id").alias(id_col), "score")


def recall(found: DataFrame, vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> float:
    """Share of the true k nearest that were found, against brute force on the given (small) query set, in blocks.

    Without queries it is 1.
    """
    rows, asked = usable(vectors, id_col, vector_col), usable(queries, id_col, vector_col)
    dim = max(widest(rows)[1], widest(asked)[1])
    rows, asked = padded(rows, dim), padded(asked, dim).toPandas()
    if not len(asked):
        return 1.0
    q, q_ids = np.array(asked["_v"].tolist(), np.float64), asked["_id"].to_numpy()
    kind = vectors.select(id_col).schema[0].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            a, ids = np.array(batch["_v"].tolist(), np.float64), batch["_id"].to_numpy()
            if not len(ids):
                continue
            s = q @ a.T
            s[q_ids[:, None] == ids[None, :]] = -np.inf
            c = np.argsort(-s, axis=1, kind="stable")[:, : k + len(ids) - len(np.unique(ids))]
            r = np.repeat(np.arange(len(q)), c.shape[1])
            yield pd.DataFrame({"query_id": q_ids[r], "_id": ids[c.ravel()], "score": s[r, c.ravel()]})

    true = rows.dropDuplicates(["_id", "_v"]).mapInPandas(run, f"query_id {kind}, _id {kind}, score double")
    true = true.where("score > -1e300").groupBy("query_id", "_id").agg(F.max("score").alias("score")).withColumn("rank", F.expr("row_number() over (partition by query_id order by score desc, _id)")).where(F.col("rank") <= k)
    hit = true.join(found.select("query_id", F.col(id_col).alias("_id")).distinct(), ["query_id", "_id"], "left_semi").count()
    return hit / max(true.count(), 1)
