"""Toxicity by cumulative-link ordinal regression over sparse text features."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import free_name, labelled_sample

#: Bound of the labelled sample that the classifier is fitted to, and the share of it that is held out for the threshold.
MAX_LABELLED = 12_000
HELD_OUT = 0.25
BUCKETS = 1 << 18
#: Beginnings of words that are features beside the words themselves, so that compounds and inflections share them.
BEGINNINGS = (4, 5, 6, 7)
GRADES = 4
LEAST_DF = 4
#: Words enter the regression if their log-odds differ by so many deviations; telling words, which grade binary labels, by so many.
ENTER_Z, SURE_Z = 3.0, 4.0
SEED = 17
WORD = re.compile(r"[^\W\d_]+")


class Buckets(dict):
    """Word -> hash buckets of it and its beginnings, remembered for each worker up to a bound."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > 60_000:
            self.clear()
        parts = [word, *(word[:n] + "*" for n in BEGINNINGS if len(word) > n)]
        found = self[word] = tuple(zlib.crc32(x.encode("utf-8", "surrogatepass")) % BUCKETS for x in parts)
        return found


def features(text: str, buckets: Buckets) -> np.ndarray:
    """The distinct buckets of the whole text's lower-cased words and their beginnings."""
    found = set().union(*map(buckets.__getitem__, set(WORD.findall(text.lower()))))
    return np.sort(np.fromiter(found, np.int32, len(found)))


class Weighted(dict):
    """Word -> those of its buckets that have a weight, remembered for each worker up to a bound. Most words have none."""

    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.weights, self.buckets = weights, Buckets()

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > 200_000:
            self.clear()
        parts = self.buckets.__missing__(word)
        self.buckets.clear()
        found = self[word] = tuple(k for k in parts if self.weights[k])
        return found

    def score(self, text: str) -> float:
        """The sum of the weights of the text's distinct buckets."""
        found = set().union(*filter(None, map(self.__getitem__, set(WORD.findall(text.lower())))))
        return float(self.weights[sorted(found)].sum(dtype=np.float64)) if found else 0.0


class Model:
    """P(grade > k) = sigmoid(w·x - b_k) with one w for all ordered thresholds b_1 < b_2 < ..."""

    def __init__(self, weights: np.ndarray, cuts: np.ndarray, threshold: float = 0.5):
        self.weights, self.cuts, self.threshold = weights.astype(np.float32), cuts, threshold

    def above(self, score: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.cuts[None, :], -40, 40)))


def ordinal_fit(rows: np.ndarray, cols: np.ndarray, n: int, grade: np.ndarray, grades: int = GRADES, rounds: int = 250, l2: float = 2e-4, rate: float = 0.08) -> Model:
    """Maximum likelihood by Adam. Thresholds stay ordered: each is the one before plus a positive step."""
    w, c = np.zeros(BUCKETS), np.concatenate([[2.0], np.zeros(grades - 2)])
    share = np.array([max((grade > k).mean(), 1e-3) for k in range(grades - 1)])
    c[0] = np.log((1 - share[0]) / share[0])
    m = [np.zeros_like(w), np.zeros_like(c)]
    v = [np.zeros_like(w), np.zeros_like(c)]
    used = np.unique(cols)
    for t in range(1, rounds + 1):
        step = np.log1p(np.exp(c[1:]))
        cuts = c[0] + np.concatenate([[0], np.cumsum(step)])
        s = np.bincount(rows, weights=w[cols], minlength=n)
        up = 1 / (1 + np.exp(-np.clip(s[:, None] - cuts, -40, 40)))  # P(grade > k)
        edge = np.concatenate([np.ones((n, 1)), up, np.zeros((n, 1))], axis=1)
        p = np.maximum(edge[np.arange(n), grade] - edge[np.arange(n), grade + 1], 1e-9)
        slope = np.concatenate([np.zeros((n, 1)), up * (1 - up), np.zeros((n, 1))], axis=1)
        d_hi, d_lo = slope[np.arange(n), grade] / p, slope[np.arange(n), grade + 1] / p
        g_s = d_lo - d_hi  # of the negative log likelihood
        g_cut = np.array([(d_hi[grade == k + 1]).sum() - (d_lo[grade == k]).sum() for k in range(grades - 1)]) / n
        g_w = np.bincount(cols, weights=g_s[rows], minlength=BUCKETS) / n + l2 * w
        tail = np.cumsum(g_cut[::-1])[::-1]
        g_c = np.concatenate([[tail[0]], tail[1:] / (1 + np.exp(-c[1:]))])
        for k, (x, g) in enumerate(((w, g_w), (c, g_c))):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            x -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    keep = np.zeros(BUCKETS, bool)
    keep[used] = True
    return Model(np.where(keep, w, 0), c[0] + np.concatenate([[0], np.cumsum(np.log1p(np.exp(c[1:])))]))


def counts(cols: np.ndarray) -> np.ndarray:
    """How often each bucket occurs, a slice at a time, since numpy widens what it counts."""
    return sum((np.bincount(cols[at : at + (1 << 20)], minlength=BUCKETS) for at in range(0, len(cols), 1 << 20)), np.zeros(BUCKETS, np.int64))


def telling(toxic: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """For each bucket, by how many standard deviations its log-odds in toxic rows differ from those in clean ones."""
    n1, n0 = max(toxic.sum(), 1), max((toxic == 0).sum(), 1)
    bad = counts(cols[(toxic > 0)[rows]])
    a, b = bad + 0.5, counts(cols) - bad + 0.5
    return (np.log(a / (n1 - a + 1)) - np.log(b / (n0 - b + 1))) / np.sqrt(1 / a + 1 / b)


def graded(toxic: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Severity grades from a binary label: 0 for clean; toxic rows are split in thirds by how many telling words they hold.

    Telling words are those whose share in toxic rows is raised beyond chance (log-odds over its deviation above SURE_Z).
    Tables with graded labels (0, 1, 2, 3) are used as they are.
    """
    if toxic.max(initial=0) > 1:
        return np.clip(toxic, 0, GRADES - 1)
    hits = np.bincount(rows, weights=(telling(toxic, rows, cols)[cols] > SURE_Z).astype(float), minlength=len(toxic))
    own = hits[toxic == 1]
    if not len(own):
        return toxic
    cuts = np.quantile(own, [1 / 3, 2 / 3])
    return np.where(toxic == 1, 1 + (hits > cuts[0]) + (hits > cuts[1]), 0).astype(np.int64)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labelled: int = MAX_LABELLED, seed: int = SEED) -> Model | None:
    """Fits to at most max_labelled labelled documents (those with the smallest hashes of their ids); None without both classes.

    Words of fewer than LEAST_DF sampled documents, and words that do not tell classes apart (ENTER_Z), are left out. The threshold on P(grade > 0) is the one with the best
    F1 on the held-out share. Only the sample's feature buckets come to the driver.
    """
    sample = labelled_sample(labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).alias("_y")), "_id", ["_y"], max_labelled, seed)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        buckets = Buckets()
        for batch in batches:
            yield pd.DataFrame({"_id": batch["_id"].astype(str), "_y": batch["_y"], "x": [features(t, buckets).tobytes() for t in batch["_text"]]})

    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    # The sample has max_labelled rows of two numbers at most: a bounded broadcast.
    own = texts.join(F.broadcast(sample), "_id").groupBy("_id", "_y").agg(F.min("_text").alias("_text"))  # a repeated id comes once
    got = own.select("_id", F.col("_y").cast("long").alias("_y"), "_text").mapInPandas(run, "_id string, _y long, x binary").toPandas()
    got = got.drop_duplicates("_id").sort_values("_id", ignore_index=True)
    y = got["_y"].to_numpy(np.int64) if len(got) else np.zeros(0, np.int64)
    if not len(y) or y.min() == y.max():
        return None
    each = [np.frombuffer(x, np.int32) for x in got["x"]]
    held = np.array([zlib.crc32(f"{seed}:{k}".encode()) % 1000 < 1000 * HELD_OUT for k in got["_id"]])
    if y[~held].min() == y[~held].max():
        held[:] = False
    train = np.flatnonzero(~held)
    rows = np.repeat(np.arange(len(train), dtype=np.int32), [len(each[k]) for k in train])
    cols = np.concatenate([each[k] for k in train])
    often = counts(cols) >= min(LEAST_DF, max(1, len(train) // 50))
    often &= np.abs(telling((y[train] > 0).astype(np.int64), rows, cols)) > ENTER_Z
    rows, cols = rows[often[cols]], cols[often[cols]]
    model = ordinal_fit(rows, cols, len(train), graded(y[train], rows, cols))
    test = np.flatnonzero(held) if held.any() else train
    p = model.above(np.array([model.weights[each[k]].sum() for k in test]))[:, 0]
    truth = y[test] > 0
    best = max(((2 * (hit := ((p >= c) & truth).sum()) / max((p >= c).sum() + truth.sum(), 1), -abs(c - 0.5), c) for c in np.round(np.arange(0.1, 0.91, 0.02), 2)), default=(0, 0, 0.5))
    model.threshold = float(best[2])
    return model


def score(docs: DataFrame, model: Model | None, text_col: str = "text", prefix: str = "") -> DataFrame:
    """docs with expected_severity (sum of P(grade > k), from 0 to 3), p_toxic, grade (most probable) and toxic (p_toxic at or above the threshold).

    Whole texts are read. Null and empty texts have no features and get what the thresholds say of them, never toxic;
    without a model all are 0. Columns of these names in docs are replaced; other columns and repeated rows stay.
    """

    @F.pandas_udf("struct<expected_severity:double,p_toxic:double,grade:int,toxic:boolean>")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        weighted = Weighted(model.weights) if model else None
        for text in texts:  # one Arrow batch at a time
            if model is None:
                yield pd.DataFrame({"expected_severity": np.zeros(len(text)), "p_toxic": 0.0, "grade": 0, "toxic": False})
                continue
            s = np.array([weighted.score(t) if t else -40.0 for t in text])
            up = model.above(s)
            p = -np.diff(np.concatenate([np.ones((len(s), 1)), up, np.zeros((len(s), 1))], axis=1), axis=1)
            yield pd.DataFrame({"expected_severity": up.sum(axis=1), "p_toxic": up[:, 0], "grade": p.argmax(axis=1).astype(np.int32), "toxic": up[:, 0] >= model.threshold})

    plain = docs.drop(*(prefix + c for c in ("expected_severity", "p_toxic", "grade", "toxic")))
    name = free_name(plain, "_scored")
    out = plain.withColumn(name, scored(F.col(text_col)))
    return out.select(*plain.columns, *(F.col(f"{name}.{c}").alias(prefix + c) for c in ("expected_severity", "p_toxic", "grade", "toxic")))
