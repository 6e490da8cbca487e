"""Quality classifier by co-training: a text view and a metadata view teach each other, then their calibrated scores combine."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import Scratch, as_text, kind_of, labelled_sample

#: Bound of the labelled sample, and the shares of it that calibrate the views and that measure the result; the rest trains.
MAX_LABELLED = 8_000
CALIBRATE, TEST = 0.2, 0.2
ROUNDS = 3
#: A view hands over what it calls good or bad beyond the point where it was right this often on calibration rows; where it
#: never is, its most confident share SURE_SHARE, which counts for less.
CONFIDENT, SURE_SHARE = 0.9, 0.03
#: Newton steps after each round, each of which sums gradient and curvature over all handed rows.
STEPS = 3
#: Tasks that add up the sums of all others before they come to the driver.
ADDERS = 16
TEXT_HASHES, META_HASHES = 128, 64
SEED = 5
KEEP_FROM = 0.5

#: Short function words of the languages the corpus may hold; their share tells prose from lists.
FUNCTION_WORDS = frozenset("the of and to a in is that it with for on as be by are was an or not de la le les des et un une en que el los las y del se por con der die das und ist von zu den mit auf ein eine".split())

CLASSES = np.zeros(256, np.uint8)
for _chars, _class in ((range(65, 91), 1), (range(97, 123), 2), (range(48, 58), 3), ((9, 10, 11, 12, 13, 32), 4), ([*map(ord, ".,;:'\"()?-")], 5), ([*map(ord, "!")], 6), ([*map(ord, "|")], 7), ([*map(ord, "#$%&*+/<=>@[\\]^_`{}~")], 8)):
    CLASSES[list(_chars)] = _class


class Hashed(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        k = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) % TEXT_HASHES
        return k


def text_view(text: str, hashed: Hashed) -> np.ndarray:
    """Shares of character classes, word and line statistics, and hashed words, of the whole text."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    kinds = np.bincount(np.where(raw < 128, CLASSES[raw], 9), minlength=10) / max(len(raw), 1)
    words, lines = text.lower().split(), [x for x in text.split("\n") if x.strip()]
    n = max(len(words), 1)
    buckets = np.bincount(np.fromiter(map(hashed.__getitem__, words), np.int64, len(words)), minlength=TEXT_HASHES)
    distinct = set(words)
    stats = [
        np.log1p(len(words)) / 10, np.log1p(len(lines)) / 10, sum(map(len, words)) / n / 20, len(distinct) / n, sum(w in FUNCTION_WORDS for w in words) / n,
        len(set(lines)) / max(len(lines), 1), sum(map(len, lines)) / max(len(lines), 1) / 1000 if lines else 0.0, float(not words),
    ]
    return np.concatenate([[1.0], kinds * 3, stats, np.sqrt(buckets / n)]).astype(np.float32)


def meta_view(lang: str, source: str, n_chars: float) -> np.ndarray:
    """Language and source by hash, and the length that the metadata states."""
    out = np.zeros(4 + 2 * META_HASHES, np.float32)
    out[0], out[1], out[2], out[3] = 1, np.log1p(max(n_chars, 0)) / 12, float(n_chars < 0), float(0 <= n_chars < 200)
    out[4 + zlib.crc32(lang.encode()) % META_HASHES] = 1
    out[4 + META_HASHES + zlib.crc32(source.encode("utf-8", "surrogatepass")) % META_HASHES] = 1
    return out


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 1e-3, rounds: int = 25) -> np.ndarray:
    """Weighted logistic regression by Newton steps."""
    beta, w = np.zeros(x.shape[1]), weight / weight.sum()
    x = x.astype(np.float64)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + l2 * np.eye(len(beta))
        step = np.linalg.solve(h, x.T @ (w * (y - p)) - l2 * beta)
        beta += step
        if np.abs(step).max() < 1e-6:
            break
    return beta


@dataclass
class CoTrained:
    text: np.ndarray
    meta: np.ndarray
    #: slope and offset of each view's calibration, and the weights and offset that combine the calibrated log-odds.
    calibrations: np.ndarray
    combine: np.ndarray
    #: rows that each view handed over in each round: {"x": (bad, good), "m": (bad, good)}.
    handed: list[dict[str, tuple[int, int]]] = field(default_factory=list)
    #: share of the test rows, which nothing was fitted to, that are judged right; and the share of the larger class among them.
    accuracy: float = float("nan")
    majority: float = float("nan")

    def views(self, x: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.clip(c[0] * (a @ b) + c[1], -30, 30) for a, b, c in ((x, self.text, self.calibrations[0]), (m, self.meta, self.calibrations[1])))

    def score(self, x: np.ndarray, m: np.ndarray) -> np.ndarray:
        t, s = self.views(x, m)
        return 1 / (1 + np.exp(-np.clip(self.combine[0] * t + self.combine[1] * s + self.combine[2], -30, 30)))


def platt(scores: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slope and offset that turn a view's scores into log-odds. The slope is never negative."""
    found = logistic(np.stack([scores, np.ones(len(y))], axis=1), y, np.ones(len(y)), 1e-4)
    return found if found[0] > 0 else np.array([1e-3, np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))])


def combined(t: np.ndarray, s: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of the calibrated views and an offset. A view that would count against what it says is left out."""
    use = [t, s]
    both = logistic(np.stack([*use, np.ones(len(y))], axis=1), y, np.ones(len(y)), 1e-3)
    if both[:2].min() >= 0:
        return both
    best = int(both[1] > both[0])
    one = logistic(np.stack([use[best], np.ones(len(y))], axis=1), y, np.ones(len(y)), 1e-3)
    return np.array([one[0] * (best == 0), one[0] * (best == 1), one[1]])


def thresholds(scores: np.ndarray, y: np.ndarray) -> dict[int, tuple[float, float]]:
    """For each class, from which (signed) score a view hands over, and how much such a row counts (1: as a labelled one)."""
    out = {}
    for label in (0, 1):
        sure, right = (scores if label else -scores), y == label
        order = np.argsort(-sure, kind="stable")
        precise = np.cumsum(right[order]) / np.arange(1, len(y) + 1)
        last = np.append(sure[order][:-1] != sure[order][1:], True)  # ties are handed over together
        # Better than chance is measured against the class's share, so that the rarer class is taught, too.
        good = np.flatnonzero(last & (precise >= CONFIDENT) & (np.arange(len(y)) >= 4))
        k = good[-1] if len(good) else np.flatnonzero(last)[np.searchsorted(np.flatnonzero(last), min(len(y) - 1, max(4, int(SURE_SHARE * len(y)))))]
        share = right.mean()
        out[label] = float(sure[order][k]), float(np.clip((precise[k] - share) / max(1 - share, 1e-6), 0.05, 1))
    return out


def features(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str, chars_col: str) -> DataFrame:
    """(_id, x, m): both views of every document, as binary float32."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashed = Hashed()
        for b in batches:
            yield pd.DataFrame({"_id": b["_id"], "x": [text_view(t, hashed).astype(np.float16).tobytes() for t in b["_text"]], "m": [meta_view(*v).astype(np.float16).tobytes() for v in zip(b["_lang"], b["_source"], b["_n"], strict=True)]})

    own = docs.select(as_text(id_col).alias("_id"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((text_col, "_text"), (lang_col, "_lang"), (source_col, "_source"))), F.coalesce(F.col(chars_col).cast("double"), F.lit(-1.0)).alias("_n"))
    return own.mapInPandas(run, "_id string, x binary, m binary").withColumn("_id", F.col("_id").cast(kind_of(docs, id_col)))


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.frombuffer(v, np.float16) for v in column]).astype(np.float32) if len(column) else np.zeros((0, 1), np.float32)


def added(pool: DataFrame, beta: dict[str, np.ndarray], weight: dict[str, dict[int, float]]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Gradient and curvature of both views' log likelihood over all rows handed to them, summed by tasks and then by ADDERS."""
    size = {v: len(b) for v, b in beta.items()}

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = {v: np.zeros((n + 1, n)) for v, n in size.items()}
        for batch in batches:
            for at in range(0, len(batch), 4096):
                for view, said in (("x", "ym"), ("m", "yx")):
                    own = batch.iloc[at : at + 4096]
                    own = own[own[said] >= 0]
                    if len(own):
                        a, y = matrix(own[view]).astype(np.float64), own[said].to_numpy(float)
                        w = np.where(y > 0, weight[view][1], weight[view][0])
                        p = 1 / (1 + np.exp(-np.clip(a @ beta[view], -30, 30)))
                        total[view][0] += a.T @ (w * (y - p))
                        total[view][1:] += (a * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ a
        yield pd.DataFrame({"view": list(total), "sums": [v.tobytes() for v in total.values()]})

    def together(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = {v: np.zeros((n + 1, n)) for v, n in size.items()}
        for batch in batches:
            for view, sums in zip(batch["view"], batch["sums"], strict=True):
                total[view] += np.frombuffer(sums).reshape(total[view].shape)
        yield pd.DataFrame({"view": list(total), "sums": [v.tobytes() for v in total.values()]})

    schema, out = "view string, sums binary", {v: np.zeros((n + 1, n)) for v, n in size.items()}
    for row in pool.where("yx >= 0 or ym >= 0").select("x", "m", "yx", "ym").mapInPandas(each, schema).repartition(ADDERS).mapInPandas(together, schema).collect():
        out[row["view"]] += np.frombuffer(row["sums"]).reshape(out[row["view"]].shape)
    return {v: (t[0], t[1:]) for v, t in out.items()}


def fit(all_rows: DataFrame, labels: DataFrame, id_col: str, label_col: str, max_labelled: int, rounds: int, seed: int, scratch: Scratch) -> CoTrained | None:
    """The model from features (_id, x, m) of all documents and labels; None without two classes of labels.

    In each round a further part of the unlabelled documents joins the pool; each view labels those it is sure of, by
    thresholds from calibration rows, for the other, and they leave the pool for good. Both then learn from the labelled
    rows and from all rows handed to them, which are summed where they are; a class weighs as much as its labelled rows at
    most. Equal documents count once. The driver holds the labelled sample, and sums of the model's own size.
    """
    known = labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).alias("_y"))
    sample = labelled_sample(known, "_id", ["_y"], max_labelled, seed)
    # Bounded by max_labelled rows, one for each id.
    got = all_rows.join(F.broadcast(sample), "_id").groupBy("_id", "_y").agg(F.min(F.struct("x", "m")).alias("f")).select("_id", "_y", "f.x", "f.m").toPandas().sort_values("_id", ignore_index=True)
    y = (got["_y"].to_numpy(float) > 0).astype(float) if len(got) else np.zeros(0)
    if not len(y) or y.min() == y.max():
        return None
    place = np.array([zlib.crc32(f"{seed}:{k}".encode()) % 1000 / 1000 for k in got["_id"]])
    test, calibrate = place < TEST, (place >= TEST) & (place < TEST + CALIBRATE)
    if any(not part.any() or y[part].min() == y[part].max() for part in (test, calibrate, ~(test | calibrate))):
        test[:], calibrate[:] = False, False
    train, held = ~(test | calibrate), calibrate if calibrate.any() else np.ones(len(y), bool)
    own = {"x": matrix(got["x"]).astype(np.float64), "m": matrix(got["m"]).astype(np.float64)}
    beta = {v: logistic(a[train], y[train], np.ones(train.sum())) for v, a in own.items()}

    left = all_rows.join(F.broadcast(sample.select("_id")), "_id", "left_anti").where(F.col("_id").isNotNull())
    part = F.pmod(F.xxhash64("x", "m", F.lit(seed)), F.lit(max(rounds, 1))).cast("int").alias("part")
    pool = scratch.keep(left.select("x", "m").distinct().select("x", "m", part, F.lit(-1).alias("yx"), F.lit(-1).alias("ym")), "pool-0")
    handed: list[dict[str, tuple[int, int]]] = []
    for step in range(rounds):
        limits = {v: thresholds(own[v][held] @ beta[v], y[held]) for v in own}
        now = dict(beta)

        @F.pandas_udf("struct<x:int,m:int>")
        def sure(a: pd.Series, b: pd.Series) -> pd.DataFrame:
            out = {}
            for v, column in (("x", a), ("m", b)):
                s = matrix(column) @ now[v] if len(column) else np.zeros(0)
                out[v] = np.where(s >= limits[v][1][0], 1, np.where(-s >= limits[v][0][0], 0, -1)).astype(np.int32)
            return pd.DataFrame(out)

        opened = F.col("part") <= step
        said = pool.withColumn("s", sure("x", "m")).select("x", "m", "part", F.when((F.col("yx") < 0) & opened, F.col("s.x")).otherwise(F.col("yx")).alias("yx"), F.when((F.col("ym") < 0) & opened, F.col("s.m")).otherwise(F.col("ym")).alias("ym"))
        pool = scratch.keep(said, f"pool-{step + 1}")
        scratch.drop(f"pool-{step}")
        counts = {(r["yx"], r["ym"]): r["count"] for r in pool.groupBy("yx", "ym").count().collect()}  # nine rows at most
        of = {"x": lambda c: sum(n for (a, _), n in counts.items() if a == c), "m": lambda c: sum(n for (_, b), n in counts.items() if b == c)}  # noqa: B023
        total = {v: (of[v](0), of[v](1)) for v in own}
        handed.append({v: tuple(total[v][c] - sum(h[v][c] for h in handed) for c in (0, 1)) for v in own})
        # The pupil's weights follow its teacher's reliability; a class weighs as much as the labelled rows of it at most.
        teacher = {"x": "m", "m": "x"}
        weight = {v: {c: limits[teacher[v]][c][1] * min(1.0, float((y[train] == c).sum()) / max(total[teacher[v]][c], 1)) for c in (0, 1)} for v in own}
        for _ in range(STEPS):
            sums = added(pool, beta, weight)
            for v, a in own.items():
                mass = train.sum() + sum(weight[v][c] * total[teacher[v]][c] for c in (0, 1))
                p = 1 / (1 + np.exp(-np.clip(a[train] @ beta[v], -30, 30)))
                slope = (a[train].T @ (y[train] - p) + sums[v][0]) / mass - 1e-3 * beta[v]
                curve = ((a[train] * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ a[train] + sums[v][1]) / mass + 1e-3 * np.eye(a.shape[1])
                beta[v] = beta[v] + np.linalg.solve(curve, slope)
    scratch.drop(f"pool-{rounds}")
    model = CoTrained(beta["x"], beta["m"], np.array([platt(own[v][held] @ beta[v], y[held]) for v in ("x", "m")]), np.array([1.0, 1.0, 0.0]), handed)
    t, s = model.views(own["x"][held], own["m"][held])
    model.combine = combined(t, s, y[held])
    if test.any():
        model.accuracy = float(((model.score(own["x"][test], own["m"][test]) >= KEEP_FROM) == (y[test] > 0)).mean())
        model.majority = float(max(y[test].mean(), 1 - y[test].mean()))
    return model


def cotrain(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", chars_col: str = "n_chars", label_col: str = "quality", max_labelled: int = MAX_LABELLED, rounds: int = ROUNDS, seed: int = SEED, scratch: Scratch | None = None) -> DataFrame:
    """Per row of docs: id, p_text, p_meta (each view's calibrated probability of good quality), score (combined) and keep (score at or above 0.5).

    Views start from at most max_labelled labelled documents and teach each other in rounds (see ``fit``). Null texts,
    languages and sources count as empty, null lengths as unknown; repeated rows get equal scores; null ids are scored,
    not trained on; without two classes of labels all scores are 0.5 and everything is kept; other columns are ignored; an
    empty table gives no rows.
    """
    scratch = scratch or Scratch(docs.sparkSession, "quality")
    all_rows = scratch.keep(features(docs, id_col, text_col, lang_col, source_col, chars_col), "features")
    model = fit(all_rows, labels, id_col, label_col, max_labelled, rounds, seed, scratch)
    if model is None:
        return all_rows.select(F.col("_id").alias(id_col), F.lit(0.5).alias("p_text"), F.lit(0.5).alias("p_meta"), F.lit(0.5).alias("score"), F.lit(True).alias("keep"))

    def final(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                a, b = matrix(batch["x"]), matrix(batch["m"])
                t, s = model.views(a, b)
                p = model.score(a, b)
                yield pd.DataFrame({"_id": batch["_id"], "p_text": 1 / (1 + np.exp(-t)), "p_meta": 1 / (1 + np.exp(-s)), "score": p, "keep": p >= KEEP_FROM})

    scored = all_rows.withColumn("_id", as_text("_id")).mapInPandas(final, "_id string, p_text double, p_meta double, score double, keep boolean")
    return scored.select(F.col("_id").cast(kind_of(docs, id_col)).alias(id_col), "p_text", "p_meta", "score", "keep")
