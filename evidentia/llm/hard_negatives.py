"""Hard-negative mining by the threshold algorithm: sorted lists for each dimension, read in the anchor's direction until no unseen row can matter."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import Scratch, kind_of

#: A component x becomes floor(SCALE * x).
SCALE = 256
#: Positives of an anchor, negatives of a positive, and the window of a negative's score in percent of the positive's.
POSITIVES, NEGATIVES, LOW, HIGH = 5, 3, 50, 95
#: Rows of a shard, and the least number of shards. Each has its own sorted lists, and its best rows are merged with those of the others.
SHARD_ROWS, LEAST_SHARDS = 16384, 12
#: Anchors that meet one shard in one group.
GROUP = 8192
#: Entries of each list that the first round reads; each later round reads twice as many.
FIRST_ROUND = 16
#: Components up to here: 1,024 products of two of them, scaled, fit 64 bits.
MOST = 2.0**18


def usable(vectors: DataFrame, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """(_id, _label, _v) of the rows that take part, one for each id: of several, the one with the smallest label and vector."""
    v = F.col(vector_col)
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= MOST))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & v.isNotNull() & fine)
    one = F.min(F.struct(F.col(label_col).cast("string").alias("label"), v.cast("array<double>").alias("v"))).alias("one")
    return rows.groupBy(F.col(id_col).alias("_id")).agg(one).select("_id", F.col("one.label").alias("_label"), F.col("one.v").alias("_v"))


def integers(vectors: list) -> np.ndarray:
    """Scaled vectors as rows of whole numbers; shorter ones are filled up with zeros."""
    out = np.zeros((len(vectors), max(map(len, vectors), default=0)))
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = v
    return np.floor(SCALE * out).astype(np.int32)


def shard(pdf: pd.DataFrame) -> pd.DataFrame:
    """One row for a shard: rows by id, so that a row's number orders ties, and for each dimension the rows by their component."""
    pdf = pdf.sort_values("_id", kind="stable")
    x = integers(pdf["_v"].tolist())
    lists = np.argsort(x, axis=0, kind="stable").T.astype("<i4")
    return pd.DataFrame({"shard": pdf["shard"].iloc[:1], "ids": [pdf["_id"].tolist()], "labels": [pdf["_label"].tolist()], "rows": [x.astype("<i4").tobytes()], "lists": [np.ascontiguousarray(lists).tobytes()], "dim": [x.shape[1]]})


class Lists:
    """A shard: its rows and sorted lists."""

    def __init__(self, row: pd.Series):
        self.ids, self.labels = np.asarray(row["ids"]), np.asarray(row["labels"], object)
        self.x = np.frombuffer(row["rows"], "<i4").reshape(len(self.ids), row["dim"])
        self.lists = np.frombuffer(row["lists"], "<i4").reshape(row["dim"], len(self.ids))
        self.most = int(np.abs(self.x).max(initial=0))
        self.exact = self.x.astype(np.float64)
        self.masks: dict[str, np.ndarray] = {}

    def labelled(self, label: str) -> np.ndarray:
        if label not in self.masks:
            self.masks[label] = self.labels == label
        return self.masks[label]

    def scan(self, anchor: np.ndarray, wanted: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
        """Rounds of sorted access: (rows met for the first time that are wanted, their scores, the threshold).

        In the anchor's direction means largest components first where the anchor's is positive, smallest first where it is negative.
        No row that has not been met scores more than the threshold; it is -inf when all rows have been met.
        """
        m, dim = len(self.ids), min(len(anchor), self.x.shape[1])
        anchor = anchor[:dim].astype(np.int64)
        up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        # Doubles hold these sums of whole numbers exactly below 2 ** 53; beyond that 64-bit integers do.
        small = self.most * int(np.abs(anchor).sum()) < 2**53
        x, a = (self.exact[:, :dim], anchor.astype(np.float64)) if small else (self.x[:, :dim].astype(np.int64), anchor)
        met, left, depth, step = np.zeros(m, bool), m, 0, FIRST_ROUND
        if not len(up) + len(down):
            rows = np.flatnonzero(wanted)
            yield rows, np.zeros(len(rows), np.int64), -np.inf
            return
        while left:
            end = min(m, depth + step)
            rows = np.concatenate([self.lists[up, m - end : m - depth].ravel(), self.lists[down, depth:end].ravel()])
            fresh = np.zeros(m, bool)
            fresh[rows] = True
            fresh &= ~met
            met |= fresh
            left -= int(np.count_nonzero(fresh))
            new = np.flatnonzero(fresh & wanted)
            scores = (x[new] @ a).astype(np.int64)
            last_up, last_down = self.x[self.lists[up, m - end], up].astype(np.int64), self.x[self.lists[down, end - 1], down].astype(np.int64)
            yield new, scores, float(last_up @ anchor[up] + last_down @ anchor[down]) if left else -np.inf
            depth, step = end, 2 * step


class Rows:
    """Result rows, gathered column by column; single values are repeated."""

    def __init__(self, *names: str):
        self.columns: dict[str, list] = {name: [] for name in names}

    def add(self, n: int, *values) -> None:
        for column, value in zip(self.columns.values(), values, strict=True):
            column.extend(value.tolist() if isinstance(value, np.ndarray) else [value] * n)

    def frame(self) -> pd.DataFrame:
        return pd.DataFrame(self.columns)


def best(lists: Lists, anchor: np.ndarray, wanted: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k wanted rows with the largest scores (ties: the first rows), largest first."""
    rows, scores = np.empty(0, np.int64), np.empty(0, np.int64)
    for new, found, threshold in lists.scan(anchor, wanted):
        rows, scores = np.concatenate([rows, new]), np.concatenate([scores, found])
        order = np.lexsort((rows, -scores))[:k]
        rows, scores = rows[order], scores[order]
        if len(rows) == k and threshold < scores[-1]:
            break
    return rows, scores


def best_in_windows(lists: Lists, anchor: np.ndarray, wanted: np.ndarray, windows: list[tuple[int, int]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each window (lowest, highest score) the k wanted rows in it with the largest scores.

    A window is settled once the threshold is strictly below its k-th score, or below the window itself.
    """
    found = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in windows]
    open_ = [low <= high for low, high in windows]
    if not any(open_):
        return found
    for new, scores, threshold in lists.scan(anchor, wanted):
        for j, (low, high) in enumerate(windows):
            if open_[j]:
                inside = (scores >= low) & (scores <= high)
                rows, own = np.concatenate([found[j][0], new[inside]]), np.concatenate([found[j][1], scores[inside]])
                order = np.lexsort((rows, -own))[:k]
                found[j] = rows[order], own[order]
                open_[j] = not (threshold < low or (len(order) == k and threshold < found[j][1][-1]))
        if not any(open_):
            break
    return found


def mine(
    vectors: DataFrame, anchors: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
    shard_rows: int = SHARD_ROWS, scratch: Scratch | None = None,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows that the condition ``anchors`` on the id names.

    Scores are integer inner products of scaled vectors; ties go to the smaller id. An anchor's positives are the first other rows
    of its label; for each of them the first rows of other labels are returned whose score lies in the window. Rows are dealt
    to shards by a hash of their id, so neither a label nor a region of the space makes one large; every anchor reads the
    sorted lists of every shard, and the best of the shards are merged. Rows with a null id, label or vector, or with a component that is
    null, not finite or beyond +-2 ** 18 take no part; a shorter vector counts as filled up with zeros, an empty one as zero; of rows
    that repeat an id the one with the smallest label and vector counts. Anchors without positives, and positives without rows
    in their window, give no rows; an empty table gives none. Other columns are ignored.
    """
    spark, scratch = vectors.sparkSession, scratch or Scratch(vectors.sparkSession, "hard-negatives")
    kind = kind_of(vectors, id_col)
    rows = scratch.keep(usable(vectors, id_col, label_col, vector_col), "rows")
    asked = rows.withColumnRenamed("_id", id_col).where(anchors).withColumnRenamed(id_col, "_id")
    total, wanted = rows.count(), asked.count()
    shards, groups = max(LEAST_SHARDS, -(-total // shard_rows)), max(1, -(-wanted // GROUP))
    index = scratch.keep(rows.withColumn("shard", F.pmod(F.xxhash64("_id"), F.lit(shards)).cast("int")).groupBy("shard").applyInPandas(shard, f"shard int, ids array<{kind}>, labels array<string>, rows binary, lists binary, dim int"), "index")

    def everywhere(df: DataFrame) -> DataFrame:
        """Each anchor once for each shard, in groups of about GROUP."""
        return df.withColumn("group", F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(groups)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    each = index.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).groupBy("shard", "group")

    def first(queries: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        out = Rows("_id", "positive_id", "positive_score")
        for _, block in blocks.iterrows():
            own = Lists(block)
            for anchor, label, v in zip(queries["_id"], queries["_label"], queries["_v"], strict=True):
                hits, scores = best(own, integers([v])[0], own.labelled(label) & (own.ids != anchor), positives)
                out.add(len(hits), anchor, own.ids[hits], scores)
        return out.frame()

    near = everywhere(asked).groupBy("shard", "group").cogroup(each).applyInPandas(first, f"_id {kind}, positive_id {kind}, positive_score long")
    near = near.withColumn("r", F.expr("row_number() over (partition by _id order by positive_score desc, positive_id)")).where(F.col("r") <= positives)
    lists = near.groupBy("_id").agg(F.array_sort(F.collect_list(F.struct("r", "positive_id", "positive_score"))).alias("p"))
    lists = scratch.keep(lists.select("_id", F.col("p.positive_id").alias("positive_ids"), F.col("p.positive_score").alias("positive_scores")), "positives")

    def second(queries: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        out = Rows("anchor_id", "positive_id", "negative_id", "positive_score", "negative_score")
        for _, block in blocks.iterrows():
            own = Lists(block)
            for anchor, label, v, ids, scores in zip(queries["_id"], queries["_label"], queries["_v"], queries["positive_ids"], queries["positive_scores"], strict=True):
                windows = [(-(-low * int(s) // 100), high * int(s) // 100) for s in scores]
                found = best_in_windows(own, integers([v])[0], ~own.labelled(label), windows, negatives)
                for positive, score, (hits, values) in zip(ids, scores, found, strict=True):
                    out.add(len(hits), anchor, positive, own.ids[hits], score, values)
        return out.frame()

    asked = scratch.keep(asked.join(lists, "_id"), "asked")
    hard = everywhere(asked).groupBy("shard", "group").cogroup(each).applyInPandas(second, f"anchor_id {kind}, positive_id {kind}, negative_id {kind}, positive_score long, negative_score long")
    ranked = hard.withColumn("rank", F.expr("row_number() over (partition by anchor_id, positive_id order by negative_score desc, negative_id)").cast("int")).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def relabelled(vectors: DataFrame, id_col: str = "vec_id", label_col: str = "label") -> DataFrame:
    """Every seventh id takes the next of ten labels, so that labels and directions differ for some rows."""
    return vectors.withColumn(label_col, F.when(F.col(id_col) % 7 == 0, (F.col(label_col) + 1) % 10).otherwise(F.col(label_col)))


def oracle() -> str:
    """The same rows as DuckDB SQL: every anchor's score with every row."""
    return f"""
    WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
      WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
    p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES}),
    n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score FROM p JOIN s USING (anchor_id) WHERE NOT s.same AND {LOW} * positive_score <= 100 * s.score AND 100 * s.score <= {HIGH} * positive_score)
    SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY negative_score DESC, negative_id)::INTEGER AS rank, negative_id, positive_score, negative_score FROM n
    QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY negative_score DESC, negative_id) <= {NEGATIVES}"""
