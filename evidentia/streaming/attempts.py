"""Incremental scoring of attempts with Structured Streaming: new files once, running pass@K, re-deliveries ignored."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery


def read_attempts(spark: SparkSession, path: str, schema: str, fmt: str = "json") -> DataFrame:
    """New files below path, each once per checkpoint."""
    return spark.readStream.schema(schema).format(fmt).load(path)


def once_by_key(attempts: DataFrame, keys: tuple[str, ...] = ("id", "attempt_idx"), time_col: str | None = None, delay: str = "1 day") -> DataFrame:
    """Z3: a re-delivered key is ignored. State is bounded by ids and attempts; with an ingest time column, by the delay too."""
    if time_col:
        return attempts.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(list(keys))
    return attempts.dropDuplicates(list(keys))


def score_new(attempts: DataFrame, out: str, checkpoint: str, score=None) -> StreamingQuery:
    """Attempts that arrived since the last run, once, scored by a row function and appended to ``out``."""
    rows = score(attempts) if score else attempts
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def running_pass(attempts: DataFrame) -> DataFrame:
    """any_correct and first_success of each id so far; state is a row for each id."""
    judged = attempts.where(F.col("is_correct").isNotNull())
    return judged.groupBy("id").agg(F.bool_or("is_correct").alias("any_correct"), F.min(F.when(F.col("is_correct"), F.col("attempt_idx"))).alias("first_success"))


def keep_running(attempts: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Changed ids of each micro-batch as one folder below ``out`` (batch=N), so that a batch that runs again replaces its own folder."""
    def save(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={n}")

    return running_pass(attempts).writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, out: str) -> DataFrame:
    """The latest state of each id that ``keep_running`` has saved."""
    rows = spark.read.parquet(out)
    return rows.groupBy("id").agg(F.max_by(F.struct("any_correct", "first_success"), "batch").alias("s")).select("id", "s.*")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
REMEMBERED = "id string, attempt_idx int, answer string, is_correct boolean, tips_wrong_answer array<string>, tips_used boolean, received_tips boolean"


STATE = "upto int, judged boolean, first_success int, wrong array<string>, waiting array<struct<attempt_idx:int,answer:string,is_correct:boolean>>"


class Memory(StatefulProcessor):
    """State of one id: how far its attempts have come, its wrong answers so far, and attempts that wait for earlier ones.

    All of it is one value, so an id costs a read and a write of the store in a micro-batch, however many attempts it has there.
    """

    def __init__(self, threshold: int):
        self.threshold = threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.progress = handle.getValueState("progress", STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = self.progress.get()
        upto, judged, success, known, waiting = before or (0, False, None, [], [])
        ready = {w[0]: (w[1], w[2]) for w in waiting or []}
        new = False
        for r in rows:
            idx = r.attempt_idx
            if success is None and idx is not None and idx > upto and idx not in ready:  # else delivered again, or after the id has ended
                ready[idx] = (r.answer, r.is_correct)
                new = True
        if before is not None and not new:
            return
        wrong = set(known or [])
        while success is None and upto + 1 in ready:
            upto += 1
            answer, correct = ready.pop(upto)
            judged = judged or correct is not None
            if correct:
                success = upto
            elif (answer or "").strip(" "):
                wrong.add(answer)
            yield Row(id=key[0], attempt_idx=upto, answer=answer, is_correct=correct, tips_wrong_answer=sorted(wrong), tips_used=upto >= self.threshold, received_tips=upto > self.threshold)
        ended = success is not None
        self.progress.update((upto, judged, success, [] if ended else sorted(wrong), [] if ended else [(k, *v) for k, v in sorted(ready.items())]))

    def close(self) -> None:
        pass


def remember(attempts: DataFrame, out: str, checkpoint: str, threshold: int) -> StreamingQuery:
    """W1, W2, Z2 and Z3 on the stream: attempts (id, attempt_idx from 1 on, answer, is_correct) with the wrong answers so far, appended to ``out``.

    Attempts of an id leave in order, each once: one that comes early waits for those before it, one that comes again is ignored. An id
    ends with its first correct attempt; later ones are dropped, and its state shrinks to one row. So state holds a row for each id
    and the wrong answers of those still open, however many micro-batches there are.
    """
    spark = attempts.sparkSession
    rows = attempts.select("id", "attempt_idx", "answer", "is_correct").groupBy("id").transformWithState(Memory(threshold), REMEMBERED, "Append", "None")
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKSDB)  # a query keeps the provider that it began with
    try:
        return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def first_or_kth(remembered: DataFrame, k: int) -> DataFrame:
    """W1 of what ``remember`` has appended: the first correct attempt of each id, else attempt k."""
    return remembered.where(F.coalesce("is_correct", F.lit(False)) & (F.col("attempt_idx") <= k) | (F.col("attempt_idx") == k))


def progress(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(id, any_correct, first_success) of ids with a judged attempt, as the state store of ``remember`` has them now."""
    state = spark.read.format("statestore").option("stateVarName", "progress").load(checkpoint)
    rows = state.select("key.id", "value.*").where("judged")
    return rows.select("id", F.col("first_success").isNotNull().alias("any_correct"), "first_success")
