"""Append-only feeds as Structured Streaming: ingest with quarantine, dedup, folds of attempts and job states, totals."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from proofmill.operators.constraints import violations
from proofmill.schemas import schema
from proofmill.tables import shared_dir

CORRUPT = "_corrupt_record"


def read_feed(spark: SparkSession, folder: str, ddl: str, files_per_batch: int = 100) -> DataFrame:
    """Appended JSON Lines files of a folder; malformed lines have their text in ``_corrupt_record``."""
    wide = StructType([*schema(ddl).fields, StructField(CORRUPT, StringType())])
    return spark.readStream.schema(wide).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).option("maxFilesPerTrigger", files_per_batch).json(folder)


def by_batch(root: str, parts: Callable[[DataFrame], dict[str, DataFrame]]) -> Callable[[DataFrame, int], None]:
    """A sink for ``foreachBatch``: each named part of a batch is written to ``<root>/<name>/batch=<id>``, then the batch is listed in ``<root>/committed``.

    A batch that is run again after a failure has the same id, is taken off the list and replaces
    what it had written, so nothing is lost or repeated; ``committed`` reads whole batches only. The stream's checkpoint
    belongs to ``root``: with another one, ids would start anew.
    """

    def sink(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        mark = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/committed/batch={n}")
        mark.getFileSystem(spark._jsc.hadoopConfiguration()).delete(mark, True)
        batch.persist()
        try:
            for name, rows in parts(batch).items():
                rows.write.mode("overwrite").parquet(f"{root}/{name}/batch={n}")
            spark.range(1).selectExpr("current_timestamp() AS at").write.mode("overwrite").parquet(f"{root}/committed/batch={n}")
        finally:
            batch.unpersist()

    return sink


def committed(spark: SparkSession, root: str, name: str, kind: StructType) -> DataFrame:
    """Rows of one part of all batches that were written whole, and their ``batch``. Batches are written in order, so those up to the last listed one count."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/committed")
    there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    last = spark.read.schema("at timestamp, batch bigint").parquet(f"{root}/committed").agg(F.max("batch")).first()[0] if there else None
    whole = StructType([*kind.fields, StructField("batch", LongType())])
    if last is None:
        return spark.createDataFrame([], whole)
    return spark.read.schema(whole).option("basePath", f"{root}/{name}").parquet(f"{root}/{name}").where(F.col("batch") <= last).select(*kind.names, "batch")


def routed(checks: dict[str, Column]) -> Callable[[DataFrame], dict[str, DataFrame]]:
    """Rows of a batch that keep all checks as ``accepted``; the others as ``quarantine`` with what they break."""

    def parts(batch: DataFrame) -> dict[str, DataFrame]:
        marked = batch.withColumn("violations", F.when(F.col(CORRUPT).isNotNull(), F.array(F.lit("malformed"))).otherwise(violations(checks)))
        return {"accepted": marked.where(F.size("violations") == 0).drop("violations", CORRUPT), "quarantine": marked.where(F.size("violations") > 0)}

    return parts


def ingest(spark: SparkSession, folder: str, ddl: str, checks: dict[str, Column], root: str, files_per_batch: int = 100):
    """Start the ingest of all files that are there; returns the query. ``ingested`` reads the result."""
    feed = read_feed(spark, folder, ddl, files_per_batch)
    return feed.writeStream.foreachBatch(by_batch(root, routed(checks))).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()


def ingested(spark: SparkSession, root: str, ddl: str) -> tuple[DataFrame, DataFrame]:
    """Accepted rows, and quarantined ones with ``violations``, of all batches that were written whole."""
    bad = StructType([*schema(ddl).fields, StructField(CORRUPT, StringType()), StructField("violations", ArrayType(StringType()))])
    return committed(spark, root, "accepted", schema(ddl)).drop("batch"), committed(spark, root, "quarantine", bad).drop("batch")


def first_seen(stream: DataFrame, keys: list[str], watermark: tuple[str, str] | None = None) -> DataFrame:
    """R2: the first row of each key. With a watermark (column, delay) state is kept for that long only."""
    if watermark is None:
        return stream.dropDuplicates(keys)
    return stream.withWatermark(*watermark).dropDuplicatesWithinWatermark(keys)


FOLDED = "dataset_id string, n_attempts int, final_outcome string, closed_by string"
_STATE = "attempts int, best int"
#: Outcomes by what an attempt reached: failed compilation, compiled, compared, passed.
_REACHED = ["compile_fail", "runtime_fail", "numeric_fail", "compiled_correct"]


def _fold(limit: int, idle_ms: int) -> Callable:
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, best = state.get if state.exists else (0, -1)
        if state.hasTimedOut:
            # an idle job is closed; the mark of a closed one has served its time
            state.remove()
            if n >= 0:
                yield pd.DataFrame([(key[0], n, _REACHED[max(best, 0)], "timeout")], columns=["dataset_id", "n_attempts", "final_outcome", "closed_by"])
            return
        rows = pd.concat(list(frames), ignore_index=True)
        closed, seen = None, n
        for r in rows.sort_values("attempt_n").itertuples() if n >= 0 else ():
            if n >= limit or best == 3:
                break
            n += 1
            passed, compared = r.correctness_status == "passed", isinstance(r.correctness_status, str)
            best = max(best, 3 if passed else 2 if compared else int(r.compile_status == "success"))
        if seen >= 0:
            closed = "pass" if best == 3 else "limit" if n >= limit else None
        # a closed job keeps a mark for a while, so that late attempts don't open it again
        state.update((-1 if closed or seen < 0 else n, best))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, int(rows["ts"].max().timestamp() * 1000) + idle_ms))
        if closed:
            yield pd.DataFrame([(key[0], n, _REACHED[best], closed)], columns=["dataset_id", "n_attempts", "final_outcome", "closed_by"])

    return run


def fold_attempts(stream: DataFrame, limit: int = 3, idle_ms: int = 600_000, watermark: str = "10 minutes") -> DataFrame:
    """A row for each job once it passed, had ``limit`` attempts, or was idle in event time ``ts``; attempts arrive in order of ``attempt_n``."""
    rows = stream.select("dataset_id", "attempt_n", "compile_status", "correctness_status", "ts").withWatermark("ts", watermark)
    return rows.groupBy("dataset_id").applyInPandasWithState(_fold(limit, idle_ms), FOLDED, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def fold_status(stream: DataFrame, watermark: str = "1 hour", key: str = "job_id") -> DataFrame:
    """The latest state of each job with its time; jobs not done ``timeout`` after their last sign are told by ``overdue``."""
    return stream.withWatermark("ts", watermark).groupBy(key).agg(F.max_by("status", "ts").alias("status"), F.max("ts").alias("ts"), F.min("ts").alias("first_ts"))


def overdue(jobs: DataFrame, now: Column, seconds: int = 600) -> DataFrame:
    """``jobs`` of a batch table with ``status`` timeout where a job hasn't ended ``seconds`` after its first sign; ``ended`` tells it by timer."""
    late = ~F.col("status").isin("done", "error") & (now.cast("double") - F.col("first_ts").cast("double") > seconds)
    return jobs.withColumn("status", F.when(late, "timeout").otherwise(F.col("status")))


ENDED = "status string, first_ts timestamp, ts timestamp"
#: Stores state outside the JVM's heap; timers need it.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Jobs(StatefulProcessor):
    """A job from its first sign to its end; a timer ends it as timeout. A mark of the end stays for a while."""

    def __init__(self, key: str, limit_ms: int, keep_ms: int, event_time: bool):
        self.key, self.limit, self.keep, self.event_time = key, limit_ms, keep_ms, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "first long, deadline long, ended boolean")

    def _end(self, key, first: int, status: str, ts: int, forget: int) -> pd.DataFrame:
        self.job.update((first, forget, True))
        self.handle.registerTimer(forget)
        at = lambda ms: pd.Timestamp(ms, unit="ms")
        return pd.DataFrame({self.key: [key[0]], "status": [status], "first_ts": [at(first)], "ts": [at(ts)]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows), ignore_index=True).sort_values("ts", kind="stable")
        now = timerValues.getCurrentWatermarkInMs() if self.event_time else timerValues.getCurrentProcessingTimeInMs()
        first, deadline, ended = self.job.get() if self.job.exists() else (None, None, False)
        if ended:
            return
        if first is None:
            first = frame["ts"].iloc[0].value // 1_000_000
            deadline = (first if self.event_time else now) + self.limit
            self.job.update((first, deadline, False))
            self.handle.registerTimer(deadline)
        for r in frame.itertuples():
            ms = r.ts.value // 1_000_000
            late = self.event_time and ms > deadline
            if late or r.status in ("done", "error"):
                self.handle.deleteTimer(deadline)
                yield self._end(key, first, "timeout" if late else r.status, deadline if late else ms, max(now, deadline) + self.keep)
                return

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        first, deadline, ended = self.job.get() if self.job.exists() else (None, None, True)
        if ended:
            self.job.clear()
            return
        yield self._end(key, first, "timeout", deadline, expiredTimerInfo.getExpiryTimeInMs() + self.keep)

    def close(self) -> None:
        pass


def ended(stream: DataFrame, seconds: int = 600, watermark: str = "10 minutes", key: str = "job_id", keep_seconds: int = 86_400, event_time: bool = True) -> DataFrame:
    """A row for each job once it is over: ``done`` or ``error`` with its time, or ``timeout`` at ``seconds`` after its first sign.

    A timer in the stream's state ends silent jobs: in event time (column ``ts``) when the watermark
    passes their deadline, else when so many seconds have passed on the clock (such a query never
    comes to rest, so it needs a processing-time trigger; after a restart its timers go on with the
    first sign of any job). Later signs of a job that is over are left
    out for ``keep_seconds``. Queries over it are started by ``start_with_timers``.
    """
    rows = stream.select(key, "status", "ts")
    rows = rows.withWatermark("ts", watermark) if event_time else rows
    kind = dict(rows.dtypes)[key]
    jobs = _Jobs(key, seconds * 1000, keep_seconds * 1000, event_time)
    return rows.groupBy(key).transformWithStateInPandas(jobs, f"`{key}` {kind}, {ENDED}", "Append", "EventTime" if event_time else "ProcessingTime")


def start_with_timers(writer: DataStreamWriter, spark: SparkSession):
    """Start a query whose state is kept in RocksDB; other queries of the session keep their store."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS)
    try:
        return writer.start()
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def append_new(stream: DataFrame, root: str, key: str = "dataset_id", existing: DataFrame | None = None):
    """Start to append the first row of each key of a stream; returns the query, ``committed`` reads part ``rows``.

    The keys that were written are the stream's own state (in RocksDB), so the growing table is never
    read again; ``existing`` are keys from before the stream, read in each batch. A batch that is run
    again replaces what it wrote.
    """

    def parts(batch: DataFrame) -> dict[str, DataFrame]:
        return {"rows": batch if existing is None else batch.join(existing.select(key), key, "left_anti").select(*batch.columns)}

    writer = stream.dropDuplicates([key]).writeStream.foreachBatch(by_batch(root, parts)).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True)
    return start_with_timers(writer, stream.sparkSession)


def totals(stream: DataFrame, by: str) -> DataFrame:
    """Running counts by ``by``; each batch of ``drain`` in update mode has those that changed."""
    return stream.groupBy(by).agg(F.count("*").alias("n"))


def rates(stream: DataFrame, by: str, window: str = "1 hour", slide: str | None = None, watermark: str = "2 hours") -> DataFrame:
    """Counts in event-time windows: ``start, end, by, n``; rows later than the watermark are left out."""
    counts = stream.withWatermark("ts", watermark).groupBy(F.window("ts", window, slide or window), by).agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), by, "n")


def drain(stream: DataFrame, mode: str = "append", batches: bool = False) -> DataFrame:
    """Run a stream over all there is and return its rows as a table in the shared folder; complete mode keeps the last result, update mode that of each batch.

    ``batches`` adds the column ``batch``.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def sink(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/rows/{'last' if mode == 'complete' else f'batch={n}'}")

    writer = stream.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
    start_with_timers(writer, spark).awaitTermination()
    if mode == "complete":
        return spark.read.schema(stream.schema).parquet(f"{base}/rows/last").select(*stream.columns)
    rows = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).parquet(f"{base}/rows")
    return rows if batches else rows.select(*stream.columns)
