"""Progress events as streams: latest status by key, labels, stall timeouts, windows, sinks, and their batch twins."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.library import status_label
from ..storage import new_folder

STALL_SECONDS = 600


def events(spark: SparkSession, folder: str, schema, files: str = "events.parquet", per_trigger: int = 1) -> DataFrame:
    """The event files of a folder as a stream, with `ts` as an instant."""
    raw = spark.readStream.schema(schema).option("pathGlobFilter", files).option("maxFilesPerTrigger", per_trigger).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def latest_status(stream: DataFrame) -> DataFrame:
    """user_id -> its last event by time, then event_id; on streams in complete or update mode."""
    return stream.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type", "value")).alias("last")).select("user_id", "last.ts", "last.event_id", "last.event_type", "last.value")


def chapter_status(stream: DataFrame) -> DataFrame:
    """(book, chapter, ts, seq, state, chunk, chunks) events -> book, chapter, label of the last one: queued, building with
    its place, error; aborting is building until it is aborted; cleared is what is ready, cached what has kept chunks only."""
    last = stream.groupBy("book", "chapter").agg(F.max(F.struct("ts", "seq", "state", "chunk", "chunks")).alias("x"))
    state = F.col("x.state")
    label = status_label(state == "queued", state == "building", F.col("x.chunk"), F.coalesce("x.chunks", F.lit(0)), state == "error", F.lit(False), state == "cleared", state == "cached")
    return last.select("book", "chapter", F.when(state.isin("aborting", "aborted"), state).otherwise(label).alias("label"))


def by_window(stream: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by event-time window and type; later events than the watermark are dropped on streams."""
    rows = stream.withWatermark("ts", late) if stream.isStreaming else stream
    return rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def job_step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """One job's events, or its timeout: only what runs times out, and what timed out stays so."""
    status, seen = state.get if state.exists else ("queued", 0)
    if state.hasTimedOut:
        status = "timeout" if status == "running" else status
    else:
        for batch in batches:
            for kind in batch.sort_values(["ts", "event_id"])["event_type"]:
                if status != "timeout":
                    status = {"error": "failed", "purchase": "done"}.get(kind, "running")
                seen += 1
        state.setTimeoutDuration(STALL_SECONDS * 1000)
    state.update((status, seen))
    yield pd.DataFrame({"user_id": [key[0]], "status": [status], "seen": [seen]})


def jobs(stream: DataFrame) -> DataFrame:
    """A state machine a user: events move it to running, done or failed; after a timeout it stays timed out."""
    return stream.groupBy("user_id").applyInPandasWithState(job_step, "user_id long, status string, seen long", "status string, seen long", "update", "ProcessingTimeTimeout")


def run_to_end(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over all there is and returns its result, from the shared folder: in complete mode the rows of the last
    batch, else those of all. Each batch has its folder, so one that is run again replaces itself."""
    spark = stream.sparkSession
    path = new_folder(spark, name)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{'last' if mode == 'complete' else f'batch={number}'}")

    query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    if mode == "complete":
        return spark.read.schema(stream.schema).parquet(f"{path}/last")
    return spark.read.schema(stream.schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(path)


def as_json_lines(stream: DataFrame, name: str) -> str:
    """Runs a stream over all there is into JSON lines in the shared folder; the path of the files."""
    path = new_folder(stream.sparkSession, name)
    query = stream.writeStream.format("json").outputMode("append").option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start(path)
    query.awaitTermination()
    return path


def mirrored(spark: SparkSession, folder: str, pattern: str = "*.mp3") -> DataFrame:
    """The files that come into a folder, as a stream: path, modificationTime, length."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path", "modificationTime", "length")
