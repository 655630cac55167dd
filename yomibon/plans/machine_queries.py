"""Queries of the state machines, in batch and on streams."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from ..session import table
from ..storage import new_folder
from ..streaming import machines, progress
from .catalogue import query

#: Events of all users as positions: an event's type is the chapter, its value the position.
LEAST, THROTTLE, STALL = 25.0, 6 * 3600.0, 12 * 3600.0


def positions(rows):
    return rows.select("user_id", "ts", F.col("event_id").alias("seq"), F.col("event_type").alias("chapter"), F.col("value").alias("position"))


def event_days(spark, d):
    """The events as a stream of files in order of time: a file for each range of times."""
    rows = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    path = new_folder(spark, "event-days")
    days = [r.day for r in rows.select(F.weekofyear("ts").alias("day")).distinct().orderBy("day").collect()]  # at most 53
    for day in days:  # file sources take files by their age
        rows.where(F.weekofyear("ts") == day).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def saved_sql(least: float, throttle: float) -> str:
    return f"""WITH RECURSIVE e AS (SELECT user_id, event_id, event_type AS chapter, value, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
s AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS event_id, false AS saved, CAST(NULL AS VARCHAR) AS c, CAST(NULL AS DOUBLE) AS p, CAST(NULL AS BIGINT) AS b FROM e
    UNION ALL SELECT user_id, n, event_id, ok, CASE WHEN ok THEN chapter ELSE c END, CASE WHEN ok THEN value ELSE p END, CASE WHEN ok THEN t ELSE b END FROM (
        SELECT e.*, s.c, s.p, s.b, value >= 5 AND NOT coalesce(c = chapter AND abs(p - value) < {least}, false) AND coalesce(t - b >= {throttle} * 1000000, true) AS ok FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1))
SELECT s.user_id, event_id AS seq, e.event_type AS chapter, e.value AS position FROM s JOIN events e USING (event_id) WHERE saved"""


@query(f"SELECT user_id, seq AS event_id, position AS value FROM ({saved_sql(machines.LEAST, machines.THROTTLE)})")
def playback_throttle(spark, d):
    """The positions that a player saves, against the last saved one."""
    return machines.saved_positions(positions(table(spark, d, "events")), "user_id").select("user_id", F.col("seq").alias("event_id"), F.col("position").alias("value"))


@query(saved_sql(LEAST, THROTTLE))
def playback_saves(spark, d):
    return machines.saved_positions(positions(table(spark, d, "events")), "user_id", LEAST, THROTTLE)


@query(saved_sql(LEAST, THROTTLE))
def stream_playback_saves(spark, d):
    """The same on a stream, with the last saved position in the state store."""
    return progress.run_to_end(machines.saved_positions(positions(event_days(spark, d)), "user_id", LEAST, THROTTLE), "saves", "append")


JOBS_SQL = f"""WITH e AS (SELECT user_id, event_type, epoch_us(ts) AS t, lead(epoch_us(ts)) OVER o AS nxt, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back, (SELECT max(epoch_us(ts)) // 1000 * 1000 FROM events) AS mark FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)),
k AS (SELECT user_id, bool_or(event_type NOT IN ('error', 'purchase') AND CASE WHEN nxt IS NULL THEN mark - t > {STALL} * 1000000 ELSE nxt - t >= {STALL} * 1000000 END) AS stalls, max(CASE WHEN back = 1 THEN event_type END) AS kind, count(*) AS seen FROM e GROUP BY user_id)
SELECT user_id, CASE WHEN stalls THEN 'timeout' WHEN kind = 'error' THEN 'failed' WHEN kind = 'purchase' THEN 'done' ELSE 'running' END AS status, seen FROM k"""


def jobs(rows):
    return rows.select("user_id", "ts", F.col("event_id").alias("seq"), F.col("event_type").alias("kind"))


@query(JOBS_SQL)
def job_timeouts(spark, d):
    """The state of each user's job, with the timeouts of those that ran and were silent."""
    return machines.job_states(jobs(table(spark, d, "events")), "user_id", STALL)


@query(JOBS_SQL)
def stream_job_timeouts(spark, d):
    """The same on a stream, by event-time timers: the last change of each user."""
    changes = progress.run_to_end(machines.job_states(jobs(event_days(spark, d)), "user_id", STALL), "jobs", "update")
    rank = Window.partitionBy("user_id").orderBy(F.desc("seen"), F.desc(F.col("status") == "timeout"))
    return changes.withColumn("rank", F.row_number().over(rank)).where("rank = 1").drop("rank")
