"""The player's saving rules and job timeouts, in batch and on streams cut in any way."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from yomibon.streaming import machines, progress

START = datetime(2024, 1, 1)
POSITIONS = "key long, ts timestamp, seq long, chapter string, position double"
JOBS = "key long, ts timestamp, seq long, kind string"


def at(seconds):
    return START + timedelta(seconds=seconds)


def saved(spark, rows):
    df = spark.createDataFrame([(1, at(t), k, c, p) for k, (t, c, p) in enumerate(rows)], POSITIONS)
    return [r.seq for r in machines.saved_positions(df, "key").orderBy("seq").collect()]


def test_positions_are_saved_against_the_last_saved_one(spark):
    slow = [(2 * k, "a", 5.0 + 0.9 * k) for k in range(12)]
    assert saved(spark, slow) == [0, 2, 4, 6, 8, 10]  # 1.8 from the last saved one each
    assert saved(spark, [(0, "a", 4.9), (1, "a", 5.0), (2, "a", 5.5), (3, "b", 5.5), (3.5, "b", 60.0), (4, "b", 60.0)]) == [1, 3, 5]
    assert saved(spark, [(0, "a", None), (1, "a", float("nan")), (2, "a", float("inf")), (3, None, 9.0), (5, None, 9.5), (7, None, 3.0), (9, None, 7.0)]) == [3, 6]


def streamed(spark, folder, df, cuts):
    """df as a stream of files, cut by seq."""
    edges = [0, *sorted(cuts), 10**9]
    for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        df.where(f"seq >= {a} and seq < {b}").coalesce(1).write.parquet(f"{folder}/{k}")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))


def brute_jobs(rows, seconds, end):
    states = {}
    for key, ts, _, kind in sorted(rows, key=lambda r: (r[1], r[2])):
        status, seen, last = states.get(key, ("queued", 0, ts))
        if status == "running" and (ts - last).total_seconds() >= seconds:
            status = "timeout"
        if status != "timeout":
            status = {"error": "failed", "purchase": "done"}.get(kind, "running")
        states[key] = (status, seen + 1, ts)
    return {k: ("timeout" if s == "running" and (end - last).total_seconds() > seconds else s, n) for k, (s, n, last) in states.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_streams_equal_their_batch_twins(spark, tmp_path, seed):
    rng, t = random.Random(seed), 0
    jobs, positions = [], []
    for k in range(60):
        t += rng.choice([1, 5, 30, 400, 700])
        jobs.append((rng.randint(1, 4), at(t), k, rng.choice(["view", "click", "error", "purchase", "view"])))
        positions.append((rng.randint(1, 3), at(t / 300), k, rng.choice("ab"), round(rng.uniform(0, 12), 1)))
    df = spark.createDataFrame(jobs, JOBS)
    batch = {r.key: (r.status, r.seen) for r in machines.job_states(df, "key").collect()}
    assert batch == brute_jobs(jobs, machines.STALL_SECONDS, max(r[1] for r in jobs))
    changes = progress.run_to_end(machines.job_states(streamed(spark, tmp_path / "jobs", df, [20, 41]), "key"), "jobs", "update")
    last = changes.groupBy("key").agg(F.max(F.struct("seen", (F.col("status") == "timeout").alias("out"), "status")).alias("x")).collect()
    assert {r.key: (r.x.status, r.x.seen) for r in last} == batch
    df = spark.createDataFrame(positions, POSITIONS)
    want = sorted(map(tuple, machines.saved_positions(df, "key").collect()))
    got = progress.run_to_end(machines.saved_positions(streamed(spark, tmp_path / "positions", df, [7, 30]), "key"), "saves", "append")
    assert sorted(map(tuple, got.collect())) == want and 0 < len(want) < 60


def test_no_events(spark):
    assert machines.saved_positions(spark.createDataFrame([], POSITIONS), "key").count() == 0
    assert machines.job_states(spark.createDataFrame([(1, None, 1, "view")], JOBS), "key").count() == 0
