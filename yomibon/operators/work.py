"""Resumable work: what is still to be made of targets in chunks, given what a run that was cut short has left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kana import library_path


def marked(chunks: DataFrame, cache: DataFrame) -> DataFrame:
    """chunks (target, key, ...) with `cached`: whether the target's cache (target, key) has the key. One join on both, so a
    large target is spread over all tasks."""
    kept = cache.select("target", "key").distinct().withColumn("kept", F.lit(True))
    return chunks.join(kept, ["target", "key"], "left").withColumn("cached", F.coalesce("kept", F.lit(False))).drop("kept")


def plan(targets: DataFrame, chunks: DataFrame, cache: DataFrame, outputs: DataFrame, markers: DataFrame, overwrite: bool = False) -> DataFrame:
    """targets (target), chunks of marked(), cache, outputs and markers (target) -> target, n_chunks, n_cached, action, stale.

    An output counts unless its cache is there without a marker of completion: that run was cut short, the output is stale
    and is made again. action: exists, no_chunks, resume (some chunks are kept), build. overwrite makes all again.
    """
    ids = lambda rows, name: rows.select("target").distinct().withColumn(name, F.lit(True))
    sizes = chunks.groupBy("target").agg(F.count(F.lit(1)).alias("n_chunks"), F.count_if("cached").alias("n_cached"))
    rows = ids(targets, "one").drop("one").join(sizes, "target", "left")
    for found, name in ((outputs, "output"), (cache, "has_cache"), (markers, "marker")):
        rows = rows.join(ids(found, name), "target", "left")
    rows = rows.na.fill(False, ["output", "has_cache", "marker"]).na.fill(0, ["n_chunks", "n_cached"])
    cut = F.col("has_cache") & ~F.col("marker")
    action = F.when(F.col("output") & ~cut & F.lit(not overwrite), "exists").when(F.col("n_chunks") == 0, "no_chunks").when(F.col("n_cached") > 0, "resume").otherwise("build")
    return rows.select("target", "n_chunks", "n_cached", action.alias("action"), (F.col("output") & cut & F.lit(not overwrite)).alias("stale"))


def left(chunks: DataFrame, planned: DataFrame) -> DataFrame:
    """The chunks of marked() that are to be made now: those not kept, of targets that are made."""
    made = planned.where("action in ('resume', 'build')").select("target")
    return chunks.where("not cached").drop("cached").join(made, "target", "left_semi")


def completed(chunks: DataFrame) -> DataFrame:
    """target, n_chunks of the targets all of whose chunks are kept: what their markers say."""
    return chunks.groupBy("target").agg(F.count(F.lit(1)).alias("n_chunks"), F.bool_and("cached").alias("all")).where("all").drop("all")


def pending_books(files: DataFrame, folders: DataFrame) -> DataFrame:
    """files (path) of a library and folders (path, is_book) -> path, target: containers whose own folder isn't a book yet.
    The folder has the container's path without its suffix; one that is there but isn't a book doesn't count."""
    path = library_path(F.col("path"))
    rows = files.select(path.alias("path")).where(F.rlike("path", F.lit(r"(?i)[^/]\.epub$"))).distinct()
    books = folders.where("is_book").select(library_path(F.col("path")).alias("target")).distinct()
    return rows.withColumn("target", F.regexp_replace("path", r"(?i)\.epub$", "")).join(books, "target", "left_anti").select("path", "target")
