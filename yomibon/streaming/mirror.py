"""A folder's mirror: what two listings differ by, and a view of files that follows creates, changes, deletes and moves.

The view is kept as two tables: the last time each path was put, and the last time each path was removed, folders with all
below them. Both are greatest values by path, so a batch that is run twice, or late, or beside another, gives the same view.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.library import ancestors

#: The files that are mirrored.
PATTERN = r"(?i)\.mp3$"
LEDGER = "path string, put struct<seq:{seq},length:bigint>, removed {seq}"


def differences(before: DataFrame, after: DataFrame) -> DataFrame:
    """Listings (path, digest, length) of one folder -> path, op, origin, of what differs: create, change, delete, or move
    from origin.

    A path that came and one that went with the same content are a move; several of one content are paired in the order of
    their paths, and the rest come or go. Paths that a listing has twice count once, by their greatest digest.
    """
    one = lambda rows: rows.where("path is not null").groupBy("path").agg(F.max(F.struct("digest", "length")).alias("x"))
    rows = one(before).withColumnRenamed("x", "old").join(one(after).withColumnRenamed("x", "new"), "path", "full_outer")
    op = F.when(F.col("old").isNull(), "create").when(F.col("new").isNull(), "delete").otherwise("change")
    rows = rows.where(~F.equal_null("old", "new")).select("path", op.alias("op"), F.coalesce("new", "old").alias("x"))
    turn = F.row_number().over(Window.partitionBy("op", "x").orderBy("path"))
    moved = F.col("op").isin("create", "delete") & F.col("x.digest").isNotNull()
    ends = rows.where(moved).withColumn("turn", turn)
    gone = ends.where("op = 'delete'").select("x", "turn", F.col("path").alias("origin"))
    came = ends.where("op = 'create'").select("x", "turn", "path")
    pairs = came.join(gone, ["x", "turn"], "full_outer")
    op = F.when(F.col("origin").isNull(), "create").when(F.col("path").isNull(), "delete").otherwise("move")
    ended = pairs.select(F.coalesce("path", "origin").alias("path"), op.alias("op"), F.when(op == "move", F.col("origin")).alias("origin"))
    return ended.unionByName(rows.where(~moved).select("path", "op", F.lit(None).cast("string").alias("origin")))


def clean(path: Column) -> Column:
    """A path without empty parts, so that a folder and what is below it compare."""
    return F.array_join(F.filter(F.split(path, "/"), lambda x: x != ""), "/")


def ledger(events: DataFrame, pattern: str = PATTERN) -> DataFrame:
    """events (seq, op, path, target, folder, length), seq of any ordered type -> path, put, removed: a row a path.

    create and change put a file there; delete removes a file, or a folder with all in it; move removes the path and, of a
    file, puts it at its target. Only files of the pattern are put. Events without a path or seq say nothing.
    """
    rows = events.where("path is not null and seq is not null").select("seq", "op", clean(F.col("path")).alias("path"), clean(F.col("target")).alias("target"), F.coalesce("folder", F.lit(False)).alias("folder"), F.col("length").cast("long").alias("length"))
    at = F.when(F.col("op") == "move", F.col("target")).when(F.col("op").isin("create", "change"), F.col("path"))
    fits = ~F.col("folder") & F.rlike(at, F.lit(pattern))
    nothing = F.lit(None)
    puts = rows.where(fits).select(at.alias("path"), F.struct("seq", "length").alias("put"), nothing.cast(rows.schema["seq"].dataType).alias("removed"))
    gone = rows.where("op in ('delete', 'move')").select("path", nothing.cast(puts.schema["put"].dataType).alias("put"), F.col("seq").alias("removed"))
    return merged(puts.unionByName(gone))


def merged(rows: DataFrame) -> DataFrame:
    """Rows of ledgers as one ledger: greatest values by path."""
    return rows.groupBy("path").agg(F.max("put").alias("put"), F.max("removed").alias("removed"))


def view(rows: DataFrame) -> DataFrame:
    """A ledger -> path, seq, length of the files that are there: put after any removal of them and of the folders above.
    A file that is moved onto itself stays: a put wins over a removal of the same event."""
    puts = rows.where("put is not null").select("path", "put")
    gone = rows.where("removed is not null").select(F.col("path").alias("above"), "removed")
    last = puts.select("path", F.explode(ancestors(F.col("path"))).alias("above")).join(gone, "above").groupBy("path").agg(F.max("removed").alias("removed"))
    left = puts.join(last, "path", "left").where("removed is null or put.seq >= removed")
    return left.select("path", "put.seq", "put.length")


def follow(stream: DataFrame, folder: str, pattern: str = PATTERN) -> None:
    """Runs a stream of events over all there is into a ledger in a shared folder, a folder a batch: one that is run again
    replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        ledger(batch, pattern).write.mode("overwrite").parquet(f"{folder}/ledger/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def followed(spark: SparkSession, folder: str, seq: str = "long") -> DataFrame:
    """The view of a followed folder; seq: the type of the events' seq."""
    rows = spark.read.schema(LEDGER.format(seq=seq)).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(f"{folder}/ledger")
    return view(merged(rows))
