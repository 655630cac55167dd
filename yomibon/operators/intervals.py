"""Joins on overlapping intervals, as equi-joins on buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH = 360


def buckets(start: Column, end: Column, width: int) -> Column:
    return F.sequence(F.floor(start / width), F.floor(F.greatest(start, end - 1) / width))


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], width: int = WIDTH) -> DataFrame:
    """left (keys..., start, end, ...) x right (keys..., r_start, r_end, ...) where the half-open intervals overlap.

    Each side is dealt to the buckets it touches; a pair is taken in the bucket where its overlap
    begins, so none comes twice and nothing has to be made distinct.
    """
    a = left.withColumn("bucket", F.explode(buckets(F.col("start"), F.col("end"), width)))
    b = right.withColumn("bucket", F.explode(buckets(F.col("r_start"), F.col("r_end"), width)))
    both = a.join(b, [*keys, "bucket"])
    begins = F.greatest("start", "r_start")
    return both.where((F.col("start") < F.col("r_end")) & (F.col("r_start") < F.col("end")) & (F.floor(begins / width) == F.col("bucket"))).drop("bucket")
