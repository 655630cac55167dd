"""Reading evidence that is kept as books come, change and go, without reading the other books again.

Sightings are counted by book version, and what a new version changes is a small table of signed counts: the new version's
minus the old one's. Totals are the sums of all changes, so changes are appended, and merged now and then. Sums don't depend
on order or grouping: partial sums meet before the shuffle, and a base that is everywhere is summed in parts like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import evidence

#: What sightings are counted by: a base as it is read, with the text before and after it.
COUNTED = ("base", "reading", "prefix", "suffix")


def counted(sightings: DataFrame, *by: str) -> DataFrame:
    """sightings (by..., base, reading, prefix, suffix) -> the same once, n. A missing context counts as an empty one."""
    rows = sightings.select(*by, "base", "reading", *[F.coalesce(c, F.lit("")).alias(c) for c in ("prefix", "suffix")])
    return rows.where("base is not null and reading is not null").groupBy(*by, *COUNTED).agg(F.count(F.lit(1)).alias("n"))


def tallied(sightings: DataFrame, *by: str) -> DataFrame:
    """sightings -> by..., n: counted by less than all columns, where what is made of the totals takes no more."""
    return sightings.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def undone(counts: DataFrame) -> DataFrame:
    """Counts (..., n) as the change that takes them away."""
    return counts.withColumn("n", -F.col("n"))


def together(*changes: DataFrame, by: tuple[str, ...] = COUNTED) -> DataFrame:
    """Changes (by..., n) one behind the other: totals for what sums them anyway."""
    rows = changes[0].select(*by, "n")
    for other in changes[1:]:
        rows = rows.unionByName(other.select(*by, "n"))
    return rows


def summed(*changes: DataFrame, by: tuple[str, ...] = COUNTED) -> DataFrame:
    """Changes as one; what cancels out is gone."""
    return together(*changes, by=by).groupBy(*by).agg(F.sum("n").alias("n")).where("n <> 0")


def change(old: DataFrame, new: DataFrame) -> DataFrame:
    """The change from the old versions' sightings of some books to the new ones': a book without new ones goes, one without
    old ones comes."""
    return summed(counted(new), undone(counted(old)))


def replaced(kept: DataFrame, new: DataFrame, books: DataFrame, book: str) -> tuple[DataFrame, DataFrame]:
    """kept (book, base, reading, prefix, suffix, n): counts by book; new: sightings of the new versions of `books` (book);
    the counts by book after them, and the change that they make. A book of `books` without new sightings is removed."""
    ids = books.select(book).distinct()
    old, fresh = kept.join(ids, book, "left_semi"), counted(new.join(ids, book, "left_semi"), book)
    after = kept.join(ids, book, "left_anti").unionByName(fresh.select(kept.columns))
    return after, summed(fresh, undone(old))


def readings(totals: DataFrame) -> DataFrame:
    """base, reading, n of totals, summed or not: what evidence.shares and its likes take."""
    return totals.groupBy("base", "reading").agg(F.sum("n").alias("n")).where("n > 0")


def contexts(totals: DataFrame, column: str, most: int = evidence.TOP_CONTEXTS) -> DataFrame:
    """The most frequent prefixes or suffixes of each base in totals, summed or not, with rank."""
    return evidence.top_contexts(totals, column, most, weight="n")


def refreshed(before: DataFrame, totals: DataFrame, changed: DataFrame, made) -> DataFrame:
    """A table by base that `made` makes of totals, brought up to date: rows of bases in the change are made again from the
    totals after it, the others stay as they are in `before`."""
    touched = changed.select("base").distinct()
    again = made(totals.join(touched, "base", "left_semi"))
    return before.join(touched, "base", "left_anti").unionByName(again.select(before.columns))


def corpus(totals: DataFrame) -> DataFrame:
    """base, reading, total of the bases with one dominant reading."""
    return evidence.corpus_filter(readings(totals))
