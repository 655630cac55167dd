"""Queries over a library of books: listings, rollups, bookmarks, progress, settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kana import folded, library_path
from ..storage import written


def latest(events: DataFrame, key: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The last row of each key: an aggregate, so partial results are combined before the shuffle."""
    return events.groupBy(*key).agg(F.max(F.struct(*order, *columns)).alias("last")).select(*key, *[F.col(f"last.{c}").alias(c) for c in dict.fromkeys([*order, *columns])])


def status_label(queued: Column, building: Column, chunk: Column, chunks: Column, error: Column, played: Column, ready: Column, cached: Column | None = None) -> Column:
    """The label of a chapter's state, the first that holds; cached: chunks of it are kept, but not the whole."""
    return (
        F.when(error, F.lit("error"))
        .when(building & (chunks > 0), F.concat(F.lit("building "), chunk.cast("string"), F.lit("/"), chunks.cast("string")))
        .when(building, F.lit("building"))
        .when(queued, F.lit("queued"))
        .when(ready & played, F.lit("played"))
        .when(ready, F.lit("ready"))
        .when(F.lit(False) if cached is None else F.coalesce(cached, F.lit(False)), F.lit("cached"))
        .otherwise(F.lit("pending"))
    )


def ancestors(path: Column) -> Column:
    """All folders above and including a path: a, a/b, a/b/c."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def rollup(items: DataFrame, path: str, order: str, samples: int = 4) -> DataFrame:
    """items (path, order) -> folder, n, first, sample: recursive counts, least order, first samples of each folder."""
    rows = items.select(F.col(order).alias("o"), F.explode(ancestors(F.col(path))).alias("folder"))
    # Samples are limited before they are collected, by rank, so a large folder stays bounded.
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("folder").orderBy("o")))
    counts = rows.groupBy("folder").agg(F.count(F.lit(1)).alias("n"), F.min("o").alias("first"))
    some = ranked.where(F.col("rank") <= samples).groupBy("folder").agg(F.array_join(F.array_sort(F.collect_list("o")).cast("array<string>"), ",").alias("sample"))
    return counts.join(some, "folder")


def completion(items: DataFrame, done: Column, *keys: str) -> DataFrame:
    return items.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), F.count_if(done).alias("completed"), F.count_if(~done).alias("pending"))


def preferred(saved: Column, config: Column, default) -> Column:
    """Settings precedence; 0 is a value."""
    return F.coalesce(saved, config, F.lit(default))


def author_order(author: str, title: str, name: str) -> list[Column]:
    """With an author first, then author, title, name, whatever the case."""
    return [F.col(author).isNull(), folded(F.col(author)), folded(F.col(title)), folded(F.col(name))]


def recent_order(created: str, author: str, title: str, name: str) -> list[Column]:
    """The newest first, then by author."""
    return [F.desc(created), *author_order(author, title, name)]


def played_order(played: str, modified: str, author: str, title: str, name: str) -> list[Column]:
    """Played ones first, the last played of them, then the last changed, then by author."""
    return [F.col(played).isNull(), F.desc(played), F.desc(modified), *author_order(author, title, name)]


def placed(rows: DataFrame, *order: Column, dense: bool = False) -> DataFrame:
    """rows with `place` in one order of all, from 1. They are dealt by ranges of the order, numbered in each range, and
    the counts of the ranges are summed: one row a range meets in one task, not one a row. dense: equal rows have one place."""
    dealt = written(rows.repartitionByRange(*order).withColumn("range_", F.spark_partition_id()), "ranges")
    within = Window.partitionBy("range_").orderBy(*order)
    number = F.dense_rank() if dense else F.row_number()
    sized = dealt.withColumn("place", number.over(within))
    before = sized.groupBy("range_").agg(F.max("place").alias("n"))
    before = before.select("range_", F.coalesce(F.sum("n").over(Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return sized.join(F.broadcast(before), "range_").withColumn("place", (F.col("place") + F.col("before")).cast("long")).drop("range_", "before")


def from_place(rows: DataFrame, first: int, *order: Column) -> DataFrame:
    """The rows from a place on, counted from 1; a place behind the last one is an error of the caller and gives none."""
    return placed(rows, *order).where(F.col("place") >= first).drop("place")


def stalled(events: DataFrame, key: str, seconds: int = 600) -> DataFrame:
    """key, since, gap: pauses of at least so many seconds between events of a key; ties in time by event_id."""
    before = F.lag("ts").over(Window.partitionBy(key).orderBy("ts", "event_id"))
    gap = F.unix_timestamp(F.col("ts").cast("timestamp")) - F.unix_timestamp(F.col("since").cast("timestamp"))
    return events.withColumn("since", before).where("since is not null").select(key, "event_id", gap.alias("gap")).where(F.col("gap") >= seconds)


def deduped(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("turn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("turn = 1").drop("turn")


def next_playable(chapters: DataFrame, key: str, order: str, playable: Column) -> DataFrame:
    """key, order, previous, following: the nearest playable chapters on either side."""
    place = Window.partitionBy(key).orderBy(order)
    at = F.when(playable, F.col(order))
    before = F.last(at, ignorenulls=True).over(place.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(at, ignorenulls=True).over(place.rowsBetween(1, Window.unboundedFollowing))
    return chapters.select(key, order, before.alias("previous"), after.alias("following"))


def upserted(current: DataFrame, changes: DataFrame, key: str, value: str) -> DataFrame:
    """Settings after changes: a null change deletes, others replace or add."""
    new = changes.select(F.col(key).alias("k_"), F.col(value).alias("v_"), F.lit(True).alias("changed"))
    both = current.join(new, F.col(key) == F.col("k_"), "full_outer")
    rows = both.select(F.coalesce(key, "k_").alias(key), F.when(F.col("changed"), F.col("v_")).otherwise(F.col(value)).alias(value))
    return rows.where(F.col(value).isNotNull())


def bookmarks(events: DataFrame) -> DataFrame:
    """(book, id, op, chapter, time, label, ts) add/label/delete events -> the bookmarks left, sorted per book by chapter and time."""
    last = latest(events, ["book", "id"], ["ts"], ["op", "chapter", "time", "label"])
    return last.where("op <> 'delete'").orderBy("book", "chapter", "time")


def latest_marks(events: DataFrame) -> DataFrame:
    """(book, id, op, chapter, time, label, ts) events -> book, id, chapter, time, label of the bookmarks left: an `add` sets
    chapter, time and label, a later `label` the label alone, a `delete` takes the bookmark away."""
    placed_ = events.where("op in ('add', 'delete')").groupBy("book", "id").agg(F.max(F.struct("ts", "op", "chapter", "time", "label")).alias("last"))
    labels = events.where("op = 'label'").groupBy("book", "id").agg(F.max(F.struct("ts", "label")).alias("named"))
    rows = placed_.where("last.op = 'add'").join(labels, ["book", "id"], "left")
    label = F.when(F.col("named.ts") > F.col("last.ts"), F.col("named.label")).otherwise(F.col("last.label"))
    return rows.select("book", "id", "last.chapter", "last.time", label.alias("label"))


def played_chapters(events: DataFrame) -> DataFrame:
    """(book, op, chapter, time, ts) events -> book, last_chapter, last_time, played: where the book was last played, null
    after a later `clear`, and the chapters marked as played, each once, in the order of their first mark."""
    last = events.where("op in ('play', 'clear')").groupBy("book").agg(F.max(F.struct("ts", "op", "chapter", "time")).alias("last"))
    marks = events.where("op = 'mark'").groupBy("book", "chapter").agg(F.min("ts").alias("ts"))
    marks = marks.groupBy("book").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "chapter"))), lambda x: x["chapter"]).alias("played"))
    rows = last.join(marks, "book", "full_outer")
    at = F.when(F.col("last.op") == "play", F.col("last"))
    return rows.select("book", at["chapter"].alias("last_chapter"), at["time"].alias("last_time"), F.coalesce("played", F.array().cast("array<string>")).alias("played"))


def with_metadata(chapters: DataFrame, metadata: DataFrame) -> DataFrame:
    """chapters (book, file, ...) with title, author and chapter_title of the metadata (book, file, ...): without an entry the
    file's stem is the title, and the track is the number that the name begins with."""
    from ..functions.kana import track_number

    known = metadata.select("book", "file", F.col("title").alias("book_title"), "author", F.col("chapter_title").alias("listed"), F.col("index").alias("listed_index"))
    rows = chapters.join(known, ["book", "file"], "left")
    name = F.regexp_extract("file", r"([^/]*)$", 1)
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    return rows.withColumn("chapter_title", F.coalesce(F.nullif("listed", F.lit("")), stem)).withColumn("track", F.coalesce("listed_index", track_number(name))).drop("listed", "listed_index")


def with_status(chapters: DataFrame, status: DataFrame) -> DataFrame:
    """chapters (book, file, ready[, cached]) with the live status (book, file, state, chunk, chunks): what is being built, else what is there."""
    rows = chapters.join(status, ["book", "file"], "left")
    state = F.coalesce("state", F.lit(""))
    label = status_label(state == "queued", state == "building", F.col("chunk"), F.coalesce("chunks", F.lit(0)), state == "error", F.lit(False), F.col("ready"), F.col("cached") if "cached" in chapters.columns else None)
    return rows.select("book", "file", label.alias("label"))


def chapter_order() -> list[Column]:
    """Chapters by place in the book, then in the file, then as they came."""
    return [F.col("spine_index"), F.col("order"), F.col("sequence")]


def chapters_of(leading: DataFrame, named: DataFrame) -> DataFrame:
    """leading (book, spine_index, sequence, text, has_points): text before a file's first point of the contents, or of a file
    without; named (book, spine_index, local_order, nav_order, text) -> book, spine_index, order, sequence, text: blank ones
    left out. What leads a file with points stands before them."""
    first = leading.select("book", "spine_index", F.when(F.col("has_points"), -1).otherwise(0).alias("order"), F.col("sequence").alias("sequence"), "text")
    rest = named.select("book", "spine_index", (F.col("local_order") + 1).alias("order"), F.col("nav_order").alias("sequence"), "text")
    return first.unionByName(rest).where(F.rlike("text", F.lit(r"(?U)\S")))


def sample_order() -> list[Column]:
    """Voice samples: the newest first, without a time last, then character and voice."""
    return [F.col("created_at").desc_nulls_last(), folded(F.coalesce("character", F.lit(""))), F.coalesce("voice_id", F.lit(0))]


def roster(samples: DataFrame) -> DataFrame:
    """samples (id, character, style) -> character, voices array<struct<id,style>>: each id once, voices by id."""
    one = samples.groupBy("id").agg(F.min(F.struct("character", "style")).alias("x"))
    return one.groupBy(F.col("x.character").alias("character")).agg(F.array_sort(F.collect_list(F.struct("id", F.col("x.style").alias("style")))).alias("voices"))


def filtered_chapters(chapters: DataFrame, query: str) -> DataFrame:
    """Chapters whose path or book has the query in it, whatever the case; an empty query has all."""
    wanted = F.lower(F.lit(query.strip()))
    return chapters.where(F.contains(F.lower("path"), wanted) | F.contains(F.lower("book"), wanted))


def queue_decisions(requests: DataFrame, files: DataFrame, books: DataFrame) -> DataFrame:
    """requests (path), files (path) that there are, books (folder) that are done -> path, reason: null if it is queued, else
    why not; a path that is asked for several times counts once."""
    asked = requests.select(F.col("path").alias("asked"), library_path(F.col("path")).alias("path"))
    asked = asked.groupBy(F.when(F.coalesce("path", F.lit("")) != "", F.col("path")).otherwise(F.col("asked")).alias("path"), (F.coalesce("path", F.lit("")) == "").alias("invalid")).agg(F.lit(1).alias("one")).drop("one")
    rows = asked.join(files.select(F.col("path").alias("there")).distinct(), F.col("path") == F.col("there"), "left")
    rows = rows.join(books.select(F.col("folder").alias("done")).distinct(), F.regexp_replace("path", r"(?i)\.epub$", "") == F.col("done"), "left")
    reason = (
        F.when(F.col("invalid"), "Invalid path.")
        .when(~F.endswith(F.lower("path"), F.lit(".epub")), "Not an EPUB file.")
        .when(F.col("there").isNull(), "File not found.")
        .when(F.col("done").isNotNull(), "Book already chapterized.")
    )
    return rows.select("path", reason.alias("reason"))


def missing_chunks(chunks: DataFrame, cache: DataFrame, force: bool = False) -> DataFrame:
    """chunks (..., key) that are still to be made: those whose key isn't in the cache (key), or all."""
    return chunks if force else chunks.join(cache.select("key").distinct(), "key", "left_anti")


def age_seconds(now: Column, then: Column) -> Column:
    return F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(then.cast("timestamp"))


def iso_utc(at: Column) -> Column:
    """An instant as ISO 8601 in UTC, to the second."""
    return F.date_format(at.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
