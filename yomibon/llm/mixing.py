"""Mixing sources to target weights by systematic sampling, in DataFrame functions.

Targets. Sources stand by code point, null last, and weigh `weights` in turn; together they get
`share` times all words, but none more than `limit` times its own: what is beyond goes to the
others by weight. The fill level that leaves none above its limit is found in closed form from
running sums over the sources, ordered by limit to weight.

Sampling. Each document of a source is expected target / source_size times. The documents of a
source stand in one order; the running sum of expected copies starts at one random offset a source,
and a document is emitted once for each integer its step crosses. So it is emitted at most `limit`
times (rounded up), and the words taken differ from the target by about one document's size.

The order is by hash bucket of the doc_id, then size, then doc_id. A bucket holds about
`BUCKET_ROWS` documents, so the largest source is spread over many tasks; only counts a bucket are
summed up over a source. Reruns agree: offsets and buckets come from hashes.

Defined results. A null text has size 0 and takes 0 words. Null is a source. Rows that repeat a
doc_id are documents of their own. Sources of size 0 have target 0. An empty table gives an empty
result. Extra columns are kept by mixed() and may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, spare_name, written

WEIGHTS, SHARE, LIMIT = (3, 1, 2), 1.5, 2.0
BUCKET_ROWS = 1024
#: Bytes that a source takes in a broadcast table, for names of usual length.
SOURCE_BYTES = 256
RUN = r"[^\x20\x09-\x0D]+"


def size(text: Column) -> Column:
    """The number of runs without white space."""
    return F.coalesce(F.regexp_count(text, F.lit(RUN)), F.lit(0)).cast("long")


def digits(text: Column, n: int) -> Column:
    """The first n hex digits of a text's md5, as a number."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, n), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """(source, source_size, n) -> the same with target. A row a source, so windows over all of them stay small."""
    every = Window.partitionBy()
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(limit))
    rows = rows.withColumn("at", F.row_number().over(Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())))
    before = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    spent, used = (F.coalesce(F.sum(c).over(before), F.lit(0.0)) for c in ("cap", "weight"))
    level = (F.lit(share) * F.sum("source_size").over(every) - spent) / (F.sum("weight").over(every) - used)
    rows = rows.withColumn("level", level)
    # The first source that its share does not fill sets the level for itself and all after it.
    open_ = F.min(F.when(F.col("weight") * F.col("level") < F.col("cap"), F.struct("at", "level"))).over(every)
    rows = rows.withColumn("open", open_)
    return rows.select("source", "source_size", "n", F.when(F.col("at") < F.coalesce(F.col("open.at"), F.lit(2**31 - 1)), F.col("cap")).otherwise(F.col("weight") * F.col("open.level")).alias("target"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, limit: float = LIMIT, seed: int = 0, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """docs (doc_id, text, source, ...) -> the same rows under a struct `row`, with size, source_size, target, copies."""
    # A null source as a pair of keys that join by equality, so one dealing of the texts serves window and join.
    source, key = F.col("source"), ["name", "none"]
    named = [F.coalesce(source, F.lit("")).alias("name"), source.isNull().alias("none")]
    sized = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"), source.alias("source"), *named, size(F.col("text")).alias("size"))
    known = sized.select("id", "source", *key, "size")
    sources = targets(known.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")), weights, share, limit)
    # Written, so that its size is known before texts are joined with it: a row a source.
    sources = written(sources.select(*named, "source_size", "target", F.ceil(F.col("n") / bucket_rows).alias("buckets")), "sources")
    sources = bounded(sources, sources.count(), SOURCE_BYTES)
    bucket = F.pmod(digits(F.coalesce(F.col("id").cast("string"), F.lit("")), 8), F.col("buckets"))
    counts = known.join(sources, key).withColumn("bucket", bucket).groupBy(*key, "bucket").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy(*key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*key, "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    place = Window.partitionBy(*key, "bucket").orderBy("size", "id")
    rows = sized.join(sources, key).withColumn("bucket", bucket).withColumn("place", F.row_number().over(place)).join(counts, [*key, "bucket"])
    offset = (digits(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("source"), F.lit("\x00"))), 4) + 0.5) / 65536
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    upto = F.col("before") + F.col("place")
    copies = F.floor(expected * upto + offset) - F.floor(expected * (upto - 1) + offset)
    return rows.select("row", "size", "source_size", "target", copies.cast("long").alias("copies"))


def taken(docs: DataFrame, **options) -> DataFrame:
    """docs (doc_id, text, source) -> doc_id, size, source_size, target, taken."""
    rows = mixed(docs.select("doc_id", "text", "source"), **options)
    return rows.select(F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def emitted(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, each as often as the mix takes it."""
    copy = spare_name(docs.columns, "copy")
    rows = mixed(docs, **options).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias(copy))
    return rows.select(*[F.col(f"row.`{c}`") for c in docs.columns])


#: The same in DuckDB's SQL.
SQL = r"""
WITH sized AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n FROM sized GROUP BY source),
w AS (SELECT *, CAST([3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight, source_size * CAST(2 AS DOUBLE) AS cap FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS turn FROM w),
l AS (SELECT *, (CAST(1.5 AS DOUBLE) * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM o),
f AS (SELECT *, min(CASE WHEN weight * level < cap THEN turn END) OVER () AS first FROM l),
t AS (SELECT source, source_size, n, CAST(ceil(n / 1024) AS BIGINT) AS buckets,
    CASE WHEN turn < coalesce(first, 2147483647) THEN cap ELSE weight * max(CASE WHEN turn = first THEN level END) OVER () END AS target FROM f),
b AS (SELECT sized.*, source_size, target, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) % buckets AS bucket
    FROM sized JOIN t ON sized.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY bucket, size, doc_id NULLS FIRST) AS upto,
    CASE WHEN source_size > 0 THEN target / source_size ELSE CAST(0 AS DOUBLE) END AS expected,
    (CAST('0x' || substr(md5('0:' || coalesce(source, chr(0))), 1, 4) AS BIGINT) + CAST(0.5 AS DOUBLE)) / 65536 AS u FROM b)
SELECT doc_id, size, source_size, target, CAST(floor(expected * upto + u) - floor(expected * (upto - 1) + u) AS BIGINT) * size AS taken FROM k
"""
