"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions only.

A benchmark item is cut into windows of `width` consecutive words; an item of fewer words, but
not none, is one window. A document holds a window exactly if it holds the window's words in a
row. The join works as prefix filtering does at containment 1: the words of each window are
ordered by rarity over all documents, and as all of them must occur, the prefix that has to be
joined is the single rarest word. Its offset in the window gives the only possible start in the
document, so candidates are bounded by position and length, then by the second rarest word at
its own offset, and what is left is verified word for word.

The documents are read twice: to count the words of the windows in all of them, and to probe. Either
time words are exploded beside the array they came from and met with a broadcast table in the same
stage, so neither texts nor words are shuffled. What is broadcast is measured in bytes. A benchmark
whose prefixes are too many bytes is probed by 8-byte hashes of its prefix words first, still in one
pass; only the few words around those that pass are then shuffled to the prefixes.

Defined results. A null or wordless text has 0 words and no hits. Rows that repeat doc_id and
text get the same result, once a row. An empty benchmark hits nothing. Wordless items have no
windows. Repeated items with one item_id count once; null item_ids are left out of n_items and
the digest, though their windows still hit. Of words that are equally rare the first by code point is
the prefix, which changes no result. Text without separators is one word, of any length. A very long
text is one array of words, in memory by itself. Extra columns, whatever their names, are ignored by
contamination() and kept by keep_clean().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, bounded, spare_name, words, written

WIDTH = 10
#: Bytes of a row of a broadcast table besides its strings, and of a row of one number.
ROW_BYTES, HASH_BYTES = 64, 16


def item_windows(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """(item, words): the distinct windows of each item."""
    listed = items.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - width + 1))
    return listed.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, width))).alias("words")).distinct()


def total_bytes(df: DataFrame, *strings: str) -> int:
    """The bytes that df takes in a broadcast, by its strings."""
    return df.agg(F.sum(sum((F.octet_length(c) for c in strings), F.lit(ROW_BYTES)))).first()[0] or 0


def rarity(docs_words: DataFrame, windows: DataFrame, broadcast_bytes: int) -> tuple[DataFrame, bool]:
    """(word, n): how often each word of the windows occurs in all documents, written; and whether that is few bytes."""
    vocabulary = written(windows.select(F.explode("words").alias("word")).distinct(), "vocabulary")
    small = total_bytes(vocabulary, "word") <= broadcast_bytes
    # explode_outer, as for explode the words would be made once more to see if there are any.
    each = docs_words.select(F.explode_outer("w").alias("word"))
    if small:
        met = each.join(F.broadcast(vocabulary), "word")
    else:
        hashes = written(vocabulary.select(F.xxhash64("word").alias("h")).distinct(), "hashes")
        met = each.join(bounded(hashes, hashes.count(), HASH_BYTES), F.xxhash64("word") == F.col("h"), "left_semi")
    seen = met.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return written(vocabulary.join(seen, "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("n")), "rarity"), small


def prefixed(windows: DataFrame, counts: DataFrame, small: bool) -> DataFrame:
    """Each distinct window by its hash, with its rarest word and the second rarest, and their offsets."""
    distinct = windows.select("words").distinct()
    at = distinct.select("words", F.posexplode("words").alias("pos", "word")).join(F.broadcast(counts) if small else counts, "word")
    ranked = at.groupBy("words").agg(F.array_sort(F.collect_list(F.struct("n", "word", "pos"))).alias("by"))
    first, second = F.col("by")[0], F.get("by", F.lit(1))
    return ranked.select(
        F.xxhash64("words").alias("window"), F.size("words").alias("len"), first["word"].alias("prefix"), first["pos"].alias("at"),
        F.coalesce(second["word"], first["word"]).alias("next"), F.coalesce(second["pos"], first["pos"]).alias("next_at"),
    ).distinct()


def fits(around: Column, before: Column, n_words: Column) -> Column:
    """Whether the prefix word at `pos` of n_words begins a window that lies in the document and has its words; `around` are the words behind place `before`."""
    start = F.col("pos") - F.col("at")  # 1-based, as the document itself is at 0
    inside = (start >= 1) & (start + F.col("len") - 1 <= n_words)
    first = F.greatest(start - before, F.lit(1))
    return inside & (F.try_element_at(around, first + F.col("next_at")) == F.col("next")) & (F.xxhash64(F.slice(around, first, F.col("len"))) == F.col("window"))


def hits(docs_words: DataFrame, entries: DataFrame, width: int, broadcast_bytes: int) -> DataFrame:
    """docs_words: (key columns..., w). A row for each document and occurrence of a window's hash, and one with null words a document."""
    keys = [c for c in docs_words.columns if c != "w"]
    # The empty string is no word, so it stands for the document itself and keeps those without hits.
    ends = docs_words.select(*keys, "w", F.posexplode_outer(F.concat(F.array(F.lit("")), F.col("w"))).alias("pos", "word"))
    nothing = F.lit(None).cast("array<string>")
    if total_bytes(entries, "prefix", "next") <= broadcast_bytes:
        itself = entries.sparkSession.range(1).select(F.lit(0).cast("long").alias("window"), F.lit(0).alias("len"), F.lit("").alias("prefix"), F.lit(0).alias("at"), F.lit("").alias("next"), F.lit(0).alias("next_at"))
        probe = ends.join(F.broadcast(entries.unionByName(itself)), F.col("word") == F.col("prefix"))
        found = probe.where((F.col("len") == 0) | fits(F.col("w"), F.lit(0), F.size("w")))
        start = F.col("pos") - F.col("at")
        return found.select(*keys, F.size("w").alias("n_words"), start.alias("start"), "len", F.when(F.col("len") > 0, F.slice("w", F.greatest(start, F.lit(1)), F.col("len"))).otherwise(nothing).alias("words"))
    hashes = written(entries.select(F.xxhash64("prefix").alias("h")).union(entries.sparkSession.range(1).select(F.xxhash64(F.lit("")))).distinct(), "hashes")
    before = F.greatest(F.col("pos") - width, F.lit(0))
    met = ends.join(bounded(hashes, hashes.count(), HASH_BYTES), F.xxhash64("word") == F.col("h"), "left_semi")
    met = written(met.select(*keys, F.size("w").alias("n_words"), "pos", "word", before.alias("before"), F.when(F.col("pos") > 0, F.slice("w", before + 1, 2 * width)).alias("around")), "met")
    itself = met.where("pos = 0").select(*keys, "n_words", F.lit(0).alias("start"), F.lit(0).alias("len"), nothing.alias("words"))
    probe = met.where("pos > 0").join(entries, F.col("word") == F.col("prefix")).where(fits(F.col("around"), F.col("before"), F.col("n_words")))
    start = F.col("pos") - F.col("at")
    return itself.unionByName(probe.select(*keys, "n_words", start.alias("start"), "len", F.slice("around", F.greatest(start - F.col("before"), F.lit(1)), F.col("len")).alias("words")))


def contamination(docs: DataFrame, items: DataFrame, width: int = WIDTH, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs (doc_id, text), items (item_id, text) -> doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    listed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), words(F.col("text")).alias("w"))
    windows = written(item_windows(items, width), "windows")
    counts, small = rarity(listed, windows, broadcast_bytes)
    entries = written(prefixed(windows, counts, small), "prefixes")
    found = hits(listed, entries, width, broadcast_bytes)
    keys = ["doc_id", "text_key"]
    found = written(found.groupBy(*keys, "start", "len", "words").agg(F.max("n_words").alias("n_words"), F.count(F.lit(1)).alias("n")), "hits")
    # The words decide, not the hash. A window is in few items as a rule, but a row each keeps that unbounded.
    owned = found.where("len = 0").withColumn("item", F.lit(None).cast("string")).unionByName(found.where("len > 0").join(windows, "words"))
    spans = owned.groupBy(*keys).agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.max(F.when(F.col("len") == 0, F.col("n"))).alias("copies"),
        F.array_sort(F.collect_set(F.when(F.col("len") > 0, F.struct("start", (F.col("start") + F.col("len")).alias("end"))))).alias("spans"),
        F.array_sort(F.collect_set("item")).alias("items"),
    )
    # The spans come in order of their starts, so each adds what lies beyond the furthest end so far.
    covered = F.aggregate(
        "spans", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda acc, s: F.struct((acc["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(acc["end"], s["start"]))).alias("n"), F.greatest(acc["end"], s["end"]).alias("end")),
        lambda acc: acc["n"].cast("long"),
    )
    result = spans.select(
        "doc_id", "n_words", covered.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"), "copies", "text_key",
    )
    each = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return result.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "text_key", each.alias("copy")).drop("copy", "text_key")


def keep_clean(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of docs without those of contaminated documents, by doc_id; rows without a doc_id, by their text."""
    pairs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.md5(F.col("text").cast("binary")))).alias("doc_id"), "text")
    bad = written(contamination(pairs, items, **options).where("contaminated").select(F.col("doc_id").alias("bad")).distinct(), "contaminated")
    key = spare_name(docs.columns, "bad")
    own = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.md5(F.col("text").cast("binary"))))
    return docs.join(bounded(bad.withColumnRenamed("bad", key), bad.count(), 64), own == F.col(key), "left_anti")


#: The same in DuckDB's SQL.
SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS k, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item, w[s:s + 9] AS words, len(w[s:s + 9]) AS n FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
g AS (SELECT k, n, s, w[s:s + n - 1] AS words FROM (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT DISTINCT g.k, g.s, g.n, win.item FROM g JOIN win ON g.words = win.words),
pos AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(s, s + n)) AS p FROM hit) GROUP BY k),
its AS (SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT k, item FROM hit) GROUP BY k)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (k) LEFT JOIN its USING (k)
"""
