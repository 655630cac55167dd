"""Word tokens with offsets, and what is computed over them: gaps, rendered offsets, contexts, search.

A text is one row, so its words, their offsets and neighbours are made inside the row, as arrays, and
exploded last: no shuffle. The functions over token tables are for tokens that come as rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import schema
from ..functions.kana import canonical_katakana, fold_small
from ..functions.slices import slices

#: White space that splits words.
SPACE = r" \t\n\x0B\f\r"
WORDS = schema.rows("word string, start long, end long")


_bytes = np.arange(256)
IS_SPACE = np.isin(_bytes, [9, 10, 11, 12, 13, 32])
IS_LETTER = np.isin(_bytes | 32, range(ord("a"), ord("z") + 1)) & (_bytes < 128)


def word_arrays(texts: pa.Array, member: np.ndarray = ~IS_SPACE) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The words of all texts: (words, starts, ends, bounds of each text's words); bytes decide: ASCII ones alone, or all others too."""
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = texts.buffers()[2] if n else None
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    inside = member[data]
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    first, last = offsets[:-1][offsets[:-1] < len(data)], offsets[1:][offsets[1:] > 0] - 1
    before[first], after[last] = False, False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    bounds = np.searchsorted(starts, offsets)
    characters = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # before each byte
    base = np.repeat(characters[offsets[:-1]], np.diff(bounds))
    lengths = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(lengths), pa.py_buffer(data[inside].tobytes())).cast(pa.string())
    return words, characters[starts] - base, characters[ends] - base, bounds


@F.arrow_udf(WORDS)
def words(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The runs without white space, with their offsets."""
    for batch in batches:
        for (texts,) in slices([batch]):
            yield words_of(texts)


@F.arrow_udf(WORDS)
def letter_runs(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The runs of ASCII letters, with their offsets."""
    for batch in batches:
        for (texts,) in slices([batch]):
            yield words_of(texts, IS_LETTER)


def words_of(texts: pa.Array, member: np.ndarray = ~IS_SPACE) -> pa.Array:
    found, starts, ends, bounds = word_arrays(texts, member)
    rows = pa.StructArray.from_arrays([found, pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], ["word", "start", "end"])
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), rows, mask=texts.is_null() if texts.null_count else None)


def plain_words(text: Column) -> Column:
    """The same without offsets, in the JVM."""
    return F.filter(F.split(text, f"[{SPACE}]+"), lambda x: x != "")


def reading_of(word: Column) -> Column:
    """A word without marks; lower-cased it is the surface."""
    return F.regexp_replace(word, r"[^\p{L}\p{N}]", "")


def tokenize(docs: DataFrame, *keys: str) -> DataFrame:
    """docs (keys..., text) -> keys..., token_idx, word, surface, reading, start, end."""
    rows = docs.select(*keys, F.posexplode(words("text")).alias("token_idx", "w"))
    rows = rows.select(*keys, F.col("token_idx").cast("long").alias("token_idx"), F.col("w.word").alias("word"), reading_of(F.col("w.word")).alias("reading"), "w.start", "w.end")
    return rows.withColumn("surface", F.lower("reading"))


def bare_tokens(docs: DataFrame, *keys: str) -> DataFrame:
    """The same without offsets."""
    rows = docs.select(*keys, F.posexplode(plain_words(F.col("text"))).alias("token_idx", "word"))
    return rows.select(*keys, F.col("token_idx").cast("long").alias("token_idx"), F.lower(reading_of(F.col("word"))).alias("surface"), reading_of(F.col("word")).alias("reading"))


def gaps_between(found: Column) -> Column:
    """words in order, none over another -> array<struct<token_idx,gap_start,gap_len>> of the text before each that no word covers."""
    before = lambda i: F.when(i > 0, F.get(found, i - 1)["end"]).otherwise(F.lit(0).cast("long"))
    each = F.transform(found, lambda w, i: F.struct(i.cast("long").alias("token_idx"), before(i).alias("gap_start"), (w["start"] - before(i)).alias("gap_len")))
    return F.filter(each, lambda x: x["gap_len"] > 0)


@F.arrow_udf(schema.rows("t_start long, t_end long"))
def rendered_offsets(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Where words stand in the text that has segments of the given sizes in their places."""
    for batch in batches:
        for found, sizes in slices(list(batch)):
            yield moved_places(found, sizes)


def moved_places(found: pa.Array, sizes: pa.Array) -> pa.Array:
    counts = pc.fill_null(pc.list_value_length(found), 0).to_numpy(zero_copy_only=False)
    listed = found.flatten()
    start, end, size = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in (listed.field("start"), listed.field("end"), sizes.flatten()))
    bounds = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    grown = np.concatenate([[0], np.cumsum(size - (end - start))])
    moved = start + grown[:-1] - np.repeat(grown[bounds[:-1]], counts)
    rows = pa.StructArray.from_arrays([pa.array(moved), pa.array(moved + size)], ["t_start", "t_end"])
    return pa.ListArray.from_arrays(pa.array(bounds), rows, mask=found.is_null() if found.null_count else None)


@F.pandas_udf(schema.LONGS)
def occurrence_numbers(surfaces: pd.Series) -> pd.Series:
    """For each surface of a list how often it has stood so far, itself included."""

    def one(listed):
        seen: Counter[str] = Counter()
        return [seen.update([x]) or seen[x] for x in listed]

    return surfaces.map(one, na_action="ignore")


def gaps(tokens: DataFrame, *keys: str) -> DataFrame:
    """Text between a token and all before it: keys..., token_idx, gap_start, gap_len, where there is some. Tokens may overlap."""
    before = Window.partitionBy(*keys).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    covered = F.coalesce(F.max("end").over(before), F.lit(0).cast("long"))
    rows = tokens.select(*keys, "token_idx", covered.alias("gap_start"), (F.col("start") - covered).alias("gap_len"))
    return rows.where("gap_len > 0")


def rendered(tokens: DataFrame, *keys: str, segment: str = "reading") -> DataFrame:
    """Offsets in the text that has each token's segment in its place: keys..., token_idx, t_start, t_end."""
    ordered = Window.partitionBy(*keys).orderBy("start", "end")
    covered = F.coalesce(F.max("end").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    size = F.char_length(segment)
    rows = tokens.withColumn("gap", F.greatest(F.lit(0).cast("long"), F.col("start") - covered))
    end = F.sum(F.col("gap") + size).over(ordered.rowsBetween(Window.unboundedPreceding, 0)).cast("long")
    return rows.withColumn("t_end", end).select(*keys, "token_idx", (F.col("t_end") - size).alias("t_start"), "t_end")


def occurrences(tokens: DataFrame, *keys: str) -> DataFrame:
    """keys..., surface, token_idx, nth: the k-th token of a surface stands at its k-th occurrence."""
    nth = F.row_number().over(Window.partitionBy(*keys, "surface").orderBy("token_idx"))
    return tokens.where("surface <> ''").select(*keys, "surface", "token_idx", nth.cast("long").alias("nth"))


def neighbours_in(surfaces: Column) -> Column:
    """array<struct<token_idx,surface,previous,following>> of a list of surfaces."""
    return F.transform(surfaces, lambda x, i: F.struct(i.cast("long").alias("token_idx"), x.alias("surface"), F.when(i > 0, F.get(surfaces, i - 1)).alias("previous"), F.get(surfaces, i + 1).alias("following")))


def neighbours(docs: DataFrame, *keys: str) -> DataFrame:
    """docs (keys..., text) -> keys..., token_idx, surface with the surfaces before and after."""
    surfaces = F.transform(plain_words(F.col("text")), lambda w: F.lower(reading_of(w)))
    return docs.select(*keys, surfaces.alias("surfaces")).select(*keys, F.inline(neighbours_in(F.col("surfaces"))))


def search(tokens: DataFrame, surface: str) -> DataFrame:
    """Tokens of one exact surface."""
    return tokens.where(F.col("surface") == F.lit(surface.strip()))


def searched(docs: DataFrame, surface: str, *keys: str, around: int = 3) -> DataFrame:
    """docs (keys..., text) -> keys..., token_idx, prefix, suffix: where a surface stands, with the characters around it.
    A row without the surface is dropped before anything is exploded."""
    wanted = F.lit(surface.strip())
    rows = docs.where(F.contains(F.lower("text"), wanted)).select(*keys, "text", words("text").alias("w"))
    hits = F.filter(F.transform("w", lambda w, i: F.struct(i.cast("long").alias("token_idx"), w["word"].alias("word"), w["start"].cast("int").alias("start"), w["end"].cast("int").alias("end"))), lambda x: F.lower(reading_of(x["word"])) == wanted)
    rows = rows.select(*keys, "text", F.explode(hits).alias("h"))
    prefix = F.expr(f"substring(text, greatest(1, h.start - {around - 1}), least({around}, h.start))")
    return rows.select(*keys, "h.token_idx", prefix.alias("prefix"), F.expr(f"substring(text, h.end + 1, {around})").alias("suffix"))


def flag_ambiguous(tokens: DataFrame, *keys: str, source: str | None = None) -> DataFrame:
    """tokens (keys..., surface, reading[, fallback_reading], reading_source) with `block`: surfaces with several readings.

    Readings that differ in the size or script of kana only are one. With a source only tokens whose source begins with it
    count and are flagged; without one all do.
    """
    said = F.coalesce(F.nullif("reading", F.lit("")), F.col("fallback_reading")) if "fallback_reading" in tokens.columns else F.nullif("reading", F.lit(""))
    concerned = F.lit(True) if source is None else F.coalesce(F.startswith(F.lower("reading_source"), F.lit(source.lower())), F.lit(False))
    counted = F.when(concerned, fold_small(canonical_katakana(said)))
    several = F.size(F.collect_set(counted).over(Window.partitionBy(*keys, "surface"))) > 1
    flagged = several & concerned
    return tokens.withColumn("block", F.coalesce(F.col("block"), F.lit(False)) | flagged if "block" in tokens.columns else flagged)
