"""Speech chunks: bounded pieces of text with offsets, and the accents that fall on them."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import schema
from .intervals import overlap_join
from .tokens import word_arrays

LIMIT = 360
# Marks that end a sentence, and marks that end a clause.
SENTENCE, CLAUSE = "\n。！？!?…‼⁉⁈｡", "、，､,;；:：・—─"
BLOCK = re.compile(r"\S(?:[^\n]|\n(?!\s*(?:\n|\Z)))*")


def cut_at(text: str, limit: int) -> int:
    """Where to cut a text that is too long: after the last sentence mark, else clause mark, else at the limit."""
    for marks in (SENTENCE, CLAUSE):
        at = max(text.rfind(m, 1, limit) for m in marks) + 1  # a mark that begins the text ends nothing
        if at:
            return at
    return max(1, limit)


def split_text(text: str, limit: int = LIMIT) -> list[tuple[str, int, int]]:
    """(chunk, start, end) of the blocks between blank lines, none above the limit; text[start:end] is the chunk."""
    found = []
    for m in BLOCK.finditer(text):
        block, at = m[0].rstrip(), m.start()
        while block:
            end = len(block) if len(block) <= limit else cut_at(block, limit)
            piece = block[:end].rstrip()
            if piece:
                found.append((piece, at, at + len(piece)))
            rest = block[end:].lstrip()
            at += len(block) - len(rest)
            block = rest
    return found


def line_blocks(text: str) -> list[dict]:
    """Runs of lines that aren't blank: the first line's number, the lines, and their characters without line ends."""
    found, last = [], -2
    for i, line in enumerate(text.split("\n")):
        if line.strip(" "):
            if last != i - 1:
                found.append({"first_line": i, "n_lines": 0, "n_chars": 0})
            found[-1]["n_lines"] += 1
            found[-1]["n_chars"] += len(line)
            last = i
    return found


@F.pandas_udf(schema.rows("first_line long, n_lines long, n_chars long"))
def blocks_of_lines(texts: pd.Series) -> pd.Series:
    return texts.map(line_blocks, na_action="ignore")


@F.arrow_udf(schema.rows("chunk_idx long, token_idx long, c_start long, c_end long"))
def words_of_chunks(texts: pa.Array) -> pa.Array:
    """The words of each chunk, cut to it: both come in order, so each chunk's words are a range of the text's."""
    _, starts, ends, bounds = word_arrays(texts)
    parts, sizes = [[], [], [], []], []
    for text, a, b in zip(texts.to_pylist(), bounds[:-1], bounds[1:], strict=True):
        spans = np.array([x[1:] for x in split_text(text)], np.int64).reshape(-1, 2) if text else np.zeros((0, 2), np.int64)
        start, end = starts[a:b], ends[a:b]
        first, last = np.searchsorted(end, spans[:, 0], "right"), np.searchsorted(start, spans[:, 1], "left")
        n = np.maximum(0, last - first)
        chunk = np.repeat(np.arange(len(spans)), n)
        token = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
        at = spans[chunk, 0]
        for part, x in zip(parts, (chunk, token, np.maximum(start[token], at) - at, np.minimum(end[token], spans[chunk, 1]) - at), strict=True):
            part.append(x)
        sizes.append(len(token))
    rows = pa.StructArray.from_arrays([pa.array(np.concatenate([*p, np.zeros(0, np.int64)]), pa.int64()) for p in parts], ["chunk_idx", "token_idx", "c_start", "c_end"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), rows, mask=texts.is_null() if texts.null_count else None)


@F.pandas_udf(T.ArrayType(T.StructType().add("text", "string").add("start", "long").add("end", "long")))
def speech_chunks(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: [{"text": t, "start": a, "end": b} for t, a, b in split_text(x)], na_action="ignore")


def chunked(docs: DataFrame, *keys: str) -> DataFrame:
    """docs (keys..., text) -> keys..., chunk_idx, chunk, start, end."""
    rows = docs.select(*keys, F.posexplode(speech_chunks("text")).alias("chunk_idx", "c"))
    return rows.select(*keys, F.col("chunk_idx").cast("long").alias("chunk_idx"), F.col("c.text").alias("chunk"), F.col("c.start").alias("start"), F.col("c.end").alias("end"))


def chunk_tokens(chunks: DataFrame, tokens: DataFrame, *keys: str) -> DataFrame:
    """Tokens of each chunk with offsets clipped to the chunk: keys..., chunk_idx, token_idx, c_start, c_end."""
    right = tokens.select(*keys, "token_idx", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    both = overlap_join(chunks.select(*keys, "chunk_idx", "start", "end"), right, list(keys))
    return both.select(*keys, "chunk_idx", "token_idx", (F.greatest("start", "r_start") - F.col("start")).alias("c_start"), (F.least("end", "r_end") - F.col("start")).alias("c_end"))


def pitch_signature(parts: Column) -> Column:
    """parts array<struct<start,end,reading,accent>> -> `start:end:reading:accent` in order, joined by a bar."""
    text = lambda p: F.concat_ws(":", p["start"].cast("string"), p["end"].cast("string"), F.coalesce(p["reading"], F.lit("")), F.coalesce(p["accent"].cast("string"), F.lit("")))
    return F.array_join(F.transform(F.array_sort(parts), text), "|")


def accent_index(accent: Column, moras: Column) -> Column:
    """A flat accent (0 or less) falls on the last mora; others stay within 1 and the number of moras. Null stays null."""
    return F.when(accent <= 0, moras).when(accent.isNotNull(), F.greatest(F.lit(1), F.least(accent, moras)))


def phrase_accents(phrases: DataFrame, tokens: DataFrame, *keys: str) -> DataFrame:
    """phrases (keys..., phrase_idx, moras array<string>, accent), tokens (keys..., start, end, accent, pos) of one
    kana text -> the phrases with new_accent: that of the first content token with an accent, else of the first with one."""
    from pyspark.sql import Window

    size = F.aggregate(F.transform("moras", F.char_length), F.lit(0), lambda a, x: a + x)
    place = Window.partitionBy(*keys).orderBy("phrase_idx")
    spans = phrases.withColumn("size", size).withColumn("end", F.sum("size").over(place)).withColumn("start", F.col("end") - F.col("size"))
    right = tokens.where(F.col("accent").isNotNull()).select(*keys, F.col("start").alias("r_start"), F.col("end").alias("r_end"), F.col("accent").alias("t_accent"), "pos")
    both = overlap_join(spans.select(*keys, "phrase_idx", "start", "end"), right, list(keys))
    from ..functions.kana import is_content_pos

    content = F.coalesce(is_content_pos(F.col("pos")), F.lit(False))
    chosen = both.groupBy(*keys, "phrase_idx").agg(F.coalesce(F.min_by(F.when(content, F.col("t_accent")), F.when(content, F.col("r_start"))), F.min_by("t_accent", "r_start")).alias("chosen"))
    rows = spans.join(chosen, [*keys, "phrase_idx"], "left")
    return rows.select(*keys, "phrase_idx", F.coalesce(accent_index(F.col("chosen"), F.size("moras")), F.col("accent")).alias("new_accent"))
