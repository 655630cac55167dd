"""Putting chapter texts together and taking them apart, with offsets that follow."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import schema
from .intervals import overlap_join

#: Three dots or more, or two ellipses or more, are one ellipsis; `...…` is two.
RUNS = re.compile(r"\.{3,}|…{2,}")


def collapsed(text: str, offsets: list[int]) -> tuple[str, list[int]]:
    """The text with one ellipsis for each run, and where the offsets are in it: one inside a run is at its ellipsis."""
    moves, out, at, lost = [], [], 0, 0
    for m in RUNS.finditer(text):
        out += [text[at : m.start()], "…"]
        at = m.end()
        moves.append((m.start(), m.end(), lost))
        lost += len(m[0]) - 1
    new = []
    for x in offsets:
        delta = 0
        for start, end, before in moves:
            if x <= start:
                break
            delta = before + (x - start if x < end else end - start - 1)
        new.append(x - delta)
    return "".join([*out, text[at:]]), new


@F.pandas_udf(schema.struct("text string, offsets array<long>"))
def ellipsis_offsets(texts: pd.Series, offsets: pd.Series) -> pd.DataFrame:
    rows = [(None, None) if t is None or x is None else collapsed(t, [int(o) for o in x]) for t, x in zip(texts, offsets, strict=True)]
    return pd.DataFrame(rows, columns=["text", "offsets"])


def trimmed_text(text: Column, marks: str = r"\r\n") -> Column:
    """struct(text, left): without line ends (or other marks) at both ends, and how many went at the start."""
    left = F.char_length(text) - F.char_length(F.regexp_replace(text, f"^[{marks}]+", ""))
    return F.struct(F.regexp_replace(text, f"^[{marks}]+|[{marks}]+$", "").alias("text"), left.cast("long").alias("left"))


def rebased(offset: Column, left: Column, size: Column) -> Column:
    """An offset in a text of which `left` characters went at the start and `size` are left."""
    return F.greatest(F.lit(0).cast("long"), F.least(offset - left, size.cast("long")))


def combined(fragments: DataFrame, key: str, order: str) -> DataFrame:
    """fragments (key, order, text) -> the same rows with `part` (without line ends around it) and its `start` in the
    text of the key, which is the parts that aren't blank, with a blank line between them."""
    rows = fragments.withColumn("part", trimmed_text(F.col("text"))["text"]).where(F.rlike("part", F.lit(r"(?U)\S")))
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("start", F.coalesce(F.sum(F.char_length("part") + 2).over(before), F.lit(0)).cast("long"))


def joined(parts: DataFrame, key: str, order: str) -> DataFrame:
    """The rows of combined() -> key, text."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(order), F.col("part"))))
    return parts.groupBy(key).agg(F.array_join(F.transform(listed, lambda x: x["part"]), "\n\n").alias("text"))


MARKER = r"\[\[CHAPTER:([0-9]+)\]\]"


def marker(order: Column) -> Column:
    """A line that marks where a chapter begins."""
    return F.concat(F.lit("\n[[CHAPTER:"), order.cast("string"), F.lit("]]\n"))


def marked(text: Column, points: Column) -> Column:
    """points array<struct<at,order>> by place -> the text with a marker at each."""
    first = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    step = lambda acc, p: F.struct(F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (p["at"] - acc["at"]).cast("int")), marker(p["order"])).alias("out"), p["at"].cast("long").alias("at"))
    return F.aggregate(F.array_sort(points), first, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.char_length(text))))


def segments(docs: DataFrame, *keys: str) -> DataFrame:
    """docs (keys..., text), marked -> keys..., order, text, start, end: what follows each marker; order null is what leads."""
    # Arrays are columns of their own before they are indexed, so that each is made once a row.
    rows = docs.select(*keys, F.regexp_extract_all("text", F.lit(MARKER), F.lit(0)).alias("marks"), F.split("text", MARKER).alias("parts"))
    rows = rows.withColumn("orders", F.transform("marks", lambda x: F.regexp_extract(x, MARKER, 1).cast("long")))
    sizes = lambda c, n: F.aggregate(F.slice(c, F.lit(1), n), F.lit(0), lambda a, x: a + F.char_length(x))
    # Markers are few, so sums over those before are cheap.
    each = F.transform("parts", lambda p, i: F.struct(F.when(i > 0, F.get("orders", i - 1)).alias("order"), p.alias("text"), (sizes("parts", i) + sizes("marks", i)).cast("long").alias("start")))
    return rows.select(*keys, F.inline(each)).withColumn("end", F.col("start") + F.char_length("text"))


def paired(transformed: DataFrame, original: DataFrame, *keys: str) -> DataFrame:
    """transformed and original segments (keys..., order, text) -> transformed with `original`, empty where there is none."""
    right = original.select(*keys, "order", F.col("text").alias("original"))
    return transformed.join(right, [*keys, "order"], "left").withColumn("original", F.coalesce("original", F.lit("")))


def sliced(parts: DataFrame, spans: DataFrame, *keys: str) -> DataFrame:
    """parts (keys..., order, start, end), spans (keys..., start, end, base, reading) -> keys..., order, base, reading, and
    where they are in the part, cut to it."""
    right = spans.select(*keys, F.col("start").alias("r_start"), F.col("end").alias("r_end"), "base", "reading")
    both = overlap_join(parts.select(*keys, "order", "start", "end"), right, list(keys))
    return both.select(*keys, "order", "base", "reading", (F.greatest("r_start", "start") - F.col("start")).alias("s_start"), (F.least("r_end", "end") - F.col("start")).alias("s_end"))


def without_repeated_titles(docs: DataFrame, *keys: str) -> DataFrame:
    """docs (keys..., text, titles) -> keys..., text: the first line that is a title stays, later ones go, and with each
    title line the blank line behind it."""
    rows = docs.select(*keys, "titles", F.split("text", "\n").alias("lines"))
    rows = rows.withColumn("own", F.transform("lines", lambda x: F.regexp_replace(x, r"^[ \t\r\x{3000}]+|[ \t\r\x{3000}]+$", "")))
    rows = rows.withColumn("is_title", F.transform("own", lambda x: (x != "") & F.array_contains("titles", x)))
    rows = rows.withColumn("first", F.array_position("is_title", F.lit(True)))
    repeats = lambda i: F.get("is_title", i) & (i + 1 > F.col("first"))
    behind = lambda i: (F.get("own", i) == "") & F.coalesce(F.when(i > 0, F.get("is_title", i - 1)), F.lit(False))
    return rows.select(*keys, F.array_join(F.filter("lines", lambda x, i: ~repeats(i) & ~behind(i)), "\n").alias("text"))


def view_segments(tokens: DataFrame, texts: DataFrame, *keys: str) -> DataFrame:
    """tokens (keys..., token_idx, start, end), texts (keys..., text) -> keys..., start, end, token_idx: the text as
    tokens and what is between them (token_idx null), in order; a token shows what earlier ones have not."""
    size = F.char_length("text").cast("long")
    rows = tokens.join(texts, list(keys)).withColumn("start", F.least(F.greatest(F.col("start"), F.lit(0)), size)).withColumn("end", F.least(F.greatest(F.col("end"), F.lit(0)), size)).where("end > start")
    before = Window.partitionBy(*keys).orderBy("start", "token_idx").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("cursor", F.coalesce(F.max("end").over(before), F.lit(0).cast("long")))
    shown = rows.select(*keys, F.greatest("start", "cursor").alias("start"), "end", "token_idx").where("end > start")
    between = rows.where("start > cursor").select(*keys, F.col("cursor").alias("start"), F.col("start").alias("end"), F.lit(None).cast("long").alias("token_idx"))
    last = texts.join(rows.groupBy(*keys).agg(F.max("end").alias("last")), list(keys), "left").select(*keys, F.coalesce("last", F.lit(0).cast("long")).alias("start"), size.alias("end"), F.lit(None).cast("long").alias("token_idx"))
    return shown.unionByName(between).unionByName(last.where("end > start"))


def selected_surface(tokens: DataFrame, selections: DataFrame, *keys: str) -> DataFrame:
    """tokens (keys..., start, end, surface), selections (keys..., selection, start, end) -> keys..., selection, surface:
    the surfaces of all tokens that a selection touches, in order."""
    right = tokens.select(*keys, F.col("start").alias("r_start"), F.col("end").alias("r_end"), "surface")
    both = overlap_join(selections.select(*keys, "selection", "start", "end"), right, list(keys))
    listed = F.array_sort(F.collect_list(F.struct("r_start", "r_end", "surface")))
    return both.groupBy(*keys, "selection").agg(F.array_join(F.transform(listed, lambda x: x["surface"]), "").alias("surface"))
