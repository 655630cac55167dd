"""The tokens of a chapter, from ruby, dictionaries and a lexicon, and the chapter as it is read.

Tiers, each taking what the ones before it leave free: ruby spans (neighbouring spans that make up a
word of the dictionary count as that word, the longest first), words of the book's dictionary, lexicon
words that have ideographs, and lexicon words in the gaps that are left. A chapter is a row with its
spans, so tiers are chosen inside the row and nothing is shuffled; flags, accents and rendering are plans.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kana import NARROW_CJK
from ..sources.markup import katakana
from . import tiers, tokens
from .tiers import compiled, free_spans, lexicon_words, matches

TOKENS = "array<struct<start:long,end:long,surface:string,reading:string,fallback_reading:string,reading_source:string,prefix:string,suffix:string>>"
NARROW = re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m[1], 16)), NARROW_CJK))


def prefixes(mapping: dict[str, str]) -> set[str]:
    """What a compound of the dictionary may begin with."""
    return {word[:n] for word in mapping if len(word) > 1 and NARROW.search(word) for n in range(1, len(word))}


def compound(spans: list, at: int, mapping: dict[str, str], begins: set[str]) -> int:
    """How many spans from `at` on make up the longest word of the dictionary, of two spans or more; 0 if none do."""
    base, end, best = spans[at]["base"], spans[at]["end"], 0
    for n, span in enumerate(spans[at + 1 :], 2):
        if base not in begins or span["start"] != end:
            break
        base, end = base + span["base"], span["end"]
        best = n if base in mapping else best
    return best


def ruby_tier(spans: list, mapping: dict[str, str], lexicon: dict[str, str], begins: set[str]) -> list[tuple[int, int, str, str]]:
    """(start, end, reading, fallback): a reading with ideographs explains, so a plain one stands behind it."""
    found, at = [], 0
    while at < len(spans):
        n, span = compound(spans, at, mapping, begins), spans[at]
        if n:
            reading = mapping["".join(x["base"] for x in spans[at : at + n])]
            found.append((span["start"], spans[at + n - 1]["end"], reading, reading))
        else:
            plain = lexicon.get(span["base"], span["reading"]) if NARROW.search(span["reading"]) else span["reading"]
            found.append((span["start"], span["end"], span["reading"], plain))
        at += max(1, n)
    return found


def chosen(text: str, spans: list, mapping: dict[str, str], lexicon: dict[str, str], tools: tuple) -> list[dict]:
    words, terms, begins = tools
    listed = [(start, end, reading, fallback, "ruby") for start, end, reading, fallback in ruby_tier(spans, mapping, lexicon, begins) if 0 <= start < end <= len(text)]
    listed += [(start, end, reading, reading, "propagation") for start, end, reading in matches(text, mapping, terms) if reading]
    own = lambda at, part: [(at + a, at + b, r, r) for a, b, w, r in lexicon_words(part, lexicon, words) if r and NARROW.search(w)]
    listed += [(*t, "unidic") for t in own(0, text)]
    taken = [t for t, free in zip(listed, free_spans(t[:2] for t in listed), strict=True) if free]
    # What is left between them is looked at by itself.
    at = 0
    for start, end, *_ in [*sorted(taken), (len(text), len(text))]:
        taken += [(*t, "unidic-gap") for t in own(at, text[at:start])] if start > at else []
        at = max(at, end)
    return [
        {"start": a, "end": b, "surface": text[a:b], "reading": katakana(r), "fallback_reading": katakana(f), "reading_source": source, "prefix": text[max(0, a - 3) : a], "suffix": text[b : b + 3]}
        for a, b, r, f, source in sorted(taken)
    ]


def chooser(mapping: dict[str, str], lexicon: dict[str, str]):
    """An Arrow-batched function of (text, spans array<struct<start,end,base,reading>>): the chapter's tokens."""

    @F.pandas_udf(TOKENS)
    def found(texts: pd.Series, spans: pd.Series) -> pd.Series:
        tools = compiled(lexicon), compiled(mapping), prefixes(mapping)
        return pd.Series([None if t is None else chosen(t, sorted(x if x is not None else [], key=lambda s: (s["start"], s["end"])), mapping, lexicon, tools) for t, x in zip(texts, spans, strict=True)])

    return found


def built(docs: DataFrame, mapping: dict[str, str], lexicon: DataFrame, *keys: str) -> DataFrame:
    """docs (keys..., text, spans), lexicon (surface, reading, accent, pos), a word list that each task holds -> a row a
    token: keys..., token_idx, start, end, surface, reading, fallback_reading, reading_source, prefix, suffix, accent,
    pos, block, validated."""
    words = {r.surface: r.reading for r in lexicon.groupBy("surface").agg(F.min("reading").alias("reading")).collect()}
    rows = docs.select(*keys, F.posexplode(chooser(mapping, words)("text", "spans")).alias("token_idx", "t"))
    rows = rows.select(*keys, F.col("token_idx").cast("long").alias("token_idx"), "t.*").withColumn("accent", F.lit(None).cast("long")).withColumn("pos", F.lit(None).cast("string"))
    rows = tiers.harmonized(rows, lexicon)
    rows = tokens.flag_ambiguous(tokens.flag_ambiguous(rows, *keys, source="unidic"), *keys)
    return tiers.with_accents(rows, lexicon)


def rendered(docs: DataFrame, found: DataFrame, *keys: str, partial: bool = False) -> DataFrame:
    """docs (keys..., text) and built() tokens -> keys..., rendered: in katakana, or where a token's reading is sure as written."""
    from ..functions.kana import may_keep_surface

    keep = may_keep_surface(F.col("surface"), F.col("block"), F.col("reading_source"), F.col("validated"))
    return tiers.render(docs.select(*keys, "text"), found.withColumn("keep", keep), *keys, partial=partial)
