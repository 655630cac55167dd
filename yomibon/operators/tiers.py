"""Tokens of a chapter from tiers of candidates, and the text rendered from them.

Candidates come from ruby spans, dictionaries and a lexicon; a tier takes what earlier tiers leave
free. Selection depends on what was taken before, so it runs by chapter, in slices of Arrow batches;
finding the candidates and everything after the selection are plans.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import schema
from ..functions.kana import WIDE_CJK, canonical_katakana, ellipsis, engine_kana, has_kanji, is_cjk_narrow
from ..functions.slices import by_row

FOUND = schema.rows("start long, end long, surface string, reading string")
#: The wide class of ideographs, as Python has it.
CJK = re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m[1], 16)), WIDE_CJK))


def match_allowed(text: str, start: int, end: int) -> bool:
    """A match may not cut a run of digits; one character may not stand beside an ideograph, nor a lone ASCII one in a word."""
    before, after = text[start - 1 : start] if start else "", text[end : end + 1]
    key = text[start:end]
    if (key[0].isdigit() and before.isdigit()) or (key[-1].isdigit() and after.isdigit()):
        return False
    if len(key) == 1:
        if CJK.match(before) or CJK.match(after):
            return False
        if key.isascii() and key.isalnum() and any(x.isascii() and x.isalnum() for x in (before, after)):
            return False
    return True


def matches(text: str, mapping: dict[str, str], pattern: re.Pattern) -> Iterable[tuple[int, int, str]]:
    """Leftmost, longest-first matches; one that isn't allowed uses up its characters all the same."""
    for m in pattern.finditer(text):
        if match_allowed(text, m.start(), m.end()):
            yield m.start(), m.end(), mapping[m[0]]


def compiled(mapping: dict[str, str]) -> re.Pattern:
    return re.compile("|".join(re.escape(k) for k in sorted(mapping, key=lambda k: (-len(k), k)) if k) or "(?!)")


def replacer(mapping: dict[str, str]):
    """An Arrow-batched function that replaces dictionary keys by their readings."""

    @F.pandas_udf("string")
    def replaced(texts: pd.Series) -> pd.Series:
        pattern = compiled(mapping)

        def one(text: str) -> str:
            parts, at = [], 0
            for start, end, reading in matches(text, mapping, pattern):
                parts += [text[at:start], reading]
                at = end
            return "".join([*parts, text[at:]])

        return texts.map(one, na_action="ignore")

    return replaced


def candidate_finder(mapping: dict[str, str]):
    """An Arrow-batched function: the dictionary's candidates in a text."""

    pattern = compiled(mapping)

    @by_row(FOUND)
    def found(text):
        return None if text is None else [{"start": a, "end": b, "surface": text[a:b], "reading": r} for a, b, r in matches(text, mapping, pattern)]

    return found


def candidates(docs: DataFrame, mapping: dict[str, str], tier: int, source: str, *keys: str) -> DataFrame:
    rows = docs.select(*keys, F.inline(candidate_finder(mapping)("text")))
    return rows.select(*keys, F.lit(tier).alias("tier"), "start", "end", "surface", "reading", F.lit(source).alias("reading_source"))


def select_free(rows: DataFrame, *keys: str) -> DataFrame:
    """candidates (keys..., tier, start, end, ...) -> those that overlap no accepted one, by tier, start, longest first."""

    listed = F.collect_list(F.struct(*[c for c in rows.columns if c not in keys]))
    part = lambda name: F.transform("found", lambda x: x[name])
    picked = free_places(part("tier"), part("start"), part("end"), part("surface"))
    found = rows.groupBy(*keys).agg(listed.alias("found")).withColumn("picked", picked)
    return found.select(*keys, F.inline(F.transform("picked", lambda k: F.get("found", k)))).select(*rows.columns)


@by_row(T.ArrayType(T.IntegerType()))
def free_places(tier: list[int], start: list[int], end: list[int], surface: list[str]) -> list[int]:
    """Which of a text's candidates are taken."""
    order = sorted(range(len(start)), key=lambda k: (tier[k], start[k], start[k] - end[k], surface[k] is None, surface[k] or ""))
    return [k for k, free in zip(order, free_spans((start[k], end[k]) for k in order), strict=True) if free]


def free_spans(spans: Iterable[tuple[int, int]]) -> list[bool]:
    """Whether each span overlaps none of those accepted before it; the accepted ones are kept sorted."""
    starts, ends, keep = [], [], []
    for start, end in spans:
        at = bisect_right(starts, start)
        free = (at == 0 or ends[at - 1] <= start) and (at == len(starts) or starts[at] >= end)
        if free:
            starts.insert(at, start)
            ends.insert(at, end)
        keep.append(free)
    return keep


def render(docs: DataFrame, tokens: DataFrame, *keys: str, partial: bool = False) -> DataFrame:
    """docs (keys..., text), tokens (keys..., start, end, surface, reading, keep) -> keys..., rendered.

    Every token gives its reading, but for partial texts one that may keep its surface gives that.
    """
    segment = F.coalesce("reading", "surface")
    segment = F.when(F.col("keep"), F.col("surface")).otherwise(segment) if partial else segment
    parts = tokens.select(*keys, "start", "end", segment.alias("segment")).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start", "end", "segment"))).alias("parts"))
    rows = docs.join(parts, list(keys), "left")
    first = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    piece = lambda acc, p: F.concat(acc["out"], F.substring(F.col("text"), (acc["at"] + 1).cast("int"), (p["start"] - acc["at"]).cast("int")), p["segment"])
    text = F.aggregate(F.coalesce("parts", F.array().cast("array<struct<start:bigint,end:bigint,segment:string>>")), first, lambda acc, p: F.struct(piece(acc, p).alias("out"), p["end"].cast("long").alias("at")))
    rows = rows.withColumn("built", text)
    return rows.select(*keys, F.concat(F.col("built.out"), F.expr("substring(text, cast(built.at + 1 as int))")).alias("rendered"))


def harmonized(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Readings that differ from the lexicon's only in small kana take the lexicon's."""
    from ..functions.kana import small_kana_only

    known = lexicon.groupBy("surface").agg(F.min("reading").alias("lex_reading"))
    rows = tokens.join(known, "surface", "left")
    return rows.withColumn("reading", F.when(small_kana_only(F.col("reading"), F.col("lex_reading")), F.col("lex_reading")).otherwise(F.col("reading"))).drop("lex_reading")


def lexicon_tokens(docs: DataFrame, lexicon: dict[str, str], *keys: str) -> DataFrame:
    """A dictionary tokenizer: leftmost-longest lexicon words, and the runs of text between them as tokens without a reading."""
    found = docs.select(*keys, F.posexplode(word_finder(lexicon)("text")).alias("idx", "t"))
    return found.select(*keys, F.col("idx").cast("long").alias("idx"), "t.start", "t.end", "t.surface", "t.reading")


def lexicon_words(text: str, lexicon: dict[str, str], pattern: re.Pattern) -> list[tuple[int, int, str, str | None]]:
    found, at = [], 0
    for m in [*pattern.finditer(text), None]:
        start = m.start() if m else len(text)
        if start > at:
            found.append((at, start, text[at:start], None))
        if m:
            found.append((start, m.end(), m[0], lexicon[m[0]]))
            at = m.end()
    return found


def word_finder(lexicon: dict[str, str]):
    pattern = compiled(lexicon)

    @by_row(FOUND)
    def found(text):
        return None if text is None else [{"start": a, "end": b, "surface": w, "reading": r} for a, b, w, r in lexicon_words(text, lexicon, pattern)]

    return found


def reading_text(words: Column) -> Column:
    """lexicon words in order -> the text as it is read: words with ideographs by their reading, all else as it is written."""
    return F.array_join(F.transform(words, spoken), "")


def spoken(word: Column) -> Column:
    return canonical_katakana(F.when(is_cjk_narrow(word["surface"]), F.coalesce(word["reading"], word["surface"])).otherwise(word["surface"]))


def pitch_tokens(docs: DataFrame, lexicon: dict[str, str], *keys: str) -> DataFrame:
    """keys..., idx, surface, reading, start, end: words with ideographs and a reading, by where they are in reading_text()."""
    words = docs.select(*keys, word_finder(lexicon)("text").alias("words"))
    # Lengths are summed by text, over the words of one row: explode keeps their order, and the window their text.
    rows = words.select(*keys, F.posexplode("words").alias("idx", "w")).withColumn("said", spoken(F.col("w")))
    upto = Window.partitionBy(*keys).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.char_length("said")).over(upto).cast("long"))
    return rows.where(is_cjk_narrow(F.col("w.surface")) & F.col("w.reading").isNotNull()).select(*keys, F.col("idx").cast("long").alias("idx"), "w.surface", F.col("said").alias("reading"), (F.col("end") - F.char_length("said")).alias("start"), "end")


def plain_reading(normalised: Column) -> Column:
    """A text's reading without a dictionary, after NFKC: katakana for kana, and ellipses made one."""
    return ellipsis(canonical_katakana(normalised))


def sure_words(lexicon: DataFrame) -> DataFrame:
    """surface, lex: the least (reading, accent, pos) with an accent, where those have one reading."""
    sure = F.countDistinct("reading") == 1
    return lexicon.where("accent is not null").groupBy("surface").agg(F.min(F.struct("reading", "accent", "pos")).alias("lex"), sure.alias("sure")).where("sure").select("surface", "lex")


def with_accents(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """tokens (surface, reading, fallback_reading, reading_source, accent, pos, ...) with accents and parts of speech of the
    lexicon (surface, reading, accent, pos) where it has one word with that reading; `validated` says if it has, and is
    true of tokens that came from the dictionary. Surfaces and readings are compared after NFKC."""
    rows = tokens.join(sure_words(lexicon), "surface", "left")
    reading = canonical_katakana(F.coalesce(F.nullif("reading", F.lit("")), F.col("fallback_reading")))
    own = F.lower(F.coalesce("reading_source", F.lit(""))) == "unidic"
    same = F.coalesce(canonical_katakana(F.col("lex.reading")) == reading, F.lit(False)) & ~own
    rows = rows.withColumn("validated", same | (own & reading.isNotNull()))
    filled = same & F.col("accent").isNull()
    return rows.withColumn("pos", F.when(filled, F.coalesce("pos", "lex.pos")).otherwise(F.col("pos"))).withColumn("accent", F.when(filled, F.col("lex.accent")).otherwise(F.col("accent"))).drop("lex")


def with_engine_accents(tokens: DataFrame, engine: DataFrame) -> DataFrame:
    """tokens (surface, reading, reading_source, accent, ...) whose accents an engine's table (surface, kana, accent) fills:
    only dictionary words with kanji that have none, by surface and kana; readings are compared as the engine spells them."""
    known = engine.groupBy("surface", F.col("kana").alias("engine_kana")).agg(F.min("accent").alias("engine_accent"))
    asked = (F.lower("reading_source") == "unidic") & has_kanji(F.col("surface")) & F.col("accent").isNull()
    rows = tokens.withColumn("engine_kana", F.when(asked, F.nullif(engine_kana(F.col("reading")), F.lit(""))))
    return rows.join(known, ["surface", "engine_kana"], "left").withColumn("accent", F.coalesce("accent", "engine_accent")).drop("engine_kana", "engine_accent")
