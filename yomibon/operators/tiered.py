"""The tokens of a chapter from tables: ruby spans, the book's dictionary, the common one, a tokenizer, and the gaps.

Each tier takes what the ones before it leave free. Ruby spans that touch and make up a word of a dictionary
count as that word, the longest first. Dictionaries are tables of any size (dictionary.occurrences); within
a tier a scan takes matches leftmost and longest first, and one that the guard or a context rule refuses
has used up its characters. A context rule of a one-ideograph key lists the numbers that must stand before
it. The tokenizer is a function of (docs, keys...), a lattice or a scan of a lexicon; what is left between
all tokens is tokenized by itself once more.

Where tasks can hold the dictionaries, a chapter's tokens are found in one pass over its text (blocks). Of larger ones a
tier's matches are scanned before they are shuffled; candidates of all tiers meet once, by chapter, where a small function settles them, and
everything else is joins and expressions. Keys of chapters are distinct; a null text has no tokens.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.kana import canonical_katakana, is_cjk_narrow, may_keep_surface
from ..functions.slices import by_row, slices
from ..storage import written
from . import lattice, tiers, tokens
from .blocks import FIELDS, NARROW, Chapters, Path, Scan, rendered_rows, token_rows
from .dictionary import AROUND, HELD_BYTES, allowed, held, scan, spliced, taken
from .evidence import rule_allows

RUBY, BOOK, COMMON, WORDS = 0, 1, 2, 3
SPAN = T.StructType().add("start", "long").add("end", "long").add("base", "string")
TOKEN = T.StructType()
for _name, _type in (("start", "long"), ("end", "long"), ("surface", "string"), ("reading", "string"), ("fallback_reading", "string"), ("reading_source", "string"), ("prefix", "string"), ("suffix", "string")):
    TOKEN.add(_name, _type)
GAP = T.StructType().add("start", "long").add("text", "string").add("before", "string").add("after", "string")
SETTLED = T.StructType().add("tokens", T.ArrayType(TOKEN)).add("gaps", T.ArrayType(GAP))


@by_row(T.ArrayType(SPAN))
def touching_runs(spans: list | None, longest: int) -> list[dict]:
    """Runs of two or more spans with nothing between them, of at most so many characters."""
    found = []
    for k, first in enumerate(spans or ()):
        base, end = first["base"], first["end"]
        for span in spans[k + 1 :]:
            if span["start"] != end or len(base) + len(span["base"]) > longest:
                break
            base, end = base + span["base"], span["end"]
            found.append({"start": first["start"], "end": end, "base": base})
    return found


def settle(tiers: list[int], starts: list[int], ends: list[int], readings: list[str | None], ok: list[bool]) -> list[int]:
    """The numbers of the candidates that a text keeps, tier by tier, in order of start."""
    kept: list[int] = []
    order = sorted(range(len(starts)), key=lambda k: (tiers[k], starts[k], -ends[k], readings[k] or ""))
    for _, group in groupby(order, key=tiers.__getitem__):
        own = list(group)
        own = [own[k] for k in scan([starts[k] for k in own], [ends[k] for k in own])]
        first, last = [starts[k] for k in kept], [ends[k] for k in kept]
        for k in own:
            at = bisect_left(first, ends[k])
            if ok[k] and (at == 0 or last[at - 1] <= starts[k]):
                kept.append(k)
        kept.sort(key=starts.__getitem__)
    return kept


@F.arrow_udf(SETTLED)
def settled(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """(text, its candidates as structs) -> the tokens that they leave, and the gaps between them."""
    for batch in batches:
        for texts, found in slices(list(batch)):
            listed = found.flatten()
            tier, start, end, reading, fallback, source, ok = (listed.field(k).to_pylist() for k in range(7))
            kept, bounds, gaps, gap_bounds, at = [], [0], [], [0], 0
            parts: list[list[str]] = [[], [], []]
            for text, n in zip(texts.to_pylist(), pc.fill_null(pc.list_value_length(found), 0).to_pylist(), strict=True):
                until = at + n
                own = [at + k for k in settle(tier[at:until], start[at:until], end[at:until], reading[at:until], ok[at:until])]
                before = 0
                for k in [*own, None]:
                    a, b = (len(text), len(text)) if k is None else (start[k], end[k])
                    if a > before:
                        gaps.append((before, text[before:a], text[max(0, before - AROUND) : before], text[a : a + AROUND]))
                    if k is not None:
                        for part, value in zip(parts, (text[a:b], text[max(0, a - AROUND) : a], text[b : b + AROUND]), strict=True):
                            part.append(value)
                    before = b
                kept += own
                bounds.append(len(kept))
                gap_bounds.append(len(gaps))
                at = until
            of = lambda x: [x[k] for k in kept]
            surface, prefix, suffix = parts
            made = pa.StructArray.from_arrays([pa.array(x, t) for x, t in zip((of(start), of(end), surface, of(reading), of(fallback), of(source), prefix, suffix), [pa.int64()] * 2 + [pa.string()] * 6, strict=True)], TOKEN.names)
            left = pa.StructArray.from_arrays([pa.array([g[k] for g in gaps], pa.string() if k else pa.int64()) for k in range(4)], GAP.names)
            yield pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), made), pa.ListArray.from_arrays(pa.array(gap_bounds, pa.int32()), left)], SETTLED.names)


class ScanTokenizer:
    """lexicon (surface, reading): the words that a scan takes, leftmost and longest first."""

    made = Scan

    def __init__(self, lexicon: DataFrame):
        self.known = lexicon.groupBy(F.col("surface").alias("key")).agg(F.min("reading").alias("reading"))

    def __call__(self, docs: DataFrame, *keys: str) -> DataFrame:
        return taken(docs, self.known, *keys).select(*keys, "start", "end", "surface", "reading")

    def held(self, most: int) -> tuple | None:
        """What Scan is made of, if tasks can hold it."""
        rows = held(self.known.where("key <> ''"), most)
        return None if rows is None else ({r.key: r.reading for r in rows},)


class LatticeTokenizer:
    """words, connections of lattice.word_costs() and connection_costs(): the known words of the cheapest path."""

    made = Path

    def __init__(self, words: DataFrame, connections: dict[tuple[str, str], int]):
        self.words, self.connections = words, connections

    def __call__(self, docs: DataFrame, *keys: str) -> DataFrame:
        return lattice.tokens(docs, self.words, self.connections, *keys).select(*keys, "start", "end", "surface", "reading")

    def held(self, most: int) -> tuple | None:
        """What Path is made of, if tasks can hold it."""
        rows = held(written(lattice.cheapest(self.words), "words"), most)
        return None if rows is None else ({r.key: [tuple(w) for w in r.words] for r in rows}, self.connections)


def scan_tokenizer(lexicon: DataFrame) -> Callable[..., DataFrame]:
    return ScanTokenizer(lexicon)


def lattice_tokenizer(words: DataFrame, connections: dict[tuple[str, str], int]) -> Callable[..., DataFrame]:
    return LatticeTokenizer(words, connections)


def worded(tokenizer: Callable[..., DataFrame], docs: DataFrame, *keys: str) -> DataFrame:
    """The tokenizer's words that have ideographs and a reading."""
    rows = tokenizer(docs, *keys).where(is_cjk_narrow(F.col("surface"))).withColumn("reading", canonical_katakana(F.col("reading")))
    return rows.where("reading <> ''").select(*keys, "start", "end", "surface", "reading")


def entries(mapping: DataFrame) -> DataFrame:
    """key, entries: its (tier, reading, source) in order."""
    each = F.struct(F.when(F.col("scope") == "book", BOOK).otherwise(COMMON).alias("tier"), "reading", F.coalesce("source", F.lit("propagation")).alias("source"))
    return mapping.where("key <> '' and reading <> ''").groupBy("key").agg(F.array_sort(F.collect_list(each)).alias("entries"))


def dictionaries(mapping: DataFrame, lexicon: DataFrame, tokenizer: Callable[..., DataFrame], rules: DataFrame | None, most: int) -> dict | None:
    """What Chapters is made of, if tasks can hold it: tables of at most so many bytes each."""
    if not hasattr(tokenizer, "held"):
        return None
    words = lexicon.groupBy("surface").agg(F.min("reading").alias("own"), F.lit(None).cast("struct<reading:string,accent:bigint,pos:string>").alias("lex"))
    words = words.unionByName(tiers.sure_words(lexicon).select("surface", F.lit(None).cast("string").alias("own"), F.struct("lex.reading", F.col("lex.accent").cast("long").alias("accent"), "lex.pos").alias("lex")))
    found = []
    for rows in (lambda: held(entries(mapping), most), lambda: held(words.where("surface is not null"), most), lambda: tokenizer.held(most), lambda: [] if rules is None else held(rules.select("base", "prefixes").where("base is not null"), most)):
        found.append(rows())
        if found[-1] is None:
            return None
    known, surfaces, made, numbers = found
    prefixes: dict = {}
    for r in numbers:
        prefixes.setdefault(r.base, []).append(r.prefixes)
    tier = lambda t: {r.key: next((e.reading, e.source) for e in r.entries if e.tier == t) for r in known if any(e.tier == t for e in r.entries)}
    return {
        "tokenizer": made, "book": tier(BOOK), "common": tier(COMMON), "compounds": {r.key: r.entries[0].reading for r in known if len(r.key) > 1 and NARROW.search(r.key)},
        "prefixes": {base: {x for p in listed for x in p if x} for base, listed in prefixes.items() if None not in listed},
        "readings": {r.surface: r.own for r in surfaces if r.own is not None}, "sure": {r.surface: tuple(r.lex) for r in surfaces if r.lex is not None},
    }


def chapters_of(kind: type) -> Callable[[dict], Chapters]:
    """Chapters of dictionaries() with a tokenizer of that kind."""
    return lambda found: Chapters(**{**found, "tokenizer": kind(*found["tokenizer"])})


def held_rows(docs: DataFrame, found: dict, kind: type, rows: Callable, fields: dict[str, str], *keys: str) -> DataFrame:
    """rows (token_rows or rendered_rows) of docs, with their fields behind the keys."""
    spans = F.transform("spans", lambda s: F.struct(s["start"].cast("long").alias("start"), s["end"].cast("long").alias("end"), s["base"].alias("base"), s["reading"].alias("reading")))
    read = docs.select("text", spans.alias("spans"), *keys)
    schema = [*[f"`{f.name}` {f.dataType.simpleString()}" for f in read.schema if f.name in keys], *[f"{name} {t}" for name, t in fields.items()]]
    order = [f.name for f in read.schema if f.name in keys]
    shared = docs.sparkSession.sparkContext.broadcast(found)
    return read.mapInArrow(rows(shared, chapters_of(kind), order), ", ".join(schema))


def candidates(docs: DataFrame, mapping: DataFrame, lexicon: DataFrame, tokenizer: Callable[..., DataFrame], rules: DataFrame | None, *keys: str) -> DataFrame:
    """keys..., tier, start, end, reading, fallback, source, ok."""
    known = entries(mapping)
    spans = F.array_sort(F.filter("spans", lambda s: (s["start"] >= 0) & (s["start"] < s["end"]) & (s["end"] <= F.char_length("text"))))
    own = docs.select(*keys, spans.alias("spans"))
    ruby = own.select(*keys, F.inline("spans"))
    plain = lexicon.groupBy(F.col("surface").alias("base")).agg(F.min("reading").alias("lex"))
    ruby = ruby.join(plain, "base", "left")
    fallback = F.when(is_cjk_narrow(F.col("reading")), F.coalesce("lex", "reading")).otherwise(F.col("reading"))
    ruby = ruby.select(*keys, F.lit(RUBY).alias("tier"), "start", "end", "reading", fallback.alias("fallback"), F.lit("ruby").alias("source"), F.lit(True).alias("ok"))

    longer = known.where((F.char_length("key") > 1) & is_cjk_narrow(F.col("key")))
    longest = longer.agg(F.coalesce(F.max(F.char_length("key")), F.lit(0))).head()[0]
    runs = own.select(*keys, F.inline(touching_runs("spans", F.lit(longest)))).join(longer, F.col("base") == F.col("key"))
    said = F.get("entries", F.lit(0))["reading"]
    compounds = runs.select(*keys, F.lit(RUBY).alias("tier"), "start", "end", said.alias("reading"), said.alias("fallback"), F.lit("ruby").alias("source"), F.lit(True).alias("ok"))

    terms = []
    for tier in (BOOK, COMMON):
        own = known.select("key", F.filter("entries", lambda e: e["tier"] == tier).alias("own")).where(F.size("own") > 0)  # noqa: B023
        met = taken(docs, own.select("key", F.get("own", F.lit(0)).alias("best")), *keys, context=("lead", "before", "after"))
        ok = allowed(F.col("surface"), F.col("before"), F.col("after"))
        if rules is not None:
            met = met.join(rules.select(F.col("base").alias("surface"), "prefixes"), "surface", "left")
            ok = ok & (F.col("prefixes").isNull() | rule_allows(F.col("lead"), F.col("prefixes")))
        terms.append(met.select(*keys, F.lit(tier).alias("tier"), "start", "end", F.col("best.reading").alias("reading"), F.col("best.reading").alias("fallback"), F.col("best.source").alias("source"), ok.alias("ok")))

    words = worded(tokenizer, docs, *keys)
    words = words.select(*keys, F.lit(WORDS).alias("tier"), "start", "end", "reading", F.col("reading").alias("fallback"), F.lit("unidic").alias("source"), F.lit(True).alias("ok"))
    return ruby.unionByName(compounds).unionByName(terms[0]).unionByName(terms[1]).unionByName(words)


def built(docs: DataFrame, mapping: DataFrame, lexicon: DataFrame, *keys: str, tokenizer: Callable[..., DataFrame] | None = None, rules: DataFrame | None = None, held_bytes: int = HELD_BYTES) -> DataFrame:
    """docs (keys..., text, spans), mapping (key, reading, scope: book or common, source), lexicon (surface, reading, accent,
    pos), rules (base, prefixes) -> a row a token: keys..., token_idx, start, end, surface, reading, fallback_reading,
    reading_source, prefix, suffix, accent, pos, block, validated. A source that isn't given is "propagation"."""
    mapping, lexicon = written(mapping, "mapping"), written(lexicon, "lexicon")
    tokenizer = tokenizer or scan_tokenizer(lexicon)
    known = dictionaries(mapping, lexicon, tokenizer, rules, held_bytes)
    if known is None:
        return joined(written(docs, "docs"), mapping, lexicon, tokenizer, rules, *keys)
    rows = held_rows(docs, known, tokenizer.made, token_rows, FIELDS, *keys)
    return rows.select("surface", *keys, "start", "end", "reading", "fallback_reading", "reading_source", "prefix", "suffix", "token_idx", "accent", "pos", "block", "validated")


def renders(docs: DataFrame, mapping: DataFrame, lexicon: DataFrame, *keys: str, tokenizer: Callable[..., DataFrame] | None = None, rules: DataFrame | None = None, held_bytes: int = HELD_BYTES) -> DataFrame:
    """rendered() of built(), from the same: where tasks hold the dictionaries, tokens are no rows on the way."""
    mapping, lexicon = written(mapping, "mapping"), written(lexicon, "lexicon")
    tokenizer = tokenizer or scan_tokenizer(lexicon)
    known = dictionaries(mapping, lexicon, tokenizer, rules, held_bytes)
    if known is None:
        docs = written(docs, "docs")
        return rendered(docs, joined(docs, mapping, lexicon, tokenizer, rules, *keys), *keys)
    return held_rows(docs, known, tokenizer.made, rendered_rows, {"rendered": "string", "partial": "string"}, *keys).select(*keys, "rendered", "partial")


def joined(docs: DataFrame, mapping: DataFrame, lexicon: DataFrame, tokenizer: Callable[..., DataFrame], rules: DataFrame | None, *keys: str) -> DataFrame:
    """built() of written tables, whatever the size of the dictionaries."""
    found = candidates(docs, mapping, lexicon, tokenizer, rules, *keys)
    found = found.groupBy(*keys).agg(F.collect_list(F.struct("tier", "start", "end", "reading", "fallback", "source", "ok")).alias("found"))
    rows = docs.where("text is not null").select(*keys, "text").join(found, list(keys), "left")
    rows = written(rows.select(*keys, settled("text", "found").alias("s")).select(*keys, "s.tokens", "s.gaps"), "chapters")
    first = rows.select(*keys, F.inline("tokens"))
    gaps = rows.select(*keys, F.explode("gaps").alias("g")).select(*keys, F.col("g.start").alias("gap"), "g.text", "g.before", "g.after").where(is_cjk_narrow(F.col("text")))
    # What stands around goes with each gap, so that its words need not be joined with it.
    more = worded(tokenizer, gaps.withColumn("whole", F.col("text")), *keys, "gap", "before", "whole", "after")
    around, lead = F.concat("before", "whole", "after"), F.char_length("before")
    at, end = lead + F.col("start").cast("int"), lead + F.col("end").cast("int")
    more = more.select(
        *keys, (F.col("gap") + F.col("start")).alias("start"), (F.col("gap") + F.col("end")).alias("end"), "surface", "reading", F.col("reading").alias("fallback_reading"), F.lit("unidic-gap").alias("reading_source"),
        F.substring(around, F.greatest(F.lit(0), at - AROUND) + 1, at - F.greatest(F.lit(0), at - AROUND)).alias("prefix"), F.substring(around, end + 1, F.lit(AROUND)).alias("suffix"),
    )
    rows = first.unionByName(more)
    rows = rows.withColumn("reading", canonical_katakana(F.col("reading"))).withColumn("fallback_reading", canonical_katakana(F.col("fallback_reading")))
    rows = rows.withColumn("token_idx", (F.row_number().over(Window.partitionBy(*keys).orderBy("start", "end")) - 1).cast("long"))
    rows = rows.withColumn("accent", F.lit(None).cast("long")).withColumn("pos", F.lit(None).cast("string"))
    rows = tokens.flag_ambiguous(tokens.flag_ambiguous(tiers.harmonized(rows, lexicon), *keys, source="unidic"), *keys)
    return tiers.with_accents(rows, lexicon)


def rendered(docs: DataFrame, found: DataFrame, *keys: str) -> DataFrame:
    """docs (keys..., text) and built() tokens -> keys..., rendered, partial: in katakana, and with the surfaces of sure readings, from one gathering of the tokens."""
    keep = may_keep_surface(F.col("surface"), F.col("block"), F.col("reading_source"), F.col("validated"))
    said = F.coalesce("reading", "surface")
    parts = found.select(*keys, F.struct("start", "end", said.alias("said"), F.when(keep, F.col("surface")).otherwise(said).alias("part")).alias("t")).groupBy(*keys).agg(F.array_sort(F.collect_list("t")).alias("ts"))
    rows = docs.select(*keys, "text").join(parts, list(keys), "left")
    of = lambda name: F.transform("ts", lambda t: t[name])
    return rows.select(*keys, spliced("text", of("start"), of("end"), of("said")).alias("rendered"), spliced("text", of("start"), of("end"), of("part")).alias("partial"))
