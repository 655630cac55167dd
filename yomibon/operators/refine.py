"""Rules that override readings or remove tokens, applied in order to a chapter's text and tokens.

Each rule sees the edits of those before it and moves every later offset, so a chapter is one group;
chapters run in parallel. Rules are a small list, sent with the function.

A rule is an edit script: its edits are gathered in the places that hold before it, found by binary
search among the tokens, and applied at once; an offset then moves by the sum of the edits that end
at it or before, so a rule costs n log n. Where the order of edits can be seen (tokens that overlap, patterns
that look at what is before a match), they are applied one by one.

Columns of a chapter's tokens: `start` and `end` in the text as it is now, `o_start` and `o_end` in the
text it was made from, `surface`, `reading`, `fallback_reading`, `accent`, `pos`, `source`. Those that
the input lacks are null, `o_start` and `o_end` then `start` and `end`.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import reduce
from itertools import accumulate
from operator import and_

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.slices import slices
from .offset_maps import aligned

TOKEN_COLUMNS = ["surface", "reading", "fallback_reading", "accent", "pos", "start", "end", "o_start", "o_end", "source"]
#: What in a pattern may look at the text before a match.
LOOKS_BACK = re.compile(r"\(\?<|\\[bBA]|\^")


class Chapter:
    """A text and its tokens, by offsets in the text; `original` is the text it was made from, if that is known."""

    def __init__(self, text: str, tokens: list[dict], original: str | None = None):
        self.text, self.original = text, original
        self.tokens = sorted(({**dict.fromkeys(TOKEN_COLUMNS), **t} for t in tokens), key=place)
        for t in self.tokens:
            t["o_start"] = t["start"] if t["o_start"] is None else t["o_start"]
            t["o_end"] = t["end"] if t["o_end"] is None else t["o_end"]

    def replace(self, start: int, end: int, new: str, leave: dict | None = None) -> None:
        """Puts `new` in place and moves every offset from the end on, but those of one token."""
        self.text = self.text[:start] + new + self.text[end:]
        delta = len(new) - (end - start)
        for t in self.tokens:
            for side in ("start", "end") if t is not leave else ():
                t[side] += delta if t[side] >= end else 0

    def apart(self) -> bool:
        """Whether no two tokens overlap; empty ones stand alone."""
        return all(t["start"] < t["end"] <= u["start"] for t, u in zip(self.tokens, self.tokens[1:], strict=False)) and all(t["start"] < t["end"] for t in self.tokens[-1:])

    def apply(self, edits: list[tuple[int, int, str]]) -> list[int]:
        """Puts texts in place of disjoint spans, given in order; the sums by which offsets move. Tokens move by `moved`."""
        parts, at = [], 0
        for start, end, new in edits:
            parts += [self.text[at:start], new]
            at = end
        self.text = "".join([*parts, self.text[at:]])
        ends, sums = [e for _, e, _ in edits], [0, *accumulate(len(new) - (end - start) for start, end, new in edits)]
        for t in self.tokens:
            t["start"] += sums[bisect_right(ends, t["start"])]
            t["end"] += sums[bisect_right(ends, t["end"])]
        return sums

    def origin(self, start: int, end: int) -> tuple[int, int]:
        """Where a span of the text comes from."""
        if self.original is None:
            return start, end
        size = len(self.original)
        a, b = aligned(self.original, self.text).mapped([start, end]).tolist()
        a = min(a, size)
        return a, max(a, min(b, size))

    def override(self, rule: dict, source: str | None = None) -> None:
        """One rule; with a source only tokens of that source take part, as with the rule's own."""
        wanted = {x.strip().lower() for x in (rule.get("source"), source) if x and x.strip()}
        concerned = lambda t: all((t["source"] or "").lower() == x for x in wanted)
        self.update(rule, concerned)
        self.insert(rule, concerned, bool(wanted), source is not None)

    def update(self, rule: dict, concerned) -> None:
        """First pass: tokens whose reading matches take what the rule gives, and its text."""
        new, at_once, edits = replacement(rule), self.apart(), []
        for t in sorted((t for t in self.tokens if t["end"] > t["start"]), key=place):
            if not concerned(t) or not fits(t, self.text[t["start"] : t["end"]], rule):
                continue
            if new is not None and new != self.text[t["start"] : t["end"]]:
                if at_once:
                    edits.append((t["start"], t["end"], new))
                else:
                    start = t["start"]
                    self.replace(start, t["end"], new, leave=t)
                    t["end"] = start + len(new)
            given = {"reading": rule.get("reading") if rule.get("reading") is not None else new, "surface": rule.get("surface") or None, "pos": rule.get("pos") or None, "accent": rule.get("accent")}
            t.update({k: v for k, v in given.items() if v is not None}, source="override")
        if edits:
            self.apply(edits)

    def insert(self, rule: dict, concerned, limited: bool, keep_others: bool) -> None:
        """Second pass: matches in the text replace the tokens they cover; one that cuts a token is left out."""
        pattern = re.compile(rule["pattern"] if rule.get("regex") else re.escape(rule["pattern"]))
        if self.apart() and not (rule.get("regex") and LOOKS_BACK.search(rule["pattern"])) and self.inserted(rule, pattern, concerned, limited, keep_others):
            return
        at = 0
        while at <= len(self.text) and (m := pattern.search(self.text, at)):
            start, end = m.span()
            at = max(end, start + 1)
            over = sorted((t for t in self.tokens if t["start"] < end and t["end"] > start), key=place)
            put = self.met(rule, m, over, concerned, limited, lambda: self.origin(start, end))  # noqa: B023
            if put is None:
                continue
            new, token = put
            gone = [t for t in over if concerned(t)] if keep_others else over
            self.tokens = [t for t in self.tokens if not any(t is x for x in gone)]
            if new != m[0]:
                self.replace(start, end, new)
            self.tokens.append({**token, "start": start, "end": start + len(new)})
            self.tokens.sort(key=place)
            at = max(start + len(new), start + 1)

    def inserted(self, rule: dict, pattern: re.Pattern, concerned, limited: bool, keep_others: bool) -> bool:
        """The second pass at once, for tokens that don't overlap; False, with nothing done, if they would then."""
        starts, ends = [t["start"] for t in self.tokens], [t["end"] for t in self.tokens]
        edits, gone, made, at, moved = [], set(), [], 0, 0
        while at <= len(self.text) and (m := pattern.search(self.text, at)):
            start, end = m.span()
            at = max(end, start + 1)
            first = bisect_right(ends, start)
            over = self.tokens[first : bisect_left(starts, end, first)]
            here = start + moved

            def origin() -> tuple[int, int]:
                if self.original is None:
                    return here, here + end - start  # noqa: B023
                parts, last = [], 0
                for a, b, put in edits:
                    parts += [self.text[last:a], put]
                    last = b
                return Chapter("".join([*parts, self.text[last:]]), [], self.original).origin(here, here + end - start)  # noqa: B023

            put = self.met(rule, m, over, concerned, limited, origin)
            if put is None:
                continue
            if keep_others and not all(map(concerned, over)):
                return False
            new, token = put
            gone.update(map(id, over))
            if new != m[0]:
                edits.append((start, end, new))
                moved += len(new) - (end - start)
            made.append({**token, "start": here, "end": here + len(new)})
            at = end + (not new)
        self.tokens = [t for t in self.tokens if id(t) not in gone]
        self.apply(edits)
        self.tokens = sorted([*self.tokens, *made], key=place)
        return True

    def met(self, rule: dict, m: re.Match, over: list[dict], concerned, limited: bool, origin) -> tuple[str, dict] | None:
        """What a match over these tokens becomes: its text and, but for its place, its token; None if the rule is not for it."""
        start, end = m.span()
        if start == end or (limited and not any(map(concerned, over))) or any(t["start"] < start or t["end"] > end for t in over):
            return None
        expected, covered = rule.get("match_surface") or rule.get("surface"), "".join(t["surface"] or "" for t in over)
        source = (min(t["o_start"] for t in over), max(t["o_end"] for t in over)) if over else origin()
        if expected and (covered if over else expected if self.original is None else self.original[slice(*source)]) != expected:
            return None
        if any(t["start"] == start and t["end"] == end and concerned(t) and applied(t, m[0], rule) for t in over):
            return None
        new = replacement(rule)
        put = m[0] if new is None else new
        reading = rule.get("reading") or put
        return put, {"surface": rule.get("surface") or put, "reading": reading, "fallback_reading": reading, "accent": rule.get("accent"), "pos": rule.get("pos"), "o_start": source[0], "o_end": source[1], "source": "override"}

    def remove(self, rules: list[dict], source: str | None = None, only: dict | None = None) -> None:
        """Tokens that match all fields of a rule go; the text gets their surface back, if they have one."""
        gone, edits, at_once = set(), [], only is None and self.apart()
        for t in [only] if only is not None else list(self.tokens):
            if source is not None and (t["source"] or "").lower() != source.strip().lower():
                continue
            reading = t["reading"] or t["fallback_reading"]
            if only is None and not any((not r.get("surface") or t["surface"] == r["surface"]) and (not r.get("reading") or reading == r["reading"]) for r in rules):
                continue
            written = (t["surface"] or "").strip()
            if written and t["end"] > t["start"] and self.text[t["start"] : t["end"]] != written:
                if at_once:
                    edits.append((t["start"], t["end"], written))
                else:
                    self.replace(t["start"], t["end"], written, leave=t)
            gone.add(id(t))
        self.tokens = [t for t in self.tokens if id(t) not in gone]
        if edits:
            self.apply(edits)

    def edit(self, wanted: list[tuple[int, str | None, int | None]]) -> None:
        """(place in order, reading, accent) by hand, from the last place on: the reading is the token's new text; without one the token goes."""
        if len({w[0] for w in wanted}) == len(wanted) and self.apart():
            edits, gone = [], set()
            for at, reading, accent in reversed([w for w in wanted if w[0] < len(self.tokens)]):
                t = self.tokens[at]
                written = (t["surface"] or "").strip() or self.text[t["start"] : t["end"]] if reading is None else reading
                edits.append((t["start"], t["end"], written))
                if reading is None:
                    gone.add(id(t))
                else:
                    t.update(reading=reading, source="manual", accent=t["accent"] if accent is None else accent)
            self.tokens = [t for t in self.tokens if id(t) not in gone]
            self.apply(edits)
            return
        for at, reading, accent in wanted:
            if at >= len(self.tokens):
                continue
            t = self.tokens[at]
            if reading is None:
                self.remove([], only=t)
                continue
            start = t["start"]
            self.replace(start, t["end"], reading, leave=t)
            t.update(end=start + len(reading), reading=reading, source="manual", accent=t["accent"] if accent is None else accent)

    def select(self, start: int, end: int, given: dict) -> None:
        """A token for a selected span: it takes the place of all that overlap it, in this text or in the one before."""
        if start < 0 or end <= start or end > len(self.text):
            raise ValueError(f"no such selection: {start} to {end}")
        segment = self.text[start:end]
        new = segment if given.get("replacement") is None else given["replacement"]
        if new != segment:
            self.replace(start, end, new)
            end = start + len(new)
        a, b = self.origin(start, end)
        if self.original is not None and b <= a:
            raise ValueError("the selection has no place in the original text")
        apart = lambda t: (end <= t["start"] or t["end"] <= start) and (b <= t["o_start"] or t["o_end"] <= a)
        reading = given.get("reading") or new
        surface = given.get("surface") or (segment if self.original is None else self.original[a:b])
        token = {"surface": surface, "reading": reading, "fallback_reading": reading, "accent": given.get("accent"), "pos": given.get("pos"), "start": start, "end": end, "o_start": a, "o_end": b, "source": "override"}
        self.tokens = sorted([*(t for t in self.tokens if apart(t)), token], key=place)


def place(t: dict) -> tuple[int, int]:
    return t["start"], t["end"]


def replacement(rule: dict) -> str | None:
    return rule.get("replacement") if rule.get("replacement") is not None else rule.get("reading")


def fits(t: dict, segment: str, rule: dict) -> bool:
    """Whether a token is what a rule is for: surface, part of speech, and reading."""
    expected = rule.get("match_surface") or rule.get("surface")
    if (expected and t["surface"] != expected) or (rule.get("pos") and t["pos"] != rule["pos"]):
        return False
    reading = t["reading"] or t["fallback_reading"] or segment
    return bool(re.search(rule["pattern"], reading)) if rule.get("regex") else reading == rule["pattern"]


def applied(t: dict, segment: str, rule: dict) -> bool:
    """Whether a token at a match already is what the rule would make."""
    new = replacement(rule)
    reading = rule.get("reading") or new or segment
    same = all(rule.get(k) is None or t[k] == rule[k] for k in ("surface", "pos", "accent")) and (rule.get("match_surface") is None or t["surface"] == rule["match_surface"])
    return same and reading in (t["reading"], t["fallback_reading"]) and new in (None, segment)


def chapter_rows(chapters: DataFrame, keys: tuple[str, ...], names: list[str]) -> DataFrame:
    """A row a chapter with an array of its tokens, from a row a token, or as they are."""
    if "tokens" in chapters.columns:
        return chapters
    listed = F.collect_list(F.struct(*[c for c in names if c in TOKEN_COLUMNS]))
    return chapters.groupBy(*keys).agg(*[F.first(c).alias(c) for c in names if c in ("text", "original")], F.filter(listed, lambda t: t["start"].isNotNull()).alias("tokens"))


def with_wanted(rows: DataFrame, wanted: DataFrame | Column, keys: tuple[str, ...], fields: dict[str, str]) -> DataFrame:
    """Chapters' rows with what is wanted of each as an array `wanted` of structs: from a table by keys, or made of the rows themselves."""
    if isinstance(wanted, Column):
        return rows.withColumn("wanted", wanted)
    each = F.struct(*[(F.col(c).cast(t) if c in wanted.columns else F.lit(None).cast(t)).alias(c) for c, t in fields.items()])
    own = [F.col(k).alias(f"wanted_{n}") for n, k in enumerate(keys)]
    listed = wanted.select(*own, each.alias("each")).groupBy(*[f"wanted_{n}" for n in range(len(keys))]).agg(F.collect_list("each").alias("wanted"))
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"wanted_{n}")) for n, k in enumerate(keys)])
    return rows.join(listed, same, "left").drop(*[f"wanted_{n}" for n in range(len(keys))])


def by_chapter(chapters: DataFrame, keys: tuple[str, ...], change, wanted: DataFrame | Column | None = None, fields: dict[str, str] | None = None) -> DataFrame:
    """change(chapter, what is wanted of it) for each chapter; columns that are neither keys, texts nor of tokens are dropped. A row is a token,
    or a chapter with an array of its tokens: then nothing is shuffled but for a table of what is wanted. Batches are read by slices, so few
    chapters are objects at a time."""
    names = [c for c in chapters.columns if c in (*keys, "text", "original", *TOKEN_COLUMNS)]
    rows = chapter_rows(chapters, keys, names)
    if "tokens" in chapters.columns:
        names += [c for c in chapters.schema["tokens"].dataType.elementType.names if c in TOKEN_COLUMNS]
    kind = T.StructType([T.StructField("text", T.StringType()), T.StructField("tokens", rows.schema["tokens"].dataType)])
    asked = F.lit(None).cast("array<int>")
    if wanted is not None:
        rows, asked = with_wanted(rows, wanted, keys, fields), F.col("wanted")

    @F.arrow_udf(kind)
    def changed(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        own = to_arrow_type(kind)
        fields = own.field("tokens").type.value_type
        given = [f.name for f in fields]
        for batch in batches:
            if not len(batch[0]):
                yield pa.array([], own)
            for texts, originals, listed, asked in slices(list(batch)):
                # Columns by themselves: a row of dictionaries is read and written many times slower.
                values, at = listed.flatten(), 0
                columns = [values.field(k).to_pylist() for k in range(len(given))]
                out, made, bounds = [], [[] for _ in given], [0]
                for text, original, n, wanted in zip(texts.to_pylist(), originals.to_pylist(), pc.fill_null(pc.list_value_length(listed), 0).to_pylist(), asked.to_pylist(), strict=True):
                    rows = zip(*(c[at : at + n] for c in columns), strict=True)
                    at += n
                    chapter = Chapter(text or "", [dict(zip(given, row, strict=True)) for row in rows], original)
                    change(chapter, wanted or [])
                    out.append(chapter.text)
                    for name, column in zip(given, made, strict=True):
                        column += [t[name] for t in chapter.tokens]
                    bounds.append(bounds[-1] + len(chapter.tokens))
                found = pa.StructArray.from_arrays([pa.array(x, f.type) for x, f in zip(made, fields, strict=True)], given)
                yield pa.StructArray.from_arrays([pa.array(out, pa.string()), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), found)], ["text", "tokens"])

    before = F.col("original") if "original" in names else F.lit(None).cast("string")
    kept = [F.col(c) for c in (*keys, "original") if c in names]
    made = rows.select(*kept, changed(F.col("text"), before, F.col("tokens"), asked).alias("made"))
    return made.select(*kept, F.col("made.text").alias("text"), F.inline_outer("made.tokens")).select(*names)


def refined(chapters: DataFrame, overrides: list[dict], removals: list[dict], *keys: str, source: str | None = None) -> DataFrame:
    """chapters: a row a token (keys..., text, surface, reading, accent, start, end, source, ...), null token columns
    for a chapter without tokens -> the same after the rules, in order. With a source only tokens of it are changed.
    Chapters may come as a row each (keys..., text, tokens array<struct<surface,...>>), too."""

    def change(chapter: Chapter, _) -> None:
        for rule in overrides:
            if rule.get("pattern"):
                chapter.override(rule, source)
        wanted = [r for r in removals if r.get("reading") or r.get("surface")]
        if wanted:
            chapter.remove(wanted, source)

    return by_chapter(chapters, keys, change)


EDIT = {"token_idx": "long", "reading": "string", "accent": "long"}
SELECTION = {"start": "long", "end": "long", "replacement": "string", "reading": "string", "surface": "string", "pos": "string", "accent": "long"}


def edited(chapters: DataFrame, edits: DataFrame | Column, *keys: str) -> DataFrame:
    """chapters as in refined(), edits (keys..., token_idx, reading, accent): the tokens of these places, by order in
    the chapter, get the reading, its text and the accent, and count as set by hand. A null reading removes the token.
    Of chapters' rows edits may be an array of such structs instead."""

    def change(chapter: Chapter, wanted: list[dict]) -> None:
        # From the end, so places hold.
        chapter.edit([(e["token_idx"], e["reading"], e["accent"]) for e in sorted(wanted, key=lambda e: -e["token_idx"])])

    return by_chapter(chapters, keys, change, edits, EDIT)


def selected(chapters: DataFrame, selections: DataFrame | Column, *keys: str) -> DataFrame:
    """chapters as in refined(), selections (keys..., start, end, replacement, reading, surface, pos, accent): a token
    for each selected span, in order of their starts from the end. Of chapters' rows selections may be an array of such structs instead."""

    def change(chapter: Chapter, wanted: list[dict]) -> None:
        for given in sorted(wanted, key=lambda w: -w["start"]):
            chapter.select(given["start"], given["end"], given)

    return by_chapter(chapters, keys, change, selections, SELECTION)


def changes(before: DataFrame, after: DataFrame, *keys: str) -> DataFrame:
    """keys..., changed, text_sha1: whether a chapter's text or tokens differ, and the hash of its stripped text."""
    own = [c for c in before.columns if c in after.columns and c not in keys]
    token = F.sum(F.xxhash64(*own).cast("decimal(38,0)"))
    old, new = (df.groupBy(*keys).agg(token.alias(name), *extra) for df, name, extra in ((before, "old", []), (after, "new", [F.first("text").alias("text")])))
    from ..functions.kana import trimmed

    return old.join(new, list(keys)).select(*keys, (F.col("old") != F.col("new")).alias("changed"), F.sha1(trimmed(F.coalesce("text", F.lit(""))).cast("binary")).alias("text_sha1"))


def text_hash(text: str) -> str:
    return hashlib.sha1(text.strip().encode()).hexdigest()


def appended(rules: DataFrame, entry: DataFrame, *keys: str) -> DataFrame:
    """Rules (keys..., rule_idx, ...) with new ones (keys..., ...) behind them, in the order of their patterns."""
    last = rules.groupBy(*keys).agg(F.max("rule_idx").alias("last"))
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy("pattern"))
    new = entry.join(last, list(keys), "left").withColumn("rule_idx", (F.coalesce("last", F.lit(-1)) + turn).cast("long")).drop("last")
    return rules.unionByName(new, allowMissingColumns=True)


def merged(book: DataFrame, template: DataFrame, key: list, *by: str) -> DataFrame:
    """Keyed union of (by..., pos, ...): of one key the book's last value, at the place where the key first stands; `place` counts from 1."""
    both = template.withColumn("prio", F.lit(0)).unionByName(book.withColumn("prio", F.lit(1)), allowMissingColumns=True)
    rows = both.withColumn("rank", F.row_number().over(Window.partitionBy(*by, *key).orderBy(F.desc("prio"), F.desc("pos"))))
    rows = rows.withColumn("first", F.min(F.struct("prio", "pos")).over(Window.partitionBy(*by, *key))).where("rank = 1")
    # Rules of a book are a small list: by book they are ordered in parallel.
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("first"))).drop("rank", "first", "prio", "pos")


def merged_rules(book: DataFrame, template: DataFrame, *by: str) -> DataFrame:
    """Rules (by..., pos, regex, pattern, match_surface, surface, source, ...) of a book over those of a template."""
    return merged(book, template, ["regex", "pattern", F.coalesce("match_surface", "surface"), "source"], *by)


def merged_removals(book: DataFrame, template: DataFrame, *by: str) -> DataFrame:
    """Removals (by..., pos, reading, surface, ...) of a book over those of a template."""
    return merged(book, template, ["reading", "surface"], *by)
