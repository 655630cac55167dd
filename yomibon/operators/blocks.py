"""The tokens of chapters where tasks hold the dictionaries: one pass over texts, nothing is shuffled.

What tiered.built() finds by joins is found here text by text, with the same results. No word of a dictionary that has no
white space reaches over white space, and neither does what a tier leaves free, so a text falls into blocks between white
space. A block's tokens depend on its characters and its ruby, on whether it begins or ends its text, and, where a context
rule asks for it, on the number before it; blocks of few characters are remembered, in a memo of bounded size. A text whose
ruby reaches over white space is one block, as are all texts if a word has white space in it.

Batches are read by slices and rows go back as flat columns, so a worker's Python objects are those of a slice.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..functions.kana import CANONICAL, FULL, HIRAGANA, KATAKANA, NARROW_CJK, NUMERIC, SMALL, WIDE_CJK
from ..functions.slices import slices
from .dictionary import AROUND, LEAD, lengths_by_first
from .lattice import BLANK, BLANKS, BOUND, Lattice

#: Blocks of at most so many characters are remembered; an entry counts so much, and a number for each of its tokens, until all are forgotten.
REMEMBERED, ENTRY, WEIGHT = 64, 8, 1 << 21
#: The columns of a token's row behind its chapter's keys.
FIELDS = {
    "token_idx": "long", "start": "long", "end": "long", "surface": "string", "reading": "string", "fallback_reading": "string", "reading_source": "string",
    "prefix": "string", "suffix": "string", "accent": "long", "pos": "string", "block": "boolean", "validated": "boolean",
}
ARROW = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}


def compiled(pattern: str) -> re.Pattern:
    return re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m[1], 16)), pattern))


WIDE, NARROW, NUMBER = compiled(WIDE_CJK), compiled(NARROW_CJK), re.compile(f"[{NUMERIC}]{{1,4}}\\Z")
WHITE, BLOCK = re.compile(f"[{BLANK}]"), re.compile(f"[^{BLANK}]+")
_canonical = str.maketrans(*CANONICAL)
TO_CANONICAL = _canonical | {ord(h): k.translate(_canonical) for h, k in zip(HIRAGANA, KATAKANA, strict=True)}
TO_FULL = str.maketrans(SMALL, FULL)


def canonical(reading: str | None) -> str | None:
    return None if reading is None else reading.translate(TO_CANONICAL)


def is_plain(c: str) -> bool:
    return c.isascii() and c.isalnum()


def allowed(text: str, start: int, end: int) -> bool:
    """dictionary.allowed() of a match in its text."""
    before, after = text[start - 1] if start else "", text[end : end + 1]
    first = text[start]
    if (before.isdecimal() and first.isdecimal()) or (after.isdecimal() and text[end - 1].isdecimal()):
        return False
    return end - start > 1 or not (WIDE.match(before) or WIDE.match(after) or (is_plain(first) and (is_plain(before) or is_plain(after))))


class Scan:
    """The tokenizer that takes what a scan takes: surface -> reading."""

    def __init__(self, words: dict[str, str | None]):
        self.words, self.lengths = words, lengths_by_first(words)

    def __call__(self, text: str, before: str, behind: str | None) -> list[tuple[int, int, str | None]]:
        found, at, n = [], 0, len(text)
        while at < n:
            for size in self.lengths.get(text[at], ()):
                word = text[at : at + size]
                if word in self.words:
                    found.append((at, at + len(word), self.words[word]))
                    at += len(word)
                    break
            else:
                at += 1
        return found


class Path:
    """The tokenizer that takes the known words of the cheapest path. Behind white space a path is in one state, whatever was before."""

    def __init__(self, words: dict[str, list[tuple]], connections: dict[tuple[str, str], int]):
        self.words, self.lattice = words, Lattice(words, connections)

    def __call__(self, text: str, before: str, behind: str | None) -> list[tuple[int, int, str | None]]:
        return [(a, b, reading) for a, b, reading, _ in self.lattice.block(text, before, behind)[1] if reading]


class Tokens:
    """What is known of a token wherever it stands, by number: surface, readings, source, accent, part of speech, whether it is validated
    and may keep its surface. readings: surface -> the lexicon's; sure: surface -> (reading, accent, part of speech)."""

    NAMES = ("surface", "reading", "fallback_reading", "reading_source", "accent", "pos", "validated")

    def __init__(self, readings: dict, sure: dict):
        self.readings, self.sure = readings, sure
        self.numbers: dict[tuple, int] = {}
        self.rows: list[tuple] = []
        self.sizes: list[int] = []
        self.keeps: list[bool] = []
        #: (surface, reading as it is compared)
        self.pairs: list[tuple[str, str | None]] = []

    def number(self, surface: str, reading: str | None, fallback: str | None, source: str) -> int:
        key = (surface, reading, fallback, source)
        found = self.numbers.get(key)
        if found is None:
            found = self.numbers[key] = len(self.rows)
            self.add(*key)
        return found

    def add(self, surface: str, reading: str | None, fallback: str | None, source: str) -> None:
        reading, fallback, own = canonical(reading), canonical(fallback), self.readings.get(surface)
        if reading is not None and own is not None and reading != own and len(reading) == len(own) and reading.translate(TO_FULL) == own.translate(TO_FULL):
            reading = own
        said, kind, known = canonical(reading or fallback), source.lower(), self.sure.get(surface)
        same = known is not None and kind != "unidic" and said is not None and canonical(known[0]) == said
        validated = same or (kind == "unidic" and said is not None)
        self.rows.append((surface, reading, fallback, source, known[1] if same else None, known[2] if same else None, validated))
        self.sizes.append(len(surface))
        self.keeps.append((kind in ("unidic", "unidic-gap", "nhk") or validated) and NARROW.search(surface) is not None)
        self.pairs.append((surface, None if said is None else said.translate(TO_FULL)))

    def ambiguous(self, numbers: list[int]) -> set[str]:
        """Surfaces with several readings among a chapter's tokens."""
        known = {pair for pair in [self.pairs[k] for k in set(numbers)] if pair[1] is not None}
        if len({s for s, _ in known}) == len(known):
            return set()
        seen: set[str] = set()
        return {s for s, _ in known if s in seen or seen.add(s)}


class Chapters:
    """Dictionaries in memory, and the tokens of texts by them. book, common: key -> (reading, source); compounds: key -> reading;
    prefixes: key -> numbers that must stand before it."""

    def __init__(self, tokenizer: Scan | Path, book: dict, common: dict, compounds: dict, prefixes: dict, readings: dict, sure: dict):
        self.tokenizer, self.compounds, self.readings = tokenizer, compounds, readings
        self.dictionaries, self.prefixes, self.sure = (book, common), prefixes, sure
        self.longest = max(map(len, compounds), default=0)
        self.whole = any(WHITE.search(key) for words in (book, common, compounds, tokenizer.words) for key in words)
        self.forget()

    def forget(self) -> None:
        """Begins anew, so that what is remembered stays small. Numbers of tokens don't hold any more."""
        self.tokens = Tokens(self.readings, self.sure)
        self.memo: dict[tuple, tuple | None] = {}
        self.parts: dict[tuple, list[tuple]] = {}
        self.weight = 0
        self.tiers = []
        for words in self.dictionaries:
            # A word's number, whether what stands around it is to be looked at, and the numbers that a rule asks for.
            known = {w: (self.tokens.number(w, reading, reading, source), len(w) == 1 or w[0].isdecimal() or w[-1].isdecimal(), self.prefixes.get(w)) for w, (reading, source) in words.items()}
            self.tiers.append((known, lengths_by_first(words)))
        self.least = len(self.tokens.rows)

    def full(self) -> bool:
        return self.weight + ENTRY * (len(self.tokens.rows) - self.least) > WEIGHT

    def free(self, text: str, spans: tuple, before: str, behind: str | None, lead: str) -> tuple[list[tuple[int, int]], bool]:
        """A block's tokens (start, number) in order, and whether a rule asked for what stands before the block."""
        n, kept, asked = len(text), [], False
        used = bytearray(n)
        if spans:
            self.ruby(text, spans, kept, used)
        for words, lengths in self.tiers:
            if used.find(0) < 0:
                break
            at = 0
            while at < n:
                for size in lengths.get(text[at], ()):
                    word = text[at : at + size]
                    if word in words:
                        break
                else:
                    at += 1
                    continue
                start, at = at, at + len(word)
                if used.find(1, start, at) >= 0:
                    continue
                number, guarded, wanted = words[word]
                if guarded and not allowed(text, start, at):
                    continue
                if wanted is not None:
                    asked = True
                    if number_before(text[:start], lead) not in wanted:
                        continue
                kept.append((start, number))
                used[start:at] = b"\1" * (at - start)
        if any(NARROW.search(text, a, b) for a, b in gaps(used)):
            self.worded(text, before, behind, kept, used)
        kept.sort()
        return kept, asked

    def ruby(self, text: str, spans: tuple, kept: list, used: bytearray) -> None:
        found = []
        for k, (start, end, base, reading) in enumerate(spans):
            own = self.readings.get(base) if reading and NARROW.search(reading) else None
            found.append((start, -end, reading or "", reading, reading if own is None else own))
            at = k + 1
            while base is not None and at < len(spans) and spans[at][0] == end and spans[at][2] is not None and len(base) + len(spans[at][2]) <= self.longest:
                base, end, at = base + spans[at][2], spans[at][1], at + 1
                if base in self.compounds:
                    said = self.compounds[base]
                    found.append((start, -end, said, said, said))
        at = 0
        for start, back, _, reading, fallback in sorted(found, key=lambda x: x[:3]):
            if start >= at:
                at = -back
                kept.append((start, self.tokens.number(text[start:at], reading, fallback, "ruby")))
                used[start:at] = b"\1" * (at - start)

    def worded(self, text: str, before: str, behind: str | None, kept: list, used: bytearray) -> None:
        """The tokenizer's words with ideographs and a reading: of the whole block where it is free, then of each gap by itself."""
        n = len(text)
        for start, end, said in self.words(text, before, behind):
            if used.find(1, start, end) < 0:
                kept.append((start, self.tokens.number(text[start:end], said, said, "unidic")))
                used[start:end] = b"\1" * (end - start)
        if not kept:
            return  # the gap is the block, and its words are known
        for at, end in gaps(used):
            if NARROW.search(text, at, end):
                part = text[at:end]
                for a, b, said in self.words(part, BOUND if at else before, behind if end == n else None):
                    kept.append((at + a, self.tokens.number(part[a:b], said, said, "unidic-gap")))

    def words(self, text: str, before: str, behind: str | None) -> list[tuple[int, int, str]]:
        key = (text, before, behind)
        found = self.parts.get(key)
        if found is None:
            found = [(a, b, canonical(reading)) for a, b, reading in self.tokenizer(text, before, behind) if reading and NARROW.search(text, a, b)]
            if len(text) <= REMEMBERED:
                self.parts[key] = found
                self.weight += ENTRY + 4 * len(found)
        return found

    def blocks(self, text: str, spans: list[tuple]) -> Iterator[tuple[int, tuple]]:
        """(where it begins, its tokens' starts, their numbers) of each block with tokens. spans in order."""
        n, memo, k, count = len(text), self.memo, 0, len(spans)
        found = [(0, n)] if self.whole else [m.span() for m in BLOCK.finditer(text)]
        if any([WHITE.search(text, a, b) for a, b, _, _ in spans]):
            found = [(0, n)]
        for start, end in found:
            block, own, first = text[start:end], (), k
            while k < count and spans[k][0] < end:
                k += 1
            if k > first:
                own = tuple([(a - start, b - start, base, reading) for a, b, base, reading in spans[first:k]])
            key = (block, own, start > 0, end < n)
            known = memo.get(key, 0)
            if known == 1:  # a rule asks for the number before it
                known = memo.get((*key, lead_of(text, start)), 0)
            if known == 0:
                lead = lead_of(text, start)
                kept, asked = self.free(block, own, BLANKS if start else BOUND, None if end == n else BLANKS, lead)
                known = tuple(zip(*kept, strict=True)) if kept else None
                if end - start <= REMEMBERED:
                    if asked:
                        memo[key] = 1
                        key = (*key, lead)
                    memo[key] = known
                    self.weight += ENTRY + len(kept) + 8 * len(own)
            if known is not None:
                yield start, *known


def gaps(used: bytearray) -> list[tuple[int, int]]:
    found, at, n = [], used.find(0), len(used)
    while at >= 0:
        end = used.find(1, at)
        end = n if end < 0 else end
        found.append((at, end))
        at = used.find(0, end)
    return found


def lead_of(text: str, start: int) -> str:
    """The last characters before a place, white space left out."""
    near = text[max(0, start - 64) : start].rstrip()
    return (near if near or start <= 64 else text[:start].rstrip())[-LEAD:]


def number_before(text: str, lead: str) -> str | None:
    """The number that a block's text, or else what stands before it, ends with."""
    found = NUMBER.search((text.rstrip() or lead)[-LEAD:])
    return found[0] if found else None


def in_slices(batches: Iterator[pa.RecordBatch], each: Callable[[str, list[tuple]], None]) -> Iterator[list[pa.Array]]:
    """Batches of (text, spans, keys...): each(text, its spans in order) for each row; the slices that were read."""
    for batch in batches:
        for part in slices(batch.columns):
            texts, spans = part[:2]
            listed = spans.flatten()
            columns = [listed.field(k).to_pylist() for k in range(4)]
            at = 0
            for text, n in zip(texts.to_pylist(), pc.fill_null(pc.list_value_length(spans), 0).to_pylist(), strict=True):
                size = len(text) if text else 0
                own = [s for s in zip(*(c[at : at + n] for c in columns), strict=True) if s[0] is not None and s[1] is not None and 0 <= s[0] < s[1] <= size]
                at += n
                if any(a[0] >= b[0] for a, b in pairwise(own)):
                    own.sort(key=lambda s: (s[0], s[1], s[2] is not None, s[2] or "", s[3] is not None, s[3] or ""))
                each(text, own)
            yield part


def token_rows(shared, made: Callable[[dict], Chapters], names: list[str]) -> Callable:
    """Batches of (text, spans, keys...) -> keys... and FIELDS, a row a token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chapters = made(shared.value)
        counts, numbers, starts, ends, prefixes, suffixes, blocked = columns = [[] for _ in range(7)]

        def each(text: str | None, spans: list[tuple]) -> None:
            tokens, first = chapters.tokens, len(numbers)
            sizes = tokens.sizes
            for at, places, found in chapters.blocks(text, spans) if text else ():
                for a, k in zip(places, found, strict=True):
                    a += at
                    b = a + sizes[k]
                    starts.append(a)
                    ends.append(b)
                    prefixes.append(text[a - AROUND if a > AROUND else 0 : a])
                    suffixes.append(text[b : b + AROUND])
                numbers.extend(found)
            own = numbers[first:]
            several = tokens.ambiguous(own)
            blocked.extend([tokens.pairs[k][0] in several for k in own] if several else [False] * len(own))
            counts.append(len(own))

        for part in in_slices(batches, each):
            if numbers:
                tokens, n = chapters.tokens, np.array(counts)
                taken, row = np.unique(np.array(numbers), return_inverse=True)
                known = zip(*[tokens.rows[k] for k in taken.tolist()], strict=True)
                found = {name: pa.array(x, ARROW[FIELDS[name]]).take(pa.array(row)) for name, x in zip(Tokens.NAMES, known, strict=True)}
                found |= {"token_idx": pa.array(np.arange(len(numbers)) - np.repeat(np.cumsum(n) - n, n)), "start": pa.array(starts, pa.int64()), "end": pa.array(ends, pa.int64())}
                found |= {"prefix": pa.array(prefixes, pa.string()), "suffix": pa.array(suffixes, pa.string()), "block": pa.array(blocked, pa.bool_())}
                kept = pa.array(np.repeat(np.arange(len(n)), n))
                yield pa.RecordBatch.from_arrays([*(c.take(kept) for c in part[2:]), *(found[name] for name in FIELDS)], [*names, *FIELDS])
            for x in columns:
                x.clear()
            if chapters.full():
                chapters.forget()

    return run


def rendered_rows(shared, made: Callable[[dict], Chapters], names: list[str]) -> Callable:
    """Batches of (text, spans, keys...) -> keys..., rendered, partial."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chapters, whole, partial = made(shared.value), [], []

        def each(text: str | None, spans: list[tuple]) -> None:
            if not text:
                whole.append(text)
                partial.append(text)
                return
            tokens, found, numbers = chapters.tokens, [], []
            for at, places, own in chapters.blocks(text, spans):
                found += [a + at for a in places]
                numbers += own
            several, said, shown, at = tokens.ambiguous(numbers), [], [], 0
            for start, k in zip(found, numbers, strict=True):
                surface, reading = tokens.rows[k][:2]
                if start > at:
                    between = text[at:start]
                    said.append(between)
                    shown.append(between)
                reading = surface if reading is None else reading
                said.append(reading)
                shown.append(surface if tokens.keeps[k] and surface not in several else reading)
                at = start + tokens.sizes[k]
            rest = text[at:]
            whole.append("".join(said) + rest)
            partial.append("".join(shown) + rest)

        for part in in_slices(batches, each):
            yield pa.RecordBatch.from_arrays([*part[2:], pa.array(whole, pa.string()), pa.array(partial, pa.string())], [*names, "rendered", "partial"])
            whole.clear()
            partial.clear()
            if chapters.full():
                chapters.forget()

    return run
