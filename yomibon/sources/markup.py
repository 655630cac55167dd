"""Ruby-annotated markup to text with spans: one pass, offsets in the produced text."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.slices import slices
from ..functions.kana import CANONICAL, HIRAGANA, KATAKANA, NUMERIC

# Elements without text, elements that begin a line, and those that do so inside others too.
SILENT = frozenset("rp script style title".split())
BLOCK = frozenset("address article aside blockquote dd div dl dt figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main nav ol p pre section table ul tr".split())
ALWAYS = frozenset("h1 h2 h3 h4 h5 h6 li p dt dd tr".split())
#: Elements that have no end.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
OKURIGANA = re.compile("\\s*([ぁ-ゟ゠-ヿ]*)")
PREFIX_LENGTH = 4
NUMBER_BEFORE = re.compile(f"([{NUMERIC}]{{1,{PREFIX_LENGTH}}})\\s*$")
TO_KATAKANA = str.maketrans(HIRAGANA, KATAKANA) | str.maketrans(*CANONICAL)


def katakana(text: str) -> str:
    """The canonical katakana of a reading."""
    return unicodedata.normalize("NFKC", text).translate(TO_KATAKANA)


def is_xml(page: str) -> bool:
    """Whether a page is XML rather than HTML: `<x/>` then ends its element."""
    head = page.lstrip()[:200].lower()
    return head.startswith("<?xml") or ("<html" in head and "xmlns" in head)


#: Pages that have no other tags, nor references, are cut by one pattern.
SIMPLE = re.compile("<(/?)(p|ruby|rt|rb|rp|rtc|br|div|h[1-6]|ul|ol|li|span|em|strong|b|i)>")


class Reader(HTMLParser):
    """Text and ruby spans of a page. spoken: ruby gives its reading, and text outside goes through `outside`."""

    def __init__(self, xml: bool = False, spoken: bool = False, outside=None):
        super().__init__(convert_charrefs=True)
        self.text, self.spans = "", []
        self.xml, self.spoken, self.outside = xml, spoken, outside or (lambda x: x)
        self.silent, self.ruby, self.part = 0, None, "base"
        self.blocks: list[str] = []

    def read(self, page: str) -> None:
        """A whole page. A simple one has the same events without the parser."""
        parts = SIMPLE.split(page) if "&" not in page else []
        if len(parts) != 3 * page.count("<") + 1:
            self.feed(page)
            self.close()
            return
        for k in range(0, len(parts), 3):
            if k:
                (self.handle_endtag if parts[k - 2] else self.opened)(parts[k - 1])
            if parts[k]:
                self.handle_data(parts[k])

    def opened(self, tag: str) -> None:
        self.handle_starttag(tag, [])

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if self.xml or tag in VOID:
            self.handle_endtag(tag)

    def handle_starttag(self, tag, attrs):
        if tag in SILENT:
            self.silent += 1
        elif tag == "ruby":
            self.ruby, self.part = {"base": "", "rb": "", "reading": "", "all": "", "start": len(self.text)}, "base"
        elif tag in ("rt", "rtc"):
            self.part = "reading"
        elif tag == "rb":
            self.part = "rb"
        elif tag == "br":
            self.text += "\n" if self.ruby is None else ""
        elif tag in BLOCK:
            if not self.xml and self.blocks[-1:] in (["p"], [tag] if tag in ("li", "dt", "dd") else ["p"]):
                self.blocks.pop()  # a block ends a paragraph, an item the one before it
            if self.ruby is None and (tag in ALWAYS or not self.blocks):
                self.text += "\n"
            self.blocks += [tag] if tag not in VOID else []

    def handle_endtag(self, tag):
        if tag in SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag in ("rt", "rb", "rtc"):
            self.part = "base"
        elif tag in self.blocks:
            while self.blocks.pop() != tag:
                pass
        elif tag == "ruby" and self.ruby is not None:
            own, self.ruby = self.ruby, None
            base = re.sub(r"\s+", "", unicodedata.normalize("NFKC", own["rb"] or own["base"]))
            reading = katakana(re.sub(r"\s+", "", own["reading"] or own["all"]))
            self.text += reading if self.spoken else base
            if base and reading:
                self.spans.append((base, reading, own["start"], own["start"] + len(base), re.sub(r"\s+", "", own["reading"] or own["all"])))

    def handle_data(self, data):
        if self.silent:
            return
        if self.ruby is not None:
            self.ruby[self.part] += data
            self.ruby["all"] += data
        else:
            self.text += self.outside(unicodedata.normalize("NFKC", data))


def edited(text: str, marks: list[int], pattern: re.Pattern, new: str) -> tuple[str, list[int]]:
    """The text with `new` for each match, and where the marks (ascending) are in it; a mark inside a match is at its start."""
    if not pattern.search(text):
        return text, marks
    out, moved, at, size, k = [], [], 0, 0, 0
    for m in [*pattern.finditer(text), None]:
        start, end = m.span() if m else (len(text), len(text))
        while k < len(marks) and (marks[k] <= start or not m):
            moved.append(size + marks[k] - at)
            k += 1
        out.append(text[at:start])
        size += start - at
        while m and k < len(marks) and marks[k] < end:
            moved.append(size)
            k += 1
        if m:
            out.append(m.expand(new))
            size += len(out[-1])
        at = end
    return "".join(out), moved


#: What is tidied in a text, in turn.
TIDY = ((r"[ \t]+\n", r"\n"), ("[〝〟]", '"'), (r"\.{3,}", "…"), ("…{2,}", "…"), (r"\n{3,}", r"\n\n"), (r"\A\s+|\s+\Z", ""))
TIDY = tuple((re.compile(pattern), new) for pattern, new in TIDY)


def page_text(page: str, spoken: bool = False, outside=None) -> tuple[str, list[tuple[str, str, int, int]]]:
    """(text, spans (base, reading, start, end) by offset in the text)."""
    return read_page(page, spoken, outside)[:2]


def read_page(page: str, spoken: bool = False, outside=None) -> tuple[str, list[tuple[str, str, int, int]], list[str]]:
    """(text, spans, the spans' readings as they are written)."""
    reader = Reader(is_xml(page), spoken, outside)
    reader.read(page)
    text, marks = reader.text, [x for span in reader.spans for x in span[2:4]]
    for pattern, new in TIDY:
        text, marks = edited(text, marks, pattern, new)
    spans = [(b, r, marks[2 * k], marks[2 * k + 1]) for k, (b, r, *_) in enumerate(reader.spans)]
    return text, spans, [x[4] for x in reader.spans]


SPAN = T.StructType().add("base", "string").add("reading", "string").add("start", "long").add("end", "long").add("raw", "string").add("prefix", "string").add("suffix", "string")
MARKUP = T.StructType().add("text", "string").add("spans", T.ArrayType(SPAN))


def annotated(page: str) -> tuple[str, list[tuple]]:
    """The text and its spans as they are in SPAN, with the number before each and the kana behind it, up to the next span."""
    text, spans, raws = read_page(page)
    found, before = [], 0
    for k, ((base, reading, start, end), raw) in enumerate(zip(spans, raws, strict=True)):
        limit = spans[k + 1][2] if k + 1 < len(spans) else len(text)
        number = NUMBER_BEFORE.search(text, before, start)
        found.append((base, reading, start, end, raw, unicodedata.normalize("NFKC", number[1]) if number else "", OKURIGANA.match(text, end, limit)[1]))
        before = end
    return text, found


def evidence(page: str) -> tuple[str, list[dict]]:
    """The same with spans as dictionaries."""
    text, found = annotated(page)
    return text, [dict(zip(SPAN.names, span, strict=True)) for span in found]


@F.arrow_udf(MARKUP)
def parse_markup(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    kinds = [pa.int64() if f.dataType == T.LongType() else pa.string() for f in SPAN]
    for batch in batches:
        if not len(batch):
            yield pa.array([], to_arrow_type(MARKUP))
        for (pages,) in slices([batch]):
            texts, spans, bounds = [], [], [0]
            for page in pages.to_pylist():
                text, found = annotated(page or "")
                texts.append(text)
                spans += found
                bounds.append(len(spans))
            columns = zip(*spans, strict=True) if spans else [[]] * len(kinds)
            rows = pa.StructArray.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], SPAN.names)
            yield pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), rows)], MARKUP.names)


def spoken_text(mapping: dict[str, str]):
    """An Arrow-batched function: pages with ruby as its reading, and the dictionary's words outside it as theirs."""
    from ..operators.tiers import compiled, matches

    @F.pandas_udf(T.StringType())
    def said(pages: pd.Series) -> pd.Series:
        pattern = compiled(mapping)

        def outside(text: str) -> str:
            parts, at = [], 0
            for start, end, reading in matches(text, mapping, pattern):
                parts += [text[at:start], reading]
                at = end
            return "".join([*parts, text[at:]])

        return pages.map(lambda page: page_text(page, True, outside)[0], na_action="ignore")

    return said


def ruby(pages: DataFrame, *keys: str) -> DataFrame:
    """pages (keys..., html) -> keys..., pos, base, reading, start, end, raw, prefix, suffix: the evidence in page order."""
    rows = pages.select(*keys, parse_markup("html").alias("m")).select(*keys, F.posexplode("m.spans").alias("pos", "s"))
    return rows.select(*keys, F.col("pos").cast("long").alias("pos"), "s.base", "s.reading", "s.start", "s.end", "s.raw", "s.prefix", "s.suffix")


def corpus_ruby(entries: DataFrame, folder: str = "text") -> DataFrame:
    """entries of containers (book, entry, bytes) -> the evidence of their text pages: XHTML below a folder of that name."""
    from .epub import decode_text

    own = entries.where(F.lower("entry").endswith(".xhtml") & F.contains(F.concat(F.lit("/"), F.lower("entry")), F.lit(f"/{folder}/")))
    return ruby(own.select("book", "entry", decode_text("bytes").alias("html")), "book", "entry")


def texts(pages: DataFrame, *keys: str) -> DataFrame:
    """pages (keys..., html) -> keys..., text."""
    return pages.select(*keys, parse_markup("html").alias("m")).select(*keys, F.col("m.text").alias("text"))
