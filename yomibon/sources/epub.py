"""EPUB containers as DataFrames: entries, spine, contents, title, author, cover, chapters with ruby.

Containers are read by Spark's binaryFile source and opened inside tasks; everything after the
entries is joins over small relations that keep their order in columns.
"""

from __future__ import annotations

import io
import posixpath
import unicodedata
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import unquote

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.kana import is_ascii_word
from ..functions.slices import by_row, slices

# Encodings that are tried in turn.
ENCODINGS = ("utf-8", "utf-16", "cp932", "shift_jis", "euc_jp")
HTML = r"(?i)\.(xhtml|html|htm)$"
ENTRIES = "book string, entry string, entry_order long, bytes binary"


def decoded(raw: bytes) -> str:
    for name in ENCODINGS:
        try:
            return raw.decode(name)
        except UnicodeError:
            continue
    return raw.decode("utf-8", errors="ignore")


@by_row(T.StringType())
def decode_text(raw: bytes | None) -> str | None:
    return None if raw is None else decoded(raw)


def unzip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of containers (path, content); a few containers are open at a time."""
    for batch in batches:
        for paths, contents in slices(batch.columns, 16):
            rows = []
            for path, content in zip(paths.to_pylist(), contents.to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as book:
                    rows += [(path, x.filename, k, book.read(x)) for k, x in enumerate(book.infolist()) if not x.is_dir()]
            kinds = (pa.string(), pa.string(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["book", "entry", "entry_order", "bytes"])


def shelf(spark: SparkSession, path: str) -> DataFrame:
    """The containers of a folder (not of folders in it) or one container, by path, whatever the case of their suffix; none is an error."""
    found = spark.read.format("binaryFile").load(path).where(F.lower("path").endswith(".epub")).select("path", "content").orderBy("path")
    if found.select("path").isEmpty():
        raise ValueError(f"no EPUB at {path}")
    return found


def entries(books: DataFrame) -> DataFrame:
    """(path, content) -> book, entry, entry_order, bytes."""
    return books.select("path", "content").mapInArrow(unzip, ENTRIES)


def _local(tag: str) -> str:
    return tag.rpartition("}")[2].lower()


class Contents(HTMLParser):
    """Anchors of the contents navigation, or of any navigation if none says it is that."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.toc, self.href, self.text = 0, False, None, ""
        self.found: dict[bool, list[tuple[str, str]]] = {True: [], False: []}

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if tag == "nav":
            self.depth += 1
            self.toc = "toc" in (attrs.get("epub:type") or "").split() or attrs.get("role") == "doc-toc"
        elif tag == "a" and self.depth and attrs.get("href"):
            self.href, self.text = attrs["href"], ""

    def handle_data(self, data):
        self.text += data if self.href is not None else ""

    def handle_endtag(self, tag):
        if tag == "nav":
            self.depth = max(0, self.depth - 1)
        elif tag == "a" and self.href is not None:
            self.found[self.toc].append((self.href, " ".join(self.text.split())))
            self.href = None


def nav_points(page: str) -> list[tuple[str, str]]:
    parser = Contents()
    parser.feed(page)
    return parser.found[True] or parser.found[False]


def ncx_points(page: str) -> list[tuple[str, str]]:
    """Points in document order; one without a target is left out with all below it."""

    def below(node) -> Iterator[tuple[str, str]]:
        for child in node:
            if _local(child.tag) == "navpoint":
                target = next((x.get("src") for x in child if _local(x.tag) == "content" and x.get("src")), None)
                if target:
                    label = next((" ".join("".join(x.itertext()).split()) for x in child if _local(x.tag) == "navlabel"), "")
                    yield target, label
                    yield from below(child)
            elif _local(child.tag) == "navmap":
                yield from below(child)

    try:
        return list(below(ET.fromstring(page)))
    except ET.ParseError:
        return []


ITEM = T.StructType().add("id", "string").add("href", "string").add("type", "string").add("properties", "string")
PACKAGE = T.StructType().add("title", "string").add("authors", T.ArrayType(T.StringType())).add("items", T.ArrayType(ITEM)).add("spine", T.ArrayType(T.StringType())).add("cover_id", "string")


@by_row(PACKAGE)
def package_of(text: str | None) -> dict:
    found = {"title": None, "authors": [], "items": [], "spine": [], "cover_id": None}
    try:
        root = ET.fromstring(text)
    except (ET.ParseError, TypeError):
        return found
    for node in root.iter():
        name, own = _local(node.tag), "".join(node.itertext()).strip() if _local(node.tag) in ("title", "creator") else ""
        if name == "title" and own and not found["title"]:
            found["title"] = unicodedata.normalize("NFKC", own)
        elif name == "creator" and own:
            role = next((v for k, v in node.attrib.items() if _local(k) == "role"), "")
            if role.lower() in ("", "aut", "author"):
                found["authors"].append(unicodedata.normalize("NFKC", own).strip())
        elif name == "item" and node.get("href"):
            found["items"].append({"id": node.get("id"), "href": unquote(node.get("href")), "type": node.get("media-type"), "properties": node.get("properties")})
        elif name == "itemref" and node.get("idref"):
            found["spine"].append(node.get("idref"))
        elif name == "meta" and node.get("name") == "cover":
            found["cover_id"] = node.get("content")
    return found


def packages(files: DataFrame) -> DataFrame:
    """entries -> book, opf, base (its folder), package: the one the container names, else the first."""
    rootfile = files.where("entry = 'META-INF/container.xml'").select("book", F.regexp_extract(decode_text("bytes"), r"full-path\s*=\s*[\"']([^\"']+)", 1).alias("named"))
    opfs = files.where(F.lower("entry").endswith(".opf")).select("book", "entry", "entry_order", "bytes").join(rootfile, "book", "left")
    best = Window.partitionBy("book").orderBy(F.when(F.col("entry") == F.col("named"), 0).otherwise(1), "entry_order")
    first = opfs.withColumn("rank", F.row_number().over(best)).where("rank = 1")
    return first.select("book", F.col("entry").alias("opf"), F.regexp_extract("entry", r"^(.*/)?[^/]*$", 1).alias("base"), package_of(decode_text("bytes")).alias("package"))


@F.pandas_udf(T.StringType())
def resolved(base: pd.Series, href: pd.Series) -> pd.Series:
    return pd.Series([posixpath.normpath(b + h) if h else None for b, h in zip(base, href, strict=True)])


def spine(files: DataFrame, packs: DataFrame) -> DataFrame:
    """book, spine_index, path: manifest joined to the reading order; without one, all pages in their order."""
    items = packs.select("book", "base", F.explode("package.items").alias("item")).select("book", F.col("item.id").alias("idref"), resolved("base", F.col("item.href")).alias("path"))
    order = packs.select("book", F.posexplode("package.spine").alias("spine_index", "idref"))
    named = order.join(items, ["book", "idref"]).select("book", F.col("spine_index").cast("long").alias("spine_index"), "path")
    pages = files.where(F.rlike("entry", F.lit(HTML))).select("book", "entry", "entry_order")
    rest = pages.join(named.select("book").distinct(), "book", "left_anti")
    rank = F.row_number().over(Window.partitionBy("book").orderBy("entry_order")) - 1
    return named.unionByName(rest.select("book", rank.cast("long").alias("spine_index"), F.col("entry").alias("path")))


def authors(packs: DataFrame) -> DataFrame:
    """book, title, author: distinct authors in order, joined by a comma if all are ASCII words, else by a middle dot."""
    names = F.array_distinct("package.authors")
    ascii_only = F.forall(names, is_ascii_word)
    return packs.select("book", F.col("package.title").alias("title"), F.when(F.size(names) > 0, F.when(ascii_only, F.array_join(names, ", ")).otherwise(F.array_join(names, "・"))).alias("author"))


def covers(files: DataFrame, packs: DataFrame) -> DataFrame:
    """book, path, bytes: cover by metadata, by property, by name, else the first image; it must exist."""
    items = packs.select("book", "base", "package.cover_id", F.posexplode("package.items").alias("pos", "item")).where("item.type like 'image/%'")
    rank = (
        F.when(F.col("item.id") == F.col("cover_id"), 0)
        .when(F.coalesce(F.col("item.properties"), F.lit("")).contains("cover-image"), 1)
        .when(F.lower(F.concat_ws(" ", "item.id", "item.href")).contains("cover"), 2)
        .otherwise(3)
    )
    listed = items.select("book", "pos", rank.alias("rank"), resolved("base", F.col("item.href")).alias("entry"))
    there = listed.join(files.select("book", "entry", "bytes"), ["book", "entry"])
    return there.groupBy("book").agg(F.min(F.struct("rank", "pos", "entry", "bytes")).alias("best")).select("book", F.col("best.entry").alias("path"), "best.bytes")


@by_row(T.ArrayType(T.StructType().add("href", "string").add("title", "string")))
def contents_of(page: str, ncx: bool) -> list[dict]:
    return [{"href": h, "title": t} for h, t in (ncx_points(page) if ncx else nav_points(page))]


def contents(files: DataFrame, packs: DataFrame, order: DataFrame) -> DataFrame:
    """book, nav_order, spine_index, fragment, title, local_order: the navigation document, else the NCX, joined to the spine."""
    items = packs.select("book", "base", F.explode("package.items").alias("item"))
    is_nav = F.array_contains(F.split(F.coalesce("item.properties", F.lit("")), " "), "nav")
    docs = items.where(is_nav | (F.col("item.type") == "application/x-dtbncx+xml")).select("book", is_nav.alias("nav"), resolved("base", F.col("item.href")).alias("entry"))
    pages = docs.join(files.select("book", "entry", "bytes"), ["book", "entry"])
    points = pages.select("book", "nav", F.regexp_extract("entry", r"^(.*/)?[^/]*$", 1).alias("base"), contents_of(decode_text("bytes"), ~F.col("nav")).alias("points")).where(F.size("points") > 0)
    best = points.withColumn("rank", F.row_number().over(Window.partitionBy("book").orderBy(F.desc("nav")))).where("rank = 1")
    each = best.select("book", "base", F.posexplode("points").alias("nav_order", "p"))
    parts = F.split(F.col("p.href"), "#", 2)
    each = each.select("book", F.col("nav_order").cast("long").alias("nav_order"), resolved("base", unquoted(parts[0])).alias("path"), F.nullif(unquoted(F.coalesce(F.get(parts, F.lit(1)), F.lit(""))), F.lit("")).alias("fragment"), F.col("p.title").alias("title"))
    first = order.groupBy("book", "path").agg(F.min("spine_index").alias("spine_index"))
    local = F.row_number().over(Window.partitionBy("book", "spine_index").orderBy("nav_order")) - 1
    return each.join(first, ["book", "path"]).select("book", "nav_order", "spine_index", "fragment", "title", local.cast("long").alias("local_order"))


@F.pandas_udf(T.StringType())
def unquoted(x: pd.Series) -> pd.Series:
    return x.map(unquote, na_action="ignore")
