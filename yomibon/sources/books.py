"""Readers and writers of book packages: token, metadata, rule and bookmark JSON, chapter texts, manifests.

Schemas are explicit. A row without a required field is dropped, an optional field of another type
becomes null.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.kana import is_single_kanji, slug
from ..operators.labels import sample_parts

HIDDEN = (".original.txt", ".partial.txt")
TOKEN = "struct<surface:string,start:string,end:string,reading:string,reading_source:string,accent:string,pos:string,transformed_start:string,transformed_end:string>"
RULE = "struct<pattern:string,regex:boolean,replacement:string,reading:string,accent:string,pos:string,surface:string,match_surface:string,source:string>"


@F.pandas_udf(T.StringType())
def utf8_text(raw: pd.Series) -> pd.Series:
    """UTF-8 text; bytes that aren't are dropped."""
    return raw.map(lambda x: bytes(x).decode("utf-8", errors="ignore"), na_action="ignore")


def text_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, text of the chapters below a folder, or of one file; originals and partial texts are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(folder)
    return chapter_files(files).select("path", utf8_text("content").alias("text"))


def chapter_files(files: DataFrame) -> DataFrame:
    """files (path, ...) that are chapters: no originals, no partial texts."""
    for suffix in HIDDEN:
        files = files.where(~F.endswith("path", F.lit(suffix)))
    return files


def listed(files: DataFrame, metadata: DataFrame) -> DataFrame:
    """files (path, text) and metadata() -> book, file, text, title, author, chapter_title, index, in order of the path: the
    book is the folder of the file; without an entry the title is the first line of its original, else the file's stem."""
    from ..functions.kana import first_line

    parts = files.select("path", "text", F.regexp_extract("path", r"([^/]*)/[^/]*$", 1).alias("book"), F.regexp_extract("path", r"([^/]*)$", 1).alias("file"))
    originals = parts.where(F.endswith("path", F.lit(HIDDEN[0]))).select(F.concat(F.regexp_replace("path", r"\.original\.txt$", ""), F.lit(".txt")).alias("path"), first_line(F.col("text")).alias("own_title"))
    rows = chapter_files(parts).join(originals, "path", "left").join(metadata.select("book", "file", "title", "author", "index", F.col("chapter_title").alias("listed")), ["book", "file"], "left")
    stem = F.regexp_replace("file", r"(?<=.)\.[^.]*$", "")
    return rows.select("path", "book", "file", "text", "title", "author", F.coalesce("own_title", "listed", stem).alias("chapter_title"), "index").orderBy("path")


def whole(text, kind: str = "long"):
    """A number from a number or digit string, else null."""
    return F.when(F.rlike(text, F.lit(r"^-?\d+$")), text.cast(kind))


def offset(token: str, name: str):
    """An offset that may stand by itself or as {original, transformed}."""
    raw = F.col(f"{token}.{name}")
    return F.coalesce(whole(raw), whole(F.get_json_object(raw, "$.original")))


def tokens(files: DataFrame) -> DataFrame:
    """files (chapter, json) -> chapter, token_idx, surface, start, end, reading, ...: tokens that have what they need."""
    parsed = files.select("chapter", F.from_json("json", f"struct<text_sha1:string,tokens:array<{TOKEN}>>").alias("j"))
    rows = parsed.select("chapter", F.posexplode("j.tokens").alias("token_idx", "t"))
    moved = [F.coalesce(whole(F.col(f"t.transformed_{s}")), whole(F.get_json_object(F.col(f"t.{s}"), "$.transformed"))).alias(f"t_{s}") for s in ("start", "end")]
    found = rows.select("chapter", F.col("token_idx").cast("long").alias("token_idx"), "t.surface", offset("t", "start").alias("start"), offset("t", "end").alias("end"), "t.reading", "t.reading_source", whole(F.col("t.accent")).alias("accent"), "t.pos", *moved)
    return found.where("surface is not null and start is not null and `end` is not null")


def token_json(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """tokens and texts (chapter, text) -> chapter, json: with the hash of the stripped text."""
    from ..functions.kana import trimmed

    one = F.struct("token_idx", "surface", "start", "end", "reading", "reading_source", "accent", "pos")
    listed = rows.groupBy("chapter").agg(F.array_sort(F.collect_list(one)).alias("tokens"))
    joined = texts.join(listed, "chapter", "left")
    return joined.select("chapter", F.to_json(F.struct(F.lit(2).alias("version"), F.sha1(trimmed(F.col("text")).cast("binary")).alias("text_sha1"), F.coalesce("tokens", F.array()).alias("tokens"))).alias("json"))


def fresh(files: DataFrame, texts: DataFrame) -> DataFrame:
    """Token files whose hash is that of their chapter's stripped text."""
    from ..functions.kana import trimmed

    rows = files.join(texts.select("chapter", F.sha1(trimmed(F.col("text")).cast("binary")).alias("now")), "chapter")
    return rows.where(F.get_json_object("json", "$.text_sha1") == F.col("now")).drop("now")


def metadata(files: DataFrame) -> DataFrame:
    """files (book, json) -> book, title, author, file, index, chapter_title: the last entry of a file counts."""
    schema = "struct<title:string,author:string,chapters:array<struct<index:string,file:string,title:string,original_title:string,source:string>>>"
    rows = files.select("book", F.from_json("json", schema).alias("j")).select("book", "j.title", "j.author", F.posexplode("j.chapters").alias("pos", "c"))
    rows = rows.where("c.file is not null").withColumn("rank", F.row_number().over(Window.partitionBy("book", "c.file").orderBy(F.desc("pos")))).where("rank = 1")
    title = F.coalesce(F.nullif(F.col("c.original_title"), F.lit("")), F.nullif(F.col("c.title"), F.lit("")), F.regexp_extract("c.file", r"([^/]*?)(\.[^./]*)?$", 1))
    return rows.select("book", "title", "author", F.col("c.file").alias("file"), whole(F.col("c.index")).alias("index"), title.alias("chapter_title"))


def rules(files: DataFrame) -> DataFrame:
    """files (book, json) -> book, rule_idx and the rule: patterns must not be empty."""
    parsed = files.select("book", F.from_json("json", f"struct<overrides:array<{RULE}>>").alias("j"))
    rows = parsed.select("book", F.posexplode("j.overrides").alias("rule_idx", "r")).where("r.pattern <> ''")
    return rows.select("book", F.col("rule_idx").cast("long").alias("rule_idx"), "r.pattern", F.coalesce("r.regex", F.lit(False)).alias("regex"), "r.replacement", "r.reading", whole(F.col("r.accent")).alias("accent"), "r.pos", "r.surface", "r.match_surface", "r.source")


def removals(files: DataFrame) -> DataFrame:
    """files (book, json) -> book, reading, surface of `remove` or `removals`; at least one is given."""
    kind = "array<struct<reading:string,surface:string>>"
    parsed = files.select("book", F.from_json("json", f"struct<remove:{kind},removals:{kind}>").alias("j"))
    return parsed.select("book", F.inline(F.coalesce("j.remove", "j.removals"))).where("coalesce(nullif(reading, ''), nullif(surface, '')) is not null")


def bookmark_state(files: DataFrame) -> DataFrame:
    """files (book, json) -> book, id, chapter, time, label: the first of each id, with a chapter and a time."""
    schema = "struct<manual:array<struct<id:string,chapter:string,time:double,label:string>>>"
    rows = files.select("book", F.from_json("json", schema).alias("j")).select("book", F.posexplode("j.manual").alias("pos", "m")).where("m.id <> '' and m.chapter <> '' and m.time is not null")
    first = rows.withColumn("rank", F.row_number().over(Window.partitionBy("book", "m.id").orderBy("pos"))).where("rank = 1")
    return first.select("book", "m.id", "m.chapter", "m.time", "m.label")


def played_state(files: DataFrame) -> DataFrame:
    """files (book, json) -> book, last_chapter, last_time, played: each chapter once, in its first place; empty ones are dropped."""
    schema = "struct<last_played:struct<chapter:string,time:double>,played:array<string>>"
    rows = files.select("book", F.from_json("json", schema).alias("j"))
    last = F.when(F.col("j.last_played.chapter").isNotNull() & F.col("j.last_played.time").isNotNull(), F.col("j.last_played"))
    played = F.array_distinct(F.filter(F.coalesce("j.played", F.array().cast("array<string>")), lambda x: F.coalesce(F.trim(x), F.lit("")) != ""))
    return rows.select("book", last["chapter"].alias("last_chapter"), last["time"].alias("last_time"), played.alias("played"))


def json_files(spark: SparkSession, path: str) -> DataFrame:
    """path, json of files; none where there is nothing."""
    try:
        return spark.read.format("binaryFile").load(path).select("path", utf8_text("content").alias("json"))
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], "path string, json string")
        raise


ENTRY = "struct<base:string,reading:string,count:string,suffix:string,suffixes:array<struct<value:string,count:string>>,prefixes:array<struct<value:string,count:string>>>"


def corpus_dictionary(files: DataFrame) -> DataFrame:
    """files (json): arrays of entries -> base, reading, total, single, suffixes, prefixes array<struct<value,count>>: entries
    with a base, a reading and a count above 0, the last of a base; a list of suffixes goes before a single one."""
    from ..functions.kana import canonical_katakana
    from ..functions.unicode_udf import nfkc

    rows = files.select(F.posexplode(F.from_json("json", f"array<{ENTRY}>")).alias("pos", "e"))
    count = lambda c: F.coalesce(whole(c), F.lit(0).cast("long"))
    listed_ = lambda name: F.filter(F.transform(f"e.{name}", lambda x: F.struct(x["value"].alias("value"), count(x["count"]).alias("count"))), lambda x: x["value"].isNotNull() & (x["count"] > 0))
    total = count(F.col("e.count"))
    single = F.when(F.coalesce(F.col("e.suffix"), F.lit("")) != "", F.array(F.struct(F.col("e.suffix").alias("value"), total.alias("count")))).otherwise(F.array().cast("array<struct<value:string,count:bigint>>"))
    rows = rows.where((F.coalesce(F.col("e.base"), F.lit("")) != "") & (F.coalesce(F.col("e.reading"), F.lit("")) != "") & (total > 0))
    rows = rows.select(nfkc("e.base").alias("base"), canonical_katakana(nfkc("e.reading")).alias("reading"), total.alias("total"), F.coalesce(listed_("suffixes"), single).alias("suffixes"), F.coalesce(listed_("prefixes"), F.array().cast("array<struct<value:string,count:bigint>>")).alias("prefixes"), "pos")
    last = rows.groupBy("base").agg(F.max_by(F.struct("reading", "total", "suffixes", "prefixes"), "pos").alias("x"))
    return last.select("base", "x.*").withColumn("single", is_single_kanji(F.col("base")))


def sample_index(files: DataFrame) -> DataFrame:
    """files (path, json) of voice samples -> path, character, sample: an entry each, as JSON; a blank character is null."""
    rows = files.select("path", F.from_json("json", "struct<character:string,samples:array<string>>").alias("j"))
    return rows.select("path", F.nullif(F.trim("j.character"), F.lit("")).alias("character"), F.explode("j.samples").alias("sample")).where(F.startswith("sample", F.lit("{")))


def roster_cache(files: DataFrame, engine: str | None = None) -> DataFrame:
    """files (path, json) of voice rosters -> path, character: an entry each, as JSON; those of another engine are left out."""
    rows = files.select("path", F.from_json("json", "struct<engine_url:string,characters:array<string>>").alias("j"))
    own = rows if not engine else rows.where(F.coalesce("j.engine_url", F.lit(engine)) == engine)
    return own.select("path", F.explode("j.characters").alias("character"))


def voice_samples(files: DataFrame) -> DataFrame:
    """files (path) -> id, name, filename of the MP3 samples, by id, those without one last, then by name."""
    from ..functions.kana import folded

    names = files.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("filename")).where(F.endswith(F.lower("filename"), F.lit(".mp3")))
    rows = names.select(sample_parts(F.col("filename")).alias("p"), "filename").select("p.id", "p.name", "filename")
    return rows.orderBy(F.col("id").asc_nulls_last(), folded(F.col("name")))


def manifest(chapters: DataFrame, books: DataFrame) -> DataFrame:
    """chapters (book, index, file, title), books (book, title, author) -> book, json: tracks in order, without an index last."""
    track = F.struct(F.coalesce("index", F.lit(10**6)).alias("order"), F.col("file"), F.col("title").alias("chapter"), F.col("index"))
    rows = chapters.groupBy("book").agg(F.array_sort(F.collect_list(track)).alias("t"))
    tracks = F.transform("t", lambda x: F.struct(x["file"].alias("file"), x["chapter"].alias("chapter"), x["index"].alias("index")))
    rows = rows.join(books.select("book", F.col("title").alias("album"), F.col("author").alias("artist")), "book", "left")
    return rows.select("book", F.to_json(F.struct(F.lit(1).alias("version"), "album", "artist", tracks.alias("tracks"))).alias("json"))


def basenames(chapters: DataFrame) -> DataFrame:
    """chapters (book, index, title, source) -> with name: `NNN_` and the slug of the title, else of the source's stem; one
    that repeats in a book is the number alone, with a count if that repeats too."""
    stem = F.regexp_replace(F.regexp_extract("source", r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    number = F.lpad(F.col("index").cast("string"), 3, "0")
    chosen = F.coalesce(F.nullif(slug(F.coalesce("title", F.lit(""))), F.lit("")), F.nullif(slug(stem), F.lit("")))
    rows = chapters.withColumn("plain", F.coalesce(F.concat(number, F.lit("_"), chosen), number))
    rows = rows.withColumn("turn", F.row_number().over(Window.partitionBy("book", "plain").orderBy("index", "source")))
    rows = rows.withColumn("bare", F.when((F.col("turn") > 1) | (F.col("plain") == number), number))
    rows = rows.withColumn("again", F.row_number().over(Window.partitionBy("book", "bare").orderBy("turn", "source")))
    name = F.when(F.col("bare").isNull(), F.col("plain")).when(F.col("again") > 1, F.concat("bare", F.lit("_"), F.col("again").cast("string"))).otherwise(F.col("bare"))
    return rows.withColumn("name", name).drop("plain", "turn", "bare", "again")


def metadata_json(chapters: DataFrame, books: DataFrame) -> DataFrame:
    """chapters (book, index, file, title, original_title, source), books (book, title, author, cover, epub, defaults) ->
    book, json: what is null is left out, chapters stand by index."""
    one = F.struct("index", "file", "title", "original_title", "source")
    rows = chapters.groupBy("book").agg(F.array_sort(F.collect_list(one)).alias("chapters"))
    payload = F.struct(F.lit(1).alias("version"), "title", "chapters", "author", "cover", "epub", F.col("defaults").alias("tts_defaults"))
    return books.join(rows, "book", "left").withColumn("chapters", F.coalesce("chapters", F.array())).select("book", F.to_json(payload).alias("json"))


def evidence_json(evidence: DataFrame, *keys: str) -> DataFrame:
    """evidence (keys..., base, reading, count, suffix, suffixes, prefixes) -> keys..., json: by count, the highest first, then base."""
    one = F.struct((-F.col("count")).alias("order"), "base", "reading", "count", "suffix", "suffixes", "prefixes")
    listed_ = F.transform(F.array_sort(F.collect_list(one)), lambda x: F.struct(*[x[c].alias(c) for c in ("base", "reading", "count", "suffix", "suffixes", "prefixes")]))
    return evidence.groupBy(*keys).agg(F.to_json(listed_).alias("json"))


# --- packages --------------------------------------------------------------------------------------

def write_package(chapters: DataFrame, path: str) -> None:
    """Chapters as a Parquet table by book; rewriting a book replaces its partition only, so nothing stale stays."""
    chapters.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("book").parquet(path)


#: The tables of a package.
KINDS = ("metadata", "chapters", "tokens", "evidence", "manifest")


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def generations(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """The generations of a package, the oldest first: the number of a commit file, and the name in it; one that is empty isn't committed."""
    at, files = _files(spark, f"{path}/commits")
    found = []
    for status in files.listStatus(at) if files.exists(at) else []:
        stream = files.open(status.getPath())
        name = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        found.append((int(status.getPath().getName()), name))
    return sorted(found)


def commit(spark: SparkSession, path: str, tables: dict[str, DataFrame]) -> str:
    """Writes tables (book, ...) by kind as one generation of a package; the generation's name. It counts once its one commit
    file is there, which is made last and must not exist: of two writers at a time one fails, and what a failed one
    has left is never read. A generation replaces the books that are in its metadata, wholly."""
    number = max((n for n, _ in generations(spark, path)), default=0) + 1
    name = f"{number:012d}-{uuid.uuid4().hex}"
    for kind, rows in tables.items():
        rows.write.parquet(f"{path}/{kind}/generation={name}")
    at, files = _files(spark, f"{path}/commits/{number:012d}")
    stream = files.create(at, False)  # an error if another writer has this number
    stream.write(name.encode())
    stream.close()
    return name


def read_package(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A table of a package: each book as its last committed generation has it."""
    names = [name for _, name in generations(spark, path) if name]
    if not names:
        raise ValueError(f"no package at {path}")

    def whole(of: str) -> DataFrame:
        folders = [_files(spark, f"{path}/{of}/generation={n}") for n in names]
        return spark.read.option("basePath", f"{path}/{of}").parquet(*[at.toString() for at, files in folders if files.exists(at)])

    last = whole("metadata").groupBy("book").agg(F.max("generation").alias("generation"))
    return whole(kind).join(last, ["book", "generation"], "left_semi").drop("generation")


def write_book(chapters: DataFrame, tokens: DataFrame, evidence: DataFrame, books: DataFrame, path: str) -> str:
    """A generation of the package at `path`: chapters (book, index, title, original_title, source, text, original),
    tokens (book, index, and those of a chapter), evidence (book, ...), books (book, title, author, cover, epub). Voice
    defaults of books that were written before are carried over."""
    spark = chapters.sparkSession
    named = basenames(chapters).withColumn("file", F.concat("name", F.lit(".txt")))
    old = spark.createDataFrame([], "book string, defaults map<string,string>")
    if any(name for _, name in generations(spark, path)):
        kept = read_package(spark, path, "metadata").select("book", F.from_json("json", "struct<tts_defaults:map<string,string>>").alias("j"))
        old = old.unionByName(kept.where("j.tts_defaults is not null").select(F.col("book").cast("string").alias("book"), F.col("j.tts_defaults").alias("defaults")))
    as_text = token_json(tokens.withColumn("chapter", F.concat_ws("/", "book", F.col("index").cast("string"))), named.select(F.concat_ws("/", "book", F.col("index").cast("string")).alias("chapter"), "text"))
    keys = named.select(F.concat_ws("/", "book", F.col("index").cast("string")).alias("chapter"), "book", "index", "name")
    tables = {
        "metadata": metadata_json(named, books.join(old, "book", "left")),
        "chapters": named.select("book", "index", "name", "title", "source", "text", "original"),
        "tokens": as_text.join(keys, "chapter").select("book", "index", F.concat("name", F.lit(".txt.token.json")).alias("file"), "json"),
        "evidence": evidence_json(evidence, "book"),
        "manifest": manifest(named.select("book", "index", "file", "title"), books),
    }
    return commit(spark, path, tables)
