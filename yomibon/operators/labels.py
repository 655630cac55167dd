"""Labels, names and small suggestions of the library's views."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.kana import KANA, WIDE_CJK, sample_name, trimmed


def progress_label(book: Column, index: Column, total: Column, title: Column) -> Column:
    """`book · 2/9 · title`: without a total the place alone, without a place or title neither."""
    place = F.when((index > 0) & (total > 0), F.concat_ws("/", index.cast("string"), total.cast("string"))).when(index > 0, index.cast("string"))
    return F.concat_ws(" · ", book, place, F.nullif(trimmed(title), F.lit("")))


def sample_text(lines: Column) -> Column:
    """The lines that say something, trimmed; null without one."""
    own = F.filter(F.transform(lines, trimmed), lambda x: x.isNotNull() & (x != ""))
    return F.when(F.size(own) > 0, F.array_join(own, "\n"))


def sample_file(speaker: Column, name: Column, width: int = 3) -> Column:
    """`007-name.mp3`; a longer number stays whole."""
    number = speaker.cast("string")
    return F.concat(F.lpad(number, F.greatest(F.lit(width), F.length(number)), F.lit("0")), F.lit("-"), sample_name(name), F.lit(".mp3"))


def sample_parts(file: Column) -> Column:
    """struct(id, name) of a sample's file name; without a leading number the whole stem is the name."""
    stem = F.regexp_replace(file, r"(?i)\.mp3$", "")
    number = F.regexp_extract(stem, r"^([0-9]+)-", 1)
    rest = F.regexp_extract(stem, r"^[0-9]+-(.*)$", 1)
    return F.struct(F.nullif(number, F.lit("")).try_cast("long").alias("id"), F.when((number != "") & (rest != ""), rest).otherwise(stem).alias("name"))


def cached_sample_file(speaker: Column, speed: Column, pitch: Column, intonation: Column, key: Column, width: int = 3) -> Column:
    number = speaker.cast("string")
    return F.concat(F.lpad(number, F.greatest(F.lit(width), F.length(number)), F.lit("0")), F.format_string("-spd%.2f-pit%.2f-int%.2f-", speed, pitch, intonation), key, F.lit(".wav"))


def lookahead(selection: Column) -> Column:
    """struct(pattern, surface) for a selection of ideographs and a kana tail: the rule for the head where the tail follows; null for others."""
    head = F.regexp_extract(selection, rf"^(.*?)({KANA}+)$", 1)
    tail = F.regexp_extract(selection, rf"^(.*?)({KANA}+)$", 2)
    fits = (tail != "") & F.rlike(head, F.lit(f"{WIDE_CJK}$"))
    return F.when(fits, F.struct(F.concat(head, F.lit("(?="), tail, F.lit(")")).alias("pattern"), head.alias("surface")))
