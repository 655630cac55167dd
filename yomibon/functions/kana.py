"""Column expressions for Japanese text: kana, character classes, spacing, names of files and paths.

Offsets and lengths are in code points. Everything here stays in the JVM; Unicode normalisation is in
`unicode_udf`, as Spark has no function for it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hiragana U+3041-U+3096 and the iteration marks, with the katakana of each.
HIRAGANA = "".join(map(chr, range(0x3041, 0x3097))) + "ゝゞゟ"
KATAKANA = "".join(map(chr, range(0x30A1, 0x30F7))) + "ヽヾヿ"
# Spellings that are read alike, and small kana with their full-size forms.
CANONICAL = ("ヂヅヮヵヶゕゖ", "ジズワカケカケ")
SMALL, FULL = "ァィゥェォッャュョヮヵヶぁぃぅぇぉっゃゅょゎ", "アイウエオツヤユヨワカケアイウエオツヤユヨワ"
# The ideographic blocks and marks of the wide, narrow and kanji-only classes.
WIDE_CJK = r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2B73F}\x{2B740}-\x{2B81F}\x{2B820}-\x{2CEAF}\x{2CEB0}-\x{2EBEF}\x{30000}-\x{3134F}\x{2F800}-\x{2FA1F}々〆ヵヶ]"
NARROW_CJK = r"[\x{4E00}-\x{9FFF}々〆ヵヶ]"
KANJI = r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{2CEAF}]"
KANA = r"[\x{3041}-\x{309F}\x{30A0}-\x{30FF}]"


def to_katakana(text: Column) -> Column:
    return F.translate(text, HIRAGANA, KATAKANA)


def canonical_katakana(text: Column) -> Column:
    """After NFKC: katakana with spellings that sound alike made one."""
    return F.translate(to_katakana(text), *CANONICAL)


def fold_small(text: Column) -> Column:
    return F.translate(text, SMALL, FULL)


def without_space(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", "")


def trimmed(text: Column) -> Column:
    """Without white space of any script at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def ellipsis(text: Column) -> Column:
    """Three dots or more, then two ellipses or more, become one ellipsis."""
    return F.regexp_replace(F.regexp_replace(text, r"\.{3,}", "…"), "…{2,}", "…")


def is_cjk(text: Column) -> Column:
    return F.rlike(text, F.lit(WIDE_CJK))


def is_cjk_narrow(text: Column) -> Column:
    return F.rlike(text, F.lit(NARROW_CJK))


def has_kanji(text: Column) -> Column:
    return F.rlike(text, F.lit(KANJI))


def is_single_kanji(text: Column) -> Column:
    own = trimmed(text)
    return (F.char_length(own) == 1) & is_cjk(own)


def is_kana(text: Column) -> Column:
    """Kana only; white space and middle dots don't count, and nothing is kana."""
    return F.rlike(F.regexp_replace(text, r"(?U)[\s・]", ""), F.lit(f"^{KANA}*$"))


def is_ascii_word(text: Column) -> Column:
    return F.rlike(text, F.lit(r"^[A-Za-z0-9\-_'’・]*[A-Za-z][A-Za-z0-9\-_'’・]*$"))


def looks_translated(reading: Column) -> Column:
    """A reading that explains rather than spells: Latin or dotted, or a long katakana word."""
    latin = F.rlike(reading, F.lit("[A-Za-zＡ-Ｚａ-ｚ・]"))
    hiragana = F.rlike(reading, F.lit(r"[\x{3041}-\x{3096}]"))
    return latin | (~hiragana & F.contains(reading, F.lit("ー")) & (F.char_length(reading) >= 4))


def is_name_candidate(base: Column, reading: Column) -> Column:
    """Two to four ideographs with a hiragana or long-mark reading."""
    n = F.char_length(base)
    spelled = F.rlike(reading, F.lit(r"[\x{3041}-\x{3096}ー]")) & ~F.rlike(reading, F.lit("[A-Za-z・]"))
    return (n >= 2) & (n <= 4) & F.rlike(base, F.lit(f"^{WIDE_CJK}+$")) & spelled


def small_kana_only(a: Column, b: Column) -> Column:
    """Two readings that differ, but only in the size of kana."""
    return (a != b) & (F.char_length(a) == F.char_length(b)) & (fold_small(a) == fold_small(b))


def reading_matches(reading: Column, variants: Column) -> Column:
    """Whether a reading is among variants, in canonical katakana; both after NFKC."""
    return F.coalesce(F.array_contains(F.transform(variants, canonical_katakana), canonical_katakana(reading)), F.lit(False))


def aligned_variant(reading: Column, variants: Column) -> Column:
    """The least variant that differs from a reading by small kana only."""
    return F.array_min(F.filter(variants, lambda v: small_kana_only(reading, v)))


def may_keep_surface(surface: Column, blocked: Column, source: Column, validated: Column) -> Column:
    """Whether a partial text may show a token as it is written: ideographs with one sure reading."""
    sure = F.lower(source).isin("unidic", "unidic-gap", "nhk") | F.coalesce(validated, F.lit(False))
    return F.coalesce(is_cjk_narrow(surface) & ~F.coalesce(blocked, F.lit(False)) & F.coalesce(sure, F.lit(False)), F.lit(False))


#: Digits and number signs that may stand before a counted word.
NUMERIC = "0-9０-９一二三四五六七八九十百千〇零"


def numeric_prefix(before: Column, most: int) -> Column:
    """The number at the end of a text, its last `most` characters, with space behind it left out; NFKC is left to the caller."""
    return F.regexp_extract(before, rf"([{NUMERIC}]{{1,{most}}})[ \t\r\n\x{{3000}}]*$", 1)


def is_content_pos(pos: Column) -> Column:
    return F.rlike(pos, F.lit("^(名詞|動詞|形容詞|副詞|連体詞|感動詞|形状詞|代名詞)"))


def paragraph_spacing(text: Column) -> Column:
    """A single line feed between characters becomes a blank line."""
    return F.regexp_replace(text, r"(?<=\S)\n(?=\S)", "\n\n")


def first_line(text: Column) -> Column:
    """The first line that isn't blank, trimmed; null without one."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^[ \t\r]+|[ \t\r]+$", ""))
    return F.get(F.filter(lines, lambda x: x != ""), F.lit(0))


def slug(text: Column, most: int = 80) -> Column:
    """A name for files: letters, digits and single underscores."""
    plain = F.regexp_replace(F.regexp_replace(text, r"[^\p{L}\p{N}]+", "_"), "^_+|_+$", "")
    return F.substring(plain, 1, most)


def library_path(path: Column) -> Column:
    """A relative path without empty, `.` and `..` parts."""
    return F.array_join(F.filter(F.split(path, "/"), lambda x: ~x.isin("", ".", "..")), "/")


def epub_path(base_file: Column, href: Column) -> Column:
    """href as seen from a file: empty and `.` parts go, `..` stays, and a leading slash begins anew."""
    folder = F.regexp_extract(base_file, r"^(.*/)?[^/]*$", 1)
    whole = F.when(F.startswith(href, F.lit("/")), href).otherwise(F.concat(folder, href))
    path = F.array_join(F.filter(F.split(whole, "/"), lambda x: ~x.isin("", ".")), "/")
    return F.when(F.startswith(whole, F.lit("/")), F.concat(F.lit("/"), path)).otherwise(path)


def stripped_of(text: Column, marks: str) -> Column:
    """Without any of some characters (a regular expression class's content) at either end."""
    return F.regexp_replace(text, f"^[{marks}]+|[{marks}]+$", "")


#: What file systems don't take in names.
NOT_IN_NAMES = r'[<>:"/\\|?*]'


def folder_name(name: Column, fallback: str = "book", most: int = 120) -> Column:
    """A name for a folder; `fallback` if nothing is left."""
    own = F.coalesce(F.nullif(trimmed(name), F.lit("")), F.lit(fallback))
    plain = stripped_of(F.regexp_replace(F.regexp_replace(own, NOT_IN_NAMES, "_"), r"[\x00-\x1F]", ""), " .")
    return F.substring(F.coalesce(F.nullif(plain, F.lit("")), F.lit(fallback)), 1, most)


def book_folder(file: Column) -> Column:
    """The folder of a book from its file's name, without path and suffix."""
    return folder_name(F.regexp_replace(F.regexp_extract(file, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", ""))


def sample_name(name: Column) -> Column:
    """A name for a voice sample: slashes and runs of space become a hyphen."""
    own = F.coalesce(F.nullif(trimmed(name), F.lit("")), F.lit("voice"))
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(own, r"[/\\]", "-"), NOT_IN_NAMES, "_"), r"[\x00-\x1F]", "")
    plain = F.coalesce(F.nullif(stripped_of(plain, r" ._\-"), F.lit("")), F.lit("voice"))
    return F.substring(F.regexp_replace(F.regexp_replace(plain, r"(?U)\s+", "-"), "-{2,}", "-"), 1, 120)


def cache_name(name: Column) -> Column:
    """A name for a cache folder: ASCII letters, digits and a few marks."""
    return F.substring(stripped_of(F.regexp_replace(name, "[^0-9A-Za-z._-]+", "_"), r"._\-"), 1, 64)


def engine_kana(text: Column) -> Column:
    """After NFKC: katakana alone, as speech engines spell it; middle dots and all else go."""
    return F.regexp_replace(F.translate(text, HIRAGANA[:-3], KATAKANA[:-3]), r"[^\x{30A1}-\x{30FF}]|・", "")


def folded(text: Column) -> Column:
    """Without case, as titles are compared."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


#: Characters whose capital is several characters in full, and their single ones.
SEVERAL = "".join(c for c in map(chr, range(0x80, 0x1FFFF)) if len(c.upper()) > 1)
SINGLE = "".join("ẞ" if c == "ß" else c.title() if len(c.title()) == 1 else c for c in SEVERAL)


def upper_by_character(text: Column) -> Column:
    """Upper case of as many characters as the text has."""
    return F.array_join(F.transform(F.split(text, ""), lambda c: F.when(F.char_length(F.upper(c)) == 1, F.upper(c)).otherwise(F.translate(c, SEVERAL, SINGLE))), "")


def track_number(name: Column) -> Column:
    """The digits that a file name begins with."""
    found = F.regexp_extract(name, r"^(\d+)", 1)
    return F.when(found != "", found.cast("long"))


def sample_key(speaker: Column, text: Column, speed: Column, pitch: Column, intonation: Column) -> Column:
    """The key of a voice sample: a hash of its settings in the order of their names."""
    settings = F.struct(intonation.alias("intonation"), pitch.alias("pitch"), speaker.alias("speaker"), speed.alias("speed"), text.alias("text"))
    return F.substring(F.sha1(F.to_json(settings).cast("binary")), 1, 12)


def cache_key(path: Column) -> Column:
    return F.substring(F.sha1(path.cast("binary")), 1, 10)


def chunk_key(text: Column, signature: Column) -> Column:
    return F.substring(F.sha1(F.concat(text, F.lit("||"), signature).cast("binary")), 1, 10)
