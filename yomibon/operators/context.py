"""Readings that depend on neighbours, and line breaks that depend on what lines look like."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kana import WIDE_CJK, is_cjk

# Words of kinship and their readings before an honorific, the honorifics, and 君 behind such a word.
KIN = {
    "父": "トウ", "母": "カア", "祖父": "ソフ", "祖母": "ソボ", "兄": "ニイ", "姉": "ネエ", "弟": "トウト", "妹": "イモウト", "伯父": "オジ", "叔父": "オジ",
    "伯母": "オバ", "叔母": "オバ", "爺": "ジイ", "婆": "バア", "義父": "ギフ", "義母": "ギボ", "客": "キャク", "医者": "イシャ",
}
HONORIFICS = ("さん", "様", "さま", "ちゃん", "くん", "殿", "どの", "氏", "君")
HONORIFIC_READINGS = {"君": "ギミ"}
# Words with a reading of their own, and parents before 上.
OWN_READINGS = {"父親": "オヤジ", "父上": "チチウエ", "母上": "ハハウエ"}
PARENTS = {"父": "チチ", "母": "ハハ"}
# What before 他 makes it ホカ.
BEFORE_OTHER = ("この", "その", "あの", "どの", "こんな", "そんな", "あんな", "どんな", "此の", "其の", "彼の")
# Marks that end a sentence, characters of a title line besides ideographs, kana, letters and digits, and its most characters.
SENTENCE_MARKS, TITLE_MARKS, TITLE_LENGTH = "。！？!?…", "・\\-‐ 　／()（）［］\\[\\]『』〈〉＝", 32


def lookup(values: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key)


def readings(morphemes: DataFrame, *keys: str) -> DataFrame:
    """morphemes (keys..., token_idx, surface, reading, pos[, lemma]) with readings set by context, the first rule that holds:

    a word of kinship before an honorific; 君 behind a word of kinship; a reading with ideographs is spelled from the
    characters before (々 repeats the reading before it); words with a reading of their own; a parent before 上; 他 as a
    noun before anything without ideographs or the end, or behind その and the like, is ホカ; 日 read カ behind a number of
    two digits or more is ニチ. A number may be one morpheme or several.
    """
    place = Window.partitionBy(*keys).orderBy("token_idx")
    lemma = F.coalesce(F.nullif("lemma", F.lit("")), F.trim("surface")) if "lemma" in morphemes.columns else F.trim("surface")
    digits = F.rlike("surface", F.lit(r"^[0-9０-９]+$"))
    rows = morphemes.withColumn("base_", lemma).withColumn("digit_", digits)
    rows = rows.withColumn("run_", F.sum(F.when(F.col("digit_"), 0).otherwise(1)).over(place))
    in_run = Window.partitionBy(*keys, "run_").orderBy("token_idx")
    rows = rows.withColumn("so_far_", F.sum(F.when(F.col("digit_"), F.char_length("surface")).otherwise(0)).over(in_run))
    number = F.coalesce(F.lag(F.when(F.col("digit_"), F.col("so_far_"))).over(place), F.lit(0))
    following, previous = F.trim(F.coalesce(F.lead("surface").over(place), F.lit(""))), F.trim(F.coalesce(F.lag("surface").over(place), F.lit("")))
    before, before_reading = F.coalesce(F.lag("base_").over(place), F.lit("")), F.lag("reading").over(place)
    base, surface, reading = F.col("base_"), F.trim("surface"), F.col("reading")
    kin = lookup(KIN, base)
    spelled = F.when(surface == "々", before_reading)
    unread = F.coalesce(is_cjk(reading), F.lit(True))
    parent = F.when(F.startswith(following, F.lit("上")), lookup(PARENTS, base))
    other = (base == "他") & F.coalesce(F.startswith("pos", F.lit("名詞")), F.lit(False)) & (~is_cjk(following) | previous.isin(*BEFORE_OTHER) | before.isin(*BEFORE_OTHER))
    new = (
        F.when(kin.isNotNull() & following.isin(*HONORIFICS), kin)
        .when(before.isin(*KIN) & surface.isin(*HONORIFIC_READINGS), lookup(HONORIFIC_READINGS, surface))
        .when(unread, F.coalesce(spelled, reading))
        .when(base.isin(*OWN_READINGS), lookup(OWN_READINGS, base))
        .when(parent.isNotNull(), parent)
        .when(other, F.lit("ホカ"))
        .when((surface == "日") & (reading == "カ") & (number >= 2), F.lit("ニチ"))
        .otherwise(reading)
    )
    return rows.withColumn("reading", new).drop("digit_", "run_", "so_far_", "base_")


def spelled_out(tokens: DataFrame, characters: DataFrame) -> DataFrame:
    """tokens (surface, reading, ...) without a reading take it from the characters' readings (surface, reading), one by one;
    a character without one stays as it is."""
    known = characters.groupBy(F.col("surface").alias("char")).agg(F.min("reading").alias("char_reading"))
    # By surface, which is data: numbers of rows may differ when a stage is run again.
    each = tokens.where("reading is null and surface is not null").select("surface").distinct().select("surface", F.posexplode(F.split("surface", "")).alias("at", "char")).where("char <> ''").join(known, "char", "left")
    said = each.groupBy("surface").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("char_reading", "char").alias("r")))), lambda x: x["r"]), "").alias("said"))
    return tokens.join(said, "surface", "left").withColumn("reading", F.coalesce("reading", "said")).select(*tokens.columns)


def looks_like_title(line: Column) -> Column:
    """A short line of ideographs, kana, ASCII letters, digits and the marks of titles."""
    own = F.regexp_replace(line, r"(?U)^\s+|\s+$", "")
    allowed = rf"^(?:{WIDE_CJK}|[\x{{3040}}-\x{{30FF}}A-Za-z0-9{TITLE_MARKS}]){{1,{TITLE_LENGTH}}}$"
    return F.coalesce(F.rlike(own, F.lit(allowed)), F.lit(False))


def title_break(text: Column) -> Column:
    """A blank line between a title line and an author line that begin a text, blank lines before them aside."""
    lines = F.split(text, "\n")
    filled = F.filter(F.transform(lines, lambda x, i: F.when(F.rlike(x, F.lit(r"(?U)\S")), i)), lambda i: i.isNotNull())
    first, second = F.get(filled, F.lit(0)), F.get(filled, F.lit(1))
    both = (second == first + 1) & looks_like_title(F.get(lines, first)) & looks_like_title(F.get(lines, second))
    broken = F.array_join(F.concat(F.slice(lines, F.lit(1), second), F.array(F.lit("")), F.slice(lines, second + 1, F.size(lines))), "\n")
    return F.when(F.coalesce(both, F.lit(False)), broken).otherwise(text)
