"""Queries of text functions, evidence, alignment and assembly, over words and texts of the tables put into kana and ideographs."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import kana
from ..functions.slices import by_row
from ..functions.unicode_udf import all_digits, nfkc
from ..operators import alignment, assembly, context, dictionary, evidence, labels, tiers, tokens
from ..session import table
from .catalogue import guarded_sql, long, md5, query, quoted

#: One table of letters for Spark and SQL: kana of all kinds, marks, and ideographs.
LETTERS, JAPANESE = "abcdefghijklmnopqrstuvwxyz", "あいうえおかきッャヵァ・ー漢字東京雨明日語々〆ヶン温"
SPLIT = r"list_filter(string_split_regex(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '')"
WORDS = rf"""w0 AS (SELECT conv_id, turn, {SPLIT} AS ws FROM conversations),
jw AS (SELECT conv_id, turn, CAST(i - 1 AS BIGINT) AS token_idx, w, translate(lower(w), '{LETTERS}', '{JAPANESE}') AS j FROM (SELECT conv_id, turn, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM w0))"""
JTEXT = f"jt AS (SELECT conv_id, turn, translate(lower(text), '{LETTERS}', '{JAPANESE}') AS j FROM conversations)"
KEYS = ("conv_id", "turn")


def japanese(text):
    return F.translate(F.lower(text), LETTERS, JAPANESE)


def conversations(spark, d):
    return table(spark, d, "conversations").select(*KEYS, "text")


def j_words(spark, d):
    rows = conversations(spark, d).select(*KEYS, F.posexplode(tokens.plain_words(F.col("text"))).alias("token_idx", "w"))
    return rows.select(*KEYS, long("token_idx"), "w", japanese(F.col("w")).alias("j"))


def j_texts(spark, d):
    return conversations(spark, d).select(*KEYS, japanese(F.col("text")).alias("j"))


def matches(value: str, pattern: str) -> str:
    return f"regexp_matches({value}, '{pattern}')"


def katakana_sql(x: str) -> str:
    return f"translate({x}, '{kana.HIRAGANA}', '{kana.KATAKANA}')"


def canonical_sql(x: str) -> str:
    return f"translate({katakana_sql(x)}, '{kana.CANONICAL[0]}', '{kana.CANONICAL[1]}')"


def folded_sql(x: str) -> str:
    return f"translate({x}, '{kana.SMALL}', '{kana.FULL}')"


# --- characters and spellings ----------------------------------------------------------------------


@query(
    f"WITH {WORDS} SELECT conv_id, turn, token_idx, {matches('j', kana.WIDE_CJK)} AS wide, {matches('j', kana.NARROW_CJK)} AS narrow, {matches('j', kana.KANJI)} AS kanji, length(trim(j)) = 1 AND {matches('j', kana.WIDE_CJK)} AS single, "
    rf"{matches('replace(j, chr(12539), ' + chr(39) * 2 + ')', '^' + kana.KANA + '*$')} AS kana, regexp_matches(w, '^[A-Za-z0-9\-_''’・]*[A-Za-z][A-Za-z0-9\-_''’・]*$') AS ascii, regexp_full_match(w, '\p{{Nd}}+') AS digits FROM jw"
)
def kana_classes(spark, d):
    """The character classes of words."""
    j = F.col("j")
    return j_words(spark, d).select(
        *KEYS, "token_idx", kana.is_cjk(j).alias("wide"), kana.is_cjk_narrow(j).alias("narrow"), kana.has_kanji(j).alias("kanji"), kana.is_single_kanji(j).alias("single"), kana.is_kana(j).alias("kana"),
        kana.is_ascii_word(F.col("w")).alias("ascii"), all_digits("w").alias("digits"),
    )


@query(
    f"WITH {WORDS} SELECT conv_id, turn, token_idx, {katakana_sql('j')} AS katakana, {canonical_sql('j')} AS canonical, {folded_sql('j')} AS folded, "
    f"regexp_replace(translate(j, '{kana.HIRAGANA[:-3]}', '{kana.KATAKANA[:-3]}'), '[^\\x{{30A1}}-\\x{{30FF}}]|・', '', 'g') AS engine FROM jw"
)
def kana_spellings(spark, d):
    """Words in katakana, canonical after NFKC, with small kana full-size, and as a speech engine spells them."""
    j = nfkc("j")
    return j_words(spark, d).select(*KEYS, "token_idx", kana.to_katakana(F.col("j")).alias("katakana"), kana.canonical_katakana(j).alias("canonical"), kana.fold_small(F.col("j")).alias("folded"), kana.engine_kana(j).alias("engine"))


@query(
    f"WITH {JTEXT} SELECT conv_id, turn, md5(regexp_replace(j, '[\\s　]+', '', 'g')) AS spaceless, md5(regexp_replace(regexp_replace(replace(j, '.', '...'), '\\.{{3,}}', '…', 'g'), '…{{2,}}', '…', 'g')) AS dotted, "
    f"md5(regexp_replace(regexp_replace({canonical_sql('j')}, '\\.{{3,}}', '…', 'g'), '…{{2,}}', '…', 'g')) AS plain FROM jt"
)
def kana_texts(spark, d):
    """Texts without space, with ellipses made one, and as they are read without a dictionary."""
    j = F.col("j")
    return j_texts(spark, d).select(*KEYS, md5(kana.without_space(j)).alias("spaceless"), md5(kana.ellipsis(F.replace(j, F.lit("."), F.lit("...")))).alias("dotted"), md5(tiers.plain_reading(nfkc("j"))).alias("plain"))


@query(
    f"WITH {WORDS} SELECT conv_id, turn, token_idx, {matches('j', '[A-Za-zＡ-Ｚａ-ｚ・]')} OR (NOT {matches('j', '[\\x{3041}-\\x{3096}]')} AND contains(j, 'ー') AND length(j) >= 4) AS translated, "
    f"length(j) BETWEEN 2 AND 4 AND {matches('j', '^' + kana.WIDE_CJK + '+$')} AND {matches('r', '[\\x{3041}-\\x{3096}ー]')} AND NOT {matches('r', '[A-Za-z・]')} AS name, regexp_extract(before, '([{kana.NUMERIC}]{{1,4}})[ \\t\\r\\n\\x{{3000}}]*$', 1) AS number, "
    f"{matches('j', kana.NARROW_CJK)} AND token_idx % 5 <> 0 AND (token_idx % 3 = 0 OR token_idx % 2 = 0) AS keeps FROM (SELECT *, translate(w, 'aeiou', 'あーうえお') AS r, 'x' || (conv_id * 37 + token_idx * 101) || repeat('　', turn % 3) AS before FROM jw)"
)
def reading_predicates(spark, d):
    """Readings that translate, names, the number before a word, and tokens that may keep their surface."""
    idx, rows = F.col("token_idx"), j_words(spark, d)
    spelled = F.translate("w", "aeiou", "あーうえお")
    before = F.concat(F.lit("x"), (F.col("conv_id") * 37 + idx * 101).cast("string"), F.expr("repeat('　', cast(turn % 3 as int))"))
    source = F.when(idx % 3 == 0, "UniDic").otherwise("ruby")
    return rows.select(
        *KEYS, "token_idx", kana.looks_translated(F.col("j")).alias("translated"), kana.is_name_candidate(F.col("j"), spelled).alias("name"), kana.numeric_prefix(before, 4).alias("number"),
        kana.may_keep_surface(F.col("j"), idx % 5 == 0, source, idx % 2 == 0).alias("keeps"),
    )


SMALL_A, SMALL_B = "translate(lower(w), 'aeioubcdfg', 'ァィゥェォカキクケコ')", "translate(lower(w), 'aeioubcdfg', 'アィウェオカキクケコ')"


@query(
    f"WITH {WORDS}, p AS (SELECT *, {SMALL_A} AS a, {SMALL_B} AS b, {folded_sql(SMALL_A)} AS c FROM jw) SELECT conv_id, turn, token_idx, a <> b AND {folded_sql('a')} = {folded_sql('b')} AS small_only, a = b OR a = 'キ' AS known, "
    f"CASE WHEN a <> b AND a <> c AND {folded_sql('a')} = {folded_sql('b')} THEN least(b, c) WHEN a <> b THEN b WHEN a <> c THEN c END AS aligned FROM p"
)
def small_kana_pairs(spark, d):
    """Readings that differ in small kana only, readings among variants, and the variant to align to."""
    a, b = (F.translate(F.lower("w"), "aeioubcdfg", to) for to in ("ァィゥェォカキクケコ", "アィウェオカキクケコ"))
    return j_words(spark, d).select(*KEYS, "token_idx", kana.small_kana_only(a, b).alias("small_only"), kana.reading_matches(a, F.array(b, F.lit("キ"))).alias("known"), kana.aligned_variant(a, F.array(b, kana.fold_small(a), F.lit("ン"))).alias("aligned"))


CHARACTERS = {"漢": "カ", "字": "ジ", "東": "ヒ", "雨": "ウ", "日": "ニ"}


@query(f"WITH {WORDS} SELECT conv_id, turn, token_idx, CASE WHEN token_idx % 2 = 0 THEN 'ヨミ' ELSE translate(j, '{''.join(CHARACTERS)}', '{''.join(CHARACTERS.values())}') END AS reading FROM jw")
def spelled_readings(spark, d):
    """Words without a reading, spelled from their characters."""
    rows = j_words(spark, d).select(*KEYS, "token_idx", F.col("j").alias("surface"), F.when(F.col("token_idx") % 2 == 0, F.lit("ヨミ")).alias("reading"))
    return context.spelled_out(rows, spark.createDataFrame([*CHARACTERS.items()], "surface string, reading string")).select(*KEYS, "token_idx", "reading")


MORPHEMES = [("父", "チチ"), ("さん", "サン"), ("君", "クン"), ("他", "タ"), ("の", "ノ"), ("日", "カ"), ("1", "1"), ("17", "17"), ("その", "ソノ"), ("上", "ウエ"), ("々", "々"), ("人", "ヒト"), ("父上", "フジョウ")]


@query(
    f"""WITH {WORDS}, m AS (SELECT conv_id, turn, token_idx, [{quoted(*[a for a, _ in MORPHEMES])}][(token_idx * 7 + length(w) * length(w)) % 13 + 1] AS surface, [{quoted(*[b for _, b in MORPHEMES])}][(token_idx * 7 + length(w) * length(w)) % 13 + 1] AS reading FROM jw),
n AS (SELECT *, regexp_matches(surface, '^[0-9]+$') AS digit, coalesce(lead(surface) OVER o, '') AS f, coalesce(lag(surface) OVER o, '') AS p, lag(reading) OVER o AS pr, sum(CASE WHEN regexp_matches(surface, '^[0-9]+$') THEN 0 ELSE 1 END) OVER o AS run FROM m WINDOW o AS (PARTITION BY conv_id, turn ORDER BY token_idx)),
q AS (SELECT *, sum(CASE WHEN digit THEN length(surface) ELSE 0 END) OVER (PARTITION BY conv_id, turn, run ORDER BY token_idx) AS so_far FROM n),
r AS (SELECT *, coalesce(lag(CASE WHEN digit THEN so_far END) OVER (PARTITION BY conv_id, turn ORDER BY token_idx), 0) AS number FROM q)
SELECT conv_id, turn, token_idx, CASE WHEN surface = '父' AND f IN ('さん', '君') THEN 'トウ' WHEN p = '父' AND surface = '君' THEN 'ギミ' WHEN surface = '々' THEN coalesce(pr, reading) WHEN surface = '父上' THEN 'チチウエ' WHEN surface = '父' AND starts_with(f, '上') THEN 'チチ'
    WHEN surface = '他' AND token_idx % 3 <> 0 AND (NOT {matches('f', kana.WIDE_CJK)} OR p = 'その') THEN 'ホカ' WHEN surface = '日' AND number >= 2 THEN 'ニチ' ELSE reading END AS reading FROM r"""
)
def ja_context_readings(spark, d):
    """Readings by what stands beside a word: honorifics, parents, numbers of days, 他 and 々."""
    at = F.get(F.array(*[F.struct(F.lit(a).alias("surface"), F.lit(b).alias("reading")) for a, b in MORPHEMES]), ((F.col("token_idx") * 7 + F.length("w") * F.length("w")) % 13).cast("int"))
    rows = j_words(spark, d).select(*KEYS, "token_idx", at["surface"].alias("surface"), at["reading"].alias("reading"), F.when(F.col("token_idx") % 3 == 0, "助詞").otherwise("名詞-普通名詞").alias("pos"))
    return context.readings(rows, *KEYS).select(*KEYS, "token_idx", "reading")


@query(
    rf"""WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM (SELECT doc_id, chr(10) || 'Name' || doc_id || chr(10) || CASE doc_id % 4 WHEN 0 THEN '著者・A' WHEN 1 THEN 'too long a line for a title line, really' WHEN 2 THEN '終わり。' ELSE chr(10) || 'B' END || chr(10) || text AS text FROM documents)),
f AS (SELECT *, list_filter(range(1, len(ls) + 1), lambda i: regexp_matches(ls[i], '\S')) AS filled FROM l)
SELECT doc_id, md5(CASE WHEN doc_id % 4 = 0 THEN array_to_string(list_concat(list_concat(ls[1:filled[1]], ['']), ls[filled[2]:]), chr(10)) ELSE text END) AS text FROM f"""
)
def ja_title_break(spark, d):
    """A blank line between a title and an author line that begin a text."""
    kind = F.col("doc_id") % 4
    second = F.when(kind == 0, "著者・A").when(kind == 1, "too long a line for a title line, really").when(kind == 2, "終わり。").otherwise("\nB")
    text = F.concat(F.lit("\nName"), F.col("doc_id").cast("string"), F.lit("\n"), second, F.lit("\n"), F.col("text"))
    return table(spark, d, "documents").select("doc_id", md5(context.title_break(text)).alias("text"))


@query(
    rf"""WITH l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (SELECT doc_id, string_split(text || chr(10) || first || chr(10) || chr(10) || text, chr(10)) AS ls FROM (SELECT doc_id, text, coalesce(regexp_extract(text, '(?s)^\s*([^\n]*)', 1), '') AS first FROM documents))),
o AS (SELECT *, regexp_replace(line, '^[ \t\r　]+|[ \t\r　]+$', '', 'g') AS own FROM l), f AS (SELECT *, first_value(own) OVER (PARTITION BY doc_id ORDER BY own = '', i) AS title FROM o),
k AS (SELECT *, own <> '' AND own = title AS is_title FROM f), s AS (SELECT *, sum(CASE WHEN is_title THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS nth, coalesce(lag(is_title) OVER (PARTITION BY doc_id ORDER BY i), false) AS behind FROM k)
SELECT doc_id, md5(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT (is_title AND nth > 1) AND NOT (own = '' AND behind))) AS text FROM s GROUP BY doc_id"""
)
def repeated_titles(spark, d):
    """Texts whose title line comes again: later ones go, with the blank line behind."""
    docs = table(spark, d, "documents").where("text is not null")
    first = F.regexp_extract("text", r"(?s)^\s*([^\n]*)", 1)
    text = F.concat("text", F.lit("\n"), first, F.lit("\n\n"), "text")
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^[ \t\r　]+|[ \t\r　]+$", "")), lambda x: x != "")
    found = assembly.without_repeated_titles(docs.select("doc_id", text.alias("text"), F.slice(lines, 1, 1).alias("titles")), "doc_id")
    return found.select("doc_id", md5(F.col("text")).alias("text"))


# --- names and labels ------------------------------------------------------------------------------

ODD = "' ' || p_name || ' <' || p_brand || '>:/' || p_type || CASE WHEN p_size % 3 = 0 THEN '. ' ELSE '  -x_' END"


def odd_names(spark, d):
    tail = F.when(F.col("p_size") % 3 == 0, ". ").otherwise("  -x_")
    return table(spark, d, "part").withColumn("odd", F.concat(F.lit(" "), "p_name", F.lit(" <"), "p_brand", F.lit(">:/"), "p_type", tail))


BAD = r'[<>:"/\\|?*]'


@query(
    f"""WITH o AS (SELECT p_partkey, {ODD} AS odd FROM part)
SELECT p_partkey, left(regexp_replace(regexp_replace(trim(odd), '{BAD}', '_', 'g'), '^[ .]+|[ .]+$', '', 'g'), 120) AS folder, left(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(odd), '[/\\\\]', '-', 'g'), '{BAD}', '_', 'g'), '^[ ._\\-]+|[ ._\\-]+$', '', 'g'), '\\s+', '-', 'g'), '-{{2,}}', '-', 'g'), 120) AS sample,
    left(regexp_replace(regexp_replace(odd, '[^0-9A-Za-z._-]+', '_', 'g'), '^[._\\-]+|[._\\-]+$', '', 'g'), 64) AS cache, regexp_replace(regexp_replace(p_partkey || '.v1.x', '[.][^.]*$', ''), '^$', 'book') AS book, left(sha1(odd), 10) AS key FROM o"""
)
def file_names(spark, d):
    """Names for folders, samples and caches, the folder of a book, and the key of a cache."""
    odd = F.col("odd")
    book = F.concat(F.lit("a/b/"), F.col("p_partkey").cast("string"), F.lit(".v1.x"))
    return odd_names(spark, d).select("p_partkey", kana.folder_name(odd).alias("folder"), kana.sample_name(odd).alias("sample"), kana.cache_name(odd).alias("cache"), kana.book_folder(book).alias("book"), kana.cache_key(odd).alias("key"))


@query(
    "SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN p_name ELSE p_name || ' · ' || CASE WHEN p_size % 4 = 1 THEN p_size || '' ELSE p_size || '/50' END END || CASE WHEN p_size % 5 = 0 THEN '' ELSE ' · ' || p_type END AS label, lpad(p_partkey || '', CAST(greatest(3, length(p_partkey || '')) AS INTEGER), '0') || '-' || replace(p_name, ' ', '-') || '.mp3' AS file, "
    "CASE WHEN p_size % 2 = 0 THEN p_partkey END AS id, replace(p_name, ' ', '-') AS name, lpad(p_partkey || '', CAST(greatest(3, length(p_partkey || '')) AS INTEGER), '0') || printf('-spd%.2f-pit%.2f-int%.2f-', p_size / 10, -p_size / 100, p_retailprice) || p_brand || '.wav' AS cached, "
    "substr(sha1(format('{{\"intonation\":{},\"pitch\":{},\"speaker\":{},\"speed\":{},\"text\":\"{}\"}}', '1.25', '-0.5', p_size, '1.0', p_name)), 1, 12) AS sample_key, CASE WHEN p_size % 5 = 0 THEN '' ELSE p_type || chr(10) END || p_brand AS lines FROM part"
)
def sample_labels(spark, d):
    """Progress labels, sample files and what their names say, their keys, and sample texts."""
    size, name = F.col("p_size"), F.col("p_name")
    key = F.col("p_partkey")
    file = labels.sample_file(key, name)
    parts = labels.sample_parts(F.when(size % 2 == 0, file).otherwise(F.concat(F.replace(name, F.lit(" "), F.lit("-")), F.lit(".MP3"))))
    title = F.when(size % 5 != 0, F.concat(F.lit(" "), "p_type", F.lit("　")))
    return table(spark, d, "part").select(
        "p_partkey", labels.progress_label(name, F.when(size % 4 != 0, size), F.when(size % 4 != 1, F.lit(50)), title).alias("label"), file.alias("file"), parts["id"].alias("id"), parts["name"].alias("name"),
        labels.cached_sample_file(key, size / 10, -size / 100, F.col("p_retailprice"), F.col("p_brand")).alias("cached"), kana.sample_key(size, name, F.lit(1.0), F.lit(-0.5), F.lit(1.25)).alias("sample_key"),
        labels.sample_text(F.array(title, F.lit(" "), F.col("p_brand"))).alias("lines"),
    )


@query(rf"WITH {WORDS} SELECT conv_id, turn, token_idx, CASE WHEN regexp_matches(j, '^.*{kana.WIDE_CJK}[\x{{3041}}-\x{{309F}}\x{{30A0}}-\x{{30FF}}]+$') AND regexp_matches(regexp_extract(j, '^(.*?)({kana.KANA}+)$', 1), '{kana.WIDE_CJK}$') THEN regexp_extract(j, '^(.*?)({kana.KANA}+)$', 1) || '(?=' || regexp_extract(j, '^(.*?)({kana.KANA}+)$', 2) || ')' END AS pattern FROM jw")
def lookahead_rules(spark, d):
    """The rule that a selection of ideographs with a kana tail suggests."""
    return j_words(spark, d).select(*KEYS, "token_idx", labels.lookahead(F.col("j"))["pattern"].alias("pattern"))


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'OPS/text/../img/p' || page_id ELSE CASE WHEN page_id % 3 = 1 THEN 'img/p' || page_id ELSE '/abs/p' || page_id END END AS path FROM pages")
def epub_paths(spark, d):
    """Hrefs as seen from a file of a container."""
    kind, name = F.col("page_id") % 3, F.concat(F.lit("p"), F.col("page_id").cast("string"))
    href = F.when(kind == 0, F.concat(F.lit("./../img//"), name)).when(kind == 1, F.concat(F.lit("img/"), name)).otherwise(F.concat(F.lit("/abs/./"), name))
    return table(spark, d, "pages").select("page_id", kana.epub_path(F.when(kind == 0, "OPS/text/a.xhtml").otherwise("a.opf"), href).alias("path"))


@query("SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS seconds, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS iso, CAST(1704412800 - floor(epoch(ts)) AS BIGINT) AS age FROM events")
def event_times(spark, d):
    """Instants as seconds, as ISO text, and how long ago they were."""
    from ..operators import library

    ts, now = F.col("ts").cast("timestamp"), F.lit("2024-01-05 00:00:00").cast("timestamp")
    return table(spark, d, "events").select("event_id", F.unix_timestamp(ts).alias("seconds"), library.iso_utc(ts).alias("iso"), library.age_seconds(now, ts).alias("age"))


# --- evidence --------------------------------------------------------------------------------------

SIGHTINGS = f"""{WORDS}, ob AS (SELECT CAST(conv_id AS BIGINT) * 1000000 + turn * 10000 + token_idx AS pos, substr(j, 1, 2) AS base, substr(j, 3, 2) AS raw, {canonical_sql('substr(j, 3, 2)')} AS reading, substr(j, 5, 2) AS suffix, CASE WHEN token_idx % 3 = 0 THEN substr('一二三四五', token_idx % 5 + 1, 1) ELSE '' END AS prefix FROM jw WHERE length(j) >= 3),
rc AS (SELECT base, reading, count(*) AS n FROM ob GROUP BY ALL), top AS (SELECT base, reading, n FROM rc QUALIFY row_number() OVER (PARTITION BY base ORDER BY n DESC, reading) = 1)"""


def sightings(spark, d):
    rows = j_words(spark, d).where(F.char_length("j") >= 3)
    part = lambda at, n: F.substring("j", at, n)
    prefix = F.when(F.col("token_idx") % 3 == 0, F.expr("substring('一二三四五', cast(token_idx % 5 + 1 as int), 1)")).otherwise("")
    return rows.select(
        (F.col("conv_id").cast("long") * 1000000 + F.col("turn") * 10000 + F.col("token_idx")).alias("pos"), part(1, 2).alias("base"), part(3, 2).alias("raw"), kana.canonical_katakana(part(3, 2)).alias("reading"), part(5, 2).alias("suffix"), prefix.alias("prefix")
    )


@query(
    f"WITH {SIGHTINGS} SELECT base, reading, count(*) AS n, bool_or({matches('raw', '[\\x{3040}-\\x{309F}]')}) AS hiragana, bool_or({matches('raw', '\\p{Latin}')}) AS latin, bool_or(contains(raw, '・')) AS middle_dot, bool_or(contains(raw, 'ー')) AS long_mark FROM ob GROUP BY base, reading"
)
def reading_observations(spark, d):
    """Sightings of readings with what their raw forms hold."""
    return evidence.observed(sightings(spark, d))


@query(
    f"""WITH {SIGHTINGS}, s AS (SELECT base, suffix, pos FROM ob WHERE suffix <> '' QUALIFY row_number() OVER (PARTITION BY base ORDER BY pos, suffix) <= 12), p AS (SELECT base, prefix, pos FROM ob WHERE prefix <> '' QUALIFY row_number() OVER (PARTITION BY base ORDER BY pos, prefix) <= 12),
sa AS (SELECT base, string_agg(suffix, '|' ORDER BY pos, suffix) AS x FROM s GROUP BY base), pa AS (SELECT base, string_agg(prefix, '|' ORDER BY pos, prefix) AS x FROM p GROUP BY base)
SELECT o.base, count(*) AS total, length(o.base) = 1 AND {matches('o.base', kana.WIDE_CJK)} AS single, coalesce(any_value(sa.x), '') AS suffixes, coalesce(any_value(pa.x), '') AS prefixes FROM ob o LEFT JOIN sa ON sa.base = o.base LEFT JOIN pa ON pa.base = o.base GROUP BY o.base"""
)
def reading_samples(spark, d):
    """The first contexts of each base."""
    rows = evidence.accumulated(sightings(spark, d))
    return rows.select("base", "total", "single", F.array_join("suffix_samples", "|").alias("suffixes"), F.array_join("prefix_samples", "|").alias("prefixes"))


def top_sql(column: str, most: int) -> str:
    return f"SELECT base, string_agg(v || ':' || n, '|' ORDER BY n DESC, v) AS x FROM (SELECT base, {column} AS v, count(*) AS n FROM ob WHERE {column} <> '' GROUP BY base, {column} QUALIFY row_number() OVER (PARTITION BY base ORDER BY count(*) DESC, {column}) <= {most}) GROUP BY base"


@query(f"WITH {SIGHTINGS}, s AS ({top_sql('suffix', 8)}), p AS ({top_sql('prefix', 6)}) SELECT top.base, CASE WHEN {folded_sql('reading')} <> reading THEN {folded_sql('reading')} ELSE reading END AS reading, n AS count, coalesce(s.x, '') AS suffixes, coalesce(p.x, '') AS prefixes FROM top LEFT JOIN s USING (base) LEFT JOIN p USING (base)")
def ruby_evidence(spark, d):
    """What is kept of a book's readings: the top reading as the lexicon spells it, the top contexts."""
    rows = sightings(spark, d)
    lexicon = evidence.shares(evidence.reading_counts(rows)).select(F.col("base").alias("surface"), kana.fold_small(F.col("reading")).alias("reading"))
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat(x["value"], F.lit(":"), x["count"].cast("string"))), "|")
    return evidence.serialized(rows, lexicon).select("base", "reading", "count", text("suffixes").alias("suffixes"), text("prefixes").alias("prefixes"))


@query(
    f"""WITH {WORDS}, ob AS (SELECT substr(j, 1, 1) AS base, CASE WHEN token_idx % 3 = 0 THEN substr('一二三四五六七八', (token_idx * token_idx) % 8 + 1, 1 + token_idx % 2) ELSE '' END AS prefix FROM jw WHERE {matches('substr(j, 1, 1)', kana.WIDE_CJK)}),
t AS (SELECT base, count(*) AS total FROM ob WHERE prefix <> '' GROUP BY base), c AS (SELECT base, prefix, count(*) AS n FROM ob WHERE prefix <> '' GROUP BY base, prefix QUALIFY row_number() OVER (PARTITION BY base ORDER BY count(*) DESC, prefix) <= 6)
SELECT base, string_agg(prefix, '|' ORDER BY n DESC, prefix) AS prefixes, CAST(max(length(prefix)) AS BIGINT) AS longest FROM c JOIN t USING (base) WHERE n / total >= 0.1 GROUP BY base"""
)
def context_rules(spark, d):
    """The numbers that stand before one-ideograph bases often enough to be a rule."""
    idx = F.col("token_idx")
    prefix = F.when(idx % 3 == 0, F.expr("substring('一二三四五六七八', cast((token_idx * token_idx) % 8 + 1 as int), cast(1 + token_idx % 2 as int))")).otherwise("")
    rows = j_words(spark, d).select(F.substring("j", 1, 1).alias("base"), prefix.alias("prefix"))
    return evidence.context_rules(rows).select("base", F.array_join("prefixes", "|").alias("prefixes"), "longest")


@query(f"WITH {WORDS}, b AS (SELECT DISTINCT j FROM jw WHERE length(j) > 1 AND {matches('j', kana.NARROW_CJK)}) SELECT DISTINCT substr(j, 1, n) AS prefix FROM (SELECT j, unnest(range(1, length(j))) AS n FROM b)")
def compound_prefixes(spark, d):
    """What compounds with ideographs may begin with."""
    return evidence.compound_prefixes(j_words(spark, d).select(F.col("j").alias("base")))


@query(
    f"""WITH {WORDS}, s AS (SELECT conv_id, turn, j AS base, w AS reading, token_idx * 2 + (CASE WHEN token_idx % 3 = 0 THEN 1 ELSE 0 END) AS start, token_idx * 2 + 2 AS "end" FROM (SELECT conv_id, turn, token_idx, left(j, 1 + CAST(token_idx % 5 = 4 AS INTEGER)) AS j, left(w, 1) AS w FROM jw)),
r AS (SELECT *, sum(CASE WHEN p = start AND pl = 1 AND length(base) = 1 THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id, turn ORDER BY start) AS run FROM (SELECT *, lag("end") OVER o AS p, length(lag(base) OVER o) AS pl FROM s WINDOW o AS (PARTITION BY conv_id, turn ORDER BY start)))
SELECT conv_id, turn, min(start) AS start, count(*) AS n, string_agg(base, '' ORDER BY start) AS base, string_agg(reading, '' ORDER BY start) AS reading FROM r WHERE length(base) = 1 GROUP BY conv_id, turn, run HAVING count(*) > 1"""
)
def ja_ruby_compound(spark, d):
    """Neighbouring one-character spans with nothing between them, as compounds."""
    idx = F.col("token_idx")
    rows = j_words(spark, d).select(*KEYS, F.expr("left(j, 1 + cast(token_idx % 5 = 4 as int))").alias("base"), F.substring("w", 1, 1).alias("reading"), (idx * 2 + (idx % 3 == 0).cast("int")).alias("start"), (idx * 2 + 2).alias("end"))
    return evidence.touching(rows, *KEYS)


# --- dictionaries ----------------------------------------------------------------------------------

LEXICON = {"漢字": "カンジ", "漢": "カン", "東京": "トウキョウ", "雨": "アメ", "明日": "アシタ", "日": "ニチ", "温": "オン"}
LEX = "|".join(sorted(LEXICON, key=lambda k: (-len(k), k)))
LEX_CASE = "CASE s " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LEXICON.items()) + " END"
LEX_WORDS = f"""{JTEXT}, lx AS (SELECT conv_id, turn, string_split_regex(j, '{LEX}') AS g, regexp_extract_all(j, '{LEX}') AS x FROM jt),
lp AS (SELECT conv_id, turn, list_filter(flatten(list_transform(range(1, len(g) + 1), lambda i: [{{'s': g[i], 'm': false}}, {{'s': coalesce(x[i], ''), 'm': true}}])), lambda p: p.s <> '') AS ps FROM lx),
lw AS (SELECT conv_id, turn, CAST(i - 1 AS BIGINT) AS idx, p.s AS s, CASE WHEN p.m THEN {LEX_CASE.replace('CASE s', 'CASE p.s')} END AS reading FROM (SELECT conv_id, turn, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM lp)),
lo AS (SELECT *, CAST(sum(length(s)) OVER (PARTITION BY conv_id, turn ORDER BY idx ROWS UNBOUNDED PRECEDING) - length(s) AS BIGINT) AS start, {canonical_sql("CASE WHEN regexp_matches(s, '" + kana.NARROW_CJK + "') THEN coalesce(reading, s) ELSE s END")} AS said FROM lw)"""


def j_docs(spark, d):
    return j_texts(spark, d).withColumnRenamed("j", "text")


@query(f'WITH {LEX_WORDS} SELECT conv_id, turn, idx, start, start + length(s) AS "end", s AS surface, reading FROM lo')
def lexicon_words(spark, d):
    """Texts cut by a lexicon, with the runs between its words."""
    return tiers.lexicon_tokens(j_docs(spark, d), LEXICON, *KEYS)


@query(f"WITH {LEX_WORDS} SELECT conv_id, turn, md5(string_agg(said, '' ORDER BY idx)) AS reading FROM lo GROUP BY ALL")
def lexicon_readings(spark, d):
    """Texts as they are read with a lexicon."""
    return j_docs(spark, d).select(*KEYS, md5(tiers.reading_text(tiers.word_finder(LEXICON)("text"))).alias("reading"))


@query(
    f"""WITH {LEX_WORDS}, e AS (SELECT *, CAST(sum(length(said)) OVER (PARTITION BY conv_id, turn ORDER BY idx ROWS UNBOUNDED PRECEDING) AS BIGINT) AS "end" FROM lo) SELECT conv_id, turn, idx, s AS surface, said AS reading, "end" - length(said) AS start, "end" FROM e WHERE reading IS NOT NULL AND {matches('s', kana.NARROW_CJK)}"""
)
def lexicon_pitch_tokens(spark, d):
    """The words with ideographs, by where they are in the text as it is read."""
    return tiers.pitch_tokens(j_docs(spark, d), LEXICON, *KEYS)


JA_GUARDED = {"日": "ヒ", "東京": "トウキョウ", "雨": "アメ", "お": "オ", "12": "ジュウニ", "7日": "ナノカ"}
NUMBERED = "nj AS (SELECT conv_id, turn, translate(lower(text), 'abcdefghijklmnopqrstuvwxyz .,', 'あいうえおかきッャヵァ・ー漢字東京雨明日語々〆ヶン温127') AS j FROM conversations)"


@query(f"WITH {NUMBERED}, " + guarded_sql("nj", "conv_id, turn", "j", JA_GUARDED).removeprefix("WITH "))
def ja_numeric_guard(spark, d):
    """Dictionary words put into kana where they cut no number and no word."""
    text = F.translate(F.lower("text"), LETTERS + " .,", JAPANESE + "127")
    words = spark.createDataFrame([*JA_GUARDED.items()], "key string, reading string")
    return dictionary.replaced(conversations(spark, d).where("text is not null").withColumn("text", text), words, *KEYS).select(*KEYS, md5(F.col("replaced")).alias("replaced"))


ANNOTATED = f"""{WORDS}, tk AS (SELECT conv_id, turn, token_idx, left(j, 1) AS surface, {canonical_sql("substr(j, 2, 1)")} AS reading, CASE token_idx % 3 WHEN 0 THEN 'UniDic' WHEN 1 THEN 'unidic-gap' ELSE 'ruby' END AS reading_source FROM jw WHERE length(j) >= 2)"""


def annotated(spark, d):
    source = F.element_at(F.array(F.lit("UniDic"), F.lit("unidic-gap"), F.lit("ruby")), (F.col("token_idx") % 3 + 1).cast("int"))
    return j_words(spark, d).where(F.char_length("j") >= 2).select(*KEYS, "token_idx", F.substring("j", 1, 1).alias("surface"), kana.canonical_katakana(F.substring("j", 2, 1)).alias("reading"), source.alias("reading_source"))


@query(
    f"""WITH {ANNOTATED}, a AS (SELECT conv_id, turn, surface, count(DISTINCT CASE WHEN starts_with(lower(reading_source), 'unidic') THEN {folded_sql('reading')} END) > 1 AS several, count(DISTINCT {folded_sql('reading')}) > 1 AS conflict FROM tk GROUP BY ALL)
SELECT tk.conv_id, tk.turn, token_idx, several AND starts_with(lower(reading_source), 'unidic') AS ambiguous, conflict FROM tk JOIN a USING (conv_id, turn, surface)"""
)
def ja_ambiguity_flags(spark, d):
    """Surfaces with several readings: among dictionary words, and among all."""
    rows = tokens.flag_ambiguous(annotated(spark, d), *KEYS, source="unidic").withColumnRenamed("block", "ambiguous")
    return tokens.flag_ambiguous(rows, *KEYS).select(*KEYS, "token_idx", "ambiguous", F.col("block").alias("conflict"))


ACCENTS = [("漢", "カ", 1, "名詞"), ("東", "ヒ", 0, "名詞"), ("雨", "ー", 2, "動詞"), ("日", "ニ", None, None), ("あ", "ッ", 3, "名詞"), ("明", "イ", 1, None), ("明", "ン", 2, None)]
ACCENT_ROWS = ", ".join("(" + ", ".join("NULL" if x is None else str(x) if isinstance(x, int) else f"'{x}'" for x in row) + ")" for row in ACCENTS)


@query(
    f"""WITH {ANNOTATED}, lexi(surface, lr, accent, pos) AS (VALUES {ACCENT_ROWS}), k AS (SELECT surface, any_value(lr) AS lr, any_value(accent) AS accent, any_value(pos) AS pos FROM lexi WHERE accent IS NOT NULL GROUP BY surface HAVING count(*) = 1),
x AS (SELECT tk.*, lower(reading_source) = 'unidic' AS own, coalesce(lr = reading, false) AND lower(reading_source) <> 'unidic' AS same, k.accent, k.pos FROM tk LEFT JOIN k USING (surface))
SELECT conv_id, turn, token_idx, CAST(CASE WHEN same THEN accent END AS BIGINT) AS accent, CASE WHEN same THEN pos END AS pos, same OR own AS validated FROM x"""
)
def lexicon_accents(spark, d):
    """Accents and parts of speech from the lexicon, where it has one word with the token's reading."""
    rows = annotated(spark, d).withColumn("fallback_reading", F.col("reading")).withColumn("accent", F.lit(None).cast("long")).withColumn("pos", F.lit(None).cast("string"))
    return tiers.with_accents(rows, spark.createDataFrame(ACCENTS, "surface string, reading string, accent long, pos string")).select(*KEYS, "token_idx", "accent", "pos", "validated")


@query(
    f"""WITH {ANNOTATED}, e(surface, kana, accent) AS (VALUES ('漢', 'カ', 1), ('東', 'ヒ', 2), ('雨', 'ー', 3), ('雨', 'ア', 4), ('明', 'オ', 5), ('字', 'イ', 6))
SELECT conv_id, turn, token_idx, CAST(CASE WHEN token_idx % 4 = 0 THEN 9 ELSE e.accent END AS BIGINT) AS accent FROM tk LEFT JOIN e ON lower(reading_source) = 'unidic' AND {matches('tk.surface', kana.KANJI)} AND token_idx % 4 <> 0 AND e.surface = tk.surface AND e.kana = nullif(regexp_replace(tk.reading, '[^\\x{{30A1}}-\\x{{30FF}}]|・', '', 'g'), '')"""
)
def engine_accents(spark, d):
    """Accents that an engine's table fills in for dictionary words with kanji."""
    rows = annotated(spark, d).withColumn("accent", F.when(F.col("token_idx") % 4 == 0, F.lit(9)).cast("long"))
    engine = spark.createDataFrame([("漢", "カ", 1), ("東", "ヒ", 2), ("雨", "ー", 3), ("雨", "ア", 4), ("明", "オ", 5), ("字", "イ", 6)], "surface string, kana string, accent long")
    return tiers.with_engine_accents(rows, engine).select(*KEYS, "token_idx", "accent")


@query(
    f"""WITH {WORDS}, p AS (SELECT *, {SMALL_A} AS a FROM jw), k AS (SELECT j AS surface, min({SMALL_B}) AS lr FROM jw GROUP BY j) SELECT conv_id, turn, token_idx, CASE WHEN a <> lr AND {folded_sql('a')} = {folded_sql('lr')} THEN lr ELSE a END AS reading FROM p JOIN k ON k.surface = p.j"""
)
def small_kana_harmony(spark, d):
    """Readings that differ from the lexicon's in small kana only take the lexicon's."""
    a, b = (F.translate(F.lower("w"), "aeioubcdfg", to) for to in ("ァィゥェォカキクケコ", "アィウェオカキクケコ"))
    rows = j_words(spark, d)
    lexicon = rows.select(F.col("j").alias("surface"), b.alias("reading"))
    return tiers.harmonized(rows.select(*KEYS, "token_idx", F.col("j").alias("surface"), a.alias("reading")), lexicon).select(*KEYS, "token_idx", "reading")


@query(
    f"""WITH {WORDS}, c AS (SELECT conv_id, turn, 1 AS tier, token_idx * 10 AS start, token_idx * 10 + 4 AS "end" FROM jw WHERE token_idx % 2 = 0 UNION ALL SELECT conv_id, turn, 3, token_idx * 7, token_idx * 7 + 3 FROM jw)
SELECT conv_id, turn, tier, start, "end" FROM c WHERE tier = 1 OR NOT EXISTS (SELECT 1 FROM c t WHERE t.tier = 1 AND t.conv_id = c.conv_id AND t.turn = c.turn AND t.start < c."end" AND c.start < t."end")"""
)
def ja_tier_precedence(spark, d):
    """Spans of a later tier only where an earlier one has left room."""
    rows, idx = j_words(spark, d), F.col("token_idx")
    span = lambda df, tier, width, size: df.select(*KEYS, F.lit(tier).alias("tier"), (idx * width).alias("start"), (idx * width + size).alias("end"), F.col("j").alias("surface"))
    return tiers.select_free(span(rows.where(idx % 2 == 0), 1, 10, 4).unionByName(span(rows, 3, 7, 3)), *KEYS).select(*KEYS, "tier", "start", "end")


def rendered_sql(partial: bool) -> str:
    said = f"CASE WHEN {partial} AND reading IS NOT NULL AND idx % 2 = 0 THEN s ELSE coalesce(reading, s) END"
    return f"WITH {LEX_WORDS} SELECT conv_id, turn, md5(string_agg({said}, '' ORDER BY idx)) AS rendered FROM lo GROUP BY ALL"


def rendered_texts(spark, d, partial):
    docs = j_docs(spark, d)
    found = tiers.lexicon_tokens(docs, LEXICON, *KEYS).where("reading is not null").withColumn("keep", F.col("idx") % 2 == 0)
    return tiers.render(docs, found, *KEYS, partial=partial).select(*KEYS, md5(F.col("rendered")).alias("rendered"))


@query(rendered_sql(False))
def ja_render_full(spark, d):
    """Texts with every token's reading in its place."""
    return rendered_texts(spark, d, False)


@query(rendered_sql(True))
def ja_render_partial(spark, d):
    """Texts in which tokens that may keep their surface keep it."""
    return rendered_texts(spark, d, True)


# --- alignment and assembly ------------------------------------------------------------------------

RUNS = """lr0 AS (SELECT conv_id, turn, text, regexp_extract_all(text, '[^A-Za-z]*[A-Za-z]+') AS ps FROM conversations),
cw AS (SELECT conv_id, turn, text, CAST(i - 1 AS BIGINT) AS token_idx, w, CAST(e - length(w) AS BIGINT) AS start, CAST(e AS BIGINT) AS "end"
    FROM (SELECT conv_id, turn, text, i, regexp_extract(p, '[A-Za-z]+$') AS w, sum(length(p)) OVER (PARTITION BY conv_id, turn ORDER BY i ROWS UNBOUNDED PRECEDING) AS e FROM (SELECT conv_id, turn, text, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM lr0)))"""


def letter_runs():
    """The runs of ASCII letters of a text, with their offsets."""
    return tokens.letter_runs


def runs(spark, d):
    rows = conversations(spark, d).select(*KEYS, "text", F.posexplode(letter_runs()("text")).alias("token_idx", "w"))
    return rows.select(*KEYS, "text", long("token_idx"), F.col("w.word").alias("w"), "w.start", "w.end")


@query(f"WITH {RUNS}, n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, w ORDER BY token_idx) AS k FROM cw) SELECT conv_id, turn, token_idx, CAST(list_sum(list_transform(string_split(text, w)[1:k], lambda x: length(x))) + (k - 1) * length(w) AS BIGINT) AS start FROM n")
def occurrence_alignment(spark, d):
    """The k-th token of a surface at the k-th place where the text has it."""
    found = letter_runs()("text")
    rows = conversations(spark, d).select(*KEYS, F.posexplode(alignment.occurrence_offsets("text", F.transform(found, lambda w: F.concat(w["word"], F.lit(" "))))).alias("token_idx", "start"))
    return rows.select(*KEYS, long("token_idx"), "start")


@query(
    f"""WITH {RUNS}, h AS (SELECT *, least(start + 5, length(text)) AS hint, greatest(length(w), 16) AS around FROM cw), x AS (SELECT *, greatest(0, hint - around) AS low, hint + around + length(w) AS high FROM h)
SELECT conv_id, turn, token_idx, CAST(CASE WHEN substr(text, hint + 1, length(w)) = w THEN hint ELSE low + instr(substr(text, low + 1, high - low), w) - 1 END AS BIGINT) AS start FROM x"""
)
def hint_alignment(spark, d):
    """Readings near where they are said to stand."""
    found = letter_runs()("text")
    rows = conversations(spark, d).select(*KEYS, F.posexplode(alignment.hint_offsets("text", F.transform(found, lambda w: w["word"]), F.transform(found, lambda w: w["start"] + 5))).alias("token_idx", "start"))
    return rows.select(*KEYS, long("token_idx"), "start")


@query(f"WITH {RUNS} SELECT conv_id, turn, token_idx, start AS original FROM cw")
def offset_mapping(spark, d):
    """Offsets in a text that has something before it and behind it, put back into the text it was made from."""
    found = letter_runs()("text")
    target = F.concat(F.lit("≪≫≪"), "text", F.lit("≫"))
    rows = conversations(spark, d).select(*KEYS, F.posexplode(alignment.mapped_offsets("text", target, F.transform(found, lambda w: w["start"] + 3))).alias("token_idx", "original"))
    return rows.select(*KEYS, long("token_idx"), "original")


DOTS = r"regexp_replace({}, '\.{{3,}}|…{{2,}}', '…', 'g')"


@query(
    f"""WITH d AS (SELECT conv_id, turn, replace(replace(text, '.', '....…'), ',', '……') AS text FROM conversations), ps AS (SELECT conv_id, turn, text, regexp_extract_all(text, '[^A-Za-z]*[A-Za-z]+') AS ps FROM d),
w AS (SELECT conv_id, turn, text, CAST(i - 1 AS BIGINT) AS token_idx, CAST(sum(length(p)) OVER (PARTITION BY conv_id, turn ORDER BY i ROWS UNBOUNDED PRECEDING) - length(regexp_extract(p, '[A-Za-z]+$')) AS BIGINT) AS start FROM (SELECT conv_id, turn, text, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM ps))
SELECT conv_id, turn, md5({DOTS.format('text')}) AS text, token_idx, CAST(length({DOTS.format('left(text, start)')}) AS BIGINT) AS start FROM w"""
)
def ellipsis_offsets(spark, d):
    """Runs of dots made one ellipsis, and where words then begin."""
    text = F.replace(F.replace("text", F.lit("."), F.lit("....…")), F.lit(","), F.lit("……"))
    rows = conversations(spark, d).select(*KEYS, text.alias("text"))
    rows = rows.select(*KEYS, assembly.ellipsis_offsets("text", F.transform(letter_runs()("text"), lambda w: w["start"])).alias("e"))
    rows = rows.select(*KEYS, md5(F.col("e.text")).alias("text"), F.posexplode("e.offsets").alias("token_idx", "start"))
    return rows.select(*KEYS, "text", long("token_idx"), "start")


@query(f"WITH {RUNS} SELECT conv_id, turn, token_idx, start - (length(text) - length(regexp_replace(text, '^[\\r\\n]+', ''))) AS start, md5(regexp_replace(text, '^[\\r\\n]+|[\\r\\n]+$', '', 'g')) AS text FROM cw")
def trimmed_offsets(spark, d):
    """Texts without line ends around them, and where words then begin."""
    text = F.concat(F.lit("\n\r\n"), "text", F.lit("\n"))
    rows = runs(spark, d).withColumn("x", assembly.trimmed_text(text))
    return rows.select(*KEYS, "token_idx", assembly.rebased(F.col("start") + 3, F.col("x.left"), F.char_length("x.text")).alias("start"), md5(F.col("x.text")).alias("text"))


PARTS = r"""pt AS (SELECT conv_id, turn, regexp_replace(text, '^[\r\n]+|[\r\n]+$', '', 'g') AS part FROM conversations WHERE regexp_matches(text, '\S'))"""


def fragments(spark, d):
    return assembly.combined(conversations(spark, d).withColumn("text", F.concat(F.lit("\n"), "text", F.lit("\r\n"))), "conv_id", "turn")


@query(f"WITH {PARTS} SELECT conv_id, turn, CAST(coalesce(sum(length(part) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM pt")
def combined_offsets(spark, d):
    """Where the turns of a conversation begin in its text."""
    return fragments(spark, d).select("conv_id", "turn", "start")


@query(f"WITH {PARTS} SELECT conv_id, md5(string_agg(part, chr(10) || chr(10) ORDER BY turn)) AS text FROM pt GROUP BY conv_id")
def combined_texts(spark, d):
    """Conversations as one text."""
    return assembly.joined(fragments(spark, d), "conv_id", "turn").select("conv_id", md5(F.col("text")).alias("text"))


POINTS = f"""{RUNS}, pn AS (SELECT conv_id, turn, text, token_idx, start, length(chr(10) || '[[CHAPTER:' || token_idx || ']]' || chr(10)) AS size, coalesce(lead(start) OVER o, length(text)) AS until, lead(start) OVER o IS NULL AS last FROM cw WHERE token_idx % 10 = 5 WINDOW o AS (PARTITION BY conv_id, turn ORDER BY token_idx)),
sg AS (SELECT conv_id, turn, token_idx AS "order", chr(10) || substr(text, start + 1, until - start) || CASE WHEN last THEN '' ELSE chr(10) END AS text, CAST(start + sum(size) OVER (PARTITION BY conv_id, turn ORDER BY token_idx ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS start FROM pn)"""


def marked_segments(spark, d):
    points = F.filter(F.transform(letter_runs()("text"), lambda w, i: F.struct(w["start"].alias("at"), i.cast("long").alias("order"))), lambda p: p["order"] % 10 == 5)
    rows = conversations(spark, d).select(*KEYS, assembly.marked(F.col("text"), points).alias("text"))
    return assembly.segments(rows, *KEYS)


@query(f'WITH {POINTS} SELECT conv_id, turn, "order", start, start + length(text) AS "end", md5(text) AS text FROM sg')
def marker_segments(spark, d):
    """Texts taken apart at the markers that were put into them."""
    return marked_segments(spark, d).where(F.col("order").isNotNull()).select(*KEYS, "order", "start", "end", md5(F.col("text")).alias("text"))


@query(f"WITH {POINTS} SELECT conv_id, turn, \"order\", CASE WHEN \"order\" % 20 = 5 THEN md5(text) ELSE md5('') END AS original FROM sg")
def segment_pairs(spark, d):
    """Segments beside those of the original text with the same marker; empty where there is none."""
    rows = marked_segments(spark, d).where(F.col("order").isNotNull())
    return assembly.paired(rows, rows.where(F.col("order") % 20 == 5), *KEYS).select(*KEYS, "order", md5(F.col("original")).alias("original"))


@query(
    f"""WITH {RUNS}, sp AS (SELECT conv_id, turn, token_idx AS "order", start, "end" + 20 AS "end" FROM cw WHERE token_idx % 7 = 0) SELECT cw.conv_id, cw.turn, "order", w AS base, greatest(cw.start, sp.start) - sp.start AS s_start, least(cw."end", sp."end") - sp.start AS s_end FROM sp JOIN cw ON sp.conv_id = cw.conv_id AND sp.turn = cw.turn AND cw.start < sp."end" AND sp.start < cw."end" """
)
def sliced_spans(spark, d):
    """Spans cut to the parts of a text that they touch."""
    rows = runs(spark, d)
    parts = rows.where("token_idx % 7 = 0").select(*KEYS, F.col("token_idx").alias("order"), "start", (F.col("end") + 20).alias("end"))
    return assembly.sliced(parts, rows.select(*KEYS, "start", "end", F.col("w").alias("base"), F.upper("w").alias("reading")), *KEYS).drop("reading")


@query(
    f"""WITH {RUNS}, s AS (SELECT conv_id, turn, token_idx, greatest(0, start - 2) AS start, least(length(text), "end" + 3) AS "end", length(text) AS size FROM cw),
c AS (SELECT *, coalesce(max("end") OVER (PARTITION BY conv_id, turn ORDER BY start, token_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cursor FROM s),
z AS (SELECT t.conv_id, t.turn, coalesce(max(c."end"), 0) AS start, length(any_value(t.text)) AS "end" FROM conversations t LEFT JOIN c ON c.conv_id = t.conv_id AND c.turn = t.turn GROUP BY t.conv_id, t.turn)
SELECT conv_id, turn, greatest(start, cursor) AS start, "end", token_idx FROM c WHERE "end" > greatest(start, cursor) UNION ALL SELECT conv_id, turn, cursor, start, NULL FROM c WHERE start > cursor UNION ALL SELECT conv_id, turn, start, "end", NULL FROM z WHERE "end" > start"""
)
def view_segments(spark, d):
    """Texts as tokens and what is between them; a token shows what earlier ones have not."""
    rows = runs(spark, d).select(*KEYS, "token_idx", (F.col("start") - 2).alias("start"), (F.col("end") + 3).alias("end"))
    return assembly.view_segments(rows, conversations(spark, d), *KEYS)


@query(f"""WITH {RUNS} SELECT conv_id, turn, k AS selection, string_agg(w, '' ORDER BY start) AS surface FROM cw, range(3) r(k) WHERE start < k * 50 + 40 AND "end" > k * 50 + 10 GROUP BY ALL""")
def selected_surfaces(spark, d):
    """The surfaces that selections touch."""
    rows = runs(spark, d)
    picks = conversations(spark, d).select(*KEYS, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("selection"))
    picks = picks.select(*KEYS, "selection", (F.col("selection") * 50 + 10).alias("start"), (F.col("selection") * 50 + 40).alias("end"))
    return assembly.selected_surface(rows.select(*KEYS, "start", "end", F.col("w").alias("surface")), picks, *KEYS)
