"""Queries of whole chapters: dictionaries from evidence, tokens in tiers, rendered texts, accents of phrases."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import kana
from ..operators import chunks, evidence, tiered, tokens
from ..sources import markup
from .catalogue import md5, query
from .text_queries import JAPANESE, JTEXT, KEYS, LETTERS, RUNS, SPLIT, WORDS, canonical_sql, conversations, folded_sql, j_texts, j_words, katakana_sql, matches, runs


@query(f"WITH {WORDS} SELECT conv_id, turn, token_idx, {katakana_sql('j')} AS katakana FROM jw")
def ja_hira_to_kata(spark, d):
    return j_words(spark, d).select(*KEYS, "token_idx", kana.to_katakana(F.col("j")).alias("katakana"))


@query(f"WITH {WORDS} SELECT conv_id, turn, token_idx, {folded_sql('j')} AS folded FROM jw")
def ja_small_kana_fold(spark, d):
    return j_words(spark, d).select(*KEYS, "token_idx", kana.fold_small(F.col("j")).alias("folded"))


@query(f"WITH {JTEXT} SELECT conv_id, turn, regexp_replace(regexp_replace(replace(replace(j, '.', '....'), ',', '…'), '\\.{{3,}}', '…', 'g'), '…{{2,}}', '…', 'g') AS text FROM jt")
def ja_ellipsis(spark, d):
    text = F.replace(F.replace("j", F.lit("."), F.lit("....")), F.lit(","), F.lit("…"))
    return j_texts(spark, d).select(*KEYS, kana.ellipsis(text).alias("text"))


BASES = f"""{WORDS}, ob AS (SELECT CASE WHEN token_idx % 7 = 0 THEN w ELSE left(j, 1 + CAST(token_idx % 3 AS INTEGER)) END AS base, {canonical_sql("substr(j, 2, 4)")} AS reading FROM jw WHERE length(j) >= 3),
c AS (SELECT base, reading, count(*) AS n FROM ob GROUP BY ALL), r AS (SELECT *, row_number() OVER o AS rank, sum(n) OVER (PARTITION BY base) AS total, lead(n) OVER o AS next_n FROM c WINDOW o AS (PARTITION BY base ORDER BY n DESC, reading)),
sh AS (SELECT base, reading, n / total AS share, total, coalesce(next_n, 0) / total AS alt_share FROM r WHERE rank = 1), v AS (SELECT base, CASE WHEN length(base) = 3 THEN min(reading) ELSE {folded_sql('min(reading)')} END AS variant FROM c GROUP BY base HAVING count(*) > 1)"""


@query(
    f"""WITH {BASES} SELECT base, reading, CASE WHEN length(trim(base)) = 1 AND {matches('base', kana.WIDE_CJK)} THEN 'skip_single' WHEN regexp_matches(base, '^[A-Za-z0-9\\-_''’・]*[A-Za-z][A-Za-z0-9\\-_''’・]*$') THEN 'accept_ascii'
    WHEN {matches('reading', '[A-Za-zＡ-Ｚａ-ｚ・]')} OR (NOT {matches('reading', '[\\x{3041}-\\x{3096}]')} AND contains(reading, 'ー') AND length(reading) >= 4) THEN 'skip_translation' WHEN alt_share >= 0.3 THEN 'skip_contested' WHEN coalesce(variant = reading, false) THEN 'accept_variant'
    WHEN coalesce(variant <> reading AND {folded_sql('variant')} = {folded_sql('reading')}, false) THEN 'align_small' WHEN share >= 0.9 AND length(base) BETWEEN 2 AND 4 AND {matches('base', '^' + kana.WIDE_CJK + '+$')} AND contains(reading, 'ー') THEN 'accept_name' WHEN total >= 3 AND share >= 0.95 THEN 'accept_sure' ELSE 'undecided' END AS decision FROM sh LEFT JOIN v USING (base)"""
)
def ja_arbitration(spark, d):
    """The decision on each base's reading, with all its rules."""
    idx, rows = F.col("token_idx"), j_words(spark, d).where(F.char_length("j") >= 3)
    base = F.when(idx % 7 == 0, F.col("w")).otherwise(F.expr("left(j, 1 + cast(token_idx % 3 as int))"))
    counts = evidence.reading_counts(rows.select(base.alias("base"), kana.canonical_katakana(F.substring("j", 2, 4)).alias("reading")))
    least = counts.groupBy("base").agg(F.min("reading").alias("x"), F.count(F.lit(1)).alias("k")).where("k > 1")
    variants = least.select("base", F.array(F.when(F.char_length("base") == 3, F.col("x")).otherwise(kana.fold_small(F.col("x")))).alias("variants"))
    b, r = F.col("base"), F.col("reading")
    found = evidence.arbitrated(
        counts, variants, is_single=kana.is_single_kanji(b), is_ascii=kana.is_ascii_word(b), is_translation=kana.looks_translated(r), is_name=kana.is_name_candidate(b, r), aligned=kana.aligned_variant(r, F.col("variants"))
    )
    return found.select("base", "reading", "decision")


@query(
    f"""WITH {RUNS}, ph AS (SELECT conv_id, turn, token_idx, length(w) AS n, sum(length(w)) OVER (PARTITION BY conv_id, turn ORDER BY token_idx ROWS UNBOUNDED PRECEDING) AS "end" FROM cw),
tk AS (SELECT conv_id, turn, "end" - n + 1 AS s, "end" - n + 4 AS e, CASE WHEN token_idx % 5 > 0 THEN token_idx % 4 END AS accent, token_idx % 2 = 0 AS content FROM ph WHERE token_idx % 3 = 0),
x AS (SELECT ph.conv_id, ph.turn, ph.token_idx, coalesce(arg_min(accent, s) FILTER (WHERE content), arg_min(accent, s)) AS accent FROM ph JOIN tk ON tk.conv_id = ph.conv_id AND tk.turn = ph.turn AND tk.s < ph."end" AND ph."end" - ph.n < tk.e WHERE accent IS NOT NULL GROUP BY ALL)
SELECT ph.conv_id, ph.turn, ph.token_idx AS phrase_idx, CAST(CASE WHEN x.accent IS NULL THEN 9 WHEN x.accent <= 0 THEN n ELSE greatest(1, least(x.accent, n)) END AS BIGINT) AS new_accent FROM ph LEFT JOIN x ON x.conv_id = ph.conv_id AND x.turn = ph.turn AND x.token_idx = ph.token_idx"""
)
def ja_accent_phrases(spark, d):
    """The accents that fall on phrases, by the tokens that they overlap."""
    from pyspark.sql import Window

    rows = runs(spark, d).withColumn("until", F.sum(F.char_length("w")).over(Window.partitionBy(*KEYS).orderBy("token_idx")))
    phrases = rows.select(*KEYS, F.col("token_idx").alias("phrase_idx"), F.filter(F.split("w", ""), lambda x: x != "").alias("moras"), F.lit(9).cast("long").alias("accent"))
    at, idx = F.col("until") - F.char_length("w"), F.col("token_idx")
    found = rows.where(idx % 3 == 0).select(*KEYS, (at + 1).alias("start"), (at + 4).alias("end"), F.when(idx % 5 > 0, idx % 4).alias("accent"), F.when(idx % 2 == 0, "名詞").otherwise("助詞").alias("pos"))
    return chunks.phrase_accents(phrases, found, *KEYS).withColumn("new_accent", F.col("new_accent").cast("long"))


# --- chapters --------------------------------------------------------------------------------------

#: One text, its ruby, and its dictionaries in SQL: every fourth word has its first two letters in ruby; a book's own
#: dictionary, the common one and the lexicon are what words of certain places begin with. In `mt` a row is a place where
#: the longest key of a tier stands, in `sc` what a scan takes of them.
CHAPTERS = rf"""RECURSIVE {WORDS},
cw AS (SELECT conv_id, turn, i - 1 AS n, translate(lower(w), '{{LETTERS}}.,', '{{JAPANESE}}12') AS w FROM (SELECT conv_id, turn, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT conv_id, turn, {SPLIT.replace('text', "regexp_replace(text, '[<>&]', '', 'g')")} AS ws FROM conversations))),
tx AS MATERIALIZED (SELECT row_number() OVER () AS k, conv_id, turn, string_agg(w, ' ' ORDER BY n) AS t FROM cw GROUP BY conv_id, turn),
sp AS (SELECT conv_id, turn, n, w, CAST(sum(length(w) + 1) OVER (PARTITION BY conv_id, turn ORDER BY n) - length(w) - 1 AS BIGINT) AS o FROM cw),
rs AS MATERIALIZED (SELECT k, o, w, n FROM sp JOIN tx USING (conv_id, turn) WHERE n % 4 = 0 AND length(w) > 2),
dc AS MATERIALIZED (SELECT key, tier, min(reading) AS reading, CASE tier WHEN 1 THEN 'propagation' ELSE 'corpus' END AS source FROM (SELECT left(j, 1 + CAST(token_idx % 3 AS INTEGER)) AS key, CASE WHEN token_idx % 2 = 0 THEN 1 ELSE 2 END AS tier, {canonical_sql("substr(j, 2, 3)")} AS reading FROM jw WHERE conv_id % 3 = 0 AND length(j) > 3) GROUP BY key, tier),
lx AS MATERIALIZED (SELECT left(j, 1 + CAST(token_idx % 2 AS INTEGER)) AS surface, {canonical_sql("substr(j, 2, 2)")} AS reading, CASE WHEN conv_id % 5 < 4 THEN conv_id % 5 END AS accent FROM jw WHERE conv_id % 4 = 1 AND length(j) > 2 AND {matches('j', '^' + kana.NARROW_CJK)}),
lr AS MATERIALIZED (SELECT surface, min(reading) AS reading FROM lx GROUP BY surface),
rl(base, prefix) AS (VALUES ('日', '1'), ('字', '2'), ('漢', '12')),
ks AS MATERIALIZED (SELECT key, tier, reading, source FROM dc UNION ALL SELECT surface, 3, reading, 'unidic' FROM lr),
pl AS MATERIALIZED (SELECT k, t, o, n, substr(t, CAST(o + 1 AS BIGINT), n) AS w FROM (SELECT k, t, unnest(range(0, length(t))) AS o FROM tx) CROSS JOIN (SELECT DISTINCT length(key) AS n FROM ks)),
mt AS MATERIALIZED (SELECT k, t, tier, o, n, reading, source, key, substr(t, CAST(o AS BIGINT), 1) AS bf, substr(t, CAST(o + n + 1 AS BIGINT), 1) AS af FROM pl JOIN ks ON key = w WHERE length(w) = n),
lm AS MATERIALIZED (SELECT k, tier, o, max(n) AS n FROM mt GROUP BY k, tier, o),
nx AS MATERIALIZED (SELECT a.k, a.tier, a.o, b.o AS nxt FROM lm a ASOF JOIN lm b ON a.k = b.k AND a.tier = b.tier AND a.o + a.n <= b.o),
sc AS (SELECT k, tier, min(o) AS o FROM lm GROUP BY k, tier UNION ALL SELECT k, tier, nxt FROM sc JOIN nx USING (k, tier, o)),
ok AS (SELECT sc.k, sc.tier, sc.o AS s, sc.o + mt.n AS e, reading, source, key, bf, af, t FROM sc JOIN lm USING (k, tier, o) JOIN mt ON mt.k = sc.k AND mt.tier = sc.tier AND mt.o = sc.o AND mt.n = lm.n),
al AS (SELECT k, tier, s, e, reading, reading AS fb, source FROM ok LEFT JOIN rl ON base = key AND tier < 3
    WHERE CASE WHEN tier = 3 THEN {matches('key', kana.NARROW_CJK)} AND reading <> '' ELSE reading <> '' AND NOT (regexp_matches(left(key, 1), '^\p{{Nd}}$') AND regexp_matches(bf, '^\p{{Nd}}$')) AND NOT (regexp_matches(right(key, 1), '^\p{{Nd}}$') AND regexp_matches(af, '^\p{{Nd}}$'))
        AND NOT (length(key) = 1 AND (({matches('bf', kana.WIDE_CJK)}) OR ({matches('af', kana.WIDE_CJK)}) OR (regexp_matches(key, '^[A-Za-z0-9]$') AND (regexp_matches(bf, '^[A-Za-z0-9]$') OR regexp_matches(af, '^[A-Za-z0-9]$')))))
        AND (prefix IS NULL OR regexp_extract(rtrim(left(t, s), ' '), '[0-9]{{1,4}}$') = prefix) END),
cm AS (SELECT k, o, o + 2 AS e, arg_min(reading, tier) AS reading FROM rs JOIN dc ON key = left(w, 2) WHERE {matches('left(w, 2)', kana.NARROW_CJK)} GROUP BY k, o),
t0 AS MATERIALIZED (SELECT k, 0 AS tier, o AS s, e, reading, reading AS fb, 'ruby' AS source FROM cm
    UNION ALL SELECT rs.k, 0, rs.o + x.i, rs.o + x.i + 1, x.r, CASE WHEN x.r = '雨' THEN coalesce(lr.reading, x.r) ELSE x.r END, 'ruby' FROM (SELECT k, o, w, unnest([{{'i': 0, 'r': 'ヨミ'}}, {{'i': 1, 'r': CASE WHEN n % 8 = 0 THEN '雨' ELSE 'ヨ' END}}]) AS x FROM rs) rs LEFT JOIN lr ON surface = substr(w, CAST(x.i + 1 AS BIGINT), 1) WHERE NOT EXISTS (SELECT 1 FROM cm WHERE cm.k = rs.k AND cm.o = rs.o)),
t1 AS MATERIALIZED (SELECT * FROM t0 UNION ALL SELECT a.* FROM (SELECT * FROM al WHERE tier = 1) a ASOF LEFT JOIN t0 b ON a.k = b.k AND a.e > b.s WHERE coalesce(b.e <= a.s, true)),
t2 AS MATERIALIZED (SELECT * FROM t1 UNION ALL SELECT a.* FROM (SELECT * FROM al WHERE tier = 2) a ASOF LEFT JOIN t1 b ON a.k = b.k AND a.e > b.s WHERE coalesce(b.e <= a.s, true)),
t3 AS MATERIALIZED (SELECT * FROM t2 UNION ALL SELECT a.* FROM (SELECT * FROM al WHERE tier = 3) a ASOF LEFT JOIN t2 b ON a.k = b.k AND a.e > b.s WHERE coalesce(b.e <= a.s, true)),
gp AS MATERIALIZED (SELECT k, g, lead(s) OVER (PARTITION BY k ORDER BY s, g) AS ge FROM (SELECT k, s, e AS g FROM t3 UNION ALL SELECT k, -1, 0 FROM tx UNION ALL SELECT k, length(t), length(t) FROM tx)),
gl AS MATERIALIZED (SELECT k, g, ge, o, max(n) AS n FROM (SELECT m.k, gp.g, gp.ge, m.o, m.n FROM (SELECT * FROM mt WHERE tier = 3) m ASOF JOIN (SELECT * FROM gp WHERE ge > g) gp ON m.k = gp.k AND m.o >= gp.g) WHERE o + n <= ge GROUP BY ALL),
gn AS MATERIALIZED (SELECT a.k, a.g, a.o, b.o AS nxt FROM gl a ASOF JOIN gl b ON a.k = b.k AND a.g = b.g AND a.o + a.n <= b.o),
gs AS (SELECT k, g, min(o) AS o FROM gl GROUP BY k, g UNION ALL SELECT k, g, nxt FROM gs JOIN gn USING (k, g, o)),
t4 AS (SELECT * FROM t3 UNION ALL SELECT k, 4, gs.o, gs.o + gl.n, lr.reading, lr.reading, 'unidic-gap' FROM gs JOIN gl USING (k, g, o) JOIN tx USING (k) JOIN lr ON surface = substr(t, CAST(gs.o + 1 AS BIGINT), gl.n) WHERE {matches('surface', kana.NARROW_CJK)} AND lr.reading <> ''),
tk AS (SELECT k, conv_id, turn, t, row_number() OVER (PARTITION BY k ORDER BY s) - 1 AS token_idx, s, e, substr(t, CAST(s + 1 AS BIGINT), CAST(e - s AS BIGINT)) AS surface, {canonical_sql('reading')} AS r0, {canonical_sql('fb')} AS fb, source FROM t4 JOIN tx USING (k)),
hm AS (SELECT tk.*, CASE WHEN r0 <> lr.reading AND length(r0) = length(lr.reading) AND {folded_sql('r0')} = {folded_sql('lr.reading')} THEN lr.reading ELSE r0 END AS reading FROM tk LEFT JOIN lr USING (surface)),
fg AS (SELECT *, {folded_sql(canonical_sql("coalesce(nullif(reading, ''), fb)"))} AS fr, starts_with(lower(source), 'unidic') AS dic FROM hm),
am AS (SELECT k, surface, count(DISTINCT CASE WHEN dic THEN fr END) > 1 AS several, count(DISTINCT fr) > 1 AS conflict FROM fg GROUP BY k, surface),
kn AS (SELECT surface, min(reading) AS lr, min({{'r': reading, 'a': accent}}).a AS accent FROM lx WHERE accent IS NOT NULL GROUP BY surface HAVING count(DISTINCT reading) = 1),
ct AS (SELECT k, conv_id, turn, t, token_idx, s, e, fg.surface, reading, fb, source, (several AND dic) OR conflict AS block, coalesce({canonical_sql('kn.lr')} = {canonical_sql("coalesce(nullif(reading, ''), fb)")}, false) AND lower(source) <> 'unidic' AS same, lower(source) = 'unidic' AS own, kn.accent AS lex_accent FROM fg JOIN am USING (k, surface) LEFT JOIN kn ON kn.surface = fg.surface)"""
CHAPTERS = CHAPTERS.replace("{LETTERS}", LETTERS).replace("{JAPANESE}", JAPANESE)


def annotated_pages(spark, d):
    """Pages whose every fourth word has its first letter, and the one behind it, in ruby."""
    plain = F.transform(tokens.plain_words(F.regexp_replace("text", "[<>&]", "")), lambda w: F.translate(F.lower(w), LETTERS + ".,", JAPANESE + "12"))
    rows = conversations(spark, d).select(*KEYS, plain.alias("words"))
    one = lambda base, reading: F.concat(F.lit("<ruby>"), base, F.lit("<rt>"), reading, F.lit("</rt></ruby>"))
    part = lambda w, n: F.substring(w, n, 1)
    marked = F.transform("words", lambda w, i: F.when((i % 4 == 0) & (F.char_length(w) > 2), F.concat(one(part(w, 1), F.lit("よみ")), one(part(w, 2), F.when(i % 8 == 0, F.lit("雨")).otherwise(F.lit("ヨ"))), F.substring(w, 3, 1000))).otherwise(w))
    return rows.select(*KEYS, F.concat(F.lit("<p>"), F.array_join(marked, " "), F.lit("</p>")).alias("html"))


def chapter_docs(spark, d):
    return annotated_pages(spark, d).select(*KEYS, markup.parse_markup("html").alias("m")).select(*KEYS, F.col("m.text").alias("text"), F.transform("m.spans", lambda s: F.struct(s["start"], s["end"], s["base"], s["reading"])).alias("spans"))


def mapping(spark, d):
    """A book's own dictionary and the common one, from what words begin with."""
    rows, idx = j_words(spark, d).where((F.col("conv_id") % 3 == 0) & (F.char_length("j") > 3)), F.col("token_idx")
    scope = F.when(idx % 2 == 0, "book").otherwise("common").alias("scope")
    rows = rows.select(F.expr("left(j, 1 + cast(token_idx % 3 as int))").alias("key"), scope, kana.canonical_katakana(F.substring("j", 2, 3)).alias("reading"))
    return rows.groupBy("key", "scope").agg(F.min("reading").alias("reading")).withColumn("source", F.when(F.col("scope") == "common", "corpus"))


def lexicon(spark, d):
    rows = j_words(spark, d).where((F.col("conv_id") % 4 == 1) & (F.char_length("j") > 2) & F.col("j").rlike("^" + kana.NARROW_CJK))
    accent = F.when(F.col("conv_id") % 5 < 4, F.col("conv_id") % 5).cast("long").alias("accent")
    return rows.select(F.expr("left(j, 1 + cast(token_idx % 2 as int))").alias("surface"), kana.canonical_katakana(F.substring("j", 2, 2)).alias("reading"), accent, F.lit("名詞").alias("pos")).distinct()


def rules(spark):
    return spark.createDataFrame([("日", ["1"]), ("字", ["2"]), ("漢", ["12"])], "base string, prefixes array<string>")


def chapters(spark, d):
    """Docs, mapping, lexicon and keys."""
    return chapter_docs(spark, d), mapping(spark, d), lexicon(spark, d), *KEYS


@query(
    f"""WITH {CHAPTERS} SELECT conv_id, turn, token_idx, s AS start, e AS "end", surface, reading, fb AS fallback_reading, source AS reading_source, substr(t, CAST(greatest(0, s - 3) + 1 AS BIGINT), CAST(s - greatest(0, s - 3) AS BIGINT)) AS prefix, substr(t, CAST(e + 1 AS BIGINT), 3) AS suffix,
    CASE WHEN same THEN lex_accent END AS accent, CASE WHEN same THEN '名詞' END AS pos, block, same OR (own AND reading IS NOT NULL) AS validated FROM ct"""
)
def chapter_tokens(spark, d):
    """The tokens of chapters from ruby, the book's dictionary, the common one, a lexicon and the gaps between them."""
    return tiered.built(*chapters(spark, d), rules=rules(spark))


SURE = f"{matches('surface', kana.NARROW_CJK)} AND NOT block AND (lower(source) IN ('unidic', 'unidic-gap', 'nhk') OR same OR (own AND reading IS NOT NULL))"
PIECES = "substr(t, CAST(p + 1 AS BIGINT), CAST(s - p AS BIGINT))"


@query(
    f"""WITH {CHAPTERS}, pc AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY k ORDER BY s), 0) AS p, max(e) OVER (PARTITION BY k) AS last FROM ct),
rd AS (SELECT k, string_agg({PIECES} || reading, '' ORDER BY s) AS a, string_agg({PIECES} || CASE WHEN {SURE} THEN surface ELSE reading END, '' ORDER BY s) AS b, any_value(last) AS last FROM pc GROUP BY k)
SELECT conv_id, turn, md5(coalesce(a, '') || substr(t, CAST(coalesce(last, 0) + 1 AS BIGINT))) AS rendered, md5(coalesce(b, '') || substr(t, CAST(coalesce(last, 0) + 1 AS BIGINT))) AS partial FROM tx LEFT JOIN rd USING (k)"""
)
def chapter_renders(spark, d):
    """Chapters from annotated pages to texts in katakana, and to partial ones."""
    return tiered.renders(*chapters(spark, d), rules=rules(spark)).select(*KEYS, md5(F.col("rendered")).alias("rendered"), md5(F.col("partial")).alias("partial"))


@query()
def chapter_lattice_tokens(spark, d):
    """The same with the lattice of the evidence's words as tokenizer, in the gaps too."""
    from . import lattice_queries

    tokenizer = tiered.lattice_tokenizer(lattice_queries.words(spark, d), lattice_queries.connections(spark, d))
    return tiered.built(*chapters(spark, d), tokenizer=tokenizer, rules=rules(spark))
