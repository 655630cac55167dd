"""Queries of the lattice tokenizer: lexicon and connections from the evidence of the conversations, the cheapest paths of whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import kana
from ..operators import lattice, tiers, tokens
from .catalogue import md5, query
from .text_queries import JTEXT, KEYS, WORDS, canonical_sql, conversations, j_docs, j_words, japanese

KANA_SQL = "[\\x{3041}-\\x{309F}\\x{30A0}-\\x{30FF}]"


def class_sql(x: str) -> str:
    named = [("space", r"\s"), ("digit", r"\p{Nd}"), ("kanji", kana.NARROW_CJK), ("kana", KANA_SQL), ("latin", "[A-Za-zＡ-Ｚａ-ｚ]")]
    return "CASE " + " ".join(f"WHEN regexp_matches({x}, '^{p}') THEN '{n}'" for n, p in named) + " ELSE 'other' END"


def cost_sql(n: str, total: str) -> str:
    return f"CAST(floor(-1000 * log10(CAST({n} AS DOUBLE) / {total}) + 0.5) AS BIGINT)"


#: Lexicon, connections and lattice as tables, and the best word to each place and class, place by place. A state
#: holds the word that ends at its place: cost and words so far, start, class before, reading, and the path.
LATTICE = rf"""RECURSIVE {WORDS}, {JTEXT},
sg AS (SELECT left(j, 2 + CAST(token_idx % 2 AS INTEGER)) AS surface, {canonical_sql("substr(j, 2, 2)")} AS reading FROM jw WHERE length(j) >= 2),
lx AS (SELECT surface, reading, {class_sql('surface')} AS c, {cost_sql('count(*)', '(SELECT count(*) FROM sg)')} AS cost FROM sg GROUP BY surface, reading),
cl AS (SELECT conv_id, turn, token_idx, {class_sql('j')} AS r FROM jw), cp AS (SELECT r, coalesce(lag(r) OVER (PARTITION BY conv_id, turn ORDER BY token_idx), 'bound') AS l FROM cl),
cn AS MATERIALIZED (SELECT l, r, {cost_sql('n', 'sum(n) OVER (PARTITION BY l)')} AS cost FROM (SELECT l, r, count(*) AS n FROM cp GROUP BY l, r)),
tx AS (SELECT row_number() OVER () AS k, conv_id, turn, j FROM jt WHERE j IS NOT NULL),
ch AS (SELECT k, i - 1 AS o, {class_sql('x')} AS c FROM (SELECT k, i, j[i] AS x FROM (SELECT k, j, unnest(range(1, length(j) + 1)) AS i FROM tx))),
rn AS (SELECT *, sum(CASE WHEN p = c THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY o) AS run FROM (SELECT *, lag(c) OVER (PARTITION BY k ORDER BY o) AS p FROM ch)),
ru AS (SELECT k, o, c, max(o) OVER (PARTITION BY k, run) + 1 AS e FROM rn),
ed AS MATERIALIZED (SELECT k, o AS s, o + 1 AS e, c, 6500 AS cost, '' AS r FROM ru UNION ALL SELECT k, o, e, c, 6000 + 500 * (e - o), '' FROM ru WHERE e > o + 1
    UNION ALL SELECT k, o, o + n, lx.c, lx.cost, lx.reading FROM (SELECT k, o, n, substr(j, CAST(o + 1 AS BIGINT), n) AS w FROM ch JOIN tx USING (k), (VALUES (2), (3)) AS ln(n)) JOIN lx ON surface = w WHERE length(w) = n),
st AS (SELECT k, CAST(0 AS BIGINT) AS p, CAST(0 AS BIGINT) AS e, 'bound' AS c, {{'cost': CAST(0 AS BIGINT), 'n': CAST(0 AS BIGINT), 's': CAST(-1 AS BIGINT), 'b': '', 'r': '', 'path': ''}} AS x, CAST(length(j) AS BIGINT) AS len FROM tx
    UNION ALL SELECT k, p + 1, e, c, min(x), any_value(len) FROM (
        SELECT k, p, e, c, x, len FROM st WHERE e > p AND p < len
        UNION ALL SELECT st.k, p, CAST(ed.e AS BIGINT), ed.c, {{'cost': CAST(x.cost + coalesce(cn.cost, 4000) + ed.cost AS BIGINT), 'n': x.n + 1, 's': p, 'b': st.c, 'r': ed.r, 'path': x.path || p || chr(31) || ed.r || chr(31) || ed.c || chr(30)}}, len
        FROM st JOIN ed ON ed.k = st.k AND ed.s = st.p LEFT JOIN cn ON cn.l = st.c AND cn.r = ed.c WHERE st.e = p AND p < len) GROUP BY k, p, e, c),
bs AS (SELECT k, arg_min(x, {{'cost': x.cost, 'n': x.n, 'c': c}}) AS x FROM st WHERE p = len AND e = len GROUP BY k),
lt AS (SELECT conv_id, turn, CAST(i - 1 AS BIGINT) AS idx, CAST(t[1] AS BIGINT) AS start, coalesce(lead(CAST(t[1] AS BIGINT)) OVER (PARTITION BY conv_id, turn ORDER BY i), length(j)) AS "end", nullif(t[2], '') AS reading, t[3] AS class, j
    FROM (SELECT k, string_split(parts[i], chr(31)) AS t, i FROM (SELECT k, string_split(x.path, chr(30)) AS parts, unnest(range(1, len(string_split(x.path, chr(30))))) AS i FROM bs)) JOIN tx USING (k))"""


def words(spark, d):
    """The lexicon: what the words of the conversations begin with, and their readings."""
    rows = j_words(spark, d).where(F.char_length("j") >= 2)
    return lattice.word_costs(rows.select(F.expr("left(j, 2 + cast(token_idx % 2 as int))").alias("surface"), kana.canonical_katakana(F.substring("j", 2, 2)).alias("reading")))


def connections(spark, d):
    words = F.transform(tokens.plain_words(F.col("text")), japanese)
    return lattice.connection_costs_of_rows(conversations(spark, d).select(words.alias("words")), "words")


@query(f"WITH {LATTICE} SELECT conv_id, turn, x.cost AS cost, x.n AS n_words FROM bs JOIN tx USING (k)")
def lattice_costs(spark, d):
    """The cost of each text's cheapest path, and the number of its words."""
    rows = lattice.paths(j_docs(spark, d), words(spark, d), connections(spark, d), *KEYS).where("path.cost is not null")
    return rows.select(*KEYS, "path.cost", F.size("path.tokens").cast("long").alias("n_words"))


@query(f'WITH {LATTICE} SELECT conv_id, turn, idx, start, "end", substr(j, start + 1, "end" - start) AS surface, reading, class FROM lt')
def lattice_tokens(spark, d):
    """The words of each text's cheapest path through the lattice of the lexicon and unknown runs."""
    return lattice.tokens(j_docs(spark, d), words(spark, d), connections(spark, d), *KEYS)


@query(f"""WITH {LATTICE}, sd AS (SELECT conv_id, turn, idx, CASE WHEN regexp_matches(s, '{kana.NARROW_CJK}') THEN coalesce(reading, s) ELSE s END AS said FROM (SELECT *, substr(j, start + 1, "end" - start) AS s FROM lt))
SELECT conv_id, turn, md5(string_agg({canonical_sql('said')}, '' ORDER BY idx)) AS reading FROM sd GROUP BY ALL""")
def lattice_readings(spark, d):
    """Texts as they are read by their cheapest paths: words with ideographs by their readings, all else as written."""
    rows = lattice.paths(j_docs(spark, d).where("text <> ''"), words(spark, d), connections(spark, d), *KEYS)
    return rows.select(*KEYS, md5(tiers.reading_text(F.col("path.tokens"))).alias("reading"))
