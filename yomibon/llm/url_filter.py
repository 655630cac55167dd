"""URL filtering: path rules first, then a weighted vocabulary found by Aho-Corasick.

A rule is (verdict, host, path): it fits its host and all subdomains if the URL's path starts with
the rule's; of several the longest wins. Without a rule, one automaton finds all vocabulary terms of
the lower-cased URL, its %-escapes decoded, in one pass; a hit counts only between boundaries (no letter
or digit beside it). One strict term blocks, and so do soft terms of `SOFT_LIMIT` or more distinct roots;
the weights of the roots make up a score. The vocabulary is a parameter: a table of weighted terms of any
size, or the built-in one, made of roots in four languages and their plurals. A table beyond
`AUTOMATON_BYTES` is not sent to the tasks but joined with the places of its terms, by their hashes.

Defined results. A URL that is null or has no `://` has an empty host and path; null has no hits and
is allowed. Terms may overlap; each distinct soft root counts once, with the greatest weight of its terms.
Of rows of one term the strict one counts, then the greater weight. A term without a root is its own. Repeated rows each get their
result; an empty table gives an empty result. A very long URL is read as a whole. Extra columns,
whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.dictionary import occurrences
from .common import ascii_lower, written

RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))

# Roots of terms that block by themselves, and of terms that block together with others, by weight; in English, German, French and Spanish.
STRICT_ROOTS = (
    "casino poker porn porno pornografie pornographie pornografía xxx xvideo camgirl malware phishing spyware ransomware botnet viagra cialis warez spam "
    "glücksspiel spielcasino sportwette sexkontakt hurenführer raubkopie "
    "paristurf jeuxdargent sexeamateur logicielpirate "
    "casinoenlínea apuestasdeportivas putita pirateado"
).split()
SOFT_ROOTS = {
    1.5: "sex sexy escort jackpot keygen pill slot nude erotik erotic érotique erótico roulette blackjack betting wette pari apuesta steroid potenzmittel pilule pastilla",
    1.0: "ad adult bet bonus cheap crack crypto loan kredit crédit préstamo lottery lotterie loterie lotería gamble torrent track tracker win winner gewinn gagnant ganador prize preis prix premio replica rolex weightloss abnehmen maigrir adelgazar dating hookup singles rencontre citas forex payday clickbait giveaway gratuit gratis kostenlos billig barato solde rabatt",
    0.5: "click deal discount farm free lucky offer angebot offre oferta promo coupon gutschein popup banner download télécharger descargar herunterladen",
}
#: What a root may end in; a term is a root with one of them.
ENDINGS = ("", "s", "es")


def vocabulary() -> list[tuple[str, bool, float, str]]:
    """(term, strict, weight, root): every root with every ending; of a term's roots the strict ones come first, then those of greater weight."""
    found: dict[str, tuple[bool, float, str]] = {}
    listed = [(root, True, 0.0) for root in STRICT_ROOTS] + [(root, False, weight) for weight, roots in SOFT_ROOTS.items() for root in roots.split()]
    for root, strict, weight in listed:
        for ending in ENDINGS:
            found[root + ending] = max(found.get(root + ending, (False, 0.0, "")), (strict, weight, root))
    return [(term, *found[term]) for term in sorted(found)]


#: The least number of distinct soft roots that blocks.
SOFT_LIMIT = 2
#: A vocabulary of at most so many bytes is sent to every task.
AUTOMATON_BYTES = 16 << 20

PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, PARTS, 1)), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def matched_rule(at_host: Column, at_path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null."""
    result = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, own, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((at_host == own) | at_host.endswith(f".{own}")) & at_path.startswith(start)
        result = F.when(fits, F.struct(F.lit(own + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(result)
    return result


def term_scorer(terms: list[tuple[str, bool, float, str]]) -> Callable:
    """A function of URL batches: strict hits, distinct soft roots and their weight."""

    @F.pandas_udf("n_strict int, n_soft int, soft_weight double")
    def hits(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import ahocorasick
        from urllib.parse import unquote

        automaton = ahocorasick.Automaton()
        for entry in terms:
            automaton.add_word(entry[0], entry)
        if terms:
            automaton.make_automaton()

        def one(url: str | None) -> tuple[int, int, float]:
            text = unquote(url or "").lower()
            found = set()
            for end, entry in automaton.iter(text) if terms else ():
                start = end - len(entry[0])
                if (start < 0 or not text[start].isalnum()) and (end + 1 == len(text) or not text[end + 1].isalnum()):
                    found.add(entry)
            soft: dict[str, float] = {}
            for _, strict, weight, root in found:
                if not strict:
                    soft[root] = max(weight, soft.get(root, weight))
            return sum(entry[1] for entry in found), len(soft), sum(soft[root] for root in sorted(soft))

        for urls in batches:
            yield pd.DataFrame([one(u) for u in urls], columns=["n_strict", "n_soft", "soft_weight"])

    return hits


@F.pandas_udf(T.StringType())
def decoded(urls: pd.Series) -> pd.Series:
    from urllib.parse import unquote

    return urls.map(lambda u: unquote(u).lower(), na_action="ignore")


def cleaned(table: DataFrame) -> DataFrame:
    """A vocabulary table (term, strict, weight[, root]) with one row a term."""
    root = F.coalesce(F.lower("root"), F.lower("term")) if "root" in table.columns else F.lower("term")
    rows = table.where("term <> ''").select(F.lower("term").alias("term"), F.struct(F.coalesce("strict", F.lit(False)).alias("strict"), F.coalesce(F.col("weight").cast("double"), F.lit(0.0)).alias("weight"), root.alias("root")).alias("x"))
    return rows.groupBy("term").agg(F.max("x").alias("x")).select("term", "x.*")


def joined_hits(pages: DataFrame, terms: DataFrame) -> DataFrame:
    """pages with `hits`, by a join of the places in URLs where a term may stand with the terms; for vocabularies of any size."""
    letter = r"^[\p{L}\p{N}]$"
    rows = written(pages.withColumn("row_", F.expr("uuid()")), "urls")  # written, so the numbers stay
    found = occurrences(rows.select("row_", decoded("url").alias("text")), terms.withColumnRenamed("term", "key"), "row_")
    found = found.where(~F.col("before").rlike(letter) & ~F.col("after").rlike(letter))
    soft = found.where("not strict").groupBy("row_", "root").agg(F.max("weight").alias("weight")).groupBy("row_").agg(F.count(F.lit(1)).cast("int").alias("n_soft"), F.sum("weight").alias("soft_weight"))
    strict = found.where("strict").groupBy("row_").agg(F.countDistinct("surface").cast("int").alias("n_strict"))
    none = F.lit(0)
    hits = F.struct(F.coalesce("n_strict", none).alias("n_strict"), F.coalesce("n_soft", none).alias("n_soft"), F.coalesce("soft_weight", F.lit(0.0)).alias("soft_weight"))
    return rows.join(strict, "row_", "left").join(soft, "row_", "left").select(*pages.columns, hits.alias("hits"))


def judged(pages: DataFrame, rules=RULES, terms: DataFrame | None = None, automaton_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """pages (page_id, url) -> page_id, host, path, rule, verdict, n_strict, n_soft, soft_weight. terms: a vocabulary table, or vocabulary()."""
    rows = pages.select("page_id", "url")
    known = None if terms is None else cleaned(terms)
    size = 0 if known is None else known.agg(F.sum(F.octet_length("term") + F.octet_length("root") + 64)).head()[0] or 0
    if size <= automaton_bytes:
        listed = vocabulary() if known is None else [tuple(r) for r in known.orderBy("term").collect()]
        rows = rows.withColumn("hits", term_scorer(listed)(F.col("url")))
    else:
        rows = joined_hits(rows, known)
    rows = rows.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), "hits")
    rows = rows.withColumn("ruled", matched_rule(F.col("host"), F.col("path"), rules))
    bad = (F.col("hits.n_strict") > 0) | (F.col("hits.n_soft") >= SOFT_LIMIT)
    verdict = F.coalesce(F.col("ruled.verdict"), F.when(bad, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict")
    return rows.select("page_id", "host", "path", F.col("ruled.rule").alias("rule"), verdict, "hits.n_strict", "hits.n_soft", "hits.soft_weight")


def _sql() -> str:
    """The same in DuckDB's SQL: all terms are letters and digits, so a hit is an equal run of these in the URL."""
    terms = ", ".join(f"('{t}', {strict}, CAST({weight} AS DOUBLE), '{root}')" for t, strict, weight, root in vocabulary())
    ordered = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))" for _, h, p in ordered]
    rule = "CASE " + " ".join(f"WHEN {f} THEN '{h}{p}'" for f, (_, h, p) in zip(fits, ordered, strict=True)) + " END"
    said = "CASE " + " ".join(f"WHEN {f} THEN '{v}'" for f, (v, _, _) in zip(fits, ordered, strict=True)) + " END"
    return rf"""
WITH terms(term, strict, weight, root) AS (VALUES {terms}),
p AS (SELECT row_number() OVER () AS k, page_id, lower(url_decode(coalesce(url, ''))) AS low,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
t AS (SELECT DISTINCT k, term FROM (SELECT k, unnest(string_split_regex(low, '[^\p{{L}}\p{{N}}]+')) AS term FROM p)),
r AS (SELECT k, strict, root, max(weight) AS weight, count(*) AS n FROM t JOIN terms USING (term) GROUP BY k, strict, root),
h AS (SELECT k, CAST(sum(CASE WHEN strict THEN n ELSE 0 END) AS INTEGER) AS n_strict, CAST(sum(CASE WHEN strict THEN 0 ELSE 1 END) AS INTEGER) AS n_soft, sum(CASE WHEN strict THEN 0 ELSE weight END) AS weight FROM r GROUP BY k)
SELECT page_id, host, path, {rule} AS rule,
    coalesce({said}, CASE WHEN coalesce(n_strict, 0) > 0 OR coalesce(n_soft, 0) >= {SOFT_LIMIT} THEN 'block' ELSE 'allow' END) AS verdict,
    coalesce(n_strict, 0) AS n_strict, coalesce(n_soft, 0) AS n_soft, coalesce(weight, 0) AS soft_weight
FROM p LEFT JOIN h USING (k)
"""


SQL = _sql()
