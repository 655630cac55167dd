"""The register of queries, each with the same in DuckDB's SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kana

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def long(c):
    return F.col(c).cast("long").alias(c) if isinstance(c, str) else c.cast("long")


def md5(c):
    return F.md5(c.cast("binary"))


def quoted(*values: str) -> str:
    return ", ".join(f"'{x}'" for x in values)


def guarded_sql(source: str, key: str, text: str, mapping: dict[str, str]) -> str:
    """SQL of the guarded replacement: the text between the matches and the matches, each with the characters beside it."""
    pattern = "|".join(sorted(mapping, key=lambda k: (-len(k), k)))
    case = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items())
    digit, plain = r"'^\p{Nd}$'", "'^[A-Za-z0-9]$'"
    return f"""WITH m AS (SELECT {key}, string_split_regex({text}, '{pattern}') AS g, regexp_extract_all({text}, '{pattern}') AS x FROM {source} WHERE {text} IS NOT NULL),
e AS (SELECT {key}, i, g[i] AS gap, x[i] AS hit, CASE WHEN g[i] <> '' THEN right(g[i], 1) WHEN i > 1 THEN right(x[i - 1], 1) ELSE '' END AS before, CASE WHEN g[i + 1] <> '' THEN left(g[i + 1], 1) ELSE coalesce(left(x[i + 1], 1), '') END AS after
    FROM (SELECT {key}, g, x, unnest(range(1, len(g) + 1)) AS i FROM m)),
f AS (SELECT *, (regexp_matches(left(hit, 1), {digit}) AND regexp_matches(before, {digit})) OR (regexp_matches(right(hit, 1), {digit}) AND regexp_matches(after, {digit}))
    OR (length(hit) = 1 AND (regexp_matches(before, '{kana.WIDE_CJK}') OR regexp_matches(after, '{kana.WIDE_CJK}') OR (regexp_matches(hit, {plain}) AND (regexp_matches(before, {plain}) OR regexp_matches(after, {plain}))))) AS refused FROM e)
SELECT {key}, md5(string_agg(gap || coalesce(CASE WHEN refused THEN hit ELSE CASE hit {case} END END, ''), '' ORDER BY i)) AS replaced FROM f GROUP BY {key}"""
