"""The queries of the numbered operators over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import table
from . import centroids, decontaminate, html_extract, katz, language, licences, media, mixing, near_dedup, token_file, toxicity, url_filter, va_file


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file.tokenized(table(spark, sf_dir, "documents"))


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.measured(table(spark, sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identified(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(table(spark, sf_dir, "pages"))


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scanned(table(spark, sf_dir, "documents"))


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extracted(table(spark, sf_dir, "pages"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op11_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.scored(table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return va_file.coded(table(spark, sf_dir, "embeddings"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clustered(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_token_file": op2_token_file,
    "op3_media": op3_media,
    "op4_language": op4_language,
    "op5_toxicity": op5_toxicity,
    "op6_mixing": op6_mixing,
    "op7_url_filter": op7_url_filter,
    "op8_licences": op8_licences,
    "op9_html_extract": op9_html_extract,
    "op10_near_dedup": op10_near_dedup,
    "op11_katz_scores": op11_katz_scores,
    "op12_vector_codes": op12_vector_codes,
    "op13_centroids": op13_centroids,
}

ORACLE_SQL: dict[str, str] = {
    "op1_decontaminate": decontaminate.SQL,
    "op6_mixing": mixing.SQL,
    "op7_url_filter": url_filter.SQL,
}
