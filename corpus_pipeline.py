"""The corpus pipeline: language ID, near-duplicates, decontamination, mixing, token file.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents.

Defined results. An empty table stays empty through all stages. Extra columns, whatever their names,
go through all stages but the last. The stages say what becomes of nulls, of rows without words and of
rows that repeat; very long texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from yomibon.llm import common, decontaminate, language, mixing, near_dedup, token_file
from yomibon.session import table


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined with a probability of LEAST_SCORE. Null texts and texts without a letter go; rows that repeat a doc_id are judged each by its text; a null lang or doc_id doesn't train."""
    return language.keep_identified(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the least doc_id, and one row of it. Rows without a doc_id and texts without words stay."""
    return near_dedup.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item. Null and wordless texts stay; all rows of a doc_id go if one of them holds a window; rows without a doc_id go by their text."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them. A null source is a source; rows that repeat are documents of their own; texts without words count as size 0."""
    return mixing.emitted(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token file, as read back: doc_id, start, n_tokens, ids_crc32, shard, block. A null text is its end id alone; rows without a doc_id come first."""
    return token_file.tokenized(docs)


STAGES = [("language_id", identify), ("near_dedup", deduplicate), ("decontaminate", decontaminated), ("mixing", mix), ("token_file", tokens)]

#: Trained and hashed stages aren't expressible in SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), name)
    return docs
