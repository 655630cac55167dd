"""Unicode work that Spark SQL lacks, as Arrow-batched functions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Compatibility normalisation; null stays null."""
    return texts.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


@F.pandas_udf(T.BooleanType())
def all_digits(texts: pd.Series) -> pd.Series:
    """Whether all characters are digits of any script, superscripts and circled ones too."""
    return texts.map(lambda x: x.isdigit(), na_action="ignore")


def register(spark) -> None:
    """The functions under SQL names."""
    from ..operators.chunks import speech_chunks

    spark.udf.register("nfkc", nfkc)
    spark.udf.register("all_digits", all_digits)
    spark.udf.register("speech_chunks", speech_chunks)
