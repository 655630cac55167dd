"""JSON that may be broken: fields by path and type, with the rows that don't parse set apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parsed(rows: DataFrame, column: str, fields: dict[str, tuple[str, str]], malformed: str = "malformed") -> DataFrame:
    """rows with a column for each field, name: (path, type), and whether the text is no JSON. A text is parsed once,
    as a variant; a field that is missing, null or of no such type is null. A null text is not malformed."""
    value = F.try_parse_json(column)
    found = rows.withColumn("variant_", value)
    made = [F.try_variant_get("variant_", path, kind).alias(name) for name, (path, kind) in fields.items()]
    return found.select(*rows.columns, *made, (F.col("variant_").isNull() & F.col(column).isNotNull()).alias(malformed))


def quarantined(rows: DataFrame, column: str, *by: str | Column) -> DataFrame:
    """by..., n, n_malformed, example: how many texts there are and don't parse, and the least of these."""
    marked = parsed(rows, column, {})
    bad = F.col("malformed")
    return marked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("n_malformed"), F.min(F.when(bad, F.col(column))).alias("example"))
