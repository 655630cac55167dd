"""What the operators share: the shared folder, written intermediate tables, stable hashes."""

from __future__ import annotations

import pickle
import sys
import types
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import new_folder

#: The word class of all word-based operators, applied after A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Tables up to this many bytes may be broadcast; beyond it the callers use another way.
BROADCAST_BYTES = 32 << 20

def written(df: DataFrame, name: str, codec: str = "snappy", paths: list[str] | None = None) -> DataFrame:
    """The rows of df, written to the shared folder and read again: it cuts the lineage and survives lost executors.

    The path is added to `paths`, for those who delete the table once it is used up."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    if paths is not None:
        paths.append(path)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def deleted(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[..., DataFrame]]:
    """written(), whose tables are deleted at the end of the block: what leaves it must not read them."""
    paths: list[str] = []
    try:
        yield lambda df, name, **options: written(df, name, paths=paths, **options)
    finally:
        for path in paths:
            deleted(spark, path)


@contextmanager
def configured(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """In the block the session has these settings, afterwards its own again."""
    own = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in own.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def bounded(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """df, marked for broadcast if its `rows` rows of at most row_bytes are proven to be few; else Spark shuffles."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def sent(spark: SparkSession, model: object) -> Broadcast:
    """A model of bounded size, sent once to each executor, by value with its classes: executors lack this package."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(model))


def received(model: Broadcast) -> object:
    """In a task: what sent() sent; a model that was broadcast as it is, as in local tests, is taken so."""
    return pickle.loads(model.value) if isinstance(model.value, bytes) else model.value


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """The words of a text; a null text has none."""
    return F.coalesce(F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def spare_name(taken: list[str], name: str) -> str:
    """A column name that clashes with none of `taken`."""
    while name.lower() in {x.lower() for x in taken}:
        name += "_"
    return name


def worker_cache() -> dict:
    """A dict that lives as long as the Python worker, for what is costly to load. Functions are pickled by
    value, so their own modules' globals are new in each task."""
    return sys.modules.setdefault("_yomibon_worker", types.ModuleType("_yomibon_worker")).__dict__
