"""Language identification: multinomial naive Bayes over hashed character n-grams.

Features are the 2-grams and 3-grams of bytes, within a word and its edges, of lower-cased letters,
hashed into 2**BUCKET_BITS buckets. Training counts them by language over a bounded sample of labelled rows,
summed by Spark. The sample is drawn by language, in equal shares, so a rare language has all its rows
in it. The model is one log-probability matrix [buckets, languages], 128 KB a language, broadcast to
the tasks. A batch of texts is scored as a sparse product: gather the matrix rows of all n-grams, sum
them by document. Whole texts are read, in pieces of bounded size.

Defined results. A null text, or one without a letter, is `und` with score 0. The score is the
posterior probability of the predicted language. Ties go to the language first by code point. A
language whose rows have no letter is not learned; with no labelled rows everything is `und`. Rows with
a null lang or doc_id don't train. Rows that repeat a doc_id each get their own result. A very long text
is one piece, in memory by itself. Extra columns are ignored, by keep_identified() kept, and may have
any names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels
from .common import received, sent

BUCKET_BITS = 15
#: At most about this many labelled rows are read for training, and of each language so many at least.
SAMPLE_ROWS, LEAST_ROWS = 20_000, 50
#: Smoothing count added to every bucket.
ALPHA = 0.5
UNDETERMINED = "und"
FOLDS = 5


def fold(doc_id):
    """crc32 of the doc_id as text, modulo FOLDS; 0 is held out. A null id is in no fold, so not held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


_bytes = np.arange(256)
#: Letters and bytes of letters beyond ASCII; all else is one separator.
CODE = np.where((_bytes >= 97) & (_bytes <= 122) | (_bytes >= 128), _bytes, 32).astype(np.uint8)
CODE[(_bytes >= 65) & (_bytes <= 90)] = _bytes[(_bytes >= 65) & (_bytes <= 90)] + 32


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of the 2-grams and 3-grams, edges of words included; none crosses two rows."""
    lengths = np.diff(offsets)
    row = np.repeat(np.arange(len(lengths)), lengths + 1)
    now = np.full(len(row), 32, np.uint32)  # a separator stands after each row
    now[np.arange(len(data)) + np.repeat(np.arange(len(lengths)), lengths)] = CODE[data]
    before, earlier = np.full_like(now, 32), np.full_like(now, 32)
    before[1:] = now[:-1]
    earlier[2:] = now[:-2]
    at = np.flatnonzero((now != 32) | (before != 32))  # around letters only
    two = now[at] | before[at] << np.uint32(8)
    # Behind a separator, the letter of the word before says nothing.
    three = two | np.where(before[at] == 32, np.uint32(32), earlier[at]) << np.uint32(16)
    shift = np.uint32(32 - BUCKET_BITS)
    keys = [(two * np.uint32(0x9E3779B1)) >> shift, ((three | np.uint32(1 << 24)) * np.uint32(0x85EBCA6B)) >> shift]
    return np.concatenate(keys).astype(np.int64), np.concatenate([row[at], row[at]])


def counter(languages: list[str]):
    """Batches of (lang, text) -> (counts), one array of all languages' buckets a task."""

    @kernels.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {lang: k for k, lang in enumerate(languages)}
        total = np.zeros(len(languages) << BUCKET_BITS, np.int64)
        for batch in batches:
            langs = np.array([place.get(x, -1) for x in batch.column(0).to_pylist()], np.int64)
            for first, end, data, offsets in kernels.pieces(batch.column(1)):
                keys, rows = grams(data, offsets)
                which = langs[first:end][rows]
                keep = which >= 0
                total += np.bincount((which[keep] << BUCKET_BITS) + keys[keep], minlength=len(total))
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["cell", "n"])

    return run


class Model:
    """Languages and their matrix of log-probabilities, [buckets, languages]."""

    def __init__(self, languages: list[str], counts: np.ndarray, documents: np.ndarray):
        smooth = counts.reshape(len(languages), -1) + ALPHA
        self.languages = languages
        self.matrix = np.ascontiguousarray(np.log(smooth / smooth.sum(axis=1, keepdims=True)).T.astype(np.float32))
        self.prior = np.log(documents / max(1, documents.sum()) + 1e-9)


def hash_share(part: Column | float) -> Column:
    """Whether a doc_id is in the given part of all, by its hash."""
    return F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < part * float(1 << 40)


def sample(rows: DataFrame, n: int, *, bound: int) -> DataFrame:
    """About `bound` of n rows, chosen by a hash of doc_id."""
    return rows.where(hash_share(F.lit(min(1.0, bound / max(1, n)))))


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """docs (doc_id, text, lang): a model of the labelled rows outside fold 0."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.coalesce(fold(F.col("doc_id")) != 0, F.lit(False)))
    # A row a language; their number is that of the labels in use, not of documents.
    numbers = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not numbers:
        return None
    languages = sorted(numbers)
    # Each language has the same share of the sample, and all its rows if these are fewer.
    bound = max(LEAST_ROWS, sample_rows // len(languages))
    parts = docs.sparkSession.createDataFrame([(lang, min(1.0, bound / n)) for lang, n in numbers.items()], "of string, part double")
    chosen = labelled.select("doc_id", "lang", "text").join(F.broadcast(parts), F.col("lang") == F.col("of")).where(hash_share(F.col("part"))).select("lang", "text")
    # The result has a fixed number of cells a language, whatever the input.
    cells = chosen.mapInArrow(counter(languages), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(len(languages) << BUCKET_BITS, np.float64)
    counts[cells["cell"].to_numpy(np.int64)] = cells["n"].to_numpy()
    known = counts.reshape(len(languages), -1).sum(axis=1) > 0
    if not known.any():
        return None
    kept = [lang for lang, has in zip(languages, known, strict=True) if has]
    return Model(kept, counts.reshape(len(languages), -1)[known].ravel(), np.array([numbers[x] for x in kept], np.float64))


def scorer(model):
    """model: a Model as sent() sends it. Batches of (doc_id, text, ...) -> the same with lang_pred and score."""

    @kernels.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = received(model)
        letter = re.compile(r"[^\W\d_]")
        for batch in batches:
            n = batch.num_rows
            logs, known = np.zeros((n, len(own.languages))), np.zeros(n, bool)
            for first, end, data, offsets in kernels.pieces(batch.column(1)):
                known[first:end] = [bool(x) and any(m[0].isalpha() for m in letter.finditer(x)) for x in batch.column(1).slice(first, end - first).to_pylist()]
                keys, rows = grams(data, offsets)
                half = len(rows) // 2
                for part in (slice(0, half), slice(half, None)):  # each half is ordered by row
                    bounds = kernels.grouped(rows[part], end - first)
                    held = np.flatnonzero(bounds[1:] > bounds[:-1])
                    if len(held):
                        logs[first + held] += np.add.reduceat(own.matrix[keys[part]], bounds[held], axis=0, dtype=np.float64)
            total = logs + own.prior
            total -= total.max(axis=1, keepdims=True)
            odds = np.exp(total)
            best = odds.argmax(axis=1)
            score = 1 / odds.sum(axis=1)
            names = np.array([*own.languages, UNDETERMINED], object)[np.where(known, best, len(own.languages))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(np.where(known, score, 0.0))], names=[*batch.schema.names, "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model | None, *keep: str) -> DataFrame:
    """docs (text, and the columns to keep) -> keep..., text, lang_pred, score."""
    cols = docs.select(*keep[:1], "text", *keep[1:])
    if model is None:
        return cols.withColumn("lang_pred", F.lit(UNDETERMINED)).withColumn("score", F.lit(0.0))
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in cols.schema)}, lang_pred string, score double"
    return cols.mapInArrow(scorer(sent(docs.sparkSession, model)), schema)


def identified(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs (doc_id, text, lang) -> doc_id, held_out, lang_pred, score."""
    held = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out")
    return predict(docs, train(docs, sample_rows), "doc_id").select("doc_id", held, "lang_pred", "score")


#: The pipeline drops documents below this probability, and undetermined ones.
LEAST_SCORE = 0.5


def keep_identified(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of docs whose language is determined with at least that probability, with all their columns."""
    model = train(docs, sample_rows)
    names = docs.columns
    plain = docs.toDF(*[f"c{k}" for k in range(len(names))])  # names of the input may clash with ours
    text = f"c{names.index('text')}"
    others = [c for c in plain.columns if c != text]
    rows = predict(plain.withColumnRenamed(text, "text"), model, *others)
    return rows.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least)).withColumnRenamed("text", text).select(*plain.columns).toDF(*names)
