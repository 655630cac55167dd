"""Vector codes by product quantisation, with a VA-file filter in place of full distance computation.

A vector's components become integers, floor(SCALE x), and the vector is cut into PARTS equal parts. Each
part position has a codebook of at most ENTRIES entries, refined in rounds: parts go to their nearest
entry, entries become the floor of the mean of their parts. Nearest entries are found as in a VA-file:
the entries' coordinates are quantised into 2**BITS cells a dimension, equally filled; a query's lookup
tables hold the least and the greatest squared distance of its coordinate to each cell, whose sums over
the dimensions bound its distance to each entry; only entries whose lower bound is within the least upper
bound are refined, by exact integer distances. Ties go to the lower index.

Each round is one scan whose tasks return sums by entry, of a fixed size; the codebooks, 1024 integers at 64
dimensions, are all that the driver holds. The last scan writes codes and errors, and errors are
summed by label in a shuffle that combines first.

Defined results. Vectors that are null, empty, or hold a null or non-finite component are dropped, and so
are those whose length isn't a multiple of PARTS or isn't that of the kept vector with the least vec_id. A
vec_id that repeats counts each time; among equal ids the least vector comes first, and a null id comes
last. Fewer kept vectors than ENTRIES make codebooks of that many entries. Integers stay within LARGEST,
so that squared distances fit a long. Sums beyond a long are the greatest long. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, kernels

SCALE, PARTS, ENTRIES, ROUNDS, BITS = 4096, 8, 16, 6, 3
LARGEST = 1 << 28
#: Vectors that are handled at a time.
ROWS = 8192
LONG = (1 << 63) - 1
#: Rows of a key that one salt takes.
SPREAD = 1_000_000


def integers(column: pa.Array, width: int, scale: int, largest: int) -> np.ndarray:
    """[n, width] of floor(scale x), from lists of that length without nulls; x is taken as double."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.clip(np.floor(flat * scale), -largest, largest).astype(np.int64).reshape(-1, width)


class Cells:
    """One part position's entries, approximated: each entry's cell by dimension, each cell's lower and upper end."""

    def __init__(self, entries: np.ndarray, bits: int = BITS):
        self.entries = entries
        n, width = entries.shape
        cells = min(n, 1 << bits)
        ends = [np.sort(entries[:, d])[np.arange(cells + 1) * n // cells - (np.arange(cells + 1) == cells)] for d in range(width)]
        self.low, self.high = (np.stack([e[k : cells + k] for e in ends]) for k in (0, 1))  # [width, cells]
        self.cell = np.stack([np.clip(np.searchsorted(low, entries[:, d], side="right") - 1, 0, cells - 1) for d, low in enumerate(self.low)], axis=1)

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """parts [n, width]: (index of the nearest entry, squared distance)."""
        n = len(parts)
        lower, upper = np.zeros((n, len(self.entries)), np.int64), np.zeros((n, len(self.entries)), np.int64)
        for d in range(parts.shape[1]):
            below, above = self.low[d] - parts[:, d, None], parts[:, d, None] - self.high[d]
            least = np.maximum(np.maximum(below, above), 0)
            most = np.maximum(np.abs(below), np.abs(above))
            lower += (least * least)[:, self.cell[:, d]]
            upper += (most * most)[:, self.cell[:, d]]
        row, entry = np.nonzero(lower <= upper.min(axis=1, keepdims=True))
        difference = parts[row] - self.entries[entry]
        refined = np.full(lower.shape, LONG, np.int64)
        refined[row, entry] = np.einsum("nd,nd->n", difference, difference)
        best = refined.argmin(axis=1)
        return best, refined[np.arange(n), best]


def assigned(vectors: np.ndarray, books: list[Cells]) -> tuple[np.ndarray, np.ndarray]:
    """vectors [n, dimensions]: entry and squared distance by part."""
    found = [book.nearest(part) for book, part in zip(books, np.split(vectors, len(books), axis=1), strict=True)]
    return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


SUMS = "part int, entry int, position int, n long, total long"


def summer(codebooks: np.ndarray, scale: int) -> Callable:
    """Batches of (vector) -> a task's count and sum of the parts of each entry, by position."""

    @kernels.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_parts, n_entries, width = codebooks.shape
        books = [Cells(b) for b in codebooks]
        count, total = np.zeros((n_parts, n_entries), np.int64), np.zeros(codebooks.shape, np.int64)
        for batch in batches:
            for s in range(0, batch.num_rows, ROWS):
                vectors = integers(batch.column(0).slice(s, ROWS), n_parts * width, scale, LARGEST)
                codes, _ = assigned(vectors, books)
                for p in range(n_parts):
                    count[p] += np.bincount(codes[:, p], minlength=n_entries)
                    np.add.at(total[p], codes[:, p], vectors[:, p * width : (p + 1) * width])
        part, entry, position = (x.ravel().astype(np.int32) for x in np.indices(codebooks.shape))
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), pa.array(position), pa.array(np.repeat(count.ravel(), width)), pa.array(total.ravel())], [x.split()[0] for x in SUMS.split(", ")])

    return run


def coder(codebooks: np.ndarray, scale: int) -> Callable:
    """Batches of (vector, vec_id, label) -> vec_id, label, code, error."""

    @kernels.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = [Cells(b) for b in codebooks]
        for batch in batches:
            for s in range(0, batch.num_rows, ROWS):
                some = batch.slice(s, ROWS)
                codes, errors = assigned(integers(some.column(0), codebooks.shape[0] * codebooks.shape[2], scale, LARGEST), books)
                names = [bytes(c).hex() for c in codes.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([some.column(1), some.column(2), pa.array(names, pa.string()), pa.array(errors.sum(axis=1))], ["vec_id", "label", "code", "error"])

    return run


def finite(vectors: DataFrame, vector: str) -> DataFrame:
    """The rows whose vector is not null or empty and has finite components only."""
    v = F.col(vector)
    return vectors.where(F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False)))


def means(rows: DataFrame, codebooks: np.ndarray) -> np.ndarray:
    """rows (part, entry, position, n, total): the entries of the next round. As many rows as the codebooks have numbers."""
    found = codebooks.copy()
    sums = rows.groupBy("part", "entry", "position").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).where("n > 0")
    for r in sums.collect():
        found[r.part, r.entry, r.position] = int(r.total) // r.n
    return found


def coded(vectors: DataFrame, vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vectors (vec_id, vector, label) -> vec_id, code, error, label_error, codebooks_sha256, label."""
    if entries > 256:
        raise ValueError("a code has two hex digits a part")
    kept = finite(vectors.select(F.col(vector).alias("vector"), "vec_id", "label"), "vector")
    by_id = [F.col("vec_id").asc_nulls_last(), "vector"]
    first = kept.orderBy(*by_id).select(F.size("vector").alias("n")).head()
    schema = f"vec_id {kept.schema['vec_id'].dataType.simpleString()}, label {kept.schema['label'].dataType.simpleString()}, code string, error long"
    if first is None or first.n % parts:
        none = kept.where("false").select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"), "label")
        return none
    kept = kept.where(F.size("vector") == first.n)
    start = kept.orderBy(*by_id).limit(entries).select("vector").collect()
    width = first.n // parts
    books = integers(pa.array([r.vector for r in start]), first.n, scale, LARGEST).reshape(-1, parts, width).transpose(1, 0, 2)
    for _ in range(rounds):
        books = means(kept.select("vector").mapInArrow(summer(books, scale), SUMS), books)
    codes = common.written(kept.mapInArrow(coder(books, scale), schema), "codes")
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return with_group_sum(codes, "label", "error", "label_error").select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"), "label")


def with_group_sum(rows: DataFrame, key: str, value: str, name: str, spread_rows: int = SPREAD, broadcast_bytes: int = common.BROADCAST_BYTES) -> DataFrame:
    """rows with the sum of a value over equal keys, nulls together. The sums are broadcast where their
    counted size is small; else a key's rows are spread over as many salts as they need, so none is hot."""
    sums = rows.groupBy(key).agg(F.sum(F.col(value).cast("decimal(38,0)")).alias("s"), F.count(F.lit(1)).alias("n"))
    sums = common.written(sums.select(F.col(key).alias("of"), F.least("s", F.lit(LONG)).cast("long").alias(name), "n"), "sums")
    size = sums.agg(F.sum(64 + F.coalesce(F.octet_length(F.col("of").cast("string")), F.lit(0)))).head()[0] or 0
    if size <= broadcast_bytes:
        return rows.join(F.broadcast(sums.drop("n")), F.col(key).eqNullSafe(F.col("of"))).drop("of")
    spread = sums.select("of", name, F.explode(F.sequence(F.lit(0), (F.col("n") / spread_rows).cast("long"))).alias("salt"))
    # A row's salt is drawn below its key's count, which only large keys need to know.
    large = sums.where(F.col("n") >= spread_rows).select(F.col("of").alias("large"), (F.col("n") / spread_rows).cast("long").alias("salts"))
    few = large.agg(F.sum(64 + F.coalesce(F.octet_length(F.col("large").cast("string")), F.lit(0)))).head()[0] or 0
    salted = rows.join(common.bounded(large, few, 1), F.col(key).eqNullSafe(F.col("large")), "left")
    salted = salted.withColumn("salt", F.pmod(F.xxhash64("vec_id", value), F.coalesce("salts", F.lit(0)) + 1))
    return salted.join(spread, F.col(key).eqNullSafe(F.col("of")) & (salted["salt"] == spread["salt"])).drop("of", "salt", "large", "salts")
