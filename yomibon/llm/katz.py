"""Language-model scoring by Katz backoff: Good-Turing discounted n-gram counts, exactly normalised backoff weights.

A text is the lower-cased (A-Z) runs of other characters than space and U+0009 to U+000D, then one end;
all words that training doesn't hold are one unknown event, so the model spreads probability 1 over its
words, the end and the unknown. Of an n-gram (h, w) seen c times,

    p(w | h) = d(c) c / total(h)   if c > 0, else   backoff(h) p(w | h without its first word)

with Katz's d(c) for c up to LARGE and 1 beyond it, and backoff(h) = left(h) / (1 - sum of p(w | shorter h)
over the w seen after h). Of a history whose counts are all beyond LARGE, discounting saves nothing: 1 is
added to its total, and that is what backs off. Where counts of counts don't give 0 < d <= 1, the order
takes d(c) = 1 - D / c with D = n1 / (n1 + 2 n2), or one half without singletons. Words are known by
64-bit hashes and n-grams by 64-bit mixes of them.

How it runs. Texts are read once and kept as blocks of word numbers, in a table bucketed by block. Each
block sends its distinct n-grams to the bucket of their hash, where counts add up; an n-gram has at most a
row's entry a block, however often it stands in the texts, so none is hot. A bucket stores its n-grams and
counts in a table partitioned by kind, and answers each block in the order of its questions. Of all
blocks that ask for an n-gram one owns it, and adds it to its history's sums; these meet in the bucket of
the history, which stores total and backoff and answers again. Then each block evaluates its n-grams order
by order. What a task holds is bounded by `block_bytes` and `bucket_bytes`, or one text beyond it; no
counts reach the driver but the counts of counts.

Defined results. A null text is an empty one: one end. A row without a doc_id, and each row that repeats
one, gets its own result; without a doc_id it trains. Without training rows all events are unknown, with
probability 1. Very long texts are read whole. Columns beyond doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import new_folder
from . import common, kernels

#: Counts up to this one are discounted.
LARGE = 5
ORDER = 2
#: Text of a block, and text whose n-grams one bucket counts; both bound what a task holds.
BLOCK_BYTES, BUCKET_BYTES = 8 << 20, 16 << 20
#: Blocks' text in a bucket of their table, and buckets at least.
FILE_BYTES, FILES = 128 << 20, 32
FOLDS, HELD = 7, 2
#: Keys of the beginning and the end of a text; no word holds white space.
BEGIN, END = b" ", b"\n"

BLOCKS = "block long, ids array<long>, held array<boolean>, sizes binary, seq binary, words binary"
ASKED = "n int, bucket int, block long, keys binary, counts binary"
COUNTED = "kind string, n int, bucket int, block long, keys binary, counts binary, stats array<long>"
SUMS = "n int, bucket int, block long, keys binary, total binary, saved binary, lower binary"
WEIGHED = "kind string, n int, bucket int, block long, keys binary, total binary, backoff binary"
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def packed(values: np.ndarray) -> bytes:
    """Numbers by byte plane, compressed: most are small, or differ little."""
    import zstandard

    return values.dtype.char.encode() + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes())


def unpacked(data: bytes) -> np.ndarray:
    import zstandard

    kind = np.dtype(chr(data[0]))
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(memoryview(data)[1:]), np.uint8)
    return np.ascontiguousarray(planes.reshape(kind.itemsize, -1).T).view(kind).ravel()


def packed_keys(keys: np.ndarray) -> bytes:
    """Ascending keys, by their differences."""
    return packed(np.diff(keys, prepend=np.uint64(0)))


def unpacked_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data), dtype=np.uint64)


def rows(schema: str, found: list[tuple]) -> pa.RecordBatch:
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<boolean>": pa.list_(pa.bool_()), "boolean": pa.bool_(), "double": pa.float64()}
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*found, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(columns, fields, strict=True)], [name for name, _ in fields])


class Numbers(dict):
    """Numbers of words in order of their first sight."""

    def __missing__(self, word: bytes) -> int:
        found = self[word] = len(self)
        return found


def blocker(order: int, block_bytes: int) -> Callable:
    """Batches of (doc_id, text, held) -> blocks of whole texts. A text is `order` - 1 beginnings, words, end."""

    @kernels.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        from pyspark import TaskContext

        partition, made = TaskContext.get().partitionId(), 0
        numbers, ids, held, sizes, parts, size = Numbers(), [], [], [], [], 0

        def block() -> pa.RecordBatch:
            keys = np.fromiter((xxhash.xxh64_intdigest(w) for w in numbers), np.uint64, len(numbers))
            return rows(BLOCKS, [(partition << 24 | made, ids, held, packed(np.array(sizes, np.int64)), packed(np.concatenate(parts)), keys.tobytes())])

        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            for k, (doc_id, out) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                text = texts[k].as_py() or b""
                found = [BEGIN] * (order - 1) + text.lower().split() + [END]
                parts.append(np.fromiter(map(numbers.__getitem__, found), np.int32, len(found)))
                ids.append(doc_id)
                held.append(out)
                sizes.append(len(found))
                size += len(text)
                if size >= block_bytes:
                    yield block()
                    made += 1
                    numbers, ids, held, sizes, parts, size = Numbers(), [], [], [], [], 0
        if ids:
            yield block()

    return run


class Block(NamedTuple):
    """The tokens of a block: word number, begin of a text, event (not a beginning), event of training, text number."""

    ids: list
    held: np.ndarray
    seq: np.ndarray
    starts: np.ndarray
    event: np.ndarray
    counted: np.ndarray
    words: np.ndarray


def opened(block: int, ids, held, sizes: bytes, seq: bytes, words: bytes, order: int) -> Block:
    lengths = unpacked(sizes)
    tokens = unpacked(seq).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    event = np.ones(len(tokens), bool)
    for k in range(order - 1):
        event[starts + k] = False
    out = np.array(held, bool)
    return Block(list(ids), out, tokens, starts, event, event & ~np.repeat(out, lengths), np.frombuffer(words, np.uint64))


class Grams(NamedTuple):
    """The distinct n-grams of a block: key, training count, number of the history and of the n-gram without
    its first word (of words: none); the number at each token, where asked for."""

    keys: np.ndarray
    count: np.ndarray
    head: np.ndarray | None
    tail: np.ndarray | None
    at: np.ndarray | None


def grams(block: Block, order: int, numbered: bool) -> list[Grams]:
    """Those of order 1 to `order`; with the last one's numbers and tails if `numbered`."""
    width = len(block.words)
    found = [Grams(block.words, np.bincount(block.seq[block.counted], minlength=width), None, None, block.seq)]
    for n in range(2, order + 1):
        below = found[-1]
        before = np.empty_like(below.at)
        before[1:] = below.at[:-1]
        before[block.starts] = below.at[block.starts]
        code = before * width + block.seq
        here = tail = None
        if n < order or numbered:
            place = np.argsort(code)
            code = code[place]
            first = np.concatenate([[True], code[1:] != code[:-1]])
            runs = np.flatnonzero(first)
            here = np.empty_like(code)
            here[place] = np.cumsum(first) - 1
            count = np.add.reduceat(block.counted[place].astype(np.int64), runs)
            tail = below.at[place[runs]]
            code = code[runs]
        else:
            code = np.sort(code * 2 + block.counted)
            runs = np.flatnonzero(np.concatenate([[True], code[1:] >> 1 != code[:-1] >> 1]))
            count = np.add.reduceat(code & 1, runs)
            code = code[runs] >> 1
        head = code // width
        keys = kernels.mix(below.keys[head] * kernels.RADIX + block.words[code - head * width])
        found.append(Grams(keys, count, head, tail, here))
    return found


def dealt(keys: np.ndarray, n_buckets: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The ascending order of keys, and (bucket, start, end) in it of the buckets in use: equal ranges of keys."""
    place = np.argsort(keys)
    bucket = ((keys[place] >> np.uint64(32)) * np.uint64(n_buckets)) >> np.uint64(32)
    starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return place, [*zip(bucket[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(keys)], strict=True)]


def asker(order: int, n_buckets: int) -> Callable:
    """Blocks -> the distinct n-grams of each, with training counts, by bucket."""

    @kernels.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                values = [c[k].as_py() for c in batch.columns]
                for n, level in enumerate(grams(opened(*values, order), order, False), 1):
                    place, parts = dealt(level.keys, n_buckets)
                    keys, count = level.keys[place], level.count[place]
                    yield rows(ASKED, [(n, b, values[0], packed_keys(keys[s:e]), packed(count[s:e])) for b, s, e in parts])

    return run


def gathered(table: pa.Table, *columns: str) -> tuple[list[int], np.ndarray, list[np.ndarray]]:
    """(blocks, bounds of their entries, keys and the columns' entries), blocks in order."""
    table = table.sort_by([("block", "ascending")])
    values = [[unpacked_keys(x.as_py()) for x in table["keys"]], *([unpacked(x.as_py()) for x in table[name]] for name in columns)]
    return table["block"].to_pylist(), np.cumsum([0, *map(len, values[0])]), [np.concatenate(x) for x in values]


def merged(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order of keys, where each distinct key begins in it, number of the distinct key by entry)."""
    place = np.argsort(keys, kind="stable")
    new = np.concatenate([[True], keys[place][1:] != keys[place][:-1]])
    number = np.empty(len(keys), np.int64)
    number[place] = np.cumsum(new) - 1
    return place, np.flatnonzero(new), number


def count_bucket(table: pa.Table) -> pa.Table:
    """A bucket's questions -> its n-grams of training with counts, and answers: twice the count, plus 1 for the owner."""
    n, bucket = table["n"][0].as_py(), table["bucket"][0].as_py()
    blocks, bounds, (keys, counts) = gathered(table, "counts")
    place, starts, number = merged(keys)
    total = np.add.reduceat(counts[place], starts)
    answer = 2 * total[number]
    answer[place[starts]] += 1
    seen = np.flatnonzero(total)
    stats = [int(total.sum()), len(seen), *np.bincount(np.minimum(total, LARGE + 2), minlength=LARGE + 3)[1 : LARGE + 2].tolist()]
    found = [("gram", n, bucket, None, packed_keys(keys[place[starts[seen]]]), packed(total[seen]), stats)]
    found += [("answer", n, bucket, b, None, packed(answer[s:e]), None) for b, s, e in zip(blocks, bounds[:-1], bounds[1:], strict=True)]
    return pa.Table.from_batches([rows(COUNTED, found)])


class Law(NamedTuple):
    """What the counts of counts fix: training tokens and words, discounts d(1) to d(LARGE) of each order."""

    tokens: int
    words: int
    discounts: tuple[tuple[float, ...], ...]

    def discount(self, n: int, count: np.ndarray) -> np.ndarray:
        return np.array([1.0, *self.discounts[n - 1], 1.0])[np.minimum(count, LARGE + 1)]

    def unigram(self, count: np.ndarray, left: float) -> np.ndarray:
        return np.where(count > 0, self.discount(1, count) * count / max(1, self.tokens + (left <= 0)), self.unknown(left))

    def unknown(self, left: float) -> float:
        return left / self.tokens if left > 0 else 1 / (self.tokens + 1)


def discounts(numbers: list[int]) -> tuple[float, ...]:
    """d(1) to d(LARGE) from the numbers of n-grams seen 1 to LARGE + 1 times."""
    n = [0, *numbers]
    if all(n[1 : LARGE + 1]):
        common = (LARGE + 1) * n[LARGE + 1] / n[1]
        found = [((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) for r in range(1, LARGE + 1)] if common < 1 else [0.0]
        if all(0 < d <= 1 for d in found):
            return tuple(found)
    step = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
    return tuple(1 - step / r for r in range(1, LARGE + 1))


def answered(table: pa.Table, n: int, column: str, kind: type) -> np.ndarray:
    """The answers of one order, in the order of the questions: by bucket, thus by key."""
    part = table.filter(compute.and_(compute.equal(table["n"], n), compute.is_valid(table[column]))).sort_by([("bucket", "ascending")])
    return np.concatenate([unpacked(x.as_py()) for x in part[column]] or [np.zeros(0, kind)])


class Evaluated(NamedTuple):
    block: Block
    levels: list[Grams]
    counts: list[np.ndarray]
    owned: list[np.ndarray]
    probabilities: list[np.ndarray]


def heads(levels: list[Grams], n: int) -> np.ndarray:
    """The numbers of the (n-1)-grams that are histories of the block's n-grams."""
    return np.flatnonzero(np.bincount(levels[n - 1].head, minlength=len(levels[n - 2].keys)))


def evaluated(state: pa.Table, answers: pa.Table, law: Law, left: float, order: int, n_buckets: int, weighed: int, upto: int) -> Evaluated:
    """A block's n-grams up to order `upto`, and their probabilities up to the order `weighed`, whose backoff weights are known."""
    block = opened(*(state[name][0].as_py() for name in state.column_names), order)
    levels = grams(block, upto, True)
    counts, owned, found = [], [], []
    for n, level in enumerate(levels, 1):
        place, _ = dealt(level.keys, n_buckets)
        said = np.empty(len(place), np.int64)
        said[place] = answered(answers, n, "counts", np.int64)
        counts.append(said >> 1)
        owned.append(said & 1 == 1)
        if n == 1:
            found.append(law.unigram(counts[0], left))
        elif n <= weighed:
            total, backoff = np.ones(len(levels[n - 2].keys)), np.ones(len(levels[n - 2].keys))
            mine = heads(levels, n)
            place, _ = dealt(levels[n - 2].keys[mine], n_buckets)
            total[mine[place]] = answered(answers, n, "total", np.int64)
            backoff[mine[place]] = answered(answers, n, "backoff", np.float64)
            seen = law.discount(n, counts[-1]) * counts[-1] / total[level.head]
            found.append(np.where(counts[-1] > 0, seen, backoff[level.head] * found[-1][level.tail]))
    return Evaluated(block, levels, counts, owned, found)


def summer(law: Law, left: float, order: int, n_buckets: int, n: int) -> Callable:
    """A block and its answers -> by history of order n: count, what discounting saves, and shorter histories' p of what was seen, of the n-grams it owns."""

    def run(state: pa.Table, answers: pa.Table) -> pa.Table:
        block, levels, counts, owned, p = evaluated(state, answers, law, left, order, n_buckets, n - 1, n)
        level, count = levels[-1], counts[-1]
        use = np.flatnonzero(owned[-1] & (count > 0))
        sums = [np.bincount(level.head[use], w, len(levels[-2].keys)) for w in (count[use], ((1 - law.discount(n, count)) * count)[use], p[n - 2][level.tail[use]])]
        mine = heads(levels, n)
        place, parts = dealt(levels[-2].keys[mine], n_buckets)
        mine = mine[place]
        columns = [sums[0][mine].astype(np.int64), sums[1][mine], sums[2][mine]]
        return pa.Table.from_batches([rows(SUMS, [(n, b, state["block"][0].as_py(), packed_keys(levels[-2].keys[mine[s:e]]), *(packed(c[s:e]) for c in columns)) for b, s, e in parts])])

    return run


def weigh_bucket(table: pa.Table) -> pa.Table:
    """A bucket's sums by history -> total and backoff of each, and the answers; a history not seen backs off with 1."""
    n, bucket = table["n"][0].as_py(), table["bucket"][0].as_py()
    blocks, bounds, (keys, *sums) = gathered(table, "total", "saved", "lower")
    place, starts, number = merged(keys)
    total, saved, lower = (np.add.reduceat(x[place], starts) for x in sums)
    seen = total > 0
    free = np.where(saved > 0, saved, 1.0)  # 1 is added where discounting saves nothing
    total = total + (seen & (saved <= 0))
    backoff = np.where(seen, free / np.maximum(total, 1) / np.maximum(1 - lower, np.finfo(float).eps), 1.0)
    total = np.maximum(total, 1)
    kept = place[starts[seen]]
    found = [("backoff", n, bucket, None, packed_keys(keys[kept]), packed(total[seen]), packed(backoff[seen]))]
    found += [("answer", n, bucket, b, None, packed(total[number[s:e]]), packed(backoff[number[s:e]])) for b, s, e in zip(blocks, bounds[:-1], bounds[1:], strict=True)]
    return pa.Table.from_batches([rows(WEIGHED, found)])


def scorer(law: Law, left: float, order: int, n_buckets: int) -> Callable:
    """A block and its answers -> its texts' scores."""

    def run(state: pa.Table, answers: pa.Table) -> pa.Table:
        block, levels, counts, _, p = evaluated(state, answers, law, left, order, n_buckets, order, order)
        of_token = np.where(block.event, np.log10(p[-1])[levels[-1].at], 0.0)
        known = counts[0] > 0
        base = np.log10((counts[0] + 1) / (law.tokens + law.words + 1))
        of_words = [block.event.astype(np.int64), (block.event & known[block.seq]).astype(np.int64), np.where(block.event, base[block.seq], 0.0)]
        per_text = [np.add.reduceat(x, block.starts) for x in (*of_words, of_token)]
        types = [pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        return pa.table([pa.array(block.ids, pa.int64()), pa.array(block.held), *(pa.array(x, t) for x, t in zip(per_text, types, strict=True))], names=[x.split()[0] for x in SCORED.split(", ")])

    return run


class Tables(NamedTuple):
    """The stored model: (n, bucket, keys, counts) of n-grams, (n, bucket, keys, total, backoff) of histories of the n-grams, and its law."""

    grams: DataFrame
    backoffs: DataFrame | None
    law: Law
    left: float


def written(df: DataFrame, path: str) -> DataFrame:
    """A table partitioned by kind."""
    df.write.option("compression", "zstd").partitionBy("kind").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def modelled(docs: DataFrame, folder: str, order: int = ORDER, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, Tables]:
    """docs (doc_id, text): (the scores of all, the model's tables), stored in the folder; the scores are read from it, too."""
    spark = docs.sparkSession
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD, F.lit(False))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held.alias("held"))
    size = texts.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    n_buckets, n_files = size // bucket_bytes + 1, max(FILES, size // FILE_BYTES + 1)

    name = f"katz_{uuid.uuid4().hex}"  # bucketed, so the later joins don't shuffle the texts
    made = texts.mapInArrow(blocker(order, block_bytes), BLOCKS)
    made.write.bucketBy(n_files, "block").option("path", f"{folder}/blocks").saveAsTable(name)
    blocks = spark.table(name)
    asked = blocks.mapInArrow(asker(order, n_buckets), ASKED)
    counted = written(asked.groupBy("n", "bucket").applyInArrow(count_bucket, COUNTED), f"{folder}/counts")

    sums = F.array(*[F.sum(F.col("stats")[k]) for k in range(LARGE + 3)])
    stats = {r.n: list(r.s) for r in counted.where("kind = 'gram'").groupBy("n").agg(sums.alias("s")).collect()}  # a row an order
    stats = [stats.get(n, [0] * (LARGE + 3)) for n in range(1, order + 1)]
    law = Law(stats[0][0], stats[0][1], tuple(discounts(s[2:]) for s in stats))
    left = sum((1 - d) * r * n for r, (d, n) in enumerate(zip(law.discounts[0], stats[0][2:], strict=False), 1))

    none = F.lit(None).cast("binary")
    answers = counted.where("kind = 'answer'").select("n", "bucket", "block", "counts", none.alias("total"), none.alias("backoff"))
    by_block = blocks.groupBy("block")
    weights = []
    for n in range(2, order + 1):
        sums = by_block.cogroup(answers.where(F.col("n") <= n).groupBy("block")).applyInArrow(summer(law, left, order, n_buckets, n), SUMS)
        weighed = written(sums.groupBy("n", "bucket").applyInArrow(weigh_bucket, WEIGHED), f"{folder}/weights-{n}")
        answers = answers.unionByName(weighed.where("kind = 'answer'").select("n", "bucket", "block", none.alias("counts"), "total", "backoff"))
        weights.append(weighed.where("kind = 'backoff'").select("n", "bucket", "keys", "total", "backoff"))
    scores = by_block.cogroup(answers.groupBy("block")).applyInArrow(scorer(law, left, order, n_buckets), SCORED)
    return scores, Tables(counted.where("kind = 'gram'").select("n", "bucket", "keys", "counts"), reduce(DataFrame.unionByName, weights) if weights else None, law, left)


def scored(docs: DataFrame, order: int = ORDER, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """docs (doc_id, text) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    folder = new_folder(spark, "katz")
    try:
        scores, tables = modelled(docs, folder, order, block_bytes, bucket_bytes)
        return common.written(scores.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tables.law.tokens).cast("long").alias("train_tokens"), "base_score", "score"), "katz-scores")
    finally:
        common.deleted(spark, folder)
