"""Token ids of all documents in a bit-packed block format.

Every id takes the fewest bits that hold the vocabulary. A block holds whole documents, about
`BLOCK_IDS` ids, packed low bits first into little-endian 64-bit words; the id at place k starts at
bit k * bits, so numpy unpacks a block at once and any run of ids by itself. Blocks are the rows of
a Parquet table that Spark's writer commits, so lost executors and any shared store are covered:

    shard int           range of doc_ids, ascending
    block int           in the shard, ascending
    shard_start long    ids in the shard before this block
    bits int, n_ids long
    doc_ids, n_tokens   the block's documents in order: array<long>, array<long>
    payload binary      ceil(n_ids * bits / 64) words

Documents are ordered by doc_id (null first), then by a hash of their text. The global offset of
a document is the sum of its shards', block's and own places; only one row a shard is summed.

Encoding. The ids are those of the tokenizer's plain encode without added special tokens; a special
token that stands in a text is that token's id, as the plain encode has it. The byte-level tokenizer
cuts a text before each single space, so pieces between spaces are encoded once, many at a time, and their ids
kept in a memo of the Python worker, flat arrays of bounded size, that serves all tasks of the stage; the first task of
another stage releases it. A slice's pieces are told apart, looked up and put in place as Arrow columns. Texts where a space is the middle or end of a run of white space, texts that hold a
special token, and other tokenizers, are encoded as a whole. Batches, slices and what the tokenizer gets at once are
bounded in bytes, so that a worker holds little besides its memo.

Defined results. A null text is empty: only the end id. Rows that repeat a doc_id are documents of
their own, in the order of a hash of their texts; which of equal rows comes first makes no difference.
A very long text is one row and one block: its ids stand in memory once, and only those. An empty
table makes an empty file. Extra columns are ignored and may have any names.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.slices import slices
from ..storage import new_folder
from . import kernels
from .common import BROADCAST_BYTES, configured, worker_cache

END_ID = 2
BLOCK_IDS = 1 << 16
#: A worker's memo holds at most so many pieces, so many bytes of them (each at most LONGEST) and so many bytes of their ids; beyond it the memo starts anew.
MEMO_PIECES, PIECE_BYTES, ID_BYTES, LONGEST = 1 << 19, 8 << 20, 16 << 20, 64
SCHEMA = "shard int, block int, shard_start long, bits int, n_ids long, doc_ids array<long>, n_tokens array<long>, payload binary"
#: A single space that isn't the last of a run of white space.
UNSAFE = r" (?<=\s )(?:\s|\Z)"

#: The space as byte-level vocabularies write it, and new pieces that are encoded as one text.
SPACE, TOGETHER = "\u0120", 256
#: A slice of a batch has at most so many texts, and so many bytes if it has more than one; so does what the tokenizer, whose results are large, gets at once.
SLICE_ROWS, SLICE_BYTES, CODED_BYTES = 1024, 1 << 19, 1 << 16
#: Rows, and bytes, that Spark sends to a worker at once.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1024", "spark.sql.execution.arrow.maxBytesPerBatch": f"{4 << 20}"}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def width(n_ids: int) -> int:
    """Bits for ids below n_ids."""
    return max(1, (n_ids - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids below 2**bits, bits <= 32, as little-endian words of 64 bits."""
    n_words = -(-len(ids) * bits // 64)
    if bits in (8, 16, 32):
        return np.asarray(ids).astype(f"<u{bits // 8}").tobytes().ljust(8 * n_words, b"\0")
    rows = -(-len(ids) // 64)
    padded = np.zeros((rows, 64), np.uint64)
    padded.ravel()[: len(ids)] = ids
    out = np.zeros((rows, bits), "<u8")
    for k in range(64):
        word, shift = divmod(k * bits, 64)
        out[:, word] |= padded[:, k] << np.uint64(shift)
        if shift + bits > 64:
            out[:, word + 1] |= padded[:, k] >> np.uint64(64 - shift)
    return out.ravel()[:n_words].tobytes()


def unpack(payload: bytes, bits: int, first: int, n: int) -> np.ndarray:
    """The n ids from place `first` on, reading only their words."""
    if n <= 0:
        return np.zeros(0, np.uint32)
    low = first * bits // 64
    words = np.frombuffer(payload, "<u8", offset=8 * low, count=-(-(first + n) * bits // 64) - low)
    if bits in (8, 16, 32):
        whole = words.view(f"<u{bits // 8}")
        return whole[first - low * 64 // bits :][:n].astype(np.uint32)
    at = np.arange(first, first + n, dtype=np.uint64) * np.uint64(bits) - np.uint64(64 * low)
    word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
    ids = words[word] >> shift
    over = shift + np.uint64(bits) > 64
    ids[over] |= words[word[over] + 1] << (np.uint64(64) - shift[over])
    return (ids & np.uint64((1 << bits) - 1)).astype(np.uint32)


def flat(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The offsets and bytes of binary values."""
    _, ends, data = values.buffers()
    if not len(values):
        return np.zeros(1, np.int32), np.zeros(0, np.uint8)
    at = np.frombuffer(ends, np.int32)[values.offset : values.offset + len(values) + 1]
    return at - at[0], np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]]


def piece_hashes(pieces: pa.Array) -> np.ndarray:
    """A hash of each piece; 0 for what isn't remembered: empty and long ones."""
    at, data = flat(pieces)
    lengths = np.diff(at)
    kept = (lengths > 0) & (lengths <= LONGEST)
    hashes = np.zeros(len(pieces), np.uint64)
    hashes[kept] = kernels.word_hashes(data, at[:-1][kept].astype(np.int64), at[1:][kept].astype(np.int64))
    return hashes


class Memo:
    """Pieces and their ids in flat arrays, which take memory as they fill; found by a hash in sorted order, then
    compared. Of two pieces of one hash the first is kept."""

    def __init__(self):
        self.n = 0
        self.sorted, self.entry = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.stores = [(np.zeros(MEMO_PIECES + 1, np.int32), np.empty(size, np.uint8)) for size in (PIECE_BYTES, ID_BYTES)]

    def column(self, k: int) -> pa.Array:
        ends, data = self.stores[k]
        return pa.Array.from_buffers(pa.binary(), self.n, [None, pa.py_buffer(ends), pa.py_buffer(data)])

    def find(self, pieces: pa.Array, hashes: np.ndarray) -> tuple[np.ndarray, pa.Array]:
        """Which pieces are known, and the ids of these."""
        found = np.zeros(len(pieces), bool)
        if not self.n:
            return found, pa.array([], pa.binary())
        at = np.minimum(np.searchsorted(self.sorted, hashes), self.n - 1)
        found = (self.sorted[at] == hashes) & (hashes != 0)
        entries = self.entry[at]
        same = pc.equal(self.column(0).take(pa.array(entries[found])), pieces.filter(pa.array(found)))
        found[found] = same.to_numpy(zero_copy_only=False)
        return found, self.column(1).take(pa.array(entries[found]))

    def keep(self, pieces: pa.Array, hashes: np.ndarray, ids: pa.Array) -> None:
        hashes, first = np.unique(hashes, return_index=True)
        at = np.searchsorted(self.sorted, hashes)
        new = hashes != 0
        new[new] = np.append(self.sorted, np.uint64(0))[at[new]] != hashes[new]
        hashes, first, at = hashes[new], first[new], at[new]
        added = [flat(x.take(pa.array(first))) for x in (pieces, ids)]
        if self.n + len(hashes) > MEMO_PIECES or any(ends[self.n] + len(more) > len(data) for (ends, data), (_, more) in zip(self.stores, added, strict=True)):
            self.__init__()
            return
        for (ends, data), (more_ends, more) in zip(self.stores, added, strict=True):
            low = ends[self.n]
            data[low : low + len(more)] = more
            ends[self.n + 1 : self.n + 1 + len(hashes)] = low + more_ends[1:]
        self.sorted = np.insert(self.sorted, at, hashes)
        self.entry = np.insert(self.entry, at, np.arange(self.n, self.n + len(hashes), dtype=np.int32))
        self.n += len(hashes)


class Encoder:
    """Texts to ids with one tokenizer."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        before = spec.get("pre_tokenizer") or {}
        self.by_piece = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not spec.get("normalizer")
        self.bits = width(max(self.tokenizer.get_vocab_size(), 1))
        # Added tokens are cut out of a text before anything else, so they may hold spaces or stand beside letters.
        added = [re.escape(t["content"]) for t in spec.get("added_tokens") or ()]
        self.added = re.compile("|".join(added)).search if added else lambda text: None
        self.spaced = re.compile(UNSAFE).search
        vocabulary = self.tokenizer.get_vocab()
        self.leads = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.leads[[k for token, k in vocabulary.items() if token.startswith(SPACE)]] = True
        self.forget()

    def forget(self) -> None:
        self.memo = Memo()

    def whole(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        while len(out) < len(texts):
            some, held = [], 0
            for text in texts[len(out) :]:
                if some and held + len(text) > CODED_BYTES:
                    break
                some.append(text)
                held += len(text)
            out += [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
        return out

    def pieces(self, pieces: list[str]) -> list[bytes]:
        """The ids of pieces, each behind a space. Many are one text for the tokenizer; a piece's ids begin
        where a token begins with the space. Pieces that begin or end with white space are encoded by themselves,
        and so are those whose text holds an added token or has another number of such tokens."""
        out: list[bytes] = [b""] * len(pieces)
        odd = [k for k, p in enumerate(pieces) if not p or len(p) > LONGEST or p != p.strip()]
        single = set(odd)
        plain = [k for k in range(len(pieces)) if k not in single]
        for low in range(0, len(plain), TOGETHER):
            some = plain[low : low + TOGETHER]
            text = " " + " ".join([pieces[k] for k in some])
            ids = np.frombuffer(self.whole([text])[0], "<u4")
            starts = np.flatnonzero(self.leads[ids])
            if len(starts) != len(some) or starts[0] or self.added(text):
                odd += some
                continue
            data, at = ids.tobytes(), (4 * starts).tolist()
            for k, (first, end) in zip(some, itertools.pairwise([*at, len(data)]), strict=True):
                out[k] = data[first:end]
        for k, ids in zip(odd, self.whole([" " + pieces[k] for k in odd]), strict=True):
            out[k] = ids
        return out

    def __call__(self, column: pa.Array | list[str | None]) -> list[np.ndarray]:
        column = (column if isinstance(column, pa.Array) else pa.array(column, pa.string())).fill_null("")
        texts = column.to_pylist()
        if not texts:
            return []
        safe = [self.by_piece and not self.spaced(x) and not self.added(x) for x in texts]
        split = pc.split_pattern(pc.if_else(pa.array(safe), column, ""), " ")
        bounds, parts = split.offsets.to_numpy(), split.values
        later = np.ones(len(parts), bool)
        later[bounds[:-1]] = False
        heads = [head if by_piece else text for head, by_piece, text in zip(parts.take(pa.array(bounds[:-1])).to_pylist(), safe, texts, strict=True)]
        coded = parts.filter(pa.array(later)).dictionary_encode()
        distinct = coded.dictionary.cast(pa.binary())
        hashes = piece_hashes(distinct)
        found, known = self.memo.find(distinct, hashes)
        fresh = coded.dictionary.filter(pa.array(~found))
        new = pa.array(self.pieces(fresh.to_pylist()), pa.binary())
        self.memo.keep(distinct.filter(pa.array(~found)), hashes[~found], new)
        # The ids of a slice's distinct pieces, then of its heads, are put in the order of the texts at once.
        place = np.empty(len(distinct), np.int64)
        place[found], place[~found] = np.arange(len(known)), np.arange(len(known), len(distinct))
        rows = np.empty(len(parts), np.int64)
        rows[later], rows[bounds[:-1]] = place[coded.indices.to_numpy()], np.arange(len(distinct), len(distinct) + len(texts))
        placed = pa.concat_arrays([x.cast(pa.large_binary()) for x in (known, new, pa.array(self.whole(heads), pa.large_binary()))]).take(pa.array(rows))
        _, ends, data = placed.buffers()
        ids = np.frombuffer(data or b"", "<u4")
        at = np.frombuffer(ends, np.int64)[bounds] // 4
        return [ids[a:b] for a, b in itertools.pairwise(at.tolist())]


def encoder(path: str, end_id: int, block_ids: int):
    """Sorted batches of (doc_id, text) -> blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = worker_cache()  # the tokenizer serves all tasks of a worker
        encode = kept[path] = kept.get(path) or Encoder(path)
        bits = max(encode.bits, width(end_id + 1))
        context = TaskContext.get()
        shard, block, start = context.partitionId() if context else 0, 0, 0
        docs: list[int | None] = []
        parts: list[np.ndarray] = []
        held = 0

        def close() -> pa.RecordBatch:
            ids = np.concatenate(parts)
            row = [[shard], [block], [start], [bits], [len(ids)], [docs], [[len(x) for x in parts]], [pack(ids, bits)]]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            names = ["shard", "block", "shard_start", "bits", "n_ids", "doc_ids", "n_tokens", "payload"]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, types, strict=True)], names)

        for batch in batches:
            for doc_ids, texts in slices(batch.columns, SLICE_ROWS, SLICE_BYTES) if batch.num_rows else ():
                for doc_id, ids in zip(doc_ids.to_pylist(), encode(texts), strict=True):
                    docs.append(doc_id)
                    parts.append(np.append(ids, np.uint32(end_id)))
                    held += len(ids) + 1
                    if held >= block_ids:
                        yield close()
                        block, start, docs, parts, held = block + 1, start + held, [], [], 0
        if parts:
            yield close()
        kernels.release()

    return run


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> str:
    """docs (doc_id, text) as a token file at `path`, in ascending doc_id order."""
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ranged = docs.select("doc_id", "text").repartitionByRange(*order).sortWithinPartitions(*order)
    with configured(docs.sparkSession, BATCH):
        ranged.mapInArrow(encoder(tokenizer or default_tokenizer(), end_id, block_ids), SCHEMA).write.option("compression", "zstd").parquet(path)
    return path


def decoder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks -> a row a document, from the unpacked ids."""
    for batch in batches:
        for at in range(batch.num_rows):
            row = batch.slice(at, 1).to_pylist()[0]
            lengths = np.array(row["n_tokens"], np.int64)
            ends = np.cumsum(lengths)
            ids = unpack(row["payload"], row["bits"], 0, row["n_ids"]).astype("<u4")
            crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(ends - lengths, ends, strict=True)]
            n = len(lengths)
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["doc_ids"], pa.int64()), pa.array([row["shard"]] * n, pa.int32()), pa.array([row["block"]] * n, pa.int32()), pa.array(row["shard_start"] + ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())],
                ["doc_id", "shard", "block", "shard_start", "n_tokens", "ids_crc32"],
            )


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, shard, block: from the ids in the file."""
    blocks = spark.read.schema(SCHEMA).parquet(path)
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    # One row a shard: a window over all of them stays small.
    before = shards.selectExpr("shard", "cast(coalesce(sum(n) over (order by shard rows between unbounded preceding and 1 preceding), 0) as long) as before")
    docs = blocks.mapInArrow(decoder, "doc_id long, shard int, block int, shard_start long, n_tokens long, ids_crc32 long")
    side = F.broadcast(before) if blocks.select("shard").distinct().count() * 64 <= BROADCAST_BYTES else before
    return docs.join(side, "shard").select("doc_id", (F.col("before") + F.col("shard_start")).alias("start"), "n_tokens", "ids_crc32", "shard", "block")


def tokenized(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Writes docs to a token file in the shared folder and reads it back."""
    spark = docs.sparkSession
    return read(spark, write(docs, new_folder(spark, "tokens"), tokenizer, end_id))
