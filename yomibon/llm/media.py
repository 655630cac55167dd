"""Media payloads as content-defined chunks: cut by a rolling gear hash, deduplicated, rebuilt and verified.

A document's payload is its UTF-8 text padded with zero bytes to a positive multiple of 64. A gear
hash over the last 16 bytes cuts it where the hash's upper bits are zero, between MIN_CHUNK and
MAX_CHUNK bytes, so equal passages give equal chunks wherever they stand.

Storage is two Parquet tables in the shared folder, committed by Spark's writer:

    packs   a row a document: the chunks that this document owns, compressed together
    lists   a row a document: the digests and lengths of all its chunks, in order, and their owner

Chunk digests are deduplicated by Spark joins: of all documents with a digest the least key owns
it. First only digests are moved; a digest of one document needs no join at all. Bytes are written
where they are read, and read back where they lie: only chunks that other documents refer to are
moved to these, deflated, and with them the packs of documents that lack some. So documents that share nothing are
not shuffled: references that are too many for a broadcast meet those documents only that a bitmap of fixed size
lets through. A chunk is moved by its digest once; one that more than REFERENCES refer to is copied in two
steps, so that no task makes more copies than about the root of their number; each copy serves REFERENCES documents.

Documents are told apart by a 64-bit hash of id and text. Two that share one by chance both keep the
chunks that only they have, and what is fetched for one is offered to both: nothing is lost by it.

The stored form of a document is its media file: a header, the chunk list, and the chunks as 8-bit
samples. It is rebuilt from the packs, every chunk checked against its digest and the payload
against its length; a mismatch raises an error.

Defined results. A null text is empty: 64 zero bytes. Equal texts give equal values. Rows that
repeat a doc_id are documents of their own, rows equal in id and text share their chunks. An empty
table gives an empty result. A very long text is one payload of many chunks, in memory by itself.
Extra columns are ignored and may have any names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels
from .common import BROADCAST_BYTES, bounded, scratch, written

MIN_CHUNK, MEAN_BITS, MAX_CHUNK = 512, 11, 8192
DIGEST = 16
PAD = 64
MAGIC = b"CHK1"
#: A fixed table of 16-bit gears, from a rule: the upper bits of multiples of an odd constant.
GEARS = (kernels.mix(np.arange(1, 257, dtype=np.uint64) * kernels.RADIX) >> np.uint64(48)).astype(np.uint16)


def payload(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + bytes(PAD - len(raw) % PAD if len(raw) % PAD or not raw else 0)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The gear hash at each byte, over the last 16 bytes: h = 2 h + gear, modulo 2**16."""
    h = GEARS[data]
    for k in (1, 2, 4, 8):
        h[k:] += h[:-k] << np.uint16(k)
    return h


def cuts(data: np.ndarray, hashes: np.ndarray) -> list[int]:
    """The ends of the chunks."""
    n = len(data)
    found = np.flatnonzero(hashes >> np.uint16(16 - MEAN_BITS) == 0) + 1
    ends, last = [], 0
    while n - last > MIN_CHUNK:
        k = int(np.searchsorted(found, last + MIN_CHUNK))
        end = min(int(found[k]) if k < len(found) else n, last + MAX_CHUNK, n)
        ends.append(end)
        last = end
    if last < n:
        ends.append(n)
    return ends


def chunks(data: bytes) -> list[bytes]:
    view = np.frombuffer(data, np.uint8)
    ends = cuts(view, gear_hashes(view))
    return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=DIGEST).digest()


def media(parts: list[bytes]) -> bytes:
    """The stored form: header, list of (digest, length), samples."""
    listed = b"".join(digest(p) + struct.pack("<I", len(p)) for p in parts)
    return MAGIC + struct.pack("<I", len(parts)) + listed + b"".join(parts)


def feature(samples: np.ndarray) -> str:
    """Mean, deviation and entropy of the samples, and the share of steps that cross the mean."""
    counts = np.bincount(samples, minlength=256)
    values, n = np.arange(256), len(samples)
    mean = float(counts @ values) / n
    deviation = float(np.sqrt(max(0.0, float(counts @ values**2) / n - mean**2)))
    shares = counts[counts > 0] / n
    above = samples > mean
    crossings = int(np.count_nonzero(above[1:] != above[:-1])) / max(1, n - 1)
    return f"mean={mean:.4f};dev={deviation:.4f};entropy={-float(shares @ np.log2(shares)):.4f};cross={crossings:.4f}"


LISTED = "key long, digest binary"
PACKED = "key long, doc_id long, n_bytes long, digests binary, sizes array<int>, own array<boolean>, samples binary"
MEASURED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_chunks long"


def lister(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, doc_id, text) -> the distinct digests of each document."""
    for batch in batches:
        rows, digests = [], []
        for row, text in enumerate(batch.column(2).to_pylist()):
            own = {digest(c) for c in chunks(payload(text))}
            rows += [row] * len(own)
            digests += own
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(digests, pa.binary())], ["key", "digest"])


def packer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, doc_id, text, foreign) -> a pack row: the list of chunks, and the bytes of those it owns."""
    for batch in batches:
        sizes_of, digests, sizes, own, samples = [], [], [], [], []
        for text, foreign in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            known = set(foreign or ())  # a repeated chunk of the document itself is kept once
            parts = chunks(payload(text))
            listed = [digest(p) for p in parts]
            mine = []
            for d in listed:
                mine.append(d not in known)
                known.add(d)
            sizes_of.append(len((text or "").encode()))
            digests.append(b"".join(listed))
            sizes.append([len(p) for p in parts])
            own.append(mine)
            samples.append(b"".join(p for p, m in zip(parts, mine, strict=True) if m))
        types = [pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.binary()]
        columns = [pa.array(c, t) for c, t in zip([sizes_of, digests, sizes, own, samples], types, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["key", "doc_id", "n_bytes", "digests", "sizes", "own", "samples"])


def owned(digests: bytes, sizes: list[int], own: list[bool], samples: bytes) -> tuple[list[bytes], dict[bytes, bytes]]:
    """The digests in order, and the bytes of the chunks that a pack holds, each checked."""
    listed = [digests[k : k + DIGEST] for k in range(0, len(digests), DIGEST)]
    held, at = {}, 0
    for d, n, mine in zip(listed, sizes, own, strict=True):
        if mine:
            held[d] = samples[at : at + n]
            at += n
            if digest(held[d]) != d:
                raise ValueError("a stored chunk doesn't match its digest")
    return listed, held


def fetcher(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packs with the digests wanted of them -> (digest, salts, bytes deflated), once each."""
    for batch in batches:
        digests, salts, found = [], [], []
        for row in batch.to_pylist():
            _, held = owned(row["digests"], row["sizes"], row["own"], row["samples"])
            for want in row["wanted"]:
                if want["digest"] in held:  # else another document of this key has it
                    digests.append(want["digest"])
                    salts.append(want["salts"])
                    found.append(zlib.compress(held[want["digest"]]))
        yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(salts, pa.int64()), pa.array(found, pa.binary())], ["digest", "salts", "bytes"])


def deflater(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packs -> packs whose samples are deflated, to be moved."""
    at = PACKED.split(", ").index("samples binary")
    for batch in batches:
        samples = pa.array([zlib.compress(x.as_py()) for x in batch.column(at)], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns[:at], samples], batch.schema.names)


def rebuilder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packs, moved with their foreign chunks or not -> what is measured on the rebuilt media."""
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            samples = zlib.decompress(row["samples"]) if row["moved"] else row["samples"]
            listed, held = owned(row["digests"], row["sizes"], row["own"], samples)
            for other in row["fetched"] or ():
                chunk = zlib.decompress(other["bytes"])
                if digest(chunk) != other["digest"]:
                    raise ValueError("a fetched chunk doesn't match its digest")
                held[other["digest"]] = chunk
            parts = [held[d] for d in listed]
            data, stored = b"".join(parts), media(parts)
            if len(data) != sum(row["sizes"]) or len(data) % PAD:
                raise ValueError("a rebuilt payload doesn't have its length")
            rows.append(
                (row["doc_id"], row["n_bytes"], len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-PAD:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(np.frombuffer(data, np.uint8)), len(parts))
            )
        names = [x.split()[0] for x in MEASURED.split(", ")]
        types = [pa.string() if " string" in x else pa.int64() for x in MEASURED.split(", ")]
        columns = list(zip(*rows, strict=True)) or [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


#: References that one copy of a fetched chunk serves; a chunk with more is fetched in several copies.
REFERENCES = 512
#: Bytes that a reference takes in a broadcast table at most.
REFERENCE_BYTES = 64
#: Bitmaps of keys, of 4 KB each; at most 32 MB in all.
BITMAPS, BITMAP_BITS = 1 << 13, 1 << 15


def document_key() -> Column:
    return F.xxhash64("doc_id", "text")


def slot(key: Column) -> list[Column]:
    """A key's bitmap and its place there."""
    return [F.pmod(key, F.lit(BITMAPS)).alias("bitmap"), F.pmod(F.shiftright(key, 13), F.lit(BITMAP_BITS)).alias("place")]


def joined(df: DataFrame, side: DataFrame, rows: int, how: str) -> DataFrame:
    """df with the rows of side by key, inner or left. A side of many rows is met by those rows of df only that may have one; the others stay where they are."""
    if rows * REFERENCE_BYTES <= BROADCAST_BYTES:
        return df.join(F.broadcast(side), "key", how)
    bits = side.select(*slot(F.col("key"))).groupBy("bitmap").agg(F.bitmap_construct_agg("place").alias("bits"))
    there = F.expr("coalesce(shiftright(cast(conv(hex(substring(bits, cast(place div 8 as int) + 1, 1)), 16, 10) as int), cast(place % 8 as int)) & 1, 0) = 1")
    marked = df.select("*", *slot(F.col("key"))).join(F.broadcast(bits), "bitmap", "left")
    met = marked.where(there).select(*df.columns).join(side, "key", how)
    if how == "inner":
        return met
    return marked.where(~there).select(*df.columns).unionByName(met, allowMissingColumns=True)


def stored(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs (doc_id, text) -> the written packs, and the references (key, digest, owner, salts) to foreign chunks."""
    keyed = docs.select(document_key().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    with scratch(docs.sparkSession) as short:
        listed = short(keyed.mapInArrow(lister, LISTED), "digests")
        shared = listed.groupBy("digest").agg(F.min("key").alias("owner"), F.max("key").alias("last"), F.count(F.lit(1)).alias("n")).where("owner <> last")
        shared = short(shared.select("digest", "owner", F.ceil(F.col("n") / REFERENCES).alias("salts")), "shared")
        references = written(listed.join(bounded(shared, shared.count(), REFERENCE_BYTES), "digest").where("key <> owner").distinct(), "references")
    foreign = references.groupBy("key").agg(F.collect_list("digest").alias("foreign"))
    packs = joined(keyed, foreign, references.count(), "left").select("key", "doc_id", "text", "foreign").mapInArrow(packer, PACKED)
    return written(packs, "packs", codec="zstd"), references


def measured(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> what is measured on the media of each document, read back from storage."""
    packs, references = stored(docs)
    n = references.count()
    wanted = references.select("digest", "owner", "salts").distinct().groupBy(F.col("owner").alias("key")).agg(F.collect_list(F.struct("digest", "salts")).alias("wanted"))
    fetched = joined(packs, wanted, n, "inner").select("digests", "sizes", "own", "samples", "wanted").mapInArrow(fetcher, "digest binary, salts long, bytes binary")
    # Rows equal in id and text have one key: any of their packs has the chunk.
    fetched = fetched.dropDuplicates(["digest"])
    # Most chunks serve few documents: they are joined where they lie by their digests. Only the others are copied.
    asked = references.select("key", "digest", "salts")
    few = asked.where("salts = 1").select("key", "digest").join(fetched.where("salts = 1").select("digest", "bytes"), "digest")
    root = F.ceil(F.sqrt("salts"))
    stems = fetched.where("salts > 1").withColumn("stem", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("salts") / root) - 1))).repartition("digest", "stem")
    copies = stems.select("digest", "bytes", F.explode(F.sequence(F.col("stem") * root, F.least((F.col("stem") + 1) * root, "salts") - 1)).alias("salt"))
    many = asked.where("salts > 1").select("key", "digest", F.pmod(F.xxhash64("key"), F.col("salts")).alias("salt")).join(copies, ["digest", "salt"])
    given = few.select("key", "digest", "bytes").unionByName(many.select("key", "digest", "bytes")).groupBy("key").agg(F.collect_list(F.struct("digest", "bytes")).alias("fetched"))
    whole = packs.where(F.forall("own", lambda x: x)).select("*", F.lit(False).alias("moved"), F.lit(None).cast("array<struct<digest:binary,bytes:binary>>").alias("fetched"))
    parts = packs.where(~F.forall("own", lambda x: x)).mapInArrow(deflater, PACKED).withColumn("moved", F.lit(True)).join(given, "key", "left")
    return whole.unionByName(parts).mapInArrow(rebuilder, MEASURED)
