"""Near-duplicate groups of documents by ProbMinHash, banding and verification.

A document is the set of its five-word shingles, each of weight 1 however often it occurs: links are
similarities of sets, and weights by count would move copies that repeat lines apart. Each shingle
sends a Poisson process of its weight's rate over the registers; a register keeps the shingle that
arrives first, so two documents agree in a register with their probability Jaccard similarity, which
is that of the sets. A document stops drawing once no arrival can beat the latest of its registers.
All processes of a batch run as arrays, round by round, on the arrivals still in play.

1. Sketches: `bands` keys of `rows` registers each, and a digest of the shingle set. A digest is a
   node, so copies never meet in pairs. Rows of one doc_id link the nodes of their texts.
2. Banding: in each bucket the node with most bucket mates is the hub, as it is likely what others
   were copied from; the others are checked against it. Pairs are verified exactly: Jaccard
   similarity of the shingle sets of both whole texts, `threshold` or more. A hub's set is sent once
   for SHARE of its pairs, so neither its set is repeated a pair nor do all its pairs meet in a task.
3. Connected components of the verified links (large and small star steps, each written).
4. What hubs leave open: the nodes of buckets that still hold several components (Jaccard distance
   is a metric, so distances to the hub rule many out) are joined with each other by the rarest
   shingles of each, a prefix filter that loses no pair, and verified too. At the end every two nodes
   of a bucket are verified, ruled out or in one component, without pairs within a component.

At similarity 0.8 a pair misses all of 24 bands of 5 rows with probability 7e-5.

Defined results. A document without words (null, empty, symbols only) is a class of its own. A
document of fewer than five words is one shingle. A doc_id is one document, whatever its rows: they
get one class, that of all their texts. Rows without a doc_id take no part: their class is null, of
size 1, and keep_one() keeps them. The class id is the least doc_id of the class. A very long text
is one set of shingles, in memory by itself. Further columns of the input, whatever their names, are
ignored by classes() and kept by keep_one().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels
from .common import bounded, scratch, spare_name, written

SIZE, THRESHOLD = 5, 0.8
BANDS, ROWS = 24, 5
#: Pairs of a hub, and nodes of a shingle, that are dealt to one task together.
SHARE = 512
#: Shingle ids have 48 bits; the upper 16 hold the row in a piece of a batch.
ID = np.uint64(0xFFFFFFFFFFFF)


def unique_shingles(data: np.ndarray, offsets: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, row, count) of the distinct shingles of each row, by row; at most 65536 rows."""
    starts, ends, rows = kernels.word_spans(data, offsets)
    hashes, rows = kernels.shingles(kernels.word_hashes(kernels.LOWERED[data], starts, ends), rows, size)
    keys, counts = np.unique((rows.astype(np.uint64) << np.uint64(48)) | (hashes >> np.uint64(16)), return_counts=True)
    return keys & ID, (keys >> np.uint64(48)).astype(np.int64), counts


def prob_minhash(ids: np.ndarray, rows: np.ndarray, weights: np.ndarray, n: int, registers: int) -> np.ndarray:
    """[n, registers]: the shingle that arrives first in each register; 0 for rows without shingles."""
    arrival, owner = np.full(n * registers, np.inf), np.zeros(n * registers, np.uint64)
    counts = np.bincount(rows, minlength=n)
    alone = counts[rows] == 1  # the only shingle takes all registers
    owner.reshape(n, registers)[rows[alone]] = ids[alone, None]
    ids, rows, rates = ids[~alone], rows[~alone], 1 / weights[~alone]
    state, at = ids.copy(), np.zeros(len(ids))
    while len(ids):
        state += kernels.RADIX
        draw = kernels.mix(state)
        # 40 bits make the exponential waiting time, the other 24 choose the register.
        at = at - np.log(((draw >> np.uint64(24)).astype(np.float64) + 0.5) * 2.0**-40) * rates
        cell = rows * registers + ((draw & np.uint64(0xFFFFFF)) * np.uint64(registers) >> np.uint64(24)).astype(np.int64)
        np.minimum.at(arrival, cell, at)
        first = arrival[cell] == at
        owner[cell[first]] = ids[first]
        latest = arrival.reshape(n, registers).max(axis=1)
        on = at < latest[rows]
        ids, rows, rates, state, at = ids[on], rows[on], rates[on], state[on], at[on]
    return owner.reshape(n, registers)


def band_keys(owner: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """[n, bands]: a hash of each band's registers and its number."""
    total = np.zeros((len(owner), bands), np.uint64)
    for k in range(rows):
        total = kernels.mix(total * kernels.RADIX + owner[:, k::rows] + np.uint64(k + 1))
    return kernels.mix(total + np.arange(1, bands + 1, dtype=np.uint64))


def shingled(column: pa.Array, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, ids, row of each id) of pieces of a column of texts: their distinct shingles."""
    for first, end, data, offsets in kernels.pieces(column):
        for low in range(0, end - first, 1 << 15):
            cut = offsets[low : low + (1 << 15) + 1]
            ids, rows, _ = unique_shingles(data[cut[0] : cut[-1]], cut - cut[0], size)
            yield first + low, len(cut) - 1, ids, rows


def digests(ids: np.ndarray, starts: np.ndarray) -> pa.Array:
    """A digest of 128 bits of each set of ids; the sets begin at `starts`."""
    sums = [np.add.reduceat(kernels.mix(ids + np.uint64(salt)), starts) for salt in (1 << 50, 1 << 51)]
    raw = np.stack(sums, axis=1).astype("<u8").tobytes()
    return pa.Array.from_buffers(pa.binary(16), len(starts), [None, pa.py_buffer(raw)]).cast(pa.binary())


def sketcher(size: int, bands: int, band_rows: int):
    """Batches of (doc_id, text) -> (doc_id, digest, keys), without the documents that have no words."""

    @kernels.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n, ids, rows in shingled(batch.column(1), size):
                bounds = kernels.grouped(rows, n)
                held = np.flatnonzero(bounds[1:] > bounds[:-1])
                if len(held):
                    keys = band_keys(prob_minhash(ids, rows, np.ones(len(ids)), n, bands * band_rows), bands, band_rows)[held].view(np.int64)
                    listed = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, bands, dtype=np.int32)), pa.array(keys.ravel()))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n).take(pa.array(held)), digests(ids, bounds[held]), listed], ["doc_id", "digest", "keys"])

    return run


def shingler(size: int):
    """Batches of texts -> (digest, ids): the distinct shingles of each text that has words."""

    @kernels.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, n, ids, rows in shingled(batch.column(0), size):
                bounds = kernels.grouped(rows, n)
                held = np.flatnonzero(bounds[1:] > bounds[:-1])
                if len(held):  # rows without words have no ids, so the others' lists follow each other
                    ends = pa.array(np.append(bounds[held], len(ids)).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([digests(ids, bounds[held]), pa.ListArray.from_arrays(ends, pa.array(ids.view(np.int64)))], ["digest", "ids"])

    return run


@kernels.tidy
def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (hub, salt, node, ids), by hub and salt, the hub's own set (node null) first -> hub, node, similarity."""
    own, mine = None, np.zeros(0, np.int64)
    for batch in batches:
        n = batch.num_rows
        hubs, salts = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        sets = batch.column(3)
        ends = sets.offsets.to_numpy()
        ids = sets.values.to_numpy(zero_copy_only=False)
        is_hub = batch.column(2).is_null().to_numpy(zero_copy_only=False)
        edges = np.flatnonzero((hubs[1:] != hubs[:-1]) | (salts[1:] != salts[:-1])) + 1
        similarity = np.zeros(n)
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), n], strict=True):
            if a == b:
                continue
            if is_hub[a]:
                own, mine = (hubs[a], salts[a]), ids[ends[a] : ends[a + 1]]
                a += 1
            if a == b:
                continue
            if own != (hubs[a], salts[a]):
                raise ValueError("a pair came without its hub")
            theirs = ids[ends[a] : ends[b]]
            at = np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)
            both = np.add.reduceat((mine[at] == theirs).astype(np.int64), ends[a:b] - ends[a])
            similarity[a:b] = both / (len(mine) + np.diff(ends[a : b + 1]) - both)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(similarity)], ["hub", "node", "similarity"]).filter(pa.array(~is_hub))


def similarity(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (hub, node), distinct, and sets (node, ids), sorted ids -> hub, node, similarity."""
    number = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / SHARE).cast("int").alias("salts"))
    asked = pairs.join(number, "hub").select("hub", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int").alias("salt"), "node").join(sets, "node")
    # A salt without pairs gets the hub's set for nothing; it is a small part of what its pairs take.
    given = number.join(sets, F.col("hub") == F.col("node")).select("hub", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("node"), "ids")
    both = given.unionByName(asked).repartition("hub", "salt").sortWithinPartitions("hub", "salt", F.col("node").asc_nulls_first())
    return both.select("hub", "salt", "node", "ids").mapInArrow(compared, "hub long, node long, similarity double")


def prefix_pairs(placed: DataFrame, sets: DataFrame, threshold: float, keep=written) -> DataFrame:
    """placed (node, root) -> all pairs (hub, node) of different roots that can be similar, by prefix filtering.

    Shingles stand in order of their frequency, rarest first. Two sets with Jaccard similarity t or more
    share one of the first n - ceil(t n) + 1 of each; shingles of one node only fill that prefix first.
    Lengths and the positions of the common shingle bound the pairs further; none that can be similar is lost.
    The nodes of a frequent shingle are dealt in shares of SHARE.
    """
    own = sets.join(placed.select("node"), "node", "left_semi")
    each = keep(own.select("node", F.size("ids").alias("n"), F.explode("ids").alias("id")), "shingles")
    counts = each.groupBy("id").agg(F.count(F.lit(1)).alias("nodes")).where("nodes > 1")
    shared = each.join(counts, "id").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("nodes", "id"))).alias("shared"))
    alone = F.col("n") - F.size("shared")
    length = F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1 - alone
    prefix = shared.where(length > 0).select("node", "n", alone.alias("alone"), F.posexplode(F.slice("shared", F.lit(1), length.cast("int"))).alias("pos", "s"))
    prefix = prefix.select("node", "n", (F.col("n") - F.col("alone") - F.col("pos")).alias("left"), F.col("s.id").alias("id"))
    prefix = keep(prefix.join(placed, "node"), "prefix")
    by = prefix.groupBy("id", "root").agg(F.count(F.lit(1)).alias("nodes"))
    main = by.groupBy("id").agg(F.max_by("root", F.struct("nodes", "root")).alias("main"), F.count(F.lit(1)).alias("roots"), F.ceil(F.sum("nodes") / SHARE).cast("int").alias("salts"))
    mixed = prefix.join(main.where("roots > 1").select("id", "main", "salts"), "id")
    outside = mixed.where("root <> main").select(
        "id", F.col("node").alias("x"), F.col("n").alias("x_n"), F.col("left").alias("x_left"), F.col("root").alias("x_root"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")
    )
    mixed = mixed.withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int"))
    # Nothing before the first common shingle is shared, so what is left of either set bounds the overlap.
    overlap = F.least("left", "x_left") >= (F.col("n") + F.col("x_n")) * (threshold / (1 + threshold)) - 1e-6
    near = overlap & (F.col("n") >= F.col("x_n") * (threshold - 1e-9)) & (F.col("x_n") >= F.col("n") * (threshold - 1e-9))
    found = outside.join(mixed, ["id", "salt"]).where((F.col("root") != F.col("x_root")) & near)
    return found.select(F.least("x", "node").alias("hub"), F.greatest("x", "node").alias("node")).distinct()


def components(links: DataFrame, keep=written, name: str = "links") -> DataFrame:
    """links (a, b) -> (node, root): each node's least connected node, by large and small star steps."""
    edges = keep(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), name)
    state = None
    while True:
        # Large star: a node's greater neighbours move to its least neighbour.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: a node and its lesser neighbours move to the least of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges = keep(small, name)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
        state = now


def unresolved(hubbed: DataFrame, done: DataFrame, roots: DataFrame, threshold: float, keep=written) -> DataFrame:
    """(node, root) of the nodes in buckets that still hold several components.

    Jaccard distance is a metric, so two nodes whose distances to one hub differ by more than
    1 - threshold can't be similar; a node without any such partner in a bucket is dropped.
    """
    left = hubbed.join(done.select("hub", "node", (1 - F.col("similarity")).alias("far")), ["hub", "node"])
    left = left.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"), "far")
    left = keep(left, "left")
    # In slices of the reach, partners are in the same or in neighbouring ones.
    slices = F.floor(F.col("far") / (1 - threshold + 1e-9)).cast("int")
    around = left.select("key", "root", F.explode(F.array(slices - 1, slices, slices + 1)).alias("slice"))
    mixed = around.groupBy("key", "slice").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key", "slice")
    return left.withColumn("slice", slices).join(mixed, ["key", "slice"]).select("node", "root").distinct()


def classes(docs: DataFrame, size: int = SIZE, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """docs (doc_id, text) -> doc_id, class_id: a row for each doc_id that has words, written."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    with scratch(docs.sparkSession) as keep:
        sketches = keep(docs.mapInArrow(sketcher(size, bands, rows), "doc_id long, digest binary, keys array<long>"), "sketches")
        # Written, so the ids hold: an attempt of a task that fails leaves none.
        nodes = sketches.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.min_by("keys", "doc_id").alias("keys"))
        nodes = keep(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
        members = keep(sketches.select("doc_id", "digest").join(nodes.select("digest", "node"), "digest").select("doc_id", "node").distinct(), "members")
        # Rows of one doc_id with several texts link the nodes of these.
        several = members.groupBy("doc_id").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
        linked = members.join(several, "doc_id").where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))

        buckets = nodes.select("node", F.explode("keys").alias("key"))
        counts = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        full = keep(buckets.join(counts, "key"), "buckets")
        # The node with most bucket mates is the likeliest to be what others were copied from.
        weights = keep(full.groupBy("node").agg(F.sum("n").alias("weight")), "weights")
        full = keep(full.join(weights, "node").select("key", "node", "weight"), "weighted")
        hubs = full.groupBy("key").agg(F.max_by("node", F.struct("weight", -F.col("node"))).alias("hub"))
        hubbed = keep(full.join(hubs, "key").where("node <> hub").select("key", "hub", "node"), "hubbed")
        needed = keep(nodes.join(weights.select("node"), "node", "left_semi").select("digest", "node", "doc_id"), "needed")
        owners = needed.select(F.col("doc_id").alias("owner")).distinct()
        texts = docs.join(bounded(owners, needed.count(), 16), F.col("doc_id") == F.col("owner"), "left_semi").select("text")
        # A doc_id may have other texts too, and equal rows: their sets are left out, by digest.
        sets = keep(texts.mapInArrow(shingler(size), "digest binary, ids array<long>").join(needed.select("digest", "node"), "digest").dropDuplicates(["digest"]).select("node", "ids"), "sets")

        done = keep(similarity(hubbed.select("hub", "node").distinct(), sets), "similarities")
        links = done.where(F.col("similarity") >= threshold).select(F.col("hub").alias("a"), F.col("node").alias("b")).unionByName(linked)
        roots = keep(components(links, keep), "roots")
        # What hubs leave open is joined by prefixes, across components.
        placed = keep(unresolved(hubbed, done, roots, threshold, keep), "placed")
        known = done.select(F.least("hub", "node").alias("hub"), F.greatest("hub", "node").alias("node"))
        rest = keep(prefix_pairs(placed, sets, threshold, keep).join(known, ["hub", "node"], "left_anti"), "rest")
        if not rest.isEmpty():
            extra = keep(similarity(rest, sets).where(F.col("similarity") >= threshold).select(F.col("hub").alias("a"), F.col("node").alias("b")), "extra")
            if not extra.isEmpty():
                roots = keep(components(links.unionByName(extra), keep), "roots")
        placed = members.join(roots, "node", "left").select("doc_id", F.coalesce("root", "node").alias("root"))
        least = placed.groupBy("root").agg(F.min("doc_id").alias("class_id"))
        return written(placed.join(least, "root").select("doc_id", "class_id").distinct(), "classes")


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, class_id, class_size: a row for each row of docs."""
    known = classes(docs, **options).withColumnRenamed("doc_id", "known")
    # Rows without words took no part: they are classes of their own.
    every = docs.select("doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    rows = every.join(known, F.col("doc_id") == F.col("known"), "left")
    rows = rows.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), "n")
    sizes = rows.where("class_id is not null").groupBy("class_id").agg(F.sum("n").alias("class_size"))
    rows = rows.join(sizes, "class_id", "left").select("doc_id", "class_id", F.coalesce("class_size", F.lit(1)).alias("class_size"), "n")
    return rows.select("doc_id", "class_id", "class_size", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy")).drop("copy")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs without those whose class has a lesser doc_id; of rows that repeat a doc_id, one stays."""
    gone = classes(docs, **options).where("doc_id <> class_id").select(F.col("doc_id").alias("gone"))
    repeated = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 and doc_id is not null").select(F.col("doc_id").alias("gone"))
    marks = written(gone.withColumn("why", F.lit(1)).unionByName(repeated.withColumn("why", F.lit(2))).groupBy("gone").agg(F.min("why").alias("why")), "gone")
    key, turn = spare_name(docs.columns, "gone"), spare_name(docs.columns, "turn")
    out = marks.where("why = 1").select(F.col("gone").alias(key))
    left = docs.join(bounded(out, out.count(), 16), F.col("doc_id") == F.col(key), "left_anti")
    again = marks.where("why = 2").select(F.col("gone").alias(key))
    if again.isEmpty():
        return left
    first = Window.partitionBy("doc_id").orderBy(F.xxhash64(*[c for c in docs.columns if c != "doc_id"]))
    one = left.join(again, F.col("doc_id") == F.col(key), "left_semi").withColumn(turn, F.row_number().over(first)).where(F.col(turn) == 1).drop(turn)
    return left.join(again, F.col("doc_id") == F.col(key), "left_anti").unionByName(one)
