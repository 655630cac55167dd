"""Katz backoff, VA-file codes and centroid clustering against brute force, with awkward rows."""

import hashlib
import math
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from yomibon.llm import centroids, katz, va_file

TEXTS = [
    (1, "The cat sat on the mat . the cat ran"),
    (2, "the cat sat on the hat"),
    (3, None),
    (4, ""),
    (5, " \t the\ndog\x0bsat \x0c on\rthe cat "),
    (6, "the cat sat on the mat . the cat ran"),
    (6, "a second row of this id"),
    (None, "no id, but words the cat"),
    (7, "unknown words everywhere the cat ünï code ÄB"),
    (8, "b " * 3000 + "the cat"),
    *[(k, f"the cat w{k} sat x{k % 3} on y{k % 7}") for k in range(20, 60)],
]


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def tokens(text):
    return (text or "").encode().lower().split() + [b"\n"]


class Katz:
    """The definition, n-gram by n-gram, in dictionaries."""

    def __init__(self, texts, order):
        self.order, self.grams = order, [Counter() for _ in range(order)]
        for t in texts:
            padded = [b" "] * (order - 1) + t
            for at in range(order - 1, len(padded)):
                for n in range(1, order + 1):
                    self.grams[n - 1][tuple(padded[at - n + 1 : at + 1])] += 1
        self.d = [katz.discounts([sum(c == r for c in g.values()) for r in range(1, 7)]) for g in self.grams]
        self.tokens, self.words = sum(self.grams[0].values()), len(self.grams[0])
        self.after = Counter()
        for n in range(1, order + 1):
            for g, c in self.grams[n - 1].items():
                self.after[g[:-1], n] += c
        self.cache = {}

    def discount(self, n, c):
        return self.d[n - 1][c - 1] if c <= 5 else 1.0

    def weights(self, h):
        n = len(h) + 1
        if (h, n) not in self.cache:
            total = self.after[h, n]
            seen = [(g[-1], c) for g, c in self.grams[n - 1].items() if g[:-1] == h]
            left = sum((1 - self.discount(n, c)) * c for _, c in seen)
            if left <= 0:
                total, left = total + 1, 1
            below = sum(self.p(h[1:], w) for w, _ in seen) if n > 1 else 0
            self.cache[h, n] = total, left / total / (1 - below)
        return self.cache[h, n]

    def p(self, h, w):
        n, c = len(h) + 1, self.grams[len(h)][(*h, w)]
        if n > 1 and not self.after[h, n]:
            return self.p(h[1:], w)
        total, backoff = self.weights(h)
        if c:
            return self.discount(n, c) * c / total
        return backoff * (self.p(h[1:], w) if n > 1 else 1.0)

    def score(self, t):
        padded = [b" "] * (self.order - 1) + t
        return sum(math.log10(self.p(tuple(padded[at - self.order + 1 : at]), padded[at])) for at in range(self.order - 1, len(padded)))


@pytest.mark.parametrize("order", [1, 2, 3])
def test_katz(spark, order):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").select("*", F.lit(1).alias("score"), F.lit(2).alias("block"), F.lit(3).alias("n")).repartition(3)
    # Blocks of a few texts and buckets of few n-grams, so that all exchanges have many parts.
    got = katz.scored(docs, order=order, block_bytes=150, bucket_bytes=700).collect()
    model = Katz([tokens(t) for k, t in TEXTS if not held(k)], order)
    want = []
    for k, t in TEXTS:
        own = tokens(t)
        base = sum(math.log10((model.grams[0][w,] + 1) / (model.tokens + model.words + 1)) for w in own)
        want.append((k, held(k), len(own), sum(model.grams[0][w,] > 0 for w in own), model.tokens, base, model.score(own)))
    key = lambda r: (r[0] is None, r[0] or 0, r[6])
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert g[:5] == w[:5]
        assert g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=1e-9)


def test_katz_is_normalised():
    model = Katz([tokens(t) for _, t in TEXTS], 3)
    words = [*{g[0] for g in model.grams[0]}, b"never seen"]
    for h in [(), (b"the",), (b"b",), (b"nowhere",), (b"on", b"the"), (b"b", b"b"), (b" ", b" "), (b"mat", b"hat")]:
        assert sum(model.p(h, w) for w in words) == pytest.approx(1, abs=1e-12)


def test_katz_without_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert katz.scored(empty).count() == 0
    one = next(k for k in range(100) if held(k))
    rows = katz.scored(spark.createDataFrame([(one, "only held out")], "doc_id long, text string")).collect()
    assert [tuple(r) for r in rows] == [(one, True, 4, 0, 0, 0.0, 0.0)]


def test_katz_stores_its_model(spark, tmp_path):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    _, tables = katz.modelled(docs, f"file://{tmp_path}/model")
    model = Katz([tokens(t) for k, t in TEXTS if not held(k)], 2)
    for n in (1, 2):
        counts = np.concatenate([katz.unpacked(r.counts) for r in tables.grams.where(f"n = {n}").collect()])
        assert sorted(counts.tolist()) == sorted(model.grams[n - 1].values())
    totals = np.concatenate([katz.unpacked(r.total) for r in tables.backoffs.collect()])
    assert sorted(totals.tolist()) == sorted(model.weights(h)[0] for h, n in model.after if n == 2)


def test_katz_tells_held_out_texts_better_than_single_words(spark, sf_dir):
    rows = katz.scored(spark.read.parquet(f"{sf_dir}/documents.parquet")).where("held_out").agg(F.sum("score"), F.sum("base_score")).head()
    assert rows[0] > rows[1]


def brute_nearest(x, entries):
    distances = [sum((a - b) ** 2 for a, b in zip(x, e, strict=True)) for e in entries]
    return distances.index(min(distances)), min(distances)


def kept_vectors(rows, valid):
    return [(k, v, *more) for k, v, *more in rows if v is not None and valid(len(v)) and all(x is not None and math.isfinite(x) for x in v)]


def embedding_rows(width, n=70):
    rng = np.random.default_rng(3)
    rows = [(k, rng.normal(0, 0.2, width).round(3).tolist(), int(k % 3)) for k in range(n, 0, -1)]
    rows += [(500, rows[0][1], None), (501, rows[0][1], None), (3, rows[2][1], 1), (502, None, 1), (503, [], 1), (504, [None] + [0.5] * (width - 1), 1)]
    rows += [(505, [math.nan] * width, 1), (506, [math.inf] + [0.0] * (width - 1), 1), (507, [0.1] * (width + 3), 1), (508, [0.0] * width, 9), (509, [3e30] + [0.0] * (width - 1), 9), (None, [0.01] * width, 2)]
    return rows


def brute_codes(rows, width):
    kept = sorted(kept_vectors(rows, lambda n: n == width), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    vectors = [[max(-va_file.LARGEST, min(va_file.LARGEST, math.floor(Fraction(float(np.float32(x))) * 4096))) for x in v] for _, v, _ in kept]
    part = width // 8
    cut = [[v[p * part : p * part + part] for v in vectors] for p in range(8)]
    books = [c[:16] for c in cut]
    for _ in range(6):
        for p in range(8):
            nearest = [brute_nearest(x, books[p])[0] for x in cut[p]]
            for e in range(len(books[p])):
                mine = [x for x, k in zip(cut[p], nearest, strict=True) if k == e]
                if mine:
                    books[p] = [*books[p][:e], [sum(c) // len(mine) for c in zip(*mine, strict=True)], *books[p][e + 1 :]]
    found = [[brute_nearest(cut[p][i], books[p]) for p in range(8)] for i in range(len(kept))]
    errors = [sum(d for _, d in f) for f in found]
    by_label = Counter()
    for (_, _, label), e in zip(kept, errors, strict=True):
        by_label[label] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((str(k), "".join(f"{e:02x}" for e, _ in f), e, by_label[label], digest) for (k, _, label), f, e in zip(kept, found, errors, strict=True))


@pytest.mark.parametrize("width,n", [(16, 70), (16, 5)])
def test_vector_codes(spark, width, n):
    rows = embedding_rows(width, n)
    vectors = spark.createDataFrame([r for r in rows], "vec_id long, embedding array<float>, label int").select("*", F.lit(1).alias("code"), F.lit(2).alias("error"), F.lit(3).alias("part"))
    got = sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in va_file.coded(vectors.repartition(3)).collect())
    assert got == brute_codes(rows, width)


def test_vector_codes_on_the_table(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").limit(150)
    rows = [tuple(r) for r in vectors.collect()]
    got = sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in va_file.coded(spark.createDataFrame(rows, vectors.schema)).collect())
    assert got == brute_codes(rows, 64)


def test_no_vectors(spark):
    for rows in ([], [(1, None, 1), (2, [], None), (3, [0.5] * 5, 1)]):
        empty = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
        assert va_file.coded(empty).count() == 0 and centroids.clustered(empty).count() == 0


def test_label_sums_without_a_broadcast(spark):
    rows = [(k, None if k % 5 == 0 else f"l{k % 2}", k) for k in range(100)]
    df = spark.createDataFrame(rows, "vec_id long, label string, error long")
    want = Counter()
    for _, label, e in rows:
        want[label] += e
    for spread_rows, bound in ((7, 0), (1000, 0), (7, 1 << 20)):
        got = va_file.with_group_sum(df, "label", "error", "s", spread_rows, bound).select("vec_id", "label", "s").collect()
        assert sorted(map(tuple, got), key=lambda r: r[0]) == [(k, label, want[label]) for k, label, _ in rows]


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 16), st.integers(1, 4), st.integers(0, 2**32), st.sampled_from([3, 40, 5000, 1 << 28]))
def test_cells_bound_the_nearest(n_entries, width, seed, spread):
    rng = np.random.default_rng(seed)
    entries, parts = rng.integers(-spread, spread + 1, (n_entries, width)), rng.integers(-spread, spread + 1, (30, width))
    best, distance = va_file.Cells(entries).nearest(parts)
    assert [*zip(best.tolist(), distance.tolist(), strict=True)] == [brute_nearest(x, entries.tolist()) for x in parts.tolist()]


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 12), st.integers(1, 70), st.integers(0, 2**32), st.sampled_from([1, 3, 300, 1 << 20, 1 << 27]))
def test_screened_centroids_are_nearest(k, width, seed, spread):
    rng = np.random.default_rng(seed)
    found, vectors = rng.integers(-spread, spread + 1, (k, width)), rng.integers(-spread, spread + 1, (30, width))
    vectors[:10] = found[rng.integers(0, k, 10)] + rng.integers(-1, 2, (10, width))  # near ties
    vectors = np.clip(vectors, -spread, spread)
    best, distance, _ = centroids.nearest(vectors, found)
    assert [*zip(best.tolist(), distance.tolist(), strict=True)] == [brute_nearest(x, found.tolist()) for x in vectors.tolist()]


def test_screening_leaves_few_open():
    rng = np.random.default_rng(1)
    vectors, found = rng.integers(-100, 100, (1000, 64)), rng.integers(-100, 100, (40, 64))
    assert centroids.nearest(vectors, found)[2] < 50


def brute_clusters(rows):
    kept = sorted(kept_vectors(rows, lambda n: n == 64), key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    vectors = [[max(-centroids.LARGEST, min(centroids.LARGEST, math.floor(Fraction(float(np.float32(x))) * 256))) for x in v] for _, v, _ in kept]
    found = vectors[:40]
    for _ in range(5):
        nearest = [brute_nearest(x, found)[0] for x in vectors]
        found = [[sum(c) // len(mine) for c in zip(*mine, strict=True)] if (mine := [x for x, j in zip(vectors, nearest, strict=True) if j == k]) else old for k, old in enumerate(found)]
    last = [brute_nearest(x, found) for x in vectors]
    inertia = Counter()
    for k, d in last:
        inertia[k] += d
    total = sum(inertia.values())
    return sorted((str(r[0]), k, d, inertia[k], total, hashlib.sha256(",".join(map(str, found[k])).encode()).hexdigest()) for r, (k, d) in zip(kept, last, strict=True))


@pytest.mark.parametrize("n", [70, 4])
def test_clusters(spark, n):
    rows = embedding_rows(64, n)
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").select("*", F.lit(1).alias("cluster"), F.lit(2).alias("distance"))
    got = sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in centroids.clustered(vectors.repartition(3)).collect())
    assert got == brute_clusters(rows)


def test_clusters_on_the_table(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    got = sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in centroids.clustered(vectors).collect())
    assert got == brute_clusters([tuple(r) for r in vectors.collect()])
