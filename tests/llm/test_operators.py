"""Each operator against brute force on small tables, with the awkward rows."""

import hashlib
import math
import re
import textwrap
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from yomibon.llm import common, decontaminate, html_extract, kernels, language, licences, media, mixing, near_dedup, token_file, toxicity, url_filter

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = T.StructType().add("doc_id", "long").add("text", "string").add("lang", "string").add("source", "string").add("n_chars", "long")
#: Columns whose names clash with those that operators make.
CLASHES = ("start", "key", "digest", "score", "class_id", "copies", "size", "target", "row", "bad", "gone", "lang_pred", "n")

BASE = "the quick brown fox jumps over a lazy dog while seven wizards brew quite strange potions beneath old stone bridges near quiet rivers every autumn evening before supper"
ROWS = [
    (1, BASE, "en", "a", 1),
    (2, BASE, "en", "a", 1),
    (3, BASE + " indeed", "en", "b", 1),
    (4, "Der Hund läuft über die Straße und bellt sehr laut am späten Abend", "de", "b", 1),
    (5, None, "en", None, None),
    (6, "", "de", "a", 0),
    (7, "### ... !!!", "en", "c", 1),
    (8, "word " * 30000 + "\n\n" + BASE.upper(), "en", "a", 1),
    (9, "short text", None, "c", 1),
    (10, "short text", "en", "c", 1),
    (10, "short text", "en", "c", 1),
    (None, "a row without an id but with words", "en", "a", 1),
    (-3, "  spaces  \n \t everywhere  ", "de", "z", 1),
]


def words(text):
    return WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 0, 0), (3, 1, 1), (4, 1, 0), (4, 1, 1), (7, 1, None), (None, 0, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    rows = [(7, " ".join(BASE.split()[3:16])), (8, "short text"), (9, None), (10, "..."), (11, " ".join(BASE.split()[3:16])), (None, "dog while seven")]
    return spark.createDataFrame(rows, "item_id long, text string")


def widened(df):
    return df.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASHES)])


def contaminated(text, items):
    w, hit, found = words(text), set(), set()
    for item, body in items:
        b = words(body)
        for s in range(max(1, len(b) - 9)) if b else ():
            win = b[s : s + 10]
            for p in range(len(w) - len(win) + 1):
                if w[p : p + len(win)] == win:
                    hit.update(range(p, p + len(win)))
                    if item is not None:
                        found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("broadcast_bytes", [1 << 25, 3 << 10, 0])
def test_decontaminate(docs, items, empty, broadcast_bytes):
    got = Counter(map(tuple, decontaminate.contamination(widened(docs), items, broadcast_bytes=broadcast_bytes).collect()))
    listed = [tuple(r) for r in items.collect()]
    assert got == Counter((r[0], *contaminated(r[1], listed)) for r in ROWS)
    assert decontaminate.contamination(empty, items).count() == 0
    assert decontaminate.contamination(docs, items.limit(0)).where("contaminated").count() == 0


@pytest.mark.parametrize("broadcast_bytes", [1 << 25, 0])
def test_decontaminate_many_windows_and_long_words(spark, broadcast_bytes):
    """A benchmark of 100,000 windows, and items without spaces, whose words are of any length."""
    rng = np.random.default_rng(9)
    body = [f"w{k}" for k in rng.integers(0, 3000, 100_000)]
    long = ["日本語の長い文" * n for n in rng.integers(1, 400, 25)]
    listed = [(k, " ".join(body[k * 1000 : k * 1000 + 1009])) for k in range(100)] + [(1000, "、 ".join(long)), (1001, long[0] * 50)]
    docs = [(1, " ".join(["x", *body[500:530], "y"])), (2, " ".join(body[700:709])), (3, "- ".join(["a", *long[3:20]])), (4, f"{long[0] * 50} end"), (5, " ".join([*body[40_000:40_010], "z", *body[40_995:41_012]])), (6, " ".join(long[3:12]))]
    got = {r.doc_id: tuple(r)[1:] for r in decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(listed, "item_id long, text string"), broadcast_bytes=broadcast_bytes).collect()}
    inside = {}
    for item, text in listed:
        w = words(text)
        for s in range(max(1, len(w) - 9)):
            inside.setdefault(tuple(w[s : s + 10]), set()).add(str(item))
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for s in range(len(w)):
            for n in (1, 10):
                if s + n <= len(w) and (items := inside.get(tuple(w[s : s + n]))):
                    hit.update(range(s, s + n))
                    found |= items
        assert got[doc_id] == (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))


def test_decontaminate_keeps_clean_rows(docs, items):
    kept = decontaminate.keep_clean(widened(docs), items)
    assert kept.columns == [*docs.columns, *CLASHES]
    listed = [tuple(r) for r in items.collect()]
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r[0] for r in ROWS if not contaminated(r[1], listed)[-1])


def test_decontaminate_runs_no_python(docs, items):
    plan = decontaminate.contamination(docs, items)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|InArrow", plan)


def test_pack_round_trip():
    rng = np.random.default_rng(1)
    for bits in (1, 3, 8, 11, 16, 17, 24, 31, 32):
        for n in (0, 1, 63, 64, 65, 1000):
            ids = rng.integers(0, 2**bits, n, dtype=np.uint64)
            data = token_file.pack(ids, bits)
            assert len(data) == 8 * -(-n * bits // 64)
            assert (token_file.unpack(data, bits, 0, n) == ids).all()
            assert (token_file.unpack(data, bits, n // 3, n // 4) == ids[n // 3 : n // 3 + n // 4]).all()


def test_pieces_equal_whole_texts():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(token_file.default_tokenizer())
    encode = token_file.Encoder(token_file.default_tokenizer())
    rng = np.random.default_rng(2)
    parts = ["a", "b", " ", "  ", "\n", "\t", "é", "1", "'s", "!", " x", "　", "word", "ß", "×", "--", "<|endoftext|>", "日本", "\x1c", "\u200b"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 10))) for _ in range(3000)]
    assert [x.tolist() for x in encode(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_new_pieces_are_encoded_together():
    """Thousands of new pieces, of letters or not, are few texts for the tokenizer."""
    from tokenizers import Tokenizer

    class Counted:
        def __init__(self, tokenizer):
            self.tokenizer, self.n = tokenizer, 0

        def __getattr__(self, name):
            return getattr(self.tokenizer, name)

        def encode_batch_fast(self, texts, **options):
            self.n += len(texts)
            return self.tokenizer.encode_batch_fast(texts, **options)

    plain = Tokenizer.from_file(token_file.default_tokenizer())
    encode = token_file.Encoder(token_file.default_tokenizer())
    encode.tokenizer = counted = Counted(encode.tokenizer)
    words = [f"{a}{k}.\n{b}" for k, (a, b) in enumerate([("the", "Of"), ("\u0120", "日本"), ("ß", "'s"), ("<|", "|>")] * 1024)]
    texts = [" ".join(words[k : k + 64]) for k in range(0, len(words), 64)]
    assert [x.tolist() for x in encode(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert counted.n <= len(words) // token_file.TOGETHER + 1 + len(texts)


def test_pieces_that_would_make_an_added_token(tmp_path):
    """New pieces of two texts that, side by side, are an added token stay what they are in their texts."""
    import json

    from tokenizers import Tokenizer

    spec = json.loads(open(token_file.default_tokenizer(), encoding="utf-8").read())
    spec["added_tokens"].append(spec["added_tokens"][0] | {"id": 50257, "content": "foo bar"})
    path = tmp_path / "tokenizer.json"
    path.write_text(json.dumps(spec))
    plain, encode = Tokenizer.from_file(str(path)), token_file.Encoder(str(path))
    texts = ["one foo", "two bar", "a foo bar", None, ""]
    assert [x.tolist() for x in encode(texts)] == [plain.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_a_worker_holds_little():
    """The memo of 400,000 pieces takes half of what a dictionary of strings takes, and the tokenizer gets few texts at once."""
    import tracemalloc

    class Watched:
        def __init__(self, tokenizer):
            self.tokenizer, self.most = tokenizer, 0

        def encode_batch_fast(self, texts, **options):
            self.most = max(self.most, sum(map(len, texts)) if len(texts) > 1 else 0)
            return self.tokenizer.encode_batch_fast(texts, **options)

    encode = token_file.Encoder(token_file.default_tokenizer())
    encode.tokenizer = watched = Watched(encode.tokenizer)
    tracemalloc.start()
    try:
        for low in range(0, 400_000, 50_000):
            encode([" ".join(f"{k:x}" for k in range(at, at + 100)) for at in range(low, low + 50_000, 100)])
        held = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert held < 48 << 20
    encode(["  ".join(["word"] * 5000)] * 20)
    assert watched.most <= 1 << 16


def test_pieces_of_one_hash_and_a_full_memo(monkeypatch):
    """Ids are right if all pieces have one hash, and when the memo starts anew again and again."""
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(token_file.default_tokenizer())
    texts = [" ".join(f"w{k % 700}\u00e9" for k in range(low, low + 40)) + " " + "x" * 200 for low in range(0, 2000, 20)]
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    monkeypatch.setattr(token_file, "MEMO_PIECES", 100)
    encode = token_file.Encoder(token_file.default_tokenizer())
    assert [x.tolist() for low in range(0, len(texts), 2) for x in encode(texts[low : low + 2])] == want
    monkeypatch.setattr(token_file, "piece_hashes", lambda pieces: np.ones(len(pieces), np.uint64))
    encode = token_file.Encoder(token_file.default_tokenizer())
    assert [x.tolist() for _ in range(2) for low in range(0, len(texts), 10) for x in encode(texts[low : low + 10])] == want * 2


def test_settings_go_back(spark):
    names = list(token_file.BATCH)
    before = [spark.conf.get(x) for x in names]
    with common.configured(spark, token_file.BATCH):
        assert [spark.conf.get(x) for x in names] == list(token_file.BATCH.values())
    assert [spark.conf.get(x) for x in names] == before


def test_token_file(docs, empty):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(token_file.default_tokenizer())
    got = token_file.tokenized(widened(docs)).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((r[0] for r in ROWS), key=lambda x: (x is not None, x or 0))
    by, at = {r[0]: r[1] for r in ROWS}, 0
    for r in got:
        ids = [*plain.encode(by[r.doc_id] or "", add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert token_file.tokenized(empty).count() == 0


def test_media_rebuilds_payloads(docs, empty):
    got = media.measured(widened(docs)).collect()
    assert len(got) == len(ROWS)
    by = {r[0]: r[1] for r in ROWS}
    for r in got:
        data = media.payload(by[r.doc_id])
        stored = media.media(media.chunks(data))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((by[r.doc_id] or "").encode()), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
    assert media.measured(empty).count() == 0


def test_media_cuts_follow_content():
    rng = np.random.default_rng(3)
    body = rng.integers(97, 123, 60000, dtype=np.uint8).tobytes()
    a, b = media.chunks(body), media.chunks(b"x" * 333 + body)
    assert b"".join(a) == body and all(len(c) <= media.MAX_CHUNK for c in a)
    assert len(set(a) & set(b)) > len(a) * 0.8
    whole = media.gear_hashes(np.frombuffer(body, np.uint8))
    h = 0
    for k, x in enumerate(body[:200]):
        h = (2 * h + int(media.GEARS[x])) % 65536
        assert h == whole[k]


def test_media_shares_chunks(docs):
    packs, references = media.stored(docs)
    assert references.count() > 0
    sizes = {r.doc_id: len(r.samples) for r in packs.where("doc_id in (1, 2)").collect()}
    assert sorted(sizes.values())[0] == 0  # one of two copies owns the bytes


def measured_right(got, rows):
    by = {}
    for doc_id, text in rows:
        by.setdefault(doc_id, []).append(hashlib.sha256(media.payload(text)).hexdigest())
    seen = {}
    for r in got:
        seen.setdefault(r.doc_id, []).append(r.payload_sha256)
    assert {k: sorted(v) for k, v in seen.items()} == {k: sorted(v) for k, v in by.items()}


def test_media_of_a_chunk_with_many_references(spark):
    """5,000 documents refer to the chunks of one passage, in ten copies, made in two steps."""
    passage = "".join(chr(97 + k) for k in np.random.default_rng(5).integers(0, 26, 9000))
    rows = [(k, passage + f" {k}") for k in range(5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    _, references = media.stored(docs)
    assert references.agg(F.max("salts")).first()[0] >= 10
    measured_right(media.measured(docs).collect(), rows)


def test_media_of_documents_with_one_key(spark, monkeypatch):
    """Documents that share their key by chance are rebuilt all the same."""
    rng = np.random.default_rng(6)
    parts = ["".join(chr(97 + k) for k in rng.integers(0, 26, 4000)) for _ in range(6)]
    rows = [(k, "".join(parts[j] for j in rng.permutation(6)[:3])) for k in range(40)]
    monkeypatch.setattr(media, "document_key", lambda: F.pmod(F.col("doc_id"), F.lit(7)).cast("long"))
    measured_right(media.measured(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect(), rows)


def shuffled(df, metric):
    """A metric of the exchanges of df's plan, once it has run; an exchange that is used again counts once."""
    found, left = {}, [df._jdf.queryExecution().executedPlan()]
    while left:
        node = left.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            left.append(node.executedPlan())
        elif name.endswith("QueryStage"):
            left.append(node.plan())
        elif name == "Exchange":
            found[node.id()] = node.metrics().apply(metric).value()
        children = node.children()
        left += [children.apply(k) for k in range(children.size())]
    return sum(found.values())


def test_media_moves_shared_bytes_twice(spark):
    """A foreign chunk goes to its digest and from there to its document, deflated both times."""
    rng = np.random.default_rng(7)
    syllables = [a + b for a in "bdfklmnrst" for b in ("a", "en", "i", "or", "u")]
    texts = [" ".join("".join(rng.choice(syllables, 3)) for _ in range(3000)) for _ in range(30)]
    rows = [(k, texts[k % 30] + f" {k}") for k in range(60)]
    got = media.measured(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    measured_right(got.collect(), rows)
    assert 0 < shuffled(got, "shuffleBytesWritten") < 1.3 * sum(map(len, texts))


def test_media_of_many_references(spark, monkeypatch):
    """References too many for a broadcast don't move the documents that have none."""
    monkeypatch.setattr(media, "REFERENCE_BYTES", 1 << 40)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        side = spark.range(0, 3000, 100).select(F.xxhash64("id").alias("key"), F.col("id").alias("found"))
        rows = spark.range(3000).select(F.xxhash64("id").alias("key"), "id", F.lit("x" * 100).alias("text"))
        for how, n in (("left", 3000), ("inner", 30)):
            got = media.joined(rows, side, 30, how)
            met = got.collect()
            assert len(met) == n and {(r.id, r.found) for r in met if r.found is not None} == {(k, k) for k in range(0, 3000, 100)}
            assert got.columns == ["key", "id", "text", "found"] and 0 < shuffled(got, "shuffleRecordsWritten") < 150
        rng = np.random.default_rng(8)
        passages = ["".join(chr(97 + k) for k in rng.integers(0, 26, 9000)) for _ in range(8)]
        texts = [(k, passages[k % 8] + f" {k}" if k % 3 else f"alone {k} " * 400) for k in range(60)] + [(60, None), (61, "")]
        measured_right(media.measured(spark.createDataFrame(texts, "doc_id long, text string").repartition(4)).collect(), texts)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_language(spark, sf_dir, docs, empty):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = language.identified(table).collect()
    truth = {r.doc_id: r.lang for r in table.select("doc_id", "lang").collect()}
    held = [r for r in got if r.held_out]
    assert held and np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.9
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    small = {r.doc_id: r for r in language.identified(widened(docs)).collect()}
    assert len(small) == 12 and {small[k].lang_pred for k in (5, 6, 7)} == {"und"} and small[9].lang_pred in ("de", "en")
    assert language.identified(empty).count() == 0
    kept = language.keep_identified(widened(docs))
    assert kept.columns == [*docs.columns, *CLASHES] and not {5, 6, 7} & {r.doc_id for r in kept.collect()}


def test_toxicity(spark, sf_dir, docs, labels, empty):
    table, marks = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in toxicity.scored(table, marks).collect()}
    truth = {r.doc_id: r.toxic for r in marks.collect()}
    rank = sorted((got[k].score, v) for k, v in truth.items())
    n = sum(v for _, v in rank)
    auc = (sum(k + 1 for k, (_, v) in enumerate(rank) if v) - n * (n + 1) / 2) / (n * (len(rank) - n))
    assert auc > 0.9 and all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in got.values())
    assert toxicity.scored(widened(docs), labels).count() == len(ROWS)
    assert toxicity.scored(empty, labels).count() == 0
    assert {r.predicted for r in toxicity.scored(docs, labels.limit(0)).collect()} == {0}


def test_toxicity_grammar():
    grammar = toxicity.Grammar({"idiot ": 4.0, "worth": 2.0})
    found = grammar.automaton()
    score = lambda text: toxicity.features(found, text)[0]
    assert score("an idiot here") > score("not an idiot here") > 0
    assert score("an idiot here") > score("he said an idiot here") > 0
    assert score("you idiot") > score("an idiot")
    assert score("I will kill you") > 0 == score("I will kill time")
    assert score("idiotic") == 0 < score("worthless") and score("") == 0


def test_mixing(docs, empty):
    got = mixing.taken(docs).collect()
    assert len(got) == len(ROWS)
    sizes = Counter()
    for r in ROWS:
        sizes[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    assert {(r.source_size) for r in got} == set(sizes.values())
    assert sum({r.source_size: r.target for r in got}.values()) == pytest.approx(1.5 * sum(sizes.values()))
    assert all(r.target <= 2 * r.source_size and r.taken in (0, r.size, 2 * r.size) for r in got)
    assert sorted(map(str, got)) == sorted(map(str, mixing.taken(docs).collect()))
    assert mixing.taken(empty).count() == 0
    out = mixing.emitted(widened(docs))
    assert out.columns == [*docs.columns, *CLASHES] and out.count() > 0


def test_mixing_targets_by_water_filling(spark):
    rng = np.random.default_rng(4)
    for _ in range(5):
        sizes = [(f"s{k}", int(x)) for k, x in enumerate(rng.integers(0, 1000, rng.integers(1, 9)) ** 2)]
        got = {r.source: r.target for r in mixing.targets(spark.createDataFrame([(s, n, 1) for s, n in sizes], "source string, source_size long, n long")).collect()}
        weights = {s: (3, 1, 2)[k % 3] for k, (s, _) in enumerate(sorted(sizes))}
        caps, left, want = {s: 2.0 * n for s, n in sizes}, 1.5 * sum(n for _, n in sizes), {}
        free = set(caps)
        while free:
            level = left / sum(weights[s] for s in free)
            full = {s for s in free if weights[s] * level >= caps[s]}
            if not full:
                want |= {s: weights[s] * level for s in free}
                break
            want |= {s: caps[s] for s in full}
            left -= sum(caps[s] for s in full)
            free -= full
        assert got == pytest.approx(want)


def test_mixing_comes_near_targets(spark):
    rows = [(k, "w " * int(1 + (k * 7919) % 400), ("hot" if k % 3 else f"s{k % 7}")) for k in range(6000)]
    mixed = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string"), bucket_rows=100)
    got = mixed.groupBy("row.source").agg(F.sum(F.col("copies") * F.col("size")).alias("t"), F.max("target").alias("g")).collect()
    assert all(abs(r.t - r.g) <= 0.05 * r.g for r in got)


def test_url_filter(spark):
    urls = [
        ("https://www.example.org/es/1", "example.org/es/", "block"), ("https://EXAMPLE.org/en/10", "example.org/en/1", "block"), ("http://x.org/a", "org/", "allow"), ("http://x.org", None, "allow"),
        ("http://a.com/fr/1", "com/fr/", "allow"), ("http://a.com/de/?x", "com/de/", "block"), ("http://casino.net/a", None, "block"), ("http://casinoroyal.net/a", None, "allow"),
        ("http://cheap-pills.net/", None, "block"), ("http://cheap.net/", None, "allow"), ("http://free-cheap.net/cheap", None, "block"), (None, None, "allow"), ("no scheme", None, "allow"), ("", None, "allow"),
    ]
    pages = widened(spark.createDataFrame([(k, u) for k, (u, _, _) in enumerate(urls)], "page_id long, url string"))
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judged(pages).collect()}
    assert got == {k: (rule, verdict) for k, (_, rule, verdict) in enumerate(urls)}
    r = url_filter.judged(spark.createDataFrame([(1, "HTTP://Ä.Example.ORG?x://y/z")], "page_id long, url string")).first()
    assert (r.host, r.path) == ("Ä.example.org", "")


def test_url_filter_of_a_table_of_terms(spark):
    assert len(url_filter.vocabulary()) > 300
    terms = spark.createDataFrame([("Büro", True, None), ("alt", None, 1.0), ("neu", False, 1.0), ("neu", False, 0.2), ("", True, 1.0), (None, True, 1.0)], "term string, strict boolean, weight double")
    long = "http://x.net/" + "a/" * 50_000
    urls = ["http://x.net/b%C3%BCro", "http://x.net/BÜRO-1", "http://x.net/büros", "http://x.net/alt/neu", "http://x.net/alt%2Dalt", "http://x.net/casino", f"{long}büro", long]
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(urls)] * 2, "page_id long, url string")
    got = url_filter.judged(pages, terms=terms).collect()
    assert len(got) == 16 and {r.page_id for r in got if r.verdict == "block"} == {0, 1, 3, 6}
    assert url_filter.judged(pages.limit(0)).count() == 0
    # A vocabulary that is too large for an automaton is joined.
    joined = url_filter.judged(pages, terms=terms, automaton_bytes=0)
    assert sorted(map(tuple, joined.collect()), key=str) == sorted(map(tuple, got), key=str)
    assert url_filter.judged(pages, terms=terms.limit(0)).where("verdict = 'block'").count() == 0


def test_url_filter_counts_roots(spark):
    urls = {"http://x.net/loan/loans": (1, "allow"), "http://x.net/deal/click": (2, "block"), "http://x.net/deals/click?deal": (2, "block"), "http://x.net/dealer/clicking": (0, "allow")}
    pages = spark.createDataFrame([*enumerate(urls)], "page_id long, url string")
    assert {r.page_id: (r.n_soft, r.verdict) for r in url_filter.judged(pages).collect()} == dict(enumerate(urls.values()))


def test_numbers_are_no_letters(spark, docs):
    texts = ["½", "²", "①", "٣", "_", "½ a"]
    table = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame([(1000 + k, t, None) for k, t in enumerate(texts)], "doc_id long, text string, lang string"))
    found = {r.doc_id: r.lang_pred for r in language.identified(table).where("doc_id >= 1000").collect()}
    assert [found[1000 + k] == "und" for k in range(len(texts))] == [True] * 5 + [False]


def brute_language(rows, text):
    """(language, probability) by counting the hashed n-grams one at a time."""
    bits = language.BUCKET_BITS

    def grams(text):
        last, out = [32, 32], []
        for x in [*text.encode(), 32]:
            now = x + 32 if 65 <= x <= 90 else x if 97 <= x <= 122 or x >= 128 else 32
            if now != 32 or last[1] != 32:
                two = now | last[1] << 8
                three = two | (32 if last[1] == 32 else last[0]) << 16 | 1 << 24
                out += [two * 0x9E3779B1 % (1 << 32) >> 32 - bits, three * 0x85EBCA6B % (1 << 32) >> 32 - bits]
            last = [last[1], now]
        return out

    counts, docs = {}, Counter()
    for lang, body in rows:
        counts.setdefault(lang, Counter()).update(grams(body))
        docs[lang] += 1
    total = {x: math.log(docs[x] / sum(docs.values()) + 1e-9) + sum(math.log((c[g] + language.ALPHA) / (sum(c.values()) + language.ALPHA * 2**bits)) for g in grams(text)) for x, c in counts.items()}
    best = min(total, key=lambda x: (-total[x], x))
    return best, 1 / sum(math.exp(v - total[best]) for v in total.values())


def test_language_equals_brute_force(spark):
    rng = np.random.default_rng(10)
    letters = {"aa": "abcde ", "bb": "cdefgé ", "cc": "xyzñ "}
    rows = [(k, "".join(rng.choice(list(letters[x]), 60)), x) for k, x in enumerate(rng.choice(["aa", "bb", "cc"], 80))]
    rows += [(100, "", "dd"), (101, "123", "aa"), (102, "abc", None), (103, None, "aa")]
    known = [(r[2], r[1]) for r in rows if r[1] is not None and r[2] and zlib.crc32(str(r[0]).encode()) % 5]
    got = {r.doc_id: r for r in language.identified(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    for doc_id, text, _ in rows:
        if not any(x.isalpha() for x in text or ""):
            assert (got[doc_id].lang_pred, got[doc_id].score) == ("und", 0.0)
        else:
            lang, score = brute_language([x for x in known if x[0] != "dd"] if not any(x[0] == "dd" and x[1] for x in known) else known, text)
            assert got[doc_id].lang_pred == lang and got[doc_id].score == pytest.approx(score, abs=2e-3)


def test_language_learns_rare_languages(spark):
    rows = [(k, f"the words of this text and number {k} of them", "en") for k in range(3000)] + [(5000 + k, f"tämä on suomenkielinen teksti ja sen sanat yö {k}", "fi") for k in range(6)]
    rows += [(6000 + k, f"lang{k} " + chr(0x400 + k) * 30, f"x{k}") for k in range(300)]
    rows += [(9000, "tämä on suomenkielinen teksti", None), (9001, "zzz qqq xxx vvv", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identified(docs, sample_rows=100).collect()}
    assert got[9000][0] == "fi" and {got[5000 + k][0] for k in range(6)} == {"fi"}
    learned = {r[2] for r in rows if r[2] and r[2][0] == "x" and zlib.crc32(str(r[0]).encode()) % 5}
    assert len(learned) > 200 and all(got[r[0]][0] == r[2] for r in rows if r[2] in learned)


def brute_clause(words_of, insults):
    """The grammar's score of one clause, by its rules."""
    target = any(w in toxicity.TARGETS for w in words_of)
    score, reach, share = 0.0, 0, 1.0
    for w in words_of:
        if w in toxicity.NEGATIONS:
            reach = toxicity.NEGATION_REACH + 1
            continue
        if w in toxicity.REPORTS:
            share = toxicity.REPORTED
        elif w in toxicity.THREATS:
            score += toxicity.THREAT * share if target else 0.0
        elif w in insults:
            score += insults[w] * share * (toxicity.NEGATED if reach else 1.0) * (toxicity.TARGETED if target else 1.0)
        reach = max(0, reach - 1)
    return score


def test_toxicity_transducers_equal_rules():
    rng = np.random.default_rng(11)
    insults = {"oaf": 2.0, "lump": 3.5}
    found = toxicity.Grammar({f"{w} ": v for w, v in insults.items()}).automaton()
    for _ in range(3000):
        clause = rng.choice(["oaf", "lump", "kill", "you", "not", "said", "a", "so", "the", "day"], rng.integers(1, 14)).tolist()
        text = " ".join(clause)
        stood = toxicity.terminals(found[0], text)
        want = brute_clause(clause, insults)
        assert not stood or toxicity.clause_score(found[1], stood, text)[0] == pytest.approx(want)
        row = toxicity.features(found, f"{text}. Fine day\n{text}! {text}")
        assert row[0] == pytest.approx(np.log1p(3 * want)) and row[1] == pytest.approx(want / 4)


def test_toxicity_learns_by_counts(spark):
    """The terminals and their weights, against counts of all documents; a prefix of one insult is no stem."""
    rng = np.random.default_rng(12)
    plain = [f"p{k}a" for k in range(40)]
    insult = ["pathetic", "worthless", "grobian", "grobianin", "grobiane", "grobianisch"]
    rows, marks = [], []
    for k in range(400):
        toxic = int(k % 4 == 0)
        body = [*rng.choice(plain, 20), *(rng.choice(insult, 3) if toxic else ["path"] * (k % 3 == 0))]
        rows.append((k, " ".join(rng.permutation(body))))
        marks.append((k, toxic))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    grammar = toxicity.learn(docs, labels)
    known = [(set(words(t)), y) for (k, t), (_, y) in zip(rows, marks, strict=True) if zlib.crc32(str(k).encode()) % 5]
    n = Counter(y for _, y in known)
    for term, weight in grammar.insults.items():
        held = Counter(y for w, y in known if (term[:-1] in w if term.endswith(" ") else any(x.startswith(term) and x != term for x in w)))
        odds = math.log((held[1] + 0.5) / (n[1] + 1)) - math.log((held[0] + 0.5) / (n[0] + 1))
        assert weight == pytest.approx(odds - toxicity.Z * math.sqrt(1 / (held[1] + 0.5) + 1 / (held[0] + 0.5)))
    stems = {t for t in grammar.insults if not t.endswith(" ")}
    assert {f"{w} " for w in insult} <= set(grammar.insults) and "grob" in stems and not any(s.startswith(("path", "wort")) for s in stems)
    score = lambda text: float(toxicity.probability(np.array([toxicity.features(grammar.automaton(), text)]), np.array(grammar.coefficients))[0])
    assert score("The garden path is worth the walk.") < 0.5 < score("What a grobianer, pathetic")
    twice = docs.unionByName(docs.where("doc_id = 4")).unionByName(docs.where("doc_id = 4").withColumn("text", F.lit("zz other")))
    assert toxicity.scored(twice, labels).count() == 402


def test_licences_of_wrapped_notices(spark):
    """Where lines break makes no difference, nor how rows are dealt."""
    rows, want = [], {}
    for family, templates in licences.TEMPLATES.items():
        for template in templates:
            for text in (template, f"Some words\n\n{textwrap.fill(template, 40)}\n\nOther words", "# " + textwrap.fill(template, 60).replace("\n", "\n# "), f"It is so: {template} And more words follow it."):
                want[len(rows)] = family
                rows.append((len(rows), text))
    want |= {len(rows): "", len(rows) + 1: ""}
    rows += [(len(rows), "Free software and the general public: this work is of the author."), (len(rows) + 1, "Released under the. MIT\n\nLicense")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one, seven = ({r.doc_id: tuple(r) for r in licences.scanned(docs.coalesce(1) if n == 1 else docs.repartition(n)).collect()} for n in (1, 7))
    assert {k: r[3] for k, r in one.items()} == want and one == seven


def brute_licences(model, text):
    """The scan of one text with a trained model, sentence by sentence, word by word."""
    weights = {int(h): model.weights[k] for k, h in enumerate(model.vocabulary)}
    known = {int(x) for x in model.known}
    n_paragraphs, found = 0, []
    for paragraph in re.split(r"(?<=\n)(?:[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*\n)", text or ""):
        n_paragraphs += bool(words(paragraph))
        for sentence in re.split(r"(?<=[.!?])(?=[\x09-\x0D ])", paragraph):
            w = words(sentence)
            if not w:
                continue
            read = licences.of_texts([" ".join(w)])
            hits = [k for k, x in enumerate(read.two.tolist()) if x in known]
            run = []
            for k in [*hits, None]:
                if run and (k is None or k - run[-1] > licences.REACH):
                    if len(run) > 1:
                        one, two = read.one[run[0] : run[-1] + 2], read.two[run[0] : run[-1] + 1]
                        total = sum(weights[x] for x in {*one.tolist(), *two.tolist()} if x in weights)
                        total = total + np.mean([x not in weights for x in one.tolist()]) * model.weights[-2] + model.weights[-1]
                        p = np.exp(total - total.max())
                        p /= p.sum()
                        best = int(p[:-1].argmax())
                        share = max(np.mean([x in set(two.tolist()) for x in t.tolist()]) for t in model.pairs[best])
                        if p[best] >= model.least and best == p.argmax() and share >= licences.CONTAINED:
                            found.append((model.families[best], p[best]))
                    run = []
                if k is not None:
                    run.append(k)
    return n_paragraphs, len(found), ",".join(sorted({f for f, _ in found})), max((p for _, p in found), default=0.0)


def test_licences_equal_brute_force(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rng = np.random.default_rng(13)
    parts = [t for x in licences.TEMPLATES.values() for t in x] + ["Some words. And others", "the license of this work", "\n\n", "\n", ". ", "\n # \n", "This program is free"]
    rows = [(10_000 + k, " ".join(rng.choice(parts, rng.integers(1, 9)))) for k in range(150)] + [(20_000, None), (20_001, "")]
    docs = table.unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    model = licences.train(docs)
    shared = spark.sparkContext.broadcast(model)
    for r in docs.mapInArrow(licences.scanner(shared), licences.SCANNED).join(docs, "doc_id").collect():
        want = brute_licences(model, r.text)
        assert (r.n_paragraphs, r.n_notices, r.licences) == want[:3] and r.score == pytest.approx(want[3]), r.text


def test_licences(docs, empty, spark):
    texts = ["Fine words.\nReleased under the MIT License.\nMore words", "the license of a released work under version", "x This work is licensed under the GNU General Public License, version 3. y", "", None, "Licensed under CC BY-NC 4.0.\nAll rights reserved."]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.licences for r in licences.scanned(rows.unionByName(docs.where("doc_id < 5").select((F.col("doc_id") + 100).alias("doc_id"), "text"))).collect()}
    assert [got[k] for k in range(6)] == ["mit", "", "gpl", "", "", "all-rights-reserved,cc-by-nc"]
    assert licences.scanned(widened(docs)).count() == len(ROWS)
    assert licences.scanned(empty).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><script>var t="</p>";</script></head><body class="home"><nav><ul><li><a href="/">Menu</a></ul></nav><!-- <p>no</p> --><div class="ad">buy</div>
<div id="cookie-notice">ok?</div><article><h1>Title {k}</h1><p><b>One&nbsp;&amp;\n two<br>three<p>Unclosed {k} &lt;b&gt;<div class="share">Share</div><p>Same line</p></article><div class="comments"><p>nice</p></div><form><p>mail</p></form><footer>&copy; me</footer></body></html>"""


def test_html_extract(spark):
    rows = [(k, f"http://h.example/{k}", PAGE.replace("{k}", str(k))) for k in range(12)]
    rows += [(50, None, None), (51, "http://one.example/", "plain <i>text</i>"), (52, "http://two.example/", "<div><p>long running text of a page</p><aside>no</aside></div>"), (53, "http://h.example/none", ""), (0, "http://h.example/0", PAGE.replace("{k}", "0"))]
    pages = widened(spark.createDataFrame(rows[:12] + rows[-1:], "page_id long, url string, html string"))
    got = html_extract.extracted(pages).collect()
    # A line of the article that stands on each of a host's pages is part of the article, on hosts of any size.
    assert len(got) == 13 and {r.page_id: r.text for r in got} == {k: f"Title {k}\nOne & two three\nUnclosed {k} <b>\nSame line" for k in range(12)}
    other = {r.page_id: r for r in html_extract.extracted(spark.createDataFrame(rows[3:5] + rows[12:16], "page_id long, url string, html string")).collect()}
    assert other[3].text == "Title 3\nOne & two three\nUnclosed 3 <b>\nSame line"
    assert (other[50].text, other[51].text, other[52].text, other[53].text) == ("", "plain text", "long running text of a page", "")
    assert all(r.n_chars == len(r.text) for r in other.values())
    assert html_extract.extracted(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def extracted_texts(spark, pages):
    """{page_id: text} of (host, html) pages, numbered."""
    rows = [(k, f"http://{name}.example/{k}", page) for k, (name, page) in enumerate(pages)]
    return {r.page_id: r.text for r in html_extract.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_html_extract_keeps_copies(spark):
    """Rows that repeat an article are no evidence of a template, whatever differs in their links."""
    copy = '<body><nav>Menu</nav><article><h1>One title</h1><p>By someone</p><p>The story <a href="/?utm={k}">goes on</a></p></article></body>'
    for n in (1, 9, 10, 14):
        got = extracted_texts(spark, [("mirror", copy.replace("{k}", str(k))) for k in range(n)])
        assert set(got.values()) == {"One title\nBy someone\nThe story goes on"}
    # Of ten texts one is all template: it is kept.
    pages = [("h", f"<body><article><p>All of it</p>{f'<p>More {k}</p>' if k else ''}</article></body>") for k in range(12)]
    assert extracted_texts(spark, pages)[0] == "All of it"


def test_html_extract_keeps_text_beside_the_content_token(spark):
    shapes = {
        "teaser": "<body><div class='top'>My site</div><main><h1>T{k}</h1><div class='story'>a story {k}, told at length</div><article class='teaser'>next {k}</article></main></body>",
        "title": "<body><div class='top'>My site</div><main><h1>T{k}</h1><article>a story {k}, told at length</article></main></body>",
        "lead": "<body><div class='top'>My site</div><div class='content'><div class='lead'>lead {k} of it, in some forty more letters</div><div class='body'>a story {k}, told at some length and more{more}</div></div></body>",
    }
    want = {"teaser": "T{k}\na story {k}, told at length\nnext {k}", "title": "T{k}\na story {k}, told at length", "lead": "lead {k} of it, in some forty more letters\na story {k}, told at some length and more{more}"}
    more = ", with a great deal of further words" * 6
    pages = [(f"{name}{n}", page.replace("{k}", str(k)).replace("{more}", more)) for name, page in shapes.items() for n in (2, 9, 12) for k in range(n)]
    texts = [want[name].replace("{k}", str(k)).replace("{more}", more) for name in shapes for n in (2, 9, 12) for k in range(n)]
    assert extracted_texts(spark, pages) == dict(enumerate(texts))


def test_html_extract_of_elements_named_like_furniture(spark):
    wraps = {
        "body": "<body class='has-sidebar fixed-header'>{}</body>",
        "article": "<body><article class='post comments-open'>{}</article></body>",
        "share": "<body><div class='content share-enabled'>{}</div></body>",
        "inside": "<body><article><div class='content share-enabled'>{}</div></article></body>",
        "style": "<body><div style='overflow:hidden'>{}</div></body>",
        "data": "<body><div data-hidden='0' title='hidden gems'>{}</div></body>",
        "head": "<html><head><meta charset='utf-8'><title>t</title><body>{}</body></html>",
        "form": "<body><form action='/'>{}</form></body>",
        "headless": "<html><head><title>t</title><p>{}</p></html>",
    }
    story = "Story {k}<nav>Menu</nav><div class='related'>Next</div><div hidden>gone</div><p>told {k}, at its length</p>"
    pages = [(name, wrap.replace("{}", story).replace("{k}", str(k))) for name, wrap in wraps.items() for k in range(3)]
    got = extracted_texts(spark, pages)
    assert {(pages[k][0], text) for k, text in got.items()} == {(name, f"Story {k}\ntold {k}, at its length") for name in wraps for k in range(3)}
    # Comments beside an article stay out, however long they are.
    long = "<body><article>Story</article><div class='comments'><article class='comment'>a long reply to it all</article></div></body>"
    assert extracted_texts(spark, [("c", long)]) == {0: "Story"}


def brute_template(pages):
    """(content, texts) of one host's pages by comparing all vectors, orders and enclosing elements directly; pages are (element or text, path) lists."""
    pages = [p for k, p in enumerate(pages) if [t for t in p if t[0] == "text"] not in [[t for t in q if t[0] == "text"] for q in pages[:k]]]
    tokens = {t for p in pages for t in p}
    count = {t: tuple(p.count(t) for p in pages) for t in tokens}
    enough = max(html_extract.SUPPORT * len(pages), min(2, len(pages)))
    known = {t for t in tokens if sum(map(bool, count[t])) >= enough and (t[0] == "tag" or len(pages) > 1)}
    classes = {v: {t for t in known if count[t] == v} for v in {count[t] for t in known}}

    def ordered(own):
        orders = set()
        for p in pages:
            stood = [t for t in p if t in own]
            k = len(set(stood))
            if stood and (len(stood) % k or any(stood[i] != stood[i % k] for i in range(len(stood)))):
                return False
            orders |= {tuple(stood[:k])} if stood else set()
        return len(orders) == 1

    def enclosing(v):
        around = [p.split("/")[1:] for kind, p, *_ in classes[v]]
        shared = [x if kind == "text" else x[:-1] for x, (kind, *_) in zip(around, classes[v], strict=True)]
        for depth in range(min(map(len, shared)), 0, -1):
            path = "/" + "/".join(shared[0][:depth])
            if all(x[:depth] == shared[0][:depth] for x in shared) and ("tag", path) in known and count["tag", path] != v:
                return "tag", path
        return None

    def valid(v):
        own, up = classes[v], enclosing(v)
        if not ordered(own):
            return False
        if up is None:
            return True
        gaps = set()
        for p in pages:
            around = [t for t in p if t in classes[count[up]]]
            repeats = len(around) % len(set(around) or {1}) == 0 and all(t == around[i % len(set(around))] for i, t in enumerate(around))
            opened, seen, stood = 0, 0, []
            for t in p:
                opened += t == up
                seen += t in classes[count[up]]
                stood += [(opened, seen % len(classes[count[up]]) if repeats else 0)] if t in own else []
            for i in range(0, len(stood), len(own)):
                first, last = stood[i], stood[i + len(own) - 1]
                if first[0] != last[0]:
                    return False
                gaps |= {first[1], last[1]}
        return len(gaps) == 1

    texts = {t for v in classes if valid(v) for t in classes[v] if t[0] == "text"}
    held = {t[1]: sum(len(x[2]) for p in pages for x in p if x[0] == "text" and x not in texts and (x[1] + "/").startswith(t[1] + "/")) for t in known if t[0] == "tag"}
    most = max(held.values(), default=0)
    depth = lambda p: p.count("/")
    tag = lambda p: p.split("/")[-1].split(".")[0]
    named = [(depth(p), p) for p, n in held.items() if n and tag(p) in ("article", "main") and n >= html_extract.CONTENT_SHARE * most]
    nearly = [(-depth(p), p) for p, n in held.items() if n and n >= html_extract.NEARLY * most]
    return min(named or nearly, default=(0, None))[1], texts


def test_html_templates_equal_brute_force(spark):
    """Random pages of nested elements and blocks: the template of each host, against direct comparison of all its pages."""
    rng = np.random.default_rng(8)
    hosts = {}
    for h in range(24):
        layout = []
        for k in range(rng.integers(2, 6)):
            layout.append((rng.choice(["div", "section", "main", "article", "div class='x y'"]), rng.random(), rng.integers(0, 3)))

        def page(k, layout=layout):
            out = []
            for n, (name, share, inner) in enumerate(layout):
                if rng.random() < 0.15:
                    continue
                repeat = rng.integers(1, 4) if share > 0.7 else 1
                for _ in range(repeat):
                    body = f"<p>label {n}</p>" if share < 0.5 else ""
                    body += "".join(f"<div><p>head {n}.{i}</p><p>told {k} {n} {i} {rng.integers(1000)}</p></div>" for i in range(inner))
                    body += f"<p>story {k} {'word ' * rng.integers(1, 30)}</p>" if share > 0.3 else ""
                    out.append(f"<{name}>{body}</{name.split()[0]}>")
            if rng.random() < 0.2:
                rng.shuffle(out)
            return f"<html><body>{''.join(out)}</body></html>"

        hosts[f"h{h}"] = [page(k) for k in range(rng.integers(1, 8))]
    hosts["copies"] = ["<body><article><p>One</p><p>By us</p></article></body>"] * 5
    rows = [(name, html) for name, pages in hosts.items() for html in pages]
    got = {r.host: (r.content, set(r.texts)) for r in html_extract.templates(spark.createDataFrame(rows, "host string, html string")).collect()}
    for name, pages in hosts.items():
        listed = [[("tag", place[0]) if kind == "tag" else ("text", place[0], value) for kind, value, place in html_extract.parsed(html)] for html in pages]
        content, texts = brute_template(listed)
        assert got[name] == (content, {html_extract.key(*t) for t in texts}), name
    assert sum(bool(t) for _, t in got.values()) > 5


def test_html_extract_keeps_what_only_looks_like_furniture(spark):
    page = "<body><div class='top'>Our site</div><article><h1>T{k}</h1><p>By our staff.</p><div class='share-price'><p>Share price fell {k}.</p></div><div class='share-tools'>Send to all</div><p>if x = {k}, then <math><mi>x</mi></math></p><canvas>drawn {k}</canvas><div class='comments-list'>nice {k}</div></article><div>Next {k}</div></body>"
    for n in (2, 9, 10, 40):
        got = extracted_texts(spark, [("h", page.replace("{k}", str(k))) for k in range(n)])
        assert got == {k: f"T{k}\nBy our staff.\nShare price fell {k}.\nif x = {k}, then x\ndrawn {k}" for k in range(n)}


def test_html_extract_without_the_word_list(spark, sf_dir, monkeypatch):
    """On hosts of two or more texts the template alone finds the articles of the test pages."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").withColumn("host", html_extract.host(F.col("url")))
    pages = pages.join(pages.groupBy("host").agg(F.countDistinct("html").alias("n")).where("n > 1"), "host").drop("n")
    want = {r.page_id: r.text for r in html_extract.extracted(pages).collect()}
    monkeypatch.setattr(html_extract, "FURNITURE_WORDS", frozenset())
    assert want and {r.page_id: r.text for r in html_extract.extracted(pages).collect()} == want


def jaccard_classes(rows):
    sets = {}
    for doc_id, text in rows:
        w = words(text)
        if w and doc_id is not None:
            sets.setdefault(doc_id, []).append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and any(len(x & y) >= 0.8 * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}


def test_near_duplicates(docs, empty):
    got = near_dedup.near_duplicates(widened(docs)).collect()
    want = jaccard_classes([(r[0], r[1]) for r in ROWS])
    assert Counter((r.doc_id, r.class_id) for r in got) == Counter((r[0], want.get(r[0])) for r in ROWS)
    assert near_dedup.near_duplicates(empty).count() == 0
    kept = near_dedup.keep_one(widened(docs))
    assert kept.columns == [*docs.columns, *CLASHES]
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted(set(want.values()))


def test_near_duplicates_of_one_base(spark):
    """Copies of one text that are like it, but not like each other, beside texts that share a passage only."""
    rng = np.random.default_rng(6)
    base = [f"w{k}" for k in rng.integers(0, 5000, 200)]
    rows = []
    for k in range(60):
        copy = list(base)
        for at in rng.choice(200, 3, replace=False):
            copy[at] = f"x{k}_{at}"
        rows.append((k, " ".join(copy)))
    rows.append((99, " ".join(base)))
    rows += [(200 + k, " ".join([*base[:100], *(f"y{k}_{j}" for j in range(14))])) for k in range(30)]
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == jaccard_classes(rows)


def test_near_duplicates_that_repeat_lines(spark):
    """Repeats of a line leave the set of shingles, and so the links, as they are."""
    rows = []
    for k in range(40):
        base = [f"w{k}_{j}" for j in range(104)]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join([*base, *[f"x{k}_{j}" for j in range(16)] * 50]))]
    want = jaccard_classes(rows)
    assert len(set(want.values())) == 40
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_near_duplicates_of_doc_ids_with_several_texts(spark):
    rows = []
    for k in range(0, 50, 10):
        one, two, three = ([f"{c}{k}_{j}" for j in range(80)] for c in "abc")
        rows += [(k, " ".join(one)), (k, " ".join(two)), (k, None), (k + 1, " ".join([*one, "x"])), (k + 2, " ".join([*two, "y"])), (k + 3, " ".join(two)), (k + 4, " ".join(three)), (k + 5, " ".join(three)), (k + 5, " ".join(["z", *one]))]
        rows += [(k + 6 + n, " ".join([*three[:70], *(f"{c}{j}" for j in range(8))])) for n, c in enumerate("pq")]
    want = jaccard_classes(rows)
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and got[1] == got[2] == 0


def test_prob_minhash_estimates_similarity():
    ids = kernels.mix(np.arange(1, 3001, dtype=np.uint64)) >> np.uint64(16)  # as shingles are: hashes
    a, b = ids[:2000], ids[500:2500]
    sketch = near_dedup.prob_minhash(np.concatenate([a, b]), np.repeat([0, 1], 2000), np.ones(4000), 2, 2000)
    assert abs(np.mean(sketch[0] == sketch[1]) - 1500 / 2500) < 0.04
    heavy = np.where(np.arange(2000) < 500, 9.0, 1.0)
    one = near_dedup.prob_minhash(np.concatenate([a, a[:500]]), np.repeat([0, 1], [2000, 500]), np.concatenate([heavy, heavy[:500]]), 2, 2000)
    assert np.mean(one[0] == one[1]) > 0.65  # by weight, not by count


