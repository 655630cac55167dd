"""The pipeline's stages, each on its predecessor's rows, and the queries against their SQL."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from oracle import compare, connect
from yomibon.llm import common, decontaminate, mixing, token_file
from yomibon.llm.queries import ORACLE_SQL, QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, con, name):
    compare(con, spark, sf_dir, QUERIES[name], ORACLE_SQL[name])


def test_operators_are_all_registered():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, tables = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, sf_dir), name)
        tables.append(docs)
        assert docs.columns == columns or name == "token_file"
    identified, deduped, clean, mixed, tokens = tables
    assert identified.count() <= 200 and deduped.count() == deduped.select("doc_id").distinct().count()
    marks = {r.doc_id: r.contaminated for r in decontaminate.contamination(deduped, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
    assert {r.doc_id for r in clean.collect()} == {k for k, bad in marks.items() if not bad}
    assert mixed.count() == mixing.mixed(clean).selectExpr("sum(copies)").first()[0]
    assert Counter(r.doc_id for r in tokens.collect()) == Counter(r.doc_id for r in mixed.collect())


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra int, score string"


def words(text):
    return WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def test_stages_by_brute_force(spark, sf_dir):
    """Each stage on its own input, with awkward rows among documents, against plain Python."""
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first().text
    text = "this is a wholly clean text of some words that nobody else has in this order at all"
    odd = [(None, text + " without an id", "en", "a", 1, 1, "x"), (90_001, None, "en", "a", 1, 1, "x"), (90_002, "", "en", None, 1, 1, "x"), (90_003, "12 !!", "de", "a", 1, 1, "x")]
    odd += [(90_004, text, "en", None, 1, 1, "x"), (90_004, text, "en", None, 1, 1, "x"), (90_005, text + " indeed", None, "b", 1, 1, "x"), (90_006, f"before it {item} behind it", "en", "b", 1, 1, "x"), (90_007, "word " * 20_000 + text, "en", "b", 1, 1, "x")]
    docs = table.selectExpr("*", "1 as extra", "'x' as score").unionByName(spark.createDataFrame(odd, SCHEMA))
    rows = [tuple(r) for r in docs.collect()]
    stages = dict(corpus_pipeline.STAGES)
    run = lambda name, df: common.written(stages[name](spark, df, sf_dir), name)

    kept = Counter(map(tuple, run("language_id", docs).collect()))
    assert not kept - Counter(rows) and kept[odd[4]] == 2 and {r[0] for r in (Counter(rows) - kept)} >= {90_001, 90_002, 90_003}
    assert all(not any(x.isalpha() for x in r[1] or "") for r in Counter(rows) - kept)  # clean documents stay

    sets = {}
    for r in rows:
        w = words(r[1])
        if w and r[0] is not None:
            sets.setdefault(r[0], []).append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    root = {r[0]: r[0] for r in rows if r[0] is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and any(0.8 * max(len(x), len(y)) <= min(len(x), len(y)) and len(x & y) >= 0.8 * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    deduped = run("near_dedup", docs)
    assert Counter(r.doc_id for r in deduped.collect()) == Counter({**{k: 1 for k in root if find(k) == k}, None: 1})

    windows = set()
    for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
        w = words(r.text)
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9)) if w}
    sizes = {len(x) for x in windows}
    dirty = {r[0] for r in rows if any(tuple(w[k : k + n]) in windows for w in [words(r[1])] for n in sizes for k in range(len(w) - n + 1))}
    assert 90_006 in dirty and Counter(map(tuple, run("decontaminate", docs).collect())) == Counter(r for r in rows if r[0] not in dirty)

    size = lambda text: len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    want = {r.source: (r.target, r.source_size) for r in mixing.mixed(docs).select("row.source", "target", "source_size").distinct().collect()}
    mixed = [tuple(r) for r in run("mixing", docs).collect()]
    for source, (target, all_of) in want.items():
        own = [r for r in rows if r[3] == source]
        assert sum(size(r[1]) for r in own) == all_of
        longest = max(size(r[1]) for r in own)
        assert abs(sum(size(r[1]) for r in mixed if r[3] == source) - target) <= 2 * longest
    assert max((Counter(mixed)[r] / Counter(rows)[r] for r in Counter(mixed))) <= 2

    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(token_file.default_tokenizer())
    at = 0
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append([*plain.encode(r[1] or "", add_special_tokens=False).ids, 2])
    for r in run("token_file", docs).orderBy("start").collect():
        ids = next(x for x in by[r.doc_id] if zlib.crc32(np.array(x, "<u4").tobytes()) == r.ids_crc32)
        by[r.doc_id].remove(ids)
        assert (r.start, r.n_tokens) == (at, len(ids))
        at += len(ids)
    assert not any(by.values())


def test_stages_of_an_empty_table(spark, sf_dir):
    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, sf_dir), name)
        assert docs.count() == 0


def test_run(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontaminate", "mixing", "token_file"]
    assert corpus_pipeline.run(spark, sf_dir).columns[:4] == ["doc_id", "start", "n_tokens", "ids_crc32"]
