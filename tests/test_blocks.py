"""Chapters whose dictionaries tasks hold: the same tokens and texts as by joins, in one pass without a shuffle."""

import random
from html.parser import HTMLParser

import pytest

from yomibon.operators import blocks, lattice, tiered
from yomibon.plans import chapter_queries
from yomibon.sources import markup

DOCS = "k long, text string, spans array<struct<start:long,end:long,base:string,reading:string>>"
BITS = ["山", "川", "上", "町", "山川", "か", "ガ", "a", "ab", "1", "12", "日", "。", " ", "  ", "\n", "　", "々"]


def chapters(rng, n):
    for k in range(n):
        text = "".join(rng.choice(BITS) for _ in range(rng.randint(0, 16)))
        spans, at = [], 0
        while at < len(text):
            size = rng.randint(1, 2)
            if rng.random() < 0.3:  # some reach over white space, or beyond the text
                spans.append((at, at + size, text[at : at + size], rng.choice(["よみ", "ヤマ", "雨", "ぢ", None])))
            at += rng.choice([size, size, 1, 3])
        rng.shuffle(spans)
        yield k, text, spans if spans or k % 2 else None


def tables(spark, blank):
    mapping = [("山川", "サンセン", "book", "evidence"), ("山", "ザン", "book", None), ("山", "サン", "common", "corpus"), ("川上", "カワカミ", "common", "corpus"), ("日", "ニチ", "book", None), ("ab", "エー", "common", "x"), ("12", "ジュウニ", "book", None), ("町", "", "book", None), (None, "x", "book", None), ("上町", "ウエマチ", "common", None)]
    words = [("町", "マチ", 2, "名詞"), ("日", "ヒ", 1, "名詞"), ("山", "ヤマ", 1, "名詞"), ("山", "ヤマ", 0, None), ("川", "カワ", None, "名詞"), ("川", "ガワ", 1, None), ("上", "ウエ", 0, "名詞"), ("川上", "かわかみ", 3, None), ("か", "カ", 1, None), ("々", None, 1, None), ("町山", "マチヤマ", 2, "名詞")]
    if blank:
        mapping.append(("川 山", "カワヤマ", "book", "evidence"))
    rules = spark.createDataFrame([("日", ["1", "12"]), ("山", ["2"]), ("ab", None)], "base string, prefixes array<string>")
    lexicon = spark.createDataFrame(words, "surface string, reading string, accent long, pos string")
    return spark.createDataFrame(mapping, "key string, reading string, scope string, source string"), lexicon, rules


def tokenizers(lexicon):
    costs = lattice.word_costs(lexicon.where("reading is not null").select("surface", "reading"))
    return [None, tiered.lattice_tokenizer(costs, {("space", "kanji"): 10, ("kanji", "kanji"): 700, ("bound", "kanji"): 9000, ("kana", "space"): 50})]


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("blank", [False, True])
def test_tokens_are_the_same_in_tasks_and_by_joins(spark, blank):
    docs = spark.createDataFrame([*chapters(random.Random(5), 250), (900, None, None), (901, "", []), (902, "1 " * 90 + "日", None)], DOCS)
    mapping, lexicon, rules = tables(spark, blank)
    for tokenizer in tokenizers(lexicon):
        options = {"tokenizer": tokenizer, "rules": rules}
        held, joined = (tiered.built(docs, mapping, lexicon, "k", **options, held_bytes=most) for most in (1 << 20, 0))
        assert (held.dtypes, rows_of(held)) == (joined.dtypes, rows_of(joined)) and held.count() > 300
        assert "Exchange" not in held._jdf.queryExecution().executedPlan().toString()
        whole, parts = (tiered.renders(docs, mapping, lexicon, "k", **options, held_bytes=most) for most in (1 << 20, 0))
        assert (whole.dtypes, rows_of(whole)) == (parts.dtypes, rows_of(parts)) and whole.count() == 253


def test_chapters_are_not_shuffled(spark, sf_dir):
    """The chapters' queries read each text once, whatever the number of tokens."""
    for query in (chapter_queries.chapter_tokens, chapter_queries.chapter_renders, chapter_queries.chapter_lattice_tokens):
        plan = query(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "Join" not in plan and "Aggregate" not in plan


def test_what_is_remembered_is_forgotten_in_time():
    """A block's tokens are the same whether it is remembered or not, and the memo begins anew when it is full."""
    rng = random.Random(6)
    made = lambda: blocks.Chapters(blocks.Scan({"山": "ヤマ"}), {"川": ("カワ", "x"), "日": ("ニチ", "x")}, {}, {}, {"日": {"1"}}, {"山": "ヤマ"}, {})
    one, texts = made(), ["1 日", "2 日", "日", "山川", *(t for _, t, _ in chapters(rng, 300))] * 2
    named = lambda c, t: [(at + s, *c.tokens.rows[k]) for at, starts, numbers in c.blocks(t, []) for s, k in zip(starts, numbers, strict=True)]
    assert [named(one, t) for t in texts] == [named(made(), t) for t in texts]
    assert [bool(named(one, t)) for t in texts[:4]] == [True, False, False, True] and one.weight > 0
    one.weight = blocks.WEIGHT + 1
    assert one.full()
    one.forget()
    assert not one.memo and not one.full()


def test_paths_by_pieces_are_those_of_whole_texts():
    rng = random.Random(7)
    words = {"山川": [("kanji", 900, "サンセン")], "山": [("kanji", 1500, "ヤマ"), ("kana", 1500, "ヤ")], "川": [("kanji", 900, "カワ")], "かa": [("kana", 1000, "カエ")], "1": [("digit", 100, "イチ")]}
    links = {(a, b): rng.choice([0, 300, 2500]) for a in ("bound", "kanji", "kana", "space") for b in ("kanji", "kana", "digit", "space")}
    for known in (words, {**words, "川 山": [("kanji", 1, "カワヤマ")]}):
        own = lattice.Lattice(known, links)
        for _ in range(400):
            text = "".join(rng.choice([*BITS[:7], "a", "1", " ", "  ", "\n", "　"]) for _ in range(rng.randint(0, 12)))
            assert own.path(text) == own.block(text)


def test_simple_pages_are_read_as_the_parser_reads_them():
    rng = random.Random(8)
    bits = [*(f"<{end}{tag}>" for tag in ("p", "ruby", "rt", "rp", "br", "li", "h1", "span") for end in ("", "/")), "漢字", "かな", " ", "\n", "a>b", "...", "ガ", "&amp;", "<!--c-->", "<P>", "<b class=x>"]
    fed = 0
    for turn in range(2000):
        page = "".join(rng.choice(bits if turn % 4 == 0 else bits[:-4]) for _ in range(rng.randint(0, 14)))
        one, other = markup.Reader(), markup.Reader()
        one.read(page)
        HTMLParser.feed(other, page)
        other.close()
        assert (one.text, one.spans) == (other.text, other.spans)
        fed += one.rawdata == "" and one.lasttag == "???"
    assert fed > 1000


def test_connections_of_rows_are_those_of_words(spark):
    texts = [["山", "a", "1", "か"], [], None, ["か"], ["山", "山", "、"]]
    rows = spark.createDataFrame([*enumerate(texts)], "k long, words array<string>")
    words = spark.createDataFrame([(k, n, w) for k, text in enumerate(texts) for n, w in enumerate(text or [])], "k long, n long, surface string")
    assert lattice.connection_costs_of_rows(rows, "words") == lattice.connection_costs(words, "k", order="n") != {}
