"""Dictionaries as tables, the lattice of words, and chapters in tiers, against plain Python."""

import random
import re

import pytest

from yomibon.operators import dictionary, lattice, tiered, tiers

LETTERS = "山川上町かa12 。"


def texts_of(rng, n, most=30):
    return ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, most))) for _ in range(n)]


@pytest.mark.parametrize("more,bound", [(0, 1 << 30), (0, 0), (50_000, 1 << 30), (50_000, 0)])
def test_replaced_equals_a_scan(spark, more, bound):
    rng = random.Random(4)
    words = {"山": "ヤマ", "川上": "カワカミ", "川": "カワ", "上町": "ウエマチ", "川上町a": "X", "12": "ジュウニ", "a": "エー", "1": "イチ", "かか": "カカ"}
    texts = [None, "", "山" * 300, *texts_of(rng, 60)]
    docs = spark.createDataFrame([*enumerate(texts)], "k long, text string")
    mapping = spark.createDataFrame([*words.items(), ("", "nothing"), (None, "nothing")], "key string, reading string")
    mapping = mapping.unionByName(spark.range(more).selectExpr("concat('zz', id) as key", "'z' as reading"))
    got = {r.k: r.replaced for r in dictionary.replaced(docs, mapping, "k", broadcast_bytes=bound).collect()}
    pattern = tiers.compiled(words)

    def one(text):
        for start, end, reading in reversed([*tiers.matches(text, words, pattern)]):
            text = text[:start] + reading + text[end:]
        return text

    assert got == {k: None if t is None else one(t) for k, t in enumerate(texts)}


def test_occurrences_carry_their_context(spark):
    docs = spark.createDataFrame([(1, "十二 \n日を𠮷日")], "k long, text string")
    mapping = spark.createDataFrame([("日", "ヒ", 7)], "key string, reading string, extra int")
    rows = [(r.start, r.end, r.lead, r.before, r.after, r.prefix, r.suffix, r.reading, r.extra) for r in dictionary.occurrences(docs, mapping, "k").orderBy("start").collect()]
    assert rows == [(4, 5, "十二", "\n", "を", "二 \n", "を𠮷日", "ヒ", 7), (7, 8, "十二 \n日を𠮷", "𠮷", "", "日を𠮷", "", "ヒ", 7)]
    assert dictionary.occurrences(docs, mapping.limit(0), "k").count() == 0 and dictionary.occurrences(docs.limit(0), mapping, "k").count() == 0


def char_class(c):
    return "space" if c.isspace() else "digit" if c.isdigit() else "kanji" if re.match("[一-鿿]", c) else "kana" if re.match("[ぁ-ヿ]", c) else "latin" if c.isascii() and c.isalpha() else "other"


def all_paths(text, at, words, classes):
    """Every way to cut a text: lists of (start, end, class, cost, reading)."""
    if at == len(text):
        yield []
        return
    run = at
    while run < len(text) and classes[run] == classes[at]:
        run += 1
    steps = {(at, end, classes[at], lattice.UNKNOWN + lattice.UNKNOWN_EACH * (end - at), None) for end in (at + 1, run)} | {w for w in words if w[0] == at}
    for step in steps:
        for rest in all_paths(text, step[1], words, classes):
            yield [step, *rest]


def test_the_path_is_the_cheapest():
    rng = random.Random(8)
    lexicon = [("山川", "kanji", 900, "サンセン"), ("山", "kanji", 1500, "ヤマ"), ("川上", "kanji", 700, "カワカミ"), ("上町か", "kanji", 2500, "ウエマチカ"), ("かa", "kana", 1000, "カエ"), ("山川", "kanji", 900, "ヤマカワ"), ("1", "digit", 100, "イチ")]
    links = {(a, b): rng.choice([0, 300, 2500]) for a in ("bound", "kanji", "kana", "digit", "latin") for b in ("kanji", "kana", "digit", "latin", "space")}
    for text in texts_of(rng, 150, 9):
        classes = [char_class(c) for c in text]
        words = sorted((m.start(), m.start() + len(w), c, cost, r) for w, c, cost, r in lexicon for m in re.finditer(f"(?={w})", text))
        cost, path = lattice.best_path(classes, words, text, links)
        total = lambda p: sum(s[3] for s in p) + sum(links.get((a, b), lattice.UNSEEN) for a, b in zip(["bound", *[s[2] for s in p]], [s[2] for s in p], strict=False))
        assert (cost, len(path)) == min((total(p), len(p)) for p in all_paths(text, 0, words, classes))
        known = {(s, e, c, r): k for s, e, c, k, r in words}
        priced = [(s, e, c, known.get((s, e, c, r), lattice.UNKNOWN + lattice.UNKNOWN_EACH * (e - s)), r) for s, e, _, r, c in path]
        assert total(priced) == cost and "".join(t[2] for t in path) == text
        assert [t[3] for t in path if t[2] == "山川"] in ([], ["サンセン"], ["サンセン"] * 2, ["サンセン"] * 3)


def test_paths_of_awkward_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "   "), (4, "山" * 2000)], "k long, text string")
    words = lattice.word_costs(spark.createDataFrame([("山", "ヤマ")] * 3 + [("川", "カワ")], "surface string, reading string"))
    rows = {r.k: r.path for r in lattice.paths(docs, words, {}, "k").collect()}
    assert rows[1].cost is None and (rows[2].cost, rows[2].tokens) == (0, []) and len(rows[3].tokens) == 1
    assert rows[4].cost == 2000 * 4000 + 2000 * 125 or len(rows[4].tokens) == 1
    assert lattice.tokens(docs.limit(0), words, {}, "k").count() == 0


def test_tiers_have_labels_and_rules(spark):
    text = "1 日と、2 日。東京の山へ、山川町。"
    docs = spark.createDataFrame([(1, text, [(9, 10, "東", "ひがし"), (10, 11, "京", "きょう")]), (2, "山", None), (3, None, None)], "k long, text string, spans array<struct<start:long,end:long,base:string,reading:string>>")
    mapping = spark.createDataFrame(
        [("日", "ニチ", "book", "evidence"), ("山", "ザン", "book", None), ("山", "サン", "common", "corpus"), ("山川", "サンセン", "common", "corpus"), ("東京", "トウキョウ", "common", "corpus"), ("町", "", "book", None)], "key string, reading string, scope string, source string"
    )
    lexicon = spark.createDataFrame([("町", "マチ", 2, "名詞"), ("日", "ヒ", 1, "名詞")], "surface string, reading string, accent long, pos string")
    rules = spark.createDataFrame([("日", ["1"])], "base string, prefixes array<string>")
    rows = tiered.built(docs, mapping, lexicon, "k", rules=rules).orderBy("k", "start").collect()
    got = [(r.k, r.start, r.surface, r.reading, r.reading_source) for r in rows]
    at = text.index
    assert got == [
        (1, 2, "日", "ニチ", "evidence"), (1, at("日。"), "日", "ヒ", "unidic"), (1, 9, "東京", "トウキョウ", "ruby"), (1, at("山へ"), "山", "ザン", "propagation"),
        (1, at("山川"), "山川", "サンセン", "corpus"), (1, at("町"), "町", "マチ", "unidic"), (2, 0, "山", "ザン", "propagation"),
    ]
    assert {r.surface: (r.prefix, r.suffix) for r in rows}["東京"] == (text[6:9], text[11:14])
    both = {r.k: (r.rendered, r.partial) for r in tiered.rendered(docs, tiered.built(docs, mapping, lexicon, "k", rules=rules), "k").collect()}
    assert both[1][0] == "1 ニチと、2 ヒ。トウキョウのザンへ、サンセンマチ。" and both[3] == (None, None) and both[2][0] == "ザン"


def test_gaps_are_tokenized_by_themselves(spark):
    """A word of the lexicon that a scan skipped, as it lay under a longer one, is found in the gap."""
    docs = spark.createDataFrame([(1, "山川上", [(0, 1, "山", "やま")])], "k long, text string, spans array<struct<start:long,end:long,base:string,reading:string>>")
    lexicon = spark.createDataFrame([("山川", "サンセン", 1, "名詞"), ("川", "カワ", 1, "名詞"), ("上", "ウエ", 1, "名詞")], "surface string, reading string, accent long, pos string")
    none = spark.createDataFrame([], "key string, reading string, scope string, source string")
    rows = tiered.built(docs, none, lexicon, "k").orderBy("start").collect()
    assert [(r.surface, r.reading, r.reading_source, r.prefix, r.suffix) for r in rows] == [("山", "ヤマ", "ruby", "", "川上"), ("川", "カワ", "unidic-gap", "山", "上"), ("上", "ウエ", "unidic", "山川", "")]


@pytest.mark.parametrize("bound", [1 << 30, 0])
def test_a_scan_takes_the_same_in_tasks_and_by_joins(spark, bound):
    rng = random.Random(11)
    texts = [None, "", "川上" * 200, *texts_of(rng, 80)]
    docs = spark.createDataFrame([*enumerate(texts)], "k long, text string")
    words = ["山", "川上", "川", "上町", "川上町a", "12", "a", "かか", "町12"]
    mapping = spark.createDataFrame([(w, i) for i, w in enumerate(words)] + [("", 90), (None, 91)], "key string, number int")
    got = {}
    for r in dictionary.taken(docs, mapping, "k", context=("lead", "before", "after"), held_bytes=bound).orderBy("start").collect():
        text = texts[r.k]
        assert words[r.number] == r.surface and (r.before, r.after) == (text[r.start - 1 : r.start] if r.start else "", text[r.end : r.end + 1]) and r.lead == text[: r.start].rstrip()[-8:]
        got.setdefault(r.k, []).append((r.start, r.end))
    pattern = re.compile("|".join(sorted(words, key=len, reverse=True)))
    assert got == {k: [m.span() for m in pattern.finditer(t)] for k, t in enumerate(texts) if t and pattern.search(t)}


@pytest.mark.parametrize("bound", [1 << 30, 0])
def test_words_that_can_be_on_no_path_do_not_go_to_the_texts(spark, bound):
    """A surface of a thousand readings is one word to the texts, the cheapest, and of equal ones that of the lesser reading."""
    rows = [("山川", f"ヤ{i:03}") for i in range(1000)] + [("山川", "ヤ500")] * 3 + [("川上", "カ2"), ("川上", "カ1")]
    words = lattice.word_costs(spark.createDataFrame(rows, "surface string, reading string"))
    assert {r.key: [(w.cost > 0, w.reading) for w in r.words] for r in lattice.cheapest(words).collect()} == {"山川": [(True, "ヤ500")], "川上": [(True, "カ1")]}
    docs = spark.createDataFrame([(1, "山川 川上"), (2, None), (3, "")], "k long, text string")
    found = lattice.tokens(docs, words, {}, "k", held_bytes=bound).orderBy("k", "idx").collect()
    assert [(r.k, r.surface, r.reading) for r in found] == [(1, "山川", "ヤ500"), (1, " ", None), (1, "川上", "カ1")]
