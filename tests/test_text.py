import random
import re

import pytest
from pyspark.sql import functions as F

from yomibon.functions import kana, unicode_udf
from yomibon.operators import alignment, assembly, chapter, chunks, intervals, refine, tiers
from yomibon.sources import markup


def one(spark, f, *values):
    names = [f"c{k}" for k in range(len(values))]
    return spark.createDataFrame([values], ", ".join(f"{n} string" for n in names)).select(f(*map(F.col, names)).alias("x")).first().x


@pytest.mark.parametrize(
    ("f", "value", "want"),
    [
        (kana.to_katakana, "ひらがなゝ", "ヒラガナヽ"),
        (kana.canonical_katakana, "チヂツヅヵゕ", "チジツズカカ"),
        (kana.fold_small, "キョウト", "キヨウト"),
        (kana.without_space, "a 　b\n", "ab"),
        (kana.trimmed, "　雨 ", "雨"),
        (kana.ellipsis, "ネエ...まあ....…", "ネエ…まあ…"),
        (kana.is_cjk, "𠮷", True),
        (kana.is_cjk_narrow, "𠮷", False),
        (kana.is_single_kanji, " 雨 ", True),
        (kana.is_single_kanji, "雨天", False),
        (kana.is_kana, "ア・イ ウ", True),
        (kana.is_kana, "", True),
        (kana.is_kana, "雨", False),
        (kana.is_ascii_word, "JUN-2", True),
        (kana.is_ascii_word, "22", False),
        (kana.looks_translated, "コンピューター", True),
        (kana.looks_translated, "しずか", False),
        (kana.paragraph_spacing, "A\nB\n\nC", "A\n\nB\n\nC"),
        (kana.first_line, "\n \n b \nc", "b"),
        (kana.first_line, " \n", None),
        (kana.slug, " Part: Two!", "Part_Two"),
        (kana.library_path, "./a//b/../c", "a/b/c"),
        (kana.track_number, "012_x.txt", 12),
        (kana.track_number, "x", None),
        (unicode_udf.nfkc, "Ａ…", "A..."),
        (unicode_udf.all_digits, "12²", True),
    ],
)
def test_functions(spark, f, value, want):
    assert one(spark, f, value) == want
    assert one(spark, f, None) is None


def test_two_column_predicates(spark):
    assert one(spark, kana.small_kana_only, "キヨウト", "キョウト") is True
    assert one(spark, kana.small_kana_only, "キヨウト", "キヨウト") is False
    assert one(spark, kana.is_name_candidate, "神崎", "しずか") is True
    assert one(spark, kana.is_name_candidate, "神崎次郎君", "しずか") is False


def test_chunks():
    found = chunks.split_text("  One\ntwo \n \nthree\n\n\n\nfour\n")
    assert found == [("One\ntwo", 2, 9), ("three", 13, 18), ("four", 22, 26)]
    assert [len(c) for c, _, _ in chunks.split_text("雨" * 400 + "\n\n晴")] == [360, 40, 1]
    assert [c[-1] for c, _, _ in chunks.split_text("雨" * 100 + "、" + "雨" * 200 + "！" + "雨" * 100)] == ["！", "雨"]
    assert [len(c) for c, _, _ in chunks.split_text("雨" * 100 + "、" + "雨" * 300)] == [101, 300]
    assert [len(c) for c, _, _ in chunks.split_text("。" + "雨" * 370)] == [360, 11]  # a mark at the start ends nothing
    assert chunks.split_text("") == chunks.split_text(" \n\n ") == []


def test_chunk_invariants():
    rng = random.Random(5)
    for _ in range(300):
        text = "".join(rng.choice("ab。、 \n\n") * rng.randint(1, 40) for _ in range(rng.randint(0, 60)))
        found = chunks.split_text(text, 50)
        assert all(text[a:b] == c and 0 < len(c) <= 50 for c, a, b in found)
        assert "".join("".join(c for c, _, _ in found).split()) == "".join(text.split())


def test_overlap_join_equals_nested_loop(spark):
    rng = random.Random(3)
    spans = lambda n: [(rng.randint(0, 2), s := rng.randint(0, 900), s + rng.randint(1, 500)) for _ in range(n)]
    left, right = spans(80), spans(60)
    a = spark.createDataFrame([(k, *x) for k, x in enumerate(left)], "i long, c long, start long, end long")
    b = spark.createDataFrame([(k, *x) for k, x in enumerate(right)], "j long, c long, r_start long, r_end long")
    got = sorted((r.i, r.j) for r in intervals.overlap_join(a, b, ["c"]).collect())
    want = sorted((i, j) for i, x in enumerate(left) for j, y in enumerate(right) if x[0] == y[0] and x[1] < y[2] and y[1] < x[2])
    assert got == want


def test_markup_resolves_ruby():
    text, spans = markup.page_text("<html><head><title>t</title></head><body><p>雨と<ruby>明日<rp>(</rp><rt>あした</rt><rp>)</rp></ruby>は</p><p>次</p></body></html>")
    assert text == "雨と明日は\n次"
    assert spans == [("明日", "アシタ", 2, 4)]
    assert markup.page_text("") == ("", [])
    text, spans = markup.page_text("a\n\n\n\n<p>  </p><ruby><rb>静</rb><rt>シズ</rt></ruby><ruby>岡<rt>オカ</rt></ruby>に")
    assert all(text[a:b] == base for base, _, a, b in spans) and len(spans) == 2


def test_mapping_guards():
    mapping = {"12": "ジュウニ", "3階": "サンガイ", "川": "カワ", "ABC": "エービー", "z": "ゼット", "る": "ル"}
    found = lambda text: [r for _, _, r in tiers.matches(text, mapping, tiers.compiled(mapping))]
    assert found("4120個") == found("13階") == found("大川") == found("川々") == found("zoo") == found("見る目") == []
    assert found("12年") == found("第12") == ["ジュウニ"]  # a number before 年 or after 第 is a word like others
    assert found("川と") == ["カワ"] and found("ABCD") == ["エービー"] and found("z-1") == ["ゼット"] and found("み る") == ["ル"]
    assert found("川\U0002f800") == [] and found("\U00030000川") == []


def token(surface, reading, start, end, source="unidic", **more):
    return {"surface": surface, "reading": reading, "start": start, "end": end, "source": source, **more}


def test_refine_is_idempotent_for_literal_rules():
    rule = {"pattern": "青森", "replacement": "アオモリ", "reading": "アオモリ", "accent": 2}
    chapter = refine.Chapter("青森へ行く", [])
    chapter.override(rule)
    once = (chapter.text, [dict(t) for t in chapter.tokens])
    chapter.override(rule)
    assert (chapter.text, chapter.tokens) == once and chapter.text == "アオモリへ行く"


def test_refine_keeps_mismatching_surfaces():
    chapter = refine.Chapter("ヤマモトタケシ", [token("竹", "タケ", 4, 6)])
    chapter.override({"pattern": "タケ", "replacement": "ブ", "reading": "ブ", "surface": "武"})
    assert chapter.text == "ヤマモトタケシ" and chapter.tokens[0]["reading"] == "タケ"


def test_refine_updates_what_the_rule_gives():
    rows = [token("川上", "カワカミ", 0, 4, accent=1, pos="名詞"), token("川上", "カワカミ", 5, 9, source="ruby")]
    rule = {"pattern": "カワカミ", "reading": "センジョウ", "accent": 0, "pos": "固有名詞", "source": "Ruby"}
    chapter = refine.Chapter("カワカミとカワカミ", rows)
    chapter.override(dict(rule, pos=None))
    assert chapter.text == "カワカミとセンジョウ"
    assert [(t["reading"], t["source"], t["accent"], t["start"], t["end"], t["o_start"]) for t in chapter.tokens] == [("カワカミ", "unidic", 1, 0, 4, 0), ("センジョウ", "override", 0, 5, 10, 5)]
    chapter = refine.Chapter("カワカミとカワカミ", rows)
    chapter.override({"pattern": "^カワカミ$", "regex": True, "reading": "セン", "pos": "固有名詞"}, source="unidic")
    assert [(t["reading"], t["source"]) for t in chapter.tokens] == [("カワカミ", "unidic"), ("カワカミ", "ruby")]  # the part of speech is another one
    chapter.override(dict(rule, source=None), source="unidic")  # the text has the pattern, and the token of that source goes
    assert [(t["reading"], t["pos"], t["source"]) for t in chapter.tokens] == [("センジョウ", "固有名詞", "override"), ("カワカミ", None, "ruby")]
    chapter = refine.Chapter("カワ", [token("川", None, 0, 2, fallback_reading="カワ")])
    chapter.override({"pattern": "^カ", "regex": True, "surface": "川", "match_surface": "川", "reading": "セン"})
    assert (chapter.text, chapter.tokens[0]["reading"], chapter.tokens[0]["fallback_reading"]) == ("セン", "セン", "カワ")


def test_refine_replaces_what_a_match_covers():
    rows = [token("北", "キタ", 0, 1, o_start=10, o_end=11), token("山", "ヤマ", 1, 2, o_start=11, o_end=12), token("道", "ミチ", 2, 3, o_start=12, o_end=13)]
    chapter = refine.Chapter("北山道", rows)
    chapter.override({"pattern": "北山", "replacement": "ホクザン", "accent": 1, "match_surface": "北山"})
    assert chapter.text == "ホクザン道"
    assert [(t["surface"], t["reading"], t["start"], t["end"], t["o_start"], t["o_end"], t["source"]) for t in chapter.tokens] == [("ホクザン", "ホクザン", 0, 4, 10, 12, "override"), ("道", "ミチ", 4, 5, 12, 13, "unidic")]
    chapter.override({"pattern": "ザン道", "replacement": "X"})  # cuts a token
    assert chapter.text == "ホクザン道"
    chapter = refine.Chapter("山。山", [], original="谷。山")
    chapter.override({"pattern": "山", "replacement": "サン", "match_surface": "山"})  # only where the original has it
    assert chapter.text == "山。サン" and chapter.tokens[0]["o_start"] == 2
    chapter = refine.Chapter("山。", [])
    chapter.override({"pattern": "x*", "regex": True, "replacement": "y"})  # empty matches are none
    assert (chapter.text, chapter.tokens) == ("山。", [])


def test_refine_removes_and_selects():
    chapter = refine.Chapter("ヽ森、モリ", [token("", "ヽ", 0, 1), token("森", "モリ", 3, 5)])
    chapter.remove([{"reading": "ヽ"}, {"surface": "森"}], source="ruby")
    assert len(chapter.tokens) == 2
    chapter.remove([{"reading": "ヽ"}, {"surface": "森"}])
    assert (chapter.text, chapter.tokens) == ("ヽ森、森", [])
    chapter = refine.Chapter("アカイハナ", [token("赤い", "アカイ", 0, 3, o_start=0, o_end=2), token("花", "ハナ", 3, 5, o_start=2, o_end=3)], original="赤い花")
    chapter.select(3, 5, {"replacement": "ハナア", "accent": 2})
    assert chapter.text == "アカイハナア" and [(t["surface"], t["reading"], t["source"]) for t in chapter.tokens][0] == ("赤い", "アカイ", "unidic")
    with pytest.raises(ValueError):
        chapter.select(4, 40, {})


def test_offset_mapper_follows_changes():
    mapped = alignment.offset_mapper("一二三四", "一二XYZ四五")
    assert [mapped(k) for k in range(-1, 9)] == [0, 0, 1, 2, 2, 3, 3, 4, 4, 4]
    same = alignment.offset_mapper("一二三", "一二三")
    assert [same(k) for k in range(4)] == [0, 1, 2, 3]


def test_alignment_by_occurrence_and_hint():
    assert alignment.by_occurrence("山川山", ["山", " 山 ", "川", "山", "", "海"]) == [0, 2, 1, 0, None, None]  # one too many is looked for shortly before the last
    assert alignment.by_occurrence("aXbX", ["X", "X", "b"]) == [1, 3, 2]
    text = "カワ" + "。" * 40 + "カワ"
    assert alignment.by_hint(text, ["カワ", "カワ", "カワ", "ヤマ", ""], [3, 42, 25, 0, 0]) == [0, 42, 0, None, None]


def test_offsets_follow_collapsed_dots():
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choice([".", "…", "a", "。"]) * rng.randint(1, 5) for _ in range(rng.randint(0, 12)))
        new, moved = assembly.collapsed(text, list(range(len(text) + 1)))
        assert new == re.sub(r"\.{3,}|…{2,}", "…", text) and moved == sorted(moved) and moved[-1:] == [len(new)]
        assert all(len(re.sub(r"\.{3,}|…{2,}", "…", text[:k])) == moved[k] for k in range(len(text) + 1) if not any(m.start() < k < m.end() for m in re.finditer(r"\.{3,}|…{2,}", text)))


def test_markup_edits_keep_marks():
    rng = random.Random(6)
    for _ in range(300):
        text = "".join(rng.choice("ab.. \n") for _ in range(rng.randint(0, 30)))
        marks = sorted(rng.randint(0, len(text)) for _ in range(5))
        new, moved = markup.edited(text, marks, re.compile(r"\.+|\n"), "<>")
        assert new == re.sub(r"\.+|\n", "<>", text)
        for a, b in zip(marks, moved, strict=True):
            inside = next((m for m in re.finditer(r"\.+|\n", text) if m.start() < a < m.end()), None)
            assert b == len(re.sub(r"\.+|\n", "<>", text[: inside.start() if inside else a]))


def test_markup_of_blocks_and_ruby():
    assert markup.page_text("<div><section>a</section><p>b<div>c</div></div>d<h1>e") [0] == "a\nbc d\ne".replace("c d", "cd")
    assert markup.page_text("<?xml version='1.0'?><html xmlns='x'><title/><p/>a<p>b</p></html>")[0] == "a\nb"
    assert markup.page_text("<ruby>字</ruby>〝x〟  \n\n\n\ny") == ('字"x"\n\ny', [("字", "字", 0, 1)])
    assert markup.page_text("<p>十<ruby>日<rt>か</rt></ruby>と</p>", True, lambda x: x.replace("十", "トオ"))[0] == "トオカと"
    text, found = markup.evidence("<p>12 <ruby>日<rt>か</rt></ruby> <b>め</b>の<ruby>夜<rt>よ</rt></ruby>。</p>")
    assert [(s["prefix"], s["suffix"], s["raw"]) for s in found] == [("12", "めの", "か"), ("", "", "よ")]


def brute_chapter(text, spans, mapping, lexicon):
    """(start, end, reading, source) by marking characters as taken, tier by tier."""
    taken, found = [False] * len(text), []

    def put(start, end, reading, source):
        if start < end and not any(taken[start:end]):
            taken[start:end] = [True] * (end - start)
            found.append((start, end, markup.katakana(reading), source))

    narrow = lambda x: bool(re.search("[一-鿿々〆ヵヶ]", x))
    k = 0
    while k < len(spans):
        best = 0
        for n in range(2, len(spans) - k + 1):
            part = spans[k : k + n]
            joined = all(a["end"] == b["start"] for a, b in zip(part, part[1:], strict=False))
            if joined and "".join(x["base"] for x in part) in mapping and narrow("".join(x["base"] for x in part)):
                best = n
        if best:
            put(spans[k]["start"], spans[k + best - 1]["end"], mapping["".join(x["base"] for x in spans[k : k + best])], "ruby")
        else:
            put(spans[k]["start"], spans[k]["end"], spans[k]["reading"], "ruby")
        k += max(1, best)

    def scan(part, words, allowed):
        at = 0
        while at < len(part):
            word = max((w for w in words if part.startswith(w, at)), key=len, default=None)
            if word and allowed(part, at, at + len(word)):
                yield at, at + len(word), words[word]
            at += len(word) if word else 1

    for a, b, r in scan(text, mapping, tiers.match_allowed):
        put(a, b, r, "propagation")
    for a, b, r in scan(text, lexicon, lambda p, x, y: narrow(p[x:y])):
        put(a, b, r, "unidic")
    at = 0
    for start in [*(k for k in range(len(text)) if taken[k]), len(text)]:
        if start > at:
            for a, b, r in [*scan(text[at:start], lexicon, lambda p, x, y: narrow(p[x:y]))]:
                found.append((at + a, at + b, markup.katakana(r), "unidic-gap"))
        at = start + 1
    return sorted(found)


def test_chapter_tokens_equal_brute_force():
    rng = random.Random(9)
    mapping, lexicon = {"山川": "ヤマカワ", "川上町": "カワカミチョウ", "上町": "ウエマチ", "a": "エー"}, {"山": "ヤマ", "川": "カワ", "川上": "カワカミ", "町": "マチ", "町山": "マチヤマ", "かな": "カナ", "上": "ウエ"}
    tools = tiers.compiled(lexicon), tiers.compiled(mapping), chapter.prefixes(mapping)
    for _ in range(500):
        text = "".join(rng.choice(["山", "川", "上", "町", "かな", "a", "。"]) for _ in range(rng.randint(0, 14)))
        spans, at = [], 0
        while at < len(text):
            n = rng.randint(1, 2)
            if rng.random() < 0.3 and at + n <= len(text):
                spans.append({"start": at, "end": at + n, "base": text[at : at + n], "reading": "よみ"})
                at += n
            at += rng.random() < 0.6
        got = [(t["start"], t["end"], t["reading"], t["reading_source"]) for t in chapter.chosen(text, spans, mapping, lexicon, tools)]
        assert got == brute_chapter(text, spans, mapping, lexicon)


def test_chapter_from_page_to_text(spark):
    """From an annotated page to its texts in katakana and in part."""
    page = "<p>東の<ruby>村<rt>むら</rt></ruby>へ、<ruby>北<rt>きた</rt></ruby><ruby>野<rt>の</rt></ruby>さんと<ruby>今日<rt>本日</rt></ruby>行く。村は雨。</p>"
    words = spark.createDataFrame([("村", "ムラ", 2, "名詞"), ("東", "ヒガシ", 0, "名詞"), ("今日", "キョウ", 1, "名詞"), ("行", "イ", None, None), ("雨", "アメ", 1, "名詞"), ("雨", "アマ", 1, None)], "surface string, reading string, accent long, pos string")
    docs = spark.createDataFrame([(1, page)], "chapter long, html string").select("chapter", markup.parse_markup("html").alias("m")).selectExpr("chapter", "m.text as text", "transform(m.spans, s -> struct(s.start, s.end, s.base, s.reading)) as spans")
    found = chapter.built(docs, {"北野": "キタノ"}, words, "chapter").cache()
    rows = {r.token_idx: r for r in found.collect()}
    assert [(rows[k].surface, rows[k].reading, rows[k].reading_source) for k in sorted(rows)] == [("東", "ヒガシ", "unidic"), ("村", "ムラ", "ruby"), ("北野", "キタノ", "ruby"), ("今日", "本日", "ruby"), ("行", "イ", "unidic"), ("村", "ムラ", "unidic"), ("雨", "アマ", "unidic")]
    assert rows[3].fallback_reading == "キョウ" and (rows[1].accent, rows[1].validated) == (2, True) and not rows[2].validated
    assert (rows[2].prefix, rows[2].suffix) == ("村へ、", "さんと")
    assert chapter.rendered(docs, found, "chapter").first().rendered == "ヒガシのムラへ、キタノさんと本日イく。ムラはアマ。"
    assert chapter.rendered(docs, found, "chapter", partial=True).first().rendered == "東の村へ、キタノさんと本日行く。村は雨。"


def test_lexicon_tokens_cover_the_text(spark):
    docs = spark.createDataFrame([(1, "山の川上"), (2, ""), (3, None), (4, "なし")], "k long, text string")
    rows = tiers.lexicon_tokens(docs, {"山": "ヤマ", "川上": "カワカミ"}, "k").orderBy("k", "idx").collect()
    assert [(r.k, r.surface, r.reading) for r in rows] == [(1, "山", "ヤマ"), (1, "の", None), (1, "川上", "カワカミ"), (4, "なし", None)]
