"""Chapters as rows: rules, tiers, letters and replacements without a pandas group, or a Python object a letter, of their own."""

import re

import pytest
from pyspark.sql import functions as F

from yomibon.operators import dictionary, refine, tiers, tokens
from yomibon.plans import library_queries, text_queries

TEXTS = ["the cat, the Hat", "", None, "Áthe東the é1", " the", "zZ[`{@aA", "x" * 9000 + " the"]


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_letter_runs_equal_a_pattern(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS * 90)), "k int, text string").coalesce(1)
    got = {r.k: r.w and [(w.word, w.start, w.end) for w in r.w] for r in docs.select("k", tokens.letter_runs("text").alias("w")).collect()}
    for k, text in enumerate(TEXTS * 90):
        assert (got[k] or []) == [(m[0], m.start(), m.end()) for m in re.finditer("[A-Za-z]+", text or "")]
        assert (got[k] is None) == (text is None)


def as_token_rows(rows, *keys):
    return rows.select(*keys, "text", F.inline_outer("tokens"))


def test_rules_are_the_same_on_rows_of_chapters_and_of_tokens(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "k int, text string")
    each = F.transform(tokens.letter_runs("text"), lambda w: F.struct(w["word"].alias("surface"), w["word"].alias("reading"), w["start"].alias("start"), w["end"].alias("end"), F.lit("ruby").alias("source")))
    rows = docs.select("k", "text", each.alias("tokens"))
    rules, removals = [{"pattern": "the", "replacement": "THEE", "reading": "ザ"}, {"pattern": "at", "replacement": "AT"}], [{"surface": "cat"}]
    whole = refine.refined(rows, rules, removals, "k")
    assert whole.columns == ["k", "text", "surface", "reading", "start", "end", "source"]
    assert rows_of(whole) == rows_of(refine.refined(as_token_rows(rows, "k"), rules, removals, "k"))
    assert ("the", None) not in {(r.surface, r.start) for r in whole.collect()}
    assert [r.text for r in whole.where("k = 1").collect()] == [""]  # a chapter without tokens stays


@pytest.mark.parametrize("name", ["ja_refine_replace", "ja_refine_covered", "ja_refine_shift", "ja_remove_rule"])
def test_rules_need_no_shuffle(spark, sf_dir, name):
    plan = getattr(library_queries, name)(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "InPandas" not in plan


def test_tiers_are_settled_in_rows(spark, sf_dir):
    assert "InPandas" not in plan_of(text_queries.ja_tier_precedence(spark, sf_dir))
    rows = [(1, 2, 0, 4, "b"), (1, 1, 3, 5, None), (1, 2, 5, 6, "a"), (1, 2, 5, 9, "c"), (2, 2, 0, 4, "b"), (None, 1, 0, 1, "n")]
    found = tiers.select_free(spark.createDataFrame(rows, "k int, tier int, start long, end long, surface string"), "k")
    assert rows_of(found) == sorted([rows[1], rows[3], rows[4], rows[5]], key=repr)


@pytest.mark.parametrize("held", [0, 1 << 20])
def test_replacements_scan_whatever_the_dictionary_is_held_by(spark, held):
    docs = spark.createDataFrame([(1, "12日は雨、東京12日"), (2, "112 雨天 お日"), (3, None), (4, "")], "k int, text string")
    words = spark.createDataFrame([("12", "ジュウニ"), ("12日", "a"), ("東京", "b"), ("雨", "c"), ("", "never")], "key string, reading string")
    got = {r.k: r.replaced for r in dictionary.replaced(docs, words, "k", held_bytes=held).collect()}
    assert got == {1: "aはc、ba", 2: "112 雨天 お日", 3: None, 4: ""}
