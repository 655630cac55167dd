"""Edits by hand and selections in rows of chapters: nothing is a pandas group, and what chapters ask for themselves is not shuffled."""

import pytest
from pyspark.sql import functions as F

from yomibon.operators import refine
from yomibon.plans import library_queries

KIND = "array<struct<surface:string,reading:string,accent:long,start:long,end:long,source:string>>"
#: With nulls, without tokens, with tokens that overlap, and one of a null key.
ROWS = [
    (1, "ab cd ef", [("ab", "ab", None, 0, 2, "x"), ("ef", "ef", 1, 6, 8, None), ("cd", None, None, 3, 5, "y")]),
    (2, "", []), (3, None, None), (4, "abc", [("ab", "ab", None, 0, 2, "x"), ("bc", "bc", None, 1, 3, "x")]), (None, "𠮷 山", [("𠮷", "ヨシ", 2, 0, 1, "z"), ("山", "ヤマ", 0, 2, 3, "z")]), (6, "ab", [("ab", "ab", None, 0, 2, "x")]),
]
EDITS = {1: [(0, "LONGER", None), (2, None, 5)], 3: [(0, "x", 1)], 4: [(1, "Q", 3), (0, None, None)], None: [(1, "", None), (9, "no", 1)]}
PICKS = {1: [(0, 2, "LONGER", "R", None, "n", 4), (3, 8, None, None, "s", None, None)], 4: [(1, 2, "", None, None, None, None), (2, 3, "zz", "R", None, None, 1)], None: [(0, 3, None, "R", None, None, 2)]}


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def chapters(spark):
    return spark.createDataFrame(ROWS * 60, f"k long, text string, tokens {KIND}").dropDuplicates(["k"]).coalesce(1)


def by_hand(change):
    found = []
    for k, text, tokens in ROWS:
        names = ["surface", "reading", "accent", "start", "end", "source"]
        chapter = refine.Chapter(text or "", [dict(zip(names, t, strict=True)) for t in tokens or []])
        change(k, chapter)
        found += [(k, chapter.text, *(t[n] for n in names)) for t in chapter.tokens or [dict.fromkeys(names)]]
    return sorted(found, key=repr)


def forms(spark, wanted, kind):
    """Chapters and what is wanted as rows with a table, as tokens with a table, and as rows with an array."""
    rows, table = chapters(spark), spark.createDataFrame([(k, *w) for k, listed in wanted.items() for w in listed] + [(99, *next(iter(wanted.values()))[0])], "k long, " + ", ".join(f"`{n}` {t}" for n, t in kind.items()))
    yield rows, table
    yield rows.select("k", "text", F.inline_outer("tokens")), table
    listed = spark.createDataFrame([(k, listed) for k, listed in wanted.items()], "j long, w array<struct<" + ",".join(f"{n}:{t}" for n, t in kind.items()) + ">>")
    yield rows.join(listed, F.col("k").eqNullSafe(F.col("j")), "left"), F.col("w")


def test_edits_are_those_of_single_chapters(spark):
    want = by_hand(lambda k, c: c.edit(sorted(EDITS.get(k, []), key=lambda e: -e[0])))
    assert any(t[1] == "LONGER cd ef" for t in want)
    for rows, edits in forms(spark, EDITS, refine.EDIT):
        found = refine.edited(rows, edits, "k")
        assert found.columns == ["k", "text", "surface", "reading", "accent", "start", "end", "source"] and rows_of(found) == want


def test_selections_are_those_of_single_chapters(spark):
    def change(k, chapter):
        for w in sorted(PICKS.get(k, []), key=lambda w: -w[0]):
            chapter.select(w[0], w[1], dict(zip(refine.SELECTION, w, strict=True)))

    want = by_hand(change)
    for rows, picks in forms(spark, PICKS, refine.SELECTION):
        assert rows_of(refine.selected(rows, picks, "k")) == want
    wrong = refine.selected(chapters(spark).where("k = 6"), F.array(F.struct(*[F.lit(9).cast(t).alias(n) for n, t in refine.SELECTION.items()])), "k")
    with pytest.raises(Exception, match="no such selection"):
        wrong.collect()


@pytest.mark.parametrize("name", ["ja_edit_token", "refine_selection"])
def test_queries_need_neither_groups_nor_a_shuffle(spark, sf_dir, name):
    plan = getattr(library_queries, name)(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "InPandas" not in plan
