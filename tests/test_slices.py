"""Row functions in slices, and results that the findings of round 3 are about."""

import pyarrow as pa

from pyspark.sql import functions as F
from pyspark.sql import types as T

from yomibon.functions import kana
from yomibon.functions.slices import by_row, slices
from yomibon.operators import tokens


def test_slices_are_few_rows_and_few_bytes():
    cuts = [len(x) for (x,) in slices([pa.array(["a"] * 5 + ["b" * 4000] * 4)], 6, 5000)]
    assert sum(cuts) == 9 and max(cuts) <= 6 and cuts[-1] == 1


def test_rows_come_back_in_order(spark):
    @by_row(T.StringType())
    def said(n, text):
        return None if n % 3 == 0 else f"{n}{text}"

    rows = spark.range(3000, numPartitions=2).select("id", said("id", F.lit("x")).alias("s")).collect()
    assert all(r.s == (None if r.id % 3 == 0 else f"{r.id}x") for r in rows) and len(rows) == 3000
    assert spark.range(0).select(said("id", F.lit("x"))).count() == 0


def test_words_stand_where_many_texts_have_them(spark):
    docs = spark.range(700, numPartitions=1).selectExpr("id", "if(id % 5 = 0, null, repeat('ab  cde ', cast(id % 4 as int))) as text").select("id", tokens.words("text").alias("w"))
    sizes = F.transform("w", lambda w: F.char_length(w["word"]).cast("long") + 1)
    for r in docs.select("id", tokens.rendered_offsets("w", sizes).alias("x")).collect():
        want = [p for k in range(r.id % 4) for p in ((10 * k, 10 * k + 3), (10 * k + 5, 10 * k + 9))]
        assert r.x is None if r.id % 5 == 0 else [(a.t_start, a.t_end) for a in r.x] == want


def test_upper_case_keeps_the_number_of_characters(spark):
    assert spark.range(1).select(kana.upper_by_character(F.lit("ßüa"))).head()[0] == "ẞÜA"
