"""Reading evidence per base: counts, shares, arbitration, corpus filters, contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Thresholds of the arbitration and of the corpus filter.
ALT_SHARE, NAME_SHARE, SURE_SHARE, SURE_TOTAL = 0.3, 0.9, 0.95, 3
CORPUS_TOTAL, DOMINANCE, TOP_CONTEXTS = 3, 0.9, 8
#: Samples kept of a base's contexts, prefixes listed, and the least share of a prefix that makes a rule.
SAMPLES, TOP_PREFIXES, RULE_SHARE = 12, 6, 0.1


def reading_counts(observations: DataFrame) -> DataFrame:
    """(base, reading, ...) -> base, reading, n: partial counts are combined before the shuffle."""
    return observations.groupBy("base", "reading").agg(F.count(F.lit(1)).alias("n"))


def shares(counts: DataFrame) -> DataFrame:
    """base, reading, n, of base: total, the share of the top reading and of the next; ties by reading."""
    order = Window.partitionBy("base").orderBy(F.desc("n"), "reading")
    every = Window.partitionBy("base")
    rows = counts.select("base", "reading", "n", F.row_number().over(order).alias("rank"), F.sum("n").over(every).alias("total"), F.lead("n").over(order).alias("next_n"), F.count(F.lit(1)).over(every).alias("n_readings"))
    top = rows.where("rank = 1")
    return top.select("base", "reading", "n", "total", "n_readings", (F.col("n") / F.col("total")).alias("share"), (F.coalesce("next_n", F.lit(0)) / F.col("total")).alias("alt_share"))


def arbitrated(counts: DataFrame, variants: DataFrame | None = None, is_single=None, is_ascii=None, is_translation=None, is_name=None, aligned=None) -> DataFrame:
    """The decision on each base's top reading, the first rule that holds:

    skip_single, accept_ascii, skip_translation, skip_contested (another reading has ALT_SHARE),
    accept_variant (a dictionary knows it), align_small (it differs from a variant by small kana only),
    accept_name, accept_sure, or undecided. The predicates are columns over base, reading, variants.
    """
    no = F.lit(False)
    rows = shares(counts)
    if variants is not None:
        rows = rows.join(variants, "base", "left")
        known = F.coalesce(F.array_contains("variants", F.col("reading")), no)
    else:
        known = no
    return rows.withColumn(
        "decision",
        F.when(no if is_single is None else is_single, "skip_single")
        .when(no if is_ascii is None else is_ascii, "accept_ascii")
        .when(no if is_translation is None else is_translation, "skip_translation")
        .when(F.col("alt_share") >= ALT_SHARE, "skip_contested")
        .when(known, "accept_variant")
        .when(no if aligned is None else F.coalesce(aligned.isNotNull(), no), "align_small")
        .when((F.col("share") >= NAME_SHARE) & (no if is_name is None else is_name), "accept_name")
        .when((F.col("total") >= SURE_TOTAL) & (F.col("share") >= SURE_SHARE), "accept_sure")
        .otherwise("undecided"),
    )


def corpus_filter(counts: DataFrame) -> DataFrame:
    """Bases seen often enough with one dominant reading."""
    return shares(counts).where((F.col("total") >= CORPUS_TOTAL) & (F.col("share") >= DOMINANCE)).select("base", "reading", "total")


def top_contexts(observations: DataFrame, context: str, k: int = TOP_CONTEXTS, weight: str | None = None) -> DataFrame:
    """(base, context[, weight]) -> the k most frequent contexts of each base, with rank; ties by value."""
    number = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counted = observations.where(F.col(context).isNotNull() & (F.col(context) != "")).groupBy("base", F.col(context).alias("value")).agg(number.alias("n"))
    counted = counted if weight is None else counted.where("n > 0")  # weights may cancel out
    rank = F.row_number().over(Window.partitionBy("base").orderBy(F.desc("n"), "value"))
    return counted.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def overlay(book: DataFrame, corpus: DataFrame) -> DataFrame:
    """(base, reading) of the book, and of the corpus where the book has none; origin says which."""
    rest = corpus.join(book.select("base"), "base", "left_anti")
    return book.withColumn("origin", F.lit("book")).unionByName(rest.withColumn("origin", F.lit("corpus")))


def compounds(observations: DataFrame, *keys: str) -> DataFrame:
    """Runs of two or more neighbouring one-character bases (keys..., pos, base, reading): joined base and reading."""
    singles = observations.where(F.char_length("base") == 1)
    run = F.col("pos") - F.row_number().over(Window.partitionBy(*keys).orderBy("pos"))
    rows = singles.withColumn("run", run).groupBy(*keys, "run").agg(F.min("pos").alias("pos"), F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("pos", "base", "reading"))).alias("parts")).where("n > 1")
    join = lambda name: F.array_join(F.transform("parts", lambda p: p[name]), "")
    return rows.select(*keys, "pos", "n", join("base").alias("base"), join("reading").alias("reading"))


def diagnostics(counts: DataFrame) -> DataFrame:
    """base, total, n_readings, share, flagged (several readings without a clear first), score."""
    flagged = (F.col("n_readings") > 1) & ((F.col("share") < 0.9) | (F.col("n_readings") >= 3))
    return shares(counts).select("base", "total", "n_readings", "share", flagged.alias("flagged"), ((1 - F.col("share")) * F.col("total")).alias("score"))


def observed(rows: DataFrame) -> DataFrame:
    """rows (base, reading, raw, suffix, prefix, pos): one a sighting -> base, reading, n, and of the reading: whether any
    raw form has hiragana, Latin letters, a middle dot, a long mark."""
    raw = F.col("raw")
    flags = {"hiragana": r"[\x{3040}-\x{309F}]", "latin": r"\p{IsLatin}", "middle_dot": "・", "long_mark": "ー"}
    return rows.groupBy("base", "reading").agg(F.count(F.lit(1)).alias("n"), *[F.bool_or(F.rlike(raw, F.lit(pattern))).alias(name) for name, pattern in flags.items()])


def samples(rows: DataFrame, column: str, most: int = SAMPLES) -> DataFrame:
    """rows (base, pos, column) -> base, samples: the first values that say something, limited by rank before they are collected."""
    some = rows.where(F.col(column) != "").select("base", "pos", F.col(column).alias("value"))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("base").orderBy("pos", "value"))).where(F.col("rank") <= most)
    return some.groupBy("base").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda x: x["value"]).alias("samples"))


def accumulated(rows: DataFrame) -> DataFrame:
    """The sightings of observed() -> base, total, single (whether the base is one ideograph), suffix_samples, prefix_samples."""
    from ..functions.kana import is_single_kanji

    totals = rows.groupBy("base").agg(F.count(F.lit(1)).alias("total")).withColumn("single", is_single_kanji(F.col("base")))
    for name in ("suffix", "prefix"):
        found = samples(rows, name).withColumnRenamed("samples", f"{name}_samples")
        totals = totals.join(found, "base", "left").withColumn(f"{name}_samples", F.coalesce(f"{name}_samples", F.array().cast("array<string>")))
    return totals


def top_list(rows: DataFrame, column: str, most: int) -> DataFrame:
    """base, list array<struct<value,count>>: the most frequent contexts, by count, then value."""
    top = top_contexts(rows, column, most)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", "value", "n"))), lambda x: F.struct(x["value"].alias("value"), x["n"].alias("count")))
    return top.groupBy("base").agg(listed.alias("list"))


def serialized(rows: DataFrame, lexicon: DataFrame | None = None) -> DataFrame:
    """The sightings of observed() -> base, reading, count, suffix, suffixes, prefixes: the evidence that is kept of a book.

    The reading is the most frequent one, as the lexicon (surface, reading) spells it if they differ in small kana only.
    """
    from ..functions.kana import small_kana_only

    top = shares(reading_counts(rows)).select("base", "reading", F.col("n").alias("count"))
    if lexicon is not None:
        known = lexicon.groupBy(F.col("surface").alias("base")).agg(F.min("reading").alias("known"))
        top = top.join(known, "base", "left").withColumn("reading", F.when(small_kana_only(F.col("reading"), F.col("known")), F.col("known")).otherwise(F.col("reading"))).drop("known")
    for name, column, most in (("suffixes", "suffix", TOP_CONTEXTS), ("prefixes", "prefix", TOP_PREFIXES)):
        listed = top_list(rows, column, most).withColumnRenamed("list", name)
        top = top.join(listed, "base", "left").withColumn(name, F.coalesce(name, F.array().cast("array<struct<value:string,count:bigint>>")))
    return top.withColumn("suffix", F.coalesce(F.get("suffixes", F.lit(0))["value"], F.lit("")))


def context_rules(rows: DataFrame) -> DataFrame:
    """rows (base, prefix): sightings -> base, prefixes, longest: for one-ideograph bases the numbers that stand before them
    often enough (RULE_SHARE of all that have one, among the TOP_PREFIXES), which a match must have before it."""
    from ..functions.kana import is_single_kanji

    own = rows.where(is_single_kanji(F.col("base")) & (F.col("prefix") != ""))
    totals = own.groupBy("base").agg(F.count(F.lit(1)).alias("total"))
    kept = top_contexts(own, "prefix", TOP_PREFIXES).join(totals, "base").where(F.col("n") / F.col("total") >= RULE_SHARE)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda x: x["value"])
    return kept.groupBy("base").agg(listed.alias("prefixes"), F.max(F.char_length("value")).cast("long").alias("longest"))


def rule_allows(before, prefixes, most: int = 4):
    """Whether the number at the end of the text before a match is among a rule's prefixes; both after NFKC."""
    from ..functions.kana import numeric_prefix

    return F.coalesce(F.array_contains(prefixes, F.nullif(numeric_prefix(before, most), F.lit(""))), F.lit(False))


def compound_prefixes(bases: DataFrame) -> DataFrame:
    """base -> what longer bases with ideographs may begin with, each once."""
    from ..functions.kana import is_cjk_narrow

    longer = bases.where((F.char_length("base") > 1) & is_cjk_narrow(F.col("base")))
    return longer.select(F.explode(F.transform(F.sequence(F.lit(1), F.char_length("base") - 1), lambda n: F.substring(F.col("base"), F.lit(1), n))).alias("prefix")).distinct()


def touching(spans: DataFrame, *keys: str) -> DataFrame:
    """Runs of two or more one-character spans (keys..., start, end, base, reading) with nothing between them: start, n, base, reading."""
    place = Window.partitionBy(*keys).orderBy("start")
    begins = F.coalesce((F.lag("end").over(place) != F.col("start")) | (F.char_length(F.lag("base").over(place)) != 1), F.lit(True)) | (F.char_length("base") != 1)
    rows = spans.withColumn("run", F.sum(begins.cast("int")).over(place)).where(F.char_length("base") == 1)
    rows = rows.groupBy(*keys, "run").agg(F.min("start").alias("start"), F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("start", "base", "reading"))).alias("parts")).where("n > 1")
    join = lambda name: F.array_join(F.transform("parts", lambda p: p[name]), "")
    return rows.select(*keys, "start", "n", join("base").alias("base"), join("reading").alias("reading"))


def histogram(rows: DataFrame, key: list[str], place: list[str], most: int = 3) -> DataFrame:
    """key..., n, first_doc, samples: how often a key stands, and its first places, limited by rank before they are collected."""
    counts = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min(place[0]).alias("first_doc"))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*place))
    some = rows.withColumn("rank", rank).where(F.col("rank") <= most)
    text = F.concat_ws(":", *[F.col(c).cast("string") for c in place])
    some = some.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", text.alias("at")))), lambda x: x["at"]), ",").alias("samples"))
    return counts.join(some, key)
