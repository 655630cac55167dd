"""Evidence, mirrors and work that are kept up to date: equal to recounts from scratch, whatever the order and the repeats."""

import random

from pyspark.sql import functions as F

from yomibon.operators import increments, work
from yomibon.plans import upkeep_queries
from yomibon.streaming import mirror

SIGHTING = "book long, base string, reading string, prefix string, suffix string"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def some_sightings(rng, books):
    letter = lambda: rng.choice(["山", "川", "山川", None, "", "x"])
    return [(b, rng.choice(["山", "川", "海", None]), rng.choice(["ヤマ", "ヤマ", "サン", None]), letter(), letter()) for b in books for _ in range(rng.randrange(1, 12))]


def test_replaced_books_equal_a_recount(spark):
    rng = random.Random(7)
    old = spark.createDataFrame(some_sightings(rng, range(12)), SIGHTING)
    new_rows = some_sightings(rng, [1, 2, 3, 20])  # 20 is new, 4 goes, 99 was never there
    new = spark.createDataFrame(new_rows, SIGHTING)
    books = spark.createDataFrame([(1,), (2,), (3,), (4,), (20,), (99,), (1,), (None,)], "book long")
    after, change = increments.replaced(increments.counted(old, "book"), new, books, "book")
    whole = old.where("book not in (1, 2, 3, 4)").unionByName(new)
    assert rows_of(after.select("book", *increments.COUNTED, "n")) == rows_of(increments.counted(whole, "book"))
    totals = increments.summed(increments.counted(old), change)
    assert rows_of(totals) == rows_of(increments.counted(whole))
    parts = change.where("n > 0"), change.where("n < 0")
    assert rows_of(increments.summed(parts[1], increments.counted(old), parts[0])) == rows_of(totals)  # in any order and grouping
    for made in (increments.corpus, lambda t: increments.contexts(t, "suffix", 2)):
        before = made(increments.counted(old))
        assert rows_of(increments.refreshed(before, totals, change, made)) == rows_of(made(totals).select(before.columns))
        loose = increments.together(increments.counted(old), change)  # not summed yet
        assert rows_of(increments.refreshed(before, loose, change, made)) == rows_of(made(totals).select(before.columns))


def test_change_undoes_itself(spark):
    rows = spark.createDataFrame(some_sightings(random.Random(3), range(5)), SIGHTING)
    none = rows.limit(0)
    assert increments.change(rows, rows).count() == 0
    assert rows_of(increments.change(none, rows)) == rows_of(increments.counted(rows))
    assert increments.summed(increments.change(rows, none), increments.counted(rows)).count() == 0
    assert increments.corpus(increments.counted(none)).count() == 0


def test_untouched_bases_are_not_made_again(spark):
    before = spark.createDataFrame([("山", "kept as it is", 1), ("川", "old", 1)], "base string, reading string, total long")
    totals = spark.createDataFrame([("山", "ヤマ", "", "", 5), ("川", "カワ", "", "", 5)], "base string, reading string, prefix string, suffix string, n long")
    changed = totals.where("base = '川'")
    assert rows_of(increments.refreshed(before, totals, changed, increments.corpus)) == [("山", "kept as it is", 1), ("川", "カワ", 5)]


EVENT = "seq long, op string, path string, target string, folder boolean, length long"


def simulated(events):
    """The mirror by running events one after the other."""
    there = {}
    clean = lambda p: "/".join(x for x in p.split("/") if x)
    for seq, op, path, target, folder, length in sorted(events):
        path = clean(path)
        if op in ("delete", "move"):
            there = {p: v for p, v in there.items() if p != path and not p.startswith(path + "/")}
        at = clean(target) if op == "move" else path
        if op != "delete" and not folder and at.lower().endswith(".mp3"):
            there[at] = (seq, length)
    return sorted((p, *v) for p, v in there.items())


def some_events(rng, n):
    name = lambda: "/".join([rng.choice("ab"), rng.choice("xy"), rng.choice(["1.mp3", "2.MP3", "3.txt"])])
    found = []
    for seq in range(n):
        op = rng.choice(["create", "change", "change", "delete", "move", "delete folder", "move folder"])
        path = name() if "folder" not in op else rng.choice(["a", "b", "a/x", "b//y/", "c.mp3"])
        found.append((seq, op.split()[0], path, name() if op.startswith("move") else None, "folder" in op, rng.randrange(100)))
    return found


def test_mirror_equals_running_events(spark):
    for seed in range(6):
        rng = random.Random(seed)
        events = some_events(rng, 60)
        odd = [(None, "create", "a/x/1.mp3", None, False, 1), (5, "create", None, None, False, 1)]
        rows = spark.createDataFrame(events + odd, EVENT)
        assert rows_of(mirror.view(mirror.ledger(rows))) == simulated(events)
        # Batches that come twice, late and in any order give the same view.
        cut = rng.randrange(60)
        parts = [mirror.ledger(rows.where(f"seq >= {cut}")), mirror.ledger(rows.where(f"seq < {cut}")), mirror.ledger(rows.where(f"seq >= {cut // 2}"))]
        assert rows_of(mirror.view(mirror.merged(parts[0].unionByName(parts[1]).unionByName(parts[2])))) == simulated(events)


def test_mirror_follows_a_stream_and_replays(spark, tmp_path):
    events = some_events(random.Random(11), 40)
    for k in range(4):
        spark.createDataFrame(events[k * 10 : k * 10 + 10], EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    mirror.follow(stream(), str(tmp_path / "out"))
    assert rows_of(mirror.followed(spark, str(tmp_path / "out"))) == simulated(events)
    (tmp_path / "out" / "checkpoint").rename(tmp_path / "lost")  # without its checkpoint all batches run again
    mirror.follow(stream(), str(tmp_path / "out"))
    assert len(list((tmp_path / "out" / "ledger").glob("batch=*"))) == 4
    assert rows_of(mirror.followed(spark, str(tmp_path / "out"))) == simulated(events)


LISTING = "path string, digest string, length long"


def test_listings_differ_by_creates_changes_deletes_and_moves(spark):
    before = [("a", "1", 1), ("b", "2", 2), ("c", "3", 3), ("d", "4", 4), ("e", "5", 5), ("f", "5", 5), (None, "9", 9), ("n", None, 1), ("d", "4", 4)]
    after = [("a", "1", 1), ("b", "x", 2), ("cc", "3", 3), ("g", "5", 5), ("h", "7", 7), ("m", None, 1)]
    listing = lambda rows: spark.createDataFrame(rows, LISTING)
    found = rows_of(mirror.differences(listing(before), listing(after)))
    assert found == sorted([("b", "change", None), ("cc", "move", "c"), ("d", "delete", None), ("g", "move", "e"), ("f", "delete", None), ("h", "create", None), ("n", "delete", None), ("m", "create", None)], key=repr)
    assert mirror.differences(listing(before), listing(before)).count() == 0
    assert mirror.differences(listing([]), listing([])).count() == 0
    # Applied to the first listing as events, they give the second.
    first = [(0, "create", f"{p}.mp3", None, False, n) for p, _, n in before if p]
    steps = [(1, op, f"{origin or p}.mp3", f"{p}.mp3" if op == "move" else None, False, 0) for p, op, origin in found]
    assert [p for p, _, _ in simulated(first + steps)] == sorted(f"{p}.mp3" for p, _, _ in after)


def test_work_goes_on_where_a_run_was_cut_short(spark):
    chunks = spark.createDataFrame([(t, f"{t}-{k}") for t in "abcd" for k in range(3)] + [("d", "d-0")], "target string, key string")
    cache = spark.createDataFrame([("a", "a-0"), ("a", "a-0"), ("a", "old"), ("b", "b-0"), ("b", "b-1"), ("b", "b-2"), ("c", "a-1")], "target string, key string")
    named = lambda text: spark.createDataFrame([(t,) for t in text], "target string")
    planned = lambda kept, outputs="abd", markers="b", **more: work.plan(named("abcde"), work.marked(chunks, kept), kept, named(outputs), named(markers), **more)
    first = {r.target: (r.n_chunks, r.n_cached, r.action, r.stale) for r in planned(cache).collect()}
    assert first == {"a": (3, 1, "resume", True), "b": (3, 3, "exists", False), "c": (3, 0, "build", False), "d": (4, 0, "exists", False), "e": (0, 0, "no_chunks", False)}
    todo = work.left(work.marked(chunks, cache), planned(cache))
    assert rows_of(todo) == [("a", "a-1"), ("a", "a-2"), ("c", "c-0"), ("c", "c-1"), ("c", "c-2")]
    # Half of it is made; the plan is that of a fresh look, and in the end nothing is left.
    half = cache.unionByName(todo.where("key <= 'c-0'"))
    assert rows_of(work.left(work.marked(chunks, half), planned(half))) == [("c", "c-1"), ("c", "c-2")]
    assert rows_of(work.completed(work.marked(chunks, half))) == [("a", 3), ("b", 3)]
    whole = cache.unionByName(todo)
    assert rows_of(work.completed(work.marked(chunks, whole))) == [("a", 3), ("b", 3), ("c", 3)]
    assert work.left(work.marked(chunks, whole), planned(whole, "abcd", "abc")).count() == 0
    assert {r.target: r.action for r in planned(cache, overwrite=True).collect()} == {"a": "resume", "b": "resume", "c": "build", "d": "build", "e": "no_chunks"}


def test_pending_books(spark):
    files = spark.createDataFrame([("a/x.epub",), ("./a//y.EPUB",), ("z.txt",), (".epub",), ("a/x.epub",), ("w.epub",), (None,)], "path string")
    folders = spark.createDataFrame([("a/y", True), ("a/x", False), ("q", True)], "path string, is_book boolean")
    assert rows_of(work.pending_books(files, folders)) == [("a/x.epub", "a/x"), ("w.epub", "w")]


def test_sightings_have_neighbours(spark):
    docs = spark.createDataFrame([(1, "Aa, bb … Cc"), (2, None), (3, " ")], "doc_id long, text string")
    assert rows_of(upkeep_queries.sightings(docs).select("base", "reading", F.col("prefix"), "suffix")) == [("aa", "Aa", None, "bb"), ("bb", "bb", "aa", ""), ("cc", "Cc", "", None)]


def replaced_books(folder, spark, n=40):
    """Tables of n documents with the same words; the second is changed, the third is gone."""
    spark.createDataFrame([(i, "Ene ene - mene, Mu ") for i in range(n)], "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 0), (1, 1), (2, 0), (3, 2)], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_evidence_is_not_kept_by_book(spark, tmp_path, monkeypatch):
    kept = []
    monkeypatch.setattr(upkeep_queries, "written", lambda df, name: kept.append(df) or df)
    found = upkeep_queries.evidence_after_replacement(spark, replaced_books(tmp_path, spark))
    assert rows_of(found) == [("mene", "mene", 39), ("mu", "Mu", 39)]
    assert sum(x.count() for x in kept) == 11  # four words and readings of books that stay and of old versions, three of new ones


def test_contexts_are_counted_once(spark, tmp_path):
    found = upkeep_queries.contexts_after_replacement(spark, replaced_books(tmp_path, spark))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate inline") == 2  # books that stay and new versions
    assert rows_of(found) == [("ene", "ene", 39, 1), ("mene", "mu", 39, 1)]


def test_sightings_of_words_of_marks(spark):
    docs = spark.createDataFrame([(1, "\n Aa\u3000b -- \tÉ’x\x0b"), (2, None), (3, " ")], "doc_id long, text string")
    assert rows_of(upkeep_queries.sightings(docs, "base", "reading", "suffix")) == [("aab", "Aab", ""), ("éx", "Éx", None)]
