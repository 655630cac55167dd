import io
import json
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from yomibon.operators import library, refine
from yomibon.sources import books, epub

OPF = """<package xmlns="x"><metadata><dc:title xmlns:dc="d">本</dc:title><dc:creator xmlns:dc="d">Ann B</dc:creator><dc:creator xmlns:dc="d">Ann B</dc:creator><meta name="cover" content="c"/></metadata>
<manifest><item id="n" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="a" href="a.xhtml" media-type="application/xhtml+xml"/><item id="b" href="b%20x.xhtml" media-type="application/xhtml+xml"/><item id="c" href="c.png" media-type="image/png"/></manifest>
<spine><itemref idref="b"/><itemref idref="a"/></spine></package>"""
NAV = '<html><nav epub:type="toc"><ol><li><a href="a.xhtml#x%20y">One</a></li><li><a href="b%20x.xhtml">Two</a></li><li><a href="gone.xhtml">No</a></li></ol></nav><nav><a href="a.xhtml">other</a></nav></html>'


@pytest.fixture
def files(spark):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="OEBPS/content.opf"/></rootfiles></container>')
        z.writestr("OEBPS/content.opf", OPF)
        z.writestr("OEBPS/nav.xhtml", NAV)
        z.writestr("OEBPS/a.xhtml", "<p>a</p>")
        z.writestr("OEBPS/b x.xhtml", "<p>é</p>".encode("utf-16"))
        z.writestr("OEBPS/c.png", b"\x89PNG")
    return epub.entries(spark.createDataFrame([("book.epub", bytearray(raw.getvalue()))], "path string, content binary")).cache()


def test_epub(spark, files):
    packs = epub.packages(files)
    order = epub.spine(files, packs)
    assert [(r.spine_index, r.path) for r in order.orderBy("spine_index").collect()] == [(0, "OEBPS/b x.xhtml"), (1, "OEBPS/a.xhtml")]
    assert epub.authors(packs).select("title", "author").first() == ("本", "Ann B")
    assert epub.covers(files, packs).select("path").first() == ("OEBPS/c.png",)
    points = epub.contents(files, packs, order).orderBy("nav_order").collect()
    assert [(r.nav_order, r.spine_index, r.fragment, r.title, r.local_order) for r in points] == [(0, 1, "x y", "One", 0), (1, 0, None, "Two", 0)]
    assert files.where("entry = 'OEBPS/b x.xhtml'").select(epub.decode_text("bytes").alias("t")).first().t == "<p>é</p>"


def test_ncx_drops_points_without_target():
    page = '<ncx><navMap><navPoint><navLabel><text>A</text></navLabel><content src="a"/></navPoint><navPoint><navPoint><content src="b"/></navPoint></navPoint></navMap></ncx>'
    assert epub.ncx_points(page) == [("a", "A")]
    assert epub.ncx_points("<broken") == []


def test_token_json(spark):
    rows = [{"surface": "雨", "start": 0, "end": 1, "reading": "アメ", "accent": "1"}, {"surface": "x", "start": {"original": 2, "transformed": 5}, "end": {"original": 3, "transformed": 6}, "accent": [1]}, {"surface": "no offsets"}]
    files = spark.createDataFrame([("c1", json.dumps({"text_sha1": "s", "tokens": rows})), ("c2", "broken")], "chapter string, json string")
    found = books.tokens(files).orderBy("token_idx").collect()
    assert [(r.surface, r.start, r.end, r.accent, r.t_start) for r in found] == [("雨", 0, 1, 1, None), ("x", 2, 3, None, 5)]
    texts = spark.createDataFrame([("c1", " 雨 x ")], "chapter string, text string")
    written = books.token_json(books.tokens(files), texts)
    assert books.fresh(written, texts).count() == 1
    assert books.fresh(written, texts.withColumn("text", F.lit("other"))).count() == 0


def test_metadata_rules_bookmarks(spark):
    meta = {"title": "T", "chapters": [{"index": 1, "file": "a/b.txt", "title": ""}, {"index": "2", "file": "a/b.txt", "title": "Last"}, {"file": "c.txt"}]}
    rules = {"overrides": [{"pattern": ""}, {"pattern": "x", "regex": True, "accent": "3"}], "removals": [{"reading": "ヽ"}, {}]}
    marks = {"manual": [{"id": "1", "chapter": "c", "time": 2}, {"id": "1", "chapter": "d", "time": 3}, {"id": "", "chapter": "c", "time": 1}]}
    frame = lambda x: spark.createDataFrame([("b", json.dumps(x))], "book string, json string")
    assert sorted((r["file"], r["index"], r["chapter_title"]) for r in books.metadata(frame(meta)).collect()) == [("a/b.txt", 2, "Last"), ("c.txt", None, "c")]
    assert [(r.rule_idx, r.pattern, r.regex, r.accent) for r in books.rules(frame(rules)).collect()] == [(1, "x", True, 3)]
    assert [r.reading for r in books.removals(frame(rules)).collect()] == ["ヽ"]
    assert [(r.id, r.chapter) for r in books.bookmark_state(frame(marks)).collect()] == [("1", "c")]


def test_writers(spark, tmp_path):
    chapters = spark.createDataFrame([("b", 2, "f2", "Two"), ("b", 1, "f1", "One!"), ("b", None, "f0", "End"), ("b", 2, "f3", "Two")], "book string, index int, file string, title string")
    named = spark.createDataFrame([("b", "A", "B")], "book string, title string, author string")
    listed = json.loads(books.manifest(chapters, named).first().json)
    assert [t["file"] for t in listed["tracks"]] == ["f1", "f2", "f3", "f0"] and (listed["album"], listed["artist"]) == ("A", "B")
    sourced = chapters.where("index is not null").withColumn("source", F.concat(F.lit("x/"), "file", F.lit(".xhtml")))
    assert sorted(r.name for r in books.basenames(sourced).collect()) == ["001_One", "002", "002_Two"]
    books.write_package(chapters, str(tmp_path / "p"))
    books.write_package(chapters.where("book = 'none'").unionByName(chapters.limit(0)), str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 4


def test_shelf_and_text_files(spark, tmp_path):
    with pytest.raises(ValueError):
        epub.shelf(spark, str(tmp_path))
    for name in ("b.EPUB", "a.epub", "c.txt", "c.original.txt", "c.partial.txt"):
        (tmp_path / name).write_bytes("\n 題 \nx".encode() + b"\xff" + "\ufffd".encode())
    assert [r.path.rpartition("/")[2] for r in epub.shelf(spark, str(tmp_path)).collect()] == ["a.epub", "b.EPUB"]
    assert [(r.path.rpartition("/")[2], r.text) for r in books.text_files(spark, str(tmp_path)).collect()] == [("c.txt", "\n 題 \nx\ufffd")]
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(str(tmp_path)).select("path", books.utf8_text("content").alias("text"))
    none = books.metadata(spark.createDataFrame([], "book string, json string"))
    assert [(r.file, r.chapter_title) for r in books.listed(files, none).collect()] == [("c.txt", "題")]
    assert books.json_files(spark, str(tmp_path / "none.json")).count() == 0


def test_streams_of_files_and_timeouts(spark, tmp_path):
    import pandas as pd

    from yomibon.streaming import progress

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.mp3").write_bytes(b"123")
    (tmp_path / "in" / "b.txt").write_bytes(b"1")
    rows = progress.run_to_end(progress.mirrored(spark, str(tmp_path / "in")), "mirror", mode="append").collect()
    assert [(r.path.rpartition("/")[2], r.length) for r in rows] == [("a.mp3", 3)]

    class State:
        exists, hasTimedOut, get = False, False, None

        def update(self, value):
            self.exists, self.get = True, value

        def setTimeoutDuration(self, millis):
            self.millis = millis

    state = State()
    batch = lambda *kinds: iter([pd.DataFrame({"ts": range(len(kinds)), "event_id": range(len(kinds)), "event_type": kinds})])
    step = lambda *kinds: next(progress.job_step((7,), batch(*kinds), state))["status"].iloc[0]
    assert step("signup", "click") == "running" and state.millis == 600_000
    state.hasTimedOut = True
    assert step() == "timeout"
    state.hasTimedOut = False
    assert step("purchase") == "timeout" and state.get == ("timeout", 3)  # what timed out stays so
    other = State()
    state = other
    assert step("purchase") == "done"
    state.hasTimedOut = True
    assert step() == "done"


def test_upsert_and_bookmarks(spark):
    current = spark.createDataFrame([("speed", 1.0), ("pitch", 0.0)], "key string, value double")
    changes = spark.createDataFrame([("speed", None), ("volume", 2.0)], "key string, value double")
    assert sorted(map(tuple, library.upserted(current, changes, "key", "value").collect())) == [("pitch", 0.0), ("volume", 2.0)]


def test_merged_rules(spark):
    schema = "pos int, regex boolean, pattern string, match_surface string, surface string, source string, reading string"
    template = spark.createDataFrame([(0, False, "a", None, None, None, "old"), (1, False, "b", None, None, None, "b")], schema)
    book = spark.createDataFrame([(0, False, "c", None, None, None, "c"), (1, False, "a", None, None, None, "new")], schema)
    assert [(r.pattern, r.reading) for r in refine.merged_rules(book, template).orderBy("place").collect()] == [("a", "new"), ("b", "b"), ("c", "c")]


def test_job_states_stream(spark, sf_dir):
    from yomibon.plans.queries import checkpoint, event_stream
    from yomibon.streaming import progress

    # A processing-time timeout keeps the stream alive, so it is stopped once it has seen all events.
    stream = progress.jobs(event_stream(spark, sf_dir))
    run = stream.writeStream.format("memory").queryName("jobs_out").outputMode("update").option("checkpointLocation", checkpoint(spark)).start()
    total, seen, end = spark.read.parquet(f"{sf_dir}/events.parquet").count(), 0, time.time() + 60
    while (seen or 0) < total and time.time() < end:
        time.sleep(1)
        seen = spark.table("jobs_out").groupBy("user_id").agg(F.max("seen").alias("seen")).agg(F.sum("seen")).first()[0]
    run.stop()
    assert seen == total
