"""The data source of containers: partitions, names, listing without payloads, streams."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from yomibon.sources import epub, epub_source
from yomibon.streaming import progress


def container(names):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for k, name in enumerate(names):
            z.writestr(name, f"{name}|" * (50 * k + 1))
    return raw.getvalue()


@pytest.fixture
def shelf(tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.epub").write_bytes(container([f"OPS/{k}.xhtml" for k in range(40)] + ["OPS/pic.png"]))
    (tmp_path / "deep" / "b.EPUB").write_bytes(container(["x.opf", "y.html"]))
    (tmp_path / "c.txt").write_bytes(b"no container")
    return tmp_path


@pytest.mark.parametrize("split", [1, 1000, 4000, 1 << 30])
def test_every_entry_is_read_once(spark, shelf, split):
    rows = epub_source.entries(spark, str(shelf), split=max(split, 200)).collect()
    assert len(rows) == 43 and len({(r.book, r.entry) for r in rows}) == 43
    for r in rows:
        assert bytes(r.bytes).startswith(f"{r.entry}|".encode()) and len(r.bytes) == r.size and r.book.startswith("file:/")
    twin = epub.entries(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(shelf)).where("lower(path) like '%.epub'").select("path", "content"))
    assert {(r.book, r.entry, r.entry_order, bytes(r.bytes)) for r in rows} == {(r.book, r.entry, r.entry_order, bytes(r.bytes)) for r in twin.collect()}


def test_a_large_container_has_many_partitions(spark, shelf):
    df = epub_source.entries(spark, str(shelf / "a.epub"), split=2000)
    parts = df.select(F.spark_partition_id().alias("p"), "entry").groupBy("p").count().collect()
    assert len(parts) > 5 and sum(r["count"] for r in parts) == 41


def test_names_leave_payloads_unread(spark, shelf):
    data = bytearray((shelf / "a.epub").read_bytes())
    at = data.find(b"OPS/pic.png|")
    data[at : at + 3] = b"???"  # its check sum is wrong now
    (shelf / "a.epub").write_bytes(bytes(data))
    with pytest.raises(Exception, match="CRC"):
        epub_source.entries(spark, str(shelf)).collect()
    named = lambda names: epub_source.entries(spark, str(shelf), names)
    assert named(r"\.xhtml$").count() == 40 and named(r"^(OPS/3\.xhtml|x\.opf)$").count() == 2 and named("none").count() == 0
    pages = named(r"html$")
    assert pages.where("entry = 'y.html'").union(pages.where("entry like 'OPS/1%'")).count() == 12  # one relation, two filters
    listed = epub_source.entries(spark, str(shelf), payload=False)
    assert listed.count() == 43 and listed.where("bytes is not null").count() == 0


def test_no_containers(spark, tmp_path):
    assert epub_source.entries(spark, str(tmp_path)).count() == 0


def test_new_containers_come_as_a_stream(spark, shelf):
    folder = f"{shelf}/stream"
    rows = spark.createDataFrame([("1.epub", container(["a", "b"])), ("2.epub", container(["c"]))], "name string, content binary")
    epub_source.save(rows, folder)
    got = progress.run_to_end(epub_source.arriving(spark, folder), "containers", "append").collect()
    assert sorted((r.book.rpartition("/")[2], r.entry) for r in got) == [("1.epub", "a"), ("1.epub", "b"), ("2.epub", "c")]
