"""EPUB containers as a data source of Spark, `spark.read.format("epub")`: a row an entry.

Small containers share a partition of about `split` bytes; a larger one is cut, and each of its parts
takes the entries whose headers begin in its range of bytes. A task reads a container's directory, which is
short, and then only the entries whose names match the option `names`, a regular expression; with the option
`payload` false no entry is read at all. The driver lists names and sizes, nothing else. As a stream, the
containers that come into the folder are read in order of their times.

Names are an option, not a pushed-down filter, as Spark 4.1 keeps pushed filters with the relation: two uses
of one DataFrame with different filters would then read by the filters of one of them.

Files are opened by Arrow's file systems; what these can't open can be read by epub.shelf() and entries().
Damaged entries that are asked for are an error; those that `names` leaves out are never looked at.
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as S

SCHEMA = "book string, entry string, entry_order long, size long, bytes binary"
SPLIT_BYTES = 32 << 20


def opened(uri: str) -> tuple:
    """(file system, path in it, what to put before a path to make it a URI)."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        uri = f"file://{uri}"
    uri = uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri
    system, path = fs.FileSystem.from_uri(uri)
    return system, path, "file:" if uri.startswith("file:") else f"{uri.partition('://')[0]}://"


def listing(uri: str) -> list[tuple[int, str, int]]:
    """(time in nanoseconds, path, bytes) of the containers below a folder, or of one, by time and path."""
    from pyarrow import fs

    system, path, _ = opened(uri)
    info = system.get_file_info(path)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
    return sorted((f.mtime_ns or 0, f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.lower().endswith(".epub"))


class Share(S.InputPartition):
    """Parts of containers: (path, bytes, part, parts)."""

    def __init__(self, parts: list[tuple[str, int, int, int]]):
        super().__init__(None)
        self.parts = parts


def shared_out(files: list[tuple[int, str, int]], split: int) -> list[Share]:
    shares, small, room = [], [], split
    for _, path, size in files:
        n = -(-size // split)
        if n > 1:
            shares += [Share([(path, size, k, n)]) for k in range(n)]
            continue
        if size > room and small:
            shares.append(Share(small))
            small, room = [], split
        small.append((path, size, 0, 1))
        room -= size
    return [*shares, *([Share(small)] if small or not shares else [])]


def read_share(share: Share, uri: str, names: str, payload: bool) -> Iterator[tuple]:
    system, _, prefix = opened(uri)
    wanted = re.compile(names)
    for path, size, part, parts in share.parts:
        with system.open_input_file(path) as raw, zipfile.ZipFile(raw) as book:
            for k, x in enumerate(book.infolist()):
                mine = min(parts - 1, x.header_offset * parts // max(1, size)) == part
                if mine and not x.is_dir() and wanted.search(x.filename):
                    yield prefix + path, x.filename, k, x.file_size, book.read(x) if payload else None


class Reader(S.DataSourceReader):
    def __init__(self, uri: str, split: int, names: str, payload: bool):
        self.uri, self.split, self.names, self.payload = uri, split, names, payload

    def partitions(self) -> list[Share]:
        return shared_out(listing(self.uri), self.split)

    def read(self, partition: Share) -> Iterator[tuple]:
        return read_share(partition, self.uri, self.names, self.payload)


class StreamReader(S.DataSourceStreamReader):
    """Offsets are (time, path) of the last container that was taken."""

    def __init__(self, uri: str, split: int, names: str, payload: bool):
        self.uri, self.split, self.names, self.payload = uri, split, names, payload

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        files = listing(self.uri)
        return {"time": files[-1][0], "path": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Share]:
        first, last = ((o["time"], o["path"]) for o in (start, end))
        return shared_out([f for f in listing(self.uri) if first < f[:2] <= last], self.split)

    def read(self, partition: Share) -> Iterator[tuple]:
        return read_share(partition, self.uri, self.names, self.payload)


class EpubSource(S.DataSource):
    """Options: path, split (bytes of a partition), names (a regular expression of entry names), payload (whether `bytes` is read)."""

    @classmethod
    def name(cls) -> str:
        return "epub"

    def schema(self) -> str:
        return SCHEMA

    def _settings(self) -> tuple[str, int, str, bool]:
        o = self.options
        return o["path"], int(o.get("split", SPLIT_BYTES)), o.get("names", ""), str(o.get("payload", "true")).lower() != "false"

    def reader(self, schema) -> Reader:
        return Reader(*self._settings())

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(*self._settings())


def entries(spark: SparkSession, path: str, names: str = "", payload: bool = True, split: int = SPLIT_BYTES) -> DataFrame:
    """The entries of the containers below a folder: book (its path), entry, entry_order, size, bytes."""
    spark.dataSource.register(EpubSource)
    return spark.read.format("epub").option("split", str(split)).option("names", names).option("payload", str(payload).lower()).load(path)


def arriving(spark: SparkSession, path: str, names: str = "", split: int = SPLIT_BYTES) -> DataFrame:
    """The entries of the containers that come into a folder, as a stream."""
    spark.dataSource.register(EpubSource)
    return spark.readStream.format("epub").option("split", str(split)).option("names", names).load(path)


def save(books: DataFrame, folder: str) -> None:
    """books (name, content): one file each in a folder. A file that is written again replaces itself."""

    def put(batches):
        from pyarrow import RecordBatch, array

        system, base, _ = opened(folder)
        system.create_dir(base, recursive=True)
        n = 0
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                with system.open_output_stream(f"{base}/{name}") as out:
                    out.write(content.as_buffer())
                n += 1
        yield RecordBatch.from_arrays([array([n])], ["n"])

    books.select("name", "content").mapInArrow(put, "n long").write.format("noop").mode("overwrite").save()
