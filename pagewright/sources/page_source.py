"""Pages of text files as a data source, batch and streaming.

``spark.dataSource.register(PageSource)``, then ``spark.read.format("text_pages")``
or ``spark.readStream.format("text_pages")`` with a ``path``.  Files are planned as
byte ranges of ``split_bytes``, so one file of very many pages is many tasks: a
range has the pages that *start* in it, and reads on to the end of its last
page.  A range is all a task needs, so a lost one rereads its range only.

Rows: path, split (number of the range in its file), place (0, 1, ... in the
range), start (byte of the page in the file), text.  :func:`numbered` turns split
and place into page numbers with one count per range.

The stream's offset is the newest (modification time, path) seen; a batch has the
files between two offsets.  A file that arrives with an older time than the
offset is not seen, as with other listing sources.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .. import constants as K

SPLIT_BYTES = 4 << 20
_READ = 1 << 20
_BREAK = K.PAGE_BREAK.encode()


@dataclass
class PageRange(InputPartition):
    path: str
    split: int
    first: int   # pages that start behind this byte (or at 0, for the first range)
    last: int    # and not behind this one

    def __init__(self, path: str, split: int, first: int, last: int):
        self.path, self.split, self.first, self.last = path, split, first, last


def _store(path: str):
    """(file system, path in it); any URI that pyarrow knows, or a local path."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path.replace("file:/", "file:///") if path.startswith("file:/") and not path.startswith("file://") else path)
    return fs.LocalFileSystem(), path


def _files(path: str, suffix: str) -> list[tuple[int, str, int]]:
    """(modification time, path, size) of the files under a folder, in this order."""
    from pyarrow import fs

    store, root = _store(path)
    info = store.get_file_info(root)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    return sorted((f.mtime_ns or 0, f.path, f.size) for f in found if f.type == fs.FileType.File and f.base_name.endswith(suffix) and not f.base_name.startswith(("_", ".")))


def _ranges(files: list[tuple[int, str, int]], size: int) -> list[PageRange]:
    return [PageRange(path, i, lo, min(lo + size, n)) for _, path, n in files for i, lo in enumerate(range(0, max(n, 1), size))]


def pages_in(base: str, part: PageRange) -> Iterator[tuple[str, int, int, int, str]]:
    """The pages that start in a range; reads from its first byte to the end of
    its last page."""
    store, _ = _store(base)
    with store.open_input_file(part.path) as f:
        f.seek(part.first)
        at, held, place = part.first, b"", 0          # ``held`` begins at byte ``at`` of the file
        start = 0 if part.first == 0 else None        # start of the page that is being read
        while True:
            cut = held.find(_BREAK)
            if cut < 0:
                more = f.read(_READ)
                if start is None:                     # bytes of a page that an earlier range has
                    at, held = at + len(held), b""
                held += more
                if more:
                    continue
                if start is not None:
                    yield part.path, part.split, place, start, held.decode("utf-8", "replace")
                return
            if start is not None:
                yield part.path, part.split, place, start, held[:cut].decode("utf-8", "replace")
                place += 1
            at, held = at + cut + len(_BREAK), held[cut + len(_BREAK):]
            start = at
            if start > part.last:
                return


class _Pages:
    def __init__(self, options: dict):
        self.path = options["path"]
        self.suffix = options.get("suffix", "")
        self.size = int(options.get("split_bytes", SPLIT_BYTES))

    def read(self, partition: PageRange) -> Iterator[tuple]:
        return pages_in(self.path, partition)


class PageReader(_Pages, DataSourceReader):
    def partitions(self) -> list[PageRange]:
        return _ranges(_files(self.path, self.suffix), self.size)


class PageStreamReader(_Pages, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        files = _files(self.path, self.suffix)
        return {"time": files[-1][0], "path": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[PageRange]:
        lo, hi = (start["time"], start["path"]), (end["time"], end["path"])
        return _ranges([f for f in _files(self.path, self.suffix) if lo < f[:2] <= hi], self.size)

    def commit(self, end: dict) -> None:
        pass


class PageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "text_pages"

    def schema(self) -> str:
        return "path string, split int, place int, start bigint, text string"

    def reader(self, schema) -> PageReader:
        return PageReader(self.options)

    def streamReader(self, schema) -> PageStreamReader:
        return PageStreamReader(self.options)


def numbered(pages: DataFrame) -> DataFrame:
    """(path, page_number, text): page numbers from 1 in each file.  One count
    per range and a running sum over a file's ranges; no text is sorted."""
    counts = pages.groupBy("path", "split").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1))
    first = counts.select("path", "split", F.coalesce(before, F.lit(0)).alias("_before"))
    return pages.join(first, ["path", "split"]).select("path", (F.col("_before") + F.col("place") + 1).cast("int").alias("page_number"), "text")
