"""A paged source for Spark's Python data sources: pages are fetched in tasks, tried again, and kept once fetched.

Register it with ``spark.dataSource.register(PagedSource)``, then
``spark.read.format("paged").schema(...).options(folder=..., kept=...).load()``.
"""

from __future__ import annotations

import json
import posixpath
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Tries of a page, the first pause in seconds, which doubles, and the longest.
TRIES, PAUSE, LONGEST = 5, 0.35, 60.0


class PageError(Exception):
    """A page that can't be fetched just now."""


def _at(url: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(url if "://" in url else "file://" + url if not url.startswith("file:") else "file://" + url.removeprefix("file:"))


def saved_page(folder: str, name: str) -> bytes:
    """A page saved as a file."""
    fs, path = _at(folder)
    try:
        with fs.open_input_stream(posixpath.join(path, name)) as f:
            return f.read()
    except OSError as e:
        raise PageError(str(e)) from e


def fetched(fetch: Callable[[str, str], bytes], folder: str, name: str, kept: str | None, tries: int = TRIES, pause: float = PAUSE) -> bytes:
    """The page, from the kept ones where it is there; else fetched, kept, and only then given.

    A failed fetch is tried again after a pause that doubles. A kept page is
    written under another name first, so that no reader ever sees half of one."""
    if kept is not None:
        fs, path = _at(kept)
        place = posixpath.join(path, name)
        if fs.get_file_info(place).type == pafs.FileType.File:
            with fs.open_input_stream(place) as f:
                return f.read()
    for attempt in range(tries):
        try:
            body = fetch(folder, name)
            break
        except PageError:
            if attempt + 1 == tries:
                raise
            time.sleep(min(LONGEST, pause * 2**attempt))
    if kept is not None:
        fs.create_dir(path, recursive=True)
        part = f"{place}.{time.time_ns()}.part"
        with fs.open_output_stream(part) as f:
            f.write(body)
        fs.move(part, place)
    return body


class Pages(InputPartition):
    def __init__(self, names: list[str]):
        super().__init__(0)
        self.names = names


class PagedReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str], fetch: Callable[[str, str], bytes]):
        self.schema, self.fetch = schema, fetch
        self.folder, self.kept = options["folder"], options.get("kept")
        self.each, self.tries, self.pause = int(options.get("pagesPerTask", 16)), int(options.get("tries", TRIES)), float(options.get("pause", PAUSE))

    def partitions(self) -> list[InputPartition]:
        """The names of the pages, so many a task."""
        fs, path = _at(self.folder)
        names = sorted(f.base_name for f in fs.get_file_info(pafs.FileSelector(path)) if f.type == pafs.FileType.File and not f.base_name.startswith(("_", ".")))
        return [Pages(names[i : i + self.each]) for i in range(0, len(names), self.each)] or [Pages([])]

    def read(self, partition: Pages) -> Iterator[pa.RecordBatch]:
        """A page's rows, one JSON object a line, as one batch; fields that a line lacks are null."""
        kinds = to_arrow_schema(self.schema)
        for name in partition.names:
            body = fetched(self.fetch, self.folder, name, self.kept, self.tries, self.pause)
            rows = [json.loads(line) for line in body.decode().splitlines() if line.strip()]
            yield pa.RecordBatch.from_pylist([{f.name: r.get(f.name) for f in kinds} for r in rows], schema=kinds)


class PagedSource(DataSource):
    """Pages of JSON lines in a folder. Options: folder; kept, where fetched pages stay for the next run; pagesPerTask; tries; pause."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def reader(self, schema: StructType) -> DataSourceReader:
        return PagedReader(schema, self.options, saved_page)
