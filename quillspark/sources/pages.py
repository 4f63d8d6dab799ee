"""Paged answers of services as a data source, read from recordings: batches and streams, with a status for every page.

A recording is a folder of JSON lines (key, offset, attempt, status, body), sorted within a file: what a service
answered when a page was asked for. Each file is a range of pages and a partition of its own; a stream's offset is the
number of files that it has read, in the order of their names. Pages are asked for by the retry policy of providers.fetching(): a
page that comes in the end has a body, one that doesn't has a reason, and neither holds up the others.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..providers import DeterministicFailure, Passing, fetching

NAME, SCHEMA = "recorded_pages", "key string, offset bigint, status int, attempts int, page string, reason string"
#: Attempts at a page, if not said otherwise.
TRIES = 3


def record(pages: DataFrame, path: str, files: int | None = None) -> None:
    """Writes pages (key, offset, attempt, status, body) as a recording: ranges of pages in files of their own."""
    rows = pages.select(F.col("key").cast("string").alias("key"), F.col("offset").cast("long").alias("offset"), F.col("attempt").cast("int").alias("attempt"), F.col("status").cast("int").alias("status"), "body")
    rows = rows.repartitionByRange(*([files] if files else []), "key", "offset").sortWithinPartitions("key", "offset", "attempt")
    rows.select(F.to_json(F.struct("*")).alias("value")).write.text(path)


def replayed(attempts: list[tuple[int, str]]) -> Callable[[str, dict], tuple[int, str]]:
    """A transport that gives recorded answers one after the other, the last one again and again."""
    left = iter(attempts[:-1])
    return lambda url, params: next(left, attempts[-1])


def fetched(key: str, offset: int, attempts: list[tuple[int, str]], tries: int) -> tuple:
    """The row of a page: asked for until it comes, fails for good, or has been asked for `tries` times."""
    asked, get = [], replayed(attempts)

    def transport(url: str, params: dict) -> tuple[int, str]:
        asked.append(get(url, params))
        return asked[-1]

    try:
        body = fetching(transport, tries, wait=0, between=0, sleep=lambda s: None)(key, {"offset": offset})
        return key, offset, asked[-1][0], len(asked), body, None
    except DeterministicFailure as e:
        return key, offset, asked[-1][0], len(asked), None, e.reason
    except Passing:
        return key, offset, asked[-1][0], len(asked), None, f"no answer after {len(asked)} attempts"


class Range(InputPartition):
    """A file of a recording."""

    def __init__(self, path: str):
        self.path = path


def _opened(path: str):
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


class PageReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.tries = options["path"], int(options.get("tries", TRIES))

    def files(self) -> list[str]:
        fs, at = _opened(self.path)
        found = sorted(f.path for f in fs.get_file_info(pafs.FileSelector(at)) if f.base_name.startswith("part-"))
        return [f"{self.path.rstrip('/')}/{f.rsplit('/', 1)[1]}" for f in found]

    def partitions(self) -> list[Range]:
        return [Range(f) for f in self.files()]

    def read(self, partition: Range) -> Iterator[tuple]:
        """A file is read line by line, and the attempts of one page are held at a time."""
        fs, at = _opened(partition.path)
        with fs.open_input_stream(at) as f:
            rows = map(json.loads, lines(f))
            for (key, offset), tried in groupby(rows, lambda r: (r["key"], r["offset"])):
                yield fetched(key, offset, [(r["status"], r.get("body", "")) for r in tried], self.tries)


def lines(stream, size: int = 1 << 20) -> Iterator[bytes]:
    rest = b""
    while chunk := stream.read(size):
        *whole, rest = (rest + chunk).split(b"\n")
        yield from whole
    if rest:
        yield rest


class PageStream(PageReader, DataSourceStreamReader):
    """Files that have come since: the offset says how many are read. A file's name comes after those that are there."""

    def initialOffset(self) -> dict:
        return {"files": 0}

    def latestOffset(self) -> dict:
        return {"files": len(self.files())}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return [Range(f) for f in self.files()[start["files"] : end["files"]]]

    def commit(self, end: dict) -> None:
        pass


class RecordedPages(DataSource):
    """spark.read.format("recorded_pages") and spark.readStream.format("recorded_pages"); option tries."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PageReader:
        return PageReader(self.options)

    def streamReader(self, schema) -> PageStream:
        return PageStream(self.options)


def read_pages(spark: SparkSession, path: str, tries: int = TRIES) -> DataFrame:
    """(key, offset, status, attempts, page, reason) of each page of a recording."""
    spark.dataSource.register(RecordedPages)
    return spark.read.format(NAME).option("tries", tries).load(path)


def stream_pages(spark: SparkSession, path: str, tries: int = TRIES) -> DataFrame:
    """read_pages() as a stream of the files that a recording has and gets; a batch has all that have come since the one before."""
    spark.dataSource.register(RecordedPages)
    return spark.readStream.format(NAME).option("tries", tries).load(path)
