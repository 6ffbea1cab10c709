"""A Spark data source over stored feeds: one folder for each source, one file for each fetched feed.

``spark.dataSource.register(StoredFeeds)``, then ``spark.read.format("stored_feeds").load(folder)`` or ``spark.readStream``. Every source is a
partition of its own, read by one task file by file. As a stream, the offset is the last file name of each source, so names must
ascend with time (fetch time first), and a restart reads no file twice. The folder must be one that the driver and all executors see.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from newsloom.sources.feeds import FIELDS, parse_feed

SCHEMA = "source_key string, file string, " + ", ".join(f"{f} string" for f in FIELDS)


class Source(InputPartition):
    def __init__(self, key: str, files: tuple[str, ...]):
        self.key, self.files = key, files


def _files(folder: str, key: str) -> list[str]:
    return sorted(f for f in os.listdir(f"{folder}/{key}") if not f.startswith((".", "_")))


def _keys(folder: str) -> list[str]:
    return sorted(d for d in os.listdir(folder) if os.path.isdir(f"{folder}/{d}"))


def _read(folder: str, part: Source) -> Iterator[tuple]:
    for name in part.files:
        with open(f"{folder}/{part.key}/{name}", "rb") as f:
            for entry in parse_feed(f.read()):
                yield (part.key, name, *entry)


class BatchReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[InputPartition]:
        return [Source(k, tuple(_files(self.folder, k))) for k in _keys(self.folder)] or [Source("", ())]

    def read(self, partition: Source) -> Iterator[tuple]:
        return _read(self.folder, partition)


class StreamReader(DataSourceStreamReader):
    def __init__(self, folder: str):
        self.folder = folder

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self, *_) -> dict:
        return {k: files[-1] for k in _keys(self.folder) if (files := _files(self.folder, k))}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        new = [Source(k, tuple(f for f in _files(self.folder, k) if start.get(k, "") < f <= last)) for k, last in sorted(end.items())]
        return [p for p in new if p.files] or [Source("", ())]

    def read(self, partition: Source) -> Iterator[tuple]:
        return _read(self.folder, partition)


class StoredFeeds(DataSource):
    @classmethod
    def name(cls) -> str:
        return "stored_feeds"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return BatchReader(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:
        return StreamReader(self.options["path"])
