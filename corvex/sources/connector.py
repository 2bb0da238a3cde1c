"""A connector of document changes as a Python data source: batches between checkpoints, replayable by offset."""

from __future__ import annotations

import json

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader


class ChangeLog(DataSource):
    """Option path: a JSON-lines file of changes (source_id, kind, payload), ordered; a change's offset is its line number.

    Batch reads give all changes; streams start at the checkpoint and acknowledge by Spark's own offset log.
    """

    @classmethod
    def name(cls) -> str:
        return "corvex_changes"

    def schema(self) -> str:
        return "offset long, source_id string, kind string, payload string"

    def reader(self, schema):
        return _Batch(self.options)

    def simpleStreamReader(self, schema):
        return _Stream(self.options)


def _changes(path: str, start: int, end: int | None = None):
    with open(path, encoding="utf-8") as lines:
        for offset, line in enumerate(lines):
            if offset >= start and (end is None or offset < end):
                r = json.loads(line)
                yield offset, r.get("source_id"), r.get("kind"), json.dumps(r.get("payload"))


class _Batch(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]

    def partitions(self):
        return [InputPartition(0)]

    def read(self, partition):
        yield from _changes(self.path, 0)


class _Stream(SimpleDataSourceStreamReader):
    def __init__(self, options):
        self.path = options["path"]

    def initialOffset(self):
        return {"offset": 0}

    def read(self, start):
        rows = list(_changes(self.path, start["offset"]))
        return iter(rows), {"offset": start["offset"] + len(rows)}

    def readBetweenOffsets(self, start, end):
        return _changes(self.path, start["offset"], end["offset"])
