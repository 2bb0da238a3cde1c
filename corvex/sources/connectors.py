"""Connectors to document stores as a streaming source: changes by partition and offset, documents, access lists, acknowledged checkpoints.

A connector is four calls over a store that every executor reaches. The source turns them into a stream: Spark keeps the
offsets, tasks read ranges of changes (and fetch what they name), and a batch's end is acknowledged once Spark has
committed the batch, so a store may forget what lies before.
"""

from __future__ import annotations

import json
import os
import tempfile
from abc import ABC, abstractmethod
from collections.abc import Iterator
from importlib import import_module
from typing import Any

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

RANGE = 1000  # changes that one task reads at most, unless option range says otherwise


class Connector(ABC):
    """Changes lie in named partitions, numbered from 0 in each; a checkpoint is how many of each partition are done."""

    @abstractmethod
    def latest(self) -> dict[str, int]:
        """How many changes each partition has."""

    @abstractmethod
    def list_changes(self, partition: str, start: int, end: int) -> Iterator[tuple[str, str, dict[str, Any]]]:
        """(source id, operation, metadata) of the changes from start up to end."""

    @abstractmethod
    def fetch_document(self, source_id: str) -> bytes | None: ...

    @abstractmethod
    def fetch_acl(self, source_id: str) -> dict[str, Any] | None: ...

    @abstractmethod
    def ack_checkpoint(self, checkpoint: dict[str, int]) -> None: ...


class FolderConnector(Connector):
    """A store in a folder: changes/<partition>.jsonl (source_id, operation, metadata), documents/<source id>, acl/<source id>.json, and the acknowledged checkpoint in ack.json."""

    def __init__(self, root: str):
        self.root = root

    def _path(self, *parts: str) -> str:
        path = os.path.normpath(os.path.join(self.root, *parts))
        if not path.startswith(os.path.normpath(self.root) + os.sep):
            raise ValueError(f"{parts[-1]!r} is not within the store")
        return path

    def _read(self, *parts: str) -> bytes | None:
        try:
            with open(self._path(*parts), "rb") as file:
                return file.read()
        except FileNotFoundError:
            return None

    def latest(self) -> dict[str, int]:
        out = {}
        for name in sorted(os.listdir(self._path("changes"))):
            if name.endswith(".jsonl"):
                with open(self._path("changes", name), "rb") as file:
                    out[name.removesuffix(".jsonl")] = sum(line.endswith(b"\n") for line in file)  # a line that is still being written does not count
        return out

    def list_changes(self, partition: str, start: int, end: int) -> Iterator[tuple[str, str, dict[str, Any]]]:
        with open(self._path("changes", f"{partition}.jsonl"), "rb") as file:
            for number, line in enumerate(file):
                if number >= end:
                    return
                if number >= start:
                    r = json.loads(line)
                    yield r["source_id"], r["operation"], r.get("metadata") or {}

    def fetch_document(self, source_id: str) -> bytes | None:
        return self._read("documents", source_id)

    def fetch_acl(self, source_id: str) -> dict[str, Any] | None:
        found = self._read("acl", f"{source_id}.json")
        return None if found is None else json.loads(found)

    def ack_checkpoint(self, checkpoint: dict[str, int]) -> None:
        handle, path = tempfile.mkstemp(dir=self.root)
        with os.fdopen(handle, "w") as file:
            json.dump(checkpoint, file)
        os.replace(path, self._path("ack.json"))

    def acknowledged(self) -> dict[str, int]:
        return json.loads(self._read("ack.json") or b"{}")


class Range(InputPartition):
    def __init__(self, partition: str, start: int, end: int):
        self.partition, self.start, self.end = partition, start, end


class ConnectorSource(DataSource):
    """Options: connector (`module:Class`, the folder connector without it), root (its argument), range, and fetch (true: also read documents and access lists).

    A deleted document, or one that the store no longer has, has null content; metadata and acl are JSON.
    """

    @classmethod
    def name(cls) -> str:
        return "corvex_connector"

    def schema(self) -> str:
        return "partition string, offset long, source_id string, operation string, metadata string, content binary, acl string"

    def streamReader(self, schema):
        return _Changes(dict(self.options))


class _Changes(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def _connector(self) -> Connector:
        module, _, name = self.options.get("connector", f"{__name__}:FolderConnector").partition(":")
        return getattr(import_module(module), name)(self.options["root"])

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return self._connector().latest()

    def partitions(self, start: dict, end: dict) -> list[Range]:
        size = int(self.options.get("range", RANGE))
        return [Range(p, n, min(n + size, last)) for p, last in sorted(end.items()) for n in range(start.get(p, 0), last, size)]

    def read(self, partition: Range):
        store, fetch = self._connector(), self.options.get("fetch", "false").lower() == "true"
        for n, (source, operation, metadata) in enumerate(store.list_changes(partition.partition, partition.start, partition.end), partition.start):
            here = fetch and operation != "deleted"
            acl = store.fetch_acl(source) if here else None
            yield partition.partition, n, source, operation, json.dumps(metadata, sort_keys=True), store.fetch_document(source) if here else None, None if acl is None else json.dumps(acl, sort_keys=True)

    def commit(self, end: dict) -> None:
        self._connector().ack_checkpoint(end)
