"""A paged source that replays a JSON-lines file, in batch or as a stream.

It stands where a REST or websocket feed stands in production: pages are bounded, offsets
survive restarts, and a page can be read again.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

SCHEMA = "line bigint, value string"


def _page(path: str, start: int, size: int) -> list[tuple[int, str]]:
    rows = []
    with open(path, encoding="utf-8") as f:
        for k, text in enumerate(f):
            if k >= start + size:
                break
            if k >= start:
                rows.append((k + 1, text.rstrip("\r\n")))
    return rows


class _Pages(DataSourceReader):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def partitions(self) -> list[InputPartition]:
        with open(self.path, encoding="utf-8") as f:
            n = sum(1 for _ in f)
        return [InputPartition(k) for k in range(0, max(n, 1), self.size)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from _page(self.path, partition.value, self.size)


class _Stream(SimpleDataSourceStreamReader):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def initialOffset(self) -> dict:
        return {"line": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows = _page(self.path, start["line"], self.size)
        return iter(rows), {"line": start["line"] + len(rows)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(_page(self.path, start["line"], end["line"] - start["line"]))


class ReplaySource(DataSource):
    """format("jsonl_replay").option("path", ...).option("page", rows a page)."""

    @classmethod
    def name(cls) -> str:
        return "jsonl_replay"

    def schema(self) -> str:
        return SCHEMA

    def _options(self) -> tuple[str, int]:
        return self.options["path"], int(self.options.get("page", "1000"))

    def reader(self, schema) -> DataSourceReader:
        return _Pages(*self._options())

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Stream(*self._options())
