"""Paged lists and recorded searches as Spark data sources.

``spark.dataSource.register(PagedList)``; ``spark.read.format("paged_list")
.option("path", folder).load()`` follows ``nextPageToken`` from the page ``first`` to the last
one. ``recorded_search`` reads recorded result lists; a partition is one file.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class PagedList(DataSource):
    """Rows ``key, item`` of JSON pages ``{"items": [{"key": ...}], "nextPageToken": ...}``."""

    @classmethod
    def name(cls) -> str:
        return "paged_list"

    def schema(self) -> str:
        return "key string, item string"

    def reader(self, schema) -> DataSourceReader:
        return _Pages(self.options["path"])


class _Pages(DataSourceReader):
    """Pages depend on each other by their tokens, so one task follows them."""

    def __init__(self, folder: str) -> None:
        self.folder = folder

    def read(self, partition) -> Iterator[tuple]:
        token, seen = "first", set()
        while token and token not in seen:
            seen.add(token)
            page = json.loads(Path(self.folder, f"{token}.json").read_text())
            for item in page.get("items", []):
                yield item.get("key"), json.dumps(item)
            token = page.get("nextPageToken")


class RecordedSearch(DataSource):
    """Rows ``formulation_id, query, rank, url, title, snippet`` of files ``{"formulation_id", "query", "results": [...]}``; option ``k``."""

    @classmethod
    def name(cls) -> str:
        return "recorded_search"

    def schema(self) -> str:
        return "formulation_id string, query string, rank int, url string, title string, snippet string"

    def reader(self, schema) -> DataSourceReader:
        return _Results(self.options["path"], int(self.options.get("k", 10)))


class _Results(DataSourceReader):
    def __init__(self, folder: str, k: int) -> None:
        self.folder, self.k = folder, k

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(str(p)) for p in sorted(Path(self.folder).glob("*.json"))]

    def read(self, partition) -> Iterator[tuple]:
        r = json.loads(Path(partition.value).read_text())
        for rank, hit in enumerate(r["results"][: self.k], 1):
            yield r["formulation_id"], r["query"], rank, hit.get("link"), hit.get("title") or "", hit.get("snippet") or ""
