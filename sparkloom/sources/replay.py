"""A data source that replays saved pages of a cursor-paged interface: no network, the same walk.

Pages are JSON-lines files, each line an item with ``created_utc``. The walk goes from the newest item down, ``limit``
items a page, each page continuing below the oldest item of the one before, until a page is empty.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class PagedReplay(DataSource):
    """``spark.read.format("paged_replay").option("path", dir).option("after", s).option("before", s).load()``"""

    @classmethod
    def name(cls) -> str:
        return "paged_replay"

    def schema(self) -> str:
        return "id string, created_utc long, body string, page int, item string"

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(self.options)


class FilePartition(InputPartition):
    """One file of pages."""
    def __init__(self, path: str):
        self.path = path


class PagedReader(DataSourceReader):
    """Replays files of a local folder as the pages of an interface."""
    def __init__(self, options: dict):
        self.path = options["path"]
        self.limit = int(options.get("limit", 100))
        self.after, self.before = int(options.get("after", 0)), int(options.get("before", 1 << 62))

    def partitions(self) -> list[InputPartition]:
        return [FilePartition(str(p)) for p in sorted(Path(self.path).glob("*.jsonl"))]

    def read(self, partition: FilePartition) -> Iterator[tuple]:
        with open(partition.path, encoding="utf-8") as f:
            items = [json.loads(x) for x in f if x.strip()]
        items.sort(key=lambda x: (-int(x["created_utc"]), str(x["id"])))
        cursor, page = self.before, 0
        while got := [x for x in items if self.after <= int(x["created_utc"]) < cursor][: self.limit]:
            edge = int(got[-1]["created_utc"])
            got += [x for x in items if int(x["created_utc"]) == edge and x not in got]  # a second is never torn between pages
            for x in got:
                yield str(x["id"]), int(x["created_utc"]), x.get("body"), page, json.dumps(x, ensure_ascii=False)
            cursor, page = edge, page + 1


def register(spark) -> None:
    """Make the source known to a session."""
    spark.dataSource.register(PagedReplay)
