"""Paged search as a Python data source: a reader pages backwards by a time key until a page is empty."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class SearchSource(DataSource):
    """options: ``pages`` (folder of one JSON array per file, each a list of posts, standing for the service), ``size``, ``before``, ``after``. One partition per term of ``terms``."""

    @classmethod
    def name(cls) -> str:
        return "paged_search"

    def schema(self) -> str:
        return "term string, id string, title string, body string, created_utc long, score int"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Term(InputPartition):
    def __init__(self, term: str):
        self.term = term


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)

    def partitions(self) -> list[InputPartition]:
        return [_Term(t.strip()) for t in self.options.get("terms", "").split(",") if t.strip()]

    def fetch(self, term: str, before: int, size: int) -> list[dict]:
        """Newest first, strictly before the key."""
        found = [p for f in sorted(Path(self.options["pages"]).glob("*.json")) for p in json.loads(f.read_text()) if term.lower() in f"{p.get('title', '')} {p.get('body', '')}".lower() and p["created_utc"] < before]
        return sorted(found, key=lambda p: (-p["created_utc"], p["id"]))[:size]

    def read(self, partition: _Term) -> Iterator[tuple]:
        before, size = int(self.options.get("before", 1 << 62)), int(self.options.get("size", 100))
        after = int(self.options.get("after", 0))
        while page := [p for p in self.fetch(partition.term, before, size) if p["created_utc"] >= after]:
            for p in page:
                yield partition.term, p["id"], p.get("title"), p.get("body"), p["created_utc"], p.get("score")
            before = min(p["created_utc"] for p in page)
