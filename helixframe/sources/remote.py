"""A data source for paged sequence services: one partition for each page, with retries."""

from __future__ import annotations

import time
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Page(InputPartition):
    def __init__(self, start: int) -> None:
        super().__init__(start)
        self.start = start


class SequenceService(DataSource):
    """Options: url, query, email (all required), db, rettype, retmax (records of a page), retry, wait (seconds)."""

    @classmethod
    def name(cls) -> str:
        return "sequence_service"

    def schema(self) -> str:
        return "page long, body string"

    def reader(self, schema) -> DataSourceReader:
        return Pages(self.options)


class Pages(DataSourceReader):
    def __init__(self, options) -> None:
        if missing := [n for n in ("url", "query", "email") if not options.get(n)]:
            raise ValueError(f"options are missing: {', '.join(missing)}")
        self.url, self.size = options["url"].rstrip("/"), int(options.get("retmax", 500))
        self.retry, self.wait = int(options.get("retry", 5)), float(options.get("wait", 1))
        self.fields = {"db": options.get("db", "protein"), "term": options["query"], "email": options["email"], "rettype": options.get("rettype", "fasta")}

    def get(self, what: str, **fields) -> str:
        for attempt in range(self.retry):
            try:
                with urllib.request.urlopen(f"{self.url}/{what}?{urllib.parse.urlencode(self.fields | fields)}", timeout=60) as r:
                    return r.read().decode()
            except OSError:
                if attempt + 1 == self.retry:
                    raise
                time.sleep(self.wait * 2**attempt)
        raise ValueError("retry must be at least 1")

    def partitions(self) -> list[Page]:
        found = self.get("search", retmax=0)
        return [Page(s) for s in range(0, int(found), self.size)]

    def read(self, partition: Page) -> Iterator[tuple[int, str]]:
        yield partition.start // self.size, self.get("fetch", retstart=partition.start, retmax=self.size)
