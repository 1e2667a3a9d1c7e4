"""Web pages as a data source, for batches and for polling streams.

``spark.dataSource.register(WebPages)``, then ``spark.read.format("web_pages")`` or ``spark.readStream.format(...)`` with options:

* ``urls``: the approved URLs, one a line. Nothing else is fetched, redirects included.
* ``pace``: seconds between two requests to a host (1.0). A host is one partition, so the pace holds on a cluster.
* ``timeout``: seconds (20). ``retries``: after failures without a status (2).
* ``every``: for streams, seconds of a polling round (3600). Each URL is fetched once a round.

Rows are those of fetch() with the time of fetching and the round. A stream's offset is its round, so a round that was committed
is not fetched again after a restart; rounds that nobody waited for are skipped.
"""

from __future__ import annotations

import datetime as dt
import time
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from urllib.parse import urlsplit

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from quern.sources.fetch import FETCHED, fetch_one, http_get


@dataclass
class _Host(InputPartition):
    host: str
    urls: tuple[str, ...]
    round: int


class _Reader:
    def __init__(self, options: dict[str, str]):
        self.urls = tuple(dict.fromkeys(u.strip() for u in options.get("urls", "").splitlines() if u.strip()))
        self.pace, self.timeout, self.retries = float(options.get("pace", 1.0)), float(options.get("timeout", 20.0)), int(options.get("retries", 2))

    def by_host(self, number: int) -> list[_Host]:
        hosts: dict[str, list[str]] = {}
        for u in self.urls:
            hosts.setdefault(urlsplit(u).netloc.lower(), []).append(u)
        return [_Host(h, tuple(us), number) for h, us in sorted(hosts.items())]

    def read(self, partition: _Host) -> Iterator[tuple]:
        listed = frozenset(self.urls)
        get = partial(http_get, timeout=self.timeout, listed=listed)
        for n, url in enumerate(partition.urls):
            if url not in listed:
                raise ValueError(f"not an approved URL: {url}")
            if n:
                time.sleep(self.pace)
            yield (*fetch_one(url, get, self.retries), dt.datetime.now(dt.timezone.utc), partition.round)


class _Batch(_Reader, DataSourceReader):
    def partitions(self) -> list[_Host]:
        return self.by_host(0) or [_Host("", (), 0)]


class _Stream(_Reader, DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.every = float(options.get("every", 3600))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"round": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"round": int(time.time() // self.every)}

    def partitions(self, start: dict, end: dict) -> list[_Host]:
        return self.by_host(end["round"]) if end["round"] > start["round"] else []

    def commit(self, end: dict) -> None:
        """Nothing is kept beside the checkpoint."""


class WebPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "web_pages"

    def schema(self) -> str:
        return f"{FETCHED}, fetched_at timestamp, round long"

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _Stream(self.options)
