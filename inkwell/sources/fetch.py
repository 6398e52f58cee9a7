"""Listings and feeds over HTTP as a Spark data source: batches of addresses, and a stream of numbered pages.

    spark.dataSource.register(FetchSource)
    spark.read.format("inkwell_fetch").option("urls", '["https://..."]').load()
    spark.readStream.format("inkwell_fetch").option("template", "https://host/list?page={page}").option("pages", 40).load()

A row for each address: (url, status, body, error). What fails is a row with an error, and touches no other address.
"""

from __future__ import annotations

import json
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator, Sequence

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

#: Addresses that one task fetches, and pages of a micro-batch, unless an option says otherwise.
PER_TASK, PER_BATCH = 8, 5


class Addresses(InputPartition):
    def __init__(self, urls: Sequence[str]) -> None:
        self.urls = list(urls)


def fetched(url: str, timeout: float, form: str | None) -> tuple[str, int | None, str | None, str | None]:
    """``form``: JSON object of fields to post."""
    try:
        data = urllib.parse.urlencode(json.loads(form)).encode() if form else None
        with urllib.request.urlopen(urllib.request.Request(url, data=data), timeout=timeout) as answer:
            charset = answer.headers.get_content_charset() or "utf-8"
            return url, answer.status, answer.read().decode(charset, "replace"), None
    except urllib.error.HTTPError as e:
        return url, e.code, None, f"HTTP {e.code}"
    except Exception as e:  # whatever goes wrong with an address stays with it
        return url, None, None, f"{type(e).__name__}: {e}"


class _Options:
    def __init__(self, options: dict) -> None:
        self.urls = json.loads(options.get("urls", "[]"))
        self.template, self.pages = options.get("template"), int(options.get("pages", 0))
        self.timeout, self.form = float(options.get("timeout", 12)), options.get("form")
        self.per_task, self.per_batch = int(options.get("pertask", PER_TASK)), int(options.get("perbatch", PER_BATCH))
        if bool(self.urls) == bool(self.template):
            raise ValueError("give either urls or template and pages")

    def split(self, urls: Sequence[str]) -> list[Addresses]:
        return [Addresses(urls[i : i + self.per_task]) for i in range(0, len(urls), self.per_task)]

    def numbered(self, first: int, after: int) -> list[str]:
        return [self.template.format(page=k) for k in range(first, after)]

    def read(self, part: Addresses) -> Iterator[tuple]:
        for url in part.urls:
            yield fetched(url, self.timeout, self.form)


class FetchReader(DataSourceReader):
    def __init__(self, options: _Options) -> None:
        self.options = options

    def partitions(self) -> Sequence[InputPartition]:
        o = self.options
        return o.split(o.urls or o.numbered(1, o.pages + 1)) or [Addresses([])]

    def read(self, partition: Addresses) -> Iterator[tuple]:
        return self.options.read(partition)


class FetchStreamReader(DataSourceStreamReader):
    """Pages 1 to ``pages``, ``perbatch`` a micro-batch; the offset is the next page, so a restarted query goes on where it was."""

    def __init__(self, options: _Options) -> None:
        self.options, self.known = options, 1

    def initialOffset(self) -> dict:
        return {"page": 1}

    def latestOffset(self) -> dict:
        self.known = min(self.known + self.options.per_batch, self.options.pages + 1)
        return {"page": self.known}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        self.known = max(self.known, end["page"])
        return self.options.split(self.options.numbered(start["page"], end["page"]))

    def read(self, partition: Addresses) -> Iterator[tuple]:
        return self.options.read(partition)

    def commit(self, end: dict) -> None:
        pass


class FetchSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "inkwell_fetch"

    def schema(self) -> str:
        return "url string, status int, body string, error string"

    def reader(self, schema: StructType) -> FetchReader:
        return FetchReader(_Options(self.options))

    def streamReader(self, schema: StructType) -> FetchStreamReader:
        return FetchStreamReader(_Options(self.options))
