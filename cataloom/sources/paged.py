"""Paged remote listings as a Spark data source: partitions of pages, stop rules and retries.

Register PagedSource and read format "paged", or call pages(). A row is (key, page, body) of one page; the stop rules of
extract.collection_rows and extract.counted_rows then hold across partitions, so pages that two partitions read past an end
change nothing. Reading a partition twice gives the same rows: nothing is kept between reads.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "key string, page int, body string"
#: Statuses after which a request is made again.
AGAIN = frozenset({429, 500, 502, 503, 504})


def fetched(url: str, headers: dict[str, str] | None = None, attempts: int = 4, wait: float = 0.5, timeout: float = 30.0) -> str | None:
    """The text behind a URL, None if there is nothing; a folder stands for its files' texts.

    Requests that fail for a while are repeated with doubling waits; other errors are raised.
    """
    if not url.startswith(("http://", "https://")):
        fs, path = pyarrow.fs.FileSystem.from_uri(url)
        found = fs.get_file_info(path)
        if found.type == pyarrow.fs.FileType.NotFound:
            return None
        files = [path] if found.is_file else sorted(f.path for f in fs.get_file_info(pyarrow.fs.FileSelector(path)) if f.is_file and not f.base_name.startswith(("_", ".")))
        return "".join(fs.open_input_stream(f).read().decode() for f in files)
    for left in range(attempts - 1, -1, -1):
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers=headers or {}), timeout=timeout) as response:
                return response.read().decode()
        except urllib.error.HTTPError as e:
            if e.code == 404:
                return None
            if e.code not in AGAIN or not left:
                raise
        except (urllib.error.URLError, TimeoutError):
            if not left:
                raise
        time.sleep(wait)
        wait *= 2
    return None


@dataclass
class Pages(InputPartition):
    key: str
    first: int
    last: int


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.url, self.keys = options["url"], json.loads(options["keys"])
        self.limit, self.most = int(options.get("limit", 250)), int(options.get("most", 20))
        self.items, self.total = options.get("items", "items"), options.get("total", "")
        self.per_partition = int(options.get("pagespertask", options.get("pagesPerTask", 5)))
        self.headers = json.loads(options.get("headers", "{}"))
        self.wait = float(options.get("wait", 0.5))

    def partitions(self) -> list[Pages]:
        return [Pages(k, a, min(a + self.per_partition - 1, self.most)) for k in self.keys for a in range(1, self.most + 1, self.per_partition)]

    def is_last(self, body: str, page: int) -> bool:
        """Whether no page follows, as far as one page tells: a stated total, else fewer items than the limit."""
        try:
            document = json.loads(body)
        except ValueError:
            return True
        if self.total:
            for step in self.total.split("."):
                document = document.get(step) if isinstance(document, dict) else None
            return page >= (document if isinstance(document, int) else 1)
        found = document.get(self.items) if isinstance(document, dict) else None
        return not isinstance(found, list) or len(found) < self.limit

    def read(self, partition: Pages) -> Iterator[tuple[str, int, str]]:
        for page in range(partition.first, partition.last + 1):
            url = self.url.format(key=partition.key, page=page, offset=(page - 1) * self.limit, limit=self.limit)
            body = fetched(url, self.headers, wait=self.wait)
            if body is None:
                return
            yield partition.key, page, body
            if self.is_last(body, page):
                return


class PagedSource(DataSource):
    """Options: url (with {key}, {page}, {offset}, {limit}), keys (JSON list), limit, most, items, total (path of a stated
    number of pages), pagesPerTask, headers (JSON), wait."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PagedReader:
        return PagedReader(dict(self.options))


def pages(spark: SparkSession, url: str, keys: list[str], limit: int = 250, most: int = 20, items: str = "items", total: str = "", per_task: int = 5, headers: dict[str, str] | None = None, wait: float = 0.5) -> DataFrame:
    """(key, page, body) of the listings of all keys, up to most pages each; tasks read per_task pages."""
    spark.dataSource.register(PagedSource)
    options = {"url": url, "keys": json.dumps(keys), "limit": limit, "most": most, "items": items, "total": total, "pagesPerTask": per_task, "headers": json.dumps(headers or {}), "wait": wait}
    return spark.read.format("paged").options(**options).load()
