"""A Spark data source for JSON that comes in pages, over HTTP or from saved pages.

    spark.dataSource.register(PagedJson)
    spark.read.format("paged_json").option("url", "https://example.org/items?page={page}").option("pages", 5)
        .option("items", "data.list").schema("id long, title string").load()

Each page is one partition, so pages are fetched by the executors, as many as asked for; a page that fails is tried
again, with growing pauses, and Spark repeats the task if an executor is lost. Nested names of the schema's columns are
reached by dots in the option fields ("title=content.title,...").

Where a page names the next one, give the option next (its dotted path) and a URL with {cursor}: the pages are then
followed one after the other in one task, `pages` of them at most if that is given. As a stream (readStream), the same
options read page after page, one a batch, and the offset is the page number or the cursor; a restart goes on there.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

def pick(value, path: str):
    """The value at a dotted path, or None."""
    for name in filter(None, path.split(".")):
        if isinstance(value, list) and name.isdigit() and int(name) < len(value):
            value = value[int(name)]
        elif isinstance(value, dict):
            value = value.get(name)
        else:
            return None
    return value


def pause(attempt: int, first: float = 0.5, most: float = 30.0) -> float:
    """Seconds before another attempt: doubling, half of them fixed."""
    return min(most, first * 2**attempt)


class PagedJson(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "raw string"

    def reader(self, schema: StructType) -> PagedReader:
        return PagedReader(schema, self.options)

    def simpleStreamReader(self, schema: StructType) -> PagedStream:
        return PagedStream(schema, self.options)


class PagedReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.options = schema, dict(options)
        self.fields = dict(p.split("=", 1) for p in self.options.get("fields", "").split(",") if "=" in p)

    def partitions(self) -> list[InputPartition]:
        if "next" in self.options:
            return [InputPartition(self.options.get("cursor", ""))]
        return [InputPartition(k + int(self.options.get("first", 1))) for k in range(max(1, int(self.options.get("pages", 1))))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if "next" not in self.options:
            yield from self.page(partition.value)[0]
            return
        at, left, seen = partition.value, int(self.options.get("pages", 0)) or None, set()
        while at is not None and at not in seen and left != 0:
            seen.add(at)  # a cursor that comes again would never end
            rows, at = self.page(at)
            yield from rows
            left = None if left is None else left - 1

    def page(self, at) -> tuple[list[tuple], str | None]:
        """The rows of a page, and the cursor of the next one if the page names it."""
        body = self._fetch(self.options["url"].replace("{page}", str(at)).replace("{cursor}", str(at)))
        found = json.loads(body) if body is not None else {}
        items = pick(found, self.options.get("items", "")) if body is not None else []
        rows = [tuple(json.dumps(item, ensure_ascii=False) if f.name == "raw" else self._cast(pick(item, self.fields.get(f.name, f.name)), f) for f in self.schema) for item in items or []]
        following = pick(found, self.options["next"]) if "next" in self.options else None
        return rows, None if following in (None, "", False) else str(following)

    @staticmethod
    def _cast(value, field):
        kind = field.dataType.simpleString()
        if value is None:
            return None
        try:
            return {"bigint": int, "int": int, "double": float, "string": str, "boolean": bool}[kind](value)
        except (KeyError, TypeError, ValueError):
            return None

    def _fetch(self, url: str, attempts: int = 3) -> str | None:
        for k in range(attempts):
            try:
                with urllib.request.urlopen(url, timeout=30) as page:
                    return page.read().decode("utf-8")
            except urllib.error.HTTPError as e:
                if e.code == 404:
                    return None  # past the last page
                if k == attempts - 1:
                    raise
            except OSError:
                if k == attempts - 1:
                    raise
            time.sleep(pause(k))
        return None


class PagedStream(SimpleDataSourceStreamReader):
    """One page a batch; an offset says which page is next, and `done` that there is none."""

    def __init__(self, schema: StructType, options: dict):
        self.reader = PagedReader(schema, options)

    def initialOffset(self) -> dict:
        o = self.reader.options
        return {"at": o.get("cursor", ""), "n": 0} if "next" in o else {"at": int(o.get("first", 1)), "n": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        o = self.reader.options
        most = int(o.get("pages", 0 if "next" in o else 1))
        if start.get("done") or (most and start["n"] >= most):
            return iter([]), start
        rows, following = self.reader.page(start["at"])
        if "next" not in o:
            return iter(rows), {"at": start["at"] + 1, "n": start["n"] + 1}
        return iter(rows), {"at": following, "n": start["n"] + 1} | ({"done": True} if following is None else {})

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        while start["n"] < end["n"]:
            rows, start = self.read(start)
            yield from rows
