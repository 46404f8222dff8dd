"""A paginated JSON feed as a Spark data source, for batches and streams: executors fetch pages, the driver only finds the end."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

COMPARED = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


class Pages(InputPartition):
    """Rows from ``start`` to ``stop`` of the feed's rows under ``where``, in pages."""

    def __init__(self, start: int, stop: int, where: list[str]):
        super().__init__((start, stop))
        self.start, self.stop, self.where = start, stop, where


class Feed:
    """Requests of one feed. Texts of failures and waits: see get()."""

    def __init__(self, schema, options: dict[str, str]):
        self.names = schema.names
        self.url, self.limit = options["url"], int(options.get("limit", "5000"))
        self.pages, self.ends = int(options.get("pages", "1")), options.get("ends", "empty")
        self.order, self.tries, self.wait = options.get("order", ":id"), int(options.get("tries", "5")), float(options.get("wait", "1"))
        self.total = int(options["total"]) if "total" in options else None
        self.where = [options["where"]] if options.get("where") else []
        self.latest = options.get("latest")
        if self.ends not in ("empty", "short"):
            raise ValueError("ends has to be empty or short")

    def get(self, query: dict) -> list[dict]:
        """An answer. Lost connections, status 429 and 500 and above are tried again, after Retry-After where that is longer."""
        address = f"{self.url}?{urllib.parse.urlencode(query)}"
        for k in range(self.tries):
            try:
                with urllib.request.urlopen(address, timeout=240) as answer:
                    return json.load(answer)
            except OSError as error:
                code = getattr(error, "code", None)
                if k + 1 == self.tries or (code is not None and code != 429 and code < 500):
                    raise
                after = error.headers.get("Retry-After") if isinstance(error, urllib.error.HTTPError) else None
                time.sleep(max(self.wait * 2**k, float(after) if after and after.replace(".", "", 1).isdigit() else 0))
        return []

    def rows(self, offset: int, limit: int) -> list[dict]:
        query = {"$limit": limit, "$offset": offset, "$order": self.order}
        return self.get(query | ({"$where": " AND ".join(f"({w})" for w in self.where)} if self.where else {}))

    def only_latest(self) -> None:
        """With option latest: only rows with the greatest value of that column, which the feed is asked for first."""
        if self.latest:
            found = self.get({"$select": f"max({self.latest}) as most", "$limit": 1})
            if found and found[0].get("most") is not None:
                self.where.append(f"{self.latest}={quoted(found[0]['most'])}")
            self.latest = None

    def end(self, step: int) -> int:
        """The first multiple of step at which the feed has no row: doubled steps, then halves. A few dozen requests of one row."""
        there = lambda k: bool(self.rows(k * step, 1))
        if not there(0):
            return 0
        high = 1
        while there(high):
            high *= 2
        low = high // 2
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if there(middle) else (low, middle)
        return high * step

    def read(self, part: Pages) -> Iterator[tuple]:
        """Rows of a partition's pages, up to an empty page, or with ends=short up to a page that isn't full."""
        self.where = part.where
        for offset in range(part.start, part.stop, self.limit):
            size = min(self.limit, part.stop - offset)
            records = self.rows(offset, size)
            for record in records:
                yield tuple(None if record.get(n) is None else str(record[n]) for n in self.names)
            if not records or (self.ends == "short" and len(records) < size):
                break

    def split(self, start: int, stop: int) -> list[Pages]:
        """At least one partition, though it may have no rows."""
        starts = range(start, stop, self.limit * self.pages) or [start]
        return [Pages(a, max(start, min(a + self.limit * self.pages, stop)), self.where) for a in starts]


def quoted(value) -> str:
    return "'" + str(value).replace("'", "''") + "'"


class FeedReader(DataSourceReader):
    def __init__(self, schema, options: dict[str, str]):
        self.feed = Feed(schema, options)

    def partitions(self) -> list[Pages]:
        self.feed.only_latest()
        return self.feed.split(0, self.feed.end(self.feed.limit) if self.feed.total is None else self.feed.total)

    def read(self, partition: Pages) -> Iterator[tuple]:
        return self.feed.read(partition)


class PushingFeedReader(FeedReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Comparisons of columns with texts go into the feed's own filter; all others are left to Spark."""
        for f in filters:
            name = ".".join(f.attribute) if hasattr(f, "attribute") else ""
            if isinstance(f, IsNotNull):
                self.feed.where.append(f"{name} IS NOT NULL")
            elif type(f) in COMPARED and isinstance(f.value, str):
                self.feed.where.append(f"{name} {COMPARED[type(f)]} {quoted(f.value)}")
            elif isinstance(f, In) and f.value and all(isinstance(v, str) for v in f.value):
                self.feed.where.append(f"{name} IN ({', '.join(map(quoted, f.value))})")
            else:
                yield f


class FeedStream(DataSourceStreamReader):
    """A feed to whose end rows are added: offsets are numbers of rows."""

    def __init__(self, schema, options: dict[str, str]):
        self.feed = Feed(schema, options)
        self.start = int(options.get("start", "0"))

    def initialOffset(self) -> dict:
        return {"row": self.start}

    def latestOffset(self) -> dict:
        return {"row": max(self.start, self.feed.end(1))}

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        return self.feed.split(start["row"], end["row"])

    def read(self, partition: Pages) -> Iterator[tuple]:
        return self.feed.read(partition)

    def commit(self, end: dict) -> None:
        """Nothing is kept at the feed."""


class PagedFeed(DataSource):
    """Options: url; limit (rows a page, 5000), pages (a partition, 1), order, where, tries and wait (seconds, doubled each time).

    total is the number of rows; without it the end is found by requests of one row. ends tells how a partition's pages
    end: with ``empty`` (the default) at an empty page, with ``short`` also at one that isn't full. latest names a column of
    which only rows with the greatest value are wanted. start is a stream's first row. The schema is given; all columns are
    texts. With push=true filters go into the feed, which takes spark.sql.python.filterPushdown.enabled.
    """

    @classmethod
    def name(cls):
        return "paged_feed"

    def reader(self, schema):
        return (PushingFeedReader if self.options.get("push") == "true" else FeedReader)(schema, self.options)

    def streamReader(self, schema):
        return FeedStream(schema, self.options)
