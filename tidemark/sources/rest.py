"""A paged REST source as a Spark data source, with retries, guards and a transport that is given to it."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from email.utils import parsedate_to_datetime
from urllib.parse import quote, urlencode, urlparse

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidemark.sources.settings import Pace

# fixed values: answers after which a request is tried again
RETRY_STATUS = (429, 500, 502, 503, 504)

#: transport(url) -> (status, headers, body); a name of a factory "module:function" so that executors can make their own.
Transport = Callable[[str], tuple[int, dict, str]]


class RequestFailed(RuntimeError):
    """A request that failed for good."""


def retry_delay(attempt: int, headers: dict, now: float, cap: float = 30.0) -> float:
    """Seconds to wait after the attempt-th failure: Retry-After (seconds or a date), then the rate limit's reset, then
    powers of two; never above the cap."""
    h = {k.lower(): v for k, v in headers.items()}
    after = h.get("retry-after")
    if after is not None:
        try:
            return min(cap, max(0.0, float(after)))
        except ValueError:
            try:
                return min(cap, max(0.0, parsedate_to_datetime(after).timestamp() - now))
            except (TypeError, ValueError):
                pass
    try:
        return min(cap, max(0.0, float(h["x-ratelimit-reset"]) - now))
    except (KeyError, ValueError):
        return min(cap, 2.0 ** (attempt - 1))


def fetch(transport: Transport, url: str, attempts: int = 5, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.time) -> dict:
    """The JSON object at url; answers of RETRY_STATUS and transport errors are tried again."""
    for k in range(1, attempts + 1):
        headers: dict = {}
        try:
            status, headers, body = transport(url)
            if status == 200:
                return json.loads(body)
            if status not in RETRY_STATUS:
                raise RequestFailed(f"status {status}")
        except OSError as e:
            status = str(e)
        if k < attempts:
            sleep(retry_delay(k, headers, clock()))
    raise RequestFailed(f"{attempts} attempts, the last: {status}")


def pages(transport: Transport, url: str, most: int, **kw) -> Iterator[dict]:
    """Pages linked by next_page_token; a repeated token or too many pages fail."""
    seen: set[str] = set()
    token = None
    for _ in range(most):
        page = fetch(transport, url + (f"&page_token={quote(token, safe='')}" if token else ""), **kw)
        yield page
        token = page.get("next_page_token")
        if token is None:
            return
        if token in seen:
            raise RequestFailed("a page token came twice")
        seen.add(token)
    raise RequestFailed(f"more than {most} pages")


def allowed(url: str, prefixes: tuple[str, ...]) -> bool:
    """Whether a link is https and below one of the allowed endpoints, host and path compared exactly."""
    u = urlparse(url)
    for p in map(urlparse, prefixes):
        if u.scheme == p.scheme == "https" and u.netloc == p.netloc and (u.path == p.path or u.path.startswith(p.path.rstrip("/") + "/")):
            return True
    return False


def bar_rows(page: dict) -> Iterator[tuple]:
    """(symbol, t, o, h, l, c, v, vw, n) of a page of bars by symbol."""
    for symbol, bars in sorted((page.get("bars") or {}).items()):
        for b in bars or ():
            yield symbol, b["t"], float(b["o"]), float(b["h"]), float(b["l"]), float(b["c"]), int(b["v"]), None if b.get("vw") is None else float(b["vw"]), b.get("n")


class _Symbols(InputPartition):
    def __init__(self, symbols: list[str]):
        self.symbols = symbols


class PagedBars(DataSource):
    """``spark.read.format("paged_bars")`` with options endpoint, allow, symbols, timeframe, start, end, feed, adjustment,
    limit, pages, pace (seconds between requests of a task) and transport (``module:function``, called with nothing, gives
    the transport). start and end bound the scan and must be given. One input partition per symbol."""

    @classmethod
    def name(cls) -> str:
        return "paged_bars"

    def schema(self) -> str:
        return "symbol string, t string, o double, h double, l double, c double, v long, vw double, n long"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)
        if not allowed(self.options["endpoint"], tuple(self.options["allow"].split(","))):
            raise RequestFailed("endpoint isn't allowed")
        if not self.options.get("start") or not self.options.get("end"):
            raise RequestFailed("a scan needs a start and an end")

    def partitions(self) -> list[InputPartition]:
        return [_Symbols([s]) for s in sorted(set(self.options["symbols"].split(",")))]

    def read(self, partition: _Symbols) -> Iterator[tuple]:
        import importlib

        module, _, name = self.options["transport"].partition(":")
        transport = getattr(importlib.import_module(module), name)()
        asked = {"symbols": ",".join(partition.symbols), "timeframe": self.options.get("timeframe", "1Min")}
        asked |= {k: self.options[k] for k in ("start", "end", "feed", "adjustment", "limit") if self.options.get(k)}
        if float(self.options.get("pace", "0")):
            transport = Pace(float(self.options["pace"])).around(transport)
        url = f"{self.options['endpoint']}?{urlencode(asked)}"
        for page in pages(transport, url, int(self.options.get("pages", "100"))):
            yield from bar_rows(page)
