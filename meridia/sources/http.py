"""HTTP fetching with retries and politeness, one task per host.

The transport is a parameter, so that everything but the network can be tested
offline; the default one is the standard library's.
"""

from __future__ import annotations

import random
import threading
import time
import urllib.error
import urllib.request
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, fields
from datetime import datetime, timezone
from email.utils import parsedate_to_datetime
from itertools import groupby
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from ..plans.schemas import FETCHED

KEPT_HEADERS = ("content-type", "content-length", "etag", "last-modified", "date", "location")


@dataclass(frozen=True)
class FetchPolicy:
    attempts: int = 3
    base_delay: float = 0.5
    max_delay: float = 30.0
    jitter: float = 0.1
    spacing: float = 0.1
    in_flight: int = 2
    timeout: float = 30.0
    max_bytes: int = 50_000_000

    def delay(self, attempt: int, status: int | None = None, retry_after: float | None = None, noise: float = 0.0) -> float:
        wait = min(self.max_delay, self.base_delay * 2 ** (attempt - 1)) + noise * self.jitter
        return max(wait, retry_after) if retry_after is not None and status in (429, 503) else wait


def retryable(status: int | None) -> bool:
    """No answer at all, 408, 429, and server errors."""
    return status is None or status in (408, 429) or status >= 500


def retryable_column(status: Column) -> Column:
    return status.isNull() | status.isin(408, 429) | (status >= 500)


def retry_after_seconds(value: str | None, now: datetime | None = None) -> float | None:
    if not value:
        return None
    if value.strip().isdigit():
        return float(value)
    try:
        return max(0.0, (parsedate_to_datetime(value) - (now or datetime.now(timezone.utc))).total_seconds())
    except (TypeError, ValueError):
        return None


def send(url: str, policy: FetchPolicy) -> tuple[int, dict, bytes, str]:
    """(status, headers, body, final address); OSError without an answer."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": "meridia"}), timeout=policy.timeout) as r:
            return r.status, {k.lower(): v for k, v in r.headers.items()}, r.read(policy.max_bytes + 1), r.url
    except urllib.error.HTTPError as e:
        return e.code, {k.lower(): v for k, v in e.headers.items()}, b"", url


def fetch_one(url: str, policy: FetchPolicy, transport: Callable = send, sleep: Callable = time.sleep) -> dict:
    row = {"url": url, "resolved_url": None, "status": None, "content_type": None, "headers": {}, "body": None, "fetched_at": None, "error_type": None, "message": None, "attempts": 0}
    for attempt in range(1, policy.attempts + 1):
        row["attempts"], headers = attempt, {}
        try:
            status, headers, body, final = transport(url, policy)
            row |= {"status": status, "error_type": "http_status", "message": f"status {status}"}
        except TimeoutError as e:
            status, body = None, b""
            row |= {"status": None, "error_type": "timeout", "message": str(e)}
        except OSError as e:
            status, body = None, b""
            row |= {"status": None, "error_type": "transport", "message": str(e)}
        if status is not None and status < 400:
            if len(body) > policy.max_bytes:
                return row | {"error_type": "value", "message": "body too large"}
            kind = (headers.get("content-type") or "").split(";")[0].strip().lower()
            kept = {k: v for k, v in headers.items() if k in KEPT_HEADERS}
            return row | {"resolved_url": final, "content_type": kind or None, "headers": kept, "body": body, "fetched_at": datetime.now(timezone.utc), "error_type": None, "message": None}
        if not retryable(status):
            return row
        if attempt < policy.attempts:
            sleep(policy.delay(attempt, status, retry_after_seconds(headers.get("retry-after")), random.random()))
    return row | {"error_type": "attempts_exhausted" if policy.attempts > 1 else row["error_type"]}


class Host:
    """One host's requests: at most ``in_flight`` at once, begun at least ``spacing`` apart; a waiting time that the host asks for holds for all of them."""

    def __init__(self, policy: FetchPolicy, transport: Callable = send, clock: Callable = time.monotonic, sleep: Callable = time.sleep):
        self.policy, self.transport, self.clock, self.sleep = policy, transport, clock, sleep
        self.lock, self.next_at = threading.Lock(), 0.0

    def _turn(self) -> None:
        """Waits until the next request may begin."""
        with self.lock:
            wait = self.next_at - self.clock()
            if wait > 0:
                self.sleep(wait)
            self.next_at = max(self.next_at, self.clock()) + self.policy.spacing

    def _send(self, url: str, policy: FetchPolicy):
        self._turn()
        got = self.transport(url, policy)
        asked = retry_after_seconds(got[1].get("retry-after")) if got[0] in (429, 503) else None
        if asked:
            with self.lock:
                self.next_at = max(self.next_at, self.clock() + asked)
        return got

    def fetch(self, urls: Iterable[str]) -> Iterator[dict]:
        """A row for each address, in order. No more answers wait than requests may be in flight, so memory holds that many bodies."""
        with ThreadPoolExecutor(self.policy.in_flight) as pool:
            waiting: deque = deque()
            for url in urls:
                if len(waiting) >= self.policy.in_flight:
                    yield waiting.popleft().result()
                waiting.append(pool.submit(fetch_one, url, self.policy, self._send, self.sleep))
            while waiting:
                yield waiting.popleft().result()


def _batches(rows: Iterator[dict], limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of at most ``limit`` bytes of bodies, or one row."""
    schema = to_arrow_schema(FETCHED)
    held, size = [], 0
    for row in rows:
        more = len(row["body"] or b"")
        if held and size + more > limit:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
        held.append(row | {"headers": list(row["headers"].items())})
        size += more
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[^:]+://([^/?#]*)", 1))


def fetch(urls: DataFrame, policy: FetchPolicy | None = None, url: str = "url", transport: Callable = send) -> DataFrame:
    """Fetched documents or their errors.

    All addresses of a host are in one task, which is what keeps its limits; a
    task takes its hosts one after another. Bodies go from the task to where
    the result is written.
    """
    policy = policy or FetchPolicy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((u, h) for b in batches for u, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        for _, own in groupby(rows, key=lambda x: x[1]):
            yield from _batches(Host(policy, transport).fetch(u for u, _ in own))

    hosted = urls.select(F.col(url).alias("url"), host_of(F.col(url)).alias("_host"))
    return hosted.repartition("_host").sortWithinPartitions("_host").mapInArrow(run, FETCHED)


@dataclass
class _HostUrls(InputPartition):
    urls: tuple[str, ...]


class _HttpReader(DataSourceReader):
    def __init__(self, urls: list[str], policy: FetchPolicy, transport: Callable):
        self.urls, self.policy, self.transport = urls, policy, transport

    def partitions(self) -> list[InputPartition]:
        by: dict[str, list[str]] = {}
        for u in self.urls:
            by.setdefault(urlsplit(u).netloc.lower(), []).append(u)
        return [_HostUrls(tuple(own)) for own in by.values()] or [_HostUrls(())]

    def read(self, partition: _HostUrls) -> Iterator[pa.RecordBatch]:
        yield from _batches(Host(self.policy, self.transport).fetch(partition.urls))


class HttpDocuments(DataSource):
    """``spark.read.format("http_documents").option("urls", ...)``: documents by their addresses, one a line, with a partition for each host.

    Options of a FetchPolicy (attempts, spacing, in_flight, ...) have its names. For
    addresses that are a table, use ``fetch``.
    """

    transport = staticmethod(send)

    @classmethod
    def name(cls) -> str:
        return "http_documents"

    def schema(self):
        return FETCHED

    def reader(self, schema) -> DataSourceReader:
        kinds = {f.name: type(f.default) for f in fields(FetchPolicy)}
        given = {k.lower(): v for k, v in self.options.items()}
        if unknown := set(given) - set(kinds) - {"urls"}:
            raise ValueError(f"unknown options {sorted(unknown)}")
        policy = FetchPolicy(**{k: kinds[k](v) for k, v in given.items() if k in kinds})
        return _HttpReader([u.strip() for u in given.get("urls", "").splitlines() if u.strip()], policy, self.transport)
