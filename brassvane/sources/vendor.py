"""Vendor connectors as a Python data source: items dealt to partitions in turn, retries with back-off, failures as rows.

A fetcher maps an item (a code, a quarter, a page) to rows. Network clients implement it elsewhere; FileFetcher serves files, for
tests and replays. An item that keeps failing gives one row with its error, so the rest of the load stands. The vendors' own
ways - histories paged backwards, numbered pages, wrapped JSON, values that a child process decodes - are functions over a
page function, so a client is no more than one request.
"""

from __future__ import annotations

import hashlib
import importlib
import json
import os
import queue
import re
import subprocess
import threading
import time
from collections.abc import Callable, Iterator
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# The paging and the limits of the vendors.
SEGMENTS, SEGMENT_ROWS, LOT = 21, 640, 100
PAGE_ROWS, LEAST_CHARS, TITLE_CHARS, TEXT_CHARS, TIME_CHARS = 100, 20, 200, 2000, 19


class FileFetcher:
    """Rows of `<folder>/<item>.jsonl`."""

    def __init__(self, folder: str):
        self.folder = folder

    def fetch(self, item: str) -> Iterator[dict]:
        with open(f"{self.folder}/{item}.jsonl", encoding="utf-8") as f:
            yield from (json.loads(x) for x in f if x.strip())


class Cached:
    """A fetcher's answers kept as files, one per request, in a folder that all executors share; the key is the sha-256 of fetcher and item."""

    def __init__(self, folder: str, fetcher: str, *arguments):
        self.folder, self.name, self.arguments = folder, fetcher, arguments

    def fetch(self, item: str) -> list[dict]:
        key = hashlib.sha256(json.dumps([self.name, *self.arguments, item], ensure_ascii=False).encode()).hexdigest()
        path = os.path.join(self.folder, f"{key}.json")
        if os.path.exists(path):
            with open(path, encoding="utf-8") as f:
                return json.load(f)
        rows = list(_made(self.name, self.arguments).fetch(item))
        with open(f"{path}.{os.getpid()}", "w", encoding="utf-8") as f:
            json.dump(rows, f, ensure_ascii=False)
        os.replace(f"{path}.{os.getpid()}", path)  # readers see a whole file or none
        return rows


def _made(name: str, arguments: list | tuple):
    module, _, cls = name.rpartition(".")
    return getattr(importlib.import_module(module), cls)(*arguments)


def backward_pages(page: Callable[[str, str], list[list]], start: str, end: str, most: int = SEGMENTS) -> list[dict]:
    """Bars of a history that a vendor pages backwards: page(start, end) gives the last rows up to `end`, oldest first, as lists of
    date, open, close, high, low, volume in lots and more. Asked again up to the day before the oldest one until `start` is
    reached, nothing comes or `most` pages were read. One bar a date, of the earliest page that has it, oldest first; volumes in shares; unreadable numbers null."""
    pages = []
    while len(pages) < most:
        rows = page(start, end)
        if not rows:
            break
        pages.append(rows)
        if rows[0][0] <= start:
            break
        end = (date.fromisoformat(rows[0][0]) - timedelta(days=1)).isoformat()
    by_date: dict[str, list] = {}
    for rows in reversed(pages):
        for r in rows:
            by_date.setdefault(r[0], r)
    number = lambda x: float(x) if re.fullmatch(r"\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*", str(x)) else None
    out = []
    for d, r in by_date.items():
        o, c, h, low, v = map(number, r[1:6])
        out.append({"date": d, "open": o, "high": h, "low": low, "close": c, "volume": None if v is None else v * LOT})
    return out


def numbered_pages(page: Callable[[int], list[dict]], most: int, size: int = PAGE_ROWS) -> Iterator[dict]:
    """Rows of pages 1 to `most`; an empty page or one with fewer than `size` rows is the last. A page that fails ends the list, what came before stays."""
    for n in range(1, most + 1):
        try:
            rows = page(n)
        except Exception:  # noqa: BLE001
            return
        yield from rows
        if len(rows) < size:
            return


def unwrapped(text: str, callback: str) -> dict:
    """The JSON inside `callback(...)`, or the text's own."""
    m = re.match(rf"\s*{re.escape(callback)}\((.*)\)\s*;?\s*$", text, re.DOTALL)
    return json.loads(m[1] if m else text)


def article(raw: dict, code: str, source: str) -> dict | None:
    """A vendor's news item under common names, without tags, cut to what is stored; None if title and text hold fewer than LEAST_CHARS characters."""
    bare = lambda t: " ".join(re.sub("<[^>]+>", "", str(t or "")).replace("\u3000", " ").split())
    title = bare(raw.get("title"))
    whole = f"{title} {bare(raw.get('content'))}".strip()
    if len(whole) < LEAST_CHARS:
        return None
    return {"title": title[:TITLE_CHARS], "text": whole[:TEXT_CHARS], "stock_code": code, "source": source, "publish_time": str(raw.get("date") or "")[:TIME_CHARS], "url": str(raw.get("url") or "")}


class Decoder:
    """A child process that answers one JSON line a request, one request at a time; a task starts its own and closes it. Lines that
    aren't the answer are skipped; no answer within `wait` seconds is a TimeoutError, a process that ends a RuntimeError."""

    def __init__(self, command: list[str], wait: float = 20.0):
        self.process = subprocess.Popen(command, stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, text=True, encoding="utf-8", bufsize=1)
        self.wait, self.lock, self.n, self.lines = wait, threading.Lock(), 0, queue.Queue()
        threading.Thread(target=self._read, daemon=True).start()

    def _read(self) -> None:
        for line in self.process.stdout:
            self.lines.put(line)
        self.lines.put(None)

    def decode(self, value: str):
        with self.lock:
            self.n += 1
            self.process.stdin.write(json.dumps({"id": self.n, "enc": value}) + "\n")
            self.process.stdin.flush()
            until = time.monotonic() + self.wait
            while True:
                try:
                    line = self.lines.get(timeout=max(0.0, until - time.monotonic()))
                except queue.Empty:
                    raise TimeoutError("no answer from the decoder") from None
                if line is None:
                    raise RuntimeError("the decoder has ended")
                try:
                    answer = json.loads(line)
                except ValueError:
                    continue
                if isinstance(answer, dict) and answer.get("id") == self.n:
                    if answer.get("ok"):
                        return answer["data"]
                    raise RuntimeError(answer.get("err", "not decoded"))

    def close(self) -> None:
        self.process.terminate()
        self.process.wait(timeout=5)


def with_retries(fetch, item: str, tries: int, wait: float, factor: float = 2.0) -> tuple[list[dict], str | None]:
    """(rows, None), or ([], the last error) after `tries` attempts; the pause starts at `wait` seconds and grows by `factor` each time."""
    error = None
    for k in range(tries):
        try:
            return list(fetch(item)), None
        except Exception as e:  # noqa: BLE001
            error = f"{type(e).__name__}: {e}"
            if k + 1 < tries:
                time.sleep(wait * factor**k)
    return [], error


class VendorReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        items = json.loads(self.options["items"])
        n = min(len(items), int(self.options.get("workers", "0")) or len(items))
        return [InputPartition(items[i::n]) for i in range(n)]  # dealt in turn, so every worker has its share of slow ones

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        o = self.options
        fetcher = _made(o["fetcher"], json.loads(o.get("arguments", "[]")))
        straight, limit, pause = 0, int(o.get("failures", "15")), float(o.get("pause", "120"))
        for item in partition.value:
            rows, error = with_retries(fetcher.fetch, item, int(o.get("tries", "3")), float(o.get("wait", "1")), float(o.get("factor", "2")))
            straight = straight + 1 if error else 0
            if error:
                yield (item, None, error)
            if straight >= limit:  # the vendor seems to throttle
                time.sleep(pause)
                straight = 0
            for r in rows:
                yield (item, json.dumps(r, ensure_ascii=False), None)


class VendorSource(DataSource):
    """Options: fetcher (import path of its class), arguments, items (JSON arrays), tries, wait (seconds), factor of the back-off, workers
    (partitions; one an item if unset), failures in a row after which a worker pauses, pause (seconds)."""

    @classmethod
    def name(cls) -> str:
        return "vendor"

    def schema(self) -> str:
        return "item string, record string, error string"

    def reader(self, schema) -> VendorReader:
        return VendorReader(self.options)


def load(spark: SparkSession, fetcher: str, items: list[str], arguments: list | None = None, tries: int = 3, wait: float = 1.0, **options) -> DataFrame:
    """(item, record JSON, error) of all items; `options` are VendorSource's others. An empty list of items gives no rows."""
    if not items:
        return spark.createDataFrame([], "item string, record string, error string")
    spark.dataSource.register(VendorSource)
    o = {"fetcher": fetcher, "items": json.dumps(items), "arguments": json.dumps(arguments or []), "tries": str(tries), "wait": str(wait)}
    return spark.read.format("vendor").options(**o, **{k: str(v) for k, v in options.items()}).load()


def failed(loaded: DataFrame, path: str) -> None:
    """Writes the items that failed, with their errors, as JSON lines."""
    loaded.where("error is not null").select("item", "error").write.mode("overwrite").json(path)
