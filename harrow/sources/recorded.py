"""Recorded exchanges with paged sources, replayed as a data source of Spark: spark.read.format("recorded").

An exchange is one request and its answer: source, page_no, attempt, status, retry_after, rows (keys), total,
stale. write() lays them down as files of many whole sources, in walk order, and beside each file where its
sources begin. The reader deals sources to partitions, seeks to each and replays each walk as a collector would: it asks a page again after a failed answer, waits as
told, learns what is new, and stops by the rules of operators.walk; what comes after is not read.

    recorded.register(spark)
    spark.read.format("recorded").option("path", folder).load()           # a row a walk
    spark.read.format("recorded").option("path", folder).option("emit", "items").load()

Options: path; emit (walks, items); most (rows a walk may collect); attempts a page; backoff seconds;
perPartition (sources a partition). The path is opened by pyarrow, when writing too, so it must be one of its
file systems. The driver sees a name and two sizes a file, never a row a source.
A walk holds the keys that it has collected and a digest a page, nothing else."""

from __future__ import annotations

import hashlib
import json
import uuid
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.walk import MAX_PAGES, SHORTFALL_SHARE, dealt

EXCHANGE = "source string, page_no int, attempt int, status int, retry_after double, rows array<string>, total long, stale boolean"
WALKS = "source string, pages long, offset long, collected long, total long, stop_reason string, complete boolean, shortfall long, requests long, waited double"
ITEMS = "source string, page_no int, key string"
#: Longest wait that an answer may ask for, and the answer that may.
LONGEST_WAIT, TOO_MANY = 120.0, 429


#: Where the sources of a file begin: 8 bytes each, in a file of this ending.
STARTS, WIDTH = ".starts", 8
BLOCK = 1 << 20


def write(exchanges: DataFrame, path: str, rows: int | None = None) -> None:
    """Files of whole sources, their exchanges in the order of pages and attempts, and where each source begins.
    rows: about how many there are, to deal them by (none: left to Spark)."""
    ordered = exchanges.repartition("source") if rows is None else dealt(exchanges, rows, "source")
    ordered = ordered.select("source", "page_no", *(c for c in exchanges.columns if c not in ("source", "page_no")))
    ordered.sortWithinPartitions("source", "page_no", "attempt").write.mode("overwrite").option("ignoreNullFields", "false").option("compression", "none").json(path)
    system, root = _open(path)
    files = [(f.path,) for f in _listed(system, root) if f.extension == "json"]
    if files:
        spark = exchanges.sparkSession
        found = spark.createDataFrame(files, "file string").repartition(len(files))
        found.mapInArrow(lambda batches: _mark(path, batches), "file string").count()


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _listed(system, root: str) -> list:
    from pyarrow import fs

    return sorted(system.get_file_info(fs.FileSelector(root)), key=lambda f: f.path)


def _lines(stream, size: int | None = None) -> Iterator[bytes]:
    """The lines of the next `size` bytes (none: of all), read block by block."""
    rest = b""
    while size is None or size > 0:
        block = stream.read(BLOCK if size is None else min(BLOCK, size))
        if not block:
            break
        size = None if size is None else size - len(block)
        *lines, rest = (rest + block).split(b"\n")
        yield from lines
    if rest:
        yield rest


def _mark(path: str, batches: Iterator) -> Iterator:
    """Write where each source of the files begins; a file takes its name once it is whole."""
    system, _ = _open(path)
    for batch in batches:
        for file in batch.column(0).to_pylist():
            starts, at, held = array("q"), 0, None
            with system.open_input_stream(file) as stream:
                for line in _lines(stream):
                    source = line[: line.index(b',"page_no":')]  # in a text the quotes would be escaped
                    if source != held:
                        starts.append(at)
                        held = source
                    at += len(line) + 1
            part = f"{file}.{uuid.uuid4().hex}.tmp"
            with system.open_output_stream(part) as out:
                out.write(starts.tobytes())
            system.move(part, file + STARTS)
        yield batch


@dataclass
class Walk:
    """One walk as it is replayed: what it has seen, and why it ended."""

    most: int
    attempts: int
    backoff: float
    pages: int = 0
    offset: int = 0
    collected: int = 0
    requests: int = 0
    waited: float = 0.0
    total: int | None = None
    reason: str | None = None
    first_size: int = 0
    was_stale: bool = False
    keys: set = field(default_factory=set)
    prints: set = field(default_factory=set)

    def answer(self, exchanges: list[dict]) -> dict | None:
        """The first good answer of a page's attempts, if one of those allowed is."""
        for n, e in enumerate(exchanges[: self.attempts]):
            self.requests += 1
            if self.total is None and e.get("total") is not None:
                self.total = e["total"]
            if 200 <= e["status"] < 300:
                return e
            if n + 1 < min(self.attempts, len(exchanges)):
                told = e.get("retry_after") if e["status"] == TOO_MANY else None
                self.waited += min(told, LONGEST_WAIT) if told else self.backoff * (n + 1)
        return None

    def page(self, exchanges: list[dict]) -> list[str]:
        """Take a page; its new keys. Sets the reason if the walk ends with it."""
        e = self.answer(exchanges)
        if e is None:
            self.reason = "page_failed"
            return []
        self.pages += 1
        rows, stale = e.get("rows") or [], bool(e.get("stale"))
        if self.pages == 1:
            self.first_size = len(rows)
        digest = hashlib.sha1(json.dumps(rows).encode()).digest()
        new = [k for k in dict.fromkeys(rows) if k is not None and k not in self.keys]
        self.reason = "exhausted" if not rows else "repeated_page" if digest in self.prints else "no_new_rows" if not new else None
        if self.reason:
            return []
        self.prints.add(digest)
        self.keys.update(new)
        self.offset, self.collected = self.offset + len(rows), self.collected + len(new)
        known = self.total
        if stale and self.was_stale and known is not None and known > self.most:
            self.reason = "freshness_reached"
        elif known is not None and self.collected >= known:
            self.reason = "reported_total_reached"
        elif known is None and len(rows) < max(1, self.first_size):
            self.reason = "exhausted"
        elif self.collected >= self.most:
            self.reason = "budget_exhausted"
        elif self.pages >= MAX_PAGES:
            self.reason = "page_ceiling"
        self.was_stale = stale
        return new

    def row(self, source: str) -> tuple:
        reason = self.reason or "exhausted"
        short = max(0, (self.total or 0) - self.collected)
        lacking = short > max(1, int((self.total or 0) * SHORTFALL_SHARE))
        complete = reason in ("exhausted", "reported_total_reached") and not lacking
        return source, self.pages, self.offset, self.collected, self.total, "total_shortfall" if reason == "exhausted" and lacking else reason, complete, short, self.requests, self.waited


class Sources(InputPartition):
    """Runs of sources: (file, its bytes, its sources, the first one, how many)."""

    def __init__(self, runs: list[tuple[str, int, int, int, int]]):
        super().__init__(runs)


class RecordedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.items = options.get("emit", "walks") == "items"
        self.most, self.attempts = int(options.get("most", 8000)), int(options.get("attempts", 2))
        self.backoff, self.each = float(options.get("backoff", 1.0)), int(options.get("perpartition", 1))

    def partitions(self) -> list[Sources]:
        listed = _listed(*_open(self.path))
        sources = {f.path.removesuffix(STARTS): f.size // WIDTH for f in listed if f.path.endswith(STARTS)}
        out, held, room = [], [], self.each
        for f in listed:
            if f.base_name.startswith("source=") or (f.extension == "json" and f.path not in sources):
                raise ValueError(f"{f.path} does not tell where its sources begin; write the exchanges again")
            first, end = 0, sources.get(f.path, 0)
            while first < end:
                n = min(room, end - first)
                held.append((f.path, f.size, end, first, n))
                first, room = first + n, room - n
                if not room:
                    out.append(Sources(held))
                    held, room = [], self.each
        return [*out, *([Sources(held)] if held else [])] or [Sources([])]

    def _pages(self, lines: Iterator[bytes]) -> Iterator[list[dict]]:
        """The exchanges of each page of a source, read as they are asked for."""
        held: list[dict] = []
        for line in lines:
            e = json.loads(line)
            if held and held[0]["page_no"] != e["page_no"]:
                yield held
                held = []
            held.append(e)
        if held:
            yield held

    def read(self, partition: Sources) -> Iterator[tuple]:
        system, _ = _open(self.path)
        for file, size, sources, first, n in partition.value:
            with system.open_input_file(file + STARTS) as stream:
                stream.seek(first * WIDTH)
                starts = [*array("q", stream.read(min(n + 1, sources - first) * WIDTH)), size]
            with system.open_input_file(file) as stream:
                for at, end in zip(starts[:n], starts[1:]):
                    stream.seek(at)
                    walk, source = Walk(self.most, self.attempts, self.backoff), None
                    for exchanges in self._pages(_lines(stream, end - at)):
                        source = exchanges[0]["source"]
                        for key in walk.page(exchanges):
                            if self.items:
                                yield source, exchanges[0]["page_no"], key
                        if walk.reason:
                            break
                    if not self.items:
                        yield walk.row(source)


class Recorded(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recorded"

    def schema(self) -> str:
        return ITEMS if self.options.get("emit", "walks") == "items" else WALKS

    def reader(self, schema) -> RecordedReader:
        return RecordedReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Recorded)
