"""Python data sources for paged document and comment lists, with fixtures in place of the network."""

from __future__ import annotations

import bisect
import calendar
import heapq
import itertools
import tempfile
import threading
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader


class MonthPartition(InputPartition):
    def __init__(self, year: int, month: int):
        super().__init__((year, month))
        self.year, self.month = year, month


class DocumentListReader(DataSourceReader):
    """One partition per month; each reads its days and re-checks that a record belongs to its day."""

    def __init__(self, options: dict):
        self.path, self.year = options["path"], int(options["year"])

    def partitions(self) -> list[InputPartition]:
        return [MonthPartition(self.year, m) for m in range(1, 13)]

    def read(self, partition: MonthPartition) -> Iterator[tuple]:
        import pyarrow.compute as pc
        import pyarrow.dataset as ds

        low, high = f"{partition.year}-{partition.month:02d}-01", f"{partition.year}-{partition.month:02d}-{calendar.monthrange(partition.year, partition.month)[1]:02d}"
        wanted = (pc.field("publication_date") >= low) & (pc.field("publication_date") <= high)
        for batch in ds.dataset(self.path).to_batches(columns=["document_number", "title", "publication_date", "agency"], filter=wanted):
            for row in batch.to_pylist():
                if len(row["publication_date"]) == 10:
                    yield row["document_number"], row["title"], row["publication_date"], row["agency"]


class DocumentList(DataSource):
    """``spark.read.format("docket_documents").option("path", ...).option("year", 2020)``."""

    @classmethod
    def name(cls) -> str:
        return "docket_documents"

    def schema(self) -> str:
        return "document_number string, title string, publication_date string, agency string"

    def reader(self, schema) -> DocumentListReader:
        return DocumentListReader(self.options)


class CommentCursor(SimpleDataSourceStreamReader):
    """Pages of a comment list in order of (posted_date, comment_id, document_number), NULLs first.

    The offset is the last such row read, so that a page may end anywhere within a
    date or an id: nothing is lost and nothing comes twice.  The list is read once, into
    sorted runs on disk, and the pages follow from merging them; it is read again only
    when a file of it has changed or the cursor was moved.  Held in memory are one run
    while the list is read, later ``pages`` pages (what a micro-batch takes) and a few
    rows of each run.
    """

    #: Rows sorted at once, and rows of each run that are held while runs are merged.
    RUN, HELD = 1_000_000, 4096
    COLUMNS = ("posted_date", "comment_id", "document_number")

    def __init__(self, options: dict):
        self.path, self.page, self.pages = options["path"], int(options.get("page", "250")), int(options.get("pages", "1"))
        self._forget()

    def _forget(self) -> None:
        self._folder = self._rows = self._at = self._files = None

    def __getstate__(self) -> dict:
        return {"path": self.path, "page": self.page, "pages": self.pages}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self._forget()

    def initialOffset(self) -> dict:
        return {"after": None}

    @staticmethod
    def _key(row: tuple) -> tuple:
        return tuple((value is not None, value or "") for value in row)

    def _dataset(self):
        import pyarrow.dataset as ds

        return ds.dataset(self.path)

    def _stamp(self, dataset) -> list[tuple]:
        return [(i.path, i.size, i.mtime_ns) for i in dataset.filesystem.get_file_info(sorted(dataset.files))]

    def _run(self, batches: list, after: tuple | None):
        """The distinct rows of some batches that stand after a key, in order."""
        import pyarrow as pa
        import pyarrow.compute as pc

        table = pa.Table.from_batches(batches)
        table = table.filter(pc.greater(pc.binary_length(table["comment_id"]), 0)).group_by(list(self.COLUMNS)).aggregate([]).select(list(self.COLUMNS))
        table = table.take(pc.sort_indices(table, sort_keys=[(c, "ascending") for c in self.COLUMNS], null_placement="at_start")).combine_chunks()
        if after is None:
            return table
        return table.slice(bisect.bisect_right(range(table.num_rows), after, key=lambda i: self._key(tuple(table[c][i].as_py() for c in self.COLUMNS))))

    def _stored(self, name: str) -> Iterator[tuple]:
        import pyarrow as pa

        with pa.OSFile(name, "rb") as file, pa.ipc.open_file(file) as run:
            for i in range(run.num_record_batches):
                yield from zip(*(column.to_pylist() for column in run.get_batch(i).columns))

    def _after(self, dataset, after: tuple | None) -> Iterator[tuple]:
        """All distinct rows after a key, in order."""
        import pyarrow as pa

        self._folder, names, held, n = tempfile.TemporaryDirectory(prefix="docketlens-cursor-"), [], [], 0

        def put() -> None:
            table = self._run(held, after)
            names.append(f"{self._folder.name}/{len(names)}.arrow")
            with pa.OSFile(names[-1], "wb") as file, pa.ipc.new_file(file, table.schema) as run:
                run.write_table(table, max_chunksize=self.HELD)

        for batch in dataset.to_batches(columns=list(self.COLUMNS)):
            held.append(batch)
            n += batch.num_rows
            if n >= self.RUN:
                put()
                held, n = [], 0
        if held:
            put()
        return self._merged(names)

    def _merged(self, names: list[str]) -> Iterator[tuple]:
        last = None
        for row in heapq.merge(*map(self._stored, names), key=self._key) if len(names) > 1 else self._stored(names[0]) if names else ():
            if row != last:
                yield row
            last = row

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        after, dataset = start["after"] and tuple(start["after"]), self._dataset()
        files = self._stamp(dataset)
        if self._rows is None or self._at != after or self._files != files:
            self._rows, self._files = self._after(dataset, after and self._key(after)), files
        rows = list(itertools.islice(self._rows, self.page * self.pages))
        self._at = rows[-1] if rows else after
        return iter([(r[1], r[0], r[2]) for r in rows]), {"after": list(rows[-1])} if rows else start

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        if not end["after"]:
            return iter([])
        low, high = self._key(start["after"]) if start["after"] else None, self._key(end["after"])
        found: set[tuple] = set()
        for batch in self._dataset().to_batches(columns=list(self.COLUMNS)):
            found.update(r for r in zip(*(column.to_pylist() for column in batch.columns)) if r[1] and (low is None or self._key(r) > low) and self._key(r) <= high)
        return iter([(r[1], r[0], r[2]) for r in sorted(found, key=self._key)])


class CommentList(DataSource):
    """``spark.readStream.format("docket_comments").option("path", ...).option("page", 250).option("pages", 40)``."""

    @classmethod
    def name(cls) -> str:
        return "docket_comments"

    def schema(self) -> str:
        return "comment_id string, posted_date string, document_number string"

    def simpleStreamReader(self, schema) -> CommentCursor:
        return CommentCursor(self.options)


def register(spark) -> None:
    """Make both sources known to the session; their classes travel with the plan, as readers also run where this package is not installed."""
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(DocumentList)
    spark.dataSource.register(CommentList)


def parse_keys(spec: str | None, default_first: int = 1000, default_other: int = 5000) -> list[tuple[str, int]]:
    """``KEY:RPH,KEY2`` as (key, requests per hour); a key without a number takes the default of its place."""
    out = []
    for i, part in enumerate(p.strip() for p in (spec or "").split(",")):
        if part:
            key, _, rate = part.partition(":")
            out.append((key.strip(), int(rate) if rate.strip().isdigit() else default_first if i == 0 else default_other))
    return out


@dataclass
class _Key:
    name: str
    per_minute: float
    per_hour: int
    next_at: float = 0.0
    hour_from: float = 0.0
    used: int = 0
    disabled: bool = False
    blocked_until: float = 0.0


@dataclass
class KeyLimiter:
    """Chooses the key that may send soonest; honours hourly windows, Retry-After (1 to 120 s), slows by a tenth after 429 and drops keys on 401 and 403."""

    keys: list[tuple[str, int]]
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    _keys: list[_Key] = field(init=False)
    _lock: threading.Lock = field(default_factory=threading.Lock, init=False)

    def __post_init__(self) -> None:
        self._keys = [_Key(name, max(1.0, rph / 60), rph) for name, rph in self.keys]

    def acquire(self) -> str:
        while True:
            with self._lock:
                now = self.clock()
                ready = []
                for k in self._keys:
                    if k.disabled:
                        continue
                    if now - k.hour_from >= 3600:
                        k.hour_from, k.used = now, 0
                    at = max(k.next_at, k.blocked_until, k.hour_from + 3600 if k.used >= k.per_hour else 0.0)
                    ready.append((at, k.name, k))
                if not ready:
                    raise RuntimeError("every key is disabled")
                at, _, key = min(ready, key=lambda r: (r[0], r[1]))
                if at <= now:
                    key.next_at, key.used = now + 60 / key.per_minute, key.used + 1
                    return key.name
                wait = at - now
            self.sleep(wait)

    def report(self, name: str, status: int, retry_after: float | None = None) -> None:
        """Tell the limiter how a request ended."""
        with self._lock:
            key = next(k for k in self._keys if k.name == name)
            if status in (401, 403):
                key.disabled = True
            elif status == 429:
                key.per_minute = max(1.0, key.per_minute * 0.9)
                key.blocked_until = self.clock() + min(120.0, max(1.0, retry_after or 1.0))


def memo_lookup(df, key: str, lookup: Callable[[str], dict | None], schema: str):
    """Rows with the fields a lookup gives for their key: each distinct key is looked up once; unknown keys give NULLs.

    ``schema`` lists the fields the lookup returns, without the key.
    """
    import pandas as pd
    from pyspark.sql import functions as F

    names = [part.split()[0] for part in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [lookup(k) or {} for k in batch["_key"]]
            yield pd.DataFrame({"_key": batch["_key"], **{n: [f.get(n) for f in found] for n in names}})

    keys = df.where(F.col(key).isNotNull()).select(F.col(key).alias("_key")).distinct()
    known = keys.mapInPandas(run, f"_key string, {schema}")
    return df.join(known, df[key] == known["_key"], "left").drop("_key")


def extract_pdf_text(files, extractor: Callable[[bytes], str | None] | None = None, max_pages: int = 2):
    """(path, text) of binary files that begin like a PDF; without an extractor the text is NULL.  HTML answers are rejected."""
    import pandas as pd

    def text(b) -> str | None:
        return extractor(bytes(b)) if extractor and b is not None and bytes(b[:5]).startswith(b"%PDF") else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"path": batch["path"], "text": [text(b) for b in batch["content"]], "max_pages": max_pages})

    return files.select("path", "content").mapInPandas(run, "path string, text string, max_pages int")
