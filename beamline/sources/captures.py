"""Captures as a Spark data source of their own, ``spark.read.format("ts")``.

Every range of a file is one task and is read once. Where packets begin in a range
follows from what stands before it: a task looks back, 64 KiB first, and walks from
every place a packet could begin at there. Framing falls into step within a few packets,
so all walks enter the range at the same place and that is the real one; where they do
not, the task looks back further, to the file's begin if need be. The rows are those of
a search through the whole file byte by byte, whatever the ranges are.

Filters on ``pid`` and ``stream_id`` are taken by the reader: packets of other pids never
leave it, files of other streams are not opened. Bounds on ``at`` leave out ranges. Under
Structured Streaming the offset says, file by file, how far its places are decided.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from .transport import HEADER, RANGE_BYTES, SIZE, first_start, headers, packet_starts, read_joined, read_range, successors

#: Bytes behind a place that decide whether a packet begins there.
AHEAD = 3 * SIZE
LOOK_BACK = 64 << 10
ROWS = 20_000
SCHEMA = f"stream_id string, at long, {HEADER}, pkt binary"


@dataclass
class Range(InputPartition):
    """Places ``begin`` to ``stop`` of a file of which ``known`` bytes are there, or of
    ``parts``, files with their places and lengths, that follow each other."""

    path: str
    begin: int
    stop: int
    known: int
    parts: tuple[tuple[str, int, int], ...] = ()

    def bytes_from(self, begin: int, size: int) -> bytes:
        return read_joined(self.parts, begin, size) if self.parts else read_range(self.path, begin, size)


def listed(path: str) -> dict[str, int]:
    """Sizes of the files under ``path``, a file, a folder or a pattern
    in its last part; hidden files are left out, as Spark does."""
    from pyarrow import fs

    plain = path.removeprefix("file://").removeprefix("file:") if path.startswith("file:") else path
    folder, _, pattern = plain.rpartition("/")
    is_pattern = any(c in pattern for c in "*?[")
    where, name = fs.FileSystem.from_uri(folder if is_pattern else plain) if "://" in plain else (fs.LocalFileSystem(), folder if is_pattern else plain)
    head = plain[: plain.index("://")] + "://" if "://" in plain else "file:"
    info = where.get_file_info(name)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else [f for f in where.get_file_info(fs.FileSelector(name, recursive=not is_pattern)) if f.is_file]
    seen = [f for f in found if not any(part[:1] in "_." for part in f.path[len(name) :].split("/") if part)]
    return {head + f.path: f.size for f in seen if not is_pattern or fnmatch(f.base_name, pattern)}


def folders(sizes: dict[str, int]) -> dict[str, tuple[tuple[str, int, int], ...]]:
    """Files by folder, in order of their names, each with its place and length."""
    out: dict[str, tuple] = {}
    for path, size in sorted(sizes.items()):
        before = out.get(path[: path.rindex("/") + 1], ())
        out[path[: path.rindex("/") + 1]] = (*before, (path, sum(before[-1][1:]) if before else 0, size))
    return out


def ranges(path: str, begin: int, stop: int, known: int, size: int, parts: tuple = ()) -> list[Range]:
    return [Range(path, a, min(a + size, stop), known, parts) for a in range(begin, stop, size)]


def entrance(part: Range, trusted: bool, look_back: int = LOOK_BACK) -> tuple[int, bool]:
    """Where the search for packets enters a range, counted from its begin, and whether it
    comes right from a packet."""
    while part.begin > 0:
        start = max(0, part.begin - look_back)
        limit = part.begin - start
        buffer = np.frombuffer(part.bytes_from(start, min(limit + AHEAD, part.known - start)), np.uint8)
        at, valid = packet_starts(buffer, limit)
        after = successors(at, valid, trusted)
        ends = [0] * (len(at) + 1)
        for k in range(len(at) - 1, -1, -1):
            ends[k] = ends[after[k]] if after[k] < len(at) else int(at[k]) + SIZE
        states = [(0, True)] if start == 0 else [(0, False), *((d, True) for d in range(SIZE))]
        last = {ends[first_start(at, valid, d, follows and trusted)] for d, follows in states}
        leaves = {(max(end - limit, 0), trusted and end >= limit) for end in last}
        if len(leaves) == 1:
            return leaves.pop()
        look_back *= 8
    return 0, trusted


def packets(part: Range, trusted: bool, pids: np.ndarray | None, look_back: int = LOOK_BACK) -> Iterator[pa.RecordBatch]:
    """The packets of a range with their header columns, those of ``pids`` alone if given."""
    first, follows = entrance(part, trusted, look_back)
    limit = part.stop - part.begin
    buffer = np.frombuffer(part.bytes_from(part.begin, min(limit + AHEAD, part.known - part.begin)), np.uint8)
    at, valid = packet_starts(buffer, limit)
    after = successors(at, valid, trusted)
    k, found = first_start(at, valid, first, follows), []
    while k < len(at):
        found.append(k)
        k = after[k]
    own = at[found]
    if pids is not None:
        own = own[np.isin((buffer[own + 1].astype(int) & 0x1F) << 8 | buffer[own + 2], pids)]
    for a in range(0, len(own), ROWS):
        places = own[a : a + ROWS]
        raw = buffer[places[:, None] + np.arange(SIZE)]
        columns = headers(raw)
        arrays = [pa.array([part.path] * len(places)), pa.array(part.begin + places, pa.int64())]
        for field in HEADER.split(", "):
            name, kind = field.split()
            arrays.append(pa.array(columns[name], {"boolean": pa.bool_(), "int": pa.int32(), "long": pa.int64()}[kind], from_pandas=True))
        arrays.append(pa.array([row.tobytes() for row in raw], pa.binary()))
        yield pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in SCHEMA.split(", ")])


class Settings:
    """Options of the source: ``path``, ``trusted``, ``pids`` (a list with commas),
    ``range_bytes``, ``look_back``, ``joined`` (the files of a folder are one capture, in
    order of their names) and, for streams, ``complete``."""

    def __init__(self, options: dict[str, str]):
        if "path" not in options:
            raise ValueError("the source needs a path")
        self.path = options["path"]
        self.trusted = options.get("trusted", "false").lower() == "true"
        self.pids = {int(p) for p in options["pids"].split(",")} if options.get("pids") else None
        self.range_bytes = int(options.get("range_bytes", RANGE_BYTES))
        self.look_back = max(SIZE, int(options.get("look_back", LOOK_BACK)))
        self.joined = options.get("joined", "false").lower() == "true"
        self.complete = options.get("complete", "false").lower() == "true"

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        pids = None if self.pids is None else np.array(sorted(self.pids), int)
        return packets(part, self.trusted, pids, self.look_back)


class CaptureReader(DataSourceReader):
    def __init__(self, settings: Settings):
        self.settings, self.streams, self.low, self.high = settings, None, 0, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute in (("pid",), ("stream_id",)):
                values = {v for v in (f.value if isinstance(f, In) else [f.value]) if v is not None}
                name = "pids" if f.attribute == ("pid",) else "streams"
                owner = self.settings if name == "pids" else self
                before = getattr(owner, name)
                setattr(owner, name, values if before is None else before & values)
            else:
                if isinstance(f, GreaterThan | GreaterThanOrEqual) and f.attribute == ("at",):
                    self.low = max(self.low, f.value)
                if isinstance(f, LessThan | LessThanOrEqual) and f.attribute == ("at",):
                    self.high = f.value if self.high is None else min(self.high, f.value)
                yield f

    def partitions(self) -> list[Range]:
        out = []
        sizes = listed(self.settings.path)
        parts = folders(sizes) if self.settings.joined else {}
        for path, size in sorted({k: sum(v[-1][1:]) for k, v in parts.items()}.items() if parts else sizes.items()):
            if self.streams is None or path in self.streams:
                out += ranges(path, 0, size, size, self.settings.range_bytes, parts.get(path, ()))
        return [p for p in out if p.stop > self.low and (self.high is None or p.begin <= self.high)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return self.settings.read(partition)


class CaptureStream(DataSourceStreamReader):
    """Files that grow. An offset maps a file to ``[decided, known]``: its places below
    ``decided`` were decided with the sight of its first ``known`` bytes.

    The last three packets of a file wait for what follows them, so the rows are those of
    the file when it has ended. With ``complete`` files no longer grow and are read to
    their ends; one that grows or is cut all the same is an error."""

    def __init__(self, settings: Settings):
        self.settings = settings

    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self) -> dict:
        sizes = sorted(listed(self.settings.path).items())
        return {"files": {path: [size if self.settings.complete else max(0, size - AHEAD + 1), size] for path, size in sizes}}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for path, (decided, known) in sorted(end["files"].items()):
            begin, seen = start["files"].get(path, (0, 0))
            if known < seen or seen and begin == seen < known:
                raise ValueError(f"{path} had {seen} bytes when it was read and has {known} now")
            out += ranges(path, begin, decided, known, self.settings.range_bytes)
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return self.settings.read(partition)

    def commit(self, end: dict) -> None:
        pass


class CaptureSource(DataSource):
    """``stream_id`` (the file), ``at`` (a packet's place in it, the order of a stream), the
    header columns and the packet ``pkt``."""

    @classmethod
    def name(cls) -> str:
        return "ts"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CaptureReader:
        return CaptureReader(Settings(self.options))

    def streamReader(self, schema) -> CaptureStream:
        settings = Settings(self.options)
        if settings.joined:
            raise ValueError("files that grow are not joined")
        return CaptureStream(settings)


def register(spark: SparkSession) -> None:
    """Makes the format "ts" known to the session and lets it take filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CaptureSource)


def captures(spark: SparkSession, path: str, **options) -> DataFrame:
    """The packets of the captures under ``path`` with their headers."""
    register(spark)
    return spark.read.format("ts").options(**options).load(path)


def captures_live(spark: SparkSession, path: str, **options) -> DataFrame:
    """The same rows of captures that grow, as a stream."""
    register(spark)
    return spark.readStream.format("ts").options(**options).load(path)
