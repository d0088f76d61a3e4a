"""Transport stream captures: framing, packet headers, RTP datagrams.

A capture is a file of 188-byte packets, of any size: it is read in ranges, one task
each. Where packets begin in a range depends on where the last one before it ended, so
each range first tells where it would end for every place it may begin at; a fold over
the ranges of a file picks the real ones. Headers are decoded by numpy over many
packets at once.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.folds import fold

SIZE, SYNC = 188, 0x47
#: Bytes of a capture that one task reads.
RANGE_BYTES = 32 << 20

HEADER = (
    "valid boolean, tei boolean, pusi boolean, pid int, scrambling int, afc int, cc int, has_payload boolean, payload_offset int, "
    "discontinuity boolean, random_access boolean, pcr_base long, pcr27 long"
)


def headers(packets: np.ndarray) -> dict[str, np.ndarray]:
    """Header columns of packets of shape (n, 188), from their first 12 bytes."""
    p = packets[:, :12].astype(np.int64)
    afc = (p[:, 3] >> 4) & 3
    adaptation, payload = (afc & 2) > 0, (afc & 1) > 0
    length = np.where(adaptation, p[:, 4], 0)
    offset = np.where(adaptation, 5 + length, 4)
    flags = np.where(adaptation & (length > 0), p[:, 5], 0)
    has_pcr = (flags & 0x10) > 0
    fits = ~adaptation | (offset <= SIZE) & (payload | (offset == SIZE)) & (~payload | (offset != SIZE))
    valid = (p[:, 0] == SYNC) & (afc != 0) & fits & (~has_pcr | (length >= 7))
    base = (p[:, 6] << 25) | (p[:, 7] << 17) | (p[:, 8] << 9) | (p[:, 9] << 1) | (p[:, 10] >> 7)
    pcr = has_pcr & valid
    null = lambda values: pd.array(np.where(pcr, values, 0), "Int64")
    base_column, clock = null(base), null(base * 300 + (((p[:, 10] & 1) << 8) | p[:, 11]))
    base_column[~pcr] = clock[~pcr] = pd.NA
    return {
        "valid": valid, "tei": (p[:, 1] & 0x80) > 0, "pusi": (p[:, 1] & 0x40) > 0, "pid": ((p[:, 1] & 0x1F) << 8) | p[:, 2], "scrambling": p[:, 3] >> 6, "afc": afc, "cc": p[:, 3] & 15,
        "has_payload": payload, "payload_offset": offset, "discontinuity": (flags & 0x80) > 0, "random_access": (flags & 0x40) > 0, "pcr_base": base_column, "pcr27": clock,
    }


def parse_headers(packets: DataFrame, column: str = "pkt") -> DataFrame:
    """``packets`` with the header columns in place of the bytes. A packet that is
    not 188 bytes long is invalid."""
    rest = [f for f in packets.schema if f.name != column]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), HEADER])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            raw = [b if b is not None and len(b) == SIZE else bytes(SIZE) for b in pdf[column]]
            columns = headers(np.frombuffer(b"".join(raw), np.uint8).reshape(-1, SIZE))
            yield pd.concat([pdf.drop(columns=[column]).reset_index(drop=True), pd.DataFrame(columns)], axis=1)

    return packets.mapInPandas(run, schema)


def packet_starts(buffer: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Places below ``limit`` where a packet may begin: a sync byte with sync bytes one and
    two packets on, as far as whole packets are there; and which of them have a valid
    header."""
    at = np.flatnonzero(buffer[:limit] == SYNC)
    at = at[at + SIZE <= len(buffer)]
    for ahead in (SIZE, 2 * SIZE):
        there = at + ahead + SIZE <= len(buffer)
        at = at[~there | (buffer[np.where(there, at + ahead, 0)] == SYNC)]
    valid = np.concatenate([np.empty(0, bool), *(headers(buffer[part[:, None] + np.arange(12)])["valid"] for part in np.array_split(at, len(at) // 100_000 + 1))])
    return at, valid


def successors(at: np.ndarray, valid: np.ndarray, trusted: bool) -> list[int]:
    """For each place the number of the next packet's place (their number if there is
    none): the place right behind it, which ``trusted`` takes unseen, else the first one
    from there on with a valid header."""
    sound = np.flatnonzero(valid)
    behind = np.searchsorted(at, at + SIZE)
    after = np.append(sound, len(at))[np.searchsorted(at[sound], at + SIZE)]
    if trusted:
        direct = behind < len(at)
        direct[direct] = at[behind[direct]] == at[direct] + SIZE
        after[direct] = behind[direct]
    return after.tolist()


def first_start(at: np.ndarray, valid: np.ndarray, begin: int, follows: bool) -> int:
    """Number of the first packet from ``begin`` on; one that ``follows`` may be unseen."""
    k = int(np.searchsorted(at, begin))
    if follows and k < len(at) and at[k] == begin:
        return k
    rest = np.flatnonzero(valid[k:])
    return k + int(rest[0]) if len(rest) else len(at)


def frame(data: bytes, trusted: bool = False) -> np.ndarray:
    """Packets of a byte stream, shape (n, 188).

    A packet begins at a sync byte with sync bytes at the next two places, as far as the
    data go, and has a valid header; from there the next one is looked for byte by byte.
    ``trusted`` takes a packet right behind another without a look at its header."""
    buffer = np.frombuffer(data, np.uint8)
    at, valid = packet_starts(buffer, len(buffer))
    after, k, found = successors(at, valid, trusted), first_start(at, valid, 0, trusted), []
    while k < len(at):
        found.append(k)
        k = after[k]
    return buffer[at[found][:, None] + np.arange(SIZE)] if found else np.empty((0, SIZE), np.uint8)


def read_range(path: str, begin: int, size: int) -> bytes:
    """``size`` bytes of a file from ``begin`` on, fewer at its end."""
    from pyarrow import fs

    if "://" not in path:
        path = path.removeprefix("file:")
    where, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    with where.open_input_file(name) as f:
        f.seek(begin)
        return f.read(size)


def read_joined(parts: list[tuple[str, int, int]], begin: int, size: int) -> bytes:
    """Bytes of files that follow each other, each with its place and length."""
    spans = [(name, max(begin, start) - start, min(begin + size, start + length) - max(begin, start)) for name, start, length in parts]
    return b"".join(read_range(name, at, n) for name, at, n in spans if n > 0)


def read_captures(spark: SparkSession, path: str, pids: list[int] | None = None, trusted: bool = False, range_bytes: int = RANGE_BYTES, joined: bool = False) -> DataFrame:
    """``(stream_id, seq, at, pkt)`` of the captures under ``path``, one stream a
    file or, ``joined``, the files of a folder in order of their names, ``at`` being a
    packet's place in it; ``pids`` lets only these through before
    the packets leave the reader (F2). The result is that of ``frame`` over the whole
    file, whatever the ranges are."""
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    files = files.select(F.regexp_replace("path", "[^/]*$", "").alias("path") if joined else "path", F.col("path").alias("file"), "length")
    files = files.withColumn("start", F.sum("length").over(W.partitionBy("path").orderBy("file")) - F.col("length"))
    streams = files.groupBy("path").agg(F.sum("length").alias("length"), F.sort_array(F.collect_list(F.struct("start", "length", "file"))).alias("parts"))
    ranges = streams.select("path", "parts", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long"))).alias("begin"))
    own = F.filter("parts", lambda p: (p["start"] < F.col("begin") + range_bytes + 3 * SIZE) & (p["start"] + p["length"] > F.col("begin")))
    ranges = ranges.select("path", "begin", F.array_join(F.transform(own, lambda p: F.concat_ws(" ", p["start"], p["length"], p["file"])), "\n").alias("parts"))
    ranges = ranges.repartition("path", "begin")
    keys = [(d, follows) for d in range(SIZE) for follows in (False, True)]

    def load(parts: str, begin: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
        files = [(name, int(start), int(length)) for start, length, name in (p.split(" ", 2) for p in parts.split("\n"))]
        buffer = np.frombuffer(read_joined(files, begin, range_bytes + 3 * SIZE), np.uint8)
        at, valid = packet_starts(buffer, range_bytes)
        return buffer, at, valid, successors(at, valid, trusted)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for name, begin, parts in zip(pdf["path"], pdf["begin"], pdf["parts"]):
                _, at, valid, after = load(parts, begin)
                # from each place: how many packets, and where the last one ends
                counts, ends = [0] * (len(at) + 1), [0] * (len(at) + 1)
                for k in range(len(at) - 1, -1, -1):
                    counts[k] = counts[after[k]] + 1
                    ends[k] = ends[after[k]] if after[k] < len(at) else int(at[k]) + SIZE
                firsts = [first_start(at, valid, d, follows and trusted) for d, follows in keys]
                # beyond the range a packet may go on; else the search does, from the range's end
                leaves = [(ends[k] - range_bytes, True) if ends[k] >= range_bytes else (0, False) for k in firsts]
                rows.append((name, begin, parts, [counts[k] for k in firsts], [d for d, _ in leaves], [f for _, f in leaves]))
            yield pd.DataFrame(rows, columns=["path", "begin", "parts", "counts", "leaves", "follows"])

    def enter(state: dict, row) -> list[tuple]:
        k = keys.index((state.get("at", 0), state.get("follows", True)))
        out = (row.begin, row.parts, state.get("at", 0), state.get("follows", True), state.get("seq", 0))
        state.update(at=row.leaves[k], follows=row.follows[k], seq=state.get("seq", 0) + row.counts[k])
        return [out]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, begin, parts, first, follows, seq in zip(pdf["path"], pdf["begin"], pdf["parts"], pdf["first"], pdf["follows"], pdf["seq"]):
                buffer, at, valid, after = load(parts, begin)
                k, found = first_start(at, valid, first, follows and trusted), []
                while k < len(at):
                    found.append(k)
                    k = after[k]
                for a in range(0, len(found), 50_000):
                    own = at[found[a : a + 50_000]]
                    numbers = seq + a + np.arange(len(own))
                    if pids is not None:
                        keep = np.isin((buffer[own + 1].astype(int) & 0x1F) << 8 | buffer[own + 2], pids)
                        own, numbers = own[keep], numbers[keep]
                    yield pd.DataFrame({"stream_id": name, "seq": numbers, "at": begin + own, "pkt": [r.tobytes() for r in buffer[own[:, None] + np.arange(SIZE)]]})

    found = ranges.mapInPandas(scan, "path string, begin long, parts string, counts array<long>, leaves array<int>, follows array<boolean>")
    entered = fold(found, "path", ["begin"], enter, "begin long, parts string, first int, follows boolean, seq long")
    return entered.repartition("path", "begin").mapInPandas(read, "stream_id string, seq long, at long, pkt binary")


def _octet(column: Column, at: int) -> Column:
    return F.conv(F.hex(F.substring(column, at + 1, 1)), 16, 10).cast("int")


def write_captures(packets: DataFrame, path: str, part_packets: int = 200_000) -> DataFrame:
    """K6, K7: ``packets(stream_id, seq, pkt)`` as files of packets in order, and what was
    written: ``(stream_id, part, packets, file)``.

    A stream is a folder of parts, each of at most ``part_packets`` packets by their place
    in the stream; their names in order give the stream. A part is written under
    another name and then moved, so a repeated task leaves one file."""
    place = W.partitionBy("stream_id").orderBy("seq")
    rows = packets.withColumn("part", F.floor((F.row_number().over(place) - 1) / part_packets).cast("int"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        where, base = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        open_part, n, out = None, 0, None

        def close() -> pd.DataFrame:
            out.close()
            stream, part = open_part
            name = f"{base}/stream_id={stream}/part-{part:08d}.ts"
            where.move(temporary, name)
            return pd.DataFrame({"stream_id": [stream], "part": [part], "packets": [n], "file": [name]})

        for pdf in batches:
            for key, own in pdf.groupby(["stream_id", "part"], sort=False, dropna=False):
                if key != open_part:
                    if out is not None:
                        yield close()
                    open_part, n = key, 0
                    where.create_dir(f"{base}/stream_id={key[0]}", recursive=True)
                    temporary = f"{base}/stream_id={key[0]}/_{uuid.uuid4().hex}"
                    out = where.open_output_stream(temporary)
                out.write(b"".join(own["pkt"]))
                n += len(own)
        if out is not None:
            yield close()

    dealt = rows.select(F.col("stream_id").cast("string").alias("stream_id"), "part", "seq", "pkt").repartition("stream_id", "part").sortWithinPartitions("stream_id", "part", "seq")
    return dealt.mapInPandas(run, "stream_id string, part int, packets long, file string")


def rtp(datagrams: DataFrame) -> DataFrame:
    """Version, sequence, time and payload of RTP datagrams ``(datagram)``; rows
    that are not RTP version 2, or too short, are marked invalid."""
    d = F.col("datagram")
    first = _octet(d, 0)
    size = F.octet_length(d)
    csrc = first.bitwiseAND(F.lit(15))
    head = F.lit(12) + 4 * csrc
    extended = first.bitwiseAND(F.lit(16)) > 0
    word = lambda at, n: F.conv(F.hex(F.substring(d, at + 1, F.lit(n))), 16, 10).cast("long")
    more = F.when(extended, 4 + 4 * word(head + 2, 2)).otherwise(0)
    padding = F.when(first.bitwiseAND(F.lit(32)) > 0, word(size - 1, 1)).otherwise(0)
    rows = datagrams.withColumn("_o", (head + F.coalesce(more, F.lit(0))).cast("int")).withColumn("_p", F.coalesce(padding, F.lit(0)).cast("int"))
    valid = F.coalesce((size >= 12) & (F.shiftright(first, 6) == 2) & (F.col("_o") + F.col("_p") <= size), F.lit(False))
    return rows.withColumn("valid", valid).withColumns({"sequence": F.when(valid, word(F.lit(2), 2)), "timestamp": F.when(valid, word(F.lit(4), 4)), "payload": F.when(valid, F.substring(d, F.col("_o") + 1, size - F.col("_o") - F.col("_p")))}).drop("_o", "_p")


def pes_pts(packets: DataFrame, strict: bool = True, column: str = "pkt") -> DataFrame:
    """``pts`` of packets that begin a PES packet; ``strict`` wants the marker
    bits and a clear packet, too. Needs the header columns."""
    o = F.col("payload_offset")
    b = lambda k: F.conv(F.hex(F.substring(F.col(column), o + 1 + k, F.lit(1))), 16, 10).cast("long")
    value = F.shiftleft(F.shiftright(b(9), 1).bitwiseAND(F.lit(7)), 30).bitwiseOR(F.shiftleft(b(10), 22)).bitwiseOR(F.shiftleft(F.shiftright(b(11), 1), 15)).bitwiseOR(F.shiftleft(b(12), 7)).bitwiseOR(F.shiftright(b(13), 1))
    ok = F.col("valid") & F.col("pusi") & F.col("has_payload") & (o + 14 <= SIZE) & (F.hex(F.substring(F.col(column), o + 1, F.lit(3))) == "000001") & (b(7).bitwiseAND(F.lit(0x80)) > 0)
    if strict:
        marked = (b(9).bitwiseAND(F.lit(1)) + b(11).bitwiseAND(F.lit(1)) + b(13).bitwiseAND(F.lit(1))) == 3
        ok = ok & (F.col("scrambling") == 0) & (b(8) >= 5) & F.shiftright(b(9), 4).isin(2, 3) & marked
    return packets.withColumn("pts", F.when(ok, value))


def remap(packets: DataFrame, pid_map: DataFrame, column: str = "pkt") -> DataFrame:
    """Packets of the mapped pids under their new pids. ``pid_map(stream_id,
    pid, new_pid)``; a service's map is a handful of rows."""
    rows = packets.join(pid_map, ["stream_id", "pid"])
    second = _octet(F.col(column), 1).bitwiseAND(F.lit(0xE0)).bitwiseOR(F.shiftright("new_pid", 8))
    head = F.unhex(F.format_string("%02X%02X", second, F.col("new_pid").bitwiseAND(F.lit(255))))
    return rows.withColumn(column, F.concat(F.substring(F.col(column), 1, 1), head, F.substring(F.col(column), 4, 185))).withColumn("pid", F.col("new_pid")).drop("new_pid")
