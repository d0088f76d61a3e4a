"""Streams within streams: PES units of a pid, and packets carried by T2-MI.

PES units are windows over runs of a pid and one aggregation; T2-MI cuts a pid into runs
that begin with a unit, and streams each through a task with what is unfinished at hand.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.packets import octet, payloads
from ..operators.folds import fold, service_ids
from ..operators.scans import dealt
from .scratch import written
from .sections import crc32_mpeg

#: First bytes of NAL units that begin a picture without references: type 5 in the low
#: five bits (H.264), types 16 to 21 in the bits 1 to 6 (HEVC).
RANDOM_ACCESS = {"h264": [b for b in range(256) if b & 0x1F == 5], "hevc": [b for b in range(256) if 16 <= b >> 1 & 0x3F <= 21]}
LARGEST_UNIT = 8202
SILENCE_MS = 15_000
#: Packets of a stream in whose order a T2-MI pid, or a pid of PES units, has one range.
CARRIED, UNITS = 200_000, 200_000


def by_run(packets: DataFrame, start: Callable[[object], object], out: str) -> DataFrame:
    """Rows of ``start(row)``'s ``feed(row)`` for each packet of a (stream_id, pid, run), and
    of its ``close()`` after the last; ``row`` is the first packet."""
    names = ["stream_id", "pid", "run", *(x.split()[0] for x in out.split(","))]
    stream = packets.schema["stream_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, own = None, None
        for pdf in batches:
            rows = []
            for row in pdf.itertuples(index=False):
                key = (row.stream_id, row.pid, row.run)
                if key != last:
                    rows += [last + r for r in own.close()] if own else []
                    last, own = key, start(row)
                rows += [key + r for r in own.feed(row)]
            yield pd.DataFrame(rows, columns=names).astype(object)
        if own:
            yield pd.DataFrame([last + r for r in own.close()], columns=names).astype(object)

    return packets.sortWithinPartitions("stream_id", "pid", "run", "seq").mapInPandas(run, f"stream_id {stream}, pid int, run long, {out}")


def in_runs(packets: DataFrame, span: int) -> DataFrame:
    """``packets(stream_id, pid, seq, pkt)`` with ``run``, the range of ``span`` packets in
    whose order a pid's unit begins: a run goes from its first start of a unit to that of
    the next one. That start is in both, in the one that it ends with ``ends``. What comes
    before a pid's first start is left out. Of a range of packets one row is folded."""
    rows = payloads(packets.select("stream_id", "pid", "seq", "pkt"))
    starts = F.col("start") & ~F.col("tei") & (octet("data", 0) < F.octet_length("data"))
    rows = rows.where(F.col("tei") | F.col("data").isNotNull()).withColumns({"_range": F.floor(F.col("seq") / F.lit(span)), "_start": F.coalesce(starts, F.lit(False))})
    own = W.partitionBy("stream_id", "pid").orderBy("_range")
    first = rows.groupBy("stream_id", "pid", "_range").agg(F.min(F.when(F.col("_start"), F.col("seq"))).alias("_first"))
    first = first.withColumn("_before", F.last(F.when(F.col("_first").isNotNull(), F.col("_range")), True).over(own.rowsBetween(W.unboundedPreceding, -1)))
    rows = rows.withColumn("_k", F.struct("stream_id", "pid", "_range")).join(F.broadcast(first.select(F.struct("stream_id", "pid", "_range").alias("_k"), "_first", "_before")), "_k")
    mine = F.struct(F.col("_range").alias("run"), F.lit(False).alias("ends"))
    other = F.struct(F.col("_before").alias("run"), (F.coalesce(F.col("seq") == F.col("_first"), F.lit(False))).alias("ends"))
    late = F.coalesce(F.col("seq") >= F.col("_first"), F.lit(False))
    runs = F.when(F.col("seq") == F.col("_first"), F.array(other, mine)).when(late, F.array(mine)).otherwise(F.array(other))
    return rows.select("stream_id", "pid", "seq", "pkt", F.explode(runs).alias("_r")).select("stream_id", "pid", "seq", "pkt", "_r.*").where("run is not null")


def payload(packet: bytes) -> tuple[bytes, bool, bool]:
    """Payload of a packet, and its discontinuity and random-access flags."""
    afc = packet[3] >> 4 & 3
    if afc < 2:
        return (packet[4:] if afc else b""), False, False
    flags = packet[5] if packet[4] else 0
    return (packet[5 + packet[4] :] if afc == 3 else b""), bool(flags & 0x80), bool(flags & 0x40)


def clock33(at: Column) -> Column:
    """The 33 bits of a timestamp from place ``at`` (from 1) of ``head``."""
    b = lambda k: F.conv(F.hex(F.substring("head", at + k, F.lit(1))), 16, 10).cast("long")
    parts = [(F.shiftright(b(0), 1).bitwiseAND(F.lit(7)), 30), (b(1), 22), (F.shiftright(b(2), 1), 15), (b(3), 7), (F.shiftright(b(4), 1), 0)]
    return sum((F.shiftleft(v, n) for v, n in parts[1:]), F.shiftleft(*parts[0]))


def by_start(rows: DataFrame, span: int) -> DataFrame:
    """``rows(stream_id, pid, seq, start, ...)`` with ``run``, the range of ``span`` packets
    in whose order the unit of a row begins, dealt out by it. What comes before a pid's first
    start is left out. Of a range of packets one row is folded."""
    rows = rows.withColumn("_k", F.struct("stream_id", "pid", F.floor(F.col("seq") / F.lit(span)).alias("_range")))
    own = W.partitionBy("_k.stream_id", "_k.pid").orderBy("_k._range").rowsBetween(W.unboundedPreceding, -1)
    first = rows.groupBy("_k").agg(F.min(F.when(F.col("start"), F.col("seq"))).alias("_first"))
    first = first.withColumn("_before", F.last(F.when(F.col("_first").isNotNull(), F.col("_k._range")), True).over(own))
    rows = rows.join(F.broadcast(first), "_k").withColumn("run", F.when(F.col("seq") >= F.col("_first"), F.col("_k._range")).otherwise(F.col("_before")))
    return dealt(rows.where("run is not null").drop("_k", "_first", "_before"), "stream_id", "pid", "run")


def pes_units(packets: DataFrame, span: int = UNITS) -> DataFrame:
    """PES units of ``packets(stream_id, pid, seq, pkt, codec)``. A declared length
    trims what is stuffed behind it, a shorter unit is dropped, and the decoding time is
    the presentation time where it is absent.

    A unit is what lies between two starts; a pid is cut into runs of units, a unit's
    payloads are joined by one aggregation over the window's partitions, and its fields are
    column expressions."""
    own = W.partitionBy("stream_id", "pid", "run").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    rows = payloads(packets.select("stream_id", "pid", "seq", "pkt", "codec"))
    hint = (F.col("afc") >= 2) & (octet("pkt", 4) > 0) & (octet("pkt", 5).bitwiseAND(F.lit(0x40)) > 0)
    rows = by_start(rows.select("stream_id", "pid", "seq", "codec", "start", hint.alias("hint"), F.coalesce("data", F.lit(b"")).alias("data")), span)
    rows = rows.withColumn("unit", F.sum(F.col("start").cast("long")).over(own))
    units = rows.groupBy("stream_id", "pid", "run", "unit").agg(
        F.min("seq").alias("seq"), F.min_by("hint", "seq").alias("hint"), F.min_by("codec", "seq").alias("codec"), F.expr("listagg(data) within group (order by seq)").alias("unit_data"))
    units = units.withColumns({"head": F.substring("unit_data", 1, 19), "whole": F.octet_length("unit_data")}).where((F.col("whole") >= 9) & (F.hex(F.substring("head", 1, 3)) == "000001"))
    length = F.conv(F.hex(F.substring("head", 5, 2)), 16, 10).cast("int")
    units = units.withColumns({"flags": octet("head", 7), "more": octet("head", 8), "end": F.when(length > 0, length + 6).otherwise(F.col("whole"))}).withColumn("begin", F.col("more") + 9)
    units = units.where("begin < end and end <= whole").withColumn("data", F.substring("unit_data", F.col("begin") + 1, F.col("end") - F.col("begin")))
    pts = F.when((F.col("flags") >= 0x80) & (F.col("more") >= 5), clock33(F.lit(10)))
    dts = F.when((F.col("flags").bitwiseAND(F.lit(0x40)) > 0) & (F.col("more") >= 10), clock33(F.lit(15))).otherwise(pts)
    begins = F.lit(False)
    for name, kinds in RANDOM_ACCESS.items():
        begins |= (F.col("codec") == name) & F.decode("data", "ISO-8859-1").rlike("\\x00\\x00\\x01[" + "".join(f"\\x{b:02x}" for b in kinds) + "]")
    return units.select("stream_id", F.col("pid").cast("int").alias("pid"), "seq", octet("head", 3).alias("pes_stream_id"), pts.alias("pts"), dts.alias("dts"), F.octet_length("data").cast("long").alias("size"), (F.col("hint") | F.coalesce(begins, F.lit(False))).alias("random_access"), "data")


class Carrier:
    """Inner packets of one T2-MI pid and one physical-layer pipe (the first, if none is
    named)."""

    def __init__(self, pipe: int | None = None):
        self.wanted, self.pipe = pipe, pipe
        self.count, self.held, self.partial, self.aligned = None, b"", b"", False

    def lose(self) -> None:
        self.held, self.partial, self.aligned, self.count = b"", b"", False, None
        self.pipe = self.wanted

    def close(self) -> list[tuple]:
        return []

    def feed(self, row) -> list[tuple]:
        packet = row.pkt
        if packet[1] & 0x80:
            self.lose()
            return []
        data, broken, _ = payload(packet)
        if not data:
            return []
        if self.count is not None and not broken and packet[3] & 15 != (self.count + 1) % 16:
            self.lose()
        self.count = packet[3] & 15
        if broken:
            self.held, self.partial, self.aligned = b"", b"", False
        found = []
        if packet[1] & 0x40:
            pointer, data = data[0], data[1:]
            if pointer > len(data):
                self.lose()
                return []
            if self.aligned:
                found += self.frames(data[:pointer])
            data, self.held, self.aligned = data[pointer:], b"", True
            if getattr(row, "ends", False):
                data = b""
        if self.aligned:
            found += self.frames(data)
        return [(row.seq, plp, p) for plp, p in found]

    def frames(self, data: bytes) -> list[tuple[int, bytes]]:
        """Inner packets of the T2-MI packets that the data complete."""
        self.held += data
        out = []
        while len(self.held) >= 6:
            size = ((self.held[4] << 8 | self.held[5]) + 7) // 8
            total = 6 + size + 4
            if total > LARGEST_UNIT:
                self.held, self.aligned = b"", False
                break
            if len(self.held) < total:
                break
            unit, self.held = self.held[:total], self.held[total:]
            if crc32_mpeg(unit):
                self.partial = b""
            elif unit[0] == 0 and size >= 13:
                out += self.baseband(unit[6 : 6 + size])
        return out

    def baseband(self, frame: bytes) -> list[tuple[int, bytes]]:
        """Packets of a baseband frame: whole ones, and one that began in the last frame.
        High-efficiency mode leaves out the sync byte."""
        plp, head, field = frame[1], frame[3:13], frame[13:]
        self.pipe = plp if self.pipe is None else self.pipe
        if plp != self.pipe:
            return []
        short = head[2:4] == b"\0\0" and head[6] == 0
        bits, sync = head[4] << 8 | head[5], head[7] << 8 | head[8]
        plain = head[0] >> 6 == 3 and not head[0] & 0x0C and (short or head[2:4] == b"\x05\xe0" and head[6] == 0x47)
        if not plain or bits & 7 or sync != 0xFFFF and sync & 7 or bits // 8 > len(field):
            self.partial = b""
            return []
        field, size = field[: bits // 8], 187 if short else 188
        first = len(field) if sync == 0xFFFF else min(sync // 8, len(field))
        whole = []
        if self.partial is None:
            self.heads.append((field[:first], size, sync == 0xFFFF))
            if sync == 0xFFFF:
                return []
        elif self.partial:
            joined = self.partial + field[:first]
            if len(joined) == size:
                whole, self.partial = [joined], b""
            elif sync == 0xFFFF and len(joined) < size:
                self.partial = joined
                return []
            else:
                self.partial = b""
        if sync != 0xFFFF:
            whole += [field[p : p + size] for p in range(first, len(field) - size + 1, size)]
            self.partial = field[first + (len(field) - first) // size * size :]
        packets = [b"\x47" + (w if short else w[1:]) for w in whole]
        return [(plp, p) for p in packets if (p[1] & 0x1F) << 8 | p[2] != 0x1FFF]


class Census(Carrier):
    """Which pipe a run goes on with: the first one before it loses the stream, whether it
    does, and the one since."""

    def __init__(self, pipe: int | None = None):
        super().__init__(pipe)
        self.lost, self.first = False, None

    def lose(self) -> None:
        if not self.lost:
            self.lost, self.first = True, self.pipe
        super().lose()

    def baseband(self, frame: bytes) -> list:
        self.pipe = frame[1] if self.pipe is None else self.pipe
        return []

    def close(self) -> list[tuple]:
        return [(self.first, True, self.pipe) if self.lost else (self.pipe, False, None)]


class Run(Carrier):
    """A run's inner packets; ``seam`` 0. What its first frames add to a packet that began
    before it has ``seam`` 1, and what it leaves unfinished 2."""

    def __init__(self, wanted: int | None, pipe: int | None):
        super().__init__(wanted)
        self.pipe, self.partial, self.heads, self.place = pipe if wanted is None else wanted, None, [], 0

    def feed(self, row) -> list[tuple]:
        found = [(seq, plp, p, 0, None, None, None) for seq, plp, p in super().feed(row)]
        for piece, size, alone in self.heads:
            found.append((row.seq, self.pipe, piece, 1, size, alone, self.place))
            self.place += 1
        self.heads = []
        return found

    def close(self) -> list[tuple]:
        return [] if self.partial is None else [(None, None, self.partial, 2, None, None, None)]


def seamed(seams: DataFrame) -> DataFrame:
    """Inner packets that began in one run and end in another; few rows a run."""
    key = F.to_json(F.struct("stream_id", "pid"))

    def step(state, row):
        held = state.get("held", b"")
        if row.seam == 2:
            state["held"] = row.pkt
            return []
        joined = held + row.pkt if held else b""
        state["held"] = joined if row.alone and len(joined) < row.size else b""
        packet = b"\x47" + (joined if row.size == 187 else joined[1:])
        return [(row.run, row.seq, row.plp, packet)] if len(joined) == row.size and (packet[1] & 0x1F) << 8 | packet[2] != 0x1FFF else []

    rows = seams.select(key.alias("of"), "run", "seam", "seq", "plp", "pkt", "size", "alone", "place")
    names = seams.select(key.alias("of"), "stream_id", "pid").distinct()
    return fold(rows, "of", ["run", "seam", "place"], step, "run long, seq long, plp int, pkt binary").join(names, "of").drop("of")


def t2mi_packets(packets: DataFrame, pid: int, pipe: int | None = None, span: int = CARRIED) -> DataFrame:
    """``(stream_id, pid, seq, plp, pkt)`` of the packets inside the T2-MI ``pid``;
    ``seq`` is the outer packet that completes one.

    A pid is many tasks: each goes through a run of it. Which pipe the stream is on is told
    by the runs before, one row each, and a packet that lies in two runs is put together
    from their ends."""
    # read three times: for the runs, for the pipes and for the packets
    outer = written(packets.where(F.col("pid") == pid).select("stream_id", F.col("pid").cast("int").alias("pid"), "seq", "pkt"))
    dealt = in_runs(outer, span).repartition("stream_id", "pid", "run")
    if pipe is None:
        own = W.partitionBy("stream_id", "pid").orderBy("run")
        census = by_run(dealt, lambda _: Census(), "first int, lost boolean, later int").withColumn("_lost", F.when(F.col("lost"), F.struct("later")))
        before = own.rowsBetween(W.unboundedPreceding, -1)
        census = census.withColumns({"_since": F.last("_lost", True).over(before), "_epoch": F.coalesce(F.sum(F.col("lost").cast("long")).over(before), F.lit(0))})
        since = W.partitionBy("stream_id", "pid", "_epoch").orderBy("run").rowsBetween(W.unboundedPreceding, -1)
        pipes = census.select(F.struct("stream_id", "pid", "run").alias("_k"), F.coalesce("_since.later", F.first("first", True).over(since)).alias("pipe"))
        dealt = dealt.withColumn("_k", F.struct("stream_id", "pid", "run")).join(F.broadcast(pipes), "_k", "left").drop("_k")
    else:
        dealt = dealt.withColumn("pipe", F.lit(pipe))
    start = lambda row: Run(pipe, None if pd.isna(row.pipe) else int(row.pipe))
    found = written(by_run(dealt, start, "seq long, plp int, pkt binary, seam int, size int, alone boolean, place long"))
    columns = ["stream_id", "pid", "seq", "plp", "pkt"]
    return found.where("seam = 0").select(*columns).unionByName(seamed(found.where("seam > 0")).select(*columns))


def pipe_census(inner: DataFrame) -> DataFrame:
    """Inner packets by stream and pipe."""
    return inner.groupBy("stream_id", "plp").agg(F.count("*").alias("packets"))


def program_identity(programs: DataFrame, streams: DataFrame) -> DataFrame:
    """Each stream's newest first program with the first video and audio pid that
    its map has named since. ``programs`` as ``pat``, ``streams`` as ``pmt`` gives them."""
    first = programs.groupBy("stream_id", "seq").agg(F.min_by(F.struct("sid", "pmt_pid"), "ord").alias("p"))
    now = first.groupBy("stream_id").agg(F.max_by("p", "seq").alias("p"))
    both = first.join(now.withColumnRenamed("p", "q"), "stream_id")
    other = both.groupBy("stream_id").agg(F.coalesce(F.max(F.when(F.col("p") != F.col("q"), F.col("seq"))), F.lit(-1)).alias("other"))
    since = both.join(other, "stream_id").where("p = q and seq > other").groupBy("stream_id", "q").agg(F.min("seq").alias("since"))
    own = streams.join(since, "stream_id").where((F.col("sid") == F.col("q.sid")) & (F.col("pid") == F.col("q.pmt_pid")) & (F.col("seq") > F.col("since")))
    pick = lambda kind: F.min_by(F.when(F.col("kind") == kind, F.col("es_pid")), F.when(F.col("kind") == kind, F.struct("seq", "ord")))
    found = own.groupBy("stream_id").agg(pick("video").alias("video_pid"), pick("audio").alias("audio_pid"))
    return since.select("stream_id", "q.sid", "q.pmt_pid").join(found, "stream_id", "left")


def multiplexed(packets: DataFrame, now_ms: int, silence_ms: int = SILENCE_MS) -> DataFrame:
    """Packets of the services that are not silent for ``silence_ms`` or more."""
    alive = packets.groupBy("stream_id").agg(F.max("arrival_ms").alias("_last")).where(F.lit(now_ms) - F.col("_last") < silence_ms)
    return packets.join(alive.select("stream_id"), "stream_id", "left_semi")


#: First pid of a multiplex, and the pids between the ranges of two services.
FIRST_PID, RANGE = 0x100, 0x20


def pid_plan(services: DataFrame, pids: DataFrame) -> DataFrame:
    """Pids of a multiplex, no two alike: ``(mux_id, stream_id, pid, new_pid)``.

    ``services(mux_id, ord, stream_id)``, ``pids(stream_id, pid)``. A service's pids take
    the first ones from its range on that are free, in order of the services."""
    rows = services.join(pids.select("stream_id", "pid").distinct(), "stream_id")
    rows = rows.withColumn("place", F.row_number().over(W.partitionBy("mux_id").orderBy("ord", "stream_id", "pid")).cast("long"))
    wanted = rows.select("mux_id", F.col("place").alias("ord"), (FIRST_PID + RANGE * F.col("ord")).cast("int").alias("wanted"))
    found = service_ids(wanted).withColumnsRenamed({"ord": "place", "service_id": "new_pid"})
    return rows.join(found, ["mux_id", "place"]).select("mux_id", "stream_id", "pid", F.col("new_pid").cast("int").alias("new_pid"))
