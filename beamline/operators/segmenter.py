"""Packets of a stream dealt out to segments that a player can begin with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.packets import octet
from ..sources.transport import parse_headers
from .folds import PTS_WRAP, fold

NULL_PID, HZ = 0x1FFF, 90_000
#: Packets and bytes of a picture that are held at most; the first segment's
#: target; the least length of a segment and the most of one that waits for random access.
HELD_PACKETS, HELD_BYTES, FIRST_MS, LEAST_MS, MOST_MS = 2048, 512 * 1024, 1000, 50, 60_000
#: Stream types.
MPEG_VIDEO, AVC, HEVC, MPEG_AUDIO, ADTS, LATM = (0x01, 0x02), 0x1B, 0x24, (0x00, 0x03, 0x04), 0x0F, 0x11
COLUMNS = ["stream_id", "seq", "pid", "clock", "pusi", "has_payload", "clear", "random_access", "pat", "pmt", "table", "safe", "coded", "starts", "picture", "bytes", "has_coded"]


def units(test) -> str:
    """Pattern of a start code and a NAL unit's first byte that passes ``test``."""
    return "\\x00\\x00\\x01[" + "".join(f"\\x{b:02x}" for b in range(256) if test(b)) + "]"


AVC_KIND, HEVC_KIND = (lambda b: b & 0x1F), (lambda b: b >> 1 & 0x3F)


def has(data: str, kind, *types: int) -> Column:
    return F.decode(data, "ISO-8859-1").rlike(units(lambda b: kind(b) in types))


def first_picture(data: str, kind: Column) -> Column:
    """``key`` or ``other`` by the first slice in the bytes of a coded pid; else null."""
    text, is_avc = F.decode(data, "ISO-8859-1"), kind == AVC
    avc = F.regexp_extract(text, f"({units(lambda b: 1 <= AVC_KIND(b) <= 5)})", 1)
    hevc = F.regexp_extract(text, f"({units(lambda b: HEVC_KIND(b) <= 31)})", 1)
    code = F.when(is_avc, avc).otherwise(hevc)
    key = F.when(is_avc, code.rlike(units(lambda b: AVC_KIND(b) == 5))).otherwise(code.rlike(units(lambda b: 16 <= HEVC_KIND(b) <= 23)))
    return F.when(kind.isin(AVC, HEVC) & (code != ""), F.when(key, "key").otherwise("other"))


def prepared(packets: DataFrame, pids: DataFrame, tables: DataFrame) -> DataFrame:
    """What ``dealt`` takes, from ``packets(stream_id, seq, pkt)``.

    ``pids(stream_id, pid, stream_type, pmt_pid)``, ``stream_type`` of the elementary
    streams of a program; ``tables(stream_id, seq, table_id)``, the packets with which a
    section of a program table is complete.

    A pid may be started with at a PES start that a fresh decoder can take: audio with a
    frame's header, MPEG video with a sequence header, H.264 and HEVC with parameter sets
    and a key picture, all in the packet itself. Start codes may lie across packets: a
    packet is searched with the three bytes before it."""
    rows = parse_headers(packets.select("stream_id", "seq", "pkt", F.col("pkt").alias("raw")), "raw").where("valid")
    rows = rows.join(pids.select("stream_id", "pid", "stream_type"), ["stream_id", "pid"], "left")
    rows = rows.join(pids.select("stream_id", F.col("pmt_pid").alias("pid")).distinct().withColumn("table", F.lit(True)), ["stream_id", "pid"], "left")
    done = tables.groupBy("stream_id", "seq").agg(F.max(F.col("table_id") == 0).alias("pat"), F.max(F.col("table_id") == 2).alias("pmt"))
    rows = rows.join(done, ["stream_id", "seq"], "left")
    kind = F.coalesce(F.col("stream_type"), F.lit(0))
    rows = rows.withColumn("data", F.when(F.col("has_payload"), F.substring("pkt", F.col("payload_offset") + 1, F.lit(188))).otherwise(F.lit(b"")))
    size = F.octet_length("data")
    rows = rows.withColumns({"_pes": (size >= 6) & (F.hex(F.substring("data", 1, 3)) == "000001"), "_sid": octet("data", 3)})
    begin = F.when(F.col("pusi"), F.when(F.col("_pes") & (size >= 9), 9 + octet("data", 8)).otherwise(188)).otherwise(0)
    rows = rows.withColumn("elem", F.substring("data", begin + 1, F.lit(188)))
    video, length = F.col("_sid").between(0xE0, 0xEF), F.octet_length("elem")
    b0, b1, b2 = (octet("elem", k) for k in range(3))
    bit = lambda b, mask: b.bitwiseAND(F.lit(mask))
    adts = (b0 == 0xFF) & (bit(b1, 0xF0) == 0xF0) & (bit(b1, 6) == 0) & (bit(b2, 0x3C) != 0x3C)
    layer = (b0 == 0xFF) & (bit(b1, 0xE0) == 0xE0) & (bit(b1, 0x18) != 8) & (bit(b1, 6) != 0) & ~bit(b2, 0xF0).isin(0, 0xF0) & (bit(b2, 0x0C) != 0x0C)
    audio = F.when(kind == ADTS, adts).when(kind == LATM, (b0 == 0x56) & (bit(b1, 0xE0) == 0xE0)).when(kind.isin(*MPEG_AUDIO), layer).otherwise(True)
    avc = has("elem", AVC_KIND, 7) & has("elem", AVC_KIND, 8) & (F.col("random_access") | has("elem", AVC_KIND, 5))
    hevc = has("elem", HEVC_KIND, 32) & has("elem", HEVC_KIND, 33) & has("elem", HEVC_KIND, 34) & (F.col("random_access") | has("elem", HEVC_KIND, *range(16, 24)))
    pictures = F.when(kind.isin(*MPEG_VIDEO), (length >= 4) & F.decode("elem", "ISO-8859-1").rlike("\\x00\\x00\\x01\\xb3")).when(kind == AVC, avc).when(kind == HEVC, hevc).otherwise(True)
    safe = F.when(~F.col("_pes"), True).when(F.col("_sid").between(0xC0, 0xDF), (length >= 3) & audio).when(video, pictures).otherwise(True)
    rows = rows.select(
        "stream_id", "seq", "pid", F.col("pcr_base").alias("clock"), "pusi", "has_payload", (F.col("scrambling") == 0).alias("clear"), "random_access",
        F.coalesce("pat", F.lit(False)).alias("pat"), F.coalesce("pmt", F.lit(False)).alias("pmt"), (F.coalesce("table", F.lit(False)) | (F.col("pid") == 0)).alias("table"),
        safe.alias("safe"), kind.isin(AVC, HEVC).alias("coded"), (F.col("_pes") & (size >= 9) & video).alias("starts"), first_picture("elem", kind).alias("picture"), length.alias("bytes"),
        F.substring("elem", 1, 3).alias("_head"), F.when(length > 3, F.substring("elem", -3, 3)).otherwise(F.col("elem")).alias("_tail"), kind.alias("_kind"))
    own = W.partitionBy("stream_id", "pid").orderBy("seq")
    tail = lambda k: F.coalesce(F.lag("_tail", k).over(own), F.lit(b""))
    begun = lambda k: F.coalesce(F.lag("pusi", k).over(own), F.lit(True))
    before = F.when(begun(1), tail(1)).when(begun(2), F.concat(tail(2), tail(1))).otherwise(F.concat(tail(3), tail(2), tail(1)))
    rows = rows.withColumn("_before", before).withColumn("_edge", F.concat(F.when(F.octet_length("_before") > 3, F.substring("_before", -3, 3)).otherwise(F.col("_before")), F.col("_head")))
    edge = F.when(~F.col("pusi") & F.col("coded"), first_picture("_edge", F.col("_kind")))
    coded = pids.groupBy("stream_id").agg(F.max(F.col("stream_type").isin(AVC, HEVC)).alias("has_coded"))
    rows = rows.withColumn("picture", F.coalesce(edge, F.col("picture"))).join(coded, "stream_id", "left")
    return rows.withColumn("has_coded", F.coalesce("has_coded", F.lit(False))).select(*COLUMNS)


def segmenter_step(state: dict, row, target_ms: int, independent: bool) -> list[tuple]:
    """One packet; gives ``(seq, segment, closed_ms)`` of the packets that are decided,
    ``closed_ms`` at the first packet behind a segment: the length of that segment."""
    if not state:
        state.update(pat=False, pmt=False, origin=None, last=None, started=set(), n=0, some=False, armed=False, held=None)
    state["pat"], state["pmt"] = state["pat"] or row.pat, state["pmt"] or row.pmt
    clocked = row.clock is not None
    if state["origin"] is None:
        if not (clocked and (row.random_access if independent else row.pusi and state["pat"] and state["pmt"])):
            return []
        state.update(origin=row.clock, last=row.clock)
    if not row.table and row.pid != NULL_PID and row.has_payload and row.pid not in state["started"]:
        if not (row.pusi and row.clear and row.safe):
            return []
        state["started"].add(row.pid)
    if clocked:
        state["last"] = row.clock
    target = target_ms if state["n"] else min(target_ms, FIRST_MS)
    ticks = (state["last"] - state["origin"]) % PTS_WRAP
    reached = state["some"] and ticks * 1000 >= target * HZ

    def cut(ticks: int, origin: int) -> int | None:
        """Length of the segment that ends here."""
        state["origin"] = origin
        if not state["some"]:
            return None
        state.update(n=state["n"] + 1, some=False)
        return min(max(ticks * 1000 // HZ, LEAST_MS), MOST_MS if independent else 3 * target_ms)

    def release(key: bool) -> list[tuple]:
        held = state["held"]
        closed = cut(held["ticks"], held["clock"]) if key else None
        state.update(held=None, some=True, armed=state["armed"] and not key)
        return [(seq, state["n"], None if k else closed) for k, seq in enumerate(held["seqs"])]

    out, closed = [], None
    if not independent and row.has_coded:
        state["armed"] |= reached
        held = state["held"]
        if held and row.pid == held["pid"] and row.pusi and row.clear:
            out, held, state["armed"] = release(False), None, True
        if held:
            held["seqs"].append(row.seq)
            held["bytes"] += row.bytes if row.pid == held["pid"] else 0
            kind = row.picture if row.pid == held["pid"] else None
            full = len(held["seqs"]) >= HELD_PACKETS or held["bytes"] >= HELD_BYTES
            return release(kind == "key") if kind or full else []
        if state["armed"] and row.pusi and row.has_payload and row.clear and row.coded and row.starts:
            state["held"] = {"pid": row.pid, "ticks": ticks, "clock": row.clock if clocked else state["last"], "seqs": [row.seq], "bytes": row.bytes}
            key = row.random_access or row.picture == "key"
            return out + (release(key) if key or row.picture else [])
    elif clocked:
        late = not independent and state["some"] and ticks * 1000 >= 3 * target * HZ
        if reached and (row.random_access if independent else row.pusi or late):
            closed = cut(ticks, state["last"])
    state["some"] = True
    return [*out, (row.seq, state["n"], closed)]


def dealt(packets: DataFrame, target_ms: int = 4000, independent: bool = False) -> DataFrame:
    """``(seq, segment, closed_ms)`` of the packets that a segment takes, from ``prepared``.

    Nothing is taken until both program tables are complete and a PES start has a clock
    (``independent``, for transcoded streams: until a clock comes with random access), and
    nothing of a pid until its safe start. A segment whose clocks span the target (a
    second at most for the first) is cut: ``independent`` at a clock with random access;
    where the program has H.264 or HEVC before the next picture of such a pid that is a
    key picture; else at a clock with a unit start, or at any clock after three times the
    target. A picture's type is its first slice's; from its start until that is seen, all
    packets are held, 2,048 packets or 512 KB at most. Packets that are held at the end of
    a stream are in no segment.

    A stream's rows are one task's, as each cut depends on the one before; the state is
    the pids that have started and what is held."""
    return fold(packets.select(*COLUMNS), "stream_id", ["seq"], lambda state, row: segmenter_step(state, row, target_ms, independent), "seq long, segment long, closed_ms long")


def segments(rows: DataFrame) -> DataFrame:
    """Segments that have ended, from ``dealt``: first and last packet, how many, and the
    length."""
    own = W.partitionBy("stream_id").orderBy("segment")
    rows = rows.groupBy("stream_id", "segment").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count("*").alias("packets"), F.max("closed_ms").alias("_closed"))
    return rows.withColumn("duration_ms", F.lead("_closed").over(own)).where("duration_ms is not null").drop("_closed")
