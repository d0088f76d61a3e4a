"""Packet continuity: per-pid status, stage counters, integrity counters, A/V tracks.

All work on packet headers ``(stream_id, pid, seq, arrival_ms, cc, afc, has_payload,
discontinuity, tei, scrambling, pusi, payload_hash, pts, pcr27)``, and ``valid`` where
it is known. What came before a packet of its pid is told by a scan over ranges of the
stream (see ``scans``), so a stream of any length is many tasks, and the counters
aggregate map-side after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.packets import payloads
from .scans import PACKETS, Last, Scan, lag

NULL_PID = 8191
#: Ticks of the 33-bit 90 kHz clock and of the 27 MHz clock built on it.
PTS_WRAP, PCR_WRAP = 1 << 33, (1 << 33) * 300
PCR_JUMP = 27_000_000
GAP_MS = 200


def key() -> W:
    return W.partitionBy("stream_id", "pid").orderBy("seq")


def count(condition) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0)).cast("long")


def modular_delta(now, before, wrap: int) -> Column:
    """Signed difference of two readings of a clock that wraps, by the half-range rule."""
    d = F.pmod(now - before, F.lit(wrap))
    return F.when(d >= wrap // 2, d - wrap).otherwise(d)


def usable(packets: DataFrame) -> DataFrame:
    """without null packets and transport errors."""
    return packets.where((F.col("pid") != NULL_PID) & ~F.col("tei"))


def admitted(packets: DataFrame, pids: DataFrame) -> DataFrame:
    """Packets of the (stream_id, pid) pairs that are let through."""
    return packets.join(pids.select("stream_id", "pid").distinct(), ["stream_id", "pid"], "left_semi")


def _few(packets: DataFrame, *columns: str) -> DataFrame:
    """The columns that counters need, and ``valid`` where it is known."""
    return packets.select("stream_id", "pid", "seq", *columns, *(c for c in ("valid",) if c in packets.columns))


def by_pid(packets: DataFrame, span: int) -> Scan:
    return Scan(packets, ["stream_id", "pid"], ["seq"], span)


def sound(packets: DataFrame) -> Column:
    """Packets with a header that can be read: ``valid`` where it is known."""
    return F.col("valid") if "valid" in packets.columns else F.col("afc") != 0


def status(packets: DataFrame, span: int = PACKETS) -> DataFrame:
    """``status`` of each packet that is valid and neither null nor in error.

    A discontinuity flag starts afresh. A payload packet continues the count by one,
    or repeats it once (Duplicate); an adaptation-only packet keeps it."""
    rows = by_pid(usable(packets).where(sound(packets)), span).add(_b=lag("cc", "has_payload")).done()
    before, paid = F.col("_b.cc"), F.col("_b.has_payload")
    return rows.withColumn(
        "status",
        F.when(F.col("discontinuity"), "Discontinuity")
        .when(F.col("_b").isNull(), "InOrder")
        .when(F.col("has_payload") & paid & (F.col("cc") == before), "Duplicate")
        .when(F.col("has_payload") & (F.col("cc") != (before + 1) % 16), "Gap")
        .when(~F.col("has_payload") & (F.col("cc") != before), "Gap")
        .otherwise("InOrder"),
    ).drop("_b")


def status_counts(packets: DataFrame, span: int = PACKETS) -> DataFrame:
    """A1: packets by pid and status."""
    return status(_few(packets, "cc", "afc", "has_payload", "discontinuity", "tei"), span).groupBy("stream_id", "pid", "status").agg(F.count("*").alias("n"))


def stream_errors(packets: DataFrame, span: int = PACKETS) -> DataFrame:
    """A1: a stream's errors are its gaps and duplicates, and its transport and header
    errors. A header is looked at first, then the error flag, whatever the pid, and then
    the pid; a packet that ends there is no one's predecessor."""
    packets = _few(packets, "cc", "afc", "has_payload", "discontinuity", "tei")
    good = sound(packets)
    counted = good & ~F.col("tei") & (F.col("pid") != NULL_PID)
    rows = by_pid(packets.withColumn("_counted", counted), span).add(_b=Last(F.when(F.col("_counted"), F.struct("cc", "has_payload")))).done()
    paid, known = F.col("has_payload"), F.col("_counted") & ~F.col("discontinuity") & F.col("_b").isNotNull()
    twin = paid & F.col("_b.has_payload") & (F.col("cc") == F.col("_b.cc"))
    gap = F.when(paid, F.col("cc") != (F.col("_b.cc") + 1) % 16).otherwise(F.col("cc") != F.col("_b.cc"))
    out = rows.groupBy("stream_id").agg(count(good & F.col("tei")).alias("transport"), count(~good).alias("invalid"), count(known & (twin | gap)).alias("continuity"))
    return out.withColumn("errors", F.col("continuity") + F.col("transport") + F.col("invalid"))


def stage_events(packets: DataFrame, span: int = PACKETS) -> DataFrame:
    """``cc_error`` and ``exact_duplicate`` of each packet but null packets; a packet
    with the error flag takes part like any other.

    Only payload advances the count. A discontinuity, or a packet without either
    field, forgets it; the last payload packet since is what follow are compared with.
    The same count and the same bytes are an exact duplicate."""
    forgets = F.col("discontinuity") | (F.col("afc") == 0)
    nothing = F.struct(F.lit(None).cast("int").alias("cc"), F.lit(None).cast(packets.schema["payload_hash"].dataType).alias("payload_hash"))
    left = F.when(F.col("has_payload"), F.struct(F.col("cc").cast("int").alias("cc"), "payload_hash")).when(forgets, nothing)
    rows = by_pid(packets.where(F.col("pid") != NULL_PID), span).add(_b=Last(left)).done()
    known = ~forgets & F.col("_b.cc").isNotNull()
    same = F.col("cc") == F.col("_b.cc")
    twin = known & F.col("has_payload") & same & (F.col("payload_hash") == F.col("_b.payload_hash"))
    follows = F.when(F.col("has_payload"), F.col("cc") == (F.col("_b.cc") + 1) % 16).otherwise(same)
    return rows.withColumn("exact_duplicate", F.coalesce(twin, F.lit(False))).withColumn("cc_error", F.coalesce(known & ~F.col("exact_duplicate") & ~follows, F.lit(False))).drop("_b")


def stage_counters(packets: DataFrame, span: int = PACKETS) -> DataFrame:
    """A2: counters of a stage by stream and pid, in one pass."""
    return stage_events(_few(packets, "cc", "afc", "has_payload", "discontinuity", "tei", "payload_hash"), span).groupBy("stream_id", "pid").agg(
        F.count("*").alias("packets"), count(F.col("cc_error")).alias("cc_errors"), count(F.col("exact_duplicate")).alias("exact_duplicates"),
        count(F.col("afc") == 2).alias("adaptation_only"), count(F.col("discontinuity") & (F.col("afc") != 0)).alias("discontinuities"), count(F.col("afc") == 0).alias("bad_afc"),
        count(F.col("cc_error") & (F.col("afc") == 2)).alias("adaptation_only_cc_errors"), count(F.col("tei")).alias("tei"),
    )


def alignment(packets: DataFrame, size: int = 188) -> DataFrame:
    """A2: how often a stream's packets do not follow each other in its bytes, and the
    bytes between them. ``packets(stream_id, seq, at)`` as the reader gives them."""
    gap = F.col("at") - F.coalesce(F.lag("at").over(W.partitionBy("stream_id").orderBy("seq")) + size, F.lit(0))
    return packets.select("stream_id", gap.alias("gap")).groupBy("stream_id").agg(count(F.col("gap") > 0).alias("alignment_misses"), F.sum("gap").alias("resync_bytes"))


def top_pids(counters: DataFrame, by: str = "cc_errors", n: int = 8) -> DataFrame:
    """A5, O2: the ``n`` pids of a stream with the most errors, none with zero; ties by pid."""
    rank = F.row_number().over(W.partitionBy("stream_id").orderBy(F.desc(by), "pid"))
    return counters.where(F.col(by) > 0).withColumn("rank", rank).where(F.col("rank") <= n)


def integrity_counters(packets: DataFrame, span: int = PACKETS) -> DataFrame:
    """Continuity, clock and scrambling counters by stream and pid.

    A transport error, a packet without either field and a discontinuity forget the
    count (the first and the last then start from the packet's own); a discontinuity
    forgets the clock, too. Parity is compared with the last scrambled packet.

    With ``adaptation_length``, the first byte of the adaptation field, a field that goes
    beyond the packet is as bad as none; with ``missing_key``, packets that no key could
    open are counted, too."""
    more = [c for c in ("adaptation_length", "missing_key") if c in packets.columns]
    overrun = (F.col("afc") >= 2) & (F.col("adaptation_length") + 5 > 188) if "adaptation_length" in more else F.lit(False)
    keys = [count(F.col("missing_key")).alias("missing_key_packets")] if "missing_key" in more else []
    good, none = (F.col("afc") != 0) & ~F.coalesce(overrun, F.lit(False)), F.lit(None)
    reset = F.col("discontinuity") & good
    forgets = F.col("tei") | ~good | reset
    count_left = F.when(good & F.col("has_payload"), F.struct(F.col("cc").cast("int").alias("v"))).when(forgets, F.struct(none.cast("int").alias("v")))
    clock_left = F.when(good & F.col("pcr27").isNotNull(), F.struct(F.col("pcr27").alias("v"))).when(reset, F.struct(none.cast("long").alias("v")))
    packets = _few(packets, "cc", "afc", "has_payload", "discontinuity", "tei", "scrambling", "pcr27", *more)
    rows = by_pid(packets.where(F.col("pid") != NULL_PID), span).add(
        _cc=Last(count_left), _pcr=Last(clock_left), _parity=Last(F.when(good & (F.col("scrambling") >= 2), F.col("scrambling")))).done()
    last_cc, last_pcr = F.when(~forgets, F.col("_cc.v")), F.when(~reset, F.col("_pcr.v"))
    step = modular_delta(F.col("pcr27"), last_pcr, PCR_WRAP)
    paid, repeat = good & F.col("has_payload"), F.col("cc") == last_cc
    return rows.groupBy("stream_id", "pid").agg(
        F.count("*").alias("packets"), count(F.col("tei")).alias("tei"), count(~good).alias("bad_afc"), count(reset).alias("discontinuities"),
        count(paid & repeat).alias("cc_repeats"), count(paid & ~repeat & (F.col("cc") != (last_cc + 1) % 16)).alias("cc_gaps"),
        count(good & (step < 0)).alias("pcr_backwards"), count(good & (step > PCR_JUMP)).alias("pcr_jumps"),
        count(good & (F.col("scrambling") >= 2)).alias("scrambled"),
        count(good & (F.col("scrambling") >= 2) & (F.col("scrambling") != F.col("_parity"))).alias("parity_changes"), *keys,
    )


def pts_gaps(packets: DataFrame, span: int = PACKETS) -> DataFrame:
    """``gap_ms`` to the timestamp before, ``backward`` where it ran back."""
    rows = by_pid(usable(packets).where("pts is not null"), span).add(_b=Last(F.col("pts"))).done()
    rows = rows.withColumn("forward", F.pmod(F.col("pts") - F.col("_b"), F.lit(PTS_WRAP))).drop("_b")
    return rows.withColumn("backward", F.col("forward") > PTS_WRAP // 2).withColumn("gap_ms", F.when(~F.col("backward"), F.expr("forward * 1000 div 90000")))


#: Why a track's PES start is bad, in the order in which they are looked for.
BAD_PES = ("adaptation", "truncated", "prefix", "stream_id")


def pes_fault(kind: Column, column: str = "pkt") -> Column:
    """A4: why the PES start of a clear packet is bad; null if it is sound. ``kind`` is
    ``video`` or ``audio`` and says which stream ids are expected."""
    byte = lambda at: F.conv(F.hex(F.substring(F.col(column), at + 1, F.lit(1))), 16, 10).cast("int")
    adaptation = F.when(F.col("afc") == 3, byte(F.lit(4))).otherwise(-1)
    start = F.when(F.col("afc") == 3, 5 + adaptation).otherwise(4)
    stream = byte(start + 3)
    expected = F.when(kind == "video", stream.between(0xE0, 0xEF)).otherwise(stream.between(0xC0, 0xDF) | (stream == 0xBD))
    return (
        F.when(adaptation > 182, BAD_PES[0]).when(start + 9 > 188, BAD_PES[1])
        .when(F.hex(F.substring(F.col(column), start + 1, F.lit(3))) != "000001", BAD_PES[2]).when(~expected, BAD_PES[3])
    )


def track_counters(packets: DataFrame, span: int = PACKETS) -> DataFrame:
    """Counters of each track: scrambling, timestamps and arrival, in one pass;
    with a column ``pes_fault`` (see ``pes_fault``) also sound and bad PES starts by
    reason."""
    more = [c for c in ("pes_fault",) if c in packets.columns]
    rows = _few(packets, "afc", "has_payload", "tei", "scrambling", "pusi", "pts", "arrival_ms", *more).where(F.col("pid") != NULL_PID)
    fine, counted = ~F.col("tei"), ~F.col("tei") & (F.col("afc") != 0)
    rows = by_pid(rows, span).add(_t=Last(F.when(fine, F.col("pts"))), _w=Last(F.when(counted, F.col("arrival_ms")))).done()
    rows = rows.withColumn("_f", F.when(fine, F.pmod(F.col("pts") - F.col("_t"), F.lit(PTS_WRAP))))
    rows = rows.withColumns({"_back": F.col("_f") > PTS_WRAP // 2, "_gap": F.when(F.col("_f") <= PTS_WRAP // 2, F.expr("_f * 1000 div 90000")), "_wall": F.when(counted, F.col("arrival_ms") - F.col("_w"))})
    clear_start = counted & F.col("pusi") & F.col("has_payload") & (F.col("scrambling") == 0)
    more = []
    if "pes_fault" in packets.columns:
        more = [count(clear_start & F.col("pes_fault").isNull()).alias("clear_pes"), count(clear_start & F.col("pes_fault").isNotNull()).alias("bad_pes")]
        more += [count(clear_start & (F.col("pes_fault") == name)).alias(f"bad_pes_{name}") for name in BAD_PES]
    return rows.groupBy("stream_id", "pid").agg(
        count(counted).alias("packets"), *[count(counted & (F.col("scrambling") == k)).alias(name) for k, name in ((0, "clear"), (2, "even"), (3, "odd"))],
        count(clear_start).alias("pes_starts"), count(F.col("_wall") > GAP_MS).alias("wall_gaps"), F.max("_wall").alias("wall_gap_max_ms"),
        count(fine & F.col("pts").isNotNull()).alias("timestamps"), count(F.col("_back")).alias("pts_backward"), count(F.col("_gap") > GAP_MS).alias("pts_gaps"), F.max("_gap").alias("pts_gap_max_ms"), *more,
    ).where("packets > 0")


def fixed_reports(packets: DataFrame, seconds: int = 3600, span: int = PACKETS) -> DataFrame:
    """Packets and errors of each stream in fixed intervals since 1970."""
    slot = F.expr(f"arrival_ms div {seconds * 1000} * {seconds}")
    return status(_few(packets, "cc", "afc", "has_payload", "discontinuity", "tei", "arrival_ms"), span).groupBy("stream_id", slot.alias("slot_s")).agg(F.count("*").alias("packets"), count(F.col("status") == "Gap").alias("gaps"))


def after_counters(packets: DataFrame) -> DataFrame:
    """A3: what leaves a descrambler, by stream and pid: packets, those still scrambled,
    sound and bad PES starts of video, and its NAL units' headers.

    ``packets(stream_id, pid, seq, pkt, codec)``; ``codec`` is null where it is no video.
    A PES start or a scrambled packet begins a run; the clear payloads of a run are
    joined, so a start code may go across packets."""
    rows = payloads(packets.where(F.col("pid") != NULL_PID).select("stream_id", "pid", "seq", "pkt", "codec"))
    clear, video = F.col("scrambling") == 0, F.col("codec").isNotNull()
    begins = clear & video & F.col("start") & F.col("data").isNotNull()
    byte = lambda k: F.conv(F.hex(F.substring("data", k + 1, 1)), 16, 10).cast("int")
    sound = (F.octet_length("data") >= 9) & (F.hex(F.substring("data", 1, 3)) == "000001") & byte(3).between(0xE0, 0xEF) & byte(6).between(0x80, 0xBF)
    rows = rows.withColumns({"begins": F.coalesce(begins, F.lit(False)), "sound": F.coalesce(sound, F.lit(False)), "clear": clear})
    rows = rows.withColumn("run", F.sum((F.col("begins") | ~F.col("clear")).cast("long")).over(key().rowsBetween(W.unboundedPreceding, 0)))
    body = F.when(~F.col("clear") | ~video | F.col("begins") & ~F.col("sound"), None).when(F.col("begins"), F.substring("data", byte(8) + 10, F.lit(188))).otherwise(F.col("data"))
    runs = rows.withColumn("body", F.coalesce(body, F.lit(b""))).groupBy("stream_id", "pid", "run").agg(
        F.count("*").alias("packets"), count(~F.col("clear")).alias("scrambled"), count(F.col("begins") & F.col("sound")).alias("ok"), count(F.col("begins") & ~F.col("sound")).alias("bad"),
        F.max("codec").alias("codec"), F.decode(F.expr("listagg(body) within group (order by seq)"), "ISO-8859-1").alias("text"))
    hevc, start = F.col("codec") == "hevc", r"\x00\x00\x01"
    found = lambda tail: F.regexp_count("text", F.lit(start + tail))
    headers = F.when(hevc, found(r"[\x00-\xff]{2}")).otherwise(found(r"[\x00-\xff]"))
    wrong = F.when(hevc, found(r"[\x80-\xff]") + found(r"[\x00-\xff](?:" + "|".join(f"\\x{b:02x}" for b in range(0, 256, 8)) + ")"))
    wrong = wrong.otherwise(found(r"(?:[\x80-\xff]|" + "|".join(f"\\x{b:02x}" for b in range(0, 128, 32)) + ")"))
    return runs.groupBy("stream_id", "pid").agg(
        F.sum("packets").alias("post_packets"), F.sum("scrambled").alias("post_still_scrambled"), F.sum("ok").alias("post_pes_ok"), F.sum("bad").alias("post_pes_bad"),
        F.sum(headers).cast("long").alias("post_video_nal_headers"), F.sum(wrong).cast("long").alias("post_video_nal_bad"))


def response_counters(results: DataFrame, slow_ms: int = 500) -> DataFrame:
    """A3: answers of a key service by stream, as its log has them: ``results(stream_id,
    found, latency_ms)``; nothing of the answers themselves."""
    ok = F.col("found")
    return results.groupBy("stream_id").agg(
        count(ok).alias("cw_responses"), count(~ok).alias("ecm_not_found"), F.coalesce(F.max(F.when(ok, F.col("latency_ms"))), F.lit(0)).alias("ecm_latency_max_ms"), count(ok & (F.col("latency_ms") > slow_ms)).alias("ecm_latency_slow"))


def accounting(pairs: DataFrame) -> DataFrame:
    """Packets of each stream that went through a stage, that it changed, and that are
    clear or scrambled behind it. ``pairs(stream_id, before, after)``."""
    scrambled = F.conv(F.hex(F.substring("after", 4, 1)), 16, 10).cast("int") >= 64
    return pairs.groupBy("stream_id").agg(F.count("*").alias("seen"), count(F.col("before") != F.col("after")).alias("changed"), count(~scrambled).alias("clear"), count(scrambled).alias("scrambled"))
