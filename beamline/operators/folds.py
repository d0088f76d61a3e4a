"""Ordered folds: operators whose next state depends on an earlier decision.

``lag`` cannot express these. Rows are dealt out by stream and sorted within the
partition; each task then goes through its rows in Arrow batches and keeps one state
for the stream at hand, so memory does not grow with a stream's history. A null stream
is a stream of its own; integers keep all their digits.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import namedtuple
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

PCR_WRAP, PTS_WRAP, HZ = (1 << 33) * 300, 1 << 33, 27_000_000
PACKET_BITS = 1504
#: Labels of what starts a clock's timeline afresh.
FLAGGED, BACKWARD, FORWARD = "discontinuity_flag", "backward_jump", "forward_jump"
#: Seconds between two probes, after a failed switch, and of the first start.
PROBE_S, RETRY_S, START_S = 5, 10, 5


def by_stream(df: DataFrame, key: str, order: list[str], start: Callable[[], dict], take: Callable[[dict, pa.RecordBatch], list], out: str) -> DataFrame:
    """Columns that ``take(state, rows)`` returns, with the key before them.

    ``start()`` makes the state of a new key; ``take`` gets the rows of one key that lie
    together in a batch; ``out`` is the DDL of the columns."""
    schema = StructType([StructField(key, df.schema[key].dataType), *StructType.fromDDL(out).fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = [], {}
        for batch in batches:
            ends, at, parts = pc.run_end_encode(batch.column(key)), 0, []
            for own, end in zip(ends.values.to_pylist(), ends.run_ends.to_pylist()):
                if last != [own]:
                    last, state = [own], start()
                columns = take(state, batch.slice(at, end - at))
                names = pa.array([own] * len(columns[0]), arrow.types[0])
                parts.append(pa.RecordBatch.from_arrays([names, *(pa.array(c, t) for c, t in zip(columns, arrow.types[1:]))], schema=arrow))
                at = end
            yield from pa.Table.from_batches(parts, arrow).combine_chunks().to_batches()

    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def fold(df: DataFrame, key: str, order: list[str], step: Callable[[dict, object], list[tuple]], out: str) -> DataFrame:
    """Rows that ``step(state, row)`` returns, with the key before them."""
    row_of, width = namedtuple("Row", df.columns), len(StructType.fromDDL(out).fields)

    def take(state: dict, rows: pa.RecordBatch) -> list:
        found = [r for row in map(row_of._make, zip(*(c.to_pylist() for c in rows.columns))) for r in step(state, row)]
        return list(zip(*found)) or [[] for _ in range(width)]

    return by_stream(df, key, order, dict, take, out)


def spaced(ts: list[int], last: int | None, gap: int) -> list[int]:
    """Places of ascending times that are ``gap`` after the last one taken."""
    out, at = [], 0 if last is None else bisect_left(ts, last + gap)
    while at < len(ts):
        out.append(at)
        at = bisect_left(ts, ts[at] + gap, at + 1)
    return out


def throttle(samples: DataFrame, seconds: int = 30) -> DataFrame:
    """A sample counts if ``seconds`` have passed since the last that counted."""

    def take(state, rows):
        ts = rows.column("ts").to_pylist()
        kept = spaced(ts, state.get("at"), seconds)
        if kept:
            state["at"] = ts[kept[-1]]
        return [rows.column("sample_id").take(pa.array(kept, pa.int64())), [ts[k] for k in kept]]

    rows = samples.select("stream_id", "ts", "sample_id").where("ts is not null")
    return by_stream(rows, "stream_id", ["ts", "sample_id"], dict, take, "sample_id long, ts long")


def downsample(samples: DataFrame, now: int, keep_s: int = 86_400, recent_s: int = 3600, step_s: int = 120) -> DataFrame:
    """T4: the last hour whole; of older samples those ``step_s`` after the last kept."""

    def take(state, rows):
        ts = rows.column("ts").to_pylist()
        recent = bisect_left(ts, now - recent_s)
        kept = spaced(ts[:recent], state.get("at"), step_s)
        if kept:
            state["at"] = ts[kept[-1]]
        kept += range(recent, len(ts))
        return [rows.column("sample_id").take(pa.array(kept, pa.int64())), [ts[k] for k in kept]]

    rows = samples.select("stream_id", "ts", "sample_id").where(f"ts >= {now - keep_s}")
    return by_stream(rows, "stream_id", ["ts", "sample_id"], dict, take, "sample_id long, ts long")


def input_rate(segments: DataFrame, reset_s: float = 12.0) -> DataFrame:
    """Bit rate of fetched segments; what is gathered starts afresh once it holds
    ``reset_s`` of media. ``segments(stream_id, sequence, bytes, duration_ms)``."""

    def take(state, rows):
        size, ms = (np.cumsum(rows.column(c).to_numpy(zero_copy_only=False)) for c in ("bytes", "duration_ms"))
        rate, at = np.zeros(len(ms), np.int64), 0
        held_bytes, held_ms = state.get("held", (0, 0))
        while at < len(ms):
            end = min(int(np.searchsorted(ms, reset_s * 1000 - held_ms, "left")) + 1, len(ms))
            own_bytes, own_ms = size[at:end] + held_bytes, ms[at:end] + held_ms
            rate[at:end] = np.where(own_ms > 0, own_bytes * 8000 // np.maximum(own_ms, 1), 0)
            if own_ms[-1] >= reset_s * 1000:
                held_bytes, held_ms = -int(size[end - 1]), -int(ms[end - 1])
            at = end
        state["held"] = (held_bytes + int(size[-1]), held_ms + int(ms[-1]))
        return [rows.column("sequence"), rate]

    rows = segments.select("stream_id", "sequence", "bytes", "duration_ms").fillna(0, ["bytes", "duration_ms"])
    return by_stream(rows, "stream_id", ["sequence"], dict, take, "sequence long, bps long")


# --- clocks ---------------------------------------------------------------------------


def reset_cause(row, back: int, ticks: int) -> str | None:
    """Why a reading of the source clock starts the timeline afresh; None if it does not."""
    if row.discontinuity:
        return FLAGGED
    if 0 < back < HZ // 1000 or ticks <= 2 * HZ:
        return None
    return BACKWARD if back > 0 else FORWARD


def reference(readings: DataFrame) -> DataFrame:
    """Readings of each stream's first clock pid, where pids are known: a stream of several
    programs has several clocks, and the first that is seen is the one."""
    if "pid" not in readings.columns:
        return readings
    first = readings.groupBy("stream_id").agg(F.min_by("pid", F.struct("idx", "pid")).alias("_pid"))
    return readings.join(first, "stream_id").where("pid = _pid").drop("_pid")


def clock_timeline(readings: DataFrame) -> DataFrame:
    """Anchors of the source clock, and its resets with their cause.

    ``readings(stream_id, idx, pcr27, discontinuity, observed_ms)``, with ``pid`` those of
    the ``reference``; steps under a
    millisecond, forward or back, are no anchor; a flag, or more than two seconds,
    starts the timeline afresh."""

    def move(state, row, ns: int, epoch: int) -> None:
        state.update(idx=row.idx, pcr=row.pcr27, seen=row.observed_ms, ns=ns, epoch=epoch)

    def step(state, row):
        if not state:
            move(state, row, 0, 0)
            return [("anchor", row.idx, 0, 0, None, 0, 0, 0)]
        if row.idx <= state["idx"]:
            return []
        back, ticks = state["pcr"] - row.pcr27, (row.pcr27 - state["pcr"]) % PCR_WRAP
        cause = reset_cause(row, back, ticks)
        if cause:
            span = (-back if back > 0 else ticks) * 1000
            jump = -(-span // HZ) if span < 0 else span // HZ
            told = (cause, jump, max(0, row.observed_ms - state["seen"]), row.idx - state["idx"])
            move(state, row, 0, state["epoch"] + 1)
            return [("reset", row.idx, 0, state["epoch"], *told)]
        if HZ // 1000 <= ticks <= 2 * HZ:
            move(state, row, state["ns"] + ticks * 1_000_000_000 // HZ, state["epoch"])
            return [("anchor", row.idx, state["ns"], state["epoch"], None, 0, 0, 0)]
        return []

    out = "kind string, idx long, ns long, epoch long, cause string, jump_ms long, wall_gap_ms long, packet_gap long"
    return fold(reference(readings).select("stream_id", "idx", "pcr27", "discontinuity", "observed_ms"), "stream_id", ["idx"], step, out)


def packet_schedule(readings: DataFrame) -> DataFrame:
    """Elapsed source ticks at each anchor; a reset is bridged with the last interval."""

    def step(state, row):
        if "idx" not in state:
            state |= {"idx": row.idx, "pcr": row.pcr27, "ticks": 0, "span": None}
            return [(row.idx, 0, False)]
        if row.idx <= state["idx"]:
            return []
        packets, delta = row.idx - state["idx"], (row.pcr27 - state["pcr"]) % PCR_WRAP
        if not row.discontinuity and delta == 0:
            return []
        bridged = row.discontinuity or delta > 10 * HZ
        if not bridged:
            state["span"] = (delta, packets)
        elif state["span"] is None:
            state |= {"idx": row.idx, "pcr": row.pcr27, "ticks": 0}
            return [(row.idx, 0, False)]
        ticks, per = state["span"]
        state |= {"idx": row.idx, "pcr": row.pcr27, "ticks": state["ticks"] + (packets * ticks // per if bridged else delta)}
        return [(row.idx, state["ticks"], bridged)]

    return fold(reference(readings).select("stream_id", "idx", "pcr27", "discontinuity"), "stream_id", ["idx"], step, "idx long, ticks long, bridged boolean")


def source_rate(readings: DataFrame, window_ticks: int = HZ // 2, weight: int = 7, maximum: int = 200_000_000) -> DataFrame:
    """Bit rate by source clock: intervals of 1 ms to 10 s fill a window of half a
    second; each window's rate, if it is not above ``maximum``, enters an average with
    ``weight`` parts of the old value (3 where the source's timeline is the master)."""

    def step(state, row):
        fresh = "pcr" not in state or row.discontinuity
        if fresh:
            state |= {"ticks": 0, "packets": 0}
        else:
            delta, packets = (row.pcr27 - state["pcr"]) % PCR_WRAP, row.idx - state["idx"]
            if packets > 0 and HZ // 1000 <= delta <= 10 * HZ:
                state["ticks"] += delta
                state["packets"] += packets
            else:
                state |= {"ticks": 0, "packets": 0}
        state |= {"pcr": row.pcr27, "idx": row.idx}
        if state["ticks"] < window_ticks:
            return []
        bits, ticks = state["packets"] * PACKET_BITS * HZ, state["ticks"]
        state |= {"ticks": 0, "packets": 0}
        if bits > maximum * ticks:
            return []
        measured = max(1, bits // ticks)
        old = state.get("rate")
        state["rate"] = measured if old is None else (old * weight + measured) // (weight + 1)
        return [(row.idx, measured, state["rate"])]

    return fold(reference(readings).select("stream_id", "idx", "pcr27", "discontinuity"), "stream_id", ["idx"], step, "idx long, measured_bps long, rate_bps long")


def arrival_rate(arrivals: DataFrame, window_ms: int = 1000) -> DataFrame:
    """Bit rate by arrival in windows of at least ``window_ms``, averaged 7 to 1.
    ``arrivals(stream_id, seq, arrival_ms)``. A window is found by its first arrival
    beyond the last one's end, so the work is in proportion to the windows."""

    def take(state, rows):
        at_ms, out, at = rows.column("arrival_ms").to_pylist(), [], 0
        if "start" not in state:
            state |= {"start": at_ms[0], "n": 1}
            at = 1
        while at < len(at_ms):
            end = bisect_left(at_ms, state["start"] + window_ms, at)
            if end == len(at_ms):
                state["n"] += end - at
                break
            n, elapsed = state["n"] + end + 1 - at, at_ms[end] - state["start"]
            measured, old = n * PACKET_BITS * 1000 // elapsed, state.get("rate")
            state |= {"start": at_ms[end], "n": 0, "rate": (old * 7 + measured) // 8 if old else measured}
            out.append((end, measured, state["rate"]))
            at = end + 1
        ends, measured, rate = zip(*out) if out else ((), (), ())
        return [rows.column("seq").take(pa.array(ends, pa.int64())), measured, rate]

    rows = arrivals.select("stream_id", "seq", "arrival_ms").where("arrival_ms is not null")
    return by_stream(rows, "stream_id", ["arrival_ms", "seq"], dict, take, "seq long, measured_bps long, rate_bps long")


def clock_lock(pictures: DataFrame, needed: int = 25, tolerance: int = 10_800, jump: int = 90_000, period: int = 3600, again: int = 100) -> DataFrame:
    """Lock to 25 pictures a second. ``pictures(stream_id, idx, pts)``.

    From its anchor on, picture ``needed`` or a later one that is within ``tolerance`` of
    its due time locks the clock to its own time, and due times follow from there; after
    ``again`` pictures without a lock the anchor moves on. A locked clock that is more
    than ``jump`` off starts afresh."""

    def step(state, row):
        pts = row.pts % PTS_WRAP
        due = (state["anchor"] + state["n"] * period) % PTS_WRAP if state else pts
        off = (pts - due + PTS_WRAP // 2) % PTS_WRAP - PTS_WRAP // 2
        if not state or state["locked"] and abs(off) > jump:
            state.update(anchor=pts, n=1, locked=False)
            return [(row.idx, False, pts)]
        state["n"] += 1
        if not state["locked"] and state["n"] >= needed:
            if abs(off) <= tolerance:
                state.update(locked=True, anchor=(pts - (state["n"] - 1) * period) % PTS_WRAP)
                due = pts
            elif state["n"] >= again:
                state.update(anchor=pts, n=1)
        return [(row.idx, state["locked"], due if state["locked"] else pts)]

    return fold(pictures.select("stream_id", "idx", "pts").where("pts is not null"), "stream_id", ["idx"], step, "idx long, locked boolean, clock long")


def switch_clock(packets: DataFrame, lead: int = 9000) -> DataFrame:
    """One clock and one continuity across source switches.

    ``packets(stream_id, seq, source, pid, cc, has_payload, pcr, pts)`` with 90 kHz
    clocks, null where a packet has none. The first clock of a new source is put ``lead``
    after the last one; from the first switch on a pid's count goes on from its last
    packet; the first PCR after a switch is flagged. Gives ``seq, out_cc, out_pcr,
    out_pts, flagged``."""

    def step(state, row):
        if not state:
            state.update(source=row.source, offset=0, last=None, waits=False, flag=False, moved=False, next={})
        elif state["source"] != row.source:
            state.update(source=row.source, waits=True, flag=True, moved=True)
        count = state["next"].get(row.pid, row.cc) if state["moved"] else row.cc
        state["next"][row.pid] = (count + bool(row.has_payload)) % 16
        first = row.pts if row.pcr is None else row.pcr
        if state["waits"] and first is not None:
            state.update(waits=False, offset=0 if state["last"] is None else (state["last"] + lead - first) % PTS_WRAP)
        flagged = state["flag"] and row.pcr is not None
        state["flag"] &= not flagged
        moved = [None if v is None else (v + state["offset"]) % PTS_WRAP for v in (row.pcr, row.pts)]
        state["last"] = max((v for v in (state["last"], *moved) if v is not None), default=None)
        return [(row.seq, count, *moved, flagged)]

    rows = packets.select("stream_id", "seq", "source", "pid", "cc", "has_payload", "pcr", "pts")
    return fold(rows, "stream_id", ["seq"], step, "seq long, out_cc int, out_pcr long, out_pts long, flagged boolean")


# --- decisions --------------------------------------------------------------------------


def failover_step(state: dict, row) -> list[tuple]:
    """One probe of T15; ``state`` holds what the next one needs."""
    if not state:
        state.update(first=row.ts, backup=False, healthy=0, next=None)
    if state["next"] is not None and row.ts < state["next"]:
        return []
    if not state["backup"]:
        if not row.active and row.ts - state["first"] < START_S or row.active and not row.stalled:
            return []
        to, cause = "backup", "input_silent"
    else:
        state["healthy"] = state["healthy"] + 1 if row.primary_healthy else 0
        state["next"] = row.ts + PROBE_S
        if state["healthy"] >= 2:
            to, cause = "primary", "primary_healthy_twice"
        elif not row.active:
            to, cause = "backup", "backup_stopped"
        else:
            return []
    # a switch that fails goes back to where it came from
    state.update(backup=(to == "backup") == bool(row.starts), healthy=0, next=row.ts + (PROBE_S if row.starts else RETRY_S))
    return [(row.ts, to, cause, bool(row.starts))]


def failover(probes: DataFrame) -> DataFrame:
    """Switches between primary and backup.

    ``probes(stream_id, ts, active, stalled, primary_healthy, starts)``, about one a
    second; ``starts`` says that a source started at that time would run. A stream that
    stalls or is not active moves to its backup, but one that is not active only
    ``START_S`` after its first start. On the backup the primary is probed every
    ``PROBE_S``; two healthy probes in a row move back, and a backup that stopped is
    started again. A switch that fails is rolled back and tried again after
    ``RETRY_S``."""
    rows = probes.select("stream_id", "ts", "active", "stalled", "primary_healthy", "starts")
    return fold(rows, "stream_id", ["ts"], failover_step, "ts long, source string, cause string, done boolean")


#: Seconds that a session may be idle.
IDLE_S = 120


def recheck_seconds(minutes: int) -> int:
    return min(60, max(1, minutes)) * 60


def registry_until(state: dict, now: int, recheck: int) -> list[tuple]:
    """What the session registry does by itself before ``now``: an unrevoked session that is
    open or not idle is checked again when that is due, and one that is neither is
    forgotten. ``state`` is a session's, empty if there is none."""
    out = []
    while state and not state["revoked"] and state["due"] < now and (state["open"] or state["due"] - state["seen"] <= IDLE_S):
        out.append((state["due"], None, True, state["verdict"]))
        if state["verdict"]:
            state["due"] += recheck
        else:
            state["revoked"] = True
    if state and not state["open"] and now - state["seen"] > IDLE_S:
        state.clear()
    return out


def registry_step(state: dict, row, recheck: int) -> list[tuple]:
    """One row of a session, after what was due before it."""
    out = registry_until(state, row.ts, recheck)
    if state and row.granted is not None:
        state["verdict"] = row.granted
    if row.kind == "request":
        if state and state["revoked"]:
            return [*out, (row.ts, row.request_id, False, False)]
        checked, granted = not state or row.ts >= state["due"], bool(row.granted)
        if not checked:
            state["seen"] = row.ts
        elif granted:
            state.update(seen=row.ts, due=row.ts + recheck, revoked=False, open=state.get("open", 0), verdict=True, hls=row.protocol == "hls")
        elif state and state["open"]:
            state["revoked"] = True
        else:
            state.clear()
        return [*out, (row.ts, row.request_id, checked, granted or not checked)]
    if not state:
        return out
    if row.kind == "revoke":
        state["revoked"] = True
    elif row.kind in ("open", "touch") and not state["revoked"]:
        state["seen"] = row.ts
        state["open"] += row.kind == "open"
    elif row.kind == "close":
        state["open"] = max(0, state["open"] - 1)
        if not state["open"] and not state["hls"]:
            state.clear()
    return out


def authorised(events: DataFrame, recheck_minutes: int = 10, now: int | None = None) -> DataFrame:
    """Verdicts of the session registry.

    ``events(session_id, ts, request_id, kind, granted)`` and, if it is there, ``protocol``
    (``hls`` otherwise); ``granted`` is what the back-end says of the session from then
    on, a null leaves it as it was and refuses a request that has to be checked. Kinds:
    ``request``; ``open`` and ``close`` of a connection; ``touch``, a sign of life;
    ``verdict``, the back-end's word alone; ``revoke``.

    A first request is checked. A granted session is cached until its recheck is due (1 to
    60 minutes); the registry then checks it without a request, as long as a connection
    is open or the session was seen within ``IDLE_S``, and revokes it if refused. A
    request at the very second checks itself: a refusal closes the session, or revokes
    it where connections are open. A revoked session refuses without a check. A session
    without connections is forgotten after more than ``IDLE_S``, and one that is not
    ``hls`` with its last connection.

    Gives ``ts, request_id, checked, allowed`` of each request and, with a null
    ``request_id``, of each recheck by the registry: those before a session's last row,
    and with ``now`` those before ``now`` (rows lie before it)."""
    recheck = recheck_seconds(recheck_minutes)
    names = ["session_id", "ts", "request_id", "kind", "granted"]
    rows = events.select(*names, *(["protocol"] if "protocol" in events.columns else [F.lit("hls").alias("protocol")]))
    if now is not None:
        ends = rows.groupBy("session_id").agg(F.lit(now).cast("long").alias("ts"), F.lit((1 << 63) - 1).alias("request_id"), F.lit("now").alias("kind"), F.lit(None).cast("boolean").alias("granted"), F.lit(None).cast("string").alias("protocol"))
        rows = rows.unionByName(ends)
    return fold(rows, "session_id", ["ts", "request_id"], lambda state, row: registry_step(state, row, recheck), "ts long, request_id long, checked boolean, allowed boolean")


def service_ids(services: DataFrame, base: int = 1) -> DataFrame:
    """A free id for each service of a multiplex. ``services(mux_id, ord,
    wanted)``: its own, or the base and its place, raised until it is free."""

    def step(state, row):
        later = state.setdefault("later", {})  # of an id in use: one to go on from, no free one lies before it
        wanted, passed = row.wanted or base + row.ord, []
        while wanted in later:
            passed.append(wanted)
            wanted = later[wanted]
        for used in (*passed, wanted):
            later[used] = wanted + 1
        return [(row.ord, wanted)]

    return fold(services.select("mux_id", "ord", "wanted"), "mux_id", ["ord"], step, "ord long, service_id long")


def unique_ids(rows: DataFrame) -> DataFrame:
    """An id for each new row of ``rows(id, ord, known)``: its own, or with the first
    number from 2 on behind it that makes one that is neither known nor given before.
    Gives ``ord, new_id``. Ids that can meet, equal but for such numbers, are one group."""

    def step(state, row):
        used = state.setdefault("used", set())
        own, n = row.id, 2
        while own in used and not row.known:
            own, n = f"{row.id}_{n}", n + 1
        used.add(own)
        return [] if row.known else [(row.ord, own)]

    named = rows.select(F.regexp_replace("id", "(_[0-9]+)+$", "").alias("stem"), (~F.col("known")).alias("later"), "ord", "id", "known")
    return fold(named, "stem", ["later", "ord"], step, "ord long, new_id string").drop("stem")
