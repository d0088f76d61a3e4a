"""Queries of the ordered folds. In DuckDB each is a recursive query: the state of a
stream is a row, and a step joins it with the stream's next row."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import folds, segmenter, timing
from . import relations as R
from .catalog import query

NOW = 1_706_000_000


def recursion(rows: str, order: str, first: str, step: str, out: str, *names: str, key: str = "stream_id") -> str:
    """DuckDB form of a fold over ``rows``: ``first`` makes the state ``s`` of a stream's
    first row ``r``, ``step`` the next one; ``out`` reads the states ``f``."""
    return R.oracle(f""", r as materialized (select *, row_number() over (partition by {key} order by {order}) as rn from ({rows})),
f as (select r.{key}, r.rn, {first} from r where r.rn = 1
  union all select r.{key}, r.rn, {step} from f s join r on r.{key} is not distinct from s.{key} and r.rn = s.rn + 1)
{out}""", *names, recursive=True)


@query(recursion("select * from quality", "ts, sample_id", "sample_id, ts, ts as at, true as kept",
                 "r.sample_id, r.ts, case when r.ts - s.at >= 7200 then r.ts else s.at end, r.ts - s.at >= 7200",
                 "select stream_id, sample_id, ts from f where kept", "quality"))
def t1_throttled_samples(spark, sf_dir: str):
    """T1"""
    return folds.throttle(R.quality(spark, sf_dir), 7200)


T4_RECENT, T4_TAKEN = f"r.ts >= {NOW - 86_400}", f"(r.ts >= {NOW - 86_400} or s.at is null or r.ts - s.at >= 7200)"


@query(recursion(f"select * from quality where ts >= {NOW - 864_000}", "ts, sample_id", f"r.sample_id, r.ts, case when not {T4_RECENT} then r.ts end as at, true as kept",
                 f"r.sample_id, r.ts, case when not {T4_RECENT} and {T4_TAKEN} then r.ts else s.at end, {T4_TAKEN}",
                 "select stream_id, sample_id, ts from f where kept", "quality"))
def t4_downsampled(spark, sf_dir: str):
    """T4"""
    return folds.downsample(R.quality(spark, sf_dir), NOW, keep_s=10 * 86_400, recent_s=86_400, step_s=7200)


def readings(spark, sf_dir: str):
    return R.packets(spark, sf_dir).where("pcr27 is not null").select("stream_id", "pid", F.col("seq").alias("idx"), "pcr27", "discontinuity", F.col("arrival_ms").alias("observed_ms"))


READINGS = "select p.stream_id, seq as idx, pcr27, discontinuity, arrival_ms as observed_ms from packets p join (select stream_id, arg_min(pid, seq) as pid from packets where pcr27 is not null group by 1) using (stream_id, pid) where pcr27 is not null"
TICKS = f"((r.pcr27 - s.pcr) % {folds.PCR_WRAP} + {folds.PCR_WRAP}) % {folds.PCR_WRAP}"



def machine(rows: str, order: str, columns: str, out: str, *names: str, key: str = "stream_id") -> str:
    """``recursion`` whose state columns are lines ``name: first value ; next value``. A next
    value names a column of its own step, from a line above, as ``$name``."""
    lines = [x.strip().split(": ", 1) for x in columns.strip().splitlines()]
    parts = [(name, *value.split(" ; ")) for name, value in lines]
    first = ", ".join(f"{a} as {name}" for name, a, _ in parts)
    step = ", ".join(f"{b.replace('$', 'n_')} as n_{name}" for name, _, b in parts)
    return recursion(rows, order, first, step, out, *names, key=key)


@query(machine(READINGS, "idx", f"""
    back: 0::bigint ; s.pcr - r.pcr27
    ticks: 0::bigint ; {TICKS}
    why: null::varchar ; case when r.discontinuity then 'discontinuity_flag' when $back > 0 and $back < 27000 or $ticks <= 54000000 then null when $back > 0 then 'backward_jump' else 'forward_jump' end
    moved: true ; $why is not null or $ticks between 27000 and 54000000
    idx: r.idx ; r.idx
    gap: 0::bigint ; case when $why is null then 0 else r.idx - s.at end
    wall: 0::bigint ; case when $why is null then 0 else greatest(0, r.observed_ms - s.seen) end
    jump: 0::bigint ; case when $why is null then 0 when $back > 0 then -($back * 1000 // 27000000) else $ticks * 1000 // 27000000 end
    at: r.idx ; case when $moved then r.idx else s.at end
    pcr: r.pcr27 ; case when $moved then r.pcr27 else s.pcr end
    seen: r.observed_ms ; case when $moved then r.observed_ms else s.seen end
    ns: 0::bigint ; case when $why is not null then 0 when $moved then s.ns + $ticks * 1000000000 // 27000000 else s.ns end
    epoch: 0::bigint ; case when $why is null then s.epoch else s.epoch + 1 end
""", "select stream_id, case when why is null then 'anchor' else 'reset' end as kind, idx, ns, epoch, why as cause, jump as jump_ms, wall as wall_gap_ms, gap as packet_gap from f where moved", "packets"))
def t18_clock_timeline(spark, sf_dir: str):
    """T18, T30"""
    return folds.clock_timeline(readings(spark, sf_dir))


@query(machine(READINGS, "idx", f"""
    delta: 0::bigint ; {TICKS}
    packets: 0::bigint ; r.idx - s.at
    taken: true ; r.discontinuity or $delta <> 0
    jumps: false ; $taken and (r.discontinuity or $delta > 270000000)
    known: false ; s.per is not null
    bridged: false ; $jumps and $known
    span: null::bigint ; case when $taken and not $jumps then $delta else s.span end
    per: null::bigint ; case when $taken and not $jumps then $packets else s.per end
    idx: r.idx ; r.idx
    ticks: 0::bigint ; case when not $taken then s.ticks when $bridged then s.ticks + $packets * $span // $per when $jumps then 0 else s.ticks + $delta end
    at: r.idx ; case when $taken then r.idx else s.at end
    pcr: r.pcr27 ; case when $taken then r.pcr27 else s.pcr end
""", "select stream_id, idx, ticks, bridged from f where taken", "packets"))
def t19_packet_schedule(spark, sf_dir: str):
    """T19"""
    return folds.packet_schedule(readings(spark, sf_dir))


@query(machine(READINGS, "idx", f"""
    delta: 0::bigint ; {TICKS}
    good: false ; not r.discontinuity and r.idx > s.idx and $delta between 27000 and 270000000
    ticks: 0::bigint ; case when not $good then 0 when s.done then $delta else s.ticks + $delta end
    packets: 0::bigint ; case when not $good then 0 when s.done then r.idx - s.idx else s.packets + r.idx - s.idx end
    done: false ; $ticks >= 13500000
    measured: null::bigint ; case when $done then greatest(1, $packets * 1504 * 27000000 // $ticks) end
    told: false ; coalesce($done and $packets * 1504 * 27000000 <= 200000000 * $ticks, false)
    rate: null::bigint ; case when not $told then s.rate when s.rate is null then $measured else (s.rate * 7 + $measured) // 8 end
    idx: r.idx ; r.idx
    pcr: r.pcr27 ; r.pcr27
""", "select stream_id, idx, measured as measured_bps, rate as rate_bps from f where told", "packets"))
def t20_source_rate(spark, sf_dir: str):
    """T20"""
    return folds.source_rate(readings(spark, sf_dir))


@query(machine("select stream_id, seq, arrival_ms from packets", "arrival_ms, seq", """
    n: 1::bigint ; case when s.done then 0 else s.n end + 1
    elapsed: 0::bigint ; r.arrival_ms - s.start
    done: false ; $elapsed >= 60000
    measured: null::bigint ; case when $done then $n * 1504 * 1000 // $elapsed end
    rate: null::bigint ; case when not $done then s.rate when coalesce(s.rate, 0) = 0 then $measured else (s.rate * 7 + $measured) // 8 end
    start: r.arrival_ms ; case when $done then r.arrival_ms else s.start end
    seq: r.seq ; r.seq
""", "select stream_id, seq, measured as measured_bps, rate as rate_bps from f where done", "packets"))
def t21_arrival_rate(spark, sf_dir: str):
    """T21"""
    return folds.arrival_rate(R.packets(spark, sf_dir).select("stream_id", "seq", "arrival_ms"), 60_000)


def probes(spark, sf_dir: str):
    any_of = lambda c: F.max(F.expr(c).cast("int")).cast("boolean")
    tests = {"active": "active", "stalled": "in_kbps < 100", "primary_healthy": "in_kbps > 200", "starts": "sample_id % 6 <> 0"}
    return R.quality(spark, sf_dir).groupBy("stream_id", "ts").agg(*[any_of(v).alias(k) for k, v in tests.items()])


@query(machine("select stream_id, ts, bool_or(active) as active, bool_or(in_kbps < 100) as stalled, bool_or(in_kbps > 200) as primary_healthy, bool_or(sample_id % 6 <> 0) as starts from quality group by 1, 2", "ts", """
    begun: r.ts ; s.begun
    ts: r.ts ; r.ts
    early: false ; coalesce(r.ts < s.wait, false)
    leave: r.active and r.stalled ; not $early and not s.backup and not (not r.active and r.ts - $begun < 5 or r.active and not r.stalled)
    healthy: 0 ; case when $early or not s.backup then s.count when r.primary_healthy then s.count + 1 else 0 end
    home: false ; not $early and s.backup and $healthy >= 2
    again: false ; not $early and s.backup and not $home and not r.active
    moves: r.active and r.stalled ; $leave or $home or $again
    done: r.starts ; r.starts
    backup: r.active and r.stalled and r.starts ; case when $moves then ($leave or $again) = r.starts else s.backup end
    wait: case when r.active and r.stalled then r.ts + case when r.starts then 5 else 10 end end ; case when $moves then r.ts + case when r.starts then 5 else 10 end when not $early and s.backup then r.ts + 5 else s.wait end
    count: 0 ; case when $moves then 0 else $healthy end
    cause: case when r.active and r.stalled then 'input_silent' end ; case when $leave then 'input_silent' when $home then 'primary_healthy_twice' when $again then 'backup_stopped' end
""", "select stream_id, ts, case when cause = 'primary_healthy_twice' then 'primary' else 'backup' end as source, cause, done from f where moves", "quality"))
def t15_failover(spark, sf_dir: str):
    """T15"""
    return folds.failover(probes(spark, sf_dir))


SEGMENT_MS = 3_600_000
#: Packets as the segmenter sees them, by expressions that both engines read.
CUT = {"clock": "case when pcr27 is not null then arrival_ms * 90 % 8589934592 end", "clear": "scrambling = 0", "random_access": "seq % 14 = 0", "pat": "seq % 50 = 0", "pmt": "seq % 70 = 0", "safe": "seq % 4 <> 1",
       "coded": "pid % 2 = 0", "starts": "pusi and seq % 6 <> 3", "picture": "case when pid % 2 = 0 and seq % 5 = 0 then case when seq % 15 = 0 then 'key' else 'other' end end"}


def cuts(begins: str, step: str, most: int) -> str:
    """Packets that are let through, by windows; then the cuts, packet by packet. What a
    held picture turns out to be is looked up ahead."""
    rows = f"""with x as (select stream_id, seq, pid, pusi, has_payload, {", ".join(f"{v} as {k}" for k, v in CUT.items())} from packets),
y as (select *, bool_or(pat) over w and bool_or(pmt) over w as psi from x window w as (partition by stream_id order by seq rows unbounded preceding)),
b as (select stream_id, min(seq) as began, arg_min(clock, seq) as clock0 from y where clock is not null and {begins} group by 1),
t as (select stream_id, pid, min(seq) as started from y join b using (stream_id) where seq >= began and has_payload and pusi and clear and safe group by 1, 2),
k as (select y.*, clock0, sum(case when pusi and clear then 1 else 0 end) over (partition by stream_id, pid order by seq) as unit from y join b using (stream_id) left join t using (stream_id, pid) where seq >= began and (not has_payload or seq >= started)),
u as (select stream_id, pid, unit, min(seq) as begin, min(seq) filter (where picture is not null) as seen, arg_min(picture, seq) filter (where picture is not null) as kind, lead(min(seq)) over (partition by stream_id, pid order by unit) - 1 as rest from k group by 1, 2, 3)
select k.*, pusi and has_payload and clear and coded and starts as candidate, random_access or coalesce(kind = 'key', false) as key, case when random_access then seq else coalesce(seen, rest, 9223372036854775807) end as until from k join u using (stream_id, pid, unit)"""
    due = f"90000::bigint * case when s.n = 0 then 1000 else {SEGMENT_MS} end"
    return machine(rows, "seq", f"""
    seq: r.seq ; r.seq
    last: coalesce(r.clock, r.clock0) ; coalesce(r.clock, s.last)
    ticks: 0::bigint ; ($last - s.origin + 8589934592) % 8589934592
    {step.replace("DUE", due)}
    n: 0::bigint ; s.n + case when $cut then 1 else 0 end
    origin: r.clock0 ; case when $cut then $last else s.origin end
    closed: null::bigint ; case when $cut then least(greatest($ticks * 1000 // 90000, 50), {most}) end
""", ", d as (select stream_id, n as segment, min(seq) as first_seq, max(seq) as last_seq, count(*) as packets, max(closed) as closed from f group by 1, 2) select * exclude (closed, duration_ms), duration_ms from (select *, lead(closed) over (partition by stream_id order by segment) as duration_ms from d) where duration_ms is not null", "packets")


def cut_rows(spark, sf_dir: str, has_coded: bool = False):
    rows = R.packets(spark, sf_dir).select("stream_id", "seq", "pid", "pusi", "has_payload", *[F.expr(v).alias(k) for k, v in CUT.items()])
    return rows.withColumns({"table": F.lit(False), "bytes": F.lit(100), "has_coded": F.lit(has_coded)})


@query(cuts("pusi and psi", "cut: false ; r.clock is not null and $ticks * 1000 >= DUE and (r.pusi or $ticks * 1000 >= 3 * DUE)", 3 * SEGMENT_MS))
def t10_segment_cuts(spark, sf_dir: str):
    """T10"""
    return segmenter.segments(segmenter.dealt(cut_rows(spark, sf_dir), SEGMENT_MS))


@query(cuts("pusi and psi", """live: true ; r.seq > s.busy
    arm: false ; $live and (s.armed or $ticks * 1000 >= DUE)
    cut: false ; $arm and r.candidate and r.key
    armed: false ; case when $live then $arm and not $cut else s.armed end
    busy: -1::bigint ; case when not $live then s.busy when $arm and r.candidate then r.until else -1 end""", 3 * SEGMENT_MS))
def t10_picture_cuts(spark, sf_dir: str):
    """T10 before key pictures, whose type is known some packets later"""
    return segmenter.segments(segmenter.dealt(cut_rows(spark, sf_dir, True), SEGMENT_MS))


@query(cuts("random_access", "cut: false ; r.clock is not null and r.random_access and $ticks * 1000 >= DUE", 60_000))
def t10_random_access_cuts(spark, sf_dir: str):
    """T10 at random access"""
    return segmenter.segments(segmenter.dealt(cut_rows(spark, sf_dir), SEGMENT_MS, True))


@query(machine("select stream_id, sequence, duration_ms * 500 as bytes, duration_ms from segments", "sequence", """
    sequence: r.sequence ; r.sequence
    bytes: r.bytes ; case when s.full then 0 else s.bytes end + r.bytes
    ms: r.duration_ms ; case when s.full then 0 else s.ms end + r.duration_ms
    full: r.duration_ms >= 12000 ; $ms >= 12000
    bps: r.bytes * 8000 // r.duration_ms ; $bytes * 8000 // $ms
""", "select stream_id, sequence, bps from f", "segments"))
def t34_input_rate(spark, sf_dir: str):
    """T34"""
    return folds.input_rate(R.segments(spark, sf_dir).select("stream_id", "sequence", (F.col("duration_ms") * 500).alias("bytes"), "duration_ms"))


PICTURES = "select stream_id, sequence as idx, (8589900000 + sequence * 3600 + case when sequence % 90 > 60 then sequence * 900 else sequence % 5 * 400 end + case when sequence % 300 >= 200 then 400000 else 0 end) % 8589934592 as pts from segments"


def pictures(spark, sf_dir: str):
    pts = "(8589900000 + sequence * 3600 + case when sequence % 90 > 60 then sequence * 900 else sequence % 5 * 400 end + case when sequence % 300 >= 200 then 400000 else 0 end) % 8589934592"
    return R.segments(spark, sf_dir).select("stream_id", F.col("sequence").alias("idx"), F.expr(pts).alias("pts"))


WRAP, HALF = folds.PTS_WRAP, folds.PTS_WRAP // 2


@query(machine(PICTURES, "idx", f"""
    idx: r.idx ; r.idx
    due: r.pts ; (s.anchor + s.n * 3600) % {WRAP}
    gap: 0::bigint ; (r.pts - $due + {WRAP + HALF}) % {WRAP} - {HALF}
    fresh: true ; s.locked and abs($gap) > 90000
    k: 1::bigint ; case when $fresh then 1 else s.n + 1 end
    locks: false ; not $fresh and not s.locked and $k >= 25 and abs($gap) <= 10800
    late: false ; not $fresh and not s.locked and not $locks and $k >= 100
    n: 1::bigint ; case when $late then 1 else $k end
    anchor: r.pts ; case when $fresh or $late then r.pts when $locks then ((r.pts - ($k - 1) * 3600) % {WRAP} + {WRAP}) % {WRAP} else s.anchor end
    locked: false ; $locks or s.locked and not $fresh
    clock: r.pts ; case when $locks or not $locked then r.pts else $due end
""", "select stream_id, idx, locked, clock from f", "segments"))
def t31_clock_lock(spark, sf_dir: str):
    """T31"""
    return folds.clock_lock(pictures(spark, sf_dir))


AUTH = "select user_id as session_id, cast(floor(epoch(ts)) as bigint) // 40 as ts, event_id as request_id, case when event_id % 11 = 0 then 'revoke' else 'request' end as kind, event_id % 5 <> 0 as granted from events"


def registry(rows: str, recheck: int) -> str:
    """The session registry without connections, for rechecks at least ``IDLE_S`` apart."""
    return machine(rows, "ts, request_id", f"""
    ts: r.ts ; r.ts
    request_id: r.request_id ; r.request_id
    request: r.kind = 'request' ; r.kind = 'request'
    worker: null::bigint ; case when s.seen is not null and not s.revoked and s.due < r.ts and s.due - s.seen <= 120 then s.due end
    answer: null::boolean ; case when $worker is not null then s.verdict end
    there: false ; coalesce(s.seen is not null and r.ts - s.seen <= 120, false)
    denied: false ; $there and (s.revoked or coalesce(not $answer, false))
    checked: r.kind = 'request' ; $request and not $denied and (not $there or r.ts >= s.due + case when $answer then {recheck} else 0 end)
    allowed: r.kind = 'request' and r.granted ; $request and not $denied and (not $checked or r.granted)
    due: case when r.kind = 'request' and r.granted then r.ts + {recheck} end ; case when $checked and r.granted then r.ts + {recheck} when $there then s.due + case when $answer then {recheck} else 0 end end
    seen: case when r.kind = 'request' and r.granted then r.ts end ; case when $allowed then r.ts when $there and not ($checked and not r.granted) then s.seen end
    revoked: false ; $there and ($denied or not $request)
    verdict: r.granted ; r.granted
""", "select session_id, ts, request_id, checked, allowed from f where request union all select session_id, worker, null, true, answer from f where worker is not null", key="session_id")


@query(registry(AUTH, 600))
def t17_authorised_requests(spark, sf_dir: str):
    """T17"""
    e = R.table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.floor(R.seconds("ts") / 40).alias("ts"), F.col("event_id").alias("request_id"), F.expr("case when event_id % 11 = 0 then 'revoke' else 'request' end").alias("kind"), F.expr("event_id % 5 <> 0").alias("granted"))
    return folds.authorised(e)


BUSY = "select user_id % 5 as session_id, cast(floor(epoch(ts)) as bigint) // 400 as ts, event_id as request_id, case when event_id % 211 = 0 then 'revoke' else 'request' end as kind, event_id % 7 <> 0 as granted from events"


@query(registry(BUSY, 120))
def t17_rechecked_sessions(spark, sf_dir: str):
    """Busy sessions, checked again every two minutes by the registry itself"""
    e = R.table(spark, sf_dir, "events").select(F.expr("user_id % 5").alias("session_id"), F.floor(R.seconds("ts") / 400).alias("ts"), F.col("event_id").alias("request_id"), F.expr("case when event_id % 211 = 0 then 'revoke' else 'request' end").alias("kind"), F.expr("event_id % 7 <> 0").alias("granted"))
    return folds.authorised(e, 2)


MUX = "select c_nationkey as mux_id, c_custkey as ord, case when c_custkey % 3 = 0 then null else c_custkey % 7 + 1 end as wanted from customer"


@query(machine(MUX, "ord", """
    ord: r.ord ; r.ord
    wish: coalesce(r.wanted, 1 + r.ord) ; coalesce(r.wanted, 1 + r.ord)
    service_id: coalesce(r.wanted, 1 + r.ord) ; list_min(list_filter(range($wish, $wish + len(s.used) + 1), lambda x: not list_contains(s.used, x)))
    used: [coalesce(r.wanted, 1 + r.ord)] ; list_append(s.used, $service_id)
""", "select mux_id, ord, service_id from f", key="mux_id"))
def w13_service_ids(spark, sf_dir: str):
    """W13"""
    wanted = F.expr("case when c_custkey % 3 = 0 then null else c_custkey % 7 + 1 end")
    return folds.service_ids(R.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("mux_id"), F.col("c_custkey").alias("ord"), wanted.alias("wanted")))


SWITCHED = f"""select stream_id, seq, (seq // 400) % 3 as source, pid, cc, has_payload, case when pcr27 is not null then (pcr27 // 300 + (seq // 400) % 3 * 5000000) % {WRAP} end as pcr,
  case when pts is not null then (pts + (seq // 400) % 3 * 5000000) % {WRAP} end as pts from packets where afc <> 0"""


@query(machine(f"select *, coalesce(pcr, pts) as first_clock from ({SWITCHED})", "seq", f"""
    seq: r.seq ; r.seq
    source: r.source ; r.source
    flag_due: false ; s.flag_left or r.source <> s.source
    waits: false ; s.waits_left or r.source <> s.source
    offset_now: 0::bigint ; case when not $waits or r.first_clock is null then s.offset_now when s.newest is null then 0 else ((s.newest + 9000 - r.first_clock) % {WRAP} + {WRAP}) % {WRAP} end
    waits_left: false ; $waits and r.first_clock is null
    flagged: false ; $flag_due and r.pcr is not null
    flag_left: false ; $flag_due and r.pcr is null
    out_pcr: r.pcr ; (r.pcr + $offset_now) % {WRAP}
    out_pts: r.pts ; (r.pts + $offset_now) % {WRAP}
    newest: greatest(r.pcr, r.pts) ; greatest(s.newest, $out_pcr, $out_pts)
""", f""", c as (select stream_id, seq, cc, has_payload, pid, calm,
   coalesce(max(case when calm then seq end) over w, min(seq) over w) as base from (select *, coalesce(seq < min(case when source <> first_source then seq end) over (partition by stream_id), true) as calm from (select *, first_value(source) over (partition by stream_id order by seq) as first_source from ({SWITCHED}))) window w as (partition by stream_id, pid)),
  b as (select c.*, (select any_value(x.cc) from c x where x.stream_id = c.stream_id and x.pid = c.pid and x.seq = c.base) as base_cc,
   count(*) filter (where has_payload and seq >= base) over (partition by stream_id, pid order by seq rows between unbounded preceding and 1 preceding) as paid from c)
  select f.stream_id, f.seq, cast(case when b.calm or b.seq = b.base then b.cc else (base_cc + paid) % 16 end as int) as out_cc, out_pcr, out_pts, flagged from f join b using (stream_id, seq)""", "packets"))
def t29_switched_clock(spark, sf_dir: str):
    """T29"""
    source = F.expr("(seq div 400) % 3")
    p = R.packets(spark, sf_dir).where("afc <> 0").withColumn("source", source)
    moved = lambda c: F.pmod(F.expr(c) + source * 5_000_000, F.lit(WRAP))
    return folds.switch_clock(p.withColumn("pcr", moved("pcr27 div 300")).withColumn("pts", moved("pts")))


def ordered(stamps: str) -> str:
    return f"list_sort(list_transform({stamps}, lambda x: (x - ({stamps})[1] + {WRAP + HALF}) % {WRAP} - {HALF}))"


RATE_ROWS = f"select stream_id * 100000 + sequence // 200 as stream_id, sequence as idx, case when sequence % 97 = 50 then null else (8589900000 + sequence * case when sequence % 400 < 250 then 3600 else 3003 end + case sequence % 3 when 0 then 7200 else -3600 end + case when sequence % 400 = 399 then 2000000 else 0 end) % {WRAP} end as pts from segments"


@query(machine(RATE_ROWS, "idx", f"""
    idx: r.idx ; r.idx
    held: case when r.pts is null then []::bigint[] else [r.pts] end ; case when r.pts is null then []::bigint[] when s.wiped then [r.pts] else list_append(list_slice(s.held, greatest(1, len(s.held) - 31), len(s.held)), r.pts) end
    own: []::bigint[] ; case when len($held) = 33 then {ordered('$held')} when len($held) >= 5 then {ordered('list_slice($held, len($held) - 4, len($held))')} else [] end
    wiped: r.pts is null ; r.pts is null or len($held) = 33 and not ($own[33] - $own[1] > 0 and $own[33] - $own[1] <= 900000)
    gaps: []::bigint[] ; case when $wiped then [] else list_sort(list_transform(range(1, greatest(1, len($own))), lambda i: $own[i + 1] - $own[i])) end
    middle: 0::double ; case when len($gaps) = 0 then 0 else ($gaps[len($gaps) // 2] + $gaps[len($gaps) // 2 + 1]) / 2.0 end
    fps: 0::double ; case when $middle > 0 then 90000 / $middle else 0 end
    is_25: false ; case when len($gaps) = 32 then $fps between 23.5 and 26.5 else len($gaps) = 4 and len(list_filter($gaps, lambda g: g between 3450 and 3750)) >= 3 and $middle between 3450 and 3750 end
""", "select stream_id, idx, fps::double as fps, is_25 from f", "segments"))
def a17_picture_rate(spark, sf_dir: str):
    """A17"""
    pts = f"case when sequence % 97 = 50 then null else (8589900000 + sequence * case when sequence % 400 < 250 then 3600 else 3003 end + case sequence % 3 when 0 then 7200 else -3600 end + case when sequence % 400 = 399 then 2000000 else 0 end) % {WRAP} end"
    return timing.picture_rate(R.segments(spark, sf_dir).select(F.expr("stream_id * 100000 + sequence div 200").alias("stream_id"), F.col("sequence").alias("idx"), F.expr(pts).alias("pts")))


@query(R.oracle(""", s as (select stream_id, sequence as idx, wall_ts * 90 as pts from segments), f as (select stream_id, min(pts) as a, max(pts) - min(pts) + 3600 as span from s group by 1)
select stream_id, loop, idx, pts - a + loop * span as out_pts from s join f using (stream_id), range(3) l(loop)""", "segments"))
def s3_replayed_file(spark, sf_dir: str):
    """S3, T28"""
    s = R.segments(spark, sf_dir).select("stream_id", F.col("sequence").alias("idx"), (F.col("wall_ts") * 90).alias("pts"))
    return timing.replayed(s, 3).select("stream_id", "loop", "idx", "out_pts")
