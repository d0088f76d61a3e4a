"""Queries of access units and their times. Each event stands for a PES unit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import timing
from ..sources import nested, pictures
from . import relations as R
from .catalog import query
from .fold_queries import HALF, WRAP, machine
from .table_queries import UNITS, hexed, unit_packets

RECOVERED = f"""
    idx: r.idx ; r.idx
    guess: null::bigint ; (s.clock + r.step) % {WRAP}
    ahead: null::bigint ; (s.decoding + r.step) % {WRAP}
    gap: 0::bigint ; coalesce((r.pts - $guess + {WRAP + HALF}) % {WRAP} - {HALF}, 0)
    locked: false ; s.locked or r.pts is not null and ($guess is null or abs($gap) > 45000)
    taken: false ; $locked and r.pts is not null
    clock: r.start_pts ; case when $taken then r.pts else $guess end
    decoding: r.start_dts ; case when $taken then r.dts else $ahead end
    corrected: false ; $taken and ($guess is distinct from r.pts or $ahead is distinct from r.dts)
"""

TIMES = f"""select stream_id, sequence as idx, case when sequence % 4 <> 1 then clock90 end as pts, case when sequence % 4 <> 1 then (clock90 + {WRAP} - sequence % 2 * 3600) % {WRAP} end as dts,
  case when sequence % 7 = 3 then 1800 else 3600 end as step, first_value(clock90) over o as start_pts, first_value(clock90) over o as start_dts
from (select stream_id, sequence, (8589900000 + sequence * 3600 + sequence % 3 * 300 + case when sequence % 200 > 150 then 50000 else 0 end) % {WRAP} as clock90 from segments) window o as (partition by stream_id order by sequence)"""


@query(machine(TIMES, "idx", RECOVERED, "select stream_id, idx, clock as pts, decoding as dts, corrected from f", "segments"))
def t24_recovered_times(spark, sf_dir: str):
    """T24"""
    rows = R.segments(spark, sf_dir).selectExpr("stream_id", "sequence", f"(8589900000 + sequence * 3600 + sequence % 3 * 300 + case when sequence % 200 > 150 then 50000 else 0 end) % {WRAP} as at")
    own = "over (partition by stream_id order by sequence)"
    rows = rows.selectExpr("stream_id", "sequence as idx", "case when sequence % 4 <> 1 then at end as pts", f"case when sequence % 4 <> 1 then (at + {WRAP} - sequence % 2 * 3600) % {WRAP} end as dts",
                           "case when sequence % 7 = 3 then 1800 else 3600 end as step", f"first(at) {own} as start_pts", f"first(at) {own} as start_dts")
    return timing.recovered_times(rows, ["stream_id"], "idx").select("stream_id", "idx", "pts", "dts", "corrected")


@query(machine(f"""select stream_id, idx, pid, seq, (case when idx = n - 1 then size + rest else size end)::bigint as size, case when idx = n - 1 then random_access or later else random_access end as key,
  pts, dts, 3600 as step, pts as start_pts, dts as start_dts
from ({UNITS} select *, row_number() over o as idx, count(*) over (partition by stream_id) as n, lead(size) over o as rest, lead(random_access) over o as later from units window o as (partition by stream_id order by seq)) where idx < n""",
               "idx", "seq: r.seq ; r.seq\n pid: r.pid ; r.pid\n size: r.size ; r.size\n key: r.key ; r.key\n" + RECOVERED.strip("\n"),
               "select stream_id, pid, seq, clock as pts, decoding as dts, size, key, 1::integer as pictures, corrected from f"))
def p16_access_units(spark, sf_dir: str):
    """Pictures of one slice, each in a PES unit; the last two are one unit"""
    return pictures.access_units(nested.pes_units(unit_packets(spark, sf_dir)))


#: Parameter sets of a stream with four bits of a frame number and fields.
SETS = "00000001674D0000ED0168490000000168E8"


def field_units(spark, sf_dir: str) -> DataFrame:
    """PES units, one an event: bytes that end the picture before, a delimiter, at times the
    parameter sets, and a slice of a field or of a frame."""
    e = R.table(spark, sf_dir, "events").selectExpr("user_id % 4 as stream_id", "cast(100 + user_id % 4 as int) as pid", "event_id as seq", f"(8589900000 + event_id * 900) % {WRAP} as at")
    head = hexed(("case when seq % 10 = 0 then 101 else 65 end", 2), ("224 + floor(seq / 2) % 16 * 2 + case when seq % 3 <> 0 then 1 else 0 end", 2), ("case when seq % 3 = 0 then 128 else seq % 2 * 128 + 64 end", 2))
    data = f"concat(unhex(repeat('5A', cast(seq % 4 as int))), x'0000000109F0', case when seq % 6 = 0 then x'{SETS}' else x'' end, x'00000001', {head}, unhex(repeat('5A', cast(10 + seq % 7 as int))))"
    timed = "seq % 4 <> 1"
    return e.select("stream_id", "pid", "seq", F.expr(f"case when {timed} then at end").alias("pts"), F.expr(f"case when {timed} then (at + {WRAP} - seq % 2 * 3600) % {WRAP} end").alias("dts"), F.expr(data).alias("data"))


#: Of the fixture in SQL: ``a`` has a row an access unit, with the timestamp that belongs to it.
FIELDS = f"""with e as (select user_id % 4 as stream_id, cast(100 + user_id % 4 as int) as pid, event_id as seq, event_id // 2 % 16 as frame, event_id % 3 <> 0 as field, event_id % 10 = 0 as key,
  event_id % 4 as tail, event_id % 4 + 6 + case when event_id % 6 = 0 then {len(SETS) // 2} else 0 end + 7 + 10 + event_id % 7 as bytes, case when event_id % 4 <> 1 then (8589900000 + event_id * 900) % {WRAP} end as pts from events),
p as (select *, bool_or(seq % 6 = 0) over o as parsed, lead(seq) over o is null as last, sum(bytes) over o - bytes + tail as begin, sum(bytes) over (partition by stream_id) as total from e window o as (partition by stream_id order by seq)),
l as (select *, coalesce(parsed and lag(parsed) over o and field and lag(field) over o and frame = lag(frame) over o and seq % 2 <> lag(seq) over o % 2 and not last, false) as other from p window o as (partition by stream_id order by seq)),
g as (select *, sum(case when other then 0 else 1 end) over (partition by stream_id order by seq) as run from l),
s as (select *, not last and (not other or row_number() over (partition by stream_id, run order by seq) % 2 = 1) as opens from g),
n as (select *, sum(case when opens then 1 else 0 end) over (partition by stream_id order by seq) as unit, case when pts is null then null else (pts + {WRAP} - seq % 2 * 3600) % {WRAP} end as dts from s),
own as (select stream_id, unit + case when opens then 0 else 1 end as unit, max_by(pts, seq) as pts, max_by(dts, seq) as dts from n where pts is not null group by 1, 2),
u as (select stream_id, pid, unit, min(seq) as seq, min(begin) as begin, max(total) as total, bool_or(key) as key, sum(case when last then 0 else 1 end)::integer as pictures, arg_min(parsed and field, seq) as field from n group by 1, 2, 3),
a as (select u.stream_id, u.pid, u.unit as idx, u.seq, (coalesce(lead(u.begin) over o, u.total) - u.begin)::bigint as size, u.key, u.pictures, own.pts, own.dts,
  lag(case when u.field and u.pictures = 1 then 1800 else 3600 end) over o as step, first_value(own.pts) over o as start_pts, first_value(own.dts) over o as start_dts
  from u left join own using (stream_id, unit) window o as (partition by u.stream_id order by u.unit))"""


@query(FIELDS + " select stream_id, pid, seq, size, key, pictures from a")
def p16_field_pairs(spark, sf_dir: str):
    """Fields of a frame in one unit, by the numbers in their slices"""
    return pictures.access_units(field_units(spark, sf_dir)).select("stream_id", "pid", "seq", "size", "key", "pictures")


@query(machine(FIELDS + " select * from a", "idx", "seq: r.seq ; r.seq\n" + RECOVERED.strip("\n"), "select stream_id, seq, clock as pts, decoding as dts, corrected from f"))
def t24_picture_times(spark, sf_dir: str):
    """Times of access units whose PES units begin inside the picture before"""
    return pictures.access_units(field_units(spark, sf_dir)).select("stream_id", "seq", "pts", "dts", "corrected")
