"""Queries of remapped services and multiplexes. The events are four streams of media
packets; every fifty packets a program table and a map come before one, and the map's
content changes every two of them. The results are read back from the output's packets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources import sections as S
from ..sources import services, transport
from . import relations as R
from .catalog import query

#: Media packets between two tables, and the first event of stream 3 behind its silence.
EVERY, BACK = 50, 400
ROWS = f"""m as (select *, (rn - 1) // {EVERY} as t, 513 + k as pid, rn % {EVERY} = 1 as tabled from (
  select user_id % 4 as stream_id, user_id // 4 % 3 as k, event_id, event_id * 8 + 4 as seq, event_id * 10 + case when user_id % 4 = 3 and event_id >= {BACK} then 20000 else 0 end as arrival_ms,
  row_number() over (partition by user_id % 4 order by event_id) as rn from events))"""


def capture(spark, sf_dir: str) -> DataFrame:
    """``stream_id, seq, arrival_ms, pid, pkt`` of media, program tables and maps."""
    e = R.table(spark, sf_dir, "events").select(
        F.expr("user_id % 4").alias("stream_id"), F.expr("cast(513 + user_id div 4 % 3 as int)").alias("pid"), "event_id",
        F.expr(f"event_id * 10 + case when user_id % 4 = 3 and event_id >= {BACK} then 20000 else 0 end").alias("arrival_ms"))
    e = e.withColumn("rn", F.row_number().over(W.partitionBy("stream_id").orderBy("event_id")))
    cc = (F.row_number().over(W.partitionBy("stream_id", "pid").orderBy("event_id")) - 1) % 16
    media = e.select("stream_id", F.expr("event_id * 8 + 4").alias("seq"), "arrival_ms", "pid", F.unhex(F.concat(F.format_string("47%04X%02X", "pid", cc + 16), F.lit("AA" * 184))).alias("pkt"))
    tables = e.where(f"rn % {EVERY} = 1").withColumn("t", F.expr(f"cast((rn - 1) div {EVERY} as bigint)"))
    head = "unhex(concat('E201', 'F000', '1BE201F000', case when t % 4 < 2 then '0FE202F000' else '' end, '06E203F0036A0100'))"
    programs = tables.select("stream_id", F.lit(0).alias("pid"), F.col("t").alias("ord"), F.lit(0).alias("table_id"), F.lit(9).alias("extension"), F.lit(0).alias("version"), F.unhex(F.format_string("%04XE12C", F.col("stream_id") + 7)).alias("body"))
    maps = tables.select("stream_id", F.lit(300).alias("pid"), F.col("t").alias("ord"), F.lit(2).alias("table_id"), (F.col("stream_id") + 7).cast("int").alias("extension"), F.lit(5).alias("version"), F.expr(head).alias("body"))
    sealed = S.sealed(programs.unionByName(maps).withColumns({"number": F.lit(0), "last_number": F.lit(0)}))
    sent = S.packetised(sealed, places=True).drop("seq").withColumnRenamed("ord", "t")
    sent = sent.join(tables.select("stream_id", "t", "event_id", "arrival_ms"), ["stream_id", "t"])
    return media.unionByName(sent.select("stream_id", (F.col("event_id") * 8 + F.when(F.col("pid") == 0, 0).otherwise(1)).alias("seq"), "arrival_ms", F.col("pid").cast("int").alias("pid"), "pkt"))


def contents(sections: DataFrame) -> DataFrame:
    """Sections that are equal byte for byte once, where the first one is: for readers of
    what a multiplex says, not of when."""
    return sections.groupBy("stream_id", "pid", "table_id", "bytes", "crc_ok").agg(F.min("seq").alias("seq"))


def read_back(parsed: DataFrame, key: str) -> DataFrame:
    """Packets with payload and marked discontinuities by pid."""
    return parsed.groupBy(key, "pid").agg(F.sum(F.col("has_payload").cast("long")).alias("packets"), F.sum(F.col("discontinuity").cast("long")).alias("marks"))


@query(f"""with {ROWS}, g as (select *, t // 2 as gen, t % 4 < 2 as whole from m),
media as (select stream_id, case when pid = 513 then 1001 else 1002 end as pid, gen from g where pid = 513 or whole and pid = 514 or not whole and pid = 515),
marks as (select stream_id, pid, count(distinct gen) filter (where gen > 0) as marks from media group by 1, 2), sums as (select stream_id, pid, count(*) as packets from media group by 1, 2),
seen as (select stream_id, gen, arrival_ms from g union all select stream_id, case when t % 2 = 0 then gen - 1 else gen end, arrival_ms from g where tabled and t > 0),
tables as (select stream_id, count(distinct (gen, arrival_ms // 100)) as n, count(distinct (gen, arrival_ms // 500)) as s from seen group by 1)
select stream_id, pid, packets, marks from sums join marks using (stream_id, pid) union all select stream_id, 0, n, 0 from tables union all select stream_id, 1000, n, 0 from tables union all select stream_id, 17, s, 0 from tables""")
def p15_remapped_services(spark, sf_dir: str) -> DataFrame:
    """Services under other ids and pids, with new tables, one of two audio streams
    and marks where the map changes"""
    plans = spark.range(4).select(F.col("id").alias("stream_id"), (F.col("id") + 7).cast("int").alias("sid"), (F.col("id") + 70).cast("int").alias("new_sid"), *(F.lit(v).alias(k) for k, v in {"map_pid": 1000, "video_pid": 1001, "audio_pid": 1002, "wanted_audio": 514, "provider": "P", "name": "N"}.items()))
    return read_back(transport.parse_headers(services.remapped_service(services.written(capture(spark, sf_dir)), plans).select("stream_id", "pkt")), "stream_id")


@query(f"""with {ROWS}, back as (select min(rn) as rn, min(t) as t from m where stream_id = 3 and event_id >= {BACK}),
media as (select m.stream_id, m.pid from m, back where (pid <> 514 or m.t % 4 < 2) and not (stream_id = 3 and m.t = back.t and m.rn >= back.rn and back.rn % {EVERY} <> 1))
select 256 + 32 * stream_id + pid - 513 as pid, count(*) as packets, 0 as marks, 200 + stream_id as sid, 'S' || stream_id as name from media group by stream_id, pid""")
def u1_multiplex(spark, sf_dir: str) -> DataFrame:
    """A multiplex in datagrams, with the services that its tables name"""
    listed = spark.range(4).select(F.lit(0).cast("long").alias("mux_id"), F.col("id").alias("ord"), F.col("id").alias("stream_id"), (F.col("id") + 200).cast("int").alias("service_id"), F.lit("P").alias("provider"), F.concat(F.lit("S"), "id").alias("name"))
    sent = services.datagrams(services.multiplex(services.written(capture(spark, sf_dir)), listed))
    packets = sent.select(F.col("mux_id").alias("stream_id"), "datagram", F.posexplode(F.expr("transform(sequence(0, octet_length(data) div 188 - 1), i -> substring(data, i * 188 + 1, 188))")))
    packets = packets.select("stream_id", (F.col("datagram") * 7 + F.col("pos")).alias("seq"), F.col("col").alias("pkt"), F.col("col").alias("raw"))
    known = services.written(transport.parse_headers(packets, "raw").select("stream_id", "seq", "pid", "pkt", "has_payload", "discontinuity"))
    maps = S.pmt(contents(S.assemble(known.where("pid between 32 and 255"), S.GUIDE))).select("sid", F.col("es_pid").alias("pid")).distinct()
    names = S.sdt(contents(S.assemble(known.where("pid = 17"), S.GUIDE))).select("sid", "name").distinct()
    return read_back(known, "stream_id").drop("stream_id").join(maps, "pid").join(names, "sid").select("pid", "packets", "marks", "sid", "name")
