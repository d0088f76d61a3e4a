"""Queries of scalar functions, files, routing, health and the smaller operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import continuity, guide, health, hls, logs, quality, sessions
from ..sources import captures, files, foreign, nested, transport
from ..sources.scratch import folder
from . import api
from . import relations as R
from .catalog import query
from .fold_queries import machine
from .table_queries import hexed, unit_packets

#: Records that a file of a guide cache is written with.
CACHE_FILE = 100_000
NOW, GUIDE_NOW = 1_706_000_000, 852_076_800


def parts(spark, sf_dir: str) -> DataFrame:
    return R.table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "id")


# --- scalars ------------------------------------------------------------------------------------


@query("select p_partkey as id, case when p_partkey % 70 <= 59 and p_size % 64 <= 59 then (p_partkey % 100) * 3600 + (p_partkey % 70) * 60 + p_size % 64 end as seconds from part")
def x2_durations(spark, sf_dir: str):
    """X2"""
    coded = lambda e: F.expr(f"cast(({e}) div 10 * 16 + ({e}) % 10 as int)")
    return parts(spark, sf_dir).select("id", X.dvb_duration(coded("id % 100"), coded("id % 70"), coded("p_size % 64")).alias("seconds"))


@query(r"""select p_partkey as id, trim(regexp_replace(p_name || chr(9) || '  of ' || p_type || chr(10), '[ \t\n\x0B\f\r]+', ' ', 'g')) as text from part""")
def x8_compacted(spark, sf_dir: str):
    """X8"""
    return parts(spark, sf_dir).select("id", X.compact(F.concat("p_name", F.lit("\t  of "), "p_type", F.lit("\n"))).alias("text"))


@query("select p_partkey as id, case when p_partkey % 4 <> 0 then p_type end as value, case when p_partkey % 3 <> 0 then '' || p_size end as size from part")
def x10_query_values(spark, sf_dir: str):
    """X10"""
    query = F.concat(F.lit("http://h/p?x=1"), F.expr("case when id % 4 <> 0 then concat('&type=', url_encode(p_type)) else '' end"), F.expr("case when id % 3 <> 0 then concat('&size=', p_size) else '' end"), F.lit("#f"))
    return parts(spark, sf_dir).withColumn("u", query).select("id", X.query_value("u", "type").alias("value"), X.query_value("u", "size").alias("size"))


WIDE = "list_reduce(list_prepend(14695981039346656037::uhugeint, list_transform(string_split(p_name, ''), lambda c: ascii(c)::uhugeint)), lambda h, b: xor(h, b) * 1099511628211 % 18446744073709551616)"
NARROW = "list_reduce(list_prepend(2166136261::ubigint, list_transform(string_split(p_name, ''), lambda c: ascii(c)::ubigint)), lambda h, b: xor(h, b) * 16777619 % 4294967296)"


@query(f"select p_partkey as id, (case when h >= 9223372036854775808 then h::hugeint - 18446744073709551616 else h::hugeint end)::bigint as hash, cast(n % 13 * 150 as int) as jitter_ms from (select *, {WIDE} as h, {NARROW} as n from part)")
def x12_hashes(spark, sf_dir: str):
    """X12, X28"""
    return parts(spark, sf_dir).select("id", X.fnv1a64("p_name").alias("hash"), X.jitter_ms("p_name").alias("jitter_ms"))


@query("""select p_partkey as id, cast(round(p_size % 60 * 2 + 2) as int) as gop, case when d < 0.065 then 'slow' when d < 0.13 then 'medium' else 'fast' end as preset, d < 0.13 as adaptive
from (select *, p_partkey * 5000.0::double / (1920.0 * 1080.0 * (p_size % 60 + 1)) as d from part)""")
def x17_transcode_settings(spark, sf_dir: str):
    """X17"""
    return parts(spark, sf_dir).select("id", X.transcode_settings(F.lit(1920.0), F.lit(1080.0), F.expr("p_size % 60 + 1"), F.expr("id * 5000.0D")).alias("s")).select("id", "s.*")


def ladder_sql() -> str:
    """One step a rendition: what stands above, how many there are, and their text."""
    out = "with l0 as (select p_partkey as id, p_size * 60 as w, p_size * 34 as h, p_partkey % 97 * 90000 as bps, p_partkey % 97 * 90000 as above, 0 as n, '' as ladder from part)"
    for k, (name, width, height, most) in enumerate(X.RENDITIONS):
        w, h = (width + 4) // 8 * 8, (height + 4) // 8 * 8
        rate = f"greatest(250000, least(bps * {w * h * 135} // (w * h * 100), {most}, above * 80 // 100))"
        out += f""", s{k} as (select *, bps >= 350000 and n < 3 and above > 300000 and {w} < w and {h} < h and {rate} + 50000 < above as fits, {rate} as rate from l{k}),
l{k + 1} as (select id, w, h, bps, case when fits then rate else above end as above, case when fits then n + 1 else n end as n, ladder || case when fits then '{name} {w}x{h} ' || rate || ';' else '' end as ladder from s{k})"""
    return out + f" select id, ladder from l{len(X.RENDITIONS)}"


@query(ladder_sql())
def x18_ladders(spark, sf_dir: str):
    """X18"""
    ladder = X.abr_ladder(F.expr("p_size * 60"), F.expr("p_size * 34"), F.expr("id % 97 * 90000"))
    text = F.array_join(F.transform(ladder, lambda r: F.format_string("%s %dx%d %d;", r["name"], r["width"], r["height"], r["rate"])), "")
    return parts(spark, sf_dir).select("id", text.alias("ladder"))


@query("""select p_partkey as id, ((p_size * 188)::hugeint * 8000000000 + p_partkey * 1000 + 6) // (p_partkey * 1000 + 7)::hugeint as spacing_ns,
  ((p_partkey * 1000003)::hugeint * 1504 * 27000000 // (p_size * 100000 + 1)) % 2576980377600 as pcr from part""")
def x19_spacing(spark, sf_dir: str):
    """X19, X21"""
    return parts(spark, sf_dir).select("id", X.spacing_ns(F.expr("p_size * 188"), F.expr("id * 1000 + 7")).alias("spacing_ns"), X.output_pcr(F.expr("id * 1000003"), F.expr("p_size * 100000 + 1")).alias("pcr"))


@query("""select p_partkey as id, case when marked then v - v % 1000 else v end as bitrate, cast(case when none then 0 when steps then (v % 100 + 1) * 500 else 3000 end as int) as buffer_ms
from (select *, none or steps or v >= 100777 and v % 1000 = 777 as marked from (select *, v >= 100699 and v % 1000 in (699, 799) as none, v >= 100700 and (v % 1000 between 700 and 729 or v % 1000 between 800 and 829) as steps
from (select p_partkey, 99600 + p_partkey * 7 % 1900 + p_size * 1000 as v from part)))""")
def x22_coded_rates(spark, sf_dir: str):
    """X22"""
    return parts(spark, sf_dir).select("id", X.target_bitrate(F.expr("99600 + id * 7 % 1900 + p_size * 1000")).alias("t")).select("id", "t.*")


SCHEMES = ("udp", "RTP", "srt", "file", "rtsp", "rtmp", "http", "https", "dvb", "rtp-x")


@query(f"select p_partkey as id, scheme in ('udp', 'RTP', 'srt', 'rtsp', 'rtmp', 'http', 'https') as network, scheme || '://host/' || p_partkey as safe from (select *, {list(SCHEMES)}[p_partkey % 10 + 1] as scheme from part)")
def x23_addresses(spark, sf_dir: str):
    """X23, P22"""
    scheme = F.element_at(F.array(*map(F.lit, SCHEMES)), F.expr("cast(id % 10 + 1 as int)"))
    uri = F.concat(scheme, F.lit("://"), F.expr("case when id % 2 = 0 then 'user:secret@' else '' end"), F.lit("host/"), F.col("id").cast("string"), F.expr("case when id % 3 = 0 then '?token=1' else '' end"))
    return parts(spark, sf_dir).select("id", X.network_source(uri).alias("network"), X.without_credentials(uri).alias("safe"))


@query("""select p_partkey as id, cast(case when p_partkey % 12 = 0 then case when p_size % 2 = 0 then 2 else 4 end else least(10, greatest(1, p_partkey % 12)) end as int) as seconds,
  cast(case when p_partkey % 40 = 0 then case when p_size % 2 = 0 then 6 else 8 end else least(30, greatest(3, p_partkey % 40)) end as int) as count,
  cast(least(100, greatest(0, round(100 - p_size))) as int) as strength, cast(least(100, greatest(0, round(case when p_partkey % 5 = 0 then 100 - p_size else p_partkey % 20 * 100 / 18.0 end))) as int) as quality, p_partkey % 5 = 0 as estimated from part""")
def x27_segment_settings(spark, sf_dir: str):
    """X27, P24"""
    settings = X.segment_settings(F.expr("cast(id % 12 as int)"), F.expr("cast(id % 40 as int)"), F.expr("p_size % 2 = 0"))
    signal = X.signal_percent_db(F.expr("double(-p_size)"), F.expr("case when id % 5 <> 0 then double(id % 20) end"))
    return parts(spark, sf_dir).select("id", settings.alias("s"), signal.alias("q")).select("id", "s.*", "q.*")


# --- counters of bytes ---------------------------------------------------------------------------


@query("""with e as (select user_id % 4 as stream_id, cast(100 + user_id % 4 as int) as pid, event_id as seq, event_id % 6 as k from events)
select stream_id, pid, count(*) as packets, count(*) as clear, 0 as even, 0 as odd, count(*) as pes_starts, 0 as wall_gaps, 0 as wall_gap_max_ms, 0 as timestamps, 0 as pts_backward, 0 as pts_gaps, null::bigint as pts_gap_max_ms,
  count(*) filter (where k in (0, 5)) as clear_pes, count(*) filter (where k not in (0, 5)) as bad_pes, count(*) filter (where k = 3) as bad_pes_adaptation, count(*) filter (where k = 4) as bad_pes_truncated,
  count(*) filter (where k = 1) as bad_pes_prefix, count(*) filter (where k = 2) as bad_pes_stream_id from e group by 1, 2""")
def a4_bad_units(spark, sf_dir: str):
    """A4: why PES starts are bad"""
    pes = "case event_id % 6 when 1 then x'000002E0' when 2 then x'000001BD' when 3 then x'B7' when 4 then x'B000' else x'000001E3' end"
    e = R.table(spark, sf_dir, "events").selectExpr("user_id % 4 as stream_id", "cast(100 + user_id % 4 as int) as pid", "event_id as seq", "event_id % 6 as k", f"rpad(concat({hexed(('71', 2), ('16384 + 100 + user_id % 4', 4), ('case when event_id % 6 in (3, 4) then 48 else 16 end', 2))}, {pes}), 188, x'00') as pkt")
    rows = e.selectExpr("*", "cast(case when k in (3, 4) then 3 else 1 end as int) as afc", "true as pusi", "true as has_payload", "false as tei", "0 as scrambling", "cast(null as bigint) as pts", "0L as arrival_ms")
    return continuity.track_counters(rows.withColumn("pes_fault", continuity.pes_fault(F.lit("video"))))


NALS = """with e as (select user_id % 4 as stream_id, cast(100 + user_id % 4 as int) as pid, event_id as seq, event_id % 5 = 0 as starts, event_id % 8 = 3 as scrambled from events)"""


@query(NALS + """, p as (select *, row_number() over (partition by stream_id order by seq) as n from e)
select stream_id, pid, count(*) as post_packets, count(*) filter (where scrambled) as post_still_scrambled, count(*) filter (where starts and not scrambled) as post_pes_ok, 0 as post_pes_bad,
  count(*) filter (where starts and not scrambled) as post_video_nal_headers, count(*) filter (where starts and not scrambled and seq % 35 = 5 and seq % 15 <> 0) as post_video_nal_bad from p group by 1, 2""")
def a3_after_counters(spark, sf_dir: str):
    """A3: counters behind a descrambler"""
    scrambled = F.expr("case when seq % 8 = 3 then concat(substring(pkt, 1, 3), unhex(lpad(hex(144 + seq % 16), 2, '0')), substring(pkt, 5)) else pkt end")
    return continuity.after_counters(unit_packets(spark, sf_dir).withColumn("pkt", scrambled))


@query("""select user_id % 4 as stream_id, count(*) filter (where event_id % 9 <> 2) as cw_responses, count(*) filter (where event_id % 9 = 2) as ecm_not_found,
  coalesce(max(case when event_id % 9 <> 2 then event_id * 7 % 700 end), 0) as ecm_latency_max_ms, count(*) filter (where event_id % 9 <> 2 and event_id * 7 % 700 > 500) as ecm_latency_slow from events group by 1""")
def a3_response_counters(spark, sf_dir: str):
    """A3: answers of a key service"""
    e = R.table(spark, sf_dir, "events").selectExpr("user_id % 4 as stream_id", "event_id % 9 <> 2 as found", "event_id * 7 % 700 as latency_ms")
    return continuity.response_counters(e)


@query("select user_id % 4 as stream_id, count(*) as seen, count(*) filter (where event_id % 3 = 0) as changed, count(*) filter (where event_id % 4 <> 1) as clear, count(*) filter (where event_id % 4 = 1) as scrambled from events group by 1")
def c2_accounting(spark, sf_dir: str):
    """C2"""
    head = lambda c, tail: F.expr(f"concat(x'470100', {hexed((c, 2))}, {tail})")
    e = R.table(spark, sf_dir, "events").select(F.expr("user_id % 4").alias("stream_id"), "event_id")
    code = "case when event_id % 4 = 1 then 144 else 16 end"
    return continuity.accounting(e.select("stream_id", head(code, "x'00'").alias("before"), head(code, "case when event_id % 3 = 0 then x'01' else x'00' end").alias("after")))


# --- captures and files -------------------------------------------------------------------------


CAPTURED = "select cast(user_id % 4 as varchar) as stream_id, row_number() over (partition by user_id % 4 order by event_id) - 1 as seq, cast(256 + event_id % 900 as int) as pid, cast(event_id % 16 as int) as cc from events"


def captured(spark, sf_dir: str, ranges: int = 7000) -> DataFrame:
    """Packets written as captures and read again in small ranges."""
    e = R.table(spark, sf_dir, "events").select(F.expr("user_id % 4").cast("string").alias("stream_id"), F.col("event_id").alias("seq"), F.expr(f"rpad({hexed(('71', 2), ('256 + event_id % 900', 4), ('16 + event_id % 16', 2))}, 188, x'AA')").alias("pkt"))
    path = folder(spark)
    transport.write_captures(e, path).count()
    rows = transport.read_captures(spark, f"{path}/*/*.ts", range_bytes=ranges, joined=True)
    return rows.withColumn("stream_id", F.regexp_extract("stream_id", "stream_id=([^/]+)/", 1))


@query(CAPTURED)
def s1_captures(spark, sf_dir: str):
    """S1, S2, K6, K7"""
    return transport.parse_headers(captured(spark, sf_dir)).select("stream_id", "seq", "pid", "cc")


@query("""with rows as (select cast(user_id % 4 as varchar) as stream_id, event_id, event_id % 29 = 0 as junk, cast(256 + event_id % 900 as int) as pid, cast(event_id % 16 as int) as cc from events),
  placed as (select *, cast(sum(188 + case when junk then 1 + event_id % 40 else 0 end) over w - 188 as bigint) as "at", coalesce(lead(junk, 1) over w, false) or coalesce(lead(junk, 2) over w, false) as out_of_step from rows window w as (partition by stream_id order by event_id))
  select stream_id, "at", pid, cc from placed where not out_of_step and pid in (256, 300, 512, 513, 777)""")
def s1_resynced_pids(spark, sf_dir: str):
    """Captures with junk between packets through the source, pids taken by the reader"""
    junk = "case when event_id % 29 = 0 then repeat(x'00', cast(1 + event_id % 40 as int)) else x'' end"
    e = R.table(spark, sf_dir, "events").select(F.expr("user_id % 4").cast("string").alias("stream_id"), F.col("event_id").alias("seq"), F.expr(f"concat({junk}, rpad({hexed(('71', 2), ('256 + event_id % 900', 4), ('16 + event_id % 16', 2))}, 188, x'AA'))").alias("pkt"))
    path = folder(spark)
    transport.write_captures(e, path).count()
    rows = captures.captures(spark, path, range_bytes=70_000, joined=True).where(F.col("pid").isin(256, 300, 512, 513, 777))
    return rows.select(F.regexp_extract("stream_id", "stream_id=([^/]+)/", 1).alias("stream_id"), "at", "pid", "cc")


@query("select cast(user_id % 4 as varchar) as stream_id, 0 as alignment_misses, 0 as resync_bytes from events group by 1")
def a2_alignment(spark, sf_dir: str):
    """A2: alignment of a capture"""
    return continuity.alignment(captured(spark, sf_dir))


@query(R.oracle(", up as (select channel_id, min(start) as start, title, max(stop) as stop from guide group by channel_id, event_id, title) select 'c' || channel_id as channel_id, start, stop, title || ' & more' as title, '' as description from up where start > 0", "guide"))
def s9_xmltv_programmes(spark, sf_dir: str):
    """A guide written as gzip XMLTV and read again"""
    g = R.guide(spark, sf_dir).groupBy("channel_id", "event_id", "title").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).where("start > 0")
    g = g.select(F.concat(F.lit("c"), "channel_id").alias("channel_id"), "start", "stop", F.concat("title", F.lit(" & more")).alias("title"))
    path = folder(spark)
    files.write_guide(guide.xmltv(g.select("channel_id").distinct().withColumn("name", F.lit("n")), g), path, "gzip")
    return files.xmltv_programmes(spark, path)


HISTORY = ", h as (select stream_id, ts, active, in_kbps, out_kbps, target_kbps, cc_total from quality)"


@query(R.oracle(HISTORY + " select cast(stream_id as int) as stream_id, ts, active, in_kbps, out_kbps, target_kbps, 0 as in_cc, 1 as out_cc, cc_total as in_cc_total, 2 as out_cc_total, status, 'ok' as level, '' as message from quality", "quality"))
def s11_quality_history(spark, sf_dir: str):
    """S11, K11"""
    q = R.quality(spark, sf_dir).selectExpr("stream_id", "ts", "active", "in_kbps", "out_kbps", "target_kbps", "0 as in_cc", "1 as out_cc", "cc_total as in_cc_total", "2 as out_cc_total", "status", "'ok' as level", "'' as message")
    path = folder(spark)
    files.write_quality_history(q, path)
    return files.quality_history(spark, path)


@query("select 'g' || (event_id % 3) as file, cast(user_id as int) as service_id, cast(event_id as int) as event_id, event_id * 60 as start_utc, 60 as duration_s, 'T' || event_id as title, event_type as description from events where event_id % 3 <> 2")
def s10_guide_cache(spark, sf_dir: str):
    """A file whose header counts other records than it has is refused; a cache of more
    records than a file may have is written as several"""
    e = R.table(spark, sf_dir, "events").withColumn("file", F.expr("concat('g', event_id % 3)")).withColumn("deal", F.expr("pmod(xxhash64(event_id), 16)"))
    own = W.partitionBy("file", "deal").orderBy("event_id")
    e = e.withColumn("part", F.concat_ws("-", "deal", F.floor((F.row_number().over(own) - 1) / CACHE_FILE))).drop("deal")
    record = F.to_json(F.struct(F.lit("event").alias("kind"), F.col("user_id").alias("service_id"), "event_id", F.expr("event_id * 60").alias("start_utc"), F.lit(60).alias("duration_s"), F.expr("concat('T', event_id)").alias("title"), F.col("event_type").alias("description")))
    heads = e.groupBy("file", "part").agg(F.count("*").alias("n")).select("file", "part", F.to_json(F.struct(F.lit("header").alias("kind"), F.expr("n + case when file = 'g2' then 1 else 0 end").alias("records"))).alias("value"))
    path = folder(spark)
    lines = heads.unionByName(e.select("file", "part", record.alias("value")))
    lines.repartition("file", "part").sortWithinPartitions("file", "part", F.desc(F.col("value").contains('"header"'))).write.partitionBy("file", "part").option("compression", "gzip").text(path)
    return files.guide_cache(spark, path).withColumn("file", F.regexp_extract("file", "file=(g[0-9])", 1))


@query("select epoch_us(ts) // 1000 as t, value as cpu, value / 2 as app_cpu, 10.0::double as ram, [[value]] as cores from events where event_id % 5 <> 0")
def s12_load_history(spark, sf_dir: str):
    """S12"""
    e = R.table(spark, sf_dir, "events").select(F.expr("case when event_id % 5 <> 0 then 1 end").alias("k"), R.millis("ts").alias("t"), F.col("value").alias("cpu"), (F.col("value") / 2).alias("app_cpu"), F.lit(10.0).alias("ram"), F.array(F.array("value")).alias("cores"))
    path = folder(spark)
    e.withColumn("t", F.when(F.col("k") == 1, F.col("t"))).drop("k").write.json(path)
    return files.load_history(spark, path).select("t", "cpu", "app_cpu", "ram", "cores")


@query("""select 's' || c_custkey as id, case when c_custkey % 3 = 0 then 's' || c_custkey else c_name end as name, '' as uri, c_custkey % 4 <> 0 as enabled, least(200000000, c_custkey * 1000000) as target_bitrate,
  cast(case when c_custkey % 5 = 0 then 24 else least(720, c_custkey) end as int) as hls_archive_hours, cast(least(10, c_custkey % 13) as int) as hls_segment_seconds, c_mktsegment as tvg_id from customer""")
def s15_configuration(spark, sf_dir: str):
    """One document a nation"""
    c = R.table(spark, sf_dir, "customer")
    fields = {"id": "concat('s', c_custkey)", "name": "case when c_custkey % 3 <> 0 then c_name end", "enabled": "case when c_custkey % 4 = 0 then false when c_custkey % 4 = 1 then true end", "target_bitrate": "c_custkey * 1000000L", "hls_archive_hours": "case when c_custkey % 5 <> 0 then c_custkey end", "hls_segment_seconds": "c_custkey % 13", "tvg_id": "c_mktsegment", "password": "'never read'"}
    rows = c.select("c_nationkey", F.struct(*[F.expr(v).alias(k) for k, v in fields.items()]).alias("s"))
    path = folder(spark)
    rows.groupBy("c_nationkey").agg(F.collect_list("s").alias("streams")).select(F.to_json(F.struct("streams")).alias("value")).repartition(5).write.option("lineSep", "\n").text(path)
    return files.configuration(spark, path, multiline=False)


@query("select 'n' || c_nationkey as node, 'c' || c_custkey as id, c_name as name, '' as tvg_id, c_custkey % 2 = 0 as live, c_custkey % 9 as viewers from (select *, row_number() over (partition by c_nationkey order by c_custkey) as k from customer) where k <= 512")
def s17_peer_channels(spark, sf_dir: str):
    """S17"""
    c = R.table(spark, sf_dir, "customer")
    channel = F.struct("c_custkey", F.expr("concat('c', c_custkey)").alias("id"), F.col("c_name").alias("name"), F.lit("").alias("tvg_id"), F.expr("c_custkey % 2 = 0").alias("live"), F.expr("c_custkey % 9").alias("viewers"))
    docs = c.groupBy("c_nationkey").agg(F.array_sort(F.collect_list(channel)).alias("channels")).select(F.to_json(F.struct(F.expr("concat('n', c_nationkey)").alias("node"), "channels")).alias("value"))
    path = folder(spark)
    docs.write.text(path)
    return files.peer_channels(spark, path, multiline=False)


# --- routing, schedules, health ---------------------------------------------------------------------


@query("select s_suppkey from supplier where (s_suppkey % 7 = 3 or s_suppkey % 5 = 3) and (s_suppkey % 4 = 2 or (s_suppkey + 1) % 4 = 2) and s_suppkey % 3 = 2")
def f6_due(spark, sf_dir: str):
    """F6"""
    s = R.table(spark, sf_dir, "supplier").select("s_suppkey", F.expr("array(s_suppkey % 7, s_suppkey % 5)").alias("weekdays"), F.expr("array(s_suppkey % 4, (s_suppkey + 1) % 4)").alias("hours"), F.expr("s_suppkey % 3").alias("minute"))
    return sessions.due(s, F.lit(3), F.lit(2), F.lit(2)).select("s_suppkey")


@query("select event_id from (select *, row_number() over (partition by user_id % 9, cast(ts as date), hour(ts) // 6 order by floor(epoch(ts)), event_id) as k from events) where k = 1")
def f7_once_a_day(spark, sf_dir: str):
    """F7"""
    e = R.table(spark, sf_dir, "events").select("event_id", F.expr("user_id % 9").alias("stream_id"), F.to_date("ts").alias("date"), F.expr("hour(ts) div 6").alias("slot"), F.struct(R.seconds("ts"), "event_id").alias("ts"))
    return sessions.once_a_day(e).select("event_id")


@query("select s_suppkey from supplier where lower(s_name) like '%00007%' or 'udp://239.0.0.' || s_suppkey like '%00007%' or s_suppkey % 10 = 7")
def f8_search(spark, sf_dir: str):
    """F8"""
    s = R.table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("name"), F.expr("concat('udp://239.0.0.', s_suppkey)").alias("uri"), F.expr("array('http://A', case when s_suppkey % 10 = 7 then 'SRT://x00007Y' else 'srt://b' end)").alias("outputs"))
    return sessions.search(s, " 00007").select("s_suppkey")


@query("select p_partkey as id from part where p_partkey % 3 <> 0")
def f9_safe_ids(spark, sf_dir: str):
    """F9"""
    name = F.expr("case id % 6 when 0 then 'a b' when 3 then '' else concat('id-', id, '_x.Y') end")
    return sessions.safe_ids(parts(spark, sf_dir).select("id", name.alias("name")), "name").select("id")


CONFIG = "config as (select s_suppkey as stream_id, s_suppkey % 50 as ord, s_name as name from supplier), state as (select distinct on (stream_id) user_id % 60 as stream_id, event_id % 2 = 0 as active, event_type as status, event_id * 1000 as bitrate_in, event_id * 900 as bitrate_out from events order by stream_id, event_id)"


def config(spark, sf_dir: str) -> DataFrame:
    return R.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("stream_id"), (F.col("s_suppkey") % 50).alias("ord"), F.col("s_name").alias("name"))


def state(spark, sf_dir: str) -> DataFrame:
    row = F.min_by(F.struct(F.expr("event_id % 2 = 0").alias("active"), F.col("event_type").alias("status"), F.expr("event_id * 1000").alias("bitrate_in"), F.expr("event_id * 900").alias("bitrate_out")), "event_id").alias("r")
    return R.table(spark, sf_dir, "events").groupBy(F.expr("user_id % 60").alias("stream_id")).agg(row).select("stream_id", "r.*")


@query(f"with {CONFIG} select stream_id, name, coalesce(active, false) as active, coalesce(status, 'stopped') as status from config left join state using (stream_id)")
def j1_states(spark, sf_dir: str):
    """J1"""
    return quality.with_state(config(spark, sf_dir), state(spark, sf_dir)).select("stream_id", "name", "active", "status")


@query(f"""with {CONFIG}, v as (select user_id % 60 as stream_id, count(distinct user_id) as viewers from events group by 1)
select ord, c.stream_id, name, coalesce(active, false) as active, coalesce(viewers, 0) as viewers, case when coalesce(active, false) then bitrate_in // 1000 else 0 end as bitrate_in_kbps, case when coalesce(active, false) then bitrate_out // 1000 else 0 end as bitrate_out_kbps
from config c left join state using (stream_id) left join v using (stream_id)""")
def j11_channel_rows(spark, sf_dir: str):
    """J11, P21, A9"""
    v = R.table(spark, sf_dir, "events").groupBy(F.expr("user_id % 60").alias("stream_id")).agg(F.countDistinct("user_id").alias("viewers"))
    return quality.channel_rows(config(spark, sf_dir), state(spark, sf_dir), v, most=1 << 30)


@query("""with n as (select c_custkey as ord, 'm_' || (c_custkey % 40) as id, 'Name' || (c_custkey % 700) as name, 'udp://' || (c_custkey % 700) as uri from customer),
k as (select s_suppkey, 'm_' || (s_suppkey % 15) || case when s_suppkey % 4 = 0 then '_2' else '' end as id, 'NAME' || s_suppkey as name, 'udp://' || case when s_suppkey % 2 = 0 then s_suppkey else 0 end as uri from supplier),
f as (select *, row_number() over (partition by id order by ord) as r from n where ord in (select min(ord) from n group by lower(name), uri) and (lower(name), uri) not in (select lower(name), uri from k)),
taken as (select id, list(distinct id) as ids from k group by 1),
free as (select stem, row_number() over (partition by stem order by c) as r, stem || case when c = 1 then '' else '_' || c end as new_id from (select distinct id as stem from f), range(1, 4000) x(c) where stem || case when c = 1 then '' else '_' || c end not in (select id from k))
select f.ord, new_id as id, name, uri from f join free on free.stem = f.id and free.r = f.r""")
def j15_imported(spark, sf_dir: str):
    """J15"""
    new = R.table(spark, sf_dir, "customer").selectExpr("c_custkey as ord", "concat('m_', c_custkey % 40) as id", "concat('Name', c_custkey % 700) as name", "concat('udp://', c_custkey % 700) as uri")
    known = R.table(spark, sf_dir, "supplier").selectExpr("concat('m_', s_suppkey % 15, case when s_suppkey % 4 = 0 then '_2' else '' end) as id", "concat('NAME', s_suppkey) as name", "concat('udp://', case when s_suppkey % 2 = 0 then s_suppkey else 0 end) as uri")
    return sessions.imported(new, known).select("ord", "id", "name", "uri")


@query("select user_id % 7 as stream_id, round(avg(value), 6) as cpu_mean, max(value) as cpu_max, max(event_id % 1000) as rss_max from events group by 1")
def a14_load_summary(spark, sf_dir: str):
    """A14"""
    return quality.load_summary(R.table(spark, sf_dir, "events").selectExpr("user_id % 7 as stream_id", "value as cpu", "event_id % 1000 as rss")).withColumn("cpu_mean", F.round("cpu_mean", 6))


@query("select p_partkey as id, case when p_size % 3 = 0 then 8000 when p_size % 3 = 1 then p_size * 10 else p_size * 9 end as rate from part")
def a18_output_rates(spark, sf_dir: str):
    """A18"""
    rate = quality.output_rate(F.expr("p_size % 3 = 0"), F.lit(8000), F.expr("case when p_size % 3 = 1 then p_size * 10 else 0 end"), F.expr("p_size * 9"))
    return parts(spark, sf_dir).select("id", rate.cast("long").alias("rate"))


@query("""with c as (select user_id % 8 as stream_id, event_id as seq, event_id // 7 % 5 as digest from events),
d as (select *, coalesce(digest <> lag(digest) over (partition by stream_id order by seq), false) as c from c)
select stream_id, seq, cast(sum(case when c then 1 else 0 end) over (partition by stream_id order by seq rows unbounded preceding) % 32 as bigint) as version from d""")
def w12_versions(spark, sf_dir: str):
    """W12"""
    c = R.table(spark, sf_dir, "events").selectExpr("user_id % 8 as stream_id", "event_id as seq", "event_id div 7 % 5 as digest")
    return guide.version(c).select("stream_id", "seq", "version")


RECORDS = ", rec as (select cast(epoch(strptime(line[1:19], '%Y-%m-%dT%H:%M:%S')) as bigint) as at_s, regexp_extract(line, 'stream=([^ ]+)', 1) as stream, regexp_extract(line, 'sid=([^ ]+)', 1) as sid, regexp_extract(line, 'gaps=([0-9]+)', 1)::bigint as gaps from log_lines)"


@query(R.oracle(RECORDS + " select at_s // 600 * 600 as slot_s, count(distinct (sid, stream)) as services, sum(gaps)::bigint as anomalies from rec where gaps > 0 group by 1 having count(distinct (sid, stream)) > 1 order by 1 limit 5", "log_lines"))
def o7_first_coincidences(spark, sf_dir: str):
    """The report of the first five intervals"""
    return logs.coincidences(logs.records(R.log_lines(spark, sf_dir)), seconds=600, most=5)


@query("select event_id as line_no, event_id % 90000 as seconds, event_id % 100 as ok, event_id % 7 as failed, event_id % 500 as avg_ms from events where event_id % 4 <> 0 and event_id % 90000 between 1 and 86400")
def p19_summaries(spark, sf_dir: str):
    """P19"""
    line = F.expr("concat('summary seconds=', event_id % 90000, ' ok=', event_id % 100, ' failed=', event_id % 7, ' avg_ms=', event_id % 500, case when event_id % 4 = 0 then ' more' else '' end)")
    return logs.summaries(R.table(spark, sf_dir, "events").select(F.col("event_id").alias("line_no"), line.alias("line")))


@query(R.oracle(""", r as (select stream_id, duration_ms * 1000 as bandwidth, '1280x' || (400 + sequence % 9) as resolution, file as uri, sequence from segments)
select stream_id, '#EXTM3U' || chr(10) || '#EXT-X-VERSION:3' || chr(10) || string_agg('#EXT-X-STREAM-INF:BANDWIDTH=' || bandwidth || ',RESOLUTION=' || resolution || chr(10) || uri || chr(10), '' order by bandwidth desc, uri desc) as playlist from (select distinct on (stream_id, bandwidth) * from r order by stream_id, bandwidth, sequence) group by 1""", "segments"))
def k10_master_playlists(spark, sf_dir: str):
    """K10"""
    s = R.segments(spark, sf_dir).withColumn("bandwidth", F.col("duration_ms") * 1000)
    one = s.groupBy("stream_id", "bandwidth").agg(F.min_by(F.struct(F.expr("concat('1280x', 400 + sequence % 9)").alias("resolution"), F.col("file").alias("uri")), "sequence").alias("r"))
    return hls.master_playlist(one.select("stream_id", "bandwidth", "r.*"))


def archived(kind: str, test: str, end: str) -> str:
    return R.oracle(f""", r as (select * from segments where wall_ts >= {NOW} - 24 * 3600 and {test}),
s as (select *, coalesce(lead(wall_ts) over w - wall_ts, wall_ts - lag(wall_ts) over w) as step from r window w as (partition by stream_id order by wall_ts, file)),
t as (select *, case when step is null then 2.0::double else least(6.0, greatest(1.0, step))::double end as seconds from s)
select stream_id, '#EXTM3U' || chr(10) || '#EXT-X-VERSION:3' || chr(10) || '#EXT-X-TARGETDURATION:6' || chr(10) || '#EXT-X-MEDIA-SEQUENCE:0' || chr(10) || '#EXT-X-PLAYLIST-TYPE:{kind}' || chr(10)
 || string_agg('#EXT-X-PROGRAM-DATE-TIME:' || strftime(to_timestamp(wall_ts) at time zone 'UTC', '%Y-%m-%dT%H:%M:%SZ') || chr(10) || '#EXTINF:' || printf('%.3f', seconds) || ',' || chr(10) || file || chr(10), '' order by wall_ts, file){end} as playlist from t group by 1""", "segments")


@query(archived("EVENT", f"wall_ts between {NOW} - 50002 and {NOW} + 12", ""))
def k9_event_playlists(spark, sf_dir: str):
    """An open range"""
    return hls.archive_playlist(R.segments(spark, sf_dir), "rewind-50000.m3u8", NOW, 24)


@query(archived("VOD", f"wall_ts between {NOW} - 60002 and {NOW} - 29998", " || '#EXT-X-ENDLIST' || chr(10)"))
def k9_vod_playlists(spark, sf_dir: str):
    """A closed range"""
    return hls.archive_playlist(R.segments(spark, sf_dir), f"archive-{NOW - 60_000}-30000.m3u8", NOW, 24)


@query("""select s_suppkey as stream_id from (select *, 1000 - s_suppkey * 7 % 900 as started, 1000 - s_suppkey * 11 % 300 as last_activity, case when s_suppkey % 3 = 0 then 1000 - s_suppkey * 5 % 200 end as last_segment, s_suppkey % 2 = 0 as hls from supplier)
where s_suppkey % 5 <> 0 and s_suppkey % 4 <> 0 and 1000 - greatest(last_activity, started) >= 30
  and case when last_segment is null and hls then 1000 - started >= 120 when last_segment is not null then 1000 - last_segment >= 75 else true end""")
def t16_idle_streams(spark, sf_dir: str):
    """T16"""
    columns = {"stream_id": "s_suppkey", "started": "1000 - s_suppkey * 7 % 900", "last_activity": "1000 - s_suppkey * 11 % 300", "last_segment": "case when s_suppkey % 3 = 0 then 1000 - s_suppkey * 5 % 200 end", "hls": "s_suppkey % 2 = 0", "on_demand": "s_suppkey % 5 <> 0", "viewers": "case when s_suppkey % 4 = 0 then 2 else 0 end"}
    return health.idle(R.table(spark, sf_dir, "supplier").select(*[F.expr(v).alias(k) for k, v in columns.items()]), F.lit(1000)).select("stream_id")


@query(f"""select s_suppkey as source_id from (select *, cast(to_timestamp({NOW}) at time zone 'UTC' as timestamp) as t from supplier)
where s_suppkey % 6 <> 0 and (s_suppkey % 2 = 0 or dayofweek(t) + 1 = s_suppkey % 7 + 1) and hour(t) * 60 + minute(t) >= (s_suppkey % 24) * 60 + s_suppkey % 60
  and not coalesce(s_suppkey % 3 = 0 and cast(to_timestamp({NOW} - s_suppkey * 3600) at time zone 'UTC' as date) = cast(t as date), false) and not (s_suppkey % 5 = 0 and s_suppkey * 60 < 900)""")
def t26_refresh_due(spark, sf_dir: str):
    """T26"""
    columns = {"source_id": "s_suppkey", "enabled": "s_suppkey % 6 <> 0", "every": "case when s_suppkey % 2 = 0 then 'daily' else 'weekly' end", "weekday": "s_suppkey % 7 + 1", "hour": "s_suppkey % 24", "minute": "s_suppkey % 60",
               "last_run": f"case when s_suppkey % 3 = 0 then {NOW} - s_suppkey * 3600 end", "last_error": f"case when s_suppkey % 5 = 0 then {NOW} - s_suppkey * 60 end"}
    return guide.refresh_due(R.table(spark, sf_dir, "supplier").select(*[F.expr(v).alias(k) for k, v in columns.items()]), NOW).select("source_id")


GATE = {"stream_id": "user_id % 6", "ts": "event_id", "generation": "case when event_id % 331 < 6 then 0 else 1 + {thousands} end", "state": "case when event_id % 9 = 4 then 'scrambled' when event_id % 9 = 5 then 'unverified' else 'partial' end",
        "active": "event_id % 241 > 5", "output_healthy": "event_id % 5 < 2 and event_id % 150 > 30", "clear_pes": "event_id % 4", "client": "event_id % 50 < 6"}


@query(machine("select " + ", ".join(f"{v.format(thousands='event_id // 1000')} as {k}" for k, v in GATE.items()) + " from events", "ts", """
    live: r.active and r.generation <> 0 ; r.active and r.generation <> 0
    fresh: true ; not s.live or r.generation <> s.generation
    pes: r.output_healthy and r.clear_pes > 0 and r.state <> 'scrambled' ; r.output_healthy and r.clear_pes > 0 and r.state <> 'scrambled'
    generation: r.generation ; r.generation
    output_at: case when r.active and r.generation <> 0 and r.output_healthy then r.ts end ; case when not $live then null when r.output_healthy then r.ts when $fresh then null else s.output_at end
    pes_at: case when r.active and r.generation <> 0 and r.output_healthy and r.clear_pes > 0 and r.state <> 'scrambled' then r.ts end ; case when not $live then null when $pes then r.ts when $fresh then null else s.pes_at end
    recent: coalesce(r.active and r.generation <> 0 and r.output_healthy and r.clear_pes > 0 and r.state <> 'scrambled', false) ; coalesce(r.ts - $pes_at <= 15 and r.ts - $output_at <= 6, false)
    promoted: coalesce(r.client and r.active and r.generation <> 0 and r.output_healthy and r.clear_pes > 0 and r.state <> 'scrambled', false) ; $recent and (r.client or s.promoted and not $fresh)
    ts: r.ts ; r.ts
    raw: case when r.active then r.state else 'offline' end ; case when r.active then r.state else 'offline' end
""", "select stream_id, ts, case when promoted then 'viewer_pes_ok' else raw end as shown from f"))
def t33_viewer_gate(spark, sf_dir: str):
    """T33"""
    s = R.table(spark, sf_dir, "events").select(*[F.expr(v.format(thousands="event_id div 1000")).alias(k) for k, v in GATE.items()])
    return health.viewer_gate(s).select("stream_id", "ts", "shown")


@query(R.oracle(f" select channel_id, event_id, start, stop, title from guide where channel_id = 7 and stop >= 840000000 - 21600 and start <= 840000000 + 7 * 86400", "guide"))
def c5_guide_snapshot(spark, sf_dir: str):
    """C5"""
    return guide.snapshot(R.guide(spark, sf_dir), 7, 840_000_000).select("channel_id", "event_id", "start", "stop", "title")


# --- the query surface ---------------------------------------------------------------------------


@query(R.oracle(f" select ts, sample_id, status from quality where stream_id = 3 and ts between {NOW} - 2592000 and {NOW} + 300", "quality"))
def k12_quality_history(spark, sf_dir: str):
    """A period beyond the greatest is held to it"""
    return api.quality_history(R.quality(spark, sf_dir), 3, 90 * 86_400, NOW).select("ts", "sample_id", "status")


@query(R.oracle(" select channel_id, count(*) as events from guide where source_id = 1 group by 1", "guide"))
def k12_guide_channels(spark, sf_dir: str):
    """K12"""
    return api.guide_channels(R.guide(spark, sf_dir), 1)


@query(R.oracle(f" select channel_id, min(case when start <= {GUIDE_NOW} and stop > {GUIDE_NOW} then start end) as now_start, min(case when start > {GUIDE_NOW} then start end) as next_start from guide where channel_id = 11 group by 1", "guide"))
def k12_now_next(spark, sf_dir: str):
    """K12, J13"""
    return api.epg_now_next(R.guide(spark, sf_dir), 11, GUIDE_NOW).select("channel_id", "now_start", "next_start")


@query(R.oracle(f""", n as (select *, case when coalesce(ts - lag(ts) over w > 7200, true) then 1 else 0 end as f from viewers window w as (partition by ip, stream_id, protocol order by ts, request_id)),
m as (select *, sum(f) over (partition by ip, stream_id, protocol order by ts, request_id rows unbounded preceding) as session from n),
found as (select ip, stream_id, protocol, min(ts) as start, max(ts) as last, count(*) as requests from m group by ip, stream_id, protocol, session)
select ip, stream_id, protocol, sum(requests)::bigint as connections, max({NOW} - start) as max_age_s from found where start <= {NOW} and last >= {NOW} - 7200 group by 1, 2, 3""", "viewers"))
def k12_sessions(spark, sf_dir: str):
    """K12, A8"""
    return api.active_sessions(R.viewers(spark, sf_dir), NOW, 7200)


@query("""with s as (select s_name as name, case s_suppkey % 4 when 0 then 'dvb://0?freq=1#2' when 1 then 'srt://u:p@h:1?streamid=x' when 2 then 'udp://h:2' else 'http://h/a?k=1' end as input_uri, case when s_suppkey % 3 = 0 then 'rtsp://me@b/c' end as backup_input_uri, s_suppkey % 4 as k, s_suppkey % 3 = 0 as b from supplier)
select '' as id, false as auto_start, name, case k when 0 then 'dvb://0?freq=1#2' when 1 then 'srt://h:1' when 2 then 'udp://h:2' else 'http://h/a' end as input_uri, case when b then 'rtsp://b/c' end as backup_input_uri,
  array_to_string(list_filter([case when k = 0 then 'input_uri: check tuner, adapter and frontend on target' end, case when k = 1 then 'input_uri: URL username/password omitted' end, case when k in (1, 3) then 'input_uri: URL query/fragment omitted; review before starting' end, case when b then 'backup_input_uri: URL username/password omitted' end], lambda x: x is not null), '|') as warnings from s""")
def p22_shared_streams(spark, sf_dir: str):
    """P22"""
    uri = "case s_suppkey % 4 when 0 then 'dvb://0?freq=1#2' when 1 then 'srt://u:p@h:1?streamid=x' when 2 then 'udp://h:2' else 'http://h/a?k=1' end"
    s = R.table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.expr(uri).alias("input_uri"), F.expr("case when s_suppkey % 3 = 0 then 'rtsp://me@b/c' end").alias("backup_input_uri"), F.lit("secret").alias("srt_passphrase"))
    return files.shareable(s).withColumn("warnings", F.concat_ws("|", "warnings"))


@query(machine("select m.r_regionkey as mux_id, n.n_nationkey % 4 as service, c_custkey % 90 + 40 as pid, n.n_nationkey as stream_id from customer join nation n on c_nationkey = n.n_nationkey join region m on m.r_regionkey = n.n_regionkey where n.n_nationkey % 5 < 4 group by all",
    "service, stream_id, pid", """
    stream_id: r.stream_id ; r.stream_id
    pid: r.pid ; r.pid
    wish: 256 + 32 * r.service ; 256 + 32 * r.service
    new_pid: 256 + 32 * r.service ; list_min(list_filter(range($wish, $wish + len(s.used) + 1), lambda x: not list_contains(s.used, x)))
    used: [256 + 32 * r.service] ; list_append(s.used, $new_pid)
""", "select mux_id, stream_id, cast(pid as int) as pid, cast(new_pid as int) as new_pid from f", key="mux_id"))
def u1_pid_plan(spark, sf_dir: str):
    """Disjoint pids of the services of a multiplex; some have more than their range"""
    n = R.table(spark, sf_dir, "nation").where("n_nationkey % 5 < 4")
    services = n.select(F.col("n_regionkey").alias("mux_id"), F.expr("(n_nationkey % 4) * 1000000L + n_nationkey").alias("ord"), F.col("n_nationkey").alias("stream_id"))
    pids = R.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("stream_id"), F.expr("cast(c_custkey % 90 + 40 as int)").alias("pid"))
    return nested.pid_plan(services.withColumn("ord", F.expr("ord div 1000000")), pids)


# --- stream lists of other servers -------------------------------------------------------------------


URIS = ("udp://239.0.0.1:5000", "http://h/a.ts", "https://h/b.m3u8", "srt://h:9?x=1", "dvb://tuner", "HTTP://h/c")


def exported(spark, sf_dir: str) -> DataFrame:
    uri = lambda e: F.element_at(F.array(*map(F.lit, URIS)), F.expr(f"cast({e} as int)"))
    out = F.expr("array(named_struct('type', case when s_suppkey % 2 = 0 then 'rtp' else 'udp-vbr' end, 'host', concat('239.1.1.', s_suppkey % 200), 'port', cast(s_suppkey % 3 * 1000 as int)))")
    return R.table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("ord"), F.format_string("%05d", "s_suppkey").alias("id"), F.expr("concat('Name ', s_suppkey % 40)").alias("name"), F.lit(True).alias("auto_start"), uri("s_suppkey % 6 + 1").alias("input_uri"),
        F.when(F.expr("s_suppkey % 4 = 1"), uri("s_suppkey % 5 + 1")).alias("backup_input_uri"), F.when(F.expr("s_suppkey % 6 = 5"), "hls").otherwise("auto").alias("input_mode"), out.alias("outputs"))


FOREIGN = f"""with s as (select s_suppkey, 'Name ' || (s_suppkey % 40) as name, {list(URIS)}[s_suppkey % 6 + 1] as u, case when s_suppkey % 4 = 1 then {list(URIS)}[s_suppkey % 5 + 1] end as b,
  s_suppkey % 3 * 1000 as port, case when s_suppkey % 2 = 0 then 'rtp' else 'udp-vbr' end as type, '239.1.1.' || (s_suppkey % 200) as host from supplier)"""
FOUND = """case when u like 'dvb%' then {b} else {u} end as input_uri, case when u not like 'dvb%' and b not like 'dvb%' then {b} end as backup_input_uri,
  case when port > 0 then type || ' ' || host || ' ' || port else '' end as outputs, case when u like 'dvb%' or coalesce(b like 'dvb%', false) then 'Unsupported input skipped' else '' end || case when u like 'dvb%' and (b is null or b like 'dvb%') then '|Stream without supported input skipped' else '' end as warnings"""


def flat(rows: DataFrame) -> DataFrame:
    outputs = F.array_join(F.transform("outputs", lambda o: F.concat_ws(" ", o["type"], o["host"], o["port"].cast("string"))), ",")
    return rows.select("name", "input_uri", "backup_input_uri", outputs.alias("outputs"), F.array_join("warnings", "|").alias("warnings"))


@query(FOREIGN + " select name, " + FOUND.format(u="u", b="case when b not like 'dvb%' then b end") + " from s")
def s16_json_streams(spark, sf_dir: str):
    """A JSON list written and read again"""
    path = folder(spark)
    foreign.json_streams(exported(spark, sf_dir)).write.text(path)
    return flat(foreign.read_json_streams(spark, path, multiline=False))


PLAIN = "case when {0} like 'HTTP://%' then 'http://' || {0}[8:] else {0} end"


@query(FOREIGN + ", n as (select *, row_number() over (partition by name order by s_suppkey) as k from s) select replace(name, ' ', '_') || case when k = 1 then '' else '_' || k end as name, " + FOUND.format(u=PLAIN.format("u"), b="case when b not like 'dvb%' then " + PLAIN.format("b") + " end") + " from n")
def s16_text_streams(spark, sf_dir: str):
    """Blocks of text written and read again"""
    path = folder(spark)
    blocks = foreign.text_streams(exported(spark, sf_dir))
    blocks.select(F.concat(F.lit("# list\nother { input udp://x:1; }\n"), "block").alias("value")).write.text(path)
    return flat(foreign.read_text_streams(spark, path))
