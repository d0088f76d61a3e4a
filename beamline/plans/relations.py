"""Relations that the stream operators work on, derived from the driver's tables.

The driver's tables hold no transport data, so deterministic projections stand in
for captures, counters, sessions and guides. Each relation has a Spark form here and
a DuckDB form in ``SQL``, which the oracle queries build upon.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.scans import Scan, Total

#: Seconds of recorded segments that are one range.
SEGMENT_SPAN = 86_400


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def millis(column: str) -> F.Column:
    """Milliseconds since 1970 of a zoneless timestamp, whatever the session's zone."""
    return F.expr(f"timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', cast({column} as timestamp_ntz))")


def seconds(column: str) -> F.Column:
    return F.floor(millis(column) / 1000).cast("long")


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packet headers: 32 pids over 4 streams, with gaps, repeats, resets and errors."""
    own = W.partitionBy("pid").orderBy("seq")
    e = table(spark, sf_dir, "events").select(
        F.expr("user_id % 4").alias("stream_id"),
        F.expr("cast(256 + user_id % 32 as int)").alias("pid"),
        F.col("event_id").alias("seq"),
        millis("ts").alias("arrival_ms"),
        F.expr("cast(case when event_id % 211 = 0 then 0 when event_type = 'view' then 2 when event_id % 5 = 0 then 3 else 1 end as int)").alias("afc"),
        F.expr("event_id % 251 = 0").alias("discontinuity"),
        F.expr("event_id % 307 = 0").alias("tei"),
        F.expr("cast(case when event_id % 13 = 0 then 2 when event_id % 17 = 0 then 3 else 0 end as int)").alias("scrambling"),
        F.expr("event_id % 3 = 0").alias("pusi"),
        F.expr("event_id % 7").alias("payload_hash"),
        F.expr("case when event_id % 3 = 0 and event_type <> 'view' then (8589900000 + event_id * 1800 - case when event_id % 401 = 0 then 90000 else 0 end) % 8589934592 end").alias("pts"),
        F.expr("case when event_id % 7 = 0 then event_id * 1080000 + case when event_id % 119 = 0 then 54000000 else 0 end end").alias("pcr27"),
    )
    return e.withColumn("has_payload", F.expr("afc in (1, 3)")).withColumn(
        "cc", ((F.row_number().over(own) - 1 + F.when(F.expr("seq % 97 = 0"), 1).otherwise(0)) % 16).cast("int")
    )


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality samples of 8 streams with counters that reset."""
    own = W.partitionBy("stream_id").orderBy("ts", "sample_id").rowsBetween(W.unboundedPreceding, 0)
    return (
        table(spark, sf_dir, "events")
        .select(
            F.expr("user_id % 8").alias("stream_id"), seconds("ts").alias("ts"), F.col("event_id").alias("sample_id"),
            F.expr("event_type <> 'view'").alias("active"),
            F.expr("cast(case when event_id % 53 = 0 then 0 else floor(value * 10) end as bigint)").alias("in_kbps"),
            F.expr("cast(floor(value * 10) as bigint)").alias("out_kbps"),
            F.expr("cast(800 as bigint)").alias("target_kbps"),
            F.expr("case when event_id % 89 = 0 then 'input failed' when event_id % 113 = 0 then 'ended' else 'running' end").alias("status"),
            F.expr("event_type = 'error'").alias("_e"),
        )
        .withColumn("cc_total", F.sum(F.col("_e").cast("long")).over(own) % 50)
        .drop("_e")
    )


def viewers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Viewer requests: client address, stream, protocol and time."""
    return table(spark, sf_dir, "events").select(
        F.expr("concat('10.0.', user_id % 7, '.', user_id % 20)").alias("ip"),
        F.expr("concat('s', user_id % 12)").alias("stream_id"),
        F.expr("case when event_type = 'click' then 'hls' when event_type = 'view' then 'http' else 'srt' end").alias("protocol"),
        seconds("ts").alias("ts"), F.col("event_id").alias("request_id"),
        F.expr("event_id % 41 = 0").alias("authorised"),
    )


def guide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Guide events: 25 channels from 3 sources, three days long."""
    return table(spark, sf_dir, "orders").select(
        F.expr("o_custkey % 3").alias("source_id"), F.expr("o_custkey % 25").alias("channel_id"),
        F.expr("o_orderkey % 4000").alias("event_id"), F.col("o_orderkey").alias("arrival"),
        seconds("o_orderdate").alias("start"), (seconds("o_orderdate") + 259200).alias("stop"),
        F.expr("concat('Show ', o_orderpriority)").alias("title"),
    )


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded segments of 5 streams in order of time."""
    e = table(spark, sf_dir, "events").select(F.expr("user_id % 5").alias("stream_id"), F.col("event_id"), seconds("ts").alias("wall_ts"), F.expr("event_id % 37 = 0").alias("discontinuity"), F.expr("4000 + event_id % 2500").alias("duration_ms"))
    e = Scan(e, ["stream_id"], ["wall_ts", "event_id"], SEGMENT_SPAN).add(sequence=Total(F.lit(1).cast("long"))).done()
    return e.withColumn("sequence", F.col("sequence") - 1).withColumn("file", F.format_string("seg_%d_%d.ts", "stream_id", "sequence")).drop("event_id")


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a monitor log: time and ``key=value`` pairs."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("line_no"),
        F.concat(
            F.date_format(F.expr("cast(ts as timestamp_ntz)"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit(" monitor stream=s"), F.expr("cast(user_id % 6 as string)"),
            F.lit(" sid="), F.expr("cast(100 + user_id % 6 as string)"), F.lit(" gaps="), F.expr("cast(case when event_type = 'error' then 1 + event_id % 4 else 0 end as string)"),
            F.lit(" peak="), F.expr("cast(event_id % 1000 as string)"), F.expr("case when event_id % 29 = 0 then ' note=bad' else '' end"),
        ).alias("line"),
    )


#: DuckDB forms, one CTE each.
SQL = {
    "packets": """packets as (
  select *, afc in (1, 3) as has_payload,
    cast((row_number() over (partition by pid order by seq) - 1 + case when seq % 97 = 0 then 1 else 0 end) % 16 as int) as cc
  from (select user_id % 4 as stream_id, cast(256 + user_id % 32 as int) as pid, event_id as seq, epoch_us(ts) // 1000 as arrival_ms,
    cast(case when event_id % 211 = 0 then 0 when event_type = 'view' then 2 when event_id % 5 = 0 then 3 else 1 end as int) as afc,
    event_id % 251 = 0 as discontinuity, event_id % 307 = 0 as tei,
    cast(case when event_id % 13 = 0 then 2 when event_id % 17 = 0 then 3 else 0 end as int) as scrambling,
    event_id % 3 = 0 as pusi, event_id % 7 as payload_hash,
    case when event_id % 3 = 0 and event_type <> 'view' then (8589900000 + event_id * 1800 - case when event_id % 401 = 0 then 90000 else 0 end) % 8589934592 end as pts,
    case when event_id % 7 = 0 then event_id * 1080000 + case when event_id % 119 = 0 then 54000000 else 0 end end as pcr27
  from events))""",
    "quality": """quality as (
  select * exclude (e), cast(sum(e) over (partition by stream_id order by ts, sample_id rows unbounded preceding) % 50 as bigint) as cc_total
  from (select user_id % 8 as stream_id, cast(floor(epoch(ts)) as bigint) as ts, event_id as sample_id, event_type <> 'view' as active,
    cast(case when event_id % 53 = 0 then 0 else floor(value * 10) end as bigint) as in_kbps, cast(floor(value * 10) as bigint) as out_kbps,
    800::bigint as target_kbps,
    case when event_id % 89 = 0 then 'input failed' when event_id % 113 = 0 then 'ended' else 'running' end as status,
    case when event_type = 'error' then 1 else 0 end as e from events))""",
    "viewers": """viewers as (
  select '10.0.' || (user_id % 7) || '.' || (user_id % 20) as ip, 's' || (user_id % 12) as stream_id,
    case when event_type = 'click' then 'hls' when event_type = 'view' then 'http' else 'srt' end as protocol,
    cast(floor(epoch(ts)) as bigint) as ts, event_id as request_id, event_id % 41 = 0 as authorised from events)""",
    "guide": """guide as (
  select o_custkey % 3 as source_id, o_custkey % 25 as channel_id, o_orderkey % 4000 as event_id, o_orderkey as arrival,
    cast(epoch(o_orderdate) as bigint) as start, cast(epoch(o_orderdate) as bigint) + 259200 as stop, 'Show ' || o_orderpriority as title from orders)""",
    "segments": """segments as (
  select stream_id, wall_ts, discontinuity, duration_ms, sequence, 'seg_' || stream_id || '_' || sequence || '.ts' as file from (
  select user_id % 5 as stream_id, cast(floor(epoch(ts)) as bigint) as wall_ts, event_id % 37 = 0 as discontinuity, 4000 + event_id % 2500 as duration_ms,
    row_number() over (partition by user_id % 5 order by floor(epoch(ts)), event_id) - 1 as sequence from events))""",
    "log_lines": """log_lines as (
  select event_id as line_no, strftime(ts, '%Y-%m-%dT%H:%M:%S') || ' monitor stream=s' || (user_id % 6) || ' sid=' || (100 + user_id % 6)
    || ' gaps=' || (case when event_type = 'error' then 1 + event_id % 4 else 0 end) || ' peak=' || (event_id % 1000)
    || (case when event_id % 29 = 0 then ' note=bad' else '' end) as line from events)""",
}


def oracle(body: str, *names: str, recursive: bool = False) -> str:
    """``body`` with the named relations before it. A body that starts with ``,`` goes
    on with further CTEs."""
    return "with " + ("recursive " if recursive else "") + (",\n".join(SQL[n] for n in names) + body).lstrip(", ")
