"""Programme guide: windows, upserts, caps, now and next, sources, sections, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scans import PACKETS, Scan, Total, lag

from ..functions.scalars import epg_xml_time, m3u_attribute, m3u_line, xml_escape

PAST_S, PER_CHANNEL, PER_SOURCE, CHANNELS = 6 * 3600, 512, 300_000, 15_000


def window(events: DataFrame, now: int, days: int = 7) -> DataFrame:
    """events that end no more than six hours ago and start within 1 to 7 days."""
    days = max(1, min(7, days))
    return events.where((F.col("stop") >= now - PAST_S) & (F.col("start") <= now + days * 86_400))


def wanted(programmes: DataFrame, mapping: DataFrame) -> DataFrame:
    """Programmes of the channels that are assigned to something."""
    return programmes.join(mapping.select("source_id", "channel_id").distinct(), ["source_id", "channel_id"], "left_semi")


def upsert(events: DataFrame) -> DataFrame:
    """One row for each channel, event and start; the last to arrive."""
    place = F.row_number().over(W.partitionBy("channel_id", "event_id", "start").orderBy(F.desc("arrival")))
    return events.withColumn("_place", place).where("_place = 1").drop("_place")


def latest(events: DataFrame, n: int = PER_CHANNEL) -> DataFrame:
    """O1: a channel's ``n`` events that start last."""
    place = F.row_number().over(W.partitionBy("channel_id").orderBy(F.desc("start"), F.desc("event_id"), F.desc("arrival")))
    return events.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def first_rows(rows: DataFrame, key: str, order: str, n: int, parts: int = 4096) -> DataFrame:
    """A key's first ``n`` rows in a numeric order, without all of its rows in one place:
    they are counted by parts of the order's range, and only within a part are they
    ranked."""
    ends = rows.groupBy(key).agg(F.min(order).alias("_lo"), F.max(order).alias("_hi"))
    part = F.expr(f"cast((cast({order} as decimal(20,0)) - _lo) * {parts} / (cast(_hi as decimal(20,0)) - _lo + 1) as int)")
    dealt = rows.join(ends, key).withColumn("_part", part)
    counts = dealt.groupBy(key, "_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(key).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("_before", before).where(F.col("_before") < n).drop("_n")
    ranked = dealt.join(counts, [key, "_part"]).withColumn("_r", F.row_number().over(W.partitionBy(key, "_part").orderBy(order)))
    return ranked.where(F.col("_before") + F.col("_r") <= n).select(*rows.columns)


def first_arrived(events: DataFrame, per_channel: int = PER_CHANNEL, per_source: int = PER_SOURCE, channels: int = CHANNELS) -> DataFrame:
    """O3: a source's first channels to arrive, a channel's first events and a source's,
    up to their limits."""
    rank = lambda rows, keys, order, n: rows.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(order))).where(F.col("_r") <= n).drop("_r")
    first = events.groupBy("source_id", "channel_id").agg(F.min("arrival").alias("_first"))
    known = rank(first, ["source_id"], "_first", channels).select("source_id", "channel_id")
    kept = rank(events.join(known, ["source_id", "channel_id"], "left_semi"), ["source_id", "channel_id"], "arrival", per_channel)
    return first_rows(kept, "source_id", "arrival", per_source)


def left_out(events: DataFrame, kept: DataFrame) -> DataFrame:
    """O3: events of each source beyond its limits."""
    n = lambda rows, name: rows.groupBy("source_id").agg(F.count("*").alias(name))
    both = n(events, "_all").join(n(kept, "_kept"), "source_id", "left")
    return both.select("source_id", (F.col("_all") - F.coalesce("_kept", F.lit(0))).alias("overflow"))


def now_next(events: DataFrame, now: int, keys: tuple[str, ...] = ("channel_id",)) -> DataFrame:
    """Start and title of what is on and of what follows, by channel."""
    on, later = (F.col("start") <= now) & (F.col("stop") > now), F.col("start") > now
    at = F.struct("start", "arrival")
    pick = lambda c, cond: F.min_by(F.when(cond, F.col(c)), F.when(cond, at))
    return events.groupBy(*keys).agg(
        F.min(F.when(on, F.col("start"))).alias("now_start"), pick("title", on).alias("now_title"),
        F.min(F.when(later, F.col("start"))).alias("next_start"), pick("title", later).alias("next_title"),
    )


def precedence(streams: DataFrame, broadcast: DataFrame, xml: DataFrame) -> DataFrame:
    """A stream's guide: broadcast only, XML only, or (auto) broadcast where it has
    what is on or what follows, and XML elsewhere."""
    cols = ("now_start", "now_title", "next_start", "next_title")
    named = lambda df, p: df.select("channel_id", *[F.col(c).alias(f"{p}_{c}") for c in cols])
    rows = streams.join(named(broadcast, "b"), "channel_id", "left").join(named(xml, "x"), "channel_id", "left")
    has = F.col("b_now_start").isNotNull() | F.col("b_next_start").isNotNull()
    own = F.when(F.col("mode") == "broadcast", True).when(F.col("mode") == "xml", False).otherwise(has)
    return rows.select("channel_id", "mode", F.when(own, "broadcast").otherwise("xml").alias("origin"), *[F.when(own, F.col(f"b_{c}")).otherwise(F.col(f"x_{c}")).alias(c) for c in cols])


def first_source(events: DataFrame, sources: DataFrame, now: int, days: int = 7) -> DataFrame:
    """A channel's events from the first enabled source that has any in the window."""
    found = window(events, now, days).join(sources.where("enabled").select("source_id"), "source_id", "left_semi")
    best = found.groupBy("channel_id").agg(F.min("source_id").alias("source_id"))
    return found.join(best, ["channel_id", "source_id"], "left_semi")


def mapping(assignments: DataFrame, sources: DataFrame) -> DataFrame:
    """Wanted (source, channel) pairs; no source stands for every enabled one. The
    sources are the small side of that pairing: a list kept by hand."""
    named = assignments.where("source_id is not null").select("source_id", "channel_id")
    every = assignments.where("source_id is null").select("channel_id").join(sources.where("enabled").select("source_id"), how="cross")
    return named.unionByName(every.select("source_id", "channel_id")).distinct()


def section_numbers(events: DataFrame, table_base: int = 0x50) -> DataFrame:
    """Table, section and last section numbers of a channel's events by start."""
    own = W.partitionBy("channel_id").orderBy("start", "event_id", "arrival")
    rows = events.withColumn("_i", F.row_number().over(own) - 1).withColumn("_n", F.count("*").over(W.partitionBy("channel_id")))
    rows = rows.withColumns({
        "table_id": F.lit(table_base) + F.expr("cast(_i div 256 as int)"), "section": F.col("_i") % 256,
        "last_section": F.when(F.expr("_i div 256 = (_n - 1) div 256"), (F.col("_n") - 1) % 256).otherwise(255).cast("int"),
    })
    return rows.withColumn("segment_last", F.least(F.col("last_section"), F.col("section").bitwiseOR(F.lit(7)))).drop("_i", "_n")


def version(contents: DataFrame, span: int = PACKETS) -> DataFrame:
    """A version from 0 to 31 that goes up when the content changes."""
    rows = Scan(contents, ["stream_id"], ["seq"], span).add(_b=lag("digest"))
    changed = F.coalesce(F.col("digest") != F.col("_b.digest"), F.lit(False)).cast("long")
    return rows.add(_n=Total(changed)).done().withColumn("version", F.pmod("_n", F.lit(32))).drop("_b", "_n")


def snapshot(events: DataFrame, channel: Column | int, now: int, days: int = 7) -> DataFrame:
    """One channel's events from six hours ago to ``days`` ahead, in order."""
    return window(events.where(F.col("channel_id") == channel), now, days).orderBy("start", "event_id")


def source_status(events: DataFrame) -> DataFrame:
    """Channels and events by source."""
    return events.groupBy("source_id").agg(F.countDistinct("channel_id").alias("channels"), F.count("*").alias("events"), (F.count("*") > PER_SOURCE).alias("truncated"))


def refresh_due(sources: DataFrame, now: int, zone: str = "UTC", back_off_s: int = 900) -> DataFrame:
    """Enabled sources whose daily or weekly time has come since the last run."""
    local = F.from_utc_timestamp(F.timestamp_seconds(F.lit(now)), zone)
    today = F.to_date(local)
    slot = F.hour(local) * 60 + F.minute(local) >= F.col("hour") * 60 + F.col("minute")
    right_day = (F.col("every") == "daily") | (F.dayofweek(local) == F.col("weekday"))
    ran = F.coalesce(F.to_date(F.from_utc_timestamp(F.timestamp_seconds("last_run"), zone)) == today, F.lit(False))
    waiting = F.coalesce(F.lit(now) - F.col("last_error") < back_off_s, F.lit(False))
    return sources.where(F.col("enabled") & right_day & slot & ~ran & ~waiting)


def xmltv(channels: DataFrame, events: DataFrame) -> DataFrame:
    """K1: the lines of an XMLTV document in order: every channel, then the programmes
    that have a title and an end after their start."""
    head = channels.select(F.lit(0).alias("part"), F.col("channel_id").cast("string").alias("_k"), F.lit(0).cast("long").alias("_s"), F.concat(
        F.lit('<channel id="'), xml_escape(F.col("channel_id").cast("string")), F.lit('"><display-name>'), xml_escape("name"), F.lit("</display-name></channel>")).alias("line"))
    body = events.where((F.col("stop") > F.col("start")) & (F.col("title") != "")).select(F.lit(1).alias("part"), F.col("channel_id").cast("string").alias("_k"), F.col("start").alias("_s"), F.concat(
        F.lit('<programme start="'), epg_xml_time("start"), F.lit('" stop="'), epg_xml_time("stop"), F.lit('" channel="'), xml_escape(F.col("channel_id").cast("string")),
        F.lit('"><title>'), xml_escape("title"), F.lit("</title></programme>")).alias("line"))
    return head.unionByName(body).orderBy("part", "_k", "_s", "line").select("part", "line")


def m3u(streams: DataFrame) -> DataFrame:
    """K2: the entries of a playlist: a stream's outputs but for those that push, with
    the kind named where there are several. ``streams(ord, name, tvg_id, outputs
    array<struct<type, url>>)``."""
    pulled = F.filter("outputs", lambda o: ~o["type"].isin("udp", "srt-push", "rtmp", "rtp"))
    rows = streams.withColumn("_o", pulled).withColumn("_several", F.size("_o") > 1).select("*", F.posexplode("_o").alias("_i", "_out"))
    title = F.when(F.col("_several"), F.concat(m3u_line("name"), F.lit(" ["), F.col("_out.type"), F.lit("]"))).otherwise(m3u_line("name"))
    return rows.select("ord", F.col("_i").alias("output"), F.concat(F.lit('#EXTINF:-1 tvg-id="'), m3u_attribute("tvg_id"), F.lit('",'), title, F.lit("\n"), F.col("_out.url")).alias("entry"))
