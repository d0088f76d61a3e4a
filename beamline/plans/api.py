"""The read-only query surface, as functions from relations to DataFrames.

Each stands for one request of a running system; ``now`` is a parameter, so an answer can
be given for any time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import guide, quality, sessions, timing
from ..sources import sections as S

#: Least and greatest periods of history requests, in seconds.
QUALITY_PERIOD, LOAD_PERIOD = (60, 30 * 86_400), (360, 86_400)


def _held(period_s: int, bounds: tuple[int, int]) -> int:
    return max(bounds[0], min(bounds[1], period_s))


def quality_history(samples: DataFrame, stream_id, period_s: int, now: int) -> DataFrame:
    """Samples of one stream in the period, in order."""
    own = quality.period(samples.where(F.col("stream_id") == stream_id), now, _held(period_s, QUALITY_PERIOD))
    return own.orderBy("ts")


def load_history(samples: DataFrame, period_s: int, now: int) -> DataFrame:
    """Load samples of the period; ``t`` is in milliseconds."""
    first = now - _held(period_s, LOAD_PERIOD)
    return samples.where(F.col("t").between(first * 1000, now * 1000)).orderBy("t")


def epg_snapshot(events: DataFrame, channel_id, now: int, days: int = 7) -> DataFrame:
    """A channel's guide around now."""
    return guide.snapshot(events, channel_id, now, days)


def epg_now_next(events: DataFrame, channel_id, now: int) -> DataFrame:
    """What is on a channel and what follows."""
    return guide.now_next(events.where(F.col("channel_id") == channel_id), now)


def export_xmltv(channels: DataFrame, events: DataFrame, now: int, days: int = 7) -> DataFrame:
    """The lines of the guide document."""
    return guide.xmltv(channels, guide.window(events, now, days))


def export_m3u(streams: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """The playlist's entries, of the allowed streams only."""
    rows = streams if allowed is None else streams.join(allowed.select("stream_id").distinct(), "stream_id", "left_semi")
    return guide.m3u(rows).orderBy("ord", "output")


def guide_status(events: DataFrame) -> DataFrame:
    """Channels and events of each source."""
    return guide.source_status(events)


def guide_channels(events: DataFrame, source_id) -> DataFrame:
    """The channels of a source with their events."""
    return events.where(F.col("source_id") == source_id).groupBy("channel_id").agg(F.count("*").alias("events")).orderBy("channel_id")


def _newest_map(sections: DataFrame, stream_id, sid: int, rows: DataFrame) -> DataFrame:
    """``rows`` of a program's newest map."""
    program = F.conv(F.hex(F.substring("bytes", 4, 2)), 16, 10).cast("int")
    newest = sections.where((F.col("stream_id") == stream_id) & (F.col("table_id") == 2) & F.col("crc_ok") & (program == sid)).agg(F.max("seq").alias("seq"))
    return rows.where(F.col("sid") == sid).join(newest, "seq", "left_semi")


def media_tracks(sections: DataFrame, stream_id, sid: int) -> DataFrame:
    """Video and audio of a program by its newest map."""
    rows = S.pmt(sections.where(F.col("stream_id") == stream_id)).where(F.col("sid") == sid)
    newest = rows.groupBy("sid").agg(F.max("seq").alias("seq"))
    return rows.join(newest, ["sid", "seq"], "left_semi").where("kind <> 'data'").select("ord", "es_pid", "kind", "codec", "language").orderBy("ord")


def subtitle_tracks(sections: DataFrame, stream_id, sid: int) -> DataFrame:
    """Subtitle pages of a program by its newest map; none if that lists none."""
    rows = S.subtitles(sections.where(F.col("stream_id") == stream_id))
    return _newest_map(sections, stream_id, sid, rows).select("ord", "track_id", "es_pid", "language", "subtitle_type", "composition_page", "ancillary_page").orderBy("ord")


def stream_state(config: DataFrame, state: DataFrame) -> DataFrame:
    """Every configured stream with its state."""
    return quality.with_state(config, state)


def active_sessions(requests: DataFrame, now: int, ttl_s: int = sessions.TTL_S) -> DataFrame:
    """Sessions that are active now, by client, stream and protocol."""
    return sessions.grouped(sessions.active(sessions.sessions(requests, ttl_s), now, ttl_s), now)


def cluster_node(config: DataFrame, state: DataFrame, viewers: DataFrame, most: int = 512) -> DataFrame:
    """A node's channels."""
    return quality.channel_rows(config, state, viewers, most)


def cluster_status(own: DataFrame, peers: DataFrame) -> DataFrame:
    """A node's channels with the same ones of its peers."""
    return sessions.same_channel(own, peers)


def route(origins: DataFrame, client: str, balance: bool = False) -> DataFrame:
    """The origin that serves a client, for each stream."""
    return sessions.choose_origin(origins, F.lit(client), balance)


def host_rates(totals: DataFrame) -> DataFrame:
    """Interface rates from byte totals."""
    return timing.interface_rate(totals)
