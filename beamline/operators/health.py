"""Liveness, delivery faults and held states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scans import SECONDS, Last, Scan


def _silence(column: str, own: W) -> Column:
    grew = F.coalesce(F.col(column) > F.lag(column).over(own), F.lit(True))
    return F.when(grew, F.col("now_ms"))


def liveness(samples: DataFrame) -> DataFrame:
    """Whether each input stalls. ``samples(stream_id, now_ms, media_bytes,
    source_bytes, network)``.

    A network input stalls after 10 s without media when its source is silent as long,
    or after 18 s while the source goes on; other inputs after 5 s. Samples of one time
    are taken in order of their counters."""
    own = W.partitionBy("stream_id").orderBy("now_ms", "media_bytes", "source_bytes")
    upto = own.rowsBetween(W.unboundedPreceding, 0)
    rows = samples.withColumns({"_m": _silence("media_bytes", own), "_s": _silence("source_bytes", own)})
    rows = rows.withColumns({"media_silence_ms": F.col("now_ms") - F.last("_m", ignorenulls=True).over(upto), "source_silence_ms": F.col("now_ms") - F.last("_s", ignorenulls=True).over(upto)})
    media, source = F.col("media_silence_ms"), F.col("source_silence_ms")
    silent = source >= 10_000
    stalled = F.when(F.col("network"), (media >= 10_000) & (silent | (media >= 18_000))).otherwise(media >= 5_000)
    rows = rows.withColumn("stalled", stalled)
    grace = F.col("network") & ~F.col("stalled") & (media >= 5_000)
    cause = (
        F.when(F.col("stalled") & ~F.col("network"), "selected_media_silent").when(F.col("stalled") & silent, "network_and_media_silent")
        .when(F.col("stalled"), "network_alive_media_stalled").when(grace, "network_jitter_grace").otherwise("healthy")
    )
    recovered = F.coalesce(F.lag("stalled").over(own), F.lit(False)) & (media == 0)
    return rows.withColumn("cause", cause).withColumn("recovered", recovered).drop("_m", "_s")


def delivery_fault(evidence: DataFrame) -> DataFrame:
    """What is wrong with an output although its input is alive; null for nothing."""
    advancing = F.col("input_pts_advancing")
    fault = (
        F.when(~F.col("eligible") | ~F.col("input_media_recent") | (F.col("startup_ms") < 20_000), None)
        .when(~F.col("output_media_established"), "no_media_started").when(F.col("media_gap_ms") >= 18_000, "media_stalled")
        .when(advancing & F.col("output_pts_established") & (F.col("pts_gap_ms") >= 18_000), "video_pts_stalled")
        .when(advancing & ~F.col("output_pts_established") & (F.col("pes_starts") >= 3), "video_pts_never_advanced")
    )
    return evidence.withColumn("fault", fault)


#: The readings that a clear state is held over.
HELD_OVER = ("waiting", "invalid", "scrambled")


def held_state(samples: DataFrame, hold_s: int = 6, span: int = SECONDS) -> DataFrame:
    """``shown`` stays ``clear`` for less than ``hold_s`` after a clear reading, over
    readings of ``HELD_OVER``. Any other reading is shown and ends that, and so does one
    whose ``may_hold`` is false, where there is such a column; an inactive stream is
    ``offline`` and remembers nothing. ``samples(stream_id, ts, sample_id, active, state)``."""
    may = F.coalesce(F.col("may_hold"), F.lit(True)) if "may_hold" in samples.columns else F.lit(True)
    over = F.col("active") & may & F.coalesce(F.col("state").isin(*HELD_OVER), F.lit(False))
    cleared = F.col("active") & may & F.coalesce(F.col("state") == "clear", F.lit(False))
    mark = F.when(cleared, F.struct(F.col("ts").alias("at"))).when(~over, F.struct(F.lit(None).cast(samples.schema["ts"].dataType).alias("at")))
    rows = Scan(samples, ["stream_id"], ["ts", "sample_id"], span).add(_m=Last(mark)).done()
    held = over & (F.col("ts") - F.col("_m.at") < hold_s)
    return rows.withColumn("shown", F.when(~F.col("active"), "offline").when(held, "clear").otherwise(F.col("state"))).drop("_m")


def playable_start(packets: DataFrame) -> DataFrame:
    """clear packets that begin a PES packet with payload."""
    return packets.where(F.col("pusi") & F.col("has_payload") & ~F.col("tei") & (F.col("scrambling") == 0))


def idle(streams: DataFrame, now: Column) -> DataFrame:
    """On-demand streams to stop: nothing for 30 s, 75 s after a segment that was
    served, 120 s after a start without one."""
    quiet = now - F.greatest("last_activity", "started")
    limit = F.when(F.col("last_segment").isNull() & F.col("hls"), now - F.col("started") >= 120).when(F.col("last_segment").isNotNull(), now - F.col("last_segment") >= 75).otherwise(quiet >= 30)
    return streams.where(F.col("on_demand") & (F.col("viewers") == 0) & limit & (quiet >= 30))


#: States whose PES packets count, seconds for which PES and output count as
#: recent, and the state that a viewer confirms.
PES_STATES, PES_GRACE_S, OUTPUT_GRACE_S, CONFIRMED = ("unverified", "partial", "viewer_pes_ok"), 15, 6, "viewer_pes_ok"


def viewer_gate(snapshots: DataFrame) -> DataFrame:
    """``shown``: whether a viewer has confirmed a stream's decoding.

    ``snapshots(stream_id, ts, generation, state, active, output_healthy, clear_pes,
    client)``. A viewer confirms while PES evidence (clear PES packets behind a healthy
    output) is at most 15 s old and a healthy output at most 6 s; from then on that
    lasts, viewer or not, until either is older. An inactive stream, generation 0 and
    another generation start afresh. A stream's snapshots are one a second at most, and
    one task's."""
    own = W.partitionBy("stream_id").orderBy("ts")
    live = F.col("active") & (F.col("generation") != 0)
    rows = snapshots.withColumn("_live", live)
    fresh = ~F.col("_live") | ~F.coalesce(F.lag("_live").over(own), F.lit(False)) | (F.col("generation") != F.lag("generation").over(own))
    rows = rows.withColumn("_epoch", F.sum(fresh.cast("long")).over(own.rowsBetween(W.unboundedPreceding, 0)))
    upto = W.partitionBy("stream_id", "_epoch").orderBy("ts").rowsBetween(W.unboundedPreceding, 0)
    healthy = F.col("_live") & F.col("output_healthy")
    evidence = healthy & (F.col("clear_pes") > 0) & F.col("state").isin(*PES_STATES)
    age = lambda c: F.col("ts") - F.last(F.when(c, F.col("ts")), ignorenulls=True).over(upto)
    rows = rows.withColumn("_recent", F.coalesce((age(evidence) <= PES_GRACE_S) & (age(healthy) <= OUTPUT_GRACE_S), F.lit(False)))
    mark = F.when(~F.col("_recent"), F.lit(False)).when(F.col("client"), F.lit(True))
    confirmed = F.coalesce(F.last(mark, ignorenulls=True).over(upto), F.lit(False))
    shown = F.when(~F.col("active"), "offline").when(confirmed, CONFIRMED).otherwise(F.col("state"))
    return rows.withColumn("shown", shown).drop("_live", "_epoch", "_recent")
