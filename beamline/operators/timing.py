"""Counters and clocks over time: deltas, moving rates, silence, interpolation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .folds import PCR_WRAP, PTS_WRAP, fold
from .scans import PACKETS, SECONDS, Last, Next, Scan, Total, Trailing, lag


def over(*order: str) -> W:
    return W.partitionBy("stream_id").orderBy(*order)


def counter_delta(counter: str, window: W, first=None) -> Column:
    """Growth of a counter; after a reset its value, at the first row ``first``
    (by default the value)."""
    now, before = F.col(counter), F.lag(counter).over(window)
    return F.when(before.isNull(), now if first is None else first).when(now >= before, now - before).otherwise(now)


def by_stream(samples: DataFrame, span: int) -> Scan:
    return Scan(samples, ["stream_id"], ["ts", "sample_id"], span)


def with_deltas(samples: DataFrame, counter: str = "cc_total", span: int = SECONDS) -> DataFrame:
    """``delta`` of a counter of ``samples(stream_id, ts, sample_id, ...)``."""
    rows, now, before = by_stream(samples, span).add(_b=lag(counter)).done(), F.col(counter), F.col(f"_b.{counter}")
    return rows.withColumn("delta", F.when(before.isNull(), now).when(now >= before, now - before).otherwise(now)).drop("_b")


def moving_rate(deltas: DataFrame, value: str = "bytes", span: int = SECONDS) -> DataFrame:
    """Eight times the mean of the last five deltas, in whole numbers."""
    rows = by_stream(deltas, span).add(_t=Trailing(F.col(value), 5)).done()
    return rows.withColumn("rate", F.expr("_t.total * 8 div _t.n")).drop("_t")


def interface_rate(totals: DataFrame, span: int = SECONDS) -> DataFrame:
    """Megabits a second from byte totals; nothing below zero."""
    rows = by_stream(totals, span).add(_b=lag("bytes_total", "ts")).done()
    grown, elapsed = F.greatest(F.lit(0), F.col("bytes_total") - F.col("_b.bytes_total")), F.col("ts") - F.col("_b.ts")
    return rows.withColumn("mbps", F.when(elapsed > 0, grown * 8 / elapsed / 1e6)).drop("_b")


def busy_percent(busy: Column, total: Column, window: W) -> Column:
    """Share of busy ticks since the row before, 0 to 100."""
    b, t = busy - F.lag(busy).over(window), total - F.lag(total).over(window)
    return F.when(t > 0, F.greatest(F.lit(0.0), F.least(F.lit(100.0), b * 100.0 / t)))


def silence(samples: DataFrame, counter: str, span: int = SECONDS) -> DataFrame:
    """Seconds since the counter last grew (since the first row, at first)."""
    rows = by_stream(samples, span).add(_b=lag(counter))
    grew = F.coalesce(F.col(counter) > F.col(f"_b.{counter}"), F.lit(True))
    rows = rows.add(_at=Last(F.when(grew, F.col("ts")), here=True)).done()
    return rows.withColumn("silence_s", F.col("ts") - F.col("_at")).drop("_b", "_at")


def interpolate(packets: DataFrame, key: str = "stream_id", span: int = PACKETS) -> DataFrame:
    """The clock at every packet, on the line between the anchors around it.

    ``packets(key, idx, pcr27)``, ``pcr27`` null where there is no anchor. Beyond the
    outermost anchors the nearest interval's line goes on. Scans in either direction take
    the place of a range join: first each anchor's neighbours, then each packet's anchors
    with their neighbours."""
    is_anchor, anchor = F.col("pcr27").isNotNull(), F.struct("idx", "pcr27")
    rows = Scan(packets, [key], ["idx"], span).add(_before=Last(F.when(is_anchor, anchor)), _after=Next(F.when(is_anchor, anchor)))
    left, right = (F.when(is_anchor, F.struct(anchor.alias("a"), F.col(c).alias("b"))) for c in ("_before", "_after"))
    rows = rows.add(_l=Last(left, here=True), _r=Next(right, here=True)).done()
    p = F.when(F.col("_l").isNull(), F.col("_r.a")).when(F.col("_r").isNull(), F.col("_l.b")).otherwise(F.col("_l.a"))
    q = F.when(F.col("_l").isNull(), F.col("_r.b")).when(F.col("_r").isNull(), F.col("_l.a")).otherwise(F.col("_r.a"))
    rows = rows.withColumn("_p", p).withColumn("_q", q)
    product = F.col("_q.pcr27").cast("decimal(20,0)") - F.col("_p.pcr27")
    rows = rows.withColumn("_d", product * (F.col("idx") - F.col("_p.idx")).cast("decimal(18,0)")).withColumn("_n", F.col("_q.idx") - F.col("_p.idx"))
    clock = F.when(is_anchor, F.col("pcr27")).otherwise(F.col("_p.pcr27") + F.expr("cast(_d div cast(_n as decimal(18,0)) as bigint)"))
    return rows.withColumn("clock27", clock).select(*packets.columns, "clock27")


def counted_on(packets: DataFrame, clock: str = "pcr27", wrap: int = PCR_WRAP, span: int = PACKETS) -> DataFrame:
    """``packets(stream_id, seq, ...)`` with the rounds of a clock that goes round added to
    it; a step of more than half a round is one the other way across its end."""
    rows = Scan(packets, ["stream_id"], ["seq"], span).add(_b=Last(F.col(clock)))
    step = F.col(clock) - F.col("_b")
    rounds = rows.add(_n=Total(F.when(step < -wrap // 2, 1).when(step > wrap // 2, -1).otherwise(0).cast("long"))).done()
    return rounds.withColumn(clock, F.col(clock) + F.col("_n") * wrap).drop("_b", "_n")


def loop_clock(samples: DataFrame, lead: int = 3600) -> DataFrame:
    """Clocks of a file that plays again and again. ``samples(stream_id, loop, idx,
    pts)``: each loop is moved by the spans of those before it and ``lead`` each."""
    spans = samples.groupBy("stream_id", "loop").agg(F.min("pts").alias("_first"), (F.max("pts") - F.min("pts")).alias("_span"))
    own = W.partitionBy("stream_id").orderBy("loop").rowsBetween(W.unboundedPreceding, -1)
    spans = spans.withColumn("_offset", F.coalesce(F.sum(F.col("_span") + lead).over(own), F.lit(0)))
    return samples.join(spans, ["stream_id", "loop"]).withColumn("out_pts", F.col("pts") - F.col("_first") + F.col("_offset")).drop("_first", "_span", "_offset")


def replayed(samples: DataFrame, loops: int, lead: int = 3600) -> DataFrame:
    """A file that plays ``loops`` times with clocks that go on.
    ``samples(stream_id, idx, pts)``; gives ``loop`` and ``out_pts``, which starts at 0."""
    span = samples.groupBy("stream_id").agg(F.min("pts").alias("_first"), (F.max("pts") - F.min("pts") + lead).alias("_span"))
    rows = samples.join(span, "stream_id").withColumn("loop", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(loops - 1).cast("long"))))
    return rows.withColumn("out_pts", F.col("pts") - F.col("_first") + F.col("loop") * F.col("_span")).drop("_first", "_span")


def progress(packets: DataFrame, tracks: DataFrame, span: int = PACKETS) -> DataFrame:
    """What an output sends of its media: payload packets of the video and the audio
    pid, starts of video PES packets with a timestamp, and how often such a timestamp is
    another than the one before.

    ``tracks(stream_id, video_pid, audio_pid)``, one row a stream, null for none. Packets
    in error count for nothing; a stream without any media has zeros."""
    rows = packets.join(tracks, "stream_id")
    rows = rows.where(~F.col("tei") & F.col("has_payload") & ((F.col("pid") == F.col("video_pid")) | (F.col("pid") == F.col("audio_pid"))))
    start = F.coalesce((F.col("pid") == F.col("video_pid")) & F.col("pusi") & F.col("pts").isNotNull(), F.lit(False))
    rows = Scan(rows.select("stream_id", "seq", "pts", start.alias("_start")), ["stream_id"], ["seq"], span).add(_b=Last(F.when(F.col("_start"), F.col("pts")))).done()
    number = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    found = rows.groupBy("stream_id").agg(F.count("*").alias("media_packets"), number(F.col("_start")).alias("pes_starts"), number(F.col("_start") & (F.col("pts") != F.col("_b"))).alias("pts_changes"))
    return tracks.select("stream_id").join(found, "stream_id", "left").fillna(0, ["media_packets", "pes_starts", "pts_changes"])


#: Pictures of the long and of the quick test, ticks of the longest window,
#: pictures a second that count as 25, and ticks of a gap that does.
LONG, QUICK, LONGEST, AROUND_25, GAP_25 = 33, 5, 900_000, (23.5, 26.5), (3450, 3750)


def _in_order(stamps: list[int]) -> list[int]:
    """Timestamps around the first one, ascending."""
    return sorted((t - stamps[0] + PTS_WRAP // 2) % PTS_WRAP - PTS_WRAP // 2 for t in stamps)


def picture_rate(pictures: DataFrame) -> DataFrame:
    """Pictures a second from the median gap of the last ``LONG`` timestamps.

    ``pictures(stream_id, idx, pts)`` in 90 kHz ticks; timestamps are put in order within
    the window, as pictures are not sent in order of display. Before the window is full
    the last ``QUICK`` tell 25 a second if three of their gaps and the median do. A
    picture without a timestamp, or a window that has no length or more than ``LONGEST``
    ticks, starts afresh. Gives ``idx, fps, is_25``."""

    def step(state, row):
        held = state.setdefault("held", [])
        if row.pts is None:
            held.clear()
            return [(row.idx, 0.0, False)]
        held.append(row.pts % PTS_WRAP)
        del held[:-LONG]
        own = _in_order(held if len(held) == LONG else held[-QUICK:])
        if len(own) < QUICK:
            return [(row.idx, 0.0, False)]
        if len(own) == LONG and not 0 < own[-1] - own[0] <= LONGEST:
            held.clear()
            return [(row.idx, 0.0, False)]
        gaps = sorted(b - a for a, b in zip(own, own[1:]))
        middle = (gaps[len(gaps) // 2 - 1] + gaps[len(gaps) // 2]) / 2
        fps = 90_000 / middle if middle > 0 else 0.0
        if len(own) == LONG:
            return [(row.idx, fps, AROUND_25[0] <= fps <= AROUND_25[1])]
        fits = sum(GAP_25[0] <= g <= GAP_25[1] for g in gaps)
        return [(row.idx, fps, fits >= 3 and GAP_25[0] <= middle <= GAP_25[1])]

    return fold(pictures.select("stream_id", "idx", "pts"), "stream_id", ["idx"], step, "idx long, fps double, is_25 boolean")


def recovered_times(units: DataFrame, key: list[str], order: str, drift: int = 45_000) -> DataFrame:
    """Times of access units in place of ``pts`` and ``dts``, and ``corrected``.

    ``units`` has a source's times ``pts`` and ``dts`` where one belongs to the unit, the
    ticks ``step`` since the unit before, and ``start_pts``, ``start_dts``, the times with
    which the first unit starts (may be null). Times go on by ``step`` until a source's
    time is more than ``drift`` off, or there was none to go on from; from there on each
    one is taken as it is. ``corrected`` says that it changed the time.

    Before that lock and after it, a time is a base and the steps since: no state."""
    own = W.partitionBy(*key).orderBy(order)
    upto = own.rowsBetween(W.unboundedPreceding, 0)
    rows = units.withColumn("_inner", F.row_number().over(own) > 1)
    rows = rows.withColumn("_ticks", F.sum(F.when(F.col("_inner"), F.col("step")).otherwise(0)).over(upto))
    rows = rows.withColumns({"_pts": F.first("start_pts").over(upto), "_dts": F.first("start_dts").over(upto)})
    off = F.pmod(F.col("pts") - F.col("_pts") - F.col("_ticks") + PTS_WRAP // 2, F.lit(PTS_WRAP)) - PTS_WRAP // 2
    breaks = F.col("pts").isNotNull() & F.coalesce(F.abs(off) > drift, F.lit(True))
    rows = rows.withColumn("_locked", F.max(breaks).over(upto))
    rows = rows.withColumn("_base", F.last(F.when(F.col("_locked") & F.col("pts").isNotNull(), F.struct((F.col("pts") - F.col("_ticks")).alias("p"), (F.col("dts") - F.col("_ticks")).alias("d"))), True).over(upto))
    at = lambda source, free: F.pmod(F.when(F.col("_locked"), F.col(source)).otherwise(F.col(free)) + F.col("_ticks"), F.lit(PTS_WRAP))
    rows = rows.withColumns({"_p": at("_base.p", "_pts"), "_d": at("_base.d", "_dts")})
    guess = lambda now, free: F.when(F.col("_inner"), F.pmod(F.lag(now).over(own) + F.col("step"), F.lit(PTS_WRAP))).otherwise(F.col(free))
    same = guess("_p", "_pts").eqNullSafe(F.col("_p")) & guess("_d", "_dts").eqNullSafe(F.col("_d"))
    rows = rows.withColumn("corrected", F.col("_locked") & F.col("pts").isNotNull() & ~same)
    return rows.withColumns({"pts": F.col("_p"), "dts": F.col("_d")}).drop("_inner", "_ticks", "_pts", "_dts", "_locked", "_base", "_p", "_d")
