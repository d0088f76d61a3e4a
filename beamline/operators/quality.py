"""Quality and load history: levels, periods, persisted points, merges, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .timing import with_deltas

RING_ROWS, RETENTION_S, LOAD_RETENTION_S, SLACK_S = 240, 30 * 86_400, 86_400, 300
DEVIATION = 0.20


def level(active: Column, status: Column, in_kbps: Column, out_kbps: Column, target_kbps: Column, cc: Column) -> Column:
    """The first rule that holds gives the level."""
    off_target = (target_kbps > 0) & (F.abs(out_kbps - target_kbps) / target_kbps > DEVIATION)
    return (
        F.when(~active, "offline").when(F.lower(status).rlike("error|failed|ended"), "error").when(in_kbps == 0, "warn")
        .when(cc > 0, "error").when(off_target, "warn").otherwise("ok")
    )


def classified(samples: DataFrame) -> DataFrame:
    """Samples with the growth of their counter and their level."""
    return with_deltas(samples).withColumnRenamed("delta", "cc").withColumn(
        "level", level(F.col("active"), F.col("status"), F.col("in_kbps"), F.col("out_kbps"), F.col("target_kbps"), F.col("cc"))
    )


def period(samples: DataFrame, now: int, seconds: int, least: int = 60, most: int = RETENTION_S, slack: int = SLACK_S) -> DataFrame:
    """Samples of the last ``seconds`` (held within ``least`` and ``most``)."""
    seconds = max(least, min(most, seconds))
    return samples.where((F.col("ts") >= now - seconds) & (F.col("ts") <= now + slack))


def summary(samples: DataFrame) -> DataFrame:
    """Samples and counter growth by stream and level."""
    return samples.groupBy("stream_id", "level").agg(F.count("*").alias("n"), F.sum("cc").alias("cc"))


def ring(samples: DataFrame, rows: int = RING_ROWS) -> DataFrame:
    """The newest ``rows`` samples of each stream."""
    place = F.row_number().over(W.partitionBy("stream_id").orderBy(F.desc("ts"), F.desc("sample_id")))
    return samples.withColumn("_place", place).where(F.col("_place") <= rows).drop("_place")


#: Fixed value: the message of a point with errors.
GROWTH = "CC-errors MPEG-TS за интервал: вход=%d, выход=%d"


def persisted_point(samples: DataFrame, now: int, seconds: int = 300) -> DataFrame:
    """A stream's newest sample up to ``now`` with the growth of both counters in the
    last ``seconds``; any growth makes it an error with a message of its own.

    ``samples(stream_id, ts, sample_id, in_kbps, out_kbps, level, message, in_cc, out_cc)``"""
    latest = lambda c: F.max_by(c, F.struct("ts", "sample_id")).alias(c)
    grown = lambda c: F.coalesce(F.sum(F.when(F.col("ts") >= now - seconds, F.col(c))), F.lit(0)).alias(c)
    out = samples.where(F.col("ts") <= now).groupBy("stream_id").agg(F.max("ts").alias("ts"), *map(latest, ("in_kbps", "out_kbps", "level", "message")), grown("in_cc"), grown("out_cc"))
    bad = (F.col("in_cc") > 0) | (F.col("out_cc") > 0)
    return out.withColumns({"level": F.when(bad, "error").otherwise(F.col("level")), "message": F.when(bad, F.format_string(GROWTH, "in_cc", "out_cc")).otherwise(F.col("message"))})


def merged(disk: DataFrame, memory: DataFrame) -> DataFrame:
    """Samples of both, one for each time of a stream; those in memory win."""
    both = disk.withColumn("_rank", F.lit(1)).unionByName(memory.withColumn("_rank", F.lit(0)))
    place = F.row_number().over(W.partitionBy("stream_id", "ts").orderBy("_rank", F.desc("sample_id")))
    return both.withColumn("_place", place).where("_place = 1").drop("_rank", "_place")


def with_state(config: DataFrame, state: DataFrame) -> DataFrame:
    """Every configured stream with its state; ``stopped`` where it has none."""
    return config.join(state, "stream_id", "left").withColumn("active", F.coalesce("active", F.lit(False))).withColumn("status", F.coalesce("status", F.lit("stopped")))


def output_rate(cbr: Column, target: Column, measured: Column, payload: Column) -> Column:
    """The target of a constant rate, else what is measured, else the payload."""
    return F.when(cbr, target).when(measured > 0, measured).otherwise(payload)


def load_summary(samples: DataFrame) -> DataFrame:
    """Mean and peak of processor share and memory by stream."""
    return samples.groupBy("stream_id").agg(F.avg("cpu").alias("cpu_mean"), F.max("cpu").alias("cpu_max"), F.max("rss").alias("rss_max"))


def alerts(samples: DataFrame) -> DataFrame:
    """A row for each change of a stream between up and down."""
    own = W.partitionBy("stream_id").orderBy("ts", "sample_id")
    return samples.withColumn("_before", F.lag("active").over(own)).where("_before <> active").withColumn("event", F.when(F.col("active"), "up").otherwise("down")).drop("_before")


def channel_rows(config: DataFrame, state: DataFrame, viewers: DataFrame, most: int = 512) -> DataFrame:
    """A node's first ``most`` channels (by ``ord``) with what runs and
    who watches; rates are zero where nothing runs."""
    rows = with_state(config.orderBy("ord").limit(most), state).join(viewers, "stream_id", "left")
    rate = lambda c: F.when(F.col("active"), F.expr(f"{c} div 1000")).otherwise(0).alias(f"{c}_kbps")
    return rows.select("ord", "stream_id", "name", "active", F.coalesce("viewers", F.lit(0)).alias("viewers"), rate("bitrate_in"), rate("bitrate_out"))
