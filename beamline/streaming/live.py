"""Operators under Structured Streaming, with event time and bounded state."""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.folds import IDLE_S, failover_step, recheck_seconds, registry_step, registry_until

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, lateness: str = "10 minutes") -> DataFrame:
    """Events from a folder of Parquet files as they arrive; a watermark needs a time
    with a zone."""
    rows = spark.readStream.schema(EVENTS).parquet(path)
    return rows.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", lateness)


def viewer_sessions(events: DataFrame, gap: str = "2 minutes") -> DataFrame:
    """Sessions of a viewer that end after ``gap`` without a request."""
    return events.groupBy(F.session_window("at", gap).alias("w"), (F.col("user_id") % 20).alias("viewer"), "event_type").agg(F.count("*").alias("requests")).select("viewer", "event_type", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "requests")


def error_windows(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """Events and errors of each stream in fixed windows."""
    return events.groupBy(F.window("at", width).alias("w"), (F.col("user_id") % 8).alias("stream_id")).agg(F.count("*").alias("events"), F.sum((F.col("event_type") == "error").cast("long")).alias("errors")).select(F.col("w.start").alias("start"), "stream_id", "events", "errors")


def failover_live(probes: DataFrame) -> DataFrame:
    """Switches between primary and backup, by the step of the fold over stored
    probes. The state of a stream is what the step keeps; it goes after an hour of event
    time without a probe. ``probes(stream_id, at, active, stalled, primary_healthy,
    starts)`` with a watermark on ``at``."""
    out, state_ddl = "stream_id long, at timestamp, source string, cause string, done boolean", "first long, backup boolean, healthy int, next long"

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        own = dict(zip(("first", "backup", "healthy", "next"), state.get)) if state.exists else {}
        rows, probed = [], pd.concat(list(batches)).sort_values("at")
        probed["ts"] = probed["at"].map(lambda t: int(t.timestamp()))
        for row in probed.itertuples():
            rows += [(key[0], row.at, source, cause, done) for _, source, cause, done in failover_step(own, row)]
        state.update((own["first"], own["backup"], own["healthy"], own["next"]))
        last = int(probed["ts"].iloc[-1]) * 1000
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + 3_600_000)
        yield pd.DataFrame(rows, columns=["stream_id", "at", "source", "cause", "done"])

    return probes.groupBy("stream_id").applyInPandasWithState(run, out, state_ddl, "append", "EventTimeTimeout")


class SessionRegistry(StatefulProcessor):
    """A session's rows wait until the watermark has passed them, then go through the step
    of the fold in order; timers wake it when a recheck is due or it has been idle.

    State of a session: six values, and its rows of one watermark delay. It is gone once
    the session is forgotten."""

    FIELDS = ("seen", "due", "revoked", "open", "verdict", "hls")
    ROW = namedtuple("Row", "ts request_id kind granted protocol")

    def __init__(self, recheck: int):
        self.recheck = recheck

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.own = handle.getValueState("session", "seen long, due long, revoked boolean, open int, verdict boolean, hls boolean")
        self.waiting = handle.getListState("waiting", "ts long, request_id long, kind string, granted boolean, protocol string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            found = [tuple(None if pd.isna(v) else v for v in row) for row in pdf[list(self.ROW._fields)].astype(object).itertuples(index=False)]
            self.waiting.appendList(found)
            for second in {ts for ts, *_ in found}:
                self.handle.registerTimer((int(second) + 1) * 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() // 1000
        state = dict(zip(self.FIELDS, self.own.get())) if self.own.exists() else {}
        rows = [self.ROW(*row) for row in self.waiting.get()]
        due = sorted((r for r in rows if r.ts < now), key=lambda r: (r.ts, r.request_id is not None, r.request_id))
        if due:
            later = [tuple(r) for r in rows if r.ts >= now]
            self.waiting.put(later) if later else self.waiting.clear()
        out = [r for row in due for r in registry_step(state, row, self.recheck)] + registry_until(state, now, self.recheck)
        if state:
            self.own.update(tuple(state[f] for f in self.FIELDS))
            wakes = [state["due"] + 1] * (not state["revoked"]) + [state["seen"] + IDLE_S + 1] * (not state["open"])
            if wakes:
                self.handle.registerTimer(max(min(wakes), now + 1) * 1000)
        elif self.own.exists():
            self.own.clear()
        if out:
            yield pd.DataFrame({"session_id": [key[0]] * len(out), **{name: pd.array([r[k] for r in out], kind) for k, (name, kind) in enumerate((("ts", "Int64"), ("request_id", "Int64"), ("checked", "boolean"), ("allowed", "boolean")))}})

    def close(self) -> None:
        pass


def authorised_live(events: DataFrame, recheck_minutes: int = 10) -> DataFrame:
    """T17 under streaming: the rows of ``folds.authorised`` as the watermark passes them.

    ``events`` has ``at``, a time with a watermark (rows without one are dropped), in place
    of ``ts``, and a session_id string. A session is rechecked, revoked and forgotten by
    timers, without a request. Sets the state store that timers need. The registry's cap
    of sessions in one process is not applied: state is spread over the executors."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    protocol = F.col("protocol") if "protocol" in events.columns else F.lit("hls").alias("protocol")
    rows = events.where("at is not null").select("session_id", "at", F.floor(F.col("at").cast("double")).cast("long").alias("ts"), "request_id", "kind", "granted", protocol)
    processor = SessionRegistry(recheck_seconds(recheck_minutes))
    return rows.groupBy("session_id").transformWithStateInPandas(processor, "session_id string, ts long, request_id long, checked boolean, allowed boolean", "append", "EventTime")


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Everything that has arrived, written to ``path`` once; restarts go on from
    ``checkpoint``."""
    query = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)
