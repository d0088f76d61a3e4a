"""The session registry: checks when due, open connections, and the same under streaming."""

import random

import pytest
from pyspark.sql import functions as F

from beamline.operators import folds
from beamline.streaming import live

DDL = "session_id string, ts long, request_id long, kind string, granted boolean, protocol string"


def decisions(spark, rows, **options):
    df = spark.createDataFrame([(s, ts, k, kind, granted, protocol) for k, (s, ts, kind, granted, protocol) in enumerate(rows)], DDL)
    return sorted(((r.session_id, r.ts, r.request_id, r.checked, r.allowed) for r in folds.authorised(df, **options).collect()), key=str)


def test_a_recheck_needs_no_request(spark):
    """Checked at 0 for a minute, seen until 50: checked again at 60 by the registry."""
    said = [("a", 0, "request", True, "hls"), ("a", 50, "verdict", False, "hls"), ("a", 61, "request", True, "hls")]
    assert decisions(spark, said, recheck_minutes=1) == [("a", 0, 0, True, True), ("a", 60, None, True, False), ("a", 61, 2, False, False)]
    same = [("a", 0, "request", True, "hls"), ("a", 50, "verdict", False, "hls"), ("a", 60, "request", True, "hls")]
    assert decisions(spark, same, recheck_minutes=1) == [("a", 0, 0, True, True), ("a", 60, 2, True, True)]


def test_an_idle_session_is_rechecked_for_two_minutes_and_an_open_one_for_good(spark):
    seen = [("a", 0, "request", True, "hls")]
    assert [r[1] for r in decisions(spark, seen, recheck_minutes=1, now=1000)] == [0, 120, 60]
    held = [*seen, ("a", 5, "open", None, "hls")]
    assert sorted(r[1] for r in decisions(spark, held, recheck_minutes=5, now=1000)) == [0, 300, 600, 900]
    left = [*held, ("a", 310, "close", None, "hls"), ("a", 320, "request", True, "hls"), ("a", 700, "request", False, "hls")]
    assert [(r[1], r[3], r[4]) for r in decisions(spark, left, recheck_minutes=5) if r[2] is not None] == [(0, True, True), (320, True, True), (700, True, False)]  # a close is no sign of life


def test_a_refused_or_revoked_session_stays_shut_while_it_is_open(spark):
    rows = [("a", 0, "request", True, "hls"), ("a", 1, "open", None, "hls"), ("a", 60, "request", False, "hls"), ("a", 500, "request", True, "hls"), ("a", 501, "close", None, "hls"), ("a", 502, "request", True, "hls")]
    assert [(r[1], r[3], r[4]) for r in sorted(decisions(spark, rows, recheck_minutes=1), key=lambda r: r[1])] == [(0, True, True), (60, True, False), (500, False, False), (502, True, True)]
    ends = [("a", 0, "request", True, "udp"), ("a", 1, "open", None, "udp"), ("a", 2, "revoke", None, "udp"), ("a", 3, "request", True, "udp"), ("a", 4, "close", None, "udp"), ("a", 5, "request", True, "udp")]
    assert [(r[1], r[3], r[4]) for r in sorted(decisions(spark, ends), key=lambda r: r[1])] == [(0, True, True), (3, False, False), (5, True, True)]
    assert decisions(spark, [("a", 0, "request", None, "hls"), ("a", 1, "revoke", None, "hls"), ("a", 2, "request", True, "hls")]) == [("a", 0, 0, True, False), ("a", 2, 2, True, True)]


@pytest.mark.parametrize("minutes", [1, 3])
def test_the_stream_gives_the_rows_of_the_fold(spark, tmp_path, minutes):
    """Files arrive one after the other with rows out of order; timers do what is due between."""
    rng, rows, n = random.Random(minutes), [], 0
    for s in ("a", "b", "c", None, "never again"):
        ts = 0
        while ts < (60 if s == "never again" else 2400):
            ts += rng.choice([1, 5, 20, 50, 90, 119, 120, 121, 125, 300])
            kind = rng.choices(["request", "open", "close", "touch", "verdict", "revoke"], [10, 3, 3, 3, 2, 1])[0]
            rows.append((s, ts, n, kind, None if kind in ("open", "close", "touch") else rng.random() < 0.8, rng.choice(["hls", "hls", "udp"])))
            n += 1
    rows.sort(key=lambda r: r[1])
    source, out, place = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    chunks = [rows[k : k + 25] for k in range(0, len(rows), 25)]
    chunks += [[("clock", 9000, n, "touch", None, "hls")], [("clock", 9001, n + 1, "touch", None, "hls")]]
    for k, chunk in enumerate(chunks):
        rng.shuffle(chunk)
        df = spark.createDataFrame(chunk, DDL).withColumn("at", F.timestamp_seconds("ts")).drop("ts")
        df.coalesce(1).write.mode("append").parquet(source)
        if k in (3, len(chunks) - 2, len(chunks) - 1):
            events = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source).withWatermark("at", "400 seconds")
            got = live.run_available(live.authorised_live(events, minutes), out, place)
    stored = spark.createDataFrame(rows, DDL)
    want = folds.authorised(stored, minutes, now=8600)
    key = lambda df: sorted(str(tuple(r)) for r in df.select("session_id", "ts", "request_id", "checked", "allowed").collect())
    assert key(got) == key(want) and want.where("request_id is null").count() > 3
