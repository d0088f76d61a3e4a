"""Scalar functions, folds and operators that DuckDB has no form of."""

import random
from statistics import median

import pytest
from pyspark.sql import functions as F

from beamline.functions import scalars as X
from beamline.operators import folds, guide, health, hls, logs, sessions, timing


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def fnv(data: bytes) -> int:
    h = X.FNV_BASIS
    for b in data:
        h = (h ^ b) * X.FNV_PRIME % (1 << 64)
    return h - (1 << 64) if h >> 63 else h


@pytest.mark.parametrize("text", ["", "a", "10.0.0.1|node|http://x/y", "é" * 40])
def test_fnv(spark, text):
    assert one(spark, X.fnv1a64(F.lit(text))) == fnv(text.encode())


@pytest.mark.parametrize(
    "text, seconds",
    [("20240101000000 +0000", 1704067200), ("202401010000", 1704067200), ("20240101000000 +0130", 1704067200 - 5400), ("20240231000000", 1709337600 - 0), ("20240101000000 +01", 1704067200), ("20240101000000 +0x30", None), ("2024", None), ("20241301000000", None), ("", None)],
)
def test_xmltv_time(spark, text, seconds):
    assert one(spark, X.xmltv_time(F.lit(text))) == seconds


def test_broadcast_times(spark):
    assert one(spark, X.dvb_time(F.lit(0xE1B3), F.lit(0x12), F.lit(0x34), F.lit(0x56))) == (0xE1B3 - 40587) * 86400 + 12 * 3600 + 34 * 60 + 56
    assert one(spark, X.dvb_time(F.lit(0xFFFF), F.lit(0), F.lit(0), F.lit(0))) is None
    assert one(spark, X.dvb_time(F.lit(1), F.lit(0x24), F.lit(0), F.lit(0))) is None
    assert one(spark, X.dvb_duration(F.lit(0x30), F.lit(0x15), F.lit(0))) == 30 * 3600 + 900


def test_small_functions(spark):
    assert one(spark, X.clock_delta(F.lit(5), F.lit((1 << 33) - 5))) == 10
    assert one(spark, X.clock_delta(F.lit((1 << 33) - 5), F.lit(5))) == -10
    assert one(spark, X.spacing_ns(F.lit(1316), F.lit(8_000_000))) == 1_316_000
    assert one(spark, X.codec(F.lit(0x1B))) == "h264" and one(spark, X.kind(F.lit("ac3"))) == "audio"
    assert one(spark, X.orbital_position(F.lit(0x0130), F.lit(True))) == "13.0E"
    assert one(spark, X.without_credentials(F.lit("http://u:p@h/x?token=1"))) == "http://h/x"
    assert one(spark, X.query_value(F.lit("http://h/?a=1&b=x%20y"), "b")) == "x y" and one(spark, X.query_value(F.lit("http://h/"), "b")) is None
    assert one(spark, X.segment_settings(F.lit(0), F.lit(50), F.lit(True))) == (2, 30)
    assert one(spark, X.network_source(F.lit("SRT://x"))) and not one(spark, X.network_source(F.lit("/a.ts")))
    assert one(spark, X.signal_percent_db(F.lit(-40), F.lit(None).cast("double"))) == (60, 60, True)
    assert one(spark, X.output_pcr(F.lit(1_000_000), F.lit(8_000_000))) == 1_000_000 * 1504 * 27_000_000 // 8_000_000 % X.PCR_WRAP
    assert one(spark, X.transcode_settings(F.lit(1920), F.lit(1080), F.lit(25), F.lit(4_000_000))).gop == 50
    assert one(spark, X.compact(F.lit("  a \n b\t"))) == "a b"


def samples(n=400, seed=3):
    rng = random.Random(seed)
    return sorted((f"s{rng.randrange(3)}", rng.randrange(5000), k) for k in range(n))


def test_throttle_and_downsample(spark):
    rows = samples()
    df = spark.createDataFrame(rows, "stream_id string, ts long, sample_id long")
    kept, last = [], {}
    for s, ts, k in rows:
        if s not in last or ts - last[s] >= 30:
            last[s] = ts
            kept.append((s, k, ts))
    assert sorted(tuple(r) for r in folds.throttle(df).collect()) == sorted(kept)
    kept, last, now = [], {}, 5000
    for s, ts, k in rows:
        if ts >= now - 600 or ts >= now - 4000 and (s not in last or ts - last[s] >= 120):
            if ts < now - 600:
                last[s] = ts
            kept.append((s, k, ts))
    assert sorted(tuple(r) for r in folds.downsample(df, now, 4000, 600, 120).collect()) == sorted(kept)


def test_clock_timeline(spark):
    ms = 27_000
    rows = [(0, 0, False, 0), (10, 50 * ms, False, 50), (20, 50 * ms + 10, False, 60), (30, 100 * ms, False, 100), (40, 100 * ms - 5, False, 110), (50, 3000 * ms, False, 150), (60, 3040 * ms, True, 190), (70, 100 * ms, False, 230)]
    df = spark.createDataFrame([("s", *r) for r in rows], "stream_id string, idx long, pcr27 long, discontinuity boolean, observed_ms long")
    got = [(r.kind, r.idx, r.ns, r.cause, r.jump_ms) for r in folds.clock_timeline(df).orderBy("idx").collect()]
    assert got == [("anchor", 0, 0, None, 0), ("anchor", 10, 50_000_000, None, 0), ("anchor", 30, 100_000_000, None, 0), ("reset", 50, 0, "forward_jump", 2900), ("reset", 60, 0, "discontinuity_flag", 40), ("reset", 70, 0, "backward_jump", -2940)]


def test_schedule_bridges_a_reset(spark):
    rows = [(0, 0, False), (10, 1000, False), (20, 500_000, True), (30, 501_000, False)]
    df = spark.createDataFrame([("s", *r, 0) for r in rows], "stream_id string, idx long, pcr27 long, discontinuity boolean, observed_ms long")
    assert [(r.idx, r.ticks, r.bridged) for r in folds.packet_schedule(df).orderBy("idx").collect()] == [(0, 0, False), (10, 1000, False), (20, 2000, True), (30, 3000, False)]


def test_rates(spark):
    rows = [("s", k * 100, k * 2_700_000, False, 0) for k in range(31)]
    df = spark.createDataFrame(rows, "stream_id string, idx long, pcr27 long, discontinuity boolean, observed_ms long")
    assert {r.rate_bps for r in folds.source_rate(df).collect()} == {1000 * 1504}
    arrivals = spark.createDataFrame([("s", k, k * 10) for k in range(500)], "stream_id string, seq long, arrival_ms long")
    assert all(abs(r.measured_bps - 150_400) < 2000 for r in folds.arrival_rate(arrivals).collect())


def test_failover(spark):
    def run(rows):
        df = spark.createDataFrame([("s", *r) for r in rows], "stream_id string, ts long, active boolean, stalled boolean, primary_healthy boolean, starts boolean")
        return [(r.ts, r.source, r.cause, r.done) for r in folds.failover(df).orderBy("ts").collect()]

    up, down, well = (True, False, False, True), (False, False, False, True), (True, False, True, True)
    silent = (True, True, False, True)
    # not active within five seconds of the start waits, a stall does not
    assert run([(0, *up), (3, *down), (4, *down), (5, *down)]) == [(5, "backup", "input_silent", True)]
    assert run([(0, *up), (1, *silent)]) == [(1, "backup", "input_silent", True)]
    # probes of the primary are five seconds apart, and two in a row have to be healthy
    probes = [(0, *up), (10, *silent)] + [(t, *well) for t in range(11, 30)]
    assert run(probes) == [(10, "backup", "input_silent", True), (20, "primary", "primary_healthy_twice", True)]
    broken = [(0, *up), (10, *silent), (15, *well), (20, *up), (25, *well), (30, *well)]
    assert run(broken)[-1] == (30, "primary", "primary_healthy_twice", True)
    # a backup that stops is started again, at most once a probe
    assert run([(0, *up), (10, *silent), (15, *down), (16, *down), (20, *down)])[1:] == [(15, "backup", "backup_stopped", True), (20, "backup", "backup_stopped", True)]
    # a switch that fails is rolled back and tried again ten seconds later
    failed = [(0, *up), (10, True, True, False, False)] + [(t, *silent) for t in range(11, 22)]
    assert run(failed) == [(10, "backup", "input_silent", False), (20, "backup", "input_silent", True)]
    back = [(0, *up), (10, *silent), (15, *well), (20, True, False, True, False), (29, *well), (30, *well), (35, *well)]
    assert run(back)[1:] == [(20, "primary", "primary_healthy_twice", False), (35, "primary", "primary_healthy_twice", True)]


def test_authorised_sessions(spark):
    rows = [("a", 0, 1, "request", True), ("a", 60, 2, "request", False), ("a", 599 - 480, 3, "request", False), ("a", 700, 4, "request", False), ("a", 701, 5, "request", True), ("a", 702, 6, "revoke", True), ("a", 703, 7, "request", True), ("a", 830, 8, "request", True)]
    rows += [("b", t, 100 + t, "request", t < 600) for t in range(0, 700, 100)] + [(None, 0, 900, "request", False), (None, 1, 901, "request", True)]
    df = spark.createDataFrame(rows, "session_id string, ts long, request_id long, kind string, granted boolean")
    got = {r.request_id: (r.checked, r.allowed) for r in folds.authorised(df).collect()}
    # cached, idle and refused, checked anew, revoked without a check, forgotten after two minutes
    assert [got[k] for k in (1, 2, 3, 4, 5, 7, 8)] == [(True, True), (False, True), (False, True), (True, False), (True, True), (False, False), (True, True)]
    # the recheck comes after ten minutes and closes the session
    assert [got[100 + t] for t in (0, 500, 600)] == [(True, True), (False, True), (True, False)]
    assert got[900] == (True, False) and got[901] == (True, True)


def test_a_null_stream_is_one_stream(spark):
    big = (1 << 60) + 1
    df = spark.createDataFrame([(None, k, big + k) for k in range(60)] + [("s", 0, 7)], "stream_id string, ts long, sample_id long")
    assert sorted((r.stream_id or "", r.sample_id) for r in folds.throttle(df).collect()) == [("", big), ("", big + 30), ("s", 7)]
    numbers = spark.createDataFrame([(None, 1, 5, 9), (big, 1, 5, 9), (big + 1, 1, 5, 9), (big + 1, 2, 5, 9)], "stream_id long, seq long, arrival_ms long, x long")
    assert folds.arrival_rate(numbers).count() == 0
    rates = folds.input_rate(spark.createDataFrame([(None, k, 1000, 5000) for k in range(6)], "stream_id string, sequence long, bytes long, duration_ms long"))
    assert [r.bps for r in rates.orderBy("sequence").collect()] == [1600] * 6


def test_rates_do_not_depend_on_the_batches(spark):
    rng = random.Random(8)
    rows, at = [], 0
    for k in range(500):
        at += rng.choice([0, 1, 3, 40])
        rows.append(("s", k, at, 100 * k, rng.randrange(0, 6000)))
    df = spark.createDataFrame(rows, "stream_id string, seq long, arrival_ms long, bytes long, duration_ms long").withColumn("sequence", F.col("seq")).withColumn("ts", F.col("arrival_ms")).withColumn("sample_id", F.col("seq"))
    whole = [sorted(map(tuple, f(df).collect())) for f in (lambda d: folds.arrival_rate(d, 50), folds.input_rate, lambda d: folds.throttle(d, 40))]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert [sorted(map(tuple, f(df).collect())) for f in (lambda d: folds.arrival_rate(d, 50), folds.input_rate, lambda d: folds.throttle(d, 40))] == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_other_folds(spark):
    mk = lambda rows, ddl: spark.createDataFrame([("s", *r) for r in rows], f"stream_id string, {ddl}")
    rows = [(0, "a", 5, 3, True, 100, None), (1, "a", 5, 4, True, None, 3700), (2, "b", 5, 9, True, None, None), (3, "b", 6, 1, True, 50, None), (4, "b", 5, 9, False, None, 3650), (5, "b", 5, 10, True, 3700, None)]
    got = folds.switch_clock(mk(rows, "seq long, source string, pid int, cc int, has_payload boolean, pcr long, pts long")).orderBy("seq").collect()
    assert [(r.out_cc, r.out_pcr, r.out_pts, r.flagged) for r in got] == [(3, 100, None, False), (4, None, 3700, False), (5, None, None, False), (1, 12_700, None, True), (6, None, 16_300, False), (6, 16_350, None, False)]
    got = folds.clock_lock(mk([(k, 1000 + 3600 * k) for k in range(40)], "idx long, pts long")).orderBy("idx").collect()
    assert [r.locked for r in got] == [k >= 24 for k in range(40)]
    ids = spark.createDataFrame([("m", 0, 2), ("m", 1, None), ("m", 2, 2)], "mux_id string, ord long, wanted int")
    assert [r.service_id for r in folds.service_ids(ids).orderBy("ord").collect()] == [2, 3, 4]


def test_picture_rate(spark):
    rng = random.Random(1)
    pts = [(1 << 33) - 40_000 + 3600 * k for k in range(60)]
    sent = [p % (1 << 33) for a in range(0, 60, 4) for p in rng.sample(pts[a : a + 4], 4)]
    df = spark.createDataFrame([("s", k, p) for k, p in enumerate(sent)], "stream_id string, idx long, pts long")
    last = timing.picture_rate(df).orderBy(F.desc("idx")).first()
    assert last.fps == 25 and last.is_25
    window = sorted(p + (1 << 33) * (p < 1 << 32) for p in sent[-33:])
    assert last.fps == 90_000 / median(b - a for a, b in zip(window, window[1:]))
    early = {r.idx: r.is_25 for r in timing.picture_rate(df).collect()}
    assert not early[3] and early[4]  # five pictures are enough for 25 a second
    broken = df.withColumn("pts", F.when(F.col("idx") != 40, F.col("pts")))
    assert [r.fps == 0 for r in timing.picture_rate(broken).where("idx between 39 and 45").orderBy("idx").collect()] == [False] + [True] * 5 + [False]


def test_origin_choice(spark):
    rows = [("x", "a", "http://a", 3, True, True, 0), ("x", "b", "http://b", 1, False, True, 1), ("x", "c", "http://c", 1, False, True, 2), ("x", "d", "", 0, False, True, 3), ("x", "e", "http://e", 0, False, False, 4)]
    df = spark.createDataFrame(rows, "stream_id string, name string, redirect string, viewers long, local boolean, live boolean, ord int")
    assert sessions.choose_origin(df, F.lit("1.2.3.4")).first().name == "a"
    best = max(("b", "c"), key=lambda n: fnv(f"1.2.3.4|{n}|http://{n}".encode()) % (1 << 64))
    assert sessions.choose_origin(df, F.lit("1.2.3.4"), balance=True).first().name == best


def test_schedules(spark):
    df = spark.createDataFrame([("a", [1, 3], [4, 5], 30), ("b", [2], [4], 30)], "stream_id string, weekdays array<int>, hours array<int>, minute int")
    assert [r.stream_id for r in sessions.due(df, F.lit(3), F.lit(4), F.lit(30)).collect()] == ["a"]
    runs = spark.createDataFrame([("a", "d", 1, 5), ("a", "d", 1, 7), ("a", "e", 1, 9)], "stream_id string, date string, slot int, ts long")
    assert sorted(r.ts for r in sessions.once_a_day(runs).collect()) == [5, 9]
    src = spark.createDataFrame([("a", True, "daily", 1, 3, 0, None, None), ("b", True, "daily", 1, 3, 0, 1_706_000_000 - 60, None), ("c", True, "weekly", 1, 3, 0, None, None), ("d", True, "daily", 1, 3, 0, None, 1_706_000_000 - 60)], "source_id string, enabled boolean, every string, weekday int, hour int, minute int, last_run long, last_error long")
    assert [r.source_id for r in guide.refresh_due(src, 1_706_000_000).collect()] == ["a"]


def test_import_and_search(spark):
    new = spark.createDataFrame([("n1", "One", "u1", 0), ("n1", "Two", "u2", 1), ("k", "Three", "u3", 2), ("n1", "KNOWN", "u9", 3)], "id string, name string, uri string, ord int")
    known = spark.createDataFrame([("k", "known", "u9")], "id string, name string, uri string")
    assert {r.name: r.id for r in sessions.imported(new, known).collect()} == {"One": "n1", "Two": "n1_2", "Three": "k_2"}
    # an id with a number may be taken already, or be given to a row before
    new = spark.createDataFrame([("a", "One", "u1", 0), ("a_3", "Two", "u2", 1), ("a", "Three", "u3", 2), ("a", "ONE", "u1", 3)], "id string, name string, uri string, ord int")
    known = spark.createDataFrame([("a", "x", "u"), ("a_2", "y", "v")], "id string, name string, uri string")
    assert {r.name: r.id for r in sessions.imported(new, known).collect()} == {"One": "a_3", "Two": "a_3_2", "Three": "a_4"}
    streams = spark.createDataFrame([("Alpha", "udp://1", ["http://out"]), ("Beta", "srt://2", [])], "name string, uri string, outputs array<string>")
    assert [r.name for r in sessions.search(streams, " OUT ").collect()] == ["Alpha"]


def test_versions_and_section_times(spark):
    df = spark.createDataFrame([("s", k, d) for k, d in enumerate("aabbac")], "stream_id string, seq long, digest string")
    assert [r.version for r in guide.version(df).orderBy("seq").collect()] == [0, 0, 1, 1, 2, 3]


def test_health(spark):
    streams = spark.createDataFrame([("a", True, False, 0, 100, 100, None), ("b", True, True, 0, 100, 100, None), ("c", True, True, 1, 0, 0, None), ("d", True, True, 0, 0, 100, 110)], "stream_id string, on_demand boolean, hls boolean, viewers int, started long, last_activity long, last_segment long")
    assert sorted(r.stream_id for r in health.idle(streams, F.lit(150)).collect()) == ["a"]
    assert sorted(r.stream_id for r in health.idle(streams, F.lit(230)).collect()) == ["a", "b", "d"]


def test_master_playlists(spark):
    lines = ["#EXTM3U", "#EXT-X-STREAM-INF:BANDWIDTH=800,RESOLUTION=1x1", "low", "#EXT-X-STREAM-INF:BANDWIDTH=900,RESOLUTION=2x2", "high"]
    df = spark.createDataFrame([("p", k, line) for k, line in enumerate(lines)], "playlist string, line_no int, line string")
    found = hls.variants(df)
    assert [(r.bandwidth, r.uri) for r in found.orderBy("line_no").collect()] == [(800, "low"), (900, "high")]
    assert hls.chosen(found, 100).first().uri == "low" and hls.chosen(found, 5000).first().uri == "high"
    text = hls.master_playlist(found.withColumnRenamed("playlist", "stream_id")).first().playlist
    assert text.index("high") < text.index("low")
    assert hls.archive_range("archive-100-20.m3u8", 0) == (100, 120, False) and hls.archive_range("x", 0) is None


def test_summary_lines(spark):
    df = spark.createDataFrame([(0, "summary seconds=60 ok=1 failed=0 avg_ms=9"), (1, "summary seconds=0 ok=1 failed=0 avg_ms=9"), (2, "x")], "line_no int, line string")
    assert [r.seconds for r in logs.summaries(df).collect()] == [60]
