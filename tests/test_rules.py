"""Rows written by hand from the rules, and scans over ranges against plain recounts."""

import random

import pytest
from pyspark.sql import functions as F

from beamline.functions import scalars as X
from beamline.operators import continuity, folds, guide, health, hls, timing, quality
from beamline.operators.scans import Last, Next, Scan, Total, Trailing, lag

# --- scans ---------------------------------------------------------------------------


def brute(rows):
    """By key and order: what each of the scan's values has to be."""
    out = []
    for key in {r[0] for r in rows}:
        own = sorted(r for r in rows if r[0] == key)
        v = [r[3] for r in own]
        for i, r in enumerate(own):
            before, upto = [x for x in v[:i] if x is not None], [x for x in v[: i + 1] if x is not None]
            behind, onward = [x for x in v[i + 1 :] if x is not None], [x for x in v[i:] if x is not None]
            few = v[max(0, i - 4) : i + 1]
            held = [x for x in few if x is not None]
            out.append((*r, before[-1] if before else None, upto[-1] if upto else None, behind[0] if behind else None, onward[0] if onward else None, sum(upto) if upto else None, i > 0, v[i - 1] if i else None, sum(held) if held else None, len(few)))
    return sorted(out, key=str)


@pytest.mark.parametrize("span", [1, 3, 40, 10_000])
def test_scans_give_what_one_pass_gives(spark, span):
    rng = random.Random(span)
    rows = []
    for key in ("a", "b", None):
        at = 0
        for _ in range(120):
            at += rng.choice([0, 1, 1, 2, 30])
            rows.append((key, at, rng.randrange(10**9), rng.choice([None, None, rng.randrange(50)])))
    df = spark.createDataFrame(rows, "k string, at long, tie long, v long").repartition(5)
    v = F.col("v")
    found = Scan(df, ["k"], ["at", "tie"], span).add(
        before=Last(v), upto=Last(v, here=True), behind=Next(v), onward=Next(v, here=True), total=Total(v), prev=lag("v"), few=Trailing(v, 5)).done()
    found = found.select("k", "at", "tie", "v", "before", "upto", "behind", "onward", "total", F.col("prev").isNotNull(), "prev.v", "few.total", "few.n")
    plain = lambda rs: sorted((tuple(r)[1:] for r in rs), key=lambda r: r[:2])  # noqa: E731  ties tell the keys apart
    assert plain(found.collect()) == plain(b for key in ("a", "b", None) for b in brute([(0, *r[1:]) for r in rows if r[0] == key]))


def capture(spark, n=640):
    rng = random.Random(2)
    rows, cc = [], [0, 0, 0]
    for seq in range(n):
        pid = rng.choice([0, 0, 1, 2])
        afc = rng.choice([1, 1, 1, 3, 2, 0])
        paid = afc in (1, 3)
        cc[pid] = (cc[pid] + (paid and rng.random() < 0.9) + (rng.random() < 0.05)) % 16
        rows.append((1, [100, 101, 8191][pid], seq, seq * 9 % 4000 + seq, cc[pid], afc, paid, rng.random() < 0.03, rng.random() < 0.03, rng.choice([0, 0, 2, 3]), rng.random() < 0.2, rng.randrange(2),
                     seq * 1800 + rng.choice([0, 0, 90_000]) if rng.random() < 0.3 else None, seq * 1_080_000 + rng.choice([0, 0, 54_000_000]) if rng.random() < 0.3 else None))
    return spark.createDataFrame(rows, "stream_id long, pid int, seq long, arrival_ms long, cc int, afc int, has_payload boolean, discontinuity boolean, tei boolean, scrambling int, pusi boolean, payload_hash long, pts long, pcr27 long")


@pytest.mark.parametrize("name", ["status", "status_counts", "stream_errors", "stage_events", "stage_counters", "integrity_counters", "pts_gaps", "track_counters", "fixed_reports"])
def test_a_stream_in_64_ranges_has_the_same_rows(spark, name):
    packets, operator = capture(spark), getattr(continuity, name)
    whole, ranges = operator(packets, span=10**9), operator(packets, span=10)
    assert sorted(map(str, whole.collect())) == sorted(map(str, ranges.collect()))


def test_counters_and_clocks_in_ranges(spark):
    rng = random.Random(3)
    rows = [("s", k * 7 % 300 + k, k, rng.randrange(40), k * 100 - rng.choice([0, 500])) for k in range(300)]
    df = spark.createDataFrame(rows, "stream_id string, ts long, sample_id long, cc_total long, bytes_total long")
    same = lambda f: sorted(map(str, f(10**9).collect())) == sorted(map(str, f(5).collect()))
    assert same(lambda s: timing.with_deltas(df, span=s)) and same(lambda s: timing.moving_rate(df, "cc_total", span=s))
    assert same(lambda s: timing.interface_rate(df, span=s)) and same(lambda s: timing.silence(df, "cc_total", span=s))
    clock = spark.createDataFrame([("s", k, k * 1000 + rng.randrange(9) if k % 17 == 5 else None) for k in range(300)], "stream_id string, idx long, pcr27 long")
    assert same(lambda s: timing.interpolate(clock, span=s))
    contents = spark.createDataFrame([("s", k, rng.choice("ab")) for k in range(200)], "stream_id string, seq long, digest string")
    assert same(lambda s: guide.version(contents, span=s))


def test_ranges_of_a_stream_go_to_different_tasks(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    rows = Scan(capture(spark), ["stream_id"], ["seq"], 10).add(b=lag("cc")).rows
    sizes = [r[0] for r in rows.groupBy(F.spark_partition_id()).count().select("count").collect()]
    spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(sizes) > 1 and max(sizes) < 640


def test_a_scan_shuffles_its_rows_once(spark):
    found = Scan(capture(spark), ["stream_id"], ["seq"], 10).add(b=lag("cc")).done().groupBy("b").count()
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("REPARTITION_BY_COL") - plan.count("ReusedExchange") <= 1 and "ReusedExchange" in plan


# --- rules ---------------------------------------------------------------------------


def held(spark, rows):
    df = spark.createDataFrame([("s", ts, k, active, state) for k, (ts, active, state) in enumerate(rows)], "stream_id string, ts long, sample_id long, active boolean, state string")
    return [r.shown for r in health.held_state(df, span=3).orderBy("ts", "sample_id").collect()]


def test_a_clear_state_is_held_for_less_than_six_seconds(spark):
    assert held(spark, [(0, True, "clear"), (5, True, "waiting"), (6, True, "waiting")]) == ["clear", "clear", "waiting"]
    assert held(spark, [(0, True, "clear"), (1, True, "error"), (2, True, "waiting")]) == ["clear", "error", "waiting"]
    assert held(spark, [(0, True, "clear"), (1, False, "waiting"), (2, True, "waiting")]) == ["clear", "offline", "waiting"]
    assert held(spark, [(0, True, "clear"), (4, True, "scrambled"), (5, True, "clear"), (10, True, "invalid"), (11, True, "invalid")]) == ["clear", "clear", "clear", "clear", "invalid"]


def gate(spark, rows):
    names = "ts long, generation long, state string, active boolean, output_healthy boolean, clear_pes long, client boolean"
    df = spark.createDataFrame([("s", *r) for r in rows], "stream_id string, " + names)
    return [r.shown for r in health.viewer_gate(df).orderBy("ts").collect()]


def test_a_confirmed_stream_stays_when_its_viewer_leaves(spark):
    ok = "viewer_pes_ok"
    rows = [(0, 1, "partial", True, True, 3, False), (10, 1, "partial", True, True, 0, True), (14, 1, "partial", True, True, 1, False), (20, 1, "partial", True, False, 0, False), (21, 1, "partial", True, False, 0, True)]
    assert gate(spark, rows) == ["partial", ok, ok, ok, "partial"]  # the output is 7 s old at last
    rows = [(0, 1, "partial", True, True, 3, True), (1, 2, "partial", True, True, 0, True), (2, 0, "scrambled", True, True, 1, True), (3, 2, "partial", False, True, 1, True)]
    assert gate(spark, rows) == [ok, "partial", "scrambled", "offline"]  # another generation knows nothing
    assert gate(spark, [(0, 1, "scrambled", True, True, 3, True), (1, 1, "partial", True, True, 0, True)]) == ["scrambled", "partial"]


def packets(spark, rows):
    """Rows of pid, cc and what is not usual."""
    usual = {"afc": 1, "discontinuity": False, "tei": False, "scrambling": 0, "pusi": False, "payload_hash": 0, "pts": None, "pcr27": None, "arrival_ms": 0}
    made = [(1, pid, seq, cc, {**usual, "payload_hash": seq, **more}) for seq, (pid, cc, more) in enumerate(rows)]
    return spark.createDataFrame(
        [(s, p, q, c, m["afc"], m["afc"] in (1, 3), m["discontinuity"], m["tei"], m["scrambling"], m["pusi"], m["payload_hash"], m["pts"], m["pcr27"], m["arrival_ms"]) for s, p, q, c, m in made],
        "stream_id long, pid int, seq long, cc int, afc int, has_payload boolean, discontinuity boolean, tei boolean, scrambling int, pusi boolean, payload_hash long, pts long, pcr27 long, arrival_ms long")


def test_packets_in_error_take_part_in_stage_counters(spark):
    row = continuity.stage_counters(packets(spark, [(5, 0, {}), (5, 1, {"tei": True}), (5, 2, {})])).first()
    assert (row.packets, row.tei, row.cc_errors) == (3, 1, 0)
    row = continuity.stage_counters(packets(spark, [(5, 0, {}), (5, 0, {"payload_hash": 0}), (5, 0, {"payload_hash": 9}), (5, 3, {"afc": 2}), (5, 4, {"afc": 2, "discontinuity": True}), (5, 9, {})])).first()
    assert (row.exact_duplicates, row.cc_errors, row.adaptation_only_cc_errors, row.discontinuities) == (1, 2, 1, 1)


def test_errors_of_null_packets_count(spark):
    row = continuity.stream_errors(packets(spark, [(8191, 0, {"tei": True}), (5, 0, {}), (5, 1, {"tei": True}), (5, 1, {}), (8191, 0, {"afc": 0})])).first()
    assert (row.transport, row.invalid, row.continuity, row.errors) == (2, 1, 0, 3)
    known = packets(spark, [(5, 0, {}), (5, 7, {}), (5, 1, {})]).withColumn("valid", F.col("seq") != 1)
    row = continuity.stream_errors(known).first()
    assert (row.invalid, row.continuity) == (1, 0)
    assert [r.status for r in continuity.status(known).orderBy("seq").collect()] == ["InOrder", "InOrder"]


def test_progress_is_that_of_the_video_pid(spark):
    start = lambda pts: {"pusi": True, "pts": pts}
    tracks = spark.createDataFrame([(1, 5, 6), (2, 5, None)], "stream_id long, video_pid int, audio_pid int")
    rows = packets(spark, [(5, 0, start(100)), (6, 0, start(900)), (5, 1, start(100)), (6, 1, start(900)), (5, 2, {"pusi": True}), (7, 0, {}), (5, 3, start(200)), (5, 4, {**start(300), "tei": True})])
    found = {r.stream_id: tuple(r)[1:] for r in timing.progress(rows, tracks, span=2).collect()}
    assert found == {1: (6, 3, 1), 2: (0, 0, 0)}


def playlist(spark, text, base="http://h/a/list.m3u8?x"):
    df = spark.createDataFrame([("p", k, line, base) for k, line in enumerate(text.split("\n"))], "playlist string, line_no long, line string, base string")
    return [(r.sequence, r.uri, r.duration, r.discontinuity, r.key_uri) for r in hls.parsed(df).orderBy("sequence").collect()]


def test_playlist_rules(spark):
    assert playlist(spark, "#EXTM3U\nlost.ts\n#EXTINF:4,\na.ts") == [(0, "http://h/a/a.ts", 4.0, False, None)]
    assert playlist(spark, "#EXT-X-KEY:METHOD=AES-128,URI=\"k\"\n#EXTINF:1,\na\n#EXT-X-KEY:METHOD=NONE\n#EXTINF:1,\nb")[1][4] is None
    assert playlist(spark, "#EXT-X-KEY:METHOD=X\n#EXTINF:1,\na")[0][4] == "unsupported:x"
    assert playlist(spark, "#EXTINF:x,\na\n#EXT-X-TARGETDURATION:0.1\n#EXTINF:,\n/b\n#EXTINF:0,\nHTTPS://c/d") == [(0, "http://h/a/a", 2.0, False, None), (1, "http://h/b", 0.25, False, None), (2, "HTTPS://c/d", 0.25, False, None)]
    assert playlist(spark, "#EXT-X-DISCONTINUITY\nlost\n#EXT-X-MEDIA-SEQUENCE:7\n#EXTINF:1,\na\n#EXTINF:1,\nb") == [(7, "http://h/a/a", 1.0, True, None), (8, "http://h/a/b", 1.0, False, None)]
    assert playlist(spark, "#EXTINF:-1,\na\n#EXTINF:1,\n#EXTINF:2,\nb") == [(0, "http://h/a/b", 2.0, False, None)]
    assert playlist(spark, "#EXT-X-STREAM-INF:BANDWIDTH=1\n#EXTINF:1,\na") == []
    assert playlist(spark, "#EXTINF:1,\na", "http://h?q")[0][1] == "http://h?q/a"


def long_list(spark, n=600):
    rng = random.Random(7)
    said = ["a.ts", "/b", "#EXTINF:3,", "#EXTINF:x,", "#EXTINF:0,", "#EXTINF:-1,", "#", "#EXT-X-DISCONTINUITY", "#EXT-X-KEY:METHOD=AES-128,URI=\"k\"", "#EXT-X-KEY:METHOD=NONE", "#EXT-X-MAP:URI=\"m\"", "#EXT-X-TARGETDURATION:%d", "#EXT-X-MEDIA-SEQUENCE:%d"]
    rows = [(p, k, line % k if "%" in line else line, "http://h/l") for p in ("a", "b", None) for k in range(n) for line in rng.choices(said, [9, 9, 20, 3, 3, 3, 3, 2, 1, 1, 1, 1, 1])]
    rows += [("b", n, "#EXT-X-ENDLIST", "http://h/l"), ("c", 1, "#EXTINF:1,", "h"), ("c", 2, "#EXT-X-STREAM-INF:BANDWIDTH=1", "h"), ("c", 3, "c", "h")]
    return spark.createDataFrame(rows, "playlist string, line_no long, line string, base string")


@pytest.mark.parametrize("span", [1, 7, 90])
def test_a_list_in_ranges_has_the_same_segments(spark, span):
    lines = long_list(spark)
    whole, ranges = (sorted(map(str, hls.parsed(lines, s).collect())) for s in (10**9, span))
    assert whole == ranges and len(whole) > 300
    assert {r.playlist for r in hls.parsed(lines, span).where("end_list").collect()} == {"b"}


@pytest.mark.parametrize("span", [1, 2, 10**9])
def test_the_start_of_a_list_in_ranges(spark, span):
    rows = [(p, n, d, p == "e") for p, ds in (("a", [9.0, 2.0, 2.0, 2.0]), ("b", [1.0, 1.0, 5.5]), ("c", [1.0]), ("e", [9.0, 9.0]), (None, [7.0, 7.0])) for n, d in enumerate(ds)]
    df = spark.createDataFrame(rows, "playlist string, sequence long, duration double, end_list boolean")
    assert dict(map(tuple, hls.start_sequence(df, span=span).collect())) == {"a": 1, "b": 1, "c": 0, "e": 0, None: 1}


def test_ladders(spark):
    def ladder(*args):
        found = spark.range(1).select(X.abr_ladder(*map(F.lit, args)).alias("x")).first().x
        return [(r.name, r.width, r.height, r.rate) for r in found]

    assert ladder(1920, 1080, 5_000_000) == [("720p", 1280, 720, 3_000_000), ("480p", 856, 480, 1_337_500), ("360p", 640, 360, 750_000)]
    assert ladder(1280, 720, 600_000) == [("480p", 856, 480, 361_125), ("360p", 640, 360, 250_000)]
    assert ladder(1280, 720, 340_000) == ladder(0, 720, 10**6) == []
    assert ladder(3840, 2160, 20_000_000)[0] == ("1080p", 1920, 1080, 6_500_000)


def test_rates_by_the_first_clock(spark):
    rows = [("s", 5, k * 100, k * 2_700_000) for k in range(31)] + [("s", 6, k * 100 + 7, k * 999) for k in range(31)]
    df = spark.createDataFrame([(*r, False, 0) for r in rows], "stream_id string, pid int, idx long, pcr27 long, discontinuity boolean, observed_ms long")
    assert [r.idx for r in folds.source_rate(df).orderBy("idx").collect()] == [500 * k for k in range(1, 7)]  # half a second each
    assert {r.kind for r in folds.clock_timeline(df).collect()} == {"anchor"}
    fast = spark.createDataFrame([("s", k * 100_000, k * 13_500_000, False) for k in range(3)], "stream_id string, idx long, pcr27 long, discontinuity boolean")
    assert folds.source_rate(fast).count() == 0  # above 200 Mbit/s


def test_an_adaptation_field_beyond_the_packet_is_bad(spark):
    base = dict(stream_id="s", pid=256, tei=False, discontinuity=False, scrambling=0, pcr27=None, adaptation_length=7, missing_key=False)
    plan = [dict(afc=1, cc=0), dict(afc=3, cc=1), dict(afc=3, cc=2, adaptation_length=184, scrambling=2, discontinuity=True, pcr27=5), dict(afc=1, cc=9), dict(afc=3, cc=10, adaptation_length=183, scrambling=2, missing_key=True), dict(afc=2, cc=10, adaptation_length=190), dict(afc=1, cc=3, adaptation_length=200, scrambling=3, missing_key=True)]
    rows = [(*{**base, **r}.values(), k, r["afc"] in (1, 3)) for k, r in enumerate(plan)]
    names = [*{**base, **plan[0]}, "seq", "has_payload"]
    types = dict(stream_id="string", pid="int", tei="boolean", discontinuity="boolean", scrambling="int", pcr27="long", adaptation_length="int", missing_key="boolean", afc="int", cc="int", seq="long", has_payload="boolean")
    packets = spark.createDataFrame(rows, ", ".join(f"{n} {types[n]}" for n in names))
    got = continuity.integrity_counters(packets).first()
    assert (got.packets, got.bad_afc, got.discontinuities, got.cc_gaps, got.cc_repeats, got.scrambled, got.parity_changes, got.missing_key_packets) == (7, 2, 0, 0, 0, 2, 1, 2)
    got = continuity.integrity_counters(packets.drop("adaptation_length", "missing_key")).first()
    assert got.bad_afc == 0 and "missing_key_packets" not in got.asDict()


def test_a_persisted_point_has_both_counters(spark):
    rows = [("a", 100, 1, 5, 6, "ok", "runs", 4, 4), ("a", 700, 2, 7, 8, "ok", "runs", 0, 2), ("a", 1000, 3, 9, 10, "warn", "late", 0, 1), ("b", 999, 4, 1, 1, "ok", "runs", 0, 0), ("b", 1001, 5, 2, 2, "ok", "after", 9, 9)]
    samples = spark.createDataFrame(rows, "stream_id string, ts long, sample_id long, in_kbps long, out_kbps long, level string, message string, in_cc long, out_cc long")
    got = [tuple(r) for r in quality.persisted_point(samples, 1000).select("stream_id", "ts", "in_kbps", "level", "message", "in_cc", "out_cc").orderBy("stream_id").collect()]
    assert got == [("a", 1000, 9, "error", "CC-errors MPEG-TS за интервал: вход=0, выход=3", 0, 3), ("b", 999, 1, "ok", "runs", 0, 0)]
