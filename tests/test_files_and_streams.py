"""File sources and sinks, and operators under Structured Streaming."""

import gzip
import json

from pyspark.sql import functions as F

from beamline.operators import folds
from beamline.sources import files, foreign
from beamline.streaming import live

XMLTV = """<?xml version="1.0"?><tv><channel id="c1"><display-name>One</display-name></channel>
<programme start="20240101000000 +0000" stop="20240101010000 +0000" channel="c1"><title>A &amp; B</title><desc> x
 y</desc></programme><programme start="bad" stop="20240101010000" channel="c1"><title>z</title></programme></tv>"""


def test_xmltv(spark, tmp_path):
    with gzip.open(tmp_path / "g.xml.gz", "wt") as f:
        f.write(XMLTV)
    assert [tuple(r) for r in files.xmltv_programmes(spark, str(tmp_path)).collect()] == [("c1", 1704067200, 1704070800, "A & B", "x y")]
    assert [tuple(r) for r in files.xmltv_channels(spark, str(tmp_path)).collect()] == [("c1", "One")]


def test_history_round_trip(spark, tmp_path):
    row = (5, True, 1, 2, 3, 0, 0, 0, 0, "ok", "ok", "")
    df = spark.createDataFrame([("s", *row), ("t", *row)], "stream_id string, ts long, active boolean, in_kbps long, out_kbps long, target_kbps long, in_cc long, out_cc long, in_cc_total long, out_cc_total long, status string, level string, message string")
    path = str(tmp_path / "h")
    files.write_quality_history(df, path)
    files.write_quality_history(df.where("stream_id = 's'"), path)
    (tmp_path / "h" / "stream_id=s" / "broken.txt").write_text("[1,2]\nnot json\n")
    back = files.quality_history(spark, path)
    assert back.where("stream_id = 's'").count() == 2 and back.count() == 3
    assert tuple(back.where("stream_id = 't'").select(*files.HISTORY).first()) == row


def test_documents(spark, tmp_path):
    (tmp_path / "l.json").write_text('{"t": 1, "cpu": 2.5}\n{"cpu": 1}\nxx\n')
    assert files.load_history(spark, str(tmp_path / "l.json")).count() == 1
    (tmp_path / "c.json").write_text(json.dumps({"telegram_token": "secret", "streams": [{"id": "a", "hls_archive_hours": 9999, "password": "p"}, {"name": "no id"}]}))
    row = files.configuration(spark, str(tmp_path / "c.json")).collect()
    assert [(r.id, r.name, r.hls_archive_hours, r.enabled) for r in row] == [("a", "a", 720, True)] and "password" not in row[0].asDict()
    head, body = {"kind": "header", "records": 1}, {"kind": "event", "service_id": 1, "event_id": 2, "start_utc": 3, "duration_s": 4, "title": "t"}
    (tmp_path / "g1.jsonl").write_text(json.dumps(head) + "\n" + json.dumps(body) + "\n")
    (tmp_path / "g2.jsonl").write_text(json.dumps(head) + "\n")
    assert files.guide_cache(spark, str(tmp_path / "g*.jsonl")).count() == 1
    (tmp_path / "p.json").write_text(json.dumps({"node": "n", "channels": [{"id": str(k)} for k in range(600)]}))
    assert files.peer_channels(spark, str(tmp_path / "p.json")).count() == 512


def test_lines_sink(spark, tmp_path):
    df = spark.createDataFrame([(0, "a"), (1, "b")], "k int, line string").orderBy("k")
    files.write_lines(df, str(tmp_path / "o"), compression="gzip")
    assert [r.value for r in spark.read.text(str(tmp_path / "o")).collect()] == ["a", "b"]


def test_streams_agree_with_batches(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    got = live.run_available(live.error_windows(live.event_stream(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "cp"))
    whole = live.error_windows(events.withColumn("at", F.col("ts").cast("timestamp")))
    a, b = {tuple(r) for r in got.collect()}, {tuple(r) for r in whole.collect()}
    assert a <= b and len(b - a) <= 8  # the newest window is still open
    got = live.run_available(live.viewer_sessions(live.event_stream(spark, str(tmp_path / "in")), "2 hours"), str(tmp_path / "out2"), str(tmp_path / "cp2"))
    whole = live.viewer_sessions(events.withColumn("at", F.col("ts").cast("timestamp")), "2 hours")
    a, b = {tuple(r) for r in got.collect()}, {tuple(r) for r in whole.collect()}
    assert a <= b and len(a) > 0.9 * len(b)


def test_failover_under_streaming(spark, tmp_path):
    up, silent, well = (True, False, False, True), (True, True, False, True), (True, False, True, True)
    rows = [(1, 0, *up), (1, 10, *silent), (1, 15, *well), (1, 17, *well), (1, 20, *well), (1, 40, *silent), (2, 0, *up), (2, 3, False, False, False, True), (2, 5, False, False, False, True)]
    df = spark.createDataFrame(rows, "stream_id long, ts long, active boolean, stalled boolean, primary_healthy boolean, starts boolean")
    stored = {(r.stream_id, r.ts, r.source, r.cause) for r in folds.failover(df).collect()}
    df = df.withColumn("at", F.timestamp_seconds(F.col("ts") + 1000)).drop("ts")  # the first watermark is 1970
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")).withWatermark("at", "1 minute")
    got = live.run_available(live.failover_live(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    live_rows = {(r.stream_id, r.ts, r.source, r.cause) for r in got.withColumn("ts", F.unix_seconds("at") - 1000).collect()}
    assert live_rows == stored and len(stored) == 4


def test_blocks_of_text(spark, tmp_path):
    (tmp_path / "a.conf").write_text("""
# stream hidden { input udp://0:1; }
http 80;
auth { stream none { input udp://0:1; } }
stream one {
  input "hls://h/a;b.m3u8" ; dvr { input udp://0:2; push udp://1:1; }
  input tshttp://h/two x=1;
  // input udp://0:3;
  push udp://10.0.0.1@239.0.0.1:1234; push udp://999.0.0.1@239.0.0.1:1234; push http://x;
}
stream two { input mystery://x; }
stream three { input udp://h:1; input srt://h:2; input rtp://h:3; push rtp://[::1]:70000; push rtp://h:65535/x; }
stream open { input udp://h:4;
""")
    got = {r.name: r for r in foreign.read_text_streams(spark, str(tmp_path)).collect()}
    one = got["one"]
    assert (one.input_uri, one.backup_input_uri, one.input_mode) == ("http://h/a;b.m3u8", "http://h/two", "hls")
    assert [tuple(o) for o in one.outputs] == [("udp-vbr", "239.0.0.1", 1234, "10.0.0.1")] and one.warnings == [foreign.BAD_OUTPUT]
    assert got["two"].input_uri is None and set(got["two"].warnings) == {foreign.BAD_INPUT, foreign.NO_INPUT}
    assert got["three"].backup_input_uri == "srt://h:2" and got["three"].warnings == [foreign.MORE_INPUTS, foreign.BAD_OUTPUT]
    assert [tuple(o) for o in got["three"].outputs] == [("rtp", "h", 65_535, "")] and set(got) == {"one", "two", "three", "open"}


def test_json_lists(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"make_stream": [{"name": "x", "input": ["udp://h:1", {"url": "hlss://h/i"}], "output": [{"url": "rtp://239.1.1.1:5"}, "file:///x"]}, {"name": "m", "type": "MPTS", "input": ["udp://h:2"]}, {"type": "spts", "input": []}, {"name": "none"}]}')
    got = {r.name: r for r in foreign.read_json_streams(spark, str(tmp_path)).collect()}
    assert set(got) == {"x", "none"} and got["x"].backup_input_uri == "https://h/i"
    assert [tuple(o) for o in got["x"].outputs] == [("rtp", "239.1.1.1", 5, "")] and got["x"].warnings == [foreign.BAD_OUTPUT]
    assert got["none"].warnings == [foreign.NO_INPUT]
