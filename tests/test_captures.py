"""The data source of captures: ranges, filters, growing files."""

import random

import pytest
from pyspark.sql import functions as F

from beamline.sources import captures as C
from beamline.sources import transport as T
from beamline.streaming.live import run_available
from tests.test_packets import damaged, framed, packet


@pytest.mark.parametrize("trusted", [False, True])
def test_ranges_give_what_a_search_through_the_whole_file_gives(tmp_path, trusted):
    rng = random.Random(31)
    for k in range(40):
        data = damaged(rng, 60)
        path = tmp_path / f"f{k}.ts"
        path.write_bytes(data)
        for size, look_back in ((700, 188), (1500, 600), (1 << 20, 1 << 16)):
            parts = C.ranges(str(path), 0, len(data), len(data), size)
            rows = [b.to_pylist() for p in parts for b in C.packets(p, trusted, None, look_back)]
            assert [(r["at"], r["pkt"]) for own in rows for r in own] == [(p, data[p : p + 188]) for p in framed(data, trusted)]


def test_two_grids_that_never_meet_are_looked_back_to_the_begin(tmp_path):
    """Two grids of valid packets run side by side: only the file's begin tells which holds."""
    data = bytearray(b"".join(packet(cc=k % 16) for k in range(60)))
    for k in range(59):
        data[k * 188 + 100 : k * 188 + 104] = packet(pid=300)[:4]
    (tmp_path / "a.ts").write_bytes(bytes(data))
    parts = C.ranges(str(tmp_path / "a.ts"), 0, len(data), len(data), 1000)
    assert [at for p in parts for b in C.packets(p, False, None, 188) for at in b["at"].to_pylist()] == [k * 188 for k in range(60)]


def test_the_source_reads_what_the_reader_of_captures_reads(spark, tmp_path):
    rng = random.Random(8)
    for k in range(3):
        (tmp_path / f"f{k}.ts").write_bytes(damaged(rng, 150))
    (tmp_path / "_hidden.ts").write_bytes(packet())
    (tmp_path / "empty.ts").write_bytes(b"")
    old = T.parse_headers(T.read_captures(spark, str(tmp_path)).withColumn("copy", F.col("pkt"))).drop("seq").withColumnRenamed("copy", "pkt")
    new = C.captures(spark, str(tmp_path), range_bytes=3000, look_back=300)
    columns = sorted(old.columns)
    assert sorted(new.columns) == columns
    assert sorted(map(str, new.select(columns).collect())) == sorted(map(str, old.select(columns).collect()))
    assert new.rdd.getNumPartitions() > 10
    assert C.captures(spark, f"{tmp_path}/f[01].ts").select("stream_id").distinct().count() == 2


def test_filters_reach_the_reader(spark, tmp_path, capsys):
    for name in "ab":
        (tmp_path / f"{name}.ts").write_bytes(b"".join(packet(pid=256 + k % 3, cc=k % 16) for k in range(300)))
    rows = C.captures(spark, str(tmp_path), range_bytes=9400)
    own = rows.where((F.col("pid").isin(256, 258)) & (F.col("stream_id") == f"file:{tmp_path}/a.ts") & (F.col("at") >= 28200))
    assert [r["at"] for r in own.orderBy("at").collect()] == [k * 188 for k in range(150, 300) if k % 3 != 1]
    own.explain("formatted")
    plan = capsys.readouterr().out
    assert "IN(pid" in plan.replace(" ", "") or "PushedFilters" in plan or "In(pid" in plan
    assert own.rdd.getNumPartitions() == 3
    assert rows.where("pid = 256 and pid = 257").count() == 0 and rows.where("pid in (257, 258) and pid <> 258").count() == 200
    assert C.captures(spark, str(tmp_path), pids="257").where("pid < 258").count() == 200


def test_readers_narrow_with_each_filter():
    reader = C.CaptureReader(C.Settings({"path": "/x", "pids": "1,2,3"}))
    left = list(reader.pushFilters([C.In(("pid",), (2, 3, None, 4)), C.EqualTo(("pid",), 3), C.EqualTo(("cc",), 1), C.LessThan(("at",), 50)]))
    assert reader.settings.pids == {3} and [type(f) for f in left] == [C.EqualTo, C.LessThan] and reader.high == 50
    with pytest.raises(ValueError):
        C.Settings({})


def test_growing_files_under_streaming(spark, tmp_path):
    """A file grows between restarts, cut in the middle of packets and of junk; the stream
    has each packet of the whole file once."""
    rng = random.Random(3)
    data, folder = damaged(rng, 120), tmp_path / "in"
    folder.mkdir()
    (folder / "b.ts").write_bytes(b"".join(packet(cc=k) for k in range(9)))
    out, place = str(tmp_path / "out"), str(tmp_path / "cp")
    held = 0
    for end in (1, 700, 701, 9000, len(data)):
        (folder / "a.ts").write_bytes(data[:end])
        got = run_available(C.captures_live(spark, str(folder), range_bytes=2000), out, place)
        held = got.where("stream_id like '%a.ts'").count()
    whole = framed(data)
    assert held == len([p for p in whole if p < len(data) - 563])
    got = run_available(C.captures_live(spark, str(folder), range_bytes=2000, complete=True), out, place).orderBy("stream_id", "at").collect()
    assert [(r["at"], bytes(r.pkt)) for r in got if r.stream_id.endswith("a.ts")] == [(p, data[p : p + 188]) for p in whole]
    assert [r["at"] for r in got if r.stream_id.endswith("b.ts")] == [k * 188 for k in range(9)]


def test_a_complete_file_that_changes_is_an_error():
    stream = C.CaptureStream(C.Settings({"path": "/x"}))
    for known in (400, 600):
        with pytest.raises(ValueError):
            stream.partitions({"files": {"f": [500, 500]}}, {"files": {"f": [known, known]}})
    assert stream.partitions({"files": {"f": [500, 500]}}, {"files": {"f": [500, 500]}}) == []
    assert [(p.begin, p.stop) for p in stream.partitions({"files": {"f": [100, 663]}}, {"files": {"f": [700, 700]}})] == [(100, 700)]
