"""Guide rows to sections and back."""

from beamline.sources import schedules as K
from beamline.sources import sections as S

DAY, HOUR = 86_400, 3600
EVENTS = "stream_id string, sid int, at long, ord int, event_id int, start long, stop long, title string, text string"


def refreshes(spark, *times):
    return spark.createDataFrame([("s", 7, t, 3, 9) for t in times], "stream_id string, sid int, at long, ts_id int, network int")


def read(sections):
    """Events read back from packets, with the version and number of their section."""
    rows = sections.selectExpr("cast(at as string) as stream_id", "18 as pid", "ord", "section")
    found = S.assemble(S.packetised(rows), S.GUIDE)
    events = S.eit(found)
    heads = {(r.stream_id, r.seq): (r.bytes[5] >> 1 & 31, r.bytes[6], r.bytes[7], r.bytes[12], r.bytes[13], r.bytes[0], r.crc_ok) for r in found.collect()}
    return heads, [(r, heads[r.stream_id, r.seq]) for r in events.collect()]


def test_versions_follow_the_content(spark):
    t = 1_700_000_000
    plan = [("A", "x", 1), ("B", "", 2)]
    of = lambda at, rows: [("s", 7, at, k, n, t + k * HOUR, t + (k + 1) * HOUR, a, b) for k, (a, b, n) in enumerate(rows)]
    rows = of(t, plan) + of(t + 60, plan) + of(t + 120, [("A", "x", 1), ("B", "new", 2)]) + of(t + 240, plan) + of(t + 300, [("A", "x", 5), ("B", "", 2)])
    got = K.snapshots(refreshes(spark, t, t + 60, t + 120, t + 180, t + 240, t + 300), spark.createDataFrame(rows, EVENTS)).groupBy("at").agg({"version": "max"}).orderBy("at").collect()
    # the refresh without events is new, too; a number alone is no new content
    assert [r[1] for r in got] == [1, 1, 2, 3, 4, 4]
    many = refreshes(spark, *range(t, t + 40))
    rows = [r for k in range(40) for r in of(t + k, [(f"A{k}", "", 1)])]
    got = K.snapshots(many, spark.createDataFrame(rows, EVENTS)).orderBy("at").collect()
    assert [r.version for r in got] == [(k + 1) % 32 for k in range(40)]


def test_what_a_refresh_takes_in(spark):
    t = 1_700_000_000
    rows = [(t - 6 * HOUR - 1, t, "early"), (t - 6 * HOUR, t - 1, "first"), (t + 7 * DAY, t + 8 * DAY, "last"), (t + 7 * DAY + 1, t + 8 * DAY, "late"), (t, t, "empty"), (t, t + 1, ""), (t - 5, t + 100, "now"), (t + 100, t + 500_000, "long"), (t + 50, t + 60, None)]
    rows = [("s", 7, t, k, 0 if k == 6 else 70_000 + k, a, b, n, None) for k, (a, b, n) in enumerate(rows)]
    heads, got = read(K.guide_sections(refreshes(spark, t), spark.createDataFrame(rows, EVENTS)))
    got = sorted((h[5], h[1], r.event_id, r.start_utc, r.duration_s, r.running, r.title) for r, h in got)
    made = (t - 5) // 60 ^ (t - 5) >> 16
    assert got == [(0x4E, 0, made & 0xFFFF, t - 5, 105, 4, "now"), (0x50, 0, 70_001 & 0xFFFF, t - 6 * HOUR, 6 * HOUR - 1, 1, "first"), (0x50, 1, made & 0xFFFF, t - 5, 105, 1, "now"), (0x50, 3, 70_002 & 0xFFFF, t + 7 * DAY, DAY, 1, "last")]
    # the following event is too long to be told, so its section is empty
    assert len(heads) == 5 and all(h[-1] for h in heads.values())


def test_tables_and_segments(spark):
    t = 1_700_000_000
    rows = [("s", 7, t, 800 - k, k + 1, t + 60 * k, t + 60 * k + 60, f"Event {k} Зима" * 9, "текст " * 40) for k in range(800)]
    heads, got = read(K.guide_sections(refreshes(spark, t), spark.createDataFrame(rows, EVENTS)))
    plan = sorted((h[5], h[1], h[2], h[3], h[4], r.start_utc) for r, h in got if h[5] != 0x4E)
    assert len(plan) == 768 and {p[4] for p in plan} == {0x52} and [p[5] for p in plan] == [t + 60 * k for k in range(32, 800)]
    assert all(p[2] == 255 and p[3] == (p[1] | 7) for p in plan)
    title = [r for r, _ in got if r.start_utc == t + 60 * 40][0]
    assert ("Event 40 Зима" * 9).startswith(title.title) and len(title.title.encode()) in (78, 79) and ("текст " * 40).startswith(title.description)
    other = K.guide_sections(refreshes(spark, t), spark.createDataFrame(rows, EVENTS), other=True)
    assert sorted((r.table_id, r["count"]) for r in other.groupBy("table_id").count().collect()) == [(0x4F, 2), (0x60, 256), (0x61, 256), (0x62, 256)]
    few = spark.createDataFrame(rows[:11], EVENTS)
    heads, got = read(K.guide_sections(refreshes(spark, t), few))
    assert sorted((h[1], h[2], h[3]) for r, h in got if h[5] == 0x50) == [(k, 10, min(10, k | 7)) for k in range(11)]
    assert K.guide_sections(refreshes(spark, t), few.limit(0)).count() == 0
