"""What only larger tables show: the queries against their DuckDB forms on small tables
whose keys or groups are as large as there."""

import itertools
import time

import duckdb
import pytest

from pyspark.sql import functions as F

from beamline.operators import folds, sessions
from beamline.plans.registry import ORACLES, QUERIES
from beamline.sources import captures, transport

SF = "/root/testdata/sf0.001"


def same(spark, folder, name, **tables):
    """A query and its SQL on the given tables (as SQL) and the smallest others."""
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        con.sql(f"copy ({tables.get(t, f'''select * from '{SF}/{t}.parquet' ''')}) to '{folder}/{t}.parquet'")
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    df = QUERIES[name](spark, str(folder))
    other = con.sql(f"select {', '.join(f'''"{c}" ''' for c in df.columns)} from ({ORACLES[name]})").fetchall()
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, other))
    return other


def orders(keys: str, customer: str = "k * 25", date: str = "timestamp '1994-01-01' + to_minutes((k % 9000)::int)") -> str:
    return f"select ({keys})::bigint as o_orderkey, ({customer})::bigint as o_custkey, 'O' as o_orderstatus, 1.0::double as o_totalprice, {date} as o_orderdate, '1-URGENT' as o_orderpriority"


@pytest.mark.parametrize("name", ["p12_events", "a13_section_census", "a13_table_stamps", "j14_inconsistent_services"])
def test_a_schedule_of_more_events_than_its_tables_hold(spark, tmp_path, name):
    # 45,000 events of one channel would take 176 tables, ids above 255
    assert same(spark, tmp_path, name, orders=orders("k") + " from range(45000) t(k)")


def test_pairs_of_channels_are_those_of_the_rows(spark, tmp_path):
    # rows that are alike twice: by id and by name, and whole rows given twice
    customers = "select k::bigint as c_custkey, 'c' as c_name, 0 as c_nationkey, 1.0::double as c_acctbal, 'm' as c_mktsegment from (select unnest([3, 3, 6, 40, 46, 1]) as k)"
    suppliers = "select k::bigint as s_suppkey, 's' as s_name, 0 as s_nationkey, 1.0::double as s_acctbal from (select unnest([6, 6, 40, 46, 3]) as k)"
    assert len(same(spark, tmp_path, "j9_same_channels", customer=customers, supplier=suppliers)) > 6


def test_pairs_of_channels_take_little_disk(spark, tmp_path):
    # names of 500 rows and 100: more than a block on the left; 1,629,541 pairs, which took 1,810 kB when they came in any order
    con, out = duckdb.connect(), tmp_path / "out"
    con.sql(f"copy (select k::bigint as c_custkey from range(20000) t(k)) to '{tmp_path}/customer.parquet'")
    con.sql(f"copy (select k::bigint as s_suppkey from range(4000) t(k)) to '{tmp_path}/supplier.parquet'")
    QUERIES["j9_same_channels"](spark, str(tmp_path)).write.parquet(str(out))
    for t in ("customer", "supplier"):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    con.sql(f"create view got as select id, r_id from '{out}/*.parquet'")
    con.sql(f"create table want as {ORACLES['j9_same_channels']}")
    odd = con.sql("select count(*) from ((select * from want except all select * from got) union all (select * from got except all select * from want))").fetchall()
    n = con.sql("select count(*) from want").fetchall()[0][0]
    assert odd == [(0,)] and n > 1_500_000
    assert sum(p.stat().st_size for p in out.glob("*.parquet")) < n / 2


def test_pairs_of_channels_from_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(sessions, "LEFT_BLOCK", 3)
    monkeypatch.setattr(sessions, "RIGHT_BLOCK", 2)
    values = [None, "", "1", "2"]
    rows = [(i, n, t, k) for k, (i, n, t) in enumerate(itertools.product(values, repeat=3))] + [("1", "2", "1", 99), (None, "1", "", 98), ("1", "2", "1", 99)]
    channels = spark.createDataFrame(rows, "id string, name string, tvg_id string, port int")
    alike = lambda a, b: a[2] == b[2] if a[2] and b[2] else bool(a[0] and a[0] == b[0]) or bool(a[1] and a[1] == b[1])
    want = [(*a, *b) for a in rows for b in rows if alike(a, b)]
    got = sessions.same_channel(channels, channels)
    assert got.columns == ["id", "name", "tvg_id", "port", "r_id", "r_name", "r_tvg_id", "r_port"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    got = sessions.same_channel(channels, channels, ["port"])
    assert sorted(map(tuple, got.collect())) == sorted((w[3], w[7]) for w in want)


def test_ids_of_a_large_multiplex(spark):
    n = 40_000
    rows = spark.range(n).selectExpr("id % 1 as mux_id", "id as ord", "cast(1 as bigint) as wanted")
    began = time.monotonic()
    got = folds.service_ids(rows).agg({"service_id": "max", "ord": "count"}).collect()[0]
    assert tuple(got) == (n, n) and time.monotonic() - began < 20  # 800 million steps one by one


def test_a_day_that_is_a_mark_in_the_broadcast_form(spark, tmp_path):
    assert ("20380422124848 +0000" in str(same(spark, tmp_path, "x1_guide_times", orders=orders("24940 + k") + " from range(20) t(k)")))


SUPPLIERS = "select k::bigint as s_suppkey, 's' as s_name, (k % 2)::int as s_nationkey, 1.0::double as s_acctbal from range(9000) t(k)"


@pytest.mark.parametrize("name", ["p8_streams", "p23_program_identity", "p15_program_maps"])
def test_a_map_of_more_streams_than_a_section_holds(spark, tmp_path, name):
    # 4,500 streams a program: 40 kB; from 7,000 on pids repeat, and some go past 13 bits with 1,000 more
    assert same(spark, tmp_path, name, supplier=SUPPLIERS)


def test_more_subtitle_tracks_than_a_list_of_the_operator(spark, tmp_path):
    assert len(same(spark, tmp_path, "p17_subtitle_tracks", supplier=SUPPLIERS.replace("9000", "5000"))) > 2 * 64


def test_a_guide_cache_of_more_records_than_a_file_may_have(spark, tmp_path):
    events = "select k::bigint as event_id, timestamp '2024-01-01' as ts, k % 9 as user_id, 'view' as event_type, 1.0::double as value, '' as props from range(1210000) t(k)"
    assert len(same(spark, tmp_path, "s10_guide_cache", events=events)) > 800_000


def test_clocks_that_went_round(spark, tmp_path):
    # 2^33 ticks of 90 kHz are 2,386,093 events
    events = "select (2380000 + k)::bigint as event_id, timestamp '2024-01-01' as ts, k % 9 as user_id, case when k % 2 = 0 then 'view' else 'click' end as event_type, 1.0::double as value, '' as props from range(12000) t(k)"
    assert len(same(spark, tmp_path, "p1_packet_headers", events=events)) == 12_000


def test_a_schedule_of_several_tables(spark, tmp_path):
    # 900 events in a refresh: 4 tables, and more than the 768 that the operator sends by itself
    date = "timestamp '1994-01-01' + to_seconds((k * 600)::int)"
    found = same(spark, tmp_path, "k4_guide_versions", orders=orders("k", date=date) + " from range(3000) t(k)")
    assert max(r[4] for r in found) > 768


def test_parts_of_a_capture_are_one_stream(spark, tmp_path):
    # parts of 40 packets; some end before junk that only the next one shows
    pkt = F.expr("concat(case when id % 7 = 0 then repeat(x'00', cast(1 + id % 40 as int)) else x'' end, unhex('47010010'), rpad(unhex(lpad(hex(id), 8, '0')), 184, x'AA'))")
    rows = spark.range(300).select(F.lit("a").alias("stream_id"), F.col("id").alias("seq"), pkt.alias("pkt"))
    parts, whole = str(tmp_path / "parts"), str(tmp_path / "whole")
    transport.write_captures(rows, parts, part_packets=40).count()
    transport.write_captures(rows, whole).count()
    old = lambda path: transport.read_captures(spark, f"{path}/*/*.ts", range_bytes=1000)
    expected = sorted((r.seq, r.at, bytes(r.pkt)) for r in old(whole).collect())
    got = transport.read_captures(spark, f"{parts}/*/*.ts", range_bytes=1000, joined=True).collect()
    assert sorted((r.seq, r.at, bytes(r.pkt)) for r in got) == expected and {r.seq for r in got} == set(range(len(got)))
    source = captures.captures(spark, parts, range_bytes=1000, joined=True).collect()
    assert sorted((r.at, bytes(r.pkt)) for r in source) == sorted((at, p) for _, at, p in expected)
    assert sorted((r.seq, r.at, bytes(r.pkt)) for r in old(parts).collect()) != expected
