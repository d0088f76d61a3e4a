"""Slice headers, field pairs, access units and their times."""

import random

from beamline.operators import timing
from beamline.sources import pictures as P

START = b"\0\0\0\1"
WRAP = 1 << 33


def golomb(n):
    bits = f"{n + 1:b}"
    return "0" * (len(bits) - 1) + bits


def nal(first, bits):
    """A NAL unit of a first byte and bits, with a stop bit and emulation bytes."""
    bits += "1"
    raw = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    out, zeros = bytearray(), 0
    for b in raw:
        if zeros >= 2 and b <= 3:
            out.append(3)
            zeros = 0
        out.append(b)
        zeros = zeros + 1 if b == 0 else 0
    return bytes([first]) + bytes(out)


def sequence(own=0, profile=77, frame_bits=4, frames=False, high="", order="0"):
    picture_order = golomb(0) + golomb(2) if order == "0" else order
    return nal(0x67, f"{profile:08b}" + "0" * 16 + golomb(own) + high + golomb(frame_bits - 4) + picture_order + golomb(1) + "0" + golomb(44) + golomb(17) + str(int(frames)))


def picture_set(own=0, of=0):
    return nal(0x68, golomb(own) + golomb(of) + "10")


def coded(frame, field=None, key=False, first_mb=0, pps=0, key_id=0, frame_bits=4, body=b"\x5a" * 20):
    """A slice; ``field`` is its parity, None a frame of a stream that has fields."""
    bits = golomb(first_mb) + golomb(7) + golomb(pps) + f"{frame:0{frame_bits}b}" + ("0" if field is None else f"1{field}") + (golomb(key_id) if key else "")
    return nal(0x65 if key else 0x41, bits) + body


def units_of(data, sizes):
    own, got, at = P.Splitter(), [], 0
    for n in sizes:
        got += own.feed(data[at : at + n])
        at += n
    return got + own.feed(data[at:]) + own.close()


def stream(*nals):
    return b"".join(START + n for n in nals)


AUD = b"\x09\xf0"


def test_bits_side_by_side():
    rng = random.Random(5)
    values = [[rng.choice([0, 1, 2, 3, 255, 65_535, 2**31 - 2, 2**32 - 2]) for _ in range(4)] for _ in range(60)]
    got = P.Bits([nal(0x41, "".join(golomb(v) for v in row) + "00000000000000000000001") for row in values])
    assert [list(r) for r in zip(*(got.golomb().tolist() for _ in range(4)))] == values
    assert got.ok.all() and (got.read(23) == 1).all() and got.ok.all()
    short = P.Bits([b"\x41\x01", b"\x41\x80\x00"])
    assert short.golomb().tolist()[1] == 0 and short.ok.tolist() == [False, True]
    assert short.read([0, 15]).tolist()[1] == 0 and short.ok.tolist() == [False, True]


def test_parameter_sets():
    assert P.sequence_set(sequence(3, frame_bits=9, frames=True)) == (3, 9, True)
    assert P.sequence_set(sequence(order=golomb(1) + "0" + golomb(5) + golomb(6) + golomb(2) + golomb(1) + golomb(4))) == (0, 4, False)
    lists = golomb(1) + golomb(0) + golomb(0) + "0" + "1" + "1" + golomb(0) * 16 + "0" * 5 + "1" + golomb(16) + "0"
    assert P.sequence_set(sequence(profile=100, high=lists, frames=True)) == (0, 4, True)
    lists = golomb(3) + "0" + golomb(0) + golomb(0) + "0" + "1" + "0" * 12
    assert P.sequence_set(sequence(profile=244, high=lists)) == (0, 4, False)
    assert P.sequence_set(b"\x67\x4d\0") is None and P.picture_set(b"\x68") is None
    assert P.sequence_set(sequence(order=golomb(3))) is None
    assert P.picture_set(picture_set(4, 3)) == (4, 3)


def test_two_fields_are_one_unit_however_the_bytes_arrive():
    sets = [sequence(), picture_set()]
    nals = [AUD, *sets, coded(0, 0, key=True), AUD, picture_set(), coded(0, 1)]  # a key field and its other field
    nals += [AUD, coded(1, 0), coded(1, 0, first_mb=50), coded(1, 1), coded(1, 1, first_mb=50)]
    nals += [AUD, coded(2, 1), AUD, coded(3, 1), AUD, coded(3, 0)]  # a field alone, then a pair
    nals += [AUD, coded(4), AUD, coded(4), AUD, b"\x06\x01", coded(5, 0), coded(5, 1), coded(5, 0)]  # frames; a third field
    nals += [AUD, coded(6, 0, key=True, key_id=1), coded(6, 1, key=True, key_id=2), AUD, coded(7, 0), AUD]
    ends = [7, 12, 14, 18, 20, 22, 26, 27, 29, 30, len(nals)]
    want = [(2, True, 3600), (2, False, 3600), (1, False, 1800), (2, False, 3600), (1, False, 3600), (1, False, 3600), (2, False, 3600), (1, False, 1800), (1, True, 1800), (1, True, 1800), (1, False, 1800)]
    sizes = [len(stream(*nals[a:b])) for a, b in zip([0, *ends], ends)]
    data, rng = stream(*nals), random.Random(3)
    for cuts in ([], [1] * len(data), [7] * 300, [rng.randrange(1, 30) for _ in range(200)]):
        got = units_of(data, cuts)
        assert [(u[3], u[2], u[4]) for u in got] == want
        assert [u[1] for u in got] == sizes and sum(sizes) == len(data)


def test_prefixes_and_joins_in_the_middle():
    own = lambda *nals: [(u[1], u[3]) for u in units_of(stream(*nals), [])]
    size = lambda *nals: len(stream(*nals))
    a, b, c = coded(0), coded(1), coded(2)
    assert own(AUD, sequence(), picture_set(), picture_set(1), a, AUD, b, AUD) == [
        (size(AUD, sequence(), picture_set()), 0), (size(picture_set(1), a), 1), (size(AUD, b, AUD), 1)]
    orphan = coded(0, first_mb=9)
    assert own(orphan, AUD, a, AUD, b, AUD, c, AUD) == [(size(orphan), 0), (size(AUD, a), 1), (size(AUD, b), 1), (size(AUD, c, AUD), 1)]
    assert units_of(b"zz" + stream(a, b, c), [1, 1])[0][:2] == (0, size(a))
    assert units_of(b"no start code", []) == [(0, 13, False, 0, 3600)] and units_of(b"", []) == []
    long = coded(0, body=b"\x5a" * 300_000)
    assert own(AUD, long, AUD, b, AUD) == [(size(AUD, long), 1), (size(AUD, b, AUD), 1)]


def test_times_go_from_pes_units_to_pictures(spark):
    nals = [AUD, sequence(), picture_set(), coded(0, 0), coded(0, 1), AUD, coded(1, 0), coded(1, 1), AUD, coded(2, 0), AUD, coded(3, 0), coded(3, 1), AUD, coded(4), AUD]
    data = stream(*nals)
    at = lambda n: len(stream(*nals[:n]))
    # PES units begin: at 0; inside the first pair; inside the second pair; at the single
    # field's delimiter (which wins over one just before it); inside the last pair
    begins = [0, at(4) + 3, at(7) + 2, at(8), at(12) + 1]
    stamps = [1000, 200_000, 333, 207_200, 209_000]
    rows = [("s", 7, k, p, p, data[a:b], "x") for k, (a, b, p) in enumerate(zip(begins, [*begins[1:], len(data)], stamps))]
    rows += [("t", 7, 0, None, None, data[: at(8)], "x"), ("t", 7, 1, 5000, 4000, data[at(8) :], "x"), ("u", 8, 0, 9, 9, None, "x")]
    units = spark.createDataFrame(rows, "stream_id string, pid int, seq long, pts long, dts long, data binary, codec string")
    got = P.access_units(units)
    assert set(got.columns) == {"stream_id", "pid", "seq", "size", "key", "pictures", "pts", "dts", "corrected"}
    rows = [tuple(r) for r in got.where("stream_id = 's'").orderBy("seq", "pts").select("seq", "pictures", "pts", "dts", "corrected").collect()]
    assert rows == [(0, 2, 1000, 1000, False), (1, 2, 200_000, 200_000, True), (3, 1, 207_200, 207_200, True), (3, 2, 209_000, 209_000, False), (4, 1, 209_000, 209_000, True)]
    rows = [tuple(r) for r in got.where("stream_id = 't'").orderBy("seq", "pts").select("pts", "dts", "corrected").collect()]
    assert rows == [(None, None, False), (None, None, False), (5000, 4000, True), (6800, 5800, False), (10_400, 9400, False)]
    assert got.where("stream_id = 'u'").count() == 0 and P.access_units(units.limit(0)).count() == 0


def test_recovered_times_by_the_rules(spark):
    """Unit after unit, as the rules are told."""
    rng, rows, want = random.Random(11), [], []
    for s in range(12):
        start = None if s % 4 == 3 else (rng.randrange(WRAP - 90_000, WRAP), 0)
        start = start and (start[0], (start[0] - rng.choice([0, 3600])) % WRAP)
        clock, locked = start, False
        for k in range(60):
            step = rng.choice([1800, 3600])
            guess = clock and (clock if k == 0 else tuple((c + step) % WRAP for c in clock))
            source = None
            if rng.random() < 0.7:
                off = rng.choice([0, 0, 0, 900, -7200, 45_000, -45_000] + ([45_001, -60_000] if s % 3 else []))
                p = ((guess or (777, 0))[0] + off) % WRAP
                source = (p, (p - rng.choice([0, 1800])) % WRAP)
            clock = guess
            corrected = False
            if source:
                away = (source[0] - guess[0] + WRAP // 2) % WRAP - WRAP // 2 if guess else None
                locked = locked or away is None or abs(away) > 45_000
                corrected = locked and source != guess
                clock = source if locked else guess
            rows.append((s, k, *(source or (None, None)), step, *(start or (None, None))))
            want.append((s, k, *(clock or (None, None)), corrected))
    units = spark.createDataFrame(rows, "stream_id int, idx int, pts long, dts long, step long, start_pts long, start_dts long")
    got = timing.recovered_times(units.repartition(3), ["stream_id"], "idx").select("stream_id", "idx", "pts", "dts", "corrected").collect()
    assert sorted(tuple(r) for r in got) == want


def test_ranges_of_a_pid_are_cut_as_one(spark):
    """PES units of a few bytes, start codes and headers across ranges, empty ranges."""
    rng, rows, want = random.Random(7), [], {}
    for s in range(6):
        nals = [AUD, sequence(), picture_set()]
        for k in range(60):
            nals += [AUD] * rng.choice([0, 1, 1, 2]) + [picture_set()] * rng.choice([0, 0, 1])
            nals += [coded(k % 16, p, first_mb=m, body=b"\x5a" * rng.choice([0, 3, 700])) for p in rng.choice([[None], [0, 1], [1]]) for m in rng.choice([[0], [0, 9], [9, 0]])]
        data = (b"zz" if s % 2 else b"") + stream(*nals) + rng.choice([b"", b"\0\0\1", b"\0\0\1\x09"])
        at, seq, own = 0, 0, P.Splitter()
        found = []
        while at < len(data):
            part = data[at : at + rng.choice([0, 1, 1, 2, 40] if s < 4 else [0, 5, 900])]
            rows.append((s, 7, seq, None, None, part))
            found += own.feed(part)
            at, seq = at + len(part), seq + rng.choice([1, 1, 1, 9])
        want[s] = sorted(u[1:4] for u in found + own.close())
    units = spark.createDataFrame(rows, "stream_id long, pid int, seq long, pts long, dts long, data binary")
    for span in (1, 3, 64):
        got = {s: [] for s in want}
        for r in P.access_units(units, span).collect():
            got[r.stream_id].append((r["size"], r.key, r.pictures))
        assert {s: sorted(v) for s, v in got.items()} == want


def test_no_task_has_a_pid_whole(spark):
    """Ranges of a pid's packets and of its bytes go to several tasks, whatever they compress to."""
    from pyspark.sql import functions as F

    from beamline.sources import nested

    pes = "concat(x'000001E00000808005', x'2100010001', x'0000014188')"
    rows = spark.range(4000).select(
        F.expr("id div 10000").alias("stream_id"), F.expr("cast(id div 10000 + 100 as int)").alias("pid"), F.col("id").alias("seq"), F.lit("h264").alias("codec"),
        F.expr(f"concat(case when id % 5 = 3 then x'474064' else x'470064' end, unhex(lpad(hex(16 + id % 16), 2, '0')), case when id % 5 = 3 then rpad({pes}, 184, x'42') else rpad(x'43', 184, x'43') end)").alias("pkt"))
    units = nested.pes_units(rows, span=100)
    sizes = [r.n for r in units.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 800 and max(sizes) < 800
    assert sorted(r.seq for r in units.collect()) == list(range(3, 4000, 5)) and {r["size"] for r in units.collect()} == {5 * 184 - 14, 2 * 184 - 14}
    assert units.exceptAll(nested.pes_units(rows)).count() == 0
