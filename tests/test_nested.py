"""PES units, T2-MI, program identity, channel rows."""

import random

import pytest

from beamline.functions import scalars as X
from beamline.operators import quality
from beamline.sources import nested
from beamline.sources import sections as S


class Row:
    def __init__(self, pkt, seq=0, codec=None):
        self.pkt, self.seq, self.codec = pkt, seq, codec


def carried(data, pid, starts):
    """Outer packets of a byte stream; ``starts`` are where units begin in it."""
    out, at = [], 0
    while at < len(data):
        first = next((s - at for s in starts if 0 <= s - at < 183), None)
        size = 184 if first is None else 183
        body = data[at : at + size].ljust(size, b"\xff")
        head = bytes([0x47, (0x40 if first is not None else 0) | pid >> 8, pid & 255, 0x10 | len(out) % 16])
        out.append(head + (b"" if first is None else bytes([first])) + body)
        at += size
    return out


@pytest.mark.parametrize("short", [True, False])
def test_t2mi(short):
    rng = random.Random(short)
    inner = [b"\x47" + bytes([1, k]) + bytes(rng.randrange(256) for _ in range(185)) for k in range(12)]
    stuffing = b"\x47\x1f\xff" + b"\0" * 185
    stream = b"".join((p[1:] if short else b"\0" + p[1:]) for p in (*inner[:6], stuffing, *inner[6:]))
    size, units, at = 187 if short else 188, [], 0
    while at < len(stream):
        part = stream[at : at + 500]
        sync = -at % size
        head = bytes([0xC0, 0]) + (b"\0\0" if short else b"\x05\xe0") + (len(part) * 8).to_bytes(2, "big") + (b"\0" if short else b"\x47") + (sync * 8 if sync < len(part) else 0xFFFF).to_bytes(2, "big") + b"\0"
        body = bytes([0, 7, 0]) + head + part
        unit = bytes([0, len(units), 0, 0]) + (len(body) * 8).to_bytes(2, "big") + body
        units.append(unit + S.crc32_mpeg(unit).to_bytes(4, "big"))
        at += 500
    starts = [sum(map(len, units[:k])) for k in range(len(units))]
    outer = carried(b"".join(units), 4096, starts)
    own = nested.Carrier()
    got = [p for k, packet in enumerate(outer) for _, plp, p in own.feed(Row(packet, k)) if plp == 7]
    assert got == inner
    other = nested.Carrier(pipe=3)
    assert not [p for packet in outer for p in other.feed(Row(packet))]
    broken = nested.Carrier()
    kept = [p for k, packet in enumerate(outer) if k != 5 for _, _, p in broken.feed(Row(packet, k))]
    assert 0 < len(kept) < len(inner) and all(p in inner for p in kept)


def pipes(rng, n):
    """Outer packets of two pipes' frames, with gaps, errors, marks and broken units."""
    units = []
    for k in range(n):
        size = rng.choice([0, 40, 150, 400, 700])
        sync = rng.choice([0xFFFF, 0xFFFF, *(8 * x for x in (0, 30, 38, 148, 188))])
        head = bytes([0xC0 if rng.random() < 0.95 else 0, 0]) + b"\x05\xe0" + (size * 8).to_bytes(2, "big") + b"\x47" + sync.to_bytes(2, "big") + b"\0"
        body = bytes([0, rng.choice([7, 7, 9]), 0]) + head + bytes(rng.randrange(256) for _ in range(size))
        unit = bytes([0, k % 256, 0, 0]) + (len(body) * 8).to_bytes(2, "big") + body
        units.append(unit + (S.crc32_mpeg(unit) ^ (rng.random() < 0.05)).to_bytes(4, "big"))
    out = carried(b"".join(units), 4096, [sum(map(len, units[:k])) for k in range(n) if k % 3])
    for k, p in enumerate(out):
        if rng.random() < 0.02:
            out[k] = rng.choice([None, p[:1] + bytes([p[1] | 0x80]) + p[2:], p[:3] + bytes([p[3] | 0x20]) + b"\x07\x80" + b"\xff" * 6 + p[4:180], p[:4] + b"\xff" + p[5:]])
    return [(k, p) for k, p in enumerate(out) if p]


@pytest.mark.parametrize("pipe", [None, 9])
def test_t2mi_in_runs_is_what_one_pass_gives(spark, pipe):
    rows, expected = [], []
    for stream in range(6):
        own = nested.Carrier(pipe)
        for seq, p in pipes(random.Random(stream), 250):
            rows.append((stream, 4096, seq, p))
            expected += [(stream, *r) for r in own.feed(Row(p, seq))]
    df = spark.createDataFrame(rows, "stream_id long, pid int, seq long, pkt binary")
    for span in (3, 40, 10**6):
        got = nested.t2mi_packets(df, 4096, pipe, span).select("stream_id", "seq", "plp", "pkt").collect()
        assert sorted((r[0], r[1], r[2], bytes(r[3])) for r in got) == sorted(expected) and len(got) > 200


def test_pes_units(spark):
    field = lambda v, tag: bytes([tag << 4 | (v >> 30 & 7) << 1 | 1, v >> 22 & 255, (v >> 15 & 127) << 1 | 1, v >> 7 & 255, (v & 127) << 1 | 1])
    picture = b"\0\0\1\x65" + b"p" * 300
    first = b"\0\0\1\xe0\0\0\x80\xc0\x0a" + field(9000, 3) + field(5400, 1) + picture
    second = b"\0\0\1\xe0" + (3 + 5 + 20).to_bytes(2, "big") + b"\x80\x80\x05" + field(12_600, 2) + b"\0\0\1\x41" + b"q" * 16
    cut = b"\0\0\1\xe0\x01\x00\x80\x00\x00" + b"x" * 30
    packets = []
    for pes in (first, second, cut):
        data, fresh = pes, True
        while data:
            part, data = data[:184], data[184:]
            pad = 184 - len(part)
            adapt = b"" if not pad else bytes([pad - 1]) + (b"\0" + b"\xff" * (pad - 2) if pad > 1 else b"")
            packets.append(bytes([0x47, 0x40 * fresh | 1, 0, (0x30 if pad else 0x10) | len(packets) % 16]) + adapt + part)
            fresh = False
    df = spark.createDataFrame([("s", 256, k, p, "h264") for k, p in enumerate(packets)], "stream_id string, pid int, seq long, pkt binary, codec string")
    rows = nested.pes_units(df).orderBy("seq").collect()
    assert [(r.pts, r.dts, r.size, r.random_access) for r in rows] == [(9000, 5400, len(picture), True), (12_600, 12_600, 20, False)]
    assert bytes(rows[0].data) == picture


def test_program_identity(spark):
    pat = spark.createDataFrame([("s", 0, 1, 0, 5, 500), ("s", 0, 1, 1, 6, 600), ("s", 0, 9, 0, 6, 600)], "stream_id string, pid int, seq long, ord int, sid int, pmt_pid int")
    pmt = spark.createDataFrame([("s", 600, 2, 6, 0, 1, "video"), ("s", 600, 10, 6, 0, 11, "audio"), ("s", 600, 10, 6, 1, 12, "video"), ("s", 600, 11, 6, 0, 13, "video")], "stream_id string, pid int, seq long, sid int, ord int, es_pid int, kind string")
    assert tuple(nested.program_identity(pat, pmt).first()) == ("s", 6, 600, 12, 11)


def test_rows_of_a_node(spark):
    config = spark.createDataFrame([(0, "a", "A"), (1, "b", "B"), (2, "c", "C")], "ord int, stream_id string, name string")
    state = spark.createDataFrame([("a", True, "ok", 5_000_999, 4_000_000)], "stream_id string, active boolean, status string, bitrate_in long, bitrate_out long")
    viewers = spark.createDataFrame([("a", 3)], "stream_id string, viewers long")
    got = [tuple(r)[1:] for r in quality.channel_rows(config, state, viewers, 2).orderBy("ord").collect()]
    assert got == [("a", "A", True, 3, 5000, 4000), ("b", "B", False, 0, 0, 0)]
    packets = spark.createDataFrame([("a", 1000), ("b", 20_000)], "stream_id string, arrival_ms long")
    assert [r.stream_id for r in nested.multiplexed(packets, 25_000).collect()] == ["b"]


def test_coded_bit_rates(spark):
    rows = spark.createDataFrame([(8_000_000,), (8_000_699,), (8_000_777,), (8_000_799,), (8_000_700,), (8_000_829,), (50_700,)], "v long").select(X.target_bitrate("v").alias("r")).collect()
    assert [tuple(r.r) for r in rows] == [(8_000_000, 3000), (8_000_000, 0), (8_000_000, 3000), (8_000_000, 0), (8_000_000, 500), (8_000_000, 15_000), (50_700, 3000)]
