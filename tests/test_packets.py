"""Packets, sections and continuity on synthetic bytes."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from beamline.operators import continuity
from beamline.plans import api
from beamline.sources import sections as S
from beamline.sources import transport as T


def packet(pid=256, cc=0, afc=1, pusi=False, tei=False, flags=None, pcr=None, payload=b"", tsc=0):
    head = bytes([0x47, (tei << 7) | (pusi << 6) | pid >> 8, pid & 255, tsc << 6 | afc << 4 | cc])
    if afc == 1:
        return head + payload.ljust(184, b"\xaa")[:184]
    field = bytes([(flags or 0) | (0x10 if pcr is not None else 0)])
    if pcr is not None:
        field += ((pcr // 300) << 15 | 0x7E00 | pcr % 300).to_bytes(6, "big")
    size = 183 if afc == 2 else max(1, len(field))
    return (head + bytes([size]) + field.ljust(size, b"\xff") + payload).ljust(188, b"\xaa")[:188]


def test_headers():
    found = T.headers(np.frombuffer(packet(0x1ABC, 7, 3, True, flags=0xC0, pcr=123456789) + packet(5, 1, 0) + packet(tei=True, tsc=2), np.uint8).reshape(-1, 188))
    assert found["valid"].tolist() == [True, False, True]
    assert found["pid"].tolist() == [0x1ABC, 5, 256] and found["cc"].tolist() == [7, 1, 0]
    assert found["pcr27"].tolist()[0] == 123456789 and found["pcr27"].isna().tolist() == [False, True, True]
    assert found["discontinuity"].tolist()[0] and found["random_access"].tolist()[0] and found["scrambling"].tolist()[2] == 2


def test_a_bad_adaptation_field_is_invalid():
    long, short_pcr = bytearray(packet(afc=3)), bytearray(packet(afc=3, flags=0x10))
    long[4], short_pcr[4] = 184, 3
    assert T.headers(np.frombuffer(bytes(long + short_pcr), np.uint8).reshape(-1, 188))["valid"].tolist() == [False, False]


def framed(data, trusted=False):
    """Places of the packets, found byte by byte."""
    out, at, follows = [], 0, True
    while at + 188 <= len(data):
        sync = data[at] == 0x47 and all(at + d + 188 > len(data) or data[at + d] == 0x47 for d in (188, 376))
        if sync and (trusted and follows or T.headers(np.frombuffer(data[at : at + 188], np.uint8).reshape(1, 188))["valid"][0]):
            out.append(at)
            at, follows = at + 188, True
        else:
            at, follows = at + 1, False
    return out


def damaged(rng, n):
    out = bytearray()
    for k in range(n):
        kind = rng.random()
        if kind < 0.1:
            out += bytes(rng.choice([0x47, 0, 1, 255]) for _ in range(rng.randrange(1, 300)))
        elif kind < 0.15:
            out += b"\x47" * rng.randrange(1, 400)
        elif kind < 0.2:
            out += packet(afc=0)
        out += packet(pid=rng.randrange(8191), cc=k % 16, afc=rng.choice([1, 1, 1, 2, 3]))
        if rng.random() < 0.1:
            del out[rng.randrange(len(out)) :][: rng.randrange(50)]
    return bytes(out)


def test_framing_finds_packets_after_junk():
    packets = b"".join(packet(cc=k) for k in range(3))
    assert len(T.frame(b"junk" + packets)) == 3
    damage = packets + b"\x47xx" + packets
    assert [r.tobytes() for r in T.frame(damage)] == [damage[p : p + 188] for p in framed(damage)] and len(framed(damage)) == 5
    assert len(T.frame(b"")) == 0 and len(T.frame(b"\x47" * 100)) == 0
    rng = random.Random(5)
    junk = bytes(rng.randrange(256) for _ in range(333)).replace(b"\x47", b"\x48")
    assert b"".join(r.tobytes() for r in T.frame(junk + packets)) == packets


@pytest.mark.parametrize("trusted", [False, True])
def test_framing_is_that_of_a_search_byte_by_byte(trusted):
    rng = random.Random(11)
    for n in [0, 1, 2, 3] + [rng.randrange(4, 25) for _ in range(60)] + [1500]:
        data = damaged(rng, n)
        assert [r.tobytes() for r in T.frame(data, trusted)] == [data[p : p + 188] for p in framed(data, trusted)]


@pytest.mark.parametrize("trusted", [False, True])
def test_captures_do_not_depend_on_the_ranges(spark, tmp_path, trusted):
    rng, files = random.Random(12), {}
    for k in range(3):
        files[f"f{k}.ts"] = damaged(rng, 200)
        (tmp_path / f"f{k}.ts").write_bytes(files[f"f{k}.ts"])
    for size in (1000, 5001, 1 << 20):
        got = T.read_captures(spark, str(tmp_path), trusted=trusted, range_bytes=size).orderBy("seq").collect()
        for name, data in files.items():
            own = [(r.seq, r["at"], bytes(r.pkt)) for r in got if r.stream_id.endswith(name)]
            assert own == [(i, p, data[p : p + 188]) for i, p in enumerate(framed(data, trusted))]


def test_captures_and_admission(spark, tmp_path):
    (tmp_path / "a.ts").write_bytes(b"".join(packet(pid=256 + k % 2, cc=k % 16) for k in range(20)))
    assert T.read_captures(spark, str(tmp_path)).count() == 20
    parsed = T.parse_headers(T.read_captures(spark, str(tmp_path), pids=[257]))
    assert [r.pid for r in parsed.collect()] == [257] * 10


def test_statuses_in_order(spark):
    seq = [(14, 1, False), (15, 1, False), (15, 1, False), (1, 1, False), (1, 2, False), (2, 1, False), (9, 1, True), (10, 1, False)]
    rows = [("s", 256, k, 0, cc, afc, afc != 2, disc, False) for k, (cc, afc, disc) in enumerate(seq)]
    rows += [("s", 8191, 90, 0, 0, 1, True, False, False), ("s", 256, 91, 0, 0, 1, True, False, True), ("s", 256, 92, 0, 0, 0, False, False, False)]
    df = spark.createDataFrame(rows, "stream_id string, pid int, seq long, arrival_ms long, cc int, afc int, has_payload boolean, discontinuity boolean, tei boolean")
    got = [r.status for r in continuity.status(df).orderBy("seq").collect()]
    assert got == ["InOrder", "InOrder", "Duplicate", "Gap", "InOrder", "InOrder", "Discontinuity", "InOrder"]


def test_crc_and_packets_of_a_section():
    section = S.eit_section(7, 0x50, 0, 0, 0, 3, (9, 1_700_000_000, 5400, "Новости", "x" * 300))
    assert S.crc32_mpeg(section) == 0 and S.crc32_mpeg(section[:-1] + b"\0") != 0


class Assembler:
    """Sections of one pid, packet by packet: a model of the operator."""

    def __init__(self, policy):
        self.policy, self.held, self.count = policy, b"", None

    def feed(self, p):
        afc, cc, policy = p[3] >> 4 & 3, p[3] & 15, self.policy
        if policy.check_count:
            if p[1] & 0x80:
                self.held, self.count = b"", None
                return []
            if self.count is not None and afc & 1:
                if cc == self.count:
                    return []
                if cc != (self.count + 1) % 16:
                    self.held = b""
            self.count = cc if afc & 1 else self.count
        start = 4 if afc == 1 else 5 + p[4] if afc == 3 else 188
        if start >= 188 or policy.clear_only and p[3] >> 6:
            return []
        data, out = p[start:], []
        if p[1] & 0x40:
            pointer, data = data[0], data[1:]
            if self.held:
                out += self.take(data[:pointer])
            self.held = b""
            out += self.take(data[pointer:])
        elif self.held:
            out += self.take(data)
        return out

    def take(self, data):
        self.held += data
        out = []
        while len(self.held) >= 3:
            size = 3 + ((self.held[1] & 15) << 8 | self.held[2])
            if self.held[0] == 0xFF or not self.policy.least <= size <= self.policy.most:
                self.held = b""
                break
            if len(self.held) < size:
                break
            out.append(self.held[:size])
            self.held = self.held[size:]
        if self.held[:1] == b"\xff":
            self.held = b""
        return out


def carried(rng, n):
    """Packets of a pid with sections that go across them, several in one, and damage."""
    data, starts, out, k = bytearray(), [], [], 0
    for _ in range(n):
        starts.append(len(data))
        size = rng.choice([10, 40, 200, 700, 1100])
        body = bytes(rng.randrange(256) for _ in range(size))
        own = bytes([rng.choice([0, 2, 0x42, 0x50])]) + (0xB000 | size + 4).to_bytes(2, "big") + body
        data += own + S.crc32_mpeg(own).to_bytes(4, "big")
        if rng.random() < 0.2:
            data += b"\xff" * rng.randrange(1, 300)
    at = 0
    while at < len(data):
        inside = [x for x in starts if at <= x < at + 183]
        own = bytes([inside[0] - at]) + bytes(data[at : at + 183]) if inside else bytes(data[at : at + 184])
        out.append(packet(7, k % 16, pusi=bool(inside), payload=own.ljust(184, b"\xff"), tei=rng.random() < 0.03, tsc=2 if rng.random() < 0.03 else 0))
        at, k = at + (183 if inside else 184), k + (rng.random() < 0.96) + (rng.random() < 0.03)
        if rng.random() < 0.1:
            out.append(packet(7, k % 16, afc=2))
    return [p for p in out if rng.random() < 0.97]


@pytest.mark.parametrize("policy", [S.DEMUX, S.GUIDE, S.NETWORK, S.MULTIPLEX])
def test_sections_are_those_of_the_model(spark, policy):
    rng, rows, expected = random.Random(9), [], []
    for stream in range(12):
        own = Assembler(policy)
        for seq, p in enumerate(carried(rng, 25)):
            rows.append((f"s{stream}", 7, seq, p))
            expected += [(f"s{stream}", 7, seq, s[0], s, S.crc32_mpeg(s) == 0) for s in own.feed(p)]
    df = spark.createDataFrame(rows, "stream_id string, pid int, seq long, pkt binary")
    got = sorted((r.stream_id, r.pid, r.seq, r.table_id, bytes(r.bytes), r.crc_ok) for r in S.assemble(df, policy).collect())
    assert got == sorted(expected) and len(got) > 50


def test_crc_is_that_of_the_polynomial():
    rng = random.Random(4)
    for n in (0, 1, 2, 3, 50, 999):
        data, value = bytes(rng.randrange(256) for _ in range(n)), 0xFFFFFFFF
        for b in data:
            value ^= b << 24
            for _ in range(8):
                value = (value << 1 ^ (0x04C11DB7 if value >> 31 else 0)) & 0xFFFFFFFF
        assert S.crc32_mpeg(data) == value


def section(table, body, version=0):
    out = bytes([table]) + (0xB000 | len(body) + 4).to_bytes(2, "big") + body
    return out + S.crc32_mpeg(out).to_bytes(4, "big")


def test_tables_end_to_end(spark):
    pat = section(0, bytes.fromhex("0001c10000") + bytes.fromhex("0000e010") + bytes.fromhex("0007e100"))
    pmt = section(2, bytes.fromhex("0007c10000e101f000") + bytes.fromhex("1be101f000") + bytes.fromhex("06e102f0086a0100") + b"\x0a\x03eng")
    name = bytes([0x48, 9, 1, 3]) + b"abc" + bytes([3]) + b"one"
    sdt = section(0x42, bytes.fromhex("0001c10000") + bytes.fromhex("0001ff") + bytes.fromhex("0007fc") + (0x8000 | len(name)).to_bytes(2, "big") + name)
    eit = S.eit_section(7, 0x4E, 0, 0, 0, 1, (9, 1_700_000_000, 5400, "Title  one", "Text"))
    orphan = S.eit_section(8, 0x4E, 0, 0, 0, 1, (9, 1_700_000_000, 5400, "T", ""))
    rows = [("s", pid, k, p) for k, (pid, p) in enumerate([(pid, p) for pid, sec in ((0, pat), (256, pmt), (17, sdt), (18, eit), (18, orphan)) for p in S.packetise(sec, pid)])]
    packets = spark.createDataFrame(rows, "stream_id string, pid int, seq long, pkt binary")
    found = S.assemble(packets)
    assert found.count() == 5 and found.where("crc_ok").count() == 5
    assert [(r.sid, r.pmt_pid) for r in S.pat(found).collect()] == [(7, 256)]
    streams = {r.es_pid: (r.codec, r.kind, r.language) for r in S.pmt(found).collect()}
    assert streams == {257: ("h264", "video", None), 258: ("ac3", "audio", "eng")}
    assert [(r.sid, r.provider, r.name) for r in S.sdt(found).collect()] == [(7, "abc", "one")]
    events = S.eit(found)
    assert [(r.sid, r.event_id, r.start_utc, r.duration_s, r.title, r.description) for r in events.where("sid = 7").collect()] == [(7, 9, 1_700_000_000, 5400, "Title one", "Text")]
    lacking = {(r.sid, r.fault) for r in S.inconsistent(events, S.pat(found), S.sdt(found)).collect()}
    assert lacking == {(7, "flags"), (8, "not in pat"), (8, "not in sdt")}
    assert {(r.pid, r.table_id): r.n for r in S.census(found).collect()}[(18, 0x4E)] == 2


def test_subtitle_tracks(spark):
    """Two pages on one pid are two tracks; a newer map without pages has none."""
    pages = b"eng\x10" + bytes.fromhex("00010002") + b"rus\x20" + bytes.fromhex("00030004") + b"eng\x11" + bytes.fromhex("00010009")
    stream = lambda kind, pid, more: bytes([kind]) + (0xE000 | pid).to_bytes(2, "big") + (0xF000 | len(more)).to_bytes(2, "big") + more
    head = lambda sid: sid.to_bytes(2, "big") + bytes.fromhex("c10000e101f000")
    listed = b"\x59" + bytes([len(pages)]) + pages
    odd = stream(6, 300, b"\x59\x07eng\x10\0\0\1") + stream(27, 301, listed) + stream(6, 16, listed) + stream(6, 302, b"\x59\x00")
    three = b"\x59" + bytes([len(pages)]) + pages.replace(bytes.fromhex("00010009"), bytes.fromhex("00070009"))
    many = b"".join(stream(6, 400 + k, three) for k in range(22))
    maps = [(256, section(2, head(7) + odd + stream(6, 258, b"\x0a\x04eng\0" + listed))), (257, section(2, head(8) + many)), (258, section(2, head(9) + stream(6, 258, listed) + b"\x06\xe1")), (256, section(2, head(7) + stream(27, 258, b"")))]
    rows = [("s", pid, k, p) for k, (pid, p) in enumerate([(pid, p) for pid, sec in maps for p in S.packetise(sec, pid)])]
    found = S.assemble(spark.createDataFrame(rows, "stream_id string, pid int, seq long, pkt binary"))
    older = found.where(F.col("seq") < len(rows) - 1)
    tracks = [tuple(r) for r in api.subtitle_tracks(older, "s", 7).collect()]
    assert tracks == [(0, "258:eng:1", 258, "eng", 16, 1, 2), (1, "258:rus:3", 258, "rus", 32, 3, 4)]
    assert api.subtitle_tracks(found, "s", 7).count() == 0 and api.subtitle_tracks(found, "s", 9).count() == 0
    assert [r.es_pid for r in api.subtitle_tracks(found, "s", 8).collect()] == [400 + k // 3 for k in range(64)]


def test_dvb_text():
    assert S.dvb_text("é".encode()) == "é" and S.dvb_text(b"\xe9") == "é"
    assert S.dvb_text(b"\x01" + "Новости".encode("iso8859_5")) == "Новости"
    assert S.dvb_text(b"\x10\x00\x05" + "Новости".encode("iso8859_5")) == "Новости"
    assert S.dvb_text(S.dvb_text_bytes("Зима")) == "Зима" and S.dvb_text_bytes("plain") == b"plain"
    assert len(S.dvb_text_bytes("Ж" * 200, 11)) <= 11


def test_rtp(spark):
    good = bytes.fromhex("80210007000000640000000a") + b"payload"
    extended = bytes.fromhex("90210008000000650000000a") + bytes.fromhex("beef0001") + b"\0\0\0\1" + b"body"
    rows = T.rtp(spark.createDataFrame([(0, good), (1, extended), (2, b"\x40" * 20), (3, b"x")], "k int, datagram binary")).orderBy("k").collect()
    assert [r.valid for r in rows] == [True, True, False, False]
    assert (rows[0].sequence, rows[0].timestamp, bytes(rows[0].payload)) == (7, 100, b"payload") and bytes(rows[1].payload) == b"body"


def test_timestamps_of_pes_packets(spark):
    pts = 5_000_000_123
    field = bytes([0x21 | (pts >> 30 & 7) << 1, pts >> 22 & 255, (pts >> 15 & 127) << 1 | 1, pts >> 7 & 255, (pts & 127) << 1 | 1])
    pes = b"\0\0\1\xe0\0\0\x80\x80\x05" + field
    loose = pes[:9] + bytes([field[0] & 0xFE]) + field[1:]
    rows = spark.createDataFrame([(k, p) for k, p in enumerate((packet(pusi=True, payload=pes), packet(pusi=True, payload=loose), packet(payload=pes)))], "seq int, pkt binary")
    parsed = rows.join(T.parse_headers(rows), "seq")
    assert [r.pts for r in T.pes_pts(parsed).orderBy("seq").collect()] == [pts, None, None]
    assert [r.pts for r in T.pes_pts(parsed, strict=False).orderBy("seq").collect()] == [pts, pts, None]


def test_null_packets_do_not_count(spark):
    df = spark.createDataFrame([("s", 8191, 1, False), ("s", 1, 2, True), ("s", 1, 3, False)], "stream_id string, pid int, seq long, tei boolean")
    assert [r.seq for r in continuity.usable(df).collect()] == [3]
    assert continuity.admitted(df, df.where(F.col("pid") == 1)).count() == 2


def test_dvb_text_falls_back_where_a_set_is_not_mapped():
    word = bytes([0x41, 0xE9, 0xFF])
    for selector in (2, 3, 4, 6, 7, 9, 10, 11):
        assert S.dvb_text(bytes([selector]) + word) == word.decode("latin-1")
    for k in (1, 2, 3, 4, 15):
        assert S.dvb_text(b"\x10\x00" + bytes([k]) + word) == word.decode("latin-1")
    assert S.dvb_text(b"\x05" + "ışık".encode("iso8859_9")) == "ışık" == S.dvb_text(b"\x10\x00\x09" + "ışık".encode("iso8859_9"))
    assert S.dvb_text(b"\x11" + "Ω m".encode("utf-16-be")) == "Ω m" and S.dvb_text(b"\x15" + "Ω".encode()) == "Ω"
    assert S.dvb_text(b"a\x00b\x86c\nd\x9f") == "abc\nd" and S.dvb_text(b"") == ""
