"""Segments of a stream: safe starts, held pictures and cuts, from packets' bytes."""

from types import SimpleNamespace

from beamline.operators import segmenter as G

VIDEO, AUDIO, MAP = 256, 257, 4096
SETS = b"\0\0\0\1\x67\x4d\x00\x1f\0\0\0\1\x68\xee"


def packet(pid, payload, start=False, clock=None, key=False, scrambled=False, count=0):
    """A packet; what is left before ``payload`` is adaptation."""
    field = b"" if clock is None else (clock << 15 | 0x7E00).to_bytes(6, "big")
    flags = (0x10 if clock is not None else 0) | (0x40 if key else 0)
    room = 184 - len(payload)
    adapt = b"" if not room else bytes([room - 1]) + (bytes([flags]) + field + b"\xff" * (room - 2 - len(field)) if room > 1 else b"")
    assert len(adapt) == room
    head = bytes([0x47, 0x40 * start | pid >> 8, pid & 255, 0x80 * scrambled | (0x30 if room else 0x10) | count % 16])
    return head + adapt + payload


def pes(sid, data):
    return b"\0\0\1" + bytes([sid]) + b"\0\0\x80\0\0" + data


def row(**own):
    base = {"seq": 0, "pid": VIDEO, "clock": None, "pusi": False, "has_payload": True, "clear": True, "random_access": False, "pat": False, "pmt": False, "table": False, "safe": True, "coded": False, "starts": False, "picture": None, "bytes": 100, "has_coded": False}
    return SimpleNamespace(**{**base, **own})


def told(rows, target=4000, independent=False):
    state, out = {}, []
    for k, r in enumerate(rows):
        r.seq = k
        out += G.segmenter_step(state, r, target, independent)
    return out


def test_cuts_at_unit_starts():
    tables = [row(pat=True, table=True, pid=0), row(pmt=True, table=True, pid=MAP)]
    at = lambda ms, pusi=True, **o: row(clock=ms * 90, pusi=pusi, **o)
    rows = [at(0), *tables, row(pusi=True), at(100, pusi=False), at(200), row(), at(900), at(1200, pusi=False), row(pusi=True), at(1300), at(5200), at(5400), at(9000, pusi=False), at(16_000, pusi=False), at(17_500, pusi=False)]
    # the first segment wants a second, from 200 on: no clock is on the start at place 9;
    # the last cut comes without a start, after three times the target
    assert told(rows) == [(5, 0, None), (6, 0, None), (7, 0, None), (8, 0, None), (9, 0, None), (10, 1, 1100), (11, 1, None), (12, 2, 4100), (13, 2, None), (14, 2, None), (15, 3, 12_000)]


def test_cuts_of_transcoded_streams():
    at = lambda ms, key: row(clock=ms * 90, random_access=key, pusi=key)
    rows = [at(0, False), at(40, True), at(1100, False), at(1140, True), at(5140, False), at(90_000, False), at(91_000, True)]
    assert told(rows, independent=True) == [(1, 0, None), (2, 0, None), (3, 1, 1100), (4, 1, None), (5, 1, None), (6, 2, 60_000)]
    wrap = [row(clock=(1 << 33) - 45_000, random_access=True, pusi=True), row(clock=45_000, random_access=True, pusi=True)]
    assert told(wrap, independent=True) == [(0, 0, None), (1, 1, 1000)]


def test_a_pid_waits_for_its_safe_start_and_its_clock_waits_too():
    first = row(clock=0, pusi=True, pat=True, pmt=True)
    rows = [first, row(pid=300), row(pid=300, pusi=True, safe=False), row(pid=300, pusi=True, clear=False), row(pid=300, clock=9_000_000), row(pid=0x1FFF), row(pid=9, has_payload=False), row(pid=300, pusi=True), row(pid=300)]
    assert [s for s, *_ in told(rows)] == [0, 5, 6, 7, 8]


def test_held_pictures():
    video = lambda ms, picture=None, **o: row(clock=None if ms is None else ms * 90, pusi=True, coded=True, starts=True, picture=picture, has_coded=True, **o)
    more = lambda picture=None, **o: row(coded=True, has_coded=True, picture=picture, **o)
    other = lambda **o: row(pid=AUDIO, has_coded=True, **{"pusi": True, **o})
    begin = video(0, "key", pat=True, pmt=True)
    # held from 2 on, decided at 4: what came in between goes with the key picture
    rows = [begin, other(clock=1000 * 90), video(1040), other(), more("key"), other(), video(1080, "key")]
    assert told(rows) == [(0, 0, None), (1, 0, None), (2, 1, 1040), (3, 1, None), (4, 1, None), (5, 1, None), (6, 1, None)]
    # another picture goes on with the segment; the next start decides where none was seen
    rows = [begin, video(1200), other(), more("other"), video(1240), other(), video(1280), more("key")]
    assert told(rows) == [(0, 0, None), *((k, 0, None) for k in range(1, 6)), (6, 1, 1280), (7, 1, None)]
    assert told([begin, video(1200, random_access=True)])[-1] == (1, 1, 1200)
    # no more than so many packets or bytes are held
    rows = [begin, video(1200), *(other() for _ in range(G.HELD_PACKETS - 1)), more("key"), other()]
    assert told(rows) == [(k, 0, None) for k in range(len(rows))]
    assert told([begin, video(1200), more(bytes=G.HELD_BYTES), more("key")])[-1] == (3, 0, None)
    assert told([begin, video(1200), more()]) == [(0, 0, None)]


def test_segments_of_a_capture_begin_with_key_pictures(spark):
    audio = pes(0xC0, b"\xff\xf1\x50" + b"a" * 60)
    rows, kinds = [], {}
    add = lambda p: rows.append(p) or len(rows) - 1
    add(packet(VIDEO, pes(0xE0, b"\0\0\1\x41" + b"v" * 50), True, 0))  # before the tables
    add(packet(0, b"\0" * 100, True)), add(packet(MAP, b"\0" * 100, True))
    add(packet(AUDIO, pes(0xC0, b"junk" * 10), True))  # no frame to begin with
    add(packet(VIDEO, pes(0xE0, b"\0\0\1\x41" + b"v" * 50), True, 90))  # begins, but is muted
    for n in range(130):
        ms, key = 40 * n + 40, n % 25 == 0
        slice_ = b"\0\0\1" + (b"\x65" if key else b"\x41") + b"v" * 40
        if n % 2 == 0 and not n % 25 == 0 or n == 0:
            kinds[add(packet(VIDEO, pes(0xE0, (SETS if key else b"") + slice_), True, ms * 90, key=False))] = key
        else:  # the slice's start code lies across two packets, audio in between
            head = pes(0xE0, (SETS if key else b"\0\0\1\x09\xf0") + b"\0\0\1\x06" + b"s" * 30 + slice_[: 1 + n % 3])
            kinds[add(packet(VIDEO, head, True, ms * 90))] = key
            add(packet(AUDIO, audio, True))
            add(packet(VIDEO, slice_[1 + n % 3 :]))
    packets = spark.createDataFrame([("s", k, p) for k, p in enumerate(rows)], "stream_id string, seq long, pkt binary")
    pids = spark.createDataFrame([("s", VIDEO, 0x1B, MAP), ("s", AUDIO, 0x0F, MAP)], "stream_id string, pid int, stream_type int, pmt_pid int")
    tables = spark.createDataFrame([("s", 1, 0), ("s", 2, 2)], "stream_id string, seq long, table_id int")
    found = G.prepared(packets, pids, tables)
    told = G.dealt(found, 2000)
    got = [tuple(r)[1:] for r in G.segments(told).orderBy("segment").collect()]
    begins = [b for _, b, *_ in got]
    assert got[0][4] == 40 * 26 - 1 and len(got) == 3 and all(kinds[b] for b in begins)
    assert begins[0] == 5 and [r[0] for r in got] == [0, 1, 2] and [r[4] for r in got[1:]] == [2000, 2000][: len(got) - 1]
    taken = {r.seq for r in told.collect()}
    assert not taken & {0, 1, 2, 3, 4} and all(b - 1 == a for (_, _, a, *_), (_, b, *_) in zip(got, got[1:]))
    pictures = {r.seq: r.picture for r in found.where("coded").collect()}
    assert [pictures[k] or pictures[k + 2] for k in kinds] == ["key" if key else "other" for key in kinds.values()]
    assert G.segments(G.dealt(G.prepared(packets.limit(0), pids, tables))).count() == 0
