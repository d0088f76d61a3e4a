"""Scalar functions as column expressions; none needs Python at run time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PTS_WRAP, PCR_WRAP = 1 << 33, (1 << 33) * 300
#: Stream types of ISO/IEC 13818-1 and their codecs.
CODECS = {
    1: "mpeg1video", 2: "mpeg2video", 3: "mp2", 4: "mp2", 6: "private", 15: "aac", 16: "mpeg4video", 17: "aac_latm", 27: "h264", 36: "hevc", 129: "ac3", 135: "eac3",
}
#: Seconds before a start is tried again.
RETRY_S = (10, 10, 20, 40, 60, 120)
#: FNV-1a, 64 bits.
FNV_BASIS, FNV_PRIME = 14695981039346656037, 1099511628211
#: FNV-1a, 32 bits.
FNV32_BASIS, FNV32_PRIME = 2166136261, 16777619
#: Jitter of a retry, steps and milliseconds of a step.
JITTER_STEPS, JITTER_MS = 13, 150


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def bcd(x) -> Column:
    """Two decimal digits of a byte."""
    x = _c(x)
    return F.shiftright(x, 4) * 10 + x.bitwiseAND(F.lit(15))


def dvb_time(mjd, hour, minute, second, undefined: int | None = 0xFFFF) -> Column:
    """Epoch seconds of a modified Julian day and BCD time; null if out of range.
    ``undefined`` is the day that says there is no time; days that are counted on beyond
    16 bits have none."""
    h, m, s = bcd(hour), bcd(minute), bcd(second)
    digits = [F.when((v.bitwiseAND(F.lit(15)) <= 9) & (F.shiftright(v, 4) <= 9), True).otherwise(False) for v in map(_c, (hour, minute, second))]
    ok = (F.lit(True) if undefined is None else _c(mjd) != undefined) & digits[0] & digits[1] & digits[2] & (h <= 23) & (m <= 59) & (s <= 59)
    return F.when(ok, (_c(mjd).cast("long") - 40587) * 86400 + h * 3600 + m * 60 + s)


def dvb_duration(hour, minute, second) -> Column:
    """Seconds of a BCD duration; hours go up to 99."""
    m, s = bcd(minute), bcd(second)
    return F.when((m <= 59) & (s <= 59), bcd(hour) * 3600 + m * 60 + s)


def dvb_time_parts(epoch) -> Column:
    """Struct of the modified Julian day and BCD time; null outside 1970 to 2099."""
    e = _c(epoch)
    to_bcd = lambda v: F.floor(v / 10).cast("int") * 16 + (v % 10).cast("int")
    rest = F.pmod(e, F.lit(86400))
    return F.when(e.between(0, 4102444799), F.struct((F.floor(e / 86400) + 40587).cast("int").alias("mjd"), to_bcd(F.floor(rest / 3600)).alias("hour"), to_bcd(F.floor(rest / 60) % 60).alias("minute"), to_bcd(rest % 60).alias("second")))


def xmltv_time(text) -> Column:
    """Epoch seconds of ``yyyyMMddHHmm[ss][ +HHMM]``.

    Without a zone it is UTC; a day past the month's end runs into the next; an offset
    that is too short is left out, one with other than digits makes the value null."""
    t = F.trim(_c(text))
    part = lambda a, n: F.substring(t, a, n).try_cast("int")
    digits = F.regexp_extract(t, r"^([0-9]+)", 1)
    full = F.length(digits) == 14
    year, month, day, hour, minute = part(1, 4), part(5, 2), part(7, 2), part(9, 2), part(11, 2)
    second = F.when(full, part(13, 2)).otherwise(0)
    zone = F.trim(F.substring(t, F.length(digits) + 1, F.lit(20)))
    signed, tail = F.substring(zone, 1, 1).isin("+", "-"), F.substring(zone, 2, 4)
    offset = F.when(signed & (F.length(tail) == 4), F.when(tail.rlike("^[0-9]{4}$"), (F.substring(tail, 1, 2).try_cast("int") * 60 + F.substring(tail, 3, 2).try_cast("int")) * 60 * F.when(F.substring(zone, 1, 1) == "-", -1).otherwise(1)).otherwise(None)).otherwise(0)
    ok = (F.length(digits).isin(12, 14)) & month.between(1, 12) & day.between(1, 31) & (hour <= 23) & (minute <= 59) & (second <= 60)
    days = F.unix_date(F.make_date(year, F.when(month.between(1, 12), month).otherwise(1), F.lit(1))) + day - 1
    return F.when(ok, days.cast("long") * 86400 + hour * 3600 + minute * 60 + second - offset)


def epg_xml_time(epoch) -> Column:
    """``yyyyMMddHHmmss +0000``; empty for zero and below."""
    e = _c(epoch)
    day = F.date_from_unix_date(F.floor(e / 86400).cast("int"))
    rest = F.pmod(e, F.lit(86400)).cast("int")
    two = lambda v: F.lpad(F.floor(v).cast("string"), 2, "0")
    return F.when(e <= 0, "").otherwise(F.concat(F.date_format(day, "yyyyMMdd"), two(rest / 3600), two(rest / 60 % 60), two(rest % 60), F.lit(" +0000")))


def compact(text) -> Column:
    """White space runs become one blank; none at the ends."""
    return F.trim(F.regexp_replace(_c(text), r"[ \t\n\x0B\f\r]+", " "))


def xml_escape(text) -> Column:
    """X9"""
    out = F.replace(_c(text), F.lit("&"), F.lit("&amp;"))
    for a, b in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def m3u_attribute(text) -> Column:
    """Without quotes and line breaks."""
    return F.translate(F.coalesce(_c(text), F.lit("")), '"\r\n', "'  ")


def m3u_line(text) -> Column:
    """On one line."""
    return F.translate(F.coalesce(_c(text), F.lit("")), "\r\n", "  ")


def query_value(url, name: str) -> Column:
    """A decoded parameter of an address; null if absent."""
    raw = F.regexp_extract(_c(url), rf"[?&]{name}=([^&#]*)", 1)
    return F.when(_c(url).rlike(rf"[?&]{name}="), F.try_url_decode(raw))


def fnv1a64(text) -> Column:
    """FNV-1a of the UTF-8 bytes, as a signed 64-bit integer.

    Folds over the bytes in halves of 32 bits, so that no product leaves 64 bits."""
    low_p, high_p = FNV_PRIME & 0xFFFFFFFF, FNV_PRIME >> 32
    octets = F.transform(F.sequence(F.lit(1), F.octet_length(_c(text))), lambda i: F.conv(F.substring(F.hex(_c(text)), i * 2 - 1, F.lit(2)), 16, 10).cast("long"))
    octets = F.when(F.octet_length(_c(text)) > 0, octets).otherwise(F.array().cast("array<long>"))
    mask = F.lit(0xFFFFFFFF)
    start = F.struct(F.lit(FNV_BASIS >> 32).cast("long").alias("hi"), F.lit(FNV_BASIS & 0xFFFFFFFF).cast("long").alias("lo"))

    def step(acc, b):
        lo = acc["lo"].bitwiseXOR(b)
        product = lo * low_p
        carry = F.shiftrightunsigned(product, 32)
        high = (acc["hi"] * low_p + lo * high_p + carry).bitwiseAND(mask)
        return F.struct(high.alias("hi"), product.bitwiseAND(mask).alias("lo"))

    return F.aggregate(octets, start, step, lambda acc: F.shiftleft(acc["hi"], 32).bitwiseOR(acc["lo"]))


def fnv1a32(text) -> Column:
    """FNV-1a of the UTF-8 bytes in 32 bits."""
    digits = F.hex(_c(text))
    octets = F.transform(F.sequence(F.lit(1), F.octet_length(_c(text))), lambda i: F.conv(F.substring(digits, i * 2 - 1, F.lit(2)), 16, 10).cast("long"))
    octets = F.when(F.octet_length(_c(text)) > 0, octets).otherwise(F.array().cast("array<long>"))
    return F.aggregate(octets, F.lit(FNV32_BASIS).cast("long"), lambda h, b: (h.bitwiseXOR(b) * FNV32_PRIME).bitwiseAND(F.lit(0xFFFFFFFF)))


def clock_delta(now, before, wrap: int = PTS_WRAP) -> Column:
    """Signed difference of two clock readings by the half-range rule."""
    d = F.pmod(_c(now) - _c(before), F.lit(wrap))
    return F.when(d >= wrap // 2, d - wrap).otherwise(d)


def codec(stream_type) -> Column:
    """X15"""
    out = None
    for value, name in CODECS.items():
        out = F.when(_c(stream_type) == value, name) if out is None else out.when(_c(stream_type) == value, name)
    return out.otherwise("unknown")


def kind(codec_name) -> Column:
    """Video, audio or data."""
    c = _c(codec_name)
    return F.when(c.isin("mpeg1video", "mpeg2video", "mpeg4video", "h264", "hevc"), "video").when(c.isin("mp2", "aac", "aac_latm", "ac3", "eac3"), "audio").otherwise("data")


def slug(text) -> Column:
    """Plain characters only; others become a dash."""
    return F.trim(F.regexp_replace(F.lower(_c(text)), "[^a-z0-9]+", "-"), F.lit("-"))


def transcode_settings(width, height, fps, bps) -> Column:
    """Group length of two seconds, and a preset by bits a pixel."""
    density = _c(bps) / (_c(width) * _c(height) * _c(fps))
    return F.struct(F.round(_c(fps) * 2).cast("int").alias("gop"), F.when(density < 0.065, "slow").when(density < 0.13, "medium").otherwise("fast").alias("preset"), (density < 0.13).alias("adaptive"))


#: Renditions with their size and highest rate; how many a ladder has, the
#: least rate, the least step, and the least rate of a picture that gets one.
RENDITIONS = (("1080p", 1920, 1080, 6_500_000), ("720p", 1280, 720, 3_500_000), ("480p", 854, 480, 1_800_000), ("360p", 640, 360, 950_000))
MOST_RENDITIONS, LEAST_RATE, LEAST_STEP, LEAST_SOURCE = 3, 250_000, 50_000, 350_000


def abr_ladder(width, height, bps) -> Column:
    """The renditions below a picture of ``width`` by ``height`` at ``bps``: an array
    of ``name, width, height, rate``.

    Sides are rounded to multiples of eight; both have to be smaller than the picture's.
    A rate is the picture's by the share of pixels and a third more (1.35), at most the
    rendition's own and four fifths of the one above, at least ``LEAST_RATE``; one that
    is not ``LEAST_STEP`` below the one above is left out."""
    w, h, rate = (_c(x).cast("long") for x in (width, height, bps))
    eight = lambda x: max(8, (x + 4) // 8 * 8)
    given = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(eight(x)).alias("width"), F.lit(eight(y)).alias("height"), F.lit(most).cast("long").alias("most")) for n, x, y, most in RENDITIONS))
    start = F.struct(F.array().cast("array<struct<name:string,width:int,height:int,rate:bigint>>").alias("ladder"), rate.alias("above"))

    def step(acc: Column, r: Column) -> Column:
        pixels = r["width"].cast("long") * r["height"]
        scaled = F.floor((rate * pixels * 135).cast("decimal(38,0)") / (w * h * 100).cast("decimal(38,0)")).cast("long")
        scaled = F.greatest(F.lit(LEAST_RATE).cast("long"), F.least(scaled, r["most"], F.floor(acc["above"] * 80 / 100).cast("long")))
        fits = (F.size(acc["ladder"]) < MOST_RENDITIONS) & (acc["above"] > LEAST_RATE + LEAST_STEP) & (r["width"] < w) & (r["height"] < h) & (scaled + LEAST_STEP < acc["above"])
        more = F.struct(r["name"].alias("name"), r["width"].alias("width"), r["height"].alias("height"), scaled.alias("rate"))
        return F.struct(F.when(fits, F.concat(acc["ladder"], F.array(more))).otherwise(acc["ladder"]).alias("ladder"), F.when(fits, scaled).otherwise(acc["above"]).alias("above"))

    found = F.aggregate(given, start, step, lambda acc: acc["ladder"])
    return F.when((w > 0) & (h > 0) & (rate >= LEAST_SOURCE), found).otherwise(start["ladder"])


def spacing_ns(n_bytes, peak_bps) -> Column:
    """Nanoseconds that bytes take at the peak rate, rounded up."""
    return F.ceil(_c(n_bytes).cast("decimal(20,0)") * F.lit(8_000_000_000).cast("decimal(12,0)") / _c(peak_bps).cast("decimal(20,0)")).cast("long")


def retry_delay(attempt) -> Column:
    """Seconds before the next try; the last value holds on."""
    return F.element_at(F.array(*map(F.lit, RETRY_S)), F.least(F.lit(len(RETRY_S)), F.greatest(F.lit(1), _c(attempt))).cast("int"))


def output_pcr(slot, bitrate) -> Column:
    """Clock of a slot at a constant bit rate."""
    ticks = F.floor(_c(slot).cast("decimal(18,0)") * F.lit(1504 * 27_000_000).cast("decimal(12,0)") / _c(bitrate).cast("decimal(12,0)"))
    return F.pmod(ticks.cast("decimal(20,0)"), F.lit(PCR_WRAP).cast("decimal(20,0)")).cast("long")


#: Last three digits of a coded bit rate: no start buffer; the usual one;
#: the first and last of the two runs that count its steps.
NO_BUFFER, USUAL_BUFFER, BUFFER_RUNS, BUFFER_STEP_MS = (699, 799), 777, ((700, 729), (800, 829)), 500


def target_bitrate(coded) -> Column:
    """The bit rate in a coded one, and the start buffer in milliseconds: the last
    three digits 699 and 799 mean none, 700 to 729 and 800 to 829 steps of 500 ms."""
    v = _c(coded)
    rest = v % 1000
    none = (v >= 100_000 + NO_BUFFER[0]) & rest.isin(*NO_BUFFER)
    steps = (v >= 100_000 + BUFFER_RUNS[0][0]) & (rest.between(*BUFFER_RUNS[0]) | rest.between(*BUFFER_RUNS[1]))
    marked = none | steps | (v >= 100_000 + USUAL_BUFFER) & (rest == USUAL_BUFFER)
    wait = F.when(none, 0).when(steps, (rest % 100 + 1) * BUFFER_STEP_MS).otherwise(3000).cast("int")
    return F.struct(F.when(marked, v - rest).otherwise(v).alias("bitrate"), wait.alias("buffer_ms"))


def network_source(uri) -> Column:
    """Addresses of live network inputs."""
    return F.lower(_c(uri)).rlike("^(udp|rtp|srt|rtsp|rtmp|https?)://")


def orbital_position(code, east) -> Column:
    """Degrees and tenths of a BCD position, with E or W."""
    c = _c(code)
    tenths = sum((F.shiftright(c, 4 * k).bitwiseAND(F.lit(15)) * 10**k for k in range(4)), F.lit(0))
    return F.concat(F.format_string("%d.%d", F.floor(tenths / 10).cast("int"), (tenths % 10).cast("int")), F.when(_c(east), "E").otherwise("W"))


def segment_settings(seconds, count, cmaf) -> Column:
    """Seconds and number of segments; zero picks them by the kind."""
    auto_s, auto_n = F.when(_c(cmaf), 2).otherwise(4), F.when(_c(cmaf), 6).otherwise(8)
    clamp = lambda v, a, b: F.least(F.lit(b), F.greatest(F.lit(a), v))
    return F.struct(F.when(_c(seconds) == 0, auto_s).otherwise(clamp(_c(seconds), 1, 10)).alias("seconds"), F.when(_c(count) == 0, auto_n).otherwise(clamp(_c(count), 3, 30)).alias("count"))


def back_off_ms(failures) -> Column:
    """One second doubled with each failure, 30 s at most."""
    return F.least(F.lit(30_000), F.lit(1000) * F.pow(F.lit(2), F.least(F.lit(5), _c(failures))).cast("int"))


def jitter_ms(name) -> Column:
    """What a retry waits beside, the same for a name each time."""
    return (fnv1a32(name) % JITTER_STEPS * JITTER_MS).cast("int")


def signal_percent(raw) -> Column:
    """Share of a 16-bit reading, in whole percent."""
    return F.least(F.lit(100), F.greatest(F.lit(0), F.round(_c(raw) * 100 / 65535).cast("int")))


def signal_percent_db(level_db, cnr_db) -> Column:
    """Strength and quality from decibels; quality falls back to strength."""
    clamp = lambda v: F.least(F.lit(100), F.greatest(F.lit(0), F.round(v).cast("int")))
    strength = clamp(_c(level_db) + 100)
    return F.struct(strength.alias("strength"), F.when(_c(cnr_db).isNull(), strength).otherwise(clamp(_c(cnr_db) * 100 / 18)).alias("quality"), _c(cnr_db).isNull().alias("estimated"))


def without_credentials(uri) -> Column:
    """An address without user, password and query."""
    return F.regexp_replace(F.regexp_replace(_c(uri), r"^([a-zA-Z][a-zA-Z0-9+.-]*://)[^/@?#]*@", "$1"), r"[?#].*$", "")
