"""Segment playlists: parsing, live windows, archive ranges, rendition choice."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scans import Last, Most, Scan, Total

#: Lines of a list, and segments of one, that are one range.
LINES, LISTED = 250_000, 250_000
#: Addresses, and the tags that a parsed list knows.
SAYING = "^(?:[^#]|#EXTINF:|#EXT-X-(?:TARGETDURATION:|STREAM-INF:|MEDIA-SEQUENCE:|KEY:|MAP:|DISCONTINUITY$|ENDLIST$))"
#: Seconds of a segment where a list names none, and the least that it may name.
TARGET_S, LEAST_TARGET_S = 2.0, 0.25


def attribute(line: Column, name: str) -> Column:
    """Value of a tag's attribute, without its quotes; empty if it is not there."""
    form = f'{name}=(?:"([^"]*)|([^",][^,]*)?)'
    return F.concat(F.regexp_extract(line, form, 1), F.trim(F.regexp_extract(line, form, 2)))


def resolved(base: Column, reference: Column) -> Column:
    """An address as seen from that of its list."""
    origin, folder = F.regexp_extract(base, "(?s)^(.*?://[^/]*)", 1), F.regexp_extract(base, "(?s)^(.*?://[^?#]*/)", 1)
    return (
        F.when(reference == "", base).when(F.lower(reference).rlike("^https?://") | ~base.contains("://"), reference)
        .when(reference.startswith("/"), F.concat(origin, reference)).when(folder == "", F.concat(origin, F.lit("/"), reference)).otherwise(F.concat(folder, reference))
    )


def _leading_number(text: Column) -> Column:
    return F.regexp_extract(text, r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)", 1).try_cast("double")


def parsed(lines: DataFrame, span: int = LINES) -> DataFrame:
    """The segments of media playlists. ``lines(playlist, line_no, line)``, with
    ``base``, the list's own address, where addresses are relative.

    An address is a segment if an EXTINF stands between it and the address before, and
    its duration is not negative: one that does not parse counts as the target duration
    so far, and so does zero. A discontinuity holds until the next segment; KEY and MAP
    hold until they are replaced, and METHOD=NONE or none clears the key; the sequence
    counts segments from the last MEDIA-SEQUENCE on. Gives ``playlist, sequence, uri,
    duration, discontinuity, key_method, key_uri, key_iv, map_uri, end_list``; the
    addresses of a master list are no segments. A list is cut into ranges of ``span`` lines,
    so one of any length is many tasks."""
    base = F.col("base") if "base" in lines.columns else F.lit("")
    line, tag = F.col("line"), lambda name: F.col("line").startswith(name)
    value = lambda name: F.when(tag(name), F.expr(f"substring(line, {len(name) + 1})"))
    named, kind = _leading_number(value("#EXT-X-TARGETDURATION:")), F.when(tag("#EXT-X-KEY:"), F.lower(attribute(line, "METHOD")))
    key = F.when(kind.isin("", "none"), F.struct(*(F.lit(None).cast("string").alias(c) for c in ("method", "uri", "iv"))))
    key = key.when(kind.isin("aes-128", "sample-aes"), F.struct(kind.alias("method"), resolved(base, attribute(line, "URI")).alias("uri"), attribute(line, "IV").alias("iv")))
    key = key.when(kind.isNotNull(), F.struct(kind.alias("method"), F.concat(F.lit("unsupported:"), kind).alias("uri"), F.lit("").alias("iv")))
    first = F.coalesce(F.regexp_extract(value("#EXT-X-MEDIA-SEQUENCE:"), r"^\s*\+?([0-9]+)", 1).try_cast("long"), F.lit(0))
    seconds = _leading_number(F.split(value("#EXTINF:"), ",")[0])
    # what a line says; lines that say nothing are left out, and no text but the addresses is moved
    said = {
        "_uri": F.when(~tag("#"), resolved(base, line)), "_goal": F.when(named.isNotNull(), F.greatest(F.lit(LEAST_TARGET_S), named)), "_stream": F.when(tag("#EXT-X-STREAM-INF:"), True),
        "_info": F.when(tag("#EXTINF:"), F.struct(F.lit(True).alias("there"), seconds.alias("s"))).when(~tag("#"), F.struct(F.lit(False).alias("there"), F.lit(None).cast("double").alias("s"))),
        "_cut": F.when(line == "#EXT-X-DISCONTINUITY", True), "_first": F.when(tag("#EXT-X-MEDIA-SEQUENCE:"), first), "_key_tag": key,
        "_map_tag": F.when(tag("#EXT-X-MAP:"), resolved(base, attribute(line, "URI"))), "_end": F.when(line == "#EXT-X-ENDLIST", True),
    }
    rows = lines.withColumn("line", F.trim("line")).where(F.col("line").rlike(SAYING)).select("playlist", "line_no", *(c.alias(n) for n, c in said.items()))
    rows = Scan(rows, ["playlist"], ["line_no"], span).add(_target=Last(F.col("_goal"), here=True), _master=Last(F.col("_stream"), here=True), _before=Last(F.col("_info")))
    goal, length = F.coalesce("_target", F.lit(TARGET_S)), F.col("_before.s")
    # an EXTINF that does not parse has a target duration, which is above zero
    segment = F.coalesce(F.col("_uri").isNotNull() & F.col("_master").isNull() & F.col("_before.there") & F.coalesce(length >= 0, F.lit(True)), F.lit(False))
    rows = rows.add(_n=Total(segment.cast("long")), _broken=Last(F.when(segment, False).otherwise(F.col("_cut"))), _assumed=Last(F.when(F.col("_info.there"), goal)))
    rows = rows.add(_from=Last(F.when(F.col("_first").isNotNull(), F.struct(F.col("_first").alias("at"), F.col("_n").alias("n")))), _key_now=Last(F.col("_key_tag")), _map=Last(F.col("_map_tag")), end_list=Most(F.col("_end"))).done()
    return rows.where(segment).select(
        "playlist", (F.coalesce("_from.at", F.lit(0)) + F.col("_n") - 1 - F.coalesce("_from.n", F.lit(0))).alias("sequence"), F.col("_uri").alias("uri"),
        F.when(length > 0, length).when(length.isNull(), F.col("_assumed")).otherwise(goal).alias("duration"), F.coalesce("_broken", F.lit(False)).alias("discontinuity"),
        F.col("_key_now.method").alias("key_method"), F.col("_key_now.uri").alias("key_uri"), F.col("_key_now.iv").alias("key_iv"), F.col("_map").alias("map_uri"), F.col("end_list").isNotNull().alias("end_list"))


def variants(lines: DataFrame) -> DataFrame:
    """The renditions of master playlists."""
    own = W.partitionBy("playlist").orderBy("line_no")
    rows = lines.withColumn("_info", F.lag("line").over(own)).where(F.col("_info").startswith("#EXT-X-STREAM-INF:") & ~F.col("line").startswith("#"))
    return rows.select("playlist", "line_no", F.regexp_extract("_info", r"[:,]BANDWIDTH=([0-9]+)", 1).try_cast("long").alias("bandwidth"), F.regexp_extract("_info", r"RESOLUTION=([0-9]+x[0-9]+)", 1).alias("resolution"), F.col("line").alias("uri"))


def chosen(found: DataFrame, target_bps: int) -> DataFrame:
    """The rendition with the highest bandwidth up to the target, else the lowest
    above; of equals the first."""
    row = F.struct("line_no", "bandwidth", "uri")
    fits = F.col("bandwidth") <= target_bps
    below = F.max_by(F.when(fits, row), F.when(fits, F.struct(F.col("bandwidth"), -F.col("line_no"))))
    above = F.min_by(row, F.struct("bandwidth", "line_no"))
    return found.groupBy("playlist").agg(F.coalesce(below, above).alias("_r")).select("playlist", "_r.*")


def start_sequence(segments: DataFrame, seconds: float = 6.0, most: int = 3, span: int = LISTED) -> DataFrame:
    """Where to start in a live list: from its end until ``seconds`` are gathered or
    ``most`` segments; the first segment of a list that has ended. Of each range of ``span``
    numbers the last ``most`` segments are looked at, and the first number."""
    part = W.partitionBy("playlist", F.floor(F.col("sequence") / span))
    rows = segments.withColumns({"_p": F.row_number().over(part.orderBy(F.desc("sequence"))), "_low": F.min("sequence").over(part), "_end": F.max("end_list").over(part)}).where(F.col("_p") <= most)
    own = W.partitionBy("playlist").orderBy(F.desc("sequence"))
    rows = rows.withColumn("_n", F.row_number().over(own)).withColumn("_sum", F.sum(F.when(F.col("_n") <= most, F.col("duration"))).over(own.rowsBetween(W.unboundedPreceding, 0)))
    enough = F.max(F.when((F.col("_n") <= most) & ((F.col("_sum") >= seconds) | (F.col("_n") >= most)), F.col("sequence")))
    return rows.groupBy("playlist").agg(F.when(F.max("_end"), F.min("_low")).otherwise(F.coalesce(enough, F.min("_low"))).alias("start"))


def live_window(segments: DataFrame, listed: int = 6) -> DataFrame:
    """Each segment's place (``listed``, ``grace``, ``gone``), counted from the end,
    and the discontinuities before the listed ones."""
    own = W.partitionBy("stream_id").orderBy(F.desc("sequence"))
    rows = segments.withColumn("_n", F.row_number().over(own))
    rows = rows.withColumn("place", F.when(F.col("_n") <= listed, "listed").when(F.col("_n") <= listed + max(3, listed), "grace").otherwise("gone"))
    return rows.withColumn("discontinuity_sequence", F.sum((F.col("discontinuity") & (F.col("place") != "listed")).cast("long")).over(W.partitionBy("stream_id"))).drop("_n")


def media_playlist(segments: DataFrame, listed: int = 6, target_s: int = 4, independent: bool = False, ended: bool = False) -> DataFrame:
    """K8: the text of each stream's live playlist; ``independent`` says that each segment
    can be begun with, ``ended`` that none follows."""
    live = live_window(segments, listed).where("place = 'listed'")
    entry = F.concat(
        F.when(F.col("discontinuity"), "#EXT-X-DISCONTINUITY\n").otherwise(""), F.lit("#EXT-X-PROGRAM-DATE-TIME:"), iso_time("wall_ts"),
        F.format_string("\n#EXTINF:%d.%03d,\n", F.floor(F.col("duration_ms") / 1000), F.col("duration_ms") % 1000), F.col("file"), F.lit("\n"),
    )
    entries = F.expr("array_join(transform(array_sort(_e), x -> x._t), '')")
    out = live.groupBy("stream_id").agg(F.collect_list(F.struct("sequence", entry.alias("_t"))).alias("_e"), F.min("sequence").alias("_q"), F.max("discontinuity_sequence").alias("_d"), F.greatest(F.lit(target_s), F.ceil(F.max("duration_ms") / 1000)).alias("_m"))
    alone, end = "#EXT-X-INDEPENDENT-SEGMENTS\n" if independent else "", "#EXT-X-ENDLIST\n" if ended else ""
    head = F.format_string(f"#EXTM3U\n#EXT-X-VERSION:3\n{alone}#EXT-X-TARGETDURATION:%d\n#EXT-X-MEDIA-SEQUENCE:%d\n#EXT-X-DISCONTINUITY-SEQUENCE:%d\n", "_m", "_q", "_d")
    return out.select("stream_id", F.concat(head, entries, F.lit(end)).alias("playlist"))


def iso_time(epoch: str) -> Column:
    day = F.date_from_unix_date(F.floor(F.col(epoch) / 86400).cast("int"))
    rest = F.pmod(F.col(epoch), F.lit(86400))
    return F.format_string("%sT%02d:%02d:%02dZ", F.date_format(day, "yyyy-MM-dd"), F.floor(rest / 3600), F.floor(rest / 60) % 60, rest % 60)


#: Names of range requests: how many numbers follow, whether the first one
#: counts back from now, and whether the range is open.
RANGES = {"archive": (2, False, False), "timeshift_abs": (1, False, True), "timeshift_rel": (1, True, True), "rewind": (1, True, True)}


def archive_range(request: str, now: int) -> tuple[int, int, bool] | None:
    """First second, last second and openness of a request's name; None if it is none."""
    name, *values = request.removesuffix(".m3u8").split("-")
    form = RANGES.get(name)
    if form is None or not request.endswith(".m3u8") or len(values) != form[0] or not all(re.fullmatch("[0-9]+", v) for v in values):
        return None
    _, from_now, is_open = form
    first = now - int(values[0]) if from_now else int(values[0])
    return first, now + 10 if is_open else first + int(values[1]), is_open


def archive(segments: DataFrame, request: str, now: int, hours: int, margin_s: int = 2) -> DataFrame:
    """The kept segments of a request's range with the seconds of each,
    taken from its neighbours and held within 1 and 6 (2 for one alone)."""
    found = archive_range(request, now)
    if found is None:
        return segments.where(F.lit(False)).withColumn("seconds", F.lit(0.0))
    first, last, _ = found
    rows = segments.where((F.col("wall_ts") >= now - hours * 3600) & F.col("wall_ts").between(first - margin_s, last + margin_s))
    own = W.partitionBy("stream_id").orderBy("wall_ts", "file")
    step = F.coalesce(F.lead("wall_ts").over(own) - F.col("wall_ts"), F.col("wall_ts") - F.lag("wall_ts").over(own))
    return rows.withColumn("seconds", F.when(step.isNull(), 2.0).otherwise(F.least(F.lit(6.0), F.greatest(F.lit(1.0), step.cast("double")))))


def archive_playlist(segments: DataFrame, request: str, now: int, hours: int) -> DataFrame:
    """K9: the text of each stream's playlist of a range: an open one is of type EVENT, a
    closed one of type VOD with an end."""
    found = archive_range(request, now)
    rows = archive(segments, request, now, hours)
    entry = F.concat(F.lit("#EXT-X-PROGRAM-DATE-TIME:"), iso_time("wall_ts"), F.format_string("\n#EXTINF:%.3f,\n", "seconds"), F.col("file"), F.lit("\n"))
    joined = F.expr("array_join(transform(array_sort(_e), x -> x._t), '')")
    kind, end = ("EVENT", "") if found and found[2] else ("VOD", "#EXT-X-ENDLIST\n")
    head = f"#EXTM3U\n#EXT-X-VERSION:3\n#EXT-X-TARGETDURATION:6\n#EXT-X-MEDIA-SEQUENCE:0\n#EXT-X-PLAYLIST-TYPE:{kind}\n"
    return rows.groupBy("stream_id").agg(F.collect_list(F.struct("wall_ts", "file", entry.alias("_t"))).alias("_e")).select("stream_id", F.concat(F.lit(head), joined, F.lit(end)).alias("playlist"))


def master_playlist(renditions: DataFrame) -> DataFrame:
    """The text of a master playlist by stream. ``renditions(stream_id, bandwidth,
    resolution, uri)``, highest first."""
    entry = F.format_string("#EXT-X-STREAM-INF:BANDWIDTH=%d,RESOLUTION=%s\n%s\n", "bandwidth", "resolution", "uri")
    joined = F.expr("array_join(transform(sort_array(_e, false), x -> x._t), '')")
    return renditions.groupBy("stream_id").agg(F.collect_list(F.struct("bandwidth", entry.alias("_t"))).alias("_e")).select("stream_id", F.concat(F.lit("#EXTM3U\n#EXT-X-VERSION:3\n"), joined).alias("playlist"))
