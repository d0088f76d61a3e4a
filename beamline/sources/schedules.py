"""K4: guide tables made from guide rows, with versions that follow their content.

A refresh of a service is a snapshot of its guide. Its sections are column expressions;
only the checksum goes through Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .sections import with_crc

#: What a refresh takes in (seconds before and behind it, events), the longest
#: event and the last second that the tables can tell, and the bytes of a title and a text.
BEFORE_S, BEHIND_S, MOST_EVENTS, LONGEST_S, LATEST = 6 * 3600, 7 * 86_400, 768, 359_999, 4_102_444_799
TITLE_BYTES, TEXT_BYTES = 80, 140
#: Tables of present and following events and first ones of a schedule, of
#: the own transport stream and of another one.
TABLES = {False: (0x4E, 0x50), True: (0x4F, 0x60)}
KEY = ["stream_id", "sid", "at"]


def text_field(column: str, most: int) -> Column:
    """Bytes of a text: ASCII as it is, else UTF-8 behind its selector; cut where a
    character ends."""
    text = F.coalesce(F.col(column), F.lit(""))
    plain = text.rlike("^[\\x20-\\x7E]*\\z")
    room = F.decode(F.substring(F.encode(text, "UTF-8"), 1, most - 1), "ISO-8859-1")
    whole = F.regexp_replace(room, "([\\xC0-\\xDF]|[\\xE0-\\xEF][\\x80-\\xBF]?|[\\xF0-\\xF7][\\x80-\\xBF]{0,2})\\z", "")
    return F.when(plain, F.substring(F.encode(text, "UTF-8"), 1, most)).otherwise(F.concat(F.lit(b"\x15"), F.encode(whole, "ISO-8859-1")))


def numbers(*parts: tuple[Column, int]) -> Column:
    """Bytes of numbers, each given with its number of hexadecimal digits."""
    return F.unhex(F.format_string("".join(f"%0{n}X" for _, n in parts), *(F.lit(v).cast("long") for v, _ in parts)))


def clock_digits(seconds: Column) -> Column:
    """Hours, minutes and seconds, a decimal digit in four bits."""
    return F.unhex(F.format_string("%02d%02d%02d", F.floor(seconds / 3600), F.floor(seconds / 60) % 60, seconds % 60))


def event_bytes(running: Column) -> Column:
    size = F.octet_length("short")
    return F.concat(numbers((F.col("event_id"), 4), (F.floor(F.col("start") / 86_400) + 40_587, 4)), clock_digits(F.col("start") % 86_400),
                    clock_digits(F.col("stop") - F.col("start")), numbers((running * 8192 + size, 4)), F.col("short"))


def snapshots(refreshes: DataFrame, events: DataFrame, most: int = MOST_EVENTS) -> DataFrame:
    """Events of each refresh, numbered by start (``i`` of ``n``), with the ``version``.

    ``refreshes(stream_id, sid, at, ts_id, network)``, ``events(stream_id, sid, at, ord,
    event_id, start, stop, title, text)`` as a refresh finds them, in order of ``ord``.
    Events that begin more than 6 hours before it or 7 days behind it, without a length or
    a title, or beyond the first ``most`` are left out. An event without a number gets one from
    its start. The version is one up where starts, stops or texts are not those of the
    service's refresh before (the first one has 1). A refresh without events is one row
    without an event."""
    rows = events.where((F.col("start") >= F.col("at") - BEFORE_S) & (F.col("start") <= F.col("at") + BEHIND_S) & (F.col("stop") > F.col("start")) & (F.col("title") != ""))
    rows = rows.withColumn("_k", F.row_number().over(W.partitionBy(*KEY).orderBy("ord"))).where(F.col("_k") <= most)
    title, text = F.col("_title"), F.col("_text")
    rows = rows.withColumns({"_title": text_field("title", TITLE_BYTES), "_text": text_field("text", TEXT_BYTES)})
    size = lambda c: F.octet_length(c)
    rows = rows.withColumn("short", F.concat(numbers((F.lit(0x4D), 2), (size(title) + size(text) + 5, 2)), F.lit(b"und"), numbers((size(title), 2)), title, numbers((size(text), 2)), text))
    made = F.floor(F.col("start") / 60).bitwiseXOR(F.shiftright("start", 16)).bitwiseAND(F.lit(0xFFFF))
    number = F.coalesce(F.col("event_id").cast("long").bitwiseAND(F.lit(0xFFFF)), F.lit(0))
    rows = rows.select(*KEY, "_k", F.when(number == 0, made).otherwise(number).alias("event_id"), "start", "stop", "short", numbers((F.col("start"), 16), (F.col("stop"), 16)).alias("_times"))
    content = rows.withColumn("_all", F.concat("_times", "short")).groupBy(*KEY).agg(F.sha2(F.expr("listagg(_all) within group (order by _k)"), 256).alias("content"), F.count("*").alias("n"))
    own = W.partitionBy("stream_id", "sid").orderBy("at")
    known = refreshes.join(content, KEY, "left").withColumn("content", F.coalesce("content", F.lit("")))
    known = known.withColumn("_new", F.coalesce(F.col("content") != F.lag("content").over(own), F.lit(True)).cast("long"))
    known = known.withColumn("version", F.sum("_new").over(own) % 32).drop("_new", "content")
    order = W.partitionBy(*KEY).orderBy("start", "_k")
    return known.join(rows.drop("_times"), KEY, "left").withColumn("i", F.row_number().over(order) - 1).drop("_k")


def guide_sections(refreshes: DataFrame, events: DataFrame, other: bool = False, most: int = MOST_EVENTS) -> DataFrame:
    """``(stream_id, sid, at, ord, table_id, number, version, section)`` of each refresh,
    see ``snapshots``; ``other`` for services of another transport stream.

    The present event is in section 0 of the first table and the following one in section
    1; an absent one leaves its section empty, and both are left out without either. The
    schedule has an event a section, 256 sections a table and segments of eight sections;
    an event of 100 hours or more has none."""
    now, first = TABLES[other]
    rows = snapshots(refreshes, events, most).withColumn("fits", F.coalesce((F.col("stop") - F.col("start") <= LONGEST_S) & F.col("start").between(0, LATEST), F.lit(False)))
    last = F.least(F.lit(255), F.col("n") - F.floor(F.col("i") / 256) * 256 - 1)
    number = F.col("i") % 256
    schedule = rows.where("fits").select(
        *KEY, "ts_id", "network", "version", (F.col("i") + 2).alias("ord"), (first + F.floor(F.col("i") / 256)).alias("table_id"), number.alias("number"), last.alias("last"),
        F.least(last, number.bitwiseOR(F.lit(7))).alias("segment_last"), (first + F.floor((F.col("n") - 1) / 256)).alias("last_table"), event_bytes(F.lit(1)).alias("body"))
    at, start = F.col("at"), F.col("start")
    present, following = (start <= at) & (at < F.col("stop")), start > at
    pick = lambda test, running: F.min_by(F.when(F.col("fits"), event_bytes(F.lit(running))).otherwise(F.lit(b"")), F.when(test, F.col("i")))
    pair = rows.where("n > 0").groupBy(*KEY, "ts_id", "network", "version").agg(pick(present, 4).alias("p"), pick(following, 1).alias("f")).where("p is not null or f is not null")
    pair = pair.select(*KEY, "ts_id", "network", "version", F.posexplode(F.array("p", "f")).alias("number", "body"))
    pair = pair.select(*KEY, "ts_id", "network", "version", F.col("number").cast("long").alias("ord"), F.lit(now).alias("table_id"), "number", F.lit(1).alias("last"), F.lit(1).alias("segment_last"), F.lit(now).alias("last_table"), F.coalesce("body", F.lit(b"")).alias("body"))
    rows = pair.unionByName(schedule)
    head = numbers((F.col("table_id"), 2), (0xF000 + F.octet_length("body") + 15, 4), (F.col("sid"), 4), (F.col("version") * 2 + 0xC1, 2), (F.col("number"), 2), (F.col("last"), 2),
                   (F.col("ts_id"), 4), (F.col("network"), 4), (F.col("segment_last"), 2), (F.col("last_table"), 2))
    return rows.select(*KEY, "ord", F.col("table_id").cast("int").alias("table_id"), F.col("number").cast("int").alias("number"), F.col("version").cast("int").alias("version"), with_crc(F.concat(head, F.col("body"))).alias("section"))
