"""Operations logs: records, per-service reports, coincidences, latencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Fields that name a record's service, and those of its delays.
SERVICE, DELAYS = ("stream", "sid"), ("prequeue_ms", "queue_ms", "upstream_ms")


def records(lines: DataFrame, marker: str = "monitor") -> DataFrame:
    """``(line_no, at_s, stream, sid, values array<struct<key, value>>)`` of the
    lines that begin with a time, bear the marker and name a stream and a sid.

    A line is split into words once; behind the marker, words of a plain name, an equals
    sign and something are its fields. Values other than whole numbers are left out; of
    equal names that of a service is the last one. What is split is generated as a row, so
    that the conditions on it do not split the line again."""
    rows = lines.select("line_no", F.explode(F.array(F.split(F.trim("line"), r"\s+"))).alias("_w"))
    at = F.greatest(F.array_position("_w", marker), F.array_position("_w", f"{marker}:"))
    named = F.filter(F.slice("_w", at.cast("int") + 1, F.size("_w")), lambda w: w.rlike("^[a-z][a-z0-9_]*=."))
    pair = lambda w: F.struct(F.substring_index(w, "=", 1).alias("key"), F.substring(w, F.length(F.substring_index(w, "=", 1)) + 2, F.length(w)).alias("text"))
    rows = rows.where(at > 1).select("line_no", F.col("_w")[0].alias("_t"), F.explode(F.array(F.transform(named, pair))).alias("_p"))
    last = lambda name: F.try_element_at(F.filter("_p", lambda p: p["key"] == name), F.lit(-1))["text"]
    rows = rows.withColumns({"_at": F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', try_cast(_t as timestamp_ntz))"), **{name: last(name) for name in SERVICE}})
    numbers = F.filter("_p", lambda p: ~p["key"].isin(*SERVICE) & p["text"].rlike(r"^[+-]?[0-9]{1,18}$"))
    found = rows.where("_at is not null and stream is not null and sid is not null")
    return found.select("line_no", F.col("_at").alias("at_s"), *SERVICE, F.transform(numbers, lambda p: F.struct(p["key"].alias("key"), p["text"].cast("long").alias("value"))).alias("values"))


def service_report(found: DataFrame, peaks: tuple[str, ...] = ("peak",)) -> DataFrame:
    """A10: sums of all values by service; of peaks the greatest."""
    rows = found.select("sid", "stream", F.explode("values").alias("v")).select("sid", "stream", "v.*")
    return rows.groupBy("sid", "stream", "key").agg(F.when(F.max(F.col("key").isin(*peaks).cast("int")) == 1, F.max("value")).otherwise(F.sum("value")).alias("value"))


def coincidences(found: DataFrame, keys: tuple[str, ...] = ("gaps",), seconds: int = 2, most: int | None = None) -> DataFrame:
    """Intervals in which more than one service has anomalies (``most``: a
    report of the first ones only, O7)."""
    rows = found.select("sid", "stream", "at_s", F.explode("values").alias("v")).where(F.col("v.key").isin(*keys) & (F.col("v.value") > 0))
    out = rows.groupBy(F.expr(f"at_s div {seconds} * {seconds}").alias("slot_s")).agg(F.countDistinct("sid", "stream").alias("services"), F.sum("v.value").alias("anomalies")).where("services > 1")
    return out if most is None else out.orderBy("slot_s").limit(most)


def nearest_rank(column: str, percent: int):
    """The value at rank ceil(n * percent / 100)."""
    return F.expr(f"cast(percentile_disc({percent / 100}) within group (order by {column}) as bigint)")


def latency_report(lines: DataFrame, marker: str = "LATENCY") -> DataFrame:
    """By service the lines of each stage, late and failed ones, and percentiles.

    Of sent requests only those that went out have delays; only whole numbers count."""
    body = F.regexp_extract("line", rf"{marker} (.*)$", 1)
    value = lambda name: F.regexp_extract(body, rf"(?:^|\s){name}=([^\s]+)", 1)
    number = lambda name: F.when(value(name).rlike("^[0-9]{1,18}$"), value(name).cast("long"))
    rows = lines.where(F.col("line").contains(f"{marker} ")).select(F.upper(value("sid")).alias("sid"), value("stage").alias("stage"), value("send").alias("send"), (value("late") == "1").alias("late"), *[number(name).alias(short) for name, short in zip(DELAYS, ("pre", "q", "up"))])
    rows = rows.where(F.col("sid").rlike("^[0-9A-F]{4}$"))
    sent, reply = F.col("stage") == "upstream_sent", F.col("stage") == "upstream_reply"
    ok = sent & (F.col("send") == "ok")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    rows = rows.withColumns({"pre": F.when(ok, F.col("pre")), "q": F.when(ok, F.col("q")), "up": F.when(reply, F.col("up"))})
    return rows.groupBy("sid").agg(
        n(F.col("stage") == "ingress").alias("ingress"), n(sent).alias("sent"), n(reply).alias("replies"), n(F.col("stage") == "client_timeout").alias("timeouts"), n(reply & F.col("late")).alias("late"), n(sent & ~ok).alias("failed"),
        nearest_rank("pre", 95).alias("prequeue_p95"), nearest_rank("q", 95).alias("queue_p95"), nearest_rank("up", 50).alias("upstream_p50"), nearest_rank("up", 95).alias("upstream_p95"),
    )


def summaries(lines: DataFrame) -> DataFrame:
    """Summary lines of the strict form, of 1 to 86,400 seconds."""
    form = r"^summary seconds=([0-9]{1,5}) ok=([0-9]+) failed=([0-9]+) avg_ms=([0-9]+)$"
    rows = lines.where(F.col("line").rlike(form)).select("line_no", *[F.regexp_extract("line", form, k + 1).cast("long").alias(c) for k, c in enumerate(("seconds", "ok", "failed", "avg_ms"))])
    return rows.where(F.col("seconds").between(1, 86_400))
