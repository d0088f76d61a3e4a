"""File sources and sinks: guides, histories, configuration, tables of history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.scalars import compact, without_credentials, xmltv_time

#: Places of a history row's fields in its JSON array.
HISTORY = ("ts", "active", "in_kbps", "out_kbps", "target_kbps", "in_cc", "out_cc", "in_cc_total", "out_cc_total", "status", "level", "message")
LOAD = "t long, cpu double, app_cpu double, ram double, app_ram double, app_ram_mb double, cores array<array<double>>, gpus array<struct<id string, usage double, vram double>>"
CONFIG = "id string, name string, uri string, enabled boolean, target_bitrate long, hls_archive_hours int, hls_segment_seconds int, tvg_id string"


def xmltv_programmes(spark: SparkSession, path: str) -> DataFrame:
    """Programmes of XMLTV files (also gzip), with their times in epoch seconds."""
    schema = "_channel string, _start string, _stop string, title string, desc string"
    rows = spark.read.format("xml").option("rowTag", "programme").schema(schema).load(path)
    return rows.select(F.col("_channel").alias("channel_id"), xmltv_time("_start").alias("start"), xmltv_time("_stop").alias("stop"), compact(F.coalesce("title", F.lit(""))).alias("title"), compact(F.coalesce("desc", F.lit(""))).alias("description")).where("start is not null")


def xmltv_channels(spark: SparkSession, path: str) -> DataFrame:
    """Channels of XMLTV files."""
    rows = spark.read.format("xml").option("rowTag", "channel").schema(StructType.fromDDL("_id string").add("display-name", "string")).load(path)
    return rows.select(F.col("_id").alias("channel_id"), compact(F.coalesce("display-name", F.lit(""))).alias("name"))


def quality_history(spark: SparkSession, path: str) -> DataFrame:
    """Rows of history files, one JSON array a line, at least twelve fields; others
    are left out. The files lie under ``stream_id=`` folders, so one stream reads one."""
    lines = spark.read.text(path)
    rows = lines.withColumn("_a", F.from_json("value", "array<string>")).where(F.size("_a") >= len(HISTORY))
    kinds = {"active": "boolean", "status": "string", "level": "string", "message": "string"}
    out = [F.expr(f"try_cast(_a[{k}] as {kinds.get(name, 'bigint')})").alias(name) for k, name in enumerate(HISTORY)]
    keep = [c for c in lines.columns if c != "value"]
    return rows.select(*keep, *out).where("ts is not null")


def write_quality_history(samples: DataFrame, path: str) -> None:
    """Samples as lines of their stream's folder, appended."""
    fields = [F.col(c).cast("string") for c in HISTORY]
    lines = samples.select("stream_id", F.to_json(F.array(*[F.coalesce(f, F.lit("")) for f in fields])).alias("value"))
    lines.repartition("stream_id").write.mode("append").partitionBy("stream_id").text(path)


def load_history(spark: SparkSession, path: str) -> DataFrame:
    """Load samples, one JSON object a line with a numeric ``t``."""
    return spark.read.schema(LOAD).json(path).where("t is not null")


def guide_cache(spark: SparkSession, path: str, most: int = 400_000, longest: int = 16_384) -> DataFrame:
    """Records of a guide cache, JSON lines (also gzip) after one of kind
    ``header``; a file whose header counts other records than it has is refused whole."""
    lines = spark.read.text(path).withColumn("file", F.input_file_name()).where(F.length("value") <= longest)
    rows = lines.withColumn("_r", F.from_json("value", "kind string, records long, service_id int, event_id int, start_utc long, duration_s int, title string, description string"))
    heads = rows.where("_r.kind = 'header'").groupBy("file").agg(F.max("_r.records").alias("_n"))
    counts = rows.where("_r.kind = 'event'").groupBy("file").agg(F.count("*").alias("_c"))
    good = heads.join(counts, "file").where(f"_n = _c and _n <= {most}").select("file")
    return rows.where("_r.kind = 'event'").join(good, "file", "left_semi").select("file", "_r.*").drop("kind", "records")


def configuration(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Streams of configuration documents, with defaults and limits; a document is
    a file or, without ``multiline``, a line. Fields that hold access data are not in
    the schema and so never leave the reader."""
    docs = spark.read.schema(f"streams array<struct<{CONFIG.replace(' string', ': string').replace(' boolean', ': boolean').replace(' long', ': bigint').replace(' int', ': int')}>>").option("multiLine", multiline).json(path)
    s = docs.select(F.explode("streams").alias("s")).select("s.*")
    clamp = lambda c, low, high, default: F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(c, F.lit(default)))).alias(c)
    return s.where("id is not null").select(
        "id", F.coalesce("name", "id").alias("name"), F.coalesce("uri", F.lit("")).alias("uri"), F.coalesce("enabled", F.lit(True)).alias("enabled"), clamp("target_bitrate", 0, 200_000_000, 0), clamp("hls_archive_hours", 0, 720, 24), clamp("hls_segment_seconds", 0, 10, 0), F.coalesce("tvg_id", F.lit("")).alias("tvg_id")
    )


def write_lines(lines: DataFrame, path: str, column: str = "line", compression: str = "none") -> None:
    """K1 to K3: the lines of a document in their order, as text or gzip. A document is
    one file, so this is for guides and playlists, not for packets."""
    lines.select(column).coalesce(1).write.mode("overwrite").option("compression", compression).text(path)


def write_guide(lines: DataFrame, path: str, compression: str = "none") -> None:
    """K1, K3: the lines of ``guide.xmltv`` as one document with its root element."""
    mark = lambda part, line: lines.sparkSession.createDataFrame([(part, line)], "part int, line string")
    whole = mark(-1, '<?xml version="1.0" encoding="UTF-8"?>\n<tv>').unionByName(lines).unionByName(mark(2, "</tv>"))
    write_lines(whole.orderBy("part", "line"), path, compression=compression)


def peer_channels(spark: SparkSession, path: str, most: int = 512, multiline: bool = True) -> DataFrame:
    """Channels of peer nodes' status documents (files, or lines without
    ``multiline``), at most ``most`` a node."""
    docs = spark.read.schema("node string, channels array<struct<id: string, name: string, tvg_id: string, live: boolean, viewers: bigint>>").option("multiLine", multiline).json(path)
    return docs.select("node", F.explode(F.slice("channels", 1, most)).alias("c")).select("node", "c.*")


#: What a shared configuration says was left out.
TUNER_NOTE, LOGIN_NOTE, QUERY_NOTE = ": check tuner, adapter and frontend on target", ": URL username/password omitted", ": URL query/fragment omitted; review before starting"


def shareable(streams: DataFrame, addresses: tuple[str, ...] = ("input_uri", "backup_input_uri"), kept: tuple[str, ...] = ("name", "outputs")) -> DataFrame:
    """Streams without what must not be shared, and ``warnings`` about it.

    Only ``kept`` and the addresses go on; an id is given anew where they are imported,
    and none of them starts by itself. Addresses lose user, password, query and fragment,
    but for those of tuners, whose options they need."""
    names = [c for c in kept if c in streams.columns]
    safe, notes = [], []
    for c in addresses:
        tuner = F.lower(c).startswith("dvb")
        safe.append(F.when(tuner, F.col(c)).otherwise(without_credentials(c)).alias(c))
        plain = F.regexp_replace(c, "[?#].*$", "")
        login = F.coalesce(~tuner & (without_credentials(c) != plain), F.lit(False))
        more = F.coalesce(~tuner & F.col(c).contains("://") & (plain != F.col(c)), F.lit(False))
        notes += [F.when(tuner, F.lit(c + TUNER_NOTE)), F.when(login, F.lit(c + LOGIN_NOTE)), F.when(more, F.lit(c + QUERY_NOTE))]
    return streams.select(F.lit("").alias("id"), F.lit(False).alias("auto_start"), *names, *safe, F.array_compact(F.array(*notes)).alias("warnings"))
