"""Stream lists of other servers, as JSON documents and as blocks of text.

Both become rows ``(name, input_uri, backup_input_uri, input_mode, outputs, warnings)``;
none of them starts by itself. A document is one row to Spark, its streams are exploded;
blocks of text are found by windows over the lines of a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.folds import unique_ids

#: Schemes that stay, and those that are written in another way.
KEPT = ("udp", "rtp", "http", "https", "srt", "rtsp", "rtmp", "file")
RENAMED = {"tshttp": ("http", None), "tshttps": ("https", None), "hls": ("http", "hls"), "hlss": ("https", "hls")}
#: What an import says about what it leaves out.
BAD_INPUT, MORE_INPUTS, BAD_OUTPUT, NO_INPUT = "Unsupported input skipped", "Only the first two inputs can migrate", "Output skipped (unsupported or invalid target)", "Stream without supported input skipped"
OUTPUT = r"(?i)^(udp|rtp)://(?:([0-9]{1,3}(?:\.[0-9]{1,3}){3})@)?([^@/?\s]+):([0-9]{1,5})(?:[/?\s].*)?$"


def unquoted(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), r"""^(["'])(.*)\1$""", "$2")


def source_url(text: Column) -> Column:
    """Struct of an input's address, as it is here, and its mode; null if it is none."""
    value = F.regexp_extract(unquoted(text), r"^(\S*)", 1)
    scheme = F.lower(F.regexp_extract(value, "^([A-Za-z0-9]+)://", 1))
    rest = F.regexp_extract(value, "^[A-Za-z0-9]+://(.*)$", 1)
    out = F.when(scheme.isin(*KEPT), F.struct(value.alias("uri"), F.lit("auto").alias("mode")))
    for name, (plain, mode) in RENAMED.items():
        out = out.when(scheme == name, F.struct(F.concat(F.lit(plain + "://"), rest).alias("uri"), F.lit(mode or "auto").alias("mode")))
    return out


def target(text: Column) -> Column:
    """Struct of an output over UDP or RTP; null if it is none."""
    value = unquoted(text)
    part = lambda k: F.regexp_extract(value, OUTPUT, k)
    address = F.coalesce(F.aggregate(F.split(part(2), r"\."), F.lit(True), lambda ok, x: ok & ((x == "") | (x.try_cast("int") <= 255))), F.lit(True))
    ok = value.rlike(OUTPUT) & part(4).try_cast("int").between(1, 65_535) & address
    return F.when(ok, F.struct(F.when(F.lower(part(1)) == "rtp", "rtp").otherwise("udp-vbr").alias("type"), part(3).alias("host"), part(4).cast("int").alias("port"), part(2).alias("interface")))


def imported(rows: DataFrame) -> DataFrame:
    """Streams of ``rows(name, inputs array<string>, targets array<string>)``. One without a
    usable input keeps its name and its warnings, and no address."""
    rows = rows.withColumns({"_in": F.array_compact(F.transform("inputs", source_url)), "_out": F.array_compact(F.transform("targets", target))})
    first, second = F.get("_in", F.lit(0)), F.get("_in", F.lit(1))
    warned = F.array_compact(F.array(
        F.when(F.size("_in") < F.size("inputs"), BAD_INPUT), F.when(F.size("_in") > 2, MORE_INPUTS),
        F.when(F.size("_in") == 0, NO_INPUT), F.when(F.size("_out") < F.size("targets"), BAD_OUTPUT)))
    return rows.select("name", first["uri"].alias("input_uri"), second["uri"].alias("backup_input_uri"), first["mode"].alias("input_mode"), F.col("_out").alias("outputs"), warned.alias("warnings"))


def read_json_streams(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Documents with an array ``make_stream`` of ``type, name, input, output``; an
    address is a string or an object with ``url``. Only single programs are taken."""
    docs = spark.read.schema("make_stream array<struct<type: string, name: string, input: array<string>, output: array<string>>>").option("multiLine", multiline).json(path)
    address = lambda x: F.when(x.startswith("{"), F.get_json_object(x, "$.url")).otherwise(x)
    rows = docs.select(F.explode("make_stream").alias("s")).select("s.*").where((F.lower(F.coalesce("type", F.lit("spts"))) == "spts") & (F.coalesce("name", F.lit("")) != ""))
    lists = {c: F.transform(F.coalesce(v, F.array().cast("array<string>")), lambda x: F.coalesce(address(x), F.lit(""))) for c, v in (("inputs", F.col("input")), ("targets", F.col("output")))}
    return imported(rows.select("name", *[v.alias(k) for k, v in lists.items()]))


def read_text_streams(spark: SparkSession, path: str) -> DataFrame:
    """Files with blocks ``stream name { input address; push address; }``. Comments,
    other blocks, nested ones and other directives are left out."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))
    lines = lines.where(~F.trim("line").rlike("^(#|//)"))
    # each brace, directive and opener by itself
    token = r"""(?:"[^"]*"|'[^']*'|[^{};"'])+|[{};]"""
    tokens = lines.select("file", "line_no", F.posexplode(F.regexp_extract_all("line", F.lit(f"({token})"), F.lit(1))).alias("k", "token"))
    own = W.partitionBy("file").orderBy("line_no", "k")
    step = F.when(F.col("token") == "{", 1).when(F.col("token") == "}", -1).otherwise(0)
    tokens = tokens.withColumn("depth", F.sum(step).over(own.rowsBetween(W.unboundedPreceding, -1))).withColumn("depth", F.coalesce("depth", F.lit(0)))
    opens = (F.col("depth") == 0) & (F.col("token") == "{")
    tokens = tokens.withColumns({"block": F.sum(opens.cast("int")).over(own), "next": F.lead("token").over(own)})
    opener = (F.col("depth") == 0) & F.col("token").rlike(r"^\s*stream\s+[A-Za-z0-9_.-]+\s*$") & (F.col("next") == "{")
    names = tokens.where(opener).select("file", (F.col("block") + 1).alias("block"), F.regexp_extract("token", r"stream\s+(\S+)", 1).alias("name"))
    said = tokens.where("depth = 1 and token not in ('{', '}', ';')").select("file", "block", F.struct("line_no", "k").alias("at"), F.lower(F.regexp_extract("token", r"^\s*(\S+)\s", 1)).alias("key"), F.regexp_extract("token", r"^\s*\S+\s+(.*)$", 1).alias("value"))
    listed = lambda key: F.transform(F.array_sort(F.collect_list(F.when(F.col("key") == key, F.struct("at", "value")))), lambda x: x["value"])
    rows = names.join(said, ["file", "block"], "left").groupBy("file", "block", "name").agg(listed("input").alias("inputs"), listed("push").alias("targets"))
    return imported(rows.select("name", "inputs", "targets"))


def _usable(streams: DataFrame) -> DataFrame:
    return streams.where((F.coalesce("input_uri", F.lit("")) != "") & (F.coalesce("name", F.lit("")) != ""))


def _addresses(column: str = "outputs") -> Column:
    fits = F.filter(column, lambda o: o["type"].isin("udp-vbr", "udp-cbr", "rtp") & (o["host"] != "") & o["port"].between(1, 65_535))
    return F.transform(fits, lambda o: F.concat(F.when(o["type"] == "rtp", "rtp://").otherwise("udp://"), o["host"], F.lit(":"), o["port"].cast("string")))


def json_streams(streams: DataFrame) -> DataFrame:
    """One JSON document of ``streams(id, name, auto_start, input_uri,
    backup_input_uri, outputs)``, in order of their ids. A document is one row."""
    item = F.struct(F.col("id"), F.col("name"), F.lit("spts").alias("type"), F.col("auto_start").alias("enable"), F.array_compact(F.array("input_uri", "backup_input_uri")).alias("input"), _addresses().alias("output"))
    return _usable(streams).agg(F.to_json(F.struct(F.array_sort(F.collect_list(item)).alias("make_stream"))).alias("document"))


def text_streams(streams: DataFrame) -> DataFrame:
    """The block of each stream as ``(ord, block)``; names are made plain and no two
    alike. An address that could end its directive is left out."""
    rows = _usable(streams).withColumn("_n", F.regexp_replace("name", "[^A-Za-z0-9_.-]", "_"))
    named = unique_ids(rows.select(F.col("_n").alias("id"), F.col("ord").cast("long").alias("ord"), F.lit(False).alias("known")))
    rows = rows.withColumn("ord", F.col("ord").cast("long")).join(named, "ord")
    hls = (F.col("input_mode") == "hls") | F.col("input_uri").contains(".m3u8")

    def line(uri: str) -> Column:
        secure, plain = F.lower(uri).startswith("https://"), F.lower(uri).startswith("http://")
        told = F.when(plain, F.concat(F.when(hls, "hls://").otherwise("tshttp://"), F.substring(F.col(uri), F.lit(8), F.lit(9000)))).when(secure, F.concat(F.when(hls, "hlss://").otherwise("tshttps://"), F.substring(F.col(uri), F.lit(9), F.lit(9000)))).otherwise(F.col(uri))
        return F.when(~F.col(uri).rlike(r"[;{}\r\n]") & (F.col(uri) != ""), F.concat(F.lit("  input "), told, F.lit(";\n"))).otherwise("")

    pushes = F.array_join(F.transform(_addresses(), lambda a: F.concat(F.lit("  push "), a, F.lit(";\n"))), "")
    return rows.select("ord", F.concat(F.lit("stream "), F.col("new_id"), F.lit(" {\n"), line("input_uri"), F.coalesce(line("backup_input_uri"), F.lit("")), pushes, F.lit("}\n")).alias("block"))
