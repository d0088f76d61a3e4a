"""URL filtering with a sorted digest array.

The list (rules and blocked hosts, tables of any size) is cut into blocks, and a block
is one file: the XXH64 values of its strings in ascending order, the offsets of the
strings, what each says, and the strings. Each worker maps the file into memory, probes
it with one vectorised binary search for a whole batch of candidates and confirms a hit
by comparing the stored string, so a collision of digests never decides. The pages pass
the blocks one after the other and keep the longest rule so far.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: The rules of the query as (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Hosts that the method blocks, subdomains included, where no rule fits.
BLOCKED_HOSTS = (
    "ads-track.example.com", "ads-track.example.net", "ads-track.example.org",
    "casino-win.example.com", "casino-win.example.net", "casino-win.example.org",
    "cheap-pills.example.com", "cheap-pills.example.net", "cheap-pills.example.org",
    "free-bets.example.com", "free-bets.example.net", "free-bets.example.org",
    "spam-farm.example.com", "spam-farm.example.net", "spam-farm.example.org",
)
#: Entries of one block, which is sent to the executors as a file (about 20 MB).
BLOCK_ENTRIES = 1 << 18
#: What an entry of the array says.
LISTED, ALLOW, BLOCK = 0, 1, 2
ENTRIES = "text string, says int"


class DigestArray:
    """A sorted array of 64-bit digests in a file, read through a memory map."""

    MAGIC = b"BLDIGST2"

    def __init__(self, path: str):
        head = np.fromfile(path, "<u8", 2)
        if head.tobytes()[:8] != self.MAGIC:
            raise ValueError(f"{path} is no digest array")
        n = int(head[1])
        self.n = n
        if n:
            self.keys = np.memmap(path, "<u8", "r", 16, (n,))
            self.ends = np.memmap(path, "<u8", "r", 16 + 8 * n, (n + 1,))
            self.says = np.memmap(path, np.uint8, "r", 16 + 8 * (2 * n + 1), (n,))
            size = int(self.ends[n])
            self.text = np.memmap(path, np.uint8, "r", 16 + 8 * (2 * n + 1) + n, (size,)) if size else np.empty(0, np.uint8)

    @classmethod
    def bytes_of(cls, entries: dict[str, int]) -> bytes:
        """The file of strings and what they say."""
        raw = sorted((xxhash.xxh64_intdigest(b), b, v) for b, v in ((s.encode(), v) for s, v in entries.items()))
        ends = np.zeros(len(raw) + 1, "<u8")
        np.cumsum([len(b) for _, b, _ in raw], out=ends[1:])
        parts = [np.uint64(len(raw)).tobytes(), np.array([k for k, _, _ in raw], "<u8").tobytes(), ends.tobytes(), bytes(v for _, _, v in raw)]
        return cls.MAGIC + b"".join(parts) + b"".join(b for _, b, _ in raw)

    @classmethod
    def write(cls, path: str, strings: list[str]) -> None:
        with open(path, "wb") as f:
            f.write(cls.bytes_of(dict.fromkeys(strings, LISTED)))

    def place(self, strings: list[bytes]) -> np.ndarray:
        """Where each string is stored; -1 if it is not."""
        out = np.full(len(strings), -1)
        if not self.n or not strings:
            return out
        digest = np.fromiter(map(xxhash.xxh64_intdigest, strings), np.uint64, len(strings))
        lo, hi = np.searchsorted(self.keys, digest, "left"), np.searchsorted(self.keys, digest, "right")
        for i in np.nonzero(lo < hi)[0]:
            for k in range(lo[i], hi[i]):
                if self.text[int(self.ends[k]) : int(self.ends[k + 1])].tobytes() == strings[i]:
                    out[i] = k
        return out

    def find(self, strings: list[bytes]) -> np.ndarray:
        """Whether each string is stored."""
        return self.place(strings) >= 0


def suffixes(host: str) -> list[str]:
    """The host and its parent domains, longest first; none for the empty host."""
    parts = host.split(".")
    return [".".join(parts[i:]) for i in range(len(parts))] if host else []


def split_url(pages: DataFrame) -> DataFrame:
    """``host`` and ``path`` of ``url``; both empty for null or no ``://``."""
    host = F.regexp_extract("url", r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract("url", r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    host = F.translate(host, common.LOWER_FROM, common.LOWER_TO)
    return pages.withColumn("host", F.coalesce(host, F.lit(""))).withColumn("path", F.coalesce(path, F.lit("")))


def ship(spark: SparkSession, entries: dict[str, int]) -> str:
    """Send a digest array to every executor; returns the name of the file. It lies in the
    shared folder, from where each executor fetches it."""
    folder = common.scratch_dir(spark)
    name = f"digests-{uuid.uuid4().hex}.bin"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    stream = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(hadoop)
    stream.write(bytearray(DigestArray.bytes_of(entries)))
    stream.close()
    spark.sparkContext.addFile(f"{folder}/{name}")
    return name


def entries_of(spark: SparkSession, rules, blocked_hosts) -> DataFrame:
    """``(text, says)`` of both lists, each a sequence or a table; where equal rules
    differ, the one that blocks holds."""
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame([tuple(r) for r in rules], "verdict string, host string, path string")
    if not isinstance(blocked_hosts, DataFrame):
        blocked_hosts = spark.createDataFrame([(h,) for h in blocked_hosts], "host string")
    ruled = rules.select(F.concat(F.lit("rule:"), "host", "path").alias("text"), F.when(F.col("verdict") == "allow", ALLOW).otherwise(BLOCK).alias("says"))
    listed = blocked_hosts.select(F.concat(F.lit("host:"), "host").alias("text"), F.lit(LISTED).alias("says"))
    return common.cut(ruled.unionByName(listed).where("text is not null").groupBy("text").agg(F.max("says").cast("int").alias("says")))


def list_blocks(spark: SparkSession, rules, blocked_hosts, block_entries: int) -> Iterator:
    """The lengths of the rules' paths, and then the lists block by block. Short sequences
    are one block and need no job."""
    if not isinstance(rules, DataFrame) and not isinstance(blocked_hosts, DataFrame) and len(rules) + len(blocked_hosts) <= block_entries:
        block = {f"host:{h}": LISTED for h in blocked_hosts}
        for verdict, host, path in rules:
            key = f"rule:{host}{path}"
            block[key] = max(block.get(key, LISTED), ALLOW if verdict == "allow" else BLOCK)
        yield {len(path) for _, _, path in rules}
        yield block
        return
    entries = entries_of(spark, rules, blocked_hosts)
    lengths = entries.where("says > 0").select(F.length(F.regexp_extract("text", "^rule:[^/]*(.*)$", 1)).alias("n")).distinct()
    yield {r[0] for r in lengths.collect()}
    n = max(1, -(-entries.count() // block_entries))
    for k in range(n):
        mine = entries if n == 1 else entries.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k)
        yield {r["text"]: r["says"] for r in mine.collect()}


def url_filter(pages: DataFrame, rules=RULES, blocked_hosts=BLOCKED_HOSTS, block_entries: int = BLOCK_ENTRIES) -> DataFrame:
    """``pages`` with ``host, path, rule, verdict``.

    A rule fits its host and all subdomains if the path starts with the rule's
    path; of those that fit, the one with the longest host and path wins, of equally
    long ones that with the longer host, and of equal ones that differ in their verdict
    the one that blocks. Where none fits, the url is blocked if its host or a parent domain is in
    ``blocked_hosts``, else allowed; a null url, or one without ``://``, has no
    host and is allowed. The lists are sequences or tables (``rules(verdict, host,
    path)``, ``blocked_hosts(host)``) of any length: they are applied in blocks of about
    ``block_entries``, in one pass over the pages. The pages may be any number; a very
    long url is judged whole; repeated rows stay; input columns named like a result are
    replaced; an empty table gives no rows."""
    spark = pages.sparkSession
    lists = list_blocks(spark, rules, blocked_hosts, block_entries)
    lengths = sorted(next(lists), reverse=True)
    state = {"rule": "string", "_host": "long", "_says": "long", "_listed": "long"}
    pages = split_url(pages.drop("host", "path", "rule", "verdict", *state, *(f"{c}2" for c in state)))
    pages = pages.withColumns({c: F.lit(None).cast(t) for c, t in state.items()})
    for block in lists:
        name = ship(spark, block)

        def start(name=name):
            array = DigestArray(SparkFiles.get(name))

            def judge(hosts: list[str], paths: list[str], rule: list, wide: list, says: list, listed: list) -> list:
                probes, owner, rule_of = [], [], []  # a rule and the length of its host
                for i, (host, path) in enumerate(zip(hosts, paths)):
                    for s in suffixes(host):
                        probes.append(f"host:{s}")
                        owner.append(i)
                        rule_of.append(None)
                        for n in lengths:
                            if n <= len(path):
                                probes.append(f"rule:{s}{path[:n]}")
                                owner.append(i)
                                rule_of.append((s + path[:n], len(s)))
                at = array.place([p.encode() for p in probes])
                for k in np.flatnonzero(at >= 0):
                    i, found = owner[k], rule_of[k]
                    if found is None:
                        listed[i] = 1
                    elif rule[i] is None or (len(found[0]), found[1]) > (len(rule[i]), wide[i]):
                        (rule[i], wide[i]), says[i] = found, int(array.says[at[k]])
                return [rule, wide, says, listed]

            return judge

        passed = common.add_columns(pages, ("host", "path", *state), "rule2 string, _host2 long, _says2 long, _listed2 long", start)
        pages = passed.drop(*state).withColumnsRenamed({f"{c}2": c for c in state})
    blocked = F.when(F.col("rule").isNotNull(), F.col("_says") == BLOCK).otherwise(F.coalesce(F.col("_listed") == 1, F.lit(False)))
    return pages.withColumn("verdict", F.when(blocked, "block").otherwise("allow")).drop("_host", "_says", "_listed")


def op5_url_filter(spark, sf_dir: str) -> DataFrame:
    """Verdict on the url of every page."""
    return url_filter(common.table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


OP5_SQL = """
with u as (
  select page_id,
    case when url like '%://%' then translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else '' end as host,
    case when url like '%://%' then regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1) else '' end as path
  from pages),
rules(verdict, h, p) as (values ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
blocked as (select a || '.example.' || b as h from (values ('ads-track'), ('casino-win'), ('cheap-pills'), ('free-bets'), ('spam-farm')) x(a), (values ('com'), ('net'), ('org')) y(b))
select page_id, host, path,
  (select h || p from rules r where (u.host = r.h or ends_with(u.host, '.' || r.h)) and starts_with(u.path, r.p) order by length(h || p) desc limit 1) as rule,
  coalesce((select verdict from rules r where (u.host = r.h or ends_with(u.host, '.' || r.h)) and starts_with(u.path, r.p) order by length(h || p) desc limit 1),
    case when exists (select 1 from blocked b where u.host = b.h or ends_with(u.host, '.' || b.h)) then 'block' else 'allow' end) as verdict
from u
"""
