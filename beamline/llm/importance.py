"""Importance resampling towards a target distribution, on collapsed texts.

Identical texts are collapsed by grouping whole texts: features are hashed once for
each distinct text, its counts are multiplied by the number of copies, and its weight
is joined back to all its documents by a digest of the text before each document's own
noise is added.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

BUCKETS = 10_000
#: Weights and noise are whole numbers of 1 / SCALE.
SCALE = 1000
MIN_WORDS = 20
PERCENT = 25
SEED = 7
#: Words of lower-cased UTF-8: digits, letters and whatever is beyond ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def features(text: str | None, buckets: int = BUCKETS) -> np.ndarray:
    """Bucket of each word and of each pair of neighbouring words of the whole text. A
    pair's checksum goes on from that of its first word."""
    words = WORD.findall(text.encode().lower()) if text else []  # lower-cases A-Z alone
    single = list(map(crc32, words))
    pairs = map(crc32, [b" " + w for w in words[1:]], single)
    return (np.array([*single, *pairs], np.uint32) % np.uint32(buckets)).astype(np.uint32)


def featured(texts: DataFrame, buckets: int) -> DataFrame:
    """``texts(text, digest, copies)``, all distinct, as ``digest, copies, n_features,
    features`` (a bucket each, 16 bits while they do)."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            found = [features(t, buckets) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("digest"), b.column("copies"), pa.array([len(f) for f in found], pa.int64()), pa.array([f.astype(kind).tobytes() for f in found], pa.binary())],
                ["digest", "copies", "n_features", "features"],
            )

    return texts.mapInArrow(run, "digest binary, copies long, n_features long, features binary")


def collapsed(docs: DataFrame, buckets: int) -> DataFrame:
    """Distinct texts of ``docs`` with their number and features, written once."""
    text = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    return common.cut(featured(text.groupBy("text").agg(F.count("*").alias("copies")).withColumn("digest", digest("text")), buckets))


def digest(text: str) -> F.Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def bucket_counts(texts: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs, copies included: summed within the tasks, then over
    them; one number a bucket comes to the driver."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in common.slices(batches):
            n = b.column("n_features").to_numpy()
            found = np.concatenate([np.frombuffer(x, kind) for x in b.column("features").to_pylist()] or [np.empty(0, kind)])
            total += np.bincount(found, np.repeat(b.column("copies").to_numpy(), n), buckets).astype(np.int64)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], ["bucket", "n"])

    found = texts.select("copies", "n_features", "features").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Gain of each bucket, a whole number."""
    s, t, n = raw.astype(np.float64), target.astype(np.float64), len(raw)
    return np.floor(SCALE * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def weighed(texts: DataFrame, gain: np.ndarray) -> DataFrame:
    """``(digest, n_features, weight)``: the floored mean of the gains of a text's features."""
    spread = texts.sparkSession.sparkContext.broadcast(gain)
    kind = "<u2" if len(gain) <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            sums = np.array([spread.value[np.frombuffer(x, kind)].sum() for x in b.column("features").to_pylist()], np.int64)
            n = b.column("n_features").to_numpy()
            yield pa.RecordBatch.from_arrays([b.column("digest"), b.column("n_features"), pa.array(sums // np.maximum(n, 1))], ["digest", "n_features", "weight"])

    return texts.select("digest", "n_features", "features").mapInArrow(run, "digest binary, n_features long, weight long")


def resampled(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_features, weight, score, rank``.

    A bucket's gain is the log ratio of its shares in the ``target`` texts and in all of
    ``docs``, in thousandths, rounded down; ``weight`` is the rounded-down mean gain of the
    text's features and ``score`` adds Gumbel noise drawn from the doc_id. Of the N
    documents with ``min_words`` words or more, ``floor(percent * N / 100)`` are drawn, the
    highest scores first, ties to the smaller doc_id; the others have no ``rank``.
    Null and empty texts have no features and weight 0; a null doc_id draws the noise of an
    empty one and comes after all others among ties; repeated doc_ids draw the same noise;
    a very long text counts whole; an empty ``target`` leaves the raw shares to decide;
    an empty table gives no rows; further columns are ignored.

    The texts are shuffled once, combined before that, so copies move as one; what is
    joined back, one row a distinct text, is a digest and two numbers. Only the documents
    at or above the score of the last one drawn are put in order."""
    texts = collapsed(docs, buckets)
    gain = gains(bucket_counts(texts, buckets), bucket_counts(collapsed(target, buckets), buckets))
    ids = docs.select(F.col("doc_id").cast("long"), digest("text").alias("digest"))
    head = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-SCALE * F.log(-F.log((head + 0.5) / F.lit(4294967296.0))))
    scored = common.cut(ids.join(weighed(texts, gain), "digest").select("doc_id", "n_features", "weight", (F.col("weight") + noise).alias("score")))
    long_enough = F.col("n_features") >= 2 * min_words - 1
    by_score = scored.where(long_enough).groupBy("score").agg(F.count("*").alias("n"))
    sums = common.cut(by_score)  # one row a score: whole numbers within the range of weights and noise
    draw = percent * (sums.agg(F.sum("n")).first()[0] or 0) // 100
    above = sums.select("score", F.sum("n").over(W.orderBy(F.desc("score"))).alias("reached"))
    last = above.where(F.col("reached") >= draw).agg(F.max("score")).first()[0] if draw else None
    inside = long_enough & (F.col("score") >= F.lit(last)) if last is not None else F.lit(False)
    placed = common.numbered(scored.where(inside), F.desc("score"), F.asc_nulls_last("doc_id"))
    drawn = placed.withColumn("rank", F.when(F.col("place") < draw, F.col("place") + 1)).drop("place")
    return drawn.unionByName(scored.where(~inside).withColumn("rank", F.lit(None).cast("long")))


def op12_resampling(spark, sf_dir: str) -> DataFrame:
    """Weight, score and rank of every document, drawn towards the benchmark's texts."""
    return resampled(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


#: The checksum by its rule, over distinct features: a table of 256 remainders, then the
#: bytes one by one.
OP12_SQL = r"""
with remainders as (
  select list(v order by b) as r from (
    select b, list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, 3988292384 * (v & 1))) as v from (select cast(range as bigint) as b from range(256)))),
texts as (
  select 0 as side, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from documents
  union all select 1, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') from benchmark),
placed as (select side, doc_id, words, unnest(range(len(words))) as i from texts),
found as (
  select side, doc_id, words[i + 1] as feature from placed
  union all select side, doc_id, words[i + 1] || ' ' || words[i + 2] from placed where i + 1 < len(words)),
spelled as (select feature, hex(encode(feature)) as h from (select distinct feature from found)),
hashed as (
  select feature, xor(list_reduce(list_prepend(cast(4294967295 as bigint), list_transform(range(len(h) // 2), lambda i: cast('0x' || substr(h, 2 * i + 1, 2) as bigint))),
    lambda c, b: xor(c >> 8, r[xor(c, b) % 256 + 1])), 4294967295) % 10000 as bucket
  from spelled, remainders),
counted as (
  select bucket, count(*) filter (where side = 0) as s, count(*) filter (where side = 1) as t
  from found join hashed using (feature) group by bucket),
gain as (
  select bucket, floor(1000 * ln((t + 1)::double * ((sum(s) over ()) + 10000)::double / ((s + 1)::double * ((sum(t) over ()) + 10000)::double))) as gain from counted),
weights as (
  select doc_id, count(*) as n_features, cast(floor(sum(gain) / count(*)) as bigint) as weight
  from found join hashed using (feature) join gain using (bucket) where side = 0 group by doc_id),
scores as (
  select doc_id, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
    coalesce(weight, 0) + cast(floor(-1000 * ln(-ln((cast('0x' || substr(sha256('7:' || doc_id), 1, 8) as bigint) + 0.5::double) / 4294967296::double))) as bigint) as score
  from documents left join weights using (doc_id)),
eligible as (select doc_id, row_number() over (order by score desc, doc_id) as place, count(*) over () as n from scores where n_features >= 39)
select doc_id, n_features, weight, score, case when place <= 25 * n // 100 then place end as rank from scores left join eligible using (doc_id)
"""
