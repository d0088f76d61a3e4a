"""Quality selection by importance resampling.

Two generative models of hashed unigrams and bigrams are counted: one over the
target texts (labelled good and not toxic), one over all raw texts. A document's
log importance weight is the sum over its n-grams of the log ratio of the two;
documents are drawn without replacement in proportion to their weights by adding
seeded Gumbel noise and keeping the top k.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .contamination import WordHash, mixed, tokens

#: Buckets of the n-grams for one document; they grow with the fourth root of the
#: number of documents (15,000 for 50,000 documents, 180,000 for a thousand million).
BUCKETS = 1024
#: Target documents that the target model is fitted on, at most.
MAX_TARGET_DOCS = 20_000
KEEP = 0.75
SEED = 7


def bucket_count(n_docs: int) -> int:
    """Buckets of the models of a corpus. A task's counts have one row a bucket, so their
    number has to grow more slowly than the corpus."""
    return int(BUCKETS * max(1, n_docs) ** 0.25)


def ngrams(text: str | None, cache: WordHash, buckets: int) -> np.ndarray:
    """Bucket of each unigram and bigram of the whole text."""
    words = tokens(text)
    h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    pairs = mixed(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])
    return (np.concatenate([h, pairs]) % np.uint64(buckets)).astype(np.int64)


def counted(docs: DataFrame, target_ids: np.ndarray, buckets: int) -> DataFrame:
    """``(bucket, raw, target)``: n-grams of all of ``docs`` and of the target texts, summed
    within the tasks and then over them."""
    chosen = docs.sparkSession.sparkContext.broadcast(np.sort(target_ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, ids = common.held("words", WordHash), chosen.value
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for b in common.slices(batches):
            good = np.isin(b.column("doc_id").fill_null(-1).to_numpy(), ids) & b.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            for text, is_target in zip(b.column("text").to_pylist(), good):
                seen, times = np.unique(ngrams(text, cache, buckets), return_counts=True)
                raw[seen] += times
                if is_target:
                    target[seen] += times
        there = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(raw[there]), pa.array(target[there])], ["bucket", "raw", "target"])

    seen = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "bucket long, raw long, target long")
    return seen.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratio(counts: DataFrame, buckets: int) -> np.ndarray:
    """Log ratio of the two models by bucket; one number a bucket comes to the driver."""
    counts = common.cut(counts)
    n = counts.agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).first()
    out = np.zeros(buckets, np.float32)
    if n["target"]:
        shares = [(F.col(c) + 1) / F.lit(float(n[c] + buckets)) for c in ("target", "raw")]
        found = counts.select("bucket", F.log(shares[0] / shares[1]).alias("ratio")).toArrow()
        out[found.column("bucket").to_numpy()] = found.column("ratio").to_numpy()
    return out


def resample(docs: DataFrame, labels: DataFrame, keep: float = KEEP, buckets: int | None = None, max_target_docs: int = MAX_TARGET_DOCS, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_grams, log_weight, mean_log_ratio,
    gumbel_key, kept``.

    The target texts are those of ``labels(doc_id, quality, toxic)`` with quality 1
    and toxic not 1, at most ``max_target_docs`` of them by a seeded order; the raw
    model and the weights cover all documents, and whole texts, also very long ones.
    ``kept`` marks the ``keep`` share of rows with the highest keys, ties by doc_id.
    Null and empty texts have weight 0; without target texts all weights are 0;
    repeated doc_ids draw the same noise; an empty table gives no rows; further
    columns are ignored. The texts are read twice, to count and to weigh."""
    good = labels.where((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) != 1) & F.col("doc_id").isNotNull())
    ids = good.select(F.col("doc_id").cast("long")).distinct().orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(max_target_docs)
    n_docs = docs.count()
    buckets = buckets or bucket_count(n_docs)
    ratio = log_ratio(counted(docs, np.array([r[0] for r in ids.collect()], np.int64), buckets), buckets)
    weights = docs.sparkSession.sparkContext.broadcast(ratio)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, weight = common.held("words", WordHash), weights.value
        for b in common.slices(batches):
            grams = [ngrams(t, cache, buckets) for t in b.column("text").to_pylist()]
            n = np.array([len(g) for g in grams], np.int64)
            total = np.array([weight[g].sum(dtype=np.float64) for g in grams])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n), pa.array(total), pa.array(total / np.maximum(n, 1))], ["doc_id", "n_grams", "log_weight", "mean_log_ratio"])

    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(score, "doc_id long, n_grams long, log_weight double, mean_log_ratio double")
    uniform = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(f"gumbel {seed}")), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    keyed = common.cut(scored.withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(uniform))))  # weighed once; the order below reads it twice
    placed = common.numbered(keyed, F.desc("gumbel_key"), F.asc("doc_id"))
    return placed.withColumn("kept", F.col("place") < round(keep * n_docs)).drop("place")


def op10_quality(spark, sf_dir: str) -> DataFrame:
    """Importance weight and selection of every document."""
    return resample(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
