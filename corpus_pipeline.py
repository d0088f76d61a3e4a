"""A training corpus from raw documents, stage by stage.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written
as Parquet and read again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from beamline.llm import common, contamination, language, mixing, simhash, tokens


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the random field tells; the others go.

    Null and letterless texts go, null doc_ids and repeated rows are judged alike, an
    empty table stays empty, and columns that bear the operator's names keep their values."""
    return language.accepted(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id.

    Null and empty texts are one group. Where doc_ids are null or repeat, one row of the
    group stays; an empty table stays empty; all columns keep their values."""
    return simhash.near_dedup(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item.

    Null and empty texts contain none and stay, null and empty items are in no text;
    an empty benchmark leaves all documents; all columns keep their values."""
    return contamination.decontaminate(docs, common.table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    A null source is one more source, the last; texts without words are taken as often
    as a source's whole repetitions; an empty table stays empty; all columns keep
    their values."""
    return mixing.mixed_documents(docs)


def token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in compressed shards, and what they hold of each document.

    A null text is its end id alone; null doc_ids come first; repeated rows are written
    as often as they are there; an empty table gives no rows."""
    return tokens.token_output(docs)


STAGES = [
    ("language_id", language_id),
    ("simhash_dedup", simhash_dedup),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
    ("token_shards", token_shards),
]

#: A random field's labels and grammar-compressed shards are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``. A stage's written documents are
    removed when the next stage's are there."""
    docs, last = common.table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        path = common.scratch_dir(spark)
        docs = common.cut(stage(spark, docs, sf_dir), path)
        if last:
            common.remove(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
