"""Alignment of two tokenizers' ids over the same texts, by distinct segments.

A text is cut before runs of white space, where neither vocabulary has a token that
goes from other characters into white space, so no token of either side crosses a cut.
Each distinct segment of the corpus is tokenised and aligned once; what is found is
joined back to the blocks of documents that the segment came from, and the documents
are composed of their segments in order.

The blocks are the dictionary encoding of the corpus: a block is a lot of documents,
each the sequence of its segments' numbers in the block, and one row for each distinct
segment of the block. So what is shuffled, by segment and back by block, is one row a
block and segment, not one row an occurrence, and a frequent segment has no more rows
than there are blocks.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Characters of a block of documents; the document that passes it is the block's last.
BLOCK_CHARS = 1 << 25
#: Pairs of ids with their counts (24 bytes each) that are sent to all tasks at most; more
#: are joined by a shuffle.
SENT_PAIRS = 1_000_000
#: White space that a cut may stand before, if the vocabularies allow it.
CANDIDATES = " \n\t"
#: Characters of alignments that go back to Spark at once.
OUT_CHARS = 1 << 23
MARK = "▁"  # a space in the second vocabulary's pieces


def vocabularies() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_alphabet() -> dict[str, int]:
    """Byte of each character in the entries of a byte-level vocabulary: visible Latin-1
    characters stand for themselves, the other bytes for U+0100 and what follows."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Aligner:
    """Both tokenizers, the bytes of their tokens and the alignment of segments."""

    def __init__(self, a_path: str, b_path: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True  # their strings are text
        self.b = SentencePieceProcessor(model_file=b_path)
        of = byte_alphabet()
        entries = self.a.get_vocab()
        self.a_bytes = [b""] * (1 + max(entries.values()))
        for entry, k in entries.items():
            self.a_bytes[k] = bytes(map(of.__getitem__, entry)) if all(c in of for c in entry) else entry.encode()
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace(MARK, " ").encode() for k, p in enumerate(pieces)]
        self.space = self.b.piece_to_id(MARK)
        self.a_width, self.b_width = (np.array([len(x) for x in own], np.int64) for own in (self.a_bytes, self.b_bytes))
        self.segment = self.cutter()

    def cutter(self) -> re.Pattern:
        """Pattern of a segment. A cut stands between a character that is no white space
        and white space of ``CANDIDATES`` that follows no other character in any token of
        either vocabulary; the first vocabulary's pre-tokenizer ends its words there too,
        since white space only begins a word. White space of another kind never starts a
        segment."""
        tokens = [x.decode("utf-8", "ignore") for x in (*self.a_bytes, *self.b_bytes)]
        joined = {y for t in tokens for x, y in zip(t, t[1:]) if not x.isspace() and y in CANDIDATES}
        led = {x.decode("utf-8", "ignore")[1:2] for x in self.b_bytes if x[:1] == b" "} - {" "}  # what a space put before it may join
        at = "".join(c for c in CANDIDATES if c not in joined and c not in led)
        if not at:
            return re.compile(r"(?s:.+)")
        other = rf"[^\S{re.escape(at)}]\s*"
        return re.compile(rf"\s*\S+(?:{other}\S+)*(?:{other}\Z)?|\s+")

    def segments(self, text: str) -> list[str]:
        """Segments of the text with a space before it; none of an empty text."""
        return self.segment.findall(" " + text) if text else []

    def b_ids(self, segments: list[str]) -> list[list[int]]:
        """Ids of segments by the second tokenizer, which puts a space before each text:
        it stands for the segment's own first space, or is taken off again."""
        found = self.b.encode([s[1:] if s[0] == " " else s for s in segments], num_threads=1)
        return [ids if s[0] == " " and len(s) > 1 else [self.space] if s[0] == " " else ids[1:] for s, ids in zip(segments, found)]

    def align(self, segments: list[str]) -> dict[str, list]:
        """Alignment of each segment: ``ok`` (both sides' bytes are the segment's),
        ``n_a``, ``groups`` as text and ``links``, one number ``a << 32 | b`` for each
        pair of tokens that overlap."""
        a = [e.ids for e in self.a.encode_batch_fast(segments, add_special_tokens=False)]
        b = self.b_ids(segments)
        data = [s.encode() for s in segments]
        ok = [b"".join(map(self.a_bytes.__getitem__, x)) == d == b"".join(map(self.b_bytes.__getitem__, y)) for x, y, d in zip(a, b, data)]
        a, b = ([ids if good else [] for ids, good in zip(own, ok)] for own in (a, b))
        ia, ib = (np.array([k for ids in own for k in ids], np.int64) for own in (a, b))
        ea, eb = np.cumsum(self.a_width[ia]), np.cumsum(self.b_width[ib])
        ends = np.cumsum([len(d) if good else 0 for d, good in zip(data, ok)])
        both, ties = np.union1d(ea, eb), np.intersect1d(ea, eb, assume_unique=True)
        links = (ia[np.searchsorted(ea, both)] << 32 | ib[np.searchsorted(eb, both)]).tolist()
        at = np.append(0, np.searchsorted(both, ends, "right")).tolist()
        a_to, b_to = np.searchsorted(ea, ties, "right").tolist(), np.searchsorted(eb, ties, "right").tolist()
        sa, sb, text, i, j = list(map(str, ia.tolist())), list(map(str, ib.tolist())), [], 0, 0
        for k, m in zip(a_to, b_to):
            text.append(f"{','.join(sa[i:k])}|{','.join(sb[j:m])}")
            i, j = k, m
        cuts = np.append(0, np.searchsorted(ties, ends, "right")).tolist()
        return {
            "ok": ok,
            "n_a": list(map(len, a)),
            "groups": [";".join(text[i:k]) for i, k in zip(cuts, cuts[1:])],
            "links": [links[i:k] for i, k in zip(at, at[1:])],
        }


def aligner(paths: tuple[str, str]) -> Aligner:
    """The worker's tokenizers, kept for its next tasks."""
    return common.held(("aligner", paths), lambda: Aligner(*paths))


def packed(numbers: np.ndarray) -> bytes:
    """Numbers of segments, all first bytes, then all second ones and so on, compressed."""
    return zstandard.compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1) if len(numbers) else b""


def unpacked(data: bytes) -> np.ndarray:
    if not data:
        return np.empty(0, np.uint32)
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)


class Numbers(dict):
    """Key -> its number in the order of first use."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


_BLOCKS = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), ("sequence", pa.binary()), ("local", pa.int32()), ("segment", pa.string()), ("times", pa.int64())])
BLOCKS = "block long, doc_id long, sequence binary, local int, segment string, times long"


def blocks(docs: DataFrame, paths: tuple[str, str], block_chars: int) -> DataFrame:
    """The corpus in blocks, two kinds of rows: a document's ``doc_id, sequence`` (numbers
    of its segments, packed), and a segment's ``local, segment, times``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, block = aligner(paths).segments, TaskContext.get().partitionId() << 32
        ids, sequences, numbers, held = [], [], Numbers(), 0

        def close() -> Iterator[pa.RecordBatch]:
            words = list(numbers)
            times = np.bincount(np.concatenate(sequences), minlength=len(words)) if words else np.empty(0, np.int64)
            rows = {"block": [block] * len(ids), "doc_id": ids, "sequence": [packed(s) for s in sequences]}
            yield _batch(rows, len(ids))
            for at in range(0, len(words), 10_000):
                own = words[at : at + 10_000]
                yield _batch({"block": [block] * len(own), "local": range(at, at + len(own)), "segment": own, "times": times[at : at + len(own)]}, len(own))

        for batch in common.slices(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                own = cut(text) if text else []
                ids.append(doc_id)
                sequences.append(np.fromiter(map(numbers.__getitem__, own), "<u4", len(own)))
                held += len(text or "")
                if held >= block_chars:
                    yield from close()
                    block, ids, sequences, numbers, held = block + 1, [], [], Numbers(), 0
        if ids:
            yield from close()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, BLOCKS)


def _batch(columns: dict, n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _BLOCKS], schema=_BLOCKS)


SEGMENTS = "times long, ok boolean, n_a long, groups string, links array<long>, blocks array<long>, locals array<int>"


def aligned_segments(words: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """Each distinct segment of ``words(block, local, segment, times)`` with its alignment
    and the blocks that it is in. The rows of a segment come together in order and are
    read batch by batch; a segment whose rows go over a batch has a row for each, and each
    row has the occurrences of its own blocks."""
    types = {"ok": pa.bool_(), "groups": pa.string(), "links": pa.list_(pa.int64())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(paths)
        for b in batches:
            if not b.num_rows:
                continue
            told = pc.run_end_encode(b.column("segment"))
            ends = told.run_ends.to_numpy()
            offsets = pa.array(np.append(0, ends), pa.int32())
            found = own.align(told.values.to_pylist())
            times = np.diff(np.append(0, np.cumsum(b.column("times").to_numpy())[ends - 1]))
            columns = [pa.array(times), *(pa.array(found[k], types.get(k, pa.int64())) for k in ("ok", "n_a", "groups", "links"))]
            columns += [pa.ListArray.from_arrays(offsets, b.column(c)) for c in ("block", "local")]
            yield pa.RecordBatch.from_arrays(columns, ["times", "ok", "n_a", "groups", "links", "blocks", "locals"])

    return words.repartition("segment").sortWithinPartitions("segment").mapInArrow(run, SEGMENTS)


def members(segments: DataFrame, *columns) -> DataFrame:
    """A row for each block of each segment: ``block, local`` and ``columns``."""
    return segments.select(*columns, F.inline(F.arrays_zip("blocks", "locals"))).withColumnsRenamed({"blocks": "block", "locals": "local"})


def unmatched(segments: DataFrame, rows: DataFrame) -> DataFrame:
    """``(block, local, lost)``: occurrences of segments in documents that hold a segment
    which the two sides do not match; only blocks that have such a segment are read."""
    odd = common.cut(members(segments.where(~F.col("ok"))).withColumnRenamed("local", "odd"))
    inside = rows.where(F.col("sequence").isNotNull()).select("block", "sequence").join(odd.select("block").distinct(), "block", "left_semi")

    def count(sequences: pd.DataFrame, odd: pd.DataFrame) -> pd.DataFrame:
        found = [s for s in map(unpacked, sequences["sequence"]) if np.isin(s, odd["odd"]).any()]
        local, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.empty(0, np.int32), np.empty(0, np.int64))
        return pd.DataFrame({"block": [sequences["block"].iloc[0] if len(sequences) else 0] * len(local), "local": local.astype(np.int32), "lost": n})

    return inside.groupBy("block").cogroup(odd.groupBy("block")).applyInPandas(count, "block long, local int, lost long")


def pair_counts(segments: DataFrame, rows: DataFrame) -> DataFrame:
    """``(link, count, best)``: how many links of the corpus are between two ids, and
    whether no other first id has more with the second."""
    fine = segments.where("ok")
    links = fine.select("times", F.explode("links").alias("link"))
    if segments.where(~F.col("ok")).limit(1).count():
        lost = members(fine, "links").join(unmatched(segments, rows), ["block", "local"])
        links = links.union(lost.select(-F.col("lost"), F.explode("links")))
    counts = links.groupBy("link").agg(F.sum("times").alias("count")).withColumn("b", F.expr("link & 4294967295"))
    counts = common.cut(counts)
    top = counts.groupBy("b").agg(F.max("count").alias("top"))
    return counts.join(top, "b").select("link", "count", (F.col("count") == F.col("top")).cast("long").alias("best"))


def scored(segments: DataFrame, counts: DataFrame, sent_pairs: int) -> DataFrame:
    """A row for each block of each segment, with ``n_best`` and ``count_sum`` of its
    links. The counts are sent to all tasks if they are at most ``sent_pairs``; more are
    joined link by link."""
    counts = common.cut(counts)
    if counts.count() > sent_pairs:
        numbered = common.cut(segments.withColumn("number", F.monotonically_increasing_id()))
        sums = numbered.select("number", F.explode("links").alias("link")).join(counts, "link").groupBy("number").agg(F.sum("best").alias("n_best"), F.sum("count").alias("count_sum"))
        found = numbered.join(sums, "number", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_best", "count_sum")})
    else:
        table = counts.orderBy("link").toArrow()
        spread = segments.sparkSession.sparkContext.broadcast([table.column(c).to_numpy() for c in ("link", "count", "best")])
        names = ["ok", "n_a", "groups", "blocks", "locals"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            link, count, best = spread.value
            for b in common.slices(batches):
                own = b.column("links")
                at = np.searchsorted(link, own.flatten().to_numpy())
                to = np.append(0, np.cumsum(own.value_lengths().to_numpy()))
                sums = [np.diff(np.append(0, np.cumsum(x[at]))[to]) for x in (best, count)]
                yield pa.RecordBatch.from_arrays([*map(b.column, names), *map(pa.array, sums)], [*names, "n_best", "count_sum"])

        found = segments.select(*names, "links").mapInArrow(run, "ok boolean, n_a long, groups string, blocks array<long>, locals array<int>, n_best long, count_sum long")
    return members(found, "n_a", "n_best", "count_sum", F.when(F.col("ok"), F.col("groups")).alias("groups"))


FOUND = ("n_a", "n_best", "count_sum")
COUNTED = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"


def composed(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Documents from their segments: the rows of a block come together, segments first."""
    docs = rows.where(F.col("local").isNull()).select("block", "doc_id", "sequence", *(F.lit(None).cast(t).alias(c) for c, t in found.drop("block").dtypes))
    found = found.select("block", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("sequence"), *found.drop("block").columns)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    together = found.union(docs).repartition(n, "block").sortWithinPartitions("block", F.col("local").asc_nulls_last())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, columns, texts, table = None, [], [], None
        for batch in common.slices(batches):
            block = batch.column("block").to_numpy()
            is_doc = batch.column("local").is_null().to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.append(True, (np.diff(block) != 0) | (is_doc[1:] != is_doc[:-1])))
            for i, k in zip(starts.tolist(), np.append(starts[1:], len(block)).tolist()):
                own = batch.slice(i, k - i)
                if block[i] != current:
                    current, columns, texts, table = block[i], [], [], None
                if not is_doc[i]:
                    found = own.column("groups")
                    texts += found.to_pylist()
                    found = found.fill_null("")
                    groups, commas = (pc.count_substring(found, x).to_numpy() for x in "|,")
                    columns.append(np.stack([groups, commas, *(own.column(c).to_numpy() for c in FOUND)]).astype(np.int64))
                    continue
                if table is None:
                    table = np.concatenate(columns, axis=1) if columns else np.empty((2 + len(FOUND), 0), np.int64)
                yield from documents(own, table, texts)

    def documents(own: pa.RecordBatch, table: np.ndarray, texts: list[str]) -> Iterator[pa.RecordBatch]:
        ids, sums, groups, held = [], [], [], 0

        def out() -> pa.RecordBatch:
            columns = zip(*sums) if sums else [()] * len(COUNTED)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(c, pa.int64()) for c in columns), pa.array(groups, pa.string())], ["doc_id", *COUNTED, "groups"])

        for doc_id, sequence in zip(own.column("doc_id").to_pylist(), own.column("sequence").to_pylist()):
            places = unpacked(sequence)
            n_groups, commas, n_a, *scores = table[:, places].sum(axis=1).tolist()
            good = len(places) > 0 and bool(table[0, places].all())  # matched segments have a group
            ids.append(doc_id)
            # two ways to cut the same bytes overlap once between any two cuts of either
            sums.append([n_a, commas + 2 * n_groups - n_a, n_groups, commas + n_groups, *scores] if good else [0] * len(COUNTED))
            groups.append(";".join(map(texts.__getitem__, places.tolist())) if good else None)
            held += len(groups[-1] or "")
            if held >= OUT_CHARS:
                yield out()
                ids, sums, groups, held = [], [], [], 0
        yield out()

    return together.mapInArrow(run, OUT)


def alignments(docs: DataFrame, paths: tuple[str, str] | None = None, block_chars: int = BLOCK_CHARS, sent_pairs: int = SENT_PAIRS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_a, n_b, n_groups, n_links, n_best,
    count_sum, groups``.

    ``groups`` is the alignment of the whole text: for each stretch between byte offsets
    where tokens of both sides end, the ids of the first side, ``|`` and those of the
    second, stretches joined by ``;``. A link is a pair of overlapping tokens, its count
    the number of links of the corpus between the same two ids; ``n_best`` counts the links
    whose count is the highest of their second id, ties included; ``count_sum`` adds the
    links' counts. A null or empty text, and one whose tokens' bytes are not a space and
    the text on both sides, has no tokens: zeros and a null alignment, and nothing of it is
    counted. A very long text is one row of its block; a segment may be as long as its
    text. Null doc_ids stay, repeated rows are aligned and counted as often as they are
    there, further columns are ignored, an empty table gives no rows."""
    paths = tuple(paths or vocabularies())
    rows = common.cut(blocks(docs, paths, block_chars))
    words = rows.where(F.col("local").isNotNull()).select("block", "local", "segment", "times")
    segments = common.cut(aligned_segments(words, paths))
    return composed(rows, scored(segments, pair_counts(segments, rows), sent_pairs))


def op11_alignment(spark, sf_dir: str) -> DataFrame:
    """Alignment of two vocabularies' ids over every document, as counts and a digest."""
    found = alignments(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", *COUNTED, F.coalesce(F.sha2("groups", 256), F.lit("")).alias("groups_sha256"))
