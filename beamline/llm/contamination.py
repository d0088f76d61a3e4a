"""Benchmark decontamination by size-partitioned MinHash containment search.

Items are partitioned by their number of distinct word 5-shingles, in powers of
two. An item is represented by the minima of ``hashes`` hash functions over its
shingles; each minimum is a uniformly drawn shingle, so the part of an item's
minima that occurs in a document estimates how much of the item the document
contains, whatever the document's length. Each partition has the number of hits
that its sizes ask for and is searched on its own; partitions whose items do not fit
into a document are left out. Each candidate is verified by exact containment of the
shingles themselves. Items of fewer than five words are
partitions of their own, one for each number of words: such an item is one
shingle, searched in the document's runs of as many words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SHINGLE = 5
THRESHOLD = 0.8
HASHES = 32
MISS = 1e-9
#: Most items in one broadcast block; a larger benchmark is searched block by block.
BLOCK_ITEMS = 50_000
#: Bytes of text in one block.
BLOCK_BYTES = 32 << 20
TOKEN = re.compile(r"[^\W_]+")
_MASK = (1 << 64) - 1
_FACTORS = np.array([(0x9E3779B97F4A7C15 * (2 * k + 1) ** 3 | 1) & _MASK for k in range(SHINGLE)], np.uint64)


def tokens(text: str | None) -> list[str]:
    """Lower-cased runs of letters and digits."""
    return TOKEN.findall(text.lower()) if text else []


def shingle_set(words: list[str], k: int = SHINGLE) -> set[str]:
    """Distinct shingles; a text with fewer words is one shingle, none without words."""
    if not words:
        return set()
    return {" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}


class WordHash(dict):
    """Word -> 64-bit hash, computed on the first use."""

    def __missing__(self, word: str) -> int:
        if len(self) > 400_000:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word, 7)
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def shingle_hashes(words: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Hashes of consecutive shingles of hashed words; short texts give one."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    m = min(n, k)
    out = np.zeros(n - m + 1, np.uint64)
    for j in range(m):
        out += words[j : n - m + 1 + j] * _FACTORS[j]
    return mixed(out + np.uint64(m))


def needed(hashes: int, threshold: float, miss: float) -> int:
    """Most hits that a containment of ``threshold`` reaches but with chance ``miss``."""
    below, r = 0.0, 0
    while r < hashes:
        below += comb(hashes, r) * threshold**r * (1 - threshold) ** (hashes - r)
        if below > miss:
            break
        r += 1
    return max(1, r)


class Partition:
    """Items of like size: the minima of their hashes, and how many of them a document
    that contains an item has, but for the chance of a miss."""

    def __init__(self, own: list[int], sizes: list[int], signatures: list[np.ndarray], threshold: float, miss: float):
        self.items = np.array(own)
        #: Least number of an item's shingles that reach the threshold, as a part of them.
        least = min(int(np.ceil(threshold * n - 1e-9)) / n for n in sizes)
        self.required = needed(len(signatures[0]), least, miss)
        self.fewest = int(np.ceil(threshold * min(sizes) - 1e-9))
        values, owners, times = [], [], []
        for k, minima in enumerate(signatures):
            found, n = np.unique(minima, return_counts=True)
            values.append(found)
            owners.append(np.full(len(found), k))
            times.append(n)
        values, owners, times = np.concatenate(values), np.concatenate(owners), np.concatenate(times)
        order = np.argsort(values, kind="stable")
        self.owner, self.times = owners[order], times[order]
        self.values, starts = np.unique(values[order], return_index=True)
        self.starts = np.append(starts, len(values))
        self.mask = np.zeros(1 << 16, bool)
        self.mask[(self.values >> np.uint64(48)).astype(np.int64)] = True

    def candidates(self, hashed: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Items that a text with these shingle hashes (and their upper 16 bits) may contain."""
        hits = hashed[self.mask[high]]
        at = np.searchsorted(self.values, hits)
        at[at == len(self.values)] = 0
        at = np.unique(at[self.values[at] == hits])
        if not len(at):
            return at
        n = self.starts[at + 1] - self.starts[at]
        rows = np.repeat(self.starts[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        score = np.bincount(self.owner[rows], self.times[rows], len(self.items))
        return self.items[score >= self.required]


class Block:
    """The items of one block: partitions by size, and the exact shingles."""

    def __init__(self, items: list[tuple[int, str]], threshold: float, hashes: int, miss: float):
        self.items, self.threshold = [], threshold
        #: Items of fewer words than a shingle: number of words -> hash -> (item_id, text).
        self.short: dict[int, dict[int, list[tuple[int, str]]]] = {}
        cache, dealt = WordHash(), {}
        salts = mixed(np.arange(1, hashes + 1, dtype=np.uint64))
        for item_id, text in items:
            words = tokens(text)
            exact = shingle_set(words)
            if not exact:
                continue
            hashed = np.array([cache[w] for w in words], np.uint64)
            if len(words) < SHINGLE:
                own = int(shingle_hashes(hashed, len(words))[0])
                self.short.setdefault(len(words), {}).setdefault(own, []).append((item_id, " ".join(words)))
                continue
            own = np.unique(shingle_hashes(hashed))
            minima = np.array([own[np.argmin(mixed(own ^ s))] for s in salts], np.uint64)
            dealt.setdefault(len(exact).bit_length(), []).append((len(self.items), len(exact), minima))
            self.items.append((item_id, exact))
        #: By size in powers of two, ascending.
        self.partitions = [Partition(*map(list, zip(*own)), threshold, miss) for _, own in sorted(dealt.items())]
        self.short_values = {m: np.array(sorted(found), np.uint64) for m, found in self.short.items()}

    def search(self, words: list[str], hashed: np.ndarray) -> list[tuple[int, int, int]]:
        """``(item_id, shared, size)`` of the items that the text contains; ``hashed``
        has the hashes of its words."""
        return self.search_short(words, hashed) + self.search_shingles(words, hashed)

    def search_short(self, words: list[str], hashed: np.ndarray) -> list[tuple[int, int, int]]:
        """The items of fewer words than a shingle that the text contains."""
        out = []
        for m, values in self.short_values.items():
            if len(words) < m:
                continue
            runs = shingle_hashes(hashed, m)
            at = np.nonzero(values[np.minimum(np.searchsorted(values, runs), len(values) - 1)] == runs)[0]
            there: dict[int, set[str]] = {}
            for k in at.tolist():
                there.setdefault(int(runs[k]), set()).add(" ".join(words[k : k + m]))
            out += [(item_id, 1, 1) for h, texts in there.items() for item_id, text in self.short[m][h] if text in texts]
        return out

    def search_shingles(self, words: list[str], hashed: np.ndarray) -> list[tuple[int, int, int]]:
        """The items of five words or more that the text contains."""
        if not self.partitions or len(words) < SHINGLE:
            return []
        hashed = shingle_hashes(hashed)
        high = (hashed >> np.uint64(48)).astype(np.int64)
        out, mine = [], None
        for part in self.partitions:
            if part.fewest > len(hashed):
                break  # this and the larger ones do not fit into the text
            for i in part.candidates(hashed, high):
                mine = shingle_set(words) if mine is None else mine
                item_id, exact = self.items[i]
                shared = len(exact & mine)
                if shared >= self.threshold * len(exact):
                    out.append((item_id, shared, len(exact)))
        return out


def item_blocks(benchmark: DataFrame, threshold: float, hashes: int, miss: float, block_items: int) -> Iterator[Broadcast]:
    """The items in blocks of about ``block_items`` and ``BLOCK_BYTES`` at most, each sent
    to all executors."""
    items = benchmark.select(F.col("item_id").cast("long"), "text")
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    n = max(1, -(-size["n"] // block_items), -(-size["bytes"] // BLOCK_BYTES))
    for b in range(n):
        mine = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b)
        yield benchmark.sparkSession.sparkContext.broadcast(Block([(r[0], r[1]) for r in mine.collect()], threshold, hashes, miss))


def _hashed(words: list[str], cache: WordHash) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def contained(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, hashes: int = HASHES, miss: float = MISS, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """``(doc_id, item_id, shared, n_shingles, containment)`` of every item of which a
    document contains ``threshold`` or more of the distinct word 5-shingles.

    Words are lower-cased runs of letters and digits of the whole text. Null and
    empty texts, and items without words, contain and are contained in nothing; a very
    long text is one search like any other;
    an item of fewer than five words is one shingle, which every text with these
    words in a row contains. Repeated document rows give
    repeated results; repeated item ids are searched as separate items. The
    benchmark is the stated query set: it is read in blocks of ``block_items``
    and each block searches all documents, so what is broadcast is bounded."""
    schema = "doc_id long, item_id long, shared long, n_shingles long, containment double"
    rows, out = docs.select(F.col("doc_id").cast("long"), "text"), None
    for block in item_blocks(benchmark, threshold, hashes, miss, block_items):

        def run(batches: Iterator[pd.DataFrame], block=block) -> Iterator[pd.DataFrame]:
            cache = common.held("words", WordHash)
            for pdf in batches:
                found = []
                for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                    words = tokens(text)
                    found += [(doc_id, i, s, n, s / n) for i, s, n in block.value.search(words, _hashed(words, cache))]
                out = pd.DataFrame(found, columns=["doc_id", "item_id", "shared", "n_shingles", "containment"])
                yield out.astype({"doc_id": "Int64", "item_id": "Int64"})

        part = rows.mapInPandas(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, hashes: int = HASHES, miss: float = MISS, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """``docs`` without the rows that contain an item of ``benchmark`` (as ``contained``
    has it), in the same columns."""
    for block in item_blocks(benchmark, threshold, hashes, miss, block_items):

        def start(block=block):
            cache = common.held("words", WordHash)
            return lambda texts: [not block.value.search(w, _hashed(w, cache)) for w in map(tokens, texts)]

        docs = common.keep_rows(docs, "text", start)
    return docs


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    """Documents and the benchmark items that they contain."""
    return contained(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


OP6_SQL = r"""
with w as (
  select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as t from documents),
i as (select item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as t from benchmark),
m as (select distinct least(len(t), 5) as m from i where len(t) > 0),
di as (select distinct item_id, least(len(t), 5) as m, array_to_string(t[k:k+4], ' ') as s
  from i, unnest(range(1, greatest(2, len(t) - 3))) r(k) where len(t) > 0),
ds as (select distinct doc_id, m, array_to_string(t[k:k+m-1], ' ') as s
  from w, m, unnest(range(1, len(t) - m + 2)) r(k) where len(t) >= m),
n as (select item_id, count(*) as n_shingles from di group by 1)
select ds.doc_id, di.item_id, count(*)::bigint as shared, any_value(n_shingles)::bigint as n_shingles, count(*)::double / any_value(n_shingles) as containment
from ds join di using (m, s) join n on n.item_id = di.item_id
group by ds.doc_id, di.item_id having count(*) >= 0.8 * any_value(n_shingles)
"""
