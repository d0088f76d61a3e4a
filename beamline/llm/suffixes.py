"""Exact substring dedup with suffix arrays built by linear grouping.

A byte goes if a 50-byte string covers it that also starts in a document with a
smaller doc_id. Two equal 50-byte strings have the same minimiser: of their 25-byte
substrings the one with the least hash (leftmost of equals). So the work is dealt
out by minimisers ("anchors"):

1. Texts are packed into blocks; a block knows the anchors of its texts.
2. Each block sends the keys of its anchors, each once, and learns which of them
   occur in another document.
3. For those, it sends each distinct context once: the 75 bytes that hold every
   50-byte string around the anchor, with the smallest doc_id that has it.
4. The contexts that meet on a key are suffix-sorted together. In the order of the
   suffixes, equal 50-byte strings are neighbours; each gets its smallest doc_id.
5. The answers go back to the blocks, which mark and count the removed bytes.

The suffix array comes from Lyndon grouping. Every position's group is its longest
Lyndon prefix. Groups are made in descending order of the first symbol: a position
takes over the complete groups that follow it, as their previous smaller position,
until a smaller one follows. Then each group's suffixes are ordered by the groups
that follow along the next-smaller pointers; no position is renamed and no smaller
text is sorted in between.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LENGTH = 50
#: Length of an anchor, windows of it in a string, and bytes of a context.
CORE = 25
SPAN = LENGTH - CORE
CONTEXT = LENGTH + SPAN
BLOCK_BYTES = 4 << 20
#: Text bytes for which one more bucket of keys is opened.
BUCKET_BYTES = 16 << 20
#: Contexts that are sorted together (but never less than those of one key).
SLICE = 1 << 14
#: Documents from which a key counts as heavy: its strings are then dealt out by
#: their own hash instead of the key's, so no task gets them all.
HEAVY = 50_000
_TOP = np.iinfo(np.int64).max
_ODD = np.random.default_rng(50).integers(0, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


# --- suffix sorting ---------------------------------------------------------------


def split(name: np.ndarray, size: np.ndarray, rows: np.ndarray, key: np.ndarray) -> None:
    """Refine the groups of ``rows`` by ``key``, in place.

    A group is named by the number of rows before it; ``size`` has its rows by name.
    Of a group, rows that are not in ``rows`` have ended and come first."""
    both = (name[rows] << 32) | key
    order = np.argsort(both)
    rows, both = rows[order], both[order]
    old, at = both >> 32, np.arange(len(rows))
    new_key, new_old = np.empty(len(rows), bool), np.empty(len(rows), bool)
    new_key[:1] = new_old[:1] = True
    np.not_equal(both[1:], both[:-1], out=new_key[1:])
    np.not_equal(old[1:], old[:-1], out=new_old[1:])
    first, opens = np.nonzero(new_old)[0], np.nonzero(new_key)[0]
    ended = size[old[first]] - np.diff(first, append=len(rows))
    size[old[first]] = ended
    group = np.cumsum(new_old) - 1
    renamed = old[opens] + ended[group[opens]] + at[opens] - first[group[opens]]
    size[renamed] = np.diff(opens, append=len(rows))
    name[rows] = renamed[np.cumsum(new_key) - 1]


def less(name: np.ndarray, width: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the word at ``a`` is less than the one at ``b``; a word is ``width``
    names long and less than its extensions."""
    out = name[a] < name[b]
    tied, q = np.nonzero(name[a] == name[b])[0], 1
    while len(tied):
        x, y = a[tied], b[tied]
        u = np.where(q < width[x], name[np.minimum(x + q, len(name) - 1)], -1)
        v = np.where(q < width[y], name[np.minimum(y + q, len(name) - 1)], -1)
        out[tied] = u < v
        tied, q = tied[(u == v) & (u >= 0)], q + 1
    return out


def lyndon_groups(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group and length of the longest Lyndon prefix at each position of ``x``.

    ``x`` holds non-negative integers and ends with 0, which is below every symbol
    and parts texts. Groups are ordered as their words are; a group's number is at
    most the number of positions that belong to smaller groups."""
    group, length = np.zeros(len(x), np.int64), np.ones(len(x), np.int64)
    places = np.argsort(x, kind="stable")
    bounds = np.concatenate([[0], np.cumsum(np.bincount(x))])
    for c in range(len(bounds) - 2, 0, -1):
        here = places[bounds[c] : bounds[c + 1]]
        n = len(here)
        if not n:
            continue
        name, size = np.zeros(n, np.int64), np.zeros(n, np.int64)
        size[0] = n
        # take over the complete groups that follow
        stop, rows = here + 1, np.arange(n)
        while True:
            rows = rows[x[stop[rows]] > c]
            if not len(rows):
                break
            open_rows = rows[size[name[rows]] > 1]
            split(name, size, open_rows, group[stop[open_rows]])
            stop[rows] += length[stop[rows]]
        # runs of positions of this symbol, from the right
        joined = np.zeros(n, bool)
        joined[:-1] = stop[:-1] == here[1:]
        if joined.any():
            ends = np.nonzero(~joined)[0]
            end = ends[np.searchsorted(ends, np.arange(n))] + 1
            width, depth = np.ones(n, np.int64), end - 1 - np.arange(n)
            order = np.argsort(depth, kind="stable")
            levels = np.searchsorted(depth[order], np.arange(1, int(depth.max()) + 2))
            for lo, hi in zip(levels[:-1], levels[1:]):
                k = order[lo:hi]
                while len(k):
                    k = k[less(name, width, k, k + width[k])]
                    width[k] += width[k + width[k]]
                    k = k[k + width[k] < end[k]]
            words, q, rows = name.copy(), 1, np.nonzero(width > 1)[0]
            while len(rows):
                open_rows = rows[size[words[rows]] > 1]
                split(words, size, open_rows, name[open_rows + q])
                q += 1
                rows = rows[width[rows] > q]
            name, stop = words, stop[np.arange(n) + width - 1]
        group[here], length[here] = bounds[c] + name, stop - here
    return group, length


def suffix_order(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Places of the suffixes of ``x`` that begin ``at`` these positions; a suffix ends
    before the next 0, and equal suffixes have the same place."""
    group, length = lyndon_groups(x)
    name, size = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    if not len(at):
        return name
    size[0] = len(at)
    cursor, rows = at.copy(), np.arange(len(at))
    while len(rows):
        rows = rows[(size[name[rows]] > 1) & (x[cursor[rows]] > 0)]
        if len(rows):
            split(name, size, rows, group[cursor[rows]])
            cursor[rows] += length[cursor[rows]]
    return name


def suffix_array(data: bytes) -> np.ndarray:
    """Suffix array of one byte string."""
    x = np.append(np.frombuffer(data, np.uint8).astype(np.int16) + 1, np.int16(0))
    return np.argsort(suffix_order(x, np.arange(len(data))), kind="stable")


# --- blocks, anchors and contexts ---------------------------------------------------


def _words(buffer: np.ndarray) -> np.ndarray:
    """The 8-byte integer at every position of ``buffer``."""
    return np.ndarray((len(buffer) - 7,), "<u8", buffer, 0, (1,))


def _mix(h: np.ndarray, k: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _ODD[k]
    return h ^ (h >> np.uint64(32))


def _core(words: np.ndarray, at, k: int) -> np.ndarray:
    """Hash of the 25 bytes at ``at`` (an index array or the start of a slice)."""
    take = (lambda d: words[at.start + d : at.stop + d]) if isinstance(at, slice) else (lambda d: words[at + d])
    return _mix(take(0) * _ODD[k] + take(8) * _ODD[k + 1] + take(16) * _ODD[k + 2] + take(17) * _ODD[k + 3], k + 4)


def _short(keys: np.ndarray) -> np.ndarray:
    """The 48 bits of a key by which the first exchange tells keys of a bucket apart."""
    return keys >> np.uint64(16)


def _pack_sorted(a: np.ndarray) -> bytes:
    """Ascending integers as steps of five bytes, or eight where five do not do."""
    steps = np.diff(a, prepend=np.uint64(0)).astype("<u8")
    wide = bool(len(steps) and steps.max() >> np.uint64(40))
    return bytes([8 if wide else 5]) + steps.view(np.uint8).reshape(-1, 8)[:, : 8 if wide else 5].tobytes()


def _unpack_sorted(b: bytes) -> np.ndarray:
    steps = np.frombuffer(b, np.uint8, offset=1).reshape(-1, b[0])
    wide = np.zeros((len(steps), 8), np.uint8)
    wide[:, : b[0]] = steps
    return np.cumsum(wide.view("<u8").ravel(), dtype=np.uint64)


class Block:
    """Whole texts of a block: bytes, ends and order ids of the documents."""

    def __init__(self, texts: bytes, ends: np.ndarray, ids: np.ndarray):
        self.n, self.ends, self.ids = len(texts), ends, ids
        self.starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        self.buffer = np.zeros(SPAN + self.n + LENGTH + 8, np.uint8)
        self.buffer[SPAN : SPAN + self.n] = np.frombuffer(texts, np.uint8)
        self.words = _words(self.buffer[SPAN:])

    def anchors(self, step: int = 1 << 17) -> np.ndarray:
        """Positions of the minimisers of all 50-byte strings within a document."""
        count = self.n - LENGTH + 1
        if count <= 0:
            return np.empty(0, np.int64)
        crossing = np.zeros(self.n + 1, np.int32)
        np.add.at(crossing, np.maximum(self.ends - LENGTH + 1, 0), 1)
        np.add.at(crossing, self.ends, -1)
        whole = np.cumsum(crossing)[:count] == 0
        mark, place = np.zeros(self.n, bool), np.arange(step + SPAN, dtype=np.uint64)
        for s in range(0, count, step):
            m = min(step, count - s)
            h = _core(self.words, slice(s, s + m + SPAN), 0)
            h = (h & np.uint64(0xFFFFFFFF00000000)) | place[: m + SPAN]
            for d in (1, 2, 4, 8):
                h = np.minimum(h[:-d], h[d:])
            h = np.minimum(h[:m], h[SPAN - 15 : SPAN - 15 + m])
            mark[(h[whole[s : s + m]] & np.uint64(0xFFFFFFFF)).astype(np.int64) + s] = True
        return np.nonzero(mark)[0]

    def keys(self, at: np.ndarray) -> np.ndarray:
        return _core(self.words, at, 5)

    def doc(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, at, "right")

    def contexts(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """75 bytes around each anchor, and the first and last place where a 50-byte
        string begins that lies within the document; other bytes are zero."""
        doc = self.doc(at)
        lo = np.maximum(0, self.starts[doc] - at + SPAN)
        hi = np.minimum(SPAN, self.ends[doc] - LENGTH - at + SPAN)
        out = np.lib.stride_tricks.sliding_window_view(self.buffer, CONTEXT)[at]
        cut = np.nonzero((lo > 0) | (hi < SPAN))[0]
        column = np.arange(CONTEXT)
        out[cut] *= (column >= lo[cut, None]) & (column < hi[cut, None] + LENGTH)
        return out, lo.astype(np.uint8), hi.astype(np.uint8)


def context_hash(contexts: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(contexts), 80), np.uint8)
    wide[:, :CONTEXT], wide[:, CONTEXT], wide[:, CONTEXT + 1] = contexts, lo, hi
    h = wide.view("<u8") * _ODD[:10]
    return _mix(_mix(h[:, 0] + h[:, 1] + h[:, 2] + h[:, 3] + h[:, 4] + h[:, 5] + h[:, 6] + h[:, 7] + h[:, 8] + h[:, 9], 3), 9)


def strings_of(contexts: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The 50-byte strings of each context, as contexts of one string each: row,
    place in the row, and the bytes (followed by zeros)."""
    row, place = np.nonzero((np.arange(SPAN + 1) >= lo[:, None]) & (np.arange(SPAN + 1) <= hi[:, None]))
    out = np.zeros((len(row), CONTEXT), np.uint8)
    out[:, :LENGTH] = np.lib.stride_tricks.sliding_window_view(contexts, LENGTH, axis=1)[row, place]
    return row, place, out


def string_keys(strings: np.ndarray) -> np.ndarray:
    none = np.zeros(len(strings), np.uint8)
    return _mix(context_hash(strings, none, none), 11)


def smallest_ids(contexts: np.ndarray, lo: np.ndarray, hi: np.ndarray, low: np.ndarray) -> np.ndarray:
    """For each context and place the smallest id of the contexts that hold the same
    50-byte string; ``low`` is each context's own. Suffix-sorts all of them."""
    m = len(contexts)
    inside = (np.arange(CONTEXT) >= lo[:, None]) & (np.arange(CONTEXT) < hi[:, None].astype(np.int64) + LENGTH)
    x = np.zeros((m, CONTEXT + 1), np.int16)
    x[:, :CONTEXT] = (contexts.astype(np.int16) + 1) * inside
    row, place = np.nonzero((np.arange(SPAN + 1) >= lo[:, None]) & (np.arange(SPAN + 1) <= hi[:, None]))
    order = np.argsort(suffix_order(x.ravel(), row * (CONTEXT + 1) + place))
    row, place = row[order], place[order]
    words = _words(np.append(contexts.ravel(), np.zeros(8, np.uint8)))
    at, new = row * CONTEXT + place, np.zeros(len(row), bool)
    new[:1] = True
    for d in (*range(0, LENGTH - 7, 8), LENGTH - 8):
        w = words[at + d]
        new[1:] |= w[1:] != w[:-1]
    out = np.full((m, SPAN + 1), _TOP)
    if len(row):
        starts = np.nonzero(new)[0]
        out[row, place] = np.minimum.reduceat(low[row], starts)[np.cumsum(new) - 1]
    return out


# --- Spark --------------------------------------------------------------------------

BLOCKS = "block long, n_bytes long, n_docs int, texts binary, ends binary, ids binary, known binary, anchors binary"
PARCEL = "bucket long, block long, n long, keys binary, counts binary, contexts binary, lo binary, hi binary, low binary"
ANSWER = "block long, kind int, keys binary, hashes binary, smallest binary"


def _pack(a: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(a).tobytes(), 3)


def _unpack(b: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(b), dtype)


def _open(row) -> tuple[Block, np.ndarray]:
    block = Block(zstandard.decompress(row.texts), _unpack(row.ends, np.int64), _unpack(row.ids, np.int64))
    return block, np.cumsum(_unpack(row.anchors, np.uint32), dtype=np.int64)


def blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each block of about ``block_bytes`` of whole texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, texts, ids, held = TaskContext.get().partitionId() << 32, [], [], 0

        def close() -> pd.DataFrame:
            data, ends = b"".join(texts), np.cumsum([len(t) for t in texts], dtype=np.int64)
            known = np.array([i is not None for i in ids], np.uint8)
            order = np.array([_TOP if i is None else i for i in ids], np.int64)
            at = Block(data, ends, order).anchors()
            row = [number, len(data), len(ids), zstandard.compress(data, 3), _pack(ends), _pack(order), _pack(known), _pack(np.diff(at, prepend=0).astype(np.uint32))]
            return pd.DataFrame([row], columns=["block", "n_bytes", "n_docs", "texts", "ends", "ids", "known", "anchors"])

        for pdf in batches:
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                ids.append(None if pd.isna(doc_id) else int(doc_id))
                texts.append(text)
                held += len(text)
                if held >= block_bytes:
                    yield close()
                    number, texts, ids, held = number + 1, [], [], 0
        if ids:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return rows.mapInPandas(run, BLOCKS)


def _parcels(block: int, buckets: int, keys: np.ndarray, short: bool = False, **columns: np.ndarray) -> pd.DataFrame:
    """One row a bucket of what a block sends; ``keys`` ascend."""
    bucket = (keys % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    first = np.nonzero(np.diff(bucket, prepend=-1))[0]
    rows = []
    for a, b in zip(first, np.append(first[1:], len(bucket))):
        own = order[a:b]
        sent = _pack_sorted(_short(keys[own])) if short else keys[own].tobytes()
        rows.append({"bucket": bucket[a], "block": block, "n": b - a, "keys": sent, **{k: _pack(v[own]) for k, v in columns.items()}})
    return pd.DataFrame(rows, columns=["bucket", "block", "n", "keys", "counts", "contexts", "lo", "hi", "low"])


def send_keys(table: DataFrame, buckets: int) -> DataFrame:
    """Each distinct key of a block once, with its number of documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                block, at = _open(row)
                keys, doc = block.keys(at), block.doc(at)
                order = np.lexsort((block.ids[doc], keys))
                keys, ids = keys[order], block.ids[doc[order]]
                new = np.ones(len(keys), bool)
                new[1:] = keys[1:] != keys[:-1]
                other = new.copy()
                other[1:] |= ids[1:] != ids[:-1]
                first = np.nonzero(new)[0]
                counts = np.add.reduceat(other, first, dtype=np.uint32) if len(first) else np.empty(0, np.uint32)
                yield _parcels(row.block, buckets, keys[first], short=True, counts=counts)

    return table.select("block", "texts", "ends", "ids", "anchors").mapInPandas(run, PARCEL)


def shared_keys(parcels: DataFrame, heavy: int) -> DataFrame:
    """For each block those of its keys that another document has, too; kind 1: heavy."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = [_unpack_sorted(k) for k in pdf["keys"]]
        keys, counts = np.concatenate(own), np.concatenate([_unpack(c, np.uint32) for c in pdf["counts"]]).astype(np.int64)
        found, place = np.unique(keys, return_inverse=True)
        total = np.bincount(place, counts, len(found))
        rows, at = [], 0
        for block, k in zip(pdf["block"], own):
            n = total[place[at : at + len(k)]]
            at += len(k)
            for kind, mine in ((0, (n > 1) & (n < heavy)), (1, (n > 1) & (n >= heavy))):
                if mine.any():
                    rows.append((block, kind, _pack_sorted(k[mine]), None, None))
        return pd.DataFrame(rows, columns=["block", "kind", "keys", "hashes", "smallest"])

    return parcels.groupBy("bucket").applyInPandas(run, ANSWER)


def _keys_of(answers: pd.DataFrame, kind: int) -> np.ndarray:
    return np.sort(np.concatenate([np.empty(0, np.uint64), *[_unpack_sorted(k) for k in answers.loc[answers["kind"] == kind, "keys"]]]))


def _among(keys: np.ndarray, some: np.ndarray) -> np.ndarray:
    short = _short(keys)
    at = np.minimum(np.searchsorted(some, short), max(0, len(some) - 1))
    return some[at] == short if len(some) else np.zeros(len(keys), bool)


def _sent(block: Block, at: np.ndarray, alone: bool):
    """What a block asks about the anchors ``at``: keys, contexts, first and last place,
    document, and where the context begins in the block. With ``alone`` each 50-byte
    string of the contexts is asked about by itself."""
    contexts, lo, hi = block.contexts(at)
    if not alone:
        return block.keys(at), contexts, lo, hi, block.doc(at), at - SPAN
    row, place, strings = strings_of(contexts, lo, hi)
    none = np.zeros(len(row), np.uint8)
    return string_keys(strings), strings, none, none, block.doc(at[row]), at[row] - SPAN + place


def send_contexts(table: DataFrame, shared: DataFrame, buckets: int) -> DataFrame:
    """Each distinct context of a block's shared keys once, with its smallest id."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in left.itertuples():
            block, at = _open(row)
            keys = block.keys(at)
            for kind in (0, 1):
                some = _keys_of(right, kind)
                mine = at[_among(keys, some)]
                if not len(mine):
                    continue
                k, contexts, lo, hi, doc, _ = _sent(block, mine, kind == 1)
                h, low = context_hash(contexts, lo, hi), block.ids[doc]
                order = np.lexsort((low, h, k))
                k, h = k[order], h[order]
                new = np.ones(len(k), bool)
                new[1:] = (k[1:] != k[:-1]) | (h[1:] != h[:-1])
                first = order[new]
                out.append(_parcels(row.block, buckets, k[new], contexts=contexts[first], lo=lo[first], hi=hi[first], low=low[first]))
        return pd.concat(out) if out else pd.DataFrame(columns=["bucket", "block", "n", "keys", "counts", "contexts", "lo", "hi", "low"])

    return table.select("block", "texts", "ends", "ids", "anchors").groupBy("block").cogroup(shared.groupBy("block")).applyInPandas(run, PARCEL)


def answer(parcels: DataFrame, slice_rows: int) -> DataFrame:
    """The smallest id of every 50-byte string of the contexts, for each block."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        join = lambda name, dtype: np.concatenate([_unpack(x, dtype) for x in pdf[name]])
        keys = np.frombuffer(b"".join(pdf["keys"]), np.uint64)
        lo, hi, low = join("lo", np.uint8), join("hi", np.uint8), join("low", np.int64)
        contexts = join("contexts", np.uint8).reshape(-1, CONTEXT)
        h = context_hash(contexts, lo, hi)
        order = np.lexsort((low, h, keys))
        new_key, new = np.ones(len(order), bool), np.ones(len(order), bool)
        new_key[1:] = keys[order[1:]] != keys[order[:-1]]
        new[1:] = new_key[1:] | (h[order[1:]] != h[order[:-1]])
        first = order[new]
        class_of = np.empty(len(order), np.int64)
        class_of[order] = np.cumsum(new) - 1
        # a key's only context is the only holder of its strings
        places = np.arange(SPAN + 1)
        out = np.where((places >= lo[first, None]) & (places <= hi[first, None]), low[first, None], _TOP)
        starts = np.nonzero(new_key[new])[0]
        sizes = np.diff(starts, append=len(first))
        several = np.nonzero(np.repeat(sizes > 1, sizes))[0]
        edges = np.concatenate([[0], np.cumsum(sizes[sizes > 1])])
        a = 0
        while a < len(edges) - 1:
            b = max(a + 1, int(np.searchsorted(edges, edges[a] + slice_rows, "right")) - 1)
            mine = several[edges[a] : edges[b]]
            own = first[mine]
            out[mine] = smallest_ids(contexts[own], lo[own], hi[own], low[own])
            a = b
        rows, at = [], 0
        for block, n in zip(pdf["block"], pdf["n"]):
            own = slice(at, at + n)
            at += n
            rows.append((block, 2, keys[own].tobytes(), h[own].tobytes(), _pack(out[class_of[own]])))
        return pd.DataFrame(rows, columns=["block", "kind", "keys", "hashes", "smallest"])

    return parcels.groupBy("bucket").applyInPandas(run, ANSWER)


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _removed(block: Block, at: np.ndarray, answers: pd.DataFrame) -> np.ndarray:
    """Which bytes of the block go."""
    begins = np.zeros(block.n + 1, bool)
    told = answers[answers["kind"] == 2]
    if len(told):
        k = np.concatenate([np.frombuffer(x, np.uint64) for x in told["keys"]])
        h = np.concatenate([np.frombuffer(x, np.uint64) for x in told["hashes"]])
        smallest = np.concatenate([_unpack(x, np.int64) for x in told["smallest"]]).reshape(-1, SPAN + 1)
        joint = k * _ODD[13] + h
        order = np.argsort(joint)
        k, h, joint = k[order], h[order], joint[order]
        keys = block.keys(at)
        for kind in (0, 1):
            some = _keys_of(answers, kind)
            mine = at[_among(keys, some)]
            if not len(mine):
                continue
            own, contexts, lo, hi, doc, origin = _sent(block, mine, kind == 1)
            hashes = context_hash(contexts, lo, hi)
            wanted = own * _ODD[13] + hashes
            place = np.minimum(np.searchsorted(joint, wanted), len(joint) - 1)
            ok = (k[place] == own) & (h[place] == hashes)
            row, offset = np.nonzero(smallest[order[place]] < np.where(ok, block.ids[doc], np.iinfo(np.int64).min)[:, None])
            begins[origin[row] + offset] = True
    count = np.cumsum(begins, dtype=np.int64)[: block.n]
    count[LENGTH:] -= count[:-LENGTH].copy()
    return count > 0


def take_out(table: DataFrame, answers: DataFrame) -> DataFrame:
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in left.itertuples():
            block, at = _open(row)
            gone = _removed(block, at, right)
            total = np.concatenate([[0], np.cumsum(gone)])
            opens = gone.copy()
            opens[1:] &= ~gone[:-1]
            inner = block.starts[(block.starts < block.n) & (block.ends > block.starts)]
            opens[inner] = gone[inner]
            spans = np.concatenate([[0], np.cumsum(opens)])
            data, kept = block.buffer[SPAN : SPAN + block.n], []
            for s, e in zip(block.starts.tolist(), block.ends.tolist()):
                part = data[s:e] if total[s] == total[e] else data[s:e][~gone[s:e]]
                kept.append(hashlib.sha256(part.tobytes()).hexdigest())
            ids = pd.array(block.ids, "Int64")
            ids[_unpack(row.known, np.uint8) == 0] = pd.NA
            out.append(pd.DataFrame({"doc_id": ids, "n_bytes": block.ends - block.starts, "n_removed": total[block.ends] - total[block.starts], "n_spans": spans[block.ends] - spans[block.starts], "kept_sha256": kept}))
        return pd.concat(out) if out else pd.DataFrame(columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    left = table.select("block", "texts", "ends", "ids", "known", "anchors").groupBy("block")
    return left.cogroup(answers.groupBy("block")).applyInPandas(run, RESULT)


def repeated_bytes(docs: DataFrame, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES, heavy: int = HEAVY, slice_rows: int = SLICE) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``.

    Texts are UTF-8 bytes; null counts as empty. Texts below 50 bytes lose nothing; a
    very long text is a block of its own. Contexts of a key that are equal byte for byte
    (by two 64-bit hashes) count as one before the sort.
    Of rows with equal texts, those with the smallest doc_id stay whole; repeated
    doc_ids never remove from each other; a null doc_id ranks above all others and
    keeps its row. An empty table gives no rows; further columns are ignored."""
    spark = docs.sparkSession
    table = common.cut_by(blocks(docs, block_bytes), "block")
    total = table.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // bucket_bytes))
    shared = common.cut(shared_keys(send_keys(table, buckets), heavy))
    told = answer(send_contexts(table, shared, buckets), slice_rows)
    return take_out(table, told.unionByName(shared))


def op3_suffixes(spark, sf_dir: str) -> DataFrame:
    """Bytes of every document that a document with a smaller id repeats."""
    return repeated_bytes(common.table(spark, sf_dir, "documents"))
