"""Token-id output in binary shards under Re-Pair grammar compression.

Texts are encoded with a public byte-level BPE vocabulary, laid out in ascending
doc_id order and cut into shards. Within a shard the most frequent pairs of
adjacent ids are replaced by new symbols (nonterminals) until no pair occurs often
enough to pay for its rule; the rules and the expanded length of every symbol are
stored, so one document, or one range of its ids, is decoded without the rest of
the shard.

A shard is one row of a Parquet table: ``part, shard, first, n_ids, doc_ids, blob``.
The blob's layout (little endian): 8 bytes of magic; u32 version, number of
documents, ids, symbols and rules, first nonterminal, bits of a symbol; u32 end of
each document in the symbol sequence; u32 number of ids of each document; u32
expanded length of each rule; the rules (all left, then all right sides) and then
the symbols, packed to the stated number of bits each.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

END_ID = 2
MAGIC = b"BLREPAIR"
#: Ids in a shard before it is closed.
SHARD_IDS = 2_000_000
#: A round of Re-Pair takes the pairs that occur at least 1 / SPREAD as often as the
#: most frequent one.
SPREAD = 32
#: Bits that hold the expanded length of a rule.
LENGTH_BITS = 32
#: Rules of at most this length are expanded ahead, longer ones when they are met.
SHORT_RULE = 64
#: Cached pieces of text per worker; a text with a longer piece is encoded whole.
CACHE = 1_000_000
#: Pieces given to the library at once, and characters split at once.
ENCODE = 4096
CHARS = 1 << 20
LONG_PIECE = 1000


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# --- encoding ---------------------------------------------------------------

LETTER, DIGIT, SPACE, OTHER, ODD = range(5)


def _kinds() -> np.ndarray:
    """Kind of each character of the basic plane, and of all beyond it at the end.

    ``ODD`` are those on which Python's and the tokenizer's character classes may
    differ: numbers that are no decimal digits, the four separators U+001C to U+001F,
    unassigned ones, and whatever lies beyond the basic plane."""
    out = np.full((1 << 16) + 1, OTHER, np.uint8)
    of = {"L": LETTER, "Nd": DIGIT, "Nl": ODD, "No": ODD, "Cn": ODD}
    for c in range(1 << 16):
        kind = unicodedata.category(chr(c))
        out[c] = SPACE if chr(c).isspace() else of.get(kind, of.get(kind[0], OTHER))
    out[0x1C:0x20] = ODD
    out[-1] = ODD
    return out


class Encoder:
    """Whole-text encoding by the tokenizers library, through a cache of pieces.

    The vocabulary's pre-tokenizer breaks a text between any character and white
    space after it, and between letters, digits and other characters, unless the
    other is an apostrophe with letters after it; so a text is the concatenation of
    such pieces, white space staying with what follows, and each distinct piece is
    encoded once by the library. Characters are classified and pieces told apart for
    many texts at once. Texts with characters that the classes treat differently,
    with the text of a special token or with a very long piece are encoded in one
    go."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kinds = _kinds()
        self.widths = np.zeros(self.vocabulary, np.int64)  # bytes of each id
        for token, k in self.tokenizer.get_vocab().items():
            self.widths[k] = len(token)
        self.dtype, self.code = (np.uint16, "H") if self.vocabulary <= 1 << 16 else (np.uint32, "I")
        self.reset()

    def reset(self) -> None:
        """An empty cache: piece -> number, and the ids of the numbered pieces."""
        self.place: dict[str, int] = {}
        self.sizes, self.flat = array("H"), array(self.code)

    def library(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids if text else [], self.dtype)

    def starts(self, codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where pieces start in ``codes``, and which characters are odd; ``first``
        are the starts of texts."""
        kind = self.kinds[np.minimum(codes, 1 << 16)]
        breaks = np.empty(len(codes), bool)
        breaks[1:] = (kind[1:] != kind[:-1]) & (kind[:-1] != SPACE)
        breaks[1:] &= (codes[:-1] != 39) | (kind[1:] != LETTER)
        breaks[first] = True
        return np.flatnonzero(breaks), kind == ODD

    def numbers(self, pieces: pa.Array) -> np.ndarray:
        """Number of each piece in the cache; -1 for a long one."""
        told = pieces.dictionary_encode()
        words = told.dictionary.to_numpy(zero_copy_only=False).tolist()
        own = np.fromiter(map(self.place.get, words, repeat(-2)), np.int64, len(words))
        new = np.flatnonzero(own == -2)
        width = np.fromiter((len(words[k]) for k in new.tolist()), np.int64, len(new))
        own[new[width > LONG_PIECE]] = -1
        new = new[width <= LONG_PIECE]
        own[new] = len(self.place) + np.arange(len(new))
        fresh = [words[k] for k in new.tolist()]
        self.place.update(zip(fresh, range(len(self.place), len(self.place) + len(fresh))))
        for k in range(0, len(fresh), ENCODE):
            self.add(fresh[k : k + ENCODE])
        return own[told.indices.to_numpy()]

    def add(self, pieces: list[str]) -> None:
        """Ids of new pieces. The library takes all as one row of words; the bytes
        that ids and pieces stand for tell the pieces' ids apart."""
        ids = np.array(self.tokenizer.encode_batch_fast([pieces], is_pretokenized=True, add_special_tokens=False)[0].ids, self.dtype)
        reach = np.cumsum(self.widths[ids])
        ends = np.cumsum(np.fromiter((len(p.encode()) for p in pieces), np.int64, len(pieces)))
        last = np.searchsorted(reach, ends)
        if not np.array_equal(reach[np.minimum(last, len(reach) - 1)], ends):
            raise ValueError("the vocabulary's ids do not stand for the bytes of the text")
        self.sizes.frombytes(np.diff(last, prepend=-1).astype(np.uint16).tobytes())
        self.flat.frombytes(ids.tobytes())

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        out, lot, held = [], [], 0  # lots keep the work on characters small
        for text in texts:
            lot.append(text)
            held += len(text)
            if held >= CHARS:
                out += self._encode(lot)
                lot, held = [], 0
        return out + self._encode(lot)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.place) > CACHE:
            self.reset()
        joined = "".join(texts)
        if not joined:
            return [np.empty(0, self.dtype) for _ in texts]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(lengths)
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        at, odd = self.starts(codes, (ends - lengths)[lengths > 0])
        data = joined.encode()
        offsets = np.append(at, len(codes))
        if len(data) > len(codes):
            width = 1 + (codes > 0x7F) + (codes > 0x7FF).astype(np.int8) + (codes > 0xFFFF)
            offsets = np.append(0, np.cumsum(width, dtype=np.int64))[offsets]
        pieces = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])
        mine = self.numbers(pieces)
        if not len(self.flat):
            return [self.library(t) for t in texts]
        sizes, flat = np.frombuffer(self.sizes, np.uint16), np.frombuffer(self.flat, self.dtype)
        starts = np.cumsum(sizes, dtype=np.int64) - sizes
        n = np.where(mine < 0, 0, sizes[mine]).astype(np.int64)
        to = np.cumsum(n)
        ids = flat[np.repeat(starts[mine] - (to - n), n) + np.arange(to[-1])]
        last = np.append(0, to)[np.searchsorted(at, ends)].tolist()
        whole = {int(k) for k in np.searchsorted(ends, np.concatenate([np.flatnonzero(odd), at[mine < 0]]), "right")}
        if any(s in joined for s in self.special):
            whole |= {k for k, t in enumerate(texts) if any(s in t for s in self.special)}
        first, out = 0, []
        for k, end in enumerate(last):
            out.append(self.library(texts[k]) if k in whole else ids[first:end])
            first = end
        return out


def encoder(path: str) -> Encoder:
    """The worker's encoder; its cache outlives a task."""
    return common.held(("tokens", path), lambda: Encoder(path))


# --- grammar ------------------------------------------------------------------


def _pairs(seq: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The pairs that start at the ``live`` positions: the positions grouped by pair and
    ascending, the first place of each group, the pairs as two columns, and how often
    each pair can be replaced."""
    bits, wide = int(seq.max()).bit_length(), len(seq).bit_length()
    where = np.flatnonzero(live)
    if 2 * bits + wide <= 64:  # one sort of pair and position together
        packed = seq[where].astype(np.uint64)
        packed <<= np.uint64(bits)
        packed |= seq[where + 1]
        packed <<= np.uint64(wide)
        packed |= where.view(np.uint64)
        packed.sort()
        change = np.append(True, packed[1:] ^ packed[:-1] >= np.uint64(1 << wide))
        packed &= np.uint64((1 << wide) - 1)
        where = packed.view(np.int64)
    else:
        key = (seq[where].astype(np.uint64) << np.uint64(32)) | seq[where + 1]
        order = np.argsort(key, kind="stable")
        key, where = key[order], where[order]
        change = np.append(True, key[1:] != key[:-1])
    first = np.flatnonzero(change)
    sizes = np.diff(first, append=len(where))
    pairs = np.stack([seq[where[first]], seq[where[first] + 1]], axis=1)
    counts = sizes.copy()
    # a symbol beside itself: of a run of overlapping pairs every second one counts
    same = np.flatnonzero(pairs[:, 0] == pairs[:, 1])
    if len(same):
        n = sizes[same]
        own = where[np.repeat(first[same] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        group = np.repeat(np.arange(len(same)), n)
        run = np.flatnonzero((np.diff(own, prepend=-2) != 1) | (np.diff(group, prepend=-1) != 0))
        counts[same] = np.bincount(group[run], (np.diff(run, append=len(own)) + 1) // 2).astype(np.int64)
    return where, first, pairs, counts


def _places(seq: np.ndarray, where: np.ndarray, first: np.ndarray, sizes: np.ndarray, counts: np.ndarray, chosen: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places where the chosen pairs are replaced: ``(places, pair of each, pairs kept)``.

    Where two of them overlap, the more frequent pair has the place, so that every
    copy of a passage is cut alike and the most frequent pair keeps its count. A pair
    that is left less than ``least`` occurrences is not replaced."""
    order = chosen[np.lexsort((chosen * 0x9E3779B1 & 0xFFFFFFFF, counts[chosen]))]
    n = sizes[order]
    mark = np.zeros(len(seq), np.int32)  # rank of the pair that starts here, from 1
    mark[where[np.repeat(first[order] - (np.cumsum(n) - n), n) + np.arange(n.sum())]] = np.repeat(np.arange(1, len(order) + 1), n)
    at = np.flatnonzero(mark)
    rank = mark[at]
    # of a run of one pair that overlaps itself, every second one from the left
    turn = np.arange(len(at))
    turn -= np.maximum.accumulate(np.where((np.diff(at, prepend=-2) != 1) | (np.diff(rank, prepend=0) != 0), turn, 0))
    at, rank = at[turn % 2 == 0], rank[turn % 2 == 0]
    taken = []
    while len(at):
        beside = np.diff(at) == 1
        wins = np.ones(len(at), bool)
        wins[1:] &= ~beside | (rank[1:] > rank[:-1])
        wins[:-1] &= ~beside | (rank[:-1] > rank[1:])
        taken.append((at[wins], rank[wins]))
        rest = ~wins
        rest[1:] &= ~(beside & wins[:-1])
        rest[:-1] &= ~(beside & wins[1:])
        at, rank = at[rest], rank[rest]
    at, rank = (np.concatenate(x) for x in zip(*taken))
    found = np.bincount(rank, minlength=len(order) + 1)
    keep = found >= least
    name = np.cumsum(keep) - 1
    own = keep[rank]
    return at[own], name[rank[own]], order[keep[1:]]


def re_pair(ids: np.ndarray, joins: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Replace frequent pairs of ``ids`` by symbols from ``base`` on.

    ``joins[i]`` says that position i may pair with i + 1 (false at the end of a
    document). A round counts all pairs and replaces those that occur at least
    1 / SPREAD as often as the most frequent; a pair that more frequent ones leave too
    few occurrences waits for the next round. It ends when no pair pays for its rule:
    a rule costs two symbols and its length, each occurrence saves a symbol. Returns
    the symbols, their joins, the rules as two columns and their expanded lengths."""
    seq, joins = ids.astype(np.uint32), joins.copy()
    live = joins.copy()
    live[-1:] = False
    rules, lengths, n_rules = [np.empty((0, 2), np.uint32)], [np.empty(0, np.int64)], 0
    size = np.ones(base, np.int64)
    while live.any():
        where, first, pairs, counts = _pairs(seq, live)
        width = (base + n_rules).bit_length()
        pays = (2 * width + LENGTH_BITS) // width + 1
        top = int(counts.max())
        if top < pays:
            break
        sizes = np.diff(first, append=len(where))
        live[where[np.repeat(counts < pays, sizes)]] = False  # until a neighbour changes
        least = max(pays, -(-top // SPREAD))
        at, pair, kept = _places(seq, where, first, sizes, counts, np.flatnonzero(counts >= least), least)
        rules.append(pairs[kept])
        lengths.append(size[rules[-1]].sum(axis=1))
        size = np.concatenate([size, lengths[-1]])
        seq[at] = (base + n_rules + pair).astype(np.uint32)
        n_rules += len(kept)
        joins[at] = joins[at + 1]
        live[at] = joins[at]
        before = at[at > 0] - 1
        live[before] = joins[before]
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        keep = np.flatnonzero(keep)
        seq, joins, live = seq[keep], joins[keep], live[keep]
        live[-1:] = False
    return seq, joins, np.concatenate(rules), np.concatenate(lengths)


def pack(values: np.ndarray, bits: int) -> bytes:
    """Numbers of ``bits`` bits each, low bits first, in lots of eight."""
    out, lot = [], 1 << 16
    for at in range(0, len(values), lot):
        raw = values[at : at + lot].astype("<u4").view(np.uint8).reshape(-1, 4)
        out.append(np.packbits(np.unpackbits(raw, axis=1, bitorder="little")[:, :bits], bitorder="little").tobytes())
    return b"".join(out)


def unpack(data: bytes, at: int, n: int, bits: int, first: int = 0) -> np.ndarray:
    """``n`` packed numbers from number ``first`` on."""
    lead = first % 8
    begin = at + (first - lead) * bits // 8
    out, lot = np.empty(n + lead, np.uint32), 1 << 16
    for k in range(0, n + lead, lot):
        own = min(lot, n + lead - k)
        raw = np.unpackbits(np.frombuffer(data, np.uint8, -(-own * bits // 8), begin + k * bits // 8), bitorder="little")[: own * bits].reshape(own, bits)
        wide = np.zeros((own, 32), np.uint8)
        wide[:, :bits] = raw
        out[k : k + own] = np.packbits(wide, axis=1, bitorder="little").view("<u4").reshape(-1)
    return out[lead:]


def write_shard(docs: list[np.ndarray], base: int) -> bytes:
    """One shard of documents' ids (end ids included)."""
    sizes = np.array([len(d) for d in docs], np.int64)
    ids = np.concatenate(docs) if docs else np.empty(0, np.uint32)
    joins = np.ones(len(ids), bool)
    ends = np.cumsum(sizes)
    joins[ends[sizes > 0] - 1] = False
    seq, left, rules, lengths = re_pair(ids, joins, base)
    symbol_ends = np.flatnonzero(~left) + 1
    bits = max(1, (base + len(rules)).bit_length())
    head = np.array([2, len(docs), len(ids), len(seq), len(rules), base, bits], "<u4")
    return b"".join(
        [MAGIC, head.tobytes()]
        + [x.astype("<u4").tobytes() for x in (symbol_ends, sizes, lengths)]
        + [pack(rules.T.reshape(-1), bits), pack(seq, bits)]
    )


class Shard:
    """Random access to the ids of one shard."""

    def __init__(self, blob: bytes):
        if blob[:8] != MAGIC:
            raise ValueError("no token shard")
        version, self.n_docs, self.n_ids, self.n_symbols, n_rules, self.base, self.bits = np.frombuffer(blob, "<u4", 7, 8).tolist()
        if version != 2:
            raise ValueError(f"version {version}")
        at, parts = 36, []
        for n in (self.n_docs, self.n_docs, n_rules):
            parts.append(np.frombuffer(blob, "<u4", n, at).astype(np.int64))
            at += 4 * n
        self.ends, self.sizes, self.lengths = parts
        self.left, self.right = unpack(blob, at, 2 * n_rules, self.bits).astype(np.int64).reshape(2, n_rules)
        self.blob, self.at = blob, at + -(-2 * n_rules * self.bits // 8)
        self.size = np.concatenate([np.ones(self.base, np.int64), self.lengths])
        # pool: all ids of the vocabulary, then the expansions of the short rules
        self.place = np.arange(self.base + n_rules)
        short = np.flatnonzero(self.lengths <= SHORT_RULE)
        n = self.lengths[short]
        self.place[self.base + short] = self.base + np.cumsum(n) - n
        self.pool = np.empty(self.base + int(n.sum()), "<u4")
        self.pool[: self.base] = np.arange(self.base)
        need, done = np.maximum(self.left[short], self.right[short]) - self.base, 0
        while done < len(short):  # rules in lots that refer to earlier lots only
            late = np.flatnonzero(need[done:] >= short[done])
            to = done + int(late[0]) if len(late) else len(short)
            own = short[done:to]
            for side, start in ((self.left[own], self.place[self.base + own]), (self.right[own], self.place[self.base + own] + self.size[self.left[own]])):
                n = self.size[side]
                step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                self.pool[np.repeat(start, n) + step] = self.pool[np.repeat(self.place[side], n) + step]
            done = to

    @property
    def symbols(self) -> np.ndarray:
        return self.between(0, self.n_symbols)

    def between(self, first: int, end: int) -> np.ndarray:
        return unpack(self.blob, self.at, end - first, self.bits, first).astype(np.int64)

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        n = self.size[symbols]
        to = np.cumsum(n) - n
        out = np.empty(int(n.sum()), "<u4")
        while len(symbols):
            long = n > SHORT_RULE
            short, own, put = self.place[symbols[~long]], n[~long], to[~long]
            step = np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own, own)
            out[np.repeat(put, own) + step] = self.pool[np.repeat(short, own) + step]
            rule, to = symbols[long] - self.base, to[long]
            left, right = self.left[rule], self.right[rule]
            symbols, to = np.concatenate([left, right]), np.concatenate([to, to + self.size[left]])
            n = self.size[symbols]
        return out

    def document(self, i: int) -> np.ndarray:
        """Ids of the i-th document, decoded alone."""
        return self.expand(self.between(int(self.ends[i - 1]) if i else 0, int(self.ends[i])))

    def all(self) -> np.ndarray:
        return self.expand(self.symbols)


# --- Spark ------------------------------------------------------------------------

_ARROW = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("blob", pa.binary())])
SHARDS = "part int, shard int, first long, n_ids long, doc_ids array<long>, blob binary"


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str | None = None, partitions: int | None = None, shard_ids: int = SHARD_IDS) -> None:
    """Encode whole texts and write shards in ascending doc_id order to ``path``.

    Documents are dealt out by ranges of doc_id, and where doc_ids repeat or are null
    by how their texts begin, and sorted by doc_id and text within them; a null doc_id
    comes first. A very long text is encoded whole and is a shard's last document."""
    spark = docs.sparkSession
    tokenizer_path = tokenizer_path or vocabulary()
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartitionByRange(n, "doc_id", F.substring("text", 1, 32)).sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, shard, first = encoder(tokenizer_path), TaskContext.get().partitionId(), 0, 0
        base = max(words.vocabulary, END_ID + 1)
        ids, docs, held = [], [], 0
        end = np.array([END_ID], words.dtype)

        def close() -> pa.RecordBatch:
            row = {"part": part, "shard": shard, "first": first, "n_ids": held, "doc_ids": ids, "blob": write_shard(docs, base)}
            common.release()
            return pa.RecordBatch.from_pylist([row], schema=_ARROW)

        for batch in common.slices(batches):
            for doc_id, own in zip(batch.column("doc_id").to_pylist(), words.encode(batch.column("text").to_pylist())):
                ids.append(doc_id)
                docs.append(np.append(own, end))
                held += len(own) + 1
                if held >= shard_ids:
                    yield close()
                    first, shard, ids, docs, held = first + held, shard + 1, [], [], 0
        if ids:
            yield close()

    rows.mapInArrow(run, SHARDS).write.parquet(path)


def read_tokens(spark, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document in the shards.

    ``start`` is the number of ids of all documents before it. Only the number of
    ids of each partition is summed ahead of the decoding."""
    shards = spark.read.schema(SHARDS).parquet(path)
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = parts.select(F.col("part"), F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rows = shards.join(F.broadcast(before), "part").select((F.col("before") + F.col("first")).alias("start"), "doc_ids", "blob")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start, doc_ids, blob in zip(pdf["start"], pdf["doc_ids"], pdf["blob"]):
                shard = Shard(blob)
                data, sizes = memoryview(shard.all().astype("<u4").tobytes()), shard.sizes
                ends = np.cumsum(sizes)
                crc = [zlib.crc32(data[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), sizes.tolist())]
                yield pd.DataFrame({"doc_id": pd.array(list(doc_ids), "Int64") if not isinstance(doc_ids, np.ndarray) or doc_ids.dtype == object else pd.array(doc_ids).astype("Int64"), "start": start + ends - sizes, "n_tokens": sizes, "ids_crc32": crc})

    return rows.mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write the shards of ``docs`` (to the shared scratch folder by default) and
    return what they hold, read back: one row per row of ``docs``. A null text is
    empty and gives the end id alone; an empty table gives no rows; columns other
    than doc_id and text are ignored."""
    path = path or common.scratch_dir(docs.sparkSession)
    write_tokens(docs, path, **options)
    return read_tokens(docs.sparkSession, path)


def op8_tokens(spark, sf_dir: str) -> DataFrame:
    """Start, length and checksum of the token ids of every document."""
    return token_output(common.table(spark, sf_dir, "documents"))
