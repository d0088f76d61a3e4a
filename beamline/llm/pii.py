"""Personal data: patterns, and terms that disclose the protected values.

Patterns find e-mail addresses, IPv4 addresses, card and phone numbers. Each
distinct value found is a protected entity. Every other word of a document that
mentions it is weighed by what the corpus says of it: with N documents, n(e) of them
holding the entity, n(t) the term and n(e, t) both,

    PMI(e; t) = log2(N * n(e, t) / (n(e) * n(t)))    and    IC(e) = log2(N / n(e)),

so PMI / IC is the part of the entity's information that the term gives away. For
n(e, t) / n(t), the part of the term's documents that hold the entity, the lower end
of its confidence interval stands, so a term in few documents needs more to be
flagged. What one or two documents have in common is no evidence at any size of the
corpus, as nearly every rare word would give away a rare entity: n(e, t) is ``TOGETHER``
at least. A term at or above the disclosure threshold is generalised to a placeholder
(or removed) at every occurrence in every document, as the entity is.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
#: Part of an entity's information from which a term counts as disclosing it.
DISCLOSURE = 0.8
#: Standard errors of the lower bound of a term's estimate (95 % on one side).
CONFIDENCE = 1.645
#: Documents that hold a term and an entity, from which on the term is judged.
TOGETHER = 3
#: Pairs of a document that one key of the join forms; more are split by entities.
PAIRS = 1 << 20
#: Filter that the flagged terms are told by before they are joined: bits for each, bits
#: that are set for each, and the most bits (16 MB; more terms then pass it in vain).
BITS_A_TERM, PROBES, MAX_BITS = 24, 4, 1 << 27
CACHE = 400_000
PLACEHOLDER = {"email": "<EMAIL>", "ip": "<IP>", "card": "<CARD>", "phone": "<PHONE>", TERM: "<TERM>"}

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_CHAIN = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_PART = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\W_]+")
_NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Matches found from each ``@``: the run of local characters before it, as far
    as the last match leaves it, and the domain after it. Linear in the text."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and _LOCAL.match(text[start - 1]):
            start -= 1
        floor = at + 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            floor = m.end()
        at = text.find("@", floor)
    return out


def ips(text: str) -> list[tuple[int, int]]:
    out = []
    for chain in _CHAIN.finditer(text):
        parts = list(_PART.finditer(text, chain.start(), chain.end()))
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            if all(len(p[0].lstrip("0")) <= 3 and int(p[0][-4:]) <= 255 for p in four):
                out.append((four[0].start(), four[3].end()))
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of each kind, in code points, end exclusive."""
    spans = {k: [] for k in KINDS}
    if "@" in text:
        spans["email"] = emails(text)
    if re.search("[0-9]", text):
        spans["ip"] = ips(text)
        for m in _CARD.finditer(text):
            digits = _NOT_DIGIT.sub("", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                spans["card"].append(m.span())
        if "+" in text:
            spans["phone"] = [m.span() for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return spans


def entity(kind: str, value: str) -> int:
    """Digest of a protected value, written alike wherever it occurs."""
    plain = value.lower() if kind == "email" else value if kind == "ip" else _NOT_DIGIT.sub("", value)
    return xxhash.xxh64_intdigest(f"{kind}:{plain}") - (1 << 63)


class Terms(dict):
    """Word -> digest of its lower case, computed on the first use."""

    def __missing__(self, word: str) -> int:
        if len(self) > CACHE:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word.lower()) - (1 << 63)
        return value


def other_words(text: str, spans: dict[str, list[tuple[int, int]]]) -> Iterator[re.Match]:
    """The words of a text that no span touches."""
    taken: list[list[int]] = []
    for s, e in sorted(x for v in spans.values() for x in v):
        if taken and s <= taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], e)
        else:
            taken.append([s, e])
    k = 0
    for m in _WORD.finditer(text):
        while k < len(taken) and taken[k][1] <= m.start():
            k += 1
        if k == len(taken) or m.end() <= taken[k][0]:
            yield m


def distinct_words(text: str, spans: dict[str, list[tuple[int, int]]]) -> set[str]:
    return {m[0] for m in other_words(text, spans)} if any(spans.values()) else set(_WORD.findall(text))


COUNTED = "entities array<long>, terms array<long>, term long, docs long"


def count_terms(docs: DataFrame) -> DataFrame:
    """A row for each document with entities (these and its terms, each once), and for
    each batch its terms with their document counts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        digest = common.held("terms", Terms)
        for pdf in batches:
            counts, rows = Counter(), []
            for text in pdf["text"]:
                spans = base_spans(text or "")
                terms = {digest[w] for w in distinct_words(text or "", spans)}
                counts.update(terms)
                if any(spans.values()):
                    rows.append((list({entity(k, text[s:e]) for k, found in spans.items() for s, e in found}), list(terms), None, None))
            types = {"entities": object, "terms": object, "term": "Int64", "docs": "Int64"}
            for part in (rows, [(None, None, t, c) for t, c in counts.items()]):  # apart: beside nulls pandas makes floats of long
                yield pd.DataFrame(part, columns=list(types)).astype(types)

    return docs.select("text").mapInPandas(run, COUNTED)


def disclosing_terms(seen: DataFrame, n_docs: int, disclosure: float = DISCLOSURE, confidence: float = CONFIDENCE, together: int = TOGETHER) -> DataFrame:
    """Terms ``t`` of which some entity's PMI is ``disclosure`` of its information or more.

    ``seen`` is what ``count_terms`` gives. With p for the part of a term's documents
    that hold the entity, PMI >= disclosure * IC says p >= (n_e / N) ** (1 - disclosure).
    Since p is n_e / n_t at most, a term in more documents than n_e ** disclosure *
    N ** (1 - disclosure) cannot be flagged, and its pairs are not formed, nor are those
    of terms and entities in fewer than ``together`` documents. An entity that every
    document holds has no information to give away. A document's pairs are split over
    keys of ``PAIRS`` at most (or one entity's), so none is one task's; they are counted
    before they move."""
    n = F.lit(float(n_docs))
    keys = F.least(F.size("entities"), F.ceil(F.size("entities").cast("long") * F.size("terms") / PAIRS)).cast("int")
    held = common.cut(seen.where("term is null").select(F.monotonically_increasing_id().alias("row"), F.greatest(F.lit(1), keys).alias("keys"), "entities", "terms"))
    mentions = held.select("row", "keys", F.posexplode("entities").alias("k", "e")).select("row", (F.col("k") % F.col("keys")).alias("key"), "e")
    n_e = mentions.groupBy("e").agg(F.count("*").alias("n_e")).where((F.col("n_e") >= together) & (F.col("n_e") < n))
    most = F.pow(F.col("n_e").cast("double"), F.lit(disclosure)) * F.pow(n, F.lit(1 - disclosure)) * F.lit(1 + 1e-9)
    n_e = common.cut(n_e.withColumn("most", most))
    bound = n_e.agg(F.max("most")).first()[0] or 0.0
    n_t = seen.where("term is not null").groupBy(F.col("term").alias("t")).agg(F.sum("docs").alias("n_t")).where(F.col("n_t").between(F.lit(together), F.lit(bound)))
    terms = held.select("row", "keys", F.explode("terms").alias("t")).join(n_t, "t")
    terms = terms.select("row", F.explode(F.sequence(F.lit(0), F.col("keys") - 1)).alias("key"), "t", "n_t")
    pairs = terms.join(mentions.join(n_e, "e"), ["row", "key"]).where(F.col("n_t") <= F.col("most"))
    pairs = pairs.groupBy("e", "t", "n_e", "n_t").agg(F.count("*").alias("n_et")).where(F.col("n_et") >= together)
    p, z2 = F.col("n_et") / F.col("n_t"), F.lit(confidence**2)
    spread = F.lit(confidence) * F.sqrt(p * (1 - p) / F.col("n_t") + z2 / (4 * F.col("n_t") * F.col("n_t")))
    low = (p + z2 / (2 * F.col("n_t")) - spread) / (1 + z2 / F.col("n_t"))
    return pairs.where(low >= F.pow(F.col("n_e") / n, F.lit(1 - disclosure))).select("t").distinct()


MARKED = "doc_id long, row long, spans string, n array<long>, base_sha256 string, near array<struct<t:long,s:int,z:int>>"


def filter_bits(n_terms: int) -> int:
    """Bits of the filter that tells flagged terms: a power of two, up to ``MAX_BITS``."""
    return min(MAX_BITS, 1 << max(16, (BITS_A_TERM * n_terms - 1).bit_length()))


def places(digests: np.ndarray, bits: int) -> np.ndarray:
    """The ``PROBES`` bits of each term, as rows."""
    low, high = digests & 0x7FFFFFFF, (digests.view(np.uint64) >> np.uint64(33)).astype(np.int64) | 1
    return (low + np.arange(PROBES)[:, None] * high) & (bits - 1)


def term_filter(flagged: DataFrame) -> np.ndarray:
    """Bloom filter of the flagged terms, as 64-bit words. The bits are gathered in Spark;
    only the words of the filter come to the driver."""
    bits = filter_bits(flagged.count())
    low, high = F.col("t").bitwiseAND(F.lit(0x7FFFFFFF)), F.shiftrightunsigned("t", 33).bitwiseOR(F.lit(1).cast("long"))
    at = F.explode(F.array(*[(low + high * k).bitwiseAND(F.lit(bits - 1)) for k in range(PROBES)]))
    words = flagged.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out.view(np.uint64)


def may_be_flagged(words: list[str], digest: Terms, found: np.ndarray) -> set[str]:
    """The words whose bits are all in the filter."""
    own = np.fromiter(map(digest.__getitem__, words), np.int64, len(words))
    at = places(own, 64 * len(found))
    hit = ((found[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).all(axis=0)
    return {words[k] for k in np.flatnonzero(hit).tolist()}


def mark(docs: DataFrame, flagged: DataFrame) -> DataFrame:
    """A row for each document: its base spans, and the places of the words that pass the
    filter of the flagged terms."""
    shared = docs.sparkSession.sparkContext.broadcast(term_filter(flagged))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        digest, found = common.held("terms", Terms), shared.value
        any_set = bool(found.any())
        for pdf in batches:
            for at in range(0, len(pdf), common.ROWS):
                part = pdf.iloc[at : at + common.ROWS]
                texts = [t or "" for t in part["text"]]
                own = [set(_WORD.findall(t)) for t in texts] if any_set else [set()] * len(texts)
                wanted, rows = may_be_flagged(list(set().union(*own)), digest, found), []
                for doc_id, row, text, words in zip(part["doc_id"], part["row"], texts, own):
                    spans, near = base_spans(text), []
                    base = ",".join(f"{k}:{s}:{e}" for k in KINDS for s, e in spans[k])
                    words &= wanted
                    if words:
                        near = [(digest[m[0]], m.start(), m.end()) for m in other_words(text, spans) if m[0] in words]
                    rows.append((doc_id, row, base, [len(spans[k]) for k in KINDS], hashlib.sha256(base.encode()).hexdigest(), near))
                types = {"doc_id": "Int64", "row": "Int64", "spans": object, "n": object, "base_sha256": object, "near": object}
                yield pd.DataFrame(rows, columns=list(types)).astype(types)

    return docs.select(F.col("doc_id").cast("long"), "row", "text").mapInPandas(run, MARKED)


def _found(rows: DataFrame, disclosure: float, confidence: float, together: int) -> DataFrame:
    """``detect`` for ``rows(doc_id, row, text)``, with the ``row``."""
    flagged = common.cut(disclosing_terms(common.cut(count_terms(rows)), rows.count(), disclosure, confidence, together))
    per_doc = common.cut(mark(rows, flagged))
    near = per_doc.where("size(near) > 0").select("row", F.explode("near").alias("x")).select("row", "x.*")
    more = near.join(flagged, "t").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("s", "z"))).alias("extra"))
    extra = F.expr(f"array_join(transform(extra, x -> concat('{TERM}:', x.s, ':', x.z)), ',')")
    return per_doc.join(more, "row", "left").select(
        "row", "doc_id",
        *[F.col("n")[i].alias(f"n_{k}") for i, k in enumerate(KINDS)],
        "base_sha256",
        F.when(F.col("extra").isNull(), F.col("spans")).otherwise(F.concat_ws(",", F.when(F.col("spans") != "", F.col("spans")), extra)).alias("spans"),
    )


def detect(docs: DataFrame, disclosure: float = DISCLOSURE, confidence: float = CONFIDENCE, together: int = TOGETHER) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_email, n_ip, n_card, n_phone,
    base_sha256, spans``.

    ``spans`` lists base spans as ``kind:start:end`` by kind and start, then every
    occurrence of a disclosing term, whether the document holds the entity or not. A
    null text counts as empty; a very long one is searched whole; an empty list is the
    empty string; repeated rows and null doc_ids each keep their row; an empty table
    gives no rows; further columns are ignored."""
    rows = docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    return _found(rows, disclosure, confidence, together).drop("row")


def sanitise_text(text: str | None, spans: str | None, remove_terms: bool = False) -> str | None:
    """The text with every span generalised to its placeholder; overlapping spans
    merge under the kind that starts first. With ``remove_terms``, disclosing terms
    are removed instead."""
    if not text or not spans:
        return text
    found = sorted((int(s), int(e), k) for k, s, e in (x.split(":") for x in spans.split(",")))
    out, at = [], 0
    for s, e, kind in found:
        if s >= at:
            out += [text[at:s], "" if remove_terms and kind == TERM else PLACEHOLDER[kind]]
        at = max(at, e)
    return "".join(out) + text[at:]


def sanitise(docs: DataFrame, disclosure: float = DISCLOSURE, confidence: float = CONFIDENCE, together: int = TOGETHER, remove_terms: bool = False) -> DataFrame:
    """``docs`` with every span that ``detect`` finds generalised in their texts.

    Spans belong to a row, not to a doc_id: the rows are numbered in a written copy, so
    null and repeated doc_ids are safe. All other columns keep their values."""
    number = common.free_name(docs, "row_number")

    @F.pandas_udf("string")
    def clean(text: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([sanitise_text(t, s, remove_terms) for t, s in zip(text, found)])

    rows = common.cut(docs.withColumn(number, F.monotonically_increasing_id()))
    found = _found(rows.select("doc_id", F.col(number).alias("row"), "text"), disclosure, confidence, together).where("spans <> ''")
    found = found.select(F.col("row").alias(f"{number}_found"), F.col("spans").alias(f"{number}_spans"))
    joined = rows.join(found, F.col(number) == F.col(f"{number}_found"), "left")
    text = F.when(F.col(f"{number}_spans").isNull(), F.col("text")).otherwise(clean("text", f"{number}_spans"))
    return joined.withColumn("text", text).select(*docs.columns)


def op9_pii(spark, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    return detect(common.table(spark, sf_dir, "documents"))
