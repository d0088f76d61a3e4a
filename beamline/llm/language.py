"""Language identification with a linear-chain conditional random field.

Every word of a text is a position of the chain; a run of more than ``PIECE``
letters, as scripts without spaces have, is several. A position's emission scores
sum the weights of its affixes, its character n-grams and its membership in the
lexicons of the languages; transitions between the languages of adjacent words are learned
too, so that code-switched text is labelled word by word. Forward-backward gives
the posterior of each word; a text's language is the one with the largest mean
posterior.
"""

from __future__ import annotations

import random
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .contamination import mixed

WORD = re.compile(r"[^\W\d_]+")
UND = "und"
#: Most letters of one position of the chain.
PIECE = 40
#: Labelled documents a language that the model is fitted on (the expected number),
#: documents of all languages, which many languages share, a language's least share of
#: them, and words of the window drawn from each of these documents.
DOCS_PER_LANGUAGE = 800
SAMPLE_DOCS = 64 * DOCS_PER_LANGUAGE
LEAST_SHARE = 20
WINDOW = 32
#: Hashed weight vectors; lexicon words a language; rounds of training.
BUCKETS = 1 << 16
LEXICON = 300
ROUNDS = 60
SEED = 11
#: Odd 64-bit factors of the characters of a feature, and of its kind.
_FACTORS = np.array([(0x9E3779B97F4A7C15 * (2 * k + 3) | 1) & ((1 << 64) - 1) for k in range(5)], np.uint64)
CACHE = 200_000
#: Scores (positions by languages) of the cache and of one step of training at most.
CELLS = 6_400_000
#: Least mean certainty of the words of a document that the pipeline keeps.
MIN_SCORE = 0.5
#: Words of a segment of the chain.
SEGMENT = 256
#: Words handled at once in forward-backward.
CHUNK_WORDS = 200_000


def crc_fold(doc_id) -> F.Column:
    """crc32 of the id as text, modulo 3: 1 is held out."""
    return F.crc32(F.col(doc_id).cast("string")) % 3


def positions(text: str | None) -> list[str]:
    """Positions of the chain: the runs of letters of a text, in lower case.

    A run of more than ``PIECE`` letters is cut into pieces of about the same length.
    A piece has ``_`` in front if the run goes on before it, and ``_`` with the next two
    characters of the run and its end mark if it goes on after it, so that the n-grams
    of the pieces are those of the run."""
    words = WORD.findall(text.lower()) if text else []
    if max(map(len, words), default=0) <= PIECE:
        return words
    out = []
    for w in words:
        parts = -(-len(w) // PIECE)
        cuts, ended = [len(w) * k // parts for k in range(parts + 1)], f"{w}$"
        out += [("_" if a else "") + w[a:b] + (f"_{ended[b : b + 2]}" if b < len(w) else "") for a, b in zip(cuts, cuts[1:])]
    return out


class Model:
    """Languages, hashed emission weights, transition and start scores, lexicons."""

    def __init__(self, languages: list[str], lexicon: dict[str, list[int]]):
        n = len(languages)
        self.languages, self.lexicon = languages, lexicon
        self.weights = np.zeros((BUCKETS, n))
        self.transitions, self.start = np.zeros((n, n)), np.zeros(n)
        self.key = uuid.uuid4().hex

    def features(self, word: str) -> list[int]:
        """Weight vectors of one position."""
        return self.features_of([word])[0].tolist()

    def features_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Weight vectors of all words, one word after the other, and where each begins.

        A word stands between ``^`` and ``$``; an inner piece of a long run has what
        comes before and after it instead. Its features are the affixes of one to three
        letters, the bigrams and trigrams that begin in it, its lexicons and one that all
        have. Hashes are computed from the characters of all words at once."""
        marked, own, first, last = [], [], [], []
        for w in words:
            if "_" not in w:
                marked.append(f"^{w}$")
                own.append(len(w) + 2)
                first.append(True)
                last.append(True)
                continue
            inner = w.startswith("_")
            body, open_end, ahead = w[inner:].partition("_")
            marked.append(("" if inner else "^") + body + (ahead or "$"))
            own.append(len(marked[-1]) - len(ahead))  # n-grams that start in the piece are its own
            first.append(not inner)
            last.append(not open_end)
        codes = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.uint64)
        length = np.fromiter(map(len, marked), np.int64, len(marked))
        start = np.cumsum(length) - length
        word = np.repeat(np.arange(len(marked)), length)
        left = np.minimum(np.array(own, np.int64), length)[word] - (np.arange(len(codes)) - start[word])
        rest = length[word] - (np.arange(len(codes)) - start[word])
        owners, hashes = [], []
        for ends, step in ((first, 1), (last, -1)):
            mine = np.flatnonzero(ends)
            edge = start[mine] if step > 0 else start[mine] + length[mine] - 1
            for most in (2, 3, 4):
                size = np.minimum(most, length[mine])
                h = (size.astype(np.uint64) + np.uint64(16 if step > 0 else 32)) * _FACTORS[4]
                for k in range(most):
                    there = k < size
                    h[there] += codes[edge[there] + step * k] * _FACTORS[k]
                owners.append(mine)
                hashes.append(h)
        for size in (2, 3):
            at = np.flatnonzero((left > 0) & (rest >= size))
            h = np.full(len(at), size, np.uint64) * _FACTORS[4]
            for k in range(size):
                h += codes[at + k] * _FACTORS[k]
            owners.append(word[at])
            hashes.append(h)
        known = [(j, k) for j, w in enumerate(words) if w in self.lexicon for k in self.lexicon[w]]
        owners.append(np.array([j for j, _ in known], np.int64))
        hashes.append((np.array([k for _, k in known], np.uint64) + np.uint64(64)) * _FACTORS[4])
        owners.append(np.arange(len(words)))
        hashes.append(np.full(len(words), 48, np.uint64) * _FACTORS[4])
        owner = np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        flat = (mixed(np.concatenate(hashes)) & np.uint64(BUCKETS - 1)).astype(np.int64)[order]
        return flat, np.searchsorted(owner[order], np.arange(len(words)))

    def emissions(self, words: list[str]) -> np.ndarray:
        """Emission scores of each word."""
        flat, starts = self.features_of(words)
        return np.add.reduceat(self.weights[flat], starts, axis=0)


class Words:
    """A worker's table of the emissions of the words that it has met."""

    def __init__(self, model: Model):
        self.model, self.most = model, min(CACHE, CELLS // len(model.languages))
        self.reset()

    def reset(self) -> None:
        self.place: dict[str, int] = {}
        self.table = np.empty((1 << 12, len(self.model.languages)))

    def numbered(self, texts: list[list[str]]) -> tuple[np.ndarray, list[np.ndarray]]:
        """The table of emissions and the words of each text as rows of it. It grows by
        half at least, and starts afresh when it has more than ``CACHE`` words or
        ``CELLS`` scores."""
        if len(self.place) > self.most:
            self.reset()
        known = len(self.place)
        new = list(set().union(*texts).difference(self.place))
        self.place.update(zip(new, range(known, known + len(new))))
        if len(self.place) > len(self.table):
            grown = np.empty((max(len(self.place), len(self.table) * 3 // 2), self.table.shape[1]))
            grown[:known] = self.table[:known]
            self.table = grown
        for k in range(0, len(new), 5000):
            part = self.model.emissions(new[k : k + 5000])
            self.table[known + k : known + k + len(part)] = part
        return self.table, [np.fromiter(map(self.place.__getitem__, t), np.int64, len(t)) for t in texts]


def build_lexicon(rows: list[tuple[int, list[str]]], n: int, size: int = LEXICON) -> dict[str, list[int]]:
    """Words most typical of each language: frequent there and rarer elsewhere."""
    counts = [Counter() for _ in range(n)]
    for label, words in rows:
        counts[label].update(words)
    total = sum(counts, Counter())
    out: dict[str, list[int]] = {}
    for k in range(n):
        ranked = sorted(((c * c / total[w], w) for w, c in counts[k].items() if c >= 3), reverse=True)[:size]
        for _, w in ranked:
            out.setdefault(w, []).append(k)
    return out


def training_sequences(coded: list[tuple[int, list[str]]], seed: int) -> list[list[tuple[int, list[str]]]]:
    """Half of the windows alone and the rest in pairs."""
    shuffled = coded[:]
    random.Random(seed).shuffle(shuffled)
    half = len(shuffled) // 2
    sequences = [[own] for own in shuffled[:half]] + [list(x) for x in zip(shuffled[half::2], shuffled[half + 1 :: 2])]
    return sequences or [[own] for own in shuffled]


def train(rows: list[tuple[str, list[str]]], rounds: int = ROUNDS, seed: int = SEED) -> Model | None:
    """Fit the field on labelled windows of words by maximum likelihood.

    Half of the sequences join windows of two documents, so that transitions
    between languages are seen as well as those within one."""
    rows = [(lang, words) for lang, words in rows if words]
    if not rows:
        return None
    languages = sorted({lang for lang, _ in rows})
    n, label = len(languages), {lang: k for k, lang in enumerate(languages)}
    coded = [(label[lang], words) for lang, words in rows]
    model = Model(languages, build_lexicon(coded, n))
    sequences = training_sequences(coded, seed)
    place: dict[str, int] = {}
    length = max(sum(len(w) for _, w in s) for s in sequences)
    word, gold = np.full((len(sequences), length), -1), np.full((len(sequences), length), -1)
    for r, s in enumerate(sequences):
        at = 0
        for k, words in s:
            for w in words:
                word[r, at], gold[r, at] = place.setdefault(w, len(place)), k
                at += 1
    flat, starts = model.features_of(list(place))
    owner = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(flat)))
    mask = word >= 0
    both = mask[:, 1:]
    observed = np.bincount(gold[:, :-1][both] * n + gold[:, 1:][both], minlength=n * n).reshape(n, n).astype(float)
    step = max(1, CELLS // (length * n))  # sequences at once
    parts = [(word[at : at + step], gold[at : at + step], mask[at : at + step]) for at in range(0, len(sequences), step)]
    parameters = [model.weights, model.transitions, model.start]
    sums = [np.zeros_like(p) + 1e-8 for p in parameters]
    for _ in range(rounds):
        table = np.add.reduceat(model.weights[flat], starts, axis=0)
        by_word, expected, first = np.zeros((len(place), n)), np.zeros((n, n)), np.zeros(n)
        t = np.exp(model.transitions)
        for w, g, m in parts:
            score = table[np.where(m, w, 0)]
            score -= score.max(axis=2, keepdims=True)
            e = np.exp(score)
            alpha, beta, scale = np.zeros_like(e), np.ones_like(e), np.ones(e.shape[:2])
            for i in range(length):
                a = e[:, i] * (np.exp(model.start) if i == 0 else alpha[:, i - 1] @ t)
                scale[:, i] = np.where(m[:, i], a.sum(axis=1), 1.0)
                alpha[:, i] = np.where(m[:, i : i + 1], a / scale[:, i : i + 1], alpha[:, i - 1] if i else 0)
            for i in range(length - 2, -1, -1):
                b = ((beta[:, i + 1] * e[:, i + 1]) @ t.T) / scale[:, i + 1 : i + 2]
                beta[:, i] = np.where(m[:, i + 1 : i + 2], b, 1.0)
            onehot = np.eye(n)[np.where(m, g, 0)] * m[:, :, None]
            missed = onehot - alpha * beta * m[:, :, None]
            right = beta[:, 1:] * e[:, 1:] / scale[:, 1:, None] * m[:, 1:, None]
            expected += np.einsum("bti,btj->ij", alpha[:, :-1], right) * t
            by_word += np.stack([np.bincount(w[m], missed[m][:, k], len(place)) for k in range(n)], axis=1)
            first += missed[:, 0].sum(axis=0)
        by_feature = np.stack([np.bincount(flat, by_word[owner, k], BUCKETS) for k in range(n)], axis=1)
        gradients = [by_feature - 0.1 * model.weights, observed - expected - 0.1 * model.transitions, first - 0.1 * model.start]
        for p, s, g in zip(parameters, sums, gradients):
            s += g * g
            p += 0.5 * g / np.sqrt(s)
    return model


def _normalised(v: np.ndarray) -> np.ndarray:
    return v / v.sum(axis=-1, keepdims=True)


def _carried(e: np.ndarray, t: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """What each segment (longest first) makes of a vector in front of it, but for a
    factor: the product of its emissions and the transitions within it."""
    out = np.eye(e.shape[1]) * e[starts][:, None, :]
    alive = np.searchsorted(-sizes, -np.arange(sizes[0]), "left")
    for i in range(1, sizes[0]):
        n = alive[i]
        own = (out[:n] @ t) * e[starts[:n] + i][:, None, :]
        out[:n] = own / own.max(axis=(1, 2), keepdims=True)
    return out


def label_words(model: Model, table: np.ndarray, words: list[np.ndarray], segment: int = SEGMENT) -> list[np.ndarray]:
    """Posterior of the languages at each word of each (non-empty) text.

    ``table`` has the emission scores by word number. A long text is cut into segments;
    what comes into a segment from either side is carried over whole segments first, and
    then all segments go through forward-backward side by side, longest first, so the
    number of steps is that of a segment. The result is that of the whole chain."""
    pieces = [(k, at) for k, w in enumerate(words) for at in range(0, len(w), segment)]
    sizes = np.array([min(segment, len(words[k]) - at) for k, at in pieces])
    order = np.argsort(-sizes, kind="stable")
    sizes = sizes[order]
    starts = np.cumsum(sizes) - sizes
    rank = np.empty(len(pieces), np.int64)
    rank[order] = np.arange(len(pieces))
    score = table[np.concatenate([words[k][at : at + segment] for k, at in (pieces[j] for j in order)])]
    e = np.exp(score - score.max(axis=1, keepdims=True))
    t = np.exp(model.transitions - model.transitions.max())
    ahead = np.tile(np.exp(model.start - model.start.max()), (len(pieces), 1))
    behind = np.ones((len(pieces), e.shape[1]))
    first = np.flatnonzero(np.array([at == 0 for _, at in pieces]))
    several = [np.arange(a, b) for a, b in zip(first, np.append(first[1:], len(pieces))) if b - a > 1]
    if several:
        own = np.sort(rank[np.concatenate(several)])
        carry = np.zeros((len(pieces), e.shape[1], e.shape[1]))
        carry[own] = _carried(e, t, starts[own], sizes[own])
        for text in several:
            r = rank[text]
            for before, now in zip(r[:-1], r[1:]):
                ahead[now] = _normalised(ahead[before] @ carry[before] @ t)
            for now, after in zip(r[-2::-1], r[:0:-1]):
                behind[now] = _normalised(t @ (carry[after] @ behind[after]))
    alive = np.searchsorted(-sizes, -np.arange(sizes[0]), "left")  # segments longer than i words
    alpha = np.empty_like(e)
    last = ahead * e[starts]
    for i in range(sizes[0]):
        at = starts[: alive[i]] + i
        if i:
            last = (last[: alive[i]] @ t) * e[at]
        last = _normalised(last)
        alpha[at] = last
    beta = np.ones((0, e.shape[1]))
    for i in range(sizes[0] - 1, -1, -1):
        at = starts[: alive[i]] + i
        own = behind[: alive[i]].copy()  # of those that end here
        own[: len(beta)] = beta
        alpha[at] = _normalised(alpha[at] * own)
        beta = _normalised((own * e[at]) @ t.T)
    out: list = [[] for _ in words]
    for j, (k, _) in enumerate(pieces):
        a = starts[rank[j]]
        out[k].append(alpha[a : a + sizes[rank[j]]])
    return [own[0] if len(own) == 1 else np.concatenate(own) for own in out]


def sample(docs: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE, window: int = WINDOW, seed: int = SEED) -> list[tuple[str, list[str]]]:
    """Windows of words of labelled documents outside the held-out fold.

    Each language is sampled at its own rate, by a seeded hash of doc_id, so that
    about ``docs_per_language`` documents come; the window lies anywhere in the
    whole text. Every language is learned: more than 64 of them share the
    ``SAMPLE_DOCS`` documents evenly, with ``LEAST_SHARE`` each at least."""
    pool = docs.select(F.col("doc_id").cast("long"), "lang", "text").where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (crc_fold("doc_id") != 1))
    counts = pool.groupBy("lang").count().collect()
    if not counts:
        return []
    share = min(docs_per_language, max(LEAST_SHARE, SAMPLE_DOCS // len(counts)))
    rate = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, share / r["count"]))])
    draw = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))

    def cut_window(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc_id, lang, text in zip(pdf["doc_id"], pdf["lang"], pdf["text"]):
                words = positions(text)
                at = random.Random(int(doc_id)).randrange(max(1, len(words) - window + 1))
                rows.append((doc_id, lang, words[at : at + window]))
            yield pd.DataFrame(rows, columns=["doc_id", "lang", "words"])

    chosen = pool.where(draw < rate[F.col("lang")]).mapInPandas(cut_window, "doc_id long, lang string, words array<string>")
    return [(r[1], list(r[2])) for r in sorted(chosen.collect())]


def has_letter(words: list[str]) -> bool:
    return any(any(map(str.isalpha, w)) for w in words)


def posteriors(model: Model, column: list) -> Iterator[np.ndarray | None]:
    """Posterior of the languages at each position of each text; None for texts
    without a letter. Texts are taken together up to a bounded number of words."""

    table = common.held(("language", model.key), lambda: Words(model))

    def label(texts: list[list[str]]) -> list:
        out: list = [None] * len(texts)
        usable = [k for k, w in enumerate(texts) if has_letter(w)]
        if usable:
            for k, posterior in zip(usable, label_words(model, *table.numbered([texts[k] for k in usable]))):
                out[k] = posterior
        return out

    room = min(CHUNK_WORDS, CELLS // len(model.languages))
    part, held = [], 0
    for text in column:
        part.append(positions(text))
        held += len(part[-1])
        if held >= room:
            yield from label(part)
            part, held = [], 0
    yield from label(part)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` added, from ``text`` alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        m = shared.value

        def compute(column: list) -> list:
            if m is None:
                return [[UND] * len(column), [0.0] * len(column)]
            languages, scores = [], []
            for posterior in posteriors(m, column):
                mean = np.zeros(1) if posterior is None else posterior.mean(axis=0)
                best = int(mean.argmax())
                languages.append(UND if posterior is None else m.languages[best])
                scores.append(float(min(1.0, mean[best])))
            return [languages, scores]

        return compute

    return common.add_columns(docs, ("text",), "lang_pred string, score double", start)


def identify(docs: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE) -> DataFrame:
    """``docs`` with ``held_out, lang_pred, score``.

    The model is fitted on a bounded sample of the labelled documents whose
    crc32(doc_id) mod 3 is not 1, and labels every whole text. ``und`` with score 0
    stands for null texts, texts without a letter, and for every text if no labelled
    document exists; of languages with equal means the first by name is taken. A null
    doc_id is not held out and not learned from; repeated rows are labelled alike; a
    very long text is labelled whole, with memory in proportion to its words; input
    columns named like a result are replaced."""
    docs = docs.drop("held_out", "lang_pred", "score")
    model = train(sample(docs, docs_per_language))
    return predict(docs, model).withColumn("held_out", F.coalesce(crc_fold("doc_id") == 1, F.lit(False)))


def accepted(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """``docs`` whose words are told with ``min_score`` or more, in the same columns.

    A document's certainty is the mean, over its words, of each word's largest
    posterior, so that text in several languages is as certain as text in one. Texts
    without a letter are rejected, and so are null texts; if no labelled document
    exists, every text with a letter stays."""
    shared = docs.sparkSession.sparkContext.broadcast(train(sample(docs)))

    def start():
        m = shared.value

        def keep(column: list) -> list[bool]:
            if m is None:
                return [has_letter(positions(text)) for text in column]
            return [p is not None and bool(p.max(axis=1).mean() >= min_score) for p in posteriors(m, column)]

        return keep

    return common.keep_rows(docs, "text", start)


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(sample(docs))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", F.coalesce(crc_fold("doc_id") == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
