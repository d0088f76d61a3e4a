"""The operators' methods against enumeration, recounts and models of the rules."""

import math
import random
from collections import Counter
from itertools import product

import numpy as np
import pytest

from beamline.llm import contamination, embeddings, language, mixing, pii, quality, simhash, suffixes, tokens, urls


# --- language: forward-backward and training by enumeration of all paths -------------------


def paths(model, words):
    """Log score of every path of labels."""
    score = np.array([[sum(model.weights[f, k] for f in model.features(w)) for k in range(len(model.languages))] for w in words])
    for labels in product(range(len(model.languages)), repeat=len(words)):
        total = model.start[labels[0]] + sum(score[i, k] for i, k in enumerate(labels))
        yield labels, total + sum(model.transitions[a, b] for a, b in zip(labels, labels[1:]))


@pytest.mark.parametrize("segment", [1, 2, 3, 256])
def test_posteriors_are_those_of_all_paths(segment):
    rng = np.random.default_rng(5)
    model = language.Model(["a", "b", "c"], {"two": [1]})
    model.weights = rng.normal(size=model.weights.shape)
    model.transitions, model.start = rng.normal(size=(3, 3)) * 2, rng.normal(size=3)
    texts = [["one"], ["one", "two"], ["three", "two", "two", "four", "one"], ["five"] * 6]
    for words, found in zip(texts, language.label_words(model, *language.Words(model).numbered(texts), segment)):
        expected, whole = np.zeros((len(words), 3)), 0.0
        for labels, score in paths(model, words):
            whole += math.exp(score)
            for i, k in enumerate(labels):
                expected[i, k] += math.exp(score)
        assert np.allclose(found, expected / whole)


def test_long_texts_do_not_depend_on_the_segments():
    rng = np.random.default_rng(6)
    model = language.Model(["a", "b", "c", "d"], {})
    model.transitions, model.start = rng.normal(size=(4, 4)) * 3, rng.normal(size=4)
    table = rng.normal(size=(50, 4)) * 20
    words = [rng.integers(0, 50, n) for n in (1, 5000, 300, 256, 257, 2, 1024)]
    whole = language.label_words(model, table, words, 1 << 20)
    for segment in (7, 256):
        assert all(np.allclose(a, b) for a, b in zip(language.label_words(model, table, words, segment), whole))


def test_training_ends_where_the_gradient_is_nought():
    rows = [("a", ["xa", "ya"]), ("b", ["xb", "yb", "xa"]), ("a", ["ya", "xa"]), ("b", ["yb", "xb"])]
    model = language.train(rows, rounds=4000)
    sequences = language.training_sequences([(model.languages.index(lang), words) for lang, words in rows], language.SEED)
    observed, expected = np.zeros((2, 2)), np.zeros((2, 2))
    for own in sequences:
        words, gold = [w for _, ws in own for w in ws], [k for k, ws in own for _ in ws]
        for a, b in zip(gold, gold[1:]):
            observed[a, b] += 1
        every = list(paths(model, words))
        whole = sum(math.exp(s) for _, s in every)
        for labels, score in every:
            for a, b in zip(labels, labels[1:]):
                expected[a, b] += math.exp(score) / whole
    assert np.abs(observed - expected - 0.1 * model.transitions).max() < 0.02


def test_word_table_grows_and_starts_afresh(monkeypatch):
    monkeypatch.setattr(language, "CACHE", 5000)
    model = language.Model(["a", "b"], {})
    model.weights = np.random.default_rng(1).normal(size=model.weights.shape)
    table = language.Words(model)
    for lot in range(4):
        words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}{'abcd'[lot]}" for k in range(3000)]
        rows, numbered = table.numbered([words])
        assert np.allclose(rows[numbered[0]], model.emissions(words))
    assert len(table.place) <= 6000


# --- token shards ---------------------------------------------------------------------------


def test_no_pair_that_pays_is_left():
    rng = np.random.default_rng(2)
    for n, letters in ((0, 5), (1, 5), (4000, 3), (4000, 400), (3000, 1)):
        ids = rng.integers(0, letters, n).astype(np.uint16)
        joins = rng.random(n) > 0.01
        joins[-1:] = False
        seq, left, rules, lengths = tokens.re_pair(ids, joins, 1000)
        width = (1000 + len(rules)).bit_length()
        pairs, last = Counter(), None
        for i in np.flatnonzero(left):
            pair = (int(seq[i]), int(seq[i + 1]))
            if last == (i - 1, pair):  # overlaps itself
                last = None
                continue
            last = (i, pair)
            pairs[pair] += 1
        assert all(c < (2 * width + tokens.LENGTH_BITS) // width + 1 for c in pairs.values())
        out = list(seq)
        while any(s >= 1000 for s in out):
            out = [x for s in out for x in (rules[s - 1000] if s >= 1000 else (s,))]
        assert out == ids.tolist()


def test_repeated_passages_become_long_rules():
    rng = np.random.default_rng(4)
    passage = rng.integers(3, 50_000, 3000).astype(np.uint16)
    docs = [np.concatenate([rng.integers(3, 50_000, 40).astype(np.uint16), passage, [2]]).astype(np.uint16) for _ in range(40)]
    shard = tokens.Shard(blob := tokens.write_shard(docs, 50_257))
    assert shard.lengths.max() > 1000 and len(blob) < 0.2 * 2 * sum(map(len, docs))
    assert all(shard.document(k).tolist() == d.tolist() for k, d in enumerate(docs))
    assert shard.all().tolist() == np.concatenate(docs).tolist()


@pytest.mark.parametrize("bits", [1, 7, 16, 17, 31, 32])
def test_packed_numbers(bits):
    values = np.random.default_rng(bits).integers(0, 1 << bits, 200_001, dtype=np.uint64).astype(np.uint32)
    data = b"head" + tokens.pack(values, bits)
    assert (tokens.unpack(data, 4, len(values), bits) == values).all()
    for first, n in ((0, 5), (13, 1), (70_001, 66_000), (200_000, 1), (5, 0)):
        assert (tokens.unpack(data, 4, n, bits, first) == values[first : first + n]).all()


def test_pieces_are_the_whole_texts_tokens():
    own, rng = tokens.Encoder(tokens.vocabulary()), random.Random(7)
    alphabet = list("abzAZé ßж字   \n\t.,!'’\"_-0123½²٣\x1c\x85\xa0　́😀") + ["'s", "'re", " '", "  ", "\r\n", "<|endoftext|>", "'S", "y" * 1200]
    for _ in range(20):
        texts = ["".join(rng.choices(alphabet, weights=[9] * (len(alphabet) - 3) + [1, 9, 1], k=rng.randrange(40))) for _ in range(200)]
        assert [x.tolist() for x in own.encode(texts)] == [own.library(t).tolist() for t in texts]


# --- SimHash, mixing, clashes ------------------------------------------------------------------


@pytest.mark.parametrize("tiles", [1, 1 << 15, 1 << 25, 1 << 31])
def test_every_close_pair_meets_in_a_view(tiles):
    masks, rng = simhash.views(3, tiles), random.Random(tiles)
    assert min((m & (1 << 64) - 1).bit_count() for m in masks) >= (4 * tiles).bit_length() - 1
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), 3):
            b ^= 1 << bit
        assert any((a ^ b) & m == 0 for m in masks)


def clashing(spark):
    rows = [(k, f"the same words again and again {k // 2} " * 9, "s", "kept as it is", k, 5, 6, 7.5, 8, 9) for k in range(12)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang_pred string, _row long, size int, source_size int, target double, times int, taken int").selectExpr("*", "'f' as own_fingerprint")


def test_columns_that_clash_keep_their_values(spark):
    df = clashing(spark)
    before = {tuple(r) for r in df.collect()}
    for out in (simhash.near_dedup(df), mixing.mixed_documents(df), pii.sanitise(df)):
        rows = [tuple(r) for r in out.collect()]
        assert out.columns == df.columns and rows and set(rows) <= before
    assert simhash.near_dedup(df).count() == 6 and mixing.mixed_documents(df).count() == 12


def test_documents_of_size_nought_are_not_taken_more_than_others(spark):
    df = spark.createDataFrame([(k, "" if k % 3 else "a b c", f"s{k % 2}") for k in range(300)], "doc_id long, text string, source string")
    assert max(r.times for r in mixing.mix(df).collect()) <= 3
    copies = Counter(r.doc_id for r in mixing.mixed_documents(df).collect())
    times = {r.doc_id: r.times for r in mixing.mix(df).collect()}
    assert copies == Counter({k: n for k, n in times.items() if n})


def test_sanitise_goes_by_row(spark):
    rows = [(None, "write to a.b@c.org now"), (1, "really no data at all in here"), (1, "call +1 202 555 0100 now"), (1, "and x@y.org too"), (2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.text or "") for r in pii.sanitise(df, disclosure=2.0).collect())
    assert got == sorted([("None", "write to <EMAIL> now"), ("1", rows[1][1]), ("1", "call <PHONE> now"), ("1", "and <EMAIL> too"), ("2", "")])


# --- decontamination ---------------------------------------------------------------------------


def test_partitions_find_what_a_plain_search_finds():
    rng = random.Random(8)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnopqrst")
    items = [(k, " ".join(word() for _ in range(rng.choice([1, 3, 5, 6, 8, 20, 70, 300])))) for k in range(80)]
    block, cache = contamination.Block(items, 0.8, 32, 1e-9), contamination.WordHash()
    sizes = sorted(len(contamination.shingle_set(contamination.tokens(t))) for _, t in items)
    assert len(block.partitions) > 4 and sizes[-1] > 200
    for _ in range(60):
        words = [word() for _ in range(rng.randrange(400))]
        for _, text in rng.sample(items, 3):
            own = text.split()
            own = own[: max(1, int(len(own) * rng.choice([1, 1, 0.9, 0.7])))]
            at = rng.randrange(len(words) + 1)
            words[at:at] = own
        found = {i for i, _, _ in block.search(words, contamination._hashed(words, cache))}
        expected = set()
        for i, text in items:
            own = text.split()
            k = min(5, len(own))
            exact, there = contamination.shingle_set(own), {" ".join(words[j : j + k]) for j in range(len(words) - k + 1)}
            if len(exact & there) >= 0.8 * len(exact):
                expected.add(i)
        assert found == expected


def test_blocks_are_bounded_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(contamination, "BLOCK_BYTES", 300)
    bench = spark.createDataFrame([(k, f"item number {k} with some more words in it") for k in range(30)], "item_id long, text string")
    assert len(list(contamination.item_blocks(bench, 0.8, 32, 1e-9, 50_000))) == 5
    docs = spark.createDataFrame([(k, f"x item number {k} with some more words in it y") for k in range(30)], "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in contamination.contained(docs, bench).collect()) == [(k, k) for k in range(30)]


# --- quality and personal data -----------------------------------------------------------------


def test_quality_is_a_recount(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["river", "stone", "buy", "cheap", "pill", "tree"]) for _ in range(rng.randrange(0, 30))) for _ in range(60)] + [None, "x " * 30_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 3 != 0, k % 7 == 0) for k in range(50)], "doc_id long, quality boolean, toxic boolean").selectExpr("doc_id", "int(quality) quality", "int(toxic) toxic")
    buckets, cache = 97, contamination.WordHash()
    grams = [quality.ngrams(t, cache, buckets).tolist() for t in texts]
    assert [len(g) for g in grams] == [max(0, 2 * len(contamination.tokens(t)) - 1) for t in texts]
    good = {k for k in range(50) if k % 3 != 0 and k % 7 != 0}
    raw, target = Counter(x for g in grams for x in g), Counter(x for k, g in enumerate(grams) if k in good for x in g)
    ratio = {b: math.log((target[b] + 1) / (sum(target.values()) + buckets)) - math.log((raw[b] + 1) / (sum(raw.values()) + buckets)) for b in range(buckets)}
    got = {r.doc_id: r for r in quality.resample(docs, labels, keep=0.4, buckets=buckets).collect()}
    for k, g in enumerate(grams):
        assert got[k].n_grams == len(g) and abs(got[k].log_weight - sum(ratio[x] for x in g)) < 1e-4 * max(1, len(g))
    order = sorted(got.values(), key=lambda r: (-r.gumbel_key, r.doc_id))
    assert [r.kept for r in order] == [k < round(0.4 * len(texts)) for k in range(len(texts))]
    noise = [r.gumbel_key - r.log_weight for r in got.values()]
    assert len({round(x, 9) for x in noise}) == len(noise) and abs(np.mean(noise) - 0.577) < 0.6


def test_buckets_grow_with_the_corpus():
    assert [quality.bucket_count(n) for n in (0, 10_000, 160_000, 100_000_000)] == [1024, 10_240, 20_480, 102_400]


def test_disclosing_terms_are_those_of_the_formula(spark):
    rng = random.Random(6)
    texts = []
    for k in range(400):
        words = [rng.choice("abcdefghijklmnopqrstuvwxyz") * 3 for _ in range(12)]
        if k % 40 < 3:
            words += [f"mail{k % 40}@x.org", f"Nam{'eqz'[k % 40]}", "İstanbul" if k % 40 == 1 else "plain"]
        texts.append(" ".join(words))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    holds = {e: {k for k, t in enumerate(texts) if e in t.split()} for e in ("mail0@x.org", "mail1@x.org", "mail2@x.org")}
    terms = [{w.lower() for w in t.split() if "@" not in w} for t in texts]
    flagged, n, z = set(), len(texts), pii.CONFIDENCE
    for e, own in holds.items():
        for t in set().union(*(terms[k] for k in own)):
            n_t, n_et = sum(t in x for x in terms), sum(t in terms[k] for k in own)
            p = n_et / n_t
            low = (p + z * z / (2 * n_t) - z * math.sqrt(p * (1 - p) / n_t + z * z / (4 * n_t * n_t))) / (1 + z * z / n_t)
            if n_et >= pii.TOGETHER and math.log2(low * n / len(own)) >= pii.DISCLOSURE * math.log2(n / len(own)):
                flagged.add(t)
    got = {texts[r.doc_id][int(s) : int(e)].lower() for r in pii.detect(df).collect() for k, s, e in (x.split(":") for x in r.spans.split(",") if x) if k == "term"}
    assert got == flagged and flagged


def flagged_words(df, **options):
    texts = {r.doc_id: r.text for r in df.collect()}
    return {texts[r.doc_id][int(s) : int(e)].lower() for r in pii.detect(df, **options).collect() for k, s, e in (x.split(":") for x in r.spans.split(",") if x) if k == "term"}


@pytest.mark.parametrize("n_docs", [800, 6000])
def test_disclosing_terms_are_told_from_rare_ones(spark, n_docs):
    """Planted: names beside one address in 4 to 9 documents, now and then elsewhere.
    Harmless: words of Zipf's law, each document's own word, copies of a document."""
    rng = random.Random(n_docs)
    vocabulary = [f"w{k}" for k in range(20 * n_docs)]
    weights = [1 / (k + 10) for k in range(len(vocabulary))]
    texts = [rng.choices(vocabulary, weights, k=60) + [f"own{k}"] for k in range(n_docs)]
    planted = set()
    for k in range(n_docs // 40):
        holders = rng.sample(range(n_docs), rng.randrange(4, 10))
        planted.add(f"name{k}")
        for d in holders:
            texts[d] += [f"name{k}", f"person{k}@mail.org"]
        if k % 4 == 0:
            texts[rng.randrange(n_docs)].append(f"name{k}")
    for k in range(n_docs // 10):
        texts[rng.randrange(n_docs)].append(f"single{k}@mail.org")
    rows = [" ".join(rng.sample(t, len(t))) for t in texts]
    rows += [rows[k] for k in range(0, n_docs, 50)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = flagged_words(df)
    right = found & planted
    assert len(right) >= 0.9 * len(planted) and len(right) >= 0.9 * len(found), (len(right), len(planted), len(found))


def test_pairs_of_a_document_in_several_keys(spark, monkeypatch):
    rng = random.Random(2)
    groups = [[f"m{g}x{k}@x.org" for k in range(5)] + [f"t{g}x{k}" for k in range(6)] for g in range(8)]
    rows = [" ".join(w for g in rng.sample(groups, 2) for w in g) for _ in range(60)] + [f"other {k}" for k in range(400)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    whole = flagged_words(df)
    for pairs in (1, 7, 50):
        monkeypatch.setattr(pii, "PAIRS", pairs)
        assert flagged_words(df) == whole and len(whole) == 48


def test_the_filter_passes_every_flagged_term_and_few_others(spark):
    digest = pii.Terms()
    flagged, others = [f"term{k}" for k in range(5000)], [f"other{k}" for k in range(20_000)]
    found = pii.term_filter(spark.createDataFrame([(digest[w],) for w in flagged], "t long"))
    assert 64 * len(found) == pii.filter_bits(5000) == 1 << 17
    assert pii.may_be_flagged(flagged, digest, found) == set(flagged)
    assert len(pii.may_be_flagged(others, digest, found)) < 100
    none = pii.term_filter(spark.createDataFrame([], "t long"))
    assert not none.any() and pii.may_be_flagged([], digest, none) == set()


# --- embeddings, URLs, suffixes ------------------------------------------------------------------


@pytest.mark.parametrize("dim", [3, 16, 64, 100, 200])
def test_bit_planes_rule_out_no_link_and_most_other_pairs(dim):
    rng = np.random.default_rng(dim)
    centre = rng.normal(size=(20, dim))
    x = centre[rng.integers(0, 20, 300)] + rng.normal(size=(300, dim)) * rng.choice([0.05, 0.3], (300, 1))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    cosine, args = unit @ unit.T, (*embeddings.encode(x), *embeddings.stepped(x))
    for threshold in (0.93, 0.5):
        i, j, exact = embeddings.linked_pairs(x, x, *args, threshold, None)
        assert set(zip(i.tolist(), j.tolist())) == set(zip(*(v.tolist() for v in np.nonzero(cosine >= threshold)))) or np.abs(cosine - threshold).min() < 1e-12
    # a finite epsilon recomputes fewer pairs and loses next to none
    i, j, exact = embeddings.linked_pairs(x, x, *args, 0.93, None)
    k, l, fewer = embeddings.linked_pairs(x, x, *args, 0.93, 3.0)
    links = set(zip(i.tolist(), j.tolist()))
    found = set(zip(k.tolist(), l.tolist()))
    assert found <= links and fewer <= exact and len(found) >= 0.99 * len(links)
    if dim >= 64:
        assert fewer < 0.5 * 300 * 300


def test_lists_from_tables_in_blocks(spark):
    rules = [("block" if k % 3 else "allow", f"h{k % 50}.example.net" if k % 2 else "example.net", "/" + "ab"[k % 2] * (k % 7)) for k in range(300)]
    hosts = [f"bad{k}.org" for k in range(100)]
    urls_ = [f"http://{s}h{k % 60}.EXAMPLE.net/{'ab'[k % 2] * (k % 9)}?q" for k in range(400) for s in ("", "x.")][:500] + [f"http://w.bad{k}.org/x" for k in range(120)] + [None, "", "nothing"]
    pages = spark.createDataFrame([(k, u, "kept") for k, u in enumerate(urls_)], "page_id long, url string, says string")
    tables = spark.createDataFrame(rules, "verdict string, host string, path string"), spark.createDataFrame([(h,) for h in hosts], "host string")
    one, many = urls.url_filter(pages, *tables), urls.url_filter(pages, *tables, block_entries=20)
    assert one.columns == many.columns == ["page_id", "url", "says", "host", "path", "rule", "verdict"]
    got = sorted(map(tuple, many.collect()), key=str)
    assert got == sorted(map(tuple, one.collect()), key=str)
    said = {}
    for verdict, host, path in rules:
        said[host, path] = max(said.get((host, path), "allow"), verdict)
    for _, url, says, host, path, rule, verdict in got:
        fits = sorted(((len(h + p), h + p, v) for (h, p), v in said.items() if (host == h or host.endswith("." + h)) and path.startswith(p)), reverse=True)
        assert says == "kept" and rule == (fits[0][1] if fits else None)
        assert verdict == (fits[0][2] if fits else "block" if any(host == h or host.endswith("." + h) for h in hosts) else "allow")


def test_documents_of_a_key_are_counted_beyond_a_byte(spark):
    line = "the same line of boilerplate that very many short documents share, word for word, all over"
    df = spark.createDataFrame([(k, f"{k} {line}") for k in range(700)], "doc_id long, text string")
    parcels = suffixes.send_keys(suffixes.blocks(df.coalesce(1)), 1).collect()
    assert max(int(suffixes._unpack(p.counts, np.uint32).max()) for p in parcels) == 700
    assert {r.kind for r in suffixes.shared_keys(suffixes.send_keys(suffixes.blocks(df.coalesce(1)), 1), 600).collect()} >= {1}
    assert [r.n_removed > 60 for r in suffixes.repeated_bytes(df, heavy=600).orderBy("doc_id").collect()] == [False] + [True] * 699
