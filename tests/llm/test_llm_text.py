"""Language, URLs, contamination, mixing, tokens, personal data and quality."""

import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from beamline.llm import contamination, language, mixing, pii, quality, registry, tokens, urls

SF = "/root/testdata/sf0.001"
EDGE = [(1, ""), (2, None), (3, "12 34 !?"), (4, "Der Hund läuft schnell über die Straße"), (4, "Der Hund läuft schnell über die Straße"), (None, "hello there my friend"), (9, "word " * 30_000)]


def edge(spark):
    return spark.createDataFrame([(i, t, "s", 7, "z") for i, t in EDGE], "doc_id long, text string, source string, size int, verdict string")


def same(a, b):
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted(([plain(x) for x in r] for r in a), key=str) == sorted(([plain(x) for x in r] for r in b), key=str)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows_in_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df, other = registry.queries()[name](spark, SF), con.sql(registry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(other.columns)
    assert same([tuple(r) for r in df.select(*sorted(df.columns)).collect()], other.select(*sorted(df.columns)).fetchall())


def test_language_on_held_out_documents(spark):
    path = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    rows = language.op4_language_id(spark, path).collect()
    assert len(rows) == len(truth) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out and truth[r.doc_id]]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.93
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edges(spark):
    learn = [(k, text, lang) for k in range(60) for text, lang in [("the house and the garden of my friend", "en")] if k % 2 == 0] + [(k, "das haus und der garten von meinem freund", "de") for k in range(1, 60, 2)]
    df = spark.createDataFrame([(i, t, lang, 5) for i, t, lang in learn] + [(1000 + k, t, None, 5) for k, (_, t) in enumerate(EDGE)], "doc_id long, text string, lang string, score int")
    got = {r.doc_id: r for r in language.identify(df).collect()}
    assert [got[1000 + k].lang_pred for k in range(4)] == ["und", "und", "und", "de"] and got[1000].score == 0
    none = language.identify(df.where("lang is null")).collect()
    assert {r.lang_pred for r in none} == {"und"}
    assert language.identify(df.limit(0)).count() == 0


def test_code_switched_words():
    rows = [("en", "the house and the garden of my friend".split()), ("de", "das haus und der garten von meinem freund".split())] * 40
    model = language.train(rows)
    words = "the garden and the house und der garten von freund".split()
    table, numbered = language.Words(model).numbered([words])
    best = [model.languages[k] for k in language.label_words(model, table, numbered)[0].argmax(axis=1)]
    assert best[:5] == ["en"] * 5 and best[-4:] == ["de"] * 4


def test_long_runs_are_read_whole():
    run = "".join(chr(0x4E00 + k) for k in range(101))
    words = language.positions(f"ab {run} cd")
    assert words[0] == "ab" and words[-1] == "cd" and len(words) == 5
    assert "".join(w.strip("_").partition("_")[0] for w in words[1:-1]) == run
    model = language.Model(["x"], {})
    grams = [model.features(w) for w in words[1:-1]]
    whole = model.features(run)  # a word that was not cut has every n-gram of the run
    assert sorted(f for g in grams for f in g) == sorted(whole + [whole[-1]] * 2)
    other = run[:40] + run[40:][::-1]
    assert sorted(model.features(other)) != sorted(whole)


def test_texts_that_differ_after_forty_letters():
    rng = np.random.default_rng(3)
    letters = {"p": [chr(0x4E00 + k) for k in range(30)], "q": [chr(0x5E00 + k) for k in range(30)]}
    write = lambda lang, n: "".join(rng.choice(letters[lang], n))
    model = language.train([(lang, language.positions(write(lang, 60))) for lang in "pq" * 30])
    head = write("p", 40)
    for tail in "pq":
        table, numbered = language.Words(model).numbered([language.positions(head + write(tail, 300))])
        mean = language.label_words(model, table, numbered)[0].mean(axis=0)
        assert model.languages[int(mean.argmax())] == tail


def test_every_language_is_learned(spark):
    langs = [f"l{k:03d}" for k in range(70)]
    rows = [(i * 1000 + k, f"w{chr(97 + k // 26)}{chr(97 + k % 26)}q " * 5, lang) for k, lang in enumerate(langs) for i in range(2 if k == 69 else 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").where("crc32(cast(doc_id as string)) % 3 <> 1")
    assert {lang for lang, _ in language.sample(df)} == {r.lang for r in df.select("lang").distinct().collect()}
    assert len({lang for lang, _ in language.sample(df)}) > 64


def test_mixed_language_documents_are_kept(spark):
    words = {"en": "the house and garden of my friend".split(), "de": "das haus und der garten von freund".split(), "es": "la casa el jardín de mi amigo".split(), "fr": "une maison avec le jardin pour nous".split()}
    learn = [(k * 4 + j, " ".join(words[lang] * 4), lang, 5) for k in range(60) for j, lang in enumerate(words)]
    share = lambda lang, n: (words[lang] * 9)[:n]
    mixed = [(1001, " ".join(share("en", 40) + share("de", 30) + share("es", 30)), None, 5), (1002, " ".join(share("en", 25) + share("de", 25) + share("es", 25) + share("fr", 25)), None, 5)]
    other = [(1003, "12 34 !?", None, 5), (1004, None, None, 5), (1005, "", None, 5)]
    df = spark.createDataFrame(learn + mixed + other, "doc_id long, text string, lang string, score int")
    kept = language.accepted(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {r[0] for r in learn + mixed}
    flat = language.accepted(df, min_score=1.01)
    assert flat.count() == 0
    unlabelled = df.selectExpr("doc_id", "text", "cast(null as string) as lang", "score")
    assert {r.doc_id for r in language.accepted(unlabelled).collect()} == {r[0] for r in learn + mixed}


def test_digest_array(tmp_path):
    path, names = str(tmp_path / "d"), ["a.com", "b.net", "ü"]
    urls.DigestArray.write(path, names)
    array = urls.DigestArray(path)
    assert array.find([b"b.net", b"x", "ü".encode()]).tolist() == [True, False, True]
    array.text = np.zeros_like(array.text)  # every digest still meets, no string does
    assert not array.find([n.encode() for n in names]).any()
    urls.DigestArray.write(path, [])
    assert urls.DigestArray(path).find([b"a"]).tolist() == [False]


def test_url_rules(spark):
    rows = ["http://EXAMPLE.com/en/x", "http://www.example.com/en/x", "http://a.www.example.com/en/", "http://notexample.com/en/", "x://net/es/", "http://a.net/fr/?q", "http://a.net/fr", "no scheme", None, "", "http://casino-win.example.org/a", "http://sub.casino-win.example.org", "http://casino-win.example.com/a", "a\nb://net/es/1"]
    df = spark.createDataFrame([(k if k else None, u, "clash") for k, u in enumerate(rows)], "page_id long, url string, rule string")
    got = [(r.host, r.rule, r.verdict) for r in sorted(urls.url_filter(df).collect(), key=lambda r: r.page_id or 0)]
    assert [g[1:] for g in got] == [("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("www.example.com/en/", "allow"), ("com/", "allow"), ("net/es/", "block"), ("net/fr/", "block"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "block"), (None, "block"), ("com/", "allow"), ("net/es/", "block")]
    assert got[8][0] == "" and urls.url_filter(df.limit(0)).count() == 0


def test_containment(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    docs = [(i, t) for i, t in EDGE] + [(20, f"lead in words {item.upper()} and a tail " * 3), (21, item.replace("zeta", "other")), (22, "tiny item")]
    df = spark.createDataFrame([(i, t, "c") for i, t in docs], "doc_id long, text string, containment string")
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "tiny item"), (4, "tiny item")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in contamination.contained(df, bench, block_items=2).collect())
    assert got == [(20, 1), (22, 4), (22, 4)]
    left = contamination.decontaminate(df, bench, block_items=2)
    assert left.columns == df.columns and left.count() == len(docs) - 2
    assert contamination.contained(df.limit(0), bench).count() == 0 and contamination.contained(df, bench.limit(0)).count() == 0


def test_short_items_inside_long_documents(spark):
    items = [(1, "tiny item"), (2, "Tiny"), (3, "a tiny item here"), (4, "item tiny"), (4, "item tiny"), (5, "one two three four five"), (6, None)]
    docs = [(1, "many words before a TINY item, here and many words after"), (2, "item"), (3, "tiny items are not it"), (4, "so an item tiny"), (5, "x one two three four five y"), (6, "one two three four"), (None, "tiny item"), (8, None)]
    df = spark.createDataFrame([(i, t, "c") for i, t in docs], "doc_id long, text string, containment string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    expected = [(1, 1), (1, 2), (1, 3), (3, 2), (4, 2), (4, 4), (4, 4), (5, 5), (None, 1), (None, 2)]
    for size in (50_000, 2):
        got = contamination.contained(df, bench, block_items=size).collect()
        assert sorted(((r.doc_id, r.item_id) for r in got), key=str) == sorted(expected, key=str)
        assert all(r.shared == r.n_shingles == 1 and r.containment == 1 for r in got)
        assert {r.doc_id for r in contamination.decontaminate(df, bench, block_items=size).collect()} == {2, 6, 8}


def test_mixture(spark):
    rows = [(k, "w " * (1 + k % 9), ("a", "b", "c", None)[min(3, k % 10)]) for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    for source in ("a", "b", "c", None):
        own = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 9 and all(r.taken <= 3 * r.size for r in own)
        assert own[0].target <= 3 * own[0].source_size + 1e-6
    assert abs(sum({r.source: r.target for r in got}.values()) - sum({r.source: r.source_size for r in got}.values())) < 1e-6
    assert same([tuple(r) for r in got], [tuple(r) for r in mixing.mix(df.repartition(3)).collect()])
    assert mixing.mixed_documents(df).count() == sum(r.times for r in got)
    edges = mixing.mix(edge(spark)).collect()
    assert len(edges) == len(EDGE) and {r.doc_id: r.size for r in edges}[2] == 0 and mixing.mix(edge(spark).limit(0)).count() == 0
    empty = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert [r.taken for r in mixing.mix(empty).collect()] == [0, 0]


def expected_tokens(rows):
    from tokenizers import Tokenizer

    t, start, out = Tokenizer.from_file(tokens.vocabulary()), 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = t.encode(text or "", add_special_tokens=False).ids + [tokens.END_ID]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_tokens(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert same([tuple(r) for r in tokens.op8_tokens(spark, SF).collect()], expected_tokens(rows))
    odd = EDGE + [(30, "it's  \n\n ¼ 日本語 <|endoftext|> \x1c x" + "y" * 3000), (31, " \t "), (32, "'s 's  don't")]
    df = spark.createDataFrame([(i, t, 1) for i, t in odd], "doc_id long, text string, start int")
    assert same([tuple(r) for r in tokens.token_output(df, shard_ids=500, partitions=3).collect()], expected_tokens(odd))
    assert tokens.token_output(df.limit(0)).count() == 0


def test_grammar_shards():
    rng = np.random.default_rng(1)
    docs = [np.append(np.tile(rng.integers(3, 50, 9), rng.integers(0, 400)), 2).astype(np.uint16) for _ in range(60)]
    blob = tokens.write_shard(docs, 50_257)
    shard = tokens.Shard(blob)
    assert len(shard.lengths) > 0 and len(shard.symbols) < sum(map(len, docs)) / 4
    for k in (0, 7, 59, 31):
        assert shard.document(k).tolist() == docs[k].tolist()
    assert shard.all().tolist() == np.concatenate(docs).tolist()
    with pytest.raises(ValueError):
        tokens.Shard(b"nothing here" * 9)


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            double = [int(c) if k % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for k, c in enumerate(reversed(digits))]
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False, "card": 16 <= len(digits) <= 19 and sum(double) % 10 == 0, "phone": 8 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


HARD = ["a@b.c@d.e x@y", "1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.4 1.2.3", "4111 1111-1111 1111 4111111111111112 +1 (555) 010-9999", "+12345 +1-2 ++1234567890", "@a.b a@@b.c é@x.y ü.a@b-.c..d", "9" * 40, "x" * 50 + "@" + "1.1." * 9]


@pytest.mark.parametrize("text", HARD)
def test_base_spans(text):
    got = pii.base_spans(text)
    assert [(k, *s) for k in pii.KINDS for s in got[k]] == plain_spans(text)


def test_personal_data(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()] + EDGE
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, spans string")
    got = sorted(((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in pii.detect(df).collect()), key=str)
    expected = []
    for i, t in rows:
        spans = plain_spans(t or "")
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        expected.append((i, *[sum(1 for s in spans if s[0] == k) for k in pii.KINDS], hashlib.sha256(joined.encode()).hexdigest()))
    assert got == sorted(expected, key=str) and pii.detect(df.limit(0)).count() == 0


def test_disclosing_terms_are_generalised(spark):
    rows = [(k, f"filler {k} zorblax writes from secret@x.org today about things") for k in range(4)] + [(k, f"today about things from other people {k}") for k in range(4, 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    text = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert "zorblax" not in text[0] and "secret@x.org" not in text[0] and "<TERM>" in text[0] and "<EMAIL>" in text[0]
    assert text[0].endswith("today about things") and text[10] == rows[10][1]


def test_terms_are_weighed_in_whole_documents(spark):
    gap = " today about things from other people" * 3
    rows = [(k, f"Zorblax Industries{gap} writes from secret@x.org{gap} signed zorblax", "k") for k in range(9)]
    rows += [(10 + k, f"again zorblax{gap}", "k") for k in range(1)] + [(100 + k, f"{gap} number", "k") for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    text = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert all("orblax" not in text[k] and "Industries" not in text[k] for k in range(9))  # far from the mention
    assert text[10] == f"again <TERM>{gap}"  # without the entity
    assert all(text[i] == t for i, t, _ in rows if i >= 100)


def test_confidence_decides_about_rare_terms(spark):
    gap = " today about things from other people"
    row = [(1, f"zorblax{gap} a@b.org", "k")]
    for filler, flagged in ((50, False), (1500, True)):
        df = spark.createDataFrame(row + [(10 + k, gap, "k") for k in range(filler)], "doc_id long, text string, spans string")
        assert {r.doc_id: r.spans for r in pii.detect(df).collect()}[1] == f"email:{8 + len(gap)}:{15 + len(gap)}"  # one document is no evidence
        spans = {r.doc_id: r.spans for r in pii.detect(df, together=1).collect()}
        assert spans[1] == f"email:{8 + len(gap)}:{15 + len(gap)}" + (",term:0:7" if flagged else "")
        assert not any(v for k, v in spans.items() if k > 1)


def test_quality(spark):
    docs = spark.createDataFrame([(k, "good clean prose about rivers" if k % 2 else "buy cheap pills now", 1) for k in range(80)] + [(None, None, 1), (200, "", 1)], "doc_id long, text string, kept int")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(40)] + [(3, 1, 1)], "doc_id long, quality int, toxic int")
    got = quality.resample(docs, labels, keep=0.5).collect()
    assert len(got) == 82 and sum(r.kept for r in got) == 41
    mean = {r.doc_id: r.mean_log_ratio for r in got}
    assert min(v for k, v in mean.items() if k is not None and k < 80 and k % 2) > max(v for k, v in mean.items() if k is not None and k < 80 and k % 2 == 0)
    ordered = sorted(got, key=lambda r: (-r.gumbel_key, r.doc_id or -1))
    assert [r.kept for r in ordered] == [True] * 41 + [False] * 41 and mean[200] == 0
    assert all(math.isfinite(r.gumbel_key) for r in got) and quality.resample(docs.limit(0), labels).count() == 0


def test_pipeline(spark, tmp_path):
    docs, counts = spark.read.parquet(f"{SF}/documents.parquet"), []
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts[0] >= counts[1] >= counts[2] > 100
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert same([tuple(r) for r in corpus_pipeline.run(spark, SF).collect()], expected_tokens(rows))
