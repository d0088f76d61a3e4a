"""Every stage of the pipeline and every operator on odd tables: nulls, empty and very long
texts, repeated rows, clashing columns, no rows at all."""

from collections import Counter

import pytest

import corpus_pipeline
from beamline.llm import contamination, embeddings, language, mixing, pii, quality, simhash, suffixes, tokens, urls

ITEM = "seven words that only the benchmark has"
LONG = "a very long text goes on and on " * 8000
TEXTS = ["", None, "   ", "12 34", f"before {ITEM} after", "the house and the garden of my friend", "the house and the garden of my friend", LONG, "x" * 300_000, "das haus und der garten von freund"]
CLASH = "size int, source_size int, target int, times int, taken int, lang_pred string, score string, held_out string, fp string, root string, place int, row string, spans string, own_fingerprint string, mix_whole int, rule string"


@pytest.fixture
def folder(spark, tmp_path):
    bench = spark.createDataFrame([(1, ITEM), (2, None), (3, ""), (None, "another item that is nowhere at all here"), (1, ITEM)], "item_id long, text string")
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def documents(spark):
    clash = [x.split() for x in CLASH.split(", ")]
    rows = []
    for k, text in enumerate(TEXTS + TEXTS[4:6]):
        doc_id = None if k in (1, 5) else min(k, 9)
        rows.append((doc_id, text, [None, "en", "de"][k % 3], [None, "web", "books"][k % 3], None, *[(k if kind == "int" else f"kept {k}") if k % 4 else None for _, kind in clash]))
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}")


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES) - 1))
def test_stages_keep_rows_as_they_are(spark, folder, k):
    docs, stage = documents(spark), corpus_pipeline.STAGES[k][1]
    before = Counter(tuple(r) for r in docs.collect())
    out = stage(spark, docs, folder)
    after = Counter(tuple(r) for r in out.collect())
    assert out.columns == docs.columns and after and set(after) <= set(before)
    if corpus_pipeline.STAGES[k][0] == "decontamination":
        assert before - after == Counter({r: n for r, n in before.items() if r[1] and ITEM in r[1]})
    elif corpus_pipeline.STAGES[k][0] == "simhash_dedup":
        fps = Counter(simhash.fingerprint(r[1]) for r in before.elements())
        assert Counter(simhash.fingerprint(r[1]) for r in after.elements()) == Counter(dict.fromkeys(fps, 1))
    elif corpus_pipeline.STAGES[k][0] == "language_id":
        assert not any(language.has_letter(language.positions(r[1])) is False for r in after)
    assert stage(spark, docs.limit(0), folder).count() == 0


def test_the_last_stage_has_every_row(spark, folder):
    docs, stage = documents(spark), corpus_pipeline.STAGES[-1][1]
    got = stage(spark, docs, folder).orderBy("start").collect()
    assert len(got) == docs.count() and got[0].start == 0 and got[0].doc_id is None
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:]))
    assert stage(spark, docs.limit(0), folder).count() == 0


def test_an_empty_benchmark_leaves_all(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = documents(spark)
    assert corpus_pipeline.decontamination(spark, docs, str(tmp_path)).count() == docs.count()


def test_operators_on_odd_documents(spark, folder):
    docs = documents(spark)
    n, bench = docs.count(), spark.read.parquet(f"{folder}/benchmark.parquet")
    labels = spark.createDataFrame([(0, 1, None), (None, 1, 0), (5, None, 0), (3, 1, 1), (3, 1, 1)], "doc_id long, quality int, toxic int")
    for rows in (simhash.simhash_components(docs), suffixes.repeated_bytes(docs), language.identify(docs), mixing.mix(docs), tokens.token_output(docs), pii.detect(docs), quality.resample(docs, labels)):
        assert rows.count() == n
    assert {(r.doc_id, r.item_id) for r in contamination.contained(docs, bench).collect()} == {(4, 1), (9, 1)}
    same = {r.text for r in pii.sanitise(docs).collect()}
    assert same == set(TEXTS)
    empty = docs.limit(0)
    for rows in (simhash.simhash_components(empty), suffixes.repeated_bytes(empty), language.identify(empty), mixing.mix(empty), tokens.token_output(empty), pii.detect(empty), pii.sanitise(empty), quality.resample(empty, labels.limit(0)), contamination.contained(empty, bench.limit(0)), simhash.near_dedup(empty), mixing.mixed_documents(empty)):
        assert rows.count() == 0


def test_operators_on_odd_vectors_and_pages(spark):
    vectors = spark.createDataFrame([(None, [1.0, 0.0], 1, "k"), (1, [1.0, 0.0], 1, "k"), (1, [1.0, 0.0], 1, None), (2, None, 1, "k"), (3, [1.0, 0.0], None, "k"), (4, [], 1, "k"), (5, [0.0, 1.0], 1, "k")], "vec_id long, embedding array<double>, label int, class string")
    got = sorted(((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(vectors).collect()), key=str)
    assert got == sorted([(0, 2, 1, False), (1, 2, 1, True), (1, 2, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True)], key=str)
    pages = spark.createDataFrame([(None, None, "x"), (1, "http://" + "a." * 40 + "net/es/" + "y" * 50_000, "x"), (1, "http://", None)], "page_id long, url string, host2 string")
    assert [r.verdict for r in urls.url_filter(pages).orderBy(urls.F.length("url")).collect()] == ["allow", "allow", "block"]
    assert urls.url_filter(pages, (), ()).where("verdict = 'allow'").count() == 3


def test_ties_of_rules_do_not_depend_on_the_blocks(spark):
    rules = [("allow", "a.com", "/x"), ("block", "com", "/xa/"), ("block", "b.org", "/"), ("allow", "b.org", "/"), ("allow", "org", "/q/r"), ("block", "b.org", "/q")]
    tables = spark.createDataFrame(rules, "verdict string, host string, path string"), spark.createDataFrame([("none.example",)], "host string")
    pages = spark.createDataFrame([(1, "http://a.com/xa/1"), (2, "http://b.org/"), (3, "http://c.b.org/q/r/s")], "page_id long, url string")
    for size in (1, 2, 100):
        found = [(r.rule, r.verdict) for r in urls.url_filter(pages, *tables, block_entries=size).orderBy("page_id").collect()]
        assert found == [("a.com/x", "allow"), ("b.org/", "block"), ("b.org/q", "block")]
    assert [(r.rule, r.verdict) for r in urls.url_filter(pages, rules, ()).orderBy("page_id").collect()] == found


def test_targets_are_met_where_doc_ids_are_null_or_repeat(spark):
    texts = [(s, f"{s} {k} " * 10) for s, n in (("a", 9), ("b", 9), ("c", 6)) for k in range(n)]
    for ids in (lambda k: None, lambda k: k % 2):
        docs = spark.createDataFrame([(ids(k), s, t) for k, (s, t) in enumerate(texts)], "doc_id long, source string, text string")
        rows = mixing.mix(docs).collect()
        for source in "abc":
            own = [r for r in rows if r.source == source]
            assert abs(sum(r.taken for r in own) - own[0].target) <= 20
        assert mixing.mixed_documents(docs).count() == sum(r.times for r in rows)
