"""Near-duplicate and substring operators against brute force."""

import hashlib
import random

import numpy as np
import pytest
import xxhash

from beamline.llm import embeddings, simhash, suffixes

TEXTS = ["", None, "  ", "one", "one two", "A b C d e f g", "a B c D e f g", "Ünï çode wörds hére", "x" * 5000, "\x0b tab\x0csep words"]


def naive_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in lowered + " ":
        if c == " " or "\x09" <= c <= "\x0d":
            words, word = words + [word] * bool(word), ""
        else:
            word += c
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def components(n, linked):
    label = list(range(n))
    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint(text):
    assert simhash.fingerprint(text) == naive_fingerprint(text)


def documents():
    rng = random.Random(4)
    base = [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(200)) for _ in range(6)]
    texts = TEXTS + [t for b in base for t in (b, b, b.replace(b.split()[9], "zz", 1), " ".join(b.split()[:-1]))]
    rng.shuffle(texts)
    rows = [(k * 3, t) for k, t in enumerate(texts)] + [(0, texts[0]), (None, texts[1]), (None, "only null ids here " * 9)]
    return rows


@pytest.mark.parametrize("tile_rows", [2048, 4])
def test_simhash_components(spark, tile_rows):
    rows = documents()
    fps = [naive_fingerprint(t) for _, t in rows]
    label = components(len(rows), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 3)
    low = {}
    for (i, _), c in zip(rows, label):
        if i is not None:
            low[c] = min(low.get(c, i), i)
    expected = sorted(((i, f"{f:016x}", low.get(c)) for (i, _), f, c in zip(rows, fps, label)), key=str)
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, fp int, component_id string")
    assert sorted((tuple(r) for r in simhash.simhash_components(df, tile_rows=tile_rows).collect()), key=str) == expected
    kept = simhash.near_dedup(df, tile_rows=tile_rows)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((low.get(c) for c in set(label)), key=str)


def test_simhash_of_nothing(spark):
    assert simhash.simhash_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(4, 16))
    vectors = [(centre[k % 4] + rng.normal(size=16) * (0.05, 0.4)[k % 3 == 0]).tolist() for k in range(40)]
    vectors += [vectors[0], [0.0] * 16, None, [], [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [float("inf")] * 16, [1.0, 0.0]]
    rows = [(k * 2, v, None if k % 11 == 5 else k % 2) for k, v in enumerate(vectors)]
    ok = [v is not None and len(v) > 0 and None not in v and bool(np.isfinite(v).all()) and any(v) and lab is not None for _, v, lab in rows]

    def linked(i, j):
        if not ok[i] or not ok[j] or rows[i][2] != rows[j][2] or len(rows[i][1]) != len(rows[j][1]):
            return False
        a, b = (np.array(np.float32(rows[k][1]), np.float64) for k in (i, j))
        return a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.93

    label = components(len(rows), linked)
    expected = sorted((i, sum(linked(k, j) for j in range(len(rows)) if j != k), 2 * label[k], 2 * label[k] == i) for k, (i, _, _) in enumerate(rows))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    for tile_rows in (4096, 6):
        assert sorted(tuple(r) for r in embeddings.near_duplicates(df, tile_rows=tile_rows).collect()) == expected
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(9)
    o, q = rng.normal(size=64), rng.normal(size=64)
    o, q = o / np.linalg.norm(o), q / np.linalg.norm(q)
    found = []
    for seed in range(300):
        code, factor = embeddings.encode(o[None], seed)
        sign = (np.unpackbits(code, axis=1, count=64)[0] * 2.0 - 1) / 8
        estimate = sign @ (embeddings.rotation(64, seed) @ q) / factor[0]
        bound = np.sqrt(1 - (o @ q) ** 2) * np.sqrt(1 - factor[0] ** 2) / factor[0]
        assert abs(estimate - o @ q) <= bound + 1e-9
        found.append(estimate)
    assert abs(np.mean(found) - o @ q) < 0.02


@pytest.mark.parametrize("alphabet", [1, 2, 3, 256])
def test_suffix_array(alphabet):
    rng = random.Random(alphabet)
    for n in (0, 1, 2, 3, 7, 30, 200):
        data = bytes(rng.randrange(alphabet) for _ in range(n))
        assert suffixes.suffix_array(data).tolist() == sorted(range(n), key=lambda i: data[i:])


def removed_by_brute_force(rows):
    rank = lambda d: 2**63 - 1 if d is None else d
    texts, low = [(d, (t or "").encode()) for d, t in rows], {}
    for d, x in texts:
        for i in range(len(x) - 49):
            low[x[i : i + 50]] = min(low.get(x[i : i + 50], 2**64), rank(d))
    out = []
    for d, x in texts:
        gone = bytearray(len(x))
        for i in range(len(x) - 49):
            if low[x[i : i + 50]] < rank(d):
                gone[i : i + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(x, gone) if not g)
        out.append((d, len(x), sum(gone), sum(1 for run in bytes(gone).split(b"\0") if run), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_repeated_bytes(spark):
    rng = random.Random(3)
    base = "".join(rng.choice("ab é中") for _ in range(400))
    rows = [(None, base), (5, base), (5, base[:200]), (7, None), (8, ""), (9, "x" * 49), (10, "x" * 50), (11, "x" * 300), (12, "-" * 200 + base[100:170]), (3, base[50:120] + "qq" + base[10:65]), (4, "\0" * 80), (6, "\0" * 60 + "a")]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n_bytes int")
    for options in ({}, {"block_bytes": 100, "slice_rows": 3}, {"block_bytes": 100, "heavy": 2}):
        assert sorted((tuple(r) for r in suffixes.repeated_bytes(df, **options).collect()), key=str) == removed_by_brute_force(rows)
    assert suffixes.repeated_bytes(df.limit(0)).count() == 0


def test_op3_on_the_smallest_table(spark):
    path = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in suffixes.op3_suffixes(spark, path).collect()), key=str) == removed_by_brute_force(rows)
