"""Alignment, resampling and chat formatting against brute force, on odd tables too."""

import hashlib
import json
import math
import random
from collections import Counter
from zlib import crc32

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from beamline.llm import alignment, chat, common, importance

DOCS = "doc_id long, text string, lang string"


# --- alignment ---------------------------------------------------------------------


@pytest.fixture(scope="module")
def both():
    return alignment.Aligner(*alignment.vocabularies())


def whole(own, text):
    """Tokens of a whole text on both sides, or none."""
    if not text:
        return [], []
    a = own.a.encode(" " + text, add_special_tokens=False).ids
    b = own.b.encode(text)
    data = (" " + text).encode()
    same = b"".join(own.a_bytes[k] for k in a) == data == b"".join(own.b_bytes[k] for k in b)
    return (a, b) if same else ([], [])


def spans(ids, widths):
    at, out = 0, []
    for k in ids:
        out.append((at, at + len(widths[k])))
        at += len(widths[k])
    return out


def brute_alignments(own, texts):
    pairs, count, groups = [], Counter(), []
    for text in texts:
        a, b = whole(own, text)
        sa, sb = spans(a, own.a_bytes), spans(b, own.b_bytes)
        mine = [(x, y) for x, (i, k) in zip(a, sa) for y, (m, n) in zip(b, sb) if i < n and m < k]
        pairs.append(mine)
        count.update(mine)
        ends = sorted({e for _, e in sa} & {e for _, e in sb})
        cut, i, j = [], 0, 0
        for end in ends:
            ka = sum(e <= end for _, e in sa)
            kb = sum(e <= end for _, e in sb)
            cut.append(f"{','.join(map(str, a[i:ka]))}|{','.join(map(str, b[j:kb]))}")
            i, j = ka, kb
        groups.append((len(a), len(b), cut))
    top = {}
    for (_, y), n in count.items():
        top[y] = max(n, top.get(y, 0))
    return [(n_a, n_b, len(cut), len(p), sum(count[x] == top[x[1]] for x in p), sum(count[x] for x in p), ";".join(cut) if cut else None) for (n_a, n_b, cut), p in zip(groups, pairs)]


TEXTS = [
    None, "", " ", "  ", "\n", "\t", "a", " a", "a ", "a  b", "Hello, world! It's 3.14", "x\n\ny\t z", "▁", "a▁b", "fine but ▁ here", "naïve café du　monde", "日本語 テキスト",
    "<|endoftext|> <s> </s> <unk> <0x0A>", "if (a) {\r\n  b();\r\n}\r\n", "trailing\r", "tail \r", "\r\nlead", "tab\there\x0bthere\x0c\x1cx", "🙂🙂 emoji ", "don't we'll I'VE", "a b c", "é combining", "nul\0byte",
    "word " * 50, "Hello, world! It's 3.14", "x" * 700,
]


def test_alignments_are_those_of_whole_texts(spark, both):
    rows = [(i, t, "n") for i, t in enumerate(TEXTS)]
    expected = {i: e for (i, _, _), e in zip(rows, brute_alignments(both, TEXTS))}
    for chars, sent in ((1, 0), (200, 10**6), (alignment.BLOCK_CHARS, 0)):  # a block a document, some, one a task
        found = alignment.alignments(spark.createDataFrame(rows, DOCS).repartition(3), block_chars=chars, sent_pairs=sent).collect()
        assert {r[0]: tuple(r[1:]) for r in found} == expected


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\t\r\x0b\x1c\x85 　a'sl.;){▁é日"), st.characters(codec="utf-8")), max_size=30))
def test_segments_are_tokenised_as_in_their_text(text):
    own = test_segments_are_tokenised_as_in_their_text.own = getattr(test_segments_are_tokenised_as_in_their_text, "own", None) or alignment.Aligner(*alignment.vocabularies())
    segments = own.segments(text)
    assert "".join(segments) == (" " + text if text else "")
    a = [k for s in segments for k in own.a.encode(s, add_special_tokens=False).ids]
    b = [k for ids in own.b_ids(segments) for k in ids] if segments else []
    assert a == (own.a.encode(" " + text, add_special_tokens=False).ids if text else [])
    assert b == (own.b.encode(text) if text else [])


def test_cuts_stand_where_the_vocabularies_allow(both):
    assert both.segments("a  b\n\nc\td\re") == [" a", "  b", "\n\nc", "\td\re"]  # "\r" follows signs in some pieces
    assert both.segments("a\r b") == [" a\r b"]


def test_odd_tables_of_documents(spark):
    empty = alignment.alignments(spark.createDataFrame([], DOCS))
    assert empty.collect() == [] and empty.columns == "doc_id n_a n_b n_groups n_links n_best count_sum groups".split()
    rows = [(None, "same text", "x"), (1, "same text", "x"), (1, "same text", "x"), (2, None, None)]
    found = sorted(map(tuple, alignment.alignments(spark.createDataFrame(rows, DOCS)).collect()), key=str)
    assert [r[1] for r in found].count(0) == 1 and len({r[1:] for r in found if r[1]}) == 1
    assert [r[6] for r in found if r[1]] == [3 * r[4] for r in found if r[1]]  # each copy counts


# --- importance --------------------------------------------------------------------


def brute_resampling(docs, target, buckets, min_words, percent):
    def grams(text):
        words, now = [], ""
        for c in text or "":
            c = chr(ord(c) + 32) if "A" <= c <= "Z" else c
            if c.isascii() and not ("0" <= c <= "9" or "a" <= c <= "z"):
                words, now = words + [now] * bool(now), ""
            else:
                now += c
        words += [now] * bool(now)
        return words + [f"{x} {y}" for x, y in zip(words, words[1:])], len(words)

    s, t = Counter(), Counter()
    for into, texts in ((s, [d[1] for d in docs]), (t, target)):
        for text in texts:
            into.update(crc32(g.encode()) % buckets for g in grams(text)[0])
    gain = [math.floor(1000 * math.log((t[k] + 1) * (sum(s.values()) + buckets) / ((s[k] + 1) * (sum(t.values()) + buckets)))) for k in range(buckets)]
    out, eligible = [], []
    for i, (doc_id, text, *_) in enumerate(docs):
        own, n = grams(text)
        weight = sum(gain[crc32(g.encode()) % buckets] for g in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(own), weight, score, None])
        if n >= min_words:
            eligible.append((-score, doc_id is None, doc_id or 0, i))
    for rank, (*_, i) in enumerate(sorted(eligible)[: percent * len(eligible) // 100], 1):
        out[i][4] = rank
    return sorted(map(tuple, out), key=str)


def test_resampling_against_a_recount(spark):
    rng = random.Random(4)
    words = "alpha Beta gamma DELTA eps é日 1 22 İ ſ".split()
    docs = [(i, rng.choice([" ", ", ", "-"]).join(rng.choices(words, k=rng.randrange(0, 60))), "x") for i in range(150)]
    docs += [(1000 + i, docs[i % 3][1], "x") for i in range(60)] + [(2000, None, "x"), (2001, "", "x"), (2002, "word " * 3000, "x"), (None, "alpha " * 30, "x"), (7, docs[7][1], "x")]
    target = ["alpha beta gamma " * 9, "1 22", None, ""]
    frame = spark.createDataFrame([(d, t, g) for d, t, g in docs], DOCS).repartition(4)
    goal = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    for buckets, percent in ((importance.BUCKETS, 25), (7, 100), (70_000, 0), (100, 60)):
        found = importance.resampled(frame, goal, buckets, percent=percent).select("doc_id", "n_features", "weight", "score", "rank")
        assert sorted(map(tuple, found.collect()), key=str) == brute_resampling(docs, target, buckets, 20, percent)


def test_resampling_of_odd_tables(spark):
    docs, goal = spark.createDataFrame([], DOCS), spark.createDataFrame([], "item_id long, text string")
    assert importance.resampled(docs, goal).collect() == []
    same = [(i, "one and the same text of ten words and ten more words as it goes on and on", "x") for i in range(40)]
    found = importance.resampled(spark.createDataFrame(same, DOCS), goal, percent=50, min_words=1).collect()
    assert {r["weight"] for r in found} == {found[0]["weight"]} and sorted(r["rank"] for r in found if r["rank"]) == list(range(1, 21))
    ties = [(5, "a b", "x")] * 4
    assert sorted(r["rank"] for r in importance.resampled(spark.createDataFrame(ties, DOCS), goal, percent=100, min_words=2).collect()) == [1, 2, 3, 4]


# --- chat --------------------------------------------------------------------------

RECORDS = [
    ({"conv_id": 5, "turn": 1, "role": "assistant", "text": "yes"}, [(5, 1, "assistant", "yes")]),
    ({"conv_id": 5, "turn": 0, "role": "user"}, [(5, 0, "user", "")]),
    ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": None}]}, [(90, None, "user", "q"), (90, None, "assistant", "")]),
    ({"id": 8, "source": {"url": "x"}, "messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}]}, [(8, None, "user", "ab")]),
    ({"system": "s", "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, [(90, None, "system", "s"), (90, None, "user", "q"), (90, None, "assistant", "a")]),
    ({"prompt": "p", "completion": "c", "id": 3}, [(3, None, "user", "p"), (3, None, "assistant", "c")]),
    ({"prompt": "p", "response": "c"}, [(90, None, "user", "p"), (90, None, "assistant", "c")]),
    ({"instruction": "do", "input": "this", "output": "o"}, [(90, None, "user", "do\n\nthis"), (90, None, "assistant", "o")]),
    ({"instruction": "do", "output": "o", "system": ""}, [(90, None, "system", ""), (90, None, "user", "do"), (90, None, "assistant", "o")]),
    ({"question": "q", "answer": 42}, [(90, None, "user", "q"), (90, None, "assistant", "42")]),
]


def test_fingerprints_select_the_mapping_of_each_layout(spark):
    records = [(json.dumps(r), 90) for r, _ in RECORDS]
    found = chat.canonical_turns(spark.createDataFrame(records, "record string, record_id long"))
    assert sorted((tuple(r[:2] + r[3:5]) for r in found.collect()), key=str) == sorted((t for _, ts in RECORDS for t in ts), key=str)
    assert {r["layout"] for r in found.collect()} == {layout.name for layout in chat.LAYOUTS}
    assert found.groupBy("layout").agg({"fingerprint": "min"}).count() == len(chat.LAYOUTS)


def test_tables_that_unite_layouts(spark):
    table = spark.createDataFrame([("p", "c", None), (None, None, [("user", "q")])], "prompt string, completion string, messages array<struct<role string, content string>>")
    found = chat.canonical_turns(chat.as_records(table, null_is_absent=True)).collect()
    assert sorted((r["layout"], r["role"], r["text"]) for r in found) == [("messages", "user", "q"), ("prompt and completion", "assistant", "c"), ("prompt and completion", "user", "p")]


def test_records_without_a_layout_stay_as_they_are(spark):
    records = [("{", 1), (None, 2), ("[1]", 3), ('{"prompt": "p"}', 4), ('{"prompt": "p", "messages": [{"role": "user", "content": "x"}]}', 5), ("{}", 6)]
    found = chat.canonical_turns(spark.createDataFrame(records, "record string, record_id long"))
    assert sorted((r["conv_id"], r["text"], r["layout"]) for r in found.where("text is not null").collect()) == [(i, t, None) for t, i in records if t]
    assert chat.formatted_conversations(found).count() == 0
    assert {(r["layout"], r["turns"]) for r in chat.layouts_found(found).collect()} >= {(None, 3)}


def test_two_layouts_of_one_fingerprint_are_refused():
    with pytest.raises(ValueError):
        chat.Registry((*chat.LAYOUTS, chat.Layout("again", (), ("question", "answer"))))


PIECES = st.lists(st.sampled_from([*chat.Template().controls, "\\", "[", "]", "<", "s>", "/", " ", "\n", "INST", "é", "x"]), max_size=12).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", ""]), PIECES), PIECES), max_size=6))
def test_formatted_turns_are_read_back(turns):
    template = chat.Template()
    said = [template.turn(role, text) for role, text in turns]
    assert list(template.turns("".join(s for s, _, _ in said))) == turns
    assert [template.unescape(s[i:k]) for s, i, k in said] == [text for _, text in turns]


def brute_chat(rows):
    by = {}
    for conv_id, turn, role, text in rows:
        by.setdefault(conv_id, []).append(((turn is not None, turn or 0), role or "", text or ""))
    out = []
    for conv_id, turns in by.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        out.append((conv_id, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return sorted(out, key=str)


def test_conversations_are_read_back_from_any_number_of_parts(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else small tables are one task
    rng = random.Random(9)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", None]), rng.choice(["", None, "</s>[INST] ok [/INST]", "a\\b", "é" * 40])) for c in (-7, 1, 2, None) for t in range(rng.randrange(1, 9))]
    rows += [(50, t, "assistant" if t % 2 else "user", f"{t} " * 20) for t in range(400)]  # a conversation over all tasks
    rows += [(3, 0, "user", "tie")] * 3 + [(3, None, "assistant", "x" * 5000)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for chars in (1, 500, chat.PART_CHARS):
        formatted = chat.chat_format(chat.as_records(table), part_chars=chars)
        found = chat.read_back(formatted).collect()
        assert sorted((tuple(r[:5]) for r in found), key=str) == brute_chat(rows)
        assert sum(r["formatted_chars"] for r in found) == sum(len(r["formatted"]) for r in formatted.collect())
    assert formatted.where("conv_id = 50").select("task").distinct().count() > 1
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    nothing = chat.read_back(chat.chat_format(chat.as_records(table.limit(0))))
    assert nothing.collect() == []


def test_queries_have_their_columns(spark):
    sf = "/root/testdata/sf0.001"
    docs = common.table(spark, sf, "documents").orderBy("doc_id").collect()
    own = alignment.Aligner(*alignment.vocabularies())
    expected = brute_counts(own, [d["text"] for d in docs])
    found = sorted(alignment.op11_alignment(spark, sf).collect())
    assert [tuple(r) for r in found] == [(d["doc_id"], *e) for d, e in zip(docs, expected)]


def brute_counts(own, texts):
    """As ``brute_alignments`` from sorted ends, for longer texts."""
    rows, count = [], Counter()
    for text in texts:
        a, b = whole(own, text)
        ends, at = [], [0, 0]
        for side, (ids, widths) in enumerate(((a, own.a_bytes), (b, own.b_bytes))):
            ends.append([])
            for k in ids:
                at[side] += len(widths[k])
                ends[side].append(at[side])
        i = j = 0
        pairs, cut, here = [], [], ([], [])
        while i < len(a):
            pairs.append((a[i], b[j]))
            x, y = ends[0][i], ends[1][j]
            if x <= y:
                here[0].append(a[i])
                i += 1
            if y <= x:
                here[1].append(b[j])
                j += 1
            if x == y:
                cut.append("|".join(",".join(map(str, side)) for side in here))
                here = ([], [])
        count.update(pairs)
        rows.append((len(a), len(b), cut, pairs))
    top = {}
    for (_, y), n in count.items():
        top[y] = max(n, top.get(y, 0))
    return [(n_a, n_b, len(cut), len(p), sum(count[x] == top[x[1]] for x in p), sum(count[x] for x in p), hashlib.sha256(";".join(cut).encode()).hexdigest() if cut else "") for n_a, n_b, cut, p in rows]
