"""Decontamination, fill-in-the-middle and lexical search against brute force, on rows with nulls, copies, ties and long texts."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from meterlake.llm import decontamination as D, fim, lexical_search as L  # noqa: E402
from meterlake.llm.words import words  # noqa: E402

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, items string, n_hit long, rest string"


def plain_words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def docs(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "x", 7, "y") for i, t in zip(ids or range(len(texts)), texts)], SCHEMA).repartition(3)


def items(spark, texts, ids=None):
    return spark.createDataFrame(list(zip(ids or range(len(texts)), texts)), "item_id long, text string")


ITEM = "Alpha beta, gamma delta epsilon zeta eta theta iota kappa lambda mu"
ITEMS = [None, "", " .,!", "Rare", "two words", ITEM, ITEM, "Éclair été [x] ñandú ÀÉ"]
TEXTS = [
    None, "", "?!", "rare", "RARE_rare two. Words two words", "so " + ITEM.upper() + " and on", ITEM[:-3], "éclair été x ñandú",
    "Éclair été x ñandú ÀÉ", "Éclair été x ñandú àé", ITEM + " " + ITEM, "no hit " * 40_000 + ITEM + " rare", "no hit at all", "no hit at all",
]


def brute_hits(text, texts, ids, width=10):
    w, hit, found = plain_words(text), set(), set()
    for item, t in zip(ids, texts):
        v = plain_words(t)
        k = min(width, len(v))
        grams = {tuple(v[i:i + k]) for i in range(len(v) - k + 1)} if v else set()
        for i in range(len(w) - k + 1 if k else 0):
            if tuple(w[i:i + k]) in grams:
                hit |= set(range(i, i + k))
                found.add(str(item))
    return len(w), len(hit), sorted(found)


def test_words_of_bytes_equal_words_of_characters():
    rng = random.Random(1)
    for _ in range(300):
        t = "".join(rng.choice("aZ09 _-[`{~\x00\x7f\x80\x1cÉß€😀İ ") for _ in range(rng.randrange(30)))
        assert [w.decode() for w in words(t.encode())] == plain_words(t)
    assert words(None) == words(b"") == []


@pytest.mark.parametrize("slice_bytes", [D.SLICE_BYTES, 900])
def test_hits_by_brute_force(spark, slice_bytes):
    parts = D.broadcast_slices(D.windows(items(spark, ITEMS)), slice_bytes)
    assert len(parts) == 1 or slice_bytes == 900 and len(parts) > 2
    got = {r["doc_id"]: r for r in D.scan(docs(spark, TEXTS), parts).collect()}
    assert got[0].asDict().keys() == {"doc_id", "items", "n_hit", "rest", "n_words", "_n_hit", "_items"}
    for i, t in enumerate(TEXTS):
        assert (got[i]["n_words"], got[i]["_n_hit"], got[i]["_items"]) == brute_hits(t, ITEMS, range(len(ITEMS))), i


def test_hits_in_random_texts(spark):
    rng = random.Random(2)
    say = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    tests, texts = [say(rng.randrange(0, 9)) for _ in range(12)], [say(rng.randrange(0, 60)) for _ in range(60)]
    parts = D.broadcast_slices(D.windows(items(spark, tests), width=4))
    for r in D.scan(docs(spark, texts).select("doc_id", "text"), parts).collect():
        assert (r["n_words"], r["n_hit"], r["items"]) == brute_hits(texts[r["doc_id"]], tests, range(12), 4)


def test_items_without_ids_hit_without_a_name(spark):
    parts = D.broadcast_slices(D.windows(items(spark, ["rare", "rare"], [None, 4])))
    r = D.scan(docs(spark, ["a rare one"]).select("doc_id", "text"), parts).first()
    assert (r["n_hit"], r["items"]) == (1, ["4"])
    parts = D.broadcast_slices(D.windows(items(spark, ["rare"], [None])))
    r = D.scan(docs(spark, ["a rare one"]).select("doc_id", "text"), parts).first()
    assert (r["n_hit"], r["items"]) == (1, [])


def test_empty_sides_of_a_scan(spark):
    none = D.broadcast_slices(D.windows(items(spark, ["x"]).limit(0)))
    assert none == [] and D.scan(docs(spark, ["a b"]).select("doc_id", "text"), none).first()["n_words"] == 2
    assert D.scan(docs(spark, ["a"]).limit(0), D.broadcast_slices(D.windows(items(spark, ["a"])))).count() == 0


def test_spans_and_documents_are_removed(spark):
    parts = D.broadcast_slices(D.windows(items(spark, ITEMS)))
    clean = {r["doc_id"]: r for r in D.remove_spans(docs(spark, TEXTS), parts).collect()}
    assert clean[0].asDict() == {"doc_id": 0, "text": None, "items": "x", "n_hit": 7, "rest": "y"}
    assert clean[5]["text"] == "so  and on" and clean[12]["text"] == TEXTS[12] and clean[4]["text"] == ""
    assert clean[11]["text"] == "no hit " * 40_000 and clean[10]["text"] == ""
    left = D.scan(D.remove_spans(docs(spark, TEXTS[5:8]), parts), parts).collect()
    assert all(r["_n_hit"] == 0 for r in left)
    kept = D.drop_documents(docs(spark, TEXTS), parts)
    assert kept.columns == docs(spark, TEXTS).columns
    hit = {i for i, t in enumerate(TEXTS) if brute_hits(t, ITEMS, range(len(ITEMS)))[1]}
    assert sorted(r["doc_id"] for r in kept.collect()) == [i for i in range(len(TEXTS)) if i not in hit]
    assert D.drop_documents(docs(spark, TEXTS), parts, most=0.5).where("doc_id = 11").count() == 1


# ---------------------------------------------------------------- fill in the middle

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")


@pytest.mark.parametrize("sparse", [2, 8])
def test_seek_reaches_every_rank(sparse):
    rng = random.Random(3)
    texts = ["", "a", " ", "ab cd", "😀😀a\n\n", *("".join(rng.choice("abZ  .é😀\n") for _ in range(rng.randrange(1, 200))) for _ in range(60))]
    for t in texts:
        s, units = fim.SkipList(t, sparse), UNIT.findall(t)
        assert s.units == len(units)
        assert [s.seek(r) for r in range(len(units) + 1)] == [len("".join(units[:r])) for r in range(len(units) + 1)]
    long = "word, " * 50_000
    s = fim.SkipList(long, sparse)
    assert len(s.lanes) > 3 and all(len(b[0]) <= len(a[0]) for a, b in zip(s.lanes, s.lanes[1:]))
    assert abs(len(s.lanes[1][0]) / len(s.lanes[0][0]) - 1 / sparse) < 0.02
    assert all(lane[0].sum() == s.units and lane[1].sum() == len(long) for lane in s.lanes)
    assert [s.seek(r) for r in (1, 75_000, 150_000)] == [4, 150_000, 300_000]


def brute_fim(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in range(0, 32, 8))
    u = UNIT.findall(text)
    a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(u), "plain", None, None, text
    if h4 % 100 < 20:
        return len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_the_middle_by_brute_force(spark):
    texts = [None, "", "a", "a <P> b", "<S", "x<M>", "<P <S <M P> S> M>", "The end.\n" * 30_000, "é😀 ñandú ", *["some words, 1 2 3 < <P S"] * 60]
    d = docs(spark, texts, [None, *range(1, len(texts))])
    got, shown = fim.fill_in_middle(d).collect(), fim.fill_in_middle(d.select("doc_id", "text"), digests=True).collect()
    assert len(got) == len(shown) == len(texts) and got[0].asDict().keys() >= {"items", "n_hit", "rest", "restored"}
    by = {r["doc_id"]: r for r in got}
    for i, t in zip([None, *range(1, len(texts))], texts):
        r = by[i]
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == brute_fim(i, t)
        assert r["restored"] == (t or "")
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    hashed = {r["doc_id"]: r for r in shown}
    assert all(hashed[i]["output"] == hashlib.sha256(r["output"].encode()).hexdigest() for i, r in by.items())
    assert fim.fill_in_middle(d.limit(0)).count() == 0


def test_rates_are_parameters():
    t = "one two three"
    assert all(fim.transform(t, i, rate=0)[1] == "plain" and fim.transform(t, i, rate=100, suffix_first=100)[1] == "spm" for i in range(50))
    assert len({fim.transform(t, i, seed="2")[4] for i in range(50)}) > 10


# ---------------------------------------------------------------- lexical search


def brute_search(texts, ids, queries, k=10):
    ws = [plain_words(t) for t in texts]
    tf = [Counter(w) for w in ws]
    df = Counter(t for c in tf for t in c)
    n_docs, total, out = sum(bool(w) for w in ws), sum(map(len, ws)), []
    for item, q in queries:
        scored = []
        for i, w, c in zip(ids, ws, tf):
            score = 0
            for t in plain_words(q):
                if c[t]:
                    m = 100 - 75 + (75 * len(w) * n_docs) // total
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                scored.append((-score, i is None, 0 if i is None else i))
        out += [(item, r, None if void else i, -s) for r, (s, void, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("edges", [L.EDGES, 40])
def test_search_by_brute_force(spark, edges):
    rng = random.Random(4)
    vocabulary = ["the", "of", "And", "été", *(f"w{i}" for i in range(40))]
    say = lambda n: " ".join(rng.choice(vocabulary[: rng.choice([4, 12, 44])]) for _ in range(n))
    texts = [None, "", "!?", "the " * 20_000, *[say(rng.randrange(1, 60)) for _ in range(150)]]
    texts += texts[4:24]  # ties
    ids = [None, *range(1, len(texts))]
    ids[30] = None
    queries = [(0, None), (1, "..."), (2, "unheard of words"), (3, "nothingness"), (4, "The the OF été"), *[(i, say(rng.randrange(2, 25))) for i in range(5, 25)], (6, "of w3")]
    got = L.search(docs(spark, texts, ids), spark.createDataFrame(queries, "item_id long, text string"), edges=edges)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_search(texts, ids, queries)


def test_search_of_empty_tables(spark):
    d, q = docs(spark, ["a b"]), items(spark, ["a"])
    assert L.search(d.limit(0), q).count() == L.search(d, q.limit(0)).count() == L.search(docs(spark, [None, ""]), q).count() == 0


def test_shared_sets_save_sums_and_change_none():
    rng = np.random.default_rng(5)
    common = [dict.fromkeys(rng.choice(30, 8, replace=False).tolist(), 1) for _ in range(4)]
    queries = [{**common[i % 4], **{int(t): int(n) for t, n in zip(rng.choice(200, 6), rng.integers(1, 3, 6))}} for i in range(60)] + [{}, {3: 2}]
    plan = L.share(queries)
    naive = sum(len(q) - 1 for q in queries if q)
    assert plan.additions() < 0.75 * naive
    value = rng.integers(1, 1000, 200)
    row = [int(value[t]) * n for t, n in plan.symbols]
    for parts in plan.nodes:
        assert all(p < len(row) for p in parts)  # nodes stand after what they sum
        row.append(sum(row[p] for p in parts))
    assert [sum(row[p] for p in x) for x in plan.items] == [sum(int(value[t]) * n for t, n in q.items()) for q in queries]
    assert L.share([]).items == [] and L.share(queries, paired=2).additions() <= naive


def test_long_documents_in_a_large_corpus_stay_exact():
    assert L.lengths([10**9], 10**11, 10**14).tolist() == [25 + 75 * 10**9 * 10**11 // 10**14]
