"""Each operator against a brute-force version, on rows that include nulls, empty and long texts, copies and clashing names."""

import hashlib
import re
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from meterlake.llm import chat, common, embedding_dedup, html_extract, jaccard_join, mixing, packing, pii, progressive_jpeg, queries, token_counts, toxicity  # noqa: E402

vocabulary = public_tokenizers.path
LONG = "the long one goes on " * 3000
TEXTS = [
    None, "", " ", "\n\t ", "one", "one two", "One two three", "one two three", LONG, LONG, "é €  😀 \x1c x", "a<|endoftext|>b",
    "mail bo.b@x.example.com, call +1 (269) 555-3296 or 10.0.0.1; 4111 1111 1111 1111.",
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, score double, copies int"


def docs(spark, texts=TEXTS, first=0):
    rows = [(first + i, t, "en", [None, "b", "a"][i % 3], None if t is None else len(t), "x", None, 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def by_id(df, key="doc_id"):
    return {r[key]: r.asDict() for r in df.collect()}


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# ---------------------------------------------------------------- media


def test_media_round_trip(spark):
    got = by_id(progressive_jpeg.text_media_digests(docs(spark)))
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        raw = (t or "").encode()
        padded = raw + bytes(-len(raw) % 64 if raw else 64)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(padded))
        assert r["payload_sha256"] == hashlib.sha256(padded).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(padded[-64:])
    assert got[8]["media_sha256"] == got[9]["media_sha256"] and got[8]["feature"] == got[9]["feature"]
    assert progressive_jpeg.text_media_digests(empty(spark)).count() == 0


def test_media_tensors(spark):
    stored = progressive_jpeg.store_texts(docs(spark, ["hello world"]))
    r = progressive_jpeg.decode_media(stored).first()
    assert (r["height"], r["width"]) == (16, 16) and len(r["rgb"]) == 16 * 16 * 3


def test_scans_add_up_for_any_coefficients():
    """Long zero runs, single bits, both signs, and the refinement scans."""
    rng = np.random.default_rng(3)
    for odds in (0.02, 0.3, 1.0):
        x = rng.integers(-255, 256, (6 * 4, 64)) * (rng.random((24, 64)) < odds)
        x[rng.random(x.shape) < 0.1] = 1
        x[0], x[1], x[2, 1:] = 0, -1, 0
        (file,) = progressive_jpeg.encode_coefficients([(2, 2, x.astype(np.int16))])
        _, (back,) = progressive_jpeg.decode_coefficients([file])
        assert (back == x).all()


def test_inverse_transform_matches_the_formula():
    c = np.zeros((1, 64), np.int32)
    c[0, :4] = [40, -30, 25, 10]
    natural = np.zeros(64)
    natural[progressive_jpeg.ZIGZAG] = c[0]
    f = natural.reshape(8, 8)
    want = np.zeros((8, 8))
    for y in range(8):
        for x in range(8):
            for v in range(8):
                for u in range(8):
                    k = (0.5**0.5 if u == 0 else 1) * (0.5**0.5 if v == 0 else 1) / 4
                    want[y, x] += k * f[v, u] * np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * v * np.pi / 16)
    got = progressive_jpeg.samples(c, np.ones(64, np.int64)).reshape(8, 8).astype(float) - 128
    assert np.abs(got - want).max() <= 1


def test_broken_media_gives_null(spark):
    (file,) = progressive_jpeg.encode_payloads([b"x" * 64])
    with pytest.raises((ValueError, IndexError)):
        progressive_jpeg.decode_coefficients([b"no jpeg" + file])
    df = spark.createDataFrame([(1, bytearray(file)), (2, bytearray(b"no jpeg")), (3, None), (4, bytearray(file[:20])), (5, bytearray(file))], "doc_id long, media binary")
    got = by_id(progressive_jpeg.decode_media(df))
    assert [got[i]["rgb"] is None for i in range(1, 6)] == [False, True, True, True, False] and got[1]["rgb"] == got[5]["rgb"]


def hand_made_jpeg(width, height, factors, blocks):
    """A progressive file written bit by bit: DC in one scan, AC 1-63 of each component in another, end-of-band runs over many blocks.

    ``blocks``: DC of each block by component, in scan order; the first component's first block also has AC 1 = 2.
    """
    def segment(mark, body):
        return bytes([0xFF, mark]) + (len(body) + 2).to_bytes(2, "big") + body

    def coded(bits):
        bits += "1" * (-len(bits) % 8)
        return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")

    n = len(factors)
    out = b"\xff\xd8" + segment(0xDB, b"\x00" + b"\x08" + b"\x01" * 63)
    out += segment(0xC2, b"\x08" + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([n]) + b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(factors)))
    # DC: sizes 0 to 7, three bits each (the eighth code is 1110); AC: run/size 0x02, end of band runs 0x00, 0x30, two bits each
    dc = {s: format(s, "03b") for s in range(7)} | {7: "1110"}
    out += segment(0xC4, b"\x00" + bytes([0, 0, 7, 1] + [0] * 12) + bytes(range(8))) + segment(0xC4, b"\x10" + bytes([0, 3] + [0] * 14) + bytes([0x02, 0x00, 0x30]))
    size = lambda v: int(abs(v)).bit_length()
    value = lambda v: "" if v == 0 else format(v if v > 0 else v + (1 << size(v)) - 1, f"0{size(v)}b")
    h_max, v_max = max(h for h, _ in factors), max(v for _, v in factors)
    mcus = -(-width // (8 * h_max)) * -(-height // (8 * v_max))
    before, at, bits = [0] * n, [0] * n, ""
    for _ in range(mcus):
        for k, (h, v) in enumerate(factors):
            for _ in range(h * v if n > 1 else 1):
                d = blocks[k][at[k]] - before[k]
                before[k], at[k] = blocks[k][at[k]], at[k] + 1
                bits += dc[size(d)] + value(d)
    out += segment(0xDA, bytes([n]) + b"".join(bytes([i + 1, 0]) for i in range(n)) + b"\x00\x00\x00") + coded(bits)
    for k, (h, v) in enumerate(factors):
        wide, high = (-(-(-(-size_ * f // m)) // 8) for size_, f, m in ((width, h, h_max), (height, v, v_max)))
        left, bits = wide * high, ""
        if k == 0:
            bits, left = "00" + "10", left  # run 0 size 2: the value 2; its block then ends with the rest
        while left:
            if left >= 8:
                bits, left = bits + "10" + format(min(left, 15) - 8, "03b"), left - min(left, 15)  # 0x30: 8 to 15 blocks end here
            else:
                bits, left = bits + "01", left - 1  # 0x00: this block ends
        out += segment(0xDA, bytes([1, k + 1, 0, 1, 63, 0])) + coded(bits)
    return out + b"\xff\xd9"


@pytest.mark.parametrize("factors", [[(1, 1)], [(1, 1)] * 3, [(2, 1), (1, 1), (1, 1)], [(1, 2), (1, 1), (1, 1)], [(2, 2), (1, 1), (1, 1)], [(3, 2), (2, 1), (1, 2)]])
def test_files_of_other_makers(factors):
    """Grey, 4:4:4, 4:2:2, 4:4:0, 4:2:0 and factors that do not divide: each pixel against the formula."""
    rng = np.random.default_rng(len(factors) + factors[0][0])
    h_max, v_max = max(h for h, _ in factors), max(v for _, v in factors)
    width, height = 8 * h_max * 3 - 5, 8 * v_max * 2 - 3
    cols, rows = -(-width // (8 * h_max)), -(-height // (8 * v_max))
    blocks = [rng.integers(-40, 41, cols * rows * h * v).tolist() for h, v in factors]
    (image,), (coef,) = progressive_jpeg.decode_coefficients([hand_made_jpeg(width, height, factors, blocks)])
    rgb = progressive_jpeg.to_rgb(image, coef)
    assert rgb.shape == (height, width, 3)
    planes = []
    for k, (h, v) in enumerate(factors):
        plane, at = np.zeros((rows * v * 8, cols * h * 8)), 0
        h1, v1 = (h, v) if len(factors) > 1 else (1, 1)
        for m in range(rows * cols):
            for b in range(h1 * v1):
                y, x = (m // cols * v1 + b // h1) * 8, (m % cols * h1 + b % h1) * 8
                plane[y : y + 8, x : x + 8] = blocks[k][at] + 128
                if k == 0 and y == x == 0:
                    plane[:8, :8] += 2 / 8 * 2**0.5 * np.cos((2 * np.arange(8) + 1) * np.pi / 16)[None, :]
                at += 1
        planes.append(np.floor(plane + 0.5))
    for y in range(0, height, 3):
        for x in range(0, width, 3):
            p = [planes[k][y * v // v_max, x * h // h_max] for k, (h, v) in enumerate(factors)]
            if len(p) == 1:
                want = [p[0]] * 3
            else:
                want = [p[0] + 1.402 * (p[2] - 128), p[0] - 0.344136 * (p[1] - 128) - 0.714136 * (p[2] - 128), p[0] + 1.772 * (p[1] - 128)]
            assert np.abs(rgb[y, x] - np.clip(want, 0, 255)).max() <= 1.6, (y, x)


# ---------------------------------------------------------------- personal data


def brute_spans(t):
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub(r"\D", "", m[0])
        if 13 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0:
            out.append((2, *m.span()))
    return out + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub(r"\D", "", m[0])) <= 15]


def test_base_spans_equal_the_patterns():
    rng = np.random.default_rng(1)
    marks = list("a1.@+- (2)b9..4é_%")
    for t in ["".join(rng.choice(marks, rng.integers(0, 60))) for _ in range(4000)] + [t or "" for t in TEXTS]:
        assert pii.base_spans(t) == brute_spans(t)


def test_pii_scan(spark):
    d = docs(spark)
    weights = pii.train(d)
    assert isinstance(weights, pii.Field)
    got = by_id(pii.scan(d, weights, mask=True))
    assert got[0]["base"] == [] and got[0]["masked"] is None
    assert {s.split(":")[0] for s in got[12]["base"]} == {"email", "ip", "card", "phone"}
    assert set(got[12]["base"]) <= set(got[12]["spans"])
    assert "<email>" in got[12]["masked"] and "@" not in got[12]["masked"]
    assert pii.scan(empty(spark), weights).count() == 0
    pii.train(empty(spark))


def test_random_field_learns_spans_without_their_patterns():
    rng = np.random.default_rng(5)
    phone = lambda: f"+1 ({rng.integers(200, 999)}) 555-{rng.integers(1000, 9999)}"
    texts = [f"some words here {phone()} and more words 10.2.{rng.integers(255)}.7 end" for _ in range(150)]
    field = pii.fit(texts, plant=200)
    t = f"other talk {phone()} stops"
    tokens = next(pii.stretches(t))
    spans = [(k, t[tokens[i][0] : tokens[j - 1][1]]) for k, i, j in pii.viterbi(t, tokens, field, hide=True)]
    assert len(spans) == 1 and spans[0][0] == 3 and spans[0][1].startswith("+1")


def segmentations(n, segments, kinds):
    """All ways to cover n tokens with segments of a kind and outside tokens."""
    if n == 0:
        yield []
        return
    for head in segmentations(n - 1, [x for x in segments if x[1] <= n - 1], kinds):
        yield [*head, (kinds, n - 1, n)]
    for i, j in segments:
        if j == n:
            for head in segmentations(i, [x for x in segments if x[1] <= i], kinds):
                for k in range(kinds):
                    yield [*head, (k, i, j)]


def test_best_path_and_gradient_by_enumeration():
    rng = np.random.default_rng(17)
    out = pii.OUTSIDE
    for _ in range(40):
        n = int(rng.integers(1, 6))
        lattice = pii.Lattice.__new__(pii.Lattice)
        lattice.n = n
        lattice.segments = [(i, j) for i in range(n) for j in range(i + 1, min(n, i + 3) + 1) if rng.random() < 0.5]
        lattice.features = [rng.integers(0, 12, 3).tolist() for _ in lattice.segments]
        field = pii.Field(np.zeros((out, pii.FEATURES)), rng.normal(0, 1, (out + 1, out + 1)))
        field.weights[:, :12] = rng.normal(0, 1, (out, 12))

        def value(path, field=field, lattice=lattice):
            at, total = out, 0.0
            for k, i, j in path:
                total += field.moves[at, k] + (field.weights[k, lattice.features[lattice.segments.index((i, j))]].sum() if k != out else 0)
                at = k
            return total

        paths = list(segmentations(n, lattice.segments, out))
        best = max(paths, key=value)
        got = pii.best_path(n, lattice.segments, lattice.scores(field.weights), field.moves)
        filled, at = [], 0
        for k, i, j in got:
            filled += [(out, x, x + 1) for x in range(at, i)] + [(k, i, j)]
            at = j
        assert value(filled + [(out, x, x + 1) for x in range(at, n)]) == pytest.approx(value(best))
        gold = paths[int(rng.integers(len(paths)))]
        marked = {g for g in gold if g[0] != out}
        loss = lambda: value(gold) - np.logaddexp.reduce([value(p) for p in paths])
        grad, moves = np.zeros_like(field.weights), np.zeros_like(field.moves)
        assert pii.likelihood(lattice, marked, field, grad, moves) == pytest.approx(loss())
        for array, slopes, at in [(field.weights, grad, (int(rng.integers(out)), int(rng.integers(12)))), (field.moves, moves, tuple(rng.integers(0, out + 1, 2)))] * 3:
            kept = array[at]
            array[at] = kept + 1e-5
            up = loss()
            array[at] = kept - 1e-5
            assert slopes[at] == pytest.approx((up - loss()) / 2e-5, abs=1e-4)
            array[at] = kept


def test_long_stretches_are_decided_as_a_whole():
    """Piece by piece or at once, and a field span beyond any number of marked tokens."""
    rng = np.random.default_rng(18)
    field = pii.fit([], plant=300, epochs=2)
    for _ in range(30):
        t = " ".join(rng.choice(["4111", "555-2896", "x", "call", "2695553296", "10", "[.]", "jo(at)ex.com", "at", "dot", "card"], 40))
        for tokens in pii.stretches(t):
            lattice = pii.Lattice(t, tokens)
            assert pii.viterbi(t, tokens, field) == pii.best_path(lattice.n, lattice.segments, lattice.scores(field.weights), field.moves)
    far = "1 " * 9000 + "jo (at) example (dot) com"
    assert any(far[a:b] == "jo (at) example (dot) com" for _, a, b in pii.find_spans(far, pii.fit([], plant=600))[1])


@pytest.fixture(scope="module")
def field():
    return pii.fit(["some words of a text that holds 12 things", "und noch ein paar Wörter, 7 davon, für den Satz", "y unas palabras que dicen 3 cosas"] * 20)


@pytest.mark.parametrize(("text", "kind", "span"), [
    ("please write to jo at example dot com today", 0, "jo at example dot com"), ("mail: jane.doe [at] host [dot] org", 0, "jane.doe [at] host [dot] org"),
    ("the router 10[.]0[.]12[.]7 answers", 1, "10[.]0[.]12[.]7"), ("my credit card number 4111 1111 1111 1112 was refused", 2, "4111 1111 1111 1112"),
    ("call 269-555-3296 for more", 3, "269-555-3296"), ("unser Telefon (030) 123-4567 ist besetzt", 3, "(030) 123-4567"),
])
def test_field_adds_what_no_pattern_takes(field, text, kind, span):
    base, spans = pii.find_spans(text, field)
    assert base == [] and [(k, text[a:b]) for k, a, b in spans] == [(kind, span)]


@pytest.mark.parametrize("text", [
    "order 4111 1111 1111 1112 was shipped", "published 2024-05-17 on page 1234567", "isbn 978-3-1614-8410-0 in stock", "look at example and dot the line", "version 1.2.13.400.5",
    "token = \"9c8b45435718dcc700c184a7e303cdc64c6a8f7f\"", "in 1999 and 2004 about 12,000,000 people",
])
def test_field_leaves_look_alikes(field, text):
    assert pii.find_spans(text, field)[1] == []


def test_field_spans_never_overlap(spark, field):
    rng = np.random.default_rng(19)
    for _ in range(200):
        t = " ".join(rng.choice(["call", "4111", "1111", "card", "555-2896", "(269)", "+1", "jo@ex.com", "jo", "at", "ex", "dot", "com", "10.0.0.1", "10[.]0", "x"], 25))
        base, spans = pii.find_spans(t, field)
        assert set(base) <= set(spans) and base == brute_spans(t)
        own = sorted((a, b) for k, a, b in spans if (k, a, b) not in base)
        assert all(b <= c for (_, b), (c, _) in zip(own, own[1:]))


def test_redact_keeps_rows_and_columns(spark, field):
    d = docs(spark, TEXTS + ["jo at ex dot com", TEXTS[12], TEXTS[12]])
    out = pii.redact(d, field)
    assert out.schema == d.schema
    got = by_id(out)
    assert len(got) == len(TEXTS) + 3 and got[0]["text"] is None and got[1]["text"] == "" and got[8] == by_id(d)[8]
    assert got[len(TEXTS) + 1]["text"] == got[12]["text"] and got[12]["n_chars"] == len(got[12]["text"])
    assert "@" not in got[12]["text"] and got[12]["text"].count("<") == 4
    assert pii.redact(d.select("doc_id", "text").limit(0), field).count() == 0
    repeated = pii.redact(docs(spark, [TEXTS[12]] * 2).selectExpr("1L AS doc_id", "text"), field).collect()
    assert len(repeated) == 2 and repeated[0] == repeated[1]


@pytest.mark.parametrize("unit", ["10.2.3.4 ", "4111 1111 1111 1111, ", "bo@x.example.com ", "+1 269 555 3296; ", "12 words 7 "])
def test_lists_of_numbers_and_addresses_take_time_that_grows_with_their_length(field, unit):
    from time import process_time

    took = []
    for size in (60_000, 240_000):
        text = unit * (size // len(unit))
        t = process_time()
        base, spans = pii.find_spans(text, field)
        took.append(process_time() - t)
        assert set(base) <= set(spans)
    assert took[1] < 8 * took[0] + 0.5


def test_scan_digests_by_brute_force(spark, field):
    rows = queries.op2_pii(spark, "/root/testdata/sf0.001").collect()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        base = brute_spans(texts[r["doc_id"]])
        shown = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in base)
        assert r["base_sha256"] == hashlib.sha256(shown.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x == i for x, _, _ in base) for i in range(4)]
        assert set(filter(None, shown.split(","))) <= set(r["spans"].split(","))


# ---------------------------------------------------------------- toxicity


def test_toxicity_learns_and_locates(spark):
    rng = np.random.default_rng(2)
    words = [f"word{i}" for i in range(80)]
    texts, marks = [], []
    for i in range(300):
        s = [" ".join(rng.choice(words, 8)) for _ in range(rng.integers(1, 9))]
        bad = i % 3 == 0
        if bad:
            s[rng.integers(len(s))] += " vileword"
        texts.append(". ".join(s))
        marks.append((i, 1, int(bad)))
    d = docs(spark, texts)
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    w = toxicity.train(d, labels)
    got = by_id(toxicity.score(d, w, locate=True))
    assert np.mean([(got[i]["score"] >= 0.5) == (i % 3 == 0) for i in range(300)]) > 0.97
    assert any("vileword" in s for s in got[0]["offending"])
    assert toxicity.keep_clean(d, w).schema == d.schema
    nulls = by_id(toxicity.score(docs(spark), w))
    assert nulls[0]["score"] == 0 and nulls[1]["score"] == 0 and nulls[8]["score"] == nulls[9]["score"]
    assert toxicity.score(empty(spark), toxicity.train(empty(spark), labels)).count() == 0


def test_noisy_or_and_its_gradient_by_brute_force():
    rng = np.random.default_rng(15)
    for _ in range(50):
        z, y = rng.normal(0, 2, rng.integers(1, 6)), float(rng.integers(2))
        loss = lambda z: (lambda s: -np.log(s if y else 1 - s))(1 - np.prod([1 - 1 / (1 + np.exp(-v)) for v in z]))
        score, g = toxicity.bag_gradient(z, y)
        assert score == pytest.approx(1 - np.prod(1 - 1 / (1 + np.exp(-z))))
        for k in range(len(z)):
            step = np.eye(len(z))[k] * 1e-6
            assert g[k] == pytest.approx((loss(z + step) - loss(z - step)) / 2e-6, abs=1e-5)


def test_scores_are_noisy_or_over_sentences():
    rng = np.random.default_rng(16)
    w = toxicity.fit(["good words here. fine talk", "vile stuff now. fine talk"] * 20, [0, 1] * 20)
    scorer = toxicity.Scorer(w)
    texts = ["", " ", "Vile stuff", "vile\tstuff " * 90, "fine talk! " * 50 + "vile stuff"] + [" ".join(rng.choice(["vile", "stuff", "fine", "talk.", "now"], 60)) for _ in range(20)]
    for t in texts:
        none = 1.0
        for x in re.split(r"[.!?\n]+", t.lower()):
            own = x.split()
            for i in range(0, len(own), 40):
                b = {b for v in own[i : i + 40] for b in toxicity.Features().buckets(v)}
                none *= 1 - 1 / (1 + np.exp(-(w[-1] + sum(w[k] for k in b))))
        assert scorer.score(t) == pytest.approx(1 - none, abs=1e-9)


def test_toxicity_of_one_label_and_repeated_ids(spark):
    d = spark.createDataFrame([(1, "some words"), (1, "other words"), (2, None), (3, "x" * 30_000)], "doc_id long, text string").selectExpr("*", "1 AS toxic", "0.5 AS score")
    for y in (0, 1):
        labels = spark.createDataFrame([(1, y), (1, 0), (3, y), (None, 1)], "doc_id long, toxic int")
        got = sorted((r["doc_id"], round(r["score"])) for r in toxicity.score(d, toxicity.train(d, labels)).collect())
        assert got == [(1, y), (1, y), (2, 0), (3, y)]


def test_toxicity_on_held_out_rows(spark):
    import pyspark.sql.functions as F

    got = queries.op3_toxicity(spark, "/root/testdata/sf0.01").where("held_out").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    right = got.agg(F.avg((F.col("predicted") == F.col("toxic")).cast("int"))).first()[0]
    assert right >= 0.9


# ---------------------------------------------------------------- vectors


def test_vectors_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((60, 16))
    rows = [(i, (base[i % 60] + 0.1 * rng.standard_normal(16)).tolist(), i % 2, "x") for i in range(240)]
    rows += [(300 + i, rows[0][1], 0, "copy") for i in range(5)]
    odd = [(400, None, 0, ""), (401, [0.0] * 16, 0, ""), (402, [float("nan")] * 16, 0, ""), (403, [None] + [1.0] * 15, 0, ""), (404, rows[0][1], None, ""), (405, [1.0], 0, "")]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int, component_id string")
    got = by_id(embedding_dedup.near_duplicates(df, passes=10, window=8), "vec_id")
    kept = {r["vec_id"]: np.array(r["embedding"], float) for r in df.where("vec_id < 400").collect()}
    label = {r[0]: r[2] for r in rows}
    links = {a: [b for b in kept if b != a and label[a] == label[b] and kept[a] @ kept[b] / np.linalg.norm(kept[a]) / np.linalg.norm(kept[b]) >= 0.93] for a in kept}
    for a in kept:
        todo, seen = [a], {a}
        while todo:
            for b in links[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        assert (got[a]["n_links"], got[a]["component_id"], got[a]["kept"]) == (len(links[a]), min(seen), a == min(seen))
    for a in range(400, 406):
        assert (got[a]["n_links"], got[a]["component_id"], got[a]["kept"]) == (0, a, True)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_large_components_go_tile_by_tile(spark):
    rng = np.random.default_rng(6)
    v = rng.standard_normal(8)
    df = spark.createDataFrame([(i, (v + 0.02 * rng.standard_normal(8)).tolist(), i) for i in range(40)], "rep long, vector array<double>, x int")
    members = df.selectExpr("0L AS component", "rep", "2L AS copies", "vector")
    got = embedding_dedup.component_links(members, 0.9, tile=7).collect()
    assert len(got) == 40 and all(r["links"] == 78 for r in got)


def test_isolated_pairs_in_a_crowded_label(spark):
    rng = np.random.default_rng(8)
    n, half = 4000, 200
    v = rng.standard_normal((n, 32)) / np.sqrt(32) + np.ones(32) / np.sqrt(32)  # mean cosine 0.5
    x = v[:half] / np.linalg.norm(v[:half], axis=1)[:, None]
    u = rng.standard_normal(x.shape)
    u -= (u * x).sum(axis=1)[:, None] * x
    u /= np.linalg.norm(u, axis=1)[:, None]
    t = rng.uniform(0.931, 0.95, half)[:, None]
    v[half : 2 * half] = t * x + np.sqrt(1 - t * t) * u
    df = spark.createDataFrame([(i, a.tolist(), 0) for i, a in enumerate(v)], "vec_id long, embedding array<double>, label int")
    got = by_id(embedding_dedup.near_duplicates(df, passes=4, window=10), "vec_id")
    assert np.mean([got[i]["component_id"] == got[i + half]["component_id"] for i in range(half)]) >= 0.97


def test_small_labels_lose_no_isolated_pair(spark):
    rng = np.random.default_rng(12)
    labels, n = 60, 50
    v = rng.standard_normal((labels * n, 32))
    x = v[::n] / np.linalg.norm(v[::n], axis=1)[:, None]
    u = rng.standard_normal(x.shape)
    u -= (u * x).sum(axis=1)[:, None] * x
    v[1::n] = 0.9301 * x + np.sqrt(1 - 0.9301**2) * u / np.linalg.norm(u, axis=1)[:, None]
    df = spark.createDataFrame([(i, a.tolist(), i // n) for i, a in enumerate(v)], "vec_id long, embedding array<double>, label int")
    got = by_id(embedding_dedup.near_duplicates(df), "vec_id")
    assert all(got[i * n + 1]["component_id"] == i * n and got[i * n]["n_links"] == 1 for i in range(labels))


def test_labels_of_many_tiles_pair_by_pair(spark):
    rng = np.random.default_rng(9)
    v = rng.standard_normal((60, 6))
    v[30:] = v[:30] + 0.01
    df = spark.createDataFrame([(i, i % 2, 6, a.tolist()) for i, a in enumerate(v)], "rep long, label long, dim int, vector array<double>")
    got = {(r["a"], r["b"]) for r in embedding_dedup.all_pairs(df, 0.999, tile=7).collect()}
    assert {(i, i + 30) for i in range(30)} <= got


# ---------------------------------------------------------------- mixing


def test_mix_meets_targets(spark):
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(["w"] * int(rng.integers(1, 60))), [None, "a", "b", "c", "tiny"][int(rng.choice(5, p=[0.2, 0.2, 0.3, 0.29, 0.01]))]) for i in range(800)] + [(900, None, "a"), (901, " ", "none")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [r.asDict() for r in mixing.mix(df).collect()]
    assert len(got) == len(rows)
    size = {r[0]: len((r[1] or "").split()) for r in rows}
    names = sorted({r[2] for r in rows}, key=lambda s: (s is None, s))
    total = {s: sum(size[r[0]] for r in rows if r[2] == s) for s in names}
    weight = {s: [1, 2, 3][i % 3] for i, s in enumerate(names)}
    fixed: dict = {}
    while True:
        share = (sum(total.values()) - sum(fixed.values())) / sum(w for s, w in weight.items() if s not in fixed)
        above = [s for s in names if s not in fixed and weight[s] * share > 3 * total[s]]
        if not above:
            break
        fixed |= {s: 3.0 * total[s] for s in above}
    target = {s: fixed.get(s, weight[s] * share) for s in names}
    for r in got:
        assert r["size"] == size[r["doc_id"]] and r["taken"] <= 3 * r["size"] and r["taken"] % max(1, r["size"]) == 0
        assert r["source_size"] == total[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
    for s in names:
        assert abs(sum(r["taken"] for r in got if r["source"] == s) - target[s]) <= 60
    again = [r.asDict() for r in mixing.mix(df.repartition(7)).collect()]
    assert {r["doc_id"]: r["taken"] for r in got} == {r["doc_id"]: r["taken"] for r in again}
    assert mixing.mix(empty(spark)).count() == 0


def test_copies_beside_clashing_columns(spark):
    df = spark.createDataFrame([(i, "w " * (3 + i % 4), "ab"[i % 2], i, i, i) for i in range(40)], "doc_id long, text string, source string, _doc_row long, _copies long, _COPY long")
    out = mixing.take_copies(df)
    assert out.columns == df.columns and all(r["_doc_row"] == r["_copies"] == r["_COPY"] == r["doc_id"] for r in out.collect())
    assert mixing.take_copies(df.limit(0)).count() == 0


def test_newton_solves_the_dual(spark):
    h = spark.createDataFrame([("a", 10, 3), ("a", 5, 2), (None, 4, 5)], "source string, size long, n long")
    t = spark.createDataFrame([("a", 80.0), (None, 10.0)], "source string, target double")
    got = {r["source"]: r["lambda"] for r in mixing.balance(h, t).collect()}
    assert got["a"] == pytest.approx(np.log(2)) and got[None] == pytest.approx(np.log(0.5))


def test_copies_of_repeated_and_missing_ids(spark):
    from pyspark.sql import functions as F

    rows = [(i, "a", "w " * (5 + i % 7)) for i in range(60)] + [(None, "b", "w " * (4 + i % 5)) for i in range(40)] + [(i % 3, "c", "w " * (3 + i % 9)) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    want = {r["source"]: r["n"] for r in mixing.mix(df).groupBy("source").agg(F.sum("taken").alias("n")).collect()}
    got = mixing.take_copies(df).groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).collect()
    assert {r["source"]: r["n"] for r in got} == want and set(want) == {"a", "b", "c"}


# ---------------------------------------------------------------- chat


def test_escape_round_trip():
    rng = np.random.default_rng(9)
    parts = [*chat.CONTROLS, "\\", "<", "[", "s>", "a", "\n", "é"]
    for _ in range(3000):
        t = "".join(rng.choice(parts, rng.integers(0, 12)))
        e = chat.escape(t)
        assert chat.unescape(e) == t and not any(c in e for c in chat.CONTROLS)


def test_chat_digests(spark):
    rows = [(1, 1, "assistant", "b\\n</s>"), (1, 0, "user", "<|end|> a"), (2, None, None, None), (2, 0, "assistant", LONG), (3, 0, "assistant", ""), (3, 0, "assistant", "tie"), (3, 0, "assistant", "tie")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    path = vocabulary("byte_bpe_50k.tiktoken")
    turns = chat.format_turns(df, path)
    got = by_id(chat.read_conversations(turns, path), "conv_id")
    for conv in (1, 2, 3):
        own = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        said = "".join(t for _, _, r, t in own if r == "assistant")
        assert got[conv]["n_turns"] == len(own)
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in own).encode()).hexdigest()
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    for r in turns.collect():
        assert len(r["ids"]) == len(r["mask"]) and sum(r["mask"]) <= len(r["ids"])
    assert chat.read_conversations(chat.format_turns(df.limit(0), path), path).count() == 0


# ---------------------------------------------------------------- Jaccard


def test_conversations_begin_once(spark):
    path = queries.vocabulary("byte_bpe_50k.tiktoken")
    df = spark.createDataFrame([(1, 2, "user", "bye"), (1, 0, "user", "hi <|begin|>"), (1, 1, "assistant", "yes\\"), (None, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    c = chat.codec(path)
    parts = chat.conversation_sequences(chat.format_turns(df, path), path).orderBy("conv_id", "seq").collect()
    for conv in (None, 1):
        own = [r for r in parts if r["conv_id"] == conv]
        ids = [i for r in own for i in r["ids"]]
        assert ids[0] == c.begin and ids.count(c.begin) == 1 and len(ids) == own[-1]["start"] + len(own[-1]["ids"])
        assert all(len(r["ids"]) == len(r["mask"]) for r in own)
    ids, mask = (np.array([x for r in parts if r["conv_id"] == 1 for x in r[k]]) for k in ("ids", "mask"))
    assert chat.unescape(c.enc.decode(ids[mask == 1].tolist())) == "yes\\"


def brute_components(texts, words, percent):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()

    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b) and root[i] != root[j]:
                lo, hi = sorted((root[i], root[j]))
                root = [lo if r == hi else r for r in root]
    return [len(s) for s in sets], root


def planted(seed, n=150):
    rng = np.random.default_rng(seed)
    out = [t for t in TEXTS]
    for _ in range(n // 5):
        w = list(rng.choice([f"w{i}" for i in range(3000)], rng.integers(1, 120)))
        for _ in range(5):
            v = list(w)
            for _ in range(int(rng.integers(0, 1 + max(1, len(v) // 8)))):
                v[rng.integers(len(v))] = f"x{rng.integers(10_000)}"
            out.append(" ".join(v))
    return out


@pytest.mark.parametrize(("words", "percent", "tile"), [(3, 90, 512), (5, 80, 512), (3, 60, 4)])
def test_jaccard_components_against_all_pairs(spark, words, percent, tile):
    texts = planted(words * percent)
    got = by_id(jaccard_join.similar_components(docs(spark, texts), words=words, percent=percent, tile=tile))
    sizes, root = brute_components(texts, words, percent)
    assert [got[i]["n_shingles"] for i in range(len(texts))] == sizes
    assert [got[i]["component_id"] for i in range(len(texts))] == root


def test_jaccard_empty_and_keep_one(spark):
    assert jaccard_join.similar_components(empty(spark)).count() == 0
    d = docs(spark)
    kept = jaccard_join.keep_one(d)
    assert kept.columns == d.columns and {r["doc_id"] for r in kept.collect()} == {0, 1, 2, 3, 4, 5, 6, 8, 10, 11, 12}


def test_routing_keeps_every_pair():
    rng = np.random.default_rng(11)
    for percent in (80, 90):
        router = jaccard_join.Router(percent)
        for _ in range(400):
            both = np.sort(rng.integers(0, 1 << 63, rng.integers(1, 300), dtype=np.uint64))
            a = np.sort(np.concatenate([both, rng.integers(0, 1 << 63, rng.integers(0, len(both) // 8 + 1), dtype=np.uint64)]))
            b = np.sort(np.concatenate([both, rng.integers(0, 1 << 63, rng.integers(0, len(both) // 8 + 1), dtype=np.uint64)]))
            if 100 * len(both) >= percent * (len(a) + len(b) - len(both)):
                assert set(router.keys(a).tolist()) & set(router.keys(b).tolist())


def test_words_longer_than_a_window(monkeypatch):
    rng = np.random.default_rng(14)
    texts = [b"", b" ", b"abc " * 50 + b"x" * 300 + b" tail ", b"x" * 41, b"a b " + b"y" * 100 + b" c d"]
    texts += ["".join(rng.choice(list("ab \n\t"), rng.integers(0, 60), p=[0.5, 0.3, 0.1, 0.05, 0.05])).encode() for _ in range(300)]
    want = [(len(t.split()), jaccard_join.word_hashes(t).tolist()) for t in texts]
    assert len(jaccard_join.shingle_set(texts[4])) == 3
    for window in (1, 2, 3, 7, 10, 64):
        monkeypatch.setattr(jaccard_join, "WINDOW_BYTES", window)
        for t, (n, hashes) in zip(texts, want):
            got = jaccard_join.word_hashes(t).tolist()
            assert len(got) == n and got == hashes


def test_words_built_to_collide():
    """Thue-Morse words of two letters have one hash under every polynomial modulo 2^64 with an odd base."""
    word = "a"
    for _ in range(11):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    hashes = jaccard_join.word_hashes(f"{word} {other}".encode())
    assert len(word) == 2048 and hashes[0] != hashes[1]
    assert len(jaccard_join.shingle_set(f"x {word} y x {other} y".encode())) == 4


def test_jaccard_odd_rows(spark):
    """Repeated rows, an id with two texts, rows without an id, very long texts in tiles of their own."""
    long = " ".join(f"w{i}" for i in range(6000))
    rows = [(1, "a b c d"), (1, "a b c d"), (2, "A B C D"), (3, long), (4, long + " x"), (5, long + " x y"), (6, "p q r s"), (6, long + " z"), (None, "a b c d"), (None, None), (7, "p q r s")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n", "2 AS keys", "3 AS rep")
    for tile in (512, 2):
        got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0) for r in jaccard_join.similar_components(df, tile=tile).collect())
        assert got == [(False, 1, 2, 1), (False, 1, 2, 1), (False, 2, 2, 1), (False, 3, 5998, 3), (False, 4, 5999, 3), (False, 5, 6000, 3), (False, 6, 2, 3), (False, 6, 5999, 3), (False, 7, 2, 3), (True, 0, 0, 0), (True, 0, 2, 0)]
    kept = jaccard_join.keep_one(df)
    assert kept.columns == df.columns and kept.where("doc_id is null").count() == 2


# ---------------------------------------------------------------- tokens


def test_token_counts_equal_the_library(spark):
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    got = by_id(token_counts.token_counts(docs(spark), path))
    for i, x in enumerate(TEXTS):
        want = len(t.encode(x or "", add_special_tokens=False).ids)
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((x or "").encode()), want, want > 512)
    m, rng = token_counts.merger(path), np.random.default_rng(12)
    marks = list(" \n\ta b'sé1.,\x1c　 Zx") + ["<|endoftext|>"]
    for _ in range(1500):
        x = "".join(rng.choice(marks, rng.integers(0, 40)))
        assert m.count(x) == len(t.encode(x, add_special_tokens=False).ids)
    assert token_counts.token_counts(empty(spark), path).count() == 0


def test_packing_cuts_the_stream_of_ids(spark):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    pieces = [r.asDict() for r in packing.concat_and_cut(docs(spark), path, sequence=64).collect()]
    for i, x in enumerate(TEXTS):
        want = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        own = sorted((p for p in pieces if p["doc_id"] == i), key=lambda p: p["start"])
        assert [v for p in own for v in np.frombuffer(p["ids"], "<u4").tolist()] == want
        assert all(p["doc_tokens"] == len(want) for p in own)
    by_seq: dict = {}
    for p in pieces:
        by_seq.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    assert sorted(by_seq) == list(range(len(by_seq)))
    for s, own in by_seq.items():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at == 64 or s == len(by_seq) - 1
    assert packing.concat_and_cut(empty(spark), path).count() == 0


def test_packing_encodes_each_word_once_and_as_the_library():
    from collections import Counter

    import pyarrow as pa
    from tokenizers import Tokenizer

    path, asked = vocabulary("word_bpe_49k.json"), {"file": Counter(), "letters": Counter()}
    library = Tokenizer.from_file(path)

    class Counting:
        def __init__(self, inner, name):
            self.inner, self.name = inner, name

        def encode_batch_fast(self, texts, **more):
            asked[self.name].update(w for t in texts for w in t.split())
            return self.inner.encode_batch_fast(texts, **more)

    def same(enc, texts):
        ids, counts = enc.encode(pa.array(texts, pa.string()))
        want = [[*e.ids, 2] for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want

    enc = packing.WordEncoder(path, 2, cache_entries=3)
    enc.tokenizer, enc.lower_words = Counting(enc.tokenizer, "file"), Counting(enc.lower_words, "letters")
    texts = ["Überaus rarely, RARELY. überaus seldom!", None, "x1 rarely", " ", "İ J\u030c rarely's"] * 300
    same(enc, texts)
    assert asked["letters"] == dict.fromkeys(["überaus", "rarely", "seldom"], 1)
    assert asked["file"] == dict.fromkeys([",", ".", "!", "x1", "İ", "J\u030c", "rarely's"], 1)
    assert len(enc.known) == 3
    same(enc, [*texts[:5], "a<|endoftext|>B c", "one\x1ctwo"])
    same(packing.WordEncoder(path, 2), [x.format(c=c) for c in map(chr, range(0x370)) for x in ("{c}", "Ab{c}cD.", "é{c}É, {c}{c}")])


# ---------------------------------------------------------------- pages


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><nav><a href=/>Home</a></nav><div class="ad">Buy now</div>
<article><h1>Big &amp; small</h1><p>First   text with a number of words.<p>Second text, also of some length.<script>var a="</p>"</script>
<div class="comments"><p>What a fine article this is, thank you.</p></div><form><label>Mail</label></form></article><footer>&copy; me</footer>"""


def test_main_text(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<p>unclosed <!-- x"), (5, "u", "<article><p>" + "many words here " * 20000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS text")
    w = html_extract.train(df)
    got = by_id(html_extract.extract(df, w), "page_id")
    assert got[1]["text"] == "Big & small\n\nFirst text with a number of words.\n\nSecond text, also of some length."
    assert got[2]["text"] == got[3]["text"] == "" and len(got[5]["text"]) == len(("many words here " * 20000).strip())
    assert html_extract.extract(df.limit(0), html_extract.train(df.limit(0))).count() == 0


@pytest.mark.parametrize("page, text", [
    ("<html><head><title>T</title><meta x=1><body><p>All of it.", "All of it."),
    ("<head><title>T</title><link><p>All of it.</p>", "All of it."),
    ("<head><title>T</title>All <b>of it.</b>", "All of it."),
    ("<head><title>T<body><p>All of it.</p>", "All of it."),
    ("<p>All <svg width='1'/>of it.", "All of it."),
    ("<p>All of it.<svg><path d=''><p>Rest.<svg><title>icon</title></svg>", "All of it. Rest."),
    ("<p>All of it.</p><select><option>a<div>Rest.</div>", "All of it. Rest."),
    ("<p>All of it.<button>Go</p>Rest.", "All of it. Rest."),
    ("<p>All of it.<textarea>x<p>Rest.", "All of it. Rest."),
    ("<p>All of it.<iframe src='a'/><p>Rest.<iframe>z</iframe>", "All of it. Rest."),
    ("<head><noscript><div>n</div></noscript><title>T</title></head><body>All of it.", "All of it."),
    ("<p>All <noscript><p>n</p></noscript>of it.<template><div>t</div></template>", "All of it."),
    ("<p>All <textarea><script><!-- </textarea>of it. <svg>a<svg>b</svg>c</svg>", "All of it."),
])
def test_omitted_ends_lose_no_text(page, text):
    assert " ".join(b.text for b in html_extract.blocks_of(page)) == text


@pytest.mark.parametrize("page, text", [
    ("<svg class=i/><article><p>All of it.</p></article>", "All of it."),
    ("<body class='single has-sidebar'><p>All of it, all of the words.</p>", "All of it, all of the words."),
    ("<div class='post no-comments category-ads'><p>All of it, all of the words.</p></div>", "All of it, all of the words."),
    ("<article><p>if a <b then c and 1 < 2 holds.</p><p>All <of it.</p></article>", "if a <b then c and 1 < 2 holds. All <of it."),
    ("<article><header><h1>A headline</h1></header><p>All of it.</p><footer>me</footer></article>", "A headline All of it."),
    ("<article><p>All <span class='advert'>buy <b>this</b></span> of it.</p></article>", "All of it."),
    ("<article><p>All <span class='lead'>of</span> it.</p><div hidden>not this</div><div style='display: none'>nor this</div></article>", "All of it."),
    ("<article><p title='hidden a > b'>All of <a href=x>it</a>.</p></article><div class='siteFooter'>me</div>", "All of it."),
    ("<div id=content><div class=comment-list><p>Well said by me.</p></div><p>All of it, all of the words.</p></div>", "All of it, all of the words."),
    ("<nav><ul><li><a href=x>Home</a></ul></nav><main><ul><li>All of it.</ul></main>", "All of it."),
    ("<article><p>All of it, with sources.</p><ul><li><a href=x>one</a></li><li><a href=y>two</a></li></ul><nav><a href=z>next</a></nav></article>", "All of it, with sources. one two"),
    ("<article><p>All of it.</p><div class='comments'><p>" + "A long and thoughtful comment, with much to say. " * 30 + "</p></div></article>", "All of it."),
    ("<article><p>All of it.</p></article><footer><p>" + "A long legal notice, with much to say. " * 30 + "</p></footer>", "All of it."),
    ("<article><p>&lt;b&gt; &amp;amp; caf&eacute;\u00a0x &#x41;</p></article>", "<b> &amp; café x A"),
    ("<article><table><tr><td>All<td>of it.</table><textarea>no</textarea><script>var x='</p>'</script></article>", "All of it."),
])
def test_main_text_of_odd_markup(page, text):
    for w in (html_extract.PRIOR, html_extract.fit([PAGE] * 3)):
        assert html_extract.extract_text(page, w).replace("\n\n", " ") == text


ARTICLE = "<h1>A headline</h1><p>First sentence of it, with words.</p><p>And a second one, which says more.</p><p>The third ends it.</p>"
WHOLE = "A headline First sentence of it, with words. And a second one, which says more. The third ends it."
AROUND = "<nav><ul><li><a href=x>Home</a></li><li><a href=y>News</a></li></ul></nav>{}<footer>© me</footer>"


@pytest.mark.parametrize("wrapped", [
    '<form id="aspnetForm" method="post"><div id="content">{}</div></form>', '<form><div>{}<input name=q></div></form>', '<div id="wrapper" class="right-sidebar">{}</div>',
    '<div class="site header-fixed"><main>{}</main></div>', '<article class="post comments-open">{}</article>', '<main id="main" class="search-enabled">{}</main>',
    '<article class="story share-enabled">{}</article>', '<article class="article social-policy">{}</article>', '<div class="left-sidebar two-column"><div id=text>{}</div></div>',
    '<div class="page nav-open"><div class="content">{}</div></div>', '<div id="page" class="with-menu">{}</div>', '<div class="banner-active wrap">{}</div>', '<div class="newsletter-2024">{}</div>',
    '<section class="legal">{}</section>', '<div class="post related">{}</div>', '<div class="popup-layout"><section>{}</section></div>', '<div class="SidebarRight"><div class="entry">{}</div></div>',
    '<div class="cookies-ok"><div>{}</div></div>', '<main class="login">{}</main>', '<div role="dialog" class="modal"><article>{}</article></div>', '<fieldset><div class=story>{}</div></fieldset>',
    '<div class="shareable subscribe"><div class="main">{}</div></div>', '<div id="search-page">{}</div>', '<div class="breadcrumbs-on toolbar"><article>{}</article></div>', '<dialog open><main>{}</main></dialog>',
    '<div class="menu"><div class="promo"><div class="sidebar">{}</div></div></div>', '<article id="comments-about-rivers" class="post">{}</article>',
    '<div class="notice-board"><div class="text-block">{}</div></div>', '<form class="search-form"><article>{}</article></form>',
])
def test_a_name_on_a_wrapper_empties_no_page(wrapped):
    for w in (html_extract.PRIOR, html_extract.fit([PAGE] * 3)):
        assert html_extract.extract_text(AROUND.format(wrapped.format(ARTICLE)), w).replace("\n\n", " ") == WHOLE


def test_pages_built_of_widgets_keep_each():
    parts = re.findall("<h1>.*?</h1>|<p>.*?</p>", ARTICLE)
    page = "<main>" + "".join(f'<div class="elementor-widget elementor-widget-text-editor">{p}</div>' for p in parts) + "</main>"
    assert html_extract.extract_text(AROUND.format(page), html_extract.PRIOR).replace("\n\n", " ") == WHOLE


@pytest.mark.parametrize("beside", [
    '<div class="comments"><p>{}</p></div>', '<div id="disqus_thread" class="comment-list"><div class="comment-body"><p>{}</p></div></div>', '<div class="sidebar-right"><p>{}</p></div>',
    '<div class="newsletter-signup"><p>{}</p></div>', '<form><label>Your mail</label><p>{}</p></form>', '<div class="related-posts"><p>{}</p></div>', '<div class="cookie-notice" role="dialog"><p>{}</p></div>',
    '<div class="widget-area sidebar"><div class="widget"><p>{}</p></div></div>', '<div class="social-links"><p>{}</p></div>', '<section class="post-comments"><p>{}</p></section>', '<div class="adBox"><p>{}</p></div>',
])
@pytest.mark.parametrize("times", [1, 30])
def test_names_beside_the_article_still_tell(beside, times):
    page = AROUND.format(f"<article>{ARTICLE}</article>" + beside.format("A long and thoughtful text, with much to say. " * times))
    inside = AROUND.format(f"<div id=content>{ARTICLE}" + beside.format("A long and thoughtful text, with much to say. " * times) + "</div>")
    for p in (page, inside):
        assert html_extract.extract_text(p, html_extract.PRIOR).replace("\n\n", " ") == WHOLE


def test_long_and_hostile_pages_take_time_that_grows_with_their_length():
    from time import process_time

    n = 30_000
    makers = [
        lambda n: "<a " * n, lambda n: "<a b='\"'" * n, lambda n: "<textarea>" * n, lambda n: "<button>" * n, lambda n: "<script>" * n, lambda n: "<!-- " * n,
        lambda n: "<div>" * n + "x" + "</section></div>" * n, lambda n: "<span class=ad>" * n, lambda n: "<p>Some words, and some more.<li><a>x</a></li>" * (n // 8),
        lambda n: "<p>Aa bb.</p>" * (n // 8) + "<li>x y z</li>" * (n // 8), lambda n: "<iframe a>x</iframe" * n,
    ]
    for make in makers:
        took = []
        for k in (n, 4 * n):
            t = process_time()
            html_extract.extract_text(make(k), html_extract.PRIOR)
            took.append(process_time() - t)
        assert took[1] < 12 * took[0] + 0.5


def test_cut_corrects_what_the_classifier_gets_wrong():
    """Blocks without telling markup: weak ones take the side of those around them."""
    long = "Here is a sentence of the article, with commas, and with a number of words in it. "
    page = f"<div><div>{long}</div><div>ok</div><div>{long}</div></div><div><div><a>menu one</a></div><div>so, it, is, a, b, c.</div><div><a>menu two</a></div></div>"
    blocks = html_extract.blocks_of(page)
    gain = [2.0, -0.2, 2.0, -2.0, 0.2, -2.0]
    assert html_extract.min_cut(gain, html_extract.ties(blocks)) == [True, True, True, False, False, False]


def test_cut_is_the_cheapest():
    rng = np.random.default_rng(13)
    for k in range(400):
        n = 7
        gain = rng.normal(0, (1, 0.2, 0.05)[k % 3], n).tolist()
        edges = [(i, j, float(rng.random())) for i in range(n) for j in range(i) if rng.random() < (0.4, 0.8, 0.2)[k // 3 % 3]]
        cost = lambda s: sum(g for g, k in zip(gain, s) if g > 0 and not k) - sum(g for g, k in zip(gain, s) if g < 0 and k) + sum(w for a, b, w in edges if s[a] != s[b])
        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert cost(html_extract.min_cut(gain, edges)) == pytest.approx(best)


# ---------------------------------------------------------------- shared helpers


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1100)] + [(5, 5)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["component"] for r in common.connected_components(df).collect()}
    assert got == {r["node"]: r["component"] for r in common.connected_components(df, chunk=40).collect()}
    assert all(got[i] == 0 for i in range(201)) and all(got[i] == 1000 for i in range(1000, 1100)) and len(got) == 301


def test_a_cluster_must_name_its_shared_folder():
    class Session:
        class sparkContext:
            master = "spark://host:7077"

            @staticmethod
            def getConf():
                return {}

        conf = {}

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Session)


def test_global_index_with_one_hot_key(spark):
    df = spark.range(500).selectExpr("id % 2 * 0 AS k", "id")
    got = sorted((r["id"], r["pos"]) for r in common.with_global_index(df.repartition(5), ["k", "id"]).collect())
    assert got == [(i, i) for i in range(500)]
