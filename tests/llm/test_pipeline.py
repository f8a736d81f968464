import re
from collections import Counter

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_keep_columns_and_take_effect(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.count()
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "pii", "mixing", "packing"]
    from meterlake.llm.common import materialize

    counts = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = materialize(stage(spark, docs, sf), name)
        assert out.schema.names == docs.schema.names
        counts[name] = out.count()
        docs = out
        if name == "pii":
            assert not docs.where("text rlike '[a-z]@mail[0-9]'").count()
    assert counts["near_duplicates"] < counts["toxicity"] < rows and counts["pii"] == counts["near_duplicates"]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    total, longest = packed.selectExpr("sum(length)", "max(offset + length)").first()
    assert longest <= 4096 and total == packed.where("start = 0").selectExpr("sum(doc_tokens)").first()[0]


@pytest.fixture(scope="module")
def small_dir(spark, tmp_path_factory):
    """The smallest tables with odd rows: nulls in every column, empty and very long texts, repeats, clashing names."""
    sf, out = "/root/testdata/sf0.001", str(tmp_path_factory.mktemp("sf"))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    some = docs.where("text is not null").orderBy("doc_id").limit(2).collect()
    odd = [
        (None, None, None, None, None), (900_001, "", "en", "src1", 0), (900_002, " \n", None, None, 2), (None, some[0]["text"], "en", "src1", None),
        (900_003, some[0]["text"], "en", None, 5), (900_003, some[0]["text"], "en", None, 5), (900_004, "long words go on " * 8000, "en", "src1", 7),
        (900_005, "mail jo@ex.com or call +1 269 555 3296 today, please", "en", "src2", 1), (900_005, "an id with another text, quite another", "en", "src2", 1),
    ]
    extra = spark.createDataFrame(odd, docs.schema)
    names = ["rep", "component_id", "_copies", "_doc_row", "score", "key", "id", "start", "n", "_t", "ids", "part"]
    docs.unionByName(extra).selectExpr("*", *[f"'{n}' AS `{n}`" for n in names]).write.parquet(f"{out}/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"{out}/labels.parquet")
    return out


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


def test_stages_by_brute_force(spark, small_dir):
    from meterlake.llm import mixing, pii, toxicity
    from meterlake.llm.common import materialize
    from tests.llm.test_operators import brute_components, brute_spans

    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    step = lambda name, d: materialize(stages[name](spark, d, small_dir), name)
    at = docs.columns.index("text")

    clean = step("toxicity", docs)
    scorer = toxicity.Scorer(toxicity.train(docs, spark.read.parquet(f"{small_dir}/labels.parquet")))
    assert rows_of(clean) == Counter(tuple(r) for r in docs.collect() if scorer.score(r["text"] or "") < 0.5)

    single = step("near_duplicates", clean)
    rows = [r for r in clean.collect()]
    known = sorted({r["doc_id"] for r in rows if r["doc_id"] is not None})
    texts = [(r["doc_id"], r["text"]) for r in rows if r["doc_id"] is not None]
    _, root = brute_components([t for _, t in texts], 5, 80)
    reach = {i: {i} for i in known}
    for i, (a, _) in enumerate(texts):
        b = texts[root[i]][0]
        if reach[a] is not reach[b]:
            both = reach[a] | reach[b]
            for x in both:
                reach[x] = both
    assert rows_of(single) == Counter(tuple(r) for r in rows if r["doc_id"] is None or min(reach[r["doc_id"]]) == r["doc_id"])

    private = step("pii", single)
    field = pii.train(single)

    def redacted(text):
        spans = brute_spans(text)
        spans += [s for s in pii.find_spans(text, field)[1] if s not in spans]
        union = []
        for a, b, k in sorted((a, b, k) for k, a, b in spans):
            if union and a < union[-1][1]:
                union[-1][1] = max(b, union[-1][1])
            else:
                union.append([a, b, k])
        for a, b, k in reversed(union):
            text = text[:a] + f"<{pii.KINDS[k]}>" + text[b:]
        return text

    want = Counter()
    for r in single.collect():
        t = tuple(r)
        want[t if r["text"] is None else (*t[:at], redacted(r["text"]), *t[at + 1 : 4], len(redacted(r["text"])), *t[5:])] += 1
    assert docs.columns[4] == "n_chars" and {k[:4] + k[5:] for k in rows_of(private)} == {k[:4] + k[5:] for k in want}
    assert all(r["n_chars"] == len(r["text"]) for r in private.where("text is not null").collect())

    mixed = step("mixing", private)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    before, after = rows_of(private), rows_of(mixed)
    assert set(after) <= set(before) and all(n <= 3 * before[k] for k, n in after.items()) and all(size(k[at]) for k in after)
    target = {r["source"]: r["target"] for r in mixing.mix(private).collect()}
    largest = max(size(k[at]) for k in before)
    for source, t in target.items():
        assert abs(sum(size(k[at]) * n for k, n in after.items() if k[3] == source) - t) <= largest

    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    packed = step("packing", mixed).collect()
    stream = {}
    for p in packed:
        stream.setdefault(p["sequence_id"], []).append((p["offset"], p["doc_id"], p["start"], np.frombuffer(p["ids"], "<u4").tolist(), p["doc_tokens"]))
    flat = [(i, start, ids, n) for s in sorted(stream) for _, i, start, ids, n in sorted(stream[s])]
    found, held = Counter(), []
    for i, start, ids, n in flat:
        assert start == len(held)
        held += ids
        if len(held) == n:
            found[i, tuple(held)] += 1
            held = []
    want = Counter()
    for k, n in after.items():
        want[k[0], (*tok.encode(k[at] or "", add_special_tokens=False).ids, 2)] += n
    assert not held and found == want


def test_stages_on_empty_tables(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, small_dir)
        assert out.count() == 0 and (name == "packing" or out.columns == docs.columns)
