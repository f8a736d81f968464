"""Names compared by blocks: the same edges and components as pair by pair, and components of names that are all alike without their edges."""

import random
import time

import pytest
from pyspark.sql import functions as F

from meterlake.functions import names as N
from meterlake.operators import resolve


def _odd_names() -> list[str]:
    rnd = random.Random(7)
    some = lambda letters, lo, hi: "".join(rnd.choice(letters) for _ in range(rnd.randint(lo, hi)))
    names = [some("abcde", 1, 9) for _ in range(60)] + [f"scan{rnd.randint(0, 999)}{rnd.choice(['', 'run2'])}" for _ in range(60)]
    names += [" ".join(some("abc", 1, 4) for _ in range(3)) for _ in range(20)] + [some("ab\U0001f600é", 58, 70) for _ in range(20)]
    return sorted({*names, "alpha beta", "beta\t  alpha", " alpha beta", "\U0001f600ab", "\U0001f601ab", "aaaaaaaaaa"})


@pytest.mark.parametrize(("threshold", "winkler"), [(0.5, False), (0.85, False), (0.88, True)])
def test_blocks_lose_no_pair_and_measure_to_the_last_bit(spark, threshold, winkler):
    names = _odd_names()
    one = N.jaro_winkler if winkler else N.similarity_of
    want = {(a, b): s for i, a in enumerate(names) for b in names[i + 1 :] if (s := one(a, b)) >= threshold}
    df = spark.createDataFrame([(n,) for n in [*names, "", names[0]]], "name string")
    for block in (16, 4_096):
        rows = resolve.name_edges(df, threshold, winkler, block).collect()
        assert {(r["a"], r["b"]): r["similarity"] for r in rows} == want and len(rows) == len(want)


@pytest.mark.parametrize("threshold", [0.85, 0.95, 1.0])
def test_components_of_blocks_are_those_of_the_edges(spark, threshold):
    names = _odd_names() + [f"{head}{k:05d}" for head in ("scan", "XRD", "qqqqqqqq") for k in range(0, 3_000, 50)]
    nodes = spark.createDataFrame([(n,) for n in names], "node string")
    want = resolve.components(nodes, resolve.name_edges(nodes.withColumnRenamed("node", "name"), threshold))
    for block in (24, 4_096):
        got = resolve.name_components(nodes, threshold, block)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert resolve.name_components(nodes.limit(0), threshold).count() == 0


def test_clusters_of_names_that_are_all_alike_need_no_edges(spark):
    n = 12_000  # about 70 million pairs, most of them edges
    hints = spark.range(n).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("file_path"), F.concat(F.lit("scan "), (F.col("id") + 20_000).cast("string")).alias("raw"), F.lit(1.0).alias("confidence"), F.lit(0).alias("seq"))
    began = time.time()
    found = resolve.clusters(hints).select(F.size("file_paths").alias("files"), F.size("normalized_forms").alias("forms")).collect()
    assert [tuple(r) for r in found] == [(n, n)]
    assert time.time() - began < 90
