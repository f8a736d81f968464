"""Tables in buckets: a rerun shuffles neither stored points nor stored results, and appends and other sessions see the same rows."""

import re

from pyspark.sql import functions as F

from meterlake.operators import catalog, service
from meterlake.sources import buckets

M = "measurement_id"
RESULTS = f"{M} string, analyzer_name string, params_fp string, analyzer_version string, outputs string, issues array<string>, result_id string"


def exchanged_scans(df):
    """For each scan of a stored table, whether it is read without its buckets or shuffled before its join."""
    text = df._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = lambda line: len(line) - len(line.lstrip(" :+-*"))
    out = []
    for i, line in enumerate(text):
        if "FileScan parquet" in line and "buckets_" in line:
            above, d = [], depth(line)
            for up in reversed(text[:i]):
                if depth(up) < d:
                    d = depth(up)
                    above.append(up)
            out.append("Bucketed: true" not in line or any(re.search(r"\bExchange hashpartitioning", u) for u in above[: next((k for k, u in enumerate(above) if "Join" in u), len(above))]))
    return out


def test_stored_sides_are_not_shuffled(spark, tmp_path):
    at = f"file://{tmp_path}"
    points = spark.range(40).select(F.concat(F.lit("m"), F.col("id")).alias(M), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("idx")).selectExpr(M, "idx", "double(idx) x", "double(idx) y")
    stored = buckets.append_buckets(points, f"{at}/points", buckets=6)
    wanted = spark.createDataFrame([(f"m{k}",) for k in range(0, 60, 3)], f"{M} string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        semi = stored.join(wanted, M, "left_semi").groupBy(M).agg(F.count(F.lit(1)).alias("n"))
        assert exchanged_scans(semi) == [False] and {r[M]: r["n"] for r in semi.collect()} == {f"m{k}": 3 for k in range(0, 40, 3)}
        results = buckets.append_buckets(spark.createDataFrame([(f"m{k}", "a", "f", f"1.0.{k % 2}", "{}", [], f"r{k}") for k in range(9)], RESULTS), f"{at}/results", buckets=6)
        missing = catalog.run_misses(wanted, results, "a", F.lit("f"), "1.0.0")
        assert exchanged_scans(missing) == [False] and {r[M] for r in missing.collect()} == {f"m{k}" for k in range(0, 60, 3)} - {"m0", "m6"}
        new = spark.createDataFrame([("m3", "a", "f", "1.0.0", "{}", ["x"], "new")], RESULTS)
        merged = catalog.replace_run(results, new, "a", F.lit("f"))
        assert exchanged_scans(merged) == [False]
        assert sorted(r["result_id"] for r in merged.collect()) == sorted([f"r{k}" for k in range(9) if k != 3] + ["new"])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_one_run_joins_are_those_of_the_whole_key(spark):
    rows = [(f"m{k % 7}", "ab"[k % 2], "fg"[k % 3 % 2], f"1.0.{k % 5 % 2}", "{}", [], f"r{k}") for k in range(40)] + [(None, "a", "f", "1.0.0", "{}", [], "null"), ("m1", None, "f", "1.0.0", "{}", [], "unnamed")]
    results = spark.createDataFrame(rows, RESULTS)
    ids = spark.createDataFrame([(f"m{k}",) for k in range(9)], f"{M} string")
    wanted = ids.select(M, F.lit("a").alias("analyzer_name"), F.lit("f").alias("params_fp"), F.lit("1.0.1").alias("analyzer_version"))
    assert {r[M] for r in catalog.run_misses(ids, results, "a", F.lit("f"), "1.0.1").collect()} == {r[M] for r in catalog.result_misses(wanted, results).collect()}
    assert catalog.run_misses(ids, results, "a", F.lit("f"), "1.0.1", force=True).count() == 9
    new = spark.createDataFrame([(f"m{k}", "a", "f", "1.0.1", "{}", [], f"n{k}") for k in (0, 2, 8)], RESULTS)
    one, whole = (sorted(r["result_id"] for r in df.collect()) for df in (catalog.replace_run(results, new, "a", F.lit("f")), catalog.replace_results(results, new)))
    assert one == whole and "null" in one and "unnamed" in one


def test_appends_and_forgotten_tables(spark, tmp_path):
    at = f"file://{tmp_path}/t's"
    assert buckets.open_buckets(spark, at) is None
    a = buckets.append_buckets(spark.createDataFrame([("a", 1), (None, 2)], f"{M} string, v int"), at, buckets=3)
    assert sorted(a.select("v").collect()) == [(1,), (2,)]
    b = buckets.append_buckets(spark.createDataFrame([(3, "a")], f"v int, {M} string"), at, buckets=3)
    assert sorted(b.select("v").collect()) == [(1,), (2,), (3,)]
    for t in spark.catalog.listTables():
        if t.name.startswith("buckets_"):
            spark.sql(f"DROP TABLE {t.name}")
    again = buckets.open_buckets(spark, at, buckets=3)
    assert sorted(again.where(f"{M} = 'a'").select("v").collect()) == [(1,), (3,)]
    assert buckets.append_buckets(again.limit(0), at, buckets=3).count() == 3
