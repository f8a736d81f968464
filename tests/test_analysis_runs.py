"""Runs of analyzers: one row for every measurement asked for, curves of the same pass, and analyzers that break the contract."""

import json
import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from meterlake.operators import ingest, peaks, service

M = "measurement_id"
RESULTS = f"{M} string, analyzer_name string, params_fp string, analyzer_version string, outputs string, issues array<string>, result_id string"


def scan(k, tops, n=1200):
    x = 10 + 0.05 * np.arange(n)
    y = 20 + 0.1 * np.random.default_rng(k).normal(size=n) + sum(h * np.exp(-((x - c) ** 2) / (2 * 0.1**2)) for c, h in tops)
    return [(f"m{k}", i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))]


def frames(spark, rows, ids):
    points = spark.createDataFrame(rows, f"{M} string, idx int, x double, y double")
    return spark.createDataFrame([(i, "xrd") for i in ids], f"{M} string, technique string"), points, spark.createDataFrame([], RESULTS)


def test_missing_arrays_get_a_row_and_curves_are_stored(spark, tmp_path):
    rows = scan(1, [(20, 100), (40, 60)]) + scan(2, [(30, 50)]) + [("m3", i, float(i), 1.0) for i in range(9)]
    m, points, none = frames(spark, rows, ["m1", "m2", "m3", "m4"])
    a, at = service.default_registry().by_name["peak-table"], str(tmp_path / "curves")
    got = {r[M]: r for r in service.run_analysis(m, points, none, a, derived=at).collect()}
    assert {k: json.loads(r["outputs"])["n_peaks"] if r["outputs"] else None for k, r in got.items()} == {"m1": 2, "m2": 1, "m3": 0, "m4": None}
    assert got["m4"]["issues"] == [service.NO_ARRAYS] and got["m3"]["issues"] == ["fewer than 50 points"] and got["m1"]["issues"] == []
    stored = spark.read.parquet(at)
    assert {r[M]: r["n"] for r in stored.groupBy(M, "result_id").pivot("name").agg(F.count(F.lit(1))).select(M, F.col("fit").alias("n")).collect()} == {"m1": 1200, "m2": 1200}
    assert {r["result_id"] for r in stored.select("result_id").distinct().collect()} == {got["m1"]["result_id"], got["m2"]["result_id"]}
    wide = stored.where(f"{M} = 'm1'").groupBy("idx").pivot("name").agg(F.first("value")).orderBy("idx").collect()
    assert max(abs(r["residual"]) for r in wide) < 1 and all(abs(r["observed"] - r["fit"] - r["residual"]) < 1e-9 for r in wide)
    kept = spark.createDataFrame(list(got.values()), RESULTS)
    again = service.run_analysis(m, points, kept, a, derived=at)
    assert sorted(r["result_id"] for r in again.collect()) == sorted(r["result_id"] for r in got.values()) and spark.read.parquet(at).count() == stored.count()


def test_one_pass_gives_table_and_curve(spark):
    rows = scan(1, [(20, 100), (40, 60)]) + [("m3", 0, 1.0, 1.0)]
    _, points, _ = frames(spark, rows, [])
    both = peaks.analyse(points)
    table = {r[M]: r.asDict() for r in both.where("tag = 'result'").select(M, *peaks.TABLE).collect()}
    assert table == {r[M]: r.asDict() for r in peaks.peak_table(points).collect()}
    assert both.where("tag = 'curve'").count() == 1200 and both.where("tag = 'curve' and n_peaks is not null").count() == 0
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapGroupsInPandas") == 1


def test_more_peaks_than_are_kept_are_a_warning(spark):
    rows = scan(1, [(12 + 0.5 * k, 100 + k) for k in range(100)]) + scan(2, [(30, 50)])
    _, points, _ = frames(spark, rows, [])
    table = {r[M]: r for r in peaks.peak_table(points).collect()}
    assert table["m1"]["n_peaks"] <= 80 and "100 peaks, of which the 80 highest are kept" in table["m1"]["issues"] and not table["m2"]["issues"]
    assert table["m1"]["state"] == "warning"
    p = peaks.prepared(points)
    assert [tuple(r) for r in peaks.capped(p).collect()] == [("m1", "peaks", "warning", "100 peaks, of which the 80 highest are kept")]
    assert peaks.capped(p, {"most": 200}).count() == 0


def analyzer(analyze):
    return service.Analyzer("probe", "1.0.0", ("xrd",), analyze)


@pytest.mark.parametrize(("twist", "says"), [
    (lambda r: r.union(r), "more than one result"), (lambda r: r.limit(0), "no result for a measurement with points"),
    (lambda r: r.union(r.withColumn(M, F.lit("other"))), "not asked for"), (lambda r: r.withColumn("outputs", F.lit("[1]")), "no JSON object"), (lambda r: r.withColumn("outputs", F.lit("{")), "no JSON object"),
])
def test_analyzers_that_break_the_contract_fail_the_job(spark, twist, says):
    m, points, none = frames(spark, [("m1", 0, 1.0, 1.0)], ["m1"])
    ok = lambda p: p.groupBy(M).agg(F.lit("{}").alias("outputs"), F.array().cast("array<string>").alias("issues"))
    assert service.run_analysis(m, points, none, analyzer(lambda p, o, keep: service.Analysis(ok(p)))).count() == 1
    with pytest.raises(PySparkException, match=says):
        service.run_analysis(m, points, none, analyzer(lambda p, o, keep: service.Analysis(twist(ok(p))))).collect()


@pytest.mark.parametrize("shape", [
    lambda p: p, lambda p: service.Analysis(p), lambda p: service.Analysis(p.select(M, F.lit("{}").alias("outputs"), F.lit("x").alias("issues"))),
    lambda p: service.Analysis(p.select(M, F.lit("{}").alias("outputs"), F.array(F.lit("x")).alias("issues")), p.select(M, "idx")),
])
def test_bad_shapes_are_errors(spark, shape):
    m, points, none = frames(spark, [("m1", 0, 1.0, 1.0)], ["m1"])
    with pytest.raises(TypeError):
        service.run_analysis(m, points, none, analyzer(lambda p, o, keep: shape(p)))


def test_ingested_scans_are_analysed(spark):
    text = "\n".join(f"{x} {y}" for _, _, x, y in scan(1, [(20, 100)]))
    got = ingest.ingest(spark.createDataFrame([("a/x.txt", "a/x.txt", text.encode()), ("a/y.xyz", "a/y.xyz", b"")], "path string, rel_path string, content binary"))
    r = service.run_analysis(got.measurements, got.points, spark.createDataFrame([], RESULTS), service.default_registry().by_name["peak-table"]).collect()
    assert len(r) == 1 and json.loads(r[0]["outputs"])["n_peaks"] == 1


def test_the_entry_works_without_what_the_training_text_side_needs():
    """In a process of its own, where one of its imports fails."""
    code = "import sys; sys.modules['public_tokenizers'] = None; import __spark_entry__ as e; q = e.queries(); assert 'a01_band_gap' in q and 'pipeline' not in q and not any(k.startswith('op1_') for k in q); assert 'a01_band_gap' in e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), timeout=120)
