"""Scans worked on many at a time: the same fits as one by one, points shuffled once."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from meterlake.operators import curves, peaks

M = "measurement_id"


def scans(spark, n=9):
    rng, rows = np.random.default_rng(3), []
    for m in range(n):
        x = np.arange(10, 60, 0.1 if m % 3 else 0.125)
        y = 30 + rng.normal(0, 1.5, len(x)) + sum(h * np.exp(-((x - c) ** 2) / (2 * s * s)) for c, h, s in ((18, 400, 0.3), (19.5 + m % 2, 250, 0.4), (44, 150, 0.25)))
        rows.append(pd.DataFrame({M: m, "idx": np.arange(len(x)), "x": x, "y": y}))
    rows.append(pd.DataFrame({M: n, "idx": np.arange(9), "x": np.arange(9.0), "y": 1.0}))
    return spark.createDataFrame(pd.concat(rows))


def test_many_fits_are_those_of_one_by_one():
    rng, jobs = np.random.default_rng(1), []
    for k in range(60):
        x = np.linspace(0, 10, 70 + k)
        tops = [3.0, 6.0][: 1 + k % 2]
        y = sum(peaks.profile(x, 5.0 + k % 3, c + 0.1, 0.4, 0.3) for c in tops) + rng.normal(0, 0.05, len(x)) * (k != 7)
        start = np.array([v for c in tops for v in (4.0, c, 0.3, 0.5)])
        low, high = np.array([v for c in tops for v in (0, c - 1, 0.1, 0)], float), np.array([v for c in tops for v in (np.inf, c + 1, 0.9, 1)])
        jobs.append((x, y * (np.nan if k == 11 else 1), start, low, high))
    many = peaks.fit_many(jobs)
    for job, got in zip(jobs, many, strict=True):
        one = peaks.fit_profiles(*job)
        assert (one is None) == (got is None) and (one is None or np.allclose(one, got, rtol=1e-4, atol=1e-5))
    assert many[11] is None and all(np.array_equal(a, b) for a, b in zip(peaks.fit_many(jobs[:5]), many))
    p = np.concatenate([g for g in many if g is not None]).reshape(-1, 4)
    assert np.array_equal(peaks._half_heights(p[:, 2], p[:, 3]), [peaks.true_fwhm(s, f) for s, f in p[:, 2:]])


def test_fits_and_curves_of_scans_shuffle_points_once(spark):
    points = scans(spark)
    fits = peaks.scan_fits(points)
    p = peaks.prepared(points)
    apart = peaks.fit_peak_clusters(p, curves.overlap_groups(p.where("is_peak").select(M, "idx", "x", "width")))
    order = [M, "cluster", "center"]
    a, b = (df.select(*apart.columns).toPandas().sort_values(order, ignore_index=True) for df in (fits, apart))
    pd.testing.assert_frame_equal(a, b)
    assert a[M].nunique() == 9 and a["issue"].isna().all() and len(a) >= 27
    one = peaks.fit_curves(points).toPandas().sort_values([M, "idx"], ignore_index=True)
    two = peaks.fit_curve(p, apart).toPandas().sort_values([M, "idx"], ignore_index=True)
    pd.testing.assert_frame_equal(one, two[one.columns])
    assert peaks.physical(fits).count() == peaks.physical(apart, p).count() >= 27
    for df in (fits, peaks.fit_curves(points), peaks.detect_peaks(points), peaks.peak_table(points)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Join" not in plan and "FlatMapGroups" not in plan


def test_detected_peaks_are_grouped_as_by_windows(spark):
    p = peaks.prepared(scans(spark)).where("is_peak").select(M, "idx", "x", F.col("smooth").alias("height"), "width")
    rows = lambda df: sorted(tuple(r) for r in df.select(M, "idx", "x", "height", "width", "cluster").collect())
    assert rows(peaks.detect_peaks(scans(spark))) == rows(curves.overlap_groups(p))


def test_a_point_takes_no_arrays_of_its_scan_along(spark):
    both = peaks.analyse(scans(spark))
    generate = [line for line in both._jdf.queryExecution().executedPlan().toString().splitlines() if "Generate" in line]
    assert len(generate) == 1 and f"[{M}#" in generate[0].replace("), [", "), [") and generate[0].split("), [")[-1].count("#") <= 1 + len(both.columns)
    curve = both.where("tag = 'curve'").select(M, "idx", "x", F.col("observed").alias("y"), "baseline", "fit", "residual").toPandas().sort_values([M, "idx"], ignore_index=True)
    pd.testing.assert_frame_equal(curve, peaks.fit_curves(scans(spark)).toPandas().sort_values([M, "idx"], ignore_index=True))
