"""Curves as long tables (measurement_id, idx, x, y): optical band gaps, baselines, noise and smoothing by windows and groups."""

from __future__ import annotations

from math import sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

#: Fixed values of the band-gap analysis.
HC_NM_EV = 1240.0
PERCENT_ABOVE = 1.5
REFLECTANCE_FLOOR = 1e-4
LEAST_POINTS, LEAST_FIT, FEW_FIT = 20, 3, 20
FIT_LOW, FIT_HIGH = 0.2, 0.8
R2_WARN = 0.95
#: Fixed values of the peak analysis.
SCAN_LEAST = 50
MAD_TO_SIGMA = 1.4826
NOISE_TIMES = 3.0
PROMINENCE_SHARE = 0.01

M = "measurement_id"


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def photon_energy(wavelength: Column) -> Column:
    return F.when(wavelength > 0, F.lit(HC_NM_EV) / wavelength)


def as_fraction(points: DataFrame) -> DataFrame:
    """y as a share within floor and 1; curves whose largest y is above 1.5 were percent."""
    most = F.max(F.when(~F.isnan("y"), F.col("y"))).over(Window.partitionBy(M))
    share = F.when(most > PERCENT_ABOVE, F.col("y") / 100).otherwise(F.col("y"))
    return points.withColumns({"was_percent": most > PERCENT_ABOVE, "y": F.least(F.greatest(share, F.lit(REFLECTANCE_FLOOR)), F.lit(1.0))})


def kubelka_munk(r: Column) -> Column:
    return (1 - r) * (1 - r) / (2 * r)


def tauc_value(f: Column, energy: Column, transition: str = "direct") -> Column:
    """(F*E)^n with n = 2 for direct gaps (and unknown types), 1/2 for indirect ones."""
    return F.sqrt(f * energy) if transition == "indirect" else (f * energy) * (f * energy)


def tauc_points(points: DataFrame, transition: str = "direct") -> DataFrame:
    """(measurement_id, idx, energy, t) of finite points of reflectance curves (x wavelength, y reflectance)."""
    p = as_fraction(points).withColumn("energy", photon_energy(F.col("x")))
    p = p.withColumn("t", tauc_value(kubelka_munk(F.col("y")), F.col("energy"), transition))
    return p.where(finite(F.col("energy")) & finite(F.col("t"))).select(M, "idx", "energy", "t", "was_percent")


def fit_window(points: DataFrame, low: float = FIT_LOW, high: float = FIT_HIGH, value: str = "t") -> DataFrame:
    """Points between two shares of their curve's largest value."""
    most = F.max(value).over(Window.partitionBy(M))
    return points.withColumn("_most", most).where(F.col(value).between(low * F.col("_most"), high * F.col("_most"))).drop("_most")


def line_fit(points: DataFrame, x: str, y: str) -> DataFrame:
    """(measurement_id, slope, intercept, r2, n, low, high) by least squares; r2 is 0 where y is constant."""
    return points.groupBy(M).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
        F.when(F.var_pop(y) == 0, 0.0).otherwise(F.regr_r2(y, x)).alias("r2"), F.count(F.lit(1)).alias("n"), F.min(x).alias("low"), F.max(x).alias("high"),
    )


def _finding(field: str, severity: str, message: str) -> Column:
    return F.struct(F.lit(field).alias("field"), F.lit(severity).alias("severity"), F.lit(message).alias("message"))


def band_gap(points: DataFrame, transition: str = "direct", low: float = FIT_LOW, high: float = FIT_HIGH) -> DataFrame:
    """(measurement_id, band_gap, slope, intercept, r2, n, low, high, issues): where the fitted line meets zero.

    One shuffle by measurement; windows and sums only. A curve that can't be fitted has a null gap and an error.
    """
    counted = points.groupBy(M).agg(F.count(F.lit(1)).alias("points"))
    fit = line_fit(fit_window(tauc_points(points, transition), low, high), "energy", "t")
    out = counted.join(fit, M, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    gap = -F.col("intercept") / F.col("slope")
    enough = (F.col("points") >= LEAST_POINTS) & (F.col("n") >= LEAST_FIT) & (F.col("slope") > 0) & (gap > 0)
    checks = [
        (F.col("points") < LEAST_POINTS, ("points", "error", "too few points")), ((F.col("n") < LEAST_FIT) & (F.col("points") >= LEAST_POINTS), ("window", "error", "too few points in the fit window")),
        ((F.col("n") >= LEAST_FIT) & (F.col("n") < FEW_FIT), ("window", "warning", "few points in the fit window")), (F.col("slope") <= 0, ("slope", "error", "slope is not positive")),
        ((F.col("slope") > 0) & (gap <= 0), ("band_gap", "error", "gap is not positive")), (F.col("r2") < R2_WARN, ("r2", "warning", "poor line")),
    ]
    found = F.filter(F.array(*[F.when(c, _finding(*x)) for c, x in checks]), lambda x: x.isNotNull())
    return out.withColumns({"issues": found, "band_gap": F.when(enough, gap)}).drop("points")


def band_gap_curve(points: DataFrame, fits: DataFrame, transition: str = "direct") -> DataFrame:
    """(measurement_id, idx, energy, t, line): transformed points with the fitted line."""
    f = fits.select(M, "slope", "intercept")
    return tauc_points(points, transition).join(f, M).select(M, "idx", "energy", "t", (F.col("slope") * F.col("energy") + F.col("intercept")).alias("line"))


# ---------------------------------------------------------------- scans


def by_x(points: DataFrame) -> DataFrame:
    """Finite points numbered anew by x, ties by idx."""
    p = points.where(finite(F.col("x")) & finite(F.col("y")))
    return p.withColumn("idx", (F.row_number().over(Window.partitionBy(M).orderBy("x", "idx")) - 1).cast("int"))


def steps(points: DataFrame) -> DataFrame:
    """(measurement_id, n, step): finite points and median distance of neighbours."""
    p = by_x(points).select(M, (F.col("x") - F.lag("x").over(Window.partitionBy(M).orderBy("idx"))).alias("d"))
    return p.groupBy(M).agg(F.count(F.lit(1)).alias("n"), F.median("d").alias("step"))


def scan_guard(points: DataFrame) -> DataFrame:
    """(measurement_id, n, step, state): error below 50 points or without a positive step."""
    return steps(points).withColumn("state", F.when(F.col("n") < SCAN_LEAST, "too_few").when(F.coalesce(F.col("step") <= 0, F.lit(True)), "no_step").otherwise("ok"))


def snip_arrays(y: Column, half_window: int) -> Column:
    """Baseline of an array: for w = 1 .. half_window every value becomes the lesser of itself and the mean of those w away; edges stay."""
    n = F.size(y)

    def at(a: Column, i: Column) -> Column:
        return F.element_at(a, (i + 1).cast("int"))

    def one(a: Column, w: Column) -> Column:
        return F.transform(a, lambda v, i: F.when((i >= w) & (i + w < n), F.least(v, (at(a, F.greatest(i - w, F.lit(0))) + at(a, F.least(i + w, n - 1))) / 2)).otherwise(v))

    return F.aggregate(F.sequence(F.lit(1), F.lit(half_window)), y, one)


def snip(y: np.ndarray, half_window: int) -> np.ndarray:
    """The same in numpy, along the last axis."""
    b = y.astype(float).copy()
    for w in range(1, half_window + 1):
        if 2 * w >= b.shape[-1]:
            break
        mean = b[..., : -2 * w] + b[..., 2 * w :]
        mean *= 0.5
        np.minimum(b[..., w:-w], mean, out=b[..., w:-w])
    return b


def baselines(points: DataFrame, half_window: int) -> DataFrame:
    """(measurement_id, idx, x, y, baseline): one group a scan, in numpy."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx", ignore_index=True)
        return pdf.assign(baseline=snip(pdf["y"].to_numpy(), half_window))

    return by_x(points).select(M, "idx", "x", "y").groupBy(M).applyInPandas(run, f"{M} long, idx int, x double, y double, baseline double")


def noise_sigma(points: DataFrame, value: str = "y") -> DataFrame:
    """(measurement_id, sigma) from the median absolute deviation of first differences."""
    d = points.select(M, (F.col(value) - F.lag(value).over(Window.partitionBy(M).orderBy("idx"))).alias("d")).where("d is not null")
    mid = d.groupBy(M).agg(F.median("d").alias("mid"))
    return d.join(mid, M).groupBy(M).agg((F.median(F.abs(F.col("d") - F.col("mid"))) * MAD_TO_SIGMA / sqrt(2)).alias("sigma"))


def prominence_threshold(points: DataFrame, share: float = PROMINENCE_SHARE, value: str = "y") -> DataFrame:
    """(measurement_id, sigma, threshold): the larger of three sigma and a share of the largest value."""
    most = points.groupBy(M).agg(F.max(value).alias("most"))
    return noise_sigma(points, value).join(most, M).select(M, "sigma", F.greatest(NOISE_TIMES * F.col("sigma"), share * F.col("most")).alias("threshold"))


def savgol_weights(window: int = 7, order: int = 2) -> np.ndarray:
    half = window // 2
    return np.linalg.pinv(np.vander(np.arange(-half, half + 1), order + 1, increasing=True))[0]


def smoothed(points: DataFrame, window: int = 7, order: int = 2) -> DataFrame:
    """(measurement_id, idx, s): least-squares smoothing of inner points by fixed weights over neighbours; the edges are left out."""
    half, w = window // 2, Window.partitionBy(M).orderBy("idx")
    terms = [float(c) * (F.lag("y", half - i).over(w) if i < half else F.lead("y", i - half).over(w) if i > half else F.col("y")) for i, c in enumerate(savgol_weights(window, order))]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return points.select(M, "idx", total.alias("s")).where("s is not null")


def overlap_groups(peaks: DataFrame, times: float = 4.0) -> DataFrame:
    """``peaks`` (measurement_id, idx, width) with cluster: neighbours whose windows idx -/+ times*width overlap, numbered from 0."""
    w = Window.partitionBy(M).orderBy("idx")
    p = peaks.withColumns({"left": F.col("idx") - times * F.col("width"), "right": F.col("idx") + times * F.col("width")})
    reach = F.max("right").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col("left") > reach), 1).otherwise(0)
    return p.withColumn("fresh", fresh).withColumn("cluster", (F.sum("fresh").over(w) - 1).cast("int")).drop("fresh", "left", "right")


def top_peaks(peaks: DataFrame, k: int = 80) -> DataFrame:
    """The k highest peaks of each scan, by position."""
    n = F.row_number().over(Window.partitionBy(M).orderBy(F.desc("height"), "idx"))
    return peaks.withColumn("_n", n).where(F.col("_n") <= k).drop("_n")


def local_maxima(points: DataFrame, value: str = "y") -> DataFrame:
    """Inner points above both neighbours."""
    w = Window.partitionBy(M).orderBy("idx")
    return points.withColumns({"_a": F.lag(value).over(w), "_b": F.lead(value).over(w)}).where(f"{value} > _a and {value} > _b").drop("_a", "_b")


def nan_free_max(points: DataFrame, value: str = "y") -> DataFrame:
    """(measurement_id, top): the largest value that is a number."""
    return points.groupBy(M).agg(F.max(F.when(~F.isnan(value), F.col(value))).alias("top"))
