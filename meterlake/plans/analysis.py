"""Queries on curves: windows (w), statistics (g), optics (x) and composed analyses (a)."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Window, functions as F

from ..operators import curves as C, peaks as P
from ..sources.durable import shared_root
from . import carriers as c
from .registry import query

M = "measurement_id"
CURVES, SCANS = f"WITH {c.CURVES} ", f"WITH {c.SCANS} "

# ---------------------------------------------------------------- carriers with known answers


def spectra(spark, sf, transition="direct"):
    """Reflectance spectra with a known gap: 401 points from 250 to 800 nm for each vector; the gap follows from label and id."""
    e = c.read(spark, sf, "embeddings").select(F.col("vec_id").alias(M), (1.7 + 0.15 * F.col("label") + 0.01 * (F.col("vec_id") % 7)).alias("gap"))
    p = e.select(M, "gap", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(400)), lambda i: 250 + i * 1.375)).alias("idx", "x"))
    over = F.greatest(1240 / F.col("x") - F.col("gap"), F.lit(0.0))
    f = (F.sqrt(over) if transition == "direct" else over * over) / (1240 / F.col("x"))
    return p.select(M, "idx", "x", F.greatest(1 + f - F.sqrt(f * f + 2 * f), F.lit(1e-3)).alias("y"), "gap")


SPECTRA = """spectra AS (SELECT vec_id AS measurement_id, idx, x, greatest(1 + f - sqrt(f * f + 2 * f), 1e-3) AS y, gap FROM (
  SELECT *, sqrt(greatest(1240 / x - gap, 0)) / (1240 / x) AS f FROM (
    SELECT vec_id, CAST(t.i AS INTEGER) AS idx, 250 + t.i * 1.375::DOUBLE AS x, 1.7::DOUBLE + 0.15::DOUBLE * label + 0.01::DOUBLE * (vec_id % 7) AS gap FROM embeddings, unnest(range(0, 401)) AS t(i))))"""
TAUC = SPECTRA + """, tauc AS (SELECT measurement_id, idx, 1240 / x AS energy, ((1 - y) * (1 - y) / (2 * y) * (1240 / x)) * ((1 - y) * (1 - y) / (2 * y) * (1240 / x)) AS t FROM (
  SELECT measurement_id, idx, x, least(greatest(y, 1e-4), 1.0) AS y FROM spectra)),
  fitted AS (SELECT measurement_id, regr_slope(t, energy) AS slope, regr_intercept(t, energy) AS intercept, regr_r2(t, energy) AS r2, count(*) AS n, min(energy) AS low, max(energy) AS high
    FROM (SELECT *, max(t) OVER (PARTITION BY measurement_id) AS top FROM tauc) WHERE t BETWEEN 0.2 * top AND 0.8 * top GROUP BY measurement_id)"""


def diffraction(spark, sf):
    """Scans of 701 points from 10 to 80 degrees: background, four peaks that follow from the label, and noise from the vector."""
    e = c.read(spark, sf, "embeddings").select(F.col("vec_id").alias(M), "label", "embedding")
    p = e.select(M, "label", "embedding", F.explode(F.sequence(F.lit(0), F.lit(700))).alias("idx")).withColumn("x", 10 + F.col("idx") * 0.1)
    y = 200 * F.exp(-F.col("x") / 30) + 20 + 3 * F.element_at("embedding", (F.col("idx") * 7 % 64 + 1).cast("int")).cast("double")
    for k, (at, h) in enumerate(((15.0, 900.0), (28.5, 600.0), (47.3, 400.0), (63.8, 250.0))):
        d = F.col("x") - (at + 0.1 * k * F.col("label"))
        y = y + h * F.exp(-d * d / (2 * 0.3 * 0.3))
    return p.select(M, "idx", "x", y.alias("y"))


DIFFRACTION = """diffraction AS (SELECT vec_id AS measurement_id, idx, x, 200 * exp(-x / 30) + 20 + 3 * CAST(embedding[idx * 7 % 64 + 1] AS DOUBLE)
  + 900 * exp(-power(x - 15.0, 2) / 0.18) + 600 * exp(-power(x - 28.5 - 0.1 * label, 2) / 0.18) + 400 * exp(-power(x - 47.3 - 0.2 * label, 2) / 0.18) + 250 * exp(-power(x - 63.8 - 0.3 * label, 2) / 0.18) AS y
  FROM (SELECT vec_id, label, embedding, CAST(t.i AS INTEGER) AS idx, (10 + t.i * 0.1)::DOUBLE AS x FROM embeddings, unnest(range(0, 701)) AS t(i)))"""


def _r(df, *cols, digits=6):
    return df.withColumns({k: F.round(k, digits) for k in cols})


# ---------------------------------------------------------------- band gap


def band_gaps(spark, sf):
    g = C.band_gap(spectra(spark, sf).select(M, "idx", "x", "y"))
    return _r(g, "band_gap", "r2", digits=5).select(M, "band_gap", "r2", "n", F.size("issues").cast("long").alias("issues"))


query("a01_band_gap", f"WITH {TAUC} SELECT measurement_id, round(-intercept / slope, 5) AS band_gap, round(r2, 5) AS r2, n, CAST(CASE WHEN n < 20 THEN 1 ELSE 0 END + CASE WHEN r2 < 0.95 THEN 1 ELSE 0 END AS BIGINT) AS issues FROM fitted")(band_gaps)


@query("a02_band_gap_curve", f"WITH {TAUC.replace(' AS (SELECT measurement_id', ' AS MATERIALIZED (SELECT measurement_id')} SELECT measurement_id, idx, round(energy, 6) AS energy, round(t, 5) AS t, round(slope * energy + intercept, 4) AS line FROM tauc JOIN fitted USING (measurement_id)")
def _(spark, sf):
    p = spectra(spark, sf).select(M, "idx", "x", "y")
    return _r(_r(_r(C.band_gap_curve(p, C.band_gap(p)), "energy"), "t", digits=5), "line", digits=4)


INDIRECT = TAUC.replace("sqrt(greatest(1240 / x - gap, 0))", "power(greatest(1240 / x - gap, 0), 2)").replace("((1 - y) * (1 - y) / (2 * y) * (1240 / x)) * ((1 - y) * (1 - y) / (2 * y) * (1240 / x)) AS t", "sqrt((1 - y) * (1 - y) / (2 * y) * (1240 / x)) AS t")


@query("a01_band_gap_indirect", f"WITH {INDIRECT} SELECT measurement_id, round(-intercept / slope, 4) AS band_gap, round(r2, 4) AS r2, n FROM fitted")
def _(spark, sf):
    """The same for indirect gaps."""
    g = C.band_gap(spectra(spark, sf, "indirect").select(M, "idx", "x", "y"), "indirect")
    return _r(g, "band_gap", "r2", digits=4).select(M, "band_gap", "r2", "n")


@query("a02_curve_sums", f"WITH {TAUC} SELECT measurement_id, count(*) AS n, round(sum(energy), 3) AS energy, round(sum(t), 2) AS t, round(sum(slope * energy + intercept), 2) AS line FROM tauc JOIN fitted USING (measurement_id) GROUP BY measurement_id")
def _(spark, sf):
    """The curves of all spectra, one row of sums each."""
    p = spectra(spark, sf).select(M, "idx", "x", "y")
    return C.band_gap_curve(p, C.band_gap(p)).groupBy(M).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("energy"), 3).alias("energy"), F.round(F.sum("t"), 2).alias("t"), F.round(F.sum("line"), 2).alias("line"))


query("x10_photon_energy", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity - 10 > 0 THEN round(1240.0 / (l_quantity - 10), 9) END AS energy FROM lineitem")(lambda s, d: c.read(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(C.photon_energy(F.col("l_quantity") - 10), 9).alias("energy")))
query("x11_percent_autoscale", SCANS + "SELECT measurement_id, idx, top > 1.5 AS was_percent, round(least(greatest(CASE WHEN top > 1.5 THEN y / 100 ELSE y END, 1e-4), 1.0), 9) AS y FROM (SELECT *, max(y) OVER (PARTITION BY measurement_id) AS top FROM scans)")(lambda s, d: _autoscale(s, d))


def _autoscale(spark, sf):
    return _r(C.as_fraction(c.scans(spark, sf).select(M, "idx", "x", "y")).select(M, "idx", "was_percent", "y"), "y", digits=9)


query("x12_kubelka_munk", "SELECT l_orderkey, l_linenumber, round((1 - (l_tax + 0.1)) * (1 - (l_tax + 0.1)) / (2 * (l_tax + 0.1)), 9) AS f FROM lineitem")(lambda s, d: c.read(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(C.kubelka_munk(F.col("l_tax") + 0.1), 9).alias("f")))
query("x13_tauc_values", "SELECT l_orderkey, l_linenumber, round(power(l_tax * l_quantity, 2), 6) AS direct, round(sqrt(l_tax * l_quantity), 6) AS indirect FROM lineitem")(
    lambda s, d: c.read(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(C.tauc_value(F.col("l_tax"), F.col("l_quantity")), 6).alias("direct"), F.round(C.tauc_value(F.col("l_tax"), F.col("l_quantity"), "indirect"), 6).alias("indirect"))
)


@query("x14_profile_width", "WITH s AS (SELECT DISTINCT p_size / 100.0::DOUBLE AS sigma, p_partkey % 5 / 4.0::DOUBLE AS share FROM part), g AS (SELECT sigma, share, -5 * sigma + t.i * 10 * sigma / 5000 AS x FROM s, unnest(range(0, 5001)) AS t(i)), v AS (SELECT *, (1 - share) / (sigma * sqrt(2 * pi())) * exp(-x * x / (2 * sigma * sigma)) + share / pi() * sigma / (x * x + sigma * sigma) AS v, (1 - share) / (sigma * sqrt(2 * pi())) + share / (pi() * sigma) AS top FROM g) SELECT sigma, share, round(max(x) FILTER (v >= top / 2) - min(x) FILTER (v >= top / 2), 2) AS fwhm FROM v GROUP BY sigma, share")
def _(spark, sf):
    s, h = F.col("sigma"), F.col("share")
    q = c.read(spark, sf, "part").select((F.col("p_size") / 100.0).alias("sigma"), (F.col("p_partkey") % 5 / 4.0).alias("share")).distinct()
    value = lambda x: (1 - h) / (s * math.sqrt(2 * math.pi)) * F.exp(-x * x / (2 * s * s)) + h / math.pi * s / (x * x + s * s)
    top = (1 - h) / (s * math.sqrt(2 * math.pi)) + h / (math.pi * s)
    grid = F.transform(F.sequence(F.lit(0), F.lit(5000)), lambda i: -5 * s + i * 10 * s / 5000)
    above = F.filter(grid, lambda x: value(x) >= top / 2)
    return q.select("sigma", "share", F.round(F.array_max(above) - F.array_min(above), 2).alias("fwhm"))


query("g12_line_fit", SCANS + "SELECT measurement_id, round(regr_slope(y, idx), 7) AS slope, round(regr_intercept(y, idx), 6) AS intercept, round(regr_r2(y, idx), 7) AS r2, count(*) AS n FROM scans GROUP BY measurement_id")(
    lambda s, d: _r(_r(C.line_fit(c.scans(s, d).withColumn("i", F.col("idx").cast("double")), "i", "y"), "slope", "r2", digits=7), "intercept").select(M, "slope", "intercept", "r2", "n")
)
query("g14_window_extent", f"WITH {TAUC} SELECT measurement_id, n, round(low, 6) AS low, round(high, 6) AS high FROM fitted")(lambda s, d: _r(C.band_gap(spectra(s, d).select(M, "idx", "x", "y")), "low", "high").select(M, "n", "low", "high"))
query("g11_noise", CURVES + ", d AS (SELECT measurement_id, y - lag(y) OVER (PARTITION BY measurement_id ORDER BY idx) AS dd FROM curves) SELECT measurement_id, round(mad(dd) * 1.4826 / sqrt(2), 6) AS sigma FROM d WHERE dd IS NOT NULL GROUP BY measurement_id")(lambda s, d: _r(C.noise_sigma(c.curves(s, d)), "sigma"))
query("g13_fit_quality", SCANS + ", f AS (SELECT measurement_id, regr_slope(y, idx) AS b, regr_intercept(y, idx) AS a FROM scans GROUP BY measurement_id) SELECT measurement_id, round(1 - sum(power(y - a - b * idx, 2)) / (var_pop(y) * count(*)), 6) AS r2, round(sum(power(y - a - b * idx, 2)) / greatest(1, count(*) - 4), 4) AS chi2 FROM scans JOIN f USING (measurement_id) GROUP BY measurement_id")(
    lambda s, d: _fit_quality(s, d)
)


def _fit_quality(spark, sf):
    p = c.scans(spark, sf).withColumn("i", F.col("idx").cast("double"))
    r = p.join(C.line_fit(p, "i", "y").select(M, "slope", "intercept"), M).withColumn("e", F.col("y") - F.col("intercept") - F.col("slope") * F.col("i"))
    rss, n = F.sum(F.col("e") * F.col("e")), F.count(F.lit(1))
    return r.groupBy(M).agg(F.round(1 - rss / (F.var_pop("y") * n), 6).alias("r2"), F.round(rss / F.greatest(F.lit(1), n - 4), 4).alias("chi2"))


# ---------------------------------------------------------------- windows

query("w02_first_difference", CURVES + "SELECT measurement_id, idx, y - lag(y) OVER (PARTITION BY measurement_id ORDER BY idx) AS dy FROM curves")(lambda s, d: c.curves(s, d).select(M, "idx", (F.col("y") - F.lag("y").over(Window.partitionBy(M).orderBy("idx"))).alias("dy")))
query("w04_smoothing", CURVES + ", s AS (SELECT measurement_id, idx, (-2 * lag(y, 3) OVER w + 3 * lag(y, 2) OVER w + 6 * lag(y, 1) OVER w + 7 * y + 6 * lead(y, 1) OVER w + 3 * lead(y, 2) OVER w - 2 * lead(y, 3) OVER w) / 21 AS s FROM curves WINDOW w AS (PARTITION BY measurement_id ORDER BY idx)) SELECT measurement_id, idx, round(s, 6) AS s FROM s WHERE s IS NOT NULL")(lambda s, d: _r(C.smoothed(c.curves(s, d)), "s"))
MAXIMA = CURVES + ", k AS (SELECT *, lag(y) OVER w AS a, lead(y) OVER w AS b FROM curves WINDOW w AS (PARTITION BY measurement_id ORDER BY idx)), pk AS (SELECT measurement_id, idx, y AS height, abs(y) * 3 AS width FROM k WHERE y > a AND y > b)"


def _maxima(spark, sf):
    return C.local_maxima(c.curves(spark, sf)).select(M, "idx", F.col("y").alias("height"), (F.abs("y") * 3).alias("width"))


GROUPS = MAXIMA + ", r AS (SELECT *, max(idx + 4 * width) OVER (PARTITION BY measurement_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM pk) SELECT measurement_id, idx, CAST(sum(CASE WHEN reach IS NULL OR idx - 4 * width > reach THEN 1 ELSE 0 END) OVER (PARTITION BY measurement_id ORDER BY idx) - 1 AS INTEGER) AS cluster FROM r"
query("w05_overlap_groups", GROUPS)(lambda s, d: C.overlap_groups(_maxima(s, d)).select(M, "idx", "cluster"))
query("a08_peak_groups", GROUPS.replace("SELECT measurement_id, idx, CAST", "SELECT measurement_id, max(cluster) + 1 AS clusters, count(*) AS peaks FROM (SELECT measurement_id, CAST") + ") GROUP BY measurement_id")(
    lambda s, d: C.overlap_groups(_maxima(s, d)).groupBy(M).agg((F.max("cluster") + 1).alias("clusters"), F.count(F.lit(1)).alias("peaks"))
)
query("j12_interval_overlaps", MAXIMA + " SELECT a.measurement_id, a.idx AS idx, count(b.idx) AS touching FROM pk a JOIN pk b ON a.measurement_id = b.measurement_id AND b.idx - 4 * b.width <= a.idx + 4 * a.width AND b.idx + 4 * b.width >= a.idx - 4 * a.width GROUP BY a.measurement_id, a.idx")(lambda s, d: _touching(s, d))


def _touching(spark, sf):
    p = _maxima(spark, sf).select(M, "idx", (F.col("idx") - 4 * F.col("width")).alias("lo"), (F.col("idx") + 4 * F.col("width")).alias("hi"))
    q = p.select(M, F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    return p.join(q, M).where("lo2 <= hi and hi2 >= lo").groupBy(M, "idx").agg(F.count(F.lit(1)).alias("touching"))


query("w07_local_maxima", MAXIMA + " SELECT measurement_id, idx, height FROM pk")(lambda s, d: _maxima(s, d).select(M, "idx", "height"))
# where higher ground begins on both sides, the lowest points before it, and the crossings at half the prominence
PROMINENT = CURVES + """, k AS (SELECT *, lag(y) OVER w AS a, lead(y) OVER w AS b FROM curves WINDOW w AS (PARTITION BY measurement_id ORDER BY idx)),
  pk AS (SELECT measurement_id, idx, y AS height FROM k WHERE y > a AND y > b),
  reach AS (SELECT p.measurement_id, p.idx, p.height, coalesce(max(c.idx) FILTER (c.idx < p.idx AND c.y > p.height) + 1, 0) AS lo, coalesce(min(c.idx) FILTER (c.idx > p.idx AND c.y > p.height) - 1, max(c.idx)) AS hi
    FROM pk p JOIN curves c ON c.measurement_id = p.measurement_id GROUP BY p.measurement_id, p.idx, p.height),
  low AS (SELECT r.measurement_id, r.idx, height, lo, hi, height - greatest(min(c.y) FILTER (c.idx <= r.idx), min(c.y) FILTER (c.idx >= r.idx)) AS prominence
    FROM reach r JOIN curves c ON c.measurement_id = r.measurement_id AND c.idx BETWEEN lo AND hi GROUP BY r.measurement_id, r.idx, height, lo, hi),
  cut AS (SELECT l.*, height - prominence / 2 AS level, max(c.idx) FILTER (c.idx < l.idx AND c.y <= height - prominence / 2) AS p, min(c.idx) FILTER (c.idx > l.idx AND c.y <= height - prominence / 2) AS q
    FROM low l JOIN curves c ON c.measurement_id = l.measurement_id AND c.idx BETWEEN lo AND hi GROUP BY ALL),
  peaks AS (SELECT t.measurement_id, t.idx, height, prominence, (q - (level - d.y) / (e.y - d.y)) - (p + (level - a.y) / (b.y - a.y)) AS width FROM cut t
    JOIN curves a ON a.measurement_id = t.measurement_id AND a.idx = p JOIN curves b ON b.measurement_id = t.measurement_id AND b.idx = p + 1
    JOIN curves d ON d.measurement_id = t.measurement_id AND d.idx = q JOIN curves e ON e.measurement_id = t.measurement_id AND e.idx = q - 1)"""
LEAST_PROMINENCE, LEAST_POINTS_WIDE, MOST_SHOWN = 0.05, 1.0, 5


@query("w07_prominent_peaks", PROMINENT + f" SELECT measurement_id, idx, height, round(prominence, 9) AS prominence, round(width, 6) AS width FROM peaks WHERE prominence >= {LEAST_PROMINENCE} AND width >= {LEAST_POINTS_WIDE}")
def _(spark, sf):
    """Peaks of noisy curves with prominence and width."""
    found = P.scan_peaks(c.curves(spark, sf), LEAST_PROMINENCE, 1, LEAST_POINTS_WIDE)
    return found.select(M, "idx", "height", F.round("prominence", 9).alias("prominence"), F.round("width", 6).alias("width"))


@query("o02_capped_scans", PROMINENT + f""" SELECT measurement_id, list(idx ORDER BY idx) AS positions, max(CASE WHEN n > {MOST_SHOWN} THEN n || ' peaks, of which the {MOST_SHOWN} highest are kept' END) AS warning
  FROM (SELECT *, count(*) OVER (PARTITION BY measurement_id) AS n, row_number() OVER (PARTITION BY measurement_id ORDER BY height DESC, idx) AS r FROM peaks WHERE prominence >= {LEAST_PROMINENCE} AND width >= {LEAST_POINTS_WIDE}) WHERE r <= {MOST_SHOWN} GROUP BY measurement_id""")
def _(spark, sf):
    """The highest peaks of each curve, and a warning where there are more."""
    from ..sources.durable import written

    found = written(P.scan_peaks(c.curves(spark, sf), LEAST_PROMINENCE, 1, LEAST_POINTS_WIDE, MOST_SHOWN), "peaks")
    warned = P.capped(found, {"most": MOST_SHOWN}).select(M, F.col("message").alias("warning"))
    return found.groupBy(M).agg(F.array_sort(F.collect_list("idx")).alias("positions")).join(warned, M, "left")


query("w08_group_max_share", CURVES + "SELECT measurement_id, idx, round(y / max(y) OVER (PARTITION BY measurement_id), 9) AS share FROM curves")(lambda s, d: c.curves(s, d).select(M, "idx", F.round(F.col("y") / F.max("y").over(Window.partitionBy(M)), 9).alias("share")))
query("o01_sorted_scan", CURVES + "SELECT measurement_id, CAST(row_number() OVER (PARTITION BY measurement_id ORDER BY y, idx) - 1 AS INTEGER) AS idx, y AS x FROM curves")(lambda s, d: C.by_x(c.curves(s, d).select(M, "idx", F.col("y").alias("x"), "y")).select(M, "idx", "x"))
query("o02_top_peaks", MAXIMA + " SELECT measurement_id, idx, height FROM (SELECT *, row_number() OVER (PARTITION BY measurement_id ORDER BY height DESC, idx) AS r FROM pk) WHERE r <= 5")(lambda s, d: C.top_peaks(_maxima(s, d), 5).select(M, "idx", "height"))
query("o03_peaks_in_order", MAXIMA + " SELECT measurement_id, list(idx ORDER BY idx) AS positions FROM pk GROUP BY measurement_id")(lambda s, d: _maxima(s, d).groupBy(M).agg(F.array_sort(F.collect_list("idx")).alias("positions")))

# ---------------------------------------------------------------- diffraction

query("a03_scan_guard", f"WITH {DIFFRACTION}, s AS (SELECT measurement_id, x - lag(x) OVER (PARTITION BY measurement_id ORDER BY x) AS dx FROM diffraction) SELECT measurement_id, count(*) AS n, round(median(dx), 6) AS step, 'ok' AS state FROM s GROUP BY measurement_id")(lambda s, d: _r(C.scan_guard(diffraction(s, d)), "step"))


BASELINE = "WITH RECURSIVE b AS (SELECT vec_id AS measurement_id, 0 AS w, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS a FROM embeddings UNION ALL SELECT measurement_id, w + 1, list_transform(range(1, 65), lambda i: CASE WHEN i - 1 >= w + 1 AND i + w + 1 <= 64 THEN least(a[i], (a[i - w - 1] + a[i + w + 1]) / 2) ELSE a[i] END) FROM b WHERE w < 6) SELECT measurement_id, CAST(t.i AS INTEGER) AS idx, round(a[t.i + 1], 9) AS baseline FROM b, unnest(range(0, 64)) AS t(i) WHERE w = 6"


@query("a04_baseline", BASELINE)
def _(spark, sf):
    return _r(C.baselines(c.curves(spark, sf), 6), "baseline", digits=9).select(M, "idx", "baseline")


@query("a04_baseline_native", BASELINE)
def _(spark, sf):
    """The executable specification: higher-order functions alone."""
    a = c.read(spark, sf, "embeddings").select(F.col("vec_id").alias(M), C.snip_arrays(F.transform("embedding", lambda v: v.cast("double")), 6).alias("b"))
    return a.select(M, F.posexplode("b").alias("idx", "baseline")).withColumn("baseline", F.round("baseline", 9))


query("a05_noise_sigma", f"WITH {DIFFRACTION}, d AS (SELECT measurement_id, y - lag(y) OVER (PARTITION BY measurement_id ORDER BY idx) AS dd FROM diffraction) SELECT measurement_id, round(mad(dd) * 1.4826 / sqrt(2), 4) AS sigma FROM d WHERE dd IS NOT NULL GROUP BY measurement_id")(lambda s, d: _r(C.noise_sigma(diffraction(s, d)), "sigma", digits=4))
query("a06_prominence_threshold", f"WITH {DIFFRACTION}, d AS (SELECT measurement_id, y, y - lag(y) OVER (PARTITION BY measurement_id ORDER BY idx) AS dd FROM diffraction) SELECT measurement_id, round(greatest(3 * mad(dd) * 1.4826 / sqrt(2), 0.01 * max(y)), 4) AS threshold FROM d GROUP BY measurement_id")(lambda s, d: _r(C.prominence_threshold(diffraction(s, d)), "threshold", digits=4).select(M, "threshold"))
#: Where the four peaks of a scan are, by its label.
CENTERS = ("15.0", "28.5 + 0.1 * label", "47.3 + 0.2 * label", "63.8 + 0.3 * label")
TRUTH = "SELECT vec_id AS measurement_id, " + ", ".join(f"round(CAST({x} AS DOUBLE), 1) AS c{k}" for k, x in enumerate(CENTERS)) + " FROM embeddings"


@query("a07_peaks_found", "SELECT vec_id AS measurement_id, CAST(4 AS BIGINT) AS peaks, CAST(4 AS BIGINT) AS clusters, CAST(0 AS BIGINT) AS astray FROM embeddings")
def _(spark, sf):
    """Detected peaks of each scan, and how many are over 0.15 degrees from all that the carrier put in."""
    found = P.detect_peaks(diffraction(spark, sf)).join(c.read(spark, sf, "embeddings").select(F.col("vec_id").alias(M), "label"), M)
    off = F.array_min(F.transform(F.array(*[F.expr(f"CAST({x} AS DOUBLE)") for x in CENTERS]), lambda t: F.abs(t - F.col("x"))))
    return found.groupBy(M).agg(F.count(F.lit(1)).alias("peaks"), F.countDistinct("cluster").alias("clusters"), F.count_if(off > 0.15).alias("astray"))


@query("a10_peak_centers", TRUTH.replace("SELECT vec_id AS measurement_id", "SELECT vec_id AS measurement_id, CAST(4 AS INTEGER) AS n_peaks, 'ok' AS state"))
def _(spark, sf):
    """Fitted centers to a tenth of a degree."""
    t = P.peak_table(diffraction(spark, sf))
    return t.select(M, "n_peaks", "state", *[F.round(F.try_element_at("peaks", F.lit(k + 1))["center"], 1).alias(f"c{k}") for k in range(4)])


query("a07_detect_peaks")(lambda s, d: P.detect_peaks(diffraction(s, d)).select(M, "idx", F.round("x", 4).alias("x"), F.round("height", 3).alias("height"), "cluster"))


@query("a09_fit_peak_clusters")
def _(spark, sf):
    return _r(P.scan_fits(diffraction(spark, sf)), "center", "height", "fwhm", "area", "fraction", digits=3).drop("sigma", "x0", "x1")


query("a10_peak_table")(lambda s, d: _r(P.peak_table(diffraction(s, d)).drop("state"), "r2", "reduced_chi2", "sigma", digits=4).withColumn("peaks", F.to_json(F.transform("peaks", lambda p: F.round(p["center"], 2)))))


@query("a09_cluster_centers", f"SELECT measurement_id, CAST(k AS INTEGER) AS cluster, ([c0, c1, c2, c3])[k + 1] AS center, CAST(NULL AS VARCHAR) AS issue FROM ({TRUTH}), unnest(range(0, 4)) AS t(k)")
def _(spark, sf):
    """Fits cluster by cluster, centers to a tenth of a degree."""
    return P.scan_fits(diffraction(spark, sf)).select(M, "cluster", F.round("center", 1).alias("center"), "issue")


@query("a11_fit_follows", "SELECT vec_id AS measurement_id, CAST(701 AS BIGINT) AS n, true AS close FROM embeddings")
def _(spark, sf):
    """Whether the fit stays within the noise of every point of a scan."""
    near = F.abs("residual") < 30  # a tenth of the lowest peak
    return P.fit_curves(diffraction(spark, sf)).groupBy(M).agg(F.count(F.lit(1)).alias("n"), F.bool_and(near).alias("close"))


@query("a11_fit_curve")
def _(spark, sf):
    return _r(P.fit_curves(diffraction(spark, sf)), "fit", "residual", "baseline", digits=3).select(M, "idx", "fit", "baseline", "residual")


@query("f08_physical_peaks", "SELECT vec_id AS measurement_id, CAST(4 AS BIGINT) AS peaks FROM embeddings")
def _(spark, sf):
    return P.physical(P.scan_fits(diffraction(spark, sf))).groupBy(M).agg(F.count(F.lit(1)).alias("peaks"))


@query("f08_unphysical_left_out", f"SELECT measurement_id, CAST((c0 BETWEEN 10 AND 40) AS BIGINT) * CAST(measurement_id % 3 <> 0 AS BIGINT) + CAST((c1 BETWEEN 10 AND 40 + measurement_id % 20) AS BIGINT) + CAST(measurement_id % 5 <> 0 AND c2 BETWEEN 10 AND 40 + measurement_id % 20 AS BIGINT) AS peaks FROM ({TRUTH})")
def _(spark, sf):
    """Peaks at the truth of each scan, of which some have no height, some no width, and some lie beyond the end of a shorter scan."""
    e = c.read(spark, sf, "embeddings").select(F.col("vec_id").alias(M), "label")
    peak = lambda k, height, fwhm: F.struct(F.round(F.expr(f"CAST({CENTERS[k]} AS DOUBLE)"), 1).alias("center"), height.cast("double").alias("height"), fwhm.cast("double").alias("fwhm"))
    one = F.lit(1)
    each = F.array(peak(0, F.when(F.col(M) % 3 == 0, 0).otherwise(one), one), peak(1, one, one), peak(2, one, F.when(F.col(M) % 5 == 0, 0).otherwise(one)))
    fits = e.select(M, F.explode(each).alias("p")).select(M, "p.*", F.lit(None).cast("string").alias("issue"))
    ends = e.select(M, F.explode(F.array(F.lit(10.0), (40 + F.col(M) % 20).cast("double"))).alias("x"))
    left = P.physical(fits, ends).groupBy(M).agg(F.count(F.lit(1)).alias("peaks"))
    return e.select(M).join(left, M, "left").select(M, F.coalesce("peaks", F.lit(0)).cast("long").alias("peaks"))


@query("a12_run_analysis", f"WITH {TAUC} SELECT measurement_id, measurement_id % 2 = 0 AS reused, CASE WHEN measurement_id % 2 = 0 THEN 0.0 ELSE round(-intercept / slope, 5) END AS band_gap FROM fitted")
def _(spark, sf):
    """Band gaps of all spectra, every other one answered by a stored result."""
    from ..operators import catalog, service

    a = service.default_registry().by_name["band-gap"]
    m = c.read(spark, sf, "embeddings").select(F.col("vec_id").alias(M), F.lit("uv_drs").alias("technique"))
    entries = F.create_map(*[F.lit(str(x)) for kv in sorted(a.defaults.items()) for x in kv])
    stored = m.where(f"{M} % 2 = 0").select(M, F.lit(a.name).alias("analyzer_name"), catalog.params_fingerprint(entries).alias("params_fp"), F.lit(a.version).alias("analyzer_version"), F.lit('{"band_gap":0.0}').alias("outputs"), F.array().cast("array<string>").alias("issues"))
    out = service.run_analysis(m, spectra(spark, sf).select(M, "idx", "x", "y"), stored, a)
    gap = F.get_json_object("outputs", "$.band_gap").cast("double")
    return out.select(M, (gap == 0).alias("reused"), F.round(gap, 5).alias("band_gap"))


@query("a12_stored_curves", f"WITH {TAUC}, s AS (SELECT measurement_id, count(*) AS n, sum(energy) AS energy, sum(slope * energy + intercept) AS line FROM tauc JOIN fitted USING (measurement_id) GROUP BY measurement_id) SELECT measurement_id, 'energy' AS name, n, round(energy, 3) AS total FROM s UNION ALL SELECT measurement_id, 'line', n, round(line, 2) FROM s")
def _(spark, sf):
    """Derived curves that a run stored, found again by the ids of its results."""
    out, stored = _stored_run(spark, sf, "band-gap", "uv_drs", spectra(spark, sf))
    sums = stored.join(out.select("result_id"), "result_id", "left_semi").groupBy(M, "name").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v"))
    return sums.where("name in ('energy', 'line')").select(M, "name", "n", F.when(F.col("name") == "energy", F.round("v", 3)).otherwise(F.round("v", 2)).alias("total"))


@query("a12_stored_fits", f"WITH {DIFFRACTION} SELECT measurement_id, count(*) AS n, CAST(4 AS BIGINT) AS n_peaks, true AS adds_up, round(sum(y), 2) AS observed FROM diffraction GROUP BY measurement_id")
def _(spark, sf):
    """Peak tables and fitted curves of one pass: the stored curve is its scan's, and fit and residual add up to it."""
    out, stored = _stored_run(spark, sf, "peak-table", "xrd", diffraction(spark, sf))
    total = lambda name: F.sum(F.when(F.col("name") == name, F.col("value")))
    sums = stored.groupBy(M).agg(F.count_if(F.col("name") == "observed").alias("n"), (F.abs(total("observed") - total("fit") - total("residual")) < 1e-6).alias("adds_up"), F.round(total("observed"), 2).alias("observed"))
    return out.join(sums, M).select(M, "n", F.get_json_object("outputs", "$.n_peaks").cast("long").alias("n_peaks"), "adds_up", "observed")


def _stored_run(spark, sf, name, technique, points):
    from ..operators import service

    path = f"{shared_root(spark)}/derived-{uuid.uuid4().hex}"
    m = c.read(spark, sf, "embeddings").select(F.col("vec_id").alias(M), F.lit(technique).alias("technique"))
    none = spark.createDataFrame([], f"{M} long, analyzer_name string, params_fp string, analyzer_version string, outputs string, issues array<string>, result_id string")
    out = service.run_analysis(m, points.select(M, "idx", "x", "y"), none, service.default_registry().by_name[name], derived=path)
    return out, spark.read.parquet(path)


@query("a12_complete_outcome", f"WITH {TAUC} SELECT e.vec_id AS measurement_id, CASE WHEN e.vec_id % 3 = 0 THEN 'no arrays' ELSE '' END AS issue, CASE WHEN e.vec_id % 3 <> 0 THEN round(-intercept / slope, 5) END AS band_gap FROM embeddings e JOIN fitted f ON f.measurement_id = e.vec_id")
def _(spark, sf):
    """A row for every measurement asked for, with points or without."""
    from ..operators import service

    m = c.read(spark, sf, "embeddings").select(F.col("vec_id").alias(M), F.lit("uv_drs").alias("technique"))
    none = spark.createDataFrame([], f"{M} long, analyzer_name string, params_fp string, analyzer_version string, outputs string, issues array<string>")
    out = service.run_analysis(m, spectra(spark, sf).select(M, "idx", "x", "y").where(f"{M} % 3 <> 0"), none, service.default_registry().by_name["band-gap"])
    issue = F.when(F.array_contains("issues", service.NO_ARRAYS), service.NO_ARRAYS).otherwise("").alias("issue")
    return out.select(M, issue, F.round(F.get_json_object("outputs", "$.band_gap").cast("double"), 5).alias("band_gap"))


@query("a12_bucketed_rerun", f"WITH {TAUC} SELECT measurement_id, measurement_id % 3 <> 1 AS reused, round(-intercept / slope, 5) AS band_gap FROM fitted")
def _(spark, sf):
    """Band gaps from points and results stored in buckets: a first run over two thirds of the spectra is stored, a second one over all reuses it."""
    from ..operators import service
    from ..sources import buckets

    path = f"{shared_root(spark)}/buckets-{uuid.uuid4().hex}"
    m = c.read(spark, sf, "embeddings").select(F.col("vec_id").alias(M), F.lit("uv_drs").alias("technique"))
    points = buckets.append_buckets(spectra(spark, sf).select(M, "idx", "x", "y"), f"{path}/points", buckets=8)
    none = spark.createDataFrame([], f"{M} long, analyzer_name string, params_fp string, analyzer_version string, outputs string, issues array<string>, result_id string")
    a = service.default_registry().by_name["band-gap"]
    stored = buckets.append_buckets(service.run_analysis(m.where(f"{M} % 3 <> 1"), points, none, a), f"{path}/results", buckets=8)
    out = service.run_analysis(m, points, stored, a)
    old = stored.select("result_id").withColumn("reused", F.lit(True))
    gap = F.round(F.get_json_object("outputs", "$.band_gap").cast("double"), 5).alias("band_gap")
    return out.join(old, "result_id", "left").select(M, F.coalesce("reused", F.lit(False)).alias("reused"), gap)
