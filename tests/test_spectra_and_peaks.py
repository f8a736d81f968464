"""Spectrum files by an XML parser, and peaks with prominence and width against a plain search."""

import time

import numpy as np
from pyspark.sql import functions as F

from meterlake.operators import ingest, parsing, peaks
from meterlake.sources import files

M = "measurement_id"
DECLARED = '<?xml version="1.0" encoding="%s"?>'
NESTED = '<a:TRTSpectrum xmlns:a="urn.x"><!-- <CalibAbs>9</CalibAbs> --><Note><![CDATA[<CalibAbs>8</CalibAbs>]]></Note><ClassInstance Name="Größe €1"><b><CalibAbs/><CalibAbs> -0.5 </CalibAbs><CalibLin>0.25</CalibLin></b><Channels>1, 2,\n3,</Channels></ClassInstance></a:TRTSpectrum>'


def fields(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "file_id int, text string")
    return {r["file_id"]: r for r in files.spectrum_fields(df).collect()}


def test_comments_nesting_and_namespaces_are_what_they_are(spark):
    got = fields(spark, NESTED, "<TRTSpectrum><CalibAbs>x</CalibAbs><Channels> </Channels></TRTSpectrum>", "<TRTSpectrum><open>", "", None)
    assert (got[0]["broken"], got[0]["spectrum_name"], got[0]["calib_abs"], got[0]["calib_lin"], got[0]["channels"]) == (None, "Größe €1", -0.5, 0.25, "1, 2,\n3,")
    assert (got[1]["broken"], got[1]["calib_abs"], got[1]["channels"]) == (None, None, None)
    assert all(got[k]["broken"] and got[k]["channels"] is None for k in (2, 3, 4))


def test_the_declared_encoding_decides(spark):
    rows = [(DECLARED % "WINDOWS-1252" + "é€µ").encode("cp1252"), (DECLARED % "utf-8" + "é€µ").encode(), "é€µ".encode(), b"a\xffb", b"", None, b'<?xml version="1.0" encoding="windows-1252"?>\x81']
    df = spark.createDataFrame([(i, bytearray(r) if r is not None else None) for i, r in enumerate(rows)], "i int, content binary")
    got = {r["i"]: r["t"] for r in df.select("i", files.declared_text(F.col("content")).alias("t")).collect()}
    assert got[0].endswith("é€µ") and got[1].endswith("é€µ") and got[2] == "é€µ" and got[3] == "a\ufffdb" and got[4] == "" and got[5] is None and got[6].endswith(">\ufffd")


def test_spectra_are_ingested_with_their_findings(spark):
    texts = {
        "good": DECLARED % "WINDOWS-1252" + NESTED.replace("xmlns:a", "xmlns").replace("a:", "").replace("</ClassInstance>", "<Date>05.03.21</Date><Time>9:1:2</Time></ClassInstance>"), "bare": "<TRTSpectrum><Channels>4,5</Channels></TRTSpectrum>",
        "undated": "<TRTSpectrum><Date>soon</Date><Time>1:2:3</Time><CalibAbs>0</CalibAbs><CalibLin>1</CalibLin><Channels>7</Channels></TRTSpectrum>",
        "bad": "<TRTSpectrum><Channels>1,x</Channels></TRTSpectrum>", "torn": "<TRTSpectrum><Channels>1,2</Channels>", "void": "<TRTSpectrum><Channels>,,</Channels></TRTSpectrum>",
    }
    df = spark.createDataFrame([(f"{k}.spx", f"{k}.spx", bytearray(t.encode("cp1252"))) for k, t in texts.items()], "path string, rel_path string, content binary")
    got = ingest.ingest(df)
    m = {r["path"][:-4]: r for r in got.measurements.collect()}
    ids = {r[M]: k for k, r in m.items()}
    points: dict = {}
    for r in got.points.collect():
        points.setdefault(ids[r[M]], []).append((r["idx"], r["x"], r["y"]))
    assert {k: sorted(v) for k, v in points.items()} == {"good": [(0, -0.5, 1.0), (1, -0.25, 2.0), (2, 0.0, 3.0)], "bare": [(0, 0.0, 4.0), (1, 1.0, 5.0)], "undated": [(0, 0.0, 7.0)]}
    assert m["good"]["metadata"]["spectrum_name"] == "Größe €1" and str(m["good"]["measured_at"]) == "2021-03-05 09:01:02" and m["undated"]["measured_at"] is None
    assert sorted((ids[r[M]], r["field"], r["severity"]) for r in got.issues.collect()) == [
        ("bad", "data", "error"), ("bare", "x", "warning"), ("good", "measured_at", "warning"), ("torn", "xml", "error"), ("undated", "measured_at", "warning"), ("void", "data", "error"),
    ]
    assert {r["path"][:-4] for r in got.outcomes.where("outcome = 'parsed_with_issues'").collect()} == {"bad", "torn", "void"}


def test_local_dates_of_four_forms(spark):
    df = spark.createDataFrame([("2.12.2022",), ("02.12.22",), ("2022-12-2",), ("12/2/2022",), ("2022",), (None,)], "d string")
    got = [r[0] for r in df.select(parsing.local_timestamp(F.col("d"), F.lit("8:0:4")).cast("string")).collect()]
    assert got == ["2022-12-02 08:00:04"] * 4 + [None, None]


# ---------------------------------------------------------------- peaks


def plain_peaks(s, threshold, distance, least_width):
    """By definition, point by point."""
    n, tops = len(s), []
    i = 1
    while i < n - 1:
        j = i
        while j + 1 < n and s[j + 1] == s[i]:
            j += 1
        if s[i - 1] < s[i] and j + 1 < n and s[j + 1] < s[i]:
            tops.append((i + j) // 2)
        i = j + 1
    left = set(tops)
    for k in sorted(tops, key=lambda k: (s[k], k), reverse=True):
        if k in left:
            left -= {o for o in left if o != k and abs(o - k) < distance}
    out = []
    for i in sorted(left):
        a = b = i
        lo = hi = i
        while a > 0 and s[a - 1] <= s[i]:
            a -= 1
            lo = a if s[a] < s[lo] else lo
        while b < n - 1 and s[b + 1] <= s[i]:
            b += 1
            hi = b if s[b] < s[hi] else hi
        p = s[i] - max(s[lo], s[hi])
        level, x, y = s[i] - p / 2, i, i
        while x > lo and s[x] > level:
            x -= 1
        while y < hi and s[y] > level:
            y += 1
        xs = x + (level - s[x]) / (s[x + 1] - s[x]) if s[x] < level else x
        ys = y - (level - s[y]) / (s[y - 1] - s[y]) if s[y] < level else y
        if p >= threshold and ys - xs >= least_width:
            out.append((i, p, ys - xs))
    return out


def test_peaks_equal_the_plain_search():
    rng = np.random.default_rng(5)
    for k in range(300):
        n = int(rng.integers(3, 120))
        s = rng.normal(size=n) if k % 3 == 0 else rng.integers(0, 6, n).astype(float) if k % 3 == 1 else np.cumsum(rng.integers(-2, 3, n)).astype(float)
        args = (float(rng.choice([0.0, 0.5, 2.0])), int(rng.integers(1, 9)), float(rng.choice([0.0, 1.0, 2.5])))
        assert np.allclose(np.array(peaks.find_peaks(s, *args)).reshape(-1, 3), np.array(plain_peaks(s.tolist(), *args)).reshape(-1, 3)), (k, args)


def test_noisy_scans_take_linear_time():
    rng = np.random.default_rng(6)
    took = []
    for n in (50_000, 200_000):
        s = rng.normal(size=n)
        at = time.perf_counter()
        assert len(peaks.find_peaks(s, 0.0, 5, 0.0)) > n // 20
        took.append(time.perf_counter() - at)
    assert took[1] < 20 and took[1] < 12 * max(took[0], 0.05)


def test_scans_of_any_kind_and_the_cap(spark):
    x = np.arange(200)
    comb = [("comb", int(i), float(i), float(10 + i / 100 if i % 10 == 5 else 0)) for i in x]
    flat, gap = [("flat", i, float(i), 1.0) for i in range(60)], [("gap", i, float(9 - i), float("nan") if i == 2 else float(i in (4, 5))) for i in range(9)]
    points = spark.createDataFrame(comb + flat + gap + [("one", 0, 1.0, 1.0), ("null", 0, None, 1.0)], f"{M} string, idx int, x double, y double")
    found = peaks.scan_peaks(points, 1.0, 1, 0.0, 7)
    rows = found.orderBy(M, "idx").collect()
    assert [(r["idx"], r["n_found"]) for r in rows if r[M] == "comb"] == [(k, 20) for k in range(135, 200, 10)]
    assert [(r["idx"], r["height"], r["prominence"], r["width"]) for r in rows if r[M] == "gap"] == [(3, 1.0, 1.0, 2.0)]
    assert {r[M] for r in rows} == {"comb", "gap"} and peaks.scan_peaks(points.limit(0)).count() == 0
    assert [tuple(r) for r in peaks.capped(found, {"most": 7}).collect()] == [("comb", "peaks", "warning", "20 peaks, of which the 7 highest are kept")]
