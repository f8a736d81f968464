"""The measurement side on small inputs with known answers."""

import json

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from meterlake.functions import names as N
from meterlake.operators import catalog, classify, curves, parsing, peaks, reports, resolve
from meterlake.sources import files

M = "measurement_id"


def col(spark, kind, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


# ---------------------------------------------------------------- names


def test_normal_forms(spark):
    raw = ["CS Pure", "CS (Pure)", "cs_pure", "Sample: MX-1", "sample sample 1", "---", "  ", "", None, "ＭＸ－１", "İ b", "A/B:[c]\\d."]
    got = col(spark, "string", raw, N.normalize_name)
    assert got[:10] == ["cspure", "cspure", "cspure", "mx1", "1", "", "", "", None, "mx1"]
    assert got[11] == "abcd"
    assert col(spark, "string", got, N.normalize_name) == got


def test_normal_form_is_stable_on_any_text(spark):
    seen = set()

    @settings(max_examples=150, deadline=None, database=None)
    @given(st.text(max_size=20))
    def gather(s):
        if "\x00" not in s:
            seen.add("".join(c for c in s if not 0xD800 <= ord(c) < 0xE000))

    gather()
    once = col(spark, "string", sorted(seen), N.normalize_name)
    assert col(spark, "string", once, N.normalize_name) == once


def test_stems_and_segments(spark):
    paths = ["a/b/CS-1_run5.txt", "CS-1.xrdml", "x/MX-001 (1).csv", "x/CS-1_5.txt", "x/.hidden", "p/scan 12"]
    assert col(spark, "string", paths, N.stem) == ["CS-1_run5", "CS-1", "MX-001 (1)", "CS-1_5", ".hidden", "scan 12"]
    assert col(spark, "string", paths, lambda c: N.cleaned_stem(N.stem(c)))[:4] == ["CS-1", "CS-1", "MX-001", "CS-1"]
    assert col(spark, "string", ["a/b/c/f.txt", "f.txt"], N.segments) == [["c", "b", "a"], []]


def test_similarities():
    assert N.similarity_of("cs1", "cs1") == 1 and N.similarity_of("", "a") == 0
    assert N.indel_ratio("cs1", "cs3") == pytest.approx(2 * 2 / 6)
    assert N.jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
    assert N.jaro_winkler("abc", "xyz") == 0

    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            before = 0
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    rng = np.random.default_rng(0)
    for _ in range(300):
        a, b = ("".join(rng.choice(list("abcd"), rng.integers(1, 12))) for _ in "ab")
        assert N.indel_ratio(a, b) == pytest.approx(2 * slow(a, b) / (len(a) + len(b)))


@pytest.mark.parametrize("threshold", [0.7, 0.85, 0.95])
def test_name_edges_lose_no_pair(spark, threshold):
    rng = np.random.default_rng(int(threshold * 100))
    stems = ["".join(rng.choice(list("abcdexyz123"), rng.integers(2, 10))) for _ in range(25)]
    names = sorted({s[:k] + str(rng.choice(list("qrs7"))) + s[k:] for s in stems for k in (0, len(s) // 2, len(s))} | set(stems))
    want = {(a, b) for a in names for b in names if a < b and N.similarity_of(a, b) >= threshold}
    got = {(r["a"], r["b"]) for r in resolve.name_edges(spark.createDataFrame([(n,) for n in names], "name string"), threshold).collect()}
    assert got == want


def test_clusters_merge_and_stay_apart(spark):
    def groups(pairs):
        h = spark.createDataFrame([(f"f{i}", "t", raw, 0.8, i) for i, raw in enumerate(pairs)], "file_path string, source_tag string, raw string, confidence double, seq int")
        return sorted(sorted(r["file_paths"]) for r in resolve.clusters(h).collect())

    assert groups(["CS Pure", "CS (Pure)"]) == [["f0", "f1"]]
    assert groups(["CS-1", "CS-3"]) == [["f0"], ["f1"]]
    assert groups(["CS", "CSCBI"]) == [["f0"], ["f1"]]
    assert groups(["CS", "CS-1", "CS-3"]) == [["f0", "f1", "f2"]]  # by way of CS
    assert groups(["---"]) == [["f0"]]


def test_clusters_do_not_depend_on_partitions(spark):
    rows = [(f"f{i % 17}", "t", f"S-{i % 9}{'x' * (i % 3)}", 0.5, i) for i in range(90)]
    h = spark.createDataFrame(rows, "file_path string, source_tag string, raw string, confidence double, seq int")
    a, b = (sorted(map(str, resolve.clusters(h.repartition(n)).collect())) for n in (1, 7))
    assert a == b


def test_overrides(spark):
    c = spark.createDataFrame([("a", ["a"], ["1", "2"]), ("b", ["b", "bb"], ["3"]), ("d", ["d"], ["4"])], "canonical string, aliases array<string>, file_paths array<string>")
    splits = spark.createDataFrame([("a", "2", "new")], "source string, path string, target string")
    merges = spark.createDataFrame([(0, 0, "b"), (0, 1, "d"), (1, 0, "gone"), (1, 1, "a")], "group_id int, pos int, name string")
    renames = spark.createDataFrame([("a", "alpha")], "auto string, new string")
    got = {r["canonical"]: (r["aliases"], r["file_paths"]) for r in resolve.apply_decisions(c, renames, merges, splits).collect()}
    assert got == {"alpha": (["a", "alpha"], ["1"]), "new": (["new"], ["2"]), "b": (["b", "bb", "d"], ["3", "4"])}
    both = resolve.apply_renames(c, spark.createDataFrame([("a", "d")], "auto string, new string"))
    assert {r["canonical"]: r["file_paths"] for r in both.collect()} == {"b": ["3"], "d": ["1", "2", "4"]}
    edited = resolve.with_rename(renames, spark.createDataFrame([("a", " "), ("b", "beta")], "auto string, new string"))
    assert [tuple(r) for r in edited.collect()] == [("b", "beta")]
    grown = resolve.with_merge(merges, spark.createDataFrame([(0, "a"), (1, "b"), (2, "a")], "pos int, name string"))
    assert sorted((r["group_id"], r["name"]) for r in grown.collect()) == [(2, "a"), (2, "b")]


def test_ties_go_to_the_name_seen_first(spark):
    rows = [("f1", "t", "zeta", 0.5, 1), ("f1", "t", "alpha", 0.5, 2), ("f2", "t", "Beta", 0.5, 3), ("f2", "t", "alpha", 0.5, 4), ("f2", "t", "alphaa", 0.1, 0)]
    h = spark.createDataFrame(rows, "file_path string, source_tag string, raw string, confidence double, seq int")
    got = {r["canonical"]: r["file_paths"] for r in resolve.clusters(h.where("seq > 0")).collect()}
    assert got == {"zeta": ["f1"], "alpha": ["f2"]}  # alpha is seen before Beta, in another file
    # a component is seen when any of its names is
    assert {r["canonical"]: r["file_paths"] for r in resolve.clusters(h, 0.9).collect()} == {"alpha": ["f1", "f2"]}
    swapped = h.where("seq > 0").withColumn("seq", -F.col("seq"))
    assert {r["canonical"]: r["file_paths"] for r in resolve.clusters(swapped).collect()} == {"alpha": ["f1", "f2"]}


@pytest.mark.parametrize("threshold", [0.0, 0.7, 0.85, 1.0])
def test_few_names_by_either_plan(spark, threshold):
    rng = np.random.default_rng(8)
    names = sorted({"".join(rng.choice(list("abcs123"), rng.integers(1, 7))) for _ in range(60)})
    nodes = spark.createDataFrame([(n,) for n in names], "node string")
    large = resolve.components(nodes, resolve.name_edges(nodes.withColumnRenamed("node", "name"), threshold))
    assert sorted(map(tuple, resolve.few_components(nodes, threshold).collect())) == sorted(map(tuple, large.collect()))
    assert resolve.few_components(nodes.limit(0), threshold).count() == 0


def test_edits_and_warnings(spark):
    c = spark.createDataFrame([("a", ["a"], ["1", "2"]), ("b", ["b", "bb"], ["3"]), ("d", ["d"], ["4"]), ("bb", ["bb"], ["5"])], "canonical string, aliases array<string>, file_paths array<string>")
    none = lambda s: spark.createDataFrame([], s)
    merges, splits = "group_id int, pos int, name string", "source string, path string, target string"
    warned = resolve.decision_warnings(c, spark.createDataFrame([("a", "d")], "auto string, new string"), none(merges), none(splits)).collect()
    assert [(r["canonical"], r["severity"], r["message"]) for r in warned] == [("d", "warning", "a rename unites a, d")]
    m = spark.createDataFrame([(0, 0, "bb"), (0, 1, "gone"), (1, 0, "x"), (1, 1, "a"), (1, 2, "d")], merges)
    meant = resolve.decision_warnings(c, none("auto string, new string"), m, none(splits))
    assert meant.count() == 0
    m = spark.createDataFrame([(0, 0, "bb"), (0, 1, "b"), (0, 2, "a")], merges)
    assert resolve.decision_warnings(c, none("auto string, new string"), m, none(splits)).count() == 0
    m = spark.createDataFrame([(0, 0, "bb"), (0, 1, "b"), (0, 2, "a")], merges).where("name <> 'bb'").unionByName(spark.createDataFrame([(0, -1, "bb ")], merges))
    assert resolve.decision_warnings(c, spark.createDataFrame([("d", "a")], "auto string, new string"), m, none(splits)).count() == 1
    old = spark.createDataFrame([(0, 0, "a"), (0, 1, "b"), (1, 0, "c"), (1, 1, "d")], merges)
    same = resolve.with_merge(old, spark.createDataFrame([(0, "a"), (1, " a "), (2, " ")], "pos int, name string"))
    assert sorted(tuple(r) for r in same.collect()) == sorted(tuple(r) for r in old.collect())
    grown = resolve.with_merge(old, spark.createDataFrame([(0, "e"), (1, "a")], "pos int, name string"))
    assert sorted((r["group_id"], r["name"]) for r in grown.collect()) == [(1, "c"), (1, "d"), (2, "a"), (2, "e")]
    s = spark.createDataFrame([("a", "1", "x"), ("b", "3", "y")], splits)
    edited = resolve.with_split(s, spark.createDataFrame([("a", "2", " z "), ("a", "9", " "), ("b", "3", "")], splits))
    assert sorted(tuple(r) for r in edited.collect()) == [("a", "2", "z")]


def test_decisions_as_json(spark, tmp_path):
    r = spark.createDataFrame([("a", "x")], "auto string, new string")
    m = spark.createDataFrame([(0, 0, "a"), (0, 1, "b")], "group_id int, pos int, name string")
    s = spark.createDataFrame([("a", "p", "t")], "source string, path string, target string")
    catalog.write_decisions(r, m, s, str(tmp_path / "d"))
    back = catalog.read_decisions(spark, str(tmp_path / "d"))
    assert [tuple(x) for x in back["renames"].collect()] == [("a", "x")]
    assert [tuple(x) for x in back["merges"].orderBy("pos").collect()] == [(0, 0, "a"), (0, 1, "b")]
    assert [tuple(x) for x in back["splits"].collect()] == [("a", "p", "t")]
    (tmp_path / "bad.json").write_text("{nope")
    with pytest.raises(Exception, match="MALFORMED|Malformed|FAILFAST"):
        catalog.read_decisions(spark, str(tmp_path / "bad.json"))["renames"].collect()


# ---------------------------------------------------------------- files and parsing


def test_scan_hash_lines(spark, tmp_path):
    for p, t in (("a/x.txt", "one\r\ntwo"), ("a/.git/y.txt", "no"), ("venv/z.txt", "no"), ("a/~$b.xlsx", "no"), ("c.tmp", "no"), ("d.txt", "é")):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(t.encode())
    found = files.with_sha256(files.scan_files(spark, str(tmp_path)))
    got = {r["rel_path"]: r["sha256"] for r in found.collect()}
    import hashlib

    assert got == {"a/x.txt": hashlib.sha256(b"one\r\ntwo").hexdigest(), "d.txt": hashlib.sha256("é".encode()).hexdigest()}
    lines = files.read_lines(found.where("rel_path = 'a/x.txt'"), "rel_path")
    assert [(r["line_no"], r["value"]) for r in lines.orderBy("line_no").collect()] == [(1, "one"), (2, "two")]


def test_keyed_text(spark):
    text = ";SampleName = b\n;KAlpha1 = 1.54\n;KBata = 1.39\n;KV = x\n;SlitName1 = s1\n;SlitName0 = s0\n\n5.0 1.5\n5.1\t2.5\n5.2 1.0d\nbad\n5.3 -1"
    lines = spark.createDataFrame([("f", i + 1, v) for i, v in enumerate(text.split("\n"))], "file_id string, line_no int, value string")
    h = parsing.typed_header(parsing.header_map(parsing.header_pairs(lines))).first()
    assert (h["sample_name"], h["wavelength_ka1"], h["wavelength_kbeta"], h["voltage_kv"], h["slits"], h["not_numeric"], h["missing"]) == ("b", 1.54, 1.39, None, ["s0", "s1"], ["KV"], [])
    pairs = parsing.pair_rows(lines)
    assert [(r["x"], r["y"]) for r in parsing.scan_points(pairs).orderBy("idx").collect()] == [(5.0, 1.5), (5.1, 2.5), (5.3, -1.0)]
    q = parsing.scan_quality(pairs).first()
    assert (q["n_points"], q["malformed"], q["state"]) == (3, 2, "warning")
    assert col(spark, "string", [text, "x"], classify.score_keyed_text) == [1.0, 0.0]


def test_xml_scans(spark, tmp_path):
    (tmp_path / "s.xml").write_text('<?xml version="1.0"?><m xmlns="http://x"><scan><header><startTimeStamp>2024-06-21T11:00:13+05:30</startTimeStamp></header><dataPoints><positions axis="2Theta" unit="deg"><startPosition>5</startPosition><endPosition>6</endPosition></positions><intensities unit="counts">1 2 3 4 5</intensities></dataPoints></scan></m>')
    scans = files.read_diffraction_xml(spark, str(tmp_path / "s.xml"))
    assert [(r["x"], r["y"]) for r in parsing.diffraction_points(scans).orderBy("idx").collect()] == [(5.0, 1.0), (5.25, 2.0), (5.5, 3.0), (5.75, 4.0), (6.0, 5.0)]
    (tmp_path / "e.spx").write_bytes("<?xml version='1.0' encoding='windows-1252'?><TRTSpectrum><CalibAbs>-0.5</CalibAbs><CalibLin>0.25</CalibLin><Date>2.12.2022</Date><Time>8:00:24</Time><Channels>1,2,3</Channels>µ</TRTSpectrum>".encode("windows-1252"))
    s = files.read_spectrum_xml(spark, str(tmp_path / "e.spx"))
    assert [r["x"] for r in parsing.spectrum_points(s).orderBy("idx").collect()] == [-0.5, -0.25, 0.0]
    assert str(s.select(parsing.local_timestamp(F.col("date"), F.col("time"))).first()[0]) == "2022-12-02 08:00:24"


def test_contract_and_outcomes(spark):
    arrays = spark.createDataFrame([(1, "a", 3), (1, "b", 4), (2, "a", 3)], "measurement_id int, name string, n int")
    meta = spark.createDataFrame([(1, "1.0.0", "xrd-text", "{}"), (2, "1.0", "Xrd", "{")], "measurement_id int, parser_version string, parser_name string, metadata string")
    got = {tuple(r) for r in parsing.contract_violations(arrays, meta).collect()}
    assert got == {(1, "equal_length"), (2, "version"), (2, "name"), (2, "json")}
    assert col(spark, "string", ["data", "RAW  data", "CS-1"], classify.is_generic) == [True, True, False]


# ---------------------------------------------------------------- curves


def spectrum(gap, transition):
    x = np.linspace(250, 800, 401)
    e = 1240 / x
    over = np.maximum(e - gap, 0)
    f = (np.sqrt(over) if transition == "direct" else over**2) / e
    return [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, np.maximum(1 + f - np.sqrt(f * f + 2 * f), 1e-3)))]


@pytest.mark.parametrize(("transition", "near"), [("direct", 0.05), ("indirect", 0.1)])
def test_band_gaps(spark, transition, near):
    gaps = [1.7, 2.05, 2.5, 3.1]
    rows = [(k, *p) for k, g in enumerate(gaps) for p in spectrum(g, transition)] + [(9, i, 300.0 + i, 0.5) for i in range(30)] + [(10, 0, 300.0, 50.0)]
    df = spark.createDataFrame(rows, f"{M} int, idx int, x double, y double")
    got = {r[M]: r for r in curves.band_gap(df, transition).collect()}
    for k, g in enumerate(gaps):
        assert abs(got[k]["band_gap"] - g) < near
    assert got[10]["band_gap"] is None and any(i["severity"] == "error" for i in got[10]["issues"])
    percent = spark.createDataFrame([(0, i, x, y * 100) for i, x, y in spectrum(2.5, transition)], f"{M} int, idx int, x double, y double")
    assert abs(curves.band_gap(percent, transition).first()["band_gap"] - 2.5) < near


def test_flat_fit_has_no_r2(spark):
    df = spark.createDataFrame([(1, i, float(i), 2.0) for i in range(5)], f"{M} int, idx int, x double, y double")
    assert curves.line_fit(df, "x", "y").first()["r2"] == 0


def test_baseline_forms_agree(spark):
    rng = np.random.default_rng(1)
    y = (rng.random(50) * 10).tolist()
    native = spark.createDataFrame([(y,)], "y array<double>").select(curves.snip_arrays(F.col("y"), 7)).first()[0]
    assert np.allclose(native, curves.snip(np.array(y), 7))


def scan(k, found, noise=1.0, step=0.02):
    rng = np.random.default_rng(k)
    x = np.arange(10, 80, step)
    y = 300 * np.exp(-x / 25) + 20 + rng.normal(0, noise, len(x))
    for center, height, fwhm, mix in found:
        d = x - center
        y += height * ((1 - mix) * np.exp(-4 * np.log(2) * d * d / fwhm**2) + mix / (1 + 4 * d * d / fwhm**2))
    return [(k, i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))]


def test_peaks_are_found_and_fitted(spark):
    truth = [(15.0, 800.0, 0.25, 0.0), (28.5, 500.0, 0.3, 1.0), (47.3, 300.0, 0.35, 0.5), (63.8, 200.0, 0.3, 0.3)]
    double = [(70.0, 400.0, 0.2, 0.2), (70.4, 250.0, 0.2, 0.2)]
    df = spark.createDataFrame(scan(1, truth) + scan(2, double) + scan(3, [], 2.0)[:3500], f"{M} long, idx int, x double, y double")
    got = {r[M]: r for r in peaks.peak_table(df).collect()}
    for k, want in ((1, truth), (2, double)):
        centers = [p["center"] for p in got[k]["peaks"]]
        for c, h, w, _ in want:
            p = min(got[k]["peaks"], key=lambda p: abs(p["center"] - c))
            assert abs(p["center"] - c) < 0.05 and abs(p["fwhm"] - w) / w < 0.2
        assert centers == sorted(centers)
    assert got[1]["r2"] > 0.9
    assert got[3]["n_peaks"] <= 15


def test_every_scan_gets_a_row(spark):
    """Short, flat, falling, constant-axis and null scans are rows with an error; the good one is unharmed."""
    rng = np.random.default_rng(3)
    x = np.arange(10, 40, 0.05)
    good = 50 + rng.normal(0, 1, len(x)) + 500 * np.exp(-((x - 25) ** 2) / 0.08)
    rows = [(1, i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, good))]
    rows += [(2, i, float(i), 1.0) for i in range(10)] + [(3, i, float(i), 5.0) for i in range(200)] + [(4, i, 7.0, float(i)) for i in range(200)]
    rows += [(5, i, None, None) for i in range(60)] + [(6, i, float("nan"), 1.0) for i in range(60)]
    df = spark.createDataFrame(rows, f"{M} long, idx int, x double, y double")
    got = {r[M]: r for r in peaks.peak_table(df).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6]
    assert got[1]["state"] == "ok" and abs(got[1]["peaks"][0]["center"] - 25) < 0.05
    for k in range(2, 7):
        assert got[k]["state"] == "error" and got[k]["n_peaks"] == 0 and got[k]["peaks"] == [] and got[k]["r2"] is None and len(got[k]["issues"]) == 1


def test_an_error_inside_is_an_issue(spark, monkeypatch):
    df = spark.createDataFrame([(1, i, float(i), float(i % 7)) for i in range(80)], f"{M} long, idx int, x double, y double")
    got = peaks.peak_table(df, {"window": "seven"}).collect()
    assert len(got) == 1 and got[0]["state"] == "error" and "Error" in got[0]["issues"][0]


def test_fits_say_when_they_do_not_converge():
    x = np.arange(0, 10, 0.1)
    y = peaks.profile(x, 5.0, 4.9, 0.3, 0.4) + peaks.profile(x, 3.0, 5.6, 0.2, 0.1)
    start = np.array([1.0, 4.5, 0.5, 0.5, 1.0, 6.0, 0.5, 0.5])
    low, high = np.array([0, 4, 0.1, 0] * 2, float), np.array([99, 7, 2, 1] * 2, float)
    assert peaks.fit_profiles(x, y, start, low, high, steps=2) is None
    fit = peaks.fit_profiles(x, y, start, low, high).reshape(2, 4)
    assert np.allclose(sorted(fit[:, 1]), [4.9, 5.6], atol=1e-3)
    assert peaks.fit_profiles(x, y * np.nan, start, low, high) is None


def test_header_cells_take_outputs_from_left_to_right(spark):
    heads = ["Temperature of Seebeck probe", "Seebeck", "Resistivity", "Temperature", "Thermal conductivity", "Temperature again"]
    cells = [(1, "A", 0, k, None, h) for k, h in enumerate(heads)] + [(1, "A", 1, k, float(k), None) for k in range(6)]
    df = spark.createDataFrame(cells, "file_id long, sheet string, row_idx int, col_idx int, num double, txt string")
    got = {r["col_idx"]: r["output"] for r in parsing.property_columns(df).collect()}
    assert got == {0: "temperature_k", 1: "seebeck_uvk", 2: "resistivity_ohm_m", 4: "thermal_conductivity"}


def test_overlap_groups(spark):
    df = spark.createDataFrame([(1, 10, 1.0), (1, 14, 1.0), (1, 40, 2.0), (1, 90, 0.1)], f"{M} int, idx int, width double")
    assert [r["cluster"] for r in curves.overlap_groups(df).orderBy("idx").collect()] == [0, 0, 1, 2]


# ---------------------------------------------------------------- catalog


def test_incremental_ingest(spark):
    prior = spark.createDataFrame([("p1", "s1", "1.0.0"), ("p2", "s2", "0.9.0")], "path string, sha256 string, parser_version string")
    now = spark.createDataFrame([("p1", "s1", "1.0.0"), ("p2", "s2", "1.0.0"), ("p3", "s3", "1.0.0")], "path string, sha256 string, parser_version string")
    todo = catalog.needs_parse(now, prior)
    assert sorted(r["path"] for r in todo.collect()) == ["p2", "p3"]
    merged = catalog.merge_measurements(prior, todo)
    assert sorted((r["path"], r["parser_version"]) for r in merged.collect()) == [("p1", "1.0.0"), ("p2", "1.0.0"), ("p3", "1.0.0")]


def test_stored_points_and_projects(spark, tmp_path):
    p = spark.createDataFrame([(m, i, float(i), float(m), "xrd") for m in (1, 2) for i in range(3)], f"{M} long, idx int, x double, y double, technique string")
    catalog.save_points(p, str(tmp_path / "p"))
    assert catalog.load_points(spark, str(tmp_path / "p"), 2).count() == 3 and catalog.load_points(spark, str(tmp_path / "p"), 7).count() == 0
    catalog.delete_points(spark, str(tmp_path / "p"), spark.createDataFrame([(2,)], f"{M} long"), str(tmp_path / "q"))
    assert {r[M] for r in spark.read.parquet(str(tmp_path / "q")).collect()} == {1}
    a = spark.createDataFrame([("x", 1), ("y", 1)], "project_id string, v int")
    catalog.save_project(a, str(tmp_path / "c"))
    catalog.save_project(spark.createDataFrame([("x", 2)], "project_id string, v int").select("v", "project_id"), str(tmp_path / "c"))
    assert {(r["project_id"], r["v"]) for r in spark.read.parquet(str(tmp_path / "c")).collect()} == {("x", 2), ("y", 1)}


def test_result_cache(spark):
    w = spark.createDataFrame([(1, "a", "f", "1"), (2, "a", "f", "1")], f"{M} int, analyzer_name string, params_fp string, analyzer_version string")
    stored = w.where(f"{M} = 1")
    assert [r[M] for r in catalog.result_misses(w, stored).collect()] == [2]
    assert catalog.result_misses(w, stored, force=True).count() == 2
    new = stored.withColumn("analyzer_version", F.lit("2"))
    assert [r["analyzer_version"] for r in catalog.replace_results(stored, new).collect()] == ["2"]
    fp = [r[0] for r in spark.sql("select map('a', '1', 'b', '2') m union all select map('b', '2', 'a', '1')").select(catalog.params_fingerprint(F.col("m"))).collect()]
    assert fp[0] == fp[1] and len(fp[0]) == 16


def test_stream_takes_each_content_once(spark, tmp_path):
    from meterlake.streaming import ingest_stream

    (tmp_path / "in").mkdir()
    pairs = lambda k: "\n".join(f"{i}.0 {k}" for i in range(9))
    for n, t in (("a.txt", pairs(1)), ("b.txt", pairs(1)), ("c.txt", pairs(2)), (".hidden", pairs(7))):
        (tmp_path / "in" / n).write_text(t)
    go = lambda: ingest_stream(spark, str(tmp_path / "in"), str(tmp_path / "t"), str(tmp_path / "k")).awaitTermination()
    go()
    (tmp_path / "in" / "d.txt").write_text(pairs(2))
    (tmp_path / "in" / "e.txt").write_text(pairs(3))
    go()
    from meterlake.streaming import stored

    at = str(tmp_path / "t")
    got = stored(spark, at, "measurements")
    assert got.count() == 3 and got.select("sha256").distinct().count() == 3
    assert stored(spark, at, "points").count() == 27
    outcomes = sorted((r["path"][-5:], r["outcome"]) for r in stored(spark, at, "outcomes").collect())
    assert outcomes == [("a.txt", "parsed"), ("c.txt", "parsed"), ("d.txt", "cached"), ("e.txt", "parsed")]
    assert not (tmp_path / "t" / "routed" / "batch=x").exists() and not list((tmp_path / "t" / "routed").glob("batch=*"))


FILES = {
    "CS-1/xrd/one.txt": b";SampleName = A\n;KAlpha1 = 1.54\n;KV = high\n10.0 5\n10.1 6\nbad row\n10.2 7\n",
    "CS-1/xrd/two.asc": b"\n".join(b"%d.5 %d" % (k, 5 - k) for k in range(12)),
    "CS-1/xps/three.csv": b"Exported by hand\nC1s,\n296.1,5\n296.0,6\n295.9,x\n295.8,7\n295.7,8\n295.6,9\n",
    "data/four.xrdml": b'<?xml version="1.0"?><xrdMeasurements xmlns="http://x"><xrdMeasurement><scan appendNumber="0"><header><startTimeStamp>2024-06-21T11:00:13+05:30</startTimeStamp></header><dataPoints><positions axis="2Theta"><startPosition>5</startPosition><endPosition>7</endPosition></positions><intensities unit="counts"> 1 2 3 </intensities></dataPoints></scan></xrdMeasurement></xrdMeasurements>',
    "data/five.spx": b"<?xml version='1.0' encoding='WINDOWS-1252'?><TRTSpectrum><Date>2.12.2022</Date><Time>18:00:24</Time><CalibAbs>-0.5</CalibAbs><CalibLin>0.25</CalibLin><Channels>1,2,3,4</Channels></TRTSpectrum>",
    "data/six.spx": b"<TRTSpectrum>\xb5<Channels>1,x,3</Channels></TRTSpectrum>",
    "data/seven.txt": b"just words\n\xff\xfe", "data/eight.pdf": b"1 2\n3 4\n", "data/nine.txt": b"",  # Spark lists no empty files
    "data/ten.xrdml": b"<xrdMeasurement><scan><broken",
}


def test_a_folder_is_ingested_whole(spark, tmp_path):
    from meterlake.operators import ingest

    for name, content in FILES.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(content)
    found = files.scan_files(spark, str(tmp_path))
    got = ingest.ingest(found)
    name = lambda p: p.split("/")[-1].split(".")[0]
    outcomes = {name(r["path"]): r["outcome"] for r in got.outcomes.collect()}
    assert outcomes == {
        "one": "parsed", "two": "parsed", "three": "parsed", "four": "parsed", "five": "parsed", "six": "parsed_with_issues",
        "seven": "unclassified", "eight": "unclassified", "ten": "parsed_with_issues",
    }
    m = {name(r["path"]): r for r in got.measurements.collect()}
    ids = {r["measurement_id"]: k for k, r in m.items()}
    points = {}
    for r in got.points.collect():
        points.setdefault(ids[r["measurement_id"]], []).append((r["idx"], r["x"], r["y"]))
    assert {k: len(v) for k, v in points.items()} == {"one": 3, "two": 12, "three": 5, "four": 3, "five": 4}
    assert sorted(points["four"]) == [(0, 5.0, 1.0), (1, 6.0, 2.0), (2, 7.0, 3.0)] and sorted(points["five"])[3] == (3, 0.25, 4.0)
    assert m["one"]["sample"] == "CS-1" and m["one"]["metadata"]["SampleName"] == "A" and m["three"]["metadata"]["region"] == "C1s"
    assert str(m["four"]["measured_at"]) == "2024-06-21 05:30:13" and str(m["five"]["measured_at"]) == "2022-12-02 18:00:24"
    issues = sorted((ids[r["measurement_id"]], r["field"], r["severity"]) for r in got.issues.collect())
    assert issues == [
        ("five", "measured_at", "warning"), ("one", "KV", "warning"), ("one", "data", "warning"), ("six", "data", "error"),
        ("ten", "data", "error"), ("three", "data", "warning"), ("two", "y", "warning"),
    ]
    again = ingest.ingest(found, got.measurements)
    assert {name(r["path"]) for r in again.outcomes.where("outcome = 'cached'").collect()} == set(m) and again.points.count() == 0
    assert ingest.ingest(found.limit(0)).outcomes.count() == 0


def test_parsers_are_registered_once_and_named_well():
    from meterlake.operators import ingest

    p = ingest.default_parsers()
    one = next(iter(p.by_name.values()))
    from dataclasses import replace

    for bad, what in ((one, "twice"), (replace(one, name="No Good"), "name"), (replace(one, name="new", version="1"), "version"), (replace(one, name="new", extensions=("txt",)), "extensions")):
        with pytest.raises(ValueError, match=what):
            p.register(bad)
    assert p.register(replace(one, name="new-one")).name in p.by_name


def test_reports(spark):
    df = spark.createDataFrame([(i,) for i in range(20)], "i int")
    got = reports.first_with_rest(df, [F.col("i")], 15).collect()
    assert len(got) == 15 and {r["remaining"] for r in got} == {5}
    assert json.loads(json.dumps(reports.SEVERITIES)) == ["info", "warning", "error"]


def test_analysis_runs_reuse_results(spark):
    from meterlake.operators import service

    registry = service.default_registry()
    with pytest.raises(ValueError, match="twice"):
        registry.register(registry.by_name["band-gap"])
    assert [a.name for a in registry.for_technique("xrd")] == ["peak-table"]
    rows = [(k, *p) for k, g in enumerate([2.0, 3.0]) for p in spectrum(g, "direct")]
    points = spark.createDataFrame(rows, f"{M} long, idx int, x double, y double")
    m = spark.createDataFrame([(0, "uv_drs"), (1, "uv_drs"), (2, "xrd")], f"{M} long, technique string")
    none = spark.createDataFrame([], f"{M} long, analyzer_name string, params_fp string, analyzer_version string, outputs string, issues array<string>")
    a = registry.by_name["band-gap"]
    first = spark.createDataFrame(service.run_analysis(m, points, none, a).collect(), none.schema)
    assert {r[M]: round(json.loads(r["outputs"])["band_gap"], 1) for r in first.collect()} == {0: 2.0, 1: 3.0}
    marked = first.withColumn("outputs", F.lit("kept"))
    assert {r["outputs"] for r in service.run_analysis(m, points, marked, a).collect()} == {"kept"}
    assert "kept" not in {r["outputs"] for r in service.run_analysis(m, points, marked, a, force=True).collect()}
    assert service.run_analysis(m, points, marked, a, {"low": 0.3}).count() == 4
    with pytest.raises(ValueError, match="unknown"):
        service.run_analysis(m, points, none, a, {"nope": 1})


def test_monotonic_judges_whole_axes(spark, sf):
    duckdb = pytest.importorskip("duckdb")
    from meterlake.plans import QUERIES, SQL

    got = {r["measurement_id"]: (r["rising"], r["falling"]) for r in QUERIES["p05_monotonic_axis"](spark, sf).collect()}
    axes: dict[int, list[float]] = {}
    for r in sorted(spark.read.parquet(f"{sf}/events.parquet").collect(), key=lambda r: (r["ts"], r["event_id"])):
        k = r["user_id"]
        us = r["ts"].timestamp()
        axes.setdefault(k, []).append(us if k % 3 == 0 else -us if k % 3 == 1 else r["value"])
    assert got == {k: (x == sorted(x), x == sorted(x, reverse=True)) for k, x in axes.items()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{sf}/events.parquet'")
    assert got == {k: (a, b) for k, a, b in con.execute(SQL["p05_monotonic_axis"]).fetchall()}
    assert {(True, False), (False, True), (False, False)} <= set(got.values())
    assert any(x[:3] == sorted(x[:3]) and not got[k][0] for k, x in axes.items())


def test_name_candidates_lose_no_similar_pair(spark):
    rng = np.random.default_rng(21)
    names = {"".join(rng.choice(list("abcdeé"), rng.integers(1, 12))) for _ in range(250)} | {"prefix" + "".join(rng.choice(list("xyz"), rng.integers(0, 5))) for _ in range(60)} | {"a" * k for k in range(1, 9)}
    df = spark.createDataFrame([(n,) for n in sorted(names)], "name string")
    for threshold in (0.0, 0.3, 0.7, 0.85, 1.0):
        want = {(a, b) for a in names for b in names if a < b and N.similarity_of(a, b) >= threshold}
        assert {(r["a"], r["b"]) for r in resolve.name_edges(df, threshold).collect()} == want
    with pytest.raises(ValueError):
        resolve.name_edges(df, 1.5)


def test_components_in_one_chunk_and_in_many(spark):
    edges = [(f"n{i:03}", f"n{i + 1:03}") for i in range(60)] + [("s", f"s{i}") for i in range(30)]
    nodes = spark.createDataFrame([(n,) for n in sorted({x for e in edges for x in e} | {"alone"})], "node string")
    df = spark.createDataFrame(edges, "a string, b string")
    want = {n: "n000" if n.startswith("n") else "s" if n.startswith("s") else n for (n,) in nodes.collect()}
    for chunk in (500_000, 20):
        assert {r["node"]: r["component"] for r in resolve.components(nodes, df, chunk).collect()} == want
