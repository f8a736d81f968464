"""Queries on catalog reports: filters (f), aggregates (g), sorts and limits (o), set operations (u), scalars (x)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as N
from ..operators import catalog, classify, curves, parsing, reports
from ..sources import files as files_source
from . import carriers as c
from .registry import query
from .resolve import LCS, SIMILAR

WITH = f"WITH {c.FILES}, {c.PRIOR} "


def _m(spark, sf):
    return c.files(spark, sf)


# ---------------------------------------------------------------- filters

query("f01_samples_with_technique", WITH + "SELECT DISTINCT sample_id FROM files WHERE technique = 'xrd'")(lambda s, d: reports.samples_with(_m(s, d), "xrd"))
query("f02_measurements_of_technique", WITH + "SELECT doc_id, path FROM files WHERE technique = 'hall'")(lambda s, d: reports.measurements_of(_m(s, d), "hall").select("doc_id", "path"))
query("f03_lookup_by_id", WITH + "SELECT path, sha256 FROM files WHERE doc_id = 7")(lambda s, d: reports.lookup(_m(s, d), "doc_id", 7).select("path", "sha256"))
query("f04_severity_flags", f"WITH {c.ISSUES} SELECT measurement_id, arg_max(severity, list_position(['info','warning','error'], severity)) AS worst, bool_or(severity = 'error') AS has_errors, bool_or(severity <> 'info') AS has_warnings, bool_or(severity = 'warning') AS has_warning_only FROM issues GROUP BY measurement_id")(
    lambda s, d: reports.worst_severity(c.issues(s, d))
)


@query("f05_finite_rows", f"WITH {c.SCANS} SELECT measurement_id, count(*) AS n FROM scans WHERE isfinite(x) AND isfinite(ln(abs(y) + CASE WHEN event_id % 5 = 0 THEN 0 ELSE 1 END)) GROUP BY measurement_id")
def _(spark, sf):
    from ..operators.curves import finite

    y = F.log(F.abs("y") + F.when(F.col("event_id") % 5 == 0, 0).otherwise(1))
    return c.scans(spark, sf).where(finite(F.col("x")) & finite(y)).groupBy("measurement_id").agg(F.count(F.lit(1)).alias("n"))


@query("f06_fit_window", f"WITH {c.CURVES}, m AS (SELECT *, max(y) OVER (PARTITION BY measurement_id) AS top FROM curves) SELECT measurement_id, idx, y FROM m WHERE y BETWEEN 0.2 * top AND 0.8 * top")
def _(spark, sf):
    from ..operators.curves import fit_window

    return fit_window(c.curves(spark, sf), value="y").select("measurement_id", "idx", "y")


ANALYZERS = [("uv_drs", "band-gap", 0), ("xrd", "peak-table", 1), ("xrd", "phase-match", 2)]
ANALYZERS_SQL = "analyzers AS (SELECT * FROM (VALUES ('uv_drs', 'band-gap', 0), ('xrd', 'peak-table', 1), ('xrd', 'phase-match', 2)) AS t(technique, analyzer, priority))"


def _analyzers(spark):
    return spark.createDataFrame(ANALYZERS, "technique string, analyzer string, priority int")


query("f07_analyzable_measurements", f"WITH {c.FILES}, {ANALYZERS_SQL} SELECT doc_id, technique FROM files WHERE technique IN (SELECT technique FROM analyzers)")(
    lambda s, d: _m(s, d).join(F.broadcast(_analyzers(s)), "technique", "left_semi").select("doc_id", "technique")
)


@query("f09_default_axes", f"WITH {c.CELLS}, a AS (SELECT DISTINCT file_id AS measurement_id, col_idx AS ordinal, txt AS name FROM cells WHERE txt IS NOT NULL AND txt <> 'n/a' AND (file_id % 2 = 0 OR col_idx < 2)) SELECT measurement_id, max(CASE WHEN ordinal = 0 THEN name END) AS x_name, coalesce(max(CASE WHEN name = 'Resistivity' THEN name END), max(CASE WHEN ordinal = 1 THEN name END), max(CASE WHEN ordinal = 0 THEN name END)) AS y_name FROM a GROUP BY measurement_id")
def _(spark, sf):
    a = c.cells(spark, sf).where("txt is not null and txt <> 'n/a' and (file_id % 2 = 0 or col_idx < 2)").select(F.col("file_id").alias("measurement_id"), F.col("col_idx").alias("ordinal"), F.col("txt").alias("name")).distinct()
    return reports.default_axes(a, "Resistivity")


@query("f10_param_override", f"WITH {c.FILES} SELECT doc_id, 'low=0.' || CAST(doc_id % 5 AS VARCHAR) || ';mode=direct' || CASE WHEN doc_id % 2 = 0 THEN ';window=9' ELSE '' END AS params FROM files")
def _(spark, sf):
    given = F.when(F.col("doc_id") % 2 == 0, F.create_map(F.lit("low"), F.concat(F.lit("0."), (F.col("doc_id") % 5).cast("string")), F.lit("window"), F.lit("9"))).otherwise(F.create_map(F.lit("low"), F.concat(F.lit("0."), (F.col("doc_id") % 5).cast("string"))))
    merged = catalog.override(F.create_map(F.lit("low"), F.lit("0.2"), F.lit("mode"), F.lit("direct")), given)
    text = F.array_join(F.transform(F.array_sort(F.map_entries(merged)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return _m(spark, sf).select("doc_id", text.alias("params"))


# ---------------------------------------------------------------- aggregates

OUTCOME_SQL = WITH + """, o AS (SELECT f.doc_id, f.technique, f.size_bytes, CASE WHEN f.content IS NULL THEN 'hash_failed' WHEN f.doc_id % 10 / 10.0 < 0.5 THEN 'unclassified'
  WHEN EXISTS (SELECT 1 FROM prior p WHERE p.sha256 = f.sha256 AND p.parser_version = f.parser_version) THEN 'cached' WHEN f.size_bytes < 200 THEN 'parse_failed'
  WHEN coalesce(l.toxic, 0) = 1 THEN 'parsed_with_issues' ELSE 'parsed' END AS outcome FROM files f LEFT JOIN labels l USING (doc_id)) """


def outcomes(spark, sf):
    f = catalog.cache_hits(_m(spark, sf), c.prior(spark, sf)).join(c.read(spark, sf, "labels"), "doc_id", "left")
    o = classify.outcome(F.col("content").isNull(), F.col("doc_id") % 10 / 10.0, F.col("cached"), F.col("size_bytes") < 200, F.coalesce("toxic", F.lit(0)) == 1)
    return f.select("doc_id", "technique", "size_bytes", o.alias("outcome"))


query("c13_outcomes", OUTCOME_SQL + "SELECT doc_id, outcome FROM o")(lambda s, d: outcomes(s, d).select("doc_id", "outcome"))
query("g01_outcome_counts", OUTCOME_SQL + "SELECT outcome, count(*) AS n FROM o GROUP BY outcome")(lambda s, d: reports.counts(outcomes(s, d), "outcome"))
query("g02_measurements_per_technique", WITH + "SELECT technique, count(*) AS n FROM files GROUP BY technique ORDER BY n DESC, technique")(lambda s, d: reports.counts(_m(s, d), "technique").orderBy(F.desc("n"), "technique"))
query("g03_technique_breakdown", WITH + ", b AS (SELECT sample_id, technique || '=' || CAST(count(*) AS VARCHAR) AS p FROM files GROUP BY sample_id, technique) SELECT sample_id, string_agg(p, ', ' ORDER BY p) AS breakdown FROM b GROUP BY sample_id")(lambda s, d: reports.technique_breakdown(_m(s, d)))
query("g04_project_summary", WITH + "SELECT project_id, count(DISTINCT sample_id) AS samples, count(*) AS measurements, count(DISTINCT sha256) AS files, array_to_string(list_sort(list_distinct(list(technique))), ',') AS techniques FROM files GROUP BY project_id")(lambda s, d: reports.project_summary(_m(s, d)))
query("g05_dashboard", OUTCOME_SQL + "SELECT count(*) AS files, count(*) FILTER (outcome = 'cached') AS cached, count(*) FILTER (outcome = 'parse_failed') AS failed, CAST(sum(size_bytes) AS BIGINT) AS bytes, count(DISTINCT technique) AS techniques FROM o")(
    lambda s, d: outcomes(s, d).agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("outcome") == "cached").alias("cached"), F.count_if(F.col("outcome") == "parse_failed").alias("failed"), F.sum("size_bytes").alias("bytes"), F.countDistinct("technique").alias("techniques"))
)
query("g06_techniques_per_sample", WITH + "SELECT sample_id, count(DISTINCT technique) AS n, list_sort(list(DISTINCT technique)) AS techniques FROM files GROUP BY sample_id")(
    lambda s, d: _m(s, d).groupBy("sample_id").agg(F.countDistinct("technique").alias("n"), F.array_sort(F.collect_set("technique")).alias("techniques"))
)
query("g15_scan_statistics", f"WITH {c.SCANS} SELECT measurement_id, round(avg(CAST(y < 10 AS INT)), 9) AS low_share, arg_min(y, idx) AS first_y, arg_max(y, idx) AS last_y, min(y) AS low, max(y) AS high, count(*) AS n FROM scans GROUP BY measurement_id")(
    lambda s, d: c.scans(s, d).groupBy("measurement_id").agg(F.round(F.avg((F.col("y") < 10).cast("int")), 9).alias("low_share"), F.min_by("y", "idx").alias("first_y"), F.max_by("y", "idx").alias("last_y"), F.min("y").alias("low"), F.max("y").alias("high"), F.count(F.lit(1)).alias("n"))
)
query("g16_nan_free_max", f"WITH {c.SCANS} SELECT measurement_id, max(y) FILTER (event_id % 3 <> 0) AS top FROM scans GROUP BY measurement_id")(
    lambda s, d: curves.nan_free_max(c.scans(s, d).withColumn("v", F.when(F.col("event_id") % 3 == 0, float("nan")).otherwise(F.col("y"))), "v")
)
query("g17_issues_by_severity", f"WITH {c.ISSUES} SELECT severity, field, count(*) AS n FROM issues GROUP BY severity, field")(lambda s, d: reports.issues_by_severity(c.issues(s, d)))

# ---------------------------------------------------------------- sorts, limits, sets

query("o04_most_recent_first", "SELECT event_id, user_id, ts FROM events ORDER BY ts DESC, event_id")(lambda s, d: reports.most_recent_first(c.read(s, d, "events").select("event_id", "user_id", "ts"), "ts", "event_id"))


@query("o05_unclassified_report", OUTCOME_SQL + ", u AS (SELECT * FROM o WHERE outcome = 'unclassified') SELECT doc_id, technique, greatest((SELECT count(*) FROM u) - 15, 0) AS remaining FROM u ORDER BY doc_id LIMIT 15")
def _(spark, sf):
    u = outcomes(spark, sf).where("outcome = 'unclassified'").select("doc_id", "technique")
    return reports.first_with_rest(u, [F.col("doc_id")], 15)


query("o06_failures", OUTCOME_SQL + "SELECT doc_id, size_bytes FROM o WHERE outcome = 'parse_failed' ORDER BY doc_id")(lambda s, d: reports.failures(outcomes(s, d), "doc_id").select("doc_id", "size_bytes"))
query("o07_samples_by_name", "SELECT DISTINCT c_name FROM customer ORDER BY c_name")(lambda s, d: reports.by_name(c.read(s, d, "customer"), "c_name"))
query("o08_first_with_arrays", WITH + "SELECT f.doc_id, f.path FROM files f WHERE EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = f.doc_id) ORDER BY f.doc_id LIMIT 1")(
    lambda s, d: reports.first_with_arrays(_m(s, d).select("doc_id", "path"), c.read(s, d, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id")
)
query("o09_canonical_name", "SELECT p_brand, arg_min(p_name, {'n': length(p_name), 'a': p_name}) AS canonical FROM part GROUP BY p_brand")(lambda s, d: c.read(s, d, "part").groupBy("p_brand").agg(F.min_by("p_name", F.struct(F.char_length("p_name"), "p_name")).alias("canonical")))
query("u01_union_of_runs", WITH + ", new AS (SELECT * FROM files f WHERE NOT EXISTS (SELECT 1 FROM prior p WHERE p.sha256 = f.sha256 AND p.parser_version = f.parser_version)) SELECT doc_id, path, parser_version FROM prior WHERE sha256 NOT IN (SELECT sha256 FROM new) UNION ALL SELECT doc_id, path, parser_version FROM new")(
    lambda s, d: catalog.merge_measurements(c.prior(s, d), catalog.needs_parse(_m(s, d), c.prior(s, d))).select("doc_id", "path", "parser_version")
)
query("u02_files_left_out", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")(lambda s, d: reports.left_out(c.read(s, d, "documents"), c.read(s, d, "labels"), "doc_id"))
query("u03_distinct_paths", "SELECT DISTINCT p_brand AS path FROM part")(lambda s, d: reports.distinct_paths(c.read(s, d, "part"), "p_brand"))
query("u04_alias_union", "SELECT p_size, list_sort(list(DISTINCT v)) AS aliases FROM (SELECT p_size, unnest([p_brand, p_type]) AS v FROM part) GROUP BY p_size")(
    lambda s, d: c.read(s, d, "part").groupBy("p_size").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("p_brand", "p_type"))))).alias("aliases"))
)
query("u05_shared_hashes", WITH + "SELECT DISTINCT a.sha256 FROM files a JOIN files b ON a.sha256 = b.sha256 AND a.project_id < b.project_id")(
    lambda s, d: reports.shared_hashes(_m(s, d))
)


@query("u06_missing_columns", f"WITH {c.CELLS}, k AS (SELECT file_id, sheet, lower(txt) AS t FROM cells WHERE row_idx = 0 AND txt IS NOT NULL AND col_idx <= file_id % 5 + 1) SELECT file_id, sheet, list_sort(list_filter(['temperature_k', 'resistivity_ohm_m', 'thermal_conductivity', 'seebeck_uvk'], lambda r: NOT list_contains(list(CASE WHEN t LIKE '%temperature%' THEN 'temperature_k' WHEN t LIKE '%resistivity%' THEN 'resistivity_ohm_m' WHEN t LIKE '%thermal conductivity%' THEN 'thermal_conductivity' WHEN t LIKE '%seebeck%' THEN 'seebeck_uvk' END), r))) AS missing FROM k GROUP BY file_id, sheet")
def _(spark, sf):
    cells = c.cells(spark, sf).where("col_idx <= file_id % 5 + 1")
    return parsing.missing_columns(parsing.property_columns(cells)).select("file_id", "sheet", "missing")


# ---------------------------------------------------------------- scalars


@query("x01_normal_names", "SELECT DISTINCT raw, regexp_replace(regexp_replace(lower(trim(raw)), '^((sample|specimen|spec|sampleid|specimenid)[\\s\\-_:.]*)+', ''), '[\\s\\-_()./:\\[\\]\\\\]+', '', 'g') AS name FROM (SELECT c_name AS raw FROM customer UNION ALL SELECT 'Sample: ' || p_name || ' (' || p_brand || ')' FROM part UNION ALL SELECT s_name FROM supplier)")
def _(spark, sf):
    raw = c.read(spark, sf, "customer").select(F.col("c_name").alias("raw")).unionAll(c.read(spark, sf, "part").select(F.concat(F.lit("Sample: "), "p_name", F.lit(" ("), "p_brand", F.lit(")")).alias("raw"))).unionAll(c.read(spark, sf, "supplier").select("s_name"))
    return raw.distinct().select("raw", N.normalize_name(F.col("raw")).alias("name"))


query("x02_name_tokens", "SELECT p_partkey, list_filter(list_transform(regexp_split_to_array(lower(trim(p_name || ' - B/' || p_brand)), '\\s+'), lambda t: regexp_replace(t, '[\\s\\-_()./:\\[\\]\\\\]+', '', 'g')), lambda t: t <> '') AS tokens FROM part")(
    lambda s, d: c.read(s, d, "part").select("p_partkey", N.name_tokens(F.concat("p_name", F.lit(" - B/"), "p_brand")).alias("tokens"))
)
query("x03_stems", WITH + ", s AS (SELECT doc_id, regexp_replace(regexp_extract(rel_path, '([^/]*)$', 1), '(.)\\.[^.]*$', '\\1') AS stem FROM files) SELECT doc_id, stem, trim(regexp_replace(regexp_replace(regexp_replace(stem, '[ _\\-]+(run|scan|rep|trial)[ _\\-]?[0-9]+\\s*$', '', 'i'), '\\s*\\([0-9]+\\)\\s*$', ''), '[ _]+[0-9]{1,3}\\s*$', '')) AS cleaned FROM s")(
    lambda s, d: _m(s, d).select("doc_id", N.stem(F.col("rel_path")).alias("stem"), N.cleaned_stem(N.stem(F.col("rel_path"))).alias("cleaned"))
)
query("x04_segments", WITH + "SELECT doc_id, list_slice(list_reverse(string_split(rel_path, '/')), 2, 7) AS segments FROM files")(lambda s, d: _m(s, d).select("doc_id", N.segments(F.col("rel_path")).alias("segments")))
query("x05_depth_weights", "SELECT page_id, t.i AS depth, (CAST([0.8, 0.5, 0.4, 0.3] AS DOUBLE[]))[least(t.i + 1, 4)] AS weight FROM pages, unnest(range(0, len(string_split(url, '/')) - 1)) AS t(i)")(
    lambda s, d: c.read(s, d, "pages").select("page_id", F.posexplode(F.slice(F.split("url", "/"), 1, F.size(F.split("url", "/")) - 1)).alias("depth", "v")).select("page_id", F.col("depth").cast("long").alias("depth"), N.depth_weight(F.col("depth")).alias("weight"))
)
#: Every row's name beside its kind and its brand, over the whole table.
PAIRS = "WITH p AS (SELECT DISTINCT p_name AS a, p_type AS b FROM part UNION SELECT DISTINCT p_type, p_brand FROM part UNION SELECT DISTINCT p_name, lower(p_type) FROM part) SELECT a, b, "
INDEL = "round(2.0 * " + LCS.format(x="a", y="b") + " / (length(a) + length(b)), 6)"


def _pairs(spark, sf):
    p = c.read(spark, sf, "part")
    two = lambda x, y: p.select(F.col(x).alias("a"), y.alias("b"))
    return two("p_name", F.col("p_type")).unionAll(two("p_type", F.col("p_brand"))).unionAll(two("p_name", F.lower("p_type"))).distinct()


query("x08_jaro_winkler", PAIRS + "round(jaro_winkler_similarity(a, b), 6) AS jw FROM p")(lambda s, d: _pairs(s, d).select("a", "b", F.round(N.winkler("a", "b"), 6).alias("jw")))
query("x06_indel_ratio", PAIRS + INDEL + " AS ratio FROM p")(lambda s, d: _pairs(s, d).select("a", "b", F.round(N.indel("a", "b"), 6).alias("ratio")))
SORTED = "array_to_string(list_sort(regexp_split_to_array(trim({}), '\\s+')), ' ')"
query("x07_token_sort_ratio", PAIRS.replace("SELECT a, b, ", "") + ", q AS (SELECT a AS a0, b AS b0, " + SORTED.format("a") + " AS a, " + SORTED.format("b") + " AS b FROM p) SELECT a0 AS a, b0 AS b, " + INDEL + " AS ratio FROM q")(
    lambda s, d: _pairs(s, d).select("a", "b", F.round(N.token_sort("a", "b"), 6).alias("ratio"))
)
query("x09_similarity", PAIRS.replace("SELECT a, b, ", "") + ", q AS (SELECT a, b, " + SIMILAR + " AS plain, " + SORTED.format("a") + " AS sa, " + SORTED.format("b") + " AS sb FROM p) SELECT a, b, round(greatest(plain, 2.0 * " + LCS.format(x="sa", y="sb") + " / (length(a) + length(b))), 6) AS similarity FROM q")(
    lambda s, d: _pairs(s, d).select("a", "b", F.round(N.similarity("a", "b"), 6).alias("similarity"))
)


@query("x15_params_fingerprint", "SELECT p_partkey, left(sha256('[{\"key\":\"mode\",\"value\":\"' || p_brand || '\"},{\"key\":\"window\",\"value\":\"' || CAST(p_size % 5 AS VARCHAR) || '\"}]'), 16) AS params_fp FROM part")
def _(spark, sf):
    m = F.create_map(F.lit("window"), (F.col("p_size") % 5).cast("string"), F.lit("mode"), F.col("p_brand"))
    return c.read(spark, sf, "part").select("p_partkey", catalog.params_fingerprint(m).alias("params_fp"))


query("x16_row_ids", WITH + "SELECT doc_id, left(sha256('measurement:' || sha256), 32) AS id FROM files")(lambda s, d: _m(s, d).select("doc_id", catalog.row_id(F.lit("measurement"), F.col("sha256")).alias("id")))
query("x17_issue_json", f"WITH {c.ISSUES} SELECT measurement_id, '{{\"field\":\"' || field || '\",\"severity\":\"' || severity || '\",\"message\":\"' || message || '\"}}' AS issue FROM issues")(
    lambda s, d: c.issues(s, d).select("measurement_id", F.to_json(F.struct("field", "severity", "message")).alias("issue"))
)
query("x18_severity_order", f"WITH {c.ISSUES} SELECT measurement_id, CASE severity WHEN 'info' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END AS o FROM issues")(lambda s, d: c.issues(s, d).select("measurement_id", reports.severity_order(F.col("severity")).alias("o")))
query("x19_display_names", WITH + "SELECT DISTINCT technique, CASE technique WHEN 'xrd' THEN 'X-Ray Diffraction' WHEN 'xps' THEN 'X-Ray Photoelectron Spectroscopy' WHEN 'uv_drs' THEN 'UV-Vis Diffuse Reflectance' WHEN 'hall' THEN 'Hall Effect' ELSE 'Energy-Dispersive X-Ray Spectroscopy' END AS display FROM files")(
    lambda s, d: _m(s, d).select("technique", reports.display_name(F.col("technique")).alias("display")).distinct()
)
query("x20_snake_case", "SELECT DISTINCT p_type, regexp_replace(regexp_replace(lower(p_type || ' (cm2/V s)'), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS key FROM part")(lambda s, d: c.read(s, d, "part").select("p_type", parsing.snake(F.concat("p_type", F.lit(" (cm2/V s)"))).alias("key")).distinct())
query("x21_cell_coercion", "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount = 0 THEN NULL ELSE l_tax / l_discount END AS v FROM lineitem")(
    lambda s, d: c.read(s, d, "lineitem").withColumn("q", F.when(F.col("l_discount") == 0, float("nan")).otherwise(F.try_divide("l_tax", "l_discount"))).select("l_orderkey", "l_linenumber", F.when(~F.isnan("q") & (F.abs("q") < float("inf")), F.col("q")).alias("v"))
)
query("x22_timestamps", "SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) AS parsed FROM orders")(
    lambda s, d: c.read(s, d, "orders").select("o_orderkey", parsing.local_timestamp(F.date_format("o_orderdate", "d.M.yyyy"), F.date_format("o_orderdate", "H:m:s")).cast("timestamp_ntz").alias("parsed"))
)
query("x23_invariants", WITH + "SELECT doc_id, 'size' AS rule FROM files WHERE size_bytes < 100 UNION ALL SELECT doc_id, 'sha' FROM files WHERE NOT regexp_full_match(sha256, '[0-9a-f]{64}') UNION ALL SELECT doc_id, 'path' FROM files WHERE rel_path NOT LIKE '%run2%' AND doc_id % 4 = 0")(
    lambda s, d: _m(s, d).select("doc_id", F.explode(F.filter(F.array(F.when(F.col("size_bytes") < 100, "size"), F.when(~F.col("sha256").rlike("^[0-9a-f]{64}$"), "sha"), F.when(~F.col("rel_path").contains("run2") & (F.col("doc_id") % 4 == 0), "path")), lambda x: x.isNotNull())).alias("rule"))
)
query("x24_relative_path", WITH + "SELECT doc_id, rel_path AS rel FROM files")(lambda s, d: _m(s, d).select("doc_id", files_source.relative(F.col("path"), "lake").alias("rel")))


@query("w01_rank_one", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS r FROM lineitem) WHERE r = 1")
def _(spark, sf):
    r = reports.ranked(c.read(spark, sf, "lineitem"), "l_orderkey", [F.desc("l_extendedprice"), F.col("l_linenumber")])
    return r.where("rank = 1").select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("w09_latest_result", "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def _(spark, sf):
    return catalog.latest(c.read(spark, sf, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")
