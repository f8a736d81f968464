"""Queries on ingest: scans and stores (s), parsing (p), classification (c), joins (j)."""

from __future__ import annotations

import uuid

from pyspark.sql import Window, functions as F

from ..functions import names as N
from ..operators import catalog, classify, curves, ingest, parsing, reports
from ..sources import files as files_source
from ..sources.durable import shared_root
from ..sources.store import Store
from . import carriers as c
from .registry import query

WITH = f"WITH {c.FILES}, {c.PRIOR} "

# ---------------------------------------------------------------- scans


@query("s01_skip_rules", "WITH p AS (SELECT page_id, CASE page_id % 7 WHEN 0 THEN '.git/' WHEN 1 THEN 'venv/' ELSE 'data/' END || replace(url, '://', '/') || CASE page_id % 5 WHEN 0 THEN '.tmp' WHEN 1 THEN '/~$book.xlsx' WHEN 2 THEN '/.DS_Store' ELSE '/a.txt' END AS rel_path FROM pages), q AS (SELECT page_id, rel_path, string_split(rel_path, '/') AS s FROM p) SELECT page_id, rel_path FROM q WHERE NOT list_bool_or(list_transform(s[:-2], lambda x: x IN ('venv', '__pycache__', 'node_modules', 'env') OR starts_with(x, '.'))) AND NOT (starts_with(s[-1], '.') OR starts_with(s[-1], '~$') OR ends_with(s[-1], '.tmp') OR ends_with(s[-1], '.swp') OR s[-1] IN ('Thumbs.db', 'desktop.ini', 'ehthumbs.db'))")
def _(spark, sf):
    i = F.col("page_id")
    head = F.when(i % 7 == 0, ".git/").when(i % 7 == 1, "venv/").otherwise("data/")
    tail = F.when(i % 5 == 0, ".tmp").when(i % 5 == 1, "/~$book.xlsx").when(i % 5 == 2, "/.DS_Store").otherwise("/a.txt")
    p = c.read(spark, sf, "pages").select("page_id", F.concat(head, F.replace("url", F.lit("://"), F.lit("/")), tail).alias("rel_path"))
    return p.where(files_source.is_wanted(F.col("rel_path")))


query("s02_content_hash", "SELECT doc_id, sha256(text) AS sha256 FROM documents")(lambda s, d: files_source.with_sha256(c.read(s, d, "documents"), "text").select("doc_id", "sha256"))
query("s03_changed_files", WITH + ", snap AS (SELECT path, size_bytes, doc_id % 13 AS mtime FROM files WHERE doc_id % 2 = 0) SELECT f.path, f.size_bytes, CAST(f.doc_id % 11 AS BIGINT) AS mtime FROM files f WHERE NOT EXISTS (SELECT 1 FROM snap s WHERE s.path = f.path AND s.size_bytes = f.size_bytes AND s.mtime = f.doc_id % 11)")(
    lambda s, d: files_source.changed(c.files(s, d).select("path", "size_bytes", (F.col("doc_id") % 11).alias("mtime")), c.files(s, d).where("doc_id % 2 = 0").select("path", "size_bytes", (F.col("doc_id") % 13).alias("mtime"))).select("path", "size_bytes", "mtime")
)
query("s04_lines", "SELECT doc_id, CAST(t.i AS INTEGER) AS line_no, l[t.i] AS value FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), unnest(range(1, len(l) + 1)) AS t(i)")(lambda s, d: files_source.read_lines(c.read(s, d, "documents"), "doc_id", "text"))
query("s05_xml_scan", "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages")(lambda s, d: c.read(s, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title")))
query("s07_arrays_of_one", f"WITH {c.CURVES} SELECT * FROM curves WHERE measurement_id = 11")(lambda s, d: c.curves(s, d).where("measurement_id = 11"))


@query("s09_delete_arrays", f"WITH {c.CURVES} SELECT measurement_id, count(*) AS n FROM curves WHERE measurement_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY measurement_id")
def _(spark, sf):
    """Stored points without some measurements, deleted twice."""
    a, b, twice = (f"{shared_root(spark)}/{what}-{uuid.uuid4().hex}" for what in ("points", "left", "left"))
    catalog.save_points(c.curves(spark, sf).withColumn("technique", F.when(F.col("measurement_id") % 2 == 0, "xrd").otherwise("xps")), a, 8)
    gone = c.read(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("measurement_id"))
    catalog.delete_points(spark, a, gone, b)
    catalog.delete_points(spark, b, gone, twice)
    return spark.read.parquet(twice).groupBy("measurement_id").agg(F.count(F.lit(1)).alias("n"))


@query("s05_xml_scan_points", "SELECT CAST(vec_id AS VARCHAR) AS path, CAST(t.i AS INTEGER) AS idx, round(5.0 + t.i * (label + 1) / 63.0, 9) AS x, CAST(embedding[t.i + 1] AS DOUBLE) AS y FROM embeddings, unnest(range(0, 64)) AS t(i)")
def _(spark, sf):
    """Diffraction scans written as XML files, read back by the XML reader and parsed into points."""
    e = c.read(spark, sf, "embeddings")
    axis = lambda name, low, high: F.struct(F.lit(name).alias("_axis"), low.alias("startPosition"), high.cast("double").alias("endPosition"))
    positions = F.array(axis("Omega", F.lit(0.0), F.lit(1.0)), axis("2Theta", F.lit(5.0), F.lit(6.0) + F.col("label")))
    counts = F.struct(F.array_join(F.transform("embedding", lambda v: v.cast("double").cast("string")), " ").alias("_VALUE"), F.lit("counts").alias("_unit"))
    path = f"{shared_root(spark)}/scans-{uuid.uuid4().hex}"
    scans = e.select(F.col("vec_id").cast("string").alias("_appendNumber"), F.struct(positions.alias("positions"), counts.alias("counts")).alias("dataPoints"))
    scans.write.format("xml").option("rowTag", "scan").option("rootTag", "xrdMeasurement").save(path)
    scans = files_source.read_diffraction_xml(spark, path)
    return parsing.diffraction_points(scans.withColumn("path", F.col("_appendNumber"))).withColumn("x", F.round("x", 9))


query("s11_derived_curve", f"WITH {c.CURVES} SELECT measurement_id, idx, 'scaled' AS name, y * 2 AS value FROM curves WHERE measurement_id = 3")(lambda s, d: catalog.derived_of(c.curves(s, d).select(F.col("measurement_id").alias("result_id"), "idx", F.lit("scaled").alias("name"), (F.col("y") * 2).alias("value")), 3).withColumnRenamed("result_id", "measurement_id"))


@query("s08_append_points", f"WITH {c.SCANS} SELECT technique, count(*) AS n, round(sum(y), 4) AS total FROM scans GROUP BY technique")
def _(spark, sf):
    from ..sources.durable import written

    p = written(c.scans(spark, sf).select("measurement_id", "idx", "x", "y", "technique"), "points")
    return p.groupBy("technique").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("y"), 4).alias("total"))


@query("s12_replace_project", WITH + "SELECT doc_id, project_id, '2' AS run FROM files WHERE project_id = 'src1' UNION ALL SELECT doc_id, project_id, '1' FROM files WHERE project_id <> 'src1'")
def _(spark, sf):
    """All projects saved, then one of them saved again: its partition alone is replaced."""
    path = f"{shared_root(spark)}/projects-{uuid.uuid4().hex}"
    f = c.files(spark, sf).select("doc_id", "project_id")
    catalog.save_project(f.withColumn("run", F.lit("1")), path)
    catalog.save_project(f.where("project_id = 'src1'").withColumn("run", F.lit("2")), path)
    return spark.read.schema("doc_id long, run string, project_id string").parquet(path).select("doc_id", "project_id", "run")


@query("s13_nested_project", WITH + "SELECT project_id, count(DISTINCT sample_id) AS samples, count(*) AS measurements FROM files GROUP BY project_id")
def _(spark, sf):
    f = c.files(spark, sf).select("project_id", "sample_id", F.col("doc_id").alias("measurement_id"), "technique")
    n = catalog.nested_project(f.select("project_id", "sample_id").distinct(), f)
    return n.select("project_id", F.size("samples").cast("long").alias("samples"), F.aggregate("samples", F.lit(0), lambda a, x: a + F.size(x["measurements"])).cast("long").alias("measurements"))


query("s14_project_list", "SELECT DISTINCT source AS project_id, 'lake/' || source AS root FROM documents")(lambda s, d: reports.project_list(c.files(s, d), "lake/"))


@query("s15_delete_project", WITH + "SELECT 'measurements' AS part, count(*) AS n FROM files WHERE project_id <> 'src2' UNION ALL SELECT 'issues', count(*) FROM labels WHERE doc_id IN (SELECT doc_id FROM files WHERE project_id <> 'src2') UNION ALL SELECT 'projects', count(DISTINCT project_id) FROM files WHERE project_id <> 'src2'")
def _(spark, sf):
    f = c.files(spark, sf).select("project_id", F.concat_ws("/", "project_id", "sample_id").alias("sample_id"), F.col("doc_id").alias("measurement_id"))
    i = c.read(spark, sf, "labels").select(F.col("doc_id").alias("measurement_id"))
    left = catalog.delete_project({"projects": f.select("project_id").distinct(), "samples": f.select("project_id", "sample_id").distinct(), "measurements": f, "issues": i}, spark.createDataFrame([("src2",)], "project_id string"))
    return left["measurements"].agg(F.count(F.lit(1)).alias("n")).select(F.lit("measurements").alias("part"), "n").unionByName(left["issues"].agg(F.count(F.lit(1)).alias("n")).select(F.lit("issues").alias("part"), "n")).unionByName(left["projects"].agg(F.count(F.lit(1)).alias("n")).select(F.lit("projects").alias("part"), "n"))


query("s17_summary_json", "SELECT source AS project_id, '{\"project\":\"' || source || '\",\"files\":' || CAST(count(*) AS VARCHAR) || '}' AS js FROM documents GROUP BY source")(
    lambda s, d: reports.summary_json(c.files(s, d))
)

# ---------------------------------------------------------------- parsing

LINES = f"WITH {c.LINES} "
query("p01_header_pairs", LINES + "SELECT file_id, regexp_extract(value, '^;([\\w.]+)\\s*=\\s*(.*)$', 1) AS key, arg_max(trim(regexp_extract(value, '^;([\\w.]+)\\s*=\\s*(.*)$', 2)), line_no) AS value FROM lines WHERE regexp_matches(value, '^;([\\w.]+)\\s*=') GROUP BY 1, 2")(lambda s, d: parsing.header_pairs(c.lines(s, d)))
PAIRS = LINES + ", b AS (SELECT *, string_split_regex(trim(replace(value, chr(9), ' ')), '\\s+') AS p FROM lines WHERE NOT starts_with(value, ';')), pr AS (SELECT file_id, line_no, CASE WHEN TRY_CAST(p[1] AS DOUBLE) IS NOT NULL AND TRY_CAST(p[2] AS DOUBLE) IS NOT NULL THEN TRY_CAST(p[1] AS DOUBLE) END AS x, CASE WHEN TRY_CAST(p[1] AS DOUBLE) IS NOT NULL THEN TRY_CAST(p[2] AS DOUBLE) END AS y FROM b) "
query("p02_numeric_pairs", PAIRS + "SELECT file_id, CAST(row_number() OVER (PARTITION BY file_id ORDER BY line_no) - 1 AS INTEGER) AS idx, x, y FROM pr WHERE x IS NOT NULL")(lambda s, d: parsing.scan_points(parsing.pair_rows(c.lines(s, d))))


@query("p03_typed_header", LINES + "SELECT file_id, max(CASE WHEN starts_with(value, ';SampleName') THEN split_part(value, ' = ', 2) END) AS sample_name, max(CASE WHEN starts_with(value, ';KAlpha1') THEN CAST(split_part(value, ' = ', 2) AS DOUBLE) END) AS wavelength_ka1, CASE WHEN count(*) FILTER (starts_with(value, ';KAlpha1')) = 0 THEN ['KAlpha1'] ELSE CAST([] AS VARCHAR[]) END AS missing FROM lines WHERE starts_with(value, ';') GROUP BY file_id")
def _(spark, sf):
    return parsing.typed_header(parsing.header_map(parsing.header_pairs(c.lines(spark, sf)))).select("file_id", "sample_name", "wavelength_ka1", "missing")


query("p04_scan_quality", PAIRS + "SELECT file_id, count(x) AS n_points, count(*) - count(x) AS malformed, arg_min(x, line_no) FILTER (x IS NOT NULL) AS first_x, arg_max(x, line_no) FILTER (x IS NOT NULL) AS last_x, CASE WHEN count(x) = 0 THEN 'error' WHEN count(*) > count(x) THEN 'warning' ELSE 'ok' END AS state FROM pr GROUP BY file_id")(
    lambda s, d: parsing.scan_quality(parsing.pair_rows(c.lines(s, d))).drop("negative_share")
)
#: Whole curves: their running maximum, its negative, and the values themselves, in turn.
RUNS = f"WITH {c.CURVES}, runs AS (SELECT measurement_id, idx, CASE measurement_id % 3 WHEN 0 THEN max(y) OVER w WHEN 1 THEN -max(y) OVER w ELSE y END AS x FROM curves WINDOW w AS (PARTITION BY measurement_id ORDER BY idx)), l AS (SELECT measurement_id, x - lag(x) OVER (PARTITION BY measurement_id ORDER BY idx) AS dd FROM runs) "


@query("p05_monotonic", RUNS + "SELECT measurement_id, bool_and(coalesce(dd >= 0, true)) AS rising, bool_and(coalesce(dd <= 0, true)) AS falling FROM l GROUP BY measurement_id")
def _(spark, sf):
    top = F.max("y").over(Window.partitionBy("measurement_id").orderBy("idx"))
    turn = F.col("measurement_id") % 3
    return parsing.monotonic(c.curves(spark, sf).select("measurement_id", "idx", F.when(turn == 0, top).when(turn == 1, -top).otherwise(F.col("y")).alias("x")))


#: Whole axes: scans by time, by time run backwards, and by value, in turn; a scan may have any number of points.
AXES = f"WITH {c.SCANS}, axes AS (SELECT measurement_id, idx, CASE measurement_id % 3 WHEN 0 THEN us WHEN 1 THEN -us ELSE y END AS x FROM scans), l AS (SELECT measurement_id, x - lag(x) OVER (PARTITION BY measurement_id ORDER BY idx) AS dd FROM axes) "


@query("p05_monotonic_axis", AXES + "SELECT measurement_id, bool_and(coalesce(dd >= 0, true)) AS rising, bool_and(coalesce(dd <= 0, true)) AS falling FROM l GROUP BY measurement_id")
def _(spark, sf):
    turn = F.col("measurement_id") % 3
    us = F.col("us").cast("double")
    return parsing.monotonic(c.scans(spark, sf).select("measurement_id", "idx", F.when(turn == 0, us).when(turn == 1, -us).otherwise(F.col("y")).alias("x")))


def _regions(spark, sf):
    i = c.read(spark, sf, "lineitem")
    n = F.col("l_linenumber")
    v = F.when(n == 1, F.lit("Region data")).when(n == 2, F.concat(F.lit("C"), (F.col("l_orderkey") % 9).cast("string"), F.lit("s,"))).when(n == 5, F.lit("bad,row")).otherwise(F.concat(n.cast("string"), F.lit(".5,"), F.col("l_suppkey").cast("string")))
    return i.select(F.col("l_orderkey").alias("file_id"), n.cast("int").alias("line_no"), v.alias("value"))


query("p06_region_scan", "WITH v AS (SELECT l_orderkey AS file_id, CAST(l_linenumber AS INTEGER) AS line_no, CASE WHEN l_linenumber = 2 THEN 'C' || CAST(l_orderkey % 9 AS VARCHAR) || 's' END AS label, CASE WHEN l_linenumber NOT IN (1, 2, 5) THEN l_linenumber + 0.5 END AS x FROM lineitem), s AS (SELECT *, min(CASE WHEN x IS NOT NULL THEN line_no END) OVER (PARTITION BY file_id) AS data_start FROM v) SELECT file_id, data_start, arg_max(label, line_no) FILTER (label IS NOT NULL AND line_no <= data_start) AS label, count(x) AS n_points, count(*) FILTER (line_no >= data_start AND x IS NULL) AS malformed, CAST(arg_min(x, line_no) FILTER (x IS NOT NULL) AS DOUBLE) AS \"start\", CAST(arg_max(x, line_no) FILTER (x IS NOT NULL) AS DOUBLE) AS \"end\" FROM s WHERE data_start IS NOT NULL GROUP BY file_id, data_start")(
    lambda s, d: parsing.region_scan(_regions(s, d))
)


@query("p07_even_axis_points", "SELECT vec_id AS path, CAST(t.i AS INTEGER) AS idx, round(5.0 + t.i * (label + 1) / 63.0, 9) AS x, CAST(embedding[t.i + 1] AS DOUBLE) AS y FROM embeddings, unnest(range(0, 64)) AS t(i)")
def _(spark, sf):
    e = c.read(spark, sf, "embeddings")
    pos = F.array(F.struct(F.lit("2Theta").alias("_axis"), F.lit(5.0).alias("startPosition"), (F.lit(6.0) + F.col("label")).alias("endPosition")))
    text = F.array_join(F.transform("embedding", lambda v: v.cast("double").cast("string")), " ")
    scans = e.select(F.col("vec_id").alias("path"), F.struct(pos.alias("positions"), F.struct(text.alias("_VALUE")).alias("counts"), F.struct(F.lit(None).cast("string").alias("_VALUE")).alias("intensities")).alias("dataPoints"))
    return parsing.diffraction_points(scans).withColumn("x", F.round("x", 9))


@query("p08_calibrated_points", "SELECT vec_id AS path, CAST(t.i AS INTEGER) AS idx, round(-0.48 + t.i * 0.005, 9) AS x, CAST(embedding[t.i + 1] AS DOUBLE) AS y FROM embeddings, unnest(range(0, 64)) AS t(i)")
def _(spark, sf):
    e = c.read(spark, sf, "embeddings")
    s = e.select(F.col("vec_id").alias("path"), F.lit(-0.48).alias("calib_abs"), F.lit(0.005).alias("calib_lin"), F.array_join(F.transform("embedding", lambda v: v.cast("double").cast("string")), ",").alias("channels"))
    return parsing.spectrum_points(s).withColumn("x", F.round("x", 9))


CELLS = f"WITH {c.CELLS} "
query("p09_reflectance_sheets", CELLS + ", r AS (SELECT file_id, sheet, row_idx, max(num) FILTER (col_idx = 0) AS x, max(num) FILTER (col_idx = 1) AS y FROM cells GROUP BY ALL), g AS (SELECT *, coalesce(x BETWEEN 100 AND 2500 AND y IS NOT NULL, false) AS good FROM r), i AS (SELECT *, sum(CAST(good AS INT)) OVER (PARTITION BY file_id, sheet ORDER BY row_idx) > 0 AS inside FROM g) SELECT file_id, sheet, count(*) FILTER (good) AS n, count(*) FILTER (inside AND NOT good) AS malformed, min(x) FILTER (good) AS low, max(x) FILTER (good) AS high FROM i GROUP BY file_id, sheet HAVING count(*) FILTER (good) > 0")(
    lambda s, d: parsing.reflectance_sheets(c.cells(s, d))
)
query("p10_property_table", CELLS + ", w AS (SELECT file_id, sheet, row_idx, max(num) FILTER (col_idx = 0) AS temperature_k, max(num) FILTER (col_idx = 1) AS seebeck_uvk, max(num) FILTER (col_idx = 2) AS resistivity_ohm_m, max(num) FILTER (col_idx = 3) AS thermal_conductivity FROM cells WHERE row_idx > 0 GROUP BY ALL) SELECT w.* FROM w WHERE seebeck_uvk IS NOT NULL AND EXISTS (SELECT 1 FROM cells c WHERE c.file_id = w.file_id AND c.row_idx = 0)")(
    lambda s, d: parsing.property_rows(parsing.property_sheets(c.cells(s, d))).drop("power_factor", "zt")
)
LABELS_SQL = CELLS + ", h AS (SELECT file_id, min(row_idx) AS head FROM cells WHERE txt LIKE '%Mobility%' OR txt LIKE '%Resistivity%' GROUP BY file_id), b AS (SELECT c.file_id, h.head, min(row_idx) AS data FROM cells c JOIN h USING (file_id) WHERE row_idx > head GROUP BY c.file_id, h.head) SELECT t.file_id, regexp_replace(regexp_replace(lower(t.txt), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS key, v.num, t.txt AS label FROM b JOIN cells t ON t.file_id = b.file_id AND t.row_idx = b.head AND t.txt IS NOT NULL JOIN cells v ON v.file_id = b.file_id AND v.row_idx = b.data AND v.col_idx = t.col_idx"
query("p11_label_values", LABELS_SQL)(lambda s, d: parsing.label_values(c.cells(s, d), classify.HALL_WORDS))
query("j11_header_data_pairing", LABELS_SQL.replace("SELECT t.file_id, regexp", "SELECT t.file_id, t.col_idx, regexp"))(
    lambda s, d: parsing.label_columns(c.cells(s, d), classify.HALL_WORDS)
)


@query("p12_image_tags", "SELECT p_partkey AS file_id, p_brand || ' ' || p_type AS instrument, CAST('2025-04-28 11:21:11' AS TIMESTAMP) + INTERVAL 1 SECOND * (p_size % 40) AS measured_at FROM part")
def _(spark, sf):
    p = c.read(spark, sf, "part")
    when = F.concat(F.lit("2025:04:28 11:21:"), F.lpad((F.col("p_size") % 40 + 11).cast("string"), 2, "0"))
    tags = p.select(F.col("p_partkey").alias("file_id"), F.explode(F.array(F.struct(F.lit(271).alias("tag_no"), F.col("p_brand").alias("value")), F.struct(F.lit(272).alias("tag_no"), F.col("p_type").alias("value")), F.struct(F.lit(306).alias("tag_no"), when.alias("value")), F.struct(F.lit(999).alias("tag_no"), F.lit("x").alias("value")))).alias("t")).select("file_id", "t.tag_no", "t.value")
    return parsing.image_metadata(tags).select("file_id", "instrument", F.col("measured_at").cast("timestamp_ntz").alias("measured_at"))


query("p13_measurements_per_sheet", CELLS + "SELECT file_id, sheet, count(*) FILTER (num IS NOT NULL) AS numbers FROM cells GROUP BY file_id, sheet HAVING count(num) > 0")(
    lambda s, d: parsing.measurements_per_sheet(c.cells(s, d))
)


@query("p14_contract_violations", "SELECT user_id AS measurement_id, 'equal_length' AS rule FROM events GROUP BY user_id HAVING count(*) FILTER (event_type = 'view') <> count(*) FILTER (event_type = 'click') AND count(*) FILTER (event_type = 'view') > 0 AND count(*) FILTER (event_type = 'click') > 0 UNION ALL SELECT event_id, 'version' FROM events WHERE event_id % 50 = 0")
def _(spark, sf):
    e = c.read(spark, sf, "events")
    arrays = e.where("event_type in ('view', 'click')").groupBy(F.col("user_id").alias("measurement_id"), F.col("event_type").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    meta = e.select(F.col("event_id").alias("measurement_id"), F.when(F.col("event_id") % 50 == 0, "1.0").otherwise("1.0.0").alias("parser_version"), F.lit("xrd-text").alias("parser_name"), F.col("props").alias("metadata"))
    return parsing.contract_violations(arrays, meta)


# ---------------------------------------------------------------- classification

query("c01_extension", "SELECT page_id, lower(regexp_extract(url, '(\\.[^./]+)$', 1)) AS ext FROM pages")(lambda s, d: c.read(s, d, "pages").select("page_id", classify.extension(F.col("url")).alias("ext")))
query("c02_keyed_text_score", LINES + ", t AS (SELECT file_id, string_agg(value, chr(10) ORDER BY line_no) AS v FROM lines GROUP BY file_id) SELECT file_id, CASE CAST(contains(v, ';SampleName') AS INT) + CAST(contains(v, ';KAlpha1') AS INT) WHEN 2 THEN 1.0 WHEN 1 THEN 0.7 ELSE 0.0 END::DOUBLE AS score FROM t")(
    lambda s, d: _texts(c.lines(s, d)).select("file_id", classify.score_keyed_text(F.col("v")).alias("score"))
)


def _texts(lines):
    parts = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "value"))), lambda x: x["value"])
    return lines.groupBy("file_id").agg(F.array_join(parts, "\n").alias("v"))


#: Whole files, a third of which have pairs in place of their two header lines.
PAIRED = LINES + ", whole AS (SELECT file_id, line_no, CASE WHEN file_id % 3 = 0 AND line_no <= 2 THEN '7 8' ELSE value END AS value FROM lines)"
GOODS = ", g AS (SELECT file_id, line_no, TRY_CAST(string_split_regex(trim(replace(value, chr(9), ' ')), '\\s+')[1] AS DOUBLE) IS NOT NULL AND TRY_CAST(string_split_regex(trim(replace(value, chr(9), ' ')), '\\s+')[2] AS DOUBLE) IS NOT NULL AS ok FROM whole) "


def _whole(spark, sf):
    head = (F.col("file_id") % 3 == 0) & (F.col("line_no") <= 2)
    return _texts(c.lines(spark, sf).withColumn("value", F.when(head, "7 8").otherwise(F.col("value"))))


query("c03_pair_score", PAIRED + GOODS + "SELECT file_id, CASE WHEN count(*) FILTER (ok) = count(*) THEN 1.0 WHEN count(*) FILTER (ok) = count(*) - 1 AND count(*) FILTER (ok) >= 1 THEN 0.7 ELSE 0.0 END::DOUBLE AS score FROM g WHERE line_no <= 5 GROUP BY file_id")(
    lambda s, d: _whole(s, d).select("file_id", classify.score_pairs(F.col("v")).alias("score"))
)
query("c04_run_score", PAIRED + GOODS + ", r AS (SELECT file_id, ok, line_no - row_number() OVER (PARTITION BY file_id, ok ORDER BY line_no) AS k FROM g WHERE line_no <= 20), n AS (SELECT file_id, count(*) AS n FROM r WHERE ok GROUP BY file_id, k) SELECT f.file_id, CASE WHEN coalesce(max(n.n), 0) >= 3 THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM (SELECT DISTINCT file_id FROM g) f LEFT JOIN n USING (file_id) GROUP BY f.file_id")(
    lambda s, d: _whole(s, d).select("file_id", classify.score_run_of_pairs(F.col("v"), classify.PAIR).alias("score"))
)
query("c05_two_signatures", "SELECT page_id, CASE WHEN contains(left(html, 2048), '<article>') AND contains(left(html, 2048), 'lang=\"en\"') THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM pages")(lambda s, d: c.read(s, d, "pages").select("page_id", classify.score_contains(F.col("html"), ("<article>", 'lang="en"'), 2048).alias("score")))
query("c06_root_tag", "SELECT page_id, CASE WHEN contains(left(html, 512), '<nav>') THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM pages")(lambda s, d: c.read(s, d, "pages").select("page_id", classify.score_contains(F.col("html"), ("<nav>",), 512).alias("score")))
query("c07_magic_bytes", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM documents")(
    lambda s, d: c.read(s, d, "documents").select("doc_id", classify.score_tiff(F.concat(F.when(F.col("doc_id") % 3 == 0, F.unhex(F.lit("49492A00"))).otherwise(F.unhex(F.lit("FFD8FFE0"))), F.col("text").cast("binary"))).alias("score"))
)
query("c08_reflectance_score", CELLS + ", r AS (SELECT file_id, sheet, row_idx, max(num) FILTER (col_idx = 0) AS x, max(num) FILTER (col_idx = 1) AS y FROM cells WHERE row_idx < 20 GROUP BY ALL) SELECT file_id, CASE WHEN count(*) FILTER (x BETWEEN 100 AND 2500 AND y IS NOT NULL) >= 3 THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM r GROUP BY file_id")(lambda s, d: classify.score_reflectance(c.cells(s, d)))
query("c09_property_score", CELLS + "SELECT file_id, 1.0::DOUBLE AS score FROM cells WHERE row_idx = 0 GROUP BY file_id UNION ALL SELECT file_id, 0.0 FROM cells WHERE txt IS NOT NULL GROUP BY file_id HAVING min(row_idx) > 0")(lambda s, d: classify.score_row_words(c.cells(s, d), ("temperature", "seebeck")))
query("c10_hall_score", CELLS + "SELECT file_id, max(CASE WHEN txt LIKE '%Mobility%' OR txt LIKE '%Resistivity%' THEN 1.0 ELSE 0.0 END)::DOUBLE AS score FROM cells GROUP BY file_id")(lambda s, d: classify.score_any_word(c.cells(s, d)))

SCORES_SQL = "scores AS (SELECT doc_id AS path, 'a' AS parser, 0 AS priority, (doc_id % 4) / 4.0::DOUBLE AS score FROM documents UNION ALL SELECT doc_id, 'b', 1, (doc_id % 3) / 3.0::DOUBLE FROM documents UNION ALL SELECT doc_id, 'c', 2, (doc_id % 4) / 4.0::DOUBLE FROM documents)"


def _scores(spark, sf):
    d = c.read(spark, sf, "documents").select(F.col("doc_id").alias("path"))
    one = lambda p, k, n: d.select("path", F.lit(p).alias("parser"), F.lit(k).alias("priority"), (F.col("path") % n / float(n)).alias("score"))
    return one("a", 0, 4).unionByName(one("b", 1, 3)).unionByName(one("c", 2, 4))


BEST_SQL = f"WITH {SCORES_SQL}, b AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY score DESC, priority) AS r FROM scores WHERE score > 0) "
query("c11_best_parser", BEST_SQL + "SELECT path, parser, priority, score FROM b WHERE r = 1")(lambda s, d: classify.best_parser(_scores(s, d)))
query("c12_threshold_states", BEST_SQL + "SELECT path, parser, CASE WHEN score >= 0.5 THEN 'classified' ELSE 'unclassified' END AS state FROM b WHERE r = 1")(lambda s, d: classify.classified(classify.best_parser(_scores(s, d))).select("path", "parser", "state"))
query("c14_microscopy_technique", WITH + "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN CASE doc_id % 3 WHEN 0 THEN 'tem' WHEN 1 THEN 'sem' ELSE 'stem' END ELSE 'xrd' END AS technique FROM files")(
    lambda s, d: c.files(s, d).select("doc_id", classify.microscopy_technique(F.concat(F.when(F.col("doc_id") % 3 == 0, "a/HR-TEM/").when(F.col("doc_id") % 3 == 1, "a/other/").otherwise("STEM/b/c/"), F.lit("x.tif")), F.when(F.col("doc_id") % 2 == 0, "sem").otherwise("xrd")).alias("technique"))
)
query("c15_sample_name", WITH + "SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN 'Sheet1' WHEN doc_id % 3 = 2 THEN 'CS-' || CAST(doc_id % 11 AS VARCHAR) ELSE project_id END AS sample FROM files")(
    lambda s, d: c.files(s, d).select("doc_id", classify.sample_name(F.col("rel_path"), F.when(F.col("doc_id") % 17 == 0, "Sheet1"), N.stem(F.col("rel_path"))).alias("sample"))
)
query("c16_generic_folders", "SELECT doc_id, lower(f) IN ('xrd', 'raw data') AS generic FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'XRD' WHEN 1 THEN 'Raw Data' ELSE 'CS 1' END AS f FROM documents)")(
    lambda s, d: c.read(s, d, "documents").select("doc_id", classify.is_generic(F.when(F.col("doc_id") % 3 == 0, " XRD ").when(F.col("doc_id") % 3 == 1, "Raw   Data").otherwise("CS 1")).alias("generic"))
)

# ---------------------------------------------------------------- joins

query("j01_cache_hits", WITH + "SELECT f.doc_id, EXISTS (SELECT 1 FROM prior p WHERE p.sha256 = f.sha256 AND p.parser_version = f.parser_version) AS cached FROM files f")(lambda s, d: catalog.cache_hits(c.files(s, d), c.prior(s, d)).select("doc_id", "cached"))
query("j02_needs_parse", WITH + "SELECT f.doc_id FROM files f WHERE NOT EXISTS (SELECT 1 FROM prior p WHERE p.sha256 = f.sha256 AND p.parser_version = f.parser_version)")(lambda s, d: catalog.needs_parse(c.files(s, d), c.prior(s, d)).select("doc_id"))
query("j03_superseded", WITH + "SELECT doc_id FROM prior WHERE sha256 NOT IN (SELECT f.sha256 FROM files f WHERE NOT EXISTS (SELECT 1 FROM prior p WHERE p.sha256 = f.sha256 AND p.parser_version = f.parser_version))")(lambda s, d: catalog.superseded(c.prior(s, d), catalog.needs_parse(c.files(s, d), c.prior(s, d))).select("doc_id"))
query("j04_navigation", WITH + f", {c.ISSUES} SELECT f.project_id, f.sample_id, count(DISTINCT f.doc_id) AS measurements, count(i.severity) AS issues FROM files f LEFT JOIN issues i ON i.measurement_id = f.doc_id GROUP BY f.project_id, f.sample_id")(
    lambda s, d: reports.project_counts(c.files(s, d), c.issues(s, d).withColumnRenamed("measurement_id", "doc_id"), "doc_id")
)
query("j05_orphans", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")(lambda s, d: catalog.orphans(c.read(s, d, "orders").select("o_orderkey"), c.read(s, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey"))
query("j07_applicable_analyzers", WITH + "SELECT doc_id, a.analyzer FROM files JOIN (VALUES ('uv_drs', 'band-gap'), ('xrd', 'peak-table'), ('xrd', 'phase-match')) AS a(technique, analyzer) USING (technique)")(
    lambda s, d: reports.applicable(c.files(s, d), s.createDataFrame([("uv_drs", "band-gap"), ("xrd", "peak-table"), ("xrd", "phase-match")], "technique string, analyzer string")).select("doc_id", "analyzer")
)


RESULTS_SQL = "wanted AS (SELECT user_id AS measurement_id, event_type AS analyzer_name, left(sha256(props), 16) AS params_fp, CAST(event_id % 3 AS VARCHAR) AS analyzer_version, event_id FROM events), stored AS (SELECT * FROM wanted WHERE event_id % 2 = 0)"


def _results(spark, sf):
    w = c.read(spark, sf, "events").select(F.col("user_id").alias("measurement_id"), F.col("event_type").alias("analyzer_name"), F.left(F.sha2("props", 256), F.lit(16)).alias("params_fp"), (F.col("event_id") % 3).cast("string").alias("analyzer_version"), "event_id")
    return w, w.where("event_id % 2 = 0")


query("j08_result_misses", f"WITH {RESULTS_SQL} SELECT event_id FROM wanted w WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.measurement_id = w.measurement_id AND s.analyzer_name = w.analyzer_name AND s.params_fp = w.params_fp AND s.analyzer_version = w.analyzer_version)")(lambda s, d: catalog.result_misses(*_results(s, d)).select("event_id"))
query("j09_replace_results", f"WITH {RESULTS_SQL}, new AS (SELECT * FROM wanted WHERE event_id % 5 = 0) SELECT event_id FROM stored s WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.measurement_id = s.measurement_id AND n.analyzer_name = s.analyzer_name AND n.params_fp = s.params_fp) UNION ALL SELECT event_id FROM new")(
    lambda s, d: catalog.replace_results(_results(s, d)[1], _results(s, d)[0].where("event_id % 5 = 0")).select("event_id")
)
query("j10_unassigned_files", WITH + "SELECT doc_id FROM files WHERE doc_id NOT IN (SELECT doc_id FROM labels)")(lambda s, d: catalog.unassigned(c.files(s, d), c.read(s, d, "labels"), "doc_id").select("doc_id"))


@query("w06_inside_block", f"WITH {c.SCANS} SELECT measurement_id, idx FROM (SELECT *, sum(CASE WHEN y > 50 THEN 1 ELSE 0 END) OVER (PARTITION BY measurement_id ORDER BY idx) AS k FROM scans) WHERE k > 0")
def _(spark, sf):
    return parsing.inside_block(c.scans(spark, sf), F.col("y") > 50, "measurement_id", "idx").select("measurement_id", "idx")


@query("a12_cached_analysis")
def _(spark, sf):
    """Line fits of the scans whose technique and parameters have no stored result yet."""
    wanted, stored = _results(spark, sf)
    todo = catalog.result_misses(wanted, stored).select("measurement_id").distinct()
    pts = c.scans(spark, sf).join(todo, "measurement_id", "left_semi")
    return curves.line_fit(pts, "x", "y").select("measurement_id", F.round("r2", 6).alias("r2"), "n")


query("s06_comma_rows", "SELECT p_partkey, string_split(p_brand || ',' || p_type || ',' || CAST(p_size AS VARCHAR), ',') AS cells FROM part")(
    lambda s, d: parsing.comma_rows(files_source.read_lines(c.read(s, d, "part").select("p_partkey", F.concat_ws(",", "p_brand", "p_type", F.col("p_size").cast("string")).alias("content")), "p_partkey"), "p_partkey").drop("line_no")
)


@query("s10_derived_curves", f"WITH {c.CURVES} SELECT analyzer_name, count(*) AS n, round(sum(y * k), 4) AS total FROM curves, (VALUES ('half', 0.5::DOUBLE), ('double', 2.0::DOUBLE)) AS a(analyzer_name, k) GROUP BY analyzer_name")
def _(spark, sf):
    """Derived curves of two analyzers, appended under the analyzer's name and read back."""
    path = f"{shared_root(spark)}/derived-{uuid.uuid4().hex}"
    for name, k in (("half", 0.5), ("double", 2.0)):
        d = c.curves(spark, sf).select(F.concat_ws(":", "measurement_id", F.lit(name)).alias("result_id"), "idx", F.lit("scaled").alias("name"), (F.col("y") * k).alias("value"), F.lit(name).alias("analyzer_name"))
        catalog.save_derived(d, path)
    return spark.read.parquet(path).groupBy("analyzer_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("s16_override_document", "SELECT DISTINCT p_brand AS auto, 'renamed ' || p_brand AS new FROM part")
def _(spark, sf):
    """Renames of brands written as a JSON document and read back as a table; there are as many as brands and types."""
    path = f"{shared_root(spark)}/decisions-{uuid.uuid4().hex}"
    p = c.read(spark, sf, "part")
    renames = p.select(F.col("p_brand").alias("auto"), F.concat(F.lit("renamed "), "p_brand").alias("new")).distinct()
    merges = p.select((F.col("p_size") % 3).alias("group_id"), F.col("p_size").alias("pos"), F.col("p_type").alias("name")).groupBy("group_id", "name").agg(F.min("pos").alias("pos"))
    splits = p.groupBy(F.col("p_brand").alias("source"), F.col("p_type").alias("path")).agg(F.max("p_type").alias("target"))
    catalog.write_decisions(renames, merges, splits, path)
    return catalog.read_decisions(spark, path)["renames"]


@query("s16_override_tables", "SELECT p_brand AS source, CAST(p_partkey AS VARCHAR) AS path, p_type AS target FROM part")
def _(spark, sf):
    """A split of every part, kept as JSON lines."""
    path = f"{shared_root(spark)}/decisions-{uuid.uuid4().hex}"
    p = c.read(spark, sf, "part")
    splits = p.select(F.col("p_brand").alias("source"), F.col("p_partkey").cast("string").alias("path"), F.col("p_type").alias("target"))
    renames = p.select(F.col("p_brand").alias("auto"), F.concat(F.lit("renamed "), "p_brand").alias("new")).distinct()
    merges = p.select(F.col("p_size").cast("long").alias("group_id"), F.lit(0).alias("pos"), F.col("p_type").alias("name")).distinct()
    catalog.save_decisions(renames, merges, splits, path)
    return catalog.load_decisions(spark, path)["splits"]


# ---------------------------------------------------------------- folders end to end

VECTORS = "v AS (SELECT vec_id, 'lake/src' || CAST(vec_id % 3 AS VARCHAR) || '/XRD/scan ' || CAST(vec_id AS VARCHAR) || (['.txt', '.txt', '.asc', '.csv', '.xrdml', '.txt', '.txt', '.txt'])[vec_id % 8 + 1] AS path, vec_id % 8 AS kind, vec_id // 8 % 3 = 0 AS old FROM embeddings)"


def _ingested(spark, sf):
    """An ingest after one that had every third round of eight files."""
    files = c.instrument_files(spark, sf)
    before = files_source.with_sha256(files.where("floor(vec_id / 8) % 3 = 0")).select("sha256", F.lit("1.0.0").alias("parser_version"))
    return ingest.ingest(files, before)


query("e01_ingest_outcomes", f"WITH {VECTORS} SELECT path, CASE kind WHEN 2 THEN 'plain-scan-asc' WHEN 3 THEN 'region-csv' WHEN 4 THEN 'diffraction-xml' WHEN 5 THEN NULL WHEN 7 THEN NULL ELSE 'keyed-scan-txt' END AS parser_name, CASE WHEN kind = 7 THEN 'hash_failed' WHEN kind = 5 THEN 'unclassified' WHEN old OR (kind = 6 AND false) THEN 'cached' WHEN kind = 6 THEN 'parsed_with_issues' ELSE 'parsed' END AS outcome FROM v")(
    lambda s, d: _ingested(s, d).outcomes.select("path", "parser_name", "outcome")
)


@query("e01_ingest_points", f"WITH {VECTORS} SELECT path, 'src' || CAST(vec_id % 3 AS VARCHAR) AS sample, CASE WHEN kind = 3 THEN 'xps' ELSE 'xrd' END AS technique, CAST(CASE WHEN kind = 6 THEN 0 ELSE 64 END AS BIGINT) AS n, CASE WHEN kind <> 6 THEN 5.0::DOUBLE END AS low, CASE WHEN kind <> 6 THEN 11.3::DOUBLE END AS high FROM v WHERE kind NOT IN (5, 7) AND NOT old")
def _(spark, sf):
    got = _ingested(spark, sf)
    ends = got.points.groupBy("measurement_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("x"), 6).alias("low"), F.round(F.max("x"), 6).alias("high"))
    return got.measurements.join(ends, "measurement_id", "left").select("path", "sample", "technique", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "low", "high")


@query("e01_ingest_issues", f"WITH {VECTORS}, s AS (SELECT vec_id, count(*) FILTER (x < 0) / 64.0 AS share FROM (SELECT vec_id, unnest(embedding) AS x FROM embeddings) GROUP BY vec_id), f AS (SELECT * FROM v JOIN s USING (vec_id) WHERE NOT old) SELECT path, 'data' AS field, 'warning' AS severity FROM f WHERE kind = 1 UNION ALL SELECT path, 'data', 'error' FROM f WHERE kind = 6 UNION ALL SELECT path, 'measured_at', 'warning' FROM f WHERE kind = 4 UNION ALL SELECT path, 'y', 'warning' FROM f WHERE kind = 2 AND share >= 0.1")
def _(spark, sf):
    got = _ingested(spark, sf)
    return got.issues.join(got.measurements.select("measurement_id", "path"), "measurement_id").select("path", "field", "severity")


# ---------------------------------------------------------------- spectra in XML


def _spectrum_files(spark, sf):
    """A spectrum file in windows-1252 for each vector: nested, in a namespace, with a comment that looks like channels and a list that ends with a comma.

    Of the ids every seventh file breaks off, every fifth has no calibration, every eleventh a channel that is no number, every third a date
    that can't be read.
    """
    e, k = c.read(spark, sf, "embeddings"), F.col("vec_id")
    calibration = F.when(k % 5 == 0, F.lit("")).otherwise("<CalibAbs> -4.8E-1 </CalibAbs><CalibLin>5E-3</CalibLin>")
    channels = F.array_join(F.transform("embedding", lambda v: v.cast("double").cast("string")), ",\n ")
    text = F.concat(
        F.lit('<?xml version="1.0" encoding="WINDOWS-1252"?>\n<TRTSpectrum xmlns="urn:spectra"><!-- <Channels>9,9</Channels> --><ClassInstance Name="Probe \u00e9\u0080 '), k.cast("string"),
        F.lit('"><Header><Date>'), F.when(k % 3 == 0, F.lit("soon")).otherwise("2.12.2022"), F.lit("</Date><Time>8:0:24</Time><ChannelCount>64</ChannelCount>"), calibration,
        F.lit("</Header><Channels/><Channels>"), channels, F.when(k % 11 == 0, F.lit(",x")).otherwise(","), F.lit("</Channels>"), F.when(k % 7 == 0, F.lit("<Open>")).otherwise("</ClassInstance></TRTSpectrum>"),
    )
    path = F.concat(F.lit("lake/spectra/"), k.cast("string"), F.lit(".spx"))
    return e.select(path.alias("path"), path.alias("rel_path"), F.encode(text, "ISO-8859-1").alias("content"))  # U+0080 becomes the byte 0x80


SPECTRUM_FILES = """WITH f AS (SELECT vec_id, 'lake/spectra/' || vec_id || '.spx' AS path, vec_id % 7 = 0 AS broken, vec_id % 11 = 0 AS bad, vec_id % 5 = 0 AS bare, vec_id % 3 = 0 AS undated, embedding FROM embeddings) """


@query("s05_spectrum_files", SPECTRUM_FILES + """SELECT path, CASE WHEN broken OR bad THEN 'parsed_with_issues' ELSE 'parsed' END AS outcome, CASE WHEN NOT broken THEN 'Probe \u00e9\u20ac ' || vec_id END AS name,
  NOT broken AND NOT undated AS dated, CASE WHEN broken OR bad THEN 0 ELSE 64 END AS n, CASE WHEN NOT broken AND NOT bad THEN round(list_sum(list_transform(range(0, 64), lambda i: (CASE WHEN bare THEN i ELSE -0.48::DOUBLE + i * 0.005::DOUBLE END) * CAST(embedding[i + 1] AS DOUBLE))), 4) END AS moment,
  CASE WHEN broken THEN ['xml error'] WHEN bad THEN ['data error', 'measured_at warning'] WHEN bare THEN ['measured_at warning', 'x warning'] ELSE ['measured_at warning'] END AS issues FROM f""")
def _(spark, sf):
    """Spectrum files through the whole ingest: what became of each, its name, points and findings."""
    got = ingest.ingest(_spectrum_files(spark, sf))
    m = "measurement_id"
    sums = got.points.groupBy(m).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("x") * F.col("y")), 4).alias("moment"))
    found = got.issues.groupBy(m).agg(F.array_sort(F.collect_list(F.concat_ws(" ", "field", "severity"))).alias("issues"))
    rows = got.measurements.join(got.outcomes.select("path", "outcome"), "path").join(sums, m, "left").join(found, m, "left")
    return rows.select("path", "outcome", F.try_element_at("metadata", F.lit("spectrum_name")).alias("name"), F.col("measured_at").isNotNull().alias("dated"), F.coalesce("n", F.lit(0)).cast("int").alias("n"), "moment", "issues")


# ---------------------------------------------------------------- staged workbooks and images

BOOKS = f"WITH {c.WORKBOOKS} "


def _workbooks(spark, sf):
    files, cells = c.workbooks(spark, sf)
    return ingest.ingest(files, cells=cells)


query("e01_workbook_outcomes", BOOKS + "SELECT path, CASE WHEN kind = 0 AND wavelengths >= 3 THEN 'reflectance-cells-xlsx' WHEN kind = 1 AND last_row >= 0 THEN 'property-cells-xlsx' WHEN kind = 2 AND last_row >= 0 THEN 'hall-cells-xls' END AS parser_name, CASE WHEN kind = 0 THEN CASE WHEN wavelengths >= 3 THEN 'parsed' ELSE 'unclassified' END WHEN last_row < 0 THEN 'unclassified' WHEN kind = 1 THEN CASE WHEN properties = 0 THEN 'parsed_with_issues' ELSE 'parsed' END WHEN last_row = 0 THEN 'parsed_with_issues' ELSE 'parsed' END AS outcome FROM books")(
    lambda s, d: _workbooks(s, d).outcomes.select("path", "parser_name", "outcome")
)


@query("e01_workbook_sheets", BOOKS + ", m AS (SELECT b.path, g.sheet, 'uv_drs' AS technique, count(*) AS n, min(x) AS low, max(x) AS high FROM books b JOIN good g USING (file_id) WHERE b.kind = 0 AND b.wavelengths >= 3 AND g.good GROUP BY ALL UNION ALL SELECT b.path, CASE WHEN b.file_id % 3 = 0 THEN 'A' ELSE 'B' END, 'thermoelectric', b.properties, min(x) FILTER (y IS NOT NULL AND row_idx > 0), max(x) FILTER (y IS NOT NULL AND row_idx > 0) FROM books b JOIN good g USING (file_id) WHERE b.kind = 1 AND g.sheet_idx = 0 GROUP BY b.path, b.file_id, b.properties UNION ALL SELECT path, 'book ' || CAST(file_id AS VARCHAR), 'hall', 0, NULL, NULL FROM books WHERE kind = 2 AND last_row >= 0) SELECT path, CASE WHEN technique = 'hall' THEN NULL ELSE sheet END AS sheet, technique, n, low, high FROM m")
def _(spark, sf):
    """Every sheet that holds data is a measurement."""
    got = _workbooks(spark, sf)
    ends = got.points.groupBy("measurement_id").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
    return got.measurements.join(ends, "measurement_id", "left").select("path", F.col("part").alias("sheet"), "technique", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "low", "high")


@query("e01_workbook_issues", BOOKS + "SELECT path, sheet, 'data' AS field, 'warning' AS severity FROM (SELECT b.path, g.sheet, min(row_idx) FILTER (good) AS start, max(row_idx) FILTER (NOT good AND row_idx > 0) AS last_bad FROM books b JOIN good g USING (file_id) WHERE b.kind = 0 AND b.wavelengths >= 3 GROUP BY ALL) WHERE start < last_bad UNION ALL SELECT path, 'B', 'data', 'error' FROM books WHERE kind = 1 AND last_row >= 0 AND properties = 0 UNION ALL SELECT path, NULL, 'data', 'error' FROM books WHERE kind = 2 AND last_row = 0")
def _(spark, sf):
    got = _workbooks(spark, sf)
    return got.issues.join(got.measurements.select("measurement_id", "path", F.col("part").alias("sheet")), "measurement_id").select("path", "sheet", "field", "severity")


@query("e01_workbook_arrays", BOOKS + ", v AS (SELECT p.path, c.* FROM books p JOIN cells c USING (file_id) WHERE p.kind = 1 AND c.row_idx > 0 AND NOT EXISTS (SELECT 1 FROM wide w WHERE w.file_id = c.file_id AND w.row_idx = c.row_idx AND w.y IS NULL)) SELECT path, (['temperature_k', 'seebeck_uvk', 'resistivity_ohm_m', 'thermal_conductivity'])[col_idx + 1] AS name, count(*) AS n, round(sum(num), 4) AS total FROM v WHERE col_idx < 4 GROUP BY ALL")
def _(spark, sf):
    got = _workbooks(spark, sf)
    sums = got.arrays.groupBy("measurement_id", "name").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    named = sums.join(got.measurements.where("technique = 'thermoelectric'").select("measurement_id", "path"), "measurement_id")
    return named.groupBy("path", "name").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 4).alias("total"))


@query("e01_workbook_labels", BOOKS + "SELECT b.path, regexp_replace(regexp_replace(lower(h.txt), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS key, h.txt AS label, v.num FROM books b JOIN cells h USING (file_id) LEFT JOIN cells v ON v.file_id = b.file_id AND v.row_idx = 1 AND v.col_idx = h.col_idx WHERE b.kind = 2 AND b.last_row > 0 AND h.row_idx = 0")
def _(spark, sf):
    """Labels and values of Hall books, from the metadata of their measurements."""
    m = _workbooks(spark, sf).measurements.where("technique = 'hall'").select("path", "metadata", F.explode("metadata").alias("key", "label")).where(F.col("key").endswith("__label"))
    key = F.regexp_replace("key", "__label$", "")
    return m.select("path", key.alias("key"), "label", F.try_element_at("metadata", key).cast("double").alias("num"))


IMAGES = "WITH i AS (SELECT p_partkey AS k, 'lake/' || (['HR-TEM/', 'images/', 'STEM/'])[p_partkey % 3 + 1] || CAST(p_partkey AS VARCHAR) || '.tif' AS path, p_partkey % 4 = 3 AS other, p_partkey % 5 = 4 AS bare, * FROM part) "


@query("e01_image_facts", IMAGES + "SELECT path, (['tem', 'sem', 'stem'])[k % 3 + 1] AS technique, CASE WHEN bare THEN 'Microscopy (.tif)' WHEN k % 2 = 0 THEN p_brand || ' ' || p_type ELSE p_brand END AS instrument, CASE WHEN NOT bare AND p_size % 7 <> 0 THEN CAST('2025-04-28 11:21:11' AS TIMESTAMP) + INTERVAL 1 SECOND * (p_size % 40) END AS measured_at FROM i WHERE NOT other")
def _(spark, sf):
    files, tags = c.images(spark, sf)
    m = ingest.ingest(files, tags=tags).measurements
    return m.select("path", "technique", F.col("metadata")["instrument"].alias("instrument"), F.col("measured_at").cast("timestamp_ntz").alias("measured_at"))


@query("e01_image_issues", IMAGES + "SELECT path, CASE WHEN bare THEN 'data' WHEN p_size % 7 = 0 THEN 'datetime' ELSE 'measured_at' END AS field, CASE WHEN bare THEN 'error' ELSE 'warning' END AS severity FROM i WHERE NOT other")
def _(spark, sf):
    files, tags = c.images(spark, sf)
    got = ingest.ingest(files, tags=tags)
    return got.issues.join(got.measurements.select("measurement_id", "path"), "measurement_id").select("path", "field", "severity")


# ---------------------------------------------------------------- two-phase ingest of folders


@query("s03_two_phase_ingest", "SELECT user_id, CASE WHEN user_id % 3 = 0 OR user_id % 5 = 1 THEN 'parsed' ELSE 'cached' END AS outcome, user_id % 3 = 0 OR user_id % 5 IN (1, 2) AS opened, count(*) AS n, round(sum(CASE WHEN user_id % 3 <> 0 AND user_id % 5 = 1 THEN value + 1 ELSE value END), 4) AS total FROM events GROUP BY user_id")
def _(spark, sf):
    """A folder ingested twice: between the runs files come (3), change (5 + 1) and are written again as they were (5 + 2); the rest is not opened."""
    root, at = (f"{shared_root(spark)}/{what}-{uuid.uuid4().hex}" for what in ("folder", "store"))
    lines, store = c.event_lines(spark, sf), Store(spark, at)
    k = F.col("user_id")
    c.write_files(lines.where(k % 3 != 0), "user_id", root)
    ingest.ingest_folder(spark, root, store)
    raised = lines.withColumn("value", F.concat_ws(" ", F.split_part("value", F.lit(" "), F.lit(1)), (F.split_part("value", F.lit(" "), F.lit(2)).cast("double") + 1).cast("string")))
    c.write_files(lines.where((k % 3 == 0) | (k % 5 == 2)).unionByName(raised.where((k % 3 != 0) & (k % 5 == 1))), "user_id", root)
    outcomes = ingest.ingest_folder(spark, root, store)
    last = store.commits().agg(F.max_by("batch", "seq")).first()[0]
    user = F.regexp_extract("path", "user=([0-9]+)", 1).cast("long").alias("user_id")
    opened = store.table(ingest.SNAPSHOT).where(F.col("batch") == last).select("path", F.lit(True).alias("opened"))
    # a file written again has another path; its measurement is the one of its content
    m, points = store.table("measurements"), store.table("points")
    sums = points.groupBy("measurement_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("y"), 4).alias("total"))
    held = m.join(sums, "measurement_id").select("sha256", "n", "total").dropDuplicates(["sha256"])  # files of equal content have a measurement each
    return outcomes.join(opened, "path", "left").join(held, "sha256").select(user, "outcome", F.coalesce("opened", F.lit(False)).alias("opened"), "n", "total")
