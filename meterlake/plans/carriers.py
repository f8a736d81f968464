"""The given tables seen as files, scans, curves, lines, cells and names; each with its SQL twin."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import suppress
from urllib.parse import quote, urlsplit

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


#: Techniques and versions that stand for those of instrument files, by document id.
TECHNIQUES = ("xrd", "xps", "uv_drs", "hall", "eds")
PARSERS = ("rigaku-xrd-txt", "casaxps-csv", "uvdrs-xlsx", "hall-xls", "bruker-eds-spx")


def files(spark: SparkSession, sf: str) -> DataFrame:
    """One row per file: path, rel_path, size_bytes, content, sha256, technique, parser_version, project_id."""
    i = F.col("doc_id")
    pick = lambda names: F.element_at(F.array(*map(F.lit, names)), (i % len(names) + 1).cast("int"))
    rel = F.concat_ws("/", F.concat("source"), F.when(i % 3 == 0, "XRD").when(i % 3 == 1, "raw data").otherwise(F.concat(F.lit("CS-"), (i % 11).cast("string"))), F.concat(F.lit("scan "), i.cast("string"), F.when(i % 4 == 0, "_run2").otherwise(""), F.lit(".txt")))
    return read(spark, sf, "documents").select(
        "doc_id", F.concat(F.lit("lake/"), rel).alias("path"), rel.alias("rel_path"), F.octet_length("text").cast("long").alias("size_bytes"),
        F.col("text").alias("content"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), pick(TECHNIQUES).alias("technique"),
        pick(PARSERS).alias("parser_name"), F.when(i % 3 == 0, "1.0.0").otherwise("1.0.1").alias("parser_version"), F.col("source").alias("project_id"), F.col("lang").alias("sample_id"),
    )


FILES = """files AS (SELECT doc_id, 'lake/' || rel_path AS path, * EXCLUDE (doc_id) FROM (SELECT doc_id,
  source || '/' || CASE WHEN doc_id % 3 = 0 THEN 'XRD' WHEN doc_id % 3 = 1 THEN 'raw data' ELSE 'CS-' || CAST(doc_id % 11 AS VARCHAR) END
    || '/scan ' || CAST(doc_id AS VARCHAR) || CASE WHEN doc_id % 4 = 0 THEN '_run2' ELSE '' END || '.txt' AS rel_path,
  CAST(strlen(text) AS BIGINT) AS size_bytes, text AS content, sha256(text) AS sha256,
  (['xrd', 'xps', 'uv_drs', 'hall', 'eds'])[doc_id % 5 + 1] AS technique,
  (['rigaku-xrd-txt', 'casaxps-csv', 'uvdrs-xlsx', 'hall-xls', 'bruker-eds-spx'])[doc_id % 5 + 1] AS parser_name,
  CASE WHEN doc_id % 3 = 0 THEN '1.0.0' ELSE '1.0.1' END AS parser_version, source AS project_id, lang AS sample_id FROM documents))"""


def prior(spark: SparkSession, sf: str) -> DataFrame:
    """What an earlier ingest left: three of four files, some of an older version."""
    old = F.when(F.col("doc_id") % 7 == 0, "0.9.0").otherwise(F.col("parser_version"))
    return files(spark, sf).where("doc_id % 4 <> 0").select("doc_id", "path", "size_bytes", "sha256", old.alias("parser_version"), "project_id", "sample_id", "technique")


PRIOR = """prior AS (SELECT doc_id, path, size_bytes, sha256, CASE WHEN doc_id % 7 = 0 THEN '0.9.0' ELSE parser_version END AS parser_version, project_id, sample_id, technique
  FROM files WHERE doc_id % 4 <> 0)"""


def curves(spark: SparkSession, sf: str) -> DataFrame:
    """Points (measurement_id, idx, x, y) of evenly spaced curves."""
    return read(spark, sf, "embeddings").select(F.col("vec_id").alias("measurement_id"), F.posexplode("embedding").alias("idx", "v")).select(
        "measurement_id", "idx", F.col("idx").cast("double").alias("x"), F.col("v").cast("double").alias("y")
    )


CURVES = """curves AS (SELECT vec_id AS measurement_id, CAST(t.i AS INTEGER) AS idx, CAST(t.i AS DOUBLE) AS x, CAST(embedding[t.i + 1] AS DOUBLE) AS y
  FROM embeddings, unnest(range(0, 64)) AS t(i))"""


def scans(spark: SparkSession, sf: str) -> DataFrame:
    """Points of unevenly spaced scans: x seconds, y value; idx by time; technique and issue text from the event."""
    from pyspark.sql import Window

    e = read(spark, sf, "events")
    idx = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return e.select(F.col("user_id").alias("measurement_id"), idx.cast("int").alias("idx"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("value").alias("y"), F.col("event_type").alias("technique"), "event_id", "props").select(
        "*", (F.col("us") / 1e6).alias("x")
    )


SCANS = """scans AS (SELECT user_id AS measurement_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS idx,
  epoch_us(ts) AS us, value AS y, event_type AS technique, event_id, props, epoch_us(ts) / 1e6 AS x FROM events)"""


def items(spark: SparkSession, sf: str) -> DataFrame:
    """Items with ln: their number within the order, from 1."""
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return read(spark, sf, "lineitem").withColumn("ln", F.row_number().over(w))


ITEMS = "items AS (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS INTEGER) AS ln FROM lineitem)"


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """Numbered lines (file_id, line_no, value) of ordered texts: header, pair and junk lines derived from items."""
    l = items(spark, sf)
    n = F.col("ln")
    value = (
        F.when(n == 1, F.concat(F.lit(";SampleName = S"), (F.col("l_partkey") % 50).cast("string")))
        .when(n == 2, F.concat(F.lit(";KAlpha1 = "), F.col("l_quantity").cast("int").cast("string")))
        .when(n % 5 == 0, F.lit("bad row"))
        .otherwise(F.concat(F.lit(" "), n.cast("string"), F.lit("\t"), F.col("l_suppkey").cast("string"), F.lit(".5 ")))
    )
    return l.select(F.col("l_orderkey").alias("file_id"), n.cast("int").alias("line_no"), value.alias("value"))


LINES = ITEMS + """, lines AS (SELECT l_orderkey AS file_id, ln AS line_no, CASE WHEN ln = 1 THEN ';SampleName = S' || CAST(l_partkey % 50 AS VARCHAR)
  WHEN ln = 2 THEN ';KAlpha1 = ' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) WHEN ln % 5 = 0 THEN 'bad row'
  ELSE ' ' || CAST(ln AS VARCHAR) || chr(9) || CAST(l_suppkey AS VARCHAR) || '.5 ' END AS value FROM items)"""


CELL_HEADS = ["Temperature (K)", "Seebeck (uV/K)", "Resistivity", "Thermal conductivity", "Mobility"]


def cells(spark: SparkSession, sf: str) -> DataFrame:
    """Staged workbook cells (file_id, sheet, row_idx, col_idx, num, txt): header rows and numbers from items."""
    l = items(spark, sf).withColumn("r", F.col("ln"))
    head = CELL_HEADS
    nums = [F.col("l_quantity").cast("double") * 50, F.col("l_discount").cast("double"), F.col("l_tax").cast("double"), F.col("l_extendedprice").cast("double"), F.col("l_suppkey").cast("double")]
    rows = [F.struct(F.lit(k).alias("col_idx"), F.when(F.col("r") == 1, F.lit(None).cast("double")).when((F.col("r") == 4) & (F.lit(k) == 1), F.lit(None).cast("double")).otherwise(nums[k]).alias("num"), F.when(F.col("r") == 1, F.lit(head[k])).when((F.col("r") == 4) & (F.lit(k) == 1), F.lit("n/a")).alias("txt")) for k in range(5)]
    out = l.select(F.col("l_orderkey").alias("file_id"), F.when(F.col("l_orderkey") % 3 == 0, "A").otherwise("B").alias("sheet"), (F.col("r") - 1).alias("row_idx"), F.explode(F.array(*rows)).alias("c"))
    return out.select("file_id", "sheet", "row_idx", "c.col_idx", "c.num", "c.txt")


CELLS = ITEMS + """, cells AS (SELECT l_orderkey AS file_id, CASE WHEN l_orderkey % 3 = 0 THEN 'A' ELSE 'B' END AS sheet, CAST(ln - 1 AS INTEGER) AS row_idx, CAST(k AS INTEGER) AS col_idx,
  CASE WHEN ln = 1 OR (ln = 4 AND k = 1) THEN NULL ELSE ([CAST(l_quantity AS DOUBLE) * 50, CAST(l_discount AS DOUBLE), CAST(l_tax AS DOUBLE), CAST(l_extendedprice AS DOUBLE), CAST(l_suppkey AS DOUBLE)])[k + 1] END AS num,
  CASE WHEN ln = 1 THEN (['Temperature (K)', 'Seebeck (uV/K)', 'Resistivity', 'Thermal conductivity', 'Mobility'])[k + 1] WHEN ln = 4 AND k = 1 THEN 'n/a' END AS txt
  FROM items, unnest(range(0, 5)) AS t(k))"""


def issues(spark: SparkSession, sf: str) -> DataFrame:
    """Findings (measurement_id, severity, field, message) of measurements: from quality and toxicity marks."""
    l = read(spark, sf, "labels")
    severity = F.when(F.col("toxic") == 1, "error").when(F.col("quality") == 0, "warning").otherwise("info")
    return l.select(F.col("doc_id").alias("measurement_id"), severity.alias("severity"), F.when(F.col("toxic") == 1, "text").otherwise("quality").alias("field"), F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("message"))


ISSUES = """issues AS (SELECT doc_id AS measurement_id, CASE WHEN toxic = 1 THEN 'error' WHEN quality = 0 THEN 'warning' ELSE 'info' END AS severity,
  CASE WHEN toxic = 1 THEN 'text' ELSE 'quality' END AS field, 'quality ' || CAST(quality AS VARCHAR) AS message FROM labels)"""


def names(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct raw names with how often and where they first occur."""
    p = read(spark, sf, "part").select(F.col("p_name").alias("raw"), F.col("p_partkey").alias("seq"), F.col("p_brand").alias("file_path"), (F.col("p_size") / 50.0).alias("confidence"))
    return p


NAMES = "hints AS (SELECT p_name AS raw, p_partkey AS seq, p_brand AS file_path, p_size / 50.0 AS confidence FROM part)"


def words(spark: SparkSession, sf: str) -> DataFrame:
    """First words of all documents, as names as people type them: thousands of distinct ones, many alike."""
    return read(spark, sf, "documents").select(F.lower(F.regexp_extract("text", "([A-Za-z]{2,})", 1)).alias("name")).where("name <> ''").distinct()


WORDS = "words AS (SELECT DISTINCT lower(regexp_extract(text, '([A-Za-z]{2,})', 1)) AS name FROM documents WHERE regexp_extract(text, '([A-Za-z]{2,})', 1) <> '')"


def instrument_files(spark: SparkSession, sf: str) -> DataFrame:
    """Files (path, rel_path, content) of every kind and state, from the vectors: whole and damaged ones by turns of eight."""
    e = read(spark, sf, "embeddings")
    i = F.col("vec_id")
    rows = F.transform("embedding", lambda v, k: F.concat((k.cast("double") / 10 + 5).cast("string"), F.lit(" "), v.cast("double").cast("string")))
    head = F.concat(F.lit(";SampleName = S"), i.cast("string"), F.lit("\n;KAlpha1 = 1.54\n"))
    scan = F.concat(F.lit('<xrdMeasurements><xrdMeasurement><scan appendNumber="0"><header><startTimeStamp>2024-06-21T11:00:13</startTimeStamp></header><dataPoints><positions axis="2Theta"><startPosition>5.0</startPosition><endPosition>11.3</endPosition></positions><counts unit="counts">'), F.array_join(F.transform("embedding", lambda v: v.cast("double").cast("string")), " "), F.lit("</counts></dataPoints></scan></xrdMeasurement></xrdMeasurements>"))
    kinds = [
        (F.concat(head, F.array_join(rows, "\n")), ".txt"), (F.concat(head, F.lit("no pair\n"), F.array_join(rows, "\r\n")), ".txt"), (F.array_join(rows, "\n"), ".asc"),
        (F.concat(F.lit("Region data\nC1s,\n"), F.array_join(F.transform(rows, lambda r: F.replace(r, F.lit(" "), F.lit(","))), "\n")), ".csv"), (scan, ".xrdml"),
        (F.lit("words of no format"), ".txt"), (head, ".txt"), (F.lit(None).cast("string"), ".txt"),
    ]
    turn = (i % len(kinds) + 1).cast("int")
    rel = F.concat(F.lit("src"), (i % 3).cast("string"), F.lit("/XRD/scan "), i.cast("string"), F.element_at(F.array(*[F.lit(x) for _, x in kinds]), turn))
    return e.select(F.concat(F.lit("lake/"), rel).alias("path"), rel.alias("rel_path"), F.element_at(F.array(*[k for k, _ in kinds]), turn).cast("binary").alias("content"), "vec_id")


def workbooks(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Workbook files (path, rel_path, content) and their staged cells, a workbook to a row as ``parsing.books`` has it: reflectance, property and Hall books by turns of three, every other one with a second sheet.

    The cells are those of ``cells``, for the first sheet without the header row of every third book, for the second without the first two rows.
    """
    named = lambda k: F.concat(F.lit("book "), k.cast("string"), F.when(k % 3 == 2, ".xls").otherwise(".xlsx"))
    path = lambda k: F.concat(F.lit("lake/books/"), named(k))
    k, order = F.col("file_id"), ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    items = read(spark, sf, "lineitem").select(path(F.col("l_orderkey")).alias("path"), F.col("l_orderkey").alias("file_id"), F.struct(*order, "l_discount", "l_tax").alias("item"))
    books = items.groupBy("path").agg(F.max("file_id").alias("file_id"), F.sort_array(F.collect_list("item")).alias("items"))
    nums = lambda x: [x["l_quantity"].cast("double") * 50, x["l_discount"].cast("double"), x["l_tax"].cast("double"), x["l_extendedprice"].cast("double"), x["l_suppkey"].cast("double")]
    blank = lambda r, j: (r == 0) | ((r == 3) & F.lit(j == 1))
    cell = lambda j, v, r: F.struct(F.lit(j).alias("col_idx"), F.when(~blank(r, j), v).alias("num"), F.when(r == 0, F.lit(CELL_HEADS[j])).when(blank(r, j), F.lit("n/a")).alias("txt"))
    rows = F.transform("items", lambda x, r: F.struct(r.alias("row_idx"), F.array(*[cell(j, v, r) for j, v in enumerate(nums(x))]).alias("cells")))
    books = books.select("path", "file_id", rows.alias("rows"))
    sheet = lambda number, name, least: F.struct(F.lit(number).alias("sheet_idx"), name.alias("sheet"), F.filter("rows", lambda r: r["row_idx"] >= least).alias("rows"))
    first = sheet(0, F.when(k % 3 == 0, F.lit("A")).otherwise(F.lit("B")), F.when(k % 3 == 0, 1).otherwise(0))
    sheets = F.filter(F.array(first, F.when(k % 2 == 0, sheet(1, F.lit("Z"), F.lit(2)))), lambda s: s.isNotNull() & (F.size(s["rows"]) > 0))
    staged = books.select("path", sheets.alias("sheets"))
    files = read(spark, sf, "orders").select(F.col("o_orderkey").alias("file_id")).select(path(k).alias("path"), F.concat(F.lit("books/"), named(k)).alias("rel_path"), k.cast("string").cast("binary").alias("content"))
    return files, staged


#: Of each book its turn, and its good rows by sheet as each kind of parser counts them.
WORKBOOKS = CELLS + """, wide AS (SELECT file_id, sheet, row_idx, max(num) FILTER (col_idx = 0) AS x, max(num) FILTER (col_idx = 1) AS y FROM cells GROUP BY ALL),
two AS (SELECT file_id, sheet, 0 AS sheet_idx, row_idx, x, y FROM wide WHERE file_id % 3 <> 0 OR row_idx > 0 UNION ALL SELECT file_id, 'Z', 1, row_idx, x, y FROM wide WHERE file_id % 2 = 0 AND row_idx > 1),
good AS (SELECT *, coalesce(x BETWEEN 100 AND 2500 AND y IS NOT NULL, false) AS good FROM two),
books AS (SELECT o.o_orderkey AS file_id, o.o_orderkey % 3 AS kind, 'lake/books/book ' || CAST(o.o_orderkey AS VARCHAR) || CASE WHEN o.o_orderkey % 3 = 2 THEN '.xls' ELSE '.xlsx' END AS path,
  coalesce(count(*) FILTER (g.good AND g.sheet_idx = 0 AND g.row_idx < 20), 0) AS wavelengths, coalesce(count(*) FILTER (g.sheet_idx = 0 AND g.row_idx > 0 AND g.y IS NOT NULL), 0) AS properties, coalesce(max(g.row_idx) FILTER (g.sheet_idx = 0), -1) AS last_row
  FROM orders o LEFT JOIN good g ON g.file_id = o.o_orderkey GROUP BY ALL)"""


def images(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Image files (path, rel_path, content) and their staged tags: some without the magic bytes, some without tags, some with a broken time."""
    p, k = read(spark, sf, "part"), F.col("p_partkey")
    rel = F.concat(F.when(k % 3 == 0, "HR-TEM/").when(k % 3 == 1, "images/").otherwise("STEM/"), k.cast("string"), F.lit(".tif"))
    path = F.concat(F.lit("lake/"), rel)
    files = p.select(path.alias("path"), rel.alias("rel_path"), F.concat(F.when(k % 4 == 3, F.unhex(F.lit("FFD8FFE0"))).otherwise(F.unhex(F.lit("4D4D002A"))), k.cast("string").cast("binary")).alias("content"))
    when = F.when(F.col("p_size") % 7 == 0, "last week").otherwise(F.concat(F.lit("2025:04:28 11:21:"), F.lpad((F.col("p_size") % 40 + 11).cast("string"), 2, "0")))
    tag = lambda n, v: F.struct(F.lit(n).alias("tag_no"), v.alias("value"))
    tags = p.where(k % 5 != 4).select(path.alias("path"), F.explode(F.array(tag(271, F.col("p_brand")), tag(272, F.when(k % 2 == 0, F.col("p_type")).otherwise("")), tag(306, when), tag(999, F.lit("x")))).alias("t"))
    return files, tags.select("path", "t.tag_no", "t.value")


def event_lines(spark: SparkSession, sf: str) -> DataFrame:
    """(user_id, idx, value): lines of pairs, one file a user."""
    return scans(spark, sf).select(F.col("measurement_id").alias("user_id"), "idx", F.concat_ws(" ", F.col("idx").cast("string"), F.col("y").cast("string")).alias("value"))


def write_files(lines: DataFrame, user: str, folder: str) -> None:
    """One text file for each value of ``user``, in a folder named after it; a file that is there already is replaced.

    In a local or mounted folder the tasks write the files themselves: Spark's writer starts six processes there for each file, which set its
    permissions. A file gets its name when it is whole, so a task that runs twice changes nothing.
    """
    n = max(1, lines.sparkSession.sparkContext.defaultParallelism)
    sorted_lines = lines.select(F.coalesce(F.col(user).cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__")).alias("user"), "idx", "value").repartition(n, "user").sortWithinPartitions("user", "idx").select("user", "value")
    at = urlsplit(folder)
    if at.scheme not in ("", "file") or at.netloc:
        sorted_lines.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("user").text(folder)
        return
    root = at.path
    os.makedirs(root, exist_ok=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, out, n_files = None, None, 0

        def close() -> None:
            out.close()
            os.replace(out.name, f"{os.path.dirname(out.name)}/part.txt")

        try:
            for batch in batches:
                runs = pc.run_end_encode(batch.column(0))
                ends = [0, *runs.run_ends.to_pylist()]
                # the lines of a run as one text, each with its end
                values = pc.fill_null(batch.column(1).cast(pa.string()), "")
                texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values), "\n")
                for who, text in zip(runs.values.to_pylist(), texts.to_pylist()):
                    if who != name or out is None:
                        if out is not None:
                            close()
                        name, n_files = who, n_files + 1
                        own = f"{root}/user={quote(who, safe='')}"
                        os.makedirs(own, exist_ok=True)
                        out = open(f"{own}/.part-{uuid.uuid4().hex}", "w", encoding="utf-8", newline="")
                    out.write(text + "\n")
            if out is not None:
                close()
                out = None
        finally:
            if out is not None:
                out.close()
                with suppress(OSError):
                    os.unlink(out.name)
        yield pa.RecordBatch.from_arrays([pa.array([n_files], pa.int64())], names=["n"])

    sorted_lines.mapInArrow(run, "n long").agg(F.sum("n")).collect()
