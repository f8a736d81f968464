"""Files as tables: listing with skip rules, content hashes, change detection, lines, XML and staged tables."""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def empty(spark: SparkSession, schema: str) -> DataFrame:
    """No rows of a schema, as a plan that the optimizer takes out (rows from Python would start a worker in every task)."""
    return spark.range(1).limit(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(schema)])


#: What a scan leaves out.
SKIP_FOLDERS = (
    ".git", ".svn", ".hg", "__pycache__", "node_modules", ".idea", ".vscode", ".pytest_cache", ".mypy_cache",
    ".ruff_cache", "venv", ".venv", "env", ".env",
)
SKIP_FILES = (".DS_Store", "Thumbs.db", "desktop.ini", "ehthumbs.db")


def is_wanted(rel_path: Column) -> Column:
    """No skipped or hidden folder on the way, and no skipped, hidden, lock or temporary file."""
    parts = F.split(rel_path, "/")
    folders, name = F.slice(parts, 1, F.size(parts) - 1), F.element_at(parts, -1)
    return ~F.exists(folders, lambda s: s.isin(*SKIP_FOLDERS) | s.startswith(".")) & ~(
        name.isin(*SKIP_FILES) | name.startswith(".") | name.startswith("~$") | name.endswith(".tmp") | name.endswith(".swp")
    )


def relative(path: Column, root: str) -> Column:
    """``path`` below ``root``; paths elsewhere stay as they are."""
    root = root.rstrip("/") + "/"
    return F.when(path.startswith(root), F.substr(path, F.lit(len(root) + 1))).otherwise(path)


def _located(found: DataFrame, root: str, *more: str) -> DataFrame:
    """What the file source gives, under this package's names and without unwanted files."""
    base = (root if ":" in root else f"file:{root}").replace("file:///", "file:/")
    named = found.select("path", relative(F.regexp_replace("path", "^file:/+", "file:/"), base).alias("rel_path"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("mtime"), *more)
    return named.where(is_wanted(F.col("rel_path")))


#: Tasks that list the folders below a root. Spark's own number makes a task of nearly every folder.
LISTING_TASKS = 64
_LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
#: What opening a file counts for where files are packed into tasks. Spark's own 4 MB puts at most 32 of them into a task, however small.
OPENING = "64kb"
_OPENING = "spark.sql.files.openCostInBytes"


def for_many_files(spark: SparkSession) -> SparkSession:
    """A session with the settings, views and functions of ``spark``, but for what it reads, streams too: folders are listed by at most ``LISTING_TASKS`` tasks, small files share a task."""
    made = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    made.conf.set(_LISTING, str(min(LISTING_TASKS, int(spark.conf.get(_LISTING)))))
    made.conf.set(_OPENING, OPENING)
    return made


def found_files(spark: SparkSession, root: str) -> DataFrame:
    """All files below ``root`` as Spark's file source has them; they are listed here, once for all that is made of the result."""
    return for_many_files(spark).read.format("binaryFile").option("recursiveFileLookup", "true").load(root)


def list_files(spark: SparkSession, root: str, found: DataFrame | None = None) -> DataFrame:
    """(path, rel_path, size_bytes, mtime) of wanted files. No file is opened: the plan asks for no content. ``found``: of ``found_files``."""
    return _located(found_files(spark, root) if found is None else found, root)


def scan_files(spark: SparkSession, root: str, found: DataFrame | None = None) -> DataFrame:
    """(path, rel_path, size_bytes, mtime, content) of wanted files. Spark's own listing hides empty files and names that begin with ``_``."""
    return _located(found_files(spark, root) if found is None else found, root, "content")


#: Paths that the driver names to one read.
PATHS_AT_ONCE = 20_000


def _literal(path: str) -> str:
    """``path`` with what a reader would take for a pattern escaped."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)


def read_contents(spark: SparkSession, root: str, wanted: DataFrame, n_wanted: int, n_listed: int, at_once: int = PATHS_AT_ONCE, found: DataFrame | None = None) -> list[DataFrame]:
    """Files of ``wanted`` (path) with their content, as one or several DataFrames like that of ``scan_files``.

    If half of all files or more are wanted, one scan reads them all and keeps the wanted; else each part reads at most about
    ``at_once`` files by path, so that neither the unchanged files are opened nor many paths reach the driver at once. Spark packs
    the files of a read into tasks of ``spark.sql.files.maxPartitionBytes``.
    """
    if n_wanted == 0:
        return []
    if 2 * n_wanted >= n_listed:
        return [scan_files(spark, root, found).join(wanted.select("path"), "path", "left_semi")]
    parts = -(-n_wanted // at_once)
    out = []
    for k in range(parts):
        paths = [r["path"] for r in wanted.where(F.pmod(F.xxhash64("path"), F.lit(parts)) == k).select("path").distinct().collect()]
        if paths:
            out.append(_located(for_many_files(spark).read.format("binaryFile").load([_literal(p) for p in paths]), root, "content"))
    return out


def with_sha256(df: DataFrame, content: str = "content") -> DataFrame:
    return df.withColumn("sha256", F.sha2(F.col(content).cast("binary"), 256))


def changed(listing: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Rows of ``listing`` that ``snapshot`` does not have with the same path, size and time."""
    return listing.join(snapshot, ["path", "size_bytes", "mtime"], "left_anti")


def read_lines(df: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """(key, line_no, value), numbered from 1 within each file."""
    text = F.decode(F.col(content).cast("binary"), "UTF-8")
    return df.select(key, F.posexplode(F.split(text, r"\r?\n")).alias("_at", "value")).select(key, (F.col("_at") + 1).alias("line_no"), "value")


def read_diffraction_xml(spark: SparkSession, path: str) -> DataFrame:
    """One row per scan of a diffraction XML file; broken files give nulls."""
    schema = (
        "_appendNumber string, header struct<startTimeStamp: string, endTimeStamp: string>, dataPoints struct<positions: array<struct<_axis: string, startPosition: double, endPosition: double>>, "
        "counts: struct<_VALUE: string, _unit: string>, intensities: struct<_VALUE: string, _unit: string>, commonCountingTime: struct<_VALUE: string>>"
    )
    return spark.read.format("xml").option("rowTag", "scan").option("mode", "PERMISSIVE").option("ignoreNamespace", "true").schema(schema).load(path).withColumn("path", F.input_file_name())


_C1 = bytes(range(0x80, 0xA0))
#: What the bytes 0x80 to 0x9F stand for in windows-1252, by its codec; the unassigned ones become U+FFFD.
_PAGE_1252 = _C1.decode("cp1252", errors="replace")


def declared_text(content: Column) -> Column:
    """The text of a file: in windows-1252 where an XML declaration at its start names that or ISO-8859-1, else in UTF-8; bad bytes become U+FFFD."""
    content = content.cast("binary")
    head = F.decode(F.substring(content, 1, 200), "ISO-8859-1")
    named = F.lower(F.regexp_extract(head, r"""^\s*<\?xml[^>]*\sencoding\s*=\s*["']([^"']+)["']""", 1))
    one_byte = F.translate(F.decode(content, "ISO-8859-1"), _C1.decode("latin-1"), _PAGE_1252)
    return F.when(named.isin("windows-1252", "cp1252", "iso-8859-1", "latin1"), one_byte).otherwise(F.make_valid_utf8(content.cast("string")))


#: Elements of a spectrum file and the columns they become.
SPECTRUM = {
    "CalibAbs": "calib_abs", "CalibLin": "calib_lin", "ChannelCount": "channel_count", "PrimaryEnergy": "primary_energy_kv",
    "Date": "date", "Time": "time", "Channels": "channels",
}
_NUMERIC = ("calib_abs", "calib_lin", "channel_count", "primary_energy_kv")


def _spectrum(text: str | None) -> dict[str, str]:
    """The first text that is not blank of each element, at any depth and in any namespace, and the name of the first class instance."""
    try:
        root = ElementTree.fromstring(text or "")
    except (ElementTree.ParseError, ValueError) as e:
        return {"broken": str(e)}
    out: dict[str, str] = {}
    for e in root.iter():
        tag = e.tag.rpartition("}")[2]
        if tag == "ClassInstance" and e.get("Name"):
            out.setdefault("spectrum_name", e.get("Name"))
        if tag in SPECTRUM and e.text and e.text.strip():
            out.setdefault(SPECTRUM[tag], e.text.strip())
    return out


def spectrum_fields(texts: DataFrame, key: str = "file_id", text: str = "text") -> DataFrame:
    """(key, broken, spectrum_name, calib_abs, calib_lin, channel_count, primary_energy_kv, date, time, channels) of spectrum XML texts.

    An XML parser reads each text, so comments, nesting and namespaces are what they are. ``broken`` says why a text (null and empty ones
    too) is not well-formed, all else is null then. A number that is none is null.
    """
    names = ["broken", "spectrum_name", *SPECTRUM.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                rows = [_spectrum(v.as_py()) for v in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([r.get(n) for r in rows], pa.string()) for n in names)], names=[key, *names])

    kind = texts.schema[key].dataType.simpleString()
    found = texts.select(key, text).mapInArrow(run, f"{key} {kind}, " + ", ".join(f"{n} string" for n in names))
    return found.withColumns({n: F.col(n).try_cast("double" if n != "channel_count" else "long") for n in _NUMERIC})


def read_spectrum_xml(spark: SparkSession, path: str) -> DataFrame:
    """Calibration, counts and time of spectrum XML files by path (see ``spectrum_fields``)."""
    raw = spark.read.format("binaryFile").load(path)
    return spectrum_fields(raw.select("path", declared_text(F.col("content")).alias("xml")), "path", "xml")
