"""Catalog tables: cache joins, incremental ingest, project replace, load and delete, and result reuse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def row_id(*parts: Column) -> Column:
    """Deterministic 32-digit identifier."""
    return F.left(F.sha2(F.concat_ws(":", *parts), 256), F.lit(32))


def cache_hits(files: DataFrame, prior: DataFrame) -> DataFrame:
    """``files`` with cached: an earlier row has the same content and parser version."""
    known = prior.select("sha256", "parser_version").distinct().withColumn("cached", F.lit(True))
    return files.join(known, ["sha256", "parser_version"], "left").withColumn("cached", F.coalesce("cached", F.lit(False)))


def needs_parse(files: DataFrame, prior: DataFrame) -> DataFrame:
    return files.join(prior.select("sha256", "parser_version").distinct(), ["sha256", "parser_version"], "left_anti")


def superseded(prior: DataFrame, parsed: DataFrame) -> DataFrame:
    """``prior`` without rows whose content was parsed anew."""
    return prior.join(parsed.select("sha256").distinct(), "sha256", "left_anti")


def merge_measurements(prior: DataFrame, parsed: DataFrame) -> DataFrame:
    return superseded(prior, parsed).unionByName(parsed.select(prior.columns))


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    return child.join(parent.select(key).distinct(), key, "left_anti")


def params_fingerprint(params: Column) -> Column:
    """First 16 digits of the hash of a map's entries in key order."""
    return F.left(F.sha2(F.to_json(F.array_sort(F.map_entries(params))), 256), F.lit(16))


def override(defaults: Column, given: Column) -> Column:
    """Entries of ``given`` over those of ``defaults``."""
    return F.map_from_entries(F.concat(F.filter(F.map_entries(defaults), lambda e: ~F.map_contains_key(given, e["key"])), F.map_entries(given)))


RESULT_KEY = ["measurement_id", "analyzer_name", "params_fp"]


def result_misses(wanted: DataFrame, results: DataFrame, force: bool = False) -> DataFrame:
    """Rows of ``wanted`` (result key and analyzer_version) that no stored result answers."""
    return wanted if force else wanted.join(results.select(*RESULT_KEY, "analyzer_version").distinct(), [*RESULT_KEY, "analyzer_version"], "left_anti")


def replace_results(prior: DataFrame, new: DataFrame) -> DataFrame:
    """New rows take the place of earlier ones of any version with the same key."""
    return prior.join(new.select(RESULT_KEY).distinct(), RESULT_KEY, "left_anti").unionByName(new)


def answered(results: DataFrame, analyzer: str, params_fp: Column, version: str | None = None) -> DataFrame:
    """(measurement_id) that a stored result of one analyzer under one set of parameters answers; with ``version``, of that version alone."""
    own = (F.col("analyzer_name") == analyzer) & (F.col("params_fp") == params_fp)
    return results.where(own if version is None else own & (F.col("analyzer_version") == version)).select("measurement_id")


def run_misses(measurements: DataFrame, results: DataFrame, analyzer: str, params_fp: Column, version: str, force: bool = False) -> DataFrame:
    """Rows of ``measurements`` that no stored result of this run's analyzer, parameters and version answers.

    ``result_misses`` for one run: its name, parameters and version are filters of the stored side, the join is by measurement alone, so that
    results stored in buckets of it are not shuffled.
    """
    return measurements if force else measurements.join(answered(results, analyzer, params_fp, version), "measurement_id", "left_anti")


def replace_run(prior: DataFrame, new: DataFrame, analyzer: str, params_fp: Column) -> DataFrame:
    """``replace_results`` where all of ``new`` is of one analyzer under one set of parameters: one join by measurement."""
    mine = new.select("measurement_id").distinct().withColumn("_anew", F.lit(True))
    own = (F.col("analyzer_name") == analyzer) & (F.col("params_fp") == params_fp)
    kept = prior.join(mine, "measurement_id", "left").where(~F.coalesce(own, F.lit(False)) | F.col("_anew").isNull())
    return kept.select(prior.columns).unionByName(new)


def latest(results: DataFrame, key: list[str], by: list[str]) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(*key).orderBy(*[F.desc(c) for c in by]))
    return results.withColumn("_n", n).where("_n = 1").drop("_n")


def unassigned(files: DataFrame, measurements: DataFrame, key: str) -> DataFrame:
    """Files without a measurement."""
    return files.join(measurements.select(key), key, "left_anti")


# ---------------------------------------------------------------- stored tables


def save_derived(curves: DataFrame, path: str) -> None:
    """Append derived curves (result_id, idx, name, value, analyzer_name) under their analyzer."""
    curves.write.mode("append").partitionBy("analyzer_name").parquet(path)


def derived_of(curves: DataFrame, result_id) -> DataFrame:
    """The derived curve of one result; empty if there is none."""
    return curves.where(F.col("result_id") == result_id)


def save_project(df: DataFrame, path: str) -> None:
    """Replace the partitions of the projects in ``df``; other projects stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project_id").parquet(path)


def save_points(points: DataFrame, path: str, buckets: int = 64) -> None:
    """Append points under technique and a bucket of the measurement, so that one measurement lies in one folder."""
    p = points.withColumn("bucket", F.pmod(F.xxhash64("measurement_id"), F.lit(buckets)))
    p.repartition("technique", "bucket").write.mode("append").partitionBy("technique", "bucket").parquet(path)


def load_points(spark: SparkSession, path: str, measurement_id, buckets: int = 64) -> DataFrame:
    """Points of one measurement; empty if there are none."""
    points = spark.read.parquet(path)
    same_type = F.lit(measurement_id).cast(points.schema["measurement_id"].dataType)
    own = spark.range(1).select(F.pmod(F.xxhash64(same_type), F.lit(buckets))).first()[0]
    return points.where((F.col("bucket") == own) & (F.col("measurement_id") == measurement_id))


def delete_points(spark: SparkSession, path: str, measurement_ids: DataFrame, out: str) -> None:
    """Write ``path`` without some measurements to ``out``; a second time changes nothing."""
    spark.read.parquet(path).join(measurement_ids, "measurement_id", "left_anti").write.mode("overwrite").partitionBy("technique", "bucket").parquet(out)


def delete_project(tables: dict[str, DataFrame], project: DataFrame) -> dict[str, DataFrame]:
    """``projects samples measurements files issues results`` without a project (project_id) and all that hangs on it."""
    out = {"projects": tables["projects"].join(project, "project_id", "left_anti"), "samples": tables["samples"].join(project, "project_id", "left_anti")}
    gone = tables["measurements"].join(tables["samples"].join(project, "project_id").select("sample_id"), "sample_id").select("measurement_id")
    for name in ("measurements", "files", "issues", "results"):
        if name in tables:
            out[name] = tables[name].join(gone, "measurement_id", "left_anti")
    return out


def nested_project(samples: DataFrame, measurements: DataFrame) -> DataFrame:
    """(project_id, samples): samples with their measurements inside."""
    m = measurements.groupBy("project_id", "sample_id").agg(F.array_sort(F.collect_list(F.struct("measurement_id", "technique"))).alias("measurements"))
    s = samples.join(m, ["project_id", "sample_id"], "left")
    return s.groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct("sample_id", "measurements"))).alias("samples"))


DECISIONS = {"renames": "auto string, new string", "merges": "group_id long, pos int, name string", "splits": "source string, path string, target string"}
#: Most decisions that go into one document; more stay in tables.
DOCUMENT_ROWS = 100_000


def save_decisions(renames: DataFrame, merges: DataFrame, splits: DataFrame, path: str) -> None:
    """The three tables as JSON lines, each in a folder of its own; of any size."""
    for name, df in (("renames", renames), ("merges", merges), ("splits", splits)):
        df.write.mode("overwrite").json(f"{path}/{name}")


def load_decisions(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """What ``save_decisions`` wrote; a malformed line is an error."""
    return {name: spark.read.schema(schema).option("mode", "FAILFAST").json(f"{path}/{name}") for name, schema in DECISIONS.items()}


def read_decisions(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """One override document as three tables; a malformed document is an error."""
    schema = "renames map<string,string>, merges array<array<string>>, splits map<string,map<string,string>>"
    doc = spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST").json(path)
    return {
        "renames": doc.select(F.explode("renames").alias("auto", "new")),
        "merges": doc.select(F.posexplode("merges").alias("group_id", "names")).select("group_id", F.posexplode("names").alias("pos", "name")),
        "splits": doc.select(F.explode("splits").alias("source", "m")).select("source", F.explode("m").alias("path", "target")),
    }


def write_decisions(renames: DataFrame, merges: DataFrame, splits: DataFrame, path: str) -> None:
    """The three tables as one JSON document, for exchange; over ``DOCUMENT_ROWS`` rows are an error (see ``save_decisions``)."""
    if sum(df.count() for df in (renames, merges, splits)) > DOCUMENT_ROWS:
        raise ValueError(f"over {DOCUMENT_ROWS} decisions: keep them in tables")
    r = renames.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("auto", "new")))).alias("renames"))
    m = merges.groupBy("group_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]).alias("names"))
    m = m.agg(F.transform(F.array_sort(F.collect_list(F.struct("group_id", "names"))), lambda x: x["names"]).alias("merges"))
    s = splits.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("path", "target"))).alias("to"))
    by_source = F.transform(F.array_sort(F.collect_list(F.struct("source", "to"))), lambda x: F.struct(x["source"], F.map_from_entries(x["to"])))
    s = s.agg(F.map_from_entries(by_source).alias("splits"))
    r.crossJoin(m).crossJoin(s).coalesce(1).write.mode("overwrite").json(path)  # one row each
