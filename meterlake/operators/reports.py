"""Counts, breakdowns and listings over catalog tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Display names of techniques, and severities from mild to grave.
TECHNIQUE_NAMES = {
    "xrd": "X-Ray Diffraction", "xps": "X-Ray Photoelectron Spectroscopy", "uv_drs": "UV-Vis Diffuse Reflectance", "hall": "Hall Effect",
    "thermoelectric": "Thermoelectric Properties", "eds": "Energy-Dispersive X-Ray Spectroscopy", "tem": "Transmission Electron Microscopy",
    "sem": "Scanning Electron Microscopy", "stem": "Scanning Transmission Electron Microscopy", "raman": "Raman Spectroscopy", "unknown": "Unknown",
}
SEVERITIES = ("info", "warning", "error")


def severity_order(s: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), s).cast("int") - 1


def display_name(technique: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in TECHNIQUE_NAMES.items() for x in kv]), technique)


def counts(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def technique_breakdown(measurements: DataFrame, sample: str = "sample_id") -> DataFrame:
    """(sample, breakdown): ``technique=n`` joined by comma and blank, sorted."""
    n = measurements.groupBy(sample, "technique").agg(F.count(F.lit(1)).alias("n"))
    parts = F.array_sort(F.collect_list(F.concat("technique", F.lit("="), F.col("n").cast("string"))))
    return n.groupBy(sample).agg(F.array_join(parts, ", ").alias("breakdown"))


def project_summary(measurements: DataFrame) -> DataFrame:
    """(project_id, samples, measurements, files, techniques)."""
    return measurements.groupBy("project_id").agg(
        F.countDistinct("sample_id").alias("samples"), F.count(F.lit(1)).alias("measurements"), F.countDistinct("sha256").alias("files"),
        F.array_join(F.array_sort(F.collect_set("technique")), ",").alias("techniques"),
    )


def worst_severity(issues: DataFrame) -> DataFrame:
    """(measurement_id, worst, has_errors, has_warnings, has_warning_only): warnings of measurements include errors; those of parser output don't."""
    o = severity_order(F.col("severity"))
    return issues.groupBy("measurement_id").agg(
        F.max_by("severity", o).alias("worst"), F.bool_or(F.col("severity") == "error").alias("has_errors"), F.bool_or(o >= 1).alias("has_warnings"),
        F.bool_or(F.col("severity") == "warning").alias("has_warning_only"),
    )


def first_with_rest(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows, with how many more there are: a top-k report."""
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    return df.orderBy(*order).limit(n).crossJoin(F.broadcast(total)).withColumn("remaining", F.greatest(F.col("_total") - n, F.lit(0))).drop("_total")


def default_axes(arrays: DataFrame, preferred: str) -> DataFrame:
    """(measurement_id, x_name, y_name) of arrays (measurement_id, ordinal, name): the first, and the preferred, else the second, else the only one."""
    pick = lambda k: F.max(F.when(F.col("ordinal") == k, F.col("name")))
    g = arrays.groupBy("measurement_id").agg(pick(0).alias("x_name"), F.coalesce(F.max(F.when(F.col("name") == preferred, F.col("name"))), pick(1), pick(0)).alias("y_name"))
    return g


def applicable(measurements: DataFrame, analyzers: DataFrame) -> DataFrame:
    """Measurements with every analyzer that takes their technique (analyzers: technique, analyzer, priority)."""
    return measurements.join(F.broadcast(analyzers), "technique")


def ranked(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


# ---------------------------------------------------------------- lookups and listings


def samples_with(measurements: DataFrame, technique: str, sample: str = "sample_id") -> DataFrame:
    """Samples that have a measurement of a technique."""
    return measurements_of(measurements, technique).select(sample).distinct()


def measurements_of(measurements: DataFrame, technique: str) -> DataFrame:
    return measurements.where(F.col("technique") == technique)


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    """The row with that key, or none."""
    return df.where(F.col(key) == value).limit(1)


def issues_by_severity(issues: DataFrame) -> DataFrame:
    return issues.groupBy("severity", "field").agg(F.count(F.lit(1)).alias("n"))


def most_recent_first(df: DataFrame, time: str, tie: str) -> DataFrame:
    """Rows by time, latest first; ties by ``tie``."""
    return df.orderBy(F.desc(time), tie)


def failures(outcomes: DataFrame, key: str) -> DataFrame:
    """Files that could not be parsed, in order."""
    return outcomes.where("outcome = 'parse_failed'").orderBy(key)


def by_name(df: DataFrame, name: str) -> DataFrame:
    """Distinct names in order."""
    return df.select(name).distinct().orderBy(name)


def first_with_arrays(measurements: DataFrame, arrays: DataFrame, key: str) -> DataFrame:
    """The first measurement, by key, that has arrays."""
    return measurements.join(arrays.select(key), key, "left_semi").orderBy(key).limit(1)


def left_out(files: DataFrame, placed: DataFrame, key: str) -> DataFrame:
    """Keys of files that are in no cluster."""
    return files.select(key).exceptAll(placed.select(key))


def distinct_paths(df: DataFrame, path: str) -> DataFrame:
    return df.select(F.col(path).alias("path")).distinct()


def shared_hashes(files: DataFrame) -> DataFrame:
    """Contents that several projects have."""
    return files.groupBy("sha256").agg(F.countDistinct("project_id").alias("_k")).where("_k > 1").select("sha256")


def project_counts(measurements: DataFrame, issues: DataFrame, key: str) -> DataFrame:
    """(project_id, sample_id, measurements, issues): from projects down to findings, samples without any included."""
    m = measurements.join(issues, key, "left")
    return m.groupBy("project_id", "sample_id").agg(F.countDistinct(key).alias("measurements"), F.count("severity").alias("issues"))


def project_list(files: DataFrame, root: str) -> DataFrame:
    return files.select("project_id", F.concat(F.lit(root), "project_id").alias("root")).distinct()


def summary_json(files: DataFrame) -> DataFrame:
    """(project_id, js): a project's summary as JSON."""
    n = files.groupBy("project_id").agg(F.count(F.lit(1)).alias("files"))
    return n.select("project_id", F.to_json(F.struct(F.col("project_id").alias("project"), "files")).alias("js"))
