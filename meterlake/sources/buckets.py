"""Stored tables in buckets of a key, so that joins and groups by that key read them without a shuffle."""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

BUCKETS = 64


def _registered(spark: SparkSession, path: str, columns: str, key: str, buckets: int) -> str:
    """The name under which the session knows the table at ``path``; it is registered anew where the session's catalog has forgotten it."""
    name = "buckets_" + hashlib.sha256(f"{path}|{columns}|{key}|{buckets}".encode()).hexdigest()[:24]
    at = path.replace("'", "\\'")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{at}'")
    return name


def _columns(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def append_buckets(df: DataFrame, path: str, key: str = "measurement_id", buckets: int = BUCKETS) -> DataFrame:
    """Append ``df`` to the table at ``path`` and give the whole table.

    The rows are shuffled once, when they are stored: each of ``buckets`` tasks writes one file. Key and number of buckets belong to the table
    and must be the same in every call. Columns are those of the first append, in any order; rows without a key are kept.
    """
    spark = df.sparkSession
    old = _stored(spark, path)
    df = df if old is None else df.select(old.columns)
    name = _registered(spark, path, _columns(df if old is None else old), key, buckets)
    df.repartition(buckets, key).write.insertInto(name)
    spark.catalog.refreshTable(name)
    return spark.table(name)


def open_buckets(spark: SparkSession, path: str, key: str = "measurement_id", buckets: int = BUCKETS) -> DataFrame | None:
    """The table at ``path``, in its buckets; None if nothing has been stored there."""
    old = _stored(spark, path)
    if old is None:
        return None
    name = _registered(spark, path, _columns(old), key, buckets)
    spark.catalog.refreshTable(name)
    return spark.table(name)


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None
