"""Incremental ingest of new files as a stream."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ingest import TABLES, Parsers, commit_ingest
from ..sources.files import for_many_files, is_wanted, relative, with_sha256
from ..sources.store import Store

__all__ = ["COPIES", "TABLES", "ingest_stream", "stored"]

COPIES = "copies"


def stored(spark: SparkSession, store: str, table: str) -> DataFrame | None:
    """A table of ``ingest_stream`` as of its last whole batch, or None before its first."""
    return Store(spark, store).table(table)


def ingest_stream(spark: SparkSession, root: str, store: str, checkpoint: str, parsers: Parsers | None = None) -> StreamingQuery:
    """Parse files that have come since the last run, each content once, into the tables ``TABLES`` under ``store``.

    Content parsed before under the same parser version, in the tables or in the batch, is left out; content parsed under another
    version takes the old one's place. The table ``COPIES`` (path, sha256) names
    the files of a batch that another one of it stands for. Nothing is kept in the stream's state, so there is no watermark and no bound on how
    late a copy may come. Readers see a batch's tables together or not at all; a batch that is run again after its commit
    changes nothing, one that broke off before is written anew.
    """
    found = for_many_files(spark).readStream.format("binaryFile").option("recursiveFileLookup", "true").schema("path string, modificationTime timestamp, length long, content binary").load(root)
    base = root if ":" in root else f"file:{root}"
    stream = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def batch(df: DataFrame, number: int) -> None:
        into, name = Store(df.sparkSession, store), f"stream-{stream}-{number:09d}"
        if into.committed(name):
            return
        at = relative(F.regexp_replace("path", "^file:/+", "file:/"), base.replace("file:///", "file:/"))
        files = with_sha256(df.select("path", at.alias("rel_path"), "content")).where(is_wanted(F.col("rel_path")))
        once = files.groupBy("sha256").agg(F.min_by(F.struct("path", "rel_path", "content"), "path").alias("f")).select("f.*")
        got = commit_ingest(into, name, once, parsers)
        into.put(name, COPIES, files.select("path", "sha256").join(got.outcomes.select("path"), "path", "left_anti"))
        into.commit(name)

    return found.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
