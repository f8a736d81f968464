"""Helpers shared by the operators: durable intermediates, global row numbers and connected components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. A private one only where it is unset and all is one process."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='meterlake-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows whose texts are rewritten at once: a batch may hold ten thousand.
ROWS_AT_ONCE = 256


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in small batches, so that what is made of them stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_global_index(df: DataFrame, order: list[str], name: str = "pos") -> DataFrame:
    """``df`` (narrow rows: it is written once) with ``name``: its 0-based rank by the columns ``order``.

    Range partitions keep equal keys apart by the later order columns, so no key needs to fit one task;
    only one count per partition reaches the driver.
    """
    spark = df.sparkSession
    n = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    mid = F.monotonically_increasing_id()
    ranged = materialize(
        df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_mid", mid), "ranked"
    ).withColumns({"_pid": F.shiftright("_mid", 33), "_row": F.col("_mid").bitwiseAND((1 << 33) - 1)})
    sizes = dict(ranged.groupBy("_pid").count().collect())  # one row per partition
    offsets, total = [], 0
    for pid in sorted(sizes):
        offsets.append((pid, total))
        total += sizes[pid]
    starts = spark.createDataFrame(offsets, "_pid long, _start long")
    return ranged.join(F.broadcast(starts), "_pid").withColumn(name, F.col("_start") + F.col("_row")).drop("_pid", "_start", "_row", "_mid")


#: Edges that one task contracts on its own.
CHUNK_EDGES = 500_000


def _contract(batches):
    """The edges of a task as stars: each node tied to the least that it reaches within the task."""
    root: dict[int, int] = {}

    def find(k: int) -> int:
        while (up := root.setdefault(k, k)) != k:
            root[k] = k = root.setdefault(up, up)
        return k

    for pdf in batches:
        for a, b in zip(pdf["u"].tolist(), pdf["v"].tolist()):
            x, y = find(a), find(b)
            if x != y:
                root[max(x, y)] = min(x, y)
    nodes = list(root)
    yield pd.DataFrame({"u": nodes, "v": [find(k) for k in nodes]}).astype("int64").query("u != v")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60, chunk: int = CHUNK_EDGES) -> DataFrame:
    """(node, component) for every node of ``edges``; component is the smallest node that it reaches.

    Tasks first contract chunks of at most ``CHUNK_EDGES`` edges into stars; one chunk alone is the answer. Stars of several
    chunks are joined by alternating large-star and small-star steps: each keeps connectivity and shortens paths, so the
    number of rounds grows with the logarithm of a component's size. Hot nodes are met by partial aggregation (min) and
    by joins that Spark can split; no neighbour list is gathered.
    """
    now = materialize(
        edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where("u <> v").distinct(), "edges"
    )
    chunks = max(1, -(-now.count() // chunk))
    now = materialize(now.repartition(chunks).mapInPandas(_contract, "u long, v long"), "stars")
    if chunks == 1:
        return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
    mark = None
    for _ in range(max_rounds):
        # large star: every larger neighbour of u is tied to the least node around u
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its smaller neighbours are tied to the least of them
        large = materialize(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        now = materialize(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        r = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (r[0], r[1]) == mark:
            break
        mark = (r[0], r[1])
    else:
        raise RuntimeError("connected_components did not settle")
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).union(now.select("v", "v").distinct()).groupBy("node").agg(F.min("component").alias("component"))


#: Most bytes of a hashed relation of narrow rows that is broadcast; beyond, both sides are shuffled.
BROADCAST_BYTES = 16 << 20
#: What a row takes in a hashed relation besides its values.
ROW_OVERHEAD = 48


def small(df: DataFrame, row_bytes: int = 16) -> DataFrame:
    """``df`` (materialized, narrow) marked for broadcast if its counted rows allow."""
    return F.broadcast(df) if df.count() * (row_bytes + ROW_OVERHEAD) <= BROADCAST_BYTES else df


def free_name(wanted: str, columns: list[str]) -> str:
    """``wanted``, with underscores before it until no column has that name (in any case)."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted
