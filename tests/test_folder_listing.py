"""Folders are listed once and in few tasks; files of equal content do not multiply the results of the two-phase ingest."""

from pyspark.sql import functions as F

from meterlake.plans import QUERIES
from meterlake.sources import files as sources

KEY = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def test_a_folder_is_listed_in_few_tasks(spark, tmp_path):
    for k in range(150):
        (tmp_path / f"d{k}").mkdir()
        (tmp_path / f"d{k}" / "a.txt").write_text(str(k))
    before = spark.conf.get(KEY)
    spark.sparkContext.setJobGroup("listing", "listing")
    found = sources.found_files(spark, str(tmp_path))
    tracker = spark.sparkContext.statusTracker()
    stages = [s for j in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(j).stageIds]
    assert stages and max(tracker.getStageInfo(s).numTasks for s in stages) <= sources.LISTING_TASKS
    assert spark.conf.get(KEY) == before
    assert sources.list_files(spark, str(tmp_path), found).count() == sources.scan_files(spark, str(tmp_path), found).count() == 150


def test_files_of_equal_content_count_once_each(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").where("user_id < 15")
    events.unionByName(events.withColumn("user_id", F.col("user_id") + 15_000)).write.parquet(f"{tmp_path}/events.parquet")
    want = {(r[0], r[1]) for r in spark.read.parquet(f"{tmp_path}/events.parquet").groupBy("user_id").count().collect()}
    got = QUERIES["s03_two_phase_ingest"](spark, str(tmp_path)).select("user_id", "n").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
