"""Folders of many small files: written without a process a file, listed and read in few tasks, by the stream too; copies keep a row of their own."""

from pyspark.sql import functions as F

from meterlake.operators.ingest import parse_plain
from meterlake.plans import QUERIES, carriers
from meterlake.sources import files as sources
from meterlake.sources.store import Store
from meterlake.streaming import COPIES, ingest_stream

PAIRS = "\n".join(f"{i}.0 {i % 4}" for i in range(9))


def test_a_users_file_is_written_in_order_and_replaced(spark, tmp_path):
    rows = [(u, i, f"{i} {u * i}") for u in range(40) for i in range(5 + 700 * (u == 3))]
    lines = spark.createDataFrame(rows, "user_id long, idx int, value string").repartition(3)
    text = lambda u, end="": "".join(f"{i} {u * i}{end}\n" for i in range(5 + 700 * (u == 3)))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        carriers.write_files(lines, "user_id", f"file://{tmp_path}/in")
        carriers.write_files(lines.where("user_id % 2 = 1").withColumn("value", F.concat("value", F.lit("!"))), "user_id", f"{tmp_path}/in")
        carriers.write_files(lines.where("user_id > 90"), "user_id", f"file://{tmp_path}/none")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    held = {p.relative_to(tmp_path / "in").as_posix(): p.read_text() for p in (tmp_path / "in").rglob("*") if p.is_file()}
    assert held == {f"user={u}/part.txt": text(u, "!" if u % 2 else "") for u in range(40)}  # nothing else, no checksums either
    assert sources.list_files(spark, f"file://{tmp_path}/in").count() == 40 and sources.list_files(spark, f"file://{tmp_path}/none").count() == 0


def test_small_files_share_tasks(spark, tmp_path):
    for k in range(600):
        (tmp_path / f"{k}.txt").write_text(str(k))
    found = sources.found_files(spark, str(tmp_path))
    assert sources.scan_files(spark, str(tmp_path), found).rdd.getNumPartitions() <= 8
    assert spark.conf.get("spark.sql.files.openCostInBytes") == spark.newSession().conf.get("spark.sql.files.openCostInBytes")


def test_a_stream_lists_its_folder_in_few_tasks_and_tells_of_every_copy(spark, tmp_path):
    for k in range(150):
        (tmp_path / f"in/d{k}").mkdir(parents=True)
        (tmp_path / f"in/d{k}/a.txt").write_text(PAIRS if k % 3 else "words only")
    run = ingest_stream(spark, str(tmp_path / "in"), str(tmp_path / "store"), str(tmp_path / "checkpoint"))
    run.awaitTermination()
    tracker = spark.sparkContext.statusTracker()
    jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup(str(run.runId))]
    tasks = [i.numTasks for j in jobs for s in j.stageIds if (i := tracker.getStageInfo(s))]
    assert tasks and max(tasks) <= sources.LISTING_TASKS
    store = Store(spark, str(tmp_path / "store"))
    got = {(r["parser_name"], r["outcome"]): r["sha256"] for r in store.table("outcomes").collect()}
    assert set(got) == {("plain-scan-asc", "parsed"), (None, "unclassified")}
    copies = {r["sha256"]: r["n"] for r in store.table(COPIES).groupBy("sha256").agg(F.countDistinct("path").alias("n")).collect()}
    assert copies == {got["plain-scan-asc", "parsed"]: 99, got[None, "unclassified"]: 49}
    assert store.table("measurements").count() == 1 and store.table("points").count() == 9


def test_users_of_equal_content_have_a_row_each(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").where("user_id < 12")
    events.unionByName(events.withColumn("user_id", F.col("user_id") + 15_000)).unionByName(events.withColumn("user_id", F.col("user_id") + 15_001)).write.parquet(f"{tmp_path}/events.parquet")
    known = spark.read.parquet(f"{tmp_path}/events.parquet").groupBy("user_id").agg(F.count(F.lit(1)), F.round(F.sum("value"), 4)).collect()
    got = QUERIES["t01_incremental_stream"](spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == sorted((u, n, total, "first" if u % 3 else "second") for u, n, total in known)


def test_a_plain_file_is_judged_in_one_pass_by_line(spark):
    texts = {"rises": "1 5\n\nbad row\n;1 1\n\t2\t6 \n2 7\n3 x\n", "falls": "1 5\nbad row\n0.5 6\n", "none": "bad row\n", "blank": "\n"}
    got = parse_plain(spark.createDataFrame(list(texts.items()), "file_id string, text string"))
    assert sorted(map(tuple, got.points.collect())) == [("falls", 0, 1.0, 5.0), ("falls", 1, 0.5, 6.0), ("rises", 0, 1.0, 5.0), ("rises", 1, 2.0, 6.0), ("rises", 2, 2.0, 7.0)]
    assert sorted((r["file_id"], r["field"], r["severity"]) for r in got.issues.collect()) == [("blank", "data", "error"), ("falls", "data", "warning"), ("falls", "x", "warning"), ("none", "data", "error"), ("rises", "data", "warning")]
    assert {r["file_id"]: (r["metadata"]["first_x"], r["metadata"]["last_x"]) for r in got.facts.collect()} == {"rises": ("1.0", "2.0"), "falls": ("1.0", "0.5"), "none": (None, None), "blank": (None, None)}
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(got.issues).count("Window [") == 1
    assert not [l for l in plan(got.points).splitlines() if "Filter" in l and "split(" in l]  # a line is split once, not for a filter too
