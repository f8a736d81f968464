"""Region scans sort their rows once, without the texts of the lines."""

import re

from meterlake.operators import parsing


def test_region_scan_sorts_once_and_narrow(spark):
    rows = [("a", 1, "Region data"), ("a", 2, "C1s,"), ("a", 3, "3.5,1"), ("a", 4, " "), ("a", 5, "bad,row"), ("a", 6, "Late"), ("a", 7, "4.5,2"), ("b", 1, "no pair")]
    lines = spark.createDataFrame(rows, "file_id string, line_no int, value string")
    got = parsing.region_scan(lines)
    plan = got._jdf.queryExecution().executedPlan().toString()
    sorts = [line for line in plan.splitlines() if re.search(r"\bSort \[", line)]
    window = next(line for line in plan.splitlines() if "Exchange" in line)
    assert len(sorts) == 1, plan
    below = plan[: plan.index(window)]
    assert "value#" not in below, plan
    assert [tuple(r) for r in got.collect()] == [("a", 3, "C1s", 2, 2, 3.5, 4.5)]
