"""Cells of a workbook are gathered once: headers, labels and rows are found within it."""

from pyspark.sql import functions as F

from meterlake.operators import classify, parsing
from meterlake.plans import carriers


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange"), plan.count("Join")


def test_cells_dealt_by_workbook_are_not_shuffled_or_joined_again(spark, sf):
    cells = carriers.cells(spark, sf)
    assert exchanges(cells) == (1, 0)
    for df in (parsing.property_rows(parsing.property_sheets(cells)), parsing.label_values(cells, classify.HALL_WORDS), parsing.label_columns(cells, classify.HALL_WORDS)):
        assert exchanges(df) == (1, 0)
    plan = parsing.reflectance_sheets(cells)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and plan.count("Exchange") == 1


def test_odd_sheets(spark):
    rows = [  # a header split over two rows tells nothing; a repeated column, text among numbers, rows without a pair
        ("a", "S", 0, 0, None, "Temperature (K)"), ("a", "S", 1, 1, None, "Seebeck"), ("a", "S", 2, 0, 5.0, None),
        ("b", "S", 3, 0, None, "TEMPERATURE"), ("b", "S", 3, 2, None, "seebeck temperature"), ("b", "S", 4, 0, 1.0, None), ("b", "S", 4, 2, 2.0, None), ("b", "S", 5, 0, 3.0, None), ("b", "S", 5, 2, None, "x"), ("b", "S", 6, 9, 4.0, None),
        ("c", "S", 1, 0, None, "Mobility"), ("c", "S", 1, 1, None, "mobility"), ("c", "S", 1, 2, None, "--"), ("c", "S", 4, 0, 1.5, None), ("c", "S", 4, 1, None, "n/a"), ("d", "S", 0, 0, None, "Mobility"),
    ]
    cells = spark.createDataFrame(rows, "file_id string, sheet string, row_idx int, col_idx int, num double, txt string")
    got = parsing.property_rows(parsing.property_sheets(cells)).select("file_id", "row_idx", "temperature_k", "seebeck_uvk", "zt").collect()
    assert [tuple(r) for r in got] == [("b", 4, 1.0, 2.0, None)]
    assert [tuple(r) for r in parsing.property_columns(cells).orderBy("col_idx").collect()] == [("b", "S", 3, 0, "temperature_k"), ("b", "S", 3, 2, "seebeck_uvk")]
    assert [tuple(r) for r in parsing.label_columns(cells, classify.HALL_WORDS).collect()] == [("c", 1, "mobility", None, "mobility")]
    assert parsing.label_facts(cells, classify.HALL_WORDS).select("file_id", F.col("labelled")["mobility"]).collect()[0][:] == ("c", "n/a")
