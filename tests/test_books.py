"""Workbooks as one row each: what is found in packed sheets equals what the functions on cells find."""

from pyspark.sql import functions as F

from meterlake.operators import classify, parsing


def rows(df):
    return sorted(map(repr, df.collect()))


def test_packed_sheets_equal_cells(spark):
    raw = [("uv", 0, "S", r, k, v, None) for r, pair in enumerate([(50.0, 1.0), (200.0, 5.0), (210.0, 6.0), (9000.0, 1.0), (220.0, 7.0)]) for k, v in enumerate(pair)]
    raw += [("uv", 0, "S", 5, 0, None, "note"), ("uv", 0, "S", 5, 1, 2.0, None), ("uv", 1, "Z", 0, 0, 300.0, None), ("uv", 1, "Z", 0, 1, 3.0, None), ("uv", 2, "empty", 0, 0, None, "x")]
    raw += [("te", 0, "T", 3, 0, None, "TEMPERATURE"), ("te", 0, "T", 3, 2, None, "seebeck temperature"), ("te", 0, "T", 4, 0, 1.0, None), ("te", 0, "T", 4, 2, 2.0, None), ("te", 0, "T", 5, 0, 3.0, None), ("te", 0, "T", 5, 2, None, "x")]
    raw += [("ha", 0, "H", 1, 0, None, "Mobility"), ("ha", 0, "H", 1, 1, None, "mobility"), ("ha", 0, "H", 1, 2, None, "--"), ("ha", 0, "H", 4, 0, 1.5, None), ("ha", 0, "H", 4, 1, None, "n/a"), ("ha", 1, "I", 0, 0, None, "Resistivity")]
    cells = spark.createDataFrame(raw, "file_id string, sheet_idx int, sheet string, row_idx int, col_idx int, num double, txt string")
    packed = parsing.books(cells, "file_id")
    assert packed._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    sheets = parsing.book_sheets(packed)
    good = parsing.reflectance_in_sheets(sheets).select("file_id", "sheet", F.size("good").cast("long").alias("n"), F.col("malformed").cast("long").alias("malformed"), F.array_min(F.transform("good", lambda p: p["x"])).alias("low"), F.array_max(F.transform("good", lambda p: p["x"])).alias("high"))
    assert rows(good) == rows(parsing.reflectance_sheets(cells)) and good.count() == 2
    body = parsing.properties_in_sheets(sheets).select("file_id", F.explode("body").alias("b")).select("file_id", F.transform("b", lambda v: v["value"]).alias("v"))
    assert [tuple(r) for r in body.collect()] == [("te", [1.0, 2.0])]
    labels = parsing.labelled_books(packed, classify.HALL_WORDS).where("labelled is not null").select("file_id", "labelled")
    assert labels.collect() == parsing.label_facts(parsing.first_sheet(cells), classify.HALL_WORDS).collect() and labels.count() == 1
    first = parsing.first_rows(F.col("sheets"))
    got = packed.select("file_id", classify.score_reflectance_sheets(first), classify.score_row_words_sheets(first, ("temperature", "seebeck")), classify.score_any_word_sheets(first))
    assert sorted(tuple(r) for r in got.collect()) == [("ha", 0.0, 0.0, 1.0), ("te", 0.0, 1.0, 0.0), ("uv", 1.0, 0.0, 0.0)]
