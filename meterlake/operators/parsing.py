"""Parsing as DataFrame functions: lines, XML rows and staged cells become points, headers and findings. Bad input never fails a job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .classify import NUMBER

#: Header keys of keyed text scans and the names they get.
HEADER_NAMES = {
    "SampleName": "sample_name", "Target": "target", "KAlpha1": "wavelength_ka1", "KAlpha2": "wavelength_ka2", "KBeta": "wavelength_kbeta",
    "KV": "voltage_kv", "mA": "current_ma", "AxisName": "axis", "IncidentMonochro": "monochromator", "Attachment": "attachment",
    "Counter": "counter", "Start": "scan_start_deg", "Finish": "scan_finish_deg", "Width": "scan_step_deg", "Speed": "scan_speed",
    "Xunit": "x_unit", "Yunit": "y_unit", "Operator": "operator", "Memo": "memo", "Comment": "comment",
}
NUMERIC_KEYS = ("KAlpha1", "KAlpha2", "KBeta", "KBata", "KV", "mA", "Start", "Finish", "Width")
#: Outputs of property tables and the words that name their columns.
COLUMN_WORDS = {
    "temperature_k": ("temperature",), "resistivity_ohm_m": ("resistivity",), "thermal_conductivity": ("thermal conductivity",),
    "seebeck_uvk": ("seebeck",), "power_factor": ("powerfactor", "power factor"), "zt": ("zt",),
}
REQUIRED_COLUMNS = ("temperature_k", "resistivity_ohm_m", "thermal_conductivity", "seebeck_uvk")
#: Image tags that become metadata.
IMAGE_TAGS = {
    256: "image_width", 257: "image_height", 258: "bits_per_sample", 259: "compression", 262: "photometric", 271: "make", 272: "model",
    274: "orientation", 277: "samples_per_pixel", 282: "x_resolution", 283: "y_resolution", 296: "resolution_unit", 305: "software",
    306: "datetime", 315: "artist", 270: "image_description",
}
MOST_NEGATIVE = 0.10


def to_number(s: Column) -> Column:
    """A double where the whole text is a plain number, else null (suffixes such as 1.0d don't count)."""
    return F.when(s.rlike(rf"^\s*{NUMBER}\s*$"), F.trim(s).try_cast("double"))


def header_pairs(lines: DataFrame, file: str = "file_id") -> DataFrame:
    """(file, key, value) of ``;Key = Value`` lines; the last value of a key wins."""
    pattern = r"^;([\w.]+)\s*=\s*(.*)$"
    hit = lines.where(F.col("value").rlike(pattern)).select(file, "line_no", F.regexp_extract("value", pattern, 1).alias("key"), F.trim(F.regexp_extract("value", pattern, 2)).alias("text"))
    return hit.groupBy(file, "key").agg(F.max_by("text", "line_no").alias("value"))


def header_map(pairs: DataFrame, file: str = "file_id") -> DataFrame:
    return pairs.groupBy(file).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("headers"))


def typed_header(headers: DataFrame) -> DataFrame:
    """Known keys as columns, numbers as doubles; slits by key; findings for a missing wavelength or text in a number."""
    h = lambda k: F.try_element_at("headers", F.lit(k))
    number = lambda k: to_number(h(k))
    cols = []
    for key, name in HEADER_NAMES.items():
        if key == "KBeta":
            cols.append(F.coalesce(F.when(number("KBeta") != 0, number("KBeta")), number("KBata")).alias(name))
        else:
            cols.append((number(key) if key in NUMERIC_KEYS else F.when(h(key) != "", h(key))).alias(name))
    slits = F.transform(F.array_sort(F.map_entries(F.map_filter("headers", lambda k, v: k.startswith("SlitName") & (v != "")))), lambda e: e["value"])
    bad = F.filter(F.array(*map(F.lit, NUMERIC_KEYS)), lambda k: F.try_element_at(F.col("headers"), k).isNotNull() & (F.try_element_at(F.col("headers"), k) != "") & to_number(F.try_element_at(F.col("headers"), k)).isNull())
    missing = F.when(F.coalesce(h("KAlpha1"), F.lit("")) == "", F.array(F.lit("KAlpha1"))).otherwise(F.array().cast("array<string>"))
    return headers.withColumns({"slits": slits, "not_numeric": bad, "missing": missing}).select(*[c for c in headers.columns if c != "headers"], *cols, "slits", "not_numeric", "missing")


def pair_rows(lines: DataFrame, file: str = "file_id", separator: str = r"\s+") -> DataFrame:
    """(file, line_no, x, y): x and y are null where a non-blank, non-header line is no numeric pair."""
    parts = F.split(F.trim(F.replace(F.col("value"), F.lit("\t"), F.lit(" "))), separator)
    body = lines.where((F.trim(F.replace(F.col("value"), F.lit("\t"), F.lit(" "))) != "") & ~F.col("value").startswith(";"))
    x, y = to_number(F.try_element_at(parts, F.lit(1))), to_number(F.try_element_at(parts, F.lit(2)))
    both = x.isNotNull() & y.isNotNull()
    return body.select(file, "line_no", F.when(both, x).alias("x"), F.when(both, y).alias("y"))


def comma_rows(lines: DataFrame, file: str = "file_id") -> DataFrame:
    """(file, line_no, cells) of ragged comma rows."""
    return lines.select(file, "line_no", F.split("value", ",").alias("cells"))


def scan_points(pairs: DataFrame, file: str = "file_id") -> DataFrame:
    """Points of the good pairs, numbered from 0 by line."""
    # good pairs are counted, and told apart after that: a filter below the window would split and read each line once more
    idx = F.count("x").over(Window.partitionBy(file).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)) - 1
    return pairs.select(file, idx.cast("int").alias("idx"), "x", "y").where("x is not null")


def scan_quality(pairs: DataFrame, file: str = "file_id", *more: Column) -> DataFrame:
    """(file, n_points, malformed, negative_share, first_x, last_x, ``more``, state): an error without points, a warning with bad rows or many negatives."""
    good = F.col("x").isNotNull()
    out = pairs.groupBy(file).agg(
        F.count_if(good).alias("n_points"), F.count_if(~good).alias("malformed"), F.avg(F.when(good, (F.col("y") < 0).cast("int"))).alias("negative_share"),
        F.min_by("x", F.when(good, F.col("line_no"))).alias("first_x"), F.max_by("x", F.when(good, F.col("line_no"))).alias("last_x"), *more,
    )
    return out.withColumn("state", F.when(F.col("n_points") == 0, "error").when((F.col("malformed") > 0) | (F.col("negative_share") >= MOST_NEGATIVE), "warning").otherwise("ok"))


def monotonic(points: DataFrame, key: str = "measurement_id") -> DataFrame:
    """(key, rising, falling): whether x never falls, never rises."""
    before = F.lag("x").over(Window.partitionBy(key).orderBy("idx"))
    p = points.select(key, (F.col("x") - before).alias("d"))
    return p.groupBy(key).agg(F.bool_and(F.coalesce(F.col("d") >= 0, F.lit(True))).alias("rising"), F.bool_and(F.coalesce(F.col("d") <= 0, F.lit(True))).alias("falling"))


def region_scan(lines: DataFrame, file: str = "file_id", separator: str = r"\s*,\s*") -> DataFrame:
    """(file, data_start, label, n_points, malformed, start, end): lines before the first pair are header; its last label-like single cell names the region."""
    parts = F.split(F.trim("value"), separator)
    x, y = to_number(F.try_element_at(parts, F.lit(1))), to_number(F.try_element_at(parts, F.lit(2)))
    pair = x.isNotNull() & y.isNotNull()
    cell = F.trim(F.regexp_replace("value", ",+$", ""))
    # only what is counted goes through the window's sort: of texts the label-like alone
    rows = lines.select(
        file, "line_no", F.when(pair, x).alias("x"), F.when(~pair & cell.rlike("^[A-Za-z][A-Za-z0-9 ]{1,7}$"), cell).alias("cell"), (~pair & (F.trim("value") != "")).alias("other"),
    )
    rows = rows.withColumn("data_start", F.min(F.when(F.col("x").isNotNull(), F.col("line_no"))).over(Window.partitionBy(file)))
    named = (F.col("line_no") <= F.col("data_start")) & F.col("cell").isNotNull()
    good = F.col("x").isNotNull()
    # the start is the same for all rows of a file; grouped by the file alone, they need no second sort
    out = rows.where("data_start is not null").groupBy(file).agg(
        F.min("data_start").alias("data_start"), F.max_by("cell", F.when(named, F.col("line_no"))).alias("label"), F.count_if(good).alias("n_points"),
        F.count_if((F.col("line_no") >= F.col("data_start")) & F.col("other")).alias("malformed"),
        F.min_by("x", F.when(good, F.col("line_no"))).alias("start"), F.max_by("x", F.when(good, F.col("line_no"))).alias("end"),
    )
    return out


def diffraction_points(scans: DataFrame) -> DataFrame:
    """(path, idx, x, y) of XML scans: x runs evenly from start to end; any bad token voids the scan."""
    two = F.element_at(F.filter("dataPoints.positions", lambda p: p["_axis"] == "2Theta"), 1)
    text = F.coalesce("dataPoints.counts._VALUE", "dataPoints.intensities._VALUE")
    s = scans.select("path", two.alias("p"), F.split(F.trim(text), r"\s+").alias("tokens"))
    s = s.where(~F.exists("tokens", lambda t: to_number(t).isNull())).withColumn("n", F.size("tokens"))
    s = s.select("path", "p", "n", F.posexplode("tokens").alias("idx", "t"))
    step = (F.col("p.endPosition") - F.col("p.startPosition")) / F.greatest(F.col("n") - 1, F.lit(1))
    x = F.coalesce(F.col("p.startPosition") + F.col("idx") * step, F.col("idx").cast("double"))
    return s.select("path", "idx", x.alias("x"), F.col("t").cast("double").alias("y"))


def zoned_timestamp(s: Column) -> Column:
    """A timestamp where the text carries a zone, else null."""
    return F.when(s.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), F.try_to_timestamp(s))


def channel_tokens(channels: Column) -> Column:
    """What stands between the commas of a list of channels, blanks left out."""
    return F.filter(F.split(channels, ","), lambda t: t.rlike(r"\S"))


def spectrum_points(spectra: DataFrame) -> DataFrame:
    """(path, idx, x, y) of comma lists with energy = calib_abs + i * calib_lin, or the index; y is null where a channel is no number."""
    s = spectra.select("path", "calib_abs", "calib_lin", F.posexplode(channel_tokens(F.col("channels"))).alias("idx", "t"))
    return s.select("path", "idx", F.coalesce(F.col("calib_abs") + F.col("idx") * F.col("calib_lin"), F.col("idx").cast("double")).alias("x"), to_number(F.col("t")).alias("y"))


def local_timestamp(date: Column, time: Column) -> Column:
    """Local date (four usual forms) and time, taken as UTC."""
    t = F.concat_ws(" ", date, time)
    return F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in ("d.M.yyyy H:m:s", "yyyy-M-d H:m:s", "M/d/yyyy H:m:s", "d.M.yy H:m:s")])


# ---------------------------------------------------------------- staged cells


def first_sheet(cells: DataFrame) -> DataFrame:
    """The cells of each workbook's first sheet (number 0); all where sheets are not numbered."""
    return cells.where("sheet_idx = 0") if "sheet_idx" in cells.columns else cells


def reflectance_rows(cells: DataFrame) -> DataFrame:
    """(file_id, sheet, row_idx, x, y, good, bad, inside): good rows have a wavelength in 100 to 2500 and a number, bad ones two other cells; inside from the first good row on."""
    at = lambda k, c: F.max(F.when(F.col("col_idx") == k, c))
    some = F.coalesce("num", F.when(F.col("txt").isNotNull(), 0.0)).isNotNull()  # whether there is text, not the text: groups of numbers are hashed, of texts sorted
    rows = cells.groupBy("file_id", "sheet", "row_idx").agg(at(0, F.col("num")).alias("x"), at(1, F.col("num")).alias("y"), at(0, some).alias("xt"), at(1, some).alias("yt"))
    good = F.coalesce(F.col("x").between(100, 2500) & F.col("y").isNotNull(), F.lit(False))
    there = F.coalesce("xt", F.lit(False)) & F.coalesce("yt", F.lit(False))
    rows = rows.withColumn("good", good).withColumn("bad", ~F.col("good") & there).drop("xt", "yt")
    w = Window.partitionBy("file_id", "sheet").orderBy("row_idx").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("inside", F.sum(F.col("good").cast("int")).over(w) > 0)


def reflectance_sheets(cells: DataFrame) -> DataFrame:
    """(file_id, sheet, n, malformed, low, high) of sheets with good rows; later bad rows count."""
    out = reflectance_rows(cells).groupBy("file_id", "sheet").agg(F.count_if("good").alias("n"), F.count_if(F.col("inside") & F.col("bad")).alias("malformed"), F.min(F.when(F.col("good"), F.col("x"))).alias("low"), F.max(F.when(F.col("good"), F.col("x"))).alias("high"))
    return out.where("n > 0")


def measurements_per_sheet(cells: DataFrame) -> DataFrame:
    """(file_id, sheet, numbers): a measurement for every sheet that holds numbers."""
    return cells.groupBy("file_id", "sheet").agg(F.count("num").alias("numbers")).where("numbers > 0")


def inside_block(rows: DataFrame, good: Column, key: str, order: str) -> DataFrame:
    """Rows from the first good one of each key on."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_inside", F.sum(good.cast("int")).over(w)).where("_inside > 0").drop("_inside")


def _gathered(cells: DataFrame, *keys: str) -> DataFrame:
    """(keys, cells): the cells of a workbook or a sheet in one row, by row and column."""
    return cells.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("row_idx", "col_idx", "num", "txt"))).alias("cells"))


def _named_columns(heads: Column) -> Column:
    """Array of (col_idx, output) of header cells."""
    heads = F.sort_array(F.transform(heads, lambda c: F.struct(c["col_idx"].alias("col_idx"), F.lower(c["txt"]).alias("low"))))
    named = F.array(*[F.struct(F.lit(name).alias("output"), F.array(*map(F.lit, words)).alias("words")) for name, words in COLUMN_WORDS.items()])
    none = F.array().cast("array<struct<col_idx:int,output:string>>")

    def take(taken: Column, cell: Column) -> Column:
        free = F.filter(named, lambda o: ~F.exists(taken, lambda t: t["output"] == o["output"]) & F.exists(o["words"], lambda w: cell["low"].contains(w)))
        got = F.try_element_at(free, F.lit(1))["output"]
        return F.when(got.isNull(), taken).otherwise(F.concat(taken, F.array(F.struct(cell["col_idx"].cast("int").alias("col_idx"), got.alias("output")))))

    return F.aggregate(heads, none, take)


def property_sheets(cells: DataFrame) -> DataFrame:
    """(file_id, sheet, cells, header_row, columns: array of (col_idx, output)) of sheets with a telling header.

    Each header cell, from left to right, goes to the first output not taken yet whose word it holds.
    """
    held = lambda word: F.transform(F.filter("cells", lambda c: F.lower(c["txt"]).contains(word)), lambda c: c["row_idx"])
    sheets = _gathered(cells, "file_id", "sheet").withColumn("header_row", F.array_min(F.array_intersect(held("temperature"), held("seebeck")))).where("header_row is not null")
    heads = F.filter("cells", lambda c: (c["row_idx"] == F.col("header_row")) & c["txt"].isNotNull())
    return sheets.withColumn("columns", _named_columns(heads))


def property_columns(cells: DataFrame) -> DataFrame:
    """(file_id, sheet, header_row, col_idx, output) of ``property_sheets``."""
    return property_sheets(cells).select("file_id", "sheet", "header_row", F.explode("columns").alias("m")).select("file_id", "sheet", "header_row", "m.col_idx", "m.output")


def property_rows(sheets: DataFrame) -> DataFrame:
    """(file_id, sheet, row_idx, outputs...) of ``property_sheets``: rows below the header whose mapped cells are all numbers."""
    below = lambda m: F.filter("cells", lambda c: (c["col_idx"] == m["col_idx"]) & (c["row_idx"] > F.col("header_row")) & c["num"].isNotNull())
    each = F.flatten(F.transform("columns", lambda m: F.transform(below(m), lambda c: F.struct(c["row_idx"].alias("row_idx"), m["output"].alias("output"), c["num"].alias("num")))))
    body = sheets.select("file_id", "sheet", F.size("columns").alias("mapped"), F.explode(each).alias("b")).select("file_id", "sheet", "mapped", "b.*")
    wide = body.groupBy("file_id", "sheet", "row_idx").agg(F.count("num").alias("have"), F.max("mapped").alias("mapped"), *[F.max(F.when(F.col("output") == o, F.col("num"))).alias(o) for o in COLUMN_WORDS])
    return wide.where("have = mapped").drop("have", "mapped")


def missing_columns(columns: DataFrame) -> DataFrame:
    """(file_id, sheet, missing): required outputs without a column."""
    return columns.groupBy("file_id", "sheet").agg(F.array_sort(F.array_except(F.array(*map(F.lit, REQUIRED_COLUMNS)), F.collect_set("output"))).alias("missing"))


def snake(label: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(label), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def _labelled(cells: DataFrame, words: tuple[str, ...]) -> DataFrame:
    """(file_id, key, num, txt, label, col_idx): the first row with a keyword paired with the next row that is not empty, by column; of equal keys the last.

    A workbook's cells are gathered once; rows are found within.
    """
    has = lambda c: F.exists(F.array(*map(F.lit, words)), lambda w: c["txt"].contains(w))
    row = lambda found: F.array_min(F.transform(found, lambda c: c["row_idx"]))
    books = _gathered(cells, "file_id").withColumn("head", row(F.filter("cells", has))).where("head is not null")
    books = books.withColumn("data", row(F.filter("cells", lambda c: (c["row_idx"] > F.col("head")) & (c["num"].isNotNull() | c["txt"].isNotNull()))))
    top = F.filter("cells", lambda c: (c["row_idx"] == F.col("head")) & c["txt"].isNotNull())
    low = lambda t: F.filter("cells", lambda c: (c["row_idx"] == F.col("data")) & (c["col_idx"] == t["col_idx"]))
    pair = lambda t: F.transform(low(t), lambda c: F.struct(t["txt"].alias("label"), c["col_idx"].alias("col_idx"), c["num"].alias("num"), c["txt"].alias("txt")))
    both = books.select("file_id", F.explode(F.flatten(F.transform(top, pair))).alias("p")).select("file_id", "p.*").withColumn("key", snake(F.col("label"))).where("key <> ''")
    last = both.groupBy("file_id", "key").agg(F.max_by(F.struct("num", "txt", "label", "col_idx"), "col_idx").alias("v"))
    return last.select("file_id", "key", "v.num", "v.txt", "v.label", "v.col_idx")


def label_values(cells: DataFrame, words: tuple[str, ...]) -> DataFrame:
    """(file_id, key, num, label) of ``_labelled``."""
    return _labelled(cells, words).drop("txt", "col_idx")


def label_columns(cells: DataFrame, words: tuple[str, ...]) -> DataFrame:
    """(file_id, col_idx, key, num, label) of ``_labelled``."""
    return _labelled(cells, words).select("file_id", "col_idx", "key", "num", "label")


def label_facts(cells: DataFrame, words: tuple[str, ...]) -> DataFrame:
    """(file_id, labelled): a map of keys to values, numbers that are none left out, and ``key__label`` to the labels."""
    number = F.when(~F.isnan("num") & ~F.col("num").isin(float("inf"), float("-inf")), F.col("num").cast("string"))
    entry = lambda k, v: F.struct(k.alias("key"), v.alias("value"))
    e = _labelled(cells, words).select("file_id", F.explode(F.array(entry(F.col("key"), F.coalesce(number, "txt")), entry(F.concat("key", F.lit("__label")), F.col("label")))).alias("e"))
    e = e.groupBy("file_id", F.col("e.key").alias("key")).agg(F.max("e.value").alias("value"))
    return e.groupBy("file_id").agg(F.map_from_entries(F.filter(F.array_sort(F.collect_list(F.struct("key", "value"))), lambda x: x["value"].isNotNull())).alias("labelled"))


# ---------------------------------------------------------------- whole workbooks

SHEETS = "array<struct<sheet_idx:int,sheet:string,rows:array<struct<row_idx:int,cells:array<struct<col_idx:int,num:double,txt:string>>>>>>"


def books(cells: DataFrame, key: str = "path") -> DataFrame:
    """(key, sheets): one row a workbook, its sheets by number and name with their rows and cells in order; one shuffle of the cells.

    All cells of a sheet's name are one sheet, whose number is the least that they have (0 where sheets are not numbered).
    """
    number = F.col("sheet_idx") if "sheet_idx" in cells.columns else F.lit(0)
    gathered = lambda *c: F.sort_array(F.collect_list(F.struct(*c)))
    rows = cells.repartition(key).groupBy(key, "sheet", "row_idx").agg(F.min(number).alias("sheet_idx"), gathered("col_idx", "num", "txt").alias("cells"))
    sheets = rows.groupBy(key, "sheet").agg(F.min("sheet_idx").alias("sheet_idx"), gathered("row_idx", "cells").alias("rows"))
    return sheets.groupBy(key).agg(gathered("sheet_idx", "sheet", "rows").cast(SHEETS).alias("sheets"))


def first_rows(sheets: Column) -> Column:
    """The rows of a workbook's first sheet (number 0)."""
    return F.flatten(F.transform(F.filter(sheets, lambda s: s["sheet_idx"] == 0), lambda s: s["rows"]))


def number_at(row: Column, col_idx: Column) -> Column:
    """The number in a column of a row; of several the greatest."""
    return F.array_max(F.transform(F.filter(row["cells"], lambda c: c["col_idx"] == col_idx), lambda c: c["num"]))


def book_sheets(books: DataFrame) -> DataFrame:
    """(other columns, sheet, all_sheets, rows): a row for each sheet, with the names of all sheets of its workbook."""
    names = F.array_join(F.transform("sheets", lambda s: s["sheet"]), ",")
    other = [c for c in books.columns if c != "sheets"]
    return books.select(*other, names.alias("all_sheets"), F.explode("sheets").alias("s")).select(*other, "all_sheets", "s.sheet", "s.rows")


def reflectance_in_sheets(sheets: DataFrame) -> DataFrame:
    """``sheets`` with good: array of (x, y), the good rows as ``reflectance_rows`` has them, and malformed, the bad ones inside; without sheets that have no good row."""
    x, y = (lambda r, k=k: number_at(r, F.lit(k)) for k in (0, 1))
    there = lambda r, k: F.exists(r["cells"], lambda c: (c["col_idx"] == k) & (c["num"].isNotNull() | c["txt"].isNotNull()))
    pairs = sheets.withColumn("pairs", F.transform("rows", lambda r: F.struct(r["row_idx"].alias("row_idx"), x(r).alias("x"), y(r).alias("y"), (there(r, 0) & there(r, 1)).alias("there")))).drop("rows")
    good = lambda p: F.coalesce(p["x"].between(100, 2500) & p["y"].isNotNull(), F.lit(False))
    found = pairs.withColumn("good", F.filter("pairs", good)).where(F.size("good") > 0)
    start = F.col("good")[0]["row_idx"]
    return found.withColumn("malformed", F.size(F.filter("pairs", lambda p: (p["row_idx"] > start) & p["there"] & ~good(p)))).drop("pairs")


def properties_in_sheets(sheets: DataFrame) -> DataFrame:
    """``sheets`` with columns as ``property_sheets`` has them, and body: array of rows below the header whose mapped cells are all numbers, each an array of (name, value); without sheets that have no telling header."""
    holds = lambda r, word: F.exists(r["cells"], lambda c: F.lower(c["txt"]).contains(word))
    head = F.try_element_at(F.filter("rows", lambda r: holds(r, "temperature") & holds(r, "seebeck")), F.lit(1))
    found = sheets.withColumn("head", head).where("head is not null")
    found = found.withColumn("columns", _named_columns(F.filter(F.col("head")["cells"], lambda c: c["txt"].isNotNull())))
    mapped = lambda r: F.filter(r["cells"], lambda c: c["num"].isNotNull() & F.exists("columns", lambda m: m["col_idx"] == c["col_idx"]))
    whole = F.filter("rows", lambda r: (r["row_idx"] > F.col("head")["row_idx"]) & (F.size(mapped(r)) == F.size("columns")))
    body = F.transform(whole, lambda r: F.transform("columns", lambda m: F.struct(m["output"].alias("name"), number_at(r, m["col_idx"]).alias("value"))))
    return found.withColumn("body", body).drop("rows", "head")


def labels_in_rows(rows: Column, words: tuple[str, ...]) -> Column:
    """Array of (key, col_idx, num, txt, label): labels of the first row with a keyword and what stands below them in the next row that is not empty; of equal keys the last."""
    telling = F.filter(rows, lambda r: F.exists(r["cells"], lambda c: F.exists(F.array(*map(F.lit, words)), lambda w: c["txt"].contains(w))))
    head = F.try_element_at(telling, F.lit(1))
    filled = F.filter(rows, lambda r: (r["row_idx"] > head["row_idx"]) & F.exists(r["cells"], lambda c: c["num"].isNotNull() | c["txt"].isNotNull()))
    data = F.try_element_at(filled, F.lit(1))
    below = lambda t: F.transform(
        F.filter(data["cells"], lambda c: c["col_idx"] == t["col_idx"]),
        lambda c: F.struct(snake(t["txt"]).alias("key"), c["col_idx"].alias("col_idx"), c["num"].alias("num"), c["txt"].alias("txt"), t["txt"].alias("label")),
    )
    return F.filter(F.flatten(F.transform(F.filter(head["cells"], lambda c: c["txt"].isNotNull()), below)), lambda p: p["key"] != "")


def labelled_books(books: DataFrame, words: tuple[str, ...]) -> DataFrame:
    """``books`` with labelled, the map of ``label_facts`` for the first sheet: null where there is no row of labels with a row of values."""
    pairs = books.withColumn("pairs", labels_in_rows(first_rows(F.col("sheets")), words)).drop("sheets")
    last = F.filter("pairs", lambda p: ~F.exists("pairs", lambda q: (q["key"] == p["key"]) & (q["col_idx"] > p["col_idx"])))
    number = lambda v: F.when(~F.isnan(v) & ~v.isin(float("inf"), float("-inf")), v.cast("string"))
    entry = lambda k, v: F.struct(k.alias("key"), v.alias("value"))
    entries = F.flatten(F.transform(last, lambda p: F.array(entry(p["key"], F.coalesce(number(p["num"]), p["txt"])), entry(F.concat(p["key"], F.lit("__label")), p["label"]))))
    told = pairs.withColumn("entries", entries)
    keys = F.array_sort(F.array_distinct(F.transform("entries", lambda e: e["key"])))
    each = F.transform(keys, lambda k: entry(k, F.array_max(F.transform(F.filter("entries", lambda e: e["key"] == k), lambda e: e["value"]))))
    return told.withColumn("labelled", F.when(F.size("pairs") > 0, F.map_from_entries(F.filter(each, lambda e: e["value"].isNotNull())))).drop("pairs", "entries")


def image_metadata(tags: DataFrame) -> DataFrame:
    """(file_id, metadata, instrument, measured_at) of image tags (file_id, tag_no, value)."""
    names = tags.sparkSession.createDataFrame(list(IMAGE_TAGS.items()), "tag_no int, name string")
    t = tags.join(F.broadcast(names), "tag_no")
    pick = lambda n: F.max(F.when((F.col("name") == n) & (F.trim("value") != ""), F.trim("value")))
    out = t.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("name", "value"))).alias("metadata"), F.concat_ws(" ", pick("make"), pick("model")).alias("instrument"), pick("datetime").alias("dt"))
    return out.select("file_id", "metadata", "instrument", F.try_to_timestamp("dt", F.lit("yyyy:MM:dd HH:mm:ss")).alias("measured_at"))


def contract_violations(arrays: DataFrame, meta: DataFrame) -> DataFrame:
    """(measurement_id, rule): arrays (measurement_id, name, n) of unlike length; bad version, parser name or JSON in meta."""
    unlike = arrays.groupBy("measurement_id").agg(F.countDistinct("n").alias("k")).where("k > 1").select("measurement_id", F.lit("equal_length").alias("rule"))
    rule = lambda ok, name: meta.where(~ok).select("measurement_id", F.lit(name).alias("rule"))
    return (
        unlike.unionByName(rule(F.col("parser_version").rlike(r"^\d+\.\d+\.\d+$"), "version")).unionByName(rule(F.col("parser_name").rlike(r"^[a-z][a-z0-9\-]*[a-z0-9]$"), "name"))
        .unionByName(rule(F.try_parse_json("metadata").isNotNull(), "json"))
    )
