"""Routing of files: sniff scores as column expressions, best parser, outcome, sample name and technique."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Folders named after a technique or a kind of data are no sample names.
GENERIC_FOLDERS = (
    "xrd", "xps", "uvdrs", "uv-drs", "uv_drs", "hall", "hall measurement", "hall measurements", "thermoelectric",
    "thermoelectric properties", "eds", "edx", "eds-edx", "tem", "sem", "stem", "fe-sem", "fe sem", "hr-fe-sem", "hr fe sem",
    "microscopy", "raman", "data", "raw", "raw data", "rawdata", "results", "characterization", "analysis", "files", "samples",
)
#: Microscopy technique by folder.
MICROSCOPY_FOLDERS = {"sem": "sem", "fe-sem": "sem", "fe sem": "sem", "hr-fe-sem": "sem", "hr fe sem": "sem", "tem": "tem", "hr-tem": "tem", "hr tem": "tem", "stem": "stem"}
TIFF_MAGIC = ("49492A00", "4D4D002A", "49492B00", "4D4D002B")
HALL_WORDS = ("Hall coefficient", "Sheet resistance", "Mobility", "Resistivity")
LEAST_SCORE = 0.5
PARENTS = 3

#: A number as instrument files write it.
NUMBER = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
PAIR = rf"^\s*{NUMBER}\s+{NUMBER}(?:\s.*)?$"
COMMA_PAIR = rf"^\s*{NUMBER}\s*,\s*{NUMBER}\s*(?:,.*)?$"


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def head_lines(text: Column, n: int) -> Column:
    return F.slice(F.split(text, r"\r?\n"), 1, n)


def score_keyed_text(text: Column) -> Column:
    """Both signature keys in the first 4096 characters 1.0, one 0.7."""
    head = F.substring(text, 1, 4096)
    hits = head.contains(";SampleName").cast("int") + head.contains(";KAlpha1").cast("int")
    return F.when(hits == 2, 1.0).when(hits == 1, 0.7).otherwise(0.0)


def score_pairs(text: Column, pattern: str = PAIR) -> Column:
    """Of the first five non-blank lines all numeric pairs 1.0, all but one (one at least) 0.7."""
    rows = F.filter(head_lines(text, 5), lambda x: F.trim(x) != "")
    good, n = F.size(F.filter(rows, lambda x: x.rlike(pattern))), F.size(rows)
    return F.when(n == 0, 0.0).when(good == n, 1.0).when((good == n - 1) & (good >= 1), 0.7).otherwise(0.0)


def score_run_of_pairs(text: Column, pattern: str = COMMA_PAIR, least: int = 3, within: int = 20) -> Column:
    """1.0 if so many lines in a row among the first 20 are pairs."""
    longest = F.aggregate(
        head_lines(text, within), F.struct(F.lit(0).alias("now"), F.lit(0).alias("best")),
        lambda a, x: F.struct(
            F.when(x.rlike(pattern), a["now"] + 1).otherwise(0).alias("now"),
            F.greatest(a["best"], F.when(x.rlike(pattern), a["now"] + 1).otherwise(0)).alias("best"),
        ),
        lambda a: a["best"],
    )
    return F.when(longest >= least, 1.0).otherwise(0.0)


def score_contains(text: Column, marks: tuple[str, ...], first: int) -> Column:
    head = F.substring(text, 1, first)
    return F.when(reduce(lambda a, b: a & b, [head.contains(m) for m in marks]), 1.0).otherwise(0.0)


def score_tiff(content: Column) -> Column:
    return F.when(F.hex(F.substring(content, 1, 4)).isin(*TIFF_MAGIC), 1.0).otherwise(0.0)


def score_reflectance(cells: DataFrame) -> DataFrame:
    """(file_id, score): three of the first twenty rows of the first sheet look like wavelength and number."""
    first = cells.where("row_idx < 20").groupBy("file_id", "sheet", "row_idx").agg(F.max(F.when(F.col("col_idx") == 0, F.col("num"))).alias("a"), F.max(F.when(F.col("col_idx") == 1, F.col("num"))).alias("b"))
    ok = F.col("a").between(100, 2500) & F.col("b").isNotNull()
    return first.groupBy("file_id").agg(F.when(F.count_if(ok) >= 3, 1.0).otherwise(0.0).alias("score"))


def score_row_words(cells: DataFrame, words: tuple[str, ...], within: int = 30) -> DataFrame:
    """(file_id, score): all words (any case) in the text of one of the first rows."""
    rows = cells.where((F.col("row_idx") < within) & F.col("txt").isNotNull()).groupBy("file_id", "sheet", "row_idx").agg(F.lower(F.array_join(F.array_sort(F.collect_list("txt")), " ")).alias("t"))
    has = reduce(lambda a, b: a & b, [F.col("t").contains(w) for w in words])
    return rows.groupBy("file_id").agg(F.max(F.when(has, 1.0).otherwise(0.0)).alias("score"))


def score_any_word(cells: DataFrame, words: tuple[str, ...] = HALL_WORDS) -> DataFrame:
    has = reduce(lambda a, b: a | b, [F.col("txt").contains(w) for w in words])
    return cells.groupBy("file_id").agg(F.max(F.when(has, 1.0).otherwise(0.0)).alias("score"))


def score_reflectance_sheets(rows: Column) -> Column:
    """``score_reflectance`` of the rows (row_idx, cells) of a first sheet."""
    at = lambda r, k: F.array_max(F.transform(F.filter(r["cells"], lambda c: c["col_idx"] == k), lambda c: c["num"]))
    ok = F.filter(rows, lambda r: (r["row_idx"] < 20) & at(r, 0).between(100, 2500) & at(r, 1).isNotNull())
    return F.when(F.size(ok) >= 3, 1.0).otherwise(0.0)


def score_row_words_sheets(rows: Column, words: tuple[str, ...], within: int = 30) -> Column:
    """``score_row_words`` of the rows (row_idx, cells) of a first sheet."""
    text = lambda r: F.lower(F.array_join(F.array_sort(F.transform(F.filter(r["cells"], lambda c: c["txt"].isNotNull()), lambda c: c["txt"])), " "))
    texts = F.transform(F.filter(rows, lambda r: r["row_idx"] < within), text)
    return F.when(F.exists(texts, lambda t: reduce(lambda a, b: a & b, [t.contains(w) for w in words])), 1.0).otherwise(0.0)


def score_any_word_sheets(rows: Column, words: tuple[str, ...] = HALL_WORDS) -> Column:
    """``score_any_word`` of the rows (row_idx, cells) of a first sheet."""
    has = lambda c: reduce(lambda a, b: a | b, [c["txt"].contains(w) for w in words])
    return F.when(F.exists(rows, lambda r: F.exists(r["cells"], has)), 1.0).otherwise(0.0)


def best_parser(scores: DataFrame, key: str = "path") -> DataFrame:
    """Of rows (key, parser, priority, score) the highest score of each key; ties by the lower priority; none at 0."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "priority"))
    return scores.where("score > 0").withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def classified(best: DataFrame) -> DataFrame:
    return best.withColumn("state", F.when(F.col("score").isNull(), "errored").when(F.col("score") >= LEAST_SCORE, "classified").otherwise("unclassified"))


def outcome(hash_failed: Column, score: Column, cached: Column, parse_failed: Column, has_error: Column) -> Column:
    """What became of a file; the first that holds."""
    return (
        F.when(hash_failed, "hash_failed").when(F.coalesce(score, F.lit(0.0)) < LEAST_SCORE, "unclassified").when(cached, "cached")
        .when(parse_failed, "parse_failed").when(has_error, "parsed_with_issues").otherwise("parsed")
    )


def folder_form(s: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(s)), r"\s+", " ")


def is_generic(s: Column) -> Column:
    return folder_form(s).isin(*GENERIC_FOLDERS)


def near_parents(rel_path: Column) -> Column:
    return F.slice(F.reverse(F.split(rel_path, "/")), 2, PARENTS)


def sample_name(rel_path: Column, sheet: Column, file_stem: Column) -> Column:
    """Sheet name; else the nearest of three parents that is not generic; else the stem."""
    return F.coalesce(sheet, F.try_element_at(F.filter(near_parents(rel_path), lambda p: ~is_generic(p)), F.lit(1)), file_stem)


def microscopy_technique(rel_path: Column, technique: Column) -> Column:
    """Images that a parser calls SEM take the technique of the nearest telling folder."""
    table = F.create_map(*[F.lit(x) for kv in MICROSCOPY_FOLDERS.items() for x in kv])
    found = F.try_element_at(F.filter(F.transform(near_parents(rel_path), lambda p: F.try_element_at(table, folder_form(p))), lambda t: t.isNotNull()), F.lit(1))
    return F.when(technique == "sem", F.coalesce(found, technique)).otherwise(technique)
