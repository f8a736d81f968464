"""Analyzers by name, and runs of one analyzer over all measurements with reuse of stored results."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F, types as T

from ..sources.durable import written
from . import catalog, curves, peaks


class Analysis(NamedTuple):
    #: (measurement_id, outputs: JSON of an object or null, issues: array of strings), one row for each measurement with points.
    results: DataFrame
    #: (measurement_id, idx, and a double column for each derived array, all of one length), or None.
    curves: DataFrame | None = None


Keep = Callable[[DataFrame, str], DataFrame]
#: (points, params, keep) -> results and derived curves of all measurements at once; ``keep`` writes what both come from.
Analyze = Callable[[DataFrame, dict, Keep], Analysis]


@dataclass
class Analyzer:
    name: str
    version: str
    techniques: tuple[str, ...]
    analyze: Analyze
    defaults: dict = field(default_factory=dict)


@dataclass
class Registry:
    """Analyzers in order of registration; a name can be taken once."""

    by_name: dict[str, Analyzer] = field(default_factory=dict)

    def register(self, analyzer: Analyzer) -> Analyzer:
        if analyzer.name in self.by_name:
            raise ValueError(f"analyzer {analyzer.name} is registered twice")
        self.by_name[analyzer.name] = analyzer
        return analyzer

    def for_technique(self, technique: str) -> list[Analyzer]:
        return [a for a in self.by_name.values() if technique in a.techniques]


def _band_gap(points: DataFrame, params: dict, keep: Keep) -> Analysis:
    g = keep(curves.band_gap(points, params["transition"], params["low"], params["high"]), "fits")
    results = g.select("measurement_id", F.to_json(F.struct("band_gap", "r2", "n")).alias("outputs"), F.transform("issues", lambda i: i["message"]).alias("issues"))
    return Analysis(results, curves.band_gap_curve(points, g.where("slope is not null"), params["transition"]))


def _peaks(points: DataFrame, params: dict, keep: Keep) -> Analysis:
    both = keep(peaks.analyse(points, params), "analysis")
    results = both.where("tag = 'result'").select("measurement_id", F.to_json(F.struct("n_peaks", "peaks", "r2")).alias("outputs"), "issues")
    return Analysis(results, both.where("tag = 'curve'").select("measurement_id", "idx", *peaks.CURVE))


def default_registry() -> Registry:
    r = Registry()
    r.register(Analyzer("band-gap", "1.0.0", ("uv_drs",), _band_gap, {"transition": "direct", "low": curves.FIT_LOW, "high": curves.FIT_HIGH}))
    r.register(Analyzer("peak-table", "1.0.0", ("xrd",), _peaks, dict(peaks.DEFAULTS)))
    return r


NO_ARRAYS = "no arrays"


def _shape(name: str, got: Analysis) -> None:
    """Columns that results and curves must have; anything else is an error."""
    if not isinstance(got, Analysis):
        raise TypeError(f"{name} gave {type(got).__name__}, not an Analysis")
    kinds = {f.name: f.dataType for f in got.results.schema}
    wanted = {"outputs": T.StringType(), "issues": T.ArrayType(T.StringType())}
    if "measurement_id" not in kinds or any(kinds.get(k) is None or kinds[k].simpleString() != t.simpleString() for k, t in wanted.items()):
        raise TypeError(f"results of {name} must have measurement_id, outputs string and issues array<string>")
    if got.curves is not None:
        kinds = {f.name: f.dataType for f in got.curves.schema}
        arrays = {k: t for k, t in kinds.items() if k not in ("measurement_id", "idx")}
        if not {"measurement_id", "idx"} <= set(kinds) or not arrays or any(not isinstance(t, T.DoubleType) for t in arrays.values()):
            raise TypeError(f"curves of {name} must have measurement_id, idx and columns of doubles")


def complete(name: str, todo: DataFrame, points: DataFrame, results: DataFrame) -> DataFrame:
    """One row of results for every row of ``todo`` (measurement_id and more).

    A measurement without points gets null outputs and the issue ``NO_ARRAYS``. Two rows for one measurement, none for one that has
    points, a row that was not asked for, or outputs that are no JSON object fail the job: the analyzer is at fault.
    """
    told = results.groupBy("measurement_id").agg(F.count(F.lit(1)).alias("_n"), F.first("outputs").alias("outputs"), F.first("issues").alias("issues"))
    has = points.select("measurement_id").distinct().withColumn("_has", F.lit(True))
    both = todo.withColumn("_asked", F.lit(True)).join(told, "measurement_id", "full").join(has, "measurement_id", "left")
    fault = (
        F.when(F.col("_asked").isNull(), "a result that was not asked for").when(F.col("_n") > 1, "more than one result for a measurement")
        .when(F.col("_n").isNull() & F.col("_has"), "no result for a measurement with points")
        .when(F.col("outputs").isNotNull() & ~F.coalesce(F.trim("outputs").startswith("{") & F.try_parse_json("outputs").isNotNull(), F.lit(False)), "outputs that are no JSON object")
    )
    void = F.col("_n").isNull()
    return both.select(
        *todo.columns, F.when(fault.isNotNull(), F.raise_error(F.concat(F.lit(f"analyzer {name}: "), fault)).cast("string")).when(~void, F.col("outputs")).alias("outputs"),
        F.when(void, F.array(F.lit(NO_ARRAYS))).otherwise(F.coalesce("issues", F.array().cast("array<string>"))).alias("issues"),
    )


def run_analysis(
    measurements: DataFrame, points: DataFrame, results: DataFrame, analyzer: Analyzer, params: dict | None = None, force: bool = False,
    derived: str | None = None, keep: Keep = written,
) -> DataFrame:
    """All results after a run: measurements (measurement_id, technique) of its techniques without a stored result are computed.

    ``results``: measurement_id, analyzer_name, params_fp, analyzer_version, outputs, issues, and result_id if curves are to be found
    again. New rows replace those of other versions under the same parameters. Every measurement asked for gets a row (see
    ``complete``); unknown parameters are an error. With ``derived``, a folder, the analyzer's curves are stored there in the same run
    (see ``catalog.save_derived``) under the results' ids, before the results are returned. Points and results that are stored in buckets of
    measurement_id (see ``sources.buckets``) are not shuffled.
    """
    unknown = set(params or {}) - set(analyzer.defaults)
    if unknown:
        raise ValueError(f"unknown parameters of {analyzer.name}: {sorted(unknown)}")
    merged = analyzer.defaults | (params or {})
    entries = [F.lit(str(x)) for kv in sorted(merged.items()) for x in kv]
    own = measurements.where(F.col("technique").isin(*analyzer.techniques)).select("measurement_id").distinct()
    fp = catalog.params_fingerprint(F.create_map(*entries))
    missing = catalog.run_misses(own, results, analyzer.name, fp, analyzer.version, force)
    wanted = missing.select("measurement_id", F.lit(analyzer.name).alias("analyzer_name"), fp.alias("params_fp"), F.lit(analyzer.version).alias("analyzer_version"))
    run = uuid.uuid4().hex
    todo = keep(wanted.withColumn("result_id", catalog.row_id(F.lit(run), F.col("measurement_id").cast("string"))), "todo")
    mine = points.join(todo.select("measurement_id"), "measurement_id", "left_semi")
    got = analyzer.analyze(mine, merged, keep)
    _shape(analyzer.name, got)
    new = keep(complete(analyzer.name, todo, mine, got.results), "results")
    if derived is not None and got.curves is not None:
        names = [c for c in got.curves.columns if c not in ("measurement_id", "idx")]
        each = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in names])).alias("a")
        long = got.curves.join(todo.select("measurement_id", "result_id"), "measurement_id").select("result_id", "measurement_id", "idx", each)
        catalog.save_derived(long.select("result_id", "measurement_id", "idx", "a.name", "a.value", F.lit(analyzer.name).alias("analyzer_name")), derived)
    return catalog.replace_run(results, new.select(results.columns), analyzer.name, fp)
