"""Mixing sources to target weights by entropy balancing.

Document rates stay as close to 1 as token constraints allow (relative entropy weighted by size); the solution is an
exponential tilt, rate = exp(lambda of the source), and the multipliers solve a smooth convex dual. Its gradient and
curvature are sums over documents: each Newton step is one distributed aggregation over the (source, size)
histogram, and multipliers stay in a table. Rates are then rounded into whole copies.

Rounding goes through the sizes of a source from the largest down, each size taking the number of copies that brings
the running total closest to its goal, so the error left is about half the smallest size. One group holds the
distinct sizes of one source, not its documents: k distinct sizes need k*k/2 words, so a group is bounded by
the square root of twice the source's words. Copies of one size are dealt evenly over its documents by global rank.

Defined cases: null text has size 0; null source is a source of its own, ordered last; documents of size 0 take 0
words; repeated rows, rows that repeat an id and rows without one are separate documents, each taken as often as its
own count says; an empty table gives no rows; other input columns are ignored.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import free_name, materialize, small, with_global_index

#: No document is taken more often than this, and no source gets more than this many times its words.
MOST_COPIES = 3
WEIGHTS = (1, 2, 3)
#: Newton stops when every constraint holds to this share of its target.
TOLERANCE = 1e-12


def word_count(text: Column) -> Column:
    """Number of stretches free of ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def capped_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """``sources`` (source, source_size, rank) with target: weighted shares of all words, none above ``most`` times its source.

    Every round fixes the sources that are above their limit and shares the rest by weight anew; a round that fixes
    none ends it. Only two sums per round reach the driver.
    """
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    now = sources.withColumns({"weight": w.cast("double"), "limit": (F.col("source_size") * most).cast("double"), "capped": F.lit(False)})
    while True:
        free = now.agg(
            F.sum(F.when(F.col("capped"), F.col("limit")).otherwise(0.0)), F.sum(F.when(F.col("capped"), 0.0).otherwise(F.col("weight")))
        ).first()
        share = (total - (free[0] or 0.0)) / free[1] if free[1] else 0.0
        above = ~F.col("capped") & (F.col("weight") * share > F.col("limit"))
        if not now.where(above).limit(1).count():
            break
        now = materialize(now.withColumn("capped", F.col("capped") | above), "targets")
    return now.withColumn("target", F.when(F.col("capped"), F.col("limit")).otherwise(F.col("weight") * share)).drop("weight", "limit", "capped")


def balance(histogram: DataFrame, targets: DataFrame, tolerance: float = TOLERANCE, max_steps: int = 60) -> DataFrame:
    """(source, lambda): multipliers with sum over documents of size * exp(lambda) = target for each source.

    ``histogram``: source, size, n. The dual is separable over sources, so its Hessian is diagonal and a step is
    lambda - g/h with g = sum(size*exp(lambda)) - target and h = sum(size*exp(lambda)); a step is kept to 1.
    """
    same = F.col("h.source").eqNullSafe(F.col("m.source"))
    now = materialize(targets.where("target > 0").select("source", "target", F.lit(0.0).alias("lambda")), "multipliers")
    for _ in range(max_steps):
        sums = histogram.alias("h").join(now.alias("m"), same)
        step = sums.groupBy("m.source", "m.target", "m.lambda").agg(F.sum(F.col("size") * F.col("n") * F.exp("m.lambda")).alias("mass"))
        step = step.withColumn("gap", F.col("mass") - F.col("target"))
        moved = step.withColumn("lambda", F.col("lambda") - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("gap") / F.col("mass"))))
        moved = materialize(moved.select("source", "target", "lambda", (F.abs("gap") / F.col("target")).alias("off")), "multipliers")
        worst = moved.agg(F.max("off")).first()[0]
        now = moved.drop("off")
        if worst is None or worst <= tolerance:
            break
    return now.select("source", "lambda")


def _dealt(rows: DataFrame, weights: tuple[int, ...], most: int) -> tuple[DataFrame, DataFrame]:
    """(placed, classes) of ``rows`` (id, source, size, and row if rows are numbered).

    classes: source, size, begin, n, copies, source_size, target: how many copies the n documents of a source and size give
    together; placed: ``rows`` with their hash ``mark`` and global rank ``pos``, which starts at ``begin`` in each class.
    """
    histogram = materialize(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "histogram")
    sources = histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    ranked = with_global_index(sources.withColumn("last", F.col("source").isNull()), ["last", "source"], "rank").drop("last")
    targets = materialize(capped_targets(materialize(ranked, "sources"), weights, most), "targets")
    tilt = balance(histogram, targets)

    def copies_by_size(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size", ascending=False, ignore_index=True)
        goal = taken = 0.0
        out = []
        for size, n, rate in zip(pdf["size"].tolist(), pdf["n"].tolist(), pdf["rate"].tolist(), strict=True):
            if size == 0:
                out.append(0)
                continue
            goal += size * n * rate
            k = min(max(0, round((goal - taken) / size)), n * most)
            taken += k * size
            out.append(k)
        return pdf[["source", "size", "n"]].assign(copies=out)

    with_rate = (
        histogram.alias("h").join(tilt.alias("t"), F.col("h.source").eqNullSafe(F.col("t.source")), "left")
        .select("h.source", "h.size", "h.n", F.least(F.coalesce(F.exp("t.lambda"), F.lit(0.0)), F.lit(float(most))).alias("rate"))
    )
    dealt = materialize(with_rate.groupBy("source").applyInPandas(copies_by_size, "source string, size long, n long, copies long"), "copies")

    # the rank of a document among those of its source and size: global rank less the least one of its class
    hashed = rows.withColumn("mark", F.xxhash64("id"))
    placed = materialize(with_global_index(hashed, ["source", "size", "mark", "id", *(["row"] if "row" in rows.columns else [])]), "placed")
    starts = placed.groupBy("source", "size").agg(F.min("pos").alias("begin"))
    classes = (
        starts.alias("s").join(dealt.alias("d"), F.col("s.source").eqNullSafe(F.col("d.source")) & (F.col("s.size") == F.col("d.size")))
        .join(targets.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source")))
        .select("s.source", "s.size", "begin", "n", "copies", "source_size", "target")
    )
    return placed, materialize(classes, "classes")


def _same_class(a: str, b: str) -> Column:
    return F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source")) & (F.col(f"{a}.size") == F.col(f"{b}.size"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(id, source, size, source_size, target, copies, taken) per row of ``docs``."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    placed, classes = _dealt(materialize(rows, "sizes"), weights, most)
    out = placed.alias("p").join(classes.alias("c"), _same_class("p", "c"))
    k = (F.floor(F.col("copies") / F.col("n")) + F.when(F.col("pos") - F.col("begin") < F.col("copies") % F.col("n"), 1).otherwise(0)).cast("long")
    return out.select(F.col("p.id").alias(id_col), F.col("p.source").alias("source"), F.col("p.size").alias("size"), "source_size", "target", k.alias("copies"), (k * F.col("p.size")).alias("taken"))


def take_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as the mix takes it.

    Texts are joined with the classes of source and size alone, not with documents: a class says how often each of its
    documents is taken, and up to which one in hash order once more. So texts need no shuffle while the classes are few
    enough to broadcast.
    """
    row, size, order, copies, copy = (free_name(n, docs.columns) for n in ("_doc_row", "_size", "_order", "_copies", "_copy"))
    # the rows are written once with a number each, which must not change between the two reads
    rows = materialize(docs.withColumns({row: F.monotonically_increasing_id(), size: word_count(F.col(text_col))}), "rows")
    placed, classes = _dealt(rows.select(F.col(row).alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(size).alias("size")), weights, most)
    at_last = F.col("pos") - F.col("begin") == F.col("copies") % F.col("n") - 1
    last = placed.alias("p").join(classes.alias("c"), _same_class("p", "c")).where(at_last).select("c.source", "c.size", F.struct("mark", "id", "row").alias("last"))
    cuts = classes.alias("c").join(last.alias("l"), _same_class("c", "l"), "left").where("copies > 0")
    cuts = materialize(cuts.select("c.source", "c.size", F.floor(F.col("copies") / F.col("n")).cast("int").alias("each"), "last"), "cuts")
    own = F.struct(F.xxhash64(id_col).alias("mark"), F.col(id_col).alias("id"), F.col(row).alias("row"))
    r, c = rows.withColumn(order, own).alias("r"), small(cuts, 96).alias("c")
    out = r.join(c, F.col(f"r.{source_col}").eqNullSafe(F.col("c.source")) & (F.col(f"r.{size}") == F.col("c.size")))
    times = F.col("each") + F.when(F.col("last").isNotNull() & (F.col(f"r.{order}") <= F.col("last")), 1).otherwise(0)
    out = out.select("r.*", times.alias(copies)).where(F.col(copies) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies))))
    return out.select(docs.columns)
