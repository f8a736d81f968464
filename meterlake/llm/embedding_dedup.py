"""Near-duplicate vectors by sorted projection passes.

Each pass orders the vectors of a label lexicographically by concatenated random hashes (signs of random
projections) and compares every vector with its next ``WINDOW`` neighbours; verified pairs of all passes are united
and closed into components. Inside a component every pair is then compared exactly, tile by tile, so a window
never caps how many links a vector has. Exact copies are one representative with a multiplicity throughout.

How many passes a label gets is measured, by one rule at every size. Probes are sorted in with the vectors: copies of
a sample, turned in a random direction until their cosine is the threshold, which makes them the hardest pairs that
count. Passes go on for each label until at most ``MISSED`` of its probes have met no vector within the threshold, and
likewise of the probes whose vector itself has no link yet: these tell what isolated pairs lose, which probes in crowded
places, met by any neighbour, would hide. A label whose passes have cost about as much as all its pairs, and still
miss more, is compared pair by pair, and so are labels, without passes, whose pairs cost no more than the first passes (960
vectors). Vectors are hashed relative to the mean direction of their label, so that a common direction does not crowd
the signs. Recall is thus an estimate for labels settled by passes, not a proof; smaller labels are whole.

The order is global: range partitions and one count per partition give positions, blocks of positions with a halo
of one window are the groups, so no label or key is ever gathered. A component of n distinct vectors costs n*n/2
cosines in tiles of bounded size, which is what counting its links takes.

Defined cases: null label, null vector, a null or non-finite component, or zero length: linked with nothing;
vectors of unlike dimension never link; ties in keys are ordered by id; repeated rows are copies of each other; an
empty table gives no rows; other input columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import connected_components, materialize, small, with_global_index

THRESHOLD = 0.93
PASSES, BITS, WINDOW = 12, 32, 40
BLOCK, TILE = 2048, 512
#: Largest share of a label's probes that its passes may miss.
MISSED = 0.01
#: Probes of a label: at most this many on average, and this share of its vectors.
PROBES, PROBE_SHARE = 1000, 0.02
#: Rows of components of one tile that share a task.
SMALL_ROWS = 4096


def _unit(vectors) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _projection(dim: int, number: int, bits: int) -> np.ndarray:
    return np.random.default_rng([dim, number]).standard_normal((dim, bits))


def _turned(x: np.ndarray, reps: np.ndarray, threshold: float) -> np.ndarray:
    """Unit vectors at a cosine just above ``threshold`` to the unit vectors ``x``, each turned in a direction fixed by its id."""
    out = np.empty_like(x)
    t = min(1.0, threshold + 1e-9)
    for k, rep in enumerate(reps.tolist()):
        u = np.random.default_rng([rep & (1 << 63) - 1, len(x[k])]).standard_normal(len(x[k]))
        u -= (u @ x[k]) * x[k]
        out[k] = t * x[k] + np.sqrt(1 - t * t) * u / max(np.sqrt(u @ u), 1e-300)
    return _unit(out)


def _directions(vectors, reps: np.ndarray, probe: np.ndarray, threshold: float) -> np.ndarray:
    x = _unit(vectors)
    if probe.any():
        x[probe] = _turned(x[probe], reps[probe], threshold)
    return x


def centres(reps: DataFrame) -> DataFrame:
    """(label, dim, centre): the mean of the unit vectors of each label."""

    def part(batches):
        for pdf in batches:
            for (label, dim), g in pdf.groupby(["label", "dim"]):
                yield pd.DataFrame({"label": [label], "dim": [dim], "n": [len(g)], "total": [_unit(g["vector"]).sum(axis=0)]})

    def mean(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf[["label", "dim"]].iloc[:1].assign(centre=[np.sum(pdf["total"].tolist(), axis=0) / pdf["n"].sum()])

    parts = reps.select("label", "dim", "vector").mapInPandas(part, "label long, dim int, n long, total array<double>")
    return parts.groupBy("label", "dim").applyInPandas(mean, "label long, dim int, centre array<double>")


def pass_keys(reps: DataFrame, passes: int = PASSES, bits: int = BITS, first: int = 0, threshold: float = THRESHOLD) -> DataFrame:
    """(rep, label, dim, probe, pass, key): the hashes of each pass from ``first`` on as one number that sorts like their concatenation."""

    def run(batches):
        for pdf in batches:
            dims = pdf["dim"].to_numpy()
            for dim in np.unique(dims):
                own = pdf[dims == dim]
                rep, probe = own["rep"].to_numpy(), own["probe"].to_numpy(bool)
                x = _directions(own["vector"], rep, probe, threshold) - np.stack([np.asarray(v, np.float64) for v in own["centre"]])
                for n in range(first, first + passes):
                    signs = x @ _projection(int(dim), n, bits) > 0
                    key = signs @ (1 << np.arange(bits - 1, -1, -1, dtype=np.int64))
                    yield pd.DataFrame({"rep": rep, "label": own["label"].to_numpy(), "dim": int(dim), "probe": probe, "pass": n, "key": key})

    return reps.select("rep", "label", "dim", "probe", "vector", "centre").mapInPandas(run, "rep long, label long, dim int, probe boolean, pass int, key long")


def _joining(left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Those of the pairs that join what no earlier one has joined: links are counted later, inside components."""
    root: dict[int, int] = {}

    def find(k: int) -> int:
        while (up := root.setdefault(k, k)) != k:
            root[k] = k = root[up]
        return k

    out = []
    for a, b in zip(left.tolist(), right.tolist()):
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((min(a, b), max(a, b)))
    return out


def window_pairs(reps: DataFrame, threshold: float = THRESHOLD, passes: int = PASSES, window: int = WINDOW, block: int = BLOCK, first: int = 0) -> DataFrame:
    """(a, b): verified pairs of representatives that connect all that any pass finds, not yet distinct; b is null where a probe of a was met.

    ``reps``: rep, label, dim, probe, vector, centre.
    """
    placed = with_global_index(pass_keys(reps, passes, first=first, threshold=threshold), ["pass", "label", "dim", "key", "rep", "probe"])
    own = F.floor(F.col("pos") / block)
    halo = F.when((F.col("pos") % block < window) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    dealt = placed.select("rep", "probe", "pass", "label", "dim", "pos", F.explode(halo).alias("block"))
    dealt = dealt.join(reps.where(~F.col("probe")).select("rep", "vector"), "rep")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos", ignore_index=True)
        first = pdf["pos"].to_numpy()
        mine = first // block == pdf["block"].iloc[0]  # rows of the halo are partners only
        group = pdf[["pass", "label", "dim"]].to_numpy()
        rep, probe = pdf["rep"].to_numpy(), pdf["probe"].to_numpy(bool)
        left, right, met = [], [], []
        for dim in np.unique(group[:, 2]):
            at = np.flatnonzero(group[:, 2] == dim)
            x = _directions(pdf["vector"].iloc[at], rep[at], probe[at], threshold)
            for d in range(1, min(window, len(at) - 1) + 1):
                i, j = at[:-d], at[d:]
                hit = mine[i] & (group[i] == group[j]).all(axis=1) & (np.einsum("ij,ij->i", x[:-d], x[d:]) >= threshold)
                i, j = i[hit], j[hit]
                real = ~probe[i] & ~probe[j]
                left.append(rep[i[real]])
                right.append(rep[j[real]])
                met += [rep[i[probe[i] & ~probe[j]]], rep[j[probe[j] & ~probe[i]]]]
        empty = [np.zeros(0, np.int64)]
        out = pd.DataFrame(_joining(np.concatenate(left or empty), np.concatenate(right or empty)), columns=["a", "b"]).astype("Int64")
        return pd.concat([out, pd.DataFrame({"a": np.unique(np.concatenate(met or empty)), "b": pd.NA}).astype("Int64")], ignore_index=True)

    return dealt.groupBy("block").applyInPandas(compare, "a long, b long")


def _tile_pairs(members: DataFrame, tile: int) -> DataFrame:
    """Members (component, rep, and others) once for each pair of tiles x <= y that they belong to; own is their tile."""
    placed = materialize(with_global_index(members.select("component", "rep"), ["component", "rep"]), "placed")
    starts = placed.groupBy("component").agg(F.min("pos").alias("begin"), F.count(F.lit(1)).alias("n"))
    total = placed.count()
    buckets = max(1, -(-total // SMALL_ROWS))
    t = placed.join(starts, "component").select("component", "rep", ((F.col("pos") - F.col("begin")) / tile).cast("int").alias("own"), F.ceil(F.col("n") / tile).cast("int").alias("tiles"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda k: F.struct(F.least("own", k).alias("x"), F.greatest("own", k).alias("y")))
    t = t.withColumn("pair", F.explode(pairs))
    shared = F.when(F.col("tiles") == 1, F.pmod(F.xxhash64("component"), F.lit(buckets))).otherwise(F.lit(-1))
    t = t.select("rep", "component", "own", "pair.x", "pair.y", shared.alias("bucket"), F.when(F.col("tiles") == 1, F.lit(-1)).otherwise(F.col("component")).alias("large"))
    return t.join(members.drop("component"), "rep")


def all_pairs(reps: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """(a, b): pairs that connect all within the threshold, every pair of a label being compared."""
    rows = _tile_pairs(reps.select(F.col("label").alias("component"), "rep", "dim", "vector"), tile)

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for _, g in pdf.groupby(["component", "dim"], sort=False):
            x, own, rep = _unit(g["vector"]), g["own"].to_numpy(), g["rep"].to_numpy()
            i, j = np.flatnonzero(own == g["x"].iloc[0]), np.flatnonzero(own == g["y"].iloc[0])
            a, b = np.nonzero(x[i] @ x[j].T >= threshold)
            left.append(rep[i[a]])
            right.append(rep[j[b]])
        return pd.DataFrame(_joining(np.concatenate(left), np.concatenate(right)), columns=["a", "b"]).astype(np.int64)

    return rows.groupBy("bucket", "large", "x", "y").applyInPandas(compare, "a long, b long")


def component_links(members: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """(rep, links): for members (component, rep, copies, vector), the copies of other members within the threshold."""
    rows = _tile_pairs(members.select("component", "rep", "copies", "vector"), tile)

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, g in pdf.groupby("component", sort=False):
            dims = g["vector"].map(len).to_numpy()
            for dim in np.unique(dims):
                h = g[dims == dim]
                x, copies, own = _unit(h["vector"]), h["copies"].to_numpy(), h["own"].to_numpy()
                i, j = np.flatnonzero(own == h["x"].iloc[0]), np.flatnonzero(own == h["y"].iloc[0])
                near = x[i] @ x[j].T >= threshold
                reps = h["rep"].to_numpy()
                if h["x"].iloc[0] == h["y"].iloc[0]:
                    np.fill_diagonal(near, False)
                    out.append((reps[i], near @ copies[j]))
                else:
                    out += [(reps[i], near @ copies[j]), (reps[j], near.T @ copies[i])]
        return pd.DataFrame({"rep": np.concatenate([a for a, _ in out]), "links": np.concatenate([b for _, b in out]).astype(np.int64)})

    return rows.groupBy("bucket", "large", "x", "y").applyInPandas(count, "rep long, links long").groupBy("rep").agg(F.sum("links").alias("links"))


def connecting_pairs(reps: DataFrame, threshold: float = THRESHOLD, passes: int = PASSES, window: int = WINDOW) -> DataFrame:
    """(a, b): pairs that connect the representatives (rep, label, vector): passes until the probes of each label are met."""
    reps = reps.select("rep", "label", F.size("vector").alias("dim"), "vector")
    group = ["label", "dim"]
    groups = materialize(reps.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "groups")
    cheap = F.col("n") <= 2 * window * passes  # all pairs cost no more than the first passes
    pairs = reps.sparkSession.createDataFrame([], "a long, b long")
    if groups.where(cheap).limit(1).count():
        pairs = materialize(all_pairs(reps.join(small(groups.where(cheap)), group), threshold), "pairs")
    open_ = materialize(groups.where(~cheap), "open")
    if not open_.limit(1).count():
        return pairs
    with_n = reps.join(small(open_), group)
    share = F.least(F.lit(PROBE_SHARE), F.lit(float(PROBES)) / F.col("n"))
    sampled = F.pmod(F.xxhash64("rep", F.lit(4)), F.lit(1 << 30)) < share * (1 << 30)
    with_n = with_n.withColumn("probe", F.explode(F.when(sampled, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    middle = materialize(centres(with_n.where(~F.col("probe"))), "centres")
    rows = materialize(with_n.join(small(middle, 1024), group).select("rep", *group, "probe", "vector", "centre"), "rows")
    probes = materialize(rows.where("probe").select("rep", *group), "probes")
    met, linked, done = None, None, 0
    while True:
        step = passes if not done else max(1, passes // 2)
        now = rows.join(small(open_), group, "left_semi")
        got = materialize(window_pairs(now, threshold, step, window, first=done), "pairs")
        done += step
        pairs = pairs.union(got.where("b is not null"))
        met = got.where("b is null") if met is None else met.union(got.where("b is null"))
        seen = met.select(F.col("a").alias("rep"), F.lit(1).alias("hit")).distinct()
        ends = got.where("b is not null").select(F.explode(F.array("a", "b")).alias("rep"))
        linked = ends if linked is None else linked.union(ends)
        fate = probes.join(seen, "rep", "left").join(linked.distinct().withColumn("crowded", F.lit(True)), "rep", "left")
        alone = F.col("crowded").isNull()
        left = open_.join(fate, group).groupBy(*group, "n").agg(
            F.count(F.lit(1)).alias("of"), F.count("hit").alias("hits"), F.count_if(alone).alias("of_alone"), F.count(F.when(alone, F.col("hit"))).alias("hits_alone")
        )
        missed = (F.col("of") - F.col("hits") > MISSED * F.col("of")) | (F.col("of_alone") - F.col("hits_alone") > MISSED * F.col("of_alone"))
        left = materialize(left.where(missed).select(*group, "n"), "open")
        if not left.limit(1).count():
            return pairs
        costly = F.col("n") <= 2 * window * done
        whole = left.where(costly)
        if whole.limit(1).count():
            pairs = pairs.union(materialize(all_pairs(rows.where(~F.col("probe")).join(small(whole), group, "left_semi"), threshold), "pairs"))
        open_ = left.where(~costly)
        if not open_.limit(1).count():
            return pairs


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, passes: int = PASSES, window: int = WINDOW) -> DataFrame:
    """(id, n_links, component_id, kept) per row of ``vectors``."""
    v = F.col("vector")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    sound = v.isNotNull() & F.col("label").isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    marks = [F.xxhash64("vector").alias("h1"), F.xxhash64(F.transform("vector", lambda x: x * 3.0), F.lit(1)).alias("h2")]
    good = rows.where(sound).select("id", "label", "vector", *marks)
    keys = ["label", "h1", "h2"]
    reps = materialize(good.groupBy(*keys).agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("vector").alias("vector")), "reps")
    pairs = connecting_pairs(reps, threshold, passes, window)
    parts = materialize(connected_components(pairs).withColumnRenamed("node", "rep"), "parts")
    links = component_links(materialize(reps.join(parts, "rep").select("component", "rep", "copies", "vector"), "members"), threshold)
    known = reps.join(parts, "rep", "left").join(links, "rep", "left").select(
        *keys, F.coalesce("component", "rep").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")
    )
    of_row = good.select("id", *keys).join(materialize(known, "known"), keys).select("id", "links", "component")
    rest = rows.where(F.coalesce(~sound, F.lit(True))).select("id", F.lit(0).cast("long").alias("links"), F.col("id").alias("component"))
    return of_row.unionByName(rest).select(F.col("id").alias(id_col), F.col("links").alias("n_links"), F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))
