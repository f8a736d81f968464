"""Entity resolution of sample names: hints, votes, a lossless similarity join, components, clusters and user overrides."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType

from ..functions import names as N
from ..sources.durable import written

THRESHOLD = 0.85
#: Folders that name no sample, for hints (a list of its own, matched after trimming only).
GENERIC_HINTS = (
    "data", "raw", "raw data", "rawdata", "characterization", "characterizations", "results", "output", "outputs", "samples",
    "measurements", "scans", "images", "image", "files", "xrd", "x-ray", "xrd data", "xrd patterns", "xps", "xps data", "uv-drs",
    "uv drs", "uvdrs", "uv-vis", "hall", "hall data", "hall measurement", "hall measurements", "thermoelectric", "te",
    "zt calculation", "zt", "eds", "edx", "tem", "sem", "stem", "raman", "microscopy",
)
#: Metadata keys that name a sample, and their confidence.
METADATA_HINTS = {"sample_name": 1.00, "sample_id": 1.00, "sample": 0.95, "title": 0.95, "specimen": 0.95, "name": 0.85}
STEM_CONFIDENCE = 0.70


def is_generic_hint(s: Column) -> Column:
    return F.lower(F.trim(s)).isin(*GENERIC_HINTS)


def extract_hints(files: DataFrame, path: str = "path", rel_path: str = "rel_path", metadata: str | None = None) -> DataFrame:
    """(file_path, source_tag, raw, confidence, seq): stem, cleaned stem, folders, and metadata (a map) where given."""
    st = N.stem(F.col(rel_path))
    clean = N.cleaned_stem(st)
    hint = lambda tag, raw, conf: F.struct(tag.alias("source_tag"), raw.alias("raw"), conf.cast("double").alias("confidence"))
    none = F.array().cast("array<struct<source_tag:string,raw:string,confidence:double>>")
    folders = F.transform(
        N.segments(F.col(rel_path)),
        lambda s, i: hint(F.when(is_generic_hint(s), "path_segment_generic").otherwise(F.concat(F.lit("path_segment_d"), i.cast("string"))), s, F.when(is_generic_hint(s), N.GENERIC_WEIGHT).otherwise(N.depth_weight(i))),
    )
    parts = [
        F.when(st != "", F.array(hint(F.lit("filename_stem"), st, F.lit(STEM_CONFIDENCE)))).otherwise(none),
        F.when((clean != "") & (clean != st), F.array(hint(F.lit("filename_stem_cleaned"), clean, F.lit(STEM_CONFIDENCE)))).otherwise(none),
        folders,
    ]
    if metadata:
        m = F.filter(F.array(*[F.when(F.trim(F.try_element_at(metadata, F.lit(k))) != "", hint(F.lit(f"metadata_{k}"), F.trim(F.try_element_at(metadata, F.lit(k))), F.lit(c))) for k, c in METADATA_HINTS.items()]), lambda x: x.isNotNull())
        parts.append(m)
    return files.select(F.col(path).alias("file_path"), F.posexplode(F.concat(*parts)).alias("seq", "h")).select("file_path", "h.source_tag", "h.raw", "h.confidence", "seq")


def name_votes(hints: DataFrame) -> DataFrame:
    """(file_path, name, votes): summed confidence per normal form."""
    h = hints.withColumn("name", N.normalize_name(F.col("raw"))).where("name <> ''")
    return h.groupBy("file_path", "name").agg(F.round(F.sum("confidence"), 9).alias("votes"))


def name_aliases(hints: DataFrame) -> DataFrame:
    """(name, aliases): raw spellings per normal form, sorted."""
    h = hints.withColumn("name", N.normalize_name(F.col("raw"))).where("name <> ''")
    return h.groupBy("name").agg(F.array_sort(F.collect_set("raw")).alias("aliases"))


#: Names of a block; a block meets another within one task.
BLOCK_NAMES = 4_096
#: Pairs of blocks in a partition: bounds what a Python worker is sent at once.
BLOCK_PAIRS = 8


def _checked(threshold: float) -> None:
    if not 0 <= threshold <= 1:
        raise ValueError("threshold must be within 0 and 1")


def _meetings(blocks: DataFrame, apart: Column | None = None) -> DataFrame:
    """Each two of ``blocks`` (id and arrays) as a row with the columns of the lesser id under x_, those of the other under y_ (null where a block meets itself).

    Not those that ``apart`` leaves out. Ids are paired before the arrays come to them; a partition has a few rows, so that they fit a worker.
    """
    x, y = (blocks.select(*[F.col(c).alias(f"{side}_{c}") for c in blocks.columns]) for side in "xy")
    keys = [[c for c in d.columns if not isinstance(d.schema[c].dataType, ArrayType)] for d in (x, y)]
    pairs = x.select(*keys[0]).join(y.select(*keys[1]), (F.col("x_id") <= F.col("y_id")) & (F.lit(True) if apart is None else apart)).select("x_id", "y_id")
    pairs = written(pairs, "meetings")
    n = pairs.count()
    met = pairs.join(x, "x_id").join(y, "y_id")
    met = met.withColumns({c: F.when(F.col("x_id") < F.col("y_id"), F.col(c)) for c in y.columns if c not in keys[1]})
    return met.repartition(max(1, min(n, max(blocks.sparkSession.sparkContext.defaultParallelism, -(-n // BLOCK_PAIRS)))))


def name_edges(names: DataFrame, threshold: float = THRESHOLD, winkler_only: bool = False, block: int = BLOCK_NAMES) -> DataFrame:
    """(a, b, similarity): pairs a < b of distinct names with similarity of at least ``threshold``.

    Every block of names meets every other in a task, which passes over pairs that by their characters cannot be similar and measures
    the rest many at a time; no pair is shuffled. At 0 every pair is similar, so that all of them are the result.
    ``winkler_only``: the Jaro-Winkler similarity alone counts.
    """
    _checked(threshold)
    base = written(names.select("name").where("name <> ''").distinct(), "names")
    if threshold == 0:
        pairs = base.select(F.col("name").alias("a")).join(base.select(F.col("name").alias("b")), F.col("a") < F.col("b"))
        return pairs.withColumn("similarity", (N.winkler if winkler_only else N.similarity)("a", "b"))
    blocks = max(1, -(-base.count() // block))
    cut = written(base.groupBy(F.pmod(F.xxhash64("name"), F.lit(blocks)).alias("id")).agg(F.collect_list("name").alias("names")), "blocks")

    def run(batches):
        for batch in batches:
            for x, y in zip(batch.column("x_names"), batch.column("y_names")):
                x, y = x.as_py(), y.as_py()
                table = N.NameTable([*x, *(y or ())])
                text = pa.array(table.names, pa.string())
                for a, b in table.near(table.places(x), None if y is None else table.places(y), threshold):
                    s = table.similarity(a, b, winkler_only)
                    k = s >= threshold
                    yield pa.RecordBatch.from_arrays([text.take(pa.array(a[k])), text.take(pa.array(b[k])), pa.array(s[k])], names=["a", "b", "similarity"])

    return _meetings(cut).mapInArrow(run, "a string, b string, similarity double")


def _met(batches, threshold: float, within: bool = True):
    """(a, b, hub): labels that similar names of two blocks tie together, each with the least of them, or with the least of the hub's if any is.

    Columns: names x_n and y_n (null: a block for itself) and their labels x_l and y_l; ``hub``: both are labels of y. Without ``within``, x is not compared
    with itself where there is a y.
    """
    for batch in batches:
        for row in zip(*(batch.column(c) for c in ("x_n", "x_l", "y_n", "y_l"))):
            x, xl, y, yl = (v.as_py() for v in row)
            of = dict(zip(x, xl, strict=True)) | ({} if y is None else dict(zip(y, yl, strict=True)))
            hub = set() if y is None or not within else set(yl)
            table = N.NameTable(list(of))
            given = [of[k] for k in table.names]
            number = {g: k for k, g in enumerate(dict.fromkeys(given))}
            label = np.array([number[g] for g in given], np.int64)
            rows = table.places(x)
            if within or y is None:
                table.united(label, rows, None, threshold)
            if y is not None:
                table.united(label, rows, table.places(y), threshold)
            least: dict[int, tuple[bool, str]] = {}
            for k, g in set(zip(label.tolist(), given)):
                least[k] = min(least.get(k, (True, g)), (g not in hub, g))
            pairs = sorted({(g, least[k][1]) for k, g in zip(label.tolist(), given) if g != least[k][1]})
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs], pa.string()), pa.array([b for _, b in pairs], pa.string()), pa.array([a in hub for a, _ in pairs], pa.bool_())], names=["a", "b", "hub"])


#: Labels that are broadcast; beyond, both sides are shuffled.
FEW_LABELS = 100_000


def name_components(names: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK_NAMES) -> DataFrame:
    """(node, component) of distinct names (node): the rows of ``components`` over ``name_edges``, without the edges, of which there may be quadratically many.

    First every block of names is united within itself and with one hub block, which leaves few labels where names are much alike.
    Then blocks meet whose names may still have different labels; pairs of one label are not compared again, all others are.
    """
    _checked(threshold)
    kind = "a string, b string, hub boolean"
    base = written(names.select("node").where("node <> ''").distinct(), "names")
    total = base.count()
    blocks = max(1, -(-total // block))
    cut = written(base.groupBy(F.pmod(F.xxhash64("node"), F.lit(blocks)).alias("id")).agg(F.collect_list("node").alias("x_n")).withColumn("x_l", F.col("x_n")), "blocks")
    none = F.lit(None).cast("array<string>")
    hub = cut.where("id = 0").select("x_n", "x_l", none.alias("y_n"), none.alias("y_l"))
    ties = written(hub.mapInArrow(lambda batches: _met(batches, threshold), kind), "ties")
    if blocks > 1:  # the hub is one row
        to = F.broadcast(ties.agg(F.map_from_entries(F.collect_list(F.struct("a", "b"))).alias("to")))
        known = hub.crossJoin(to).select(F.col("x_n").alias("y_n"), F.transform("x_n", lambda v: F.coalesce(F.try_element_at("to", v), v)).alias("y_l"))
        rest = cut.where("id > 0").select("x_n", "x_l").crossJoin(F.broadcast(written(known, "hub")))
        n = max(min(blocks, base.sparkSession.sparkContext.defaultParallelism), -(-blocks // BLOCK_PAIRS))
        ties = ties.unionByName(written(rest.repartition(n).mapInArrow(lambda batches: _met(batches, threshold), kind), "ties"))
    joined = ties.where("hub").select("a", "b")
    moved = written(components(joined.select(F.col("a").alias("node")).union(joined.select("b")), joined), "hub")  # at most the hub's names
    labels = base.join(ties.where("not hub"), F.col("node") == F.col("a"), "left").select("node", F.coalesce("b", "node").alias("k"))
    labels = written(labels.join(F.broadcast(moved.select(F.col("node").alias("k"), "component")), "k", "left").select("node", F.coalesce("component", "k").alias("label")), "labels")
    sizes = written(labels.groupBy("label").agg(F.count(F.lit(1)).alias("k"), F.min("node").alias("least")), "sizes")
    if sizes.count() > 1:
        large = sizes.where(F.col("k") >= block).select("label", F.ceil(F.col("k") / block).alias("parts"))  # at most as many as blocks
        rest = max(1, -(-(sizes.where(F.col("k") < block).agg(F.coalesce(F.sum("k"), F.lit(0))).first()[0]) // block))
        placed = labels.join(F.broadcast(large), "label", "left")
        part = F.coalesce(F.pmod(F.xxhash64("node"), "parts"), F.pmod(F.xxhash64("label"), F.lit(rest)))
        placed = placed.groupBy(F.when(F.col("parts").isNotNull(), F.col("label")).alias("whole"), part.alias("part")).agg(F.collect_list("node").alias("n"), F.collect_list("label").alias("l"))
        cut = written(placed.select(F.concat_ws(" ", F.col("part").cast("string"), "whole").alias("id"), "whole", "n", "l"), "blocks")
        met = _meetings(cut, ~F.coalesce(F.col("x_whole") == F.col("y_whole"), F.lit(False)))
        ties = met.mapInArrow(lambda batches: _met(batches, threshold, within=False), kind)
        found = components(sizes.select(F.col("label").alias("node")), ties.select("a", "b")).withColumnRenamed("node", "label").join(sizes, "label")
        least = found.groupBy("component").agg(F.min("least").alias("of_all"))
        sizes = found.join(least, "component").select("label", F.col("of_all").alias("least"))
    moved = written(sizes.where("label <> least").select("label", "least"), "moved")
    moved = F.broadcast(moved) if moved.count() <= FEW_LABELS else moved
    return labels.join(moved, "label", "left").select("node", F.coalesce("least", "label").alias("component"))


#: Distinct names that one task compares and contracts on its own, without candidates, edges or rounds.
FEW_NAMES = 200


def few_components(names: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(node, component) of at most ``FEW_NAMES`` distinct names (node): the same rows as of ``components`` over ``name_edges``, in one small task."""
    _checked(threshold)

    def run(batches):
        nodes = sorted(x for pdf in batches for x in pdf["node"])
        near = [(a, b) for i, a in enumerate(nodes) for b in nodes[i + 1:] if N.similarity_of(a, b) >= threshold]
        stars = dict(pair for pdf in _contracted([pd.DataFrame(near, columns=["a", "b"])]) for pair in zip(pdf["a"], pdf["b"], strict=True))
        yield pd.DataFrame({"node": nodes, "component": [stars.get(x, x) for x in nodes]}, dtype=object)

    return names.select("node").coalesce(1).mapInPandas(run, "node string, component string")


#: Edges that one task contracts on its own.
CHUNK_EDGES = 500_000


def _contracted(batches):
    """The edges of a task as stars: each node tied to the least that it reaches within the task."""
    root: dict = {}

    def find(k):
        while (up := root.setdefault(k, k)) != k:
            root[k] = k = root[up]
        return k

    for pdf in batches:
        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True):
            x, y = find(a), find(b)
            if x != y:
                root[max(x, y)] = min(x, y)
    stars = [(k, up) for k in list(root) if (up := find(k)) != k]
    if stars:
        yield pd.DataFrame(stars, columns=["a", "b"])


def components(nodes: DataFrame, edges: DataFrame, chunk: int = CHUNK_EDGES, max_rounds: int = 100) -> DataFrame:
    """(node, component): the least node that each reaches; lone nodes are their own. Strings or numbers.

    Tasks contract chunks of edges into stars; one chunk alone is the answer. Stars of several chunks are joined by hash-min
    with pointer jumping: every round takes the least label around each node, then the label of that label.
    """
    kind = nodes.schema["node"].dataType
    pairs = written(edges.select(F.col("a").cast(kind).alias("a"), F.col("b").cast(kind).alias("b")).where("a <> b"), "pairs")
    chunks = max(1, -(-pairs.count() // chunk))
    stars = pairs.repartition(chunks).mapInPandas(_contracted, f"a {kind.simpleString()}, b {kind.simpleString()}")
    own = nodes.select("node").distinct()
    if chunks == 1:
        return own.join(stars, F.col("node") == F.col("a"), "left").select("node", F.coalesce("b", "node").alias("component"))
    stars = written(stars, "stars")
    both = written(stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    now = written(own.withColumn("component", F.col("node")), "labels")
    for _ in range(max_rounds):
        around = both.join(now, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("m"))
        low = now.join(around, F.col("node") == F.col("a"), "left").select("node", F.least("component", F.coalesce("m", "component")).alias("component"))
        jump = now.select(F.col("node").alias("k"), F.col("component").alias("next"))
        fresh = written(low.join(jump, F.col("component") == F.col("k"), "left").select("node", F.least("component", "next").alias("component")), "labels")
        moved = fresh.join(now.withColumnRenamed("component", "old"), "node").where("component <> old").limit(1).count()
        now = fresh
        if not moved:
            return now
    raise RuntimeError("components did not settle")


def first_seen(hints: DataFrame, comps: DataFrame, order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """(component, ordinal): the place in the order of ``hints`` where any name of the component is seen first."""
    named = hints.withColumn("name", N.normalize_name(F.col("raw"))).where("name <> ''")
    least = named.groupBy("name").agg(F.min(F.struct(*order)).alias("ordinal"))
    return least.join(comps.withColumnRenamed("node", "name"), "name").groupBy("component").agg(F.min("ordinal").alias("ordinal"))


def assign_files(votes: DataFrame, comps: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """(file_path, component): the component with most votes; ties go to the one seen first (``seen`` as of ``first_seen``), then to the lesser label."""
    v = votes.join(comps.withColumnRenamed("node", "name"), "name").groupBy("file_path", "component").agg(F.round(F.sum("votes"), 9).alias("votes"))
    by = [F.desc("votes"), F.col("component")]
    if seen is not None:
        v, by = v.join(seen, "component", "left"), [by[0], F.asc_nulls_last("ordinal"), by[1]]
    n = F.row_number().over(Window.partitionBy("file_path").orderBy(*by))
    return v.withColumn("_n", n).where("_n = 1").select("file_path", "component")


def canonical(aliases: Column) -> Column:
    """The shortest alias, then the first by code point."""
    ordered = F.array_sort(F.transform(F.transform(aliases, lambda a: F.trim(a)), lambda a: F.struct(F.char_length(a).alias("n"), a.alias("a"))))
    return ordered[0]["a"]


def clusters(hints: DataFrame, threshold: float = THRESHOLD, order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """(canonical, aliases, file_paths, normalized_forms): end to end, with a cluster of its own for each file without a name.

    ``order``: columns of ``hints`` that say in which order they were seen, which decides ties of votes; where ``seq`` counts within a file,
    as in ``extract_hints``, it is (file_path, seq).
    """
    votes = written(name_votes(hints), "votes")
    names = votes.select(F.col("name").alias("node")).distinct()
    few = names.limit(FEW_NAMES + 1).count() <= FEW_NAMES
    comps = written(few_components(names, threshold) if few else name_components(names, threshold), "components")
    own = written(assign_files(votes, comps, first_seen(hints, comps, order)), "assigned")
    files = own.groupBy("component").agg(F.array_sort(F.collect_list("file_path")).alias("file_paths"))  # a file has one component
    forms = comps.join(name_aliases(hints), F.col("node") == F.col("name")).groupBy("component").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("aliases")))).alias("aliases"), F.array_sort(F.collect_list("node")).alias("normalized_forms"))
    main = files.join(forms, "component").select(canonical(F.col("aliases")).alias("canonical"), "aliases", "file_paths", "normalized_forms")
    rest = hints.select("file_path").distinct().join(own, "file_path", "left_anti")
    st = N.stem(F.col("file_path"))
    alone = rest.select(st.alias("canonical"), F.array(st).alias("aliases"), F.array("file_path").alias("file_paths"), F.array(N.normalize_ascii(st)).alias("normalized_forms"))
    return main.unionByName(alone)


# ---------------------------------------------------------------- overrides


def _regroup(c: DataFrame) -> DataFrame:
    """Clusters of one name become one; nothing is lost."""
    flat = lambda x: F.array_sort(F.array_distinct(F.flatten(F.collect_list(x)))).alias(x)
    return c.groupBy("canonical").agg(flat("aliases"), flat("file_paths"))


def apply_splits(c: DataFrame, splits: DataFrame) -> DataFrame:
    """Files named in ``splits`` (source, path, target) move to the target's cluster, in a single pass."""
    files = c.select("canonical", "aliases", F.explode("file_paths").alias("path"))
    s = splits.select(F.col("source").alias("canonical"), "path", "target")
    moved = files.join(s, ["canonical", "path"], "left")
    out = moved.select(F.coalesce("target", "canonical").alias("canonical"), F.when(F.col("target").isNull(), F.col("aliases")).otherwise(F.array("target")).alias("aliases"), F.array("path").alias("file_paths"))
    return _regroup(out)


def _merged(c: DataFrame, merges: DataFrame) -> DataFrame:
    """``c`` with target: the name after the merges, and together: what it is merged with (its group, or itself)."""
    hit = c.join(merges.withColumnRenamed("name", "canonical"), "canonical")
    n = hit.groupBy("group_id").agg(F.count(F.lit(1)).alias("k"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("aliases")))).alias("all"))
    first = merges.groupBy("group_id").agg(F.min_by("name", "pos").alias("first"))
    names = n.where("k >= 2").join(first, "group_id").select("group_id", F.when(F.array_contains("all", F.col("first")), F.col("first")).otherwise(canonical(F.col("all"))).alias("target"))
    to = merges.join(names, "group_id").select(F.col("name").alias("canonical"), "target", "group_id")
    return c.join(to, "canonical", "left").withColumns({"target": F.coalesce("target", "canonical"), "together": F.coalesce(F.concat(F.lit("group "), F.col("group_id").cast("string")), F.concat(F.lit("name "), "canonical"))})


def _renamed(c: DataFrame, renames: DataFrame) -> DataFrame:
    r = c.join(renames.withColumnRenamed("auto", "canonical"), "canonical", "left")
    return r.withColumns({"target": F.coalesce("new", "canonical"), "together": F.col("canonical")})


def apply_merges(c: DataFrame, merges: DataFrame) -> DataFrame:
    """Clusters of a group (group_id, pos, name) become one if two or more exist; the first name stays if it is an alias, else the canonical rule."""
    return _regroup(_merged(c, merges).select(F.col("target").alias("canonical"), "aliases", "file_paths"))


def apply_renames(c: DataFrame, renames: DataFrame) -> DataFrame:
    r = _renamed(c, renames)
    return _regroup(r.select(F.col("target").alias("canonical"), F.when(F.col("new").isNull(), F.col("aliases")).otherwise(F.array_union("aliases", F.array("new"))).alias("aliases"), "file_paths"))


def _united(step: DataFrame, what: str) -> DataFrame:
    """A warning for each name at which clusters meet that the step did not mean to join."""
    met = step.groupBy("target").agg(F.array_sort(F.collect_set("together")).alias("t"), F.array_sort(F.collect_set("canonical")).alias("names")).where(F.size("t") > 1)
    message = F.concat(F.lit(f"a {what} unites "), F.array_join("names", ", "))
    return met.select(F.col("target").alias("canonical"), F.lit("clusters").alias("field"), F.lit("warning").alias("severity"), message.alias("message"))


def decision_warnings(c: DataFrame, renames: DataFrame, merges: DataFrame, splits: DataFrame) -> DataFrame:
    """(canonical, field, severity, message): clusters that ``apply_decisions`` unites because they come to have one name."""
    parted = apply_splits(c, splits)
    return _united(_merged(parted, merges), "merge").unionByName(_united(_renamed(apply_merges(parted, merges), renames), "rename"))


def apply_decisions(c: DataFrame, renames: DataFrame, merges: DataFrame, splits: DataFrame) -> DataFrame:
    """Splits, then merges, then renames."""
    return apply_renames(apply_merges(apply_splits(c, splits), merges), renames)


def with_rename(renames: DataFrame, edits: DataFrame) -> DataFrame:
    """``edits`` (auto, new) over ``renames``; a blank or unchanged name clears."""
    kept = renames.join(edits.select("auto"), "auto", "left_anti")
    return kept.unionByName(edits.where("trim(new) <> '' and new <> auto").select("auto", F.trim("new").alias("new")))


def with_merge(merges: DataFrame, group: DataFrame) -> DataFrame:
    """A new group of distinct names (pos, name), trimmed and not blank; older groups that hold one of them go. Fewer than two names change nothing."""
    g = group.withColumn("name", F.trim("name")).where("name <> ''").groupBy("name").agg(F.min("pos").alias("pos"))
    if g.limit(2).count() < 2:
        return merges.select("group_id", "pos", "name")
    stale = merges.join(g.select("name"), "name", "left_semi").select("group_id").distinct()
    new_id = merges.agg(F.coalesce(F.max("group_id"), F.lit(-1)) + 1).first()[0]
    kept = merges.join(stale, "group_id", "left_anti").select("group_id", "pos", "name")
    return kept.unionByName(g.select(F.lit(new_id).cast(merges.schema["group_id"].dataType).alias("group_id"), "pos", "name"))


def with_split(splits: DataFrame, edits: DataFrame) -> DataFrame:
    """``edits`` (source, path, target) in place of what ``splits`` has of their sources; blank targets are dropped, so that a source with no other is cleared.

    Of several targets for one path the last by code point stays.
    """
    kept = splits.join(edits.select("source").distinct(), "source", "left_anti").select("source", "path", "target")
    fresh = edits.select("source", "path", F.trim("target").alias("target")).where("target <> ''").groupBy("source", "path").agg(F.max("target").alias("target"))
    return kept.unionByName(fresh)


def auto_name(shown: DataFrame, renames: DataFrame) -> DataFrame:
    """(canonical, auto): the automatic name behind a displayed one."""
    r = renames.select(F.col("new").alias("canonical"), "auto")
    return shown.join(r, "canonical", "left").withColumn("auto", F.coalesce("auto", "canonical"))
