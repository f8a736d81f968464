"""N-gram Jaccard join by signature trees.

Documents are sets of word shingles, held as 64-bit hashes; equal sets (128-bit fingerprints) are one representative.
Routing is lossless: two sets of Jaccard similarity t or more differ in at most d = floor(s*(1-t)/t) shingles, s being
the smaller size, so of over d hash ranges at least one holds the same shingles in both. Each set sends the digests
of its fuller ranges, under the range counts of the size classes its partners can be in; sets that share a digest are tied
to the least of them (a minimum by digest, aggregated before the shuffle) and so into coarse groups. Within a group
signature trees do the join: sorted by size, documents are leaves with token bitmaps,
inner nodes hold OR-combined bitmaps and size ranges, and a dual traversal drops node pairs whose largest
possible overlap is too small or whose documents are connected already. Pairs left are verified on their full sets.

Groups are cut into tiles of at most ``TILE`` documents and, by size class, about ``TILE_HASHES`` shingles; pairs of tiles
are tasks of bounded size that start from the links found inside tiles. Nothing is capped: all pairs of similar sets
end up in one component. A text is hashed once for its set and digests, and once more if it is in a coarse group.

Defined cases: null, empty and blank texts have no shingle and link with nothing; with fewer words than a shingle has,
the whole sequence is one; repeated rows are copies; rows that repeat an id with other texts are one node with the
links of each; rows without an id link with nothing and have no component; ties go to the smaller id; an empty table gives no
rows; texts are read whole, in windows, and words of any length are hashed as one; other input columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh3_64_intdigest

from .common import connected_components, materialize, small, with_global_index

WORDS, PERCENT = 3, 90
#: Sizes of a class reach from its bound to this many times it.
CLASS_RATIO = 1.6
#: Ranges beyond those needed, as a share of the most shingles that differ; so many of the emptiest are left out.
SPARE_RANGES = 0.2
TILE, LEAVES = 512, 8
#: Shingles of a tile, unless one document alone has more.
TILE_HASHES = 1 << 20
#: Shingles of small groups that share a task.
BUCKET_HASHES = 500_000
#: Fingerprints that a task remembers, so that it sends the digests of copies once; others are sent again.
REMEMBERED = 50_000
WINDOW_BYTES = 1 << 20

_rng = np.random.default_rng(20_011)
_SEED = int(_rng.integers(1, 1 << 63))
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_MULT = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def _mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scrambler of 64-bit words (public-domain splitmix finalizer constants)."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word's bytes, in order; the text is cut in windows that end where a word ends.

    A hash of whole words, not a polynomial modulo 2^64 by prefix sums, under which words of 2,048 letters can be built that
    collide for any base.
    """
    out, text, at = [], text.lower(), 0
    while at < len(text):
        gap = _SPACE.search(text, min(at + WINDOW_BYTES, len(text)))
        end = gap.start() if gap else len(text)
        words = text[at:end].split()
        out.append(np.fromiter(map(xxh3_64_intdigest, words, repeat(_SEED)), np.uint64, len(words)))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingle_set(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text."""
    w = word_hashes(text)
    if not len(w):
        return w
    n = min(words, len(w))
    total = np.full(len(w) - n + 1, n, np.uint64)
    for i in range(n):
        total = total + w[i : len(w) - n + 1 + i] * _MULT[i]
    return np.unique(_mix(total))


class Router:
    """Range digests under a similarity of ``percent`` / 100."""

    def __init__(self, percent: int, ratio: float = CLASS_RATIO):
        if not 50 < percent <= 100:
            raise ValueError("percent must be over 50 and at most 100")
        self.percent = percent
        bounds = [1]
        while bounds[-1] < 1 << 40:
            bounds.append(max(bounds[-1] + 1, int(bounds[-1] * max(ratio, 100 / percent + 0.01))))
        self.bounds = np.array(bounds)

    def classes(self, size: int) -> set[int]:
        """Classes in which the smaller set of a pair with a set of this size can be, the size itself included."""
        least = -(-size * self.percent // 100)
        return {int(c) for c in np.searchsorted(self.bounds, [least, size], "right") - 1}

    def most_apart(self, size: int) -> int:
        """Shingles in which sets of the similarity can differ if the smaller has this size."""
        return size * (100 - self.percent) // self.percent

    def ranges(self, c: int) -> int:
        """Hash ranges of a class: more than its sets can differ in, so that some can be left out."""
        d = self.most_apart(int(self.bounds[c + 1]) - 1)
        return d + 1 + int(SPARE_RANGES * d)

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        """Digests of the fuller ranges of a set, by class.

        Of n ranges n - d at least are the same in both sets of a pair. A set leaves out its emptiest ranges, fewer
        than n - d of them, by a bound on their fill; the larger of both sets' bounds still leaves a common one.
        """
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(hashes, 1), dtype=np.uint64)])
        out = []
        for c in sorted(self.classes(len(hashes))):
            n = self.ranges(c)
            step = (1 << 64) // n + 1
            cuts = np.searchsorted(hashes, np.arange(1, n, dtype=np.uint64) * np.uint64(step) if n > 1 else np.zeros(0, np.uint64))
            cuts = np.concatenate([[0], cuts, [len(hashes)]])
            fill = np.diff(cuts)
            d = self.most_apart(min(len(hashes), int(self.bounds[c + 1]) - 1))
            full = np.flatnonzero(fill >= np.partition(fill, n - d - 1)[n - d - 1])
            out.append(_mix((sums[cuts[full + 1]] - sums[cuts[full]]) ^ _mix(full.astype(np.uint64) + np.uint64(c << 40), 2), 3))
        return np.concatenate(out)


def _fingerprint(h: np.ndarray) -> tuple[int, int]:
    return tuple(int(_mix(h, s).sum(dtype=np.uint64).view(np.int64)) for s in (4, 5))


def shingle_sets(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(id, n, f1, f2, keys) of documents (id, text): set size, fingerprint and range digests; keys is null where the task sent them before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        router, seen = Router(percent), set()
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                marks, keys = [], []
                for v in part.column(1):
                    h = shingle_set((v.as_py() or "").encode(), words)
                    f1, f2 = _fingerprint(h)
                    marks.append((len(h), f1, f2))
                    mark = f1 << 64 ^ f2
                    if not len(h) or mark in seen:
                        keys.append(None)
                        continue
                    if len(seen) < REMEMBERED:
                        seen.add(mark)
                    keys.append(router.keys(h).view(np.int64))
                cols = [pa.array(list(c), pa.int64()) for c in zip(*marks)]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols, pa.array(keys, pa.list_(pa.int64()))], names=["id", "n", "f1", "f2", "keys"])

    return docs.mapInArrow(run, "id long, n long, f1 long, f2 long, keys array<long>")


def set_hashes(wanted: DataFrame, words: int) -> DataFrame:
    """(id, n, f1, f2, hashes) of documents (id, text, n, f1, f2) whose text has that set: its sorted hashes as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                own, hashes = [], []
                for i, (v, *mark) in enumerate(zip(part.column(1), *(part.column(k).to_pylist() for k in (3, 4)), strict=True)):
                    h = shingle_set((v.as_py() or "").encode(), words)
                    if _fingerprint(h) == tuple(mark):
                        own.append(i)
                        hashes.append(h.tobytes())
                kept = part.take(pa.array(own, pa.int64()))
                yield pa.RecordBatch.from_arrays([kept.column(0), *(kept.column(k) for k in (2, 3, 4)), pa.array(hashes, pa.binary())], names=["id", "n", "f1", "f2", "hashes"])

    return wanted.select("id", "text", "n", "f1", "f2").mapInArrow(run, "id long, n long, f1 long, f2 long, hashes binary")


class Tree:
    """Signature tree over sets sorted by size; level 0 holds the documents."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets])
        bits = 64
        while bits < 4 * self.size.max() and bits < 1 << 17:
            bits *= 2
        bitmap, row = np.zeros((len(sets), bits // 8), np.uint8), np.zeros(bits, bool)
        for i, s in enumerate(sets):
            at = (s & np.uint64(bits - 1)).astype(np.int64)
            row[at] = True
            bitmap[i] = np.packbits(row)
            row[at] = False
        bitmap = bitmap.view(np.uint64)
        spare = self.size - np.bitwise_count(bitmap).sum(axis=1, dtype=np.int64)  # shingles that share a bit
        #: Per level: bitmaps, least and largest size, most spare, first and last document.
        self.levels = [(bitmap, self.size, self.size, spare, np.arange(len(sets)), np.arange(1, len(sets) + 1))]
        while len(self.levels[-1][0]) > 1:
            b, lo, hi, sp, first, last = self.levels[-1]
            at = np.arange(0, len(b), LEAVES)
            top = lambda f, v: f.reduceat(v, at, axis=0)
            self.levels.append((top(np.bitwise_or, b), top(np.minimum, lo), top(np.maximum, hi), top(np.maximum, sp), first[at], top(np.maximum, last)))


def tree_join(sets: list[np.ndarray], percent: int, label: np.ndarray, left: int | None = None) -> list[tuple[int, int]]:
    """Links between sets (in order of size) that connect what ``label`` does not; with ``left``, only between the first so many and the rest.

    ``label`` is changed in place: documents of one component carry one label.
    """
    found: list[tuple[int, int]] = []
    trees = [(Tree(sets), 0)] * 2 if left is None else [(Tree(sets[:left]), 0), (Tree(sets[left:]), left)]
    if left is not None and trees[0][0].levels[0][0].shape[1] != trees[1][0].levels[0][0].shape[1]:
        both = Tree(sets)  # equal bitmaps for both sides
        trees = [_side(both, 0, left), _side(both, left, len(sets))]
    (a, at_a), (b, at_b) = trees
    stack = [(len(a.levels) - 1, 0, len(b.levels) - 1, 0)]
    while stack:
        p, i, q, j = stack.pop()
        if a is b and p == q and j < i:
            continue
        map_a, lo_a, hi_a, spare_a, first_a, last_a = (v[i] for v in a.levels[p])
        map_b, lo_b, hi_b, spare_b, first_b, last_b = (v[j] for v in b.levels[q])
        if a is b and first_b >= last_a and p != q and first_a > first_b:
            continue
        if max(lo_a, lo_b) * percent > min(hi_a, hi_b) * 100:
            continue
        own = np.concatenate([label[at_a + first_a : at_a + last_a], label[at_b + first_b : at_b + last_b]])
        if own.min() == own.max():
            continue
        overlap = int(np.bitwise_count(map_a & map_b).sum()) + min(spare_a, spare_b)
        if overlap * (100 + percent) < percent * (lo_a + lo_b):
            continue
        if p == 0 and q == 0:
            x, y = at_a + int(first_a), at_b + int(first_b)
            if x != y:
                s, t = sets[x], sets[y]
                where = np.searchsorted(s, t)
                where[where == len(s)] = 0
                both = int((s[where] == t).sum())
                if 100 * both >= percent * (len(s) + len(t) - both):
                    found.append((x, y))
                    label[label == label[y]] = label[x]
            continue
        if p >= q and p > 0:
            stack += [(p - 1, k, q, j) for k in range(i * LEAVES, min((i + 1) * LEAVES, len(a.levels[p - 1][0])))]
        else:
            stack += [(p, i, q - 1, k) for k in range(j * LEAVES, min((j + 1) * LEAVES, len(b.levels[q - 1][0])))]
    return found


def _side(tree: Tree, a: int, b: int) -> tuple[Tree, int]:
    side = Tree.__new__(Tree)
    side.size = tree.size[a:b]
    m, lo, hi, sp, _, _ = (v[a:b] for v in tree.levels[0])
    side.levels = [(m, lo, hi, sp, np.arange(b - a), np.arange(1, b - a + 1))]
    while len(side.levels[-1][0]) > 1:
        m, lo, hi, sp, first, last = side.levels[-1]
        at = np.arange(0, len(m), LEAVES)
        side.levels.append((np.bitwise_or.reduceat(m, at, axis=0), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(sp, at), first[at], np.maximum.reduceat(last, at)))
    return side, a


def _group_links(pdf: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links within each coarse group of a task, or between the two tiles of a task."""
    out: list[tuple[int, int]] = []
    for _, g in pdf.groupby("part", sort=False):
        across = g["x"].iloc[0] != g["y"].iloc[0]
        sets = [np.frombuffer(h, np.uint64) for h in g["hashes"]]
        size = g["n"].to_numpy()
        own = g["own"].to_numpy() if across else np.zeros(len(g), np.int64)
        ids = g["id"].to_numpy()
        order = np.lexsort((ids, size, own))
        sets, ids = [sets[i] for i in order], ids[order]
        label = g["label"].to_numpy()[order].copy()
        left = int((own == own.min()).sum()) if across else None
        out += [(int(ids[i]), int(ids[j])) for i, j in tree_join(sets, percent, label, left)]
    return pd.DataFrame(out, columns=["a", "b"]).astype(np.int64)


def coarse_edges(sets: DataFrame) -> DataFrame:
    """(a, b): each document that shares a range digest with others, and the least of these."""
    digests = sets.where("keys is not null").select("id", F.explode("keys").alias("key"))
    shared = digests.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("last")).where("a < last").select("key", "a")
    return digests.join(shared, "key").where("a <> id").select("a", F.col("id").alias("b")).distinct()


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, tile: int = TILE) -> DataFrame:
    """(id, n_shingles, component_id) per row of ``docs``."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sets = materialize(shingle_sets(rows, words, percent), "sets")
    equal, linked = ["f1", "f2", "n"], sets.where("n > 0 and id is not null")
    reps = materialize(linked.groupBy(*equal).agg(F.min("id").alias("rep")), "reps")
    rep_of = linked.select("id", *equal).distinct().join(reps, equal)

    # coarse groups: ties to the least document of each digest, over representatives
    chain = materialize(coarse_edges(linked), "chain")
    ids = rep_of.select("id", "rep").distinct()
    by_a, by_b = ids.select(F.col("id").alias("a"), F.col("rep").alias("ra")), ids.select(F.col("id").alias("b"), F.col("rep").alias("rb"))
    edges = chain.join(by_a, "a").join(by_b, "b").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    coarse = materialize(connected_components(edges).select(F.col("node").alias("id"), F.col("component").alias("part")), "coarse")

    # positions inside a coarse group, by size; tiles hold fewer documents the larger these are
    placed = materialize(with_global_index(coarse.join(rep_of.where("id = rep").select("id", *equal), "id"), ["part", "n", "id", "f1", "f2"]), "placed")
    begins = placed.groupBy("part").agg(F.min("pos").alias("begin"))
    size_class = F.floor(F.log2(F.col("n").cast("double"))).cast("long")
    rows_of = F.greatest(F.lit(1), F.least(F.lit(tile), F.floor(TILE_HASHES / F.pow(F.lit(2.0), size_class + 1))))
    own = F.when(rows_of < tile, size_class + 1).otherwise(F.lit(0)) * F.lit(1 << 40) + F.floor((F.col("pos") - F.col("begin")) / rows_of)
    placed = placed.join(begins, "part").select("id", "part", *equal, own.cast("long").alias("own"))
    spans = placed.groupBy("part").agg((F.min("own") == F.max("own")).alias("single"), F.sum("n").alias("weight"))
    placed = materialize(placed.join(spans.select("part", "single"), "part"), "tiles")
    stats = spans.agg(F.sum("weight"), F.min("single")).first()
    # an id with several sets ties their representatives
    several = ids.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("last")).where("a < last").select("id", "a")
    links = materialize(ids.join(several, "id").where("a <> rep").select("a", F.col("rep").alias("b")), "links")
    if not stats[0]:
        links = links if links.limit(1).count() else None
    else:
        wanted = small(placed.select("id", *equal), 32)
        hashes = set_hashes(rows.join(wanted, "id"), words).groupBy("id", *equal).agg(F.first("hashes").alias("hashes"))  # equal in repeated rows
        hashes = materialize(hashes, "hashes")
        buckets = max(1, int(stats[0] // BUCKET_HASHES))
        kinds = "a long, b long"
        join = lambda p: _group_links(p, percent)

        def tasks(t: DataFrame) -> DataFrame:
            shared = F.when(F.col("single"), F.pmod(F.xxhash64("part"), F.lit(buckets))).otherwise(F.col("part"))
            t = t.withColumn("task", shared).join(hashes, ["id", *equal])
            return t.groupBy("single", "task", "x", "y").applyInPandas(join, kinds)

        inside = placed.select("id", *equal, "part", "own", "single", F.col("own").alias("x"), F.col("own").alias("y"), F.col("id").alias("label"))
        links = links.union(materialize(tasks(inside), "links"))
        if not stats[1]:
            known = materialize(connected_components(links), "known")
            label = placed.where("not single").join(known, F.col("id") == F.col("node"), "left").withColumn("label", F.coalesce("component", "id"))
            # pairs of tiles (roots of two trees) whose size ranges allow a link and whose documents are not all of one component
            roots = label.groupBy("part", "own").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("label").alias("l0"), F.max("label").alias("l1"))
            x, y = (roots.select("part", F.col("own").alias(k), *[F.col(v).alias(f"{v}{k}") for v in ("lo", "hi", "l0", "l1")]) for k in "xy")
            pairs = x.join(y, "part").where(f"x < y and loy * {percent} <= hix * 100 and not (l0x = l1x and l0y = l1y and l0x = l0y)").select("part", "x", "y")
            pairs = pairs.select("part", "x", "y", F.explode(F.array("x", "y")).alias("own"))
            crossing = label.join(pairs, ["part", "own"]).select("id", *equal, "part", "own", "single", "x", "y", "label")
            links = materialize(links.union(tasks(crossing)), "links")

    out = sets.select("id", *equal).join(reps, equal, "left").withColumn("rep", F.when(F.col("id").isNotNull(), F.coalesce("rep", "id")))
    if links is not None:
        comps = materialize(connected_components(links), "components")
        out = out.join(comps, F.col("rep") == F.col("node"), "left").withColumn("rep", F.coalesce("component", "rep"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("rep").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, without those of a component that are not its smallest id."""
    found = similar_components(docs, id_col, text_col, words, percent)
    dropped = materialize(found.where(F.col("component_id") != F.col(id_col)).select(id_col).distinct(), "dropped")
    return docs.join(small(dropped), id_col, "left_anti").select(docs.columns)
