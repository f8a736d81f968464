"""Ranked lexical search of many queries at once, by common-subexpression evaluation over a query-sharing DAG.

The items (queries) are sets of terms with repeats. Terms that occur in the same items, and pairs of such sets that occur
together in many items, become nodes: sums of partial scores that several items need. One pass over the documents keeps of each its
length and the frequencies of query terms (a compact table, written once); its counts give the weights. A second pass takes blocks of
documents: every node's accumulator is made once a block, in the order of the DAG, and items combine the accumulators they
share. A task keeps the best documents of each item; a window over these few ranks them.

Items are taken in slices of at most ``EDGES`` (item, term) pairs, whole items each, and every document is held against every
slice: the driver and the workers hold one slice's terms and nodes, however many items there are.

Defined cases: null or empty texts have no terms and are never found; items without terms give no rows; rows that share an item id are items
of their own and ranked apart; repeated documents rank apart, by ascending id, a null id last; an empty table on either side gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import materialize, slices
from .words import as_bytes, words

#: (item, term) pairs of a slice of items.
EDGES = 400_000
#: Numbers in the accumulators of a block of documents.
BLOCK_NUMBERS = 2_000_000
#: Sets of an item that are paired with each other when shared ones are mined; the rest are added one by one.
PAIRED = 128


@dataclass
class Sharing:
    """Rows: first the symbols (term, repeats), then the nodes, each the sum of earlier rows; ``items``: the rows each item sums."""

    symbols: list[tuple[int, int]]
    nodes: list[list[int]] = field(default_factory=list)
    items: list[list[int]] = field(default_factory=list)

    def additions(self) -> int:
        """Sums of two rows that a block of documents takes."""
        return sum(len(x) - 1 for x in [*self.nodes, *self.items] if x)


def share(queries: list[dict[int, int]], paired: int = PAIRED) -> Sharing:
    """Mine what ``queries`` (term to repeats, each) have in common."""
    where: dict[tuple[int, int], list[int]] = {}
    for k, q in enumerate(queries):
        for symbol in sorted(q.items()):
            where.setdefault(symbol, []).append(k)
    out = Sharing(sorted(where))
    row = {s: i for i, s in enumerate(out.symbols)}
    own: list[list[int]] = [[] for _ in queries]  # rows that only this item has
    sets: list[set[int]] = [set() for _ in queries]
    together: dict[tuple[int, ...], list[int]] = {}
    for s in out.symbols:
        together.setdefault(tuple(where[s]), []).append(row[s])

    def node(rows: list[int]) -> int:
        out.nodes.append(rows)
        return len(out.symbols) + len(out.nodes) - 1

    for items, rows in together.items():
        if len(items) == 1:
            own[items[0]] += rows
        else:  # terms of the same items are one shared set
            shared = rows[0] if len(rows) == 1 else node(rows)
            for k in items:
                sets[k].add(shared)
    _pair_up(sets, node, paired)
    out.items = [sorted(s) + o for s, o in zip(sets, own)]
    return out


def _pair_up(sets: list[set[int]], node, paired: int) -> None:
    """Replace the pair of rows that most sets hold by a node of its own, again and again, while three sets hold one."""
    held = Counter(x for s in sets for x in s)
    active = [set(sorted(s, key=lambda x: (-held[x], x))[:paired]) for s in sets]
    at: dict[int, set[int]] = {}
    counts: Counter[tuple[int, int]] = Counter()
    for k, s in enumerate(active):
        counts.update(combinations(sorted(s), 2))
        for x in s:
            at.setdefault(x, set()).add(k)
    heap = [(-c, p) for p, c in counts.items() if c > 2]
    heapq.heapify(heap)
    while heap:
        c, (a, b) = heapq.heappop(heap)
        now = counts[a, b]
        if now != -c:
            if now > 2:
                heapq.heappush(heap, (-now, (a, b)))
            continue
        new, both = node([a, b]), at[a] & at[b]
        grown: set[int] = set()
        for k in both:
            s = active[k]
            s -= {a, b}
            sets[k] -= {a, b}
            for x in s:
                counts[min(x, a), max(x, a)] -= 1
                counts[min(x, b), max(x, b)] -= 1
                counts[x, new] += 1
                grown.add(x)
            s.add(new)
            sets[k].add(new)
        at[a] -= both
        at[b] -= both
        at[new] = set(both)
        counts[a, b] -= len(both)
        for x in grown:
            if counts[x, new] > 2:
                heapq.heappush(heap, (-counts[x, new], (x, new)))


# ---------------------------------------------------------------- passes


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        for row, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)).to_pylist()):
            found = Counter(words(text))
            yield pa.RecordBatch.from_arrays([pa.array([row] * len(found), pa.int64()), pa.array(list(found), pa.binary()), pa.array(found.values(), pa.int64())], names=["row", "term", "repeats"])


def _frequencies(terms):
    """Of each text its number of terms, and the query terms in it (places in the vocabulary, ascending) with their frequencies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {t: i for i, t in enumerate(terms.value)}
        known = place.keys()
        for batch in slices(batches):
            sizes, found = [], []
            for text in as_bytes(batch.column(1)).to_pylist():
                w = words(text)
                counts = Counter(w)
                sizes.append(len(w))
                found.append(sorted((place[t], counts[t]) for t in counts.keys() & known))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(sizes, pa.int64()), pa.array([[i for i, _ in f] for f in found], pa.list_(pa.int32())),
                pa.array([[n for _, n in f] for f in found], pa.list_(pa.int32())),
            ], names=["id", "n", "terms", "freqs"])

    return run


def lengths(n: list[int], documents: int, total: int) -> np.ndarray:
    """m of documents of n terms."""
    return np.array([25 + 75 * x * documents // total for x in n], np.int64)


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


class Evaluator:
    """Scores of all items for blocks of documents."""

    def __init__(self, plan: Sharing, weights: list[int], documents: int, total: int):
        self.plan, self.weights, self.documents, self.total = plan, np.array(weights, np.int64), documents, total
        self.base = len(weights)  # a row for each term as it stands once, then the plan's rows
        self.rows = self.base + len(plan.symbols) + len(plan.nodes)
        self.symbol_terms = np.array([t for t, _ in plan.symbols], np.int64)
        self.repeats = np.array([r for _, r in plan.symbols], np.int64)[:, None]
        self.sums = [np.array(x, np.int64) + self.base for x in plan.nodes]
        self.items = [np.array(x, np.int64) + self.base for x in plan.items]
        self.block = max(16, BLOCK_NUMBERS // max(1, self.rows + len(self.items)))

    def scores(self, n: list[int], sizes: np.ndarray, terms: np.ndarray, freqs: np.ndarray) -> np.ndarray:
        """(items, documents): ``sizes`` of the documents' stretches of ``terms`` and ``freqs``."""
        acc = np.zeros((self.rows, len(n)), np.int64)
        doc, tf = np.repeat(np.arange(len(n)), sizes), freqs.astype(np.int64)
        m = lengths(n, self.documents, self.total)
        acc[terms, doc] = self.weights[terms] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
        acc[self.base:self.base + len(self.symbol_terms)] = acc[self.symbol_terms] * self.repeats
        for row, parts in enumerate(self.sums, self.base + len(self.plan.symbols)):
            acc[parts].sum(0, out=acc[row])
        return np.stack([acc[x].sum(0) for x in self.items]) if self.items else np.zeros((0, len(n)), np.int64)


def _best(given, k: int):
    """The k best documents of each item in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evaluator: Evaluator = given.value[0]
        best: list[list[tuple]] = [[] for _ in evaluator.items]
        kind = pa.int64()
        for batch in slices(batches, evaluator.block):
            kind = batch.column(0).type
            ids, terms, freqs = batch.column(0).to_pylist(), batch.column(2), batch.column(3)
            sizes = np.diff(terms.offsets.to_numpy())
            got = evaluator.scores(batch.column(1).to_pylist(), sizes, terms.flatten().to_numpy(), freqs.flatten().to_numpy())
            for j, s in enumerate(got):
                at = np.flatnonzero(s >= (-best[j][-1][0] if len(best[j]) == k else 1))
                if len(at) > 4 * k:
                    at = at[s[at] >= np.partition(s[at], len(at) - k)[len(at) - k]]
                if len(at):
                    best[j] = heapq.nsmallest(k, best[j] + [(-int(s[i]), ids[i] is None, 0 if ids[i] is None else ids[i]) for i in at])
        rows = [(j, None if void else key, -score) for j, b in enumerate(best) for score, void, key in b]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], kind), pa.array([r[2] for r in rows], pa.int64())], names=["item", "id", "score"])

    return run


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", edges: int = EDGES) -> DataFrame:
    """(item, rank int, id, score): the k best documents of every item with a score above 0."""
    numbered = materialize(items.select(F.monotonically_increasing_id().alias("row"), F.col(item_col).alias("item_id"), F.col(item_text_col).cast("string").alias("text")), "items")
    asked = materialize(numbered.select("row", "text").mapInArrow(_item_terms, "row long, term binary, repeats long"), "asked")
    parts = max(1, -(-asked.count() // edges))
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    found = [_search(narrow, asked.where(F.pmod(F.xxhash64("row"), F.lit(parts)) == p), k) for p in range(parts)]
    best = reduce(DataFrame.unionByName, found)
    order = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(numbered.select("row", "item_id"), "row").select(F.col("item_id").alias(item_col), "rank", F.col("id").alias(id_col), "score")


def _search(docs: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(row, id, score): the best documents of one slice of items, k or more of each."""
    spark, kind = docs.sparkSession, docs.schema["id"].dataType.simpleString()
    queries: dict[int, dict[bytes, int]] = {}
    for r in asked.collect():
        queries.setdefault(r["row"], {})[bytes(r["term"])] = r["repeats"]
    rows, terms = sorted(queries), sorted({t for q in queries.values() for t in q})
    compact = materialize(docs.mapInArrow(_frequencies(spark.sparkContext.broadcast(terms)), f"id {kind}, n long, terms array<int>, freqs array<int>").where("n > 0"), "terms")
    documents, total = compact.agg(F.count(F.lit(1)), F.sum("n")).first()
    holding = dict(compact.select(F.explode("terms").alias("t")).groupBy("t").count().collect())  # a row for each term of the slice
    place = {t: i for i, t in enumerate(terms)}
    plan = share([{place[t]: n for t, n in queries[r].items() if place[t] in holding} for r in rows])
    evaluator = Evaluator(plan, [weight(documents, holding.get(i, 0)) for i in range(len(terms))], documents, total)
    best = compact.where(F.size("terms") > 0).mapInArrow(_best(spark.sparkContext.broadcast([evaluator]), k), f"item long, id {kind}, score long")
    numbers = spark.createDataFrame(list(enumerate(rows)), "item long, row long")
    return best.join(F.broadcast(numbers), "item").select("row", "id", "score")  # bounded by the slice
