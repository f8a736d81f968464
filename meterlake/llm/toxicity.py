"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a probability from a logistic model over hashed words and
word pairs; noisy-or combines them: score = 1 - prod(1 - p). Only document labels are known; gradients flow through
the noisy-or to the sentences, so the model learns which sentences offend and can locate them.

The model is fitted on a bounded sample of labelled documents (``sample``, each of at most ``SAMPLE_CHARS`` characters), on
the driver, as a vector of ``BUCKETS`` weights; scoring is a narrow map over whole texts.

Defined cases: null and empty texts have no sentence and get the score of a bag of none, 0; equal texts get equal
scores; without labelled rows every score is 0, with rows of one label only all texts that have a sentence get that label;
an id with several labels has the highest, one with several texts is learned from the least of them, and every row
is scored by its own text; an empty table gives no rows; other input columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import slices

#: Hash buckets of the sentence features.
BUCKETS = 1 << 18
#: Most labelled documents that the model is fitted on: those whose ids hash lowest, so that reruns agree.
SAMPLE = 6000
#: Longer documents are not in the sample.
SAMPLE_CHARS = 20_000
#: Words that a task remembers; others are looked up anew.
CACHE_WORDS = 100_000
#: Sentences end here; a text without any is one sentence. Sentences of over so many words are cut.
SENTENCE = re.compile(r"[.!?\n]+")
LONGEST = 40
#: Lengths of word beginnings that are features; features in fewer than this share of the sample are not learned.
PREFIXES = (4, 5)
RARE = 0.004
WORD = re.compile(r"[^\W\d_]+")


class Features:
    """Buckets of a word: itself and its beginnings, so that inflected forms share weight; remembered per process."""

    def __init__(self, limit: int = 300_000):
        self.known: dict[str, tuple[int, ...]] = {}
        self.limit = limit

    def buckets(self, word: str) -> tuple[int, ...]:
        b = self.known.get(word)
        if b is None:
            b = tuple({zlib.crc32(f.encode()) % BUCKETS for f in (f"={word}", *(word[:n] for n in PREFIXES if len(word) > n))})
            if len(self.known) < self.limit:
                self.known[word] = b
        return b


def sentences(text: str) -> list[str]:
    """Non-empty sentences, in order; long ones in cuts of ``LONGEST`` words."""
    out = []
    for s in SENTENCE.split(text):
        if len(s) > 2 * LONGEST and len(words := s.split()) > LONGEST:
            out += [" ".join(words[i : i + LONGEST]) for i in range(0, len(words), LONGEST)]
        elif s.strip():
            out.append(s)
    return out


def bag(text: str, feats: Features) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words of a text and the index of the sentence of each."""
    ids, owner = [], []
    for k, s in enumerate(sentences(text.lower())):
        got = {b for w in set(WORD.findall(s)) for b in feats.buckets(w)}
        ids += got
        owner += [k] * len(got)
    return np.array(ids, np.int64), np.array(owner, np.int64)


def bag_gradient(z: np.ndarray, y: float) -> tuple[float, np.ndarray]:
    """The noisy-or of sentences with log odds ``z``, and the slope of its log loss under label ``y`` by each of them."""
    p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    log_none = np.log1p(-np.minimum(p, 1 - 1e-12)).sum()
    score = -np.expm1(log_none)
    # p_k for a clean document; -p_k * (1 - score) / score for a toxic one
    return float(score), p if y == 0 else -p * np.exp(log_none) / max(score, 1e-9)


def fit(texts: list[str], labels: list[int], epochs: int = 12, rate: float = 0.5, decay: float = 1e-3, seed: int = 7) -> np.ndarray:
    """Weights of the buckets and, last, the bias: AdaGrad on the log loss of the noisy-or."""
    weights = np.zeros(BUCKETS + 1)
    weights[-1] = -7.0
    if len(set(labels)) < 2:
        weights[-1] = np.inf if labels and labels[0] else -np.inf
        return weights
    feats = Features()
    bags = [bag(t, feats) for t in texts]
    common = sum(np.bincount(np.unique(ids), minlength=BUCKETS) for ids, _ in bags) >= max(3, RARE * len(bags))
    n_sent = [int(o[-1]) + 1 if len(o) else 0 for _, o in bags]
    bags = [(ids[common[ids]], owner[common[ids]]) for ids, owner in bags]
    squares = np.full(BUCKETS + 1, 1e-2)
    order = np.random.default_rng(seed)
    y = np.asarray(labels, np.float64)
    for _ in range(epochs):
        for i in order.permutation(len(bags)):
            ids, owner = bags[i]
            if not n_sent[i]:
                continue
            _, g = bag_gradient(np.bincount(owner, weights[ids], n_sent[i]) + weights[-1], y[i])
            if np.abs(g).max() < 1e-4:
                continue
            grad = g[owner] + decay * weights[ids]
            np.add.at(squares, ids, grad * grad)
            np.subtract.at(weights, ids, rate * grad / np.sqrt(squares[ids]))
            total = g.sum()
            squares[-1] += total * total
            weights[-1] -= 0.1 * rate * total / np.sqrt(squares[-1])
    return weights


def is_held_out(id_col: str):
    return (F.crc32(F.col(id_col).cast("string").cast("binary")) % 5) == 0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> np.ndarray:
    """Weights from at most ``sample`` labelled documents that are not held out; half of them of each label where there are as many."""
    marked = labels.where(F.col(label_col).isin(0, 1) & ~is_held_out(id_col)).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_y"))
    parts = []
    for y in (0, 1):  # two bounded top-k selections over ids alone
        parts.append(marked.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(sample // 2))
    chosen = F.broadcast(parts[0].unionByName(parts[1]))  # at most ``sample`` ids
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_t")).where(F.coalesce(F.char_length("_t"), F.lit(0)) <= SAMPLE_CHARS)
    rows = rows.join(chosen, "_id").groupBy("_id").agg(F.min("_t").alias("_t"), F.max("_y").alias("_y"))
    got = sorted(((r["_id"], r["_t"] or "", int(r["_y"])) for r in rows.toLocalIterator()))
    return fit([t for _, t, _ in got], [y for _, _, y in got])


class Scorer:
    def __init__(self, weights: np.ndarray):
        self.bias = float(weights[-1])
        used = np.flatnonzero(weights[:-1])
        self.weight = dict(zip(used.tolist(), weights[used].tolist()))
        self.by_word: dict[str, tuple] = {}
        self.feats = Features(0)

    def sentence(self, s: str) -> float:
        """Probability that a sentence (lower case) offends."""
        look, z, seen = self.by_word, self.bias, None
        for w in WORD.findall(s):
            v = look.get(w)
            if v is None:
                v = tuple((b, self.weight[b]) for b in self.feats.buckets(w) if b in self.weight)
                if len(look) < CACHE_WORDS:
                    look[w] = v
            if v:
                seen = seen or {}
                seen.update(v)
        if seen:
            z += sum(seen[b] for b in sorted(seen))
        return 1 / (1 + float(np.exp(-z))) if z > -30 else 0.0

    def score(self, text: str) -> float:
        none = 0.0
        for s in sentences(text.lower()):
            p = self.sentence(s)
            if p > 1e-12:
                none += float(np.log1p(-min(p, 1 - 1e-12)))
        return -float(np.expm1(none))

    def locate(self, text: str, least: float = 0.5) -> list[tuple[str, float]]:
        """Offending sentences (lower case) and their probabilities."""
        return [(s, p) for s in sentences(text.lower()) if (p := self.sentence(s)) >= least]


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text", locate: bool = False) -> DataFrame:
    """(id, score, offending): probability of each whole text, and its offending sentences if ``locate``."""
    used = np.flatnonzero(weights[:-1])
    packed = (used.astype(np.int32), weights[used].astype(np.float32), float(weights[-1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = np.zeros(BUCKETS + 1)
        full[packed[0]], full[-1] = packed[1], packed[2]
        scorer = Scorer(full)
        for batch in batches:
            scores, found = [], []
            for v in batch.column(1):
                text = v.as_py() or ""
                scores.append(scorer.score(text))
                found.append([x for x, _ in scorer.locate(text)] if locate else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(found, pa.list_(pa.string()))], names=["id", "score", "offending"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, score double, offending array<string>")
    return out.withColumnRenamed("id", id_col)


def keep_clean(docs: DataFrame, weights: np.ndarray, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below ``threshold``."""
    at = docs.columns.index(text_col)
    used = np.flatnonzero(weights[:-1])
    packed = (used.astype(np.int32), weights[used].astype(np.float32), float(weights[-1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = np.zeros(BUCKETS + 1)
        full[packed[0]], full[-1] = packed[1], packed[2]
        scorer = Scorer(full)
        for batch in slices(batches):
            yield batch.filter(pa.array([scorer.score(v.as_py() or "") < threshold for v in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
