"""Benchmark decontamination: a broadcast hash set of normalised test n-grams against the token windows of training texts.

Words (see ``words``) are lower-cased; a window is ``width`` consecutive words of an item, or the whole of a shorter item. Each
task hashes the words of a text once and rolls the hash over windows of every length that the set holds; a table of
bits thins the windows out, and what passes is verified against the window's words themselves. Hit words are those inside any
occurrence of a window. Spans of them, or whole documents, are removed.

The set is broadcast in slices of at most ``SLICE_BYTES``, so that neither the driver nor a worker holds more than one
slice at a time however large the benchmark is; every text is held against every slice.

Defined cases: a null or empty text has no words and no hits; an item without words has no window; an item without id is
removed like any other but not named among ``items``; repeated items and texts give equal results; an empty benchmark
hits nothing, an empty table gives an empty result; columns of any name stay, results take underscores until their names are free.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F, types as T

from .common import free_name, materialize, slices
from .words import as_bytes, words

#: Words of a window.
WIDTH = 10
#: Bytes of windows, with ``ENTRY_BYTES`` for each, that are broadcast and held at once.
SLICE_BYTES, ENTRY_BYTES = 32 << 20, 200
#: The words of ``words`` in a text, for their places in code points.
_WORD = regex.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_STEP = np.uint64(0x9E3779B97F4A7C15)


class WindowSet:
    """Windows by their words, with a table of bits over their hashes for each length."""

    def __init__(self, entries: list[tuple[str | None, bytes]]):
        self.items: dict[bytes, list[str]] = {}
        for item, window in entries:
            found = self.items.setdefault(window, [])
            if item is not None:
                found.append(item)
        lengths: dict[int, list[bytes]] = {}
        for window in self.items:
            lengths.setdefault(window.count(b" ") + 1, []).append(window)
        self.shift, self.seen = {}, {}
        for k, held in lengths.items():
            bits = min(24, max(16, (16 * len(held)).bit_length()))
            self.shift[k] = np.uint64(64 - bits)
            self.seen[k] = np.zeros(1 << bits, bool)
            for window in held:
                h = list(rolled(word_hashes(window.split(b" ")), k))[-1][1]
                self.seen[k][(h * _STEP) >> self.shift[k]] = True
        self.longest = max(lengths, default=0)

    def hits(self, text: list[bytes], hashes: np.ndarray) -> Iterator[tuple[int, int, list[str]]]:
        """(first word, number of words, items) of each window that occurs in the words of a text."""
        for k, h in rolled(hashes, self.longest):
            if k in self.seen:
                for at in np.flatnonzero(self.seen[k][(h * _STEP) >> self.shift[k]]).tolist():
                    found = self.items.get(b" ".join(text[at:at + k]))
                    if found is not None:
                        yield at, k, found


def word_hashes(text: list[bytes]) -> np.ndarray:
    """One 64-bit hash a word, the same within a process."""
    return np.fromiter(map(hash, text), np.int64, len(text)).view(np.uint64)


def rolled(hashes: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray]]:
    """(k, the hashes of all windows of k words) for k from 1 as far as the text reaches."""
    h = hashes
    for k in range(1, min(longest, len(hashes)) + 1):
        if k > 1:
            h = h[:-1] * _STEP + hashes[k - 1:]
        yield k, h


def _windows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for item, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)).to_pylist()):
                w = words(text)
                k = min(width, len(w))
                for at in range(0, len(w) - k + 1 if w else 0, 65_536):
                    some = [b" ".join(w[i:i + k]) for i in range(at, min(at + 65_536, len(w) - k + 1))]
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(some), pa.string()), pa.array(some, pa.binary())], names=["item", "window"])

    return run


def windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(item string, window binary): the distinct windows of every item, written once."""
    narrow = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))
    return materialize(narrow.mapInArrow(_windows(width), "item string, window binary").distinct(), "windows")


class Slice(NamedTuple):
    key: str
    entries: Broadcast


def broadcast_slices(found: DataFrame, slice_bytes: int = SLICE_BYTES) -> list[Slice]:
    """The windows as broadcast lists of (item, window), each of about ``slice_bytes`` at most."""
    total = found.agg(F.sum(F.length("window") + ENTRY_BYTES)).first()[0] or 0
    n, sc = -(-total // slice_bytes), found.sparkSession.sparkContext
    part = F.pmod(F.xxhash64("item", "window"), F.lit(max(1, n)))
    lists = ([(r["item"], bytes(r["window"])) for r in found.where(part == k).collect()] for k in range(n))
    return [Slice(uuid.uuid4().hex, sc.broadcast(entries)) for entries in lists]


_HELD: dict[str, WindowSet] = {}


def _held(part: Slice) -> WindowSet:
    """The set of a slice; a worker keeps one."""
    if part.key not in _HELD:
        _HELD.clear()
        _HELD[part.key] = WindowSet(part.entries.value)
        vars(part.entries).pop("_value", None)  # the list itself is loaded again if it is asked for
    return _HELD[part.key]


def hit_runs(hit: np.ndarray) -> list[tuple[int, int]]:
    """(first, end) of the runs of true."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def spans_of(text: str, hit: np.ndarray) -> list[tuple[int, int]]:
    """Code points of the runs of hit words, from the first one's start to the last one's end."""
    at = [m.span() for m in _WORD.finditer(text)]
    return [(at[a][0], at[b - 1][1]) for a, b in hit_runs(hit)]


def without(text: str, spans: list[tuple[int, int]]) -> str:
    ends = [0, *[b for _, b in spans]]
    return "".join(text[a:b] for a, b in zip(ends, [*[a for a, _ in spans], len(text)]))


RESULT = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
    T.StructField("rest", T.StringType()),
])


def scan(docs: DataFrame, parts: list[Slice], text_col: str = "text", with_spans: bool = False) -> DataFrame:
    """``docs`` without their text, and n_words, n_hit, items (sorted); narrow, in one pass over the texts.

    ``parts`` comes from ``broadcast_slices``. With ``with_spans`` also spans (code points of runs of hit words) and rest: the text
    without them.
    """
    kept = [c for c in docs.columns if c != text_col]
    names = [free_name(f.name, kept) for f in RESULT]
    fields = [T.StructField(n, f.dataType) for n, f in zip(names, RESULT)][: 5 if with_spans else 3]
    schema = T.StructType([*(docs.schema[c] for c in kept), *fields])
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256 if len(parts) < 2 else 4096):
            raw = as_bytes(batch.column(len(kept))).to_pylist()
            hit, items, counts = [None] * len(raw), [set() for _ in raw], [0] * len(raw)
            for part in parts:
                held = _held(part)
                for i, text in enumerate(raw):
                    w = words(text)
                    counts[i] = len(w)
                    for at, k, of in held.hits(w, word_hashes(w)):
                        if hit[i] is None:
                            hit[i] = np.zeros(len(w), bool)
                        hit[i][at:at + k] = True
                        items[i].update(of)
            if not parts:
                counts = [len(words(text)) for text in raw]
            out = [
                *batch.columns[: len(kept)], pa.array(counts, pa.int64()), pa.array([0 if h is None else int(h.sum()) for h in hit], pa.int64()),
                pa.array([sorted(x) for x in items], pa.list_(pa.string())),
            ]
            if with_spans:
                texts = [None if t is None else t.decode() for t in raw]
                spans = [[] if h is None else spans_of(t, h) for t, h in zip(texts, hit)]
                out += [
                    pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], span_type),
                    pa.array([t if t is None else without(t, s) for t, s in zip(texts, spans)], pa.string()),
                ]
            yield pa.RecordBatch.from_arrays(out, names=[f.name for f in schema])

    return docs.select(*kept, F.col(text_col).cast("string").alias(free_name("text", kept))).mapInArrow(run, schema)


def remove_spans(docs: DataFrame, parts: list[Slice], text_col: str = "text") -> DataFrame:
    """``docs`` with the runs of hit words taken out of their texts; all other columns and every row stay."""
    found = scan(docs, parts, text_col, with_spans=True)
    rest = free_name("rest", [c for c in docs.columns if c != text_col])
    return found.select(*[F.col(rest).alias(c) if c == text_col else F.col(c) for c in docs.columns])


def drop_documents(docs: DataFrame, parts: list[Slice], most: float = 0.0, text_col: str = "text") -> DataFrame:
    """``docs`` of whose words at most the share ``most`` is hit; rows and columns stay as they are."""
    mine = free_name("text_", docs.columns)
    found = scan(docs.withColumn(mine, F.col(text_col)), parts, mine)
    n, hit = (free_name(c, docs.columns) for c in ("n_words", "n_hit"))
    return found.where(F.col(hit) <= most * F.col(n)).select(docs.columns)
