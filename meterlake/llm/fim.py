"""Fill-in-the-middle transformation over indexable skip lists.

A text is a list of runs: a run of letters is one unit, a run of other characters is as many units as it has code points. The
runs form a skip list whose towers have geometric heights drawn from a hash of the place; every lane carries for each of its
links how many units and how many code points it passes. A cut by its rank in units is found from the top lane down by
accumulated unit widths, and the code points passed on the way give its place in the text; both cuts of a document
come from one list, exactly.

Defined cases: a null text is an empty one; an empty text, or one that contains a sentinel, stays plain; a null id takes part in the
hash as an empty text; repeated rows give equal results; an empty table gives an empty result; other columns stay.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import free_name, slices

PREFIX, SUFFIX, MIDDLE = SENTINELS = ("<P>", "<S>", "<M>")
#: One tower in so many (a power of two) reaches the next lane.
SPARSE = 8
#: Shares in percent: texts that are transformed, and those of them whose suffix comes first.
RATE, SUFFIX_FIRST = 90, 20


class SkipList:
    """The runs of a text; ``lanes[k]``: unit widths, code-point widths and the place of each tower in the lane below."""

    def __init__(self, text: str, sparse: int = SPARSE):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = ((codes | 32) - 97) < 26
        edge = np.flatnonzero(letter[1:] != letter[:-1]) + 1
        starts = np.concatenate([[0], edge])[: len(codes)]
        chars = np.diff(np.concatenate([starts, [len(codes)]]))
        units = np.where(letter[starts], 1, chars)
        self.lanes = [(units, chars, None)]
        height = towers(len(units), sparse)
        place = np.arange(len(units))
        for k in range(1, int(height.max(initial=0)) + 1):
            up = np.flatnonzero(height[place] >= k)
            up = up if len(up) and up[0] == 0 else np.concatenate([[0], up])  # the head is as tall as the list
            self.lanes.append((np.add.reduceat(self.lanes[-1][0], up), np.add.reduceat(self.lanes[-1][1], up), up))
            place = place[up]
        self.units = int(self.lanes[-1][0].sum())

    def seek(self, rank: int) -> int:
        """Code points before the unit of this rank (0 to ``units``)."""
        at = passed = point = 0
        for units, chars, below in reversed(self.lanes):
            while at < len(units) and passed + units[at] <= rank:
                passed, point, at = passed + int(units[at]), point + int(chars[at]), at + 1
            if at == len(units):
                return point
            if below is not None:
                at = int(below[at])
        return point + rank - passed  # inside a run of single code points


def towers(n: int, sparse: int = SPARSE) -> np.ndarray:
    """Heights of the towers at places 0 to n - 1: k or more for one in ``sparse`` to the power of k."""
    h = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    low = (h & (~h + np.uint64(1))).astype(np.float64)  # the lowest bit that is set
    bits = np.log2(low, where=low > 0, out=np.full(n, 63.0))
    return (bits // (sparse.bit_length() - 1)).astype(np.int64)


def draws(doc_id: int | None, seed: str) -> list[int]:
    """Four numbers from the hash of seed and id."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(h[i:i + 8], 16) for i in range(0, 32, 8)]


def transform(text: str, doc_id: int | None, seed: str = "1", rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, code points of the prefix, of the middle, output)."""
    listed = SkipList(text)
    n, (h1, h2, h3, h4) = listed.units, draws(doc_id, seed)
    if not text or any(s in text for s in SENTINELS) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    a, b = (listed.seek(r) for r in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < suffix_first:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restore(output: str, form: str) -> str:
    """The text from which ``transform`` made ``output``."""
    if form == "plain":
        return output
    second = output.index(PREFIX if form == "spm" else SUFFIX)
    third = output.index(MIDDLE, second)
    first, then, middle = output[3:second], output[second + 3:third], output[third + 3:]
    return then + middle + first if form == "spm" else first + middle + then


RESULT = T.StructType([
    T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()),
    T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType()), T.StructField("restored", T.StringType()),
])
#: Characters of texts that a task rewrites at once.
CHARS_AT_ONCE = 4 << 20


def _some(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    """Small batches: of few rows, and of one where the texts are long."""
    for batch in slices(batches):
        if batch.column(at).nbytes <= CHARS_AT_ONCE:
            yield batch
        else:
            yield from (batch.slice(i, 1) for i in range(batch.num_rows))


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = "1", rate: int = RATE, suffix_first: int = SUFFIX_FIRST, digests: bool = False,
) -> DataFrame:
    """``docs`` without their text, and n, form, prefix_chars, middle_chars, output, restored; a narrow map.

    ``restored`` is rebuilt from output and form. With ``digests`` these two are the hex sha256 of their UTF-8 bytes, so that no
    text leaves the worker.
    """
    kept = [c for c in docs.columns if c != text_col]
    schema = T.StructType([*(docs.schema[c] for c in kept), *(T.StructField(free_name(f.name, kept), f.dataType) for f in RESULT)])
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    at, shown = len(kept), (lambda s: hashlib.sha256(s.encode()).hexdigest()) if digests else str

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _some(batches, at):
            rows = []
            for key, text in zip(batch.column(kept.index(id_col)).to_pylist(), batch.column(at).to_pylist()):
                n, form, prefix, middle, output = transform(text or "", key, seed, rate, suffix_first)
                rows.append((n, form, prefix, middle, shown(output), shown(restore(output, form))))
            made = [pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], *made], names=[f.name for f in schema])

    return docs.select(*kept, F.col(text_col).cast("string").alias(free_name("text", kept))).mapInArrow(run, schema)
