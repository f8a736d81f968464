"""Token counts by heap-and-linked-list byte-pair merging.

The symbols of a pre-token form a linked list; a heap holds the adjacent pairs that have a merge rank. The lowest
rank (leftmost first) is popped again and again until no ranked pair is left. The count is initial symbols minus
merges; token identifiers are never looked up or emitted.

Defined cases: null text counts as empty (0 bytes, 0 tokens); an empty table gives an empty result; equal texts get
equal counts; duplicate ids stay separate rows; all other input columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

#: Fixed by the byte-level pre-tokenizer of the vocabulary file.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Marks that follow a word without a space form one pre-token.
MARKS = ".,;:!?%$#&*"
#: Remembered chunks per Python worker; beyond this, counts are computed anew each time.
CACHE_ENTRIES = 800_000


def _byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in shown:
            out[b] = chr(b)
        else:
            out[b], extra = chr(extra), extra + 1
    return out


class PairMerger:
    """Counts the tokens of texts under a byte-level BPE file (tokenizer.json)."""

    def __init__(self, path: str, cache_entries: int = CACHE_ENTRIES):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.rank = {(a, b): i for i, (a, b) in enumerate(pairs)}
        self.alphabet = dict(enumerate(_byte_alphabet()))
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.split_special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.pretoken = regex.compile(PRETOKEN)
        self.lone_space = regex.compile(r"(?<=\S) (?=\S)")
        self.odd_space = regex.compile(r" \s|\s ")
        self.odd_ascii = re.compile(r"[\t\x0b-\r]|  | \n|\n ")
        self.limit = cache_entries
        self.by_word: dict[str, int] = {}  # after a space
        self.by_pretoken: dict[str, int] = {}

    def merge_count(self, pretoken: str) -> int:
        rank = self.rank.get
        symbols = list(pretoken.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.alphabet))
        n = left = len(symbols)
        if n == 1:
            return 1
        heap = [(r << 32) + i for i, pair in enumerate(zip(symbols, symbols[1:])) if (r := rank(pair)) is not None]
        if not heap:
            return n
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            popped = heapq.heappop(heap)
            i = popped & 0xFFFFFFFF
            j = after[i]
            a = symbols[i]
            if a is None or j >= n:
                continue
            b = symbols[j]
            if rank((a, b)) != popped >> 32:  # one of the two was merged meanwhile
                continue
            symbols[i] = ab = a + b
            symbols[j] = None
            left -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                r = rank((ab, symbols[k]))
                if r is not None:
                    heapq.heappush(heap, (r << 32) + i)
            h = before[i]
            if h >= 0:
                r = rank((symbols[h], ab))
                if r is not None:
                    heapq.heappush(heap, (r << 32) + h)
        return left

    def _plain(self, text: str) -> int:
        """A lone space between two non-spaces always starts a pre-token, so the text can be cut before each."""
        odd = (self.odd_ascii if text.isascii() else self.odd_space).search(text)
        parts = self.lone_space.split(text) if odd else text.split(" ")
        total, known = self._pretokens(parts[0]), self.by_word
        for p in parts[1:]:
            c = known.get(p)
            total += self._after_space(p) if c is None else c
        return total

    def _after_space(self, chunk: str) -> int:
        """Of a space and ``chunk``: letters and a tail of marks are two pre-tokens, all else goes by the pattern."""
        head = chunk.rstrip(MARKS)
        if not head.isalpha():
            return self._pretokens(" " + chunk)
        c = self.by_word.get(head)
        if c is None:
            c = self.merge_count(" " + head)
            if len(self.by_word) < self.limit and len(head) < 64:
                self.by_word[head] = c
        if len(head) < len(chunk):
            c += self._pretokens(chunk[len(head):])
            if len(self.by_word) < self.limit and len(chunk) < 64:
                self.by_word[chunk] = c
        return c

    def _pretokens(self, chunk: str) -> int:
        total, known = 0, self.by_pretoken
        for p in [chunk] if chunk in known else self.pretoken.findall(chunk):
            c = known.get(p)
            if c is None:
                c = self.merge_count(p)
                if len(known) < self.limit // 4 and len(p) < 64:
                    known[p] = c
            total += c
        return total

    def count(self, text: str) -> int:
        if self.split_special is None or not any(s in text for s in self.special):
            return self._plain(text) if text else 0
        parts = self.split_special.split(text)
        return len(parts) - 1 + sum(self._plain(p) for p in parts if p)


_MERGERS: dict[str, PairMerger] = {}


def merger(path: str) -> PairMerger:
    """One per Python worker and vocabulary."""
    if path not in _MERGERS:
        _MERGERS[path] = PairMerger(path)
    return _MERGERS[path]


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) per row of ``docs``; a narrow map, without any shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merger(vocabulary)
        for batch in batches:
            sizes, counts = [], []
            for v in batch.column(1):
                text = v.as_py() or ""
                sizes.append(len(text.encode("utf-8")))
                counts.append(m.count(text))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())],
                names=["id", "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = narrow.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("id", id_col)
