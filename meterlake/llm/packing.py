"""Concatenate and cut: documents become one stream of token ids that is cut into fixed windows.

Pass one encodes each document once and notes its running start within its input partition. One total per
partition gives every partition its global offset (a prefix sum over a list as long as the partition count), so
global positions need no shuffle and no sort. Pass two cuts each document at multiples of the window; the pieces
are the boundary records. Only the very last sequence can be short.

Defined cases: null text counts as empty and yields just the closing id; an empty table gives no pieces; duplicate
rows are packed as often as they occur; other input columns are ignored; texts of any length are cut as needed.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import materialize

SEQUENCE = 4096
CLOSING_ID = 2
#: Marks that follow a word without a space form one pre-token.
MARKS = ".,;:!?%$#&*"
#: Remembered words per Python worker; others are encoded anew in each batch.
CACHE_ENTRIES = 200_000
#: Bytes of texts, short of one text, whose words are looked up together.
TEXT_BYTES = 8 << 20
#: Words that the library encodes in one go.
ENCODE_WORDS = 16_384
#: Words whose ids are laid out at once.
LAID_OUT = 1 << 17
#: Letters that stay letters under the file's own normaliser (composition and lower case), one for one, so that a word of
#: them stays one pre-token. İ is not among them: its lower form ends with a mark.
PLAIN = "A-Za-zÀ-ÖØ-öø-įıĲ-ňŊ-ž"
LETTERS = "".join(c for c in map(chr, range(0x180)) if re.match(f"[{PLAIN}]", c))
ONE_WORD = f"^[{PLAIN}]+$"
WITH_MARKS = f"^[{PLAIN}]+[{re.escape(MARKS)}]*$"
#: Special strings; marks that Arrow counts as space and the file does not.
WHOLE_TEXT = "<[|]|[\x1c-\x1f]"


def laid_out(ids: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The stretches of ``ids``, as long as ``sizes`` says, in the order of ``codes``."""
    starts = np.cumsum(sizes) - sizes
    out = [ids[:0]]
    for at in range(0, len(codes), LAID_OUT):
        own = codes[at : at + LAID_OUT]
        n = sizes[own]
        out.append(ids[np.repeat(starts[own] - np.cumsum(n) + n, n) + np.arange(n.sum())])
    return np.concatenate(out)


class WordEncoder:
    """Ids of texts under a tokenizers file that drops white space between words.

    Such a file encodes each stretch between white space alone, so Arrow cuts a batch into words and only its distinct words
    are looked up. Plain letters with a tail of marks are two pre-tokens, other words are encoded whole; only stretches
    not seen before go to the library. Those of letters alone need neither its normaliser nor its pattern.
    """

    def __init__(self, path: str, closing_id: int, cache_entries: int = CACHE_ENTRIES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.lower_words = Tokenizer(self.tokenizer.model)
        self.lower_words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 and closing_id < 1 << 16 else np.dtype("<u4")
        self.closing = np.array([closing_id], self.dtype)
        self.known, self.ids, self.sizes = pa.array([], pa.string()), np.empty(0, self.dtype), np.empty(0, np.int64)
        self.limit = cache_entries
        suffix = self.tokenizer.model.end_of_word_suffix or "\0"
        self.closes = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)
        self.closes[[i for w, i in self.tokenizer.get_vocab().items() if w.endswith(suffix)]] = True

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)

    def _learn(self, letters: list[str], others: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of lower-case words of plain letters, whose last id alone is marked as a word's end, then of others."""
        ids, sizes = [self.closing[:0]], [np.empty(0, np.int64)]
        for at in range(0, len(letters), ENCODE_WORDS):
            group = letters[at : at + ENCODE_WORDS]
            own = np.array(self.lower_words.encode_batch_fast([" ".join(group)], add_special_tokens=False)[0].ids, self.dtype)
            n = np.diff(np.flatnonzero(self.closes[own]) + 1, prepend=0)
            if len(n) != len(group):
                each = list(map(self._whole, group))
                own, n = np.concatenate(each), np.array(list(map(len, each)))
            ids.append(own)
            sizes.append(n)
        for w in others:
            ids.append(self._whole(w))
            sizes.append(np.array([len(ids[-1])]))
        return np.concatenate(ids), np.concatenate(sizes)

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, one after the other, and how many each has."""
        plain, lower = pc.match_substring_regex(words, WITH_MARKS), pc.utf8_lower(words)
        heads = pc.if_else(plain, pc.utf8_rtrim(lower, MARKS), "")
        tails = pc.if_else(plain, pc.utf8_ltrim(lower, LETTERS), words)
        parts = pa.concat_arrays([heads, tails]).dictionary_encode()
        fresh = parts.dictionary.filter(pc.invert(pc.is_in(parts.dictionary, value_set=self.known)))
        single = pc.match_substring_regex(fresh, ONE_WORD)
        letters, others = fresh.filter(single), fresh.filter(pc.invert(single))
        ids, sizes = self._learn(letters.to_pylist(), others.to_pylist())
        every = pa.concat_arrays([self.known, letters, others])
        ids, sizes = np.concatenate([self.ids, ids]), np.concatenate([self.sizes, sizes])
        codes = pc.index_in(parts.dictionary, value_set=every).to_numpy()[parts.indices.to_numpy()]
        if len(self.known) < min(self.limit, len(every)):
            self.known, self.sizes = pa.concat_arrays([every.slice(0, self.limit)]), sizes[: self.limit].copy()
            self.ids = ids[: self.sizes.sum()].copy()
        pairs = codes.reshape(2, -1)
        return laid_out(ids, sizes, pairs.T.ravel()), sizes[pairs].sum(axis=0)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of each text and the closing id, one text after the other, and how many each text has."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        alone = pc.match_substring_regex(texts, WHOLE_TEXT)
        more = [self.closing, *map(self._whole, texts.filter(alone).to_pylist())]
        split = pc.utf8_split_whitespace(pc.if_else(alone, "", texts))  # of an empty text: one empty word
        words, ends = split.flatten().dictionary_encode(), split.offsets.to_numpy()[1:]
        ids, sizes = self._words(words.dictionary)
        closing = len(sizes)
        ids, sizes = np.concatenate([ids, *more]), np.concatenate([sizes, np.array(list(map(len, more)))])
        codes = words.indices.to_numpy().copy()
        codes[ends[alone.to_numpy(zero_copy_only=False)] - 1] = np.arange(closing + 1, len(sizes))
        codes = np.insert(codes, ends, closing)
        upto = np.cumsum(sizes[codes])[ends + np.arange(len(ends))]
        return laid_out(ids, sizes, codes), np.diff(upto, prepend=0)


_ENCODERS: dict[tuple[str, int], WordEncoder] = {}


def encoder(path: str, closing_id: int) -> WordEncoder:
    if (path, closing_id) not in _ENCODERS:
        _ENCODERS[path, closing_id] = WordEncoder(path, closing_id)
    return _ENCODERS[path, closing_id]


def concat_and_cut(
    docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", sequence: int = SEQUENCE, closing_id: int = CLOSING_ID, rows_at_once: int = 256, bytes_at_once: int = TEXT_BYTES
) -> DataFrame:
    """One row per piece: id, start, length, ids (binary, little-endian unsigned 32 bit), doc_tokens, sequence_id, offset."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, closing_id)
        pid, total = TaskContext.get().partitionId(), 0
        for whole in batches:
            size = np.cumsum(pc.fill_null(pc.binary_length(whole.column(1)), 0).to_numpy(), dtype=np.int64)
            cuts = [0, *(np.flatnonzero(np.diff(size // bytes_at_once)) + 1).tolist(), whole.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                batch = whole.slice(a, b - a)
                ids, counts = enc.encode(batch.column(1))
                ends = np.cumsum(counts)
                starts = total + ends - counts
                total += len(ids)
                offsets = np.concatenate([[0], ends * ids.itemsize]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0), pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(offsets), pa.py_buffer(ids)]), pa.array(counts), pa.array(starts),
                        pa.array(np.full(b - a, ids.itemsize, np.int32)), pa.array(np.full(b - a, pid, np.int32)),
                    ],
                    names=["id", "ids", "n", "start", "width", "pid"],
                )

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, rows_at_once):
                batch = whole.slice(at, rows_at_once)
                own, cols = [], {k: [] for k in ("start", "length", "ids", "doc_tokens", "sequence_id", "offset")}
                for i, (ids, n, g, width) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(1, 5)), strict=True)):
                    ids = np.frombuffer(ids, f"<u{width}").astype("<u4")
                    cuts = [g, *range((g // sequence + 1) * sequence, g + n, sequence), g + n]
                    for a, b in zip(cuts, cuts[1:]):
                        own.append(i)
                        for k, v in zip(cols, (a - g, b - a, ids[a - g : b - g].tobytes(), n, a // sequence, a % sequence)):
                            cols[k].append(v)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(own, pa.int64())), *(pa.array(v, pa.binary() if k == "ids" else pa.int64()) for k, v in cols.items())], names=["id", *cols]
                )

    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    encoded = materialize(narrow.mapInArrow(first, f"id {kind}, ids binary, n long, start long, width int, pid int"), "encoded")
    totals = dict(encoded.groupBy("pid").agg(F.sum("n")).collect())  # one row per partition
    offsets, at = [], 0
    for pid in sorted(totals):
        offsets.append((pid, at))
        at += totals[pid]
    begins = spark.createDataFrame(offsets, "pid int, begin long")
    placed = encoded.join(F.broadcast(begins), "pid").select("id", "ids", "n", (F.col("begin") + F.col("start")).alias("start"), "width")
    pieces = placed.mapInArrow(second, f"id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    return pieces.withColumnRenamed("id", id_col)
