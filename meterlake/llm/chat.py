"""Chat formatting by token-level assembly.

Role and text of each turn are encoded on their own as ordinary text; reserved ids, which no text can produce, are
spliced between them. The loss mask comes from a prefix sum over +1 and -1 at the borders of assistant texts.
The readable form of a turn writes the reserved ids as control strings; a control string inside a text is broken by
a backslash after its first character, and backslashes are doubled, so that texts come back exactly.

Defined cases: null text and null role count as empty; null turn numbers come first; ties in turn keep the order of
role and text; repeated rows are repeated turns; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Control strings of the template and others that are common in chat data; all are escaped in texts.
BEGIN, TURN, BODY, END = "<|begin|>", "<|turn|>", "<|body|>", "<|end|>"
CONTROLS = (BEGIN, TURN, BODY, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
#: A place after the first character of a control string.
ESCAPE_AT = "([<\\[])(?=" + "|".join(re.escape(c[1:]) for c in CONTROLS) + ")"


def escape(text: str) -> str:
    return re.sub(ESCAPE_AT, r"\1\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


class TurnCodec:
    def __init__(self, path: str):
        import tiktoken

        from public_tokenizers import PATTERN

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.enc = tiktoken.Encoding("turns", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        top = max(ranks.values()) + 1
        #: Reserved ids: above every id of the vocabulary.
        self.begin, self.turn, self.body, self.end = top + 1, top + 2, top + 3, top + 4

    def assemble(self, role: str, text: str, is_first: bool, learns: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids and loss mask of a turn."""
        r, t = (np.array(self.enc.encode_ordinary(escape(x)), np.int32) for x in (role, text))
        head = ([self.begin] if is_first else []) + [self.turn]
        ids = np.concatenate([np.array(head, np.int32), r, [self.body], t, [self.end]]).astype(np.int32)
        border = np.zeros(len(ids) + 1, np.int8)
        if learns:
            at = len(head) + len(r) + 1
            border[at] += 1
            border[at + len(t)] -= 1
        return ids, np.cumsum(border, dtype=np.int8)[:-1]

    def read(self, ids: np.ndarray, mask: np.ndarray) -> tuple[str, str, str]:
        """Role, text and text under the mask, from a turn's ids alone."""
        body = int(np.flatnonzero(ids == self.body)[0])
        start = 2 if ids[0] == self.begin else 1
        text = lambda x: unescape(self.enc.decode_bytes(x.tolist()).decode("utf-8"))
        return text(ids[start:body]), text(ids[body + 1 : -1]), text(ids[mask.astype(bool)])

    def shown(self, ids: np.ndarray) -> str:
        """The readable form."""
        body = int(np.flatnonzero(ids == self.body)[0])
        plain = lambda x: self.enc.decode_bytes(x.tolist()).decode("utf-8")
        start = 2 if ids[0] == self.begin else 1
        return (BEGIN if start == 2 else "") + TURN + plain(ids[start:body]) + BODY + plain(ids[body + 1 : -1]) + END


_CODECS: dict[str, TurnCodec] = {}


def codec(path: str) -> TurnCodec:
    if path not in _CODECS:
        _CODECS[path] = TurnCodec(path)
    return _CODECS[path]


def format_turns(turns: DataFrame, vocabulary: str, learn_role: str = "assistant") -> DataFrame:
    """(conv_id, turn, ids, mask, formatted, role, text) per turn row: a narrow map over (conv_id, turn, role, text).

    Every turn is complete in itself; ``conversation_sequences`` orders them and splices in the id that begins a conversation.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for batch in batches:
            ids, masks, shown = [], [], []
            for role, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                a, b = c.assemble(role or "", text or "", False, role == learn_role)
                ids.append(a)
                masks.append(b)
                shown.append(c.shown(a))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int32())), pa.array(masks, pa.list_(pa.int8())), pa.array(shown, pa.string()), batch.column(2), batch.column(3)],
                names=["conv_id", "turn", "ids", "mask", "formatted", "role", "text"],
            )

    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "conv_id long, turn long, ids array<int>, mask array<tinyint>, formatted string, role string, text string")


def _spliced(batches: Iterator[pa.RecordBatch], c: TurnCodec) -> Iterator[tuple[int | None, bool, np.ndarray, np.ndarray]]:
    """(conv_id, is_first, ids, mask) of sorted turns: the first of a conversation starts with the id that begins it."""
    now: object = object()
    for batch in batches:
        for conv, ids, mask in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            is_first, now = conv != now, conv
            head = [c.begin] if is_first else []
            yield conv, is_first, np.array(head + ids, np.int32), np.array([0] * len(head) + mask, np.int8)


def _in_order(formatted: DataFrame) -> DataFrame:
    dealt = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    return dealt.select("conv_id", "ids", "mask")


def conversation_sequences(formatted: DataFrame, vocabulary: str) -> DataFrame:
    """(conv_id, seq, start, ids, mask): a conversation's sequence in pieces, one per turn; start is the place of the piece's first id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["conv_id", "seq", "start", "ids", "mask"], (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int8()))
        done, seq, start = [], 0, 0
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(list(zip(*done)) or [[]] * 5, kinds)], names=names)
        for conv, is_first, ids, mask in _spliced(batches, codec(vocabulary)):
            seq, start = (0, 0) if is_first else (seq, start)
            done.append((conv, seq, start, ids, mask))
            seq, start = seq + 1, start + len(ids)
            if len(done) >= 1024:
                yield pack()
                done.clear()
        yield pack()

    return _in_order(formatted).mapInArrow(run, "conv_id long, seq long, start long, ids array<int>, mask array<tinyint>")


def read_conversations(formatted: DataFrame, vocabulary: str) -> DataFrame:
    """Digests per conversation, read back from the ids and masks of its sequence alone.

    Turns are dealt by conversation, sorted, and streamed: a conversation of any length needs the state of two
    hashes, not its turns.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        now, state, done = None, None, []

        def flush() -> pa.RecordBatch:
            cols = list(zip(*done)) or [[]] * 6
            done.clear()
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            return pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(cols, kinds)], names=names)

        def close() -> None:
            if state:
                n, turns, chars, loss, shown = state
                done.append((now, n, turns.hexdigest(), chars, loss.hexdigest(), shown))

        for conv, is_first, ids, mask in _spliced(batches, c):
            if is_first:
                close()
                now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                if len(done) >= 4096:
                    yield flush()
            role, text, learned = c.read(ids, mask)
            state[0] += 1
            state[1].update(f"{role}\n{text}\n".encode())
            state[2] += len(learned)
            state[3].update(learned.encode())
            state[4] += len(c.shown(ids))
        close()
        yield flush()

    return _in_order(formatted).mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
