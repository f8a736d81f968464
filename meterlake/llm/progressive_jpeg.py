"""Progressive JPEG media columns: a codec whose entropy coding runs in lock step over restart intervals in numpy.

Decoding accumulates spectral-selection and successive-approximation scans into coefficient arrays (zigzag order),
inverse-transforms them in exact integer steps, upsamples chroma and gives full-resolution RGB tensors. All restart
intervals of all files of a batch that share a scan's parameters advance together, one symbol a step.

A payload is stored losslessly in the format's own unit, the 8-bit quantised coefficient: 64 bytes are one block,
byte b is coefficient b - 128, and blocks fill the planes Y, Cb, Cr of a 4:2:0 image (all quantisers 1). Samples
of a JPEG come out of a rounded transform and could not hold arbitrary bytes.

Defined cases: null text counts as empty, whose payload is 64 zero bytes; equal texts give equal files; repeated rows are
coded one by one; an empty table gives no rows; a text is coded as a whole, so a task needs some forty times the bytes
of its longest text (short ones are coded together up to ``BATCH_BYTES``); a file that can't be decoded gives null; other
input columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Lanes (restart intervals) that advance together; bounds memory.
LANES = 16_384
#: Bytes of payload, and rows, that are coded together.
BATCH_BYTES, BATCH_ROWS = 1 << 20, 512
#: The last AC coefficients come in two approximations, as does DC.
REFINED_FROM = 56
#: ITU T.81 zigzag order: position in the scan -> row * 8 + column.
ZIGZAG = np.array([r * 8 + c for s in range(15) for r, c in (sorted((i, s - i) for i in range(8) if 0 <= s - i < 8) if s % 2 else sorted(((i, s - i) for i in range(8) if 0 <= s - i < 8), reverse=True))])
#: Code lengths of the files we write: symbols of text payloads are short, all others long.
DC_LENGTHS = {4: 2, 5: 2, 3: 3, 2: 3, 1: 4, 0: 4, 6: 4, 7: 5, 8: 6, 9: 7, 10: 8, 11: 9}
AC_SHORT = {5: 1, 4: 3, 7: 3, 6: 4, 3: 4, 0: 5, 2: 6, 1: 6, 8: 6, 0xF0: 8}
AC_LONG = 12
SIZE_OF = np.array([0, *(int(v).bit_length() for v in range(1, 1 << 15))], np.int64)


def _canonical(lengths: dict[int, int]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """DHT body (16 counts and the symbols), and code and length by symbol."""
    symbols = sorted(lengths, key=lambda s: (lengths[s], s))
    codes, sizes = np.zeros(256, np.int64), np.zeros(256, np.int64)
    code, last = 0, 0
    for s in symbols:
        code <<= lengths[s] - last
        last = lengths[s]
        codes[s], sizes[s] = code, last
        code += 1
    counts = bytes(sum(v == n for v in lengths.values()) for n in range(1, 17))
    return counts + bytes(symbols), codes, sizes


DC_TABLE, DC_CODE, DC_SIZE = _canonical(DC_LENGTHS)
AC_TABLE, AC_CODE, AC_SIZE = _canonical(
    AC_SHORT | {(r << 4) + s: AC_LONG for r in range(16) for s in range(11) if (r << 4) + s not in AC_SHORT}
)


# ---------------------------------------------------------------- writing


def _pack(values: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bit strings of lanes, (lanes, codes) each at most 32 bits; every lane is padded with ones to whole bytes."""
    ends = np.cumsum(lengths, axis=1)
    total = ends[:, -1]
    pad = -total % 8
    size = (total + pad) >> 3
    start = np.concatenate([[0], np.cumsum(size)])
    at = ends - lengths + (start[:-1] << 3)[:, None]
    some = lengths > 0
    at = np.concatenate([at[some], (start[1:] << 3) - pad])
    v = np.concatenate([values[some], (1 << pad) - 1]).astype(np.uint64)
    n = np.concatenate([lengths[some], pad])
    v <<= (64 - (at & 31) - n).astype(np.uint64) & np.uint64(63)
    v[n == 0] = 0
    word, words = at >> 5, int(start[-1] >> 2) + 2
    out = np.bincount(word, (v >> np.uint64(32)).astype(np.float64), words) + np.bincount(word + 1, (v & np.uint64(0xFFFFFFFF)).astype(np.float64), words)
    return out[:words].astype(np.uint64).astype(">u4").view(np.uint8)[: start[-1]], size


def _signed_bits(v: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(v < 0, v + (1 << size) - 1, v)


def _ac_first(c: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of one block a lane; ``c``: coefficients of the band."""
    mag = np.abs(c) >> low
    v = np.where(c < 0, -mag, mag)
    n, width = v.shape
    hit = v != 0
    place = np.broadcast_to(np.arange(width), v.shape)
    before = np.maximum.accumulate(np.where(hit, place, -1), axis=1)
    last = before[:, -1]
    before = np.concatenate([np.full((n, 1), -1), before[:, :-1]], axis=1)
    run = place - before - 1
    size = SIZE_OF[mag]
    symbol = ((run & 15) << 4) + size
    code = np.where(hit, (AC_CODE[symbol] << size) + _signed_bits(v, size), 0)
    length = np.where(hit, AC_SIZE[symbol] + size, 0)
    end = last < width - 1
    code, length = np.column_stack([code, np.where(end, AC_CODE[0], 0)]), np.column_stack([length, np.where(end, AC_SIZE[0], 0)])
    if (long := hit & (run > 15)).any():  # runs of 16 zeros come before the symbol
        more = np.zeros((n, width + 1, 2), np.int64)
        size = more.copy()
        more[:, :, 1], size[:, :, 1] = code, length
        for k in range(1, 4):
            here = long & (run >> 4 >= k)
            more[:, :width, 0][here] = (more[:, :width, 0][here] << AC_SIZE[0xF0]) + AC_CODE[0xF0]
            size[:, :width, 0][here] += AC_SIZE[0xF0]
        code, length = more.reshape(n, -1), size.reshape(n, -1)
    return code, length


def _ac_refine(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The last bit of a band of at most 16 coefficients, one block a lane."""
    mag = np.abs(c)
    n, width = c.shape
    codes, lengths = np.zeros((n, width + 1), np.int64), np.zeros((n, width + 1), np.int64)
    run, kept, n_kept = (np.zeros(n, np.int64) for _ in range(3))
    for k in range(width):
        t = mag[:, k]
        fresh, old = t == 1, t > 1
        symbol = (run << 4) + 1
        code = (((AC_CODE[symbol] << 1) + (c[:, k] > 0)) << n_kept) + kept
        codes[fresh, k] = code[fresh]
        lengths[fresh, k] = (AC_SIZE[symbol] + 1 + n_kept)[fresh]
        kept = np.where(fresh, 0, np.where(old, (kept << 1) + (t & 1), kept))
        n_kept = np.where(fresh, 0, n_kept + old)
        run = np.where(fresh, 0, run + (t == 0))
    rest = (run > 0) | (n_kept > 0)
    codes[:, width] = np.where(rest, (AC_CODE[0] << n_kept) + kept, 0)
    lengths[:, width] = np.where(rest, AC_SIZE[0] + n_kept, 0)
    return codes, lengths


def _scan_bytes(blocks: np.ndarray, coder) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all lanes and the size of each; ``blocks``: a row a lane."""
    parts = [_pack(*coder(blocks[at : at + LANES].astype(np.int64))) for at in range(0, len(blocks), LANES)]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _with_markers(data: np.ndarray, sizes: np.ndarray, runs: list[int]) -> list[bytes]:
    """Cut lanes into scans of so many lanes, stuff a zero after each 0xFF and put restart markers between lanes."""
    lane_end = np.cumsum(sizes)
    shift = np.zeros(len(data) + 1, np.int64)
    full = data == 255
    shift[1:] += full
    number = np.concatenate([np.arange(r) for r in runs])
    inner = np.ones(len(sizes), bool)
    inner[np.cumsum(runs) - 1] = False  # no marker after a scan's last lane
    shift += np.bincount(lane_end[inner], minlength=len(data) + 1) * 2
    place = np.arange(len(data)) + np.cumsum(shift)[:-1]
    total = len(data) + int(shift.sum())
    out = np.zeros(total, np.uint8)
    out[place] = data
    after = place[lane_end[inner] - 1] + 1 + full[lane_end[inner] - 1]
    out[after], out[after + 1] = 255, 0xD0 + (number[inner] & 7)
    last = lane_end[np.cumsum(runs) - 1] - 1
    ends = place[last] + 1 + full[last]
    raw, begin, scans = out.tobytes(), 0, []
    for e in ends.tolist():
        scans.append(raw[begin:e])
        begin = e
    return scans


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, marker, len(body) + 2) + body


def _sos(parts: list[tuple[int, int]], first: int, last: int, high: int, low: int) -> bytes:
    return _segment(0xDA, bytes([len(parts)]) + b"".join(bytes(p) for p in parts) + bytes([first, last, (high << 4) + low]))


def shape_for(n_blocks: int) -> tuple[int, int]:
    """Columns and rows of MCUs that hold so many blocks, 6 in each."""
    n = -(-n_blocks // 6)
    cols = int(np.ceil(np.sqrt(n)))
    return cols, -(-n // cols)


def encode_coefficients(images: list[tuple[int, int, np.ndarray]]) -> list[bytes]:
    """Progressive 4:2:0 files of (MCU columns, MCU rows, coefficients): planes Y, Cb, Cr by block rows, zigzag, int16."""
    n_mcu = [c * r for c, r, _ in images]
    blocks = np.concatenate([x for _, _, x in images])
    dc = []
    for cols, rows, x in images:
        n = cols * rows
        y = x[: 4 * n, 0].reshape(rows, 2, cols, 2).transpose(0, 2, 1, 3).reshape(n, 4)
        dc.append(np.column_stack([y, x[4 * n : 5 * n, 0], x[5 * n :, 0]]))
    dc = np.concatenate(dc).astype(np.int64)

    def dc_first(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        v = v >> 1
        d = np.column_stack([v[:, 0], v[:, 1:4] - v[:, 0:3], v[:, 4:]])
        size = SIZE_OF[np.abs(d)]
        return (DC_CODE[size] << size) + _signed_bits(d, size), DC_SIZE[size] + size

    planes = [k for n in n_mcu for k in (4 * n, n, n)]
    scans = {
        "dc": _with_markers(*_scan_bytes(dc, dc_first), n_mcu),
        "low": _with_markers(*_scan_bytes(blocks[:, 1:REFINED_FROM], lambda v: _ac_first(v, 0)), planes),
        "high": _with_markers(*_scan_bytes(blocks[:, REFINED_FROM:], lambda v: _ac_first(v, 1)), planes),
        "dc_last": _with_markers(*_scan_bytes(dc, lambda v: (v & 1, np.ones_like(v))), n_mcu),
        "high_last": _with_markers(*_scan_bytes(blocks[:, REFINED_FROM:], _ac_refine), planes),
    }
    every = [(1, 0), (2, 0), (3, 0)]
    out = []
    for i, (cols, rows, _) in enumerate(images):
        parts = [
            b"\xff\xd8", _segment(0xDB, b"\0" + b"\1" * 64),
            _segment(0xC2, struct.pack(">BHHB", 8, rows * 16, cols * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])),
            _segment(0xC4, b"\x00" + DC_TABLE), _segment(0xC4, b"\x10" + AC_TABLE), _segment(0xDD, b"\0\1"),
            _sos(every, 0, 0, 0, 1), scans["dc"][i],
        ]
        for key, first, last, high, low in (("low", 1, REFINED_FROM - 1, 0, 0), ("high", REFINED_FROM, 63, 0, 1)):
            for k in range(3):
                parts += [_sos([(k + 1, 0)], first, last, high, low), scans[key][3 * i + k]]
        parts += [_sos(every, 0, 0, 1, 0), scans["dc_last"][i]]
        for k in range(3):
            parts += [_sos([(k + 1, 0)], REFINED_FROM, 63, 1, 0), scans["high_last"][3 * i + k]]
        out.append(b"".join([*parts, b"\xff\xd9"]))
    return out


def payload_of(text: bytes) -> bytes:
    """``text`` and zeros up to a positive multiple of 64."""
    return text + bytes(-len(text) % 64 if text else 64)


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    images = []
    for p in payloads:
        n = len(p) // 64
        cols, rows = shape_for(n)
        x = np.zeros((6 * cols * rows, 64), np.int16)
        x[:n] = np.frombuffer(p, np.uint8).reshape(n, 64)
        x[:n] -= 128
        images.append((cols, rows, x))
    return encode_coefficients(images)


# ---------------------------------------------------------------- reading


class Image:
    """Headers and scans of a file; ``coef`` holds a row per block of all components, in zigzag order."""

    def __init__(self, data: bytes):
        self.data, self.scans, self.parts = data, [], []
        quant, tables, every = {}, {}, 0
        at = 2
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG")
        while True:
            while data[at + 1] == 255:
                at += 1
            marker = data[at + 1]
            if marker == 0xD9:
                break
            size = struct.unpack_from(">H", data, at + 2)[0]
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.int64)
                    body = body[65 + 64 * wide :]
            elif marker == 0xC2:
                bits, self.height, self.width, n = struct.unpack_from(">BHHB", body)
                if bits != 8:
                    raise ValueError("only 8-bit samples")
                raw = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
                self.h_max, self.v_max = max(r[1] for r in raw), max(r[2] for r in raw)
                self.cols, self.rows = -(-self.width // (8 * self.h_max)), -(-self.height // (8 * self.v_max))
                base = 0
                for ident, h, v, q in raw:
                    own = (-(-(-(-self.width * h // self.h_max)) // 8), -(-(-(-self.height * v // self.v_max)) // 8))
                    self.parts.append({"id": ident, "h": h, "v": v, "q": q, "base": base, "wide": self.cols * h, "high": self.rows * v, "own": own})
                    base += self.cols * h * self.rows * v
                self.n_blocks = base
            elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                raise ValueError("not a progressive Huffman JPEG")
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    tables[body[0]] = body[1 : 17 + n]
                    body = body[17 + n :]
            elif marker == 0xDD:
                every = struct.unpack(">H", body)[0]
            elif marker == 0xDA:
                n = body[0]
                used = [([p for p in self.parts if p["id"] == body[1 + 2 * i]][0], body[2 + 2 * i]) for i in range(n)]
                first, last, approx = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n]
                end = _MARKER.search(data, at)
                stop = end.start() if end else len(data)
                keys = tuple(tables.get(t >> 4 if first == 0 else 0x10 + (t & 15), b"") for _, t in used)
                self.scans.append({"parts": [p for p, _ in used], "key": (first, last, approx >> 4, approx & 15, keys if first == 0 else keys[:1]), "every": every, "span": (at, stop)})
                at = stop
        self.quant = quant

    def order(self, scan: dict) -> np.ndarray:
        """Rows of ``coef`` in the order in which a scan visits them."""
        parts = tuple((p["base"], p["h"], p["v"], p["wide"], *p["own"]) for p in scan["parts"])
        return _order(self.cols, self.rows, parts)


@lru_cache(256)
def _order(cols: int, rows: int, parts: tuple) -> np.ndarray:
    if len(parts) == 1:
        base, _, _, wide, w, h = parts[0]
        return (base + np.arange(h)[:, None] * wide + np.arange(w)).ravel()
    out = []
    for base, h, v, wide, _, _ in parts:
        y = np.arange(rows)[:, None, None, None] * v + np.arange(v)[:, None]
        x = np.arange(cols)[:, None, None] * h + np.arange(h)
        out.append((base + y * wide + x).reshape(rows * cols, -1))
    return np.concatenate(out, axis=1).ravel()


_MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")
_LOOKUPS: dict[bytes, np.ndarray] = {}


def _lookup(table: bytes) -> np.ndarray:
    """By the next 16 bits: code length * 256 + symbol; 0 where no code fits."""
    if table not in _LOOKUPS:
        out, code, at = np.zeros(1 << 16, np.int64), 0, 16
        for n in range(1, 17):
            for _ in range(table[n - 1]):
                out[code << (16 - n) : (code + 1) << (16 - n)] = (n << 8) + table[at]
                code, at = code + 1, at + 1
            code <<= 1
        _LOOKUPS[table] = out
    return _LOOKUPS[table]


class Lanes:
    """Restart intervals of many scans: first bit, and first and last place in ``order``."""

    def __init__(self, window: np.ndarray, bit: np.ndarray, at: np.ndarray, end: np.ndarray, order: np.ndarray):
        self.window, self.bit, self.at, self.end, self.order = window, bit, at, end, order

    def peek(self, bit: np.ndarray, n) -> np.ndarray:
        return (self.window[bit >> 3] >> (32 - (bit & 7) - n)) & ((1 << n) - 1)

    def code(self, bit: np.ndarray, table: np.ndarray) -> np.ndarray:
        got = table[(self.window[bit >> 3] >> (16 - (bit & 7))) & 0xFFFF]
        if not got.all():
            raise ValueError("broken entropy data")
        return got


def _extend(x: np.ndarray, size: np.ndarray) -> np.ndarray:
    return x - np.where(x < (1 << size >> 1), (1 << size) - 1, 0)


def _read_dc(lanes: Lanes, coef: np.ndarray, which: np.ndarray, tables: list[np.ndarray], high: int, low: int) -> None:
    """``which``: the component, by place in ``order`` modulo its length."""
    bit, at = lanes.bit.copy(), lanes.at.copy()
    if high:
        while len(at):
            coef[lanes.order[at], 0] |= lanes.peek(bit, 1) << low
            bit, at = bit + 1, at + 1
            go = at < lanes.end
            if not go.all():
                bit, at, lanes = bit[go], at[go], Lanes(lanes.window, bit, at, lanes.end[go], lanes.order)
        return
    seen, step = np.zeros((len(at), int(which.max()) + 1), np.int64), 0
    row = np.arange(len(at))
    while len(at):
        part = int(which[step % len(which)])
        got = lanes.code(bit, tables[part])
        size, bit = got & 255, bit + (got >> 8)
        seen[row, part] += _extend(lanes.peek(bit, size), size)
        coef[lanes.order[at], 0] = seen[row, part] << low
        bit, at, step = bit + size, at + 1, step + 1
        go = at < lanes.end
        if not go.all():
            bit, at, row, lanes = bit[go], at[go], row[go], Lanes(lanes.window, bit, at, lanes.end[go], lanes.order)


def _read_ac_first(lanes: Lanes, coef: np.ndarray, table: np.ndarray, first: int, last: int, low: int) -> None:
    flat, window, order = coef.reshape(-1), lanes.window, lanes.order
    bit, at, end = lanes.bit.copy(), lanes.at.copy(), lanes.end
    k, row = np.full(len(at), first), order[at] * 64
    while len(at):
        got = lanes.code(bit, table)
        bit += got >> 8
        symbol = got & 255
        run, size = symbol >> 4, symbol & 15
        some = size > 0
        if some.all():
            k += run
            x = (window[bit >> 3] >> (32 - (bit & 7) - size)) & ((1 << size) - 1)
            bit += size
            if k.max() > last:
                raise ValueError("a run leaves its band")
            flat[row + k] = _extend(x, size) << low
            k += 1
            done = k > last
            skip = 0
        else:
            extra = np.where(some, size, np.where(run < 15, run, 0))
            x = (window[bit >> 3] >> (32 - (bit & 7) - extra)) & ((1 << extra) - 1)
            bit += extra
            k += np.where(some | (run == 15), run, 0)
            if k.max() > last:
                raise ValueError("a run leaves its band")
            flat[(row + k)[some]] = (_extend(x, size) << low)[some]
            k += 1
            over = ~some & (run < 15)
            done = over | (k > last)
            skip = np.where(over, (1 << np.where(over, run, 0)) + x - 1, 0)
        if done.any():
            at = at + done + skip
            k[done] = first
            go = at < end
            if not go.all():
                bit, at, end, k = bit[go], at[go], end[go], k[go]
            row = order[at] * 64


def _read_ac_refine(lanes: Lanes, coef: np.ndarray, table: np.ndarray, first: int, last: int, low: int) -> None:
    """A step takes a symbol where one is due, then passes one coefficient."""
    flat, order = coef.reshape(-1), lanes.order
    bit, at, end = lanes.bit.copy(), lanes.at.copy(), lanes.end
    n = len(at)
    k, left, value, blocks = np.full(n, first), np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, np.int64)
    while len(at):
        due = np.flatnonzero((left < 0) & (blocks == 0))
        if len(due):
            b = bit[due]
            got = lanes.code(b, table)
            b = b + (got >> 8)
            run, size = (got & 255) >> 4, got & 15
            eob = (size == 0) & (run < 15)
            extra = np.where(eob, run, size)
            x = lanes.peek(b, extra)
            bit[due] = b + extra
            blocks[due] = np.where(eob, (1 << np.where(eob, run, 0)) + x, 0)
            left[due] = np.where(eob, -1, run)
            value[due] = np.where(size == 1, np.where(x == 1, 1, -1) << low, 0)
        here = order[at] * 64 + k
        now = flat[here].astype(np.int64)
        old = now != 0
        fix = lanes.peek(bit, 1) * old
        bit += old
        place = ~old & (left == 0)
        now += np.where((fix == 1) & (np.abs(now) >> low & 1 == 0), np.where(now > 0, 1, -1) << low, 0)
        flat[here] = np.where(place, value, now)
        left = np.where(old | (left < 0), left, left - 1)  # a placed value or the last zero of a run of 16 ends at -1
        k += 1
        done = k > last
        if done.any():
            blocks = np.where(done & (blocks > 0), blocks - 1, blocks)
            left = np.where(done, -1, left)
            k[done] = first
            at = at + done
            go = at < end
            if not go.all():
                bit, at, end, k, left, value, blocks = (v[go] for v in (bit, at, end, k, left, value, blocks))


def decode_coefficients(files: list[bytes]) -> tuple[list[Image], list[np.ndarray]]:
    """Headers and accumulated coefficients (a row per block, zigzag) of progressive files."""
    images = [Image(f) for f in files]
    first_row = np.concatenate([[0], np.cumsum([i.n_blocks for i in images])])
    coef = np.zeros((int(first_row[-1]), 64), np.int32)
    waiting = [list(i.scans) for i in images]
    while any(waiting):
        groups: dict[tuple, list[tuple[int, dict]]] = {}
        for n, scans in enumerate(waiting):
            taken: set[int] = set()
            while scans and not taken & {p["base"] for p in scans[0]["parts"]}:
                if taken and scans[0]["key"] != key:
                    break
                s = scans.pop(0)
                key = s["key"]
                taken |= {p["base"] for p in s["parts"]}
                pattern = tuple(k for k, p in enumerate(s["parts"]) for _ in range(p["h"] * p["v"])) if len(s["parts"]) > 1 else (0,)
                groups.setdefault((key, pattern), []).append((n, s))
        for (key, pattern), scans in groups.items():
            _read_group(images, scans, key, pattern, first_row, coef)
    return images, [coef[a:b] for a, b in zip(first_row, first_row[1:])]


def _read_group(images: list[Image], scans: list[tuple[int, dict]], key: tuple, pattern: tuple, first_row: np.ndarray, coef: np.ndarray) -> None:
    raw = np.frombuffer(b"".join(images[n].data[s["span"][0] : s["span"][1]] for n, s in scans) + b"\0" * 8, np.uint8)
    sizes = np.array([s["span"][1] - s["span"][0] for _, s in scans])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    full = np.flatnonzero(raw[:-1] == 255)
    follow = raw[full + 1]
    restart = full[(follow & 0xF8) == 0xD0]
    keep = np.ones(len(raw), bool)
    keep[full[follow == 0] + 1] = False
    keep[restart] = keep[restart + 1] = False
    place = np.cumsum(keep) - keep  # of a raw byte among those kept
    data = np.concatenate([raw[keep], np.zeros(8, np.uint8)]).astype(np.int64)
    window = (data[:-3] << 24) + (data[1:-2] << 16) + (data[2:-1] << 8) + data[3:]
    orders, at, end, base = [], [], [], 0
    for n, s in scans:
        o = images[n].order(s) + first_row[n]
        step = s["every"] * len(pattern) or len(o)
        orders.append(o)
        at.append(np.arange(0, len(o), step) + base)
        end.append(np.minimum(np.arange(step, len(o) + step, step), len(o)) + base)
        base += len(o)
    owner = np.searchsorted(starts, restart, "right") - 1
    begins = np.sort(np.concatenate([starts[:-1], restart + 2]))
    lanes_of = np.array([len(a) for a in at])
    if len(begins) != lanes_of.sum() or (np.bincount(owner, minlength=len(scans)) + 1 != lanes_of).any():
        raise ValueError("restart markers do not match the interval")
    bit, at, end, order = place[begins] * 8, np.concatenate(at), np.concatenate(end), np.concatenate(orders)
    first, last, high, low, tables = key
    for a in range(0, len(at), LANES):
        lanes = Lanes(window, bit[a : a + LANES], at[a : a + LANES], end[a : a + LANES], order)
        if first == 0:
            _read_dc(lanes, coef, np.array(pattern), [] if high else [_lookup(t) for t in tables], high, low)
        elif high:
            _read_ac_refine(lanes, coef, _lookup(tables[0]), first, last, low)
        else:
            _read_ac_first(lanes, coef, _lookup(tables[0]), first, last, low)


def _basis() -> np.ndarray:
    """Inverse transform, (zigzag coefficient, sample), in units of 1/2048."""
    f = np.arange(8)
    c = np.cos((2 * f[None, :] + 1) * f[:, None] * np.pi / 16) / 2
    c[0] /= np.sqrt(2)
    return np.rint(np.einsum("ux,vy->uvxy", c, c).reshape(64, 64)[ZIGZAG] * 2048)


BASIS = {t: _basis().astype(t) for t in (np.float32, np.float64)}


def samples(coef: np.ndarray, quant: np.ndarray) -> np.ndarray:
    """8x8 samples of blocks, 0 to 255; sums of whole numbers, hence the same in any order."""
    out = np.empty((len(coef), 64), np.uint8)
    for a in range(0, len(coef), LANES):
        c = coef[a : a + LANES] * quant
        kind = np.float32 if np.abs(c).max(initial=0) <= 255 else np.float64
        s = c.astype(kind) @ BASIS[kind]
        out[a : a + LANES] = np.clip(np.floor((s + 1024) / 2048) + 128, 0, 255)
    return out


def to_rgb(image: Image, coef: np.ndarray) -> np.ndarray:
    """(height, width, 3) uint8; chroma is upsampled by repetition, strip by strip of MCU rows."""
    planes, shared = [], samples(coef, image.quant[image.parts[0]["q"]])
    for p in image.parts:
        own = slice(p["base"], p["base"] + p["wide"] * p["high"])
        x = shared[own] if p["q"] == image.parts[0]["q"] else samples(coef[own], image.quant[p["q"]])
        planes.append(x.reshape(p["high"], p["wide"], 8, 8))
    out = np.empty((image.rows * image.v_max * 8, image.cols * image.h_max * 8, 3), np.uint8)
    strip = max(1, (1 << 16) // max(1, image.cols * 64))
    for r in range(0, image.rows, strip):
        parts = []
        for p, x in zip(image.parts, planes):
            v = x[r * p["v"] : (r + strip) * p["v"]]
            v = v.transpose(0, 2, 1, 3).reshape(v.shape[0] * 8, -1).astype(np.int32)
            parts.append((v, (p["v"], image.v_max), (p["h"], image.h_max)))

        def full(t: np.ndarray, v: tuple[int, int], h: tuple[int, int]) -> np.ndarray:
            """A plane at full size: the sample whose place holds each pixel, also where the factors do not divide."""
            if v[0] != v[1]:
                t = t[np.arange(len(t) * v[1] // v[0]) * v[0] // v[1]]
            return t if h[0] == h[1] else t[:, np.arange(t.shape[1] * h[1] // h[0]) * h[0] // h[1]]

        y = full(*parts[0])
        dst = out[r * image.v_max * 8 : r * image.v_max * 8 + y.shape[0]]
        if len(parts) == 1:
            dst[:] = y[:, :, None]
            continue
        (b, *up_b), (c, *up_c) = parts[1], parts[2]
        b, c = b - 128, c - 128
        dst[:, :, 0] = np.clip(y + full((91881 * c + 32768) >> 16, *up_c), 0, 255)
        same = up_b == up_c
        green = full((-22554 * b - 46802 * c + 32768) >> 16, *up_b) if same else (-22554 * full(b, *up_b) - 46802 * full(c, *up_c) + 32768) >> 16
        dst[:, :, 1] = np.clip(y + green, 0, 255)
        dst[:, :, 2] = np.clip(y + full((116130 * b + 32768) >> 16, *up_b), 0, 255)
    return out[: image.height, : image.width]


def payload_from(coef: np.ndarray, size: int) -> bytes:
    return (coef[: size // 64] + 128).astype(np.uint8).tobytes()


def feature(rgb: np.ndarray) -> str:
    """Shape and mean of each channel in thousandths."""
    h, w, _ = rgb.shape
    return f"{w}x{h}:" + ",".join(str(int(rgb[:, :, k].sum(dtype=np.int64)) * 1000 // (h * w)) for k in range(3))


# ---------------------------------------------------------------- DataFrames


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive rows of column 1 that are coded together."""
    at, held, size = 0, [], 0
    for i, v in enumerate(batch.column(1)):
        x = v.as_py()
        x = x.encode() if isinstance(x, str) else (x or b"")
        if held and (size + len(x) > BATCH_BYTES or len(held) >= BATCH_ROWS):
            yield at, held
            at, held, size = i, [], 0
        held.append(x)
        size += len(x)
    if held:
        yield at, held


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each whole text as a progressive JPEG file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in _groups(batch):
                media = encode_payloads([payload_of(t) for t in texts])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], names=["id", "n_bytes", "media"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string")).mapInArrow(run, f"id {kind}, n_bytes long, media binary").withColumnRenamed("id", id_col)


def decode_media(files: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """(id, height, width, rgb): tensors by rows of any progressive files; null media and files that can't be decoded give null."""

    def decoded(media: list[bytes]) -> Iterator[np.ndarray | None]:
        try:
            yield from [to_rgb(image, coef) for image, coef in zip(*decode_coefficients(media))]
        except (ValueError, IndexError, KeyError, struct.error):
            if len(media) == 1:
                yield None
            else:  # one by one, so that a broken file takes no other with it
                for m in media:
                    yield from decoded([m])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, media in _groups(batch):
                good = [i for i, m in enumerate(media) if m]
                tensors: list[np.ndarray | None] = [None] * len(media)
                for i, rgb in zip(good, decoded([media[i] for i in good])):
                    tensors[i] = rgb
                size = lambda k: pa.array([None if t is None else t.shape[k] for t in tensors], pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(media)), size(0), size(1), pa.array([None if t is None else t.tobytes() for t in tensors], pa.binary())], names=["id", "height", "width", "rgb"])

    kind = files.schema[id_col].dataType.simpleString()
    return files.select(F.col(id_col).alias("id"), F.col(media_col)).mapInArrow(run, f"id {kind}, height int, width int, rgb binary").withColumnRenamed("id", id_col)


def text_media_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``store_texts`` and ``decode_media`` in one pass, with digests of what was stored and of what was read back."""
    names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in _groups(batch):
                sizes = [len(payload_of(t)) for t in texts]
                media = encode_payloads([payload_of(t) for t in texts])
                rows = []
                for text, size, file, image, coef in zip(texts, sizes, media, *decode_coefficients(media), strict=True):
                    got = payload_from(coef, size)
                    rows.append((len(text), len(got), hashlib.sha256(got).hexdigest(), zlib.crc32(got[-64:]), len(file), hashlib.sha256(file).hexdigest(), feature(to_rgb(image, coef))))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), *(pa.array(list(c), k) for c, k in zip(zip(*rows), kinds))], names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string")).mapInArrow(
        run, f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )
    return out.withColumnRenamed("id", id_col)
