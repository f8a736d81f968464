"""Personal data by patterns and a semi-Markov conditional random field.

The base patterns give spans that always stay. The random field scores whole candidate segments: features look at
a span as a unit (kind of characters, digit groups, checksum, separators, the words before and after it), transitions score
the kinds of adjacent segments, and a dynamic program over segments of at most ``LONGEST`` tokens chooses boundaries and
types together. Its spans that overlap no base span are added: addresses spelled out ("jo at host dot com"), broken-up
network addresses, numbers without a plus sign, cards with a wrong digit where the words around them tell.

The field is fitted on a bounded sample of documents. Labels are the base spans of their own text (some hidden from the
field's pattern features, so that shape and context must explain them too) and planted forms: items of each kind written
as no base pattern takes them, and look-alikes that are none, set among words of the sample. It runs over stretches
around tokens that hold a digit, @ or a spelled-out mark; no other token can start or end a candidate, so the rest of
a text is outside by definition. Stretches have no greatest length.

Defined cases: null and empty texts have no spans; offsets count code points, end exclusive; equal texts give equal
spans and repeated rows are scanned one by one; of paths with equal scores the one with fewer and later spans wins, so
spans of the field never overlap; an empty table gives no rows; texts of any length are scanned in one pass; other
input columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import slices

KINDS = ("email", "ip", "card", "phone")
#: Most tokens in a segment, and tokens of context on either side of a stretch.
LONGEST, AROUND = 7, 4
#: Most documents that the field is fitted on: those whose ids hash lowest, of those with at most so many characters.
SAMPLE, SAMPLE_CHARS = 3000, 20_000
#: Stretches of the sample that are fitted (longer ones than ``FIT_TOKENS`` are left out), and planted ones.
STRETCHES, FIT_TOKENS, PLANTED = 4000, 200, 2000
#: Words that tell a kind, and words that tell something else; by these the field learns what context means.
TELLING = {
    "email": "mail email e-mail address contact write correo kontakt adresse courriel".split(),
    "ip": "ip host server gateway proxy node router addr servidor".split(),
    "card": "card cards visa mastercard amex credit debit karte kreditkarte tarjeta carte".split(),
    "phone": "call phone tel telephone mobile cell fax whatsapp telefon handy teléfono téléphone móvil".split(),
    "": "order invoice id isbn ref version page year article item sku code serial tracking total build issue number".split(),
}

Span = tuple[int, int, int]  # kind, start, end

# ---------------------------------------------------------------- base patterns

_AT_RUN = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_HINT = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    """Leftmost matches: a local part reaches as far left of its @ as its characters and the match before allow."""
    out, at, free = [], text.find("@"), 0
    while at >= 0:
        m = _DOMAIN.match(text, at)
        start = at
        if m:
            while start > free and _AT_RUN.match(text, start - 1):
                start -= 1
            if start < at:
                out.append((0, start, m.end()))
                free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def _ips(text: str) -> list[Span]:
    """Four parts at a time of each dotted chain; a part may not exceed 255."""
    out = []
    for m in _DOTTED.finditer(text):
        parts, at = m.group().split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:4] or 0) <= 255 for p in four):
                out.append((1, at, at + size))
            at += size + 1
    return out


def _cards(text: str) -> list[Span]:
    out = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() < 38:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    return out


def _phones(text: str) -> list[Span]:
    return [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]


def base_spans(text: str) -> list[Span]:
    """By kind as in ``KINDS``, then by start."""
    if not _HINT.search(text):
        return []
    return [*(_emails(text) if "@" in text else ()), *_ips(text), *_cards(text), *(_phones(text) if "+" in text else ())]


# ---------------------------------------------------------------- the field

_TOKEN = re.compile(r"\S+")
_SHAPE = re.compile(r"[0-9]+|[A-Za-z]+|[^\x00-\x7f]+")
_TRIM = ".,;:!?\"'$%&*#"
_DIGITS = re.compile(r"[0-9]+")
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)?")
_AT, _DOT = r"(?:\s*[\[({<]\s*at\s*[\])}>]\s*|\s+at\s+|@)", r"(?:\s*[\[({<]\s*dot\s*[\])}>]\s*|\s+dot\s+|\.)"
_SPELLED = re.compile(rf"[a-z0-9._%+-]+{_AT}[a-z0-9-]+(?:{_DOT}[a-z0-9-]+)+", re.I)
_BROKEN_IP = re.compile(r"[0-9]{1,3}(?:\s*[\[({]?\.[\])}]?\s*[0-9]{1,3}){3}")
_NUMBER = re.compile(r"[(+]?[0-9][0-9+().\- ]*")
#: What makes a stretch: a digit, @, or a spelled-out mark.
_MARK = re.compile(r"[0-9@]|[\[({<](?:at|dot)[\])}>]|(?<!\S)dot(?!\S)", re.I)
FEATURES = 1 << 13
OUTSIDE = len(KINDS)
LEXICON = {w: kind or "none" for kind, words in TELLING.items() for w in words}


class Field(NamedTuple):
    """Weights by kind and feature, and scores of moves from the kind of one segment to that of the next."""

    weights: np.ndarray
    moves: np.ndarray


def stretches(text: str) -> Iterator[list[tuple[int, int]]]:
    """Tokens (start, end) near those with a mark; trimmed of closing marks. Stretches don't overlap."""
    at = 0
    while (m := _MARK.search(text, at)) is not None:
        left = m.start()
        for k in range(AROUND + 1):  # back over a few tokens, not beyond the stretch before
            while left > at and not text[left - 1].isspace():
                left -= 1
            if k < AROUND:
                while left > at and text[left - 1].isspace():
                    left -= 1
        tokens, quiet, end = [], 0, left
        for t in _TOKEN.finditer(text, left):
            a, b = t.span()
            end = b
            quiet = 0 if _MARK.search(text, a, b) else quiet + 1
            while b - 1 > a and text[b - 1] in _TRIM:
                b -= 1
            while a < b - 1 and text[a] in "\"'<":
                a += 1
            tokens.append((a, b))
            if quiet > AROUND and a > m.start():
                break
        yield tokens
        at = max(end, m.end())


def _shape(s: str) -> str:
    return _SHAPE.sub(lambda m: "9" * min(4, len(m[0])) if m[0][0].isdigit() and m[0].isascii() else ("a" if m[0].isascii() else "u"), s)


def candidate_ends(text: str, tokens: list[tuple[int, int]], i: int) -> Iterator[int]:
    """Ends (token after the last) of the segments from token ``i`` that could be an entity by their build."""
    a = tokens[i][0]
    first = text[a : tokens[i][1]]
    numeric = first[0].isdigit() or first[0] in "(+"
    spelled = first[0].isalnum()
    for j in range(i, min(len(tokens), i + LONGEST)):
        b = tokens[j][1]
        if b - a > 120 and j > i:
            return
        s = text[a:b]
        if numeric and _NUMBER.fullmatch(s):
            if (7 if i == j else 9) <= sum(map(len, groups := _DIGITS.findall(s))) <= 22 and len(groups) <= 6:
                yield j + 1
                continue
        elif not spelled:
            return
        if spelled and (j == i or len(s) < 120) and (_SPELLED.fullmatch(s) or _BROKEN_IP.fullmatch(s)):
            yield j + 1


_BUCKETS: dict[str, int] = {}


def _bucket(name: str) -> int:
    b = _BUCKETS.get(name)
    if b is None:
        b = zlib.crc32(name.encode("utf-8", "replace")) % FEATURES
        if len(_BUCKETS) < 20_000:
            _BUCKETS[name] = b
    return b


def _near_words(text: str, tokens: list[tuple[int, int]], i: int, j: int) -> tuple[list[str], list[str]]:
    """Lower-case words of up to three tokens before a segment, nearest first, and two after it."""
    word = lambda t: (m[0].lower() if len(t) < 60 and (m := _WORD.search(t)) else "")
    before = [word(text[a:b]) for a, b in reversed(tokens[max(0, i - 3) : i])]
    return before, [word(text[a:b]) for a, b in tokens[j : j + 2]]


def segment_features(text: str, tokens: list[tuple[int, int]], i: int, j: int, with_pattern: bool = True) -> list[int]:
    """Hashed features of a whole span and of the words around it."""
    s = text[tokens[i][0] : tokens[j - 1][1]]
    groups = _DIGITS.findall(s)
    digits = "".join(groups)
    before, after = _near_words(text, tokens, i, j)
    build = "spelled" if _SPELLED.fullmatch(s) else "broken" if _BROKEN_IP.fullmatch(s) else "number"
    marks = "".join(sorted({c for c in s if not c.isalnum()}))[:8]
    size = f"{build}:{min(len(digits), 20)}"
    names = [
        "bias", build, f"shape={_shape(s)[:24]}", f"digits={size}", f"groups={'-'.join(str(min(len(g), 9)) for g in groups[:6])}", f"tokens={j - i}",
        f"first={s[0] if not s[0].isalnum() else ('9' if s[0].isdigit() else 'a')}", f"marks={build}:{marks}", f"before={build}:{before[0] if before else ''}",
        f"after={build}:{after[0] if after else ''}",
    ]
    told = {LEXICON[w] for w in before + after if w in LEXICON}
    names += [f"told={k}" for k in sorted(told)] + [f"told={k}:{size}" for k in sorted(told)] if told else [f"told=no:{size}"]
    if before and before[0] in LEXICON:
        names.append(f"next={LEXICON[before[0]]}")
    if 13 <= len(digits) <= 19 and build == "number":
        names.append(f"luhn={luhn(digits)}")
    if with_pattern:
        for k, f in enumerate((_emails, _ips, _cards, _phones)):
            names += [f"match={k}:{(a, b) == (0, len(s))}" for _, a, b in f(s)[:1]]
    return [_bucket(n) for n in names]


class Lattice:
    """Candidate segments of a stretch and their features."""

    def __init__(self, text: str, tokens: list[tuple[int, int]], hide: bool = False):
        self.n = len(tokens)
        self.segments = [(i, j) for i in range(self.n) for j in candidate_ends(text, tokens, i)]
        self.features = [segment_features(text, tokens, i, j, not hide) for i, j in self.segments]

    def scores(self, weights: np.ndarray) -> list[np.ndarray]:
        return [weights[:, f].sum(axis=1) for f in self.features]


def best_path(n: int, segments: list[tuple[int, int]], scores: list[np.ndarray], moves: np.ndarray) -> list[tuple[int, int, int]]:
    """(kind, first token, token after the last) of the best segmentation; outside tokens are segments of one and score 0."""
    by_end: dict[int, list] = {}
    for (i, j), s in zip(segments, scores):
        by_end.setdefault(j, []).append((i, s))
    m, states = moves.tolist(), range(OUTSIDE + 1)
    low = float("-inf")
    #: Best score of a path that ends before token j with a segment of each kind; where that segment and the one before come from.
    best = [[low] * OUTSIDE + [0.0]]
    back: list[list[tuple[int, int] | None]] = [[None] * (OUTSIDE + 1)]
    for j in range(1, n + 1):
        now, way = [low] * (OUTSIDE + 1), [None] * (OUTSIDE + 1)
        for y in states:
            if (v := best[j - 1][y] + m[y][OUTSIDE]) > now[OUTSIDE]:
                now[OUTSIDE], way[OUTSIDE] = v, (j - 1, y)
        for i, s in by_end.get(j, ()):
            for k in range(OUTSIDE):
                for y in states:
                    if (v := best[i][y] + m[y][k] + s[k]) > now[k]:
                        now[k], way[k] = v, (i, y)
        best.append(now)
        back.append(way)
    out, j = [], n
    y = max(reversed(states), key=lambda y: best[n][y])
    while j > 0:
        i, before = back[j][y]
        if y != OUTSIDE:
            out.append((y, i, j))
        j, y = i, before
    return out[::-1]


def viterbi(text: str, tokens: list[tuple[int, int]], field: Field, hide: bool = False) -> list[tuple[int, int, int]]:
    """The best segmentation of a stretch of any length.

    A token that no candidate covers is outside whatever the rest is, so the stretch is decided piece by piece between them.
    """
    out: list[tuple[int, int, int]] = []
    segments: list[tuple[int, int]] = []
    scores: list[np.ndarray] = []
    begin, reach = 0, 0  # of the piece at hand: its first token, and the end of what its candidates cover

    def decide(end: int) -> None:
        if segments:
            path = best_path(end - begin, [(i - begin, j - begin) for i, j in segments], scores, field.moves)
            out.extend((k, i + begin, j + begin) for k, i, j in path)
            segments.clear()
            scores.clear()

    for i in range(len(tokens)):
        ends = list(candidate_ends(text, tokens, i))
        if not ends and reach <= i:
            decide(i + 1)  # the outside token closes the piece
            begin = i + 1
            continue
        reach = max([reach, *ends])
        for j in ends:
            f = segment_features(text, tokens, i, j, not hide)
            segments.append((i, j))
            scores.append(field.weights[:, f].sum(axis=1).tolist())
    decide(len(tokens))
    return out


def _sum(x: np.ndarray, axis: int | None = None) -> np.ndarray:
    return np.logaddexp.reduce(x, axis=axis)


def likelihood(lattice: Lattice, gold: set[tuple[int, int, int]], field: Field, grad: np.ndarray, moves: np.ndarray) -> float:
    """Log likelihood of ``gold``; adds its slopes, observed minus expected counts, to ``grad`` and ``moves`` (forward-backward)."""
    n, w = lattice.n, field.moves
    scores = lattice.scores(field.weights)
    ends: dict[int, list[int]] = {}
    starts: dict[int, list[int]] = {}
    for x, (i, j) in enumerate(lattice.segments):
        ends.setdefault(j, []).append(x)
        starts.setdefault(i, []).append(x)
    fwd, bwd = np.full((n + 1, OUTSIDE + 1), -np.inf), np.full((n + 1, OUTSIDE + 1), -np.inf)
    into = np.full((n + 1, OUTSIDE + 1), -np.inf)  # all paths to a place and a move on to each kind
    fwd[0, OUTSIDE] = 0.0
    bwd[n] = 0.0
    for j in range(n + 1):
        if j:
            fwd[j, OUTSIDE] = into[j - 1, OUTSIDE]
            for x in ends.get(j, ()):
                fwd[j, :OUTSIDE] = np.logaddexp(fwd[j, :OUTSIDE], into[lattice.segments[x][0], :OUTSIDE] + scores[x])
        into[j] = _sum(fwd[j][:, None] + w, axis=0)
    total = float(_sum(fwd[n]))
    for i in range(n - 1, -1, -1):
        ahead = np.full(OUTSIDE + 1, -np.inf)
        ahead[OUTSIDE] = bwd[i + 1, OUTSIDE]
        for x in starts.get(i, ()):
            ahead[:OUTSIDE] = np.logaddexp(ahead[:OUTSIDE], scores[x] + bwd[lattice.segments[x][1], :OUTSIDE])
        bwd[i] = _sum(w + ahead[None, :], axis=1)
        moves -= np.exp(fwd[i][:, None] + w + ahead[None, :] - total)
    for x, ((i, j), s, f) in enumerate(zip(lattice.segments, scores, lattice.features)):
        p = -np.exp(into[i, :OUTSIDE] + s + bwd[j, :OUTSIDE] - total)
        for k in range(OUTSIDE):
            p[k] += (k, i, j) in gold
        for b in f:
            grad[:, b] += p
    # the gold path
    place, kind, value = 0, OUTSIDE, 0.0
    own = {i: (k, j) for k, i, j in gold}
    at = {seg: x for x, seg in enumerate(lattice.segments)}
    while place < n:
        k, j = own.get(place, (OUTSIDE, place + 1))
        value += w[kind, k] + (scores[at[place, j]][k] if k != OUTSIDE else 0.0)
        moves[kind, k] += 1
        place, kind = j, k
    return value - total


def planted(words: list[str], count: int = PLANTED, seed: int = 6) -> Iterator[tuple[str, dict[tuple[int, int], int]]]:
    """Snippets of ``words`` around one item each, and its kind by place: forms that no base pattern takes, and look-alikes without a kind."""
    rng = np.random.default_rng(seed)
    pick = lambda x: x[int(rng.integers(len(x)))]
    number = lambda n: "".join(str(d) for d in rng.integers(0, 10, n))

    def card(right: bool) -> str:
        d = pick("3456") + number(15)
        while luhn(d) != right:
            d = d[:-1] + str((int(d[-1]) + 1) % 10)
        return pick([d, " ".join((d[:4], d[4:8], d[8:12], d[12:])), "-".join((d[:4], d[4:8], d[8:12], d[12:]))])

    def email() -> str:
        name = pick(words)[:12] or "me"
        name = re.sub(r"[^A-Za-z0-9._%+-]", "", name) or "me"
        host, end = pick(["example", "mail7", "host", "post-1", "web"]), pick(["com", "org", "net", "de", "es", "fr", "example.com"])
        at, dot = pick([(" at ", " dot "), (" [at] ", " [dot] "), (" (at) ", " (dot) "), ("[at]", "[dot]"), ("(at)", "."), ("[at]", "."), (" AT ", " DOT "), ("@", " dot "), ("@", "[dot]"), (" (at) ", ".")])
        return pick([name, name + str(rng.integers(99))]) + at + host + dot + end.replace(".", dot)

    def phone() -> str:
        a, b, c = number(3), number(3), number(4)
        return pick([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a} {b} {c}", f"{a}.{b}.{c}", f"{a}{b}{c}", f"00{number(2)} {a} {b} {c}", f"0{a} {b}{c}"])

    def ip() -> str:
        dot = pick(["[.]", "(.)", " . ", " ."])
        parts = [str(x) for x in rng.integers(0, 256, 4)]
        return pick([dot.join(parts), parts[0] + dot + ".".join(parts[1:])])

    def other() -> str:
        return pick([number(int(rng.integers(7, 20))), f"{number(4)}-{number(2)}-{number(2)}", f"{number(2)}.{number(2)}.{number(4)}", f"{number(3)} {number(4)}", f"978-{number(1)}-{number(4)}-{number(4)}-{number(1)}", card(False), f"{number(1)}.{number(1)}.{number(2)}.{number(3)}.{number(1)}", f"{number(4)} {number(4)}"])

    makers = {"email": email, "ip": ip, "card": lambda: card(False), "phone": phone, "": other}
    for x in range(count):
        kind = pick(["email", "ip", "card", "phone", "", ""])
        item = makers[kind]()
        left, right = ([pick(words) for _ in range(int(rng.integers(0, 6)))] for _ in range(2))
        # what is a number without a plus sign or a right checksum is told by its words alone; other forms speak for themselves
        needs = kind in ("card", "phone") and not (kind == "phone" and item[0] == "(")
        if kind == "" and rng.random() < 0.4:
            left.append(pick(TELLING[""]))
        elif kind and (needs or rng.random() < 0.4):
            told = [pick(TELLING[kind]) + pick(["", "", ":", " no", " number"])] if rng.random() < 0.85 else []
            left += told + ([pick(words)] if rng.random() < 0.2 else [])
            if not told and needs:
                right.insert(0, pick(TELLING[kind]))
        elif kind == "" and rng.random() < 0.1:
            item = phone().replace("(", "").replace(")", "")  # a number nobody calls a phone
        head = " ".join(left)
        start = len(head) + bool(head)
        text = " ".join([*filter(None, [head]), item, *right]) + pick(["", ".", " ."])
        yield text, {(start, start + len(item)): KINDS.index(kind)} if kind else {}


def fit(texts: list[str], epochs: int = 6, rate: float = 0.3, decay: float = 1e-3, most: int = STRETCHES, plant: int = PLANTED) -> Field:
    """The field by AdaGrad on the conditional likelihood of base spans and of planted ones."""
    data = []

    def add(text: str, spans: dict[tuple[int, int], int], hide: bool) -> None:
        for tokens in stretches(text):
            if len(tokens) > FIT_TOKENS or len(data) >= most + plant:
                continue
            lattice = Lattice(text, tokens, hide)
            own = {(k, i, j) for i, j in lattice.segments if (k := spans.get((tokens[i][0], tokens[j - 1][1]))) is not None}
            gold, at = set(), 0
            for k, i, j in sorted(own, key=lambda g: (g[1], -g[2])):  # base spans of two kinds may overlap
                if i >= at:
                    gold.add((k, i, j))
                    at = j
            if lattice.segments:
                data.append((lattice, gold))

    for x, t in enumerate(texts):
        if len(data) >= most:
            break
        add(t, {(a, b): k for k, a, b in base_spans(t)}, x % 3 == 0)
    words = [w for t in texts[:300] for w in t.split()[:60] if not _MARK.search(w)] or ["some", "words", "here"]
    for x, (t, spans) in enumerate(planted(words, plant)):
        add(t, spans, x % 3 == 0)
    weights, moves = np.zeros((OUTSIDE, FEATURES)), np.zeros((OUTSIDE + 1, OUTSIDE + 1))
    squares, move_squares = np.full(weights.shape, 1e-4), np.full(moves.shape, 1e-2)
    order = np.random.default_rng(5)
    for _ in range(epochs):
        shuffled = order.permutation(len(data))
        for a in range(0, len(shuffled), 32):
            grad, move_grad = np.zeros_like(weights), np.zeros_like(moves)
            for x in shuffled[a : a + 32]:
                likelihood(*data[x], Field(weights, moves), grad, move_grad)
            grad -= decay * weights
            move_grad -= decay * moves
            squares += grad * grad
            move_squares += move_grad * move_grad
            weights += rate * grad / np.sqrt(squares)
            moves += rate * move_grad / np.sqrt(move_squares)
    return Field(weights, moves)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Field:
    """The field from at most ``sample`` documents of at most ``SAMPLE_CHARS`` characters that hold a digit or @."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_t")).where(F.col("_t").rlike("[0-9@]") & (F.char_length("_t") <= SAMPLE_CHARS))
    ids = rows.select("_id").where("_id is not null").orderBy(F.xxhash64("_id"), "_id").limit(sample)
    got = rows.join(F.broadcast(ids.distinct()), "_id").limit(2 * sample)  # bounded also if ids repeat
    return fit([t for _, t in sorted((r["_id"], r["_t"]) for r in got.toLocalIterator())])


def find_spans(text: str, field: Field) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans: those and the field's that overlap none of them; by kind, then start."""
    base = base_spans(text)
    taken = sorted((a, b) for _, a, b in base)
    starts, reach = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))

    def met(a: int, b: int) -> bool:
        """Whether a base span overlaps this stretch: of those that start before its end the one that reaches furthest."""
        k = bisect_left(starts, b)
        return k > 0 and reach[k - 1] > a

    extra = []
    for tokens in stretches(text):
        if met(tokens[0][0], tokens[-1][1]) and all(met(a, b) for a, b in tokens if _MARK.search(text, a, b)):
            continue  # every candidate meets a base span
        for k, i, j in viterbi(text, tokens, field):
            a, b = tokens[i][0], tokens[j - 1][1]
            if not met(a, b):
                extra.append((k, a, b))
    return base, sorted({*base, *extra})


def shown(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def masked(text: str, spans: list[Span]) -> str:
    """``text`` with every span replaced by its kind in angle brackets; of overlapping spans the union by the first's kind."""
    out, at = [], 0
    for a, b, k in sorted((a, b, k) for k, a, b in spans):
        if a >= at:
            out += [text[at:a], f"<{KINDS[k]}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text", mask: bool = False) -> DataFrame:
    """(id, base, spans, masked): strings kind:start:end, and the masked text if ``mask``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, spans, texts = [], [], []
            for v in batch.column(1):
                text = v.as_py()
                b, s = find_spans(text or "", field)
                base.append([f"{KINDS[k]}:{x}:{y}" for k, x, y in b])
                spans.append([f"{KINDS[k]}:{x}:{y}" for k, x, y in s])
                texts.append((masked(text, s) if s and text else text) if mask else None)
            kind = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, kind), pa.array(spans, kind), pa.array(texts, pa.string())], names=["id", "base", "spans", "masked"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string")).mapInArrow(run, f"id {kind}, base array<string>, spans array<string>, masked string")
    return out.withColumnRenamed("id", id_col)


def redact(docs: DataFrame, field: Field, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs`` with all spans of ``text_col`` replaced by their kinds, and ``length_col``, where there is one, brought in line."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = []
            for v in batch.column(at):
                text = v.as_py()
                spans = find_spans(text, field)[1] if text else []
                texts.append(masked(text, spans) if spans else text)
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    out = docs.mapInArrow(run, docs.schema)
    if length_col in docs.columns:
        out = out.withColumn(length_col, F.char_length(text_col).cast(docs.schema[length_col].dataType))
    return out
