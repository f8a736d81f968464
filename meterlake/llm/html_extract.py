"""Main text of web pages by minimum-cut labelling.

A page is cut into blocks of text. A logistic classifier gives each block the costs of being content or boilerplate,
which become capacities to the two terminals; neighbouring blocks, and successive blocks of one container, are tied
by smoothness edges that weaken with their distance in the DOM. Maximum flow separates content from boilerplate.

The classifier is fitted on a bounded sample of pages whose markup says what is what (article, main; nav, footer,
forms, class names and so on), towards a prior that holds where the sample is silent. Every such block counts three times:
as it is, with that markup hidden, and with all tags hidden, so that its links and text must tell what it is; where a page
has no telling markup these decide together with the neighbours that the cut ties a block to.

Defined cases: null and empty pages give empty text; broken markup is read as far as it goes: a "<" that starts no whole
tag is text, and a tag holds no "<" outside quotes; an unclosed comment, script or style runs to the end; select, button,
svg, iframe, textarea, noscript and template are dropped up to their end tag or, without one, up to the next tag of a block,
and alone if self-closing; a head ends at its end tag, <body>, another block or text outside its title; equal pages give
equal texts; an empty table gives no rows; pages of any length and depth are read whole, in time that grows with their
length; other input columns are ignored.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Most pages that the classifier is fitted on (those whose ids hash lowest), and most characters of each: longer ones are not in the sample.
SAMPLE, SAMPLE_CHARS = 800, 50_000
#: Strength of smoothness between neighbours in one container.
SMOOTH = 1.0

_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:._-]*)((?:=\s*\"[^\"]*+\"|=\s*'[^']*+'|[^<>=]++|=)*+)>")
_DECLARATION = re.compile(r"<(?:[!?][^<>]*|/)>")
_RAW = re.compile(r"<(/?)(textarea|iframe|title)\b", re.I)
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in ("script", "style")}
#: Tags that end a block of text.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: Tags whose nesting is followed.
CONTAINER = frozenset("article aside body div dl details dialog fieldset figure footer form header html main menu nav ol section table ul blockquote".split())
#: Elements whose text is not text of the page.
HIDDEN = frozenset("head title select button svg iframe textarea noscript template".split())
#: Elements inside a block that are looked at for links and adverts.
INLINE = frozenset("a span b strong em i u small ins font mark label".split())
_ATTR = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
_HIDDEN_WORD = re.compile(r"(?:^|\s)hidden(?=[\s/=]|$)", re.I)
_NOT_SHOWN = re.compile(r"style\s*=\s*[\"'][^\"']*display\s*:\s*none", re.I)
#: Parts of class, id and role names that mark boilerplate or content.
BAD_NAME = frozenset(
    "ad ads advert adverts advertisement adsense alert banner breadcrumb breadcrumbs button comment comments commentlist complementary consent contentinfo cookie cookies disqus dialog disclaimer footer form gdpr header legal login masthead menu menubar modal nav navbar navigation newsletter notice notification pagination popup promo promoted related replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe subscription tags toolbar".split()
)
GOOD_NAME = frozenset("article content entry main post story text body".split())
#: Those that mark an advert inside a block.
INLINE_BAD = frozenset("ad ads advert adverts advertisement adsense promo promoted share sharing social sponsor sponsored subscribe newsletter popup".split())
#: A name with one of these parts says what a page has or lacks, what state it is in or how a post is filed, not what the element is.
TELLS_OTHER = frozenset(
    "no not has have with without is js single category tag type format status enabled disabled open opened closed fixed sticky active on off template layout page theme mode ready loaded supports".split()
)
#: Last parts that name a piece of whatever stands before them.
PIECE = frozenset("area bar block body box button buttons col column container content group heading holder icon icons inner item items label link links list panel row section text title top bottom unit wrap wrapper zone widget widgets".split())
BAD_TAG = frozenset("nav footer header aside menu".split())
#: Tags that may just as well wrap a whole page.
SOFT_TAG = frozenset("form fieldset dialog".split())
GOOD_TAG = frozenset("article main".split())
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Words from which a block that is not mostly links counts as running text, without the end of a sentence.
RUNNING_WORDS = 8

#: ``good`` is content markup without boilerplate markup inside it; such markup outweighs what text and links say.
FEATURES = ("bias", "log_words", "link_share", "bad", "good", "heading", "paragraph", "item", "sentence", "stops", "in_list", "copyright")
PRIOR = np.array([-1.0, 0.5, -3.0, -10.0, 6.0, 0.3, 0.5, -0.5, 0.5, 0.5, -0.5, -2.0])
#: Places of the features that come from telling markup, and of those that come from any.
TELLING = [FEATURES.index(f) for f in ("bad", "good")]
MARKUP = TELLING + [FEATURES.index(f) for f in ("heading", "paragraph", "item", "in_list")]


class Block:
    __slots__ = ("text", "home", "far", "tag", "bad", "good", "linked", "in_list", "soft")

    def __init__(self, text: str, home: int, far: int, tag: str, bad: bool, good: bool, linked: int, in_list: bool, soft: int = 0):
        #: Number of the container, steps in the DOM from the container of the block before, characters inside links, and
        #: number of the nearest element around whose boilerplate markup may fade (see ``_fade``).
        self.text, self.home, self.far, self.tag, self.bad, self.good, self.linked, self.in_list, self.soft = text, home, far, tag, bad, good, linked, in_list, soft

    def running(self) -> int:
        """Characters, if this is running text."""
        t = self.text
        return len(t) if 2 * self.linked < len(t) and (t[-1] in ".!?…\"'”" or t.count(" ") >= RUNNING_WORDS - 1) else 0


def _names(attrs: str) -> Iterator[list[str]]:
    """The parts of each class, id and role name that says what an element is, in order."""
    for m in _ATTR.finditer(attrs):
        for name in (m[1] or m[2] or m[3] or "").split():
            parts = [x.lower() for x in _NAME.findall(name)]
            if TELLS_OTHER.isdisjoint(parts):
                yield parts


def _says(parts: list[str], words: frozenset[str]) -> bool:
    """Whether a name's first part, or its last that is more than a piece of something, is one of ``words``."""
    last = len(parts)
    while last > 1 and parts[last - 1] in PIECE:
        last -= 1
    return bool(parts) and (parts[0] in words or parts[last - 1] in words)


def _kind(tag: str, attrs: str, inside_good: bool) -> tuple[bool, bool, bool]:
    """Whether an element's markup says boilerplate for sure, says it but may fade, and says content.

    A name is judged as a whole. A tag or a name that says content overrules other names of the same element; the names of a
    whole page say nothing of its parts.
    """
    if tag == "body" or tag == "html":
        return False, False, False
    bad, good, named = tag in BAD_TAG and not (tag == "header" and inside_good), tag in GOOD_TAG, False
    if "=" in attrs:
        wrong = BAD_NAME - {"header"} if inside_good else BAD_NAME
        for parts in _names(attrs):
            if _says(parts, wrong):
                named = True
            elif not GOOD_NAME.isdisjoint(parts):
                good = True
    low = attrs.lower()
    unseen = "hidden" in low and _HIDDEN_WORD.search(_QUOTED.sub("", attrs)) or "display" in low and _NOT_SHOWN.search(attrs)
    return bad or bool(unseen), (named and not good) or tag in SOFT_TAG, good


def _fade(blocks: list[Block], above: list[int]) -> None:
    """Settle which blocks stay marked as boilerplate.

    ``above``: for each soft element, by number from 1, the one around it (0: none). Names, and the tags of forms, are evidence: where
    an element holds most of the page's running text, and no content markup stands outside it but inside other such elements, its
    mark fades. In one pass down and one up, for elements of any depth.
    """
    inside, good_own = [0] * len(above), [0] * len(above)
    for b in blocks:
        if not b.bad:
            inside[b.soft] += b.running()
            good_own[b.soft] += b.good
    for e in range(len(above) - 1, 0, -1):
        inside[above[e]] += inside[e]
    outside, marked = [0] * len(above), [False] * len(above)
    for e in range(1, len(above)):
        up = above[e]
        outside[e] = outside[up] + good_own[up]
        marked[e] = marked[up] or 2 * inside[e] <= inside[0] or outside[e] > 0
    for b in blocks:
        b.bad = b.bad or marked[b.soft]


Piece = tuple[int, int, str, bool, str]  # start, end, name ("" if nothing of it counts), is an end tag, attributes


def pieces_of(page: str) -> list[Piece]:
    """Tags, comments and raw elements of a page, in order; all else is text."""
    out: list[Piece] = []
    last = page.rfind(">")
    raw: dict[str, tuple[list[int], list[int]]] | None = None
    at = 0
    while (i := page.find("<", at)) >= 0:
        if page.startswith("<!--", i):
            short = 5 if page.startswith("<!-->", i) else 6 if page.startswith("<!--->", i) else 0
            end = i + short if short else page.find("-->", i + 4) + 3
            at = end if end > i else len(page)
            out.append((i, at, "", False, ""))
            continue
        if i > last:
            break
        m = _TAG.match(page, i)
        if m is None:
            d = _DECLARATION.match(page, i)
            if d is not None:
                out.append((i, d.end(), "", False, ""))
            at = d.end() if d is not None else i + 1
            continue
        at = m.end()
        name, ending, attrs = m[2].lower(), bool(m[1]), m[3]
        if not ending:
            alone = attrs.endswith("/")
            if name in _RAW_END:
                e = _RAW_END[name].search(page, at)
                at = e.end() if e is not None else at if alone else len(page)
                name = ""
            elif name in ("textarea", "iframe", "title") and not alone:
                if raw is None:
                    raw = {}
                    for r in _RAW.finditer(page):
                        raw.setdefault(r[2].lower(), ([], []))[bool(r[1])].append(r.start())
                starts, ends = raw.get(name, ([], []))
                k, j = bisect_left(ends, at), bisect_left(starts, at)
                if k < len(ends) and not (j < len(starts) and starts[j] < ends[k]) and (e := page.find(">", ends[k])) >= 0:
                    at, name = e + 1, ""
        out.append((i, at, name, ending, attrs))
    return out


def _ends(pieces: list[Piece]) -> dict[int, int]:
    """The piece that ends each piece which opens a hidden or inline element, where there is one."""
    waiting: dict[str, list[int]] = {}
    out: dict[int, int] = {}
    for k, (_, _, name, ending, attrs) in enumerate(pieces):
        if name in HIDDEN or name in INLINE:
            before = waiting.setdefault(name, [])
            if not ending:
                if not attrs.rstrip().endswith("/"):
                    before.append(k)
            elif before:
                out[before.pop()] = k
    return out


def blocks_of(page: str) -> list[Block]:
    """Blocks in page order: text with references decoded and white space made single, and where it stands."""
    out: list[Block] = []
    #: Open containers: tag, number, bad (for sure) and good so far, inside a list, nearest soft element.
    stack: list[tuple[str, int, int, bool, bool, int]] = [("", 0, 0, False, False, 0)]
    above = [0]  # of each soft element the one around it
    opened: dict[str, int] = {}
    number, tag, bad_here, linked = 0, "", False, 0
    depth_before, lowest = 1, 1  # depth of the block before, and least depth since
    parts: list[str] = []

    def close() -> None:
        nonlocal linked, depth_before, lowest
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                _, home, bad, good, in_list, soft = stack[-1]
                far = depth_before + len(stack) - 2 * lowest
                out.append(Block(text, home, far, tag, bad > 0 or bad_here, good, min(linked, len(text)), in_list, soft))
                depth_before = lowest = len(stack)
            parts.clear()
        linked = 0

    pieces = pieces_of(page)
    ends = _ends(pieces)
    next_block, k = [len(pieces)] * (len(pieces) + 1), len(pieces)
    while k:
        k -= 1
        next_block[k] = k if pieces[k][2] in BLOCK else next_block[k + 1]
    at, skip_to, link_to = 0, -1, -1
    hidden = ""  # the open head, or an element without an end tag
    for k, (start, end, name, ending, attrs) in enumerate(pieces):
        if k < skip_to:
            continue
        run = page[at:start] if k > skip_to else ""
        if hidden == "head" and run and not run.isspace():
            hidden = ""
        if run and not hidden:
            parts.append(run)
            if k <= link_to:
                linked += len(run)
        at = end
        if not name or k == skip_to:
            continue
        if name in HIDDEN and (name != "title" or hidden == "head"):
            if ending:
                hidden = "" if name == hidden else hidden
            elif k in ends and name != "head":
                skip_to = ends[k]
            elif not attrs.rstrip().endswith("/") and not (hidden and name != "title"):
                hidden = name
            continue
        if hidden:
            if name not in BLOCK or name == "html":
                continue
            hidden = ""
        if name in BLOCK:
            close()
            if name in CONTAINER:
                if not ending:
                    top = stack[-1]
                    bad, soft, good = _kind(name, attrs, top[3] and not top[2] and not top[5])
                    number += 1
                    opened[name] = opened.get(name, 0) + 1
                    if soft:
                        above.append(top[5])
                    # content markup inside boilerplate stays boilerplate; boilerplate inside content counts again
                    stack.append((name, number, top[2] + bad, top[3] or good, top[4] or name in ("ul", "ol", "menu"), len(above) - 1 if soft else top[5]))
                elif opened.get(name):
                    while True:
                        gone = stack.pop()[0]
                        opened[gone] -= 1
                        if gone == name:
                            break
                    lowest = min(lowest, len(stack))
                tag, bad_here = "", False
            elif ending:
                tag, bad_here = "", False
            else:
                tag, bad_here = name, any(_kind(name, attrs, stack[-1][3] and not stack[-1][2] and not stack[-1][5])[:2]) if attrs else False
        elif name == "br":
            parts.append(" ")
        elif name in INLINE and not ending and k in ends:
            if name == "a":
                link_to = max(link_to, ends[k])
            if "=" in attrs and next_block[k] > ends[k] and any(_says(x, INLINE_BAD) for x in _names(attrs)):
                parts.append(" ")
                skip_to = ends[k]
    rest = page[at:]
    if not hidden or (hidden == "head" and not rest.isspace()):
        parts.append(rest)
    close()
    _fade(out, above)
    return out


def features(blocks: list[Block]) -> np.ndarray:
    rows = []
    for b in blocks:
        t = b.text
        words = t.count(" ") + 1
        rows.append((
            1.0, min(5.0, float(np.log1p(words))), b.linked / len(t), float(b.bad), float(b.good and not b.bad),
            float(b.tag[:1] == "h" and len(b.tag) == 2), float(b.tag == "p"), float(b.tag == "li"), float(t[-1] in ".!?…\"'”"),
            min(3.0, float(np.log1p(t.count(". ") + t.count(", ")))), float(b.in_list), float("©" in t),
        ))
    return np.array(rows).reshape(-1, len(FEATURES))


def fit(pages: list[str], steps: int = 60, towards_prior: float = 0.02) -> np.ndarray:
    """Weights by Newton steps on blocks whose markup is telling, each with it, without it and without any, drawn towards ``PRIOR``."""
    x, y = [], []
    for p in pages:
        blocks = [b for b in blocks_of(p) if b.bad or b.good]
        if blocks:
            x.append(features(blocks))
            y += [float(b.good and not b.bad) for b in blocks]
    if not x:
        return PRIOR.copy()
    x, y, w = np.concatenate(x), np.array(y), PRIOR.copy()
    plain, bare = x.copy(), x.copy()
    plain[:, TELLING] = 0.0
    bare[:, MARKUP] = 0.0
    x, y = np.concatenate([x, plain, bare]), np.concatenate([y, y, y])
    pull = towards_prior * len(y) * np.eye(len(w)) / len(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + pull, x.T @ (y - p) - pull @ (w - PRIOR))
        w = w + np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-6:
            break
    return w


def ties(blocks: list[Block], smooth: float = SMOOTH) -> list[tuple[int, int, float]]:
    """Smoothness edges: of neighbours, and of successive blocks of the same container."""
    out, last = [], {}
    for i, b in enumerate(blocks):
        if i:
            out.append((i - 1, i, smooth / (1 + b.far) ** 2))
        before = last.get(b.home)
        if before is not None and before < i - 1:
            out.append((before, i, smooth / 2))
        last[b.home] = i
    return out


def min_cut(gain: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels of least cost: True keeps ``gain`` > 0 joined to the source; an edge costs where its ends differ.

    ``gain`` is the difference of the two terminal capacities, the part of the flow that passes source, block and sink
    directly being taken off. A block whose terminal capacity exceeds all its edges keeps to its terminal whatever the
    others do; it is merged into it, and its edges become capacities of its neighbours, which may decide these in turn.
    Maximum flow on what is left: highest label first, with relabelling by gaps; what cannot reach the sink is content.
    """
    n, eps = len(gain), 1e-9
    g = list(gain)
    near: list[list[int]] = [[] for _ in range(n)]
    head, room = [], []
    for a, b, w in edges:
        near[a].append(len(head))
        near[b].append(len(head) + 1)
        head += [b, a]
        room += [w, w]
    tied = [sum(room[e] for e in near[i]) for i in range(n)]
    label: list[bool | None] = [None] * n
    todo = [i for i in range(n) if abs(g[i]) > tied[i]]
    while todo:
        i = todo.pop()
        if label[i] is not None:
            continue
        label[i] = g[i] > 0
        for e in near[i]:
            j = head[e]
            if label[j] is None:
                g[j] += room[e] if label[i] else -room[e]
                tied[j] -= room[e]
                if abs(g[j]) > tied[j] + eps:
                    todo.append(j)
    rest = [i for i in range(n) if label[i] is None]
    if not rest:
        return label
    for i in rest:
        near[i] = [e for e in near[i] if label[head[e]] is None]
    # labels of flow: distance to the sink, found from the blocks that have capacity to it
    top = n + 1
    excess = [max(0.0, v) for v in g]
    to_sink = [max(0.0, -v) for v in g]
    high = [top] * n
    line = [i for i in rest if to_sink[i] > eps]
    for i in line:
        high[i] = 1
    for i in line:
        for e in near[i]:
            if high[head[e]] == top:
                high[head[e]] = high[i] + 1
                line.append(head[e])
    at_level = [0] * (top + 2)
    active: dict[int, list[int]] = {}
    members: dict[int, set[int]] = {}
    for i in rest:
        at_level[high[i]] += 1
        members.setdefault(high[i], set()).add(i)
        if excess[i] > eps and high[i] < top:
            active.setdefault(high[i], []).append(i)
    highest = max(active, default=0)
    current = [0] * n

    def move(i: int, to: int) -> None:
        at_level[high[i]] -= 1
        members[high[i]].discard(i)
        high[i] = to
        at_level[to] += 1
        members.setdefault(to, set()).add(i)

    widest = max((h for h in high if h < top), default=0)
    while highest > 0:
        if not active.get(highest):
            highest -= 1
            continue
        i = active[highest].pop()
        if high[i] != highest or excess[i] <= eps:
            continue
        while excess[i] > eps and high[i] < top:
            if high[i] == 1 and to_sink[i] > eps:
                flow = min(excess[i], to_sink[i])
                excess[i] -= flow
                to_sink[i] -= flow
                continue
            if current[i] < len(near[i]):
                e = near[i][current[i]]
                j = head[e]
                if room[e] > eps and high[i] == high[j] + 1:
                    flow = min(excess[i], room[e])
                    room[e] -= flow
                    room[e ^ 1] += flow
                    excess[i] -= flow
                    if excess[j] <= eps:
                        active.setdefault(high[j], []).append(j)
                    excess[j] += flow
                else:
                    current[i] += 1
                continue
            old = high[i]
            low = min((high[head[e]] for e in near[i] if room[e] > eps), default=top)
            if to_sink[i] > eps:
                low = 0
            current[i] = 0
            move(i, min(top, low + 1))
            widest = max(widest, high[i] if high[i] < top else 0)
            if at_level[old] == 0 and old < top:  # a gap: what lies above it has lost the sink
                for h in range(old + 1, widest + 1):
                    for j in list(members.get(h, ())):
                        move(j, top)
                widest = old - 1
        if excess[i] > eps and high[i] < top:
            active.setdefault(high[i], []).append(i)
        highest = max(highest, high[i] if high[i] < top else 0)
    # what can still reach the sink is boilerplate
    sunk = [i for i in rest if to_sink[i] > eps]
    for i in rest:
        label[i] = True
    for i in sunk:
        label[i] = False
    for i in sunk:
        for e in near[i]:
            j = head[e]
            if label[j] and room[e ^ 1] > eps:
                label[j] = False
                sunk.append(j)
    return label


def extract_text(page: str, weights: np.ndarray) -> str:
    blocks = blocks_of(page)
    if not blocks:
        return ""
    gain = (features(blocks) @ weights).tolist()  # log odds: the difference of the two costs
    keep = min_cut(gain, ties(blocks))
    return "\n\n".join(b.text for b, k in zip(blocks, keep) if k)


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE) -> np.ndarray:
    """Weights from at most ``sample`` pages of at most ``SAMPLE_CHARS`` characters."""
    rows = pages.select(F.col(id_col).alias("_id"), F.col(html_col).cast("string").alias("_h")).where(F.char_length("_h") <= SAMPLE_CHARS)
    ids = rows.select("_id").orderBy(F.xxhash64("_id"), "_id").limit(sample)
    got = rows.join(F.broadcast(ids.distinct()), "_id").limit(2 * sample)  # bounded also if ids repeat
    return fit([h for _, h in sorted(((r["_id"], r["_h"] or "") for r in got.toLocalIterator()), key=lambda x: (x[0] is None, x))])


def extract(pages: DataFrame, weights: np.ndarray, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """(id, kept columns, text) per page; a narrow map."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract_text(h, weights) if h else "" for h in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(texts, pa.string())], names=["id", *keep, "text"])

    kinds = "".join(f"`{k}` {pages.schema[k].dataType.simpleString()}, " for k in keep)
    narrow = pages.select(F.col(id_col).alias("id"), F.col(html_col).cast("string").alias("_h"), *keep)
    out = narrow.mapInArrow(run, f"id {pages.schema[id_col].dataType.simpleString()}, {kinds}text string")
    return out.withColumnRenamed("id", id_col)
