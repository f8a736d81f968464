"""Diffraction peaks: detection and least squares on scans packed one to a row, tables around them native.

No scan fails the job: a scan that can't be analysed, for its points or for an error inside, is a row with an issue.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .curves import M, MAD_TO_SIGMA, NOISE_TIMES, PROMINENCE_SHARE, SCAN_LEAST, overlap_groups, savgol_weights, snip

#: Defaults of the analysis.
DEFAULTS = {"baseline_deg": 5.0, "window": 7, "order": 2, "share": PROMINENCE_SHARE, "distance_deg": 0.1, "least_width": 2, "times": 4.0, "most": 80}
FWHM_PER_SIGMA = 2.354820045030949
POINTS_PER_PEAK = 5
R2_WARN = 0.8


@lru_cache(maxsize=64)
def _end_fit(window: int, order: int) -> np.ndarray:
    """What the least-squares fit to a window makes of its values, as a matrix."""
    v = np.vander(np.arange(window) - window // 2, order + 1, increasing=True).astype(float)
    return v @ np.linalg.pinv(v)


def _smooth(y: np.ndarray, window: int, order: int) -> np.ndarray:
    """Least-squares smoothing along the last axis; the ends take the values of the fit to the first and last window."""
    half, n, weights, ends = window // 2, y.shape[-1], savgol_weights(window, order), _end_fit(window, order)
    out = np.empty_like(y)
    inner = out[..., half : n - half]
    np.multiply(y[..., : n - 2 * half], weights[0], out=inner)
    for k in range(1, window):
        inner += y[..., k : n - window + 1 + k] * weights[k]
    out[..., :half] = sum(y[..., k, None] * ends[:half, k] for k in range(window))
    out[..., n - half :] = sum(y[..., n - window + k, None] * ends[window - half :, k] for k in range(window))
    return out


def _maxima(s: np.ndarray) -> np.ndarray:
    """Middles of flat tops that fall on both sides."""
    change = np.flatnonzero(np.diff(s) != 0)
    starts, ends = np.concatenate([[0], change + 1]), np.concatenate([change, [len(s) - 1]])
    v = s[starts]
    top = np.flatnonzero((v[1:-1] > v[:-2]) & (v[1:-1] > v[2:])) + 1
    return (starts[top] + ends[top]) // 2


def _lows(s: list[float]) -> list[int]:
    """For every point where the lowest one lies, the nearest of equals, between it and the next higher point to its left.

    A stack of falling heights, each with the lowest point since the one before it: every point is pushed and popped once.
    """
    out, stack = [], []
    for j, v in enumerate(s):
        low = j
        while stack and s[stack[-1][0]] <= v:
            _, k = stack.pop()
            if s[k] < s[low]:
                low = k
        stack.append((j, low))
        out.append(low)
    return out


#: Peaks of a scan that are looked up one by one rather than by a pass over all its points.
FEW_PEAKS = 12


def _prominence(s: np.ndarray, i: int) -> tuple[float, int, int]:
    """As of ``_prominences``, of one peak."""
    higher = np.flatnonzero(s > s[i])
    k = int(np.searchsorted(higher, i))
    lo = int(higher[k - 1]) + 1 if k else 0
    hi = int(higher[k]) if k < len(higher) else len(s)
    a, b = i - int(np.argmin(s[lo : i + 1][::-1])), i + int(np.argmin(s[i:hi]))
    return float(s[i] - max(s[a], s[b])), a, b


def _prominences(s: np.ndarray, at: np.ndarray) -> list[tuple[float, int, int]]:
    """Of each point in ``at``: height above the higher of the two lowest points before higher ground, and where these are; linear in the scan."""
    if not len(at):
        return []
    if len(at) <= FEW_PEAKS:
        return [_prominence(s, int(i)) for i in at]
    v, last = s.tolist(), len(s) - 1
    left, right = _lows(v), _lows(v[::-1])
    ends = [(i, left[i], last - right[last - i]) for i in at.tolist()]
    return [(v[i] - max(v[a], v[b]), a, b) for i, a, b in ends]


def _half_width(s: np.ndarray, i: int, prominence: float, left: int, right: int) -> float:
    """Distance between the crossings at half the prominence, by straight lines."""
    level = s[i] - prominence / 2
    a = i
    while a > left and s[a] > level:
        a -= 1
    b = i
    while b < right and s[b] > level:
        b += 1
    x = a + (level - s[a]) / (s[a + 1] - s[a]) if s[a] < level else float(a)
    y = b - (level - s[b]) / (s[b - 1] - s[b]) if s[b] < level else float(b)
    return y - x


def find_peaks(s: np.ndarray, threshold: float, distance: int, least_width: float) -> list[tuple[int, float, float]]:
    """(index, prominence, width) of peaks: the highest win within a distance, then prominence and width decide."""
    at = _maxima(s)
    keep = np.ones(len(at), bool)
    for k in np.argsort(s[at], kind="stable")[::-1].tolist() if distance > 1 else ():
        if keep[k]:
            for side in (range(k - 1, -1, -1), range(k + 1, len(at))):
                for j in side:
                    if abs(int(at[j]) - int(at[k])) >= distance:
                        break
                    keep[j] = False
    out = []
    at = at[keep & (s[at] - s.min() >= threshold)]  # no peak stands higher above its surroundings than above all
    for i, (p, left, right) in zip(at.tolist(), _prominences(s, at)):
        if p >= threshold and (w := _half_width(s, i, p, left, right)) >= least_width:
            out.append((i, p, w))
    return out


# ---------------------------------------------------------------- scans in rows

#: Scans and points that are worked on together.
MOST_SCANS, MOST_POINTS = 256, 131_072


class Scan:
    """Finite points by x, and what has been found of them; ``fault`` says why a scan can't be analysed."""

    def __init__(self, row: int, idx: np.ndarray, x: np.ndarray, y: np.ndarray):
        order = np.lexsort((idx, x))
        self.row, self.x, self.y = row, x[order], y[order]
        self.fault: str | None = None


def _packed(points: DataFrame) -> DataFrame:
    """(measurement_id, scan): the points of a scan in one row."""
    return points.select(M, "idx", "x", "y").groupBy(M).agg(F.collect_list(F.struct(F.col("idx").cast("double").alias("idx"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))).alias("scan"))


def _slices(batch: pa.RecordBatch, column: str = "scan") -> Iterator[tuple[pa.Array, list[tuple[np.ndarray, ...]]]]:
    """Keys and fields of the lists of a batch, so many scans or points at a time."""
    lists = batch.column(column)
    offsets, flat = lists.offsets.to_numpy(), lists.values
    fields = [flat.field(k).to_numpy(zero_copy_only=False) for k in range(flat.type.num_fields)]
    at, n = 0, len(lists)
    while at < n:
        end = min(n, at + MOST_SCANS, max(at + 1, int(np.searchsorted(offsets, offsets[at] + MOST_POINTS, "right")) - 1))
        yield batch.column(0).slice(at, end - at), [tuple(f[offsets[k] : offsets[k + 1]] for f in fields) for k in range(at, end)]
        at = end


def _read_scans(lists: list[tuple[np.ndarray, ...]]) -> list[Scan]:
    out = []
    for row, (idx, x, y) in enumerate(lists):
        x, y = np.asarray(x, float), np.asarray(y, float)
        good = np.isfinite(x) & np.isfinite(y)
        out.append(Scan(row, np.asarray(idx, float)[good], x[good], y[good]))
    return out


def _over_scans(points: DataFrame, kinds: str, work: Callable[[pa.Array, list[Scan]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """Rows that ``work`` makes of scans, many at a time; keys are those of the slice's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, lists in _slices(batch):
                yield from work(keys, _read_scans(lists))

    return _packed(points).mapInArrow(run, kinds)


def _table(keys: pa.Array, rows: np.ndarray | list[int], **columns) -> pa.RecordBatch:
    """A batch of the keys at ``rows`` and of columns: arrays of Arrow as they are, others by their values."""
    arrays = [v if isinstance(v, pa.Array) else pa.array(v) for v in columns.values()]
    return pa.RecordBatch.from_arrays([keys.take(pa.array(rows, pa.int64())), *arrays], [M, *columns])


def scan_peaks(points: DataFrame, threshold: float = 0.0, distance: int = 1, least_width: float = 0.0, most: int = DEFAULTS["most"]) -> DataFrame:
    """(measurement_id, idx, height, prominence, width, n_found) of the peaks of y as it is.

    idx counts the scan's finite points by x from 0. A flat top counts once, at its middle. Of peaks closer than ``distance`` points
    the higher one stays; then prominence (at least ``threshold``) and width at half of it, in points, decide. Of more than
    ``most`` peaks the highest are given, ``n_found`` counts all (see ``capped``). A scan without peaks has no rows.
    """

    def work(keys, scans):
        rows = []
        for scan in scans:
            s = scan.y
            found = find_peaks(s, threshold, distance, least_width) if len(s) > 2 else []
            kept = sorted(sorted(found, key=lambda f: (-s[f[0]], f[0]))[:most])
            rows += [(scan.row, i, float(s[i]), p, w, len(found)) for i, p, w in kept]
        at, i, height, p, w, n = (list(c) for c in zip(*rows, strict=True)) if rows else ([],) * 6
        yield _table(keys, at, idx=pa.array(i, pa.int32()), height=pa.array(height, pa.float64()), prominence=pa.array(p, pa.float64()), width=pa.array(w, pa.float64()), n_found=pa.array(n, pa.int32()))

    return _over_scans(points, f"{M} {_kind(points)}, idx int, height double, prominence double, width double, n_found int", work)


def _prepare(scans: list[Scan], o: dict) -> None:
    """Baseline, noise and peaks of scans, or why they can't be had; what fails together is tried scan by scan."""
    try:
        by_length: dict[int, list[Scan]] = {}
        for s in scans:
            if len(s.x) < SCAN_LEAST:
                s.fault = f"fewer than {SCAN_LEAST} points"
            else:
                by_length.setdefault(len(s.x), []).append(s)
        for own in by_length.values():
            _prepare_even(own, o)
    except Exception as e:
        if len(scans) == 1:
            scans[0].fault = f"{type(e).__name__}: {e}"
        else:
            for s in scans:
                s.fault = None
                _prepare([s], o)


def _prepare_even(scans: list[Scan], o: dict) -> None:
    """The same of scans of one length, as rows of a matrix."""
    for s, step in zip(scans, np.median(np.diff(np.array([s.x for s in scans]), axis=1), axis=1).tolist()):
        s.step = step
        if step <= 0:
            s.fault = "the axis does not rise"
    by_window: dict[int, list[Scan]] = {}
    for s in scans:
        if s.fault is None:
            by_window.setdefault(max(3, round(o["baseline_deg"] / s.step)), []).append(s)
    for half, own in by_window.items():
        y = np.array([s.y for s in own])
        base = snip(y, half)
        c = y - base
        for s, b, row in zip(own, base, c):
            s.baseline, s.corrected = b, row
            if row.max() <= 0:
                s.fault = "nothing above the baseline"
        smooth = _smooth(c, o["window"], o["order"])
        d = np.diff(c, axis=1)
        sigma = MAD_TO_SIGMA * np.median(np.abs(d - np.median(d, axis=1, keepdims=True)), axis=1) / 2**0.5
        for s, v, noise in zip(own, smooth, sigma.tolist()):
            if s.fault is not None:
                continue
            s.smooth, s.sigma = v, noise
            s.threshold = max(NOISE_TIMES * noise, o["share"] * float(s.corrected.max()))
            found = find_peaks(v, s.threshold, max(1, round(o["distance_deg"] / s.step)), o["least_width"])
            s.n_found = len(found)
            found = sorted(sorted(found, key=lambda f: (-v[f[0]], f[0]))[: o["most"]])
            s.at, s.width = np.array([f[0] for f in found], int), np.array([f[2] for f in found], float)


def prepared(points: DataFrame, params: dict | None = None) -> DataFrame:
    """(measurement_id, idx, x, y, baseline, corrected, smooth, sigma, threshold, step, is_peak, width, n_found) of the points of scans.

    Scans that can't be analysed have no points here; ``peak_table`` says why. Of more than ``most`` peaks the highest are marked;
    ``n_found`` counts all (see ``capped``).
    """
    o = DEFAULTS | (params or {})

    def work(keys, scans):
        _prepare(scans, o)
        good = [s for s in scans if s.fault is None]
        if not good:
            return
        n = [len(s.x) for s in good]
        wide = lambda name: np.repeat([getattr(s, name) for s in good], n)
        tall = lambda name: np.concatenate([getattr(s, name) for s in good])
        starts = np.cumsum([0, *n[:-1]])
        at = np.concatenate([s.at + k for s, k in zip(good, starts)])
        is_peak, width = np.zeros(sum(n), bool), np.zeros(sum(n))
        is_peak[at], width[at] = True, tall("width")
        yield _table(
            keys, np.repeat([s.row for s in good], n), idx=np.concatenate([np.arange(k, dtype=np.int32) for k in n]), x=tall("x"), y=tall("y"), baseline=tall("baseline"), corrected=tall("corrected"),
            smooth=tall("smooth"), sigma=wide("sigma"), threshold=wide("threshold"), step=wide("step"), is_peak=is_peak, width=width, n_found=wide("n_found").astype(np.int32),
        )

    kinds = f"{M} {_kind(points)}, idx int, x double, y double, baseline double, corrected double, smooth double, sigma double, threshold double, step double, is_peak boolean, width double, n_found int"
    return _over_scans(points, kinds, work)


def _kind(points: DataFrame) -> str:
    return points.schema[M].dataType.simpleString()


def capped(points: DataFrame, params: dict | None = None) -> DataFrame:
    """(measurement_id, field, severity, message): a warning for every scan of ``prepared`` or ``scan_peaks`` with more peaks than are kept."""
    most = (DEFAULTS | (params or {}))["most"]
    over = points.groupBy(M).agg(F.max("n_found").alias("n")).where(F.col("n") > most)
    return over.select(M, F.lit("peaks").alias("field"), F.lit("warning").alias("severity"), _cap_message(F.col("n").cast("string"), most).alias("message"))


def _cap_message(n: Column, most: int) -> Column:
    return F.concat(n, F.lit(f" peaks, of which the {most} highest are kept"))


def detect_peaks(points: DataFrame, params: dict | None = None) -> DataFrame:
    """(measurement_id, idx, x, height, width, cluster) of scans; only the peaks leave the task that has the scan."""
    o = DEFAULTS | (params or {})

    def work(keys, scans):
        _prepare(scans, o)
        good = [s for s in scans if s.fault is None and len(s.at)]
        if not good:
            return
        cluster = [k for s in good for k, own in enumerate(_groups(s.at.tolist(), s.width.tolist(), o["times"])) for _ in own]
        yield _table(
            keys, np.repeat([s.row for s in good], [len(s.at) for s in good]), idx=np.concatenate([s.at for s in good]).astype(np.int32), x=np.concatenate([s.x[s.at] for s in good]),
            height=np.concatenate([s.smooth[s.at] for s in good]), width=np.concatenate([s.width for s in good]), cluster=np.array(cluster, np.int32),
        )

    return _over_scans(points, f"{M} {_kind(points)}, idx int, x double, height double, width double, cluster int", work)


# ---------------------------------------------------------------- least squares


def profile(x: np.ndarray, area: float, center: float, sigma: float, share: float) -> np.ndarray:
    """Pseudo-Voigt: a Gaussian and a Lorentzian of one sigma."""
    d = x - center
    return area * ((1 - share) / (sigma * np.sqrt(2 * np.pi)) * np.exp(-d * d / (2 * sigma * sigma)) + share / np.pi * sigma / (d * d + sigma * sigma))


def _slopes(x: np.ndarray, area: float, center: float, sigma: float, share: float) -> tuple[np.ndarray, ...]:
    """Derivatives of a profile by its four parameters."""
    d, v = x - center, sigma * sigma
    w = d * d + v
    g, l = np.exp(-d * d / (2 * v)) / (sigma * np.sqrt(2 * np.pi)), sigma / np.pi / w
    return (
        (1 - share) * g + share * l, area * d * ((1 - share) * g / v + 2 * share * l / w),
        area * ((1 - share) * g * (d * d / v - 1) / sigma + share / np.pi * (d * d - v) / (w * w)), area * (l - g),
    )


def true_fwhm(sigma: float, share: float) -> float:
    """Full width at half height, from 5001 points over five sigma on either side."""
    x = np.linspace(-5 * sigma, 5 * sigma, 5001)
    v = profile(x, 1.0, 0.0, sigma, share)
    above = np.flatnonzero(v >= v[2500] / 2)
    return float(x[above[-1]] - x[above[0]]) if len(above) >= 2 else 2 * sigma


def fit_profiles(x: np.ndarray, y: np.ndarray, start: np.ndarray, low: np.ndarray, high: np.ndarray, steps: int = 200) -> np.ndarray | None:
    """Damped least squares kept within bounds; parameters are (area, center, sigma, share) a peak.

    It has converged when a step gains no more than rounding would, or when no step of any damping gains at all. None: it
    has not after so many steps, or the misfit is no number.
    """
    p, damp = np.clip(start, low, high), 1e-3
    total = lambda q: sum(profile(x, *q[k : k + 4]) for k in range(0, len(q), 4))
    r = y - total(p)
    cost = float(r @ r)
    if not np.isfinite(cost):
        return None
    for _ in range(steps):
        j = np.column_stack([c for k in range(0, len(p), 4) for c in _slopes(x, *p[k : k + 4])])
        a, g = j.T @ j, j.T @ r
        while damp < 1e12:
            # parameters at a bound that the step would cross stay there
            free = ~(((p <= low) & (g < 0)) | ((p >= high) & (g > 0)))
            step = np.zeros_like(p)
            try:
                step[free] = np.linalg.solve(a[np.ix_(free, free)] + damp * np.diag(np.diag(a)[free] + 1e-12), g[free])
            except np.linalg.LinAlgError:
                damp *= 10
                continue
            q = np.clip(p + step, low, high)
            rq = y - total(q)
            if float(rq @ rq) < cost:
                break
            damp *= 10
        else:
            return p
        gain = cost - float(rq @ rq)
        p, r, cost, damp = q, rq, float(rq @ rq), max(damp / 10, 1e-9)
        if not np.isfinite(cost):
            return None
        if gain <= 1e-10 * max(cost, 1e-12):
            return p
    return None


def _half_heights(sigma: np.ndarray, share: np.ndarray) -> np.ndarray:
    """``true_fwhm`` of many peaks: a profile falls on both sides, so that the last point above half of it is found by bisection."""
    grid = lambda i: np.where(i == 5000, 5 * sigma, i * (10 * sigma / 5000) - 5 * sigma)  # noqa: E731  as np.linspace has it
    half = profile(grid(np.full(len(sigma), 2500)), 1.0, 0.0, sigma, share) / 2
    ends = []
    for side in (1, -1):
        near, far = np.zeros(len(sigma), int), np.full(len(sigma), 2501)
        while (far - near > 1).any():
            mid = (near + far) // 2
            above = profile(grid(2500 + side * mid), 1.0, 0.0, sigma, share) >= half
            near, far = np.where(above, mid, near), np.where(above, far, mid)
        ends.append(near)
    return np.where(ends[0] + ends[1] > 0, grid(2500 + ends[0]) - grid(2500 - ends[1]), 2 * sigma)


#: Doubles in the largest table of a set of clusters that are fitted together; windows are filled up to a multiple of so many points.
MOST_FITTED, FILLED = 500_000, 32


def fit_many(jobs: list[tuple[np.ndarray, ...]], steps: int = 200) -> list[np.ndarray | None]:
    """``fit_profiles`` of many (x, y, start, low, high): those alike in peaks and points go through the same steps side by side, each with a damping of its own.

    What a fit finds does not depend on those beside it.
    """
    out: list[np.ndarray | None] = [None] * len(jobs)
    alike: dict[tuple[int, int], list[int]] = {}
    for k, (x, _, start, *_) in enumerate(jobs):
        alike.setdefault((len(start), -(-len(x) // FILLED) * FILLED), []).append(k)
    for (size, n), own in alike.items():
        most = max(1, MOST_FITTED // (size * max(size, n)))
        for at in range(0, len(own), most):
            for k, p in zip(own[at : at + most], _fit_even([jobs[k] for k in own[at : at + most]], n, steps), strict=True):
                out[k] = p
    return out


def _fit_even(jobs: list[tuple[np.ndarray, ...]], n: int, steps: int) -> list[np.ndarray | None]:
    """Fits with one number of peaks; windows are filled up to n points by some that weigh nothing."""
    x, y, inside = np.zeros((len(jobs), n)), np.zeros((len(jobs), n)), np.zeros((len(jobs), n))
    for k, (xs, ys, *_) in enumerate(jobs):
        x[k, : len(xs)], x[k, len(xs) :], y[k, : len(xs)], inside[k, : len(xs)] = xs, xs[-1], ys, 1.0
    low, high = np.array([j[3] for j in jobs]), np.array([j[4] for j in jobs])
    p = np.clip(np.array([j[2] for j in jobs]), low, high)
    size = p.shape[1]

    def misfit(rows, q):
        total = sum(profile(x[rows], *(q[:, k + i, None] for i in range(4))) for k in range(0, size, 4))
        r = (y[rows] - total) * inside[rows]
        return r, np.einsum("bn,bn->b", r, r)

    everything = np.arange(len(jobs))
    r, cost = misfit(everything, p)
    a, g = np.zeros((len(jobs), size, size)), np.zeros((len(jobs), size))
    damp, taken, settled = np.full(len(jobs), 1e-3), np.zeros(len(jobs), int), np.zeros(len(jobs), bool)
    active = np.flatnonzero(np.isfinite(cost))
    fresh = active
    while len(active):
        if len(fresh):
            slopes = [c * inside[fresh] for k in range(0, size, 4) for c in _slopes(x[fresh], *(p[fresh, k + i, None] for i in range(4)))]
            j = np.stack(slopes, axis=1)
            a[fresh], g[fresh] = j @ j.transpose(0, 2, 1), np.einsum("bpn,bn->bp", j, r[fresh])
        pa_, ga = p[active], g[active]
        # parameters at a bound that the step would cross stay there
        free = ~(((pa_ <= low[active]) & (ga < 0)) | ((pa_ >= high[active]) & (ga > 0)))
        step, solved = _damped(a[active], ga, free, damp[active])
        q = np.clip(pa_ + step, low[active], high[active])
        rq, cq = misfit(active, q)
        better = solved & (cq < cost[active])
        won, lost = active[better], active[~better]
        gain = cost[won] - cq[better]
        p[won], r[won], cost[won], damp[won] = q[better], rq[better], cq[better], np.maximum(damp[won] / 10, 1e-9)
        taken[won] += 1
        damp[lost] *= 10
        settled[won] = gain <= 1e-10 * np.maximum(cost[won], 1e-12)
        settled[lost] = damp[lost] >= 1e12
        active = active[~settled[active] & (taken[active] < steps)]
        fresh = won[~settled[won] & (taken[won] < steps)]
    return [p[k] if settled[k] else None for k in range(len(jobs))]


def _damped(a: np.ndarray, g: np.ndarray, free: np.ndarray, damp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps of free parameters, others at 0, and which could be had."""
    size = a.shape[1]
    own = np.einsum("bpp->bp", a)
    m = np.where(free[:, :, None] & free[:, None, :], a, 0.0)
    m[:, np.arange(size), np.arange(size)] = np.where(free, own + damp[:, None] * (own + 1e-12), 1.0)
    rhs = np.where(free, g, 0.0)
    try:
        return np.linalg.solve(m, rhs[:, :, None])[:, :, 0], np.ones(len(a), bool)
    except np.linalg.LinAlgError:
        if len(a) == 1:
            return np.zeros_like(g), np.zeros(1, bool)
        half = len(a) // 2
        parts = [_damped(a[s], g[s], free[s], damp[s]) for s in (slice(0, half), slice(half, None))]
        return np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])


def _start(x: np.ndarray, step: float, tops: list[tuple[float, float, float]]) -> tuple[np.ndarray, ...] | str:
    """Where the fit of a cluster with peaks (x, height, width) begins, and its bounds; or why there is none."""
    if len(x) < POINTS_PER_PEAK * len(tops):
        return "window too narrow"
    start, low, high = [], [], []
    for c, h, w in tops:
        sigma = max(step, max(step, w * step) / FWHM_PER_SIGMA)
        start += [max(1e-12, h * sigma * np.sqrt(2 * np.pi)), c, sigma, 0.5]
        low += [0.0, c - 2 * sigma, step, 0.0]
        high += [np.inf, c + 2 * sigma, max(step, 3 * sigma), 1.0]
    return np.array(start), np.array(low), np.array(high)


def _fit_clusters(clusters: list[tuple[np.ndarray, np.ndarray, float, list[tuple[float, float, float]]]]) -> list[np.ndarray | str]:
    """Of each cluster (x, y, step, tops) a row (center, height, fwhm, area, fraction, sigma) a peak, or why there are none."""
    if not clusters:
        return []
    try:
        starts = [_start(x, step, tops) for x, _, step, tops in clusters]
        jobs = [(x, y, *s) for (x, y, *_), s in zip(clusters, starts) if not isinstance(s, str)]
        with np.errstate(all="ignore"):
            fits = iter(fit_many(jobs))
        out = [s if isinstance(s, str) else next(fits) for s in starts]
        fitted = [p.reshape(-1, 4) for p in out if isinstance(p, np.ndarray)]
        if fitted:
            a, c, s, f = np.concatenate(fitted).T
            peaks = np.stack([c, profile(c, a, c, s, f), _half_heights(s, f), a, f, s], axis=1)
            rows = iter(np.split(peaks, np.cumsum([len(p) for p in fitted])[:-1]))
        return ["no convergence" if p is None else p if isinstance(p, str) else next(rows) for p in out]
    except Exception as e:
        if len(clusters) == 1:
            return [f"{type(e).__name__}: {e}"]
        return [_fit_clusters([one])[0] for one in clusters]


FIT = ("center", "height", "fwhm", "area", "fraction", "sigma")


def _fit_rows(keys: pa.Array, at: list[int], cluster: list[int], got: list[np.ndarray | str], **ends) -> pa.RecordBatch:
    """A row a peak, or one with an issue for a cluster that could not be fitted; ``ends``: more columns, a value a cluster."""
    n = [1 if isinstance(g, str) else len(g) for g in got]
    wide = lambda v: np.repeat(np.array(v), n)
    table = np.concatenate([np.full((1, 6), np.nan) if isinstance(g, str) else g for g in got])
    issue = [g if isinstance(g, str) else None for g in got]
    columns = {k: pa.array(v, pa.float64(), from_pandas=True) for k, v in zip(FIT, table.T)}
    return _table(keys, wide(at), cluster=wide(cluster).astype(np.int32), **columns, issue=pa.array([i for i, k in zip(issue, n) for _ in range(k)], pa.string()), **{k: wide(v) for k, v in ends.items()})


_FIT_KINDS = "cluster int, " + ", ".join(f"{k} double" for k in FIT) + ", issue string"


def fit_peak_clusters(points: DataFrame, peaks: DataFrame, params: dict | None = None) -> DataFrame:
    """(measurement_id, cluster, center, height, fwhm, area, fraction, sigma, issue) per peak; a cluster that can't be fitted is one row with an issue.

    ``points`` as of ``prepared``, ``peaks`` (measurement_id, cluster, idx, width). Points and peaks of a scan meet in one row, so that points are
    shuffled once and never multiplied; many clusters are fitted at a time. ``scan_fits`` does all from the points of scans.
    """
    times = (DEFAULTS | (params or {}))["times"]
    number = lambda df, *names: F.collect_list(F.struct(*[F.col(k).cast("double").alias(k) for k in names]))
    packed = points.groupBy(M).agg(number(points, "idx", "x", "corrected", "step", "width").alias("scan"))
    found = peaks.groupBy(M).agg(number(peaks, "cluster", "idx", "width").alias("peaks"))

    def run(batches):
        for batch in batches:
            tops = batch.column("peaks").to_pylist()
            done = 0
            for keys, lists in _slices(batch):
                at, cluster, jobs = [], [], []
                for row, (idx, x, c, step, width) in enumerate(lists):
                    order = np.argsort(idx, kind="stable")
                    idx, x, c, width = idx[order], x[order], c[order], width[order]
                    own: dict[int, list] = {}
                    for p in tops[done + row]:
                        own.setdefault(int(p["cluster"]), []).append(p)
                    for k in sorted(own):
                        w = times * max(p["width"] for p in own[k])
                        lo, hi = max(0, np.floor(min(p["idx"] for p in own[k]) - w)), np.floor(max(p["idx"] for p in own[k]) + w)
                        i, j = np.searchsorted(idx, lo), np.searchsorted(idx, hi, "right")
                        if i == j:
                            continue
                        top = i + np.flatnonzero(np.isin(idx[i:j], [p["idx"] for p in own[k]]))
                        at, cluster = [*at, row], [*cluster, k]
                        jobs.append((x[i:j], c[i:j], float(step[0]), list(zip(x[top], c[top], width[top]))))
                done += len(lists)
                if jobs:
                    yield _fit_rows(keys, at, cluster, _fit_clusters(jobs))

    return packed.join(found, M).mapInArrow(run, f"{M} {_kind(points)}, {_FIT_KINDS}")


def _windows(scans: list[Scan], o: dict) -> list[tuple[Scan, int, tuple]]:
    """(scan, cluster, what ``_fit_clusters`` takes) of all clusters of scans."""
    out = []
    for s in scans:
        for k, own in enumerate(_groups(s.at.tolist(), s.width.tolist(), o["times"])):
            i, w = s.at[own], o["times"] * s.width[own].max()
            lo, hi = max(0, int(np.floor(i[0] - w))), int(np.floor(i[-1] + w))
            out.append((s, k, (s.x[lo : hi + 1], s.corrected[lo : hi + 1], s.step, list(zip(s.x[i], s.corrected[i], s.width[own])))))
    return out


def scan_fits(points: DataFrame, params: dict | None = None) -> DataFrame:
    """``fit_peak_clusters`` from the points (measurement_id, idx, x, y) of scans in one pass, with x0 and x1, the ends of the scan."""
    o = DEFAULTS | (params or {})

    def work(keys, scans):
        _prepare(scans, o)
        clusters = _windows([s for s in scans if s.fault is None], o)
        if clusters:
            ends = {"x0": [float(s.x[0]) for s, *_ in clusters], "x1": [float(s.x[-1]) for s, *_ in clusters]}
            yield _fit_rows(keys, [s.row for s, *_ in clusters], [k for _, k, _ in clusters], _fit_clusters([c for *_, c in clusters]), **ends)

    return _over_scans(points, f"{M} {_kind(points)}, {_FIT_KINDS}, x0 double, x1 double", work)


def physical(fits: DataFrame, points: DataFrame | None = None) -> DataFrame:
    """Fitted peaks inside their scan with positive height and width; the scan's ends are those of ``points``, or x0 and x1 as of ``scan_fits``."""
    if points is not None:
        fits = fits.join(points.groupBy(M).agg(F.min("x").alias("x0"), F.max("x").alias("x1")), M)
    return fits.where("issue is null and center between x0 and x1 and height > 0 and fwhm > 0").drop("x0", "x1", "issue")


def fit_curve(points: DataFrame, fits: DataFrame) -> DataFrame:
    """(measurement_id, idx, x, y, baseline, fit, residual): the peaks' sum over the whole scan plus the baseline."""
    # at most ``most`` peaks of a scan ride along as an array: points are neither multiplied nor regrouped
    peaks = fits.where("issue is null").groupBy(M).agg(F.array_sort(F.collect_list(F.struct("center", "sigma", "area", "fraction"))).alias("_peaks"))
    x = F.col("x")

    def value(p: Column) -> Column:
        d, s = x - p["center"], p["sigma"]
        g = (1 - p["fraction"]) / (s * (2 * np.pi) ** 0.5) * F.exp(-d * d / (2 * s * s))
        return p["area"] * (g + p["fraction"] / np.pi * s / (d * d + s * s))

    model = F.coalesce(F.aggregate("_peaks", F.lit(0.0), lambda a, p: a + value(p)), F.lit(0.0))
    each = points.select(M, "idx", "x", "y", "baseline").join(peaks, M, "left").withColumn("_model", model)
    return each.select(M, "idx", "x", "y", "baseline", (F.col("_model") + F.col("baseline")).alias("fit"), (F.col("y") - F.col("_model") - F.col("baseline")).alias("residual"))


def _groups(at: list[int], width: list[float], times: float) -> list[list[int]]:
    """Positions in ``at`` (rising) of peaks whose windows at -/+ times * width touch."""
    out: list[list[int]] = []
    reach = -np.inf
    for k, (i, w) in enumerate(zip(at, width)):
        if i - times * w > reach:
            out.append([])
        out[-1].append(k)
        reach = max(reach, i + times * w)
    return out


CURVE = ("x", "observed", "baseline", "fit", "residual")


def _analysed(scans: list[Scan], o: dict) -> Iterator[tuple[Scan, dict, np.ndarray | None]]:
    """All of the analysis of scans in one pass: peaks, statistics and issues of each, and the sum of its fitted peaks."""
    _prepare(scans, o)
    clusters = _windows([s for s in scans if s.fault is None], o)
    by_scan: dict[int, list] = {}
    for (s, *_), got in zip(clusters, _fit_clusters([c for *_, c in clusters])):
        by_scan.setdefault(s.row, []).append(got)
    for s in scans:
        try:
            row, model = _judged(s, by_scan.get(s.row, []), o)
        except Exception as e:
            row, model = {"state": "error", "issues": [f"{type(e).__name__}: {e}"]}, None
        yield s, {"n_peaks": 0, "peaks": [], "r2": None, "reduced_chi2": None, "sigma": None} | row, model


def _judged(s: Scan, clusters: list[np.ndarray | str], o: dict) -> tuple[dict, np.ndarray | None]:
    """Statistics and issues of a scan from the fits of its clusters, and their sum."""
    if s.fault is not None:
        return {"state": "error", "issues": [s.fault]}, None
    x, c = s.x, s.corrected
    fits, issues, model = [], [], np.zeros(len(x))
    if s.n_found > len(s.at):
        issues.append(f"{s.n_found} peaks, of which the {o['most']} highest are kept")
    for got in clusters:
        if isinstance(got, str):
            issues.append(got)
            continue
        for center, height, fwhm, area, fraction, sigma in got.tolist():
            model += profile(x, area, center, sigma, fraction)
            fits.append((center, height, fwhm, area, fraction))
    good = sorted(f for f in fits if x[0] <= f[0] <= x[-1] and f[1] > 0 and f[2] > 0)
    if len(good) < len(fits):
        issues.append("unphysical peaks left out")
    rss, tss = float(((c - model) ** 2).sum()), float(((c - c.mean()) ** 2).sum())
    r2 = 1 - rss / tss if tss > 0 else 0.0
    if not good:
        issues.append("no peaks")
    elif r2 < R2_WARN:
        issues.append("poor fit")
    return {
        "state": "warning" if issues else "ok", "n_peaks": len(good), "peaks": [dict(zip(FIT, f)) for f in good], "r2": r2,
        "reduced_chi2": rss / max(1, len(x) - 4 * len(good)) / max(s.sigma * s.sigma, 1e-30), "sigma": s.sigma, "issues": list(dict.fromkeys(issues)),
    }, model


TABLE = ("n_peaks", "peaks", "r2", "reduced_chi2", "sigma", "state", "issues")


_PEAK = "struct<center:double,height:double,fwhm:double,area:double,fraction:double>"
_TABLE_KINDS = f"n_peaks int, peaks array<{_PEAK}>, r2 double, reduced_chi2 double, sigma double, state string, issues array<string>"


_TABLE_TYPES = {
    "n_peaks": pa.int32(), "peaks": pa.list_(pa.struct([(k, pa.float64()) for k in FIT[:5]])), "r2": pa.float64(), "reduced_chi2": pa.float64(), "sigma": pa.float64(), "state": pa.string(), "issues": pa.list_(pa.string()),
}


def _result_columns(rows: list[dict]) -> dict[str, pa.Array]:
    return {k: pa.array([r[k] for r in rows], t) for k, t in _TABLE_TYPES.items()}


def analyse(points: DataFrame, params: dict | None = None) -> DataFrame:
    """Table rows and curves of one pass, by ``tag``: one ``result`` a scan as of ``peak_table``, and its points (idx, x, observed, baseline, fit, residual) under ``curve``.

    One group a scan is fitted once and leaves its task as one row; write the result and take either part of it. The fit is that of all fitted peaks.
    """
    o = DEFAULTS | (params or {})

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        (s,) = _read_scans([tuple(pdf[k].to_numpy(float) for k in ("idx", "x", "y"))])
        ((_, row, model),) = _analysed([s], o)
        curve = [[]] * len(CURVE) if model is None else [s.x, s.y, s.baseline, model + s.baseline, s.y - model - s.baseline]
        return pd.DataFrame([{M: pdf[M].iloc[0], **row, **dict(zip(CURVE, curve, strict=True))}])[[M, *TABLE, *CURVE]].astype({k: float for k in ("r2", "reduced_chi2", "sigma")})

    one = points.select(M, "idx", "x", "y").groupBy(M).applyInPandas(run, f"{M} {_kind(points)}, {_TABLE_KINDS}, " + ", ".join(f"{k} array<double>" for k in CURVE))
    # the result first, then its points: an element each, which takes no copy of the scan's arrays along
    void = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in one.schema}
    head = F.struct(F.lit("result").alias("tag"), *TABLE, F.lit(None).cast("int").alias("idx"), *[F.lit(None).cast("double").alias(k) for k in CURVE])
    tail = F.transform(F.arrays_zip(*CURVE), lambda p, i: F.struct(F.lit("curve").alias("tag"), *[void[k] for k in TABLE], i.alias("idx"), *[p[k].alias(k) for k in CURVE]))
    return one.select(M, F.inline(F.concat(F.array(head), tail)))


def fit_curves(points: DataFrame, params: dict | None = None) -> DataFrame:
    """``fit_curve`` from the points of scans, which are shuffled once: (measurement_id, idx, x, y, baseline, fit, residual)."""
    o = DEFAULTS | (params or {})

    def work(keys, scans):
        own = [(s, model) for s, _, model in _analysed(scans, o) if model is not None]
        if own:
            sizes = [len(s.x) for s, _ in own]
            x, y, base, model = (np.concatenate(v) for v in ([s.x for s, _ in own], [s.y for s, _ in own], [s.baseline for s, _ in own], [m for _, m in own]))
            yield _table(keys, np.repeat([s.row for s, _ in own], sizes), idx=np.concatenate([np.arange(k, dtype=np.int32) for k in sizes]), x=x, y=y, baseline=base, fit=model + base, residual=y - model - base)

    return _over_scans(points, f"{M} {_kind(points)}, idx int, x double, y double, baseline double, fit double, residual double", work)


def peak_table(points: DataFrame, params: dict | None = None) -> DataFrame:
    """(measurement_id, n_peaks, peaks, r2, reduced_chi2, sigma, state, issues), one row for every scan; peaks by center.

    state: ok, warning (no peaks, a poor fit, clusters or peaks left out) or error (too few points, no rising axis, nothing
    above the baseline, or any failure inside), in which case there are no numbers.
    """
    o = DEFAULTS | (params or {})

    def work(keys, scans):
        done = list(_analysed(scans, o))
        yield _table(keys, [s.row for s, *_ in done], **_result_columns([row for _, row, _ in done]))

    return _over_scans(points, f"{M} {_kind(points)}, {_TABLE_KINDS}", work)
