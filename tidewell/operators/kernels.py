"""Numeric kernels over one series: peaks, extreme value fits, spectra."""

from __future__ import annotations

import math

import numpy as np


def local_peaks(x: np.ndarray, height: float, distance: int) -> np.ndarray:
    """Positions of strict local maxima (middle of a flat top) of at least ``height``, ``distance`` apart.

    Ends are no peaks.  Higher peaks are kept first, of equal ones the later.
    """
    n = len(x)
    if n < 3:
        return np.zeros(0, dtype=int)
    starts = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    ends = np.append(starts[1:], n) - 1
    level = x[starts]
    top = np.flatnonzero((level[1:-1] > level[:-2]) & (level[1:-1] > level[2:])) + 1
    peaks = (starts[top] + ends[top]) // 2
    peaks = peaks[x[peaks] >= height]
    keep = np.ones(len(peaks), dtype=bool)
    for i in np.argsort(x[peaks], kind="stable")[::-1]:
        if keep[i]:
            close = np.abs(peaks - peaks[i]) < distance
            close[i] = False
            keep[close] = False
    return peaks[keep]


def _bisect(f, lo: float, hi: float) -> float:
    for _ in range(200):
        mid = (lo + hi) / 2
        if f(mid) > 0:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


def fit_gumbel(x: np.ndarray, sign: int = 1) -> tuple[float, float]:
    """Maximum likelihood location and scale; ``sign`` -1 for the left-skewed form."""
    y = sign * x
    mean, low = y.mean(), y.min()

    def gap(s: float) -> float:
        w = np.exp(-(y - low) / s)
        return mean - (y * w).sum() / w.sum() - s

    spread = max(y.std(), 1e-12)
    lo, hi = spread * 1e-3, spread * 10
    while gap(hi) > 0:
        hi *= 2
    while gap(lo) < 0 and lo > 1e-300:
        lo /= 2
    s = _bisect(gap, lo, hi)
    loc = low - s * math.log(np.exp(-(y - low) / s).mean())
    return sign * loc, s


def _simplex(f, start: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """Downhill simplex."""
    points = [start] + [start + d for d in np.diag(np.where(start != 0, 0.05 * start, 0.00025))]
    values = [f(p) for p in points]
    for _ in range(rounds):
        order = np.argsort(values)
        points, values = [points[i] for i in order], [values[i] for i in order]
        if np.abs(np.array(points[1:]) - points[0]).max() < 1e-8 and values[-1] - values[0] < 1e-8:
            break
        centre = np.mean(points[:-1], axis=0)
        tried = centre + (centre - points[-1])
        v = f(tried)
        if v < values[0]:
            far = centre + 2 * (centre - points[-1])
            w = f(far)
            tried, v = (far, w) if w < v else (tried, v)
        elif v >= values[-2]:
            inner = centre + 0.5 * ((tried if v < values[-1] else points[-1]) - centre)
            w = f(inner)
            if w < min(v, values[-1]):
                tried, v = inner, w
            else:
                points = [points[0]] + [points[0] + 0.5 * (p - points[0]) for p in points[1:]]
                values = [values[0]] + [f(p) for p in points[1:]]
                continue
        points[-1], values[-1] = tried, v
    return points[int(np.argmin(values))]


def _nll(logpdf):
    def f(p: np.ndarray, x: np.ndarray) -> float:
        loc, scale = p[-2], p[-1]
        if scale <= 0:
            return math.inf
        with np.errstate(all="ignore"):
            v = logpdf((x - loc) / scale, *p[:-2]) - math.log(scale)
        return -v.sum() if np.isfinite(v).all() else math.inf

    return f


def _gev(z: np.ndarray, c: float) -> np.ndarray:
    if abs(c) < 1e-9:
        return -z - np.exp(-z)
    t = 1 - c * z
    return np.where(t > 0, (1 / c - 1) * np.log(t) - np.maximum(t, 1e-300) ** (1 / c), -np.inf)


def _pareto(z: np.ndarray, c: float) -> np.ndarray:
    if abs(c) < 1e-9:
        return np.where(z >= 0, -z, -np.inf)
    t = 1 + c * z
    return np.where((z >= 0) & (t > 0), -(1 + 1 / c) * np.log(t), -np.inf)


def _weibull(z: np.ndarray, c: float) -> np.ndarray:
    return np.where((z > 0) & (c > 0), math.log(max(c, 1e-300)) + (c - 1) * np.log(z) - z**c, -np.inf)


def _lognormal(z: np.ndarray, s: float) -> np.ndarray:
    return np.where((z > 0) & (s > 0), -np.log(z) - math.log(max(s, 1e-300) * math.sqrt(2 * math.pi)) - np.log(z) ** 2 / (2 * s * s), -np.inf)


def _normal_isf(p: np.ndarray) -> np.ndarray:
    from statistics import NormalDist

    return np.array([math.inf if q <= 0 else -math.inf if q >= 1 else NormalDist().inv_cdf(1 - q) for q in p])


#: Inverse survival functions of the standard forms.
ISF = {
    "gumbel_r": lambda p: -np.log(-np.log1p(-p)),
    "gumbel_l": lambda p: np.log(-np.log(p)),
    "norm": _normal_isf,
    "expon": lambda p: -np.log(p),
    "logistic": lambda p: np.log1p(-p) - np.log(p),
    "genextreme": lambda p, c: ISF["gumbel_r"](p) if abs(c) < 1e-9 else (1 - (-np.log1p(-p)) ** c) / c,
    "genpareto": lambda p, c: -np.log(p) if abs(c) < 1e-9 else (p ** (-c) - 1) / c,
    "weibull_min": lambda p, c: (-np.log(p)) ** (1 / c),
    "lognorm": lambda p, s: np.exp(s * _normal_isf(p)),
}
_SHAPED = {"genextreme": (_gev, 0.1), "genpareto": (_pareto, 0.1), "weibull_min": (_weibull, 1.5), "lognorm": (_lognormal, 0.5)}
DISTRIBUTIONS = tuple(ISF)


def fit(name: str, x: np.ndarray) -> tuple[float, ...]:
    """Shape (if any), location and scale: closed forms or a root where there is one, else a simplex search."""
    if name == "gumbel_r":
        return fit_gumbel(x)
    if name == "gumbel_l":
        return fit_gumbel(x, -1)
    if name == "norm":
        return x.mean(), x.std()
    if name == "expon":
        return x.min(), x.mean() - x.min()
    spread = max(x.std(), 1e-9)
    if name == "logistic":
        f = _nll(lambda z: -z - 2 * np.log1p(np.exp(-z)))
        return tuple(_simplex(lambda p: f(p, x), np.array([x.mean(), spread * 0.55])))
    logpdf, shape = _SHAPED[name]
    f = _nll(logpdf)
    loc = x.mean() - 0.45 * spread if name == "genextreme" else x.min() - 0.01 * spread
    return tuple(_simplex(lambda p: f(p, x), np.array([shape, loc, spread])))


def return_values(x: np.ndarray, dt_hours: float, periods: list[float], percentile: float, distribution: str, duration: float) -> np.ndarray:
    """Values at the return periods (years) from a fit to peaks over a percentile; NaN if there are too few."""
    none = np.full(len(periods), np.nan)
    x = x[~np.isnan(x)]
    if len(x) < 2:
        return none
    peaks = x[local_peaks(x, np.percentile(x, percentile), max(1, int(duration / dt_hours)))]
    if len(peaks) < 2:
        return none
    try:
        *shape, loc, scale = fit(distribution, peaks)
    except (ArithmeticError, ValueError, np.linalg.LinAlgError):
        return none
    years = len(x) * dt_hours / 8760
    p = np.clip(1 / (np.array(periods, float) * len(peaks) / max(years, 1e-9)), 1e-9, 1.0)
    with np.errstate(all="ignore"):
        return loc + scale * ISF[distribution](p, *shape)


def welch(x: np.ndarray, fs: float, nperseg: int) -> tuple[np.ndarray, np.ndarray]:
    """One-sided power spectral density: Hann segments with half overlap, means removed."""
    n = max(1, min(nperseg, len(x)))
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    step = n - n // 2
    parts = np.lib.stride_tricks.sliding_window_view(x, n)[::step]
    parts = parts - parts.mean(axis=1, keepdims=True)
    density = np.abs(np.fft.rfft(parts * window, axis=1)) ** 2 / (fs * max((window**2).sum(), 1e-300))
    density[:, 1 : (None if n % 2 else -1)] *= 2
    return np.fft.rfftfreq(n, 1 / fs), density.mean(axis=0)


def simpson(y: np.ndarray, x: np.ndarray) -> float:
    """Simpson's rule on uneven points; an even number of points ends with a corrected last interval."""
    n = len(x)
    if n < 2:
        return 0.0
    if n == 2:
        return float((x[1] - x[0]) * (y[0] + y[1]) / 2)
    h = np.diff(x)
    m = n if n % 2 else n - 1
    h0, h1 = h[0 : m - 2 : 2], h[1 : m - 1 : 2]
    y0, y1, y2 = y[0 : m - 2 : 2], y[1 : m - 1 : 2], y[2:m:2]
    with np.errstate(all="ignore"):
        total = np.nansum((h0 + h1) / 6 * (y0 * (2 - h1 / h0) + y1 * (h0 + h1) ** 2 / (h0 * h1) + y2 * (2 - h0 / h1)))
    if n % 2 == 0:
        a, b = h[-1], h[-2]
        total += y[-1] * (2 * a * a + 3 * a * b) / (6 * (a + b)) + y[-2] * (a * a + 3 * a * b) / (6 * b) - y[-3] * a**3 / (6 * b * (a + b))
    return float(total)


def band_heights(x: np.ndarray, fs: float, segment_seconds: float, bands: list[tuple[float | None, float | None]]) -> np.ndarray:
    """4 sqrt of the spectral density integrated over each band; NaN if a sample is missing."""
    if np.isnan(x).any() or not len(x):
        return np.full(len(bands), np.nan)
    freq, density = welch(x, fs, int(segment_seconds * fs))
    out = []
    for low, high in bands:
        low = freq[0] if low is None or low != low else low
        high = freq[-1] if high is None or high != high else high
        points = np.concatenate([[low], freq[(freq > low) & (freq < high)], [high]])
        values = np.interp(points, freq, density, left=0.0, right=0.0)
        out.append(4 * math.sqrt(max(simpson(values, points), 0.0)))
    return np.array(out)
