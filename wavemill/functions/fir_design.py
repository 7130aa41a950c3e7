"""FIR design in NumPy: windowed ideal filters, equiripple filters and a Hilbert transformer."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np

from .windows import window


def band_type(fpass, fstop) -> str:
    fpass, fstop = np.atleast_1d(fpass), np.atleast_1d(fstop)
    if len(fpass) != len(fstop):
        raise ValueError("fpass and fstop need the same number of edges")
    if len(fpass) == 1:
        return "lowpass" if fpass[0] < fstop[0] else "highpass"
    if len(fpass) == 2:
        return "bandstop" if fpass[0] < fstop[0] else "bandpass"
    raise ValueError("fpass and fstop have one or two edges")


def pass_attenuation(gpass: float) -> float:
    """Attenuation in dB of the ripple that a loss of gpass dB in the pass band allows."""
    return -20 * math.log10(1 - 10 ** (-gpass / 20))


def kaiser_beta(att: float) -> float:
    if att > 50:
        return 0.1102 * (att - 8.7)
    return 0.5842 * (att - 21) ** 0.4 + 0.07886 * (att - 21) if att > 21 else 0.0


def kaiser_taps(att: float, width: float) -> int:
    """Taps for a transition of `width` (in units of the Nyquist frequency)."""
    return math.ceil((att - 7.95) / (2.285 * math.pi * width) + 1)


def windowed_sinc(taps: int, cutoff, kind: str, win: np.ndarray) -> np.ndarray:
    """Ideal filter (edges in units of Nyquist) times a window, scaled to unit gain in the middle of its first pass band."""
    edges = np.atleast_1d(cutoff).astype(float)
    if kind in ("lowpass", "bandstop"):
        edges = np.concatenate(([0.0], edges))
    if len(edges) % 2:
        edges = np.concatenate((edges, [1.0]))
    m = np.arange(taps) - (taps - 1) / 2
    h = sum(hi * np.sinc(hi * m) - lo * np.sinc(lo * m) for lo, hi in edges.reshape(-1, 2)) * win
    lo, hi = edges[:2]
    at = 0.0 if lo == 0 else 1.0 if hi == 1 else (lo + hi) / 2
    return h / np.sum(h * np.cos(np.pi * m * at))


@dataclass
class Fir:
    """A designed filter. `coeffs` are its taps; `delay` is the group delay in samples."""

    coeffs: np.ndarray
    fs: float
    btype: str = ""
    ftype: str = ""
    fpass: tuple = ()
    fstop: tuple = ()
    gpass: float = 0.0
    gstop: float = 0.0
    params: tuple = field(default_factory=tuple)

    @property
    def numtaps(self) -> int:
        return len(self.coeffs)

    @property
    def delay(self) -> int:
        return (len(self.coeffs) - 1) // 2

    @property
    def nyq(self) -> float:
        return self.fs / 2

    def response(self, n: int = 2000, scale: str = "complex", rope: float = -100.0):
        """(frequencies, response) at n points below Nyquist; scale `complex`, `abs` or `dB` (not below rope)."""
        f = np.arange(n) * self.nyq / n
        return f, scaled(np.exp(-2j * np.pi * np.outer(f / self.fs, np.arange(self.numtaps))) @ self.coeffs, scale, rope)

    def impulse(self) -> np.ndarray:
        """The response to a unit impulse of one second."""
        x = np.zeros(int(self.fs))
        x[0] = 1
        return np.convolve(x, self.coeffs)


def scaled(h: np.ndarray, scale: str, rope: float) -> np.ndarray:
    if scale == "complex":
        return h
    if scale == "abs":
        return np.abs(h)
    if scale != "dB":
        raise ValueError(f"unknown scale {scale!r}")
    return 20 * np.log10(np.maximum(np.abs(h), 10 ** (rope / 20)))


def _windowed(fpass, fstop, fs, name, per_width, gpass, gstop) -> Fir:
    kind = band_type(fpass, fstop)
    p, s = np.atleast_1d(fpass).astype(float), np.atleast_1d(fstop).astype(float)
    width = np.abs(s - p).min() / (fs / 2)
    if name == "kaiser":
        att = max(pass_attenuation(gpass), gstop)
        taps, spec = kaiser_taps(att, width), ("kaiser", kaiser_beta(att))
    else:
        taps, spec = int(per_width / width), (name,)
    taps += 1 - taps % 2
    h = windowed_sinc(taps, (p + s) / fs, kind, window(spec, taps, periodic=False))
    return Fir(h, fs, kind, name, tuple(p), tuple(s), gpass, gstop, spec[1:])


def kaiser(fpass, fstop, fs, gpass=1.0, gstop=40.0) -> Fir:
    return _windowed(fpass, fstop, fs, "kaiser", None, gpass, gstop)


# Main-lobe widths (times the reciprocal of the transition in units of Nyquist) and peak errors in dB.
#   rectangular 4 21, bartlett 8 25, hann 8 44, hamming 8 53, blackman 12 74


def _loss(gstop):
    return -20 * math.log10(1 - 10 ** (-gstop / 20))


def rectangular(fpass, fstop, fs) -> Fir:
    return _windowed(fpass, fstop, fs, "boxcar", 4, _loss(21), 21)


def bartlett(fpass, fstop, fs) -> Fir:
    return _windowed(fpass, fstop, fs, "bartlett", 8, _loss(25), 25)


def hann(fpass, fstop, fs) -> Fir:
    return _windowed(fpass, fstop, fs, "hann", 8, _loss(44), 44)


def hamming(fpass, fstop, fs) -> Fir:
    return _windowed(fpass, fstop, fs, "hamming", 8, _loss(53), 53)


def blackman(fpass, fstop, fs) -> Fir:
    return _windowed(fpass, fstop, fs, "blackman", 12, _loss(74), 74)


def hilbert(width, fs, gpass=0.01, gstop=60.0) -> Fir:
    """Type III Hilbert transformer with transitions of `width` Hz at 0 and Nyquist, under a periodic Kaiser window."""
    att = max(pass_attenuation(gpass), gstop)
    taps = kaiser_taps(att, width / (fs / 2))
    taps += 1 - taps % 2
    n = np.arange(taps) - (taps - 1) // 2
    h = np.zeros(taps)
    odd = n % 2 != 0
    h[odd] = 2 / (np.pi * n[odd])
    return Fir(h * window(("kaiser", kaiser_beta(att)), taps), fs, "bandpass", "hilbert", (width, fs / 2 - width), (0, fs / 2), gpass, gstop)


def remez(bands, desired, fs, gpass=1.0, gstop=40.0, numtaps=None, weight=None, maxiter=50, density=16) -> Fir:
    """Equiripple (Parks-McClellan) filter: bands as edges, desired gain of each, odd taps (type I)."""
    bands = np.asarray(bands, float).reshape(-1, 2)
    desired = np.asarray(desired, float)
    if len(bands) != len(desired) or (np.diff(bands.ravel()) < 0).any():
        raise ValueError("bands must rise, with one desired gain each")
    dp, ds = 1 - 10 ** (-gpass / 20), 10 ** (-gstop / 20)
    if numtaps is None:
        width = (bands[1:, 0] - bands[:-1, 1]).min()
        numtaps = math.ceil(-2 / 3 * math.log10(10 * dp * ds) * fs / width)
    numtaps += 1 - numtaps % 2
    weight = np.where(desired > 0, 1 / dp, 1 / ds) if weight is None else np.asarray(weight, float)
    r = (numtaps + 1) // 2 + 1  # extremal frequencies
    step = (fs / 2) / (density * (r - 1))
    grid, want, w = [], [], []
    for (lo, hi), d, q in zip(bands, desired, weight, strict=True):
        f = np.linspace(lo, hi, max(2, int((hi - lo) / step) + 1))
        grid.append(f), want.append(np.full(len(f), d)), w.append(np.full(len(f), q))
    grid, want, w = np.concatenate(grid), np.concatenate(want), np.concatenate(w)
    x = np.cos(2 * np.pi * grid / fs)
    at = np.round(np.linspace(0, len(grid) - 1, r)).astype(int)
    ends = np.cumsum([0, *[max(2, int((hi - lo) / step) + 1) for lo, hi in bands]])
    for _ in range(maxiter):
        d = x[at][:, None] - x[at][None]
        np.fill_diagonal(d, 1)
        scale = np.exp(-np.log(np.abs(d)).sum(1) + np.log(np.abs(d)).sum(1).mean())
        b = np.sign(np.prod(np.sign(d), 1)) * scale
        sign = (-1.0) ** np.arange(r)
        delta = (b @ want[at]) / (b @ (sign / w[at]))
        y = want[at] - sign * delta / w[at]
        gap = x[:, None] - x[at[:-1]][None]
        hit = np.isclose(gap, 0, atol=1e-14)
        c = b[:-1] * (x[at[:-1]] - x[at[-1]])
        q = c / np.where(hit, 1, gap)
        a = (q @ y[:-1]) / q.sum(1)
        a[hit.any(1)] = y[:-1][hit.argmax(1)[hit.any(1)]]
        e = w * (want - a)
        peak = np.zeros(len(e), bool)
        for i, j in zip(ends, ends[1:], strict=False):
            p = e[i:j]
            up = np.concatenate(([True], np.abs(p[1:]) >= np.abs(p[:-1]))) & np.concatenate((np.abs(p[:-1]) >= np.abs(p[1:]), [True]))
            peak[i:j] = up
        peak[at] = True  # the old points alternate, so enough remain
        cand = np.flatnonzero(peak)
        keep: list[int] = []
        for k in cand:  # one of each run of equal signs
            if keep and np.sign(e[k]) == np.sign(e[keep[-1]]):
                if abs(e[k]) > abs(e[keep[-1]]):
                    keep[-1] = k
            else:
                keep.append(k)
        while len(keep) > r:
            if len(keep) == r + 1:
                keep.pop(0 if abs(e[keep[0]]) < abs(e[keep[-1]]) else -1)
            else:
                k = min(range(len(keep) - 1), key=lambda i: max(abs(e[keep[i]]), abs(e[keep[i + 1]])))
                del keep[k : k + 2]
        if len(keep) < r:
            raise ValueError("the exchange did not find enough extremal frequencies")
        new = np.array(keep)
        if (new == at).all() or np.abs(e).max() <= abs(delta) * (1 + 1e-7):
            break
        at = new
    # cosine polynomial through the extremal points
    m = np.arange(r - 1)
    gains = np.linalg.lstsq(np.cos(np.outer(2 * np.pi * grid[at] / fs, m)), y, rcond=None)[0]
    h = np.concatenate((gains[:0:-1] / 2, gains[:1], gains[1:] / 2))
    return Fir(h, fs, "multiband", "remez", tuple(bands.ravel()), (), gpass, gstop)
