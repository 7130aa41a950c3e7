"""IIR design in NumPy: analog prototypes, band transforms and the bilinear map, as second-order sections."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from .fir_design import band_type, scaled


@dataclass
class Iir:
    """A designed filter: second-order sections (b0 b1 b2 1 a1 a2), its order and critical frequencies."""

    sos: np.ndarray
    fs: float
    order: int
    wn: np.ndarray
    btype: str
    ftype: str
    fpass: tuple = ()
    fstop: tuple = ()
    gpass: float = 0.0
    gstop: float = 0.0

    @property
    def ba(self) -> tuple[np.ndarray, np.ndarray]:
        b, a = np.ones(1), np.ones(1)
        for s in self.sos:
            b, a = np.convolve(b, s[:3]), np.convolve(a, s[3:])
        return b, a

    @property
    def zpk(self) -> tuple[np.ndarray, np.ndarray, float]:
        """Zeros, poles and gain."""
        gain = float(np.prod([s[0] if s[0] else 1.0 for s in self.sos]))
        return np.concatenate([np.roots(np.trim_zeros(s[:3], "f")) for s in self.sos]), np.concatenate([np.roots(s[3:]) for s in self.sos]), gain

    def response(self, n: int = 2000, scale: str = "complex", rope: float = -100.0):
        f = np.arange(n) * self.fs / 2 / n
        z = np.exp(-2j * np.pi * f / self.fs)
        h = np.ones(n, complex)
        for s in self.sos:
            h *= (s[0] + s[1] * z + s[2] * z * z) / (s[3] + s[4] * z + s[5] * z * z)
        return f, scaled(h, scale, rope)

    def impulse(self) -> np.ndarray:
        x = np.zeros(int(self.fs))
        x[0] = 1
        return run_sos(self.sos, x, np.zeros((len(self.sos), 2)))[0]


@lru_cache(maxsize=256)
def _blocks_of(b: tuple, a: tuple, block: int) -> tuple[np.ndarray, ...]:
    """What run_ba multiplies blocks with: outputs of inputs and of states, states of inputs and of states."""
    m = len(b) - 1
    step = np.zeros((m, m))
    step[:, 0] = -np.array(a[1:])
    step[: m - 1, 1:] += np.eye(m - 1)
    c = np.array(b[1:]) - np.array(a[1:]) * b[0]
    powers = [np.eye(m)]
    for _ in range(block):
        powers.append(step @ powers[-1])
    see = np.array([p[0] for p in powers[:block]])
    h = np.concatenate(([b[0]], [powers[k][0] @ c for k in range(block - 1)]))
    lag = np.arange(block)[:, None] - np.arange(block)[None]
    return np.where(lag >= 0, h[np.maximum(lag, 0)], 0), see, np.array([powers[block - 1 - k] @ c for k in range(block)]).T, powers[block]


def run_ba(b: np.ndarray, a: np.ndarray, x: np.ndarray, z: np.ndarray, block: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """The filter b/a (any order m) over x from state z (m numbers, transposed direct form II), by blocks of matrix products:
    (y, last state)."""
    b, a = np.atleast_1d(np.asarray(b, float)), np.atleast_1d(np.asarray(a, float))
    m = max(len(a), len(b)) - 1
    b, a = np.pad(b, (0, m + 1 - len(b))) / a[0], np.pad(a, (0, m + 1 - len(a))) / a[0]
    x = np.asarray(x, float)
    if m == 0 or not len(x):
        return b[0] * x, np.asarray(z, float)
    n, block = len(x), min(block, len(x))
    toeplitz, see, feed, step = _blocks_of(tuple(b.tolist()), tuple(a.tolist()), block)
    full = n // block * block
    xb = x[:full].reshape(-1, block)
    states, add = np.empty((len(xb), m)), xb @ feed.T
    z = np.asarray(z, float)
    for k in range(len(xb)):
        states[k] = z
        z = step @ z + add[k]
    y = (xb @ toeplitz.T + states @ see.T).ravel()
    if full < n:
        tail, z = run_ba(b, a, x[full:], z, n - full)
        y = np.concatenate((y, tail))
    return y, z


def steady_ba(b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """The state in which a constant input of 1 leaves the filter b/a as it is."""
    b, a = np.atleast_1d(np.asarray(b, float)), np.atleast_1d(np.asarray(a, float))
    m = max(len(a), len(b)) - 1
    b, a = np.pad(b, (0, m + 1 - len(b))) / a[0], np.pad(a, (0, m + 1 - len(a))) / a[0]
    step = np.zeros((m, m))
    if m:
        step[:, 0] = -a[1:]
        step[: m - 1, 1:] += np.eye(m - 1)
    return np.linalg.solve(np.eye(m) - step, b[1:] - a[1:] * b[0]) if m else np.zeros(0)


def run_section(s: np.ndarray, x: np.ndarray, z: np.ndarray, block: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """One section over x from state z: (y, last state)."""
    return run_ba(s[:3], s[3:], x, z, block)


def run_sos(sos: np.ndarray, x: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cascade over x from states z (sections x 2): (y, last states)."""
    out = np.empty_like(np.asarray(z, float))
    y = np.asarray(x, float)
    for k, s in enumerate(sos):
        y, out[k] = run_section(s, y, z[k])
    return y, out


def steady_state(sos: np.ndarray) -> np.ndarray:
    """States (sections x 2) in which a constant input of 1 gives a constant output."""
    z, gain = [], 1.0
    for b0, b1, b2, _, a1, a2 in sos:
        m = np.eye(2) - np.array([[-a1, 1.0], [-a2, 0.0]])
        z.append(gain * np.linalg.solve(m, [b1 - a1 * b0, b2 - a2 * b0]))
        gain *= (b0 + b1 + b2) / (1 + a1 + a2)
    return np.array(z)


# prototypes: zeros, poles, gain of analog low-pass filters with edge 1


def _butter(n):
    p = -np.exp(1j * np.pi * np.arange(-n + 1, n, 2) / (2 * n))
    return np.zeros(0, complex), p, 1.0


def _cheby1(n, rp):
    eps = math.sqrt(10 ** (0.1 * rp) - 1)
    mu = math.asinh(1 / eps) / n
    p = -np.sinh(mu + 1j * np.pi * np.arange(-n + 1, n, 2) / (2 * n))
    k = np.prod(-p).real
    return np.zeros(0, complex), p, k / math.sqrt(1 + eps * eps) if n % 2 == 0 else k


def _cheby2(n, rs):
    mu = math.asinh(math.sqrt(10 ** (0.1 * rs) - 1)) / n
    m = np.arange(-n + 1, n, 2)
    z = 1j / np.sin(m[m != 0] * np.pi / (2 * n))
    p = -np.exp(1j * np.pi * m / (2 * n))
    p = 1 / (math.sinh(mu) * p.real + 1j * math.cosh(mu) * p.imag)
    return z, p, (np.prod(-p) / np.prod(-z)).real


def _landen(k: float) -> list[float]:
    """Descending moduli."""
    out = []
    while k > 1e-16 and len(out) < 12:
        k = (k / (1 + math.sqrt(1 - k * k))) ** 2
        out.append(k)
    return out


def _cd(u, moduli):
    """Jacobi cd(u K, k), by ascending Landen transformations."""
    w = np.cos(u * np.pi / 2)
    for v in reversed(moduli):
        w = (1 + v) * w / (1 + v * w**2)
    return w


def _sn(u, moduli):
    w = np.sin(u * np.pi / 2)
    for v in reversed(moduli):
        w = (1 + v) * w / (1 + v * w**2)
    return w


def _asn(w: complex, k: float, moduli) -> complex:
    """u with sn(u K, k) = w."""
    for prev, v in zip([k, *moduli], moduli, strict=False):
        w = 2 * w / ((1 + v) * (1 + np.sqrt(1 - (prev * w) ** 2 + 0j)))
    return 2 / np.pi * np.arcsin(w + 0j)


def ellip_k(k: float) -> float:
    """Complete elliptic integral of modulus k."""
    a, b = 1.0, math.sqrt(1 - k * k)
    for _ in range(60):
        if abs(a - b) < 1e-16:
            break
        a, b = (a + b) / 2, math.sqrt(a * b)
    return math.pi / (2 * a)


def _ellip(n, rp, rs):
    eps = math.sqrt(10 ** (0.1 * rp) - 1)
    k1 = eps / math.sqrt(10 ** (0.1 * rs) - 1)
    k1c = math.sqrt(1 - k1 * k1)
    half = n // 2
    u = (2 * np.arange(1, half + 1) - 1) / n
    # degree equation: the selectivity that goes with n and k1
    kc = k1c**n * np.prod(_sn(u, _landen(k1c)) ** 4)
    k = math.sqrt(1 - kc * kc)
    moduli = _landen(k)
    zeta = _cd(u, moduli)
    z = 1j / (k * zeta)
    v0 = -1j * _asn(1j / eps, k1, _landen(k1)) / n
    p = 1j * _cd(u - 1j * v0, moduli)
    z, p = np.concatenate((z, z.conj())), np.concatenate((p, p.conj()))
    if n % 2:
        p = np.append(p, 1j * _sn(1j * v0, moduli))
    gain = (np.prod(-p) / np.prod(-z)).real
    return z, p, gain / math.sqrt(1 + eps * eps) if n % 2 == 0 else gain


def _transform(z, p, k, warped, kind):
    """Low-pass prototype to the band of warped edges."""
    d = len(p) - len(z)
    if kind == "lowpass":
        return z * warped[0], p * warped[0], k * warped[0] ** d
    if kind == "highpass":
        return np.concatenate((warped[0] / z, np.zeros(d))), warped[0] / p, k * (np.prod(-z) / np.prod(-p)).real
    bw, w0 = warped[1] - warped[0], math.sqrt(warped[0] * warped[1])

    def split(r):
        root = np.sqrt(r**2 - w0**2 + 0j)
        return np.concatenate((r + root, r - root))

    if kind == "bandpass":
        return np.concatenate((split(z * bw / 2), np.zeros(d))), split(p * bw / 2), k * bw**d
    zz = split(bw / 2 / z) if len(z) else np.zeros(0, complex)
    return np.concatenate((zz, np.full(d, 1j * w0), np.full(d, -1j * w0))), split(bw / 2 / p), k * (np.prod(-z) / np.prod(-p)).real


def _pair(r: np.ndarray) -> list[np.ndarray]:
    """Roots in conjugate pairs, then the real ones by twos."""
    r = np.asarray(r, complex)
    up = sorted(r[r.imag > 1e-9 * np.maximum(1, np.abs(r))], key=lambda x: (abs(abs(x) - 1), x.real))
    real = sorted(r[np.abs(r.imag) <= 1e-9 * np.maximum(1, np.abs(r))].real, key=abs)
    return [np.array([x, np.conj(x)]) for x in up] + [np.array(real[i : i + 2]) for i in range(0, len(real), 2)]


def to_sos(z, p, k) -> np.ndarray:
    """Sections of zeros, poles and gain: each pair of poles with the nearest zeros, poles nearest the unit circle last."""
    z = np.concatenate((z, np.zeros(max(0, len(p) - len(z)))))
    zs = _pair(z)
    out = []
    for q in sorted(_pair(p), key=lambda q: abs(1 - abs(q[0]))):
        i = min(range(len(zs)), key=lambda i: (len(zs[i]) != len(q), abs(zs[i][0] - q[0])))
        w = zs.pop(i)
        b, a = np.poly(w).real, np.poly(q).real
        out.append([*np.pad(b, (0, 3 - len(b))), *np.pad(a, (0, 3 - len(a)))])
    out = np.array(out[::-1])
    out[0, :3] *= k
    return out


def design(order: int, wn, fs: float, btype: str, ftype: str, gpass=1.0, gstop=40.0) -> np.ndarray:
    """Second-order sections of a digital filter; wn in Hz."""
    proto = {"butter": lambda: _butter(order), "cheby1": lambda: _cheby1(order, gpass), "cheby2": lambda: _cheby2(order, gstop), "ellip": lambda: _ellip(order, gpass, gstop)}[ftype]()
    warped = 4 * np.tan(np.pi * np.atleast_1d(wn) / fs)  # with a sampling rate of 2
    z, p, k = _transform(*proto, warped, btype)
    k = k * (np.prod(4 - z) / np.prod(4 - p)).real
    zd = np.concatenate(((4 + z) / (4 - z), -np.ones(len(p) - len(z))))
    return to_sos(zd, (4 + p) / (4 - p), k)


def _order_of(ftype, ratio, gpass, gstop) -> float:
    gp, gs = 10 ** (0.1 * gpass) - 1, 10 ** (0.1 * gstop) - 1
    if ftype == "butter":
        return math.log10(gs / gp) / (2 * math.log10(ratio))
    if ftype in ("cheby1", "cheby2"):
        return math.acosh(math.sqrt(gs / gp)) / math.acosh(ratio)
    k, k1 = 1 / ratio, math.sqrt(gp / gs)
    return ellip_k(k) * ellip_k(math.sqrt(1 - k1 * k1)) / (ellip_k(math.sqrt(1 - k * k)) * ellip_k(k1))


def _stop_ratio(pe, se) -> float:
    """Selectivity of a band stop with warped pass edges pe and stop edges se."""
    return np.abs(se * (pe[0] - pe[1]) / (se**2 - pe[0] * pe[1])).min()


def _minimise(f, lo, hi, steps=80):
    g = (math.sqrt(5) - 1) / 2
    a, b = hi - g * (hi - lo), lo + g * (hi - lo)
    fa, fb = f(a), f(b)
    for _ in range(steps):
        if fa < fb:
            hi, b, fb = b, a, fa
            a = hi - g * (hi - lo)
            fa = f(a)
        else:
            lo, a, fa = a, b, fb
            b = lo + g * (hi - lo)
            fb = f(b)
    return (lo + hi) / 2


def order_and_edges(ftype, fpass, fstop, fs, gpass, gstop) -> tuple[int, np.ndarray, str]:
    """The least order that meets the specification, the critical frequencies in Hz, and the band type."""
    kind = band_type(fpass, fstop)
    pe, se = (np.tan(np.pi * np.atleast_1d(x).astype(float) / fs) for x in (fpass, fstop))
    if kind == "lowpass":
        ratio = se[0] / pe[0]
    elif kind == "highpass":
        ratio = pe[0] / se[0]
    elif kind == "bandpass":
        ratio = np.abs((se**2 - pe[0] * pe[1]) / (se * (pe[0] - pe[1]))).min()
    else:
        need = lambda p: _order_of(ftype, max(1 + 1e-12, _stop_ratio(p, se)), gpass, gstop)
        pe[0] = _minimise(lambda x: need(np.array([x, pe[1]])), pe[0], se[0] - 1e-12)
        pe[1] = _minimise(lambda x: need(np.array([pe[0], x])), se[1] + 1e-12, pe[1])
        ratio = _stop_ratio(pe, se)
    n = max(1, math.ceil(_order_of(ftype, ratio, gpass, gstop)))
    wn = pe
    if ftype == "butter":
        w0 = (10 ** (0.1 * gpass) - 1) ** (-1 / (2 * n))  # 3 dB point of the prototype
    elif ftype == "cheby2":
        w0 = math.cosh(math.acosh(math.sqrt((10 ** (0.1 * gstop) - 1) / (10 ** (0.1 * gpass) - 1))) / n)
    else:
        w0 = 1.0
    if kind == "lowpass":
        wn = pe * w0
    elif kind == "highpass":
        wn = pe / w0
    else:
        s = w0 if kind == "bandpass" else 1 / w0
        root = math.sqrt((s * (pe[1] - pe[0])) ** 2 / 4 + pe[0] * pe[1])
        wn = np.array([root - s * (pe[1] - pe[0]) / 2, root + s * (pe[1] - pe[0]) / 2])
    return n, np.arctan(wn) * fs / np.pi, kind


def iir(ftype, fpass, fstop, fs, gpass=1.0, gstop=40.0) -> Iir:
    n, wn, kind = order_and_edges(ftype, fpass, fstop, fs, gpass, gstop)
    return Iir(design(n, wn, fs, kind, ftype, gpass, gstop), fs, n, wn, kind, ftype, tuple(np.atleast_1d(fpass)), tuple(np.atleast_1d(fstop)), gpass, gstop)


def butter(fpass, fstop, fs, gpass=1.0, gstop=40.0) -> Iir:
    return iir("butter", fpass, fstop, fs, gpass, gstop)


def cheby1(fpass, fstop, fs, gpass=1.0, gstop=40.0) -> Iir:
    return iir("cheby1", fpass, fstop, fs, gpass, gstop)


def cheby2(fpass, fstop, fs, gpass=1.0, gstop=40.0) -> Iir:
    return iir("cheby2", fpass, fstop, fs, gpass, gstop)


def ellip(fpass, fstop, fs, gpass=1.0, gstop=40.0) -> Iir:
    return iir("ellip", fpass, fstop, fs, gpass, gstop)


def notch(fstop: float, width: float, fs: float) -> Iir:
    """Second-order notch with 3 dB edges fstop ± width/2."""
    w0 = 2 * np.pi * fstop / fs
    g = 1 / (1 + math.tan(np.pi * width / fs))
    c = -2 * math.cos(w0)
    return Iir(np.array([[g, g * c, g, 1.0, g * c, 2 * g - 1]]), fs, 2, np.array([fstop]), "bandstop", "notch", (fstop - width / 2, fstop + width / 2), (fstop,), 3.0, 0.0)
