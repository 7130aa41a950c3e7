"""Filters, windows and weights for the queries' SQL, by formulas of their own: in SQL where it can do them, else in closed form.
Nothing here uses the package's designs, so that equal results speak for both."""

from __future__ import annotations

import cmath
import math

#: DuckDB's modified Bessel function of order 0, by its series.
_I0 = "list_sum(list_transform(range(0, 40), lambda i: pow(pow({x} / 2, i) / gamma(i + 1), 2)))"
_SINC = "(case when {x} = 0 then 1 else sin(pi() * ({x})) / (pi() * ({x})) end)"
# Cosine terms of the windows, and taps times the transition in units of Nyquist
_COSINES = {"boxcar": (1.0,), "hann": (0.5, 0.5), "hamming": (0.54, 0.46), "blackman": (0.42, 0.5, 0.08)}
_WIDTHS = {"boxcar": 4, "bartlett": 8, "hann": 8, "hamming": 8, "blackman": 12}


def window_sql(name: str, k: str, points: str, beta: float = 0.0) -> str:
    """The window's value at k, where points are one less than those of a symmetric window (and those of a periodic one)."""
    if name == "bartlett":
        return f"(1 - abs(2.0 * {k} / ({points}) - 1))"
    if name == "kaiser":
        at = f"{beta!r} * sqrt(greatest(0, 1 - pow(2.0 * {k} / ({points}) - 1, 2)))"
        return f"({_I0.format(x=f'({at})')} / {_I0.format(x=repr(beta))})"
    return "(" + " ".join(f"{'-' if i % 2 else '+'} {a} * cos({2 * i} * pi() * {k} / ({points}))" for i, a in enumerate(_COSINES[name])) + ")"


def _attenuation(gpass: float, gstop: float) -> float:
    return max(-20 * math.log10(1 - 10 ** (-gpass / 20)), gstop)


def fir_taps_sql(win: str, fpass, fstop, fs: float, gpass: float = 1.0, gstop: float = 40.0, name: str = "taps") -> str:
    """Tables {name}_n (n) and {name} (k, h): the windowed ideal filter, of unit gain in the middle of its first pass band."""
    p, s = ((x,) if isinstance(x, (int, float)) else tuple(x) for x in (fpass, fstop))
    width = min(abs(a - b) for a, b in zip(p, s, strict=True)) / (fs / 2)
    att = _attenuation(gpass, gstop)
    beta = 0.1102 * (att - 8.7) if att > 50 else 0.5842 * (att - 21) ** 0.4 + 0.07886 * (att - 21) if att > 21 else 0.0
    n = f"ceil(({att!r} - 7.95) / (2.285 * pi() * {width!r}) + 1)" if win == "kaiser" else f"floor({_WIDTHS.get(win, 0) / width!r})"
    edges = [(a + b) / fs for a, b in zip(p, s, strict=True)]
    if len(p) == 1:
        bands = [(0.0, edges[0])] if p[0] < s[0] else [(edges[0], 1.0)]
    else:
        bands = [(0.0, edges[0]), (edges[1], 1.0)] if p[0] < s[0] else [(edges[0], edges[1])]
    lo, hi = bands[0]
    at = 0.0 if lo == 0 else 1.0 if hi == 1 else (lo + hi) / 2
    m = "(k - (n - 1) / 2.0)"
    ideal = " + ".join(f"{b!r} * {_SINC.format(x=f'{b!r} * {m}')} - {a!r} * {_SINC.format(x=f'{a!r} * {m}')}" for a, b in bands)
    return f"""{name}_n as (select (n + 1 - n % 2)::bigint as n from (select {n}::bigint as n)),
{name}_i as (select k, n, ({ideal}) * {window_sql(win, 'k', 'n - 1.0', beta)} as h from {name}_n, lateral (select unnest(range(0, n)) as k)),
{name} as (select k, h / sum(h * cos(pi() * {m} * {at!r})) over () as h from {name}_i)"""


def hilbert_taps_sql(width: float, fs: float, gpass: float = 0.01, gstop: float = 60.0, name: str = "taps") -> str:
    """The same for a Hilbert transformer: 2 / (pi m) at odd distances m from the middle, under a periodic Kaiser window."""
    att = _attenuation(gpass, gstop)
    m = "(k - (n - 1) // 2)"
    return f"""{name}_n as (select (n + 1 - n % 2)::bigint as n from (select ceil(({att!r} - 7.95) / (2.285 * pi() * {width / (fs / 2)!r}) + 1)::bigint as n)),
{name} as (select k, case when abs({m}) % 2 = 1 then 2 / (pi() * {m}) else 0 end * {window_sql('kaiser', 'k', 'n::double', 0.1102 * (att - 8.7))} as h from {name}_n, lateral (select unnest(range(0, n)) as k))"""


# Simpson's rule on 13 points of distance 1, and the last of 13 more steps by (5, 8, -1) / 12
SIMPSON_14 = (1 / 3, 4 / 3, 2 / 3, 4 / 3, 2 / 3, 4 / 3, 2 / 3, 4 / 3, 2 / 3, 4 / 3, 2 / 3, 4 / 3 - 1 / 12, 1 / 3 + 8 / 12, 5 / 12)


def notch_sections(f0: float, width: float, fs: float) -> list[list[float]]:
    c, t = math.cos(2 * math.pi * f0 / fs), math.tan(math.pi * width / fs)
    return [[1 / (1 + t), -2 * c / (1 + t), 1 / (1 + t), 1.0, -2 * c / (1 + t), (1 - t) / (1 + t)]]


def lowpass_sections(kind: str, fpass: float, fstop: float, fs: float, gpass: float, gstop: float) -> list[list[float]]:
    """Sections of the least order that meets the specification: poles of the prototype with edge 1, s = (1 - q) / (1 + q)."""
    wp, ws = math.tan(math.pi * fpass / fs), math.tan(math.pi * fstop / fs)
    gp, gs = 10 ** (gpass / 10) - 1, 10 ** (gstop / 10) - 1
    if kind == "butter":
        n = math.ceil(math.log(gs / gp) / (2 * math.log(ws / wp)))
        edge, grow = wp * gp ** (-1 / (2 * n)), (1.0, 1.0)
    else:
        n = math.ceil(math.acosh(math.sqrt(gs / gp)) / math.acosh(ws / wp))
        mu = math.asinh(1 / math.sqrt(gp) if kind == "cheby1" else math.sqrt(gs)) / n
        edge, grow = (wp if kind == "cheby1" else wp * math.cosh(math.acosh(math.sqrt(gs / gp)) / n)), (math.sinh(mu), math.cosh(mu))
    out = []
    for k in range((n + 1) // 2):
        t = math.pi * (2 * k + 1) / (2 * n)
        p = complex(-grow[0] * math.sin(t), grow[1] * math.cos(t))
        p = edge * (1 / p if kind == "cheby2" else p)
        z = edge / math.cos(t) if kind == "cheby2" and 2 * k + 1 != n else None
        if 2 * k + 1 == n:  # the real pole
            a, b = [1 - p.real, -1 - p.real, 0.0], [-p.real, -p.real, 0.0]
        else:
            r = abs(p) ** 2
            a = [1 - 2 * p.real + r, 2 * r - 2, 1 + 2 * p.real + r]
            b = [r, 2 * r, r] if z is None else [(1 + z * z) * r / z**2, (2 * z * z - 2) * r / z**2, (1 + z * z) * r / z**2]
        out.append([x / a[0] for x in (*b, *a)])
    if kind == "cheby1" and n % 2 == 0:
        out[0][:3] = [x * 10 ** (-gpass / 20) for x in out[0][:3]]
    return out


def steady(sections) -> list[tuple[float, float]]:
    """States in which a constant input of 1 leaves each section, given what those before it make of it."""
    out, x = [], 1.0
    for b0, b1, b2, _, a1, a2 in sections:
        y = x * (b0 + b1 + b2) / (1 + a1 + a2)
        z2 = b2 * x - a2 * y
        out.append((b1 * x - a1 * y + z2, z2))
        x = y
    return out


def gain(sections, f: float, fs: float) -> float:
    q = cmath.exp(-2j * math.pi * f / fs)
    return abs(math.prod((b0 + b1 * q + b2 * q * q) / (a0 + a1 * q + a2 * q * q) for b0, b1, b2, a0, a1, a2 in sections))


def normal_tail_sql(z: str) -> str:
    """1 - Phi(z) to 12 digits after the point."""
    series = f"list_sum(list_transform(range(0, 150), lambda i: exp((2 * i + 1) * ln(greatest(abs({z}), 1e-300)) - i * ln(2) - lgamma(i + 1)) * case when i % 2 = 0 then 1 else -1 end / (2 * i + 1)))"
    near = f"(0.5 - {series} / sqrt(2 * pi()))"
    return f"(case when abs({z}) > 5 then case when {z} > 0 then 0.0 else 1.0 end when {z} >= 0 then {near} else 1 - {near} end)"
