"""Tapers by name. Symmetric windows are for filter design, periodic ones for spectra (a symmetric one of n + 1 points
without its last)."""

from __future__ import annotations

import numpy as np


def _cosine_sum(n: int, terms) -> np.ndarray:
    x = 2 * np.pi * np.arange(n) / max(1, n - 1)
    return sum((-1) ** k * a * np.cos(k * x) for k, a in enumerate(terms))


def _bartlett(n):
    return 1 - np.abs(2 * np.arange(n) / (n - 1) - 1)


WINDOWS = {
    "boxcar": np.ones,
    "rectangular": np.ones,
    "bartlett": _bartlett,
    "hann": lambda n: _cosine_sum(n, (0.5, 0.5)),
    "hamming": lambda n: _cosine_sum(n, (0.54, 0.46)),
    "blackman": lambda n: _cosine_sum(n, (0.42, 0.5, 0.08)),
    "nuttall": lambda n: _cosine_sum(n, (0.3635819, 0.4891775, 0.1365995, 0.0106411)),
    "blackmanharris": lambda n: _cosine_sum(n, (0.35875, 0.48829, 0.14128, 0.01168)),
    "flattop": lambda n: _cosine_sum(n, (0.21557895, 0.41663158, 0.277263158, 0.083578947, 0.006947368)),
    "cosine": lambda n: np.sin(np.pi * (np.arange(n) + 0.5) / n),
    "triang": lambda n: 1 - np.abs((np.arange(n) - (n - 1) / 2) / ((n + n % 2) / 2 + (0.5 if n % 2 else 0))),
    "kaiser": lambda n, beta: np.kaiser(n, beta),
    "gaussian": lambda n, std: np.exp(-0.5 * ((np.arange(n) - (n - 1) / 2) / std) ** 2),
    "tukey": lambda n, alpha=0.5: _tukey(n, alpha),
}


def _tukey(n, alpha):
    x = np.minimum(np.arange(n), n - 1 - np.arange(n)) / max(1, n - 1)
    return np.where(x < alpha / 2, 0.5 * (1 - np.cos(2 * np.pi * x / alpha)), 1.0) if alpha > 0 else np.ones(n)


def register(name: str, fn) -> None:
    """Makes fn(n, *parameters) -> array known as a window."""
    WINDOWS[name] = fn


def window(spec, n: int, periodic: bool = True) -> np.ndarray:
    """A window by name, (name, parameters...), or as an array of n points."""
    if isinstance(spec, (list, np.ndarray)) and not isinstance(spec[0], str):
        if len(spec) != n:
            raise ValueError(f"a window of {len(spec)} points for {n}")
        return np.asarray(spec, float)
    name, *args = (spec,) if isinstance(spec, str) else spec
    if name not in WINDOWS:
        raise ValueError(f"unknown window {name!r}")
    if n == 1:
        return np.ones(1)
    return np.asarray(WINDOWS[name](n + 1, *args)[:-1] if periodic else WINDOWS[name](n, *args), float)
