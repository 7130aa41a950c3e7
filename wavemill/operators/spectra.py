"""Welch spectra, short-time Fourier transforms and measures of power."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.windows import window
from .signal import Signal, block_apply, dense

#: Segments that a block computes at once.
SEGMENTS = 256


def _detrend(x: np.ndarray, how: str) -> np.ndarray:
    if how == "constant":
        return x - x.mean(-1, keepdims=True)
    if how == "linear":
        t = np.arange(x.shape[-1]) - (x.shape[-1] - 1) / 2
        mean = x.mean(-1, keepdims=True)
        return x - mean - (x @ t / (t @ t) if len(t) > 1 else np.zeros(x.shape[:-1]))[..., None] * t
    if not how:
        return x
    raise ValueError(f"unknown detrend {how!r}")


def modified_dft(x: np.ndarray, fs: float, nfft: int, win="hann", detrend="constant", scaling="density") -> np.ndarray:
    """Scaled one-sided transform along the last axis: cropped to nfft, detrended, windowed, zero-padded."""
    x = x[..., :nfft]
    w = window(win, x.shape[-1])
    if scaling not in ("density", "spectrum"):
        raise ValueError(f"unknown scaling {scaling!r}")
    norm = 1 / (fs * (w @ w)) if scaling == "density" else 1 / w.sum() ** 2
    return np.fft.rfft(_detrend(x, detrend) * w, nfft) * np.sqrt(norm)


def one_sided(p: np.ndarray, nfft: int) -> np.ndarray:
    p = p.copy()
    p[..., 1 : (-1 if nfft % 2 == 0 else None)] *= 2
    return p


def _segments(idx, x, first, count, stride, nfft, offset=0) -> np.ndarray:
    """Rows of the segments first .. first + count - 1, where segment j begins at j * stride - offset."""
    lo = first * stride - offset
    flat = dense(idx, x, lo, lo + (count - 1) * stride + nfft)
    return np.lib.stride_tricks.sliding_window_view(flat, nfft)[::stride]


def _plan(fs, resolution, overlap, nfft):
    nfft = nfft or int(fs / resolution)
    return nfft, nfft - int(nfft * overlap)


def periodograms(sig: Signal, nfft: int, overlap: float = 0.5, win="hann", detrend="constant", scaling="density") -> DataFrame:
    """keys, seg, k, freq, p: of every full segment."""
    nfft, stride = _plan(sig.fs, None, overlap, nfft)
    return _blocks(sig, nfft, stride, win, detrend, scaling, False)


def _blocks(sig, nfft, stride, win, detrend, scaling, summed, strict=False):
    fs = sig.fs
    kept = min(SEGMENTS, max(1, (1 << 20) // stride))

    def fn(b, idx, x):
        first = b * kept
        if strict and b == 0 and idx[-1] < nfft - 1:
            raise ValueError(f"a channel of {idx[-1] + 1} samples has no segment of {nfft}")
        count = min(kept, (int(idx[-1]) + 1 - nfft) // stride + 1 - first)
        nk = nfft // 2 + 1
        if count <= 0:
            return {c: np.zeros(0) for c in ("seg", "k", "freq", "p")}
        p = one_sided(np.abs(modified_dft(_segments(idx, x, first, count, stride, nfft), fs, nfft, win, detrend, scaling)) ** 2, nfft)
        if summed:  # one row for each bin of the block
            return {"seg": np.full(nk, count), "k": np.arange(nk), "freq": np.arange(nk) * fs / nfft, "p": p.sum(0)}
        return {"seg": np.repeat(first + np.arange(count), nk), "k": np.tile(np.arange(nk), count), "freq": np.tile(np.arange(nk) * fs / nfft, count), "p": p.ravel()}

    low = F.greatest(F.lit(0), F.floor((F.ceil((F.col("idx") - (nfft - 1)) / stride)) / kept))
    high = F.floor(F.col("idx") / (stride * kept))
    return block_apply(sig, low, F.greatest(low, high), fn, {"seg": "bigint", "k": "int", "freq": "double", "p": "double"})


def psd(sig: Signal, resolution: float = 0.5, win="hann", overlap: float = 0.5, detrend="constant", scaling="density", nfft: int | None = None, short: str = "error") -> DataFrame:
    """Welch's estimate: keys, k, freq, psd, n_segments. A channel shorter than a segment is an error when the plan runs, or has
    no rows (short: `drop`)."""
    nfft, stride = _plan(sig.fs, resolution, overlap, nfft)
    if nfft < 1 or stride < 1:
        raise ValueError("segments without samples, or an overlap of 1 or more")
    if short not in ("error", "drop"):
        raise ValueError(f"unknown {short!r}")
    sums = _blocks(sig, nfft, stride, win, detrend, scaling, True, short == "error")
    out = sums.groupBy(*sig.keys, "k").agg(F.first("freq").alias("freq"), (F.sum("p") / F.sum("seg")).alias("psd"), F.sum("seg").alias("n_segments"))
    return out.select(*sig.keys, "k", "freq", "psd", "n_segments")


def stft(sig: Signal, resolution: float = 0.5, win="hann", overlap: float = 0.5, detrend="constant", scaling="density", boundary: bool = True, padded: bool = True, nfft: int | None = None) -> DataFrame:
    """keys, seg, t, k, freq, re, im. boundary: nfft//2 zeros before and after; padded: a stride of zeros more unless the
    length is a multiple of the stride."""
    nfft, stride = _plan(sig.fs, resolution, overlap, nfft)
    fs, side = sig.fs, nfft // 2 if boundary else 0
    kept = min(SEGMENTS, max(1, (1 << 20) // stride))
    keys = list(sig.keys)
    total = F.col("_n") + 2 * side
    total = total + (F.when(total % stride != 0, stride).otherwise(0) if padded else 0)
    n = sig.lengths("_n").withColumn("_segs", F.floor((total - nfft) / stride) + 1)
    x = sig.with_df(sig.df.join(n, keys))

    def fn(b, idx, v):
        v, segs = v
        first = b * kept
        count = min(kept, int(segs[0]) - first)
        nk = nfft // 2 + 1
        if count <= 0:
            return {c: np.zeros(0) for c in ("seg", "t", "k", "freq", "re", "im")}
        z = modified_dft(_segments(idx, v, first, count, stride, nfft, side), fs, nfft, win, detrend, scaling)
        j = first + np.arange(count)
        t = j * stride / fs if boundary else (nfft // 2 + j * stride) / fs
        return {"seg": np.repeat(j, nk), "t": np.repeat(t, nk), "k": np.tile(np.arange(nk), count), "freq": np.tile(np.arange(nk) * fs / nfft, count), "re": z.real.ravel(), "im": z.imag.ravel()}

    at = F.col("idx") + side
    low = F.greatest(F.lit(0), F.floor(F.ceil((at - (nfft - 1)) / stride) / kept))
    # the last sample goes to all blocks after it, which hold padding only
    high = F.when(F.col("idx") == F.col("_n") - 1, F.floor((F.col("_segs") - 1) / kept)).otherwise(F.floor(at / (stride * kept)))
    return block_apply(x, low, F.greatest(low, high), fn, {"seg": "bigint", "t": "double", "k": "int", "freq": "double", "re": "double", "im": "double"}, ("value", "_segs"))


def simpson_weights(n: int) -> np.ndarray:
    """Weights of Simpson's rule for n equally spaced points of distance 1; an even number has the last interval corrected."""
    if n == 1:
        return np.zeros(1)
    if n == 2:
        return np.full(2, 0.5)
    m = n if n % 2 else n - 1
    w = np.zeros(n)
    w[:m] = 2 / 3
    w[1:m:2] = 4 / 3
    w[0] = w[m - 1] = 1 / 3
    if m < n:
        w[-3:] += np.array([-1, 8, 5]) / 12
    return w


def _band(spectrum: DataFrame, start: float | None, stop: float | None) -> DataFrame:
    """k and Simpson weight (with the frequency step) of the bins nearest to start .. stop, both included."""
    f = [r[0] for r in spectrum.select("k", "freq").distinct().orderBy("k").select("freq").collect()]  # one row per bin
    if len(f) < 2:
        raise ValueError("a spectrum of fewer than two bins")
    a = 0 if start is None else int(np.abs(np.array(f) - start).argmin())
    b = len(f) - 1 if stop is None else int(np.abs(np.array(f) - stop).argmin())
    w = simpson_weights(b - a + 1) * (f[1] - f[0])
    return spectrum.sparkSession.createDataFrame([(a + i, float(x)) for i, x in enumerate(w)], "k int, _w double")


def power(spectrum: DataFrame, keys, start: float | None = None, stop: float | None = None) -> DataFrame:
    """Band power by Simpson's rule: keys, power."""
    band = F.broadcast(_band(spectrum, start, stop))
    return spectrum.join(band, "k").groupBy(*keys).agg(F.sum(F.col("psd") * F.col("_w")).alias("power"))


def power_norm(spectrum: DataFrame, keys, start: float | None = None, stop: float | None = None) -> DataFrame:
    """The spectrum divided by its power in the band."""
    p = power(spectrum, keys, start, stop)
    return spectrum.join(p, list(keys)).withColumn("psd", F.col("psd") / F.nullif(F.col("power"), F.lit(0.0))).drop("power")


def chi2_quantile(spark, q: float, dof: float) -> float:
    return spark._jvm.org.apache.commons.math3.distribution.ChiSquaredDistribution(float(dof)).inverseCumulativeProbability(q)


def confidence_interval(spectrum: DataFrame, n_estimates: int, alpha: float = 0.05) -> DataFrame:
    """Adds ci_low and ci_high, with as many degrees of freedom as estimates."""
    hi, lo = (n_estimates / chi2_quantile(spectrum.sparkSession, q, n_estimates) for q in (alpha / 2, 1 - alpha / 2))
    return spectrum.withColumn("ci_low", F.col("psd") * lo).withColumn("ci_high", F.col("psd") * hi)


def spectrogram_db(z: DataFrame, freqs: tuple[float, float] | None = None, times: tuple[float, float] | None = None) -> DataFrame:
    """10 log10(|X|² + 1) of a short-time transform; of the bins nearest to the ends of `freqs` and those between, and of the
    segments from the one nearest to the first of `times` up to, but without, the one nearest to the second."""
    asked = {c: v for c, v in (("freq", freqs), ("t", times)) if v is not None}
    if asked:
        ends = z.agg(*(F.min_by(c, F.struct(F.abs(F.col(c) - float(x)), F.col(c))) for c, v in asked.items() for x in v)).first()
        for k, c in enumerate(asked):
            lo, hi = ends[2 * k], ends[2 * k + 1]
            if lo is not None:
                z = z.where((F.col(c) >= lo) & (F.col(c) <= hi if c == "freq" else F.col(c) < hi))
    p = F.col("re") * F.col("re") + F.col("im") * F.col("im")
    return z.withColumn("db", 10 * F.log10(p + 1)).drop("re", "im")


def banded(spectrum: DataFrame, bands: dict[str, tuple[float, float]], value: str = "psd") -> DataFrame:
    """The rows of the named bands of frequencies (both ends included), with the name in `band`; bands may overlap."""
    names = [F.when(F.col("freq").between(float(lo), float(hi)), F.lit(n)) for n, (lo, hi) in bands.items()]
    return spectrum.withColumn("band", F.explode(F.filter(F.array(*names), lambda x: x.isNotNull())))
