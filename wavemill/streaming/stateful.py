"""Filters and estimators with state by channel for Structured Streaming, and windows on event time.

Input rows are (ch, idx, value); a micro-batch may hold samples of a channel in any order. Samples are worked on in the order of
idx: those after a gap wait in the state until it is filled. Results equal those of the batch operators.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions.fir_design import kaiser
from ..functions.iir_design import run_sos
from ..operators.spectra import modified_dft, one_sided

STATE = "next long, wait_idx array<long>, wait_value array<double>, memory array<double>"


def _run(stream: DataFrame, out: str, start, work, limit: int | None, mode: str = "append") -> DataFrame:
    """work(first idx, new samples, memory) -> (frame without ch, memory), on gapless runs of each channel. With a limit, more
    waiting samples than that are an error; without one the state holds all that wait."""
    kind = stream.schema["ch"].dataType.simpleString()

    def step(key, frames, state):
        nxt, wi, wv, memory = state.get if state.exists else (0, [], [], list(start))
        new = pd.concat(list(frames), ignore_index=True)
        idx = np.concatenate((np.asarray(wi, np.int64), new["idx"].to_numpy(np.int64)))
        val = np.concatenate((np.asarray(wv, float), new["value"].to_numpy(float)))
        keep = idx >= nxt  # repeated samples are ignored
        order = np.argsort(idx[keep], kind="stable")
        idx, val = idx[keep][order], val[keep][order]
        idx, first = np.unique(idx, return_index=True)
        val = val[first]
        ready = int((idx == nxt + np.arange(len(idx))).sum()) if len(idx) else 0
        if limit is not None and len(idx) - ready > limit:
            raise ValueError(f"more than {limit} samples of channel {key} wait for a missing one")
        got, memory = work(nxt, val[:ready], np.asarray(memory, float))
        state.update((int(nxt + ready), idx[ready:].tolist(), val[ready:].tolist(), np.asarray(memory, float).tolist()))
        got.insert(0, "ch", key[0])
        yield got

    return stream.groupBy("ch").applyInPandasWithState(step, f"ch {kind}, {out}", STATE, mode, GroupStateTimeout.NoTimeout)


def stream_fir(stream: DataFrame, taps, limit: int | None = None) -> DataFrame:
    """The causal part of a full convolution: y[i] from samples up to i. State: the last taps - 1 samples."""
    h = np.asarray(taps, float)
    w = len(h)

    def work(at, x, memory):
        y = np.convolve(np.concatenate((memory, x)), h)[w - 1 : w - 1 + len(x)] if len(x) else x
        memory = np.concatenate((memory, x))[-(w - 1) :] if w > 1 else memory[:0]
        return pd.DataFrame({"idx": at + np.arange(len(x)), "value": y}), memory

    return _run(stream, "idx long, value double", [0.0] * (w - 1), work, limit)


def stream_sos(stream: DataFrame, sos, limit: int | None = None) -> DataFrame:
    """Forward IIR filtering. State: two numbers a section."""
    sos = np.asarray(sos, float)

    def work(at, x, memory):
        y, z = run_sos(sos, x, memory.reshape(-1, 2))
        return pd.DataFrame({"idx": at + np.arange(len(x)), "value": y}), z.ravel()

    return _run(stream, "idx long, value double", [0.0] * (2 * len(sos)), work, limit)


def stream_psd(stream: DataFrame, fs: float, nfft: int, overlap: float = 0.5, win="hann", detrend="constant", scaling="density", limit: int | None = None) -> DataFrame:
    """Welch's estimate so far, after every micro-batch with a new segment. State: the unfinished segment and the running sum."""
    stride, nk = nfft - int(nfft * overlap), nfft // 2 + 1

    def work(at, x, memory):
        count, sums, tail = memory[0], memory[1 : nk + 1], np.concatenate((memory[nk + 1 :], x))
        n = max(0, (len(tail) - nfft) // stride + 1)
        out = pd.DataFrame({"k": pd.Series(dtype="int32"), "freq": pd.Series(dtype="float64"), "psd": pd.Series(dtype="float64"), "n_segments": pd.Series(dtype="int64")})
        if n:
            segs = np.lib.stride_tricks.sliding_window_view(tail, nfft)[: (n - 1) * stride + 1 : stride]
            sums = sums + one_sided(np.abs(modified_dft(segs, fs, nfft, win, detrend, scaling)) ** 2, nfft).sum(0)
            count += n
            tail = tail[n * stride :]
            out = pd.DataFrame({"k": np.arange(nk, dtype=np.int32), "freq": np.arange(nk) * fs / nfft, "psd": sums / count, "n_segments": int(count)})
        return out, np.concatenate(([count], sums, tail))

    return _run(stream, "k int, freq double, psd double, n_segments long", [0.0] * (nk + 1), work, limit, "update")


def stream_stft(stream: DataFrame, fs: float, nfft: int, overlap: float = 0.5, win="hann", detrend="constant", scaling="density", limit: int | None = None) -> DataFrame:
    """Each full segment's transform as soon as its samples are there (as of stft() without boundary and padding). State: the
    number of segments so far and the unfinished one."""
    stride, nk = nfft - int(nfft * overlap), nfft // 2 + 1

    def work(at, x, memory):
        first, tail = int(memory[0]), np.concatenate((memory[1:], x))
        n = max(0, (len(tail) - nfft) // stride + 1)
        z = np.zeros((0, nk), complex)
        if n:
            segs = np.lib.stride_tricks.sliding_window_view(tail, nfft)[: (n - 1) * stride + 1 : stride]
            z = modified_dft(segs, fs, nfft, win, detrend, scaling)
        seg = first + np.arange(n)
        out = pd.DataFrame({"seg": np.repeat(seg, nk), "t": np.repeat((nfft // 2 + seg * stride) / fs, nk), "k": np.tile(np.arange(nk, dtype=np.int32), n), "freq": np.tile(np.arange(nk) * fs / nfft, n), "re": z.real.ravel(), "im": z.imag.ravel()})
        return out, np.concatenate(([first + n], tail[n * stride :]))

    return _run(stream, "seg long, t double, k int, freq double, re double, im double", [0.0], work, limit)


def stream_resample(stream: DataFrame, up: int, down: int, fs: float, fir=kaiser, gpass: float = 0.1, gstop: float = 40.0, limit: int | None = None) -> DataFrame:
    """Rational resampling as of resample(); a value comes when the last sample under its taps is there. State: the samples
    under the taps of the next one."""
    g = math.gcd(up, down)
    up, down = up // g, down // g
    cut = fs / (2 * max(up, down))
    h = fir(0.9 * cut, 1.1 * cut, fs, gpass=gpass, gstop=gstop).coeffs if up != down else np.ones(1)
    half = (len(h) - 1) // 2
    keep = 2 * half // up + 2

    def work(at, x, memory):
        held = np.concatenate((memory, x))
        base = at - len(memory)  # idx of the first held sample; zeros before the signal
        m = np.arange(max(0, -(-(at * up - half) // down)), max(0, -(-((at + len(x)) * up - half) // down)))
        y = np.zeros(len(m))
        first = -(-(m * down - half) // up)
        for k in range(2 * half // up + 1):
            i = first + k
            tap = m * down - i * up + half
            ok = (tap >= 0) & (tap < len(h)) & (i >= max(0, base)) & (i < at + len(x))
            y[ok] += held[i[ok] - base] * h[tap[ok]]
        return pd.DataFrame({"idx": m, "value": up * y}), held[-keep:]

    return _run(stream, "idx long, value double", [0.0] * keep, work, limit)


def event_windows(events: DataFrame, width: str, slide: str | None = None, delay: str = "1 hour", by=("event_type",)) -> DataFrame:
    """Counts and sums of values in tumbling or sliding windows; late rows beyond the delay are dropped in a stream."""
    x = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = x.groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), *by, "n", "total")


def event_sessions(events: DataFrame, gap: str, delay: str = "1 hour", by=("user_id",)) -> DataFrame:
    """Sessions by gap of inactivity."""
    x = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    out = x.groupBy(F.session_window("ts", gap).alias("w"), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), *by, "n", "total")
