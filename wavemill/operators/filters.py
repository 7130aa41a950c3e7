"""FIR and IIR filtering, analytic signals and rational resampling, exact for any block size."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fir_design import Fir, hilbert, kaiser
from ..functions.iir_design import Iir, run_ba, run_sos, steady_ba, steady_state
from .signal import BLOCK, Signal, block_apply, dense, key_fields


def _fft_convolve(x: np.ndarray, h: np.ndarray) -> np.ndarray:
    if len(h) < 64 or len(x) < 64:
        return np.convolve(x, h)
    n = 1 << (len(x) + len(h) - 2).bit_length()
    return np.fft.irfft(np.fft.rfft(x, n) * np.fft.rfft(h, n), n)[: len(x) + len(h) - 1]


def convolve(sig: Signal, taps, mode: str = "same", block: int = BLOCK) -> Signal:
    """Linear convolution: `full` (N + w - 1 samples), `same` (N) or `valid` (N - w + 1)."""
    h = np.asarray(taps, float)
    w = len(h)
    shift = {"full": 0, "same": (w - 1) // 2, "valid": w - 1}[mode]  # place of output 0 in the full result
    block = max(block, w)

    def fn(b, idx, x):
        lo = b * block  # first output of this block
        first = lo + shift - (w - 1)
        stop = lo + block + shift
        y = _fft_convolve(dense(idx, x, first, stop), h)[w - 1 : w - 1 + block]
        last = idx[-1] + {"full": w - 1, "same": 0, "valid": 0}[mode] - (shift if mode == "valid" else 0)
        if mode == "same" and stop - 1 <= idx[-1]:
            last = lo + block - 1
        out = np.arange(lo, max(lo, min(lo + block, last + 1)))
        return {"idx": out, "value": y[: len(out)]}

    # sample i takes part in outputs i - shift .. i - shift + w - 1
    low = F.floor((F.col("idx") - shift) / block) if mode == "full" else F.greatest(F.lit(0), F.floor((F.col("idx") - shift) / block))
    high = F.greatest(F.lit(0), F.floor((F.col("idx") - shift + w - 1) / block))
    return sig.with_df(block_apply(sig, low, F.greatest(low, high), fn, {"idx": "bigint", "value": "double"}))


def fir(sig: Signal, f: Fir, mode: str = "same", block: int = BLOCK) -> Signal:
    return convolve(sig, f.coeffs, mode, block)


class Recursion:
    """A linear filter with a state: y, state = run(x, state). `size` numbers make a state; `steady` is the state of an endless
    input of 1."""

    def __init__(self, sos=None, ba=None):
        if (sos is None) == (ba is None):
            raise ValueError("either sections or (b, a)")
        self.sos = None if sos is None else np.asarray(sos, float)
        self.ba = None if ba is None else tuple(np.atleast_1d(np.asarray(c, float)) for c in ba)
        self.steady = steady_state(self.sos).ravel() if self.ba is None else steady_ba(*self.ba)
        self.size = len(self.steady)

    def run(self, x: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.ba is not None:
            return run_ba(*self.ba, x, z)
        y, z = run_sos(self.sos, x, np.asarray(z).reshape(-1, 2))
        return y, z.ravel()

    def free(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """What each unit state becomes in n samples without input: outputs (size x n), and states as columns (size x size)."""
        runs = [self.run(np.zeros(n), e) for e in np.eye(self.size)]
        return np.array([y for y, _ in runs]).reshape(self.size, n), np.stack([z for _, z in runs], 1) if runs else np.zeros((0, 0))


def _blocked(sig: Signal, block: int) -> DataFrame:
    """keys, b, start, x: the samples of each block in order."""
    x = sig.df.groupBy(*sig.keys, F.expr(f"idx div {block}").alias("b")).agg(F.array_sort(F.collect_list(F.struct("idx", "value"))).alias("s"))
    return x.select(*sig.keys, "b", F.col("s")[0]["idx"].alias("start"), F.transform("s", lambda s: s["value"]).alias("x"))


def _recursive(sig: Signal, f: Recursion, init: str | np.ndarray, both: bool, block: int) -> tuple[Signal, DataFrame]:
    """The filtered signal, forward or forward and backward, and the states (keys, z) that the forward run ends in.

    The signal is cut in blocks by one shuffle. Each block is run from rest, in parallel; a small row of it (its last states, and
    what the run back over its output would end in) is chained with those of the key's other blocks, since a state's effect
    on all of these is linear; then the blocks are run again, both ways, from their own states.
    """
    keys, m = list(sig.keys), f.size
    steady = f.steady if both or (isinstance(init, str) and init == "steady") else np.zeros(m)
    given = np.zeros(m) if isinstance(init, str) else np.asarray(init, float).ravel()
    blocks = _blocked(sig, block)
    numbers = "array<double>"

    def ends(batches):
        for t in batches:
            rows = []
            for x in t.column("x"):
                x = x.values.to_numpy()
                y, z = f.run(x, np.zeros(m))
                back = f.run(y[::-1], np.zeros(m))[1] if both else z
                rows.append((len(x), x[0], y[-1], z, back))
            n, first, last, z, back = zip(*rows, strict=True) if rows else ((),) * 5
            vectors = (pa.array([v.tolist() for v in c], pa.list_(pa.float64())) for c in (z, back))
            yield pa.RecordBatch.from_arrays([*(t.column(k) for k in [*keys, "b"]), pa.array(n, pa.int64()), pa.array(first, pa.float64()), pa.array(last, pa.float64()), *vectors], [*keys, "b", "n", "first", "last", "z", "back"])

    free: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    turned: dict[int, np.ndarray] = {}

    def chained(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """States that a key's blocks begin with on the way there and back, and the one that the way there ends in."""
        for n in {r["n"] for r in rows} - free.keys():
            free[n] = f.free(n)
            turned[n] = np.stack([f.run(y[::-1], np.zeros(m))[1] for y in free[n][0]], 1) if both and m else np.zeros((m, m))
        start, end = np.zeros((len(rows), m)), np.zeros((len(rows), m))
        state = given + steady * rows[0]["first"]
        for k, r in enumerate(rows):
            start[k] = state
            state = free[r["n"]][1] @ state + np.array(r["z"], float)
        after = state
        if both:
            state = steady * (rows[-1]["last"] + free[rows[-1]["n"]][0][:, -1] @ start[-1])
            for k in range(len(rows) - 1, -1, -1):
                n = rows[k]["n"]
                end[k] = state
                state = free[n][1] @ state + np.array(rows[k]["back"], float) + turned[n] @ start[k]
        return start, end, after

    def chain(batches):
        for t in batches:
            which, b, z, back, after = [], [], [], [], []
            for r, rows in enumerate(t.column("s").to_pylist()):
                start, end, last = chained(rows)
                which += [r] * len(rows)
                b += [x["b"] for x in rows]
                z += start.tolist()
                back += end.tolist()
                after += [last.tolist()] * len(rows)
            lists = (pa.array(c, pa.list_(pa.float64())) for c in (z, back, after))
            yield pa.RecordBatch.from_arrays([*(t.column(k).take(pa.array(which, pa.int64())) for k in keys), pa.array(b, pa.int64()), *lists], [*keys, "b", "z", "back", "after"])

    small = blocks.mapInArrow(ends, f"{key_fields(sig)}, b bigint, n bigint, first double, last double, z {numbers}, back {numbers}")
    by_key = small.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("b", "n", "first", "last", "z", "back"))).alias("s"))  # a small row for each block
    states = by_key.mapInArrow(chain, f"{key_fields(sig)}, b bigint, z {numbers}, back {numbers}, after {numbers}")

    def run(batches):
        for t in batches:
            ys, held = [], 0
            z, back, first = (t.column(c).to_pylist() for c in ("z", "back", "start"))
            for r, x in enumerate(t.column("x")):
                y, _ = f.run(x.values.to_numpy(), np.array(z[r], float))
                ys.append(f.run(y[::-1], np.array(back[r], float))[0][::-1] if both else y)
                held += len(y)
                if held >= block or r == t.num_rows - 1:
                    rows = np.arange(r + 1 - len(ys), r + 1)
                    which = pa.array(np.repeat(rows, [len(y) for y in ys]))
                    idx = np.concatenate([first[k] + np.arange(len(y)) for k, y in zip(rows, ys, strict=True)])
                    yield pa.RecordBatch.from_arrays([*(t.column(k).take(which) for k in keys), pa.array(idx), pa.array(np.concatenate(ys))], [*keys, "idx", "value"])
                    ys, held = [], 0

    x = blocks.join(states.drop("after"), [*keys, "b"])
    out = sig.with_df(x.mapInArrow(run, key_fields(sig) + ", idx bigint, value double"))
    return out, states.where("b = 0").select(*keys, F.col("after").alias("z"))


def sos_forward(sig: Signal, sos, init: str | np.ndarray = "rest", block: int = BLOCK, with_states: bool = False):
    """The cascade over each key's samples in order. init: `rest`, `steady` (as if the first value had always been there), or
    states (sections x 2). With `with_states` also (keys, z): the states at the end, in order of the sections."""
    out, states = _recursive(sig, Recursion(sos=sos), init, False, block)
    return (out, states) if with_states else out


def sos_both_ways(sig: Signal, sos, block: int = BLOCK) -> Signal:
    """Forward and backward without a phase shift, each run beginning in its steady state."""
    return _recursive(sig, Recursion(sos=sos), "steady", True, block)[0]


def ba_forward(sig: Signal, b, a, init: str | np.ndarray = "rest", block: int = BLOCK, with_states: bool = False):
    """The filter b/a in transposed direct form II; init as for sections, a state being as long as the filter's order."""
    out, states = _recursive(sig, Recursion(ba=(b, a)), init, False, block)
    return (out, states) if with_states else out


def ba_both_ways(sig: Signal, b, a, block: int = BLOCK) -> Signal:
    return _recursive(sig, Recursion(ba=(b, a)), "steady", True, block)[0]


def iir(sig: Signal, f: Iir, dephase: bool = True, init="rest", block: int = BLOCK, form: str = "sos") -> Signal:
    """Forward, or (dephase) forward and backward, by sections or (form `ba`) as one quotient, which is less exact."""
    if form not in ("sos", "ba"):
        raise ValueError(f"unknown form {form!r}")
    if form == "ba":
        return ba_both_ways(sig, *f.ba, block) if dephase else ba_forward(sig, *f.ba, init, block)
    return sos_both_ways(sig, f.sos, block) if dephase else sos_forward(sig, f.sos, init, block)


def analytic(sig: Signal, width: float, gpass: float = 0.01, gstop: float = 60.0, block: int = BLOCK) -> Signal:
    """Columns re (the signal) and im (its Hilbert transform)."""
    im = fir(sig, hilbert(width, sig.fs, gpass, gstop), "same", block).df.withColumnRenamed("value", "im")
    return sig.with_df(sig.df.withColumnRenamed("value", "re").join(im, [*sig.keys, "idx"]))


def amplitude(z: Signal) -> Signal:
    return z.with_df(z.df.select(*z.keys, "idx", F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("value")))


def phase(z: Signal) -> Signal:
    """In [0, 2 pi)."""
    a = F.atan2("im", "re")
    return z.with_df(z.df.select(*z.keys, "idx", F.when(a < 0, a + 2 * math.pi).otherwise(a).alias("value")))


def resample(sig: Signal, up: int, down: int, fir=kaiser, gpass: float = 0.1, gstop: float = 40.0, block: int = BLOCK) -> Signal:
    """By up/down: y[m] = L sum x[i] h[m M - i L + (len(h) - 1)/2], zeros outside; ceil(N L / M) samples at fs L / M. A channel of
    no more than M samples is an error when the plan runs."""
    g = math.gcd(up, down)
    up, down = up // g, down // g
    if up == down:
        return sig
    cut = sig.fs / (2 * max(up, down))
    h = fir(0.9 * cut, 1.1 * cut, sig.fs, gpass=gpass, gstop=gstop).coeffs
    half = (len(h) - 1) // 2
    span = -(-len(h) // up) + 1

    block = max(block, up)

    def fn(b, idx, x):
        if b == 0 and idx[-1] < down:  # all samples of so short a channel are here
            raise ValueError(f"{idx[-1] + 1} samples are too few to keep one of {down}")
        m = np.arange(b * block, min((b + 1) * block, -(-(int(idx[-1]) + 1) * up // down)))
        if not len(m):
            return {"idx": m, "value": np.zeros(0)}
        first = -(-(m * down - half) // up)  # first sample under the taps
        lo = int(first[0])
        padded = dense(idx, x, lo, int(first[-1]) + span)
        y = np.zeros(len(m))
        for k in range(span):
            tap = m * down - (first + k) * up + half
            y += padded[first + k - lo] * np.where((tap >= 0) & (tap < len(h)), h[np.clip(tap, 0, len(h) - 1)], 0)
        return {"idx": m, "value": up * y}

    low = F.greatest(F.lit(0), F.floor(F.ceil((F.col("idx") * up - half) / down) / block))
    high = F.greatest(low, F.floor(F.floor((F.col("idx") * up + half) / down) / block))
    return sig.with_df(block_apply(sig, low, high, fn, {"idx": "bigint", "value": "double"}), fs=sig.fs * up / down)


def downsample(sig: Signal, factor: int, **kw) -> Signal:
    return resample(sig, 1, factor, **kw)


def upsample(sig: Signal, factor: int, **kw) -> Signal:
    return resample(sig, factor, 1, **kw)
