"""Operators on signals against whole-array NumPy, for several block sizes."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavemill.functions import fir_design as fd
from wavemill.functions import iir_design as idn
from wavemill.functions.windows import window
from wavemill.operators import algebra, coupling, filters, responses, shape, spectra, transforms
from wavemill.operators.pipeline import Pipeline, allocate, assignable, pickleable
from wavemill.operators.signal import Signal, from_array, from_chunks, from_function, from_rows, map_blocks, normalize_axis, to_array
from wavemill.sources import annotations, edf, protocols, synthetic
from wavemill.streaming import stateful


@pytest.fixture(scope="module")
def x():
    return np.random.default_rng(0).standard_normal((3, 1003))


@pytest.fixture(scope="module")
def sig(spark, x):
    s = from_array(spark, x, fs=100.0)
    return s.with_df(s.df.repartition(5).cache())


def test_layouts(spark, sig, x):
    assert np.array_equal(to_array(sig), x)
    assert np.array_equal(to_array(from_chunks(sig.chunked(100), sig.keys)), x)
    y = np.arange(24.0).reshape(2, 3, 4)
    assert np.array_equal(to_array(from_array(spark, y, axis=1)), np.moveaxis(y, 1, -1).reshape(-1, 3))
    with pytest.raises(TypeError):
        from_array(spark, "x")
    with pytest.raises(MemoryError):
        to_array(sig, 10)
    with pytest.raises(IndexError):
        normalize_axis(2, 2)


@pytest.mark.parametrize("kind", ["int", "sparse", "nulls", "timestamp", "string", "double"])
@pytest.mark.parametrize("bucket", [7, None])
def test_rows_are_numbered(spark, kind, bucket):
    """By whole numbers and times in buckets, by anything else in ranges; null keys are a channel of their own."""
    rng = np.random.default_rng(2)
    order = rng.permutation(500)
    if bucket and kind == "timestamp":
        bucket *= 1_000_003
    made = {"int": "n - 250", "sparse": "n * 18000000000000000L - 4500000000000000000L", "nulls": "if(n < 40, null, n)", "timestamp": "timestamp_micros(n * 1000003)", "string": "lpad(n, 5, '0')", "double": "n / 7.0D"}[kind]
    rows = [(None if n % 5 == 4 else f"c{n % 5}", int(n), float(n)) for n in order]
    df = spark.createDataFrame(rows, "ch string, n int, value double").selectExpr("ch", f"{made} as at", "value").repartition(3)
    got = from_rows(df, "ch", "at", "value", bucket=bucket).df.collect()
    assert len(got) == 500
    for ch in (None, "c0", "c3"):
        mine = sorted((r.idx, r.value) for r in got if r.ch == ch)
        assert [i for i, _ in mine] == list(range(100))
        want = sorted(v for c, _, v in rows if c == ch)
        assert [v for _, v in mine] == want or (kind == "nulls" and [v for _, v in mine][8:] == want[8:])


def test_generated_parts(spark):
    sizes = [5, 0, 130, 1, 64]
    make = lambda k: np.arange(2 * sizes[k], dtype=float).reshape(2, sizes[k]) + 1000 * k
    got = to_array(from_function(spark, make, 5, 10.0))
    assert np.array_equal(got, np.concatenate([make(k) for k in range(5)], 1))
    with pytest.raises(ValueError):
        from_function(spark, lambda k: np.zeros((k + 1, 4)), 3)
    assert to_array(from_function(spark, lambda k: np.ones(3) * k, 2)).tolist() == [[0, 0, 0, 1, 1, 1]]


@pytest.mark.parametrize("block", [50, 1003, 4000])
def test_user_function(sig, x, block):
    def fn(b, idx, v):
        w = np.convolve(np.pad(v, 2, "edge"), np.ones(5) / 5, "valid")
        return w[(idx >= b * block) & (idx < (b + 1) * block)]

    assert np.allclose(to_array(map_blocks(sig, fn, 2, block))[:, 2:-2], [np.convolve(r, np.ones(5) / 5, "valid") for r in x])
    with pytest.raises(Exception, match="values for"):
        to_array(map_blocks(sig, lambda b, idx, v: v[:-1], 0, block))


@pytest.mark.parametrize("s", [(5, 900, 1), (3, None, 7), (None, -100, 2), (-50, None, 1), (None, None, -1), (900, 10, -13), (2000, 3000, 1)])
def test_slices(sig, x, s):
    got, want = to_array(shape.take_slice(sig, *s)), x[:, slice(*s)]
    assert np.array_equal(got, want) or got.size == want.size == 0


def test_shapes(spark, sig, x):
    assert np.array_equal(to_array(shape.pad(sig, (3, 2), 1.5)), np.pad(x, ((0, 0), (3, 2)), constant_values=1.5))
    for how, mode in (("edge", "edge"), ("even", "reflect"), ("zero", "constant")):
        assert np.allclose(to_array(shape.extend(sig, 7, how)), np.pad(x, ((0, 0), (7, 7)), mode))
    assert np.allclose(to_array(shape.extend(sig, 7, "odd")), np.pad(x, ((0, 0), (7, 7)), "reflect", reflect_type="odd"))
    z = to_array(shape.zero_stuff(sig, 3))
    assert z.shape == (3, 3009) and np.array_equal(z[:, ::3], x) and not z[:, 1::3].any()
    assert np.array_equal(to_array(shape.concatenate([sig, shape.take_slice(sig, 0, 10)])), np.concatenate((x, x[:, :10]), 1))
    assert np.array_equal(to_array(shape.reverse(sig)), x[:, ::-1])
    a, b = shape.split(sig, 400)
    assert np.array_equal(to_array(a), x[:, :400]) and np.array_equal(to_array(b), x[:, 400:])
    assert shape.expand_dims(sig, "rec").keys == ("rec", "d0") and shape.squeeze(shape.expand_dims(sig, "rec"), "rec").keys == ("d0",)
    with pytest.raises(ValueError):
        shape.squeeze(sig, "d0")
    assert np.array_equal(to_array(shape.channels(sig, [0, 2])), x[[0, 2]])


def test_masks(spark, sig, x):
    ann = spark.createDataFrame([("a", 1.5, 2.0, "x"), ("b", 3.0, 1.005, "x"), ("c", 9.0, 50.0, "x")], "label string, time double, duration double, channel string")
    keep = np.zeros(1003, bool)
    for t, d in ((1.5, 2.0), (3.0, 1.005), (9.0, 50.0)):
        keep[int(np.rint(t * 100)) : int(np.rint((t + d) * 100))] = True
    assert np.array_equal(to_array(shape.mask_by_annotations(sig, ann)), x[:, keep])
    assert np.array_equal(to_array(shape.mask_by_annotations(sig, ann, include=False)), x[:, ~keep])
    mask = shape.as_mask(spark, ann, 1003, 100.0)
    assert [r.keep for r in mask.orderBy("idx").collect()] == keep.tolist()
    assert algebra.count_true(mask).first()[0] == keep.sum()
    m = shape.index_mask(spark, 1003, [slice(0, 10, 2), [3, 5], 1000])
    assert [r.idx for r in m.where("keep").orderBy("idx").collect()] == [0, 2, 3, 4, 5, 6, 8, 1000]
    assert np.array_equal(to_array(shape.apply_mask(sig, m)), x[:, [0, 2, 3, 4, 5, 6, 8, 1000]])


@pytest.mark.parametrize("bucket", [1 << 22, 64, 7])
def test_intervals(spark, bucket):
    """Ranges that overlap, touch, hold each other and reach over many buckets."""
    rng = np.random.default_rng(bucket)
    rows = [("a", float(t), float(d), "x") for t, d in zip(rng.uniform(0, 8, 60), rng.exponential(0.15, 60))] + [("b", 2.0, 3.0, "x"), ("b", 2.0, 3.0, "x"), ("c", 7.0, 0.0, "x")]
    keep = np.zeros(1100, bool)
    for _, t, d, _ in rows:
        keep[int(np.rint(t * 100)) : int(np.rint((t + d) * 100))] = True
    ann = spark.createDataFrame(rows, "label string, time double, duration double, channel string").repartition(3)
    got = sorted((r.start, r.stop) for r in shape.intervals(ann, 100.0, bucket).collect())
    assert all(a < b for a, b in got) and all(b <= c for (_, b), (c, _) in zip(got, got[1:]))
    seen = np.zeros(1100, bool)
    for a, b in got:
        seen[a:b] = True
    assert np.array_equal(seen, keep)
    assert shape.intervals(ann.where("false"), 100.0, bucket).collect() == []


def test_channel_axis(spark, sig, x):
    s = Signal(sig.df.withColumnRenamed("d0", "ch"), ("ch",), sig.fs)
    assert np.array_equal(to_array(shape.pad(s, (1, 2), 0.5, axis="ch")), np.pad(x, ((1, 2), (0, 0)), constant_values=0.5))
    assert np.allclose(to_array(algebra.standardize(s, over="ch")), (x - x.mean(0)) / x.std(0))
    flat = to_array(algebra.standardize(from_array(spark, np.array([[2.0, 2.0, 2.0], [1.0, 2.0, 3.0]]))))
    assert np.isnan(flat[0]).all() and np.allclose(flat[1], [-np.sqrt(1.5), 0, np.sqrt(1.5)])


def test_broadcast(spark, sig, x):
    row, col, grid = np.linspace(0, 1, 1003), np.array([[1.0], [2.0], [3.0]]), x[::-1] + 1
    for other in (row, col, grid, np.array([[2.5]]), 4.0, row[None], row.tolist()):
        assert np.allclose(to_array(algebra.add(sig, other)), x + np.asarray(other))
        assert np.allclose(to_array(algebra.multiply(sig, other)), x * np.asarray(other))
    for bad in (row[:-1], np.ones((2, 1)), np.ones((1, 3, 1003))):
        with pytest.raises(ValueError):
            algebra.add(sig, bad)


def test_algebra(spark, sig, x):
    assert np.allclose(to_array(algebra.add(sig, 2)), x + 2)
    assert np.allclose(to_array(algebra.multiply(sig, sig)), x * x)
    with pytest.raises(Exception, match="different shapes"):
        to_array(algebra.add(sig, shape.take_slice(sig, 0, 5)))
    z = algebra.multiply_complex(algebra.multiply(sig, 3 * (0.5 + 3j)), 1j).df.orderBy("d0", "idx").toPandas()
    assert np.allclose(z["re"] + 1j * z["im"], (x * 3 * (0.5 + 3j) * 1j).ravel())
    w = np.linspace(0, 1, 1003)
    assert np.allclose(to_array(algebra.multiply_along(sig, w)), x * w)
    assert np.allclose(to_array(algebra.multiply_along(sig, [1, 2, 3], "d0")), x * np.array([[1], [2], [3]]))
    with pytest.raises(ValueError):
        algebra.multiply_along(sig, [1, 2])
    y = x.copy()
    y[0, 5] = np.nan
    s = from_array(spark, y)
    assert np.allclose([r[1] for r in algebra.mean(s).orderBy("d0").collect()], np.nanmean(y, 1))
    assert np.isnan(algebra.mean(s, ignore_nan=False).orderBy("d0").first()[1])
    assert np.allclose([r.std for r in algebra.std(s).orderBy("d0").collect()], np.nanstd(y, 1))
    assert np.allclose([r.mean for r in algebra.mean(sig, over="d0").orderBy("idx").collect()], x.mean(0))
    assert np.allclose(to_array(algebra.standardize(sig)), (x - x.mean(1, keepdims=True)) / x.std(1, keepdims=True))
    assert algebra.nearest(sig.df.where("d0 = 0"), "value", 0.3).first()[0] == np.abs(x[0] - 0.3).argmin()


@pytest.mark.parametrize("mode", ["full", "same", "valid"])
@pytest.mark.parametrize("block,w", [(40, 31), (100, 76), (100, 1), (1003, 2), (5000, 76)])
def test_convolution(sig, x, mode, block, w):
    h = np.random.default_rng(w).standard_normal(w)
    got = to_array(filters.convolve(shape.channels(sig, [0]), h, mode, block))
    want = np.convolve(x[0], h, "full")
    lo = {"full": 0, "same": (w - 1) // 2, "valid": w - 1}[mode]
    n = {"full": 1003 + w - 1, "same": 1003, "valid": 1003 - w + 1}[mode]
    assert got.shape == (1, n) and np.allclose(got[0], want[lo : lo + n])


def brute_sos(sos, x, zi=None):
    y = x
    for k, s in enumerate(sos):
        z = [0.0, 0.0] if zi is None else list(zi[k])
        out = np.zeros(len(y))
        for i, v in enumerate(y):
            out[i] = s[0] * v + z[0]
            z = [s[1] * v - s[4] * out[i] + z[1], s[2] * v - s[5] * out[i]]
        y = out
    return y


@pytest.mark.parametrize("block", [50, 2000])
def test_iir(sig, x, block):
    for f in (idn.notch(10, 1, 100.0), idn.cheby1((10, 20), (5, 30), 100.0), idn.ellip(30, 20, 100.0)):
        assert np.allclose(to_array(filters.iir(sig, f, dephase=False, block=block)), [brute_sos(f.sos, r) for r in x], atol=1e-9)
        zi = idn.steady_state(f.sos)
        want = []
        for r in x:
            y = brute_sos(f.sos, r, zi * r[0])[::-1]
            want.append(brute_sos(f.sos, y, zi * y[0])[::-1])
        assert np.allclose(to_array(filters.iir(sig, f, block=block)), want, atol=1e-8)
        assert np.allclose(to_array(filters.iir(sig, f, block=block, form="ba")), want, atol=1e-6)
        assert np.allclose(to_array(filters.iir(sig, f, dephase=False, block=block, form="ba")), [brute_sos(f.sos, r) for r in x], atol=1e-6)
    # in two parts, the second from the states that the first ends in
    one = shape.channels(sig, [0])
    head, states = filters.sos_forward(shape.take_slice(one, 0, 700), f.sos, block=block, with_states=True)
    tail = filters.sos_forward(shape.take_slice(one, 700), f.sos, np.array(states.first().z), block)
    assert np.allclose(np.concatenate((to_array(head), to_array(tail)), 1), to_array(filters.sos_forward(one, f.sos, block=block)), atol=1e-9)
    with pytest.raises(ValueError):
        filters.iir(sig, f, form="xy")


def brute_ba(b, a, x):
    y = np.zeros(len(x))
    for i in range(len(x)):
        y[i] = sum(b[k] * x[i - k] for k in range(min(len(b), i + 1))) - sum(a[k] * y[i - k] for k in range(1, min(len(a), i + 1)))
    return y


@pytest.mark.parametrize("b,a", [([1.0, 0.5], [1.0]), ([0.2, 0.1, 0.3, 0.05], [1.0, -0.4, 0.1]), ([0.3], [1.0, -0.2, 0.1, 0.05]), ([2.0], [1.0])])
def test_quotients(sig, x, b, a):
    got = to_array(filters.ba_forward(sig, b, a, block=64))
    assert np.allclose(got, [brute_ba(b, a, r) for r in x])
    assert np.allclose(to_array(filters.ba_both_ways(from_array(sig.df.sparkSession, np.ones((1, 200))), b, a, 64)), (sum(b) / sum(a)) ** 2)


def test_zpk():
    for f in (idn.cheby1(20, 35, 100.0, 1, 20), idn.ellip(20, 30, 100.0, 1, 20), idn.notch(20, 4, 100.0)):
        z, p, k = f.zpk
        fr, h = f.response(50)
        q = np.exp(2j * np.pi * fr / 100)
        n = len(p) - len(z)
        assert np.allclose(h, k * np.prod(q[:, None] - z, 1) / np.prod(q[:, None] - p, 1) * q**n)


@pytest.mark.parametrize("up,down", [(1, 2), (3, 1), (3, 5), (5, 3), (3, 11), (4, 2), (2, 2)])
@pytest.mark.parametrize("block", [64, 3000])
def test_resampling(sig, x, up, down, block):
    got = to_array(filters.resample(sig, up, down, block=block))
    g = math.gcd(up, down)
    up, down = up // g, down // g
    if up == down:
        assert np.array_equal(got, x)
        return
    cut = 100.0 / (2 * max(up, down))
    h = fd.kaiser(0.9 * cut, 1.1 * cut, 100.0, 0.1, 40).coeffs * up
    stuffed = np.zeros((3, 1003 * up))
    stuffed[:, ::up] = x
    half = (len(h) - 1) // 2
    want = np.array([np.convolve(r, h)[half : half + 1003 * up : down] for r in stuffed])
    assert got.shape[1] == -(-1003 * up // down) and np.allclose(got, want)


def test_too_few_samples(sig):
    short = shape.take_slice(sig, 0, 8)
    with pytest.raises(Exception, match="too few"):
        filters.downsample(short, 8).df.count()
    assert to_array(filters.downsample(short, 7)).shape == (3, 2)
    with pytest.raises(Exception, match="no segment"):
        spectra.psd(short, nfft=9).count()
    assert spectra.psd(short, nfft=9, short="drop").count() == 0 and spectra.psd(short, nfft=8).count() == 15


def brute_welch(r, fs, nfft, overlap, win, detrend, scaling):
    stride = nfft - int(nfft * overlap)
    w = window(win, nfft)
    out = []
    for a in range(0, len(r) - nfft + 1, stride):
        s = r[a : a + nfft]
        t = np.arange(nfft)
        s = s - (s.mean() if detrend == "constant" else np.polyval(np.polyfit(t, s, 1), t))
        p = np.abs(np.array([(s * w * np.exp(-2j * np.pi * k * t / nfft)).sum() for k in range(nfft // 2 + 1)])) ** 2
        p *= 1 / (fs * (w**2).sum()) if scaling == "density" else 1 / w.sum() ** 2
        p[1 : (-1 if nfft % 2 == 0 else None)] *= 2
        out.append(p)
    return np.array(out)


@pytest.mark.parametrize("nfft,overlap,win,detrend,scaling", [(64, 0.5, "hann", "constant", "density"), (51, 0.3, "blackman", "linear", "spectrum"), (100, 0.0, ("kaiser", 5.0), "constant", "density")])
def test_welch(sig, x, nfft, overlap, win, detrend, scaling, monkeypatch):
    monkeypatch.setattr(spectra, "SEGMENTS", 4)
    want = np.array([brute_welch(r, 100.0, nfft, overlap, win, detrend, scaling) for r in x])
    got = spectra.psd(sig, win=win, overlap=overlap, detrend=detrend, scaling=scaling, nfft=nfft).orderBy("d0", "k").toPandas()
    assert np.allclose(got["psd"], want.mean(1).ravel()) and set(got["n_segments"]) == {want.shape[1]}
    each = spectra.periodograms(sig, nfft, overlap, win, detrend, scaling).orderBy("d0", "seg", "k").toPandas()
    assert np.allclose(each["p"], want.ravel())
    assert spectra.psd(shape.take_slice(sig, 0, nfft - 1), nfft=nfft, short="drop").count() == 0


@pytest.mark.parametrize("boundary", [True, False])
@pytest.mark.parametrize("padded", [True, False])
@pytest.mark.parametrize("nfft,overlap", [(64, 0.5), (50, 0.8), (90, 0.1)])
def test_stft(sig, x, boundary, padded, nfft, overlap, monkeypatch):
    monkeypatch.setattr(spectra, "SEGMENTS", 3)
    stride = nfft - int(nfft * overlap)
    y = np.pad(x, ((0, 0), (nfft // 2,) * 2)) if boundary else x
    if padded and y.shape[1] % stride:
        y = np.pad(y, ((0, 0), (0, stride)))
    want = np.array([[spectra.modified_dft(r[a : a + nfft], 100.0, nfft) for a in range(0, y.shape[1] - nfft + 1, stride)] for r in y])
    got = spectra.stft(sig, overlap=overlap, boundary=boundary, padded=padded, nfft=nfft).orderBy("d0", "seg", "k").toPandas()
    assert np.allclose(got["re"] + 1j * got["im"], want.ravel())
    t = np.arange(want.shape[1]) * stride / 100 + (0 if boundary else nfft // 2 / 100)
    assert np.allclose(got["t"].to_numpy().reshape(want.shape)[0, :, 0], t)


def test_power(spark, sig):
    for n in (2, 5, 6, 9):
        w = spectra.simpson_weights(n)
        assert np.isclose(w @ np.arange(n) ** min(2, n - 1), (n - 1) ** min(3, n) / min(3, n)) or n == 2
    s = spectra.psd(sig, nfft=64)
    t = s.where("d0 = 0").orderBy("k").toPandas()
    p = spectra.power(s, ["d0"], 10, 30).orderBy("d0").first().power
    a, b = np.abs(t["freq"] - 10).argmin(), np.abs(t["freq"] - 30).argmin()
    assert np.isclose(p, spectra.simpson_weights(b - a + 1) @ t["psd"][a : b + 1] * (t["freq"][1]))
    norm = spectra.power(spectra.power_norm(s, ["d0"], 10, 30), ["d0"], 10, 30)
    assert np.allclose([r.power for r in norm.collect()], 1)
    banded = spectra.banded(s, {"low": (5, 10), "both": (9, 20)}).groupBy("band").count().collect()
    assert dict(map(tuple, banded)) == {"low": 3 * (((t["freq"] >= 5) & (t["freq"] <= 10)).sum()), "both": 3 * (((t["freq"] >= 9) & (t["freq"] <= 20)).sum())}
    z = spectra.stft(sig, nfft=64)
    cut = spectra.spectrogram_db(z, (10, 20), (1.0, 3.0)).agg(F.min("freq"), F.max("freq"), F.min("t"), F.max("t")).first()
    f, at = t["freq"].to_numpy(), np.arange(33) * 0.32
    near = lambda grid, v: grid[np.abs(grid - v).argmin()]
    assert np.allclose(cut, [near(f, 10), near(f, 20), near(at, 1), near(at, 3) - 0.32]) and spectra.spectrogram_db(z).count() == z.count()
    ci = spectra.confidence_interval(s, 10).first()
    assert np.isclose(ci.ci_high / ci.psd, 10 / 3.24697, atol=1e-4) and ci.ci_low < ci.psd < ci.ci_high


def test_fir_designs():
    for f, att in ((fd.kaiser(500, 700, 5000), 38), (fd.hamming(500, 700, 5000), 50), (fd.hann(700, 500, 5000), 40), (fd.blackman((500, 900), (300, 1100), 5000), 70), (fd.bartlett(500, 700, 5000), 20), (fd.rectangular((300, 1100), (500, 900), 5000), 18)):
        fr, h = f.response(4000, "dB")
        edges = np.sort(np.concatenate((f.fpass, f.fstop)))
        stop = {"lowpass": fr >= edges[-1], "highpass": fr <= edges[0], "bandpass": (fr <= edges[0]) | (fr >= edges[-1]), "bandstop": (fr >= edges[1]) & (fr <= edges[-2])}[f.btype]
        assert h[stop].max() < -att and f.numtaps % 2 == 1
        cut = (np.array(f.fpass) + np.array(f.fstop)) / 2
        assert np.allclose(np.interp(cut, fr, h), -6.02, atol=0.8)
    assert fd.kaiser(500, 700, 5000).numtaps == 57 and fd.hamming(500, 700, 5000).numtaps == 101 and fd.hilbert(4, 250).numtaps == 229
    assert len(fd.kaiser(500, 700, 5000).impulse()) == 5000 + 56
    r = fd.remez([0, 500, 700, 2500], [1, 0], 5000)
    fr, h = r.response(4000, "dB")
    assert h[fr >= 700].max() < -38 and h[fr <= 500].min() > -1.3
    with pytest.raises(ValueError):
        fd.band_type((1, 2, 3), (1, 2, 3))


@pytest.mark.parametrize("kind", ["butter", "cheby1", "cheby2", "ellip"])
@pytest.mark.parametrize("fpass,fstop", [(200, 400), (400, 200), ((400, 800), (300, 900)), ((300, 900), (400, 800))])
def test_iir_designs(kind, fpass, fstop):
    f = idn.iir(kind, fpass, fstop, 5000, 2, 40)
    fr, h = f.response(20000, "dB")
    p, s = np.atleast_1d(fpass), np.atleast_1d(fstop)
    inside = lambda e, out: (fr <= e[0]) | (fr >= e[1]) if out else (fr >= e[0]) & (fr <= e[1])
    ok, no = {"lowpass": lambda: (fr <= p[0], fr >= s[0]), "highpass": lambda: (fr >= p[0], fr <= s[0]), "bandpass": lambda: (inside(p, 0), inside(s, 1)), "bandstop": lambda: (inside(p, 1), inside(s, 0))}[f.btype]()
    assert h[ok].min() > -2.01 and h[ok].max() < 0.01 and h[no].max() < -39.99
    assert max(abs(np.roots(q[3:])).max() for q in f.sos) < 1


def test_known_filters():
    b, a = idn.Iir(idn.design(2, 1000, 4000, "lowpass", "butter"), 4000, 2, None, "lowpass", "butter").ba
    assert np.allclose(b, [0.29289322, 0.58578644, 0.29289322]) and np.allclose(a, [1, 0, 0.17157288])
    assert idn.cheby1(200, 400, 5000, 0.5, 40).order == 5
    f, h = idn.notch(60, 4, 5000).response(5000, "abs")
    assert np.interp(60, f, h) < 1e-2 and abs(np.interp(58, f, h) - 0.707) < 0.02


def test_hilbert_tone(spark):
    s = synthetic.tone(spark, 30, 250, 8)
    z = filters.analytic(s, 4).df.orderBy("idx").toPandas()[500:-500]
    want = -np.cos(2 * np.pi * 8 * z["idx"] / 250)
    assert np.abs(z["im"] - want).max() < 0.03
    a = filters.amplitude(filters.analytic(s, 4)).df.orderBy("idx").toPandas()["value"][500:-500]
    assert np.abs(a - 1).max() < 0.03
    view = transforms.Analytic(s, 4)
    assert repr(view) == "Analytic(ch at 250 samples a second, width=4)"
    b = view.amplitudes().df.orderBy("idx").toPandas()["value"][500:-500]
    assert np.array_equal(a, b) and view.phases().df.count() == 7500
    p = filters.phase(filters.analytic(s, 4)).df
    assert p.where("value < 0 or value >= 6.2831854").count() == 0


def test_unwrap(spark):
    t = np.linspace(0, 60, 700)
    truth = np.stack([t**1.3, -2 * t, 3 * np.sin(t)])
    wrapped = truth % (2 * np.pi)
    want = truth + (wrapped[:, :1] - truth[:, :1])
    assert np.allclose(responses.unwrap(wrapped), want)
    for block in (10, 64, 1000):
        assert np.allclose(to_array(responses.unwrapped(from_array(spark, wrapped), block=block)), want)


def test_response_frames(spark):
    f = fd.kaiser((10, 20), (4, 26), 100.0)
    r = responses.response(spark, f, 500).orderBy("freq").toPandas()
    assert np.abs(np.diff(r["phase"])).max() <= np.pi and np.allclose(r["db"], np.maximum(-100, 20 * np.log10(r["gain"])))
    band = r[(r["freq"] > 10) & (r["freq"] < 20)]
    assert np.allclose(np.diff(band["phase"]) / np.diff(band["freq"]), -2 * np.pi * f.delay / 100.0)  # linear: its delay
    assert responses.impulse(spark, idn.notch(20, 4, 100.0)).count() == 100
    got = [tuple(x) for x in responses.bands(spark, f).orderBy("low").collect()]
    assert [x[:3] for x in got] == [("stop", 0.0, 4.0), ("transition", 4.0, 10.0), ("pass", 10.0, 20.0), ("transition", 20.0, 26.0), ("stop", 26.0, 50.0)]
    assert [x[0] for x in responses.bands(spark, idn.butter(30, 20, 100.0)).orderBy("low").collect()] == ["stop", "transition", "pass"]


def test_normal_tail(spark):
    z = [-9.0, -3.2, -1.0, 0.0, 0.5, 2.9, 3.0, 3.1, 6.0, 12.0, 30.0]
    got = spark.createDataFrame([(v,) for v in z], "z double").select(coupling.normal_tail(F.col("z"))).collect()
    for v, (p,) in zip(z, got):
        assert math.isclose(p, 0.5 * math.erfc(v / math.sqrt(2)), rel_tol=1e-10)


def convolved(x, f):
    half = (len(f.coeffs) - 1) // 2
    return np.convolve(x, f.coeffs)[half : half + len(x)]


def test_coupling(spark):
    """A band wide enough for the modulation, against NumPy."""
    s = synthetic.coupled(spark, 20, 250, 4, 40, strength=1.0, sigma=0.05)
    s = s.with_df(s.df.cache())
    x = to_array(s)[0]
    lock = coupling.PhaseLock((3, 5), (2, 6), 1.5, 0.3, 2.0, bandwidth=12, window_s=0.4, surrogates=20)
    events = lock.events(s)
    slow = convolved(x, fd.kaiser((3, 5), (2, 6), 250))
    phase = np.arctan2(convolved(slow, fd.hilbert(2.0, 250)), slow) % (2 * np.pi)
    at = np.flatnonzero(np.abs(phase - 1.5) < 0.3)
    assert sorted(r.idx for r in events.collect()) == at.tolist() and len(at) > 20
    got = lock.estimate(s, [40], events).orderBy("offset").toPandas()
    fast = convolved(x, fd.kaiser((34, 46), (28, 52), 250))
    fast = (fast - fast.mean()) / fast.std()
    power = fast**2 + convolved(fast, fd.hilbert(2.0, 250)) ** 2

    def locked(at):
        at = at[(at >= 50) & (at + 50 <= len(x))]
        return np.mean([power[i - 50 : i + 50] for i in at], 0)

    real = locked(at)
    null = np.array([locked((at + int(v * len(x))) % len(x)) for v in np.random.default_rng(0).random(20)])
    z = (real - null.mean(0)) / (null.std(0) / np.sqrt(20))
    assert len(got) == 100 and np.allclose(got["power"], real)
    assert np.allclose(got["pvalue"], [0.5 * math.erfc(v / math.sqrt(2)) for v in z], rtol=1e-6)
    assert got["pvalue"].between(0, 1).all() and (got["adjusted"] >= got["pvalue"] * (1 - 1e-12)).all()
    assert got["power"].max() > 2 * got["power"].min()
    frame = lock.frame(lock.estimate(s, [40], events), 250)
    assert {"seconds", "significant"} <= set(frame.columns) and frame.where("significant").count() > 0
    p = spark.createDataFrame([(0, v) for v in (0.01, 0.04, 0.03, 0.5)], "g int, pvalue double")
    assert np.allclose(sorted(r.adjusted for r in coupling.fdr(p, ["g"]).collect()), [0.04, 0.16 / 3, 0.16 / 3, 0.5])


@pytest.mark.parametrize("spr", [(50, 100, 25), (64, 64)])
@pytest.mark.parametrize("ranged", [True, False])
def test_edf(spark, tmp_path, spr, ranged, monkeypatch):
    """In pieces of two records, and where only Spark's readers and one stream reach the file."""
    monkeypatch.setattr(edf, "PIECE", 4 * sum(spr))
    if not ranged:
        monkeypatch.setattr(edf, "_ranges", lambda uri: None)
        monkeypatch.setattr(edf, "_local", lambda uri: None)
    rng = np.random.default_rng(1)
    n, k = 8, len(spr)
    values = {"version": "0", "patient": "p", "recording": "r", "start_date": "01.01.20", "start_time": "00.00.00", "header_bytes": 256 * (k + 1), "reserved_0": "", "num_records": n, "record_duration": 1.0, "num_signals": k, "names": [f"c{i}" for i in range(k)], "transducers": [""] * k, "physical_dim": ["uV"] * k, "physical_min": [-1000.0] * k, "physical_max": [1000.0] * k, "digital_min": [-32768.0] * k, "digital_max": [32767.0] * k, "prefiltering": [""] * k, "samples_per_record": list(spr), "reserved_1": [""] * k}
    h = edf.Header.from_dict(values)
    with pytest.raises(ValueError):
        edf.Header.from_dict({"names": []})
    data = [rng.uniform(-900, 900, s * n) for s in spr]
    rows = [(i, j, float(v)) for i, d in enumerate(data) for j, v in enumerate(d)]
    sig = Signal(spark.createDataFrame(rows, "ch int, idx long, value double"), ("ch",), 50.0)
    path = f"{tmp_path}/a.edf"
    edf.write(sig, h, path)
    assert edf.read_header(spark, path).values == values
    got = edf.read(spark, path)
    for i, d in enumerate(data):
        v = np.array([r.value for r in got.df.where(f"ch = {i}").orderBy("idx").collect()])
        assert np.abs(v - d).max() <= 0.5 * h.slopes[0] + 1e-9
    part = edf.read(spark, path, [1], 70, 150).df.orderBy("idx").toPandas()
    assert part["idx"].tolist() == list(range(80)) and np.abs(part["value"] - data[1][70:150]).max() < 0.02
    assert edf.read(spark, path, [0], 10**6).df.count() == 0
    # channels of other rates have their own idx; filled up, all are as long as the longest
    assert got.rates == {i: float(n) for i, n in enumerate(spr)} and not h.annotated and h.annotation is None
    whole = edf.read(spark, path, padvalue=float("nan"))
    assert {r[0]: r[1] for r in whole.lengths().collect()} == dict.fromkeys(range(k), n * max(spr))
    nans = {r[0]: r[1] for r in whole.df.groupBy("ch").agg(F.sum(F.isnan("value").cast("int"))).collect()}
    assert nans == {i: n * (max(spr) - s) for i, s in enumerate(spr)}
    cut = edf.read(spark, path, None, 90, n * max(spr) - 5, -1.0).df
    assert cut.count() == k * (n * max(spr) - 95) and cut.agg(F.min("idx"), F.max("idx")).first() == (0, n * max(spr) - 96)
    assert {int(r.ch) for r in cut.where("value = -1").select("ch").distinct().collect()} == {i for i, s in enumerate(spr) if s < max(spr)}
    out = edf.split(spark, path, {"x": [0], "y": list(range(1, k))}, str(tmp_path))
    assert edf.read_header(spark, out[1]).names == h.names[1:]
    assert edf.headers(spark, f"{tmp_path}/*.edf").count() == 2 * k
    with pytest.raises(ValueError):
        edf.write(shape.take_slice(sig, 0, 7), h, f"{tmp_path}/b.edf")
    with pytest.raises(ValueError):
        edf.read(spark, path, 1)


def test_edf_annotations(spark, tmp_path):
    """A signal of annotations is no channel."""
    values = {"version": "0", "patient": "p", "recording": "r", "start_date": "01.01.20", "start_time": "00.00.00", "header_bytes": 768, "reserved_0": "EDF+C", "num_records": 3, "record_duration": 1.0, "num_signals": 2, "names": ["EDF Annotations", "c"], "transducers": [""] * 2, "physical_dim": ["", "uV"], "physical_min": [-1.0, -100.0], "physical_max": [1.0, 100.0], "digital_min": [-32768.0] * 2, "digital_max": [32767.0] * 2, "prefiltering": [""] * 2, "samples_per_record": [4, 10], "reserved_1": [""] * 2}
    h = edf.Header.from_dict(values)
    assert h.annotated and h.annotation == 0 and h.channels == [1] and h.samples == [30]
    (tmp_path / "p.edf").write_bytes(h.encode() + np.arange(42, dtype="<i2").tobytes())
    reader = protocols.open_recording(spark, str(tmp_path / "p.edf"))
    assert reader.channels == [1] and reader.shape() == (1, 30)
    got = [r.value for r in reader.read(5, 25).df.orderBy("idx").collect()]
    raw = np.arange(42).reshape(3, 14)[:, 4:].ravel()[5:25]
    assert np.allclose(got, raw * h.slopes[1] + h.offsets[1])


def test_protocols(spark, tmp_path):
    class Csv(protocols.Reader):
        channels = [0]

        def shape(self):
            return 1, self.read().df.count()

        def read(self, start=0, stop=None, channels=None, padvalue=None):
            rows = self.spark.read.csv(self.path, schema="idx long, value double").selectExpr("0 as ch", "idx", "value")
            return shape.take_slice(Signal(rows), start, stop)

    (tmp_path / "x.csv").write_text("0,1.5\n1,2.5\n2,3.5\n")
    with pytest.raises(ValueError):
        protocols.open_recording(spark, str(tmp_path / "x.csv"))
    with pytest.raises(TypeError):
        protocols.register("csv", dict)
    with pytest.raises(TypeError):
        protocols.Reader(spark, "x")
    protocols.register(".CSV", Csv)
    r = protocols.open_recording(spark, str(tmp_path / "x.csv"))
    assert r.shape() == (1, 3) and to_array(r.read(1)).tolist() == [[2.5, 3.5]]
    s = from_array(spark, np.arange(20.0).reshape(1, 20))
    values = {"version": "0", "patient": "p", "recording": "r", "start_date": "01.01.20", "start_time": "00.00.00", "header_bytes": 512, "reserved_0": "", "num_records": 2, "record_duration": 1.0, "num_signals": 1, "names": ["c"], "transducers": [""], "physical_dim": [""], "physical_min": [-32768.0], "physical_max": [32767.0], "digital_min": [-32768.0], "digital_max": [32767.0], "prefiltering": [""], "samples_per_record": [10], "reserved_1": [""]}
    protocols.EdfWriter(str(tmp_path / "w.edf")).write(s, edf.Header.from_dict(values))
    assert to_array(protocols.open_recording(spark, str(tmp_path / "w.edf")).read()).tolist() == [list(range(20))]


def test_odd_annotations(spark, tmp_path):
    """Short rows, quoted fields, lines like those of the preamble, numbers and times that can't be read, other delimiters."""
    head = "Start Time|End Time|Time From Start|Channel|Annotation"
    rows = ['02/09/22 09:19:38.094000|02/09/22 09:19:40.594000|12.5|EEG1|"rest|ing"', "x", "1/2|3|abc|EEG2|odd", head, "", "02/09/22 09:19:38|02/09/22 09:19:39|2|EEG1|whole"]
    (tmp_path / "o.txt").write_text("\n".join(["x", head, *rows]))
    got = [tuple(r) for r in annotations.read_annotations(spark, str(tmp_path / "o.txt"), 1, "|").collect()]
    assert got == [("rest|ing", 12.5, 2.5, "EEG1"), (None, None, None, None), ("odd", None, None, "EEG2"), ("Annotation", None, None, "Channel"), ("whole", 2.0, 1.0, "EEG1")]
    with pytest.raises(Exception, match="no columns"):
        annotations.read_annotations(spark, str(tmp_path / "o.txt"), 0, "|").collect()
    (tmp_path / "empty.txt").write_text(head)
    assert protocols.TextAnnotations(spark, str(tmp_path / "empty.txt"), delimiter="|").read("rest").collect() == []


def test_folders(spark, tmp_path):
    for n in ("a/m1_x.edf", "a/m2_x.edf", "a/notes.md", "b/ann_m2.txt", "b/ann_m1.txt"):
        (tmp_path / n).parent.mkdir(exist_ok=True)
        (tmp_path / n).write_text("x")
    assert [r.path.rsplit("/", 1)[-1] for r in annotations.list_files(spark, str(tmp_path / "a"), "*.edf").collect()] == ["m1_x.edf", "m2_x.edf"]
    got = annotations.match_folders(spark, str(tmp_path / "a"), str(tmp_path / "b"), r"m\d", "*.edf").collect()
    assert sorted((r.path[-8:], r.other[-10:]) for r in got) == [("m1_x.edf", "ann_m1.txt"), ("m2_x.edf", "ann_m2.txt")]
    assert annotations.list_files(spark, str(tmp_path / "a"), "*.none").collect() == []


def test_annotations(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Experiment\tx\nOther\ty\nNumber\tStart Time\tEnd Time\tTime From Start\tChannel\tAnnotation\n0\t02/09/22 09:19:38.094000\t02/09/22 09:19:40.594000\t12.5\tEEG1\trest\n1\t02/09/22 09:20:00.000000\t02/09/22 09:20:01.000000\t34.0\tEEG2\texploring\n")
    got = annotations.read_annotations(spark, str(tmp_path / "a.txt"), start=2)
    assert sorted(map(tuple, got.collect())) == [("exploring", 34.0, 1.0, "EEG2"), ("rest", 12.5, 2.5, "EEG1")]
    assert annotations.read_annotations(spark, str(tmp_path / "a.txt"), 2, labels="rest").count() == 1
    a = spark.createDataFrame([("/d/m1_base.edf",), ("/d/m2_base.edf",)], "path string")
    b = spark.createDataFrame([("/e/ann_m2.txt",), ("/e/ann_m1.txt",)], "path string")
    assert sorted(map(tuple, annotations.match(a, b, r"m\d").collect())) == [("/d/m1_base.edf", "/e/ann_m1.txt"), ("/d/m2_base.edf", "/e/ann_m2.txt")]
    with pytest.raises(ValueError):
        annotations.match(a, b.limit(1), r"m\d")
    assert {r[0] for r in annotations.mismatched(a, b).collect()} == {"m1_base", "m2_base", "ann_m1", "ann_m2"}
    assert annotations.metadata(a, "path", mouse=r"(m\d)", none=r"(zz)").first().metadata == {"mouse": "m1"}
    (tmp_path / "old_1.edf").write_text("x")
    files = spark.createDataFrame([(str(tmp_path / "old_1.edf"),)], "path string")
    assert annotations.rename(spark, files, "old_", "new_") == 1 and (tmp_path / "new_1.edf").exists()


def test_pipeline(sig, x):
    p = Pipeline().append(algebra.add, other=1).append(shape.take_slice, start=0, stop=10)
    assert np.allclose(to_array(p(sig)), x[:, :10] + 1) and algebra.add in p and algebra.multiply not in p
    with pytest.raises(TypeError):
        p.append(algebra.add)
    assert not assignable((10**6, 10**6), limit=10**9) and assignable((10,), limit=10**9)
    assert allocate(3, 2) == 2 and pickleable(p) and not pickleable((i for i in []))


def test_streams(spark, sig, x, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(str(c), i, float(x[c, i])) for c in range(2) for i in range(400)]
    order = np.argsort(np.arange(800) % 400 + rng.uniform(0, 30, 800))
    for k, part in enumerate(np.array_split(order, 4)):
        spark.createDataFrame([rows[j] for j in part], "ch string, idx long, value double").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")

    def run(make, mode):
        s = spark.readStream.schema("ch string, idx long, value double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        name = f"t{rng.integers(10**9)}"
        q = make(s).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name).toPandas()

    h = rng.standard_normal(9)
    got = run(lambda s: stateful.stream_fir(s, h), "append").sort_values(["ch", "idx"])
    assert np.allclose(got["value"], np.concatenate([np.convolve(x[c, :400], h)[:400] for c in range(2)]))
    f = idn.notch(10, 1, 100.0)
    got = run(lambda s: stateful.stream_sos(s, f.sos), "append").sort_values(["ch", "idx"])
    assert np.allclose(got["value"], np.concatenate([brute_sos(f.sos, x[c, :400]) for c in range(2)]))
    got = run(lambda s: stateful.stream_psd(s, 100.0, 64), "update")
    last = got.sort_values("n_segments").groupby(["ch", "k"]).last()["psd"].to_numpy()
    assert np.allclose(last, np.concatenate([brute_welch(x[c, :400], 100.0, 64, 0.5, "hann", "constant", "density").mean(0) for c in range(2)]))
    z = run(lambda s: stateful.stream_stft(s, 100.0, 64), "append").sort_values(["ch", "seg", "k"])
    want = spectra.stft(Signal(shape.take_slice(shape.channels(sig, [0, 1]), 0, 400).df.withColumnRenamed("d0", "ch"), ("ch",), 100.0), nfft=64, boundary=False, padded=False).orderBy("ch", "seg", "k").toPandas()
    assert np.allclose(z["re"] + 1j * z["im"], want["re"] + 1j * want["im"]) and np.allclose(z["t"], want["t"])
    for up, down in ((3, 5), (1, 4), (5, 2), (2, 2)):
        got = run(lambda s, up=up, down=down: stateful.stream_resample(s, up, down, 100.0), "append")
        whole = to_array(filters.resample(shape.take_slice(sig, 0, 400), up, down))
        for c in range(2):
            y = got[got["ch"] == str(c)].sort_values("idx")
            assert y["idx"].tolist() == list(range(len(y))) and len(y) > 0.75 * whole.shape[1]
            assert np.allclose(y["value"], whole[c, : len(y)])
    with pytest.raises(Exception, match="wait for a missing one"):
        run(lambda s: stateful.stream_fir(s, h, limit=2), "append")
