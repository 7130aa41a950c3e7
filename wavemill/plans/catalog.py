"""Queries over the driver tables and their DuckDB counterparts.

Signals: `ev`: channels are event types, samples their values in the order of event_id (fs 100); `users`: channels are users, for
recurrences; `all`: one channel of all events (event_id is the rank by time). Results are rounded alike on both sides.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fir_design as fd
from ..functions import iir_design as idn
from ..operators import algebra, coupling, filters, responses, shape, spectra
from ..operators.pipeline import Pipeline
from ..operators.signal import BLOCK, Signal, from_chunks, from_function, from_rows, map_blocks
from ..sources import annotations as ann
from ..store import shared_path
from ..streaming import stateful
from . import closed_forms as cf

FS = 100.0


def events(spark, d):
    return spark.read.parquet(f"{d}/events.parquet")


def ev(spark, d) -> Signal:
    """event_id has no gaps over all events, so a bucket of it holds as many rows as it is wide at most."""
    return from_rows(events(spark, d).select(F.col("event_type").alias("ch"), "event_id", "value"), "ch", "event_id", "value", FS, BLOCK)


def users(spark, d) -> Signal:
    return from_rows(events(spark, d).select(F.col("user_id").alias("ch"), "event_id", "value"), "ch", "event_id", "value", FS, BLOCK)


def whole(spark, d) -> Signal:
    x = events(spark, d).select(F.lit(0).alias("ch"), "event_id", "value")
    first = x.agg(F.min("event_id")).first()[0]
    return Signal(x.select("ch", (F.col("event_id") - first).alias("idx"), F.col("value").cast("double").alias("value")), ("ch",), FS)


def emb(spark, d) -> Signal:
    x = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("ch"), F.lit(0).cast("long").alias("start"), F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    return from_chunks(x, ("ch",), FS)


def notes(spark, d) -> DataFrame:
    x = events(spark, d)
    first = x.agg(F.min("event_id")).first()[0]
    t = (F.col("event_id") - first).cast("double")
    return x.where("event_type = 'signup'").select(F.col("event_type").alias("label"), (t / FS).alias("time"), F.lit(0.5).alias("duration"), F.lit("ALL").alias("channel"))


def events_as_notes(spark, d) -> DataFrame:
    x = events(spark, d)
    first = x.agg(F.min("event_id")).first()[0]
    return x.select(F.col("event_type").alias("label"), ((F.col("event_id") - first).cast("double") / FS).alias("time"), F.lit(0.0).alias("duration"), F.lit("ALL").alias("channel"))


def by_label(spark, d) -> Signal:
    """The first component of each vector, channels by label; numbers in between are left out."""
    x = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("label").alias("ch"), F.col("vec_id").alias("idx"), F.col("embedding")[0].cast("double").alias("value"))
    return Signal(x, ("ch",), FS)


EV = "ev as (select event_type as ch, row_number() over (partition by event_type order by event_id) - 1 as idx, value::double as value from events)"
US = "ev as (select user_id as ch, row_number() over (partition by user_id order by event_id) - 1 as idx, value::double as value from events)"
ALL = "ev as (select 0 as ch, event_id - (select min(event_id) from events) as idx, value::double as value from events)"
EMB = "ev as (select vec_id as ch, unnest(range(0, len(embedding))) as idx, unnest(embedding)::double as value from embeddings)"
LEN = "len as (select ch, max(idx) + 1 as n from ev group by ch)"

_Q: dict[str, tuple] = {}


def query(name: str, sql: str | None):
    def keep(fn):
        _Q[name] = fn, sql
        return fn

    return keep


def _r(c: str = "value", digits: int = 4):
    return (F.round(c, digits) + 0.0).alias(c)


def long(sig: Signal, digits: int = 4) -> DataFrame:
    return sig.df.select("ch", F.col("idx").cast("long").alias("idx"), _r("value", digits))


def sql_long(ctes: str, body: str, digits: int = 4) -> str:
    return f"with {ctes} select ch, idx::bigint as idx, round(value, {digits}) + 0.0 as value from ({body})"


def rows(values) -> str:
    return ", ".join(f"({k}, {float(v)!r}::double)" for k, v in enumerate(values))


# selection, masks, shapes

for _name, _args in {"range_slice": (10, 60, 1), "strided_slice": (5, 95, 7)}.items():
    query(_name, sql_long(EV, f"select ch, (idx - {_args[0]}) // {_args[2]} as idx, value from ev where idx >= {_args[0]} and idx < {_args[1]} and (idx - {_args[0]}) % {_args[2]} = 0"))(lambda s, d, a=_args: long(shape.take_slice(ev(s, d), *a)))

query("signal_index", sql_long(EV, "select * from ev"))(lambda s, d: long(ev(s, d)))
query("negative_slice", sql_long(f"{EV}, {LEN}", "select ch, n - 1 - idx as idx, value from ev join len using (ch) where n - 1 - idx < 20"))(lambda s, d: long(shape.take_slice(ev(s, d), None, -21, -1)))
query("channel_project", sql_long(EV, "select * from ev where ch in ('click', 'purchase', 'signup')"))(lambda s, d: long(shape.channels(ev(s, d), ["click", "purchase", "signup"])))
query("reverse", sql_long(f"{EV}, {LEN}", "select ch, n - 1 - idx as idx, value from ev join len using (ch)"))(lambda s, d: long(shape.reverse(ev(s, d))))
query("ordered_union", sql_long(f"{EV}, {LEN}", "select * from ev union all select ch, n + idx, value from ev join len using (ch) where idx < 30"))(lambda s, d: long(shape.concatenate([ev(s, d), shape.take_slice(ev(s, d), 0, 30)])))
query("split", sql_long(EV, "select ch, idx - 40 as idx, value from ev where idx >= 40"))(lambda s, d: long(shape.split(ev(s, d), 40)[1]))
query("chunked_layout", f"with {EV} select ch, (idx // 64)::bigint as chunk, min(idx)::bigint as start, count(*)::int as n, round(sum(value), 4) as total from ev group by ch, idx // 64")(lambda s, d: ev(s, d).chunked(64).select("ch", "chunk", "start", "n", F.round(F.aggregate("x", F.lit(0.0), lambda a, b: a + b), 4).alias("total")))
query("array_layout", sql_long(EMB, "select * from ev"))(lambda s, d: long(emb(s, d)))

NOTES = f"{ALL}, notes as (select (event_id - (select min(event_id) from events)) / 100.0 as t, 0.5 as dur from events where event_type = 'signup'), hit as (select distinct idx from ev join notes on idx >= round_even(t * 100, 0) and idx < round_even((t + dur) * 100, 0))"
query("annotation_mask_include", sql_long(NOTES, "select ch, row_number() over (order by idx) - 1 as idx, value from ev where idx in (select idx from hit)"))(lambda s, d: long(shape.mask_by_annotations(whole(s, d), notes(s, d))))
query("annotation_mask_exclude", sql_long(NOTES, "select ch, row_number() over (order by idx) - 1 as idx, value from ev where idx not in (select idx from hit)"))(lambda s, d: long(shape.mask_by_annotations(whole(s, d), notes(s, d), False)))
SIZE = "size as (select max(idx) + 1 as n from ev)"


def size(sig: Signal) -> int:
    """Samples of the longest channel."""
    return (sig.df.agg(F.max("idx") + 1).first()[0]) or 0


def masked(sig: Signal) -> Signal:
    return shape.apply_mask(sig, shape.index_mask(sig.df.sparkSession, size(sig), slice(0, None, 3)))


query("annotation_mask_dense", f"with {NOTES}, {SIZE} select idx::bigint as idx, idx in (select idx from hit) as keep from (select unnest(range(0, n)) as idx from size)")(lambda s, d: shape.as_mask(s, notes(s, d), size(whole(s, d)), FS))
query("index_set_mask", f"with {EV}, {SIZE} select r as idx, (r < 50 and r % 3 = 0) or r in (77, 80, 81) or r >= n - 10 as keep from (select n, unnest(range(0, n)) as r from size)")(lambda s, d: shape.index_mask(s, size(ev(s, d)), [slice(0, 50, 3), [77, 80, 81], slice(-10, None)]))
query("mask_filter_reindex", sql_long(EV, "select ch, row_number() over (partition by ch order by idx) - 1 as idx, value from ev where idx % 3 = 0"))(lambda s, d: long(masked(ev(s, d))))
query("count_true", f"with {EV}, {SIZE} select count(*)::bigint as n_true from (select unnest(range(0, n)) as r from size) where r % 7 = 2")(lambda s, d: algebra.count_true(shape.index_mask(s, size(ev(s, d)), slice(2, None, 7))))
query("label_predicate", "select event_type as label, (event_id - (select min(event_id) from events)) / 100.0::double as time from events where event_type in ('signup', 'click')")(lambda s, d: ann.labelled(events_as_notes(s, d), ["signup", "click"]).select("label", "time"))
query("interval_seconds", "select event_id, 90061.5::double as seconds from events")(lambda s, d: events(s, d).select("event_id", ann.seconds_between(F.date_format("ts", ann.STAMPS[0]), F.date_format(F.col("ts") + F.expr("interval 1 day 1 hour 1 minute 1 second 500 milliseconds"), ann.STAMPS[0])).alias("seconds")))
query("pad_channels", sql_long("ev as (select label as ch, vec_id as idx, embedding[1]::double as value from embeddings)", "select ch + 1 as ch, idx, value from ev union all select unnest([0, 11]) as ch, idx, 2.5 from ev where ch = 0"))(lambda s, d: long(shape.pad(by_label(s, d), (1, 1), 2.5, axis="ch")))
query("pad_const", sql_long(f"{EV}, {LEN}", "select ch, idx + 3 as idx, value from ev union all select ch, i, 1.5 from len, (select unnest([0, 1, 2]) as i) union all select ch, n + 3 + i, 1.5 from len, (select unnest([0, 1]) as i)"))(lambda s, d: long(shape.pad(ev(s, d), (3, 2), 1.5)))

_FIRST = f"{EV}, {LEN}, e as (select ch, n, min_by(value, idx) as f, max_by(value, idx) as l from ev join len using (ch) group by ch, n)"
query("edge_extend", sql_long(_FIRST, "select ch, idx + 4 as idx, value from ev union all select ch, i, f from e, (select unnest(range(0, 4)) as i) union all select ch, n + 4 + i, l from e, (select unnest(range(0, 4)) as i)"))(lambda s, d: long(shape.extend(ev(s, d), 4, "edge")))
for _how, (_a, _b) in {"even": ("value", "value"), "odd": ("2 * f - value", "2 * l - value")}.items():
    query(f"{_how}_extend", sql_long(_FIRST, f"select ch, idx + 5 as idx, value from ev union all select ch, 5 - idx, {_a} from ev join e using (ch) where idx between 1 and 5 union all select ch, 2 * (n - 1) - idx + 5, {_b} from ev join e using (ch) where idx between n - 6 and n - 2"))(lambda s, d, h=_how: long(shape.extend(ev(s, d), 5, h)))
query("zero_extend", sql_long(f"{EV}, {LEN}", "select ch, idx + 2 as idx, value from ev union all select ch, i, 0.0 from len, (select unnest([0, 1]) as i) union all select ch, n + 2 + i, 0.0 from len, (select unnest([0, 1]) as i)"))(lambda s, d: long(shape.extend(ev(s, d), 2, "zero")))
query("zero_stuff", sql_long(EV, "select ch, idx * 3 + i as idx, case when i = 0 then value else 0 end as value from ev, (select unnest([0, 1, 2]) as i)"))(lambda s, d: long(shape.zero_stuff(ev(s, d), 3)))
query("expand_squeeze", sql_long(EV, "select * from ev"))(lambda s, d: long(shape.squeeze(shape.expand_dims(ev(s, d), "rec"), "rec")))

# algebra and statistics

query("add_scalar", sql_long(EV, "select ch, idx, value + 2.5 as value from ev"))(lambda s, d: long(algebra.add(ev(s, d), 2.5)))
query("add_signals", sql_long(f"{EV}, {LEN}", "select a.ch, a.idx, a.value + b.value as value from ev a join len using (ch) join ev b on b.ch = a.ch and b.idx = n - 1 - a.idx"))(lambda s, d: long(algebra.add(ev(s, d), shape.reverse(ev(s, d)))))
query("multiply_signals", sql_long(EV, "select ch, idx, value * value as value from ev", 2))(lambda s, d: long(algebra.multiply(ev(s, d), ev(s, d)), 2))
query("complex_multiply", f"with {EV} select ch, idx::bigint as idx, round(value * 1.5, 4) + 0.0 as re, round(value * 9, 4) + 0.0 as im from ev")(lambda s, d: algebra.multiply(ev(s, d), 3 * (0.5 + 3j)).df.select("ch", "idx", _r("re"), _r("im")))
query("multiply_along_axis", sql_long(EMB, "select ch, idx, value * (idx + 1) as value from ev"))(lambda s, d: long(algebra.multiply_along(emb(s, d), range(1, 65))))
query("mean_time", f"with {EV} select ch, round(avg(value), 4) as mean from ev group by ch")(lambda s, d: algebra.mean(ev(s, d)).select("ch", _r("mean")))
query("mean_channel", f"with {EMB} select idx::bigint as idx, round(avg(value), 4) + 0.0 as mean from ev group by idx")(lambda s, d: algebra.mean(emb(s, d), over="ch").select(F.col("idx").cast("long").alias("idx"), _r("mean")))
query("std_pop", f"with {EV} select ch, round(stddev_pop(value), 4) as std from ev group by ch")(lambda s, d: algebra.std(ev(s, d)).select("ch", _r("std")))
query("standardize", sql_long(EV, "select ch, idx, (value - avg(value) over (partition by ch)) / stddev_pop(value) over (partition by ch) as value from ev"))(lambda s, d: long(algebra.standardize(ev(s, d))))
query("nearest_index", f"with {ALL} select arg_min(idx, (abs(value - 50.0), idx))::bigint as idx from ev")(lambda s, d: algebra.nearest(whole(s, d).df, "value", 50.0))
query("extrema", f"with {EV} select ch, min(value) as low, max(value) as high from ev group by ch")(lambda s, d: algebra.extrema(ev(s, d)))

TILT = [0.5 * k - 3 for k in range(64)]
query("add_broadcast", sql_long(EMB, "select ch, idx, value + 0.5 * idx - 3 as value from ev"))(lambda s, d: long(algebra.add(emb(s, d), TILT)))
query("multiply_broadcast", sql_long(EMB, "select ch, idx, value * (0.5 * idx - 3) as value from ev"))(lambda s, d: long(algebra.multiply(emb(s, d), np.array([TILT]))))
query("standardize_channels", sql_long(EMB, "select ch, idx, (value - avg(value) over (partition by idx)) / stddev_pop(value) over (partition by idx) as value from ev"))(lambda s, d: long(algebra.standardize(emb(s, d), over="ch")))
query("generated", "select k::int as ch, i::bigint as idx, round(sin(i / 7.0) * (k + 1), 4) + 0.0 as value from (select unnest(range(0, 2)) as k), (select unnest(range(0, (select 9 * count(*) from nation))) as i)")(lambda s, d: long(_named(from_function(s, lambda k: np.outer([1, 2], np.sin(np.arange(9 * k, 9 * k + 9) / 7)), s.read.parquet(f"{d}/nation.parquet").count()))))
query("user_function", sql_long(f"{EV}, {LEN}", "select ch, idx, avg(value) over (partition by ch order by idx rows between 2 preceding and 2 following) as value from ev"))(lambda s, d: long(map_blocks(ev(s, d), _moving, halo=2)))


def _named(sig: Signal) -> Signal:
    return Signal(sig.df.withColumnRenamed("d0", "ch"), ("ch",), sig.fs)


def _moving(block: int, idx: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Means of five neighbours, or as many as there are."""
    c = np.concatenate(([0.0], np.cumsum(x)))
    at = np.arange(len(x))
    lo, hi = np.maximum(at - 2, 0), np.minimum(at + 3, len(x))
    return ((c[hi] - c[lo]) / (hi - lo))[(idx >= block * 65_536) & (idx < (block + 1) * 65_536)]


# FIR filters: the taps are made in SQL


def conv_sql(taps: str, out: str, mode: str = "same", source: str = "ev") -> str:
    """Table `out` (ch, idx, value): `source` convolved with the table `taps` (k, h). Needs len."""
    n = f"(select count(*) from {taps})"
    shift = {"full": "0", "same": f"({n} - 1) // 2", "valid": f"({n} - 1)"}[mode]
    cut = {"full": "true", "same": "idx >= 0 and idx < n", "valid": f"idx >= 0 and idx <= n - {n}"}[mode]
    return f"{out} as (select y.ch, y.idx, y.value from (select ch, idx + k - {shift} as idx, sum(value * h) as value from {source}, {taps} group by 1, 2) y join len using (ch) where {cut})"


def fir_sql(taps: str, mode: str = "same") -> str:
    """taps: a table's definition."""
    return sql_long(f"{EV}, {LEN}, {taps}, {conv_sql('taps', 'y', mode)}", "select * from y", 3)


SHORT = np.array([0.103717213, -0.251923711, 0.503192713, 0.754719317, -0.301931179])
for _mode in ("full", "same", "valid"):
    query(f"fir_{_mode}", fir_sql(f"taps(k, h) as (values {rows(SHORT)})", _mode))(lambda s, d, m=_mode: long(filters.convolve(ev(s, d), SHORT, m), 3))
DESIGNS = {
    "fir_kaiser_lowpass": (fd.kaiser, "kaiser", 10, 16),
    "fir_kaiser_bandpass": (fd.kaiser, "kaiser", (10, 20), (4, 26)),
    "fir_rect": (fd.rectangular, "boxcar", 10, 16),
    "fir_bartlett": (fd.bartlett, "bartlett", 10, 20),
    "fir_hann": (fd.hann, "hann", 20, 10),
    "fir_hamming": (fd.hamming, "hamming", (15, 25), (5, 35)),
    "fir_blackman": (fd.blackman, "blackman", (5, 35), (15, 25)),
}
for _name, (_make, _win, _p, _s) in DESIGNS.items():
    query(_name, fir_sql(cf.fir_taps_sql(_win, _p, _s, FS)))(lambda s, d, f=_make, p=_p, q=_s: long(filters.fir(ev(s, d), f(p, q, FS)), 3))
_REMEZ = ([0, 10, 16, 50], [1, 0], FS)  # an exchange, which has no closed form: the SQL has its taps as they are
query("fir_remez", fir_sql(f"taps(k, h) as (values {rows(fd.remez(*_REMEZ).coeffs)})"))(lambda s, d: long(filters.fir(ev(s, d), fd.remez(*_REMEZ)), 3))
query("hilbert_imag", fir_sql(cf.hilbert_taps_sql(8, FS)))(lambda s, d: long(filters.fir(ev(s, d), fd.hilbert(8, FS)), 3))


def analytic_sql(source: str = "ev", out: str = "z", width: float = 8) -> str:
    """Tables up to `out` (ch, idx, re, im)."""
    return f"{cf.hilbert_taps_sql(width, FS, name=f'{out}_taps')}, {conv_sql(f'{out}_taps', f'{out}_im', source=source)}, {out} as (select a.ch, a.idx, a.value as re, b.value as im from {source} a join {out}_im b on a.ch = b.ch and a.idx = b.idx)"


_PHASE = "case when atan2(im, re) < 0 then atan2(im, re) + 2 * pi() else atan2(im, re) end"
_Z = f"{EV}, {LEN}, {analytic_sql()}"
query("analytic_amplitude", sql_long(_Z, "select ch, idx, sqrt(re * re + im * im) as value from z", 3))(lambda s, d: long(filters.amplitude(filters.analytic(ev(s, d), 8)), 3))
query("analytic_phase", sql_long(_Z, f"select ch, idx, {_PHASE} as value from z"))(lambda s, d: long(filters.phase(filters.analytic(ev(s, d), 8))))
query("phase_unwrap", sql_long(f"{_Z}, p as (select ch, idx, {_PHASE} as value from z), t as (select *, coalesce(round_even((value - lag(value) over (partition by ch order by idx)) / (2 * pi()), 0), 0) as turns from p)", "select ch, idx, value - 2 * pi() * sum(turns) over (partition by ch order by idx) as value from t"))(lambda s, d: long(responses.unwrapped(filters.phase(filters.analytic(ev(s, d), 8)), block=512)))
_H = f"{cf.fir_taps_sql('kaiser', 10, 16, FS)}, f as (select j, j * {FS / 2 / 200!r}::double as freq from (select unnest(range(0, 200)) as j)), h as (select freq, j, sum(h * cos(2 * pi() * freq * k / {FS})) as re, -sum(h * sin(2 * pi() * freq * k / {FS})) as im from f, taps group by freq, j), a as (select *, sqrt(re * re + im * im) as gain, atan2(im, re) as p from h), t as (select *, coalesce(round_even((p - lag(p) over (order by j)) / (2 * pi()), 0), 0) as turns from a)"
query("fir_response", f"with {_H} select round(freq, 6) as freq, round(gain, 6) + 0.0 as gain, round(greatest(-60, 20 * log10(gain)), 3) + 0.0 as db, round(p - 2 * pi() * sum(turns) over (order by j), 4) + 0.0 as phase from t where gain > 0.02 or j < 80")(lambda s, d: responses.response(s, fd.kaiser(10, 16, FS), 200, -60.0).where(f"gain > 0.02 or freq < {80 * FS / 400}").select(F.round("freq", 6).alias("freq"), _r("gain", 6), _r("db", 3), _r("phase")))

# IIR filters: recursive oracles by sample


def iir_sql(sos, both=False) -> str:
    """A cascade by recursion over the samples, the state in transposed direct form II; zero-phase with steady-state starts."""
    parts, src = [US, LEN], "ev"
    zi = cf.steady(sos) if both else [(0.0, 0.0)] * len(sos)
    for turn in range(2 if both else 1):
        parts.append(f"x{turn} as (select ch, " + ("idx" if not turn else "n - 1 - idx as idx") + f", value from {src}" + (" join len using (ch)" if turn else "") + ")")
        src = f"x{turn}"
        head, cols, step, prev = [], [], [], "x.value"
        first = "x.value"
        for k, (b0, b1, b2, _, a1, a2) in enumerate(np.asarray(sos).tolist()):
            z1, z2 = (f"({zi[k][i]!r}::double * {first})" for i in (0, 1))
            y0 = f"({b0!r}::double * {{p}} + {z1})"
            head.append((y0, z1, z2, b1, b2, a1, a2))
            cols += [f"p{k}", f"q{k}"]
            step.append((b0, b1, b2, a1, a2))
        p, init = first, []
        for y0, z1, z2, b1, b2, a1, a2 in head:
            y = y0.format(p=p)
            init += [f"{b1!r} * {p} - {a1!r} * {y} + {z2}", f"{b2!r} * {p} - {a2!r} * {y}"]
            p = y
        start = f"select ch, idx, {p} as y, " + ", ".join(f"{e} as {c}" for e, c in zip(init, cols, strict=True)) + f" from {src} x where idx = 0"
        p, upd = prev, []
        for k, (b0, b1, b2, a1, a2) in enumerate(step):
            y = f"({b0!r}::double * {p} + r.p{k})"
            upd += [f"{b1!r} * {p} - {a1!r} * {y} + r.q{k}", f"{b2!r} * {p} - {a2!r} * {y}"]
            p = y
        parts.append(f"r{turn}(ch, idx, y, {', '.join(cols)}) as ({start} union all select x.ch, x.idx, {p}, {', '.join(upd)} from r{turn} r join {src} x on x.ch = r.ch and x.idx = r.idx + 1)")
        parts.append(f"o{turn} as (select ch, idx, y as value from r{turn})")
        src = f"o{turn}"
    body = f"select ch, idx, value from {src}" if not both else f"select ch, n - 1 - idx as idx, value from {src} join len using (ch)"
    return sql_long(", ".join(parts), body, 3).replace("with ", "with recursive ", 1)


# Of elliptic filters the SQL has the sections as they are; of all others it has those of closed forms.
IIRS = {
    "notch": (lambda: idn.notch(20, 4, FS), lambda: cf.notch_sections(20, 4, FS)),
    "butter": (lambda: idn.butter(20, 35, FS, 1, 15), lambda: cf.lowpass_sections("butter", 20, 35, FS, 1, 15)),
    "cheby1": (lambda: idn.cheby1(20, 35, FS, 1, 20), lambda: cf.lowpass_sections("cheby1", 20, 35, FS, 1, 20)),
    "cheby2": (lambda: idn.cheby2(20, 35, FS, 1, 20), lambda: cf.lowpass_sections("cheby2", 20, 35, FS, 1, 20)),
    "ellip": (lambda: idn.ellip(20, 30, FS, 1, 20), lambda: idn.ellip(20, 30, FS, 1, 20).sos.tolist()),
}
for _name, (_make, _closed) in IIRS.items():
    query(f"{_name}_forward", iir_sql(_closed()))(lambda s, d, f=_make: long(filters.iir(users(s, d), f(), dephase=False), 3))
    query(f"{_name}_zero_phase", iir_sql(_closed(), True))(lambda s, d, f=_make: long(filters.iir(users(s, d), f()), 3))
query("ba_forward", iir_sql(cf.notch_sections(20, 4, FS)))(lambda s, d: long(filters.iir(users(s, d), idn.notch(20, 4, FS), dephase=False, form="ba"), 3))
query("ba_zero_phase", iir_sql(cf.lowpass_sections("cheby1", 20, 35, FS, 1, 20), True))(lambda s, d: long(filters.iir(users(s, d), idn.cheby1(20, 35, FS, 1, 20), form="ba"), 3))

# resampling


def resample_sql(up, down, win: str = "kaiser") -> str:
    cut = FS / (2 * max(up, down))
    half = "((select count(*) from taps) - 1) // 2"
    return sql_long(f"{EV}, {LEN}, {cf.fir_taps_sql(win, 0.9 * cut, 1.1 * cut, FS, 0.1, 40)}, x as (select ch, idx * {up} + k - {half} as pos, n, value * h as v from ev join len using (ch), taps)", f"select ch, pos // {down} as idx, sum(v) * {up} as value from x where pos >= 0 and pos % {down} = 0 and pos < n * {up} group by 1, 2", 3)


query("downsample_own_fir", resample_sql(1, 4, "hamming"))(lambda s, d: long(filters.resample(ev(s, d), 1, 4, fir=lambda p, q, fs, gpass, gstop: fd.hamming(p, q, fs)), 3))
for _name, _f in {"downsample": (1, 4), "upsample": (3, 1), "resample_rational": (3, 5)}.items():
    query(_name, resample_sql(*_f))(lambda s, d, f=_f: long(filters.resample(ev(s, d), *f), 3))

# spectra


def segments_sql(nfft, overlap, win="hann", detrend="constant", scaling="density", source=EV, pad=0) -> str:
    """Tables w, seg (ch, seg, j, v: tapered) and f (ch, seg, k, re, im), scaled."""
    stride = nfft - int(nfft * overlap)
    norm = f"(select 1 / ({FS} * sum(w * w)) from w)" if scaling == "density" else "(select 1 / pow(sum(w), 2) from w)"
    flat = "v - avg(v) over s" if detrend == "constant" else "v - (regr_intercept(v, j) over s + regr_slope(v, j) over s * j)"
    return f"""{source}, {LEN}, w as (select j, {cf.window_sql(win, "j", f"{nfft}.0")} as w from (select unnest(range(0, {nfft})) as j)),
raw as (select ch, s as seg, j, coalesce(ev.value, 0) as v, w from (select ch, n, unnest(range(0, (n + {2 * pad} - {nfft}) // {stride} + 1)) as s from len where n + {2 * pad} >= {nfft}) x cross join w left join ev using (ch) where ev.idx = s * {stride} + j - {pad}),
seg as (select ch, seg, j, ({flat}) * w as v from raw window s as (partition by ch, seg)),
f as (select ch, seg, k, sqrt({norm}) * sum(v * cos(2 * pi() * k * j / {nfft})) as re, -sqrt({norm}) * sum(v * sin(2 * pi() * k * j / {nfft})) as im from seg, (select unnest(range(0, {nfft // 2 + 1})) as k) group by ch, seg, k),
p as (select ch, seg, k, (re * re + im * im) * case when k = 0 or 2 * k = {nfft} then 1 else 2 end as p from f)"""


def psd_sql(nfft, overlap=0.5, digits=3, **kw) -> str:
    return f"with {segments_sql(nfft, overlap, **kw)} select ch, k::int as k, k * {FS / nfft!r}::double as freq, round(avg(p), {digits}) + 0.0 as psd, count(*)::bigint as n_segments from p group by ch, k"


def _psd(x: DataFrame, digits=3) -> DataFrame:
    return x.select("ch", "k", "freq", _r("psd", digits), "n_segments")


query("welch_psd", psd_sql(64))(lambda s, d: _psd(spectra.psd(ev(s, d), nfft=64)))
query("welch_linear_detrend", psd_sql(32, detrend="linear"))(lambda s, d: _psd(spectra.psd(ev(s, d), nfft=32, detrend="linear")))
query("psd_spectrum_scaling", psd_sql(50, 0.3, scaling="spectrum", win="blackman"))(lambda s, d: _psd(spectra.psd(ev(s, d), nfft=50, overlap=0.3, scaling="spectrum", win="blackman")))
query("periodogram", f"with {segments_sql(32, 0.5)} select ch, seg::bigint as seg, k::int as k, k * {FS / 32!r}::double as freq, round(p, 3) + 0.0 as p from p")(lambda s, d: spectra.periodograms(ev(s, d), 32).select("ch", "seg", "k", "freq", _r("p", 3)))
_STFT = segments_sql(32, 0.5)
query("stft", f"with {_STFT} select ch, seg::bigint as seg, (16 + seg * 16) / 100.0::double as t, k::int as k, k * {FS / 32!r}::double as freq, round(re, 3) + 0.0 as re, round(im, 3) + 0.0 as im from f")(lambda s, d: spectra.stft(ev(s, d), nfft=32, boundary=False, padded=False).select("ch", "seg", "t", "k", "freq", _r("re", 3), _r("im", 3)))
_PADDED = f"{EV}, {LEN}, pad as (select ch, n + 32 + case when (n + 32) % 16 <> 0 then 16 else 0 end as n, n as n0 from len), w as (select j, {cf.window_sql('hann', 'j', '32.0')} as w from (select unnest(range(0, 32)) as j)), cells as (select ch, s as seg, j, w from (select ch, unnest(range(0, (n - 32) // 16 + 1)) as s from pad) x cross join w), raw as (select cells.ch, seg, j, coalesce(ev.value, 0) as v, w from cells left join ev on ev.ch = cells.ch and ev.idx = seg * 16 + j - 16), seg as (select ch, seg, j, (v - avg(v) over s) * w as v from raw window s as (partition by ch, seg)), norm as (select sqrt(1 / ({FS} * sum(w * w))) as a from w)"
query("stft_padded", f"with {_PADDED} select ch, seg::bigint as seg, seg * 16 / 100.0::double as t, k::int as k, round(any_value(a) * sum(v * cos(2 * pi() * k * j / 32)), 3) + 0.0 as re, round(-any_value(a) * sum(v * sin(2 * pi() * k * j / 32)), 3) + 0.0 as im from seg, norm, (select unnest(range(0, 17)) as k) group by ch, seg, k")(lambda s, d: spectra.stft(ev(s, d), nfft=32).select("ch", "seg", "t", "k", _r("re", 3), _r("im", 3)))
query("spectrogram_db", f"with {_STFT} select ch, seg::bigint as seg, k::int as k, round(10 * log10(re * re + im * im + 1), 4) + 0.0 as db from f")(lambda s, d: spectra.spectrogram_db(spectra.stft(ev(s, d), nfft=32, boundary=False, padded=False)).select("ch", "seg", "k", _r("db")))
_W = [w * FS / 64 for w in cf.SIMPSON_14]  # bins 3 .. 16
_BAND = f"{segments_sql(64, 0.5)}, psd as (select ch, k, avg(p) as psd from p group by ch, k), bw(i, bw) as (values {rows(_W)}), pw as (select ch, sum(psd * bw) as power from psd join bw on k = i + 3 group by ch)"
query("band_power_simpson", f"with {_BAND} select ch, round(power, 3) as power from pw")(lambda s, d: spectra.power(spectra.psd(ev(s, d), nfft=64), ["ch"], 5, 25).select("ch", _r("power", 3)))
query("power_norm", f"with {_BAND} select ch, k::int as k, round(psd / power, 6) + 0.0 as psd from psd join pw using (ch)")(lambda s, d: spectra.power_norm(spectra.psd(ev(s, d), nfft=64), ["ch"], 5, 25).select("ch", "k", _r("psd", 6)))
query("psd_confidence_interval", f"with {_BAND} select ch, k::int as k, round(psd * 10 / 20.483177350807388, 3) + 0.0 as ci_low, round(psd * 10 / 3.2469727802368404, 3) + 0.0 as ci_high from psd")(lambda s, d: spectra.confidence_interval(spectra.psd(ev(s, d), nfft=64), 10).select("ch", "k", _r("ci_low", 3), _r("ci_high", 3)))

_GRID = f"g as (select distinct k * {FS / 32!r}::double as freq, (16 + seg * 16) / 100.0::double as t from f), e as (select arg_min(freq, (abs(freq - 10), freq)) as f0, arg_min(freq, (abs(freq - 30), freq)) as f1, arg_min(t, (abs(t - 0.5), t)) as t0, arg_min(t, (abs(t - 9), t)) as t1 from g)"
query("spectrogram_slice", f"with {_STFT}, {_GRID} select ch, seg::bigint as seg, k::int as k, round(10 * log10(re * re + im * im + 1), 4) + 0.0 as db from f, e where k * {FS / 32!r} between f0 and f1 and (16 + seg * 16) / 100.0::double >= t0 and (16 + seg * 16) / 100.0::double < t1")(lambda s, d: spectra.spectrogram_db(spectra.stft(ev(s, d), nfft=32, boundary=False, padded=False), (10, 30), (0.5, 9)).select("ch", "seg", "k", _r("db")))
query("banded_psd", f"with {_BAND}, b(band, lo, hi) as (values ('low', 4, 12), ('mid', 10, 30)) select ch, band, k::int as k, round(psd, 3) + 0.0 as psd from psd join b on k * {FS / 64!r} between lo and hi")(lambda s, d: spectra.banded(spectra.psd(ev(s, d), nfft=64), {"low": (4, 12), "mid": (10, 30)}).select("ch", "band", "k", _r("psd", 3)))

# coupling


def _spikes(s, d):
    """Clicks of more than 50."""
    return shape.channels(ev(s, d), ["click"]).df.where("value > 50").select("ch", "idx")


def bands_sql(name: str, fpass, fstop, source: str = "ev") -> str:
    return f"{cf.fir_taps_sql('kaiser', fpass, fstop, FS, name=f'{name}_taps')}, {conv_sql(f'{name}_taps', name, source=source)}"


_EVENTS = f"{EV}, {LEN}, {bands_sql('slow', (8, 14), (4, 18))}, {analytic_sql('slow', 'sz', 4)}, hits as (select ch, idx from (select ch, idx, {_PHASE} as p from sz) where p > 1.2 and p < 1.6)"


def lock(**more) -> coupling.PhaseLock:
    return coupling.PhaseLock((8, 14), (4, 18), 1.4, 0.2, 4.0, **more)


query("phase_event_index", f"with {_EVENTS} select ch, idx::bigint as idx from hits")(lambda s, d: lock().events(ev(s, d)).select("ch", F.col("idx").cast("long").alias("idx")))
_LOCK = {"bandwidth": 12.0, "window_s": 0.16, "surrogates": 5, "seed": 3}


def locking_sql(at: str = "hits") -> str:
    """Power around the events of each channel in the band 24 .. 36, and what phase_locking makes of it."""
    shifts = np.random.default_rng(3).random(5)
    sh = ", ".join(f"({i}, {float(v)!r}::double)" for i, v in enumerate(shifts))
    around = "(select unnest(range(-8, 8)) as o)"
    near = "idx >= 8 and idx + 8 <= n"
    return f"""{_EVENTS}, {bands_sql('fast', (24, 36), (18, 42))},
std as (select ch, idx, (value - avg(value) over (partition by ch)) / stddev_pop(value) over (partition by ch) as value from fast),
{analytic_sql('std', 'fz', 4)}, sh(surrogate, s) as (values {sh}),
amp as (select ch, idx, re * re + im * im as p from fz),
moved as (select ch, n, surrogate, (idx + floor(s * n)::bigint) % n as idx from {at} join len using (ch), sh),
own as (select e.ch, o, avg(p) as power from (select * from {at} join len using (ch) where {near}) e, {around} join amp on amp.ch = e.ch and amp.idx = e.idx + o group by e.ch, o),
null_ as (select ch, o, avg(power) as m, stddev_pop(power) as sd from (select e.ch, surrogate, o, avg(p) as power from (select * from moved where {near}) e, {around} join amp on amp.ch = e.ch and amp.idx = e.idx + o group by e.ch, surrogate, o) group by ch, o),
zs as (select own.ch, own.o, power, (power - m) / (sd / sqrt(5.0)) as z from own join null_ on own.ch = null_.ch and own.o = null_.o),
ps as (select *, {cf.normal_tail_sql('z')} as p from zs),
ranked as (select *, count(*) over (partition by ch) as m, count(*) over (partition by ch order by p range between unbounded preceding and current row) as r from ps)"""


query("phase_locking", f"with {locking_sql()} select ch, 30.0::double as center, o::bigint as \"offset\", round(power, 4) + 0.0 as power, round(p, 4) + 0.0 as pvalue, round(least(1.0, min(p * m / r) over (partition by ch order by p desc range between unbounded preceding and current row)), 4) + 0.0 as adjusted from ranked")(lambda s, d: lock(**_LOCK).estimate(ev(s, d), [30]).select("ch", "center", F.col("offset").cast("long").alias("offset"), _r("power"), _r("pvalue"), _r("adjusted")))
query("phase_locked_power", f"with {EV}, {LEN}, e as (select ch, idx from ev join len using (ch) where ch = 'click' and value > 50 and idx >= 8 and idx + 8 <= n) select ev.ch, o::bigint as \"offset\", round(avg(value * value), 3) as power from e, (select unnest(range(-8, 8)) as o) join ev on ev.ch = e.ch and ev.idx = e.idx + o group by ev.ch, o")(lambda s, d: coupling.locked_power(ev(s, d), _spikes(s, d), 16).select("ch", F.col("offset").cast("long").alias("offset"), _r("power", 3)))
_SHIFTS = ", ".join(f"({i}, {float(v)!r}::double)" for i, v in enumerate(np.random.default_rng(3).random(5)))
query("surrogate_shifts", f"with {EV}, {LEN}, sh(surrogate, s) as (values {_SHIFTS}) select ch, surrogate::int as surrogate, ((idx + floor(s * n)::bigint) % n)::bigint as idx from ev join len using (ch), sh where ch = 'click' and value > 50")(lambda s, d: coupling.shuffled(_spikes(s, d), 5, ev(s, d).lengths("n"), 3).select("ch", "surrogate", F.col("idx").cast("long").alias("idx")))
query("fdr_bh", "with t as (select event_type as g, event_id, (value - floor(value)) as p from events), r as (select *, count(*) over (partition by g) as m, count(*) over (partition by g order by p range between unbounded preceding and current row) as k from t) select g, event_id, round(least(1.0, min(p * m / k) over (partition by g order by p desc range between unbounded preceding and current row)), 6) + 0.0 as adjusted from r")(lambda s, d: coupling.fdr(events(s, d).select(F.col("event_type").alias("g"), "event_id", (F.col("value") - F.floor("value")).alias("pvalue")), ["g"]).select("g", "event_id", _r("adjusted", 6)))

# file names, windows on event time


def _pages(s, d):
    return s.read.parquet(f"{d}/pages.parquet").select(F.col("url").alias("path"))


query("regex_metadata", "select url as path, nullif(regexp_extract(url, '://([^/]+)', 1), '') as host, nullif(regexp_extract(url, '([0-9]+)', 1), '') as number from pages")(lambda s, d: ann.metadata(_pages(s, d), "path", host="://([^/]+)", number="([0-9]+)").select("path", F.col("metadata")["host"].alias("host"), F.col("metadata")["number"].alias("number")))
query("stem_symmetric_difference", "with t as (select regexp_extract(url, '([^/]+?)(\\.[^./]*)?$', 1) as stem, url from pages), a as (select distinct stem from t where contains(url, '1')), b as (select distinct stem from t where contains(url, '2')) select * from (select * from a except select * from b) union all select * from (select * from b except select * from a)")(lambda s, d: ann.mismatched(_pages(s, d).where(F.contains("path", F.lit("1"))), _pages(s, d).where(F.contains("path", F.lit("2")))))
query("rename_plan", "select url as path, replace(url, 'http', 'file') as renamed from pages where contains(url, 'http')")(lambda s, d: ann.rename_plan(_pages(s, d), "http", "file"))
query("regex_match_join", "select 'rec_' || r || '_base.edf' as path, 'note_' || r || '.txt' as other from (select lpad(n_nationkey::varchar, 3, '0') as r from nation)")(lambda s, d: ann.match(*(s.read.parquet(f"{d}/nation.parquet").select(F.concat(F.lit(a), F.lpad(F.col("n_nationkey").cast("string"), 3, "0"), F.lit(b)).alias("path")) for a, b in (("rec_", "_base.edf"), ("note_", ".txt"))), r"\d{3}"))


def _stamps(x: DataFrame) -> DataFrame:
    return x.select(*[F.unix_micros(c).alias(c) if c in ("start", "stop") else (_r(c, 3) if c == "total" else F.col(c)) for c in x.columns])


query("tumbling_window", "select epoch_us(date_trunc('day', ts)) as start, epoch_us(date_trunc('day', ts)) + 86400000000 as stop, event_type, count(*)::bigint as n, round(sum(value), 3) + 0.0 as total from events group by date_trunc('day', ts), event_type")(lambda s, d: _stamps(stateful.event_windows(events(s, d), "1 day")))
query("sliding_window", "with w as (select epoch_us(date_trunc('day', ts)) - o * 86400000000 as start, event_type, value from events, (select unnest([0, 1]) as o)) select start::bigint as start, (start + 2 * 86400000000)::bigint as stop, event_type, count(*)::bigint as n, round(sum(value), 3) + 0.0 as total from w group by start, event_type")(lambda s, d: _stamps(stateful.event_windows(events(s, d), "2 days", "1 day")))
query("session_window", "with a as (select user_id, epoch_us(ts) as t, value, lag(epoch_us(ts)) over (partition by user_id order by ts) as b from events), g as (select *, sum(case when b is null or t - b >= 21600000000 then 1 else 0 end) over (partition by user_id order by t) as g from a) select min(t)::bigint as start, (max(t) + 21600000000)::bigint as stop, user_id, count(*)::bigint as n, round(sum(value), 3) + 0.0 as total from g group by user_id, g")(lambda s, d: _stamps(stateful.event_sessions(events(s, d), "6 hours")))


_FILTERED = f"{EV.replace('ev as', 'src as')}, len as (select ch, max(idx) + 1 as n from src group by ch), {cf.fir_taps_sql('kaiser', (10, 20), (4, 26), FS)}, {conv_sql('taps', 'ev', source='src')}"


@query("pipeline_filter_psd", f"with {segments_sql(64, 0.5, source=_FILTERED).replace(', ' + LEN, '', 1)} select ch, k::int as k, k * {FS / 64!r}::double as freq, round(avg(p), 3) + 0.0 as psd, count(*)::bigint as n_segments from p group by ch, k")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Band-pass filtered event channels and their Welch spectra."""
    steps = Pipeline().append(filters.fir, f=fd.kaiser((10, 20), (4, 26), FS)).append(spectra.psd, nfft=64)
    return _psd(steps(ev(spark, sf_dir)))


# EDF: values as 16 bits can hold them
_SLOPE = 20000 / 65535
_EDF = f"{EV}, b as (select dense_rank() over (order by ch) - 1 as ch, idx, round_even((value - {-10000 + 32768 * _SLOPE!r}) / {_SLOPE!r}, 0) * {_SLOPE!r} + {-10000 + 32768 * _SLOPE!r} as value from ev)"


def recorded(spark: SparkSession, sf_dir: str) -> tuple[str, list[tuple[str, int]]]:
    """All samples of every event channel, written as a recording: its path, and the channels' names and lengths. Shorter
    channels and the last record are filled with zeros."""
    from ..sources import edf

    x = ev(spark, sf_dir)
    lengths = sorted(map(tuple, x.lengths().collect()))  # one row a channel
    n, k = max(1, -(-max((m for _, m in lengths), default=0) // 32)), len(lengths)
    values = {"version": "0", "patient": "x", "recording": "events", "start_date": "01.01.24", "start_time": "00.00.00", "header_bytes": 256 * (k + 1), "reserved_0": "", "num_records": n, "record_duration": 32 / FS, "num_signals": k, "names": [f"ch{i}" for i in range(k)], "transducers": [""] * k, "physical_dim": [""] * k, "physical_min": [-10000.0] * k, "physical_max": [10000.0] * k, "digital_min": [-32768.0] * k, "digital_max": [32767.0] * k, "prefiltering": [""] * k, "samples_per_record": [32] * k, "reserved_1": [""] * k}
    path = shared_path(spark, "events") + ".edf"
    ends = spark.createDataFrame(lengths, "ch string, n long")
    fill = spark.range(min((m for _, m in lengths), default=0), 32 * n).join(F.broadcast(ends), F.col("id") >= F.col("n"))
    padded = x.df.select("ch", "idx", "value").union(fill.select("ch", "id", F.lit(0.0)))
    edf.write(x.with_df(padded), edf.Header.from_dict(values), path)
    return path, lengths


def _cut(spark, back: DataFrame, lengths, start: int = 0) -> DataFrame:
    ends = spark.createDataFrame([(i, m) for i, (_, m) in enumerate(lengths)], "ch int, n long")
    return back.join(F.broadcast(ends), "ch").where(F.col("idx") + start < F.col("n")).select("ch", "idx", _r("value", 2))


@query("edf_roundtrip", f"with {_EDF} select ch::int as ch, idx::bigint as idx, round(value, 2) + 0.0 as value from b")
def edf_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All samples of every event channel, written as a recording and read back."""
    from ..sources import edf

    path, lengths = recorded(spark, sf_dir)
    return _cut(spark, edf.read(spark, path).df, lengths)


@query("edf_subrange", f"with {_EDF} select ch::int as ch, idx - 37 as idx, round(value, 2) + 0.0 as value from b where ch in (1, 3) and idx >= 37 and idx < 1000")
def edf_subrange(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples 37 .. 1000 of two channels of the recording."""
    from ..sources import edf

    path, lengths = recorded(spark, sf_dir)
    return _cut(spark, edf.read(spark, path, [1, 3], 37, 1000).df, lengths, 37)


@query("edf_split", f"with {_EDF} select case when ch = 2 then 'a' else 'b' end as file, (case when ch = 2 then 0 else ch end)::int as ch, idx::bigint as idx, round(value, 2) + 0.0 as value from b where ch < 3")
def edf_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recording split in two files, read again."""
    from ..sources import edf

    path, lengths = recorded(spark, sf_dir)
    a, b = edf.split(spark, path, {"a": [2], "b": [0, 1]}, shared_path(spark, "split"))
    parts = [_cut(spark, edf.read(spark, p).df, x).select(F.lit(n).alias("file"), "ch", "idx", "value") for p, n, x in ((a, "a", lengths[2:3]), (b, "b", lengths[:2]))]
    return parts[0].union(parts[1])


@query("edf_header", f"with {EV}, {LEN}, r as (select (max(n) + 31) // 32 * 32 as n from len) select (dense_rank() over (order by ch) - 1)::int as ch, 'ch' || (dense_rank() over (order by ch) - 1) as name, 100.0::double as fs, r.n::bigint as n, round({_SLOPE!r}::double, 9) as slope from len, r")
def edf_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each signal of the recording."""
    from ..sources import edf

    return edf.headers(spark, recorded(spark, sf_dir)[0]).select("ch", "name", "fs", "n", F.round("slope", 9).alias("slope"))


def queries() -> dict:
    return {k: f for k, (f, _) in _Q.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _Q.items() if sql}
