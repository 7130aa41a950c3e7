"""Signals as DataFrames: one row per sample (keys..., idx, value), and work on blocks of samples by one shuffle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..store import numbered

#: Samples of a block. Bounds a task's memory and sets its parallelism: channels x samples / BLOCK.
BLOCK = 65_536


@dataclass(frozen=True)
class Signal:
    """`df` has the columns keys..., idx (BIGINT from 0, gapless by key) and value (or re, im). `fs` is in samples a second;
    `rates` has those of channels with a rate of their own, by the value of the last key."""

    df: DataFrame
    keys: tuple[str, ...] = ("ch",)
    fs: float = 1.0
    rates: dict | None = None

    def with_df(self, df: DataFrame, **more) -> Signal:
        return replace(self, df=df, **more)

    def lengths(self, name: str = "n") -> DataFrame:
        """Samples by key; one row per channel."""
        return self.df.groupBy(*self.keys).agg((F.max("idx") + 1).alias(name))

    def chunked(self, width: int = BLOCK) -> DataFrame:
        """Blocked layout: keys, chunk, start, n, x (array in order)."""
        c = F.expr(f"idx div {width}")
        out = self.df.groupBy(*self.keys, c.alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("idx", "value"))).alias("s"))
        return out.select(*self.keys, "chunk", F.col("s")[0]["idx"].alias("start"), F.size("s").alias("n"), F.transform("s", lambda s: s["value"]).alias("x"))


def from_chunks(chunks: DataFrame, keys=("ch",), fs: float = 1.0) -> Signal:
    long = chunks.select(*keys, "start", F.posexplode("x").alias("pos", "value"))
    return Signal(long.select(*keys, (F.col("start") + F.col("pos")).alias("idx"), "value"), tuple(keys), fs)


def from_rows(df: DataFrame, keys, order, value, fs: float = 1.0, bucket: int | None = None) -> Signal:
    """Numbers the rows of each key in an order (ties in any order).

    Where the order is a whole number or a time (in microseconds), rows are ranked within buckets of it, `bucket` wide, and
    buckets are counted first; without a width, one look at the range of the order gives one for about BLOCK rows. So no task
    sorts a whole channel. Nulls come first. Any other order is numbered by ranges of (keys, order), which are written once.
    """
    keys = [keys] if isinstance(keys, (str, Column)) else list(keys)
    names = [k if isinstance(k, str) else f"k{i}" for i, k in enumerate(keys)]
    by = order if isinstance(order, Column) else F.col(order)
    x = df.select(*[F.col(k) if isinstance(k, str) else k.alias(n) for k, n in zip(keys, names, strict=True)], by.alias("_order"), (value if isinstance(value, Column) else F.col(value)).cast("double").alias("value"))
    kind = x.schema["_order"].dataType
    time = isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType))
    if time or isinstance(kind, T.IntegralType):
        number = F.unix_micros(F.col("_order").cast("timestamp")) if time else F.col("_order").cast("long")
        if bucket is None:
            low, high, n = x.agg(F.min(number), F.max(number), F.count("*")).first()
            bucket = min(1 << 62, max(1, -(-((high or 0) - (low or 0) + 1) * BLOCK // max(1, n))))
        at = F.floor(number / bucket) if time else F.expr(f"cast(_order as long) div {bucket}L")
    else:
        at = None
    if at is None:
        place = numbered(x, [*(F.col(n) for n in names), F.col("_order")], "_place")
        first = place.groupBy(*names).agg(F.min("_place").alias("_first"))
        out = _joined(place, first, names).select(*names, "value", (F.col("_place") - F.col("_first")).alias("idx"))
        return Signal(out, tuple(names), fs)
    # nulls are ties, so they may be dealt to buckets of their own
    x = x.withColumn("_b", F.coalesce(at.cast("long"), F.pmod(F.xxhash64("value"), F.lit(1024)) - F.lit(1 << 62)))
    n = x.groupBy(*names, "_b").agg(F.count("*").alias("_n"))
    before = n.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(*names).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    ranked = x.withColumn("_r", F.row_number().over(Window.partitionBy(*names, "_b").orderBy("_order")))
    out = _joined(ranked, before, [*names, "_b"]).select(*names, "value", (F.col("_before") + F.col("_r") - 1).cast("long").alias("idx"))
    return Signal(out, tuple(names), fs)


def _joined(x: DataFrame, small: DataFrame, names) -> DataFrame:
    """x with the columns of `small`, where both are equal in the names, nulls too."""
    small = small.withColumnsRenamed({n: f"_of_{n}" for n in names})
    hit = F.col(names[0]).eqNullSafe(F.col(f"_of_{names[0]}"))
    for n in names[1:]:
        hit = hit & F.col(n).eqNullSafe(F.col(f"_of_{n}"))
    return x.join(small, hit).drop(*(f"_of_{n}" for n in names))


def from_function(spark, make: Callable[[int], np.ndarray], parts: int, fs: float = 1.0) -> Signal:
    """Parts made on the executors, one after the other along the samples: make(k) gives channels x samples (or samples) of
    part k. Parts may differ in length, so each is made twice: once to be counted."""
    import pandas as pd

    def each(batches, what):
        for b in batches:
            for k in b["id"]:
                x = np.atleast_2d(np.asarray(make(int(k)), float))
                yield what(int(k), x)

    ids = spark.range(0, parts, 1, max(1, min(parts, 4 * spark.sparkContext.defaultParallelism)))
    sizes = ids.mapInPandas(lambda bs: each(bs, lambda k, x: pd.DataFrame({"k": [k], "n": [x.shape[1]], "channels": [x.shape[0]]})), "k long, n long, channels long")
    rows = sorted(map(tuple, sizes.collect()))  # a row for each part
    if len({c for _, n, c in rows if n}) > 1:
        raise ValueError("parts of different numbers of channels")
    starts = np.cumsum([0, *(n for _, n, _ in rows)])

    def long(k, x):
        idx = starts[k] + np.arange(x.shape[1])
        return pd.DataFrame({"d0": np.repeat(np.arange(len(x), dtype=np.int32), x.shape[1]), "idx": np.tile(idx, len(x)), "value": x.ravel()})

    return Signal(ids.mapInPandas(lambda bs: each(bs, long), "d0 int, idx long, value double"), ("d0",), fs)


def from_array(spark, x, axis: int = -1, fs: float = 1.0) -> Signal:
    """An array of any number of dimensions; the other axes become keys d0, d1, ... A list of arrays is joined along the axis.

    The array is on the driver already; large recordings come from a source or Parquet."""
    if isinstance(x, (list, tuple)):
        x = np.concatenate([np.asarray(p) for p in x], axis)
    if not isinstance(x, np.ndarray):
        raise TypeError(f"not a signal: {type(x).__name__}")
    x = np.moveaxis(x, normalize_axis(axis, x.ndim), -1)
    flat, shape = x.reshape(-1, x.shape[-1]), x.shape[:-1]
    keys = [f"d{i}" for i in range(len(shape))] or ["d0"]
    where = np.unravel_index(np.repeat(np.arange(len(flat)), x.shape[-1]), shape or (1,))
    cols = {k: w.astype(np.int32) for k, w in zip(keys, where, strict=True)} | {"idx": np.tile(np.arange(x.shape[-1], dtype=np.int64), len(flat)), "value": flat.ravel().astype(float)}
    return Signal(spark.createDataFrame(pa.table(cols)), tuple(keys), fs)


def to_array(sig: Signal, limit: int = 1 << 28) -> np.ndarray:
    """keys x samples on the driver; refused beyond `limit` bytes. Ragged channels end in NaN."""
    n, k = sig.lengths().agg(F.max("n"), F.count("*")).first()
    if (n or 0) * k * 8 > limit:
        raise MemoryError(f"{n * k * 8} bytes are over the limit of {limit}; write the signal instead")
    t = sig.df.orderBy(*sig.keys, "idx").toPandas()
    out = np.full((k, n or 0), np.nan)
    out[t.groupby(list(sig.keys), sort=True).ngroup(), t["idx"]] = t["value"]
    return out


def normalize_axis(axis: int, ndim: int) -> int:
    if not -ndim <= axis < ndim:
        raise IndexError(f"axis {axis} of {ndim} dimensions")
    return axis % ndim


def key_fields(sig: Signal) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sig.df.select(*sig.keys).schema)


def block_apply(sig: Signal, low: Column, high: Column, fn: Callable[[int, np.ndarray, np.ndarray], dict], out: dict[str, str], values: tuple[str, ...] = ("value",)) -> DataFrame:
    """fn(block, idx, values) on every block, to which the samples with low <= block <= high have been sent.

    low and high are numbers of blocks as columns of idx; a sample that several blocks need is sent to each, and the rest
    once, so one shuffle does, its size 1 + halo/block of the signal. Within a block samples come in order. fn returns
    arrays by name of `out` (name -> Spark type).
    """
    keys = list(sig.keys)
    dealt = sig.df.select(*keys, "idx", *values, F.explode(F.sequence(low.cast("long"), high.cast("long"))).alias("block"))
    schema = T._parse_datatype_string(", ".join(f"{n} {t}" for n, t in out.items()))
    kinds = {f.name: arrow_type(f.dataType) for f in schema}

    def run(t: pa.Table) -> pa.Table:
        idx = t["idx"].to_numpy()
        order = np.argsort(idx, kind="stable")
        v = np.stack([t[c].to_numpy()[order].astype(float) for c in values])
        got = fn(t["block"][0].as_py(), idx[order], v[0] if len(values) == 1 else v)
        n = len(next(iter(got.values())))
        cols = [pa.array([t[k][0].as_py()] * n, t[k].type) for k in keys]
        return pa.table([*cols, *(pa.array(got[c], kinds[c]) for c in out)], [*keys, *out])

    return dealt.groupBy(*keys, "block").applyInArrow(run, key_fields(sig) + ", " + ", ".join(f"{n} {t}" for n, t in out.items()))


def map_blocks(sig: Signal, fn: Callable[[int, np.ndarray, np.ndarray], np.ndarray], halo: int = 0, block: int = BLOCK) -> Signal:
    """A function of the user's on every block: fn(block, idx, values), with `halo` samples of the neighbours on both sides
    where there are any, gives a value for each sample of the block itself."""

    def own(b, idx, x):
        at = (idx >= b * block) & (idx < (b + 1) * block)
        y = np.asarray(fn(b, idx, x), float)
        if len(y) != at.sum():
            raise ValueError(f"{len(y)} values for the {at.sum()} samples of a block")
        return {"idx": idx[at], "value": y}

    last = F.max("idx").over(Window.partitionBy(*sig.keys)) if halo else F.lit(None)
    x = sig if not halo else sig.with_df(sig.df.withColumn("_last", last))
    low, high = F.greatest(F.lit(0), F.expr(f"(idx - {halo}) div {block}")), F.expr(f"(idx + {halo}) div {block}")
    if halo:
        high = F.least(high, F.expr(f"_last div {block}"))
    return sig.with_df(block_apply(x, low, high, own, {"idx": "bigint", "value": "double"}))


def arrow_type(kind: T.DataType) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "array<double>": pa.list_(pa.float64())}[kind.simpleString()]


def dense(idx: np.ndarray, x: np.ndarray, start: int, stop: int) -> np.ndarray:
    """x at start..stop-1, zeros where there is no sample."""
    out = np.zeros(stop - start)
    keep = (idx >= start) & (idx < stop)
    out[idx[keep] - start] = x[keep]
    return out
