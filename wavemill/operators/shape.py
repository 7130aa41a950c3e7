"""Selection, masks, padding and extension of signals. All are plans of built-in operators; idx stays gapless."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .signal import Signal


def channels(sig: Signal, names, key: str | None = None) -> Signal:
    """Only the channels of the list."""
    return sig.with_df(sig.df.where(F.col(key or sig.keys[-1]).isin(list(names))))


def take_slice(sig: Signal, start: int | None = None, stop: int | None = None, step: int = 1) -> Signal:
    """Python's slice along the samples, for each key's own length."""
    if step == 0:
        raise ValueError("a step of 0")
    simple = step > 0 and (start or 0) >= 0 and (stop is None or stop >= 0)
    if simple:  # reaches the scan as a range of idx
        x = sig.df.where(F.col("idx") >= (start or 0))
        x = x if stop is None else x.where(F.col("idx") < stop)
        lo = F.lit(start or 0)
        return sig.with_df(x.where((F.col("idx") - lo) % step == 0).withColumn("idx", F.expr(f"(idx - {start or 0}) div {step}")))
    x = sig.df.join(sig.lengths(), list(sig.keys))
    n = F.col("n")

    def edge(v, default, low, high):
        if v is None:
            return default
        e = n + v if v < 0 else F.lit(v)
        return F.greatest(low, F.least(high, e))

    if step > 0:
        a, b = edge(start, F.lit(0), F.lit(0), n), edge(stop, n, F.lit(0), n)
        keep = (F.col("idx") >= a) & (F.col("idx") < b)
    else:
        a, b = edge(start, n - 1, F.lit(-1), n - 1), edge(stop, F.lit(-1), F.lit(-1), n - 1)
        keep = (F.col("idx") <= a) & (F.col("idx") > b)
    x = x.withColumn("_d", F.col("idx") - a).where(keep & (F.col("_d") % abs(step) == 0))
    return sig.with_df(x.withColumn("idx", F.expr(f"_d div {step}")).drop("n", "_d"))


def split(sig: Signal, at: int) -> tuple[Signal, Signal]:
    return take_slice(sig, 0, at), take_slice(sig, at)


def renumber(sig: Signal) -> Signal:
    """Gapless idx in the order of the old one. Counts by block first, so no task sorts more than a block."""
    width = 65_536
    keys = list(sig.keys)
    x = sig.df.withColumn("_b", F.expr(f"idx div {width}"))
    n = x.groupBy(*keys, "_b").agg(F.count("*").alias("_n"))
    before = n.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    rank = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy("idx"))
    return sig.with_df(x.withColumn("_r", rank).join(before, [*keys, "_b"]).withColumn("idx", (F.col("_before") + F.col("_r") - 1).cast("long")).drop("_b", "_r", "_before"))


def apply_mask(sig: Signal, mask: DataFrame) -> Signal:
    """Samples where mask (idx, keep) is true, renumbered; ends with the shorter of both."""
    return renumber(sig.with_df(sig.df.join(mask.where("keep").select("idx"), "idx", "left_semi").select(*sig.df.columns)))


def intervals(annotations: DataFrame, fs: float, bucket: int = 1 << 22) -> DataFrame:
    """Disjoint sample ranges (start, stop) that the annotations cover, ends rounded half to even.

    They are merged within buckets of samples by their starts; then a row for each bucket tells the next ones how far it
    reaches. A range that reaches into another bucket's may touch the next range instead of being one with it.
    """
    a = annotations.select(F.rint(F.col("time") * fs).cast("long").alias("a"), F.rint((F.col("time") + F.col("duration")) * fs).cast("long").alias("b")).where("b > a")
    a = a.withColumn("_b", F.floor(F.col("a") / bucket))
    w = Window.partitionBy("_b").orderBy("a", "b")
    x = a.withColumn("_new", F.when(F.col("a") <= F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1)), 0).otherwise(1))
    x = x.withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    merged = x.groupBy("_b", "_g").agg(F.min("a").alias("start"), F.max("b").alias("stop"))
    reach = a.groupBy("_b").agg(F.max("b").alias("_to"))  # a row for each bucket
    reach = reach.select("_b", F.max("_to").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)).alias("_from"))
    out = merged.join(reach, "_b").select(F.greatest("start", F.coalesce("_from", "start")).alias("start"), "stop")
    return out.where("start < stop")


def mask_by_annotations(sig: Signal, annotations: DataFrame, include: bool = True, bucket: int = 65_536) -> Signal:
    """Samples inside (or outside) the annotations' ranges, renumbered. An equi-join on buckets of samples, no theta join."""
    r = intervals(annotations, sig.fs).withColumn("_b", F.explode(F.sequence(F.expr(f"start div {bucket}"), F.expr(f"(stop - 1) div {bucket}"))))
    x = sig.df.withColumn("_b", F.expr(f"idx div {bucket}"))
    hit = (x["_b"] == r["_b"]) & (x["idx"] >= r["start"]) & (x["idx"] < r["stop"])
    return renumber(sig.with_df(x.join(r, hit, "left_semi" if include else "left_anti").drop("_b")))


def as_mask(spark, annotations: DataFrame, size: int, fs: float, include: bool = True) -> DataFrame:
    """(idx, keep) for all samples below size."""
    r = Signal(spark.range(size).select(F.lit(0).alias("ch"), F.col("id").alias("idx"), F.lit(0.0).alias("value")), ("ch",), fs)
    i = intervals(annotations, fs)
    b = 65_536
    i = i.withColumn("_b", F.explode(F.sequence(F.expr(f"start div {b}"), F.expr(f"(stop - 1) div {b}"))))
    x = r.df.withColumn("_b", F.expr(f"idx div {b}"))
    hit = x.join(i, (x["_b"] == i["_b"]) & (x["idx"] >= i["start"]) & (x["idx"] < i["stop"]), "left_semi").select("idx", F.lit(True).alias("_in"))
    return r.df.select("idx").join(hit, "idx", "left").select("idx", (F.coalesce("_in", F.lit(False)) == F.lit(include)).alias("keep"))


def index_mask(spark, size: int, indices) -> DataFrame:
    """(idx, keep): true at ints, slices and lists of them."""
    flat, ranges = [], []

    def add(x):
        if isinstance(x, slice):
            ranges.append(x.indices(size))
        elif isinstance(x, (list, tuple)):
            for y in x:
                add(y)
        else:
            flat.append(int(x) % size)

    add(indices)
    keep = F.col("id").isin(flat) if flat else F.lit(False)
    for a, b, s in ranges:
        keep = keep | ((F.col("id") >= a) & (F.col("id") < b) & ((F.col("id") - a) % s == 0))
    return spark.range(size).select(F.col("id").alias("idx"), keep.alias("keep"))


def pad(sig: Signal, amount: int | tuple[int, int], value: float = 0.0, axis: str = "idx") -> Signal:
    """Constants before and after each key's samples, or (axis: an integer key from 0) as channels before and after."""
    if axis != "idx":
        return _pad_key(sig, (amount, amount) if isinstance(amount, int) else amount, float(value), axis)
    left, right = (amount, amount) if isinstance(amount, int) else amount
    keys = list(sig.keys)
    body = sig.df.select(*keys, (F.col("idx") + left).alias("idx"), "value")
    n = sig.lengths()
    none = F.expr("cast(array() as array<bigint>)")
    head = F.sequence(F.lit(0).cast("long"), F.lit(left - 1).cast("long")) if left else none
    tail = F.sequence(F.col("n") + left, F.col("n") + left + right - 1) if right else none
    ends = n.select(*keys, F.explode(F.concat(head, tail)).alias("idx"), F.lit(float(value)).alias("value"))
    return sig.with_df(body.unionByName(ends))


def _pad_key(sig: Signal, amount: tuple[int, int], value: float, axis: str) -> Signal:
    left, right = amount
    kind = sig.df.schema[axis].dataType
    body = sig.df.withColumn(axis, (F.col(axis) + left).cast(kind))
    top = sig.df.agg(F.max(axis)).first()[0]
    new = [*range(left), *range(left + top + 1, left + top + 1 + right)] if top is not None else []
    if not new:
        return sig.with_df(body)
    # the samples of channel 0, once for each new one
    blank = sig.df.where(F.col(axis) == 0).withColumn(axis, F.explode(F.lit(new).cast(T.ArrayType(kind)))).withColumn("value", F.lit(value))
    return sig.with_df(body.unionByName(blank))


def extend(sig: Signal, n: int, how: str = "edge") -> Signal:
    """n samples before and after: `zero`, `edge` (first and last repeated), `even` (mirrored without the edge) or `odd` (mirrored
    about the edge's value). even and odd need more than n samples."""
    if how == "zero":
        return pad(sig, n)
    keys = list(sig.keys)
    last = F.col("n") - 1
    ends = sig.df.groupBy(*keys).agg((F.max("idx") + 1).alias("n"), F.min_by("value", "idx").alias("_first"), F.max_by("value", "idx").alias("_last"))
    if how == "edge":
        head = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")), lambda k: F.struct(k.alias("idx"), F.col("_first").alias("value")))
        tail = F.transform(F.sequence(F.col("n") + n, F.col("n") + 2 * n - 1), lambda k: F.struct(k.alias("idx"), F.col("_last").alias("value")))
        more = ends.select(*keys, F.explode(F.concat(head, tail)).alias("s")).select(*keys, "s.idx", "s.value")
    elif how in ("even", "odd"):
        x = sig.df.join(ends, keys)
        x = x.where((F.col("n") > n) | F.raise_error(F.lit(f"extension by {n} needs more than {n} samples")).isNotNull())
        v = F.col("value")
        head = F.when(F.col("idx").between(1, n), F.struct((F.lit(n) - F.col("idx")).alias("idx"), (v if how == "even" else 2 * F.col("_first") - v).alias("value")))
        tail = F.when((F.col("idx") >= last - n) & (F.col("idx") < last), F.struct((2 * last - F.col("idx") + n).alias("idx"), (v if how == "even" else 2 * F.col("_last") - v).alias("value")))
        more = x.select(*keys, F.explode(F.filter(F.array(head, tail), lambda s: s.isNotNull())).alias("s")).select(*keys, "s.idx", "s.value")
    else:
        raise ValueError(f"unknown extension {how!r}")
    return sig.with_df(sig.df.select(*keys, (F.col("idx") + n).alias("idx"), "value").unionByName(more))


def zero_stuff(sig: Signal, factor: int, value: float = 0.0) -> Signal:
    """factor - 1 values after each sample."""
    between = F.posexplode(F.concat(F.array("value"), F.array_repeat(F.lit(float(value)), factor - 1)))
    x = sig.df.select(*sig.keys, "idx", between.alias("_p", "value"))
    return sig.with_df(x.withColumn("idx", F.col("idx") * factor + F.col("_p")).drop("_p"))


def squeeze(sig: Signal, key: str) -> Signal:
    """Drops a key of one value; more are an error when the plan runs."""
    one = sig.df.agg(F.count_distinct(key)).first()[0]
    if one > 1:
        raise ValueError(f"{key} has {one} values")
    return sig.with_df(sig.df.drop(key), keys=tuple(k for k in sig.keys if k != key))


def expand_dims(sig: Signal, key: str, value=0) -> Signal:
    return sig.with_df(sig.df.withColumn(key, F.lit(value)), keys=(key, *sig.keys))


def concatenate(parts: list[Signal]) -> Signal:
    """Signals one after the other, by key."""
    keys = list(parts[0].keys)
    x = None
    for k, p in enumerate(parts):
        y = p.df.select(*keys, F.lit(k).alias("_part"), "idx", "value")
        x = y if x is None else x.unionByName(y)
    n = x.groupBy(*keys, "_part").agg((F.max("idx") + 1).alias("_n"))
    before = n.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return parts[0].with_df(x.join(before, [*keys, "_part"]).withColumn("idx", F.col("idx") + F.col("_before")).drop("_part", "_before"))


def reverse(sig: Signal) -> Signal:
    x = sig.df.join(sig.lengths("_n"), list(sig.keys))
    return sig.with_df(x.withColumn("idx", F.col("_n") - 1 - F.col("idx")).drop("_n"))
