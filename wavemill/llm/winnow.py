"""Document fingerprints by winnowing.

Of every window of `window` consecutive k-gram hashes the smallest is kept, the rightmost of equal ones, with its place.
Two texts that share a passage of window + k - 1 code points therefore share at least one fingerprint of it.
"""

from __future__ import annotations

import base64
import hashlib
import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import BASE, U64, lean, mix, utf8

K, WINDOW = 8, 16
#: Windows that are worked on at once.
STEP = 1 << 18
#: Rows of a range of ids; its bounds, eight bytes each, are all that the driver holds of the table.
RANGE_ROWS = 50_000


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def winnow(points: np.ndarray, k: int = K, window: int = WINDOW, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """(places, 32-bit hashes) of the kept k-grams, by place. A text shorter than k is one gram of its own length; one with
    fewer than `window` grams is one window; an empty text has none. Windows are worked on `step` at a time, so a text of any
    length takes little more memory than itself."""
    n = len(points)
    if not n:
        return np.zeros(0, np.uint32), np.zeros(0, np.uint32)
    k = min(k, n)
    w = min(window, n - k + 1)
    out: list[np.ndarray] = []
    for i in range(0, n - k - w + 2, step):
        m = min(step, n - k - w + 2 - i)  # windows that begin at i .. i + m - 1
        kept = _minima(points[i : i + m + w + k - 2], k, w, i)
        if out and out[-1][-1] == kept[0]:
            kept = kept[1:]
        if len(kept):
            out.append(kept)
    kept = np.concatenate(out)
    return (U64(0xFFFFFFFF) - (kept & U64(0xFFFFFFFF))).astype(np.uint32), (kept >> U64(32)).astype(np.uint32)


def _minima(points: np.ndarray, k: int, w: int, first: int) -> np.ndarray:
    """The least key (hash, then place downwards: the rightmost of the least hashes) of every w grams, each once in a row."""
    p = points.astype(np.uint64) * U64(2) + U64(1)
    m = len(p) - k + 1
    grams = p[k - 1 :].copy()
    for j in range(k - 2, -1, -1):
        grams *= U64(BASE)
        grams += p[j : j + m]
    key = mix(grams) >> U64(32) << U64(32) | (U64(0xFFFFFFFF) - np.arange(first, first + m, dtype=np.uint64))
    span = 1
    while span * 2 <= w:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    if span < w:
        key = np.minimum(key[: len(key) - (w - span)], key[w - span :])
    return key[np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))]


def encode(places: np.ndarray, hashes: np.ndarray) -> str:
    """Little-endian (place, hash) pairs in base64."""
    return base64.b64encode(np.stack([places, hashes], 1).astype("<u4").tobytes()).decode()


def decode(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(base64.b64decode(fingerprint), "<u4").reshape(-1, 2)
    return x[:, 0], x[:, 1]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets of hashes; 1 for two empty ones."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = len(a) + len(b) - len(np.union1d(a, b))
    return both / (len(a) + len(b) - both)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, window: int = WINDOW) -> DataFrame:
    """(id, fingerprint) of every row: the operator by itself, without any shuffle. Null texts are empty."""

    def run(batches):
        for b in batches:
            data, off = utf8(b.column(1))
            out = [encode(*winnow(code_points(data[off[r] : off[r + 1]].tobytes().decode("utf-8", "replace")), k, window)) for r in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["id", "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(lean(run), "id long, fingerprint string")


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _place(bounds: list[int]) -> tuple[Column, Column]:
    """How many of the sorted bounds are at most doc_id (0 for a null id), and whether one is doc_id itself. Looked up in two
    steps of about sqrt(bounds) comparisons each."""
    if not bounds:
        return F.lit(0), F.lit(False)
    m = math.isqrt(len(bounds)) + 1
    groups = [bounds[i : i + m] for i in range(0, len(bounds), m)]
    held = F.from_json(F.lit(json.dumps(groups)), "array<array<bigint>>")
    tops = F.from_json(F.lit(json.dumps([g[0] for g in groups])), "array<bigint>")
    i = F.size(F.filter(tops, lambda x: x <= F.col("doc_id")))
    group = F.get(held, i - 1)
    place = F.when(i > 0, (i - 1) * m + F.size(F.filter(group, lambda x: x <= F.col("doc_id")))).otherwise(0)
    return F.coalesce(place, F.lit(0)).cast("int"), F.coalesce(F.array_contains(group, F.col("doc_id")), F.lit(False))


def compare_edited(docs: DataFrame, k: int = K, window: int = WINDOW, buckets: int | None = None) -> DataFrame:
    """For every row (doc_id, text): fingerprints of the text and of an edited text, whose last half is replaced by the
    beginning of the next row's text (by doc_id; after the last comes the first), and their likenesses.

    Null ids come first; rows of equal ids come by checksum, then text; null texts are empty; a lone row is its own
    next; an empty table gives no rows; a text may be as long as a row can be (a task holds two texts, their fingerprints
    and the arrays of one block of windows). Rows go to ranges of ids whose bounds are ids of the table, one for every
    RANGE_ROWS rows; the row at a bound goes to the range before it too, and the first row to the last range, so neighbours
    meet after one shuffle. Equal ids stay in one range. Further columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ids = rows.select("doc_id")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    least, none, n = ids.agg(F.min("doc_id"), F.max(F.col("doc_id").isNull().cast("int")), F.count("*")).first()
    want = buckets or max(4 * parts, -(-n // RANGE_ROWS))
    bounds = sorted(set(ids.approxQuantile("doc_id", [i / want for i in range(1, want)], 0.2 / want))) if want > 1 and n else []
    if bounds:  # quantiles are doubles; the least id from each on is an exact long of the table
        place, _ = _place([min(int(x), 2**63 - 1) for x in bounds])
        first = ids.groupBy(place.alias("n")).agg(F.min("doc_id").alias("low")).where("n > 0")
        bounds = sorted(r.low for r in first.collect())  # a row for each range
    start = None if none else least
    bucket, at_bound = _place(bounds)
    one = F.struct(bucket.alias("bucket"), F.lit(0).alias("after"))
    before = F.struct((bucket - 1).alias("bucket"), F.lit(1).alias("after"))
    wrap = F.struct(F.lit(len(bounds)).alias("bucket"), F.lit(2).alias("after"))
    to = F.filter(F.array(one, F.when(at_bound, before), F.when(F.col("doc_id").eqNullSafe(F.lit(start)), wrap)), lambda x: x.isNotNull())
    dealt = rows.select("doc_id", "text", F.explode(to).alias("to")).select("to.bucket", "to.after", "doc_id", "text")
    dealt = dealt.repartition(parts, "bucket").sortWithinPartitions("bucket", "after", F.col("doc_id").asc_nulls_first(), F.crc32(F.col("text").cast("binary")), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held: tuple | None = None  # (bucket, after, doc_id, text, places, hashes)

        def finish(a, b) -> None:
            text, n = a[3], len(a[3])
            half = n // 2
            edited = text[: n - half] + b[3][:half]
            fp, efp = a[4], winnow(code_points(edited), k, window)
            mine = np.unique(fp[1])
            out.append((a[2], n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), encode(*fp), encode(*efp), likeness(mine, np.unique(efp[1])), likeness(mine, np.unique(b[4][1]))))

        def flush():
            cols = list(zip(*out, strict=True))
            out.clear()
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], [x.split()[0] for x in SCHEMA.split(", ")])

        for b in batches:
            data, off = utf8(b.column(3))
            for r, (bucket, after, i) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                if held is not None and held[1] and held[0] == bucket:
                    continue  # only the first row after a range is wanted
                text = data[off[r] : off[r + 1]].tobytes().decode("utf-8", "replace")
                row = (bucket, after, i, text, winnow(code_points(text), k, window))
                if held is not None and not held[1] and held[0] == bucket:
                    finish(held, row)
                held = row
                if len(out) >= 500:
                    yield flush()
        if out:
            yield flush()

    return dealt.mapInArrow(lean(run), SCHEMA)
