"""European Data Format: header and samples from any file system that Spark reads, writing, and splitting by channels.

A file is a header of 256 bytes and 256 for each signal, then records, each with `samples_per_record` 16-bit integers of every
signal in turn. Physical values are slope * digital + offset. Signals may have different rates; each has its own idx.
"""

from __future__ import annotations

import math
import os
from dataclasses import dataclass, field
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.signal import Signal

# Fields, widths and types of the header, in order
FILE_FIELDS = (
    ("version", 8, str),
    ("patient", 80, str),
    ("recording", 80, str),
    ("start_date", 8, str),
    ("start_time", 8, str),
    ("header_bytes", 8, int),
    ("reserved_0", 44, str),
    ("num_records", 8, int),
    ("record_duration", 8, float),
    ("num_signals", 4, int),
)
SIGNAL_FIELDS = (
    ("names", 16, str),
    ("transducers", 80, str),
    ("physical_dim", 8, str),
    ("physical_min", 8, float),
    ("physical_max", 8, float),
    ("digital_min", 8, float),
    ("digital_max", 8, float),
    ("prefiltering", 80, str),
    ("samples_per_record", 8, int),
    ("reserved_1", 32, str),
)
ANNOTATION = "EDF Annotations"


@dataclass
class Header:
    values: dict = field(default_factory=dict)

    def __getattr__(self, name):
        try:
            return self.__dict__["values"][name]
        except KeyError:
            raise AttributeError(name) from None

    @classmethod
    def from_dict(cls, values: dict) -> Header:
        want = {n for n, _, _ in (*FILE_FIELDS, *SIGNAL_FIELDS)}
        if set(values) != want:
            raise ValueError(f"header fields differ: {sorted(set(values) ^ want)}")
        return cls(dict(values))

    @classmethod
    def parse(cls, raw: bytes) -> Header:
        out, at = {}, 0
        for name, width, kind in FILE_FIELDS:
            out[name] = kind(raw[at : at + width].decode("ascii").strip())
            at += width
        for name, width, kind in SIGNAL_FIELDS:
            out[name] = [kind(raw[at + i * width : at + (i + 1) * width].decode("ascii").strip()) for i in range(out["num_signals"])]
            at += width * out["num_signals"]
        return cls(out)

    def encode(self) -> bytes:
        out = []
        for name, width, kind in (*FILE_FIELDS, *SIGNAL_FIELDS):
            v = self.values[name]
            for x in v if isinstance(v, list) else [v]:
                text = f"{x:.10g}" if kind is float else str(x)
                out.append(text.encode("ascii")[:width].ljust(width))
        return b"".join(out)

    @property
    def channels(self) -> list[int]:
        """Signals that hold samples, not annotations."""
        return [i for i, n in enumerate(self.names) if n != ANNOTATION]

    @property
    def annotated(self) -> bool:
        """Whether some signal holds annotations."""
        return ANNOTATION in self.names

    @property
    def annotation(self) -> int | None:
        """The number of the first signal that holds annotations."""
        return self.names.index(ANNOTATION) if self.annotated else None

    @property
    def samples(self) -> list[int]:
        return [self.samples_per_record[i] * self.num_records for i in self.channels]

    @property
    def slopes(self) -> list[float]:
        return [(self.physical_max[i] - self.physical_min[i]) / (self.digital_max[i] - self.digital_min[i]) for i in range(self.num_signals)]

    @property
    def offsets(self) -> list[float]:
        return [self.physical_min[i] - s * self.digital_min[i] for i, s in enumerate(self.slopes)]

    @property
    def record_map(self) -> list[tuple[int, int]]:
        """Each signal's place in a record, in samples."""
        ends = np.cumsum([0, *self.samples_per_record]).tolist()
        return list(zip(ends, ends[1:], strict=False))

    def filter(self, signals) -> Header:
        signals = list(signals)
        out = {k: [v[i] for i in signals] if isinstance(v, list) else v for k, v in self.values.items()}
        out["num_signals"] = len(signals)
        out["header_bytes"] = 256 * (len(signals) + 1)
        return Header(out)


def _bytes(spark: SparkSession, path: str, start: int, length: int) -> bytes:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark._jsc.hadoopConfiguration()).open(p)
    try:
        stream.seek(start)
        return bytes(stream.readNBytes(length))
    finally:
        stream.close()


def read_header(spark: SparkSession, path: str) -> Header:
    n = int(_bytes(spark, path, 252, 4).decode("ascii").strip())
    return Header.parse(_bytes(spark, path, 0, 256 * (n + 1)))


def headers(spark: SparkSession, pattern: str) -> DataFrame:
    """A row for each signal of each file: path, ch, name, units, range, rate, slope, offset and samples."""

    def run(batches):
        for b in batches:
            for path, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                h = Header.parse(raw.as_py())
                rows = [{"path": path, "ch": i, "name": h.names[i], "physical_dim": h.physical_dim[i], "fs": h.samples_per_record[i] / h.record_duration, "n": h.samples_per_record[i] * h.num_records, "slope": h.slopes[i], "offset": h.offsets[i]} for i in h.channels]
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("path", pa.string()), ("ch", pa.int32()), ("name", pa.string()), ("physical_dim", pa.string()), ("fs", pa.float64()), ("n", pa.int64()), ("slope", pa.float64()), ("offset", pa.float64())]))

    files = spark.read.format("binaryFile").load(pattern).select("path", "content")
    return files.mapInArrow(run, "path string, ch int, name string, physical_dim string, fs double, n long, slope double, offset double")


#: Bytes of records that are read or written at once; a task works on several such pieces in turn.
PIECE = 4 << 20


def _qualified(spark: SparkSession, path: str) -> str:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()


def _local(uri: str) -> str | None:
    """The path of a file that tasks can open as such (on a cluster: of a file system that is mounted everywhere)."""
    return unquote(urlparse(uri).path) if urlparse(uri).scheme in ("", "file") else None


def _ranges(uri: str):
    """A function (offset, length) -> bytes over the file, or None if its file system can be read by Spark's readers only."""
    if local := _local(uri):
        f = open(local, "rb")
        return lambda at, n: os.pread(f.fileno(), n, at) if f else b""
    try:
        from pyarrow import fs

        files, name = fs.FileSystem.from_uri(uri)
        f = files.open_input_file(name)
        return lambda at, n: f.read_at(n, at)
    except (pa.ArrowException, OSError, ValueError, NotImplementedError):
        return None


def _tasks(spark: SparkSession, pieces: int) -> DataFrame:
    """Numbers of pieces, dealt to tasks of 16 pieces at most."""
    return spark.range(0, pieces, 1, max(1, min(pieces, max(2 * spark.sparkContext.defaultParallelism, -(-pieces // 16)))))


def _column(c: int, first: int, x: np.ndarray, start: int, stop: int | None, h: Header) -> pa.RecordBatch:
    """Rows of channel c from its digital samples first, first + 1, ..., as far as they lie in start .. stop."""
    lo, hi = max(0, start - first), len(x) if stop is None else max(0, min(len(x), stop - first))
    x = x[lo:hi]
    idx = first + lo - start + np.arange(len(x), dtype=np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(x), c, np.int32)), pa.array(idx), pa.array(x * h.slopes[c] + h.offsets[c])], ["ch", "idx", "value"])


def read(spark: SparkSession, path: str, channels=None, start: int = 0, stop: int | None = None, padvalue: float | None = None) -> Signal:
    """Samples start .. stop of the channels of one recording, idx from 0 at start. Channels may differ in rate (`rates`); each
    has its own idx. With `padvalue` (NaN, say) shorter channels are filled up to the longest.

    Tasks read the ranges of records that are asked for, in any file system that Arrow opens. Of one that only Spark's readers
    open, all records are read, in pieces of the greatest length that divides header and records, and cut afterwards.
    """
    h = read_header(spark, path)
    channels = h.channels if channels is None else channels
    if isinstance(channels, (str, int)):
        raise ValueError("channels are a sequence of numbers")
    channels = list(channels)
    spr, places, size, head = h.samples_per_record, h.record_map, 2 * sum(h.samples_per_record), h.header_bytes
    first = min((start // spr[c] for c in channels), default=0)
    end = h.num_records if stop is None else min(h.num_records, max((-(-stop // spr[c]) for c in channels), default=0))
    uri = _qualified(spark, path)
    schema = "ch int, idx long, value double"
    if _ranges(uri) is not None:
        per = max(1, PIECE // size)

        def decode(batches):
            get = _ranges(uri)
            for b in batches:
                for k in b.column(0).to_pylist():
                    rec = first + k * per
                    x = np.frombuffer(get(head + rec * size, min(per, end - rec) * size), "<i2").reshape(-1, size // 2)
                    for c in channels:
                        lo, hi = places[c]
                        yield _column(c, rec * spr[c], x[:, lo:hi].ravel(), start, stop, h)

        df = _tasks(spark, max(0, -(-(end - first) // per))).mapInArrow(decode, schema)
    else:
        g = math.gcd(size, head)
        form = "org.apache.spark.input.FixedLengthBinaryInputFormat"
        numbered = spark.sparkContext.newAPIHadoopFile(path, form, "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.BytesWritable", conf={f"{form}.recordLength": str(g)})

        def samples(rows):
            for k, raw in rows:
                at = k * g - head  # a record's samples follow each other, so a piece lies in one record
                if at >= 0 and first <= at // size < end:
                    yield at // size, at % size // 2, bytearray(raw)

        def cut(batches):
            for b in batches:
                for rec, at, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                    x = np.frombuffer(raw, "<i2")
                    for c in channels:
                        lo, hi = max(places[c][0], at), min(places[c][1], at + len(x))
                        if lo < hi:
                            yield _column(c, rec * spr[c] + lo - places[c][0], x[lo - at : hi - at], start, stop, h)

        df = spark.createDataFrame(numbered.mapPartitions(samples), "record long, at int, raw binary").mapInArrow(cut, schema)
    if padvalue is not None and channels:
        most = max(spr[c] for c in channels) * h.num_records
        upto = most if stop is None else min(stop, most)
        for c in channels:
            n = max(start, spr[c] * h.num_records)
            if n < upto:
                df = df.union(spark.range(n - start, upto - start).select(F.lit(c).cast("int"), "id", F.lit(float(padvalue))))
    rates = {c: spr[c] / h.record_duration for c in channels}
    return Signal(df, ("ch",), next(iter(rates.values()), 1.0), rates)


def _create(local: str, header: Header, size: int) -> None:
    os.makedirs(os.path.dirname(local), exist_ok=True)
    with open(local, "wb") as f:
        f.write(header.encode())
        f.truncate(header.header_bytes + size * header.num_records)


def _put(local: str, at: int, raw: bytes) -> None:
    f = os.open(local, os.O_WRONLY)
    try:
        while raw:
            n = os.pwrite(f, raw, at)
            at, raw = at + n, raw[n:]
    finally:
        os.close(f)


def write(sig: Signal, header: Header, path: str) -> None:
    """Writes a recording. In a file system that tasks can open, each writes its records at their place of the file (again, if
    it is run again); elsewhere records are encoded in parallel and go through one stream in order.

    Channel i of the header is the signal's i-th key in order. Values beyond the digital range are clipped.
    """
    spark, h, key = sig.df.sparkSession, header, sig.keys[-1]
    lengths = sorted((r[0], r[1]) for r in sig.df.groupBy(key).agg(F.count("*")).collect())  # one row a channel
    if len(lengths) != h.num_signals:
        raise ValueError(f"{len(lengths)} channels for {h.num_signals} signals")
    spr, size = h.samples_per_record, 2 * sum(h.samples_per_record)
    if any(n != spr[i] * h.num_records for i, (_, n) in enumerate(lengths)):
        raise ValueError("samples aren't a whole number of records")
    local = _local(_qualified(spark, path))
    per = max(1, PIECE // size) if local else 1
    place, each = (F.create_map(*[F.lit(x) for i, (c, _) in enumerate(lengths) for x in (c, v[i])])[F.col(key)] for v in (range(len(lengths)), spr))
    slopes, offsets, low, high = (np.array(v, float) for v in (h.slopes, h.offsets, h.digital_min, h.digital_max))
    x = sig.df.withColumn("_i", place).withColumn("_record", F.expr("idx") - F.expr("idx") % each).withColumn("_record", (F.col("_record") / each).cast("long"))

    def encode(t: pa.Table) -> pa.Table:
        order = np.lexsort((t["idx"].to_numpy(), t["_i"].to_numpy(), t["_record"].to_numpy()))
        i = t["_i"].to_numpy()[order]
        v = np.rint((t["value"].to_numpy()[order] - offsets[i]) / slopes[i])
        raw = np.clip(v, low[i], high[i]).astype("<i2").tobytes()
        rec = int(t["_record"].to_numpy().min())
        if local:
            _put(local, h.header_bytes + rec * size, raw)
        return pa.table([pa.array([rec]), pa.array([len(raw)], pa.int64()), pa.array([None if local else raw], pa.binary())], ["record", "n", "raw"])

    rows = x.select("_i", "_record", "idx", "value", F.expr(f"_record div {per}").alias("_piece")).groupBy("_piece").applyInArrow(encode, "record long, n long, raw binary")
    if local:
        _create(local, h, size)
        done = rows.agg(F.sum("n")).first()[0] or 0
        if done != size * h.num_records:
            raise ValueError(f"{done} bytes of {size * h.num_records}: samples aren't gapless")
        return
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(h.encode()))
        for r in rows.orderBy("record").toLocalIterator():  # a partition of records at a time
            out.write(r.raw)
    finally:
        out.close()


def split(spark: SparkSession, path: str, mapping: dict[str, list[int]], folder: str) -> list[str]:
    """One file for every name of the mapping, with its channels. Where tasks can open the files, the recording is read once and
    its channels' bytes are written to their places as they are; elsewhere it is read once for each file."""
    h = read_header(spark, path)
    out = [f"{folder}/{name}" + ("" if name.endswith(".edf") else ".edf") for name in mapping]
    heads = [h.filter(c) for c in mapping.values()]
    uri = _qualified(spark, path)
    local = [_local(_qualified(spark, at)) for at in out]
    if _local(uri) is None or None in local:
        for at, channels, head in zip(out, mapping.values(), heads, strict=True):
            write(read(spark, path, channels), head, at)
        return out
    size, first, n, places = 2 * sum(h.samples_per_record), h.header_bytes, h.num_records, h.record_map
    per = max(1, PIECE // size)
    to = [(at, head.header_bytes, list(channels)) for at, head, channels in zip(local, heads, mapping.values(), strict=True)]
    for (at, _, _), head in zip(to, heads, strict=True):
        _create(at, head, 2 * sum(head.samples_per_record))

    def copy(batches):
        get = _ranges(uri)
        for b in batches:
            for k in b.column(0).to_pylist():
                rec = k * per
                x = np.frombuffer(get(first + rec * size, min(per, n - rec) * size), "<i2").reshape(-1, size // 2)
                for at, head, channels in to:
                    part = np.concatenate([x[:, slice(*places[c])] for c in channels], 1)
                    _put(at, head + rec * 2 * part.shape[1], part.tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0)], ["piece"])

    _tasks(spark, -(-n // per)).mapInArrow(copy, "piece long").count()
    return out
