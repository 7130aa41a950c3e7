"""Readers of annotation text files, and file-name utilities as plans."""

from __future__ import annotations

import csv
import io

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# The columns of an annotation file and the form of its times
COLUMNS = ("Annotation", "Start Time", "End Time", "Time From Start", "Channel")
STAMPS = ("MM/dd/yy HH:mm:ss.SSSSSS", "MM/dd/yy HH:mm:ss.SSS", "MM/dd/yy HH:mm:ss")


def seconds_between(start, stop):
    """Seconds from one written time to another, as a column; null where either isn't of a known form."""
    first, last = (F.coalesce(*(F.unix_micros(F.try_to_timestamp(c, F.lit(f))) for f in STAMPS)) for c in (start, stop))
    return (last - first) / 1e6


def read_annotations(spark: SparkSession, path: str, start: int = 0, delimiter: str = "\t", labels=None, quote: str = '"') -> DataFrame:
    """(label, time, duration, channel) of delimited text files, with `start` lines before their header row.

    Columns used: Annotation, Start Time, End Time (MM/dd/yy HH:mm:ss.ffffff), Time From Start (seconds), Channel; one that the
    header lacks is an error. Fields may be quoted. Lines without any field are left out; fields that a short row lacks, and
    numbers and times that can't be read, are null. Files are read each in a task, so one has to fit there.
    """

    def run(batches):
        for b in batches:
            for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                lines = csv.reader(io.StringIO(text.split("\n", start)[start] if text.count("\n") >= start else "", newline=""), delimiter=delimiter, quotechar=quote)
                head = [x.strip() for x in next(lines, [])]
                if missing := [c for c in COLUMNS if c not in head]:
                    raise ValueError(f"{name}: no columns {missing} in {head}")
                at = [head.index(c) for c in COLUMNS]
                rows = [[x[i].strip() if i < len(x) else None for i in at] for x in lines if any(map(str.strip, x))]
                cols = list(zip(*rows, strict=True)) or [()] * len(at)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], ["label", "start", "stop", "time", "channel"])

    files = spark.read.format("binaryFile").load(path).select("path", F.col("content").cast("string").alias("text"))
    x = files.mapInArrow(run, "label string, start string, stop string, time string, channel string")
    out = x.select("label", F.col("time").try_cast("double").alias("time"), seconds_between(F.col("start"), F.col("stop")).alias("duration"), "channel")
    return out if labels is None else labelled(out, labels)


def labelled(annotations: DataFrame, labels) -> DataFrame:
    """The annotations of a label, or of some."""
    return annotations.where(F.col("label").isin([labels] if isinstance(labels, str) else list(labels)))


def stem(path):
    """The last part of a path without its suffix."""
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def metadata(df: DataFrame, column: str, **patterns: str) -> DataFrame:
    """Adds `metadata`: the first group of each named pattern that matches, by name."""
    pairs = [x for n, p in patterns.items() for x in (F.lit(n), F.regexp_extract(column, p, 1))]
    return df.withColumn("metadata", F.map_filter(F.create_map(*pairs), lambda k, v: v != ""))


def match(paths: DataFrame, others: DataFrame, pattern: str) -> DataFrame:
    """(path, other): pairs whose other stem contains what the pattern finds in the path's; exactly one for every path.

    Both are lists of file names on which a person works. The containment is an equi-join on substrings of the key's length,
    so the tables aren't crossed."""
    a = paths.select("path", F.regexp_extract(stem(F.col("path")), pattern, 0).alias("key"))
    counts = a.agg(F.count_if(F.col("key") == ""), F.count("*")).first()
    if counts[0] or counts[1] != others.count():
        raise ValueError("the pattern isn't in every path, or the lists differ in length")
    lengths = a.select(F.length("key").alias("size")).distinct()
    s = stem(F.col("other"))
    b = others.select(F.col("path").alias("other")).join(F.broadcast(lengths), F.length(s) >= F.col("size"))
    b = b.select("other", F.explode(F.transform(F.sequence(F.lit(1), F.length(s) - F.col("size") + 1), lambda i: F.substring(s, i, F.col("size")))).alias("key")).distinct()
    out = a.join(b, "key").select("path", "other")
    n = out.groupBy("path").count().agg(F.count("*"), F.max("count")).first()
    if n[0] != counts[1] or (n[1] or 0) > 1:
        raise ValueError("some path has no match or several")
    return out


def mismatched(paths: DataFrame, others: DataFrame) -> DataFrame:
    """Stems that only one of the lists has."""
    a, b = (x.select(stem(F.col("path")).alias("stem")) for x in (paths, others))
    return a.subtract(b).union(b.subtract(a))


def rename_plan(paths: DataFrame, substring: str, replacement: str) -> DataFrame:
    """(path, renamed): what rename() would do."""
    return paths.select("path", F.replace("path", F.lit(substring), F.lit(replacement)).alias("renamed")).where("path <> renamed")


def rename(spark: SparkSession, paths: DataFrame, substring: str, replacement: str) -> int:
    """Renames files of Spark's file systems; returns how many."""
    n = 0
    for r in rename_plan(paths, substring, replacement).toLocalIterator():
        p = spark._jvm.org.apache.hadoop.fs.Path(r.path)
        n += bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).rename(p, spark._jvm.org.apache.hadoop.fs.Path(r.renamed)))
    return n


def list_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path): the files of a folder of any of Spark's file systems whose names fit a glob. The list is made on the driver."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    p = fs_path(f"{folder.rstrip('/')}/{pattern}")
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    names = sorted(s.getPath().toString() for s in found or [] if s.isFile())
    return spark.createDataFrame([(n,) for n in names], "path string")


def match_folders(spark: SparkSession, folder: str, other: str, pattern: str, glob: str = "*", other_glob: str = "*") -> DataFrame:
    """(path, other): match() of the files of two folders."""
    return match(list_files(spark, folder, glob), list_files(spark, other, other_glob), pattern)
